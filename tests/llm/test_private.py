"""Personal data: seeds against the plain patterns, discoveries on planted cases, odd input."""

import hashlib
import random
import re

import pytest

from mnemo.llm import catalog, private
from mnemo.llm.private import KINDS, seeds

WORDS = "amber birch cedar dune elm fern grove heath iris juniper kelp larch moss nettle oak pine".split()


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def plain(text):
    """The contract's patterns as they stand."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15:
                out.append((kind, m))
    return [(kind, *m.span()) for kind, m in out]


def test_seeds_equal_the_plain_patterns():
    rng = random.Random(3)
    bits = ["a", "Z9", "@", ".", "-", "+", "%", " ", "é", "1", "255", "256", "007", "(", ")", "4111111111111111", "\n", "b.c", "x@y.de", "+1 ", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert list(seeds(text)) == plain(text), text


def test_long_words_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "1." * 300_000, "+1" * 300_000, "+" + " (" * 400_000):
        private._mentions(text)


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if luhn(body + d))


def phone(rng):
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"


@pytest.fixture(scope="module")
def planted():
    rng, rows, want = random.Random(4), [], {}
    noise = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    for i in range(60):
        rows.append((i, f"{noise(5)} {phone(rng)} {noise(4)} {card(rng)} {noise(5)}."))
    # The number behind it is swallowed by the strict phone pattern, and the phone by the card's.
    p, c = phone(rng), card(rng)
    rows.append((100, f"{noise(4)} {p} {c} {noise(3)}"))
    want[100] = {("phone", p), ("card", c)}
    # A seed written another way.
    rows += [(101, f"{noise(4)} jane.doe@mail.example.org {noise(4)}"), (102, f"{noise(3)} jane.doe (at) mail (dot) example (dot) org {noise(3)}")]
    want[102] = {("email", "jane.doe (at) mail (dot) example (dot) org")}
    # Clean: plain numbers, dates, versions.
    rows += [(200 + i, f"{noise(6)} {n} {noise(6)}") for i, n in enumerate(["2024-01-31", "12345678", "10.2.3", "1234 5678 9012", "3.14159265", "600,000"])]
    rows += [(300, None), (300, None), (301, ""), (None, rows[0][1]), (0, rows[0][1])]
    return rows, want


def test_planted_identifiers_are_found_and_clean_rows_left(spark, planted):
    rows, want = planted
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, place int").repartition(4)
    texts = {}
    for i, text in rows:
        texts.setdefault(i, text or "")
    got = {}
    for r in private.extract(table).collect():
        got.setdefault(r.doc_id, []).append([(KINDS[s.kind], s.start, s.end, s.base) for s in r.spans])
    assert sum(map(len, got.values())) == len(rows)
    for i, found in got.items():
        for spans in found:
            assert [s[:3] for s in spans if s[3]] == plain(texts[i])
            assert {(s[0], texts[i][s[1]:s[2]]) for s in spans if not s[3]} == want.get(i, set()), i
            assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def test_empty_table(spark):
    assert private.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_query_counts_the_strict_spans_of_each_kind(spark, tmp_path):
    texts = [
        "a@b.cd then x@y.de", "10.0.0.1 and 10.0.0.2", "4111 1111 1111 1111", "+1234567890 or +2345678901",
        "a@b.cd 10.0.0.1 4111111111111111 +1234567890 +2345678901", "none", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.op13_private(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        want = plain(text or "")
        assert [got[i][f"n_{kind}"] for kind in KINDS] == [sum(s[0] == kind for s in want) for kind in KINDS], text
        joined = ",".join(f"{kind}:{start}:{end}" for kind, start, end in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
