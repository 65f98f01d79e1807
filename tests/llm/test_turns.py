"""Conversation repair against all paths tried one by one; nulls, ties, repeats, odd columns."""

import hashlib
import random
import re
import zlib

import pytest

from mnemo.llm import turns
from mnemo.llm.turns import EditCosts, Repair

COSTS = EditCosts()
STEP = {0: 2, 1: 2, 2: 3, 3: 2}


def inserted(paths):
    """Every path again with none, one and two inserts behind it."""
    out = {}
    for start, held in paths.items():
        for cost, audit, lines in held:
            s = start
            for _ in range(3):
                out.setdefault(s, []).append((cost, audit, lines))
                cost, audit, lines = cost + COSTS.insert, audit + "I", (*lines, "assistant:" if s == 2 else "user:")
                s = STEP[s]
    return out


def plain(rows):
    """(cost, audit, lines) by trying every path; ``rows`` of (role, text, fault)."""
    paths = {0: [(0, "", ())]}
    for role, text, fault in rows:
        after = {}
        for s, held in inserted(paths).items():
            for cost, audit, lines in held:
                after.setdefault(s, []).append((cost + COSTS.delete, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                extra, line = COSTS.truncated if fault else 0, f"{role}:{text}"
                if role[:1] == "s" and s == 0:
                    after.setdefault(1, []).append((cost + extra, audit + "K", (*lines, line)))
                if role[:1] == ("a" if s == 2 else "u"):
                    after.setdefault(STEP[s], []).append((cost + extra, audit + "K", (*lines, line)))
                new = "assistant" if s == 2 else "user"
                after.setdefault(STEP[s], []).append((cost + extra + COSTS.rerole, audit + "R", (*lines, f"{new}:{text}")))
        paths = after
    ends = inserted(paths)
    return min(ends.get(0, []) + ends.get(3, []))


def test_survivors_equal_all_paths():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [
            (rng.choice(["user", "assistant", "system", "user", "assistant", " ", "", "x"]), "t",
             rng.choice([None, None, None, "blank", "duplicate", "truncated"]))
            for _ in range(rng.randint(0, 5))
        ]
        run, steps = Repair(COSTS), []
        for role, _, fault in rows:
            steps += run.add(role, fault)
        steps += run.end()
        edits = [e for step in steps for e in step]
        assert (run.cost, "".join(e for e, _ in edits)) == plain(rows)[:2], rows
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for e, role in edits if e != "D"))


def test_long_conversations_are_settled_as_they_go():
    rng, run, done, most = random.Random(6), Repair(COSTS), 0, 0
    for i in range(4000):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[i % 2]
        done += len(run.add(role, rng.choice([None] * 8 + ["blank", "truncated"])))
        most = max(most, i + 1 - done)
    assert most < 200


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def expected(conv, rows):
    rows, seen, marked = damaged(conv, rows), set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, lines = plain(marked)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for r, _, _ in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = [sum(f == kind for _, _, f in marked) for kind in turns.FAULTS]
    return (conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.fixture(scope="module")
def talks():
    rng, out = random.Random(7), {}
    for conv in [*range(60), None]:
        out[conv] = [
            (rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", None, "", "üser"]),
             rng.choice(["Hi.", "hm", None, " \n", "", "What?", "Größe!  ", "a\nb"]))
            for _ in range(rng.randint(1, 5))
        ]
    out[100] = [(1, "user", "Hi.")] * 3 + [(2, "assistant", "Yo.")] * 2
    return out


def test_query_columns_equal_the_plain_version(spark, talks):
    rows = [(c, t, r, x, 1, "e", "f") for c, held in talks.items() for t, r, x in held]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, way int, edit string, fault string").repartition(5)
    got = {r[0]: tuple(r) for r in turns.digest(turns.repair(turns.damage(table))).collect()}
    for conv, held in talks.items():
        want = expected(conv, held)
        assert got.get(conv, (conv, *[0] * 6, "", hashlib.sha256().hexdigest())) == want


def test_edits_are_rows_and_empty_tables_have_none(spark):
    table = spark.createDataFrame(
        [(1, 1, "system", "Be kind."), (1, 2, "user", "Hi."), (1, 4, "user", "Hello?"), (1, 5, "tool", "Yes.")],
        "conv_id int, turn int, role string, text string",
    )
    got = [tuple(r)[1:6] for r in turns.repair(table).collect()]
    assert got == [(1, "K", "system", "system", "Be kind."), (2, "D", "user", None, None), (4, "K", "user", "user", "Hello?"),
                   (5, "R", "tool", "assistant", "Yes.")]
    assert turns.digest(turns.repair(table.limit(0))).count() == 0
    assert turns.digest(turns.repair(turns.damage(table.limit(0)))).count() == 0
