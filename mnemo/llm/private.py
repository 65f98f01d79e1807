"""Personal data by bootstrapped contextual extraction.

Strict patterns find seeds. The words around a seed and its shape make lexical patterns; Spark
scores patterns by the known share of what they extract and candidates by the patterns that
extract them, in rounds, until nothing new becomes known. Candidates are wider forms of the same
kinds that the strict patterns miss: swallowed by a neighbouring number, written without a sign,
with other separators, or in words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from mnemo.llm.common import WordHash, spaced, utf8
from mnemo.sources.tables import stage

KINDS = ("email", "ip", "card", "phone")
# What a seed of each kind is. The e-mail pattern is in two halves, at the sign.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What a candidate of each kind looks like. Every repetition is bounded.
SIGN, DOT = r"(?:@|[\[(]at[\])])", r"(?:\.|[\[(]dot[\])])"
LABEL = r"[A-Za-z0-9-]{1,63}"
CANDIDATES = {
    "email": re.compile(
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:\x20?{SIGN}\x20?{LABEL}(?:\x20?{DOT}\x20?{LABEL}){{1,8}}"
        rf"|\x20at\x20{LABEL}(?:\x20dot\x20{LABEL}){{1,8}})(?![A-Za-z0-9])"
    ),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20./_-][0-9]{4}){3}(?:[\x20./_-]?[0-9]{1,3})?)(?![0-9A-Za-z])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z])(?:(?:\+|00)[0-9]{1,3}[\x20./-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{1,2}"
        r"[0-9]{3,4}(?:[\x20./-]?[0-9]{2,4}){1,2}(?![0-9A-Za-z])"
    ),
}
#: A text without any of these holds neither seeds nor candidates.
NEEDED = re.compile(r"[0-9@]|[\[(]at[\])]|\x20dot\x20")
DIGITS = re.compile("[0-9]")
#: Context words are bytes, A to Z as small letters, cut at white space and at these.
EDGE = b".,:;!?()[]{}<>\"*%$#&|="
PLAIN = bytes.maketrans(EDGE + bytes(range(65, 91)), b" " * len(EDGE) + bytes(range(97, 123)))
SEED, COUNTED = 29, 1 << 20
WORDS = WordHash(SEED)
SHAPES = (re.compile(r"[0-9]"), re.compile(r"[A-Za-z]+"))


@dataclass(frozen=True)
class BootstrapConfig:
    #: Share of what a pattern extracts that must be known.
    confidence: float = 0.9
    #: Keys of hot patterns and candidates are split so often.
    salts: int = 16


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in re.findall("[0-9]+", text))
    n = len(digits := _digits(text))
    return 16 <= n <= 19 and _luhn(digits) if kind == "card" else 8 <= n <= 15


def seeds(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the strict patterns: by kind, then in order."""
    last, lower, at = 0, 0, text.find("@")
    while at >= 0:
        # Nothing before the last sign can belong to this local part.
        low = max(last, lower)
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield "email", start, last
        lower, at = at + 1, text.find("@", at + 1)
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            if _valid(kind, m.group()):
                yield kind, m.start(), m.end()


def _name(kind: str, text: str) -> str:
    """What two ways of writing one identifier have in common."""
    if kind == "email":
        text = re.sub(rf"\x20?{SIGN}\x20?|\x20at\x20", "@", text.lower())
        return re.sub(rf"\x20?{DOT}\x20?|\x20dot\x20", ".", text)
    return ".".join(re.findall("[0-9]+", text)) if kind == "ip" else _digits(text)


def _shape(kind: str, text: str) -> str:
    if kind == "card":
        return re.sub("[0-9]+", lambda m: str(len(m.group())), text)
    if kind == "ip":
        return re.sub("[0-9]+", "9", text)
    return SHAPES[1].sub("a", SHAPES[0].sub("9", text)) if kind == "phone" else re.sub("[A-Za-z0-9%+_-]+", "a", text)


def _near(text: str, start: int, end: int) -> tuple[bytes, bytes]:
    """The words before and after a span, within 80 characters of it; empty where there is none."""
    head = text[max(0, start - 80):start].encode().translate(PLAIN).split()
    tail = text[end:end + 80].encode().translate(PLAIN).split()
    return head[-1] if head else b"", tail[0] if tail else b""


def _key(*parts: str | bytes) -> int:
    data = b"\x00".join(p if isinstance(p, bytes) else p.encode() for p in parts)
    return int(np.uint64(xxhash.xxh64_intdigest(data, 42)).view(np.int64))


def _mention(kind: str, text: str, start: int, end: int, known: bool) -> tuple:
    piece, (left, right) = text[start:end], _near(text, start, end)
    shape, name = _shape(kind, piece), _name(kind, piece)
    word = WORDS(np.frombuffer(b" %b " % left, np.uint8)).view(np.int64).tolist() if left else [0]
    return (
        KINDS.index(kind), start, end, known, _key(kind, name), word[0],
        [_key(kind, "shape", shape), _key(kind, "left", left, shape), _key(kind, "right", right, shape)],
        _key(kind, "slot", left),
    )


def _mentions(text: str) -> list[tuple]:
    """Seeds, and candidates that overlap no seed of their kind, with their patterns."""
    if not NEEDED.search(text):
        return []
    found = list(seeds(text))
    out = [_mention(kind, text, start, end, True) for kind, start, end in found]
    for kind in KINDS:
        held = iter([s for s in found if s[0] == kind] + [(kind, len(text) + 1, len(text) + 1)])
        _, start, end = next(held)
        for m in CANDIDATES[kind].finditer(text):
            while end <= m.start():
                _, start, end = next(held)
            if m.end() <= start and _valid(kind, m.group()):
                out.append(_mention(kind, text, m.start(), m.end(), False))
    return out


MENTION = (
    "array<struct<kind:int,start:int,end:int,known:boolean,inst:long,left:long,patterns:array<long>,slot:long>>"
)
SPANS = "array<struct<kind:int,start:int,end:int,base:boolean>>"


def mentions(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to place (a number of the row), doc_id and its mentions, written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"place long, doc_id {kind}, mentions {MENTION}"
    schema = to_arrow_schema(StructType.fromDDL(result))
    names = [f.name for f in schema.field("mentions").type.value_type]

    def run(batches):
        for batch in batches:
            found = [[dict(zip(names, m)) for m in _mentions(t.decode("utf-8", "replace"))] for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, schema.field("mentions").type)], schema=schema
            )

    rows = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    return stage(rows.mapInArrow(run, result), "mentions")


def _word_counts(docs: DataFrame) -> DataFrame:
    """(left, n): how often each word occurs in all texts; hashes as in mentions."""
    def run(batches):
        word = WordHash(SEED)

        def counted(parts):
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["left", "n"])

        held, total = [], 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                for part in spaced(text.translate(PLAIN)):
                    held.append(word(part))
                    total += len(held[-1])
                    if total > COUNTED:
                        yield counted(held)
                        held, total = [], 0
        if held:
            yield counted(held)

    return docs.select("text").mapInArrow(run, "left long, n long").groupBy("left").agg(F.sum("n").alias("n"))


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def bootstrap(found: DataFrame, docs: DataFrame, config: BootstrapConfig = BootstrapConfig()) -> DataFrame:
    """``found`` as from ``mentions`` to the candidates (inst) that became known, with confidence.

    A pattern with a shape is scored over the distinct identifiers it extracts, a bare word over
    all places where it stands in ``docs``. One more extraction counts as wrong. Only patterns
    that some candidate shows matter; in each round those of enough confidence make their
    candidates known, which raises the scores of other patterns.
    """
    each = found.select("place", F.explode("mentions").alias("m")).select("place", "m.*")
    salt = F.pmod(F.xxhash64("inst", F.lit(1)), F.lit(config.salts)).cast("int")
    shaped = each.select("known", "inst", F.explode("patterns").alias("pattern"))
    shaped = shaped.groupBy("pattern", "inst").agg(F.max("known").alias("known")).withColumn("n", F.lit(1).cast("long"))
    # A slot extracts whatever follows its word, so its total is the count of that word.
    slots = each.groupBy("slot", "inst").agg(F.max("known").alias("known"), F.count("*").alias("n"), F.first("left").alias("left"))
    slots = stage(slots, "slots")
    open_slots = slots.groupBy("slot").agg(F.first("left").alias("left"), F.bool_and("known").alias("done")).filter("NOT done")
    slot_total = open_slots.join(_word_counts(docs), "left").select(F.col("slot").alias("pattern"), F.col("n").alias("total"))
    shaped = stage(shaped, "edges")
    edges = shaped.unionByName(slots.select(F.col("slot").alias("pattern"), "inst", "known", "n"))
    inst_known = each.groupBy("inst").agg(F.max("known").alias("seed"))
    named = stage(edges.join(inst_known.filter("seed").select("inst"), "inst", "left_semi").select("pattern", "n"), "known")
    fresh = stage(edges.filter("NOT known").join(inst_known.filter("NOT seed").select("inst"), "inst", "left_semi").select("pattern", "inst", "n", salt.alias("salt")), "fresh")
    counted = shaped.groupBy("pattern").agg(F.count("*").alias("total")).unionByName(slot_total)
    touched = fresh.select("pattern").distinct()
    sure = named.groupBy("pattern").agg(F.sum("n").alias("sure"))
    patterns = stage(touched.join(counted, "pattern").join(sure, "pattern", "left").fillna(0, ["sure"]), "patterns")

    accepted = docs.sparkSession.createDataFrame([], "inst long, conf double")
    before = 0
    while True:
        gained = fresh.join(accepted, "inst").groupBy("pattern").agg(F.sum(F.col("n") * F.col("conf")).alias("more"))
        conf = (F.col("sure") + F.coalesce("more", F.lit(0.0))) / (F.col("total") + 1)
        good = patterns.join(gained, "pattern", "left").select("pattern", conf.alias("conf")).filter(F.col("conf") >= config.confidence)
        # Independent patterns: the candidate is wrong only if all of them are.
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-12)))))
        reached = fresh.join(_salted(good, config.salts), ["pattern", "salt"]).groupBy("inst").agg((1 - miss).alias("conf"))
        accepted = stage(reached, "accepted")
        now = accepted.count()
        if now == before:
            break
        before = now
    # Other ways of writing a seed are known from the start.
    again = each.filter("NOT known").select("inst").join(inst_known.filter("seed").select("inst"), "inst", "left_semi").distinct()
    return accepted.unionByName(again.withColumn("conf", F.lit(1.0)))


def extract(docs: DataFrame, config: BootstrapConfig = BootstrapConfig()) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id and spans, one row per row.

    ``spans`` holds kind (an index of ``KINDS``), start and end in code points, end exclusive, and
    base: whether the strict pattern of the kind found it. They are in order of kind and start.
    Added spans overlap no other span; of two that do, the earlier, then the longer stays. Null and
    empty texts have none; repeated rows are documents of their own, but count once as evidence for
    a shape. An empty table gives no rows.
    """
    found = mentions(docs)
    known = bootstrap(found, docs, config)
    salt = F.pmod(F.col("place"), F.lit(config.salts)).cast("int").alias("salt")
    each = found.select("place", F.explode(F.filter("mentions", lambda m: ~m["known"])).alias("m"))
    each = each.select("place", salt, "m.kind", "m.start", "m.end", "m.inst")
    added = each.join(_salted(known, config.salts), ["inst", "salt"])
    added = added.groupBy("place").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    base = F.transform(F.filter("mentions", lambda m: m["known"]), lambda m: F.struct(m["kind"], m["start"], m["end"], F.lit(True).alias("base")))
    rows = found.select("place", "doc_id", base.alias("base")).join(added, "place", "left")
    return rows.select("doc_id", _settled(F.col("base"), F.col("added")).alias("spans"))


def _merge(base: list[dict], added: list[dict]) -> list[dict]:
    """Both in order; an added span stays if it overlaps none that is held."""
    wanted = sorted(added, key=lambda s: (s["start"], -s["end"], s["kind"]))
    taken, out = sorted(base, key=lambda s: s["start"]), []
    at = reach = end = 0
    for s in wanted:
        while at < len(taken) and taken[at]["start"] < s["end"]:
            reach = max(reach, taken[at]["end"])
            at += 1
        if s["start"] >= max(end, reach):
            out.append(s | {"base": False})
            end = s["end"]
    return sorted(base + out, key=lambda s: (s["kind"], s["start"]))


def _settled(base: Column, added: Column) -> Column:
    schema = to_arrow_type(StructType.fromDDL(f"spans {SPANS}")["spans"].dataType)

    @F.arrow_udf(SPANS)
    def run(held: pa.Array, more: pa.Array) -> pa.Array:
        return pa.array([_merge(b or [], a) if a else b or [] for b, a in zip(held.to_pylist(), more.to_pylist())], schema)

    return run(base, added)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
