"""Repeated spans of words across documents, and their removal.

The words of a text are a path in a De Bruijn graph whose edges are windows of ``k`` words. An
edge that also starts earlier in the corpus repeats; a maximal run of such edges whose earlier
places run along with it passes no branching node, and is compacted to one span with its source
coordinates.

Most edges occur once, and these never leave their task. Every window has an anchor, the least hash
of its ``anchor``-word windows, so equal windows have equal anchors. First anchors are counted over
the corpus; then only windows with a repeated anchor become edge rows. What repeats within one task
is settled there, so a passage that a third of all documents share gives one row per task and
edge, not one per document.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType

from mnemo.llm.common import SLICE, WordHash, mixed, per_text, spaced, utf8

LAST = (1 << 63) - 1
#: Texts that a task has open at once when it writes what is kept.
OPEN = 256
RUN = pa.struct([(x, pa.int64()) for x in ("n", "fd", "fh", "fp")])


@dataclass(frozen=True)
class SubstringConfig:
    k: int = 20
    anchor: int = 8
    seed: int = 5
    #: Rows that a task compares with each other before it hands them on.
    buffer: int = 2_000_000


class Grams:
    """Hashes of runs of words, from those of the words, by prefix sums."""

    def __init__(self, seed: int):
        self.words = WordHash(seed)
        rng = np.random.default_rng(seed + 1)
        self.bases = rng.integers(1, 1 << 62, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = [np.ones((3, 1), np.uint64) for _ in range(2)]

    def of(self, text: bytes) -> np.ndarray:
        return np.concatenate([self.words(a) for a in spaced(text)] or [np.zeros(0, np.uint64)])

    def runs(self, words: np.ndarray, size: int, which: int) -> np.ndarray:
        n = len(words)
        if n < size:
            return np.zeros(0, np.uint64)
        if self.up.shape[1] < n + 1:
            inverse = np.array([pow(int(b), -1, 1 << 64) for b in self.bases], np.uint64)
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate(
                    [np.ones((3, 1), np.uint64), np.repeat(b[:, None], 2 * n, 1)], 1), axis=1)
                for b in (self.bases, inverse)
            )
        sums = np.append(np.uint64(0), np.cumsum(words * self.up[which, :n]))
        return mixed((sums[size:] - sums[:-size]) * self.down[which, : n - size + 1])


    def each(self, texts, size: int, width: int):
        """Of each text the words, its runs of ``size`` words, and the least of each ``width`` of those.

        Many short texts are hashed at once; what crosses from one to the next is left out.
        """
        held, total = [], 0
        for text in texts:
            if held and total + len(text) > SLICE:
                yield from self._together(held, size, width)
                held, total = [], 0
            held.append(text)
            total += len(text)
        yield from self._together(held, size, width)

    def _together(self, texts: list[bytes], size: int, width: int):
        lists = [text.split() for text in texts]
        if len(texts) == 1:
            words = self.of(texts[0])
        else:
            words = self.words(np.frombuffer(b" ".join([b"", *(b" ".join(x) for x in lists if x), b""]), np.uint8))
        runs = self.runs(words, size, 0)
        least, at = _least(runs, width), 0
        for n in map(len, lists):
            end = at + n - size + 1
            yield words[at: at + n], runs[at: max(at, end)], least[at: max(at, end - width + 1)]
            at += n


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _placed(docs: DataFrame) -> DataFrame:
    """Rows with the place (d, h) of the document in the order, and a hash t of the text.

    Null ids come last. Rows of one id and one text are the same document; h tells others of one
    id apart, and is 0 where every id is unique.
    """
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(
        F.struct(*rest).alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("d"),
        (t if repeated else F.lit(0).cast("long")).alias("h"), t.alias("t"), "text",
    )


def _press(texts) -> list[bytes]:
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(text) for text in texts]


def _copies(placed: DataFrame) -> DataFrame:
    """(d, h, fd, fh) of each document whose whole text stands in an earlier one."""
    # 96 bits of text hash.
    marks = placed.select("d", "h", "t", F.hash(F.coalesce("text", F.lit(""))).alias("u"))
    first = marks.groupBy("t", "u").agg(F.min(F.struct("d", "h")).alias("first"), F.count("*").alias("n"))
    found = marks.join(first.filter("n > 1"), ["t", "u"]).filter(F.struct("d", "h") > F.col("first"))
    return found.select("d", "h", F.col("first.d").alias("fd"), F.col("first.h").alias("fh")).distinct()


def _texts(column: pa.Array):
    open_ = zstandard.ZstdDecompressor()
    for blob in utf8(column):
        yield open_.decompress(blob)


def _anchors(config: SubstringConfig):
    """(d, h, t, text) to anchors (gram, d, h, t, known, salt) of each document.

    ``known`` anchors were seen to repeat by the task, in one text or in different ones. One row
    per anchor and buffer has salt 0 and announces the anchor to the others.
    """
    def run(batches):
        grams, held = Grams(config.seed), []

        def flush():
            g = np.concatenate([x[0] for x in held] or [np.zeros(0, np.uint64)])
            d, h, t = (np.repeat(np.array([x[i] for x in held], np.int64), [len(x[0]) for x in held]) for i in (1, 2, 3))
            twice = np.concatenate([x[4] for x in held] or [np.zeros(0, bool)])
            order = np.argsort(g, kind="stable")
            g, d, h, t, twice = g[order], d[order], h[order], t[order], twice[order]
            head = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
            group = np.cumsum(head) - 1
            # Copies of one text do not make its anchors repeat.
            other = t != t[np.flatnonzero(head)[group]]
            known = np.bincount(group, other | twice)[group] > 0 if len(g) else head
            salt = np.where(head | ~known, 0, d | 1)
            held.clear()
            return pa.RecordBatch.from_pydict({
                "gram": g.view(np.int64), "d": d, "h": h, "t": t, "known": known, "salt": salt,
            })

        size = 0
        for batch in batches:
            places = zip(*(batch.column(i).to_pylist() for i in range(3)))
            hashed = grams.each(utf8(batch.column(3)), config.anchor, config.k - config.anchor + 1)
            for (d, h, t), (_, runs, least) in zip(places, hashed):
                if not len(least):
                    continue
                # Neighbours mostly have one least run.
                chosen, all_ = np.unique(least[np.append(True, least[1:] != least[:-1])]), np.sort(runs)
                held.append((chosen, d, h, t, np.isin(chosen, all_[1:][all_[1:] == all_[:-1]])))
                size += len(chosen)
                if size > config.buffer:
                    yield flush()
                    size = 0
        yield flush()

    return run


def _edges(config: SubstringConfig):
    """(row, d, h, blob, grams, fd, fh) to windows with a repeated anchor; a copy is one row.

    A window that is the task's first of its edge has its hashes and no ``run``. Others are known
    to repeat; neighbours among them whose earlier places run along are one row of ``n`` windows.
    """
    def run(batches):
        grams, held = Grams(config.seed), []

        def flush():
            e, c, p = (np.concatenate([x[i] for x in held]) for i in (0, 1, 4))
            sizes = [len(x[0]) for x in held]
            d, h = (np.repeat(np.array([x[i] for x in held], np.int64), sizes) for i in (2, 3))
            held.clear()
            order = np.lexsort((p, h, d, c, e))
            e, c, d, h, p = e[order], c[order], d[order], h[order], p[order]
            head = np.append(True, (e[1:] != e[:-1]) | (c[1:] != c[:-1]))
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            # The same document read twice (a repeated row) is no earlier place.
            head = (d == d[first]) & (h == h[first]) & (p == p[first])
            fd, fh, fp = d[first], h[first], p[first]
            yield pa.RecordBatch.from_pydict({
                "edge": e[head].view(np.int64), "check": c[head], "d": d[head], "h": h[head],
                "pos": p[head], "run": pa.nulls(int(head.sum()), RUN),
            })
            more = ~head
            d, h, p, fd, fh, fp = (x[more] for x in (d, h, p, fd, fh, fp))
            order = np.lexsort((p, h, d))
            d, h, p, fd, fh, fp = (x[order] for x in (d, h, p, fd, fh, fp))
            joined = np.ones(max(0, len(d) - 1), bool)
            for x, step in ((d, 0), (h, 0), (p, 1), (fd, 0), (fh, 0), (fp, 1)):
                joined &= x[1:] - x[:-1] == step
            starts = np.flatnonzero(np.append(True, ~joined)) if len(d) else np.zeros(0, np.int64)
            n = np.diff(np.append(starts, len(d)))
            d, h, p, fd, fh, fp = (x[starts] for x in (d, h, p, fd, fh, fp))
            spread = mixed((h + p).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "edge": spread, "check": np.zeros(len(d), np.int32), "d": d, "h": h, "pos": p,
                "run": pa.StructArray.from_arrays([pa.array(x) for x in (n, fd, fh, fp)], fields=list(RUN)),
            })

        size, n = 0, config.k - 1
        for batch in batches:
            places = zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6)))
            copies, lengths = [], deque()

            def opened(batch=batch):
                """The texts, but of copies only their length."""
                for fd, text in zip(batch.column(5).to_pylist(), _texts(batch.column(3))):
                    if fd is not None:
                        lengths.append(len(text.split()))
                    yield text if fd is None else b""

            hashed = grams.each(opened(), config.anchor, config.k - config.anchor + 1)
            for (d, h, repeated, fd, fh), (words, _, least) in zip(places, hashed):
                if fd is not None:
                    windows = lengths.popleft() - n
                    if windows > 0:
                        run = {"n": windows, "fd": fd, "fh": fh, "fp": 0}
                        copies.append((d ^ fd, 0, d, h, 0, run))
                    continue
                at = np.flatnonzero(np.isin(least, np.array(repeated, np.int64).view(np.uint64)))
                if len(at):
                    e, c = (grams.runs(words, config.k, i)[at] for i in (1, 2))
                    # 96 bits tell the windows of 100 TB apart.
                    c = c.astype(np.uint32).view(np.int32)
                    held.append((e, c, d, h, at))
                    size += len(at)
                if size > config.buffer:
                    yield from flush()
                    size = 0
            if copies:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), RUN]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*copies), kinds)],
                    names=["edge", "check", "d", "h", "pos", "run"],
                )
        if held:
            yield from flush()

    return run


def repeated_spans(
    placed: DataFrame, packed: DataFrame, config: SubstringConfig = SubstringConfig()
) -> DataFrame:
    """Spans (d, h, start, length in words, fd, fh, fstart) with an earlier equal place each."""
    anchors = placed.select("d", "h", "t", "text").mapInArrow(
        _anchors(config), "gram long, d long, h long, t long, known boolean, salt long"
    )
    same = Window.partitionBy("gram", "salt")
    seen = (F.min("t").over(same) != F.max("t").over(same)) | F.max("known").over(same)
    # Salted rows are known to repeat already; rows of salt 0 are few per task and anchor.
    repeated = anchors.withColumn("seen", F.col("known") | seen).filter("seen")
    none = F.lit(None).cast("long")
    marks = repeated.select("d", "h", "gram", none.alias("fd"), none.alias("fh")).union(
        _copies(placed).select("d", "h", none.alias("gram"), "fd", "fh")
    )
    wanted = marks.groupBy("d", "h").agg(
        F.collect_set("gram").alias("grams"), F.max("fd").alias("fd"), F.max("fh").alias("fh")
    )
    with_anchor = packed.join(wanted, ["d", "h"]).select("row", "d", "h", "blob", "grams", "fd", "fh")
    edges = with_anchor.mapInArrow(
        _edges(config),
        "edge long, check int, d long, h long, pos long, run struct<n long, fd long, fh long, fp long>",
    ).withColumn("known", F.col("run").isNotNull())
    place = F.struct("d", "h", "pos")
    first = F.min(place).over(Window.partitionBy("edge", "check", "known"))
    later = edges.withColumn("first", first).filter(F.col("known") | (place > F.col("first")))
    later = later.select(
        "d", "h", "pos", F.coalesce("run.n", F.lit(1)).cast("long").alias("n"),
        F.when(F.col("known"), F.col("run.fd")).otherwise(F.col("first.d")).alias("fd"),
        F.when(F.col("known"), F.col("run.fh")).otherwise(F.col("first.h")).alias("fh"),
        F.when(F.col("known"), F.col("run.fp")).otherwise(F.col("first.pos")).alias("fp"),
    )
    # Compaction: an edge joins the path of the one before it if both places step by one word.
    along = Window.partitionBy("d", "h").orderBy("pos", "n", "fd", "fh", "fp")
    step = F.lag(F.struct((F.col("pos") + F.col("n")).alias("pos"), "fd", "fh", (F.col("fp") + F.col("n")).alias("fp"))).over(along)
    breaks = F.when(step.eqNullSafe(F.struct("pos", "fd", "fh", "fp")), 0).otherwise(1)
    paths = later.withColumn("break", breaks).withColumn("path", F.sum("break").over(along))
    return paths.groupBy("d", "h", "path").agg(
        F.min("pos").alias("start"), (F.sum("n") + config.k - 1).alias("length"), F.min("fd").alias("fd"),
        F.min("fh").alias("fh"), F.min("fp").alias("fstart"),
    ).drop("path")


def remove_repeats(
    docs: DataFrame, config: SubstringConfig = SubstringConfig(), keep_layout: bool = False
) -> DataFrame:
    """``docs`` (doc_id, text, ...) without each word in a window of k words that starts earlier.

    Earlier: smaller doc_id, or the same document before. Windows are judged on the input. Gives
    row (the input's other columns), n_words, n_removed, spans (start and length of what repeats)
    and ``text``, the kept words with one space between them; with ``keep_layout`` an untouched
    text stays as it is. Null texts have no words and come out empty. Null ids come last, among themselves
    ordered by a hash of the text, as are different texts of one id; equal rows are one document
    and get equal results.
    """
    placed = _placed(docs)
    # Texts are compressed for the one shuffle that both joins below read.
    packed = placed.select("row", "d", "h", per_text(BinaryType(), _press)(F.col("text")).alias("blob"))
    found = repeated_spans(placed, packed, config).groupBy("d", "h").agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans")
    )
    joined = packed.join(found, ["d", "h"], "left").select("row", "blob", "spans")

    def run(batches):
        for batch in (b.slice(at, OPEN) for b in batches for at in range(0, len(b), OPEN)):
            total, removed, kept = [], [], []
            for spans, text in zip(batch.column(2).to_pylist(), _texts(batch.column(1))):
                words, at, parts = text.split(), 0, []
                for s in spans or []:
                    parts += words[at: s["start"]]
                    at = max(at, s["start"] + s["length"])
                parts = parts + words[at:] if spans else words
                total.append(len(words))
                removed.append(len(words) - len(parts))
                kept.append(text if keep_layout and not spans else b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), batch.column(2),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["row", "n_words", "n_removed", "spans", "text"],
            )

    schema = joined.select(
        "row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), "spans",
        F.lit("").alias("text"),
    ).schema
    return joined.mapInArrow(run, schema)
