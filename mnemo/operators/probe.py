"""Best-k of a big table per probe, without ever shuffling the pairs.

Every ranking query of the engine asks the same thing: for each probe (a prompt,
an entity, a keyword) the k best rows of a big table under some score. The pairs
are never rows of a DataFrame. Each task scores a slice of the big table against
a block of probes as one dense matrix and keeps k rows per probe; only those
survivors are shuffled for the final cut.

Two ways to bring probes and rows together, both exact:

* probes within ``MAX_PROBES`` rows and ``MAX_BYTES`` travel to every task with the task's
  code, and the big table is read in place, with no shuffle of it at all;
* beyond either bound, probes and rows are hashed into blocks and each pair of blocks is
  one cell of a grid, so no task ever holds more than one block of either side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

MAX_PROBES = 16_384  # 32 MB of 512 floats
MAX_BYTES = 64 << 20  # probes may carry token lists of any length, so bytes are bounded too
PARCEL = 1 << 20
GRID_PROBES = 16_384
GRID_ROWS = 65_536
CELLS = 4_000_000  # scores held at once: probes x rows of one slice
SLICE = 2048  # rows of one slice, whatever a batch holds: their vectors are held as doubles
SALTS = 256  # a probe's survivors from all tasks are cut in this many parts first,
ONE_CUT = 20  # unless it has no more than so many from a task

GLOBAL_POOL = ""
UNSCORED = -2.0  # ranks below every real score, reported as NULL


@dataclass(frozen=True)
class Kernel:
    """How to score. ``prepare`` sees a block of probes once; ``score`` sees slices of rows.

    ``score(state, rows)`` returns ``(rows, matrix)`` with one matrix line per
    probe; ``-inf`` marks a pair that does not qualify. It may return other rows
    than it was given (a document's lines, say).
    """

    prepare: Callable[[pa.Table], object]
    score: Callable[[object, pa.Table], tuple[pa.Table, np.ndarray]]


@dataclass(frozen=True)
class Scope:
    """Which rows a probe may see, and which pools are ranked for it.

    ``project``: '' ignores projects, 'strict' wants the probe's own, 'global'
    adds rows without one. A probe without a project sees everything.
    ``axes``: besides the global pool, rank one pool per axis in the probe's
    ``axes``, holding only rows tagged with it.
    """

    project: str = ""
    axes: bool = False


def _direction(name: str) -> tuple[str, str]:
    """A tie-breaker as (column, direction); a leading minus means descending."""
    return (name[1:], "descending") if name.startswith("-") else (name, "ascending")


def _codes(values: list, known: dict) -> np.ndarray:
    return np.array([known.setdefault(v, len(known)) for v in values], dtype=np.int64)


class _Block:
    """The running best k per (probe, pool) of one block of probes."""

    def __init__(self, probes: pa.Table, kernel: Kernel, scope: Scope, k: int, order: Sequence[str],
                 payload: Sequence[str]):
        self.kernel, self.k, self.order = kernel, k, [_direction(c) for c in order]
        self.payload = list(payload)
        self.state = kernel.prepare(probes)
        self.n = probes.num_rows
        self.ids = probes.column("prompt_id")
        self.known_projects: dict = {None: 0, "": 0}
        self.scope = scope
        self.probe_project = None
        if scope.project:
            self.probe_project = _codes(probes.column("project").to_pylist(), self.known_projects)
        self.pools = [(GLOBAL_POOL, np.arange(self.n))]
        if scope.axes:
            members: dict[str, list[int]] = {}
            for i, axes in enumerate(probes.column("axes").to_pylist()):
                for axis in axes or ():
                    members.setdefault(axis, []).append(i)
            self.pools += [(a, np.array(m)) for a, m in sorted(members.items())]
        # kth best so far per (pool, probe): rows below it cannot enter any more.
        self.floor = [np.full(len(m), -np.inf) for _, m in self.pools]
        self.kept: pa.Table | None = None

    def add(self, table: pa.Table) -> None:
        step = min(SLICE, max(128, CELLS // max(self.n, 1)))
        for start in range(0, table.num_rows, step):
            self._add(table.slice(start, step))

    def _add(self, table: pa.Table) -> None:
        rows, scores = self.kernel.score(self.state, table)
        if rows.num_rows == 0:
            return
        if self.probe_project is not None:
            mine = _codes(rows.column("project").to_pylist(), self.known_projects)
            seen = self.probe_project[:, None] == mine[None, :]
            seen |= self.probe_project[:, None] == 0
            if self.scope.project == "global":
                seen |= mine[None, :] == 0
            scores = np.where(seen, scores, -np.inf)
        scores = np.rint(scores * 1e6)
        ranks = np.empty(rows.num_rows)
        by_order = pc.sort_indices(rows, sort_keys=self.order)
        ranks[by_order.to_numpy()] = np.arange(rows.num_rows)
        tags = None
        if len(self.pools) > 1:
            tags = [{x.lower() for x in t or ()} for t in rows.column("experts").to_pylist()]
        found = []
        for slot, (pool, members) in enumerate(self.pools):
            at = np.arange(rows.num_rows)
            if pool != GLOBAL_POOL:
                at = np.array([i for i, t in enumerate(tags) if pool.lower() in t], dtype=np.int64)
                if not len(at):
                    continue
            block = scores[members][:, at] if pool != GLOBAL_POOL else scores
            alive = (block > -np.inf) & (block >= self.floor[slot][:, None])
            live = alive.any(axis=0)
            if not live.any():
                continue
            at, block, alive = at[live], block[:, live], alive[:, live]
            # Score first, then row order, as one exact number: no ties are left.
            width = float(rows.num_rows)
            key = np.where(alive, block * width + (width - 1 - ranks[at])[None, :], -np.inf)
            if key.shape[1] > self.k:
                top = np.argpartition(-key, self.k - 1, axis=1)[:, : self.k]
            else:
                top = np.broadcast_to(np.arange(key.shape[1]), key.shape)
            line = np.repeat(np.arange(len(members)), top.shape[1])
            col = top.ravel()
            ok = key[line, col] > -np.inf
            line, col = line[ok], col[ok]
            found.append((np.full(len(line), slot), members[line], at[col], block[line, col]))
        if not found:
            return
        slots, probe, row, score = (np.concatenate(part) for part in zip(*found))
        new = rows.select(self.payload).take(pa.array(row))
        new = new.append_column("_slot", pa.array(slots.astype(np.int32)))
        new = new.append_column("_probe", pa.array(probe.astype(np.int64)))
        new = new.append_column("_score", pa.array(score))
        self._cut(new)

    def _cut(self, new: pa.Table) -> None:
        every = new if self.kept is None else pa.concat_tables([self.kept, new])
        keys = [("_slot", "ascending"), ("_probe", "ascending"), ("_score", "descending")]
        every = every.take(pc.sort_indices(every, sort_keys=keys + self.order))
        slot, probe = every.column("_slot").to_numpy(), every.column("_probe").to_numpy()
        first = np.ones(len(slot), dtype=bool)
        first[1:] = (slot[1:] != slot[:-1]) | (probe[1:] != probe[:-1])
        starts = np.flatnonzero(first)
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        self.kept = every.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        score = every.column("_score").to_numpy()
        for i, (_, members) in enumerate(self.pools):
            full = last & (slot == i)
            self.floor[i][np.searchsorted(members, probe[full])] = score[full]

    def result(self, schema: pa.Schema) -> pa.Table:
        if self.kept is None:
            return schema.empty_table()
        kept = self.kept
        score = kept.column("_score").to_numpy() / 1e6
        names = pa.array([p for p, _ in self.pools])
        columns = {
            "prompt_id": self.ids.take(kept.column("_probe")),
            "pool": names.take(kept.column("_slot").combine_chunks()),
            "score": pa.array(score, mask=score == UNSCORED),
        }
        for name in self.payload:
            columns[name] = kept.column(name)
        return pa.table([_fit(columns[f.name], f.type) for f in schema], schema=schema)


def _fit(column, kind: pa.DataType):
    return column if column.type == kind else column.cast(kind)


def best_k(
    probes: DataFrame,
    rows: DataFrame,
    kernel: Kernel,
    k: int,
    order: Sequence[str],
    payload: Sequence[str],
    scope: Scope = Scope(),
    row_schema: StructType | None = None,
    max_probes: int | None = None,
) -> DataFrame:
    """(prompt_id, pool, score, payload…): the k best rows per probe and pool.

    ``order`` names tie-breakers that are unique together, and is part of the payload:
    ascending, or descending with a leading minus, NULLs last.
    ``row_schema`` describes the payload when the kernel makes rows of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    limit = MAX_PROBES if max_probes is None else max_probes
    described = row_schema or rows.schema
    ties = [_direction(c) for c in order]
    payload = list(dict.fromkeys([*(c for c, _ in ties), *payload]))
    schema = StructType([
        probes.schema["prompt_id"],
        StructField("pool", StringType()),
        StructField("score", DoubleType()),
        *[described[name] for name in payload],
    ])
    arrow_schema = to_arrow_schema(schema)

    def settle(block: pa.Table, tables: Iterable[pa.Table]) -> pa.Table:
        best = _Block(block, kernel, scope, k, order, payload)
        for table in tables:
            best.add(table)
        return best.result(arrow_schema)

    small = _within(probes, limit)
    if small is not None:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if small.num_rows:
                yield from settle(small, (pa.Table.from_batches([b]) for b in batches)).to_batches()

        local = rows.mapInArrow(scan, schema)
    else:
        local = _grid(probes, rows, settle, schema, [c for c, _ in ties])
    best = [
        F.col("score").desc_nulls_last(),
        *[F.desc_nulls_last(c) if way == "descending" else F.asc_nulls_last(c) for c, way in ties],
    ]
    return cut(local, ["prompt_id", "pool"], best, k, [c for c, _ in ties])


def cut(hits: DataFrame, by: Sequence[str], best: Sequence, k: int, ids: Sequence[str]) -> DataFrame:
    """The first ``k`` rows of each group in the order ``best``, with their rank.

    Every task sends k rows of a group at most. Where k is large, no single task takes them all
    in: groups are cut in parts, by a hash of ``ids``, first.
    """
    part = F.pmod(F.xxhash64(*ids), F.lit(SALTS))
    for keys in ([[*by, part]] if k > ONE_CUT else []) + [list(by)]:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
        hits = hits.withColumn("rank", place).filter(F.col("rank") <= k)
    return hits


def _within(probes: DataFrame, limit: int) -> pa.Table | None:
    """The probes, or None if they break a bound. The driver fetches no more than the bounds allow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = pa.schema([("rows", pa.binary())])

    def packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Parcels of at most PARCEL bytes, or of one row."""
        if batch.nbytes > PARCEL and batch.num_rows > 1:
            half = batch.num_rows // 2
            yield from packed(batch.slice(0, half))
            yield from packed(batch.slice(half))
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=kind)

    def parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from packed(batch)

    most = MAX_BYTES // PARCEL
    got = probes.limit(limit + 1).mapInArrow(parcels, "rows binary").limit(most + 1).toArrow()
    if got.num_rows > most:
        return None
    tables = [pa.ipc.open_stream(p).read_all() for p in got.column("rows").to_pylist()]
    if not tables:
        return to_arrow_schema(probes.schema).empty_table()
    small = pa.concat_tables(tables)
    return small if small.num_rows <= limit else None


def _grid(probes, rows, settle, schema, order) -> DataFrame:
    n_probes = max(1, math.ceil(probes.count() / GRID_PROBES))
    n_rows = max(1, math.ceil(rows.count() / GRID_ROWS))
    keys = [c for c in order if c in rows.columns]
    left = probes.withColumn(
        "_cell",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(n_rows - 1)),
            lambda r: r * n_probes + F.pmod(F.xxhash64("prompt_id"), F.lit(n_probes)).cast("int"),
        )),
    )
    right = rows.withColumn(
        "_cell",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(n_probes - 1)),
            lambda p: F.pmod(F.xxhash64(*keys), F.lit(n_rows)).cast("int") * n_probes + p,
        )),
    )

    def cell(block: pa.Table, part: pa.Table) -> pa.Table:
        if not block.num_rows or not part.num_rows:
            return settle(block, [])
        return settle(block, (part.slice(i, 10_000) for i in range(0, part.num_rows, 10_000)))

    return left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(cell, schema)
