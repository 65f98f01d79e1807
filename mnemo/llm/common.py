"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: A word: a run without ASCII white space. ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: No numpy pass sees more bytes of one text than this, and the rest of a word.
SLICE = 1 << 20


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def held_out(key: Column, n: int) -> Column:
    return crc_mod(key, n) == 1


def utf8(values: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null as empty, few Python objects at a time."""
    raw = values.cast(pa.binary())
    for at in range(0, len(raw), 256):
        for b in raw.slice(at, 256).to_pylist():
            yield b or b""


def spaced(text: bytes) -> Iterator[np.ndarray]:
    """The words of a text, each between single spaces, as byte arrays of bounded size.

    Slices end at a space, so no word is cut, however long the text is.
    """
    flat = b" " + b" ".join(text.split()) + b" "
    at = 0
    while at < len(flat) - 1:
        end = flat.find(b" ", min(at + SLICE, len(flat) - 1)) + 1
        yield np.frombuffer(flat, np.uint8, end - at, at)
        at = end - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all bits (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHash:
    """64-bit hashes of all words of a byte array at once: sum of table[byte] * base^position."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = rng.integers(1, 1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)

    def __call__(self, a: np.ndarray) -> np.ndarray:
        """``a`` as from ``spaced``; one hash per word, in order."""
        gaps = np.flatnonzero(a == 32)
        starts, ends = gaps[:-1] + 1, gaps[1:]
        if not len(starts):
            return np.zeros(0, np.uint64)
        longest = int((ends - starts).max()) + 1
        if len(self.powers) < longest:
            steps = np.full(longest, self.base, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
        place = np.arange(len(a), dtype=np.int64)
        place -= np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(a))))
        values = self.table[a] * self.powers[place]
        # The space after a word takes part too, at a place that its length sets.
        return mixed(np.add.reduceat(values, starts))


def per_text(result: DataType, compute: Callable[[Iterable[bytes]], list]) -> Callable:
    """An Arrow UDF of a text column; ``compute`` maps the bytes of texts to values."""
    kind = to_arrow_type(result)

    @F.arrow_udf(result)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(compute(utf8(texts)), kind)

    return run


def load(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
