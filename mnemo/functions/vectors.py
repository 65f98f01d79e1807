"""Vectors: the hashed text embedding, cosine, and user-supplied embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from mnemo.config import DEFAULT_RULES, Rules
from mnemo.functions.text import once, tokens

VECTOR = ArrayType(FloatType())


class EmbedderUnavailable(RuntimeError):
    """A configured embedding model cannot be used here."""


class Embedder(Protocol):
    """What a user supplies to embed text with a model of their own.

    ``embed_batch`` runs inside tasks and gets one Arrow batch of texts. Two
    vectors compare only when name, model and dimensions are all equal.
    """

    name: str
    model: str
    dimensions: int

    def embed_batch(self, texts: pd.Series) -> np.ndarray: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """The default: hashed words and character n-grams, no model needed."""

    rules: Rules = DEFAULT_RULES
    name: str = "deterministic"

    @property
    def dimensions(self) -> int:
        return self.rules.hash_dim

    @property
    def model(self) -> str:
        return f"md5-{self.rules.hash_dim}"


def get_embedder(backend: str = "", model: Embedder | None = None, rules: Rules = DEFAULT_RULES,
                 allow_fallback: bool = False) -> Embedder | HashedEmbedder:
    """Embedder by configured name. An unknown or missing one fails unless a fallback is asked for."""
    wanted = backend.strip().lower()
    if wanted in ("", "deterministic", "local", "hashed"):
        return HashedEmbedder(rules)
    if model is not None and wanted == model.name.lower():
        return model
    if allow_fallback:
        return HashedEmbedder(rules)
    raise EmbedderUnavailable(f"no embedder named {backend!r} was supplied")


def identity_of(embedder: Embedder | HashedEmbedder) -> Column:
    return F.struct(
        F.lit(embedder.name).alias("backend"),
        F.lit(embedder.model).alias("model"),
        F.lit(int(embedder.dimensions)).alias("dim"),
    )


def bucket(token: str, dim: int) -> int:
    """First 15 hex digits of md5, modulo ``dim``; same value as the SQL form."""
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:15], 16) % dim


class _Hasher:
    """Buckets of a token: its own first, then those of its n-grams. Memoised within bounds."""

    def __init__(self, dim: int, size: int, grams: bool, memo: int = 100_000):
        self.dim, self.size, self.grams, self.memo = dim, size, grams, memo
        self.numbers = list(range(dim))  # one object a bucket, however many tokens name it
        self.words: dict[str, list[int]] = {}
        self.parts: dict[str, int] = {}

    def __call__(self, token: str) -> list[int]:
        found = self.words.get(token)
        if found is None:
            found = [self.numbers[bucket(token, self.dim)]]
            if self.grams and len(token) > self.size:
                size = self.size
                found += [self.gram(token[i:i + size]) for i in range(len(token) - size + 1)]
            if len(self.words) >= self.memo:
                self.words.clear()
            self.words[token] = found
        return found

    def gram(self, part: str) -> int:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.memo:
                self.parts.clear()
            found = self.parts[part] = self.numbers[bucket("#" + part, self.dim)]
        return found


def _slices(lists: pa.Array, rows: int = 512, values: int = 500_000) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of so many rows and list values at most, one row at least."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    at = 0
    while at < len(lists):
        end = int(np.searchsorted(offsets, offsets[at] + values, "right")) - 1
        end = min(max(end, at + 1), at + rows, len(lists))
        yield at, end - at
        at = end


def hashed_vectors(c: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """array<float> of a text: words weigh 1, n-grams less, log damping, unit length.

    Tokens are cut in the JVM; only the hashing runs in Arrow batches. Each
    distinct token of a batch is hashed once, and a bounded memo carries the
    common ones on to the next batch. No shuffle.
    """
    dim, size, weight = rules.hash_dim, rules.ngram_size, rules.ngram_weight
    hasher = _Hasher(dim, size, weight > 0)

    def embed(column: pa.Array) -> pa.Array:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        n = len(lists)
        out = np.zeros((n, dim))
        rows_per_list = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        if len(flat):
            encoded = flat.dictionary_encode()
            hashed = [hasher(token) for token in encoded.dictionary.to_pylist()]
            sizes = np.array([len(b) for b in hashed])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            all_buckets = np.fromiter(chain.from_iterable(hashed), np.int64, sizes.sum())
            codes = encoded.indices.to_numpy()
            rows = np.repeat(np.arange(n), rows_per_list)
            step = 500_000  # expanded n-grams held at once
            edges = np.searchsorted(
                np.cumsum(sizes[codes]), np.arange(0, sizes[codes].sum() + step, step), "right"
            )
            words, grams = np.zeros(n * dim), np.zeros(n * dim)
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = codes[lo:hi]
                count = sizes[part]
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(starts[part], count) + offset
                cell = np.repeat(rows[lo:hi], count) * dim + all_buckets[at]
                is_gram = offset > 0
                words += np.bincount(cell[~is_gram], minlength=n * dim)
                grams += np.bincount(cell[is_gram], minlength=n * dim)
            total = (words + weight * grams).reshape(n, dim)
            hit = total != 0
            out[hit] = 1.0 + np.log(total[hit])
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        np.divide(out, norm, out=out, where=norm > 0)
        values = pa.array(out.astype(np.float32).ravel())
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32()), values
        )

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            # Narrow slices keep the dense matrices small on wide batches, and what long texts take.
            slices = [embed(part.slice(i, n)) for i, n in _slices(part)]
            yield pa.concat_arrays(slices) if slices else pa.array([], pa.list_(pa.float32()))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, VECTOR)(tokens(c, rules))


def model_vectors(c: Column, embedder: Embedder) -> Column:
    """array<float> of a text from a user's model, one call per Arrow batch."""
    dim = int(embedder.dimensions)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            matrix = np.asarray(embedder.embed_batch(texts.fillna("")), dtype=np.float32)
            if matrix.shape != (len(texts), dim):
                raise ValueError(f"embedder returned {matrix.shape}, expected {(len(texts), dim)}")
            yield pd.Series(list(matrix))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, VECTOR)(c)


def vectors(c: Column, embedder: Embedder | HashedEmbedder) -> Column:
    if isinstance(embedder, HashedEmbedder):
        return hashed_vectors(c, embedder.rules)
    return model_vectors(c, embedder)


def embed(df: DataFrame, text: str, embedder: Embedder | HashedEmbedder) -> DataFrame:
    """Add ``embedding`` and ``embed_identity``."""
    return df.withColumn("embedding", vectors(F.col(text), embedder)).withColumn(
        "embed_identity", identity_of(embedder)
    )


def embed_batch(df: DataFrame, input_col: str, embedder: Embedder | HashedEmbedder) -> DataFrame:
    """One row per text of ``input_col`` (a string or an array), with its index kept."""
    kind = df.schema[input_col].dataType
    texts = F.col(input_col) if isinstance(kind, ArrayType) else F.array(F.col(input_col))
    exploded = df.select("*", F.posexplode_outer(texts).alias("index", "_input"))
    clean = exploded.withColumn("_input", F.coalesce(F.col("_input"), F.lit("")))
    return embed(clean, "_input", embedder).withColumnRenamed("_input", "input")


def sparse(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, bucket, weight) rows of the non-zero entries."""
    rows = once(df.select(key, vector), _vector=F.col(vector))
    return rows.select(key, F.posexplode("_vector").alias("bucket", "weight")).filter("weight != 0")


def cosine(a: Column, b: Column) -> Column:
    """0.0 for a zero vector or unequal lengths."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0), lambda s, v: s + v,
        )

    norms = dot(a, a) * dot(b, b)
    return F.when(
        (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / F.sqrt(norms)
    ).otherwise(F.lit(0.0))


def paired_cosine(a: Column, b: Column) -> Column:
    """``cosine`` for columns of many pairs, in Arrow batches; null vectors give 0.0 as well."""
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x))
        n, m = (pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False) for v in (x, y))
        for size in np.unique(n[(n == m) & (n > 0)]):
            rows = np.flatnonzero((n == m) & (n == size))
            for start in range(0, len(rows), 2048):
                at = rows[start:start + 2048]
                flat = [v.take(pa.array(at)).flatten() for v in (x, y)]
                p, q = (f.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) for f in flat)
                norms = np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q)
                # A missing component leaves no length to compare.
                usable = ~(norms <= 0)
                for f in flat:
                    if f.null_count:
                        usable &= ~f.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(1)
                out[at[usable]] = np.einsum("ij,ij->i", p[usable], q[usable]) / np.sqrt(norms[usable])
        return pa.array(out)

    return run(a, b)
