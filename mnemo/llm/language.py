"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot ``s`` holds a bit mask whose bit ``l`` says
that some n-gram of language ``l`` hashes to ``s``. The AND of an n-gram's slots gives all
languages that contain it at once. A text's n-grams are looked up, each language's bits are
counted, the count is corrected for the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mnemo.llm.common import mixed, per_text, spaced, utf8

#: Letters of ASCII in lower case, other bytes of ASCII as a space, all else unchanged.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


@dataclass(frozen=True)
class LanguageConfig:
    #: About this many documents of each language are read for the fit, those of least hash.
    per_language: int = 3000
    #: An n-gram belongs to a language if it is at least this share of the language's n-grams.
    #: It also bounds the n-grams per language, so the filter's size does not grow with the data.
    min_share: float = 1e-5
    #: Slots per n-gram of the largest language; hash functions.
    slots: int = 16
    hashes: int = 2


@dataclass(frozen=True)
class Filter:
    languages: tuple[str, ...]
    common: str
    #: planes x slots; plane p has the bits of languages 64p to 64p + 63.
    masks: np.ndarray
    false_rate: np.ndarray


def ngrams(text: bytes):
    """Codes of the byte 3-grams and 4-grams of each word with its boundaries."""
    for a in spaced(text.translate(FOLD)):
        wide, inner = a.astype(np.uint64), a != 32
        three = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
        four = (three[:-1] << np.uint64(8)) | wide[3:] | np.uint64(1 << 32)
        yield three[inner[1:-1]]
        yield four[inner[1:-2] & inner[2:-1]]


def _places(codes: np.ndarray, hashes: int, slots: int):
    h = mixed(codes)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield ((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64)


def fit(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> Filter | None:
    """Learn from ``docs`` (doc_id, text, lang); rows without a language teach nothing.

    None if there is no such row. The driver gets one row per language and the n-grams above the
    share, at most ``2 / min_share`` per language.
    """
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    rates = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, config.per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(draw < rates[F.col("lang")]).select("lang", "text")

    def count(batches):
        pending: dict[str, list] = {}
        held = 0

        def flush():
            for lang, parts in pending.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(codes), pa.string()),
                    "gram": pa.array(codes.astype(np.int64)), "n": pa.array(n.astype(np.int64)),
                })
            pending.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                for codes in ngrams(text):
                    pending.setdefault(lang, []).append(codes)
                    held += len(codes)
                if held > 4_000_000:
                    yield from flush()
                    held = 0
        yield from flush()

    grams = sample.mapInArrow(count, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for k in sizes for x in (k, config.min_share * totals.get(k, 0))])
    kept = grams.filter(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toArrow()
    languages = tuple(sorted(sizes))
    of, gram = np.array(kept["lang"].to_pylist(), dtype=object), kept["gram"].to_numpy().astype(np.uint64)
    most = max([1, *(int((of == lang).sum()) for lang in languages)])
    slots = 1 << int(np.ceil(np.log2(config.slots * most)))
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    masks = np.zeros((-(-len(languages) // 64), slots), kind)
    false = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        bit = kind(1 << (i % 64))
        for at in _places(gram[of == lang], config.hashes, slots):
            masks[i // 64, at] |= bit
        false[i] = float((masks[i // 64] & bit != 0).mean()) ** config.hashes
    common = min(languages, key=lambda lang: (-sizes[lang], lang))
    return Filter(languages, common, masks, false)


def identify(text: Column, filter_: Filter | None, config: LanguageConfig = LanguageConfig()) -> Column:
    """Struct of lang_pred and score (its share of all corrected counts) of each whole text.

    Null texts and texts without a letter give ``und`` and 0, as do all without a fitted
    language. A text none of whose n-grams is known gets the commonest language.
    """
    undetermined = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")).cast(RESULT)
    if filter_ is None:
        return undetermined
    names, masks, false = filter_.languages, filter_.masks, filter_.false_rate

    def compute(texts):
        out = []
        for text in texts:
            n, counts = 0, np.zeros(len(names))
            for codes in ngrams(text):
                n += len(codes)
                places = list(_places(codes, config.hashes, masks.shape[1]))
                for p, plane in enumerate(masks):
                    found = plane[places[0]]
                    for at in places[1:]:
                        found = found & plane[at]
                    for i in range(p * 64, min(len(names), p * 64 + 64)):
                        counts[i] += np.count_nonzero(found & found.dtype.type(1 << (i % 64)))
            true = np.clip((counts - n * false) / (1 - np.minimum(false, 0.999)), 0, None)
            best = int(true.argmax())
            known = true[best] > 0
            out.append({
                "lang_pred": names[best] if known else filter_.common,
                "score": float(true[best] / true.sum()) if known else 1 / len(names),
            })
        return out

    return F.when(text.rlike(r"\p{L}"), per_text(RESULT, compute)(text)).otherwise(undetermined)
