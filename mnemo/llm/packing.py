"""Packing token streams into sequences, in order, by dynamic programming.

Each partition of the input is one stream, in its own order: nothing is shuffled, and a lost task
packs its partition again to the same result. Cuts may fall at document ends (free), sentence ends
and, where those are rare, word ends or anywhere. The cost of a sequence is its padding plus the
penalty of its cut; the cheapest cutting is found in one pass, as the best start for an end is the
least of ``cost + position`` over a sliding window, which a monotone queue keeps.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long"
)


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str
    #: Id put after each document.
    end: int = 1
    length: int = 2048
    #: Sequences of these lengths need no padding.
    exact: tuple[int, ...] = (128, 256, 512, 1024)
    #: Padding tokens that a cut after a sentence, after a word, or within a word is worth.
    sentence: int = 8
    word: int = 64
    inside: int = 128
    #: Without a better place for so many tokens, a word end may be cut.
    sparse: int = 64
    #: Tokens cut at a time; the last, open sequence moves on to the next.
    buffer: int = 1 << 20
    #: Entries of a worker's word caches; a full cache is emptied, which costs time only.
    cache: int = 300_000


#: Words that fall apart into the tokenizer's own pieces by this pattern: no apostrophe, no letter
#: outside Latin-1, so lower-casing and composing leave each piece as it is.
_PLAIN = "^[!-&(-;=-~À-ÖØ-öø-ÿ]+$"
_PIECES = "([a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
_SENTENCE = "[.!?]$"


def _spread(pool: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``pool``, which lie in order of their ``sizes``, in the order of ``code``; their sizes."""
    begin, size = np.cumsum(sizes) - sizes, sizes[code]
    done = np.cumsum(size)
    take = np.arange(int(done[-1]) if len(done) else 0) + np.repeat(begin[code] - (done - size), size)
    return pool[take], size


class WordTokens:
    """Token ids of words between white space, by the tokenizer itself.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of
    its words in order. Plain words fall apart into pieces (letters, digit, signs) in Arrow kernels;
    a piece, which recurs far more often than a word, is encoded once and looked up again.
    """

    def __init__(self, path: str, cache: int = PackConfig.cache):
        from tokenizers import Tokenizer, pre_tokenizers

        self.cache = cache
        self.full = Tokenizer.from_file(path)
        # The same model, without what plain words do not need.
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """No piece is known: names, ids behind each other, and how many each has."""
        self.known, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand among the known ones; unknown ones are encoded first."""
        if len(self.known) > self.cache:
            self._forget()
        found = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(found.is_null())
        names, ids, sizes = new.to_pylist(), [self.ids], [self.sizes]
        for at in range(0, len(names), 5_000):
            part = names[at: at + 5_000]
            e = self.bare.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, "<u4"))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        place = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(names))
        self.known = pa.concat_arrays([self.known, new])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        return place

    def _of_words(self, words: list[str]) -> list[bytes]:
        if len(self.words) > self.cache:
            self.words.clear()
        for w in words:
            if w not in self.words:
                self.words[w] = np.array(self.full.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return list(map(self.words.__getitem__, words))

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words behind each other, and how many each has."""
        plain = pc.match_substring_regex(words, _PLAIN)
        cut = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), pattern=_PIECES, replacement="\\1 ")
        parts = pc.split_pattern(pc.ascii_rtrim_whitespace(cut), pattern=" ")
        coded = parts.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        ids, size = _spread(self.ids, self.sizes, place[coded.indices.to_numpy()])
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py() if len(parts) else np.zeros(1, np.int64)
        each = np.diff(np.append(0, np.cumsum(size))[bounds])
        found = self._of_words(words.filter(pc.invert(plain)).to_pylist())
        others, other_sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        # Plain words first, then the others; back into the given order.
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)
        place[mask] = np.arange(len(each))
        place[~mask] = len(each) + np.arange(len(other_sizes))
        return _spread(np.concatenate([ids, others]), np.concatenate([each, other_sizes]), place)


_loaded: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, cache: int) -> WordTokens:
    """One per worker process, which serves many tasks."""
    key = (path, cache)
    if key not in _loaded:
        _loaded[key] = WordTokens(path, cache)
    return _loaded[key]


def encode(texts: pa.Array, tokens: WordTokens, config: PackConfig):
    """Ids of all texts behind each other; their ends; cut places and their penalties.

    Nulls are empty. Every document ends with ``config.end``.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.dictionary_encode()
    of = coded.indices.to_numpy()
    pool, sizes = tokens(coded.dictionary)
    last = pc.match_substring_regex(coded.dictionary, _SENTENCE).to_numpy(zero_copy_only=False)
    told, lengths = _spread(pool, sizes, of)
    done = np.append(0, np.cumsum(lengths))
    docs = np.arange(1, len(offsets))
    ends = done[offsets[1:]] + docs
    ids = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
    word_doc = np.searchsorted(offsets[1:], np.arange(len(of)), "right")
    word_start = done[:-1] + word_doc
    # All places but the ends of documents hold the words' ids, in order.
    inside = np.ones(len(ids), bool)
    inside[ends - 1] = False
    ids[inside] = told
    ids[ends - 1] = config.end
    word_end = word_start + lengths
    stops = last[of] if len(of) else np.zeros(0, bool)
    # Where a document, a sentence or a word ends; an end of more than one kind is the best kind.
    places = np.concatenate([ends, word_end[stops], word_end[~stops]])
    kinds = np.concatenate([np.zeros(len(ends), int), np.full(stops.sum(), 1), np.full((~stops).sum(), 2)])
    order = np.lexsort((kinds, places))
    places, kinds = places[order], kinds[order]
    first = np.append(True, places[1:] != places[:-1]) & (places > 0)
    return ids, ends, places[first], kinds[first]


def candidates(places: np.ndarray, kinds: np.ndarray, total: int, config: PackConfig):
    """Cut positions and penalties: good ends, and others where good ones are far apart."""
    good = kinds < 2
    strong = places[good]
    # A word end serves if the next multiple of ``sparse`` after the last good end falls in it.
    before = np.append(0, strong)[np.searchsorted(strong, places, "left")]
    grid = (places - before) // config.sparse
    previous = np.append(0, places[:-1])
    serves = good | (grid > np.where(previous >= before, (previous - before) // config.sparse, 0))
    places, kinds = places[serves], kinds[serves]
    step = config.length // 2
    gaps = np.diff(np.append(0, places))
    more = [np.arange(p - g + step, p, step) for p, g in zip(places[gaps > step], gaps[gaps > step])]
    inner = np.concatenate([np.zeros(0, np.int64), *more])
    cost = np.array([0, config.sentence, config.word])[kinds]
    at = np.concatenate([places, inner])
    cost = np.concatenate([cost, np.full(len(inner), config.inside)])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def cuts(at: np.ndarray, cost: np.ndarray, config: PackConfig) -> list[int]:
    """Ends of the sequences, the last position included, of least padding plus penalties."""
    exact = []
    for size in config.exact:
        i = np.searchsorted(at, at - size)
        hit = np.where((i < len(at)) & (at[np.minimum(i, len(at) - 1)] == at - size), i, -1)
        exact.append(np.where(at == size, -2, hit))
    exact = np.stack(exact, 1) if len(at) else np.zeros((0, 1), np.int64)
    # Few positions end a sequence that needs no padding.
    short = {int(j): [k for k in exact[j].tolist() if k != -1] for j in np.flatnonzero((exact != -1).any(1))}
    positions, penalties, full = at.tolist(), cost.tolist(), config.length
    best: list[float] = []
    back: list[int] = []
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])
    push, pop, drop = queue.append, queue.pop, queue.popleft
    for j, (p, penalty) in enumerate(zip(positions, penalties)):
        while p - queue[0][1] > full:
            drop()
        value, _, i = queue[0]
        value += full - p
        if j in short:
            for k in short[j]:
                other = 0.0 if k == -2 else best[k]
                if other < value:
                    value, i = other, (-1 if k == -2 else k)
        value += penalty
        best.append(value)
        back.append(i)
        key = value + p
        while queue and queue[-1][0] >= key:
            pop()
        push((key, p, j))
    out, j = [], len(positions) - 1
    while j >= 0:
        out.append(positions[j])
        j = back[j]
    return out[::-1]


class Stream:
    """Tokens of one partition that are not in a finished sequence yet."""

    def __init__(self, config: PackConfig, first: int):
        self.config, self.next = config, first
        self.ids = np.zeros(0, "<u4")
        self.places, self.kinds = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Per document: id, where it starts in ``ids`` (below 0 if begun earlier), its tokens.
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, keys: list, ids, ends, places, kinds) -> None:
        base = len(self.ids)
        starts = np.append(0, ends[:-1])
        self.docs += [(k, base + int(s), int(e - s)) for k, s, e in zip(keys, starts, ends)]
        self.ids = np.concatenate([self.ids, ids])
        self.places = np.concatenate([self.places, places + base])
        self.kinds = np.concatenate([self.kinds, kinds])

    def finish(self, last: bool) -> pa.RecordBatch:
        """Cut what is held; unless it is the last, the open end stays."""
        config = self.config
        ends = cuts(*candidates(self.places, self.kinds, len(self.ids), config), config)
        if not last and ends:
            ends.pop()
        rows: list[tuple] = []
        start, d = 0, 0
        for end in ends:
            at = start
            while at < end:
                while self.docs[d][1] + self.docs[d][2] <= at:
                    d += 1
                key, begin, size = self.docs[d]
                stop = min(end, begin + size)
                crc = zlib.crc32(self.ids[at:stop].tobytes())
                rows.append((key, at - begin, stop - at, crc, size, self.next, at - start))
                at = stop
            self.next += 1
            start = end
        while d < len(self.docs) and self.docs[d][1] + self.docs[d][2] <= start:
            d += 1
        self.docs = [(k, b - start, n) for k, b, n in self.docs[d:]]
        self.ids = self.ids[start:]
        kept = self.places > start
        self.places, self.kinds = self.places[kept] - start, self.kinds[kept]
        columns = list(zip(*rows)) or [[]] * 7
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def pack(docs: DataFrame, config: PackConfig) -> DataFrame:
    """``docs`` (doc_id, text) to one row per piece of a document in a sequence.

    A null or empty text is the end id alone. Ids may be null or repeat: each row is a document of
    its own. Sequence ids are unique over the partitions, not consecutive.
    """
    def run(batches):
        tokens = word_tokens(config.tokenizer, config.cache)
        stream = Stream(config, TaskContext.get().partitionId() << 40)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(keys):
                # Some 2 MB of text at a time, one text at least.
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + (2 << 20), "right")))
                part = slice(at, end)
                stream.add(keys[part].to_pylist(), *encode(texts[part], tokens, config))
                at = end
                if len(stream.ids) >= config.buffer:
                    yield stream.finish(False)
        if len(stream.ids):
            yield stream.finish(True)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
