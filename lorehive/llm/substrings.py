"""Substring dedup with fixed-block anchors."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehive.llm import exchange
from lorehive.llm.common import staged
from lorehive.llm.interpolation import _planes, _rows, _unplanes

#: Words of documents that are handled together before anything is shuffled.
BLOCK_WORDS = 500_000
ANCHORED, SHARED = 1, 2

PACKED = "block long, ids binary, known binary, sizes binary, words binary"
HIT = "block long, done_ids binary, done_known binary, done_sizes binary, done_words binary, ids binary, known binary, sizes binary, words binary, starts binary"
CLEANED = "doc_id long, n_words long, removed array<struct<start: long, end: long>>, text string"
ODD1, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _rolling(hashes: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """A hash of the n words from each position on, as a difference of sums of powers."""
    at = np.arange(len(hashes) + 1)
    power = np.cumprod(np.where(at > 0, odd, np.uint64(1)), dtype=np.uint64)
    back = np.cumprod(np.where(at > 0, np.uint64(pow(int(odd), -1, 1 << 64)), np.uint64(1)), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)))
    return _mixed((total[n:] - total[:-n]) * back[: max(0, len(hashes) - n + 1)]) if len(hashes) >= n else np.zeros(0, np.uint64)


class Texts:
    """Documents as words, one after the other."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, words: list[bytes]):
        self.ids, self.known, self.sizes, self.words = ids, known, sizes, words

    @classmethod
    def unpacked(cls, ids: bytes, known: bytes, sizes: bytes, words: bytes) -> Texts:
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(known, bool), _unplanes(sizes).astype(np.int64), zstandard.decompress(words).split())

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.ids.tobytes(), self.known.tobytes(), _planes(self.sizes), zstandard.compress(b" ".join(self.words))

    def where(self, docs: np.ndarray) -> Texts:
        ends = np.cumsum(self.sizes).tolist()
        words = [w for k in np.flatnonzero(docs).tolist() for w in self.words[ends[k] - int(self.sizes[k]) : ends[k]]]
        return Texts(self.ids[docs], self.known[docs], self.sizes[docs], words)

    def hashes(self, *seeds: int) -> list[np.ndarray]:
        local: dict[bytes, int] = defaultdict()
        local.default_factory = local.__len__
        number = np.fromiter(map(local.__getitem__, self.words), dtype=np.int64, count=len(self.words))
        return [np.fromiter((xxhash.xxh64_intdigest(w, s) for w in local), dtype=np.uint64, count=len(local))[number] for s in seeds]

    def starts_of(self, n: int, least: int) -> np.ndarray:
        """Positions from which n words are in one document, of documents of least words or more."""
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        return np.flatnonzero((np.arange(len(ends)) + n <= ends) & (np.repeat(self.sizes, self.sizes) >= least))

    def in_doc(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document of each position, and the position in it."""
        ends = np.cumsum(self.sizes)
        doc = np.searchsorted(ends, positions, side="right")
        return doc, positions - (ends - self.sizes)[doc]


def _read(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple[int, Texts]]:
    part, count = TaskContext.get().partitionId(), 0
    ids, sizes, words = [], [], []

    def close() -> tuple[int, Texts]:
        known = np.array([i is not None for i in ids], dtype=bool)
        return (part << 32) + count, Texts(np.array([i or 0 for i in ids], dtype=np.int64), known, np.array(sizes, dtype=np.int64), words)

    for doc_id, text in _rows(batches):
        found = text.split()
        ids.append(doc_id)
        sizes.append(len(found))
        words += found
        if len(words) >= block_words:
            yield close()
            ids, sizes, words, count = [], [], [], count + 1
    if ids:
        yield close()


def _anchors(texts: Texts, window: int, buckets: int):
    """Positions of all rolling blocks of half a window; their distinct codes in order, with what this
    block of documents knows about each, and each position's place among them."""
    n = window // 2
    at = texts.starts_of(n, window)
    code = exchange.codes(_rolling(texts.hashes(0)[0], n, ODD1)[at], buckets)
    doc, start = texts.in_doc(at)
    order = np.lexsort((doc, code))
    c, d = code[order], doc[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    other = np.zeros(len(c), bool)
    other[1:] = ~new[1:] & (d[1:] != d[:-1])
    starts = np.flatnonzero(new)
    place = np.empty(len(c), np.int64)
    place[order] = np.cumsum(new) - 1
    info = np.bitwise_or.reduceat((start[order] % n == 0) * np.uint64(ANCHORED) | other * np.uint64(SHARED), starts) if len(c) else np.zeros(0, np.uint64)
    return at, c[starts], info, place


def _either(info: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduceat(info, starts) | (count > 1) * np.uint64(SHARED)


def _least(info: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(info, starts)


def _ask_anchors(window: int, buckets: int, fine: int, block_words: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = exchange.bucket_starts(buckets, fine)

        def rows() -> Iterator[list[tuple]]:
            for block, texts in _read(batches, block_words):
                _, code, info, _ = _anchors(texts, window, buckets)
                if found := [(k, block, *row) for k, row in exchange.cut(code, np.zeros_like(code), info, starts)]:
                    yield found

        return exchange.frames(rows())

    return ask


def _pack(block_words: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return exchange.frames(([(block, *texts.packed())] for block, texts in _read(batches, block_words)), PACKED)

    return pack


def _extended(at: np.ndarray, info: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Positions of windows in runs that a hit can be extended to: each rolling block of such a run is
    shared with another document, and one at least is anchored."""
    shared, anchored = np.zeros(n_words + 1, np.int64), np.zeros(n_words + 1, np.int64)
    shared[at + 1] = info & np.uint64(SHARED) > 0
    anchored[at + 1] = info == np.uint64(SHARED | ANCHORED)
    shared, anchored = np.cumsum(shared), np.cumsum(anchored)
    blocks = window - window // 2 + 1
    first = at[at + blocks <= n_words]
    return first[(shared[first + blocks] - shared[first] == blocks) & (anchored[first + blocks] > anchored[first])]


def _hits(window: int, buckets: int):
    def hits(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        texts = Texts.unpacked(r["ids"], r["known"], r["sizes"], r["words"])
        at, code, _, place = _anchors(texts, window, buckets)
        starts = _extended(at, exchange.answered(right, code)[place], window, len(texts.words))
        doc, start = texts.in_doc(starts)
        open_ = np.zeros(len(texts.sizes), bool)
        open_[doc] = True
        open_ &= texts.known
        kept = open_[doc]
        rest = texts.where(open_)
        number = np.cumsum(open_) - 1
        again = (np.cumsum(rest.sizes) - rest.sizes)[number[doc[kept]]] + start[kept]
        mask = np.zeros(len(rest.words), bool)
        mask[again] = True
        row = (int(r["block"]), *texts.where(~open_).packed(), *rest.packed(), np.packbits(mask).tobytes())
        return pd.DataFrame([row], columns=[c.split()[0] for c in HIT.split(", ")])

    return hits


def _windows(texts: Texts, starts: bytes, window: int, buckets: int):
    """Of the windows that may repeat: positions and documents; distinct keys in order with the least
    id that has each, and each window's place among them."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(starts, np.uint8), count=len(texts.words)))
    one, two = texts.hashes(0, 1)
    code = exchange.codes(_rolling(one, window, ODD1)[at], buckets)
    more = _rolling(two, window, ODD2)[at] >> np.uint64(24)
    doc, _ = texts.in_doc(at)
    # ids keep their order as unsigned numbers
    ids = texts.ids.view(np.uint64) ^ np.uint64(1 << 63)
    code, more, least, place = exchange.merged(code, more, ids[doc], _least)
    return at, doc, ids, code, more, least, place


def _ask_windows(window: int, buckets: int, fine: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = exchange.bucket_starts(buckets, fine)

        def rows() -> Iterator[list[tuple]]:
            for block, ids, known, sizes, words, starts in _rows(batches):
                _, _, _, code, more, least, _ = _windows(Texts.unpacked(ids, known, sizes, words), starts, window, buckets)
                if found := [(k, block, *row) for k, row in exchange.cut(code, more, least, edges)]:
                    yield found

        return exchange.frames(rows())

    return ask


def _cleaned(texts: Texts, gone: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(texts.sizes).tolist()
    rows = []
    for k, end in enumerate(ends):
        begin = end - int(texts.sizes[k])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[begin:end], [False])).astype(np.int8)))
        spans = [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        words = texts.words[begin:end]
        if spans:
            words = [w for w, g in zip(words, gone[begin:end].tolist()) if not g]
        rows.append((int(texts.ids[k]) if texts.known[k] else None, end - begin, spans, b" ".join(words).decode("utf-8", "replace")))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "removed", "text"]).astype({"doc_id": "Int64", "n_words": "int64"})


def _clean(window: int, buckets: int):
    def clean(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        texts = Texts.unpacked(r["ids"], r["known"], r["sizes"], r["words"])
        at, doc, ids, code, _, own, place = _windows(texts, r["starts"], window, buckets)
        least = exchange.answered(right, code)
        again = at[least[place] < ids[doc]]
        edge = np.zeros(len(texts.words) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + window, -1)
        return _cleaned(texts, np.cumsum(edge)[:-1] > 0)

    return clean


def _untouched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            texts = Texts.unpacked(*row)
            if len(texts.sizes):
                yield _cleaned(texts, np.zeros(len(texts.words), bool))


def remove_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", stage: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, removed (spans of words, end exclusive) and text (the words that are left, joined
    by one space) for each row: without what a document of a smaller id has too.

    A word goes if it is in a window of so many words whose sequence also starts in a document of a
    smaller id. Reference blocks of half a window stand at the multiples of their length, so any
    repeated window holds a whole one in each of its documents. All documents' rolling blocks probe
    them; a hit is extended to both sides for as long as the rolling blocks are shared, and what is as
    long as a window is verified: the least id of each whole window's sequence decides. Runs of such
    windows are the maximal repeats.

    Documents stay together in blocks of one input partition, which ask hash buckets about their
    distinct keys (40 bits besides the bucket; whole windows by 80), so a passage that all documents
    share costs a block one entry for each of its positions. Documents are never paired. The input is
    read twice and must give the same rows in the same order, as files do; stage=True writes it to a
    table first.

    Null and empty texts: no words. Null ids: neither remove nor lose words. Rows of one id don't
    remove from each other. Very long texts: a block of their own. Empty table: no rows. Other columns
    are not read. Ids are integers.
    """
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    row = staged(row, "texts") if stage else row
    # about six bytes a word
    n_words = (row.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    (buckets, fine), n_blocks = exchange.sizes(n_words), -(-n_words // block_words)
    asked = row.mapInArrow(_ask_anchors(window, buckets, fine, block_words), exchange.ASKED)
    answers = exchange.exchange(asked, fine, n_blocks, _either)
    packed = row.mapInArrow(_pack(block_words), PACKED)
    hit = staged(packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_hits(window, buckets), HIT), "anchor-hits")
    some = hit.select("block", "ids", "known", "sizes", "words", "starts")
    answers = exchange.exchange(some.mapInArrow(_ask_windows(window, buckets, fine), exchange.ASKED), fine, n_blocks, _least)
    cleaned = some.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_clean(window, buckets), CLEANED)
    return cleaned.unionByName(hit.select("done_ids", "done_known", "done_sizes", "done_words").mapInPandas(_untouched, CLEANED))
