"""Language-model scoring by deleted interpolation."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehive.llm.common import id_remainder, staged

#: Tokens of documents that are counted together before anything is shuffled.
BLOCK_TOKENS = 400_000
#: About as many n-grams meet in one bucket of hashes; more input means more buckets.
BUCKET_NGRAMS, LEAST_BUCKETS = 2_500_000, 64
#: A block's n-grams go to so many buckets at most. Where the input needs more, blocks ask in teams of
#: about so many: what a team asks of one bucket is summed, and then split by finer buckets.
WIRE_BUCKETS, TEAM_BLOCKS = 2048, 8192
LOW = np.uint64((1 << 40) - 1)
END = b""  # the token after the last word; no word is empty
#: Steps per octave of the bigram and unigram estimates in the held-out table.
FINE2, FINE1 = 4, 1

ASKED = "bucket int, block long, kind int, keys binary, counts binary, n int, sum long"
ANSWERED = "block long, bucket int, kind int, totals binary, n int, sum long, types long, tokens long"
BLOCKS = "block long, ids array<long>, held array<boolean>, train array<boolean>, sizes binary, words binary, hashes binary"
RESOLVED = "block long, ids array<long>, held array<boolean>, sizes binary, words binary, unigrams binary, bigrams binary, types long, tokens long, cells array<long>, weights array<long>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _planes(a: np.ndarray) -> bytes:
    """How many bytes the largest number has, then the lowest bytes of all numbers, then the next
    ones, so many times: small numbers compress well, and none is too large."""
    a = np.ascontiguousarray(a, dtype="<u8")
    width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<u8").ravel()


def _codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 more bits of the hashes: n-grams of one bucket sort together."""
    b = np.uint64(buckets)
    return (h % b) << np.uint64(40) | (h // b) & LOW


def _bigram_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15) ^ (second << np.uint64(31) | second >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class Block:
    """Documents of one input partition whose tokens are handled together."""

    def __init__(self, number: int, words: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, train: np.ndarray):
        self.number, self.words, self.sizes, self.hashes = number, words, sizes, hashes
        self.of_train = np.repeat(train, sizes)
        ends = np.cumsum(sizes) - 1
        self.before = np.empty_like(words)
        self.before[1:] = words[:-1]
        self.before[ends[:-1] + 1] = self.before[0] = words[ends[0]]  # what ends a text stands before the next one's first word

    def unigrams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes in order, and for each local word its place among them."""
        return np.unique(_codes(self.hashes, buckets), return_inverse=True)

    def bigrams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes in order, and for each token its bigram's place among them."""
        return np.unique(_codes(_bigram_hashes(self.hashes[self.before], self.hashes[self.words]), buckets), return_inverse=True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, of which few at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, 128).columns))


def _frames(rows: Iterator[list[tuple]], kind: str) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in kind.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    of = [types[c.split()[1]] for c in kind.split(", ")]
    for some in rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), of)], names=names)


def _read_blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[tuple[list, list, Block]]:
    """Ids, held-out flags and block, for each block of a partition."""
    part, count = TaskContext.get().partitionId(), 0
    ids, held, train, words, sizes = [], [], [], [], []

    def close() -> tuple[list, list, Block]:
        local: dict[bytes, int] = defaultdict()
        local.default_factory = local.__len__
        local[END]
        numbers = np.fromiter(map(local.__getitem__, words), dtype=np.int32, count=len(words))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in local), dtype=np.uint64, count=len(local))
        return ids, held, Block((part << 32) + count, numbers, np.array(sizes), hashes, np.array(train, dtype=bool))

    for doc_id, h, t, text in _rows(batches):
        found = text.lower().split()
        found.append(END)
        words += found
        sizes.append(len(found))
        ids.append(doc_id)
        held.append(h)
        train.append(t)
        if len(words) >= block_tokens:
            yield close()
            ids, held, train, words, sizes, count = [], [], [], [], [], count + 1
    if ids:
        yield close()


def _ask(buckets: int, fine: int, block_tokens: int):
    """What blocks count, a row per block, kind and wire bucket of so many fine buckets each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frames(rows(batches), ASKED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        starts = np.arange(-(-buckets // fine) + 1, dtype=np.uint64) * np.uint64(fine << 40)
        for _, _, block in _read_blocks(batches, block_tokens):
            per_word = np.bincount(block.words, weights=block.of_train, minlength=len(block.hashes))
            for kind in (0, 1):
                codes, place = block.unigrams(buckets) if kind == 0 else block.bigrams(buckets)
                counts = np.bincount(place, weights=per_word if kind == 0 else block.of_train, minlength=len(codes))
                yield [(k, block.number, kind, *row) for k, row in _cut(codes, counts, starts)]

    return ask


def _cut(codes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """For each range between two starts that has codes: keys (from its start on), counts, number, sum of codes."""
    cuts = np.searchsorted(codes, starts)
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        a, b = cuts[k], cuts[k + 1]
        yield k, (_planes(codes[a:b] - starts[k]), _planes(counts[a:b]), int(b - a), int(codes[a:b].sum().astype(np.int64)))


def _totals(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of rows that ask, their summed counts, and each asked key's place among them."""
    known, place = np.unique(np.concatenate([_unplanes(x) for x in part["keys"]]), return_inverse=True)
    return known, np.bincount(place, weights=np.concatenate([_unplanes(x) for x in part["counts"]]), minlength=len(known)), place


def _answers(part: pd.DataFrame, totals: np.ndarray, types: int, tokens: int) -> pd.DataFrame:
    """Rows that answer each row of part with its totals; the first has the bucket's share of the corpus totals."""
    each = np.split(totals, np.cumsum(part["n"].to_numpy())[:-1])
    answer = part[["block", "bucket", "kind", "n", "sum"]].assign(totals=[_planes(x) for x in each], types=0, tokens=0)
    answer.iloc[0, answer.columns.get_loc("types")], answer.iloc[0, answer.columns.get_loc("tokens")] = types, tokens
    return answer[[c.split()[0] for c in ANSWERED.split(", ")]]


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Totals over all blocks for each n-gram that a block asked about, in the block's order."""
    out = []
    for _, part in group.groupby("kind"):
        _, totals, place = _totals(part)
        out.append(_answers(part, totals[place], int((totals > 0).sum()), int(totals.sum())))
    return pd.concat(out)


def _ask_as_team(fine: int):
    """What a team's blocks ask of one wire bucket, summed, and split by its fine buckets."""

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        starts, rows = np.arange(fine + 1, dtype=np.uint64) << np.uint64(40), []
        for kind, part in group.groupby("kind"):
            known, totals, _ = _totals(part)
            rows += [(int(part["bucket"].iloc[0]) * fine + k, int(part["team"].iloc[0]), kind, *row) for k, row in _cut(known, totals, starts)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ASKED.split(", ")])

    return ask


def _hand_on(asked: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A team's answers for one wire bucket, to the blocks that asked."""
    out = []
    for kind, part in asked.groupby("kind"):
        _, _, place = _totals(part)
        got = answers[answers["kind"] == kind].sort_values("bucket")
        totals = np.concatenate([_unplanes(x) for x in got["totals"]])
        out.append(_answers(part, totals[place], int(got["types"].sum()), int(got["tokens"].sum())))
    return pd.concat(out)


def _exchange(row: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Each block's n-grams with their totals over the corpus, and the number of buckets.

    One exchange there and back for up to WIRE_BUCKETS buckets. Beyond, a block's rows would become
    so many that each holds few n-grams; so their number stays, teams of blocks ask the fine
    buckets, and hand the answers on.
    """
    buckets = max(LEAST_BUCKETS, size // 6 // BUCKET_NGRAMS)
    fine = -(-buckets // WIRE_BUCKETS)
    asked = row.mapInArrow(_ask(buckets, fine, BLOCK_TOKENS), ASKED)
    if fine == 1:
        return asked.groupBy("bucket").applyInPandas(_answer, ANSWERED), buckets
    teams = max(1, -(-size // (BLOCK_TOKENS * 6 * TEAM_BLOCKS)))
    asked = asked.withColumn("team", F.pmod(F.xxhash64("block"), F.lit(teams)))
    answers = asked.groupBy("team", "bucket").applyInPandas(_ask_as_team(fine), ASKED).groupBy("bucket").applyInPandas(_answer, ANSWERED)
    answers = answers.withColumn("team", F.col("block")).withColumn("wire", F.floor(F.col("bucket") / fine).cast("int"))
    return asked.groupBy("team", "bucket").cogroup(answers.groupBy("team", "wire")).applyInPandas(_hand_on, ANSWERED), buckets


def _pack(block_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ([(b.number, ids, held, b.of_train[np.cumsum(b.sizes) - 1].tolist(), _planes(b.sizes), _planes(b.words), b.hashes.tobytes())] for ids, held, b in _read_blocks(batches, block_tokens))
        return _frames(blocks, BLOCKS)

    return pack


def _cells(block: Block, pair: np.ndarray, c1: np.ndarray, c12: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Held-out counts: each training document's bigrams against the counts without this document.

    A cell is a context-frequency bucket with the levels of the bigram and the unigram estimate.
    """
    doc = np.repeat(np.arange(len(block.sizes)), block.sizes)[block.of_train]
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, before, pair = block.words[block.of_train], block.before[block.of_train], pair[block.of_train]
    n_words, n_pairs = len(block.hashes), len(c12)
    keys, first, own12 = np.unique(doc * n_pairs + pair, return_index=True, return_counts=True)
    words, own = np.unique(doc * n_words + word, return_counts=True)
    at = lambda w: own[np.searchsorted(words, doc[first] * n_words + w)]
    left1, left2 = c1[before[first]] - at(before[first]), c1[word[first]] - at(word[first])
    left12 = c12[pair[first]] - own12
    context = np.floor(np.log2(np.maximum(left1, 0) + 1)).astype(np.int64)
    with np.errstate(divide="ignore"):
        level2 = np.where(left12 > 0, np.round(-np.log2(np.maximum(left12, 1) / np.maximum(left1, 1)) * FINE2) + 1, 0).astype(np.int64)
    level1 = np.where(left2 > 0, np.round(np.log2(np.maximum(left2, 1)) * FINE1) + 1, 0).astype(np.int64)
    cell, place = np.unique((context * 1000 + np.clip(level2, 0, 999)) * 1000 + level1, return_inverse=True)
    return cell, np.bincount(place, weights=own12).astype(np.int64)


def _resolve(buckets: int):
    def resolve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        block = Block(int(r["block"]), _unplanes(r["words"]).astype(np.int32), _unplanes(r["sizes"]).astype(np.int64), np.frombuffer(r["hashes"], np.uint64), np.array(r["train"], dtype=bool))
        right = right.sort_values(["kind", "bucket"])
        totals = []
        for kind in (0, 1):
            codes, place = block.unigrams(buckets) if kind == 0 else block.bigrams(buckets)
            part = right[right["kind"] == kind]
            got = np.concatenate([_unplanes(x) for x in part["totals"]])
            if len(got) != len(codes) or int(codes.sum().astype(np.int64)) != int(np.array(part["sum"], dtype=np.int64).sum()):
                raise RuntimeError("the input's order changed between two passes; write it to a table first (stage=True)")
            totals.append(got[place].astype(np.int64))
        c1, of_token = totals
        pairs, first, pair = np.unique(block.before.astype(np.int64) * len(block.hashes) + block.words, return_index=True, return_inverse=True)
        c12 = of_token[first]
        cells, weights = _cells(block, pair, c1, c12)
        row = (block.number, list(r["ids"]), list(r["held"]), r["sizes"], r["words"], _planes(c1), _planes(c12), int(right["types"][right["kind"] == 0].sum()), int(right["tokens"][right["kind"] == 0].sum()), cells, weights)
        return pd.DataFrame([row], columns=[c.split()[0] for c in RESOLVED.split(", ")])

    return resolve


def fit_weights(cells: pd.DataFrame, types: int, tokens: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) for each context-frequency bucket, by
    expectation-maximisation on the held-out counts in cells(cell, n)."""
    weights = np.tile([0.0, 0.5, 0.5], (64, 1))
    cell, n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)
    context, level2, level1 = cell // 1_000_000, cell // 1000 % 1000, cell % 1000
    p2 = np.where(level2 > 0, 2.0 ** (-(level2 - 1) / FINE2), 0.0)
    p1 = np.where(level1 > 0, 2.0 ** ((level1 - 1) / FINE1) / max(tokens, 1), 0.0)
    p = np.stack([p2, p1, np.full(len(cell), 1 / (types + 1))], axis=1)
    for k in np.unique(context):
        mine, count = p[context == k], n[context == k]
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = mine * w
            new = (share * (count / share.sum(axis=1))[:, None]).sum(axis=0) / count.sum()
            done = np.abs(new - w).max() < 1e-6
            w = new
            if done:
                break
        weights[k] = w
    # a frequency that no held-out context has takes the weights of the next lower one
    for k in range(1, 64):
        if k not in context:
            weights[k] = weights[k - 1]
    return weights


def _score(types: int, tokens: int, weights: np.ndarray):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                sizes, words, c1, c12 = (_unplanes(x).astype(np.int64) for x in (r.sizes, r.words, r.unigrams, r.bigrams))
                block = Block(r.block, words, sizes, np.zeros(0), np.zeros(len(sizes), dtype=bool))
                pairs, pair = np.unique(block.before * len(c1) + words, return_inverse=True)
                before, word = pairs // len(c1), pairs % len(c1)
                w = weights[np.floor(np.log2(c1[before] + 1)).astype(np.int64)]
                p = w[:, 0] * c12 / np.maximum(c1[before], 1) + w[:, 1] * c1[word] / max(tokens, 1) + w[:, 2] / (types + 1)
                base = np.log10((c1 + 0.5) / (tokens + 0.5 * (types + 1)))
                starts = np.cumsum(sizes) - sizes
                yield pd.DataFrame({
                    "doc_id": pd.array(r.ids, dtype="Int64"), "held_out": list(r.held), "n_tokens": sizes, "n_known": np.add.reduceat((c1 > 0).astype(np.int64)[words], starts), "train_tokens": tokens,
                    "base_score": np.add.reduceat(base[words], starts), "score": np.add.reduceat(np.log10(p)[pair], starts),
                })

    return score


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stage: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each document.

    Tokens are lower-cased (A-Z) words and an end per text. score is the log10 probability under
    w2 * c(a b) / c(a) + w1 * c(b) / N + w0 / (V + 1), where the end of the text before stands
    before a first word. The weights depend on floor(log2(c(a) + 1)) and are learned by
    expectation-maximisation on held-out counts: each training document in turn is left out of the
    counts that predict its bigrams.

    Documents stay together in blocks of one input partition. A block asks for the totals of its
    distinct n-grams; buckets of hashes (40 bits besides the bucket) sum what all blocks have
    counted, and answer. So an n-gram that all documents hold costs a row per block, the number of
    buckets follows the size of the input, and what is shuffled keeps its proportion to it. The input is read twice and must give the same rows in
    the same order, as files do; stage=True writes it to a table first.

    Null text: empty, that is, one end. Very long texts: a block of their own. Null id: not held out, and not learned from. Repeated rows
    count and are scored each. Empty table: no rows. Other columns are not read. Ids are integers.
    """
    rest = id_remainder(F.col(id_col))
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(rest == 1, F.lit(False)).alias("held"), F.coalesce(rest != 1, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    row = staged(row, "texts") if stage else row
    size = row.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answered, buckets = _exchange(row, size)
    packed = row.mapInArrow(_pack(BLOCK_TOKENS), BLOCKS)
    resolved = staged(packed.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(_resolve(buckets), RESOLVED), "resolved-blocks", "zstd")

    types, tokens = (int(x or 0) for x in resolved.agg(F.sum("types"), F.sum("tokens")).first())
    cells = resolved.select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).groupBy(F.col("x.cells").alias("cell")).agg(F.sum("x.weights").alias("n"))
    # at most 64 contexts x 1000 levels x some 100 levels, whatever the input
    weights = fit_weights(cells.toPandas(), types, tokens)
    return resolved.select("block", "ids", "held", "sizes", "words", "unigrams", "bigrams").mapInPandas(_score(types, tokens, weights), SCORED)
