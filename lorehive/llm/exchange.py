"""Blocks of documents ask what all blocks together know about a key, and get an answer per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehive.llm.interpolation import _frames, _planes, _unplanes

#: About as many keys meet in one bucket; more input means more buckets.
BUCKET_KEYS, LEAST_BUCKETS = 2_500_000, 64
#: A block's keys go to so many buckets at most. Where the input needs more, blocks ask in teams of
#: about so many: what a team asks of one bucket is merged, and then split by finer buckets.
WIRE_BUCKETS, TEAM_BLOCKS = 2048, 8192

ASKED = "bucket int, block long, keys binary, more binary, info binary, n int, sum long"
ANSWERED = "block long, bucket int, info binary, n int, sum long"
_NAMES, _BACK = ([c.split()[0] for c in kind.split(", ")] for kind in (ASKED, ANSWERED))

#: info of equal keys, one after the other from each of starts, and how many there are, to one info each
Merge = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 more bits of the hashes: keys of one bucket sort together."""
    b = np.uint64(buckets)
    return (h % b) << np.uint64(40) | (h // b) & np.uint64((1 << 40) - 1)


def merged(keys: np.ndarray, more: np.ndarray, info: np.ndarray, merge: Merge) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, more) in order, their merged info, and each given key's place among them."""
    if not len(keys):
        return keys, more, info, np.zeros(0, np.int64)
    order = np.lexsort((more, keys)) if more.any() else np.argsort(keys, kind="stable")
    keys, more = keys[order], more[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])))
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[starts], more[starts], merge(info[order], starts, np.diff(np.append(starts, len(keys)))), place


def bucket_starts(buckets: int, fine: int) -> np.ndarray:
    return np.arange(-(-buckets // fine) + 1, dtype=np.uint64) * np.uint64(fine << 40)


def cut(keys: np.ndarray, more: np.ndarray, info: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """For each range between two starts that has keys: what ASKED has from keys on."""
    cuts = np.searchsorted(keys, starts)
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        a, b = cuts[k], cuts[k + 1]
        yield k, (_planes(keys[a:b] - starts[k]), _planes(more[a:b]), _planes(info[a:b]), int(b - a), int(keys[a:b].sum().astype(np.int64)))


def frames(rows: Iterator[list[tuple]], kind: str = ASKED):
    return _frames(rows, kind)


def _merged(part: pd.DataFrame, merge: Merge):
    return merged(*(np.concatenate([_unplanes(x) for x in part[c]]) for c in ("keys", "more", "info")), merge)


def _answers(part: pd.DataFrame, info: np.ndarray) -> pd.DataFrame:
    each = np.split(info, np.cumsum(part["n"].to_numpy())[:-1])
    return part[["block", "bucket", "n", "sum"]].assign(info=[_planes(x) for x in each])[_BACK]


def _answer(merge: Merge):
    def answer(group: pd.DataFrame) -> pd.DataFrame:
        _, _, info, place = _merged(group, merge)
        return _answers(group, info[place])

    return answer


def _ask_as_team(fine: int, merge: Merge):
    def ask(group: pd.DataFrame) -> pd.DataFrame:
        keys, more, info, _ = _merged(group, merge)
        bucket, team = int(group["bucket"].iloc[0]), int(group["team"].iloc[0])
        return pd.DataFrame([(bucket * fine + k, team, *row) for k, row in cut(keys, more, info, np.arange(fine + 1, dtype=np.uint64) << np.uint64(40))], columns=_NAMES)

    return ask


def _hand_on(merge: Merge):
    def hand_on(asked: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=_BACK)
        place = _merged(asked, merge)[3]
        return _answers(asked, np.concatenate([_unplanes(x) for x in answers.sort_values("bucket")["info"]])[place])

    return hand_on


def sizes(n_keys: int) -> tuple[int, int]:
    """Number of buckets for about so many keys, and how many of them a block asks with one row."""
    buckets = max(LEAST_BUCKETS, n_keys // BUCKET_KEYS)
    return buckets, -(-buckets // WIRE_BUCKETS)


def exchange(asked: DataFrame, fine: int, n_blocks: int, merge: Merge) -> DataFrame:
    """The merged info of each asked key, in the order in which a block asked.

    One exchange there and back for up to WIRE_BUCKETS buckets. Beyond, a block's rows would become
    so many that each holds few keys; so their number stays, teams of blocks ask the fine buckets,
    and hand the answers on. A key that all blocks hold costs each of them one entry.
    """
    if fine == 1:
        return asked.groupBy("bucket").applyInPandas(_answer(merge), ANSWERED)
    teams = max(1, -(-n_blocks // TEAM_BLOCKS))
    asked = asked.withColumn("team", F.pmod(F.xxhash64("block"), F.lit(teams)))
    answers = asked.groupBy("team", "bucket").applyInPandas(_ask_as_team(fine, merge), ASKED).groupBy("bucket").applyInPandas(_answer(merge), ANSWERED)
    answers = answers.withColumn("team", F.col("block")).withColumn("wire", F.floor(F.col("bucket") / fine).cast("int"))
    return asked.groupBy("team", "bucket").cogroup(answers.groupBy("team", "wire")).applyInPandas(_hand_on(merge), ANSWERED)


def answered(answers: pd.DataFrame, keys: np.ndarray) -> np.ndarray:
    """The answers of all buckets to one block, in the order of its distinct keys."""
    answers = answers.sort_values("bucket")
    info = np.concatenate([np.zeros(0, np.uint64), *(_unplanes(x) for x in answers["info"])])
    if len(info) != len(keys) or int(keys.sum().astype(np.int64)) != int(answers["sum"].to_numpy(np.int64).sum()):
        raise RuntimeError("the input's order changed between two passes; write it to a table first (stage=True)")
    return info
