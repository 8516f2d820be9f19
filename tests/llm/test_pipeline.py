"""The pipeline's stages on one small table, each against what it should keep."""

import random
from collections import Counter
from pathlib import Path

import pytest

from lorehive.stage import new_path, staged
from tests_llm_common import DOCS, random_text

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path, odd, odd_rows, nothing):
    rng = random.Random(37)
    item = random_text(rng, 30)
    live = "Ab3dEf6hIj9kLm2nOp5qRs8tUv"
    rows = [(k, random_text(rng, 200), "en", "ab"[k % 2], 0) for k in range(40)]
    rows += [(100, rows[5][1], "en", "a", 0), (101, f"{random_text(rng, 50)} {item} {random_text(rng, 50)}", "en", "a", 0), (102, "123 456", "en", "b", 0), (103, None, "en", "b", 0), (104, f"{random_text(rng, 80)} {live}", "en", "b", 0)]
    df = spark.createDataFrame([(*r[:4], None if r[1] is None else len(r[1])) for r in rows], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0] for r in rows}
    for (name, stage), lost in zip(corpus_pipeline.STAGES, ({102, 103}, {100}, {101}, set(), set())):
        out = stage(spark, docs, str(tmp_path))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        kept -= lost
        got = {r["doc_id"]: r for r in out.collect()}
        assert set(got) == kept
        if name == "secret_scans":
            assert got[104]["text"].endswith("[SECRET]") and got[104]["n_chars"] == len(got[104]["text"])
        docs = staged(out, name)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
        out = stage(spark, odd, str(tmp_path)).collect()
        kept = [(r["doc_id"], r["size"] if "copies" in r else r["text"]) for r in out]
        # what each stage makes of nulls, empty texts, copies and repeated rows: no row twice that was there once
        assert not Counter(kept) - Counter((r[0], len((r[1] or "").split()) if "copies" in out[0] else r[1]) for r in odd_rows)


def test_stages_on_odd_rows(spark, tmp_path, odd, odd_rows):
    """Each stage by itself: which of the odd rows stay."""
    spark.createDataFrame([(1, "none of it is there at all in any text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name: Counter(r["doc_id"] for r in stages[name](spark, odd, str(tmp_path)).collect())
    every = Counter(r[0] for r in odd_rows)
    has_letter = Counter(r[0] for r in odd_rows if any(c.isalpha() for c in r[1] or ""))
    assert not ids("language_id") - has_letter and not ids("language_id").keys() & {4, 5, 8, 10}
    near = ids("simhash_near_dedup")
    assert near[1] == 1 and not near.keys() & {2, 3, 5, 8} and near[4] == 1 and near[6] == 1 and not near[7]
    assert ids("benchmark_decontamination") == ids("secret_scans") == ids("source_mix") == every


def test_scratch_goes_and_the_result_stays(spark, tmp_path):
    rng = random.Random(43)
    rows = [(k, random_text(rng, 150), "en", "ab"[k % 2], 0) for k in range(30)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, random_text(rng, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    root = Path(new_path(spark, "probe")).parent
    before = set(root.iterdir()) if root.exists() else set()
    got = corpus_pipeline.run(spark, str(tmp_path))
    left = {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before}
    assert "secret_scans" in left and not left & {"language_id", "simhash_near_dedup", "benchmark_decontamination", "fingerprints", "nodes", "secret-candidates", "seeds"}
    assert got.count() == 30
