"""Archives that seek by offset and length, shards without a cap, and the whole history's order."""

import gzip
import random
from collections import Counter
from pathlib import Path

from lorehive.llm import warc

PAGES = "page_id long, url string, html string"


def test_each_record_is_read_by_its_offset_and_length(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"http://h{k % 3}.example.com/{k}", "".join(rng.choice("<>ab é\r\n") for _ in range(rng.randrange(400)))) for k in range(200)] + [(500, "http://x/", "long " * 400_000)]
    path = str(tmp_path / "archives")
    warc.write_archives(warc.records(spark.createDataFrame(rows, PAGES).repartition(3)), path, archive_bytes=3000)
    files = {f.name: f.read_bytes() for f in Path(path).glob("*.txt")}
    assert len(files) > 5 and all(len(f) < 3000 + 1000 or b"long " in gzip.decompress(f) for f in files.values())
    html = {k: h for k, _, h in rows}
    for r in warc.read_history(spark, path).collect():
        record = gzip.decompress(files[r["archive"]][r["offset"] : r["offset"] + r["length"]])
        fields, block = warc.parse_record(record)
        assert fields["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>" and fields["WARC-Type"] == r["record_type"]
        if r["record_type"] == "response":
            assert block.partition(b"\r\n\r\n")[2] == html[r["page_id"]].encode()


def test_shards_follow_the_rows(spark, monkeypatch):
    """Many more shards than rows of a run, and a URL that a third of all captures have."""
    monkeypatch.setattr(warc, "SHARD_ROWS", 2)
    rng = random.Random(3)
    rows = [(k, "http://hot.example.com/" if rng.random() < 0.34 else f"http://h{rng.randrange(40)}.example.com/?q={rng.randrange(5)}", f"page {k}") for k in range(600)]
    got = warc.capture_history(spark.createDataFrame(rows, PAGES).repartition(5)).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(600))
    key = [(r["url_key"], r["captured"], r["page_id"]) for r in got]
    assert key == sorted(key) and {r["page_id"] for r in got} == set(range(600))
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) > 150 and max(sizes.values()) < 60
    assert [(r["shard"], r["position"]) for r in got] == sorted((r["shard"], r["position"]) for r in got)
