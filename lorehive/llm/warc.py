"""WARC archives, and an index merged from their sorted runs."""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorehive.llm.common import new_path, staged

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"
MERGED = INDEX + ", shard int, position long"
#: Captures per shard of the merged index, about; their number follows the input.
SHARD_ROWS = 50_000
#: An archive ends with the record that takes it to so many bytes.
ARCHIVE_BYTES = 8 << 20
#: An empty gzip member, which ends an archive: Spark's text writer needs some line end.
EMPTY_MEMBER = zlib.compress(b"", wbits=31)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits, four characters each."""
    group = lambda i: F.conv(F.substring(F.sha1(payload), F.lit(5) * i + 1, F.lit(5)), 16, 10).cast("int")
    char = lambda n, shift: F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), group)
    return F.array_join(F.transform(groups, lambda n: F.concat(*[char(n, s) for s in (15, 10, 5, 0)])), "")


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, crawl_start: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A WARC record per page, with the blank lines that end it.

    Of pages with equal payloads of min_bytes or more, the one with the largest id is a response,
    the others revisit it. A revisit keeps the HTTP header, whose length is that of the payload.
    Captures are dated one second per id after crawl_start.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"))
    same = page.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"))
    page = page.join(same, "digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("latest"), F.col("page_id").isNull() & F.col("latest").isNotNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit(crawl_start).cast("timestamp")) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", date),
        # no null, and no line break in a header
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Refers-To", name(F.col("latest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block)),
    )
    return page.select(F.concat(head, F.lit(END), block, F.lit(END)).cast("binary").alias("record"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of whole records, a gzip member each, so that a record is read by its offset and
    length alone. A task fills one archive after the other; each is a file of Spark's text writer."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members, size = [], 0
        for batch in batches:
            for record in batch["record"]:
                members.append(zlib.compress(record, wbits=31))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [b"".join(members)]})
                    members, size = [], 0
        if members:
            yield pd.DataFrame({"archive": [b"".join(members)]})

    rows = records.mapInPandas(fill, "archive binary").select(F.col("archive").cast("string"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def url_key(url: str | None) -> str:
    """Host with its labels reversed, then path and query: pages of a site sort together."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return (url or "").lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset and length of each member of a gzip file, and what it holds."""
    view, at = memoryview(data), 0
    while at < len(data):
        inflate, held, to = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if to >= len(data):
                raise ValueError(f"the member at byte {at} is cut off")
            held.append(inflate.decompress(view[to : to + 4096]))
            to = min(to + 4096, len(data))
        to -= len(inflate.unused_data)
        yield at, to - at, b"".join(held)
        at = to


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or data[stop:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, data[end + 4 : stop]


def _order(row: tuple) -> tuple:
    """url_key, capture time, then page id (none first)."""
    return row[2], row[3], row[0] is not None, row[0] or 0


def _index_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in INDEX.split(", ")]
    number = lambda x: int(x[10:-1]) if len(x) > 11 else None
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            run = []
            for at, length, data in members(content):
                if not data:
                    continue
                f, block = parse_record(data)
                http, _, body = block.partition(b"\r\n\r\n")
                digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rsplit(b": ", 1)[1])
                if f["WARC-Type"] == "response":
                    size, found = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if found != digest:
                        raise ValueError(f"payload of {f['WARC-Record-ID']} differs from its digest")
                url = f.get("WARC-Target-URI")
                refers = number(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
                run.append((number(f["WARC-Record-ID"]), url, url_key(url), f["WARC-Date"], f["WARC-Type"], size, digest, refers, path.rsplit("/", 1)[-1], at, length))
            run.sort(key=_order)
            yield pd.DataFrame(run, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


class LoserTree:
    """k-way merge of sorted runs: the inner nodes keep the losers, so each next row costs one path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _key(self, i: int) -> tuple:
        return (0, *_order(self.runs[i][self.at[i]]), i) if self.at[i] < len(self.runs[i]) else (1, i)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # first match at this node: wait for an opponent
                self.tree[node] = winner
                return
            if self._key(self.tree[node]) < self._key(winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.at[w := self.tree[0]] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


def _merge_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of sorted runs that a shard gets, merged by a loser tree."""
    columns = [c.split()[0] for c in INDEX.split(", ")]
    runs: dict[str, list[list[tuple]]] = {}
    for batch in batches:
        for archive, part in batch.groupby("archive", sort=False):
            pieces = runs.setdefault(archive, [[]])
            for row in part[columns].astype(object).where(part.notna(), None).itertuples(index=False, name=None):
                if pieces[-1] and _order(row) < _order(pieces[-1][-1]):  # a run that was read in several tasks
                    pieces.append([])
                pieces[-1].append(row)
    merged, at = iter(LoserTree([piece for pieces in runs.values() for piece in pieces if piece])), 0
    while some := list(itertools.islice(merged, 10_000)):
        out = pd.DataFrame(some, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        yield out.assign(shard=TaskContext.get().partitionId(), position=range(at, at + len(some)))
        at += len(some)


def merged_index(runs: DataFrame, rows: int) -> DataFrame:
    """One history of all captures from locally sorted runs: shards that follow each other in order
    of url_key, capture time and id, position within each.

    Spark's range partitioning draws the borders over the whole sort key, so a URL with very many
    captures is split too, and there are as many shards as rows ask for. Each shard merges its pieces
    of the runs.
    """
    dealt = runs.repartitionByRange(max(1, -(-rows // SHARD_ROWS)), "url_key", "captured", "page_id")
    return dealt.mapInPandas(_merge_shard, MERGED)


def capture_history(pages: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Writes pages as WARC archives, reads them back, and returns their merged index.

    A row per page: page_id, url, url_key, captured, record_type, payload_bytes, payload_digest,
    refers_to, archive, offset and length (of the record's gzip member in its archive), shard,
    position in the shard, place in the whole history.

    Null html: an empty payload. Null url: no target field, the empty key. Null ids: a payload's
    response has the largest id; without any, all are responses. Rows that repeat the largest id
    are responses each. Ties of url_key, time and id: in any order. Very long html: a record, and an
    archive, of its own size. Empty table: no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    write_archives(records(pages, **options), path)
    return read_history(spark, path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    runs = staged(files.mapInPandas(_index_runs, INDEX), "index-runs")
    history = staged(merged_index(runs, runs.count()), "history")
    # a row per shard
    before = history.groupBy("shard").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    return history.join(before.drop("n"), "shard").withColumn("place", F.col("before") + F.col("position")).drop("before")
