"""Tables with empty texts, which sf0.001 to sf0.1 have none of: queries that say of every file what became of it."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = [
    "Some text of the first file. " * 9, "", "HEADINGS!! ONLY!!", "some  text of the first file. " * 9, "Another text.\nIt has two lines.", "", "Last but one. " * 20, " \n", "Another text.\nIt has two lines.", "", "Some text of the first file. " * 9, "ANOTHER TEXT.\nIt has two lines.", "",
]


@pytest.mark.parametrize("name", ["ingest_catalogue", "str1_stream_catalogue", "str1_stream_tags", "ded5_stored_verdicts", "ded11_store_after", "ded11_reprocess"])
def test_empty_files_are_documents(spark, tmp_path, name):
    rows = [(k, t, "en" if k % 2 else "de", f"s{k % 3}") for k, t in enumerate(TEXTS, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in got.description]
    want = sorted(map(str, got.fetchall()))
    assert want and sorted(str(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).select(columns).collect()) == want
