import io
import struct

import duckdb
import pytest
import zstandard

from pyspark.sql import functions as F

from lumentrack.llm import warc

D = "/root/testdata/sf0.01/pages.parquet"


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{D}'")
    assert got(warc.read(warc.write(spark.read.parquet(D)))) == sorted(duckdb.sql(warc.ORACLE_SQL).fetchall(), key=str)


def test_edges(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "a\r\nb", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é" * 50000), (5, "u", "é" * 50000), (6, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest")
    out = {}
    for r in warc.read(warc.write(df), payloads=True).collect():
        out.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload and bytes(r.payload).decode(), r.payload_bytes))
    same = ("revisit", 2, None, 4)
    assert out[1] == [same] and out[None] == [same] and out[2] == [("response", None, "same", 4)]
    assert out[3] == [("revisit", 4, None, 0)] and out[4][0][:2] == ("response", None)
    assert out[5] == [("response", None, "é" * 50000, 100000)] * 2 and out[6][0][2] == "WARC/1.1\r\n\r\n"
    assert warc.read(warc.write(df, min_bytes=5)).where("record_type = 'revisit'").count() == 0
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_faults():
    record = warc._record(1, "u", b"body", warc.digest(b"body"), None, False)
    assert warc.parse(record)["payload"] == b"body"
    for bad in (record.replace(b"body", b"bodx"), record[:-1], record + b"x", record.replace(b"WARC/1.1", b"WARC/9")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    frame = zstandard.ZstdCompressor().compress(record)
    assert list(warc.frames(io.BytesIO(frame * 3))) == [record] * 3
    for bad in (frame[:-3], frame + b"junk", struct.pack("<II", warc.DICT_MAGIC, 99) + b"x"):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(bad)))


def test_unresolved_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "other"), (4, "u", None)], "page_id long, url string, html string")
    records = warc.read(warc.write(pages))
    assert warc.unresolved(records).count() == 0
    assert [r.page_id for r in warc.unresolved(records.where("page_id <> 2")).collect()] == [1]
    assert [r.page_id for r in warc.unresolved(records.selectExpr("page_id", "CASE WHEN page_id = 2 THEN 'X' ELSE payload_digest END AS payload_digest", "record_type", "refers_to")).collect()] == [1]
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_hot_payload(spark):
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("html"))
    rows = {r.page_id: r for r in warc.read(warc.write(pages)).collect()}
    assert len(rows) == 1000 and {r.refers_to for r in rows.values()} == {699, None} and sum(r.record_type == "revisit" for r in rows.values()) == 699
