import json
import tempfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumentrack.llm import tokenstore as ts

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def lib_ids(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["Word", "it's", "'S", " ", "\n", "\x0b", "\x1c", "\x00", "ªº", "é", "É", "12", "!?", "<|endoftext|>", "<|EndOfText|>", "日本", "ΑΣ ", "İ", " ", "́", "µ", "×÷", "groß", "ß."]), st.text(max_size=4)), max_size=20).map("".join))
def test_ids_equal_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ts.encoder(PATH).encode(text), "<u2").tolist() == lib_ids(text)


def test_index():
    for n in (1, 2, 7, 5000):
        keys = [ts.key_bytes(i * 3, 0) for i in range(n)]
        h = np.array([ts._key_hash(k) for k in keys], dtype=np.uint64)
        shift, slots = ts.build_index(h)
        assert sorted(slots) == list(range(n)) and (ts.slot_of(h, shift, n) == slots).all()


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-5, ""), (7, "again"), (7, "again"), (None, "x"), (10**12, "Long word " * 30000)], "doc_id long, text string")
    df = docs.union(extra).selectExpr("*", "1 AS shard", "'p' AS path")
    got = sorted(((r.doc_id if r.doc_id is not None else -(10**9), r.start, r.n_tokens, r.ids_crc32) for r in ts.write_and_read(df).collect()))
    rows = sorted((r.doc_id if r.doc_id is not None else -(10**9), r.text) for r in df.collect() if r.doc_id != 7)
    ids = {d: [*lib_ids(t), 1] for d, t in rows}
    want, seen = {}, {d: (s, n, c) for d, s, n, c in got if d != 7}
    assert len(got) == df.count() and len([g for g in got if g[0] == 7]) == 3
    for d, x in ids.items():
        assert seen[d][1:] == (len(x), zlib.crc32(np.array(x, "<u4").tobytes())), d
    ends = 0
    for _, s, n, _ in sorted(got, key=lambda g: g[1]):
        assert s == ends
        ends = s + n
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == [g[0] for g in got] and want == {}
    places, shards, index = ts.store(df)
    keys = spark.createDataFrame([(-1, 0), (123456789, 0), (7, 2), (7, 3)], "doc_id long, number int")
    assert {(r.doc_id, r.number) for r in ts.look_up(keys, index).collect()} == {(-1, 0), (7, 2)}
    assert ts.write_and_read(df.limit(0)).count() == 0


def test_empty_parts_of_the_index(spark):
    """Where hashing leaves parts of the index without keys, the others are still found; a lost part is an error."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    folder = "file://" + tempfile.mkdtemp()
    places, shards, _ = ts.store(docs, folder=folder)
    index = ts.write_index(places, f"{folder}/small", keys=2)
    assert index.count() < index.first().parts == 20
    assert ts.look_up(places, index).count() == 40
    whole = ts.write_index
    ts.write_index = lambda places, folder: whole(places, folder, keys=2).limit(3)
    try:
        with pytest.raises(RuntimeError):
            ts.write_and_read(docs)
    finally:
        ts.write_index = whole


def test_other_patterns_encode_whole_texts(tmp_path):
    path = P.path("word_bpe_49k.json")
    made = json.load(open(path, encoding="utf-8"))
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[a-z]|[^a-z]+"}
    other = str(tmp_path / "other.json")
    json.dump(made, open(other, "w", encoding="utf-8"))
    assert ts.Encoder(path).by_word and not ts.Encoder(other).by_word
