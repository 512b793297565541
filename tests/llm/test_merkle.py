import zlib
from hashlib import sha256

import duckdb
import pytest

from lumentrack.llm import merkle
from lumentrack.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def row_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def up(nodes):
    """(root, for each node its steps as (position in its run, the run))."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for proof, p in zip(proofs, places, strict=True):
            proof.append((p % 3, runs[p // 3]))
        places = [p // 3 for p in places]
        nodes = [h(*r) for r in runs]
    return nodes[0], proofs


def expected(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    sources, out = {}, []
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(((r[0], row_leaf(*r), r) for r in sources[s]), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in order}
    built = {s: up([x[1] for x in t]) for s, t in trees.items()}
    root, tops = up([built[s][0] for s in order])
    for s, top in zip(order, tops, strict=True):
        for (doc_id, own, r), proof in zip(trees[s], built[s][1], strict=True):
            node = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r[1] is not None:
                node = row_leaf(r[0], r[1].replace("\n", ""), *r[2:])
            steps = proof + top
            siblings = [x for at, run in steps for k, x in enumerate(run) if k != at]
            for at, run in steps:
                node = h(*run[:at], node, *run[at + 1 :])
            out.append((doc_id, own, built[s][0], root, h(*siblings), node, node == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    df = QUERIES["op12_merkle_manifest"](spark, d)
    sql = sorted(duckdb.sql(ORACLE_SQL["op12_merkle_manifest"]).select(*df.columns).fetchall(), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got(df) == sql == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_small_trees(spark, n):
    rows = [(k, f"a\nb{k}", "en", "s", 3) for k in range(n)]
    assert got(merkle.check_tampering(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_many_blocks(spark):
    """A source of several blocks over many tasks, others of exactly one block and one more row, and many of one row."""
    rows = [(k, f"t{k}\n", None, "hot", k) for k in range(5200)] + [(k, "x", "de", "one", 1) for k in range(merkle.BLOCK)] + [(k, "\n", "de", "more", 1) for k in range(merkle.BLOCK + 1)]
    rows += [(k, "y", "fr", f"s{k}", 1) for k in range(2400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(merkle.check_tampering(df)) == expected(rows)


def test_edges(spark):
    rows = [
        (None, "no\nid", "en", "a", 1), (None, None, None, None, None), (5, "é\n" * 3, "fr", "é", 6), (5, "é\n" * 3, "fr", "é", 6), (5, "other", "fr", "é", 6), (7, "", "", "", 0), (7, "", "", None, 0),
        (-3, "-", "-", "-", 1), (9, "long \n" * 100_000, "en", "a", 1), (10, "Z", "en", "Z", 1), (11, "\U0001f600", "en", "\U0001f600", 1), (12, "￮", "en", "￮", 1),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", leaf int, steps string")
    assert got(merkle.check_tampering(df)) == expected(rows)
    assert merkle.check_tampering(df.limit(0)).count() == 0
    clean = merkle.verify(merkle.manifest(df.select("doc_id", "source", merkle.leaf().alias("leaf"))))
    assert clean.where("not verified").count() == 0 and clean.count() == len(rows)
