from collections import defaultdict

import xxhash

from lumentrack.llm import simhash

DOCS = "/root/testdata/sf0.001/documents.parquet"


def brute(rows):
    prints = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in w).split(" ") if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids, root = sorted(prints), {d: d for d in prints}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def got(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    assert got(simhash.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", None), (4, "a b", "x"), (5, "A  B", "x"), (6, "word " * 70000, "x"), (6, "word " * 70000, "x")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert out.count() == 7
    assert got(out) == brute([r[:2] for r in rows])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_buckets_match_small(spark):
    base = 0x1234567890ABCDEF
    values = [base ^ (1 << i) ^ (1 << j) for i in range(0, 30) for j in range(i, 30)] + [base ^ (0b111 << k) for k in range(40)]
    values = sorted({simhash._signed(v) for v in values})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    def classes(edges):
        root = {v: v for v in values}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
            root[find(a)] = find(b)
        out = defaultdict(set)
        for v in values:
            out[find(v)].add(v)
        return sorted(map(sorted, out.values()))
    every = [(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    pairs = [tuple(r) for r in simhash.links(df, bucket=10**6).collect()]
    assert sorted(pairs) == sorted(every)
    assert classes([tuple(r) for r in simhash.links(df, bucket=2).collect()]) == classes(every)
