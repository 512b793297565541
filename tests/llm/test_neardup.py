import random

from lumentrack.llm import neardup, simhash

DOCS = "/root/testdata/sf0.01/documents.parquet"


def shingles(text):
    w = "".join(" " if c in "\t\n\v\f\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute(rows):
    """Least doc_id of each component under Jaccard >= 0.8 on five-word shingles, all pairs compared."""
    every = {d: shingles(t) for d, t in rows}
    ids, root = sorted(every), {d: d for d in every}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = every[a], every[b]
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * (s := len(x & y)) >= 4 * (len(x) + len(y) - s)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in neardup.near_texts(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want.values()))


def test_large_groups(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"x{rng.random()}" if rng.random() < rng.choice([0.005, 0.03]) else w for w in base)) for i in range(120)]
    rows += [(200 + i, " ".join([*base[:20], *(f"y{i}-{k}" for k in range(30))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for bucket in (2, 32, 10**6):
        assert {r.doc_id: r.component_id for r in neardup.near_texts(df, bucket=bucket).collect()} == want


def test_near_copies_go(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = [*words[:50], "other", *words[51:]], [*words[:30], *(f"v{i}" for i in range(70))]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(near))).bit_count() > 2
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3]
