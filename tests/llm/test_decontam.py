import random
import re

from lumentrack.llm import decontam

SCHEMA = "doc_id long, text string, item_id string"


def brute(docs, items, threshold=0.8, k=5):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    def grams(w, n):
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for i, t in items:
        w = words(t)
        n = min(k, len(w))
        if n:
            g = grams(w, n)
            for d, text in docs:
                s = len(g & grams(words(text), n))
                if s / len(g) >= threshold:
                    out.add((d, i, s, len(g)))
    return out


def test_containment(spark):
    item = " ".join(f"w{i}" for i in range(30))
    near = item.replace("w29", "x").replace("w28", "y")
    half = " ".join(f"w{i}" for i in range(15))
    docs = [(1, "a b " + item.upper() + " c", "q"), (2, "z, " + near, "q"), (3, half, None), (4, None, "q"), (5, "", "q"), (6, ("filler " * 3000) + item, "q"), (1, "a b " + item, "q"), (7, "alpha beta", "q"), (8, "beta alpha", "q"), (9, item.replace(" ", "\n-- "), "q")]
    items = [(10, item), (11, "alpha beta"), (12, None), (13, "..."), (14, half), (15, "one")]
    d, i = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = brute([r[:2] for r in docs], items)
    for rows in (10**6, 0):
        got = [(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in decontam.contained(d, i, broadcast_rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert decontam.contained(d.limit(0), i).count() == 0
    assert decontam.contained(d, i.limit(0)).count() == 0


def test_long_documents_and_size_partitions(spark):
    """Texts of 20,000 words, items of many sizes, by the broadcast and by the shuffle path."""
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in (1, 2, 4, 5, 6, 9, 20, 70, 300, 1200)]
    docs = []
    for d in range(6):
        words = [word() for _ in range(20000)]
        for n, t in items[2 + d % 3 :: 3]:
            own = t.split()
            if d % 2 and n > 20:
                own[0] = "changed"
            at = rng.randrange(19000)
            words[at : at + n] = own
        docs.append((d, " ".join(words), None))
    docs += [(10 + n, t, None) for n, t in items] + [(None, items[6][1], None), (None, None, "x")]
    d, i = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*items, (20, items[7][1]), (None, items[6][1])], "item_id long, text string")
    want = brute([r[:2] for r in docs], [*items, (20, items[7][1]), (None, items[6][1])])
    want = {max((x for x in want if x[:2] == pair), key=lambda x: (x[2] / x[3], x[3])) for pair in {x[:2] for x in want}}
    for rows in (10**6, 0):
        got = [(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in decontam.contained(d, i, broadcast_rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_text_is_joined_to_sketches(spark):
    """What a probe carries to the join are ids, sizes and a hash."""
    d = spark.createDataFrame([(1, "a b c d e f g", "q")], SCHEMA)
    found = decontam.sketches(decontam.shingled(spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"), 0.8, 5))
    plan = decontam.hits(d, found, 0)._jdf.queryExecution().optimizedPlan().toString()
    under = [line for line in plan[plan.index("Join") :].splitlines()[1:] if "Project" in line][0]
    sent = re.sub(r"xxhash64\(concat_ws\(.*?\), 42\)", "hash", under)
    assert "doc_id" in sent and "hash AS h" in sent and "words" not in sent and "shingles" not in sent
