import math
import random
import re
from collections import Counter

from lumentrack.llm import rules


def brute(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cov = Counter(win), set()
    for i, x in enumerate(win):
        if count[x] > 1:
            cov.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w))


def test_counts(spark):
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "x\nx\n\n \ny é $$ & |", "a " * 30000, "q w e r t y u i o p q w e r t y", "a\x0bb\x0cc\rd\x1ce f   g", "\n".join(["same line"] * 4)]
    texts += [" ".join(f"w{i}" for i in range(n)) + " " + " ".join(f"w{i}" for i in range(m)) for n, m in ((100, 6), (50, 20), (8, 8))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.quality_rules(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in rows) >= 0.97 * len(rows)


def test_em_finds_a_weak_rule():
    patterns = [((1, 1, 1), 900), ((-1, 1, 1), 40), ((-1, -1, 1), 40), ((1, 0, -1), 10)]
    prior, weights = rules.fit(patterns, 3)
    assert rules.posterior((1, 1, 1), prior, weights) > 0.5 > rules.posterior((-1, -1, 1), prior, weights)
    assert rules.posterior((0, 0, 0), *rules.fit([], 3)) == 0.5


def planted(n, prior, rates, cover, seed=7):
    """Vote patterns of documents whose quality is known: rates of bad votes on (bad, good) documents, share of votes cast."""
    rng, found = random.Random(seed), Counter()
    for _ in range(n):
        good = rng.random() < prior
        found[tuple(0 if rng.random() > c else -1 if rng.random() < r[good] else 1 for r, c in zip(rates, cover)), good] += 1
    return found


RATES = ((0.7, 0.02), (0.6, 0.10), (0.8, 0.30), (0.5, 0.01), (0.55, 0.45), (0.9, 0.05))


def test_em_recovers_planted_accuracies():
    found = planted(40000, 0.85, RATES, (0.9, 0.8, 1.0, 0.7, 0.9, 0.6))
    counts = Counter()
    for (v, _), c in found.items():
        counts[v] += c
    prior, weights = rules.fit(list(counts.items()), 6)
    assert abs(1 / (1 + math.exp(-prior)) - 0.85) < 0.03
    for (bad, good), (w_bad, none, w_good) in zip(RATES, weights, strict=True):
        assert none == 0 and abs(w_bad - math.log(good / bad)) < 0.3 and abs(w_good - math.log((1 - good) / (1 - bad))) < 0.3
    right = sum(c for (v, good), c in found.items() if (rules.posterior(v, prior, weights) >= 0.5) == good)
    strict = sum(c for (v, good), c in found.items() if (min(v) >= 0) == good)
    assert right > 0.93 * 40000 > strict


def test_fit_equals_scalar_em():
    counts = Counter()
    for (v, _), c in planted(3000, 0.7, RATES[:3], (0.9, 0.9, 0.9)).items():
        counts[v] += c
    prior, bad, good = 0.8, [0.4] * 3, [0.1] * 3
    for _ in range(500):
        sums, total = [[1.0, 2.0, 1.0, 2.0] for _ in range(3)], 0.0
        for v, c in counts.items():
            g, b = prior, 1 - prior
            for j, x in enumerate(v):
                if x:
                    g, b = g * (good[j] if x < 0 else 1 - good[j]), b * (bad[j] if x < 0 else 1 - bad[j])
            p = g / (g + b)
            total += p * c
            for j, x in enumerate(v):
                if x:
                    sums[j] = [sums[j][0] + (x < 0) * (1 - p) * c, sums[j][1] + (1 - p) * c, sums[j][2] + (x < 0) * p * c, sums[j][3] + p * c]
        prior = (total + 1) / (sum(counts.values()) + 2)
        bad, good = [x[0] / x[1] for x in sums], [x[2] / x[3] for x in sums]
    got = rules.fit(list(counts.items()), 3)
    for v in counts:
        g, b = prior, 1 - prior
        for j, x in enumerate(v):
            if x:
                g, b = g * (good[j] if x < 0 else 1 - good[j]), b * (bad[j] if x < 0 else 1 - bad[j])
        assert abs(rules.posterior(v, *got) - g / (g + b)) < 1e-5


def test_verdicts_are_not_all_must_pass(spark):
    """On the given documents the posterior keeps some that a rule votes against, and is nearer to the labels than all-must-pass."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    votes = rules.features(docs).select("doc_id", F.least(*rules.rule_votes().values()).alias("worst"))
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = rules.quality_rules(docs).where("NOT base_failed").join(votes, "doc_id").join(labels, "doc_id", "left").collect()
    assert sum(r.kept and r.worst < 0 for r in rows) > 50 and any(not r.kept for r in rows)
    known = [r for r in rows if r.quality is not None]
    assert sum(r.kept == (r.quality == 1) for r in known) > max(0.99 * len(known), sum((r.worst >= 0) == (r.quality == 1) for r in known))
