"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Each rule looks at one property of a text and votes good (1), bad (-1) or abstains (0); several
rules look at one property with graded thresholds, so they overlap and some are wrong often. The
label model takes votes as independent given the hidden quality and abstentions as saying nothing; each rule
has a rate of bad votes on good and on bad documents. Expectation-maximisation estimates these
and the share of good documents, from the same start for every rule, on the counts of vote patterns over all documents that the base
rules leave open, a table of at most 3^12 rows whatever the corpus. The posterior probability of good quality then
replaces the all-must-pass rule: one bad vote of a rule that good documents often fail doesn't
condemn a document. DataFrame functions only; plain arithmetic on the pattern
counts at the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, materialise, words_of

WINDOW = 5


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and n_lines, n_distinct, n_upper, n_stops, n_digits (long).

    Null texts count as empty. Windows are compared by 64-bit hashes of their words. Sorting
    the windows that repeat makes the cost of a text n log n, whatever repeats in it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    w = docs.select("doc_id", held(t=text, words=words_of(F.col("text"))))
    n = F.size("words")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)]))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = w.select("doc_id", "t", "words", held(windows=F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")), lines=lines))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda x, i: F.named_struct(F.lit("x"), x, F.lit("i"), i)))
    kept = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")
    counts = {
        "n_words": n.cast("long"),
        "word_chars": kept(r"[\x20\x09-\x0D]++"),
        "n_symbols": kept(r"[^#*$%&|<>]++"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_distinct": F.size(F.array_distinct("words")).cast("long"),
        "n_upper": kept(r"[^\p{Lu}]++"),
        "n_stops": kept(r"[^.!?]++"),
        "n_digits": kept(r"[^0-9]++"),
    }
    w = w.select("doc_id", held(**counts), F.when(repeats, placed).alias("p")).select("doc_id", *counts, held(p=F.col("p")))
    again = F.filter("p", lambda e, j: F.coalesce(e["x"] == F.get("p", j - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get("p", j + 1)["x"], F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    start = F.named_struct(F.lit("last"), F.lit(-WINDOW), F.lit("n"), F.lit(0))
    covered = F.aggregate(starts, start, lambda a, i: F.named_struct(F.lit("last"), i, F.lit("n"), a["n"] + F.least(F.lit(WINDOW), i - a["last"])), lambda a: a["n"])
    return w.select("doc_id", *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rule_votes() -> dict[str, Column]:
    """Votes 1, -1 or 0 by rule name."""
    n = F.col("n_words")
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    per = lambda c, m: F.col(c) / F.greatest(F.col(m), F.lit(1))
    symbols, letters, caps, stops = per("n_symbols", "n_words"), per("word_chars", "n_words"), per("n_upper", "word_chars"), per("n_stops", "n_words")
    return {
        "length": vote(n < 25, n >= 60),
        "word_length": vote((letters < 3.8) | (letters > 7), letters.between(4.4, 6.4)),
        "word_length_wide": vote((letters < 2.5) | (letters > 12), letters.between(3.5, 9.0)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "symbol_share": vote(per("n_symbols", "word_chars") > 0.05, per("n_symbols", "word_chars") < 0.002),
        "dup_lines": vote(per("n_dup_lines", "n_lines") > 0.3, per("n_dup_lines", "n_lines") < 0.05),
        "repeats": vote(per("n_repeat_words", "n_words") > 0.1, per("n_repeat_words", "n_words") < 0.02),
        "variety": vote(per("n_distinct", "n_words") < 0.45, per("n_distinct", "n_words") > 0.6),
        "capitals": vote(caps > 0.3, caps < 0.06),
        "capitals_strict": vote(caps > 0.1, caps < 0.03),
        "sentences": vote((n >= 20) & ((stops > 0.5) | (stops < 0.01)), stops.between(0.03, 0.25)),
        "digits": vote(per("n_digits", "word_chars") > 0.1, per("n_digits", "word_chars") < 0.02),
    }


#: Where EM starts, alike for all rules: the share of good documents, and the rates of bad votes on bad and on good ones.
START = (0.8, 0.4, 0.1)


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 500) -> tuple[float, list]:
    """(log odds of the prior, weights) by expectation-maximisation over (votes, count).

    weights[rule][vote + 1] is what the vote adds to the log odds of good quality: nothing if it
    abstains. Each rate starts from one bad vote in two, so none is 0 or 1; no patterns: even odds, no weights.
    """
    if not patterns:
        return 0.0, [[0.0] * 3 for _ in range(rules)]
    votes, n = np.array([p for p, _ in patterns]).reshape(-1, rules), np.array([c for _, c in patterns], dtype=float)
    bad, good = (votes < 0).astype(float), (votes > 0).astype(float)
    prior = math.log(START[0] / (1 - START[0]))
    rates = np.array([[START[1]] * rules, [START[2]] * rules])  # of bad votes: on bad documents, on good ones
    for _ in range(rounds):
        weights = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        p = 1 / (1 + np.exp(-np.clip(prior + bad @ weights[0] + good @ weights[1], -500, 500)))
        new = np.array([((m @ bad) + 1) / (m @ (bad + good) + 2) for m in ((1 - p) * n, p * n)])
        share, moved = (p @ n + 1) / (n.sum() + 2), np.abs(new - rates).max()
        prior, rates = math.log(share / (1 - share)), new
        if moved < 1e-9:
            break
    return prior, [[float(a), 0.0, float(b)] for a, b in zip(np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0])), strict=True)]


def posterior(votes: tuple[int, ...], prior: float, weights: list) -> float:
    """Probability of good quality given the votes."""
    z = prior + sum(w[v + 1] for v, w in zip(votes, weights, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def quality_rules(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row: doc_id, the counts of ``features``, base_failed, posterior, kept.

    base_failed: fewer than 10 words, or over a fifth of the words repeated. kept: false if
    base_failed, else whether the posterior is ``least`` or more. Null and empty texts fail.
    An empty table gives no rows; repeated rows are judged alike, and a posterior of exactly
    ``least`` keeps; texts of any length are read whole; other columns are not read, whatever
    their names.
    """
    votes = rule_votes()
    seen = materialise(features(docs).select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()]), "rules")
    names = [f"vote_{k}" for k in votes]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    patterns = [(tuple(r[:-1]), r[-1]) for r in seen.where(~failed).groupBy(*names).agg(F.count("*")).collect()]  # at most 3^12 rows
    prior, weights = fit(patterns, len(names))
    z = F.lit(prior)
    for name, w in zip(names, weights, strict=True):
        z = z + F.when(F.col(name) < 0, w[0]).when(F.col(name) > 0, w[2]).otherwise(w[1])
    out = seen.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop(*names)
