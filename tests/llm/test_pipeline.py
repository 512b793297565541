import re

import corpus_pipeline
from lumentrack.llm import bytebpe, common, decontam, pii, quality, simhash
from tests.llm.test_neardup import brute

D = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.table(spark, D, "documents")
    steps = [docs]
    for _, f in corpus_pipeline.STAGES:
        steps.append(common.materialise(f(spark, steps[-1], D), "test"))
    for df in steps[1:-1]:
        assert df.columns == docs.columns
    rows = [{r.doc_id: r for r in df.collect()} for df in steps]
    assert all(len(r) == df.count() for r, df in zip(rows, steps, strict=True))
    model = quality.fit(docs, common.table(spark, D, "labels"))
    assert set(rows[1]) == {d for d, r in rows[0].items() if model.score(quality.text_features(r.text)[None, :])[0] >= 0.7}
    kept = set(brute([(d, r.text) for d, r in rows[1].items()]).values())
    assert set(rows[2]) == kept
    def grams(t):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [grams(r.text) for r in common.table(spark, D, "benchmark").collect()]
    assert set(rows[3]) == {d for d, r in rows[2].items() if not any(len(g & grams(r.text)) >= 0.8 * len(g) for g in items)}
    assert set(rows[4]) == set(rows[3]) == set(rows[5])
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in rows[4].values())
    tree = bytebpe.codec(*bytebpe._paths(None, None))
    assert all(list(rows[5][d].ids) == tree.bpe.encode_ordinary(r.text) for d, r in rows[4].items())


def test_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "only null"), (None, "only null"), (5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (6, "alpha beta gamma delta"), (None, "alpha beta gamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS n", "2 AS fp", "3 AS _row", "4 AS n_chars")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 5]
    items = spark.createDataFrame([(1, "beta gamma delta")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontam.keep_clean(docs, items).collect()) == sorted(["1", "1", "2", "None", "None", "None"])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == quality.keep_good(docs, labels, least=0.5).count() == 9
    assert pii.redact(docs).count() == 9


def test_rows_are_judged_by_their_own_text(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey"
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, None), (8, ""), (9, b), (9, "own text of nine that is longer"), (9, "own text of nine that is longer")]
    df = spark.createDataFrame([(*r, "s", 0, "r") for r in rows], "doc_id long, text string, sig string, root int, _salt string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (None, c), (7, None), (9, "own text of nine that is longer")], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_every_stage_on_edges(spark):
    """Nulls in any column, empty and very long texts, repeated rows, further columns with clashing names, and an empty table."""
    long = "mail me at jane.doe@example.com or call. " * 40_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", None, "s", 10), (4, long, "en", "s", len(long)), (5, long + "end", "en", None, None), (6, "one two three", "en", "s", 13), (6, "one two three", "en", "s", 13), (7, " \n\t ", "", "", 4)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, sig int, ids string, score int")
    expected = {"quality_classifier": None, "near_dedup": 4, "decontamination": 8, "pii_masking": 8, "byte_bpe": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        got = out.collect()
        assert expected[name] is None or len(got) == expected[name], (name, len(got))
        assert name == "byte_bpe" or out.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.count() == 0 and empty.columns == out.columns, name
        if name == "pii_masking":
            masked = {r.doc_id: r for r in got}
            assert masked[1].text is None and masked[2].text == "" and masked[4].text == "mail me at [EMAIL] or call. " * 40_000 and masked[4].n_chars == len(masked[4].text)
        if name == "byte_bpe":
            tree = bytebpe.codec(*bytebpe._paths(None, None))
            assert {r.doc_id: r.n_tokens for r in got}[4] == len(tree.bpe.encode_ordinary(long)) and {r.doc_id: r.n_tokens for r in got}[1] == 0
