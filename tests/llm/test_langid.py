import random

from lumentrack.llm import langid


def longest(text, known):
    n = 0
    while n < len(text) and text[: n + 1] in known:
        n += 1
    return max(1, n)


def test_phrases_equal_brute_force():
    a, b = "the cat sat on the mat and the hat", "le chat est sur le tapis et la table"
    parser = langid._parser((("en", a), ("fr", b)))
    key = lambda t: "".join(chr(65 + c) for c in parser.encode(t))
    rng = random.Random(3)
    texts = ["the hat sat", "le tapis, LA TABLE", "", "zzz 12", "the chat " * 400, "x" * 3000, (a + " ") * 90, a[3:] * 40 + b * 40, "".join(rng.choice("theca sol") for _ in range(5000))]
    for block in (7, 512):
        langid.BLOCK = block
        for t, got in zip(texts, parser.phrases(texts).tolist(), strict=True):
            for known, n in zip((key(a), key(b)), got, strict=True):
                want, rest = 0, key(t)
                while rest:
                    rest = rest[longest(rest, known) :]
                    want += 1
                assert n == want, (t[:40], n, want)


def test_every_letter_counts():
    han = [("aa", "".join(chr(0x4E00 + 3 * k) for k in range(900))), ("bb", "".join(chr(0x4E00 + 3 * k + 1) for k in range(900)))]
    parser = langid._parser((*han, ("en", "some plain words of english text " * 20)))
    assert [x for x, _ in parser.predict([han[1][1][200:260], han[0][1][700:], "plain words", "\U00020000\U00031350 text of words"])] == ["bb", "aa", "en", "en"]


def test_phrases_are_normalised():
    """A language with a tenth of the text isn't at a disadvantage where both need phrases in proportion to what they know."""
    rng = random.Random(5)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    parser = langid._parser((("big", make("abcdefgh", 20000)), ("small", make("efghijkl", 1500))))
    answers = [x for x, _ in parser.predict([make("efghijkl", 400) for _ in range(20)])]
    assert answers.count("small") == 20


def test_long_rows_don_t_fill_the_model(spark):
    rows = [(4 * k, "english words are here" if k else "one long text " * 20000, "en") for k in range(40)]
    (lang, text), = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=20000)
    assert lang == "en" and "english words are here" in text and "one long text" in text and len(text) < 20000 + 200


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.99 * len(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "hello the", "en"), (3, "bonjour le", "fr"), (4, None, "en"), (7, "", None), (9, "12 !?", "en"), (None, "the hello", "en"), (9, "le " * 40000, None)], "doc_id long, text string, lang string").selectExpr("*", "1.0D AS score")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()]
    assert len(got) == 7 and {(4, "und"), (7, "und"), (9, "und"), (9, "fr"), (None, "en")} <= set(got)
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
