import hashlib
import random

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from lumentrack.llm import bytebpe

TREE = bytebpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
PIECES = st.lists(st.sampled_from(["a", "word", "'s", "'", "'ll", " ", "  ", "\n", "\t ", "12", "9", "é", "ß", "?!", "…", "　", "日本", "é", "🙂", "<|endoftext|>"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_tree_equals_library(text, leaf):
    ids = TREE.encode(text, leaf)
    assert ids == TREE.bpe.encode_ordinary(text)
    assert TREE.decode(ids, leaf) == text.encode()


BLANKS = ["a", "word", "'s", "'ll", " ", "  ", "\n", "\r\n", "\r", "\x85", "\u00a0", "\u2003", "\u2009", " \u00a0", "\u00a0 ", "12", "?!", "中", "é", "🙂"]


def test_mixed_white_space():
    """Runs of mixed white space across every boundary: ids, not only the decoded text, equal the library's."""
    rng = random.Random(11)
    for n in range(10_000):
        text = "".join(rng.choices(BLANKS, k=rng.randint(1, 40)))
        assert TREE.encode(text, n % 9 + 1) == TREE.bpe.encode_ordinary(text), repr(text)
    for gap in (" \u00a0", "\n \u00a0", "\u2003\r\n", "\x85 \u2009", " \u00a0 "):
        for _ in range(40):
            text = gap.join("".join(rng.choices(["ab", " ", "cde ", "f.", "12 "], k=rng.randint(5, 60))) for _ in range(60))
            assert TREE.encode(text) == TREE.bpe.encode_ordinary(text)


def test_checked(spark):
    texts = [None, "", "a", "a", "x \u00a0y\r\n" * 3000]
    df = spark.createDataFrame([(i // 2, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    got = sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in bytebpe.encode_checked(df).collect())
    assert got == sorted((i // 2, len(e), tuple(e)) for i, t in enumerate(texts) for e in [TREE.bpe.encode_ordinary(t or "")])
    assert bytebpe.encode_checked(df.limit(0)).count() == 0


def test_long_texts():
    rng = random.Random(5)
    for text in ("x" * 20000, " " * 9000 + "a", "ab " * 9000, "\n \n" * 5000, "".join(rng.choice("ab'sl 12\n.é") for _ in range(30000))):
        assert TREE.encode(text) == TREE.bpe.encode_ordinary(text)


def test_rows(spark):
    texts = [None, "", "hello world", "hello world", "été " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for r in bytebpe.round_trip(df).collect():
        ids = TREE.bpe.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.content).decode() for r in bytebpe.decode(bytebpe.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bytebpe.round_trip(df.limit(0)).count() == 0
