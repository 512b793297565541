import hashlib
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumentrack.llm import bpedfa
from lumentrack.llm.queries import QUERIES

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
CODEC = bpedfa.codec(PATH)
PIECES = st.lists(st.sampled_from(["a", "word", "The", "'s", "'LL", " ", "\n", " ", " ", "12", "9", "é", "É", "ß", "İ", "?!", "…", "日本", "🙂", "<|endoftext|>", "<|", "</w>", "aaaa", "ing", "tion", "\x1f", "\x85"]), max_size=40).map("".join)


def plain_bpe(word, merges, end):
    """The merges one by one, from the left, over the whole word."""
    parts = [*word[:-1], word[-1] + end]
    for u, v in merges:
        out, i = [], 0
        while i < len(parts):
            if parts[i] == u and i + 1 < len(parts) and parts[i + 1] == v:
                out.append(u + v)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_random_merges(data):
    parts, merges = ["a", "b", "a$", "b$"], []
    for _ in range(data.draw(st.integers(0, 12))):
        u, v = data.draw(st.sampled_from([p for p in parts if not p.endswith("$")])), data.draw(st.sampled_from(parts))
        if u + v not in parts:
            merges.append((u, v))
            parts.append(u + v)
    automaton = bpedfa.Automaton({p: i for i, p in enumerate(parts)}, merges, "$")
    for word in [data.draw(st.text("ab", min_size=1, max_size=30)), "a" * 17, "ab" * 8]:
        ids = automaton.encode(word)
        assert automaton.decode(ids) == plain_bpe(word, merges, "$")
        assert automaton.accepts(ids)
        other = automaton.encode(word[:1]) + automaton.encode(word[1:]) if len(word) > 1 else ids
        assert automaton.accepts(other) == (other == ids)


def test_one_path():
    """Every place of a word is reached by one token sequence only."""
    a = CODEC.automaton
    word = "antidisestablishmentarianismsssss"
    reached = {0: [[]]}
    for i in range(len(word)):
        for path in reached.get(i, []):
            for k in range(i + 1, len(word)):
                t = LIBRARY.token_to_id(word[i:k])
                if t is not None and a.allows(a.after[path[-1]] if path else a.start, t):
                    reached.setdefault(k, []).append([*path, t])
    assert all(len(v) == 1 for v in reached.values()) and len(reached) == len(word)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_equals_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert CODEC._split(text) == ids


def test_long_words():
    rng = random.Random(3)
    for text in ("x" * 20000, "".join(rng.choice("abcdefghij") for _ in range(20000)), "ha" * 9000 + " " + "!" * 5000):
        assert CODEC.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows(spark):
    texts = [None, "", "    ", "hello World", "hello World", "été 12's <|endoftext|>x " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpedfa.round_trip(df).collect()} == {i: expected(t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in bpedfa.decode(bpedfa.encode(df)).collect()}
    assert hashlib.sha256(back[5].encode()).hexdigest() == expected(texts[5])[2] and back[0] == back[1] == back[2] == ""
    assert bpedfa.round_trip(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_bpe_automaton"](spark, d).collect()}
    assert got == {k: expected(t) for k, t in texts.items()}


def test_order_of_merges():
    with pytest.raises(ValueError):
        bpedfa.Automaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_all_words_at_once(data):
    """Many words give what each gives by itself, with a mark of the end and without; characters that no token has are an error."""
    end = data.draw(st.sampled_from(["$", ""]))
    parts, merges = sorted({"a", "b", "a" + end, "b" + end}), []
    for _ in range(data.draw(st.integers(0, 12))):
        u, v = data.draw(st.sampled_from([p for p in parts if not (end and p.endswith(end))])), data.draw(st.sampled_from(parts))
        if u + v not in parts:
            merges.append((u, v))
            parts.append(u + v)
    automaton = bpedfa.Automaton({p: i for i, p in enumerate(parts)}, merges, end)
    words = data.draw(st.lists(st.text("ab", max_size=20), max_size=20))
    assert automaton.encode_all(words) == [automaton.encode(w) for w in words]
    with pytest.raises(ValueError):
        automaton.encode_all([*words, "abca"])


def test_new_words_are_encoded_together(monkeypatch):
    """New words don't go one by one, in whatever texts they are, and however few are remembered or looked up at once."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéçABC"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ".", "'s", "!?7"])
    texts = ["", " ", *[" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(100)], "", "日本 \x85 <|endoftext|>x", "x" * 300, " ".join(word() for _ in range(3000))]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    for together, size in ((20_000, 400_000), (50, 400_000), (300, 40)):
        own = bpedfa.Codec(PATH, CODEC.automaton)
        own.words.size = own.pieces.size = size
        alone = []
        monkeypatch.setattr(bpedfa, "TOGETHER", together)
        monkeypatch.setattr(own.automaton, "encode", lambda w, alone=alone: alone.append(w) or bpedfa.Automaton.encode(CODEC.automaton, w))
        got = list(own.each(texts))
        assert [[int(i) for i in ids.split()] for _, ids, _ in got] == want and [n for n, _, _ in got] == list(map(len, want))
        assert [d.decode() for _, _, d in got] == [LIBRARY.decode(ids, skip_special_tokens=False) for ids in want]
        assert size < 1000 or len(alone) < 10


def test_one_codec_of_a_worker(spark):
    """Tasks get their codec by a function that is pickled by its name, so that it stays in the worker."""
    import pickle

    func = bpedfa._shared(spark, None).func
    assert pickle.loads(pickle.dumps(func)) is bpedfa._own
