import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumentrack.llm import pii

PARTS = st.lists(st.sampled_from(["a", "b.c", "@", ".", "x@y.z", "1", "12", "255", "256", "00", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "é", "\n", "_", "%", "1.2.3.4"]), max_size=25).map("".join)


def brute(text):
    """The patterns as the contract states them."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=1000, deadline=None)
@given(PARTS)
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_is_linear():
    for text in ("a" * 300000, "1" * 300000, "1." * 100000, "a@" * 100000, "+1(" * 100000, "1 " * 100000, "@" * 100000):
        pii.graph(text)


def made(seed, n):
    """Texts with mentions of every kind, some of them repeated, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        card = next(c for c in iter(lambda: "4" + digits(15), "") if pii._luhn(c))
        card = " ".join(card[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.5 else card
        decoy = next(c for c in iter(lambda: digits(16), "") if not pii._luhn(c))
        mentions = [card, f"+1 ({digits(3)}) 555-{digits(4)}", f"user{digits(2)}@mail{digits(1)}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.9.1", decoy, digits(8)]
        chosen = rng.sample(mentions, 3)
        chosen += rng.sample(chosen, 1)
        rng.shuffle(chosen)
        out.append(" ".join(f"some words of text {m} and more of it," for m in chosen))
    return out


def fitted(texts):
    total = Counter()
    for t in texts:
        total.update(pii.examples(t))
    return pii.Field([(*k, n) for k, n in total.items()])


FIELD = fitted(made(1, 300))


def test_hidden_mentions_are_found():
    """Known mentions with a part hidden, beside a twin: what the messages recover, and what they add besides."""
    hits = misses = wrong = 0
    for text in made(2, 300):
        base = pii.base_spans(text)
        if not base:
            continue
        kind, lo, hi = base[0]
        for form in pii.hidden(kind, text[lo:hi]):
            longer = f"{text} again {form} it says"
            at = len(text) + 7
            own, every = FIELD.spans(longer)
            added = set(every) - set(own)
            hit = any(k == kind and a < at + len(form) and at < b for k, a, b in every)
            hits, misses = hits + hit, misses + (not hit)
            wrong += sum(not (a < at + len(form) and at < b) for _, a, b in added)
    assert hits >= 0.9 * (hits + misses) and wrong <= 0.02 * hits, (hits, misses, wrong)


def test_mentions_beside_others():
    """Numbers that a pattern takes for one are told apart by their shapes."""
    text = "call +1 (826) 555-4081 190.137.223.204 now, pay 4111111111111111 7536784127813051 soon"
    base, every = FIELD.spans(text)
    assert [k for k, *_ in base] == ["ip"]
    assert {(k, text[a:b]) for k, a, b in every} == {("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081"), ("card", "4111111111111111")}


def enumerated(field, shapes, clamped, chain, skips, known):
    """Exact label probabilities by all assignments: known are hubs' labels, None for a hub of candidates."""
    n, total = len(shapes), np.zeros((len(shapes), 5))
    free = [h for h, k in enumerate(known) if k is None]
    for labels in itertools.product(range(5), repeat=n + len(free)):
        hub = {h: labels[n + i] for i, h in enumerate(free)}
        if any(c and labels[i] != pii.LABELS.index(c) for i, c in enumerate(clamped)):
            continue
        z = sum(field.node[s][labels[i]] for i, s in enumerate(shapes) if not clamped[i])
        z += sum(field.pair["chain"][labels[a], labels[b]] for a, b in chain)
        z += sum(field.pair["skip"][pii.LABELS.index(known[h]) if known[h] else hub[h], labels[k]] for h, k in skips)
        for i in range(n):
            total[i, labels[i]] += math.exp(z)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_equal_enumeration():
    shapes = ["16", "4-4-4-4!", "1-3-3-4(", "16"]
    nodes = [("", 0, 1), ("card", 2, 3), ("", 4, 5), ("", 6, 7)]
    clamped = [x[0] for x in nodes]
    for chain, skips, known, loops in (
        ([(0, 1), (1, 2), (2, 3)], [], [], False), ([(0, 1)], [(0, 3)], ["card"], False), ([], [(0, 0), (0, 3)], [None], False),
        ([(0, 1), (2, 3)], [(0, 0), (0, 2)], [None], False), ([(0, 1), (1, 2), (2, 3)], [(0, 0), (0, 2), (0, 3)], [None], True),
    ):
        hubs = [Counter({k: 1} if k else {}) for k in known]
        got = FIELD.posteriors(nodes, shapes, [(a, b, "chain") for a, b in chain], (hubs, skips, [1] * 4))
        want = enumerated(FIELD, shapes, clamped, chain, skips, known)
        assert np.abs(got - want).max() < (0.05 if loops else 1e-3)


def test_spans_are_added_on_documents(spark):
    """On the given documents some mentions are added, and only with the digits of a card or phone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    added = []
    for r in pii.find(docs).collect():
        base = {f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id] or "")}
        for span in set(filter(None, r.spans.split(","))) - base:
            k, a, b = span.split(":")
            added.append((k, (texts[r.doc_id] or "")[int(a) : int(b)]))
    assert added
    sound = [k == "email" or (k == "card" and pii._luhn(pii._digits(m))) or (k == "phone" and 10 <= len(pii._digits(m)) <= 15) for k, m in added]
    assert sum(sound) >= 0.9 * len(added)


def test_precision_on_documents(spark):
    """With the field fitted on the given documents: dates, order numbers, ISBNs and local phone numbers planted in them stay, repeats of personal data are found."""
    field = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text and len(r.text) < 20_000]
    rng = random.Random(8)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    wrong = added = hits = total = 0
    for text in texts[:400]:
        plain = ["20240117", f"2024-01-17 12:{d(2)}", f"order {d(rng.randint(7, 13))}", f"ISBN 978{d(10)}", f"ISBN 978-3-16-{d(6)}-{d(1)}", f"0170 {d(7)}", f"(030) {d(8)}", f"no. {d(4)}-{d(4)}-{d(4)}", f"{d(3)} 120 130 140", "meet at noon.today", f"{d(16)}"]
        longer = text + "".join(f" see {m} here." for m in rng.sample(plain, 6))
        own, every = field.spans(longer)
        wrong += len({s for s in set(every) - set(own) if s[1] >= len(text)})
        card = next(c for c in iter(lambda: "4" + d(15), "") if pii._luhn(c))
        kind, mention = rng.choice([("card", card), ("phone", f"+1 ({d(3)}) 555-{d(4)}"), ("email", f"user{d(2)}@mail{d(1)}.example.com"), ("ip", f"19{d(1)}.1{d(2)}.9.{rng.randrange(256)}")])
        for form in pii.hidden(kind, mention):
            planted = f"{text} reach {mention} or. And later {form} it says"
            at = planted.rindex(form)
            own, every = field.spans(planted)
            found = [s for s in every if s[0] == kind and at <= s[1] and s[2] <= at + len(form)]
            hits, total, added = hits + bool(found), total + 1, added + len([s for s in set(every) - set(own) if s[1] >= len(text)])
    assert hits >= 0.9 * total, (hits, total)
    assert wrong <= 0.05 * added, (wrong, added)
    for text in ("Order 20240117 shipped.", "ISBN 9783161484100", "dial 0170 1234567", "look at this.example today"):
        assert field.spans(text)[1] == [], text
    for text in ("jane (at) site dot org", "write to jane (at) site.org", "jane at site dot org"):
        assert [k for k, *_ in field.spans(text)[1]] == ["email"], text


def test_no_length_is_too_long():
    text = "see " + "x" * 200 + "@" + "y" * 400 + " and 12345678"
    assert pii.candidates(text, pii.base_spans(text)) == [(4, 605), (610, 618)]


def test_repeated_mentions_agree():
    text = "card 4111 1111 1111 1111 and far away 4111 1111 1111 1112, phone +1 (017) 555-7713 or 1 (017) 555-7713; id 9876543210987654"
    base, every = FIELD.spans(text)
    assert base == brute(text) and set(base) < set(every)
    added = {text[lo:hi]: k for k, lo, hi in set(every) - set(base)}
    assert added == {"4111 1111 1111 1112": "card", "1 (017) 555-7713": "phone"}
    assert FIELD.spans("plain 9876543210987654 and 1234567")[1] == []


def test_rows(spark):
    texts = [None, "", "none here", "mail a.b@c.de x", "ip 1.2.3.4, 999.1.1.1", "mail a.b@c.de x"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.find(df).collect():
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in want).split(",")) <= set(r.spans.split(","))
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == [None, "", "none here", "mail [EMAIL] x", "ip [IP], 999.1.1.1", "mail [EMAIL] x"]
    assert pii.find(df.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.KINDS)


def test_many_repeats():
    phones = ["1 (017) 555-7713", "1-017-555-7713", "1 017 555 7713"]
    for m in (1, 2, 3, 50):
        repeats = [phones[k % 3] for k in range(m)]
        for text in (" and once more, ".join(["+1 (017) 555-7713", *repeats]), " and once more, ".join([*repeats, "+1 (017) 555-7713"])):
            assert [k for k, *_ in FIELD.spans(text)[1]] == ["phone"] * (m + 1)
        for typos in (["4111 1111 1111 1112"] * m, [f"4111 1111 11{k:02} 1119" if not pii._luhn(f"41111111{11}{k:02}1119") else f"4111 1111 11{k:02} 1118" for k in range(m)]):
            text = " and once more, ".join(["4111 1111 1111 1111", *typos])
            assert [k for k, *_ in FIELD.spans(text)[1]] == ["card"] * (m + 1)
        assert FIELD.spans(" and once more, ".join(["9876543210987654", "1234567"] * m))[1] == []
