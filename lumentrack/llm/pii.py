"""Personal data by a skip-chain conditional random field over base matches and candidates.

Base matches are exact patterns with checks (see ``base_spans``); they stay as they are. The
field's nodes are the base matches, clamped to their kind, and the candidates that no base match
overlaps: numbers of seven digits or more, also with their digits apart or next to others that a pattern took
for one number; words with an ``@``; addresses spelled with "at" and "dot". Its potentials:

- node: the mention's shape (the lengths of a number's groups, marks, checksum; an address's signs). A shape that was never
  seen with personal data stays none;
- chain: neighbours in the text with at most a few characters between them;
- skip: nodes of the same key wherever they are in the document. Keys are a node's letters and
  digits, its digits, and halves of long digit strings, so that a repeated mention with other
  punctuation, or with a mistyped digit, shares potentials with its twin. The mentions of a key
  meet in one hub, which keeps the number of links in proportion to the text; the hub of a key
  with base matches is clamped to their kinds, so that these inform every mention directly.
  Mentions that share a key share one mention's shape evidence: a repeat is no evidence of its own.

The potentials are fitted by pseudo-likelihood: each base match must be found again from its shape
and its neighbours' labels, as it is and with a part hidden (the plus sign, a digit, the signs of an address
or between digits). A form that is then like any number or sentence (digits without brackets, a plain "at") counts as no personal data
unless the mention itself is near to tell it. Candidates count as no personal data, but for those that share a key with a
base match, whose label isn't known. One pass over all documents counts the cases, a table that is small whatever
the corpus; the fit runs on the table.

Loopy sum-product messages run until they settle. A candidate whose likeliest label is a kind of
personal data becomes a span. Documents without a candidate need no messages.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().+-]{0,3}[0-9])*+")
_PART = re.compile(r"[^\x20]*[0-9][^\x20]*")
_AT_WORD = re.compile(r"(?<![^\s@])[^\s@]*+@[^\s@]*+")
_SPELLED = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[(\[]?(?:at|@)[)\]]?\x20?[a-z0-9-]++(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[a-z0-9-]++)+")
_BRACKETED, _DOT, _GROUP = re.compile(r"(?i)[(\[](?:at|@)[)\]]"), re.compile(r"(?i)[\x20(\[]dot[\x20)\]]"), re.compile("[0-9]+")
_SPELLING = re.compile(r"(?i)[\x20(\[](?:at|dot)[\x20)\]]")
#: Characters between neighbours in the chain; rounds and damping of the messages.
NEAR, ROUNDS, DAMP = 12, 60, 0.3
#: Weight, in the fit, of a base match as it is or hidden beside a twin; a case with a part hidden and no twin weighs one.
WHOLE = 10
#: Bound of the chain's log potentials: as candidates may be misses of the patterns, neighbours sway a label and don't decide it.
CHAIN = 1.0
#: Rows that are masked at a time, so that a worker holds few masked texts.
PART_ROWS = 256


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: leftmost matches of each kind, in linear time, without those that fail their check."""
    found = list(_emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 14 <= len(digits := _digits(m[0])) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _numbers(text: str, lo: int, hi: int):
    """Mentions in a run of digits and separators: its parts between spaces, joined while they may be one number."""
    start, end, digits, last = -1, -1, 0, 0
    for m in _PART.finditer(text, lo, hi):
        n = len(_digits(m[0]))
        if start >= 0 and (digits + n > 19 or max(n, last) >= 12 or m[0].startswith("+")):
            yield start, end, digits
            start, digits = -1, 0
        if start < 0:
            start = m.start()
        end, digits, last = m.end(), digits + n, n
    if start >= 0:
        yield start, end, digits


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans that may be personal data and overlap no base match, in order and apart from each other."""
    taken: list[list[int]] = []  # the base matches, joined where they overlap
    for _, lo, hi in sorted(base, key=lambda s: s[1:]):
        if taken and lo < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], hi)
        else:
            taken.append([lo, hi])
    found = []
    if "@" in text or _SPELLING.search(text):
        found += [(0, *m.span()) for m in _SPELLED.finditer(text)]
        found += [(1, *m.span()) for m in _AT_WORD.finditer(text) if len(m[0]) >= 5]
    if re.search("[0-9]", text):
        edges = [0, *(x for span in taken for x in span), len(text)]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):  # between base matches
            for m in _NUMBER.finditer(text, lo, hi):
                for at, end, digits in _numbers(text, *m.span()):
                    end = at + len(text[at:end].rstrip("(.-+ "))
                    alone = (at == 0 or not text[at - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
                    if digits >= 7 and alone:
                        found.append((2, at, end))
    out, k, done = [], 0, 0
    for _, lo, hi in sorted(found, key=lambda s: (s[1], s[0])):
        while k < len(taken) and taken[k][1] <= lo:
            k += 1
        if lo >= done and (k == len(taken) or hi <= taken[k][0]):
            out.append((lo, hi))
            done = hi
    return out


def _shape(mention: str) -> str:
    """What a mention looks like: an address by its signs, a number by the lengths of its groups of digits, marks and checksum."""
    if "@" in mention or _SPELLING.search(mention):
        return "a" + ("@" if "@" in mention else "") + ("*" if _BRACKETED.search(mention) or _DOT.search(mention) else "")
    groups = _GROUP.findall(mention)
    n = sum(map(len, groups))
    marks = ("+" if mention.startswith("+") else "") + ("(" if "(" in mention else "") + ("!" if 14 <= n <= 19 and _luhn("".join(groups)) else "")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        return "q" + ("." if mention.count(".") == 3 else "") + marks
    return ("~" if n >= 7 and len(groups) == n else "-".join(str(len(g)) for g in groups) if n <= 19 else "long") + marks


def _telling(form: str) -> bool:
    """Whether a form with a part hidden can be told by itself: a number in groups with a bracket, a spelled address with its "at" in brackets or its dots spelled."""
    shape = _shape(form)
    return ("(" in shape or "*" in shape) and shape[0] not in "q~"


def _keys(mention: str) -> list[str]:
    digits, plain = _digits(mention), "".join(c for c in _SPELLING.sub(" ", mention).lower() if c.isalnum())
    keys = ["a" + plain] if len(plain) >= 5 else []
    if len(digits) >= 7:
        keys.append("d" + digits)
    if len(digits) >= 12:
        half = len(digits) // 2
        keys += [f"h{len(digits)}" + digits[:half], f"t{len(digits)}" + digits[half:]]
    return keys


def graph(text: str) -> tuple[list[tuple[str, int, int]], list[str], list[tuple[int, int, str]]]:
    """Nodes (label or "" for a candidate, start, end) by start, their shapes, and edges (earlier, later, chain or skip)."""
    base = base_spans(text)
    nodes = sorted([*base, *(("", lo, hi) for lo, hi in candidates(text, base))], key=lambda s: (s[1], s[2]))
    shapes, edges, last = [], [], {}
    for k, (_, lo, hi) in enumerate(nodes):
        mention = text[lo:hi]
        shapes.append(_shape(mention))
        if k and lo - nodes[k - 1][2] <= NEAR:
            edges.append((k - 1, k, "chain"))
        linked = set()
        for key in _keys(mention):
            if (j := last.get(key)) is not None and j not in linked:
                linked.add(j)
                edges.append((j, k, "skip"))
            last[key] = k
    return nodes, shapes, edges


def pools(text: str, nodes: list[tuple[str, int, int]]) -> tuple[list[Counter], list[tuple[int, int]], list[int]]:
    """Hubs (base labels of a key, none if no base match has it), links (hub, candidate), and for each node the candidates that share its evidence.

    A candidate is linked to the first of its keys that has a base match, and to every key that only candidates have.
    """
    keys = [_keys(text[lo:hi]) for _, lo, hi in nodes]
    members: dict[str, list[int]] = {}
    for k, own in enumerate(keys):
        for key in own:
            members.setdefault(key, []).append(k)
    hubs, links, sizes = [], [], [1] * len(nodes)
    found: dict[str, int] = {}
    alike: dict[tuple[int, ...], int] = {}
    for key, ks in members.items():
        if len(ks) > 1 and not all(nodes[k][0] for k in ks):
            found[key] = alike.setdefault(tuple(ks), len(hubs))  # keys with the same mentions are one hub
            if found[key] == len(hubs):
                hubs.append(Counter(nodes[k][0] for k in ks if nodes[k][0]))
            free = sum(not nodes[k][0] for k in ks)
            for k in ks:
                sizes[k] = max(sizes[k], free)
    for k, own in enumerate(keys):
        if not nodes[k][0]:
            at = dict.fromkeys(found[key] for key in own if key in found)
            known = [h for h in at if hubs[h]][:1]
            links += [(h, k) for h in [*known, *(h for h in at if not hubs[h])]]
    return hubs, links, sizes


def hidden(kind: str, mention: str) -> list[str]:
    """Forms of a base match with a part hidden, as people write them."""
    if kind == "phone":
        return [mention.lstrip("+"), " ".join(_digits(mention))]
    if kind == "card":
        other = next(d for d in "0123456789" if not _luhn(_digits(mention)[:-1] + d))
        return [mention[:-1] + other, " ".join(_digits(mention))]
    if kind == "email":
        name, _, host = mention.partition("@")
        return [f"{name} at {host}", f"{name} at {host.replace('.', ' dot ')}", f"{name} (at) {host}"]
    return [mention.replace(".", " ")]


def examples(text: str) -> Counter:
    """Weights of (shape, label before, label after, label of a twin, label): what pseudo-likelihood is fitted to. An unknown label is "-"."""
    found: Counter = Counter()
    nodes, shapes, edges = graph(text)
    keys = [_keys(text[lo:hi]) for _, lo, hi in nodes]
    members: dict[str, Counter] = {}
    for (label, _, _), own in zip(nodes, keys, strict=True):
        for key in own if label else ():
            members.setdefault(key, Counter())[label] += 1
    seen = [label or ("-" if any(k in members for k in own) else "none") for (label, _, _), own in zip(nodes, keys, strict=True)]
    before, after = ["-"] * len(nodes), ["-"] * len(nodes)
    for a, b, kind in edges:
        if kind == "chain":
            after[a], before[b] = seen[b], seen[a]
    for k, (label, lo, hi) in enumerate(nodes):
        if label:
            twins = sum((members[key] for key in keys[k]), Counter())
            twins[label] -= len(keys[k])
            twin = max(LABELS, key=lambda x: twins[x]) if twins and max(twins.values()) > 0 else "-"
            found[shapes[k], before[k], after[k], twin, label] += WHOLE
            for form in hidden(label, text[lo:hi]):
                found[_shape(form), before[k], after[k], twin, label if twin != "-" or _telling(form) else "none"] += 1
                found[_shape(form), before[k], after[k], label, label] += WHOLE  # beside the mention itself, not hidden
        elif seen[k] == "none":
            found[shapes[k], before[k], after[k], "-", "none"] += WHOLE
    return found


def counts(docs: DataFrame) -> DataFrame:
    """(shape, before, after, twin, label, n) over all documents."""
    names = ["shape", "before", "after", "twin", "label"]

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                if _worth(text := value.as_py() or ""):
                    total.update(examples(text))
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.string()) for i in range(5)), pa.array(list(total.values()), pa.int64())], [*names, "n"])

    return docs.select("text").mapInArrow(run, ", ".join(f"{k} string" for k in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))


def _worth(text: str) -> bool:
    return "@" in text or bool(re.search("[0-9]", text)) or bool(_SPELLING.search(text))


class Field:
    """Log potentials fitted to counted cases (shape, before, after, twin, label, n) by pseudo-likelihood."""

    def __init__(self, rows: list[tuple[str, str, str, str, str, int]], rounds: int = 600, rate: float = 0.05, decay: float = 0.05):
        label = {k: i for i, k in enumerate(LABELS)} | {"-": 5}  # the sixth row of each table stays zero
        shapes = {k: i for i, k in enumerate(sorted({r[0] for r in rows}))}
        # Each shape starts with one case of no personal data.
        rows = sorted([*rows, *((k, "-", "-", "-", "none", WHOLE) for k in shapes)])
        at = np.array([[shapes[r[0]], *(label[x] for x in r[1:5])] for r in rows], dtype=np.int64).reshape(-1, 5)
        n = np.array([r[5] for r in rows], dtype=float) / WHOLE
        node, chain, skip = np.zeros((len(shapes), 5)), np.zeros((6, 6)), np.zeros(1)
        goal = np.eye(6)[at[:, 4]][:, :5]
        params = (node, chain, skip)
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
        twin = np.eye(6)[at[:, 3]][:, :5]
        for t in range(1, rounds + 1 if len(rows) else 1):
            z = node[at[:, 0]] + chain[at[:, 1], :5] + chain[:5, at[:, 2]].T + twin * skip
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - goal) * n[:, None]
            grads = [decay * x for x in params]
            np.add.at(grads[0], at[:, 0], d)
            np.add.at(grads[1], (at[:, 1][:, None], np.arange(5)), d)
            np.add.at(grads[1], (np.arange(5), at[:, 2][:, None]), d)
            grads[1][5], grads[1][:, 5] = 0, 0
            np.clip(chain, -CHAIN, CHAIN, out=chain)
            grads[2] += (d * twin).sum()
            for x, g, (m, v) in zip(params, grads, state, strict=True):
                m[:], v[:] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.node = {k: node[i] - np.logaddexp.reduce(node[i]) for k, i in shapes.items()}
        self.unseen = np.log(np.array([0.96, 0.01, 0.01, 0.01, 0.01]))
        self.pair = {"chain": np.clip(chain[:5, :5], -CHAIN, CHAIN), "skip": np.eye(5) * max(0.0, float(skip[0]))}  # twins agree on any label alike

    def posteriors(self, nodes, shapes, edges, pooled) -> np.ndarray:
        """Label probabilities of each node by damped loopy sum-product, all messages of a round at once."""
        hubs, links, sizes = pooled
        theta = np.array([self.node.get(s, self.unseen) for s in shapes]) / np.array(sizes)[:, None]
        for k, (label, _, _) in enumerate(nodes):
            if label:
                theta[k] = -60.0
                theta[k, LABELS.index(label)] = 0.0
        top = np.zeros((len(hubs), 5))
        for k, known in enumerate(hubs):
            if known:
                top[k] = -60.0
                for label, n in known.items():
                    top[k, LABELS.index(label)] = np.log(n / known.total())
        theta = np.concatenate([theta, top])
        edges = [e for e in edges if e[2] == "chain"] + [(len(nodes) + hub, k, "skip") for hub, k in links]
        if edges:
            a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
            table = np.array([self.pair[e[2]] for e in edges])
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            table = np.concatenate([table, table.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            msg = np.zeros((len(src), 5))
            for _ in range(ROUNDS):
                belief = theta.copy()
                np.add.at(belief, dst, msg)
                into = (belief[src] - msg[back])[:, :, None] + table
                top = into.max(axis=1, keepdims=True)
                new = np.log(np.exp(into - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                moved = np.abs(new - msg).max()
                msg = DAMP * msg + (1 - DAMP) * new
                if moved < 1e-4:
                    break
            np.add.at(theta, dst, msg)
        theta = theta[: len(nodes)]
        p = np.exp(theta - theta.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans) of a text."""
        if not _worth(text):
            return [], []
        nodes, shapes, edges = graph(text)
        base = sorted((n for n in nodes if n[0]), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        free = [k for k, n in enumerate(nodes) if not n[0]]
        if not free:
            return base, base
        p = self.posteriors(nodes, shapes, edges, pools(text, nodes))
        added = [(LABELS[int(p[k].argmax())], *nodes[k][1:]) for k in free if p[k].argmax() and p[k].max() > 0.5]
        return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def fit(docs: DataFrame) -> Field:
    """The field's potentials from counts over all documents."""
    return Field([tuple(r) for r in counts(docs).collect()])  # a row for each kind of case


def _joined(spans) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all) of every row's whole text.

    Offsets are code points, ends exclusive. Null texts are empty; texts of any length are read
    whole; repeated rows are alike; of labels that are equally likely the first of LABELS holds, so a tie with
    "none" adds nothing; an empty table gives no rows; other columns are not read, whatever their names.
    """
    field = field or fit(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            found = [field.spans(t.as_py() or "") for t in batch.column(1)]
            tallies = [Counter(s[0] for s in base) for base, _ in found]
            columns = [pa.array([t[k] for t in tallies], pa.int64()) for k in KINDS]
            shas = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(shas, pa.string()), pa.array([_joined(every) for _, every in found], pa.string())], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def mask(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first is named."""
    out, done = [], 0
    for kind, lo, hi in spans:
        if hi > done:
            out += [text[done:lo], f"[{kind.upper()}]"] if lo >= done else []
            done = hi
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with ``text`` masked and, where there is such a column, ``n_chars`` counted anew.

    All rows and columns stay, repeated rows alike; null texts stay null, empty ones empty; texts
    of any length are masked whole; an empty table gives no rows. Ties are as for ``find``; other columns stay as they are, whatever their names.
    """
    field = field or fit(docs)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(start, PART_ROWS)
                texts = [(t := v.as_py()) and mask(t, field.spans(t)[1]) for v in part.column(at)]
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
