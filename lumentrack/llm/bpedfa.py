"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that the merges make. It starts with
one free state in which every symbol may follow every other, and each merge (u, v) -> w, in order
of rank, puts its gadget in:

- an arc w goes wherever an arc u goes that v may follow, and ends in a copy of the state that v leads to;
- the state that u leads to loses its arc v, as a u before a v would have been merged;
- if u is v, that state loses its arc w as well, since runs are merged from the left.

So all arcs with one label end in one state, and a state is the set of arcs that it lacks: the
automaton is a table of bits, [label][state]. Labels that are lacking in the same states share a row. It
has as many states as there are tokens that may be followed, and its size depends on the vocabulary alone.

A word is encoded from left to right. From every place that the path reaches, the tokens that
begin there are read from a trie, and those whose arc the table allows lead on; as the automaton accepts one
sequence for each prefix, each place is reached once, and the work is linear in the word.
Words that a worker has not met yet are encoded together, all of them by one symbol at a time in arrays.
Decoding walks the path of the ids and emits the labels of its arcs.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenstore import _PIECE, _PLAIN, _PRE_TOKENIZER, _SPACE_SPLIT, Memory

#: Bytes of the longest word that is remembered.
LONGEST = 64
#: Words and pieces in each half of a worker's memory.
MEMORY_WORDS, MEMORY_PIECES = 200_000, 100_000
#: Words from which on a worker looks them up; the new ones among them are encoded together.
TOGETHER = 20_000


class Automaton:
    """Tables of the deterministic automaton for a vocabulary {token: id} and merges [(left, right)] in order of rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        size = max(vocab.values(), default=-1) + 1
        made = {u + v for u, v in merges}
        ends = {i for t, i in vocab.items() if end and t.endswith(end)}  # nothing follows these in a word
        self.label = [""] * size
        for t, i in vocab.items():
            self.label[i] = t
        followed = [i for i in vocab.values() if i not in ends]
        #: State after each token, -1 at a word's end; the last state is the start, which lacks no arc.
        after = np.full(size, -1, dtype=np.int64)
        after[followed] = np.arange(len(followed))
        self.after, self.start = after.tolist(), len(followed)
        lacks = np.zeros((size, self.start // 8 + 1), dtype=np.uint8)
        known = [i for t, i in vocab.items() if t not in made]  # labels so far, in order of their appearance
        order = np.array(known + [vocab[u + v] for u, v in merges], dtype=np.int64)
        rows, count = np.argsort(order), len(known)  # a label's row is its place in that order, so that those so far are the first
        if len(set(order.tolist())) != size:
            raise ValueError("a token without an id, or one that two merges make")
        born = np.zeros(size, dtype=bool)
        born[known] = True
        after = self.after
        for u, v, w in [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]:
            if not (born[u] and born[v]) or u in ends:
                raise ValueError("merges are not in an order in which their parts exist")
            row, (at, bit) = rows[w], divmod(after[u], 8)
            lacks[row] = 255 if lacks[rows[v], at] >> bit & 1 else lacks[rows[u]]  # parts that never meet make no arc
            if w not in ends:
                (old, from_bit), (new, to_bit) = divmod(after[v], 8), divmod(after[w], 8)
                lacks[:count, new] |= ((lacks[:count, old] >> from_bit) & 1) << to_bit
                lacks[row, new] |= ((lacks[row, old] >> from_bit) & 1) << to_bit
            lacks[rows[v], at] |= 1 << bit
            if u == v:
                lacks[row, at] |= 1 << bit
            born[w], count = True, count + 1
        alike = lacks.view([("", np.void, lacks.shape[1])]).ravel() if lacks.size else lacks[:, 0]
        _, first, own = np.unique(alike, return_index=True, return_inverse=True)
        self.lacks = lacks[first]
        self.row = own.ravel()[rows].tolist() if size else []
        self.trie: dict[tuple[int, str], int] = {}
        self.token = [-1]
        self.end, self.depth = end, max(map(len, vocab), default=0)  # no token has more symbols than characters
        for text, i in vocab.items():
            node = 0
            for symbol in self.symbols(text[: -len(end)] if i in ends else text, i in ends):
                nxt = self.trie.setdefault((node, symbol), len(self.token))
                if nxt == len(self.token):
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.arrays = self._arrays()

    def _arrays(self) -> dict[str, np.ndarray]:
        """The trie in arrays: symbols are numbered from the most frequent one on, and a node's row of ``next`` ends after its last symbol with a 0 for all others."""
        often = Counter(symbol for _, symbol in self.trie)
        number = {symbol: k for k, (symbol, _) in enumerate(often.most_common())}
        chars = max((ord(symbol[0]) for symbol in number), default=0) + 1
        inside, final = np.full((2, chars + 1), len(number), dtype=np.int64)  # the last place is for all other characters
        for symbol, k in number.items():
            (final if symbol[1:] else inside)[ord(symbol[0])] = k
        made = np.array([(node, number[symbol], nxt) for (node, symbol), nxt in self.trie.items()], dtype=np.int64).reshape(-1, 3)
        width = np.zeros(len(self.token), dtype=np.int64)
        np.maximum.at(width, made[:, 0], made[:, 1] + 1)
        base = np.cumsum(width + 1) - width - 1
        table = np.zeros(int((width + 1).sum()), dtype=np.int64)
        table[base[made[:, 0]] + made[:, 1]] = made[:, 2]
        as_long = lambda values: np.array(values, dtype=np.int64)
        return {"inside": inside, "final": final if self.end else inside, "width": width, "base": base, "next": table, "token": as_long(self.token), "after": as_long(self.after), "row": as_long(self.row)}

    @cached_property
    def nodes(self) -> dict:
        """The trie as a chain of tables, symbol -> (next table, token or -1, the states that lack the token's arc); made anew in each worker."""
        inner, leaf = {n for n, _ in self.trie}, {}
        tables = [{} if n in inner else leaf for n in range(len(self.token))]
        for (node, symbol), nxt in self.trie.items():
            t = self.token[nxt]
            tables[node][symbol] = tables[nxt], t, memoryview(self.lacks[self.row[t]]) if t >= 0 else b""
        return tables[0]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "nodes"}

    def symbols(self, word: str, ended: bool = True) -> list[str]:
        """Characters, the last one with the mark of a word's end."""
        return [*word[:-1], word[-1] + self.end] if word and ended else list(word)

    def allows(self, state: int, token: int) -> bool:
        """Whether the arc of a token leaves a state."""
        return state >= 0 and not int(self.lacks[self.row[token], state >> 3]) >> (state & 7) & 1

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        symbols = self.symbols(word)
        states, arcs = [-1] * (len(symbols) + 1), [-1] * (len(symbols) + 1)
        lengths = [0] * (len(symbols) + 1)
        states[0] = self.start
        root, after, depth = self.nodes, self.after, self.depth
        for i, state in enumerate(states):
            if state < 0:
                continue
            table, byte, bit, k = root, state >> 3, 1 << (state & 7), i
            for symbol in symbols[i : i + depth]:
                found = table.get(symbol)
                if found is None:
                    break
                table, t, lacks = found
                k += 1
                if t >= 0 and not lacks[byte] & bit:
                    states[k], arcs[k], lengths[k] = after[t], t, k - i
                if not table:
                    break
        out, at = [], len(symbols)
        if symbols and arcs[at] < 0:
            raise ValueError("a character that the vocabulary lacks")
        while at:
            out.append(arcs[at])
            at -= lengths[at]
        return out[::-1]

    def encode_all(self, words: list[str]) -> list[list[int]]:
        """Ids of each of many pre-split words, as ``encode`` gives them.

        Every place that a path reaches sends a walker down the trie; all walkers of all words take one symbol at a time, and where the
        table allows a token's arc, the place that it leads to sends its own.
        """
        a, count = self.arrays, len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=count)
        own, filled = np.arange(count), sizes > 0
        starts = np.cumsum(sizes) - sizes + own  # a word of n symbols has n + 1 places, the last of which has no symbol
        stops = starts + sizes
        chars = np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64), len(a["inside"]) - 1)
        places = np.arange(len(chars)) + np.repeat(own, sizes)
        symbols = np.full(len(chars) + count, a["inside"][-1])
        symbols[places] = a["inside"][chars]
        symbols[stops[filled] - 1] = a["final"][chars[np.cumsum(sizes)[filled] - 1]]
        arcs, before = np.full(len(symbols), -1), np.zeros(len(symbols), dtype=np.int64)
        at = begun = starts[filled]
        node, state = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.start)
        while len(at):
            node = a["next"][a["base"][node] + np.minimum(symbols[at], a["width"][node])]
            live = np.flatnonzero(node)
            at, node, state, begun = at[live] + 1, node[live], state[live], begun[live]
            token = a["token"][node]
            hit = np.flatnonzero(token >= 0)
            token, lacked = token[hit], state[hit]
            free = self.lacks[a["row"][token], lacked >> 3] >> (lacked & 7).astype(np.uint8) & 1 == 0
            hit, token = hit[free], token[free]
            to, then = at[hit], a["after"][token]
            arcs[to], before[to] = token, begun[hit]
            to, then = to[then >= 0], then[then >= 0]
            on = np.flatnonzero(a["width"][node])
            at, node, state, begun = (np.concatenate(x) for x in ((at[on], to), (node[on], np.zeros_like(to)), (state[on], then), (begun[on], to)))
        at = stops[filled]
        if (arcs[at] < 0).any():
            raise ValueError("a character that the vocabulary lacks")
        path = np.zeros(len(symbols), dtype=bool)
        while len(at):
            path[at] = True
            at = before[at]
            at = at[arcs[at] >= 0]
        ids, upto = arcs[path].tolist(), np.cumsum(np.bincount(np.repeat(own, sizes + 1)[path], minlength=count)).tolist()
        return [ids[i:k] for i, k in zip([0, *upto], upto, strict=False)]

    def accepts(self, ids: list[int]) -> bool:
        """Whether the ids are what a word encodes to."""
        state = self.start
        for i in ids:
            if not self.allows(state, i):
                return False
            state = self.after[i]
        return True

    def decode(self, ids: list[int]) -> list[str]:
        """Labels of the arcs that the ids name."""
        return [self.label[i] for i in ids]


class _Words(Memory):
    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= LONGEST else self.make(key)

    def new(self, keys) -> list:
        """The keys that can be remembered and are not; then there is room for them."""
        found = [k for k in keys if len(k) <= LONGEST and k not in self and k not in self.old]
        if len(self) + len(found) > self.size:
            self.old.clear()
            self.old.update(self)
            self.clear()
            found = [k for k in keys if len(k) <= LONGEST and k not in self.old]
        return found


class Codec:
    """A tokenizer file's normaliser and splitter around the automaton of its merges.

    With the splitting at white space that ``tokenstore`` knows, no token spans white space, so a text is encoded word by word,
    and each short word once while it is remembered; with any other, whole texts are normalised and split.
    """

    def __init__(self, path: str, automaton: Automaton | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"not a plain BPE model: {path}")
        if made.get("decoder") is not None:
            raise ValueError("only labels joined by spaces are decoded")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = automaton or Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.labels = {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.by_word = made.get("normalizer") == _SPACE_SPLIT and made.get("pre_tokenizer") == _PRE_TOKENIZER and not any(c.isspace() for t in self.special for c in t)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        self.alphabet = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(kept))}
        self.byte_letters = {b: c for b, c in self.alphabet.items() if chr(b) != c}
        self.letters_stay = not any(t.isalpha() for t in self.special)
        shown = dict(enumerate(self.automaton.label)) | self.labels
        self.shown = {i: (b"%d " % i, f"{t} ".encode()) for i, t in shown.items()}
        self.pieces = _Words(self._piece, MEMORY_PIECES)
        self.words = _Words(self._word, MEMORY_WORDS)

    def _split(self, text: str) -> list[int]:
        """Ids of a text by the tokenizer's own normaliser and splitter; added tokens count as they stand in the text."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)] if self.tokenizer.pre_tokenizer else [normal]
                for piece in pieces:
                    out += self.automaton.encode(piece)
        return out

    def _cut(self, raw: bytes) -> list[str] | None:
        """A word's pieces, lower-cased; None if only the tokenizer's own splitter cuts it."""
        if self.letters_stay and raw.isalpha():  # ASCII letters
            return [raw.lower().decode()]
        word = raw.decode()
        return _PIECE.findall(word.lower()) if _PLAIN.fullmatch(word) and not (self.cut and self.cut.search(word)) else None

    def _letters(self, piece: str) -> str:
        """A piece's bytes in the characters that stand for them."""
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.byte_letters)

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        return self._forms(self.automaton.encode(self._letters(piece)))

    def _word(self, raw: bytes) -> tuple[bytes, bytes]:
        return self._whole(raw, self._cut(raw))

    def _whole(self, raw: bytes, pieces: list[str] | None) -> tuple[bytes, bytes]:
        if pieces is None:
            return self._forms(self._split(raw.decode()))
        if len(pieces) == 1:
            return self.pieces[pieces[0]]
        found = [self.pieces[p] for p in pieces]
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def _forms(self, ids: list[int]) -> tuple[bytes, bytes]:
        """(decimal ids, their decoded labels), each followed by a blank."""
        found = [self.shown[i] for i in ids]
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def _learn(self, words: set[bytes]) -> None:
        """Remember the words, of which the pieces that are new are encoded together."""
        fresh = [(raw, self._cut(raw)) for raw in self.words.new(words)]
        pieces = self.pieces.new({p for _, cut in fresh for p in cut or ()})
        for p, ids in zip(pieces, self.automaton.encode_all([self._letters(p) for p in pieces]), strict=True):
            self.pieces[p] = self._forms(ids)
        for raw, cut in fresh:
            self.words[raw] = self._whole(raw, cut)

    def _found(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Forms of words in order; those that are not remembered are learnt first."""
        found = list(map(self.words.get, words))
        lacking = [k for k, f in enumerate(found) if f is None]
        self._learn({words[k] for k in lacking})
        for k in lacking:
            found[k] = self.words[words[k]]
        return found

    def each(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids joined by blanks, decoded text) of each whole text, in order; the words of short texts are looked up together."""
        words: list[bytes] = []
        ends: list[int] = []

        def joined():
            found = [f for k in range(0, len(words), 4 * TOGETHER) for f in self._found(words[k : k + 4 * TOGETHER])]  # a long text goes in parts
            for a, b in zip([0, *ends], ends, strict=False):
                yield b"".join([f[0] for f in found[a:b]]), b"".join([f[1] for f in found[a:b]])

        def done():
            for ids, decoded in joined():
                yield ids.count(b" "), ids[:-1], decoded[:-1]
            words.clear()
            ends.clear()

        for text in texts:
            if not self.by_word:
                ids, decoded = self._forms(self._split(text))
                yield ids.count(b" "), ids[:-1], decoded[:-1]
                continue
            words += text.encode().split()
            ends.append(len(words))
            if len(words) >= TOGETHER:
                yield from done()
        yield from done()

    def both(self, text: str) -> tuple[int, bytes, bytes]:
        """(number of ids, decimal ids joined by blanks, decoded text) of a whole text."""
        return next(self.each([text]))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.both(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids, added tokens included, joined by blanks, as a file without a decoder has it."""
        label, own = self.automaton.label, self.labels
        return " ".join([own[i] if i in own else label[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a tokenizer file, whose automaton is compiled here."""
    return Codec(path)


_OWN: dict[str, Codec] = {}


def _own(path: str, automaton: Broadcast) -> Codec:
    """A worker's one codec of a file, for all its tasks; a function of the module, as a nested one would come with an empty ``_OWN`` to each task."""
    if path not in _OWN:
        _OWN[path] = Codec(path, automaton.value)
        gc.freeze()  # it stays as long as the worker, so the collector needn't walk its tables and memories
    return _OWN[path]


def _shared(spark: SparkSession, path: str | None):
    """A function for tasks that gives a worker its one codec.

    The automaton is compiled once, on the driver, and broadcast; its size is set by the vocabulary (about 30 MB for 50,000 tokens). The
    file's normaliser and splitter are read on the executors.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    automaton = spark.sparkContext.broadcast(codec(path).automaton)

    return partial(_own, path, automaton)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text; null and empty texts have no ids.

    Repeated rows and texts are encoded alike, texts of any length whole; an empty table gives no rows; other columns are not read, whatever their names.
    """
    shared = _shared(docs.sparkSession, path)

    def run(batches):
        own = shared()
        for batch in batches:
            for k in range(batch.num_rows):
                ids = own.encode(batch.column(1)[k].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): arc labels joined by blanks; null ids count as none. An id outside the vocabulary is an error."""
    shared = _shared(encoded.sparkSession, path)

    def run(batches):
        own = shared()
        for batch in batches:
            texts = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by blanks), decoded_sha256 (of the text decoded from the ids).

    Null and empty texts have no ids and decode to an empty text. Repeated rows and equal texts give equal
    digests, texts of any length are encoded whole; an empty table gives no rows; other columns are not
    read, whatever their names. Encodes and decodes in one pass, so that ids of long texts need not be moved.
    """
    shared = _shared(docs.sparkSession, path)

    def run(batches):
        own = shared()
        for batch in batches:
            counts, shas, back = [], [], []
            for n, ids, decoded in own.each(text.as_py() or "" for text in batch.column(1)):
                counts.append(n)
                shas.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
