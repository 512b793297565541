"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of some labelled text. A text is
parsed greedily into the longest phrases that the automaton knows. A language with more text knows
longer phrases, so the number of phrases is normalised by the logarithm of the length of what was
learned (the cross-parsing estimate of entropy); the language that needs the fewest wins.

The parse is a walk: from a state and a letter to the next state, or, where the phrase cannot
go on, to the state after that letter from the root, which starts a phrase. Transitions are kept in
one hash table, so memory follows the automata and not the alphabet, which has every letter
learned. Texts are walked in blocks of ``BLOCK`` characters, all blocks of a group and all
languages at once: first each block from the root, keeping its states, then again from the state that the block
before it ends in, until the walk meets a state that it had at the same place (from there on it
is the same). What is counted is the parse of the whole text.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, fold, unit_hash

#: Labelled rows gathered for each language (in expectation), characters of their pieces in an automaton, words of a piece.
ROWS, TRAIN_CHARS, PIECE = 400, 24_000, 24
#: Characters that are walked side by side in one language, and languages times characters held at once. Both change speed only.
BLOCK, _GROUP = 512, 1 << 23
#: Codes of what is no letter and of letters that were not learned; learned letters follow.
_OTHER, _NEW = 0, 1


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur, p = len(edges), last
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return edges


class Parser:
    """Automata of all languages, by text of each."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.languages = [k for k, _ in texts]
        alphabet = sorted({c for _, t in texts for c in t.lower() if c.isalpha()})
        self.width = len(alphabet) + 2
        self.codes = np.full(0x110000, _OTHER, dtype=np.int32)
        self.codes[[c for c in range(0x110000) if chr(c).isalpha()]] = _NEW
        self.codes[[ord(c) for c in alphabet]] = np.arange(2, self.width)
        keys, values, roots, starts, base = [], [], [], [], 0
        for _, text in texts:
            edges = suffix_automaton(self.encode(text).tolist())
            roots.append(base)
            first = np.full(self.width, base, dtype=np.int64)  # a letter that the language lacks is a phrase by itself
            first[list(edges[0])] = np.array(list(edges[0].values()), dtype=np.int64) + base
            starts.append(first)
            edges[0] = {}  # every letter starts a phrase at the root, so it has no transition that goes on
            keys.append(np.array([(s + base) * self.width + c for s, out in enumerate(edges) for c in out], dtype=np.int64))
            values.append(np.array([to + base for out in edges for to in out.values()], dtype=np.int64))
            base += len(edges)
        self.roots = np.array(roots, dtype=np.int64) * self.width
        if base >= 1 << 24 or base * self.width >= 1 << 39:
            raise ValueError("too much to learn: lower the characters of a language")
        #: States are kept times width. The state after each code from the root, language by language.
        self.starts = np.concatenate(starts) * self.width
        #: Bits that a language's phrase points to a place of its text with.
        self.bits = np.array([math.log2(max(2, len(t))) for _, t in texts])
        self._fill(np.concatenate(keys), np.concatenate(values))

    def _fill(self, keys: np.ndarray, states: np.ndarray) -> None:
        """Hash table of the transitions, a sixth to a third full, by linear probing; an entry is its key and its state, or -1."""
        size = 1 << max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.entries = np.full(size, -1, dtype=np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.entries[at] < 0
            self.entries[at[first]] = keys[left[first]] << 24 | states[left[first]]
            left = left[~first]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _step(self, state: np.ndarray, code: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, whether a phrase starts) of lanes; ``offset`` is where a lane's language has its ``starts``."""
        keys = state + code
        slot = self._slot(keys)
        entry = self.entries[slot]
        new = entry >> 24 != keys
        to = (entry & 0xFFFFFF) * self.width
        on = np.flatnonzero(new & (entry >= 0))
        wanted, at = keys[on], slot[on]
        while len(on):  # those whose slot another key holds
            at = (at + 1) & self.mask
            entry = self.entries[at]
            hit = entry >> 24 == wanted
            to[on[hit]], new[on[hit]] = (entry[hit] & 0xFFFFFF) * self.width, False
            left = ~hit & (entry >= 0)
            on, wanted, at = on[left], wanted[left], at[left]
        miss = np.flatnonzero(new)
        to[miss] = self.starts[offset[miss] + code[miss]]
        return to, new

    def encode(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each whole text (rows) in each language (columns)."""
        coded = [self.encode(t) for t in texts]
        sizes = np.array([len(c) for c in coded])
        blocks = -(-sizes // BLOCK)
        n, languages = int(blocks.sum()), len(self.languages)
        if not n:
            return np.zeros((len(texts), languages), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), blocks)
        inner = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # a block's number in its text
        length = np.minimum(BLOCK, sizes[owner] - inner * BLOCK)
        grid = np.zeros((n, BLOCK), dtype=np.int32)
        grid[np.arange(BLOCK) < length[:, None]] = np.concatenate(coded)
        # Lanes: blocks by length, the longest first, so that those still walked are a slice; all languages of a block side by side.
        order = np.argsort(-length, kind="stable")
        steps = np.ascontiguousarray(grid[order].T)
        live = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")  # blocks longer than a place
        state, offset = np.tile(self.roots, n), np.tile(np.arange(languages) * self.width, n)
        count, end = np.zeros(n * languages, dtype=np.int64), state.copy()
        trace, starts = np.zeros((BLOCK, n * languages), dtype=np.int64), np.zeros((BLOCK, n * languages), dtype=bool)
        for at in range(BLOCK):
            m = live[at] * languages
            if not m:
                break
            state[:m], new = self._step(state[:m], np.repeat(steps[at, : live[at]], languages), offset[:m])
            trace[at, :m], starts[at, :m] = state[:m], new
            count[:m] += new
        end[:] = state
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        later = np.flatnonzero(inner > 0)
        lanes = (place[later][:, None] * languages + np.arange(languages)).ravel()
        before = (place[later - 1][:, None] * languages + np.arange(languages)).ravel()
        room = np.repeat(length[later], languages)
        entry = np.tile(self.roots, n)  # the state that each lane was last walked from
        while len(lanes):
            moved = end[before] != entry[lanes]
            lanes_now, begin, room_now = lanes[moved], end[before][moved], room[moved]
            if not len(lanes_now):
                break
            entry[lanes_now] = begin
            now, at = begin, 0
            while len(lanes_now):
                now, new = self._step(now, steps[at, lanes_now // languages], offset[lanes_now])
                count[lanes_now] += new.astype(np.int64) - starts[at, lanes_now]
                on = now != trace[at, lanes_now]
                trace[at, lanes_now], starts[at, lanes_now] = now, new
                last = on & (room_now == at + 1)
                end[lanes_now[last]] = now[last]
                on &= room_now > at + 1
                lanes_now, now, room_now, at = lanes_now[on], now[on], room_now[on], at + 1
        found = np.zeros((len(texts), languages), dtype=np.int64)
        np.add.at(found, owner[order], count.reshape(n, languages))
        return found

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; ties go to the language that sorts first."""
        need = np.maximum(self.phrases(texts), 1) * self.bits
        best = need.argmin(axis=1)
        share = (need.min(axis=1, keepdims=True) / need) ** 8
        score = share.max(axis=1) / share.sum(axis=1)
        return [(self.languages[k], float(s)) for k, s in zip(best, score, strict=True)]


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(texts)


def learn(docs: DataFrame, rows: int = ROWS, chars: int = TRAIN_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, text) for each label seen outside fold 2.

    About ``rows`` rows of a language, chosen by a hash of their ids, are cut into pieces of PIECE words; pieces
    from anywhere in them, in the order of a hash, are learned until they hold ``chars`` characters (or all
    are). Words longer than ``chars`` and languages without a letter are left out.
    """
    known = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) != 2)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    part = known.join(F.broadcast(counts), "lang").where(unit_hash(F.struct("doc_id", "text")) < F.lit(float(rows)) / F.col("n"))  # a row a language
    words = part.select("lang", "doc_id", F.filter(F.split("text", WORD_GAP), lambda w: (w != "") & (F.length(w) <= chars)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(PIECE)))
    pieces = words.select("lang", "doc_id", "w", starts.alias("at")).select("lang", F.array_join(F.slice("w", F.col("at"), PIECE), " ").alias("piece"), F.xxhash64("doc_id", "at", F.array_join(F.slice("w", F.col("at"), PIECE), " ")).alias("rank"))
    order = Window.partitionBy("lang").orderBy("rank", "piece")
    before = F.coalesce(F.sum(F.length("piece") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = pieces.where(F.col("piece").rlike(r"\p{L}")).withColumn("before", before).where(F.col("before") < chars).select("lang", "rank", "piece").collect()
    found: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r.rank, r.piece)):
        found.setdefault(r.lang, []).append(r.piece)
    return tuple((k, " ".join(found[k])) for k in sorted(found))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row's whole text, however long.

    ``und`` with score 0 if the text is null or has no letter, or if no label is known. Where
    languages need equally many phrases, the one that sorts first is named. Equal texts get equal
    answers, repeated rows stay; an empty table gives no rows; other columns are not read,
    whatever their names.
    """
    texts = learn(docs)

    def run(batches):
        parser = _parser(texts) if texts else None
        most = _GROUP // max(1, len(texts))
        for batch in batches:
            out: list[tuple[str, float]] = []
            group, held = [], 0

            def flush():
                nonlocal group, held
                lettered = [any(map(str.isalpha, t)) for t in group]
                answers = iter(parser.predict([t for t, ok in zip(group, lettered, strict=True) if ok]) if texts else [])
                out.extend(next(answers) if ok and texts else ("und", 0.0) for ok in lettered)
                group, held = [], 0

            for t in batch.column(1):
                group.append(t.as_py() or "")
                held += len(group[-1])
                if held >= most:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
