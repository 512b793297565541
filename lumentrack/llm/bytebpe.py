"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts are small, the parts are encoded by themselves, and neighbours
are joined up the tree. Joining re-encodes a window around the boundary: it begins at the left
part's last piece (pieces are the matches of the splitting pattern) that starts far enough from
the boundary that no earlier piece depends on what follows, and grows to the right until it ends a piece where the right part, split by
itself, also ends one. From such a place on the pattern sees the same characters from the same
start, so all later pieces, and the tokens in them, are those that the right part already has.
Joining is associative, and the root holds the tokens of the whole text. Decoding concatenates
the bytes of halves up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf, of the first window, and ids of a decoding leaf.
LEAF, WINDOW, LEAF_IDS = 512, 32, 512
#: The pattern decides on a piece within so many characters after it ('ll is the longest of its fixed strings).
LOOK = 3
#: Ids in a batch of output.
BATCH_IDS = 1 << 18


class TreeCodec:
    """Encoder and decoder for a rank file and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        #: In this pattern no piece has white space after another character, so a blank after a letter or digit starts a piece.
        self.space_starts = pattern == public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Ids of a whole text."""
        return self._reduce(text, 0, len(text), leaf)[0]

    def _reduce(self, text: str, lo: int, hi: int, leaf: int) -> tuple[list[int], int]:
        """(ids, tail) of text[lo:hi] taken by itself; see ``_tail``."""
        if hi - lo <= leaf:
            return self.bpe.encode_ordinary(text[lo:hi]), self._tail(text, lo, hi) if hi - lo < len(text) else lo
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._reduce(text, lo, mid, leaf), self._reduce(text, mid, hi, leaf))

    def _tail(self, text: str, lo: int, hi: int) -> int:
        """The last start of a piece, LOOK or more characters from the end: pieces before it stay, whatever follows."""
        for i in range(hi - LOOK, lo, -1) if self.space_starts else ():
            if text[i] in " \n" and text[i - 1].isalnum():
                return i
        tail = lo
        for m in self.pieces.finditer(text, lo, hi):
            if m.start() > hi - LOOK:
                break
            tail = m.start()
        return tail

    def _join(self, text: str, lo: int, mid: int, hi: int, left: tuple[list[int], int], right: tuple[list[int], int]) -> tuple[list[int], int]:
        begin, width, stable = left[1], WINDOW, None
        while stable is None:
            end = min(hi, mid + width)
            sure = end if end == hi else end - LOOK  # pieces that end later may depend on what the window leaves out
            own = [m.span() for m in self.pieces.finditer(text, mid, end)]
            joint = [m.span() for m in self.pieces.finditer(text, begin, end)]
            ends = {mid, *(e for _, e in own)}
            stable = next((e for _, e in joint if mid <= e <= sure and e in ends), None)
            width *= 2
        old = [m.span() for m in self.pieces.finditer(text, begin, mid)]
        ids = left[0][: len(left[0]) - len(self._each(text, old, mid))] + self._each(text, joint, stable) + right[0][len(self._each(text, own, stable)) :]
        return ids, right[1] if stable <= right[1] <= hi - LOOK else self._tail(text, begin, hi)

    def _each(self, text: str, spans: list[tuple[int, int]], end: int) -> list[int]:
        """Ids of the pieces up to ``end``, each by itself: a slice that was split anew would lose what follows it."""
        return [i for lo, hi in spans if hi <= end for i in self.bpe._encode_single_piece(text[lo:hi])]

    def decode(self, ids: list[int], leaf: int = LEAF_IDS) -> bytes:
        """Bytes of the ids, halves concatenated."""
        if len(ids) <= leaf:
            return self.bpe.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def _encoded(tree: TreeCodec, batch, check: bool):
    """Yield batches (doc_id, n_tokens, ids) of at most about BATCH_IDS ids, so that no batch's ids are held as Python numbers."""
    ids, ends, first = array("i"), [0], 0
    texts = batch.column(1)
    for k in range(batch.num_rows):
        text = texts[k].as_py() or ""
        own = tree.encode(text)
        if check and tree.decode(own) != text.encode():
            raise ValueError("a text does not survive encoding and decoding")
        ids.extend(own)
        ends.append(len(ids))
        if len(ids) >= BATCH_IDS or k == batch.num_rows - 1:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends) - 1), pa.array(np.diff(ends), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])
            ids, ends, first = array("i"), [0], k + 1


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> TreeCodec:
    """One codec for each worker process."""
    return TreeCodec(path, pattern)


def _paths(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text; null texts count as empty and have no ids.

    Repeated rows are encoded alike, other columns are not read, an empty table gives no rows.
    Unpaired surrogates cannot occur in Spark strings. The rank file is read on the executors.
    """
    path, pattern = _paths(path, pattern)

    def run(batches):
        tree = codec(path, pattern)
        for batch in batches:
            for part in _encoded(tree, batch, False):
                yield part.select(["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def encode_checked(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; each text is decoded again and must come back byte for byte, or it is an error.

    Null and empty texts have no ids; repeated rows and equal texts are encoded alike, texts of any length whole; an empty table gives no
    rows; other columns are not read, whatever their names.
    """
    path, pattern = _paths(path, pattern)

    def run(batches):
        tree = codec(path, pattern)
        for batch in batches:
            yield from _encoded(tree, batch, True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, content binary) of (doc_id, ids)."""
    path, pattern = _paths(path, pattern)

    def run(batches):
        tree = codec(path, pattern)
        for batch in batches:
            content = [tree.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes decoded from the ids).

    Null and empty texts have no ids and decode to no bytes. Repeated rows and equal texts give equal digests, texts of any
    length are encoded whole; an empty table gives no rows; other columns are not read, whatever their names.
    Encodes and decodes in one pass, so that ids of long texts need not be moved.
    """
    path, pattern = _paths(path, pattern)

    def run(batches):
        tree = codec(path, pattern)
        for batch in batches:
            counts, shas, back = [], [], []
            for text in batch.column(1):
                ids = tree.encode(text.as_py() or "")
                counts.append(len(ids))
                shas.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
