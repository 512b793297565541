"""Token-id shards with a minimal perfect hash index.

Shards: one file for each range of document ids, in ascending order, holding a header and the
raw ids of its documents, little-endian, two bytes each if the vocabulary allows and four
otherwise. Index: the keys are dealt by hash to index files of bounded size; each holds a
minimal perfect hash (keys fall into small groups, and a displacement for each group sends its
keys to free slots), and for each slot a fingerprint of the key and the place of its ids: shard,
offset, count. A lookup reads one slot and compares the fingerprint, so it takes constant time,
and a key that is not in the index is refused (but for one in 2^64).

A document's key is its id and its number among rows of the same id (0 but for repeated rows).
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir
from .files import open_file, write_file

MAGIC, INDEX_MAGIC = b"LTSHARD1", b"LTMPHIX1"
#: Ids appended to each document; documents in an index file (on average); keys of a group.
END_ID, INDEX_KEYS, GROUP = 1, 50_000, 4
#: Words and pieces in each half of a worker's memory.
MEMORY_WORDS, MEMORY_PIECES = 400_000, 400_000

#: Text of only these characters is split here as the tokenizer's own pattern splits it once lower-cased.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0D\x20a-zß-öø-ÿ0-9]+")
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SPACE_SPLIT = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


class Memory(dict):
    """Results by key, made where missing; of two halves the older one goes when the newer is full."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        self[key] = got = self.make(key) if got is None else got
        return got


class Encoder:
    """Ids of texts by the tokenizers library, with each word and each piece encoded once while remembered.

    If the tokenizer drops white space, no token spans it, so a text's ids are those of its words.
    The memory is used only for a tokenizer with exactly the normaliser and splitting that this relies on,
    patterns and behaviours included; any other encodes whole texts.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.by_word = made.get("normalizer") == _SPACE_SPLIT and made.get("pre_tokenizer") == _PRE_TOKENIZER and not any(c.isspace() for t in self.special for c in t)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        self.alphabet = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(kept))}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.is_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        self.words = Memory(self._word, MEMORY_WORDS)
        self.pieces = Memory(self._piece, MEMORY_PIECES)

    def _pack(self, ids) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isalnum() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return self._pack([t.id for t in self.tokenizer.model.tokenize(plain)])

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if _PLAIN.fullmatch(word) and not self.is_special(word):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(word.lower())))
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text, without the end id."""
        if not self.by_word:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, text.encode().split()))  # bytes split at ASCII white space only; any other stays in a word and is dropped there


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def key_bytes(doc_id: int | None, number: int) -> bytes:
    return f"{'' if doc_id is None else doc_id}#{number}".encode()


def _mix(h: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mix of hashes and seeds."""
    with np.errstate(over="ignore"):
        x = (h ^ (np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct 64-bit hashes: (displacement of each group, slot of each key)."""
    n = len(hashes)
    groups = max(1, -(-n // GROUP))
    group = (_mix(hashes, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    begins = np.cumsum(sizes) - sizes
    taken, slots, shift = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(groups, dtype=np.uint32)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        members = order[begins[g] : begins[g] + sizes[g]]
        own, d = hashes[members], 1
        while True:
            tries = np.arange(d, d + 64, dtype=np.uint64)
            at = (_mix(own[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[at].any(axis=1)
            if len(members) > 1 and free.any():
                s = np.sort(at, axis=1)
                free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if free.any():
                k = int(free.argmax())
                shift[g], slots[members], taken[at[k]] = d + k, at[k], True
                break
            d += 64
            if d >= 1 << 31:
                raise ValueError("keys are not distinct")
    return shift, slots


def slot_of(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    group = (_mix(hashes, 0) % np.uint64(len(shift))).astype(np.int64)
    return (_mix(hashes, shift[group].astype(np.uint64)) % np.uint64(max(1, n))).astype(np.int64)


def _key_hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 1)


def _fingerprint(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 2)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write ``docs`` in ascending doc_id order; returns (shard, path, doc_id, number, offset, n_tokens), offsets in ids within a shard.

    Rows are dealt by ranges of doc_id, so shard numbers ascend with the ids, nulls first. The
    texts are moved rather than their ids; ids stream to the file, so a task holds one batch and
    28 bytes for each document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("shard", F.spark_partition_id())
    schema = "shard int, path string, doc_id long, number int, offset long, n_tokens long"
    types = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        enc, shard = encoder(tokenizer), [0]
        ids, nulls, numbers, offsets, sizes = array("q"), [0], array("i"), array("q"), array("q")  # nulls come first
        end = enc._pack([end_id])

        def parts():
            before, number, at = object(), 0, 0
            yield MAGIC + struct.pack("<II", 1, enc.dtype.itemsize)
            for batch in batches:
                for doc_id, text, s in zip(*batch.columns, strict=True):
                    doc_id, packed = doc_id.as_py(), enc.encode(text.as_py() or "") + end
                    number = number + 1 if doc_id == before else 0
                    before, shard[0] = doc_id, s.as_py()
                    nulls[0] += doc_id is None
                    ids.append(doc_id or 0)
                    numbers.append(number)
                    offsets.append(at)
                    sizes.append(len(packed) // enc.dtype.itemsize)
                    at += sizes[-1]
                    yield packed

        path = write_file(folder, "ids.bin", parts())
        for lo in range(0, len(ids), 10_000):
            hi = min(lo + 10_000, len(ids))
            own = [None if k < nulls[0] else ids[k] for k in range(lo, hi)]
            columns = [[shard[0]] * (hi - lo), [path] * (hi - lo), own, numbers[lo:hi], offsets[lo:hi], sizes[lo:hi]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split(" ")[0] for x in schema.split(", ")])

    return materialise(rows.mapInArrow(run, schema), "places")


def write_index(places: DataFrame, folder: str, keys: int = INDEX_KEYS) -> DataFrame:
    """Write the index files; returns (part, path, parts). A key belongs to the part that its hash names, of ``parts`` in all; a part without keys has no file."""
    parts = max(1, -(-places.count() // keys))
    spread = _parted(places, parts).select("part", "doc_id", "number", "shard", "offset", "n_tokens")

    def run(key, table):
        names = [key_bytes(d, k) for d, k in zip(table.column("doc_id").to_pylist(), table.column("number").to_pylist(), strict=True)]
        hashes = np.array([_key_hash(k) for k in names], dtype=np.uint64)
        shift, slots = build_index(hashes)
        columns = [np.zeros(len(names), dtype=t) for t in ("<u8", "<u4", "<u8", "<u4")]
        columns[0][slots] = [_fingerprint(k) for k in names]
        for c, name in zip(columns[1:], ("shard", "offset", "n_tokens"), strict=True):
            c[slots] = table.column(name).to_numpy()
        head = INDEX_MAGIC + struct.pack("<QQ", len(names), len(shift))
        path = write_file(folder, "index.bin", [head, shift.astype("<u4").tobytes(), *(c.tobytes() for c in columns)])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "path": [path], "parts": pa.array([parts], pa.int32())})

    return materialise(spread.groupBy("part").applyInArrow(run, "part int, path string, parts int"), "index")


def _parted(keys: DataFrame, parts: int) -> DataFrame:
    return keys.withColumn("part", F.pmod(F.xxhash64("doc_id", "number"), F.lit(parts)).cast("int"))


class Index:
    """A part of the index, read from its file."""

    def __init__(self, path: str):
        with open_file(path) as f:
            data = f.read()
        if data[:8] != INDEX_MAGIC:
            raise ValueError(f"not an index: {path}")
        self.n, groups = struct.unpack_from("<QQ", data, 8)
        at, found = 24, []
        for t, k in (("<u4", groups), ("<u8", self.n), ("<u4", self.n), ("<u8", self.n), ("<u4", self.n)):
            found.append(np.frombuffer(data, dtype=t, count=k, offset=at))
            at += found[-1].nbytes
        self.shift, self.prints, self.shard, self.offset, self.count = found

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(known, shard, offset, count) of each key."""
        slots = slot_of(np.array([_key_hash(k) for k in keys], dtype=np.uint64), self.shift, self.n)
        known = self.prints[slots] == np.array([_fingerprint(k) for k in keys], dtype=np.uint64)
        return known, self.shard[slots], self.offset[slots], self.count[slots]


def look_up(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, number) -> the same with shard, offset, n_tokens from the index; keys that it lacks are left out."""
    parts = index.agg(F.max("parts")).first()[0] or 1
    schema = "doc_id long, number int, shard int, offset long, n_tokens long"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    rows = _parted(keys.select("doc_id", "number"), parts).join(index.select("part", "path"), "part").select("doc_id", "number", "path").repartition("path").sortWithinPartitions("path")

    def run(batches):
        at, own = None, None
        for batch in batches:
            paths = batch.column(2).to_pylist()
            for path in dict.fromkeys(paths):
                if path != at:
                    at, own = path, Index(path)
                part = batch.filter(pa.array([p == path for p in paths]))
                known, shard, offset, count = own.find([key_bytes(d, k) for d, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)])
                columns = [part.column(0), part.column(1), pa.array(shard.astype(np.int32)), pa.array(offset.astype(np.int64)), pa.array(count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(known))

    return rows.mapInArrow(run, schema)


def read_ids(places: DataFrame, shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the shard files at the places that the index gave.

    ``shards``: (shard, path, n_ids, base), a row for each shard file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = places.join(shards, "shard").select("doc_id", "offset", "n_tokens", "base", "path").repartition("path").sortWithinPartitions("path", "offset")

    def run(batches):
        at, source, width = None, None, 0
        for batch in batches:
            out = []
            for doc_id, offset, n, base, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != at:
                    if source:
                        source.close()
                    at, source = path, open_file(path)
                    head = source.read(16)
                    if head[:8] != MAGIC:
                        raise ValueError(f"not a shard: {path}")
                    width = struct.unpack_from("<I", head, 12)[0]
                source.seek(16 + offset * width)
                ids = np.frombuffer(source.read(n * width), dtype=f"<u{width}").astype("<u4")
                if len(ids) != n:
                    raise ValueError(f"shard is cut short: {path}")
                out.append((doc_id, base + offset, n, zlib.crc32(ids.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [x.split(" ")[0] for x in schema.split(", ")])
        if source:
            source.close()

    return rows.mapInArrow(run, schema)


def store(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write shards and index of ``docs`` under ``folder``: (places, shards, index). Null texts are empty: the end id alone."""
    import public_tokenizers

    folder = folder or shared_dir(docs.sparkSession, "tokens")
    places = write_shards(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), f"{folder}/shards")
    sizes = places.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n_ids")).orderBy("shard").collect()  # a row for each file
    rows, base = [], 0
    for r in sizes:
        rows.append((r.shard, r.path, r.n_ids, base))
        base += r.n_ids
    shards = docs.sparkSession.createDataFrame(rows, "shard int, path string, n_ids long, base long")
    return places, shards, write_index(places, f"{folder}/index")


def write_and_read(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, start, n_tokens, ids_crc32, found through the index and read back from the shards.

    Null and empty texts have the end id alone; texts of any length are encoded whole. Null ids come first; rows that repeat an id
    all stay, in no set order among themselves. An empty table gives no rows; other columns are not
    read, whatever their names. It is an error if the index does not find every row that was written.
    """
    places, shards, index = store(docs, tokenizer, folder)
    found = materialise(look_up(places, index), "found")
    if (wanted := places.count()) != (got := found.count()):
        raise RuntimeError(f"the index finds {got} of {wanted} keys")
    return read_ids(found, shards)
