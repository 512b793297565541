"""SimHash near-duplicates: fingerprints, pivot distance tables, links at two bits or fewer, components.

Fingerprints that may link are brought together by blocks: two 64-bit values that differ
in at most two bits agree on two of four 16-bit blocks at least, so each value is keyed by
its six pairs of blocks. In a bucket, pairs are first compared by their rows of the pivot
table (the Hamming distances to fixed reference fingerprints): since distances obey the
triangle inequality, a pair whose rows differ by more than two in any coordinate cannot
link and is discarded. Survivors are verified on the fingerprints themselves.

A bucket of more than ``BUCKET`` values (thousands of near copies) is not paired: each of its
values x is sent to the 65 centres within one bit of it. Two values link exactly if they
share a centre, and a centre has at most 65 values, so edges from each centre's least value
to its others keep every connection at a cost linear in the number of values.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, materialise, spread_join
from .components import components
from .neardup import classes, with_sigs

MAX_BITS = 2
PIVOTS = 64
#: Buckets up to this size are paired; larger ones go by centres. Both ways are exact.
BUCKET = 32
_CHUNK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_values(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints: hashes of the numbers 0 to n-1."""
    return [xxhash.xxh64_intdigest(f"pivot {i}", 7) for i in range(n)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text; a bit is 1 if set in over half the shingle hashes. No word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < shingle:
        hashes = iter([xxhash.xxh64_intdigest(b" ".join(words), 42)])
        n = 1
    else:
        grams = zip(*(words[i:] for i in range(shingle)), strict=False)
        hashes = (xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams)
        n = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = np.fromiter(hashes, dtype="<u8", count=min(_CHUNK, n - at))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches):
        for batch in batches:
            found = [_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _far(a: Column, b: Column) -> Column:
    """The largest difference of two rows of the pivot table."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def links(values: DataFrame, bucket: int = BUCKET, pivots: int = PIVOTS) -> DataFrame:
    """Distinct fp -> edges (a, b): all linked pairs of small buckets, and for large ones edges that connect all that link."""
    block = lambda i: F.shiftright("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    key = [F.lit(n << 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for n, (i, j) in enumerate(combinations(range(4), 2))]
    keyed = values.select("fp", F.explode(F.array(*key)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(spread_join(keyed, sizes, "key"), "buckets")
    table = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))) for p in pivot_values(pivots)]
    small = met.where(F.col("n") <= bucket).select("key", "fp", F.array(*table).alias("row"))
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (_far(F.col("a.row"), F.col("b.row")) <= MAX_BITS))
    near = pairs.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    centres = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    met_at = met.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(centres).alias("centre"))
    around = met_at.groupBy("centre").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    star = around.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return near.union(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links).

    Null texts and texts without a word have fingerprint zero and link like any other; a bit set
    in exactly half the hashes is 0; texts of any length are taken whole. Repeated rows stay and
    share a component; null ids are never the least id, unless all of a component are null. An
    empty table gives no rows; other columns are not read, whatever their names.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    values = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "values")
    found = components(links(values.select("fp")))
    roots = materialise(values.join(found, values.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "roots")
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialise(spread_join(roots, ids, "root").select("fp", "component_id"), "classes")
    return spread_join(prints, of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of one document for each component: that of the least doc_id.

    Documents link where the Jaccard similarity of their shingles reaches ``similarity`` (see ``neardup``).
    Each row is judged by the component of its own text. Of rows that repeat a doc_id in one
    component the first by text stays (of equal texts any one); of rows without an id, those in a component with ids go,
    and of a component without any the first by text stays. Texts of any length count whole;
    an empty table gives no rows. Rows with an id of their own are joined out by it, so texts move
    only where ids are too many to broadcast, repeated or null.
    """
    every, of = classes(docs, shingle, similarity)
    ids = spread_join(every.where("doc_id IS NOT NULL"), of, "sig").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("keep"))
    ids = materialise(ids.where("n > 1 OR NOT keep"), "losers")
    known = docs.where("doc_id IS NOT NULL")
    single = by_ids(known, ids, "left_anti").select(*docs.columns)
    several = by_ids(known, ids.where("n > 1 AND keep"), "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
    rows = spread_join(with_sigs(several.select(*docs.columns), shingle), of, "sig").where("doc_id <=> component_id")
    first = rows.groupBy("root").agg(F.min_by("_row", F.struct("_row.text", F.xxhash64("_row"))).alias("_row"))
    return single.unionByName(first.select("_row.*").select(*docs.columns))
