"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item with n distinct shingles is contained in a document at threshold t if at least
``ceil(t * n)`` of them occur there. Then the document holds at least one of the item's
``n - ceil(t * n) + 1`` shingles of least hash: its MinHash sketch. Items are partitioned by
size (powers of two of n), since the sketch length, the largest hash that any sketch of the
partition holds, and the fewest shingles that a document must have all follow from the size.
A document probes a partition only if it is long enough for it and only with hashes up to that
partition's largest; as a hash is sent once for all partitions, a document's bound is the greatest of those it is long enough for.
A hit is a hash and ids. Pairs that share a sketch hash are verified: the item's shingles, as text,
against the document's. No containing pair is lost.

Documents are read once to probe, and those with hits once more to verify; no document's text is
shuffled but for these, once each, and only where the pairs are too many to broadcast.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, held, materialise

#: Sketch rows (a hash, ids and a count, under 50 bytes each), and ids of documents with hits, are broadcast up to this number; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))


def shingled(items: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(item_id, own, k, shingles, n, need, part) of each item; own tells apart rows of one id. Items without a word are left out."""
    words = items.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    k = F.least(F.size("words"), F.lit(shingle))
    grams = words.select("item_id", k.alias("k"), F.array_distinct(_shingles(F.col("words"), k)).alias("shingles"))
    n = F.size("shingles")
    need = F.ceil(F.round(F.lit(threshold) * n, 9)).cast("int")
    return grams.select("item_id", F.xxhash64("shingles").alias("own"), "k", "shingles", n.alias("n"), need.alias("need"), F.floor(F.log2(n)).cast("int").alias("part"))


def sketches(items: DataFrame) -> DataFrame:
    """``shingled`` items -> (h, item_id, own, k, need, part): a row for each sketch hash of an item."""
    hashed = F.sort_array(F.transform("shingles", lambda s: F.xxhash64(s)))
    return items.select("item_id", "own", "k", "need", "part", F.explode(F.slice(hashed, 1, F.col("n") - F.col("need") + 1)).alias("h"))


def hits(docs: DataFrame, found: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc_id, of, item_id, own) of documents and items that share a sketch hash; ``of`` tells apart rows of one doc_id."""
    parts = found.groupBy("k", "part").agg(F.max("h").alias("top"), F.min("need").alias("need"), F.count("*").alias("rows")).collect()  # at most a row for each power of two and k
    keys = docs.select("doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", normal_words(F.col("text")).alias("words"))
    keys = keys.select("doc_id", held(words=F.col("words"))).select("doc_id", "words", F.xxhash64("words").alias("of"), F.size("words").alias("size"))
    small = sum(p.rows for p in parts) <= broadcast_rows
    every = []
    for k in sorted({p.k for p in parts}):
        fits = [p for p in parts if p.k == k]
        bound = F.greatest(*[F.when(F.col("size") >= p.need + k - 1, p.top) for p in fits], F.lit(None).cast("long"))  # nulls are passed over
        at = F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("at")
        gram = F.concat_ws(" ", *[F.get("words", F.col("at") + j) for j in range(k)])
        probe = keys.withColumn("bound", bound).where("bound IS NOT NULL").select("doc_id", "of", "size", "bound", "words", at)
        probe = probe.select("doc_id", "of", "size", "bound", F.xxhash64(gram).alias("h")).where("h <= bound").drop("bound")
        own = found.where(F.col("k") == k).select("h", "item_id", "own", "need")
        own = F.broadcast(own) if small else own.hint("shuffle_hash")
        every.append(probe.join(own, "h").where(F.col("size") >= F.col("need") + k - 1).select("doc_id", "of", "item_id", "own"))
    if not every:
        return keys.where("false").crossJoin(found.where("false")).select("doc_id", "of", "item_id", "own")  # neither side has a row
    return reduce(DataFrame.unionByName, every).distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment) of every document and item whose containment reaches ``threshold``.

    Words are lower-cased runs of letters and digits. Items of fewer than ``shingle`` words
    form one shingle; items without a word, null texts and empty documents match nothing; texts of any
    length are read whole. Of repeated ids each row is matched by itself and the best containment is kept
    (of equal ones any: they are alike), so each pair occurs once; null ids count as one id. An
    empty table on either side gives no rows. Documents and items may have further columns,
    whatever their names; they are not read.
    """
    known = materialise(shingled(items, threshold, shingle), "items")
    found = materialise(sketches(known), "sketches")
    pairs = materialise(hits(docs, found, broadcast_rows), "hits")
    ids = materialise(pairs.select(F.col("doc_id").alias("_id")).distinct(), "hit-ids")
    few = ids.count() <= broadcast_rows
    read = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    read = read.select("doc_id", held(words=normal_words(F.col("text")))).select(F.col("doc_id").alias("_id"), "words", F.xxhash64("words").alias("_of"))
    asked = pairs.join(known.dropDuplicates(["item_id", "own"]), pairs.item_id.eqNullSafe(known.item_id) & (pairs.own == known.own)).select("doc_id", "of", pairs.item_id, "k", "n", "need", "shingles")
    both = read.join(asked, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_of") == F.col("of")))
    shared = F.size(F.array_intersect("shingles", _shingles(F.col("words"), F.col("k"))))
    best = both.select("doc_id", "item_id", "n", "need", shared.alias("shared")).where("shared >= need").groupBy("doc_id", "item_id").agg(F.max_by(F.struct("shared", "n"), F.struct(F.col("shared") / F.col("n"), "n")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.shared").cast("long").alias("shared"), F.col("m.n").cast("long").alias("n_shingles"), F.round(F.col("m.shared") / F.col("m.n"), 6).alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose id holds no item.

    Rows without an id cannot be told apart and stay; of repeated ids all rows go if one holds an
    item. Null and empty texts stay; an empty table on either side changes nothing.
    """
    leaked = materialise(contained(docs, items, threshold, shingle).select("doc_id").where("doc_id IS NOT NULL").distinct(), "leaked")
    return by_ids(docs, leaked, "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH w AS (SELECT 'd' AS k, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
g AS (SELECT DISTINCT k, id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT k, id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM g WHERE k = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(n.n) AS n_shingles, round(count(*) / any_value(n.n), 6) AS containment
FROM g d JOIN g i ON d.s = i.s AND d.k = 'd' AND i.k = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= ceil(round(0.8 * any_value(n.n), 9))
"""
