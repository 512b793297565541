"""Merkle manifest of a dataset: a digest a row, a root a source, one root of all, and a proof a row.

Rows of a source are leaves in order of their id. While a source has more than one node, each
run of three (the last may be shorter, even a single one) becomes the digest of its texts. The
sources' roots, in order of the sources, make the dataset's root in the same way.

The trees are climbed in blocks of 3^7 aligned leaves, which tasks hold one at a time. A block is
traversed in postorder: a call returns its subtree's digest, and appends the siblings of each child to
the leaves below it while it unwinds. Block roots are nodes seven levels up, so they feed
the next traversal of the same kind, until each tree has one root. A row's proof is what the traversals
that it passes through appended.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import remove, stored

#: Nodes of a run, and levels of a block.
FAN, LEVELS = 3, 7
BLOCK = FAN**LEVELS
_STEPS = "array<struct<l:string,r:string>>"
_ARROW_STEPS = pa.struct([("l", pa.string()), ("r", pa.string())])


def digest(*fields: Column) -> Column:
    """sha256 in lowercase hex of the fields one after another: ``-`` for null, else UTF-8 bytes, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def leaf(text: Column | None = None) -> Column:
    """Digest of a row of documents, or of one with another text."""
    return digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text") if text is None else text)


def _below(nodes: list[str], start: int, level: int, steps: list[list[tuple[str, str]]]) -> str:
    """Digest of the subtree of this level that begins at leaf ``start``; its leaves' steps grow by a pair (left, right) a level."""
    if level == 0:
        return nodes[start]
    width = FAN ** (level - 1)
    starts = range(start, min(start + FAN * width, len(nodes)), width)
    digests = [_below(nodes, s, level - 1, steps) for s in starts]
    for k, s in enumerate(starts):
        step = ("".join(digests[:k]), "".join(digests[k + 1 :]))
        for own in steps[s : s + width]:
            own.append(step)
    return sha256("".join(digests).encode()).hexdigest()


def _height(block: int, n: int) -> int:
    """Levels of a block: all, but for the only block of a small tree, which ends where one node remains."""
    level = 0
    while level < LEVELS and (block or FAN**level < n):
        level += 1
    return level


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, str]:
    """``rows`` with ``i``, their number within their ``tree`` by ``order``, nulls first; and the folder they are stored in.

    Rows are sorted over all tasks by ranges of (tree, order), so a tree of any size is spread. A task numbers its own; only its
    first tree may have rows in tasks before it, and their number is found from a row a task at the driver.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("task", F.spark_partition_id())
    schema = StructType([*dealt.schema.fields]).add("run", "long").add("own", "long")

    def run(batches):
        tree, number, at = object(), -1, 0
        for batch in batches:
            trees = batch.column(batch.schema.get_field_index("tree")).to_pylist()
            runs, owns = np.empty(len(trees), np.int64), np.empty(len(trees), np.int64)
            for k, t in enumerate(trees):
                if t != tree:
                    tree, number, at = t, number + 1, 0
                runs[k], owns[k] = number, at
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(owns)], [*batch.schema.names, "run", "own"])

    kept, path = stored(dealt.mapInArrow(run, schema), "numbered")
    place = F.struct("run", "own")
    ends = kept.groupBy("task").agg(F.min_by("tree", place).alias("first"), F.max_by("tree", place).alias("last"), F.max(place).alias("end")).orderBy("task").collect()  # a row a task
    before, tree, n = [], None, 0
    for e in ends:
        before.append((e.task, n if e.first == tree else 0))
        n = e.end.own + 1 + (before[-1][1] if e.end.run == 0 else 0)
        tree = e.last
    offsets = rows.sparkSession.createDataFrame(before, "task int, before long")
    i = F.col("own") + F.when(F.col("run") == 0, F.col("before")).otherwise(0)
    return kept.join(F.broadcast(offsets), "task").select(*rows.columns, i.alias("i")), path  # a row a task


def traverse(nodes: DataFrame) -> tuple[DataFrame, str]:
    """(tree, i, node, ...) -> the same with block, steps (siblings left and right, level by level) and, on a block's first row, root; and the folder."""
    rows = nodes.withColumn("block", F.floor(F.col("i") / BLOCK)).repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    names = [*rows.columns, "steps", "root"]

    def walk(table):
        trees, blocks, digests = (table.column(c).to_pylist() for c in ("tree", "block", "node"))
        lefts, rights, ends, roots, start = [], [], [0], [], 0
        while start < len(trees):
            end = start
            while end < len(trees) and (trees[end], blocks[end]) == (trees[start], blocks[start]):
                end += 1
            steps: list[list[tuple[str, str]]] = [[] for _ in range(start, end)]
            roots += [_below(digests[start:end], 0, _height(blocks[start], end - start), steps), *[None] * (end - start - 1)]
            for own in steps:
                lefts += [s[0] for s in own]
                rights += [s[1] for s in own]
                ends.append(len(lefts))
            start = end
        found = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(_ARROW_STEPS))
        columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), pa.array(roots, pa.string())]
        for batch in table.append_column("steps", columns[0]).append_column("root", columns[1]).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    def run(batches):
        held = []  # rows of the block that may go on
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            keys = list(zip(table.column("tree").to_pylist(), table.column("block").to_pylist(), strict=True))
            cut = len(keys) - 1
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if cut:
                yield from walk(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
        if held:
            yield from walk(pa.Table.from_batches(held).combine_chunks())

    schema = StructType([*rows.schema.fields]).add("steps", ArrayType(StructType().add("l", "string").add("r", "string"))).add("root", "string")
    return stored(rows.mapInArrow(run, schema), "blocks")


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(first traversal, steps above each of its blocks (tree, block, above), roots (tree, root), folders)."""
    first, path = traverse(nodes)
    levels, folders = [first], [path]
    tops = lambda df: df.where("root IS NOT NULL").select("tree", F.col("block").alias("i"), F.col("root").alias("node"))
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        level, path = traverse(tops(levels[-1]))
        levels.append(level)
        folders.append(path)
    above = tops(levels[-1]).select("tree", F.col("i").alias("block"), F.array().cast(_STEPS).alias("above"))
    for level in reversed(levels[1:]):
        above = level.select("tree", "block", "i", "steps").join(above, ["tree", "block"]).select("tree", F.col("i").alias("block"), F.concat("steps", "above").alias("above"))
    return first, above, tops(levels[-1]).select("tree", F.col("node").alias("root")), folders


def manifest(leaves: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, ...) -> the same with subroot, root and steps, the row's proof.

    Leaves of a source are in order of doc_id, nulls first; rows that repeat an id are in order of their
    digests, and equal rows are leaves of their own. A null source comes before all others. An empty table gives no rows. Other
    columns stay. Nothing but a row a task and the one root reaches the driver.
    """
    spark = leaves.sparkSession
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))  # keeps the order
    rows, place = numbered(leaves.withColumn("tree", tree).withColumn("node", F.col("leaf")), ["doc_id", "leaf"])
    first, above, subroots, folders = _climb(rows)
    subroots, kept = stored(subroots, "subroots")
    sources, other = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node")), ["source"])
    upper, over, roots, more = _climb(sources)
    root = roots.select("root").first()  # one row at most
    ends = upper.join(over, ["tree", "block"]).select(F.col("source").alias("tree"), F.col("node").alias("subroot"), F.concat("steps", "above").alias("top"))
    above, held = stored(above.join(ends, "tree").select("tree", "block", "subroot", F.concat("above", "top").alias("above")), "proofs")
    remove(spark, place, kept, other, *folders[1:], *more)
    steps = F.concat("steps", "above").alias("steps")
    return first.join(above, ["tree", "block"]).select(*leaves.columns, "subroot", F.lit(root and root.root).cast("string").alias("root"), steps)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["l"], s["r"]))), 256)


def verify(rows: DataFrame, leaf_column: str = "leaf") -> DataFrame:
    """Rows of a ``manifest`` with folded_root, from ``leaf_column`` and the steps, and verified: whether it is the root."""
    return rows.withColumn("folded_root", folded(F.col(leaf_column), F.col("steps"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed): changed is the leaf after line ends are deleted where the crc32 of the id is even; null ids, texts without line ends and null texts are as they were."""
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    differs = F.coalesce(F.contains(F.col("text"), F.lit("\n")), F.lit(False))
    return docs.select("doc_id", "source", leaf().alias("leaf"), F.when(differs, leaf(text)).alias("changed")).withColumn("changed", F.coalesce("changed", "leaf"))


def check_tampering(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of documents, whose texts are tampered with after the manifest is made.

    Null columns, empty and long texts are digested as they are; repeated rows are leaves of their own; an
    empty table gives no rows; columns that the digest doesn't name are not read, whatever their names.
    """
    rows = verify(manifest(tampered(docs)), "changed")
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || {c} END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _up(name: str, base: str) -> str:
    """Levels of a tree over ``base`` (g, i, node, n), and the siblings of each node (g, lv, i, l, r)."""
    return f"""{name} AS (SELECT g, 0 AS lv, i, node, n FROM {base} UNION ALL SELECT g, lv + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lv, i // 3),
{name}_s AS (SELECT a.g, a.lv, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name} a JOIN {name} b ON a.g = b.g AND a.lv = b.lv AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL)"""


def _fold(name: str, base: str, up: str) -> str:
    """Rows (id, g, i, proof, acc) of ``base`` taken up the tree."""
    return f"""{name} AS (SELECT id, g, 0 AS lv, i, proof, acc FROM {base} UNION ALL SELECT f.id, f.g, f.lv + 1, f.i // 3, f.proof || s.l || s.r, sha256(s.l || f.acc || s.r) FROM {name} f JOIN {up}_s s ON s.g = f.g AND s.lv = f.lv AND s.i = f.i),
{name}_e AS (SELECT id, arg_max(proof, lv) AS proof, arg_max(acc, lv) AS acc FROM {name} GROUP BY id)"""


#: DuckDB has no crc32: the usual shifts over the digits' bits.
ORACLE_SQL = f"""WITH RECURSIVE dc AS (SELECT *, row_number() OVER () AS id, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc FROM documents),
lf AS (SELECT id, doc_id, coalesce('=' || source, '') AS g, {_LEAF('text')} AS leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF('text')} END AS changed FROM dc),
nd AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM lf),
{_up('ua', 'nd')},
sr AS (SELECT g AS id, '' AS g, node, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM ua WHERE n = 1),
{_up('ub', 'sr')},
pa AS (SELECT id, g, i, '' AS proof, changed AS acc FROM nd), {_fold('fa', 'pa', 'ua')},
pb AS (SELECT nd.id, sr.g, sr.i, proof, acc FROM fa_e JOIN nd USING (id) JOIN sr ON sr.id = nd.g), {_fold('fb', 'pb', 'ub')}
SELECT doc_id, leaf, sr.node AS subroot, ub.node AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = ub.node AS verified FROM nd JOIN fb_e USING (id) JOIN sr ON sr.id = nd.g JOIN ub ON ub.n = 1"""
