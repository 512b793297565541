"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become integers on a grid, so that sums and centring are exact: a vector x of n distinct
ones with sums S is centred as n*x - S, in whole numbers. MLlib's RowMatrix adds up the products of the centred
rows on the executors, which gives the covariance; a dense eigendecomposition of that matrix, whose size is set by
the dimension alone, is done at the driver; and its leading vectors are broadcast to the tasks that project the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import remove, stored

#: Grid steps in a unit, and components returned.
GRID, COMPONENTS = 256, 4
#: Components whose share of the largest eigenvalue is less hold rounding only.
LEAST = 1e-12


@dataclass
class Whitening:
    """What was fitted: n distinct vectors, their sums, covariance, eigenvalues and unit eigenvectors (columns), by falling eigenvalue."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def explained(self, k: int) -> float | None:
        total = float(np.trace(self.covariance))
        return float(self.values[k]) / total if total > 0 else None

    def matrix(self, k: int) -> np.ndarray:
        """Projects n*x - S on k components, over n and the root of the eigenvalue; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values[:k] > LEAST * max(self.values[0], 0.0), 1 / (self.n * np.sqrt(np.maximum(self.values[:k], 0))), np.nan)
        return self.vectors[:, :k] * scale


def grid(embedding: Column) -> Column:
    """The vector as whole grid steps, rounded down; null if it is null or holds null or non-finite entries."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda v: F.floor(v.cast("double") * GRID).cast("long")))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of the vectors of an array<double> column."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def centred(x: Column, fitted: Whitening) -> Column:
    """n*x - S in whole numbers, as array<long>; overflow is an error."""
    sums = F.array(*[F.lit(int(s)) for s in fitted.sums])
    return F.zip_with(x, sums, lambda v, s: v * F.lit(fitted.n) - s)


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of distinct vectors (x array<long>, all of one length); None if there are none.

    Centred entries below 2^53 are exact as doubles: n times the range of an entry may reach so far.
    """
    first = vectors.select(F.size("x")).first()
    if first is None or first[0] == 0:
        return None
    d = first[0]
    sums = vectors.agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(k))) for k in range(d)]).alias("s")).first()
    own = Whitening(sums.n, np.array(sums.s, dtype=np.int64), np.zeros((d, d)), np.zeros(d), np.eye(d))
    product = gramian(vectors.select(F.transform(centred(F.col("x"), own), lambda v: v.cast("double")).alias("c")), "c")
    own.covariance = product / own.n / own.n / own.n
    values, basis = np.linalg.eigh((own.covariance + own.covariance.T) / 2)
    own.values, basis = values[::-1].copy(), basis[:, ::-1].copy()
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(d)])  # the largest entry of each is positive
    own.vectors = basis * np.where(signs == 0, 1, signs)
    return own


def project(rows: DataFrame, fitted: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(..., c array<long>, centred) -> the same with white array<double>, a component each; null where a component has no variance."""
    matrix = rows.sparkSession.sparkContext.broadcast(fitted.matrix(components))  # the dimension times the components
    schema = StructType([*rows.schema.fields]).add("white", ArrayType(DoubleType()))

    def run(batches):
        w = matrix.value
        for pdf in batches:
            white = np.stack(pdf["c"].to_numpy()).astype(np.float64) @ w if len(pdf) else np.zeros((0, w.shape[1]))
            yield pdf.assign(white=pd.Series(list(np.where(np.isnan(white), None, white)), index=pdf.index, dtype=object))

    return rows.mapInPandas(run, schema)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows with whole, finite vectors of the length that most of them have (of equally many, the greatest)."""
    rows = embeddings.select("vec_id", grid(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component up to ``components``.

    Null vectors and those with null, NaN or infinite entries are left out, and vectors of another length than most. The fit takes each distinct
    vector once, so copies don't count; all rows, copies and repeated ids included, are projected. ``whitened`` is null for
    a component without variance (fewer distinct vectors than components, for one), and explained is null if there is no variance at all.
    ``identity_error`` is measured on the whitened fit list, over the components that have variance. An empty table gives no rows; other columns
    are not read, whatever their names.
    """
    spark = embeddings.sparkSession
    distinct, path = stored(usable(embeddings).select("x").distinct(), "distinct")
    fitted = fit(distinct)
    if fitted is None:
        remove(spark, path)
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = min(components, len(fitted.sums))
    error = identity_error(project(distinct.select(centred(F.col("x"), fitted).alias("c")), fitted, k), fitted, k)
    remove(spark, path)
    rows = usable(embeddings).select("vec_id", centred(F.col("x"), fitted).alias("c"))
    out = project(rows, fitted, k).select("vec_id", F.aggregate("c", F.lit(0).cast("long"), lambda t, v: t + v * v).alias("deviation"), F.posexplode("white").alias("at", "whitened"))
    shares = F.array(*[F.lit(fitted.explained(j)).cast("double") for j in range(k)])
    return out.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(white: DataFrame, fitted: Whitening, components: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity; None without a component that has variance."""
    live = [j for j in range(components) if np.isfinite(fitted.matrix(components)[:, j]).all()]
    if not live:
        return None
    own = F.array(*[F.get("white", F.lit(j)) for j in live])
    means = white.agg(*[F.avg(F.get("white", F.lit(j))) for j in live]).first()
    shifted = F.zip_with(own, F.array(*[F.lit(float(m)) for m in means]), lambda v, m: v - m)
    return float(np.abs(gramian(white.select(shifted.alias("c")), "c") / fitted.n - np.eye(len(live))).max())
