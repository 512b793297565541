"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a logistic model on the features of
``text_features`` by minimising the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

whose gradient is reversed while the second term is below zero (those are the steps that would
fit the unlabelled negatives away). The class prior is estimated from the scores themselves:
the share of unlabelled text at or above a score is at least prior times the share of held-back
positives there, so the least upper bound of their ratio over the high scores estimates it.

Samples are bounded (``sample`` rows of either kind in expectation, by a hash of the id), so
what reaches the driver does not grow with the corpus; scoring reads every row's whole text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, unit_hash

#: Positives, and unlabelled rows, that the model is fitted on, in expectation; at most twice as many.
SAMPLE = 3000
_LINE = re.compile(rb"\n+")


def text_features(text: str | None) -> np.ndarray:
    """256 + 10 numbers for a whole text: square roots of byte shares, and measures of its words and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in _LINE.split(raw) if x]
    w = max(1, len(words))
    ascii_upper, ascii_lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    symbols = int(sum(counts[c] for c in b"#$%&*<>|=~^{}[]\\"))
    rest = [
        min(1.0, math.log1p(len(words)) / 10), float(len(words) < 10), float(len(words) < 30), min(3.0, (n / w - 1) / 6), len(set(words)) / w, len(set(lines)) / max(1, len(lines)),
        math.sqrt(ascii_upper / max(1, ascii_upper + ascii_lower)), math.sqrt(min(1.0, symbols / w)), math.sqrt(min(1.0, int(counts[33] + counts[63]) / w)), math.sqrt(int(counts[48:58].sum()) / n),
    ]
    return np.concatenate([np.sqrt(counts / n), rest]).astype(np.float32)


@dataclass
class Model:
    """Scaled logistic model."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from the scores of held-back positives and of unlabelled rows."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.8, 81))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + slack) / p))  # where the bound, with its margin of error, is least; the margin chooses the place and isn't added
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, rounds: int = 400, rate: float = 0.05, decay: float = 3.0) -> Model:
    """Non-negative PU risk by full-batch Adam; the prior is estimated in a first pass where not given. decay: L2 weight over the number of positives. Deterministic."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-2
    p, u = ((positive - mean) / scale).astype(np.float64), ((unlabelled - mean) / scale).astype(np.float64)

    def train(xp, xu, pi):
        w, b = np.zeros(p.shape[1]), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, rounds + 1):
            sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for x in (xp, xu))
            negative = -np.log(1 - su + 1e-12).mean() + pi * np.log(1 - sp + 1e-12).mean()
            gp = pi * (sp - 1) / len(sp)  # of prior * R_p(+)
            gn_u, gn_p = su / len(su), -pi * sp / len(sp)  # of R_u(-) - prior * R_p(-)
            if negative >= 0:
                cu, cp = gn_u, gp + gn_p
            else:
                cu, cp = -gn_u, -gn_p
            g = np.append(xu.T @ cu + xp.T @ cp + decay / len(p) * w, cu.sum() + cp.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        return w, b

    if prior is None:
        half = np.arange(len(p)) % 2 == 0
        w, b = train(p[half], u, 0.5)
        prior = estimate_prior(p[~half] @ w + b, u @ w + b)
    w, b = train(p, u, prior)
    return Model(mean, scale, w, float(b), prior)


def _sampled(rows: DataFrame, n: int, total: int) -> np.ndarray:
    """Features of about ``n`` of the rows, chosen by a hash of the id; texts of any length are read where they lie, whole."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_features(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "x"])

    part = rows.where(unit_hash(F.col("doc_id")) < n / max(1, total)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = part.mapInArrow(run, "doc_id long, x binary").orderBy("doc_id", "x").limit(2 * n).collect()
    return np.array([np.frombuffer(r.x, dtype=np.float32) for r in found], dtype=np.float32).reshape(len(found), 266)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from positives and a sample of all rows, both outside fold 2; None if either has under ten rows. Of repeated labels the least counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    positive = known.where("quality = 1").select("doc_id")
    free = docs.select("doc_id", "text").where("doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 2)
    n_positive, n_all = positive.count(), free.count()
    chosen = positive.where(unit_hash(F.col("doc_id")) < sample / max(1, n_positive))
    p = _sampled(free.where(unit_hash(F.col("doc_id")) < sample / max(1, n_positive)).join(chosen, "doc_id"), sample, n_positive)
    u = _sampled(free, sample, n_all)
    return fit_pu(p, u) if len(p) >= 10 and len(u) >= 10 else None


def scores(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns ``keep`` and, as ``out``, the score (0 to 1) of every row; 0.5 without a model. Null texts score as empty ones."""
    rows = docs.select(*[k for k in keep if k != "text"], "text")
    fields = [f for f in rows.schema.fields if f.name != "text" or "text" in keep]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.full(batch.num_rows, 0.5)
            for lo in range(0, batch.num_rows if model else 0, 256):
                x = np.array([text_features(t.as_py()) for t in texts[lo : lo + 256]])
                found[lo : lo + 256] = model.score(x)
            columns = batch.columns if "text" in keep else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], [*(f.name for f in fields), out])

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``least`` or more; all rows where too few labels allow no model.

    Null and empty texts are scored as empty; equal texts have equal fates; an empty table gives
    no rows; texts of any length are scored whole.
    """
    out = "_quality_score"
    if (model := fit(docs, labels)) is None:
        return docs
    return scores(docs, model, tuple(docs.columns), out).where(F.col(out) >= least).select(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= ``least``, also where they are equal) of every row.

    Null texts score as empty ones; texts of any length are read whole; repeated rows score
    alike; too few labels for a model: every score is 0.5; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
