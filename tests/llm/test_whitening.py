import math

import numpy as np
import pytest

from lumentrack.llm import whitening
from lumentrack.llm.queries import QUERIES


def check(got, rows):
    """Compare with numpy on the whole list: rows (vec_id, vector)."""
    good = [(i, np.floor(256 * np.array(v, dtype=float)).astype(int)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s).astype(float) / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append(r)
    assert sum(map(len, found.values())) == len(good) * min(4, fit.shape[1])
    for k in range(min(4, fit.shape[1])):
        expect = {}
        for i, x in good:
            expect.setdefault(i, []).append(((n * x - s).astype(float) / n @ v[:, k] / math.sqrt(e[k]), int(sum(int(d) ** 2 for d in n * x - s))))
        sign = 0
        for i, values in expect.items():
            own = sorted(found[i, k + 1], key=lambda r: r.deviation)
            for r, (w, d) in zip(own, sorted(values, key=lambda t: t[1]), strict=True):
                sign = sign or math.copysign(1, r.whitened * w)
                assert r.n == n and r.deviation == d
                assert r.whitened == pytest.approx(sign * w, abs=1e-6)
                assert r.explained == pytest.approx(e[k] / np.trace(cov), rel=1e-6)
                assert 0 <= r.identity_error < 1e-9


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, d).collect(), rows)


def test_copies_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=5) * [5, 4, 3, 2, 1]]) for k in range(60)]
    rows += [(100 + k, rows[3][1]) for k in range(200)] + [(7, rows[9][1]), (300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [math.nan] * 5), (303, [math.inf, 0.0, 0.0, 0.0, 0.0]), (304, [-0.0, -0.001, 0.0, 1e-9, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, x int, white string").repartition(5)
    check(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 300")).count() == 0


def test_no_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(df).collect())
    assert got == [(v, c, 1, 0, None, None, None) for v in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.component, r.whitened, r.explained) for r in whitening.whiten(line).collect())
    assert got == [(1, 1, -1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)]
