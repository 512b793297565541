"""Every query with SQL gives DuckDB's rows; the kernels without SQL give values known in closed form."""

import math

import duckdb
import numpy as np
import pytest

from lumentrack import queries
from lumentrack.operators import raster, trajectory
from lumentrack.operators.requests import accepted

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", autouse=True)
def views():
    for t in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    df = queries.QUERIES[name](spark, D)
    rel = duckdb.sql(queries.ORACLE_SQL[name])
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(map(clean, r)) for r in df.select(*names).collect()), key=str)
    assert got == sorted((tuple(map(clean, r)) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, D).count() > 0


def test_borders():
    square = np.zeros((8, 8), bool)
    square[1:6, 1:6] = True
    assert raster._trace(square) == (16.0, 1)
    line = np.zeros((8, 8), bool)
    line[3, 1:7] = True
    assert raster._trace(line) == (10.0, 1)
    dot = np.zeros((8, 8), bool)
    dot[0, 0] = True
    assert raster._trace(dot) == (0.0, 1)
    dot[2, 2] = dot[1, 1] = dot[7, 0] = True
    length, n = raster._trace(dot)
    assert n == 2 and math.isclose(length, 4 * math.sqrt(2))
    assert raster._trace(np.zeros((8, 8), bool)) == (0.0, 0)
    assert raster._trace(np.ones((8, 8), bool)) == (28.0, 1)


def test_short_tracks(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 1.0, 2.0, 3.0), (2, 0, 0.0, 0.0, 0.0, 0.0), (2, 1, 0.0, 9.0, 0.0, 0.0)], "obj_id int, pos int, t double, x double, y double, z double")
    assert {r.obj_id: r.motion_type for r in trajectory.summary(trajectory.smooth(p)).collect()} == {1: "stationary", 2: "stationary"}
    moved = {(r.obj_id, r.pos): round(r.x, 6) for r in trajectory.clamp_speed(p, 10.0).collect()}
    assert moved == {(1, 0): 1.0, (2, 0): 0.0, (2, 1): 0.33}
    assert {r.obj_id: r.conformance for r in trajectory.gravity_fit(p).collect()} == {1: 1.0, 2: 1.0}
    assert trajectory.turns(p).count() == 0


def test_rate_limit(spark):
    r = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 60.5, 61.5, 61.6])] + [(2, 9, 0.0)], "key int, id int, at double")
    got = {x.id: x.accepted for x in accepted(r, 60.0, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 9: True}
