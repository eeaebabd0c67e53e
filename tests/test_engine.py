import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from docuweave.functions import text as T
from docuweave.operators import graph as G
from docuweave.operators import vectors as V
from docuweave.plans import queries as Q

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, dict):
        v = tuple(v.values())
    if isinstance(v, (float, Decimal)):
        return float(v) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def table(names, rows):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, want = Q.QUERIES[name](spark, SF), con.execute(Q.ORACLE[name])
    assert table(got.columns, got.collect()) == table([d[0] for d in want.description], want.fetchall())


def test_clean_text(spark):
    cases = {"a \u2022 b": "a  b", "\u2022 a": " a", "  a\t\nb\u00a0c ": "a b c", "a\u001cb": "a b", "x\u0000y\uf0b7z": "xyz"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.clean_text(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_chunk_counts(spark):
    want = {0: 0, 1: 1, 7000: 1, 7001: 2, 13500: 2, 13501: 3, 15001: 3, 33000: 5, 33001: 6}
    rows = spark.createDataFrame([(n, "x" * n) for n in want], "n int, t string").select("n", F.size(T.chunks(F.col("t"), 7000, 500)).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == want
    with pytest.raises(ValueError):
        T.chunks(F.col("t"), 5, 5)


def test_modularity_of_two_triangles(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    c = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, cluster long")
    assert G.modularity(e, c).first()["modularity"] == pytest.approx(0.357142857)


@pytest.mark.parametrize(("quota", "want"), [(1, {"ab", "cd"}), (2, {"ab", "ac", "cd", "de"})])
def test_capped_edges(spark, quota, want):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.8), ("c", "d", 0.7), ("d", "e", 0.7), ("a", "e", 0.66)], "i string, j string, sim double")
    known = spark.createDataFrame([("c", "b")], "src string, dst string")
    assert {r["i"] + r["j"] for r in G.capped_edges(pairs, known, quota).collect()} == want


def test_capped_edges_as_the_loop_does(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, j, rnd.randint(1, 5) / 5) for i in range(12) for j in range(i + 1, 12) if rnd.random() < 0.6]
    left, want = dict.fromkeys(range(12), 2), set()
    for i, j, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if left[i] and left[j]:
            want.add((i, j))
            left[i] -= 1
            left[j] -= 1
    none = spark.createDataFrame([], "src long, dst long")
    got = G.capped_edges(spark.createDataFrame(rows, "i long, j long, sim double"), none, 2)
    assert {(r["i"], r["j"]) for r in got.collect()} == want


def test_similar_pairs_in_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(V, "BLOCK", 7)
    m = np.random.RandomState(1).standard_normal((40, 6))
    got = V.similar_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>"), 0.4)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if u[i] @ u[j] >= 0.4}
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_triangles_on_bits_in_many_colours(spark):
    import numpy as np

    from docuweave.operators import triangles as B

    rng = np.random.RandomState(3)
    ids = np.unique(np.concatenate([rng.randint(-(2**62), 2**62, 50), np.arange(30)]))
    drawn = [(int(ids[a]), int(ids[b])) for a, b in rng.randint(0, len(ids), (900, 2))]  # with loops, copies and both directions
    near = {int(x): set() for x in ids}
    for a, b in drawn:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {x: (len(s), sum(len(near[y] & s) for y in s) // 2) for x, s in near.items() if s}
    edges = spark.createDataFrame(drawn, "src long, dst long")
    for colours in (1, 2, 3, 6):
        assert {r["id"]: (r["k"], r["t"]) for r in B.triangles(edges, colours).collect()} == want
    joined = {r["id"]: (r["k"], r["t"] or 0) for r in G._triangles_joined(edges).collect()}
    assert joined == want
    assert B.triangles(edges.limit(0), 2).collect() == []
    a = [np.array([5, -(2**63), 2**63 - 1]), np.empty(0, np.int64)]
    assert [x.tolist() for x in B.unpack(B.pack(*a))] == [x.tolist() for x in a]


def test_min_max_of_a_constant(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0)], "id long, x double")
    assert {r["x"] for r in G.min_max(df, ["x"]).collect()} == {0.5}
