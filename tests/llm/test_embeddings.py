import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from airlake.llm import embeddings
from airlake.llm.embeddings import near_duplicates

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def expected(rows, threshold=0.98):
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, v, lab) in enumerate(rows):
        for j in range(i):
            _, w, other = rows[j]
            if lab is None or lab != other or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            a, b = np.asarray(v, "f4").astype(float), np.asarray(w, "f4").astype(float)
            if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known) if known else None
    return Counter((d, links[i], least[find(i)], d is not None and d == least[find(i)]) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [embeddings.TILE, 4])
def test_planted_clusters(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for _ in range(6):
            x = rng.normal(size=24)
            for _ in range(6):
                rows.append((len(rows), (x + rng.normal(size=24) * rng.uniform(0.02, 0.25)).tolist(), label))
    rows += [(r[0] + 1000, r[1], 0) for r in rows[:5]] + [(None, rows[0][1], 0), (3, rows[3][1], 0)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [float("nan")] + [1.0] * 23, 0),
             (2004, [None] + [1.0] * 23, 0), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, [-0.0, 1.0], 1),
             (2008, [0.0, 1.0], 1), (2009, [float("inf")] + [1.0] * 23, 0), (2010, [1e-30] * 24, 1),
             (2011, [1e30] * 24, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F
    df = df.withColumn("v", F.lit(1)).withColumn("row", F.lit(2)).withColumn("class", F.lit(3))
    got = Counter(tuple(r) for r in near_duplicates(df).collect())
    assert got == expected(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_pruning_keeps_every_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 32)) * np.linspace(3, 0.1, 32)
    y = np.concatenate([x[:60] + rng.normal(size=(60, 32)) * 0.05, rng.normal(size=(50, 32))])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    ux, uy = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    for threshold in (0.5, 0.9, 0.98):
        assert (embeddings.compare(x, y, axes, threshold, 4) == (ux @ uy.T >= threshold)).all()


def test_very_large_and_very_small_vectors(spark):
    import duckdb

    from airlake.llm.oracle import OP10

    rows = [(1, [1e160, 2e160], 0), (2, [2e160, 4e160], 0), (3, [1e-170, 2e-170], 0), (4, [5e-324, 1e-323], 0),
            (5, [1.7e308, 1.7e308], 0), (6, [1.0, 1.0], 0), (7, [-1e160, -2e160], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert got == {r[0]: (r[1], r[2]) for r in con.execute(OP10).fetchall()}
