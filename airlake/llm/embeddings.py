"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes of the corpus, which leaves
their products as they are and gathers most of them in the leading dimensions.
Tiles of vectors are compared block of dimensions by block; what the remaining
dimensions can add is at most the product of the two suffix norms, and a pair
is dropped as soon as its cosine cannot reach the threshold. What is left is
verified with the unrotated vectors in double precision.

Vectors that are equal are one class from the start. Classes are sorted into
bands along the first axis, as wide as two linked vectors can lie apart, so
only equal or neighbouring bands meet; a band with more than ``TILE`` classes
is dealt to several tiles, and each pair of tiles is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm.graph import components
from airlake.session import cut_lineage

TILE = 1024
DIM_STEP = 16
SLACK = 1e-9   # rounding of rotated products; verified products have none


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each distinct (label, vector): its smallest vec_id and the
    number of rows. Unusable vectors are left out."""
    usable = (F.col("label").isNotNull() & F.col("v").isNotNull()
              & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists("v", lambda x: x != 0))
    # 0.0 + x turns a negative zero into zero, so that equal vectors group
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    return (vectors.where(usable).withColumn("v", plain)
            .groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("rows"))
            .withColumn("class", F.monotonically_increasing_id()))


def _scaled(v):
    """Each row divided by the power of two at its largest component: exact,
    and squares of very large and very small vectors stay in range."""
    import numpy as np

    _, exponent = np.frexp(np.abs(v).max(1, keepdims=True))
    return np.ldexp(v, -exponent)


def _unit(v):
    import numpy as np

    scaled = _scaled(v)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _axes(classes: DataFrame) -> dict:
    """dimension -> principal axes (columns). Sums of products are made per
    task and added up by Spark; a number of sums that depends on the dimension
    only reaches the driver."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        sums = {}
        for batch in batches:
            by_dim = {}
            for v in batch["v"]:
                by_dim.setdefault(len(v), []).append(v)
            for d, rows in by_dim.items():
                u = _unit(np.asarray(rows, float))
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, s in sums.items():
            yield pd.DataFrame({"dim": d, "i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d),
                                "sum": s.ravel()})

    out = {}
    found = (classes.select("v").mapInPandas(run, "dim int, i int, j int, sum double")
             .groupBy("dim", "i", "j").agg(F.sum("sum").alias("sum")))
    for r in found.collect():
        out.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.i, r.j] = r["sum"]
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in out.items()}


def _tiles(classes: DataFrame, axes: dict, threshold: float) -> DataFrame:
    """class, label, dim, v, band, tile, low, high: a row for each pair of
    tiles that a class takes part in."""
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    shared = classes.sparkSession.sparkContext.broadcast({d: a[:, 0] for d, a in axes.items()})

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            first = [float(_unit(np.asarray([v], float))[0] @ shared.value[len(v)]) for v in batch["v"]]
            yield batch.assign(dim=[len(v) for v in batch["v"]], band=[math.floor(x / width) for x in first])

    banded = cut_lineage(classes.select("class", "label", "rows", "v").mapInPandas(
        run, "class bigint, label string, rows bigint, v array<double>, dim int, band int"))
    counts = banded.groupBy("label", "dim", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    above = counts.select("label", "dim", (F.col("band") - 1).alias("band"), F.col("tiles").alias("tiles_above"))
    below = counts.select("label", "dim", (F.col("band") + 1).alias("band"), F.col("tiles").alias("tiles_below"))
    sizes = counts.join(above, ["label", "dim", "band"], "left").join(below, ["label", "dim", "band"], "left")
    placed = banded.join(sizes, ["label", "dim", "band"]).withColumn(
        "tile", F.expr("cast(pmod(xxhash64(class), tiles) as int)"))
    # all tile pairs of the own band, and every tile of the bands beside it
    own = F.expr("transform(sequence(0, tiles - 1), t -> struct(band as band, least(tile, t) as low, "
                 "band as band2, greatest(tile, t) as high))")
    up = F.expr("if(tiles_above is null, array(), transform(sequence(0, tiles_above - 1), t -> "
                "struct(band as band, tile as low, band + 1 as band2, t as high)))")
    down = F.expr("if(tiles_below is null, array(), transform(sequence(0, tiles_below - 1), t -> "
                  "struct(band - 1 as band, t as low, band as band2, tile as high)))")
    return (placed.withColumn("pair", F.explode(F.concat(own, up, down)))
            .select("class", "rows", "label", "dim", "v", F.col("band").alias("own_band"), "tile", "pair"))


def compare(x, y, axes, threshold: float, step: int = DIM_STEP):
    """Boolean matrix: which rows of ``x`` and ``y`` reach the threshold."""
    import numpy as np

    ux, uy = _unit(x), _unit(y)
    rx, ry = ux @ axes, uy @ axes
    # norms of what follows each dimension
    suffix = lambda r: np.sqrt(np.maximum(np.cumsum((r * r)[:, ::-1], 1)[:, ::-1], 0))
    sx, sy = suffix(rx), suffix(ry)
    rows, cols = np.arange(len(x)), np.arange(len(y))
    partial = np.zeros((len(x), len(y)))
    dims = rx.shape[1]
    for d in range(0, dims, step):
        partial += rx[rows, d:d + step] @ ry[cols, d:d + step].T
        if d + step >= dims:
            break
        alive = partial + sx[rows, d + step][:, None] * sy[cols, d + step][None, :] >= threshold - SLACK
        live_rows, live_cols = alive.any(1), alive.any(0)
        if not live_rows.any():
            return np.zeros((len(x), len(y)), bool)
        if live_rows.sum() < 0.75 * len(rows) or live_cols.sum() < 0.75 * len(cols):
            partial = partial[live_rows][:, live_cols]
            rows, cols = rows[live_rows], cols[live_cols]
    out = np.zeros((len(x), len(y)), bool)
    i, j = np.nonzero(partial >= threshold - SLACK)
    i, j = rows[i], cols[j]
    for k in range(0, len(i), 1 << 16):  # the exact check, on what is left
        a, b = x[i[k:k + (1 << 16)]], y[j[k:k + (1 << 16)]]
        a, b = _scaled(a), _scaled(b)
        cosine = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        out[i[k:k + (1 << 16)], j[k:k + (1 << 16)]] = cosine >= threshold
    return out


def _roots(linked):
    """Smallest node of every node's component in a two-sided graph: nodes are
    rows 0..n-1 and columns n..n+m-1 of ``linked``."""
    import numpy as np

    n, m = linked.shape
    row, col = np.arange(n), np.full(m, n + m)
    while True:
        new_col = np.minimum(np.where(linked, row[:, None], n + m).min(0, initial=n + m), col)
        new_row = np.minimum(np.where(linked, new_col[None, :], n + m).min(1, initial=n + m), row)
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for ``vectors(vec_id, embedding,
    label)``: one row per input row, links only between equal labels.

    A vector that is null, empty, zero or holds null or non-finite components,
    and one with a null label, links with nothing and is its own component.
    Vectors of different lengths do not link. Rows with equal vectors and
    labels link with each other; a repeated vec_id is counted row by row. A
    null vec_id takes part; the component is the smallest known vec_id. An
    empty table gives no rows.
    """
    source = cut_lineage(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v")))
    classes = cut_lineage(_classes(source))
    axes = _axes(classes)
    shared = classes.sparkSession.sparkContext.broadcast(axes)
    tiles = _tiles(classes, axes, threshold)

    def run(pdf):
        import numpy as np
        import pandas as pd

        pair = pdf["pair"].iloc[0]
        same = pair["band"] == pair["band2"] and pair["low"] == pair["high"]
        first = ((pdf["own_band"] == pair["band"]) & (pdf["tile"] == pair["low"])).to_numpy()
        a, b = (pdf, pdf) if same else (pdf[first], pdf[~first])
        if not len(a) or not len(b):
            return pd.DataFrame({"class": [], "root": [], "links": []}).astype("int64")
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        linked = compare(x, y, shared.value[x.shape[1]], threshold)
        if same:
            linked |= linked.T
            np.fill_diagonal(linked, False)
        ids = np.concatenate([a["class"].to_numpy(), b["class"].to_numpy()])
        sizes = [b["rows"].to_numpy(), a["rows"].to_numpy()]
        row, col = _roots(linked if not same else linked | np.eye(len(x), dtype=bool))
        links = np.concatenate([linked @ sizes[0], linked.T @ sizes[1]])
        root = np.concatenate([row, col])
        out = pd.DataFrame({"class": ids, "root": ids[np.minimum(root, len(ids) - 1)], "links": links})
        out = out.iloc[:len(x)] if same else out
        return out[out["links"] > 0]

    found = cut_lineage(tiles.groupBy("label", "dim", "pair").applyInPandas(
        run, "class bigint, root bigint, links bigint"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    known = (classes.join(links, "class", "left").join(comp, classes["class"] == comp.node, "left")
             .select("label", "v", "least", "rows", F.coalesce("links", F.lit(0)).alias("links"),
                     F.coalesce("component", "class").alias("component")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(
        "label", "v", (F.col("links") + F.col("rows") - 1).alias("n_links"), F.col("component_id"))
    plain = source.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return (plain.join(known, ["label", "v"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
