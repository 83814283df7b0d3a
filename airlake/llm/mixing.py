"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, in code point order, weigh 1, 2, 3, repeating, and share the size of
the whole corpus; no target exceeds ``MOST`` times its source's size. A source
takes as many complete epochs as its target holds; the rest of the target is
filled from its documents in the order of exponential keys ``-ln(u) / w`` (u: a
hash of doc_id, w: the document's quality weight), summed up to the budget.

Prefix sums are distributed: rows are dealt by ranges of (source, key), each
range is summed on its own and the sums of earlier ranges of the source are
added, so that a hot source is spread over many tasks. Only the last key each
source takes is kept, and every row is decided by comparing with it; no row
meets the other rows of its source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from airlake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WEIGHTS = (1, 2, 3)
MOST = 3
SOURCES_TO_BROADCAST = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """Between 0 and 1: documents full of symbols weigh less."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * symbols / F.greatest(words, F.lit(1)))


def salt(doc_id: Column, text: Column) -> Column:
    """What tells rows without a doc_id apart: the hash of their text."""
    return F.when(doc_id.isNull(), F.md5(F.coalesce(text, F.lit("")))).otherwise("")


def exponential_key(doc_id: Column, salt: Column, weight: Column) -> Column:
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), salt))), 1, 13), 16, 10)
    u = (digits.cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``: the place in code point order from 0, null last. Ranges
    of the order are ranked on their own and shifted by the earlier ranges."""
    order = F.col("source").asc_nulls_last()
    dealt = cut_lineage(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}  # one number per range
    before, shifts = 0, []
    for part in sorted(counts):
        shifts += [F.lit(part), F.lit(before)]
        before += counts[part]
    shift = F.create_map(*shifts)[F.col("part")] if shifts else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("rank", (shift + within).cast("long")).drop("part")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of the whole by weight, none above
    ``most`` times its source; what is above is shared anew among the others.
    Each round needs three numbers from Spark."""
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    weight = F.array(*[F.lit(int(w)) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    table = cut_lineage(_ranked(sources).withColumn("weight", weight))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(most) * F.col("source_size")
    fixed, left, shared, full = None, total, None, F.lit(False)
    while True:
        full = F.lit(False) if shared is None else F.col("weight") * F.lit(float(left)) / F.lit(float(shared)) > cap
        n, capped, open_weight = table.agg(
            F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == fixed or not open_weight:
            break
        fixed, left, shared = n, total - (capped or 0), open_weight
    open_share = F.col("weight") * F.lit(float(left)) / F.lit(float(shared or 1))
    return table.select("source", "source_size",
                        F.when(open_share > cap, cap.cast("double")).otherwise(open_share).alias("target"))


def _cuts(units: DataFrame, planned: DataFrame) -> DataFrame:
    """source, cut: the last (key, id, salt, size) that the fractional epoch takes."""
    place = F.struct("key", "id", "salt", "size").alias("place")
    dealt = cut_lineage(units.select("source", place, (F.col("size") * F.col("rows")).alias("mass"))
                        .repartitionByRange("source", "place").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("source", "part").agg(F.sum("mass").alias("sum"))
    before = sums.select("source", "part", (F.sum("sum").over(
        Window.partitionBy("source").orderBy("part")) - F.col("sum")).alias("before"))
    known = F.broadcast(before) if before.count() <= SOURCES_TO_BROADCAST else before
    budget = planned.select("source", "fraction")
    same = lambda a, b: a.source.eqNullSafe(b.source)
    inside = F.sum("mass").over(Window.partitionBy("source", "part").orderBy("place"))
    running = dealt.withColumn("inside", inside)
    rows = (running.join(known, same(running, known) & (running.part == known.part))
            .select(running.source, "place", "mass", (F.col("before") + F.col("inside")).alias("sum")))
    rows = rows.join(budget, same(rows, budget)).select(rows.source, "place", "mass", "sum", "fraction")
    return (rows.where(2 * F.col("sum") - F.col("mass") <= 2 * F.col("fraction"))
            .groupBy("source").agg(F.max("place").alias("cut")))


def _mixed(sized: DataFrame) -> DataFrame:
    """doc_id, source, size and least weight of the rows equal in the first
    three whose weights differ, under names of their own: few as a rule. Rows
    without a doc_id that are equal have one text, so one weight."""
    mixed = cut_lineage(sized.where("doc_id is not null").groupBy("doc_id", "source", "size")
                        .agg(F.min("weight").alias("least"), F.max("weight").alias("most")).where("least < most")
                        .select(F.col("doc_id").alias("unit_id"), F.col("source").alias("unit_source"),
                                F.col("size").alias("unit_size"), "least"))
    return _small(mixed)


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, epochs, cut for ``sized``: doc_id, salt,
    source, size, weight. Rows equal in doc_id (without one: in the hash of
    their text), source and size are taken together."""
    units = cut_lineage(
        sized.groupBy("doc_id", "salt", "source", "size").agg(F.min("weight").alias("weight"), F.count("*").alias("rows"))
        .select("source", "size", "rows", "salt", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"),
                exponential_key(F.col("doc_id"), F.col("salt"), F.col("weight")).alias("key")))
    goals = targets(units, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = cut_lineage(goals.withColumn("epochs", epochs.cast("long")).withColumn(
        "fraction", F.col("target") - F.col("epochs") * F.col("source_size")))
    cuts = _cuts(units, _small(planned))
    return cut_lineage(planned.join(cuts, planned.source.eqNullSafe(cuts.source), "left").select(
        planned.source, "source_size", "target", "epochs", "cut"))


def _small(table: DataFrame) -> DataFrame:
    """A table that is small as a rule: sent to all tasks while its rows are few."""
    return F.broadcast(table) if table.count() <= SOURCES_TO_BROADCAST else table


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, salt, source, size, weight of every document."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        "text", word_count(F.col("text")).alias("size"))
            .select("doc_id", salt(F.col("doc_id"), F.col("text")).alias("salt"), "source", "size", quality_weight(F.col("text"), F.col("size")).alias("weight")))


def copies(rows: DataFrame, planned: DataFrame, mixed: DataFrame) -> DataFrame:
    """Joins ``rows`` (doc_id, salt, source, size, weight, ...) with the plan and
    adds ``copies``: how often the mix takes the row. Rows that the plan sums
    up as one are decided as one, by their least weight."""
    rows = rows.join(mixed, (rows.doc_id == mixed.unit_id) & rows.source.eqNullSafe(mixed.unit_source)
                     & (rows["size"] == mixed.unit_size), "left")
    rows = rows.withColumn("weight", F.coalesce("least", "weight")).drop(
        "unit_id", "unit_source", "unit_size", "least")
    planned = _small(planned).withColumnRenamed("source", "plan_source")
    place = F.struct(exponential_key(F.col("doc_id"), F.col("salt"), F.col("weight")).alias("key"),
                     F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("salt"), F.col("size"))
    joined = rows.join(planned, rows.source.eqNullSafe(planned.plan_source))
    extra = F.when(F.col("cut").isNotNull() & (place <= F.col("cut")), 1).otherwise(0)
    return joined.withColumn("copies", F.col("epochs") + extra).drop("plan_source", "cut", "epochs", "salt")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per input row.

    A null text has size 0; a null source is a source of its own, after all
    others; rows without a doc_id are told apart by the hash of their text. Rows
    equal in doc_id (without one: in text), source and size are taken together. Ties in the key go by doc_id, then
    size. A source without words has target 0. An empty table gives no rows.
    """
    rows = cut_lineage(sized(docs))
    return copies(rows, plan(rows, weights, most), _mixed(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: every row of ``docs``, with all its columns, as often
    as the mix takes it (not at all, or up to ``most`` times). Nulls, repeated
    rows and ties as in ``mix``; an empty table stays empty."""
    sizes = cut_lineage(sized(docs))
    planned = plan(sizes, weights, most)
    row = docs.select(F.struct("*").alias("row"))
    rows = row.select("row", F.col("row.doc_id").cast("long").alias("doc_id"),
                      F.col("row.source").cast("string").alias("source"),
                      word_count(F.col("row.text")).alias("size"))
    rows = (rows.withColumn("weight", quality_weight(F.col("row.text"), F.col("size")))
            .withColumn("salt", salt(F.col("doc_id"), F.col("row.text"))))
    taken = copies(rows, planned, _mixed(sizes)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
