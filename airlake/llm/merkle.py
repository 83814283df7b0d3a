"""Merkle manifest of a table: a hash tree per language, one tree over them.

A node's digest ``H`` is the lowercase hex sha256 of its concatenated inputs.
A leaf hashes the length-prefixed values of one row. In every tree ``FANOUT``
consecutive nodes, a run, become their parent; a short last run, even of one,
does too; a tree of one node is its own root.

Per level, window columns at fixed offsets (``lag`` and ``lead`` by 1 to
``FANOUT - 1``), masked by the node's slot in its run and by the run's length,
are a node's siblings. The first child of each run hashes the parent, so the
next level is a filter of this one. Going up, every level is written and read
again; going down, every level joins its nodes with their parents on the key
that its windows are dealt by, and hands on the siblings met so far. Windows
hold one run each, whatever share of the rows a language has; positions come
from a range partitioning and the counts of its parts, never from a window
over a whole language.

Defined cases. A null column is ``-`` in its leaf. Null doc_ids come first;
rows of equal doc_id are ordered by their leaf. A null language is its own
group, the first, unlike the empty string. Repeated rows are leaves of their
own. Rows without a doc_id are never tampered with. Further columns are not
read, so their names cannot clash. An empty table gives no rows. Texts are
hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.llm.store import stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:``, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """Digest of one row; ``instead`` replaces columns by other values."""
    return F.sha2(F.concat(*(field(instead.get(c, F.col(c))) for c in FIELDS)), 256)


def group_key(lang: Column) -> Column:
    """Orders null first, then by UTF-8 bytes; never null."""
    return F.coalesce(F.concat(F.lit("1"), lang), F.lit("0"))


def with_positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in ``order`` within ``group``) and ``n``,
    the group's size, as a stored table.

    Range parts are written in order; a row's place in its part plus the rows
    of its group in earlier parts is its position. Only one count for each
    part and group is added up by a window.
    """
    parts = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    parts = stored(parts.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = parts.groupBy(group, part.alias("part")).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(group).alias("its_group"), "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    placed = parts.join(counts, (F.col(group) == F.col("its_group")) & (part == F.col("part")))
    return stored(placed.select(*rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("pos"), "n"))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (group, pos, n, node) with run, slot and the digests of the
    others of the run to the left and to the right, concatenated in order."""
    over = "over (partition by `group`, run order by pos)"
    offsets = range(1, FANOUT)
    nodes = nodes.selectExpr("*", f"pos div {FANOUT} as run", f"pos % {FANOUT} as slot")
    nodes = nodes.selectExpr(
        "*", f"least({FANOUT}, n - pos + slot) as length",
        *(f"lag(node, {k}) {over} as lag{k}" for k in offsets), *(f"lead(node, {k}) {over} as lead{k}" for k in offsets))
    left = ", ".join(f"if(slot >= {k}, lag{k}, null)" for k in reversed(offsets))
    right = ", ".join(f"if(slot + {k} < length, lead{k}, null)" for k in offsets)
    kept = [f"`{c}`" for c in nodes.columns if not c.startswith(("lag", "lead", "length"))]
    return nodes.selectExpr(*kept, f"concat_ws('', {left}) as left", f"concat_ws('', {right}) as right")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: first children hash their runs; a root stays."""
    above = F.sha2(F.concat("node", "right"), 256)
    return with_siblings(nodes).where("slot = 0").select(
        "group", F.col("run").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"),
        F.when(F.col("n") > 1, above).otherwise(F.col("node")).alias("node"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels, leaves first; the last one has one node for each group."""
    largest = leaves.agg(F.max("n")).first()[0] or 1
    out = [leaves.select("group", "pos", "n", "node")]
    while largest > 1:
        out.append(stored(parents(out[-1])))
        largest = -(-largest // FANOUT)
    return out


def down(level: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """Nodes of ``level`` with the ``path`` of their parents in ``above``
    extended by their own siblings. ``carried`` columns of ``above`` stay."""
    above = above.selectExpr("`group` as group_above", "pos as pos_above", "path as path_above", *carried)
    nodes = with_siblings(level)
    own = [f"`{c}`" for c in level.columns]
    return nodes.join(above, (F.col("group") == F.col("group_above")) & (F.col("run") == F.col("pos_above"))).selectExpr(
        *own, *carried, "if(n > 1, concat(array(struct(left, right)), path_above), path_above) as path")


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` gives with the siblings along ``path``."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, leaf_of: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, other (the digest with the
    columns of ``leaf_of`` in place, null where they change nothing), subroot,
    root and path, the (left, right) siblings from leaf to root."""
    docs = docs.select(*FIELDS)
    own, other = leaf(), leaf(**(leaf_of or {}))
    rows = docs.select("doc_id", group_key(F.col("lang")).alias("group"), own.alias("node"), other.alias("other"))
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other")))
    leaves = with_positions(stored(rows), "group", "doc_id", "node")

    by_lang = levels(leaves)
    subroots = by_lang[-1].select(F.lit("").alias("group"), F.col("group").alias("key"), "node")
    subroots = with_positions(subroots, "group", "key")
    tree = levels(subroots)

    no_path = F.array().cast("array<struct<left:string,right:string>>")
    top = (tree[-1] if len(tree) > 1 else subroots).withColumns({"root": F.col("node"), "path": no_path})
    for level in [*reversed(tree[1:-1]), subroots][:len(tree) - 1]:
        top = down(level, top, "root")
    # subroots are the parents of their groups' last levels
    top = top.select(F.col("key").alias("group"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "root", "path")
    for level in reversed(by_lang[1:-1]):
        top = down(level, top, "subroot", "root")
    return down(leaves, top, "subroot", "root").select("doc_id", F.col("node").alias("leaf"), "other", "subroot", "root", "path")


def lower_cased(every: int = 3) -> dict[str, Column]:
    """Tampering: A-Z of the text lower-cased where ``every`` divides the
    unsigned crc32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return {"text": F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}


def verify(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of all siblings, leaf to
    root, left to right), folded_root (from ``other`` where it is not null),
    verified."""
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    return (rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
                        folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
