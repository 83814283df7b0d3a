"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints at most ``distance`` bits apart, cut into ``segments`` parts with
``distance < 2 * segments``, differ by one bit at most in some part. Each part
is indexed once per bit with that bit wiped out, so two parts that differ by
one bit (or none) share an index key. Equal keys are joined and each pair is
verified by its full bit distance. Equal fingerprints are one class from the
start and are never compared.

Keys are joined in sorted partitions; within a key only the links that hold
its members together are kept (a spanning forest), never all pairs. A key with
more than ``BLOCK`` members is split into blocks, and every pair of blocks is
its own group, so no group is larger than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from airlake.llm.graph import components
from airlake.session import cut_lineage

BITS = 64
BLOCK = 4096


def _fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of all shingles' hashes; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n < 1:
        return xxh64_intdigest(b" ".join(words), 42)
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))),
                         "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(hashes[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint as the bits of a signed long."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((_fingerprint(t.encode(), shingle) for t in batch.column(2).to_pylist()), "<u8",
                              batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view("<i8"))],
                                             ["doc_id", "text_hash", "fp"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    return [(BITS * i // segments, BITS * (i + 1) // segments) for i in range(segments)]


def _variants(segments: int):
    """Array of index keys of ``fp``: the part with one bit wiped out, and the
    number of that bit (which tells the part as well)."""
    out = []
    for low, high in segment_bounds(segments):
        mask = (1 << (high - low)) - 1
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask))
        out += [F.shiftleft(part.bitwiseAND(F.lit(mask & ~(1 << (bit - low)))), 6).bitwiseOR(F.lit(bit))
                for bit in range(low, high)]
    return F.array(*out)


def _hot_keys(fps: DataFrame, segments: int) -> DataFrame:
    """Keys with more than ``BLOCK`` members: ``key, blocks``.

    A key gathers the two values of its part that differ in the wiped bit, so
    only values held by over half a block can make a large key. Those are
    counted first (one row per part and value), which leaves few keys."""
    parts = F.array(*[
        F.struct(F.lit(i).alias("part"),
                 F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"))
        for i, (low, high) in enumerate(segment_bounds(segments))])
    values = (fps.select(F.explode(parts).alias("p")).groupBy("p.part", "p.value").count()
              .where(F.col("count") > BLOCK // 2))
    keys = []
    for i, (low, high) in enumerate(segment_bounds(segments)):
        bits = F.sequence(F.lit(0), F.lit(high - low - 1))
        keys.append(values.where(F.col("part") == i).select("count", F.explode(bits).alias("bit"), "value").select(
            F.expr(f"((value & ~shiftleft(1L, bit)) << 6) | (bit + {low})").alias("key"), "count"))
    union = keys[0]
    for k in keys[1:]:
        union = union.union(k)
    # the half that isn't counted here has at most BLOCK / 2 members
    return union.groupBy("key").agg(F.ceil((F.sum("count") + BLOCK // 2) / BLOCK).cast("int").alias("blocks"))


def _forest(fps, distance: int):
    """Links that hold together what is linked among the numbers ``fps``."""
    import numpy as np

    a, b = [], []
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
                rest = rest[~near]
    return a, b


def links(fps: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints (column ``fp``) at most
    ``distance`` bits apart, enough to hold every component together."""
    if distance >= 2 * segments:
        raise ValueError("too few segments: none need differ by one bit at most")
    indexed = fps.select("fp", F.explode(_variants(segments)).alias("key"))
    hot = cut_lineage(_hot_keys(fps, segments))
    if hot.isEmpty():
        placed = indexed.select("key", F.lit(0).alias("low"), F.lit(0).alias("high"), "fp")
    else:
        own = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
        placed = (indexed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
                  .withColumn("own", own)
                  .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
                  .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = None

        def groups(rows, last: bool):
            """Forests of the finished groups; the rest is held back."""
            change = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
            bounds = np.concatenate([[0], change, [len(rows)]])
            sizes = np.diff(bounds)
            done = len(sizes) if last else len(sizes) - 1
            a, b = [], []
            for g in np.flatnonzero(sizes[:done] > 1):
                x, y = _forest(rows[bounds[g]:bounds[g + 1], 3].astype("u8"), distance)
                a += x
                b += y
            found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1).view("i8"), axis=0) if a else None
            return found, rows[bounds[done]:]

        def table(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns], 1)
            if held is not None and len(held):
                rows = np.concatenate([held, rows])
            found, held = groups(rows, False) if len(rows) else (None, rows)
            if found is not None:
                yield table(found)
        if held is not None and len(held):
            found, _ = groups(held, True)
            if found is not None:
                yield table(found)

    return (placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
            .mapInArrow(run, "a bigint, b bigint").distinct())


def _grouped(marked: DataFrame, distance: int, segments: int) -> DataFrame:
    """``marked(doc_id, fp, ...)`` with component_fp and component_id."""
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), distance, segments))
    joined = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component_fp"))
    roots = joined.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    return marked.join(joined.join(roots, "component_fp").drop("least"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id linked, itself included): one
    row per input row.

    A null or wordless text has fingerprint zero and is linked like any other.
    Rows with the same doc_id and text give equal rows; rows that share a
    doc_id but not the text keep their own fingerprints. A null doc_id takes
    part, and its component is the smallest known doc_id (null if there is
    none). An empty table gives no rows. Texts of any length count whole.
    """
    marked = cut_lineage(fingerprints(docs, shingle))
    return _grouped(marked, distance, segments).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """``docs`` with all its columns: of each group of near-duplicates the row
    with the smallest doc_id (null ids last), one row even if it is repeated.
    The texts are shuffled once, to meet the keys of the rows that stay."""
    marked = cut_lineage(fingerprints(docs, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    stay = _grouped(marked, distance, segments).groupBy("component_fp").agg(F.min(order).alias("least")).select(
        F.col("least.doc_id").alias("stay_id"), F.col("least.text_hash").alias("stay_hash"))
    rows = docs.select(F.struct("*").alias("all"))
    rows = rows.select("all", F.col("all.doc_id").cast("long").alias("id"),
                       F.xxhash64(F.coalesce("all.text", F.lit(""))).alias("text_hash"))
    joined = rows.join(stay, rows.id.eqNullSafe(stay.stay_id) & (rows.text_hash == stay.stay_hash))
    copy = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("id"))
    return joined.withColumn("copy", copy).where("copy = 1").select("all.*")
