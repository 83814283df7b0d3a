"""Removal of long repeated byte strings with a logarithmic family of sparse
suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
anywhere else. Every such string holds an anchor, the position of its smallest
``GRAM``-byte hash (leftmost of equals), which depends on the string alone: two
equal strings have their anchors at the same place. So the suffix arrays hold
anchored suffixes only, about one per 180 bytes, instead of every suffix.

An entry stands for the run of strings (window starts ``first`` .. ``last``)
that share an anchor. Its segment is all bytes of these strings; entries with
equal segments are one class with a count. Of any string, half of its bytes at
least lie on one side of the anchor, so equal strings agree in the ``HALF``
bytes after their anchors (forward key) or in the ``HALF`` before (backward).

Batches of documents become arrays of classes, dealt by the hash of the segment
and sorted by prefix within each part. No step reads that order: keys (64-bit
hashes of the anchored halves) held both by a batch and by a level are found by
equality semi-joins, not by a merge scan, and arrays are merged by a sum over
segment hashes. A batch and the levels of rank 0, 1, ... up to the first free rank
merge into that rank at once, so that a class is rewritten a logarithmic number of
times. Classes of two or more entries are
repeated whole. A class of one, whose keys were found elsewhere, is compared
window by window with the classes that share a key, and matches are confirmed
byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm.store import StoredTable, shuffles_removed, stored

LENGTH, GRAM, HALF = 400, 32, 200
BATCHES = 4
BLOCK = 2048          # classes of a key compared in one group
PREFIX = 12           # bytes that order the suffix arrays
CHUNK = 1 << 20       # window starts handled at once in a long text
NO_ID = -(1 << 63)    # stands for a null doc_id

ENTRIES = ("id bigint, row bigint, pos int, first int, last int, seg binary, prefix binary, "
           "forward bigint, backward bigint")


# --- anchors of one text ------------------------------------------------------

def _gram_hashes(data):
    """32-bit hash of the GRAM bytes from every position, high bits of a word."""
    import numpy as np

    h = data.astype(np.uint64) + np.uint64(1)
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h & np.uint64(0xFFFFFFFF00000000)


def _sliding_min(v, width: int):
    """Minimum of every ``width`` neighbours, from running minima of blocks."""
    import numpy as np

    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(v)] = v
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def anchors(text: bytes):
    """Arrays pos, first, last: every anchor and its run of window starts."""
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    windows = len(data) - LENGTH + 1
    pos, first = [], []
    for begin in range(0, max(0, windows), CHUNK):
        end = min(begin + CHUNK, windows)
        v = _gram_hashes(data[begin:end + LENGTH - 1])
        v |= np.arange(begin, begin + len(v), dtype=np.uint64)
        least = (_sliding_min(v, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        if pos and pos[-1][-1] == least[0]:  # the run goes on in this chunk
            starts = starts[1:]
        pos.append(least[starts])
        first.append(starts + begin)
    if not pos:
        none = np.zeros(0, np.int64)
        return none, none, none
    pos, first = np.concatenate(pos), np.concatenate(first)
    return pos, first, np.append(first[1:] - 1, windows - 1)


def _entries_task(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        out = [[] for _ in range(9)]

        def table():
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(),
                     pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                              [c.split()[0] for c in ENTRIES.split(", ")])

        for id_, row, text in zip(*(c.to_pylist() for c in batch.columns)):
            if len(text) < LENGTH // 4:  # fewer code points than any text of LENGTH bytes
                continue
            text = text.encode()
            for p, a, z in zip(*(x.tolist() for x in anchors(text))):
                # the seed ties the segment to the anchor's place in it
                values = (id_, row, p, a, z, xxh3_128_digest(text[a:z + LENGTH], p - a), text[p:p + PREFIX],
                          signed(xxh3_64_intdigest(text[p:p + HALF], 1)) if p - z <= HALF else None,
                          signed(xxh3_64_intdigest(text[p - HALF:p], 2)) if p - a > HALF else None)
                for column, value in zip(out, values):
                    column.append(value)
            if len(out[0]) >= 100_000:
                yield table()
                out = [[] for _ in range(9)]
        if out[0]:
            yield table()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, id, row, text: ``id`` and ``row`` tell a row's text from others'."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
                       F.xxhash64("doc_id", "text").alias("row"), "text")


def entries(docs: DataFrame) -> DataFrame:
    return keyed(docs).select("id", "row", "text").mapInArrow(_entries_task, ENTRIES)


# --- the family of suffix arrays ----------------------------------------------

def _keys(classes: DataFrame) -> DataFrame:
    return classes.select(F.explode(F.array_compact(F.array("forward", "backward"))).alias("key"))


class SuffixFamily:
    """Levels by rank; each is a table of classes in order of their suffixes:
    seg, n, the class' first entry (``rep``), prefix, forward, backward. A
    level that was merged into another one is discarded."""

    def __init__(self):
        self.levels: dict[int, StoredTable] = {}
        self.found: list[StoredTable] = []

    def add(self, batch: DataFrame) -> None:
        """Index a batch of entries: scan it against all levels, then merge."""
        array = self._sorted(batch.groupBy("seg").agg(
            F.count("*").alias("n"), F.min(F.struct("id", "row", "pos", "first", "last")).alias("rep"),
            *[F.first(c).alias(c) for c in ("prefix", "forward", "backward")]))
        own = _keys(array.df).groupBy("key").agg(F.count("*").alias("classes"))
        hits = own.where("classes > 1").select("key")
        for level in self.levels.values():
            hits = hits.union(own.select("key").join(_keys(level.df), "key", "left_semi"))
        self.found.append(StoredTable(hits.distinct()))
        parts = [array]
        while (rank := len(parts) - 1) in self.levels:
            parts.append(self.levels.pop(rank))
        if rank:
            array = self._sorted(_summed([p.df for p in parts]))
            for p in parts:
                p.discard()
        self.levels[rank] = array

    @staticmethod
    def _sorted(classes: DataFrame) -> StoredTable:
        return StoredTable(classes.sortWithinPartitions("prefix", "forward"))

    def classes(self) -> DataFrame:
        """All classes, whichever levels hold them."""
        levels = [level.df for level in self.levels.values()]
        return levels[0] if len(levels) == 1 else stored(_summed(levels))

    def hits(self) -> DataFrame:
        """Keys that two or more classes hold."""
        every = self.found[0].df
        for f in self.found[1:]:
            every = every.union(f.df)
        return every.distinct()

    def discard(self) -> None:
        """Remove all tables of the family."""
        for t in (*self.levels.values(), *self.found):
            t.discard()


def _summed(arrays: list[DataFrame]) -> DataFrame:
    every = arrays[0]
    for a in arrays[1:]:
        every = every.union(a)
    return every.groupBy("seg").agg(F.sum("n").alias("n"), F.min("rep").alias("rep"),
                                    *[F.first(c).alias(c) for c in ("prefix", "forward", "backward")])


# --- comparison of what shares a key ------------------------------------------

def _window_hashes(data: bytes, n: int):
    """Hash of each of the first ``n`` windows (a polynomial modulo 2**64)."""
    import numpy as np

    size = n + LENGTH
    powers, inverse = _powers(size)
    sums = np.zeros(size, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[:size - 1], out=sums[1:])
    return (sums[LENGTH:LENGTH + n] - sums[:n]) * inverse[:n]


def _powers(size: int, base: int = 0xD6E8FEB86659FD93, made={}):  # noqa: B006  the tables are kept
    import numpy as np

    if made.get("size", 0) < size:
        grown = max(size, 2 * LENGTH)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            table = np.empty(grown, np.uint64)
            x = 1
            for i in range(grown):
                table[i] = x
                x = x * b % (1 << 64)
            made[name] = table
        made["size"] = grown
    return made["up"], made["down"]


def repeated_windows(members: list[tuple]) -> list[list[tuple[int, int]]]:
    """For ``members`` (group, offset of the first window before the anchor,
    number of windows, bytes): runs (from, to) of each member's windows that a
    member of the same group also holds at the same offset."""
    import numpy as np

    counts = np.array([m[2] for m in members])
    owner = np.repeat(np.arange(len(members)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    step = np.arange(len(owner)) - begin[owner]
    place = (np.array([m[0] for m in members])[owner].astype(np.uint64) * np.uint64(1 << 10)
             + (np.array([m[1] for m in members])[owner] - step).astype(np.uint64))
    key = np.concatenate([_window_hashes(m[3], m[2]) for m in members])
    key = (key ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    # partner: the first of equal windows; of the first one, the second
    heads = np.concatenate([[True], ~equal])
    head_at = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    partner = np.full(len(key), -1)
    partner[order] = order[head_at]
    seconds = np.flatnonzero(heads[:-1] & equal)
    partner[order[seconds]] = order[seconds + 1]
    alone = np.concatenate([heads[1:], [True]]) & heads
    partner[order[alone]] = -1
    flat = np.flatnonzero(partner >= 0)
    runs: list[list[tuple[int, int]]] = [[] for _ in members]
    if not len(flat):
        return runs
    other = partner[flat]
    cut = np.flatnonzero((np.diff(flat) != 1) | (np.diff(other) != 1) | (np.diff(owner[flat]) != 0)
                         | (np.diff(owner[other]) != 0)) + 1
    for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(flat)]])):
        m, m2 = owner[flat[i]], owner[other[i]]
        t, t2, n = step[flat[i]], step[other[i]], j - i
        if members[m][0] == members[m2][0] and (
                members[m][3][t:t + n - 1 + LENGTH] == members[m2][3][t2:t2 + n - 1 + LENGTH]):
            runs[m].append((int(t), int(t + n - 1)))
        else:  # equal hashes of different strings: compare with each member
            runs[m] += [(x, x) for x in range(int(t), int(t + n)) if _held_elsewhere(members, int(m), x)]
    return runs


def _held_elsewhere(members: list[tuple], m: int, t: int) -> bool:
    group, offset, _, data = members[m]
    for i, (g, o, n, other) in enumerate(members):
        x = o - (offset - t)
        if i != m and g == group and 0 <= x < n and other[x:x + LENGTH] == data[t:t + LENGTH]:
            return True
    return False


SPANS = "id bigint, row bigint, begin int, end int"


def _spans_table(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      ["id", "row", "begin", "end"])


def _compare_task(batches: Iterator) -> Iterator:
    """Rows in order of their keys; whole groups are gathered and compared."""
    held, last, group = [], None, 0

    def spans(rows):
        found = repeated_windows([(r[0], r[4], r[5], r[7]) for r in rows])
        return [(r[1], r[2], r[3] + a, r[3] + z + LENGTH) for r, runs in zip(rows, found) if r[6] for a, z in runs]

    for batch in batches:
        for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                if len(held) >= BLOCK:
                    if out := spans(held):
                        yield _spans_table(out)
                    held, group = [], 0
                last, group = key, group + 1
            held.append((group, *rest))
    if held and (out := spans(held)):
        yield _spans_table(out)


def _windows_task(batches: Iterator) -> Iterator:
    """One row per window of a large key: a digest of its bytes and place."""
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    for batch in batches:
        for _, id_, row, begin, offset, n, single, data in zip(*(c.to_pylist() for c in batch.columns)):
            digests = [xxh3_128_digest(data[t:t + LENGTH], offset - t) for t in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([id_] * n, pa.int64()), pa.array([row] * n, pa.int64()),
                 pa.array(range(begin, begin + n), pa.int32()), pa.array([single] * n, pa.bool_())],
                ["window", "id", "row", "begin", "single"])


PARTS = ("key bigint, id bigint, row bigint, begin int, offset int, windows int, single boolean, data binary, "
         "large boolean")


def _cut_task(batches: Iterator) -> Iterator:
    """The bytes that each wanted class needs compared, for each of its keys."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(),
             pa.bool_())
    names = [c.split()[0] for c in PARTS.split(", ")]
    for batch in batches:
        rows = []
        for id_, row, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            for w in wanted:
                if w["ahead"]:
                    a, z = max(w["first"], w["pos"] - HALF), w["last"]
                else:
                    a, z = w["first"], min(w["last"], w["pos"] - HALF - 1)
                rows.append((w["key"], id_, row, a, w["pos"] - a, z - a + 1, w["single"], data[a:z + LENGTH],
                             w["large"]))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _wanted(classes: DataFrame, hits: DataFrame) -> DataFrame:
    """id, row, wanted: the classes to compare, by the text that shows them.
    Keys without a class of one need no comparison: all their classes repeat."""
    sides = F.array(F.struct(F.col("forward").alias("key"), F.lit(True).alias("ahead")),
                    F.struct(F.col("backward").alias("key"), F.lit(False).alias("ahead")))
    held = (classes.select("seg", "rep", (F.col("n") == 1).alias("single"), F.explode(sides).alias("side"))
            .where("side.key is not null").select("rep", "single", "side.*").join(hits, "key", "left_semi"))
    open_keys = held.groupBy("key").agg(F.count("*").alias("classes"), F.max("single").alias("open")).where(
        "classes > 1 and open").select("key", (F.col("classes") > BLOCK).alias("large"))
    rows = held.join(open_keys, "key").select("rep.id", "rep.row", F.struct(
        "key", "ahead", "rep.pos", "rep.first", "rep.last", "single", "large").alias("want"))
    return rows.groupBy("id", "row").agg(F.collect_list("want").alias("wanted"))


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """id, row, begin, end: byte ranges (not merged) covered by repeated strings.
    Every step is stored, and what no later step reads is removed at once."""
    with shuffles_removed(docs.sparkSession):
        indexed = StoredTable(entries(docs).withColumn("batch", F.pmod("row", F.lit(batches)).cast("int")), "batch")
        family = SuffixFamily()
        for b in range(batches):
            family.add(indexed.df.where(F.col("batch") == b))
        classes = family.classes()
        whole = classes.where("n > 1").select("seg")
        spans = stored(indexed.df.join(whole, "seg").select("id", "row", F.col("first").alias("begin"),
                                                            (F.col("last") + LENGTH).alias("end")))
        indexed.discard()
        wanted = StoredTable(_wanted(classes, family.hits()))
        family.discard()
        parts = stored(keyed(docs).join(wanted.df, ["id", "row"]).select("id", "row", "text", "wanted")
                       .mapInArrow(_cut_task, PARTS))
        wanted.discard()
    small = parts.where("not large").drop("large").repartition("key").sortWithinPartitions("key")
    spans = spans.union(small.mapInArrow(_compare_task, SPANS))
    # keys with many classes: windows are counted, combined before the shuffle
    windows = parts.where("large").drop("large").mapInArrow(
        _windows_task, "window binary, id bigint, row bigint, begin int, single boolean")
    often = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return spans.union(windows.where("single").join(often, "window").select(
        "id", "row", "begin", (F.col("begin") + LENGTH).alias("end")))


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes): one
    row per input row.

    A null text counts as empty. Texts shorter than ``LENGTH`` bytes are kept
    whole. All copies of a repeated string go, repeated rows are each other's
    copies; a null doc_id stays null; an empty table gives no rows. A text of
    any length is searched whole; matches never cross documents.
    """
    ranges = repeated_spans(docs, batches).groupBy("id", "row").agg(
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("ranges"))
    joined = keyed(docs).join(ranges, ["id", "row"], "left").select("doc_id", "text", "ranges")

    def run(batches_: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_:
            sizes, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, out, at, gone, n = text.encode(), [], 0, 0, 0
                for r in found or ():
                    a, z = r["begin"], r["end"]
                    if a > at or not n:
                        out.append(data[at:a])
                        n, gone, at = n + 1, gone + z - a, z
                    elif z > at:
                        gone, at = gone + z - at, z
                out.append(data[at:])
                sizes.append(len(data))
                removed.append(gone)
                spans.append(n)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
