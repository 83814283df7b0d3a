"""Token counts by a map-side two-tier lookup.

Tier one is a compact broadcast table: lengths of the corpus' most frequent
pre-token chunks (at most ``TABLE_ENTRIES`` of up to 64 characters). Tier two is a bounded cache in
each worker, filled by the tokenizer library. No pre-token is ever shuffled:
the table is made from one bounded summary per task, merged in a tree. The
table decides speed only; counts are the library's for any table.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm import bpe

TABLE_ENTRIES = 65_536   # entries of the broadcast table
TASK_ENTRIES = 16_384    # entries of one task's summary
FAN_IN = 16              # summaries merged by one task
SUMMARY = "words array<string>, counts array<bigint>"


def _top(counts: dict[str, int], n: int) -> dict[str, int]:
    if len(counts) <= n:
        return dict(counts)
    return dict(heapq.nlargest(n, counts.items(), key=lambda x: (x[1], x[0])))


def _summary(counts: dict[str, int], n: int):
    import pyarrow as pa

    top = _top(counts, n)
    return pa.RecordBatch.from_arrays(
        [pa.array([list(top)], pa.list_(pa.string())), pa.array([list(top.values())], pa.list_(pa.int64()))],
        ["words", "counts"])


def _count_task(batches: Iterator) -> Iterator:
    """One summary per task; the counter is cut back whenever it grows large."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(c for c in bpe.chunks(text)[1:] if len(c) <= bpe.LONGEST_CHUNK)
                if len(counts) > 16 * TASK_ENTRIES:
                    counts = Counter(_top(counts, 4 * TASK_ENTRIES))
    yield _summary(counts, TASK_ENTRIES)


def _merge_task(batches: Iterator) -> Iterator:
    counts: Counter = Counter()
    for batch in batches:
        for words, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w, k in zip(words, n):
                counts[w] += k
    yield _summary(counts, TABLE_ENTRIES)


def frequent_chunks(texts: DataFrame) -> list[str]:
    """The most frequent chunks of all texts (at most ``TABLE_ENTRIES``)."""
    tasks = texts.rdd.getNumPartitions()
    level = texts.mapInArrow(_count_task, SUMMARY)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        level = level.repartition(tasks).mapInArrow(_merge_task, SUMMARY)
    return [w for row in level.collect() for w in row.words]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null;
    repeated rows give repeated results; an empty table gives no rows; texts
    of any length are counted whole. ``limit`` is the context size that
    ``over_limit`` refers to.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = frequent_chunks(docs.select("text"))
    tok = bpe.load(tokenizer_path)
    table = {}
    for i in range(0, len(words), 4096):
        part = words[i:i + 4096]
        table.update(zip(part, map(len, tok.encode_batch([" " + w for w in part], add_special_tokens=False))))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = bpe.Counter(tokenizer_path, shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
            tokens = pa.array(counter(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens], ["doc_id", "n_bytes", "n_tokens"])

    return (docs.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit))
