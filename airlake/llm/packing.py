"""Hierarchical multi-length packing.

Every document (its ids and a closing id) gives full windows of the largest
context size and a rest. Rests are routed to tiers by length, the smallest
context size that holds them. Each tier, from the longest, is packed into
windows of its size; the gap of a window is filled from shorter tiers (whole
rests that fit best first, then one rest is cut to the exact gap). Windows are
dealt to step groups of one context size and ``STEP_TOKENS`` tokens, so that
steps weigh the same, but for the last group of each context size in a task.

Ids come from ``bpe.Encoder``: texts, or runs of a text between single spaces,
in scripts up to Cyrillic are merged by tiktoken from the tokenizer file's own
vocabulary, everything else by the tokenizers library (ids are the same).

Each task packs its own rows in bounded rounds and carries unfinished windows
on, so there is no shuffle and no state between tasks, and a repeated task
gives the same windows. What a task has left at its end is cut into windows of
descending powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm import bpe

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 8 * 2048
ROUND_TOKENS = 1 << 20   # ids held back before a round of packing
ROUND_RESTS = 1 << 14    # or rests
CLOSING_ID = b"\x01\x00\x00\x00"
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, context bigint, step_group bigint")


class _Rest:
    """A run of a document's ids not yet placed."""

    __slots__ = ("doc", "start", "ids", "total", "n")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total, self.n = doc, start, ids, total, len(ids) // 4

    def cut(self, n: int) -> tuple["_Rest", "_Rest"]:
        return (_Rest(self.doc, self.start, self.ids[:4 * n], self.total),
                _Rest(self.doc, self.start + n, self.ids[4 * n:], self.total))


class Packer:
    """Packs the documents of one task; finished pieces gather in ``rows``."""

    def __init__(self, task: int, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.task, self.tiers, self.step_tokens = task, tuple(sorted(tiers, reverse=True)), step_tokens
        self.sequences, self.made = 0, {}
        self.tier: dict[int, list[_Rest]] = {t: [] for t in self.tiers}
        self.held, self.rows = 0, []

    def add(self, doc, ids: bytes) -> None:
        top, total = self.tiers[0], len(ids) // 4
        whole = total - total % top
        for start in range(0, whole, top):
            self._emit(top, [_Rest(doc, start, ids[4 * start:4 * (start + top)], total)])
        if whole < total:
            self._hold(_Rest(doc, whole, ids[4 * whole:], total))
            if self.held >= ROUND_TOKENS or sum(map(len, self.tier.values())) >= ROUND_RESTS:
                self._round()

    def finish(self) -> None:
        """Pack all that is held; the last windows are powers of two."""
        self._round()
        parts = [r for t in self.tiers for r in self.tier[t]]
        self.tier = {t: [] for t in self.tiers}
        left = sum(r.n for r in parts)
        while left:
            size = 1 << (left.bit_length() - 1)
            size = min(size, self.tiers[0])
            window, need = [], size
            while need:
                r = parts.pop(0)
                if r.n > need:
                    r, rest = r.cut(need)
                    parts.insert(0, rest)
                window.append(r)
                need -= r.n
            self._emit(size, window)
            left -= size

    def _tier_of(self, n: int) -> int:
        return min(t for t in self.tiers if t >= n)

    def _hold(self, r: _Rest) -> None:
        insort(self.tier[self._tier_of(r.n)], r, key=lambda x: x.n)
        self.held += r.n

    def _take(self, tier: int, i: int) -> _Rest:
        r = self.tier[tier].pop(i)
        self.held -= r.n
        return r

    def _fill(self, gap: int, below: list[int]) -> tuple[list[_Rest], int]:
        """Rests from the tiers ``below``, best fit first, one cut at the end."""
        got = []
        while gap:
            for t in below:
                i = bisect_right(self.tier[t], gap, key=lambda x: x.n)
                if i:
                    r = self._take(t, i - 1)
                    break
            else:
                t = min((t for t in below if self.tier[t]), default=None)
                if t is None:
                    break
                r, rest = self._take(t, 0).cut(gap)
                self._hold(rest)
            got.append(r)
            gap -= r.n
        return got, gap

    def _round(self) -> None:
        unfinished = []
        for k, t in enumerate(self.tiers):
            while self.tier[t]:
                first = self._take(t, len(self.tier[t]) - 1)
                more, gap = self._fill(t - first.n, [*self.tiers[k + 1:], t])
                if gap:  # nothing is left to fill it with
                    unfinished += [first, *more]
                else:
                    self._emit(t, [first, *more])
        for r in unfinished:
            self._hold(r)

    def _emit(self, context: int, parts: list[_Rest]) -> None:
        sequence = (self.task << 33) + self.sequences
        self.sequences += 1
        k = self.made.get(context, 0)
        self.made[context] = k + 1
        step = (self.task << 33) + (context.bit_length() << 27) + k // max(1, self.step_tokens // context)
        offset = 0
        for r in parts:
            self.rows.append((r.doc, r.start, r.n, zlib.crc32(r.ids), r.total, sequence, offset, context, step))
            offset += r.n


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the window's context size and step group.

    A null text counts as empty, its document is the closing id alone. A null
    doc_id stays null. Repeated rows are packed one by one, each from start 0.
    An empty table gives no rows; a text of any length is cut over as many
    windows as it needs. No window is padded: each is filled to its context
    size, a power of two.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in PIECES.split(", ")]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        encode, packer = bpe.encoder(tokenizer_path), Packer(TaskContext.get().partitionId())
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                packer.add(doc, ids + CLOSING_ID)
                if len(packer.rows) >= 50_000:
                    yield out(packer.rows)
                    packer.rows = []
        packer.finish()
        if packer.rows:
            yield out(packer.rows)

    return docs.mapInArrow(run, PIECES)
