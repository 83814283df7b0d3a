"""Quality rules as a short-circuit cascade.

Every rule's cost and rejection rate is measured on a sample; rules then run
in the order of rejections per cost, and a document leaves at the first rule
that rejects it. A document is kept if no rule rejects it, whatever the order:
the sample decides speed only.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SAMPLE_FRACTION = 0.01


class Text:
    """Features of one text, each computed when a rule first asks for it.
    Words are runs without the six ASCII white-space characters."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # on bytes: ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        covered, end = 0, 0
        for i, x in enumerate(windows):
            if often[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def n_wordless(self) -> int:
        """Words without a letter."""
        return sum(not any(map(str.isalpha, w)) for w in map(bytes.decode, self.words) if not w.isalpha())


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


#: The base rules of the contract, then the rest of the cascade.
BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = BASE + (
    Rule("symbols", lambda t: 5 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("long_words", lambda t: t.word_chars > 25 * t.n_words),
    Rule("no_letters", lambda t: 2 * t.n_wordless > t.n_words),
)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, fraction: float = SAMPLE_FRACTION,
            seed: int = 11) -> dict[str, tuple[float, float]]:
    """name -> (seconds per document, share rejected), each rule on its own,
    over a sample of ``fraction`` of the rows. Empty if the sample is."""
    texts = docs.select("text").sample(fraction=fraction, seed=seed)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spent, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += rule.rejects(Text(text))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(rejected, pa.int64()),
             pa.array([seen] * len(rules), pa.int64())], ["rule", "spent", "rejected", "seen"])

    sums = (texts.mapInArrow(run, "rule int, spent double, rejected bigint, seen bigint")
            .groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"),
                                 F.sum("seen").alias("seen")))
    return {rules[r.rule].name: (r.spent / r.seen, r.rejected / r.seen) for r in sums.collect() if r.seen}


def cascade_order(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejections per second first; unmeasured rules last, as given."""
    def gain(rule: Rule) -> float:
        cost, share = measured.get(rule.name, (1.0, -1.0))
        return share / max(cost, 1e-9)
    return sorted(rules, key=gain, reverse=True)


def first_rejection(text: Text, ordered: Sequence[Rule]) -> str | None:
    return next((rule.name for rule in ordered if rule.rejects(text)), None)


def score(docs: DataFrame, rules: Sequence[Rule] = RULES, fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept: one row per input row.

    A null text has no words and fails the base rules, as an empty one does. A
    null doc_id stays null; repeated rows give repeated results; an empty
    table gives no rows; texts of any length are judged whole.
    """
    ordered = cascade_order(rules, measure(docs, rules, fraction))
    base = [r for r in ordered if r in BASE]
    rest = [r for r in ordered if r not in BASE]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = [[] for _ in numbers]
            failed, kept = [], []
            for text in map(Text, batch.column(1).to_pylist()):
                for values, name in zip(columns, numbers):
                    values.append(getattr(text, name))
                failed.append(first_rejection(text, base) is not None)
                kept.append(not failed[-1] and first_rejection(text, rest) is None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, pa.int64()) for v in columns), pa.array(failed, pa.bool_()),
                 pa.array(kept, pa.bool_())], ["doc_id", *numbers, "base_failed", "kept"])

    return docs.mapInArrow(run, ", ".join(["doc_id bigint", *(f"{n} bigint" for n in numbers),
                                           "base_failed boolean", "kept boolean"]))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """doc_id and the first rule that rejects the document (null: kept); rules
    run short-circuit, so features no rule asked for are never computed."""
    ordered = cascade_order(rules, measure(docs, rules, fraction))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([first_rejection(Text(t), ordered) for t in batch.column(1).to_pylist()],
                                           pa.string())], ["doc_id", "rejected_by"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, rejected_by string")
