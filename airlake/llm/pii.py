"""Personal data by bootstrapped contextual extraction.

Base patterns give the seed entities. The two words before an entity are a
lexical pattern, and so are a label alone ("tel:") and the first word of a
line; the same words before another identifier-like run, one that no base
pattern knows, tie that run to the pattern. Spark scores the graph of patterns
and instances in rounds: a pattern is as good as the known instances it
precedes, an instance as good as the patterns it follows. Instances that
high-confidence patterns carry become further spans, named ``ctx_<kind>``, and
support further patterns in the next round, until nothing changes.

Texts stay in the scan: what is shuffled are pattern-instance edges, combined
per pattern and instance, so that a phrase found in a third of the documents
is a sum and not a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5        # distinct instances of a kind behind a pattern
MIN_SCORE = 0.9      # of a pattern, and of an instance it adds
CONTEXT_WORDS = 2
MOST_BROADCAST = 100_000   # rows of discovered spans sent to all tasks

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that does not start a match has no later start that does
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: identifier-like runs: handles with an @, and numbers of seven digits or more
OTHER = re.compile(r"(?<![\w@.+-])(?:[\w.%+-]+@[\w.-]*\w|\(?[0-9][0-9()\x20./-]{5,}[0-9])(?![\w@])")
MARKS = tuple(":#=")
WORD_BEFORE = re.compile(r"[^\W_]+[:#=]*")
LABEL = re.compile(r"([^\W_]+)[\x20\t]*([:#=]+)$")
LINE_END = re.compile(r"[\r\n]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(_is_octet, m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def contexts(text: str, start: int) -> list[str]:
    """Patterns of a position, lower-cased, digits as 0: the two words before
    it, and as back-off a label (a word with a mark) on its own, and a word
    that is the first of its line (after ``^``)."""
    at = max(0, start - 80)
    before = text[at:start].rstrip("\x20\t([\"'<")
    words = WORD_BEFORE.findall(before)[-CONTEXT_WORDS:]
    if not words:
        return []
    out = [" ".join(words)] if len(words) == CONTEXT_WORDS else []
    label = LABEL.search(before) if before.endswith(MARKS) else None
    if label:
        out.append(label[1] + label[2])
    line = LINE_END.split(before)
    first = WORD_BEFORE.findall(line[-1])
    if len(first) == 1 and (len(line) > 1 or at == 0):
        out.append("^" + first[0])
    return [DIGIT.sub("0", p.lower()) for p in out]


def mentions(text: str) -> tuple[list, list]:
    """Base spans, and for each identifier-like run (base ones included):
    patterns, instance, kind number (None if no base pattern knows it), span."""
    spans = base_spans(text)
    seen = [(contexts(text, s), text[s:e].lower(), k, s, e) for s, k, e in spans]
    if "@" in text or DIGIT.search(text):
        at = 0
        for m in OTHER.finditer(text):
            s, e = m.span()
            if "@" not in m[0] and len(NOT_DIGIT.sub("", m[0])) < 7:
                continue
            while at < len(spans) and spans[at][2] <= s and at + 1 < len(spans):
                at += 1
            if not any(x < e and s < y for x, _, y in spans[max(0, at - 4):at + 5]):
                seen.append((contexts(text, s), m[0].lower(), None, s, e))
    return spans, [x for x in seen if x[0]]


FOUND = ("row bigint, doc_id bigint, spans array<struct<start:int,rank:int,end:int>>, "
         "mentions array<struct<patterns:array<string>,instance:string,kind:int,start:int,end:int>>")


def extract(docs: DataFrame) -> DataFrame:
    """row (a hash of the text), doc_id, base spans and mentions per document."""
    import pyarrow as pa

    docs = docs.select(F.xxhash64("text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    mention_type = pa.list_(pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.string()), ("kind", pa.int32()),
                                       ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            both = [mentions(t) for t in batch.column(2).to_pylist()]
            spans = [[dict(zip(("start", "rank", "end"), s)) for s in b] for b, _ in both]
            seen = [[dict(zip(("patterns", "instance", "kind", "start", "end"), m)) for m in x] for _, x in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, span_type), pa.array(seen, mention_type)],
                ["row", "doc_id", "spans", "mentions"])

    return docs.mapInArrow(run, FOUND)


def confident(edges: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """pattern, instance, kind of the instances that good patterns add, from
    ``edges(pattern, instance, kind)`` (kind: of the seed, null if unknown).

    A pattern's score for a kind is the mean score of its distinct instances
    that have a kind: 1 for a seed, 0 for an instance of another kind, its own
    score for an accepted one. Unknown instances do not count. An unknown
    instance's score is ``1 - product of (1 - score)`` over its patterns with
    enough instances of the kind; from ``min_score`` on it is accepted, with
    its best kind, for good. Rounds go on until none is accepted."""
    nodes = cut_lineage(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    unknown = cut_lineage(nodes.where("kind is null").select("pattern", "instance"))
    # patterns without unknown instances have nothing to add
    seeds = cut_lineage(nodes.where("kind is not null")
                        .join(unknown.select("pattern").distinct(), "pattern", "left_semi")
                        .groupBy("pattern", "kind").agg(F.count("*").alias("n")))
    seeds = seeds.withColumn("sum", F.col("n").cast("double"))
    sure = good = None
    while True:
        held = seeds
        if sure is not None:
            held = seeds.unionByName(unknown.join(sure, "instance").groupBy("pattern", "kind").agg(
                F.count("*").alias("n"), F.sum("score").alias("sum")))
        held = held.groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        of_any = F.sum("n").over(Window.partitionBy("pattern"))  # one row per kind
        scored = cut_lineage(held.select("pattern", "kind", "n", (F.col("sum") / of_any).alias("score"))
                             .where(F.col("n") >= min_seeds).drop("n"))
        now = scored.where(F.col("score") >= min_score).select("pattern", "kind")
        good = now if good is None else cut_lineage(good.union(now).distinct())
        # score of each unknown instance: one minus the product of the misses, no less than its best pattern's
        miss = F.exp(F.sum(F.log(F.greatest(1.0 - F.col("score"), F.lit(1e-12)))))
        open_ = unknown if sure is None else unknown.join(sure, "instance", "left_anti")
        reached = (open_.join(scored, "pattern").groupBy("instance", "kind")
                   .agg(F.greatest(1.0 - miss, F.max("score")).alias("score")).where(F.col("score") >= min_score))
        new = cut_lineage(reached.groupBy("instance").agg(
            F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best"))
            .select("instance", (-F.col("best.kind")).alias("kind"), F.col("best.score").alias("score")))
        if new.isEmpty():
            break
        sure = new if sure is None else cut_lineage(sure.union(new))
    named = new if sure is None else sure
    return unknown.join(good, "pattern").join(named.select("instance", "kind"), ["instance", "kind"]).select(
        "pattern", "instance", "kind")


def discovered(found: DataFrame, **limits) -> DataFrame:
    """row, doc_id and the further spans of every document that has any."""
    seen = found.select("row", "doc_id", F.explode("mentions").alias("m")).select("row", "doc_id", "m.*")
    seen = seen.withColumn("pattern", F.explode("patterns")).drop("patterns")
    sure = confident(seen.select("pattern", "instance", "kind"), **limits)
    open_ = seen.where("kind is null").drop("kind").join(sure, ["pattern", "instance"])
    spans = open_.groupBy("row", "doc_id", "start", "end").agg(F.min("kind").alias("kind"))
    return spans.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "start", (F.col("kind") + len(KINDS)).alias("rank"), "end"))).alias("more"))


def _with_more(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` with ``more`` spans: these are few, and sent to all tasks up
    to ``MOST_BROADCAST`` rows; beyond, both sides are shuffled."""
    more = cut_lineage(more).withColumnRenamed("row", "row2").withColumnRenamed("doc_id", "doc_id2")
    if more.count() <= MOST_BROADCAST:
        more = F.broadcast(more)
    return found.join(more, (found.row == more.row2) & found.doc_id.eqNullSafe(more.doc_id2), "left").drop(
        "row2", "doc_id2").withColumn("more", F.coalesce("more", F.array().cast(
            "array<struct<start:int,rank:int,end:int>>")))


NAMES = (*KINDS, *(f"ctx_{k}" for k in KINDS))


def _joined(spans):
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", names[s["rank"]], s["start"], s["end"])), ",")


def find(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, spans (base: start, rank, end) and more (discovered spans): one
    row per input row.

    A null text counts as empty; a null doc_id stays null; repeated rows give
    repeated results; an empty table gives no rows. Positions are code points,
    ends exclusive; texts of any length are searched whole.
    """
    found = cut_lineage(extract(docs))
    return _with_more(found.select("row", "doc_id", "spans"), discovered(found, **limits)).drop("row")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find``."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"),
                        _joined(F.concat("spans", "more")).alias("spans"),
                        F.size("more").cast("long").alias("n_context"))


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind; overlaps become one."""
    out, at = [], 0
    for start, rank, end in spans:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"[{NAMES[rank].removeprefix('ctx_').upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with all its columns, personal data in ``text`` replaced by its
    kind in brackets and ``n_chars`` (if there) set to the new length. A null
    text stays null. The texts are not shuffled while discovered spans are few."""
    found = extract(docs)
    spans = cut_lineage(found.select("row", "doc_id", "mentions"))
    more = discovered(spans, **limits)
    rows = docs.select(F.struct("*").alias("all")).select(
        "all", F.xxhash64("all.text").alias("row"), F.col("all.doc_id").cast("long").alias("doc_id"))
    marked = _with_more(rows, more).select("all", "all.text", F.col("more").alias("more"))

    @F.pandas_udf("string")
    def replace(text, more):
        import pandas as pd

        out = []
        for t, m in zip(text, more):
            if t is not None:
                t = masked(t, sorted([*base_spans(t), *((x["start"], x["rank"], x["end"]) for x in m)]))
            out.append(t)
        return pd.Series(out, dtype=object)

    changed = marked.withColumn("text", replace("text", "more"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            columns.append(F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType),
                                      F.col("all.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col("all").getField(name).alias(name))
    return changed.select(*columns)
