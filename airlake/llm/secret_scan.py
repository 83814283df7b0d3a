"""Secret scans with corpus-wide ownership frequency.

Base patterns and generic credential candidates are found in whole texts with
Spark's regular expressions. The hash of every candidate value is counted over
the corpus by distinct repositories (documents) and owners (sources): a value
under many owners, or in very many repositories of a few, is a widely copied
example; one that fewer hold looks live. Generic candidates that look live
become spans of their own.

Everything is DataFrame expressions. Only short arrays of spans leave the scan,
never the texts; counts are pre-aggregated by value, owner and repository, so
a value that a third of the documents hold is combined before it is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.session import cut_lineage


class Kind(NamedTuple):
    name: str
    pattern: str     # leftmost, non-overlapping
    group: int       # of the value
    least: int       # characters of the value
    hint: str        # a text without this has no match that counts
    needs: tuple[str, ...] = ()   # the value holds all of these


#: The base kinds of the contract, in its order. Runs that are
#: too short are left out in the pattern where that changes no other match.
BASE = (
    Kind("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12, r"(?i)password|passwd|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)
#: Further credentials: long runs, of any length, that mix cases and digits.
LIVE = Kind("live", r"[A-Za-z0-9+/_-]{20,}+", 0, 20, r"[A-Za-z0-9+/_-]{20}", ("[0-9]", "[A-Z]", "[a-z]"))
KINDS = (*BASE, LIVE)
EXAMPLE_OWNERS = 3          # a value under so many owners is an example,
EXAMPLE_REPOSITORIES = 50   # as is one in so many repositories of fewer owners
BLOCK = 512

SPAN = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """Spans of one kind: split() gives the texts between the matches and
    regexp_extract_all() the matches; their lengths add up to positions. The
    sum runs in blocks, so that its arrays stay short in a text full of
    matches."""
    pattern = F.lit(kind.pattern)

    def counts(value: Column) -> Column:
        enough = F.length(value) >= kind.least
        for need in kind.needs:
            enough = enough & value.rlike(need)
        return enough

    def one(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"),
                        F.lit(kind.name).alias("kind"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(counts(part["value"]), F.concat(state["out"], F.array(span)))
                        .otherwise(state["out"]).alias("out"))

    def fold(found: Column) -> Column:
        last = F.floor(F.greatest(F.size(found) - 1, F.lit(0)) / BLOCK).cast("int")
        blocks = F.sequence(F.lit(0), last)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        whole = F.aggregate(blocks, start, lambda acc, b: F.aggregate(
            F.slice(found, b * BLOCK + 1, BLOCK),
            F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), one,
            lambda inner: F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))))
        return whole["out"]

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = hits if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))
    found = F.zip_with(F.arrays_zip(hits.alias("hit"), values.alias("value")), F.split(text, kind.pattern, -1),
                       lambda a, gap: F.struct(gap.alias("gap"), a["hit"].alias("hit"), a["value"].alias("value")))
    found = _let(found, lambda all_: F.filter(all_, lambda p: p["hit"].isNotNull()))
    return F.when(text.rlike(kind.hint), _let(found, fold)).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, base (all base spans) and more (generic ones that
    no base span covers whole): one row per input row, without the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("source").cast("string").alias("source"),
                        F.concat(*[_spans(text, i, k) for i, k in enumerate(BASE)]).alias("base"),
                        _spans(text, len(BASE), LIVE).alias("more"))
    return cut_lineage(found.withColumn("more", F.filter("more", lambda m: ~F.exists(
        "base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))))


def ownership(found: DataFrame) -> DataFrame:
    """value (hash), repositories, owners: distinct documents and sources that
    hold the value. Rows without a doc_id are repositories of their own, a
    null source counts as one owner."""
    held = found.select("row", "doc_id", "source", F.explode(F.concat("base", "more")).alias("span")).select(
        F.sha2("span.value", 256).alias("value"), F.coalesce("source", F.lit("\0")).alias("owner"),
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row"))).alias("repository"))
    return (held.distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
            .groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners")))


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS,
         example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, base (spans), live (further spans), n_owned, n_example: one row
    per input row. Examples are candidates that ``example_owners`` owners or
    ``example_repositories`` repositories hold, or more. ``live`` are the generic
    candidates that are none; n_example counts all candidates that are, n_owned
    those that are none and have one owner.

    A null text counts as empty and has no spans; a null doc_id or source is
    kept; repeated rows give repeated results; an empty table gives no rows.
    Positions are code points, ends exclusive.
    """
    found = candidates(docs)
    held = found.select("row", F.explode(F.concat("base", "more")).alias("span"))
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    counted = held.withColumn("value", F.sha2("span.value", 256)).join(
        ownership(found).select("value", "owners", example.alias("example")), "value")
    by_row = counted.groupBy("row").agg(
        F.collect_list(F.when((F.col("span.kind") == LIVE.name) & ~F.col("example"), F.col("span"))).alias("live"),
        F.count_if(~F.col("example") & (F.col("owners") == 1)).alias("n_owned"),
        F.count_if("example").alias("n_example"))
    none = F.array().cast(SPAN)
    return found.join(by_row, "row", "left").select(
        "doc_id", "base", F.coalesce("live", none).alias("live"), F.coalesce("n_owned", F.lit(0)).alias("n_owned"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        "doc_id", *[count(k.name) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "live")).alias("spans"), "n_owned", "n_example")
