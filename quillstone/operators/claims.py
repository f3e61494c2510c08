"""Claims that sources make, and what becomes of one when another says otherwise.

A claim is a value of a subject's attribute: "X works at Y", "X's role is chair", with "since 2026-05-01" after it if it says from
when it holds. It has two times: valid_from, which the text may give, and recorded_at, when it was captured. Claims
that say the same are one, verified by the last of them. Each is compared with the one recorded before it, an as-of
join in the form of a window: where the values differ, a claim that holds from a later day supersedes the other, and any other
contradicts it. Contradictions stay open until one side is superseded, as with pages, and are found by the same check.

Scale. Equal claims are folded by an aggregate before anything is ordered, so what is sorted within an attribute of a subject are its
different values, not its mentions. Defined cases: a null text makes no claims; repeated items make the same claims; a date that there isn't counts as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import slugify

_SINCE = r"(?: since (\d{4}-\d{2}-\d{2}))?"
#: (pattern, groups of subject, attribute, value and date; an attribute may be fixed).
FORMS = (
    (r"\b([A-Z]\w+(?: [A-Z]\w+)?) works at ([A-Z]\w+)" + _SINCE, 1, "works_at", 2, 3),
    (r"\b([A-Z][\w-]*(?: [A-Z][\w-]*)?)'s ([a-z]+(?: [a-z]+)?) is ([^.\n]{1,80}?)" + _SINCE + r"(?=[.\n]|$)", 1, 2, 3, 4),
)


def extract(items: DataFrame, text: str = "content", source: str = "path", at: str = "captured_at") -> DataFrame:
    """(subject, attribute, value, valid_from, source, recorded_at) of the claims in items' texts."""
    every = None
    for pattern, who, what, value, since in FORMS:
        group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))  # noqa: B023, E731
        names = F.transform(group(who), lambda x: F.lit(what)) if isinstance(what, str) else group(what)
        each = F.arrays_zip(group(who).alias("who"), names.alias("what"), group(value).alias("value"), group(since).alias("since"))
        rows = items.select(F.col(source).alias("source"), F.col(at).alias("recorded_at"), F.explode(each).alias("e"))
        told = slugify("e.value") if isinstance(what, str) else F.trim("e.value")
        rows = rows.select(slugify("e.who").alias("subject"), F.replace(F.col("e.what"), F.lit(" "), F.lit("_")).alias("attribute"), told.alias("value"), F.try_to_date("e.since").alias("valid_from"), "source", "recorded_at")
        every = rows if every is None else every.unionByName(rows)
    return every.distinct()


def settle(claims: DataFrame) -> DataFrame:
    """(slug, subject, attribute, value, valid_from, first_recorded, last_verified, n, contradicts, superseded_by) of claims as `extract` gives them.

    slug names a claim; contradicts and superseded_by name others, as pages' do, so `lint.contradictions` finds the open ones.
    """
    key = F.concat_ws("/", "subject", "attribute", F.substring(F.sha2(F.concat_ws("\n", "value", F.coalesce(F.col("valid_from").cast("string"), F.lit(""))), 256), 1, 12))
    one = claims.groupBy("subject", "attribute", "value", "valid_from").agg(F.min("recorded_at").alias("first_recorded"), F.max("recorded_at").cast("date").alias("last_verified"), F.count("*").alias("n"))
    order = Window.partitionBy("subject", "attribute").orderBy("first_recorded", F.asc_nulls_first("valid_from"), "value")
    rows = one.withColumn("slug", key).withColumn("since", F.coalesce("valid_from", F.col("first_recorded").cast("date")))
    before = lambda c: F.lag(c).over(order)
    after = lambda c: F.lead(c).over(order)
    other = before("value").isNotNull() & (before("value") != F.col("value"))
    replaces = other & F.coalesce(F.col("valid_from") > before("since"), F.lit(False))
    replaced = F.coalesce((after("value") != F.col("value")) & (after("valid_from") > F.col("since")), F.lit(False))
    out = rows.withColumns({"contradicts": F.when(other & ~replaces, F.array(before("slug"))), "superseded_by": F.when(replaced, after("slug"))})
    return out.select("slug", "subject", "attribute", "value", "valid_from", "first_recorded", "last_verified", "n", "contradicts", "superseded_by")


def as_of(asked: DataFrame, claims: DataFrame) -> DataFrame:
    """`asked` (subject, attribute, day, known) with the value that holds on a day by what was recorded until `known`: that of the latest beginning, then the latest recorded.

    A claim without a date holds from the day it was recorded. Both times are conditions of one join on subject and attribute, of which one row a question is kept.
    """
    held = claims.select(F.col("subject").alias("_s"), F.col("attribute").alias("_a"), "value", F.coalesce("valid_from", F.col("recorded_at").cast("date")).alias("_from"), "recorded_at")
    on = (F.col("subject") == F.col("_s")) & (F.col("attribute") == F.col("_a")) & (F.col("_from") <= F.col("day")) & (F.col("recorded_at") <= F.col("known"))
    best = F.max_by("value", F.struct("_from", "recorded_at", "value")).alias("value")
    return asked.join(held, on, "left").groupBy(*asked.columns).agg(best)
