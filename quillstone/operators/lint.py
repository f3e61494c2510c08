"""Health checks over pages, links and edges; each gives rows (rule, slug, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import is_empty, wikilinks


def links(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct wikilinks from page bodies."""
    return pages.select(F.col("slug").alias("src"), F.explode(wikilinks("body")).alias("dst")).distinct()


def orphans(pages: DataFrame, links_: DataFrame, key: str = "slug", target: str = "dst") -> DataFrame:
    """Pages that nothing links to (a page's link to itself counts as a link): an anti join on the key."""
    return pages.join(links_.select(F.col(target).alias(key)), key, "left_anti")


def stale(pages: DataFrame, as_of: str | Column, days: int = 90, column: str = "last_verified") -> DataFrame:
    """Pages last verified more than `days` days before `as_of`; exactly `days` is not stale, null is not reported here."""
    at = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return pages.where(F.col(column) < F.date_sub(at, days))


def never_verified(pages: DataFrame, column: str = "last_verified") -> DataFrame:
    return pages.where(F.col(column).isNull())


def missing_values(pages: DataFrame, kind: str, column: str) -> DataFrame:
    """Pages of a type whose list is absent, null or empty: a person without works_at, a decision without sources."""
    return pages.where((F.col("type") == kind) & is_empty(column))


def contradictions(pages: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs where one contradicts the other and neither has superseded_by."""
    named = pages.select(F.col("slug").alias("x"), F.explode("contradicts").alias("y"), F.col("superseded_by").alias("xs"))
    other = pages.select(F.col("slug").alias("y"), F.col("superseded_by").alias("ys"))
    open_ = named.join(other, "y").where("xs is null and ys is null and x <> y")
    return open_.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _finding(rows: DataFrame, rule: str, slug: str = "slug", detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(slug).alias("slug"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def invariants(pages: DataFrame) -> DataFrame:
    """The graph invariants in one view, tagged by rule."""
    return (
        _finding(missing_values(pages, "person", "works_at"), "person_without_works_at")
        .unionByName(_finding(missing_values(pages, "decision", "sources"), "decision_without_sources"))
        .unionByName(_finding(contradictions(pages), "unresolved_contradiction", "a", F.col("b")))
    )


def lint(pages: DataFrame, as_of: str | Column, days: int = 90) -> DataFrame:
    """All findings: invariants, orphans, stale and never verified pages, and links to pages that don't exist."""
    own = links(pages)
    dangling = own.join(pages.select(F.col("slug").alias("dst")), "dst", "left_anti")
    parts = [
        invariants(pages),
        _finding(orphans(pages, own), "orphan"),
        _finding(stale(pages, as_of, days), "stale", detail=F.col("last_verified").cast("string")),
        _finding(never_verified(pages), "never_verified"),
        _finding(dangling, "dangling_link", "src", F.col("dst")),
    ]
    return reduce(DataFrame.unionByName, parts)


def debt(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("n"))
