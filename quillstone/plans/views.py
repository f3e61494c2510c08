"""Saved views: YAML view files compiled to plans.

A view file has the keys view, filter, columns and views (a list of {type, name}); keys that begin with
// are comments. As written, a filter of {} keeps every row. As intended, a view keeps the rows that
its comment describes; those predicates are given here by the view's name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class View:
    name: str
    columns: list[str]
    filter: dict = field(default_factory=dict)
    kind: str = "table"
    views: list[dict] = field(default_factory=list)


#: The five views: columns in order. Their filters are all {}.
VIEWS = {
    v.name: v
    for v in (
        View("graph-invariants", ["file.name", "type", "works_at", "sources", "contradicts", "status"]),
        View("inbox-status", ["file.name", "source", "channel", "captured_at"]),
        View("lint-orphans", ["file.name", "type", "created", "last_verified"]),
        View("lint-stale", ["file.name", "type", "last_verified", "status"]),
        View("quarantine", ["file.name", "source", "channel", "captured_at"]),
    )
}


def load(text: str, name: str) -> View:
    """A view from a view file's text."""
    import yaml

    spec = {k: v for k, v in yaml.safe_load(text).items() if not str(k).startswith("//")}
    return View(name, list(spec.get("columns") or []), dict(spec.get("filter") or {}), spec.get("view", "table"), list(spec.get("views") or []))


def alias(column: str) -> str:
    """file.name -> file_name: the name of a view's column in the tables."""
    return column.replace(".", "_")


def as_written(view: View, rows: DataFrame) -> DataFrame:
    """The view's projection; no filter node for {}."""
    if view.filter:
        raise ValueError(f"view {view.name}: no grammar is known for the filter {view.filter}")
    return rows.select(*(F.col(alias(c)) for c in view.columns))


def as_intended(view: View, rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The projection of the rows that `keep` leaves; the predicate runs below the projection."""
    return as_written(view, keep(rows))


def folder(name: str) -> Callable[[DataFrame], DataFrame]:
    """Rows whose path is under raw/<name>/."""
    return lambda rows: rows.where(F.col("path").startswith(f"raw/{name}/"))
