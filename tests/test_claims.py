"""Claims at ingest: what is extracted, what contradicts and supersedes, and that ingesting again changes nothing."""

import datetime

import pytest

from quillstone.operators import claims, lint
from quillstone.vault import Vault

from .test_vault import rows

DAY = lambda d: datetime.datetime(2026, 5, d)
ITEMS = "path string, content string, captured_at timestamp"


def said(spark, *texts):
    return claims.extract(spark.createDataFrame([(f"p{d}", text, DAY(d)) for d, text in texts], ITEMS))


def test_extract(spark):
    got = said(spark, (1, "Cora Lind works at Alder since 2026-01-02. Dan's role is vice chair.\nHe works at night. Old Oak's due date is 5 May since 2026-02-30."), (2, None), (3, "No claims."))
    assert rows(got, "subject", "attribute", "value", "valid_from", "source") == [
        ("cora-lind", "works_at", "alder", datetime.date(2026, 1, 2), "p1"),
        ("dan", "role", "vice chair", None, "p1"),
        ("old-oak", "due_date", "5 May", None, "p1"),
    ]


def test_a_change_without_a_day_contradicts_and_one_with_a_later_day_supersedes(spark):
    told = said(spark, (1, "Dan's role is chair."), (2, "Dan's role is clerk."), (3, "Dan's role is chair."), (1, "Eve's role is chair since 2026-01-01."), (4, "Eve's role is clerk since 2026-03-01."), (5, "Eve's role is chief since 2026-02-01."))
    got = {(r["subject"], r["value"]): r for r in claims.settle(told).collect()}
    name = lambda *k: got[k]["slug"]
    assert got["dan", "clerk"]["contradicts"] == [name("dan", "chair")] and got["dan", "chair"]["superseded_by"] is None
    assert got["dan", "chair"]["last_verified"] == datetime.date(2026, 5, 3) and got["dan", "chair"]["n"] == 2
    assert got["eve", "chair"]["superseded_by"] == name("eve", "clerk") and got["eve", "clerk"]["contradicts"] is None
    assert got["eve", "chief"]["contradicts"] == [name("eve", "clerk")]  # it holds from before
    open_ = {tuple(r) for r in lint.contradictions(claims.settle(told)).collect()}
    assert open_ == {tuple(sorted((name("dan", "chair"), name("dan", "clerk")))), tuple(sorted((name("eve", "chief"), name("eve", "clerk"))))}


def test_as_of_both_times(spark):
    told = said(spark, (1, "Eve's role is chair since 2026-01-01."), (4, "Eve's role is clerk since 2026-03-01."), (5, "Eve's role is chief since 2026-02-01."))
    asked = [(1, "2026-04-01", 3, "chair"), (2, "2026-04-01", 9, "clerk"), (3, "2026-02-15", 9, "chief"), (4, "2026-02-15", 4, "chair"), (5, "2025-01-01", 9, None)]
    table = spark.createDataFrame([(i, "eve", "role", datetime.date.fromisoformat(day), DAY(known)) for i, day, known, _ in asked], "i int, subject string, attribute string, day date, known timestamp")
    assert rows(claims.as_of(table, told), "i", "value") == [(i, v) for i, _, _, v in asked]


@pytest.fixture
def box(spark, tmp_path):
    v = Vault(spark, f"file://{tmp_path}/vault")
    v.init()
    return v


def test_ingest_records_both_claims_and_lint_reports_them(spark, box):
    item = lambda d, text: spark.createDataFrame([(f"n{d}.md", "journal", "s", DAY(d), text)], "file_name string, channel string, source string, captured_at timestamp, content string")
    box._save("pages", box._pages_of(spark.createDataFrame([("wiki/people/cora-lind.md", "---\ntype: person\naliases: [Cora]\nlast_verified: 2026-01-01\nworks_at: [alder]\n---\n")], "path string, content string")))
    box.collect(item(1, "Cora Lind works at Alder."))
    box.ingest("b1", approve=True)
    assert box.lint("2026-05-02").where("rule = 'unresolved_contradiction'").count() == 0
    box.collect(item(9, "Cora works at Birch."))
    assert any("works_at: birch" in r["diff"] for r in box.ingest("b2").collect())
    box.ingest("b2", approve=True)
    page = box.table("pages").where("slug = 'cora-lind'").first()
    assert page["last_verified"] == datetime.date(2026, 5, 9)
    assert "- works_at: alder (n1.md)" in page["body"] and "- works_at: birch (n9.md)" in page["body"]
    assert rows(box.claims(), "subject", "value") == [("cora-lind", "alder"), ("cora-lind", "birch")]
    assert box.lint("2026-05-10").where("rule = 'unresolved_contradiction' and slug like 'cora-lind/works_at/%'").count() == 1
    # Again: the items are known, so nothing changes.
    before = rows(box.table("claims"), "value", "source")
    box.collect(item(9, "Cora works at Birch."))
    assert box.ingest("b3", approve=True).count() == 0 and rows(box.table("claims"), "value", "source") == before
    # A claim with a day resolves it, and undo takes claims back.
    box.collect(item(20, "Cora works at Cedar since 2026-05-15."))
    box.ingest("b4", approve=True)
    assert box.lint("2026-05-21").where("rule = 'unresolved_contradiction'").count() == 0
    box.undo_ingest("b4")
    assert rows(box.claims(), "value") == [("alder",), ("birch",)]
