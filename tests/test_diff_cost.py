"""Diffs of many sources are worked out once, and pages with many sources are read by the parser in C where there is one."""

import time

import pytest

from quillstone.functions import frontmatter
from quillstone.operators import ingest


def test_a_consolidated_diff_is_worked_out_once(spark):
    rows = [("b", "s1", "p1", "create", None, "x"), ("b", "s1", "p2", "update", "x", "y"), ("b", None, "p3", "delete", "x", None)]
    changes = spark.createDataFrame(rows, "batch_id string, source_path string, path string, op string, before string, after string")
    got = ingest.consolidated(changes)
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["source_path"], r["path"], r["n"]) for r in got.collect()] == [(None, "p3", 1), ("s1", "p1", 2), ("s1", "p2", 2)]


def test_a_page_with_many_sources_is_parsed_fast():
    yaml = pytest.importorskip("yaml")
    if not hasattr(yaml, "CBaseLoader"):
        pytest.skip("no libyaml")
    block = "type: tofile\nsources:\n" + "".join(f"  - raw/meetings/2001/05/i{i}.md\n" for i in range(20_000))
    began = time.process_time()
    found = frontmatter.load(block)
    took = time.process_time() - began
    began = time.process_time()
    assert found == yaml.load(block, Loader=yaml.BaseLoader)
    assert took * 3 < time.process_time() - began
