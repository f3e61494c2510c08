"""Pulling exports: what is new, once, over stops and restarts; late duplicates; lines half written, odd lines."""

import json
import os

from quillstone.streaming.pull import pull, pulled


def lines(*contents, **other):
    return "".join(json.dumps({"channel": "emails", "content": c, **other}) + "\n" for c in contents)


def found(spark, table):
    return sorted((r["content"] or "", r["duplicates"]) for r in pulled(spark, table).collect())


def test_pull(spark, tmp_path):
    box, table, check = (str(tmp_path / n) for n in ("box", "table", "check"))
    os.makedirs(box)
    one, two = f"{box}/one.jsonl", f"{box}/two.jsonl"
    open(one, "w").write(lines("a", "b", "a") + '{"channel": "emails", "content": "ha')
    pull(spark, box, table, check)
    assert found(spark, table) == [("a", 1), ("b", 0)]

    # The half line is ended, a file comes with a late duplicate, a broken line, a null and an empty content.
    open(one, "a").write('lf"}\n')
    open(two, "w").write(lines("b", "c", "", source="s") + '{"channel": "x"}\n{broken\n[1]\n' + lines("d"))
    pull(spark, box, table, check)
    second = [("", 1), ("[1]", 0), ("a", 1), ("b", 1), ("c", 0), ("d", 0), ("half", 0), ("{broken", 0)]
    assert found(spark, table) == second
    by = {r["content"]: r for r in pulled(spark, table).collect()}
    assert by["{broken"]["channel"] == "quarantine" and by["b"]["source"] is None and by["c"]["source"] == "s"

    pull(spark, box, table, check)  # nothing new
    assert found(spark, table) == second

    # As if the last run had stopped after its rows were written and before its batch was committed.
    open(two, "a").write(lines("e", "a", "e"))
    pull(spark, box, table, check)
    commits = sorted((f for f in os.listdir(f"{check}/commits") if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{check}/commits/{f}"):
            os.remove(f"{check}/commits/{f}")
    open(one, "a").write(lines("f"))
    pull(spark, box, table, check)
    third = sorted([*(x for x in second if x[0] != "a"), ("a", 2), ("e", 1), ("f", 0)])
    assert found(spark, table) == third

    # A file written anew, shorter than before, is read from its start; one that is gone does no harm.
    os.remove(one)
    open(two, "w").write(lines("c", "g"))
    pull(spark, box, table, check)
    assert found(spark, table) == sorted([*(x for x in third if x[0] != "c"), ("c", 1), ("g", 0)])


def test_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "box")
    pull(spark, str(tmp_path / "box"), str(tmp_path / "table"), str(tmp_path / "check"))
    assert not os.path.exists(tmp_path / "table") or found(spark, str(tmp_path / "table")) == []


def test_lines_longer_than_a_block_and_splits(spark, tmp_path):
    from quillstone.sources.providers import BLOCK, ExportSource, _Stream

    os.makedirs(tmp_path / "box")
    path = str(tmp_path / "box" / "x.jsonl")
    text = lines("x" * (3 * BLOCK), "y") + "z" * (2 * BLOCK)
    open(path, "w").write(text)
    stream = _Stream(str(tmp_path / "box"), 1000, ".jsonl")
    end = stream.latestOffset()
    assert end == {path: text.rindex("\n") + 1}
    got = [row[-1][0] for part in stream.partitions({}, end) for row in stream.read(part)]
    assert got == ["x", "y"] and ExportSource.name() == "provider_export"
    assert stream.partitions(end, end)[0].value is None
