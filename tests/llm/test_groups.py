"""PPM's groups: bounded by what their memory goes by, with text that doesn't repeat; notices in great number."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from quillstone.llm import licenses, ppm

#: 32 MB of base64 in 64 documents, dealt, tallied and scored group by group in one process.
RANDOM = """
import base64, resource
import numpy as np, pyarrow as pa
from pyspark import TaskContext
from quillstone.llm import ppm
TaskContext.get = classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})())
rng = np.random.default_rng(1)
def parts():
    for d in range(64):
        text = base64.b64encode(rng.bytes(3 << 17))
        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([d % 7 == 2]), pa.array([text], pa.binary())], ["doc_id", "held", "text"])
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
dealt = list(ppm._deal(ppm.GROUP_BYTES)(parts()))
groups = {}
for b in dealt:
    groups.setdefault(b.column("g")[0].as_py(), []).append(b)
rows = 0
for g, own in groups.items():
    got = list(ppm._tally(iter(own)))
    table = pa.Table.from_batches(got)
    del got
    model = pa.table({"kind": table["kind"], "key": table["key"], "value": table["c"].cast(pa.float64())})
    del table
    rows += ppm._score(10, 10)(None, pa.Table.from_batches(own), model).num_rows
    del model
assert rows == 64
print(len(groups), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


def test_groups_of_random_text_stay_small():
    done = subprocess.run([sys.executable, "-c", RANDOM], capture_output=True, text=True, timeout=600, cwd=Path(__file__).parents[2])
    assert done.returncode == 0, done.stderr[-2000:]
    groups, mb = map(int, done.stdout.split())
    assert groups >= 8 and mb < 1000, (groups, mb)


def test_estimates_are_near_and_prose_is_dealt_by_bytes(monkeypatch):
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 3_000_000).astype(np.uint8)
    true = len(np.unique(ppm.grams(text, np.array([0, len(text)]))[0]))
    assert abs(len(ppm._sampled(text)) * 64 - true) < 0.05 * true
    texts = [b"the same words again " * 500] * 40 + [b"", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array([False] * 42), pa.array([t or b"" for t in texts], pa.binary())], ["doc_id", "held", "text"])
    dealt = list(ppm._deal(100_000)(iter([batch, batch.slice(0, 0), batch])))
    ids = [i for b in dealt for own in ppm._unpacked(b.column("rows")) for i in own.column("doc_id").to_pylist()]
    assert ids == [*range(42), *range(42)] and len({b.column("g")[0].as_py() for b in dealt}) >= 2
    assert all(b.column("g")[0].as_py() >> 32 == 3 for b in dealt)


def test_many_notices_take_time_in_proportion():
    import time

    name, text = min(licenses.TEMPLATES.items(), key=lambda x: len(x[1]))
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    took = []
    for n in (2000, 8000):
        began = time.perf_counter()
        got = scanner.scan((text + " and so on ").encode() * n)
        took.append(time.perf_counter() - began)
        assert len(got) == n and {g[0] for g in got} == {name} and all(a[3] <= b[2] for a, b in zip(got, got[1:], strict=False))
    assert took[1] < 8 * took[0] + 0.5
