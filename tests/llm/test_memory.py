"""What a step holds in memory at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillstone.llm import common, decontaminate


def test_scans_hold_few_rows_of_text(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 4096)
        common.batches(spark)
        assert int(spark.conf.get(name)) == common.SCAN_ROWS
        spark.conf.set(name, 100)  # a session's own lower setting stays
        common.batches(spark)
        assert int(spark.conf.get(name)) == 100
    finally:
        spark.conf.set(name, before)


def test_decontamination_of_a_batch_takes_a_few_times_its_bytes():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), 4000)) for _ in range(1000)]
    item = texts[500][100:300]
    part = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    drop = decontaminate._drop(decontaminate.Index([(1, item)]))
    tracemalloc.start()
    try:
        tracemalloc.reset_peak()
        (left,) = drop(iter([part]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert left.column("text").to_pylist() == [t for t in texts if item not in t] and left.num_rows == 999
    assert peak < 20 << 20
