"""What the driver holds while a classifier is fitted, and how tightly numbered rows are packed."""

import tracemalloc

import numpy as np
import pyarrow.parquet as pq

from sparkseek.llm import common, toxicity


def test_fit_holds_one_block_besides_its_data():
    pick = np.random.default_rng(1)
    size = np.full(3000, 1000)
    place = pick.integers(0, 2000, size.sum()).astype(np.int32)
    toxic = np.arange(3000) % 2
    tracemalloc.start()
    w, bias = toxicity._fit(place, np.ones(len(place), dtype=np.int32), size, pick.normal(size=2000), toxic, 2, 1e-4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w) == 2000 and np.isfinite(bias)
    assert peak < 60 << 20  # all values at once take 24 MB each, and five of them


def test_fit_does_not_depend_on_blocks(monkeypatch):
    pick = np.random.default_rng(2)
    size = pick.integers(0, 30, 200)
    place = np.concatenate([pick.choice(100, n, replace=False) for n in size]).astype(np.int32)
    count, ratio, toxic = pick.integers(1, 4, len(place)).astype(np.int32), pick.normal(size=100), np.arange(200) % 2
    whole = toxicity._fit(place, count, size, ratio, toxic, 20, 1e-4)
    monkeypatch.setattr(toxicity, "_FIT_ENTRIES", 50)
    parts = toxicity._fit(place, count, size, ratio, toxic, 20, 1e-4)
    assert np.allclose(whole[0], parts[0]) and np.isclose(whole[1], parts[1])


def test_numbered_rows_are_packed(spark):
    rows = common.numbered_rows(spark.createDataFrame([("some text",)], "text string"))
    files = [f.removeprefix("file:").removeprefix("//") for f in rows.inputFiles()]
    groups = [meta.row_group(g) for meta in (pq.ParquetFile(f).metadata for f in files) for g in range(meta.num_row_groups)]
    assert {group.column(0).compression for group in groups} == {"ZSTD"}
