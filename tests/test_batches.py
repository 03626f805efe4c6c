"""Memory of tasks: rows of a batch become Python objects a few at a time."""

import gc
import tracemalloc

import pyarrow as pa

from tokenloom.functions.batches import slices


def test_slices():
    batch = pa.RecordBatch.from_pydict({"a": [1, None, 3, 4, 5], "b": ["x", "y", None, "z", ""]})
    assert list(slices([batch, batch.slice(0, 0)], 2)) == [[[1, None], ["x", "y"]], [[3, 4], [None, "z"]], [[5], [""]]]
    wide = pa.RecordBatch.from_pydict({"a": ["ü" * 4000 + str(k) for k in range(4000)]})
    gc.collect()
    tracemalloc.start()
    assert sum(len(a) for (a,) in slices([wide])) == 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # all rows as Python strings are 16 MB


def test_a_batch_is_no_frame_of_texts(spark, monkeypatch):
    """Personal data is found, and files are made, from slices: neither asks for pandas frames or a column of whole files."""
    from tokenloom.llm import pii
    from tokenloom.plans import roundtrips

    df = spark.createDataFrame([(1, "mail a@b.co"), (None, None), (3, "")], "doc_id bigint, text string")
    found = pii.find_pii(df)
    assert [(r.doc_id, r.n_email, r.spans) for r in found.orderBy("n_email", "doc_id").collect()] == [(None, 0, ""), (3, 0, ""), (1, 1, "email:5:11")]
    seen = []
    monkeypatch.setattr(roundtrips, "_files_of", lambda d, *_: seen.append(d) or 0)
    monkeypatch.setattr(roundtrips.tar, "broken_shards", lambda s, p: s.createDataFrame([], "path string"))
    roundtrips.checked_shards(spark, "/root/testdata/sf0.001")
    for d in (found, seen[0]):
        plan = d._jdf.queryExecution().analyzed().toString()
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan and "packed(" not in plan
