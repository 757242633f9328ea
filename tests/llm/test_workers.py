"""What operators leave in the Python workers that they share."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lectern.llm import kernels, tokens
from lectern.llm.common import given


def test_tidy_forgets(spark):
    def holds(batches):
        kernels.held("large", lambda: bytes(1 << 20))
        yield from batches

    def sees(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([len(kernels._held)], pa.int64())], names=["n"])

    rows = spark.range(0, 64, 1, 16)
    assert rows.mapInArrow(kernels.tidy(holds, keep=True), "id long").count() == 64
    assert {r.n for r in rows.mapInArrow(kernels.tidy(sees), "n long").collect()} == {0}


def test_given(spark):
    rows = [("a", 1, 2, 0.5, True), (None, None, 1 << 40, None, False)]
    schema = "s string, i int, l long, d double, b boolean"
    got = given(spark, rows, schema)
    assert [tuple(r) for r in got.collect()] == rows and got.dtypes == spark.createDataFrame(rows, schema).dtypes
    assert given(spark, [], schema).collect() == []
    # No rows that a Python worker has to read.
    assert "LocalRelation" in got._jdf.queryExecution().optimizedPlan().toString()


def test_encoder_memory():
    """Encoding holds the arrays of a small slice beside a bounded cache, and ids do not depend on the slices."""
    rng = random.Random(5)
    texts = pa.array([" ".join(str(rng.randrange(3000)) for _ in range(400)) for _ in range(600)])
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert enc.keys.nbytes + enc.lengths.nbytes + enc.ids.nbytes <= 32 << 20
    flat = lambda budget: np.concatenate([ids for ids, _ in enc.batches(texts, *budget)])
    want = flat([kernels.SLICE_BYTES])
    tracemalloc.start()
    assert (flat([]) == want).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20, peak
