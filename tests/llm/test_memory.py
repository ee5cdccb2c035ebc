"""What Python workers and Arrow batches hold at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import langid, mixing
from sessionlake.llm.common import BATCH_BYTES, query, small_table


def test_language_id_works_on_little_text_at_once():
    rng = random.Random(3)
    texts = pa.array(["".join(rng.choice("abcdefghij é") for _ in range(2000)) for _ in range(500)])
    logs = np.random.default_rng(3).random((langid.BUCKETS + 1, 8)).astype(np.float32)
    langid._letters()
    tracemalloc.start()
    langs, best = langid.scores(texts, [f"l{i}" for i in range(8)], logs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(langs) == len(best) == 500 and peak < 20e6


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    @query
    def found(spark):
        return spark.range(0, 1500, 1, 1).selectExpr("repeat('x', 10000) as text").mapInArrow(sizes, "n bigint, size bigint").collect()

    rows = found(spark)
    assert sum(r.n for r in rows) == 1500 and max(r["size"] for r in rows) <= BATCH_BYTES + 20_000


def test_the_mix_starts_no_python_for_its_own_small_tables(spark, monkeypatch):
    rows = [(i, "a b c" if i % 3 else "d e", f"s{i % 2}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").localCheckpoint()

    def refused(*_):
        raise AssertionError("a list became an RDD")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refused)
    assert mixing.mix(docs, keep=["doc_id"]).count() == 30


@pytest.mark.parametrize("rows", [[], [(1, "a", 0.5), (2, None, None)]])
def test_small_tables_keep_their_rows(spark, rows):
    table = small_table(spark, rows, "k int, source string, m double")
    assert [tuple(r) for r in table.collect()] == rows and table.dtypes == [("k", "int"), ("source", "string"), ("m", "double")]
