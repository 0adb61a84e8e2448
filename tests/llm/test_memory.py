"""What a worker keeps between tasks."""

import gc
import weakref

import pyarrow as pa
import pytest

from copse.llm import batches, packing, pii, tokens


@pytest.fixture
def task(spark, monkeypatch):
    """Runs what a plan hands to the workers in this process, as one task."""
    docs, made = spark.createDataFrame([(1, "ab")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run) or self.select("_0", *[
        batches.F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]))

    def run(plan):
        plan(docs)
        kernel = made.pop()
        made.clear()
        columns = {"_0": ["a b c"]} if plan is mentions else {"_0": [1], "_1": ["a b c"]}
        return list(kernel(iter([pa.RecordBatch.from_pydict(columns)])))
    return run


def mentions(docs):
    pii._mentions(docs, "text")


def test_encoder_goes_when_the_worker_turns_to_another_kernel(task):
    task(packing.pieces)
    kept = weakref.ref(tokens.encoder(tokens.tokenizer_path()))
    task(packing.pieces)
    assert kept() is tokens.encoder(tokens.tokenizer_path())          # kept from task to task
    task(mentions)
    gc.collect()
    assert kept() is None


def test_memory_is_handed_back_after_a_task(task, monkeypatch):
    calls = []
    monkeypatch.setattr(batches, "hand_back", lambda: calls.append(1), raising=False)
    task(mentions)
    assert calls == [1]
