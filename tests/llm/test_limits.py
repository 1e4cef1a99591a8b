"""What the text operators cost beside their results: tasks, memory of workers, memory of the driver."""

import os
import tracemalloc
from random import Random

import numpy as np
import pyarrow as pa

from tracemill.llm import common, lines, shingles, toxicity


def test_lines_that_differ_from_one_line_take_few_shuffles(spark):
    rows = [f"abcdefghijklmnop{'qrstuvwxyz' * 3}"[:i] + c + f"abcdefghijklmnop{'qrstuvwxyz' * 3}"[i + 1 :] for i in range(1, 40) for c in "UV"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few-shuffles", "")
        assert lines.duplicate_lines(docs).groupBy("class_doc").count().collect() == [(0, len(rows) - 1)]
        stages = {s for j in tracker.getJobIdsForGroup("few-shuffles") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s)
        assert tasks <= 390
    finally:
        context.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shared_keys_come_once_with_their_size(monkeypatch):
    draw = Random(2)
    rows = sorted((draw.randrange(40), draw.randrange(12) if draw.random() < 0.3 else 5, draw.random() < 0.5) for _ in range(400))
    wanted = {}
    for key, h, indexed in rows:
        wanted.setdefault(key, {}).setdefault(h, []).append(indexed)
    wanted = {(k, h, any(flags), len(own)) for k, own in wanted.items() if len(own) > 1 for h, flags in own.items()}

    def found(rows, size):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        names = ["key", "h", "indexed"]
        return [r for b in common.shared(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p)], names=names) for p in parts) for r in zip(*(c.to_pylist() for c in b.columns))]

    for size in (1, 3, 50, 400):
        out = found(rows, size)
        assert len(out) == len(wanted) and set(out) == wanted
    monkeypatch.setattr(common, "HELD", 2)  # a key may pass in parts: nothing is lost, nothing alone passes
    assert {r[:2] for r in found(rows, 3)} == {r[:2] for r in wanted}


def test_shingles_of_many_texts_take_little_memory():
    draw = Random(3)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(5000)]
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(800)]
    size = sum(map(len, texts))
    tracemalloc.start()
    found = shingles.shingle_sets(texts, 5)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 12 * size
    alone = [shingles.shingle_sets([t], 5)[0] for t in texts[::40]]
    assert all(np.array_equal(a, b) for a, b in zip(found[::40], alone))


def test_the_driver_does_not_train_the_network(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    whole = toxicity.fit(docs, labels)
    none = toxicity.fit(docs.where("1 = 0"), labels)
    start = toxicity.Network.start()
    assert all(np.array_equal(none.p[k], start.p[k]) for k in start.p) and not np.array_equal(whole.p["out"], start.p["out"])

    class Elsewhere:
        def __init__(self, texts, labels):
            self.p = {"pid": os.getpid(), "texts": sorted(zip(texts, labels))}

    monkeypatch.setattr(toxicity, "train", Elsewhere)
    found = toxicity.fit(docs, labels).p
    assert found["pid"] != os.getpid() and found["texts"] == [(f"text {i}", i % 2) for i in range(6)]
