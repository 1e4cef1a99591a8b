"""The exchange of prefix shingles, and what is built on it."""

from collections import defaultdict
from random import Random

import numpy as np

from tracemill.llm import jaccard, packing, queries


def sent_and_met(lots, parts, num, den):
    rows = [r for lot in lots for r in jaccard._sent(lot, parts).to_pylist()]
    rows = jaccard.pa.Table.from_pylist(sorted(rows, key=lambda r: r["part"]), schema=jaccard._sent(lots[0], parts).schema)
    batches = rows.to_batches(max_chunksize=3)
    return [r for part in jaccard._of_one_part(batches) for r in jaccard._met(part, num, den).to_pylist()]


def test_points_keep_every_similar_other_and_not_those_that_cannot_be_similar():
    draw, num, den = Random(8), 4, 5
    base = [sorted(draw.sample(range(1 << 40), 60)) for _ in range(12)]
    sets = [sorted({*draw.sample(b, draw.randint(40, 60)), *draw.sample(range(1 << 40), draw.randint(0, 8))}) for b in base for _ in range(14)]
    sets = [np.array(s, np.uint64) << np.uint64(24) for s in sets] + [np.array([7, 8], np.uint64), np.array([70_000 + i for i in range(70_000)], np.uint64)]
    points = []
    for i, s in enumerate(sets):
        prefix = len(s) - -(-num * len(s) // den) + 1
        points.append((s[:prefix], i, len(s), prefix if i % 3 else prefix - 1))  # some have a frequent one
    for parts in (1, 5):
        found = defaultdict(set)
        rows = sent_and_met([points[:60], points[60:], points[:20]], parts, num, den)
        for r in rows:
            found[r["g"]].add(r["id"])
        assert len(rows) == sum(map(len, found.values()))  # repeated points count once
        rare = {(s[k], i): k for s, i, _, n in points for k in range(n)}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = np.intersect1d(a, b)
                if len(both) and len(both) * den >= num * (len(a) + len(b) - len(both)) and (both[0], i) in rare and (both[0], j) in rare:
                    assert any({i, j} <= own for own in found.values())
    # sizes 2 and 10 share their first shingle, and so do two sets at places from where on too little is left
    apart = [(np.array([5, 6], np.uint64), 1, 2, 2), (np.array([5, 9, 10], np.uint64), 2, 10, 3)]
    apart += [(np.array([1 << 30, 1 << 31, 1 << 32], np.uint64), 3, 10, 3), (np.array([1 << 33, 1 << 34, 1 << 32], np.uint64), 4, 10, 3)]
    assert sent_and_met([apart], 4, num, den) == []


def test_a_text_that_also_stands_without_an_id_keeps_its_links(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(words)), (5, " ".join(words)), (6, " ".join([*words[:60], "x", *words[61:]])), (6, "another text"), (7, " ")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows + rows[:1], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found) == [(0, 116, 5), (0, 116, 5), (5, 116, 5), (6, 1, 6), (6, 116, 5), (7, 0, 7)]


def test_packing_near_copies_reads_no_text_again(spark, tmp_path, monkeypatch):
    read, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda docs, **named: read.append(docs.columns) or pack(docs, **named))
    rows = [(i, " ".join(f"{i}x{k}" for k in range(i)), "s") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op5_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_words) for r in found) == [(i, i) for i in range(1, 5)]
    assert len(read) == 1 and "text" not in read[0]


def test_of_blocks_with_the_same_points_one_makes_pairs(spark, monkeypatch):
    met, leaf_pairs = [], jaccard.Join.leaf_pairs
    monkeypatch.setattr(jaccard.Join, "leaf_pairs", lambda self, rows, chosen: met.append(rows.count()) or leaf_pairs(self, rows, chosen))
    shared = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*shared, *(f"{i}x{k}" for k in range(50 + 50 * (i == 3)))])) for i in range(4)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=55).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 if i < 3 else 3 for i in range(4)}
    assert sum(met) <= 40
