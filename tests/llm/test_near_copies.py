"""Packing keeps near copies apart."""

from collections import defaultdict

from tracemill.llm import lines, queries


def test_near_copies_never_share_a_bin(spark, tmp_path):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"edit{i}"] + base[61:]), f"s{i}") for i in range(8)]
    rows += [(10 + i, " ".join(f"v{i}x{k}" for k in range(50)), f"t{i}") for i in range(8)]
    rows += [(3, "another text under the same number", "u"), (None, " ".join(base), "v"), (30, None, "w"), (31, " ", "w")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op5_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in found) == sorted((i is None, i or 0, len((t or "").split())) for i, t, _ in rows if (t or "").split())
    bins = defaultdict(list)
    for r in found:
        bins[r.shard, r.bin].append((r.doc_id, r.n_words))
    near = {(i, 120) for i in range(8)} | {(None, 120)}
    assert all(len(near & set(own)) <= 1 for own in bins.values())
    assert len(bins) == 9


def test_two_families_of_lines_that_share_a_third_do_not_meet_in_pairs(spark, monkeypatch):
    verified, _verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: verified.append(pairs.count()) or _verified(pairs, *more))
    tails = ["q" * 12 + "r" * 12, "s" * 12 + "t" * 12]
    rows = [f"abcdefghijkl{t[:i]}{c}{t[i + 1 :]}" for t in tails for i in range(1, 23) for c in "UVWXYZ"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert lines.duplicate_lines(docs).groupBy("class_doc").count().orderBy("class_doc").collect() == [(0, 131), (132, 131)]
    assert sum(verified) <= lines.FEW * len(rows)


def test_lines_that_share_no_more_than_a_third_are_no_candidates(spark, monkeypatch):
    from random import Random

    verified, _verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: verified.append(pairs.count()) or _verified(pairs, *more))
    draw = Random(5)
    rows = ["the same beginning " + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=38)) for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate([*rows, rows[3][:30] + rows[3][31:] + "!"])), "doc_id long, text string")
    assert [(r.doc_id, r.class_doc) for r in lines.duplicate_lines(docs).collect()] == [(24, 3)]
    assert 1 <= sum(verified) <= 6


def test_parities_allow_all_lines_within_the_distance():
    from random import Random

    draw, alphabet = Random(9), "ab é€\U0001F600"
    pairs = []
    for _ in range(3000):
        a = b = "".join(draw.choices(alphabet, k=draw.randint(32, 70)))
        for _ in range(lines.DISTANCE):
            at, kind = draw.randrange(len(b)), draw.randrange(3)
            b = b[:at] + draw.choice(alphabet) * (kind > 0) + b[at + (kind < 2) :]
        pairs.append((a, b))
    for own, bound in zip(zip(lines.parities([a for a, _ in pairs]), lines.parities([b for _, b in pairs])), (2, 4)):
        apart = [((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(*own)]
        assert 0 < max(apart) <= bound * lines.DISTANCE


def test_the_line_stage_of_the_pipeline_tries_few_pairs(spark, monkeypatch):
    from random import Random

    import corpus_pipeline

    verified, _verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: verified.append(pairs.count()) or _verified(pairs, *more))
    draw = Random(6)
    rows = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=20)) + " the same ending of it" for _ in range(20)]
    docs = spark.createDataFrame([(i, f"{i}\n{line}") for i, line in enumerate([*rows, rows[3][:7] + rows[3][8:]])], "doc_id long, text string")
    kept = dict(corpus_pipeline.drop_repeated_lines(spark, docs, "").select("doc_id", "text").collect())
    assert kept == {i: f"{i}\n{line}" for i, line in enumerate(rows)} | {20: "20"}
    assert 1 <= sum(verified) <= 6
