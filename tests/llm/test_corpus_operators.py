"""Operators over the whole corpus, held against brute force on small fixtures."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tracemill.llm import graph, hamming, jaccard, lines, lm, packing, shingles


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def word_set(text, width):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def family_texts(seed=4):
    """Clusters of edited copies, chains of edits, shared passages, tiny and empty texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    texts = [None, "", " \t", "one", "One", "one two", "a b c d", "A B C D", "a b c d e"]
    passage = [word() for _ in range(60)]
    for family in range(14):
        base = [word() for _ in range(rng.randint(20, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.5:
                base = copy
    for _ in range(30):
        texts.append(" ".join(passage + [word() for _ in range(rng.randint(0, 30))]))
    texts += texts[20:26]
    return texts


@pytest.mark.parametrize("width,percent,leaf", [(5, 80, 32), (4, 85, 3)])
def test_jaccard_equals_brute_force(spark, monkeypatch, width, percent, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    texts = family_texts()
    sets = [word_set(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, g string, id int")
    found = {r.doc_id: r for r in jaccard.jaccard_components(docs, width, percent).collect()}
    assert [found[i].component_id for i in range(len(texts))] == roots(len(texts), links)
    assert [found[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_jaccard_edge_cases(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_components(docs).collect()
    assert len(found) == 5 and {(r.doc_id, r.component_id) for r in found} == {(None, 3), (3, 3), (1, 1), (2, 2)}
    assert jaccard.jaccard_components(docs.where("1 = 0")).count() == 0
    kept = jaccard.drop_near_duplicates(docs.selectExpr("*", "1 as _head"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3] and kept.columns == ["doc_id", "text", "_head"]


def test_regions_lose_no_pair(spark, monkeypatch):
    """Every pair within the distance shares a region after the cells were divided."""
    import numpy as np

    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = np.random.default_rng(2)
    centers = [rng.integers(0, 1 << 62, 120, np.uint64) for _ in range(6)]
    sets = []
    for i in range(60):
        own = centers[i % 6].copy()
        swap = rng.integers(0, 120, int(rng.integers(0, 14)))
        own[swap] = rng.integers(0, 1 << 62, len(swap), np.uint64)
        sets.append(np.unique(own))
    join = jaccard.Join(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 4, 85)
    rows = spark.createDataFrame([(7, i, len(s), 0, i) for i, s in enumerate(sets)], "region long, id long, n int, pos int, root long")
    chosen = spark.createDataFrame([(i, bytearray(shingles.sketch(s))) for i, s in enumerate(sets)], "id long, sketch binary")
    regions = defaultdict(set)
    divided = join.regions(rows, chosen).collect()
    for r in divided:
        regions[r.region].add(r.id)
    assert len(regions) > 1
    near = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.85 * len(np.union1d(sets[i], sets[j]))]
    assert near and all(any({i, j} <= m for m in regions.values()) for i, j in near)


def test_shingles_equal_sets_of_words():
    texts = family_texts() + ["Ä Ö ü", "a\x1cb c d e", "x y z"]
    for width in (1, 4, 5):
        assert [len(s) for s in shingles.shingle_sets(texts, width)] == [len(word_set(t, width)) for t in texts]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    found = {r.h: r.root for r in graph.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots(400, links)
    assert found == {i: expected[i] for i in {x for p in links if p[0] != p[1] for x in p}}
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_within_equals_levenshtein():
    rng = random.Random(3)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            if rng.random() < 0.4 or not b:
                b.insert(at, rng.choice("abcd"))
            elif rng.random() < 0.5:
                b.pop(min(at, len(b) - 1))
            else:
                b[min(at, len(b) - 1)] = rng.choice("abcd")
        for d in (1, 2, 3):
            assert lines.within(a, "".join(b), d) == (levenshtein(a, b) <= d)


def line_docs(seed=6):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 60))) for _ in range(30)]
    docs = []
    for i in range(50):
        own = []
        for line in rng.choices(base, k=rng.randint(1, 6)):
            line = list(line)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            if rng.random() < 0.3:
                line.insert(rng.randrange(len(line)), "q")
            own.append("".join(line))
        docs.append((i, "\n".join(own)))
    return docs + [(50, None), (51, ""), (52, "\n\n")]


def dropped_lines(rows):
    """Line numbers by document that repeat an earlier line, by comparing all lines with all."""
    places = sorted({(i, k, line) for i, t in rows if t is not None and i is not None for k, line in enumerate(t.split("\n")) if line.strip(" \t\x0b\f\r")})
    same = lambda a, b: a == b or min(len(a), len(b)) >= lines.MIN_LENGTH and abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2
    links = [(i, j) for i in range(len(places)) for j in range(i) if same(places[i][2], places[j][2])]
    head = roots(len(places), links)
    expected = defaultdict(list)
    for i, (doc, k, _) in enumerate(places):
        if head[i] != i:
            expected[doc].append(k)
    return expected


def test_divergence_keys_lose_no_pair():
    rng = random.Random(8)

    def edited(s, n, letters):
        s = list(s)
        for _ in range(n):
            at, kind = rng.randint(0, len(s)), rng.random()
            if kind < 0.35 or not s:
                s.insert(at, rng.choice(letters))
            elif kind < 0.7:
                s[min(at, len(s) - 1)] = rng.choice(letters)
            else:
                del s[min(at, len(s) - 1)]
        return "".join(s)

    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh "])
        pivot = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        x = edited(pivot, rng.randint(0, 7), letters)
        if rng.random() < 0.3:
            at = rng.randint(0, len(x))
            x = x[:at] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + x[at + rng.randint(0, 20) :]
        y = edited(x, rng.randint(0, 2), letters)
        for d in (1, 2):
            if levenshtein(x, y) <= d and max(levenshtein(x, pivot), levenshtein(y, pivot)) > d:
                assert lines.divergence_keys(x, pivot, d) & lines.divergence_keys(y, pivot, d)


def test_crowded_line_keys_equal_brute_force(spark, monkeypatch):
    """Variants of one line with words replaced, more than are joined in pairs."""
    monkeypatch.setattr(lines, "FEW", 3)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))
    base = [word() for _ in range(11)]
    rows = []
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(11), rng.choice([1, 1, 2])):
            own[at] = word()
        line = " ".join(own)
        rows.append((2 * i, line))
        if i % 3 == 0:  # a near copy of the variant
            at = rng.randrange(len(line))
            rows.append((2 * i + 1, line[:at] + "#" + line[at + rng.randint(0, 1) :]))
    report = {r.doc_id: r.dropped for r in lines.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = dropped_lines(rows)
    assert report == {i: expected.get(i, []) for i, _ in rows}
    assert sum(map(len, report.values())) >= 30


def test_line_dedup_edges(spark):
    long = "word " * 9000
    rows = [(1, f"Same.\n{long}x"), (1, f"Same.\n{long}x"), (2, f"Same.\n{long}yz\n \n \n"), (None, "Same."), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, key long, h int, root int")
    report = {(r.doc_id, r.n_lines): r.dropped for r in lines.dedup_report(docs).collect()}
    assert report == {(1, 2): [], (2, 5): [0, 1], (None, 1): [], (3, 0): [], (4, 1): []}
    cut = lines.drop_lines(docs, lines.duplicate_lines(docs))
    assert cut.columns == docs.columns and cut.count() == 6
    assert cut.where("doc_id = 2").first().text == " \n \n"
    assert lines.dedup_report(docs.where("1 = 0")).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rows = line_docs()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, line int")
    expected = dropped_lines(rows)
    report = {r.doc_id: r for r in lines.dedup_report(docs).collect()}
    assert {i: r.dropped for i, r in report.items()} == {i: expected.get(i, []) for i, _ in rows}
    assert report[50].n_lines == 0 and report[51].n_lines == 1 and report[52].n_lines == 3
    cut = lines.drop_lines(docs, lines.duplicate_lines(docs))
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and texts[50] is None
    assert all(texts[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in expected.get(i, [])) for i, t in rows if t is not None)
    assert lines.dedup_report(docs.where("1 = 0")).count() == 0


def test_lm_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), i % 5 == 0) for i in range(120)] + [(200, None, False), (201, "", True), (None, "W1 w2", False), (3, "w1\x0bw2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").selectExpr("*", "1 as n_tokens")
    tokens = [lm.tokens_of(t) + [b""] for _, t, _ in rows]
    one, two, starts = Counter(), Counter(), 0
    for (_, _, held), own in zip(rows, tokens):
        if not held:
            one.update(own)
            two.update(zip([None, *own], own))
            starts += 1
    n, v = sum(one.values()), len(one)
    context = Counter(one)
    context[None] = starts
    level = lambda c: math.frexp(c)[1]
    once, mass = Counter(), Counter()
    for (h, _), c in two.items():
        mass[level(context[h])] += c
        once[level(context[h])] += c == 1
    keep = lambda c: min(max((once[level(c)] + 0.5) / (mass[level(c)] + 1), 1e-4), 0.9999)
    expected = []
    for (i, _, held), own in zip(rows, tokens):
        base = score = 0.0
        for h, w in zip([None, *own], own):
            p = (one[w] + 1) / (n + v + 1)
            base += math.log10(p)
            score += math.log10((1 - keep(context[h])) * two[h, w] / context[h] + keep(context[h]) * p) if context[h] else math.log10(p)
        expected.append((i, bool(held), len(own), sum(one[w] > 0 for w in own), n, round(base, 6), round(score, 6)))
    key = lambda r: tuple(str(x) for x in r)
    for block, reducer in ((40, 50), (100_000, 2_000_000)):
        found = lm.score_texts(docs, "held", block_tokens=block, reducer_entries=reducer).collect()
        assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in found), key=key) == sorted(expected, key=key)
    assert lm.score_texts(docs.where("1 = 0"), "held").count() == 0
    alone = lm.score_texts(docs.withColumn("held", docs.doc_id.isNotNull() | docs.doc_id.isNull()), "held").collect()
    assert len(alone) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 for r in alone)


def test_probabilities_of_a_state_sum_to_one():
    import numpy as np

    words, starts = np.array([5, 3, 0, 2]), 4
    codes = np.array([0 * 5 + 1, 0 * 5 + 3, 1 * 5 + 0, 4 * 5 + 0, 4 * 5 + 1])
    counts = np.array([2, 1, 3, 3, 1])
    model = lm.Automaton(codes, counts, words, starts, int(words.sum()), 3, np.full(lm.CLASSES, 0.3))
    unseen = 1 / (words.sum() + 3 + 1)
    for state in (0, 1, 4):
        total = sum(10 ** model.step(np.array([state]), np.array([w]))[1][0] for w in (0, 1, 3))
        gone = 0.7 * (1 - sum(c for k, c in zip(codes, counts) if k // 5 == state) / np.append(words, starts)[state])
        assert abs(total + 0.3 * unseen + gone - 1) < 1e-9


def naive_best_fit(pieces, capacity):
    bins = []
    out = []
    for size, source, cluster in pieces:
        fits = [(b["left"], sum(1 << s for s in b["sources"]), i) for i, b in enumerate(bins) if b["left"] >= size and b["left"] > 0 and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        if fits:
            at = min(fits)[2]
        else:
            at = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        out.append((at, capacity - bins[at]["left"]))
        bins[at]["left"] -= size
        bins[at]["sources"] |= {source} - {None}
        bins[at]["clusters"] |= {cluster} - {None}
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        pieces = sorted(((rng.randint(1, 40), rng.choice([None, 0, 0, 1, 2, 3]), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(rng.randint(0, 60))), key=lambda p: -p[0])
        assert packing.best_fit(pieces, 40) == naive_best_fit(pieces, 40)


def test_packing_holds_all_words_without_conflicts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 130) + [str(i % 40)]), rng.choice(["a", "a", "b", None])) for i in range(200)] + [(300, None, "a"), (301, " \n", "b"), (None, "x y", None), (5, "again", "a"), (5, "again", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as piece", "2 as bin")
    found = packing.pack(docs, capacity=50, shard=40).collect()
    assert sum(r.n_words for r in found) == sum(len((t or "").split()) for _, t, _ in rows)
    by_bin = defaultdict(list)
    for r in found:
        by_bin[r.shard, r.bin].append(r)
    source = {i: s for i, _, s in rows}
    for own in by_bin.values():
        assert sum(r.n_words for r in own) == own[0].bin_used <= 50
        spans = sorted((r.bin_offset, r.bin_offset + r.n_words) for r in own)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        named = [source[r.doc_id] for r in own if source[r.doc_id]]
        assert len(named) == len(set(named))
    assert packing.pack(docs.where("1 = 0")).count() == 0


def test_packing_rounds_fill_bins_and_keep_clusters_apart(spark):
    """Shards lose little against one packing of everything; no cluster meets itself in a bin."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), f"s{rng.randint(0, 60)}", rng.choice([None, 1, 2, rng.randint(3, 300)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, group long")
    found = packing.pack(docs, capacity=60, shard=100, cluster="group").collect()
    whole = packing.pack(docs, capacity=60, shard=10_000, cluster="group").collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in whole) == list(range(600))
    bins = defaultdict(list)
    for r in found:
        bins[r.shard, r.bin].append(rows[r.doc_id])
    for own in bins.values():
        assert len({s for _, _, s, _ in own}) == len(own)
        named = [c for *_, c in own if c is not None]
        assert len(named) == len(set(named))
    assert len(bins) <= 1.05 * len({(r.shard, r.bin) for r in whole})


def test_hamming_equals_brute_force(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)]
    codes = [(i, rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) % (1 << 64)) for i in range(300)] + [(i, base[0]) for i in range(300, 420)]
    signed = [(i, c - (1 << 64) if c >> 63 else c) for i, c in codes]
    rows = spark.createDataFrame(signed + [(None, 5), (999, None), signed[0]], "id long, code long")
    found = defaultdict(list)
    for r in hamming.top_k(rows, rows.where("id % 50 = 0"), 7).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.distance, r.id))
    for q, code in codes:
        if q % 50 == 0:
            assert found[q] == sorted(((c ^ code).bit_count(), i) for i, c in codes)[:7]
    assert hamming.top_k(rows.where("1 = 0"), rows, 3).count() == 0
    few = hamming.top_k(rows.where("id < 2"), rows.where("id = 0"), 5).collect()
    assert len(few) == 2


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import language_rows

    rows = [(i, t, k, f"s{i % 3}", len(t)) for i, t, k in language_rows(120)]
    rows += [(500 + i, rows[i][1], rows[i][2], "s0", 1) for i in range(10)] + [(600, None, "aa", "s1", 0), (601, "", "aa", "s1", 0), (602, "12 34", "aa", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {600, 601, 602} and not ids & set(range(500, 510)) and len(ids) >= 110
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
