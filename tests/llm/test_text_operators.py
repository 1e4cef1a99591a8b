"""Per-document operators: round trips, library equality, edge cases, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tracemill.llm import bpe, fst, langid, media, toxicity
from tracemill.llm.common import company

P = pytest.importorskip("public_tokenizers")
ODD = " \n\t'’rvlestmdRE  ab1२é!?-_ 　ñ🙂́"


def odd_texts(n=400, seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return texts + ["", "a" * 3000, " " * 700 + "x", "x<|endoftext|>y", "<|endoftext|>", "'re'll'lx'r e''s", "don't we've they'll"]


def messy(spark):
    """Null and empty texts, repeated rows, null ids, clashing names, one very long text."""
    rows = [(1, None, "en", 0, 0), (2, "", "en", 1, 1), (3, " \n\t ", None, 2, 2), (4, "Ein Text.", "de", 3, 3), (4, "Ein Text.", "de", 3, 3), (None, "no id", "en", 4, 4), (5, "long " * 40_000, "en", 5, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long, score int")


def empty(spark):
    return messy(spark).where("1 = 0")


def test_pretokens_stitch_at_every_chunk_size():
    import regex

    pattern = regex.compile(P.PATTERN)
    for text in odd_texts():
        for chunk, overlap in ((16, 12), (40, 20), (64, 24)):
            assert bpe.pretokens(text, pattern, chunk, overlap) == pattern.findall(text)


def test_bpe_equals_library_and_round_trips():
    import tiktoken

    own = bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_equals_library_on_all_code_points():
    """Every assigned or unassigned character between letters, digits and signs."""
    import tiktoken

    own = bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for start in range(0x80, 0x34000, 256):
        codes = [c for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)}\n" for c in codes)
        assert own.encode(text) == library.encode_ordinary(text), hex(start)


def test_long_runs_are_matched_in_linear_work():
    class Counting:
        def __init__(self, pattern):
            self.pattern, self.read = pattern, 0

        def finditer(self, text):
            self.read += len(text)
            return self.pattern.finditer(text)

    import regex

    read = {}
    for n in (200_000, 800_000):
        counting = Counting(regex.compile(P.PATTERN))
        assert bpe.pretokens("a" * n + " b", counting) == ["a" * n, " b"]
        read[n] = counting.read
    assert read[800_000] < 5 * read[200_000]


def test_looking_for_other_classes_costs_little():
    from time import process_time

    path, text = P.path("byte_bpe_multi_50k.tiktoken"), "für später, où déjà vu; " * 20_000
    seconds = []
    for others in ({}, bpe.stand_ins(P.PATTERN)):
        own = bpe.ByteBPE(path, P.PATTERN, others)
        own.encode(text[:100])
        start = process_time()
        own.encode(text)
        seconds.append(process_time() - start)
    assert seconds[1] < 3 * seconds[0]


def test_bpe_edge_cases(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.bpe_digest(messy(spark), path, P.PATTERN).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 7
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_tokens == by_id[2].n_tokens == 0 and by_id[1].ids_sha256 == by_id[1].decoded_sha256 == nothing
    assert by_id[5].decoded_sha256 == hashlib.sha256(b"long " * 40_000).hexdigest()
    assert bpe.bpe_digest(empty(spark), path, P.PATTERN).count() == 0
    encoded = bpe.encode_texts(messy(spark), path, P.PATTERN)
    assert {r.doc_id: bytes(r.raw) for r in bpe.decode_ids(encoded, path, P.PATTERN).collect()}[4] == b"Ein Text."


def test_token_counts_equal_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = odd_texts()
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = fst.TokenCounter(P.path("byte_bpe_50k.json"))
    assert counter.count(texts) == expected
    short = fst.TokenCounter(P.path("byte_bpe_50k.json"), counter.splitter.classes)
    short.splitter.lane = 7  # chunks that end inside words, contractions and blanks
    assert short.count(texts) == expected


def test_transducer_counts_are_token_counts():
    counter = fst.TokenCounter(P.path("byte_bpe_50k.json"))
    words = [b" tokenization", b"aaaaaaaaaaaa", "höchst".encode(), b"x" * 500, b"ab" * 300, b"x" * 48, b"x" * 49, b"q"]
    assert counter.merger.count(words).tolist() == [len(counter.merger.merge(w)) for w in words]


def test_token_count_edge_cases(spark):
    rows = {r.doc_id: r for r in fst.token_counts(messy(spark), P.path("byte_bpe_50k.json")).collect()}
    assert rows[1].n_bytes == rows[1].n_tokens == rows[2].n_tokens == 0 and not rows[1].over_limit
    assert rows[5].over_limit and rows[5].n_bytes == 200_000
    assert fst.token_counts(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 5000, 70_000])
def test_media_round_trip(n):
    payload, size = media.padded("é" * (n // 2) + "x" * (n % 2))
    assert size == n and len(payload) % 64 == 0 and len(payload) >= 64
    data = media.mux(payload)
    found = media.demux(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in found.packets) == payload
    assert [c for _, _, c in found.cues] == sorted(c for _, _, c in found.cues) and len(found.cues) == len(found.clusters)
    assert [p.timestamp_ms for p in found.packets] == [64.0 * i for i in range(len(found.packets))]


def test_media_lacing_kinds():
    frames = [b"a" * 300, b"b" * 20, b"c" * 700]
    for kind in (media.XIPH, media.EBML_LACING):
        data = media.lace(frames, kind)
        assert [data[o : o + s] for o, s in media.unlace(data, 0, len(data), kind)] == frames
    same = [b"a" * 9, b"b" * 9]
    data = media.lace(same, media.FIXED)
    assert [data[o : o + s] for o, s in media.unlace(data, 0, len(data), media.FIXED)] == same


def test_media_unknown_sizes_and_damage(spark):
    data = media.mux(media.padded("hello " * 3000)[0])
    at = data.index(media.CLUSTER.to_bytes(4, "big"))
    width = 9 - data[at + 4].bit_length()
    unknown = data[: at + 4] + ((1 << 7 * width) - 1 | 1 << 7 * width).to_bytes(width, "big") + data[at + 4 + width :]
    assert len(media.demux(unknown).packets) == len(media.demux(data).packets)
    rows = spark.createDataFrame([(1, data), (2, data[:200]), (3, None), (4, b"")], "doc_id long, media binary")
    found = media.packet_table(rows).collect()
    assert {r.doc_id for r in found if r.error} == {2, 4} and all(r.packet is None for r in found if r.error)
    assert sum(r.byte_size for r in found if r.doc_id == 1) == len(media.padded("hello " * 3000)[0])


def test_media_digest_edge_cases(spark):
    rows = media.media_digest(messy(spark)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and by_id[1].payload_sha256 == by_id[2].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert by_id[1].tail_crc32 == zlib.crc32(bytes(64)) and by_id[5].n_bytes == 200_000
    assert media.media_digest(empty(spark)).count() == 0
    stored = media.store_texts(messy(spark))
    assert media.packet_table(stored).where("doc_id = 4").count() == 2


SYLLABLES = {"aa": ["ka", "lo", "mi", "ta", "ru"], "bb": ["sch", "ein", "ung", "ber", "ach"], "cc": ["eux", "oi", "ment", "que", "tre"]}


def language_rows(n=240, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[k], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 120))), k) for i, k in enumerate(rng.choices(list(SYLLABLES), k=n))]


def test_language_held_out_accuracy(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    truth = {i: k for i, _, k in rows}
    found = langid.predict_language(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark):
    model = langid.fit(messy(spark))
    rows = {r.doc_id: r for r in langid.predict_language(messy(spark), model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].rejected and rows[1].score == 0
    assert langid.predict_language(empty(spark), model).count() == 0
    assert langid.predict_language(messy(spark), langid.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0
    kept = langid.drop_unknown(messy(spark), model)
    assert kept.columns == messy(spark).columns and kept.where("doc_id = 1").count() == 0


def toxic_rows(n=500, seed=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["th", "an", "er", "ing", "on", "re"], k=rng.randint(1, 4)))
    bad = lambda: rng.choice(["vequ", "lostra"]) + rng.choice(["is", "an", "oir", "ent", "ig"]) + rng.choice(["", "s", "m", "x"])
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(4, 90))], i % 4 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), bad())
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_gradient():
    net = toxicity.Network.start(1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    net.p["chars"] += rng.normal(0, 0.3, net.p["chars"].shape)
    vocabulary, index, doc = toxicity._windows([["idiot", "foo", "bar"] * 15, ["x", "yy", "foo"]])
    chars, word = toxicity.features(vocabulary)
    call = lambda: net.gradient(chars, word, index, index < len(vocabulary), doc, np.array([1, 0]), np.ones(len(vocabulary)))
    _, g = call()
    for k in ("xf", "hb", "cf", "attend", "query", "out", "bias"):
        at = tuple(0 for _ in net.p[k].shape)
        old, step = net.p[k][at], 1e-3
        net.p[k][at] = old + step
        up = call()[0]
        net.p[k][at] = old - step
        down = call()[0]
        net.p[k][at] = old
        assert abs(g[k][at] - (up - down) / 2 / step) < 1e-5


def test_windows_cover_the_text():
    for n in (1, 31, 32, 33, 57, 200):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_toxicity_held_out_accuracy_and_edges(spark):
    rows = toxic_rows()
    net = toxicity.train([t for _, t, _ in rows[:350]], [y for *_, y in rows[:350]])
    found = toxicity.score(net, [t for _, t, _ in rows[350:]]) >= 0.7
    truth = np.array([y for *_, y in rows[350:]]) == 1
    assert (found == truth).mean() > 0.95
    scored = toxicity.score_toxicity(messy(spark), net).collect()
    assert len(scored) == 7 and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_toxicity(empty(spark), net).count() == 0
    kept = toxicity.drop_toxic(messy(spark), net)
    assert kept.columns == messy(spark).columns
    labels = spark.createDataFrame([(4, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(messy(spark), labels).p["bias"].shape == (1,)


def test_company_streams_over_batch_borders():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 40))
        rows = sorted(zip(rng.integers(0, 9, n).tolist(), rng.integers(0, 4, n).tolist(), rng.integers(0, 2, n).tolist()))
        expected = sorted({r for r in rows if len({q[1] for q in rows if q[0] == r[0]}) > 1})
        cuts = [0, *sorted(rng.integers(0, n + 1, 3).tolist()), n]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[a:b]], pa.int64()) for j in range(3)], names=["g", "i", "x"]) for a, b in zip(cuts, cuts[1:])]
        assert [tuple(r.values()) for b in company(iter(batches)) for r in b.to_pylist()] == expected
