"""Operators that SQL cannot express against naive versions; the SQL of the others in DuckDB."""

import os
import random

import numpy as np
import pytest

from tracemill.llm import fst, langid, media, queries, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def naive_window(net, words):
    """Logit of one window, word by word in double precision."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    inputs = []
    for w in words:
        grams, word = toxicity.features([w])
        inputs.append(np.concatenate([p["chars"][grams.buckets].sum(axis=0) / np.sqrt(len(grams.buckets)), p["words"][word[0]]]))
    h, states = toxicity.HIDDEN, {}
    for way, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        state = np.zeros(h)
        for i in order:
            x, y = inputs[i] @ p[f"x{way}"] + p[f"c{way}"], state @ p[f"h{way}"]
            reset, keep = sigmoid(x[:h] + y[:h]), sigmoid(x[h : 2 * h] + y[h : 2 * h])
            new = np.tanh(x[2 * h :] + reset * y[2 * h :])
            state = (1 - keep) * new + keep * state
            states[way, i] = state
    both = [np.concatenate([states["f", i], states["b", i]]) for i in range(len(words))]
    weight = np.exp([np.tanh(s @ p["attend"]) @ p["query"] for s in both])
    return sum(w * s for w, s in zip(weight / weight.sum(), both)) @ p["out"] + p["bias"][0]


def test_toxicity_scores_equal_one_window_at_a_time():
    rng, net = random.Random(3), toxicity.Network.start(4)
    for name in ("chars", "words"):
        net.p[name] += np.random.default_rng(5).normal(0, 0.4, net.p[name].shape).astype(np.float32)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14))) for _ in range(n)) for n in (1, 5, 32, 33, 75)] + ["", "12 !?"]
    found = toxicity.score(net, texts)
    for text, score in zip(texts, found):
        words = toxicity.words_of(text)
        n = toxicity.WINDOW
        starts = [*range(0, len(words) - n, toxicity.STRIDE), len(words) - n] if len(words) > n else [0] if words else []
        # padding behind a short text is read backwards before its words
        naive = [naive_window(net, words[s : s + n]) for s in starts if len(words) >= n]
        if len(words) >= n:
            assert abs(score - sigmoid(max(naive))) < 1e-4
        elif not words:
            assert abs(score - sigmoid(net.p["bias"][0])) < 1e-5


def test_whole_words_reach_the_net():
    """Words that differ in their last characters only have different inputs."""
    (a, _), (b, _) = toxicity.features(["donaudampfschiffahrtsmist"]), toxicity.features(["donaudampfschiffahrtskind"])
    assert set(a.buckets) != set(b.buckets)
    both, _ = toxicity.features(["ab", "x" * 5000])
    assert both.counts.tolist() == [3, sum(5002 - n + 1 for n in toxicity.GRAMS)]


def test_language_equals_a_loop_over_dictionaries():
    import zstandard

    rng = random.Random(6)
    letters = {"aa": "abcdefgh", "bb": "klmnopqr", "cc": "stuvwxyz"}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    model = langid.LanguageModel(tuple((k, langid._dictionary([text(k, 400)])) for k in letters))
    classifier = langid.Classifier(model)
    for t in [text(k, n) for k in letters for n in (1, 30, 6000)] + ["stuv abcd", "1 2 3", "", None, "x"]:
        if not t or not any(c.isalpha() for c in t):
            assert classifier.predict(t) == ("und", 0.0)
            continue
        raw = langid.letters_only(t).encode()
        sizes = []
        for _, d in model.dictionaries:
            size = 0
            for i in range(0, len(raw), langid.BLOCK_BYTES):
                data = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size += len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[i : i + langid.BLOCK_BYTES]))
            sizes.append(size)
        best, second = sorted(sizes)[:2]
        assert classifier.predict(t) == (list(letters)[sizes.index(best)], (second - best) / second)


class Reader:
    """A second, minimal reader of the media files: nested elements with known sizes, blocks, lacing."""

    MASTERS = {0x18538067, 0x1F43B675, 0xA0}

    def __init__(self, data):
        self.data, self.frames = data, []
        self.read(0, len(data))

    def number(self, at, marker):
        width = 9 - self.data[at].bit_length()
        value = int.from_bytes(self.data[at : at + width], "big")
        return (value if marker else value - (1 << 7 * width)), at + width

    def read(self, at, end):
        while at < end:
            kind, at = self.number(at, True)
            size, at = self.number(at, False)
            if kind in self.MASTERS:
                self.read(at, at + size)
            elif kind in (0xA3, 0xA1):
                self.block(at, at + size)
            at += size

    def block(self, at, end):
        _, at = self.number(at, False)
        lacing = self.data[at + 2] >> 1 & 3
        at += 3
        sizes = []
        if lacing:
            n = self.data[at] + 1
            at += 1
            if lacing == 2:
                sizes = [(end - at) // n] * n
            elif lacing == 1:
                for _ in range(n - 1):
                    size = 0
                    while self.data[at] == 255:
                        size, at = size + 255, at + 1
                    sizes.append(size + self.data[at])
                    at += 1
            else:
                first, at = self.number(at, False)
                sizes = [first]
                for _ in range(n - 2):
                    width = 9 - self.data[at].bit_length()
                    value, at = self.number(at, False)
                    sizes.append(sizes[-1] + value - ((1 << 7 * width - 1) - 1))
            if lacing != 2:
                sizes.append(end - at - sum(sizes))
        else:
            sizes = [end - at]
        for size in sizes:
            self.frames.append(self.data[at : at + size])
            at += size


@pytest.mark.parametrize("n", [0, 63, 64, 513, 5000, 70_001])
def test_media_read_by_a_second_reader(n):
    payload, _ = media.padded("ü" * (n // 2) + "-" * (n % 2))
    data = media.mux(payload)
    frames = Reader(data).frames
    assert b"".join(frames) == payload
    assert [len(f) for f in frames] == [p.size for p in media.demux(data).packets]


@pytest.mark.parametrize("size", [191, 192, 193, 500, 50_000])
def test_long_pieces_equal_the_library(size):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), fst.TokenCounter(path)
    rng = random.Random(size)
    for letters in ("a", "ab", "etaoinshrdlu", "é"):
        text = "".join(rng.choice(letters) for _ in range(size // len(letters.encode()[:2]) if letters == "é" else size))
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = queries.queries()[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    expected = sorted(repr([r[names.index(c)] for c in frame.columns]) for r in result.fetchall())
    assert sorted(names) == sorted(frame.columns) and sorted(repr(list(r)) for r in frame.collect()) == expected


def test_pipeline_over_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = "doc_id long, quality int, toxic int"
    for name, made in (("documents", schema), ("labels", labels)):
        spark.createDataFrame([], made).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(i, f"some words of document number {i} and a few more", "en", "s", 1) for i in range(6)] + [(None, None, None, None, None), (None, "no number", "en", None, 2)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], f"{schema}, h long, key long, root long, line_no int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
