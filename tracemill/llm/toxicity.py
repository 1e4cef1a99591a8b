"""Toxicity by a bidirectional gated recurrent network, trained in numpy.

A word enters as the scaled sum of hashed character n-gram vectors (all those of
GRAMS characters in the whole word between its borders) beside a hashed word vector.
A forward and a backward gated recurrent unit read each window of WINDOW words;
attention pools their states to one logit.  Windows overlap and cover the whole
text.  Training takes a document as toxic if any window is (noisy-or over its
windows); scoring returns the highest window probability.

The network is fitted on at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN clean
labelled documents, those with the lowest hashes.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import keep_rows, map_texts

SAMPLE_TOXIC = 900
SAMPLE_CLEAN = 1500
WINDOW = 32
STRIDE = 16  # every span of half a window stands whole in one
EPOCHS = 7
THRESHOLD = 0.7

HIDDEN = 8
WIDTH = 8
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)  # characters of an n-gram; a word's borders are characters too
#: Windows that run through the network in one pass.
BATCH = 8192

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; none for no words."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


@dataclass
class Grams:
    """Hash buckets of the n-grams of words, word by word, and the number of each word's."""

    buckets: np.ndarray
    counts: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        return (1 / np.sqrt(np.maximum(self.counts, 1))).astype(np.float32)


def features(words: list[str]) -> tuple[Grams, np.ndarray]:
    """Hash buckets of each word's character n-grams and of the word itself [n]."""
    n = len(words)
    mix, golden = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    c = np.frombuffer("".join([f"\2{w}\3" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, n)
    owner = np.repeat(np.arange(n), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(c))  # characters from here to the word's end
    buckets, owners = [], []
    run = np.full(len(c), 7, np.uint64)
    for size in range(1, max(GRAMS) + 1):
        # n-grams of this size, by their first character
        ahead = np.zeros(len(c), np.uint64)
        ahead[: max(0, len(c) - size + 1)] = c[size - 1 :]
        run = (run ^ ahead) * mix
        run ^= run >> np.uint64(29)
        if size in GRAMS:
            inside = left >= size
            buckets.append(((run * golden) >> np.uint64(48)).astype(np.int64)[inside])
            owners.append(owner[inside])
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=n)
    word = np.fromiter((zlib.crc32(w.encode()) >> 16 for w in words), np.int64, n)
    return Grams(np.concatenate(buckets)[order] % BUCKETS, counts), word % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name; see :meth:`start` for their shapes."""

    p: dict[str, np.ndarray]

    @staticmethod
    def start(seed: int = 7) -> Network:
        rng, h, d = np.random.default_rng(seed), HIDDEN, 2 * WIDTH
        p = {"chars": np.zeros((BUCKETS, WIDTH)), "words": np.zeros((BUCKETS, WIDTH))}
        for way in ("f", "b"):
            p[f"x{way}"] = rng.normal(0, d**-0.5, (d, 3 * h))
            p[f"h{way}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            p[f"c{way}"] = np.zeros(3 * h)
        p["attend"] = rng.normal(0, 0.3, (2 * h, h))
        p["query"] = rng.normal(0, 0.3, h)
        p["out"] = rng.normal(0, 0.3, 2 * h)
        p["bias"] = np.full(1, -3.0)
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, chars: Grams, word: np.ndarray) -> np.ndarray:
        # every word has a letter, hence a trigram with its borders
        total = np.add.reduceat(self.p["chars"][chars.buckets], np.cumsum(chars.counts) - chars.counts, axis=0)
        return np.concatenate([total * chars.scale[:, None], self.p["words"][word]], axis=1)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of the gates for distinct words, and a last row for padding."""
        x = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
        return {way: x @ self.p[f"x{way}"] + self.p[f"c{way}"] for way in ("f", "b")}

    def states(self, parts: dict[str, np.ndarray], index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States [T, B, 2H] over windows of word indexes [T, B]."""
        t, b, h = *index.shape, HIDDEN
        out = np.empty((t, b, 2 * h), np.float32)
        for k, way in enumerate(("f", "b")):
            state, w = np.zeros((b, h), np.float32), self.p[f"h{way}"]
            for step in range(t) if way == "f" else range(t - 1, -1, -1):
                x, y = parts[way][index[step]], state @ w
                gates = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
                r, z = gates[:, :h], gates[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
                before, state = state, new + z * (state - new)
                out[step, :, k * h : k * h + h] = state
                if keep is not None:
                    keep.append((way, step, before, r, z, new, y[:, 2 * h :]))
        return out

    def pool(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window logits, and what the backward pass needs; ``real`` marks words that are not padding."""
        shape = states.shape
        tanh = np.tanh(states.reshape(-1, shape[2]) @ self.p["attend"]).reshape(shape[0], shape[1], HIDDEN)
        score = np.where(real, tanh @ self.p["query"], -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled @ self.p["out"] + self.p["bias"][0], tanh, weight, pooled

    def gradient(self, chars, word, inverse, real, doc, label, drop) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradient of a batch: windows [T, B] of distinct-word indexes, by document."""
        h, p = HIDDEN, self.p
        x = self.inputs(chars, word)
        x[:, WIDTH:] *= drop[:, None]
        parts, keep = self.project(x), []
        states = self.states(parts, inverse, keep)
        logit, tanh, weight, pooled = self.pool(states, real)
        soft = np.logaddexp(0, logit)
        total = np.maximum(np.bincount(doc, soft, len(label)), 1e-6)
        chance = np.maximum(-np.expm1(-total), 1e-6)
        loss = np.where(label == 1, -np.log(chance), total).mean()
        slope = np.where(label == 1, -np.exp(-total) / chance, 1.0) / len(label)
        d_logit = (slope[doc] * _sigmoid(logit)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"][0], g["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["query"] = np.einsum("tb,tbh->h", d_score, tanh)
        d_tanh = (d_score[:, :, None] * p["query"] * (1 - tanh * tanh)).reshape(-1, h)
        g["attend"] = states.reshape(-1, 2 * h).T @ d_tanh
        d_states += (d_tanh @ p["attend"].T).reshape(states.shape)
        d_parts = {way: np.zeros_like(parts[way]) for way in parts}
        carry = {way: 0.0 for way in parts}
        for way, step, before, r, z, new, y in reversed(keep):
            k = 0 if way == "f" else h
            d = d_states[step, :, k : k + h] + carry[way]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * y * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_new], axis=1)
            d_y = np.concatenate([d_r, d_z, d_new * r], axis=1)
            g[f"h{way}"] += before.T @ d_y
            carry[way] = d_y @ p[f"h{way}"].T + d * z
            _add_rows(d_parts[way], inverse[step], d_x)
        d_input = 0.0
        for way, d in d_parts.items():
            g[f"c{way}"] = d.sum(axis=0)
            g[f"x{way}"] = x.T @ d[:-1]
            d_input = d_input + d[:-1] @ p[f"x{way}"].T
        _add_rows(g["chars"], chars.buckets, np.repeat(d_input[:, :WIDTH] * chars.scale[:, None], chars.counts, axis=0))
        _add_rows(g["words"], word, d_input[:, WIDTH:] * drop[:, None])
        return float(loss), g


def _add_rows(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """target[rows] += values, with repeated rows summed."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    target[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def _windows(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, windows of word indexes [T, B] (padding: one past the last), document of each window."""
    known: dict[str, int] = {}
    flat, starts, docs, base = [], [], [], 0
    for d, words in enumerate(texts):
        flat += [known.setdefault(w, len(known)) for w in words]
        own = window_starts(len(words))
        starts += [(base + s, base + len(words)) for s in own]
        docs += [d] * len(own)
        base += len(words)
    vocabulary = list(known)
    ids = np.append(np.array(flat, np.int64), len(vocabulary))
    if not starts:
        return vocabulary, np.empty((WINDOW, 0), np.int64), np.empty(0, np.int64)
    bounds = np.array(starts, np.int64)
    at = bounds[:, 0] + np.arange(WINDOW)[:, None]
    index = ids[np.where(at < bounds[:, 1], at, len(flat))]
    return vocabulary, index, np.array(docs, np.int64)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit by Adam over batches of whole documents; the word part of an input is dropped half the time."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    known: dict[str, str] = {}
    words = [[known.setdefault(w, w) for w in words_of(t)] for t in texts]  # equal words are one object
    pick = [i for i, w in enumerate(words) if w]
    label = np.array(labels)
    if not pick or len({labels[i] for i in pick}) < 2:
        return net
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(pick)
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        for batch in batches:
            vocabulary, index, doc = _windows([words[i] for i in batch])
            chars, word = features(vocabulary)
            drop = (rng.random(len(vocabulary)) < 0.5).astype(np.float32)
            _, g = net.gradient(chars, word, index, index < len(vocabulary), doc, label[batch], drop)
            step += 1
            rate = 0.01 * (1 - epoch / (epochs + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                net.p[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return net


def score(net: Network, texts: list[str | None]) -> np.ndarray:
    """Highest window probability of each whole text; no words: the network's bias alone."""
    vocabulary, index, doc = _windows([words_of(t) for t in texts])
    logits = np.full(len(texts), net.p["bias"][0], np.float32)
    if len(doc):
        parts = net.project(net.inputs(*features(vocabulary)))
        found = np.concatenate([net.pool(net.states(parts, part), part < len(vocabulary))[0] for part in np.array_split(index, max(1, -(-index.shape[1] // BATCH)), axis=1)])
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        logits[doc[first]] = np.maximum.reduceat(found, first)
    return np.round(_sigmoid(logits.astype(np.float64)), 6)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Network:
    """Train on labelled documents, in one task; rows without text, id or label are left out.

    The driver sees the network alone.
    """
    own = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    marks = labels.select(labels[doc_id].alias("id"), labels[toxic].cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bound = {0: SAMPLE_CLEAN, 1: SAMPLE_TOXIC}
    # a bounded set of ids: the lowest hashes of each label
    share = F.when(F.col("toxic") == 1, 1.2 * bound[1] / counts.get(1, 1)).otherwise(1.2 * bound[0] / counts.get(0, 1))
    few = marks.where(draw < share)
    sample = own.where("length(text) > 0").join(F.broadcast(few), "id").select(draw.alias("draw"), "id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        chosen = [r for k in (0, 1) for r in [x for x in rows if x[3] == k][: bound[k]]]
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(train([r[2] for r in chosen], [r[3] for r in chosen]).p)], pa.binary())})

    found = sample.repartition(1).mapInArrow(run, "net binary").collect()
    return Network(pickle.loads(bytes(found[0].net))) if found else train([], [])


def score_toxicity(docs: DataFrame, net: Network, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score in 0..1 and predicted (1 from ``threshold`` on).

    One row a document, repeated rows included.  Null, empty and wordless texts
    get the score of the network's bias; columns beside id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net.p))  # a fixed size, about 4 MB

    def make():
        own = Network(pickle.loads(shared.value))

        def apply(batch: pa.RecordBatch) -> dict:
            found = score(own, batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "score": found, "predicted": (found >= threshold).astype(np.int32)}

        return apply

    picked = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    return map_texts(docs, picked, "text", "doc_id long, score double, predicted int", make)


def drop_toxic(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose score stays below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net.p))

    def make():
        own = Network(pickle.loads(shared.value))
        return lambda texts: (score(own, texts) < threshold).tolist()

    return keep_rows(docs, text, make)
