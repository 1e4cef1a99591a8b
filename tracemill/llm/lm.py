"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram model over words.  Its automaton has a root, a
state for every context word seen in training, an arc for every n-gram seen and
a failure arc from each context state to the root.  A text is read once from
left to right: from the state of the last word the arc of the next word is
taken if it exists; otherwise the failure arc's weight is added and the root's
arc is taken.  Either way the next state is that of the word just read.

Root arcs carry the add-one unigram (c + 1) / (N + V + 1).  A context h keeps
mass 1 - r for what followed it in training and passes r to the root, where r is
the share of training bigrams in contexts as frequent as h that occur once
(Good-Turing), so rare contexts trust the unigram more.

Counts are exact over all training documents.  Texts are first written as
blocks of about BLOCK_TOKENS tokens with their own vocabulary.  Each block asks
for the counts of its distinct words and of its distinct bigrams; requests
carry the block's own training counts and are hashed to reducers that sum them
over all blocks and answer every block in the order asked.  A frequent word or
bigram is one entry a block, however often it occurs, and reducers grow in
number with the distinct entries, so none of them grows with the input.  Of the
blocks that ask for a bigram one owns it: the Good-Turing shares are sums over the
blocks of what they own.  Words and bigrams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch
from tracemill.llm.shingles import distinct

BLOCK_TOKENS = 1_000_000
REDUCER_ENTRIES = 2_000_000
#: Context frequencies are grouped by their binary logarithm.
CLASSES = 48

END = 0  # local id of the end token in every block
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block long, ids binary, held binary, null_ids binary, lengths binary, tokens binary, words binary, n_words long, n_pairs long, train_docs long"
REQUESTS = "kind int, part int, block long, keys binary, counts binary"
ANSWERS = "kind int, part int, block long, counts binary, owned binary, n_types long, n_tokens long"
COUNTED = "block long, ids binary, held binary, null_ids binary, lengths binary, tokens binary, n_words long, word_counts binary, pair_counts binary, classes array<struct<once:bigint,mass:bigint>>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased text, divided by ASCII white space."""
    return text.encode().translate(_LOWER).split() if text else []


def pack(values: np.ndarray) -> bytes:
    """An integer array, byte plane by byte plane, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _hash_words(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def blocks_of(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encoded blocks of a table with columns doc_id, held, text."""

    def encode(rows: list[tuple], block: int) -> dict:
        known: dict[bytes, int] = defaultdict(count().__next__)
        known[b""]  # the end token: no word is empty
        tokens, lengths = [], []
        for _, _, words in rows:
            tokens += map(known.__getitem__, words)
            tokens.append(END)
            lengths.append(len(words) + 1)
        flat = np.array(tokens, np.int32)
        sizes = np.array(lengths, np.int64)
        held = np.array([h for _, h, _ in rows], bool)
        return {
            "block": block,
            "ids": np.array([i or 0 for i, _, _ in rows], np.int64).tobytes(),
            "held": held.tobytes(),
            "null_ids": np.array([i is None for i, _, _ in rows], bool).tobytes(),
            "lengths": pack(sizes),
            "tokens": pack(flat),
            "words": _hash_words(list(known)).tobytes(),
            "n_words": len(known),
            "n_pairs": len(distinct(_pairs(flat, sizes, len(known)))),
            "train_docs": int((~held).sum()),
        }

    def run(batches):
        from tracemill.llm.common import slices

        base, rows, size, made = TaskContext.get().partitionId() << 24, [], 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                for i, held, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = tokens_of(text)
                    rows.append((i, held, words))
                    size += len(words) + 1
                    if size >= block_tokens:
                        yield pa.RecordBatch.from_pylist([encode(rows, base + made)], schema=schema)
                        rows, size, made = [], 0, made + 1
        if rows:
            yield pa.RecordBatch.from_pylist([encode(rows, base + made)], schema=schema)

    from tracemill.llm.common import _arrow_schema

    schema = _arrow_schema(docs.sparkSession, BLOCKS)
    return docs.select("doc_id", "held", "text").mapInArrow(run, BLOCKS)


def _before(tokens: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The token before each token; ``start`` before a text's first."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = start
    return before


def _pairs(tokens: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    return _before(tokens, lengths, n) * (n + 1) + tokens


class Block:
    """A decoded block row."""

    def __init__(self, row):
        self.block = int(row.block)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.held = np.frombuffer(row.held, bool)
        self.null_ids = np.frombuffer(row.null_ids, bool)
        self.lengths = unpack(row.lengths, np.int64)
        self.tokens = unpack(row.tokens, np.int32).astype(np.int64)
        self.n = int(row.n_words)
        self.words = np.frombuffer(row.words, np.uint64) if hasattr(row, "words") else None
        self.trains = ~np.repeat(self.held, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trains], minlength=self.n)

    def word_parts(self, parts: int) -> list[np.ndarray]:
        """Local word ids by reducer."""
        return _dealt(self.words, parts)

    def pairs(self) -> np.ndarray:
        """Distinct (context, word) codes."""
        return distinct(_pairs(self.tokens, self.lengths, self.n))

    def counted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context, word) codes, and how often training texts of the block have each."""
        pairs = _pairs(self.tokens, self.lengths, self.n)
        codes, counts = np.unique(pairs, return_counts=True)
        held, times = np.unique(pairs[~self.trains], return_counts=True)
        counts[np.searchsorted(codes, held)] -= times
        return codes, counts

    def pair_hashes(self, codes: np.ndarray) -> np.ndarray:
        hashes = np.append(self.words, np.uint64(0xA5A5A5A55A5A5A5A))  # the last: a text's start
        left, right = hashes[codes // (self.n + 1)], hashes[codes % (self.n + 1)]
        mixed = (left * _MIX ^ left >> np.uint64(31)) + right
        mixed = (mixed ^ mixed >> np.uint64(29)) * _MIX
        return mixed ^ mixed >> np.uint64(32)


def _dealt(hashes: np.ndarray, parts: int) -> list[np.ndarray]:
    """Positions by reducer, each in the order of the hashes: reducers take equal ranges of them."""
    order = np.argsort(hashes)
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.split(order, np.searchsorted(hashes[order], bounds))


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the binary logarithm of its count."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(np.float64))[1], 0).astype(np.uint8)


def _requests(kind: int, block: int, parts: list[np.ndarray], keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """One row a reducer that the block has something to ask."""
    asked = [(i, p) for i, p in enumerate(parts) if len(p)]
    return pd.DataFrame(
        {
            "kind": kind,
            "part": [i for i, _ in asked],
            "block": block,
            "keys": [pack(np.diff(keys[p], prepend=np.uint64(0))) for _, p in asked],
            "counts": [pack(counts[p].astype(np.uint64)) for _, p in asked],
        }
    )


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum one reducer's requests over all blocks and answer each block."""
    rows = rows.sort_values("block", kind="stable")
    own = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    sizes, keys = [len(k) for k in own], np.concatenate(own)
    counts = np.concatenate([unpack(c, np.uint64) for c in rows["counts"]]).astype(np.int64)
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, counts)
    owned = np.zeros(len(keys), bool)
    owned[first] = True
    cut = np.cumsum(sizes)[:-1]
    lead = np.arange(len(rows)) == 0
    return pd.DataFrame(
        {
            "kind": rows["kind"].to_numpy(),
            "part": rows["part"].to_numpy(),
            "block": rows["block"].to_numpy(),
            "counts": [pack(a.astype(np.uint64)) for a in np.split(total[which], cut)],
            "owned": [pack(np.packbits(a)) for a in np.split(owned, cut)],
            "n_types": np.where(lead, int((total > 0).sum()), 0),
            "n_tokens": np.where(lead, int(total.sum()), 0),
        }
    )


def _answered(rows: pd.DataFrame, kind: int, parts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """One block's counts and which it owns, put back in the block's own order."""
    rows = rows[rows["kind"] == kind]
    counts, owned = np.zeros(n, np.int64), np.zeros(n, bool)
    for i, raw, mask in zip(rows["part"], rows["counts"], rows["owned"]):
        counts[parts[i]] = unpack(raw, np.uint64)
        owned[parts[i]] = np.unpackbits(unpack(mask, np.uint8), count=len(parts[i]))
    return counts, owned


class Automaton:
    """Arcs and failure weights over a block's words, as base-10 logarithms.

    States are the local word ids that training saw as contexts, ``start`` for
    the beginning of a text, and the root (-1).
    """

    def __init__(self, codes: np.ndarray, pair_counts: np.ndarray, word_counts: np.ndarray, starts: int, total: int, types: int, keep: np.ndarray):
        n = len(word_counts)
        context = np.append(word_counts, starts)
        self.n, self.start = n, n if starts else -1
        self.root = np.log10((word_counts + 1) / (total + types + 1))
        passed = keep[frequency_class(context)]
        self.failure = np.where(context > 0, np.log10(passed), 0.0)
        self.state = np.where(context > 0, np.arange(n + 1), -1)
        seen = pair_counts > 0
        self.arcs = codes[seen]
        left, right = self.arcs // (n + 1), self.arcs % (n + 1)
        self.weight = np.log10((1 - passed[left]) * pair_counts[seen] / context[left] + passed[left] * 10 ** self.root[right])

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and weights of reading one word from each state."""
        code = states * (self.n + 1) + words
        at = np.minimum(np.searchsorted(self.arcs, code), max(0, len(self.arcs) - 1))
        hit = (states >= 0) & (self.arcs[at] == code) if len(self.arcs) else np.zeros(len(states), bool)
        miss = np.where(states >= 0, self.failure[states], 0.0) + self.root[words]
        return self.state[words], np.where(hit, self.weight[at] if len(self.arcs) else 0.0, miss)

    def read(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability of each text, all texts one word at a time from left to right."""
        first = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        at, left = first[order], lengths[order]
        state, total = np.full(len(order), self.start), np.zeros(len(order))
        live, step = len(order), 0
        while live:
            state[:live], weight = self.step(state[:live], tokens[at[:live] + step])
            total[:live] += weight
            step += 1
            live = int(np.searchsorted(-left, -step, side="left"))  # texts longer than step
        out = np.empty(len(order))
        out[order] = total
        return out


def score_texts(docs: DataFrame, held: str, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, reducer_entries: int = REDUCER_ENTRIES) -> DataFrame:
    """Score every whole text with a model of the documents where ``held`` is false.

    One row a document: doc_id, held_out, n_tokens (the end included), n_known,
    train_tokens, base_score and score, both log10.  A null or empty text is one
    end token.  A null doc_id is kept, a null ``held`` is false; repeated rows
    count as often as they occur.  With no training rows both scores are those of
    an empty model; an empty table gives no rows.  A text of any length lies in one
    block.  Columns beside the three named are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[held], F.lit(False)).alias("held"), docs[text].alias("text"))
    blocks = scratch.table(blocks_of(own, block_tokens), "blocks")
    sizes = blocks.agg(F.sum("n_words"), F.sum("n_pairs"), F.sum("train_docs")).first()
    word_parts = max(1, -(-(sizes[0] or 0) // reducer_entries))
    pair_parts = max(1, -(-(sizes[1] or 0) // reducer_entries))
    starts = sizes[2] or 0

    def ask(frames):
        for frame in frames:
            for row in frame.itertuples():
                b = Block(row)
                yield _requests(0, b.block, b.word_parts(word_parts), b.words, b.word_counts())
                codes, counts = b.counted_pairs()
                hashes = b.pair_hashes(codes)
                yield _requests(1, b.block, _dealt(hashes, pair_parts), hashes, counts)

    asked = _dealt_out(blocks.mapInPandas(ask, REQUESTS), word_parts + pair_parts)
    answers = scratch.table(asked.groupBy("kind", "part").applyInPandas(_answer, ANSWERS), "answers")
    total, types = answers.where("kind = 0").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()

    def count_in(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        b = Block(row)
        known, _ = _answered(right, 0, b.word_parts(word_parts), b.n)
        codes = b.pairs()
        counts, owned = _answered(right, 1, _dealt(b.pair_hashes(codes), pair_parts), len(codes))
        of = frequency_class(np.append(known, starts))[codes // (b.n + 1)][owned]
        once = np.bincount(of[counts[owned] == 1], minlength=CLASSES)
        mass = np.zeros(CLASSES, np.int64)
        np.add.at(mass, of, counts[owned])
        given = {c: [getattr(row, c)] for c in ("block", "ids", "held", "null_ids", "lengths", "tokens", "n_words")}
        sums = [{"once": int(x), "mass": int(y)} for x, y in zip(once, mass)]
        return pd.DataFrame(given | {"word_counts": [pack(known.astype(np.uint64))], "pair_counts": [pack(counts.astype(np.uint64))], "classes": [sums]})

    asking = answers.select("kind", "part", "block", "counts", "owned")
    scratch.free()  # the requests
    counted = scratch.table(blocks.groupBy("block").cogroup(asking.groupBy("block")).applyInPandas(count_in, COUNTED), "counted")
    scratch.drop("blocks", "answers")
    scratch.free()
    keep = np.full(CLASSES, 0.5)
    for row in counted.select(F.posexplode("classes").alias("c", "x")).groupBy("c").agg(F.sum("x.once").alias("once"), F.sum("x.mass").alias("mass")).collect():  # CLASSES rows
        keep[row.c] = (row.once + 0.5) / (row.mass + 1)
    keep = np.clip(keep, 1e-4, 0.9999)

    def finish(frames):
        for frame in frames:
            for row in frame.itertuples():
                b = Block(row)
                known = unpack(row.word_counts, np.uint64).astype(np.int64)
                model = Automaton(b.pairs(), unpack(row.pair_counts, np.uint64).astype(np.int64), known, starts, total, types, keep)
                first = np.cumsum(b.lengths) - b.lengths
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(np.where(b.null_ids, 0, b.ids), "Int64"),
                        "held_out": b.held,
                        "n_tokens": b.lengths,
                        "n_known": np.add.reduceat((known > 0)[b.tokens].astype(np.int64), first),
                        "train_tokens": total,
                        "base_score": np.add.reduceat(model.root[b.tokens], first),
                        "score": model.read(b.tokens, b.lengths),
                    }
                ).assign(doc_id=lambda d: d["doc_id"].mask(b.null_ids))

    return counted.mapInPandas(finish, SCORES)


def _dealt_out(requests: DataFrame, parts: int) -> DataFrame:
    """Requests with their reducers spread over at least as many partitions as there are."""
    return requests.repartition(parts, "kind", "part")
