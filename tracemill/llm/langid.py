"""Language identification by compression.

Each language has a zstandard compressor primed with a raw-content dictionary
of its training text.  A text, reduced to lower-case words, is compressed in
blocks, so that the dictionary and not the text's own past decides, and gets
the language whose blocks are smallest in sum.  The score is how much smaller
they are than the runner-up's, relative to it; narrow scores are rejected.

Training reads a bounded sample: the SAMPLE_DOCS rows of each language with the
lowest hash, and of those DICTIONARY_BYTES bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import keep_rows, map_texts

SAMPLE_DOCS = 400
DICTIONARY_BYTES = 96 * 1024
LEVEL = 6
BLOCK_BYTES = 16_384
MARGIN = 0.004
UNKNOWN = "und"

_GAP = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower-case words divided by single spaces."""
    return _GAP.sub(" ", text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, in alphabetical order."""

    dictionaries: tuple[tuple[str, bytes], ...]


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", key: str | Column = "doc_id") -> LanguageModel:
    """Dictionaries from labelled rows; rows without text or language are left out."""
    key = F.col(key) if isinstance(key, str) else key
    draw = (F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("draw")
    labelled = rows.select(rows[lang].alias("lang"), rows[text].alias("text"), draw).where("lang is not null and length(text) > 0")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel(())
    # the rows with the lowest draws, with some to spare; the share follows the counts
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(1.5 * SAMPLE_DOCS / n)) for k, n in counts.items()))
    sample = labelled.where(F.col("draw") < share[F.col("lang")]).withColumn("text", F.substring("text", 1, DICTIONARY_BYTES))
    found: dict[str, list[tuple[float, str]]] = {}
    for row in sample.toLocalIterator():
        found.setdefault(row.lang, []).append((row.draw, row.text))
    found = {k: sorted(v)[:SAMPLE_DOCS] for k, v in found.items()}
    return LanguageModel(tuple((k, _dictionary([t for _, t in v])) for k, v in sorted(found.items())))


def _dictionary(rows: list[str]) -> bytes:
    """Training text, an equal share of every sampled row, the first row last (nearest)."""
    texts = [letters_only(t).encode() for t in rows]
    share = max(1, DICTIONARY_BYTES // len(texts))
    parts = [t[:share] for t in texts]
    spare = DICTIONARY_BYTES - sum(map(len, parts))
    for t in texts:
        if spare <= 0:
            break
        more = t[share : share + spare]
        parts.append(more)
        spare -= len(more)
    return b"\n".join(reversed(parts))[-DICTIONARY_BYTES:]


class Classifier:
    def __init__(self, model: LanguageModel):
        import zstandard

        self.names = [k for k, _ in model.dictionaries]
        self._compress = []
        for _, raw in model.dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._compress.append(c.compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); no letter, or no language learned, gives ``und`` and 0."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        raw = letters_only(text).encode()
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = [sum([len(compress(b)) for b in blocks]) for compress in self._compress]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.names[0], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.names[best], (second - sizes[best]) / second


def rejects(lang: str, score: float, margin: float = MARGIN) -> bool:
    return lang == UNKNOWN or score < margin


def drop_unknown(docs: DataFrame, model: LanguageModel, margin: float = MARGIN, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose language is not rejected."""

    def make():
        classifier = Classifier(model)
        return lambda texts: [not rejects(*classifier.predict(t), margin) for t in texts]

    return keep_rows(docs, text, make)


def predict_language(docs: DataFrame, model: LanguageModel, margin: float = MARGIN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score in 0..1, rejected (``und`` or score below ``margin``).

    One row a document, repeated rows included; null, empty and letterless
    texts are ``und`` with score 0.  Ties go to the alphabetically first.
    """

    def make():
        classifier = Classifier(model)

        def apply(batch: pa.RecordBatch) -> dict:
            found = [classifier.predict(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "lang_pred": [k for k, _ in found],
                "score": [s for _, s in found],
                "rejected": [rejects(k, s, margin) for k, s in found],
            }

        return apply

    picked = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    return map_texts(docs, picked, "text", "doc_id long, lang_pred string, score double, rejected boolean", make)
