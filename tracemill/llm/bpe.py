"""Byte-level BPE encoding and decoding of whole texts from a rank file.

A text is cut into overlapping chunks that are pre-tokenised independently.
Two neighbouring chunks are stitched at the first pre-token start that both of
them found inside their overlap: matching has no memory beyond a match's start,
so from there on both would agree.  What a chunk found near its own end is not
trusted, because a match there may have been cut short.  Where no such start
exists (a single run longer than the overlap) the left chunk is matched again over
twice its length.  Each pre-token is then merged by rank, and decoding concatenates
the bytes of the ids.

The pattern engine here and the library's may know different versions of Unicode.
The library is asked which characters it joins to letters and digits, and those on
which the two differ are matched by stand-ins of the library's class.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.common import map_texts

CHUNK = 16_384
OVERLAP = 512
#: A match is trusted when it ends so many characters before its chunk's end;
#: no alternative of the pattern looks further ahead than that.
GUARD = 8
#: Distinct pre-tokens whose ids one task keeps at a time.
CACHE = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


@lru_cache(maxsize=4)
def stand_ins(pattern: str) -> dict[int, str]:
    """Code points that the library classes otherwise than ``regex``, and a character of its class.

    The library's class shows in whether a character stands in one piece with the
    letter or the digit before it: only then its first byte merges with that one.
    No plane above the third has letters or digits.
    """
    import regex
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {x + bytes([b]): len(ranks) + 256 * i + b for i, x in enumerate((b"a", b"1")) for b in range(0xC2, 0xF5)}
    library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    codes = [c for c in range(0x80, 0x40000) if not 0xD800 <= c < 0xE000 and not chr(c).isspace() and unicodedata.category(chr(c))[0] != "Z"]
    found = {}
    for i in range(0, len(codes), 512):
        part = codes[i : i + 512]
        seen = {"a": set(), "1": set()}
        for x, joined in seen.items():
            at = 0
            for token in library.encode_ordinary("".join(f"{x}{chr(c)}\n" for c in part)):
                if token == 10:
                    at += 1
                elif token > 255:
                    joined.add(at)
        for k, c in enumerate(part):
            own = "ß" if k in seen["a"] else "3" if k in seen["1"] else "!"
            here = "ß" if letter.match(chr(c)) else "3" if number.match(chr(c)) else "!"
            if own != here:
                found[c] = own
    return found


def pretokens(text: str, pattern, chunk: int = CHUNK, overlap: int = OVERLAP, seen: str | None = None) -> list[str]:
    """The pattern's matches over the whole text, found chunk by chunk; on ``seen``, of the same length, if it is given."""
    shown, text = text, text if seen is None else seen
    if len(text) <= chunk and seen is None:
        return pattern.findall(text)
    step = chunk - overlap
    spans = [(a, min(len(text), a + chunk)) for a in range(0, max(1, len(text) - overlap), step)]
    found = [_starts(pattern, text, a, b) for a, b in spans]
    starts = found[0]
    end = spans[0][1]
    for (a, b), right in zip(spans[1:], found[1:]):
        if b <= end:
            continue
        known = set(right)
        meet = next((i for i in range(len(starts) - 1, -1, -1) if starts[i] in known), None) if starts and starts[-1] >= a else None
        if meet is None:
            # no common start: match again from the last sure one, over twice as much each time
            origin = starts[-1] if starts else spans[0][0]
            end = min(len(text), 2 * b - origin)
            starts = starts[:-1] + _starts(pattern, text, origin, end)
        else:
            at = starts[meet]
            starts = starts[:meet] + right[right.index(at) :]
            end = b
    assert end == len(text)
    starts.append(len(text))
    return [shown[i:j] for i, j in zip(starts, starts[1:])]


def _starts(pattern, text: str, begin: int, end: int) -> list[int]:
    """Starts of the trusted matches in text[begin:end]; every one at the text's end."""
    spans = [m.span() for m in pattern.finditer(text[begin:end])]
    if end == len(text):
        return [begin + a for a, _ in spans]
    sure = [begin + a for a, b in spans if begin + b <= end - GUARD]
    # the start after the last trusted match is a match start too
    if len(sure) < len(spans):
        sure.append(begin + spans[len(sure)][0])
    return sure


class ByteBPE:
    """Encoder and decoder over a rank file."""

    def __init__(self, path: str, pattern: str, others: dict[int, str] | None = None):
        import regex
        import tiktoken

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self._pieces: dict[str, list[int]] = {}
        self._others = stand_ins(pattern) if others is None else others
        self._other = frozenset(map(chr, self._others))  # a class of thousands of characters is tried one by one by ``regex``

    def piece(self, piece: str) -> list[int]:
        ids = self._pieces.get(piece)
        if ids is None:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            ids = [rank] if rank is not None else self._merge(raw)
            if len(self._pieces) >= CACHE:
                self._pieces.clear()
            if len(piece) <= 64:
                self._pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, own = self._pieces, self.piece
        odd = not text.isascii() and not self._other.isdisjoint(text)
        pieces = pretokens(text, self.pattern, seen=text.translate(self._others) if odd else None)
        return list(chain.from_iterable([known[p] if p in known else own(p) for p in pieces]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def encode_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, ids ARRAY<INT>; a null text has no ids."""
    others = stand_ins(pattern)  # a few thousand code points at most

    def make():
        bpe = ByteBPE(path, pattern, others)
        return lambda batch: {"doc_id": batch.column(0), "ids": [bpe.encode(t or "") for t in batch.column(1).to_pylist()]}

    return map_texts(docs, [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")], "text", "doc_id long, ids array<int>", make)


def decode_ids(encoded: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row a document: doc_id, raw BINARY; bytes that are no UTF-8 by themselves stay as they are."""

    def run(batches):
        bpe = ByteBPE(path, pattern, {})
        for batch in batches:
            raw = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].alias("ids")).mapInArrow(run, "doc_id long, raw binary")


def bpe_digest(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and return both digests.

    One row a document; a null or empty text has no tokens and the digests of
    empty strings.  Repeated rows repeat their result, and columns beside id
    and text are ignored.
    """
    others = stand_ins(pattern)

    def make():
        bpe = ByteBPE(path, pattern, others)
        decimal = {i: str(i) for i in bpe.bytes_of}

        def apply(batch: pa.RecordBatch) -> dict:
            counts, ids_hash, raw_hash = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t or "")
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                raw_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids_hash, "decoded_sha256": raw_hash}

        return apply

    picked = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    return map_texts(docs, picked, "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
