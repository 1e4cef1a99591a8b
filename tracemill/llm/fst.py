"""Token counts by finite-state transduction.

Two deterministic machines are composed.

*Splitter.*  Thirteen states over character classes reproduce the byte-level
pre-token pattern, look-ahead included: a transition says whether a pre-token
starts at the character read, at the one before it, or at both.  Texts of a
batch form one character stream that is cut into equal chunks.  For every chunk
the map from entry state to exit state is computed, all chunks in lock step; the
maps compose associatively, so a parallel prefix scan gives each chunk its true
entry state, and a second pass in lock step emits the starts.

*Merger.*  A byte transducer that is compiled as input reaches it.  Its state
after a prefix of a pre-token is the prefix's last BPE token in the context of
the states before it; by the unique-valid-encoding property of BPE the last
token is the one suffix token that merges with nothing to its left.  A transition
takes a token behind the state some bytes back and is annotated with one emitted
token, so a pre-token's count is the sum along its path.  The distinct pre-tokens
of a batch are lanes that read their bytes in lock step; which pairs of tokens stand
unmerged is compiled when the first lane asks and looked up from then on.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracemill.llm.common import map_texts

# Character classes of the splitter.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, L_R, L_V, L_L, L_E, L_STMD, END = range(12)
# States: Q quote that starts a token, QR/QV/QL after 'r 'v 'l, DONE a finished
# contraction, W one blank, WW a longer run of blanks; the last blank is a plain
# space (S) or not (B).
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, Q, QR, QV, QL, DONE, WS, WB, WWS, WWB = range(13)
N_STATES, N_CLASSES = 13, 12
HERE, BEFORE = 1, 2  # a pre-token starts at this character, at the one before
LANE = 2048


def _letterlike(c: int) -> bool:
    return c in (LETTER, L_R, L_V, L_L, L_E, L_STMD)


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables next[state, class] and emit[state, class]."""

    def fresh(c: int) -> int:
        """The state after a character that starts a token."""
        if _letterlike(c):
            return IN_LETTERS
        return {NUMBER: IN_NUMBERS, QUOTE: Q, SPACE: WS, BLANK: WB, END: START}.get(c, IN_OTHER)

    def inside(c: int) -> int:
        """The state after the first character behind a leading space."""
        return IN_LETTERS if _letterlike(c) else IN_NUMBERS if c == NUMBER else IN_OTHER

    nxt = np.zeros((N_STATES, N_CLASSES), np.uint8)
    emit = np.zeros((N_STATES, N_CLASSES), np.uint8)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            blank = c in (SPACE, BLANK)
            to, out = fresh(c), HERE
            if s == IN_LETTERS and _letterlike(c) or s == IN_NUMBERS and c == NUMBER:
                to, out = s, 0
            elif s in (IN_OTHER, Q) and c in (OTHER, QUOTE):
                to, out = IN_OTHER, 0
            elif s == Q and c in (L_R, L_V, L_L):
                to, out = {L_R: QR, L_V: QV, L_L: QL}[c], 0
            elif s == Q and c == L_STMD:
                to, out = DONE, 0
            elif s in (QR, QV) and c == L_E or s == QL and c == L_L:
                to, out = DONE, 0
            elif s in (QR, QV, QL):  # no contraction: the quote stands alone
                to, out = (IN_LETTERS, BEFORE) if _letterlike(c) else (fresh(c), BEFORE | HERE)
            elif s in (WS, WB, WWS, WWB):
                if blank:
                    to, out = (WWS if c == SPACE else WWB), 0
                elif c == END:
                    to, out = START, HERE
                else:
                    out = BEFORE if s in (WWS, WWB) else 0
                    if s in (WS, WWS):
                        to = inside(c)
                    else:
                        to, out = fresh(c), out | HERE
            nxt[s, c], emit[s, c] = to, (out if c != END else out & ~HERE)
    return nxt, emit


#: White space beyond the separators of category Z, as Unicode's White_Space has it.
_WHITE = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}


def class_table(before=None) -> np.ndarray:
    """The class of every code point.

    ``before`` is the library's pre-tokenizer: code points that Python's Unicode
    tables don't know yet get the class under which it splits them.
    """
    table = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = NUMBER
        elif kind[0] == "Z" or c in _WHITE:
            table[c] = BLANK
    table[0x20], table[ord("'")] = SPACE, QUOTE
    for c, kind in (("r", L_R), ("v", L_V), ("l", L_L), ("e", L_E), ("s", L_STMD), ("t", L_STMD), ("m", L_STMD), ("d", L_STMD)):
        table[ord(c)] = kind
    if before is not None:
        new = [c for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]  # no later plane has letters or digits
        for c, (letter, number) in zip(new, _as_split(before, new)):
            table[c] = LETTER if letter else NUMBER if number else table[c]
    return table


def _as_split(before, codes: list[int]) -> list[tuple[bool, bool]]:
    """Whether the pre-tokenizer joins each code point to a letter, to a digit."""
    found = []
    for i in range(0, len(codes), 256):
        part = codes[i : i + 256]
        starts = {span[0] for _, span in before.pre_tokenize_str("".join(f"\na{chr(c)}1" for c in part))}
        found += [(k + 2 not in starts, k + 3 not in starts) for k in range(0, 4 * len(part), 4)]
    return found


class Splitter:
    def __init__(self, lane: int = LANE, classes: np.ndarray | None = None):
        self.next, self.emit = compile_splitter()
        self.classes = class_table() if classes is None else classes
        self.lane = lane

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Positions at which a pre-token starts in a stream of classes that ends with END."""
        n = len(classes)
        lanes = -(-n // self.lane)
        grid = np.full(lanes * self.lane, END, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(lanes, self.lane).T)
        flat_next, flat_emit = self.next.ravel(), self.emit.ravel()
        entry = self._entries(grid)
        state = entry.astype(np.intp)
        out = np.empty((self.lane, lanes), np.uint8)
        for t in range(self.lane):
            index = state * N_CLASSES + grid[t]
            out[t] = flat_emit[index]
            state = flat_next[index].astype(np.intp)
        marks = np.ascontiguousarray(out.T).ravel()[:n]
        here = (marks & HERE) != 0
        here[:-1] |= (marks[1:] & BEFORE) != 0
        return np.flatnonzero(here)

    def _entries(self, grid: np.ndarray) -> np.ndarray:
        """Entry state of every chunk: chunk maps composed by a prefix scan."""
        length, lanes = grid.shape
        flat = self.next.ravel()
        maps = np.repeat(np.arange(N_STATES, dtype=np.intp)[:, None], lanes, axis=1)
        live = np.arange(lanes)
        final = np.empty((N_STATES, lanes), np.intp)
        for t in range(length):
            maps = flat[maps * N_CLASSES + grid[t, live]].astype(np.intp)
            if t % 16 == 15 and t < length - 1:  # a map that became constant goes on as a single state
                constant = (maps == maps[0]).all(axis=0)
                if constant.any():
                    done = live[constant]
                    state = maps[0, constant]
                    for u in range(t + 1, length):
                        state = flat[state * N_CLASSES + grid[u, done]].astype(np.intp)
                    final[:, done] = state
                    live, maps = live[~constant], maps[:, ~constant]
                    if not len(live):
                        break
        if len(live):
            final[:, live] = maps
        scan, shift = final, 1
        while shift < lanes:  # scan[:, i] becomes the map of chunks 0..i
            ahead = scan.copy()
            ahead[:, shift:] = np.take_along_axis(scan[:, shift:], scan[:, :-shift], axis=0)
            scan, shift = ahead, shift * 2
        return np.concatenate([[START], scan[START, :-1]])


#: Checked token pairs, and counts of pre-tokens, that one worker keeps at a time.
LIMIT = 1_000_000
#: Bytes up to which pre-tokens run as lanes, and cells of the lanes' tables.
WIDTH, CELLS = 48, 1 << 23


class Merger:
    """The byte transducer of a BPE vocabulary, compiled as it is used."""

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.merges = merges
        self.tokens = sorted(vocabulary)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.longest = max(map(len, self.tokens), default=1)
        # the trie of the tokens, its edges as sorted node * 256 + byte
        edges: dict[int, int] = {}
        ends = [-1]
        for i, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                node = edges.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self._edges = np.array(sorted(edges), np.int64)
        self._to = np.array([edges[k] for k in self._edges.tolist()], np.int64)
        self._ends = np.array(ends, np.int64)
        self._whole = np.full(len(self.tokens), -1, np.int8)
        self._pairs, self._apart = np.empty(0, np.int64), np.empty(0, bool)
        self._new: dict[int, bool] = {}

    def merge(self, raw: bytes) -> list[bytes]:
        """BPE by its definition: the lowest-ranked adjacent pair merges first."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.merges.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token is what its own bytes merge to."""
        for i in np.unique(tokens[self._whole[tokens] < 0]).tolist():
            self._whole[i] = self.merge(self.tokens[i]) == [self.tokens[i]]
        return self._whole[tokens] == 1

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``left`` and ``right`` stand next to each other unmerged, pair by pair."""
        n = len(self.tokens)
        keys = left * n + right
        at = np.minimum(np.searchsorted(self._pairs, keys), max(0, len(self._pairs) - 1))
        known = self._pairs[at] == keys if len(self._pairs) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), bool)
        out[known] = self._apart[at[known]]
        if not known.all():
            asked, which = np.unique(keys[~known], return_inverse=True)
            found = []
            for k in asked.tolist():
                if k not in self._new:
                    a, b = self.tokens[k // n], self.tokens[k % n]
                    self._new[k] = self.merge(a + b) == [a, b]
                found.append(self._new[k])
            out[~known] = np.array(found, bool)[which]
            if len(self._new) > 1 << 14:
                self._merge_new()
        return out

    def _merge_new(self) -> None:
        if len(self._pairs) > LIMIT:
            self._pairs, self._apart = np.empty(0, np.int64), np.empty(0, bool)
        keys = np.concatenate([self._pairs, np.fromiter(self._new, np.int64, len(self._new))])
        apart = np.concatenate([self._apart, np.fromiter(self._new.values(), bool, len(self._new))])
        order = np.argsort(keys, kind="stable")
        self._pairs, self._apart, self._new = keys[order], apart[order], {}

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        for i in np.flatnonzero(lengths > WIDTH).tolist():
            out[i] = self._long(pieces[i])
        order = np.argsort(lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= WIDTH)]
        at = 0
        while at < len(order):
            # lanes of like length, as many as their table has room for
            width = int(lengths[order[min(len(order), at + 4096) - 1]])
            own = order[at : at + max(1, CELLS // (width * width))]
            own = own[lengths[own] <= width]
            out[own] = self._lanes([pieces[i] for i in own.tolist()], lengths[own])
            at += len(own)
        return out

    def _lanes(self, pieces: list[bytes], lengths: np.ndarray) -> np.ndarray:
        n, width = len(pieces), int(lengths.max())
        grid = np.zeros((n, width), np.uint8)
        grid[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        grid = np.ascontiguousarray(grid.T).astype(np.int64)
        # the token that each lane's bytes are from a place on, by its size
        found = np.full((width, min(width, self.longest) + 1, n), -1, np.int32)
        for a in range(width):
            live, node = np.flatnonzero(lengths > a), 0
            for size in range(1, min(width - a, self.longest) + 1):
                if size > 1:
                    inside = lengths[live] >= a + size
                    live, node = live[inside], node[inside]
                key = node * 256 + grid[a + size - 1, live]
                at = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
                hit = self._edges[at] == key
                live, node = live[hit], self._to[at[hit]]
                if not len(live):
                    break
                found[a, size, live] = self._ends[node]
        last, weight = np.full((width, n), -1, np.int64), np.zeros((width, n), np.int64)
        for i in range(width):
            todo = np.flatnonzero(lengths > i)
            for size in range(1, min(i + 1, self.longest) + 1):
                token = found[i + 1 - size, size, todo].astype(np.int64)
                some = token >= 0
                lane, token = todo[some], token[some]
                if len(lane):
                    fits = self.apart(last[i - size, lane], token) if size <= i else self.whole(token)
                    lane, token = lane[fits], token[fits]
                    last[i, lane] = token
                    weight[i, lane] = 1 + (weight[i - size, lane] if size <= i else 0)
                    todo = todo[last[i, todo] < 0]
                if not len(todo):
                    break
            else:
                if len(todo):
                    raise ValueError("no token of the vocabulary ends a run")
        return weight[lengths - 1, np.arange(n)]

    def _long(self, raw: bytes) -> int:
        """The same transduction of one run of any length, with a sliding window of states."""
        last: list[int] = []
        weight: list[int] = []
        for i in range(len(raw)):
            for size in range(1, min(i + 1, self.longest) + 1):
                token = self.ids.get(raw[i + 1 - size : i + 1])
                if token is not None and self._fits(last[i - size] if size <= i else None, token):
                    break
            else:
                raise ValueError("no token of the vocabulary ends the run")
            last.append(token)
            weight.append((weight[i - size] if size <= i else 0) + 1)
        return weight[-1]

    def _fits(self, left: int | None, token: int) -> bool:
        if left is None:
            return bool(self.whole(np.array([token]))[0])
        known = self._new.get(left * len(self.tokens) + token)
        return bool(self.apart(np.array([left]), np.array([token]))[0]) if known is None else known


def _byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts tokens as the library of the vocabulary file would."""

    def __init__(self, path: str, classes: np.ndarray | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without normalizer or prefix space are supported")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.added = [t["content"] for t in spec["added_tokens"]]
        vocabulary = {raw(t): i for t, i in model["vocab"].items() if t not in self.added}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merger = Merger(vocabulary, {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)})
        self.splitter = Splitter(classes=classes)
        self._added = None
        if self.added:
            import re

            self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self._pieces: dict[bytes, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        """Token counts of whole texts; None counts as empty."""
        counts = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self._added and any(a in t for a in self.added):
                own = self._added.split(t)
                counts[i] += len(own) - 1
                own = [p for p in own if p]
            else:
                own = [t]
            parts += own
            owner += [i] * len(own)
        if parts:
            np.add.at(counts, owner, self._parts(parts))
        return counts.tolist()

    def _parts(self, parts: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        joined = "\n".join(parts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.splitter.classes[codes]
        classes[ends] = END
        starts = self.splitter.starts(classes)
        which = np.searchsorted(ends, starts)
        # the pre-tokens tile the texts' bytes: they are one Arrow array over them
        sizes = 1 + (codes > 0x7F) + (codes > 0x7FF).view(np.uint8) + (codes > 0xFFFF)
        sizes[ends] = 0
        at = np.cumsum(sizes, dtype=np.int64) - sizes
        raw = "".join(parts).encode()
        offsets = np.append(at[starts], len(raw))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        own = coded.dictionary.to_pylist()
        counts = list(map(self._pieces.get, own))
        new = [i for i, n in enumerate(counts) if n is None]
        if new:
            if len(self._pieces) > LIMIT:
                self._pieces.clear()
            fresh = [own[i] for i in new]
            for i, raw, n in zip(new, fresh, self.merger.count(fresh).tolist()):
                counts[i] = n
                if len(raw) <= WIDTH:
                    self._pieces[raw] = n
        return np.bincount(which, weights=np.array(counts, np.int64)[coded.indices.to_numpy()], minlength=len(parts)).astype(np.int64)


#: Counters of a Python worker by vocabulary file, so that its tasks compile transitions once.
_COUNTERS: dict[tuple[str, int], TokenCounter] = {}


def _counter(path: str, packed: bytes) -> TokenCounter:
    key = path, zlib.crc32(packed)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(path, np.frombuffer(zlib.decompress(packed), np.uint8))
    return _COUNTERS[key]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text, and whether they exceed ``limit``.

    One row a document; null and empty texts have no bytes and no tokens.
    Repeated rows repeat their result; columns beside id and text are ignored.
    """

    from tokenizers import Tokenizer

    # compiled once: 1.1 million classes, a few kilobytes when packed
    packed = zlib.compress(class_table(Tokenizer.from_file(path).pre_tokenizer).tobytes())

    def make():
        counter = _counter(path, packed)

        def apply(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            counts = counter.count(texts)
            return {
                "doc_id": batch.column(0),
                "n_bytes": pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64()),
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

        return apply

    picked = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    return map_texts(docs, picked, "text", "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
