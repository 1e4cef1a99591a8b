"""Near-duplicate lines by a segment-partition edit join.

Two different lines of at least MIN_LENGTH characters are linked when their
edit distance is at most DISTANCE; of shorter lines only equal ones are the same,
since two edits make another word of them.  A line is split into DISTANCE + 1
segments; within that distance one segment of the shorter line must occur
unchanged in the longer one, at a position that the lengths and the segment's rank
bound.  Segments are the index, the bounded substrings of equal or longer lines the
probes; both are joined on a hash of (length, segment number, substring).  Candidates must agree
in what lines within the distance have in common, nearly equal lengths and parities of
characters and of pairs of characters, before they are rows at all, and are then verified
with a banded bit-parallel automaton.

Equal lines are collapsed before the join, so copies never meet in pairs, and
variants of one line are first joined to the line that meets most others, the key's
pivot, so they need not meet each other.  A key under which many lines remain apart
is not joined in pairs: its lines get keys from where they differ from the pivot
(:func:`divergence_keys`), which only lines that are nearly equal share, and are
joined by these, up to ROUNDS times.

Of a class of linked lines the first by (doc_id, line number) is kept; the others are
dropped from their documents.  Lines of white space alone always stay.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, map_texts, shared
from tracemill.llm.graph import components, small

DISTANCE = 2
MIN_LENGTH = 32  # characters from which lines may differ by edits
#: Lines of other components that a line meets on average under a key that is still joined in pairs.
FEW = 24
ROUNDS = 3
#: Characters between two divergences up to which all deletions are made.
MIDDLE = 8
#: Lines of which a task remembers that it has met them.
MET = 1 << 20
#: A line with anything but white space.
INK = r"[^ \t\x0B\f\r]"

KEYS = "key long, h long, indexed boolean, size long"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def segments(length: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(start, size) of distance + 1 nearly equal segments; the longer ones last."""
    size, longer = divmod(length, distance + 1)
    sizes = [size + (i >= distance + 1 - longer) for i in range(distance + 1)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def probe_windows(length: int, shorter: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(segment number, start, size) of the substrings of a line of ``length`` that can
    equal a segment of a line of ``shorter``.

    If the first segment that is unchanged is number i, at most i edits stand
    before it and at most distance - i behind, which bounds its shift from both
    ends.
    """
    gap, out = length - shorter, []
    for i, (start, size) in enumerate(segments(shorter, distance)):
        low = max(0, start - i, start + gap - (distance - i))
        high = min(length - size, start + i, start + gap + (distance - i))
        out += [(i, at, size) for at in range(low, high + 1)]
    return out


def within(a: str, b: str, distance: int = DISTANCE) -> bool:
    """Whether the edit distance is at most ``distance``.

    A band of 2 * distance + 1 diagonals is held as one small integer for each
    number of errors; a step shifts the pattern's match bits into the band.
    """
    if abs(len(a) - len(b)) > distance:
        return False
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    match: dict[str, int] = {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << i
    band = (1 << 2 * distance + 1) - 1
    # bit k of a state is pattern prefix i = j - distance + k for text prefix j
    rows = [((1 << e + 1) - 1) << distance & band for e in range(distance + 1)]
    offset = distance
    for j, c in enumerate(b):
        bits = match.get(c, 0)
        shift = j - offset
        fit = (bits >> shift if shift >= 0 else bits << -shift) & band
        before, new = None, []
        for e, old in enumerate(rows):
            state = old & fit
            if e:
                # one more error: replaced, inserted in the text, left out of it
                state |= rows[e - 1] | rows[e - 1] >> 1
                state |= before << 1
            state &= band
            # prefixes outside the pattern do not exist
            low = distance - (j + 1)
            if low > 0:
                state &= ~((1 << low) - 1)
            new.append(state)
            before = state
        rows = new
        if not any(rows):
            return False
    at = len(a) - len(b) + distance
    return any(r >> at & 1 for r in rows)


def signatures(lines: list[str], ids: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, index?) for the probes of each line; its own segments are probes that are indexed too."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(lengths)])
    power = np.full(len(codes) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(len(codes) + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    code = (codes + np.uint64(1)) * _MIX
    code ^= code >> np.uint64(32)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:-1], dtype=np.uint64)])
    keys, owners, indexed = [], [], []
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        own = set(enumerate(segments(int(length), distance)))
        wanted = []
        for shorter in range(max(MIN_LENGTH, int(length) - distance), int(length) + 1):
            wanted += [(shorter, i, a, n, shorter == length and (i, (a, n)) in own) for i, a, n in probe_windows(int(length), shorter, distance)]
        spec = np.array([w[:4] for w in wanted], np.int64)
        left = start[rows][:, None] + spec[:, 2]
        value = (total[left + spec[:, 3]] - total[left]) * inverse[left]
        salt = (spec[:, 0] * 16 + spec[:, 1]).astype(np.uint64) * _MIX
        value = (value ^ value >> np.uint64(29) ^ salt) * _BASE
        keys.append((value ^ value >> np.uint64(32)).ravel())
        owners.append(np.repeat(ids[rows], len(wanted)))
        indexed.append(np.tile(np.array([w[4] for w in wanted]), len(rows)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(indexed)


def parities(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, none empty, which of 64 cells have an odd number of its characters, and of its pairs of neighbours.

    An edit moves at most two characters and four pairs into or out of a line, so lines
    within a distance differ in at most twice, and four times, as many cells.
    """
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    begins = np.cumsum(lengths) - lengths
    pairs = codes * _BASE
    pairs[1:] += codes[:-1]
    one, two = (np.uint64(1) << (x * _MIX >> np.uint64(58)) for x in (codes, pairs))
    two[begins] = 0
    return tuple(np.bitwise_xor.reduceat(x, begins).view(np.int64) if len(begins) else np.empty(0, np.int64) for x in (one, two))


def may_be_within(a: str, b: str, distance: int) -> Column:
    """Whether the lengths and parities in the structs of those names allow the distance; true for all lines within it."""
    apart = lambda c: F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return (F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) <= distance) & (apart("one") <= 2 * distance) & (apart("two") <= 4 * distance)


def common_prefix(a: str, b: str, at: int = 0) -> int:
    """Length of the longest common prefix, known to be at least ``at``."""
    n = min(len(a), len(b))
    while at < n and a[at : at + 32] == b[at : at + 32]:
        at += 32
    at = min(at, n)
    while at < n and a[at] == b[at]:
        at += 1
    return at


def toward(x: str, pivot: str) -> set[str]:
    """``x`` after each edit at the first place where it differs from the pivot that lets it follow the pivot."""
    at = common_prefix(x, pivot)
    out = set()
    if at < len(x):
        out.add(x[:at] + x[at + 1 :])
    if at < len(pivot):
        out.add(x[:at] + pivot[at] + x[at:])
        if at < len(x):
            out.add(x[:at] + pivot[at] + x[at + 1 :])
    return out


def divergence_keys(x: str, pivot: str, distance: int = DISTANCE) -> set:
    """Keys of which two lines within the distance share one, unless both are within it of the pivot.

    Let x and y agree with the pivot up to a(x), a(y) from the left and up to
    b(x), b(y) from the right.  If a(x) < a(y), the first edit between x and y
    stands at a(x), where y goes on as the pivot does: one of the three edits of
    x toward the pivot there brings it one edit nearer to y.  The same holds
    for y, and from the right.  After at most ``distance`` such edits of x and y,
    what is left of the distance lies between them with a and b equal, and then
    it lies in the middles.  Middles within e edits share a string from which e
    characters at most were left out; long ones share a segment.
    """
    back = pivot[::-1]
    level, seen, out = {x}, {x}, set()
    for made in range(distance + 1):
        left = distance - made
        for v in level:
            if v == pivot:
                continue  # x is within the distance of the pivot
            a, b = common_prefix(v, pivot), common_prefix(v[::-1], back)
            middle = v[a : max(a, len(v) - b)]
            if len(middle) <= MIDDLE + distance:
                short = {middle}
                for _ in range(left + 1):
                    out.update((a, b, m) for m in short)
                    short = {m[:i] + m[i + 1 :] for m in short for i in range(len(m))}
            if len(middle) >= MIDDLE - 1:
                for e in range(left + 1):
                    for shorter in range(max(e + 1, len(middle) - e), len(middle) + 1):
                        out.update((a, b, e, shorter, i, middle[at : at + n]) for i, at, n in probe_windows(len(middle), shorter, e))
        if left:
            level = {w for v in level for w in (*toward(v, pivot), *(u[::-1] for u in toward(v[::-1], back)))} - seen
            seen |= level
    return out


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line, h of every line; lines are divided by newlines alone."""
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).where("text is not null")
    lines = own.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("h", F.xxhash64("line"))


def line_links(lines: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) hashes, a < b, of lines that connect all lines within the distance; needs columns h and line.

    Every link joins lines within the distance; a link between lines that others already join may be left out.
    """

    def make():
        met: set[int] = set()

        def apply(batch: pa.RecordBatch) -> dict:
            if len(met) > MET:
                met.clear()
            ids, texts = [], []
            for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h not in met:
                    met.add(h)
                    ids.append(h)
                    texts.append(line)
            keys, owners, indexed = signatures(texts, np.array(ids, np.int64), distance)
            return {"key": keys, "h": owners, "indexed": indexed}

        return apply

    long = lines.where(F.length("line") >= MIN_LENGTH)
    scratch = Scratch(lines.sparkSession, "lines")
    rows = map_texts(long, ["h", "line"], "line", "key long, h long, indexed boolean", make, rows=1 << 14)
    # most keys belong to one line alone and end in one streamed pass
    dealt = rows.repartition("key").sortWithinPartitions("key")
    rows = scratch.table(dealt.mapInArrow(shared, KEYS), "keys")
    # the texts of the lines that share a key with another
    meets = _meets(rows, scratch, 0)
    texts = long.select("h", "line").join(small(meets.select("h")), "h", "left_semi")
    texts = scratch.table(_marked(texts.groupBy("h").agg(F.min("line").alias("line"))), "texts")
    return _joined(rows, meets, texts, None, distance, scratch, 0)


def _marked(texts: DataFrame) -> DataFrame:
    """(h, line) with the line's size and parities."""

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            lines = batch.column(1).to_pylist()
            one, two = parities(lines)
            return {"h": batch.column(0), "line": batch.column(1), "size": list(map(len, lines)), "one": one, "two": two}

        return apply

    return map_texts(texts, ["h", "line"], "line", "h long, line string, size int, one long, two long", make)


def _meets(rows: DataFrame, scratch: Scratch, step: int) -> DataFrame:
    """(h, meets): how many lines a line meets over all of its keys."""
    return scratch.table(rows.groupBy("h").agg(F.sum("size").alias("meets")), f"meets{step}")


def _joined(rows: DataFrame, meets: DataFrame, texts: DataFrame, links: DataFrame | None, distance: int, scratch: Scratch, step: int) -> DataFrame:
    """``links`` and those among lines that share a key: of (key, h, indexed), one of a pair is indexed.

    What is known of a line, a key or a component is joined to the rows behind a
    count, so that only pairs and sums are shuffled while these tables are small.
    """
    own = texts.select("h", F.struct("size", "one", "two").alias("m")).join(small(meets), "h")
    rows = scratch.table(rows.drop("size").join(small(own), "h"), f"marked{step}")
    most = rows.groupBy("key").agg(F.max(F.struct("meets", "h", "m")).alias("p"))
    # each key's line that meets most others, its pivot
    pivot = scratch.table(most.select("key", F.col("p.h").alias("p"), F.col("p.m").alias("mp")), f"pivots{step}")
    # linearly many pairs join the variants of a line
    star = rows.join(small(pivot), "key").where("h <> p").where(may_be_within("m", "mp", distance)).select(F.least("h", "p").alias("a"), F.greatest("h", "p").alias("b"))
    star = scratch.table(star.distinct(), f"star{step}")
    fresh = _verified(star, texts, distance, scratch, f"star-links{step}")
    links = fresh if links is None else links.union(fresh)
    # what is left: lines under one key that are not connected yet
    placed = _open(rows, links, scratch, step)
    few = placed.where("not crowded")
    probe = few.select("key", F.col("h").alias("p"), F.col("root").alias("rp"), F.col("indexed").alias("both"), F.col("m").alias("mp"))
    index = few.where("indexed").select("key", F.col("h").alias("i"), F.col("root").alias("ri"), F.col("m").alias("mi"))
    met = probe.join(index, "key").where("rp <> ri and (not both or p < i)").where(may_be_within("mp", "mi", distance)).select(F.least("p", "i").alias("a"), F.greatest("p", "i").alias("b")).distinct()
    pairs = scratch.table(met.join(star, ["a", "b"], "left_anti"), f"pairs{step}")
    if not pairs.isEmpty():
        links = links.union(_verified(pairs, texts, distance, scratch, f"links{step}"))
    crowds = placed.where("crowded")
    if not crowds.isEmpty():
        crowd = scratch.table(crowds.join(small(pivot), "key").select("h", "p").distinct(), f"crowd{step}")
        keys = scratch.table(_crowd_keys(crowd, texts, distance, scratch, step), f"crowd-keys{step}")
        links = _joined(keys, _meets(keys, scratch, step + 1), texts, links, distance, scratch, step + 1)
    return links


def _open(rows: DataFrame, links: DataFrame, scratch: Scratch, step: int) -> DataFrame:
    """The rows of keys whose lines lie in several components, with their ``root``; crowded: under that key they are not joined in pairs.

    Under a crowded key a line would meet more than FEW lines of other components on average.
    A few components may have many lines each, so it is lines that count and not components.
    """
    roots = scratch.table(components(rows.sparkSession, links), f"roots{step}")
    placed = rows.join(small(roots), "h", "left").withColumn("root", F.coalesce("root", "h"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    sizes = sizes.agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).where("roots > 1")
    crowded = F.lit(step < ROUNDS) & (F.col("n") * F.col("n") - F.col("own") > FEW * F.col("n"))
    keys = scratch.table(sizes.select("key", crowded.alias("crowded")), f"open-keys{step}")
    return scratch.table(placed.join(small(keys), "key"), f"open{step}")


def _crowd_keys(crowd: DataFrame, texts: DataFrame, distance: int, scratch: Scratch, step: int) -> DataFrame:
    """(key, h, indexed, size) from where lines h differ from the pivot p that all of their keys then have in common."""
    spark = crowd.sparkSession
    first = scratch.table(crowd.groupBy("h").agg(F.min("p").alias("a")), f"crowd-first{step}")
    joined = components(spark, crowd.join(small(first), "h").select("a", F.col("p").alias("b")))  # pivots of one line
    joined = scratch.table(joined.select(F.col("h").alias("p"), "root"), f"crowd-roots{step}")
    named = crowd.join(small(joined), "p", "left").withColumn("root", F.coalesce("root", "p"))
    most = named.groupBy("root", "p").count().groupBy("root").agg(F.max_by("p", F.struct("count", "p")).alias("p"))
    most = scratch.table(most, f"crowd-pivots{step}")
    # the pivots of a line are of one component
    own = first.join(small(joined.withColumnRenamed("p", "a")), "a", "left").select("h", F.coalesce("root", "a").alias("root"))
    own = scratch.table(own.join(small(most), "root").where("h <> p").select("h", "p"), f"crowd-own{step}")
    both = texts.select("h", F.col("line").alias("x")).join(small(own), "h")
    both = both.join(texts.select(F.col("h").alias("p"), F.col("line").alias("y")).join(small(most.select("p")), "p", "left_semi"), "p")

    def make():
        from xxhash import xxh3_64_intdigest

        def apply(batch: pa.RecordBatch) -> dict:
            keys, owners = [], []
            for h, p, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                found = {xxh3_64_intdigest(repr((p, k)).encode("utf-8", "surrogatepass")) for k in divergence_keys(x, y, distance)}
                keys += found
                owners += [h] * len(found)
            return {"key": np.array(keys, np.uint64).view(np.int64), "h": owners, "indexed": [True] * len(keys)}

        return apply

    rows = map_texts(both, ["h", "p", "x", "y"], "x", "key long, h long, indexed boolean", make)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(shared, KEYS)


def _verified(pairs: DataFrame, texts: DataFrame, distance: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs of line hashes whose lines are within the distance."""
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")

    def verify():
        def apply(batch: pa.RecordBatch) -> dict:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if within(x[i], y[i], distance)]
            return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

        return apply

    return scratch.table(map_texts(both.where(F.abs(F.length("x") - F.length("y")) <= distance), ["a", "b", "x", "y"], "x", "a long, b long", verify), name)


def duplicate_lines(docs: DataFrame, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, class_doc, class_line of every line that repeats an earlier one.

    (class_doc, class_line) is where the class first occurs.  Null texts have no
    lines; lines of rows with a null doc_id are neither kept first nor dropped.
    Lines of white space alone are not compared.  Of rows that repeat a doc_id,
    lines with equal text and number are one line.  An empty table gives no rows;
    columns beside the id and the text are ignored, whatever their names.
    Lines are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "duplicates")
    lines = line_table(docs, doc_id, text).where(F.col("doc_id").isNotNull() & F.col("line").rlike(INK))
    links = line_links(lines, distance)
    # two steps, so that a line's copies are first counted by document
    lines = scratch.table(lines.select("doc_id", "line_no", "h"), "lines")  # the texts are done with
    own = lines.groupBy("h", "doc_id").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    firsts = own.groupBy("h").agg(F.min("doc_id").alias("doc"), F.min_by("line_no", "doc_id").alias("no"), F.sum("n").alias("n"))
    firsts = scratch.table(firsts, "firsts")
    classes = components(spark, links)  # h, root
    linked = scratch.table(classes.join(firsts, "h").withColumn("first", F.struct("doc", "no")), "linked")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    moved = linked.join(heads, "root").select("h", F.col("head.doc").alias("class_doc"), F.col("head.no").alias("class_line"))
    repeated = firsts.where("n > 1").join(linked.select("h"), "h", "left_anti").select("h", F.col("doc").alias("class_doc"), F.col("no").alias("class_line"))
    heads = scratch.table(repeated.union(moved), "heads")
    found = lines.join(small(heads), "h").where("doc_id <> class_doc or line_no <> class_line")
    return found.select("doc_id", "line_no", "class_doc", "class_line")


def dedup_report(docs: DataFrame, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: lines, lines dropped, and which.

    doc_id, n_lines, n_dropped, dropped ARRAY<INT>.  A null text has no lines,
    an empty one a single empty line that stays.  Rows that repeat a doc_id form
    one document whose equal line numbers are dropped together.  An empty table
    gives no rows; columns beside the id and the text are ignored.
    """
    dropped = duplicate_lines(docs, distance, doc_id, text).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))
    n = F.coalesce(F.size(F.split(docs[text], "\n", -1)), F.lit(0))
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), n.alias("n_lines"))
    none = F.array().cast("array<int>")
    joined = own.join(dropped, "doc_id", "left").withColumn("dropped", F.coalesce("dropped", none))
    return joined.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.size("dropped").alias("n_dropped"), "dropped")


def drop_lines(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines of ``dropped`` (doc_id, line_no) taken out of the text.

    All other columns stay, whatever their names.  A document whose every line is
    dropped keeps an empty text, a null text stays null.  Rows that repeat a doc_id
    lose the same line numbers.
    """
    key, cut = (f"{name}_{uuid4().hex}" for name in ("id", "cut"))  # docs may have any columns
    gone = dropped.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(cut))
    joined = docs.join(gone, docs[doc_id] == gone[key], "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col(cut), i)), "\n")
    return joined.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept)).drop(key, cut)
