"""Exact Jaccard join of shingle sets in metric space.

Jaccard distance 1 - |A & B| / |A | B| is a metric.  Documents with equal sets
are one point.  The join is exact:

1. *Blocks.*  In one global order of shingles (frequent ones last) two sets
   within the distance share a shingle among the first n - ceil(s * n) + 1 of
   each.  Only points that meet in such a block are compared at all; most
   shingles have one point and end here.
   The positions of the shared shingle bound the overlap that can follow it.
2. *Star.*  The point of a block that meets most others is its pivot: of a
   document and its edited copies, the document.  Distances to the pivot join
   the copies, however many, in a linear number of pairs.
3. *Regions.*  Blocks whose points still lie in several components are regions.
   A large region takes pivots that lie apart, which divide it into Voronoi cells
   of at most a radius r and what is farther from all of them.  A point also goes
   to every cell whose pivot is at most 2t farther than its nearest, a far one to
   every cell whose pivot is within r + t: by the triangle inequality no partner
   within t has its cell elsewhere.  Cells and the far rest are regions again.  Distances here are those of the sketches, sets counted in
   a fixed number of cells: a weighted Jaccard distance that never exceeds the
   true one, so windows taken from it lose nothing.
4. *Leaves.*  A small region, or one that its pivots do not divide, is cut into
   bands of sizes, of which only neighbours can be similar.  Pairs of different
   components pass bounds on sizes, positions and parities inside the join, then
   the sketch bound, and are verified on the sets.

The parity of a set says of each of PARITY cells whether it holds an odd number of
shingles; as many cells as differ, at least so many shingles stand in one set alone.

The global order puts a bounded list of frequent shingles last.  The list only
decides how much work is done; any order gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd, log
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, _arrow_schema, map_texts, slices
from tracemill.llm.graph import components, small
from tracemill.llm.shingles import CELLS, PARITY, counted_sets, parities, shingle_sets, sketches

WIDTH, SIMILARITY = 5, 80  # words of a shingle; percent
FREQUENT = 65_536  # shingles in the list of frequent ones
FREQUENT_CHUNK = 2_000_000  # shingles counted together
FREQUENT_LEAST = 3  # of a chunk's sets that must have a shingle
LOT = 1 << 20  # prefix shingles that a task sends together
PART = 1 << 18  # prefix shingles of a part, about
NEIGHBOURS = 8  # points of a shingle up to which, less one, each is compared with each for company
TOGETHER = 256  # points verified in one go against one other, about
PIVOTS = 8
LEAF = 64
LEVELS = 8
PARITIES = [f"p{i}" for i in range(PARITY // 64)]
PARITY_COLUMNS = ", ".join(f"{p} long" for p in PARITIES)


def _ids(sets: list[np.ndarray]) -> np.ndarray:
    """A point's id: a hash of its set."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)


class Join:
    """One run over a table of documents with columns doc_id and text; further ones are kept."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.kept = [c for c in docs.columns if c not in ("doc_id", "text")]
        self.docs, self.width = docs.withColumn("key", F.xxhash64("text")), width
        self.num, self.den = percent // gcd(percent, 100), 100 // gcd(percent, 100)
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")

    def similar(self, small_side: Column, large_side: Column) -> Column:
        """small / large reaches the similarity, in whole numbers."""
        return small_side * self.den >= large_side * self.num

    def may_follow(self, na: str, pa_: str, nb: str, pb: str) -> Column:
        """What stands from the shared shingle on can make up the overlap that two sizes need.

        It holds at the first shingle that a similar pair shares, where every such pair meets.
        """
        rest = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
        return rest * (self.den + self.num) >= (F.col(na) + F.col(nb)) * self.num

    # -------------------------------------------------------------- points

    def points(self) -> tuple[DataFrame, np.ndarray]:
        """doc_id, key, n, words, id (null without words), sketch, parities and kept columns of every row; frequent shingles by rising frequency.

        Both come of one pass over the texts: shingles that several of a chunk's sets
        have are counted in rows of their own.  Of all sets at most FREQUENT are returned.
        """
        width, kept = self.width, self.kept
        own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.docs.schema if f.name in ("doc_id", "key", *kept))
        schema = f"{own}, n long, words long, id long, sketch binary, {PARITY_COLUMNS}, often binary"
        target = _arrow_schema(self.spark, schema)

        def run(batches):
            held, size, seen = [], 0, set()

            def counted():
                values = np.sort(np.concatenate(held))
                last = values[FREQUENT_LEAST - 1 :]
                often = np.flatnonzero(last == values[: len(last)])  # runs of equal ones begin there
                kept = np.zeros(len(values), bool)
                for d in range(FREQUENT_LEAST):
                    kept[often + d] = True
                values, counts = np.unique(values[kept], return_counts=True)
                packed = np.concatenate([values, counts.astype(np.uint64)]).tobytes()
                return pa.RecordBatch.from_arrays([pa.array([packed if f.name == "often" else None], f.type) for f in target], schema=target)

            for batch in batches:
                for part in slices(batch, "text"):
                    sets, words = counted_sets(part.column(part.schema.get_field_index("text")).to_pylist(), width)
                    n, ids = np.array([len(s) for s in sets], np.int64), _ids(sets)
                    odd = parities(sets)
                    out = {c: part.column(part.schema.get_field_index(c)) for c in ("doc_id", "key", *kept)}
                    out |= {"n": n, "words": words, "id": pa.array(ids, mask=n == 0), "sketch": sketches(sets), "often": [None] * len(sets)}
                    out |= {name: odd[:, i] for i, name in enumerate(PARITIES)}
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
                    for key, s in zip(ids.tolist(), sets):
                        if key not in seen:
                            seen.add(key)
                            held.append(s)
                            size += len(s)
                    if size >= FREQUENT_CHUNK:
                        yield counted()
                        held, size = [], 0
            if held:
                yield counted()

        def unpacked(batches):
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    values, counts = np.frombuffer(packed, np.int64).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["g", "c"])

        found = self.scratch.table(self.docs.mapInArrow(run, schema), "points")
        rows = found.where("often is not null").select("often").mapInArrow(unpacked, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
        top = rows.orderBy(F.desc("c"), "g").limit(FREQUENT).collect()
        return found.where("often is null").drop("often"), np.array([r.g for r in reversed(top)], np.int64).view(np.uint64)

    # -------------------------------------------------------------- blocks

    def blocks(self, frequent: np.ndarray, entries: int) -> DataFrame:
        """(g, id, n, pos, size) of the points that share a prefix shingle with another point that sizes and positions allow.

        size is the number of the shingle's points, null for frequent ones, of which there are FREQUENT at most.
        ``entries`` is the number of prefix shingles of all rows.  A task sends them in
        one row a part of the shingles and lot, as arrays; a part is worked on alone.
        """
        sorted_frequent, rank = np.sort(frequent), np.argsort(frequent)
        marks = np.zeros(1 << 20, bool)  # of the frequent ones, by their last bits
        marks[(frequent & np.uint64(len(marks) - 1)).astype(np.int64)] = True
        shared = self.spark.sparkContext.broadcast((sorted_frequent, rank, marks))  # FREQUENT entries at most
        width, num, den = self.width, self.num, self.den
        parts = max(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // PART))

        def run(batches):
            known, place, marks = shared.value
            last = np.uint64(len(marks) - 1)
            seen: set[int] = set()
            held, size = [], 0
            for batch in batches:
                for part in slices(batch, "text"):
                    sets = shingle_sets(part.column(0).to_pylist(), width)
                    for key, s in zip(_ids(sets).tolist(), sets):
                        if not len(s) or key in seen:
                            continue
                        seen.add(key)
                        prefix = len(s) - -(-num * len(s) // den) + 1
                        rare, g = prefix, s[:prefix]
                        may = np.flatnonzero(marks[(s & last).astype(np.int64)])
                        if len(may):
                            at = np.minimum(np.searchsorted(known, s[may]), len(known) - 1)
                            same = known[at] == s[may]
                            hit, at = may[same], at[same]
                            g = np.delete(s, hit)[:prefix]
                            rare = len(g)
                            g = np.concatenate([g, s[hit[np.argsort(place[at], kind="stable")][: prefix - rare]]])
                        held.append((g, key, len(s), rare))
                        size += prefix
                    if size >= LOT:
                        yield _sent(held, parts)
                        held, size = [], 0
            if held:
                yield _sent(held, parts)

        def met(batches):
            for rows in _of_one_part(batches):
                found = _met(rows, num, den)
                if found.num_rows:
                    yield found

        sent = self.docs.select("text").mapInArrow(run, "part int, often boolean, low binary, high binary, top binary, id binary, n binary, pos binary")
        dealt = sent.repartition("part").sortWithinPartitions("part")
        return self.scratch.table(dealt.mapInArrow(met, "g long, id long, n int, pos int, size long"), "blocks")

    def chosen(self, points: DataFrame, blocks: DataFrame) -> DataFrame:
        """id, doc_id and key of one of its documents, sketch and parities of every point in a block."""
        met = points.where("id is not null").join(blocks.select("id").distinct(), "id", "left_semi")
        one = met.groupBy("id").agg(F.min(F.struct("doc_id", "key", "sketch", *PARITIES)).alias("one"))
        return self.scratch.table(one.select("id", "one.*"), "chosen")

    # --------------------------------------------------------- verification

    def verified(self, pairs: DataFrame, points: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
        """(a, b) of the pairs that reach the similarity: sketch bound first, then the sets.

        Sets are made again from the texts of the points that pass the bound; a
        text is smaller than its set.  The texts of all b of one a meet that of a;
        where these are many, they do in several parts.
        """
        num, den, width = self.num, self.den, self.width
        side = lambda df, x, c, to: df.select(F.col("id").alias(x), F.col(c).alias(to))

        def bound():
            def apply(batch: pa.RecordBatch) -> dict:
                mask = pa.array(_bounds(batch.column(2), batch.column(3)) * den >= num - 1e-9)
                return {"a": batch.column(0).filter(mask), "b": batch.column(1).filter(mask)}

            return apply

        rows = pairs.join(side(chosen, "a", "sketch", "x"), "a").join(side(chosen, "b", "sketch", "y"), "b")
        near = self.scratch.table(map_texts(rows, ["a", "b", "x", "y"], "x", "a long, b long", bound), f"{name}-near")
        sizes = near.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
        others = near.join(sizes, "a").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
        hubs = others.select(F.col("hub").alias("id"), "hub", "part").distinct()
        uses = others.unionByName(hubs).groupBy("id").agg(F.collect_list(F.struct("hub", "part")).alias("uses"))
        needed = self.scratch.table(chosen.select("id", "doc_id", "key").join(uses, "id"), f"{name}-needed")
        same = lambda left: F.col("wanted.key").eqNullSafe(left["key"]) & F.col("wanted.doc_id").eqNullSafe(left["doc_id"])
        wanted = small(needed).alias("wanted")
        texts = self.docs.join(wanted, same(self.docs)).select("wanted.id", "wanted.uses", "text")
        once = small(needed.select("doc_id", "key")).alias("wanted")
        if points.join(once, same(points)).count() > needed.count():  # rows that repeat a doc_id and its text
            texts = texts.dropDuplicates(["id"])
        met = texts.select("id", F.explode("uses").alias("use"), "text").select("use.hub", "use.part", "id", "text")
        met = met.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))  # the hub first

        def exact(batches):
            known = base = None
            for batch in batches:
                for part in slices(batch, "text"):
                    a, b = [], []
                    for hub, i, s in zip(*(part.column(c).to_pylist() for c in (0, 2)), shingle_sets(part.column(3).to_pylist(), width)):
                        if i == hub:
                            known, base = hub, s
                            continue
                        if hub != known:
                            raise ValueError(f"no text of the point {hub}")
                        both = len(np.intersect1d(base, s, assume_unique=True))
                        if both * den >= num * (len(base) + len(s) - both):
                            a.append(hub)
                            b.append(i)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return self.scratch.table(met.mapInArrow(exact, "a long, b long"), name)

    # ------------------------------------------------------------- regions

    def regions(self, rows: DataFrame, chosen: DataFrame) -> DataFrame:
        """Divide (region, id, n, pos, root) until regions are leaves; adds d, the distance to the last pivot."""
        reach = 1 - self.num / self.den + 1e-9
        window = radius = 2 * reach
        leaves, schema = [], "region long, id long, n int, pos int, root long, d double"
        sketches = chosen.select("id", "sketch")
        rows = rows.withColumn("d", F.lit(None).cast("double"))
        for level in range(LEVELS):
            sizes = rows.groupBy("region").agg(F.count("*").alias("size"))
            large = self.scratch.table(sizes.where(F.col("size") > LEAF), f"large{level}")
            if large.isEmpty():
                break
            order = Window.partitionBy("region").orderBy(F.xxhash64("id", F.lit(level)), "id")
            large_rows = rows.drop("d").join(small(large.select("region")), "region", "left_semi").join(sketches, "id")
            pivots = large_rows.select("region", "id", "sketch").withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * PIVOTS)
            pivots = pivots.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("k", "sketch"))).alias("pivots"))

            def cells():
                chosen_of: dict[int, list[bytes]] = {}

                def apply(batch: pa.RecordBatch) -> dict:
                    owner, number, distance = [], [], []
                    rows_of: dict[int, list[int]] = {}
                    for i, region in enumerate(batch.column(0).to_pylist()):
                        rows_of.setdefault(region, []).append(i)
                    for region, rows in rows_of.items():
                        if region not in chosen_of:
                            if len(chosen_of) > 4096:
                                chosen_of.clear()
                            chosen_of[region] = _apart([p["sketch"] for p in batch.column(6)[rows[0]].as_py()], window)
                        own = batch.column(5).take(pa.array(rows)).to_pylist()
                        own = [x for x in own for _ in chosen_of[region]]
                        table = 1 - _bounds(pa.array(own, pa.binary()), pa.array(chosen_of[region] * len(rows), pa.binary())).reshape(len(rows), -1)
                        for i, d in zip(rows, table):
                            far = d.min() > radius
                            for k in np.flatnonzero(d <= (radius + reach if far else d.min() + window)):
                                owner.append(i)
                                number.append(int(k))
                                distance.append(float(d[k]))
                            if far:
                                owner.append(i)
                                number.append(-1)
                                distance.append(None)
                    part = batch.take(pa.array(owner, pa.int64()))
                    return {"region": part.column(0), "id": part.column(1), "n": part.column(2), "pos": part.column(3), "root": part.column(4), "d": distance, "cell": number}

                return apply

            dealt = map_texts(large_rows.join(pivots, "region"), ["region", "id", "n", "pos", "root", "sketch", "pivots"], "sketch", f"{schema}, cell int", cells)
            dealt = self.scratch.table(dealt, f"cells{level}")
            sizes = dealt.groupBy("region", "cell").agg(F.count("*").alias("n")).groupBy("region").agg(F.sum("n").alias("made"), F.max("n").alias("most"))
            shrunk = sizes.join(large, "region").where((F.col("made") <= 1.5 * F.col("size")) & (F.col("most") < F.col("size"))).select("region")
            shrunk = self.scratch.table(shrunk, f"shrunk{level}")
            leaves.append(rows.join(small(shrunk), "region", "left_anti"))
            rows = dealt.join(small(shrunk), "region", "left_semi").withColumn("region", F.xxhash64("region", "cell")).drop("cell")
        leaves.append(rows)
        out = leaves[0]
        for part in leaves[1:]:
            out = out.unionByName(part)
        return out

    def leaf_pairs(self, rows: DataFrame, chosen: DataFrame) -> DataFrame:
        """Pairs of one region in different components that sizes, positions, distances to the pivot and parities allow.

        A region is cut into bands in each of which the largest size is at most
        the smallest over the similarity: partners lie in one band or in the next.
        """
        near = 1 - self.num / self.den + 1e-9
        kept = ["region", "id", "n", "pos", "root", "d", *PARITIES]
        band = F.floor(F.log(F.col("n").cast("double")) / (log(self.den / self.num) + 1e-9)).cast("int") if self.num < self.den else F.col("n")
        rows = rows.join(chosen.select("id", *PARITIES), "id").select(*kept, band.alias("band"))
        a = rows.select("region", "band", *[F.col(c).alias(f"a_{c}") for c in kept[1:]])
        b = rows.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
        b = b.select("region", "band", "own", *[F.col(c).alias(f"b_{c}") for c in kept[1:]])
        met = a.join(b, ["region", "band"]).where(F.col("a_root") != F.col("b_root")).where((F.col("a_id") < F.col("b_id")) | (F.col("own") != F.col("band")))
        met = met.where(self.similar(F.least("a_n", "b_n"), F.greatest("a_n", "b_n"))).where(self.may_follow("a_n", "a_pos", "b_n", "b_pos"))
        apart = sum(F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES)
        met = met.where(apart * (self.den + self.num) <= (F.col("a_n") + F.col("b_n")) * (self.den - self.num))
        met = met.where(F.coalesce(F.abs(F.col("a_d") - F.col("b_d")) <= near, F.lit(True)))
        return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()

    # ----------------------------------------------------------------- run

    def run(self) -> DataFrame:
        """doc_id, n_shingles, words, id, root and kept columns of every row; id and root are null without words."""
        points, frequent = self.points()
        prefixes = points.where("n > 0").agg(F.sum(F.col("n") - F.ceil(F.col("n") * self.num / self.den) + 1)).first()[0]
        blocks = self.blocks(frequent, int(prefixes or 0))
        chosen = self.chosen(points, blocks)
        # how many others a point meets, over all its blocks
        often = F.broadcast(blocks.where("size is null").groupBy("g").agg(F.count("*").alias("points")))
        meets = blocks.join(often, "g", "left").groupBy("id").agg(F.sum(F.coalesce("size", "points")).alias("meets"))
        blocks = blocks.drop("size")
        ranked = self.scratch.table(blocks.join(meets, "id"), "ranked")
        pivot = ranked.groupBy("g").agg(F.max(F.struct("meets", "id", "n")).alias("p"))
        star = ranked.join(pivot, "g").where("id <> p.id").where(self.similar(F.least("n", F.col("p.n")), F.greatest("n", F.col("p.n"))))
        # of two points always the same one is the pivot
        star = self.scratch.table(star.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct(), "star")
        links = self.verified(star, points, chosen, "star-links")
        roots = self.scratch.table(components(self.spark, links), "roots")
        placed = blocks.join(roots.withColumnRenamed("h", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        # of blocks with the same points the first in the order of shingles has all pairs whose first shared shingle is among theirs
        points_of = F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.min_by("pos", "id").alias("first")
        open_blocks = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *points_of).where("lo < hi")
        open_blocks = open_blocks.groupBy("x", "y").agg(F.min_by("g", "first").alias("g")).select("g")
        rows = placed.join(open_blocks, "g", "left_semi").select(F.col("g").alias("region"), "id", "n", "pos", "root")
        rows = self.scratch.table(rows, "regions")
        tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = self.leaf_pairs(self.regions(rows, chosen), chosen).join(tried, ["a", "b"], "left_anti")
        more = self.verified(self.scratch.table(pairs, "pairs"), points, chosen, "links")
        roots = self.scratch.table(components(self.spark, links.union(more)), "all-roots")
        return points.join(roots.withColumnRenamed("h", "id"), "id", "left").select("doc_id", F.col("n").alias("n_shingles"), "words", "id", F.coalesce("root", "id").alias("root"), *self.kept)


def _sent(held: list[tuple[np.ndarray, int, int, int]], parts: int) -> pa.RecordBatch:
    """Rows of arrays, one a part, of points (prefix, id, size, number of prefix shingles that are not frequent).

    A shingle's part is its remainder, or where it is frequent, so that its points
    are dealt out, that of the id.  Of a shingle 40 bits and its remainder are kept
    here: two that agree in these only make candidates.
    """
    lengths = np.array([len(x[0]) for x in held])
    g = np.concatenate([x[0] for x in held])
    ids, n, rare = (np.repeat(np.array([x[i] for x in held], np.int64), lengths) for i in (1, 2, 3))
    pos = np.arange(len(g)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    often = pos >= rare
    rest = (g % np.uint64(parts)).astype(np.int64)
    g = g >> np.uint64(24)
    group = np.where(often, parts + (ids.view(np.uint64) % np.uint64(parts)).astype(np.int64), rest)
    order = np.argsort(group, kind="stable")
    group = group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    often = group[starts] >= parts
    rest = rest[order].astype(np.uint32)
    cut = np.r_[starts, len(group)]
    # the parts of frequent shingles stand last, and only they name the remainders
    first = cut[:-1][often].min(initial=len(group))

    def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
        values = np.ascontiguousarray(values)
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

    small_sizes = n.max() < 1 << 16
    g, n, pos = g[order], n[order], pos[order]
    kind = np.uint16 if small_sizes else np.uint32
    columns = [pa.array((group[starts] % parts).astype(np.int32)), pa.array(often)]
    columns += [packed(x, cut) for x in ((g & np.uint64(0xFFFFFFFF)).astype(np.uint32), (g >> np.uint64(32)).astype(np.uint8))]
    columns += [packed(rest[first:], np.maximum(cut - first, 0))]
    columns += [packed(x, cut) for x in (ids[order], n.astype(kind), pos.astype(kind))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "often", "low", "high", "top", "id", "n", "pos"])


def _of_one_part(batches) -> Iterator[pa.Table]:
    """Rows of arrays in order of their part, those of one part at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cut = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]).tolist() + [len(parts)]
        for start, stop in zip(cut, cut[1:]):
            if held and held[-1].column(0)[0].as_py() != int(parts[start]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _met(rows: pa.Table, num: int, den: int) -> pa.RecordBatch:
    """(g, id, n, pos, size) of one part's points: of frequent shingles all, of others those that a point with the same shingle may be similar to."""
    out = []
    for often in (False, True):
        own = rows.filter(pc.equal(rows.column(1), often))
        if not own.num_rows:
            continue
        low, high, top, ids = (np.frombuffer(b"".join(own.column(c).to_pylist()), kind) for c, kind in (("low", np.uint32), ("high", np.uint8), ("top", np.uint32), ("id", np.int64)))
        lists = [own.column(c).to_pylist() for c in ("high", "n", "pos")]
        n, pos = (np.concatenate([np.frombuffer(x, np.uint16 if len(x) == 2 * len(h) else np.uint32) for h, x in zip(lists[0], x)]).astype(np.int64) for x in lists[1:])
        part = top.astype(np.int64) if often else np.int64(own.column(0)[0].as_py())
        g = part << 40 | high.astype(np.int64) << 32 | low
        if not often:  # most shingles have one point and end here
            ordered = np.sort(g)
            several = ordered[1:][ordered[1:] == ordered[:-1]]
            at = np.minimum(np.searchsorted(several, g), max(0, len(several) - 1))
            kept = several[at] == g if len(several) else np.zeros(len(g), bool)
            g, ids, n, pos = g[kept], ids[kept], n[kept], pos[kept]
        order = np.lexsort((pos, ids, g))
        g, ids, n, pos = g[order], ids[order], n[order], pos[order]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])][: len(g)]
        g, ids, n, pos = g[fresh], ids[fresh], n[fresh], pos[fresh]
        if not often and len(g):
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.repeat(np.diff(np.r_[starts, len(g)]), np.diff(np.r_[starts, len(g)]))
            kept = size > NEIGHBOURS + 1
            for d in range(1, min(NEIGHBOURS, len(g) - 1) + 1):
                x, y = slice(None, -d), slice(d, None)
                may = (g[x] == g[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
                may &= np.minimum(n[x] - pos[x], n[y] - pos[y]) * (den + num) >= (n[x] + n[y]) * num
                kept[x] |= may
                kept[y] |= may
            g, ids, n, pos = g[kept], ids[kept], n[kept], pos[kept]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
        size = np.repeat(np.diff(np.r_[starts, len(g)]), np.diff(np.r_[starts, len(g)]))
        out.append((g, ids, n.astype(np.int32), pos.astype(np.int32), size, np.full(len(g), often)))
    *columns, often = (np.concatenate(c) for c in zip(*out))
    size = pa.array(columns.pop(), pa.int64(), mask=often)
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), size], names=["g", "id", "n", "pos", "size"])


def _bounds(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Upper bounds of the similarity from pairs of sketches; 1 where a sketch is missing."""
    sizes = np.minimum(pc.binary_length(x).to_numpy(zero_copy_only=False), pc.binary_length(y).to_numpy(zero_copy_only=False))
    full = sizes == 2 * CELLS
    out = np.ones(len(x))
    if full.any():
        mask = pa.array(full)
        p = np.frombuffer(b"".join(x.filter(mask).to_pylist()), np.uint16).reshape(-1, CELLS)
        q = np.frombuffer(b"".join(y.filter(mask).to_pylist()), np.uint16).reshape(-1, CELLS)
        out[full] = np.minimum(p, q).sum(axis=1, dtype=np.int64) / np.maximum(p, q).sum(axis=1, dtype=np.int64)
    return out


def _distances(x: bytes, pivots: list[bytes]) -> np.ndarray:
    return 1 - _bounds(pa.array([x] * len(pivots), pa.binary()), pa.array(pivots, pa.binary()))


def _apart(sketches: list[bytes], gap: float) -> list[bytes]:
    """At most PIVOTS of the sketches, in order, each more than ``gap`` from those before."""
    kept = sketches[:1]
    for x in sketches[1:]:
        if len(kept) < PIVOTS and _distances(x, kept).min() > gap:
            kept.append(x)
    return kept


def prepared(docs: DataFrame, doc_id: str, text: str, *kept: Column) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), *kept)


def near_clusters(docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, words (their number) and cluster of every row: rows that links connect have the same cluster.

    Rows without words have none.  Ids may repeat or be null; an empty table gives no rows.
    """
    found = Join(prepared(docs, doc_id, text, docs[source].cast("string").alias("source")), width, percent).run()
    return found.select("doc_id", "source", "words", F.col("root").alias("cluster"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of every row.

    Rows without words have no shingles and are linked with nothing: their
    component is themselves.  Rows with equal sets are linked, so repeated rows
    and rows that share a doc_id are returned as often as they occur.  A null
    doc_id is passed over as a component's name; a component of such rows alone
    is null.  Pairs at the very bound of the similarity are linked.  An empty table
    gives no rows; columns beside the id and the text are ignored.  Sets are sets of
    64-bit hashes of shingles, known by 64-bit hashes of their own.
    """
    found = Join(prepared(docs, doc_id, text), width, percent).run()
    heads = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("head"))
    joined = found.join(heads, "root", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all columns, of the least doc_id of each component.

    Rows with a null doc_id cannot be named as copies and stay, and so do rows
    without words.  Rows that repeat a doc_id and its text stay once; if their
    texts differ, all of them stay or go with their number.  An empty table gives
    no rows.  ``docs`` may have any further columns, whatever their names.
    """
    found = jaccard_components(docs.where(docs[doc_id].isNotNull()), width, percent, doc_id, text)
    name = f"head_{uuid4().hex}"  # docs may have any columns
    heads = found.where("component_id = doc_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(heads, docs[doc_id] == heads[name]).drop(name).dropDuplicates([doc_id, text])
    return kept.unionByName(docs.where(docs[doc_id].isNull()))
