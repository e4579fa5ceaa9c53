"""MinHash near-duplicates by an LSH forest.

A document's shingles give ``TREES`` paths of ``DEPTH`` MinHash values. Each tree is a sorted
order of the distinct sets by their path, dealt over tasks by range, and a set's candidates are
its neighbours in that order with a common prefix of ``LEAST_DEPTH`` values or more. Where up to
``NEIGHBOURS`` sets share a prefix all of them are candidates; where more do, those that share
a longer one, and the next in order. So the depth at which sets meet follows the density of the
region, and the number of candidates is in proportion to the sets, however many are alike.
Tasks hand the ends of their range to the next one.

Candidates are confirmed on the full sets in two steps: first the closest ones of every set,
then, of the others, those that lie in different components by then; links within a component
change nothing and are not looked up. Later links join components, not sets.

A region with more sets than neighbours, such as a thousand edits of one text, may hold sets
that are linked to one of them only, commonly the text itself. So every set of a dense region
that is not in the component which holds most of the region is confirmed against the centre of
that component, then against all its members that a link allows by the shingles they share
and by those in which they differ from the centre, then against its neighbours in a forest
without that component. That goes on while components
grow.

Exact copies are one set throughout. Sets are compared as hashes of 64 bits of all their
shingles, and known by 128 bits of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clash_free, cuts, few, per_batch, stored, texts
from .stars import components

#: Fixed by the contract: words to a shingle, and linked from this many hundredths of the union on.
SHINGLE_WORDS, LEAST_PERCENT = 3, 85
TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS = 16, 10, 3, 12
#: Neighbours on each side that a set meets on account of a prefix that more than ``NEIGHBOURS`` sets share.
DENSE_NEIGHBOURS = 2
#: Sets are linked if WHOLE times the shingles that one of them lacks are at most LOSS times the sum of their sizes.
WHOLE, LOSS = 100 + LEAST_PERCENT, 100 - LEAST_PERCENT
#: A shingle is common in a component if more than one in so many of its members have it.
COMMON = 8
#: Bytes of one MinHash value in a path; values are compared as bytes.
VALUE_BYTES = 3
#: Closest candidates of each set that are confirmed first.
FIRST = 3
SEED = 42
#: Shingles that meet all hash functions at once.
STRIP = 4096

_random = np.random.default_rng(SEED)
_MASKS = _random.integers(0, 1 << 64, TREES * DEPTH, dtype=np.uint64)[:, None]
_FACTORS = _random.integers(0, 1 << 64, TREES * DEPTH, dtype=np.uint64)[:, None] | np.uint64(1)


# sets and paths of one text


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising; empty without words."""
    words = (text or b"").lower().split()  # bytes.lower touches A-Z only; split is on ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE_WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(begins[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype=np.uint64, count=n))


def paths(hashes: np.ndarray) -> bytes:
    """The paths of a set through all trees, one after another."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), STRIP):
        np.minimum(least, ((hashes[None, i : i + STRIP] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    return least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :VALUE_BYTES].tobytes()


def _sketch_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingle_hashes(t) for t in texts(b.column(2))]
    columns = [
        b.column(0),
        b.column(1),
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
        pa.array([paths(s) if len(s) else None for s in sets], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "node", "paths"])


def _set_kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingle_hashes(t) for t in texts(b.column(0))]
    nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
    flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64))
    ends = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
    return pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(ends, flat)], names=["node", "shingles"])


def _documents(docs: DataFrame) -> DataFrame:
    return clash_free(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), "text")


# the forest


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that rows of two arrays of paths share from the start on."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


class _Window:
    """Pairs each row with those up to ``NEIGHBOURS`` before it, over batches of one sorted stream."""

    def __init__(self):
        self.held: tuple | None = None

    def meet(self, group: np.ndarray, path: np.ndarray, n: np.ndarray, node: np.ndarray) -> tuple[list, list]:
        """Candidates as (a, b, depth) arrays, and rows of dense regions as (index, depth) over what is now held."""
        old = 0
        if self.held is not None:
            old = len(self.held[0])
            group, path, n, node = (np.concatenate(x) for x in zip(self.held, (group, path, n, node), strict=True))
        pairs, deep, depths = [], np.zeros(len(group), dtype=np.int64), []
        for lag in range(1, min(NEIGHBOURS, len(group) - 1) + 1):
            depth = common_prefix(path[lag:], path[:-lag])
            depth[group[lag:] != group[:-lag]] = 0
            if depth.max() < LEAST_DEPTH:
                break
            depths.append((lag, depth))
        if len(depths) == NEIGHBOURS:
            at = np.flatnonzero(depths[-1][1] >= LEAST_DEPTH)
            for k in range(NEIGHBOURS + 1):
                np.maximum.at(deep, at + k, depths[-1][1][at])
        for lag, depth in depths:
            later = np.arange(len(depth)) + lag >= old  # held rows have met each other before
            # sets that share no more than many others do are left to the next of them and to the region's centre
            at = np.flatnonzero(later & (depth >= LEAST_DEPTH) & ((depth > deep[:-lag]) | (lag <= DENSE_NEIGHBOURS)))
            small, large = np.minimum(n[at], n[at + lag]), np.maximum(n[at], n[at + lag])
            at = at[100 * small >= LEAST_PERCENT * large]  # sizes further apart rule a link out
            pairs.append((node[at], node[at + lag], depth[at]))
        dense = np.flatnonzero(deep)
        found = (group[dense], path[dense], node[dense], deep[dense])
        self.held = tuple(x[-NEIGHBOURS:] for x in (group, path, n, node))
        return pairs, [found]


_FOUND = "kind string, a binary, b binary, tree int, depth int, path binary, side int, n bigint"


def _arrays(b: pa.RecordBatch, group: str) -> tuple[np.ndarray, ...]:
    path = np.frombuffer(b"".join(b.column("path").to_pylist()), dtype=np.uint8).reshape(-1, VALUE_BYTES)
    value = path.astype(np.uint32) @ np.array([1 << 8 * (VALUE_BYTES - 1 - k) for k in range(VALUE_BYTES)], dtype=np.uint32)
    return b.column(group).to_numpy(zero_copy_only=False), value.reshape(-1, DEPTH), b.column("n").to_numpy(zero_copy_only=False), np.array(b.column("node").to_pylist(), dtype=object)


def _rows(kind: str, k: int, **columns) -> pa.RecordBatch:
    types = {"a": pa.binary(), "b": pa.binary(), "tree": pa.int32(), "depth": pa.int32(), "path": pa.binary(), "side": pa.int32(), "n": pa.int64()}
    arrays = [pa.array([kind] * k, pa.string())] + [pa.array(columns[c], t) if c in columns else pa.nulls(k, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *types])


def _bytes_of(path: np.ndarray) -> list[bytes]:
    return [p.tobytes() for p in path.astype(">u4").view(np.uint8).reshape(len(path), DEPTH, 4)[:, :, 4 - VALUE_BYTES :]]


def _outcome(window: _Window, group: np.ndarray, path: np.ndarray, n: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs, dense = window.meet(group, path, n, node)
    for a, b, depth in pairs:
        if len(a):
            yield _rows("pair", len(a), a=list(map(min, a, b)), b=list(map(max, a, b)), depth=depth)
    for g, p, x, depth in dense:
        if len(x):
            yield _rows("dense", len(x), a=list(x), tree=g % TREES, depth=depth, path=_bytes_of(p))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates and dense rows within a task's range, and its first and last rows for the next."""
    window, part, head, tail = _Window(), TaskContext.get().partitionId(), [], []
    for b in cuts(batches):
        tree, path, n, node = _arrays(b, "tree")
        rows = list(zip(tree.tolist(), _bytes_of(path), n.tolist(), node, strict=True)) if len(tree) < 2 * NEIGHBOURS else None
        first, last = (rows, rows) if rows is not None else ([(tree[i], p, n[i], node[i]) for i, p in zip(ends, _bytes_of(path[ends]), strict=True)] for ends in (np.arange(NEIGHBOURS), np.arange(-NEIGHBOURS, 0)))
        head = head if len(head) >= NEIGHBOURS else [*head, *first][:NEIGHBOURS]
        tail = [*tail, *last][-NEIGHBOURS:]
        yield from _outcome(window, tree, path, n, node)
    for side, rows in ((part, head), (part + 1, tail)):
        if rows:
            tree, path, n, node = zip(*rows, strict=True)
            yield _rows("edge", len(rows), a=node, tree=tree, path=path, n=n, side=[side] * len(rows))


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates between the last rows of one range and the first of the next: a seam and tree is a group."""
    window = _Window()
    for b in cuts(batches):
        tree, path, n, node = _arrays(b, "tree")
        yield from _outcome(window, b.column("side").to_numpy(zero_copy_only=False).astype(np.int64) * TREES + tree, path, n, node)


def forest(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, closeness): candidate pairs of distinct sets; (node, tree, depth, path): sets in dense regions, with the depth to which they are dense."""
    start = F.col("tree") * (DEPTH * VALUE_BYTES) + 1
    trees = distinct.select("node", "n", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = trees.select("tree", F.substring("paths", start, F.lit(DEPTH * VALUE_BYTES)).alias("path"), "n", "node")
    # sets of one path lie in another order in each tree
    order = ["tree", "path", "mix", "node"]
    ordered = rows.withColumn("mix", F.hash("tree", "node")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ordered.mapInArrow(_neighbours, _FOUND), "forest")
    edges = found.where("kind = 'edge'").select("side", "tree", "path", "n", F.col("a").alias("node"), F.hash("tree", "a").alias("mix")).distinct()
    ranges = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seams = stored(few(edges.repartition("side"), 2 * NEIGHBOURS * ranges).sortWithinPartitions("side", *order).mapInArrow(_seams, _FOUND), "seams")
    both = found.union(seams)
    pairs = both.where("kind = 'pair' and a <> b").groupBy("a", "b").agg(F.sum("depth").alias("closeness"))
    dense = both.where("kind = 'dense'").groupBy(F.col("a").alias("node"), "tree", "path").agg(F.max("depth").alias("depth"))
    return pairs, dense


# confirming


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.select("a", "b").join(a, "a").join(b, "b").where(100 * both.cast("bigint") >= LEAST_PERCENT * union.cast("bigint")).select("a", "b")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    root = lambda side: comp.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    met = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _large(comp: DataFrame) -> DataFrame:
    """(root, members) of components with more members than neighbours."""
    return comp.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > NEIGHBOURS)


def _regions(dense: DataFrame) -> DataFrame:
    """(region, node): every set under the prefixes down to the depth to which they are dense."""
    cut = F.explode(F.sequence(F.lit(LEAST_DEPTH), F.col("depth"))).alias("d")
    return dense.select("node", "tree", "path", cut).select(F.xxhash64("tree", F.substring("path", F.lit(1), F.col("d") * VALUE_BYTES), "d").alias("region"), "node").distinct()


def _outside(regions: DataFrame, comp: DataFrame, large: DataFrame, n: int) -> DataFrame:
    """(node, root): sets of dense regions, and the large component that most of the region belongs to but they do not."""
    rooted = regions.join(comp, "node", "left").select("region", "node", F.coalesce("root", "node").alias("own"))
    shares = rooted.join(large.select(F.col("root").alias("own")), "own").groupBy("region", "own").count()
    main = stored(few(shares.groupBy("region").agg(F.max(F.struct("count", "own")).getField("own").alias("root")), TREES * n), "main")
    return rooted.join(main, "region").where("own <> root").select("node", "root").distinct()


def _joined(comp: DataFrame, more: DataFrame, links: int) -> DataFrame:
    """``comp`` with the components that ``more``, of so many links, links joined: a graph of components, not of sets."""
    own = lambda side: comp.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    ends = more.join(own("a"), "a", "left").join(own("b"), "b", "left")
    graph = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct()
    top = components(graph, links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    fresh = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("root"))
    return comp.union(fresh).join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _centres(members: DataFrame, counts: DataFrame) -> DataFrame:
    """(root, centre, middle): of every component the member nearest to the shingles that most members have, and its shingles."""
    common = stored(counts.where("2 * count > members").groupBy("root").agg(F.collect_list("s").alias("common")), "common")
    met = members.join(common, "root", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    both = F.size(F.array_intersect("shingles", "common"))
    near = both / (F.size("shingles") + F.size("common") - both)
    nearest = met.groupBy("root").agg(F.max(F.struct(near.alias("near"), "node", "shingles")).alias("nearest"))
    return nearest.select("root", F.col("nearest.node").alias("centre"), F.col("nearest.shingles").alias("middle"))


def _to_centres(outside: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b): sets beside the centre of their region's component."""
    return outside.join(centres.select("root", "centre"), "root").select(*_pair("node", "centre"))


def _to_members(outside: DataFrame, members: DataFrame, sets: DataFrame, counts: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b): sets beside all members of their region's component to which they may be linked, but for links that the centre's makes needless.

    A set linked to a member has with it one of the shingles that remain when as many as the
    link lets it lack, the rarest of the component first, are set aside. Most sets lack more
    shingles in the whole component than a link allows, and have no candidates. A set that needs
    a shingle which many members have is compared by what sets it apart from the centre.
    """
    postings = members.select("root", F.col("node").alias("member"), F.size("shingles").alias("other"), F.explode("shingles").alias("s"))
    size = F.size("shingles")
    lacking = (size - F.floor((LEAST_PERCENT * size + 99) / 100)).cast("int")
    spread = outside.join(sets, "node").select("node", "root", size.alias("size"), lacking.alias("lacking"), F.explode("shingles").alias("s"))
    rarest = F.row_number().over(Window.partitionBy("node", "root").orderBy("count", "s"))
    held = spread.join(counts, ["root", "s"], "left").fillna(0, ["count"]).withColumn("nth", rarest).where("nth <= lacking + 1 and count > 0")
    held = stored(held.select("node", "root", "size", "s", (COMMON * F.col("count") > F.col("members")).alias("often")), "held")
    common = held.where("often").select("node", "root").distinct()
    alike = 100 * F.least("size", "other") >= LEAST_PERCENT * F.greatest("size", "other")  # sizes further apart rule a link out
    beside_some = held.join(common, ["node", "root"], "left_anti").select("node", "root", "size", "s").join(postings, ["root", "s"]).where(alike)
    return _by_differences(common, members, sets, counts, centres).union(beside_some.select(*_pair("node", "member")))


def _apart_from(laid: DataFrame) -> DataFrame:
    """``laid`` (root, node, shingles, middle) with ``size``, ``d`` shingles that only the set or only the centre has, and what the bounds of ``_by_differences`` are made of."""
    size, middle, both = (F.size(x).cast("bigint") for x in ("shingles", "middle", F.array_intersect("shingles", "middle")))
    found = laid.withColumn("size", size).withColumn("of_middle", middle).withColumn("d", size + middle - 2 * both)
    differing, alike = WHOLE * F.col("d"), LOSS * F.col("size")
    return found.withColumn("excess", differing - alike).withColumn("reach", differing + alike)


def _rarest_differences(laid: DataFrame, counts: DataFrame, shared: Column) -> DataFrame:
    """(root, node, size, excess, reach, s): of each set's differences from the centre those that remain when all but one of the ``shared`` ones, the most frequent, are set aside."""
    fewest = F.greatest(F.lit(1), F.ceil(shared / (2 * WHOLE)))
    kept = laid.withColumn("keep", F.col("d") - fewest + 1).where("keep > 0")
    own = F.transform(F.array_except("shingles", "middle"), lambda s: F.struct(s.alias("s"), F.lit(False).alias("lacks")))
    lacked = F.transform(F.array_except("middle", "shingles"), lambda s: F.struct(s.alias("s"), F.lit(True).alias("lacks")))
    names = ["root", "node", "size", "excess", "reach"]
    spread = kept.select(*names, "keep", F.explode(F.concat(own, lacked)).alias("e")).select(*names, "keep", "e.*")
    count = F.coalesce("count", F.lit(0))
    often = F.when(F.col("lacks"), F.col("members") - count).otherwise(count)  # members with this difference
    nth = F.row_number().over(Window.partitionBy("root", "node").orderBy("often", "s"))
    return spread.join(counts, ["root", "s"], "left").withColumn("often", often).withColumn("nth", nth).where("nth <= keep").select(*names, "s")


def _by_differences(beside: DataFrame, members: DataFrame, sets: DataFrame, counts: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b): sets beside the members of a component to which they may be linked if they are not linked to its centre.

    Let d be the number of shingles in which a set differs from the centre. Two sets that share o
    of these differences differ in d + d' - 2 o shingles, and are linked if WHOLE times that is at
    most LOSS times the sum of their sizes; that is, if 2 WHOLE o >= excess + excess', where
    a set's excess is WHOLE d - LOSS size. A set not linked to the centre has an excess
    above LOSS times the centre's size, so it must share more than about half of a member's
    differences, and most of those are rare: edits of one text differ from it at different places.
    As o is at most d or d', each one's excess is at most the other's reach, WHOLE d + LOSS size.
    """
    middles = centres.select("root", "middle")
    laid = _apart_from(beside.join(sets, "node").join(middles, "root")).where(F.col("excess") > LOSS * F.col("of_middle"))
    largest = F.floor(100 * F.col("size") / LEAST_PERCENT)
    seeking = stored(_rarest_differences(laid, counts, 2 * F.col("excess") - 2 * LOSS * largest), "seeking")
    crowd = _apart_from(members.select("root", "node", "shingles").join(middles, "root").join(seeking.select("root").distinct(), "root", "left_semi"))
    there = _rarest_differences(crowd, counts, F.col("excess") + LOSS * F.col("of_middle") + 1)
    there = stored(there.toDF("root", "member", "other", "other_excess", "other_reach", "s"), "there")
    alike = 100 * F.least("size", "other") >= LEAST_PERCENT * F.greatest("size", "other")
    met = seeking.join(there, ["root", "s"]).where(alike & (F.col("excess") <= F.col("other_reach")) & (F.col("other_excess") <= F.col("reach")))
    return met.select(*_pair("node", "member")).distinct()


def _among(outside: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): neighbours in a forest without the components that crowd their regions."""
    return forest(distinct.join(outside.select("node").distinct(), "node", "left_semi"))[0].select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the least doc_id that is reached over links. Null texts and texts without
    words have no shingles and are linked with nothing, not even with each other; repeated rows
    stay repeated and are one class; a null doc_id is kept and never wins the minimum unless its
    whole component has none. Texts of any length are used whole. An empty table gives an empty
    one; no column but doc_id and text is looked at.
    """
    rows = _documents(docs)
    sketches = stored(per_batch(rows, _sketch_kernel, "doc_id bigint, mark bigint, n bigint, node binary, paths binary"), "sketches")
    some = sketches.where("n > 0")
    whose = some.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark")).alias("whose"), F.first("n").alias("n"), F.first("paths").alias("paths"))
    n = sketches.count()
    distinct = stored(few(whose.select("node", "n", "paths", "whose.doc_id", "whose.mark"), n), "distinct")
    pairs, dense = forest(distinct)
    pairs = stored(pairs, "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct, "node")
    wanted = stored(few(wanted.select("node", F.col("doc_id").alias("i"), F.col("mark").alias("m")), n), "wanted")
    held = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.i) & (rows.mark == wanted.m), "left_semi").select("text")
    sets = stored(per_batch(held, _set_kernel, "node binary, shingles array<bigint>").dropDuplicates(["node"]), "sets")

    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "closeness"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("closeness"), "b"))
    closest = both.withColumn("nth", nth).where(F.col("nth") <= FIRST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    comp = components(_linked(closest, sets), FIRST * n)
    regions = stored(_regions(dense), "regions")
    crowded, asked, among = not regions.isEmpty(), pairs.select("a", "b"), False
    while True:
        if crowded:
            large = stored(few(_large(comp), n), "large")
            outside = stored(few(_outside(regions, comp, large, n), TREES * n), "outside")
            members = comp.join(large, "root").join(sets, "node").select("root", "members", "node", "shingles")
            counts = stored(members.select("root", "members", F.explode("shingles").alias("s")).groupBy("root", "members", "s").agg(F.count("*").alias("count")), "counts")
            centres = stored(few(_centres(members, counts), n), "centres")
            asked = asked.union(_to_centres(outside, centres)).union(_to_members(outside, members, sets, counts, centres))
            if among:
                asked = asked.union(_among(outside, distinct))
        # each link joins two components, so the rounds end
        more = stored(_linked(stored(_apart(asked.distinct(), comp), "asked"), sets), "links")
        grown = more.count()
        if grown:
            comp = stored(few(_joined(comp, more, grown), n), "components")
        if not crowded or (among and not grown):
            break
        asked, among = pairs.select("a", "b").limit(0), True
    root = F.coalesce("root", "node")
    rooted = distinct.select("node", "doc_id").join(comp, "node", "left").select("node", "doc_id", root.alias("root"))
    least = stored(few(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), n), "least")
    ids = stored(few(rooted.join(least, "root").select("node", "component_id"), n), "ids")
    known = sketches.select("doc_id", F.col("n").alias("n_shingles"), "node")
    # a set may have a third of all rows: the large side is split, and rows without shingles stay out of the join
    linked = known.where("n_shingles > 0").join(ids, "node").select("doc_id", "n_shingles", "component_id")
    return linked.union(known.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document; ``kept`` is whether it is the first of its component."""
    kept: Column = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return classes(docs).withColumn("kept", kept)
