"""N-gram Jaccard join by count vectors in R-trees.

Texts whose sets of word shingles are the same are one node. Each node's shingle
hashes fall into groups; the counts of the groups are its point. Two points'
summed coordinate minima bound the overlap of their sets, and so their
similarity; boxes of an R-tree bound it for all points below them.

One tree over a corpus would not fit a task, so nodes are dealt to trees by
shingle: of a node's shingles in a fixed order, the first n - ceil(t n) + 1 have
one in common with those of every node of similarity t or more, so each link is
in some tree. The order puts shingles first whose hash bucket is rare in the
corpus (a count sketch of fixed size; how exact it is changes the cost, never the
result), hence what thousands of documents share makes no large tree.

A tree gives each of its points its nearest few partners, which are verified on
whole sets; linked nodes are joined to components. A tree of more than ``SLICE``
nodes is cut in parts that share some nodes. Trees that had more to give, or were
cut, and still hold several components are searched once more, for all partners in
other components, a block of queries against a block of points at a time; so
copies don't become all pairs, no tree must fit a task, and no link between
components is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 4
#: Links have PERCENT * union <= 100 * intersection.
PERCENT = 85
SKETCH_BITS = 22
PIECES = 64
NEAREST = 3
LEAF = 16
#: Nodes of a tree that are searched together; a larger tree is cut in parts, and about CENTRES of its nodes stand in all of them.
SLICE = 512
CENTRES = 32
#: Nodes of one side of a block, where all partners in other components are sought.
BLOCK = 1024
#: Ids are broadcast up to this count, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Keys whose trees are made in one round.
KEYS = 40_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: runs of ``words`` words, or the whole of a shorter text; none without words."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    k = min(words, len(w))
    v = _word_hashes(w)
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = _mixed(h * _MULTIPLIER + v[i : len(w) - k + 1 + i])
    return np.unique(h)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def point(s: np.ndarray) -> np.ndarray:
    """Group counts of a set: a power of two of groups, one or two for a shingle, so that few shingles that two sets don't share fall together."""
    groups = 1 << min(max(int(len(s)).bit_length(), 4), 13)
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint32)


# -- the tree ----------------------------------------------------------------------


class RTree:
    """Points (counts per group) packed by size and by their first coordinates into leaves, with a box for each leaf and for each run of leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points[:, 1], points[:, 0], sizes // max(1, int(sizes.max()) // 16 or 1)))
        self.order, self.points, self.sizes = order, points[order].astype(np.int32), sizes[order]
        starts = np.arange(0, len(order), LEAF)
        self.high = np.maximum.reduceat(self.points, starts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, starts)
        self.most = np.maximum.reduceat(self.sizes, starts)
        self.top = np.maximum.reduceat(self.high, np.arange(0, len(self.high), LEAF), axis=0)
        self.top_least = np.minimum.reduceat(self.least, np.arange(0, len(self.high), LEAF))

    def search(self, p: np.ndarray, size: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """Indices of points that may be linked with p, and the bounds of their overlaps with it."""
        need = percent / (100 + percent) - 1e-12
        p = p.astype(np.int32)
        tops = np.flatnonzero(np.minimum(self.top, p).sum(1) >= need * (size + self.top_least))
        leaves = (tops[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(self.high)]
        fits = (100 * self.most[leaves] >= percent * size) & (percent * self.least[leaves] <= 100 * size)
        leaves = leaves[fits]
        leaves = leaves[np.minimum(self.high[leaves], p).sum(1) >= need * (size + self.least[leaves])]
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[rows < len(self.order)]
        bound = np.minimum(self.points[rows], p).sum(1)
        ok = bound >= need * (size + self.sizes[rows])
        return self.order[rows[ok]], bound[ok]


def _folded(p: np.ndarray, groups: int) -> np.ndarray:
    return p.astype(np.int32) if len(p) == groups else p.astype(np.int32).reshape(-1, groups).sum(0)


@lru_cache(maxsize=512)
def _unpacked(point: bytes) -> np.ndarray:
    raw = zlib.decompress(point)
    return np.frombuffer(raw[1:], dtype=np.uint8 if raw[0] == 1 else np.uint32)


def _packed(point: np.ndarray) -> bytes:
    """A point as bytes: a byte a count where all fit, else four."""
    small = int(point.max()) < 256
    return zlib.compress(b"\1" + point.astype(np.uint8).tobytes() if small else b"\4" + point.tobytes(), 6)


def candidates(sizes: list[int], points: list[np.ndarray], components: list | None, nearest: int | None, percent: int = PERCENT, sides: list[int] | None = None):
    """Pairs (i, j), i < j, of points of one tree that may be linked, and whether there were more than are given.

    nearest: at most so many partners are given for a point, those with the largest bounds relative to the sizes.
    components: pairs in one component are left out.
    sides: of each point 0 or 1; pairs of one side are left out.
    """
    level = np.array([len(p) for p in points])
    numbers: dict = {}
    component = None if components is None else np.array([numbers.setdefault(c, len(numbers)) for c in components])
    side = None if sides is None else np.array(sides)
    out, more = set(), False
    for groups in np.unique(level):
        here = np.flatnonzero((level == groups) | (level == 2 * groups))
        own = level[here] == groups
        if len(here) < 2 or (component is not None and (component[here] == component[here[0]]).all()):
            continue
        folded = np.stack([_folded(points[i], int(groups)) for i in here])
        n = np.array([sizes[i] for i in here])
        if len(here) == 2:  # a single pair needs no tree
            bound = int(np.minimum(folded[0], folded[1]).sum())
            if (100 + percent) * bound >= percent * int(n.sum()) and (side is None or side[here[0]] != side[here[1]]):
                out.add((int(here[0]), int(here[1])))
            continue
        asked, among = np.flatnonzero(own), np.arange(len(here))
        if side is not None:
            asked, among = np.flatnonzero(side[here] == 0), np.flatnonzero(side[here] == 1)
        elif component is not None:  # of a pair of two components, one isn't the largest
            asked = np.flatnonzero(component[here] != np.bincount(component[here]).argmax())
        if not len(asked) or not len(among):
            continue
        tree = RTree(folded[among], n[among])
        for a in asked:
            found, bound = tree.search(folded[a], int(n[a]), percent)
            found = among[found]
            keep = (found != a) & (own[found] | own[a])  # two of the finer level meet in a tree of their own
            if component is not None:
                keep &= component[here[found]] != component[here[a]]
            found, bound = found[keep], bound[keep]
            if nearest is not None and len(found) > nearest:
                more = True
                likely = bound / (n[found] + n[a] - bound)
                # Ties go to the nodes that come first, the same for all points: these become the centres.
                found = found[np.lexsort((here[found], -np.round(likely, 2)))[:nearest]]
            for f in found:
                i, j = int(here[a]), int(here[f])
                out.add((min(i, j), max(i, j)))
    return sorted(out), more


# -- passes over texts -------------------------------------------------------------


def _sketched(words):
    def run(batches):
        from lagspace.llm import jaccard

        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        some: list[np.ndarray] = []
        held = [0]

        def add():
            at, n = np.unique((np.concatenate(some) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
            counts[at] += n.astype(np.uint32)
            some.clear()
            held[0] = 0

        for b in batches:
            for t in common.as_bytes(b.column(0)):
                some.append(jaccard.shingles(t, words))
                held[0] += len(some[-1])
                if held[0] > 400_000 or len(some) >= 2000:
                    add()
        if some:
            add()
        for i, part in enumerate(np.split(counts, PIECES)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["piece", "counts"])

    return run


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(c), dtype=np.uint32)
            total[i] = total[i] + part if i in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(x, 65535).astype(np.uint16).tobytes(), 1) for x in total.values()], pa.binary())], names=["piece", "counts"])


def sketch(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """How often shingles fall into each hash bucket, over all texts; 8 MB whatever the corpus."""
    rows = texts.select("text").mapInArrow(common.lean(_sketched(words)), "piece int, counts binary").repartition(PIECES, "piece").mapInArrow(_summed, "piece int, counts binary").collect()
    out = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), dtype=np.uint16)
    for r in rows:
        out[r.piece] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint16)
    return out.ravel()


def _noded(shared, words, percent):
    def run(batches):
        from lagspace.llm import jaccard

        rarity, seen = shared.value, set()
        for b in batches:
            sizes, nodes, points, keys = [], [], [], []
            for doc, t in zip(b.column(0).to_pylist(), common.as_bytes(b.column(1))):
                s = jaccard.shingles(t, words)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None)
                    points.append(None)
                    keys.append(None)
                    continue
                node = hashlib.md5(s.tobytes()).digest()
                nodes.append(node)
                if doc is None or node in seen:  # a copy in the same task
                    points.append(None)
                    keys.append(None)
                    continue
                if len(seen) < 100_000:
                    seen.add(node)
                count = rarity[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                keys.append(s[np.lexsort((s, count))[: prefix_length(len(s), percent)]].astype(np.int64))
                points.append(_packed(point(s)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(points, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "point", "keys"])

    return run


def _searched(nearest, percent, again=False):
    """Pairs of sorted rows (key, part, node, n, point[, component, side]): the points of a part of a key are one tree."""

    def run(batches):
        group, rows = None, []
        known: set = set()

        def flush(out):
            if len(rows) < 2:
                return
            names = [r[0] for r in rows]
            sides = [r[4] for r in rows] if again and rows[0][4] >= 0 else None
            found, more = candidates([r[1] for r in rows], [_unpacked(r[2]) for r in rows], [r[3] for r in rows] if again else None, nearest, percent, sides)
            for i, j in found:
                p = (names[i], names[j]) if names[i] < names[j] else (names[j], names[i])
                if p not in known:
                    if len(known) < 50_000:
                        known.add(p)
                    out.append((*p, None))
            if more:
                out.append((None, None, group[0]))

        for b in batches:
            out: list = []
            for key, part, *rest in zip(*[c.to_pylist() for c in b.columns]):
                if (key, part) != group:
                    flush(out)
                    group, rows = (key, part), []
                rows.append(rest)
            yield _pairs(out)
        out = []
        flush(out)
        yield _pairs(out)

    return run


def _pairs(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["a", "b", "more"])


def _sets(words):
    def run(batches):
        from lagspace.llm import jaccard

        for b in batches:
            pairs = [(n, jaccard.shingles(t, words).tobytes()) for n, t in zip(b.column(0).to_pylist(), common.as_bytes(b.column(1)))]
            # Another text of the same doc_id is another node.
            pairs = [x for x in pairs if hashlib.md5(x[1]).digest() == x[0]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.binary()) for k in (0, 1)], names=["node", "set"])

    return run


def _verified(percent):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return run


def small(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df, to be broadcast if it is known to have at most ``limit`` rows; else left to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _contracted(batches):
    """Edges (u, v), by up to ``common.SLIM`` at a time, as stars: each node and the least node that these edges join it to."""
    root: dict[bytes, bytes] = {}
    taken = 0

    def find(x):
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def stars():
        found = [(x, find(x)) for x in root]
        found = [(x, r) for x, r in found if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([r for _, r in found], pa.binary())], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            root.setdefault(u, u)
            root.setdefault(v, v)
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
        taken += b.num_rows
        if taken >= common.SLIM:
            yield stars()
            root.clear()
            taken = 0
    yield stars()


def _known_by(edges: DataFrame):
    """A count and two sums that tell sets of edges apart."""
    return edges.agg(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64("u", "v", F.lit(k))) for k in (0, 1)]).first()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reached) of the nodes of links (a, b).

    Each task first joins what its own links join; alternating large and small stars
    do the rest, until nothing changes.
    """
    rows = links.count()
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    edges = common.cut(edges.coalesce(max(1, -(-rows // common.SLIM))).mapInArrow(_contracted, "u binary, v binary").distinct(), rows)
    before = _known_by(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = common.cut(star.where("u != v").distinct(), rows)
        after = _known_by(edges)
        if after == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = after


def _first_of_each(wide: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of wide with a point, one of each node: that with the least row number.

    The copies are found by slim rows and usually broadcast, so that keys and
    points, most of what is on disk here, are written once and never shuffled.
    """
    own = rows.where("own").select("row", "node")
    twice = common.cut(own.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node", "first"))
    copies = common.cut(own.join(small(twice), "node").where("row != first").select("row"))
    held = small(copies)
    nodes = wide.where("point IS NOT NULL").join(held, "row", "left_anti").select("node", "n_shingles", "point", "keys")
    if held is copies:  # too many for a broadcast: shuffled once
        nodes = common.cut(nodes)
        common.drop(wide)
    return nodes


def _dealt(nodes: DataFrame, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """key, node, n_shingles, point, size: the nodes of each tree of two or more; and the trees (key, size).

    A node has dozens of keys, of which few are another node's too. So keys go through
    shuffles with a hash of the node alone; the points join what is left of them.
    Nodes of equal hashes would stand in each other's trees, which costs no link.

    rounds: keys are dealt to so many rounds, and the files of a round's shuffles go
    before the next, so that disk has the keys of one round at a time.
    """
    spark = nodes.sparkSession
    turn = F.pmod(F.xxhash64("key", F.lit("round")), F.lit(rounds))
    keyed = nodes.select(F.xxhash64("node").alias("h"), F.explode("keys").alias("key"))
    # A tree is known by its size and two sums of its nodes' hashes, made on the map side first; its nodes are never gathered in a row.
    sums = [F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    # Near copies share most of their keys: of trees with the same nodes, one is enough.
    same = ["size", "h0", "h1"]
    found = []
    for i in range(rounds):
        some = keyed.where(turn == i).groupBy("key").agg(F.count(F.lit(1)).alias("size"), *sums).where("size > 1")
        found.append(common.cut(some.groupBy(same).agg(F.min("key").alias("key"))))
        if rounds > 1:
            common.sweep(spark)
    trees = found[0].select("key", "size")
    if rounds > 1:
        trees = common.cut(reduce(DataFrame.unionByName, found).groupBy(same).agg(F.min("key").alias("key")).select("key", "size"))
        common.drop(*found)
    total = trees.agg(F.sum("size")).first()[0] or 0
    held = small(trees)
    if rounds == 1 or held is not trees:
        slim = [common.cut(keyed.join(held, "key").select("h", "key", "size"), total)]
    else:
        slim = []
        for i in range(rounds):
            slim.append(common.cut(keyed.where(turn == i).join(small(trees.where(turn == i)), "key").select("h", "key", "size"), total))
            common.sweep(spark)
    points = nodes.select(F.xxhash64("node").alias("h"), "node", "n_shingles", "point")
    dealt = common.cut(reduce(DataFrame.unionByName, slim).join(points, "h").select("key", "node", "n_shingles", "point", "size"), total, common.WIDE)
    common.drop(*slim)
    return dealt, trees


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that is reached by links of similarity ``percent`` or more.

    A null or empty text has no shingles and links with nothing; its component is
    its own doc_id. Repeated rows are copies of each other. A row with a null
    doc_id is kept; it belongs to the component of the rows with the same
    shingles, and makes no links itself (null where there are no such rows).
    """
    spark = docs.sparkSession
    texts = common.pick(docs, "doc_id", "text")
    shared = spark.sparkContext.broadcast(sketch(texts, words))
    wide = texts.mapInArrow(common.lean(_noded(shared, words, percent)), "doc_id long, n_shingles long, node binary, point binary, keys array<bigint>")
    wide = common.cut(wide.withColumn("row", F.monotonically_increasing_id()))
    shared.unpersist()
    rows = common.cut(wide.select("row", "doc_id", "n_shingles", "node", F.col("point").isNotNull().alias("own"), F.size("keys").alias("n_keys")))
    firsts = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    keys = rows.where("own").agg(F.sum("n_keys")).first()[0] or 0
    nodes = _first_of_each(wide, rows)
    dealt, trees = _dealt(nodes, max(1, -(-keys // KEYS)))
    common.drop(wide)
    ddl = "a binary, b binary, more long"
    parts = F.ceil(F.col("size") / SLICE).cast("int")
    centre = F.pmod(F.xxhash64("node", F.lit("centre")), F.col("size")) < CENTRES
    part = F.when((parts == 1) | ~centre, F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
    sliced = dealt.select("key", F.explode(part).alias("part"), "node", "n_shingles", "point")
    found = common.cut(sliced.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_searched(NEAREST, percent), ddl))
    links = _check(texts, rows, found, words, percent)
    classes = components(links)
    full = common.cut(found.where("more IS NOT NULL").select(F.col("more").alias("key")).unionByName(trees.where(F.col("size") > SLICE).select("key")).distinct())
    # First the nearest few partners in other components, which join the parts of a family, then all that are left.
    for nearest in () if full.isEmpty() else (NEAREST, None):
        again = dealt.join(small(full), "key").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        which = F.xxhash64("component")
        mixed = common.cut(again.groupBy("key").agg(F.min(which).alias("a"), F.max(which).alias("b")).where("a != b").select("key"))
        if mixed.isEmpty():
            break
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        own, other = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.col("other")
        rest = again.join(small(mixed), "key").withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        side = F.when(own == other, -1).otherwise(F.when(own < other, 0).otherwise(1)).alias("side")
        rest = rest.select("key", (F.least(own, other) * F.lit(1 << 16) + F.greatest(own, other)).alias("part"), "node", "n_shingles", "point", "component", side)
        rest = rest.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_searched(nearest, percent, True), ddl)
        links = links.unionByName(_check(texts, rows, common.cut(rest), words, percent))
        classes = components(links)
    group = firsts.join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first")
    least = group.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = group.join(least, "component").select("node", "component_id")
    return rows.select("doc_id", "n_shingles", "node").join(ids, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id. Texts without shingles, and null ids, each stay.

    Only ids are compared; texts are shuffled where there are more ids to drop
    than can be broadcast, or where rows repeat.
    """
    found = common.cut(joined(docs, words, percent).where("doc_id IS NOT NULL"))
    drop = found.where("doc_id != component_id").select("doc_id").distinct()
    twice = found.where("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(small(drop), "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    again = small(common.cut(twice))
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def _check(texts: DataFrame, rows: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """The candidate pairs that are links, by their whole sets. Only the texts of candidates are read again."""
    pairs = found.where("a IS NOT NULL").select("a", "b")
    n = pairs.count()
    pairs = common.cut(pairs.distinct(), n)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    holders = rows.where("own").select("doc_id", "node", "n_shingles").join(nodes, "node", "left_semi")
    holders = common.cut(holders.groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL"), 2 * n)
    sets = texts.join(small(holders), "doc_id").select("node", "text").mapInArrow(_sets(words), "node binary, set binary")
    sets = common.cut(sets.dropDuplicates(["node"]), 2 * n, common.WIDE)
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").select("b", "a", "x")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    links = common.cut(two.mapInArrow(_verified(percent), "a binary, b binary"), n, common.WIDE)
    common.drop(sets, pairs, holders)
    return links
