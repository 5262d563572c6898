"""N-gram Jaccard join by signature trees.

Two texts link when the Jaccard index of their sets of distinct k-word
shingles is at least num/den. The join is exact up to 64-bit hash collisions:

1. One pass hashes each text's shingles and makes the keys of step 2. Texts with equal sets become one
   node, so groups of copies shrink to a row before anything is compared.
2. Nodes whose sets could link are brought together. For the smaller set's
   size class [lo, hi], linked sets differ in at most D = hi*(den-num)/num
   shingles. The hash space is cut into more than D cells; linked sets agree
   in all of some cell, so they share the key of that cell's content. There
   are a few cells to spare, and as many of a set's with the least content are
   left out, so that hardly a key stands for an empty cell. Of a
   key's members the bitmaps are compared: a pair that could link by them is
   an edge (not all edges: a spanning forest). Keys with more than BUCKET
   members are not compared; all their members hang on the least one. The
   parts that edges join are clusters.
3. A cluster is a forest of signature trees. Its nodes are cut into leaf
   blocks by size, and nodes of one size by hash; blocks and the levels above hold the OR and the AND
   of their bitmaps and the range of sizes. Dual traversal drops node pairs
   whose largest possible overlap is below what their sizes need, and
   surviving documents are verified on the exact sets. Pairs of blocks are
   separate rows, and so are pairs of chunks of blocks before, so a very large
   cluster spreads over tasks, and a block pair only emits the links that join parts it had not joined yet.
   Pairs of blocks hold a block once for each partner: they are made in as many
   parts, one after another, as keep each about as large as all blocks.
4. Components of the verified links give each document its class.

Null or wordless texts have empty sets and link with nothing. Rows without
doc_id take no part: their component_id is null. Repeated doc_ids are rows of
their own; with different texts they are different nodes. Nodes are known by
the hash of their sets throughout, and a component_id is the least doc_id of
the component's nodes. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, among, tidied, unshuffled
from .components import components
from .shingles import mix, shingle_set

#: Ratio of the size classes, documents and shingles of a leaf block, bits of a bitmap, children of a tree node.
RATIO, LEAF_DOCS, LEAF_SHINGLES, BITS, FAN = 1.25, 256, 200_000, 2048, 16
#: Members of a key up to which they are compared at once; blocks of a chunk; nodes up to which a bitmap of their ids is broadcast, of 2 MB at most.
BUCKET, CHUNK, BROADCAST_ROWS = 2048, 1024, 16_000_000
#: Parts of the keys, and of their buckets, that are shuffled one after another.
SLICES = 4
#: Bytes of blocks that a part of the pairs of blocks may hold in any case.
PAIRED = 1 << 29


class SizeClasses:
    """Size classes and the number of hash cells of each."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.lo = [1]
        while self.lo[-1] < 1 << 40:
            self.lo.append(max(self.lo[-1] + 1, int(self.lo[-1] * RATIO)))

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(class, differences + 1, cells) of each class that a set of n shingles may meet a partner in."""
        out = []
        c = int(np.searchsorted(self.lo, n, side="right")) - 1
        for g in range(c, -1, -1):
            hi = self.lo[g + 1] - 1
            if n * self.num > hi * self.den:
                break
            differ = hi * (self.den - self.num) // self.num
            if differ:
                need = differ + 1
                # By the class alone: both sides have to cut into the same cells.
                per = self.lo[g] / need
                out.append((g, need, need + max(1, int(need * (0.25 if per < 5 else 0.06)))))
        return out


def cell_keys(h: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """Keys of a sorted set: one for each cell but as many of the weakest as are spare.

    Sets that link agree in more cells than are spare. Weakness goes by a cell's
    content alone, so of the cells in which two sets agree each has more than
    the spare ones below the strongest: both have its key.
    """
    keys = []
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h))))
    for g, need, cells in classes.of(len(h)):
        edges = np.arange(cells + 1, dtype=np.uint64) * np.uint64((1 << 64) // cells)
        at = np.searchsorted(h, edges)
        at[-1] = len(h)
        count = np.diff(at)
        own = mix(mix(c[at[1:]] - c[at[:-1]]) + np.arange(cells, dtype=np.uint64) + np.uint64(g << 32))
        keys.append(own[np.lexsort((own, count))[cells - need :]])
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def node_of(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64))


def small_bitmap(h: np.ndarray) -> bytes:
    """About a bit or two for each shingle; folding it in halves gives the smaller ones."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    on = np.zeros(bits, bool)
    on[(h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _sets(k: int, num: int, den: int):
    """Texts are shingled here, once. Of equal sets that one task meets, just the first gives its bitmap and its keys."""

    def run(batches):
        classes, seen = SizeClasses(num, den), set()
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                n, node, bits, keys = [], [], [], []
                for i, t in zip(part.column(0), part.column(1), strict=True):
                    h = shingle_set(t.as_py(), k)
                    n.append(len(h))
                    node.append(x := node_of(h) if len(h) else None)
                    new = x is not None and i.is_valid and x not in seen
                    if new:
                        seen.add(x)
                    bits.append(small_bitmap(h) if new else None)
                    keys.append(cell_keys(h, classes) if new else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "bits", "keys"])

    return tidied(run)


def _bucket_edges(num: int, den: int):
    """A spanning forest of the pairs of a key's members that could link by their bitmaps."""

    def run(batches):
        for batch in batches:
            found = []
            for cell in batch.column(0):
                members = cell.as_py()
                k = len(members)
                size = min(len(x["bits"]) for x in members)
                bits = np.stack([np.bitwise_or.reduce(np.frombuffer(x["bits"], np.uint64).reshape(-1, size // 8), axis=0) for x in members])
                n = np.array([x["n_shingles"] for x in members], np.int64)
                part = np.arange(k)
                for i in range(k - 1):
                    j = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
                    if not len(j):
                        continue
                    most = np.minimum(n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64), n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64))
                    for x in j[most * (den + num) >= num * (n[i] + n[j])].tolist():
                        if part[x] != part[i]:
                            part[part == part[x]] = part[i]
                            found.append((members[i]["node"], members[x]["node"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return tidied(run)


def _payloads(k: int):
    """The sets of the documents that stand for their nodes."""

    def run(batches):
        for b in batches:
            rows = {x: [] for x in ("cluster", "block", "node", "shingles")}
            for t, node, cluster, block in zip(*(b.column(i) for i in range(4)), strict=True):
                h = shingle_set(t.as_py(), k)
                if len(h) and node_of(h) == node.as_py():
                    for x, v in zip(rows, (cluster.as_py(), block.as_py(), node.as_py(), h.tobytes()), strict=True):
                        rows[x].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if x == "shingles" else pa.int64()) for x, v in rows.items()], names=list(rows))

    return tidied(run)


# ---- the tree -------------------------------------------------------------


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    on = np.zeros((len(sets), BITS), bool)
    for i, h in enumerate(sets):
        on[i, (h & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(on, axis=1).view(np.uint64)


class Tree:
    """Levels of nodes over rows in order of size; the last level is one root."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, any_: np.ndarray, all_: np.ndarray) -> None:
        self.levels = [(lo, hi, any_, all_)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, any_, all_ = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(any_, at, axis=0), np.bitwise_and.reduceat(all_, at, axis=0)))


def may_link(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether any member of node i of x could link with any of node j of y.

    Each member of i has a shingle of its own in every bit that all of i set
    and none of j does; so many of its shingles lie outside the overlap.
    """
    xlo, xhi, xany, xall = (v[i] for v in x)
    ylo, yhi, yany, yall = (v[j] for v in y)
    most = np.minimum(xhi - np.bitwise_count(xall & ~yany).sum(1, dtype=np.int64), yhi - np.bitwise_count(yall & ~xany).sum(1, dtype=np.int64))
    return (most * (den + num) >= num * (xlo + ylo)) & (xhi * den >= num * ylo) & (yhi * den >= num * xlo)


def dual(a: Tree, b: Tree, same: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of level-0 rows that survive; with same, each pair once."""
    da, db = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        parts = []
        for s in range(0, len(i), 1 << 15):
            si, sj = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            ok = may_link(a.levels[da], si, b.levels[db], sj, num, den)
            if same:
                ok &= (si < sj) if not da else (si <= sj)
            parts.append((si[ok], sj[ok]))
        i, j = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (i[:0], j[:0])
        if not da and not db:
            return i, j
        down_a, down_b = da > 0 and da >= db, db > 0 and db >= da
        if down_a:
            da -= 1
            i, j = np.repeat(i * FAN, FAN) + np.tile(np.arange(FAN), len(i)), np.repeat(j, FAN)
            ok = i < len(a.levels[da][0])
            i, j = i[ok], j[ok]
        if down_b:
            db -= 1
            i, j = np.repeat(i, FAN), np.repeat(j * FAN, FAN) + np.tile(np.arange(FAN), len(j))
            ok = j < len(b.levels[db][0])
            i, j = i[ok], j[ok]


def block_links(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links within block a, or between a and b; of links that close a circle, none."""
    a = sorted(a, key=lambda x: (len(x[1]), x[0]))
    b = sorted(b, key=lambda x: (len(x[1]), x[0])) if b else None
    trees = []
    for side in (a, b or a):
        n, bits = np.array([len(h) for _, h in side], np.int64), bitmaps([h for _, h in side])
        trees.append(Tree(n, n, bits, bits))
    other = b or a
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in dual(*trees, b is None, num, den)), strict=True):
        (p, hp), (q, hq) = a[i], other[j]
        rp, rq = find(p), find(q)
        if rp == rq:
            continue
        if len(hp) > len(hq):
            hp, hq = hq, hp
        at = np.searchsorted(hq, hp)
        at[at == len(hq)] = 0
        inter = int((hq[at] == hp).sum())
        if inter * (den + num) >= num * (len(hp) + len(hq)):
            root[max(rp, rq)] = min(rp, rq)
            out.append((p, q))
    return out


def _unpack(cell) -> list[tuple[int, np.ndarray]]:
    # Rows that repeat a document give its set again.
    return [(node, np.frombuffer(h, np.uint64)) for node, h in {(x["node"], x["shingles"]) for x in cell.as_py()}]


def _links(num: int, den: int, two: bool):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a = _unpack(batch.column(0)[r])
                found = block_links(a, _unpack(batch.column(1)[r]) if two else None, num, den)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return tidied(run)


def _summaries(batches):
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            sets = [h for _, h in _unpack(batch.column(2)[r])]
            bits, n = bitmaps(sets), [len(h) for h in sets]
            rows.append((batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), min(n), max(n), np.bitwise_or.reduce(bits).tobytes(), np.bitwise_and.reduce(bits).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["cluster", "block", "lo", "hi", "any_bits", "all_bits"])


def _block_pairs(num: int, den: int):
    """Pairs of blocks that could link, of chunks p and q of a cluster's blocks."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for chunk in sorted(pdf["chunk"].unique()):
            side = pdf[pdf["chunk"] == chunk].sort_values(["lo", "hi", "block"])
            bits = lambda c, side=side: np.frombuffer(b"".join(side[c]), np.uint64).reshape(len(side), -1)
            sides.append((side["block"].to_numpy(), Tree(side["lo"].to_numpy(np.int64), side["hi"].to_numpy(np.int64), bits("any_bits"), bits("all_bits"))))
        same = pdf["p"].iloc[0] == pdf["q"].iloc[0]
        if not same and len(sides) < 2:
            return pd.DataFrame({"cluster": [], "x": [], "y": []})
        (xs, t), (ys, u) = sides[0], sides[-1]
        i, j = dual(t, u, same, num, den)
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "x": xs[i], "y": ys[j]})

    return run


def _placed(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows (cluster, node, rep, block): blocks of a cluster's nodes of about one size, by sums over sizes; no cluster is ranked row by row."""
    rows = nodes.select("rep", "node", "n_shingles").join(clusters, "node")
    sizes = rows.groupBy("cluster", "n_shingles").agg(F.count("*").alias("c"))
    w = Window.partitionBy("cluster").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0))
    docs, shingles = before(F.col("c")), before(F.col("c") * F.col("n_shingles"))
    parts = F.ceil(F.greatest(F.col("c") / LEAF_DOCS, F.col("c") * F.col("n_shingles") / LEAF_SHINGLES)).cast("long")
    sizes = sizes.select(F.col("cluster").alias("_c"), F.col("n_shingles").alias("_n"), F.floor(docs / LEAF_DOCS).alias("i"), F.floor(shingles / LEAF_SHINGLES).alias("j"), parts.alias("parts"))
    rows = rows.join(sizes, (F.col("cluster") == F.col("_c")) & (F.col("n_shingles") == F.col("_n")))
    # Many sets of one size are dealt out by hash.
    return rows.select("cluster", "node", "rep", F.xxhash64("i", "j", F.when(F.col("parts") > 1, F.concat_ws(":", "_n", F.pmod(F.xxhash64("node"), "parts")))).alias("block"))


def _parts(blocks: DataFrame, pairs: DataFrame) -> int:
    """Parts of the pairs, of which each holds about as many bytes as all blocks together, or PAIRED."""
    if pairs.isEmpty():
        return 1
    sizes = blocks.select("cluster", "block", F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + F.length(m["shingles"]).cast("long")).alias("size"))
    ends = pairs.select("cluster", F.explode(F.array("x", "y")).alias("block"))
    with unshuffled(pairs.sparkSession):
        paired = ends.groupBy("cluster", "block").agg(F.count("*").alias("n")).join(sizes, ["cluster", "block"]).agg(F.sum(F.col("n") * F.col("size"))).first()[0]
        return -int(-paired // max(PAIRED, sizes.agg(F.sum("size")).first()[0]))


# ---- the join -------------------------------------------------------------


def ngram_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    sets = scratch.put(text.mapInArrow(_sets(k, num, den), "doc_id long, n_shingles long, node long, bits binary, keys array<long>"), "sets")
    known = scratch.put(sets.select("doc_id", "n_shingles", "node"), "known")
    usable = sets.filter("doc_id is not null and node is not null")
    nodes = scratch.put(usable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bits", True).alias("bits")), "nodes")

    entries = usable.select("node", F.explode("keys").alias("key"))
    by_key = Window.partitionBy("key")
    met = lambda rows: rows.withColumns({"size": F.count("*").over(by_key), "least": F.min("node").over(by_key)}).filter("size > 1")
    met = scratch.put_sliced(entries, "key", met, SLICES, "met")
    scratch.drop(sets)
    # Keys are many, but most have the members of another key: each company is compared once.
    lists = met.filter(F.col("size") <= BUCKET).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("company"))
    lists = scratch.put(lists.filter(F.size("company") > 1).select("company").distinct().withColumn("list", F.monotonically_increasing_id()), "lists")
    buckets = lambda rows: rows.select("list", F.explode("company").alias("node")).join(nodes, "node").groupBy("list").agg(F.collect_list(F.struct("node", "n_shingles", "bits")).alias("members"))
    edges = scratch.put_sliced(lists, "list", lambda rows: buckets(rows).select("members").mapInArrow(_bucket_edges(num, den), "a long, b long"), SLICES, "edges")
    large = met.filter(F.col("size") > BUCKET).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    clusters = scratch.put(components(edges.union(large), scratch).select("node", F.col("component").alias("cluster")), "clusters")

    placed = scratch.put(_placed(nodes, clusters), "placed")
    wanted = text
    if placed.count() <= BROADCAST_ROWS:
        wanted = among(text, placed.select(F.col("rep").alias("doc_id")))
    payload = wanted.join(placed, F.col("doc_id") == F.col("rep")).select("text", "node", "cluster", "block")
    payload = payload.mapInArrow(_payloads(k), "cluster long, block long, node long, shingles binary")
    blocks = payload.groupBy("cluster", "block").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))
    blocks = scratch.put(blocks, "blocks")

    within = blocks.select("members").mapInArrow(_links(num, den, False), "a long, b long")
    several = blocks.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    wide = blocks.join(several.select("cluster"), "cluster", "left_semi").select("cluster", "block", "members").mapInArrow(_summaries, "cluster long, block long, lo long, hi long, any_bits binary, all_bits binary")
    chunk, other = F.col("chunk"), F.col("other")
    wide = wide.join(several, "cluster").withColumn("chunk", F.pmod(F.xxhash64("block"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    wide = wide.select("cluster", F.least(chunk, other).alias("p"), F.greatest(chunk, other).alias("q"), "chunk", "block", "lo", "hi", "any_bits", "all_bits")
    pairs = scratch.put(wide.groupBy("cluster", "p", "q").applyInPandas(_block_pairs(num, den), "cluster long, x long, y long"), "pairs")
    one = blocks.select("cluster", F.col("block").alias("x"), F.col("members").alias("mx"))
    two = blocks.select("cluster", F.col("block").alias("y"), F.col("members").alias("my"))
    across = lambda rows: rows.join(one, ["cluster", "x"]).join(two, ["cluster", "y"]).select("mx", "my").mapInArrow(_links(num, den, True), "a long, b long")
    links = within.union(scratch.put_sliced(pairs, "x", across, _parts(blocks, pairs), "across"))
    linked = components(links, scratch)

    least = nodes.select("node", "rep").join(linked, "node").groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    out = known.join(nodes.select("node", "rep"), "node", "left").join(linked, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id")).alias("component_id"))
    # All that led to the result has done its work.
    out = scratch.put(out, "result")
    scratch.keep(out)
    return out
