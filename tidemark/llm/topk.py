"""Exact top-k inner products over vectors in order of length.

Vectors are integers: floor(scale * x) of each component. The search is exact:

1. One pass sums the second moments of all vectors (a d x d table for each
   partition); their eigenvectors are the right singular vectors of the data,
   and rotate it so that the first components carry most of each product.
2. Vectors are ranged by descending length and packed into blocks. The
   HEAD longest, a fixed number, give each query a first threshold: its k-th
   best score so far. A query's threshold over its length says which blocks
   can hold anything for it; shorter ones are never joined to its block.
3. Queries of up to RESIDENT components in all go to every task, which reads
   its vectors by descending length and keeps each query's threshold from block
   to block; nothing but the k best a query leaves a task. More queries meet
   the data in a grid of groups, each of which holds a bounded number of
   blocks: a cell brings the blocks of a data group and of a query group to a
   task, each once, and they are searched in the same way.
   Within a pair of blocks, sub-blocks go by descending length: one whose longest
   vector falls short for all queries ends the pair; for the others the
   rotated partial sum plus the product of the residual lengths
   (Cauchy-Schwarz) bounds each score, and what may reach the threshold is
   scored in full, in integers.
4. Each task emits at most k rows a query; a rank per query ends the search.

Rows without vec_id, and vectors that are null or hold null or non-finite
components, take no part. Of rows that repeat a vec_id the smallest vector
counts. Shorter vectors count as padded with zeros. Scores are exact while
they fit 53 bits and wrap at 64. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a block, of a sub-block, and of the head; queries of a block; blocks of a group of the grid.
BLOCK, STEP, HEAD, QUERIES, GROUP = 4096, 512, 4096, 1024, 64
#: Components of queries (8 bytes each) up to which all of them go to every task.
RESIDENT = 4 << 20
#: Share of a pair's scores above which the whole product is cheaper than its parts.
DENSE = 0.1


def _matrix(cells, d: int) -> np.ndarray:
    out = np.zeros((len(cells), d), np.int64)
    for i, v in enumerate(cells):
        out[i, : len(v)] = v
    return out


def _moments(d: int):
    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0).to_pylist(), d).astype(np.float64)
            total += x.T @ x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.float64())], names=["at", "v"])

    return run


def _narrow(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold them all; the first byte tells how many."""
    for size in (2, 4, 8):
        kind = np.dtype(f"i{size}")
        if size == 8 or not x.size or max(-int(x.min()), int(x.max())) <= np.iinfo(kind).max:
            return bytes([size]) + x.astype(kind).tobytes()
    raise AssertionError


def _wide(data: bytes, d: int) -> np.ndarray:
    data = memoryview(data)
    return np.frombuffer(data[1:], f"i{data[0]}").astype(np.int64).reshape(-1, d)


def _blocks(batches, d: int, size: int):
    """(ids, vectors) of size rows each, as they come."""
    ids, rows = [], []
    for b in batches:
        ids += b.column(0).to_pylist()
        rows += b.column(1).to_pylist()
        while len(ids) >= size:
            yield np.array(ids[:size], np.int64), _matrix(rows[:size], d)
            del ids[:size], rows[:size]
    if ids:
        yield np.array(ids, np.int64), _matrix(rows, d)


def _packed(d: int, size: int):
    """Blocks of size vectors, as they come."""

    def run(batches):
        for ids, x in _blocks(batches, d, size):
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array([norm.max()], pa.float64()), pa.array([ids.tobytes()], pa.binary()), pa.array([_narrow(x)], pa.binary())], names=["longest", "ids", "vectors"])

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of integer rows: in doubles while those are exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _best(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: highest score, then smallest id."""
    order = np.lexsort((ids, -score, rows))
    r = rows[order]
    first = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    return order[np.arange(len(r)) - start < k]


def _thresholds(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score over x, or the least integer."""
    low = np.iinfo(np.int64).min
    if len(x) < k:
        return np.full(len(q), low)
    s = _scores(q, x)
    s[qid[:, None] == xid[None, :]] = low
    return np.partition(s, len(x) - k, axis=1)[:, len(x) - k]


def _query_blocks(d: int, k: int, head_ids: np.ndarray, head: np.ndarray):
    """Blocks of queries with their first thresholds."""

    def run(batches):
        for b in batches:
            for ids, vectors in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                least = _thresholds(_wide(vectors, d), np.frombuffer(ids, np.int64), head, head_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([vectors], pa.binary()), pa.array([least.tobytes()], pa.binary())], names=["qids", "queries", "least"])

    return run


def search_pair(qid, q, least, xid, x, rotation, k, keep) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query position, vec_id, score) of what one block of vectors may add."""
    least = least.copy()
    norm = lambda v: np.sqrt((v * v).sum(1))
    order = np.lexsort((xid, -norm(x.astype(np.float64))))
    x, xid = x[order], xid[order]
    rq, rx = q.astype(np.float64) @ rotation, x.astype(np.float64) @ rotation
    nq, nx = norm(rq), norm(rx)
    tq, tx = norm(rq[:, keep:]), norm(rx[:, keep:])
    out = []
    for s in range(0, len(x), STEP):
        e = slice(s, s + STEP)
        slack = 1e-9 * nq * nx[s] + 1e-6
        alive = np.flatnonzero(nq * nx[s] + slack >= least)
        if not len(alive):
            break
        bound = rq[alive, :keep] @ rx[e, :keep].T + np.outer(tq[alive], tx[e]) + slack[alive, None]
        r, c = np.nonzero(bound >= least[alive, None])
        if not len(r):
            continue
        if len(r) > DENSE * bound.size or float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] >= 2.0**52:
            score = _scores(q[alive], x[e])[r, c]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[alive[r[p : p + 65536]]], x[e][c[p : p + 65536]]) for p in range(0, len(r), 65536)])
        ok = (score >= least[alive[r]]) & (qid[alive[r]] != xid[e][c])
        r, c, score = alive[r[ok]], c[ok], score[ok]
        top = _best(r, xid[e][c], score, k)
        out.append((r[top], xid[e][c[top]], score[top]))
        # The threshold rises to the k-th best that the pair has found.
        rows, ids, found = (np.concatenate(p) for p in zip(*out, strict=True))
        top = _best(rows, ids, found, k)
        out = [(rows[top], ids[top], found[top])]
        full = np.bincount(out[0][0], minlength=len(q)) >= k
        kth = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(kth, out[0][0], out[0][2])
        least = np.where(full, np.maximum(least, kth), least)
    return out


class Best:
    """The k best so far of a block of queries, and the thresholds that they give."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> None:
        self.qid, self.q, self.k, self.least = qid, q, k, least.copy()
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.found = (np.empty(0, np.int64),) * 3

    def meet(self, xid: np.ndarray, x: np.ndarray, longest: float, rotation: np.ndarray, keep: int) -> None:
        """Searches a block of vectors, the longest of which is so long."""
        if not (self.length * longest * (1 + 1e-9) + 1e-6 >= self.least).any():
            return
        for found in search_pair(self.qid, self.q, self.least, xid, x, rotation, self.k, keep):
            rows, ids, score = (np.concatenate(v) for v in zip(self.found, found, strict=True))
            top = _best(rows, ids, score, self.k)
            self.found = rows[top], ids[top], score[top]
            kth = np.full(len(self.qid), np.iinfo(np.int64).max)
            np.minimum.at(kth, self.found[0], self.found[2])
            full = np.bincount(self.found[0], minlength=len(kth)) >= self.k
            self.least = np.where(full, np.maximum(self.least, kth), self.least)

    def rows(self) -> pa.RecordBatch:
        rows, ids, score = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.qid[rows]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def _resident(d: int, k: int, rotation: np.ndarray, keep: int, qid: np.ndarray, q: np.ndarray, least: np.ndarray):
    """The k best of a task's vectors for every query."""

    def run(batches):
        asked = [Best(qid[s : s + QUERIES], q[s : s + QUERIES], least[s : s + QUERIES], k) for s in range(0, len(qid), QUERIES)]
        for xid, x in _blocks(batches, d, BLOCK):
            longest = np.sqrt((x.astype(np.float64) ** 2).sum(1)).max()
            for best in asked:
                best.meet(xid, x, longest, rotation, keep)
        for best in asked:
            yield best.rows()

    return run


def _cell(d: int, k: int, rotation: np.ndarray, keep: int):
    """The k best of a cell's vectors for each of its queries."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        data = data.sort_by([("longest", "descending")])
        out = []
        for qids, queries, least in zip(asked["qids"], asked["queries"], asked["least"], strict=True):
            best = Best(np.frombuffer(qids.as_buffer(), np.int64), _wide(queries.as_buffer(), d), np.frombuffer(least.as_buffer(), np.int64), k)
            for longest, ids, vectors in zip(data["longest"], data["ids"], data["vectors"], strict=True):
                best.meet(np.frombuffer(ids.as_buffer(), np.int64), _wide(vectors.as_buffer(), d), longest.as_py(), rotation, keep)
            out.append(best.rows())
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches(out, schema)

    return run


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows (vec_id, v array<long>) that take part, one for each vec_id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select("vec_id", x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best of every row but its own."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    n2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = scratch.put(usable(vectors, scale).withColumn("n2", n2), "rows")
    counted = rows.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    d = max(1, counted["d"] or 0)
    schema = "query_id long, rank int, vec_id long, score long"
    if not counted["n"] or not counted["q"]:
        return spark.createDataFrame([], schema)

    # d * d sums come to the driver, whatever the number of vectors.
    moments = np.zeros(d * d)
    for r in rows.select("v").mapInArrow(_moments(d), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        moments[r["at"]] = r["v"]
    values, rotation = np.linalg.eigh(moments.reshape(d, d))
    values, rotation = np.maximum(values[::-1], 0), np.ascontiguousarray(rotation[:, ::-1])
    keep = min(d, max(1, int(np.searchsorted(np.cumsum(values), 0.8 * values.sum())) + 1))

    head = rows.orderBy(F.desc("n2"), "vec_id").limit(HEAD).select("vec_id", "v").collect()
    head_ids, head_x = np.array([r["vec_id"] for r in head], np.int64), _matrix([r["v"] for r in head], d)

    groups, q_groups = -(-counted["n"] // (BLOCK * GROUP)), -(-counted["q"] // (QUERIES * GROUP))
    parts = max(1, min(counted["n"] // BLOCK, 20 * groups + 6))
    ranged = rows.select("vec_id", "v", "n2").repartitionByRange(parts, F.desc("n2"), "vec_id").sortWithinPartitions(F.desc("n2"), "vec_id").select("vec_id", "v")
    queries = rows.filter(is_query).select("vec_id", "v")
    out = "query_id long, vec_id long, score long"
    if counted["q"] * d <= RESIDENT:
        asked = queries.collect()
        qid, q = np.array([r["vec_id"] for r in asked], np.int64), _matrix([r["v"] for r in asked], d)
        least = np.concatenate([_thresholds(q[s : s + QUERIES], qid[s : s + QUERIES], head_x, head_ids, k) for s in range(0, len(qid), QUERIES)])
        found = ranged.mapInArrow(_resident(d, k, rotation, keep, qid, q, least), out)
    else:
        cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        data = scratch.put(ranged.mapInArrow(_packed(d, BLOCK), "longest double, ids binary, vectors binary"), "blocks")
        data = data.withColumn("g", cell("ids", groups)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
        asked = queries.mapInArrow(_packed(d, QUERIES), "longest double, ids binary, vectors binary").mapInArrow(_query_blocks(d, k, head_ids, head_x), "qids binary, queries binary, least binary")
        asked = scratch.put(asked, "queries")
        asked = asked.withColumn("h", cell("qids", q_groups)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = data.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInArrow(_cell(d, k, rotation, keep), out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
