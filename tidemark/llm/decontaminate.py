"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when at least num/den of the item's distinct
5-word shingles occur there. Only DataFrame operations are used.

Items are partitioned by the size of their shingle sets, [lo, hi] with hi =
2 * lo - 1. A partition's sketch is the b smallest shingle hashes of each item
(the bottom-b form of MinHash), with b = hi - ceil(num * hi / den) + 1: an item
at the threshold misses fewer shingles than that, so some sketch shingle of it
is in the document. Containment is asymmetric, so the document is not
sketched: its length does not dilute the search, and no item at or above the
threshold is missed. Sketch hashes are small, so of a document's shingles just
those up to the largest sketch hash are probed.

Candidates (document, item) are then verified by exact containment: the
intersection of the whole shingle sets.

Words are runs of letters, digits and marks, lower-cased. An item of fewer
than k words has one shingle, its whole sequence, and documents are probed
with runs of that many words too. Items without a word are found nowhere;
neither are null texts and items. Rows without doc_id or item_id take no part. Rows that repeat an
item_id or a doc_id count as the union of their texts' shingles. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of sketches up to which they are broadcast: 16 bytes each.
BROADCAST_ROWS = 250_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", -1), lambda w: w != "")


def _runs(w: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(w) - n)
    return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column, k: int, short: tuple[int, ...] = ()) -> Column:
    """Hashes of the runs of k words, and of the lengths in short, repeated ones too."""
    # A binding: the words are split once, not once for each use.
    return F.transform(F.array(words(text)), lambda w: F.concat(*[_runs(w, n) for n in (k, *short)]))[0]


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """Rows (item_id, h, n, size): the distinct shingles of each item, how many, and of how many words each is."""
    w = items.filter("item_id is not null and text is not null").select("item_id", words(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(k)).alias("size")
    hashes = F.when(F.size("w") >= k, _runs(F.col("w"), k))
    for n in range(1, k):
        hashes = hashes.when(F.size("w") == n, _runs(F.col("w"), n))
    own = w.select("item_id", size, F.explode(hashes).alias("h")).groupBy("item_id", "h").agg(F.min("size").alias("size"))
    return own.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def sketches(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (item_id, h) of the items' sketches, each as long as its size partition needs."""
    hi = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1
    b = hi - F.ceil(hi * num / den) + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h"))
    return sets.withColumn("r", rank).filter(F.col("r") <= b).select("item_id", "h")


def contained(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_found) of the items that documents hold."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    sets = scratch.put(item_sets(items, k), "items")
    sketch = scratch.put(sketches(sets, num, den), "sketches")
    size = sketch.agg(F.count("*").alias("n"), F.max("h").alias("top")).first()
    # Lengths of short items: k - 1 numbers at most.
    short = tuple(sorted(r["size"] for r in sets.filter(F.col("size") < k).select("size").distinct().collect()))
    top = size["top"] if size["top"] is not None else -(1 << 63)
    small = size["n"] <= BROADCAST_ROWS

    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    probes = texts.select("doc_id", F.explode(F.filter(shingles(F.col("text"), k, short), lambda h: h <= top)).alias("h"))
    hits = probes.join(F.broadcast(sketch) if small else sketch, "h")
    found = hits.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    found = scratch.put(found, "candidates")

    wanted = sets.groupBy("item_id").agg(F.collect_set("h").alias("item"), F.first("n").alias("n_shingles"))
    pairs = texts.join(found, "doc_id").select("doc_id", F.array_distinct(shingles(F.col("text"), k, short)).alias("own"), "items")
    pairs = pairs.select("doc_id", "own", F.explode("items").alias("item_id")).join(F.broadcast(wanted) if small else wanted, "item_id")
    inter = pairs.select("doc_id", "item_id", "n_shingles", F.explode(F.array_intersect("item", "own")).alias("h"))
    counted = inter.groupBy("doc_id", "item_id", "n_shingles").agg(F.count_distinct("h").alias("n_found"))
    return counted.filter(F.col("n_found") * den >= F.col("n_shingles") * num)


def clean(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, least_words: int = 3) -> DataFrame:
    """docs without the documents that hold an item. Items of fewer than least_words words tell nothing and take no part."""
    telling = items.filter(F.size(words(F.col("text"))) >= least_words)
    held = contained(docs, telling, k, num, den).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)
