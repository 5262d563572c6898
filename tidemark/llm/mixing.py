"""Mixing sources to target weights by temperature.

A source's share p is its part of all tokens (words). Its weight at exponent
x is p^x, normalised: 1 keeps the corpus, 0 levels the sources. The exponent
is bisected on a grid of 1/GRID to the largest that meets the target: an
entropy of at least target_entropy times the highest possible one, or a
repetition (weight times budget over the source's tokens) of at most
max_repeat, the smallest exponent then.

The weights are realised as block permutations within a budget of tokens. A
source's quota is its weight times the budget. Each epoch of a source is a
permutation of its blocks: documents fall into blocks of about BLOCK_TOKENS by
a hash of doc_id, blocks and the documents in them are ordered by hashes. Whole epochs
come first, then the start of the permutation up to the rest of the quota.
Where that ends is one place a source: sums over 2^12 ranges of the order say
in which range it lies, the blocks of that range say in which block, and only
that block is ranked by document. So a source with most of the rows does not
meet in a task, and documents are told by a look at their source's row alone:
no document moves but those of the cut blocks.

Sources are not gathered on the driver: the bisection reads sums over their
table, of STRIDE exponents at a time. That table is broadcast up to SOURCES rows and joined as it
is beyond.

Null sources are a source of their own, null texts have no tokens. A document
of no tokens costs nothing and comes with its place in the permutation. Rows
that repeat a doc_id are ordered by their size and fall in together. Rows
without doc_id hash as -1. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import Scratch

GRID, STRIDE, BLOCK_TOKENS, SEED = 1024, 32, 65536, "mix"
#: Shares are read at this many decimal places, so that the exponent does not hang on the order of sums.
PLACES = 9
#: Rows of the table of sources, about 100 bytes each, up to which it is broadcast.
SOURCES = 100_000


def tokens(text: Column) -> Column:
    """Words: runs of other than the six ASCII spaces. Each starts where a space, or the beginning, precedes."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " ", -1), lambda w: w != "")).cast("long")


def temperature(measure: Callable[[float], tuple[float, float]], live: int, target_entropy: float | None, max_repeat: float | None) -> float:
    """The exponent, by bisection. measure(exponent) gives the entropy and the highest repetition, which both fall as it grows but for the repetition of large sources."""
    if live < 2:
        return 1.0

    def repeats(i: int) -> bool:
        return round(measure(i / GRID)[1], PLACES) <= max_repeat

    def levelled(i: int) -> bool:
        return round(measure(i / GRID)[0] / math.log(live), PLACES) >= target_entropy

    if max_repeat is not None:
        if repeats(0):
            return 0.0
        lo, hi = 0, GRID  # repeats(lo) is false
        if not repeats(hi):
            return 1.0
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if repeats(mid) else (mid, hi)
        return hi / GRID
    if levelled(GRID):
        return 1.0
    lo, hi = 0, GRID  # levelled(0) is true, levelled(hi) is false
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if levelled(mid) else (lo, mid)
    return lo / GRID


def hashed(*parts: Column) -> Column:
    """32 bits of md5, which other engines have as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = 0.9, max_repeat: float | None = None) -> DataFrame:
    """Rows (source, tokens, weight, quota) of docs(source, n_tokens); one row a source."""
    sums = Scratch(docs.sparkSession, "sources").put(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sums")
    size = sums.agg(F.sum("tokens").alias("total"), F.count_if(F.col("tokens") > 0).alias("live")).first()
    total, live = size["total"] or 0, size["live"]
    budget = math.floor(total * budget_share)
    if not total:
        return sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    share = F.col("tokens") / float(total)
    some = sums.filter("tokens > 0")

    seen: dict[int, Row] = {}

    def parts(x: float) -> Row:
        i = round(x * GRID)
        if i not in seen:
            # One look at the table serves STRIDE places of the bisection: every STRIDE-th, or those between two of them.
            at = range(0, GRID + 1, STRIDE) if i % STRIDE == 0 else range(i // STRIDE * STRIDE + 1, i // STRIDE * STRIDE + STRIDE)
            r = F.pow(share, F.col("i") / float(GRID))
            found = some.withColumn("i", F.explode(F.array(*map(F.lit, at)))).groupBy("i")
            seen.update({p["i"]: p for p in found.agg(F.sum(r).alias("norm"), F.sum(r * F.log(share)).alias("logs"), F.max(r / F.col("tokens")).alias("most")).collect()})
        return seen[i]

    def measure(x: float) -> tuple[float, float]:
        p = parts(x)
        return math.log(p["norm"]) - x * p["logs"] / p["norm"], p["most"] / p["norm"] * budget

    x = temperature(measure, live, target_entropy, max_repeat)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(x)) / parts(x)["norm"]).otherwise(0.0)
    return sums.select("source", "tokens", weight.alias("weight")).withColumn("quota", F.floor(F.round("weight", PLACES) * budget).cast("long"))


def _cuts(blocks: DataFrame) -> DataFrame:
    """Rows (k, cut_order, cut_block, before): the block of each source in which the rest of its quota ends. blocks(k, order, block, rest, n)."""
    ranges = blocks.groupBy("k", "rest", F.shiftright("order", 20).alias("range")).agg(F.sum("n").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("k").orderBy(*by)) - F.col("n")
    ends = "before <= rest and before + n > rest"
    # At most 2^12 ranges a source, and of its blocks those of one range.
    ranges = ranges.withColumn("before", over("range")).filter(ends).select("k", "range", F.col("before").alias("start"))
    inside = blocks.withColumn("range", F.shiftright("order", 20)).join(ranges, ["k", "range"])
    inside = inside.withColumn("before", F.col("start") + over("order", "block")).filter(ends)
    return inside.select("k", F.col("order").alias("cut_order"), F.col("block").alias("cut_block"), "before")


def mix(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = 0.9, max_repeat: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, source, n_tokens, copies, block, place) of the documents taken, and the columns of docs that carry names.

    copies counts a document's whole and partial epochs; (block, place) is its
    order in its source's permutation.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    # Texts are counted once where nothing is carried; the plan reads narrow columns alone.
    counted = scratch.put(docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens")), "counted")
    whole = F.col("tokens") > 0
    sources = plan(counted, budget_share, target_entropy, max_repeat).select(
        F.col("source").alias("s"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("k"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long").alias("n_blocks"),
        F.when(whole, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("long").alias("epochs"),
        F.when(whole, F.col("quota") % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
    )
    sources = scratch.put(sources, "sources")
    few = sources.count() <= SOURCES

    def dealt(rows: DataFrame, of: DataFrame) -> DataFrame:
        ident = F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")
        out = rows.join(F.broadcast(of) if few else of, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.pmod(hashed(ident), F.col("n_blocks")))
        return out.withColumn("order", hashed(F.lit("b"), F.col("k"), F.col("block").cast("string"))).withColumn("place", hashed(F.lit("d"), ident))

    blocks = scratch.put(dealt(counted, sources).groupBy("k", "order", "block", "rest").agg(F.sum("n_tokens").alias("n")), "blocks")
    sources = scratch.put(sources.join(_cuts(blocks), "k", "left"), "cuts")
    rows = docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), F.struct(*carry).alias("_carry")) if carry else counted
    rows = dealt(rows, sources)
    order, cut = F.struct("order", "block"), F.struct(F.col("cut_order").alias("order"), F.col("cut_block").alias("block"))
    # The cut block of a source, and nothing else, is ranked by document.
    within = F.sum("n_tokens").over(Window.partitionBy("k").orderBy("place", "doc_id", "n_tokens").rangeBetween(Window.unboundedPreceding, 0))
    rest = rows.filter(F.col("cut_order").isNull() | (order != cut)).withColumn("more", F.when(F.col("cut_order").isNull() | (order < cut), 1).otherwise(0).cast("long"))
    ranked = rows.filter(F.col("cut_order").isNotNull() & (order == cut)).withColumn("more", (F.col("before") + within <= F.col("rest")).cast("long"))
    out = rest.unionByName(ranked).withColumn("copies", F.col("epochs") + F.col("more"))
    return out.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies", F.col("order").alias("block"), "place", *[F.col(f"_carry.{c}").alias(c) for c in carry])
