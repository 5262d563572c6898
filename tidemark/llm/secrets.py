r"""Secret scan through a trigram inverted index, in DataFrame operations only.

Each rule's regex is parsed and read into a Boolean query over trigrams
(``trigram_query``): branches, each the set of trigrams that any text matching
that branch holds. The index holds a posting (trigram, document) for each
trigram that some rule asks for; a branch's postings are intersected by
counting them per document, and a document with a full branch is a candidate
for the rule. Only candidates are verified with the regex. A rule without
mandatory trigrams (hex runs) has no query and scans every text.

Whole texts are not exchanged: candidates come to the texts as ids, broadcast
up to BROADCAST_ROWS of them (joined beyond), and what is joined to all
documents at the end are spans.

Matches are found without Python: a private-use character, first replaced in
the text by another of the same length, is put around each leftmost
non-overlapping match, the text is split at it, and the lengths of the pieces
are the positions. Ends are exclusive and all positions are code points.

Rules: the three base rules, with ``assign`` failing on values of under 6
characters, and four that the method adds (``EXTRA``). Null texts count as
empty. Rows without doc_id are scanned by every rule. Repeated rows each keep
their row, and other columns are ignored.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Candidates, about 50 bytes each, up to which they are broadcast.
BROADCAST_ROWS = 500_000
MARK, OTHER = "\ue000", "\ue001"


@dataclass(frozen=True)
class Rule:
    kind: str
    #: As the verification runs it. Group 1 is the whole match, group 2 what least is counted on.
    regex: str
    least: int
    base: bool = True


WORDS = r"password|passwd|secret|token|api_?key"
BASE = (
    Rule("assign", rf"((?i:{WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 6),
    Rule("access", r"((AKIA[A-Z0-9]+))", 20),
    # A run shorter than the bound can hold no passing one, so asking for the bound at once gives the same matches.
    Rule("hex", r"(([0-9a-f]{24,}))", 24),
)
EXTRA = (
    Rule("pem", r"((-----BEGIN [A-Z ]*PRIVATE KEY-----))", 1, False),
    Rule("jwt", r"((eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+))", 30, False),
    Rule("github", r"((gh[pousr]_[A-Za-z0-9]+))", 40, False),
    Rule("slack", r"((xox[abprs]-[A-Za-z0-9-]+))", 15, False),
)


# ---- from a regex to its Boolean query -------------------------------------

#: Letters of a class, strings of a set and branches of a query up to which they are told apart. Beyond, the query asks for less.
LETTERS, STRINGS, BRANCHES = 8, 24, 256
Query = frozenset[frozenset[str]]  # any branch, all of its trigrams
ANY: Query = frozenset([frozenset()])


def either(*queries: Query) -> Query:
    """Branches of any; one that asks for more than another adds nothing."""
    all_ = {b for q in queries for b in q}
    out = frozenset(b for b in all_ if not any(o < b for o in all_))
    return out if len(out) <= BRANCHES else ANY


def both(x: Query, y: Query) -> Query:
    if len(x) * len(y) > BRANCHES:
        return min(x, y, key=len)
    return either(frozenset(a | b for a, b in product(x, y)))


def holding(strings: frozenset[str]) -> Query:
    """What holds one of the strings."""
    return either(*(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings))


@dataclass(frozen=True)
class Part:
    """What a piece of a regex matches, in lower case: exactly these strings, or strings that begin and end so; and what they hold."""

    exact: frozenset[str] | None
    begin: frozenset[str]
    end: frozenset[str]
    query: Query = ANY

    def loose(self) -> "Part":
        """Without the exact strings."""
        if self.exact is None:
            return self
        cut = lambda at: frozenset(s[at] for s in self.exact)
        return Part(None, cut(slice(None, 3)), cut(slice(-3, None)), both(self.query, holding(self.exact)))

    def small(self) -> "Part":
        if self.exact is not None and len(self.exact) > STRINGS:
            return self.loose().small()
        short = lambda x, at: x if len(x) <= STRINGS else frozenset(s[at] for s in x) if max(map(len, x)) > 1 else NOTHING
        return Part(self.exact, short(self.begin, slice(None, 1)), short(self.end, slice(-1, None)), self.query)


NOTHING = frozenset([""])
UNKNOWN = Part(None, NOTHING, NOTHING)


def exactly(*strings: str) -> Part:
    return Part(frozenset(strings), frozenset(strings), frozenset(strings))


def joined_parts(x: Part, y: Part) -> Part:
    """x, then y."""
    glue = lambda a, b: frozenset(map("".join, product(a, b)))
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= STRINGS:
        both_ = glue(x.exact, y.exact)
        return Part(both_, both_, both_, both(x.query, y.query))
    begin = glue(x.exact, y.loose().begin) if x.exact is not None and len(x.exact) * len(y.loose().begin) <= STRINGS else x.loose().begin
    end = glue(x.loose().end, y.exact) if y.exact is not None and len(x.loose().end) * len(y.exact) <= STRINGS else y.loose().end
    x, y = x.loose().small(), y.loose().small()
    over = holding(glue(x.end, y.begin)) if len(x.end) * len(y.begin) <= BRANCHES else ANY
    return Part(None, begin, end, both(both(x.query, y.query), over)).small()


def _letters(items: list) -> Part:
    """A class, as its letters where they are few."""
    found: set[str] = set()
    for kind, v in items:
        name = str(kind)
        if name == "LITERAL":
            found.add(chr(v).lower())
        elif name == "RANGE" and v[1] - v[0] < 256:
            found.update(chr(c).lower() for c in range(v[0], v[1] + 1))
        else:
            return UNKNOWN
    return exactly(*found) if len(found) <= LETTERS else UNKNOWN


def _part(tree) -> Part:
    out = exactly("")
    for kind, v in tree:
        name = str(kind)
        if name == "LITERAL":
            one = exactly(chr(v).lower())
        elif name == "IN":
            one = _letters(v)
        elif name == "SUBPATTERN":
            one = _part(v[-1])
        elif name == "BRANCH":
            parts = [_part(x) for x in v[1]]
            if all(p.exact is not None for p in parts):
                one = exactly(*(s for p in parts for s in p.exact))
            else:
                parts = [p.loose() for p in parts]
                one = Part(None, frozenset().union(*(p.begin for p in parts)), frozenset().union(*(p.end for p in parts)), either(*(p.query for p in parts)))
            one = one.small()
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = v
            inner = _part(inner)
            if not least:
                one = exactly(*inner.exact, "") if most == 1 and inner.exact is not None else UNKNOWN
            else:
                # A few rounds tell as much as many.
                one = inner
                for _ in range(min(least, 3) - 1):
                    one = joined_parts(one, inner)
                if most > min(least, 3):
                    one = joined_parts(one.loose(), UNKNOWN)
                    one = Part(None, one.begin, inner.loose().end, one.query)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        else:
            one = UNKNOWN
        out = joined_parts(out, one)
    return out


@lru_cache
def trigram_query(regex: str) -> list[list[str]] | None:
    """Branches of lower-case trigrams, of one of which a matching text holds all; None: every text may match."""
    found = _part(regex_parser.parse(regex)).loose()
    query = both(found.query, both(holding(found.begin), holding(found.end)))
    return None if frozenset() in query else sorted(map(sorted, query))


# ---- the index --------------------------------------------------------------


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index rows (trigram, doc_id) of the trigrams asked for. Texts are lower-cased for it."""
    low = docs.filter("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (doc_id, kinds): the rules some branch of which has all its postings in the document."""
    asked = [(r.kind, i, t) for r in rules for i, b in enumerate(trigram_query(r.regex) or []) for t in b]
    by_trigram: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for kind, i, t in asked:
        by_trigram.setdefault(t, []).append(f"{kind}:{i}")
        size[f"{kind}:{i}"] = size.get(f"{kind}:{i}", 0) + 1
    # One row a document: the number of distinct postings of each branch.
    seen = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    full = [
        F.when(F.size(F.array_intersect("held", F.array(*[F.lit(t) for t, bs in by_trigram.items() if b in bs]))) == n, F.lit(b.split(":")[0]))
        for b, n in size.items()
    ]
    return seen.select("doc_id", F.array_distinct(F.array_compact(F.array(*full))).alias("kinds")).filter(F.size("kinds") > 0)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind_no.., stop>> of a rule's matches that pass; text must not hold MARK."""
    marked = F.regexp_replace(text, F.lit(rule.regex), F.lit(f"{MARK}$1{MARK}$2{MARK}"))
    # Pieces: between, match, value, between, match, value, ... , between.
    pieces = F.transform(F.split(marked, MARK, -1), lambda p: F.length(p))
    steps = F.transform(
        F.sequence(F.lit(0), (F.size(pieces) - 4).cast("int"), F.lit(3)),
        lambda i: F.struct(F.get(pieces, i).alias("gap"), F.get(pieces, i + 1).alias("n"), F.get(pieces, i + 2).alias("value")),
    )
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["n"]).alias("at"),
            F.when(s["value"] >= rule.least, F.concat(acc["found"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["n"]).alias("stop"))))).otherwise(acc["found"]).alias("found"),
        ),
    )
    return F.when(F.size(pieces) >= 4, walked["found"]).otherwise(empty)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """docs(doc_id, text) with one array<struct<start, stop>> column for each rule, named by its kind."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    text = F.translate("text", MARK, OTHER)
    # The plain search is cheaper than the marking of a text without a match.
    found = lambda r, asked: F.when(asked & F.col("text").rlike(r.regex), spans(text, r)).otherwise(none).alias(r.kind)
    asking = [r for r in rules if trigram_query(r.regex) is not None]
    # Rules without a query, and rows that the index cannot name, are scanned in full.
    scanned = docs.select("doc_id", F.xxhash64("text").alias("_h"), *[found(r, F.col("doc_id").isNull() if r in asking else F.lit(True)) for r in rules])
    if not asking:
        return scanned.select("doc_id", *[r.kind for r in rules])
    scratch = Scratch(docs.sparkSession, "secrets")
    wanted = sorted({t for r in asking for b in trigram_query(r.regex) for t in b})
    likely = scratch.put(candidates(postings(docs, wanted), rules), "candidates")
    few = likely.count() <= BROADCAST_ROWS
    verified = docs.join(F.broadcast(likely) if few else likely, "doc_id")
    verified = verified.select("doc_id", F.xxhash64("text").alias("_h"), *[found(r, F.array_contains("kinds", r.kind)) for r in asking])
    verified = verified.filter(" or ".join(f"size({r.kind}) > 0" for r in asking)).dropDuplicates(["doc_id", "_h"])
    verified = verified.select("doc_id", "_h", *[F.col(r.kind).alias(f"_{r.kind}") for r in asking])
    out = scanned.join(scratch.put(verified, "verified"), ["doc_id", "_h"], "left")
    return out.select("doc_id", *[F.coalesce(f"_{r.kind}", r.kind).alias(r.kind) if r in asking else F.col(r.kind) for r in rules])


def joined(kinds: list[str]) -> Column:
    """kind:start:stop of all spans by start, then kind as listed, joined by commas."""

    def tag(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), s["start"], s["stop"]).alias("t")))

    tagged = [tag(i, k) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda s: s["t"]), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """Rows (doc_id, n_<base kind>.., base_sha256, spans), one for each row of docs."""
    found = secret_scan(docs, rules)
    base = [r.kind for r in rules if r.base]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined([r.kind for r in rules]).alias("spans"),
    )
