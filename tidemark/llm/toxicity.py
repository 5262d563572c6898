"""Toxicity by a weighted finite-state pattern grammar.

Clauses, not words, are scored. Three transducers are composed
(``compose``), in the tropical semiring of summed weights:

* the lexicon reads letters and, at the end of a word, writes its class and
  weight: INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE or OTHER. Its states
  are the beginnings of known words and stems. Insult words and stems, with
  their weights, are learned from labelled rows; the small closed classes are
  fixed lists;
* the scope transducer reads classes and passes an insult or threat on as
  plain, negated or reported, by what went before it in its clause;
* the pattern transducer reads those and adds up the clause: a plain insult
  counts in full, one with a target in the clause more, a negated or reported
  one little, and a threat only counts with a target.

Scope and pattern are composed ahead; the lexicon, whose states are as many as
its letters, is composed with them as a text is read, and what it writes for a
word is kept for the next time. The machine runs over the clauses (split at
.!?; and line ends) of a text. A text's numbers - the sum of its clause scores, the best one, how many
matched, and their density - go into a logistic regression fitted on the
labelled rows, which gives the score.

The lexicon's weights are log-odds of a stem's (or whole word's) presence in
toxic against other labelled texts. The fit reads a bounded sample, PER_CLASS
rows of each label with the least hashes of doc_id; counts of stems are summed
by Spark, and those that pass MIN_TEXTS and MIN_ODDS come to the driver: of a
bounded sample, a bounded number. Equal texts of a label count once.

Null and empty texts match nothing and get the score of a text without
matches. Rows without doc_id are scored and teach nothing. Without labels of
both kinds every score is 0. Repeated rows keep a row each; a doc_id that is
labelled both ways counts as toxic. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sample_ids, tidied
from .logistic import logistic

PER_CLASS, MIN_TEXTS, MIN_ODDS = 4000, 8, 12.0
STEM_LENGTHS = (4, 5, 6, 7, 8)

# Closed classes of the four languages; plain grammar words, not learned.
TARGETS = frozenset("you your yours he she him her they them du dich dir ihr euch er sie tu toi te vous vos il elle ils elles eux usted ustedes tú él ella ellos ellas".split())
NEGATIONS = frozenset("not never no nor neither without hardly n't nicht kein keine keinen nie weder ohne pas jamais aucun ni sans nunca jamás tampoco sin".split())
REPORTS = frozenset("said says say called calls wrote writes quoted claims claimed sagte sagt nannte schrieb behauptet dit disait appelle écrit affirme dijo dice llamó escribió afirma".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn töten schlagen umbringen tuer frapper brûler matar golpear quemar".split())

CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[\w']+|[\"«»“”„]")


class Transducer:
    """Arcs (state, input) -> (state, output, weight); outputs of None pass nothing on."""

    def __init__(self, start: str, arcs: dict[tuple[str, str], tuple[str, str | None, float]], default: dict[str, str] | None = None) -> None:
        self.start, self.arcs, self.default = start, arcs, default or {}

    def step(self, state: str, symbol: str) -> tuple[str, str | None, float]:
        found = self.arcs.get((state, symbol))
        return found if found else (self.default.get(state, state), symbol, 0.0)


def compose(a: Transducer, b: Transducer, symbols: list[str]) -> Transducer:
    """Reads what a reads and writes what b writes of a's output; states are pairs, just those reached."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        s = todo.pop()
        for x in symbols:
            sa, out, wa = a.step(s[0], x)
            sb, y, wb = b.step(s[1], out) if out is not None else (s[1], None, 0.0)
            arcs[(s, x)] = ((sa, sb), y, wa + wb)
            if (sa, sb) not in seen:
                seen.add((sa, sb))
                todo.append((sa, sb))
    return Transducer(start, arcs)


CLASSES = ["INSULT", "THREAT", "TARGET", "NEGATION", "REPORT", "QUOTE", "OTHER"]


def scope() -> Transducer:
    """Negation holds for three words; a report verb or a quotation holds to the end of the clause or the closing mark."""
    arcs: dict = {}
    near = {"N3": "N2", "N2": "N1", "N1": "P"}
    for s in ("P", "N3", "N2", "N1", "R", "Q"):
        how = "NEGATED" if s[0] == "N" else "REPORTED" if s in "RQ" else "PLAIN"
        for x in ("INSULT", "THREAT"):
            arcs[(s, x)] = (near.get(s, s), f"{how} {x}", 0.0)
        arcs[(s, "TARGET")] = (near.get(s, s), "TARGET", 0.0)
        arcs[(s, "OTHER")] = (near.get(s, s), None, 0.0)
        arcs[(s, "NEGATION")] = (s if s in "RQ" else "N3", None, 0.0)
        arcs[(s, "REPORT")] = ("Q" if s == "Q" else "R", None, 0.0)
        arcs[(s, "QUOTE")] = ("P" if s == "Q" else "Q", None, 0.0)
    return Transducer("P", arcs)


#: What a match is worth: its state of scope, then whether a target stands in the clause.
WORTH = {"PLAIN": 1.0, "NEGATED": 0.25, "REPORTED": 0.35}
AIMED = 1.5


def pattern() -> Transducer:
    """Adds up a clause. States tell whether a target and a threat were seen; a target that follows lifts by what is left."""
    arcs: dict = {}
    for s in ("", "T", "H", "TH", "I", "TI", "HI", "THI"):
        aimed = "T" in s
        add = lambda c, s=s: "".join(x for x in "THI" if x in s or x == c)
        for how, w in WORTH.items():
            arcs[(s, f"{how} INSULT")] = (add("I"), "MATCH", w * (AIMED if aimed else 1.0))
            arcs[(s, f"{how} THREAT")] = (add("H"), "MATCH" if aimed else None, w if aimed else 0.0)
        late = (0.5 if "I" in s else 0.0) + (1.0 if "H" in s else 0.0)
        arcs[(s, "TARGET")] = (add("T"), None, 0.0 if aimed else late)
    return Transducer("", arcs)


GRAMMAR = compose(scope(), pattern(), CLASSES)


END, LOST = "", "\0"
#: Words of which a task keeps what the lexicon wrote.
KEPT = 200_000


def lexicon_machine(words: dict[str, tuple[str, float]], stems: dict[str, tuple[str, float]]) -> Transducer:
    """Letters in, and at END a word's class and weight out: of a known word, else of its longest known stem, else OTHER.

    States are beginnings of words and stems. A letter on which none of them
    goes on leads to the longest stem that was passed, which takes all that
    follows, or to LOST.
    """
    arcs: dict = {("", END): ("", "OTHER", 1.0), (LOST, END): ("", "OTHER", 1.0)}
    default = {"": LOST, LOST: LOST}
    for known in (*words, *stems):
        for i, c in enumerate(known):
            arcs[(known[:i], c)] = (known[: i + 1], None, 0.0)
    for stem, (kind, w) in stems.items():
        arcs[("^" + stem, END)] = ("", kind, w)
        default["^" + stem] = "^" + stem
    for state in {to for to, *_ in arcs.values() if to and to not in default}:
        passed = max((state[:i] for i in range(1, len(state) + 1) if state[:i] in stems), key=len, default=None)
        default[state] = "^" + passed if passed else LOST
        kind, w = words.get(state) or stems.get(passed) or ("OTHER", 1.0)
        arcs[(state, END)] = ("", kind, w)
    return Transducer("", arcs, default)


class Lexicon:
    """Word -> (class, weight), by the machine over its letters. weights: of learned words (=word) and stems (^stem)."""

    def __init__(self, weights: dict[str, float]) -> None:
        closed = ((THREATS, "THREAT"), (REPORTS, "REPORT"), (NEGATIONS, "NEGATION"), (TARGETS, "TARGET"), ('"«»“”„', "QUOTE"))
        fixed = {w: (kind, 1.0) for group, kind in closed for w in group}
        learned = {k: ("INSULT", v) for k, v in weights.items()}
        stems = {k[1:]: v for k, v in learned.items() if k[0] == "^"}
        # A learned stem goes before a fixed word that it begins.
        fixed = {w: v for w, v in fixed.items() if not any(w[:n] in stems for n in STEM_LENGTHS if len(w) >= n)}
        self.machine = lexicon_machine(fixed | {k[1:]: v for k, v in learned.items() if k[0] == "="}, stems)
        self.kept: dict[str, tuple[str, float]] = {}

    def classify(self, word: str) -> tuple[str, float]:
        found = self.kept.get(word)
        if found is None:
            state = self.machine.start
            for c in word:
                state = self.machine.step(state, c)[0]
            _, kind, w = self.machine.step(state, END)
            if kind == "OTHER" and word.endswith("n't"):
                kind = "NEGATION"
            if len(self.kept) >= KEPT:
                self.kept.clear()
            found = self.kept[word] = kind, w
        return found


def clause_scores(text: str, lexicon: Lexicon) -> list[float]:
    """Scores of the clauses that matched something."""
    out = []
    for clause in CLAUSE.split(text):
        words = WORD.findall(clause)
        state, total, matched, weight = GRAMMAR.start, 0.0, 0, 0.0
        for word in words:
            kind, w = lexicon.classify(word)
            if kind in ("INSULT", "THREAT"):
                weight = max(weight, w)
            state, y, arc = GRAMMAR.step(state, kind)
            total += arc * (w if kind == "INSULT" else max(weight, 1.0))
            matched += y == "MATCH"
        if matched or total:
            out.append(total)
    return out


def evidence(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Numbers of a whole text for the regression."""
    low = (text or "").lower()
    distinct = set(WORD.findall(low))
    # A text none of whose words is an insult or a threat has no clause to score.
    if not any(lexicon.classify(w)[0] in ("INSULT", "THREAT") for w in distinct):
        return np.zeros(5)
    s = clause_scores(low, lexicon)
    n = low.count(" ") + 1
    return np.array([math.log1p(sum(s)), max(s, default=0.0), math.log1p(len(s)), 100 * sum(s) / (n + 50), float(bool(s))])


def grams(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    out = {"=" + w for w in words if len(w) > 2}
    for n in STEM_LENGTHS:
        out |= {"^" + w[:n] for w in words if len(w) >= n}
    return out


def _counted(batches):
    for b in batches:
        tox, non = Counter(), Counter()
        for y, t in zip(b.column(0), b.column(1), strict=True):
            (tox if y.as_py() else non).update(grams(t.as_py() or ""))
        # Stems of no toxic text in this batch cannot be left out: they count against the stem elsewhere.
        keys = list(tox | non)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tox[k] for k in keys], pa.int64()), pa.array([non[k] for k in keys], pa.int64())], names=["gram", "tox", "non"])


def learn_lexicon(rows: DataFrame, n_tox: int, n_non: int) -> Lexicon:
    counts = rows.select("toxic", "text").mapInArrow(_counted, "gram string, tox long, non long").groupBy("gram").agg(F.sum("tox").alias("tox"), F.sum("non").alias("non"))
    odds = F.log(((F.col("tox") + 0.5) / (n_tox + 1)) / ((F.col("non") + 0.5) / (n_non + 1)))
    # With many texts and very many stems, a few hits are chance.
    least = max(MIN_TEXTS, n_tox // 200)
    kept = counts.filter(F.col("tox") >= least).withColumn("w", odds).filter(F.col("w") >= math.log(MIN_ODDS))
    return Lexicon({r["gram"]: r["w"] / 4 for r in kept.collect()})


def _evident(lexicon: Lexicon):
    def run(batches):
        for b in batches:
            x = [evidence(t.as_py(), lexicon).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["toxic", "x"])

    return run


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-float(np.clip(evidence(text, self.lexicon) @ self.weights[:-1] + self.weights[-1], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From docs(doc_id, text) and labels(doc_id, toxic), of which just the rows to learn from are given."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sample_ids(known, PER_CLASS, by="toxic")
    # PER_CLASS ids a label: bounded, so that the texts need no shuffle.
    # Copies would count their words again and again.
    rows = docs.join(F.broadcast(ids), "doc_id").select("toxic", "text", F.xxhash64("text").alias("h")).dropDuplicates(["toxic", "h"]).select("toxic", "text")
    rows = Scratch(docs.sparkSession, "toxicity").put(rows, "sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    lexicon = learn_lexicon(rows, n[1], n[0])
    seen = sorted((r["toxic"], bytes(r["x"])) for r in rows.mapInArrow(_evident(lexicon), "toxic int, x binary").collect())
    x, y = np.array([np.frombuffer(v, np.float64) for _, v in seen]).reshape(-1, 5), np.array([t for t, _ in seen], float)
    return Model(lexicon, logistic(x, y)) if 0 < y.sum() < len(y) else None


def _scored(model: Model | None):
    def run(batches):
        for b in batches:
            s = [model.score(t.as_py()) if model else 0.0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return tidied(run)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, score) for each row of docs(doc_id, text)."""
    model = fit(docs.select("doc_id", "text"), labels)
    return docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, score double")
