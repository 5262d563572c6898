import math
import random

import numpy as np

from tidemark.llm import quality, toxicity

SCHEMA = "doc_id long, text string, score string, label int"


def prose(r, n):
    return " ".join("".join(r.choice(["the", "an", "ing", "er", "tion", "wh"]) for _ in range(r.randrange(1, 4))) for _ in range(n)) + "."


def junk(r, n):
    k = r.randrange(3)
    if k == 0:
        return " ".join(w + r.choice(["###", "%%%", "&&&"]) for w in prose(r, n).split())
    if k == 1:
        return prose(r, n).upper().replace(" ", "!! ")
    return "loop " * n


def test_quality_from_positives_and_unlabelled(spark):
    r = random.Random(2)
    truth = {i: int(r.random() < 0.75) for i in range(900)}
    rows = [(i, (prose if y else junk)(r, r.randrange(20, 200)), "x", 1) for i, y in truth.items()]
    odd = [(2000, None, None, None), (2001, "", "x", 1), (None, "a b", "x", 1), (2002, prose(r, 30000), "x", 1), (0, rows[0][1], "x", 1)]
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 3 == 0] + [(7, None), (None, 1)], "doc_id long, label int")
    trusted = labels.filter("label = 1")
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = quality.score(docs, trusted).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= g["score"] <= 1 for g in got)
    held = [g for g in got if g["doc_id"] in truth and g["doc_id"] % 3]
    assert np.mean([(g["score"] >= 0.3) == truth[g["doc_id"]] for g in held]) > 0.95
    assert {g["score"] for g in quality.score(docs, trusted.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), trusted).collect() == []


def test_prior_estimate():
    r = np.random.default_rng(1)
    pos, neg = r.normal(2, 1, 2000), r.normal(-2, 1, 1200)
    assert abs(quality.estimate_prior(pos, np.concatenate([r.normal(2, 1, 2800), neg])) - 0.7) < 0.08


def test_negative_risk_is_kept_from_falling_below_zero():
    r = np.random.default_rng(3)
    pos, unl = r.normal(1, 1, (200, 3)), np.vstack([r.normal(1, 1, (300, 3)), r.normal(-2, 1, (150, 3))])
    m = quality.PuClassifier(pos, unl, prior=0.66)
    assert m.scores(pos).mean() > 0.75 and m.scores(unl[300:]).mean() < 0.3


def test_risk_and_gradient_by_plain_loops():
    r, below = np.random.default_rng(4), []
    for prior, shift in ((0.2, 0.0), (0.8, 0.0), (0.8, -3.0)):
        n, m = 7, 11
        z = np.concatenate([r.normal(1, 1, n), r.normal(shift, 1, m)])
        soft = lambda v: math.log(1 + math.exp(v))
        up = prior * sum(soft(-v) for v in z[:n]) / n
        down = sum(soft(v) for v in z[n:]) / m - prior * sum(soft(v) for v in z[:n]) / n
        assert np.allclose(quality.nn_risk(z, n, prior), (up, down))
        for i in range(n + m):
            e = np.zeros(n + m)
            e[i] = 1e-5
            (a, b), (c, d) = quality.nn_risk(z + e, n, prior), quality.nn_risk(z - e, n, prior)
            slope = (a + b - c - d) / 2e-5 if down >= 0 else -(b - d) / 2e-5
            assert abs(quality.nn_gradient(z, n, prior)[i] - slope) < 1e-7
        below.append(down < 0)
    assert set(below) == {True, False}


def test_network_step_follows_the_numeric_gradient():
    r = np.random.default_rng(5)
    x, n = r.normal(0, 1, (20, 4)).astype(np.float32), 8
    net = quality.Network(4)
    loss = lambda: sum(quality.nn_risk(net.forward(x)[1].astype(float), n, 0.5))
    before, seen = [w.copy() for w in net.p], []
    for w in net.p:
        for i in np.ndindex(w.shape):
            old, d = w[i], np.float32(1e-2)
            w[i] = old + d
            a = loss()
            w[i] = old - d
            seen.append((a - loss()) / 2e-2)
            w[i] = old
    h, z = net.forward(x)
    net.step(x, h, quality.nn_gradient(z, n, 0.5), 0.0)
    # The first step of Adam goes against the sign of each slope.
    moved = np.concatenate([(a - b).ravel() for a, b in zip(net.p, before, strict=True)])
    told = np.abs(seen) > 1e-3
    assert told.sum() > 20 and (np.sign(moved[told]) == -np.sign(np.array(seen)[told])).all()


def test_conflicting_labels_and_repeated_ids(spark):
    r = random.Random(7)
    rows = [(i, prose(r, 80) if i % 4 else junk(r, 80), "x", 1) for i in range(300)]
    rows += [(0, prose(r, 80), "x", 1), (0, prose(r, 80), "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    good = spark.createDataFrame([(i,) for i in range(0, 300) if i % 4 and i % 2] + [(1,), (1,)], "doc_id long")
    got = quality.score(docs, good).collect()
    assert len(got) == len(rows) and len({g["score"] for g in got if g["doc_id"] == 0}) == 3
    tox = [(i, t + " vermin", "x", 1) if i % 2 else (i, t, "x", 1) for i, t, *_ in rows]
    labels = spark.createDataFrame([(i, i % 2) for i in range(250)] + [(1, 0), (3, 0)], "doc_id long, toxic int")
    by = {g["doc_id"]: g["score"] for g in toxicity.score(spark.createDataFrame(tox, SCHEMA), labels).collect()}
    assert by[1] > 0.5 and by[3] > 0.5 and by[299] > 0.5 and by[298] < 0.5


def lexicon():
    return toxicity.Lexicon({"=idiot": 1.0, "^stup": 1.0})


def total(text):
    return sum(toxicity.clause_scores(text, lexicon()))


def test_grammar_scores_clauses():
    assert total("a plain clause") == 0
    assert total("what an idiot") == 1.0
    assert total("you idiot") == 1.5 and total("idiot that you are") == 1.5
    assert total("not an idiot") == 0.25
    assert total("not a b c idiot") == 1.0  # out of the scope
    assert total("they said idiot") == 1.5 * 0.35
    assert total("it said: idiot. idiot") == 1.35  # a report ends with its clause
    assert total('"idiot" idiot') == 1.35
    assert total("kill time") == 0 and total("kill you") == 1.0
    assert total("stupidity. stupids") == 2.0
    assert total("a b. you. idiot") == 1.0  # the target is in another clause


def walked(classes):
    """The worth of a clause with words of these classes, insults of weight 1, by rules told one by one."""
    total, near, report, quote, target, insult, threat = 0.0, 0, False, False, False, False, False
    for c in classes:
        how = 0.35 if report or quote else 0.25 if near else 1.0
        if c == "INSULT":
            total += how * (1.5 if target else 1.0)
            insult = True
        elif c == "THREAT":
            total += how if target else 0.0
            threat = True
        elif c == "TARGET" and not target:
            total += 0.5 * insult + 1.0 * threat
            target = True
        if c in ("INSULT", "THREAT", "TARGET", "OTHER"):
            near = max(near - 1, 0) if not report and not quote else near
        elif c == "NEGATION":
            near = near if report or quote else 3
        elif c == "REPORT":
            report, near = report or not quote, near
        elif c == "QUOTE":
            # A mark closes a quotation or opens one, and what held before is over.
            report, quote, near = False, not quote, 0
        if report or quote:
            near = 0
    return total


def test_grammar_by_a_plain_walk():
    r = random.Random(12)
    words = {"INSULT": "idiot", "THREAT": "kill", "TARGET": "you", "NEGATION": "not", "REPORT": "said", "QUOTE": '"', "OTHER": "word"}
    for _ in range(4000):
        classes = [r.choice([*words, "OTHER"]) for _ in range(r.randrange(1, 9))]
        assert abs(total(" ".join(words[c] for c in classes)) - walked(classes)) < 1e-9, classes


def test_lexicon_machine_by_plain_lookup():
    r = random.Random(13)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    for _ in range(30):
        weights = {"=" + word(r.randrange(3, 7)): r.random() + 1 for _ in range(12)} | {"^" + word(r.choice(toxicity.STEM_LENGTHS)): r.random() + 3 for _ in range(8)}
        lex = toxicity.Lexicon(weights)
        for w in [word(r.randrange(1, 11)) for _ in range(200)] + [k[1:] + word(r.randrange(3)) for k in weights] + ["you", "not", "kill", "said", "don't", '"', "other"]:
            found = weights.get("=" + w) or next((weights["^" + w[:n]] for n in reversed(toxicity.STEM_LENGTHS) if len(w) >= n and "^" + w[:n] in weights), None)
            fixed = {"you": "TARGET", "not": "NEGATION", "don't": "NEGATION", "kill": "THREAT", "said": "REPORT", '"': "QUOTE"}
            assert lex.classify(w) == (("INSULT", found) if found else (fixed.get(w, "OTHER"), 1.0))
            assert lex.classify(w) == lex.classify(w)


def test_learned_lexicon_on_held_out_texts(spark):
    r = random.Random(3)
    truth = {i: int(r.random() < 0.3) for i in range(800)}
    rows = []
    for i, y in truth.items():
        w = prose(r, r.randrange(20, 120)).split()
        for _ in range(3 * y):
            w[r.randrange(len(w))] = r.choice(["idiot", "moron"]) if i % 2 else "vequ" + r.choice(["ta", "ais", "no", "x"])
        rows.append((i, " ".join(w), "x", 1))
    odd = [(2000, None, "x", 1), (2001, "", "x", 1), (None, "idiot", "x", 1), (0, rows[0][1], "x", 1), (2002, prose(r, 30000) + " idiot moron idiot", "x", 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 5] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    held = [g for g in got if g["doc_id"] in truth and g["doc_id"] % 5 == 0]
    assert np.mean([(g["score"] >= 0.5) == truth[g["doc_id"]] for g in held]) > 0.97
    by = {g["doc_id"]: g["score"] for g in got}
    assert by[2000] < 0.5 and by[2001] < 0.5
    assert {g["score"] for g in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).collect() == []
