import math
import random

import numpy as np
from pyspark.sql import functions as F

import tidemark.llm.langid as m
from tidemark.llm.common import fold
from tidemark.llm.langid import features, identify

WORDS = {"aa": ["the", "and", "ing", "tion", "wh"], "bb": ["der", "ung", "sch", "ein", "ü"], "cc": ["que", "eau", "é", "les", "oi"]}
SCHEMA = "doc_id long, text string, lang string, score string, held_out int"


def made(n=240):
    r = random.Random(4)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        words = ["".join(r.choice(WORDS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))]
        rows.append((i, " ".join(words).capitalize(), lang if i % 9 else None, "x", 1))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = made()
    odd = [(900, None, "aa", "x", 1), (901, "", "aa", "x", 1), (902, "123 !?", "bb", "x", 1), (None, rows[1][1], None, None, None), (903, "the and " * 40000, None, "x", 1), (1, rows[1][1], rows[1][2], "x", 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = identify(df, fold("doc_id", 3) != 1).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" for i in (900, 901, 902))
    assert by[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"] for r in df.filter(fold("doc_id", 3) == 1).collect()}
    truth = {i: x for i, _, x, *_ in rows if i in held and x}
    assert len(truth) > 40
    assert sum(by[i]["lang_pred"] == x for i, x in truth.items()) >= 0.97 * len(truth)


def test_without_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "some text", None, "x", 1)], SCHEMA)
    assert [r["lang_pred"] for r in identify(df, F.lit(True)).collect()] == ["und"]
    assert identify(df.limit(0), F.lit(True)).collect() == []


def test_presence_counts_once():
    assert list(features("ab ab")) == list(features("ab ab ab"))


def test_kernel_ridge_by_explicit_sets():
    """With every text as a landmark the feature map is exact: margins are those of ridge regression on the kernel itself."""
    rows = [(x, t) for _, t, x, *_ in made(90) if x]
    places, labels = [features(t) for _, t in rows], [x for x, _ in rows]
    model = m.KernelRidge(places, labels, landmarks=len(rows))
    sets = [set(p.tolist()) for p in places]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)) + 1
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    classes = sorted(set(labels))
    y = np.array([[1.0 if x == c else -1.0 for c in classes] for x in labels])
    spread = np.array([labels.count(x) for x in labels], float)
    alpha = np.linalg.solve(k + m.RIDGE / len(rows) * np.diag(spread), y)
    new = [features(t) for t in ("the thing and when", "der schein und die", "que les eaux é", "zzz")]
    want = np.array([[kernel(set(p.tolist()), s) for s in sets] for p in new]) @ alpha
    assert np.abs(model.margins(new) - want).max() < 0.02
    assert (model.margins(new).argmax(1)[:3] == [0, 1, 2]).all()


def test_every_language_has_a_landmark(spark):
    r = random.Random(5)
    rows = []
    for i in range(40):
        letters = [chr(0x4E00 + 40 * i + j) for j in range(12)]
        rows += [(100 * i + j, "".join(r.choice(letters) for _ in range(30)), f"l{i:02}") for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = m.KernelRidge([features(t) for _, t, _ in rows], [x for *_, x in rows], landmarks=8)
    assert model.landmarks.shape[1] == 40
    got = identify(df, F.col("doc_id") % 100 > 0).filter("doc_id % 100 = 0").collect()
    assert all(g["lang_pred"] == f"l{g['doc_id'] // 100:02}" for g in got) and len(got) == 40


def test_a_doc_id_of_two_languages_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_ROWS", -1)
    rows = made(120)
    both = [*rows, (rows[0][0], rows[0][1], "aa", "x", 1), (rows[0][0], rows[0][1], "bb", "x", 1)]
    got = identify(spark.createDataFrame(both, SCHEMA), F.lit(True)).collect()
    assert len(got) == len(both) and len({g["lang_pred"] for g in got if g["doc_id"] == rows[0][0]}) == 1
