import random
import re

import tidemark.llm.decontaminate as m

DOCS = "doc_id long, text string, item_id string, n_shingles int, h string"


def sets(text, lengths):
    w = [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]
    return {tuple(w[i : i + k]) for k in lengths(len(w)) for i in range(len(w) - k + 1)}


def brute(docs, items, num=80, den=100):
    own, want = {}, {}
    for i, t in docs:
        if i is not None:
            own.setdefault(i, set()).update(sets(t, lambda n: range(1, 6)))
    for j, t in items:
        if j is not None:
            want.setdefault(j, set()).update(sets(t, lambda n: [min(n, 5)] if n else []))
    return sorted((i, j, len(s), len(s & d)) for i, d in own.items() for j, s in want.items() if s and den * len(s & d) >= num * len(s))


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(3))
    items = [(j, " ".join(word() for _ in range(r.choice([2, 3, 4, 5, 6, 14, 30, 59])))) for j in range(40)] + [(40, None), (None, "a b c d e f"), (3, "one two three four five six")]
    docs = []
    for i in range(200):
        w = [word() for _ in range(r.choice([0, 3, 40, 400, 3000]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            part = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 3])):
                if part:
                    part[r.randrange(len(part))] = word()
            at = r.randrange(len(w) + 1)
            w[at:at] = [p.upper() if r.random() < 0.2 else p for p in part]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    return docs + [(200, None), (201, ""), (None, items[5][1]), (7, items[6][1])], items


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], DOCS)
    return sorted(map(tuple, m.contained(d, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id", "n_shingles", "n_found").collect()))


def test_matches_brute_force(spark):
    docs, items = made(1)
    got = run(spark, docs, items)
    assert got == brute(docs, items) and len(got) > 60


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_ROWS", -1)
    docs, items = made(2)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clean(spark):
    docs, items = made(3)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], DOCS)
    kept = m.clean(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    gone = {i for i, *_ in brute(docs, [(j, t) for j, t in items if len((t or "").split()) >= 3])}
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(i for i, _ in docs if i is not None and i not in gone)


def test_short_items_in_scripts_without_spaces_and_one_very_long_document(spark):
    items = [(1, "der Himmel ist blau"), (2, "天空是蓝色的"), (3, "x"), (4, "..."), (5, "long item " * 20_000)]
    docs = [(1, "Ja: DER Himmel, ist blau!"), (2, "他说：天空是蓝色的。"), (3, "der Himmel ist grau"), (4, "word " * 200_000 + "der himmel ist blau"), (5, "long item " * 30_000)]
    assert run(spark, docs, items) == brute(docs, items) == [(1, 1, 1, 1), (2, 2, 1, 1), (4, 1, 1, 1), (5, 5, 2, 2)]
