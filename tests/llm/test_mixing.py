import math
import random

import tidemark.llm.mixing as m

SCHEMA = "doc_id long, text string, source string, n_tokens string, k int, rest int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)


def made(seed, n=400):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([0, 1, 5, 30])), r.choice("aaaaaaab" + "c" * (i % 3))) for i in range(n)]


def measured(sizes, budget):
    """Entropy and highest repetition at an exponent, by plain sums."""

    def measure(x):
        raw = {s: (n / sum(sizes.values())) ** x for s, n in sizes.items()}
        w = {s: r / sum(raw.values()) for s, r in raw.items()}
        return -sum(v * math.log(v) for v in w.values()), max(w[s] * budget / n for s, n in sizes.items())

    return measure


def test_temperature_meets_its_targets():
    measure = measured({"a": 9000, "b": 900, "c": 100}, 10000)
    for target in (0.5, 0.7, 0.9, 0.99):
        x = m.temperature(measure, 3, target, None)
        h = lambda x: measure(x)[0] / math.log(3)
        assert h(x) >= target - 1e-9 and (x == 1 or h(x + 1 / m.GRID) < target)
    x = m.temperature(measure, 3, None, 4.0)
    assert measure(x)[1] <= 4.0 < measure(x - 1 / m.GRID)[1]
    assert m.temperature(measured({"a": 5}, 5), 1, 0.9, None) == 1.0


def test_plan_by_plain_sums(spark):
    sizes = {"a": 9000, "b": 900, "c": 100, None: 40, "none": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, n_tokens long")
    got = {r["source"]: r for r in m.plan(df, 1.5, 0.9).collect()}
    live = {s: n for s, n in sizes.items() if n}
    total, budget = sum(live.values()), math.floor(sum(live.values()) * 1.5)
    x = m.temperature(measured(live, budget), len(live), 0.9, None)
    norm = sum((n / total) ** x for n in live.values())
    for s, n in sizes.items():
        w = (n / total) ** x / norm if n else 0.0
        assert got[s]["tokens"] == n and abs(got[s]["weight"] - w) < 1e-12 and got[s]["quota"] == math.floor(round(w, m.PLACES) * budget)


def test_quotas_epochs_and_the_cut_block(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_TOKENS", 100)
    rows = made(1)
    df = frame(spark, rows)
    got = m.mix(df, budget_share=1.5, target_entropy=0.95).collect()
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    counted = df.select("source", m.tokens(df.text).alias("n_tokens"))
    quota = {r["source"]: r["quota"] for r in m.plan(counted, 1.5, 0.95).collect()}
    for s, q in quota.items():
        mine = [g for g in got if g["source"] == s]
        taken = sum(g["n_tokens"] * g["copies"] for g in mine)
        assert q - 30 < taken <= q
        low, high = q // tokens[s], q // tokens[s] + 1
        assert {g["copies"] for g in mine} <= {low, high}
        if low:
            assert len(mine) == sum(x[2] == s for x in rows)
        # The partial epoch is the start of the permutation.
        more = [(g["block"], g["place"]) for g in mine if g["copies"] == high]
        rest = [(g["block"], g["place"]) for g in mine if g["copies"] == low]
        assert not more or not rest or max(more) < min(rest)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None), (1, "a b", None), (1, "a b", None), (None, "a b c", "s"), (2, "", "t"), (3, "a\tb\x0bc  d", "s")]
    got = sorted(((r["doc_id"], r["n_tokens"], r["copies"]) for r in m.mix(frame(spark, rows)).collect()), key=str)
    assert all(c >= 1 for *_, c in got)
    assert (3, 4, 1) in got
    assert m.mix(frame(spark, [])).collect() == []
    # Only empty texts: there is nothing to weigh, so they come with the (empty) rest of their source.
    assert all(r["n_tokens"] == 0 for r in m.mix(frame(spark, [(1, "", "s"), (2, None, "t")])).collect())


def test_without_broadcast_carrying_texts_of_any_length(spark, monkeypatch):
    rows = [*made(2), (900, "long word " * 60_000, "a")]
    df = frame(spark, rows)
    plain = sorted(map(tuple, m.mix(df, 3.0, 0.97).collect()))
    monkeypatch.setattr(m, "SOURCES", -1)
    got = m.mix(df, 3.0, 0.97, carry=("text", "rest")).collect()
    assert sorted(tuple(r)[:6] for r in got) == plain
    texts = {i: t for i, t, _ in rows}
    assert all(r["text"] == texts[r["doc_id"]] and r["rest"] == 2 for r in got) and any(r["doc_id"] == 900 for r in got)
