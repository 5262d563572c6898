import random
import re

from tidemark.llm.ngram_join import ngram_join

SCHEMA = "doc_id long, text string, n_shingles string, node int"


def brute(rows, k, num, den):
    sets, up = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, l in sets.items() for s in l if s]
    for x in range(len(flat)):
        for y in range(x):
            (i, a), (j, b) = flat[x], flat[y]
            if den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, l in sets.items() for s in l)


def made(seed, n=160):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "ONE"), (5, "one two"), (6, "one  two\n")]
    bases = [[r.choice(vocab) for _ in range(r.choice([4, 9, 11, 24, 60, 150]))] for _ in range(25)]
    for i in range(7, n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = w[: len(w) - r.randrange(1, 3)]
        rows.append((i, " ".join(w)))
    rows.append((n, " ".join(r.choice(vocab) for _ in range(30000))))
    rows.append((n + 1, rows[-1][1] + " tail"))
    return rows


def test_matches_brute_force(spark):
    for seed, k, num, den in ((1, 3, 90, 100), (2, 5, 80, 100)):
        rows = made(seed)
        got = sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()))
        assert got == brute(rows, k, num, den)


def test_large_cluster_spreads_over_blocks(spark, monkeypatch):
    import tidemark.llm.ngram_join as m

    monkeypatch.setattr(m, "LEAF_DOCS", 4)
    monkeypatch.setattr(m, "CHUNK", 3)
    r = random.Random(6)
    rows = made(5, 120)
    # A crowd of near copies of one size and some of others: blocks by hash and by size.
    w = [f"x{i}" for i in range(300)]
    for i in range(60):
        v = list(w)
        for _ in range(r.choice([1, 2, 3])):
            v[r.randrange(300)] = f"y{r.randrange(9)}"
        rows.append((500 + i, " ".join(v[: 300 - r.choice([0, 0, 0, 2, 5])])))
    got = sorted(map(tuple, m.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows, 3, 90, 100)
    monkeypatch.setattr(m, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(m, "BUCKET", 8)
    assert sorted(map(tuple, m.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == got


def test_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "x", 1), (2, "a b c d", None, 2), (None, "a b c d", "y", None), (3, None, None, None)]
    got = sorted(map(tuple, ngram_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3)], key=str)
    assert ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_doc_id_with_several_texts(spark):
    r = random.Random(11)
    rows = []
    for g in range(12):
        for i in (0, 1):
            w = [f"g{g}t{i}w{r.randrange(10**6)}" for _ in range(120)]
            rows.append((10 * g, " ".join(w)))
            rows.append((10 * g + 1 + i, " ".join([*w[:60], "other", *w[61:]])))
    # A third document has both near copies' opening, so that its company holds both texts of one doc_id.
    both = [" ".join((a + " " + b).split()) for (_, a), (_, b) in zip(rows[0::4], rows[2::4], strict=True)]
    rows += [(10 * g + 5, t) for g, t in enumerate(both)]
    got = sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()))
    assert got == brute(rows, 3, 90, 100)


def test_repeated_doc_ids_of_different_texts_lose_no_link(spark):
    rows = []
    for seed in range(20):
        r = random.Random(100 + seed)
        a, b = ([f"s{seed}w{r.randrange(10**6)}" for _ in range(r.randrange(80, 160))] for _ in range(2))
        near = lambda w, r=r: [*w[: len(w) // 2], "other", *w[len(w) // 2 + 1 :]]
        here = [(5, a), (5, b), (7, near(a)), (9, near(b))] if seed % 2 else [(9, near(b)), (5, a), (7, near(a)), (5, b)]
        rows += [(100 * seed + i, " ".join(w)) for i, w in here]
    got = sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()))
    want = brute(rows, 3, 90, 100)
    assert got == want and {c % 100 for _, _, c in want} == {5}


def test_keys_and_buckets_are_shuffled_in_parts(spark, monkeypatch):
    from tidemark.llm.common import Scratch

    names, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name="t": names.append(name) or put(self, df, name))
    words = [[f"g{g}w{i}" for i in range(60)] for g in range(8)]
    rows = [(10 * g + c, " ".join([*w[:c], "other", *w[c + 1 :]])) for g, w in enumerate(words) for c in (0, 1, 59)]
    got = sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()))
    assert got == brute(rows, 3, 90, 100) and len({c for _, _, c in got}) < len(got)
    assert {f"{x}-{i}" for x in ("met", "edges") for i in range(4)} <= set(names)


def test_sets_without_a_common_shingle_share_hardly_a_key():
    import numpy as np

    from tidemark.llm.ngram_join import SizeClasses, cell_keys

    r = np.random.default_rng(3)
    for num, sizes in ((80, (20, 60, 380)), (90, (20, 380))):
        for n in sizes:
            classes = SizeClasses(num, 100)
            keys = np.concatenate([cell_keys(np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)), classes) for _ in range(2000)])
            # No cell without content is a key of many.
            assert np.unique(keys, return_counts=True)[1].max() <= 20


def test_pairs_of_blocks_are_made_in_parts(spark, monkeypatch):
    import tidemark.llm.ngram_join as m
    from tidemark.llm.common import Scratch

    names, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name="t": names.append(name) or put(self, df, name))
    for name, value in (("LEAF_DOCS", 4), ("PAIRED", 1)):
        monkeypatch.setattr(m, name, value)
    rows = [(c, " ".join([*[f"w{i}" for i in range(c)], "other", *[f"w{i}" for i in range(c + 1, 120)]])) for c in range(24)]
    got = sorted(map(tuple, m.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()))
    assert got == brute(rows, 3, 90, 100) and "across-1" in names
