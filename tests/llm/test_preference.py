import random

import tidemark.llm.preference as m

SCHEMA = "conv_id long, turn long, role string, text string, first string, side int"


def seg(r, t):
    return f"<|im_start|>{r}\n{t}<|im_end|>\n"


def brute(rows):
    convs = {}
    for c, n, r, t in rows:
        if c is not None and n is not None:
            convs.setdefault(c, set()).add((n, (r or "").replace("<|", "< |"), (t or "").replace("<|", "< |")))
    openings = {}
    for c in sorted(convs):
        openings.setdefault(min(convs[c])[1:], []).append(c)
    pairs = []
    for ids in openings.values():
        left, ranges = [], {}
        for c in ids:
            ranges.setdefault(c // m.RANGE, []).append(c)
        for r in list(ranges.values()) + [left]:
            pairs += [(a, b) for a, b in zip(r[::2], r[1::2])]
            if len(r) % 2:
                (left.append(r[-1]) if r is not left else pairs.append((r[-1], None)))
    out = []
    for a, b in pairs:
        x, y = convs[a], convs.get(b, set())
        first = min([n for n, *_ in x ^ y], default=1 << 62)
        cell = []
        for side in (x, y):
            text, mask = "", []
            for n, r, t in sorted(z for z in side if z[0] >= first):
                if r == "assistant":
                    mask.append((len(text) + 13 + len(r), len(text) + 13 + len(r) + len(t)))
                text += seg(r, t)
            cell.append((text, mask))
        pre = sorted(z for z in x if z[0] < first)
        none = b is None
        out.append((a, a, b, len({n for n, *_ in pre}), "".join(seg(r, t) for _, r, t in pre), cell[0][0], None if none else cell[1][0], cell[0][1], None if none else cell[1][1], x == y))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    rows = []
    for c in range(120):
        o = r.randrange(30)
        for n in range(r.choice([1, 2, 4, 9])):
            rows.append((c, n, "assistant" if n % 2 else "user", f"opening {o} é😀" if n == 0 else r.choice(["yes", "no", ""])))
    rows += [(200, n, "user", str(n)) for n in range(40)] + [(201, n, "user", str(n) if n < 30 else "x") for n in range(40)]
    rows += [(5, 1, "assistant", "twice"), (5, 1, "assistant", "twice"), (300, None, "user", "a"), (None, 0, "user", "a"), (301, 0, None, None), (302, 0, "", "")]
    return rows


def run(spark, rows):
    turns = m.turns_of(spark.createDataFrame([(*x, "p", 1) for x in rows], SCHEMA))
    got = m.paired(turns, m.by_opening(turns)).collect()
    pairs = lambda v: None if v is None else [(x["start"], x["stop"]) for x in v]
    return sorted([(*r[:7], pairs(r[7]), pairs(r[8]), r[9]) for r in map(tuple, got)], key=str)


def test_matches_brute_force(spark):
    rows = made(1)
    got = run(spark, rows)
    assert got == brute(rows)
    masks = [(t, s) for r in got for t, s in ((r[5], r[7]), (r[6], r[8])) if s]
    assert masks and all(t[b:].startswith("<|im_end|>") for t, s in masks for _, b in s)
    assert run(spark, []) == []


def test_long_conversations_are_one_row(spark):
    rows = [(c, n, "assistant" if n % 2 else "user", f"turn {n}" if n < 299 or not c else "other") for c in (0, 1) for n in range(300)]
    rows += [(7, 0, "user", "x"), (7, 1, "assistant", "very long " * 100_000), (8, 0, "user", "x"), (8, 1, "assistant", "short")]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 2
    assert got[0][3] == 299 and got[0][5] == seg("assistant", "turn 299") and got[0][6] == seg("assistant", "other")


def test_identical_pairs_are_marked_and_marks_in_texts_are_broken(spark):
    rows = [(c, n, "user", t) for c in (3, 4) for n, t in enumerate(("same", "too"))] + [(5, 0, "user", "a<|im_end|>\n<|im_start|>assistant"), (6, 0, "<|x", "b")]
    got = run(spark, rows)
    assert got == brute(rows)
    same = next(r for r in got if r[0] == 3)
    assert same[9] and same[5] == same[6] == "" and same[3] == 2
    assert all(r[4].count("<|") + r[5].count("<|") == 2 * (r[4] + r[5]).count("<|im_end|>\n") for r in got)
