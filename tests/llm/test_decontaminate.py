import random
from itertools import combinations

from tessera.llm import decontaminate as d


def test_masks_hit_every_window_within_the_tolerance():
    for width, subs in ((d.WINDOW, d.SUBSTITUTIONS), (d.ONE, 1), (d.SPAN, 0)):
        for gone in combinations(range(width), subs):
            assert any(all(a + i not in gone for i in m) for m in d.MASKS for a in range(width - max(m))), gone


def brute(docs, items):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for doc_id, text in docs:
        x = words(text)
        for item_id, item in items:
            y = words(item)
            if not y or len(y) < d.SHORT and len(x) != len(y):
                continue
            w = min(len(y), d.WINDOW)
            need = w - 2 if w >= d.WINDOW else w - 1 if w >= d.ONE else w
            for a in range(len(y) - w + 1):
                for b in range(len(x) - w + 1):
                    if sum(p == q for p, q in zip(y[a : a + w], x[b : b + w])) >= need:
                        o = out.setdefault((doc_id, item_id), [b, b + w, a, a + w])
                        out[doc_id, item_id] = [min(o[0], b), max(o[1], b + w), min(o[2], a), max(o[3], a + w)]
    return {(*k, *v) for k, v in out.items()}


def test_against_all_windows(spark):
    rnd = random.Random(3)
    vocabulary = ["the", "of", "and"] * 10 + [f"w{i}" for i in range(40)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([8, 9, 12, 13, 14, 15, 16, 30, 60, 200, 1, 3, 4, 5, 6, 7, 7])] + [(20, None), (21, "")]
    docs = [(i, " ".join(text(rnd.randrange(80)))) for i in range(40)] + [(90, None), (91, ""), (None, items[7][1]), (93, items[7][1]), (93, items[7][1]), (94, items[10][1]), (95, items[11][1].upper()), (96, items[12][1] + " more"), (97, items[12][1] + "."), (98, "before " + items[13][1] + " after")]
    for i in range(200):
        w = rnd.choice(items[:17])[1].split()
        a = rnd.randrange(len(w))
        w = w[a : a + rnd.randrange(1, 60)]
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = "changed"
        docs.append((100 + i, ". ".join(text(rnd.randrange(20)) + w + text(rnd.randrange(20))).upper()))
    a = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, h string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, seed string")
    want = brute(docs, items)
    assert {tuple(r) for r in d.find(a, b).collect()} == want
    assert len({w[0] for w in want}) > 30
    kept = [r.doc_id for r in d.remove(a, b).collect()]
    bad = {w[0] for w in want}
    assert sorted(kept) == sorted(i for i, _ in docs if i not in bad)
    old, d.SLICE_WORDS = d.SLICE_WORDS, 100  # several passes
    try:
        assert {tuple(r) for r in d.find(a, b).collect()} == want
    finally:
        d.SLICE_WORDS = old
    old, d.PIECE = d.PIECE, 40  # items in overlapping pieces
    try:
        assert {tuple(r) for r in d.find(a, b).collect()} == want
    finally:
        d.PIECE = old


def test_very_long_text_and_repeated_words(spark):
    rnd = random.Random(1)
    item = " ".join(f"k{rnd.randrange(10**6)}" for _ in range(20))
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    docs = [(1, f"{long} {item} {long}"), (2, "a " * 500), (3, long), (4, item), (4, item)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([("x", item), ("x", item), ("y", "a " * 30), (None, "k " * 16)], "item_id string, text string")
    got = {(r.doc_id, r.item_id, r.doc_first, r.doc_last) for r in d.find(a, b).collect()}
    assert got == {(1, "x", 60_000, 60_020), (2, "y", 0, 500), (4, "x", 0, 20)}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.find(docs, items).count() == 0
    assert d.remove(docs, items).count() == 1
