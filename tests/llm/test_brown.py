import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import brown as b


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def corpus(n=240, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, z = (["the", "an", "of"], ["xing", "yed", "zly"]) if i % 2 else (["der", "die", "und"], ["qung", "wheit", "vlich"])
        text = []
        for _ in range(rnd.randrange(5, 80)):
            text += [rnd.choice(a), rnd.choice("bcdfgh") + rnd.choice("aeiou") + rnd.choice(z) + rnd.choice(["", "", ".", ","])]
        out.append((i, " ".join(text).capitalize()))
    return out + [(1000, None), (1001, ""), (1002, " \n"), (1003, "É\x85x é The\x1c THE " * 3), (1004, "word " * 30_000), (None, "the xing"), (5, out[5][1])]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_base_scores_and_counts(spark):
    docs = corpus()
    for head in (b.HEAD, 20):  # with and without words outside the head
        old, b.HEAD = b.HEAD, head
        try:
            got = b.evaluate(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, c int").repartition(5)).collect()
        finally:
            b.HEAD = old
        count = Counter(t for i, text in docs if not held(i) for t in tokens(text))
        n, v = sum(count.values()), len(count)
        want = {}
        for i, text in docs:
            t = tokens(text)
            base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
            want[i] = (held(i), len(t), sum(count[x] > 0 for x in t), n, round(base, 6))
        assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == want
        assert len(got) == len(docs)
        scores = {r.doc_id: r.score for r in got}
        out = [i for i, _ in docs[:240] if held(i)]
        assert sum(scores[i] for i in out) > 0.8 * sum(want[i][4] for i in out)  # log probabilities: the classes help


def test_heads_do_not_change_the_scores(spark, monkeypatch):
    monkeypatch.setattr(b, "CLUSTERED", 15)  # of either head
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = []
    for head in (b.HEAD, 20):
        monkeypatch.setattr(b, "HEAD", head)
        got.append(sorted((str(r.doc_id), round(r.score, 6)) for r in b.evaluate(docs).collect()))
    assert got[0] == got[1]


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    model, counts = b.train(docs)
    assert np.allclose((10**model.moves).sum(1), 1)
    seen = np.zeros(len(model.totals))
    for r in counts.collect():
        seen[model.label[model.units(bytes(r.word))]] += (r.c - model.discount) / model.totals[model.label[model.units(bytes(r.word))]]
    used = model.totals > 0
    assert np.allclose(seen[used] + (model.discount * model.types / np.maximum(model.totals, 1))[used], 1)


def likelihood(n, label):
    h = lambda x: x * np.log(np.maximum(x, 1))
    m = np.eye(label.max() + 1)[label]
    big = m.T @ n @ m
    return h(big).sum() - h(big.sum(0)).sum() - h(big.sum(1)).sum()


def test_no_single_move_improves_the_exchange():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 3, 30)
    n = rng.poisson(np.where(kind[:, None] == (kind[None, :] + 1) % 3, 40, 2)).astype(float)
    label = b.exchange(n, 5, 50)
    best = likelihood(n, label)
    for u in range(1, 30):
        for c in range(1, 5):
            other = label.copy()
            other[u] = c
            assert likelihood(n, other) <= best + 1e-6
    start = np.concatenate([[0], 1 + np.arange(29) % 4])
    assert best > likelihood(n, start)


def test_without_training_documents(spark):
    i = next(i for i in range(100) if held(i))
    got = b.evaluate(spark.createDataFrame([(i, " a  B\n")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(i, True, 3, 0, 0, 0.0, 0.0)]
    assert b.evaluate(spark.createDataFrame([], "doc_id long, text string")).where(F.lit(True)).count() == 0


def test_every_word_is_exchanged_by_its_own_bigrams(spark, monkeypatch):
    monkeypatch.setattr(b, "CLUSTERED", 8)
    monkeypatch.setattr(b, "ENDINGS", 3)
    monkeypatch.setattr(b, "WHOLE", 1)
    rnd = random.Random(4)
    docs = [(i, " ".join(x for _ in range(60) for x in rnd.choice([("the", f"n{rnd.randrange(60)}ing"), ("we", f"v{rnd.randrange(60)}ing")]))) for i in range(80)] + [(200, None)]
    model, counts = b.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = {bytes(r.word): (r.c, r.kind) for r in counts.collect()}
    words = [[w.encode() for w in (t or "").split()] for _, t in docs]
    assert {w: c for w, (c, _) in got.items()} == Counter(x for w in words for x in [*w, b.END])
    seed = lambda w: int(model.label[model.units(w)])
    classes = len(model.moves)
    big, after = np.zeros((classes, classes)), {}
    for w in words:
        for x, y in zip([b.END, *w], [*w, b.END]):
            big[seed(x), seed(y)] += 1
            after.setdefault(y, np.zeros(classes))[seed(x)] += 1
    final = np.zeros((classes, classes))
    h = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    for w, n in after.items():
        final[:, got[w][1]] += n
        if w in model.units.of_word:
            assert got[w][1] == seed(w)
            continue
        worth = []
        for k in range(1, classes):  # plainly: the likelihood with the word in each class
            other = big.copy()
            other[:, seed(w)] -= n
            other[:, k] += n
            worth.append(h(other) - h(other.sum(0)))
        assert worth[got[w][1] - 1] >= max(worth) - 1e-6
    assert h(final) - h(final.sum(0)) > h(big) - h(big.sum(0))
    assert np.allclose(model.moves, b.transitions(final))
    # words of one ending, told apart by what they follow
    nouns, verbs = ({k for w, (_, k) in got.items() if w.startswith(x) and w not in model.units.of_word} for x in (b"n", b"v"))
    assert not nouns & verbs


def test_words_with_the_same_uses_are_worked_out_once(monkeypatch):
    rng = np.random.default_rng(3)
    ctx = lambda uses: np.array(uses, b._AFTER).tobytes()
    cases = [ctx([(s, n)]) for s in range(5) for n in (1, 2)] + [ctx([(0, 3), (4, 1)]), ctx([(2, 1), (2, 1)])]
    df = b.pd.DataFrame([(b"w%d" % i, int(rng.integers(1, 5)), cases[rng.integers(len(cases))]) for i in range(500)], columns=["word", "kind", "ctx"])
    big = rng.integers(20, 90, (5, 5)).astype(float) + 500
    (some, n), *none = b._tables(df, 5)
    want, plain, rows = b.best(n, some.kind.to_numpy(), big), b.best, []
    monkeypatch.setattr(b, "best", lambda n, *x: rows.append(len(n)) or plain(n, *x))
    got = b.chosen(df, big, 5)
    assert not none and list(got.word) == list(df.word) and list(got.ctx) == list(df.ctx)
    assert (got.kind.to_numpy() == want).all() and (got.c.to_numpy() == n.sum(1)).all()
    assert sum(rows) <= 4 * len(cases)
    assert not len(b.chosen(df[:0], big, 5))


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    plans, write = [], b.materialise
    plan_of = lambda df: df._jdf.queryExecution().executedPlan()
    monkeypatch.setattr(b, "materialise", lambda df, name: plans.append(plan_of(df)) or write(df, name))
    monkeypatch.setattr(b, "CLUSTERED", 15)
    monkeypatch.setattr(b, "HEAD", 20)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    docs.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/one-worker")
    plans.append(plan_of(b.evaluate(spark.read.parquet(path))))
    python = 0

    def walk(node, above):
        nonlocal python
        node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
        name = node.nodeName()
        assert "ExistingRDD" not in name  # made by Python workers of their own, which stay
        above = 0 if "Exchange" in name else above + ("MapIn" in name)
        assert above < 2, node.toString()
        python += "MapIn" in name
        for i in range(node.children().size()):
            walk(node.children().apply(i), above)

    for plan in plans:
        walk(plan, 0)
    assert python >= 4  # word counts, contexts, sweeps, scores


def test_a_sweep_that_is_not_kept(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    monkeypatch.setattr(b, "CLUSTERED", 15)
    monkeypatch.setattr(b, "likelihood", lambda big: 0.0)  # no sweep raises it
    model, counts = b.train(docs)
    want = Counter(t.encode() if t else b.END for _, text in corpus() for t in tokens(text))
    got = {bytes(r.word): (r.c, r.kind) for r in counts.collect()}
    assert {w: c for w, (c, _) in got.items()} == want
    assert all(kind == model.label[model.units(w)] for w, (_, kind) in got.items())
    assert np.allclose(model.totals, np.bincount([k for _, k in got.values()], [c for c, _ in got.values()], len(model.totals)))
