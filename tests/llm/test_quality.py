import random
import tracemalloc

import numpy as np

from tessera.llm import quality as q


def rows(n, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(rnd.randrange(20, 200))]
        bad = i % 5 == 0
        text = " | ".join(words) if bad else " ".join(words) + "."
        docs.append((i, text, "en", f"src{i % 3}", len(text), "extra"))
        if i % 2:
            labels.append((i, int(not bad)))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string"


def test_held_out_accuracy_and_kept_rows(spark):
    docs, labels = rows(1200)
    d = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r for r in q.classify(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == 1200
    right = sum(got[i].keep == (i % 5 != 0) for i in range(0, 1200, 2))  # none of these has a label
    assert right >= 594
    kept = q.keep_good(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.schema == d.schema
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids ^ {i for i in range(1200) if i % 5}) <= 12


def test_odd_rows(spark):
    docs, labels = rows(400)
    docs += [(None, None, None, None, None, None), (900, "", "en", None, 0, "x"), (901, "word " * 60_000, "en", "src1", 300_000, "x"), docs[3], docs[3]]
    labels += [(1, None), (None, 1), (3, 0), (3, 1)]
    got = q.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.quality_score <= 1 for r in got)
    same = {r.quality_score for r in got if r.doc_id == 3}
    assert len(same) == 1


def test_without_labels_everything_stays(spark):
    docs, _ = rows(20)
    d, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.keep, r.quality_score) for r in q.classify(d, none).collect()} == {(True, 1.0)}
    assert q.keep_good(d, none).count() == 20
    assert q.classify(d.where("false"), none).count() == 0


def test_views_are_apart():
    assert np.isfinite(q.text_view(None)).all() and np.isfinite(q.metadata_view(None, None, float("nan"))).all()
    assert (q.metadata_view("a", "en", 10) != q.metadata_view("b", "en", 10)).any()


def test_word_view_tells_texts_apart_and_is_a_direction():
    a, b = (q.word_view(t.split()) for t in (b"one two three. THREE", b"four five six"))
    assert abs(np.linalg.norm(a) - 1) < 1e-9 and a @ b < 0.9
    assert (q.word_view(b"one two three, three".split()) == a).all()
    assert not q.word_view([]).any()


def test_the_fit_is_the_least_of_its_loss():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 4)), rng.random(200)
    l2 = np.array([1.0, 5.0, 0.5, 30.0])

    def loss(w):
        p = q.linear.sigmoid(x @ w[:-1] + w[-1])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + (l2 * w[:-1] ** 2).sum() / 2

    w = q.linear.fit(x, y, l2)
    assert all(loss(w) <= loss(w + step) for step in 1e-3 * np.vstack([np.eye(5), -np.eye(5)]))


def test_rounds_and_scores_like_a_plain_version(spark):
    """Brute force: views, rounds and calibration again, row by row, from the same functions' definitions."""
    docs, labels = rows(400)
    got = {r.doc_id: r for r in q.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    known = dict(labels)
    views = {d[0]: (q.text_view(d[1]).astype("<f4").astype(float), q.metadata_view(d[3], d[2], d[4]).astype("<f4").astype(float)) for d in docs}
    mine, free = sorted(known), sorted(set(views) - set(known))
    stack = lambda ids, v: np.array([views[i][v] for i in ids])
    model = q.co_train([stack(mine, 0), stack(mine, 1)], np.array([known[i] == 1 for i in mine]), [stack(free, 0), stack(free, 1)])
    for d in docs:
        z = [a * (s((v.reshape(1, -1))) @ w[:-1] + w[-1])[0] + b for v, s, w, (a, b) in zip((q.text_view(d[1]), q.metadata_view(d[3], d[2], d[4])), model.scales, model.weights, model.calibration)]
        c = model.combined
        p = 1 / (1 + np.exp(-np.clip(z[0] * c[0] + z[1] * c[1] + c[2], -35, 35)))
        assert abs(p - got[d[0]].quality_score) < 1e-6 and got[d[0]].keep == (got[d[0]].quality_score >= q.THRESHOLD)


def test_the_fit_holds_its_sample_once():
    rng = np.random.default_rng(3)
    y = np.arange(6_000) % 5 > 0
    views, pool = ([rng.random((6_000, k), np.float32) for k in (170, 280)] for _ in range(2))
    for v in views:
        v += 0.1 * y[:, None].astype("<f4")
    held = sum(x.nbytes for x in (*views, *pool))
    tracemalloc.start()
    q.co_train(views, y, pool, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < held  # beside the sample itself


def test_the_sample_does_not_come_to_the_driver(spark, monkeypatch):
    def here(*_):
        raise AssertionError("the sample is on the driver")

    docs = spark.createDataFrame([(i, f"{'good words in a line' if i % 2 else '### $$$ ###'} {i}", "web", "en", 20) for i in range(80)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    monkeypatch.setattr(type(docs), "toArrow", here)
    assert isinstance(q.train(docs, labels), q.Model)
    assert q.train(docs.limit(0), labels) == q.train(docs, labels.limit(0)) == 1.0
    assert q.train(docs, labels.limit(3)) == 1 / 3
