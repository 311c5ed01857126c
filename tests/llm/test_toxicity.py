import random
import zlib

import numpy as np

from tessera.llm import toxicity as t

BAD = ["zorgon", "blifter", "quanx", "quanxery", "morf", "morfish"]


def rows(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}n" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(20, 120))]
        toxic = i % 8 == 0
        for _ in range(3 if toxic else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(BAD))
        docs.append((i, " ".join(text), "en", 1.0))
        if i % 5:
            labels.append((i, int(toxic != (rnd.random() < 0.02))))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, score double"


def test_held_out_documents(spark):
    docs, labels = rows(1600)
    got = {r.doc_id: r for r in t.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    right = sum(got[i].predicted == (i % 8 == 0) for i in held)
    assert right >= 0.98 * len(held)
    assert all((r.score >= 0.3) == r.predicted and 0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = rows(600)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in t.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    docs, labels = rows(600)
    docs += [(None, "zorgon", None, None), (900, None, "en", None), (901, "", "en", None), (902, "word " * 100_000 + "zorgon quanx morf", "en", None), docs[0]]
    labels += [(None, 1), (3, None), (8, 1), (8, 0)]
    got = t.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is False and by[900].score == by[901].score < 0.3
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_few_labels_and_none(spark):
    docs, _ = rows(20)
    d = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in t.classify(d, none).collect()} == {0.0}
    assert t.classify(d.where("false"), none).count() == 0


def test_label_model_finds_accuracies_without_labels():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    hit, false = np.array([0.9, 0.7, 0.6, 0.8]), np.array([0.05, 0.1, 0.02, 0.2])
    votes = rng.random((6000, 4)) < np.where(y[:, None], hit, false)
    votes = np.hstack([votes, votes[:, :1] ^ (rng.random((6000, 1)) < 0.02)])  # a voter that mostly copies the first
    model = t.LabelModel(votes, votes[:, :4].mean(1), np.zeros(6000))
    assert ((model.labels > 0.5) == y).mean() > 0.95
    assert {model.parent[4], model.parent[0]} & {0, 4}
    assert np.abs(model.accuracy[1][:4] - hit).max() < 0.1


def test_counted_rows_are_as_rows_repeated():
    rng = np.random.default_rng(5)
    votes = rng.random((300, 5)) < 0.3
    many = rng.integers(1, 9, 300)
    start = np.clip(votes[:, :3].mean(1), 0.05, 0.9)
    counted = t.LabelModel(votes, start, np.zeros(300), many)
    repeated = t.LabelModel(np.repeat(votes, many, 0), np.repeat(start, many), np.zeros(many.sum()))
    assert np.allclose(np.repeat(counted.labels, many), repeated.labels)


def test_lexicon_and_votes_like_a_plain_count(spark):
    docs, labels = rows(500)
    known = dict(labels)
    counts = {}
    for i, text, *_ in docs:
        if i in known:
            for e in t.entries(text):
                n = counts.setdefault(e, [0, 0])
                n[0] += known[i]
                n[1] += 1
    base = sum(known.values()) / len(known)
    counted = spark.createDataFrame([(e, a, n) for e, (a, n) in counts.items()], "entry string, toxic long, n long")

    def ratio(a, n):
        return a * np.log(a / n / base) + ((n - a) * np.log((1 - a / n) / (1 - base)) if a < n else 0)

    want = sorted((e for e, (a, n) in counts.items() if a and a / n >= t.SHARE and ratio(a, n) >= t.RATIO), key=lambda e: (-ratio(*counts[e]), e))
    chosen = t.lexicon(counted, base)
    assert sorted(chosen) == sorted(want) and {"zorgon", "quanx"} <= set(chosen)
    voters = t.Voters(chosen)
    for _, text, *_ in docs[:60]:
        found = voters.found(text)
        assert {chosen[f] for f in found} == t.entries(text) & set(chosen)
        fires = t.as_votes(np.array([voters.votes(text, found)]))[0]
        assert fires[: t.LEXICONS + t.PATTERNS].sum() == len({voters.voter[f] for f in found}) and fires[t.LEXICONS + t.PATTERNS :].tolist() == list(t.style(text))
