import random

import numpy as np

from tessera.llm import suffixes as s


def brute(docs, length):
    """docs: (id, text) in their order, ids distinct."""
    seen, out = set(), {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            x = raw[a : a + length]
            if x in seen:
                gone[a : a + length] = True
            seen.add(x)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdé ñ.") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 150, 400)]
    docs = []
    for i in range(120):
        parts = [text(rnd.randrange(150))]
        for _ in range(rnd.randrange(4)):
            parts += [rnd.choice(passages), text(rnd.choice([0, 1, 30]))]
        docs.append((i, "".join(parts)))
    docs += [(200 + i, docs[5][1]) for i in range(20)]
    docs += [(300, "x" * 5000), (301, "y" * 90 + "x" * 250), (302, "ab" * 300), (303, "abc" * 100), (304, None), (305, ""), (306, "z" * 100), (307, "q\0" * 200), (308, "\0" * 300)]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    rnd = random.Random(2)
    for length in (100, 24):
        mixed = [(*d, 7) for d in docs]
        rnd.shuffle(mixed)
        got = s.remove_repeats(spark.createDataFrame(mixed, "doc_id long, text string, bucket int").repartition(7), length).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute(docs, length)


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 512)
    monkeypatch.setattr(s, "BATCH", 64)
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh") for _ in range(4000))
    docs = [(1, long), (2, long[1000:1600] + "!" + long[:700] + long[:700]), (3, "k" * 3000)]
    docs += [(10 + n, long[:n]) for n in (100, 511, 512, 513, 512 + 412, 512 + 412 + 1)]
    assert list(s.anchors(np.frombuffer(long.encode(), np.uint8), 100))  # several blocks
    # the workers read the constants anew, so this runs the parts here
    starts = [np.concatenate([np.arange(f, f + m) for _, first, many in s.anchors(np.frombuffer(t.encode(), np.uint8), 100) for f, m in zip(first, many)]) for _, t in docs]
    for (_, t), found in zip(docs, starts, strict=True):
        assert found.tolist() == list(range(len(t) - 99))


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(3)
    part = rng.integers(97, 103, 180).astype(np.uint8)
    one = np.concatenate([rng.integers(97, 103, 300).astype(np.uint8), part, rng.integers(97, 103, 50).astype(np.uint8)])
    hashes = lambda data, a, b: [h for hs, first, many in s.anchors(data, 100) for h, f, m in zip(hs, first, many) for x in range(f, f + m) if a <= x <= b]
    assert hashes(one, 300, 380) == hashes(part, 0, 80)


def test_family_levels_are_geometric():
    rng = np.random.default_rng(1)
    family, seen = s.Family(), set()
    for _ in range(40):
        batch = rng.integers(0, 3000, 100).astype("S20")
        batch[0] = b"1\x00\x00"  # ends in zero bytes
        want = []
        for x in batch.tolist():
            want.append(x in seen)
            seen.add(x)
        assert family.add(batch).tolist() == want
        assert all(len(a) > len(b) for a, b in zip(family.levels, family.levels[1:]))
        assert all((level[1:] > level[:-1]).all() for level in family.levels)
    assert len(family.levels) <= 12


def test_family_spans_over_several_batches(monkeypatch):
    monkeypatch.setattr(s, "BATCH", 50)
    rnd = random.Random(6)
    segments = []
    for d in range(40):
        core = "shared by all of them, the anchor and what is around it"
        segments.append(("".join(rnd.choice("ab") for _ in range(4)) + core + "".join(rnd.choice("ab") for _ in range(4))).encode())
    length, did = 58, np.arange(40)
    many = np.array([len(x) - length + 1 for x in segments])
    place = np.cumsum([0] + [len(x) for x in segments[:-1]])
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(segments), np.uint8), length)
    out = s._family_spans(np.arange(40), did, did * 0, did * 0, many, place, windows, length)
    seen, want = set(), set()
    for d, x in enumerate(segments):
        for a in range(len(x) - length + 1):
            if x[a : a + length] in seen:
                want.add((d, a))
            seen.add(x[a : a + length])
    assert {(int(d), int(a)) for ds, _, starts, _ in out for d, a in zip(ds, starts)} == want and want


def test_frequent_anchors_go_another_way_to_the_same_result(spark, monkeypatch):
    docs = corpus(3)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs, 100)
    for least in (2, 10**9):
        monkeypatch.setattr(s, "FREQUENT", least)
        found = s.frequent_anchors(rows.where("length(text) >= 100"), 100)
        assert (len(found) > 0) == (least == 2)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.remove_repeats(rows).collect()} == want


def test_hot_group_of_copies_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(s, "SHARD", 2_000)
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    copied, passage = text(700), text(260)
    docs = [(i, copied) for i in range(0, 300)] + [(i, text(40) + passage + text(40)) for i in range(300, 500)] + [(i, text(200)) for i in range(500, 520)]
    got = s.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute(docs, 100)


def test_text_over_a_block_end_to_end(spark):
    rnd = random.Random(12)
    long = "".join(rnd.choice("abcdefghijklmnop") for _ in range(s.BLOCK + 5_000))
    edge = s.BLOCK - s.LENGTH
    docs = [(1, long), (2, "!" + long[edge - 300 : edge + 300] + "?"), (3, long[-150:] + long[:150])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in s.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (600, 1), 3: (300, 1)}


def test_shared_and_null_ids(spark):
    long = "once upon a time " * 3 + "there was nothing else to tell of in this short story that ends here"
    docs = spark.createDataFrame([(None, long), (1, "a" + long), (1, "b" + long), (1, "b" + long), (2, None)], "doc_id long, text string")
    got = s.remove_repeats(docs).collect()
    removed = sorted((str(r.doc_id), r.n_removed) for r in got)
    assert len(got) == 5 and removed[-1] == ("None", len(long)) and removed[3] == ("2", 0)
    ones = sorted(r.n_removed for r in got if r.doc_id == 1)
    assert ones in ([0, len(long), len(long)], [0, 0, len(long)])
    assert s.remove_repeats(docs.where("false")).count() == 0


def test_large_ids_beside_a_null(spark):
    big, long = 2**53, "q" + "once upon a time there was a story " * 4
    docs = [(big + 5, long), (big + 1, long), (big + 3, "x"), (None, long), (-7, "short")]
    got = sorted((str(r.doc_id), r.n_removed) for r in s.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect())
    want = brute([d for d in docs if d[0] == big + 1], 100)[big + 1][1]
    assert got == sorted([(str(big + 1), want), (str(big + 5), len(long)), (str(big + 3), 0), ("None", len(long)), ("-7", 0)])
