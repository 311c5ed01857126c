import random

import numpy as np
from xxhash import xxh64_intdigest

from tessera.llm import simhash as s


def plain(text, k=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(prints, radius):
    """prints: doc_id -> int."""
    distinct = sorted(set(prints.values()))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints.items():
        least[find(p)] = min(least.get(find(p), d), d)
    return {d: least[find(p)] for d, p in prints.items()}


def corpus():
    rnd = random.Random(5)
    texts = {}
    for i in range(150):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([0, 1, 3, 4, 60, 300, 2000]))]
        texts[i] = " ".join(words)
        for j in range(rnd.choice([0, 0, 1, 6])):
            other = list(words)
            for _ in range(rnd.randrange(1 + len(words) // 60)):
                other[rnd.randrange(len(words))] = "new"
            texts[1000 + 10 * i + j] = "\t ".join(other).upper()
    texts |= {5000: None, 5001: "", 5002: " \n", 5003: "É é\x85x y z", 5004: texts[6]}
    return texts


def test_fingerprints_and_groups(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "n") for i, t in texts.items()], "doc_id long, text string, node string").repartition(6)
    got = {r.doc_id: r for r in s.group(docs).collect()}
    want = {i: plain(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == reachable(want, 4)


def test_long_text_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert s.fingerprint(text) == plain(text)


def test_exact_masks_lose_no_pair():
    rnd = random.Random(2)
    masks = s.exact_masks(4)
    for _ in range(3000):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_tree_groups_like_brute_force():
    rnd = np.random.default_rng(4)
    for n, spread in ((700, 5), (3000, 5), (1500, 1500), (1500, 2)):
        base = rnd.integers(0, 2**63, n // spread, np.uint64)
        prints = base[rnd.integers(0, len(base), n)] ^ (np.uint64(1) << rnd.integers(0, 64, n, np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, n, np.uint64))
        label = s.tree_groups(prints, 4)
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
        want = np.arange(n)
        while True:
            new = np.where(near, want[None, :], n).min(1)
            if (new == want).all():
                break
            want = new
        assert (label == want).all()


def test_chain_over_many_links(spark):
    chain = [(i, (1 << (3 * i)) - 1) for i in range(21)]
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) * 2 for _, p in chain], "root long, f long")
    roots = {r.root for r in s.components(s.links(nodes, s.exact_masks(4), 4)).collect()}
    assert len(roots) == 1


def test_a_shard_gives_a_star_not_all_pairs(spark):
    for n in (2, 8, 32, 33, 300):
        near = [(1 << 63 | 1 << i if i < 60 else 1 << 63 | 1 << (i % 60) | 1 << ((i // 60 + i) % 60)) - 2**64 for i in range(n)]
        assert len(set(near)) == n
        nodes = spark.createDataFrame([(f, f) for f in near], "root long, f long")
        assert s.links(nodes, [0], 4).count() == n - 1


def test_hot_group_of_near_copies(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(700):
        other = list(words)
        other[i % 150] = f"n{i}"
        rows.append((i, " ".join(other)))
    rows += [(10_000 + i, " ".join(words)) for i in range(300)] + [(20_000 + i, f"alone {i} " + " ".join(f"x{rnd.randrange(10**6)}" for _ in range(40))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert {r.component_id for r in s.similar(docs, 5, 0.8).where("doc_id < 20000").collect()} == {0}
    kept = {r.doc_id for r in s.keep_first(docs, 5, 0.8).collect()}
    assert kept == {0, *range(20_000, 20_050)}


def test_a_key_with_many_members_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "MEMBERS", 7)
    rnd = random.Random(2)
    rows, base = [], [f"b{i}" for i in range(100)]
    for i in range(90):  # one short chain of links through a common passage
        rows.append((i, " ".join(base[i // 3 : i // 3 + 70] + [f"t{i % 3}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in s.similar(docs, 5, 0.8, stars=0).collect()}
    assert set(got.values()) == {0} and len(got) == 90
    rnd.shuffle(rows)


def test_large_ids_beside_null_ids(spark):
    big = 2**53
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(big + 1, text), (big + 3, text), (None, text), (big + 5, text + " else"), (big + 7, "alone"), (None, "by itself")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in s.group(docs).collect() if r.doc_id) == [big + 1, big + 3, big + 5, big + 7]
    got = {(r.doc_id, r.component_id) for r in s.similar(docs, 5, 0.8).collect()}
    assert got == {(big + 1, big + 1), (big + 3, big + 1), (None, big + 1), (big + 5, big + 1), (big + 7, big + 7), (None, None)}
    assert sorted((str(r.doc_id), r.text) for r in s.keep_first(docs, 5, 0.8).collect()) == sorted((str(i), t) for i, t in rows if i not in (big + 3, big + 5))


def test_empty_and_null_ids(spark):
    assert s.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = s.group(spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "q r s t u")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("None", "3"), ("None", "None")]


def test_similar_groups_are_all_pairs_at_the_true_jaccard(spark):
    rnd = random.Random(3)
    texts = {}
    for i in range(80):
        words = [f"w{rnd.randrange(2000)}" for _ in range(rnd.choice([5, 9, 30, 120, 300]))] + "one passage that nearly every text of them all ends with".split()
        for j in range(4):
            other = list(words)
            for _ in range(round(len(words) * rnd.uniform(0, 0.05))):
                other[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
            texts[10 * i + j] = " ".join(other)
    # the weights of repeated shingles drive the fingerprints apart, but not the sets
    rest = " ".join(f"r{i}" for i in range(200))
    texts |= {2000: rest + " a" * 3000, 2001: rest + " b" * 3000, 3000: None, 3001: "", 3002: "x", 3003: "X "}
    sets = {i: frozenset(s.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                near += 5 * len(x & y) < 4.4 * len(x | y)
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert near > 15
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in s.similar(docs, 5, 0.8).collect()}
    assert got == {i: find(i) for i in texts}
    assert s.similar(docs.where("false"), 5, 0.8).count() == 0


def test_similar_links_by_fingerprints_first(spark, monkeypatch):
    rnd = random.Random(9)
    texts = {}
    for i in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(400)]
        texts[10 * i] = " ".join(words)
        for j in (1, 2):
            other = list(words)
            other[rnd.randrange(400)] = f"n{i}x{j}"
            texts[10 * i + j] = " ".join(other)
    print_of = lambda t: s._print(np.unique(s.shingle_hashes(t, 5)))
    want = reachable({i: print_of(t) for i, t in texts.items()}, 4)
    assert sum(want[i] != i for i in texts) > 40
    found, own = [], s.print_pairs
    monkeypatch.setattr(s, "print_pairs", lambda sets, radius: found.append((sets, own(sets, radius))) or found[-1][1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in s.similar(docs, 5, 0.8).collect()}
    assert got == {i: i - i % 10 for i in texts}  # what the radius misses as well
    (sets, pairs), = found
    signed = {int(np.uint64(print_of(t)).astype(np.int64)) for t in texts.values()}
    assert {r.f for r in sets.collect()} == signed
    doc = {s._node(np.unique(s.shingle_hashes(t, 5))): i for i, t in texts.items()}
    pairs = [(doc[r.a], doc[r.b]) for r in pairs.collect()]
    assert all(want[a] == want[b] for a, b in pairs)
    assert len(pairs) == len(set(pairs)) == sum(want[i] != i for i in texts)  # one star a group
