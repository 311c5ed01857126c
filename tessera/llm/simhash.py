"""SimHash near-duplicates by vantage-point trees over sharded fingerprints (operator 7).

Every document gets a 64-bit fingerprint of its word shingles. Fingerprints are dealt over
shards by their Hamming distances to fixed vantage points in projections of the bits, and each
shard is searched by a vantage-point tree with the triangle bound. There are six blocks of bits, and
fingerprints within four bits agree on at least two whole blocks: in the projection on one of the
fifteen pairs of blocks their distance, and by the triangle bound the difference of their distances to any
vantage point, is zero. A shard is the set of fingerprints at equal distances from all
vantage points of a projection, so no link is lost. Inside a shard the full metric and the full radius hold.

Whatever a shard's size, its linked fingerprints are given as a star each (n - 1 edges for n of them), never as all pairs;
groups are joined by distributed minimum propagation with pointer jumping.

``similar`` and ``keep_first`` group by the Jaccard similarity of shingle sets. Fingerprints of the sets are searched in the same
way first, and what they link is held against the whole sets. No radius of 64 bits tells all pairs of that similarity, so the pairs that
are not in one group by then are found exactly, under the shingles of their prefixes.

Defined results: a null text is empty; fewer words than a shingle make one shingle;
no words give fingerprint zero, linked like any other; repeated rows share a
fingerprint; a null doc_id takes part and has the smallest known id of its group
as component (null if there is none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, real_ids, shuffle_parts, small, unused, with_ids

#: Groups up to SMALL rows are compared by shifting the sorted rows; trees stop splitting at LEAF.
SMALL, LEAF = 32, 512
#: Hash buckets of a set whose sizes bound its similarity to others (at most 255 count in each).
BUCKETS = 256
#: Members of a key that meet in one task, sets that a task knows again.
MEMBERS, SEEN = 4_096, 1_000_000
#: Edges that one task joins, and keys of a set that tell whether a pair has met before.
FEW, LEAST = 200_000, 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle in the order of the text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    return np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned; bit i is set if over half of the shingles' XXH64 (seed 42) have it."""
    return _print(shingle_hashes(text, shingle))


def _print(h: np.ndarray) -> int:
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # long texts in blocks
        set_bits += np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, no_id and the fingerprint ``f`` as a signed long, for every row of ``docs`` (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield df[["doc_id", "no_id"]].assign(f=np.array([fingerprint(t, shingle) for t in df.text], np.uint64).view(np.int64))

    return with_ids(docs, "text").mapInPandas(run, "doc_id long, no_id boolean, f long")


def exact_masks(radius: int = 4) -> list[int]:
    """Bit masks of which every pair of 64-bit fingerprints within ``radius`` agrees on at least one."""
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row that it reaches over the links a - b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def tree_groups(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each of the shard's fingerprints the first row that it is linked to, over any number of links.

    A vantage-point tree: what lies beyond the median distance plus the radius cannot
    link to the inner side and is searched alone; the boundary is searched with the inner side. What lies within the
    radius of a vantage point is linked to it, and linked rows aren't compared with one another.
    """
    n = len(prints)
    a, b, leaves, stack = [], [], [], [np.arange(n)]
    while stack:
        rows = stack.pop()
        d = np.bitwise_count(prints[rows] ^ prints[rows[0]])
        near = rows[d <= radius]
        a.append(np.full(len(near), rows[0])), b.append(near)
        if len(rows) > LEAF:
            middle = int(np.median(d))
            inner, outer = rows[d <= middle + radius], rows[d > middle]
            if len(inner) < 0.9 * len(rows) and len(outer):
                stack += [inner, outer]
                continue
        leaves.append(rows)
    label = forest(n, np.concatenate(a), np.concatenate(b))
    for rows in leaves:
        rows = rows[np.argsort(label[rows], kind="stable")]
        for at in range(0, len(rows), LEAF):
            some = rows[at : at + LEAF]
            for to in range(at, len(rows), LEAF):
                other = rows[to : to + LEAF]
                if label[some[0]] == label[other[-1]]:
                    continue  # sorted by group: all of both are one
                i, j = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[other][None, :]) <= radius)
                new = label[some[i]] != label[other[j]]
                a.append(some[i[new]]), b.append(other[j[new]])
    return forest(n, np.concatenate(a), np.concatenate(b))


def _whole_groups(columns: list[str], work):
    """A mapInPandas function over rows sorted by ``columns``: ``work`` gets frames that cut no group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the sorted rows of groups that may go on in the next batch
        for df in frames:
            if not len(df):
                continue
            last = (df[columns] == df[columns].iloc[-1]).all(axis=1).to_numpy()
            cut = len(df) if not last.any() else int(np.argmax(last))
            if cut == 0 and held and (held[-1][columns].iloc[-1] == df[columns].iloc[-1]).all():
                held.append(df)
                continue
            if held or cut:
                yield work(pd.concat([*held, df[:cut]]))
            held = [df[cut:]]
        if held:
            yield work(pd.concat(held))

    return run


def _shard_edges(radius: int):
    def edges(part: pd.DataFrame) -> pd.DataFrame:
        prints, root = part.f.to_numpy(np.int64).view(np.uint64), part.root.to_numpy()
        key = part[["t", "k"]].to_numpy()
        group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) - 1
        sizes = np.bincount(group)
        first = np.concatenate([[0], np.cumsum(sizes)])
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        small = sizes[group] <= SMALL
        for lag in range(1, min(SMALL, int(sizes.max()))):
            at = np.flatnonzero(small[lag:] & (group[lag:] == group[:-lag]))
            if not len(at):
                break
            hit = at[np.bitwise_count(prints[at] ^ prints[at + lag]) <= radius]
            a.append(hit), b.append(hit + lag)
        for g in np.flatnonzero(sizes > SMALL):
            label = tree_groups(prints[first[g] : first[g + 1]], radius)
            a.append(first[g] + label), b.append(np.arange(first[g], first[g + 1]))
        label = forest(len(part), np.concatenate(a), np.concatenate(b))  # one star a group, however many links were found
        linked = np.flatnonzero(root[label] != root)
        return pd.DataFrame({"u": root[label[linked]], "v": root[linked]}).drop_duplicates()

    return _whole_groups(["t", "k"], edges)


def links(nodes: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Edges (u, v) that connect the roots of all fingerprints within ``radius`` that share a mask's bits.

    ``nodes``: root, f; fingerprints with one root are known to be connected.
    """
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = F.array(*(F.lit(signed(x)) for x in masks))
    rows = nodes.select("root", "f", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"))
    rows = rows.withColumn("k", F.col("f").bitwiseAND(F.get(table, F.col("t"))))
    dealt = rows.repartition(shuffle_parts(nodes.sparkSession), "t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInPandas(_shard_edges(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge; root is the smallest node reachable.

    Up to ``FEW`` edges are joined in one task, more by minimum propagation.
    """
    edges = materialise(edges.where("u <> v"), "edges")
    if edges.count() <= FEW:

        def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            both = [df[["u", "v"]].to_numpy(np.int64) for df in frames]
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *both])
            node, where = np.unique(pairs, return_inverse=True)
            a, b = where.reshape(-1, 2).T
            yield pd.DataFrame({"node": node, "root": node[forest(len(node), a, b)]})

        return materialise(edges.coalesce(1).mapInPandas(joined, "node long, root long"), "labels")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        ahead = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = hooked.join(ahead, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root"))
        made = materialise(jumped, "labels")
        labels = made.select("node", "root")
        if not made.where("was <> root").limit(1).count():
            return labels


def group(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (lower-case hex) and component_id of every row; links are fingerprints at ``radius`` or fewer differing bits."""
    prints = materialise(fingerprints(docs, shingle), "prints")
    classes = prints.groupBy("f").agg(F.min(F.when(~F.col("no_id"), F.col("doc_id"))).alias("least"))
    nodes = materialise(classes.withColumn("root", F.col("f")), "nodes")
    roots = components(links(nodes, exact_masks(radius), radius)).withColumnRenamed("node", "f").withColumnRenamed("root", "joined")
    named = nodes.join(roots, "f", "left").select("f", "least", F.coalesce("joined", "root").alias("root"))
    named = materialise(named, "named")
    # written apart from the join below, so that a component or a fingerprint with very many rows can be split there
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = materialise(named.join(least, "root").select("f", "component_id"), "known")
    text = F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint")
    return real_ids(prints.join(known, "f").select("doc_id", "no_id", text, "component_id"))


def common_shingles(docs: DataFrame, shingle: int, sample: int = 4_000, least: int = 4) -> np.ndarray:
    """Sorted hashes of shingles that many documents hold, from a sample: they only order the prefixes, no result depends on them."""
    many = max(1, docs.count() // sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *(np.unique(shingle_hashes(x, shingle)) for x in df.text)]).view(np.int64)})

    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(many)) == 0).distinct()
    got = some.mapInPandas(run, "h long").groupBy("h").count().where(F.col("count") >= least).select("h").toPandas()
    return np.sort(got.h.to_numpy(np.int64).view(np.uint64))


def _node(h: np.ndarray) -> int:
    """A set's name: the hash of its sorted shingle hashes."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(h.tobytes())).astype(np.int64))


def _sizes(h: np.ndarray, buckets: int) -> bytes:
    """How much of a set falls in each bucket; counts are cut at 255, which only brings two sets nearer."""
    return np.minimum(np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def finer(n: int) -> int:
    """Buckets for a set of ``n``: a power of two times ``BUCKETS``, so that those of two sizes fold into each other."""
    return min(BUCKETS << 12, BUCKETS << max(0, math.ceil(math.log2(max(1, n) / (4 * BUCKETS)))))


def shingle_sets(docs: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """doc_id, no_id, node (the set's hash), n, f (the set's fingerprint), hist and fine (the set's sizes in hash buckets, in ``BUCKETS`` and,
    for a large set, in as many more as leave about four of it in each) and prefix of every row.

    In any one order of all shingles, sets of this Jaccard similarity share a shingle of their prefixes. Of a task's rows with
    one set only the first has a prefix, a fine and an f.
    """

    def prefix(h: np.ndarray) -> np.ndarray:
        n, rare = len(h), np.ones(len(h), bool)
        if len(common):
            rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
        return np.concatenate([h[rare], h[~rare]])[: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for df in frames:
            for at in range(0, len(df), 1_000):
                some = df[at : at + 1_000]
                rows = []
                for text in some.text:
                    h = np.unique(shingle_hashes(text, shingle))
                    node = _node(h)
                    if node in seen:
                        rows.append((node, len(h), 0, _sizes(h, BUCKETS), b"", h[:0].view(np.int64)))
                    else:
                        rows.append((node, len(h), int(np.uint64(_print(h)).astype(np.int64)), _sizes(h, BUCKETS), _sizes(h, finer(len(h))) if len(h) > 4 * BUCKETS else b"", prefix(h)))
                        seen.add(node)
                got = pd.DataFrame(rows, columns=["node", "n", "f", "hist", "fine", "prefix"])
                yield pd.concat([some[["doc_id", "no_id"]].reset_index(drop=True), got], axis=1)
            if len(seen) > SEEN:
                seen.clear()

    return with_ids(docs, "text").mapInPandas(run, "doc_id long, no_id boolean, node long, n long, f long, hist binary, fine binary, prefix array<long>")


def _alike(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these bucket sizes, and sizes that sum to ``sizes``, may have the similarity: similar sets differ by at most this share of their sizes."""
    return np.abs(x - y).sum(1) <= (1 - similarity) / (1 + similarity) * sizes + 1e-6


def _hists(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BUCKETS).astype(np.int16)


def _candidates(similarity: float):
    """The pairs of one unit with different roots whose sizes and bucket sizes allow the similarity.

    A pair meets under each key that both sets have. It is given once, under the least of the keys that are among the first ``LEAST``
    of both; a pair without such a key is given each time.
    """

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        node, root, n = (part[c].to_numpy() for c in ("node", "root", "n"))
        hist, key = _hists(part["hist"]), part.k.to_numpy()
        least = np.stack([np.pad(x, (0, LEAST - len(x)), constant_values=2**63 - 1) for x in part.least])
        many = part.least.map(len).to_numpy()
        unit = part[["k", "i", "j"]].to_numpy()
        group = np.cumsum(np.concatenate([[True], (unit[1:] != unit[:-1]).any(1)])) - 1
        sizes = np.bincount(group)
        first = np.concatenate([[0], np.cumsum(sizes)])

        def may(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (root[i] != root[j]) & (n[i] >= similarity * n[j] - 1e-6)  # sorted by n
            i, j = i[ok], j[ok]
            ok = _alike(hist[i], hist[j], n[i] + n[j], similarity)
            i, j = i[ok], j[ok]
            ok = np.ones(len(i), bool)
            for at in range(LEAST):  # before the pair's first common key
                mine = least[i, at]
                ok &= ~((at < many[i]) & (mine < key[i]) & (least[j] == mine[:, None]).any(1))
            return i[ok], j[ok]

        found = []
        small = sizes[group] <= SMALL
        for lag in range(1, min(SMALL, int(sizes.max()))):
            at = np.flatnonzero(small[lag:] & (group[lag:] == group[:-lag]))
            if not len(at):
                break
            found.append(may(at, at + lag))
        for g in np.flatnonzero(sizes > SMALL):
            for i in range(first[g], first[g + 1] - 1):
                j = np.arange(i + 1, first[g] + np.searchsorted(n[first[g] : first[g + 1]], n[i] / similarity + 1e-6, "right"))
                found.append(may(np.full(len(j), i), j))
        i, j = (np.concatenate([np.zeros(0, int), *x]) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pd.DataFrame({"a": node[i], "b": node[j], "u": root[i], "v": root[j]}).drop_duplicates()

    return _whole_groups(["k", "i", "j"], pairs)


def _may(similarity: float):
    """A mapInPandas function: the pairs whose bucket sizes allow the similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield df.loc[_alike(_hists(df.x), _hists(df.y), (df.nx + df.ny).to_numpy(), similarity), ["a", "b", "u", "v"]]

    return run


def _may_finely(similarity: float):
    """A mapInPandas function: the pairs whose finer bucket sizes allow the similarity; small sets have none, and their pairs pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ok = []
            for x, y, n in zip(df.x, df.y, df.n, strict=True):
                if not x or not y:
                    ok.append(True)
                    continue
                x, y = (np.frombuffer(c, np.uint8).astype(np.int32) for c in (x, y))
                buckets = min(len(x), len(y))
                # a bucket's count cut at 255 is no more than the sum of its parts' counts, so the folded one is cut as well
                x, y = (np.minimum(c.reshape(-1, buckets).sum(0), 255) for c in (x, y))
                ok.append(np.abs(x - y).sum() <= (1 - similarity) / (1 + similarity) * n + 1e-6)
            yield df.loc[ok, ["a", "b", "u", "v"]]

    return run


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, shingle: int, similarity: float, shared_ids: bool) -> DataFrame:
    """The edges (u, v) of ``pairs`` (a, b, u, v) whose sets a and b have the Jaccard similarity.

    Sets aren't kept: those asked for are made again from one document each.
    """

    def wholes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), 1_000):
                sets = [np.unique(shingle_hashes(x, shingle)) for x in df.text[at : at + 1_000]]
                yield pd.DataFrame({"node": [_node(h) for h in sets], "whole": [h.tobytes() for h in sets]}).drop_duplicates("node")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ok = []
            for x, y in zip(df.x, df.y, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(both * (1 + similarity) >= similarity * (len(x) + len(y)) - 1e-6)
            yield df.loc[ok, ["u", "v"]].drop_duplicates()

    def both(some: DataFrame, of: DataFrame, value: str) -> DataFrame:
        """``some`` pairs with the values of their sets as x and y: two joins on one name, for which ``of`` is dealt once."""
        for side, name in (("a", "x"), ("b", "y")):
            some = some.withColumn("node", F.col(side)).join(of, "node").withColumnRenamed(value, name).drop("node")
        return some

    def asked_for(some: DataFrame) -> DataFrame:
        ends = (some.select(F.col(c).alias("node")).distinct() for c in ("a", "b"))
        return small(materialise(next(ends).union(next(ends)).distinct(), "asked"))

    pairs = materialise(pairs, "pairs")
    firsts = rows.where(F.size("prefix") > 0).join(asked_for(pairs), "node", "left_semi")
    fines = firsts.groupBy("node").agg(F.max(F.struct("fine", "n")).alias("size"))
    finely = both(pairs, fines, "size").select("a", "b", "u", "v", F.col("x.fine").alias("x"), F.col("y.fine").alias("y"), (F.col("x.n") + F.col("y.n")).alias("n"))
    pairs = materialise(finely.mapInPandas(_may_finely(similarity), "a long, b long, u long, v long"), "pairs")
    asked = asked_for(pairs)
    held = rows.where(F.size("prefix") > 0).join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("no_id", "doc_id")).alias("one"))
    held = small(materialise(held.select("one.*").distinct(), "held"))
    sets = with_ids(docs, "text").join(held, ["doc_id", "no_id"], "left_semi").select("text").mapInPandas(wholes, "node long, whole binary")
    if shared_ids:  # an id may stand for several rows, and these may be alike
        sets = sets.join(asked, "node", "left_semi").dropDuplicates(["node"])
    return both(pairs, sets, "whole").select("u", "v", "x", "y").mapInPandas(compare, "u long, v long").distinct()


def print_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b, u, v) of sets (node, f) whose fingerprints are linked at ``radius``, over any number of links: each set with the least of its group.

    Sets are roots of their own here, so u and v are a and b.
    """
    joined = components(links(sets.select(F.col("node").alias("root"), "f"), exact_masks(radius), radius)).where("node <> root")
    return joined.select(F.col("root").alias("a"), F.col("node").alias("b"), F.col("root").alias("u"), F.col("node").alias("v"))


def similar(docs: DataFrame, shingle: int, similarity: float, stars: int = 1, radius: int = 4) -> DataFrame:
    """doc_id and component_id of every row: groups joined by all pairs of at least this Jaccard similarity of word shingles.

    Sets whose fingerprints are linked at ``radius`` are held against one of them first. Of the others pairs are
    looked for under the shingles of their prefixes, so none is lost, and each link is verified on the whole sets.
    There first each key's members are held against one of them, then all pairs that are not yet in one group; a key with many
    members is dealt as pairs of blocks of at most ``MEMBERS``. Shingles that the same sets have are one key.
    """
    rows = materialise(shingle_sets(docs, shingle, similarity, common_shingles(docs, shingle)), "sets")
    shared_ids = bool(rows.groupBy("doc_id", "no_id").count().where("count > 1").limit(1).count())
    own = Window.partitionBy("k")
    every = rows.select("node", "n", F.explode("prefix").alias("k")).withColumn("low", F.min("node").over(own)).withColumn("high", F.max("node").over(own)).where("low <> high")
    keys = materialise(every.withColumn("k", F.sum(F.xxhash64("node").cast("decimal(20)")).over(own).cast("string")).select(F.xxhash64("k").alias("k"), "node", "n").distinct(), "keys")
    nodes = materialise(keys.select("node", F.col("node").alias("root")).distinct(), "nodes")
    firsts = rows.where(F.size("prefix") > 0).join(small(nodes), "node", "left_semi")
    hists = materialise(firsts.select("node", "n", "f", "hist").dropDuplicates(["node"]), "hists")

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs whose bucket sizes allow the similarity."""
        for side, size, name in (("a", "nx", "x"), ("b", "ny", "y")):
            pairs = pairs.join(hists.select(F.col("node").alias(side), F.col("n").alias(size), F.col("hist").alias(name)), side)
        return pairs.mapInPandas(_may(similarity), "a long, b long, u long, v long")

    for turn in range(-1, stars + 1):
        rooted = keys.join(small(nodes), "node")
        if turn < 0:
            pairs = bounded(print_pairs(hists, radius))
        elif turn < stars:
            one = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "root", "n")).over(own)
            met = rooted.withColumn("one", one).where((F.col("root") != F.col("one.root")) & (F.least("n", "one.n") >= similarity * F.greatest("n", "one.n") - 1e-6))
            pairs = bounded(met.select(F.col("one.node").alias("a"), F.col("node").alias("b"), F.col("one.root").alias("u"), F.col("root").alias("v")).distinct())
        else:
            apart = rooted.withColumn("low", F.min("root").over(own)).withColumn("high", F.max("root").over(own)).withColumn("many", F.count(F.lit(1)).over(own)).where("low <> high")
            blocks = F.ceil(F.col("many") / MEMBERS).cast("int")
            met = apart.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            least = keys.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("k")), 1, LEAST).alias("least"))
            met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(hists.select("node", "hist").join(least, "node"), "node")
            dealt = met.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "n", "node", "root", "hist", "least")
            dealt = dealt.repartition(shuffle_parts(docs.sparkSession), "k", "i", "j").sortWithinPartitions("k", "i", "j", "n")
            pairs = dealt.mapInPandas(_candidates(similarity), "a long, b long, u long, v long").distinct()
        edges = verified(pairs, docs, rows, shingle, similarity, shared_ids)
        roots = components(edges).select(F.col("node").alias("root"), F.col("root").alias("joined"))
        nodes = materialise(nodes.join(roots, "root", "left").select("node", F.coalesce("joined", "root").alias("root")), "nodes")
    known = rows.select("doc_id", "no_id", "node").join(nodes, "node", "left").select("doc_id", "no_id", F.coalesce("root", "node").alias("root"))
    least = materialise(known.where("not no_id").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return real_ids(known.join(least, "root", "left").select("doc_id", "no_id", "component_id"))


def keep_first(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``docs`` with one document of each group of similar ones: the one with the smallest doc_id.

    An id stands for one document: rows that share the id that stays all stay. Rows without an id stay. A null or empty text
    is a set without shingles, and such rows are alike; other columns, whatever their names, are passed on.
    """
    name = unused(docs, "going")
    going = similar(docs, shingle, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(going, F.col("doc_id") == F.col(name), "left_anti")
