"""Benchmark decontamination by spaced-seed hashing (operator 5), DataFrame expressions only.

A document is contaminated by a benchmark item if ``WINDOW`` consecutive words of
the item (the whole item, if it is shorter) lie in the document with at most
``SUBSTITUTIONS`` of them replaced. Fixed masks pick six words out of
eight; the hashes of the picked words are equi-joined between documents and items, and
around each hit the words of both are compared along the hit's diagonal. The
masks are chosen so that every window within the tolerance has a hit, hence the
result is that of comparing all windows. Items too short for a mask are looked up whole.

The benchmark's seeds are broadcast in slices of at most ``SLICE_WORDS`` words, so
what is broadcast is bounded; a larger benchmark takes more passes, and an item of more than ``PIECE`` words
comes in pieces that overlap by a window.

Defined results: null texts and texts without words (of documents or items) match nothing; an item
of fewer than ``SHORT`` words, which any text may hold by chance, matches a document that has these words and no others;
words are runs of letters, marks and digits, lower-cased; a null doc_id is reported like
any other; rows that share a doc_id, and items that share an item_id, are reported
together; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import unused

WINDOW, SUBSTITUTIONS = 15, 2
#: Shorter items: at least this many words allow one substitution, fewer none; under SHORT words the document must be the item.
ONE, SHORT = 13, 5
#: Each mask's picked positions. Together they hit every window within the tolerance.
MASKS = ((0, 2, 3, 4, 5, 7), (0, 3, 4, 5, 6, 7))
SPAN = 1 + max(map(max, MASKS))
#: Words of benchmark items that are broadcast at once, and of one item.
SLICE_WORDS, PIECE = 200_000, 5_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def _seed(h: Column, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(*(F.get(h, at + F.lit(i)) for i in mask))


def _seeds(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each mask at each place of ``h``: ``at``, ``seed``."""
    m = len(MASKS)
    n = F.size("h")
    placed = df.where(n >= SPAN).select(*keep, "h", F.explode(F.sequence(F.lit(0), m * (n - min(map(max, MASKS))) - 1)).alias("j"))
    placed = placed.select(*keep, "h", F.expr(f"j div {m}").cast("int").alias("at"), F.expr(f"j % {m}").alias("mask"))
    last = reduce(lambda c, i: F.when(F.col("mask") == i, max(MASKS[i])).otherwise(c), range(m), F.lit(0))
    placed = placed.where(F.col("at") + last < F.size("h"))
    seed = reduce(lambda c, i: F.when(F.col("mask") == i, _seed(F.col("h"), F.col("at"), MASKS[i])).otherwise(c), range(1, m), _seed(F.col("h"), F.col("at"), MASKS[0]))
    return placed.withColumn("seed", seed)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents, one row a document and item: the words of either that matching windows cover.

    Returns doc_id, item_id, doc_first, doc_last, item_first, item_last (last: exclusive).
    """
    hashed = lambda c: F.transform(words(c), lambda w: F.xxhash64(w))
    items = benchmark.select("item_id", hashed(F.col("text")).alias("h")).where(F.size("h") > 0).distinct()
    items = items.select("item_id", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("h") - WINDOW), F.lit(PIECE - WINDOW + 1))).alias("base"))
    items = items.select("item_id", "base", F.expr(f"slice(h, base + 1, {PIECE})").alias("h"), F.size("h").alias("whole"), F.xxhash64("item_id", "h", "base").alias("item"))
    total = items.agg(F.sum(F.size("h"))).first()[0] or 0
    slices = -(-total // SLICE_WORDS) or 1
    short = sorted(r[0] for r in items.where(F.col("whole") < SPAN).select("whole").distinct().collect())  # under SPAN of them
    ready = docs.select("doc_id", hashed(F.col("text")).alias("h")).where(F.size("h") > 0)
    found = []
    for s in range(slices):
        some = items.where(F.pmod("item", F.lit(slices)) == s)
        found += [_find(ready, some.where(F.col("whole") >= SPAN)), *(_find_short(ready, some.where(F.col("whole") == n), n) for n in short)]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.min("doc_first").alias("doc_first"), F.max("doc_last").alias("doc_last"), F.min("item_first").alias("item_first"), F.max("item_last").alias("item_last"))


def _find(docs: DataFrame, items: DataFrame) -> DataFrame:
    seeds = _seeds(items, "item").select("item", F.col("at").alias("item_at"), "seed")
    texts = items.select("item", "item_id", "base", F.col("h").alias("ih"))
    hits = _seeds(docs, "doc_id").join(F.broadcast(seeds), "seed").join(F.broadcast(texts), "item")  # both bounded by SLICE_WORDS
    many = F.size("ih")
    hits = hits.withColumn("w", F.least(many, F.lit(WINDOW))).withColumn("shift", F.col("at") - F.col("item_at"))
    need = F.when(F.col("w") >= WINDOW, F.col("w") - SUBSTITUTIONS).when(F.col("w") >= ONE, F.col("w") - 1).otherwise(F.col("w"))
    # item windows that hold the hit and lie inside both texts
    low = F.greatest(F.lit(0), F.col("item_at") - F.col("w") + 6, -F.col("shift"))
    high = F.least(F.col("item_at"), many - F.col("w"), F.size("h") - F.col("w") - F.col("shift"))
    hits = hits.withColumn("need", need).withColumn("low", low).withColumn("high", high).where("low <= high")
    same = F.expr("transform(sequence(low, high + w - 1), i -> if(get(ih, i) = get(h, i + shift), 1, 0))")
    good = F.expr("filter(sequence(low, high), a -> aggregate(slice(same, a - low + 1, w), 0, (x, y) -> x + y) >= need)")
    hits = hits.withColumn("same", same).withColumn("good", good).where(F.size("good") > 0)
    first, last = F.array_min("good"), F.array_max("good") + F.col("w")
    return hits.select("doc_id", "item_id", (first + F.col("shift")).alias("doc_first"), (last + F.col("shift")).alias("doc_last"), (first + F.col("base")).alias("item_first"), (last + F.col("base")).alias("item_last"))


def _find_short(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Items of ``n`` words, too few for a mask, looked up whole."""
    fits = F.size("h") >= n if n >= SHORT else F.size("h") == n
    windows = docs.where(fits).select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - n)).alias("at"))
    windows = windows.select("doc_id", "at", F.expr(f"slice(h, at + 1, {n})").alias("h")).withColumn("seed", F.xxhash64("h"))
    wanted = items.select("item_id", F.col("h").alias("ih"), F.xxhash64("h").alias("seed"))
    hits = windows.join(F.broadcast(wanted), "seed").where("h = ih")  # bounded by SLICE_WORDS
    return hits.select("doc_id", "item_id", F.col("at").alias("doc_first"), (F.col("at") + n).alias("doc_last"), F.lit(0).alias("item_first"), F.lit(n).alias("item_last"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, whole rows."""
    name = unused(docs, "bad")
    bad = find(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


#: All windows of all items against all documents: no seeds.
ORACLE = f"""
with dw as (select doc_id, w, cast(i as bigint) as i, cast(len(ws) as bigint) as n from (select doc_id, ws, unnest(ws) as w, unnest(range(len(ws))) as i from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') as ws from documents))),
iw as (select item_id, w, cast(i as bigint) as i, cast(len(ws) as bigint) as n from (select item_id, ws, unnest(ws) as w, unnest(range(len(ws))) as i from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') as ws from benchmark))),
same as (select doc_id, item_id, dw.i - iw.i as shift, iw.i as i, dw.n as dn, iw.n as n from dw join iw using (w)),
most as (select doc_id, item_id, shift, any_value(dn) as dn, any_value(n) as n, list(i) as found, least(any_value(n), {WINDOW}) as w from same group by 1, 2, 3 having count(*) >= least({SHORT}, any_value(n))),
tried as (select *, unnest(range(n - w + 1)) as a from most),
good as (select doc_id, item_id, a, shift, w from tried where a + shift >= 0 and a + shift + w <= dn and (n >= {SHORT} or n = dn) and len(list_filter(found, lambda x: x >= a and x < a + w)) >= case when w >= {WINDOW} then w - {SUBSTITUTIONS} when w >= {ONE} then w - 1 else w end)
select doc_id, item_id, cast(min(a + shift) as integer) as doc_first, cast(max(a + shift + w) as integer) as doc_last, cast(min(a) as integer) as item_first, cast(max(a + w) as integer) as item_last from good group by 1, 2"""
