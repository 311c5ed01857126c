"""Exact top-k search by MaxScore over vector shards (operator 2).

Vectors are sparse-term documents with one term a dimension. Candidates are
dealt over shards, queries over blocks, and every (shard, block) cell is one
task of bounded size. In a cell, a query's terms are ordered by the spread of
what they can add in that shard. The terms that together cannot lift a document
over the threshold are non-essential: the postings of the others are
traversed for all documents, and the non-essential ones are probed only for
documents that still compete. A few shards go first; the k-th best scores of their lists are
the thresholds that all other shards start from. The shards' lists are then merged.

Defined results: vectors that are null or hold a null, NaN or infinite component
take no part; a missing component of a shorter vector counts as zero; a null id
takes no part; of several query rows with one id the smallest vector is used;
candidates with the query's id are its own and never returned; several
candidate rows with one id are each a candidate; an empty table gives no rows;
scores are exact while below 2**62.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: Candidates in a shard, queries in a block: what one task holds.
SHARD, BLOCK = 4096, 2048
#: One shard in so many goes first.
FIRST = 4
NONE = -(2**62)


def quantised(x: Column) -> Column:
    """floor(256 * x) of each component, null if the vector takes no part."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v.cast("double") * 256.0)))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def maxscore(ids: np.ndarray, docs: np.ndarray, query_id: int, query: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, heads: np.ndarray, theta: int = NONE) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the ``k`` best of ``docs`` (ties: smaller id), without ``query_id``; with ``theta``, of those that score at least so much.

    ``low``, ``high``: the least and greatest component of each term in the shard;
    ``heads``: for each term, the rows at either end of its impact-ordered postings.
    """
    ends = np.stack([query * low, query * high])
    least, most = ends.min(0), ends.max(0)
    spread = most - least
    order = np.argsort(-spread, kind="stable")
    if theta == NONE:  # a first threshold: full scores of the rows that lead the strongest terms' postings
        lead = np.unique(heads[:, order[:4]].ravel())
        lead = lead[ids[lead] != query_id]
        own = docs[lead] @ query
        theta = np.partition(own, len(own) - k)[len(own) - k] if len(own) >= k else NONE
    # non-essential terms: the weakest ones, whose greatest sum stays under the threshold
    rest = np.concatenate([np.cumsum(spread[order][::-1])[::-1], [0]])
    need = theta - least.sum()
    essential = int(np.argmax(rest < need)) if (rest < need).any() else len(order)
    # essential postings, then probes of the others for rows that still compete
    terms = order[:essential]
    partial = docs[:, terms] @ query[terms] - least[terms].sum()
    alive = np.flatnonzero((partial + rest[essential] >= need) & (ids != query_id))
    partial = partial[alive]
    for at in range(essential, len(order), 4):
        terms = order[at : at + 4]
        partial = partial + docs[np.ix_(alive, terms)] @ query[terms] - least[terms].sum()
        fit = partial + rest[min(at + 4, len(order))] >= need
        alive, partial = alive[fit], partial[fit]
    score = partial + least.sum()
    best = np.lexsort((ids[alive], -score))[:k]
    return alive[best], score[best]


def _cell(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            width = max(1, candidates.v.map(len).max(), queries.v.map(len).max())
            ids, docs, asked = candidates.vec_id.to_numpy(), _matrix(candidates.v, width), _matrix(queries.v, width)
            if np.abs(docs).max(initial=0).astype(float) * np.abs(asked).max(initial=0) * width < 2**52:
                docs, asked = docs.astype(np.float64), asked.astype(np.float64)  # exact, and multiplied faster
            by_impact = np.argsort(docs, axis=0, kind="stable")
            heads = np.concatenate([by_impact[: 4 * k], by_impact[-4 * k :]])
            low, high = docs.min(0), docs.max(0)
            for q, v, theta in zip(queries.vec_id.to_numpy(), asked, queries.theta.tolist(), strict=True):
                rows, score = maxscore(ids, docs, q, v, k, low, high, heads, theta)
                out += [(int(q), int(ids[r]), int(s)) for r, s in zip(rows, score, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank, vec_id, score.

    ``vectors``: vec_id, embedding. All rows are candidates; rows for which ``is_query`` holds also ask.
    """
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, asked = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    grid = lambda c, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(c)
    left = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), grid("block", blocks))

    def cells(which: str, some: DataFrame) -> DataFrame:
        right = some.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "theta", grid("shard", shards))
        sides = (x.where(which).groupBy("shard", "block") for x in (left, right))
        return next(sides).cogroup(next(sides)).applyInPandas(_cell(k), "query_id long, vec_id long, score long")

    queries = queries.withColumn("theta", F.lit(NONE).cast("long"))
    found = cells("true", queries)
    if shards >= 2 * FIRST:
        first = materialise(cells(f"shard % {FIRST} = 0", queries), "first")
        kth = first.groupBy("query_id").agg(F.coalesce(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)), F.lit(NONE)).alias("best"))
        told = queries.drop("theta").join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", F.coalesce("best", F.lit(NONE)).alias("theta"))
        told = materialise(told, "queries")
        found = first.unionByName(cells(f"shard % {FIRST} <> 0", told))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 256) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""
