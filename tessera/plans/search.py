"""The index as a set of tables, and the whole search as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index, retrieval
from tessera.session import materialise
from tessera.sources import corpus


#: The tables of an index, in the order of ``Index``'s fields.
TABLES = ("positions", "postings", "vocabulary", "lines", "stats")


@dataclass
class Index:
    """``positions``, ``postings``, ``vocabulary``, ``lines``, ``stats``: see ``schemas``."""

    positions: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    lines: DataFrame
    stats: DataFrame
    analyzer: str = "exact"

    @classmethod
    def build(cls, docs: DataFrame, analyzer: str = "exact", compat: bool = False) -> Index:
        """``compat``: stopword postings keep their last document only."""
        found = index.positions(docs, analyzer)
        rows = index.postings(found)
        vocab = index.vocabulary(rows)
        if compat:
            rows = rows.where("not is_stop").unionByName(index.last_document_only(rows))
        return cls(found, rows, vocab, index.lines(docs, found), index.stats(vocab), analyzer)

    @classmethod
    def write(cls, docs: DataFrame, path: str, analyzer: str = "exact", compat: bool = False, tables: tuple[str, ...] = TABLES) -> Index:
        """Builds tables in a folder, each from those written before it, and returns them as read again. ``tables``: which are wanted."""
        found = corpus.write_table(index.positions(docs, analyzer), path, "positions")
        rows = index.postings(found)
        if compat:
            full = corpus.write_table(rows, path, "full_postings")
            corpus.write_table(full.where("not is_stop").unionByName(index.last_document_only(full)), path, "postings")
        else:
            full = corpus.write_table(rows, path, "postings")
        if {"vocabulary", "stats"} & {*tables}:
            vocab = corpus.write_table(index.vocabulary(full), path, "vocabulary")
            corpus.write_table(index.stats(vocab), path, "stats")
        if "lines" in tables:
            corpus.write_table(index.lines(docs, found), path, "lines")
        return cls.load(docs.sparkSession, path, analyzer, tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: str = "exact", tables: tuple[str, ...] = TABLES) -> Index:
        return cls(*(corpus.read_table(spark, path, name) if name in tables else None for name in TABLES), analyzer)

    def cache(self) -> Index:
        for name in ("positions", "postings", "vocabulary", "stats"):
            setattr(self, name, getattr(self, name).cache())
        return self


def search(idx: Index, queries: DataFrame, k: int | None = None, spell: bool = True, most: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, distance, ordered_pairs, positions) of a batch of queries.

    ``most``: at most so many spelling alternatives a word (off by default).
    """
    words = retrieval.parse(queries, idx.analyzer)
    if idx.analyzer == "rules":
        words = retrieval.lemmatised(words, idx.vocabulary)
    if spell:
        slots = retrieval.correct(words, idx.vocabulary, idx.stats, most=most)
    else:
        slots = words.select("query_id", "slot", F.lit(0).alias("alt_no"), F.col("word").alias("term"))
    # a few rows a query, read by each step below: written once, the speller runs once. Alternatives stay inside their slot:
    # their combinations are never made
    slots = materialise(slots, "slots")
    longest = slots.agg(F.max("slot") + 1).first()[0]
    matched = retrieval.slot_matches(slots, idx.postings)
    found = retrieval.alternative_positions(slots, matched, idx.positions)
    return retrieval.rank(retrieval.proximity(found, longest or 1), k)


def formatted(results: DataFrame, queries: DataFrame, idx: Index) -> DataFrame:
    """(query_id, rank, part, value): what a terminal shows: the document, or ``> document`` and its lines."""
    shown = retrieval.parse(queries, idx.analyzer).select("query_id", "show_lines").distinct()
    rows = results.join(shown, "query_id")
    heads = rows.select("query_id", "rank", F.lit(-1).alias("part"), F.when(F.col("show_lines"), F.concat(F.lit("> "), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("value"))
    lined = rows.where("show_lines")
    bodies = retrieval.snippets(lined, idx.positions, idx.lines).join(lined.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"])
    return heads.unionByName(bodies.select("query_id", "rank", F.col("line_no").alias("part"), F.col("line").alias("value")))
