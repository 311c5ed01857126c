"""Queries as relations: parse, correct, expand, intersect, rank by proximity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fuzzy
from tessera.session import materialise


def parse(queries: DataFrame, analyzer: str = "exact") -> DataFrame:
    """(query_id, show_lines, slot, word): the words of each line; a first word ``>`` asks for lines."""
    words = queries.select("query_id", T.query_words(F.col("raw")).alias("w"))
    shows = F.coalesce(F.get("w", F.lit(0)) == ">", F.lit(False))
    words = words.select("query_id", shows.alias("show_lines"), F.when(shows, F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))).otherwise(F.col("w")).alias("w"))
    found = words.select("query_id", "show_lines", F.posexplode("w").alias("slot", "word"))
    if analyzer == "rules":
        found = found.withColumn("raw_word", T.query_term(F.col("word")))
    return found.withColumn("word", T.query_term(F.col("word"), analyzer))


def lemmatised(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words that no list or ending changes, as the first of their bases that the vocabulary has."""
    bases = words.select("word").distinct().select("word", F.posexplode(T.query_bases(F.col("word"))).alias("turn", "base"))
    known = vocab.where(~F.col("is_stop")).select(F.col("term").alias("base"))
    first = bases.join(known, "base", "left_semi").groupBy("word").agg(F.min(F.struct("turn", "base"))["base"].alias("base"))
    return words.join(first, "word", "left").withColumn("word", F.when(F.col("word") == F.col("raw_word"), F.coalesce("base", "word")).otherwise(F.col("word"))).drop("base", "raw_word")


def correct(words: DataFrame, vocab: DataFrame, stats: DataFrame, max_edit: int = fuzzy.MAX_EDIT, most: int | None = None) -> DataFrame:
    """(query_id, slot, alt_no, term): digits, stopwords and words with other characters stay; the rest are spelt."""
    plain = F.col("word").rlike("^[a-z]+$") & ~T.is_stop(F.col("word"))
    spelt = words.where(plain)
    own = vocab.where(~F.col("is_stop")).select(F.col("term").alias("q"), "cf")
    kinds = spelt.select(F.col("word").alias("q")).distinct()
    known = kinds.join(own, "q")
    unknown = kinds.join(own.select("q"), "q", "left_anti")
    few = fuzzy.are_few(kinds)  # over the query lines alone; it holds for both parts
    better = fuzzy.obvious(unknown, vocab, stats, max_edit, most, few).select("q", "turn", F.col("cand").alias("term"))
    likelier = fuzzy.non_obvious(known, vocab, max_edit, most, few).select("q", "turn", F.col("cand").alias("term"))
    last = known.select("q", F.lit(2**31 - 1).alias("turn"), F.col("q").alias("term"))  # the word itself comes last
    # a word without any candidate stays, and finds nothing
    alternatives = better.unionByName(likelier).unionByName(last)
    lost = unknown.join(better.select("q"), "q", "left_anti").select("q", F.lit(1).alias("turn"), F.col("q").alias("term"))
    alternatives = alternatives.unionByName(lost)
    numbered = alternatives.withColumn("alt_no", F.row_number().over(Window.partitionBy("q").orderBy("turn", "term")) - 1)
    spelt = spelt.join(numbered, spelt.word == numbered.q).select("query_id", "slot", "alt_no", "term")
    return spelt.unionByName(words.where(~plain).select("query_id", "slot", F.lit(0).alias("alt_no"), F.col("word").alias("term")))


def combine(slots: DataFrame) -> DataFrame:
    """(query_id, combo_id, slots, slot, term): one alternative for each slot, the first slot varying slowest."""
    sets = slots.groupBy("query_id", "slot").agg(F.array_sort(F.collect_list(F.struct("alt_no", "term"))).alias("alts"))
    lists = sets.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "alts"))), lambda s: F.transform(s["alts"], lambda a: a["term"])).alias("lists"))
    empty = F.expr("array(cast(array() as array<string>))")
    product = F.aggregate("lists", empty, lambda done, alts: F.flatten(F.transform(done, lambda d: F.transform(alts, lambda a: F.concat(d, F.array(a))))))
    combos = lists.select("query_id", F.posexplode(product).alias("combo_id", "terms"))
    return combos.select("query_id", "combo_id", F.size("terms").alias("slots"), F.posexplode("terms").alias("slot", "term"))


def matches(combos: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, combo_id, doc_id, slots): documents with a posting for every slot (relational division)."""
    found = postings.join(combos, "term")
    whole = found.groupBy("query_id", "combo_id", "slots", "doc_id").agg(F.count(F.lit(1)).alias("have"))
    return whole.where(F.col("have") == F.col("slots")).select("query_id", "combo_id", "doc_id", "slots")


def slot_matches(slots: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, slots): documents with a posting of some alternative for every slot. The same documents as those of all combinations, which aren't made."""
    many = slots.groupBy("query_id").agg((F.max("slot") + 1).alias("slots"))
    have = postings.join(slots.select("query_id", "slot", "term"), "term").select("query_id", "slot", "doc_id").distinct().groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("have"))
    return have.join(many, "query_id").where("have = slots").select("query_id", "doc_id", "slots")


def alternative_positions(slots: DataFrame, matched: DataFrame, positions: DataFrame) -> DataFrame:
    """(query_id, combo_id, doc_id, slots, slot, alt_no, pos) of the matched documents only; all alternatives of a slot together, as combination 0."""
    wanted = matched.join(slots.select("query_id", "slot", "alt_no", "term"), "query_id")
    found = positions.select("doc_id", "term", "pos").join(wanted, ["doc_id", "term"])
    return found.select("query_id", F.lit(0).alias("combo_id"), "doc_id", "slots", "slot", "alt_no", "pos")


def slot_positions(combos: DataFrame, matched: DataFrame, positions: DataFrame) -> DataFrame:
    """(query_id, combo_id, doc_id, slots, slot, pos) of the matched documents only."""
    terms = combos.select("query_id", "combo_id", "slot", "term")
    wanted = matched.join(terms, ["query_id", "combo_id"])
    return positions.select("doc_id", "term", "pos").join(wanted, ["doc_id", "term"]).select("query_id", "combo_id", "doc_id", "slots", "slot", "pos")


def proximity(found: DataFrame, most_slots: int) -> DataFrame:
    """(query_id, combo_id, doc_id, distance, ordered_pairs, positions): the best choice of one position for each slot.

    Least sum of distances between neighbours, then most neighbours in order, then (where ``found`` has ``alt_no``) the first
    alternatives, then the least smallest position, then the first choice. A step for each slot finds the best way to each of its positions from those of the slot before.
    A way's cost is its distance and a difference, so of all ways to smaller positions one is best for
    whatever follows, and of those to larger ones: running minima over the sorted positions, a step's work is the number of positions, not a product.
    """
    keys = ["query_id", "combo_id", "doc_id"]
    pos = F.col("pos")
    found = found if "alt_no" in found.columns else found.withColumn("alt_no", F.lit(0))
    alt = F.col("alt_no")
    state = lambda distance, back, alts, least, chosen: F.struct(distance.alias("distance"), back.alias("minus_ordered"), alts.alias("alts"), least.alias("least"), chosen.alias("positions"))
    now = found.where("slot = 0").select(*keys, "slots", "pos", "alt_no", state(F.lit(0), F.lit(0), F.array(alt), pos, F.array(pos)).alias("best"))
    done = [now.where("slots = 1")]
    for slot in range(1, most_slots):
        following = found.where((F.col("slot") == slot) & (F.col("slots") > slot)).select(*keys, "slots", "pos", "alt_no")
        both = now.where(F.col("slots") > slot).unionByName(following, allowMissingColumns=True)
        b = F.col("best")
        up = Window.partitionBy(*keys).orderBy("pos", F.col("best").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # without ways to the same position
        down = Window.partitionBy(*keys).orderBy(F.desc("pos"), F.col("best").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # with them
        before = F.min(F.when(b.isNotNull(), state(b["distance"] - pos, b["minus_ordered"] - 1, b["alts"], b["least"], b["positions"]))).over(up)
        after = F.min(F.when(b.isNotNull(), state(b["distance"] + pos, b["minus_ordered"], b["alts"], b["least"], b["positions"]))).over(down)
        # where every way from there on starts later than this position, their own starts don't tell them apart
        first = F.min(F.when(b.isNotNull(), F.struct((b["distance"] + pos).alias("distance"), b["minus_ordered"].alias("minus_ordered"), b["alts"].alias("alts"), b["positions"].alias("positions")))).over(down)
        met = both.select(*keys, "slots", "pos", "alt_no", "best", before.alias("before"), after.alias("after"), first.alias("first")).where("best is null")
        more = lambda way, distance, least: F.when(way.isNotNull(), state(distance, way["minus_ordered"], F.concat(way["alts"], F.array(alt)), least, F.concat(way["positions"], F.array(pos))))
        x, y, z = F.col("before"), F.col("after"), F.col("first")
        behind = F.when(y["least"] < pos, more(y, y["distance"] - pos, y["least"])).otherwise(more(z, z["distance"] - pos, pos))
        now = met.select(*keys, "slots", "pos", "alt_no", F.least(more(x, x["distance"] + pos, x["least"]), behind).alias("best")).where("best is not null")
        done.append(now.where(F.col("slots") == slot + 1))
    best = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.min("best").alias("b"))
    return best.select(*keys, F.col("b.distance").cast("long").alias("distance"), (-F.col("b.minus_ordered")).cast("long").alias("ordered_pairs"), "b.positions")


def rank(found: DataFrame, k: int | None = None) -> DataFrame:
    """The best combination of each document, ranked within its query; ``k``: only the first so many.

    With ``k`` each task drops all but its own first k. Without, a query may match a large part of all documents, so no
    task numbers them all: the results are dealt by ranges of their order, and a range's rows come after
    those of all ranges before it, whatever the documents' ids are.
    """
    best = Window.partitionBy("query_id", "doc_id").orderBy("distance", F.desc("ordered_pairs"), "combo_id")
    kept = found.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    if k:
        order = Window.partitionBy("query_id").orderBy("distance", F.desc("ordered_pairs"), "doc_id")
        ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    else:
        order = [F.col("query_id"), F.col("distance"), F.desc("ordered_pairs"), F.col("doc_id")]
        placed = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        placed = materialise(placed.withColumn("part", F.shiftrightunsigned("at", 33)), "ranked")  # a range is numbered once
        counts = placed.groupBy("query_id", "part").agg(F.count(F.lit(1)).alias("many"), F.min("at").alias("first"))
        earlier = Window.partitionBy("query_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        starts = counts.withColumn("start", F.coalesce(F.sum("many").over(earlier), F.lit(0))).drop("many")
        ranked = placed.join(starts, ["query_id", "part"]).withColumn("rank", (F.col("start") + F.col("at") - F.col("first") + 1).cast("int"))
    return ranked.select("query_id", "rank", "doc_id", "distance", "ordered_pairs", "positions")


def snippets(results: DataFrame, positions: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, line_no, line): the lines of the chosen positions, once each, by the line number every position carries."""
    chosen = results.select("query_id", "doc_id", F.explode("positions").alias("pos"))
    at = positions.select("doc_id", "pos", "line_no").join(chosen, ["doc_id", "pos"]).select("query_id", "doc_id", "line_no").distinct()
    return at.join(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"]).select("query_id", "doc_id", "line_no", "line")


def snippets_by_range(results: DataFrame, lines: DataFrame) -> DataFrame:
    """The same lines by the range of positions that a line covers."""
    chosen = results.select("query_id", "doc_id", F.explode("positions").alias("pos"))
    inside = (F.col("pos") > F.col("start_pos")) & (F.col("pos") <= F.col("end_pos"))
    return chosen.join(lines, "doc_id").where(inside).select("query_id", "doc_id", "line_no", "line").distinct()
