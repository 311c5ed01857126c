"""Edit-distance joins and the noisy-channel speller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T

MAX_EDIT = 2
#: Query words up to this many are compared with the whole vocabulary; more go through the deletion neighbourhood.
SCAN_WORDS = 2_000
# The channel's priors (no error, obvious, non-obvious), its split over one and two edits, the acceptance threshold.
NO_ERROR, OBVIOUS, NON_OBVIOUS = 0.75, 0.2, 0.05
ONE_EDIT, TWO_EDITS = 0.8, 0.2
ACCEPTED = 0.00015


def letters(vocab: DataFrame) -> DataFrame:
    """(cand, cf): main terms of letters only, which an edit by a letter can reach."""
    return vocab.where(~F.col("is_stop") & F.col("bucket").between("a", "z") & F.col("term").rlike("^[a-z]+$")).select(F.col("term").alias("cand"), "cf")


def scan_join(words: DataFrame, targets: DataFrame, max_edit: int = MAX_EDIT) -> DataFrame:
    """(q, cand, ..., edit) within ``max_edit``: the query side, at most SCAN_WORDS words (see ``edit_join``), is broadcast against the scan."""
    distance = F.levenshtein("q", "cand", max_edit)
    close = F.abs(F.length("q") - F.length("cand")) <= max_edit
    return targets.join(F.broadcast(words), close & (F.col("q") != F.col("cand")) & (distance >= 0)).withColumn("edit", F.levenshtein("q", "cand"))


def deletions(word: Column, most: int = MAX_EDIT) -> Column:
    """All strings that are left when up to ``most`` characters of a word are deleted."""
    out = F.array(word)
    for _ in range(most):
        less = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        out = F.array_distinct(F.concat(out, less))
    return out


def deletion_join(words: DataFrame, targets: DataFrame, max_edit: int = MAX_EDIT, only: str = "true") -> DataFrame:
    """The same pairs as ``scan_join`` by an equi-join: words within ``max_edit`` edits share a string left by deletions.

    ``only``: a condition on the columns of both, which is tried before anything else.
    """
    left = words.select("*", F.explode(deletions(F.col("q"), max_edit)).alias("rest"))
    right = targets.select("*", F.explode(deletions(F.col("cand"), max_edit)).alias("rest"))
    pairs = left.join(right, "rest").where((F.col("q") != F.col("cand")) & F.expr(only)).drop("rest").distinct()
    return pairs.withColumn("edit", F.levenshtein("q", "cand")).where(F.col("edit") <= max_edit)


def are_few(words: DataFrame) -> bool:
    """Whether these query words, and so any subset of them, may be broadcast."""
    return words.limit(SCAN_WORDS + 1).count() <= SCAN_WORDS


def edit_join(words: DataFrame, targets: DataFrame, max_edit: int = MAX_EDIT, few: bool | None = None, only: str = "true") -> DataFrame:
    """The scan while the query words are few enough to broadcast, else the equi-join over deletions."""
    few = are_few(words) if few is None else few
    return scan_join(words, targets, max_edit).where(only) if few else deletion_join(words, targets, max_edit, only)


def surfaces(vocab: DataFrame) -> DataFrame:
    """(surface, cand, cf): inflected forms of main terms that are no terms themselves."""
    t = F.col("cand")
    stem = lambda n: t.substr(F.lit(1), F.length(t) - n)
    plural = [F.when(t.endswith(base) if base else F.lit(True), F.concat(stem(len(base)), F.lit(suffix))) for suffix, base in L.TRIMS]
    verb = [F.concat(t, F.lit(x)) for x in ("ed", "ing")] + [F.when(t.endswith("e"), F.concat(stem(1), F.lit(x))) for x in ("ed", "ing")]
    doubled = [F.when(t.rlike("[b-df-hj-np-tv-z]$"), F.concat(t, t.substr(F.length(t), F.lit(1)), F.lit(x))) for x in ("ed", "ing")]
    terms = letters(vocab)
    made = terms.select("cand", "cf", F.explode(F.array_distinct(F.array_compact(F.array(*plural, *verb, *doubled)))).alias("surface"))
    made = made.where(F.length("surface") >= 4)
    listed = L.IRREGULAR_VERBS | L.IRREGULAR_PLURALS
    forms = F.array(*(F.struct(F.lit(a).alias("surface"), F.lit(b).alias("cand")) for a, b in listed.items()))
    table = vocab.sparkSession.range(1).select(F.explode(forms).alias("f")).select("f.surface", "f.cand")
    irregular = terms.join(F.broadcast(table), "cand").select("cand", "cf", "surface")
    return made.unionByName(irregular).distinct().join(terms.select(F.col("cand").alias("surface")), "surface", "left_anti")


def candidates(words: DataFrame, vocab: DataFrame, inflected: bool, max_edit: int = MAX_EDIT, few: bool | None = None) -> DataFrame:
    """(q, cand, cf, edit), the least edit of each pair; with ``inflected`` also by way of inflected forms."""
    few = are_few(words) if few is None else few
    near = edit_join(words, letters(vocab), max_edit, few).select("q", "cand", "cf", "edit")
    if inflected:
        forms = surfaces(vocab).select(F.col("cand").alias("lemma"), "cf", F.col("surface").alias("cand"))
        by_form = edit_join(words, forms, max_edit, few).select("q", F.col("lemma").alias("cand"), "cf", "edit")
        near = near.unionByName(by_form.where(F.col("q") != F.col("cand")))
    return near.groupBy("q", "cand", "cf").agg(F.min("edit").alias("edit"))


def channel(p: Column, edit: Column, obvious: bool) -> Column:
    """P(word) times the channel's share of the edit."""
    return F.when(edit == 0, p * NO_ERROR).otherwise(p * (OBVIOUS if obvious else NON_OBVIOUS) * F.when(edit == 1, ONE_EDIT).otherwise(TWO_EDITS))


#: The thresholds in whole numbers, so that any engine decides alike: cf / sumf over ACCEPTED, and over NO_ERROR times the query word's own share.
OBVIOUS_RULE = "case when edit = 1 then cf * 10000000 > sumf * 9375 else cf * 100000 > sumf * 375 end"
NON_OBVIOUS_RULE = "case when edit = 1 then 4 * cf > 75 * own else cf > 75 * own end"
ORDER = ("cf_weight", "edit", "cf", "cand")


def ranked(found: DataFrame) -> DataFrame:
    """``turn``: the order of a word's candidates by score, edit, frequency, spelling."""
    weight = F.col("cf") * F.when(F.col("edit") == 1, 4).otherwise(1)  # the score without what all candidates share
    order = Window.partitionBy("q").orderBy(weight.desc(), "edit", F.desc("cf"), "cand")
    return found.withColumn("turn", F.row_number().over(order))


def obvious(words: DataFrame, vocab: DataFrame, stats: DataFrame, max_edit: int = MAX_EDIT, most: int | None = None, few: bool | None = None) -> DataFrame:
    """Corrections of words outside the vocabulary: all over the threshold, or else the best one."""
    found = ranked(candidates(words, vocab, True, max_edit, few)).crossJoin(F.broadcast(stats.select("sumf")))  # one row
    found = found.withColumn("passes", F.expr(OBVIOUS_RULE))
    any_pass = F.max("passes").over(Window.partitionBy("q"))
    kept = found.withColumn("any", any_pass).where(F.col("passes") | (~F.col("any") & (F.col("turn") == 1)))
    kept = kept.withColumn("score", channel(F.col("cf") / F.col("sumf"), F.col("edit"), True))
    return (kept.where(F.col("turn") <= most) if most else kept).select("q", "cand", "edit", "cf", "turn", "score")


def non_obvious(words: DataFrame, vocab: DataFrame, max_edit: int = MAX_EDIT, most: int | None = None, few: bool | None = None) -> DataFrame:
    """Alternatives of words in the vocabulary that are likelier than no error; ``words`` has q and its own frequency."""
    # whatever the edit, an alternative is this much more frequent
    found = edit_join(words.select("q", F.col("cf").alias("own")), letters(vocab), max_edit, few, "4 * cf > 75 * own")
    kept = ranked(found.where(F.expr(NON_OBVIOUS_RULE)))
    return (kept.where(F.col("turn") <= most) if most else kept).select("q", "cand", "edit", "cf", "turn")
