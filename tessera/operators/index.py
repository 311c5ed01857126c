"""The positional index as DataFrames: lines, positions, postings, vocabulary, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import materialise


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): every line, empty ones too."""
    return docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


def split_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, tok_no, tok) after normalisation."""
    lines = split_lines(docs).select("doc_id", "line_no", T.tokens(T.normalised(F.col("line"))).alias("t"))
    return lines.select("doc_id", "line_no", F.posexplode("t").alias("tok_no", "tok"))


def raw_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line_no, term), pos from 1 over the whole document.

    A document's terms are numbered inside its own row, so positions need no shuffle and no sort.
    """
    return _numbered(docs, lambda line, i: F.transform(T.line_terms(line), lambda t: F.struct(i.alias("line_no"), t.alias("term")))).select("doc_id", "pos", "t.line_no", "t.term")


def tagged_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line_no, term, tag): the same with each term's tag."""
    found = lambda line, i: F.transform(T.line_tagged(line), lambda t: F.struct(i.alias("line_no"), t["term"].alias("term"), t["tag"].alias("tag")))
    return _numbered(docs, found).select("doc_id", "pos", "t.line_no", "t.term", "t.tag")


def _numbered(docs: DataFrame, of_line) -> DataFrame:
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.flatten(F.transform(T.lines(F.col("text")), of_line))).alias("at", "t"))
    return rows.withColumn("pos", F.col("at") + 1)


def with_classes(terms: DataFrame) -> DataFrame:
    stop = T.is_stop(F.col("term"))
    return terms.withColumn("is_stop", stop).withColumn("bucket", F.when(F.col("is_stop"), "_stop").otherwise(T.bucket(F.col("term"))))


def lemma_table(tagged: DataFrame) -> DataFrame:
    """(term, tag, lemma) of the terms that change: by lists and endings, or else to a base that the terms themselves attest."""
    kinds = tagged.select("term", "tag").distinct()
    first = kinds.select("term", "tag", T.lemma_by_tag(F.col("term"), F.col("tag")).alias("lemma"))
    bases = first.where("term = lemma").select("term", "tag", F.posexplode(T.bases_by_tag(F.col("term"), F.col("tag"))).alias("turn", "base"))
    attested = bases.join(kinds.select(F.col("term").alias("base")).distinct(), "base", "left_semi").groupBy("term", "tag").agg(F.min(F.struct("turn", "base"))["base"].alias("verb"))
    both = first.join(attested, ["term", "tag"], "left").select("term", "tag", F.coalesce("verb", "lemma").alias("lemma"))
    return both.where("term <> lemma")


def positions(docs: DataFrame, analyzer: str = "exact") -> DataFrame:
    """(doc_id, term, pos, line_no, is_stop, bucket). ``rules`` lemmatises by the terms' tags, ``exact`` does not."""
    if analyzer == "rules":
        found = materialise(tagged_positions(docs), "tagged")  # read by each step of the lemma table: analysed once
        found = found.join(lemma_table(found), ["term", "tag"], "left").select("doc_id", "pos", "line_no", F.coalesce("lemma", "term").alias("term"))
    else:
        found = raw_positions(docs)
    return with_classes(found).select("doc_id", "term", "pos", "line_no", "is_stop", "bucket")


def lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, line_no, start_pos, end_pos, line) of lines with an indexed term; start_pos is the last position before the line."""
    ends = found.groupBy("doc_id", "line_no").agg((F.min("pos") - 1).alias("start_pos"), F.max("pos").alias("end_pos"))
    return split_lines(docs).join(ends, ["doc_id", "line_no"]).select("doc_id", "line_no", "start_pos", "end_pos", "line")


def term_positions(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "term", "is_stop").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def postings(found: DataFrame) -> DataFrame:
    """(term, doc_id, tf, is_stop, bucket): one row a term and document."""
    return found.groupBy("term", "is_stop", "bucket", "doc_id").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf", "is_stop", "bucket")


def posting_lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "is_stop").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def last_document_only(rows: DataFrame) -> DataFrame:
    """Stopword postings as a system keeps them that overwrites a stopword's list with each document."""
    return rows.where("is_stop").groupBy("term", "is_stop", "bucket").agg(F.max(F.struct("doc_id", "tf")).alias("d")).select("term", "d.doc_id", "d.tf", "is_stop", "bucket")


def vocabulary(rows: DataFrame) -> DataFrame:
    """(term, cf, df, is_stop, bucket) from postings: the second aggregate of the same key, so no second scan of positions."""
    return rows.groupBy("term", "is_stop", "bucket").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")).select("term", "cf", "df", "is_stop", "bucket")


def stats(vocab: DataFrame) -> DataFrame:
    """(sumf): uses of main terms that begin with a letter; digits, stopwords and other beginnings do not count."""
    return vocab.where(F.col("bucket").between("a", "z")).agg(F.coalesce(F.sum("cf"), F.lit(0)).cast("long").alias("sumf"))


def problems(found: DataFrame, rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(problem, many): what contradicts itself in an index; all zero for a sound one.

    A position or a posting that occurs twice, a document whose positions don't run from 1 without a gap, a posting's tf and a
    term's cf and df that don't agree with the rows they count.
    """
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("many")).select(F.lit(name).alias("problem"), "many")
    per_doc = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    tf = found.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("uses"))
    sums = rows.groupBy("term").agg(F.sum("tf").alias("uses"), F.count(F.lit(1)).alias("docs"))
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    parts = [
        count(found.groupBy("doc_id", "pos").count().where("count > 1"), "position twice"),
        count(per_doc.where("low <> 1 or high <> n"), "positions with a gap"),
        count(rows.groupBy("term", "doc_id").count().where("count > 1"), "posting twice"),
        count(rows.select("term", "doc_id", "tf").join(tf, ["term", "doc_id"], "full").where(differ("tf", "uses")), "tf differs"),
        count(vocab.select("term", "cf", "df").join(sums, "term", "full").where(differ("cf", "uses") | differ("df", "docs")), "cf or df differs"),
    ]
    return reduce(DataFrame.unionByName, parts)
