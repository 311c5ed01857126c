"""The engine's own queries and their DuckDB twins, by the operator that each one shows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import oracle as O
from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators import fuzzy, index, retrieval
from tessera.plans.search import Index, formatted, search
from tessera.session import materialise, shared_dir
from tessera.sources import corpus
from tessera.streaming import service

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What is asked of the corpus.
BATCH = ["the of", "that with for", "the the", "tion ing re", "> of the and", "thatt the", "zqxv", "", "1,234 the", "of"]
MISSPELT = ["thatt", "tionn", "theon", "onthe", "andthe", "reing", "zqxvw"]
LINES = list(enumerate(BATCH))
QUERY_LINES = O.values(LINES, "query_id", "raw")
SHORT = [(q, r) for q, r in LINES if q in (0, 1, 2, 3, 4, 9)]


def query(sql: str | None = None, **parts: str):
    """Register a query under its own name; ``sql`` over the parts of ``oracle``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = O.sql(sql, **parts)
        return f

    return add


def literal(spark: SparkSession, rows: list[tuple], *columns: str) -> DataFrame:
    """A few given rows as a literal relation."""
    structs = F.array(*(F.struct(*((F.lit(x).cast("long") if isinstance(x, int) else F.lit(x)).alias(c) for x, c in zip(r, columns, strict=True))) for r in rows))
    return spark.range(1).select(F.explode(structs).alias("r")).select("r.*")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents(spark, d)


def found(spark: SparkSession, d: str) -> DataFrame:
    return index.positions(docs(spark, d))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(found(spark, d))


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return index.vocabulary(rows(spark, d))


def kept_vocab(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary as a table: the speller's steps read it several times, the documents once."""
    return materialise(vocab(spark, d), "vocabulary")


def written(spark: SparkSession, d: str, *tables: str) -> Index:
    """The index as tables in the shared folder: built once, read by every part of a search. ``tables``: which are wanted."""
    return Index.write(docs(spark, d), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", tables=tables or ("positions", "postings"))


SPELLER = ("positions", "postings", "vocabulary", "stats")


def asked(spark: SparkSession, lines: list[tuple[int, str]] = LINES) -> DataFrame:
    return literal(spark, lines, "query_id", "raw")


def joined(c: str = "positions") -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


# Sources, lines and the analysis chain


@query("select doc_id, text from documents")
def docs_scan(spark, d):
    return docs(spark, d)


@query("select doc_id, cast(line_no as integer) as line_no, line from lines")
def lines_split(spark, d):
    return index.split_lines(docs(spark, d))


@query(f"select doc_id, cast(line_no as integer) as line_no, {O.lowered('line')} as line from lines")
def norm_lower(spark, d):
    return index.split_lines(docs(spark, d)).select("doc_id", "line_no", T.lowered(F.col("line")).alias("line"))


CONTRACTIONS = [(i, x) for i, x in enumerate(["don't hadn't isn't", "can't won't shan't ain't", "he couldn't, she wouldn't", "n't", "it's weren't'", "mustn't've"])]


@query(f"select id, {O.expanded('raw')} as line from fixture", fixture=O.values(CONTRACTIONS, "id", "raw"))
def norm_contractions(spark, d):
    return literal(spark, CONTRACTIONS, "id", "raw").select("id", T.expanded(F.col("raw")).alias("line"))


@query(f"select doc_id, cast(line_no as integer) as line_no, {O.without_decimals('line')} as line from lines")
def norm_decimals(spark, d):
    return index.split_lines(docs(spark, d)).select("doc_id", "line_no", T.without_decimals(F.col("line")).alias("line"))


@query("select doc_id, cast(line_no as integer) as line_no, cast(tok_no as integer) as tok_no, tok from toks")
def tokenize(spark, d):
    return index.split_tokens(docs(spark, d))


@query("select tok, count(*) as uses, count(distinct doc_id) as docs from toks group by tok")
def token_counts(spark, d):
    each = index.split_tokens(docs(spark, d)).groupBy("tok", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("tok").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("docs"))


POSSESSIVES = [(i, x) for i, x in enumerate(["it's the dog's bone", "he's she's they's", "'s first", "dogs' tails", "what's it's"])]


@query(
    f"select id, cast(tok_no as integer) as tok_no, tok from (select id, tok_no, tok, {O.term('tok', 'prev')} as term from b) where term is not null",
    fixture=O.values(POSSESSIVES, "id", "raw"),
    t=f"select id, {O.tokens('raw')} as ts from fixture",
    u="select id, unnest(range(len(ts))) as tok_no, unnest(ts) as tok from t",
    b="select *, lag(tok) over (partition by id order by tok_no) as prev from u",
)
def possessive_filter(spark, d):
    toks = literal(spark, POSSESSIVES, "id", "raw").select("id", F.posexplode(T.tokens(F.col("raw"))).alias("tok_no", "tok"))
    before = F.lag("tok").over(Window.partitionBy("id").orderBy("tok_no"))
    return toks.withColumn("term", T.term(F.col("tok"), before)).where("term is not null").select("id", "tok_no", "tok")


@query("select doc_id, term, count(*) as n from terms group by doc_id, term")
def index_terms(spark, d):
    return index.raw_positions(docs(spark, d)).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, term, pos, line_no, is_stop, bucket from positions")
def positions(spark, d):
    return found(spark, d)


@query("select doc_id, line_no, start_pos, end_pos, line from stored_lines")
def line_endpos(spark, d):
    return index.lines(docs(spark, d), found(spark, d))


@query("select is_stop, count(*) as uses, count(distinct term) as terms from positions group by is_stop")
def stop_split(spark, d):
    return vocab(spark, d).groupBy("is_stop").agg(F.sum("cf").alias("uses"), F.count(F.lit(1)).alias("terms"))


STOPS = O.values([(w,) for w in dict.fromkeys(L.STOPWORDS)], "term")


def stop_table(spark):
    return F.broadcast(literal(spark, [(w,) for w in dict.fromkeys(L.STOPWORDS)], "term"))  # a fixed list


@query("select doc_id, term, pos from positions p where exists (select 1 from stops s where s.term = p.term)", stops=STOPS)
def stop_semi(spark, d):
    return found(spark, d).join(stop_table(spark), "term", "left_semi").select("doc_id", "term", "pos")


@query("select doc_id, term, pos from positions p where not exists (select 1 from stops s where s.term = p.term)", stops=STOPS)
def stop_anti(spark, d):
    return found(spark, d).join(stop_table(spark), "term", "left_anti").select("doc_id", "term", "pos")


# Index tables


@query("select doc_id, term, is_stop, string_agg(cast(pos as varchar), ',' order by pos) as positions from positions group by doc_id, term, is_stop")
def term_positions(spark, d):
    return index.term_positions(found(spark, d)).select("doc_id", "term", "is_stop", joined())


@query("select doc_id, term || ',' || string_agg(cast(pos as varchar), ',' order by pos) as value from positions group by doc_id, term")
def positions_text(spark, d):
    """The text form of the positions, written as text files, a folder a document's number, and read again."""
    path = f"{shared_dir(spark)}/positions-{uuid.uuid4().hex}"
    lists = index.term_positions(found(spark, d)).withColumnRenamed("term", "key")
    corpus.csv_rows(lists, "key", "positions", "doc_id").repartition(8).write.text(path)
    line = F.split("value", ",", 2)
    return spark.read.text(path).select(F.get(line, F.lit(0)).cast("long").alias("doc_id"), F.get(line, F.lit(1)).alias("value"))


@query("select doc_id, term || ',' || string_agg(cast(pos as varchar), ',' order by pos) as value from positions group by doc_id, term")
def positions_csv(spark, d):
    lists = index.term_positions(found(spark, d))
    return lists.select("doc_id", F.concat_ws(",", "term", F.array_join(F.col("positions").cast("array<string>"), ",")).alias("value"))


@query("select distinct term from positions")
def vocab_distinct(spark, d):
    return found(spark, d).select("term").distinct()


@query("select term, cf from vocab")
def vocab_cf(spark, d):
    return found(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


@query("select term, df from vocab")
def vocab_df(spark, d):
    return vocab(spark, d).select("term", "df")


@query("select bucket, count(*) as terms, cast(sum(cf) as bigint) as uses from vocab group by bucket")
def vocab_buckets(spark, d):
    return vocab(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("terms"), F.sum("cf").alias("uses"))


@query("select coalesce(bucket, '*') as bucket, count(*) as terms, cast(sum(cf) as bigint) as uses, cast(grouping(bucket) as integer) as total from vocab group by rollup(bucket)")
def vocab_rollup(spark, d):
    rolled = vocab(spark, d).rollup("bucket").agg(F.count(F.lit(1)).alias("terms"), F.sum("cf").alias("uses"), F.grouping("bucket").cast("int").alias("total"))
    return rolled.withColumn("bucket", F.coalesce("bucket", F.lit("*")))


@query("select sumf from stats")
def corpus_sumf(spark, d):
    return index.stats(vocab(spark, d))


@query("select term, cf from vocab where bucket between 'a' and 'z'")
def vocab_scan_alpha(spark, d):
    return written(spark, d, "vocabulary").vocabulary.where(F.col("bucket").between("a", "z")).select("term", "cf")  # prunes partitions


@query("select term, cf from vocab where bucket between '0' and '9'")
def vocab_scan_digits(spark, d):
    return written(spark, d, "vocabulary").vocabulary.where(F.col("bucket").between("0", "9")).select("term", "cf")


@query("select term, is_stop, string_agg(cast(doc_id as varchar), ',' order by doc_id) as doc_ids from postings group by term, is_stop")
def postings_list(spark, d):
    return index.posting_lists(rows(spark, d)).select("term", "is_stop", joined("doc_ids"))


@query("select term, doc_id, tf from postings where is_stop")
def stop_postings(spark, d):
    return rows(spark, d).where("is_stop").select("term", "doc_id", "tf")


@query("select term, max(doc_id) as doc_id from postings where is_stop group by term")
def stop_postings_compat(spark, d):
    return index.last_document_only(rows(spark, d)).select("term", "doc_id")


@query("select term, doc_id, tf from postings where term in ('tion', 'ing', 'the')")
def posting_lookup(spark, d):
    terms = ["tion", "ing", "the"]
    wanted = {("_stop" if t in L.STOPWORDS else t[0]) for t in terms}
    return written(spark, d).postings.where(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms)).select("term", "doc_id", "tf")


@query("select doc_id, pos from positions where term = 'tion' and doc_id in (select doc_id from postings where term = 'ing')")
def position_lookup(spark, d):
    idx = written(spark, d)
    docs_with = idx.postings.where("bucket = 'i' and term = 'ing'").select("doc_id")
    return idx.positions.where("bucket = 't' and term = 'tion'").join(docs_with, "doc_id", "left_semi").select("doc_id", "pos")


# Lemmas

TAGS = list(L.TAG_CLASSES.items()) + [("NNP", None), ("RB", None), ("MD", None), ("CD", None), ("POS", None)]
TAG_LIST = [t for t, _ in TAGS]


@query("select tag, class from tags", tags=O.values(TAGS, "tag", "class"))
def tag_class_map(spark, d):
    table = F.create_map(*(F.lit(x) for pair in L.TAG_CLASSES.items() for x in pair))
    return literal(spark, [(t,) for t in TAG_LIST], "tag").select("tag", table[F.col("tag")].alias("class"))


@query(f"select distinct term, {O.lemma('term')} as lemma from positions")
def lemma_rules(spark, d):
    return found(spark, d).select("term").distinct().select("term", T.lemma(F.col("term")).alias("lemma"))


TAGGED = f"select tok, {O.tag('tok', 'prev')} as tag, {O.term('tok', 'prev')} as term from before"


def token_rows(spark, d):
    return index.split_lines(docs(spark, d)).select(T.tokens(T.normalised(F.col("line"))).alias("t"))


def token_before(i: Column) -> Column:
    return F.when(i > 0, F.get("t", i - 1))


@query("select tag, count(*) as n from tagged group by tag", tagged=TAGGED)
def pos_tags(spark, d):
    tags = F.transform("t", lambda x, i: T.tag(x, token_before(i)))
    return token_rows(spark, d).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"select term, tag, lemma, count(*) as n from (select term, tag, {O.lemma_by_tag('term', 'tag')} as lemma from tagged where term is not null) group by term, tag, lemma", tagged=TAGGED)
def lemma_tagged(spark, d):
    both = F.transform("t", lambda x, i: F.struct(T.term(x, token_before(i)).alias("term"), T.tag(x, token_before(i)).alias("tag")))
    counted = token_rows(spark, d).select(F.explode(both).alias("b")).where("b.term is not null").groupBy("b.term", "b.tag").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("term", "tag", T.lemma_by_tag(F.col("term"), F.col("tag")).alias("lemma"), "n")


WORDS = ["dogs", "went", "children", "1,234", "buses", "bodies", "class", "is", "the", "gas", "matches", "2nd", "thes"]


@query(
    f"select word, {O.query_term('plain')} as lemma from (select word, case when regexp_matches(word, '^[0-9]') then replace(word, ',', '') else word end as plain from w)",
    w=O.values([(w,) for w in WORDS], "word"),
)
def query_lemma(spark, d):
    return literal(spark, [(w,) for w in WORDS], "word").select("word", T.query_term(F.col("word"), "rules").alias("lemma"))


@query(f"select distinct term, base from (select term, unnest({O.trims('term')}) as base from letters_) where base in (select cand from letters)", letters_="select cand as term from letters")
def plural_trim(spark, d):
    terms = fuzzy.letters(kept_vocab(spark, d))
    made = terms.select(F.col("cand").alias("term"), F.explode(T.trims(F.col("cand"))).alias("base"))
    return made.join(terms.select(F.col("cand").alias("base")), "base", "left_semi").select("term", "base").distinct()


@query(
    "select term, base from irregular_forms where base is not null union all select term, base from (select b.term, b.base, row_number() over (partition by b.term order by turn) as n from bases b join letters l on l.cand = b.base) where n = 1",
    irregular_forms=f"select cand as term, {O.irregular('cand')} as base from letters",
    lists=f"select term, {O.verb_bases('term', True)} as bs from irregular_forms where base is null and length(term) > 3",
    bases="select term, unnest(bs) as base, unnest(range(len(bs))) as turn from lists",
)
def quick_lemma(spark, d):
    """Irregular forms by list, of three letters by nothing else; then the first base of an -ed, -ing, -er or -est word that the vocabulary has."""
    terms = fuzzy.letters(kept_vocab(spark, d)).select("cand")
    listed = terms.select(F.col("cand").alias("term"), T.irregular(F.col("cand")).alias("base"))
    bases = listed.where("base is null and length(term) > 3").select("term", F.posexplode(T.verb_bases(F.col("term"), True)).alias("turn", "base"))
    attested = bases.join(terms.withColumnRenamed("cand", "base"), "base", "left_semi")
    return listed.where("base is not null").unionByName(attested.groupBy("term").agg(F.min(F.struct("turn", "base"))["base"].alias("base")))


# The lemmatising index, the one that the command line builds


@query("select doc_id, term, pos, line_no, is_stop, bucket from positions", **O.RULES)
def positions_rules(spark, d):
    return index.positions(docs(spark, d), "rules")


@query("select term, tag, lemma from lemmas where term <> lemma")
def lemma_table(spark, d):
    return index.lemma_table(materialise(index.tagged_positions(docs(spark, d)).select("term", "tag").distinct(), "kinds"))


@query("select term, cf, df, is_stop, bucket from vocab", **O.RULES)
def vocab_rules(spark, d):
    return index.vocabulary(index.postings(index.positions(docs(spark, d), "rules")))


# Queries and spelling


@query("select query_id, show_lines, slot, word from words", query_lines=QUERY_LINES)
def query_parse(spark, d):
    return retrieval.parse(asked(spark))


@query("select query_id, raw from query_lines", query_lines=QUERY_LINES)
def query_batch(spark, d):
    return asked(spark)


@query("select query_id, raw from query_lines", query_lines=QUERY_LINES)
def query_file(spark, d):
    """The same lines from a text file."""
    path = f"{shared_dir(spark)}/asked-{uuid.uuid4().hex}"
    write_text(spark, f"{path}/queries", "\r\n".join(BATCH) + "\n")
    return corpus.queries(spark, f"{path}/queries")


#: Text files as a folder of documents: names are numbers, lines end in each of the three ways, one file is empty.
FILES = [(3, "One line.\nAnother of it\r\n\r\nand the last"), (12, ""), (7, "A single line without an end"), (100, "\rOld ends\rof lines\r")]


@query("select doc_id, text from files", files=O.values([(i, x.replace("\n", "\\n").replace("\r", "\\r")) for i, x in FILES], "doc_id", "raw").replace("select *", "select doc_id, replace(replace(raw, '\\n', chr(10)), '\\r', chr(13)) as text"))
def docs_folder(spark, d):
    path = f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    for i, text in FILES:
        write_text(spark, f"{path}/{i}", text)
    return corpus.directory(spark, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, by Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(text.encode()))
    out.close()


@query("select q from unknown", query_lines=QUERY_LINES)
def query_oov(spark, d):
    words = retrieval.parse(asked(spark)).where(F.col("word").rlike("^[a-z]+$") & ~T.is_stop(F.col("word"))).select(F.col("word").alias("q")).distinct()
    return words.join(vocab(spark, d).where("not is_stop").select(F.col("term").alias("q")), "q", "left_anti")


@query("select q, cf from known", query_lines=QUERY_LINES)
def query_iv(spark, d):
    words = retrieval.parse(asked(spark)).where(F.col("word").rlike("^[a-z]+$") & ~T.is_stop(F.col("word"))).select(F.col("word").alias("q")).distinct()
    return words.join(vocab(spark, d).where("not is_stop").select(F.col("term").alias("q"), "cf"), "q")


MISSPELT_ROWS = O.values([(w,) for w in MISSPELT], "q")
PAIRS = "select q, cand, cf, edit from (select q, cand, cf, levenshtein(q, cand) as edit from ws join letters on q <> cand and abs(length(q) - length(cand)) <= 2) where edit <= 2"


def misspelt(spark):
    return literal(spark, [(w,) for w in MISSPELT], "q")


@query(PAIRS, ws=MISSPELT_ROWS)
def fuzzy_join(spark, d):
    return fuzzy.scan_join(misspelt(spark), fuzzy.letters(kept_vocab(spark, d))).select("q", "cand", "cf", F.col("edit").cast("long").alias("edit"))


@query(PAIRS, ws=MISSPELT_ROWS)
def fuzzy_join_deletes(spark, d):
    return fuzzy.deletion_join(misspelt(spark), fuzzy.letters(kept_vocab(spark, d))).select("q", "cand", "cf", F.col("edit").cast("long").alias("edit"))


@query("select distinct q, cand, cf, min(edit) as edit from (select q, cand, cf, levenshtein(q, surface) as edit from ws join surfaces on q <> surface and abs(length(q) - length(surface)) <= 2) where edit <= 2 group by q, cand, cf", ws=MISSPELT_ROWS)
def fuzzy_inflected(spark, d):
    forms = fuzzy.surfaces(kept_vocab(spark, d)).select(F.col("cand").alias("lemma"), "cf", F.col("surface").alias("cand"))
    near = fuzzy.scan_join(misspelt(spark), forms)
    return near.groupBy("q", F.col("lemma").alias("cand"), "cf").agg(F.min("edit").cast("long").alias("edit"))


@query("select q, cand, round(cf / sumf * 0.2 * case when edit = 1 then 0.8 else 0.2 end, 12) as score from near, stats", ws=MISSPELT_ROWS, near=PAIRS)
def spell_scores(spark, d):
    v = kept_vocab(spark, d)
    near = fuzzy.scan_join(misspelt(spark), fuzzy.letters(v)).crossJoin(F.broadcast(index.stats(v)))  # one row
    return near.select("q", "cand", F.round(fuzzy.channel(F.col("cf") / F.col("sumf"), F.col("edit"), True), 12).alias("score"))


@query("select q, cand, edit, cf, cast(turn as integer) as turn from obvious", unknown=f"select q from ({MISSPELT_ROWS}) where q not in (select term from vocab where not is_stop)")
def spell_obvious(spark, d):
    v = kept_vocab(spark, d)
    words = misspelt(spark).join(v.where("not is_stop").select(F.col("term").alias("q")), "q", "left_anti")
    return fuzzy.obvious(words, v, index.stats(v)).select("q", "cand", F.col("edit").cast("long").alias("edit"), "cf", "turn")


@query("select q, cand, edit from obvious_ranked where turn = 1", unknown=f"select q from ({MISSPELT_ROWS}) where q not in (select term from vocab where not is_stop)")
def spell_top1(spark, d):
    v = kept_vocab(spark, d)
    words = misspelt(spark).join(v.where("not is_stop").select(F.col("term").alias("q")), "q", "left_anti")
    return fuzzy.ranked(fuzzy.candidates(words, v, True)).where("turn = 1").select("q", "cand", F.col("edit").cast("long").alias("edit"))


@query(
    "select q, cand, edit, cf, cast(turn as integer) as turn from non_obvious",
    rests="select cand, cf, unnest(" + O.DELETIONS.format(w="cand") + ") as rest from letters",
    rests_of_two="select distinct cand, cf, unnest(" + O.DELETIONS.format(w="rest") + ") as rest from rests",
    near_known="select q, cand, cf, own, edit from (select *, levenshtein(q, cand) as edit from (select distinct a.cand as q, a.cf as own, b.cand, b.cf from rests_of_two a join rests_of_two b on a.rest = b.rest and a.cand <> b.cand and 4 * b.cf > 75 * a.cf)) where edit <= 2",
)
def spell_nonobvious(spark, d):
    """Every plain word of the vocabulary is asked."""
    v = kept_vocab(spark, d)
    words = fuzzy.letters(v).select(F.col("cand").alias("q"), "cf")
    return fuzzy.non_obvious(words, v, few=False).select("q", "cand", F.col("edit").cast("long").alias("edit"), "cf", "turn")


@query("select query_id, slot, alt_no, term from slots", query_lines=QUERY_LINES)
def query_correction(spark, d):
    v = kept_vocab(spark, d)
    return retrieval.correct(retrieval.parse(asked(spark)), v, index.stats(v))


@query("select query_id, combo_id, slots, slot, term from combos", query_lines=QUERY_LINES)
def query_combos(spark, d):
    v = kept_vocab(spark, d)
    return retrieval.combine(retrieval.correct(retrieval.parse(asked(spark)), v, index.stats(v)))


# Retrieval; these queries are spelt as they stand

PLAIN = {"query_lines": O.values(SHORT, "query_id", "raw"), "slots": "select query_id, slot, 0 as alt_no, word as term from words"}


def plain_combos(spark) -> DataFrame:
    words = retrieval.parse(asked(spark, SHORT))
    return retrieval.combine(words.select("query_id", "slot", F.lit(0).alias("alt_no"), F.col("word").alias("term")))


def plain_matches(spark, idx: Index) -> tuple[DataFrame, DataFrame]:
    combos = plain_combos(spark)
    return combos, retrieval.matches(combos, idx.postings)


def plain_near(spark, idx: Index) -> DataFrame:
    combos, matched = plain_matches(spark, idx)
    return retrieval.proximity(retrieval.slot_positions(combos, matched, idx.positions), 3)


@query("select query_id, slot, doc_id, tf from combos join postings using (term)", **PLAIN)
def query_postings(spark, d):
    return rows(spark, d).join(F.broadcast(plain_combos(spark)), "term").select("query_id", "slot", "doc_id", "tf")  # a few given queries


@query("select doc_id from postings where term = 'the' intersect select doc_id from postings where term = 'tion'")
def docs_intersect(spark, d):
    p = rows(spark, d)
    return p.where("term = 'the'").select("doc_id").intersect(p.where("term = 'tion'").select("doc_id"))


@query("select term, doc_id from postings where term = 'ing' union all select term, doc_id from postings where term = 'tion'")
def docs_union(spark, d):
    p = rows(spark, d).select("term", "doc_id")
    return p.where("term = 'ing'").unionByName(p.where("term = 'tion'"))


@query("select query_id, combo_id, doc_id, slots from matched", **PLAIN)
def and_query(spark, d):
    return plain_matches(spark, written(spark, d))[1]


@query("select query_id, combo_id, doc_id, slots, slot, pos from found", **PLAIN)
def match_positions(spark, d):
    idx = written(spark, d)
    combos, matched = plain_matches(spark, idx)
    return retrieval.slot_positions(combos, matched, idx.positions)


@query("select a.doc_id, a.pos as first, b.pos as second, cast(abs(b.pos - a.pos) as integer) as distance, cast(b.pos > a.pos as integer) as ordered from positions a join positions b on a.doc_id = b.doc_id where a.term = 'tion' and b.term = 'ing'")
def proximity_pairs(spark, d):
    p = found(spark, d)
    a, b = (p.where(F.col("term") == t).select("doc_id", F.col("pos").alias(c)) for t, c in (("tion", "first"), ("ing", "second")))
    return a.join(b, "doc_id").select("doc_id", "first", "second", F.abs(F.col("second") - F.col("first")).alias("distance"), (F.col("second") > F.col("first")).cast("int").alias("ordered"))


@query("select query_id, combo_id, doc_id, distance, ordered_pairs from near", **PLAIN)
def proximity(spark, d):
    return plain_near(spark, written(spark, d)).drop("positions")


@query("select query_id, doc_id, distance, ordered_pairs from best", **PLAIN)
def best_per_doc(spark, d):
    return retrieval.rank(plain_near(spark, written(spark, d))).select("query_id", "doc_id", "distance", "ordered_pairs")


@query("select query_id, rank, doc_id, distance, ordered_pairs from ranked", **PLAIN)
def ranked_results(spark, d):
    return retrieval.rank(plain_near(spark, written(spark, d))).drop("positions")


@query("select query_id, rank, doc_id from ranked where rank <= 10", **PLAIN)
def topk_docs(spark, d):
    return retrieval.rank(plain_near(spark, written(spark, d)), 10).select("query_id", "rank", "doc_id")


@query("select query_id, rank, case when show_lines then '> ' || doc_id else cast(doc_id as varchar) end as value from ranked join (select distinct query_id, show_lines from words) using (query_id)", **PLAIN)
def result_rows(spark, d):
    idx = written(spark, d)
    ranked = retrieval.rank(plain_near(spark, idx))
    shown = retrieval.parse(asked(spark, SHORT)).select("query_id", "show_lines").distinct()
    return ranked.join(shown, "query_id").select("query_id", "rank", F.when(F.col("show_lines"), F.concat(F.lit("> "), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("value"))


PAIRS_ONLY = {"query_lines": O.values([(0, "the of"), (1, "tion ing"), (2, "re")], "query_id", "raw"), "slots": PLAIN["slots"]}


def pairs_near(spark, idx: Index) -> DataFrame:
    words = retrieval.parse(literal(spark, [(0, "the of"), (1, "tion ing"), (2, "re")], "query_id", "raw"))
    combos = retrieval.combine(words.select("query_id", "slot", F.lit(0).alias("alt_no"), F.col("word").alias("term")))
    matched = retrieval.matches(combos, idx.postings)
    return retrieval.proximity(retrieval.slot_positions(combos, matched, idx.positions), 2)


@query("select distinct c.query_id, c.doc_id, l.line_no, l.line from chosen c join positions p on p.doc_id = c.doc_id and p.pos = c.pos join stored_lines l on l.doc_id = p.doc_id and l.line_no = p.line_no", **PAIRS_ONLY)
def snippets(spark, d):
    idx = written(spark, d, "positions", "postings", "lines")
    return retrieval.snippets(pairs_near(spark, idx), idx.positions, idx.lines)


@query("select distinct query_id, c.doc_id, line_no, line from chosen c asof join stored_lines l on l.doc_id = c.doc_id and c.pos <= l.end_pos", **PAIRS_ONLY)
def snippets_range(spark, d):
    idx = written(spark, d, "positions", "postings", "lines")
    return retrieval.snippets_by_range(pairs_near(spark, idx), idx.lines)


@query("select problem, many from (values ('position twice', 0), ('positions with a gap', 0), ('posting twice', 0), ('tf differs', 0), ('cf or df differs', 0)) as t(problem, many)")
def index_check(spark, d):
    idx = written(spark, d, "positions", "postings", "vocabulary")
    return index.problems(idx.positions, idx.postings, idx.vocabulary)


#: Queries of four words and more.
LONG = list(enumerate(["the of and to", "tion the ing the re", "of the that with for and", "> the the the the"]))
LONG_PARTS = {"query_lines": O.values(LONG, "query_id", "raw"), "slots": "select query_id, slot, 0 as alt_no, word as term from words", "ways": "select * from long_ways"}


@query("select query_id, rank, doc_id, distance, ordered_pairs, positions from ranked", **LONG_PARTS)
def search_long(spark, d):
    return search(written(spark, d), asked(spark, LONG), spell=False).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


PRINTED = list(enumerate(["> the of", "that with for", "> tion ing", "of", "> zqxv"]))


@query(
    "select query_id, rank, -1 as part, case when show_lines then '> ' || doc_id else cast(doc_id as varchar) end as value from shown union all select s.query_id, s.rank, l.line_no, l.line from (select distinct s.query_id, s.rank, s.doc_id, p.line_no from shown s join chosen c on c.query_id = s.query_id and c.doc_id = s.doc_id join positions p on p.doc_id = c.doc_id and p.pos = c.pos where s.show_lines) s join stored_lines l on l.doc_id = s.doc_id and l.line_no = s.line_no",
    shown="select r.query_id, r.rank, r.doc_id, w.show_lines from ranked r join (select distinct query_id, show_lines from words) w on w.query_id = r.query_id",
    query_lines=O.values(PRINTED, "query_id", "raw"),
    slots=LONG_PARTS["slots"],
)
def search_printed(spark, d):
    """What the command line prints, in its order: query_id, rank, part."""
    idx, queries = written(spark, d, "positions", "postings", "lines"), asked(spark, PRINTED)
    return formatted(search(idx, queries, spell=False), queries, idx).orderBy("query_id", "rank", "part")


END_TO_END = "select query_id, rank, doc_id, distance, ordered_pairs from ranked"


@query(END_TO_END, query_lines=QUERY_LINES)
def search_end_to_end(spark, d):
    return search(written(spark, d, *SPELLER), asked(spark)).drop("positions")


RULE_LINES = list(enumerate(["the dogs", "tions ing", "> of the and", "thatt the", "went children", "reading", "1,234 the", "of"]))


@query(END_TO_END, query_lines=O.values(RULE_LINES, "query_id", "raw"), **O.RULES)
def search_rules(spark, d):
    """A search of the lemmatising index."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    return search(Index.write(docs(spark, d), path, "rules", tables=SPELLER), asked(spark, RULE_LINES)).drop("positions")


@query(END_TO_END, query_lines=QUERY_LINES)
def stream_search(spark, d):
    """The same queries as a stream of files; every micro-batch's results are appended to a table, which is returned."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    asked(spark).repartition(3).write.parquet(f"{base}/in")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    service.serve(service.query_stream(spark, f"{base}/in"), written(spark, d, *SPELLER), sink, f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("positions", "batch")


TWICE = ["the of", "tion ing", "the of", ""]


@query("select n, count(*) as documents, cast(sum(distance) as bigint) as distance from (select query_id % 2 as n, distance from ranked) group by n", query_lines=O.values([(i, x) for i, x in enumerate(TWICE)], "query_id", "raw"), slots=PLAIN["slots"])
def stream_lines(spark, d):
    """Lines of a text file as a stream; equal lines are queries of their own, though their ids are hashes."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    write_text(spark, f"{base}/in/queries.txt", "\n".join(TWICE) + "\n")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    service.serve(service.text_stream(spark, f"{base}/in"), written(spark, d), sink, f"{base}/state", spell=False).awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    each = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("distance").alias("distance"))
    # the twins have the same results: their sums together, and the other query's alone
    twins = each.groupBy("documents", "distance").agg(F.count(F.lit(1)).alias("queries"))
    return twins.select(F.when(F.col("queries") > 1, 0).otherwise(1).cast("long").alias("n"), (F.col("documents") * F.col("queries")).alias("documents"), (F.col("distance") * F.col("queries")).alias("distance"))
