import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import fuzzy, retrieval
from tessera.plans.search import Index, formatted, search
from tessera.sources import corpus
from tessera.streaming import service

from test_analysis import DOCS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def idx(docs):
    return Index.build(docs, "rules").cache()


def ask(spark, idx, *lines, **options):
    rows = search(idx, corpus.inline(spark, list(lines)), **options).orderBy("query_id", "rank").collect()
    return [[(r.doc_id, r.distance, r.ordered_pairs, r.positions) for r in rows if r.query_id == i] for i in range(len(lines))]


def test_small_corpus(spark, idx):
    got = ask(spark, idx, "dog", "dog lazy", "lazy dog", "the fox", "1,234 book", "the the", "qqqqqqqq", "", "  ", "Dogs  READING")
    assert got[0] == [(1, 0, 0, [9]), (2, 0, 0, [5]), (3, 0, 0, [1])]
    assert got[1] == [(1, 1, 0, [9, 8]), (2, 3, 1, [5, 8])]
    assert got[2] == [(1, 1, 1, [8, 9]), (2, 3, 0, [8, 5])]
    assert got[3] == [(1, 3, 1, [1, 4])]
    assert got[4] == [(3, 1, 1, [10, 11])]
    assert got[5] == [(1, 0, 0, [1, 1]), (3, 0, 0, [6, 6])]
    assert got[6] == got[7] == got[8] == []


def test_compat_keeps_the_last_document_of_a_stopword(spark, docs):
    old = Index.build(docs, "rules", compat=True)
    got = ask(spark, old, "the fox", "the the")
    assert got[0] == [] and [r[0] for r in got[1]] == [3]


def test_spelling(spark, idx):
    assert [r[:1] + r[3:] for r in ask(spark, idx, "foxx")[0] if r[3] in ([4], [2])] == [(1, [4]), (2, [2])]
    words = spark.createDataFrame([("foxx",)], "q string")
    best = fuzzy.obvious(words, idx.vocabulary, idx.stats).where("cand = 'fox'").first()
    assert best.edit == 1 and abs(best.score - 2 / 18 * 0.2 * 0.8) < 1e-12


def test_lines_of_hits(spark, idx):
    queries = corpus.inline(spark, ["> dog sleep", "> fox sleep", "dog sleep"])
    found = search(idx, queries)
    rows = [(r.query_id, r.value) for r in formatted(found, queries, idx).orderBy("query_id", "rank", "part").collect()]
    assert rows == [(0, "> 1"), (0, "The dog sleeps."), (1, "> 1"), (1, "The quick brown fox jumps over the lazy dog."), (1, "The dog sleeps."), (2, "1")]
    a = sorted(tuple(r) for r in retrieval.snippets(found, idx.positions, idx.lines).collect())
    assert a == sorted(tuple(r) for r in retrieval.snippets_by_range(found, idx.lines).collect())


def test_written_index_and_stream(spark, docs, idx, tmp_path):
    again = Index.write(docs, str(tmp_path / "index"), "rules")
    queries = corpus.inline(spark, ["dog lazy", "the the", "foxx"])
    want = sorted(map(tuple, search(idx, queries).collect()))
    assert sorted(map(tuple, search(again, queries).collect())) == want
    queries.write.parquet(str(tmp_path / "in"))
    out = []
    service.serve(service.query_stream(spark, str(tmp_path / "in")), again, lambda df, n: out.extend(map(tuple, df.collect())), str(tmp_path / "check")).awaitTermination()
    assert sorted(out) == want


def test_written_compat_index_keeps_the_vocabulary(spark, docs, idx, tmp_path):
    old = Index.write(docs, str(tmp_path / "index"), "rules", compat=True)
    assert sorted(map(tuple, old.vocabulary.collect())) == sorted(map(tuple, idx.vocabulary.collect()))
    assert [(r.term, r.doc_id) for r in old.postings.where("term = 'the'").collect()] == [("the", 3)]
    assert old.stats.first().sumf == 18


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for i, text in DOCS:
        (tmp_path / "docs" / str(i)).write_text(text)
    assert sorted(map(tuple, corpus.directory(spark, str(tmp_path / "docs")).collect())) == sorted(DOCS)
    (tmp_path / "q").write_text("a b\n\n> c\n")
    assert [tuple(r) for r in corpus.queries(spark, str(tmp_path / "q")).orderBy("query_id").collect()] == [(0, "a b"), (1, ""), (2, "> c")]
    (tmp_path / "docs" / "x").write_text("no number")
    with pytest.raises(Exception, match="not a document's number"):
        corpus.directory(spark, str(tmp_path / "docs")).collect()


@pytest.mark.parametrize(
    "slots,want",
    [([[5], [2, 8]], (3, 1, [5, 8])), ([[1, 10], [2, 11]], (1, 1, [1, 2])), ([[1], [5], [3]], (6, 1, [1, 5, 3])), ([[4, 9]], (0, 0, [4]))],
)
def test_ties_of_proximity(spark, slots, want):
    rows = [(0, 0, 1, len(slots), s, p) for s, ps in enumerate(slots) for p in ps]
    r = retrieval.proximity(spark.createDataFrame(rows, "query_id long, combo_id int, doc_id long, slots int, slot int, pos int"), len(slots)).first()
    assert (r.distance, r.ordered_pairs, r.positions) == want


def test_proximity_like_the_whole_product(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for d in range(60):
        lists = [sorted(rnd.sample(range(1, 40), rnd.randrange(1, 6))) for _ in range(1 + d % 4)]
        rows += [(0, d % 4, d, len(lists), s, p) for s, ps in enumerate(lists) for p in ps]
        key = lambda c: (sum(abs(b - a) for a, b in zip(c, c[1:])), -sum(b > a for a, b in zip(c, c[1:])), min(c))
        want[d] = min(map(key, itertools.product(*lists)))[:2]
    got = retrieval.proximity(spark.createDataFrame(rows, "query_id long, combo_id int, doc_id long, slots int, slot int, pos int"), 4).collect()
    assert {r.doc_id: (r.distance, -r.ordered_pairs) for r in got} == want


def test_ranks_in_ranges(spark):
    rnd = random.Random(3)
    rows = [(q, c, d, rnd.randrange(3), rnd.randrange(2), [1]) for q in (0, 1) for d in range(100) for c in range(rnd.randrange(1, 3))]
    df = spark.createDataFrame(rows, "query_id long, combo_id int, doc_id long, distance long, ordered_pairs long, positions array<int>")
    want = set()
    for q in (0, 1):
        best = {}
        for r in rows:
            if r[0] == q:
                best[r[2]] = min(best.get(r[2], (9,)), (r[3], -r[4], r[1]))
        want |= {(q, n + 1, d) for n, (_, _, d) in enumerate(sorted((b[0], b[1], d) for d, b in best.items()))}
    assert {tuple(r)[:3] for r in retrieval.rank(df).collect()} == want
    assert {tuple(r)[:3] for r in retrieval.rank(df, 7).collect()} == {w for w in want if w[1] <= 7}


def test_fuzzy_joins_agree(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    left = spark.createDataFrame([(w,) for w in sorted(set(words[:40]))], "q string")
    right = spark.createDataFrame([(w, 1) for w in sorted(set(words))], "cand string, cf long")
    a = sorted(map(tuple, fuzzy.scan_join(left, right).select("q", "cand", "edit").collect()))
    b = sorted(map(tuple, fuzzy.deletion_join(left, right).select("q", "cand", "edit").collect()))
    assert a == b and len(a) > 100


def test_many_query_words_take_the_equi_join(spark, monkeypatch):
    vocab = spark.createDataFrame([("cat", 1, 1, False, "c"), ("car", 90, 1, False, "c")], "term string, cf long, df long, is_stop boolean, bucket string")
    words = spark.createDataFrame([("cat", 1), ("car", 90)], "q string, cf long")
    few = sorted(map(tuple, fuzzy.non_obvious(words, vocab).collect()))
    monkeypatch.setattr(fuzzy, "SCAN_WORDS", 1)
    assert sorted(map(tuple, fuzzy.non_obvious(words, vocab).collect())) == few and few


VOCAB = "term string, cf long, df long, is_stop boolean, bucket string"


@pytest.mark.parametrize("other,cf,edit,kept", [("car", 19, 1, True), ("car", 18, 1, False), ("cars", 76, 2, True), ("cars", 75, 2, False)])
def test_non_obvious_thresholds(spark, other, cf, edit, kept):
    vocab = spark.createDataFrame([("cat", 1, 1, False, "c"), (other, cf, 1, False, "c")], VOCAB)
    got = fuzzy.non_obvious(spark.createDataFrame([("cat", 1)], "q string, cf long"), vocab).collect()
    assert [(r.cand, r.edit) for r in got] == ([(other, edit)] if kept else [])
    words = spark.createDataFrame([(0, 0, "cat")], "query_id long, slot int, word string")
    alternatives = retrieval.correct(words, vocab, spark.createDataFrame([(1000,)], "sumf long")).orderBy("alt_no").collect()
    assert [r.term for r in alternatives] == ([other, "cat"] if kept else ["cat"])


@pytest.mark.parametrize("cf,word,kept", [(94, "abcx", True), (93, "abcx", False), (376, "abxx", True), (374, "abxx", False)])
def test_obvious_thresholds(spark, cf, word, kept):
    vocab = spark.createDataFrame([("abcd", cf, 1, False, "a"), ("abce", 5000, 1, False, "a")], VOCAB)
    stats = spark.createDataFrame([(100_000,)], "sumf long")
    got = {r.cand for r in fuzzy.obvious(spark.createDataFrame([(word,)], "q string"), vocab, stats).collect()}
    assert ("abcd" in got) == kept and "abce" in got


def test_combinations_vary_the_last_slot_fastest(spark):
    slots = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "c"), (0, 1, 1, "d"), (1, 0, 0, "e")], "query_id long, slot int, alt_no int, term string")
    rows = retrieval.combine(slots).groupBy("query_id", "combo_id").agg(F.array_sort(F.collect_list(F.struct("slot", "term")))["term"].alias("t")).orderBy("query_id", "combo_id").collect()
    assert [(r.query_id, "".join(r.t)) for r in rows] == [(0, "ac"), (0, "ad"), (0, "bc"), (0, "bd"), (1, "e")]
