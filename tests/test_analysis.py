import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import index

TOKENS = [
    ("it's 3.14 and 1,234,567 u.s. plan b. x-ray b2b 2nd", "it 's 3.14 and 1,234,567 u.s. plan b. x ray b2b 2 nd"),
    ("été schäden niño_x 12abc", "été schäden niño_x 12 abc"),
    ("192.168.1.1 dogs' hadn't $3.50", "192.168 . 1.1 dogs ' hadn 't 3.50"),
    ("1,234.56 don’t", "1,234 . 56 don t"),
    ("e.g. the u.s.a end.next a_b covid19 1,23 o'clock", "e.g. the u.s. a end . next a_b covid19 1 23 o ' clock"),
    ("rock'n'roll 'til well-known -5 50%", "rock ' n ' roll ' til well known 5 50"),
]
NORMAL = [
    ("don't hadn't isn't", " do not  hadn't  is not "),
    ("can't", " can not "),
    ("won't", " will not "),
    ("shan't", " shall not "),
    ("ain't", " are not "),
    ("pi 3.14, ip 192.168.1.1 $3.50 7.5", "pi , ip 192.168.1.1 $3.50 "),
    ("1.5 2.5 1.2.x", "  .x"),
]
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog.\n\nThe dog sleeps.\n"),
    (2, "A fox and a dog. It's lazy.\n"),
    (3, "Dogs don't read 3.14 books; the dog's owner reads 1,234 books.\n"),
]
POSITIONS = {
    1: "the* quick brown fox jump over* the* lazy dog the* dog sleep",
    2: "a* fox and* a* dog it* s* lazy",
    3: "dog do* not* read book the* dog owner read 1234 book",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,want", TOKENS)
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens) == want.split()


@pytest.mark.parametrize("text,want", NORMAL)
def test_normalised(spark, text, want):
    assert one(spark, text, lambda c: T.without_decimals(T.expanded(c))) == want


def test_positions_of_the_small_corpus(docs):
    rows = index.positions(docs, "rules").orderBy("doc_id", "pos").collect()
    for d, want in POSITIONS.items():
        got = [r for r in rows if r.doc_id == d]
        assert [r.term + "*" * r.is_stop for r in got] == want.split()
        assert [r.pos for r in got] == list(range(1, len(got) + 1))


def test_lines_and_vocabulary(docs):
    found = index.positions(docs, "rules")
    assert sorted((r.doc_id, r.end_pos) for r in index.lines(docs, found).collect()) == [(1, 9), (1, 12), (2, 8), (3, 11)]
    vocab = index.vocabulary(index.postings(found))
    main = {r.term: r.cf for r in vocab.where("not is_stop").collect()}
    assert main == {"dog": 5, "fox": 2, "lazy": 2, "read": 2, "book": 2, "quick": 1, "brown": 1, "jump": 1, "sleep": 1, "owner": 1, "1234": 1}
    assert index.stats(vocab).first().sumf == 18
    lists = {r.term: r.doc_ids for r in index.posting_lists(index.postings(found)).collect()}
    assert lists["dog"] == [1, 2, 3] and lists["the"] == [1, 3]
    assert {r.term: r.doc_id for r in index.last_document_only(index.postings(found)).collect()}["the"] == 3


@pytest.mark.parametrize(
    "word,want",
    [("axes", {"axis", "ax", "axe"}), ("knives", {"knife", "knive", "knif", "kniv", "knivis"}), ("bodies", {"body", "bodie", "bodi", "bodiis"}), ("classes", {"class", "classe", "classis"}), ("matrices", {"matrix", "matrice", "matric", "matricis"}), ("men", set()), ("women", {"woman"})],
)
def test_trims(spark, word, want):
    assert want <= set(one(spark, word, T.trims)) and (want or not one(spark, word, T.trims))


def test_null_empty_and_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "...\n!!\r\n"), (4, "x\r y\r\nz"), (None, "a")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.term, r.pos, r.line_no) for r in index.positions(df).collect())
    assert got == [("4", "x", 1, 0), ("4", "y", 2, 1), ("4", "z", 3, 2), ("None", "a", 1, 0)]


def test_lemmas_by_attested_bases(spark):
    df = spark.createDataFrame([(1, "jump jumping hope hoping stop stopped sing king tried try dying die bus buses")], "doc_id long, text string")
    table = {r.term: r.lemma for r in index.lemma_table(index.tagged_positions(df)).collect()}
    assert table["jumping"] == "jump" and table["hoping"] == "hope" and table["stopped"] == "stop" and table["dying"] == "die" and table["buses"] == "bus"
    assert "king" not in table and "sing" not in table
