import random

from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import index, retrieval
from tessera.plans.search import Index, search
from tessera.session import materialise, scratch
from tessera.sources import corpus
from tessera.streaming import service

FILES = {"3": "The dog sat.\nA cat slept here.\n", "12": "Dogs and cats are reading\r\nbooks", "7": ""}


def folder(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in FILES.items():
        (docs / name).write_bytes(text.encode())
    return str(docs)


def test_build_and_search_by_the_command_line(spark, tmp_path, capsys):
    docs, place = folder(tmp_path), str(tmp_path / "index")
    (tmp_path / "queries").write_text("dog\n> cat\n\n> books reading\n")
    cli.main(["build", docs, place])
    cli.main(["search", place, str(tmp_path / "queries")])
    assert capsys.readouterr().out.splitlines() == ["3", "12", "> 3", "A cat slept here.", "> 12", "Dogs and cats are reading", "> 12", "Dogs and cats are reading", "books"]


def test_empty_files_and_wrong_names(spark, tmp_path):
    path = folder(tmp_path)
    assert {r.doc_id: r.text for r in corpus.directory(spark, path).collect()} == {int(k): v for k, v in FILES.items()}
    (tmp_path / "docs" / "notes.txt").write_text("x")
    try:
        corpus.directory(spark, path).collect()
    except Exception as e:
        assert "not a document's number" in str(e)
    else:
        raise AssertionError


def test_lines_of_a_text_stream_are_queries_each(spark, tmp_path):
    idx = Index.build(corpus.directory(spark, folder(tmp_path)))
    (tmp_path / "asked").mkdir()
    (tmp_path / "asked" / "a.txt").write_text("cat\ndog\ncat\n")
    rows = []
    service.serve(service.text_stream(spark, str(tmp_path / "asked")), idx, lambda df, n: rows.extend(df.collect()), str(tmp_path / "state"), spell=False).awaitTermination()
    assert sorted(r.doc_id for r in rows) == [3, 3, 3] and len({r.query_id for r in rows}) == 3


def test_a_stream_that_goes_on(spark, tmp_path):
    idx = Index.build(corpus.directory(spark, folder(tmp_path)))
    asked = tmp_path / "asked"
    asked.mkdir()
    rows = []
    stream = service.serve(service.text_stream(spark, str(asked)), idx, lambda df, n: rows.extend(df.collect()), str(tmp_path / "state"), every="1 second", spell=False)
    for name in ("a", "b"):
        (tmp_path / name).write_text("dog\n")
        (tmp_path / name).rename(asked / name)
        stream.processAllAvailable()
    stream.stop()
    assert len(rows) == 2


def test_scratch_tables_go(spark, tmp_path):
    with scratch(spark):
        made = materialise(spark.range(3), "three")
        files = made.inputFiles()
        assert made.count() == 3
    from pathlib import Path
    from urllib.parse import urlparse

    assert files and not any(Path(urlparse(f).path).exists() for f in files)


def test_an_index_that_contradicts_itself_is_found(spark, tmp_path):
    idx = Index.build(corpus.directory(spark, folder(tmp_path)))
    sound = {r.problem: r.many for r in index.problems(idx.positions, idx.postings, idx.vocabulary).collect()}
    assert set(sound.values()) == {0} and len(sound) == 5
    broken = index.problems(idx.positions.union(idx.positions.limit(1)), idx.postings.where("term <> 'dog'"), idx.vocabulary)
    assert all(r.many for r in broken.collect() if r.problem != "posting twice")


def test_proximity_is_linear_and_like_all_ways(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for doc in range(60):
        slots = rnd.choice([1, 2, 3, 4, 5, 6])
        at = [sorted(rnd.sample(range(1, 16), rnd.randrange(1, 5))) for _ in range(slots)]
        if slots > 1 and doc % 3 == 0:
            at[1] = at[0]  # a repeated word
        rows += [(0, 0, doc, slots, s, p) for s, ps in enumerate(at) for p in ps]
        ways = [()]
        for ps in at:
            ways = [(*w, p) for w in ways for p in ps]
        want[doc] = min((sum(abs(b - a) for a, b in zip(w, w[1:])), -sum(b > a for a, b in zip(w, w[1:])), min(w), w) for w in ways)
    found = spark.createDataFrame(rows, "query_id long, combo_id int, doc_id long, slots int, slot int, pos int")
    got = {r.doc_id: (r.distance, -r.ordered_pairs, min(r.positions), tuple(r.positions)) for r in retrieval.proximity(found, 6).collect()}
    assert got == want
    # one text with 100,000 uses of either word
    many = spark.range(200_000).selectExpr("0L as query_id", "0 as combo_id", "1L as doc_id", "2 as slots", "cast(id % 2 as int) as slot", "cast(3 * id + 1 as int) as pos")
    assert [tuple(r)[3:] for r in retrieval.proximity(many, 2).collect()] == [(3, 1, [1, 4])]


def test_ranks_of_sparse_ids(spark):
    rnd = random.Random(4)
    rows = [(q, 0, rnd.getrandbits(62) - 2**61, rnd.randrange(4), rnd.randrange(2), [1]) for q in range(3) for _ in range(400)]
    found = spark.createDataFrame(rows, "query_id long, combo_id int, doc_id long, distance long, ordered_pairs long, positions array<int>").repartition(7)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in retrieval.rank(found).collect())
    want = []
    for q in range(3):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (r[3], -r[4], r[2]))
        want += [(q, i + 1, r[2]) for i, r in enumerate(mine)]
    assert got == want


def test_six_words(spark, tmp_path):
    idx = Index.build(corpus.directory(spark, folder(tmp_path)))
    got = search(idx, corpus.inline(spark, ["the dog sat a cat slept", "cats and dogs reading books are"]), spell=False).collect()
    assert {(r.query_id, r.doc_id, r.distance, r.ordered_pairs) for r in got} == {(0, 3, 5, 5), (1, 12, 9, 2)}


def test_alternatives_stay_in_their_slot(spark):
    rnd = random.Random(21)
    slots, positions = [], []
    for q, sizes in ((0, [3, 1, 2]), (1, [1, 1]), (2, [4, 3, 2, 3])):
        for s, n in enumerate(sizes):
            slots += [(q, s, a, f"t{q}{s}{a}") for a in range(n)]
    terms = [t for *_, t in slots]
    for doc in range(80):
        positions += [(doc, rnd.choice(terms), p, False) for p in range(1, 40)]
    found = spark.createDataFrame(positions, "doc_id long, term string, pos int, is_stop boolean").withColumn("bucket", F.lit("t"))
    rows = index.postings(found)
    wanted = spark.createDataFrame(slots, "query_id long, slot int, alt_no int, term string")
    combos = retrieval.combine(wanted)
    old = retrieval.rank(retrieval.proximity(retrieval.slot_positions(combos, retrieval.matches(combos, rows), found), 4))
    new = retrieval.rank(retrieval.proximity(retrieval.alternative_positions(wanted, retrieval.slot_matches(wanted, rows), found), 4))
    a, b = (sorted(tuple(r) for r in x.collect()) for x in (old, new))
    assert a == b and len({r[0] for r in a}) == 3
    # eight words of twenty alternatives
    many = spark.range(160).selectExpr("9L as query_id", "cast(id / 20 as int) as slot", "cast(id % 20 as int) as alt_no", "concat('t', cast(id % 7 as int), '0', cast(id % 3 as int)) as term")
    assert retrieval.slot_matches(many, rows).count() > 0
