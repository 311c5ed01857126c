import duckdb
import pandas as pd

from tessera.llm import url_templates as u


def test_host_path_and_rules(spark):
    urls = ["http://A.Net/x", "https://www.example.net/en/1?q=/de/", "http://example.com/de/", "http://xexample.com/de/", "x.org/fr/", "http://b.org/fr/9#a", None, "", "http://c.net", "://?a/b", "http://EXAMPLE.net/EN/1", "http://é.net/é", "a://b/c://d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, good double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(df, labels).collect()}
    want = [("a.net", "/x", "net/", "block"), ("www.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("xexample.com", "/de/", None, "allow"), ("", "", None, "allow"), ("b.org", "/fr/9", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("c.net", "", None, "allow"), ("", "", None, "allow"), ("example.net", "/EN/1", "net/", "block"), ("é.net", "/é", "net/", "block"), ("b", "/c://d", None, "allow")]
    assert [got[i] for i in range(len(urls))] == want


def test_bad_template_is_rejected_as_in_sql(spark):
    rows = [(i, f"http://h.com/{'bad' if i % 2 else 'ok'}/{i}/x/y/z/w") for i in range(200)] + [(300, None), (300, None)]
    pages = pd.DataFrame(rows, columns=["page_id", "url"])
    labels = pd.DataFrame([(i, 1 - i % 2, 0) for i in range(200)] + [(0, None, 0), (0, 1, 0)], columns=["doc_id", "quality", "toxic"])
    good = labels.dropna().assign(good=lambda x: x.quality * (1 - x.toxic)).rename(columns={"doc_id": "page_id"})[["page_id", "good"]]
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(good.astype({"good": float}))).collect()
    assert {(r.page_id % 2, r.verdict) for r in got if r.page_id < 200} == {(0, "allow"), (1, "block")}
    assert len(got) == 202
    con = duckdb.connect()
    con.register("pages", pages), con.register("labels", labels)
    sql = con.sql(u.oracle()).select("page_id, host, path, rule, verdict, template").fetchall()
    assert sorted(map(repr, sql)) == sorted(repr(tuple(r)) for r in got)


def verdicts(spark, rows, good):
    got = u.judge(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, template string, n int"), spark.createDataFrame(good, "page_id long, good double")).collect()
    return {r.page_id: (r.template, r.verdict) for r in got}


def test_more_traffic_does_not_change_a_template(spark):
    few = [(i, f"http://h.com/{'bad' if i % 2 else 'ok'}/{i % 40 // 2}-a/page") for i in range(40)]
    many = [(i, f"http://h.com/{'bad' if i % 2 else 'ok'}/{i % 40 // 2}-a/page") for i in range(2_000)]
    a, b = (verdicts(spark, rows, [(i, 1.0 - i % 2) for i, _ in rows]) for rows in (few, many))
    assert {a[0], a[1]} == {b[0], b[1]} == {("/ok", "allow"), ("/bad", "block")}
    words = [f"{x}{y}" for x in ("ab", "cd", "ef", "gh") for y in ("ij", "kl", "mn", "op")]
    named = verdicts(spark, [(i, f"http://h.com/u/{words[i % 16]}/{'bad' if i % 3 == 0 else 'ok'}") for i in range(1_600)], [(i, float(i % 3 > 0)) for i in range(1_600)])
    assert {named[0], named[1]} == {("/u/*/bad", "block"), ("/u/*/ok", "allow")}


def test_inner_branches_merge_and_frequent_paths_may_be_deep(spark):
    deep = "/".join("abcdefghijklmn")
    rows = [(i, f"http://h.com/{'x' if i % 2 else 'y'}/{deep}/{'p' if i % 4 < 2 else 'q'}") for i in range(400)]
    alike = verdicts(spark, rows, [(i, float(i // 4 % 10 > 0)) for i, _ in rows])
    assert set(alike.values()) == {("/", "allow")}
    apart = verdicts(spark, rows, [(i, float(i % 4 < 2)) for i, _ in rows])
    assert {apart[0], apart[1]} == {(f"/y/{deep}/p", "allow"), (f"/x/{deep}/p", "allow")} and {apart[2], apart[3]} == {(f"/y/{deep}/q", "block"), (f"/x/{deep}/q", "block")}


def test_very_long_urls(spark):
    rows = [(1, "http://h.com/" + "a/" * 20_000), (2, "http://h.com/" + "b" * 100_000), (3, "http://h.com/a/b"), (3, "http://h.com/a/b")]
    assert {v for _, v in verdicts(spark, rows, []).values()} == {"allow"}


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, good double")).count() == 0
