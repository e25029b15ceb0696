"""URL rules against their SQL, and filter lists against every rule run on every url."""

import os
import re

import pytest

from shelfcast.llm import urlrules, vafile

SF = "/root/testdata/sf0.1"


def read(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
@pytest.mark.parametrize("query, table", [(urlrules.op6_url_rules, "pages"), (vafile.op10_va_file_top_k, "embeddings")])
def test_query_equals_its_sql(spark, query, table):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    sql = (urlrules if table == "pages" else vafile).SQL
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    got = query(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert read(got, names) == sorted(found.fetchall(), key=repr)


ODD = [
    "http://a.example/x.PNG?y", "http://a.example/x.png/y", "http://sex.example/casino-poker", "http://b.com/?PHPSESSID=1&print=yes",
    "http://b.com/print=1", "https://x.net/a.jpeg", "https://x.net/ajpeg", "http://x.org/casino", "casino", "", "://", "http://", "ext:pdf",
    "http://x.net/warez_login", "http://x.net/?q=login#cart", "http://example.org/en/1?sex", "http://x.net/a.mp3#t"]


def test_own_rules_equal_the_sql_on_odd_urls(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    rows = [*enumerate(ODD), (98, None), (99, "http://x.net/casino"), (99, "http://x.net/casino")]
    db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    found = db.execute(urlrules.SQL)
    names = [d[0] for d in found.description]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, host string, rule int")
    got = urlrules.judged(pages, urlrules.BASE + urlrules.OWN)
    assert read(got, names) == sorted(found.fetchall(), key=repr)
    assert {r.own_rule for r in got.collect()} > {"param:phpsessid", "ext:jpeg", "word:casino", "ext:mp3"}
    assert urlrules.judged(pages.filter("page_id < 0"), urlrules.BASE + urlrules.OWN).count() == 0


SYNTAX = """
! places
||ads.example^
@@||ads.example/help|
|http://plain.
banner*300x250
/track/*/pixel.gif^
-promo-
&id=7|
"""
FITS = {
    "http://ads.example/": "||ads.example^", "http://x.ads.example": "||ads.example^", "http://badads.example/": None,
    "http://ads.example.com/": None, "https://ads.example/help": "@@||ads.example/help|", "https://ads.example/helpful": "||ads.example^",
    "HTTP://PLAIN.net": "|http://plain.", "https://plain.net": None, "http://y/banner_300x250": "banner*300x250",
    "http://y/300x250banner": None, "http://y/track/a/b/pixel.gif?1": "/track/*/pixel.gif^", "http://y/track/pixel.gif": None,
    "http://y/a-promo-b": "-promo-", "http://y/?a&id=7": "&id=7|", "http://y/?a&id=77": None}


def test_filter_list_syntax(spark):
    rules = urlrules.filter_rules(SYNTAX)
    pages = spark.createDataFrame(list(enumerate(FITS)), "page_id long, url string")
    rows = {r.page_id: r for r in urlrules.judged(pages, rules).collect()}
    for k, (url, name) in enumerate(FITS.items()):
        assert rows[k].own_rule == name, url
        assert rows[k].verdict == ("block" if name and not name.startswith("@@") else "allow")
    with pytest.raises(ValueError):
        urlrules.filter_rules("||x^$third-party")


def test_thousands_of_rules_run_on_few_urls(spark):
    lines = [f"||site{i}.example^" for i in range(1500)] + [f"/dir{i}/*/page{i % 7}." for i in range(500)] + [f"@@||site{i}.example/ok/" for i in range(0, 1500, 10)]
    rules = urlrules.filter_rules("\n".join(lines))
    urls = [f"http://www.site{i * 7}.example/{'ok' if i % 3 else 'no'}/" for i in range(200)] + [f"http://h/dir{i}/a/page{i % 7}.html" for i in range(50)]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    index = urlrules.rule_index(frame.select(urlrules.url_tokens(frame.url).alias("_tokens")), rules)
    assert "" not in index and sum(map(len, index.values())) == len(rules)
    compiled = {r: re.compile(r.pattern) for r in rules}
    runs = 0
    for url in urls:
        near = [r for t in urlrules.TOKEN.findall(url) for r in index.get(t, ())]
        runs += len(near)
        assert {r for r in near if compiled[r].search(url)} == {r for r in rules if compiled[r].search(url)}
    assert runs < 3 * len(urls) < len(rules)
