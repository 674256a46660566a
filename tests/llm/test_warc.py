import duckdb
import pytest

from episodica.llm import warc

SCHEMA = "rec_id long, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>, r string"


def rec(i, url, ts, status, etag=None, modified=None, digest=None, headers=None):
    return (i, url, ts, status, etag, modified, digest, headers, "clash")


def resolve(spark, rows, **options):
    return {r.rec_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_canonical_addresses(spark):
    pairs = [("HTTP://www.Example.com:80/a/?utm_source=x&b=1#top", "example.com/a?b=1"), ("https://u@example.com/a", "example.com/a"),
             ("https://example.com", "example.com"), ("https://example.com/?ref=a", "example.com"), ("https://example.com:8080/A", "example.com:8080/A"), ("nonsense", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in pairs], "u string")
    assert [r[0] for r in df.select(warc.canonical_url(df.u)).collect()] == [b for _, b in pairs]


def test_verdicts_and_headers(spark):
    u = "http://a.com/x"
    full = rec(1, u, 100, 200, "e1", "m", "d", {"etag": "e1", "date": "1", "content-length": "9"})
    rows = [full, rec(2, "https://www.a.com/x/", 200, 304, "W/e1", None, None, {"date": "2", "content-length": "0", "vary": "z"}),
            rec(3, u, 300, 304, "e2", "m", "d", {"date": "3"}), rec(4, u, 100, 304, "e1"), rec(5, u, 50, 304, "e1"), rec(6, u, 400, 304),
            rec(7, u, 400, 304, None, "m2", "d"), rec(8, None, 400, 304), rec(9, u, None, 304), rec(10, u, 400, 404), rec(11, u, 500, 304, None, None, "d")]
    got = resolve(spark, rows)
    assert {k: r.verdict for k, r in got.items()} == {2: "resolved", 3: "changed", 4: "missing", 5: "missing", 6: "unverified", 7: "changed", 8: "missing",
                                                      9: "missing", 11: "resolved"}
    assert got[2].ref_id == 1 and got[2].headers == {"etag": "e1", "date": "2", "content-length": "9", "vary": "z"}
    assert got[3].headers == {"date": "3"} and got[6].headers == full[7] and got[4].headers == {}


@pytest.mark.parametrize("stretch", [1, 7, 10**9])
def test_latest_earlier_equals_brute_force(spark, stretch):
    rows = [rec(i, f"http://h{i % 3}.com/", (i * 37) % 50, 200 if i % 4 == 0 else 304) for i in range(200)]
    got = resolve(spark, rows, stretch=stretch)
    for i, url, ts, status, *_ in rows:
        if status == 304:
            earlier = [(x[2], x[0]) for x in rows if x[3] == 200 and x[1] == url and x[2] < ts]
            assert got[i].ref_id == (max(earlier)[1] if earlier else None)


def test_repeated_rows_and_empty(spark):
    rows = [rec(1, "http://a.com/", 1, 200, headers={"a": "1"}), rec(2, "http://a.com/", 2, 304)]
    out = warc.resolve_revisits(spark.createDataFrame(rows * 3, SCHEMA)).collect()
    assert [(r.rec_id, r.verdict, r.ref_id, r.headers) for r in out] == [(2, "unverified", 1, {"a": "1"})] * 3
    # one id for several records: each is judged by what it says itself
    mixed = [rec(1, "http://a.com/", 1, 200, "e1"), rec(1, "http://b.com/", 1, 200, "e2"), rec(1, "http://a.com/", 2, 304, "e1"), rec(1, "http://b.com/", 2, 304, "e1"),
             rec(None, "http://a.com/", 3, 304, "e1", headers={"date": "3"}), rec(None, "http://a.com/", 4, 304, "e9")]
    out = warc.resolve_revisits(spark.createDataFrame(mixed, SCHEMA)).collect()
    assert sorted((r.address, r.ts, r.verdict, str(r.headers)) for r in out) == [
        ("a.com", 2, "resolved", "{}"), ("a.com", 3, "resolved", "{'date': '3'}"), ("a.com", 4, "changed", "{}"), ("b.com", 2, "changed", "{}")]
    twice = [rec(1, "http://a.com/", 1, 200, "e2"), rec(1, "http://a.com/", 1, 200, "e1"), rec(2, "http://a.com/", 2, 304, "e1")]
    assert [r.verdict for r in warc.resolve_revisits(spark.createDataFrame(twice, SCHEMA)).collect()] == ["resolved"]
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    out = warc.resolved_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    cur = con.execute(warc.RESOLVED_SQL)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in out.columns) for r in cur.fetchall()))
    assert sorted(map(tuple, out.collect())) == want
