import datetime as dt
import gzip
import random

import duckdb

from tidemark.llm import warc_revisit as W

SCHEMA = "record_id long, kind string, url string, captured timestamp, status int, digest string, etag string, last_modified string, headers map<string,string>, body string, original_id string"


def brute(rows):
    out = {}
    for r in rows:
        if r["kind"] != "revisit":
            continue
        old = dt.datetime(1, 1, 1)
        earlier = [o for o in rows if o["kind"] == "response" and o["url"] == r["url"] and (o["captured"] or old, o["record_id"]) < (r["captured"] or old, r["record_id"])]
        best = max(earlier, key=lambda o: (o["captured"] or old, o["record_id"]), default=None)
        good = False
        if best:
            for c in ("digest", "etag", "last_modified"):
                if r[c] is not None and best[c] is not None:
                    good = r[c].removeprefix("W/") == best[c].removeprefix("W/") if c == "etag" else r[c] == best[c]
                    break
        out[r["record_id"]] = (best and best["record_id"], good, best["body"] if good else None)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        pick = lambda *x: rng.choice((None, *x))
        rows.append({"record_id": i, "kind": rng.choice(("response", "revisit")), "url": f"http://h.example/{min(rng.randrange(9), 4)}", "captured": rng.choice((None, *(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(3000)) for _ in range(30)))), "status": 200, "digest": pick("a", "b"), "etag": pick('"x"', 'W/"x"', '"y"'), "last_modified": pick("m", "n"), "headers": {"ETag": "q", "Server": "s"}, "body": f"body {i}", "original_id": "clash"})
    got = {r.record_id: (r.original_id, r.resolved, r.body) for r in W.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_canonical_urls(spark):
    urls = ["HTTP://www.Example.com:80/a/?b=2&a=1&utm_source=x#top", "https://example.com/a?a=1&b=2", "http://example.com", "http://example.com/", None, "no scheme", "dns:a.example", "urn:b#c", " "]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.k for r in df.select(W.canonical_url(df.url).alias("k")).collect()]
    assert got == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", "example.com", "example.com", None, ":no scheme", ":dns:a.example", ":urn:b", None]


def test_headers_that_may_be_renewed(spark):
    rows = [dict(record_id=1, kind="response", url="http://a.example/", captured=dt.datetime(2024, 1, 1), status=200, etag='"e"', headers={"etag": '"e"', "Content-Type": "text/html", "Expires": "1"}, body="b"), dict(record_id=2, kind="revisit", url="http://a.example", captured=dt.datetime(2024, 1, 2), status=304, etag='"e"', headers={"ETag": 'W/"e"', "Content-Type": "text/plain", "Expires": "2"})]
    got = W.resolve(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.resolved and got.headers == {"ETag": 'W/"e"', "Content-Type": "text/html", "Expires": "2"} and got.body == "b" and got.status == 200


def test_file_format_round_trip():
    records = [{"kind": "response", "url": "http://a.example/é", "captured": "2024-01-01T00:00:00Z", "id": 1, "status": 200, "digest": "sha1:X", "headers": {"ETag": '"e"', "A": "b: c"}, "body": b"x\r\n\r\nWARC/1.1 inside"}, {"kind": "revisit", "url": "http://a.example/", "captured": "2024-01-02T00:00:00Z", "id": 2, "status": 304, "headers": {"Last-Modified": "m"}}]
    got = list(W.read_warc(W.write_warc(records)))
    assert [r["kind"] for r in got] == ["response", "revisit"] and got[0]["body"] == records[0]["body"] and got[0]["etag"] == '"e"' and got[0]["headers"] == records[0]["headers"] and got[1]["last_modified"] == "m" and got[1]["status"] == 304


def test_query_against_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = W.revisit_rows(spark.read.parquet(f"{folder}/pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.sql(W.ORACLE)
    assert found.columns == want.columns
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(want.fetchall()) and len(got) == 750
    for k in (2, 3, 4):  # entity tag, digest, Last-Modified: each resolves some rows and leaves some
        resolved = [r[3] for r in got if r[0] % 5 == k]
        assert any(resolved) and (k == 2 or not all(resolved))
    assert {r[2] % 5 for r in got} == {0, 1}


def test_archives_of_a_folder(spark, tmp_path):
    body = gzip.compress(b"inside")
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (body[:7], body[7:])) + b"0\r\n\r\n"
    first = {"kind": "response", "url": "http://a.example/", "captured": "2024-01-01T00:00:00Z", "id": 1, "status": 200, "headers": {"ETag": '"e"', "Content-Encoding": "gzip", "Transfer-Encoding": "chunked"}, "body": chunked}
    again = {"kind": "revisit", "url": "http://a.example/#x", "captured": "2024-01-02T00:00:00Z", "id": 2, "status": 304, "headers": {"ETag": 'W/"e"'}}
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(W.write_warc([first]))
    whole = W.write_warc([again, first | {"id": 3, "url": "http://b.example/"}])
    (tmp_path / "deep" / "b.warc.gz").write_bytes(whole[:-20])  # breaks off within its second record
    (tmp_path / "c.warc").write_bytes(b"")
    records = W.read_archives(spark, str(tmp_path))
    assert records.count() == 2
    row = W.resolve(records).collect()
    assert len(row) == 1 and row[0].resolved and bytes(row[0].body) == b"inside" and row[0].status == 200


def test_hot_originals(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT_ORIGINALS", 10)
    day = dt.datetime(2024, 1, 1)
    base = {"status": 200, "digest": "a", "headers": {}, "captured": day, "url": "http://h.example/"}
    rows = [base | {"record_id": 0, "kind": "response", "body": "b"}, *(base | {"record_id": i, "kind": "revisit", "captured": day + dt.timedelta(seconds=i)} for i in range(1, 300)), base | {"record_id": 500, "kind": "revisit", "url": "urn:x"}]
    got = W.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 300 and sum(r.resolved for r in got) == 299 and {r.body for r in got if r.resolved} == {"b"}


def test_edge_tables(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "", "x"), (1, "", "x"), (2, "http://a.example/", "y" * 100_000)], "page_id long, url string, html string")
    assert W.revisit_rows(pages).count() == 12
    assert W.revisit_rows(pages.limit(0)).count() == 0
