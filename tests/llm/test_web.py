"""URL filters against SQL and brute force; WARC round trips."""

import datetime as dt
import hashlib
import random

import duckdb
import pandas as pd
import pytest

from sparkfolio.llm import urls, warc

DAY = dt.datetime(2024, 1, 1)


def at(n):
    return DAY + dt.timedelta(days=n)


def test_captures_by_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.example.org", "example.org", "other.net"]
    entries = [(rng.choice(hosts), rng.choice(["block", "allow", "remove"]), at(rng.randint(0, 20))) for _ in range(40)] + [("EXAMPLE.com", "block", at(3)), (None, "block", at(1)), ("other.net", "block", None), ("[2001:db8::1]", "block", at(2)), ("0.0.1", "block", at(2)), ("10.0.0.1", "allow", at(3)), ("x" * 300, "block", at(1)), ("y" * 200 + ".net." + "z." * 150 + "net", "allow", at(1)), ("z.net", "block", at(1)), ("", "block", at(1))]
    captures = [(i, f"https://{rng.choice(hosts).upper()}:80/p?q#f", at(rng.randint(-1, 22))) for i in range(120)] + [(500, None, at(1)), (501, "nonsense", at(1)), (502, "http://example.com.", None), (503, "http://user@example.com/x", at(9)), (503, "http://user@example.com/x", at(9)), (504, "http://[2001:DB8::1]:8080/x", at(9)), (505, "http://10.0.0.1/", at(9)), (506, "http://" + "long." * 60_000 + "example.com/", at(9)), (507, "http://" + "x" * 300 + "/", at(9)), (508, "http://w." + "y" * 200 + ".net." + "z." * 150 + "net/", at(9)), (509, "http://q." + "z." * 150 + "net/", at(9)), (510, "http://a..b./", at(9))]
    frame = spark.createDataFrame([(i, u, t, "clash", 1) for i, u, t in captures], "id long, url string, fetched_at timestamp, host string, _host int")
    out = urls.judge_captures(frame, spark.createDataFrame(entries, "pattern string, action string, at timestamp")).collect()
    order = {"block": 0, "allow": 1, "remove": 2}
    want = []
    for i, u, t in captures:
        host = None
        if u and "://" in u:
            host = u.split("://")[1].split("/")[0].split("@")[-1].lower()
            host = host.split("]")[0] + "]" if host[0] == "[" else host.split(":")[0].rstrip(".")
        pattern = action = None
        alone = host and (host[0] == "[" or host.replace(".", "").isdigit())
        above = {e[0].lower() for e in entries if e[0] is not None and host and (e[0].lower() == host or (not alone and host.endswith("." + e[0].lower())))}
        for p in sorted(above, key=len, reverse=True):
            known = [(e[2], -order[e[1]], e[1]) for e in entries if e[0] is not None and e[2] and e[0].lower() == p and t is not None and e[2] <= t]
            if known and max(known)[2] != "remove":
                pattern, action = p, max(known)[2]
                break
        want.append((i, host, pattern, action, action != "block"))
    assert sorted((tuple([r.id, r.host, r.matched_pattern, r.matched_action, r.kept]) for r in out), key=repr) == sorted(want, key=repr)
    assert urls.judge_captures(frame.limit(0), spark.createDataFrame([], "pattern string, action string, at timestamp")).count() == 0


def test_page_query_equals_sql(spark):
    rng = random.Random(2)
    pages = pd.DataFrame([(i, f"http{'s' * (i % 2)}://{rng.choice('abcdefgh')}{i % 40}.site{i % 25}.example.com/{i}") for i in range(400)] + [(900, None), (901, "x")], columns=["page_id", "url"])
    frame = spark.createDataFrame(pages.astype(object).where(pages.notna(), None).values.tolist(), "page_id long, url string")
    got = urls.judge_captures(urls.page_captures(frame), urls.dated_lists(frame)).selectExpr("page_id", "url", "unix_timestamp(fetched_at)", "host", "matched_pattern", "matched_action", "kept")
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.sql(urls.SQL).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert 0 < sum(not r[-1] for r in want) < 400


def page_rows():
    rng = random.Random(3)
    big = "".join(rng.choice("abc <p>é\r\n") for _ in range(120_000))
    same = "<html>" + "x" * 300
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n" * 5
    return [(5, "http://a/5", same), (3, "http://a/3", same), (9, "http://a b/\r\n9", same), (1, None, None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "u", big), (10, "u", tricky), (11, "u", tricky), (12, "u", "z" * 99), (13, "u", "z" * 99), (14, "u", "0\r\n\r\n" * 9000)]


def test_archives_round_trip(spark):
    pages = page_rows()
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    out = {r.page_id: r for r in warc.through_archives(frame).collect()}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    want = {r[0]: r for r in con.sql(warc.SQL).fetchall()}
    assert {k: tuple(r) for k, r in out.items()} == want and out[8].refers_to == 7 and out[5].refers_to == 3
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_repeated_null_and_empty(spark):
    big = "y" * 100_000
    frame = spark.createDataFrame([(1, "u", big), (1, "u", big), (None, "u", big), (None, "u", "small")], "page_id long, url string, html string")
    out = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.through_archives(frame).collect()), key=repr)
    assert out == sorted([(1, "response", None, 100_000), (1, "response", None, 100_000), (None, "revisit", 1, 100_000), (None, "response", None, 5)], key=repr)
    assert warc.through_archives(frame.limit(0)).count() == 0


def test_broken_framing_is_told():
    whole = warc.chunked(b"x" * 20_000)
    assert warc.dechunked(whole) == b"x" * 20_000
    for bad in (whole[:-8], whole[:5000], b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    with pytest.raises(ValueError):
        list(warc.parsed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parsed(b"no archive"))


def test_records_can_be_read_from_their_offsets(spark, tmp_path):
    import gzip
    import zlib

    folder = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1), folder)
    (file,) = (tmp_path / "w").glob("part-*")
    raw = file.read_bytes()
    whole = gzip.decompress(raw)
    assert len(list(warc.parsed(whole))) == 30
    at, found = 0, []
    while at < len(raw):
        inflate = zlib.decompressobj(31)
        ((fields, block),) = warc.parsed(inflate.decompress(raw[at:]))
        found.append(fields["warc-record-id"])
        at = len(raw) - len(inflate.unused_data)
    assert len(set(found)) == 30
    with pytest.raises(ValueError):
        list(warc.members(raw[:-5]))


def test_a_wrong_digest_and_other_spellings_are_told(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\ntransfer-ENCODING: chunked\r\n\r\n" + warc.chunked(b"payload")
    def one(page, digest):
        return warc.head([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{page}:x>"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"
    right = hashlib.sha256(b"payload").hexdigest()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-0").write_bytes(gzip.compress(one(1, right) + one(2, "0" * 64)))  # one member for both
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "in")).collect()}
    assert (got[1].payload_bytes, got[1].payload_digest, got[1].problem) == (7, right, None) and "digest" in got[2].problem
