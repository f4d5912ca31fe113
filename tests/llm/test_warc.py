import base64
import hashlib

from roamer.llm import warc


def want(rows):
    top = {}
    for p, _, h in rows:
        h = h or ""
        top[h] = max(top.get(h, -10**9), -10**9 if p is None else p)
    out = []
    for p, _, h in rows:
        raw, first = (h or "").encode(), top[h or ""]
        mine = (-10**9 if p is None else p) == first
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if mine else "revisit",
                    None if mine else first))
    return sorted(map(str, out))


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, kind string, record_id string")


def test_round_trip(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.example/p/{i}?q=é {i}\r\nX: y", f"<p>{i % 9}</p>\r\n\r\nWARC/1.1\r\n" * (i % 5)) for i in range(60)]
    rows += [(70, None, None), (71, "", ""), (72, "http://[bad", "é" * 20000), (60, "u", "same"), (60, "u", "same"), (61, "v", "one"), (None, "w", "one"), (None, "z", "lone")]
    files = warc.write_archives(make(spark, rows).repartition(3), str(tmp_path / "w"), 3000)
    assert files.count() > 3
    out = warc.captures(files).collect()
    got = sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in out)
    assert got == want(rows)
    for r in out:
        assert r["response"]["concurrent_to"] == r["metadata"]["concurrent_to"] == r["request"]["record_id"]
        assert r["request"]["http_line"].startswith("GET ") and r["response"]["http_line"] == "HTTP/1.1 200 OK"
    back = warc.read_records(files, payloads=True).filter("kind = 'response'").collect()
    assert {bytes(r["payload"]).decode() for r in back} == {h or "" for _, _, h in rows}


def test_files_are_plain_warc(spark, tmp_path):
    import gzip

    f = warc.write_archives(make(spark, [(1, "http://a/", "x")]), str(tmp_path / "w")).first()["uri"]
    raw = gzip.open(f).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.count(b"WARC-Record-ID") == 4 and raw.endswith(b"\r\n\r\n")


def test_empty_table(spark, tmp_path):
    assert warc.captures(warc.write_archives(make(spark, []), str(tmp_path / "w"))).count() == 0
