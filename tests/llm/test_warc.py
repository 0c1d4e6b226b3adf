import hashlib
import re

import duckdb

from thermaweave.llm import warc


def test_records(spark, tmp_path):
    html = '<html lang="fr"><head><title> A &amp;\n B </title><style>p{}</style></head><body><!-- x --><p>one<br>two <b>three</b></p><script>var t="</p>";</script><a href="/x">l</a></body></html>'
    pages = spark.createDataFrame([(1, "http://u", html, 9), (2, None, None, 9), (3, "http://u", "", 9), (1, "http://u", html, 9)], "page_id long, url string, html string, block int")
    found = warc.derive(pages).collect()
    assert len(found) == 8
    text = [r for r in found if r.record_type == "conversion" and r.page_id == 1][0]
    assert text.block == "one\ntwo three\nl" and text.block_type == "text/plain" and text.source_length == len(html)
    meta = [r for r in found if r.record_type == "metadata" and r.page_id == 1][0]
    assert meta.block == "title: A & B\r\nlanguage: fr\r\nlinks: 1\r\n" and meta.refers_to == text.refers_to and meta.record_id != text.record_id
    assert [r for r in found if r.page_id == 2][0].target_uri is None
    record = [r.record for r in warc.serialised(warc.derive(pages.limit(1))).collect() if "conversion" in r.record][0]
    head, body = record.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.1\r\nWARC-Date: ") and f"Content-Length: {len(body.encode())}" in head and body == text.block
    warc.write(warc.derive(pages), str(tmp_path / "w"))
    assert warc.derive(pages.limit(0)).count() == 0


def test_all_references(spark):
    from html import unescape
    from html.entities import html5

    names = [f"&{k}" for k in sorted(html5)]
    texts = [" | ".join(names[k : k + 100]) for k in range(0, len(names), 100)] + ["&copy; 2020 &middot; A&#8217;s &#x1F600; &#169 &amp;copy; &amp;nbsp; &unknown; a & b &lt;p&gt;&#128;&#0;", "a&nbsp;b&#160;&#xA0;c&#1600;"]
    pages = spark.createDataFrame([(k, "u", f"<title>{t}</title><p>{t}</p>") for k, t in enumerate(texts)] + [(900, None, None), (901, "u", "")], "page_id long, url string, html string")
    found = {(r.page_id, r.record_type): r for r in warc.derive(pages, all_references=True).collect()}

    def spaced(x):
        for p, r in warc.SPACES:
            x = re.sub(p, r, x)
        return x.strip(" \n")

    for k, t in enumerate(texts):
        want = spaced(unescape(re.sub(r"&nbsp;?|&#160;|&#xA0;", " ", t)))
        assert found[k, "conversion"].block == want and found[k, "metadata"].block == f"title: {want}\r\nlanguage: \r\nlinks: 0\r\n"
        assert found[k, "conversion"].block_digest == "sha256:" + hashlib.sha256(want.encode()).hexdigest() and found[k, "conversion"].block_length == len(want.encode())
    assert found[900, "conversion"].block == "" and found[901, "conversion"].block == "" and len(found) == 2 * len(texts) + 4
    plain = {(r.page_id, r.record_type): r for r in warc.derive(pages).collect()}
    assert all(plain[k].record_id == found[k].record_id and plain[k].refers_to == found[k].refers_to for k in found)


def read_records(data):
    """An independent reader: (headers, block) of concatenated records."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        head = dict(line.split(": ", 1) for line in lines)
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        out.append((head, block))
        at = end + 8 + n
    return out


def test_files_read_back(spark, tmp_path):
    long = "<p>" + "long words stand here é &copy; " * 60_000
    pages = spark.createDataFrame([(1, "http://u\r\nX: y", "<title>t</title><p>a<script>var x = '<p>no</p>'", 0), (2, "http://v", long, 0), (3, None, "<!-- open <p>no", 0), (4, "http://w", "<style>p{}", 0)], "page_id long, url string, html string, created int").drop("created")
    for every in (False, True):
        records = warc.derive(pages, all_references=every)
        path = str(tmp_path / f"w{every}")
        warc.write(records, path)
        found = [r for p in sorted((tmp_path / f"w{every}").glob("part-*")) for r in read_records(p.read_bytes())]
        want = {r.record_id: r for r in records.collect()}
        assert len(found) == 8 == len(want)
        for head, block in found:
            r = want[head["WARC-Record-ID"]]
            assert block.decode() == r.block and head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            assert head["WARC-Refers-To"] == r.refers_to and head["X-Source-Payload-Digest"] == r.source_digest and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"]) and "X" not in head
        text = {r.page_id: r.block for r in want.values() if r.record_type == "conversion"}
        assert text[1] == "a" and text[3] == text[4] == ""
        assert text[2] == ("long words stand here é %s " % ("©" if every else "&copy;") * 60_000).strip()


def test_headers_dates_and_ids_of_the_response(spark, tmp_path):
    block = "HTTP/1.1 200 OK\r\nContent-Type: application/xhtml+xml;\r\n charset=utf-8 \r\nX-A: b: c\r\nnot a field\r\nServer: $1 \\ s\r\n\r\n"
    day = "2024-02-29T23:30:00-01:00"
    rows = [
        (1, "http://u", "<title>t</title>x", block, day, "<urn:uuid:one>", "p"), (2, "http://u", "y", "etag: 1", "no day", "<urn:uuid:one>", "p"), (3, None, None, None, None, None, None),
        (4, "http://u", "z", "", day, None, "p"), (4, "http://u", "z", "", day, None, "p"), (4, "http://u", "z", "", "2024-03-02 00:00:00Z", None, "p"), (None, "", "", "\r\n", "", "", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, head string, day string, rid string, source_type string")
    for every in (False, True):
        records = warc.derive(pages, every, headers="head", date="day", source_id="rid")
        found = records.collect()
        assert len(found) == 14 and records.columns[-2:] == ["source_headers", "created"]
        meta = {r.page_id: r for r in found if r.record_type == "metadata" and r.page_id != 4}
        fields = ["Content-Type: application/xhtml+xml; charset=utf-8 ", "X-A: b: c", "Server: $1 \\ s"]
        assert meta[1].source_type == "application/xhtml+xml; charset=utf-8" and meta[1].source_headers == "\r\n".join(fields)
        assert meta[1].block == "title: t\r\nlanguage: \r\nlinks: 0\r\n" + "".join(f"source-{f}\r\n" for f in fields)
        assert meta[1].created == "2024-03-01T00:30:00Z" and meta[2].created is None and meta[3].created is None
        assert meta[1].refers_to == meta[2].refers_to == "<urn:uuid:one>" and meta[1].record_id != meta[2].record_id
        assert meta[2].source_type == meta[3].source_type == meta[None].source_type == "text/html" and meta[2].block.endswith("source-etag: 1\r\n")
        assert meta[3].source_headers is None and meta[3].refers_to.startswith("<urn:uuid:") and meta[None].refers_to.startswith("<urn:uuid:")
        assert len({r.record_id for r in found}) == 12  # two rows are equal
        assert len({r.refers_to for r in found if r.page_id == 4}) == 2
        path = tmp_path / f"h{every}"
        warc.write(records, str(path))
        written = [h for p in sorted(path.glob("part-*")) for h, _ in read_records(p.read_bytes())]
        assert sorted(h["WARC-Record-ID"] for h in written) == sorted({r.record_id for r in found})
        assert {h["WARC-Date"] for h in written} == {"2024-03-01T00:30:00Z", "2024-03-02T00:00:00Z", warc.CREATED}
        assert {h["X-Source-Content-Type"] for h in written} == {"text/html", "application/xhtml+xml; charset=utf-8"}
        plain = warc.derive(pages, every)
        assert plain.columns == records.columns[:-2] and {r.source_type for r in plain.collect()} == {"text/html"}
        assert warc.derive(pages.limit(0), every, "head", "day", "rid").count() == 0
    stamped = pages.withColumn("day", pages.day.try_cast("timestamp"))
    assert {r.created for r in warc.derive(stamped, date="day").collect()} == {"2024-03-01T00:30:00Z", "2024-03-02T00:00:00Z", None}


def test_sql_decodes_what_the_query_decodes(spark):
    from html.entities import html5

    numbers = [*range(300), 0x2019, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**30]
    parts = [" ".join(f"a&{k}b" for k in sorted(html5)), " ".join(f"&#{n};&#{n} &#x{n:x}; &#X{n:X}g" for n in numbers)]
    parts += ["&amp;copy; &amp;nbsp; &unknown; a & b &&amp;& &#; &#x; &#000160;&#x00a0;x&nbspx&nbsp &ltp&gt &noti; &notin; é&copyé &" + "x" * 50, "&" + "copy" * 20 + ";&lt;p&gt;\u00a0"]
    rows = [(k, "u", f"<html lang=de><title>{t}</title><p>{t}</p><br>{t}") for k, t in enumerate(parts)] + [(7, None, None), (8, "u", ""), (0, "u", "&lt;"), (0, "u", "&lt;"), (None, None, "&gt;&#10;x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    for query, sql in ((warc.derive(pages), warc.ORACLE), (warc.serialised(warc.derive(pages)), warc.SERIALISED)):
        theirs = con.sql(sql)
        assert query.columns == theirs.columns
        assert sorted(map(tuple, query.collect()), key=repr) == sorted(theirs.fetchall(), key=repr)
