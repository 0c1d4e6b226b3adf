import hashlib
import html
import re
import zlib

from thermaweave.llm import media
from thermaweave.llm.common import doc_columns, table

from .helpers import AWKWARD, clashing, docs, words


def test_round_trip(spark):
    rows = AWKWARD + [(30, "x" * 192), (31, "x" * 193), (32, words(900)), (33, words(900))]
    found = media.interleave(doc_columns(clashing(docs(spark, rows)))).collect()
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b" " * ((-len(b)) % 192 if b else 192)
        form = b"P6\n64 %d\n255\n" % (len(p) // 192) + p
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(form), hashlib.sha256(form).hexdigest()))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in found), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in found}
    assert by[32].feature == by[33].feature and by[30].feature != by[31].feature and by[32].caption == f"{by[32].n_bytes} bytes"
    assert media.interleave(doc_columns(docs(spark, []))).count() == 0


def test_parse_order_and_captions():
    html = '<html><head><title>no</title></head><body>a <b>b</b><figure><img src="sha256:1"><img src="sha256:2" alt="z"><figcaption>c &amp; d</figcaption></figure><p>e<script>x</script> f<img src="http://g" alt="h"></p></body>'
    found = [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.parse(html)]
    assert found == [(0, "text", "a b", None, None), (1, "media", None, "1", "c & d"), (2, "media", None, "2", "c & d"), (3, "text", "e f", None, None), (4, "media", None, None, "h")]
    assert media.parse(None) == [] and media.parse("") == []


def test_unknown_digest_stays_without_payload(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:nowhere">'), (2, None)], "page_id long, html string")
    store = media.describe(media.media_store(docs(spark, [(1, "a")])))
    found = media.resolve(media.sequences(pages), "page_id", store).collect()
    assert len(found) == 1 and found[0].payload_bytes is None and found[0].digest == "nowhere"


def test_sequence_holds_the_whole_text(spark):
    rows = AWKWARD + [(40, "first & last\n\n<b>second</b> line\n" + words(900) + "\n  &amp; \u00a0 tail"), (41, words(3000))]
    found = media.interleave(doc_columns(docs(spark, rows))).collect()
    want = []
    for i, t in rows:
        items = [" ".join(x.split()) for x in (t or "").split("\n") if x.split()]
        text = "\n".join(items).encode()
        want.append((i, min(1, len(items)), len(items) + 1, len(items), len(text), hashlib.sha256(text).hexdigest()))
    assert sorted(((r.doc_id, r.position, r.n_items, r.n_texts, r.text_bytes, r.text_sha256) for r in found), key=repr) == sorted(want, key=repr)


def by_patterns(page):
    """The items of a page without captions, by patterns in place of a parser."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    page = re.sub(r"(?is)<(script|style|head|template|noscript)\b[^>]*>.*?</\1\s*>", "", page)
    media_tag, block = r"(?:img|video|audio|source)", "|".join(media.BLOCKS)
    out = []
    for part in re.split(rf"(?i)(<{media_tag}\b[^>]*>)|</?(?:{block})\b[^>]*>", page):
        if part and re.match(rf"(?i)<{media_tag}\b", part):
            found = re.search(r'src="sha256:([^"]*)"', part)
            out.append(("media", None, found and found[1]))
        elif text := " ".join(html.unescape(re.sub(r"<[^>]*>", "", part or "")).split()):
            out.append(("text", text, None))
    return [(k, *x) for k, x in enumerate(out)]


def test_items_of_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    found = media.page_items(spark, sf)
    assert found.columns == ["page_id", "position", "kind", "text", "digest", "caption"]
    want = [(r.page_id, *x) for r in table(spark, sf, "pages").collect() for x in by_patterns(r.html or "")]
    assert sorted((r.page_id, r.position, r.kind, r.text, r.digest) for r in found.collect()) == sorted(want) != []


def test_several_figures_keep_their_places_and_payloads(spark):
    texts = [words(40, seed=k) for k in range(4)]
    digests = [hashlib.sha256(media.payload_of(t.encode())).hexdigest() for t in texts]
    figure = lambda k, more="": f'<figure><img src="sha256:{digests[k]}"{more}><figcaption>no. {k}</figcaption></figure>'
    pages = [(1, f"<p>a{figure(0)}b</p>{figure(1)}{figure(0)}<p>c"), (2, f'd<img src="sha256:{digests[2]}" alt="bare">{figure(3)}e'), (3, None), (4, "<p> </p>")]
    described = media.describe(media.media_store(docs(spark, list(enumerate(texts)))))
    items = media.sequences(spark.createDataFrame(pages, "page_id long, html string"))
    got = sorted((r.page_id, r.position, r.caption, r.payload_sha256) for r in media.resolve(items, "page_id", described).collect())
    assert got == [(1, 1, "no. 0", digests[0]), (1, 3, "no. 1", digests[1]), (1, 4, "no. 0", digests[0]), (2, 1, "bare", digests[2]), (2, 2, "no. 3", digests[3])]
    held = {r.page_id: [(i.kind, i.text) for i in r["items"] if i.kind == "text"] for r in items.collect()}
    assert held == {1: [("text", "a"), ("text", "b"), ("text", "c")], 2: [("text", "d"), ("text", "e")], 3: [], 4: []}
