import base64
import hashlib

from tidemark.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, monkeypatch):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3
    long = "é" * 50000 + "\r\n\r\n" + tricky + "ü" * 60000
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\nX: y", None), (4, "http://c/", ""), (5, "u", tricky), (6, "u", long), (7, "u", long), (8, "u", "\r\n\r\n"), (9, "u", "x\r\n"), (9, "u", "y")]
    got = sorted(tuple(r) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    first = {}
    for page, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", page)
    want = []
    for page, _, html in rows:
        lead = first[html or ""]
        want.append((page, len((html or "").encode()), digest(html), "response" if lead == page else "revisit", None if lead == page else lead))
    assert got == sorted(want)


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.archived(df, least_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    assert warc.archived(df.limit(0)).count() == 0


def test_segments_cover_the_payload_and_hold_no_boundary():
    payload = ("aé€😀" * 50 + "\r\n\r\nWARC/1.1\r\n" + "\r\n\r\nWARC" * 5).encode()
    for size in (4, 5, 16, 64, 1000):
        cuts = list(warc.segments(payload, size))
        assert b"".join(payload[a:b] for a, b in cuts) == payload
        for a, b in cuts:
            assert warc.BOUNDARY not in warc.ENDS.encode() + payload[a:b]
            payload[a:b].decode()
    assert list(warc.segments(b"")) == [(0, 0)]


def test_payloads_that_spell_the_version_line_after_a_head(spark):
    size = warc.CHUNK
    texts = ["WARC/1.1\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx", "WARC/1.1\r\n" * 4000, "a" * (size - 4) + "\r\n\r\nWARC/1.1\r\nz", "a" * size + "WARC/1.1\r\nz", "é" * size + "WARC/1.1\r\n" * 3]
    rows = [(i, None, text, "x") for i, text in enumerate(texts)] + [(None, "u", "p", "x")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    got = {r["page_id"]: r for r in warc.archived(df).collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"]) == (len(text.encode()), digest(text), "response")
