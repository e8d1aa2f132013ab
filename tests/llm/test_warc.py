import base64
import gzip
import hashlib
import io

from sensorlab.llm import warc

from .conftest import ODD_TEXTS

SCHEMA = "page_id long, url string, html string, revisit string"


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_write_and_read_back(make, spark):
    texts = [*ODD_TEXTS, "copy", "copy", "copy", "\r\n\r\n", "WARC/1.1\r\n\r\n"]
    rows = [(i, f"http://h/{i}?q=ü%41\r\nx y", t, "c") for i, t in enumerate(texts)] + [(None, None, "copy", "c"), (3, None, "", "c")]
    df = make(rows, SCHEMA)
    files = warc.write_archives(warc.mark_revisits(df))
    got = warc.read_archives(spark, files, payload=True).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    top = {}
    for i, _, t, _ in rows:
        top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
    want = set()
    for i, u, t, _ in rows:
        again = top[t or ""] != i
        want.add((i, u, len((t or "").encode()), sha(t), "revisit" if again else "response", top[t or ""] if again else None,
                  None if again else (t or "").encode()))
    assert {(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
             None if r.payload is None else bytes(r.payload)) for r in got} == want


def test_min_bytes(make):
    rows = [(1, None, "ab", "c"), (2, None, "ab", "c"), (3, None, "abcdef", "c"), (4, None, "abcdef", "c")]
    out = {r.page_id: r.refers_to for r in warc.mark_revisits(make(rows, SCHEMA), min_bytes=3).collect()}
    assert out == {1: None, 2: None, 3: 4, 4: None}


def test_damage_is_reported():
    a = warc.record(1, "u", b"payload one", "d", None, False)
    b = warc.record(2, "u", b"payload two", "d", None, False)

    def read(raw):
        return [(r.get("page_id"), r["problem"]) for r in warc.read_archive(io.BytesIO(raw))]
    assert read(a + b) == [(1, None), (2, None)]
    forged = gzip.compress(gzip.decompress(a).replace(b"payload one", b"payload 0ne"))
    assert read(forged + b) == [(1, "block digest differs"), (2, None)]
    assert read(gzip.compress(gzip.decompress(a) + gzip.decompress(b)))[0][1] == "more than one record in a member"
    cut = read(a + b[:-20])
    assert cut[0] == (1, None) and cut[1][0] is None and "ends within" in cut[1][1]
    assert "length" in read(gzip.compress(gzip.decompress(a)[:-15]))[0][1]
    assert read(b"") == []


def test_empty_table(make, spark):
    files = warc.write_archives(warc.mark_revisits(make([], SCHEMA)))
    assert warc.read_archives(spark, files).count() == 0


def test_url_of_any_length():
    url = "http://h/" + "漢字" * 200_000
    raw = warc.record(1, url, b"one", "d", None, False) + warc.record(2, "u", b"two", "d", None, False)
    got = list(warc.read_archive(io.BytesIO(raw), payload=True))
    assert [(r["page_id"], r["url"], r["payload"], r["problem"]) for r in got] == [(1, url, b"one", None), (2, "u", b"two", None)]


def test_repeated_ids_that_are_the_largest(make, spark):
    """Rows that share the largest id of a payload all stay responses; the rest revisit that id."""
    df = make([(5, "a", "same", "c"), (5, "b", "same", "c"), (3, "c", "same", "c"), (3, "d", "same", "c")], SCHEMA)
    got = warc.read_archives(spark, warc.write_archives(warc.mark_revisits(df))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [(3, "revisit", 5)] * 2 + [(5, "response", 0)] * 2
