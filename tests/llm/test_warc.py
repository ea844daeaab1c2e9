import base64
import gzip
import hashlib

import pytest

from mentionflow.llm import warc
from mentionflow.llm.queries import QUERIES


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def want_of(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of (page_id, html) rows."""
    original = {}
    for i, t in rows:
        if i is not None and len((t or "").encode()) >= least:
            original[t or ""] = max(original.get(t or "", i), i)
    out = []
    for i, t in rows:
        n, first = len((t or "").encode()), original.get(t or "")
        revisit = i is not None and n >= least and i != first
        out.append((i, n, digest(t), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_pages_equal_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = QUERIES["op4_warc_revisits"](spark, sf_dir)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want_of(rows)


ROWS = [(1, "same é"), (2, "same é"), (9, "same é"), (9, "same é"), (3, None), (4, ""), (5, "WARC/1.1\r\n\r\nx\r\n\r\n"), (None, "same é"), (None, ""),
        (6, "big " * 400_000), (7, "big " * 400_000), (-8, "Content-Length: 5\r\n"), (6, "other")]


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, tmp_path, least):
    df = spark.createDataFrame([(i, "http://x/ y\r\nEvil: 1" if n % 2 else None, t, "q") for n, (i, t) in enumerate(ROWS)],
                               "page_id long, url string, html string, digest string")
    path = str(tmp_path / "archives")
    warc.write(warc.records(df.repartition(3), "2024-01-01T00:00:00Z", least_bytes=least), path)
    found = warc.read(spark, path)
    rows = warc.resolved(found).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == want_of(ROWS, least)
    payloads = {(r.page_id, r.payload_digest): bytes(r.payload).decode() for r in rows if r.record_type == "response"}
    assert all(payloads[i, digest(t)] == (t or "") for i, t in ROWS if (i, digest(t)) in payloads)


def test_archives_are_plain_warc(spark, tmp_path):
    path = tmp_path / "archives"
    df = spark.createDataFrame([(1, "http://a/b", "<p>é</p>"), (2, "http://a/c", "<p>é</p>")], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.records(df, "2024-01-01T00:00:00Z"), str(path))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(path.glob("*.gz"))).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.count("WARC-Refers-To: <urn:page:2>") == 1 and "<p>é</p>\r\n\r\n" in text
    assert text.count("<p>") == 1 and "WARC-Target-URI: http://a/b\r\n" in text
    with pytest.raises(ValueError, match="within a record"):
        list(warc.parsed(iter([text.encode()[:-9]])))
    assert warc.read(spark, str(path)).filter("record_type = 'revisit'").count() == 1


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.records(df, "2024-01-01T00:00:00Z"), str(tmp_path / "none"))
    assert warc.resolved(warc.read(spark, str(tmp_path / "none"))).count() == 0
