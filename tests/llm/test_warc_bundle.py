import io

import pytest
import zstandard

from compare import duck, same
from llmdata import SF
from tracewalk.llm import warc_bundle as wb
from tracewalk.llm.queries import QUERIES, SQL


def test_query_agrees_with_sql(spark):
    same(QUERIES["op9_seekable_warc"](spark, SF), duck(SF), SQL["op9_seekable_warc"])


def test_a_bundle_is_plain_warc_and_seekable(tmp_path):
    out = wb.BundleWriter()
    digest = "A" * 32
    for i in range(700):
        out.add(wb.record_id(i, digest), wb.warc_record(i, f"http://x/{i}", b"<p>%d</p>" % i, len(b"<p>%d</p>" % i), digest, None, "1970-01-01T00:00:00Z"))
    out.add(wb.record_id(700, digest), wb.warc_record(700, None, None, 8, digest, 3, "1970-01-01T00:00:00Z"))
    (tmp_path / "b").write_bytes(out.finish())
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "b").read_bytes()), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC/1.1\r\n") == 701
    b = wb.BundleReader(f"file://{tmp_path}/b")
    assert len(b.sizes) == 3 and b.index[300][1] == 1 and b.index[256][2] == 0
    head, payload = b.record(b.index[300])
    assert payload == b"<p>300</p>" and head["WARC-Target-URI"] == "http://x/300"
    head, payload = b.record(b.index[700])
    assert payload == b"" and wb.page_of(head["WARC-Refers-To"]) == 3 and "WARC-Target-URI" not in head


SCHEMA = "page_id long, url string, html string, sha1 string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", "p") for r in rows], SCHEMA).repartition(3)


def read(df, **kw):
    return sorted((tuple(r) for r in wb.read_bundles(wb.write_bundles(df, **kw)).collect()), key=repr)


def test_odd_rows(spark):
    rows = [(5, "http://a/\r\nx: y", "same é"), (3, None, "same é"), (3, None, "same é"), (9, "u", None), (8, "u", ""), (None, "u", "same é"), (None, "u", "lone"), (7, "u", "x" * 3_000_000), (6, "u", "\r\n\r\nWARC/1.1")]
    got = {(r[0], r[1]): r for r in read(pages(spark, rows))}
    assert got[5, 7][3:] == ("revisit", 3) and got[3, 7][3:] == ("response", None) and got[None, 7][3:] == ("revisit", 3)
    assert got[8, 0][3:] == ("response", None) and got[9, 0][3:] == ("revisit", 8) and got[9, 0][2] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert got[None, 4][3] == "response" and got[7, 3_000_000][3] == "response" and got[6, 12][3] == "response"
    assert read(pages(spark, [])) == []


def test_least_bytes_of_a_revisit(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    assert [(r[0], r[3]) for r in read(pages(spark, rows), min_revisit_bytes=3)] == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_large_partitions_go_to_several_bundles(spark, monkeypatch):
    assert wb.write_bundles(pages(spark, [(i, "u", str(i)) for i in range(50)]).coalesce(1)).agg({"n_records": "sum"}).first()[0] == 50


def test_damage_is_noticed(tmp_path):
    with pytest.raises(ValueError, match="seek table"):
        (tmp_path / "x").write_bytes(b"\0" * 64)
        wb.BundleReader(f"file://{tmp_path}/x")
