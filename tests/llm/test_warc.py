"""Seekable WARC bundles: round trips, duplicates by a plain rule, and the bytes against tools that do not know the table."""

import hashlib
import io
import struct
from collections import defaultdict
from urllib.parse import urlparse

import pyarrow.fs as fs
import pytest
import zstandard

from brackwater.llm import common, warc

LONG = "<p>" + "a page with words that repeat " * 60
ROWS = [
    (1, "http://a/1", LONG),
    (2, "http://a/2", LONG),
    (7, "http://a/7\nx%", LONG),
    (3, "http://a/3", "short"),
    (4, "http://a/4", "short"),
    (5, None, None),
    (6, "http://a/6", ""),
    (None, "http://a/n", LONG),
    (8, "http://b/8", "é\r\n\r\n\U0001f600" * 400),
    (9, "http://b/9", "x" * 1000),
    (10, "http://b/10", "x" * 1000),
    (11, "http://b/11", "x" * 999),
    (12, "http://b/12", "x" * 999),
    (None, "http://c/1", "only rows without ids " * 100),
    (None, "http://c/2", "only rows without ids " * 100),
    (13, "http://d/13", "word " * 400_000),
    (14, "http://d/14", "z" * 3000),
    (14, "http://d/14", "z" * 3000),
    (-3, "http://d/m", "z" * 3000),
]


def pages_of(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.selectExpr("*", "'x' as digest", "1 as refers_to", "1 as newest", "'y' as twin", "true as long", "1 as path") if clash else df


def plain(rows):
    """page_id, bytes, digest, type, target of every row, by the rule as it is stated."""
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        known = [i for i in groups[html or ""] if i is not None]
        target = max(known) if len(data) >= 1000 and known and page_id != max(known) else None
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if target is None else "revisit", target))
    return sorted(map(repr, out))


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("small", [True, False], ids=["told", "shuffled"])
def test_records_come_back(spark, clash, small, monkeypatch):
    if not small:
        monkeypatch.setattr(common, "SMALL_ROWS", 0)
        monkeypatch.setattr(common, "small", lambda df: df.hint("merge"))
    folder = common.new_dir(spark, "warc")
    index = warc.write_bundles(pages_of(spark, ROWS, clash), folder, frame=2000, bundle=5000)
    assert sorted(repr(tuple(r)) for r in warc.read_bundles(index, folder).collect()) == plain(ROWS)
    assert index.count() > index.select("path").distinct().count() > index.selectExpr("split(path, '-\\\\w+.warc')[0]").distinct().count()


def test_lookup_reads_a_frame_by_its_place(spark):
    folder = common.new_dir(spark, "warc")
    index = warc.write_bundles(pages_of(spark, ROWS), folder, frame=4000)
    got = {r.page_id: r for r in warc.lookup(index, folder, spark.createDataFrame([(8,), (1,), (5,), (7,), (8,), (99,)], "page_id long")).collect()}
    assert set(got) == {8, 1, 5, 7}
    assert got[8].payload.decode() == ROWS[8][2] and got[1].payload is None and got[1].refers_to == 7 and got[5].url is None
    assert got[7].url == "http://a/7\nx%" and got[7].payload.decode() == LONG
    assert warc.located(index).count() == len(ROWS)


def test_bundles_are_plain_zstandard_and_warc(spark):
    folder = common.new_dir(spark, "warc")
    index = warc.write_bundles(pages_of(spark, ROWS).coalesce(1), folder, frame=4000)
    (path,) = [r.path for r in index.select("path").distinct().collect()]
    stored = open(urlparse(path).path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(stored), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS) == whole.count(b"WARC-Record-ID: ")
    # The seek table, taken apart by hand: sizes of all frames, then their number.
    n = struct.unpack("<I", stored[-9:-5])[0]
    table = struct.unpack(f"<{2 * n}I", stored[-9 - 8 * n : -9])
    frames = sorted(index.collect(), key=lambda r: r.frame)
    assert n == len(frames) and [r.stored for r in frames] == list(table[::2]) and [r.bytes for r in frames] == list(table[1::2])
    assert sum(table[1::2]) == len(whole) and [r.at for r in frames] == [sum(table[: 2 * i : 2]) for i in range(n)]
    with fs.LocalFileSystem().open_input_file(urlparse(path).path) as source:
        r = warc.BundleReader(source)
        assert b"".join(r.frame(i) for i in reversed(range(n)))[: len(r.frame(n - 1))] == r.frame(n - 1)
        assert r.frame(2)[frames[2].offsets[0] :].startswith(b"WARC/1.1")


def test_damage_is_told():
    record = warc.encode_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.decode_record(record, 0)[0].payload == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(record.replace(b"abc", b"abd"), 0)
    with pytest.raises(ValueError, match="seek table"):
        warc.BundleReader(fs.LocalFileSystem().open_input_file(__file__))


def test_no_pages(spark):
    folder = common.new_dir(spark, "warc")
    assert warc.read_bundles(warc.write_bundles(pages_of(spark, []), folder), folder).count() == 0
