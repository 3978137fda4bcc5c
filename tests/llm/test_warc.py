import hashlib
import json
import os

from quirelake.llm import warc

SCHEMA = "page_id long, url string, html string, file string, size long"


def pages(n=120):
    return [(i, f"http://h{i % 7}.example.com/{i}?q=a b", f"<html>{'päge ' * (i % 50)}{i}</html>", "clash", 1) for i in range(n)]


def files(folder):
    return {f: hashlib.sha256(open(os.path.join(folder, f), "rb").read()).hexdigest() for f in os.listdir(folder) if not f.startswith(".")}


def test_round_trip_and_same_bytes_however_partitioned(spark, tmp_path):
    rows = pages()
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    index = warc.write(docs.repartition(5), one, 4000)
    warc.write(docs.orderBy("html").coalesce(2), two, 4000)
    assert files(one) == files(two) and len(files(one)) > 3
    back = warc.read(spark, one).collect()
    assert all(r.intact for r in back)
    assert sorted((r.page_id, r.url, r.html) for r in back) == sorted((i, u.replace(" ", "%20"), h) for i, u, h, _, _ in rows)
    listed = {x["file"]: x for x in map(json.loads, open(os.path.join(one, "MANIFEST.jsonl")))}
    assert set(listed) == set(files(one)) - {"MANIFEST.jsonl"}
    for name, x in listed.items():
        assert os.path.getsize(os.path.join(one, name)) == x["bytes"]
    order = [(r.file, r.offset, r.url.encode()) for r in index.orderBy("file", "offset").collect()]
    assert [u for _, _, u in order] == sorted(u for _, _, u in order)
    import gzip

    for r in index.limit(20).collect():
        with open(os.path.join(one, r.file), "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and r.payload_digest.encode() in record


def test_files_keep_to_their_size(spark, tmp_path):
    index = warc.write(spark.createDataFrame(pages(300), SCHEMA), str(tmp_path / "x"), 5000)
    sizes = index.groupBy("file").sum("length").collect()
    longest = index.agg({"length": "max"}).first()[0]
    assert all(s[1] <= 5000 + longest for s in sizes)


def test_edges(spark, tmp_path):
    rows = [(1, None, "a", None, None), (None, "http://x/\r\nInjected: 1", "b", None, None), (2, "http://x", None, "f", 1), (3, "http://x", "", "f", 1), (4, "http://y", "z" * 3_000_000, None, 1), (5, "http://z", "same", None, 1), (5, "http://z", "same", None, 1)]
    folder = str(tmp_path / "e")
    index = warc.write(spark.createDataFrame(rows, SCHEMA), folder, 1)
    assert index.count() == len(rows)
    back = warc.read(spark, folder).collect()
    assert len(back) == len(rows) and all(r.intact for r in back)
    assert sorted((r.page_id or 0, r.url, len(r.html)) for r in back) == [(0, "http://x/%0D%0AInjected:%201", 1), (1, None, 1), (2, "http://x", 0), (3, "http://x", 0), (4, "http://y", 3_000_000), (5, "http://z", 4), (5, "http://z", 4)]
    empty = str(tmp_path / "none")
    assert warc.write(spark.createDataFrame([], SCHEMA), empty).count() == 0
    assert os.listdir(empty) == ["MANIFEST.jsonl"] or "MANIFEST.jsonl" in os.listdir(empty)
    assert warc.read(spark, empty).count() == 0


def test_every_record_has_an_id_of_its_own_and_its_date(spark, tmp_path):
    import gzip
    import re

    rows = [(1, "http://x", "same", "2020-01-02 03:04:05")] * 5 + [(1, "http://x", "same", "2021-01-01 00:00:00"), (2, "http://x", "other", None)] + [(None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, seen string")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    index = warc.write(docs, one, 1 << 20, date=docs["seen"]).collect()
    warc.write(docs.repartition(3), two, 1 << 20, date=docs["seen"])
    assert files(one) == files(two)
    data = open(os.path.join(one, index[0].file), "rb").read()
    records = [gzip.decompress(data[r.offset : r.offset + r.length]).decode() for r in index]
    ids = [re.search("WARC-Record-ID: <(.*)>", r)[1] for r in records]
    assert len(set(ids)) == len(rows)
    dates = sorted(re.search("WARC-Date: (.*)\r", r)[1] for r in records)
    assert dates == sorted(["2020-01-02T03:04:05Z"] * 5 + ["2021-01-01T00:00:00Z"] + [warc.DATE] * 4)
    assert all(r.intact for r in warc.read(spark, one).collect())
