import os

import pytest

from quirelake.functions import yaml_values as Y
from quirelake.operators import structure as M
from quirelake.sources import files
from quirelake.streaming import parse as stream
from pyspark.sql import functions as F


def tree(root):
    for path, text in {"a.md": "# A", "b/B.MARKDOWN": "# B", "b/skip/c.md": "x", "b/.gitignore": "skip/\n*.tmp.md\n!keep.tmp.md\n", "b/x.tmp.md": "x", "b/keep.tmp.md": "k", ".hidden/h.md": "h", "_u.md": "u", "n.txt": "n", "b/odd [1] +é.md": "odd", "own.md": "o", ".mine": "own.md"}.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "w") as f:
            f.write(text)
    with open(os.path.join(root, "bad.md"), "wb") as f:
        f.write(b"\xff\xfe")


def test_listing_and_reading(spark, tmp_path):
    root = str(tmp_path)
    tree(root)
    assert files.listing(root) == ["_u.md", "a.md", "b/B.MARKDOWN", "b/keep.tmp.md", "b/odd [1] +é.md", "bad.md", "own.md"]
    assert "b/skip/c.md" in files.listing(root, ignore_files=False) and ".hidden/h.md" in files.listing(root, hidden=True)
    assert "own.md" not in files.listing(root, custom_ignore=".mine")
    got = {r.path: (r.name, r.content) for r in files.read_folder(spark, root).collect()}
    assert got == {"_u.md": ("_u", "u"), "a.md": ("a", "# A"), "b/B.MARKDOWN": ("B", "# B"), "b/keep.tmp.md": ("keep.tmp", "k"), "b/odd [1] +é.md": ("odd [1] +é", "odd"), "own.md": ("own", "o")}
    with pytest.raises(NotADirectoryError, match="not a folder"):
        files.listing(root + "/none")


def test_stream_gives_the_batch_result(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"# H{i}\n\ntext [[L{i}]]\n") for i in range(20)], "doc_id long, content string")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream.parse_to(stream.read(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(M.parsed(docs).collect())
    assert files.to_ndjson(got).where(F.col("value").contains('"type":"wikilink"')).count() == 20


def test_yaml_values(spark):
    text = "---\ntitle: yes\nday: 2026-01-01\nn: 3\nlist: [a, {b: 1.5}]\nflag: true\n1: x\n---\nbody"
    root = Y.load(Y.block_text(text))
    assert (root["title"], root["day"], root["n"], root["flag"]) == ("yes", "2026-01-01", 3, True)
    assert Y.value_at(root, "list[1].b") == 1.5 and Y.display(root["list"]) == "a, b: 1.5"
    for path, why in (("list[9]", "len 2"), ("none", "key 'none' not found"), ("n.x", "key 'x' on a non-mapping"), ("n[0]", "non-sequence"), ("", "empty key"), (".b", "empty key"), ("n[", "unclosed"), ("n[x]", "not a number"), ("n[0]x", "expected")):
        with pytest.raises(KeyError, match=why):
            Y.value_at(root, path)
    assert Y.to_json({1: 2}) == "null"
    d = spark.createDataFrame([(text,), ("none",), (None,), ("---\na: [\n---\n",)], "c string")
    assert [r[0] for r in d.select(Y.frontmatter_value(F.col("c"), "list")).collect()] == ['["a", {"b": 1.5}]', None, None, None]
