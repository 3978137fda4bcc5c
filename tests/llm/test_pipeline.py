import random
import sys
from pathlib import Path

import corpus_pipeline as cp
sys.path.insert(0, str(Path(__file__).parent))
from tests_llm_shared import LANGS, edited, prose


def corpus(seed=2):
    rng = random.Random(seed)
    rows, planted = [], {"toxic": set(), "copies": {}, "leaks": set(), "unknown": set()}
    items = [(k, prose(rng, "en", 40, True)) for k in range(6)]
    for i in range(160):
        lang = rng.choice(list(LANGS))
        rows.append([i, prose(rng, lang, rng.randint(60, 200)), lang, f"src{i % 4}", 0])
    for i in range(0, 48, 4):
        rows[i][1] += " you are a pathetic idiot this worthless moron scum"
        planted["toxic"].add(i)
    for k, i in enumerate(range(1, 48, 4)):
        rows.append([1000 + k, edited(rng, rows[i][1], 2), rows[i][2], "src1", 0])
        planted["copies"][1000 + k] = i
    for k, i in enumerate(range(2, 26, 4)):
        rows[i][1] += " " + items[k][1]
        planted["leaks"].add(i)
    for i in (150, 151):
        rows[i][1] = "12345 !!! 678 ???" * i
        planted["unknown"].add(i)
    return [tuple(r) for r in rows], items, planted


def test_stages_against_brute_force(spark, tmp_path):
    rows, items, planted = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] in planted["toxic"])) for r in rows if r[0] % 2], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        if k < 4:
            assert docs.columns == columns
            kept.append({r.doc_id for r in docs.collect()})
    every = {r[0] for r in rows}
    assert every - kept[0] == planted["unknown"]
    assert kept[0] - kept[1] == planted["toxic"]
    gone = kept[1] - kept[2]
    assert gone == {c for c, i in planted["copies"].items() if i in kept[1]}
    assert kept[2] - kept[3] == planted["leaks"]
    chosen = {r.doc_id for r in docs.collect()}
    assert chosen and chosen <= kept[3]
    got = sorted(tuple(r) for r in cp.run(spark, sf).collect())
    assert got == sorted(tuple(r) for r in docs.collect())


def test_stages_on_awkward_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "some benchmark item words here.")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, group_id string, pattern int, words double"
    rows = [(None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "g", 1, 1.0), (2, "plain words of text " * 20_000, None, None, None, None, None, None), (3, "a few words", "en", "s", 11, "g", 1, 2.0), (3, "a few words", "en", "s", 11, "g", 1, 2.0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, sf)
            assert k == 4 or out.columns == docs.columns
            got = sorted(tuple(r) for r in out.select("doc_id", "text", "lang", "source").collect() if k < 4)
            texts = [r for r in data if r[1] is not None and r[1].strip()]
            assert k == 4 or set(got) <= {tuple(r[:4]) for r in data} and all(got.count(tuple(r[:4])) <= data.count(r) for r in texts)
            docs = out if k < 4 else docs
