"""The pipeline against a brute-force version of its stages, on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from sparkcube.llm import language_id
from sparkcube.llm.sql import OP10

SF = "/root/testdata/sf0.001"


def _module():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def _shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark):
    import re

    pipeline = _module()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    results = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, SF)
        now = spark.createDataFrame(out.collect(), out.schema)
        results.append(now)
        if name != "packing":
            assert now.columns == docs.columns
    first, lines, near, clean, packed = results
    # stage 1: posterior and letters decide
    model = language_id.train(docs)
    judged = language_id.predict(docs, model).collect()
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.5}
    # stage 2: the oracle's texts
    con = duckdb.connect()
    con.register("documents", first.toPandas())
    want = con.execute(f"SELECT doc_id, text_md5, n_equal + n_near AS n FROM ({OP10})").fetchall()
    got = {r["doc_id"]: r["m"] for r in lines.select("doc_id", F.md5("text").alias("m")).collect()}
    assert all(got.get(d, m) == m for d, m, _ in want) and all(d in got for d, _, n in want if n == 0)
    # stage 3: brute force over all pairs
    rows = [(r["doc_id"], _shingles(r["text"])) for r in lines.collect()]
    label = {d: d for d, _ in rows}
    for _ in range(5):
        for d, a in rows:
            for e, b in rows:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[d] = label[e] = min(label[d], label[e])
    assert {r["doc_id"] for r in near.collect()} == {d for d, x in label.items() if d == x}
    # stage 4: no window of ten words of the benchmark is left
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = {tuple(w[i : i + 10]) for w in map(split, bench) for i in range(len(w) - 9)}
    bad = {r["doc_id"] for r in near.collect() if any(tuple(w[i : i + 10]) in grams for w in [split(r["text"])] for i in range(len(w) - 9))}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - bad
    # stage 5: the texts come back whole
    pieces = {}
    for r in sorted(packed.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], "") + r["text"]
    assert pieces == {r["doc_id"]: r["text"] for r in clean.collect()}
    assert pipeline.run(spark, SF).count() == packed.count()
