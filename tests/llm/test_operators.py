"""The ten operators against brute force on small fixtures, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import fnmatch
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import types as T
from sparkcube.llm import decontamination, language_id, line_dedup, near_dedup, ngram_lm, packing, quality_rules, sharding, token_counts, url_filters

# clashing names: columns that operators make or use inside
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("score", "key", "shard", "label", "n_lines", "spans", "_id", "a")]
)
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box with great élan and naïve zeal under über skies".split()


def _random_text(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randrange(40)))
        out.append("\n" if i % 12 == 11 else " ")
    return "".join(out)


def _fixture():
    rng = random.Random(5)
    texts = [_random_text(rng, rng.randrange(1, 160)) for _ in range(24)]
    base = _random_text(rng, 120)
    near = base.split(" ")
    near[30] = "changed"
    line = base.split("\n")[2].split(" ")
    texts += [base, base, " ".join(near), base + " tail", "intro words here\n" + base.split("\n")[1] + "\n" + " ".join([*line[:4], "other", *line[5:]])]
    texts += [None, "", "   \n\t ", "12 34 -- !!", "x", "one two", "Long " * 3000 + _random_text(rng, 4000), "\n" * 50, "ÀÉÎ Äpfel STRASSE straße", "w" * 9000]
    rows = [(i, t, None if i == 3 else ("en", "de")[i % 2], None if i == 7 else f"s{min(i % 7, 2)}") for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s0"), (None, None, None, None), rows[0], rows[24], (5, "same id other text entirely", "de", "s1")]
    return [(*r, *["clash"] * 8) for r in rows]


ROWS = _fixture()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text, fold=True):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found] if fold else found


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_token_counts(spark, docs, empty):
    pieces = {"▁": -2.0, "▁th": -3.0, "th": -4.0, "e": -1.5, "t": -3.5, "h": -3.5, "qu": -2.5, "i": -2.0, "ck": -3.0, "▁▁": -3.0, "x": -1.0, "xx": -2.0}

    def brute(text):
        if not text:
            return 0
        s = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(s)
        for d in range(1, len(s) + 1):
            for size in range(min(2 + 1, d), 0, -1):
                if (p := s[d - size : d]) in pieces and best[d - size][0] + pieces[p] > best[d][0]:
                    best[d] = best[d - size][0] + pieces[p], best[d - size][1] + 1
            if s[d - 1] not in pieces and (x := best[d - 1][0] + min(pieces.values()) - token_counts.UNKNOWN_PENALTY) > best[d][0]:
                best[d] = x, best[d - 1][1] + len(s[d - 1].encode())
        return best[-1][1]

    counter = token_counts.Counter(pieces)
    texts = [r[1] for r in ROWS] + ["the quick", "  thth  e ", "xxxxx", "é☃"]
    assert counter.count(texts) == [brute(t) for t in texts]
    got = rows_of(token_counts.count_tokens(docs), "doc_id", "n_tokens")
    full = token_counts.Counter(token_counts.load_pieces())
    assert got == sorted(((r[0], full.count([r[1]])[0]) for r in ROWS), key=repr)
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_equal_the_library():
    spm = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    with open(token_counts.TOKENIZER, "rb") as f:
        model.ParseFromString(f.read())
    pieces = token_counts.load_pieces()
    for p in model.pieces:
        p.score = pieces.get(p.piece, p.score) if p.type in (1, 4) else p.score
    model.trainer_spec.model_type = 1
    library = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [r[1] or "" for r in ROWS] + ["  a  b ", "é漢字 ①x\n\ny"]
    got, want = token_counts.Counter(pieces).count(texts), [len(x) for x in library.encode(texts)]
    # the library adds in single precision: ties may fall otherwise once in many thousand tokens
    assert sum(abs(g - w) for g, w in zip(got, want)) <= 2


def test_quality_rules(docs, empty):
    found = quality_rules.judge(docs)
    want = []
    for doc_id, text, *_ in ROWS:
        w = words(text, fold=False)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), base))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(found, *names) == sorted(want, key=repr)
    assert all(not (r["kept"] and r["base_failed"]) and r["kept"] is not None for r in found.collect())
    assert quality_rules.judge(empty).count() == 0


def test_host_verdicts(spark):
    rows = [("bad", True)] * 95 + [("bad", False)] * 5 + [(f"h{i}", j == 0) for i in range(20) for j in range(20)] + [("tiny", True)]
    found = {r["source"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "source string, failed boolean")).collect()}
    assert not found["bad"]["host_kept"] and found["h3"]["host_kept"] and found["tiny"]["host_kept"] is (found["tiny"]["rate"] <= 0.5)
    assert found["tiny"]["rate"] < 1 and 0.9 < found["bad"]["rate"] < 0.95


def test_decontamination(spark, docs, empty):
    base = words(ROWS[24][1])
    items = [(1, " ".join(base[20:45])), (2, "one TWO"), (3, None), (4, "..."), (5, " ".join(base[40:60]).upper()), (10, " ".join(base[20:45])), (None, "x"), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    grams = defaultdict(set)
    for item, text in items:
        w = split(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k and item is not None else 0):
            grams[tuple(w[i : i + k])].add(str(item))
    want = []
    for doc_id, text, *_ in ROWS:
        w, hit, found = split(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if g := grams.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= g
        want.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    names = ("doc_id", "n_words", "n_hit", "items", "contaminated")
    got = decontamination.contamination(docs, bench)
    assert rows_of(got, *names) == sorted(want, key=repr)
    assert any(x[2] for x in want) and not all(x[2] for x in want)
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert rows_of(clean, "doc_id") == sorted([(w[0],) for w in want if not w[2]], key=repr)
    cut = decontamination.decontaminate(docs, bench, remove="span")
    assert sum(r["n_words"] for r in decontamination.contamination(cut, bench).collect()) == sum(w[1] - w[2] for w in want)
    assert {r["text"] for r in cut.collect()} >= {r[1] for r, w in zip(ROWS, want) if not w[2]}
    assert decontamination.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())
    old, decontamination.BROADCAST_BYTES = decontamination.BROADCAST_BYTES, -1  # the way by shuffle
    try:
        assert rows_of(decontamination.contamination(docs, bench), *names) == sorted(want, key=repr)
    finally:
        decontamination.BROADCAST_BYTES = old


def test_sharding(spark, docs, empty):
    rng = random.Random(1)
    many = [(i, "copy " * 50 if i % 3 == 0 else _random_text(rng, rng.randrange(1, 60))) for i in range(3000)]
    for df, n in ((spark.createDataFrame(many, "doc_id long, text string"), 16), (docs, 3)):
        got = sharding.assign_shards(df, n).collect()
        source = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source), key=repr)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r)
        assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
        if n == 16:
            sizes, mean = [sum(r["size"] for r in by[s]) for s in range(n)], sum(r["size"] for r in got) / n
            assert max(abs(s - mean) for s in sizes) < 0.06 * mean + max(r["size"] for r in got)
            # the assignment by its law: one sorted list, cut where middles lie
            rows = sorted(((hashlib.md5((t or "").encode()).hexdigest(), hashlib.md5(str("" if i is None else i).encode()).hexdigest(), len((t or "").encode()) + 1, i) for i, t in source), key=lambda r: r[:3])
            total, groups, own, expect, taken = sum(r[2] for r in rows), Counter(), 0, {}, Counter()
            for r in rows:
                groups[r[0]] += r[2]
            starts = {}
            for k, _, size, i in rows:
                starts.setdefault(k, own)
                middle = 2 * starts[k] + groups[k] if groups[k] * n <= sharding.WHOLE_GROUP * total else 2 * own + size
                shard = min(n - 1, middle * n // (2 * total))
                expect[i] = shard, taken[shard]
                taken[shard] += 1
                own += size
            assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == expect
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(docs, 3)
    docs = docs.drop("shard")
    path = sharding.write_shards(docs, 3)
    again = spark.read.parquet(path)
    assert rows_of(again, "doc_id", "text") == rows_of(docs, "doc_id", "text")
    assert sharding.assign_shards(empty, 4).count() == 0


def _naive_best_fit(sizes, sources, clusters, capacity, limit):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and c not in b["clusters"] and (s < 0 or b["sources"].count(s) < limit)]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "clusters": set(), "sources": []})
        bins[k]["room"] -= n
        bins[k]["clusters"].add(c)
        bins[k]["sources"].append(s)
        out.append(k)
    return out


def test_packing(docs, empty):
    rng = random.Random(3)
    items = sorted(((rng.randrange(1, 100), rng.choice([-1, 0, 0, 0, 1, 2, 3]), rng.randrange(60)) for _ in range(500)), reverse=True)
    assert packing.best_fit(*zip(*items), 100, 2) == _naive_best_fit(*zip(*items), 100, 2)
    got = packing.pack(docs, capacity=64, texts=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r["bin_id"]].append(r)
    for x in by.values():
        x.sort(key=lambda r: r["bin_slot"])
        assert sum(r["n_tokens"] for r in x) <= 64 and [r["bin_slot"] for r in x] == list(range(len(x)))
        assert [r["bin_offset"] for r in x] == [sum(y["n_tokens"] for y in x[:i]) for i in range(len(x))]
        ids = [r["doc_id"] for r in x if r["doc_id"] is not None and r["doc_id"] != 5]
        assert len(ids) == len(set(ids))
    assert Counter(x["doc_id"] for x in got if x["piece"] == 0) == Counter(r[0] for r in ROWS)
    assert sum(r["n_tokens"] for r in got) == sum(len(words(r[1])) + 1 for r in ROWS)
    for doc_id in (35, 8):
        whole = "".join(r["text"] for r in sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["piece"]))
        assert whole == (next(r[1] for r in ROWS if r[0] == doc_id) or "")
    assert packing.pack(empty).count() == 0
    # conflicts on the whole output: sources and clusters of equal words, or of a column
    source, text = {r[0]: r[3] for r in ROWS}, {r[0]: tuple(words(r[1])) for r in ROWS}
    for cluster, key in ((None, text), ("lang", {r[0]: r[2] or r[0] for r in ROWS})):
        bins = defaultdict(list)
        for r in packing.pack(docs.where("doc_id is not null and doc_id not in (0, 5, 24)"), 64, limit=2, cluster=cluster).collect():
            bins[r["bin_id"]].append(r["doc_id"])
        assert all(len({key[i] for i in x}) == len(x) for x in bins.values())
        assert all(n <= 2 for x in bins.values() for s, n in Counter(source[i] for i in x).items() if s is not None)
    narrow = packing.pieces(docs, 64).collect()
    hot, tokens = max(Counter(r["source"] for r in narrow if r["source"]).values()), sum(r["n_tokens"] for r in narrow)
    assert packing.source_limit(packing.pieces(docs, 64), 64) == math.ceil(hot / math.ceil(tokens / 64)) + 1


def test_ngram_model(docs, empty):
    texts = [(r[0], [*words(r[1]), "</s>"]) for r in ROWS]
    train = [t for i, t in texts if i is None or i % 3]
    uni, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t))
    contexts, by = Counter(w for _, w in pairs), defaultdict(lambda: [0, 0, 0, 0])
    for (h, _), c in pairs.items():
        by[h][0] += c
        by[h][min(c, 3)] += 1
    d2, d1 = ((0, *ngram_lm.discounts([sum(c == i for c in x.values()) for i in (1, 2, 3, 4)])) for x in (pairs, contexts))
    n, v, types = sum(uni.values()), len(uni), len(pairs)
    backoff = sum(d1[min(c, 3)] for c in contexts.values()) / types

    def p(h, w):
        low = max(contexts[w] - d1[min(contexts[w], 3)], 0) / types + backoff / (v + 1)
        if h not in by:
            return low
        c, z = pairs[h, w], by[h]
        return max(c - d2[min(c, 3)], 0) / z[0] + sum(d2[k] * z[k] for k in (1, 2, 3)) / z[0] * low

    model = ngram_lm.train(docs.where("doc_id is null or doc_id % 3 <> 0"))
    assert (model.tokens, model.words, model.types) == (n, v, types)
    assert abs(sum(p("<s>", w) for w in uni) + p("<s>", "never seen") - 1) < 1e-9
    got = sorted(ngram_lm.score(docs, model).collect(), key=lambda r: (repr(r["doc_id"]), r["score"]))
    want = sorted(
        (repr(i), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t)), sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), len(t), sum(uni[w] > 0 for w in t)) for i, t in texts
    )
    for r, w in zip(got, want, strict=True):
        assert (repr(r["doc_id"]), r["n_tokens"], r["n_known"]) == (w[0], *w[3:])
        assert r["score"] == pytest.approx(w[1]) and r["base_score"] == pytest.approx(w[2])
    nothing = ngram_lm.train(empty)
    assert nothing.tokens == 0 and all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in ngram_lm.score(docs, nothing).collect())
    assert ngram_lm.score(empty, model).count() == 0


def test_language_id(spark, docs, empty):
    path = "/root/testdata/sf0.001/documents.parquet"
    real = spark.read.parquet(path).withColumn("score", T_lit("clash"))
    model = language_id.train(real.where("doc_id % 3 <> 1"))
    held = language_id.predict(real, model).where("doc_id % 3 = 1 and lang is not null").collect()
    assert len(held) > 50 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    got = {(r["doc_id"], r["text"]): r for r in language_id.predict(docs, model).collect()}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1 for r in got.values())
    assert all(r["score"] == 0 for r in got.values() if r["lang_pred"] == "und")
    # one text by the formula
    codes = [c if c.isalpha() else " " for c in "The fox".lower()]
    total = model.prior.copy()
    part = pa.RecordBatch.from_pydict({"text": ["The fox"]})
    at = language_id._characters(part)
    for _, bucket in language_id._features(*at):
        for b in bucket:
            total += model.weights[b]
    assert sum(len(b) for _, b in language_id._features(*at)) == 3 * len(codes) - 3
    p = np.exp(total - total.max())
    assert np.allclose(language_id.scores(part, model)[0][0], p / p.sum())
    kept = language_id.keep_languages(docs, model)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"clash"}
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    # without labels nothing can be rejected but texts without letters
    assert rows_of(language_id.keep_languages(docs, nothing), "doc_id") == sorted([(r[0],) for r in ROWS if any(c.isalpha() for c in r[1] or "")], key=repr)
    # a floor rejects strings of random letters and keeps what was learned from
    floor = language_id.floors(real, model)
    rng = random.Random(6)
    noise = [(-1 - i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(40))) for i in range(5)]
    mixed = real.select("doc_id", "text").union(spark.createDataFrame(noise, "doc_id long, text string"))
    stay = {r["doc_id"] for r in language_id.keep_languages(mixed, model, floor=floor).collect()}
    assert not any(i < 0 for i in stay) and stay == {r["doc_id"] for r in language_id.keep_languages(mixed, model).collect() if r["doc_id"] >= 0}


def test_language_training_by_hand(spark):
    """Counts, smoothing and priors of a small table, n-gram by n-gram."""
    rows = [(1, "Ab, a", "x"), (2, "ba ab", "y"), (3, "b", "y"), (4, None, "x"), (5, "zz", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {"x": Counter(), "y": Counter()}
    for _, text, lang in rows:
        if text and lang:
            t = "".join(c if c.isalpha() else " " for c in text.lower())
            for k in language_id.ORDERS:
                counts[lang].update(t[i : i + k] for i in range(len(t) - k + 1))

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor % 2**64
        return (h ^ h >> 31) >> 64 - language_id.BITS

    assert model.languages == ("x", "y") and np.allclose(model.prior, np.log([1 / 3, 2 / 3]))
    for i, lang in enumerate(model.languages):
        own = np.zeros(1 << language_id.BITS)
        for gram, n in counts[lang].items():
            own[bucket(gram)] += n
        assert np.allclose(model.weights[:, i], np.log((own + language_id.SMOOTHING) / (own.sum() + language_id.SMOOTHING * len(own))))


def test_workers_need_no_package(tmp_path):
    """Executors that can't import the package run what travels to them: op7, op6, op9 and op10 on workers started elsewhere."""
    script = tmp_path / "job.py"
    script.write_text(
        f"""
import importlib.util, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
import pyspark.cloudpickle as cloudpickle
import sparkcube.llm.queries, sparkcube.llm as llm
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", "false").getOrCreate()
from sparkcube.llm import language_id, quality_rules
docs = spark.createDataFrame([(1, "ab ab", "x", "s"), (2, "cd cd", "y", "s")], "doc_id long, text string, lang string, source string")
seen = spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib").util.find_spec("sparkcube") is None).collect()
assert seen == [True], seen
print("PRED", sorted(r["lang_pred"] for r in language_id.predict(docs, language_id.train(docs)).collect()), quality_rules.judge(docs).count())
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "PRED ['x', 'y'] 2" in done.stdout, done.stdout + done.stderr[-3000:]


def T_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_url_automaton():
    rng = random.Random(4)
    globs = ["*", "", "a*", "*b", "a?c", "*a*b*", "?", "??*", "abc", "*" + "ab" * 40 + "*", "a**b"] + ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = ["", "a", "b", "abc", "aéc", "é", "ab" * 45, "a" * 200 + "b"] + ["".join(rng.choice("aab") for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = url_filters.Automaton(globs).match(np.frombuffer(b"".join(raw), np.uint8), at, len(globs))
    want = np.array([[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts])
    assert (got == want).all(), [(globs[j], texts[i]) for i, j in np.argwhere(got != want)[:5]]


def test_url_filters(spark):
    urls = [
        ("https://Example.ORG/es/1?x#y", "example.org", "/es/1", "example.org/es/", "block"),
        ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://cheap-pills.x.com/fr/1", "cheap-pills.x.com", "/fr/1", "com/fr/", "allow"),
        ("http://cheap-pills.x.com/en/1", "cheap-pills.x.com", "/en/1", None, "block"),
        ("http://org", "org", "", None, "allow"),
        ("no scheme/es/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://long.net/" + "p" * 20_000, "long.net", "/" + "p" * 20_000, None, "allow"),
    ]
    urls.append(urls[0])
    df = spark.createDataFrame([(None if i == 2 else i, u[0], "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = rows_of(url_filters.filter_urls(df), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((None if i == 2 else i, *u[1:]) for i, u in enumerate(urls)), key=repr)
    assert url_filters.filter_urls(df.limit(0)).count() == 0
    assert url_filters.canonical("HTTPS://u:p@WWW.X.com.:443/A?q#f") == "https://x.com/A?q"


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, k, percent):
    sets = []
    for i, t, *_ in ROWS:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = sorted(((i, len(s), None if i is None else root(i), True if i is None else root(i) == i) for i, s in sets), key=repr)
    assert rows_of(near_dedup.near_duplicates(docs, k, percent), "doc_id", "n_shingles", "component_id", "kept") == want
    assert any(not w[3] for w in want)
    kept = near_dedup.drop_near_duplicates(docs, k, percent)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == sorted([(w[0],) for w in want if w[3]], key=repr)
    assert near_dedup.near_duplicates(empty, k, percent).count() == 0


def test_near_duplicates_across_a_bucket(spark, monkeypatch):
    """Chains and groups whose first member isn't linked to the others, with blocks so small that buckets span several."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(8)
    texts = []
    for g in range(6):
        text = [f"g{g}w{i}" for i in range(200)]
        for step in range(12):
            texts.append(" ".join(text))
            at = rng.randrange(200)
            text[at] = f"new{g}s{step}"
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert rows_of(near_dedup.near_duplicates(df, 3, 85), "doc_id", "component_id") == sorted(enumerate(label), key=repr)


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for j in (0.0, 0.3, 0.6, 0.85, 1.0):
        n = int(2000 * j / (1 + j) * 2)
        a, b = x[:2000], np.concatenate([x[2000 - n : 2000], x[2000 : 4000 - n]])
        regs = near_dedup.registers(np.concatenate([a, b]), np.array([0, 2000, 2000 + len(b)]))
        got = near_dedup.estimate(*(np.array([v]) for v in ((regs[0] > regs[1]).sum(), (regs[0] < regs[1]).sum(), 2000.0, float(len(b)))))[0]
        assert abs(got - j) < 0.15
        union = near_dedup.registers(np.concatenate([a, b]), np.array([0, 2000 + len(b)]))
        assert (union[0] == regs.max(axis=0)).all()


def test_line_dedup(docs, empty):
    kinds, lines = {}, []
    order = sorted((r for r in ROWS), key=lambda r: (r[0] is None, r[0] or 0))
    for r in order:
        found = [(i, tuple(words(x, fold=False))) for i, x in enumerate((r[1] or "").split("\n"))] if r[1] is not None else []
        for i, w in found:
            if w and r[0] is not None:
                kinds.setdefault(w, (r[0], i))

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    least = line_dedup.MIN_WORDS
    near = {w for w, at in kinds.items() if len(w) >= least and any(other < at and len(x) >= least and close(w, x) for x, other in kinds.items())}
    want = []
    for r in ROWS:
        out, seen, counts = [], set(), [0, 0]
        for x in r[1].split("\n") if r[1] is not None else []:
            w = tuple(words(x, fold=False))
            if w:
                again = w in seen
                seen.add(w)
                if not again and r[0] is not None and w in near:
                    counts[1] += 1
                    continue
                if again or (r[0] is not None and kinds[w][0] < r[0]):
                    counts[0] += 1
                    continue
            out.append(x)
        want.append((r[0], None if r[1] is None else "\n".join(out), 0 if r[1] is None else r[1].count("\n") + 1, *counts))
        lines.append(out)
    got = line_dedup.dedup_lines(docs)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_equal", "n_near") == sorted(want, key=repr)
    assert near and any(w[3] for w in want) and any(w[4] for w in want)
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "text") == sorted([w[:2] for w in want if not (w[3] + w[4] and not words(w[1]))], key=repr)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_drops_what_only_repeats(spark):
    """A later copy goes with its short lines; a line of its own, or nothing removed, keeps a document."""
    long, short = " ".join(f"w{i}" for i in range(20)), "Licensed under the Apache License, Version 2.0."
    texts = [f"{long}\n{short}\n{short}", f"{short}\n{long}\n\n{short}", f"{long}\n{short}\nwords of its own", short, f"{long} more\n{short}", "\n \n", f"short line of\n{long}", "short line off"]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    counts = [(0, 1, 0), (1, 3, 0), (2, 2, 0), (3, 1, 0), (4, 1, 1), (5, 0, 0), (6, 1, 0), (7, 0, 0), (None, 1, 0)]
    assert rows_of(line_dedup.dedup_lines(df), "doc_id", "n_equal", "n_near") == sorted(counts, key=repr)
    want = [(0, f"{long}\n{short}"), (2, "words of its own"), (5, "\n \n"), (6, "short line of"), (7, "short line off"), (None, f"{long}\n{short}")]
    assert rows_of(line_dedup.drop_repeated_lines(df), "doc_id", "text") == sorted(want, key=repr)


def _thue_morse(n, a, b):
    x = [a]
    while len(x) < n:
        x += [b if y == a else a for y in x]
    return x


def test_thue_morse_words_are_told_apart(spark):
    """Words and lines on which every polynomial modulo 2**64 agrees: different shingles, different lines."""
    one, two = ("".join(_thue_morse(1024, *x)) for x in ("ab", "ba"))
    yes, no = (" ".join(_thue_morse(1024, *x)) for x in (("yes", "no"), ("no", "yes")))
    texts = [f"p q {one} r s", f"p q {two} r s", yes, no, f"{one}\n{two}", f"{'x ' * 9}{one}", f"{'x ' * 9}{two}"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    measured = {r["doc_id"]: r for r in quality_rules.measure(df).collect()}
    assert measured[4]["n_dup_lines"] == 0 and measured[4]["n_words"] == 2
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert found[1] == 1 and found[6] == 6
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert [lines[i]["text"] for i in (1, 3, 4)] == [texts[i] for i in (1, 3, 4)]
    assert (lines[6]["n_near"], lines[6]["n_equal"]) == (1, 0)


def test_one_line_with_thousands_of_variants(spark):
    """A hot variant: thousands of lines that differ in one word of the same place, and some in two; only the first one stays."""
    line = [f"w{i}" for i in range(12)]
    texts = ["\n".join(" ".join([*line[:4], f"n{i * 50 + j}", *line[5:]]) for j in range(50)) for i in range(60)]
    texts.append(" ".join([*line[:4], "other", "word", *line[6:]]))
    texts.append(" ".join(line[:4] + line[5:]))  # one word fewer: an edit from all of them
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_near"], r["text"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == (49, texts[0].split("\n")[0]) and all(got[i] == (50, "") for i in range(1, 60))
    assert got[60] == (0, texts[60]) and got[61] == (1, "")


def test_bands_miss_as_seldom_as_independent_ones():
    assert len(np.unique(near_dedup._CHOICE)) == near_dedup._CHOICE.size == near_dedup.BANDS * near_dedup.BAND_ROWS
    rng, missed, pairs = np.random.default_rng(2), 0, 300_000
    p = 1 - 2 * float(near_dedup._p(np.array(0.5 - 0.5 * 0.8)))  # two sets of equal size and similarity 0.8 agree in a register
    for _ in range(pairs // 20_000):
        a = rng.integers(0, 128, (20_000, near_dedup.REGISTERS), dtype=np.uint8)
        b = np.where(rng.random(a.shape) < p, a, a + np.uint8(128))
        missed += int((near_dedup.band_keys(a) != near_dedup.band_keys(b)).all(axis=1).sum())
    assert missed < 10 * pairs * (1 - p**near_dedup.BAND_ROWS) ** near_dedup.BANDS


def test_decontamination_by_shuffle_moves_less_than_the_texts(spark, monkeypatch, tmp_path):
    """A table of windows that is too large to broadcast: hashes are shuffled, and fewer bytes than the texts have."""
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1000)) for _ in range(400)]
    bench = spark.createDataFrame([(1, " ".join(texts[3].split()[100:130])), (2, " ".join(texts[8].split()[:10])), (3, "nothing of this kind is anywhere to be found in it")], "item_id long, text string")
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(path)
    before = _shuffled(spark)
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(spark.read.parquet(path), bench).collect() if r["contaminated"]}
    assert got == {3: (30, ["1"]), 8: (10, ["2"])}
    written = _shuffled(spark) - before
    assert 0 < written < sum(map(len, texts)), written


def _shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_a_thousand_globs_from_a_file(spark, tmp_path):
    rng = random.Random(12)
    globs = [f"*://{rng.choice(['*', 'a*', 'www?'])}{rng.choice('abcdef')}{rng.randrange(40)}*/{rng.choice(['*', 'x*y', 'p?/*'])}" for _ in range(1000)]
    (tmp_path / "rules.txt").write_text("# rules\n\n" + "\n".join(globs) + "\n")
    assert url_filters.load_globs(spark, str(tmp_path / "rules.txt")) == globs
    urls = [f"http://{rng.choice(['', 'a', 'www1', 'zz'])}{rng.choice('abcdefg')}{rng.randrange(40)}.net/{rng.choice(['', 'x1y', 'p1/q', 'xy'])}" for _ in range(300)]
    raw = [u.encode() for u in urls]
    got = url_filters.Automaton(globs).match(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), len(globs))
    assert (got == np.array([[fnmatch.fnmatchcase(u, g) for g in globs] for u in urls])).all() and got.any()


def test_a_bucket_of_twenty_thousand(spark):
    """All pairs of one level are compared in blocks: two planted pairs are found among 20,000 members of unlike registers."""
    rng = np.random.default_rng(4)
    regs = rng.integers(0, 255, (20_000, near_dedup.REGISTERS), dtype=np.uint8)
    regs[19_999], regs[7_777] = regs[3], regs[12_345]
    rows = spark.createDataFrame(pa.table({"key": pa.array(np.ones(20_000, np.int64)), "doc_id": pa.array(np.arange(20_000)), "label": pa.array(np.arange(20_000)), "n_shingles": pa.array(np.full(20_000, 100)), "regs": pa.array([r.tobytes() for r in regs])}))
    cells = near_dedup._cells(rows, 80)
    assert cells.count() < 20_000 * 13
    assert rows_of(near_dedup._across(cells, 80), "a", "b") == [(3, 19_999), (7_777, 12_345)]


def test_a_family_of_unlinked_documents(spark, monkeypatch):
    """Three hundred variants of one text, too far from each other for a link, and a chain of three among them: what buckets hold across
    components is told by sets that come once to each cell, a pair in one cell only, and texts are brought together for links alone."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for d in range(300):
        text = list(base)
        for at in rng.sample(range(300), 8):
            text[at] = f"d{d}n{at}"
        texts.append(text)
    for step in (1, 2):
        text = list(texts[150 if step == 1 else -1])
        for at in rng.sample(range(300), 6):
            text[at] = f"s{step}n{at}"
        texts.append(text)
    pairs, met = [], []
    verified, sieved = near_dedup._verified, near_dedup._sieved
    monkeypatch.setattr(near_dedup, "_verified", lambda p, *rest: pairs.append(p.count()) or verified(p, *rest))
    monkeypatch.setattr(near_dedup, "_sieved", lambda m, *rest: met.append(m) or sieved(m, *rest))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in texts]
    label = list(range(len(texts)))
    for _ in range(3):
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert 1 <= sum(i != x for i, x in enumerate(label)) <= 4
    assert rows_of(near_dedup.near_duplicates(df, 3, 85), "doc_id", "component_id") == sorted(enumerate(label), key=repr)
    compared = [tuple(sorted((r["doc_id"], o))) for r in met[0].collect() for o in r["others"]]
    assert len(compared) == len(set(compared)) > 5_000
    assert pairs[1] <= 4


def test_sieve_of_documents_with_several_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, "quite other words stand here"), (2, text + " more"), (3, text.replace("w20 ", "x ").replace("w40 ", "y ")), (4, text), (4, text), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = spark.createDataFrame([(7, 1, [2, 3]), (7, 2, []), (7, 3, []), (-9, 4, [2]), (-9, 2, [3]), (-9, 2, []), (-9, 3, [])], "cell long, doc_id long, others array<long>")
    assert rows_of(near_dedup._sieved(met, docs, 3, 85), "a", "b") == [(1, 2), (2, 4)]


def test_language_model_and_floors_come_from_all_rows(spark):
    """Six thousand texts of one language: n-gram counts and floors are those of every text."""
    rng = random.Random(31)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(60)) for _ in range(6_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4).cache()
    model = language_id.train(df)
    part = pa.RecordBatch.from_pydict({"text": texts})
    own = sum(np.bincount(b, minlength=1 << language_id.BITS) for _, b in language_id._features(*language_id._characters(part)))
    assert np.allclose(model.weights[:, 0], np.log((own + language_id.SMOOTHING) / (own.sum() + language_id.SMOOTHING * len(own))), rtol=1e-12, atol=0)
    fit = np.array([r["fit"] for r in language_id.predict(df, model).collect() if len(r["text"]) >= language_id.FLOOR_CHARS])
    want = fit.mean() - language_id.FLOOR_DEVIATIONS * fit.std(ddof=1)
    assert len(fit) > 5_500 and math.isclose(language_id.floors(df, model)["x"], want, rel_tol=1e-9)
    noise = spark.createDataFrame([(-1, "zqzqvw " * 60, None), (-2, "zq", None), (-3, None, None)], df.schema)
    both = df.union(noise)
    floor = language_id.floors(both, model)
    native = rows_of(language_id.keep_native(both, model), "doc_id", "lang")
    assert native == rows_of(language_id.keep_languages(both, model, floor=floor), "doc_id", "lang") and len(native) > 5_000
