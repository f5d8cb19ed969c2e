"""Benchmark decontamination, in DataFrame operations only.

The benchmark's word windows form a hash table that is broadcast when its measured size allows it: then one pass over the texts
probes every window of every length by hash and confirms hits on the words. A larger table is joined by shuffle, in two steps that
keep the texts where they are: documents that share no minimizer (the least hash of the GRAM-word runs in a window) with the
benchmark hold none of its windows, so only the others' windows are shuffled, as hashes, and their hits confirmed on the words.
Then documents or the hit spans are removed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcube.llm._shared import small, written

WINDOW = 10
#: The table of benchmark windows is broadcast up to this many bytes of window text; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Words of the runs whose least hash stands for a window in the first step of the way by shuffle.
GRAM = 5
#: Stands for a document among the hashes of its windows.
SELF = -0x5A17_C0DE_5A17_C0DE
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: A-Z folded, then maximal runs of digits, a-z and anything beyond ASCII. Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() would fold letters beyond ASCII as well; for texts without any the two agree and lower() is faster
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(folded, _GAP), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k, gram, hash, items): each distinct window of k words with the item_ids that hold it. Items without id or words have none."""
    w = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("k", F.least(F.size("w"), F.lit(window)))
    w = w.select("item_id", "k", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    w = w.select(F.col("item_id").cast("string").alias("item_id"), "k", F.slice("w", F.col("i"), F.col("k")).alias("s"))
    w = w.select("item_id", "k", F.array_join("s", " ").alias("gram"), F.xxhash64("k", F.transform("s", lambda x: F.xxhash64(x))).alias("hash"))
    return w.groupBy("k", "gram", "hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents by what decides their result: id and text. Repeated rows share a key and a result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"), words(F.col("text")).alias("_w"))


def _hashes(words_: Column) -> Column:
    return F.transform(words_, lambda x: F.xxhash64(x))


def _windows(hashes: Column, lengths: list[int]) -> Column:
    """(hashes: a column, not an expression) The hashes of all windows of the first length, then of the next one, and so on."""
    parts = []
    for k in lengths:
        at = F.when(F.size(hashes) >= k, F.sequence(F.lit(1), F.size(hashes) - (k - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, lambda i: F.xxhash64(F.lit(k), F.slice(hashes, i, k))))  # noqa: B023
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _place(n: Column, size: Column, lengths: list[int]) -> tuple[Column, Column]:
    """First word (from 0) and length of window number n of _windows()."""
    p, k, before = n, F.lit(lengths[-1]), F.lit(0)
    ends = []
    for length in lengths[:-1]:
        end = before + F.greatest(size - (length - 1), F.lit(0))
        ends.append((length, before, end))
        before = end
    p = n - before
    for length, start, end in reversed(ends):
        p, k = F.when(n < end, n - start).otherwise(p), F.when(n < end, F.lit(length)).otherwise(k)
    return p, k


def _minimizers(hashes: Column, lengths: list[int]) -> Column:
    """The distinct minimizers of all windows: of each, the least hash of its runs of GRAM words (of all its words, if it has fewer)."""
    parts = []
    for k in lengths:
        m = min(GRAM, k)
        runs = F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(1), F.size(hashes) - (m - 1)), lambda i: F.xxhash64(F.lit(m), F.slice(hashes, i, m))))  # noqa: B023
        # bound to r, as an expression inside a lambda is computed for each element
        least = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - (k - m)), lambda i: F.array_min(F.slice(r, i, k - m + 1)))  # noqa: B023,E731
        parts.append(F.coalesce(runs if k == m else F.transform(F.array(runs), lambda r: F.when(r.isNotNull(), least(r)))[0], F.array().cast("array<bigint>")))
    return F.array_distinct(F.concat(*parts))


def _probed(keyed: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """(_id, _a, _b, n_words, rows, spans, items) of every document (a key with its number of rows), in one pass: windows are probed where the
    text is, and of those without a hit only a document's first one goes on."""
    # the document itself comes first, and its constant in the table as well: so an inner join keeps it, and the windows that are hit
    hashes = F.concat(F.array(F.lit(SELF)), _windows(F.col("_x"), lengths))
    # a column of its own, as a generator that holds lambdas is left out of generated code, and its rows with all their words are copied;
    # and outer, as else Spark filters on the array's size and computes all hashes once more for that
    probe = keyed.select("_id", "_a", "_b", "_w", hashes.alias("_s")).select("_id", "_a", "_b", "_w", F.posexplode_outer("_s").alias("_n", "_h"))
    itself = table.sparkSession.range(1).select(F.lit(0).alias("_k"), F.lit(SELF).alias("hash"), F.lit(None).cast("string").alias("gram"), F.array().cast("array<string>").alias("items"))
    joined = probe.join(F.broadcast(table.unionByName(itself)), F.col("_h") == F.col("hash"))
    p, k = _place(F.col("_n") - 1, F.size("_w"), lengths)
    # an equality would become a join key, and every window's words would be joined to a string
    hit = (F.col("_n") > 0) & (k == F.col("_k")) & F.array_contains(F.array("gram"), F.array_join(F.slice("_w", p + 1, k), " "))
    first = (F.col("_n") == 0) & F.col("gram").isNull()
    found = joined.where(first | hit).select("_id", "_a", "_b", F.when(first, F.size("_w")).alias("n"), F.when(~first, F.struct(p.alias("p"), F.col("_k").alias("k"))).alias("span"), F.when(~first, F.col("items")).alias("items"))
    return found.groupBy("_id", "_a", "_b").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count("n").alias("rows"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _shuffled(keyed: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(_id, _a, _b, spans, items) of the documents with hits, by shuffle of hashes."""
    own = grams.select(_hashes(F.split("gram", " ")).alias("_x")).select(F.explode(_minimizers(F.col("_x"), lengths)).alias("m")).distinct()
    sieve = keyed.select("_id", "_a", "_b", _minimizers(F.col("_x"), lengths).alias("_s"))
    sieve = sieve.select("_id", "_a", "_b", F.explode_outer("_s").alias("m")).join(own, "m", "left_semi")
    passed = written(sieve.select("_id", "_a", "_b").distinct(), "minimizer-hits").select(F.col("_id").alias("_i"), F.col("_a").alias("_c"), F.col("_b").alias("_d"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d"))
    some = written(keyed.join(small(passed), same, "left_semi").select("_id", "_a", "_b", "_w", "_x").distinct(), "minimizer-texts")
    probe = some.select("_id", "_a", "_b", _windows(F.col("_x"), lengths).alias("_s"), F.size("_w").alias("_size"))
    probe = probe.select("_id", "_a", "_b", "_size", F.posexplode_outer("_s").alias("_n", "h"))
    p, k = _place(F.col("_n"), F.col("_size"), lengths)
    hits = probe.join(grams.withColumnRenamed("k", "_k"), F.col("h") == F.col("hash")).where(k == F.col("_k"))
    hits = written(hits.select("_id", "_a", "_b", p.alias("p"), F.col("_k").alias("k"), "gram", "items"), "window-hits")
    texts = some.select(F.col("_id").alias("_i"), F.col("_a").alias("_c"), F.col("_b").alias("_d"), "_w")
    sure = hits.join(texts, same).where(F.array_contains(F.array("gram"), F.array_join(F.slice("_w", F.col("p") + 1, F.col("k")), " ")))
    return sure.groupBy("_id", "_a", "_b").agg(
        F.sort_array(F.collect_set(F.struct("p", "k"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def _prepared(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, list[int], bool]:
    """The keyed documents, the benchmark's windows, their lengths, and whether their table may be broadcast."""
    grams = written(benchmark_windows(benchmark, window), "benchmark-windows")
    sizes = grams.groupBy("k").agg(F.sum(F.octet_length("gram") + 64 + 24 * F.size("items")).alias("bytes")).collect()  # at most `window` rows
    fits = sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    return _keyed(docs).withColumn("_x", _hashes(F.col("_w"))), grams, sorted(r["k"] for r in sizes), fits


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _a, _b, spans, items): for each document with hits, its hit windows as (first word from 0, words) and its items."""
    keyed, grams, lengths, fits = _prepared(docs, benchmark, window)
    if not lengths:
        return keyed.select("_id", "_a", "_b", F.array().cast("array<struct<p:int,k:int>>").alias("spans"), F.array().cast("array<string>").alias("items")).where(F.lit(False))
    if fits:
        return _probed(keyed, grams.withColumnRenamed("k", "_k"), lengths).where(F.size("spans") > 0).select("_id", "_a", "_b", "spans", "items")
    return _shuffled(keyed, grams, lengths)


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["p"] + s["k"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["p"] + s["k"] - F.greatest(acc["end"], s["p"]))).cast("long").alias("n")
    )
    return F.coalesce(F.aggregate(spans, start, step, lambda acc: acc["n"]), F.lit(0)).cast("long")


def _with_hits(left: DataFrame, hits: DataFrame) -> DataFrame:
    h = hits.select(F.col("_id").alias("_hid"), F.col("_a").alias("_ha"), F.col("_b").alias("_hb"), "spans", "items")
    return left.join(h, left["_id"].eqNullSafe(F.col("_hid")) & (left["_a"] == F.col("_ha")) & (left["_b"] == F.col("_hb")), "left").drop("_hid", "_ha", "_hb")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items (sorted as strings), spans, contaminated.

    A null, empty or wordless text has no words and is clean; null doc_ids keep their rows; repeated rows get equal results;
    an item of fewer than `window` words is one window; an empty benchmark leaves all documents clean; other columns are ignored.
    """
    keyed, grams, lengths, fits = _prepared(docs, benchmark, window)
    none = F.array().cast("array<struct<p:int,k:int>>"), F.array().cast("array<string>")
    if not lengths:
        found = keyed.select("_id", F.size("_w").cast("long").alias("n_words"), none[0].alias("spans"), none[1].alias("items"))
    elif fits:  # repeated rows were counted, and come back as often
        found = _probed(keyed, grams.withColumnRenamed("k", "_k"), lengths)
        found = found.select("_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")
    else:
        base = keyed.select("_id", "_a", "_b", F.size("_w").cast("long").alias("n_words"))
        found = _with_hits(base, _shuffled(keyed, grams, lengths)).withColumns({"spans": F.coalesce("spans", none[0]), "items": F.coalesce("items", none[1])})
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "document") -> DataFrame:
    """The documents without contaminated ones (remove="document"), or with the hit words cut out of their texts (remove="span").

    Cutting a word takes what stands between it and the word before along. Columns and other rows stay as they are.
    """
    if remove not in ("document", "span"):
        raise ValueError("remove: document or span")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = find_hits(docs, benchmark, window)
    # the rows travel as structs, so that none of their columns clashes with those made here
    left = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"))
    if remove == "document":
        hits = written(hits.select(F.col("_id").alias("_hid"), F.col("_a").alias("_ha"), F.col("_b").alias("_hb")), "contaminated")
        cond = left["_id"].eqNullSafe(F.col("_hid")) & (left["_a"] == F.col("_ha")) & (left["_b"] == F.col("_hb"))
        return left.join(small(hits), cond, "left_anti").select("_row.*")
    text = F.col("_row.text")
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    kept = F.filter(pieces, lambda x, i: ~F.exists("spans", lambda s: (s["p"] <= i) & (i < s["p"] + s["k"])))
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))
    return _with_hits(left, hits).select(F.col("_row").withField("text", cut).alias("_row")).select("_row.*")
