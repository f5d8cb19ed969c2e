"""Quality rules with host-level verdicts.

Each document is measured once; rule failures are counted per host (the column `source`), the rates are shrunk towards all hosts'
rate by a beta prior fitted to the hosts, and the verdict of its host goes back to each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcube.llm._shared import small_batches, written
from sparkcube.llm._text import LINE, SPACED, buffers, hash_spans, hashed, mix, owners, per_text, released, slices, spans, windows

#: A host is rejected when its shrunk rate of failing documents exceeds this.
MAX_HOST_RATE = 0.5
#: A document is rejected when it breaks one of these rules: symbols per word, more than one repeated line in so many, bounds of the mean word length.
MAX_SYMBOLS, DUP_LINES_IN, WORD_CHARS = 0.1, 3, (2.0, 15.0)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False  # continuation bytes of UTF-8

FEATURES = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _repeated(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each item, whether its hash occurs more than once in its own text."""
    own = mix(h ^ mix(owners(at).astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _later(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each item, whether an equal one stands before it in its own text."""
    own = mix(h ^ mix(owners(at).astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    later = np.zeros(len(h), bool)
    later[order[1:][own[order][1:] == own[order][:-1]]] = True
    return later


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        for part in slices(batch, "text"):
            data, at = buffers(part.column("text"))
            h, starts, ends, to = hashed(data, at, SPACED)
            lead = np.concatenate([[0], np.cumsum(_LEAD[data], dtype=np.int64)])
            w, first, wat = windows(h, to, 3, whole=False)
            hit = first[_repeated(w, wat)]
            covered = np.zeros(len(h), bool)
            for i in range(3):
                covered[hit + i] = True
            ls, le = spans(data, at, LINE)
            words_before = np.searchsorted(starts, ls), np.searchsorted(starts, le)
            wordy = words_before[1] > words_before[0]
            ls, le = ls[wordy], le[wordy]
            lat = np.searchsorted(ls, at)
            dup = _later(hash_spans(data, ls, le), lat) if len(ls) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("source"),
                    *(pa.array(x.astype(np.int64)) for x in (np.diff(to), per_text(lead[ends] - lead[starts], to), per_text(_SYMBOL[data], at), np.diff(lat), per_text(dup, lat), per_text(covered, to))),
                ],
                names=["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
            )


def measure(docs: DataFrame) -> DataFrame:
    """The features of every text, in one pass without a shuffle. A null text has no words, symbols or lines."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return found.mapInArrow(_measure, FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule broken; a text without words fails."""
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return base_failed() | (F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")) | (DUP_LINES_IN * F.col("n_dup_lines") > F.col("n_lines")) | ~mean.between(*WORD_CHARS)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(source, n, failures, rate, host_kept): failures are summed before the shuffle, so a hot host costs a row per task.

    The beta prior's mean m is the rate over all documents and its weight comes from the spread of the hosts' rates (moments): with
    V the variance of rates weighted by size and E the binomial part of it, weight = m(1-m)/(V-E) - 1, within 1 to 10,000.
    """
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    both = hosts.agg(F.sum("n").alias("docs"), F.sum("failures").alias("fails"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("sq")).first()
    docs = max(1, both["docs"] or 0)
    m = (both["fails"] or 0) / docs
    spread, noise = (both["sq"] or 0.0) / docs - m * m, m * (1 - m) * both["hosts"] / docs
    weight = min(max(m * (1 - m) / (spread - noise) - 1, 1.0), 10_000.0) if spread > noise else 10_000.0
    rate = (F.col("failures") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("source", "n", "failures", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE, salts: int = 16) -> DataFrame:
    """One row per input row: its features, base_failed, rule_failed, host_rate, host_kept and kept.

    kept: no rule broken and the host kept. Null sources are one host; null or empty texts fail; repeated rows count each; an empty
    table gives no rows; other columns are ignored. Verdicts are joined back by host and salt, so a hot host is spread over tasks.
    """
    rows = written(measure(docs), "quality-features").withColumns({"base_failed": base_failed(), "failed": rule_failed()})
    hosts = host_verdicts(rows, max_rate).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hosts = hosts.select(F.col("source").alias("_host"), F.col("_salt"), F.col("rate").alias("host_rate"), "host_kept")
    left = rows.withColumn("_s", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    joined = left.join(hosts, left["source"].eqNullSafe(hosts["_host"]) & (F.col("_s") == F.col("_salt")), "left")
    return joined.withColumn("kept", ~F.col("failed") & F.col("host_kept")).withColumnRenamed("failed", "rule_failed").drop("_s", "_salt", "_host")
