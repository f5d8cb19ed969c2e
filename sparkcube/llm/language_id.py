"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcube.llm._shared import small_batches, written
from sparkcube.llm._text import mix, released, slices

ORDERS, BITS, SMOOTHING = (1, 2, 3), 16, 0.5
#: What a filter takes for a language at least.
MIN_SCORE = 0.5
#: Texts of fewer characters have too few n-grams for their mean to tell anything.
FLOOR_CHARS = 200
#: A text is foreign to its language when its mean log probability per n-gram lies so many standard deviations below the training texts'.
FLOOR_DEVIATIONS = 16.0
UNKNOWN = "und"
_PIECE = 1 << 17  # characters whose features are held at once


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: log priors, and log probabilities (buckets, languages)
    prior: np.ndarray
    weights: np.ndarray


def _characters(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters as code points, and each text's first."""
    texts = [t.lower() if t else "" for t in part.column("text").to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _letters(codes: np.ndarray) -> np.ndarray:
    """Whether each character is a letter; other characters count as spaces between words."""
    seen = np.unique(codes) if len(codes) < 1 << 12 else np.flatnonzero(np.bincount(codes))
    table = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, bool)
    table[seen] = [chr(int(c)).isalpha() for c in seen]
    return table[codes]


def _features(codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first characters, buckets) of the n-grams, order by order, piece by piece; an n-gram lies in one text."""
    if not len(codes):
        return
    folded = np.where(_letters(codes), codes, 32).astype(np.uint64)
    end = np.repeat(at[1:], np.diff(at))
    for lo in range(0, len(codes), _PIECE):
        for k in ORDERS:
            i = np.arange(lo, min(lo + _PIECE, len(codes)))
            i = i[i + k <= end[i]]
            h = np.full(len(i), k, np.uint64)
            for j in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + folded[i + j]
            yield i, (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def train(docs: DataFrame) -> Model:
    """Learns from text and lang of the rows that have both: the languages' shares and n-gram counts come from all of them."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros(0), np.zeros((1 << BITS, 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        place = {name: i for i, name in enumerate(languages)}
        for batch in released(batches):
            for part in slices(batch, "text", 1 << 20):
                codes, at = _characters(part)
                own = np.repeat(np.array([place[x] for x in part.column("lang").to_pylist()], np.int64), np.diff(at))
                for i, bucket in _features(codes, at):
                    total += np.bincount(own[i] << BITS | bucket, minlength=total.size).reshape(total.shape)
        for row in np.flatnonzero(total.any(axis=1)):
            where = np.flatnonzero(total[row])
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([where.astype(np.int32).tobytes()]), pa.array([total[row, where].tobytes()])], names=["row", "buckets", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, b, c in zip(*(batch.column(x).to_pylist() for x in ("row", "buckets", "counts"))):
                total.setdefault(r, np.zeros(1 << BITS, np.int64))[np.frombuffer(b, np.int32)] += np.frombuffer(c, np.int64)
        for r, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([c.tobytes()])], names=["row", "counts"])

    partial = rows.select("text", "lang").mapInArrow(count, "row long, buckets binary, counts binary")
    counts = np.zeros((1 << BITS, len(languages)))
    for r in partial.repartition("row").mapInArrow(add, "row long, counts binary").collect():  # one row a language
        counts[:, r["row"]] = np.frombuffer(r["counts"], np.int64)
    weights = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * (1 << BITS))
    n = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(n / n.sum()), weights)


def _floors(found: DataFrame) -> dict[str, float]:
    found = found.where((F.char_length("text") >= FLOOR_CHARS) & (F.col("lang_pred") != UNKNOWN))
    rows = found.groupBy("lang_pred").agg(F.avg("fit").alias("m"), F.stddev("fit").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # one row a language
    return {r["lang_pred"]: r["m"] - FLOOR_DEVIATIONS * r["s"] for r in rows if r["n"] > 1}


def floors(docs: DataFrame, model: Model) -> dict[str, float]:
    """For each language the mean log probability per n-gram below which a text is foreign to it: FLOOR_DEVIATIONS below the mean of
    all texts of at least FLOOR_CHARS characters that are predicted as it. A language of one such text has no floor."""
    return _floors(predict(docs.select("text"), model))


def scores(part: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, languages) posterior probabilities, whether each text has a letter, and the best language's mean log probability per n-gram."""
    codes, at = _characters(part)
    n = len(at) - 1
    total, grams = np.tile(model.prior, (n, 1)), np.zeros(n)
    for i, bucket in _features(codes, at):
        own = np.searchsorted(at, i, side="right") - 1
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
        if len(first):
            total[own[first]] += np.add.reduceat(model.weights[bucket], first, axis=0)
            grams += np.bincount(own, minlength=n)
    letters = np.concatenate([np.zeros(1, np.int64), np.cumsum(_letters(codes))]) if len(codes) else np.zeros(1, np.int64)
    has_letter = letters[at[1:]] > letters[at[:-1]]
    if not model.languages:
        return total, has_letter, np.zeros(n)
    best = total.argmax(axis=1)
    fit = (total.max(axis=1) - model.prior[best]) / np.maximum(grams, 1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), has_letter, fit


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred, score (the posterior of lang_pred) and fit (its mean log probability per n-gram), in one pass
    without a shuffle.

    A null text, one without a letter, and any text if the model has no language get `und`, score 0 and fit 0. Equal scores go to the
    language that sorts first. Repeated rows get equal results; an empty table gives no rows; existing columns of the names added are
    replaced; nothing but the text decides.
    """
    small_batches(docs.sparkSession)
    # 2**BITS numbers a language, as plain arrays: workers needn't have this package to read them
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.weights))
    added = ("lang_pred", "score", "fit")
    kept = docs.drop(*added).withColumn("text", F.col("text").cast("string"))
    names = kept.columns
    text_at = next(i for i, c in enumerate(names) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in released(batches):
            for part in slices(batch, names[text_at], 1 << 20):
                p, letters, fit = scores(pa.RecordBatch.from_arrays([part.column(text_at)], names=["text"]), known)
                if known.languages:
                    best = p.argmax(axis=1)
                    name, top = [known.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, p.max(axis=1), 0.0)
                else:
                    name, top = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(name, pa.string()), pa.array(top), pa.array(np.where(letters, fit, 0.0))], names=[*names, *added])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.DoubleType(), T.DoubleType())))]))


_ADDED = ("lang_pred", "score", "fit")


def _judged(docs: DataFrame, model: Model) -> DataFrame:
    """predict(), where columns of docs of the names added go on as _own_..."""
    return predict(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in _ADDED}), model)


def _kept(found: DataFrame, columns: list[str], model: Model, min_score: float, floor: dict[str, float] | None) -> DataFrame:
    if model.languages:
        ok = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
        if floor:
            least = F.create_map(*[F.lit(x) for kv in sorted(floor.items()) for x in kv])[F.col("lang_pred")]
            ok &= (F.char_length("text") < FLOOR_CHARS) | least.isNull() | (F.col("fit") >= least)
    else:
        ok = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.where(ok).select(*[F.col(f"_own_{c}").alias(c) if c in _ADDED else F.col(c) for c in columns])


def keep_languages(docs: DataFrame, model: Model, min_score: float = MIN_SCORE, floor: dict[str, float] | None = None) -> DataFrame:
    """The documents with a language: those of `und`, those below min_score and, where floor (see floors()) is given, texts of at least
    FLOOR_CHARS characters that lie below their language's floor go. A model without languages can't tell: then all texts with a letter stay.
    """
    return _kept(_judged(docs, model), docs.columns, model, min_score, floor)


def keep_native(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """keep_languages() with the floors() of docs themselves; each text is predicted once, into a table that both read."""
    found = written(_judged(docs, model), "languages")
    return _kept(found, docs.columns, model, min_score, _floors(found))
