"""An interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays, memory-mapped for scoring.

Words are counted by 64-bit hash; the sorted hashes, split by their leading bits into shards, are the vocabulary, and a word's id is
its place in it. Bigrams are sorted arrays of (context id, word id). Map tasks count in numpy and send one compressed block of
sorted keys and counts per shard, so that the shuffle carries a few bytes per distinct bigram and task; each shard is merged by
one task, which writes its arrays to the shared folder (whole or not at all, so that a task can run again). Nothing is pruned.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcube.llm._hashfiles import load, save
from sparkcube.llm._shared import posix_dir, small_batches
from sparkcube.llm._text import SPACED, buffers, hashed, mix, owners, per_text, released, slices

#: The end of a text, counted and predicted like a word.
END = np.uint64(0x5BD1E9955BD1E995)
#: Distinct keys that a task counts before it sends them on.
HELD = 2_000_000
#: Bytes of text for each shard of the model, up to 2**MOST_BITS shards (1 TB); beyond, shards grow, as a task's blocks would get too small.
SHARD_BYTES, MOST_BITS = 16 << 20, 16
_BLOCK = "shard long, keys binary, counts binary"


def _fold(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _pack(a: np.ndarray) -> bytes:
    """Bytes of equal rank side by side: the leading ones of sorted keys hardly differ."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


def _add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first) if len(first) else c


class _Counter:
    """Sums counts by key and gives blocks per shard once HELD keys have come together."""

    def __init__(self, shard_of):
        self.shard_of, self.keys, self.counts, self.n = shard_of, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        if self.n > HELD:
            k, c = _add_up(self.keys, self.counts)
            self.keys, self.counts, self.n = [k], [c], len(k)
            if self.n > HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        k, c = _add_up(self.keys, self.counts)
        self.keys, self.counts, self.n = [], [], 0
        shard = self.shard_of(k)
        cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(k)]]) if len(k) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[lo])], pa.int64()), pa.array([_pack_keys(k[lo:hi])]), pa.array([_pack(c[lo:hi].astype(np.int64))])], names=["shard", "keys", "counts"])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _add_up([_unpack_keys(x) for x in table.column("keys").to_pylist()], [_unpack(x, np.int64) for x in table.column("counts").to_pylist()])


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and each text's first token."""
    h, _, _, to = hashed(*buffers(part.column("text")), SPACED, fold=True)
    out = np.full(len(h) + part.num_rows, END, np.uint64)
    out[np.arange(len(h)) + owners(to)] = h
    return out, to + np.arange(len(to))


class _Shards:
    """Columns of the model by id or by key, mapped shard by shard."""

    def __init__(self, folder: str, bases: np.ndarray, bits: int):
        self.folder, self.bases, self.bits, self.open = folder, bases, bits, {}

    def part(self, name: str, shard: int) -> np.ndarray:
        if (name, shard) not in self.open:
            path = f"{self.folder}/{name}-{shard}.npy"
            self.open[name, shard] = load(path) if os.path.exists(path) else None
        return self.open[name, shard]

    def _runs(self, shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield int(shard[lo]), int(lo), int(hi)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes; -1 for those that aren't words of the training texts."""
        out = np.full(len(hashes), -1, np.int64)
        shard = hashes >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(hashes), np.uint64)
        for s, lo, hi in self._runs(shard):
            have = self.part("word", s)
            if have is not None and len(have):
                at = np.minimum(np.searchsorted(have, hashes[lo:hi]), len(have) - 1)
                hit = have[at] == hashes[lo:hi]
                out[lo:hi][hit] = at[hit] + self.bases[s]
        return out

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        """Ids beyond the last word (the start of texts) belong to the last shard."""
        return np.clip(np.searchsorted(self.bases, ids, side="right") - 1, 0, len(self.bases) - 2)

    def column(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids; 0 for -1, which stands first, and for what is absent."""
        out, lo0 = None, int(np.searchsorted(ids, 0))
        for s, lo, hi in self._runs(self.shard_of(ids[lo0:])):
            have = self.part(name, s)
            if have is not None:
                if out is None:
                    out = np.zeros((len(ids), *have.shape[1:]), np.float64)
                at = ids[lo0 + lo : lo0 + hi] - self.bases[s]
                ok = at < len(have)
                out[lo0 + lo : lo0 + hi][ok] = have[at[ok]]
        return np.zeros(len(ids)) if out is None else out

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted (context, word) keys."""
        out = np.zeros(len(keys), np.int64)
        for s, lo, hi in self._runs(self.shard_of((keys >> np.uint64(32)).astype(np.int64))):
            have = self.part("pair", s)
            if have is not None and len(have):
                at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
                hit = have[at] == keys[lo:hi]
                out[lo:hi][hit] = self.part("pair-count", s)[at[hit]]
        return out


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the model's totals: tokens, distinct tokens, bigram types, discounts of both orders."""

    folder: str
    bases: tuple[int, ...]
    bits: int
    tokens: int
    words: int
    types: int
    bigram_discounts: tuple[float, float, float]
    unigram_discounts: tuple[float, float, float]
    unigram_backoff: float

    def arrays(self) -> _Shards:
        return _Shards(self.folder, np.array(self.bases, np.int64), self.bits)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of n-grams seen 1, 2, 3 and 4 times.

    Where these are too few to give discounts between 0 and the count, 0.5, 1 and 1.5 are taken.
    """
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 < x <= k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def train(docs: DataFrame) -> Model:
    """Counts all of `text` in docs. Null texts count as empty: their end is a token. Without rows the model knows no token."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(_fold(F.col("text")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = min(MOST_BITS, max(1, (size // SHARD_BYTES).bit_length()))
    folder = posix_dir(spark, "ngram-model")
    os.makedirs(folder, exist_ok=True)
    top = np.uint64(64 - bits)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Counter(lambda k: (k >> top).astype(np.int64))
        for batch in released(batches):
            for part in slices(batch, "text"):
                yield from found.add(*np.unique(_tokens(part)[0], return_counts=True))
        yield from found.flush()

    def store_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        k, c = _merged(table)
        save(f"{folder}/word-{shard}.npy", k)
        save(f"{folder}/count-{shard}.npy", c)
        return pa.table({"shard": pa.array([shard], pa.int64()), "words": pa.array([len(k)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64())})

    sizes = texts.mapInArrow(count_words, _BLOCK).groupBy("shard").applyInArrow(store_words, "shard long, words long, tokens long").collect()  # one row a shard
    per = np.zeros(1 << bits, np.int64)
    for r in sizes:
        per[r["shard"]] = r["words"]
    bases = np.concatenate([np.zeros(1, np.int64), np.cumsum(per)])
    words, tokens = int(bases[-1]), sum(r["tokens"] for r in sizes)
    if words >= (1 << 32) - 1:
        raise ValueError("more than 4 billion distinct words: ids need more than 32 bits")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Shards(folder, bases, bits)
        found = _Counter(lambda k: model.shard_of((k >> np.uint64(32)).astype(np.int64)))
        for batch in released(batches):
            for part in slices(batch, "text"):
                h, to = _tokens(part)
                unique, back = np.unique(h, return_inverse=True)
                ids = model.ids(unique)[back]
                before = np.concatenate([np.zeros(1, np.int64), ids[:-1]])
                before[to[:-1]] = words  # the start of a text
                yield from found.add(*np.unique((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), return_counts=True))
        yield from found.flush()

    def store_pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        k, c = _merged(table)
        row = (k >> np.uint64(32)).astype(np.int64) - bases[shard]
        rows = int(bases[shard + 1] - bases[shard]) + int(shard == len(bases) - 2)
        kinds = np.stack([np.bincount(row[m], minlength=rows) for m in (c == 1, c == 2, c > 2)], axis=1)
        save(f"{folder}/pair-{shard}.npy", k)
        save(f"{folder}/pair-count-{shard}.npy", c.astype(np.min_scalar_type(int(c.max(initial=0)))))
        save(f"{folder}/total-{shard}.npy", np.bincount(row, c, minlength=rows))
        save(f"{folder}/kinds-{shard}.npy", kinds.astype(np.uint32))
        # how many contexts each word has here goes to the word's shard; the counts of counts go with shard -1
        words_, contexts = np.unique(k & np.uint64(0xFFFFFFFF), return_counts=True)
        to = np.clip(np.searchsorted(bases, words_.astype(np.int64), side="right") - 1, 0, len(bases) - 2)
        out = [(-1, _pack_keys(np.arange(1, 6, dtype=np.uint64)), _pack(np.array([*((c == i).sum() for i in (1, 2, 3, 4)), len(k)], np.int64)))]
        for s in np.unique(to):
            out.append((int(s), _pack_keys(words_[to == s]), _pack(contexts[to == s].astype(np.int64))))
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("shard", "keys", "counts"), zip(*out), (pa.int64(), pa.binary(), pa.binary()))})

    def store_contexts(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        k, c = _merged(table)
        if shard < 0:
            counts = [0] * 5
            for i, n in zip(k, c):
                counts[int(i) - 1] = int(n)
        else:
            dense = np.zeros(int(bases[shard + 1] - bases[shard]), np.int64)
            dense[k.astype(np.int64) - bases[shard]] = c
            save(f"{folder}/contexts-{shard}.npy", dense)
            counts = [*(int((c == i).sum()) for i in (1, 2, 3, 4)), len(c)]
        return pa.table({"shard": pa.array([shard], pa.int64()), "counts": pa.array([counts], pa.list_(pa.int64()))})

    pairs = texts.mapInArrow(count_pairs, _BLOCK).groupBy("shard").applyInArrow(store_pairs, _BLOCK)
    found = pairs.groupBy("shard").applyInArrow(store_contexts, "shard long, counts array<long>").collect()  # one row a shard
    two = next((r["counts"] for r in found if r["shard"] < 0), [0] * 5)
    one = [sum(r["counts"][i] for r in found if r["shard"] >= 0) for i in range(5)]
    d2, d1 = discounts(two[:4]), discounts(one[:4])
    held = d1[0] * one[0] + d1[1] * one[1] + d1[2] * (one[4] - one[0] - one[1])
    return Model(folder, tuple(int(b) for b in bases), bits, tokens, words, two[4], d2, d1, held / two[4] if two[4] else 1.0)


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.choose(np.minimum(c, 3).astype(np.int64), (0.0, *d))


def score_part(part: pa.RecordBatch, model: Model, arrays: _Shards) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text of a batch."""
    h, to = _tokens(part)
    unique, back = np.unique(h, return_inverse=True)
    ids = arrays.ids(unique)
    known = np.concatenate([np.full(1, -1), ids[ids >= 0]])  # sorted, as ids follow hashes
    at = np.zeros(len(ids), np.int64)
    at[ids >= 0] = np.arange(1, len(known))
    count, contexts, total, kinds = (arrays.column(n, known) for n in ("count", "contexts", "total", "kinds"))
    kinds = kinds.reshape(len(known), 3) if kinds.ndim == 2 else np.zeros((len(known), 3))
    start = np.array([model.words])
    start_total, start_kinds = arrays.column("total", start), arrays.column("kinds", start).reshape(1, -1)
    word = at[back]
    before = np.concatenate([np.zeros(1, np.int64), word[:-1]])
    begins = np.zeros(len(h), bool)
    begins[to[:-1]] = True
    # the lower order: continuation counts, interpolated with an equal share for each word and the unknown one
    low = model.unigram_backoff / (model.words + 1) + np.maximum(contexts - _discount(contexts, model.unigram_discounts), 0) / max(1, model.types)
    d = np.array(model.bigram_discounts)
    weight = np.divide(kinds @ d, total, out=np.ones(len(known)), where=total > 0)
    start_weight = float(start_kinds[0] @ d / start_total[0]) if start_total[0] > 0 and start_kinds.shape[1] == 3 else 1.0
    context = np.where(begins, model.words, known[before])
    totals = np.where(begins, start_total[0], total[before])
    pair = (np.maximum(context, 0).astype(np.uint64) << np.uint64(32)) | np.maximum(known[word], 0).astype(np.uint64)
    asked, which = np.unique(pair, return_inverse=True)
    c = np.where((context >= 0) & (known[word] >= 0), arrays.bigrams(asked)[which], 0)
    direct = np.divide(np.maximum(c - _discount(c, model.bigram_discounts), 0), totals, out=np.zeros(len(h)), where=totals > 0)
    p = direct + np.where(begins, start_weight, weight[before]) * low[word]
    base = np.log10((count[word] + 1) / (model.tokens + model.words + 1))
    return {"n_tokens": np.diff(to), "n_known": per_text(count[word] > 0, to), "base_score": per_text(base, to), "score": per_text(np.log10(p), to)}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, base_score, score, perplexity, in one pass without a shuffle.

    score is the log10 probability of the whole text with its end. A null text counts as empty: one token, its end. Null doc_ids and
    repeated rows keep their rows; an empty table gives none; other columns are ignored. Texts of any length are scored whole.
    """

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = model.arrays()
        for batch in released(batches):
            for part in slices(batch, "text"):
                found = score_part(part, model, arrays)
                found["perplexity"] = 10 ** np.minimum(-found["score"] / found["n_tokens"], 300)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in found.values())], names=["doc_id", *found])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fold(F.col("text")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
