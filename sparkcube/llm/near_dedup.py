"""Near-duplicate documents by SetSketch registers: sketch, band, estimate, verify on the full sets, connect.

A register of a set is floor(1 - log_b x) of the minimum x of exponential hash values (rate RATE) over its elements, truncated to
0..255: registers of a union are the maxima, and two sets agree in a register about as often as they are similar.

1. One pass over the texts gives each document its set size, a 128-bit digest (BLAKE2b) of its words and its registers.
2. Documents of equal words form a class, which goes on as its smallest doc_id. (A third of all rows may be one class: it is
   reduced before the shuffle, and its members never leave their tasks, see join_skewed.)
3. Bands hash BAND_ROWS registers each; classes that share a band form a bucket. In a bucket, every member is linked to the
   smallest one only: as many pairs as members. Pairs whose joint likelihood estimate is far too low are left out, the rest are
   verified on the words of the full texts, and components are formed.
4. Buckets that still hold several components are compared across components, by levels of size (sets of unlike sizes aren't
   similar) and in blocks of bounded size: first on registers, a pair only in the first band that it shares, then on the full sets
   of hashes, which come to each cell once for all its pairs. What reaches the threshold there is verified on the words as well.
   So no link between components is lost to step 3, and none inside one is needed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcube.llm._shared import hot_keys, join_salted, join_skewed, small, small_batches, written
from sparkcube.llm._text import FOLD, SPACED, buffers, hashed, mix, owners, released, slices, window_codes, windows, word_codes
from sparkcube.llm.components import connected_components

REGISTERS, BASE, RATE = 128, 1.1, 20.0
#: No register is in two bands, so bands fail independently. Of 10 million simulated pairs of equal sizes all bands missed 258 at
#: a similarity of 0.8, 93 at 0.81 and none at 0.85 (where 2 are expected).
BANDS, BAND_ROWS = 25, 5
#: Members of a block of a large bucket; a task compares two blocks at a time.
BLOCK = 2048
#: Set elements of such a block.
BLOCK_ELEMENTS = 1 << 20
#: A band's key holds its number above these bits.
KEY_BITS = 58
#: Pairs are left unverified only this many standard deviations below the threshold.
MARGIN = 6.0

_rng = np.random.default_rng(20_240_601)
_SEEDS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64)
_CHOICE = _rng.permutation(REGISTERS)[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)


def _sets(w: np.ndarray, wat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text's run of w, sorted within it, and each text's first one."""
    own = owners(wat)
    order = np.lexsort((w, own))
    w, own = w[order], own[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (own[1:] != own[:-1])
    w, own = w[fresh], own[fresh]
    return w, np.searchsorted(own, np.arange(len(at)))


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted within it, and each text's first one."""
    h, _, _, to = hashed(data, at, SPACED, fold=True)
    w, _, wat = windows(h, to, k)
    return _sets(w, wat, at)


def exact_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_sets(), but of numbers that are equal for shingles of the same words only, within this call."""
    h, starts, ends, to = hashed(data, at, SPACED, fold=True)
    return _sets(*window_codes(word_codes(FOLD[data], starts, ends, h), to, k), at)


def registers(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) uint8. An empty set has zeros."""
    out = np.zeros((len(at) - 1, REGISTERS), np.uint8)
    scale, step = 2.0**-64, 1 / math.log(BASE)
    for i in np.flatnonzero(np.diff(at)):
        low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
        for lo in range(at[i], at[i + 1], 4096):
            x = sets[lo : min(lo + 4096, at[i + 1]), None]
            y = x * _SEEDS
            y ^= y >> np.uint64(32)
            y *= _SHIFTS | np.uint64(1)
            np.minimum(low, y.min(axis=0), out=low)
        # the least of the uniform values gives the least of the exponential ones
        x = -np.log1p(-np.minimum((low.astype(np.float64) + 0.5) * scale, 1 - 1e-16)) / RATE
        out[i] = np.clip(np.floor(1 - np.log(x) * step), 0, 255)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys of the chosen registers; different bands have different keys, and those of earlier bands are smaller."""
    picked = regs[:, _CHOICE].astype(np.uint64)
    key = np.zeros(picked.shape[:2], np.uint64)
    for j in range(BAND_ROWS):
        key = key * np.uint64(257) + picked[:, :, j] + np.uint64(1)
    bands = np.arange(BANDS, dtype=np.uint64)
    return mix(key ^ mix(bands + np.uint64(1))[None, :]) >> np.uint64(64 - KEY_BITS) | (bands << np.uint64(KEY_BITS))[None, :]


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def estimate(greater: np.ndarray, less: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Similarity of most joint likelihood for sets of m and n elements, given in how many registers the first is greater or less.

    The likelihood is concave in the similarity; 40 golden-section steps over its whole range find the top.
    """
    u, v = m / (m + n), n / (m + n)
    equal = REGISTERS - greater - less

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _p(u - v * j), _p(v - u * j)
        safe = lambda x: np.log(np.maximum(x, 1e-12))
        return greater * safe(p) + less * safe(q) + equal * safe(1 - p - q)

    lo, hi, g = np.zeros(len(u)), np.minimum(u / v, v / u), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(a) > likelihood(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def _least(percent: int) -> float:
    t = percent / 100
    return t - MARGIN * math.sqrt(t * (1 - t) / REGISTERS)


def _may_link(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of registers and sizes that may reach the threshold: sizes allow it, and the estimate is not far below."""
    ok = 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
    if ok.any():
        i = np.flatnonzero(ok)
        ok[i] = estimate((a[i] > b[i]).sum(axis=1), (a[i] < b[i]).sum(axis=1), m[i].astype(float), n[i].astype(float)) >= _least(percent)
    return ok


def _fixed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


@lru_cache(None)
def _fewest_equal(percent: int) -> int:
    """Equal registers without which no pair reaches the threshold by _may_link(), whatever the sizes it allows (a grid of them, less 2)."""
    g, l = (x.ravel() for x in np.meshgrid(np.arange(REGISTERS + 1), np.arange(REGISTERS + 1)))
    g, l = g[g + l <= REGISTERS], l[g + l <= REGISTERS]
    fewest = REGISTERS
    for ratio in np.linspace(percent / 100, 1, 16):
        ok = estimate(g, l, np.full(len(g), 1e6), np.full(len(g), 1e6 * ratio)) >= _least(percent)
        fewest = min(fewest, int((REGISTERS - g - l)[ok].min(initial=REGISTERS)))
    return max(0, fewest - 2)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, fa, fb, regs) of every row, in one pass without a shuffle; fa and fb: a digest of the words, A-Z folded."""

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text"):
                data, at = buffers(part.column("text"))
                sets, to = shingle_sets(data, at, k)
                regs = registers(sets, to)
                raw = FOLD[data].tobytes()
                # split() parts at the very characters that part words here
                digest = b"".join(hashlib.blake2b(b" ".join(raw[x:y].split()), digest_size=16).digest() for x, y in zip(at[:-1], at[1:]))
                a, b = np.frombuffer(digest, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(to)), pa.array(a.copy()), pa.array(b.copy()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "n_shingles", "fa", "fb", "regs"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, fa long, fb long, regs binary")


def _banded(reps: DataFrame) -> DataFrame:
    """(key, doc_id), BANDS rows for each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys = band_keys(_fixed(part.column("regs")))
                ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "doc_id"])

    return reps.select("doc_id", "regs").mapInArrow(run, "key long, doc_id long")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be links by sizes and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(c).to_numpy() for c in ("na", "nb")]
                ok = _may_link(_fixed(batch.column("ra")), _fixed(batch.column("rb")), *n, percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = join_salted(pairs.join(side("b"), "b"), side("a"), "a", "b", hot_keys(pairs, "a"))
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a written table) whose full shingle sets reach the threshold: 100 * intersection >= percent * union, told by the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for half in slices(batch, "ta", 1 << 20):
                for part in slices(half, "tb", 1 << 20):
                    n, one = part.num_rows, [buffers(part.column(c)) for c in ("ta", "tb")]
                    data, at = np.concatenate([one[0][0], one[1][0]]), np.concatenate([one[0][1][:-1], one[1][1] + one[0][1][-1]])
                    sets, to = exact_sets(data, at, k)
                    ok = np.zeros(n, bool)
                    for r in range(n):
                        x, y = sets[to[r] : to[r + 1]], sets[to[n + r] : to[n + r + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        ok[r] = 100 * both >= percent * (len(x) + len(y) - both) and both > 0
                    yield part.select(["a", "b"]).filter(pa.array(ok))

    ids = written(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "paired")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_t")).join(small(ids), "_id", "left_semi")
    first = pairs.join(texts, pairs["b"] == texts["_id"]).select("a", "b", F.col("_t").alias("tb"))
    both = join_salted(first, texts.select(F.col("_id").alias("a"), F.col("_t").alias("ta")), "a", "b", hot_keys(pairs, "a"))
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _met(members: DataFrame, percent: int) -> DataFrame:
    """(cell, doc_id, others): the members of a cell that may be linked, with other members that they may be linked with, told by sizes
    and registers; each pair once, and a row without others for those that are only named. Each cell (bucket, x, y) holds the members
    of block x and of block y, or of one block if they are the same.

    A pair is left to the first band that it shares: that bucket is open as well, or has no other members, so that its star was tried.
    Rows come sorted by cell within a partition, so a cell is held and compared on its own: at most two blocks of about BLOCK members.
    """
    fewest = _fewest_equal(percent)

    def rows_of(number: int, ids: np.ndarray, others: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(others))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids), lists], names=["cell", "doc_id", "others"])

    def pairs(cell):
        """The cell's pairs, some rows of the matrix at a time."""
        at, ids, side, label, n, regs = cell
        number = int(mix(at[:1, 0].view(np.uint64) ^ mix(at[:1, 1].view(np.uint64) ^ mix(at[:1, 2].view(np.uint64)))).view(np.int64)[0])
        own = at[0, 1] == at[0, 2]
        left, right = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min()))
        columns = np.ascontiguousarray(regs[right].T)
        earlier = band_keys(regs)[:, : int(at[0, 0]) >> KEY_BITS]
        named = np.zeros(len(ids), bool)
        for lo in range(0, len(left), 256):
            i = left[lo : lo + 256]
            ok = label[i][:, None] != label[right][None, :]
            ok &= 100 * np.minimum(n[i][:, None], n[right][None, :]) >= percent * np.maximum(n[i][:, None], n[right][None, :])
            if own:
                ok &= i[:, None] < right[None, :]
            if ok.any():
                equal = np.zeros(ok.shape, np.uint8)
                for r in range(REGISTERS):
                    equal += regs[i, r][:, None] == columns[r][None, :]
                x, y = np.nonzero(ok & (equal >= fewest))
                for s in range(0, len(x), 1 << 15):
                    u, v = i[x[s : s + (1 << 15)]], right[y[s : s + (1 << 15)]]
                    fresh = ~(earlier[u] == earlier[v]).any(axis=1)
                    u, v = u[fresh], v[fresh]
                    if len(u):
                        named[v] = True
                        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                        yield rows_of(number, ids[u[first]], ids[v], np.append(first, len(u)))
        if named.any():
            yield rows_of(number, ids[named], ids[:0], np.zeros(named.sum() + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in released(batches):
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023,E731
            now = [np.stack([column("key"), column("x"), column("y")], axis=1), *(column(c) for c in ("doc_id", "side", "label", "n_shingles")), _fixed(batch.column("regs"))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            cuts = np.concatenate([[0], np.flatnonzero(np.any(now[0][1:] != now[0][:-1], axis=1)) + 1, [len(now[0])]])
            for lo, hi in zip(cuts[:-2], cuts[1:-1]):
                yield from pairs([x[lo:hi] for x in now])
            held = [x[cuts[-2] :] for x in now]  # the last cell may go on in the next batch
        if held is not None:
            yield from pairs(held)

    rows = members.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return rows.select("key", "x", "y", "doc_id", "side", "label", "n_shingles", "regs").mapInArrow(run, "cell long, doc_id long, others array<long>")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one bucket but of different components that may be links by sizes and registers."""
    pairs = _met(members, percent).select("doc_id", F.explode("others").alias("o"))
    return pairs.select(F.least("doc_id", "o").alias("a"), F.greatest("doc_id", "o").alias("b")).distinct()


def _element_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, elements) of the documents in ids (_id; a written table): set size and 32 bits of each shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text"):
                sets, to = shingle_sets(*buffers(part.column("text")), k)
                short = (mix(sets) >> np.uint64(32)).astype(np.uint32)
                packed = pa.array([short[x:y].tobytes() for x, y in zip(to[:-1], to[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(to)), packed], names=["doc_id", "n", "elements"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(small(ids), rows["doc_id"] == ids["_id"], "left_semi")
    return rows.mapInArrow(run, "doc_id long, n long, elements binary").where("n > 0").distinct()


def _sieved(met: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): the pairs of met (a written table of _met()) whose sets of hashes reach the threshold. Equal hashes of unlike shingles can
    only let more pairs through, so no link is lost. A cell's sets come before its pairs and are held for all of them.
    """

    class Cell:
        def __init__(self, rows: list[tuple[int, int, bytes]]) -> None:
            rows.sort(key=lambda r: r[0])
            self.ids, self.n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            self.at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.n)])
            values, codes = np.unique(np.frombuffer(b"".join(r[2] for r in rows), np.uint32), return_inverse=True)
            self.codes, self.inside = codes.astype(np.int32), np.zeros(len(values), np.uint8)

        def places(self, ids: np.ndarray) -> np.ndarray:
            """Where the sets of these ids are; an id of several texts has several."""
            lo, hi = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, side="right")
            return np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())

        def links(self, one: int, others: np.ndarray) -> np.ndarray:
            found = []
            for i in self.places(np.array([one])):
                mine = self.codes[self.at[i] : self.at[i + 1]]
                self.inside[mine] = 1
                where = self.places(others)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(self.n[where]) >> 20)) + 1, [len(where)]])
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    j = where[lo:hi]
                    first = np.cumsum(self.n[j]) - self.n[j]
                    hits = self.inside[self.codes[np.repeat(self.at[j] - first, self.n[j]) + np.arange(self.n[j].sum())]]
                    both = np.add.reduceat(hits, first, dtype=np.int64)
                    found.append(self.ids[j[100 * both >= percent * (self.n[i] + self.n[j] - both)]])
                self.inside[mine] = 0
            return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, cell = None, [], None
        for batch in released(batches):
            a, b = [], []
            others = batch.column("others")
            for r, (number, one, n, elements) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "doc_id", "n", "elements")))):
                if number != now:
                    now, sets, cell = number, [], None
                if elements is not None:
                    sets.append((one, n, elements))
                    continue
                if cell is None:
                    cell, sets = Cell(sets), []
                found = cell.links(one, others[r].values.to_numpy())
                a.append(np.minimum(found, one))
                b.append(np.maximum(found, one))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    sets = _element_sets(docs, written(met.select(F.col("doc_id").alias("_id")).distinct(), "met"), k)
    sets = met.select("cell", "doc_id").distinct().join(sets, "doc_id").select("cell", "doc_id", "n", "elements", F.lit(None).cast("array<bigint>").alias("others"))
    rows = sets.union(met.where(F.size("others") > 0).select("cell", "doc_id", F.lit(None).cast("long"), F.lit(None).cast("binary"), "others"))
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("elements").isNull())
    return rows.mapInArrow(run, "a long, b long").distinct()


def _cells(open_members: DataFrame, percent: int) -> DataFrame:
    """The members (key, doc_id, n_shingles, ...) of open buckets, each once for every cell (key, x, y) that it has a part in.

    Levels are logarithms of the size to the base of the threshold: sets two levels apart can't reach it. A level of a bucket is cut
    into blocks of BLOCK members and BLOCK_ELEMENTS elements at most, by a hash; blocks meet those of their own level and of the next one.
    """
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(max(-math.log(percent / 100), 1e-9) * (1 + 1e-9))).cast("long")
    members = written(open_members.withColumn("level", level), "open-members")
    sizes = written(members.groupBy("key", "level").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_ELEMENTS)).cast("long").alias("blocks"), F.count(F.lit(1)).alias("rows")), "open-levels")
    near = lambda by, name: sizes.select("key", (F.col("level") + by).alias("level"), F.col("blocks").alias(name))
    sizes = sizes.join(near(-1, "above"), ["key", "level"], "left").join(near(1, "below"), ["key", "level"], "left").na.fill(0, ["above", "below"])
    placed = join_skewed(members, sizes, ["key", "level"], "rows", members.count()).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    # a block's number: its level and place; cells are named by their lower and their higher block
    number = lambda level, place: F.col("level") * F.lit(1 << 24) + level * F.lit(1 << 24) + place
    others = lambda count, by: F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), lambda i: number(F.lit(by), i))).otherwise(F.array().cast("array<bigint>"))
    placed = placed.withColumn("own", number(F.lit(0), F.col("block")))
    placed = placed.withColumn("other", F.explode(F.concat(others("blocks", 0), others("above", 1), others("below", -1))))
    return placed.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "side": F.col("own")})


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents are linked when 100 * |intersection| >= percent * |union| of their distinct k-word shingle sets (A-Z folded; a text
    of fewer words is one shingle); component_id is the smallest doc_id reached. Null, empty and wordless texts have empty sets and
    are linked with nothing. Rows that repeat a doc_id belong to one document, linked by any of its texts. A null doc_id is linked
    with nothing, has a null component_id and is kept. An empty table gives no rows; other columns are ignored.
    """
    sketches = written(sketch(docs, k), "sketches")
    linkable = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = written(linkable.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    key = classes.select(F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), "rep")
    # joined by doc_id, so that the rows of a large class are spread
    is_rep = (sketches["doc_id"] == key["rep"]) & (sketches["fa"] == key["_fa"]) & (sketches["fb"] == key["_fb"])
    reps = written(sketches.join(key, is_rep).select("doc_id", "n_shingles", "regs").distinct(), "representatives")
    placed = written(join_skewed(linkable.select("doc_id", "fa", "fb"), classes, ["fa", "fb"], "rows", sketches.count()).select("doc_id", "rep"), "placed")
    # rows of one doc_id in several classes link these
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("_top")).where("u < _top").select("doc_id", "u")
    same = written(placed.join(several, "doc_id").select("u", F.col("rep").alias("v")).where("u <> v").distinct(), "repeated-ids")

    n_reps = reps.count()
    banded = written(_banded(reps), "bands")
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z")
    shared = written(shared.select("key", "a", "n"), "shared-bands")
    buckets = written(join_skewed(banded, shared, ["key"], "n", n_reps * BANDS), "buckets")
    stars = written(buckets.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "stars")
    tried = written(_estimated(stars, reps, percent), "pairs")
    links = written(_verified(tried, docs, k, percent), "star-links")
    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    labelled = buckets.select("key", "n", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    labelled = written(labelled, "labelled-buckets")
    open_ = labelled.groupBy("key", "n").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("doc_id")).alias("s"), F.sum(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))).alias("t")
    )
    # buckets of the same members are compared once, in their first band; two members were compared by their star already
    open_ = written(open_.where("lo < hi and n > 2").groupBy("n", "s", "t").agg(F.min("key").alias("key")).select("key", "n"), "open-buckets")
    again = join_skewed(labelled.select("key", "doc_id", "label"), open_, ["key"], "n", n_reps * BANDS).join(reps, "doc_id")
    cells = _cells(again.select("key", "doc_id", "label", "n_shingles", "regs"), percent)
    more = _sieved(written(_met(cells, percent), "met-members"), docs, k, percent).join(tried, ["a", "b"], "left_anti")
    links = links.union(_verified(written(more, "more-pairs"), docs, k, percent))

    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(same))
    labels = labels.select(F.col("node").alias("rep"), "label")
    # several classes may have one rep, by repeated ids
    ends = classes.groupBy("rep").agg(F.sum("rows").alias("rows")).join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    found = join_skewed(placed, written(ends, "labels"), ["rep"], "rows", sketches.count()).groupBy("doc_id").agg(F.min("label").alias("label"))
    out = sketches.select("doc_id", "n_shingles").join(found.select(F.col("doc_id").alias("_node"), "label"), F.col("doc_id") == F.col("_node"), "left")
    out = out.withColumn("component_id", F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are near-duplicates of a kept one: of each component, the rows of its smallest doc_id stay."""
    gone = written(near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-duplicates")
    return docs.join(small(gone), F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)
