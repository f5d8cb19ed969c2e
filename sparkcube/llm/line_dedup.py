"""Line dedup over all documents: equal lines, and lines within one word edit, go but for the earliest.

A line is the sequence of its words; lines without words are left alone. Equal lines go whatever their length; one edit (a word
replaced, put in or taken out) counts for lines of min_words words or more: in shorter ones a word is much of the
meaning. Two lines within one edit have an equal variant: the line itself or the line without one of its words. So variants of
all lines are emitted as hashed keys and equal ones meet; the edit distance of each pair that meets is then verified on its words.
Before that, an exact sieve: of two such lines, the first or the last half(s) of the shorter's words agree, so lines that share no
half with another line emit no variants.

Passes over the texts: (1) lines and their halves, (2) variants and words of the lines that passed the sieve, (3) the new texts.
Decisions travel to (2) and (3) as sorted hash files that workers memory-map; whole texts are never shuffled. Equal lines are told
by 128 bits: two sums over the words and their places, of independent hashes of each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcube.llm._hashfiles import SortedFiles, write_sorted
from sparkcube.llm._shared import hot_keys, join_salted, join_skewed, small, small_batches, written
from sparkcube.llm._text import LINE, SPACED, buffers, hash_spans, hashed, mix, released, slices, spans

#: Lines of fewer words are compared for equality only.
MIN_WORDS = 8
#: Bytes of text that a worker handles at once.
SLICE = 1 << 20
_NONE = np.iinfo(np.int64).max


def _lines(part: pa.RecordBatch):
    """For each line with words: its text, number, first word and number of words; the hashes of line sequences; bytes and places."""
    data, at = buffers(part.column("text"))
    h, starts, ends, _ = hashed(data, at, SPACED)
    g = hash_spans(data, starts, ends, seed=1)
    # a line is what stands between newlines, empty ones included in the numbering
    ls, le = spans(data, at, LINE)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    doc = np.searchsorted(at, ls, side="right") - 1
    number = newline[ls] - newline[at[doc]]
    w0, w1 = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    ok = w1 > w0
    lo, n = w0[ok], (w1 - w0)[ok]
    return _Sequences((h, g), lo, n), doc[ok], number[ok], lo, n, (data, at, ls[ok], le[ok], starts, ends)


class _Sequences:
    """Hashes of lines, of their first and last words and of lines without a word, from prefix sums.

    A sequence's hash is the sum of its words' hashes, each mixed with the word's place; a second sum has them mixed with the place
    before, for words that move up when one before them is taken out, and a third one with the place from the end. All words belong
    to the lines (lo, n), which are told apart by lane 0, or by both lanes, of independent word hashes.
    """

    def __init__(self, lanes: tuple[np.ndarray, np.ndarray], lo: np.ndarray, n: np.ndarray):
        self.lanes, self.n, self.kept = lanes, n, {}
        self.place = np.arange(len(lanes[0])) - np.repeat(lo, n)
        self.mixed = mix(np.arange(-1, int(n.max(initial=0)) + 1).astype(np.uint64))  # of the places from -1 on

    def _sums(self, lane: int, what: str) -> np.ndarray:
        """Prefix sums over all words with their place, the place before, or the place from the end; made when first asked for."""
        if (lane, what) not in self.kept:
            at = {"here": lambda: self.place + 1, "moved": lambda: self.place, "end": lambda: np.repeat(self.n, self.n) - self.place}[what]()
            total = np.zeros(len(at) + 1, np.uint64)
            np.cumsum(mix(self.lanes[lane] ^ self.mixed[at]), out=total[1:])
            self.kept[lane, what] = total
        return self.kept[lane, what]

    def of(self, lo: np.ndarray, n: np.ndarray, lane: int = 0) -> np.ndarray:
        """The first n words of the line that begins at lo."""
        here = self._sums(lane, "here")
        return mix((here[lo + n] - here[lo]) ^ mix(n.astype(np.uint64)))

    def last(self, end: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The last n words of the line that ends at `end`."""
        total = self._sums(0, "end")
        return mix((total[end] - total[end - n]) ^ mix(n.astype(np.uint64)))

    def without(self, lo: np.ndarray, n: np.ndarray, i: np.ndarray, lane: int = 0) -> np.ndarray:
        """The line but for its word i."""
        here, moved = self._sums(lane, "here"), self._sums(lane, "moved")
        return mix((here[lo + i] - here[lo] + moved[lo + n] - moved[lo + i + 1]) ^ mix((n - 1).astype(np.uint64)))


def _first_in_text(doc: np.ndarray, a: np.ndarray, a2: np.ndarray) -> np.ndarray:
    """Whether no equal line stands before in the same text."""
    order = np.lexsort((np.arange(len(a)), a2, a, doc))
    again = np.ones(max(len(a) - 1, 0), bool)
    for x in (doc, a, a2):
        again &= x[order][1:] == x[order][:-1]
    first = np.ones(len(a), bool)
    first[order[1:][again]] = False
    return first


def _ids(part: pa.RecordBatch) -> np.ndarray:
    """doc_ids; a null one as the largest number, and such rows are left out of comparisons between documents."""
    return part.column("doc_id").fill_null(_NONE).to_numpy(zero_copy_only=False)


def _instances(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, a, a2, halves) of each text's first line of each kind; lines of fewer than `least` words have null halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text", SLICE):
                s, doc, _, lo, n, _ = _lines(part)
                ids, a, a2 = _ids(part), s.of(lo, n), s.of(lo, n, 1)
                keep = _first_in_text(doc, a, a2) & (ids[doc] != _NONE)
                doc, lo, n, a, a2 = (x[keep] for x in (doc, lo, n, a, a2))
                halves = []
                for short in (n, n - 1):  # as the shorter line of a pair or its equal, and as the longer one
                    k, tag = short // 2, mix(short.astype(np.uint64) + np.uint64(77))
                    halves += [mix(s.of(lo, k) ^ tag), mix(s.last(lo + n, k) ^ tag ^ np.uint64(1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[doc], a.view(np.int64), a2.view(np.int64))] + [pa.array(x.view(np.int64), mask=n < least) for x in halves], names=["doc_id", "a", "a2", "h1", "h2", "h3", "h4"]
                )

    return docs.mapInArrow(run, "doc_id long, a long, a2 long, h1 long, h2 long, h3 long, h4 long")


_VARIANT = ["v", "v2", "pos", "doc_id", "line", "a"]
_PAIR = "gone long, kept long"


def _earliest(v, v2, pos, doc, line, a, held):
    """Rows sorted by v, v2, pos, doc, line: pairs of lines (one that goes, the earlier one within an edit), and the state of the last run.

    Rows of one variant that lack the same word (pos) differ in that word only: all but the first go. The whole line (pos -1,
    first in its run) and a row that lacks a word are an edit apart: the later one goes.
    """
    if held is not None:
        v, v2, pos, doc, line, a = (np.concatenate([x, y]) for x, y in zip(held, (v, v2, pos, doc, line, a)))
    n = len(v)
    new = np.ones(n, bool)
    new[1:] = (v[1:] != v[:-1]) | (v2[1:] != v2[:-1])
    sub = new.copy()
    sub[1:] |= pos[1:] != pos[:-1]
    index = np.arange(n)
    head, lead = (np.maximum.accumulate(np.where(x, index, 0)) for x in (new, sub))
    same = (a != a[lead]) & (pos >= 0)
    whole = (pos[head] == -1) & (pos >= 0) & (a != a[head])
    later = whole & ((doc > doc[head]) | ((doc == doc[head]) & (line > line[head])))
    sooner = whole & ~later
    out = np.stack([np.concatenate([a[same], a[later], a[head[sooner]]]), np.concatenate([a[lead[same]], a[head[later]], a[sooner]])], axis=1)
    # what later rows of the same variant have to be held against: the whole line and the first of the last pos
    keep = sorted({int(head[-1]), int(lead[-1])})
    return np.unique(out, axis=0), tuple(x[keep] for x in (v, v2, pos, doc, line, a))


def _variants(docs: DataFrame, folder: str, bits: int, least: int) -> DataFrame:
    """Rows of the lines in the files: variants (v, v2, pos, doc_id, line, a); pairs that a slice of texts can tell alone (v null: a goes,
    as it is an edit from v2); and the lines themselves (pos -2, with their words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SortedFiles(folder, bits)
        for batch in released(batches):
            for part in slices(batch, "text", SLICE):
                s, doc, number, lo, n, (data, *_, starts, ends) = _lines(part)
                ids, a, a2 = _ids(part), s.of(lo, n), s.of(lo, n, 1)
                keep = np.flatnonzero(_first_in_text(doc, a, a2) & (ids[doc] != _NONE) & (n >= least))
                keep = keep[files.get(a[keep], _NONE, a2[keep]) == ids[doc[keep]]]  # in the document where the line is first
                if not len(keep):
                    continue
                lo, n, a, own, number = lo[keep], n[keep], a[keep], ids[doc[keep]], number[keep].astype(np.int32)
                raw = data.tobytes()
                text = [b" ".join(raw[starts[x] : ends[y - 1]].split()) for x, y in zip(lo, lo + n)]
                yield _rows([np.zeros(len(n), np.int64), a2[keep].view(np.int64), np.full(len(n), -2, np.int32), own, number, a.view(np.int64)], text)
                for first, last in _runs(n):
                    lo_, n_, a_, own_, number_ = (x[first:last] for x in (lo, n, a, own, number))
                    which = np.repeat(np.arange(len(n_)), n_)
                    i = np.arange(len(which)) - np.repeat(np.cumsum(n_) - n_, n_)
                    cols = [np.concatenate([s.of(lo_, n_, k), s.without(lo_[which], n_[which], i, k)]).view(np.int64) for k in (0, 1)]
                    cols += [np.concatenate([np.full(len(n_), -1), i]).astype(np.int32)]
                    cols += [np.concatenate([x, x[which]]) for x in (own_, number_, a_.view(np.int64))]
                    order = np.lexsort(cols[:5][::-1])
                    cols = [x[order] for x in cols]
                    gone, _ = _earliest(*cols, None)
                    one = np.ones(len(order), bool)
                    one[1:] = np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)
                    yield _rows([x[one] for x in cols])
                    nothing = np.zeros(len(gone), np.int64)
                    yield _rows([nothing, gone[:, 1], nothing.astype(np.int32), nothing, nothing.astype(np.int32), gone[:, 0]], null=True)

    return docs.mapInArrow(run, "v long, v2 long, pos int, doc_id long, line int, a long, words binary")


def _runs(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lines with about 100,000 variants; a longer line comes alone."""
    to, lo = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(to, to[lo] + 100_000, side="right")) - 1)
        yield lo, hi
        lo = hi


def _rows(cols: list[np.ndarray], text: list[bytes] | None = None, null: bool = False) -> pa.RecordBatch:
    first = pa.array(cols[0], mask=np.full(len(cols[0]), null))
    return pa.RecordBatch.from_arrays([first, *map(pa.array, cols[1:]), pa.array(text, pa.binary()) if text is not None else pa.nulls(len(cols[0]), pa.binary())], names=[*_VARIANT, "words"])


def _meeting(rows: DataFrame) -> DataFrame:
    """(gone, kept): lines that meet in a variant. Of a variant's rows that lack the same word the first one decides; it is found by
    partial and final minima, so that of a hot variant a row per missing word is left, and the others are held against it by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in released(batches):
            if batch.num_rows:
                gone, held = _earliest(*(batch.column(c).to_numpy() for c in _VARIANT), held)
                yield pa.RecordBatch.from_arrays([pa.array(gone[:, 0]), pa.array(gone[:, 1])], names=["gone", "kept"])

    by = ["v", "v2", "pos"]
    leads = rows.groupBy(*by).agg(F.min(F.struct("doc_id", "line", "a")).alias("f"), F.count(F.lit(1)).alias("n")).select(*by, "f.*", "n")
    leads = written(leads, "variant-leads")
    whole = leads.select(*_VARIANT).repartition("v").sortWithinPartitions(*_VARIANT[:5]).mapInArrow(run, _PAIR)
    many = written(leads.where("n > 1 and pos >= 0").select(*by, F.col("a").alias("kept"), "n"), "variants-of-many")
    others = _matched(rows, many, by).where("a <> kept").select(F.col("a").alias("gone"), "kept")
    return whole.union(others)


def _matched(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """rows (a written table) joined with keys (one each, and how many rows it has in n): few keys are broadcast."""
    few = small(keys)
    return rows.join(few, by) if few is not keys else join_skewed(rows, keys, by, "n", rows.count())


def edits(a: list[bytes], b: list[bytes]) -> int:
    """The word edit distance (replace, put in, take out) of two lines if it is at most 1; else 2."""
    if abs(len(a) - len(b)) > 1:
        return 2
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest = (a[i + (len(a) >= len(b)) :], b[i + (len(b) >= len(a)) :])
    return int(a != b) if rest[0] == rest[1] else 2


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, a2): the lines of pairs (gone, kept) that go, as their words (lines: a, a2, words) are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            words = [[x.split() for x in batch.column(c).to_pylist()] for c in ("wg", "wk")]
            ok = [edits(x, y) == 1 for x, y in zip(*words)]
            yield batch.select(["a", "a2"]).filter(pa.array(ok, pa.bool_()))

    own = pairs.join(lines.select(F.col("a").alias("gone"), "a2", F.col("words").alias("wg")), "gone")
    both = join_salted(own, lines.select(F.col("a").alias("kept"), F.col("words").alias("wk")), "kept", "gone", hot_keys(pairs, "kept"))
    return both.select(F.col("gone").alias("a"), "a2", "wg", "wk").mapInArrow(run, "a long, a2 long").distinct()


def _sharing(kinds: DataFrame) -> DataFrame:
    """(a): the lines that share a half with another line. Each half's smallest and largest line are found by partial and final minima;
    only the halves of three lines or more are joined with their lines."""
    keys = kinds.where("h1 is not null").select(F.explode(F.array("h1", "h2", "h3", "h4")).alias("key"), "a")
    ends = keys.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    ends = written(ends, "shared-halves")
    more = _matched(keys, ends.where("n > 2").select("key", "n"), ["key"]).select("a")
    return ends.select(F.explode(F.array("lo", "hi")).alias("a")).union(more).distinct()


def _deduped(docs: DataFrame, least: int) -> DataFrame:
    """dedup_lines() with a column _left: lines with words that stay."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    halves = ["h1", "h2", "h3", "h4"]
    kinds = _instances(texts, least).groupBy("a", "a2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), *(F.first(h).alias(h) for h in halves))
    kinds = written(kinds, "line-kinds")
    sieved = written(kinds.join(_sharing(kinds), "a").where("h1 is not null").select("a", "a2", "first"), "sieved")
    folder, bits = write_sorted(sieved, "a", "first", "sieved-files", "a2")
    variants = written(_variants(texts, folder, bits, least), "variants")
    lines = variants.where("pos = -2").select("a", F.col("v2").alias("a2"), "words")
    told = variants.where("v is null").select(F.col("a").alias("gone"), F.col("v2").alias("kept"))
    pairs = written(_meeting(variants.where("v is not null and pos > -2").select(*_VARIANT)).union(told).distinct(), "line-pairs")
    near = _verified(pairs, lines)
    low = F.lit(-(1 << 63)).cast("long")
    gone = kinds.where("n > 1").select("a", "a2", "first").union(near.select("a", "a2", low.alias("first")))
    gone = written(gone.groupBy("a", "a2").agg(F.min("first").alias("first")), "gone")
    to, to_bits = write_sorted(gone, "a", "first", "gone-files", "a2")

    added = ("n_lines", "n_equal", "n_near", "_left")
    kept = docs.drop(*added).withColumn("text", F.col("text").cast("string"))
    names = kept.columns
    id_at = next(i for i, c in enumerate(names) if c.lower() == "doc_id")
    text_at = next(i for i, c in enumerate(names) if c.lower() == "text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SortedFiles(to, to_bits)
        for batch in released(batches):
            for part in slices(batch, names[text_at], SLICE):
                view = pa.RecordBatch.from_arrays([part.column(id_at).cast(pa.int64()), part.column(text_at)], names=["doc_id", "text"])
                s, doc, _, lo, n, (data, at, ls, le, *_) = _lines(view)
                ids, a, a2 = _ids(view), s.of(lo, n), s.of(lo, n, 1)
                first, known = _first_in_text(doc, a, a2), ids[doc] != _NONE
                before = files.get(a, _NONE, a2)
                low = np.iinfo(np.int64).min
                near_copy = first & known & (before == low) & (ids[doc] != low)
                equal = ~first | (known & ~near_copy & (before < ids[doc]))
                out = equal | near_copy
                texts, has = part.column(text_at).to_pylist() if out.any() else None, part.column(text_at).is_valid()
                newlines = np.concatenate([[0], np.cumsum(data == 10)])
                n_lines = np.where(has.to_numpy(zero_copy_only=False), newlines[at[1:]] - newlines[at[:-1]] + 1, 0)
                column = part.column(text_at)
                if texts is not None:
                    raw = data.tobytes()
                    cuts = {}
                    for d, x, y in zip(doc[out], ls[out], le[out]):
                        cuts.setdefault(int(d), []).append((int(x), int(y)))
                    for d, gaps in cuts.items():
                        lo_, hi_, pieces = int(at[d]), int(at[d + 1]), []
                        for x, y in gaps:  # a line goes with the newline after it, the last one with the one before
                            pieces.append(raw[lo_:x])
                            lo_ = min(y + 1, hi_)
                        pieces.append(raw[lo_:hi_])
                        new = b"".join(pieces)
                        if gaps[-1][1] == hi_ and new.endswith(b"\n"):
                            new = new[:-1]
                        texts[d] = new.decode()
                    column = pa.array(texts, pa.string())
                columns = [c if i != text_at else column for i, c in enumerate(part.columns)]
                count = lambda x: pa.array(np.bincount(doc[x], minlength=part.num_rows).astype(np.int64))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines.astype(np.int64)), count(equal), count(near_copy), count(~out)], names=[*names, *added])

    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    return kept.mapInArrow(rewrite, schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs with the new text, and n_lines, n_equal and n_near: lines, and those removed as equal or as near copies.

    Order is by doc_id, then line. A line goes if an equal one stands before it, or if it has min_words words or more and its kind's
    first occurrence has a line within one word edit before it. Rows that repeat a doc_id don't remove each other's lines; rows with
    a null doc_id lose only lines that repeat in their own text. Null texts stay null with 0 lines; empty texts, lines without words and
    the order of what stays are untouched; an empty table gives no rows. Existing columns of the names added are replaced.
    """
    return _deduped(docs, min_words).drop("_left")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their new texts, but for those that lost lines and have no words left. The first document of a line never goes
    for it. Edge cases are as in dedup_lines()."""
    return _deduped(docs, min_words).where("_left > 0 or n_equal + n_near = 0").select(*docs.columns)
