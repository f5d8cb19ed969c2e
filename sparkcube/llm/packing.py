"""Conflict-constrained best-fit packing of texts into bins of fixed capacity.

A text of n words takes n tokens and one for its end; longer ones are cut into pieces of at most a bin. Pieces are spread over
blocks of about BLOCK_BYTES of text by a hash of their id, so that a hot source or a large group of copies lands evenly, and each block
is packed by one task: largest piece first, into the bin with the least room that suffices and that has no conflict. Bins are ordered by
room and carry bitmaps of the block's sources and duplicate clusters; the search goes on from one bin to the next roomier one
until a compatible bin is found, else it opens a bin. A bin holds no two pieces of a duplicate cluster (texts of equal words, A-Z folded,
or of equal values in a column that the caller names, such as component_id; so no two pieces of a text either), and at most `limit`
pieces of a source: by default the fewest with which the most frequent source can still be spread over all bins, see source_limit().
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcube.llm._shared import small_batches, written
from sparkcube.llm._text import SPACED, buffers, hashed, mix, owners, per_text, released, slices

CAPACITY = 2048
#: Bytes of text in a block, whatever the number of documents: what a task holds of it.
BLOCK_BYTES = 8 << 20


def best_fit(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int, limit: int) -> list[int]:
    """Bin of each item, in the order given (largest first gives the best fill). Sources of -1 conflict with none.

    sources and clusters are small numbers, each a bit. A bin's source bitmaps, one per count up to the limit, say which sources it
    holds that often.
    """
    bins: list[int] = []
    by_room: list[tuple[int, int]] = []  # (room, bin), ordered
    held: list[int] = []  # cluster bitmaps
    full: list[list[int]] = []  # source bitmaps
    for size, source, cluster in zip(sizes, sources, clusters):
        c, s = 1 << cluster, 1 << source if source >= 0 else 0
        at = bisect_left(by_room, (size, -1))
        while at < len(by_room) and (held[by_room[at][1]] & c or full[by_room[at][1]][-1] & s):
            at += 1
        if at < len(by_room):
            room, k = by_room.pop(at)
        else:
            room, k = capacity, len(held)
            held.append(0)
            full.append([0] * limit)
        insort(by_room, (room - size, k))
        held[k] |= c
        for level in range(limit):  # the first count at which the source isn't there yet
            if not full[k][level] & s:
                full[k][level] |= s
                break
        bins.append(k)
    return bins


_PIECES = "doc_id long, source string, cluster long, piece int, start_word long, n_tokens long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, texts: bool = False, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, piece, start_word, n_tokens[, text]) of every row, at least one piece each, without a shuffle."""

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text"):
                data, at = buffers(part.column("text"))
                h, starts, _, to = hashed(data, at, SPACED, fold=True)
                n = np.diff(to) + 1
                place = (np.arange(len(h)) - to[:-1][owners(to)]).astype(np.uint64)
                # sums of words mixed with their places: equal for equal word sequences
                own = mix(per_text(mix(h ^ mix(place)).view(np.int64), to).view(np.uint64) + n.astype(np.uint64)).view(np.int64)
                if cluster is not None:
                    named = part.column("_cluster")
                    own = np.where(named.is_valid().to_numpy(zero_copy_only=False), named.fill_null(0).to_numpy(zero_copy_only=False), own)
                count = -(-n // capacity)
                row = np.repeat(np.arange(part.num_rows), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                size = np.minimum(capacity, n[row] - start)
                columns = [part.column("doc_id").take(pa.array(row)), part.column("source").take(pa.array(row)), *(pa.array(x) for x in (own[row], piece.astype(np.int32), start, size))]
                names = ["doc_id", "source", "cluster", "piece", "start_word", "n_tokens"]
                if texts:
                    edge = np.concatenate([starts, np.zeros(1, np.int64)])
                    first = np.where(piece == 0, at[:-1][row], edge[np.minimum(to[:-1][row] + start, len(starts))])
                    # the end of a text may be a piece of its own, without words
                    first = np.where((piece > 0) & (start >= n[row] - 1), at[1:][row], first)
                    last = np.where(piece == count[row] - 1, at[1:][row], np.concatenate([first[1:], np.zeros(1, np.int64)]))
                    raw = data.tobytes()
                    columns.append(pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(first, last)], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *([F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster)).alias("_cluster")] if cluster is not None else []))
    return rows.mapInArrow(run, _PIECES + (", text string" if texts else ""))


def source_limit(narrow: DataFrame, capacity: int = CAPACITY) -> int:
    """How many pieces of a source a bin may hold: the most frequent source's pieces over the bins that all tokens need, rounded up, and
    one more as slack for best-fit. With fewer, that source alone would need more bins than all tokens do."""
    sources = narrow.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tokens = narrow.agg(F.sum("n_tokens")).first()[0] or 0
    return -(-sources // max(1, -(-tokens // capacity))) + 1


def pack(docs: DataFrame, capacity: int = CAPACITY, limit: int | None = None, texts: bool = False, cluster: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start_word, n_tokens, bin_id, bin_slot, bin_offset[, text].

    bin_id is unique, bin_offset is the piece's first token in its bin, bin_slot its place. Null and empty texts take one token; null
    sources conflict with none; null values of the column `cluster` leave the cluster to the words; null doc_ids and repeated rows are
    packed like others (repeats are of one cluster); an empty table gives no rows; other columns are ignored.
    """
    narrow = written(pieces(docs, capacity, cluster=cluster), "pieces")
    limit = source_limit(narrow, capacity) if limit is None else limit
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 1)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        code = table.column("source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_pylist()
        cluster = table.column("cluster").combine_chunks().dictionary_encode().indices.to_pylist()
        sizes = table.column("n_tokens").to_pylist()
        found = best_fit(sizes, code, cluster, capacity, limit)
        slot, offset, used = [], [], {}
        for k, n in zip(found, sizes):
            j, o = used.get(k, (0, 0))
            slot.append(j)
            offset.append(o)
            used[k] = j + 1, o + n
        base = table.column("block")[0].as_py() << 24
        out = {n: table.column(n) for n in ("doc_id", "piece", "start_word", "n_tokens")}
        out |= {"bin_id": pa.array([base + k for k in found], pa.int64()), "bin_slot": pa.array(slot, pa.int32()), "bin_offset": pa.array(offset, pa.int64())}
        return pa.table(out | ({"text": table.column("text")} if texts else {}))

    blocked = (pieces(docs, capacity, True, cluster) if texts else narrow).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "doc_id", "piece"), F.lit(blocks)))
    schema = "doc_id long, piece int, start_word long, n_tokens long, bin_id long, bin_slot int, bin_offset long" + (", text string" if texts else "")
    return blocked.groupBy("block").applyInArrow(run, schema)
