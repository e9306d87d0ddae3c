"""Packing documents into sequences of a fixed number of tokens: large items matched, small ones best fit.

Lengths are whole numbers up to the capacity, so a table of how many pieces have each length (at most `capacity` rows)
decides the whole packing: pieces of equal length are alike. The driver plans on that table, the same work for any
input. Items above a third of the capacity go at most two to a bin, each matched greedily to the largest partner that
fits; smaller ones, from the longest, go to the bin with the least gap that takes them. A plan is a list of runs: ranks
r0 to r1 of one length go to bins from s0 on, k to a bin. Pieces learn their rank within their length by bucket counts
and prefix sums, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, written
from .tokens import encoded, vocabulary

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, ends in encoded(batch.column(1), path, end_id):
                n = np.diff(ends)
                many = -(-n // capacity)
                row = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                # the first piece takes what whole ones leave
                upto = n[row] - (many[row] - 1 - piece) * capacity
                start = np.where(piece == 0, 0, upto - capacity)
                bytes_ = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(bytes_[4 * x : 4 * y]) for x, y in zip((ends[row] + start).tolist(), (ends[row] + upto).tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(upto - start), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, vocabulary_path: str | None = None) -> DataFrame:
    """Each document's ids with end_id after them, cut where longer than capacity; then the first piece is the shorter."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(_cut(vocabulary_path or vocabulary(), end_id, capacity), PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, r0, r1, s0, k, base) for so many pieces of each length: rank r goes to sequence s0 + (r - r0) // k
    at offset base + (r - r0) % k * length."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins: list[tuple[int, int, int]] = []  # gap, first sequence, how many; ascending
    made = 0

    def put(n: int, first: int, many: int, k: int, base: int) -> None:
        runs.append((n, used[n], used[n] + many * k, first, k, base))
        used[n] += many * k
        left[n] -= many * k

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((p for p in large if p <= n and n + p <= capacity and left[p] > (p == n)), None)
            many = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
            put(n, made, many, 1, 0)
            if partner is not None:
                put(partner, made, many, 1, n)
            insort(bins, (capacity - n - (partner or 0), made, many))
            made += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(bins, (n,))
            if at == len(bins):
                many = max(1, left[n] // (capacity // n))
                bins.append((capacity, made, many))
                made += many
            gap, first, many = bins.pop(at)
            k = min(gap // n, left[n])
            now = min(many, left[n] // k)
            put(n, first, now, k, capacity - gap)
            insort(bins, (gap - k * n, first, now))
            if many > now:
                insort(bins, (gap, first + now, many - now))
    return runs


def _place(runs: list[tuple]):
    by_length: dict[int, np.ndarray] = {}
    for n in {r[0] for r in runs}:
        by_length[n] = np.array(sorted(r[1:] for r in runs if r[0] == n), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0, True]) if len(order) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows, n = order[a:b], int(lengths[order[a]])
                t = by_length[n]
                at = t[np.searchsorted(t[:, 0], ranks[rows], "right") - 1]
                q = ranks[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + q // at[:, 3]
                offset[rows] = at[:, 4] + q % at[:, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces (see PIECES) with sequence_id and offset; every length must be from 1 to capacity. The pieces are read
    more than once, so they should be a written table. Fully equal rows may trade places."""
    buckets = shuffle_partitions(pieces.sparkSession)
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(sizes, ["length", "bucket"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(_place(plan(counts, capacity)), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, vocabulary_path: str | None = None) -> DataFrame:
    """Encode, cut and pack every document (null text: empty, which is one token) into few sequences of at most capacity.

    Returns for each piece id_column, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed
    each; a null id stays null; an empty table gives an empty result; other columns are left out. No piece is dropped.
    """
    pieces = written(token_pieces(docs, capacity, id_column, text_column, end_id, vocabulary_path), "pieces")
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_column)
