"""Substring dedup by fixed-block anchors.

A window of w words holds a whole block of w // 2 words that starts at a multiple of w // 2 in its document. So
non-overlapping blocks of every document are the index, and every rolling block probes it:

1. probe: each task sends a 32-bit fingerprint of every rolling block to the bucket of its hash, a few packed bytes
   each. In a bucket the aligned ones are the index; whatever meets an index entry at another place is a hit. Blocks
   that repeat within a task are hits already and go out once, so that a passage of a third of all documents costs one
   entry for each task.
2. extend: hits go back to their documents. Each is extended to all windows that hold it; those windows meet under
   128-bit hashes, again one of each task, and all but the first start of a sequence are repeats.
3. remove: repeated windows go back to their documents, where overlapping ones merge to maximal exact repeats.

Fingerprints only propose; the 128-bit hash of the whole window decides. Shuffled are the probes (about 5 bytes a
word), the texts once, and the candidate windows. Nothing is collected and no pairs are formed. A document goes by its
key, a hash of id and text: different texts under one id, or without one, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .shared import partitions_for
from .wordhash import U, pieces, windows

#: Probes that a task holds before it sends them: some 100 MB with what sorting takes.
HELD = 1_200_000


def _first_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in any order: order by keys (the last is the main one), and in that order where a new main key begins."""
    order = np.lexsort(keys)
    main = keys[-1][order]
    return order, np.r_[True, main[1:] != main[:-1]] if len(main) else np.zeros(0, bool)


def _probes(buckets: int, homes: int, block: int):
    def send(ids, pos, h) -> Iterator[pa.RecordBatch]:
        ids, pos, h = np.concatenate(ids), np.concatenate(pos), np.concatenate(h)
        order, new = _first_of_equal(pos % block != 0, h)  # an aligned one stands for its equals
        group = np.cumsum(new) - 1
        many = np.zeros(len(h), bool)
        many[order] = np.bincount(group)[group] > 1
        keep = np.zeros(len(h), bool)
        keep[order[new]] = True
        b = ((h >> U(32)) % U(buckets)).astype(np.int64)
        yield from packed.pack("bucket", b[keep], ids[keep], pos[keep], [h[keep].astype(np.uint32)])
        home = _home(ids[many], homes)
        yield from packed.pack("bucket", home % buckets, ids[many], pos[many], [home.astype(np.uint32)], kind=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pos, h, n = [], [], [], 0
        for batch in batches:
            doc_ids = packed.ids_of(batch.column(0))
            for a, b, words in pieces(batch.column(1)):
                ok = np.flatnonzero(words.room() >= block)
                if not len(ok):
                    continue
                ids.append(np.repeat(doc_ids[a:b], words.counts)[ok])
                pos.append(ok - np.repeat(words.first[:-1], words.counts)[ok])
                h.append(windows(words.hashes(), block)[ok])
                n += len(ok)
                if n >= HELD:
                    yield from send(ids, pos, h)
                    ids, pos, h, n = [], [], [], 0
        if n:
            yield from send(ids, pos, h)

    return run


def _home(keys: np.ndarray, homes: int) -> np.ndarray:
    """The group that the document of a key lies in; the same formula as home_of."""
    return (keys % homes).astype(np.int64)


def home_of(key, homes: int):
    return F.pmod(key, F.lit(homes).cast("long")).cast("int")


def _answer(found: pa.Table, homes: int, decide, kinds) -> pa.Table:
    """What decide picks of a bucket's entries, and what tasks knew themselves, to the documents' groups."""
    kind = found.column("kind").to_numpy()
    ids, pos, values, _ = packed.unpack(found.filter(pa.array(kind == 0)), kinds)
    pick = decide(ids, pos, values)
    known_ids, known_pos, _, _ = packed.unpack(found.filter(pa.array(kind == 1)), (np.uint32,))
    ids, pos = np.r_[ids[pick], known_ids], np.r_[pos[pick], known_pos]
    order = np.lexsort((pos, ids))
    ids, pos = ids[order], pos[order]
    to = packed.arrow_schema("home", 0)
    return pa.Table.from_batches(list(packed.pack("home", _home(ids, homes), ids, pos, [])), to)


def _hits(homes: int, block: int):
    def decide(_, pos, values):
        (fp,) = values
        index = np.unique(fp[pos % block == 0])
        if not len(index):
            return np.zeros(len(fp), bool)
        at = np.minimum(np.searchsorted(index, fp), len(index) - 1)
        met = index[at] == fp
        return met & (np.bincount(at[met], minlength=len(index)) > 1)[at]

    return lambda found: _answer(found, homes, decide, (np.uint32,))


def _judged(ids, keys, pos, high, low) -> tuple[np.ndarray, np.ndarray]:
    """For windows under two hashes: which are repeats (an equal one lies in a document of smaller id, or earlier in the
    same document), and which of the others come first among equal rows."""
    order = np.lexsort((pos, keys, ids, low, high))
    i, k, p, h, g = ids[order], keys[order], pos[order], high[order], low[order]
    n = np.arange(len(order))
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][: len(order)]
    turn = new | np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])][: len(order)]
    head, own = np.maximum.accumulate(np.where(new, n, 0)), np.maximum.accumulate(np.where(turn, n, 0))
    later, single = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = (i > i[head]) | (p > p[own])
    single[order[turn]] = True
    return later, single & ~later


def _repeats(homes: int):
    return lambda found: _answer(found, homes, lambda keys, pos, values: _judged(values[2], keys, pos, *values[:2])[0], (np.uint64, np.uint64, np.int64))


def _marks(answers: pa.Table, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word numbers, in a group's texts one after another, that the answers name. Keys may repeat."""
    named, pos, _, _ = packed.unpack(answers, ())
    if not len(named):
        return named
    order = np.argsort(named, kind="stable")
    named, pos = named[order], pos[order]
    known, run = np.unique(named, return_index=True)
    stop = np.r_[run[1:], len(named)]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    out = [first[d] + pos[run[at[d]] : stop[at[d]]] for d in np.flatnonzero(known[at] == keys)]
    return np.concatenate(out) if out else named[:0]


def _counted(texts: pa.Array) -> np.ndarray:
    """The number of the first word of each text, and of all words."""
    counts = [words.counts for _, _, words in pieces(texts)]
    return np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)


def _candidates(buckets: int, homes: int, window: int, block: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        to = packed.arrow_schema("bucket", 3)
        keys, doc_ids = docs.column(1).combine_chunks().to_numpy(zero_copy_only=False), packed.ids_of(docs.column(2).combine_chunks())
        got: list[tuple] = []
        first = _counted(docs.column(3))
        marks = np.unique(_marks(answers, keys, first))
        for a, b, words in pieces(docs.column(3)):
            base = first[a]
            own = marks[np.searchsorted(marks, base) : np.searchsorted(marks, base + len(words))] - base
            if not len(own):
                continue
            low = np.maximum(own - (window - block), np.repeat(words.first[:-1], words.counts)[own])
            edge = np.bincount(low, minlength=len(words) + 1) - np.bincount(own + 1, minlength=len(words) + 1)
            at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (words.room() >= window))
            start, row = np.repeat(words.first[:-1], words.counts)[at], a + np.repeat(np.arange(b - a), words.counts)[at]
            got.append((doc_ids[row], keys[row], at - start, windows(words.hashes(), window)[at], windows(words.hashes(1), window, 1)[at]))
        if not got:
            return to.empty_table()
        ids, keys, pos, high, low = (np.concatenate(x) for x in zip(*got, strict=True))
        later, kept = _judged(ids, keys, pos, high, low)
        b = ((high[kept] >> U(20)) % U(buckets)).astype(np.int64)
        home = _home(keys[later], homes)
        out = [*packed.pack("bucket", b, keys[kept], pos[kept], [high[kept], low[kept], ids[kept]])]
        for x in packed.pack("bucket", home % buckets, keys[later], pos[later], [home.astype(np.uint32)], kind=1):
            out.append(pa.RecordBatch.from_arrays([*x.columns, *(pa.nulls(len(x), pa.binary()) for _ in range(2))], schema=to))
        return pa.Table.from_batches(out, to)

    return run


def _removed(window: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, texts, where = docs.column(1).combine_chunks().to_numpy(zero_copy_only=False), docs.column(3), []
        first = _counted(texts)
        marks = _marks(answers, keys, first)
        n = int(first[-1])
        edge = np.bincount(marks, minlength=n + window) - np.bincount(marks + window, minlength=n + window)[: n + window]
        gone = np.cumsum(edge)[:n] > 0
        before = np.r_[0, np.cumsum(gone)]
        lost = before[first[1:]] - before[first[:-1]]
        kept = []
        for d, text in enumerate(texts):
            words = (text.as_py() or "").encode().split()
            if lost[d]:
                g = gone[first[d] : first[d + 1]]
                turn = np.flatnonzero(np.diff(np.r_[False, g, False]))
                where.append([{"from": int(a), "to": int(b)} for a, b in turn.reshape(-1, 2)])
                words = [words[i] for i in np.flatnonzero(~g)]
            else:
                where.append([])
            kept.append(b" ".join(words).decode())
        spans = pa.array(where, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
        return pa.table({"id": docs.column(2), "n_words": np.diff(first), "n_removed": lost, "kept_text": pa.array(kept, pa.string()), "spans": spans})

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20) -> DataFrame:
    """Remove each word covered by a window of `window` words whose sequence also starts earlier.

    Earlier: in a document of smaller id, or in the same one at an earlier word. Windows are judged on the input.
    Returns id_column, n_words, n_removed, kept_text (kept words joined by one space), spans (removed word ranges,
    end exclusive: the maximal exact repeats). Null or empty text: no words, kept_text empty. A null id counts as
    smaller than all others. Different texts under one id, null or not, are different documents, none earlier than the
    other; equal rows (id and text) come back alike. A very long text is one slice of its task, 40 bytes a word while
    it is read. An empty table gives an empty result; other columns are left out.
    """
    block, buckets = window // 2, partitions_for(docs, 48 << 20)
    homes = buckets
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = texts.select(F.xxhash64(F.coalesce("id", F.lit(packed.NULL_ID)), F.coalesce("text", F.lit(""))).alias("key"), "id", "text")
    homed = texts.select(home_of(F.col("key"), homes).alias("home"), "key", "id", "text")
    probes = texts.select("key", "text").mapInArrow(_probes(buckets, homes, block), packed.schema("bucket", 1))
    hits = probes.groupBy("bucket").applyInArrow(_hits(homes, block), packed.schema("home", 0))
    found = homed.groupBy("home").cogroup(hits.groupBy("home")).applyInArrow(_candidates(buckets, homes, window, block), packed.schema("bucket", 3))
    repeats = found.groupBy("bucket").applyInArrow(_repeats(homes), packed.schema("home", 0))
    out = homed.groupBy("home").cogroup(repeats.groupBy("home")).applyInArrow(_removed(window), "id long, n_words long, n_removed long, kept_text string, spans array<struct<from: long, to: long>>")
    return out.withColumnRenamed("id", id_column)
