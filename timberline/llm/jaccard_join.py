"""Similarity join on sets of word n-grams by chosen paths.

Sets become signatures of `SIZE` min-hashes; position i and its value are the tokens on which sets are split, shared by
two sets with a chance equal to their Jaccard similarity. A run starts with one or two positions: sets with equal
values there share a bucket. A bucket of more than `small` sets is split again on positions that a hash of its path
picks, each with chance 1 / (threshold * SIZE), up to `depth` times; smaller ones are compared by brute force. Two sets
at the threshold meet in a run with at least the chance of a critical branching process to live so long, and runs are
repeated until the chance to meet in any is the target recall; all but large buckets stop after one step.

Copies (equal word sequences) count as one set. Pairs whose signatures agree enough connect; in each connected group
the n-gram sets themselves are compared, all against all with integers, in blocks where a group is large. Groups come
as star edges and counts, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .components import components
from .shared import written
from .wordhash import U, Words, _splitmix, mix, pieces, windows

SIZE = 64
_FACTORS = _splitmix(23, SIZE) | U(1)
#: Sets of a group that one task compares with each other; a larger group is cut into blocks of about so many.
BLOCK = 1500


def runs_for(recall: float, threshold: float, depth: int, size: int = SIZE) -> int:
    """Runs until two sets at the threshold share a bucket of the last depth with that chance."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - p / size) ** size
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _roots(runs: int, threshold: float) -> list[tuple[int, int]]:
    """(run, position): 1 / threshold positions to a run on average, none twice while there are others."""
    order, out, due = np.argsort(_splitmix(31, SIZE)), [], 0.0
    for run in range(runs):
        due += 1 / threshold
        while due >= 1:
            out.append((run, int(order[len(out) % SIZE])))
            due -= 1
    return out


def _ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of each text (with repeats), and len + 1 offsets. 1 to n - 1 words are one n-gram."""
    hashes, counts = words.hashes(), words.counts
    own = windows(hashes, n)
    at = np.where((counts > 0) & (counts < n), 1, np.maximum(counts - n + 1, 0))
    first = np.r_[0, np.cumsum(at)]
    take = np.arange(first[-1]) - np.repeat(first[:-1], at) + np.repeat(words.first[:-1], at)
    out = own[take] if len(take) else np.zeros(0, U)
    for k in range(1, n):
        d = np.flatnonzero(counts == k)
        if len(d):
            out[first[d]] = windows(hashes, k)[words.first[d]] ^ U(k)
    return out, first


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in pieces(batch.column(2), 1_000_000):
                grams, first = _ngrams(words, n)
                full = np.flatnonzero(np.diff(first))
                sig = np.zeros((b - a, SIZE), np.uint32)
                if len(full):
                    for j in range(SIZE):
                        sig[full, j] = np.minimum.reduceat(((grams * _FACTORS[j]) >> U(32)).astype(np.uint32), first[full])
                has = np.diff(first) > 0
                k1, k2 = words.keys()
                signature = pa.array([x.tobytes() if h else None for x, h in zip(sig, has, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(k1), pa.array(k2), signature], ["id", "content", "k1", "k2", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def _path(path: np.ndarray, i: int, values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(path ^ mix(values.astype(U) + U(i + 1) * U(0x9E3779B97F4A7C15)))


def _start(roots: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(1))
            for r, i in roots:
                yield pa.RecordBatch.from_arrays([pa.array(_path(U(r + 1), i, sig[:, i]).view(np.int64)), batch.column(0)], ["path", "rep"])

    return run


def _with_paths(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """rep, the paths of its rows, sig: a row for each set, however many paths it is on. A set meets its signature once
    instead of once for each path."""
    return rows.groupBy("rep").agg(F.collect_set("path").alias("paths")).join(signatures, "rep").select("rep", "paths", "sig")


def _split(threshold: float):
    bound, picks = U(int(2**64 / (threshold * SIZE))), _splitmix(41, SIZE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, reps, sig = batch.column(1).flatten().to_numpy().view(U), batch.column(0).to_numpy(), _matrix(batch.column(2))
            row = np.repeat(np.arange(len(reps)), batch.column(1).value_lengths().to_numpy())
            for i in range(SIZE):
                at = np.flatnonzero(mix(path ^ picks[i]) < bound)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(_path(path[at], i, sig[row[at], i]).view(np.int64)), pa.array(reps[row[at]])], ["path", "rep"])

    return run


def _connected(same, n: int) -> np.ndarray:
    """For n things, the first one that each is connected with; same(i, others): which of the others are like i.
    Each is compared with those not reached yet, so that a close group of any size costs little."""
    root, left = np.full(n, -1), np.arange(n)
    while len(left):
        start, left = left[0], left[1:]
        root[start], todo = start, [start]
        while todo and len(left):
            like = same(todo.pop(), left)
            root[left[like]] = start
            todo += left[like].tolist()
            left = left[~like]
    return root


def _alike(least: int):
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        reps, sig = bucket.column("rep").to_numpy(), _matrix(bucket.column("sig"))
        order = np.argsort(reps)
        reps, sig = reps[order], sig[order]
        root = _connected(lambda i, others: (sig[others] == sig[i]).sum(1) >= least, len(reps))
        far = root != np.arange(len(reps))
        return pa.table({"a": reps[far], "b": reps[root[far]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _shared(lists: list[np.ndarray], n: int):
    """count(i): for each of n things, how many values its list shares with list i."""
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], owner[order]
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    ends, known = np.r_[heads[1:], len(values)], values[heads] if len(values) else values

    def count(i: int) -> np.ndarray:
        at = np.searchsorted(known, lists[i])
        met = [owner[heads[k] : ends[k]] for k in at]
        return np.bincount(np.concatenate(met), minlength=n) if met else np.zeros(n, np.int64)

    return count


def _similar(sets: list[np.ndarray], threshold: float):
    """like(i): which sets have at least that similarity with set i. Values that most sets hold are counted by the few
    that lack them."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    values, held = np.unique(np.concatenate(sets), return_counts=True)
    core = values[2 * held > n]
    some = values[(held > 1) & (2 * held <= n)]
    lack = [np.setdiff1d(core, x, assume_unique=True) for x in sets]
    lacking = np.array([len(x) for x in lack])
    lacks, more = _shared(lack, n), _shared([np.intersect1d(x, some, assume_unique=True) for x in sets], n)

    def like(i: int) -> np.ndarray:
        shared = len(core) - lacking[i] - lacking + lacks(i) + more(i)
        out = (1 + threshold) * shared >= threshold * (sizes[i] + sizes) - 1e-9
        out[i] = False
        return out

    return like


def _verified(n: int, threshold: float):
    to = pa.schema([("rep", pa.int64()), ("near", pa.int64()), ("linked", pa.int64()), ("others", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        reps, first = np.unique(group.column("rep").to_numpy(), return_index=True)  # a repeated row stands once
        group = group.take(pa.array(first))
        copies, block = group.column("copies").to_numpy(), group.column("block").to_numpy()
        sets = []
        for _, _, words in pieces(group.column("text"), 1_000_000):
            grams, at = _ngrams(words, n)
            sets += [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        # in a task of two blocks only links across them count: those within a block have a task of their own
        across = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        similar = _similar(sets, threshold)
        linked, others = np.zeros(len(reps), np.int64), np.zeros(len(reps), np.int64)
        parent = np.arange(len(reps))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(len(reps)):
            like = similar(i) & (block != block[i]) if across else similar(i)
            linked[i], others[i] = like.sum(), copies[like].sum()
            before = np.flatnonzero(like[:i])
            for root in np.unique(parent[before]):
                a, b = top(i), top(int(root))
                parent[max(a, b)] = min(a, b)
        near = np.array([top(i) for i in range(len(reps))], np.int64)
        return pa.table({"rep": reps, "near": reps[near], "linked": linked, "others": others}, schema=to)

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, n: int = 5, recall: float = 0.999, small: int = 100, depth: int = 3) -> DataFrame:
    """One row for each row of docs: id_column, class_id (the least id of those connected by links of at least the
    threshold, copies included), n_links (other documents so similar, copies included), n_linked_texts (different
    texts among them).

    Null and empty texts are copies of each other and like nothing else; texts of fewer than n words are one n-gram.
    A null id counts as the least id and stays null. Different texts under one id, null or not, are documents of their
    own. An empty table gives an empty result; other columns are left out.
    """
    found = _classes(docs, id_column, text_column, threshold, n, recall, small, depth)
    real = lambda c: F.when(F.col(c) != packed.NULL_ID, F.col(c))
    return found.select(real("id").alias(id_column), real("class_id").alias("class_id"), "n_links", "n_linked_texts")


def _keys(docs: DataFrame, id_column: str, text_column: str) -> tuple:
    """What names a document: its id (null: NULL_ID) and a hash of its text."""
    return F.coalesce(docs[id_column].cast("long"), F.lit(packed.NULL_ID)), F.xxhash64(F.coalesce(docs[text_column].cast("string"), F.lit("")))


def _classes(docs: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, n: int = 5, recall: float = 0.999, small: int = 100, depth: int = 3) -> DataFrame:
    """id, content, class (a number of its own for each class), class_id, n_links and n_linked_texts of each row."""
    own_id, content = _keys(docs, id_column, text_column)
    texts = docs.select(own_id.alias("id"), content.alias("content"), F.col(text_column).cast("string").alias("text"))
    signed = written(texts.mapInArrow(_signed(n), "id long, content long, k1 long, k2 long, sig binary"), "signatures")
    # a set goes by the hash of one of its texts, that of the least id
    least_row = F.min(F.struct("id", "content"))
    sets = signed.groupBy("k1", "k2").agg(least_row.alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = written(sets.select("k1", "k2", F.col("least")["content"].alias("rep"), F.col("least")["id"].alias("rep_id"), "copies", "sig"), "sets")
    signatures = sets.filter("sig IS NOT NULL").select("rep", "sig")
    rows = signatures.mapInArrow(_start(_roots(runs_for(recall, threshold, depth), threshold)), "path long, rep long")
    buckets = []
    for level in range(1, depth + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("held"), F.bit_xor(F.xxhash64("rep")).alias("members")).filter("held > 1")
        held = written(rows.join(sizes, "path"), "paths")
        buckets.append(held if level == depth else held.filter(F.col("held") <= small))
        if level < depth:
            # written, as their counts and they themselves are read: else large buckets are split twice
            rows = written(_with_paths(held.filter(F.col("held") > small), signatures).mapInArrow(_split(threshold), "path long, rep long"), "split")
    every = buckets[0]
    for more in buckets[1:]:
        every = every.union(more)
    # the same sets meet in many runs: one bucket of them is enough
    once = every.groupBy("held", "members").agg(F.min("path").alias("path")).select("path")
    least = math.ceil(SIZE * (threshold - 3.3 * math.sqrt(threshold * (1 - threshold) / SIZE)))
    compared = _with_paths(every.join(once, "path", "left_semi"), signatures).select(F.explode("paths").alias("path"), "rep", "sig")
    groups = written(components(compared.groupBy("path").applyInArrow(_alike(least), "a long, b long")), "groups")

    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    member = groups.join(sizes, "root").join(sets.select(F.col("rep").alias("node"), "rep_id", "copies"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    member = member.select("root", F.col("node").alias("rep"), "rep_id", "copies", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    member = member.select("root", "rep", "rep_id", "copies", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    checked = member.join(texts.select(F.col("id").alias("rep_id"), F.col("content").alias("rep"), "text"), ["rep_id", "rep"]).groupBy("root", "x", "y").applyInArrow(_verified(n, threshold), "rep long, near long, linked long, others long")
    checked = written(checked, "checked")
    totals = checked.groupBy("rep").agg(F.sum("linked").alias("linked"), F.sum("others").alias("others"))
    classes = components(checked.select(F.col("rep").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "rep")
    least_ids = classes.join(sets.select("rep", "rep_id"), "rep").groupBy("root").agg(F.min("rep_id").alias("class_id"))
    found = sets.join(totals, "rep", "left").join(classes.join(least_ids, "root"), "rep", "left")
    zero = F.lit(0).cast("long")
    found = found.select("k1", "k2", F.coalesce("root", "rep").alias("class"), F.coalesce("class_id", "rep_id").alias("class_id"), (F.coalesce("others", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("linked", zero).alias("n_linked_texts"))
    return signed.select("id", "content", "k1", "k2").join(found, ["k1", "k2"]).drop("k1", "k2")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Of each class of near duplicates, the row of the least id (of its texts under that id, one), with all columns; of
    repeated rows, one."""
    least = _classes(docs, id_column, text_column, **options).groupBy("class").agg(F.min(F.struct("id", "content")).alias("least"))
    good = least.select(F.col("least")["id"].alias("good_id"), F.col("least")["content"].alias("good_content"))
    own_id, content = _keys(docs, id_column, text_column)
    rows = docs.select(*docs.columns, own_id.alias("own id"), content.alias("own content"))
    kept = rows.join(good, (F.col("own id") == F.col("good_id")) & (F.col("own content") == F.col("good_content")), "left_semi")
    return kept.dropDuplicates(["own id", "own content"]).drop("own id", "own content")
