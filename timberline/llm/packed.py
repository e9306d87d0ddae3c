"""Many (id, position, values) entries in one shuffled row for each bucket: a few bytes an entry instead of a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .wordhash import planes, unplanes

#: Stands for a null id: it sorts before every other.
NULL_ID = np.iinfo(np.int64).min


def schema(bucket: str, values: int) -> str:
    return ", ".join([f"{bucket} int", "kind int", "ids binary", "runs binary", "pos binary", *(f"v{i} binary" for i in range(values))])


def arrow_schema(bucket: str, values: int) -> pa.Schema:
    names = ["ids", "runs", "pos", *(f"v{i}" for i in range(values))]
    return pa.schema([(bucket, pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in names)])


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ids_to_arrow(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NULL_ID)


def pack(name: str, bucket: np.ndarray, ids: np.ndarray, pos: np.ndarray, values: list[np.ndarray], kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Entries ascending by (id, pos) within equal buckets give the fewest bytes; any order works."""
    to = arrow_schema(name, len(values))
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, ids, pos, values = bucket[order], ids[order], pos[order].astype(np.int64), [v[order] for v in values]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows: list[tuple] = []
    for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
        heads = np.flatnonzero(np.r_[True, ids[a + 1 : b] != ids[a : b - 1]])
        step = np.diff(pos[a:b], prepend=0)
        step[heads] = pos[a:b][heads]
        rows.append((int(bucket[a]), kind, planes(ids[a:b][heads]), planes(np.diff(np.r_[heads, b - a]).astype(np.uint32)), planes(step.astype(np.int32)), *(planes(v[a:b]) for v in values)))
        if len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), to.types, strict=True)], schema=to)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), to.types, strict=True)], schema=to)


def unpack(table: pa.Table | pa.RecordBatch, kinds: tuple[type, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """ids, positions, values and the number of the row that each entry came from."""
    ids, pos, rows, values = [], [], [], [[] for _ in kinds]
    columns = [table.column(n).to_pylist() for n in ("ids", "runs", "pos", *(f"v{i}" for i in range(len(kinds))))]
    for k, (i, r, p, *more) in enumerate(zip(*columns, strict=True)):
        runs = unplanes(r, np.uint32).astype(np.int64)
        at = np.cumsum(unplanes(p, np.int32).astype(np.int64))
        heads = np.cumsum(runs) - runs
        at -= np.repeat(np.r_[0, at[heads[1:] - 1]] if len(heads) else at[:0], runs)
        ids.append(np.repeat(unplanes(i, np.int64), runs))
        pos.append(at)
        rows.append(np.full(len(at), k, np.int64))
        for out, v, kind in zip(values, more, kinds, strict=True):
            out.append(unplanes(v, kind))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(ids, np.int64), join(pos, np.int64), [join(v, k) for v, k in zip(values, kinds, strict=True)], join(rows, np.int64)
