"""Token ids in Parquet files: a list column in ascending order of documents.

Ids are dictionary encoded where a row group's dictionary stays small and delta encoded (format version 2) otherwise;
positions are delta encoded. Row groups and pages have set sizes, and the writer adds page indexes; as each file is
sorted by document id, a reader that wants some documents or only the metadata columns reads few pages.
Spark's writer commits the files, so a task that is lost and run again leaves no halves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions_for
from .tokens import encoded, vocabulary

FILE_SCHEMA = "part int, id long, start_in_part long, n_tokens long, ids array<int>"


def write_options(row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> dict[str, str]:
    return {
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "compression": "zstd",
    }


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, ids, ends in encoded(batch.column(1), path, end_id):
                n = np.diff(ends)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), batch.column(0).slice(a, b - a), pa.array(start + ends[:-1]), pa.array(n), lists], ["part", "id", "start_in_part", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, vocabulary_path: str | None = None, **sizes) -> None:
    """Encode every whole text (null: empty), add end_id, and write the ids in ascending order of id_column.

    Rows with the same id stand in the order of a hash of their texts, a null id first. An empty table writes files
    without rows. A text is encoded whole, and held whole while it is, however long. Other columns are left out.
    """
    text = F.col(text_column).cast("string")
    # Ranges of id, hash and input partition: an id in a third of the rows is dealt to many partitions by its texts, and
    # equal texts by where they come from. Sorting compares these numbers, never texts.
    keys = [F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.spark_partition_id().alias("from")]
    texts = docs.select(*keys, text.alias("text"))
    ordered = texts.repartitionByRange(partitions_for(docs), "id", "h", "from").sortWithinPartitions("id", "h", "from").select("id", "text")
    ordered.mapInArrow(_encode(vocabulary_path or vocabulary(), end_id), FILE_SCHEMA).write.options(**write_options(**sizes)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids. Only the columns asked for are read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each written partition: small by construction
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("part", before.alias("before")))
    return rows.join(starts, "part").select("id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame, ids_column: str = "ids") -> DataFrame:
    """The rows with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) instead of the ids."""
    others = [c for c in rows.columns if c != ids_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(others))
            where, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], crc], [*others, "ids_crc32"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    return rows.select(*others, ids_column).mapInArrow(run, f"{fields}, ids_crc32 long")
