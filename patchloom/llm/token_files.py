"""Operator 2, token ids on disk: Parquet list columns with delta-encoded ids, small row groups and page indexes.

File format: rows (doc_id, n_tokens, ids) in ascending doc_id order, over files and within each. ids is a list of 32-bit integers without a
dictionary, so the writer's second version stores them delta-packed; doc_id and n_tokens lie in columns of their own, and the page
index that the writer adds has the bounds of doc_id for each page, so a range of documents or the lengths alone are read without
the ids of others. Documents go to the file of their id's range before they are encoded, which moves texts and not the larger ids. Files
hold about ``PER_FILE`` documents; in huge tables more, so that there are no more than ``FILES_AT_MOST`` files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.llm.common import load, map_arrow, new_path
from patchloom.llm.tokens import encoder, public_path

END = 0
#: Documents of a file, about; bytes of a row group and of a page.
PER_FILE, ROW_GROUP, PAGE = 8_192, 16 << 20, 1 << 16
FILES_AT_MOST = 100_000
FORMAT = {
    "compression": "lz4_raw",  # packed ids hardly shrink further: zstd makes files of the same size and takes longer
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": "512",
}
ENCODED = "doc_id long, n_tokens long, ids array<int>"


def by_range(docs: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(doc_id, text) with each range of ids in a partition of its own, sorted; equal ids share a range."""
    n = docs.count()
    files = max(1, round(n / max(per_file, n / FILES_AT_MOST)))
    return docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, ids), each document's ids with the end id; order stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), END.to_bytes(4, "little")
        for batch in batches:
            found = [enc.encode(t.as_py()) + end for t in batch.column("text")]
            sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
            values = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"])

    return map_arrow(docs, run, ENCODED)


def write(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Encode all documents and write them to the folder ``out``, one file for each range of ids.

    A null or empty text is its end id alone. Repeated rows are each written. Rows with a null doc_id come first. Long texts are encoded
    whole, extra columns are ignored, and an empty table gives a file without rows.
    """
    encoded(by_range(docs), path or public_path("byte_bpe_50k.json")).write.options(**FORMAT).parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The written rows; select doc_id and n_tokens alone and no ids are read."""
    return spark.read.schema(ENCODED).parquet(out)


def digests(spark: SparkSession, out: str) -> DataFrame:
    """One row per written document: doc_id, start, n_tokens, ids_crc32, all from the files.

    Each file's total comes from its lengths; totals are added up over files (one row a file), lengths within a file in order of its rows.
    """
    file, place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    own = read(spark, out).select("doc_id", "n_tokens", "ids", file, place)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.flatten().to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("doc_id", "n_tokens", "file", "row")], pa.array(sums, type=pa.int64())], ["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    rows = map_arrow(own, crc, "doc_id long, n_tokens long, file string, row long, ids_crc32 long")
    totals = read(spark, out).select("doc_id", "n_tokens", file).groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"))
    before = Window.orderBy(F.col("low").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, "file")
    return rows.select("doc_id", (F.col("start") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files, and what is read back from them."""
    out = new_path(spark, "token-files")
    write(load(spark, sf_dir, "documents"), out)
    return digests(spark, out)
