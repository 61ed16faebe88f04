"""Helpers that the corpus operators share: tables, written intermediate results, grouped Arrow streams."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from patchloom.shared import keep, new_path, remove, shared_dir, write_bytes
from patchloom.shipping import ship

__all__ = ["ARROW_ROWS", "keep", "load", "map_arrow", "new_path", "remove", "shared_dir", "ship", "star_edges", "whole_groups", "write_bytes"]

#: Rows and bytes that a function gets at once. Texts can be long, and what Python makes of them needs more memory than their Arrow batch.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows and about ARROW_BYTES.

    The session's bound on the bytes of an Arrow batch is lowered to ARROW_BYTES where it is higher, always to the same value, so frames
    that run later keep it; no other setting is touched.
    """
    conf = df.sparkSession.conf
    if int(re.sub("[^0-9].*", "", conf.get(_BATCH_BYTES)) or 0) > ARROW_BYTES:
        conf.set(_BATCH_BYTES, str(ARROW_BYTES))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(itertools.chain.from_iterable(map(sliced, batches)))

    def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        each = max(1, min(rows, int(batch.num_rows * ARROW_BYTES / max(1, batch.nbytes))))
        for at in range(0, max(1, batch.num_rows), each):
            yield batch.slice(at, each)

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Batches sorted by integer ``keys`` become tables of whole groups: (columns, start of each group and the end).

    A group that a batch cuts is carried over to the next one, so memory holds one batch and one group.
    """
    rest: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
        elif rest is None:
            return
        else:
            table = rest
        ids = [table[k].to_numpy() for k in keys]
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for k in ids:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        if batch is not None:
            cut = int(starts[-1])
            rest = table.slice(cut)
            table, starts = table.slice(0, cut), starts[:-1]
            if not cut:
                continue
        yield {n: table[n].to_numpy(zero_copy_only=False) if not pa.types.is_binary(table[n].type) else table[n] for n in table.column_names}, np.append(starts, table.num_rows)
        if batch is None:
            return


def star_edges(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least member that each member reaches: a spanning star instead of all pairs."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new
