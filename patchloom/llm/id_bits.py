"""Bitmaps of hashed ids, of one size whatever the tables: which rows of a table of texts may have an id, told where the rows lie, so no text moves to be tested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import keep

#: Bits of a map of ids, and of a page of it.
ID_BITS, PAGE = 1 << 26, 1 << 15


def place() -> Column:
    """struct<page, bit> of a row's doc_id."""
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    return F.struct(F.floor(hashed / PAGE).cast("int").alias("page"), (hashed % PAGE).cast("int").alias("bit"))


def is_set(bits: str, at: str) -> Column:
    """Whether the column ``bits``, a page's map, has the bit of the place ``at``."""
    return F.expr(f"shiftright(cast(conv(hex(substring({bits}, {at}.bit div 8 + 1, 1)), 16, 10) AS int), {at}.bit % 8) & 1 = 1")


def maybe(docs: DataFrame, ids: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """``docs`` with a boolean column for each of ``kinds`` (of a doc_id in ``ids``): false says that the row's id is surely of none that are so.

    All maps go to all executors together, 8 MB each.
    """
    free = "_" * max(len(c) for c in [*docs.columns, *kinds])  # longer than any name that is there
    at, page = f"{free}p", f"{free}g"
    rows = ids.select(place().alias("p"), *[k.alias(n) for n, k in kinds.items()])
    maps = [F.bitmap_construct_agg(F.when(F.col(n), F.col("p.bit"))).alias(f"{free}{k}") for k, n in enumerate(kinds)]
    pages = keep(rows.groupBy(F.col("p.page").alias(page)).agg(*maps), "bitmap")  # ID_BITS / PAGE rows at most
    near = docs.withColumn(at, place()).withColumn(page, F.col(f"{at}.page")).join(F.broadcast(pages), page, "left")
    return near.select(*[docs[c] for c in docs.columns], *[F.coalesce(is_set(f"{free}{k}", at), F.lit(False)).alias(n) for k, n in enumerate(kinds)])
