"""Operator 1, SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

With b blocks, two fingerprints that differ in at most d bits agree in at least b - d whole blocks, so for each choice of b - d blocks
one table keyed by these bits brings every such pair together at least once. b follows the number of distinct fingerprints, so that a
bucket holds few rows at any size; each b gives the same links. Equal fingerprints are one row before any join. Buckets over
``BUCKET`` rows (near copies of one text) are cut into chunks, and each pair of chunks is checked by its own task; of a bucket only
a spanning star of verified links is emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import keep, load, map_arrow, star_edges, whole_groups
from patchloom.llm.components import connected_components
from patchloom.llm.id_bits import maybe
from patchloom.shared import merged_join

DISTANCE, SHINGLE, SEED = 4, 4, 42
BUCKET = 1024
#: Rows that share a bucket by chance, on average at most.
CROWD = 0.25


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of a whole text, in order; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8").lower().split()  # on bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a whole text; null, empty and blank texts give 0."""
    hashes = shingles(text, shingle)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a long text needs no more memory than a block of shingles
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    return map_arrow(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks, as signed longs, of every choice of blocks - distance blocks of 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    ones = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(x) for x in combinations(ones, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_blocks(n: int, distance: int, most: int = 9) -> int:
    """The fewest blocks with which n random fingerprints crowd a bucket by no more than CROWD rows."""
    for blocks in range(distance + 1, most):
        if n / 2 ** (64 * (blocks - distance) / blocks) <= CROWD:
            return blocks
    return most


def _verified(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in whole_groups(batches, ("t", "key", "i", "j")):
            fp, rep = cols["fp"].view(np.uint64), cols["rep"]
            src, dst = [], []
            sizes = np.diff(starts)
            few = np.repeat(sizes, sizes)
            group = np.repeat(np.arange(len(sizes)), sizes)
            for lag in range(1, 4):  # groups of up to four rows, all at once
                if len(fp) <= lag:
                    break
                a = np.flatnonzero((group[lag:] == group[:-lag]) & (few[lag:] <= 4))
                a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= distance]
                src.append(rep[a])
                dst.append(rep[a + lag])
            for g in np.flatnonzero(sizes > 4):
                f, r = fp[starts[g] : starts[g + 1]], rep[starts[g] : starts[g + 1]]
                label = star_edges(np.bitwise_count(f[:, None] ^ f[None, :]) <= distance)
                moved = np.flatnonzero(label != np.arange(len(f)))
                src.append(r[moved])
                dst.append(r[label[moved]])
            if src and any(map(len, src)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return run


def links(reps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(fp long, rep long), one row per fingerprint, to (src, dst): edges over rep with the components of all pairs within ``distance`` bits."""
    masks = block_masks(choose_blocks(reps.count(), distance), distance)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask")) for t, m in enumerate(masks)])).alias("x")
    rows = reps.select("fp", "rep", tables).select("fp", "rep", "x.t", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    sizes = rows.groupBy("t", "key").count().where(F.col("count") > 1)
    full = keep(sizes.select("t", "key", F.ceil(F.col("count") / bucket).cast("int").alias("chunks")), "buckets")
    rows = rows.join(full, ["t", "key"])
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("t", "key", "fp", "rep", own.alias("own"), other)
    rows = rows.select("t", "key", "fp", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return map_arrow(rows, _verified(distance), "src long, dst long", 8192)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fp long, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, itself included).

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows are each returned. A row whose doc_id is null is
    returned with the component of the documents that share its fingerprint (null if there are none). Extra columns are ignored; an
    empty table gives no rows.
    """
    prints = keep(fingerprints(docs), "fingerprints")
    reps = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")
    parts = connected_components(links(reps, distance))
    reps = reps.join(parts, reps["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(reps, "fp", "left")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents whose id is the smallest of their near-duplicate group, all columns kept; of repeated ids one row stays.

    Rows with a null doc_id can't be told apart and stay.
    """
    return leaders(docs, near_duplicates(docs.select("doc_id", "text"), distance))


def leaders(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that have the id of their group in (doc_id, component_id), or no id; of repeated ids one row stays."""
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("go"), F.count("*").alias("n"))
    ids = keep(ids, "leaders")
    free = "_" * max(map(len, docs.columns))  # longer than any name that is there
    go, stay, again = f"{free}g", f"{free}s", f"{free}n"
    # Bitmaps tell most rows' fate where they lie. Only texts of ids that may be of both kinds, or that may come again, move.
    rows = maybe(docs, ids, {go: F.col("go"), stay: ~F.col("go"), again: ~F.col("go") & (F.col("n") > 1)})
    known = F.col("doc_id").isNotNull()
    sure = rows.where(~known | ~F.col(go) & ~F.col(again)).select(*docs.columns)
    rest = rows.where(known & F.col(stay) & (F.col(go) | F.col(again))).select(*docs.columns)
    gone = ids.where("go").select(F.col("doc_id").alias(go))
    rest = merged_join(rest, gone, rest["doc_id"] == gone[go], "left_anti")
    if not ids.where("not go and n > 1").isEmpty():
        rest = rest.dropDuplicates(["doc_id"])
    return sure.unionByName(rest)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
