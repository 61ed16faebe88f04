"""Operator 8, near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

A vector's sketch is its signs against 256 random hyperplanes; two vectors at angle a differ in each sign with probability a / pi. A table's
key is a block of these bits. The bits of a block grow with the logarithm of the number of vectors, so that buckets hold about ``CROWD`` of them, and
the number of tables is what finds a pair at the very bound with probability ``RECALL`` (a closer pair is found almost surely). Equal
vectors are one row with a weight before any table. Sketches alone go to the tables: what is left there are vectors with a partner whose
sketch differs in at most ``DIFFER`` bits (a pair at the bound stays with probability 0.99999), and only those are fetched for the exact
cosine. A pair that shares several tables counts in the first of them only, so links are counted exactly once without gathering
pairs. Buckets over ``BUCKET`` rows are cut into chunks and each pair of chunks is a group of its own; a group emits sums for each vector
and a spanning star, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import keep, load, map_arrow, star_edges, whole_groups
from patchloom.llm.components import connected_components
from patchloom.llm.sign_blocks import BITS, blocks_for, groups

COSINE, RECALL, CROWD, BUCKET, SEED = 0.95, 0.999, 48, 512, 5
TABLES_AT_MOST = 96
#: Standard deviations over the mean number of differing signs that a pair at the bound may have.
DEVIATIONS = 4.6


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, tables) for n distinct vectors."""
    return blocks_for(n, math.acos(cosine) / math.pi, CROWD, recall, TABLES_AT_MOST)


def differ_at_most(cosine: float) -> int:
    """Bits in which the sketches of a pair at the bound differ, at most but for a chance of 1e-5."""
    share = math.acos(cosine) / math.pi
    return math.ceil(BITS * share + DEVIATIONS * math.sqrt(BITS * share * (1 - share)))


def hyperplanes(dim: int) -> np.ndarray:
    """Normal vectors: (dim, BITS), the same for the same arguments."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, BITS))


def usable(embedding: str = "embedding") -> F.Column:
    """Not null, not empty, every component a finite number, and not all of them zero."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector").to_pylist()
        dims = np.array([len(v) for v in vectors], dtype=np.int64)
        signs = np.empty((len(vectors), BITS // 8), dtype=np.uint8)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.array([vectors[i] for i in at], dtype=np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in sums
            signs[at] = np.packbits(x @ hyperplanes(int(dim)) > 0, axis=1)
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in batch.schema.names], pa.array([s.tobytes() for s in signs], type=pa.binary())], [*batch.schema.names, "sketch"])


def _slots(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("sketch")
            keys = groups(_matrix(raw.to_pylist()), bits, tables)
            where = np.repeat(np.arange(batch.num_rows), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("rep").take(pa.array(where)), raw.take(pa.array(where))], ["g", "rep", "sketch"])

    return run


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, BITS // 8)


def _first(keys: np.ndarray, g: int, bits: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether each pair shares no table before that of group g."""
    t = g >> bits
    return (keys[p, :t] != keys[q, :t]).all(axis=1)


def _survivors(bits: int, tables: int, differ: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in whole_groups(batches, ("g", "i", "j")):
            left = []
            for s in np.flatnonzero(np.diff(starts) > 1):
                a, b = int(starts[s]), int(starts[s + 1])
                raw = _matrix(cols["sketch"].slice(a, b - a).to_pylist())
                words = raw.view(np.uint64)
                apart = np.zeros((b - a, b - a), dtype=np.int16)
                for w in words.T:
                    apart += np.bitwise_count(w[:, None] ^ w[None, :])
                close = np.triu(apart <= differ, 1)
                if cols["i"][a] != cols["j"][a]:  # two chunks of one bucket: pairs within a chunk are another group's
                    close &= cols["own"][a:b][:, None] != cols["own"][a:b][None, :]
                p, q = np.nonzero(close)
                if len(p):
                    first = _first(groups(raw, bits, tables), int(cols["g"][a]), bits, p, q)
                    left.append(a + np.unique(np.concatenate([p[first], q[first]])))
            at = np.concatenate(left) if left else []
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(cols[n][at]) for n in ("g", "i", "j", "own", "rep")], ["g", "i", "j", "own", "rep"])

    return run


def _linked(cosine: float, bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in whole_groups(batches, ("g", "i", "j")):
            rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s in np.flatnonzero(np.diff(starts) > 1):
                a, b = int(starts[s]), int(starts[s + 1])
                keys = groups(_matrix(cols["sketch"].slice(a, b - a).to_pylist()), bits, tables)
                vectors, weight, rep, own = cols["vector"][a:b], cols["weight"][a:b], cols["rep"][a:b], cols["own"][a:b]
                dims = np.array([len(v) for v in vectors])
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    if len(at) < 2:
                        continue
                    x = np.stack(vectors[at]).astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in squares
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    close = x @ x.T >= cosine
                    np.fill_diagonal(close, False)
                    if cols["i"][a] != cols["j"][a]:
                        close &= own[at][:, None] != own[at][None, :]
                    p, q = np.nonzero(close)
                    first = _first(keys[at], int(cols["g"][a]), bits, p, q)
                    p, q = p[first], q[first]
                    if not len(p):
                        continue
                    links = np.zeros(len(at), dtype=np.int64)
                    np.add.at(links, p, weight[at][q])
                    exact = np.eye(len(at), dtype=bool)
                    exact[p, q] = True
                    label = star_edges(exact)
                    has = np.flatnonzero(links)
                    rows.append((rep[at][has], rep[at][label[has]], links[has]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["src", "dst", "links"])

    return run


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(rep long, vector array<double>, weight long), vectors distinct, to (src, dst, links): links are to be added up by src; src and dst share a component."""
    bits, tables = tables_for(classes.count(), cosine)
    whole = keep(map_arrow(classes, _sketched, f"{', '.join(f'{n} {t}' for n, t in classes.dtypes)}, sketch binary", 2048), "sketches")
    slots = map_arrow(whole.select("rep", "sketch"), _slots(bits, tables), "g long, rep long, sketch binary", 2048)
    large = slots.groupBy("g").count().where(F.col("count") > BUCKET)
    large = keep(large.select("g", F.ceil(F.col("count") / BUCKET).cast("int").alias("chunks")), "buckets")
    zero = F.lit(0).cast("int")
    if large.isEmpty():
        rows = slots.select("g", zero.alias("i"), zero.alias("j"), zero.alias("own"), "rep", "sketch")
    else:
        rows = slots.join(large, "g", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.select("*", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("own"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("other"))
        rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "sketch")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "rep")

    left = keep(map_arrow(dealt(rows), _survivors(bits, tables, differ_at_most(cosine)), "g long, i int, j int, own int, rep long", 8192), "survivors")
    found = left.join(whole, "rep").select("g", "i", "j", "own", "rep", "weight", "vector", "sketch")
    return map_arrow(dealt(found), _linked(cosine, bits, tables), "src long, dst long, links long", 1024)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links, itself included), kept.

    Vectors of different lengths never link. Vectors that are null, empty, zero or hold null or non-finite components link with nothing
    and are their own component. Repeated rows and ids are vectors of their own; a row with a null vec_id is returned with its links counted
    and the smallest id of its component (null if there is none). Other columns are ignored; an empty table gives no rows.
    """
    element = vectors.schema["embedding"].dataType.elementType  # cosines are taken in double precision whatever it is
    rows = vectors.select("vec_id", F.when(usable(), F.transform("embedding", lambda v: v + F.lit(0).cast(element))).alias("vector"))  # -0.0 becomes 0.0
    hashed = F.array_join(F.transform("vector", lambda v: F.hex(F.xxhash64(v.cast("double")))), ",")
    rows = rows.withColumn("digest", F.when(F.col("vector").isNotNull(), F.sha2(hashed, 256)))
    # Equal vectors have an equal digest; a shared one joins vectors that are equal in all components, as hashing a double is one to one.
    rows = keep(rows.select("vec_id", "digest", "vector"), "vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # ids may repeat, so classes have numbers of their own
    found = keep(links(classes.select(F.col("node").alias("rep"), "weight", "vector"), cosine), "links")
    sums = found.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("src", "dst"))
    classes = classes.select("digest", "rep", "weight", "node").join(sums, "node", "left").join(parts, "node", "left")
    classes = classes.select("digest", "rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part"))
    least = classes.groupBy("part").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "part").select("digest", "n_links", "component_id")
    out = rows.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_duplicates(load(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.z) = len(b.z) AND list_inner_product(a.z, b.z) / sqrt(list_inner_product(a.z, a.z)) / sqrt(list_inner_product(b.z, b.z)) >= {COSINE}
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), parts AS (
  SELECT a, least(a, min(b)) AS part FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(part, e.vec_id) AS component_id, e.vec_id = coalesce(part, e.vec_id) AS kept
FROM embeddings e LEFT JOIN parts p ON p.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
