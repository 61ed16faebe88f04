"""Operator 9, exact top-k by columnar branch and bound.

Candidates lie in vertical layout: one array for each block of dimensions. The partial inner products of a block of queries with
all candidates of a batch are accumulated block of dimensions by block; what the rest of a vector can still add is at most the
product of the remaining norms (Cauchy-Schwarz), so candidates that cannot reach a query's k-th best score are dropped and the survivors
compacted before the next block. Bounds only decide what is dropped, and they are rounded up; scores are exact integers.

All queries are searched in one job, however many there are. Candidates are dealt into stores of at most ``STORE`` rows, and each store gets all
queries, a batch at a time; of the two sides the queries are the twentieth part, so they are the ones that are copied. A store answers
a block with at most k rows a query. Before that, the k-th best score among a sample of ``SAMPLE`` candidates is each query's first bound, so
a store answers with nothing that can't be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.llm.common import keep, load, map_arrow

K, EVERY, SCALE, QUERIES, BATCH = 20, 20, 64, 1024, 4096
#: Rows of a store at most, rows that a store should have at least, and candidates that give first bounds.
STORE, SMALL, SAMPLE = 1 << 17, 1 << 11, 4096
#: Stands for a null id: the last in order.
NO_ID = np.iinfo(np.int64).max
#: Dimensions of a block, queries that are searched at once, and the share of candidates left at which a list replaces the table of all.
BLOCK, SLICE, FEW = 16, 256, 0.1
#: Bounds are lowered by this against rounding; scores are integers.
SLACK = 1e-3
#: Inner products up to here are exact in double arithmetic.
EXACT = float(1 << 53)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, x array<long>), row being a number of its own for each row: floor(scale * component) of every vector that is not null and holds neither null nor non-finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    fit = F.coalesce(x.isNotNull() & finite, F.lit(False))
    return vectors.where(fit).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def _remaining(x: np.ndarray) -> list[np.ndarray]:
    """For each block of dimensions, the norm of what comes after it."""
    left = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return [np.sqrt(left[:, a]) if a < x.shape[1] else np.zeros(len(x)) for a in range(BLOCK, x.shape[1] + BLOCK, BLOCK)]


class Block:
    """A block of queries of one length, with the k best scores found so far; ``floor`` is what a score must reach."""

    def __init__(self, numbers: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.numbers, self.x, self.k = numbers, x, k
        self.score = np.full((len(x), k), -np.inf)
        self.found = np.full((len(x), k), NO_ID)
        self.parts = [x[:, a : a + BLOCK] for a in range(0, x.shape[1], BLOCK)]
        self.rest = _remaining(x)
        self.floor = np.full(len(x), -np.inf) if floor is None else floor

    def search(self, batch: Batch) -> None:
        """Take in a batch of candidates."""
        columns, rest = batch.columns, batch.rest
        for a in range(0, len(self.x), SLICE):  # partial sums of a slice of queries with the whole batch
            rows = np.arange(a, min(a + SLICE, len(self.x)))
            need = np.maximum(self.score[rows, -1], self.floor[rows]) - SLACK
            total, sparse = np.zeros((len(rows), len(batch.ids))), False
            q = c = np.empty(0, dtype=np.int64)
            for k, column in enumerate(columns):
                if sparse:
                    total = total + np.einsum("ij,ij->i", self.parts[k][rows[q]], column.T[c])
                    alive = total + self.rest[k][rows[q]] * rest[k][c] >= need[q]
                    q, c, total = q[alive], c[alive], total[alive]
                    continue
                total += self.parts[k][rows] @ column
                alive = total + np.outer(self.rest[k][rows], rest[k]) >= need[:, None]
                if k == len(columns) - 1 or np.count_nonzero(alive) < FEW * alive.size:  # compact what is left
                    q, c = np.nonzero(alive)
                    total, sparse = total[q, c], True
            if not columns:
                q, c = (x.ravel() for x in np.indices(total.shape))
                total = np.zeros(len(q))
            other = batch.numbers[c] != self.numbers[rows[q]]
            self._merge(rows[q][other], batch.ids[c][other], total[other])

    def _merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Keep the k best of each query, ties to the smaller id."""
        if not len(q):
            return
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([ids, self.found[touched].ravel()])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, touched)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = rank < self.k
        self.score[q[top], rank[top]] = score[top]
        self.found[q[top], rank[top]] = ids[top]

    def bounds(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity if there are fewer."""
        return self.score[:, -1]


class Batch:
    """Candidates of one length in vertical layout: an array for each block of dimensions, and what can still come after it."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.numbers, self.ids, self.dim = numbers, ids, x.shape[1]
        self.columns = [np.ascontiguousarray(x[:, a : a + BLOCK].T) for a in range(0, x.shape[1], BLOCK)]
        self.rest = _remaining(x)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, their vectors as doubles) for each length of a batch's vectors."""
    vectors = batch.column("x")
    sizes = np.diff(vectors.offsets.to_numpy())
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), int(dim))


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("row").to_numpy(), pc.fill_null(batch.column("vec_id"), NO_ID).to_numpy()


def _floored(sample, k: int):
    """Adds ``floor`` to queries: the k-th best score in the sample, null if it has fewer candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {x.shape[1]: Batch(rows, np.zeros(len(rows), dtype=np.int64), x) for rows, x in sample.value}
        for batch in batches:
            floor = np.full(batch.num_rows, -np.inf)
            for at, x in _by_length(batch):
                if x.shape[1] in known:
                    block = Block(batch.column("row").to_numpy()[at], x, k)
                    block.search(known[x.shape[1]])
                    floor[at] = block.bounds()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], [*batch.schema.names, "floor"])

    return run


def _answered(k: int):
    """Rows sorted by store, its candidates before the queries, to the best candidates of each query in each store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held = None, {}
        for batch in batches:
            stores, asks = batch.column("store").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(stores) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if stores[a] != store:
                    store, held = stores[a], {}
                rows, ids = _numbers(part)
                if not asks[a]:
                    for at, x in _by_length(part):
                        held.setdefault(x.shape[1], []).append(Batch(rows[at], ids[at], x))
                    continue
                floors = part.column("floor").to_numpy()
                for at, x in _by_length(part):
                    block = Block(rows[at], x, k, floors[at])
                    for candidates in held.get(x.shape[1], ()):
                        block.search(candidates)
                    real = np.isfinite(block.score)
                    if real.any():
                        each = real.sum(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[at], each)), _ids(np.repeat(ids[at], each)), _ids(block.found[real]), pa.array(block.score[real].astype(np.int64))], ["row", "query_id", "vec_id", "score"])

    return run


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values == NO_ID)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The ``k`` highest integer inner products of each query (vec_id divisible by ``every``) with all other rows: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id, a null one being the last; with fewer candidates all are returned. Every row is a candidate of every query but its
    own row: of repeated ids each row is a query with answers of its own, and a candidate of the others. Vectors that are null or hold null
    or non-finite components take no part; vectors of another length than the query's are no candidates of it. Components so large that
    an inner product might exceed 2 ** 53 raise an error, as double arithmetic would not be exact. Extra columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = keep(integers(vectors), "integers")
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    facts = rows.agg(F.max(square).alias("m"), F.count("*").alias("n")).first()
    if facts["m"] is not None and facts["m"] >= EXACT:
        raise ValueError(f"inner products up to {facts['m']:g} are not exact in double arithmetic")
    n = facts["n"]
    picked = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).collect()  # so many rows at most
    by_length: dict[int, list] = {}
    for r in picked:
        by_length.setdefault(len(r["x"]), []).append((r["row"], r["x"]))
    sample = spark.sparkContext.broadcast([(np.array([i for i, _ in q], dtype=np.int64), np.array([x for _, x in q], dtype=np.float64).reshape(len(q), dim)) for dim, q in by_length.items()])
    asked = map_arrow(rows.where(F.col("vec_id") % every == 0), _floored(sample, k), "row long, vec_id long, x array<long>, floor double", QUERIES)
    asked = keep(asked, "queries")

    stores = max(-(-n // STORE), min(-(-n // SMALL), 4 * spark.sparkContext.defaultParallelism), 1)
    held = rows.select(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(stores)).cast("int").alias("store"), F.lit(False).alias("asks"), "row", "vec_id", "x", F.lit(0.0).alias("floor"))
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(stores - 1))).alias("store"), F.lit(True).alias("asks"), "row", "vec_id", "x", "floor")
    dealt = held.unionByName(asks).repartition(stores, "store").sortWithinPartitions("store", "asks")
    found = map_arrow(dealt, _answered(k), "row long, query_id long, vec_id long, score long", BATCH)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())  # at most k rows for each store
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors of every twentieth embedding."""
    return nearest(load(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.r <> q.r AND len(c.z) = len(q.z)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS k FROM scored
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= {K}
"""
