"""Operator 6, packing by cutting stock: documents become sequences of at most ``LENGTH`` tokens without padding, few of them cut.

1. Each document is encoded once; pieces of ``LENGTH`` tokens are cut off whole, each a sequence of its own, and the tail of the document
   is what gets packed. Kept in the shared folder: lengths and checksums, and the ids of the tails in the filler pool, a fixed share of all.
2. The histogram of tail lengths (at most ``LENGTH`` numbers) goes to the driver. Column generation finds patterns of length classes, their
   counts are rounded, and a document takes the slot that its rank within its class gives. Ranks come from counts by partition.
3. What room is left (tails are a little shorter than their class) is filled with tails from the pool, cut wherever needed: the room of all
   sequences and the tokens of all fillers are two lines, and overlapping intervals on them are the pieces. Fillers are taken
   until the sequences of the others hold no more than all tokens, so no room stays; what is over makes sequences of its own, the last of them
   cut into powers of two, which need no padding. If the pool is too small (a few documents only), room stays as padding.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.llm.common import keep, load, map_arrow
from patchloom.llm.cutting_stock import round_patterns, solve
from patchloom.llm.tokens import encoder, public_path

LENGTH, END, UNIT = 4096, 2, 16
#: One tail in so many may be cut to fill sequences.
POOL = 4
#: Words that a worker keeps in each of two generations.
WORDS_KEPT = 120_000
#: Rows that one task adds up in a running total.
RUN = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUT = "doc_id long, part int, pos long, n long, crcs array<long>, first_full long, tail int, tail_crc long, cls int, pool boolean, nth long, ids binary"


def cut(docs: DataFrame, path: str, pool: int) -> DataFrame:
    """One row per document: its length, the checksums of whole pieces and of the tail, and the tail's place among those of its class in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, pos, full, nth = encoder(path, WORDS_KEPT), TaskContext.get().partitionId(), 0, 0, Counter()
        end = END.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for text, pooled in zip(batch.column("text"), batch.column("pooled").to_pylist(), strict=True):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                crcs = [zlib.crc32(ids[4 * a : 4 * (a + LENGTH)]) for a in range(0, n - LENGTH + 1, LENGTH)]
                tail = ids[4 * LENGTH * len(crcs) :]
                cls = -(-len(tail) // (4 * UNIT))
                key = (cls, pooled)
                rows.append((part, pos, n, crcs, full, len(tail) // 4, zlib.crc32(tail), cls, pooled, nth[key], tail if pooled else None))
                pos, full = pos + 1, full + len(crcs)
                nth[key] += 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in _CUT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]], names)

    pooled = (F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(pool)) == 0).alias("pooled")
    return map_arrow(docs.select("doc_id", "text", pooled), run, _CUT)


def running_total(df: DataFrame, at: str, value: str, rows: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over rows with a smaller ``at`` (distinct, 0 to ``rows``). Sums of runs are added up by the same rule."""
    name = f"{at}_run"
    run = F.floor(F.col(at) / RUN).alias(name)
    own = Window.partitionBy(name).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn(name, run).withColumn("before", F.coalesce(F.sum(value).over(own), F.lit(0)))
    if rows <= RUN:
        return inside.drop(name)
    sums = df.groupBy(run).agg(F.sum(value).alias("sum"))
    sums = running_total(sums, name, "sum", rows // RUN + 1).select(name, F.col("before").alias("earlier"))
    return inside.join(sums, name).withColumn("before", F.col("before") + F.col("earlier")).drop(name, "earlier")


def plan(lengths: list[tuple[bool, int, int]]) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """From (in the pool, tail length, count): patterns with their uses, and how many of each class of the pool are fillers."""
    demand, pool, tokens, pool_tokens = Counter(), Counter(), 0, 0
    for pooled, n, count in lengths:
        demand[-(-n // UNIT)] += count
        tokens += n * count
        if pooled:
            pool[-(-n // UNIT)] += count
            pool_tokens += n * count
    capacity = LENGTH // UNIT
    basis = solve(demand, capacity)
    share, fillers = 0.0, Counter()
    while True:
        patterns = round_patterns(basis, {c: n - fillers[c] for c, n in demand.items()}, capacity)
        room = LENGTH * sum(n for _, n in patterns) - tokens
        if room <= 0 or share >= 1:
            return patterns, dict(fillers)
        share = min(1.0, share + max(0.02, 1.05 * room / max(1, pool_tokens)))
        fillers = Counter({c: int(np.ceil(share * n)) for c, n in pool.items()})


class Slots:
    """The sequence and slot of each rank in each class."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        by_class: dict[int, list[tuple[int, int, int, int]]] = {}
        base, filled = 0, Counter()
        for pattern, n in patterns:
            slot = 0
            for c in sorted(pattern, reverse=True):
                by_class.setdefault(c, []).append((filled[c], pattern[c], base, slot))
                filled[c] += pattern[c] * n
                slot += pattern[c]
            base += n
        self.sequences = base
        self.by_class = {c: np.array(rows, dtype=np.int64).T for c, rows in by_class.items()}

    def find(self, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, slot) of documents by class and rank."""
        sequence, slot = np.zeros(len(cls), dtype=np.int64), np.zeros(len(cls), dtype=np.int64)
        for c in np.unique(cls):
            here = np.flatnonzero(cls == c)
            first, each, base, at = self.by_class[int(c)]
            k = np.searchsorted(first, rank[here], side="right") - 1
            t = rank[here] - first[k]
            sequence[here], slot[here] = base[k] + t // each[k], at[k] + t % each[k]
        return sequence, slot


def _placed(slots: Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, slot = slots.find(batch.column("cls").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("doc_id", "n", "tail", "tail_crc")], pa.array(sequence), pa.array(slot)], ["doc_id", "n", "tail", "tail_crc", "sequence_id", "slot"])

    return run


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document (its end id included) lies in exactly one piece; pieces of a sequence lie gapless from offset 0. A null or empty
    text is its end id alone. Repeated rows are packed each for itself, a null doc_id stays null, extra columns are ignored, an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = keep(cut(docs, path or public_path("word_bpe_49k.json"), POOL), "cut")

    tails = rows.where("tail > 0")
    lengths = tails.groupBy("pool", "tail").count().collect()  # at most two for each length
    patterns, fillers = plan([(r["pool"], r["tail"], r["count"]) for r in lengths])
    slots = Slots(patterns)

    earlier = Window.partitionBy("pool", "cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = tails.groupBy("pool", "cls", "part").count().select("pool", "cls", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    ranked = tails.join(counts, ["pool", "cls", "part"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    of_class = sorted(fillers.items())
    firsts = np.cumsum([0, *[n for _, n in of_class]]).tolist()
    known = F.broadcast(spark.createDataFrame([(c, n, f) for (c, n), f in zip(of_class, firsts, strict=False)], "cls int, fillers long, first long"))  # at most LENGTH / UNIT rows
    ranked = ranked.join(known, "cls", "left")
    is_filler = F.col("pool") & (F.col("rank") < F.coalesce("fillers", F.lit(0)))
    # Ranks of the others: documents outside the pool first, then what the fillers leave of it.
    outside = Counter({c: 0 for c, _ in of_class})
    for r in lengths:
        outside[-(-r["tail"] // UNIT)] += 0 if r["pool"] else r["count"]
    shift = F.broadcast(spark.createDataFrame([*outside.items()] or [(0, 0)], "cls int, outside long"))
    others = ranked.where(~is_filler).join(shift, "cls", "left")
    others = others.withColumn("rank", F.when(F.col("pool"), F.col("rank") - F.coalesce("fillers", F.lit(0)) + F.col("outside")).otherwise(F.col("rank")))
    placed = map_arrow(others.select("doc_id", "n", "tail", "tail_crc", "cls", "rank"), _placed(slots), "doc_id long, n long, tail int, tail_crc long, sequence_id long, slot long", 8192)
    placed = keep(placed, "placed")

    left_of = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.select("doc_id", (F.col("n") - F.col("tail")).alias("start"), F.col("tail").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum("tail").over(left_of), F.lit(0)).alias("offset"))

    room = placed.groupBy("sequence_id").agg((F.lit(LENGTH) - F.sum("tail")).alias("room"))
    room = keep(running_total(room, "sequence_id", "room", slots.sequences).where("room > 0"), "room")
    cuts = ranked.where(is_filler).select("doc_id", "n", "tail", "ids", (F.col("first") + F.col("rank")).alias("q"))
    cuts = keep(running_total(cuts, "q", "tail", firsts[-1]), "fillers")
    has_room = room.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
    over = max(0, cuts.agg(F.coalesce(F.sum("tail"), F.lit(0))).first()[0] - has_room)
    extra, rest = divmod(over, LENGTH)
    powers = [1 << k for k in range(LENGTH.bit_length() - 2, -1, -1) if rest >> k & 1]
    last = [(slots.sequences + extra + k, p, has_room + extra * LENGTH + sum(powers[:k])) for k, p in enumerate(powers)]
    gaps = room.select("sequence_id", F.col("room").cast("long"), F.col("before").cast("long"))
    gaps = gaps.unionByName(spark.range(extra).select((F.col("id") + slots.sequences).alias("sequence_id"), F.lit(LENGTH).cast("long").alias("room"), (F.col("id") * LENGTH + has_room).alias("before")))
    gaps = gaps.unionByName(spark.createDataFrame(last, "sequence_id long, room long, before long")).withColumn("filled", F.when(F.col("sequence_id") < slots.sequences, LENGTH - F.col("room")).otherwise(0))

    def binned(df: DataFrame, size: str, name: str) -> DataFrame:
        ends = F.col("before"), F.col("before") + F.col(size) - 1
        return df.withColumn("bin", F.explode(F.sequence(*[F.floor(x / LENGTH) for x in ends]))).withColumnRenamed("before", name)

    both = binned(gaps, "room", "a").join(binned(cuts, "tail", "b"), "bin")
    begin, end = F.greatest("a", "b"), F.least(F.col("a") + F.col("room"), F.col("b") + F.col("tail"))
    both = both.withColumn("begin", begin).withColumn("end", end).where((F.col("begin") < F.col("end")) & (F.floor(F.col("begin") / LENGTH) == F.col("bin")))
    inside, length = F.col("begin") - F.col("b"), F.col("end") - F.col("begin")
    filling = both.select("doc_id", (F.col("n") - F.col("tail") + inside).alias("start"), length.alias("length"), F.crc32(F.substring("ids", (inside * 4 + 1).cast("int"), (length * 4).cast("int"))).alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", (F.col("filled") + F.col("begin") - F.col("a")).alias("offset"))

    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = rows.groupBy("part").agg(F.sum(F.size("crcs")).alias("full")).select("part", F.coalesce(F.sum("full").over(by_part), F.lit(0)).alias("parts_full"))
    full = rows.where(F.size("crcs") > 0).join(parts, "part").select("doc_id", "n", (F.col("first_full") + F.col("parts_full")).alias("first"), F.posexplode("crcs").alias("k", "crc"))
    first = slots.sequences + extra + len(last)
    full = full.select("doc_id", (F.col("k") * F.lit(LENGTH).cast("long")).alias("start"), F.lit(LENGTH).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k") + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = full.unionByName(whole).unionByName(filling)
    return out.select(*[F.col(x.split()[0]).cast("long") for x in PIECES.split(", ")])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    return pack(load(spark, sf_dir, "documents"))
