"""Interval overlap join: sales against sessions of clicks, aggregated by Allen's relations.

The join is an IEJoin (Khayyat et al., 2015) on numpy arrays, inside blocks that Spark deals out. A block holds the right intervals of one key
and at most about ``BLOCK`` of its left ones: keys with more are cut into blocks by a hash of the row, and their right intervals go to each of
them. In a block, a permutation leads from the end order of the right intervals to their start order, offset arrays say where a left interval
would stand in either, and bits of the start order, set from an offset of the end order on, are scanned up to an offset of the start order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.llm.common import keep, load, map_arrow, whole_groups

#: Left intervals of one key that go to a block, on average.
BLOCK = 4096
#: Bits, and pairs, that a task has in memory at once; at least those of one left interval.
AT_ONCE = 1 << 20
#: Stands for the end of an open interval; slots lie between its negative and itself.
OPEN = 1 << 39
GAP_US, SLOT_US = 30 * 60 * 1_000_000, 6 * 3600 * 1_000_000
#: By three times the order of the starts plus the order of the ends (0: left earlier, 1: equal, 2: left later).
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")


def micros(ts: Column) -> Column:
    """Whole microseconds from 1970 to a timestamp as it reads on the clock: of one without a zone in no zone at all, of another in the session's."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def slot(us: Column, width: int = SLOT_US) -> Column:
    """Number of the slot since 1970, rounded down before 1970 too."""
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


def click_sessions(clicks: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """(client_id, ts, kind) to client_id, first_us, last_us, is_open: runs of a client's clicks of which none is over ``gap_us`` after the one before.

    Clicks in one span of ``gap_us`` belong to one session, so they are first summed up by client and span, before and after the shuffle.
    What a client has then is bounded by the time that the table covers, not by its clicks. is_open: a click at the last ts has kind error.
    Rows with a null client or ts are left out; repeated rows and ties change nothing; extra columns are ignored; no rows give none.
    """
    rows = clicks.where("client_id is not null and ts is not null").select("client_id", micros(F.col("ts")).alias("us"), F.coalesce(F.col("kind") == "error", F.lit(False)).cast("long").alias("bad"))
    spans = rows.groupBy("client_id", (F.col("us") - F.pmod("us", F.lit(gap_us))).alias("span")).agg(F.min("us").alias("a"), F.max(F.col("us") * 2 + F.col("bad")).alias("z"))
    by = Window.partitionBy("client_id").orderBy("a")
    before = F.lag(F.shiftright("z", 1)).over(by)
    marked = spans.withColumn("new", F.coalesce((F.col("a") - before > gap_us).cast("long"), F.lit(1)))
    numbered = marked.withColumn("nth", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("client_id", "nth").agg(F.min("a").alias("first_us"), F.max("z").alias("z"))
    return found.select("client_id", "first_us", F.shiftright("z", 1).alias("last_us"), (F.col("z").bitwiseAND(1) == 1).alias("is_open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sale_id, client_id, start_us, end_us, is_open of each row of ``sales`` (sale_id, client_id, status, sold_at).

    The end is the latest of sold_at and the shipped_at of the lines with its sale_id; is_open: the status is open. Rows with a null client or
    sold_at are left out; a null sale_id has no lines; repeated rows are each returned; extra columns are ignored; no rows give none.
    """
    shipped = keep(lines.where("sale_id is not null and shipped_at is not null").groupBy(F.col("sale_id").alias("of")).agg(F.max("shipped_at").alias("shipped")), "shipped")
    rows = sales.where("client_id is not null and sold_at is not null").select("sale_id", "client_id", "sold_at", F.coalesce(F.col("status") == "open", F.lit(False)).alias("is_open"))
    rows = rows.join(shipped, rows["sale_id"] == shipped["of"], "left")
    start = micros(F.col("sold_at"))
    return rows.select("sale_id", "client_id", start.alias("start_us"), F.greatest(start, micros(F.col("shipped"))).alias("end_us"), "is_open")


def overlaps(lkey: np.ndarray, llo: np.ndarray, lhi: np.ndarray, rkey: np.ndarray, rlo: np.ndarray, rhi: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of left and right intervals that have the same key (0, 1, ...) and share a slot, in slices of about ``most`` pairs.

    Pairs of one left interval come in one slice. No interval may end before it starts.
    """

    def coded(key: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        return (key.astype(np.int64) << 41) + (at + OPEN)

    by_start = np.argsort(coded(rkey, rlo), kind="stable")
    starts, ends = coded(rkey, rlo)[by_start], coded(rkey, rhi)[by_start]
    permutation = np.argsort(ends, kind="stable")
    place = np.empty(len(ends), np.int64)
    place[permutation] = np.arange(len(ends))
    # Offsets: partners stand from `begin` on and before `before` in start order, and at or after `after` in end order.
    begin = np.searchsorted(starts, coded(lkey, -OPEN), "left")
    before = np.searchsorted(starts, coded(lkey, lhi), "right")
    after = np.searchsorted(ends[permutation], coded(lkey, llo), "left")
    left = np.flatnonzero((before > begin) & (after < np.searchsorted(starts, coded(lkey, OPEN), "right")))
    left = left[np.lexsort((after[left], begin[left]))]
    if not len(left):
        return
    # Left intervals with one offset into the end order have the same bits; the longest prefix of them is laid out once.
    new = np.append(True, (np.diff(begin[left]) != 0) | (np.diff(after[left]) != 0))
    first = np.flatnonzero(new)
    width = np.maximum.reduceat(before[left] - begin[left], first)
    edges, first = np.append(0, np.cumsum(width)), np.append(first, len(left))
    at = 0
    while at < len(width):
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + most, "right")) - 1)
        one, w = left[first[at:end]], width[at:end]
        base = edges[at:end] - edges[at]
        spots = np.repeat(begin[one] - base, w) + np.arange(base[-1] + w[-1])
        bits = place[spots] >= np.repeat(after[one], w)
        ones, counts = spots[bits], np.append(0, np.cumsum(bits))
        own = left[first[at] : first[end]]
        base = np.repeat(base, np.diff(first[at : end + 1]))
        low = counts[base]
        pairs = np.append(0, np.cumsum(counts[base + before[own] - begin[own]] - low))
        k = 0
        while k < len(own):
            to = max(k + 1, int(np.searchsorted(pairs, pairs[k] + most, "right")) - 1)
            n = np.diff(pairs[k : to + 1])
            yield np.repeat(own[k:to], n), by_start[ones[np.repeat(low[k:to] - (pairs[k:to] - pairs[k]), n) + np.arange(pairs[to] - pairs[k])]]
            k = to
        at = end


def relation_codes(llo: np.ndarray, lhi: np.ndarray, rlo: np.ndarray, rhi: np.ndarray) -> np.ndarray:
    """Places in RELATIONS of overlapping intervals."""
    return (3 * (np.sign(llo - rlo) + 1) + np.sign(lhi - rhi) + 1).astype(np.int64)


def _block_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    for t, edges in whole_groups(batches, ("key", "block")):
        key = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        yield t, key, np.flatnonzero(t["is_left"]), np.flatnonzero(~t["is_left"])


def _aggregated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, key, left, right in _block_sides(batches):
        llo, lhi, rlo, rhi = t["lo"][left], t["hi"][left], t["lo"][right], t["hi"][right]
        for a, b in overlaps(key[left], llo, lhi, key[right], rlo, rhi):
            code = relation_codes(llo[a], lhi[a], rlo[b], rhi[b])
            own, row = np.unique(a, return_inverse=True)
            cell = row * len(RELATIONS) + code
            both = (lhi[a] == OPEN) & (rhi[b] == OPEN)
            shared = np.where(both, 0, np.minimum(lhi[a], rhi[b]) - np.maximum(llo[a], rlo[b]) + 1)
            weight = t["weight"][right][b]
            # Sums of halves stay below 2 ** 53, where floating point is exact.
            n, closed, slots, low, high = (np.bincount(cell, x, len(own) * len(RELATIONS)).astype(np.int64) for x in (None, ~both, shared, weight & 0xFFFFFFFF, weight >> 32))
            some = np.flatnonzero(n)
            who = left[own[some // len(RELATIONS)]]
            times = t["weight"][who]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t["id"][who], mask=t["no_id"][who]), pa.array(np.array(RELATIONS, dtype=object)[some % len(RELATIONS)], type=pa.string()), pa.array(n[some] * times),
                    pa.array(slots[some] * times, mask=closed[some] == 0), pa.array((low[some] + (high[some] << 32)) * times),
                ],
                ["id", "relation", "n_pairs", "overlap_slots", "weight"],
            )


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, key, left, right in _block_sides(batches):
        llo, lhi, rlo, rhi = t["lo"][left], t["hi"][left], t["lo"][right], t["hi"][right]
        for a, b in overlaps(key[left], llo, lhi, key[right], rlo, rhi):
            code = relation_codes(llo[a], lhi[a], rlo[b], rhi[b])
            ids = [pa.array(t["id"][x], mask=t["no_id"][x]) for x in (left[a], right[b])]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.array(RELATIONS, dtype=object)[code], type=pa.string())], ["left_id", "right_id", "relation"])


def _blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides by key and block. left, right: id, key, lo, hi (null: open), weight."""
    spark = left.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def plain(df: DataFrame) -> DataFrame:
        return df.where("key is not null and lo is not null").select(F.col("id").cast("long").alias("id"), F.col("key").cast("long").alias("key"), F.col("lo").cast("long").alias("lo"), F.coalesce(F.col("hi").cast("long"), F.lit(OPEN)).alias("hi"), F.col("weight").cast("long").alias("weight")).where("hi >= lo")

    left, right = keep(plain(left), "left"), plain(right)
    heavy = keep(left.groupBy(F.col("key").alias("of")).count().where(F.col("count") > BLOCK).select("of", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "heavy")
    # The numbers of blocks reach the rows of a heavy key through copies of them, so that no task gets all of its rows.
    copies = heavy.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    hashed = F.xxhash64("id", "lo", "hi")
    dealt = left.withColumn("part", F.pmod(hashed, F.lit(spread)).cast("int"))
    dealt = dealt.join(copies, (dealt["key"] == copies["of"]) & (dealt["part"] == copies["copy"]), "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(12), "id", "lo", "hi"), F.coalesce("blocks", F.lit(1))).cast("int"))
    everywhere = right.join(heavy, right["key"] == heavy["of"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    columns = ["key", "block", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "lo", "hi", "weight"]
    both = dealt.select(*columns, F.lit(True).alias("is_left")).unionByName(everywhere.select(*columns, F.lit(False).alias("is_left")))
    return both.repartition("key", "block").sortWithinPartitions("key", "block")


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, key, lo, hi) of both sides to left_id, right_id, relation: all pairs of one key that share a slot, ``lo`` to ``hi`` inclusive.

    A null ``hi`` is an open end, infinite and equal to any other; rows with a null key or ``lo``, or that end before they start, have no
    partners. Null ids are returned as null; repeated rows pair each for itself; extra columns are ignored; an empty side gives no rows.
    """
    blocks = _blocks(left.withColumn("weight", F.lit(1)), right.withColumn("weight", F.lit(1)))
    return map_arrow(blocks, _paired, "left_id long, right_id long, relation string", 1 << 16)


def overlap_relations(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, key, lo, hi) and (key, lo, hi, weight) to id, relation, n_pairs, overlap_slots (null if both ends are open), weight (of the partners, summed).

    One row per left id and relation of ``overlap_pairs``, without its pairs ever leaving a task. Right rows need a weight of 0 or more.
    Equal left rows are joined once and count as often as they come; an id with several intervals has their sums; otherwise as ``overlap_pairs``.
    """
    once = left.groupBy("id", "key", "lo", "hi").agg(F.count("*").alias("weight"))
    found = map_arrow(_blocks(once, right.withColumn("id", F.lit(None).cast("long"))), _aggregated, "id long, relation string, n_pairs long, overlap_slots long, weight long", 1 << 16)
    return found.groupBy("id", "relation").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "weight")])


def op12_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales against all sessions of their clients, by relation of their 6-hour slots."""
    sold = sale_intervals(load(spark, sf_dir, "sales"), load(spark, sf_dir, "sale_lines"))
    seen = click_sessions(load(spark, sf_dir, "clicks"))

    def slotted(lo: str, hi: str) -> list[Column]:
        return [F.col("client_id").alias("key"), slot(F.col(lo)).alias("lo"), F.when(~F.col("is_open"), slot(F.col(hi))).alias("hi")]

    left = sold.select(F.col("sale_id").alias("id"), *slotted("start_us", "end_us"))
    right = seen.select(*slotted("first_us", "last_us"), F.crc32(F.col("first_us").cast("string").cast("binary")).alias("weight"))
    out = overlap_relations(left, right)
    return out.select(F.col("id").alias("sale_id"), "relation", "n_pairs", "overlap_slots", F.col("weight").alias("sessions_crc"))


#: The checksum of a text is taken byte by byte with its table of 256 remainders.
OP12_SQL = """
WITH steps AS (
  SELECT list(list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), clicked AS (
  SELECT client_id, epoch_us(ts) AS us, bool_or(coalesce(kind = 'error', false)) AS bad FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2
), marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM clicked
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS nth FROM marked
), sessions AS (
  SELECT client_id, min(us) AS first_us, max(us) AS last_us, arg_max(bad, us) AS is_open FROM numbered GROUP BY client_id, nth
), seen AS (
  SELECT client_id, first_us // 21600000000 AS lo, CASE WHEN is_open THEN 9000000000 ELSE last_us // 21600000000 END AS hi,
    xor(list_reduce([4294967295] || list_transform(range(1, length(first_us::VARCHAR) + 1), lambda i: ascii(substr(first_us::VARCHAR, i, 1))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM sessions, steps
), shipped AS (
  SELECT sale_id, max(epoch_us(shipped_at)) AS us FROM sale_lines GROUP BY 1
), sold AS (
  SELECT s.sale_id, client_id, epoch_us(sold_at) // 21600000000 AS lo,
    CASE WHEN status = 'open' THEN 9000000000 ELSE greatest(epoch_us(sold_at), coalesce(us, epoch_us(sold_at))) // 21600000000 END AS hi
  FROM sales s LEFT JOIN shipped p ON s.sale_id = p.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), pairs AS (
  SELECT a.sale_id, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi, crc FROM sold a JOIN seen b ON a.client_id = b.client_id AND a.lo <= b.hi AND b.lo <= a.hi
)
SELECT sale_id,
  CASE WHEN alo < blo THEN CASE WHEN ahi < bhi THEN 'overlaps' WHEN ahi = bhi THEN 'finished_by' ELSE 'contains' END
    WHEN alo = blo THEN CASE WHEN ahi < bhi THEN 'starts' WHEN ahi = bhi THEN 'equals' ELSE 'started_by' END
    ELSE CASE WHEN ahi < bhi THEN 'during' WHEN ahi = bhi THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
  count(*) AS n_pairs, sum(CASE WHEN ahi = 9000000000 AND bhi = 9000000000 THEN NULL ELSE least(ahi, bhi) - greatest(alo, blo) + 1 END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc
FROM pairs GROUP BY 1, 2
"""
