"""Near copies for the pipeline: operator 1 with wide fingerprints of five-word shingles, and an exact check of what it brings together.

Two texts are linked if their sets of shingles have a Jaccard similarity of ``SIMILAR`` or more. At 0.8, signs of SimHash differ in 15 % of all
places: about 10 of 64, so no few blocks of 64 bits are sure to agree. Fingerprints here have ``BITS`` bits, split into blocks again and
again after another shuffle of the bits (the first split's blocks bring any pair together that differs in fewer bits than it has blocks); the
number of blocks is what a pair at the very bound shares one of with probability ``RECALL`` (closer pairs: almost surely). Pairs
in a block are held against Hamming bounds that lose a pair at 0.8 with probability 5e-5. What is left is components of
candidates, and inside each of them the similarity is counted exactly on the sets themselves, each of which moves once.

Texts with equal sets are one row from the start. A large group (a block or a component that a third of all rows may share) is cut into chunks.
First each chunk is checked by itself, with a few members of the whole group as guests, which joins the copies of one text whatever the
chunk. Any link still missing has a member outside the group's largest component, so only those members are then
held against all chunks. Of a chunk only a spanning star of verified links is emitted, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm import sign_blocks
from patchloom.llm.common import keep, map_arrow, whole_groups
from patchloom.llm.components import connected_components
from patchloom.llm.id_bits import maybe
from patchloom.llm.sign_blocks import BITS
from patchloom.llm.simhash import leaders, shingles

#: SIMILAR is a fraction, so that the test is exact in whole numbers.
SHINGLE, SIMILAR, SEED = 5, (4, 5), 7
#: Bounds on differing bits in the first 64 and the first 128 of a fingerprint.
FIRST, BOTH = 22, 36
RECALL, CROWD, BLOCKS_AT_MOST = 0.999, 512, 192
#: Members of a chunk of a block, shingles in a chunk of a component, and guests in each chunk.
BUCKET, FILL, GUESTS = 4096, 1 << 18, 8
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, (1, BITS // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text; none for null, empty and blank texts."""
    return np.unique(shingles(text, SHINGLE))


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b members with ``common`` shared ones reach SIMILAR."""
    return common * sum(SIMILAR) >= SIMILAR[0] * (a + b)


def wide_fingerprint(members: np.ndarray) -> np.ndarray:
    """BITS signs (0 or 1) of a set: each member has a pseudo-random weight of -128 to 127 for each bit, and the sign is that of the sum."""
    sums = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(members), 1 << 10):
        x = members[i : i + (1 << 10), None] * _FACTORS
        x ^= x >> np.uint64(31)
        x *= _SECOND
        sums += (x ^ (x >> np.uint64(29))).view(np.int8).sum(axis=0, dtype=np.int64)
    return (2 * sums + len(members) > 0).astype(np.uint8)  # the mean weight is -1/2


def blocks_for(n: int) -> tuple[int, int]:
    """(bits of a block, blocks) for n distinct sets; of all pairs at one similarity, sets of equal sizes are the farthest."""
    return sign_blocks.blocks_for(n, math.acos(2 * SIMILAR[0] / sum(SIMILAR)) / math.pi, CROWD, RECALL, BLOCKS_AT_MOST)


def _identity(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), SEED) if len(members) else 0


def _nodes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for the first 128 bits of fingerprints: what the graph of candidates is made of."""
    x = a.view(np.uint64) * _SECOND
    x = (x ^ (x >> np.uint64(32)) ^ b.view(np.uint64)) * _FACTORS[0, 0]
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _words(fps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, first and second 64 bits as signed longs) of fingerprints."""
    raw = np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(-1, BITS // 8)
    words = np.ascontiguousarray(raw[:, :16]).view(np.int64)
    return raw, np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column("text"):
            members = shingle_set(t.as_py())
            rows.append((_identity(members), len(members), np.packbits(wide_fingerprint(members)).tobytes()))
        same = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
        node = _nodes(*_words([r[2] for r in rows])[1:])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same), pa.array([r[1] for r in rows], type=pa.int64()), pa.array([r[2] for r in rows], type=pa.binary()), pa.array(node)], ["doc_id", "same", "n", "fp", "node"])


def _blocked(bits: int, blocks: int):
    """Fingerprints to one row for each of their blocks: what the block is and holds, and the first 128 bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, a, b = _words(batch.column("fp").to_pylist())
                groups = sign_blocks.groups(raw, bits, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(groups.ravel()), pa.array(np.repeat(a, blocks)), pa.array(np.repeat(b, blocks))], ["g", "a", "b"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rep = _nodes(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(rep), batch.column("a"), batch.column("b")], ["g", "rep", "a", "b"])


def reached(sets: list[np.ndarray]) -> np.ndarray:
    """For each of some non-empty sets, one set of its component, the same for all of them; links are those of all pairs that are similar."""
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    left, flat = label.copy(), codes
    while len(left) > 1:
        root, todo = left[0], [left[0]]
        flat, left = flat[sizes[root] :], left[1:]
        while todo and len(left):
            p = todo.pop()
            mark = np.zeros(int(codes.max()) + 1, dtype=bool)
            mark[codes[ends[p] - sizes[p] : ends[p]]] = True
            common = np.add.reduceat(mark[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            hit = similar(common, sizes[left], sizes[p])
            if hit.any():
                label[left[hit]] = root
                todo += left[hit].tolist()
                flat, left = flat[np.repeat(~hit, sizes[left])], left[~hit]
    return label


def _rooted(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least member that each of n members reaches by the links (p, q)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[p], label[q])
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def close_labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each fingerprint (first and second 64 bits, unsigned) reaches by pairs within the Hamming bounds."""
    label = np.arange(len(x))
    for i in range(0, len(x), 256):  # of each strip of pairs only what it joins is kept
        bits = np.bitwise_count(x[i : i + 256, None] ^ x[None, i:])
        p, q = np.nonzero(bits <= FIRST)
        later = p < q
        p, q = p[later], q[later]
        near = bits[p, q] + np.bitwise_count(y[i + p] ^ y[i + q]) <= BOTH
        if near.any():
            own = np.flatnonzero(label != np.arange(len(x)))
            label = _rooted(len(x), np.concatenate([own, i + p[near]]), np.concatenate([label[own], i + q[near]]))
    return label


def _close(cols: dict, a: int, b: int) -> np.ndarray:
    return close_labels(*[cols[w][a:b].view(np.uint64) for w in ("a", "b")])


def _close_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks' values to (src, dst): a spanning star of what is close in each."""
    for cols, starts in whole_groups(batches, ("g",)):
        src, dst = [], []
        nodes = _nodes(cols["a"], cols["b"])
        for s in np.flatnonzero(np.diff(starts) > 1):
            a, b = int(starts[s]), int(starts[s + 1])
            label = _close(cols, a, b)
            moved = np.flatnonzero(label != np.arange(b - a))
            src.append(nodes[a:b][moved])
            dst.append(nodes[a:b][label[moved]])
        if src and any(map(len, src)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])


def _alike(cols: dict, a: int, b: int) -> np.ndarray:
    """The same for a group of shingle sets and their exact similarity."""
    return reached([np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in cols["members"].slice(a, b - a)])


def _verified(label_of: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in whole_groups(batches, ("g", "i", "j")):
            src, dst = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a > 1:
                    label = label_of(cols, a, b)
                    moved = np.flatnonzero(label != np.arange(b - a))
                    src.append(cols["rep"][a:b][moved])
                    dst.append(cols["rep"][a:b][label[moved]])
            if src and any(map(len, src)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return run


def joined(members: DataFrame, fill: int, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(g, rep, load, ...), rep unique in g, to (rep, component): components of all links that ``check`` finds between members of one g.

    ``check`` takes rows with a group (g, i, j) and gives (src, dst) with the components of each group. Groups whose loads add up to
    more than ``fill`` are cut into chunks.
    """
    total = members.groupBy("g").agg(F.sum("load").alias("total")).where(F.col("total") > fill)
    large = keep(total.select("g", F.ceil(F.col("total") / fill).cast("int").alias("chunks")), "large")
    rest = [c for c in members.columns if c != "g"]
    zero = F.lit(0).cast("int")
    if large.isEmpty():
        found = check(members.select("g", zero.alias("i"), zero.alias("j"), *rest))
        return connected_components(found)

    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    rows = members.join(large, "g", "left").withColumn("i", F.coalesce(own, zero))
    cut = keep(rows.where("chunks IS NOT NULL"), "cut")
    picked = cut.groupBy("g", "chunks").agg(*[F.min(F.struct(F.xxhash64("rep", F.lit(s)).alias("h"), "i", *rest)).alias(f"p{s}") for s in range(GUESTS)])
    guests = picked.select("g", "chunks", F.explode(F.array_distinct(F.array(*[F.col(f"p{s}").dropFields("h") for s in range(GUESTS)]))).alias("p")).select("g", "p.*", "chunks")
    guests = guests.withColumn("j", F.explode(F.sequence(zero, F.col("chunks") - 1))).where("i <> j").drop("i").withColumnRenamed("j", "i")
    first = rows.drop("chunks").unionByName(guests.drop("chunks"))
    found = keep(check(first.select("g", "i", zero.alias("j"), *rest)), "first")
    parts = keep(connected_components(found), "parts")

    # What is still missing links a member outside its group's largest component to some other member.
    known = cut.join(parts, cut["rep"] == parts["node"], "left").withColumn("of", F.coalesce("component", "rep")).drop("node", "component")
    counts = known.groupBy("g", "of").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    most = counts.groupBy("g").agg(F.max(F.struct("n", "of")).alias("m"), F.sum("load").alias("all"))
    most = most.join(counts.select("g", F.col("of").alias("mine"), F.col("load").alias("held")), (most["g"] == counts["g"]) & (F.col("m.of") == F.col("mine"))).select(most["g"], F.col("mine").alias("top"), (F.col("all") - F.col("held")).alias("open"))
    most = keep(most.where("open > 0").select("g", "top", F.ceil(F.col("open") / fill).cast("int").alias("sides")), "most")
    if most.isEmpty():
        return parts.select("node", "component")
    known = known.join(most, "g")
    few = known.where(F.col("of") != F.col("top"))
    side = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("sides")).cast("int")
    asks = few.withColumn("j", side + 1).drop("i").withColumn("i", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    told = known.withColumn("j", F.explode(F.sequence(zero + 1, F.col("sides")))).where((F.col("of") == F.col("top")) | (F.col("j") != side + 1))
    both = asks.unionByName(told, allowMissingColumns=True).select("g", "i", "j", *rest)
    more = check(both.dropDuplicates(["g", "i", "j", "rep"]))
    return connected_components(keep(more, "more").unionByName(parts.select(F.col("node").alias("src"), F.col("component").alias("dst"))))


def _dealt(rows: DataFrame, label_of: Callable, rows_at_once: int) -> DataFrame:
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "rep")
    return map_arrow(rows, _verified(label_of), "src long, dst long", rows_at_once)


def candidates(reps: DataFrame) -> DataFrame:
    """(fp, n), one row per distinct set, to (node, component): components of fingerprints that share a block and keep the Hamming bounds."""
    wide = keep(reps.where("n > 0").select("fp").distinct(), "fingerprints")
    bits, blocks = blocks_for(wide.count())
    rows = map_arrow(wide, _blocked(bits, blocks), "g long, a long, b long", 2048)
    large = keep(rows.groupBy("g").count().where(F.col("count") > BUCKET).select("g"), "large")
    none = large.isEmpty()
    small = (rows if none else rows.join(large, "g", "left_anti")).repartition("g").sortWithinPartitions("g")
    found = map_arrow(small, _close_in_blocks, "src long, dst long", 8192)
    if none:
        return connected_components(found)
    found = keep(found, "close")
    members = map_arrow(rows.join(large, "g", "left_semi"), _numbered, "g long, rep long, a long, b long", 8192).withColumn("load", F.lit(1).cast("long"))
    more = joined(members.dropDuplicates(["g", "rep"]), BUCKET, lambda r: _dealt(r.select("g", "i", "j", "rep", "a", "b"), _close, 8192))
    return connected_components(found.unionByName(more.select(F.col("node").alias("src"), F.col("component").alias("dst"))))


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id may be among ``ids`` (doc_id): all that are, and a few others.

    A bitmap of ID_BITS hashed ids, 8 MB whatever the tables, goes to all executors, so no text moves to be tested.
    """
    return maybe(docs, ids, {"among": F.lit(True)}).where("among").select(*docs.columns)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column("text")]
        same = np.array([_identity(s) for s in sets], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(same), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([s.tobytes() for s in sets], type=pa.binary())], ["rep", "load", "members"])


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(same, doc_id, n, fp, node), one row per distinct set, to (node, component) over same: components of all pairs of sets that are similar, found among candidates and counted exactly."""
    parts = candidates(reps)
    own = reps.where("n > 0").select("same", "node").join(parts, "node", "left").select(F.coalesce("component", "node").alias("g"), F.col("same").alias("rep"))
    groups = keep(own.join(own.groupBy("g").count().where("count > 1").select("g"), "g"), "groups")
    ids = reps.join(groups, reps["same"] == groups["rep"], "left_semi").select("doc_id")
    sets = map_arrow(among(docs.select("doc_id", "text"), ids), _sets, "rep long, load long, members binary")
    sets = keep(sets.join(groups, "rep").dropDuplicates(["rep"]).select("g", "rep", "load", "members"), "sets")
    return joined(sets, FILL, lambda r: _dealt(r.select("g", "i", "j", "rep", "members"), _alike, 256))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable by links of similarity SIMILAR or more. Texts without words are alike; rows with a null doc_id are left out."""
    sketches = keep(map_arrow(docs.select("doc_id", "text"), _sketches, "doc_id long, same long, n long, fp binary, node long").where("doc_id is not null"), "sketches")
    reps = sketches.groupBy("same").agg(F.min(F.struct("doc_id", "n", "fp", "node")).alias("r"))
    reps = keep(reps.select("same", "r.doc_id", "r.n", "r.fp", "r.node"), "reps")
    parts = links(docs, reps)
    parts = parts.withColumnRenamed("node", "same")
    reps = reps.join(parts, "same", "left").select("same", "doc_id", F.coalesce("component", "same").alias("c"))
    least = reps.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    reps = reps.join(least, "c").select("same", "component_id")
    return sketches.select("doc_id", "same").join(reps, "same").select("doc_id", "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their group, all columns kept; of repeated ids one row stays, and so do rows with a null doc_id.

    An empty table gives no rows, long texts are read whole, and other columns, whatever their names, pass through.
    """
    return leaders(docs, groups(docs))
