"""Sharding by minimax contiguous partition.

Equal texts form an atomic group. Groups stand in the order of their smallest
document id; the cuts between shards are chosen so that the largest shard is as
small as any contiguous partition into that many shards allows: the smallest
capacity for which filling shards greedily in order needs no more than the
given number of shards is found by binary search. Under that capacity each cut is
made where the running size is nearest to an equal share of what is left, so that
shards are near equal and none is left with the rest.

The search looks groups up in two levels. The driver holds the running sizes of
at most ``BLOCKS`` blocks of groups; the sizes inside a block are fetched for
the blocks in which a cut may fall. The order itself is a range-partitioned
table in the shared folder, from which ranks are read as partition offset plus
place, so neither a group nor a shard is ever collected in one task.

Null text has no bytes. Repeated rows (equal ids too) are kept, each with its
own slot. An empty table gives an empty result. With fewer groups than shards
the last shards stay empty. A null ``doc_id`` is placed like the smallest id.
Extra columns are left out of the result, which carries ``doc_id``.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.runtime import materialize, small_frame

BLOCKS = 4096
#: Bytes that a document counts beside its text.
ROW_BYTES = 8
PART_ROWS = 200_000
PLACE = 1 << 33  # monotonically_increasing_id counts rows below this bit


class GroupSizes:
    """Running sizes over the ordered groups; details are fetched block by block."""

    def __init__(self, leaders: DataFrame):
        self._leaders = leaders
        rows = (
            leaders.groupBy("part", "block")
            .agg(F.sum("group_bytes").alias("bytes"), F.max("group_bytes").alias("largest"))
            .orderBy("part", "block")
            .collect()
        )
        self.keys = [(r.part, r.block) for r in rows]
        self.largest = max((r.largest for r in rows), default=0)
        self.before = [0]
        for r in rows:
            self.before.append(self.before[-1] + r.bytes)
        self.total = self.before[-1]
        self._inside: dict[int, list[tuple[int, int, int]]] = {}

    def fetch(self, blocks: set[int]) -> None:
        """Load running sizes of the groups in some blocks with one job."""
        wanted = sorted(b for b in blocks if 0 <= b < len(self.keys) and b not in self._inside)
        if not wanted:
            return
        keys = small_frame(self._leaders.sparkSession, [(*self.keys[b], b) for b in wanted], "part long, block long, no long")
        rows = (
            self._leaders.where(F.col("part").isin(sorted({self.keys[b][0] for b in wanted})))
            .join(F.broadcast(keys), ["part", "block"])
            .select("no", "part", "place", "group_bytes")
            .collect()
        )
        found: dict[int, list] = {b: [] for b in wanted}
        for r in rows:
            found[r.no].append((r.place, r.part, r.group_bytes))
        for b, groups in found.items():
            at, self._inside[b] = self.before[b], []
            for place, part, n in sorted(groups):
                self._inside[b].append((at, part, place))
                at += n

    def block_of(self, size: int) -> int:
        return min(bisect_right(self.before, size) - 1, len(self.keys) - 1)

    def last_start(self, size: int) -> tuple[int, int, int]:
        """The last group whose running size before it is at most ``size``: (running size, part, place)."""
        b = self.block_of(size)
        inside = self._inside[b]
        return inside[bisect_right(inside, (size, float("inf"), 0)) - 1]

    def around(self, size: float) -> list[tuple[int, int, int]]:
        """The last group that begins at or before a running size, and the next one if there is one."""
        b = self.block_of(size)
        self.fetch({b, b + 1})
        inside = self._inside[b] + self._inside.get(b + 1, [])
        at = bisect_right(inside, (size, float("inf"), 0)) - 1
        return inside[max(at, 0) : at + 2]

    def blocks_suffice(self, start: int, capacity: int, shards: int) -> bool:
        """Whether what follows a running size fits into shards that end with whole blocks."""
        for _ in range(shards):
            if start + capacity >= self.total:
                return True
            end = self.before[bisect_right(self.before, start + capacity) - 1]
            if end <= start:
                return False
            start = end
        return False

    def cuts(self, capacity: int, shards: int, start: int = 0) -> list[tuple[int, int, int]] | None:
        """First groups of the second and later shards filled greedily from ``start``; None if more are needed."""
        found = []
        while start + capacity < self.total:
            if len(found) == shards - 1:
                return None
            # The next shard starts at the last group that begins at or before start + capacity. The blocks of
            # the cuts after it are fetched along: they lie near the multiples of the capacity.
            if self.block_of(start + capacity) not in self._inside:
                ahead = [self.block_of(start + k * capacity) for k in range(1, shards - len(found) + 1)]
                self.fetch({b - back for b in ahead for back in (0, 1)})
            cut = self.last_start(start + capacity)
            found.append(cut)
            start = cut[0]
        return found

    def cuts_at_blocks(self, capacity: int, shards: int) -> bool:
        """Whether shards filled greedily with whole blocks suffice: then whole groups suffice too."""
        start = 0
        for _ in range(shards):
            end = bisect_right(self.before, self.before[start] + capacity) - 1
            if end == len(self.keys):
                return True
            if end == start:
                return False
            start = end
        return False


def smallest_capacity(sizes: GroupSizes, shards: int) -> int:
    low, high = max(sizes.largest, -(-sizes.total // shards)), sizes.total  # no smaller capacity can do
    floor = low
    while low < high:  # block sums alone narrow the search to about one block
        middle = (low + high) // 2
        if sizes.cuts_at_blocks(middle, shards):
            high = middle
        else:
            low = middle + 1
    low = floor
    while low < high:
        middle = (low + high) // 2
        if sizes.cuts(middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def even_cuts(sizes: GroupSizes, capacity: int, shards: int) -> list[tuple[int, int, int]]:
    """First groups of the second and later shards, each cut nearest to an equal share of what is left; no shard is
    above the capacity."""
    found: list[tuple[int, int, int]] = []
    start = 0
    near = {sizes.block_of(sizes.total * i / shards) for i in range(1, shards)}
    sizes.fetch({b + step for b in near for step in (0, 1)})
    for left in range(shards - 1, 0, -1):
        share = start + (sizes.total - start) / (left + 1)
        options = [c for c in sizes.around(share) if start < c[0] <= start + capacity]
        for cut in sorted(options, key=lambda c: abs(c[0] - share)):
            if sizes.blocks_suffice(cut[0], capacity, left) or sizes.cuts(capacity, left, cut[0]) is not None:
                break
        else:
            rest = sizes.cuts(capacity, left + 1, start)
            if not rest:
                break
            cut = rest[0]
        found.append(cut)
        start = cut[0]
    return found


def minimax_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs`` (``doc_id, text``)."""
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("digest"),
    )
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("group_bytes"))
    joined = rows.join(groups, "digest")
    order = ["first_id", "digest", "doc_id"]
    parts = max(spark.sparkContext.defaultParallelism, docs.count() // PART_ROWS + 1)
    placed = materialize(
        joined.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .select("*", (F.col("at") / PLACE).cast("long").alias("part"), F.pmod("at", F.lit(PLACE)).alias("place"))
        .drop("at")
    )
    counts = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, n = {}, 0
    for part, rows_in in counts:
        before[part] = n
        n += rows_in
    # A group's first row stands for it; a group may go on into the next partition.
    per_block = max(1, -(-n // BLOCKS))
    leaders = materialize(
        placed.groupBy("digest")
        .agg(F.min(F.struct("part", "place")).alias("first"), F.first("group_bytes").alias("group_bytes"))
        .select("first.part", "first.place", "group_bytes", (F.col("first.place") / per_block).cast("long").alias("block"))
    )
    sizes = GroupSizes(leaders)
    capacity = smallest_capacity(sizes, shards) if n else 0
    cuts = even_cuts(sizes, capacity, shards) if n else []
    shard, first = F.lit(0), F.lit(0).cast("long")
    for i, (_, part, place) in enumerate(cuts, 1):
        reached = (F.col("part") > part) | ((F.col("part") == part) & (F.col("place") >= place))
        shard = F.when(reached, i).otherwise(shard)
        first = F.when(reached, F.lit(before[part] + place).cast("long")).otherwise(first)
    offsets = small_frame(spark, sorted(before.items()), "part long, before long")
    return placed.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        F.col("text_crc32"),
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("before") + F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
