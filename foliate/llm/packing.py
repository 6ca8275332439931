"""Filling containers of fixed capacity with items of varying size.

The plan is made on the histogram of sizes, which has at most ``capacity`` entries however many items there are,
and is then carried out by rank within each size, so no item travels to the driver.

* Items above the capacity are the only ones that are split: into full containers and a rest.
* Large-item matching: items above a third of the capacity fit at most twice into a container (three of them
  exceed it), so each, from the largest down, is paired with the largest such item that still fits.
* The smaller items, from the largest down, go to the container with the least gap that takes them (best fit);
  a new container is opened only when no gap does.

Items of equal size are interchangeable, so every step moves a run of them at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Ranks within a size are taken in so many independent slices, so that one size may hold any share of all items.
SLICES = 64


class Plan:
    """Runs of equal items and the containers they go to: (size, first rank, first container, count)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int]] = []
        self.containers = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.levels: list[int] = []

    def _open(self, count: int) -> int:
        first, self.containers = self.containers, self.containers + count
        return first

    def _leave(self, gap: int, first: int, count: int) -> None:
        if gap > 0:
            if not self.gaps.get(gap):
                insort(self.levels, gap)
            self.gaps[gap].append((first, count))

    def match_large(self, counts: dict[int, int]) -> None:
        """Pairs items above a third of the capacity, each size with the largest size that fits beside it."""
        left = dict(counts)
        sizes = sorted(left)
        taken: dict[int, int] = defaultdict(int)
        while sizes:
            big = sizes[-1]
            at = bisect_left(sizes, self.capacity - big + 1) - 1
            if at >= 0 and sizes[at] == big and left[big] == 1:
                at -= 1
            mate = sizes[at] if at >= 0 else None
            sole = mate is None
            n = left[big] if sole else left[big] // 2 if mate == big else min(left[big], left[mate])
            first = self._open(n)
            self.runs.append((big, taken[big], first, n))
            taken[big] += n
            left[big] -= n
            if not sole:
                self.runs.append((mate, taken[mate], first, n))
                taken[mate] += n
                left[mate] -= n
            self._leave(self.capacity - big - (0 if sole else mate), first, n)
            for size in {big, mate} - {None}:
                if left.get(size) == 0:
                    del left[size]
                    sizes.pop(bisect_left(sizes, size))

    def fit_small(self, counts: dict[int, int]) -> None:
        """Best fit, from the largest size down; opens containers only when no gap is wide enough."""
        for size in sorted(counts, reverse=True):
            rank, todo = 0, counts[size]
            while todo:
                at = bisect_left(self.levels, size)
                if at < len(self.levels):
                    gap = self.levels[at]
                    first, count = self.gaps[gap].pop()
                    n = min(count, todo)
                    if n < count:
                        self.gaps[gap].append((first + n, count - n))
                    elif not self.gaps[gap]:
                        self.levels.pop(at)
                    self.runs.append((size, rank, first, n))
                    self._leave(gap - size, first, n)
                else:
                    # Whole containers of this size alone, as many as the items fill, then one for the rest.
                    each = self.capacity // size
                    full = todo // each
                    n = full * each
                    if full:
                        first = self._open(full)
                        for turn in range(each):
                            self.runs.append((size, rank + turn * full, first, full))
                        self._leave(self.capacity - each * size, first, full)
                    else:
                        n = 1
                        first = self._open(1)
                        self.runs.append((size, rank, first, 1))
                        self._leave(self.capacity - size, first, 1)
                rank += n
                todo -= n


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    """Where items of each size go; ``counts`` maps sizes from 1 to ``capacity`` to numbers of items."""
    plan = Plan(capacity)
    plan.match_large({s: n for s, n in counts.items() if 3 * s > capacity and n})
    plan.fit_small({s: n for s, n in counts.items() if 3 * s <= capacity and n})
    return plan


def fill_containers(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container, ``key``, token_start, token_end) for every item; ends are exclusive.

    ``items`` has a unique ``key`` and a ``size``; null and non-positive sizes go nowhere. Only an item larger than
    ``capacity`` is split, into full containers and one rest. An empty table gives no rows. The result does not
    depend on partitioning: ranks follow ``key`` within fixed hash slices.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[key]
    sizes = materialize(items.where(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("long").alias("n")))
    full = sizes.where(F.col("n") >= capacity).select("key", "n", F.expr(f"n div {capacity}").alias("pieces"))
    rest = sizes.select("key", (F.col("n") % capacity).alias("s"), (F.col("n") - F.col("n") % capacity).alias("start")).where("s > 0")
    rest = rest.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(SLICES)).cast("int"))

    # At most capacity x SLICES counts come to the driver, whatever the number of items.
    by_slice = rest.groupBy("s", "slice").count().collect()
    counts: dict[int, int] = defaultdict(int)
    starts: dict[tuple[int, int], int] = {}
    for row in sorted(by_slice):
        starts[row["s"], row["slice"]] = counts[row["s"]]
        counts[row["s"]] += row["count"]
    plan = plan_containers(counts, capacity)
    runs = sorted(plan.runs)
    run_size = np.array([r[0] for r in runs], dtype=np.int64)
    run_rank = np.array([r[1] for r in runs], dtype=np.int64)
    run_first = np.array([r[2] for r in runs], dtype=np.int64)
    shift = np.zeros((capacity, SLICES), dtype=np.int64)
    for (s, slice_), start in starts.items():
        shift[s, slice_] = start
    sent = spark.sparkContext.broadcast((run_size << 40 | run_rank, run_rank, run_first, shift))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ranks, first, offsets = sent.value
        for frame in frames:
            s = frame["s"].to_numpy(np.int64)
            rank = frame["r"].to_numpy(np.int64) - 1 + offsets[s, frame["slice"].to_numpy()]
            at = np.searchsorted(keys, s << 40 | rank, side="right") - 1
            yield pd.DataFrame({"container": first[at] + rank - ranks[at], "key": frame["key"], "token_start": frame["start"], "token_end": frame["start"] + s})

    ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy("s", "slice").orderBy("key")))
    placed = ranked.mapInPandas(place, f"container bigint, key {kind}, token_start bigint, token_end bigint")

    # Full containers are numbered behind the planned ones, in the same slices.
    cut = full.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(SLICES)).cast("int"))
    before = defaultdict(int)
    total = plan.containers
    for row in sorted(cut.groupBy("slice").agg(F.sum("pieces").alias("p")).collect()):
        before[row["slice"]] = total
        total += row["p"]
    offset = F.element_at(F.array(*[F.lit(before[i]).cast("long") for i in range(SLICES)]), F.col("slice") + 1)
    running = F.sum("pieces").over(Window.partitionBy("slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    # Two steps: a window beside a generator would see the generated rows.
    whole = cut.select("key", "pieces", (offset + F.coalesce(running, F.lit(0))).alias("base"))
    whole = whole.select("key", "base", F.explode(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int"))).alias("i"))
    whole = whole.select((F.col("base") + F.col("i")).alias("container"), "key", (F.col("i") * capacity).cast("long").alias("token_start"), ((F.col("i") + 1) * capacity).cast("long").alias("token_end"))
    return placed.unionByName(whole).select("container", F.col("key").alias(key), "token_start", "token_end")
