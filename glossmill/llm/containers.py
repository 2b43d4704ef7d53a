"""Filling fixed-capacity containers: minimum bin slack by bitset subset sums.

Each container is filled from a window of the waiting items: the largest item opens it, then a subset-sum table over the
multiset of lengths in the window, kept as the bits of one integer, tells every load that can be reached; the highest
one is taken and traced back to counts of each length. The window slides: what is taken is replaced by the next items,
so only the last containers of a partition are filled from what is left.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 1024
#: Items of a partition; containers are numbered within partitions, which are fixed by the data and not by the cluster.
PARTITION_ITEMS, MAX_PARTITIONS = 8192, 20_000


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """Counts of each length whose sum is the largest that fits the room. ``lengths`` descending."""
    reach, steps, mask, full = 1, [], (1 << room + 1) - 1, 1 << room
    for length in lengths:
        if length > room:
            continue
        left, part = counts[length], 1
        while left:  # k equal lengths as 1, 2, 4, ... of them at once
            part = min(part, left)
            if length * part > room:
                part = max(1, room // length)
                left = part
            new = reach | (reach << length * part) & mask
            if new != reach:
                steps.append((length, part, reach))
                reach = new
                if reach & full:
                    break
            left -= part
            part *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += part
            at -= length * part
    return list(taken.items())


class Filler:
    """Streams items in and assigned items out: (item, container number)."""

    def __init__(self, capacity: int, window: int = WINDOW):
        self.capacity, self.window, self.next = capacity, window, 0
        self.waiting: dict[int, list] = defaultdict(list)
        self.count = 0

    def add(self, item, length: int) -> Iterator[tuple]:
        if length == self.capacity:
            yield item, self.next
            self.next += 1
            return
        self.waiting[length].append(item)
        self.count += 1
        if self.count > self.window:
            yield from self._one()

    def _one(self) -> Iterator[tuple]:
        lengths = sorted(self.waiting, reverse=True)
        first = lengths[0]
        yield self._take(first), self.next
        counts = {n: len(x) for n, x in self.waiting.items()}
        for length, k in best_fill(counts, [n for n in lengths if n in counts], self.capacity - first):
            for _ in range(k):
                yield self._take(length), self.next
        self.next += 1

    def _take(self, length: int):
        items = self.waiting[length]
        item = items.pop()
        if not items:
            del self.waiting[length]
        self.count -= 1
        return item

    def end(self) -> Iterator[tuple]:
        while self.count:
            yield from self._one()


def partitions_for(n_items: int) -> int:
    """Number of partitions for so many items."""
    return min(MAX_PARTITIONS, max(1, -(-n_items // PARTITION_ITEMS)))


def fill_all(items: DataFrame, key: str, size: str, specs: DataFrame, window: int = WINDOW, partitions: int | None = None) -> DataFrame:
    """The items filled into containers of every capacity of ``specs`` (``spec_id``, ``capacity_tokens``), a filling each.

    Columns ``spec_id``, ``container_id`` bigint, ``key``, ``piece_no`` int, ``piece_from``, ``piece_to`` bigint
    (half-open, in size units). An item larger than the capacity is cut into pieces: full containers and one rest,
    which shares a container like any other; nothing else is cut. Items of size 0 or null need no room: one row with a
    null container. Repeated keys are items of their own. Capacities that are null or below 1 are an error.

    The sizes are shuffled once, as key and number: items are spread by a hash over partitions whose number depends on
    the number of items only. Each task streams its items in key order with a window of ``window`` waiting ones for
    each capacity, so neither memory nor result depends on the cluster. Only the last containers of a partition have
    a short window. Give ``partitions`` (see
    partitions_for) where counting ``items`` would compute their sizes twice. The specs are few; they are read to the driver, at most 1000.
    """
    caps = [(r[0], r[1]) for r in specs.select("spec_id", "capacity_tokens").orderBy("spec_id").limit(1001).collect()]
    if len(caps) > 1000 or any(c is None or c < 1 for _, c in caps):
        raise ValueError("specs must be at most 1000 positive capacities")
    partitions = partitions_for(items.count()) if partitions is None else partitions
    rows = items.select(F.col(key), F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("__n"))
    rows = rows.repartition(partitions, F.xxhash64(key), F.col("__n")).sortWithinPartitions(key, "__n")
    kind, names = rows.schema[key].dataType, ["spec_id", "container_id", key, "piece_no", "piece_from", "piece_to"]
    schema = T.StructType([T.StructField("spec_id", T.IntegerType()), T.StructField("container_id", T.LongType()), T.StructField(key, kind), T.StructField("piece_no", T.IntegerType()), T.StructField("piece_from", T.LongType()), T.StructField("piece_to", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        fillers = [(s, c, Filler(c, window)) for s, c in caps]
        out: list[tuple] = []
        key_type = None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), key_type, pa.int32(), pa.int64(), pa.int64()))], names=names)
            out.clear()
            return done

        for got in batches:
            key_type = got.schema.field(0).type
            for k, n in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                for spec, capacity, filler in fillers:
                    if n <= 0:
                        out.append((spec, None, k, 1, 0, 0))
                    for no, at in enumerate(range(0, n, capacity), 1):
                        to = min(n, at + capacity)
                        out.extend((spec, base + c, *piece) for piece, c in filler.add((k, no, at, to), to - at))
            if len(out) > 20_000:
                yield batch()
        for spec, _, filler in fillers:
            out.extend((spec, base + c, *piece) for piece, c in filler.end())
        if out:
            yield batch()

    return rows.mapInArrow(fill, schema)
