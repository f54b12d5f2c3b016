"""Sharding over fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.frames import without
from textloom.llm.scratch import Scratch

SLOTS = 4096
OVERHEAD = 8  # bytes of a record beside its text
CELL_ROWS = 65_536  # rows that are numbered together
HOT_SLOTS = 2  # an id with the bytes of so many mean slots is spread over all of them


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each virtual slot. Edited into a new version, never in place."""

    version: int
    shards: int
    owners: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, o) for s, o in enumerate(self.owners)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table of maps at ``path``."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """One version of the map, the latest unless given."""
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).collect()  # one row per slot
        owners = {r["virtual_slot"]: r["shard"] for r in rows}
        return SlotMap(version, rows[0]["shards"], tuple(owners[s] for s in range(len(owners))))


def with_slots(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> DataFrame:
    """``docs`` with ``size`` and ``virtual_slot``.

    The slot is a hash of the id alone, or of the text where there is no id.
    The size is the UTF-8 length of the text plus OVERHEAD; null counts none.
    """
    text = F.col(text_col).cast("binary")
    return docs.withColumns(
        {
            "size": (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long"),
            "virtual_slot": F.pmod(_slot_key(id_col, text_col), F.lit(slots)).cast("int"),
        }
    )


def _slot_key(id_col: str, text_col: str) -> Column:
    key = F.coalesce(F.xxhash64(F.when(F.col(id_col).isNotNull(), F.col(id_col))), F.lit(0))
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(key)


def _spread(
    slotted: DataFrame, id_col: str, text_col: str, slots: int, cell_rows: int
) -> tuple[DataFrame, int]:
    """``slotted`` with ``__copy``, rows of hot ids dealt to all slots; and the number of rows.

    Only slots with the bytes of HOT_SLOTS mean slots or with more than
    ``cell_rows`` rows can hold a hot id, so only their rows are grouped by id.
    The rows of hot ids are written once with a number each, so that what
    counts them and what numbers them sees the same rows. Hot ids are fewer than
    ``slots`` and one for ``cell_rows`` rows, a bound for their broadcast.
    """
    sums = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    loads = sums.collect()  # one row per slot
    rows = sum(r["n"] for r in loads)
    limit = HOT_SLOTS * sum(r["b"] for r in loads) // slots
    full = [r["virtual_slot"] for r in loads if r["b"] > limit or r["n"] > cell_rows]
    plain = slotted.withColumn("__copy", F.lit(0).cast("long"))
    if not full:
        return plain, rows
    keyed = slotted.withColumn("__hot", _slot_key(id_col, text_col))
    ids = keyed.filter(F.col("virtual_slot").isin(full)).groupBy("__hot").agg(
        F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")
    )
    hot = ids.filter((F.col("n") > 1) & ((F.col("b") > limit) | (F.col("n") > cell_rows))).select("__hot")
    scratch = Scratch(slotted.sparkSession, "shards")
    hot = scratch.table(hot, "hot")
    if hot.isEmpty():
        scratch.close()
        return plain, rows
    copies = scratch.table(
        keyed.join(F.broadcast(hot), "__hot", "left_semi").withColumn("__copy", F.monotonically_increasing_id()),
        "copies",
    )
    slot = F.pmod(F.xxhash64("__hot", "__copy"), F.lit(slots)).cast("int")
    dealt = copies.withColumn("virtual_slot", slot).select(*plain.columns)
    others = keyed.join(F.broadcast(hot), "__hot", "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    return others.select(*plain.columns).unionAll(dealt), rows


def slot_loads(slotted: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes in every slot; the result has one number per slot whatever the input."""
    loads = [0] * slots
    for row in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():
        loads[row["virtual_slot"]] = row["b"]
    return loads


def first_map(loads: list[int], shards: int) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    owners = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda s: (-loads[s], s)):
        held, shard = heapq.heappop(heap)
        owners[slot] = shard
        heapq.heappush(heap, (held + loads[slot], shard))
    return SlotMap(1, shards, tuple(owners))


def rebalance(
    old: SlotMap, loads: list[int], shards: int | None = None, tolerance: float = 0.02
) -> SlotMap:
    """The next version: only as many slots move as the new loads or shards ask for.

    Slots of shards that no longer exist go first; then the fullest shard gives
    the emptiest the slot that brings the two nearest together, until none helps
    or they differ by no more than ``tolerance`` of a shard's mean.
    """
    shards = shards or old.shards
    owners = list(old.owners)
    held = [0] * shards
    mine: list[set[int]] = [set() for _ in range(shards)]
    homeless = []
    for slot, owner in enumerate(owners):
        if owner < shards:
            held[owner] += loads[slot]
            mine[owner].add(slot)
        else:
            homeless.append(slot)

    def give(slot: int, to: int) -> None:
        owners[slot] = to
        held[to] += loads[slot]
        mine[to].add(slot)

    for slot in sorted(homeless, key=lambda s: (-loads[s], s)):
        give(slot, min(range(shards), key=lambda s: (held[s], s)))
    while True:
        full = max(range(shards), key=lambda s: (held[s], -s))
        bare = min(range(shards), key=lambda s: (held[s], s))
        gap = held[full] - held[bare]
        fit = [s for s in mine[full] if 0 < loads[s] < gap]
        if not fit or gap <= tolerance * sum(held) / shards:
            break
        slot = min(fit, key=lambda s: (abs(gap - 2 * loads[s]), s))
        mine[full].remove(slot)
        held[full] -= loads[slot]
        give(slot, bare)
    return SlotMap(old.version + 1, shards, tuple(owners))


def assign(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    using: SlotMap | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``docs`` with ``size, virtual_slot, map_version, shard`` and ``slot``.

    The map is built from the bytes per slot, or ``using`` is taken as it is.
    ``slot`` is the row's place in its shard, from 0 without gaps. Rows are
    numbered inside cells of a virtual slot of about ``cell_rows`` rows, and
    cells after each other, so no task holds a shard. Rows with equal ids share
    a slot and are numbered in the order of their texts; but where they are more
    than ``cell_rows`` or have the bytes of two mean slots, they are dealt to all
    slots. Rows without an id go by their text. Columns with the names of added
    ones are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, ("size", "virtual_slot", "map_version", "shard", "slot"))
    slotted, rows = _spread(
        with_slots(docs, id_col, text_col, slots), id_col, text_col, slots, cell_rows
    )
    mapped = using or first_map(slot_loads(slotted, slots), shards)
    cells = 1 + rows // (slots * cell_rows)
    text_key = F.xxhash64(F.col(text_col))
    cell = F.pmod(F.xxhash64(F.lit(1), F.col(id_col), text_key, "__copy"), F.lit(cells)).cast("int")
    slotted = slotted.withColumn("__cell", cell).withColumn("__text", text_key)
    # One row per slot: ``slots`` rows.
    owner = F.broadcast(
        mapped.frame(spark).select("virtual_slot", F.col("version").alias("map_version"), "shard")
    )
    counts = slotted.groupBy("virtual_slot", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = (
        Window.partitionBy("shard")
        .orderBy("virtual_slot", "__cell")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = counts.join(owner, "virtual_slot").select(
        "virtual_slot", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")
    )
    nth = F.row_number().over(
        Window.partitionBy("virtual_slot", "__cell").orderBy(F.col(id_col), "__text", "__copy")
    )
    numbered = slotted.withColumn("__nth", nth)
    placed = numbered.join(bases, ["virtual_slot", "__cell"]).join(owner, "virtual_slot")
    return placed.select(
        *[c for c in docs.columns], "size", "virtual_slot", "map_version", "shard",
        (F.col("__base") + F.col("__nth") - 1).cast("long").alias("slot"),
    )
