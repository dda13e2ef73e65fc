"""Shards through fixed virtual slots and a versioned slot map, in built-in expressions.

Records are hashed by their text into `SLOTS` slots, so copies of a text share a slot.
A slot that holds too many bytes or rows (a hot text) is dealt out again over all slots
by doc_id and the record's number, so equal rows part too. Bytes are summed per slot, and the slots, heaviest first, go to the lightest
shard. The map is a table of SLOTS rows with a version; `rebalance` edits it by moving
as few slots as it takes and returns the next version.

The law is `bytes`: shard sizes differ by less than about one small slot. A record's
position in its shard is the base of its slot there plus its rank in the slot, so no
task orders a whole shard. Null text counts one byte; null doc_ids are hashed like any
value; repeated rows keep their own positions; other columns are ignored; an empty
table gives no rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollspan.session import cut

SLOTS = 4096


def digests(docs):
    """Written table: doc_id, size, text_crc32 and the text's hash per record."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return cut(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("number"),  # fixed once it is written
        )
    )


def with_slots(records, shards, slots=SLOTS):
    """Add `virtual_slot`; records of a hot slot are hashed again with doc_id and number."""
    slot = F.pmod("key", F.lit(slots)).cast("int")
    rows = records.withColumn("virtual_slot", slot)
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = Window.partitionBy()  # of at most `slots` rows
    large = F.col("bytes") > F.sum("bytes").over(every) / (4 * shards)
    many = F.col("n") > F.greatest(F.lit(64), F.sum("n").over(every) / 256)
    hot = sums.withColumn("_hot", large | many).filter("_hot").select("virtual_slot", "_hot")
    again = F.pmod(F.xxhash64("doc_id", "key", "number", F.lit("slot")), F.lit(slots)).cast("int")
    return rows.join(F.broadcast(hot), "virtual_slot", "left").select(  # at most `slots` rows
        "doc_id",
        "size",
        "text_crc32",
        "key",
        "number",
        F.when(F.col("_hot"), again).otherwise(F.col("virtual_slot")).alias("virtual_slot"),
    )


def slot_sizes(records):
    """Bytes and rows per slot, at most SLOTS rows."""
    return records.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")
    )


def _fold(sizes, carried, start, step):
    """Fold the slots, heaviest first, over a state of shard loads and placements."""
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", *carried))
    )
    one = sizes.agg(ordered.alias("ordered"), F.sum("bytes").alias("total"))
    placed = F.aggregate("ordered", start, step)
    return one.select(F.explode(F.arrays_zip("ordered", placed["out"].alias("out"))).alias("z"))


def _add(loads, at, value):
    return F.transform(loads, lambda x, i: F.when(i == at, x + value).otherwise(x))


def build_map(sizes, shards):
    """Version 1: every slot, heaviest first, to the lightest shard."""

    def step(state, slot):
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        return F.struct(
            _add(state["loads"], lightest, -slot["minus"]).alias("loads"),
            F.concat(state["out"], F.array(lightest.cast("int"))).alias("out"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.expr("cast(array() as array<int>)").alias("out"),
    )
    return _fold(sizes, [], start, step).select(
        F.lit(1).alias("version"),
        F.lit(shards).alias("shards"),
        F.col("z.ordered.virtual_slot").alias("virtual_slot"),
        F.col("z.out").alias("shard"),
    )


def rebalance(slot_map, sizes, shards):
    """The next version for new sizes or more shards; slots move only if that helps.

    A slot leaves its shard if the shard stays at its fair share without it and the
    lightest shard has room. With one shard more, slots move only into the new one.
    """
    known = slot_map.select("version", "virtual_slot", "shard")
    rows = known.join(sizes, "virtual_slot", "left").fillna(0, ["bytes", "n"])
    every = Window.partitionBy()  # of at most SLOTS rows
    held = [F.sum(F.when(F.col("shard") == s, F.col("bytes")).otherwise(0)) for s in range(shards)]
    rows = rows.withColumn("loads", F.array(*[x.over(every) for x in held])).withColumn(
        "share", F.sum("bytes").over(every) / shards
    )

    def step(state, slot):
        size = -slot["minus"]
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        room = F.array_min(state["loads"]) + size <= slot["share"]
        spare = F.get(state["loads"], slot["shard"]) - size >= slot["share"]
        target = F.when(room & spare, lightest.cast("int")).otherwise(slot["shard"])
        moved = _add(_add(state["loads"], slot["shard"], -size), target, size)
        return F.struct(
            moved.alias("loads"), F.concat(state["out"], F.array(target)).alias("out")
        )

    carried = ["shard", "share", "loads", "version"]
    start = F.struct(
        F.get(F.col("ordered"), 0)["loads"].alias("loads"),
        F.expr("cast(array() as array<int>)").alias("out"),
    )
    return _fold(rows, carried, start, step).select(
        (F.col("z.ordered.version") + 1).alias("version"),
        F.lit(shards).alias("shards"),
        F.col("z.ordered.virtual_slot").alias("virtual_slot"),
        F.col("z.out").alias("shard"),
    )


def place(records, slot_map, sizes):
    """Shard and gapless position of every record under a map."""
    before = (
        Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = slot_map.join(sizes, "virtual_slot").select(
        "virtual_slot",
        "shard",
        F.col("version").alias("map_version"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
    )
    rank = F.row_number().over(
        Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "key", "number")
    )
    return (
        records.withColumn("_rank", rank)
        .join(F.broadcast(bases), "virtual_slot")  # at most SLOTS rows
        .withColumn("slot", (F.col("base") + F.col("_rank") - 1).cast("long"))
    )


def shard_documents(docs, shards=16, slots=SLOTS):
    """Every record with its shard, position there, virtual slot and the map's version."""
    records = with_slots(digests(docs), shards, slots)
    sizes = cut(slot_sizes(records))
    slot_map = cut(build_map(sizes, shards))
    return place(records, slot_map, sizes).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
