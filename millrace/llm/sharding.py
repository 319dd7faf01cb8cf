"""Sharding through fixed virtual slots, with DataFrame functions only.

A record's virtual slot is a hash of its id and text, modulo SLOTS. Bytes are added up for
each slot, and a versioned table, kept by SlotMap, maps every slot to a shard. Rebalancing edits that map:
slots, the largest first, stay where they are while their shard has room, and go to the emptiest shard
otherwise; only slots move, records keep theirs. The table has SLOTS rows at every size of
the input, so it may be broadcast and folded in one task.

Law: `bytes`. A record's place in its shard is the number of records in the shard's slots
before its own, plus its place in its slot. In a slot records stand in the order of a second hash, then of id, CRC and size;
a slot is cut into ranges of that hash of about RANGE records, as many as the data needs, whose counts give where each
begins. So no task sorts more than a range, and the places are the same with any number of ranges.

Groups of equal texts are spread over slots, as ids differ. Defined results: a null text has
size 1 and the CRC of the empty string; null and repeated ids are placed like any other; rows that are equal in
id and text are added up before they move and get places one after the other, PIECE of them in a task; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import common

SLOTS, SHARDS = 4096, 16
RANGE, PIECE = 200_000, 100_000
SIZED = ("doc_id", "size", "text_crc32")


class SlotMap:
    """Versions of the map (virtual_slot, shard) in a folder, one folder each; a version is never written again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The last version whose write was finished; -1: none."""
        fs, at = common.hadoop_fs(self.spark, self.path)
        if not fs.exists(at):
            return -1
        done = [str(x.getPath()) for x in fs.listStatus(at) if fs.exists(common.hadoop_fs(self.spark, f"{x.getPath()}/_SUCCESS")[1])]
        return max((int(x.rpartition("=")[2]) for x in done), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        """(version, virtual_slot, shard), of the last version unless another is named."""
        v = self.version() if version is None else version
        rows = self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={v}")
        return rows.select(F.lit(v).alias("version"), "virtual_slot", "shard")

    def write(self, rows: DataFrame) -> DataFrame:
        v = self.version() + 1
        rows.select("virtual_slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={v}")
        return self.read(v)

    def edit(self, slots: DataFrame, shards: int = SHARDS, n_slots: int = SLOTS) -> DataFrame:
        """Writes the version that rebalances the last one to the bytes of `slots`; the first use starts from slots in turn."""
        if self.version() < 0:
            self.write(first_map(self.spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot")), shards))
        return self.write(rebalanced(self.read(), slots, shards))


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot and second hash of each row; one scan, no exchange."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text"))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), (number(1) % slots).cast("int").alias("virtual_slot"), number(9).alias("h"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def first_map(slots: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0: slots in turn. slots: slot_bytes()."""
    return slots.select(F.lit(0).alias("version"), "virtual_slot", (F.col("virtual_slot") % shards).alias("shard"))


def rebalanced(current: DataFrame, slots: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map: (version, virtual_slot, shard). A fold over at most SLOTS slots.

    shards may exceed the number in current; new shards then take slots from full ones."""
    both = current.join(F.broadcast(slots), "virtual_slot", "left_outer").na.fill(0, ["bytes"])  # SLOTS rows at most
    to = f"if(a.loads[x.shard] + x.bytes <= a.room, x.shard, cast(array_position(a.loads, array_min(a.loads)) - 1 as int))"
    fold = f"""aggregate(s,
        named_struct('room', room, 'loads', array_repeat(0L, {shards}), 'map', cast(array() as array<struct<virtual_slot: int, shard: int>>)),
        (a, x) -> named_struct('room', a.room, 'loads', transform(a.loads, (l, i) -> if(i = {to}, l + x.bytes, l)), 'map', concat(a.map, array(named_struct('virtual_slot', x.virtual_slot, 'shard', {to})))),
        a -> a.map)"""
    one = both.agg(F.max("version").alias("version"), F.expr(f"cast(ceil(sum(bytes) / {shards}) as long)").alias("room"), F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "shard")), asc=False).alias("s"))
    return one.select((F.col("version") + 1).alias("version"), F.expr(f"inline({fold})"))


def in_order(rows: DataFrame, starts: DataFrame, n: int, slots: int = SLOTS, size: int = 0) -> DataFrame:
    """rows (sized) with `place`, from 0 in the order of slots' starts. starts: virtual_slot, before; n: number of rows."""
    bits = max(0, math.ceil(math.log2(max(1, n / (slots * (size or RANGE))))))
    own = ["virtual_slot", "range"]
    equal = rows.groupBy("virtual_slot", "h", *SIZED).agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.shiftright("h", 32 - bits))
    counts = common.stored(rows.groupBy("virtual_slot", F.shiftright("h", 32 - bits).alias("range")).agg(F.count(F.lit(1)).alias("n")), "ranges")
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.join(F.broadcast(starts), "virtual_slot").select("virtual_slot", "range", (F.col("before") + earlier(["virtual_slot"], ["range"])).alias("begins"))  # SLOTS rows
    groups = equal.withColumn("within", earlier(own, ["h", *SIZED])).join(begins, own)
    groups = common.stored(groups.select("virtual_slot", *SIZED, (F.col("begins") + F.col("within")).alias("first"), "n"), "groups")
    every = lambda df, c, n, step: df.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(step).cast("long"))))
    few = every(groups.where(F.col("n") <= PIECE), "k", F.col("n"), 1).withColumn("place", F.col("first") + F.col("k"))
    # many equal rows: pieces of them go to tasks of their own
    many = every(groups.where(F.col("n") > PIECE), "piece", F.col("n"), PIECE).repartition("first", "piece")
    many = every(many, "k", F.least(F.col("n") - F.col("piece"), F.lit(PIECE)), 1).withColumn("place", F.col("first") + F.col("piece") + F.col("k"))
    return few.select("virtual_slot", *SIZED, "place").union(many.select("virtual_slot", *SIZED, "place"))


def placed(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard (null: law `bytes`), virtual_slot, version.

    store: the folder of the map, whose next version this writes; without one a map of this call's own is begun."""
    spark = docs.sparkSession
    rows = common.stored(sized(docs, slots), "sized")
    sizes = common.stored(slot_bytes(rows), "slots")
    kept = SlotMap(spark, store or common.new_path(spark, "map")).edit(sizes, shards, slots)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    table = common.stored(kept.join(F.broadcast(sizes), "virtual_slot").select("version", "virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    return in_order(rows, table.select("virtual_slot", "before"), n, slots).join(F.broadcast(table.drop("before")), "virtual_slot").select(
        *SIZED, F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version",
    )


def sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """placed() in DuckDB's SQL: CRC by its table of 256 remainders, worked out from the polynomial, and the same fold."""
    to = "CASE WHEN a.loads[x.shard + 1] + x.bytes <= x.room THEN x.shard ELSE list_position(a.loads, list_min(a.loads)) - 1 END"
    return f"""
    WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    d AS (SELECT doc_id, coalesce(text, '') AS s, ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 8))::BIGINT % {slots} AS virtual_slot, ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 9, 8))::BIGINT AS h FROM documents),
    sized AS (SELECT doc_id, strlen(s) + 1 AS size, virtual_slot, h, xor(list_reduce(list_concat([4294967295], list_transform(range(1, 2 * strlen(s), 2), lambda i: ('0x' || substr(hex(encode(s)), i, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32 FROM d, tab),
    slots AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n, virtual_slot % {shards} AS shard FROM sized GROUP BY virtual_slot),
    ordered AS (SELECT list(struct_pack(virtual_slot := virtual_slot, bytes := bytes, shard := shard, room := room) ORDER BY bytes DESC, virtual_slot DESC) AS s FROM slots, (SELECT ceil(sum(bytes) / {shards})::BIGINT AS room FROM slots)),
    folded AS (SELECT list_reduce(s, lambda a, x: struct_pack(loads := list_transform(a.loads, lambda l, i: CASE WHEN i - 1 = {to} THEN l + x.bytes ELSE l END), map := list_append(a.map, struct_pack(virtual_slot := x.virtual_slot, shard := ({to})::BIGINT))),
        struct_pack(loads := list_transform(range({shards}), lambda i: 0::BIGINT), map := []::STRUCT(virtual_slot BIGINT, shard BIGINT)[])) AS f FROM ordered),
    kept AS (SELECT m.virtual_slot, m.shard FROM (SELECT unnest(f.map) AS m FROM folded)),
    placed AS (SELECT virtual_slot, kept.shard, coalesce(sum(n) OVER (PARTITION BY kept.shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM kept JOIN slots USING (virtual_slot))
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, before + row_number() OVER (PARTITION BY virtual_slot ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard, virtual_slot, 1 AS version
    FROM sized JOIN placed USING (virtual_slot)"""
