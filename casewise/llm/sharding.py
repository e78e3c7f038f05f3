"""Sharding by a K-d tree over metadata; DataFrame functions only.

The unit of placement is a text: documents with equal texts stay together, with the language,
source and size of the one with the smallest id. A text whose copies weigh more than a
``HEAVY`` part of a shard is placed document by document, as no law of equal sizes could hold
otherwise, and rows that repeat such a text's id, where they weigh as much, row by row; there are at most shards / HEAVY such
texts and as many such ids.

The tree starts with all units. A node that stands for n shards is cut in two, for n // 2 shards
and the rest, along its widest dimension (language, source, logarithm of the size, each scaled to
16 bits), at the value that gives both sides their part of the bytes. The weighted median is
found by three sums over all units: by the dimension's value, then, among units of the value where
the cut falls, by the upper and the lower half of a 32-bit hash of the text. Each sum has at most
65,536 rows a node and the cut takes one row from it, so all that reaches the driver is the tree,
one row per node. After the last level a node is a shard.

Numbers within a shard (slots) come from counts of small slices, not from one sort of a shard.

Null texts: a text of its own, no bytes, checksum 0. Empty texts are texts. Null languages and
sources count as one more value, null ids sort first. Rows repeated in full stay together unless
heavy, and are then dealt singly; repeated ids do not matter otherwise. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import prepare
from casewise.session import Scratch

SHARDS = 24
# Part of a shard's bytes above which copies of one text are placed singly.
HEAVY = 0.05
OVERHEAD = 8
DIMENSIONS = ["lang_at", "source_at", "size_at"]
SLICE_ROWS, LEAST_SLICES = 10_000, 64


def _name_at(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("binary")) % 65535 + 1, F.lit(0)).cast("int")


def _rows(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.lit(None).cast("string"), F.lit(1))).alias("text_key"),
        _name_at("lang").alias("lang_at"),
        _name_at("source").alias("source_at"),
    )


def _units(rows: DataFrame, shard_bytes: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their unit, units): a unit is a text, or a document of a heavy text, or a row of a heavy document."""
    weighs = (F.sum("size") > HEAVY * shard_bytes) & (F.count(F.lit(1)) > 1)
    # At most shards / HEAVY rows each.
    heavy = F.broadcast(rows.groupBy("text_key").agg(weighs.alias("heavy")).where("heavy"))
    by_text = rows.join(heavy, "text_key", "left")
    repeated = by_text.where("heavy").groupBy("text_key", "doc_id").agg(weighs.alias("repeated")).where("repeated")
    other = F.broadcast(repeated.select(F.col("text_key").alias("of_key"), F.col("doc_id").alias("of_id"), "repeated"))
    same = (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    unit = F.when(F.col("repeated"), F.xxhash64("text_key", "doc_id", "row"))
    unit = unit.when(F.col("heavy"), F.xxhash64("text_key", "doc_id")).otherwise(F.col("text_key"))
    placed = by_text.join(other, same, "left").withColumn("unit", unit)
    first = F.min_by(F.struct("lang_at", "source_at", "size"), F.struct("doc_id", "size", "lang_at", "source_at"))
    units = placed.groupBy("unit").agg(F.sum("size").alias("weight"), first.alias("first")).select(
        "unit",
        "weight",
        F.col("first.lang_at").alias("lang_at"),
        F.col("first.source_at").alias("source_at"),
        F.least(F.floor(F.log2("first.size") * 2048), F.lit(65535)).cast("int").alias("size_at"),
        F.expr("unit & 65535").cast("int").alias("low"),
        F.expr("shiftrightunsigned(unit, 16) & 65535").cast("int").alias("high"),
        F.lit(0).alias("node"),
    )
    return placed, units


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the tree, one row per node; shards bound it."""
    columns = [c.split() for c in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns])
    values = ", ".join("(" + ", ".join(f"{v!r}D" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)
    made = spark.sql(f"SELECT * FROM VALUES {values} AS tree({', '.join(name for name, _ in columns)})")
    return F.broadcast(made.select(*[F.col(name).cast(kind) for name, kind in columns]))


def _cut(units: DataFrame, value, wants: dict[int, float]) -> dict[int, tuple[int, int]]:
    """For each node the value at which the running weight passes what is wanted, and the weight before it."""
    spark = units.sparkSession
    goal = _local(spark, list(wants.items()), "node int, want double")
    sums = units.groupBy("node", value.alias("value")).agg(F.sum("weight").alias("weight"))
    running = F.sum("weight").over(Window.partitionBy("node").orderBy("value"))
    passed = sums.withColumn("upto", running).join(goal, "node").where(F.col("upto") >= F.col("want"))
    ends = passed.groupBy("node").agg(F.min_by(F.struct("value", (F.col("upto") - F.col("weight")).alias("before"), "upto"), "value").alias("end"))
    return {r.node: (r.end.value, r.end.before, r.end.upto) for r in ends.collect()}


def _level(units: DataFrame, open_: dict[int, int]) -> DataFrame:
    """Cut every open node (first shard -> number of shards) and give its units the node they fall into."""
    spark = units.sparkSession
    inside = units.join(_local(spark, [(k,) for k in open_], "node int"), "node")
    spread = inside.groupBy("node").agg(
        F.sum("weight").alias("total"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
    ).collect()
    widest = {r.node: max(range(len(DIMENSIONS)), key=lambda k: (r[DIMENSIONS[k]], -k)) for r in spread}
    wants = {r.node: r.total * (open_[r.node] // 2) / open_[r.node] for r in spread}
    chosen = _local(spark, list(widest.items()), "node int, dimension int")
    inside = inside.join(chosen, "node").withColumn("at", F.element_at(F.array(*DIMENSIONS), F.col("dimension") + 1))
    first = _cut(inside, F.col("at"), wants)
    ends = _local(spark, [(k, v[0]) for k, v in first.items()], "node int, end_at int")
    inside = inside.join(ends, "node").where("at = end_at")
    second = _cut(inside, F.col("high"), {k: wants[k] - v[1] for k, v in first.items()})
    ends = _local(spark, [(k, v[0]) for k, v in second.items()], "node int, end_high int")
    inside = inside.join(ends, "node").where("high = end_high")
    rest = {k: wants[k] - first[k][1] - v[1] for k, v in second.items()}
    third = _cut(inside, F.col("low"), rest)
    # The last value goes to the side that it brings closer to its part.
    rows = [
        (k, widest[k], first[k][0], second[k][0], v[0] + (1 if v[2] - rest[k] < rest[k] - v[1] else 0), k + open_[k] // 2)
        for k, v in third.items()
    ]
    tree = _local(spark, rows, "node int, dimension int, end_at int, end_high int, end_low int, right int")
    at = F.element_at(F.array(*DIMENSIONS), F.col("dimension") + 1)
    left = F.struct(at, "high", "low") < F.struct("end_at", "end_high", "end_low")
    return units.join(tree, "node", "left").select(
        *[c for c in units.columns if c != "node"], F.when(F.col("right").isNull() | left, F.col("node")).otherwise(F.col("right")).alias("node")
    )


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null under this law) of every document.

    With ``target_bytes`` the number of shards is what the bytes ask for.
    """
    prepare(docs.sparkSession)
    rows = Scratch(_rows(docs).withColumn("row", F.monotonically_increasing_id()), "shard-rows").frame
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    placed, units = _units(rows, total / shards)
    held = Scratch(units, "shard-units")
    open_ = {0: shards} if count else {}
    while open_ := {k: n for k, n in open_.items() if n > 1}:
        below = Scratch(_level(held.frame, open_), "shard-units")
        held.discard()
        held = below
        open_ = {k: n for node, whole in open_.items() for k, n in ((node, whole // 2), (node + whole // 2, whole - whole // 2))}
    of_shard = placed.join(held.frame.select("unit", F.col("node").alias("shard")), "unit")
    slices = max(LEAST_SLICES, count // (shards * SLICE_ROWS))
    sliced = Scratch(
        of_shard.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "unit"), F.lit(slices)).cast("int").alias("slice")),
        "shard-slices",
    ).frame
    held.discard()
    counts = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("before")
    )
    number = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32")) - 1
    return (
        sliced.withColumn("number", number)
        .join(before, ["shard", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("number")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
