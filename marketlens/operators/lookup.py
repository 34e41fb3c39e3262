"""Table lookups as joins: exact, and as-of (nearest key at or before / after the probe)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.operators.ordered import FEW_GROUPS, few_or_written, join_keys
from marketlens.operators.places import asof
from marketlens.operators.scratch import scratch_table


def folded(c: Column) -> Column:
    """Key compared without case."""
    return F.lower(c.cast("string"))


def vlookup_exact(probes: DataFrame, probe: str, table: DataFrame, key: str, value: str, place: str, name: str = "found") -> DataFrame:
    """Value of the first row (by ``place``) whose key equals the probe; null where there is none."""
    first = table.groupBy(folded(F.col(key)).alias("_key")).agg(F.min_by(value, place).alias(name))
    return probes.withColumn("_key", folded(F.col(probe))).join(first, "_key", "left").drop("_key")


def hlookup(probes: DataFrame, probe: str, table: DataFrame, names: Sequence[str], row: Column, name: str = "found") -> DataFrame:
    """Lookup along the header: the value of the column named like the probe, in the row that ``row`` picks."""
    line = table.filter(row).select(*names).unpivot([], list(names), "_name", name)
    line = line.select(folded(F.col("_name")).alias("_key"), name)
    return probes.withColumn("_key", folded(F.col(probe))).join(line, "_key", "left").drop("_key")


def match(probes: DataFrame, probe: str, table: DataFrame, key: str, place: str, kind: int = 1, name: str = "position") -> DataFrame:
    """Position of the probe in a list: 0 equal (text without case), 1 largest <=, -1 smallest >=."""
    if kind == 0:
        return vlookup_exact(probes, probe, table, key, place, place, name)
    return asof(probes, probe, table, key, place, name=name, forward=kind == -1)


def index_value(table: DataFrame, place: str, row: int, column: str, name: str = "value") -> DataFrame:
    return table.filter(F.col(place) == row).select(F.col(column).alias(name))


def choose(index: Column, *choices: Column) -> Column:
    """The i-th argument; null outside 1..n."""
    return F.when((index >= 1) & (index <= len(choices)), F.get(F.array(*choices), (index - 1).cast("int")))


def transpose(table: DataFrame, header: str, columns: Sequence[str], new_headers: Sequence[str]) -> DataFrame:
    """Rows become columns: one row per former column, one column per named former row."""
    cells = table.select(F.col(header).cast("string").alias("_row"), *columns).unpivot("_row", list(columns), "field", "_cell")
    return cells.groupBy("field").pivot("_row", list(new_headers)).agg(F.first("_cell"))


#: Entries of one inner index, on either side, that meet in one task.
BLOCK = 10_000
#: Products that one task adds up where one side has few entries.
PRODUCTS_PER_PART = 16_000_000


def matrix_product(left: DataFrame, right: DataFrame, block: int = BLOCK, few: int = FEW_GROUPS) -> DataFrame:
    """Sparse product of (i, j, v) tables: join on the inner index, sum per cell.

    A side with few entries is sent to all tasks, and the rows (or columns) of the other
    side are kept together, so the products are added up where they are made. Otherwise an
    inner index with many entries is cut into blocks of rows and blocks of columns, and each
    is repeated along the other axis, so that no index is the work of one task.
    """
    a = scratch_table(left.select("i", F.col("j").alias("k"), F.col("v").alias("a")), "left")
    b = scratch_table(right.select(F.col("i").alias("k"), "j", F.col("v").alias("b")), "right")
    for long, short, kept in ((a, b, "i"), (b, a, "j")):
        if short.limit(few + 1).count() <= few:
            return _with_few(long, short, kept)
    return _in_blocks(a, b, block)


def _with_few(long: DataFrame, few: DataFrame, kept: str, products_per_part: int | None = None) -> DataFrame:
    """Product with a side of few entries; what has the same ``kept`` index on the long side meets in one task.

    The number of tasks follows the number of products. A kept index with more products than
    one task may have is spread, and its sums are added.
    """
    products_per_part = products_per_part or PRODUCTS_PER_PART
    made = long.join(F.broadcast(few.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))), "k")
    total = made.agg(F.sum("_n")).first()[0] or 0
    parts = max(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // products_per_part))
    cells = lambda rows, *on: rows.join(F.broadcast(few), "k").groupBy(*on).agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    plain = cells(long.repartition(parts, kept), "i", "j")
    if total <= products_per_part:
        return plain
    heavy = made.groupBy(kept).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > products_per_part)
    heavy, held = few_or_written(heavy.select(kept, F.ceil(F.col("_n") / products_per_part).cast("int").alias("_parts")), "heavy")
    if held and heavy.isEmpty():
        return plain
    spread = join_keys(long, F.broadcast(heavy) if held else heavy, [kept], "left")
    spread = spread.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    summed = cells(spread.repartition(parts, kept, "_salt"), "i", "j", "_salt")
    return summed.groupBy("i", "j").agg(F.sum("v").cast(plain.schema["v"].dataType).alias("v"))


def _in_blocks(a: DataFrame, b: DataFrame, block: int) -> DataFrame:
    sizes = a.groupBy("k").agg(F.count(F.lit(1)).alias("_a")).join(b.groupBy("k").agg(F.count(F.lit(1)).alias("_b")), "k")
    large = sizes.filter((F.col("_a") > block) | (F.col("_b") > block))
    blocks, few = few_or_written(large.select("k", F.ceil(F.col("_a") / block).cast("int").alias("_rows"), F.ceil(F.col("_b") / block).cast("int").alias("_columns")), "blocks")
    if few and blocks.isEmpty():
        joined = a.join(b, "k")
    else:
        blocks = F.broadcast(blocks) if few else blocks
        part = lambda of, count: F.pmod(F.xxhash64(of), F.coalesce(count, F.lit(1))).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1))
        a = a.join(blocks, "k", "left").withColumn("_i", part("i", "_rows")).withColumn("_j", every("_columns")).drop("_rows", "_columns")
        b = b.join(blocks, "k", "left").withColumn("_j", part("j", "_columns")).withColumn("_i", every("_rows")).drop("_rows", "_columns")
        joined = a.join(b, ["k", "_i", "_j"])
    return joined.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
