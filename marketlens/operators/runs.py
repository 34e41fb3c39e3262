"""Queries over the catalog of runs, their effects and downloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.operators.scratch import scratch_table


def active(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("recycle") == 0)


def recycled(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("recycle") == 1)


def set_recycled(runs: DataFrame, chosen: Column, flag: bool) -> DataFrame:
    """Soft delete (or restore) of the chosen runs."""
    return runs.withColumn("recycle", F.when(chosen, F.lit(int(flag))).otherwise(F.col("recycle")))


def visible_users(users: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """Users whose rank is at or above the own rank (theta join with a scalar subquery)."""
    ranked = users.join(ranks.select(F.col("id").alias("rid"), "rank"), "rid")
    own = ranked.filter(F.col("name") == name).agg(F.max("rank")).scalar()
    return ranked.filter(F.col("rank") >= own).select("name", "rank")


def visible_runs(runs: DataFrame, users: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    shown = visible_users(users, ranks, name).select(F.col("name").alias("submitter")).distinct()
    return active(runs).join(shown, "submitter", "left_semi")


def newest(runs: DataFrame, n: int, time: str = "create_time", key: str = "id") -> DataFrame:
    return runs.orderBy(F.col(time).desc(), F.col(key)).limit(n)


def page(runs: DataFrame, offset: int, size: int = 20, time: str = "create_time", key: str = "id") -> DataFrame:
    return runs.orderBy(F.col(time).desc(), F.col(key)).offset(offset).limit(size)


def latest_effects(effects: DataFrame, time: str = "query_time", key: str = "id") -> DataFrame:
    """The newest effect of every run and type.

    A maximum over structs: partial results are merged map-side, so a run with very many
    effects never meets in one task.
    """
    rest = [c for c in effects.columns if c not in ("prom_id", "type")]
    lead = [time, key] + [c for c in rest if c not in (time, key)]
    best = effects.groupBy("prom_id", "type").agg(F.max(F.struct(*lead)).alias("_best"))
    return best.select("prom_id", "type", *[F.col(f"_best.{c}").alias(c) for c in rest])


def unfetched(downloads: DataFrame, user: str, n: int) -> DataFrame:
    """Finished downloads of the user that were not fetched yet, newest first."""
    rows = downloads.filter((F.col("user") == user) & (F.col("status") == 1))
    return newest(rows, n, time="time")


def due(runs: DataFrame, at) -> DataFrame:
    """Waiting runs whose start time has come."""
    return active(runs).filter((F.col("task_status") == 0) & (F.col("start_time") < F.lit(at)))


#: Distinct leaves that may be nested below one root, which is one row.
NESTED_LEAVES = 1_000_000


def nested_tree(rows: DataFrame, levels: Sequence[str], leaf: Sequence[str], most: int = NESTED_LEAVES) -> DataFrame:
    """Path rows to a tree: one row per root, children nested below it.

    Rows are made distinct and written first. A root with more than ``most`` leaves is
    refused before anything is collected: such trees are tables of edges (``tree_edges``).
    """
    names = list(levels)
    rows = scratch_table(rows.select(*names, *leaf).distinct(), "tree")
    largest = rows.groupBy(names[0]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if largest is not None and largest > most:
        raise ValueError(f"{largest} leaves below one root; a row holds at most {most}, use tree_edges")
    item = F.struct(*[F.col(c) for c in (names[-1:] + list(leaf))])
    tree = rows.groupBy(*names[:-1]).agg(F.sort_array(F.collect_list(item)).alias("children"))
    for depth in range(len(names) - 2, 0, -1):
        node = F.struct(F.col(names[depth]), F.col("children"))
        tree = tree.groupBy(*names[:depth]).agg(F.sort_array(F.collect_list(node)).alias("children"))
    return tree


def tree_edges(rows: DataFrame, levels: Sequence[str]) -> DataFrame:
    """The same tree as a table of (level, parent path, node, number of leaves): the form for large trees."""
    names = list(levels)
    paths = [
        F.struct(
            F.lit(i + 1).alias("level"),
            F.concat_ws("/", *names[:i]).alias("parent"),
            F.col(names[i]).cast("string").alias("node"),
        )
        for i in range(len(names))
    ]
    each = rows.select(*names).distinct().select(F.explode(F.array(*paths)).alias("p")).select("p.*")
    return each.groupBy("level", "parent", "node").agg(F.count(F.lit(1)).alias("leaves"))
