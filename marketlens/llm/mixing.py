"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key ``-ln(u) / weight`` (Efraimidis and Spirakis): u is
a hash of id and text, so reruns agree, and the weight is the document's quality. In the
order of that key a source's documents form a weighted random order without
replacement. A source's target is met by complete epochs first: every document is taken
as often as the target holds the whole source. What then remains of the target is
filled by a prefix of the order, up to the prefix whose total is nearest to it.

The order is never laid out as a whole. Keys are cut into ``BINS`` ranges; totals of the
ranges give the range in which the remainder ends, and only documents of that range are
sorted, so a source with a third of all rows is spread over all tasks.

Targets: sources in order of code points (null last) have the weights 3, 1, 2, repeating,
and share a budget of ``share`` times all sizes. A target never exceeds ``most`` times
its source's size; what is above goes to the other sources by weight until no target is
above.

Defined results: size counts words (runs without white space), null texts have size 0; a
null source is a source of its own; repeated rows are documents of their own; documents
of size 0 are not taken; columns of the input with the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marketlens.operators.ordered import join_keys, numbered
from marketlens.operators.scratch import scratch_table
from marketlens.tables import Tables

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BINS = 1 << 12
#: Signs that count against a text's quality, next to its words.
SYMBOLS = "#*$%&|<>!"


def size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def quality(text: Column, words: Column) -> Column:
    """Weight between 0 and 1: lower with more symbols for each word."""
    body = F.coalesce(text, F.lit(""))
    symbols = F.regexp_count(body, F.lit(f"[{SYMBOLS}]"))
    return (1.0 + words) / (1.0 + words + symbols)


def uniform(key: Column, text: Column) -> Column:
    """A number in (0, 1) from the MD5 of id and text."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def with_key(docs: DataFrame) -> DataFrame:
    """Adds ``_size``, ``_key`` and ``_bin`` to the documents."""
    rows = docs.withColumn("_size", size(F.col("text")))
    rows = rows.withColumn("_key", -F.log(uniform(F.col("doc_id"), F.col("text"))) / quality(F.col("text"), F.col("_size")))
    return rows.withColumn("_bin", F.floor((1 - F.exp(-F.col("_key"))) * BINS).cast("int"))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key, bin``: what the sampling needs, without the texts."""
    return with_key(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.col("_size").alias("size"), F.col("_key").alias("key"), F.col("_bin").alias("bin"))


def targets(rows: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, weight, target``, one row per source."""
    sources = scratch_table(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    place = numbered(sources, [F.col("source").isNull(), "source"], name="place")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int"))
    sources = scratch_table(place.select("source", "source_size", weight.alias("weight")), "source-weights")
    top = most * F.col("source_size")
    # a level per unit of weight rises as sources reach their top and leave the sharing
    level, above, budget = None, 0, None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > top
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("done"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        budget = share * (row["all"] or 0)
        if level is not None and row["n"] == above or not row["open"]:
            break
        level, above = (budget - most * row["done"]) / row["open"], row["n"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level or 0.0), top).cast("double"))


def plan(rows: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, weight, target, epochs, cut``, one row per source.

    ``cut`` is the last (key, id, size) of the order that is taken once more than the
    complete epochs. Repeated rows of one document fall on the same side of it.
    """
    sources = targets(rows, share, most)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    sources = scratch_table(sources.withColumn("remainder", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-sources")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    bins = join_keys(bins.withColumn("before", F.coalesce(F.sum("in_bin").over(earlier), F.lit(0))), sources.select("source", "remainder"), ["source"])
    last = bins.filter("before <= remainder").groupBy("source").agg(F.max(F.struct("bin", "before", "remainder")).alias("last")).select("source", "last.*")
    tied = rows.groupBy("source", "bin", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"))
    inside = join_keys(tied, scratch_table(last, "mix-ends"), ["source", "bin"])
    inside = inside.withColumn("total", F.col("rows") * F.col("size"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)  # the rows of one bin
    inside = inside.withColumn("upto", F.col("before") + F.sum("total").over(order))
    start = F.col("upto") - F.col("total")
    taken = inside.filter((F.col("upto") <= F.col("remainder")) | (start <= F.col("remainder")) & (F.col("upto") - F.col("remainder") <= F.col("remainder") - start))
    cut = taken.groupBy("source").agg(F.max(F.struct("key", "doc_id", "size")).alias("cut"))
    done = join_keys(join_keys(sources, last.select("source", F.col("bin").alias("last_bin")), ["source"], "left"), cut, ["source"], "left")
    return done.drop("remainder")


def _copies() -> Column:
    """How often a document is taken, from its ``_size, _key, _bin`` and the plan of its source."""
    here = F.struct(F.col("_key").alias("key"), F.col("doc_id"), F.col("_size").alias("size"))
    extra = F.when(F.col("_bin") < F.col("last_bin"), 1).when((F.col("_bin") == F.col("last_bin")) & (here <= F.col("cut")), 1).otherwise(0)
    return F.when(F.col("_size") == 0, 0).otherwise(F.col("epochs") + extra).cast("bigint")


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, source, size, weight, source_size, target, copies, taken`` for every document."""
    rows = scratch_table(measured(docs), "mix-rows")
    made = scratch_table(plan(rows, share, most), "mix-plan")
    placed = join_keys(rows.withColumnsRenamed({"size": "_size", "key": "_key", "bin": "_bin"}), made, ["source"])
    return placed.select(
        "doc_id", "source", F.col("_size").alias("size"), "weight", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("_size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    made = scratch_table(plan(scratch_table(measured(docs), "mix-rows"), share, most), "mix-plan")
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    placed = join_keys(with_key(rows), made, ["source"]).withColumn("_copies", _copies().cast("int"))
    repeated = placed.filter("_copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select("_row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    done = mix(Tables(spark, folder).documents)
    return done.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')) AS symbols,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents
), keyed AS (
  SELECT doc_id, source, size, -ln(u) / ((1.0::DOUBLE + size) / (1.0::DOUBLE + size + symbols)) AS key FROM rows
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM keyed GROUP BY source
), levels AS (
  -- sources by the level at which they reach twice their size; the level of the first that does not is the common one
  SELECT *, 2.0::DOUBLE * source_size / weight AS top_level,
    sum(source_size) OVER () AS everything,
    coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
    sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open
  FROM sources
), common AS (
  SELECT arg_min((1.5::DOUBLE * everything - 2.0::DOUBLE * done) / open, top_level) FILTER (WHERE (1.5::DOUBLE * everything - 2.0::DOUBLE * done) / open <= top_level) AS level FROM levels
), plan AS (
  SELECT source, source_size, weight, least(weight * coalesce(level, 0), 2.0::DOUBLE * source_size) AS target FROM sources, common
), ordered AS (
  SELECT k.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY k.source, key, doc_id, size) AS tied
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
), decided AS (
  SELECT *, target - epochs * source_size AS remainder FROM ordered
), counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(epochs AS BIGINT) END + CASE WHEN size > 0 AND (upto <= remainder OR (upto - tied <= remainder AND upto - remainder <= remainder - (upto - tied))) THEN 1 ELSE 0 END AS copies FROM decided
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM counted
"""
