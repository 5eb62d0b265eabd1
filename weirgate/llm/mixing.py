"""Operator 8: mixing sources to target weights, with DataFrame functions only.

Each document has an expected number of copies, so that a source's expected
words are its target: a level of the source times a weight that grows with the
document's length, as longer texts give longer contexts, up to the most copies
a document may have. The whole part is taken for certain. For the rest, documents
are ranked by Pareto order sampling: random odds u / (1 - u) divided by the odds
p / (1 - p) of inclusion; the first ones are taken until the source's words are
reached. Random numbers come from a digest of the id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, whole_rows

#: Weights of the sources in order, repeating; the share of all words to take; copies of a document at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Cells of the ranks of a source. Words are summed by cell; only the cell where the target falls is sorted.
CELLS = 4096


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(text.isNull() | (bare == ""), 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``, one row a source.

    Sources in order of code point, null last, get the weights in turn. A
    target stops at ``most`` times the source's size; the excess goes to the
    others by weight. That is least(most * size, level * weight) with one level
    for all: the first in order of size by weight that leaves no other above.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.select("*", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint").alias("_w"))
    full = Window.orderBy((F.col("source_size") / F.col("_w")), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    sums = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("_all"),
        F.sum("_w").over(every).alias("_weights"),
        F.coalesce(F.sum("source_size").over(full), F.lit(0)).alias("_full"),
        F.coalesce(F.sum("_w").over(full), F.lit(0)).alias("_full_w"),
    )
    level = (share * F.col("_all") - most * F.col("_full")) / (F.col("_weights") - F.col("_full_w"))
    fits = sums.select("*", level.alias("_level"), (level * F.col("_w") <= most * F.col("source_size")).alias("_fits"))
    chosen = fits.select("*", F.min(F.when(F.col("_fits"), F.struct("_full", "_full_w", "_level"))).over(every)["_level"].alias("_l"))
    top = F.col("source_size").cast("double") * most
    return chosen.select("source", "source_size", F.when(F.col("_l").isNull(), top).otherwise(F.least(top, F.col("_l") * F.col("_w"))).alias("target"))


def _uniform(doc_id: Column, seed: str) -> Column:
    """Between 0 and 1, neither included; 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(2**52)


def _odds(doc_id: Column, seed: str) -> Column:
    """Odds over odds of inclusion, for documents with an expected number of copies that is no whole number."""
    u, p = _uniform(doc_id, seed), F.col("_expected") - F.floor("_expected")
    return F.when(p > 0, u / (1 - u) / (p / (1 - p)))


def length_class(size: Column) -> Column:
    """The binary digits of a number of words: a document's weight."""
    return F.length(F.bin(size))


def expected_copies(by_source: DataFrame, classes: DataFrame, most: int = MOST) -> DataFrame:
    """``_s, source_size, target, _class, _expected, _words`` for each source and length class.

    ``least(most, level * class)`` copies of each document, with the level for
    which a source's expected words are its target: the first, from the longest
    class on, that leaves no class above ``most`` but those before it.
    """
    longer = Window.partitionBy("_s").orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("_s").orderBy(F.desc("_class")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("_s")
    both = classes.join(by_source, F.col("_s").eqNullSafe(F.col("source")))
    level = (F.col("target") - most * F.coalesce(F.sum("_words").over(longer), F.lit(0))) / F.nullif(F.sum(F.col("_words") * F.col("_class")).over(rest), F.lit(0))
    fits = both.withColumn("_level", level).withColumn("_fits", (F.col("_level") >= 0) & (F.col("_level") * F.col("_class") <= most))
    chosen = fits.withColumn("_l", F.max(F.when(F.col("_fits"), F.struct("_class", "_level"))).over(whole)["_level"])
    copies = F.when(F.col("target") >= most * F.col("source_size"), F.when(F.col("source_size") > 0, float(most)).otherwise(0.0)).otherwise(F.least(F.lit(float(most)), F.col("_l") * F.col("_class")))
    return chosen.select("_s", "source_size", "target", "_class", copies.alias("_expected"), "_words")


def plan_sources(sizes: DataFrame, scratch: Scratch, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``_s, source_size, target, _class, _expected, _cut`` from ``sizes(doc_id, source, size)``, a row for each source and length class.

    Documents with odds up to ``_cut`` get one copy more. The cut is where the
    words taken come nearest to the target. Sums by cell find the cell it falls
    in; only that cell's rows are sorted.
    """
    classes = scratch.write(sizes.groupBy(F.col("source").alias("_s"), length_class(F.col("size")).alias("_class")).agg(F.sum("size").alias("_words")), "classes")
    by_source = targets(classes.groupBy(F.col("_s").alias("source")).agg(F.sum("_words").alias("source_size")), weights, share, most)
    copies = scratch.write(expected_copies(by_source, classes, most), "copies")
    rest = copies.groupBy(F.col("_s").alias("_t")).agg((F.max("target") - F.sum(F.floor("_expected") * F.col("_words"))).alias("_rest"))
    asked = copies.join(rest, F.col("_s").eqNullSafe(F.col("_t"))).select("_s", "_class", "_expected", "_rest")
    ranked = sizes.join(asked, F.col("source").eqNullSafe(F.col("_s")) & (length_class(F.col("size")) == F.col("_class"))).withColumn("_odds", _odds(F.col("doc_id"), seed)).where("_odds IS NOT NULL")
    ranked = ranked.withColumn("_cell", F.floor(F.col("_odds") / (1 + F.col("_odds")) * CELLS).cast("int")).select("_s", "_rest", "_cell", "_odds", "size")
    in_order = Window.partitionBy("_s").orderBy("_cell")
    cells = ranked.groupBy("_s", "_rest", "_cell").agg(F.sum("size").alias("_words"))
    cells = cells.select("_s", "_cell", (F.sum("_words").over(in_order) - F.col("_words")).alias("_before"), F.sum("_words").over(in_order).alias("_after"), "_rest")
    edge = cells.where("_before <= _rest").groupBy("_s").agg(F.max(F.struct("_cell", "_before")).alias("_edge"))
    edge = scratch.write(edge.select(F.col("_s").alias("_e"), F.col("_edge._cell").alias("_c"), F.col("_edge._before").alias("_before")), "edges")
    last = ranked.join(edge, F.col("_s").eqNullSafe(F.col("_e")) & (F.col("_cell") == F.col("_c")))
    ties = last.groupBy("_s", "_rest", "_before", "_odds").agg(F.sum("size").alias("_words"))
    reached = F.col("_before") + F.sum("_words").over(Window.partitionBy("_s").orderBy("_odds")) - F.col("_words") / 2
    cut = ties.select("_s", "_odds", (reached <= F.col("_rest")).alias("_in")).groupBy("_s").agg(F.max(F.when(F.col("_in"), F.col("_odds"))).alias("_cut"), F.min("_odds").alias("_least"))
    # With no row of the last cell in, the cut lies before all of them.
    cut = cut.select("_s", F.coalesce("_cut", F.col("_least") * (1 - 2.0**-40)).alias("_cut"))
    cut = cut.withColumnRenamed("_s", "_of")
    return scratch.write(copies.join(cut, F.col("_s").eqNullSafe(F.col("_of")), "left").drop("_of", "_words"), "plan")


def _copies(seed: str) -> Column:
    more = F.coalesce(_odds(F.col("doc_id"), seed) <= F.col("_cut"), F.lit(False))
    return (F.floor("_expected") + more.cast("bigint")).cast("bigint")


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ...)``, each as often as the mix takes it; all columns stay as they are, whatever their names.

    A null text has no words, and a null source is a source of its own. Rows
    with one ``doc_id`` in a source have one random number, so they are taken
    or left together. A source without words has a target of 0 and gives no
    rows. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(measure(docs), "sizes")
    plan = plan_sources(sizes, scratch, seed, weights, share, most)
    rows = whole_rows(docs, F.col("doc_id"), F.col("source").cast("string").alias("_source"), length_class(n_words(F.col("text").cast("string"))).alias("_length"))
    taken = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_length") == F.col("_class"))).withColumn("_copies", _copies(seed))
    return taken.where("_copies > 0").withColumn("_copy", F.explode(F.expr("array_repeat(1, cast(_copies AS int))"))).select("row.*")


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of documents."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    sizes = scratch.write(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    plan = plan_sources(sizes, scratch)
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (length_class(F.col("size")) == F.col("_class")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies("mix")).alias("taken"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s
), f AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS ws,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_size,
    coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_w FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * total - 2 * full_size) / (ws - full_w) AS level FROM f
), t AS (
  SELECT source, source_size, coalesce(least(2 * source_size::DOUBLE, (SELECT level FROM l WHERE level * w <= 2 * source_size ORDER BY full_size, full_w LIMIT 1) * w), 2 * source_size::DOUBLE) AS target FROM l
), k AS (
  SELECT source, length(bin(size)) AS class, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), v AS (
  SELECT k.source, class, words, source_size, target,
    (target - 2 * coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / nullif(sum(words * class) OVER (PARTITION BY k.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT, 0) AS level
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT source, class, source_size, target, CASE WHEN target >= 2 * source_size THEN CASE WHEN source_size > 0 THEN 2 ELSE 0 END
    ELSE least(2, max_by(level, class) FILTER (level >= 0 AND level * class <= 2) OVER (PARTITION BY source) * class) END::DOUBLE AS expected, words FROM v
), r AS (
  SELECT doc_id, size, d.source, source_size, target, floor(expected) AS whole, expected - floor(expected) AS p,
    target - (SELECT sum(floor(y.expected) * y.words) FROM e y WHERE y.source IS NOT DISTINCT FROM d.source) AS rest,
    ((('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND length(bin(size)) = class
), o AS (
  SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS odds FROM r
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds) - size / 2 AS reached FROM o
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN odds IS NOT NULL AND reached <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
