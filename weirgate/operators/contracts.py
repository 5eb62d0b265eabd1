"""Rules that data should keep: violations, summaries in one scan, and quarantine.

A null fails ``not_null`` only; every other row rule treats null as not checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import with_neighbour


@dataclass(frozen=True)
class RowRule:
    """``holds`` is true, false, or null for not checked; ``observed`` is what a violation shows."""

    rule_id: str
    holds: Column
    observed: Column

    def broken(self) -> Column:
        return F.coalesce(~self.holds, F.lit(False))


def not_null_rule(rule_id: str, *cols: str) -> RowRule:
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in cols)), lambda x: x.isNotNull()), ",")
    holds = F.lit(True)
    for c in cols:
        holds = holds & F.col(c).isNotNull()
    return RowRule(rule_id, holds, missing)


def in_domain_rule(rule_id: str, col: str, values: list) -> RowRule:
    return RowRule(rule_id, F.col(col).isin(values), F.col(col).cast("string"))


def in_range_rule(rule_id: str, col: str, lo=None, hi=None) -> RowRule:
    holds = F.when(F.col(col).isNull(), None).otherwise(F.lit(True))
    if lo is not None:
        holds = holds & (F.col(col) >= lo)
    if hi is not None:
        holds = holds & (F.col(col) <= hi)
    return RowRule(rule_id, holds, F.col(col).cast("string"))


def row_holds_rule(rule_id: str, predicate: Column, observed: Column | None = None) -> RowRule:
    return RowRule(rule_id, predicate, observed if observed is not None else F.lit(None).cast("string"))


def matches_rule(rule_id: str, col: str, regex: str) -> RowRule:
    return RowRule(rule_id, F.col(col).rlike(regex), F.col(col))


def not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(not_null_rule("", *cols).broken())


def in_domain(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(in_domain_rule("", col, values).broken())


def in_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    return df.where(in_range_rule("", col, lo, hi).broken())


def row_holds(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(row_holds_rule("", predicate).broken())


def matches(df: DataFrame, col: str, regex: str) -> DataFrame:
    return df.where(matches_rule("", col, regex).broken())


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups with more than one row, with ``n``. Keys with a null are not checked."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def references(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose key no parent has."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def reconciles(parent: DataFrame, child: DataFrame, on: str, child_on: str, amount: str, part: Column, tol: float = 0.01) -> DataFrame:
    """``key, declared, summed`` of parents with children whose total differs from the children's sum by more than ``tol``."""
    sums = child.groupBy(F.col(child_on).alias("key")).agg(F.sum(part.cast("decimal(18,2)")).cast("double").alias("summed"))
    declared = parent.select(F.col(on).alias("key"), F.col(amount).cast("decimal(18,2)").cast("double").alias("declared"))
    return declared.join(sums, "key").where(F.abs(F.col("declared") - F.col("summed")) > tol)


def sequence_complete(df: DataFrame, group: str, seq: str, first: int = 1) -> DataFrame:
    """``group, n, lo, hi`` of groups whose distinct numbers don't run from ``first`` without a hole."""
    by = df.groupBy(group).agg(F.count_distinct(seq).alias("n"), F.min(seq).cast("bigint").alias("lo"), F.max(seq).cast("bigint").alias("hi"))
    return by.where((F.col("lo") != first) | (F.col("hi") - F.col("lo") + 1 != F.col("n")))


#: Numbers of a sequence that are put in order together.
SEQUENCE_CELL = 65_536


def sequence_steps(df: DataFrame, group: str, seq: str) -> DataFrame:
    """Rows that don't follow the one before in their group by a step of one: ``group, seq, before``.

    A hot group is sorted in cells of neighbouring numbers. Rows without a
    number are left out; a null group is one like others.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(seq).alias("_q")).where("_q IS NOT NULL")
    steps = with_neighbour(rows, "_g", ["_q"], F.struct("_q"), F.floor(F.col("_q") / SEQUENCE_CELL))
    before = F.col("_beside._q")
    return steps.where(F.col("_q") - before != 1).select(F.col("_g").alias(group), F.col("_q").alias(seq), before.alias("before"))


def volume(dense: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows of a dense rollup with ``n`` out of bounds; periods without rows count 0."""
    return dense.where(~F.col("n").between(lo, hi))


def violations(df: DataFrame, rules: list[RowRule], key: Column) -> DataFrame:
    """``rule_id, key, observed``: all broken row rules in one scan."""
    found = F.array(*(F.when(r.broken(), F.struct(F.lit(r.rule_id).alias("rule_id"), key.cast("string").alias("key"), r.observed.alias("observed"))) for r in rules))
    return df.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def contract_summary(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """``rule_id, n_checked, n_violations, passed``: all row rules in one aggregation."""
    aggs = []
    for i, r in enumerate(rules):
        aggs += [F.count_if(r.holds.isNotNull()).alias(f"_c{i}"), F.count_if(r.broken()).alias(f"_v{i}")]
    rows = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"_c{i}").alias("n_checked"), F.col(f"_v{i}").alias("n_violations"), (F.col(f"_v{i}") == 0).alias("passed")) for i, r in enumerate(rules)))
    return df.agg(*aggs).select(F.inline(rows))


def found_violations(rule_id: str, broken: DataFrame, key: Column, observed: Column) -> DataFrame:
    """``rule_id, key, observed`` of what ``unique``, ``references``, ``reconciles`` or ``sequence_complete`` found, to be appended to ``violations``."""
    return broken.select(F.lit(rule_id).alias("rule_id"), key.cast("string").alias("key"), observed.cast("string").alias("observed"))


def _summary(rule_id: str, counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(rule_id).alias("rule_id"), "n_checked", "n_violations", (F.col("n_violations") == 0).alias("passed"))


def unique_summary(rule_id: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """A row as of ``contract_summary`` for ``unique``, in one scan: key groups, and those with more than one row."""
    groups = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _summary(rule_id, groups.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("n") > 1).alias("n_violations")))


def references_summary(rule_id: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """A row as of ``contract_summary`` for ``references``, in one scan of each side: rows with a key, and those whose key no parent has.

    Rows of both are counted by key, so a key goes through the shuffle once a task and no side is joined.
    """
    keys = child.select(F.col(fk).alias("_k"), F.lit(1).alias("_c"), F.lit(0).alias("_p")).unionByName(parent.select(F.col(pk).alias("_k"), F.lit(0).alias("_c"), F.lit(1).alias("_p")))
    by = keys.where("_k IS NOT NULL").groupBy("_k").agg(F.sum("_c").alias("_c"), F.sum("_p").alias("_p"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return _summary(rule_id, by.agg(zero("_c").alias("n_checked"), zero(F.when(F.col("_p") == 0, F.col("_c"))).alias("n_violations")))


def quarantine(df: DataFrame, rules: list[RowRule]) -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and the others with ``_reasons``."""
    marked = df.withColumn("_reasons", F.filter(F.array(*(F.when(r.broken(), F.lit(r.rule_id)) for r in rules)), lambda x: x.isNotNull()))
    return marked.where(F.size("_reasons") == 0).drop("_reasons"), marked.where(F.size("_reasons") > 0)
