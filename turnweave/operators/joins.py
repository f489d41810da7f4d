"""Joins and windows over candidates, examples and turns; columns are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators.streams import number_rows


def score_lookup(rows: DataFrame, key: str, scores: dict[str, DataFrame]) -> DataFrame:
    """Rows with one column per score table (``key`` and ``score``); a key without a score keeps null. A table's keys are unique."""
    for name, table in scores.items():
        rows = rows.join(table.select(key, F.col("score").alias(name)), key, "left")
    return rows


def candidate_grid(rows: DataFrame, context: str, seed: str, first: object) -> DataFrame:
    """(context, seed): the contexts that exist under the seed ``first``, with every seed under which they exist."""
    pairs = rows.select(context, seed).where(F.col(context).isNotNull()).distinct()
    return pairs.join(pairs.where(F.col(seed) == first).select(context), context, "left_semi")


def common_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Names that stand on both sides, once for each pair of rows."""
    return left.select(name).join(right.select(name), name)


def with_prelabel(rows: DataFrame, prelabels: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with their prelabel's value (as ``prelabel``) and ``status``: WARN where there is none, else ok."""
    found = rows.join(prelabels.select(key, F.col(value).alias("prelabel")), key, "left")
    return found.withColumn("status", F.when(F.col("prelabel").isNull(), "WARN").otherwise("ok"))


def positional(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of two tables side by side by their place (``k`` from 0) in either order; the longer one's rest is left out."""
    return number_rows(left, [F.col(left_order)], "k").join(number_rows(right, [F.col(right_order)], "k"), "k")


def reference_log_probs(rows: DataFrame, reference: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the reference's columns; 0 where the reference has no row or no value."""
    joined = rows.join(reference.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def first_n(rows: DataFrame, order: str, n: int, out: str) -> DataFrame:
    """The first ``n`` rows in ``order``, numbered from 0. Each task keeps ``n`` rows at most."""
    return rows.orderBy(order).limit(n).withColumn(out, F.row_number().over(Window.orderBy(order)) - 1)


def slice_of(rows: DataFrame, order: str, first: int, end: int, out: str = "k") -> DataFrame:
    """Rows at places ``first`` up to ``end`` (not included) of the whole order, with their place."""
    return number_rows(rows, [F.col(order)], out).where((F.col(out) >= first) & (F.col(out) < end))


def first_k(rows: DataFrame, group: str, order: str, k: int, out: str = "k") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1. Partitions keep ``k`` rows of a group before any row is moved."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col(out) <= k)


def capped(rows: DataFrame, group: str, order: str, per_group: int, most: int) -> DataFrame:
    """At most ``per_group`` rows of each group, and of those the first ``most`` in ``order`` over all."""
    return first_k(rows, group, order, per_group).orderBy(order).limit(most)


def shifted(values: DataFrame, column: str, by: int, out: str) -> DataFrame:
    """Each distinct value with the one ``by`` places on in order, around the end."""
    k = number_rows(values.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], "_k")
    n = k.agg(F.count("*").alias("_n"))
    other = k.select(F.col(column).alias(out), F.col("_k").alias("_j"))
    return k.crossJoin(F.broadcast(n)).withColumn("_j", (F.col("_k") + by) % F.col("_n")).join(other, "_j").select(column, out)  # one row on the right


def proportional_spans(rows: DataFrame, group: str, order: str, weight: Column, total_ms: float) -> DataFrame:
    """Add ``s`` and ``e``: ``total_ms`` of each group shared out in order by weight, edges rounded half to even."""
    w = Window.partitionBy(group).orderBy(order)
    t = rows.withColumn("_w", weight)
    t = t.withColumns({"_upto": F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_w").over(Window.partitionBy(group))})
    at = lambda x: F.rint(float(total_ms) * x / F.col("_total")).cast("bigint")
    return t.withColumns({"s": at(F.col("_upto") - F.col("_w")), "e": at(F.col("_upto"))}).drop("_w", "_upto", "_total")


def window_choice(cuts: DataFrame, key: str, cut: str, length: float, least: float) -> DataFrame:
    """(key, t0, t1): per key a start cut drawn by hash, and the first cut at least ``length`` later, else the last; shorter ones than ``least`` are left out."""
    last = cuts.groupBy(key).agg(F.max(cut).alias("total"))
    word = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.floor(cut).cast("string")))
    start = cuts.join(last, key).where(F.col(cut) < F.col("total") - least).groupBy(key).agg(F.min_by(cut, word).alias("t0"), F.first("total").alias("total"))
    later = start.join(cuts, key).where(F.col(cut) >= F.col("t0") + length).groupBy(key).agg(F.min(cut).alias("t1"))
    out = start.join(later, key, "left").withColumn("t1", F.coalesce("t1", "total"))
    return out.where(F.col("t1") - F.col("t0") >= least).select(key, "t0", "t1")


def contiguous_parts(rows: DataFrame, order: str, n_parts: int, out: str = "part") -> DataFrame:
    """Near-equal parts of neighbours in order, the first ones longer by one."""
    numbered = number_rows(rows, [F.col(order)], "_k")
    n = numbered.agg(F.count("*").alias("_n"))
    k, base, extra = F.col("_k"), F.floor(F.col("_n") / n_parts), F.col("_n") % n_parts
    part = F.when(k < extra * (base + 1), F.floor(k / (base + 1))).otherwise(extra + F.floor((k - extra * (base + 1)) / F.greatest(base, F.lit(1))))
    return numbered.crossJoin(F.broadcast(n)).withColumn(out, part).drop("_k", "_n")  # one row on the right


def resume_position(step: Column, steps_per_epoch: int, batch: int) -> tuple[Column, Column]:
    """(epoch, examples to skip in it) of a run that stopped after ``step`` steps."""
    return F.floor(step / steps_per_epoch), step % steps_per_epoch * batch
