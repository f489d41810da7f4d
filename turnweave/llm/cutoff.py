"""A cutoff per source that keeps a target fraction of its records (problem 6).

One mergeable quantile sketch per source gives a bracket of values around the target rank, as wide as
the sketch's rank error. A second pass counts the records in buckets of value: below the bracket, inside
it and above it, so one bucket holds the target rank for certain, whatever the sketch said. A third pass
counts the values of that bucket one by one, and with them the exact cutoff and its ties.

A source may hold most of all records: what is known of a source is repeated under each of ``SALTS``
salts and meets the records by source and salt, and counts are combined before they are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch, buckets in each of the three parts of a source's values, and parts (a power of two) a source's records are dealt into.
SKETCH_K, BUCKETS, SALTS = 800, 64, 32


def rank_error(k: int) -> float:
    """Rank error of a KLL sketch of size ``k`` that 99 % of queries stay within (published fit)."""
    return 2.296 / k**0.9021


def clean_stem(stem: Column) -> Column:
    """A stem without outer blanks, directories (either slash) and extension, in lower case."""
    name = F.regexp_extract(F.regexp_replace(stem, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z][A-Za-z0-9]{0,5}$", ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def source_of(stem: Column) -> Column:
    """The first two parts of a stem between underscores; the whole stem where there are fewer."""
    return F.substring_index(stem, "_", 2)


def counted(records: DataFrame) -> DataFrame:
    """One record per stem: the latest by ``scored_at`` (ties: the greatest rec_id), if its rate is finite and not negative.

    A null time counts as the earliest; records without a stem count for none.
    """
    stem = clean_stem(F.col("stem"))
    order = F.struct(F.coalesce(F.col("scored_at"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.col("rec_id"))
    latest = records.where("stem IS NOT NULL").select(stem.alias("stem"), "cer", order.alias("o")).groupBy("stem").agg(F.max_by("cer", "o").alias("cer"))
    valid = F.col("cer").isNotNull() & ~F.isnan("cer") & (F.col("cer") >= 0) & (F.col("cer") < F.lit(float("inf")))
    # Never null, and known to be: a filter on nulls would keep the shuffle below from being used again.
    return latest.where(valid).withColumn("source", F.coalesce(source_of(F.col("stem")), F.lit("")))


def _met(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records with what is ``known`` of their source; no task holds more than a part of a source."""
    # By bits, not by a remainder: that could be null to the optimizer, whose filter would part equal shuffles.
    salt = F.xxhash64("stem" if "stem" in records.columns else "cer").bitwiseAND(F.lit(SALTS - 1)).cast("int")
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return records.withColumn("_salt", salt).join(salted, ["source", "_salt"]).drop("_salt")


def _bucket() -> Column:
    """The bucket of a value, in order of value: equal widths from the least value to the bracket, in it, and behind it."""
    cer = F.col("cer")
    part = lambda low, high: F.when(high > low, F.least(F.width_bucket(cer, low, high, F.lit(BUCKETS)), F.lit(BUCKETS))).otherwise(F.lit(1))
    least, low, high, most = (F.col(c) for c in ("least", "low", "high", "most"))
    return F.when(cer < low, part(least, low)).when(cer <= high, BUCKETS + part(low, high)).otherwise(2 * BUCKETS + part(high, most)).cast("int")


def cutoffs(records: DataFrame, percent: int = 80, k: int = SKETCH_K) -> DataFrame:
    """Source, cutoff, records and records kept, for records (source, cer) without nulls.

    The cutoff is the smallest ``cer`` that at least ``percent`` % of the source's records do not
    exceed; ties at it are kept. Ranks are whole numbers, so no rounding of a fraction decides.
    """
    margin = rank_error(k)
    near = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))
    sketched = records.groupBy("source").agg(F.kll_sketch_agg_double("cer", F.lit(k)).alias("sketch"), F.count("*").alias("n_records"), F.min("cer").alias("least"), F.max("cer").alias("most"))
    bracket = sketched.select("source", "n_records", "least", "most", near(max(0.0, percent / 100 - margin)).alias("low"), near(min(1.0, percent / 100 + margin)).alias("high"))
    counts = _met(records, bracket).groupBy("source", _bucket().alias("bucket")).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n_records", "least", "most", "low", "high")])
    # At most 3 * BUCKETS rows of a source: ranking them is a bounded window.
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("below", upto - F.col("n")).withColumn("need", F.expr(f"(n_records * {percent} + 99) div 100"))
    chosen = ranked.where("below < need AND below + n >= need").select("source", F.col("bucket").alias("wanted"), "below", "need", "n_records", "least", "most", "low", "high")
    values = _met(records, chosen).where(_bucket() == F.col("wanted")).groupBy("source", "cer").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("below", "need", "n_records")])
    rank = F.col("below") + F.sum("n").over(Window.partitionBy("source").orderBy("cer").rowsBetween(Window.unboundedPreceding, 0))
    hit = values.withColumn("rank", rank).where("rank >= need")
    return hit.groupBy("source").agg(F.min("cer").alias("cutoff"), F.first("n_records").alias("n_records"), F.min("rank").alias("n_kept"))


def kept(records: DataFrame, found: DataFrame) -> DataFrame:
    """The records at or below their source's cutoff."""
    return _met(records, found.select("source", "cutoff")).where("cer <= cutoff").drop("cutoff")
