"""Candidate scoring, preference pairs, masked losses, error rates, interval statistics, annotation checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def order_statistics(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(name, value): the values at places of the sorted values, each place given as a function of their number.

    No sorted list is gathered and no task numbers all rows: values are counted, and the running count
    over distinct values finds the place.
    """
    from turnweave.operators.streams import number_rows

    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"))
    numbered = number_rows(counts, [F.col(value)], "_k")
    block = numbered.withColumn("_b", F.floor(F.col("_k") / 4096))
    w = Window.partitionBy("_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    inside = block.withColumn("_upto", F.sum("_c").over(w))
    sums = block.groupBy("_b").agg(F.sum("_c").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    ranked = inside.join(before, "_b").withColumn("_upto", F.col("_upto") + F.col("_before"))
    wanted = total.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("bigint").alias("_at")) for name, place in places.items()])).alias("x")).select("x.*")
    hit = ranked.join(F.broadcast(wanted), (F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at")))  # one row per place on the right
    return hit.select("name", F.col(value).alias("value"))


def index_percentile(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """The value at place ``min(n - 1, int(share * n))`` of the sorted values, per share, in one row each."""
    places = {str(s): (lambda n, s=s: F.least(n - 1, F.floor(n * s))) for s in shares}
    return order_statistics(rows, value, places).select(F.col("name").cast("double").alias("share"), "value")


def grouped_median(counts: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """The median of each group from counts per value: the mean of the two middle values where their number is even.

    Counts come map-side combined, and the running count over a group's distinct values needs no buffer of them.
    """
    w = Window.partitionBy(*keys)
    upto, n = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), F.sum(count).over(w)
    ranked = counts.withColumns({"_upto": upto, "_n": n})
    at = lambda place: F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col(count) <= place), F.col(value)))
    return ranked.groupBy(*keys).agg(((at(F.expr("(_n - 1) div 2")) + at(F.expr("_n div 2"))) / 2).alias("median"))


def z_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation (plus 1e-6) of each column's non-null values; 0 and 1 where there are none."""
    out = []
    for c in columns:
        out += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(c) + 1e-6, F.lit(1.0)).alias(f"{c}_std")]
    return rows.agg(*out)


def rewards(candidates: DataFrame, least_balance: float, weights: dict[str, float]) -> DataFrame:
    """Add ``vetoed`` and ``reward``: weighted z-scores plus half of each bonus; null terms count nothing.

    Statistics include vetoed candidates. A balance below the bound vetoes.
    """
    stats = z_statistics(candidates, list(weights))
    rows = candidates.crossJoin(F.broadcast(stats))  # one row on the right
    total = F.lit(0.0)
    for c, weight in weights.items():
        total = total + F.coalesce(weight * (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), F.lit(0.0))
    total = total + F.coalesce(0.5 * F.col("distinct_ratio"), F.lit(0.0)) + F.coalesce(0.5 * F.col("balance"), F.lit(0.0))
    vetoed = F.coalesce(F.col("balance") < least_balance, F.lit(False))
    return rows.withColumn("vetoed", vetoed).withColumn("reward", F.when(~vetoed, total)).drop(*[f"{c}_{k}" for c in weights for k in ("mean", "std")])


def preference_pairs(candidates: DataFrame, context: str, order: str, least_gap: float) -> DataFrame:
    """Best and worst candidate of each context with two or more left and a gap of ``least_gap`` or more.

    Ties go by ``order``: the best is the first of the maxima, the worst the last of the minima. Both
    come from one map-side combined aggregate, so a context of any size needs no window.
    """
    rows = candidates.where("reward IS NOT NULL")
    pair = rows.groupBy(context).agg(
        F.count("*").alias("n"),
        F.max_by(order, F.struct("reward", -F.col(order))).alias("chosen"),
        F.max("reward").alias("high"),
        F.min_by(order, F.struct("reward", -F.col(order))).alias("rejected"),
        F.min("reward").alias("low"),
    )
    return pair.where((F.col("n") >= 2) & (F.col("high") - F.col("low") >= least_gap)).withColumn("gap", F.col("high") - F.col("low"))


def silence_cuts(states: DataFrame, least_gap: int, totals: DataFrame) -> DataFrame:
    """Cut points of each entity: 0, its total, and the middle of every gap of ``least_gap`` or more.

    ``states`` are interval states (part is not used apart from grouping); ``totals``: entity, total.
    """
    from turnweave.operators.intervals import gaps

    middle = gaps(states, least_gap).select("entity", ((F.col("gap_start") + F.col("gap_end")) / 2.0).alias("cut"))
    ends = totals.select("entity", F.explode(F.array(F.lit(0.0), F.col("total").cast("double"))).alias("cut"))
    return middle.unionByName(ends).distinct()


def overlap_ms(rows: DataFrame, key: str, channel: str, start: str, end: str, block_ms: int = 3_600_000) -> DataFrame:
    """Milliseconds in which two channels or more of a key are active, per key. Intervals that only touch do not overlap.

    Intervals are cut at the edges of blocks of time, so a block's overlap is its own and a key of any
    size is spread over its blocks. In a block one sorted pass over the ends of all intervals counts the
    active ones of each channel. Rows without both ends, or that end before they begin, count for nothing.
    """
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    cut = rows.where(e > s).select(F.col(key).alias("_key"), F.col(channel).alias("_ch"), s.alias("_s"), e.alias("_e"))
    cut = cut.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_s") / block_ms), F.floor((F.col("_e") - 1) / block_ms))))
    low, high = F.greatest("_s", F.col("_block") * block_ms), F.least("_e", (F.col("_block") + 1) * block_ms)
    ends = cut.select("_key", "_block", "_ch", F.explode(F.array(F.struct(low.alias("t"), F.lit(1).alias("d")), F.struct(high.alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy("_key", "_block", "_ch", F.col("x.t").alias("_t")).agg(F.sum("x.d").alias("_d"))
    own = Window.partitionBy("_key", "_block", "_ch").orderBy("_t")
    # A channel is active from a step where its count is positive; only changes of that matter to the others.
    active = (F.sum("_d").over(own) > 0).cast("int")
    turned = steps.withColumn("_on", active)
    turned = turned.withColumn("_change", F.col("_on") - F.coalesce(F.lag("_on").over(own), F.lit(0)))
    every = Window.partitionBy("_key", "_block").orderBy("_t")
    at_once = F.sum("_change").over(every.rowsBetween(Window.unboundedPreceding, 0))
    spans = turned.select("_key", at_once.alias("_n"), (F.lead("_t").over(every) - F.col("_t")).alias("_ms"))
    return spans.groupBy(F.col("_key").alias(key)).agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_ms"))), F.lit(0)).cast("bigint").alias("both_ms"))


def sequence_log_prob(tokens: DataFrame, keys: list[str], label: str = "label", logp: str = "logp") -> DataFrame:
    """Mean log-probability over cells whose label is not ignored (0 without any)."""
    use = F.col(label) != -1
    return tokens.groupBy(*keys).agg((F.sum(F.when(use, F.col(logp)).otherwise(0.0)) / F.greatest(F.count_if(use), F.lit(1))).alias("logp"))


def preference_loss(pairs: DataFrame, beta: float) -> DataFrame:
    """Mean loss ``-log sigmoid(beta * ((w - rw) - (l - rl)))`` in its stable form, accuracy and margin."""
    z = beta * ((F.col("w") - F.col("rw")) - (F.col("l") - F.col("rl")))
    loss = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return pairs.agg(F.avg(loss).alias("loss"), F.avg(F.when(z > 0, 1.0).otherwise(0.0)).alias("accuracy"), F.avg(z).alias("margin"))


def masked_text_loss(tokens: DataFrame, pad: int = 3) -> DataFrame:
    """Mean loss over pads and over all other labels; ignored labels (-1) count for neither, the end-of-padding id as text."""
    label = F.col("label")
    return tokens.agg(
        F.avg(F.when((label != pad) & (label != -1), F.col("loss"))).alias("non_pad_loss"),
        F.avg(F.when(label == pad, F.col("loss"))).alias("pad_loss"),
        F.avg(F.when((label != pad) & (label != -1), F.when(F.col("pred") == label, 1.0).otherwise(0.0))).alias("non_pad_accuracy"),
        F.avg(F.when(label == pad, F.when(F.col("pred") == label, 1.0).otherwise(0.0))).alias("pad_accuracy"),
    )


def weighted_audio_loss(tokens: DataFrame, semantic: float = 100.0, acoustic: float = 1.0, codebooks: int = 8, user_stream: bool = False) -> DataFrame:
    """Loss over codebooks 0 (semantic) and the acoustic ones up to ``codebooks``: sums weighted and divided by the weighted counts; 0 without any.

    With ``user_stream`` the user's codebooks follow, their semantic one first; without, they are left out.
    """
    book = F.col("codebook")
    use = (F.col("label") != -1) & (F.lit(user_stream) | (book < codebooks))
    weight = F.when(book % codebooks == 0, semantic).otherwise(acoustic)
    total = F.sum(F.when(use, weight).otherwise(0.0))
    return tokens.agg((F.when(total > 0, F.sum(F.when(use, weight * F.col("loss")).otherwise(0.0)) / total).otherwise(0.0)).alias("audio_loss"))


def text_losses(tokens: DataFrame, marked: list[int], pad: int = 3) -> DataFrame:
    """Mean loss over labels that are neither ignored nor padding, and over the ``marked`` ones of them; NaN where there are none."""
    use = ~F.col("label").isin(-1, pad)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("loss"))), F.lit(float("nan")))
    return tokens.agg(mean(use).alias("mean"), mean(use & F.col("label").isin(marked)).alias("marked"))


def flip_summary(rows: DataFrame, style: str, matched: str = "matched", swapped: str = "swapped") -> DataFrame:
    """Per style and over all: pairs, mean of either condition, mean of swapped less matched, and percent of pairs where swapped is greater.

    Pairs with a NaN or null on either side count for nothing; a style without a pair gives no row.
    """
    m, s = F.col(matched), F.col(swapped)
    good = rows.where(m.isNotNull() & s.isNotNull() & ~F.isnan(m) & ~F.isnan(s))
    g = good.groupingSets([[style], []], style).agg(
        F.count("*").alias("n"), F.avg(m).alias("matched"), F.avg(s).alias("swapped"), F.avg(s - m).alias("effect"), (100.0 * F.avg(F.when(m < s, 1.0).otherwise(0.0))).alias("accuracy"),
    )
    return g.where("n > 0").select(F.coalesce(style, F.lit("all")).alias("style"), "n", "matched", "swapped", "effect", "accuracy")


def _channel_text(export: Column, channel: str) -> Column:
    """A channel's transcripts in order of start, joined and brought to one form."""
    from turnweave.functions.text import normalize_ja

    own = F.filter(export, lambda s: s.channelId == channel)
    placed = F.array_sort(F.transform(own, lambda s, i: F.struct(F.coalesce(s.startMs, F.lit(0)).alias("at"), i.alias("i"), F.coalesce(s.transcript, F.lit("")).alias("t"))))
    return normalize_ja(F.array_join(F.transform(placed, lambda x: x.t), ""), lower=False)


def annotation_problems(export: str = "segments", prelabel: str | None = None, complete: Column | None = None) -> Column:
    """Failures of an export's segments, then what is doubtful about it; "no segments" alone where there are none.

    ``complete`` says whether the export has audio, channels and segments at all; where it has not, that is the one failure.

    Failures are bad channel, bad span, foreign tag. Doubtful are empty transcripts and, against the
    segments of ``prelabel`` where they are not null, an unchanged text of both channels and fewer than half the segments.
    """
    from turnweave.functions.text import SPACES, foreign_tags

    def bare(s: Column) -> Column:
        return F.regexp_replace(F.coalesce(s.transcript, F.lit("")), rf"^[{SPACES}]+|[{SPACES}]+$", "")

    def of(s: Column, i: Column) -> Column:
        name = F.concat(F.lit("seg["), i.cast("string"), F.lit("] "))
        span = s.startMs.isNull() | s.endMs.isNull() | (s.endMs <= s.startMs)
        text = bare(s)
        tags = F.transform(foreign_tags(text, ["(笑)", "(不明)"]), lambda t: F.concat(name, F.lit("illegal tag "), t))
        return F.concat(
            F.array_compact(F.array(
                F.when(~F.coalesce(s.channelId.isin("ch_1", "ch_2"), F.lit(False)), F.concat(name, F.lit("bad channelId"))),
                F.when(span, F.concat(name, F.lit("bad span"))),
            )),
            F.when(text != "", tags).otherwise(F.array().cast("array<string>")),
        )

    n, empty = F.size(export), F.size(F.filter(export, lambda s: bare(s) == ""))
    doubts = [F.when(empty > 0, F.concat(empty.cast("string"), F.lit("/"), n.cast("string"), F.lit(" empty transcripts")))]
    if prelabel is not None:
        same = [_channel_text(F.col(export), c) == _channel_text(F.col(prelabel), c) for c in ("ch_1", "ch_2")]
        doubts += [
            F.when(same[0] & same[1], F.lit("identical to prelabel")),
            F.when(F.col(prelabel).isNotNull() & (n < 0.5 * F.size(prelabel)), F.concat(F.lit("segment count dropped "), F.size(prelabel).cast("string"), F.lit("->"), n.cast("string"))),
        ]
    found = F.concat(F.flatten(F.transform(export, of)), F.array_compact(F.array(*doubts)))
    found = F.when(F.coalesce(F.size(export), F.lit(0)) <= 0, F.array(F.lit("no segments"))).otherwise(found)
    return found if complete is None else F.when(complete, found).otherwise(F.array(F.lit("not a valid export")))


def annotation_status(problems: Column) -> Column:
    """FAIL where a problem is a failure, WARN where all are only doubtful, PASS without any."""
    doubtful = lambda p: p.rlike("^[0-9]+/[0-9]+ empty transcripts$|^identical to prelabel$|^segment count dropped ")
    return F.when(F.size(problems) == 0, "PASS").when(F.forall(problems, doubtful), "WARN").otherwise("FAIL")


# Names of JavaScript prototypes, which no cell of a diagram may have as its id.
RESERVED = """
    constructor hasOwnProperty isPrototypeOf propertyIsEnumerable toLocaleString toString valueOf __proto__ __defineGetter__ __defineSetter__ __lookupGetter__ __lookupSetter__
    length at concat copyWithin entries every fill filter find findIndex findLast findLastIndex flat flatMap forEach includes indexOf join keys lastIndexOf map pop push reduce
    reduceRight reverse shift slice some sort splice unshift values with group groupBy charAt charCodeAt codePointAt endsWith match matchAll normalize padEnd padStart repeat replace
    replaceAll search split startsWith substring substr toLowerCase toUpperCase trim trimEnd trimStart trimLeft trimRight apply bind call name
""".split()


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): duplicate ids, ids of odd characters, reserved names, ids both node and edge, edge ends that are no node or that are missing, missing parents, parent cycles.

    An end that is missing is none if the edge has a point there (``source_point``, ``target_point``, if these columns exist).

    Cycles are found by pointer doubling: each round replaces a parent by its parent's parent, so a
    chain of any length ends at its root after a logarithm of rounds.
    """
    duplicate = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id").alias("problem"), "id")
    ids = nodes.select("id").distinct()
    cells = ids.union(edges.select("id"))
    odd = cells.where("NOT id RLIKE '^[A-Za-z0-9_-]+$'").select(F.lit("odd id").alias("problem"), "id").distinct()
    reserved = cells.where(F.col("id").isin(RESERVED)).select(F.lit("reserved name").alias("problem"), "id").distinct()
    both = ids.join(edges.select("id"), "id", "left_semi").select(F.lit("vertex and edge").alias("problem"), "id")
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    dangling = ends.join(ids.withColumnRenamed("id", "end"), "end", "left_anti").where("end IS NOT NULL").select(F.lit("dangling edge").alias("problem"), "id").distinct()
    point = lambda end: F.coalesce(F.col(f"{end}_point"), F.lit(False)) if f"{end}_point" in edges.columns else F.lit(False)
    open_ends = edges.select("id", F.explode(F.array(*[F.when(F.col(end).isNull() & ~point(end), F.lit(f"no {end}")) for end in ("source", "target")])).alias("problem")).where("problem IS NOT NULL").select("problem", "id")
    parented = nodes.where("parent IS NOT NULL")
    orphan = parented.join(ids.withColumnRenamed("id", "parent"), "parent", "left_anti").select(F.lit("missing parent").alias("problem"), "id")
    return duplicate.unionByName(odd).unionByName(reserved).unionByName(both).unionByName(dangling).unionByName(open_ends).unionByName(orphan).unionByName(_cycles(parented))


def _cycles(parented: DataFrame, most_rounds: int = 64) -> DataFrame:
    from turnweave.session import checkpointed

    hops = checkpointed(parented.select("id", "parent").distinct())
    for _ in range(most_rounds):
        up = hops.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        further = checkpointed(hops.join(up, "parent").select("id", F.col("_next").alias("parent")).distinct())
        # Nodes whose chain ended at a root fall out; what stays for good lies on or below a cycle.
        if further.count() == hops.count():
            break
        hops = further
    return hops.select(F.lit("parent cycle").alias("problem"), "id").distinct()


def alternating_batches(base: DataFrame, alt: DataFrame, ratio: int, batch: int, ranks: int, drop_last: bool = False, seed: int = 0) -> DataFrame:
    """Plan of batches (step, rank, slot, kind, id): after every ``ratio`` global base batches one of the other kind.

    Both sides are shuffled by hash. A short last base batch is filled from the base's own start, or
    dropped; the other kind is repeated until it fills its batches. ``base`` and ``alt`` have one column, id.
    A base of under half a global batch cannot fill one and is an error, unless it may be dropped.
    """
    from turnweave.operators.streams import number_rows

    size = batch * ranks
    shuffled = lambda df: number_rows(df.withColumn("_h", F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))), [F.col("_h"), F.col("id")], "k").drop("_h")
    b, a = shuffled(base), shuffled(alt)
    n_base, n_alt = b.count(), a.count()
    if not drop_last and n_base and 2 * n_base < size:
        raise ValueError("the base is under half a global batch: its own start cannot fill it")
    n_batches = n_base // size + (1 if n_base % size and not drop_last else 0)
    wrap = n_batches * size - n_base
    b = b.where(F.col("k") < n_batches * size)
    if wrap > 0:
        b = b.unionByName(b.where(F.col("k") < wrap).withColumn("k", F.col("k") + n_base))
    b = b.withColumn("g", F.floor(F.col("k") / size)).withColumn("step", F.col("g") + F.floor(F.col("g") / ratio)).withColumn("kind", F.lit("base"))
    need = n_batches // ratio * size
    copies = -(-need // n_alt) if n_alt else 0
    a = a.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(copies - 1, 0))))).withColumn("k", F.col("k") + F.col("copy") * n_alt).where(F.col("k") < need)
    a = a.withColumn("g", F.floor(F.col("k") / size)).withColumn("step", (F.col("g") + 1) * (ratio + 1) - 1).withColumn("kind", F.lit("alt")).drop("copy")
    plan = b.unionByName(a)
    place = F.col("k") % size
    return plan.select("step", F.floor(place / batch).alias("rank"), (place % batch).alias("slot"), "kind", "id")
