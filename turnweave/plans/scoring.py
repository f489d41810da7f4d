"""Queries of scoring, metrics, windows, batching and stream twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions import arrays as X
from turnweave.functions import text as T
from turnweave.operators import intervals as I
from turnweave.operators import joins as J
from turnweave.operators import scores as S
from turnweave.operators.corpus import induced_subgraph, recovered_spans, repeated, single_speaker
from turnweave.operators.streams import number_rows
from turnweave.plans.corpus import docs, read, turns


def _cer(spark, d):
    return read(spark, d, "cer_all").where("cer IS NOT NULL AND NOT isnan(cer) AND abs(cer) < 1e9 AND stem IS NOT NULL").select("rec_id", "stem", "cer", "shard")


def _candidates(spark, d):
    e = read(spark, d, "events")
    natural = F.when(F.col("event_id") % 7 != 0, F.bround(F.col("value"), 4))
    return e.select("user_id", "event_id", natural.alias("naturalness"), (F.col("event_id") % 11 / 11.0).alias("distinct_ratio"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 10 / 10.0).alias("balance"))


def agg01_distribution(spark, d):
    rows = _cer(spark, d)
    stats = rows.agg(F.count("*").alias("n"), F.round(F.avg("cer"), 9).alias("mean"), F.max("cer").alias("most"))
    places = {f"p{int(s * 100)}": (lambda n, s=s: F.least(n - 1, F.floor(n * s))) for s in (0.1, 0.5, 0.9, 0.99)}
    places |= {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}
    p = S.order_statistics(rows, "cer", places).groupBy().agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in places])
    p = p.withColumn("median", (F.col("low") + F.col("high")) / 2).drop("low", "high")
    return stats.crossJoin(F.broadcast(p))


def agg02_prefix_means(spark, d):
    return _cer(spark, d).groupBy(F.substring_index(F.lower("stem"), "_", 2).alias("prefix")).agg(F.count("*").alias("n"), F.round(F.avg("cer"), 9).alias("mean"))


def agg04_z_statistics(spark, d):
    s = S.z_statistics(_candidates(spark, d), ["naturalness", "balance"])
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def agg06_channel_balance(spark, d):
    """Ratio of the quieter to the louder half's root mean square of each embedding."""
    e = read(spark, d, "embeddings")
    rms = lambda a, b: F.sqrt(F.aggregate(F.slice("embedding", a, b), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / b + 1e-12)
    return e.select("vec_id", F.round(F.least(rms(1, 32), rms(33, 32)) / F.greatest(rms(1, 32), rms(33, 32)), 6).alias("balance"))


def _segments(spark, d):
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)")
    e = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("ch"), start.alias("s"))
    return e.withColumn("e", F.col("s") + 1000 + F.col("event_id") % 9000 * 100)


def agg07_silence_cuts(spark, d):
    seg = _segments(spark, d)
    states = I.interval_states(seg, F.col("user_id"), F.lit(""), F.col("s"), F.col("e"))
    totals = seg.groupBy("user_id").agg(F.max("e").alias("total")).select(F.col("user_id").cast("string").alias("entity"), "total")
    return S.silence_cuts(states, 60_000, totals).select(F.col("entity").cast("bigint").alias("user_id"), "cut")


def agg08_overlap(spark, d):
    out = S.overlap_ms(_segments(spark, d), "user_id", "ch", "s", "e")
    return out.select(F.col("user_id").cast("bigint").alias("user_id"), "both_ms")


def agg10_channel_text(spark, d):
    t = turns(spark, d).groupBy("doc_id", "speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "").alias("text"))
    return t.select("doc_id", "speaker", F.md5("text").alias("digest"))


def agg11_mean_without_nan(spark, d):
    return read(spark, d, "cer_all").groupBy("shard").agg(F.round(F.coalesce(F.avg(F.when(~F.isnan("cer") & (F.abs("cer") < 1e9), F.col("cer"))), F.lit(-1.0)), 9).alias("mean"))


def agg12_tag_channel(spark, d):
    """Mean, median and count per tag and channel, and pooled per tag, from one count per value."""
    rows = _cer(spark, d).select(F.substring_index(F.lower("stem"), "_", 1).alias("tag"), F.when(F.col("rec_id") % 2 == 0, "L").otherwise("R").alias("ch"), "cer")
    counts = rows.groupBy("tag", "ch", "cer").agg(F.count("*").alias("n"), F.sum("cer").alias("s"))
    both = counts.withColumn("ch", F.explode(F.array(F.col("ch"), F.lit("pooled")))).groupBy("tag", "ch", "cer").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = both.groupBy("tag", "ch").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 9).alias("mean"))
    medians = S.grouped_median(both, ["tag", "ch"], "cer", "n").select("tag", "ch", F.round("median", 9).alias("median"))
    return means.join(medians, ["tag", "ch"])


def agg13_rank_mean(spark, d):
    return _cer(spark, d).groupBy((F.col("rec_id") % 8).alias("rank")).agg(F.avg("cer").alias("m")).agg(F.round(F.avg("m"), 9).alias("mean"))


def agg15_corpus_summary(spark, d):
    s = S.overlap_ms(_segments(spark, d), "user_id", "ch", "s", "e").crossJoin(F.broadcast(_segments(spark, d).agg(F.sum(F.col("e") - F.col("s")).alias("all_ms"))))
    return s.groupBy("all_ms").agg(F.count("*").alias("n"), F.sum("both_ms").alias("both_ms")).select("n", "both_ms", F.round(100.0 * F.col("both_ms") / F.greatest("all_ms", F.lit(1)), 6).alias("overlap_pct"))


def _flips(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("style"), (F.col("l_extendedprice") / 1e4).alias("matched"), F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity") / 5).alias("swapped"))


def agg17_flip_summary(spark, d):
    s = S.flip_summary(_flips(spark, d), "style")
    return s.select("style", "n", *[F.round(c, 6).alias(c) for c in ("matched", "swapped", "effect", "accuracy")])


def agg18_directional(spark, d):
    e = read(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("request")).agg(F.bool_and(F.col("value") < 60).alias("ok"))
    return e.groupBy("user_id").agg(F.bool_and("ok").alias("both")).agg(F.count("*").alias("n"), F.count_if("both").alias("n_both"))


def agg19_status_totals(spark, d):
    """Exports by status: failed, doubtful, clean."""
    return _exports(spark, d).groupBy(S.annotation_status(F.col("problems")).alias("status")).agg(F.count("*").alias("n"))


def win03_preference_pairs(spark, d):
    r = S.rewards(_candidates(spark, d), 0.2, {"naturalness": 1.0})
    return S.preference_pairs(r, "user_id", "event_id", 0.5).select("user_id", "n", "chosen", "rejected", F.round("gap", 6).alias("gap"))


def win04_length_order(spark, d):
    rows = docs(spark, d).select("doc_id", F.length("text").alias("n"))
    return number_rows(rows, [F.col("n"), F.col("doc_id")], "k")


def win05_first_n(spark, d):
    return J.first_n(read(spark, d, "documents").select("doc_id"), "doc_id", 100, "example_id")


def win06_slice(spark, d):
    both = read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name")).unionByName(read(spark, d, "cer_all").select(F.concat(F.lit("c"), "rec_id").alias("name")))
    return J.slice_of(both, "name", 500, 1500)


def win07_first_k_per_style(spark, d):
    return J.first_k(docs(spark, d).select("doc_id", T.formality(F.col("text")).alias("style")), "style", "doc_id", 5)


def win08_first_per_topic(spark, d):
    t = read(spark, d, "dialogues").where("topic IS NOT NULL").groupBy("topic").agg(F.min("dialogue_id").alias("first_id"))
    return t.orderBy("first_id", "topic").limit(20)


def win09_next_topic(spark, d):
    return J.shifted(read(spark, d, "dialogues"), "topic", 7, "next_topic")


def win10_caps(spark, d):
    """At most three windows per session, and of those the first 200 in all."""
    return J.capped(read(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 3, 200)


def win11_spans(spark, d):
    """Runs of cells with text in a text row, split where more than four frames lie between, of rows with as many runs as turns (row_id modulo 12, plus 1)."""
    from turnweave.plans.token_streams import sides

    cells = sides(spark, d).select("row_id", F.posexplode(F.get("A", F.lit(0))).alias("t", "x")).where("x NOT IN (0, 3)")
    w = Window.partitionBy("row_id").orderBy("t")
    fresh = F.when(F.col("t") - F.lag("t").over(w) <= 4, 0).otherwise(1)
    spans = cells.withColumn("f", fresh).withColumn("run", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = spans.groupBy("row_id", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))
    return recovered_spans(found, "row_id", sides(spark, d).select("row_id", (F.col("row_id") % 12 + 1).alias("n_turns")))


def win12_proportional(spark, d):
    """A thousand ms shared out among a dialogue's turns by text length."""
    return J.proportional_spans(turns(spark, d), "doc_id", "pos", F.greatest(F.length("text"), F.lit(1)), 1000).select("doc_id", "pos", "s", "e")


def win13_window_choice(spark, d):
    """Per user a start cut chosen by hash, and the first cut at least an hour later (else the last)."""
    return J.window_choice(agg07_silence_cuts(spark, d), "user_id", "cut", 3_600_000, 1_000)


def jn06_score_lookup(spark, d):
    a = read(spark, d, "orders").where("o_orderkey % 2 = 0").groupBy(F.col("o_orderkey").alias("event_id")).agg(F.max("o_totalprice").alias("score"))
    b = read(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.col("n_chars").alias("score"))
    return J.score_lookup(read(spark, d, "events").select("event_id"), "event_id", {"natural": a, "meaning": b})


def jn07_candidate_grid(spark, d):
    """Contexts of the first seed with every seed under which they exist."""
    return J.candidate_grid(read(spark, d, "events").select("user_id", F.col("event_type").alias("seed")), "user_id", "seed", "click")


def jn08_gold_pairs(spark, d):
    names = read(spark, d, "documents").select(F.col("doc_id").alias("name"))
    return J.common_names(names.where("name % 2 = 0"), names.where("name % 3 = 0"), "name")


def jn09_prelabel(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "n_chars")
    return J.with_prelabel(rows, rows.where("doc_id % 5 <> 0"), "doc_id", "n_chars").select("doc_id", "status")


def jn12_positional(spark, d):
    return J.positional(read(spark, d, "customer").select("c_custkey"), "c_custkey", read(spark, d, "part").select("p_partkey"), "p_partkey")


def jn13_reference_log_probs(spark, d):
    reference = read(spark, d, "events").where("event_id % 3 = 0").select("event_id", (-F.col("value")).alias("w"), F.col("value").alias("l"))
    return J.reference_log_probs(read(spark, d, "events").select("event_id"), reference, "event_id", ["w", "l"])


def flt02_by_speaker(spark, d):
    """Turns by speaker, and whether the text may go where a single speaker is asked for."""
    t = turns(spark, d)
    return t.groupBy("doc_id").agg(F.count_if(F.col("speaker") == "A").alias("n_a"), F.count_if(F.col("speaker") == "B").alias("n_b")).join(single_speaker(t, "doc_id").select("doc_id", "problem"), "doc_id")


def flt14_subgraph(spark, d):
    nations, customers = read(spark, d, "nation"), read(spark, d, "customer")
    nodes = nations.select(F.col("n_nationkey").alias("id"), F.array(F.col("n_regionkey").cast("string")).alias("cats"))
    edges = customers.select(F.col("c_custkey").alias("edge"), F.col("c_nationkey").alias("source"), ((F.col("c_nationkey") + F.col("c_custkey")) % 25).cast("int").alias("target"), F.array(F.lit("1"), F.lit("2")).alias("cats"))
    return induced_subgraph(nodes, edges, "1")[1].select("edge", "source", "target")


def met04_sequence_log_prob(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1).alias("label"), (-F.col("l_quantity") / 10).alias("logp"))
    return S.sequence_log_prob(li, ["l_orderkey"]).select("l_orderkey", F.round("logp", 9).alias("logp"))


def met05_preference_loss(spark, d):
    li = read(spark, d, "lineitem").select((-F.col("l_quantity") / 10).alias("w"), (-F.col("l_discount") * 40).alias("l"), F.lit(-2.0).alias("rw"), (-F.col("l_tax") * 40).alias("rl"))
    s = S.preference_loss(li, 0.1)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def _token_losses(spark, d):
    li = read(spark, d, "lineitem")
    label = F.when(F.col("l_linenumber") == 1, -1).when(F.col("l_linenumber") % 2 == 0, 3).when(F.col("l_linenumber") == 3, 0).otherwise(F.col("l_suppkey").cast("int") + 4)
    return li.select(label.alias("label"), (F.col("l_suppkey") % 7 + 3).cast("int").alias("pred"), (F.col("l_quantity") / 10).alias("loss"), (F.col("l_linenumber") - 1).alias("codebook"))


def met01_text_loss(spark, d):
    s = S.masked_text_loss(_token_losses(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def met02_audio_loss(spark, d):
    """Main stream alone, and with the user's codebooks 8 to 16."""
    book = ((F.col("l_orderkey") + F.col("l_linenumber")) % 17).cast("int")
    li = read(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_suppkey").cast("int")).alias("label"), (F.col("l_quantity") / 10).alias("loss"), book.alias("codebook"))
    both = S.weighted_audio_loss(li, user_stream=True).select(F.round("audio_loss", 6).alias("with_user"))
    return S.weighted_audio_loss(li).select(F.round("audio_loss", 6).alias("audio_loss")).crossJoin(F.broadcast(both))


def met03_total_loss(spark, d):
    t = S.masked_text_loss(_token_losses(spark, d)).crossJoin(F.broadcast(S.weighted_audio_loss(_token_losses(spark, d))))
    total = F.coalesce("non_pad_loss", F.lit(0.0)) + 0.5 * F.coalesce("pad_loss", F.lit(0.0)) + F.col("audio_loss")
    return t.select(F.round(total, 6).alias("total"))


def met06_rewards(spark, d):
    return S.rewards(_candidates(spark, d), 0.2, {"naturalness": 1.0}).select("event_id", "vetoed", F.round("reward", 6).alias("reward"))


def _exports(spark, d):
    """Exports made of all rows of a dialogue against prelabels that are unchanged, three times as long, absent or of another text; some lack their audio."""
    ch = F.when(F.col("speaker").isin("ch_1", "ch_2"), F.col("speaker")).when(F.col("speaker") == "A", "ch_1").when(F.col("speaker") == "B", "ch_2")
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    w = read(spark, d, "word_transcripts").select("dialogue_id", "row_id", ch.alias("channelId"), ms("start").alias("startMs"), ms("end").alias("endMs"), F.col("word").alias("transcript"))
    one = w.groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "channelId", "startMs", "endMs", "transcript"))).alias("segments"))
    kind = F.ascii(F.md5("dialogue_id")) % 4
    other = F.transform("segments", lambda s: s.withField("transcript", F.concat(F.coalesce(s.transcript, F.lit("")), F.lit("x"))))
    pre = F.when(kind == 0, F.col("segments")).when(kind == 1, F.concat("segments", "segments", "segments")).when(kind == 2, other)
    complete = ~F.md5("dialogue_id").startswith("ff")
    return one.withColumn("prelabel", pre).select("dialogue_id", S.annotation_problems("segments", "prelabel", complete).alias("problems"))


def met07_annotation_qa(spark, d):
    return _exports(spark, d).select("dialogue_id", F.explode("problems").alias("problem"))


def met08_graph_lint(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    nodes = c.select(name(F.col("k") % 1400).alias("id"), F.when(F.col("k") % 1400 > 10, name(F.floor(F.col("k") % 1400 / 2))).when(F.col("k") % 1400 == 9, F.lit("n8")).when(F.col("k") % 1400 == 8, F.lit("n9")).alias("parent"))
    edge = F.when(F.col("k") % 97 == 5, F.lit("n5")).when(F.col("k") % 101 == 7, F.lit("concat")).when(F.col("k") % 103 == 9, F.lit("e 9")).otherwise(F.concat(F.lit("e"), "k"))
    edges = c.select(edge.alias("id"), F.when(F.col("k") % 31 != 0, name(F.col("k") % 1400)).alias("source"), F.when(F.col("k") % 37 != 0, name(F.col("k") % 1450)).alias("target"), (F.col("k") % 2 == 0).alias("source_point"))
    return S.graph_problems(nodes, edges)


def met09_marker_mean(spark, d):
    """Over all tokens, and over those of one label alone that is never said: NaN."""
    rows = _token_losses(spark, d)
    never = S.text_losses(rows, [-7]).select(F.isnan("marked").alias("unsaid_is_nan"))
    return S.text_losses(rows, [5, 6, 7, 8]).select(F.round("mean", 6).alias("mean"), F.round("marked", 6).alias("marked")).crossJoin(F.broadcast(never))


def bat03_alternating(spark, d):
    base, alt = docs(spark, d).select(F.col("doc_id").alias("id")), read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return S.alternating_batches(base, alt, 3, 8, 4, seed=5)


def bat04_length_batches(spark, d):
    rows = number_rows(docs(spark, d).select("doc_id", F.length("text").alias("n")), [F.col("n"), F.col("doc_id")], "k")
    return rows.groupBy(F.floor(F.col("k") / 32).alias("batch_id")).agg(F.count("*").alias("n"), F.max("n").alias("longest"))


def bat05_static_split(spark, d):
    """Contiguous near-equal parts of the sorted documents (the first ones longer by one)."""
    return J.contiguous_parts(read(spark, d, "documents").select("doc_id"), "doc_id", 7)


def bat06_resume(spark, d):
    epoch, skip = J.resume_position(F.col("event_id"), 313, 4)
    return read(spark, d, "events").select("event_id", skip.alias("skip"), epoch.alias("epoch"))


def bat07_upsample(spark, d):
    return repeated(read(spark, d, "dialogues").select("dialogue_id").distinct(), 3)


def mth01_float_frame(spark, d):
    """Frames of word starts by floor division; the SQL computes them from whole milliseconds, which cannot tie."""
    w = read(spark, d, "word_transcripts").where("start IS NOT NULL").select("row_id", (F.round(F.col("start") * 1000) + 0.5).alias("ms"))
    return w.select("row_id", X.float_frame(F.col("ms") / 1000).alias("frame"))


def mth02_round_frame(spark, d):
    return read(spark, d, "word_transcripts").where("start IS NOT NULL").select("row_id", F.rint(F.col("start") * 12.5).cast("bigint").alias("frame"))


def mth03_ceil_div(spark, d):
    return read(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", F.expr("(n_chars + 299) div 300").alias("n_parts"))


def mth04_linspace(spark, d):
    rows = read(spark, d, "events").select("event_id", (F.col("event_id") % 9 + 1).cast("int").alias("n"), (F.col("event_id") % 50 + 10).cast("int").alias("span"))
    return rows.select("event_id", F.array_join(F.transform(X.linspace_positions(F.col("n"), F.col("span")), lambda x: x.cast("string")), ",").alias("at"))


def mth05_array_split(spark, d):
    rows = docs(spark, d).select("doc_id", F.length("text").alias("n"))
    return rows.select("doc_id", F.inline(X.part_bounds(F.col("n"), 512)))


def mth06_edge_width(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.greatest(F.lit(1.0), F.sqrt(F.sum("l_quantity"))), 9).alias("width"))


def mth07_rounding(spark, d):
    return read(spark, d, "events").select("event_id", F.bround(F.col("event_id") % 1000 / 16.0, 3).alias("r"))


def tim01_rebase(spark, d):
    w = read(spark, d, "word_transcripts").where("start IS NOT NULL AND `end` IS NOT NULL")
    s, e = F.greatest("start", F.lit(5.0)), F.least("end", F.lit(25.0))
    return w.where(e - s > 0).select("row_id", F.rint((s - 5.0) * 1000).cast("bigint").alias("start_ms"), F.rint((e - 5.0) * 1000).cast("bigint").alias("end_ms"))


def tim02_char_times(spark, d):
    """Each character's share of its word's time."""
    w = read(spark, d, "word_transcripts").where("word <> '' AND `end` > start").select("row_id", "start", (F.col("end") - F.col("start")).alias("dur"), F.length("word").alias("n"), F.posexplode(T.chars(F.col("word"))).alias("k", "ch"))
    return w.select("row_id", "k", F.round(F.col("start") + F.col("k") * F.col("dur") / F.col("n"), 9).alias("s"), F.round(F.col("start") + (F.col("k") + 1) * F.col("dur") / F.col("n"), 9).alias("e"))


def stm01_decode(spark, d):
    """Messages built from the events, decoded by their first byte."""
    from turnweave.streaming.messages import decode_message

    kind = (F.col("event_id") % 9).cast("int")
    payload = F.to_binary(F.concat(F.lpad(F.hex(kind), 2, "0"), F.hex(F.encode(F.col("event_type"), "UTF-8"))), F.lit("hex"))
    rows = read(spark, d, "events").select("event_id", decode_message(F.when(F.col("event_id") % 10 == 0, F.unhex(F.lit(""))).otherwise(payload)).alias("m"))
    return rows.select("event_id", "m.kind", "m.text")


def stm03_rechunk(spark, d):
    """Batch twin of the re-chunker: frames of 1,920 samples, with the message in which each frame is complete."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 37 % 3000 + 1).alias("n"))
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("before", F.expr("(upto - n) div 1920")).withColumn("after", F.expr("upto div 1920"))
    return rows.where("after > before").select("user_id", "event_id", F.explode(F.sequence("before", F.col("after") - 1)).alias("frame"))


def stm04_phases(spark, d):
    """Frames of each user's session: the prompt's first (whole ones only), then the live ones, numbered on.

    Every user has every frame of the prompt. These rows lie frame by frame within blocks of users and ranges of frames:
    in a file each frame is then one run and the block's users repeat, where a user's frames in order would hardly compress.
    """
    a = read(spark, d, "documents").groupBy().agg(F.expr("coalesce(sum(n_chars), 0) div 1920").alias("n"))
    users = read(spark, d, "events").select("user_id").distinct()
    blocks = users.groupBy().agg(F.expr("greatest((count(*) + 255) div 256, 1)").alias("n_blocks"))
    block = F.expr("pmod(xxhash64(user_id), n_blocks)").alias("block")
    # Structs, as a list of bare ids would leave out a null.
    held = users.crossJoin(F.broadcast(blocks)).groupBy(block).agg(F.transform(F.collect_list(F.struct("user_id")), lambda u: u.user_id).alias("users"))
    ranges = held.crossJoin(F.broadcast(a)).where("n > 0").select("users", "n", F.explode(F.expr("sequence(0L, n - 1, 4096L)")).alias("low"))
    # A number of partitions that stays: these few rows become as many as users times the prompt's frames.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = ranges.repartition(parts).select("users", F.explode(F.expr("sequence(low, least(low + 4095, n - 1))")).alias("k"))
    # ``coalesce`` moves nothing, but ends the generated code: within it a range's rows, a million, would all be held before the first is written.
    prompt = frames.coalesce(parts).select(F.explode("users").alias("user_id"), F.lit(0).alias("phase"), "k").withColumn("frame", F.col("k"))
    # Both phases count their frames from 0 without holes.
    live = stm03_rechunk(spark, d).crossJoin(F.broadcast(a)).select("user_id", F.lit(1).alias("phase"), F.col("frame").alias("k"), (F.col("n") + F.col("frame")).alias("frame"))
    return prompt.unionByName(live)


def stm05_text_emission(spark, d):
    from turnweave.plans.token_streams import sides

    kept = F.filter(F.get("A", F.lit(0)), lambda x: ~x.isin(0, 3))
    return sides(spark, d).select("row_id", F.size(kept).alias("n"), F.replace(F.concat(F.lit("▁"), F.array_join(F.transform(kept, lambda x: x.cast("string")), "▁")), F.lit("▁"), F.lit(" ")).alias("text"))


def stm07_idle_sessions(spark, d):
    """Sessions of a user that end after ten minutes without a message."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return s.select("user_id", "first_id", "n")


def stm08_accumulate(spark, d):
    """Text of each socket of a user so far: a handshake (event_id divisible by 9) opens a new one, which empties the text but not the count of messages."""
    from turnweave.streaming.live import accumulated

    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 9 == 0).alias("opens"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("text"))
    out = accumulated(e, "user_id", "event_id")
    return out.select("user_id", "socket", "n", "n_total", F.md5("text").alias("digest"))


def tok18_overlay(spark, d):
    """All turns laid over their dialogue's frames: ids are turn lengths, times run on evenly and overlap."""
    from turnweave.operators.streams import overlay_turns

    t = turns(spark, d).select("doc_id", "speaker", F.col("pos").alias("turn"), (F.col("pos") * 11).alias("f0"), (F.col("pos") * 11 + F.length("text") % 30).alias("f1"), F.transform(F.sequence(F.lit(1), F.length("text") % 12 + 1), lambda k: F.col("pos") * 100 + k + 10).alias("ids"))
    frames = t.groupBy("doc_id").agg((F.max("turn") * 11 + 30).alias("n_frames"))
    return overlay_turns(t, frames, "doc_id").select("doc_id", "speaker", X.digest(F.col("text")).alias("digest"), "dropped")


def tok24_chat_ids(spark, d):
    """Ids of a chat with either speaker first: markers in turn, each before its normalised sentence's ids (here code points)."""
    code = lambda t: F.transform(T.chars(t), lambda c: F.ascii(c) % 31_996 + 4)
    chats = turns(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text).alias("texts"))
    both = [X.chat_ids(F.col("texts"), code, first).alias(name) for name, first in (("main_first", True), ("other_first", False))]
    g = chats.select("doc_id", *both)
    return g.select("doc_id", F.size("main_first").alias("n"), X.digest(F.col("main_first")).alias("digest"), X.digest(F.col("other_first")).alias("other_digest"))


def tok23_text_blocks(spark, d):
    """A block per text: first id, prompt, separator, body, cut at 512; texts without a prompt have none of it."""
    code = lambda t: F.transform(T.chars(t), lambda c: F.ascii(c) % 31_996 + 4)
    ids, prompt_len = X.text_block(F.col("text"), code, 512)
    return docs(spark, d).select("doc_id", prompt_len.alias("prompt_len"), X.digest(ids).alias("digest"))


def tok23_text_concat(spark, d):
    """The texts of 16 documents end to end, cut into near-equal blocks of at most 2,048 ids: groups are batches of a fixed size."""
    code = lambda t: F.transform(T.chars(t), lambda c: F.ascii(c) % 31_996 + 4)
    ids, _ = X.text_block(F.col("text"), code, None)
    rows = docs(spark, d).select(F.floor(F.col("doc_id") / 16).alias("grp"), F.struct("doc_id", ids.alias("ids")).alias("x"))
    flat = rows.groupBy("grp").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda q: q.ids)).alias("ids"))
    blocks = flat.select("grp", F.posexplode(X.split(F.array("ids"), 2_048)).alias("block", "m"))
    return blocks.select("grp", "block", F.size(F.get("m", F.lit(0))).alias("n"), X.digest(F.get("m", F.lit(0))).alias("digest"))


def tok31_swapped_prompts(spark, d):
    """Each row with the prompt of its own style and with that of the opposite style."""
    s = docs(spark, d).select("doc_id", T.formality(F.col("text")).alias("style")).where("style <> 'mixed'")
    rows = s.withColumn("how", F.explode(F.array(F.lit("matched"), F.lit("swapped"))))
    use = F.when(F.col("how") == "matched", F.col("style")).otherwise(F.when(F.col("style") == "polite", "casual").otherwise("polite"))
    prompts = spark.createDataFrame([("polite", "丁寧な話し方で話します。"), ("casual", "くだけた話し方で話します。")], "use string, prompt string")
    return rows.withColumn("use", use).join(F.broadcast(prompts), "use").select("doc_id", "how", "prompt")


def jsn03_config_diff(spark, d):
    """Keys on which two flat maps differ, apart from those that may."""
    a = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("a"))
    b = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_size") + F.when(F.col("p_partkey") % 9 == 0, 1).otherwise(0)).cast("string").alias("b"))
    return a.join(b, "k").where("a <> b AND k NOT IN ('9', '18')").select("k", "a", "b")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if re.match(r"[a-z]{2,3}\d\d_", k)}


def oracle_sql() -> dict[str, str]:
    from turnweave.plans import corpus as P
    from turnweave.plans import sql as Q

    turn = P._TURNS
    cer = "c AS (SELECT rec_id, stem, cer, shard FROM cer_all WHERE cer IS NOT NULL AND NOT isnan(cer) AND abs(cer) < 1e9 AND stem IS NOT NULL)"
    exports = f"""WITH s AS (SELECT dialogue_id, row_id, CASE WHEN speaker IN ('ch_1', 'ch_2') THEN speaker WHEN speaker = 'A' THEN 'ch_1' WHEN speaker = 'B' THEN 'ch_2' END AS c, round(start * 1000) AS a, round("end" * 1000) AS b,
              regexp_replace(coalesce(word, ''), '^[{P._SPACE}]+|[{P._SPACE}]+$', '', 'g') AS w, row_number() OVER (PARTITION BY dialogue_id ORDER BY row_id) - 1 AS i, ascii(md5(dialogue_id)) % 4 AS kind, starts_with(md5(dialogue_id), 'ff') AS bad FROM word_transcripts),
            k AS (SELECT * FROM s WHERE NOT bad), g AS (SELECT dialogue_id, any_value(kind) AS kind, count(*) AS n, count(*) FILTER (w = '') AS e, count(*) FILTER (c IS NOT NULL) AS own, count(*) FILTER (c IS NOT NULL AND w <> '') AS said FROM k GROUP BY 1)
            SELECT DISTINCT dialogue_id, 'not a valid export' AS problem FROM s WHERE bad UNION ALL SELECT dialogue_id, 'seg[' || i || '] bad channelId' FROM k WHERE c IS NULL
            UNION ALL SELECT dialogue_id, 'seg[' || i || '] bad span' FROM k WHERE a IS NULL OR b IS NULL OR b <= a
            UNION ALL SELECT dialogue_id, 'seg[' || i || '] illegal tag ' || unnest(list_filter(regexp_extract_all(w, '[（(][^（）()]*[）)]'), lambda t: regexp_replace({P._WIDE('t')}, '[{P._SPACE}]+', '', 'g') NOT IN ('(笑)', '(不明)'))) FROM k
            UNION ALL SELECT dialogue_id, e || '/' || n || ' empty transcripts' FROM g WHERE e > 0 UNION ALL SELECT dialogue_id, 'identical to prelabel' FROM g WHERE kind = 0 OR kind = 1 AND said = 0 OR kind = 2 AND own = 0
            UNION ALL SELECT dialogue_id, 'segment count dropped ' || 3 * n || '->' || n FROM g WHERE kind = 1"""
    cand = "k AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN round_even(value, 4) END AS naturalness, event_id % 11 / 11.0 AS distinct_ratio, CASE WHEN event_id % 5 <> 0 THEN event_id % 10 / 10.0 END AS balance FROM events)"
    reward = f"{cand}, z AS (SELECT avg(naturalness) AS m, stddev_pop(naturalness) + 1e-6 AS s FROM k), r AS (SELECT k.*, coalesce(balance < 0.2, false) AS vetoed, CASE WHEN NOT coalesce(balance < 0.2, false) THEN coalesce((naturalness - m) / s, 0) + 0.5 * distinct_ratio + coalesce(0.5 * balance, 0) END AS reward FROM k, z)"
    seg = "g AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS ch, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + 1000 + event_id % 9000 * 100 AS e FROM events)"
    cuts = f"{seg}, w AS (SELECT user_id, s, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM g), cuts AS (SELECT user_id, (r + s) / 2.0 AS cut FROM w WHERE s - r >= 60000 UNION SELECT user_id, 0.0 FROM g UNION SELECT user_id, CAST(max(e) AS DOUBLE) FROM g GROUP BY 1)"
    sweep = f"{seg}, v AS (SELECT user_id, t, sum(CASE WHEN ch = 'A' THEN d ELSE 0 END) AS a, sum(CASE WHEN ch = 'B' THEN d ELSE 0 END) AS b FROM (SELECT user_id, ch, s AS t, 1 AS d FROM g UNION ALL SELECT user_id, ch, e, -1 FROM g) GROUP BY 1, 2), o AS (SELECT user_id, sum(a) OVER w AS a, sum(b) OVER w AS b, lead(t) OVER w - t AS ms FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t)), ov AS (SELECT user_id, CAST(coalesce(sum(CASE WHEN a > 0 AND b > 0 THEN ms END), 0) AS BIGINT) AS both_ms FROM o GROUP BY 1)"
    losses = "t AS (SELECT CASE WHEN l_linenumber = 1 THEN -1 WHEN l_linenumber % 2 = 0 THEN 3 WHEN l_linenumber = 3 THEN 0 ELSE l_suppkey + 4 END AS label, l_suppkey % 7 + 3 AS pred, l_quantity / 10 AS loss, l_linenumber - 1 AS codebook FROM lineitem)"
    text_loss = "avg(loss) FILTER (label NOT IN (3, -1)) AS non_pad_loss, avg(loss) FILTER (label = 3) AS pad_loss, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FILTER (label NOT IN (3, -1)) AS non_pad_accuracy, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FILTER (label = 3) AS pad_accuracy"
    audio = lambda label: f"sum(CASE WHEN {label} <> -1 THEN (CASE WHEN codebook = 0 THEN 100.0 ELSE 1.0 END) * loss ELSE 0 END) / sum(CASE WHEN {label} <> -1 THEN CASE WHEN codebook = 0 THEN 100.0 ELSE 1.0 END ELSE 0 END)"
    chunk = "m AS (SELECT user_id, event_id, n, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM (SELECT *, event_id * 37 % 3000 + 1 AS n FROM events)), f AS (SELECT user_id, event_id, unnest(range(CAST((upto - n) // 1920 AS BIGINT), CAST(upto // 1920 AS BIGINT))) AS frame FROM m)"
    code = lambda t: f"list_transform(string_split({t}, ''), lambda c: unicode(c) % 31996 + 4)"
    digest = lambda a: f"md5(array_to_string(list_transform({a}, lambda q: CAST(q AS VARCHAR)), ','))"
    blocks = f"WITH x AS (SELECT doc_id, text, strpos(text, chr(10) || '---' || chr(10)) AS p FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, p, lower(CASE WHEN p > 0 THEN text[1:p - 1] ELSE '' END) AS a, lower(CASE WHEN p > 0 THEN text[p + 5:] ELSE text END) AS b FROM x), z AS (SELECT doc_id, p, CASE WHEN a = '' THEN [] ELSE {code('a')} END AS a, CASE WHEN b = '' THEN [] ELSE {code('b')} END AS b FROM y), w AS (SELECT doc_id, p, a, CASE WHEN p > 0 THEN list_concat(list_concat(list_concat([1], a), [2]), b) ELSE list_concat([1], b) END AS ids FROM z)"
    return {
        "agg01_distribution": f"WITH {cer}, o AS (SELECT list(cer ORDER BY cer) AS v, count(*) AS n FROM c) SELECT n, round(list_avg(v), 9) AS mean, list_median(v) AS median, v[n] AS most, v[least(n - 1, CAST(floor(0.1 * n) AS BIGINT)) + 1] AS p10, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1] AS p90, v[least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) + 1] AS p99 FROM o",
        "agg02_prefix_means": f"WITH {cer} SELECT array_to_string(string_split(lower(stem), '_')[1:2], '_') AS prefix, count(*) AS n, round(avg(cer), 9) AS mean FROM c GROUP BY 1",
        "agg04_z_statistics": f"WITH {cand} SELECT round(avg(naturalness), 6) AS naturalness_mean, round(stddev_pop(naturalness) + 1e-6, 6) AS naturalness_std, round(avg(balance), 6) AS balance_mean, round(stddev_pop(balance) + 1e-6, 6) AS balance_std FROM k",
        "agg06_channel_balance": "WITH r AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 32 + 1e-12) AS a, sqrt(list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 32 + 1e-12) AS b FROM embeddings) SELECT vec_id, round(least(a, b) / greatest(a, b), 6) AS balance FROM r",
        "agg07_silence_cuts": f"WITH {cuts} SELECT user_id, CAST(cut AS DOUBLE) AS cut FROM cuts",
        "agg08_overlap": f"WITH {sweep} SELECT * FROM ov",
        "agg10_channel_text": f"WITH {turn} SELECT doc_id, speaker, md5(string_agg(text, '' ORDER BY pos)) AS digest FROM turns GROUP BY 1, 2",
        "agg11_mean_without_nan": "SELECT shard, round(coalesce(avg(cer) FILTER (NOT isnan(cer) AND abs(cer) < 1e9), -1.0), 9) AS mean FROM cer_all GROUP BY 1",
        "agg12_tag_channel": f"WITH {cer}, t AS (SELECT string_split(lower(stem), '_')[1] AS tag, CASE WHEN rec_id % 2 = 0 THEN 'L' ELSE 'R' END AS ch, cer FROM c) SELECT tag, coalesce(ch, 'pooled') AS ch, count(*) AS n, round(avg(cer), 9) AS mean, round(median(cer), 9) AS median FROM t GROUP BY GROUPING SETS ((tag, ch), (tag))",
        "agg13_rank_mean": f"WITH {cer} SELECT round(avg(m), 9) AS mean FROM (SELECT avg(cer) AS m FROM c GROUP BY rec_id % 8)",
        "agg15_corpus_summary": f"WITH {sweep} SELECT count(*) AS n, CAST(sum(both_ms) AS BIGINT) AS both_ms, round(100.0 * sum(both_ms) / greatest((SELECT sum(e - s) FROM g), 1), 6) AS overlap_pct FROM ov",
        "agg17_flip_summary": "WITH f AS (SELECT l_returnflag AS style, l_extendedprice / 1e4 AS m, l_quantity / 5 AS s FROM lineitem WHERE l_linenumber <> 7) SELECT coalesce(style, 'all') AS style, count(*) AS n, round(avg(m), 6) AS matched, round(avg(s), 6) AS swapped, round(avg(s - m), 6) AS effect, round(100.0 * avg(CASE WHEN m < s THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f GROUP BY GROUPING SETS ((style), ())",
        "agg18_directional": "SELECT count(*) AS n, count(*) FILTER (ok) AS n_both FROM (SELECT user_id, bool_and(value < 60) AS ok FROM events GROUP BY 1)",
        "agg19_status_totals": f"""WITH p AS ({exports}), g AS (SELECT dialogue_id, bool_and(regexp_matches(problem, '^[0-9]+/[0-9]+ empty transcripts$|^identical to prelabel$|^segment count dropped ')) AS doubtful FROM p GROUP BY 1)
            SELECT CASE WHEN doubtful IS NULL THEN 'PASS' WHEN doubtful THEN 'WARN' ELSE 'FAIL' END AS status, count(*) AS n FROM (SELECT DISTINCT dialogue_id FROM word_transcripts) LEFT JOIN g USING (dialogue_id) GROUP BY 1""",
        "win03_preference_pairs": f"WITH {reward}, p AS (SELECT user_id, count(*) AS n, max(reward) - min(reward) AS gap, list(event_id ORDER BY reward DESC, event_id) AS ids FROM r WHERE reward IS NOT NULL GROUP BY 1) SELECT user_id, n, ids[1] AS chosen, ids[n] AS rejected, round(gap, 6) AS gap FROM p WHERE n >= 2 AND gap >= 0.5",
        "win04_length_order": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS k FROM documents WHERE text IS NOT NULL",
        "win05_first_n": "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS example_id FROM documents ORDER BY doc_id LIMIT 100",
        "win06_slice": "SELECT * FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS k FROM (SELECT 'd' || doc_id AS name FROM documents UNION ALL SELECT 'c' || rec_id FROM cer_all)) WHERE k >= 500 AND k < 1500",
        "win07_first_k_per_style": f"SELECT * FROM (SELECT doc_id, style, CAST(row_number() OVER (PARTITION BY style ORDER BY doc_id) AS INTEGER) AS k FROM (SELECT doc_id, {P._STYLE} AS style FROM documents WHERE text IS NOT NULL)) WHERE k <= 5",
        "win08_first_per_topic": "SELECT topic, min(dialogue_id) AS first_id FROM dialogues WHERE topic IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 20",
        "win09_next_topic": "WITH t AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT topic FROM dialogues WHERE topic IS NOT NULL)) SELECT a.topic, b.topic AS next_topic FROM t a JOIN t b ON b.k = (a.k + 7) % a.n",
        "win10_caps": "SELECT * FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS k FROM events) WHERE k <= 3 ORDER BY event_id LIMIT 200",
        "win11_spans": f"WITH {Q.V1}, c AS (SELECT row_id, t, x FROM (SELECT row_id, unnest(range(len(a[1]))) AS t, unnest(a[1]) AS x FROM v1) WHERE x NOT IN (0, 3)), r AS (SELECT *, sum(f) OVER (PARTITION BY row_id ORDER BY t) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY row_id ORDER BY t) <= 4 THEN 0 ELSE 1 END AS f FROM c)) SELECT * FROM (SELECT row_id, CAST(run AS BIGINT) AS run, CAST(min(t) AS INTEGER) AS start, CAST(max(t) AS INTEGER) AS \"end\", count(*) AS n FROM r GROUP BY row_id, run) QUALIFY count(*) OVER (PARTITION BY row_id) = row_id % 12 + 1",
        "win12_proportional": f"WITH {turn}, x AS (SELECT doc_id, pos, greatest(length(text), 1) AS n, sum(greatest(length(text), 1)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(greatest(length(text), 1)) OVER (PARTITION BY doc_id) AS total FROM turns) SELECT doc_id, pos, CAST(round_even(CAST(1000.0 AS DOUBLE) * (upto - n) / total, 0) AS BIGINT) AS s, CAST(round_even(CAST(1000.0 AS DOUBLE) * upto / total, 0) AS BIGINT) AS e FROM x",
        "win13_window_choice": f"WITH {cuts}, l AS (SELECT user_id, max(cut) AS total FROM cuts GROUP BY 1), s AS (SELECT user_id, arg_min(cut, md5(user_id || ':' || CAST(floor(cut) AS BIGINT))) AS t0, any_value(total) AS total FROM cuts JOIN l USING (user_id) WHERE cut < total - 1000 GROUP BY 1), t AS (SELECT s.user_id, t0, coalesce((SELECT min(cut) FROM cuts c WHERE c.user_id = s.user_id AND c.cut >= t0 + 3600000), total) AS t1 FROM s) SELECT user_id, CAST(t0 AS DOUBLE) AS t0, CAST(t1 AS DOUBLE) AS t1 FROM t WHERE t1 - t0 >= 1000",
        "jn06_score_lookup": "SELECT event_id, a.natural, b.n_chars AS meaning FROM events LEFT JOIN (SELECT o_orderkey, max(o_totalprice) AS \"natural\" FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a ON o_orderkey = event_id LEFT JOIN documents b ON doc_id = event_id",
        "jn07_candidate_grid": "SELECT DISTINCT user_id, event_type AS seed FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'click')",
        "jn08_gold_pairs": "SELECT doc_id AS name FROM documents WHERE doc_id % 6 = 0",
        "jn09_prelabel": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR n_chars IS NULL THEN 'WARN' ELSE 'ok' END AS status FROM documents",
        "jn12_positional": "SELECT k, c_custkey, p_partkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part) USING (k)",
        "jn13_reference_log_probs": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(-value, 0) ELSE 0.0 END AS w, CASE WHEN event_id % 3 = 0 THEN coalesce(value, 0) ELSE 0.0 END AS l FROM events",
        "flt02_by_speaker": f"WITH {turn} SELECT doc_id, count(*) FILTER (speaker = 'A') AS n_a, count(*) FILTER (speaker = 'B') AS n_b, CASE WHEN count(DISTINCT speaker) > 1 THEN 'several speakers' END AS problem FROM turns GROUP BY 1",
        "flt14_subgraph": "WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), e AS (SELECT c_custkey AS edge, c_nationkey AS source, CAST((c_nationkey + c_custkey) % 25 AS INTEGER) AS target FROM customer) SELECT * FROM e WHERE source IN (SELECT * FROM n) AND target IN (SELECT * FROM n)",
        "met04_sequence_log_prob": "SELECT l_orderkey, round(sum(CASE WHEN l_linenumber % 3 <> 0 THEN -l_quantity / 10 ELSE 0 END) / greatest(count(*) FILTER (l_linenumber % 3 <> 0), 1), 9) AS logp FROM lineitem GROUP BY 1",
        "met05_preference_loss": "WITH z AS (SELECT 0.1 * ((-l_quantity / 10 + 2.0) - (-l_discount * 40 + l_tax * 40)) AS z FROM lineitem) SELECT round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))), 6) AS loss, round(avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(z), 6) AS margin FROM z",
        "met01_text_loss": f"WITH {losses}, s AS (SELECT {text_loss} FROM t) SELECT round(non_pad_loss, 6) AS non_pad_loss, round(pad_loss, 6) AS pad_loss, round(non_pad_accuracy, 6) AS non_pad_accuracy, round(pad_accuracy, 6) AS pad_accuracy FROM s",
        "met02_audio_loss": """WITH t AS (SELECT l_quantity / 10 AS loss, (l_orderkey + l_linenumber) % 17 AS b, CASE WHEN (l_orderkey + l_linenumber) % 17 % 8 = 0 THEN 100.0 ELSE 1.0 END AS w FROM lineitem WHERE l_linenumber <> 1)
            SELECT round(sum(loss * w) FILTER (b < 8) / sum(w) FILTER (b < 8), 6) AS audio_loss, round(sum(loss * w) / sum(w), 6) AS with_user FROM t""",
        "met03_total_loss": f"WITH {losses}, s AS (SELECT {text_loss}, {audio('label')} AS audio_loss FROM t) SELECT round(non_pad_loss + 0.5 * pad_loss + audio_loss, 6) AS total FROM s",
        "met06_rewards": f"WITH {reward} SELECT event_id, vetoed, round(reward, 6) AS reward FROM r",
        "met07_annotation_qa": exports,
        "met08_graph_lint": """WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 1400 AS i FROM customer), n AS (SELECT 'n' || i AS id, CASE WHEN i > 10 THEN 'n' || (i // 2) WHEN i = 9 THEN 'n8' WHEN i = 8 THEN 'n9' END AS parent FROM c),
            e AS (SELECT CASE WHEN k % 97 = 5 THEN 'n5' WHEN k % 101 = 7 THEN 'concat' WHEN k % 103 = 9 THEN 'e 9' ELSE 'e' || k END AS id, CASE WHEN k % 31 <> 0 THEN 'n' || (k % 1400) END AS s, CASE WHEN k % 37 <> 0 THEN 'n' || (k % 1450) END AS t, k % 2 = 0 AS p FROM c),
            up AS (SELECT DISTINCT id, parent, 1 AS d FROM n WHERE parent IS NOT NULL UNION ALL SELECT up.id, m.parent, d + 1 FROM up JOIN (SELECT DISTINCT id, parent FROM n WHERE parent IS NOT NULL) m ON m.id = up.parent WHERE d < 40)
            SELECT 'duplicate id' AS problem, id FROM n GROUP BY id HAVING count(*) > 1
            UNION ALL SELECT DISTINCT 'odd id', id FROM e WHERE id = 'e 9' UNION ALL SELECT DISTINCT 'reserved name', id FROM e WHERE id = 'concat' UNION ALL SELECT DISTINCT 'vertex and edge', id FROM n WHERE id IN (SELECT id FROM e)
            UNION ALL SELECT DISTINCT 'dangling edge', id FROM (SELECT id, s AS x FROM e UNION ALL SELECT id, t FROM e) WHERE x IS NOT NULL AND x NOT IN (SELECT id FROM n) UNION ALL SELECT 'no source', id FROM e WHERE s IS NULL AND NOT p UNION ALL SELECT 'no target', id FROM e WHERE t IS NULL
            UNION ALL SELECT 'missing parent', id FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)
            UNION ALL SELECT DISTINCT 'parent cycle', id FROM up WHERE d = 40""",
        "met09_marker_mean": f"WITH {losses} SELECT round(avg(loss) FILTER (label NOT IN (-1, 3)), 6) AS mean, round(avg(loss) FILTER (label IN (5, 6, 7, 8)), 6) AS marked, true AS unsaid_is_nan FROM t",
        "bat03_alternating": """WITH b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(doc_id || ':5'), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT max(n) AS n, (max(n) + 31) // 32 AS nb FROM b),
            bb AS (SELECT id, k FROM b UNION ALL SELECT b.id, b.k + b.n FROM b, g WHERE b.k < g.nb * 32 - g.n), a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5(vec_id || ':5'), vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings),
            aa AS (SELECT a.id, a.k + c.i * a.n AS k FROM a, g, unnest(range(g.nb * 32 // a.n + 1)) AS c(i) WHERE a.k + c.i * a.n < g.nb // 3 * 32)
            SELECT k // 32 + k // 32 // 3 AS step, k % 32 // 8 AS rank, k % 32 % 8 AS slot, 'base' AS kind, id FROM bb UNION ALL SELECT (k // 32 + 1) * 4 - 1, k % 32 // 8, k % 32 % 8, 'alt', id FROM aa""",
        "bat04_length_batches": "SELECT k // 32 AS batch_id, count(*) AS n, CAST(max(n) AS INTEGER) AS longest FROM (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS k FROM documents WHERE text IS NOT NULL) GROUP BY 1",
        "bat05_static_split": "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS part FROM documents",
        "bat06_resume": "SELECT event_id, event_id % 313 * 4 AS skip, event_id // 313 AS epoch FROM events",
        "bat07_upsample": "SELECT dialogue_id, CAST(unnest([1, 2, 3]) AS INTEGER) AS copy FROM (SELECT DISTINCT dialogue_id FROM dialogues)",
        "mth01_float_frame": "SELECT row_id, CAST(round(start * 1000) AS BIGINT) // 80 AS frame FROM word_transcripts WHERE start IS NOT NULL",
        "mth02_round_frame": "SELECT row_id, CAST(round_even(start * CAST(12.5 AS DOUBLE), 0) AS BIGINT) AS frame FROM word_transcripts WHERE start IS NOT NULL",
        "mth03_ceil_div": "SELECT doc_id, (n_chars + 299) // 300 AS n_parts FROM documents WHERE n_chars IS NOT NULL",
        "mth04_linspace": "WITH r AS (SELECT event_id, event_id % 9 + 1 AS n, event_id % 50 + 10 AS span FROM events) SELECT event_id, array_to_string(list_transform(range(n), lambda i: CAST(CASE WHEN i = n - 1 AND n > 1 THEN span - 1 ELSE CAST(floor(i * ((span - 1) / greatest(n - 1, 1))) AS BIGINT) END AS VARCHAR)), ',') AS at FROM r",
        "mth05_array_split": "WITH r AS (SELECT doc_id, length(text) AS n, (length(text) + 511) // 512 AS p FROM documents WHERE text IS NOT NULL AND length(text) > 0), k AS (SELECT *, unnest(range(p)) AS k FROM r) SELECT doc_id, CAST(k * (n // p) + least(k, n % p) AS INTEGER) AS start, CAST(n // p + CASE WHEN k < n % p THEN 1 ELSE 0 END AS INTEGER) AS size FROM k",
        "mth06_edge_width": "SELECT l_suppkey, round(greatest(1.0, sqrt(sum(l_quantity))), 9) AS width FROM lineitem GROUP BY 1",
        "mth07_rounding": "SELECT event_id, round_even(event_id % 1000 / CAST(16 AS DOUBLE), 3) AS r FROM events",
        "tim01_rebase": 'SELECT row_id, CAST(round_even((greatest(start, 5.0) - 5.0) * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even((least("end", 25.0) - 5.0) * 1000, 0) AS BIGINT) AS end_ms FROM word_transcripts WHERE start IS NOT NULL AND "end" IS NOT NULL AND least("end", 25.0) - greatest(start, 5.0) > 0',
        "tim02_char_times": 'WITH w AS (SELECT row_id, start, "end" - start AS dur, length(word) AS n, unnest(range(length(word))) AS k FROM word_transcripts WHERE word <> \'\' AND "end" > start) SELECT row_id, CAST(k AS INTEGER) AS k, round(start + k * dur / n, 9) AS s, round(start + (k + 1) * dur / n, 9) AS e FROM w',
        "stm01_decode": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'empty' ELSE (['handshake', 'audio', 'text', 'control', 'metadata', 'error', 'ping', 'coloured', 'unknown'])[event_id % 9 + 1] END AS kind, CASE WHEN event_id % 10 <> 0 AND event_id % 9 IN (2, 4, 5) THEN event_type WHEN event_id % 10 <> 0 AND event_id % 9 = 7 THEN event_type[2:] END AS text FROM events",
        "stm03_rechunk": f"WITH {chunk} SELECT user_id, event_id, frame FROM f",
        "stm04_phases": f"WITH {chunk}, p AS (SELECT user_id, 0 AS phase, unnest(range((SELECT CAST(sum(coalesce(n_chars, 0)) // 1920 AS BIGINT) FROM documents))) AS k FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, 1, frame FROM f) SELECT user_id, CAST(phase AS INTEGER) AS phase, k, row_number() OVER (PARTITION BY user_id ORDER BY phase, k) - 1 AS frame FROM p",
        "stm05_text_emission": f"WITH {Q.V1}, k AS (SELECT row_id, list_filter(a[1], lambda x: x NOT IN (0, 3)) AS x FROM v1) SELECT row_id, CAST(len(x) AS INTEGER) AS n, replace('▁' || array_to_string(list_transform(x, lambda q: CAST(q AS VARCHAR)), '▁'), '▁', ' ') AS text FROM k",
        "stm07_idle_sessions": "WITH s AS (SELECT user_id, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS f, ts FROM events), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM r GROUP BY user_id, g",
        "stm08_accumulate": """WITH s AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS socket FROM events),
            g AS (SELECT user_id, CAST(socket AS BIGINT) AS socket, count(*) AS n, md5(string_agg(event_type, '' ORDER BY event_id)) AS digest FROM s WHERE event_id % 9 <> 0 GROUP BY 1, 2)
            SELECT user_id, socket, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY socket) AS BIGINT) AS n_total, digest FROM g""",
        "tok18_overlay": f"""WITH {turn}, t AS (SELECT doc_id, speaker, pos, pos * 11 AS f0, greatest(1, length(text) % 30) AS span, length(text) % 12 + 1 AS n FROM turns),
            k AS (SELECT *, unnest(range(least(n, span))) AS k FROM t), c AS (SELECT doc_id, speaker, pos, f0 + CASE WHEN span >= n THEN CASE WHEN k = n - 1 AND n > 1 THEN span - 1 ELSE CAST(floor(k * ((span - 1) / greatest(n - 1, 1))) AS BIGINT) END ELSE k END AS frame, pos * 100 + k + 11 AS id FROM k),
            l AS (SELECT doc_id, speaker, frame, arg_max(id, pos) AS id FROM c GROUP BY 1, 2, 3), m AS (SELECT doc_id, speaker, map(list(frame), list(id)) AS m FROM l GROUP BY 1, 2), d AS (SELECT doc_id, speaker, CAST(sum(greatest(n - span, 0)) AS BIGINT) AS dropped FROM t GROUP BY 1, 2)
            , z AS (SELECT doc_id, max(pos) * 11 + 30 AS frames FROM turns GROUP BY 1)
            SELECT doc_id, speaker, {digest('list_transform(range(frames), lambda f: coalesce(m[f], 3))')} AS digest, dropped FROM m JOIN d USING (doc_id, speaker) JOIN z USING (doc_id)""",
        "tok24_chat_ids": f"""WITH {turn}, s AS (SELECT doc_id, pos, {P._WIDE(f"lower(regexp_replace(text, '^[{P._SPACE}]+|[{P._SPACE}]+$', '', 'g'))")} AS s FROM turns), q AS (SELECT doc_id, pos, CASE WHEN regexp_matches(s, '[。、!?]$') THEN s ELSE s || '。' END AS s FROM s),
            x AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) % 2 AS odd, {code('s')} AS ids FROM q),
            y AS (SELECT doc_id, flatten(list(list_concat([CASE WHEN odd = 1 THEN 1 ELSE 2 END], ids) ORDER BY pos)) AS a, flatten(list(list_concat([CASE WHEN odd = 1 THEN 2 ELSE 1 END], ids) ORDER BY pos)) AS b FROM x GROUP BY 1)
            SELECT doc_id, CAST(len(a) AS INTEGER) AS n, {digest('a')} AS digest, {digest('b')} AS other_digest FROM y""",
        "tok23_text_blocks": f"{blocks} SELECT doc_id, CAST(CASE WHEN p > 0 THEN least(len(a) + 2, 512) ELSE 0 END AS INTEGER) AS prompt_len, {digest('ids[1:512]')} AS digest FROM w",
        "tok23_text_concat": f"""{blocks}, f AS (SELECT doc_id // 16 AS grp, flatten(list(ids ORDER BY doc_id)) AS ids FROM w GROUP BY 1), g AS (SELECT *, len(ids) AS t, (len(ids) + 2047) // 2048 AS nb FROM f), h AS (SELECT grp, ids, t // nb AS base, t % nb AS extra, unnest(range(nb)) AS block FROM g),
            o AS (SELECT grp, block, ids[block * base + least(block, extra) + 1 : (block + 1) * base + least(block + 1, extra)] AS x FROM h) SELECT grp, CAST(block AS INTEGER) AS block, CAST(len(x) AS INTEGER) AS n, {digest('x')} AS digest FROM o""",
        "tok31_swapped_prompts": f"WITH s AS (SELECT doc_id, {P._STYLE} AS style FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, style, unnest(['matched', 'swapped']) AS how FROM s WHERE style <> 'mixed') SELECT doc_id, how, CASE WHEN (style = 'polite') = (how = 'matched') THEN '丁寧な話し方で話します。' ELSE 'くだけた話し方で話します。' END AS prompt FROM r",
        "jsn03_config_diff": "SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS a, CAST(p_size + 1 AS VARCHAR) AS b FROM part WHERE p_partkey % 9 = 0 AND p_partkey NOT IN (9, 18)",
    }
