"""Queries of the corpus and text operators over documents, dialogues and word_transcripts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import text as T
from turnweave.operators import corpus as C

BUDGET = 300


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL")


def turns(spark, d):
    return C.drop_unusable(C.parse_turns(docs(spark, d)))


def str08_parse_dialogue(spark, d):
    """Generated dialogues: a model's leading role word goes, and so does a last turn that is not a finished sentence."""
    return C.parse_dialogue(docs(spark, d)).select("doc_id", "pos", "speaker", F.md5("text").alias("digest"))


def flt04_drop_unusable(spark, d):
    """How many lines are turns, how many have no text, and how many name no known speaker."""
    rows = C.lines(docs(spark, d)).select(F.regexp_extract("line", C.TURN, 1).alias("label"), F.regexp_extract("line", C.TURN, 2).alias("text"))
    return rows.agg(F.count("*").alias("n_lines"), F.count_if(F.expr("label = ''")).alias("n_unknown"), F.count_if(F.expr("label <> '' AND text = ''")).alias("n_empty"))


def win01_merge_turns(spark, d):
    return C.merge_turns(turns(spark, d)).select("doc_id", "pos", "speaker", F.md5("text").alias("digest"))


def win01_event_runs(spark, d):
    runs = C.runs(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def win02_chunks(spark, d):
    out = C.greedy_chunks(C.merge_turns(turns(spark, d)), BUDGET)
    return out.select("doc_id", "pos", "chunk", C.chunk_names(F.col("doc_id").cast("string"), F.col("chunk")).alias("name"))


def snk01_shards(spark, d):
    return C.shards(read(spark, d, "documents").select("doc_id"), "doc_id", 300, "docs").select("doc_id", "shard", "file")


def snk05_key_lists(spark, d):
    """Dialogues that lack tokens, and tokens' dialogues that lack words (missing lists)."""
    words, toks = read(spark, d, "word_transcripts"), read(spark, d, "dialogue_tokens")
    a = C.missing(words, toks, "dialogue_id").withColumn("lacks", F.lit("tokens"))
    return a.unionByName(C.missing(toks, words, "dialogue_id").withColumn("lacks", F.lit("words")))


def jn01_text_audio(spark, d):
    """Dialogues that have both words and tokens, with the number of rows of each."""
    words = read(spark, d, "word_transcripts").groupBy("dialogue_id").agg(F.count("*").alias("n_words"))
    toks = read(spark, d, "dialogue_tokens").groupBy("dialogue_id").agg(F.count("*").alias("n_exports"))
    return words.join(toks, "dialogue_id")


def jn03_resume(spark, d):
    done = read(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id")
    return C.pending(read(spark, d, "documents").select("doc_id"), done, "doc_id")


def jn04_lookup(spark, d):
    """Dialogues with their tokens' export, matched on the base name of a path; unmatched ones are dropped."""
    named = read(spark, d, "dialogue_tokens").select("row_id", F.concat(F.lit("slot/"), F.col("dialogue_id")).alias("path"))
    maps = read(spark, d, "dialogues").groupBy("dialogue_id").agg(F.min("topic").alias("topic"), F.min("lang").alias("lang"))
    return named.withColumn("dialogue_id", F.substring_index("path", "/", -1)).join(maps, "dialogue_id").where("topic IS NOT NULL").select("row_id", "topic", "lang")


def jn05_unmatched(spark, d):
    """Per language: dialogues, those with a topic, and those without (counted as unmatched)."""
    maps = read(spark, d, "dialogues").groupBy("dialogue_id").agg(F.min("topic").alias("topic"), F.min("lang").alias("lang"))
    return maps.groupBy("lang").agg(F.count("*").alias("n"), F.count("topic").alias("matched"), F.count_if(F.expr("topic IS NULL")).alias("unmatched"))


def jn11_manifest(spark, d):
    """Per source and form: documents and characters, all sources listed, forms that are absent with 0."""
    base = read(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source"), "form").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))
    slots = base.select("source").distinct().withColumn("form", F.explode(F.array(*map(F.lit, ("turns", "prose", "json", "prompt", "roles")))))
    return slots.join(base, ["source", "form"], "left").select("source", "form", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("chars", F.lit(0)).alias("chars"))


def flt05_split_membership(spark, d):
    """Dialogues whose topic's split list holds them: lists are exploded, membership is a semi join."""
    named = read(spark, d, "dialogues").groupBy("dialogue_id").agg(F.min("source").alias("source"))
    lists = spark.createDataFrame([("train", ["desk_calls", "open_line", "panel_talk"]), ("dev", ["chat_lab"])], "split string, sources array<string>")
    return named.join(lists.select("split", F.explode("sources").alias("source")).where("split = 'train'"), "source", "left_semi").select("dialogue_id")


def flt06_duration(spark, d):
    s = read(spark, d, "word_transcripts").where(F.col("end") - F.col("start") >= 0.0)
    return s.where(F.round((F.col("end") - F.col("start")) * 1000).between(2_000, 30_000)).select("row_id")


def _quality(spark, d):
    """Segments through the chain of drops; what costs a Python stage is asked only of those that the cheap rules leave."""
    rows = docs(spark, d).select("doc_id", "text", "lang", "n_chars")
    n_words = F.size(F.filter(F.split("text", rf"[{T.SPACES}]+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))
    cheap = C.reasons(
        rows,
        [
            ("len", ~F.length("text").between(20, 3_000)),
            ("empty", F.trim("text") == ""),
            ("quality", F.abs(F.length("text") - F.col("n_chars")) > 5),
        ],
    )
    late = C.reasons(
        cheap.where("reason IS NULL").drop("reason"),
        [
            ("hallucination", T.hallucination_reason(F.col("text"), 0.05, 0.3) != ""),
            ("no words", n_words == 0),
            ("no tokens", F.regexp_replace("text", rf"[{T.SPACES}]+", "") == ""),
            ("error", F.col("lang").isNull()),
        ],
    )
    return cheap.where("reason IS NOT NULL").unionByName(late)


def flt07_quality_gate(spark, d):
    """Events standing for scored segments: kept unless one of three scores is out of bounds."""
    e = read(spark, d, "events").select("event_id", (F.col("value") / 100).alias("no_speech"), (-F.col("value") / 50).alias("logprob"), (F.col("event_id") % 40 / 10.0).alias("compression"))
    return e.where("NOT (no_speech > 0.6 OR logprob < -1.0 OR compression > 2.4)").select("event_id")


def flt08_drop_reasons(spark, d):
    return C.reason_counts(_quality(spark, d))


def flt09_turn_gate(spark, d):
    """Dialogues of at least four turns, cut after the tenth."""
    from pyspark.sql import Window

    t = turns(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n >= 4")
    return t.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("k <= 10").select("doc_id", "pos", "k")


def flt10_threshold_sweep(spark, d):
    rows = read(spark, d, "cer_all").where("cer IS NOT NULL AND NOT isnan(cer)").select("rec_id", "cer")
    return C.threshold_sweep(rows, "cer", (0.1, 0.2, 0.3, 0.4, 0.5, 1.0)).groupBy("threshold").agg(F.count("*").alias("n"))


def flt12_modulo_shards(spark, d):
    from turnweave.operators.streams import number_rows

    names = read(spark, d, "dialogues").select("dialogue_id").distinct()
    return number_rows(names, [F.col("dialogue_id")], "k").where("k % 4 = 1").select("dialogue_id", "k")


def flt15_corpus_label(spark, d):
    label = F.when(F.col("source").contains("talk"), "talk").when(F.col("source").contains("desk"), "desk").otherwise("unknown")
    return read(spark, d, "documents").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def flt16_exclusions(spark, d):
    """Documents without the excluded ones; keys on the list that no document has are only counted."""
    excluded = spark.range(0, 500, 7).select(F.col("id").alias("doc_id"))
    rows = read(spark, d, "documents").select("doc_id")
    absent = excluded.join(rows, "doc_id", "left_anti").agg(F.count("*").alias("n_absent"))
    return rows.join(excluded, "doc_id", "left_anti").agg(F.count("*").alias("n_left"), F.sum("doc_id").alias("sum_left")).crossJoin(F.broadcast(absent))


def set01_key_sets(spark, d):
    words, toks = (read(spark, d, t).select("dialogue_id").distinct() for t in ("word_transcripts", "dialogue_tokens"))
    both = words.intersect(toks).agg(F.count("*").alias("both"))
    return both.crossJoin(F.broadcast(words.subtract(toks).agg(F.count("*").alias("only_words")))).crossJoin(F.broadcast(toks.subtract(words).agg(F.count("*").alias("only_tokens"))))


def set02_union(spark, d):
    a = read(spark, d, "documents").select("doc_id", "source", "form")
    b = read(spark, d, "dialogues").select("dialogue_id", "source", "topic")
    return a.unionByName(b, allowMissingColumns=True)


def set03_marker_vocabulary(spark, d):
    words = read(spark, d, "word_transcripts").select(F.explode(T.chars(F.col("word"))).alias("ch"))
    return words.select(F.lower("ch").alias("ch")).distinct().where("ch RLIKE '^[a-z]$'")


def set05_duplicate_ids(spark, d):
    return read(spark, d, "dialogues").groupBy("dialogue_id").agg(F.count("*").alias("n")).where("n > 1")


def _gram_sets(spark, d):
    return docs(spark, d).select("doc_id", F.coalesce("source", F.lit("none")).alias("topic"), T.gram_set(F.col("text")).alias("grams"))


def agg16_topic_sets(spark, d):
    return _gram_sets(spark, d).select("topic", F.explode("grams").alias("gram")).groupBy("topic").agg(F.countDistinct("gram").alias("n_grams"))


def set04_best_topic(spark, d):
    """Each text's best topic by Jaccard similarity of 2-gram sets; the first topic by name wins ties."""
    rows = docs(spark, d).select("doc_id", F.coalesce("source", F.lit("none")).alias("topic"), "text")
    best = C.best_by_jaccard(rows, "doc_id", "topic", "text", of=T.bigram_pairs)
    return best.select("doc_id", "topic", F.round("score", 6).alias("score"))


def agg09_repetition(spark, d):
    return docs(spark, d).select("doc_id", F.round(T.repetition_ratio(F.col("text")), 9).alias("ratio"))


def str01_fold_width(spark, d):
    from turnweave.functions.labels import fold_fullwidth

    return read(spark, d, "word_transcripts").where("word IS NOT NULL").select("row_id", F.md5(fold_fullwidth(F.col("word"))).alias("digest"))


def str03_chat_sentence(spark, d):
    return turns(spark, d).select("doc_id", "pos", F.md5(T.chat_sentence(F.col("text"))).alias("digest"))


def str04_foreign_ratio(spark, d):
    return docs(spark, d).select("doc_id", F.round(T.non_japanese_ratio(F.col("text")), 9).alias("ratio"))


def str05_hallucinated(spark, d):
    """Texts that count as hallucinated, by the kind of reason (the ratio itself is checked by agg09 and str04)."""
    reason = T.hallucination_reason(F.col("text"), 0.05, 0.3)
    return docs(spark, d).select("doc_id", F.substring_index(reason, "=", 1).alias("kind"))


def str06_formality(spark, d):
    return docs(spark, d).select("doc_id", T.formality(F.col("text")).alias("style"))


def agg03_style_confusion(spark, d):
    """Requested style (from the source) against the measured one, with the share that matches in percent."""
    requested = F.when(F.col("doc_id") % 2 == 0, "polite").otherwise("casual")
    rows = docs(spark, d).select(requested.alias("style"), T.formality(F.col("text")).alias("measured"))
    return rows.groupBy("style").agg(
        *[F.count_if(F.col("measured") == m).alias(m) for m in ("polite", "casual", "mixed")],
        F.round(100.0 * F.count_if(F.col("measured") == F.col("style")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("match_pct"),
    )


def str07_persona_prompt(spark, d):
    pick = lambda name, values, m: F.get(F.array(*[F.lit(v) for v in values]), ((F.col("doc_id") + m) % len(values)).cast("int")).alias(name)
    rows = read(spark, d, "documents").select(
        "doc_id", pick("role", ["友人", None, "受付", ""], 0), pick("relationship", [None, "旧友", "初対面"], 0), pick("formality", ["polite", None, "casual", "mixed", "rare"], 0),
        pick("pace", [None, "slow", "fast", "medium", None, None, None], 0), pick("warmth", [None, "high", None, "low", "medium"], 1), pick("backchannel", ["none", None, None, "frequent"], 1),
    )
    return rows.select("doc_id", T.persona_prompt({c: F.col(c) for c in rows.columns[1:]}).alias("prompt"))


def str09_first_score(spark, d):
    return docs(spark, d).select("doc_id", T.first_score(F.col("text"), 2.5).alias("score"))


def str11_foreign_tags(spark, d):
    words = read(spark, d, "word_transcripts").where("word IS NOT NULL")
    return words.select("row_id", F.size(T.foreign_tags(F.col("word"), ["(笑)", "(不明)"])).alias("n")).where("n > 0")


def str12_stems(spark, d):
    base = F.substring_index(F.replace("stem", F.lit("\\"), F.lit("/")), "/", -1)
    return read(spark, d, "cer_all").where("stem IS NOT NULL").select("rec_id", base.alias("base"), F.substring_index(base, "_", 1).alias("first"), F.lpad(F.col("shard").cast("string"), 3, "0").alias("shard"))


def str13_split_prompt(spark, d):
    prompt, body = T.split_prompt(F.col("text"))
    return docs(spark, d).where("form = 'prompt'").select("doc_id", F.md5(prompt).alias("prompt"), F.md5(body).alias("body"))


def str14_paraphrase(spark, d):
    return read(spark, d, "documents").select("doc_id", T.stable_choice(F.col("doc_id").cast("string"), 6, 2).alias("choice"))


def str15_topic_prompt(spark, d):
    return read(spark, d, "dialogues").where("topic IS NOT NULL").select("dialogue_id", F.concat("topic", F.lit("について話します。")).alias("prompt")).distinct()


def str17_content_ids(spark, d):
    from turnweave.plans.token_streams import sides

    keep = F.filter(F.get("A", F.lit(0)), lambda x: (x >= 4) & (x < 32_000))
    return sides(spark, d).select("row_id", F.md5(F.array_join(F.transform(keep, lambda x: x.cast("string")), ",")).alias("digest"))


def str18_bigram_set(spark, d):
    words = read(spark, d, "word_transcripts").where("word IS NOT NULL").select("row_id", T.bigram_set(F.col("word")).alias("s"))
    return words.select("row_id", F.array_join(F.array_sort("s"), "|").alias("grams"))


def str19_escape_html(spark, d):
    return read(spark, d, "word_transcripts").where("word IS NOT NULL").select("row_id", F.md5(T.escape_html(F.col("word"))).alias("digest"))


def str20_natural_key(spark, d):
    return read(spark, d, "cer_all").where("stem IS NOT NULL").select("rec_id", T.natural_key(F.col("stem")).alias("key"))


def src17_line_numbers(spark, d):
    """Lines 2 and 4 of every text, addressed by number."""
    wanted = spark.createDataFrame([(2,), (4,)], "pos int")
    return C.lines(docs(spark, d)).join(F.broadcast(wanted), "pos").select("doc_id", "pos", F.md5("line").alias("digest"))


def src09_projection(spark, d):
    return read(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'1996-01-01'").select("l_orderkey", "l_quantity").groupBy(F.col("l_orderkey") % 16).agg(F.count("*").alias("n")).select(F.col("(l_orderkey % 16)").alias("k"), "n")


def src14_script_map(spark, d):
    """Script rows as a keyed lookup, joined to their texts by stem."""
    maps = read(spark, d, "dialogues").groupBy("dialogue_id").agg(F.min("topic").alias("topic"))
    texts = read(spark, d, "word_transcripts").groupBy("dialogue_id").agg(F.count("*").alias("n"))
    return texts.join(maps, "dialogue_id").groupBy("topic").agg(F.sum("n").alias("n"), F.count("*").alias("n_dialogues"))


def src15_score_shapes(spark, d):
    """Scores given as a map or as a list of records, in one shape (from the events' JSON)."""
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('[{"path": "k", "naturalness": '), F.get_json_object("props", "$.k"), F.lit("}]"))).alias("j"))
    as_map = F.from_json("j", "map<string,double>")
    as_list = F.map_from_entries(F.transform(F.from_json("j", "array<struct<path:string,naturalness:double>>"), lambda x: F.struct(x.path, x.naturalness)))
    rows = e.select("event_id", F.explode(F.when(F.col("j").startswith("["), as_list).otherwise(as_map)).alias("path", "score"))
    return rows.select("event_id", "path", "score")


def jsn01_sparse_json(spark, d):
    """Dialogues as JSON without null fields and without empty maps and lists."""
    rows = read(spark, d, "dialogues").groupBy("dialogue_id").agg(F.min("topic").alias("topic"), F.min("lang").alias("lang"))
    extra = F.when(F.ascii(F.md5("dialogue_id")) % 2 == 0, F.create_map(F.lit("k"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>"))
    notes = F.when(F.ascii(F.md5("dialogue_id")) % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return rows.select("dialogue_id", T.sparse_json({"lang": F.col("lang"), "topic": F.col("topic"), "extra": extra, "notes": notes}).alias("json"))


def jsn02_tolerant_parse(spark, d):
    """A field that holds an object or the object's text, from whole documents: scripts with a persona given either way, with one broken or none."""
    k, obj = F.col("doc_id") % 5, F.concat(F.lit('{"role": "r'), F.col("doc_id"), F.lit('", "pace": null}'))
    given = F.when(k == 0, obj).when(k == 1, F.to_json(F.struct(obj.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(obj.alias("x")))) - 6)).when(k == 2, F.lit("{}")).when(k == 3, F.lit("null")).otherwise(F.lit('"{broken"'))
    script = F.concat(F.lit('{"text": '), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))) - 6), F.lit(', "persona_json": '), given, F.lit("}"))
    rows = read(spark, d, "documents").select("doc_id", script.alias("script"))
    persona = T.object_or_text("script", "persona_json")
    return rows.select("doc_id", F.get_json_object(persona, "$.role").alias("role"), persona.isNotNull().alias("found"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if re.match(r"(str|flt|win|snk|jn|set|agg|src|jsn)\d\d_", k)}


_TURNS = r"""lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
labelled AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_extract(line, '{turn}', 1) AS label, regexp_extract(line, '{turn}', 2) AS text FROM lines),
turns AS (SELECT doc_id, pos, CASE WHEN label IN ('A', 'Ａ', 'USER') THEN 'A' ELSE 'B' END AS speaker, text FROM labelled WHERE label <> '' AND text <> '')""".replace("{turn}", C.TURN.replace("\\t", "\t").replace("\\n", "\n"))
_MERGED = """runs AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS f FROM turns)),
merged AS (SELECT doc_id, min(pos) AS pos, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY pos) AS text FROM runs GROUP BY doc_id, run)"""
_SPACE = "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_CONTENT = f"regexp_replace(text, '[{_SPACE}\\x{{0}}-\\x{{40}}\\x{{5b}}-\\x{{60}}\\x{{7b}}-\\x{{7f}}]', '', 'g')"
_FOREIGN = f"CASE WHEN length({_CONTENT}) > 0 THEN length(regexp_replace({_CONTENT}, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}、。！？「」（）・…ー〜]', '', 'g')) / length({_CONTENT}) ELSE 0.0 END"
_REP = "CASE WHEN length(text) < 4 THEN 0.0 ELSE list_max(map_values(list_histogram(list_transform(range(length(text) - 3), lambda i: text[i + 1:i + 4])))) / length(text) END"
_POLITE = f"len(regexp_extract_all(text, '{T.POLITE}'))"
_CASUAL = f"len(regexp_extract_all(replace(text, 'してるます', '_'), '{T.CASUAL.replace('(?!ます)', '')}'))"
_STYLE = f"CASE WHEN {_POLITE} >= {_CASUAL} + 2 THEN 'polite' WHEN {_CASUAL} >= {_POLITE} + 2 THEN 'casual' ELSE 'mixed' END"
_GRAMS = lambda t: f"list_distinct(CASE WHEN length(regexp_replace({t}, '[{_SPACE}]+', '', 'g')) >= 2 THEN list_transform(range(length(regexp_replace({t}, '[{_SPACE}]+', '', 'g')) - 1), lambda i: (regexp_replace({t}, '[{_SPACE}]+', '', 'g'))[i + 1:i + 2]) ELSE list_filter([regexp_replace({t}, '[{_SPACE}]+', '', 'g')], lambda g: g <> '') END)"
_WIDE = lambda t: f"translate({t}, '{''.join(map(chr, range(0xFF01, 0xFF5F)))}', '{''.join(map(chr, range(0x21, 0x7F))).replace(chr(39), chr(39) * 2)}')"


def oracle_sql() -> dict[str, str]:
    trim = f"regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
    bigrams = f"WITH b AS (SELECT doc_id, coalesce(source, 'none') AS topic, unnest({_GRAMS('text')}) AS gram FROM documents WHERE text IS NOT NULL)"
    maps = "SELECT dialogue_id, min(topic) AS topic, min(lang) AS lang FROM dialogues GROUP BY 1"
    arr = lambda values, m: f"([{', '.join('NULL' if v is None else chr(39) + v + chr(39) for v in values)}])[(doc_id + {m}) % {len(values)} + 1]"
    return {
        "str08_parse_dialogue": f"""WITH bare AS (SELECT doc_id, regexp_replace(text, '^[{_SPACE}]*(analysis|final|assistant)([^\\p{{L}}\\p{{N}}_][{_SPACE}:：]*|$)', '') AS text FROM documents WHERE text IS NOT NULL),
            l AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM bare)),
            m AS (SELECT doc_id, pos, regexp_extract(line, '^[{_SPACE}]*([ABＡＢ])[{_SPACE}]*[:：]', 1) AS label, regexp_replace(regexp_replace(line, '^[{_SPACE}]*[ABＡＢ][{_SPACE}]*[:：][{_SPACE}]*', ''), '[{_SPACE}]+$', '') AS text FROM l),
            k AS (SELECT *, pos = max(pos) OVER (PARTITION BY doc_id) AS last FROM m WHERE label <> '' AND text <> '')
            SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN label IN ('A', 'Ａ') THEN 'S1' ELSE 'S2' END AS speaker, md5(text) AS digest FROM k WHERE NOT last OR contains('{T.SENTENCE_END}', right(text, 1))""",
        "flt04_drop_unusable": f"WITH {_TURNS} SELECT count(*) AS n_lines, count(*) FILTER (label = '') AS n_unknown, count(*) FILTER (label <> '' AND text = '') AS n_empty FROM labelled",
        "win01_merge_turns": f"WITH {_TURNS}, {_MERGED} SELECT doc_id, pos, speaker, md5(text) AS digest FROM merged",
        "win01_event_runs": "WITH r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS f FROM events)) SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM r GROUP BY user_id, run",
        "win02_chunks": f"""WITH RECURSIVE {_TURNS}, {_MERGED}, k AS MATERIALIZED (SELECT doc_id, pos, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM merged),
            r AS (SELECT doc_id, i, pos, n AS used, 0 AS chunk FROM k WHERE i = 1 UNION ALL
              SELECT k.doc_id, k.i, k.pos, CASE WHEN r.used > 0 AND r.used + k.n > {BUDGET} THEN k.n ELSE r.used + k.n END, r.chunk + CASE WHEN r.used > 0 AND r.used + k.n > {BUDGET} THEN 1 ELSE 0 END FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1)
            SELECT doc_id, pos, CAST(chunk AS INTEGER) AS chunk, format('{{}}_part{{:02d}}', doc_id, chunk) AS name FROM r""",
        "snk01_shards": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS shard, format('docs-{:03d}-of-{:03d}', (row_number() OVER (ORDER BY doc_id) - 1) // 300, (count(*) OVER () + 299) // 300) AS file FROM documents",
        "snk05_key_lists": "SELECT DISTINCT dialogue_id, 'tokens' AS lacks FROM word_transcripts WHERE dialogue_id NOT IN (SELECT dialogue_id FROM dialogue_tokens) UNION ALL SELECT DISTINCT dialogue_id, 'words' FROM dialogue_tokens WHERE dialogue_id NOT IN (SELECT dialogue_id FROM word_transcripts)",
        "jn01_text_audio": "SELECT * FROM (SELECT dialogue_id, count(*) AS n_words FROM word_transcripts GROUP BY 1) JOIN (SELECT dialogue_id, count(*) AS n_exports FROM dialogue_tokens GROUP BY 1) USING (dialogue_id)",
        "jn03_resume": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0",
        "jn04_lookup": f"SELECT row_id, topic, lang FROM dialogue_tokens JOIN ({maps}) USING (dialogue_id) WHERE topic IS NOT NULL",
        "jn05_unmatched": f"SELECT lang, count(*) AS n, count(topic) AS matched, count(*) FILTER (topic IS NULL) AS unmatched FROM ({maps}) GROUP BY 1",
        "jn11_manifest": "WITH b AS (SELECT coalesce(source, 'none') AS source, form, count(*) AS n, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2) SELECT source, form, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars FROM (SELECT DISTINCT source, unnest(['turns', 'prose', 'json', 'prompt', 'roles']) AS form FROM b) LEFT JOIN b USING (source, form)",
        "flt05_split_membership": "SELECT dialogue_id FROM (SELECT dialogue_id, min(source) AS source FROM dialogues GROUP BY 1) WHERE source IN ('desk_calls', 'open_line', 'panel_talk')",
        "flt06_duration": 'SELECT row_id FROM word_transcripts WHERE "end" - start >= 0 AND round(("end" - start) * 1000) BETWEEN 2000 AND 30000',
        "flt07_quality_gate": "SELECT event_id FROM events WHERE NOT (value / 100 > 0.6 OR -value / 50 < -1.0 OR event_id % 40 / 10.0 > 2.4)",
        "flt08_drop_reasons": f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) NOT BETWEEN 20 AND 3000 THEN 'len' WHEN trim(text) = '' THEN 'empty' WHEN abs(length(text) - n_chars) > 5 THEN 'quality'
            WHEN ({_REP}) > 0.05 OR ({_FOREIGN}) > 0.3 THEN 'hallucination' WHEN len(list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) = 0 THEN 'no words' WHEN regexp_replace(text, '[{_SPACE}]+', '', 'g') = '' THEN 'no tokens' WHEN lang IS NULL THEN 'error' ELSE 'kept' END AS reason FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
        "flt09_turn_gate": f"WITH {_TURNS} SELECT doc_id, pos, CAST(k AS INTEGER) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM turns) WHERE n >= 4 AND k <= 10",
        "flt10_threshold_sweep": "SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS n FROM cer_all JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 1.0]::DOUBLE[]) AS t) ON cer <= t AND NOT isnan(cer) GROUP BY 1",
        "flt12_modulo_shards": "SELECT * FROM (SELECT dialogue_id, row_number() OVER (ORDER BY dialogue_id) - 1 AS k FROM (SELECT DISTINCT dialogue_id FROM dialogues)) WHERE k % 4 = 1",
        "flt15_corpus_label": "SELECT CASE WHEN contains(source, 'talk') THEN 'talk' WHEN contains(source, 'desk') THEN 'desk' ELSE 'unknown' END AS label, count(*) AS n FROM documents GROUP BY 1",
        "flt16_exclusions": "SELECT (SELECT count(*) FROM documents WHERE doc_id >= 500 OR doc_id % 7 <> 0) AS n_left, (SELECT CAST(sum(doc_id) AS BIGINT) FROM documents WHERE doc_id >= 500 OR doc_id % 7 <> 0) AS sum_left, (SELECT count(*) FROM range(0, 500, 7) t(i) WHERE i NOT IN (SELECT doc_id FROM documents)) AS n_absent",
        "set01_key_sets": "WITH w AS (SELECT DISTINCT dialogue_id FROM word_transcripts), t AS (SELECT DISTINCT dialogue_id FROM dialogue_tokens) SELECT (SELECT count(*) FROM w WHERE dialogue_id IN (SELECT * FROM t)) AS both, (SELECT count(*) FROM w WHERE dialogue_id NOT IN (SELECT * FROM t)) AS only_words, (SELECT count(*) FROM t WHERE dialogue_id NOT IN (SELECT * FROM w)) AS only_tokens",
        "set02_union": "SELECT doc_id, source, form, NULL::VARCHAR AS dialogue_id, NULL::VARCHAR AS topic FROM documents UNION ALL SELECT NULL, source, NULL, dialogue_id, topic FROM dialogues",
        "set03_marker_vocabulary": "SELECT DISTINCT lower(ch) AS ch FROM (SELECT unnest(string_split(word, '')) AS ch FROM word_transcripts) WHERE regexp_matches(lower(ch), '^[a-z]$')",
        "set05_duplicate_ids": "SELECT dialogue_id, count(*) AS n FROM dialogues GROUP BY 1 HAVING count(*) > 1",
        "agg16_topic_sets": f"{bigrams} SELECT topic, count(DISTINCT gram) AS n_grams FROM b GROUP BY 1",
        "set04_best_topic": f"""{bigrams}, t AS (SELECT DISTINCT topic, gram FROM b), ts AS (SELECT topic, count(*) AS nt FROM t GROUP BY 1), ds AS (SELECT doc_id, count(*) AS nd FROM b GROUP BY 1),
            s AS (SELECT b.doc_id, t.topic, count(*) AS n FROM b JOIN t USING (gram) GROUP BY 1, 2), x AS (SELECT doc_id, topic, n / (nd + nt - n + 1e-9) AS score FROM s JOIN ts USING (topic) JOIN ds USING (doc_id))
            SELECT doc_id, topic, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) = 1""",
        "agg09_repetition": f"SELECT doc_id, round({_REP}, 9) AS ratio FROM documents WHERE text IS NOT NULL",
        "str01_fold_width": f"SELECT row_id, md5({_WIDE('word')}) AS digest FROM word_transcripts WHERE word IS NOT NULL",
        "str03_chat_sentence": f"WITH {_TURNS}, x AS (SELECT doc_id, pos, {_WIDE(f'lower({trim})')} AS s FROM turns) SELECT doc_id, pos, md5(CASE WHEN regexp_matches(s, '[。、!?]$') THEN s ELSE s || '。' END) AS digest FROM x",
        "str04_foreign_ratio": f"SELECT doc_id, round({_FOREIGN}, 9) AS ratio FROM documents WHERE text IS NOT NULL",
        "str05_hallucinated": f"SELECT doc_id, CASE WHEN ({_REP}) > 0.05 THEN '4gram_rep_ratio' WHEN ({_FOREIGN}) > 0.3 THEN 'non_ja_ratio' ELSE '' END AS kind FROM documents WHERE text IS NOT NULL",
        "str06_formality": f"SELECT doc_id, {_STYLE} AS style FROM documents WHERE text IS NOT NULL",
        "agg03_style_confusion": f"WITH x AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'polite' ELSE 'casual' END AS style, {_STYLE} AS m FROM documents WHERE text IS NOT NULL) SELECT style, count(*) FILTER (m = 'polite') AS polite, count(*) FILTER (m = 'casual') AS casual, count(*) FILTER (m = 'mixed') AS mixed, round(100.0 * count(*) FILTER (m = style) / greatest(count(*), 1), 6) AS match_pct FROM x GROUP BY 1",
        "str07_persona_prompt": f"""WITH p AS (SELECT doc_id, {arr(['友人', None, '受付', ''], 0)} AS role, {arr([None, '旧友', '初対面'], 0)} AS rel, {arr(['polite', None, 'casual', 'mixed', 'rare'], 0)} AS f,
            {arr([None, 'slow', 'fast', 'medium', None, None, None], 0)} AS pace, {arr([None, 'high', None, 'low', 'medium'], 1)} AS warm, {arr(['none', None, None, 'frequent'], 1)} AS bc FROM documents),
            q AS (SELECT doc_id, CASE WHEN role <> '' THEN 'あなたは' || CASE WHEN rel <> '' THEN rel || 'の' ELSE '' END || role || 'です。' ELSE '' END
              || CASE WHEN f <> '' THEN CASE f WHEN 'polite' THEN '丁寧な' WHEN 'casual' THEN 'くだけた' WHEN 'mixed' THEN '自然な' ELSE f END || '話し方で話します。' ELSE '' END
              || CASE WHEN pace <> '' OR warm <> '' THEN concat_ws('、', CASE pace WHEN 'slow' THEN 'ゆっくりしたテンポ' WHEN 'medium' THEN 'ふつうのテンポ' WHEN 'fast' THEN 'テンポの速いテンポ' END, CASE warm WHEN 'low' THEN 'あっさり接し方' WHEN 'medium' THEN 'ほどよく接し方' WHEN 'high' THEN 'とても親しみのある接し方' END) || '。' ELSE '' END
              || CASE WHEN bc <> '' THEN 'あいづちは' || CASE bc WHEN 'none' THEN 'ほとんど打たない' WHEN 'sparse' THEN '控えめに打つ' ELSE 'よく打つ' END || '。' ELSE '' END AS s FROM p)
            SELECT doc_id, CASE WHEN s = '' THEN '自然な話し方で話します。' ELSE s END AS prompt FROM q""",
        "str09_first_score": "SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '[1-5]'), '') AS DOUBLE), 2.5) AS score FROM documents WHERE text IS NOT NULL",
        "str11_foreign_tags": f"SELECT * FROM (SELECT row_id, CAST(len(list_filter(regexp_extract_all(word, '[（(][^（）()]*[）)]'), lambda t: regexp_replace({_WIDE('t')}, '[{_SPACE}]+', '', 'g') NOT IN ('(笑)', '(不明)'))) AS INTEGER) AS n FROM word_transcripts WHERE word IS NOT NULL) WHERE n > 0",
        "str12_stems": "SELECT rec_id, list_last(string_split(replace(stem, chr(92), '/'), '/')) AS base, string_split(list_last(string_split(replace(stem, chr(92), '/'), '/')), '_')[1] AS first, lpad(CAST(shard AS VARCHAR), 3, '0') AS shard FROM cer_all WHERE stem IS NOT NULL",
        "str13_split_prompt": "WITH x AS (SELECT doc_id, text, strpos(text, chr(10) || '---' || chr(10)) AS p FROM documents WHERE text IS NOT NULL AND form = 'prompt') SELECT doc_id, md5(lower(CASE WHEN p > 0 THEN text[1:p - 1] ELSE '' END)) AS prompt, md5(lower(CASE WHEN p > 0 THEN text[p + 5:] ELSE text END)) AS body FROM x",
        "str14_paraphrase": "SELECT doc_id, CAST(CASE WHEN m >= 2 THEN m + 1 ELSE m END AS INTEGER) AS choice FROM (SELECT doc_id, list_sum(list_transform(string_split(md5(CAST(doc_id AS VARCHAR)), ''), lambda h: strpos('0123456789abcdef', h) - 1)) % 5 AS m FROM documents)",
        "str15_topic_prompt": "SELECT DISTINCT dialogue_id, topic || 'について話します。' AS prompt FROM dialogues WHERE topic IS NOT NULL",
        "str17_content_ids": "WITH v AS (SELECT row_id, list_resize(\"A\"[1], least(len(\"A\"[2]), len(\"B\"[2])), 3) AS x FROM dialogue_tokens WHERE len(\"A\") = 9 AND len(\"B\") = 9 AND least(len(\"A\"[2]), len(\"B\"[2])) > 0) SELECT row_id, md5(array_to_string(list_transform(list_filter(x, lambda i: i >= 4 AND i < 32000), lambda i: CAST(i AS VARCHAR)), ',')) AS digest FROM v",
        "str18_bigram_set": f"SELECT row_id, array_to_string(list_sort({_GRAMS('word')}), '|') AS grams FROM word_transcripts WHERE word IS NOT NULL",
        "str19_escape_html": "SELECT row_id, md5(replace(replace(replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM word_transcripts WHERE word IS NOT NULL",
        "str20_natural_key": "SELECT rec_id, array_to_string(list_transform(regexp_extract_all(stem, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS key FROM cer_all WHERE stem IS NOT NULL",
        "src17_line_numbers": "WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)) SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(line) AS digest FROM l WHERE pos IN (2, 4)",
        "src09_projection": "SELECT l_orderkey % 16 AS k, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1",
        "src14_script_map": f"SELECT topic, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_dialogues FROM (SELECT dialogue_id, count(*) AS n FROM word_transcripts GROUP BY 1) JOIN ({maps}) USING (dialogue_id) GROUP BY topic",
        "src15_score_shapes": "SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS DOUBLE) AS score FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
        "jsn01_sparse_json": f"""SELECT dialogue_id, '{{' || concat_ws(',', '"lang":"' || lang || '"', '"topic":"' || topic || '"', CASE WHEN ascii(md5(dialogue_id)) % 2 = 0 THEN '"extra":{{"k":1}}' END, CASE WHEN ascii(md5(dialogue_id)) % 3 = 0 THEN '"notes":["a","b"]' END) || '}}' AS json FROM ({maps})""",
        "jsn02_tolerant_parse": "SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'r' || doc_id END AS role, doc_id % 5 < 2 AS found FROM documents",
    }
