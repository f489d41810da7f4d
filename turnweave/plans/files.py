"""Queries of the file sources and sinks: files are made from whole test tables in the shared folder, then read the way they would come in."""

from __future__ import annotations

import gzip
import io
import os
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import arrays as X
from turnweave.functions.tokenizer import SentencePiece
from turnweave.plans.corpus import docs, read, turns
from turnweave.plans.token_streams import sides
from turnweave.session import map_groups, shared_folder
from turnweave.sources import files, sinks

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TURNWEAVE_TOKENIZERS", "/opt/tokenizers")


def _made(rows: DataFrame) -> str:
    """A folder with the files (name, content)."""
    folder = shared_folder(rows.sparkSession)
    sinks.write_files(rows.select("name", F.col("content").cast("binary").alias("content")), folder)
    return folder


def wav_bytes(channels: int, samples: list[int], rate: int = 24_000) -> bytes:
    """A 16-bit WAV whose first channel holds ``samples``; the others are silent."""
    data = np.zeros((len(samples), channels), dtype="<i2")
    data[:, 0] = np.array(samples, dtype=np.int64).astype("<i2")
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    body = form + struct.pack("<4sI", b"data", data.nbytes) + data.tobytes()
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def _wav(channels: Column, samples: Column) -> Column:
    @F.arrow_udf("binary")
    def made(c: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array([wav_bytes(int(k), x) for k, x in zip(c.to_pylist(), s.to_pylist())], type=pa.binary())

    return made(channels, samples)


def _grouped(members: DataFrame, pack: Callable[[list[tuple[str, bytes]]], bytes]) -> DataFrame:
    """Archives (name, content) of members (archive, member, content)."""

    def kernel(table: pa.Table) -> Iterator[tuple]:
        yield table.column(0)[0].as_py(), pack(list(zip(table.column(1).to_pylist(), table.column(2).to_pylist())))

    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])
    rows = members.select("archive", "member", F.col("content").cast("binary").alias("content"))
    return map_groups(rows, ["archive"], ["member"], kernel, "name string, content binary", schema, flush=20)


def _tar(members: list[tuple[str, bytes]]) -> bytes:
    file = io.BytesIO()
    with tarfile.open(fileobj=file, mode="w") as archive:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    return file.getvalue()


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as archive:
        for name, content in members:
            archive.writestr(name, content)
    return file.getvalue()


def _stem(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[a-z]+$", 1)


def _text_ids(spark: SparkSession, d: str) -> DataFrame:
    return sides(spark, d).select("row_id", F.get("A", F.lit(0)).alias("ids"), (F.col("row_id") % 2 + 1).cast("int").alias("channels"))


def src01_word_files(spark, d):
    """One JSON array of words per dialogue."""
    words = read(spark, d, "word_transcripts").groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "speaker", "word", "start", "end"))).alias("x"))
    content = F.to_json(F.transform("x", lambda w: F.struct(w["speaker"].alias("speaker"), w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"))))
    folder = _made(words.select(F.concat(F.lit("part/"), "dialogue_id", F.lit(".json")).alias("name"), content.alias("content")))
    rows = files.word_transcripts(spark, folder).select(F.substring_index("dialogue_id", "/", -1).alias("dialogue_id"), "word", "start")
    return rows.groupBy("dialogue_id").agg(F.count("*").alias("n"), F.count("word").alias("n_words"), F.coalesce(F.sum(F.round(F.col("start") * 1000).cast("bigint")), F.lit(0)).alias("total_ms"))


def src02_npz(spark, d):
    """One archive of two matrices per export."""

    @F.arrow_udf("binary")
    def packed(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            file = io.BytesIO()
            np.savez(file, A=np.array(x, dtype=np.int32), B=np.array(y, dtype=np.int32))
            out.append(file.getvalue())
        return pa.array(out, type=pa.binary())

    folder = _made(sides(spark, d).select(F.concat(F.lit("x/"), "row_id", F.lit(".npz")).alias("name"), packed("A", "B").alias("content")))
    return _matrix_totals(files.npz_matrices(spark, folder)).select(_stem().cast("bigint").alias("row_id"), "name", "n_rows", "n_cols", "total")


def _matrix_totals(rows: DataFrame) -> DataFrame:
    total = F.aggregate(F.flatten("codes"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.where("error IS NULL").select("path", "name", F.size("codes").alias("n_rows"), F.size(F.get("codes", F.lit(0))).alias("n_cols"), total.alias("total"))


def src03_stereo(spark, d):
    """Stereo recordings by their headers."""
    folder = _made(_text_ids(spark, d).select(F.concat("row_id", F.lit(".wav")).alias("name"), _wav(F.col("channels"), F.col("ids")).alias("content")))
    return files.wav_headers(spark, folder).where("channels = 2").select(_stem().cast("bigint").alias("row_id"), "rate", "frames")


def src04_tar_members(spark, d):
    """Recordings in tars; loose ones beside them are ignored."""
    ids = _text_ids(spark, d)
    members = ids.select(F.format_string("k%02d.tar", F.col("row_id") % 20).alias("archive"), F.concat("row_id", F.lit(".wav")).alias("member"), _wav(F.col("channels"), F.col("ids")).alias("content"))
    loose = ids.where("row_id % 3 = 0").select(F.concat(F.lit("loose_"), "row_id", F.lit(".wav")).alias("name"), _wav(F.col("channels"), F.col("ids")).alias("content"))
    folder = _made(_grouped(members, _tar).unionByName(loose))
    return files.tar_members(spark, folder, loose=True).where("error IS NULL").select("name", F.length("content").alias("n_bytes"))


def src05_cuts(spark, d):
    """Cuts of gzipped lines with the members of the archive of the same index; indices without an archive are left out."""

    @F.arrow_udf("binary")
    def zipped(x: pa.Array) -> pa.Array:
        return pa.array([gzip.compress(t.encode(), mtime=0) for t in x.to_pylist()], type=pa.binary())

    named = read(spark, d, "dialogues").select("dialogue_id").distinct().select("dialogue_id", F.ascii(F.md5("dialogue_id")).alias("k"))
    line = F.to_json(F.struct(F.col("dialogue_id").alias("id"), F.lit(2.5).alias("duration")))
    cuts = named.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines")).select(F.format_string("cuts.%d.jsonl.gz", "k").alias("name"), zipped("lines").alias("content"))
    tars = _grouped(named.where("k % 2 = 0").select(F.format_string("recording.%d.tar", "k").alias("archive"), F.concat("dialogue_id", F.lit(".flac")).alias("member"), F.lit("x").alias("content")), _tar)
    out = files.cuts_with_archives(spark, _made(cuts.unionByName(tars)))
    return out.select("id", F.col("index").cast("int").alias("k"), F.size("members").alias("n_members"), F.get("members", F.lit(0)).alias("first"))


def src06_episodes(spark, d):
    """The first channel of the episodes in tars."""
    members = _text_ids(spark, d).select(F.format_string("e%02d.tar", F.col("row_id") % 9).alias("archive"), F.concat("row_id", F.lit(".wav")).alias("member"), _wav(F.col("channels"), F.col("ids")).alias("content"))
    rows = files.episodes(spark, _made(_grouped(members, _tar)))
    return rows.where("error IS NULL").select(_stem("name").cast("bigint").alias("row_id"), F.size("samples").alias("n"), X.digest(F.col("samples")).alias("digest"))


def src07_npy(spark, d):
    """Token matrices in a folder per seed."""
    folder = shared_folder(spark)
    sinks.write_arrays(sides(spark, d).select(F.concat(F.lit("seed"), F.col("row_id") % 4, F.lit("/"), "row_id").alias("name"), "A"), folder, "name", "A")
    rows = _matrix_totals(files.npy_matrices(spark, folder))
    return rows.select(F.regexp_extract("path", r"/seed(\d)/", 1).cast("int").alias("seed"), _stem().cast("bigint").alias("row_id"), "n_rows", "n_cols", "total")


def src10_text_field(spark, d):
    """A corpus of JSON lines with a text field."""
    folder = shared_folder(spark)
    sinks.write_json_lines(docs(spark, d).select("doc_id", "text", "lang"), folder)
    return spark.read.schema("doc_id bigint, text string").json(folder).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def src11_text_chats(spark, d):
    """Chats as arrays of speaker and text; the text is kept in order."""
    t = turns(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "speaker", "text"))).alias("x"))
    content = F.to_json(F.transform("x", lambda q: F.array(q["speaker"], q["text"])))
    folder = _made(t.select(F.concat("doc_id", F.lit(".json")).alias("name"), content.alias("content")))
    rows = files.text_chats(spark, folder)
    return rows.select(F.col("dialogue_id").cast("bigint").alias("doc_id"), F.size("texts").alias("n"), F.md5(F.array_join("texts", "|")).alias("digest"))


def src12_zip_members(spark, d):
    """Members of zip files by their suffix."""
    rows = read(spark, d, "documents").select(F.format_string("z%02d.zip", F.col("doc_id") % 10).alias("archive"), "doc_id", "form")
    data = rows.groupBy("archive").agg(F.to_json(F.array_sort(F.collect_list(F.struct("doc_id", "form")))).alias("content"))
    members = data.select("archive", F.lit("a/dialogues.json").alias("member"), "content").unionByName(data.select("archive", F.lit("a/readme.txt").alias("member"), F.lit("x").alias("content")))
    found = files.zip_members(spark, _made(_grouped(members, _zip)), "/dialogues.json").where("error IS NULL")
    return found.select(F.inline(F.from_json(F.col("content").cast("string"), "array<struct<doc_id:bigint,form:string>>")))


def src13_dialogue_files(spark, d):
    """Dialogues in files of their own: how many there are, cannot be read, or have no utterance."""
    t = turns(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("utterances"))
    body = read(spark, d, "documents").select("doc_id").join(t, "doc_id", "left")
    text = F.to_json(F.struct(F.col("doc_id").alias("dialogue_id"), F.coalesce("utterances", F.array().cast("array<struct<pos:int,text:string>>")).alias("utterances")))
    broken = F.when(F.col("doc_id") % 13 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    folder = _made(body.select(F.concat("doc_id", F.lit(".json")).alias("name"), broken.alias("content")))
    rows = files.dialogue_files(spark, folder, "dialogue_id long, utterances array<struct<text:string>>")
    n = F.coalesce(F.size("dialogue.utterances"), F.lit(0))
    return rows.agg(F.count("*").alias("n_files"), F.count_if("unreadable").alias("n_unreadable"), F.count_if(~F.col("unreadable") & (n == 0)).alias("n_empty"), F.sum(F.when(~F.col("unreadable"), n).otherwise(0)).alias("n_utterances"))


def _timed_words(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "word_transcripts").where("start IS NOT NULL AND `end` IS NOT NULL")


def src16_annotations(spark, d):
    """Annotation exports by the ending of their file's name."""
    seg = F.struct(F.col("row_id").cast("string").alias("id"), F.lit("ch_1").alias("channelId"), F.round(F.col("start") * 1000).alias("startMs"), F.round(F.col("end") * 1000).alias("endMs"), F.col("word").alias("transcript"))
    one = _timed_words(spark, d).groupBy("dialogue_id").agg(F.collect_list(seg).alias("segments"))
    text = F.to_json(F.struct(F.create_map().cast("map<string,string>").alias("audio"), "segments"))
    gold = one.select(F.concat("dialogue_id", F.lit("_gold.json")).alias("name"), text.alias("content"))
    pre = one.select(F.concat("dialogue_id", F.lit("_pre.json")).alias("name"), F.lit("{}").alias("content"))
    rows = files.annotation_exports(spark, _made(gold.unionByName(pre)), "_gold.json")
    total = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["endMs"]).cast("bigint")
    return rows.select(F.col("name").alias("dialogue_id"), F.size("segments").alias("n"), total.alias("total_ms"))


def src18_cascade(spark, d):
    """Folders that hold audio and turns; those that lack one of them are left out."""
    t = turns(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "speaker", "text"))).alias("x"))
    said = F.to_json(F.transform("x", lambda q: F.struct(q["speaker"].alias("speaker"), q["text"].alias("text"), q["pos"].cast("double").alias("t_start"), (q["pos"] + 1).cast("double").alias("t_end"))))
    texts = t.where("doc_id % 5 <> 0").select(F.concat("doc_id", F.lit("/turns.json")).alias("name"), said.cast("binary").alias("content"))
    sound = t.where("doc_id % 7 <> 0").select(F.concat("doc_id", F.lit("/audio.wav")).alias("name"), _wav(F.lit(2), F.transform("x", lambda q: q["pos"])).alias("content"))
    rows = files.cascade_folders(spark, _made(texts.unionByName(sound)))
    return rows.select(F.col("dialogue_id").cast("bigint").alias("doc_id"), "channels", "frames", F.size("turns").alias("n_turns"))


def src19_wav_pairs(spark, d):
    """Stereo recordings with the segments of both speakers' files."""
    w = read(spark, d, "word_transcripts").where("speaker IN ('A', 'B')")
    seg = F.struct(F.col("word").alias("text"), F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))
    one = w.groupBy("dialogue_id", "speaker").agg(F.to_json(F.collect_list(seg)).cast("binary").alias("content"))
    sound = w.select("dialogue_id").distinct().select("dialogue_id", (F.ascii(F.md5("dialogue_id")) % 2 + 1).alias("channels"))
    sound = sound.select(F.concat(F.lit("s/"), "dialogue_id", F.lit(".wav")).alias("name"), _wav(F.col("channels"), F.array(F.lit(1), F.lit(2))).alias("content"))
    rows = files.wav_pairs(spark, _made(one.select(F.concat(F.lit("s/"), "dialogue_id", F.lit("_"), "speaker", F.lit(".json")).alias("name"), "content").unionByName(sound)))
    return rows.select(F.substring_index("base", "/", -1).alias("dialogue_id"), F.size("a").alias("n_a"), F.size("b").alias("n_b"), "frames")


def src20_diagram(spark, d):
    """Cells of diagrams: nations below their region, suppliers as edges."""
    cell = lambda *parts: F.concat(F.lit("<mxCell "), *parts, F.lit("/>"))
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    n = read(spark, d, "nation").select(cell(attr("id", F.concat(F.lit("n"), "n_nationkey")), attr("parent", F.concat(F.lit("r"), "n_regionkey")), attr("vertex", F.lit(1))).alias("line"), F.col("n_regionkey").alias("g"))
    s = read(spark, d, "supplier").select(cell(attr("id", F.concat(F.lit("s"), "s_suppkey")), attr("source", F.concat(F.lit("n"), "s_nationkey")), attr("target", F.concat(F.lit("n"), (F.col("s_nationkey") + F.col("s_suppkey")) % 25)), attr("edge", F.lit(1))).alias("line"), (F.col("s_suppkey") % 50).alias("g"))
    whole = n.unionByName(s).groupBy("g").agg(F.concat(F.lit("<g>"), F.array_join(F.array_sort(F.collect_list("line")), ""), F.lit("</g>")).alias("content"))
    return files.xml_cells(spark, _made(whole.select(F.concat("g", F.lit(".xml")).alias("name"), "content")))


def src21_live_messages(spark, d):
    """Messages taken off a stream: audio payloads, in the order of their session."""
    from turnweave.streaming import live

    kind = (F.col("event_id") % 9).cast("int")
    message = F.unhex(F.concat(F.lpad(F.hex(kind), 2, "0"), F.hex(F.encode("event_type", "UTF-8"))))
    folder = shared_folder(spark)
    rows = read(spark, d, "events").select("user_id", "event_id", message.alias("message"))
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    query = live.accepted(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema("user_id bigint, event_id bigint, payload binary").parquet(f"{folder}/out").select("user_id", "event_id", F.decode("payload", "UTF-8").alias("payload"))


def snk02_written_once(spark, d):
    """A shard that stands is not written again, and an empty one not at all."""
    folder = shared_folder(spark)
    rows = read(spark, d, "documents").select("doc_id", "form")
    sinks.write_missing(rows.limit(0), f"{folder}/shard")
    sinks.write_missing(rows, f"{folder}/shard")
    sinks.write_missing(rows.withColumn("form", F.lit("again")), f"{folder}/shard")
    return spark.read.parquet(f"{folder}/shard").groupBy("form").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def snk03_arrays(spark, d):
    """Matrices written as array files and read again."""
    folder = shared_folder(spark)
    sinks.write_arrays(sides(spark, d).select(F.col("row_id").cast("string").alias("name"), "B"), folder, "name", "B")
    rows = files.npy_matrices(spark, folder).where("error IS NULL")
    return rows.select(_stem().cast("bigint").alias("row_id"), F.posexplode("codes").alias("r", "s")).select("row_id", "r", F.size("s").alias("n"), X.digest(F.col("s")).alias("digest"))


def str16_pieces(spark, d):
    """Sub-word pieces of every text by a public model, byte pieces joined to whole characters: how many, and that they spell the text the model saw."""
    model = SentencePiece(f"{TOKENIZERS}/piece_bpe_32k.model")

    @F.arrow_udf("struct<n:int,digest:string,spells:boolean>")
    def pieces(texts: pa.Array) -> pa.Array:
        import hashlib

        rows = []
        for text in texts.to_pylist():
            found = model.encode_pieces(text)
            spelled = "".join(found).replace("▁", " ").strip(" ")
            rows.append({"n": len(found), "digest": hashlib.md5("\x1f".join(found).encode()).hexdigest(), "spells": spelled == model.decode(model.model.encode(text)).strip(" ")})
        return pa.array(rows, type=pa.struct([("n", pa.int32()), ("digest", pa.string()), ("spells", pa.bool_())]))

    return docs(spark, d).select("doc_id", pieces("text").alias("p")).select("doc_id", "p.n", "p.digest", "p.spells")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if re.match(r"[a-z]{3}\d\d_", k)}


def oracle_sql() -> dict[str, str]:
    from turnweave.plans import corpus as P
    from turnweave.plans import sql as Q

    digest = lambda a: f"md5(array_to_string(list_transform({a}, lambda q: CAST(q AS VARCHAR)), ','))"
    timed = """SELECT * FROM word_transcripts WHERE start IS NOT NULL AND "end" IS NOT NULL"""
    k = "ascii(md5(dialogue_id))"
    return {
        "src01_word_files": "SELECT dialogue_id, count(*) AS n, count(word) AS n_words, CAST(coalesce(sum(CAST(round(start * 1000) AS BIGINT)), 0) AS BIGINT) AS total_ms FROM word_transcripts GROUP BY 1",
        "src02_npz": f"WITH {Q.V1} SELECT row_id, 'A' AS name, 9 AS n_rows, CAST(t AS INTEGER) AS n_cols, CAST(list_sum(flatten(a)) AS BIGINT) AS total FROM v1 UNION ALL SELECT row_id, 'B', 9, CAST(t AS INTEGER), CAST(list_sum(flatten(b)) AS BIGINT) FROM v1",
        "src03_stereo": f"WITH {Q.V1} SELECT row_id, 24000 AS rate, t AS frames FROM v1 WHERE row_id % 2 = 1",
        "src04_tar_members": f"WITH {Q.V1} SELECT row_id || '.wav' AS name, CAST(44 + 2 * t * (row_id % 2 + 1) AS INTEGER) AS n_bytes FROM v1",
        "src05_cuts": f"WITH n AS (SELECT DISTINCT dialogue_id AS id, {k} AS k FROM dialogues), g AS (SELECT k, count(*) AS n, min(id || '.flac') AS first FROM n WHERE k % 2 = 0 GROUP BY 1) SELECT id, k, CAST(n AS INTEGER) AS n_members, first FROM n JOIN g USING (k)",
        "src06_episodes": f"WITH {Q.V1} SELECT row_id, CAST(t AS INTEGER) AS n, {digest('a[1]')} AS digest FROM v1",
        "src07_npy": f"WITH {Q.V1} SELECT CAST(row_id % 4 AS INTEGER) AS seed, row_id, 9 AS n_rows, CAST(t AS INTEGER) AS n_cols, CAST(list_sum(flatten(a)) AS BIGINT) AS total FROM v1",
        "src10_text_field": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
        "src11_text_chats": f"WITH {P._TURNS} SELECT doc_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(text, '|' ORDER BY pos)) AS digest FROM turns GROUP BY 1",
        "src12_zip_members": "SELECT doc_id, form FROM documents",
        "src13_dialogue_files": f"WITH {P._TURNS}, u AS (SELECT doc_id, count(*) AS n FROM turns GROUP BY 1), a AS (SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN u USING (doc_id)) SELECT count(*) AS n_files, count(*) FILTER (doc_id % 13 = 0) AS n_unreadable, count(*) FILTER (doc_id % 13 <> 0 AND n = 0) AS n_empty, CAST(coalesce(sum(n) FILTER (doc_id % 13 <> 0), 0) AS BIGINT) AS n_utterances FROM a",
        "src16_annotations": f"""SELECT dialogue_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(round("end" * 1000)) AS BIGINT) AS total_ms FROM ({timed}) GROUP BY 1""",
        "src18_cascade": f"WITH {P._TURNS} SELECT doc_id, 2 AS channels, count(*) AS frames, CAST(count(*) AS INTEGER) AS n_turns FROM turns WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 GROUP BY 1",
        "src19_wav_pairs": f"""WITH s AS (SELECT dialogue_id, speaker, count(*) FILTER ("end" > start) AS n FROM word_transcripts WHERE speaker IN ('A', 'B') GROUP BY 1, 2)
            SELECT a.dialogue_id, CAST(a.n AS INTEGER) AS n_a, CAST(b.n AS INTEGER) AS n_b, 2::BIGINT AS frames FROM s a JOIN s b ON a.dialogue_id = b.dialogue_id AND a.speaker = 'A' AND b.speaker = 'B' WHERE ascii(md5(a.dialogue_id)) % 2 = 1""",
        "src20_diagram": """SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, NULL AS source, NULL AS target, '1' AS vertex, NULL AS edge FROM nation
            UNION ALL SELECT 's' || s_suppkey, NULL, 'n' || s_nationkey, 'n' || ((s_nationkey + s_suppkey) % 25), NULL, '1' FROM supplier""",
        "src21_live_messages": "SELECT user_id, event_id, event_type AS payload FROM events WHERE event_id % 9 = 1",
        "snk02_written_once": "SELECT form, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1",
        "snk03_arrays": f"WITH {Q.V1}, s AS (SELECT row_id, unnest(range(9)) AS r, unnest(b) AS s FROM v1) SELECT row_id, CAST(r AS INTEGER) AS r, CAST(len(s) AS INTEGER) AS n, {digest('s')} AS digest FROM s",
    }
