import io
import json
import struct
import tarfile
import zipfile

import numpy as np
from pyspark.sql import functions as F

from turnweave.operators import corpus as C
from turnweave.sources import files, sinks


def _wav(channels, frames):
    data = b"\x00" * (channels * 2 * frames)
    return b"RIFF" + struct.pack("<I", 36 + 10 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, 24000, 48000 * channels, 2 * channels, 16) + b"LIST" + struct.pack("<I", 2) + b"ab" + b"data" + struct.pack("<I", len(data)) + data


def test_sources(spark, tmp_path):
    (tmp_path / "w/x").mkdir(parents=True)
    (tmp_path / "w/x/d1.json").write_text(json.dumps([{"speaker": "A", "word": "hi", "start": 0.5, "end": 1}]))
    assert [tuple(r) for r in files.word_transcripts(spark, str(tmp_path / "w")).collect()] == [("x/d1", "A", "hi", 0.5, 1.0)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text('[["A", "one"],\n ["B", "two"]]')
    (tmp_path / "c/b.json").write_text("broken")
    assert {(r.dialogue_id, tuple(r.texts or ())) for r in files.text_chats(spark, str(tmp_path / "c")).collect()} == {("a", ("one", "two")), ("b", ())}
    np.save(tmp_path / "m.npy", np.arange(6).reshape(2, 3))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: (r.codes, r.error is None) for r in files.npy_matrices(spark, str(tmp_path)).collect()}
    assert got == {"m.npy": ([[0, 1, 2], [3, 4, 5]], True), "bad.npy": (None, False)}
    np.savez(tmp_path / "n.npz", A=np.array([1, 2]), B=np.array([[3]]))
    assert {(r.name, str(r.codes)) for r in files.npz_matrices(spark, str(tmp_path)).collect()} == {("A", "[[1, 2]]"), ("B", "[[3]]")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/dialogues.json", "{}")
        z.writestr("a/other.txt", "x")
    assert [(r.name, bytes(r.content)) for r in files.zip_members(spark, str(tmp_path), "/dialogues.json").collect()] == [("a/dialogues.json", b"{}")]
    (tmp_path / "s.wav").write_bytes(_wav(2, 100))
    (tmp_path / "t.wav").write_bytes(b"RIFFxxxx")
    assert {(r.channels, r.frames, r.error is None) for r in files.wav_headers(spark, str(tmp_path)).collect()} == {(2, 100, True), (None, None, False)}
    with tarfile.open(tmp_path / "k.tar", "w") as t:
        for name in ("b.wav", "a.wav", "c.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "bad.tar").write_bytes(b"no tar at all")
    rows = files.tar_members(spark, str(tmp_path)).collect()
    assert [r.name for r in rows if r.name] == ["a.wav", "b.wav"] and sum(r.error is not None for r in rows) == 1
    (tmp_path / "g.xml").write_text('<g><mxCell id="1" parent="0"/><mxCell id="2" source="1" target="9"/></g>')
    assert {(r.id, r.parent, r.target) for r in files.xml_cells(spark, str(tmp_path / "g.xml")).collect()} == {("1", "0", None), ("2", None, "9")}
    (tmp_path / "lines.txt").write_text("a\nb\nc")
    assert [r.line for r in files.manifest_lines(spark, str(tmp_path / "lines.txt"), [1]).collect()] == ["b"]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nbroken\n')
    assert {(r.a, r._corrupt_record) for r in files.json_rows(spark, str(tmp_path / "r.jsonl"), "a int").cache().collect()} == {(1, None), (None, "broken")}


def test_paired_sources(spark, tmp_path):
    import gzip

    (tmp_path / "gold").mkdir()
    (tmp_path / "gold/x_gold.json").write_text('{"audio": {}, "segments": [{"id": "1", "channelId": "ch_1", "startMs": 0, "endMs": 5}]}')
    (tmp_path / "gold/x_pre.json").write_text("{}")
    assert [(r.name, r.segments[0].endMs) for r in files.annotation_exports(spark, str(tmp_path / "gold"), "_gold.json").collect()] == [("x", 5.0)]
    (tmp_path / "cuts").mkdir()
    for k in (1, 2):
        with gzip.open(tmp_path / f"cuts/cuts.{k}.jsonl.gz", "wt") as f:
            f.write(json.dumps({"id": f"c{k}", "duration": 2.5}) + "\n")
    with tarfile.open(tmp_path / "cuts/recording.1.tar", "w") as t:
        for name in ("b.flac", "a.flac"):
            t.addfile(tarfile.TarInfo(name), io.BytesIO(b""))
    assert [(r.id, r.members) for r in files.cuts_with_archives(spark, str(tmp_path / "cuts")).collect()] == [("c1", ["a.flac", "b.flac"])]
    for name in ("d1", "d2"):
        (tmp_path / "cascade" / name).mkdir(parents=True)
        (tmp_path / "cascade" / name / "turns.json").write_text('[{"speaker": "A", "text": "hi", "t_start": 0, "t_end": 1}]')
    (tmp_path / "cascade/d1/audio.wav").write_bytes(_wav(2, 9))
    assert [(r.dialogue_id, r.frames, len(r.turns)) for r in files.cascade_folders(spark, str(tmp_path / "cascade")).collect()] == [("d1", 9, 1)]


def test_sinks(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "doc_id")
    numbered = C.shards(rows, "doc_id", 4, "x")
    sinks.write_shards(numbered, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 10 and {(r.shard, r.file) for r in back.select("shard", "file").distinct().collect()} == {(0, "x-000-of-003"), (1, "x-001-of-003"), (2, "x-002-of-003")}
    sinks.write_missing(rows, str(tmp_path / "m"))
    sinks.write_missing(rows.limit(1), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 10
    sinks.write_key_list(rows, "doc_id", str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).count() == 10
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    sinks.write_csv(rows, str(tmp_path / "v"))
    sinks.write_chunks(rows.withColumn("chunk_id", F.lit("a_part00")), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "v")).count() == spark.read.json(str(tmp_path / "p")).count() == 10


def test_loose_files_and_broken_tars(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.wav").write_bytes(_wav(1, 4))
    assert [(r.name, len(r.content)) for r in files.tar_members(spark, str(tmp_path / "a"), loose=True).collect()] == [("x.wav", len(_wav(1, 4)))]
    assert files.tar_members(spark, str(tmp_path / "a")).count() == 0
    with tarfile.open(tmp_path / "a/k.tar", "w:gz") as t:
        for name in ("b.wav", "c.wav"):
            info = tarfile.TarInfo(name)
            info.size = 60_000
            t.addfile(info, io.BytesIO(np.random.default_rng(1).bytes(60_000)))
    whole = (tmp_path / "a/k.tar").read_bytes()
    assert [r.name for r in files.tar_members(spark, f"file://{tmp_path}/a", loose=True).collect()] == ["b.wav", "c.wav"]  # loose ones ignored
    (tmp_path / "a/k.tar").write_bytes(whole[: len(whole) // 2])
    rows = files.tar_members(spark, str(tmp_path / "a")).collect()
    assert rows and rows[-1].error


def test_episodes_and_pairs(spark, tmp_path):
    from turnweave.plans.files import wav_bytes

    assert files.wav_channel(wav_bytes(2, [5, -6, 7])) == [5, -6, 7]
    with tarfile.open(tmp_path / "k.tar", "w") as t:
        for name, content in (("b.wav", wav_bytes(2, [1, 2])), ("a.wav", wav_bytes(1, [3])), ("bad.wav", b"RIFFxxxx")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    assert [(r.name, r.samples, r.error is None) for r in files.episodes(spark, str(tmp_path)).collect()] == [("a.wav", [3], True), ("b.wav", [1, 2], True), ("bad.wav", None, False)]
    (tmp_path / "s").mkdir()
    segments = json.dumps([{"text": "hi", "start": "0.5", "end": "1"}, {"text": "bad", "start": "2", "end": "1"}, {"text": "none", "start": "", "end": "1"}])
    for name, channels in (("x", 2), ("mono", 1)):
        (tmp_path / f"s/{name}.wav").write_bytes(wav_bytes(channels, [1]))
        for who in "AB":
            (tmp_path / f"s/{name}_{who}.json").write_text(segments)
    (tmp_path / "s/lone_A.json").write_text(segments)
    assert [(r.base, len(r.a), r.b[0].start) for r in files.wav_pairs(spark, str(tmp_path / "s")).collect()] == [("s/x", 1, 0.5)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.json").write_text('{"dialogue_id": "1", "utterances": [{"text": "hi"}]}')
    (tmp_path / "d/two.json").write_text('{"dialogue_id": "1", ')
    found = {r.dialogue_id: (r.unreadable, r.dialogue.utterances[0].text if r.dialogue else None) for r in files.dialogue_files(spark, str(tmp_path / "d"), "dialogue_id string, utterances array<struct<text:string>>").collect()}
    assert found == {"one": (False, "hi"), "two": (True, None)}


def test_array_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x", [[1, 2], [3, 4]]), ("y", [[1], [2, 3]]), ("z", None)], "name string, m array<array<int>>")
    assert sinks.write_arrays(rows, str(tmp_path / "o"), "name", "m") == 1
    assert [r.codes for r in files.npy_matrices(spark, str(tmp_path / "o")).collect()] == [[[1, 2], [3, 4]]]
    assert not [p for p in (tmp_path / "o").rglob("*.part")]
    sinks.write_missing(rows.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
