"""File sources: transcripts, chats, scripts, scores, token arrays, archives, audio headers, diagrams."""

from __future__ import annotations

import io
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WORDS = "speaker string, word string, start double, end double"


def _relative(root: str):
    """A file's path below ``root`` without its suffix."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    below = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    return F.regexp_replace(F.replace(path, F.lit(below), F.lit("")), r"\.[^./]+$", "")


def word_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Words of every ``*.json`` below ``root``, each file an array; the dialogue is the relative path."""
    reader = spark.read.schema(WORDS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return reader.json(root).select(_relative(root).alias("dialogue_id"), "speaker", "word", "start", "end")


def text_chats(spark: SparkSession, root: str) -> DataFrame:
    """Chats ``[[speaker, text], ...]``: dialogue, texts in order; labels are dropped. Broken files give null texts."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    turns = F.from_json("value", "array<array<string>>")
    return files.select(_relative(root).alias("dialogue_id"), F.transform(turns, lambda t: F.get(t, F.lit(1))).alias("texts"))


def json_rows(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines (gzip is transparent) with unreadable lines kept in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)


def manifest_lines(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """Lines of a text file addressed by number from 0."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines if wanted is None else lines.where(F.col("line_no").isin(*wanted))


def _decoded(files: DataFrame, decode, schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows decoded from binary files; a file that cannot be read gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.extend((path, *r, None) for r in decode(content))
                except Exception as e:  # noqa: BLE001 - the error is data here
                    rows.append((path, *[None] * (len(arrow) - 2), f"{type(e).__name__}: {e}"[:200]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)


_MATRIX = pa.schema([("path", pa.string()), ("name", pa.string()), ("codes", pa.list_(pa.list_(pa.int32()))), ("error", pa.string())])
_MATRIX_DDL = "path string, name string, codes array<array<int>>, error string"


def npy_matrices(spark: SparkSession, root: str) -> DataFrame:
    """``.npy`` files as integer matrices; a vector is a matrix of one row."""

    def decode(content: bytes):
        yield "", np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.int32).tolist()

    return _decoded(_binary(spark, root, "*.npy"), decode, _MATRIX_DDL, _MATRIX)


def npz_matrices(spark: SparkSession, root: str) -> DataFrame:
    """``.npz`` files: one row per array in the archive, by its name."""

    def decode(content: bytes):
        with np.load(io.BytesIO(content), allow_pickle=False) as archive:
            for name in archive.files:
                yield name, np.atleast_2d(archive[name]).astype(np.int32).tolist()

    return _decoded(_binary(spark, root, "*.npz"), decode, _MATRIX_DDL, _MATRIX)


_MEMBER = pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def zip_members(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Members of zip files whose name ends in ``suffix``."""

    def decode(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in sorted(archive.namelist()):
                if name.endswith(suffix):
                    yield name, archive.read(name)

    return _decoded(_binary(spark, root, "*.zip"), decode, "path string, name string, content binary, error string", _MEMBER)


_WAV = pa.schema([("path", pa.string()), ("channels", pa.int32()), ("rate", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("error", pa.string())])


def wav_header(file: BinaryIO) -> tuple[int, int, int, int]:
    """(channels, rate, bits, frames) of a RIFF file; chunks before the data are skipped, the data are not read."""
    if not (head := file.read(12)).startswith(b"RIFF") or head[8:] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    end = file.seek(0, 2)
    at, found = 12, None
    while at + 8 <= end:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            found = channels, rate, bits
        elif name == b"data":
            if not found:
                raise ValueError("data before format")
            size = min(size, end - at - 8)
            return (*found, size // max(1, found[0] * found[2] // 8))
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def wav_channel(content: bytes, channel: int = 0) -> list[int]:
    """The samples of one channel of a 16-bit WAV."""
    file = io.BytesIO(content)
    channels, _, bits, frames = wav_header(file)
    if bits != 16:
        raise ValueError(f"{bits} bits a sample")
    return np.frombuffer(file.read(frames * channels * 2), dtype="<i2")[channel::channels].tolist()


def _opened(path: str) -> BinaryIO:
    """A seekable file of any filesystem that Arrow knows (local, HDFS, object stores)."""
    filesystem, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return filesystem.open_input_file(name)


def wav_headers(spark: SparkSession, root: str) -> DataFrame:
    """Headers of ``.wav`` files, of which only the chunk headers are read; a caller that needs stereo filters on ``channels = 2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    with _opened(path) as file:
                        rows.append((path, *wav_header(file), None))
                except Exception as e:  # noqa: BLE001 - the error is data here
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _WAV)], schema=_WAV)

    # Without the content column the file source lists and does not read.
    return _binary(spark, root, "*.wav").select("path").mapInArrow(run, "path string, channels int, rate int, bits int, frames long, error string")


def wav_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Stereo recordings ``<base>.wav`` with the segments of ``<base>_A.json`` and ``<base>_B.json`` of the same folder name.

    (base, a, b, rate, frames): segments without both times or that end before they begin are dropped.
    Recordings that lack a side, are not stereo or cannot be read give no row.
    """
    segment = "array<struct<text:string,start:string,end:string>>"
    number = lambda c: F.try_to_number(c, F.lit("999999999.999999")).cast("double")
    place = lambda c, suffix: F.regexp_extract(c, rf"([^/]+/[^/]+){suffix}$", 1)
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*_[AB].json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", segment).alias("segments"))
    timed = F.transform("segments", lambda s: F.struct(s["text"].alias("text"), number(s["start"]).alias("start"), number(s["end"]).alias("end")))
    files = files.withColumn("segments", F.filter(timed, lambda s: s["end"] > s["start"]))
    side = lambda who: files.where(F.col("path").endswith(f"_{who}.json")).select(place("path", f"_{who}\\.json").alias("base"), F.col("segments").alias(who.lower()))
    audio = wav_headers(spark, root).where("error IS NULL AND channels = 2").select(place("path", "\\.wav").alias("base"), "rate", "frames")
    return side("A").join(side("B"), "base").join(audio, "base")


def dialogue_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row per ``*.json`` below ``root``: the dialogue (relative path), its object, and whether the file could not be read."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    parsed = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema))
    return files.select(_relative(root).alias("dialogue_id"), parsed.alias("dialogue"), F.try_parse_json("value").isNull().alias("unreadable"))


def xml_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a diagram file with id, parent, source and target."""
    schema = "_id string, _parent string, _source string, _target string, _vertex string, _edge string"
    rows = spark.read.format("xml").option("rowTag", "mxCell").schema(schema).load(path)
    return rows.select(*[F.col(f"_{c}").alias(c) for c in ("id", "parent", "source", "target", "vertex", "edge")])


class TarSource(DataSource):
    """Members of tar files, one partition a tar: ``format("tar_members")`` with options path and suffix.

    With the option ``loose`` files that are in no tar are read where there is no tar at all; where there
    is one they are ignored. A tar that cannot be read to its end gives one row with its error behind the
    members read so far, instead of failing the job. Any filesystem that Arrow knows will do.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "path string, name string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix, self.loose = options["path"], options.get("suffix", ""), options.get("loose", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        filesystem, root = fs.FileSystem.from_uri(self.root) if ":/" in self.root else (fs.LocalFileSystem(), self.root)
        names = sorted(f.path for f in filesystem.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
        scheme = self.root[: self.root.index(root)] if root in self.root else ""
        tars = [n for n in names if n.endswith(".tar")]
        found = tars or ([n for n in names if n.endswith(self.suffix)] if self.loose else [])
        return [InputPartition(scheme + n) for n in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        if path is None:
            return
        try:
            with _opened(path) as file:
                if not path.endswith(".tar"):
                    yield path, path.rsplit("/", 1)[-1], file.read(), None
                    return
                with tarfile.open(fileobj=file) as archive:
                    for member in sorted((m for m in archive if m.isfile() and m.name.endswith(self.suffix)), key=lambda m: m.name):
                        yield path, member.name, archive.extractfile(member).read(), None
        except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
            yield path, None, None, f"{type(e).__name__}: {e}"[:200]


def annotation_exports(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Annotation files whose name ends in ``suffix``: name without it, and their segments."""
    segment = "array<struct<id:string,channelId:string,startMs:double,endMs:double,transcript:string>>"
    rows = spark.read.schema(f"segments {segment}").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").json(root)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), F.lit(f"\\Q{suffix}\\E$"), F.lit("")).alias("name"), "segments")


def cuts_with_archives(spark: SparkSession, root: str, suffix: str = ".flac") -> DataFrame:
    """Cuts of gzipped JSON lines (``cuts.N.jsonl.gz``) with the names in the archive of the same index (``recording.N.tar``).

    Cuts without an archive are left out, as are archives without cuts; members stay in name order.
    """
    index = lambda c: F.regexp_extract(c, r"\.(\d+)\.[a-z.]+$", 1)
    cuts = spark.read.schema("id string, duration double").option("pathGlobFilter", "*.jsonl.gz").json(root)
    cuts = cuts.select(index(F.col("_metadata.file_name")).alias("index"), "id", "duration")
    names = tar_members(spark, root, suffix).where("error IS NULL").groupBy(index(F.col("path")).alias("index")).agg(F.array_sort(F.collect_list("name")).alias("members"))
    return cuts.join(names, "index")


def cascade_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders that hold both ``audio.wav`` and ``turns.json``: header and turns; folders that lack one give no row."""
    turn = "array<struct<speaker:string,text:string,t_start:double,t_end:double>>"
    folder = lambda c: F.regexp_extract(c, r"([^/]+)/[^/]+$", 1)
    turns = spark.read.text(root, wholetext=True, pathGlobFilter="turns.json", recursiveFileLookup=True)
    turns = turns.select(folder(F.col("_metadata.file_path")).alias("dialogue_id"), F.from_json("value", turn).alias("turns")).where("turns IS NOT NULL")
    audio = wav_headers(spark, root).where("error IS NULL AND path LIKE '%/audio.wav'").select(folder(F.col("path")).alias("dialogue_id"), "channels", "rate", "frames")
    return turns.join(audio, "dialogue_id")


def tar_members(spark: SparkSession, root: str, suffix: str = ".wav", loose: bool = False) -> DataFrame:
    """Members of the tars below ``root``; with ``loose``, the files themselves where there is no tar at all."""
    spark.dataSource.register(TarSource)
    return spark.read.format("tar_members").option("path", root).option("suffix", suffix).option("loose", str(loose).lower()).load()


def episodes(spark: SparkSession, root: str, suffix: str = ".wav") -> DataFrame:
    """Episodes of the tars below ``root`` (path, name, samples, error): the first channel of each 16-bit WAV, in order of name within a tar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name, content, error in zip(*(c.to_pylist() for c in batch.columns)):
                samples = None
                if error is None:
                    try:
                        samples = wav_channel(content)
                    except (ValueError, struct.error) as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                rows.append((path, name, samples, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _EPISODE)], schema=_EPISODE)

    return tar_members(spark, root, suffix).mapInArrow(run, "path string, name string, samples array<int>, error string")


_EPISODE = pa.schema([("path", pa.string()), ("name", pa.string()), ("samples", pa.list_(pa.int32())), ("error", pa.string())])
