"""Words to frames, and the merge of two speakers' text rows, as array kernels over one stream.

Neither is expressible in built-in columns, so both run Arrow-batched: frames by (dialogue, channel)
groups cut from a sorted stream, merges row by row. Inside a stream there is no step per cell: times come
from prefix sums of characters, frames from a running maximum, markers from the runs of a speaker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.config import TokenConfig
from turnweave.functions.tokenizer import CodePoints, Tokenizer
from turnweave.session import map_groups

CFG = TokenConfig()


def _slots(frames: np.ndarray, room: int) -> np.ndarray:
    """For each wished-for frame, in order, the frame it gets; ``room`` or more where the stream has ended.

    Where wishes never go back, each gets its own or the one behind the last. Where they do, a gap left
    earlier may serve, and the frame in front of an id counts as taken: then free frames are looked up
    in a forest of links to the next free one.
    """
    k = np.arange(len(frames))
    if (np.diff(frames) >= 0).all():
        return np.maximum.accumulate(frames - k) + k
    link: dict[int, int] = {}

    def free(cell: int) -> int:
        passed = []
        while cell in link:
            passed.append(cell)
            cell = link[cell]
        link.update(dict.fromkeys(passed, cell))
        return cell

    got = np.full(len(frames), room)
    for i, wish in enumerate(frames.tolist()):
        cell = free(wish)
        if cell >= room:
            break
        got[i] = cell
        link[cell] = cell + 1
        if cell and cell - 1 not in link:
            link[cell - 1] = cell
    return got


def place_pieces(starts: np.ndarray, last_end: float, ids: np.ndarray, rate: float, pad: int, epad: int) -> tuple[list[int], int]:
    """Frame ids of pieces in order, and how many fell off the end (a piece that does takes all behind it along).

    The stream ends a second behind the last piece. A pad in front of an id becomes the end-of-padding id.
    """
    if not len(ids):
        return [], 0
    room = int((last_end + 1) * rate)
    got = _slots(np.maximum(starts // (1 / rate), 0).astype(np.int64), room)
    over = np.flatnonzero(got >= room)
    kept = int(over[0]) if len(over) else len(ids)
    cells = np.full(max(room, 0), pad, dtype=np.int64)
    at = got[:kept]
    front = np.setdiff1d(at - 1, at)
    cells[front[front >= 0]] = epad
    cells[at] = ids[:kept]
    return cells.tolist(), len(ids) - kept


def align_words(words: list[tuple[str, float, float]], tokenizer: Tokenizer, spaces: bool, lenient: bool, cfg: TokenConfig = CFG) -> tuple[list[int], int, str | None]:
    """Frame ids of one speaker's words (text, start, end) in order of start, ids dropped, and an error if there is one.

    A word's time is shared out evenly over its characters; a piece lasts from its first to its last.
    Strict: an empty word or characters left over are errors. Lenient: empty words are skipped, and
    the pieces end where the characters do.
    """
    said = [(" " * (spaces and k > 0) + w.strip()) if spaces else w for k, (w, _, _) in enumerate(words)]
    if not lenient and not all(said):
        return [], 0, "empty word"
    texts = [t for t in said if t]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.array([s for t, (_, s, _) in zip(said, words) if t], dtype=float)
    each = (np.array([e for t, (_, _, e) in zip(said, words) if t], dtype=float) - begins) / np.maximum(sizes, 1)
    upto = np.cumsum(sizes)
    # Characters of each piece; the mark in front of the first word stands for none.
    pieces = tokenizer.encode_pieces("".join(texts))
    widths = np.array([len(p) - (k == 0 and p.startswith("▁")) for k, p in enumerate(pieces)], dtype=np.int64)
    pieces, widths = [p for p, w in zip(pieces, widths) if w], widths[widths > 0]
    ends = np.cumsum(widths)
    total, covered = int(sizes.sum()), int(widths.sum())
    if not lenient and covered != total:
        return [], 0, "pieces without characters" if covered > total else "characters without pieces"
    n = int(np.searchsorted(ends, total, "right"))
    pieces, ends, widths = pieces[:n], ends[:n], widths[:n]
    if not n:
        return [], 0, None

    def time(char: np.ndarray, edge: int) -> np.ndarray:
        word = np.searchsorted(upto, char, "right")
        return begins[word] + (char - (upto[word] - sizes[word]) + edge) * each[word]

    ids = np.array([tokenizer.piece_to_id(p) for p in pieces], dtype=np.int64)
    return (*place_pieces(time(ends - widths, 0), float(time(ends[-1:] - 1, 1)[0]), ids, cfg.frame_rate, cfg.text_pad, cfg.text_epad), None)


def frame_align(words: DataFrame, tokenizer: Tokenizer | None = None, spaces: bool = True, lenient: bool = False, cfg: TokenConfig = CFG) -> DataFrame:
    """(dialogue_id, channel, ids, dropped, error) of words (dialogue_id, channel, word, start, end, row_id).

    Words without both times are left out. Ties in start go by row id. A stream is one row of the
    result, so one task holds one stream at a time.
    """
    tokenizer = tokenizer or CodePoints()

    def kernel(table: pa.Table) -> Iterator[tuple]:
        dialogue, channel = table.column(0)[0].as_py(), table.column(1)[0].as_py()
        rows = list(zip(*(table.column(k).to_pylist() for k in (2, 3, 4))))
        yield (dialogue, channel, *align_words([(w or "", s, e) for w, s, e in rows], tokenizer, spaces, lenient, cfg))

    schema = pa.schema([("dialogue_id", pa.string()), ("channel", pa.string()), ("ids", pa.list_(pa.int32())), ("dropped", pa.int32()), ("error", pa.string())])
    rows = words.where("start IS NOT NULL AND `end` IS NOT NULL").select("dialogue_id", "channel", "word", "start", "end", "row_id")
    return map_groups(rows, ["dialogue_id", "channel"], ["start", "row_id"], kernel, "dialogue_id string, channel string, ids array<int>, dropped int, error string", schema, flush=500)


def _markers(who: np.ndarray, cfg: TokenConfig) -> tuple[list[tuple[int, int]], list[int]]:
    """Where markers stand (cell, marker), and cells whose id is given up, from who speaks in each cell (0: nobody).

    A marker stands in the cell before a speaker's run. The main speaker's may cover an id there; the
    other's may not, so a run right behind an id of the main speaker gives up its first cell, and one of
    a single cell vanishes, as if the main speaker had gone on. In front of cell 0 there is no cell.
    """
    speaking = np.flatnonzero(who)
    if not len(speaking):
        return [], []
    runs = np.split(speaking, np.flatnonzero(np.diff(who[speaking])) + 1)
    markers, given_up, current, taken = [], [], 0, -1
    for run in runs:
        speaker, first = int(who[run[0]]), int(run[0])
        if speaker != current:
            before = first == 0 or (speaker == cfg.other_bos and taken == first - 1)
            if before and speaker == cfg.other_bos:
                given_up.append(first)
            if not before or len(run) > 1:
                markers.append((int(run[1 if before else 0]) - 1, speaker))
                current = speaker
        taken = int(run[-1]) if not (given_up and given_up[-1] == run[-1]) else taken
    return markers, given_up


def merge_speakers(main: list[int], other: list[int], cfg: TokenConfig = CFG) -> list[int]:
    """One text row of two: the main speaker goes first, and markers stand where the speaker changes.

    Where nobody speaks the end-of-padding id of either row wins over padding. A marker that lands on the
    end-of-padding id behind a pad moves that id one cell to the front.
    """
    n = min(len(main), len(other))
    m, o = np.array(main[:n], dtype=np.int64), np.array(other[:n], dtype=np.int64)
    quiet = lambda x: (x == cfg.text_pad) | (x == cfg.text_epad)
    ends = (m == cfg.text_epad) | (o == cfg.text_epad)
    out = np.where(~quiet(m), m, np.where(~quiet(o), o, np.where(ends, cfg.text_epad, cfg.text_pad)))
    who = np.where(~quiet(m), cfg.main_bos, np.where(~quiet(o), cfg.other_bos, 0))
    markers, given_up = _markers(who, cfg)
    out[given_up] = m[given_up]
    if markers:
        at, ids = (np.array(c, dtype=np.int64) for c in zip(*markers))
        tail = at[(at > 0) & (out[at] == cfg.text_epad) & (out[at - 1] == cfg.text_pad)]
        out[tail - 1] = cfg.text_epad
        out[at] = ids
    return out.tolist()


def merged_text(main: Column, other: Column, cfg: TokenConfig = CFG) -> Column:
    """The merged text row of two text rows of one length, Arrow-batched."""

    @F.arrow_udf("array<int>")
    def merge(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else merge_speakers(x, y, cfg) for x, y in zip(a.to_pylist(), b.to_pylist())], type=pa.list_(pa.int32()))

    return merge(main, other)


def merged_streams(sides: DataFrame, cfg: TokenConfig = CFG) -> DataFrame:
    """One 17-row matrix a dialogue: merged text over both speakers' audio."""
    text = merged_text(F.get("A", F.lit(0)), F.get("B", F.lit(0)), cfg)
    audio = F.concat(F.slice("A", 2, cfg.codebooks), F.slice("B", 2, cfg.codebooks))
    return sides.withColumn("_text", text).withColumn("streams", F.concat(F.array("_text"), audio)).drop("A", "B", "_text")


def preprocess_tts(sides: DataFrame, most: int, least: int, cfg: TokenConfig = CFG) -> DataFrame:
    """Merge, split, minimum length, delay, labels: here every part is delayed by itself, after the split."""
    from turnweave.functions import arrays as X

    merged = merged_streams(sides, cfg)
    parts = merged.select("row_id", F.posexplode(X.split(F.col("streams"), most)).alias("part", "streams"))
    parts = parts.where(X.length_of(F.col("streams")) >= least).withColumn("streams", X.delay(F.col("streams"), cfg))
    return parts.withColumns({"labels": X.labels(F.col("streams"), cfg), "num_streams": F.size("streams"), "num_frames": X.length_of(F.col("streams"))})
