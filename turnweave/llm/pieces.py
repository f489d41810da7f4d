"""Splitting oversized transcripts at natural boundaries (problem 1).

A transcript is read in ranges of time, each with a halo of one limit on either side. A worker finds,
in its range alone, where a piece that begins at a given word ends, for every word at which a piece
may begin there: the first of the range, or any that a piece of the range before can reach. What it
emits is a boundary table, one row per range: entry to exit, how many pieces lie between, and the pieces
that may begin there. Stitching moves numbers only. Boundary tables of neighbouring ranges compose into
one of the same kind, so spans of ranges are composed first, then the spans of a transcript are
followed, and prefix sums of pieces, words and characters go back down to the ranges; each range emits
its pieces where they lie. Nothing ever holds a whole transcript, and no text leaves its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.confusables import Spelling
from turnweave.llm.forms import Forms
from turnweave.llm.words import KEYS, ORDER, blocked, delivered_once
from turnweave.session import checkpointed, map_groups

#: Width of a range, and ranges composed at once.
RANGE_MS, SPAN = 1_800_000, 64
_L, _S, _I = pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()
_TABLE = pa.schema(
    [("dialogue_id", pa.string()), ("block", _I), ("n_words", _I), ("n_chars", _I), ("exits", _L), ("counts", _L), ("pos", _L), ("next", _L), ("first_row", _L), ("new_row", _L), ("last_row", _L)]
    + [("start_ms", _L), ("end_ms", _L), ("words", _L), ("chars", _L), ("chars_before", _L), ("new_chars", _L), ("cut", _S), ("text", _S)]
)
_TABLE_DDL = (
    "dialogue_id string, block bigint, n_words bigint, n_chars bigint, exits array<bigint>, counts array<bigint>, pos array<bigint>, next array<bigint>, first_row array<bigint>, new_row array<bigint>, last_row array<bigint>, "
    "start_ms array<bigint>, end_ms array<bigint>, words array<bigint>, chars array<bigint>, chars_before array<bigint>, new_chars array<bigint>, cut array<string>, text array<string>"
)
_PIECE = pa.schema(
    [("dialogue_id", pa.string()), ("piece", _I), ("first_row_id", _I), ("new_row_id", _I), ("last_row_id", _I), ("start_ms", _I), ("end_ms", _I)]
    + [("n_words", _I), ("n_chars", _I), ("word_offset", _I), ("char_offset", _I), ("new_chars", _I), ("cut", pa.string()), ("text", pa.string())]
)
_PIECE_DDL = (
    "dialogue_id string, piece bigint, first_row_id bigint, new_row_id bigint, last_row_id bigint, start_ms bigint, end_ms bigint, n_words bigint, n_chars bigint, "
    "word_offset bigint, char_offset bigint, new_chars bigint, cut string, text string"
)


class Range:
    """The words of a range and its halo, in order, with what a piece needs to know of them."""

    def __init__(self, rows: list[tuple], max_ms: int, max_chars: int, overlap_ms: int, pause_ms: int):
        self.rows, self.max_ms, self.max_chars, self.overlap_ms, self.pause_ms = rows, max_ms, max_chars, overlap_ms, pause_ms
        self.sizes = [len(r[4]) for r in rows]
        self.before = [0]
        self.reach = [-(1 << 62)]  # furthest end of all words before
        for r, size in zip(rows, self.sizes):
            self.before.append(self.before[-1] + size)
            self.reach.append(max(self.reach[-1], r[1]))

    def begins(self, b: int) -> int:
        """The first word of the piece whose first new word is ``b``: as much of the overlap as the limits allow."""
        rows = self.rows
        if b == 0:
            return b
        since, reach, a = rows[b - 1][1] - self.overlap_ms, rows[b][1], b
        while a and rows[a - 1][0] >= since:
            furthest = max(reach, rows[a - 1][1])
            if furthest - rows[a - 1][0] > self.max_ms or self.before[b + 1] - self.before[a - 1] > self.max_chars:
                break
            reach, a = furthest, a - 1
        return a

    def ends(self, a: int, b: int) -> tuple[int, str]:
        """The first word behind the piece, and what is there: a pause of both channels, the end of a turn, or the limit."""
        rows, n = self.rows, len(self.rows)
        until, most = rows[a][0] + self.max_ms, self.before[a] + self.max_chars
        c = b + 1
        if rows[b][1] > until or self.before[c] > most:
            return c, "word"
        while c < n and rows[c][1] <= until and self.before[c + 1] <= most:
            c += 1
        if c == n:
            return c, "pause"
        for at in range(c, b, -1):
            if rows[at][0] - self.reach[at] >= self.pause_ms:
                return at, "pause"
            if rows[at][3] != rows[at - 1][3]:
                return at, "turn"
        return c, "limit"


def _tables(max_ms: int, max_chars: int, overlap_ms: int, pause_ms: int, range_ms: int, with_text: bool, spelling: Spelling):
    state: dict = {}

    def kernel(table: pa.Table) -> Iterator[tuple]:
        forms = state.setdefault("forms", Forms(spelling))
        rows = list(delivered_once(table, forms))
        mine = [k for k, r in enumerate(rows) if r[6]]
        if not mine:
            return
        lo, hi = mine[0], mine[-1] + 1
        block = table.column(1)[0].as_py()
        view = Range(rows, max_ms, max_chars, overlap_ms, pause_ms)
        reachable = sum(rows[k][0] < block * range_ms + max_ms for k in range(lo, hi)) if lo else 0
        exit_of: dict[int, tuple[int, int]] = {}  # word to the exit of its path and the pieces up to there
        nodes: dict[int, tuple] = {}
        for entry in range(lo, lo + reachable + 1):
            path, b = [], entry
            while b < hi and b not in exit_of:
                if b not in nodes:
                    a = view.begins(b)
                    nodes[b] = (a, *view.ends(a, b))
                path.append(b)
                b = nodes[b][1]
            leaves, count = (b - hi, 0) if b >= hi else exit_of[b]
            for p in reversed(path):
                count += 1
                exit_of[p] = (leaves, count)
        entries = [exit_of.get(e, (e - hi if e >= hi else 0, 0)) for e in range(lo, lo + reachable + 1)]
        exits, counts = [e for e, _ in entries], [n for _, n in entries]
        known = sorted(nodes)
        spans = [(b, *nodes[b]) for b in known]
        yield (
            table.column(0)[0].as_py(), block, hi - lo, view.before[hi] - view.before[lo], exits, counts,
            [b - lo for b in known], [c - lo for _, _, c, _ in spans],
            [rows[a][2] for _, a, _, _ in spans], [rows[b][2] for b in known], [rows[c - 1][2] for _, _, c, _ in spans],
            [rows[a][0] for _, a, _, _ in spans], [max(r[1] for r in rows[a:c]) for _, a, c, _ in spans],
            [c - a for _, a, c, _ in spans], [view.before[c] - view.before[a] for _, a, c, _ in spans],
            [view.before[b] - view.before[lo] for b in known], [view.before[c] - view.before[b] for b, _, c, _ in spans],
            [cut for *_, cut in spans], [" ".join(r[4] for r in rows[a:c] if r[4]) for _, a, c, _ in spans] if with_text else [None] * len(spans),
        )

    return kernel


_SPAN = pa.schema([("dialogue_id", pa.string()), ("span", _I), ("first", _I), ("last", _I), ("n_words", _I), ("n_chars", _I), ("exits", _L), ("counts", _L)])
_SPAN_DDL = "dialogue_id string, span bigint, first bigint, last bigint, n_words bigint, n_chars bigint, exits array<bigint>, counts array<bigint>"
_START = pa.schema([("dialogue_id", pa.string()), ("at", _I), ("entry", _I), ("piece", _I), ("words", _I), ("chars", _I)])
_START_DDL = "dialogue_id string, at bigint, entry bigint, piece bigint, words bigint, chars bigint"


def _composed(table: pa.Table) -> Iterator[tuple]:
    """The boundary table of a span of ranges from those of its ranges, in order of the ranges."""
    dialogue, span = table.column(0)[0].as_py(), table.column(1)[0].as_py()
    blocks, words, chars = (table.column(k).to_pylist() for k in (2, 4, 5))
    at = count = None
    expected = blocks[0]
    for block, exits, counts in zip(blocks, table.column(6), table.column(7)):
        exits, counts = (np.array(x.as_py(), dtype=np.int64) for x in (exits, counts))
        if at is None:
            at, count = np.arange(len(exits)), np.zeros(len(exits), dtype=np.int64)
        elif block != expected:  # a hole: what comes next begins afresh
            at = np.zeros_like(at)
        here = np.minimum(at, len(exits) - 1)
        at, count, expected = exits[here], count + counts[here], block + 1
    yield dialogue, span, blocks[0], blocks[-1], sum(words), sum(chars), at.tolist(), count.tolist()


def _followed(table: pa.Table) -> Iterator[tuple]:
    """Where each row of a group is entered, with the pieces, words and characters before it.

    Rows are ranges or spans in order; the group's own start rides on each of them.
    """
    dialogue = table.column(0)[0].as_py()
    rows = zip(*(table.column(k).to_pylist() for k in range(2, table.num_columns)))
    entry = piece = words = chars = expected = None
    for first, last, n_words, n_chars, exits, counts, entry0, piece0, words0, chars0 in rows:
        if entry is None:
            entry, piece, words, chars = entry0, piece0, words0, chars0
        elif first != expected:
            entry = 0
        yield dialogue, first, entry, piece, words, chars
        at = min(entry, len(exits) - 1)
        entry, piece, words, chars, expected = exits[at], piece + counts[at], words + n_words, chars + n_chars, last + 1


def _starts(tables: DataFrame, span: int) -> DataFrame:
    """(dialogue_id, block, entry, piece, words, chars) of every range. Only numbers of ranges are moved."""
    numbers = tables.select("dialogue_id", F.floor(F.col("block") / span).alias("span"), F.col("block").alias("first"), F.col("block").alias("last"), "n_words", "n_chars", "exits", "counts")
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("entry", "piece", "words", "chars")]
    spans = map_groups(numbers, ["dialogue_id", "span"], ["first"], _composed, _SPAN_DDL, _SPAN)
    body = ["first", "last", "n_words", "n_chars", "exits", "counts"]
    whole = spans.select("dialogue_id", F.lit(0).cast("bigint").alias("part"), *body, *zero)
    entered = map_groups(whole, ["dialogue_id", "part"], ["first"], _followed, _START_DDL, _START)
    # A span's start is known by the span that holds its first range; a hole before it was seen above.
    at_span = entered.select(F.col("dialogue_id").alias("_d"), F.floor(F.col("at") / span).alias("_s"), "entry", "piece", "words", "chars")
    inside = numbers.join(at_span, F.col("dialogue_id").eqNullSafe(F.col("_d")) & (F.col("span") == F.col("_s"))).select("dialogue_id", "span", *body, "entry", "piece", "words", "chars")
    return map_groups(inside, ["dialogue_id", "span"], ["first"], _followed, _START_DDL, _START)


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each range on the path from its entry, with their offsets in the transcript."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            at = {p: k for k, p in enumerate(row["pos"])}
            b, piece = row["entry"], row["piece"]
            while b < row["n_words"]:
                k = at[b]
                out.append(
                    (row["dialogue_id"], piece, row["first_row"][k], row["new_row"][k], row["last_row"][k], row["start_ms"][k], row["end_ms"][k], row["words"][k], row["chars"][k])
                    + (row["words_before"] + b, row["chars_before_range"] + row["chars_before"][k], row["new_chars"][k], row["cut"][k], row["text"][k])
                )
                piece += 1
                b = row["next"][k]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)


def split_transcripts(
    words: DataFrame,
    roles: DataFrame,
    dialogues: DataFrame,
    max_ms: int = 50_000,
    max_chars: int = 600,
    overlap_ms: int = 3_000,
    pause_ms: int = 300,
    range_ms: int = RANGE_MS,
    with_text: bool = True,
    span: int = SPAN,
    spelling: Spelling | None = None,
) -> DataFrame:
    """Ordered pieces of every transcript, each within both limits.

    A piece takes as many words as fit and ends at the latest point among them where both channels are
    silent for ``pause_ms`` or another channel begins; only where there is none, at the limit. It
    repeats the words that began in the last ``overlap_ms`` before the cut, fewer where the limits
    leave no room for them and one new word. A word beyond a limit stands alone. A transcript within
    the limits is one piece. ``word_offset`` and ``char_offset`` count new words and characters.
    Null words count as empty; rows that are not usable give nothing; ties in start go by row id.
    """
    if not 0 < overlap_ms < max_ms < range_ms:
        raise ValueError("overlap_ms < max_ms < range_ms must hold")
    rows = blocked(words, roles, dialogues, range_ms, halo_ms=max_ms)
    kernel = _tables(max_ms, max_chars, overlap_ms, pause_ms, range_ms, with_text, spelling or Spelling())
    # Read twice below, for the numbers and for the pieces.
    tables = checkpointed(map_groups(rows, KEYS, ORDER, kernel, _TABLE_DDL, _TABLE, flush=2_000))
    starts = _starts(tables, span).select(
        F.col("dialogue_id").alias("_d"), F.col("at").alias("_b"), "entry", "piece", F.col("words").alias("words_before"), F.col("chars").alias("chars_before_range")
    )
    return tables.join(starts, F.col("dialogue_id").eqNullSafe(F.col("_d")) & (F.col("block") == F.col("_b"))).drop("_d", "_b").mapInArrow(_emitted, _PIECE_DDL)


def oversized(pieces: DataFrame, max_ms: int = 50_000, max_chars: int = 600) -> DataFrame:
    """Dialogues whose pieces together reach over a limit: from their times and character prefix sums."""
    whole = pieces.groupBy("dialogue_id").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.sum("new_chars").alias("n"))
    return whole.where((F.col("e") - F.col("s") > max_ms) | (F.col("n") > max_chars)).select("dialogue_id")
