"""Expressions over token streams: ``array<int>`` rows and ``array<array<int>>`` matrices.

All are built-in higher-order functions, so they run inside the JVM without a shuffle. A null row or
matrix gives null; slices beyond the end are shorter; nothing here raises on empty arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.config import TokenConfig

CFG = TokenConfig()


def ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def repeat(value: Column | int, n: Column | int) -> Column:
    value = value if isinstance(value, Column) else F.lit(int(value))
    n = n if isinstance(n, Column) else F.lit(n)
    return F.array_repeat(value, F.greatest(n, F.lit(0)).cast("int"))


def fit(row: Column, length: Column, pad: Column | int) -> Column:
    """Cut a row to ``length`` or pad it on the right."""
    return F.slice(F.concat(row, repeat(pad, length - F.size(row))), 1, length)


def length_of(matrix: Column) -> Column:
    """Frames of a rectangular matrix: those of its first row, 0 without rows."""
    return F.coalesce(F.size(F.get(matrix, F.lit(0))), F.lit(0))


def merge_text_audio(side: Column, cfg: TokenConfig = CFG) -> Column:
    """Text row cut or padded to the audio's length, audio rows made rectangular, stacked."""
    frames = F.size(F.get(side, F.lit(1)))
    return F.transform(side, lambda row, i: fit(row, frames, F.when(i == 0, cfg.text_pad).otherwise(cfg.audio_initial)))


def main_view(main: Column, other: Column) -> Column:
    """Text and audio of the main speaker over the audio of the other; the other's text is dropped."""
    return F.concat(main, F.slice(other, 2, F.greatest(F.size(other) - 1, F.lit(0))))


def delay(matrix: Column, cfg: TokenConfig = CFG, delays: Column | None = None) -> Column:
    """Row i: initial id, initial ids for its delay, the row, pads up to the greatest delay."""
    by_row = ints(cfg.delays) if delays is None else delays
    most = F.array_max(by_row)
    initials, pads = ints(cfg.initials), ints(cfg.pads)
    return F.transform(
        matrix,
        lambda row, i: F.concat(repeat(F.get(initials, i), F.get(by_row, i) + 1), row, repeat(F.get(pads, i), most - F.get(by_row, i))),
    )


def undelay(matrix: Column, delays: Sequence[int] = CFG.delays) -> Column:
    """Row i from its delay on, over the length without the greatest delay; null where nothing is left.

    The initial column stays: callers that do not want it cut it off.
    """
    most = max(delays)
    frames = length_of(matrix) - most
    return F.when(frames >= 1, F.transform(matrix, lambda row, i: F.slice(row, F.get(ints(delays), i) + 1, frames)))


def part_bounds(frames: Column, most: Column | int) -> Column:
    """(start, size) of ``ceil(frames / most)`` near-equal parts; the first ones are longer by one."""
    most = most if isinstance(most, Column) else F.lit(most)
    n = ((frames + most - 1) / most).cast("int")
    base, extra = (frames / n).cast("int"), frames % n
    return F.when(
        frames > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.struct((k * base + F.least(k, extra)).cast("int").alias("start"), (base + F.when(k < extra, 1).otherwise(0)).cast("int").alias("size")),
        ),
    ).otherwise(F.array())


def split(matrix: Column, most: Column | int) -> Column:
    """The parts of a matrix, each as long as ``part_bounds`` says."""
    return F.transform(part_bounds(length_of(matrix), most), lambda p: F.transform(matrix, lambda row: F.slice(row, p.start + 1, p.size)))


def labels(matrix: Column, cfg: TokenConfig = CFG) -> Column:
    """Ids below the row's initial id stay, all others become the ignored label."""
    initials = ints(cfg.initials)
    return F.transform(matrix, lambda row, i: F.transform(row, lambda x: F.when(x < F.get(initials, i), x).otherwise(F.lit(cfg.zero))))


def mask_prompt(label: Column, prompt_len: Column, cfg: TokenConfig = CFG) -> Column:
    """Labels whose cells before the end of the prompt, shifted by each row's delay, are ignored."""
    by_row = ints(cfg.delays)

    def masked(row: Column, i: Column) -> Column:
        end = F.get(by_row, i) + 1 + prompt_len
        return F.concat(repeat(cfg.zero, F.least(end, F.size(row))), F.slice(row, end + 1, F.size(row)))

    return F.transform(label, masked)


def demux(text: Column, main_first: bool = True, cfg: TokenConfig = CFG) -> Column:
    """The two speakers' text rows of a marked row, as struct (main, other).

    A marker sets the speaker and goes away; a pad leaves both padded; any other id, the end-of-padding
    id included, goes to the speaker of the last marker.
    """
    is_marker = lambda x: (x == cfg.main_bos) | (x == cfg.other_bos)
    # Each marker's speaker is repeated up to the next marker, so the work is linear in the row.
    found = F.filter(F.transform(text, lambda x, i: F.struct(i.alias("pos"), x.alias("who"))), lambda m: is_marker(m.who))
    begins = F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit(cfg.main_bos if main_first else cfg.other_bos).alias("who"))), found)
    ends = F.concat(F.transform(found, lambda m: m.pos), F.array(F.size(text)))
    speakers = F.flatten(F.zip_with(begins, ends, lambda m, end: F.array_repeat(m.who, end - m.pos)))
    one = lambda bos: F.zip_with(text, speakers, lambda x, who: F.when(is_marker(x) | (who != bos), F.lit(cfg.text_pad)).otherwise(x))
    return F.struct(one(cfg.main_bos).alias("main"), one(cfg.other_bos).alias("other"))


def tile(codes: Column, length: Column) -> Column:
    """A row of constant codes repeated to ``length``."""
    times = ((length + F.size(codes) - 1) / F.size(codes)).cast("int")
    return F.slice(F.flatten(F.array_repeat(codes, times)), 1, length)


def prompt_length(role: Column, voice: Column | None, delimiter: int | None) -> Column:
    """Frames that ``prompt_prefix`` will have, from sizes alone."""
    tv = F.lit(0) if voice is None else F.coalesce(F.size(F.get(voice, F.lit(0))), F.lit(0))
    return tv + F.size(role) + (0 if delimiter is None else 1)


def prompt_prefix(role: Column, voice: Column | None, delimiter: int | None, rows: int = 17, cfg: TokenConfig = CFG) -> Column:
    """``[voice | role text | delimiter]`` as a matrix; every cell that no part sets is padding.

    Without voice, role text and delimiter the prompt is empty, which is an error.
    """
    tv = F.lit(0) if voice is None else F.coalesce(F.size(F.get(voice, F.lit(0))), F.lit(0))
    lt, ld = F.size(role), 0 if delimiter is None else 1
    total = tv + lt + ld
    text = F.concat(repeat(cfg.text_pad, tv), role, ints([] if delimiter is None else [delimiter]).cast("array<int>"))
    silent = repeat(cfg.audio_initial, total)

    def audio(k: int) -> Column:
        if voice is None or k >= cfg.codebooks:
            return silent
        return F.when(tv > 0, F.concat(F.get(voice, F.lit(k)), repeat(cfg.audio_initial, total - tv))).otherwise(silent)

    built = F.array(text, *[audio(k) for k in range(rows - 1)])
    return F.when(total > 0, built).otherwise(F.raise_error(F.lit("empty system prompt")).cast(f"array<array<int>>"))


def prompt_prefix_v2(role: Column, voice: Column | None, silence: Column, sine: Column, delimiter: int, pause: int = 6, rows: int = 17, cfg: TokenConfig = CFG) -> Column:
    """``[voice][pause][delimiter text delimiter][pause]``: main audio is silence, the other's a sine, repeated to length."""
    tv = F.lit(0) if voice is None else F.coalesce(F.size(F.get(voice, F.lit(0))), F.lit(0))
    lt = F.size(role)
    text_part = F.when(lt > 0, F.concat(ints([delimiter]), role, ints([delimiter]))).otherwise(F.array().cast("array<int>"))
    before = tv + F.when(tv > 0, pause).otherwise(0)
    total = before + F.size(text_part) + pause
    text = F.concat(repeat(cfg.text_pad, before), text_part, repeat(cfg.text_pad, pause))

    def audio(k: int) -> Column:
        if k >= cfg.codebooks:
            return tile(F.get(sine, F.lit(k - cfg.codebooks)), total)
        quiet = tile(F.get(silence, F.lit(k)), total)
        if voice is None:
            return quiet
        return F.when(tv > 0, F.concat(F.get(voice, F.lit(k)), F.slice(quiet, tv + 1, total - tv))).otherwise(quiet)

    return F.array(text, *[audio(k) for k in range(rows - 1)])


def join_time(left: Column, right: Column) -> Column:
    """Two matrices of the same rows, one after the other in time."""
    return F.zip_with(left, right, lambda a, b: F.concat(a, b))


def cut_time(matrix: Column, first: Column | int, size: Column | int) -> Column:
    """Frames ``first`` (from 0) on, ``size`` of them."""
    first = first if isinstance(first, Column) else F.lit(first)
    size = size if isinstance(size, Column) else F.lit(size)
    return F.transform(matrix, lambda row: F.slice(row, (first + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int")))


def speaker_prefix(matrix: Column, n: int, text_ids: tuple[int, int], audio_ids: tuple[int, int]) -> Column:
    """``2n`` columns before the matrix: n of the main speaker's embedding id, n of the other's; row 0 has its own ids."""
    return F.transform(
        matrix,
        lambda row, i: F.concat(
            repeat(F.when(i == 0, text_ids[0]).otherwise(audio_ids[0]), n), repeat(F.when(i == 0, text_ids[1]).otherwise(audio_ids[1]), n), row
        ),
    )


def trim_point(text: Column, buffer: int, pad: int = CFG.text_pad) -> Column:
    """Length up to which a text row is kept: behind its last id that is no pad, plus the buffer.

    With such an id among the last ``buffer`` cells the whole length counts. If there is none at all,
    or the row is no longer than the buffer and padded, the last index tried counts.
    """
    n = F.size(text)
    at = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.when(F.get(text, k) != pad, k))
    last = F.array_max(at)
    return F.when(last >= n - buffer, n).otherwise(F.coalesce(last + buffer, F.least(F.lit(buffer - 1), n - 1)))


def repair(matrix: Column, cfg: TokenConfig = CFG) -> Column:
    """Audio ids outside the codebook become 0; the text row stays."""
    return F.transform(matrix, lambda row, i: F.when(i == 0, row).otherwise(F.transform(row, lambda x: F.when((x < 0) | (x >= cfg.audio_initial), 0).otherwise(x))))


def swap_halves(matrix: Column) -> Column:
    """The second half of the rows before the first."""
    half = (F.size(matrix) / 2).cast("int")
    return F.concat(F.slice(matrix, half + 1, F.size(matrix) - half), F.slice(matrix, 1, half))


def drop_row(matrix: Column, at: int) -> Column:
    """The matrix without row ``at`` (from 0)."""
    return F.filter(matrix, lambda _r, i: i != at)


def digest(row: Column) -> Column:
    """A row as text digest, alike in any engine: md5 of its ids joined by commas."""
    return F.md5(F.array_join(F.transform(row, lambda x: x.cast("string")), ","))


def linspace_positions(n: Column, span: Column) -> Column:
    """``n`` frame positions spread evenly over ``0..span-1``, rounded down; the last is ``span - 1``."""
    step = (span - 1) / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i == n - 1) & (n > 1), span - 1).otherwise(F.floor(i * step)).cast("int"))


def float_frame(seconds: Column, rate: float = CFG.frame_rate) -> Column:
    """The frame of a time by floor division of doubles (0.24 s at 80 ms is frame 2, not 3)."""
    width = F.lit(1.0 / rate)
    return F.rint((seconds - seconds % width) / width).cast("bigint")


def chat_ids(texts: Column, encode, main_first: bool = True, cfg: TokenConfig = TokenConfig()) -> Column:
    """Ids of a chat's texts in order: the speakers' markers in turn, each before the ids of its normalised sentence. Null texts count as empty."""
    from turnweave.functions.text import chat_sentence

    first, second = (cfg.main_bos, cfg.other_bos) if main_first else (cfg.other_bos, cfg.main_bos)
    marker = lambda i: F.when(i % 2 == 0, first).otherwise(second)
    return F.flatten(F.transform(texts, lambda t, i: F.concat(F.array(marker(i)), encode(chat_sentence(F.coalesce(t, F.lit("")))))))


def text_block(text: Column, encode, most: int | None, separator: str = "\n---\n", bos: int = 1, delimiter: int = 2) -> tuple[Column, Column]:
    """(ids, prompt length) of a text in lower case: first id, prompt, delimiter, body where it holds the separator; else first id and text, and length 0.

    Both are cut at ``most`` ids (None: not at all).
    """
    from turnweave.functions.text import split_prompt

    prompt, body = split_prompt(text, separator)
    p = encode(prompt)
    has = F.locate(separator, text) > 0
    ids = F.when(has, F.concat(F.array(F.lit(bos)), p, F.array(F.lit(delimiter)), encode(body))).otherwise(F.concat(F.array(F.lit(bos)), encode(body)))
    length = F.when(has, F.size(p) + 2).otherwise(0)
    return (ids, length) if most is None else (F.slice(ids, 1, most), F.least(length, F.lit(most)))
