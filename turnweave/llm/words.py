"""What the transcript operators share: usable rows of a dialogue in blocks of time, each delivered once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.labels import to_ms, usable
from turnweave.llm.forms import Forms, languages

#: Width of a block of a dialogue. A dialogue of any length is spread over its blocks.
BLOCK_MS = 600_000
KEYS, ORDER = ["dialogue_id", "block"], ["start_ms", "row_id"]


def _placed(rows: DataFrame, block_ms: int, halo_ms: int) -> DataFrame:
    """Rows with ``start_ms`` in their block, and with a halo in the neighbours it reaches into."""
    start = F.col("start_ms")
    if not halo_ms:
        return rows.withColumn("block", F.floor(start / block_ms))
    first = F.greatest(F.floor((start - halo_ms) / block_ms), F.when(start >= 0, 0))
    return rows.withColumn("block", F.explode(F.sequence(first, F.floor((start + halo_ms) / block_ms))))


def blocked(words: DataFrame, roles: DataFrame, dialogues: DataFrame, block_ms: int = BLOCK_MS, halo_ms: int = 0) -> DataFrame:
    """Usable rows with their block and the row of their dialogue's language, in the column order the kernels read.

    With a halo, rows within ``halo_ms`` of a neighbouring block stand in that block too, ``own`` false.
    The language costs no shuffle of the words and no broadcast of the dialogues: each block gets one
    more row with the language, without a start, and the one shuffle into blocks brings both together.
    """
    rows = words.select("row_id", "dialogue_id", "speaker", "word", "start", "end")
    body = _placed(usable(rows, roles), block_ms, halo_ms)
    own = F.floor(F.col("start_ms") / block_ms) == F.col("block")
    columns = ["dialogue_id", "block", "start_ms", "end_ms", "row_id", "channel", "word"]
    starts = words.select("dialogue_id", to_ms(F.col("start")).alias("start_ms")).where("start_ms IS NOT NULL")
    # A block's halo reaches into blocks that have words of their own or gives them nothing to emit.
    blocks = _placed(starts, block_ms, 0).select("dialogue_id", "block").distinct()
    empty = {c: F.lit(None).cast(body.schema[c].dataType).alias(c) for c in columns[2:]}
    heads = blocks.join(languages(dialogues), "dialogue_id").select("dialogue_id", "block", *empty.values(), F.col("_lang").alias("lang"), F.lit(False).alias("own"))
    return body.select(*columns, F.lit(None).cast("string").alias("lang"), own.alias("own")).unionByName(heads)


def delivered_once(table: pa.Table, forms: Forms) -> Iterator[tuple]:
    """Rows (start, end, row id, channel, form without outer spaces, language, own) of a block in order.

    Of rows alike in channel, times and word only the one with the smallest row id comes out; the
    sort by start and row id makes that the first one met.
    """
    _, _, starts, ends, ids, channels, words, langs, own = (c.to_pylist() for c in table.columns)
    at, seen, spoken = None, set(), None
    for start, end, row_id, channel, word, lang, mine in zip(starts, ends, ids, channels, words, langs, own):
        if start is None:  # the block's language, first as it has no start
            spoken = lang
            continue
        form = (forms(word, spoken) or "").strip(" ")
        if start != at:
            at = start
            seen.clear()
        key = (end, channel, form)
        if key not in seen:
            seen.add(key)
            yield start, end, row_id, channel, form, spoken, mine


def rolled_on(rows: list[tuple], tolerance_ms: int, least: int = 2) -> list[bool]:
    """Which of a block's rows (as ``delivered_once`` gives them) repeat what their channel has just delivered.

    A caption that rolls on begins with the end of the one before. In a channel's words that is a suffix
    of what stands that equals the prefix of what follows, word by word in consistent form (case aside),
    with times of its own: the repeated words are ``least`` or more, not all alike ("no no"), and all of
    both lies within ``tolerance_ms``. A single word is a repeat only if it overlaps in time with an equal
    one of its channel. The verdict on a word depends on the rows within the tolerance alone, so blocks
    with a halo of that length give the same as the whole dialogue.
    """
    out = [False] * len(rows)
    for channel in {r[3] for r in rows}:
        at = [k for k, r in enumerate(rows) if r[3] == channel]
        forms = [rows[k][4].lower() for k in at]
        starts, ends = [rows[k][0] for k in at], [rows[k][1] for k in at]
        last: dict[str, list[int]] = {}
        total = len(at)
        for i, form in enumerate(forms):
            places = last.get(form)
            if places is None:
                last[form] = [i]
                continue
            start = starts[i]
            if start - starts[places[0]] > tolerance_ms:
                places[:] = [j for j in places if start - starts[j] <= tolerance_ms]
            for j in places:
                if start < ends[j] and form:
                    out[at[i]] = True
                # Words j..i-1 stand; do the next ones repeat them? The second word tells most apart.
                n = i - j
                if n >= least and i + n <= total and (n < 2 or forms[j + 1] == forms[i + 1]) and starts[i + n - 1] - starts[j] <= tolerance_ms and forms[j:i] == forms[i : i + n] and len(set(forms[j:i])) > 1:
                    for x in at[i : i + n]:
                        out[x] = True
            places.append(i)
    return out
