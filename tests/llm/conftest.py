import datetime as dt

import pytest

WORDS = "row_id long, dialogue_id string, speaker string, word string, start double, end double, ingested_at timestamp_ntz, extra string"


@pytest.fixture(scope="session")
def transcripts(spark):
    """Builds (words, roles, dialogues) from short tuples (row_id, dialogue, speaker, word, start, end)."""

    def build(rows, langs=None):
        langs = langs or {}
        names = sorted({r[1] for r in rows if r[1] is not None} | set(langs))
        words = spark.createDataFrame([(*r, None, "x") for r in rows], WORDS)
        roles = spark.createDataFrame([("A", "A"), ("B", "B"), ("S1", "A"), ("ch_2", "B")], "role string, channel string")
        at = dt.datetime(2025, 1, 1)
        dialogues = spark.createDataFrame(
            [(n, langs.get(n, "en"), at, "clash") for n in names] * 2 or [], "dialogue_id string, lang string, delivered_at timestamp_ntz, word string"
        )
        return words, roles, dialogues

    return build
