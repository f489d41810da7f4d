import random

import pytest

from turnweave.llm import turns

FILLERS = {"en": ["um", "er", "hmm", "mm"], "ja": ["えー", "えっと", "うーん"], "ru": ["ээ"]}


@pytest.mark.parametrize(
    "form,lang,speech",
    [
        ("hello", "en", True), ("um", "en", False), ("UMMM", "en", False), ("hm", "en", True), ("hmm--", "en", False), ("er", "de", True), ("-um-", "en", False),
        ("えーー", "ja", False), ("え", "ja", True), ("ええ", "ja", True), ("うん", "ja", True), ("えっとー", "ja", False), ("эээ", "ru", False),
        ("[door closes]", "en", False), ("((noise))", "en", False), ("*sigh*", "en", False), ("【咳】", "ja", False), ("keeps[sigh]", "en", True), ("6137[[lachen]]", "de", True),
        ("[door", "en", False), ("closes]", "en", False), ("00:00:07,741", "en", False), ("(1:40)", "en", False), ("@0:03", "en", False), ("<9.14>", "en", False), ("[2.9s]", "ru", False),
        ("4489", "en", True), ("—", "en", False), ("", "en", False), ("♪", "en", False), ("¿quieres", "es", True), ("can't", "en", True),
    ],
)
def test_what_is_speech(form, lang, speech):
    forms = FILLERS.get(lang)
    assert turns.is_speech(form, turns.filler_pattern(forms) if forms else None) is speech


def _brute(rows, pause_ms=None):
    seen, out = {}, []
    for i, d, s, w, a, b in sorted(rows):
        if s in "AB" and b > a:
            seen.setdefault((d, s, round(a * 1000), round(b * 1000), (w or "").strip()), i)
    kept = sorted((d, a, i, s, b) for (d, s, a, b, w), i in seen.items() if turns.is_speech(w, turns.filler_pattern(FILLERS["en"])))
    for d, a, i, s, b in kept:
        if out and out[-1][:2] == [d, s] and (pause_ms is None or a - out[-1][4] <= pause_ms):
            out[-1][3], out[-1][4] = i, max(out[-1][4], b)
        else:
            out.append([d, s, i, i, b])
    return {tuple(r[:4]) for r in out}


@pytest.mark.parametrize("block_ms,span,pause", [(600_000, 256, None), (700, 2, None), (1_500, 3, None), (900, 2, 400), (10**8, 2, 400)])
def test_blocks_are_stitched(spark, transcripts, block_ms, span, pause):
    rng, rows = random.Random(5), []
    for k in range(600):
        a = round(rng.uniform(0, 60), 1)
        rows.append((k, rng.choice("xyz"), rng.choice("AAAB"), rng.choice(["hi", "um", "go ", "[noise]", None, "7"]), a, round(a + rng.choice([-0.2, 0.0, 0.3, 2.0]), 1)))
    rows += [(1000 + r[0], *r[1:]) for r in rows[:50]]
    out = turns.speaker_turns(*transcripts(rows), FILLERS, pauses=None if pause is None else {None: pause}, block_ms=block_ms, span=span).collect()
    found = {(r.dialogue_id, r.channel, r.first_row_id, r.last_row_id) for r in out}
    assert found == _brute(rows, pause) and len(out) == len(found)


def test_each_block_has_its_language(spark, transcripts):
    from turnweave.llm import words as W

    rows = [(1, "r", "A", "cop", 0.0, 1.0), (2, "r", "B", "x", 700.0, 701.0), (3, "e", "A", "cop", 1.0, 2.0), (4, None, "A", "no", 1.0, 2.0), (5, "r", "A", "no", 590.0, None)]
    tables = transcripts(rows, {"r": "ru"})
    for halo in (0, 50_000):
        found = [(r.dialogue_id, r.block, r.row_id, r.lang, r.own) for r in W.blocked(*tables, halo_ms=halo).collect()]
        assert {(d, b, lang) for d, b, i, lang, _ in found if i is None} == {("r", 0, "ru"), ("r", 1, "ru"), ("e", 0, "en")}
        assert {(d, b, i) for d, b, i, _, own in found if own} == {("r", 0, 1), ("r", 1, 2), ("e", 0, 3), (None, 0, 4)}


def _times(text, at=0.0, step=0.2, row=0, channel="A"):
    return [(row + k, "d", channel, w, round(at + k * step, 3), round(at + k * step + step, 3)) for k, w in enumerate(text.split())]


def _said(spark, transcripts, rows, **options):
    found = turns.speaker_turns(*transcripts(rows), FILLERS, **options).collect()
    return " | ".join(r.text for r in sorted(found, key=lambda r: r.first_ms))


ROLLING = [
    ("red house fell", 0.64, "the red house fell"),  # rolls on 40 ms behind
    ("red house fell", 0.24, "the red house fell"),  # rolls on while it still stands
    ("the red house fell", 0.61, "the red house fell"),
    ("Red HOUSE fell", 0.64, "the red house fell"),
    ("house fell", 0.64, "the red house house fell"),  # one word may be said twice
    ("red house fell", 20.0, "the red house red house fell"),  # said again much later
    ("blue house fell", 0.64, "the red house blue house fell"),
]


@pytest.mark.parametrize("block_ms", [600_000, 700])
def test_rolling_captions(spark, transcripts, block_ms):
    rows = [(100 * k + i, f"d{k}", c, w, s, e) for k, (second, at, _) in enumerate(ROLLING) for i, _, c, w, s, e in _times("the red house") + _times(second, at, row=10)]
    found = turns.speaker_turns(*transcripts(rows), FILLERS, rolling_ms=10_000, block_ms=block_ms).collect()
    assert {r.dialogue_id: r.text for r in found} == {f"d{k}": kept for k, (_, _, kept) in enumerate(ROLLING)}


def test_rolling_captions_keep_natural_repetition(spark, transcripts):
    rows = _times("no no no no well") + _times("no no", 5.0, row=20, channel="B")
    assert _said(spark, transcripts, rows, rolling_ms=10_000) == "no no no no well | no no"


def _brute_rolled(words, tolerance):
    out = set()
    for c in {w[2] for w in words}:
        seq = [w for w in words if w[2] == c]
        for b in range(1, len(seq)):
            for n in range(1, min(b, len(seq) - b) + 1):
                first, second = seq[b - n : b], seq[b : b + n]
                if n > 1 and [w[3] for w in first] == [w[3] for w in second] and len({w[3] for w in first}) > 1 and second[-1][0] - first[0][0] <= tolerance:
                    out |= {w[4] for w in second}
            out |= {seq[b][4] for w in seq[:b] if w[3] == seq[b][3] and seq[b][3] and seq[b][0] < w[1] and seq[b][0] - w[0] <= tolerance}
    return out


def test_rolling_captions_against_brute_force():
    from turnweave.llm.words import rolled_on

    rng = random.Random(11)
    for _ in range(150):
        words, t = [], 0
        for i in range(40):
            t += rng.choice([0, 50, 200, 900])
            words.append((t, t + rng.choice([100, 300]), rng.choice("AB"), rng.choice(["x", "y", "z", ""]), i))
        rows = [(s, e, i, c, w, "en", True) for s, e, c, w, i in words]
        assert {r[2] for r, again in zip(rows, rolled_on(rows, 3_000)) if again} == _brute_rolled(words, 3_000)


def test_pauses_are_calibrated_per_language(spark, transcripts):
    rows = [(k, "d", "A", "w", k * 1.0, k * 1.0 + 0.5) for k in range(200)] + [(1_000 + k, "r", "A", "w", k * 3.0, k * 3.0 + 1.0) for k in range(100)]
    found = {r.lang: r.pause_ms for r in turns.calibrated_pauses(*transcripts(rows, {"r": "ru"})).collect()}
    assert found == {"en": 500, "ru": 2_000, None: 2_000}
    rows = _times("a b") + _times("c", 1.0, row=5)
    assert _said(spark, transcripts, rows, pauses={None: 500}) == "a b | c" and _said(spark, transcripts, rows, pauses={"en": 700, None: 0}) == "a b c"


def test_odd_rows(spark, transcripts):
    rows = [(1, "d", "S 1", "один", 0.0, 1.0), (2, "d", "A/B", "no", 1.0, 2.0), (3, "d", None, "no", 1.0, 2.0), (4, "d", "**ch_2**", "x" * 10_000, None, 2.0), (5, None, "A", "hi", 0.0, 1.0), (6, "d", "В:", "yes", 0.0, float("nan"))]
    words, roles, dialogues = transcripts(rows, {"d": "ru"})
    out = turns.speaker_turns(words, roles, dialogues, FILLERS).collect()
    assert {(r.dialogue_id, r.channel, r.text) for r in out} == {("d", "A", "один"), (None, "A", "hi")}
    assert turns.speaker_turns(words.limit(0), roles, dialogues, {}).count() == 0
    assert turns.filler_forms(spark.createDataFrame([("um", "en"), (None, "en")], "form string, lang string")) == {"en": ["um"]}
