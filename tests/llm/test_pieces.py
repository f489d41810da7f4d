import random

from turnweave.llm import pieces


def _dialogue(name, n, seed, row=0):
    rng, rows, t = random.Random(seed), [], 0.0
    for k in range(n):
        t += rng.choice([0.0, 0.1, 0.2, 0.9, 3.0, 0.0, 0.0])
        length = rng.choice([0.2, 0.4, 1.1, 0.3])
        rows.append((row + k, name, rng.choice(["A", "A", "A", "B"]), "w" * rng.randint(1, 12), round(t, 3), round(t + length, 3)))
        t += length * 0.8
    return rows


def _check(found, rows, max_ms, max_chars):
    by = {}
    for r in found:
        by.setdefault(r.dialogue_id, []).append(r)
    for name, parts in by.items():
        parts.sort(key=lambda r: r.piece)
        words = sorted((round(s * 1000), i, w, round(e * 1000)) for i, d, _, w, s, e in rows if d == name)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert parts[0].word_offset == 0 and parts[0].char_offset == 0
        at = {i: k for k, (_, i, _, _) in enumerate(words)}
        for p, q in zip(parts, parts[1:]):
            assert at[q.new_row_id] == at[p.last_row_id] + 1 == q.word_offset
            assert q.char_offset == p.char_offset + p.new_chars
            cut = words[at[p.last_row_id]][3]
            repeated = [w for w in words[at[q.first_row_id] : at[q.new_row_id]]]
            assert all(w[0] >= cut - 3000 for w in repeated)
        assert parts[-1].word_offset + (at[parts[-1].last_row_id] - at[parts[-1].new_row_id] + 1) == len(words)
        for p in parts:
            span = words[at[p.first_row_id] : at[p.last_row_id] + 1]
            assert p.text == " ".join(w[2] for w in span) and p.n_words == len(span)
            if len(span) > 1:
                assert max(w[3] for w in span) - span[0][0] <= max_ms and sum(len(w[2]) for w in span) <= max_chars


def test_limits_offsets_and_stitching(spark, transcripts):
    rows = _dialogue("a", 700, 1) + _dialogue("b", 40, 2, 10_000) + _dialogue("c", 900, 3, 20_000)
    tables = transcripts(rows)
    whole = pieces.split_transcripts(*tables, range_ms=10**9).collect()
    _check(whole, rows, 50_000, 600)
    for width, span in ((53_000, 2), (61_000, 64), (61_000, 3), (200_000, 1)):
        assert {tuple(r) for r in pieces.split_transcripts(*tables, range_ms=width, span=span).collect()} == {tuple(r) for r in whole}


def test_holes_between_ranges_and_spans(spark, transcripts):
    rows = _dialogue("a", 60, 4) + [(900 + i, d, c, w, s + 700.0, e + 700.0) for i, d, c, w, s, e in _dialogue("a", 60, 5)] + [(2_000, "a", "B", "end", 3_000.0, 3_001.0)]
    tables = transcripts(rows)
    whole = pieces.split_transcripts(*tables, range_ms=10**9).collect()
    _check(whole, rows, 50_000, 600)
    for width, span in ((60_000, 2), (51_000, 7)):
        assert {tuple(r) for r in pieces.split_transcripts(*tables, range_ms=width, span=span).collect()} == {tuple(r) for r in whole}


def test_only_numbers_of_ranges_gather_by_dialogue(spark, transcripts):
    plan = pieces.split_transcripts(*transcripts(_dialogue("a", 30, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 4  # composed, followed twice, emitted; the ranges are written before


def test_single_words_beyond_a_limit_and_odd_rows(spark, transcripts):
    rows = [
        (1, "d", "A", "a", 0.0, 1.0), (2, "d", "A", "x" * 700, 1.0, 2.0), (3, "d", "B", "b", 2.0, 3.0), (4, "d", "A", "long", 3.0, 70.0),
        (5, "d", "B", None, 4.0, 5.0), (6, "d", "B", "c", 4.0, 5.0), (7, "d", "A", "no", 9.0, 9.0), (8, "d", "?", "no", 9.0, 10.0), (9, "d", "Ａ:", "a", 0.0, 1.0), (10, "e", "A", "late", 500_000.0, 500_001.0),
    ]
    found = sorted(map(tuple, pieces.split_transcripts(*transcripts(rows)).select("dialogue_id", "piece", "n_words", "n_chars", "cut").collect()))
    assert found == [("d", 0, 1, 1, "limit"), ("d", 1, 1, 700, "word"), ("d", 2, 1, 1, "turn"), ("d", 3, 1, 4, "word"), ("d", 4, 2, 1, "pause"), ("e", 0, 1, 4, "pause")]
    over = pieces.oversized(pieces.split_transcripts(*transcripts(rows))).collect()
    assert [r.dialogue_id for r in over] == ["d"]
    words, roles, dialogues = transcripts(rows)
    assert pieces.split_transcripts(words.limit(0), roles, dialogues).count() == 0
