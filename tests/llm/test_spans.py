import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnweave.llm import spans
from turnweave.llm.fm import FMIndex, agreeing, suffix_order


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.integers(1, 6))
def test_index_counts_and_places(text, length):
    codes = np.array(text, dtype=np.int64)
    assert suffix_order(codes).tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    index = FMIndex(codes, 6)
    ends = np.arange(length, len(text) + 1)
    if not len(ends):
        return
    low, high = index.search(codes, ends, length)
    for e, a, b in zip(ends, low, high):
        want = [k for k in range(len(text) - length + 1) if text[k : k + length] == text[e - length : e]]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=2, max_size=40), st.data())
def test_common_stretches(text, data):
    codes = np.array(text, dtype=np.int64)
    places = st.lists(st.integers(0, len(text) - 1), min_size=2, max_size=2, unique=True)
    x, y = (np.array([k]) for k in data.draw(places))
    after = next(k for k in range(len(text) + 1) if max(x[0], y[0]) + k >= len(text) or text[x[0] + k] != text[y[0] + k])
    before = next(k for k in range(len(text) + 1) if min(x[0], y[0]) - k <= 0 or text[x[0] - k - 1] != text[y[0] - k - 1])
    assert agreeing(codes, x, y, len(text) - np.maximum(x, y), False, 4)[0] == after
    assert agreeing(codes, x, y, np.minimum(x, y), True, 4)[0] == before


def test_anchors_of_long_inputs_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    codes = rng.integers(97, 100, 5_000).astype(np.uint32)
    owner = np.sort(rng.integers(0, 9, 5_000))
    whole = spans._anchors_of(codes, owner, 120, 60)
    for segment in (130, 500, 4_990):
        cut = spans.anchors_of(codes, owner, 120, 60, segment)
        assert len(whole[0]) and whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def _docs(rng):
    make = lambda n: "".join(rng.choice("abcdefgh 漢字\n") for _ in range(n))
    shared = [make(n) for n in (119, 120, 121, 150, 400)]
    docs = [(k, make(rng.randint(0, 300)) + rng.choice(shared) + make(rng.randint(0, 300))) for k in range(40)]
    docs += [(40, docs[0][1]), (41, docs[0][1]), (42, None), (43, ""), (44, "x" * 130), (45, "y" + "x" * 125), (46, "\x00" * 121 + "q"), (47, "p" + "\x00" * 121), (48, shared[4] + "|" + shared[4])]
    return docs


def _brute(docs, least):
    grams = {d: {t[k : k + least] for k in range(len(t) - least + 1)} for d, t in docs if t}
    return {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if grams[a] & grams[b]}


def _cover(rows):
    cover = {}
    for r in rows:
        cover.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return cover


@pytest.mark.parametrize("hot,block", [(None, 1_500), (1, 3)])
def test_pairs_and_spans(spark, hot, block):
    docs = _docs(random.Random(8))
    documents = spark.createDataFrame([(d, t, "x") for d, t in [*docs, (None, docs[0][1])]], "doc_id long, text string, anchor string")
    want = _brute(docs, 120)
    members = spans.members(documents, hot_docs=hot)
    found = spans.sharing_pairs(documents, block=block, found=members).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    rows = spans.shared_spans(documents, found=members).collect()
    cover = _cover(rows)
    texts = {d: t for d, t in docs if t}
    for d, t in texts.items():
        expected = set()
        for k in range(len(t) - 119):
            if any(t[k : k + 120] in u for e, u in texts.items() if e != d):
                expected.update(range(k, k + 120))
        assert cover.get(d, set()) == expected
    names, holders = {}, {}
    for r in rows:
        piece = texts[r.doc_id][r.start : r.end]
        assert len(piece) >= 120 and names.setdefault(r.span, piece) == piece
        holders.setdefault(r.span, set()).add(r.doc_id)
    assert all(len(h) > 1 for h in holders.values())


def test_nothing_comes_without_the_index(spark, monkeypatch):
    docs = _docs(random.Random(8))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(spans.FMIndex, "search", lambda self, symbols, ends, length, least=1: (np.zeros(len(ends), dtype=np.int64),) * 2)
    members = spans.members(documents)
    assert members.count() > 50 and spans.sharing_pairs(documents, found=members).count() == 0 and spans.shared_spans(documents, found=members).count() == 0


def test_boilerplate_and_periodic_texts_stay_linear(spark):
    """A page footer in thousands of documents and a text of one repeated pattern: rows follow documents, not their pairs or places."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    footer = word(150)
    docs = [(k, word(40) + footer + word(40)) for k in range(2_000)]
    docs += [(5_000 + k, "ab" * 500_000) for k in range(2)] + [(6_000, "ab" * 70)]
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    members = spans.members(documents)
    assert members.count() < 2_000 * 200
    groups = spans.classes(members).groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert groups < 1_600
    cover = _cover(spans.shared_spans(documents, found=members).where("doc_id < 2000 or doc_id = 6000").collect())
    assert all(set(range(40, 190)) <= cover[k] for k in range(2_000)) and cover[6_000] == set(range(140))
    pairs = spans.sharing_pairs(documents, found=members.where("doc_id >= 5000")).collect()
    assert {tuple(r) for r in pairs} == {(5_000, 5_001), (5_000, 6_000), (5_001, 6_000)}


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    assert spans.sharing_pairs(documents).count() == 0 and spans.shared_spans(documents).count() == 0
