import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnweave.llm import bpe

PATH = f"{bpe.VOCABULARIES}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return bpe.Encoder(bpe.Vocabulary.load(PATH)), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "a" * 3000, "aaa aaaa aaaaa", "<|endoftext|>", "\n\n \t x  y", "　" * 99, "é" * 500, "😀😀 'll can't", "電話をかけてもらえますか。", "0123 4567", "\x00\x01"]


def test_texts(both):
    ours, theirs = both
    assert ours.encode([*TEXTS, None]).to_pylist() == [theirs.encode_ordinary(t) for t in TEXTS] + [[]]
    assert ours.encode([]).to_pylist() == [] and ours.encode([None, ""]).to_pylist() == [[], []]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab ba'\n1é"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any_text(both, texts):
    ours, theirs = both
    assert ours.encode(texts).to_pylist() == [theirs.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab '1\n　é", max_size=200), st.integers(1, 20))
def test_stretches_split_alike(both, text, size):
    stretches = list(bpe.segments(text, size))
    assert "".join(stretches) == text
    assert [w for s in stretches for w in both[0].split(s)] == both[0].split(text)


def test_documents(spark, both):
    rows = [(k, t, "x", [1]) for k, t in enumerate(TEXTS)] + [(99, None, "x", None), (0, "again", "x", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids array<int>")
    found = [(r.doc_id, r.ids) for r in bpe.encode_documents(documents).collect()]
    assert sorted(found) == sorted((k, both[1].encode_ordinary(t) if t else []) for k, t, *_ in rows)
    assert bpe.encode_documents(documents.limit(0)).count() == 0
