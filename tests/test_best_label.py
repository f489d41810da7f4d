"""The best label by Jaccard: the two ways to count, sets from texts, and the memory its workers need."""

import random
import re
import threading
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from turnweave.functions import text as T
from turnweave.operators import corpus as C
from turnweave.plans.corpus import set04_best_topic


def _best(rows):
    sets = defaultdict(set)
    for _, label, items in rows:
        if label is not None:
            sets[label] |= items
    scored = {i: [(-len(items & s) / (len(items) + len(s) - len(items & s) + 1e-9), label) for label, s in sets.items() if items & s] for i, _, items in rows}
    return {i: (min(x)[1], -min(x)[0]) for i, x in scored.items() if x}


def _grams(text):
    bare = "".join(c for c in text or "" if ord(c) not in T._SPACE_CODES)
    return {bare[k : k + 2] for k in range(len(bare) - 1)} or ({bare} if bare else set())


def test_sets_from_texts():
    texts = [None, "", " 　\n", "a", "\0a", "a b\tab", "😀", "😀😀  😀é", "日本語の日本", "\U0010ffff\U0010ffff"]
    row, item, codes = T.bigram_pairs(pa.array(texts))
    pairs = sorted(zip(row.tolist(), codes.take(pa.array(item)).to_pylist()))
    word = lambda c: chr(c & 0x1FFFFF) if c >> 21 == 0x1FFFFF else chr(c >> 21) + chr(c & 0x1FFFFF)
    assert len(pairs) == len(set(pairs))
    assert {(r, word(c)) for r, c in pairs} == {(r, g) for r, t in enumerate(texts) for g in _grams(t)}
    assert [len(x) for x in T.bigram_pairs(pa.array([None, ""], pa.string()))] == [0, 0, 0]


def test_both_ways_against_brute_force(spark):
    rng = random.Random(7)
    labels = [*(f"l{k}" for k in range(9)), "Ａ", "ß", None]
    texts = [(i, rng.choice(labels), "".join(rng.choice("abcde 　あい😀") for _ in range(rng.choice([0, 1, 2, 9, 60])))) for i in range(400)] + [(400, "l0", None)]
    want = _best([(i, label, _grams(t)) for i, label, t in texts])
    df = spark.createDataFrame(texts, "i long, label string, t string").repartition(5)
    for held in (None, 0):
        found = C.best_by_jaccard(df, "i", "label", "t", of=T.bigram_pairs, held=held).collect()
        assert {r.i: (r.label, r.score) for r in found} == want and len(found) == len(want)
    arrays = [(i, label, sorted(_grams(t)) if t is not None else None) for i, label, t in texts]
    df = spark.createDataFrame(arrays, "i long, label string, g array<string>").repartition(3)
    for held in (None, 0):
        assert {r.i: (r.label, r.score) for r in C.best_by_jaccard(df, "i", "label", "g", held=held).collect()} == want
    assert C.best_by_jaccard(df.withColumn("label", F.lit(None).cast("string")), "i", "label", "g").collect() == []
    assert C.best_by_jaccard(df.where("false"), "i", "label", "g").collect() == []


def _worker_mb():
    most = 0
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                most = max(most, int(re.search(r"VmRSS:\s+(\d+)", (p / "status").read_text())[1]) // 1024)
        except (OSError, TypeError):
            pass
    return most


def test_workers_hold_little_of_a_batch(spark, tmp_path):
    """A batch of 10,000 texts of 1,000 characters, nearly all of whose 2-grams differ: 10 million strings if sets are made of them."""
    rng = random.Random(3)
    letters = [chr(0x4E00 + k) for k in range(120)]
    texts = ["".join(rng.choices(letters, k=1_000)) for _ in range(10_000)]
    pq.write_table(pa.table({"doc_id": range(10_000), "text": texts, "source": [f"s{k % 20}" for k in range(10_000)]}), tmp_path / "documents.parquet")
    seen, done = [], threading.Event()
    watch = threading.Thread(target=lambda: [seen.append(_worker_mb()) for _ in iter(lambda: done.wait(0.05), True)])
    watch.start()
    try:
        assert set04_best_topic(spark, str(tmp_path)).count() == 10_000
    finally:
        done.set()
        watch.join()
    assert 0 < max(seen) < 600
