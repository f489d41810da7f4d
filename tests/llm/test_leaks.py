import random

from turnweave.llm import leaks


def _brute(docs, items, least):
    out = set()
    for i, it in items:
        r = leaks.reduce_text(it or "")
        grams = {r[k : k + least] for k in range(len(r) - least + 1)}
        for d, t in docs:
            s = leaks.reduce_text(t or "")
            if any(s[k : k + least] in grams for k in range(len(s) - least + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeа漢é1") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(12)]
    items += [(12, items[0][1]), (13, "short"), (14, None), (15, ""), (16, "ab" * 200)]
    docs = []
    for d in range(80):
        source = leaks.reduce_text(items[rng.randrange(12)][1])
        n = rng.choice([57, 58, 59, 60, 61, 62, 80, 120])
        a = rng.randrange(max(1, len(source) - n))
        passage = source[a : a + n]
        if rng.random() < 0.5:
            passage = "-".join(passage).upper()
        docs.append((d, " ".join(word() for _ in range(rng.randint(0, 30))) + " " + passage + " " + word()))
    docs += [(80, None), (81, ""), (82, "ab" * 500), (83, items[3][1]), (84, items[3][1])]
    documents = spark.createDataFrame([(d, t, "x") for d, t in [*docs, (None, docs[0][1])]], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in [*items, (None, items[0][1])]], "item_id long, text string, doc_id string")
    want = _brute(docs, items, 60)
    assert len(want) > 20
    found = leaks.leaked_items(leaks.leaked_passages(documents, benchmark)).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    monkeypatch.setattr(leaks, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(leaks, "SEGMENT", 100)
    assert {tuple(r) for r in leaks.leaked_items(leaks.leaked_passages(documents, benchmark)).collect()} == want
    assert leaks.leaked_passages(documents.limit(0), benchmark).count() == 0
    assert leaks.leaked_passages(documents, benchmark.limit(0)).count() == 0
    index = leaks.build_index(documents)
    postings = {(t, d, p) for t, ds, ps in map(tuple, index.collect()) for d, p in zip(ds, ps)}
    assert len(postings) == sum(len(r) // 20 for _, t in docs if len(r := leaks.reduce_text(t or "")) >= 60)  # every token of every document
    assert {tuple(r) for r in leaks.leaked_items(leaks.leaked_passages(documents, benchmark, index=index)).collect()} == want


def test_proximity_against_brute_force(spark):
    rng = random.Random(9)
    item = "".join(rng.choice("abcdefgh") for _ in range(300))
    docs = []
    for d in range(30):
        # Tokens of the item, aligned to the document's tokens, between others.
        parts = [item[k : k + 20] if rng.random() < 0.3 else "".join(rng.choice("xyz") for _ in range(20)) for k in [rng.randrange(280) for _ in range(60)]]
        docs.append((d, "".join(parts)))
    docs += [(30, None), (31, ""), (32, "short")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "ab", "x")], "item_id long, text string, doc_id string")
    want = {}
    terms = {item[k : k + 20] for k in range(281)}
    for d, t in docs:
        places = [p for p in range(0, len(t or "") - 19, 20) if len(t) >= 60 and t[p : p + 20] in terms]
        sizes = [(len({t[q : q + 20] for q in places if p <= q <= p + 380}), -p) for p in places]
        if sizes and max(sizes)[0] >= 3:
            want[d] = (1, max(sizes)[0], -max(sizes)[1])
    found = {r.doc_id: (r.item_id, r.n_near, r.start) for r in leaks.proximity(leaks.build_index(documents), items).collect()}
    assert found == want and len(want) > 10
