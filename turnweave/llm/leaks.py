"""Evaluation texts leaking into training text (problem 8): a distributed positional inverted index.

Both sides are reduced to letters and digits. Documents are cut into tokens of ``gram`` characters that
lie end to end, and the index holds, for every token of every document, the documents and positions
where it stands. It is written once, in segments: each holds the lists of about a million characters
of text, by term, so building it moves nothing, no list is longer than its segment, and any set of test
items can be asked of it (``build_index``, ``leaked_passages(index=...)``).

A shared passage of ``least`` characters covers at least two neighbouring tokens of the document in
full, at some offset of the item. So each item is a set of phrases of two terms, one per offset; a
phrase is answered from the list of its rarer term, shifted by the offset, and intersected with the
other list at the neighbouring position. What remains is a candidate with a fixed diagonal, which the
characters of the document decide exactly. Proximity matches need no phrase: tokens of one item that
stand near each other in a document, in any order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.session import checkpointed

LEAST, GRAM = 60, 20
#: Characters of a segment of the index.
SEGMENT = 1_000_000
#: Parts that the postings of a term are dealt into where they meet the items.
SALTS = 16
#: Documents with candidates up to which their list is broadcast to the texts (24 bytes each); beyond that both are shuffled.
BROADCAST_DOCS = 200_000

_OTHER = re.compile(r"[\W_]+")


def reduce_text(text: str) -> str:
    """Letters and digits alone: compatibility forms replaced, lower case, everything else removed."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each window of ``gram`` codes, from hashes of windows of doubling width."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    level, width, out, done = _mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, None, 0
    while True:
        if gram & width:
            part = level[done : done + n]
            out = part if out is None else _mixed(out * np.uint64(0xD6E8FEB86659FD93) + part)
            done += width
        if done == gram:
            return out
        level = _mixed(level[:-width] * np.uint64(0xA24BAED4963EE407) + level[width:])
        width *= 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


_LISTS = pa.schema([("term", pa.int64()), ("docs", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])
_LISTS_DDL = "term bigint, docs array<bigint>, positions array<bigint>"


def _reduced(ids: list, texts: list, least: int) -> tuple[list, list]:
    pairs = [(i, reduce_text(t)) for i, t in zip(ids, texts) if t]
    pairs = [(i, t) for i, t in pairs if len(t) >= least]
    return [i for i, _ in pairs], [t for _, t in pairs]


def build_index(documents: DataFrame, gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """The positional inverted index of all documents in segments: term, documents, positions (lists side by side).

    Rows without an id, null texts and texts under ``least`` reduced characters have no postings.
    """
    segment = SEGMENT - SEGMENT % gram

    def lists(terms: list, docs: list, positions: list) -> pa.RecordBatch:
        term, doc, pos = (np.concatenate(x) for x in (terms, docs, positions))
        order = np.lexsort((pos, doc, term))
        term, doc, pos = term[order], doc[order], pos[order]
        begins = np.concatenate(([0], np.flatnonzero(term[1:] != term[:-1]) + 1, [len(term)])).astype(np.int32)
        offsets = pa.array(begins)
        columns = [pa.array(term[begins[:-1]]), pa.ListArray.from_arrays(offsets, pa.array(doc)), pa.ListArray.from_arrays(offsets, pa.array(pos))]
        return pa.RecordBatch.from_arrays(columns, schema=_LISTS)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, docs, positions, held = [], [], [], 0
        for batch in batches:
            ids, texts = _reduced(batch.column(0).to_pylist(), batch.column(1).to_pylist(), least)
            # Stretches of whole tokens, about a segment at a time, however the texts are cut up.
            stretches = [(k, a, min(len(t), a + segment)) for k, t in enumerate(texts) for a in range(0, len(t), segment)]
            at = 0
            while at < len(stretches):
                upto, total = at, 0
                while upto < len(stretches) and (upto == at or total < segment):
                    total += stretches[upto][2] - stretches[upto][1]
                    upto += 1
                hashes = gram_hashes(_codes("".join(texts[k][a:b] for k, a, b in stretches[at:upto])), gram).view(np.int64)
                base = 0
                for k, a, b in stretches[at:upto]:
                    step = np.arange(0, b - a - gram + 1, gram)
                    terms.append(hashes[base + step])
                    docs.append(np.full(len(step), ids[k], dtype=np.int64))
                    positions.append(step + a)
                    base += b - a
                at = upto
                held += total
                if held >= segment:
                    if sum(map(len, terms)):
                        yield lists(terms, docs, positions)
                    terms, docs, positions, held = [], [], [], 0
        if sum(map(len, terms)):
            yield lists(terms, docs, positions)

    rows = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return checkpointed(rows.mapInArrow(index, _LISTS_DDL))


def postings_of(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos) of the ``terms`` asked for, once each."""
    found = index.join(terms.select("term").distinct(), "term", "left_semi")
    return found.select("term", F.explode(F.arrays_zip("docs", "positions")).alias("p")).select("term", F.col("p.docs").alias("doc_id"), F.col("p.positions").alias("pos"))


def item_terms(items: DataFrame, gram: int = GRAM) -> DataFrame:
    """Item and the term at each of its offsets."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = gram_hashes(_codes(reduce_text(text)), gram).view(np.int64) if text else np.zeros(0, dtype=np.int64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), item_id)), pa.array(h)], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("bigint"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(terms, "item_id bigint, term bigint")


def item_phrases(items: DataFrame, gram: int, least: int) -> DataFrame:
    """Item, offset, the terms at the offset and one token on, and the item's characters around the first."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_id", "offset", "term", "next_term"]
        kinds = [pa.int64()] * 4
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reduced = reduce_text(text) if text else ""
                if len(reduced) < least:
                    continue
                h = gram_hashes(_codes(reduced), gram).view(np.int64)
                n = len(h) - gram
                columns = [np.full(n, item_id), np.arange(n), h[:n], h[gram:]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return items.select(F.col("item_id").cast("bigint"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(phrases, "item_id bigint, offset bigint, term bigint, next_term bigint")


_PASSAGE_DDL = "doc_id bigint, item_id bigint, start bigint, end bigint"


def _exact(gram: int, least: int):
    """Decide candidates on the document's text: equal characters around the two tokens, on their diagonal."""

    def run(doc: str, item: str, pos: int, at: int) -> tuple[int, int]:
        if doc[pos : pos + gram] != item[at : at + gram]:  # equal hashes of different tokens
            return pos, pos
        left = 0
        while left < least and left < pos and left < at and doc[pos - 1 - left] == item[at - 1 - left]:
            left += 1
        end, upto, right = pos + gram, at + gram, 0
        while right < least and end + right < len(doc) and upto + right < len(item) and doc[end + right] == item[upto + right]:
            right += 1
        return pos - left, end + right

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "item_id", "start", "end"], [pa.int64()] * 4
        reduced: dict[int, str] = {}
        held, doc = None, ""
        for batch in batches:
            rows = []
            for doc_id, text, item_id, item_text, places in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (doc_id, text):
                    held, doc = (doc_id, text), reduce_text(text)
                item = reduced.get(item_id)
                if item is None:
                    if len(reduced) > 10_000:
                        reduced.clear()
                    item = reduced[item_id] = reduce_text(item_text)
                for place in places:
                    start, end = run(doc, item, place["pos"], place["at"])
                    if end - start >= least:
                        rows.append((doc_id, item_id, start, end))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    return decide


def candidates(index: DataFrame, items: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, pos, item_id, at): a token of a document and its neighbour that stand side by side in an item at ``at``."""
    phrases = item_phrases(items, gram, least)
    asked = phrases.select("term").union(phrases.select(F.col("next_term").alias("term")))
    postings = checkpointed(postings_of(index, asked))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    other = frequency.select(F.col("term").alias("next_term"), F.col("df").alias("next_df"))
    rare_first = F.col("df") <= F.col("next_df")
    plan = phrases.join(frequency, "term").join(other, "next_term").select(
        "item_id",
        F.when(rare_first, F.col("term")).otherwise(F.col("next_term")).alias("term"),
        F.when(rare_first, F.col("offset")).otherwise(F.col("offset") + gram).alias("at"),
        F.when(rare_first, F.col("next_term")).otherwise(F.col("term")).alias("with_term"),
        F.when(rare_first, F.lit(gram)).otherwise(F.lit(-gram)).alias("shift"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    # A term of boilerplate stands in very many documents: its list is dealt out by document.
    dealt = postings.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    hits = dealt.join(plan, ["term", "salt"]).withColumn("with_pos", F.col("pos") + F.col("shift"))
    neighbours = postings.select(F.col("term").alias("with_term"), "doc_id", F.col("pos").alias("with_pos"))
    # Repeats of a token inside an item give several offsets for one position; each is decided by itself.
    return hits.join(neighbours, ["with_term", "doc_id", "with_pos"], "left_semi").select("doc_id", "pos", "item_id", "at")


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = LEAST, gram: int = GRAM, index: DataFrame | None = None) -> DataFrame:
    """Document, item, and the range of reduced characters of each phrase that is part of a passage of ``least`` or more.

    Rows without an id, null and empty texts and items under ``least`` reduced characters match nothing; items that repeat
    others match under each id. A range reaches at most ``least`` characters beyond its two tokens, so
    longer passages show as ranges that overlap. ``index`` is one that ``build_index`` made of the documents.
    """
    if least < 3 * gram - 1:
        raise ValueError("a passage must cover two whole tokens: least >= 3 * gram - 1")
    found = candidates(build_index(documents, gram, least) if index is None else index, items, least, gram)
    texts = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint"), F.col("text").alias("item_text"))
    places = checkpointed(found.groupBy(F.col("doc_id").alias("_d"), "item_id").agg(F.collect_set(F.struct("pos", "at")).alias("places")))
    body = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = places.select(F.col("_d").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_DOCS:  # the texts without candidates then need no shuffle
        body = body.join(F.broadcast(wanted), "doc_id", "left_semi")
    rows = body.join(places.join(texts, "item_id"), F.col("doc_id") == F.col("_d"))
    return rows.select("doc_id", "text", "item_id", "item_text", "places").mapInArrow(_exact(gram, least), _PASSAGE_DDL)


def leaked_items(passages: DataFrame) -> DataFrame:
    """Each document with each item that leaked into it."""
    return passages.select("doc_id", "item_id").distinct()


def proximity(index: DataFrame, items: DataFrame, window: int = 400, tokens: int = 3, gram: int = GRAM) -> DataFrame:
    """Documents in which at least ``tokens`` different tokens of an item stand within ``window`` reduced characters, in any order.

    (doc_id, item_id, n_near, start): the most such tokens of one window, and where the first such window
    begins. Answered from the postings: positions of an item's tokens in a document are compared with
    those that follow within the window. Items shorter than a token match nothing.
    """
    terms = item_terms(items, gram)
    postings = postings_of(index, terms)
    dealt = postings.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    asked = terms.select("item_id", "term", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).distinct()
    hits = dealt.join(asked, ["term", "salt"]).select("doc_id", "item_id", "pos", "term").distinct()
    ahead = Window.partitionBy("doc_id", "item_id").orderBy("pos").rangeBetween(0, window - gram)
    near = hits.withColumn("n", F.size(F.collect_set("term").over(ahead)))
    best = near.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_near"), F.max_by("pos", F.struct("n", -F.col("pos"))).alias("start"))
    return best.where(F.col("n_near") >= tokens)
