"""Long exact spans shared between documents (problem 9): a compressed FM-index per shard.

Streaming every document through the index of every shard would cost the square of the corpus, so
documents are routed first. Anchors are window minima of k-gram hashes; any span of ``least``
characters holds an anchor that depends on the span alone, so two documents that share a span share an
anchor. Around each anchor found in two documents or more, the text that a shortest shared span can
reach is a context. Equal contexts of an anchor are one class: its text goes to the anchor's shard once,
however many documents have it, and the membership of documents stays a table of its own.

In a shard an FM-index is built over the classes' texts, and the same texts are streamed through it:
backward search over a wavelet matrix finds where the characters before every 60th place stand, in
other classes or in a class of several documents, and comparing outwards gives the matching statistic
there, the maximal common interval. What is reported comes from those searches alone.

An anchor of very many documents or places (boilerplate, periodic text) would gather as many different
contexts. There every window of ``least`` characters over the anchor is a context of its own under its
own hash, so each group has one class, and the work is linear in the documents. Document pairs arise at the very end only, from
membership, in blocks; spans per document need no pairs at all. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.fm import FMIndex, agreeing
from turnweave.llm.leaks import gram_hashes
from turnweave.session import checkpointed, key_groups

LEAST, GRAM, STEP = 120, 60, 60
#: An anchor of 60 characters is rarely shared by chance, where 24 leave 40 % of all anchors as candidates.
#: Documents and places of an anchor from which its contexts are taken window by window; characters of contexts in one index.
HOT_DOCS, HOT_PLACES, SHARD_CHARS = 1_500, 5_000, 400_000
#: Parts (a power of two) that rows of one anchor or class are dealt into, and members of a class in a block of a pair of blocks.
SALTS, BLOCK = 16, 1_500


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` over each window of ``width``, by windows of doubling width."""
    n = len(values) - width + 1
    have = 1
    while have * 2 <= width:
        values = of(values[:-have], values[have:])
        have *= 2
    return of(values[:n], values[width - have : width - have + n])


#: Codes whose anchors are looked for at once.
SEGMENT = 1_000_000


def anchors_of(codes: np.ndarray, owner: np.ndarray, least: int, gram: int, segment: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in texts that lie end to end; ``owner`` numbers the text of each code.

    Long inputs are taken in stretches that overlap by one window, so every window lies in one of them.
    """
    segment = segment or SEGMENT
    if len(codes) <= segment + least:
        return _anchors_of(codes, owner, least, gram)
    found = []
    for a in range(0, len(codes), segment):
        b = a + segment + least - 1
        at, h = _anchors_of(codes[a:b], owner[a:b], least, gram)
        found.append((at + a, h))
    places, first = np.unique(np.concatenate([at for at, _ in found]), return_index=True)
    return places, np.concatenate([h for _, h in found])[first]


def _anchors_of(codes: np.ndarray, owner: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    window = least - gram + 1
    h = gram_hashes(codes, gram)
    if len(h) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    lowest = _sliding(h, window, np.minimum)
    whole = owner[: len(lowest)] == owner[least - 1 : least - 1 + len(lowest)]
    lowest = np.where(whole, lowest, np.uint64(0))
    padded = np.concatenate((np.zeros(window - 1, dtype=np.uint64), lowest, np.zeros(window - 1, dtype=np.uint64)))
    covering = _sliding(padded, window, np.maximum)
    at = np.flatnonzero((covering == h) & (h != 0))
    return at, h[at]


_PLACES = pa.list_(pa.int32())
_ANCHOR = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("at", _PLACES)])


def anchors(documents: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(anchor, doc_id, at): each document's anchors with their places; null texts, texts under ``least`` characters and documents without an id have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                b, total = a, 0
                while b < len(texts) and (b == a or total < 500_000):
                    total += len(texts[b] or "")
                    b += 1
                sizes = np.array([len(t or "") for t in texts[a:b]])
                codes = np.frombuffer("".join(t or "" for t in texts[a:b]).encode("utf-32-le"), dtype=np.uint32)
                owner = np.repeat(np.arange(b - a), sizes)
                at, h = anchors_of(codes, owner, least, gram)
                if len(at):
                    begins = np.cumsum(sizes) - sizes
                    order = np.lexsort((at, h, owner[at]))
                    at, h = at[order], h[order].view(np.int64)
                    who = owner[at]
                    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1]))))
                    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array((at - begins[who]).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(ids[a:b][who[first]].astype(np.int64)), places], schema=_ANCHOR)
                a = b

    return documents.select(F.col("doc_id").cast("bigint"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInArrow(find, "anchor bigint, doc_id bigint, at array<int>")


def _salt(key: str | Column) -> Column:
    """By bits, not by a remainder: that could be null to the optimizer, whose filter would part equal shuffles."""
    return F.xxhash64(key).bitwiseAND(F.lit(SALTS - 1)).cast("int")


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


_MEMBER = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("starts", _PLACES), ("context", pa.string())])


def members(documents: DataFrame, least: int = LEAST, gram: int = GRAM, hot_docs: int | None = None, hot_places: int | None = None) -> DataFrame:
    """(anchor, cls, doc_id, starts, context): the contexts of anchors that stand in several documents, by document.

    ``cls`` names the context's text within its anchor, ``starts`` where it stands in the document.
    """
    # Anchors are dealt out by document and grouped once; both the counts and the join below use that grouping.
    # Neither column is ever null; said so, no filter on nulls parts the two uses.
    dealt = anchors(documents, least, gram).select(F.coalesce("anchor", F.lit(0)).alias("anchor"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "at", _salt("doc_id").alias("salt")).repartition("anchor", "salt")
    counts = dealt.groupBy("anchor", "salt").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("docs"), F.sum(F.size("at")).alias("places"))
    shared = counts.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("docs").alias("docs"), F.sum("places").alias("places")).where("lo < hi")
    hot = (F.col("docs") > (hot_docs or HOT_DOCS)) | (F.col("places") > (hot_places or HOT_PLACES))
    kept = dealt.join(_salted(shared.select("anchor", hot.alias("hot"))), ["anchor", "salt"])
    # A document's anchors travel as one list, so its text is cut in one pass over the text, however long it is.
    listed = checkpointed(kept.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot", "at")).alias("found")))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL")
    cut = listed.join(texts, "doc_id").select("doc_id", "text", "found").mapInArrow(_cut(least, gram), "anchor bigint, doc_id bigint, starts array<int>, context string")
    return checkpointed(cut.select("anchor", F.md5(F.encode("context", "UTF-8")).alias("cls"), "doc_id", "starts", "context"))


def _cut(least: int, gram: int):
    reach = least - gram

    def contexts(text: str, at: list[int]) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for pos in at:
            if pos + gram <= len(text):  # another text of the same id may be shorter
                start = max(0, pos - reach)
                found.setdefault(text[start : pos + gram + reach], []).append(start)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _MEMBER)], schema=_MEMBER)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                for x in found:
                    whole = contexts(text, x["at"])
                    if not x["hot"]:
                        out.extend((x["anchor"], doc_id, starts, context) for context, starts in whole.items())
                        continue
                    windows: dict[str, set[int]] = {}
                    for context, starts in whole.items():
                        for k in range(len(context) - least + 1):
                            windows.setdefault(context[k : k + least], set()).update([s + k for s in starts])
                    for window, starts in windows.items():
                        name = int.from_bytes(hashlib.blake2b(window.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                        out.append((name, doc_id, sorted(starts), window))
                        if len(out) > 20_000:
                            yield emit()
                if len(out) > 20_000:
                    yield emit()
        if out:
            yield emit()

    return run


def classes(found: DataFrame) -> DataFrame:
    """(anchor, cls, context, doc_id, n): each class with its text, one of its documents and how many it has."""
    once = found.groupBy("anchor", "cls").agg(F.first("context").alias("context"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows"))
    return once.select("anchor", "cls", "context", F.col("lo").alias("doc_id"), F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.col("rows")).alias("n"))


def shared_intervals(texts: list[str], several: np.ndarray, least: int, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Maximal common intervals of classes, as arrays: x, its from and to, y, its from.

    ``x < y`` are two different classes; a class of several documents also stands against itself, as a
    whole. Each common interval of ``least`` or more holds a place that is a multiple of ``step`` with
    ``least - step + 1`` characters of the interval before it; the index finds where those stand, and
    the characters on either side say how far both go on alike.
    """
    sizes = np.array([len(t) for t in texts])
    joined = "\x00" + "\x00".join(texts) + "\x00"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    separator = np.zeros(len(raw), dtype=bool)
    separator[0] = True
    separator[begins + sizes] = True
    letters, code = np.unique(raw, return_inverse=True)
    code = code.astype(np.int64) + 2  # 0 ends the text, 1 separates
    code[separator] = 1
    probe = least - step + 1
    places = [np.arange(-(-probe // step) * step, s + 1, step) for s in sizes]
    who = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    if not len(who):
        return
    index = FMIndex(code, len(letters) + 2)
    ends = np.concatenate(places) + begins[who]
    enough = np.where(several[who], 1, 2)
    low, high = index.search(code, ends, probe, enough)
    found = np.maximum(high - low, 0)
    use = found >= enough
    who, ends, low, found = who[use], ends[use], low[use], found[use]
    if not len(who):
        return
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(found) // 200_000)) + 1, [len(found)]))
    for a, b in zip(cuts, cuts[1:]):
        n = found[a:b]
        x = np.repeat(np.arange(a, b), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        y_end = index.locate(low[x] + offset) + probe
        x_end, x_who = ends[x], who[x]
        y_who = owner[np.minimum(y_end - 2, len(owner) - 1)]
        use = (x_who < y_who) | ((x_end == y_end) & several[x_who])
        x_end, x_who, y_end, y_who = x_end[use], x_who[use], y_end[use], y_who[use]
        if not len(y_end):
            continue
        x_at, y_at = x_end - begins[x_who], y_end - begins[y_who]
        left = probe + agreeing(code, x_end - probe, y_end - probe, np.minimum(x_at, y_at) - probe, True)
        right = agreeing(code, x_end, y_end, np.minimum(sizes[x_who] - x_at, sizes[y_who] - y_at), False)
        use = left + right >= least
        yield x_who[use], (x_at - left)[use], (x_at + right)[use], y_who[use], (y_at - left)[use]


_PAIR = pa.schema([("a", pa.int64()), ("cls_a", pa.string()), ("doc_a", pa.int64()), ("n_a", pa.int64()), ("b", pa.int64()), ("cls_b", pa.string()), ("doc_b", pa.int64()), ("n_b", pa.int64())])
_PAIR_DDL = "a bigint, cls_a string, doc_a bigint, n_a bigint, b bigint, cls_b string, doc_b bigint, n_b bigint"
_INTERVAL = pa.schema([("anchor", pa.int64()), ("cls", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("span", pa.int64())])
_INTERVAL_DDL = "anchor bigint, cls string, start bigint, end bigint, span bigint"


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _shard(least: int, step: int, pairs: bool):
    """Search the classes of a shard: pairs of classes, or intervals of each class that stand in another document."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, cls, texts, doc, n = (list(c) for c in zip(*held))
        doc, n = np.array(doc, dtype=np.int64), np.array(n, dtype=np.int64)
        once: set[tuple[int, int, int]] = set()
        for x, low, high, y, y_low in shared_intervals(texts, n > 1, least, step):
            # Two classes of one and the same document share nothing with another one.
            use = ~((n[x] == 1) & (n[y] == 1) & (doc[x] == doc[y]))
            x, low, high, y, y_low = x[use], low[use], high[use], y[use], y_low[use]
            if pairs:
                both = np.unique(x * len(texts) + y)
                x, y = both // len(texts), both % len(texts)
                take = lambda names, at: [names[k] for k in at.tolist()]
                if len(x):
                    yield _rows([take(anchor, x), take(cls, x), doc[x], n[x], take(anchor, y), take(cls, y), doc[y], n[y]], _PAIR)
            else:
                for k, a, b in ((x, low, high), (y, y_low, y_low + high - low)):
                    once.update(map(tuple, np.unique(np.stack((k, a, b), axis=1), axis=0).tolist()))
        if once:
            spans = [int.from_bytes(hashlib.blake2b(texts[k][a:b].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for k, a, b in once]
            yield _rows([[anchor[k] for k, _, _ in once], [cls[k] for k, _, _ in once], [a for _, a, _ in once], [b for _, _, b in once], spans], _INTERVAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in key_groups(batches, 1):
            rows = list(zip(*(c.to_pylist() for c in table.columns)))
            held.extend(rows)
            size += sum(len(r[2]) + 1 for r in rows)
            if size >= SHARD_CHARS:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    return run


def _searched(found: DataFrame, least: int, step: int, pairs: bool) -> DataFrame:
    shards = classes(found).repartition("anchor").sortWithinPartitions("anchor")
    return shards.mapInArrow(_shard(least, step, pairs), _PAIR_DDL if pairs else _INTERVAL_DDL)


def sharing_pairs(documents: DataFrame, least: int = LEAST, gram: int = GRAM, step: int = STEP, block: int = BLOCK, found: DataFrame | None = None) -> DataFrame:
    """Pairs of documents (doc_id_a < doc_id_b) whose stored texts have a common substring of ``least`` code points.

    Null texts, texts under ``least`` and documents without an id share nothing; a repeated doc_id is one document.
    """
    found = members(documents, least, gram) if found is None else found
    pairs = checkpointed(_searched(found, least, step, True))
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    direct = pairs.where(single).select(F.col("doc_a").alias("x"), F.col("doc_b").alias("y"))
    # Classes of several documents: members meet in pairs of blocks, so no task holds all of a class's pairs.
    wide = pairs.where(~single)
    n_blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    wide = wide.withColumn("i", F.explode(F.sequence(F.lit(0), n_blocks("n_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), n_blocks("n_b") - 1)))
    same = (F.col("a") == F.col("b")) & (F.col("cls_a") == F.col("cls_b"))
    wide = wide.where(~same | (F.col("i") <= F.col("j")))
    used = wide.select(F.col("a").alias("anchor"), F.col("cls_a").alias("cls"), F.col("n_a").alias("n")).union(wide.select("b", "cls_b", "n_b")).distinct()
    placed = found.select("anchor", "cls", "doc_id", _salt("doc_id").alias("salt")).join(_salted(used), ["anchor", "cls", "salt"])
    placed = placed.select("anchor", "cls", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), n_blocks("n")).cast("int").alias("k")).distinct()
    left = placed.select(F.col("anchor").alias("a"), F.col("cls").alias("cls_a"), F.col("k").alias("i"), F.col("doc_id").alias("x"))
    right = placed.select(F.col("anchor").alias("b"), F.col("cls").alias("cls_b"), F.col("k").alias("j"), F.col("doc_id").alias("y"))
    met = wide.select("a", "cls_a", "i", "b", "cls_b", "j").join(left, ["a", "cls_a", "i"]).join(right, ["b", "cls_b", "j"]).where("x <> y").select("x", "y")
    return direct.union(met).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_spans(documents: DataFrame, least: int = LEAST, gram: int = GRAM, step: int = STEP, found: DataFrame | None = None) -> DataFrame:
    """Spans (doc_id, start, end, span) of a document's text that stand in another document; they may overlap.

    ``span`` names the span's text: equal texts have equal names in all documents. No pairs are formed.
    """
    found = members(documents, least, gram) if found is None else found
    intervals = _salted(_searched(found, least, step, False).distinct())
    dealt = found.select("anchor", "cls", "doc_id", "starts", _salt("doc_id").alias("salt"))
    met = dealt.join(intervals, ["anchor", "cls", "salt"]).select("doc_id", F.explode("starts").alias("at"), "start", "end", "span")
    return met.select("doc_id", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "span").distinct()
