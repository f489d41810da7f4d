"""Corpus operators: turns, chunks, splits, drop accounting, sharding, resuming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from turnweave.session import checkpointed

#: Of a batch's column: a row and a place for each item, and the items.
Pairs = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, pa.Array]]

# The speakers' labels and the form of a turn's line.
TURN = "^[ \\t]*(A|B|Ａ|Ｂ|USER|SYSTEM)[ \\t]*[:：][ \\t]*([^\\n]*?)[ \\t]*\\z"


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of each text with their position from 0; null texts have none."""
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def parse_turns(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of the form "speaker: text" as turns (key, pos, speaker A or B, text). Other lines are no turns."""
    rows = lines(documents, key, text).select(key, "pos", F.regexp_extract("line", TURN, 1).alias("label"), F.regexp_extract("line", TURN, 2).alias("text"))
    speaker = F.when(F.col("label").isin("A", "Ａ", "USER"), "A").when(F.col("label").isin("B", "Ｂ", "SYSTEM"), "B")
    return rows.withColumn("speaker", speaker).where("speaker IS NOT NULL").select(key, "pos", "speaker", "text")


def parse_dialogue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Turns of a generated dialogue (key, pos, speaker S1 or S2, text): lines "A: ..." and "B: ..." of either width.

    A role word a model puts in front (analysis, final, assistant) is cut off. The last turn is dropped
    unless it ends like a finished sentence. Null texts and texts without such lines give no turn.
    """
    from turnweave.functions.text import SENTENCE_END, SPACES

    bare = F.regexp_replace(text, rf"\A[{SPACES}]*(?:analysis|final|assistant)(?![\p{{L}}\p{{N}}_])[{SPACES}:：]*", "")
    split = F.split(bare, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    rows = documents.select(key, F.posexplode(split).alias("pos", "line"))
    turn = rf"\A[{SPACES}]*([ABＡＢ])[{SPACES}]*[:：][{SPACES}]*((?s).*?)[{SPACES}]*\z"
    parsed = rows.select(key, "pos", F.regexp_extract("line", turn, 1).alias("label"), F.regexp_extract("line", turn, 2).alias("text")).where("label <> '' AND text <> ''")
    last = parsed.groupBy(key).agg(F.max("pos").alias("_last"))
    kept = parsed.join(last, key).where((F.col("pos") != F.col("_last")) | F.lit(SENTENCE_END).contains(F.right("text", F.lit(1))))
    return kept.select(key, "pos", F.when(F.col("label").isin("A", "Ａ"), "S1").otherwise("S2").alias("speaker"), "text")


def single_speaker(rows: DataFrame, key: str, speaker: str = "speaker") -> DataFrame:
    """Each key's one speaker, or the problem: "several speakers" where it has more (null speakers count for none)."""
    found = rows.groupBy(key).agg(F.min(speaker).alias("_low"), F.max(speaker).alias("_high"))
    several = F.col("_low") != F.col("_high")
    return found.select(key, F.when(~several, F.col("_low")).alias("speaker"), F.when(several, "several speakers").alias("problem"))


def recovered_spans(spans: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Spans of the keys that have as many as ``expected`` (key, n_turns) says; a key with more or fewer gives none."""
    counts = spans.groupBy(key).agg(F.count("*").alias("_n")).join(expected, key).where("_n = n_turns").select(key)
    return spans.join(counts, key, "left_semi")


def drop_unusable(turns: DataFrame) -> DataFrame:
    """Turns with text and a known speaker."""
    return turns.where("speaker IN ('A', 'B') AND text <> ''")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Add ``run``: the number of the longest run of equal values that a row belongs to, per key."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge_turns(turns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Consecutive turns of one speaker as one, joined with a space."""
    merged = runs(turns, key, "pos", "speaker").groupBy(key, "run")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), " ")
    return merged.agg(F.min("pos").alias("pos"), F.first("speaker").alias("speaker"), texts.alias("text")).drop("run")


def greedy_chunks(turns: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """Turns with ``chunk``: a new one begins where the current is not empty and the turn would exceed the budget.

    Each chunk depends on where the one before ended, so this is a fold over a dialogue's turn lengths;
    the texts themselves are not folded. One dialogue's turns are one row on the way.
    """
    gathered = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.length("text").alias("n"), "speaker", "text"))).alias("ts"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        fresh = (s["used"] > 0) & (s["used"] + t["n"] > budget)
        chunk = s["chunk"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, t["n"]).otherwise(s["used"] + t["n"]).alias("used"), chunk.alias("chunk"), F.array_append(s["out"], chunk).alias("out"))

    numbered = gathered.withColumn("chunks", F.aggregate("ts", start, step)["out"])
    rows = numbered.select(key, F.inline(F.arrays_zip("ts", "chunks")))
    return rows.select(key, "ts.pos", "ts.speaker", "ts.text", F.col("chunks").alias("chunk"))


def chunk_names(key: Column, chunk: Column) -> Column:
    return F.format_string("%s_part%02d", key, chunk)


def reasons(rows: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """Add the name of the first rule that drops a row; null where none does. A null condition does not drop."""
    case = None
    for name, condition in rules:
        case = F.when(condition, name) if case is None else case.when(condition, name)
    return rows.withColumn(out, case)


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def threshold_sweep(rows: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Each row once per threshold that its score does not exceed. The thresholds ride along as an array."""
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    return rows.withColumn("threshold", F.explode(F.filter(values, lambda t: F.col(score) <= t)))


def shards(rows: DataFrame, order: str, per_file: int, prefix: str) -> DataFrame:
    """Add ``shard`` and ``file`` (``prefix-NNN-of-MMM``): rows in ``order``, a fixed number a file."""
    from turnweave.operators.streams import number_rows

    numbered = number_rows(rows, [F.col(order)], "_n").withColumn("shard", F.floor(F.col("_n") / per_file))
    total = numbered.agg(F.ceil(F.count("*") / per_file).alias("_m"))
    joined = numbered.crossJoin(F.broadcast(total))  # one row on the right
    return joined.withColumn("file", F.format_string(f"{prefix}-%03d-of-%03d", "shard", "_m")).drop("_n", "_m")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of the left side that the right side lacks."""
    return left.select(key).where(f"{key} IS NOT NULL").distinct().join(right.select(key).distinct(), key, "left_anti")


def pending(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def induced_subgraph(nodes: DataFrame, edges: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a category, and the edges of that category whose two ends are among them."""
    seen = nodes.where(F.array_contains("cats", category))
    kept = edges.where(F.array_contains("cats", category))
    for end in ("source", "target"):
        kept = kept.join(seen.select(F.col("id").alias(end)), end, "left_semi")
    return seen, kept


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, with its copy number."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def array_pairs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The elements of sets as pairs of a row and a place in the last array, which has each element once. Nulls are none."""
    flat = pc.list_flatten(lists).dictionary_encode()
    there = flat.indices.is_valid()
    return pc.list_parent_indices(lists).filter(there).to_numpy(), flat.indices.filter(there).to_numpy(), flat.dictionary


#: Pairs of an item and a label up to which the table of items is broadcast (4 bytes each and 8 an item); beyond that the rows' items are shuffled.
HELD_PAIRS = 4_000_000


def best_by_jaccard(rows: DataFrame, key: str, label: str, items: str, of: Pairs | None = None, held: int | None = None) -> DataFrame:
    """(key, label, score): the label whose items, those of all its rows together, are most like the row's by Jaccard similarity.

    ``items`` are sets; with ``of`` any column whose batches it turns into pairs of a row and an item (``text.bigram_pairs``).
    Keys are unique. Ties go to the smaller label; a row without items gives none. The labels are few: an item has a list of them.

    Items never become rows of Spark where this can be helped: each task unites the items of its rows by label and hands
    over one row an item. The rows then meet the table of items in a second pass, in which a common item counts for all
    labels less those that lack it. Batches are cut by the bytes of their items, so the memory of a worker does not
    depend on them. A table of over ``held`` pairs is not broadcast: the rows' items are then shuffled to it.
    """
    kinds = {c: rows.schema[c].dataType for c in (key, label, items)}
    item_kind = LongType() if of else kinds[items].elementType
    pairs = of or array_pairs
    names = rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).toArrow().column(0).combine_chunks()
    if not len(names):
        return rows.select(key, label, F.lit(0.0).alias("score")).where("false")
    n_labels = len(names)

    def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
        step = max(1, min(4_000_000 // n_labels, batch.num_rows * 1_000_000 // max(1, batch.column(column).nbytes)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)

    def label_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        found: list[np.ndarray] = []

        def emit(pair: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.diff(pair // n_labels, prepend=-1))
            values = pa.array(list(known), type=to_arrow_type(item_kind)).take(pa.array(pair[starts] // n_labels))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pair)), pa.int32()), pa.array(pair % n_labels, pa.int32()))
            for a in range(0, len(values), 20_000):
                yield pa.RecordBatch.from_arrays([values.slice(a, 20_000), lists.slice(a, 20_000)], ["_item", "_labels"])

        for batch in batches:
            for piece in pieces(batch, 1):
                piece = piece.filter(pc.is_valid(piece.column(0)))
                own = pc.index_in(piece.column(0), names.cast(piece.column(0).type)).to_numpy()
                row, item, values = pairs(piece.column(1))
                ids = np.fromiter((known.setdefault(v, len(known)) for v in values.to_pylist()), np.int64, len(values))
                found.append(np.unique(ids[item] * n_labels + own[row]))
                if sum(map(len, found)) > 1_500_000:
                    found = [np.unique(np.concatenate(found))]
                    if len(found[0]) > 1_000_000:
                        yield from emit(found[0])
                        known.clear()
                        found.clear()
        if found:
            yield from emit(np.unique(np.concatenate(found)))

    table_kind = StructType([StructField("_item", item_kind), StructField("_labels", ArrayType(IntegerType()))])
    own = rows.select(label, items).mapInArrow(label_items, table_kind)
    table = checkpointed(own.groupBy("_item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_labels")))).alias("_labels")))
    n_pairs = table.agg(F.coalesce(F.sum(F.size("_labels")), F.lit(0))).first()[0]
    if n_pairs > (HELD_PAIRS if held is None else held):
        return _best_by_join(rows.select(key, items), key, label, names, table, pairs, pieces, StructType([StructField(key, kinds[key]), StructField("_size", LongType()), StructField("_item", item_kind)]))

    found = table.toArrow()
    values, lists = found.column(0).combine_chunks(), found.column(1).combine_chunks()
    common = pc.list_value_length(lists).to_numpy() * 2 > n_labels
    at, of_labels = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
    sizes = np.bincount(of_labels, minlength=n_labels)
    # Of a common item the table tells the labels that lack it, of another those that have it.
    told_at, told_labels = [at[~common[at]]], [of_labels[~common[at]]]
    commons, place = np.flatnonzero(common), np.cumsum(common) - 1
    for a in range(0, len(commons), chunk := max(1, 4_000_000 // n_labels)):
        lacks = np.ones((min(chunk, len(commons) - a), n_labels), bool)
        here = common[at] & (place[at] >= a) & (place[at] < a + chunk)
        lacks[place[at[here]] - a, of_labels[here]] = False
        k, lacking = np.nonzero(lacks)
        told_at.append(commons[a + k])
        told_labels.append(lacking)
    at = np.concatenate(told_at)
    of_labels = np.concatenate(told_labels).astype(np.int32)[np.argsort(at, kind="stable")]
    starts = np.append(0, np.cumsum(np.bincount(at, minlength=len(values))))
    shared = rows.sparkSession.sparkContext.broadcast((values, common, starts, of_labels, sizes))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, common, starts, of_labels, sizes = shared.value
        # A last place, for items that no label has.
        common, starts = np.append(common, False), np.append(starts, starts[-1])
        for batch in batches:
            for piece in pieces(batch, 1):
                n = piece.num_rows
                row, item, own = pairs(piece.column(1))
                place = pc.index_in(own, values).fill_null(len(values)).to_numpy()[item]
                counts = np.zeros(n * n_labels)
                told = starts[place + 1] - starts[place]
                upto = np.cumsum(told)
                cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + 1_000_000 if len(upto) else 0, 1_000_000), side="left"))
                for a, b in zip(cuts, np.append(cuts[1:], len(place))):
                    t = told[a:b]
                    k = np.arange(t.sum()) + np.repeat(starts[place[a:b]] - (np.cumsum(t) - t), t)
                    counts += np.bincount(np.repeat(row[a:b] * n_labels, t) + of_labels[k], np.repeat(np.where(common[place[a:b]], -1.0, 1.0), t), n * n_labels)
                counts = counts.reshape(n, n_labels) + np.bincount(row[common[place]], minlength=n)[:, None]
                score = counts / (np.bincount(row, minlength=n)[:, None] + sizes - counts + 1e-9)
                first = score.argmax(axis=1)
                score = score[np.arange(n), first]
                some = pa.array(score > 0)
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(some), names.take(pa.array(first)).filter(some), pa.array(score).filter(some)], [key, label, "score"])

    return rows.select(key, items).mapInArrow(best, StructType([StructField(key, kinds[key]), StructField(label, kinds[label]), StructField("score", DoubleType())]))


def _best_by_join(rows: DataFrame, key: str, label: str, names: pa.Array, table: DataFrame, pairs: Pairs, pieces: Callable, kind: StructType, salts: int = 8) -> DataFrame:
    """``best_by_jaccard`` by a join of the rows' items with a table of any size; frequent items are dealt out by row (``salts``: a power of two)."""

    def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                row, item, values = pairs(piece.column(1))
                sizes = np.bincount(row, minlength=piece.num_rows)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(sizes[row]), values.take(pa.array(item))], [key, "_size", "_item"])

    of = table.withColumn("_set", F.md5(F.to_json(F.struct("_labels"))))
    sizes = of.select(F.explode("_labels").alias("_label")).groupBy("_label").agg(F.count("*").alias("_n"))
    sets = of.groupBy("_set").agg(F.first("_labels").alias("_labels"))
    salted = of.select("_item", "_set", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    dealt = rows.mapInArrow(unfolded, kind).withColumn("_salt", F.xxhash64(key).bitwiseAND(F.lit(salts - 1)).cast("int"))
    # Many items of a row have the same labels: they are counted together before their labels are unfolded.
    counted = dealt.join(salted, ["_item", "_salt"]).groupBy(key, "_size", "_set").agg(F.count("*").alias("_c"))
    shared = counted.join(sets, "_set").select(key, "_size", F.explode("_labels").alias("_label"), "_c").groupBy(key, "_size", "_label").agg(F.sum("_c").alias("_shared"))
    score = F.col("_shared") / (F.col("_size") + F.col("_n") - F.col("_shared") + 1e-9)
    # The labels' numbers are in their order.
    best = shared.join(sizes, "_label").groupBy(key).agg(F.min(F.struct((-score).alias("_less"), F.col("_label"))).alias("_best"))
    told = rows.sparkSession.createDataFrame(pa.table({"_label": pa.array(range(len(names)), pa.int32()), label: names}))
    return best.select(key, F.col("_best._label").alias("_label"), (-F.col("_best._less")).alias("score")).join(F.broadcast(told), "_label").select(key, label, "score")
