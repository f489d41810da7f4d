"""Encoding of a whole corpus with a byte-level BPE vocabulary (problem 7).

Batched numpy merge rounds. The distinct words of a batch lie as symbols in one flat array. In a round,
each word's adjacent pairs are looked up by binary search over the sorted pair keys of the vocabulary;
the lowest rank of each word is found by a segmented minimum, and every word merges its pairs of that
rank, leftmost first. Words without a pair in the vocabulary are done and leave the array. Word results
are kept for the next batch; the texts' ids are then gathered from the word results by offsets.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter everywhere below.
VOCABULARIES = "/opt/tokenizers"

# Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NO_RANK = np.int64(1 << 40)


class Vocabulary:
    """A rank file as arrays: the id of each byte, and sorted keys of mergeable pairs with their result.

    A token's id is its rank. A pair of ids is mergeable when its bytes joined are a token; which pairs
    can occur is found by splitting each token at every place into two tokens.
    """

    def __init__(self, symbols: np.ndarray, keys: np.ndarray, results: np.ndarray):
        self.bytes, self.keys, self.results = symbols, keys, results

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        keys, results = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = ranks.get(token[cut:]) if left is not None else None
                if right is not None:
                    keys.append(left << 32 | right)
                    results.append(rank)
        symbols = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        order = np.argsort(np.array(keys, dtype=np.int64))
        return cls(symbols, np.array(keys, dtype=np.int64)[order], np.array(results, dtype=np.int64)[order])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.results[at], _NO_RANK)


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each word (not empty), by merge rounds over all words at once."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbols = vocabulary.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_owner = [], []
    # Ranks of pairs are kept between rounds; only pairs next to a merge are looked up again.
    rank = np.full(len(symbols), _NO_RANK)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inside] = vocabulary.rank_of(symbols[inside], symbols[inside + 1])
    while len(symbols):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lengths = np.diff(np.concatenate((starts, [len(symbols)])))
        lowest = np.minimum.reduceat(rank, starts)
        over = np.repeat(lowest == _NO_RANK, lengths)
        if over.any():
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            keep = ~over
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            lengths, lowest = lengths[lowest != _NO_RANK], lowest[lowest != _NO_RANK]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, lengths)
        # Of touching hits (a a a) every second one of a run merges, counted from the left.
        at = np.flatnonzero(hit)
        run_start = np.concatenate(([True], np.diff(at) != 1))
        run_first = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_first) % 2 == 0]
        symbols[at] = rank[at]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        where = np.cumsum(keep) - 1
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        merged = where[at]
        for pair in (merged, merged[merged > 0] - 1):
            rank[pair] = _NO_RANK
            pair = pair[pair + 1 < len(symbols)]
            pair = pair[owner[pair] == owner[pair + 1]]
            rank[pair] = vocabulary.rank_of(symbols[pair], symbols[pair + 1])
    out_symbols = np.concatenate(done_symbols) if done_symbols else symbols
    out_owner = np.concatenate(done_owner) if done_owner else owner
    order = np.argsort(out_owner, kind="stable")
    counts = np.bincount(out_owner, minlength=len(words))
    return np.split(out_symbols[order].astype(np.int32), np.cumsum(counts)[:-1])


#: Characters of a text that are split at once.
SEGMENT = 1_000_000
# A single space between two characters that are no white space: the split always begins a word there.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def segments(text: str, size: int) -> Iterator[str]:
    """A text in stretches of about ``size`` that can be split each by itself."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Encoder:
    """Ids of texts, batch by batch, with a bounded memory of word results."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most
        self.number: dict[str, int] = {}
        self.results: list[np.ndarray] = []
        self.split = regex.compile(PATTERN).findall

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list of ids per text; null and empty texts both give an empty list."""
        if len(self.number) > self.most:
            self.number, self.results = {}, []
        number, tokens, counts, fresh = self.number, array("q"), [], []
        for text in texts:
            before = len(tokens)
            for stretch in segments(text, SEGMENT) if text else ():
                for word in self.split(stretch):
                    k = number.get(word)
                    if k is None:
                        k = number[word] = len(number)
                        fresh.append(word.encode())
                    tokens.append(k)
            counts.append(len(tokens) - before)
        if fresh:
            self.results.extend(merge_words(fresh, self.vocabulary))
        if not tokens:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, dtype=np.int32)), pa.array([], type=pa.int32()))
        used, place = np.unique(np.frombuffer(tokens, dtype=np.int64), return_inverse=True)
        parts = [self.results[k] for k in used]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        begins = np.cumsum(sizes) - sizes
        flat = np.concatenate(parts)
        size = sizes[place]
        ends = np.cumsum(size)
        ids = flat[np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(begins[place], size)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, type=pa.int32()))


def encode_column(spark: SparkSession, text: Column, path: str) -> Column:
    """The ids of ``text`` as an array column; texts that look like special tokens are ordinary text.

    The vocabulary is read on the driver and broadcast as arrays: its size is that of the file, under
    4 MB for 50,000 tokens, whatever the corpus.
    """
    loaded = Vocabulary.load(path)
    shared = spark.sparkContext.broadcast((loaded.bytes, loaded.keys, loaded.results))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(*shared.value))
        for texts in batches:
            out, step = [], 512
            for a in range(0, max(1, len(texts)), step):
                out.append(encoder.encode(texts.slice(a, step).to_pylist()))
            yield pa.concat_arrays(out)

    return encode(text)


def encode_documents(documents: DataFrame, path: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id`` and ``ids`` of every document, duplicates included; empty and null texts give ``[]``."""
    return documents.select("doc_id", encode_column(documents.sparkSession, F.col("text"), path).alias("ids"))
