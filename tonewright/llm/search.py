"""Ranked lexical search by documents: the items are indexed, and the documents are streamed through that index.

The items' terms form the inverted index: sorted term hashes, the terms' bytes, and for each term the items that
hold it. It is sent to every task; items are taken in blocks of at most ``INDEX_BYTES`` of text, so its size is
bounded whatever their number, and every block is one more pass over the documents.

1. One pass counts the documents and the terms of the collection, and for each indexed term the documents that hold
   it. Only indexed terms are counted, so a task sends at most one row for each of them.
2. In a second pass every task keeps a heap of the best ``k`` documents for each item. A document's terms are looked up,
   their weights added up for each item that holds them, and a heap changes only where a score can enter it. Once a heap is
   full, the terms of an item that even together can't reach its smallest score bring no document into play: only
   documents with one of its other terms are scored for it (in full). That is exact, as the bound is that of the weights.
3. Heaps of all tasks are merged in two steps, first by groups of tasks.

Term, document length and score are those of the contract: terms are runs of letters, digits and all characters
from U+0080 on, only A-Z lower-cased. The weight of a term is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, and a document's share
of it is ``(10^9 tf) div (1000 tf + 8 m)`` with ``m = 10 + (90 n N) div L``, in integers.

Nulls and odd input: a null text has no term; an item or document without terms is in no result; a null key of a
document comes before all others where scores are equal; repeated document rows are documents of their own; each item row
has its own list, equal ones too; an empty table gives an empty result; other columns are not read. Keys of documents are
whole numbers. An item longer than a block is a block by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.common import prefix_hash, running_total, slices, span_hash, text_bytes

INDEX_BYTES = 4_000_000  # text of the items of one block; its index takes some ten times that
CELLS = 1 << 22  # (document, item) pairs that are added up at a time
GROUPS = 64  # of tasks, in the first merge

# The characters of a term.
TERM = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    TERM[_low: _high + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


# --- terms -----------------------------------------------------------------------------------------

def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and where every term begins and ends; no term crosses texts."""
    low = LOWER[data]
    inside = TERM[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1: len(low)]
    end[:-1] &= ~inside[1:] | cut[1: len(low)]
    return low, np.flatnonzero(begin), np.flatnonzero(end) + 1


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the stretches, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


@dataclass
class Index:
    """The distinct terms of a block of items, in order of their hash."""

    hashes: np.ndarray
    sizes: np.ndarray  # bytes of each term
    begins: np.ndarray  # where they begin in ``letters``
    letters: np.ndarray
    posting_begin: np.ndarray  # by term, with the end at last
    posting_item: np.ndarray
    n_items: int

    @classmethod
    def of(cls, texts: pa.Array) -> "Index":
        data, offsets = text_bytes(texts)
        low, start, end = terms_of(data, offsets)
        raw = low.tobytes()
        item = np.searchsorted(offsets, start, "right") - 1
        number: dict[bytes, int] = {}
        term = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(start, end)], np.int64)
        words = list(number)
        sizes = np.array([len(w) for w in words], np.int64)
        begins = np.cumsum(sizes) - sizes
        letters = np.frombuffer(b"".join(words), np.uint8)
        hashes = span_hash(prefix_hash(letters), begins, begins + sizes)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        pairs = np.unique(place[term] * max(len(texts), 1) + item)
        by_term, by_item = np.divmod(pairs, max(len(texts), 1))
        return cls(hashes[order], sizes[order], begins[order], letters,
                   np.searchsorted(by_term, np.arange(len(words) + 1)), by_item, len(texts))

    def look_up(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are in the index, and their numbers. Bytes decide, so a hash that two terms
        share makes no difference."""
        if not len(self.hashes) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = span_hash(prefix_hash(low), start, end)
        first = np.searchsorted(self.hashes, hashes)
        found, terms = [], []
        left = np.flatnonzero(first < len(self.hashes))
        place = first[left]
        while len(left):  # more than once only for terms of the index that share a hash
            same = self.hashes[place] == hashes[left]
            left, place = left[same], place[same]
            hit = np.flatnonzero(self.sizes[place] == end[left] - start[left])
            sizes = self.sizes[place[hit]]
            equal = low[spread(start[left[hit]], sizes)] == self.letters[spread(self.begins[place[hit]], sizes)]
            good = np.add.reduceat(equal, np.cumsum(sizes) - sizes, dtype=np.int64) == sizes if len(hit) else hit
            found.append(left[hit[good]])
            terms.append(place[hit[good]])
            other = np.ones(len(left), bool)
            other[hit[good]] = False
            left, place = left[other], place[other] + 1
            inside = place < len(self.hashes)
            left, place = left[inside], place[inside]
        return np.concatenate(found), np.concatenate(terms)


def term_counts(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, term and count for every indexed term of a document, in order; all terms of each document."""
    low, start, end = terms_of(data, offsets)
    doc = np.searchsorted(offsets, start, "right") - 1
    which, term = index.look_up(low, start, end)
    width = max(len(index.hashes), 1)
    pairs, count = np.unique(doc[which] * width + term, return_counts=True)
    return *np.divmod(pairs, width), count, np.bincount(doc, minlength=len(offsets) - 1)


# --- the heaps -------------------------------------------------------------------------------------

class Heaps:
    """The best ``k`` documents of every item, highest score first, then by ascending key, nulls first.
    A score of -1 is a free place."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.score = np.full((n_items, k), -1, np.int64)
        self.known = np.zeros((n_items, k), bool)  # whether the key is not null
        self.key = np.zeros((n_items, k), np.int64)

    def floor(self) -> np.ndarray:
        """What a score has to reach to enter each heap."""
        return self.score[:, -1]

    def put(self, item: np.ndarray, score: np.ndarray, known: np.ndarray, key: np.ndarray) -> None:
        """Add candidates; only the heaps that get one are touched."""
        touched = np.unique(item)
        item = np.concatenate([np.repeat(touched, self.k), item])
        score = np.concatenate([self.score[touched].ravel(), score])
        known = np.concatenate([self.known[touched].ravel(), known])
        key = np.concatenate([self.key[touched].ravel(), key])
        order = np.lexsort((key, known, -score, item))
        top = order[np.searchsorted(item[order], touched)[:, None] + np.arange(self.k)]
        self.score[touched], self.known[touched], self.key[touched] = score[top], known[top], key[top]


class Scorer:
    """Adds up the weights of indexed terms for documents, and keeps the heaps of a task."""

    def __init__(self, index: Index, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> None:
        self.index, self.weights, self.n_docs, self.n_terms = index, weights, n_docs, n_terms
        self.heaps = Heaps(index.n_items, k)
        # the postings once more by item, light terms first
        item = index.posting_item
        term = np.repeat(np.arange(len(weights)), np.diff(index.posting_begin))
        order = np.lexsort((term, weights[term], item))
        self.item_term = term[order]
        self.item_begin = np.searchsorted(item[order], np.arange(index.n_items + 1))
        self.place = np.empty(len(order), np.int64)  # of each posting of a term among those of its item
        self.place[order] = np.arange(len(order))

    def add(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray, key: np.ndarray) -> None:
        doc, term, count, n = term_counts(self.index, data, offsets)
        m = 10 + 90 * n * self.n_docs // max(self.n_terms, 1)
        share = self.weights[term] * (10**9 * count // (1000 * count + 8 * m[doc]))
        rows = max(1, CELLS // max(self.index.n_items, 1))
        for first in range(0, len(n), rows):
            low, high = np.searchsorted(doc, [first, first + rows])
            self.compare(doc[low:high] - first, term[low:high], share[low:high], min(rows, len(n) - first),
                         known[first: first + rows], key[first: first + rows])

    def compare(self, doc: np.ndarray, term: np.ndarray, share: np.ndarray, n_rows: int,
                known: np.ndarray, key: np.ndarray) -> None:
        """Bring the documents of a chunk into the heaps; (doc, term) are in order."""
        index, items = self.index, self.index.n_items
        floor = self.heaps.floor()
        # the most that each term brings to any document of this chunk bounds what an item's light terms can bring
        most = np.zeros(len(self.weights), np.int64)
        np.maximum.at(most, term, share)
        total = np.cumsum(most[self.item_term])
        before = np.concatenate([[0], total])[self.item_begin[:-1]]
        item_of = np.repeat(np.arange(items), np.diff(self.item_begin))
        light = total - before[item_of] < floor[item_of]  # a first stretch of each item's terms
        n_light = np.bincount(item_of[light], minlength=items)
        rest = np.concatenate([[0], total])[self.item_begin[:-1] + n_light] - before  # what they can bring at most
        # every document with another term of an item is scored for it
        length = np.diff(index.posting_begin)[term]
        posting = spread(index.posting_begin[term], length)
        heavy = ~light[self.place[posting]]
        cell = (np.repeat(doc, length) * items + index.posting_item[posting])[heavy]
        cells = np.zeros(n_rows * items, np.int64)
        np.add.at(cells, cell, np.repeat(share, length)[heavy])
        chosen = np.flatnonzero(cells)
        item = chosen % items
        enters = cells[chosen] + rest[item] >= floor[item]
        chosen, item = chosen[enters], item[enters]
        # the light terms of those that can still enter
        of = chosen // items
        width = len(self.weights)
        pairs = doc * width + term
        wanted = np.repeat(of, n_light[item]) * width + self.item_term[spread(self.item_begin[item], n_light[item])]
        at = np.minimum(np.searchsorted(pairs, wanted), max(len(pairs) - 1, 0))
        hit = pairs[at] == wanted if len(pairs) else np.zeros(0, bool)
        score = cells[chosen]
        np.add.at(score, np.repeat(np.arange(len(chosen)), n_light[item])[hit], share[at[hit]])
        good = (score >= floor[item]) & (score > 0)
        if good.any():
            self.heaps.put(item[good], score[good], known[of[good]], key[of[good]])


# --- Spark -------------------------------------------------------------------------------------------

def collection_counts(docs: DataFrame, index, text: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and for each indexed term the documents that hold it.
    ``index`` is a broadcast :class:`Index`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        df, n_docs, n_terms = np.zeros(len(known.hashes), np.int64), 0, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets):
                _, term, _, n = term_counts(known, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                df += np.bincount(term, minlength=len(df))
                n_docs += int((n > 0).sum())
                n_terms += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *seen], pa.int64()), pa.array([n_docs, n_terms, *df[seen]], pa.int64())], names=["term", "n"])

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(count, "term long, n long")
    total = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each indexed term
    numbers, sums = total["term"].to_numpy(), total["n"].to_numpy()
    facts = dict(zip(numbers[numbers < 0].tolist(), sums[numbers < 0].tolist()))
    df = np.zeros(len(index.value.hashes), np.int64)
    df[numbers[numbers >= 0]] = sums[numbers >= 0]
    return facts.get(-1, 0), facts.get(-2, 0), df


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def numbered_items(items: DataFrame, text: str, item_key: str) -> DataFrame:
    """``no, block, item, text``: items with terms to come, numbered, in blocks of ``INDEX_BYTES`` of text."""
    rows = items.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{item_key}`").alias("item"), F.col(f"`{text}`").alias("text"))
    size = F.octet_length("text").cast("long") + 1  # so every item begins at a place of its own
    placed = running_total(rows, [F.col("item"), F.xxhash64("text")], size, "no")
    return placed.select("no", F.floor(F.col("no") / INDEX_BYTES).alias("block"), "item", "text")


def search_block(docs: DataFrame, block: DataFrame, k: int, text: str, key: str) -> DataFrame:
    """``part, no, key, score``: the heaps of every task for the items of one block."""
    spark = docs.sparkSession
    held = block.select("no", "text").orderBy("no").toArrow()  # bounded by INDEX_BYTES and one text
    numbers = held["no"].to_numpy()
    index = spark.sparkContext.broadcast(Index.of(held["text"].combine_chunks()))
    n_docs, n_terms, df = collection_counts(docs, index, text)
    weights = term_weights(n_docs, df)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, part = Scorer(index.value, weights, n_docs, n_terms, k), None
        for batch in batches:
            part = batch.column(0)[:1] if part is None and len(batch) else part
            data, offsets = text_bytes(batch.column(2))
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            keys = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                scorer.add(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], known[i:j], keys[i:j])
        if part is not None:
            heaps = scorer.heaps
            row, place = np.nonzero(heaps.score > 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(row), part[0].as_py()), pa.int32()), pa.array(numbers[row], pa.int64()),
                pa.array(heaps.key[row, place], pa.int64(), mask=~heaps.known[row, place]),
                pa.array(heaps.score[row, place], pa.int64()),
            ], names=["part", "no", "key", "score"])

    rows = docs.select(
        F.spark_partition_id().alias("part"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(best, "part int, no long, key long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """The ``k`` best documents of every item, of all documents: ``item_key``, ``rank`` (from 1), ``key``, ``score``."""
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("keys of documents have to be whole numbers")
    known = numbered_items(items, item_text, item_key)
    blocks = sorted(r["block"] for r in known.select("block").distinct().collect())  # one row for each block
    found = None
    for number in blocks or [0]:
        heaps = search_block(docs, known.where(F.col("block") == number), k, text, key)
        found = heaps if found is None else found.union(heaps)

    def merged(rows: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy("no", *group).orderBy(F.col("score").desc(), F.col("key").asc_nulls_first())
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = merged(merged(found.withColumn("part", F.col("part") % GROUPS), "part").drop("rank", "part"))
    return best.join(known.select("no", "item"), "no").select(
        F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")
