"""Packing documents into sequences along a space-filling curve.

Token counts of a document, hashed and projected to a few dimensions, give a point; its place on the
Hilbert curve is the sort key. Documents are laid end to end in that order and the stream is cut every
``length`` tokens, so a sequence holds documents that are near each other and nothing is padded. What
is left at the end is cut at powers of two.

The stream's positions come from light rows (key and token count); tokens are stored once and move
once, to meet the position of their document.

Nulls and odd input: a null or empty text is its end token alone; ties on the curve are put in order
by a hash of the document, then arbitrarily; each of several equal rows is packed on its own; a null
key stays null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.common import forgets, mix, running_total, stored, tidy

LENGTH = 2048
END = 1
DIMENSIONS = 4
BITS = 15
HASHED = 256
MEMO = 500_000  # a Python worker remembers at most twice as many words


@functools.cache
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of words, remembered. White space always separates tokens, so a text's ids are the
    ids of its words in a row; a word's are those of its letters and of the mark that follows.

    New words of letters only are encoded many at a time. Where the vocabulary marks the end of a word,
    each of them has one such token, so the ids fall apart into words again.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}  # the generation before; words still in use move up
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def ask(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed."""
        out: list[bytes] = []
        for first in range(0, len(words), 500):
            part = words[first: first + 500]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids) and all(map(str.isalpha, part)):
                packed, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
                cuts = [0, *(stops * width).tolist()]
                out.extend(packed[i:j] for i, j in zip(cuts, cuts[1:]))
            else:
                for found in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                    out.append(np.array(found.ids, self.kind).tobytes())
        return out

    def learn(self, words: set[str]) -> None:
        """Remember the ids of new words."""
        memo, older, letters, others, marked = self.memo, self.older, set(), set(), []
        for word in words:
            if (known := older.get(word)) is not None:
                memo[word] = known
                continue
            if word.isalpha():
                letters.add(word)
            elif word[-1] in ",." and (body := word[:-1]).isalpha():
                marked.append((word, body, word[-1]))
                if body not in memo:
                    if (known := older.get(body)) is not None:
                        memo[body] = known
                    else:
                        letters.add(body)
            else:
                others.add(word)
        others.update({",", "."} - memo.keys())
        for ask in (list(letters), list(others)):
            memo.update(zip(ask, self.ask(ask)))
        for word, body, mark in marked:
            memo[word] = memo[body] + memo[mark]

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and the end token, as packed integers."""
        tail = np.array([end], self.kind).tobytes()
        out = []
        for first in range(0, len(texts), 1000):
            if len(self.memo) > MEMO:
                self.memo, self.older = {"": b""}, self.memo
            memo, parts, holes = self.memo, [], []
            for text in texts[first: first + 1000]:
                words = simple_case(text).replace("\n", " ").split(" ")
                ids = list(map(memo.get, words))
                if None in ids:
                    holes.append((ids, [(i, words[i]) for i, x in enumerate(ids) if x is None]))
                ids.append(tail)
                parts.append(ids)
            self.learn({w for _, spots in holes for _, w in spots})
            for ids, spots in holes:
                for i, word in spots:
                    ids[i] = memo[word]
            out.extend(map(b"".join, parts))
        return out


@functools.cache
def word_ids(path: str) -> WordIds:
    """What this Python worker has learned; it serves many tasks."""
    return WordIds(path)


forgets(word_ids.cache_clear)


def simple_case(text: str) -> str:
    """Lower case where that can't differ from the tokenizer's own: one byte a character, and no
    special token whose case counts. Fewer different words are to be learned then."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates below 2^bits (rows x dimensions).

    Each level of the curve is a reflected and turned copy of the whole; undoing that from the top
    bit down and taking Gray codes back leaves the bits of the place, dimension by dimension.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(dims):
            on = (x[i] >> level & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level & 1)
    return key


def projection(vocabulary: int, dimensions: int) -> np.ndarray:
    """For each token: the projection of its hashed unit vector (a bucket and a sign)."""
    matrix = np.random.default_rng(11).normal(size=(HASHED, dimensions))
    hashed = mix(np.arange(1, vocabulary + 1, dtype=np.uint64))
    sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
    return (matrix[(hashed % np.uint64(HASHED)).astype(np.int64)] * sign[:, None]).astype(np.float32)


def curve_keys(ids: np.ndarray, offsets: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert key of each document from the mean of its tokens' vectors."""
    # no document is without a token, so every stretch between offsets has a sum
    total = np.add.reduceat(table[ids], offsets[:-1], axis=0, dtype=np.float64)
    mean = total / np.maximum(np.diff(offsets), 1)[:, None]
    grid = (np.tanh(3 * mean) + 1) / 2 * ((1 << bits) - 1)
    return hilbert_key(np.round(grid).astype(np.int64), bits)


def tokenize(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``doc_id, k, k2, text`` -> ``doc_id, k, k2, n_tokens, curve, ids`` (packed, width by vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        table = projection(words.tokenizer.get_vocab_size() + 1, DIMENSIONS)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                if not part.num_rows:
                    continue
                packed = words.encode(part.column(3).to_pylist(), end)
                ids = np.frombuffer(b"".join(packed), words.kind)
                n = np.array([len(p) for p in packed]) // words.kind.itemsize
                keys = curve_keys(ids, np.concatenate([[0], np.cumsum(n)]), table, BITS)
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:3], pa.array(n), pa.array(keys), pa.array(packed, pa.binary()),
                ], names=["doc_id", "k", "k2", "n_tokens", "curve", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run, keep=True), f"doc_id {kind}, k long, k2 long, n_tokens long, curve long, ids binary")


def cut(placed: DataFrame, path: str, length: int, total: int) -> DataFrame:
    """Cut documents that know their place in the stream into pieces."""
    full, rest = divmod(total, length)
    edges = [full * length]  # ends of the sequences; those after the full ones have powers of two
    for bit in range(length.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    edges = np.array(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = word_ids(path).kind
        for batch in batches:
            cols = {"doc": [], "start": [], "length": [], "tokens": [], "sequence": [], "offset": [], "ids": []}
            number, place, blobs = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for row, (n, at, blob) in enumerate(zip(number, place, blobs)):
                ids = np.frombuffer(blob, kind).astype("<u4")
                done = 0
                while done < n:
                    here = at + done
                    if here < edges[0]:
                        sequence, begin = here // length, here // length * length
                        stop = begin + length
                    else:
                        i = int(np.searchsorted(edges, here, "right"))
                        sequence, begin, stop = full + i - 1, int(edges[i - 1]), int(edges[i])
                    size = min(n - done, stop - here)
                    for name, value in zip(cols, (
                        row, done, size, n, sequence, here - begin, ids[done: done + size].tobytes(),
                    )):
                        cols[name].append(value)
                    done += size
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(cols["doc"], pa.int64())),
                *(pa.array(cols[c], pa.int64()) for c in list(cols)[1:-1]),
                pa.array(cols["ids"], pa.binary()),
            ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(tidy(run, keep=True), (
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    ))


def pack(
    docs: DataFrame,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    length: int = LENGTH,
    end: int = END,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit integers. ``start`` counts the document's tokens before
    the piece, ``offset`` the tokens before it in its sequence.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence has to be a power of two")
    # two hashes of the whole row are its identity; the window and the join then share one exchange
    whole = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("k"), F.xxhash64(F.lit(1), text, key).alias("k2"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    tokens = stored(tokenize(whole, path, end), "tokens")
    # equal rows lie next to each other in the stream
    light = tokens.groupBy("k", "k2").agg(
        F.count("*").alias("copies"), F.max("n_tokens").alias("n"), F.max("curve").alias("curve"))
    order = [F.col("curve"), F.xxhash64("k"), F.col("k"), F.col("k2")]
    light = running_total(light, order, F.col("n") * F.col("copies"), "place")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    same = Window.partitionBy("k", "k2").orderBy("k")
    numbered = tokens.withColumn("copy", F.row_number().over(same) - 1)
    placed = numbered.join(light.select("k", "k2", "place"), ["k", "k2"]).select(
        "doc_id", "n_tokens", (F.col("place") + F.col("copy") * F.col("n_tokens")).alias("place"), "ids")
    return cut(placed, path, length, total)
