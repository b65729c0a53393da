"""Fingerprints of documents from their improbable features, and the likeness of two fingerprints.

1. A feature is a window of 32 bytes. Its entropy falls into one of 1,001 classes. How many windows of the whole
   collection lie in each class is counted once (``rarity``); the fewer, the lower the rank of the class. Windows of
   next to no entropy (class below 100: runs and rulers) come last, however few they are.
2. Over any 32 neighbouring windows the one of lowest rank, the leftmost of equals, is the most improbable. A
   window that is it at least 8 times is selected, and in any text the one that is it most often. A text of less than
   128 bytes has too few windows to choose from: there the features are all its windows of 8 bytes.
3. Selected features, each once and in order, go into a chain of Bloom filters of 2,048 bits with 5 bits for a
   feature. After 160 features the next filter of the chain begins, so the digest grows with the text.
4. Two filters are compared by their overlap: bits in common, less those that two such filters share by chance, over the
   mean number of bits, less the same. Every filter of either chain counts with its best partner in the other one,
   weighted by its features. Equal chains have likeness 1.

Entropies are sums of integers, so a window has the same class wherever it lies, and equal texts have equal
fingerprints. A fingerprint is the chain's filters, each a byte with its number of features and 256 bytes,
in base64.

Nulls and odd input: a null text is empty, an empty text has the empty fingerprint; two empty ones have likeness
1, an empty and another one 0; a null fingerprint has a null likeness. A text of less than 8 bytes is one feature. Repeated
rows are rows of their own. Other columns stay; a new column replaces one of its name. A text longer than a
megabyte is worked through in parts, with the result of the whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.common import mix, slices, stored, text_bytes

WINDOW = 32  # bytes of a feature
REACH = 32  # neighbouring windows that are ranked together, a power of two
POPULAR = 8  # so often has a window to be the most improbable one
SHORT, SHORT_WINDOW = 128, 8  # bytes of a text that has too few windows, and of its features
TOP = 1000  # classes of entropy are 0 to TOP
WEAK = 100  # classes below have next to no entropy
BITS, HASHES, PER_FILTER = 2048, 5, 160
RECORD = 1 + BITS // 8
PART = 1 << 20  # bytes that are worked on at a time
BLOCK = 1 << 16  # bytes that stay in the processor's cache
SCALE = 1024

_count = np.arange(1, WINDOW + 1)
# c * log2(c), the part of the entropy of a byte value that occurs c times, as integers
SHARE = np.concatenate([[0], np.rint(_count * np.log2(_count) * SCALE)]).astype(np.int32)
STEP = np.diff(SHARE)


# --- improbable features ---------------------------------------------------------------------------

def near_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the ``WINDOW - 1`` bytes before, and after, each byte are equal to it."""
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for low in range(0, len(data), BLOCK):
        high = min(len(data), low + BLOCK)
        for k in range(1, min(WINDOW, high)):
            first = max(low, k)
            same = (data[first:high] == data[first - k: high - k]).view(np.uint8)
            before[first:high] += same
            after[first - k: high - k] += same
    return before, after


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The class of the window that begins at each byte (0 to ``TOP``)."""
    places = len(data) - WINDOW + 1
    if places < 1:
        return np.zeros(0, np.int64)
    before, after = near_counts(data)
    sums = np.empty(places, np.int64)
    sums[0] = SHARE[np.bincount(data[:WINDOW])].sum()
    # a window moves on by a byte: one value occurs once more, one once less
    np.cumsum(STEP[before[WINDOW:]] - STEP[after[: places - 1]], out=sums[1:])
    sums[1:] += sums[0]
    full = int(SHARE[WINDOW])
    return TOP * (full - sums) // full


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the stretches, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + shift if total else np.zeros(0, np.int64)


def most_improbable(ranks: np.ndarray, width: int) -> np.ndarray:
    """The place of the lowest, leftmost rank among ``width`` (a power of two) from each place on."""
    keys = (ranks.astype(np.uint32) << np.uint32(22)) | np.arange(len(ranks), dtype=np.uint32)
    size = 1
    while size < width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return (keys & np.uint32((1 << 22) - 1)).astype(np.int64)


def runs(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted array and how often (or with which weight) they occur."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if weights is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(weights, first)


def selected(data: np.ndarray, offsets: np.ndarray, ranks_of: np.ndarray) -> np.ndarray:
    """Places of the selected windows of all texts of at least ``SHORT`` bytes, in order. More than
    ``PART`` bytes are one text."""
    sizes = np.diff(offsets)
    places = np.where(sizes < SHORT, 0, sizes - (WINDOW + REACH - 2))  # where a whole row of windows begins
    found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(data), PART):
        part = data[low: low + PART + WINDOW + REACH - 2]
        ranks = ranks_of[entropy_classes(part)]
        if len(ranks) < REACH:
            continue
        lowest = most_improbable(ranks, REACH)[:PART]
        begin = np.clip(offsets[:-1] - low, 0, len(lowest))
        end = np.clip(offsets[:-1] + places - low, 0, len(lowest))
        place, count = runs(lowest[spans(begin, end - begin)])
        found.append(place + low)
        counts.append(count)
    place, count = runs(np.concatenate(found), np.concatenate(counts))
    text = np.searchsorted(offsets, place, "right") - 1
    popular = count >= POPULAR
    best = np.lexsort((place, -count, text))  # the one that is chosen most often, of each text
    popular[best[np.concatenate([[True], text[best][1:] != text[best][:-1]])[: len(best)]]] = True
    return place[popular]


def feature_hashes(windows: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of each row of bytes (a multiple of eight)."""
    words = np.ascontiguousarray(windows).view("<u8")
    total = np.zeros(len(words), np.uint64) + np.asarray(sizes, np.uint64)
    for column in range(words.shape[1]):
        total = mix(total ^ words[:, column]) + np.uint64(column + 1)
    return mix(total)


def features(data: np.ndarray, offsets: np.ndarray, ranks_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the features of all texts, in order, each feature once for a text."""
    place = np.concatenate([np.zeros(0, np.int64), *[
        selected(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], ranks_of) + offsets[i]
        for i, j in slices(offsets, PART)]])
    hashes = feature_hashes(data[place[:, None] + np.arange(WINDOW)], WINDOW)
    sizes = np.diff(offsets)
    widths = np.where(sizes < SHORT, np.minimum(sizes, SHORT_WINDOW), 0)
    windows = np.where(widths > 0, sizes - widths + 1, 0)
    small = spans(offsets[:-1], windows)  # every window of the short texts
    width = np.repeat(widths, windows)
    padded = np.zeros((len(small), SHORT_WINDOW), np.uint8)
    for i in range(SHORT_WINDOW):
        padded[width > i, i] = data[small[width > i] + i]
    place, hashes = np.concatenate([place, small]), np.concatenate([hashes, feature_hashes(padded, width)])
    order = np.argsort(place, kind="stable")
    place, hashes = place[order], hashes[order]
    text = np.searchsorted(offsets, place, "right") - 1
    order = np.lexsort((place, hashes, text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (text[order][1:] != text[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    kept = np.sort(order[fresh])
    return text[kept], hashes[kept]


# --- chained Bloom filters -------------------------------------------------------------------------

def chains(data: np.ndarray, offsets: np.ndarray, ranks_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter records of all texts (a byte with the number of features, then the bits), and where each
    text's chain begins (with the end at last)."""
    text, hashes = features(data, offsets, ranks_of)
    per_text = np.bincount(text, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(-(-per_text // PER_FILTER))])
    number = np.arange(len(text)) - (np.cumsum(per_text) - per_text)[text]
    filter_no = begin[text] + number // PER_FILTER
    records = np.zeros((begin[-1], RECORD), np.uint8)
    records[:, 0] = np.bincount(filter_no, minlength=begin[-1])
    for i in range(HASHES):
        bit = ((hashes >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(records, (filter_no, 1 + bit // 8), (1 << (bit % 8)).astype(np.uint8))
    return records, begin


def likenesses(records: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of pairs of chains; ``a`` and ``b`` are rows of (first record, end)."""
    weights = records[:, 0].astype(np.float64)
    words = np.ascontiguousarray(records[:, 1:]).view(np.uint64)
    bits = np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(np.float64)

    def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        common = np.bitwise_count(words[x] & words[y]).sum(axis=1, dtype=np.int64)
        chance, mean = bits[x] * bits[y] / BITS, (bits[x] + bits[y]) / 2
        room = mean - chance
        shown = np.divide(common - chance, room, out=np.zeros(len(x)), where=room > 0)
        return np.where(room > 0, np.clip(shown, 0, 1), (common == mean) * 1.0)

    out = np.zeros(len(a))
    for i, ((a0, a1), (b0, b1)) in enumerate(zip(a.tolist(), b.tolist())):
        if a1 - a0 == b1 - b0 == 1:
            continue  # below, all at once
        if a1 == a0 or b1 == b0:
            out[i] = float(a1 - a0 == b1 - b0)
            continue
        theirs, best_theirs, best_ours = np.arange(b0, b1), np.zeros(b1 - b0), np.zeros(a1 - a0)
        for x in range(a0, a1):
            alike = similar(np.full(len(theirs), x), theirs)
            best_ours[x - a0] = alike.max()
            np.maximum(best_theirs, alike, out=best_theirs)
        shared = (weights[a0:a1] * best_ours).sum() + (weights[b0:b1] * best_theirs).sum()
        out[i] = shared / (weights[a0:a1].sum() + weights[b0:b1].sum())
    single = np.flatnonzero((a[:, 1] - a[:, 0] == 1) & (b[:, 1] - b[:, 0] == 1))
    out[single] = similar(a[single, 0], b[single, 0])
    return out


def pack_texts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), offsets


# --- Spark -------------------------------------------------------------------------------------------

def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each class of entropy: the rarest class among the windows of all texts has rank 0, weak
    classes come last. One pass that adds up at most 1,001 counts for each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOP + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets, PART):
                inner, base = offsets[i: j + 1] - offsets[i], offsets[i]
                windows = np.maximum(np.diff(inner) - WINDOW + 1, 0)
                for low in range(0, int(inner[-1]), PART):
                    part = data[base + low: min(base + low + PART + WINDOW - 1, offsets[j])]
                    classes = entropy_classes(part)
                    begin = np.clip(inner[:-1] - low, 0, len(classes))
                    end = np.clip(inner[:-1] + windows - low, 0, len(classes))
                    total += np.bincount(classes[spans(begin, end - begin)], minlength=TOP + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["class", "n"])

    counts = docs.select(F.col(f"`{text}`")).mapInArrow(count, "class int, n long")
    rows = counts.groupBy("class").agg(F.sum("n").alias("n")).collect()  # one row for each class
    total = np.zeros(TOP + 1, np.int64)
    for row in rows:
        total[row["class"]] = row["n"]
    classes = np.arange(TOP + 1)
    order = np.lexsort((classes, total, classes < WEAK))
    ranks = np.empty(TOP + 1, np.uint16)
    ranks[order] = classes
    return ranks


def fingerprint(text: Column, ranks_of: np.ndarray) -> Column:
    """The fingerprint of each text, by ranks from ``rarity``. Nothing is shuffled."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = text_bytes(texts)
            records, begin = chains(data, offsets, ranks_of)
            yield pa.array([as_text(records[x:y]) for x, y in zip(begin, begin[1:])], pa.string())

    return run(text)


def as_text(records: np.ndarray) -> str:
    return base64.b64encode(records.tobytes()).decode()


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            given = left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False)
            raw = [base64.b64decode(x or "") for column in (left, right) for x in column.to_pylist()]
            end = np.cumsum([len(r) // RECORD for r in raw], dtype=np.int64)
            begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
            ends = np.stack([begin, end], axis=1)
            records = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, RECORD)
            found = likenesses(records, ends[: len(left)], ends[len(left):])
            yield pa.array(found, pa.float64(), mask=~given)

    return run(a, b)


# --- how well fingerprints tell edited texts from other ones --------------------------------------------

RESULT = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
          "near_edited": "double", "near_next": "double"}


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def try_edits(texts: list[str], ranks_of: np.ndarray) -> dict[str, list]:
    """The columns of ``RESULT`` for each text of a row of neighbours but the last one."""
    changed = [edited(t, f) for t, f in zip(texts, texts[1:])]
    parts, begins, done = [], [], 0
    for group in (texts, changed):
        data, offsets = pack_texts(group)
        records, begin = chains(data, offsets, ranks_of)
        parts.append(records)
        begins.append(np.stack([begin[:-1], begin[1:]], axis=1) + done)
        done += len(records)
    records, (own, other) = np.concatenate(parts), begins
    return {
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [as_text(records[x:y]) for x, y in own[:-1]],
        "edited_fingerprint": [as_text(records[x:y]) for x, y in other],
        "near_edited": likenesses(records, own[:-1], other),
        "near_next": likenesses(records, own[:-1], own[1:]),
    }


def edit_trial(docs: DataFrame, ranks_of: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited version, whose last quarter comes from the next document in
    ascending order of the key (after the last: the first): ``key`` and the columns of ``RESULT``.

    Rows are dealt by range of the key, with a hash of the text behind it that splits a repeated key, and each range is
    read in order with one text of outlook. Texts move once; the last text of a range meets the first one of the next
    range in a join of one row for each range.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole)
    order = [F.col("key"), F.xxhash64("text")]  # samples of these go to the driver, so texts are not among them
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    kind = rows.schema["key"].dataType.simpleString()
    fields = {"part": "int", "key": kind, **RESULT, "first_text": "string", "last_text": "string"}
    ddl = ", ".join(f"{n} {t}" for n, t in fields.items())

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = keys = None
        held: list[str] = []  # the last text so far
        for batch in batches:
            part, column = batch.column(0)[:1], batch.column(2)
            keys = batch.column(1) if keys is None else pa.concat_arrays([keys, batch.column(1)])
            _, offsets = text_bytes(column)
            for i, j in slices(offsets, PART):
                group = held + column[i:j].to_pylist()
                first = group[0] if first is None else first
                held = group[-1:]
                if len(group) > 1:
                    made = try_edits(group, ranks_of)
                    n = len(group) - 1
                    yield record(pa.concat_arrays([part] * n), keys[:n], made, pa.nulls(n, pa.string()), pa.nulls(n, pa.string()))
                    keys = keys[n:]
        if held:
            yield record(part, keys, dict.fromkeys(RESULT, [None]), pa.array([first]), pa.array(held))

    def record(part: pa.Array, keys: pa.Array, made: dict[str, list], first: pa.Array, last: pa.Array) -> pa.RecordBatch:
        types = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        columns = [pa.array(made[n], t) for n, t in zip(RESULT, types)]
        return pa.RecordBatch.from_arrays([part, keys, *columns, first, last], names=list(fields))

    tried = stored(ranged.select(F.spark_partition_id().alias("part"), "key", "text").mapInArrow(in_order, ddl), "edits")
    ends = tried.where("last_text is not null")  # one row for each range
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = ends.select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(along)).alias("next"))
    heads = ends.select(F.col("part").alias("next"), F.col("first_text").alias("following"))
    borders = ends.join(follows, "part").join(heads, "next").select("key", F.col("last_text").alias("text"), "following")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, f) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                yield record(pa.nulls(1, pa.int32()), batch.column(0)[i: i + 1], try_edits([t, f], ranks_of),
                             pa.nulls(1, pa.string()), pa.nulls(1, pa.string()))

    inner = tried.where("last_text is null")
    return inner.union(borders.mapInArrow(across, ddl)).select(F.col("key").alias(key), *RESULT)
