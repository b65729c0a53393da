"""Removal of long repeated strings by merging Burrows-Wheeler transforms.

A string of ``length`` bytes that starts at two places holds the same anchor at both: the smallest
hash among its short grams. So only the surroundings of anchors that occur twice can hold repeats,
and each is a string of its own, aligned at the anchor. Whatever repeats lies in the same column of
two such strings.

1. Each batch of texts is a shard. Its anchors are counted; those seen twice, here or elsewhere, stay.
2. Each shard writes the strings around them as a Burrows-Wheeler transform, column by column: the
   symbols that precede the suffixes, in the order of the suffixes. Equal strings enter once.
3. For each share of the anchors, the transforms of all shards are merged. The interleave, which
   names the shard of each suffix in the merged order, is refined once for each column: it yields
   the symbols, and distributing them keeps the order for the next column. No suffix is sorted or
   compared again. The first differing column of neighbours is carried along as a range minimum, so
   common prefixes are known at every column; two suffixes that share ``length`` bytes mark a repeat.
4. Marked strings become spans of bytes of each text.

Equal texts take part once where they lie together. A shard sends a hash once for counting, and equal
surroundings once with the list of their places, so copies collapse before they meet. Anchors that
occur more than ``hot`` times (the most frequent ``HOT_ANCHORS`` of them; no other can then hold more
than that fraction of all anchors) are told apart further: the strings are cut by start position and
dealt by the hash of the stretch that all strings of a cut share.

Nulls and odd input: a null text is an empty text; texts shorter than ``length`` have no spans; rows
with equal texts lose all their bytes if they are long enough; a null key is returned as it is; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import checkpoint, mix, prefix_hash, slices, span_hash, text_bytes, tidy

LENGTH = 200
GRAM = 50
#: Shares of the anchors are merged together up to about this many strings.
MERGED_STRINGS = 40_000
SHARES = 8  # shares of the anchors for each shuffle partition
PENDING_BYTES = 12_000_000  # strings that a shard holds before it transforms them
ALIGNED = 4_000  # strings whose places are worked out at a time
HOT = 50_000
HOT_ANCHORS = 1_000_000  # bounds what is broadcast: 8 bytes each
CUT = 8  # start positions that a cut of a hot anchor covers

ABSENT = 256  # stands before and after a string; sorts last and equals nothing
ANCHOR = np.dtype([("hash", "<u8"), ("key", "<i8"), ("at", "<i4"), ("many", "<i4")])
STRING = np.dtype([("group", "<u8"), ("left", "<i4"), ("right", "<i4"), ("many", "<i4")])
PLACE = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("at", "<i4")])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values: running minima inside blocks, from both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1: width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Position and hash of every anchor: the smallest gram of some string of ``length`` bytes that
    lies in one text. Equal smallest grams are all anchors."""
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = prefix_hash(data)
    n = len(data) - gram + 1
    spot = np.arange(n)
    grams = span_hash(total, spot, spot + gram)
    low = sliding_min(grams, width)
    # strings that reach into the next text have no say
    inside = np.ones(len(low), bool)
    for end in offsets[1:-1]:
        inside[max(0, end - length + 1): end] = False
    low[~inside] = 0
    top = np.full(n + width - 1, 0, np.uint64)
    top[width - 1: width - 1 + len(low)] = low
    highest = ~sliding_min(~top, width)
    chosen = np.flatnonzero((highest == grams) & (highest != 0))
    return chosen, grams[chosen]


def share_of(hashes: np.ndarray, shares: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(shares)).astype(np.int64)


def by_share(shares: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shares, kind="stable")
    ordered = shares[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else []
    for start, end in zip(cuts, [*cuts[1:], len(order)]):
        yield int(ordered[start]), order[start:end]


def first_of_each(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def find_anchors(docs: DataFrame, length: int, gram: int, shares: int) -> DataFrame:
    """Rows ``share, known, blob`` of packed anchors.

    Each shard sends every hash once, with its count, to the share that the hash belongs to. Places of
    hashes that it has seen twice itself are known to stay and travel apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            found = [np.zeros(0, ANCHOR)]
            for lo, hi in slices(offsets):
                starts = offsets[lo: hi + 1] - offsets[lo]
                at, hashes = anchors(data[offsets[lo]: offsets[hi]], starts, length, gram)
                doc = np.searchsorted(starts, at, "right") - 1
                rows = np.zeros(len(at), ANCHOR)
                rows["hash"], rows["key"], rows["at"] = hashes, keys[lo + doc], at - starts[doc]
                found.append(rows)
            rows = np.concatenate(found)
            rows = rows[np.lexsort((rows["at"], rows["key"], rows["hash"]))]
            rows = rows[first_of_each(rows["hash"], rows["key"], rows["at"])]  # equal texts once
            first = np.flatnonzero(first_of_each(rows["hash"]))
            rows["many"] = np.repeat(np.diff(np.append(first, len(rows))), np.diff(np.append(first, len(rows))))
            told, again = rows[first], rows[rows["many"] > 1]
            out = [(s, False, told[i].tobytes()) for s, i in by_share(share_of(told["hash"], shares))]
            for start in range(0, len(again), 65_536):
                turn += 1
                spread = int(mix(again["hash"][start: start + 1])[0]) + turn
                out.append((spread % shares, True, again[start: start + 65_536].tobytes()))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.bool_()),
                pa.array([r[2] for r in out], pa.binary()),
            ], names=["share", "known", "blob"])

    return docs.mapInArrow(tidy(run), "share int, known boolean, blob binary")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each share; the partition is sorted by share, the first column."""
    share, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[0] != share and rows:
                yield share, rows
                rows = []
            share = row[0]
            rows.append(row)
    if rows:
        yield share, rows


def repeated_anchors(found: DataFrame, hot: int) -> DataFrame:
    """``key, at`` of anchors whose hash occurs at two places; ``hash, many`` of hot ones."""

    def batch_of(key=(), at=(), hashes=(), many=()):
        n, h = len(key), len(hashes)
        return pa.RecordBatch.from_arrays([
            pa.array([*key, *[None] * h], pa.int64()), pa.array([*at, *[None] * h], pa.int32()),
            pa.array([*[None] * n, *hashes], pa.int64()), pa.array([*[None] * n, *many], pa.int64()),
        ], names=["key", "at", "hash", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(batches):
            for _, known, blob in blobs:
                if known:
                    rows = np.frombuffer(blob, ANCHOR)
                    yield batch_of(rows["key"].tolist(), rows["at"].tolist())
            rows = np.concatenate(
                [np.zeros(0, ANCHOR), *(np.frombuffer(b, ANCHOR) for _, known, b in blobs if not known)])
            rows = rows[np.lexsort((rows["at"], rows["key"], rows["hash"]))]
            first = np.flatnonzero(first_of_each(rows["hash"]))
            if not len(first):
                continue
            size = np.diff(np.append(first, len(rows)))
            places = first_of_each(rows["hash"], rows["key"], rows["at"]).astype(np.int64)
            several = (np.add.reduceat(places, first) > 1) | (np.maximum.reduceat(rows["many"], first) > 1)
            total = np.add.reduceat(rows["many"].astype(np.int64), first)
            stay = rows[np.repeat(several, size) & (rows["many"] == 1) & (places == 1)]
            top = total > hot
            yield batch_of(
                stay["key"].tolist(), stay["at"].tolist(),
                rows["hash"][first][top].view(np.int64).tolist(), total[top].tolist(),
            )

    return found.mapInArrow(tidy(run), "key long, at int, hash long, many long")


def shard_strings(data, starts, keys, texts, at, total, hot, length, gram):
    """The strings around anchors: where they lie, and what tells equal ones.

    ``texts`` and ``at`` name the anchors by text and position. Returns begin, anchor and end in
    ``data``, the group of each string and its text.
    """
    reach = length - gram
    spot = starts[texts] + at
    group = span_hash(total, spot, spot + gram)
    begin = np.maximum(spot - reach, starts[texts])
    end = np.minimum(spot + length, starts[texts + 1])
    is_hot = np.isin(group, hot) if len(hot) else np.zeros(len(spot), bool)
    parts = [(begin[~is_hot], spot[~is_hot], end[~is_hot], group[~is_hot], texts[~is_hot])]
    if is_hot.any():
        s, t, g = spot[is_hot], texts[is_hot], group[is_hot]
        for cut in range(0, reach + 1, CUT):
            width = min(CUT, reach + 1 - cut)
            b = np.maximum(s - cut - width + 1, starts[t])
            e = np.minimum(s - cut + length, starts[t + 1])
            ok = (e - b >= length) & (s - cut >= starts[t]) & (s - cut - width + 1 + length <= starts[t + 1])
            core = span_hash(total, s[ok] - cut, s[ok] - cut - width + 1 + length)
            parts.append((b[ok], s[ok], e[ok], mix(g[ok] + core + np.uint64(cut + 1)), t[ok]))
    begin, spot, end, group, texts = (np.concatenate(p) for p in zip(*parts))
    ok = end - begin >= length
    return begin[ok], spot[ok], end[ok], group[ok], texts[ok]


def transform(matrix: np.ndarray, strings: np.ndarray, reach: int) -> np.ndarray:
    """Burrows-Wheeler transform of aligned strings that are sorted by group.

    Row j of the result holds the symbols in column j, in the order of the suffixes that follow. Beyond
    the ends of a string, which its lengths tell, ``matrix`` has zeros that stand for ``ABSENT``.
    """
    width = matrix.shape[1]
    out = np.ascontiguousarray(matrix.T)
    block = np.cumsum(first_of_each(strings["group"])) - 1
    many = np.flatnonzero(np.bincount(block)[block] > 1) if len(block) else block
    if not len(many):
        return out
    start, stop = reach - strings["left"], reach + strings["right"]
    order, block = many.copy(), block[many].astype(np.int64)
    for j in range(width - 1, -1, -1):
        symbols = matrix[order, j]
        out[j, many] = symbols
        symbols = symbols.astype(np.int64)
        symbols[(j < start[order]) | (j >= stop[order])] = ABSENT
        key = block * 512 + symbols
        if (key[1:] < key[:-1]).any():
            order = order[np.argsort(key, kind="stable")]
    return out


def aligned(part: np.ndarray, begin: np.ndarray, spot: np.ndarray, end: np.ndarray, reach: int, width: int) -> np.ndarray:
    """The strings in rows, anchors in one column; zeros beyond their ends. Some rows at a time, as
    places take more room than bytes."""
    matrix = np.empty((len(spot), width), np.uint8)
    for first in range(0, len(spot), ALIGNED):
        rows = slice(first, first + ALIGNED)
        column = (spot[rows, None] - reach + np.arange(width)).astype(np.int32)
        there = (column >= begin[rows, None]) & (column < end[rows, None])
        np.clip(column, 0, len(part) - 1, out=column)
        matrix[rows] = part[column] * there
    return matrix


def shard_transforms(joined: DataFrame, length: int, gram: int, shares: int, hot: np.ndarray) -> DataFrame:
    """``doc_id, k1, k2, text, at`` (positions of anchors) -> ``share, blob``: a transform for each share."""
    reach = length - gram
    hot = joined.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            data, offsets = text_bytes(batch.column(3))
            positions = batch.column(4)
            values = positions.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(np.diff(positions.offsets.to_numpy()))])
            fresh = first_of_each(k1, k2)  # rows come sorted: an equal text is next to its copy
            if len(k1):
                fresh[0] = (k1[0], k2[0]) != last
                last = (k1[-1], k2[-1])
            shares_of: dict[int, list] = {}
            pending = 0
            for lo, hi in slices(offsets):
                starts = offsets[lo: hi + 1] - offsets[lo]
                part = data[offsets[lo]: offsets[hi]]
                texts = np.repeat(np.arange(hi - lo), np.diff(bounds[lo: hi + 1]))
                at = values[bounds[lo]: bounds[hi]]
                # an equal key of another text may bring positions that don't fit
                ok = fresh[lo + texts] & (at >= 0) & (starts[texts] + at + gram <= starts[texts + 1])
                if not ok.any():
                    continue
                total = prefix_hash(part)
                begin, spot, end, group, texts = shard_strings(
                    part, starts, None, texts[ok], at[ok], total, hot.value, length, gram)
                equal = mix(span_hash(total, begin, end) + mix(group + (spot - begin).astype(np.uint64)))
                order = np.lexsort((equal, group))
                begin, spot, end, group, texts, equal = (
                    x[order] for x in (begin, spot, end, group, texts, equal))
                new = first_of_each(group, equal)
                first = np.flatnonzero(new)
                strings = np.zeros(len(first), STRING)
                strings["group"] = group[first]
                strings["left"], strings["right"] = (spot - begin)[first], (end - spot)[first]
                strings["many"] = np.diff(np.append(first, len(new)))
                places = np.zeros(len(new), PLACE)
                places["k1"], places["k2"] = k1[lo + texts], k2[lo + texts]
                places["at"] = spot - starts[texts]
                matrix = aligned(part, begin[first], spot[first], end[first], reach, reach + length)
                number = np.cumsum(new) - 1
                for share, i in by_share(share_of(strings["group"], shares)):
                    mine = np.zeros(len(first), bool)
                    mine[i] = True
                    shares_of.setdefault(share, []).append((strings[i], places[mine[number]], matrix[i]))
                pending += matrix.nbytes
                if pending >= PENDING_BYTES:
                    yield transformed(shares_of)
                    shares_of, pending = {}, 0
            if shares_of:
                yield transformed(shares_of)

    def transformed(shares_of: dict[int, list]) -> pa.RecordBatch:
        out = []
        for share in sorted(shares_of):
            got = shares_of.pop(share)
            strings = np.concatenate([g[0] for g in got])
            order = np.argsort(strings["group"], kind="stable")
            number = np.repeat(np.arange(len(strings)), strings["many"])
            rank = np.argsort(order)[number]
            places = np.concatenate([g[1] for g in got])[np.argsort(rank, kind="stable")]
            strings = strings[order]
            columns = transform(np.concatenate([g[2] for g in got])[order], strings, reach)
            out.append((share, strings.tobytes(), places.tobytes(), zlib.compress(columns, 1)))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()),
             *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3))],
            names=["share", "strings", "places", "columns"])

    return joined.mapInArrow(tidy(run), "share int, strings binary, places binary, columns binary")


def merge(transforms: list[tuple[np.ndarray, np.ndarray]], length: int, gram: int) -> np.ndarray:
    """Merge the transforms of several shards; returns marks[start column, string] of repeats.

    Strings are numbered shard by shard. ``shard`` is the interleave: the shard of each suffix in the
    merged order. ``differ`` is the first column in which a suffix differs from the one before it.
    """
    reach = length - gram
    width = reach + length
    strings = np.concatenate([t[0] for t in transforms])
    columns = np.concatenate([t[1].reshape(width, -1) for t in transforms], axis=1)
    marks = np.zeros((reach + 1, len(strings)), bool)
    start, stop = reach - strings["left"], reach + strings["right"]
    # strings that came twice in a shard repeat as a whole
    several = strings["many"] > 1
    column = np.arange(reach + 1)[:, None]
    marks |= several & (column >= start) & (column + length <= stop)
    shard = np.repeat(np.arange(len(transforms)), [len(t[0]) for t in transforms])
    _, block, size = np.unique(strings["group"], return_inverse=True, return_counts=True)
    # whole groups of one string are left out; in their shards they stand apart from the others
    many = np.flatnonzero(size[block] > 1)
    if not len(many):
        return marks
    strings, start, stop = strings[many], start[many], stop[many]
    shard, block, columns = shard[many], block[many].astype(np.int64), columns[:, many]
    order = np.argsort(block, kind="stable")  # the first interleave: by group, then by shard
    name, shard, block = order.copy(), shard[order].astype(np.int32), block[order]
    if shard.max() < 1 << 15:
        shard = shard.astype(np.int16)
    begins = first_of_each(block)
    differ = np.where(begins, -1, width).astype(np.int32)
    for j in range(width - 1, -1, -1):
        symbol = np.empty(len(name), np.int64)
        symbol[np.argsort(shard, kind="stable")] = columns[j]  # next symbols of each shard in turn
        absent = (j < start[name]) | (j >= stop[name])
        symbol[absent] = ABSENT
        key = block * 512 + symbol
        if (key[1:] < key[:-1]).any():
            turn = np.argsort(key, kind="stable")
            gap = np.flatnonzero(np.diff(turn) != 1)
            moved = differ[turn]
            low, high = turn[gap] + 1, turn[gap + 1] + 1
            use = low < high
            if use.any():
                pairs = np.stack([low[use], high[use]], axis=1).ravel()
                moved[gap[use] + 1] = np.minimum.reduceat(np.append(differ, width), pairs)[::2]
            shard, name, key, absent = shard[turn], name[turn], key[turn], absent[turn]
            differ = moved
        unlike = np.concatenate([[True], key[1:] != key[:-1]]) | absent
        differ[unlike] = j
        differ[begins] = -1
        if j <= reach:
            long = differ >= j + length
            long[:-1] |= long[1:]
            marks[j, many[name[long]]] = True
    return marks


def repeated_spans(transforms: DataFrame, length: int, gram: int) -> DataFrame:
    """``k1, k2, start, end``: stretches of texts that consist of repeated strings."""
    reach = length - gram

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        shards = [(np.frombuffer(r[1], STRING), np.frombuffer(zlib.decompress(r[3]), np.uint8)) for r in rows]
        places = np.concatenate([np.frombuffer(r[2], PLACE) for r in rows])
        strings = np.concatenate([s[0] for s in shards])
        marks = merge(shards, length, gram)
        edge = np.zeros((len(strings), reach + 3), np.int8)
        edge[:, 1:-1] = marks.T
        change = np.diff(edge, axis=1)
        string, begin = np.nonzero(change == 1)
        _, end = np.nonzero(change == -1)
        first = np.concatenate([[0], np.cumsum(strings["many"])])
        number = strings["many"][string]
        row = np.repeat(first[string], number) + (
            np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
        at = places["at"][row].astype(np.int64) - reach
        start, stop = at + np.repeat(begin, number), at + np.repeat(end, number) - 1 + length
        k1, k2 = places["k1"][row], places["k2"][row]
        # spans of a text that touch are one
        order = np.lexsort((start, k2, k1))
        k1, k2, start, stop = k1[order], k2[order], start[order], stop[order]
        text = np.cumsum(first_of_each(k1, k2)) << 40
        reached = np.maximum.accumulate(stop + text)
        new = np.ones(len(text), bool)
        new[1:] = (start + text)[1:] > reached[:-1]
        last = np.append(np.flatnonzero(new)[1:], len(text)) - 1 if len(text) else np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([
            pa.array(k1[new]), pa.array(k2[new]), pa.array(start[new]), pa.array((reached - text)[last]),
        ], names=["k1", "k2", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for _, rows in grouped(batches):
            waiting.extend(rows)
            size += sum(len(r[1]) for r in rows) // STRING.itemsize
            if size >= MERGED_STRINGS:
                yield spans(waiting)
                waiting, size = [], 0
        if waiting:
            yield spans(waiting)

    return transforms.mapInArrow(tidy(run), "k1 long, k2 long, start long, end long")


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
) -> DataFrame:
    """``doc_id, text`` (bytes), ``spans``, ``kept`` (the bytes left) and ``clean`` for each row.

    Every byte is removed that some string of ``length`` bytes covers which also starts elsewhere, in
    the same text or another. ``spans`` are the maximal removed runs, as begin and end in bytes.
    ``clean`` is the text that is left if characters are never torn: those partly in a span stay.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = SHARES * parts
    whole = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"),
    ).select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    found = find_anchors(whole.select("k1", "text"), length, gram, shares)
    found = found.repartition(parts, "share").sortWithinPartitions("share")
    repeated = checkpoint(repeated_anchors(found, hot))
    hottest = repeated.where("many is not null").orderBy(F.desc("many"), "hash").limit(HOT_ANCHORS)
    hot_hashes = np.array([r["hash"] for r in hottest.select("hash").collect()], np.int64).view(np.uint64)
    wanted = (
        repeated.where("at is not null").groupBy(F.col("key").alias("k1"))
        .agg(F.collect_set("at").alias("at"))
    )
    # both joins need the texts by k1 and the same columns, so that one exchange serves them
    joined = whole.join(wanted, "k1").select("doc_id", "k1", "k2", "text", "at")
    shards = shard_transforms(joined, length, gram, shares, hot_hashes)
    shards = shards.repartition(parts, "share").sortWithinPartitions("share")
    spans = repeated_spans(shards, length, gram)
    copies = (
        whole.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("end"))
        .where(f"n > 1 and end >= {int(length)}")
        .select("k1", "k2", F.lit(0).cast("long").alias("start"), F.col("end").cast("long"))
    )
    spans = spans.union(copies).groupBy("k1").agg(F.collect_set(F.struct("k2", "start", "end")).alias("found"))
    return apply_spans(whole.join(spans, "k1", "left").select("doc_id", "k1", "k2", "text", "found"))


def apply_spans(joined: DataFrame) -> DataFrame:
    """Join the spans of each text to maximal runs and cut them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k2 = batch.column(2).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(3))
            found = batch.column(4)
            inner = found.flatten()
            owner, start, end = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = np.array([0 if n is None else n for n in found.value_lengths().to_pylist()], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            runs, kept, clean = [], [], []
            for i in range(len(k2)):
                body = data[offsets[i]: offsets[i + 1]]
                mine = slice(bounds[i], bounds[i + 1])
                own = owner[mine] == k2[i]
                s, e = start[mine][own], end[mine][own]
                if not len(s):
                    runs.append([])
                    kept.append(body.tobytes())
                    clean.append(kept[-1].decode("utf-8", "replace"))
                    continue
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                s, e = s[new], e[np.append(np.flatnonzero(new)[1:], len(e)) - 1]
                runs.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e)])
                left, sound = np.ones(len(body), bool), np.ones(len(body), bool)
                for a, b in zip(s, e):
                    left[a:b] = False
                    while a < b and body[a] & 0xC0 == 0x80:
                        a += 1
                    while a < b < len(body) and body[b] & 0xC0 == 0x80:
                        b -= 1
                    sound[a:b] = False
                kept.append(body[left].tobytes())
                clean.append(body[sound].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(3),
                pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()), pa.array(clean, pa.string()),
            ], names=["doc_id", "text", "spans", "kept", "clean"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(tidy(run), (
        f"doc_id {kind}, text binary, spans array<struct<start:long,end:long>>, kept binary, clean string"))


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` (``text, n_chars`` and others) without repeated strings.

    A span gives up the characters it would tear. A null text stays null; ``n_chars`` is counted anew for
    texts that changed. Rows stay, also if nothing is left of the text.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    done = remove_repeats(named, "text", "row", length)
    changed = F.size("spans") > 0
    row = {c: F.col("doc_id").getField(c) for c in docs.columns}
    row["text"] = F.when(changed, F.col("clean")).otherwise(row["text"])
    if "n_chars" in row:
        kind = docs.schema["n_chars"].dataType
        row["n_chars"] = F.when(changed, F.char_length("clean").cast(kind)).otherwise(row["n_chars"])
    return done.select(*[row[c].alias(c) for c in docs.columns])
