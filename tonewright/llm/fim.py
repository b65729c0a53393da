"""Fill-in-the-middle: texts are cut at two places and their parts put in another order.

A text is a row of units (code points, words or lines). Both cuts are ranks among them, taken from a hash of
the document's key. To turn a rank into a place in the text, the units form an indexable skip list: the
lowest lane links every unit to the next one, an express lane keeps about one node in sixteen of the lane below,
and every link carries two widths, the units and the code points that it spans. A descent from the head of the
highest lane follows links as long as the units add up to at most the rank, goes down a lane where the next one
would pass it, and has then added up the code points before the cut. All texts of a slice
descend together, both cuts at once. Which nodes are kept is a hash of their rank, so nothing is drawn at
random, and the result does not depend on it.

Only the text goes to Python and only four numbers come back; the parts are put together and taken apart again
by column expressions. Nothing is shuffled.

Nulls and odd input: a null text is empty; an empty text, one that holds a mark, and one that the share of
plain texts takes, stay as they are (form ``plain``, null widths); a null key counts as an empty one; repeated rows
are rows of their own with equal cuts; an empty table gives an empty result; other columns stay, and new columns
replace those of the same name. A text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import SPACE, mix, slices, text_bytes

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")
RARE = 16  # about one node in so many is kept in the lane above
PLAIN_PERCENT, SPM_PERCENT = 10, 20


# --- the skip list -------------------------------------------------------------------------------

def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Where a unit begins: every code point, every word that follows white space, or every line. What
    stands before the first word of a text is a unit as well, so the units of a text are all of it."""
    if unit == "char":
        begins = (data & 0xC0) != 0x80
    elif unit == "word":
        begins = ~SPACE[data]
        begins[1:] &= SPACE[data[:-1]]
    else:
        begins = np.zeros(len(data), bool)
        begins[1:] = data[:-1] == 0x0A
    first = offsets[:-1]
    begins[first[first < offsets[1:]]] = True
    return np.flatnonzero(begins)


@dataclass
class Lane:
    """The nodes of all texts in order, each text's head first. A link goes to the next node; the last
    node of a text has none."""

    units: np.ndarray  # width of the link that leaves a node
    chars: np.ndarray
    last: np.ndarray
    rank: np.ndarray  # in the lowest lane, 0 for a head; only decides what the lane above keeps
    down: np.ndarray  # the same node in the lane below


def lowest_lane(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[Lane, np.ndarray]:
    """The lane of all units, and each text's number of them."""
    starts = unit_starts(data, offsets, unit)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    begin = np.searchsorted(starts, offsets)
    count = np.diff(begin)
    heads = begin[:-1] + np.arange(len(count))
    nodes = len(starts) + len(count)
    last = np.zeros(nodes, bool)
    last[heads + count] = True
    ends = np.append(starts[1:], offsets[-1:])
    units, chars = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    units[~last] = 1
    chars[~last] = points[ends] - points[starts]
    rank = np.arange(nodes) - np.repeat(heads, count + 1)
    return Lane(units, chars, last, rank, np.arange(nodes)), count


def lane_above(lane: Lane, number: int) -> Lane | None:
    """The nodes that a hash keeps, and all heads; None if only heads would stay."""
    kept = mix(lane.rank.astype(np.uint64) + np.uint64(number << 48)) % np.uint64(RARE) == 0
    if not (kept & (lane.rank > 0)).any():
        return None
    kept |= lane.rank == 0
    nodes = np.flatnonzero(kept)
    rank = lane.rank[nodes]
    last = np.append(rank[1:] == 0, True)
    return Lane(np.add.reduceat(lane.units, nodes), np.add.reduceat(lane.chars, nodes), last, rank, nodes)


def skip_list(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[list[Lane], np.ndarray, np.ndarray]:
    """Lanes from the lowest to the highest, each text's head in the highest, each text's number of units."""
    lane, count = lowest_lane(data, offsets, unit)
    lanes = [lane]
    while above := lane_above(lanes[-1], len(lanes)):
        lanes.append(above)
    return lanes, np.flatnonzero(lanes[-1].rank == 0), count


def descend(lanes: list[Lane], heads: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The code points before each rank; ``heads`` are nodes of the highest lane."""
    at = heads.copy()
    units, chars = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
    for level in range(len(lanes) - 1, -1, -1):
        lane = lanes[level]
        going = np.arange(len(ranks))
        while len(going):
            node = at[going]
            further = units[going] + lane.units[node]
            moves = ~lane.last[node] & (further <= ranks[going])
            going, node = going[moves], node[moves]
            units[going] = further[moves]
            chars[going] += lane.chars[node]
            at[going] = node + 1
        at = lane.down[at] if level else at
    return chars


def cut_places(
    data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of units, its code points, and the code points before each cut. The cuts
    are at the smaller and the larger of ``first`` and ``second`` modulo one more than the units."""
    lanes, heads, count = skip_list(data, offsets, unit)
    a, b = first % (count + 1), second % (count + 1)
    ranks = np.concatenate([np.minimum(a, b), np.maximum(a, b), count])
    places = descend(lanes, np.concatenate([heads] * 3), ranks)
    low, high, whole = np.split(places, 3)
    return count, whole, low, high


PLACES = "n_units long, n_chars long, low long, high long"
PLACES_TYPE = pa.struct([(name, pa.int64()) for name in ("n_units", "n_chars", "low", "high")])


def places_of(text: Column, first: Column, second: Column, unit: str) -> Column:
    """``n_units, n_chars, low, high`` of every text, by its skip list."""

    @F.arrow_udf(PLACES)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, one, two in batches:
            data, offsets = text_bytes(texts)
            a, b = one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)
            parts = [
                cut_places(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], a[i:j], b[i:j], unit)
                for i, j in slices(offsets)
            ]
            columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(4)]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(PLACES_TYPE))

    return run(text, first, second)


# --- columns ---------------------------------------------------------------------------------------

def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the key."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    unit: str = "char",
    seed: int = 1,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """Add ``n_units``, ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars``, ``middle_chars`` (code
    points, null for ``plain``) and ``output``.

    ``psm`` is prefix, suffix, middle, each behind its mark; ``spm`` is suffix, prefix, middle.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; use one of {UNITS}")
    new = ("n_units", "form", "prefix_chars", "middle_chars", "output")
    columns = [c for c in docs.columns if c not in new]
    # one struct of the row, so names can't clash below
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    h1, h2, h3, h4 = draws(F.col("row")[key], seed)
    placed = row.select(
        "row", whole.alias("whole"), places_of(whole, h1, h2, unit).alias("at"),
        (h3 % 100 >= 100 - plain_percent).alias("left_plain"), (h4 % 100 < spm_percent).alias("is_spm"),
    )
    marked = F.greatest(*[F.locate(m, F.col("whole")) for m in (PREFIX, SUFFIX, MIDDLE)]) > 0
    form = F.when((F.col("whole") == "") | marked | F.col("left_plain"), "plain").otherwise(
        F.when(F.col("is_spm"), "spm").otherwise("psm"))
    formed = placed.select("row", "whole", "at", form.alias("form"))
    low, high = F.col("at.low").cast("int"), F.col("at.high").cast("int")
    before, middle = F.substring("whole", F.lit(1), low), F.substring("whole", low + 1, high - low)
    after = F.substring("whole", high + 1, F.col("at.n_chars").cast("int") - high)
    p, s, m = F.concat(F.lit(PREFIX), before), F.concat(F.lit(SUFFIX), after), F.concat(F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(
        F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("whole"))
    is_cut = F.col("form") != "plain"
    return formed.select(
        *[F.col("row")[c].alias(c) for c in columns], F.col("at.n_units").alias("n_units"), "form",
        F.when(is_cut, F.col("at.low")).alias("prefix_chars"),
        F.when(is_cut, F.col("at.high") - F.col("at.low")).alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text behind an output. The parts hold no mark, and a mark can't arise where two parts meet, so the
    marks found are the three that were put there."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(
        form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
