"""Gradient boosting of trees for several classes at once, over sparse TF-IDF vectors.

One softmax over all classes: in every round each class gets a tree that is fitted to the difference between truth and
probability. Weights are cut into bins (the same cuts for all terms, quantiles of the weights above zero), and only weights
above zero are stored and added up: what a histogram lacks for a node's total belongs to the bin of zero.

The weights are dealt once by groups of up to ``GROUP`` rows and by term, and stand by (term, bin) in the executors' memory or
on their disks, with the labels and margins of all rows of the group. So a part has all weights of its terms and searches
them itself: no sums move, and a level of all trees of a round is one job. The driver gets the best cut of each node in each
part with a bit for each row and class, which side it goes to, and sends out the node that each row has come to. With several
groups sums of count, gradient and curvature for (tree, node, term, bin) are dealt by term to ``BUCKETS`` parts, which add
them up in a table and search it, and only the bits of chosen cuts are asked for. Parts are written to the checkpoint folder
every ``CHECKPOINT`` rounds, so lost executors cost few rounds.

Rows with a label that is no class are left out; a null text has no cells and goes to the side of zero.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scores as S

CLASSES = len(P.LABELS)
BINS = 16
ROWS = 2_000  # of a block, at most
BUCKETS = 32  # parts of the terms that are searched apart, at most unless their tables get too large
TABLE = 4_000_000  # places of a part's table, about
GROUP = 1_000_000  # rows, about
CELLS = 8_000_000  # weights of a part of a group, about
NEAR = 1_000_000  # places of the table, and weights, that a part adds up at a time
CHECKPOINT = 10
COUNT, GRADIENT, CURVATURE = range(3)


@dataclass
class Block:
    """Rows of one task: ``cells`` are row x terms + term of the weights above zero, in order."""

    label: np.ndarray
    margins: np.ndarray
    cells: np.ndarray
    bins: np.ndarray


@dataclass
class Columns:
    """The rows of a group with the weights above zero of every ``of``-th term, the ``number``-th first: their rows, in order of
    (place of the term, bin), and where each of these begins."""

    group: int
    number: int
    of: int
    label: np.ndarray
    margins: np.ndarray
    row: np.ndarray
    begin: np.ndarray


@dataclass
class Tree:
    """A tree for each class: node 1 is the root, the children of node i are 2i and 2i + 1. ``term`` is -1
    in a leaf; a row goes to the second child if its bin of the term is at least ``cut``."""

    term: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        shape = (CLASSES, 2 << depth)
        return cls(np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape))


def bins_at(block: Block, n_terms: int, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The bin of a term in a row, 0 where its weight is zero."""
    if not len(block.cells):
        return np.zeros(len(rows), np.int64)
    wanted = rows * n_terms + terms
    at = np.minimum(np.searchsorted(block.cells, wanted), len(block.cells) - 1)
    return np.where(block.cells[at] == wanted, block.bins[at], 0)


def nodes_of(block: Block, tree: Tree, number: int, n_terms: int) -> np.ndarray:
    """The node that every row has come to in the tree of a class."""
    node = np.ones(len(block.label), np.int64)
    while True:
        going = np.flatnonzero(tree.term[number, node] >= 0)
        if not len(going):
            return node
        here = node[going]
        right = bins_at(block, n_terms, going, tree.term[number, here]) >= tree.cut[number, here]
        node[going] = 2 * here + right


def probabilities(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def after(block: Block, tree: Tree, n_terms: int, rate: float) -> Block:
    """The block with the values of a round's trees added to its margins."""
    gained = np.stack([tree.value[c, nodes_of(block, tree, c, n_terms)] for c in range(CLASSES)], axis=1)
    return Block(block.label, block.margins + rate * gained, block.cells, block.bins)


# --- sums of a level -------------------------------------------------------------------------------

@dataclass
class Sums:
    """Sums by (class, node, term, bin), in order of the key, by (class, node), and the loss."""

    keys: np.ndarray
    cells: np.ndarray  # 3 x keys
    totals: np.ndarray  # classes x nodes x 3
    loss: float


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(place, v, len(found)) for v in values]) if len(found) else values[:, :0]


def merged(a: Sums | None, b: Sums | None) -> Sums | None:
    if a is None or b is None:
        return a or b
    keys, cells = added(np.concatenate([a.keys, b.keys]), np.concatenate([a.cells, b.cells], axis=1))
    return Sums(keys, cells, a.totals + b.totals, a.loss + b.loss)


def level_sums(block: Block, tree: Tree, n_terms: int, n_bins: int, depth: int) -> Sums:
    """Sums of the rows in the nodes of one depth."""
    shares = probabilities(block.margins)
    row, term = np.divmod(block.cells, n_terms)
    # the (term, bin) that occur are numbered once, so that nodes are summed by counting, without a sort
    known, place = np.unique(term * n_bins + block.bins, return_inverse=True)
    nodes, first = tree.term.shape[1], 1 << depth
    keys, values, totals = [], [], np.zeros((*tree.term.shape, 3))
    for c in range(CLASSES):
        gradient, curvature = gradients(block.label, shares, c)
        each = np.stack([np.ones(len(gradient)), gradient, curvature])
        node = nodes_of(block, tree, c, n_terms)
        open_here = node >> depth == 1
        totals[c] = np.stack([np.bincount(node[open_here], e[open_here], nodes) for e in each], axis=1)
        inside = open_here[row]
        at = row[inside]
        where = (node[at] - first) * len(known) + place[inside]
        sums = np.stack([np.bincount(where, e[at], first * len(known)) for e in each])
        found = np.flatnonzero(sums[COUNT])
        which, kind = np.divmod(found, max(len(known), 1))
        keys.append((c * nodes + first + which) * n_terms * n_bins + known[kind])
        values.append(sums[:, found])
    return Sums(np.concatenate(keys), np.concatenate(values, axis=1), totals, loss_of(block.label, shares))


def gradients(label: np.ndarray, shares: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of a class."""
    gradient = (label == number) - shares[:, number]
    return gradient, np.abs(gradient) * (1 - np.abs(gradient))


def loss_of(label: np.ndarray, shares: np.ndarray) -> float:
    return float(-np.log(np.maximum(shares[np.arange(len(label)), label], 1e-300)).sum())


def opened(node: np.ndarray, depth: int) -> np.ndarray:
    """The place of each row's node among those of a depth, the place behind them for rows in other nodes."""
    first = 1 << depth
    return np.where(node >> depth == 1, node.astype(np.int64) - first, first).astype(np.min_scalar_type(first))


def tables(
    part: Columns, where: list[np.ndarray], weights: list[list[np.ndarray]], width: int, n_bins: int
) -> Iterator[tuple[int, np.ndarray]]:
    """Counts and sums of each class's ``weights`` by (class, weight, place of a term, bin, place of a node), for so many terms at
    a time that tables stay small, with the place of the first of these. What the largest node of a class has is what all rows
    have less the other nodes, so only rows in these are told apart."""
    begin, n_keys, n_sums = part.begin, len(part.begin) - 1, 1 + len(weights[0])
    large = [int(np.bincount(w, minlength=width).argmax()) for w in where]
    step = max(1, NEAR // (n_bins * width)) * n_bins
    for low in range(0, n_keys, step):
        high = min(low + step, n_keys)
        table = np.zeros((len(where), n_sums, high - low, width))
        for a in range(int(begin[low]), int(begin[high]), NEAR):
            b = min(a + NEAR, int(begin[high]))
            k, last = np.searchsorted(begin, [a, b - 1], "right") - 1
            row = part.row[a:b].astype(np.intp)
            size = np.diff(np.clip(begin[k : last + 2], a, b))
            there = np.flatnonzero(size)
            starts = np.cumsum(size)[there] - size[there]
            base = np.repeat(np.arange(len(size)) * width, size)
            for place, weight, big, sums in zip(where, weights, large, table[:, :, k - low : last + 1 - low]):
                node = place.take(row)
                other = np.flatnonzero(node != big)
                at = base.take(other) + node.take(other)
                for of_rows, into in zip((None, *weight), sums):
                    each = None if of_rows is None else of_rows.take(row)
                    found = np.bincount(at, None if each is None else each.take(other), len(size) * width).reshape(-1, width)
                    into += found
                    whole = size[there] if each is None else np.add.reduceat(each, starts)
                    into[there, big] += whole - found[there].sum(axis=1)
        table = table.reshape(len(where), n_sums, -1, n_bins, width)
        table[..., -1] = 0  # rows in other nodes
        yield low // n_bins, table


def column_sums(part: Columns, tree: Tree, n_terms: int, n_bins: int, depth: int, nodes: dict[int, np.ndarray]) -> Sums:
    """:func:`level_sums` of the terms of a part. Totals and loss of a group come from its first part."""
    shares, node = probabilities(part.margins), nodes[part.group]
    n_nodes, first = tree.term.shape[1], 1 << depth
    totals = np.zeros((*tree.term.shape, 3))
    keys, values = [np.zeros(0, np.int64)], [np.zeros((3, 0))]
    where = [opened(node[c], depth) for c in range(CLASSES)]
    weights = [gradients(part.label, shares, c) for c in range(CLASSES)]
    if part.number == 0:
        totals[:, first : 2 * first] = [_totals(w, e, first) for w, e in zip(where, weights)]
    for low, table in tables(part, where, weights, first + 1, n_bins):
        for c, of_class in enumerate(table):
            found = np.flatnonzero(of_class[COUNT])
            place, at = np.divmod(found, first + 1)
            place, bin_ = np.divmod(place, n_bins)
            keys.append(((c * n_nodes + first + at) * n_terms + (low + place) * part.of + part.number) * n_bins + bin_)
            values.append(of_class.reshape(3, -1)[:, found])
    every = np.concatenate(keys)
    order = np.argsort(every)
    loss = loss_of(part.label, shares) if part.number == 0 else 0.0
    return Sums(every[order], np.concatenate(values, axis=1)[:, order], totals, loss)


def _totals(where: np.ndarray, weights: tuple[np.ndarray, ...], first: int) -> np.ndarray:
    return np.stack([np.bincount(where, w, first + 1)[:first] for w in (None, *weights)], axis=1)


def dealt(sums: Sums, n_terms: int, n_bins: int, buckets: int) -> Iterator[tuple[int, Sums]]:
    """The sums in parts by term. Totals and loss are small and go with every part."""
    bucket = sums.keys // n_bins % n_terms % buckets
    for b in range(buckets):
        mine = bucket == b
        yield b, Sums(sums.keys[mine], sums.cells[:, mine], sums.totals, sums.loss)


@dataclass
class Cuts:
    """The best cut of each node that has one, by (class, node): owner, term, bin, gain, and the sums on both sides."""

    owner: np.ndarray
    term: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray  # cuts x 3
    right: np.ndarray
    totals: np.ndarray  # of the nodes, as in Sums
    loss: float
    number: int = 0  # of the part
    goes: np.ndarray | None = None  # from column_cuts: classes x rows, packed, as in sides()


def best_cuts(sums: Sums, n_terms: int, n_bins: int) -> Cuts:
    totals = sums.totals.reshape(-1, 3)
    place, bin_ = np.divmod(sums.keys, n_bins)
    owner, term = np.divmod(place, n_terms)
    # what lies at or above each cut: sums from the end of each (node, term)
    begin = np.flatnonzero(place[1:] != place[:-1]) + 1 if len(place) else np.zeros(0, np.int64)
    begin = np.append(0, begin)[: len(place)]
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(place))))
    running = np.cumsum(sums.cells, axis=1)
    end = running[:, np.append(begin[1:], len(place)) - 1] if len(place) else running
    right = (end[:, group] - running + sums.cells).T
    whole = totals[owner]
    left = whole - right
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (right[:, GRADIENT] ** 2 / right[:, COUNT] + left[:, GRADIENT] ** 2 / left[:, COUNT]
                - whole[:, GRADIENT] ** 2 / whole[:, COUNT])
    good = np.flatnonzero((left[:, COUNT] > 0.5) & (right[:, COUNT] > 0.5) & (gain > 1e-12))
    good = good[_best(owner[good], term[good], bin_[good], np.round(gain[good], 12))]
    return Cuts(owner[good], term[good], bin_[good], np.round(gain[good], 12), left[good], right[good], sums.totals, sums.loss)


def _best(owner: np.ndarray, term: np.ndarray, cut: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The highest gain of each node; of equal ones the first term, the lowest cut."""
    order = np.lexsort((cut, term, -gain, owner))
    return order[np.append(True, owner[order][1:] != owner[order][:-1])] if len(order) else order


def column_cuts(part: Columns, node: np.ndarray, shape: tuple, n_bins: int, depth: int) -> Cuts:
    """The best cuts among the terms of a part that has all rows, and the sides that rows go to."""
    shares, first = probabilities(part.margins), 1 << depth
    totals, mine = np.zeros((*shape, 3)), Tree(np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape))
    where = [opened(node[c], depth) for c in range(CLASSES)]
    weights = [gradients(part.label, shares, c) for c in range(CLASSES)]
    whole = totals[:, first : 2 * first] = np.stack([_totals(w, e, first) for w, e in zip(where, weights)])
    best, found = np.zeros((CLASSES, first)), []
    for low, table in tables(part, where, [e[:1] for e in weights], first + 1, n_bins):
        for c, of_class in enumerate(table):
            for at, place, cut, gain in zip(*_best_of_table(of_class, whole[c])):
                if gain > best[c, at]:  # of equal ones the first term
                    best[c, at] = gain
                    mine.term[c, first + at], mine.cut[c, first + at] = (low + place) * part.of + part.number, cut
    for c, at in zip(*np.nonzero(best)):
        rows = _right_rows(part, where[c], at, mine.term[c, first + at], mine.cut[c, first + at], n_bins)
        right = np.array([len(rows), *(w[rows].sum() for w in weights[c])])
        found.append((c * shape[1] + first + at, best[c, at], whole[c, at] - right, right))
    owner = np.array([f[0] for f in found], np.int64)
    gain, left, right = (np.array([f[i] for f in found]).reshape(len(found), *size) for i, size in ((1, ()), (2, (3,)), (3, (3,))))
    return Cuts(owner, mine.term.reshape(-1)[owner], mine.cut.reshape(-1)[owner], gain, left, right, totals,
                loss_of(part.label, shares), part.number, sides(part, node, mine, n_bins, depth))


def _best_of_table(table: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of the node, place of the term, bin and gain of the best cut of each node that has one."""
    width = table.shape[-1]
    there = np.flatnonzero(table[COUNT])
    # what lies at or above each cut
    count, gradient = (np.cumsum(t[:, ::-1], axis=1)[:, ::-1].reshape(-1)[there] for t in table[[COUNT, GRADIENT]])
    node = there % width
    whole_count, whole_gradient = whole[node, COUNT], whole[node, GRADIENT]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (gradient ** 2 / count + (whole_gradient - gradient) ** 2 / (whole_count - count)
                - whole_gradient ** 2 / whole_count)
    good = np.flatnonzero((whole_count - count > 0.5) & (gain > 1e-12))
    there, node, gain = there[good], node[good], np.round(gain[good], 12)
    most = np.zeros(width)
    np.maximum.at(most, node, gain)
    at = np.flatnonzero(gain == most[node])
    node, begin = np.unique(node[at], return_index=True)  # the first: of equal ones the first term, the lowest cut
    place, bin_ = np.divmod(there[at[begin]] // width, table.shape[2])
    return node, place, bin_, gain[at[begin]]


def _right_rows(part: Columns, where: np.ndarray, at: int, term: int, cut: int, n_bins: int) -> np.ndarray:
    place = term // part.of * n_bins
    rows = part.row[part.begin[place + cut] : part.begin[place + n_bins]]
    return rows[where[rows] == at]


def sides(part: Columns, node: np.ndarray, tree: Tree, n_bins: int, depth: int) -> np.ndarray:
    """Which rows go to the second child, by class, of the nodes of a depth that are cut by a term of the part; packed bits."""
    goes = np.zeros(node.shape, bool)
    for c in range(CLASSES):
        where = opened(node[c], depth)
        term = tree.term[c, 1 << depth : 2 << depth]
        for at in np.flatnonzero((term >= 0) & (term % part.of == part.number)):
            goes[c, _right_rows(part, where, at, term[at], tree.cut[c, (1 << depth) + at], n_bins)] = True
    return np.packbits(goes, axis=1)


def went(node: np.ndarray, tree: Tree, goes: dict[int, np.ndarray], n_parts: int, depth: int) -> np.ndarray:
    """The nodes of all rows after the cuts of a depth, by the packed bits of the parts that have the terms."""
    packed_bits = np.zeros((n_parts, CLASSES, -(-node.shape[1] // 8)), np.uint8)
    for number, bits in goes.items():
        packed_bits[number] = bits
    row, new = np.arange(node.shape[1]), node.copy()
    byte, shift = row >> 3, (7 - (row & 7)).astype(np.uint8)
    for c in range(CLASSES):
        cut = (tree.term[c] >= 0) & (np.arange(len(tree.term[c])) >> depth == 1)
        bit = packed_bits[(tree.term[c] % n_parts)[node[c]], c, byte] >> shift & 1
        new[c] = np.where(cut[node[c]], 2 * node[c] + bit, node[c])
    return new


def split(tree: Tree, sums: Sums, n_terms: int, n_bins: int, last: bool) -> bool:
    """Give every node of a level its best cut, or its value; whether there are new nodes to split."""
    return apply_cuts(tree, [best_cuts(sums, n_terms, n_bins)], last)


def apply_cuts(tree: Tree, parts: list[Cuts], last: bool) -> bool:
    """The same from the best cuts of each part of the terms."""
    nodes = tree.term.shape[1]
    totals = parts[0].totals.reshape(-1, 3)
    known = np.flatnonzero(totals[:, COUNT] > 0)
    _set_values(tree, known, totals[known])
    owner, term, cut, gain, left, right = (
        np.concatenate([getattr(p, n) for p in parts]) for n in ("owner", "term", "cut", "gain", "left", "right"))
    best = _best(owner, term, cut, gain)
    number, node = np.divmod(owner[best], nodes)
    tree.term[number, node], tree.cut[number, node] = term[best], cut[best]
    for child, part in ((2 * node, left[best]), (2 * node + 1, right[best])):
        _set_values(tree, number * nodes + child, part)
    return bool(len(best)) and not last


def _set_values(tree: Tree, owner: np.ndarray, totals: np.ndarray) -> None:
    """Newton steps of the softmax loss."""
    curved = totals[:, CURVATURE] > 1e-150
    value = np.zeros(len(owner))
    np.divide((CLASSES - 1) / CLASSES * totals[:, GRADIENT], totals[:, CURVATURE], out=value, where=curved)
    tree.value.reshape(-1)[owner] = value


# --- fitting -----------------------------------------------------------------------------------------

@dataclass
class BoostedModel:
    """A feature pipeline, the cuts of the weights, and the trees of all rounds."""

    features: PipelineModel
    cuts: list[float]
    prior: list[float]
    rate: float
    n_terms: int
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)  # mean log loss before the first round and after each

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and ``probabilities``."""
        columns = df.columns
        cuts, prior, n_terms, scores = np.array(self.cuts), self.prior, self.n_terms, Scores(self.trees, self.n_terms, self.rate)

        @F.arrow_udf("array<double>")
        def shares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                found = probabilities(scores(block_of(vectors, np.zeros(len(vectors), np.int64), cuts, n_terms, prior)))
                yield pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), CLASSES).cast(pa.list_(pa.float64()))

        weighed = self.features.transform(df).select(*columns, F.unwrap_udt("features").alias("_v"))
        scored = weighed.select(*columns, shares(sparse("_v")).alias("probabilities"))
        return scored.withColumn("prediction", S.argmax(F.col("probabilities")))

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        kept = {"cuts": self.cuts, "prior": self.prior, "rate": self.rate, "n_terms": self.n_terms, "losses": self.losses}
        lines = [json.dumps(kept)] + [
            json.dumps({"term": t.term.tolist(), "cut": t.cut.tolist(), "value": t.value.tolist()}) for t in self.trees]
        table = pa.table({"value": [f"{i:06d}{line}" for i, line in enumerate(lines)]})
        SparkSession.getActiveSession().createDataFrame(table).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> "BoostedModel":
        rows = SparkSession.getActiveSession().read.text(f"{path}/metadata").orderBy("value").collect()  # one per round
        kept, *trees = (json.loads(r["value"][6:]) for r in rows)
        return cls(PipelineModel.load(f"{path}/features"), kept["cuts"], kept["prior"], kept["rate"], kept["n_terms"],
                   [Tree(np.array(t["term"]), np.array(t["cut"]), np.array(t["value"])) for t in trees], kept["losses"])


class Scores:
    """Margins of rows after all trees. The bins of the terms that occur in trees are laid out in a table, so that a row's way
    through a tree is a look-up for each level."""

    def __init__(self, trees: list[Tree], n_terms: int, rate: float) -> None:
        self.rate, self.n_terms = rate, n_terms
        self.used = np.unique(np.concatenate([np.zeros(1, np.int64), *(t.term[t.term >= 0] for t in trees)]))
        self.ways = []
        for tree in trees:
            node = np.tile(np.arange(tree.term.shape[1]), (CLASSES, 1))
            inner = tree.term >= 0
            # a leaf is its own left child, and no bin reaches its cut
            self.ways.append((np.where(inner, np.searchsorted(self.used, tree.term), 0), np.where(inner, tree.cut, 1 << 30),
                              np.where(inner, 2 * node, node), tree.value, int(np.max(node * inner)).bit_length()))

    def __call__(self, block: Block) -> np.ndarray:
        size, n_used = len(block.label), len(self.used)
        column = np.full(self.n_terms, -1)
        column[self.used] = np.arange(n_used)
        margins = block.margins.copy()
        border = np.searchsorted(block.cells, np.arange(size + 1) * self.n_terms)
        for low in range(0, size, ROWS):
            high = min(low + ROWS, size)
            row, term = np.divmod(block.cells[border[low] : border[high]], self.n_terms)
            bins = np.zeros((high - low) * n_used, np.int32)
            known = column[term] >= 0
            bins[((row - low) * n_used + column[term])[known]] = block.bins[border[low] : border[high]][known]
            begin = np.arange(high - low) * n_used
            for place, cut, left, value, depth in self.ways:
                for c in range(CLASSES):
                    node = np.ones(high - low, np.int64)
                    for _ in range(depth):
                        node = left[c, node] + (bins[begin + place[c, node]] >= cut[c, node])
                    margins[low:high, c] += self.rate * value[c, node]
        return margins


def sparse(vector: str):
    """``indices, values`` of an unwrapped vector, whether it is stored sparse or dense."""
    v = F.col(vector)
    every = F.sequence(F.lit(0), F.greatest(F.size(v["values"]) - 1, F.lit(0)))
    return F.struct(F.coalesce(v["indices"], every).alias("indices"), v["values"].alias("values"))


def block_of(vectors: pa.Array, label: np.ndarray, cuts: np.ndarray, n_terms: int, prior: list[float]) -> Block:
    indices, values = vectors.field("indices"), vectors.field("values")
    if indices.null_count:  # a vector that is null has no cells
        indices, values = (x.fill_null(pa.scalar([], x.type)) for x in (indices, values))
    size = np.diff(indices.offsets.to_numpy())
    weight = values.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    above = weight > 0
    cells = row[above] * n_terms + indices.flatten().to_numpy(zero_copy_only=False)[above]
    bins = np.searchsorted(cuts, weight[above], "left") + 1
    return Block(label.astype(np.int64), np.tile(np.array(prior, float), (len(label), 1)), cells, bins.astype(np.int64))


def training_facts(data: DataFrame) -> tuple[DataFrame, int, dict[int, int], list[float], int]:
    """``label, v`` of rows with a class, the number of terms, rows by class, the cuts of the weights, and how many are above zero."""
    rows = data.where(F.col("label").isin(*range(CLASSES))).select("label", F.unwrap_udt("features").alias("_v"))
    facts = rows.select("label", sparse("_v").alias("v"), F.col("_v.size").alias("size"))
    counts = facts.groupBy("label").agg(F.count("*").alias("n"), F.max(F.coalesce("size", F.size("v.values"))).alias("size"))
    counted = counts.collect()  # one row for each class
    if not counted:
        raise ValueError("no row with a class")
    positive = facts.select(F.explode("v.values").alias("w")).where("w > 0")
    quantiles, n_cells = positive.agg(
        F.percentile_approx("w", [i / BINS for i in range(1, BINS)], 10_000), F.count("*")).first()
    return facts, max(r["size"] for r in counted), {r["label"]: r["n"] for r in counted}, sorted(set(quantiles or [])), n_cells


def packed(part: Iterator, cuts: np.ndarray, n_terms: int, prior: list[float]) -> Iterator[Block]:
    """Blocks of the rows ``label, v`` of a partition."""
    held: list = []

    def block() -> Block:
        kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
        vectors = pa.array([{"indices": r.v.indices, "values": r.v.values} for r in held], kind)
        return block_of(vectors, np.array([r.label for r in held]), cuts, n_terms, prior)

    for row in part:
        held.append(row)
        if len(held) == ROWS:
            yield block()
            held = []
    if held:
        yield block()


def fit(
    features: PipelineModel, data: DataFrame, maxIter: int = 100, maxDepth: int = 5, stepSize: float = 0.1,
) -> BoostedModel:
    """Fit on ``features, label``."""
    facts, n_terms, counted, cuts, n_cells = training_facts(data)
    n_rows = sum(counted.values())
    prior = [float(np.log(max(counted.get(c, 0), 1e-9) / n_rows)) for c in range(CLASSES)]
    n_bins = len(cuts) + 2

    # columns of numbers that every level reads: the work inside a task is a program, not a query
    n_groups = -(-n_rows // GROUP)
    cores = data.sparkSession.sparkContext.defaultParallelism
    n_parts = min(n_terms, max(-(-cores // n_groups), -(-n_cells // (n_groups * CELLS))))
    sent = facts.select("label", "v").rdd.mapPartitionsWithIndex(
        lambda i, part: _sent(i, packed(part, np.array(cuts), n_terms, prior), n_groups, n_parts, n_terms, n_bins))
    columns = sent.partitionBy(n_groups * n_parts, int).mapPartitions(
        lambda part: _together(part, n_parts, n_terms, n_bins, prior)).persist(StorageLevel.MEMORY_AND_DISK)
    columns.checkpoint()
    model = BoostedModel(features, cuts, prior, stepSize, n_terms, [])
    stale = None
    try:
        sizes = dict(columns.filter(lambda part: part.number == 0).map(lambda part: (part.group, len(part.label))).collect())
        for round_no in range(maxIter):
            tree, nodes = Tree.empty(maxDepth), _roots(sizes, maxDepth)
            for depth in range(maxDepth):
                parts = _cuts(columns, tree, n_terms, n_bins, depth, nodes)
                if depth == 0:  # the columns of this round are there now
                    model.losses.append(parts[0].loss / n_rows)
                    if stale is not None:
                        stale.unpersist()
                more = apply_cuts(tree, parts, depth == maxDepth - 1)
                nodes = _gone(columns, tree, parts, n_bins, n_parts, depth, nodes)
                if not more:
                    break
            model.trees.append(tree)
            stale, columns = columns, _next(columns, tree, nodes, stepSize, (round_no + 1) % CHECKPOINT == 0)
        last = Tree.empty(0)
        model.losses.append(_cuts(columns, last, n_terms, n_bins, 0, _roots(sizes, 0))[0].loss / n_rows)
    finally:
        for held in (stale, columns):
            if held is not None:
                held.unpersist()
    return model


def _sent(
    partition: int, blocks: Iterator[Block], n_groups: int, n_parts: int, n_terms: int, n_bins: int
) -> Iterator[tuple[int, tuple]]:
    """Each block dealt by term: its place, labels, and rows and (place of the term, bin) of its weights."""
    for number, block in enumerate(blocks):
        group = (partition + number) % n_groups
        row, term = np.divmod(block.cells, n_terms)
        place, part = np.divmod(term, n_parts)
        order = np.argsort(part, kind="stable")
        border = np.cumsum(np.bincount(part, minlength=n_parts))[:-1]
        row, key = row[order].astype(np.int32), (place * n_bins + block.bins)[order].astype(np.int32)
        for i, (rows, keys) in enumerate(zip(np.split(row, border), np.split(key, border))):
            yield group * n_parts + i, (group, i, (partition, number), block.label.astype(np.int8), rows, keys)


def _together(
    part: Iterator[tuple[int, tuple]], n_parts: int, n_terms: int, n_bins: int, prior: list[float]
) -> Iterator[Columns]:
    """The columns of a part, in the same order of rows as those of other parts of the group."""
    held = sorted((sent for _, sent in part), key=lambda sent: sent[2])
    if not held:
        return
    groups, numbers, _, labels, rows, keys = zip(*held)
    first = np.cumsum([0, *map(len, labels)])
    label, key = np.concatenate(labels), np.concatenate(keys)
    row = np.concatenate([r + np.int32(f) for r, f in zip(rows, first)])
    n_keys = -(-(n_terms - numbers[0]) // n_parts) * n_bins
    begin = np.append(0, np.cumsum(np.bincount(key, minlength=n_keys)))
    margins = np.tile(np.array(prior, float), (len(label), 1))
    yield Columns(groups[0], numbers[0], n_parts, label, margins, row[np.argsort(key, kind="stable")], begin)


def _roots(sizes: dict[int, int], max_depth: int) -> dict[int, np.ndarray]:
    """Node 1 for each class and row of each group."""
    return {group: np.ones((CLASSES, size), np.min_scalar_type(4 << max_depth)) for group, size in sizes.items()}


def _cuts(columns: RDD, tree: Tree, n_terms: int, n_bins: int, depth: int, nodes: dict[int, np.ndarray]) -> list[Cuts]:
    """The best cuts of the nodes of a depth from each part."""
    if len(nodes) > 1:
        return _level(columns, tree, n_terms, n_bins, depth, partial(column_sums, nodes=nodes))
    shape, (node,) = tree.term.shape, nodes.values()
    return columns.map(lambda part: column_cuts(part, node, shape, n_bins, depth)).collect()  # a row for each part


def _gone(
    columns: RDD, tree: Tree, parts: list[Cuts], n_bins: int, n_parts: int, depth: int, nodes: dict[int, np.ndarray]
) -> dict[int, np.ndarray]:
    """The nodes of all rows after the cuts of a depth."""
    if len(nodes) == 1:
        return {group: went(node, tree, {p.number: p.goes for p in parts}, n_parts, depth) for group, node in nodes.items()}
    terms = tree.term[:, 1 << depth : 2 << depth]
    chosen = set((terms[terms >= 0] % n_parts).tolist())
    found = columns.filter(lambda part: part.number in chosen).map(
        lambda part: (part.group, part.number, sides(part, nodes[part.group], tree, n_bins, depth))).collect()  # a bit for a row and class
    return {group: went(node, tree, {n: bits for g, n, bits in found if g == group}, n_parts, depth) for group, node in nodes.items()}


def _level(
    blocks: RDD, tree: Tree, n_terms: int, n_bins: int, depth: int, sums_of: Callable[..., Sums] = level_sums
) -> list[Cuts]:
    """The best cuts of the nodes of a depth, from each part of the terms."""
    places = CLASSES * n_terms * n_bins << depth
    buckets = max(1, min(BUCKETS, blocks.getNumPartitions()), min(n_terms, -(-places // TABLE)))

    def send(part: Iterator[Block]) -> Iterator[tuple[int, Sums]]:
        whole = reduce(merged, (sums_of(block, tree, n_terms, n_bins, depth) for block in part), None)
        return dealt(whole, n_terms, n_bins, buckets) if whole is not None else iter(())

    def search(part: Iterator[tuple[int, Sums]]) -> Iterator[Cuts]:
        # a part of the terms has a place for each (class, node of the depth, term, bin)
        per_node, first, nodes = -(-n_terms // buckets) * n_bins, 1 << depth, tree.term.shape[1]
        table, totals, loss, bucket = np.zeros((3, CLASSES * first * per_node)), 0.0, 0.0, None
        for bucket, sums in part:
            place, bin_ = np.divmod(sums.keys, n_bins)
            owner, term = np.divmod(place, n_terms)
            number, node = np.divmod(owner, nodes)
            # a sender has each key once
            table[:, (number * first + node - first) * per_node + term // buckets * n_bins + bin_] += sums.cells
            totals, loss = totals + sums.totals, loss + sums.loss
        if bucket is None:
            return
        found = np.flatnonzero(table[COUNT])
        owner, rest = np.divmod(found, per_node)
        number, node = np.divmod(owner, first)
        term, bin_ = np.divmod(rest, n_bins)
        keys = ((number * nodes + first + node) * n_terms + term * buckets + bucket) * n_bins + bin_
        yield best_cuts(Sums(keys, table[:, found], totals, loss), n_terms, n_bins)

    return blocks.mapPartitions(send).partitionBy(buckets, int).mapPartitions(search).collect()  # a row for each part


def _next(columns: RDD, tree: Tree, nodes: dict[int, np.ndarray], rate: float, cut: bool) -> RDD:
    """The columns after a round, made by the first job that reads them."""
    def gained(part: Columns) -> Columns:
        values = np.stack([tree.value[c, nodes[part.group][c]] for c in range(CLASSES)], axis=1)
        return replace(part, margins=part.margins + rate * values)

    moved = columns.map(gained).persist(StorageLevel.MEMORY_AND_DISK)
    if cut:
        moved.checkpoint()
    return moved
