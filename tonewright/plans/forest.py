"""A random forest of deep trees over sparse TF-IDF vectors.

Large nodes of all trees are split together, a level in a job. The node that a row has come to in each tree is carried with
the row. Blocks of rows send class counts for (node, term, bin); these are merged and searched in the executors, and the driver
gets one row for each node that is split. A job takes at most ``NODES`` nodes, the others wait. A node whose rows have
``CELLS`` weights or fewer, as rows have on average, is small: its rows are brought together once and one task grows all that
is below it, by the same steps. The rows of ``PARTS`` tasks move at a time, so what lies in a shuffle does not grow with the trees.

A node with fewer than ``minRows`` rows, of one class, or at ``maxDepth`` is a leaf. A node looks at the square root of all
terms: ``RUNS`` runs of a random order of the terms, begun where a hash of the tree and the path to the node says, so rows are only
asked for weights in these runs, and a tree is the same wherever it grows. A node that finds no cut looks at more and more
terms and takes the first that parts its rows, so only rows that no term parts end in a mixed leaf.

Weights are cut into bins as in :mod:`boosting`. Trees are held whole by the driver and by each task that scores: up to half as
many nodes as ``minRows`` rows fit into the training rows, so large collections need a larger ``minRows``.

Each tree sees a row as often as a Poisson number with mean 1 says, which is the bootstrap of a distributed table. The
numbers are drawn once and stored with the blocks in the checkpoint folder, so a lost executor can't change them.
Rows with a label that is no class are left out; a null text has no cells and goes to the side of zero.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from . import boosting
from .boosting import CLASSES, Block, added, bins_at, block_of, sparse

NODES = 20_000  # of a job
BUCKETS = 64  # nodes of a job are searched in so many parts
RUNS = 8  # of terms that a node looks at
WIDER = 8  # times as many terms at every further look at a node
CELLS = 4_000_000  # weights in the rows of a small node, and of the small nodes of a task, about
PARTS = 64  # tasks whose small nodes grow at a time
STEP = 4_000  # rows that are looked up at a time
CHECKPOINT = 10
ROWS = 0  # place of the number of rows in a node's counts; class counts follow


@dataclass
class Tree:
    """Node 0 is the root. ``term`` is -1 in a leaf; a row goes to ``left``, or to ``left + 1`` if its bin of
    the term is at least ``cut``. ``sums`` are rows, then how often each class was seen."""

    term: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    sums: np.ndarray  # nodes x (1 + classes)

    @classmethod
    def of(cls, sums: np.ndarray, depth: np.ndarray) -> "Tree":
        """Nodes without splits."""
        n = len(sums)
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int16), np.full(n, -1, np.int32),
                   np.asarray(depth, np.int16), np.asarray(sums, np.int64))

    @property
    def counts(self) -> list[list[int]]:
        return self.sums.tolist()

    def add(self, more: "Tree") -> None:
        for name, values in vars(more).items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))

    def part(self, node: np.ndarray, term: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Split leaves; the numbers of their left children."""
        children = len(self.term) + 2 * np.arange(len(node))
        self.term[node], self.cut[node], self.left[node] = term, cut, children
        self.add(Tree.of(np.stack([left, right], axis=1).reshape(-1, 1 + CLASSES), np.repeat(self.depth[node] + 1, 2)))
        return children


@dataclass
class Grown:
    """Rows of one task with the node they have come to in each tree, and how often each tree sees them."""

    rows: Block
    node: np.ndarray  # trees x rows
    times: np.ndarray


class Places:
    """Where weights lie in the cells of a block, by row and stretch of the order of the terms: about as many stretches as rows
    have weights, so a weight is found by a look-up and a step or two."""

    def __init__(self, rows: Block, n_terms: int) -> None:
        self.rows, self.n_terms, n_rows = rows, n_terms, max(len(rows.label), 1)
        self.width = -(-n_terms // min(max(len(rows.cells) // n_rows, 1), n_terms))
        self.stretches = -(-n_terms // self.width)
        row, term = np.divmod(rows.cells, n_terms)
        size = np.bincount(row * self.stretches + term // self.width, minlength=n_rows * self.stretches)
        self.begin = np.zeros(len(size) + 1, np.min_scalar_type(max(len(rows.cells), 1)))
        np.cumsum(size, out=self.begin[1:])

    def within(self, who: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of rows ``who`` in the ranges of terms of their nodes, which stand at ``at`` in ``begin`` and ``end``, and the
        place in ``who`` of each weight."""
        first_stretch, last_stretch, found = begin // self.width, -(-end // self.width), [np.zeros((2, 0), np.int64)]
        for step in range(0, len(who), STEP):
            row, node = who[step : step + STEP], at[step : step + STEP]
            first = (row * self.stretches)[:, None]
            low = self.begin[first + first_stretch[node]].reshape(-1)
            high = self.begin[first + last_stretch[node]].reshape(-1)
            some = np.flatnonzero(high > low)
            low, high = low[some].astype(np.int64), high[some].astype(np.int64)
            cell, (owner, run) = expanded(low, high), np.divmod(some, begin.shape[1])
            base = row[owner] * self.n_terms
            node = node[owner]
            size = high - low
            term = self.rows.cells[cell]
            inside = np.flatnonzero((term >= np.repeat(base + begin[node, run], size)) & (term < np.repeat(base + end[node, run], size)))
            found.append(np.stack([cell[inside], np.repeat(owner + step, size)[inside]]))
        return tuple(np.concatenate(found, axis=1))

    def bins_at(self, who: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """:func:`boosting.bins_at` by look-up."""
        found = np.zeros(len(who), np.int64)
        cell, owner = self.within(who, np.arange(len(who)), terms[:, None], terms[:, None] + 1)
        found[owner] = self.rows.bins[cell]
        return found


@dataclass
class Rules:
    """When a node is split, and by which terms. ``order`` holds the term at each place of a random order."""

    order: np.ndarray
    n_bins: int
    weights: np.ndarray
    min_rows: int
    max_depth: int
    first: int  # terms of a first look

    def open(self, sums: np.ndarray, depth: np.ndarray) -> np.ndarray:
        mixed = (sums[:, 1:] > 0).sum(axis=1) > 1
        return (sums[:, ROWS] >= self.min_rows) & (np.asarray(depth) < self.max_depth) & mixed


@dataclass
class Look:
    """Nodes that are looked at, with their counts, the hashes of their paths, and how many terms they look at."""

    counts: np.ndarray
    path: np.ndarray
    looked: np.ndarray

    def begins(self, n_terms: int) -> np.ndarray:
        """Where the runs of each node begin, in order; what a node has less of repeats its first."""
        drawn = np.stack([(mixed(self.path + np.uint64(j + 2)) % np.uint64(n_terms)).astype(np.int64) for j in range(RUNS)], axis=1)
        spare = np.arange(RUNS) >= self.looked[:, None]
        return np.sort(np.where(spare, drawn[:, :1], drawn), axis=1)

    def runs(self, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of each node's runs in the order of the terms. None overlap; one that passes the end
        of the order goes on at its begin."""
        begin = self.begins(n_terms)
        following = np.concatenate([begin[:, 1:], begin[:, :1] + n_terms], axis=1)
        width = -(-self.looked // np.minimum(self.looked, RUNS))
        width = np.where(self.looked >= n_terms, n_terms, width)
        end = np.minimum(begin + width[:, None], following)
        nothing = np.zeros((len(begin), 1), np.int64)
        return (np.concatenate([nothing, begin], axis=1),
                np.concatenate([np.maximum(end[:, -1:] - n_terms, 0), np.minimum(end, n_terms)], axis=1))


@dataclass
class Job:
    """A look at large nodes by (tree, number), in order, and the splits made since the last job in the same order."""

    nodes: np.ndarray
    look: Look
    splits: np.ndarray  # (tree, number), term, cut, left


def name(tree, node):
    return np.asarray(tree, np.int64) << 32 | np.asarray(node, np.int64)


def place(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` stand in ``names``, -1 if they don't."""
    if not len(names):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, at, -1)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def below(path: np.ndarray) -> np.ndarray:
    """Hashes of the paths to the left and right child of each node, in pairs."""
    return np.stack([mixed(path), mixed(path + np.uint64(1))], axis=1).reshape(-1)


def moved(block: Grown, job: Job, n_terms: int) -> Grown:
    """The block after the splits of the last job."""
    if not len(job.splits):
        return block
    node = block.node.copy()
    names, term, cut, left = job.splits.T
    for tree in range(len(node)):
        at = place(names, name(tree, node[tree]))
        going = np.flatnonzero((at >= 0) & (block.times[tree] > 0))
        at = at[going]
        node[tree, going] = left[at] + (bins_at(block.rows, n_terms, going, term[at]) >= cut[at])
    return Grown(block.rows, node, block.times)


def expanded(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = end - begin
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def node_counts(
    places: Places, who: np.ndarray, at: np.ndarray, seen: np.ndarray, runs: tuple, n_bins: int
) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (node's place, term, bin) and what each weight of rows ``who`` in the runs of their nodes ``at`` adds: a row and
    its classes."""
    rows, n_terms = places.rows, places.n_terms
    cell, owner = places.within(who, at, *runs)
    keys = ((at - who)[owner] * n_terms + rows.cells[cell]) * n_bins + rows.bins[cell]
    label, often = rows.label[who[owner]], seen[owner].astype(float)
    return keys, np.stack([np.ones(len(owner)), *(often * (label == c) for c in range(CLASSES))])


def block_counts(block: Grown, job: Job, runs: tuple, rules: Rules) -> Iterator[tuple[int, tuple]]:
    """Counts by (place of the node, term, bin) in parts by node: rows and classes."""
    n_terms, parts = len(rules.order), []
    places = Places(block.rows, n_terms)
    for tree in range(len(block.node)):
        at = np.where(block.times[tree] > 0, place(job.nodes, name(tree, block.node[tree])), -1)
        who = np.flatnonzero(at >= 0)
        if len(who):
            parts.append(node_counts(places, who, at[who], block.times[tree, who], runs, rules.n_bins))
    if not parts:
        return
    found, sums = added(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts], axis=1))
    bucket = found // (n_terms * rules.n_bins) % BUCKETS
    for b in np.unique(bucket):
        mine = bucket == b
        yield int(b), (found[mine], sums[:, mine])


def together(a: tuple, b: tuple) -> tuple:
    return added(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]], axis=1))


def best_splits(keys: np.ndarray, sums: np.ndarray, look: Look, rules: Rules) -> tuple[np.ndarray, ...]:
    """Place, term, cut, left counts and right counts of each node that has a cut. A node at its first look takes the purest
    cut of all its terms, others that of their first term from the begin of a run."""
    n_terms, empty = len(rules.order), np.zeros((0, 1 + CLASSES))
    if not len(keys):
        return (*np.zeros((3, 0), np.int64), empty, empty)
    group, bin_ = np.divmod(keys, rules.n_bins)
    node, term = np.divmod(group, n_terms)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(group))))
    running = np.cumsum(sums, axis=1)
    end = running[:, np.append(begin[1:], len(group)) - 1]
    right = (end[:, number] - running + sums).T
    left = look.counts[node] - right

    def purity(counts: np.ndarray) -> np.ndarray:
        weighed = counts[:, 1:] * rules.weights
        return (weighed ** 2).sum(axis=1) / np.maximum(weighed.sum(axis=1), 1e-300)

    gain = np.round(purity(left) + purity(right), 9)
    good = np.flatnonzero((left[:, ROWS] > 0.5) & (right[:, ROWS] > 0.5))
    turn = np.zeros(len(good), np.int64)
    later = np.flatnonzero(look.looked[node[good]] != rules.first)
    if len(later):
        there = node[good[later]]
        turn[later] = ((term[good[later], None] - look.begins(n_terms)[there]) % n_terms).min(axis=1)
    order = good[np.lexsort((bin_[good], rules.order[term[good]], -gain[good], turn, node[good]))]
    best = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])] if len(order) else order
    return node[best], term[best], bin_[best], left[best], right[best]


# --- small nodes -------------------------------------------------------------------------------------

@dataclass
class Rest:
    """Small nodes that grow at a time, by (tree, number), in order, with the part that each belongs to."""

    nodes: np.ndarray
    sums: np.ndarray
    path: np.ndarray
    depth: np.ndarray
    part: np.ndarray


def sent_rows(block: Grown, rest: Rest, n_terms: int) -> Iterator[tuple[int, tuple]]:
    """The rows of small nodes for each part: node's place, label, how often seen, number of weights; their terms and bins."""
    who, at, seen = [], [], []
    for tree in np.unique(rest.nodes >> 32):
        here = np.where(block.times[tree] > 0, place(rest.nodes, name(tree, block.node[tree])), -1)
        who.append(np.flatnonzero(here >= 0))
        at.append(here[who[-1]])
        seen.append(block.times[tree, who[-1]])
    who, at, seen = (np.concatenate(x) for x in (who, at, seen))
    border = np.searchsorted(block.rows.cells, np.arange(len(block.rows.label) + 1) * n_terms)
    terms = (block.rows.cells % n_terms).astype(np.int32)
    for part in np.unique(rest.part[at]):
        mine = rest.part[at] == part
        rows = who[mine]
        cell = expanded(border[rows], border[rows + 1])
        yield int(part), (at[mine].astype(np.int32), block.rows.label[rows].astype(np.int8), seen[mine],
                          np.diff(border)[rows].astype(np.int32), terms[cell], block.rows.bins[cell])


def grown_rest(chunks: list[tuple], rest: Rest, rules: Rules) -> tuple[np.ndarray, Tree, np.ndarray]:
    """Places of the small nodes that came, a table of nodes that begins with them, and for each node its place: all that
    grows below them. Children stand in pairs."""
    n_terms = len(rules.order)
    at, label, seen, size, term, bins = (np.concatenate(x) for x in zip(*chunks))
    cells = np.repeat(np.arange(len(at)) * n_terms, size) + term
    rows = Block(label.astype(np.int64), np.zeros((0, CLASSES)), cells, bins)
    places = Places(rows, n_terms)
    roots, node = np.unique(at, return_inverse=True)
    tree, path, root = Tree.of(rest.sums[roots], rest.depth[roots]), rest.path[roots], roots
    waiting, looked = np.arange(len(roots)), np.full(len(roots), rules.first)
    while len(waiting):
        look = Look(tree.sums[waiting], path[waiting], looked)
        where = np.full(len(tree.term), -1)
        where[waiting] = np.arange(len(waiting))
        who = np.flatnonzero(where[node] >= 0)
        keys, values = node_counts(places, who, where[node[who]], seen[who], look.runs(n_terms), rules.n_bins)
        found, cut_term, cut, left, right = best_splits(*added(keys, values), look, rules)
        parted = waiting[found]
        n_before = len(tree.term)
        children = tree.part(parted, cut_term, cut, left, right)
        path, root = np.concatenate([path, below(path[parted])]), np.concatenate([root, np.repeat(root[parted], 2)])
        going = who[tree.left[node[who]] >= 0]
        old = node[going]
        node[going] = tree.left[old] + (places.bins_at(going, tree.term[old].astype(np.int64)) >= tree.cut[old])
        new = np.arange(n_before, len(tree.term))
        new = new[rules.open(tree.sums[new], tree.depth[new])]
        again = np.setdiff1d(np.flatnonzero(looked < n_terms), found)
        waiting, looked = (
            np.concatenate([new, waiting[again]]),
            np.concatenate([np.full(len(new), rules.first), np.minimum(looked[again] * WIDER, n_terms)]))
    return roots, tree, root


def put_below(trees: list[Tree], roots: np.ndarray, grown: Tree, root: np.ndarray, rest: Rest) -> None:
    """Add what has grown below small nodes to their trees."""
    owner = rest.nodes[root] >> 32
    number = np.zeros(len(root), np.int64)
    number[:len(roots)] = rest.nodes[roots] & 0xFFFFFFFF
    for t in np.unique(owner):
        tree, mine = trees[t], np.flatnonzero(owner == t)
        new = mine[mine >= len(roots)]
        number[new] = len(tree.term) + np.arange(len(new))
        tree.add(Tree.of(grown.sums[new], grown.depth[new]))
        parted = mine[grown.term[mine] >= 0]
        at = number[parted]
        tree.term[at], tree.cut[at] = grown.term[parted], grown.cut[parted]
        tree.left[at] = number[grown.left[parted]]


# --- the model ---------------------------------------------------------------------------------------

@dataclass
class ForestModel:
    """A feature pipeline, the cuts of the weights, class weights and the trees."""

    features: PipelineModel
    cuts: list[float]
    weights: list[float]
    n_terms: int
    trees: list[Tree] = field(default_factory=list)

    def leaves(self, vectors: pa.Array) -> Iterator[tuple[Tree, np.ndarray]]:
        """Every tree, with the leaf that each vector comes to."""
        block = block_of(vectors, np.zeros(len(vectors), np.int64), np.array(self.cuts), self.n_terms, [0.0] * CLASSES)
        for tree in self.trees:
            term, cut, left = (x.astype(np.int64) for x in (tree.term, tree.cut, tree.left))
            node = np.zeros(len(vectors), np.int64)
            while len(going := np.flatnonzero(term[node] >= 0)):
                here = node[going]
                node[going] = left[here] + (bins_at(block, self.n_terms, going, term[here]) >= cut[here])
            yield tree, node

    def add_probabilities(self, df: DataFrame, out: str, vector: str = "features") -> DataFrame:
        """Mean over the trees of the class shares of a row's leaf."""
        slim = ForestModel(None, self.cuts, self.weights, self.n_terms, self.trees)

        @F.arrow_udf("array<double>")
        def shares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            values = []
            for tree in slim.trees:
                weighed = tree.sums[:, 1:] * slim.weights
                total = weighed.sum(axis=1, keepdims=True)
                values.append(np.divide(weighed, total, out=np.full_like(weighed, 1 / CLASSES), where=total > 0))
            for vectors in batches:
                found = np.zeros((len(vectors), CLASSES))
                for value, (_, node) in zip(values, slim.leaves(vectors)):
                    found += value[node]
                mean = (found / len(values)).ravel()
                yield pa.FixedSizeListArray.from_arrays(pa.array(mean), CLASSES).cast(pa.list_(pa.float64()))

        columns = df.columns
        unwrapped = df.select(*columns, F.unwrap_udt(vector).alias("_v"))
        return unwrapped.select(*columns, shares(sparse("_v")).alias(out))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and ``probabilities``."""
        columns = df.columns
        scored = self.add_probabilities(self.features.transform(df).select(*columns, "features"), "probabilities")
        return scored.drop("features").withColumn("prediction", S.argmax(F.col("probabilities")))

    def add_leaves(self, df: DataFrame, out: str = "leaves", vector: str = "features") -> DataFrame:
        """The number of the leaf in each tree, from a feature vector."""
        slim = ForestModel(None, self.cuts, self.weights, self.n_terms, self.trees)

        @F.arrow_udf("array<int>")
        def leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                node = np.stack([n for _, n in slim.leaves(vectors)], axis=1).astype(np.int32)
                yield pa.FixedSizeListArray.from_arrays(pa.array(node.ravel()), node.shape[1]).cast(pa.list_(pa.int32()))

        columns = df.columns
        unwrapped = df.select(*columns, F.unwrap_udt(vector).alias("_v"))
        return unwrapped.select(*columns, leaves(sparse("_v")).alias(out))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """A row for every node: ``tree, node, term, depth, n_rows`` and ``counts`` by class; a leaf has no term."""
        term, depth, sums = (np.concatenate([getattr(t, c) for t in self.trees]) for c in ("term", "depth", "sums"))
        counts = pa.FixedSizeListArray.from_arrays(pa.array(sums[:, 1:].astype(float).ravel()), CLASSES)
        rows = pa.table({
            "tree": np.repeat(np.arange(len(self.trees), dtype=np.int32), [len(t.term) for t in self.trees]),
            "node": np.concatenate([np.arange(len(t.term), dtype=np.int32) for t in self.trees]),
            "term": pa.array(term.astype(np.int64), mask=term < 0),
            "depth": depth.astype(np.int32),
            "n_rows": sums[:, ROWS],
            "counts": counts.cast(pa.list_(pa.float64())),
        })
        return spark.createDataFrame(rows)

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        kept = {"cuts": self.cuts, "weights": self.weights, "n_terms": self.n_terms}
        lines = [json.dumps(kept)] + [json.dumps({k: v.tolist() for k, v in vars(t).items()}) for t in self.trees]
        table = pa.table({"value": [f"{i:06d}{line}" for i, line in enumerate(lines)]})
        SparkSession.getActiveSession().createDataFrame(table).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> "ForestModel":
        rows = SparkSession.getActiveSession().read.text(f"{path}/metadata").orderBy("value").collect()  # one per tree
        kept, *trees = (json.loads(r["value"][6:]) for r in rows)
        return cls(PipelineModel.load(f"{path}/features"), **kept, trees=[_read_tree(t) for t in trees])


def _read_tree(kept: dict) -> Tree:
    sums = np.array(kept["sums"] if "sums" in kept else kept["counts"])  # ``counts``: stored by earlier versions
    tree = Tree.of(sums, kept["depth"])
    for column in ("term", "cut", "left"):
        getattr(tree, column)[:] = kept[column]
    return tree


# --- fitting -----------------------------------------------------------------------------------------

def fit(
    features: PipelineModel, data: DataFrame, numTrees: int = 200, maxDepth: int = 50, minRows: int = 5,
    share: float | None = None, bootstrap: bool = True, seed: int = 42,
) -> ForestModel:
    """Fit on ``features, label``. ``share`` of the terms is looked at by a node, the root of their number unless given."""
    facts, n_terms, counted, cuts, _ = boosting.training_facts(data)
    n_rows = sum(counted.values())
    weights = np.array([n_rows / (len(counted) * counted[c]) if c in counted else 0.0 for c in range(CLASSES)])
    looked = max(1, round((share if share is not None else n_terms ** -0.5) * n_terms))
    order = np.random.default_rng(seed).permutation(n_terms)
    rules = Rules(order, len(cuts) + 2, weights, minRows, maxDepth, min(looked, n_terms))
    begun = facts.select("label", "v").rdd.mapPartitionsWithIndex(
        lambda i, part: _drawn(i, boosting.packed(part, np.array(cuts), n_terms, [0.0] * CLASSES), order, numTrees, bootstrap, seed))
    blocks = begun.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    totals, n_cells = blocks.treeAggregate(
        (np.zeros((numTrees, 1 + CLASSES)), 0), lambda total, block: _plus(total, _root_counts(block)), _plus)
    trees = [Tree.of(sums[None], [0]) for sums in totals]
    paths = [mixed(np.array([t], np.uint64) + mixed(np.array([seed], np.uint64))) for t in range(numTrees)]
    small = CELLS * n_rows // max(n_cells, 1)  # rows
    waiting, rest = [], []  # (tree, node, terms of a look)
    sort = lambda t, node: (rest if trees[t].sums[node, ROWS] <= small else waiting).append((t, int(node), rules.first))
    for t, tree in enumerate(trees):
        if rules.open(tree.sums, tree.depth)[0]:
            sort(t, 0)
    splits, job_no, stale = np.zeros((0, 4), np.int64), 0, None
    try:
        while waiting or rest:
            taken, waiting = sorted(waiting[:NODES]), waiting[NODES:]
            tree_of, node_of, looked = np.array(taken, np.int64).reshape(-1, 3).T
            look = Look(
                np.array([trees[t].sums[n] for t, n, _ in taken]).reshape(-1, 1 + CLASSES),
                np.array([paths[t][n] for t, n, _ in taken], np.uint64), looked)
            job = Job(name(tree_of, node_of), look, splits)
            now = blocks.map(lambda block, job=job: moved(block, job, n_terms)).persist(StorageLevel.MEMORY_AND_DISK)
            job_no += 1
            if job_no % CHECKPOINT == 0:
                now.checkpoint()
            stale, blocks = blocks, now
            if not taken:  # all rows have come to small nodes
                _grow_rest(blocks, trees, paths, rest, rules, small)
                break
            at, term, cut, left, right = _searched(blocks, job, rules)
            stale.unpersist()
            made = []
            for t in np.unique(tree_of[at]):
                mine = np.flatnonzero(tree_of[at] == t)
                node = node_of[at[mine]]
                children = trees[t].part(node, term[mine], cut[mine], left[mine], right[mine])
                paths[t] = np.concatenate([paths[t], below(paths[t][node])])
                made.append(np.stack([name(t, node), term[mine], cut[mine], children], axis=1))
                new = np.stack([children, children + 1], axis=1).reshape(-1)
                for child in new[rules.open(trees[t].sums[new], trees[t].depth[new])]:
                    sort(t, child)
            for i in np.setdiff1d(np.flatnonzero(looked < n_terms), at):
                waiting.append((int(tree_of[i]), int(node_of[i]), min(int(looked[i]) * WIDER, n_terms)))
            splits = np.concatenate(made) if made else np.zeros((0, 4), np.int64)
            splits = splits[np.argsort(splits[:, 0])]
    finally:
        for held in (stale, blocks):
            if held is not None:
                held.unpersist()
    for tree in trees:  # terms had the numbers of their places in the order
        tree.term = np.where(tree.term >= 0, order[tree.term], -1).astype(np.int32)
    return ForestModel(features, cuts, weights.tolist(), n_terms, trees)


def _drawn(part: int, blocks: Iterator[Block], order: np.ndarray, n_trees: int, bootstrap: bool, seed: int) -> Iterator[Grown]:
    rng, n_terms, place_of = np.random.default_rng([seed, part]), len(order), np.argsort(order)
    for block in blocks:
        shape = (n_trees, len(block.label))
        times = rng.poisson(1.0, shape).astype(np.uint8) if bootstrap else np.ones(shape, np.uint8)
        row, term = np.divmod(block.cells, n_terms)
        cells = row * n_terms + place_of[term]
        sort = np.argsort(cells)
        rows = Block(block.label, block.margins, cells[sort], block.bins[sort].astype(np.uint8))
        yield Grown(rows, np.zeros(shape, np.int32), times)


def _root_counts(block: Grown) -> tuple[np.ndarray, int]:
    of_class = [(block.times * (block.rows.label == c)).sum(axis=1) for c in range(CLASSES)]
    return np.stack([(block.times > 0).sum(axis=1), *of_class], axis=1).astype(float), len(block.rows.cells)


def _plus(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    return a[0] + b[0], a[1] + b[1]


def _searched(blocks: RDD, job: Job, rules: Rules) -> tuple[np.ndarray, ...]:
    """The split of every node that has one, as in :func:`best_splits`."""
    runs = job.look.runs(len(rules.order))
    parts = min(BUCKETS, max(1, blocks.getNumPartitions()))
    summed = blocks.flatMap(lambda block: block_counts(block, job, runs, rules)).reduceByKey(together, parts)
    found = summed.map(lambda kept: best_splits(*kept[1], job.look, rules)).collect()  # one row a node
    return tuple(np.concatenate(x) for x in zip(*found)) if found else best_splits(np.zeros(0, np.int64), None, job.look, rules)


def _grow_rest(
    blocks: RDD, trees: list[Tree], paths: list[np.ndarray], nodes: list[tuple], rules: Rules, small: int
) -> None:
    """Grow all small nodes to their ends. A part has about as many rows as the largest small node may have, or fewer if that
    gives all cores work; ``PARTS`` parts are one job."""
    n_terms = len(rules.order)
    tree_of, node_of, _ = np.array(sorted(nodes), np.int64).T
    sums = np.stack([trees[t].sums[n] for t, n in zip(tree_of, node_of)])
    path = np.array([paths[t][n] for t, n in zip(tree_of, node_of)], np.uint64)
    depth = np.array([trees[t].depth[n] for t, n in zip(tree_of, node_of)])
    before = np.cumsum(sums[:, ROWS]) - sums[:, ROWS]
    wide = min(small, -(-int(sums[:, ROWS].sum()) // blocks.context.defaultParallelism))
    part = before // max(wide, 1)
    for first in range(0, int(part[-1]) + 1, PARTS):
        mine = (part >= first) & (part < first + PARTS)
        if not mine.any():
            continue
        rest = Rest(name(tree_of[mine], node_of[mine]), sums[mine], path[mine], depth[mine], part[mine] - first)

        def grow(chunks: Iterator[tuple[int, tuple]], rest=rest) -> Iterator[tuple]:
            held = [chunk for _, chunk in chunks]
            return iter([grown_rest(held, rest, rules)] if held else [])

        sent = blocks.flatMap(lambda block, rest=rest: sent_rows(block, rest, n_terms)).partitionBy(int(rest.part.max()) + 1, int)
        for grown in sent.mapPartitions(grow).collect():  # finished parts of trees, which the driver holds whole
            put_below(trees, *grown, rest)
