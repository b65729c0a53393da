import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.plans import catalog, forest, training


@pytest.fixture(scope="module")
def noisy(spark):
    """Texts whose class follows no word, so trees go on until rows can't be parted."""
    rng = np.random.default_rng(3)
    words = np.array("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 9))), int(rng.integers(0, 3))) for i in range(120)]
    rows += [(200, "alpha", 0), (201, "alpha", 1), (202, "", 2), (203, None, 1), (204, "zeta", 9), (205, "zeta", None)]
    return spark.createDataFrame(rows, "doc_id long, sentence string, label int").repartition(3).cache()


def grid_of(model, df):
    rows = training.vectors(model.features, df, ["doc_id", "label"]).orderBy("doc_id").collect()
    grid = np.zeros((len(rows), model.n_terms), int)
    for i, r in enumerate(rows):
        for term, weight in zip(r.features.indices, r.features.values):
            grid[i, term] = np.searchsorted(model.cuts, weight, "left") + 1 if weight > 0 else 0
    return [r.doc_id for r in rows], grid, np.array([r.label for r in rows])


def plain_tree(grid, label, weights, min_rows, max_depth):
    """All nodes as ``path: (term, cut, counts)``, by trying every cut of every term."""
    nodes = {}

    def counts(rows):
        return np.bincount(label[rows], minlength=3)

    def purity(rows):
        w = counts(rows) * weights
        return (w ** 2).sum() / w.sum()

    def grow(path, rows):
        best = None
        if len(rows) >= min_rows and len(path) < max_depth and (counts(rows) > 0).sum() > 1:
            for term in range(grid.shape[1]):
                for cut in sorted(set(grid[rows, term]) - {0}):
                    right = grid[rows, term] >= cut
                    if not right.all():
                        gain = round(purity(rows[right]) + purity(rows[~right]), 9)
                        if best is None or gain > best[0] + 1e-8:
                            best = (gain, term, cut, rows[~right], rows[right])
        nodes[path] = (*(best[1:3] if best else (-1, 0)), counts(rows).tolist())
        if best:
            grow(path + "l", best[3])
            grow(path + "r", best[4])

    grow("", np.arange(len(grid)))
    return nodes


def as_paths(tree):
    found = {}

    def walk(path, node):
        found[path] = (tree.term[node], tree.cut[node] if tree.term[node] >= 0 else 0, tree.counts[node][1:])
        if tree.term[node] >= 0:
            walk(path + "l", tree.left[node])
            walk(path + "r", tree.left[node] + 1)

    walk("", 0)
    return found


@pytest.mark.parametrize("options", [{}, {"maxDepth": 3, "minRows": 2}, {"minRows": 30}])
def test_trees_match_a_plain_version(spark, noisy, monkeypatch, options):
    monkeypatch.setattr(forest, "NODES", 8)  # nodes have to wait for their turn
    monkeypatch.setattr(forest, "CHECKPOINT", 4)
    model = training.train_model("random_forest", noisy, numTrees=2, share=1.0, bootstrap=False, **options)
    known = noisy.where("label between 0 and 2")
    _, grid, label = grid_of(model, known)
    expected = plain_tree(grid, label, np.array(model.weights), options.get("minRows", 5), options.get("maxDepth", 50))
    for tree in model.trees:
        assert as_paths(tree) == expected


def test_few_terms_at_a_time_still_part_all_rows(spark, noisy):
    """However few terms a node looks at first, only rows that no term parts end in a mixed leaf."""
    model = training.train_model("random_forest", noisy, numTrees=4, share=0.01, bootstrap=False, minRows=2)
    ids, grid, label = grid_of(model, noisy.where("label between 0 and 2"))
    leaves = {r.doc_id: r.leaves for r in model.add_leaves(training.vectors(model.features, noisy, ["doc_id"])).collect()}
    for number in range(4):
        together = {}
        for i, key in enumerate(ids):
            together.setdefault(leaves[key][number], []).append(i)
        for rows in together.values():
            assert len(set(label[rows])) == 1 or len({tuple(grid[i]) for i in rows}) == 1
    assert len({tuple(t.term) for t in model.trees}) == 4  # trees look at different terms


def test_forest_scores_and_is_stored(spark, noisy, tmp_path):
    model = training.train_model("random_forest", noisy, numTrees=12)
    sizes = {int(t.counts[0][forest.ROWS]) for t in model.trees}
    assert len(sizes) > 1 and all(50 < s < 110 for s in sizes)  # each tree sees its own rows
    nodes = model.nodes(spark)
    inner, leaf = nodes.where("term is not null"), nodes.where("term is null")
    assert inner.where("n_rows < 5").count() == 0 and leaf.where("n_rows < 1").count() == 0
    assert leaf.groupBy("tree").count().collect() and inner.count() + 12 == leaf.count()
    training.save_model(model, str(tmp_path), "random_forest")
    again = training.load_model(str(tmp_path), "random_forest")
    one, two = (training.score(m, noisy.drop("label")).orderBy("doc_id").collect() for m in (model, again))
    assert one == two and all(abs(sum(r.prediction.probabilities.values()) - 1) < 1e-9 for r in one)
    right = training.score(model, noisy).where("prediction.prediction = label").count()
    assert right > 0.6 * noisy.count()  # rows that were seen
    assert len(one) == noisy.count()


def test_forest_of_one_class_and_of_nothing(spark, noisy):
    model = training.train_model("random_forest", noisy.where("label = 1"), numTrees=2)
    assert [t.term for t in model.trees] == [[-1], [-1]]
    assert {r.prediction.prediction for r in training.score(model, noisy).collect()} == {1}
    with pytest.raises(ValueError):
        training.train_model("random_forest", noisy.where("label = 9"), numTrees=2)


def test_deep_trees_on_the_given_tables(spark):
    train = catalog.training_data(spark, "/root/testdata/sf0.01").where("split = 'train'")
    model = training.train_model("random_forest", train, numTrees=6)
    assert 30 < model.nodes(spark).agg(F.max("depth")).first()[0] <= 50


def test_small_nodes_grow_in_one_task_to_the_same_trees(spark, noisy, monkeypatch):
    """A tree is the same whether its nodes are split level by level over all rows or below small nodes in one task, which
    takes no job for a level."""
    searched, jobs, grown = forest._searched, [], {}
    monkeypatch.setattr(forest, "_searched", lambda *args: jobs.append(1) or searched(*args))
    for cells in (0, 150, 4_000_000):
        monkeypatch.setattr(forest, "CELLS", cells)
        jobs.clear()
        model = training.train_model("random_forest", noisy, numTrees=3, minRows=2)
        grown[cells] = [as_paths(tree) for tree in model.trees], len(jobs)
    (far, n_far), (some, n_some), (near, n_near) = grown.values()
    assert far == some == near and any(len(tree) > 30 for tree in far)
    assert n_far > n_some > 0 == n_near


def test_weights_are_found_by_look_up(monkeypatch):
    """The weights of rows in the runs of their nodes, as a comparison of every weight with every run finds them; rows without
    weights, empty and whole ranges included."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(forest, "STEP", 7)
    n_terms, n = 90, 50
    for share in (0.0, 0.02, 0.3, 1.0):
        grid = rng.integers(1, 9, (n, n_terms)) * (rng.random((n, n_terms)) < share)
        grid[10:13] = 0
        row, term = np.nonzero(grid)
        rows = forest.Block(rng.integers(0, 3, n), np.zeros((n, 3)), row * n_terms + term, grid[row, term])
        places = forest.Places(rows, n_terms)
        assert len(places.begin) <= 1 + max(len(rows.cells), n) * 2  # grows with the weights, not with rows x terms
        look = forest.Look(np.zeros((6, 4)), np.arange(6, dtype=np.uint64) * np.uint64(77), np.array([1, 5, 9, 40, 89, 90]))
        begin, end = look.runs(n_terms)
        who = np.sort(rng.choice(n, 30, False))
        at = rng.integers(0, 6, 30)
        cell, owner = places.within(who, at, begin, end)
        expected = [(w, t) for i, w in enumerate(who) for t in np.flatnonzero(grid[w]) if ((begin[at[i]] <= t) & (t < end[at[i]])).any()]
        assert sorted(zip(row[cell], term[cell])) == expected and (who[owner] == row[cell]).all()
        asked = rng.integers(0, n_terms, 30)
        assert (places.bins_at(who, asked) == grid[who, asked]).all()
