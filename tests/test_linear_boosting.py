import pickle

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tonewright.functions.lexicon import Lexicon
from tonewright.operators import linear, tfidf
from tonewright.plans import boosting, calibration, network, training


@pytest.fixture(scope="module")
def labelled(spark):
    words = {0: "loss decline weak", 1: "flat steady report", 2: "gain profit strong"}
    rows = [(i, f"{words[i % 3]} item {i % 7} in quarter {i % 4}", i % 3) for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, sentence string, label int").repartition(2).cache()


@pytest.mark.parametrize("name", training.LINEAR)
def test_contributions_add_up_to_the_margins(spark, labelled, tmp_path, name):
    changes = {} if name == "naive_bayes" else {"maxIter": 5}
    model = training.train_model(name, labelled, **changes)
    training.save_model(model, str(tmp_path), name)
    texts = labelled.select("doc_id", F.col("sentence").alias("text")).union(
        spark.createDataFrame([(1000, None), (1001, ""), (1002, "no known terms"), (1003, "profit profit LOSS")], "doc_id long, text string"))
    told = training.explain_by_name(str(tmp_path), f"baseline_{name}", texts, Lexicon(), keep=["text"])
    own = model.transform(texts.withColumn("sentence", F.coalesce("text", F.lit("")))).select(
        "doc_id", vector_to_array("rawPrediction").alias("raw"), F.col("prediction").alias("number"))
    rows = told.join(own, "doc_id").collect()
    assert len(rows) == 94
    for r in rows:
        assert np.allclose(r.margins, r.raw, rtol=0, atol=1e-9)
        total = np.array(training.linear_part(model).intercepts) + sum((np.array(c.by_class) for c in r.contributions), np.zeros(3))
        assert np.allclose(total, r.margins, atol=1e-12)
        assert r.prediction == ("negative", "neutral", "positive")[int(np.argmax(r.margins))] and abs(sum(r.probabilities) - 1) < 1e-12
        if r.doc_id < 1000:
            assert {0: "loss", 1: "flat", 2: "profit"}[r.doc_id % 3] in " ".join(w.word for w in r.speaks_for)
    empty = {r.doc_id: r for r in rows}[1000]
    assert empty.contributions == [] and empty.speaks_for == []
    assert [w.word for w in {r.doc_id: r for r in rows}[1003].negative_words][:1] == ["loss"]


def test_only_linear_models_are_explained(spark, labelled):
    forest = training.train_model("random_forest", labelled, numTrees=3)
    with pytest.raises(ValueError):
        training.linear_part(forest)
    none = linear.LinearModel(tfidf.Vocabulary((), ()), ((), (), ()), (0.5, 0.1, 0.2))
    r = linear.explain_linear(labelled, none, Lexicon(), text="sentence").first()
    assert r.margins == [0.5, 0.1, 0.2] and r.prediction == "negative" and r.contributions == []


# boosting

def dense_of(block, n_terms):
    grid = np.zeros((len(block.label), n_terms), int)
    row, term = np.divmod(block.cells, n_terms)
    grid[row, term] = block.bins
    return grid


def plain_tree(grid, gradient, curvature, depth):
    """A dictionary of nodes, grown over all cuts of all terms."""
    nodes = {}

    def grow(node, rows, level):
        g, h = gradient[rows].sum(), curvature[rows].sum()
        value = 2 / 3 * g / h if h > 1e-150 else 0.0
        best = (0.0,)
        if level < depth:
            for term in range(grid.shape[1]):
                for cut in sorted(set(grid[rows, term]) - {0}):
                    right = grid[rows, term] >= cut
                    if right.all() or not right.any():
                        continue
                    a, b = gradient[rows][right], gradient[rows][~right]
                    gain = round(a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - g ** 2 / len(rows), 12)
                    if gain > max(best[0], 1e-12):
                        best = (gain, term, cut, rows[~right], rows[right])
        nodes[node] = (value, *best[1:3])
        if best[0] > 0:
            grow(2 * node, best[3], level + 1)
            grow(2 * node + 1, best[4], level + 1)

    grow(1, np.arange(len(grid)), 0)
    return nodes


def test_trees_match_a_plain_version():
    rng = np.random.default_rng(0)
    n, n_terms, n_bins, depth = 60, 8, 5, 3
    grid = rng.integers(0, n_bins, (n, n_terms)) * (rng.random((n, n_terms)) < 0.5)
    label = rng.integers(0, 3, n)
    parts = []
    for rows in np.array_split(np.arange(n), 3):
        row, term = np.nonzero(grid[rows])
        parts.append(boosting.Block(label[rows], np.zeros((len(rows), 3)), row * n_terms + term, grid[rows][row, term]))
    assert (dense_of(parts[0], n_terms) == grid[:20]).all()
    margins = np.zeros((n, 3))
    for _ in range(4):
        tree = boosting.Tree.empty(depth)
        for level in range(depth):
            sums = None
            for block in parts:
                sums = boosting.merged(sums, boosting.level_sums(block, tree, n_terms, n_bins, level))
            boosting.split(tree, sums, n_terms, n_bins, level == depth - 1)
        shares = boosting.probabilities(margins)
        step = np.zeros((n, 3))
        for c in range(3):
            gradient = (label == c) - shares[:, c]
            expected = plain_tree(grid, gradient, np.abs(gradient) * (1 - np.abs(gradient)), depth)
            for node, (value, *cut) in expected.items():
                assert abs(tree.value[c, node] - value) < 1e-9
                assert [tree.term[c, node], tree.cut[c, node]] == cut if cut else tree.term[c, node] == -1
            assert (tree.term[c] >= 0).sum() == sum(len(v) > 1 for v in expected.values())
            step[:, c] = tree.value[c, np.concatenate([boosting.nodes_of(b, tree, c, n_terms) for b in parts])]
        margins += 0.1 * step
        parts = [boosting.after(b, tree, n_terms, 0.1) for b in parts]
        assert np.allclose(np.concatenate([b.margins for b in parts]), margins)


def test_the_driver_gets_the_best_cuts_only(spark):
    rng = np.random.default_rng(3)
    n, n_terms, n_bins = 400, 3000, 6
    grid = rng.integers(1, n_bins, (n, n_terms)) * (rng.random((n, n_terms)) < 0.1)
    label = rng.integers(0, 3, n)
    blocks = []
    for rows in np.array_split(np.arange(n), 5):
        row, term = np.nonzero(grid[rows])
        blocks.append(boosting.Block(label[rows], np.zeros((len(rows), 3)), row * n_terms + term, grid[rows][row, term]))
    held = spark.sparkContext.parallelize(blocks, 3)
    whole, dealt = boosting.Tree.empty(3), boosting.Tree.empty(3)
    for depth in range(3):
        sums = None
        for block in blocks:
            sums = boosting.merged(sums, boosting.level_sums(block, whole, n_terms, n_bins, depth))
        parts = boosting._level(held, dealt, n_terms, n_bins, depth)
        assert len(pickle.dumps(parts)) < 30_000  # sums of all terms and bins: 400 kB and more
        assert abs(parts[0].loss - sums.loss) < 1e-9
        assert boosting.apply_cuts(dealt, parts, depth == 2) == boosting.split(whole, sums, n_terms, n_bins, depth == 2)
    assert (whole.term == dealt.term).all() and (whole.cut == dealt.cut).all() and np.allclose(whole.value, dealt.value)
    empty = spark.sparkContext.parallelize([boosting.Block(label, np.zeros((n, 3)), np.zeros(0, int), np.zeros(0, int))], 2)
    parts = boosting._level(empty, boosting.Tree.empty(2), n_terms, n_bins, 0)
    assert not boosting.apply_cuts(boosting.Tree.empty(2), parts, False) and parts[0].loss > 0


def test_columns_give_the_trees_of_rows(spark, labelled, monkeypatch):
    """Weights dealt by term once give the trees that sums over blocks of rows give, in one group of rows and in several, and
    a level takes one job of the rows' columns."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(60)])
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 25))), int(rng.integers(0, 3))) for i in range(300)]
    texts = spark.createDataFrame([*rows, (900, "", 1), (901, "w1", None)], "doc_id long, sentence string, label int").repartition(3)
    features = training.fit_features(texts)
    data = training.vectors(features, texts, ["label"]).persist()
    facts, n_terms, counted, cuts, n_cells = boosting.training_facts(data)
    assert n_cells == sum((r.v["values"] > np.zeros(1)).sum() for r in facts.collect() if len(r.v["values"]))
    prior = [float(np.log(counted[c] / 301)) for c in range(3)]
    blocks = facts.rdd.mapPartitions(lambda part: boosting.packed(part, np.array(cuts), n_terms, prior)).collect()
    sent = list(boosting._sent(0, iter(blocks), 1, 2, n_terms, len(cuts) + 2))
    part = next(boosting._together((x for x in sent if x[0] == 1), 2, n_terms, len(cuts) + 2, prior))
    root = np.ones((3, len(part.label)), np.uint8)
    whole = boosting.column_cuts(part, root, (3, 4), len(cuts) + 2, 0)
    monkeypatch.setattr(boosting, "NEAR", 70)  # tables and weights come in steps
    steps = boosting.column_cuts(part, root, (3, 4), len(cuts) + 2, 0)
    assert len(whole.owner) == 3 and all(np.allclose(x, y) for x, y in zip(vars(whole).values(), vars(steps).values()))
    jobs, level = [], boosting._cuts
    monkeypatch.setattr(boosting, "_cuts", lambda *args: jobs.append(1) or level(*args))
    for rows_of_a_group in (1_000, 120):
        monkeypatch.setattr(boosting, "GROUP", rows_of_a_group)
        jobs.clear()
        model = boosting.fit(features, data, maxIter=4, maxDepth=4)
        assert len(jobs) == 4 * 4 + 1
        held = blocks
        for number, tree in enumerate(model.trees):
            loss = sum(boosting.loss_of(b.label, boosting.probabilities(b.margins)) for b in held) / 301
            assert abs(loss - model.losses[number]) < 1e-9
            plain = boosting.Tree.empty(4)
            for depth in range(4):
                sums = None
                for block in held:
                    sums = boosting.merged(sums, boosting.level_sums(block, plain, n_terms, len(cuts) + 2, depth))
                # cuts of equal gain may differ: the gains are compared, then the cuts of the model are made
                best = boosting.best_cuts(sums, n_terms, len(cuts) + 2)
                gain = dict(zip(best.owner.tolist(), best.gain))
                nodes = plain.term.shape[1]
                inner = np.flatnonzero((tree.term >= 0).ravel() & (np.arange(tree.term.size) % nodes >> depth == 1))
                assert set(inner.tolist()) == set(gain)
                place, bin_ = np.divmod(sums.keys, len(cuts) + 2)
                totals = sums.totals.reshape(-1, 3)
                for owner in inner.tolist():
                    term, cut = tree.term.ravel()[owner], tree.cut.ravel()[owner]
                    right = sums.cells[:, (place == owner * n_terms + term) & (bin_ >= cut)].sum(axis=1)
                    parts = [x[1] ** 2 / x[0] for x in (right, totals[owner] - right, totals[owner])]
                    assert abs(parts[0] + parts[1] - parts[2] - gain[owner]) < 1e-9
                plain.term.ravel()[inner], plain.cut.ravel()[inner] = tree.term.ravel()[inner], tree.cut.ravel()[inner]
            for c in range(3):  # the values of leaves, from the rows that come to them
                node = np.concatenate([boosting.nodes_of(b, tree, c, n_terms) for b in held])
                weights = [boosting.gradients(b.label, boosting.probabilities(b.margins), c) for b in held]
                gradient, curvature = (np.concatenate(x) for x in zip(*weights))
                for leaf in np.unique(node):
                    mine = node == leaf
                    assert abs(tree.value[c, leaf] - 2 / 3 * gradient[mine].sum() / curvature[mine].sum()) < 1e-9
            held = [boosting.after(b, tree, n_terms, 0.1) for b in held]
        known = facts.rdd.map(lambda r: r.label).collect()
        assert sorted(known) == sorted(np.concatenate([b.label for b in held]).tolist())
        scores = boosting.Scores(model.trees, n_terms, 0.1)
        for before, block in zip(blocks, held):
            assert np.allclose(scores(before), block.margins, atol=1e-12)


def test_boosting_learns_and_is_stored(spark, labelled, tmp_path):
    with_gaps = labelled.union(spark.createDataFrame([(500, "weak loss", 7), (501, "gain", None)], labelled.schema))
    model = training.train_model("gradient_boosting", with_gaps, maxIter=12, maxDepth=2)
    assert len(model.trees) == 12 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    assert training.evaluate_model("boosted", model, labelled).first().accuracy > 0.95
    training.save_model(model, str(tmp_path), "gradient_boosting")
    again = training.load_model(str(tmp_path), "gradient_boosting")
    texts = labelled.select("doc_id", "sentence").union(spark.createDataFrame([(900, ""), (901, "unknown")], "doc_id long, sentence string"))
    one, two = (training.score(m, texts).orderBy("doc_id").collect() for m in (model, again))
    assert one == two and all(abs(sum(r.prediction.probabilities.values()) - 1) < 1e-9 for r in one)
    assert training.list_models(spark, str(tmp_path))[0] == "baseline_gradient_boosting"


# calibration

def plain_line(margin, hit):
    """Gradient descent to the same loss in long steps, then Newton, in plain numpy."""
    p, q = hit.sum(), (~hit).sum()
    target = np.where(hit, (p + 1) / (p + 2), 1 / (q + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    line = np.zeros(2)
    for _ in range(5000):
        share = 1 / (1 + np.exp(-x @ line))
        line -= 4 / (x**2).sum() * (x.T @ (share - target))
    for _ in range(50):
        share = 1 / (1 + np.exp(-x @ line))
        line -= np.linalg.solve((x * (share * (1 - share))[:, None]).T @ x, x.T @ (share - target))
    return line


def test_sigmoids_match_a_plain_version(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        label = int(rng.integers(0, 3))
        margin = rng.normal(0, 1, 3) + 1.5 * np.eye(3)[label]
        if i % 2:
            margin = 40 * np.eye(3)[label] - 20.0  # no mistakes in this fold
        rows.append((i % 2, label, [float(m) for m in margin]))
    frame = spark.createDataFrame([*rows, (0, 9, [9.0] * 3), (0, None, [9.0] * 3), (0, 1, None)], "fold int, label int, margins array<double>")
    lines = calibration.fit_sigmoids(calibration.stacked_margins(frame).cache())
    assert set(lines) == {(f, c) for f in range(2) for c in range(3)}
    for c in range(3):
        mine = [r for r in rows if r[0] == 0]
        expected = plain_line(np.array([r[2][c] for r in mine]), np.array([r[1] == c for r in mine]))
        assert np.allclose(lines[0, c], expected, atol=1e-8)
        hits = sum(r[1] == c for r in rows if r[0] == 1)
        others = sum(r[0] == 1 for r in rows) - hits
        slope, intercept = lines[1, c]  # two different margins: the line meets both targets
        assert abs(1 / (1 + np.exp(-(20 * slope + intercept))) - (hits + 1) / (hits + 2)) < 1e-9
        assert abs(1 / (1 + np.exp(-(-20 * slope + intercept))) - 1 / (others + 2)) < 1e-9


def test_sigmoid_of_equal_margins(spark):
    frame = spark.createDataFrame([(0, i % 3, [1.0, 1.0, 1.0]) for i in range(30)], "fold int, label int, margins array<double>")
    for slope, intercept in calibration.fit_sigmoids(calibration.stacked_margins(frame)).values():
        assert abs(1 / (1 + np.exp(-(slope + intercept))) - (10 * 11 / 12 + 20 / 22) / 30) < 1e-9


# the neural network

def test_gradient_of_the_network():
    rng = np.random.default_rng(3)
    size, terms = [0, 2, 4, 1, 3], 6
    term = np.concatenate([rng.choice(terms, s, replace=False) for s in size])
    rows = network.Rows(np.array([0, 1, 2, 1, 0]), np.array([0, 0, 0, 0, 1], bool), np.cumsum([0, *size]), term, rng.random(10).astype(np.float32))
    # biases off zero: a row without terms would stand where the rectifier has no slope
    weights = [w.astype(np.float64) if w.ndim == 2 else rng.uniform(0.01, 0.1, w.shape) for w in network.initial(terms, 1)]
    part = network.epoch_part(rows, weights)
    assert (part.seen, part.held) == (4, 1)
    whole = np.zeros_like(weights[0])
    whole[part.terms] = part.first
    for layer, gradient in enumerate([whole, *part.others]):
        for place in rng.integers(0, weights[layer].size, 6):
            losses = []
            for step in (1e-4, -1e-4):
                moved = [w.copy() for w in weights]
                moved[layer].reshape(-1)[place] += step
                losses.append(network.epoch_part(rows, moved).loss)
            assert abs((losses[0] - losses[1]) / 2e-4 - gradient.reshape(-1)[place]) < 2e-3
    halves = [network.Rows(rows.label[a:b], rows.held_out[a:b], rows.begin[a: b + 1] - rows.begin[a],
                           term[rows.begin[a]: rows.begin[b]], rows.weight[rows.begin[a]: rows.begin[b]]) for a, b in ((0, 2), (2, 5))]
    both = network.merged(*[network.epoch_part(h, weights) for h in halves])
    assert (both.terms == part.terms).all() and np.allclose(both.first, part.first, atol=1e-6) and abs(both.loss - part.loss) < 1e-6


def test_network_stops_early_keeps_the_best_and_goes_on(spark, labelled, tmp_path):
    noisy = labelled.withColumn("label", F.when(F.col("doc_id") % 11 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label")))
    features = training.fit_features(noisy)
    data = training.vectors(features, noisy, ["label"])
    model = network.fit(features, data, patience=4)
    shares = [s for _, s in model.curve]
    assert len(shares) < 500 and shares[model.best_epoch] == max(shares) and len(shares) - model.best_epoch > 4
    assert model.curve[-1][0] < model.curve[0][0] / 2
    training.save_model(model, str(tmp_path), "mlp")
    again = training.load_model(str(tmp_path), "mlp")
    one, two = (training.score(m, labelled).orderBy("doc_id").collect() for m in (model, again))
    assert one == two and again.curve == model.curve
    assert sum(r.prediction.prediction == r.label for r in one) > 80
    more = network.fit(features, data, maxIter=1, start=again)
    assert abs(more.curve[0][1] - max(shares)) < 1e-9


def test_the_driver_gets_one_gradient(spark):
    rng = np.random.default_rng(5)
    terms, blocks = 400, []
    for _ in range(12):
        size = rng.integers(0, 40, 20)
        term = np.concatenate([np.sort(rng.choice(terms, n, False)) for n in size]).astype(np.int64)
        blocks.append(network.Rows(rng.integers(0, 3, 20), rng.random(20) < 0.1, np.cumsum([0, *size]), term, rng.random(len(term)).astype(np.float32)))
    weights = network.initial(terms, 1)
    whole = None
    for block in blocks:
        whole = network.merged(whole, network.epoch_part(block, weights))
    parts = network.gradient_parts(spark.sparkContext.parallelize(blocks, 12), spark.sparkContext.broadcast(weights))
    assert sum(p.first.nbytes for p in parts) <= weights[0].nbytes  # each task's part: several times as much
    found = np.concatenate([p.terms for p in parts])
    order = np.argsort(found)
    assert (found[order] == whole.terms).all()
    assert np.allclose(np.concatenate([p.first for p in parts])[order], whole.first, atol=1e-5)
    rest = [p for p in parts if p.others]
    assert len(rest) == 1 and (rest[0].seen, rest[0].held, rest[0].hits) == (whole.seen, whole.held, whole.hits)
    assert abs(rest[0].loss - whole.loss) < 1e-9 and all(np.allclose(x, y, atol=1e-5) for x, y in zip(rest[0].others, whole.others))
