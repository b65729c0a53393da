import random

import numpy as np
import pytest
from llm import brute
from conftest import SF
from pyspark.sql import functions as F

from tonewright.llm import components, embeddings, minhash, queries, suffix
from tonewright.llm.common import checkpoint
from tonewright.sources.tables import table

RNG = random.Random(3)


def words(n, rng=RNG):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(text, n, rng=RNG):
    parts = text.split(" ")
    for i in rng.sample(range(len(parts)), n):
        parts[i] = "zzz" + parts[i]
    return " ".join(parts)


def odd_documents():
    """Nulls, blanks, ties, copies, long texts, groups of near copies."""
    base, other = words(300), words(60)
    texts = [None, "", " \n\t", "one two", "One  TWO", "one two three four five", "x " * 3000, base, base, base.upper()]
    texts += [edited(base, n) for n in (1, 2, 3, 5, 8, 12, 20)]
    texts += [edited(other, n) for n in (0, 1, 1, 2, 3)]
    texts += [other + " " + words(40), words(5000), "é" * 400, None, ""]
    return list(enumerate(texts))


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


def test_components_match_a_plain_version(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)]
    links += [(5, 5), (5, 5)]
    got = {r["node"]: r["component"] for r in
           components.connected_components(frame(spark, links + [(None, 3)], "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == brute.components({x for p in real for x in p}, real)


def test_components_of_nothing(spark):
    assert components.connected_components(frame(spark, [], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_near_duplicates_match_a_plain_version(spark, percent):
    rows = odd_documents()
    docs = frame(spark, [(*r, 1, "x") for r in rows], "doc_id long, text string, k1 long, component string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           minhash.near_duplicates(docs, percent=percent).collect()}
    assert got == brute.near_duplicates(rows, percent)


def test_near_duplicates_in_other_documents_of_an_entry(spark):
    # two groups whose members may meet in one table entry without being similar to its first document
    base = words(100)
    rows = [(i, edited(base, n)) for i, n in enumerate([20, 20, 0, 1, 2, 20, 3])]
    got = {r["doc_id"]: r["component_id"] for r in
           minhash.near_duplicates(frame(spark, rows), percent=80, bands=12, rows=1).collect()}
    assert got == {d: c for d, (_, c) in brute.near_duplicates(rows, 80).items()}


def test_large_groups_are_verified_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "TILE", 7)
    rng = random.Random(12)
    bases = [words(120, rng), words(90, rng)]
    rows = [(i, edited(bases[i % 2], rng.randint(0, 5), rng)) for i in range(70)]
    got = {r["doc_id"]: r["component_id"] for r in
           minhash.near_duplicates(frame(spark, rows), percent=85).collect()}
    assert got == {d: c for d, (_, c) in brute.near_duplicates(rows, 85).items()}
    assert len(set(got.values())) > 2


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60))).astype(np.uint64) for _ in range(20)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[9:]] for a in sets[:9]]
    assert (minhash.shared_counts(sets[:9], sets[9:]) == expected).all()
    assert minhash.shared_counts([np.zeros(0, np.uint64)], sets[:2]).shape == (1, 2)


def test_near_duplicates_of_repeated_rows_and_of_nothing(spark):
    rows = [(1, words(20)), (2, words(20)), (None, words(20))]
    got = minhash.near_duplicates(frame(spark, rows + rows), percent=80).collect()
    assert len(got) == 6 and all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)
    assert minhash.near_duplicates(frame(spark, []), percent=80).count() == 0


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(12)
    base, other, third, fourth = (words(200, rng) for _ in range(4))
    rows = [(1, base), (1, base), (None, base), (2, edited(base, 1, rng)), (None, other), (None, other),
            (None, edited(other, 1, rng)), (5, third), (5, edited(third, 1, rng)), (5, fourth), (None, None), (None, None)]
    kind = "doc_id long, text string, source string"
    docs = frame(spark, [(d, t, f"s{i}") for i, (d, t) in enumerate(rows)], kind)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    assert sorted((d or 0) for d, _, _ in got) == [0, 0, 1, 5, 5]
    texts = [t for _, t, _ in got]
    assert (1, base, "s0") in got and fourth in texts and None in texts
    assert sum("".join((t or "").split("zzz")) == other for t in texts) == 1
    # what stays is no copy of anything, so the next stage leaves it whole
    cut = suffix.cut_repeats(frame(spark, got, kind)).collect()
    assert sorted(r["text"] or "" for r in cut) == sorted(t or "" for t in texts)


def test_bands_follow_the_threshold(spark):
    assert [minhash.bands_for(p) for p in (80, 85, 95)] == [10, 8, 8]
    # 80 of 100 shingles in common; no table of 8 x 8 holds both
    rng = random.Random(211)
    parts = [f"{rng.getrandbits(32):x}" for _ in range(104)]
    rows = [(1, " ".join(parts[:94])), (2, " ".join(parts[:84] + parts[94:]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), percent=80).collect()}
    assert got == {1: 1, 2: 1}


def test_query_near_duplicates(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    expected = brute.near_duplicates(rows, 85)
    got = queries.op6_minhash(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("length,gram,hot", [(20, 5, 50_000), (20, 5, 2), (20, 20, 50_000), (16, 3, 1)])
def test_repeats_match_a_plain_version(spark, length, gram, hot):
    rng = random.Random(length + gram + hot)
    stock = ["".join(rng.choice("ab " if rng.random() < 0.3 else "abcdé\0") for _ in range(rng.randint(5, 60)))
             for _ in range(12)]
    texts = ["", "a" * 50, "a" * 19, "é" * 30, None, "ab" * 40, "\0" * 45]
    for _ in range(60):
        texts.append("".join(
            rng.choice(stock) if rng.random() < 0.6 else "".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 40)))
            for _ in range(rng.randint(0, 5))))
    texts += texts[5:12]
    docs = frame(spark, list(enumerate(texts))).repartition(3)
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs, length=length, gram=gram, hot=hot).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (text, mask) in enumerate(zip(raw, brute.repeated_bytes(raw, length))):
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(text, np.uint8)[~mask])
        assert len(got[i]["spans"]) == brute.runs(mask)


def test_merge_of_transforms_is_exact():
    rng = np.random.default_rng(0)
    length, gram = 12, 4
    reach = length - gram
    width = reach + length
    for _ in range(200):
        m = int(rng.integers(2, 12))
        group = rng.integers(0, 3, m).astype(np.uint64)
        left, right = rng.integers(0, reach + 1, m), rng.integers(gram, length + 1, m)
        matrix = rng.integers(0, rng.integers(1, 4), (m, width)).astype(np.int16)
        for i in range(m):
            a, b = sorted(rng.integers(0, width + 1, 2))
            matrix[i, a:b] = matrix[rng.integers(0, m), a:b]
        for i in range(m):
            matrix[i, : reach - left[i]] = matrix[i, reach + right[i]:] = suffix.ABSENT
        shard, parts, numbers = rng.integers(0, 3, m), [], []
        for s in range(3):
            mine = np.flatnonzero(shard == s)
            mine = mine[np.argsort(group[mine], kind="stable")]
            strings = np.zeros(len(mine), suffix.STRING)
            strings["group"], strings["left"], strings["right"], strings["many"] = group[mine], left[mine], right[mine], 1
            stored = np.where(matrix[mine] == suffix.ABSENT, 0, matrix[mine]).astype(np.uint8)
            parts.append((strings, suffix.transform(stored, strings, reach).ravel()))
            numbers.append(mine)
        numbers = np.concatenate(numbers)
        marks = suffix.merge(parts, length, gram)
        for a, i in enumerate(numbers):
            for j in range(reach + 1):
                own = matrix[i, j: j + length]
                again = (own != suffix.ABSENT).all() and any(
                    k != i and group[k] == group[i] and (matrix[k, j: j + length] == own).all() for k in range(m))
                assert marks[j, a] == again


def test_query_repeats(spark):
    rows = table(spark, SF, "documents").collect()
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    masks = dict(zip(raw, brute.repeated_bytes(list(raw.values()), 200)))
    got = queries.op2_suffix_dedup(spark, SF).collect()
    assert len(got) == len(rows) and sum(r["n_removed"] for r in got) > 0
    for r in got:
        text, mask = raw[r["doc_id"]], masks[r["doc_id"]]
        kept = bytes(np.frombuffer(text, np.uint8)[~mask])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(text), int(mask.sum()), brute.runs(mask), brute.sha(kept))


def test_repeats_of_nothing(spark):
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_cut_texts_keep_whole_characters(spark):
    shared = "é" * 150
    rows = [(1, "aé" + shared + "x", "en", "s", 9), (2, "bè" + shared + "y", "en", "s", 9), (3, None, None, None, None)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in suffix.cut_repeats(docs).collect()}
    assert got[1]["text"] == "ax" and got[1]["n_chars"] == 2  # the é before the shared run belongs to it here
    assert got[2]["text"] == "bèy" and got[3]["text"] is None and got[3]["n_chars"] is None


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vectors_match_a_plain_version(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(160):
        v = centres[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.25, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 11 else 0))
    rows += [(200 + i, rows[7][1], rows[7][2]) for i in range(30)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1),
             (304, rows[0][1], None), (305, [float("inf")] + [0.0] * 15, 1), (306, [], 1), (307, [1.0, 2.0], 0),
             (308, [2.0, 4.0], 0), (309, [-0.0, 1.0], 0), (310, [0.0, 1.0], 0)]
    expected = brute.vector_links(rows, 0.93)
    for tile in (16, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
               embeddings.near_duplicate_vectors(vectors(spark, rows), tile=tile).collect()}
        assert got == expected


def test_codes_never_miss_a_pair():
    rng = np.random.default_rng(4)
    x = embeddings.unit_rows(rng.normal(size=(200, 8)) * 10.0 ** rng.integers(-30, 30, (200, 1)))
    for threshold in (0.2, 0.7, 0.93):
        i, j = embeddings.linked_pairs(x, x, threshold)
        assert set(zip(i, j)) == set(zip(*np.nonzero(x @ x.T >= threshold)))


def test_vectors_of_nothing_and_query(spark):
    assert embeddings.near_duplicate_vectors(vectors(spark, [])).count() == 0
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None, r["label"])
            for r in table(spark, SF, "embeddings").collect()]
    expected = brute.vector_links(rows, 0.93)
    for r in queries.op3_vector_dedup(spark, SF).collect():
        assert (r["n_links"], r["component_id"]) == expected[r["vec_id"]]
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, t, "en" if d % 2 else "fr", None if d % 5 == 0 else f"s{d % 3}", None) for d, t in odd_documents()]
    for docs in (frame(spark, [], kind), frame(spark, rows, kind), frame(spark, rows + rows[:9], kind)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.format("noop").mode("overwrite").save()


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, SF)
    expected = brute.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()], 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in expected.items() if c == d)
    cut = stages["repeats"](spark, docs, SF).agg(F.sum(F.octet_length("text"))).first()[0]
    assert cut < docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_one_of_each_with_maps_clashing_names_and_repeats(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i % 3 or None, t, {"a": i}, i, f"r{i}") for i, t in enumerate([text, text + " more", "other " + text, "x y z", None, "", text] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marks map<string,int>, _tw_row int, no string")
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert sum(t is not None and "word1 " in t for t in texts) == 1 and texts.count("x y z") == 1


def test_many_small_tiles(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = base[:]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows.append((90, " ".join(base + base[::-1])))
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "TILE", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.near_duplicates(rows, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, percent=90).collect()}
    assert got == expected


def test_components_make_no_round_in_vain(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "checkpoint", lambda df: made.append(1) or checkpoint(df))
    star = frame(spark, [(1, n) for n in range(2, 40)] + [(50, 51), (52, 50)], "a long, b long")
    told = {r.node: r.component for r in components.connected_components(star).collect()}
    assert told == {**{n: 1 for n in range(1, 40)}, **{n: 50 for n in (50, 51, 52)}}
    assert len(made) == 1  # the links alone
    chain = frame(spark, [(n, n + 1) for n in range(30)], "a long, b long")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}
