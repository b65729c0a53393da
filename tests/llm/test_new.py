import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tonewright.llm import fim, fingerprints, queries, search
from tonewright.sources.tables import table


# fill in the middle

UNIT = {"char": "(?s).", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", "line": "[^\n]*\n|[^\n]+"}


def plain_cut(key, text, unit, seed=1):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), out


def odd_texts():
    rng = random.Random(3)
    return [None, "", " ", "\n\n", "a", "é", "😀", "a <P> b", "x<S", "<", "<<P", "M>", "P><S", " lead and\ttrail \n",
            "one\ntwo\n\nthree", "".join(rng.choice("aé😀 \n<PSM>") for _ in range(5000)), "long words " * 30_000, "é" * 70_000]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_fill_in_middle_matches_a_plain_version(spark, unit):
    texts = odd_texts()
    rows = [(i, t, "psm?", 5) for i, t in enumerate(texts)] + [(None, "no key at all", "a", 6), (None, None, "b", 7)]
    rows += rows[:4] + [(100 + i, f"text number {i} of\nmany, é {i}", "c", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, at int")
    done = fim.fill_in_middle(docs, unit=unit).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(done) == len(rows)
    known = {(i, t): plain_cut(i, t, unit) for i, t, *_ in rows}
    forms = set()
    for r in done:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == known[r.doc_id, r.text]
        assert r.back == (r.text or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_skip_list_finds_every_rank():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aé😀\n "), size=n)) for n in (0, 1, 2, 40, 3000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for unit in fim.UNITS:
        lanes, heads, count = fim.skip_list(data, offsets, unit)
        assert len(lanes) > 1 and all(len(a.units) <= len(b.units) for a, b in zip(lanes[1:], lanes))
        for number, text in enumerate(texts):
            parts = re.findall(UNIT[unit], text)
            assert count[number] == len(parts)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(int)
            ranks = np.arange(len(parts) + 1)
            assert (fim.descend(lanes, np.full(len(ranks), heads[number]), ranks) == ends).all()


def test_fill_in_middle_of_nothing(spark):
    docs = table(spark, SF, "documents").where("false")
    assert fim.fill_in_middle(docs).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="page")


def test_fill_in_middle_moves_nothing(spark):
    plan = queries.op13_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


# fingerprints

SHARE = [0, *[round(c * math.log2(c) * 1024) for c in range(1, 33)]]
MASK = (1 << 64) - 1


def plain_class(window):
    return 1000 * (SHARE[32] - sum(SHARE[c] for c in Counter(window).values())) // SHARE[32]


def plain_ranks(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(plain_class(r[i: i + 32]) for r in raw for i in range(len(r) - 31))
    order = sorted(range(1001), key=lambda c: (c < 100, count[c], c))
    return {c: i for i, c in enumerate(order)}


def plain_hash(window, size):
    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
        return x ^ (x >> 31)

    total = size
    for i in range(0, len(window), 8):
        total = (mixed(total ^ int.from_bytes(window[i: i + 8], "little")) + i // 8 + 1) & MASK
    return mixed(total)


def plain_fingerprint(text, ranks):
    raw = (text or "").encode()
    if len(raw) < 128:
        size = min(8, len(raw))
        found = [plain_hash(raw[i: i + size].ljust(8, b"\0"), size) for i in range(len(raw) - size + 1)] if raw else []
    else:
        rank = [ranks[plain_class(raw[i: i + 32])] for i in range(len(raw) - 31)]
        chosen = Counter(min(range(i, i + 32), key=lambda p: (rank[p], p)) for i in range(len(rank) - 31))
        most = min(chosen, key=lambda p: (-chosen[p], p))
        found = [plain_hash(raw[p: p + 32], 32) for p in sorted(chosen) if chosen[p] >= 8 or p == most]
    found = list(dict.fromkeys(found))
    chain = []
    for i in range(0, len(found), 160):
        bits = [0] * 256
        for h in found[i: i + 160]:
            for k in range(5):
                b = (h >> 11 * k) & 2047
                bits[b // 8] |= 1 << b % 8
        chain.append((len(found[i: i + 160]), bytes(bits)))
    return chain


def plain_likeness(a, b):
    if not a or not b:
        return float(not a and not b)

    def alike(x, y):
        x, y = int.from_bytes(x, "little"), int.from_bytes(y, "little")
        chance, mean = x.bit_count() * y.bit_count() / 2048, (x.bit_count() + y.bit_count()) / 2
        return max(0.0, ((x & y).bit_count() - chance) / (mean - chance))

    total = sum(n * max(alike(f, g) for _, g in other) for own, other in ((a, b), (b, a)) for n, f in own)
    return total / sum(n for n, _ in a + b)


def as_text(chain):
    return base64.b64encode(b"".join(bytes([n]) + bits for n, bits in chain)).decode()


def plain_trial(rows):
    """{key: result} for distinct keys."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0]))
    ranks = plain_ranks([t for _, t in rows])
    out = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        own, other, following = (plain_fingerprint(t, ranks) for t in (text, changed, after))
        out[key] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(own), as_text(other),
                    plain_likeness(own, other), plain_likeness(own, following))
    return out


def check_trial(done, rows):
    expected = plain_trial(rows)
    assert len(done) == len(rows)
    for r in done:
        n, sha, own, other, near_edited, near_next = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, own, other), r.doc_id
        assert abs(r.near_edited - near_edited) < 1e-12 and abs(r.near_next - near_next) < 1e-12


def test_fingerprints_match_a_plain_version(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts = [None, "", "a", "é" * 3, "short text", "x" * 127, "x" * 128, "ab" * 300, "é" * 64, "😀" * 40]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 900))) for _ in range(40)] + [" ".join(words * 9), "y" * 9000]
    rows = [(None, "the first of all, as nulls come first"), *[(3 * i, t) for i, t in enumerate(texts)]]
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id int, text string, part string").repartition(3)
    ranks = fingerprints.rarity(docs)
    assert dict(enumerate(ranks.tolist())) == plain_ranks(texts + [rows[0][1]])
    done = fingerprints.edit_trial(docs, ranks).collect()
    check_trial(done, rows)
    known = {r.doc_id: r.fingerprint for r in done}
    for r in docs.withColumn("fingerprint", fingerprints.fingerprint(F.col("text"), ranks)).collect():
        assert r.fingerprint == known[r.doc_id] and r.part == "z"


def test_chains_of_parts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (20_000, 0, 50, 140, 3_000)]
    data, offsets = fingerprints.pack_texts(texts)
    ranks = np.random.default_rng(1).permutation(1001).astype(np.uint16)
    whole = fingerprints.chains(data, offsets, ranks)
    monkeypatch.setattr(fingerprints, "PART", 1000)
    monkeypatch.setattr(fingerprints, "BLOCK", 100)
    parts = fingerprints.chains(data, offsets, ranks)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_likeness_of_fingerprints(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.random()) for _ in range(2000))
    docs = spark.createDataFrame([(long, long), (long, long[:30_000]), (long, None), ("", ""), ("", long), (long[:5000], long)], "a string, b string")
    ranks = fingerprints.rarity(docs, "a")
    prints = docs.select(fingerprints.fingerprint(F.col("a"), ranks).alias("a"),
                         F.when(F.col("b").isNotNull(), fingerprints.fingerprint(F.col("b"), ranks)).alias("b"))
    got = [r[0] for r in prints.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and 0.85 < got[1] < 0.95 and got[2] is None and got[3] == 1.0 and got[4] == 0.0 and got[5] < 0.35


def test_trial_of_odd_tables(spark):
    def trial(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return fingerprints.edit_trial(docs, fingerprints.rarity(docs)).collect()

    assert trial([]) == []
    check_trial(trial([(5, "only one document, which is followed by itself")]), [(5, "only one document, which is followed by itself")])
    again = trial([(1, "same"), (1, "same"), (None, "same"), (None, None), (2, "other")] * 20)
    assert len(again) == 100
    assert {r.fingerprint for r in again if r.n_chars == 4} == {again[0].fingerprint if again[0].n_chars == 4 else
                                                              next(r.fingerprint for r in again if r.n_chars == 4)}


def test_query_of_fingerprints(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    done = queries.op12_improbable_features(spark, SF).collect()
    check_trial(done, rows)
    by_text = {}
    for (key, text), r in zip(sorted(rows), sorted(done)):
        assert key == r.doc_id and by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited > 0.4 for r in done]) > 0.95 and np.mean([r.near_next < 0.2 for r in done]) > 0.95


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    """[(item, rank, doc, score)] for rows (key, text); a null key comes first among equals."""
    bags = [(key, Counter(plain_terms(text))) for key, text in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(1 for s in sizes if s), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (key, bag), n in zip(bags, sizes):
            m = 10 + 90 * n * n_docs // n_terms if n_terms else 10
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in set(plain_terms(text)) if t in bag)
            if score > 0:
                scored.append((-score, key is not None, key or 0, key))
        scored.sort(key=lambda x: x[:3])
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(scored[:k])]
    return sorted(out, key=repr)


def random_texts(rng, n, words, longest):
    frequent = sorted(rng.random() ** 3 for _ in words)
    return ["".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", ", ", "\n", "-", "_"])
                    for w in rng.choices(words, frequent, k=rng.randint(0, longest))) for _ in range(n)]


def test_search_matches_a_plain_version(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdé9ß") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    texts = random_texts(rng, 300, words, 60) + [None, "", " .,;", "é" * 9000, "Ab " * 20_000]
    docs = [(i // 2 if i % 50 else None, t) for i, t in enumerate(texts)]
    docs += [(1000 + i, texts[7]) for i in range(40)]  # ties
    items = [(i % 25 if i != 3 else None, t) for i, t in enumerate(random_texts(rng, 30, words, 12))]
    items += [(90, None), (91, ""), (92, "zzzzz"), (93, "É ÀÉ 9"), (94, "a " * 50), (95, " ".join(words))]
    docs_df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, rank int").repartition(5)
    items_df = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, score int")
    for k in (1, 4, 400):
        got = sorted((tuple(r) for r in search.search(docs_df, items_df, k).collect()), key=repr)
        assert got == plain_search(docs, items, k)


def test_search_in_blocks_of_items(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs, items = list(enumerate(random_texts(rng, 60, words, 30))), list(enumerate(random_texts(rng, 12, words, 9)))
    monkeypatch.setattr(search, "INDEX_BYTES", 100)
    found = search.search(spark.createDataFrame(docs, "doc_id int, text string"),
                          spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(docs, items, 3)


def test_chunks_and_light_terms_lose_nothing(monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs = list(enumerate(random_texts(rng, 400, words, 80)))
    items = list(enumerate(random_texts(rng, 10, words, 40)))
    data, offsets = fingerprints.pack_texts([t for _, t in items])
    import pyarrow as pa
    index = search.Index.of(pa.array([t for _, t in items]))
    monkeypatch.setattr(search, "CELLS", 50)
    data, offsets = fingerprints.pack_texts([t for _, t in docs])
    _, term, _, n = search.term_counts(index, data, offsets)
    df = np.bincount(term, minlength=len(index.hashes))
    n_docs, n_terms = int((n > 0).sum()), int(n.sum())
    scorer = search.Scorer(index, search.term_weights(n_docs, df), n_docs, n_terms, 5)
    scorer.add(data, offsets, np.ones(len(docs), bool), np.arange(len(docs)))
    got = sorted(((i, r + 1, int(scorer.heaps.key[i, r]), int(s)) for i, row in enumerate(scorer.heaps.score)
                  for r, s in enumerate(row) if s > 0), key=repr)
    assert got == plain_search(docs, items, 5)


def test_terms_that_share_a_hash(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(search, "span_hash", lambda total, start, end: (end - start).astype(np.uint64))
    index = search.Index.of(pa.array(["one two six three", "ten seven"]))
    data, offsets = fingerprints.pack_texts(["six ten xxx ONE three", "seven seven eight two"])
    doc, term, count, n = search.term_counts(index, data, offsets)
    letters = index.letters.tobytes()
    found = {(int(d), letters[index.begins[t]: index.begins[t] + index.sizes[t]]): int(c) for d, t, c in zip(doc, term, count)}
    assert found == {(0, b"six"): 1, (0, b"ten"): 1, (0, b"one"): 1, (0, b"three"): 1, (1, b"seven"): 2, (1, b"two"): 1}
    assert n.tolist() == [5, 4]


def test_search_of_nothing(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    assert search.search(docs.where("false"), items).count() == 0
    assert search.search(docs, items.where("false")).count() == 0
    with pytest.raises(ValueError):
        search.search(docs, items, key="source")
