"""Quality rules as a short-circuit cascade.

On a sample of about ``SAMPLE_ROWS`` rows every rule is timed on what the base rules leave, with the features known that
are known by then. The order is greedy: next comes the rule with most rejections, among documents that no rule before it
rejects, for each second that it adds. A document is out at the first rule that rejects it: later rules don't
see it. The order changes what is computed and which rule is named in ``rejected_by`` (it follows the clock),
never who is kept.

Words are runs of bytes other than ASCII white space; symbols are ``#*$%&|<>``; a duplicate line has a
word and equals an earlier line of its text; a repeated word lies in a window of eight words that
occurs at least twice in the text (windows are compared by 64-bit hashes).

Nulls and odd input: a null text has no words and fails the rule on few words; a null key stays; repeated
rows are judged one by one; an empty table gives an empty result; extra columns pass through and
those named like the result are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import add_by_text, prefix_hash, slices, span_hash, text_bytes, word_bounds
from tonewright.llm.minhash import combine

WINDOW = 8
SAMPLE_ROWS = 2000  # the bound on what the estimate reads

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHARACTER = np.ones(256, bool)  # first bytes of characters that stand in words
_CHARACTER[0x80:0xC0] = False
_CHARACTER[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True  # first bytes of most letters beyond ASCII
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True
BLANK = b" \t\n\x0b\x0c\r"


@dataclass
class Texts:
    """Some texts as bytes; features are computed when a rule first asks for them."""

    data: np.ndarray
    offsets: np.ndarray
    known: dict[str, np.ndarray] = field(default_factory=dict)
    spent: dict[str, float] = field(default_factory=dict)  # seconds of each feature, without those that it asks for

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, feature: str) -> np.ndarray:
        if feature not in self.known:
            begin, before = time.perf_counter(), sum(self.spent.values())
            self.known[feature] = FEATURES[feature](self)
            asked = sum(self.spent.values()) - before
            self.spent[feature] = time.perf_counter() - begin - asked
        return self.known[feature]

    def take(self, rows: np.ndarray) -> Texts:
        parts = [self.data[self.offsets[i]: self.offsets[i + 1]] for i in rows]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        data = np.concatenate(parts) if parts else self.data[:0]
        kept = {k: v[rows] for k, v in self.known.items() if not k.startswith("_")}
        return Texts(data, offsets, kept)

    def count(self, kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[self.data], dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def _words(texts: Texts) -> np.ndarray:
    return np.stack(word_bounds(texts.data, texts.offsets))


def _n_words(texts: Texts) -> np.ndarray:
    return np.diff(np.searchsorted(texts["_words"][0], texts.offsets))


def _lines(texts: Texts) -> np.ndarray:
    """Lines with a word, and how many of them equal an earlier line."""
    out = np.zeros((len(texts), 2), np.int64)
    raw = texts.data.tobytes()
    for i in range(len(texts)):
        lines = [x for x in raw[texts.offsets[i]: texts.offsets[i + 1]].split(b"\n") if x.strip(BLANK)]
        out[i] = len(lines), len(lines) - len(set(lines))
    return out


def _repeat_words(texts: Texts) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    start, end = texts["_words"]
    if len(start) < WINDOW:
        return out
    hashes = combine(span_hash(prefix_hash(texts.data), start, end), WINDOW, 6)
    first = np.searchsorted(start, texts.offsets)
    for i in range(len(texts)):
        mine = hashes[first[i]: max(first[i], first[i + 1] - WINDOW + 1)]
        ordered = np.sort(mine)
        if len(mine) < 2 or not (ordered[1:] == ordered[:-1]).any():
            continue
        _, which, number = np.unique(mine, return_inverse=True, return_counts=True)
        cover = np.zeros(len(mine) + WINDOW, np.int64)
        spots = np.flatnonzero(number[which] > 1)
        cover[spots] += 1
        cover[spots + WINDOW] -= 1
        out[i] = (np.cumsum(cover) > 0).sum()
    return out


def _lettered(texts: Texts) -> np.ndarray:
    """Words with a letter."""
    start, end = texts["_words"]
    total = np.concatenate([[0], np.cumsum(_LETTER[texts.data], dtype=np.int64)])
    has = np.concatenate([[0], np.cumsum(total[end] > total[start])])
    first = np.searchsorted(start, texts.offsets)
    return has[first[1:]] - has[first[:-1]]


def _stutters(texts: Texts) -> np.ndarray:
    """Words that equal the word before."""
    start, end = texts["_words"]
    first = np.searchsorted(start, texts.offsets)
    again = np.zeros(len(start), bool)
    if len(start):
        hashes = span_hash(prefix_hash(texts.data), start, end)
        again[1:] = hashes[1:] == hashes[:-1]
        again[first[:-1][first[:-1] < len(start)]] = False
    total = np.concatenate([[0], np.cumsum(again)])
    return total[first[1:]] - total[first[:-1]]


FEATURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "_words": _words,
    "n_words": _n_words,
    "word_chars": lambda t: t.count(_CHARACTER),
    "n_symbols": lambda t: t.count(_SYMBOL),
    "lines": _lines,
    "n_dup_lines": lambda t: t["lines"][:, 1],
    "n_repeat_words": _repeat_words,
    "upper": lambda t: t.count(_UPPER),
    "letters": lambda t: t.count(_LETTER),
    "shouts": lambda t: t.count(_SHOUT),
    "lettered": _lettered,
    "stutters": _stutters,
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


def few_words(t: Texts) -> np.ndarray:
    return t["n_words"] < 20


def many_repeats(t: Texts) -> np.ndarray:
    return 100 * t["n_repeat_words"] > 30 * t["n_words"]


def many_symbols(t: Texts) -> np.ndarray:
    return 10 * t["n_symbols"] > t["n_words"]


def odd_word_length(t: Texts) -> np.ndarray:
    return (t["word_chars"] < 3 * t["n_words"]) | (t["word_chars"] > 10 * t["n_words"])


def many_duplicate_lines(t: Texts) -> np.ndarray:
    return 10 * t["n_dup_lines"] > 3 * t["lines"][:, 0]


def mostly_capitals(t: Texts) -> np.ndarray:
    return 2 * t["upper"] > t["letters"]


def many_shouts(t: Texts) -> np.ndarray:
    return 2 * t["shouts"] > t["n_words"]


def few_lettered_words(t: Texts) -> np.ndarray:
    return 10 * t["lettered"] < 8 * t["n_words"]


def stuttering(t: Texts) -> np.ndarray:
    return 10 * t["stutters"] > 3 * t["n_words"]


BASE = (Rule("few_words", few_words), Rule("many_repeats", many_repeats))
RULES = (
    Rule("many_symbols", many_symbols),
    Rule("odd_word_length", odd_word_length),
    Rule("many_duplicate_lines", many_duplicate_lines),
    Rule("mostly_capitals", mostly_capitals),
    Rule("many_shouts", many_shouts),
    Rule("few_lettered_words", few_lettered_words),
    Rule("stuttering", stuttering),
)


@dataclass
class Seen:
    """What a sample says: seconds of each rule by itself, seconds of the features that it computes beyond those that are
    known before the cascade, and how many documents are rejected by exactly the rules of a set (bits of their places)."""

    own: dict[str, float]
    needs: dict[str, dict[str, float]]
    rejected: dict[int, int]


def estimate(
    sample: DataFrame, text: str, rules: Sequence[Rule], base: Sequence[Rule] = (), report: Sequence[str] = ()
) -> Seen:
    """Time every rule on the sample's documents that ``base`` leaves, where the features of ``report`` and of ``base`` are
    known already, as they are in the cascade."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            whole = Texts(data, offsets)
            failed = np.zeros(len(whole), bool)
            for name in report:
                whole[name]
            for rule in base:
                failed |= rule.rejects(whole)
            left = whole.take(np.flatnonzero(~failed)) if failed.any() else whole
            if not len(left):
                continue
            found, mask = [], np.zeros(len(left), np.int64)
            for i, rule in enumerate(rules):
                fresh = Texts(left.data, left.offsets, dict(left.known))
                begin = time.perf_counter()
                out = rule.rejects(fresh)
                took = time.perf_counter() - begin
                mask |= out.astype(np.int64) << i
                found += [(rule.name, f, None, s, 0) for f, s in fresh.spent.items()]
                found.append((rule.name, None, None, took - sum(fresh.spent.values()), 0))
            found += [(None, None, int(m), 0.0, int(n)) for m, n in zip(*np.unique(mask, return_counts=True))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(
                    zip(*found), (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64()))],
                names=["rule", "feature", "mask", "seconds", "n"])

    rows = (  # rules x features, and no more sets than documents in the sample
        sample.select(text).mapInArrow(run, "rule string, feature string, mask long, seconds double, n long")
        .groupBy("rule", "feature", "mask").agg(F.sum("seconds").alias("s"), F.sum("n").alias("n")).collect()
    )
    seen = Seen({}, {r.name: {} for r in rules}, {})
    for r in rows:
        if r["rule"] is None:
            seen.rejected[r["mask"]] = r["n"]
        elif r["feature"] is None:
            seen.own[r["rule"]] = r["s"]
        else:
            seen.needs[r["rule"]][r["feature"]] = r["s"]
    return seen


def greedy_order(rules: Sequence[Rule], seen: Seen) -> list[Rule]:
    """Next comes the rule with most rejections, among documents that the rules before it leave, for each second that it adds:
    features that a rule before it has computed cost nothing again."""
    known: set[str] = set()
    left, rest, ordered = dict(seen.rejected), list(enumerate(rules)), []

    def worth(place: int, rule: Rule) -> float:
        rejected = sum(n for mask, n in left.items() if mask >> place & 1)
        adds = sum(s for f, s in seen.needs[rule.name].items() if f not in known)
        return (rejected + 0.5) / (max(seen.own.get(rule.name, 0.0), 0.0) + adds + 1e-6)

    while rest:
        place, rule = max(rest, key=lambda x: worth(*x))
        rest.remove((place, rule))
        ordered.append(rule)
        left = {mask: n for mask, n in left.items() if not mask >> place & 1}
        known |= {f for f in seen.needs[rule.name] if not f.startswith("_")}  # bounds are made anew for fewer texts
    return ordered


def order_rules(
    docs: DataFrame, text: str, key: str, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS,
    base: Sequence[Rule] = (), report: Sequence[str] = (),
) -> list[Rule]:
    """Rules in greedy order by a random sample of about ``sample_rows`` rows, whatever their keys and texts."""
    total = docs.select(F.count("*")).first()[0]
    sample = docs.where(F.rand(17) < sample_rows / max(total, 1))
    return greedy_order(rules, estimate(sample, text, rules, base, report))


def cascade(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    base: Sequence[Rule] = BASE,
    rules: Sequence[Rule] = RULES,
    report: Sequence[str] = (),
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Add ``base_failed``, ``rejected_by`` (the rule that ended the cascade), ``kept`` and the features of ``report``.

    All of ``base`` is evaluated; the documents it leaves go through ``rules`` in the estimated order.
    Features in ``report`` are computed for every document, all others only where a rule asks.
    """
    ordered = order_rules(docs, text, key, rules, sample_rows, base, report)

    def work(texts: pa.Array) -> dict[str, object]:
        data, offsets = text_bytes(texts)
        made: dict[str, list] = {n: [] for n in ("base_failed", "kept", "rejected_by", *report)}
        for lo, hi in slices(offsets):
            whole = Texts(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
            for name in report:
                made[name].append(whole[name].astype(np.int64))
            failed = np.zeros(hi - lo, bool)
            for rule in base:
                failed |= rule.rejects(whole)
            by = np.full(hi - lo, None, object)
            by[failed] = "base"
            rows = np.flatnonzero(~failed)
            left = whole.take(rows) if failed.any() else whole
            for rule in ordered:
                if not len(rows):
                    break
                out = rule.rejects(left)
                if out.any():
                    by[rows[out]] = rule.name
                    rows = rows[~out]
                    left = left.take(np.flatnonzero(~out))
            made["base_failed"].append(failed)
            made["rejected_by"].append(by)
            kept = np.zeros(hi - lo, bool)
            kept[rows] = True
            made["kept"].append(kept)
        empty = {"rejected_by": np.zeros(0, object)}
        joined = {n: np.concatenate(v) if v else empty.get(n, np.zeros(0, np.int64)) for n, v in made.items()}
        kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}
        return {n: pa.array(v.tolist(), kinds[n]) if n in kinds else pa.array(v) for n, v in joined.items()}

    fields = ", ".join(["base_failed boolean", "rejected_by string", "kept boolean", *(f"{n} long" for n in report)])
    return add_by_text(docs, text, fields, work)
