"""Language identification in two levels: family first, then the languages within it.

Texts become frequencies of hashed byte n-grams. Linear support vector machines decide, one against
one: first between families, then between the languages of the winning family. Training takes a
bounded sample of labelled rows; prediction reads whole texts, batch by batch.

Nulls and odd input: a null text, or one without a letter, is ``und`` with score 0; rows with a null
language, and texts without a letter, aren't learned from; a corpus without any labelled row gives
``und`` everywhere; repeated rows count each time; an empty table gives an empty result. Extra columns
pass through; columns named like the result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.common import add_by_text, slices, text_bytes

UNDETERMINED = "und"
#: Sampled labelled rows for each language: the bound on what the fit gathers.
SAMPLE_PER_LANGUAGE = 500
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
ROUNDS = 20

# Language families of some ISO 639-1 codes. A code not listed is a family by itself.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn mr gu pa ne",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def gram_ids(data: np.ndarray, size: int) -> np.ndarray:
    """A bucket for the n-gram that starts at each byte; lower case in ASCII, white space alike."""
    low = _LOWER[data]
    code = low[: len(low) - size + 1].copy()
    for i in range(1, size):
        code = code * np.uint32(0x01000193) ^ low[i: len(low) - size + 1 + i]
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    return (code + np.uint32(size * 0x51ED27)) & np.uint32(BUCKETS - 1)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        text = data[offsets[i]: offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


@dataclass
class Duel:
    """One linear machine: the weights favour ``first`` above zero and ``second`` below."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    between: list[Duel] = field(default_factory=list)
    within: dict[str, list[Duel]] = field(default_factory=dict)

    def predict(self, texts: pa.Array) -> dict[str, object]:
        """Language and score of each text."""
        data, offsets = text_bytes(texts)
        names: list[str] = []
        scores: list[np.ndarray] = []
        for first, last in slices(offsets):
            part = data[offsets[first]: offsets[last]]
            n, s = self._predict(part, offsets[first: last + 1] - offsets[first])
            names.extend(n)
            scores.append(s)
        return {
            "lang_pred": pa.array(names, pa.string()),
            "score": pa.array(np.concatenate(scores) if scores else np.zeros(0)),
        }

    def _predict(self, data, offsets):
        rows = len(offsets) - 1
        duels = [*self.between, *(d for group in self.within.values() for d in group)]
        letters = has_letter(data, offsets)
        if not self.families:
            return [UNDETERMINED] * rows, np.zeros(rows)
        margins = np.zeros((rows, len(duels)))
        if duels and len(data):
            table = np.stack([d.weights for d in duels], axis=1).astype(np.float32)
            counted = np.zeros(rows)
            for size in GRAMS:
                if len(data) < size:
                    continue
                ids = gram_ids(data, size)
                # n-grams that would reach into the next text are left out
                ends = np.maximum(offsets[1:] - size + 1, offsets[:-1])
                for j in range(len(duels)):
                    total = np.zeros(len(ids) + 1)
                    np.cumsum(table[ids, j], out=total[1:])
                    stop, start = np.minimum(ends, len(ids)), np.minimum(offsets[:-1], len(ids))
                    margins[:, j] += total[stop] - total[start]
                counted += ends - offsets[:-1]
            margins /= np.maximum(counted, 1)[:, None]
        margins += np.array([d.bias for d in duels])
        names, scores = [], np.zeros(rows)
        confidence = 1 / (1 + np.exp(-4 * np.clip(np.abs(margins), 0, 50)))
        column = {id(d): j for j, d in enumerate(duels)}
        for i in range(rows):
            if not letters[i]:
                names.append(UNDETERMINED)
                continue
            family, a = self._vote(sorted(self.families), self.between, margins[i], confidence[i], column)
            name, b = self._vote(
                self.families[family], self.within.get(family, []), margins[i], confidence[i], column
            )
            names.append(name)
            scores[i] = a * b
        return names, scores

    @staticmethod
    def _vote(names, duels, margin, confidence, column):
        """Most wins; ties go to the larger sum of margins, then to the earlier name."""
        if len(names) == 1:
            return names[0], 1.0
        wins = {n: [0, 0.0] for n in names}
        for duel in duels:
            m = margin[column[id(duel)]]
            winner, loser = (duel.first, duel.second) if m > 0 else (duel.second, duel.first)
            wins[winner][0] += 1
            wins[winner][1] += abs(m)
            wins[loser][1] -= abs(m)
        best = max(sorted(wins), key=lambda n: tuple(wins[n]))
        worst = min(
            (confidence[column[id(d)]] if (d.first if margin[column[id(d)]] > 0 else d.second) == best
             else 1 - confidence[column[id(d)]])
            for d in duels if best in (d.first, d.second)
        )
        return best, float(worst)


def train_machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 10.0):
    """A linear support vector machine by dual coordinate descent over sparse rows (ids, values)."""
    weights, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    limit = np.where(signs > 0, cost / max((signs > 0).mean(), 1e-9), cost / max((signs < 0).mean(), 1e-9)) / 2
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            ids, values = rows[i]
            gradient = signs[i] * (weights[ids] @ values + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                alpha[i] = new
                weights[ids] += step * values
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


SCALE = 30.0  # frequencies are small; this brings rows to a length near one


def fit_rows(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Fit on rows (language, n-gram buckets, counts)."""
    by: dict[str, list[int]] = {}
    rows = []
    for i, (lang, ids, counts) in enumerate(samples):
        by.setdefault(lang, []).append(i)
        rows.append((ids, (counts / counts.sum() * SCALE).astype(np.float32)))
    model = LanguageModel()
    for lang in sorted(by):
        model.families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)

    def duel(first, second, left, right):
        chosen = [*left, *right]
        signs = np.array([1.0] * len(left) + [-1.0] * len(right))
        weights, bias = train_machine([rows[i] for i in chosen], signs)
        return Duel(first, second, (weights * SCALE).astype(np.float32), bias)

    members = {f: [i for n in names for i in by[n]] for f, names in model.families.items()}
    names = sorted(members)
    model.between = [
        duel(a, b, members[a], members[b]) for k, a in enumerate(names) for b in names[k + 1:]
    ]
    for family, langs in model.families.items():
        model.within[family] = [
            duel(a, b, by[a], by[b]) for k, a in enumerate(langs) for b in langs[k + 1:]
        ]
    return model


GRAM_ID, GRAM_COUNT = np.dtype("<u2"), np.dtype("<u4")


def count_grams(texts: pa.Array) -> dict[str, object]:
    """N-gram buckets of each text and their counts, packed: the driver gathers the sample's."""
    data, offsets = text_bytes(texts)
    letters = has_letter(data, offsets)
    ids, counts = [], []
    for i in range(len(offsets) - 1):
        part = data[offsets[i]: offsets[i + 1]]
        found = [gram_ids(part, g) for g in GRAMS if len(part) >= g] if letters[i] else []
        u, c = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
        ids.append(np.asarray(u, GRAM_ID).tobytes())
        counts.append(np.asarray(c, GRAM_COUNT).tobytes())
    return {"gram_ids": pa.array(ids, pa.binary()), "gram_counts": pa.array(counts, pa.binary())}


def fit_language_model(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each language, chosen by a hash of the key and text.

    Distinct rows of each language are counted first, about; each gets the share of rows that gives the sample
    somewhat more than its size, and at least the row with the smallest hash. Rows that are equal enter once
    and the sample is cut to its size, so what is gathered is bounded by languages times ``per_language``.
    """
    rows = labelled.select(
        F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where("lang is not null and text is not null")
    parts = 1 << 30
    # by key as well, so that copies of one text don't enter or stay out together
    rows = rows.withColumn("hash", F.xxhash64("k", "lang", "text"))
    hashed = F.pmod("hash", F.lit(parts))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"), F.min(hashed).alias("least")).collect()
    if not counts:
        return LanguageModel()
    share = F.create_map(*[
        F.lit(x) for r in sorted(counts, key=lambda r: r["lang"])
        for x in (r["lang"], min(parts, max(2 * parts * per_language // max(r["n"], 1), r["least"]) + 1))
    ])
    some = rows.where(hashed < share[F.col("lang")]).dropDuplicates(["lang", "hash"])
    order = Window.partitionBy("lang").orderBy("hash")
    sample = some.withColumn("number", F.row_number().over(order)).where(F.col("number") <= per_language)
    sample = sample.select("k", "text", "lang")
    grams = add_by_text(sample, "text", "gram_ids binary, gram_counts binary", count_grams)
    got = grams.where(F.octet_length("gram_ids") > 0).select("k", "lang", "gram_ids", "gram_counts").collect()
    got.sort(key=lambda r: (r["k"] is None, r["k"], r["lang"], len(r["gram_ids"])))
    return fit_rows([
        (r["lang"], np.frombuffer(r["gram_ids"], GRAM_ID), np.frombuffer(r["gram_counts"], GRAM_COUNT))
        for r in got
    ])


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) from the whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few weight vectors for each pair

    def work(texts: pa.Array) -> dict[str, object]:
        return shared.value.predict(texts)

    return add_by_text(df, text, "lang_pred string, score double", work)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id"
) -> DataFrame:
    """Fit on the rows that may be learned from and keep the rows whose language can be told."""
    model = fit_language_model(docs.where(~held_out(F.col(key))), text, lang, key)
    named = docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns})
    found = identify(named, model, f"_in_{text}").where(F.col("lang_pred") != UNDETERMINED)
    return found.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])
