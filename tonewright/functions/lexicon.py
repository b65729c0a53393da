"""Word lists by category.

The starter lists are base words plus regular English inflection. They are a parameter
everywhere: load a full published dictionary with ``sources.lexicons`` and pass it instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("positive", "negative", "uncertainty", "litigious")

# verbs get -s, -ed, -ing; nouns get a plural; other words stand as they are
VERBS = {
    "positive": "achieve boost climb deliver enhance expand gain improve increase outperform "
    "recover reward soar strengthen succeed surge upgrade",
    "negative": "abandon collapse damage decline decrease delay deteriorate disappoint dismiss "
    "disrupt downgrade fail impair lack miss plunge reduce reject slump struggle suffer suspend "
    "threaten tumble violate warn weaken worsen",
    "uncertainty": "anticipate appear assume believe depend estimate expect forecast fluctuate "
    "indicate predict seem suggest vary",
    "litigious": "accuse allege appeal arbitrate defend indict litigate prosecute settle sue violate",
}
NOUNS = {
    "positive": "benefit breakthrough innovation leader opportunity profit recovery record success "
    "turnaround",
    "negative": "bankruptcy breach complaint concern crisis deficit disruption downturn failure "
    "fraud lawsuit layoff liability litigation loss penalty problem recession risk setback "
    "shortage shortfall shutdown slowdown threat weakness writedown",
    "uncertainty": "assumption contingency expectation fluctuation possibility prediction "
    "probability projection uncertainty",
    "litigious": "allegation arbitration complaint court defendant fraud injunction judge lawsuit "
    "lawyer liability litigation plaintiff prosecution settlement subpoena tribunal verdict "
    "violation",
}
WORDS = {
    "positive": "confident confidence earnings efficient excellent favorable good great grow "
    "growing grows grew growth higher optimistic outstanding positive positively profitable rise "
    "rises rising risen rose robust stable strong stronger strongest successful up upbeat win "
    "winning won",
    "negative": "adverse adversely against bad bankrupt bearish difficult down drop dropped "
    "dropping drops fall fallen falling falls fell fraudulent lose losing lost low lower negative "
    "negatively poor poorly severe severely slow slower sluggish unable uncertain "
    "uncertainty unfavorable volatile volatility weak weaker weakest worse worst worthless",
    "uncertainty": "approximately could likely may maybe might nearly pending perhaps plan "
    "planned planning plans possible possibly potential potentially probable probably should "
    "sometimes tentative uncertain unclear unexpected unknown unpredictable volatile volatility",
    "litigious": "criminal fraudulent guilty illegal judicial jury law legal legally regulatory "
    "statutory unlawful",
}


def _plural(word: str) -> str:
    if word.endswith("sis"):
        return word[:-2] + "es"
    if word.endswith(("s", "sh", "ch", "x", "z")):
        return word + "es"
    if word.endswith("y") and word[-2] not in "aeiou":
        return word[:-1] + "ies"
    return word + "s"


def _verb_forms(word: str) -> list[str]:
    if word.endswith("y") and word[-2] not in "aeiou":
        past, present = word[:-1] + "ied", word + "ing"
    elif word.endswith("e"):
        past, present = word + "d", word[:-1] + "ing"
    else:
        past, present = word + "ed", word + "ing"
    return [word, _plural(word), past, present]


def _starter(category: str) -> tuple[str, ...]:
    terms = set(WORDS[category].split())
    for noun in NOUNS[category].split():
        terms |= {noun, _plural(noun)}
    for verb in VERBS[category].split():
        terms.update(_verb_forms(verb))
    return tuple(sorted(terms))


@dataclass(frozen=True)
class Lexicon:
    """Lower-case terms by category; a term may belong to several categories."""

    positive: tuple[str, ...] = field(default_factory=lambda: _starter("positive"))
    negative: tuple[str, ...] = field(default_factory=lambda: _starter("negative"))
    uncertainty: tuple[str, ...] = field(default_factory=lambda: _starter("uncertainty"))
    litigious: tuple[str, ...] = field(default_factory=lambda: _starter("litigious"))

    @classmethod
    def from_table(cls, table: DataFrame, max_terms: int = 100_000) -> "Lexicon":
        """Build from a ``(category, term)`` table of at most ``max_terms`` rows.

        A longer table is refused here; use ``operators.lexicon.match_lexicon``, which joins.
        """
        rows = table.select("category", F.lower("term").alias("term")).distinct().limit(max_terms + 1)
        pairs = [(r.category, r.term) for r in rows.collect()]
        if len(pairs) > max_terms:
            raise ValueError(f"lexicon has more than {max_terms} terms; use match_lexicon")
        return cls(**{c: tuple(sorted(t for k, t in pairs if k == c)) for c in CATEGORIES})

    def terms(self, category: str) -> tuple[str, ...]:
        return getattr(self, category)

    def table(self, spark: SparkSession) -> DataFrame:
        """The lists as ``(category, term)`` rows."""
        rows = [(c, t) for c in CATEGORIES for t in self.terms(c)]
        columns = {"category": [c for c, _ in rows], "term": [t for _, t in rows]}
        return spark.createDataFrame(pa.table(columns))


def is_in(word: Column, terms: tuple[str, ...]) -> Column:
    """Membership test that becomes a hash-set lookup for long lists."""
    return word.isin(*terms) if terms else F.lit(False)


def only(words: Column, terms: tuple[str, ...]) -> Column:
    """Words found in ``terms``; order and repeats kept."""
    return F.filter(words, lambda w: is_in(w, terms))
