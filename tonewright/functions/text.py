"""Cleaning, tokenising and extraction as Column expressions (all JVM side, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any script (SQL ``trim`` drops spaces only)."""
    space = r"[\s\x1c-\x1f]"
    return F.regexp_replace(text, rf"(?U)^{space}++|{space}(?<!{space}{{2}}){space}*+\z", "")


def squash(text: Column) -> Column:
    """Turn every whitespace run into one space."""
    return F.regexp_replace(text, f"{P.JAVA_WS}+", " ")


def is_blank(text: Column) -> Column:
    """True for null text and for text made of whitespace only."""
    return F.coalesce(~F.rlike(text, F.lit(P.NOT_WS)), F.lit(True))


def clean_text(text: Column) -> Column:
    """Model text: lower case, single spaces, only word characters and ``. , % $ - +``."""
    return F.trim(F.regexp_replace(squash(F.lower(text)), f"{P.NOT_MODEL_TEXT}+", ""))


def clean_financial_text(text: Column) -> Column:
    """Repair mis-decoded quotes and blank out URLs and e-mail addresses."""
    plain = squash(text)
    repaired = plain
    for broken, fixed in P.MOJIBAKE:
        repaired = F.replace(repaired, F.lit(broken), F.lit(fixed))
    repaired = F.regexp_replace(repaired, P.JAVA_URL, " ")
    repaired = F.regexp_replace(repaired, P.JAVA_EMAIL, " ")
    # most texts need none of this; one test is cheaper than all the replacements
    return F.trim(
        F.when(F.rlike(plain, F.lit(P.JAVA_NEEDS_REPAIR)), repaired).otherwise(plain)
    )


def normalize_text(
    text: Column,
    lowercase: bool = True,
    remove_punctuation: bool = False,
    normalize_numbers: bool = True,
) -> Column:
    """Replace amounts by placeholders, then lower-case and squash whitespace."""
    out = squash(text)
    if normalize_numbers:
        replaced = out
        for placeholder, pattern in P.JAVA_PLACEHOLDERS:
            replaced = F.regexp_replace(replaced, pattern, placeholder)
        out = F.when(F.rlike(out, F.lit(P.D)), replaced).otherwise(out)
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.translate(out, P.PUNCTUATION, "")
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def _pieces(squashed: Column) -> Column:
    return F.array_remove(F.split(squashed, " "), "")


def tokens(text: Column) -> Column:
    """Split on whitespace; no empty tokens."""
    return _pieces(squash(text))


def lexical_words(text: Column) -> Column:
    """Lower-cased tokens without non-word characters; tokens that vanish are dropped."""
    return _pieces(F.regexp_replace(F.lower(squash(text)), r"[^\p{L}\p{N}_ ]+", ""))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def preview(text: Column, length: int = 100) -> Column:
    """First ``length`` characters, with ``...`` when something was cut off."""
    cut = F.concat(F.substring(text, 1, length), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def find_all(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Every match of ``pattern`` in order."""
    prefix = "(?i)" if ignore_case else ""
    return F.regexp_extract_all(text, F.lit(P.word_boundary_aware(prefix + pattern)), F.lit(0))


def percentages(text: Column) -> Column:
    return find_all(text, P.JAVA_PERCENT)


def currencies(text: Column) -> Column:
    return find_all(text, P.JAVA_CURRENCY, ignore_case=True)


def numbers(text: Column) -> Column:
    return find_all(text, P.NUMBER, ignore_case=True)


def companies(text: Column, ignore_case: bool = True) -> Column:
    """Company-like spans. With ``ignore_case`` (default) any 2-5 letters count, as the rules say.

    Runs of words are taken first; a run without a company suffix is then cut into letter groups.
    """
    letters = "[A-Z]{2,5}"
    suffix = ("(?i)" if ignore_case else "") + P.WS + P.COMPANY_SUFFIX
    runs = find_all(text, rf"{P.name_runs(P.COMPANY_SUFFIX + r'\.?')}|{letters}", ignore_case)
    named = F.flatten(F.transform(
        runs,
        lambda run: F.when(F.rlike(run, F.lit(suffix)), F.array(run)).otherwise(
            find_all(run, letters, ignore_case)
        ),
    ))
    # without any suffix in the text there are only letter groups
    return F.when(F.rlike(text, F.lit(suffix)), named).otherwise(
        find_all(text, letters, ignore_case)
    )


def step_companies(text: Column) -> Column:
    """Capitalised words that end in one of the few suffixes the reasoning steps know."""
    runs = P.word_boundary_aware(rf"\b(?:{P.name_runs(P.STEP_COMPANY_SUFFIX)})")
    named = F.regexp_extract_all(text, F.lit(runs), F.lit(1))
    return F.filter(named, lambda name: name != "")


def fiscal_terms(text: Column) -> Column:
    return find_all(text, P.FISCAL, ignore_case=True)


def dates(text: Column) -> Column:
    return find_all(text, P.DATE, ignore_case=True)


def sentence_count(text: Column) -> Column:
    """Runs of ``. ! ?``, at least 1."""
    return F.greatest(F.lit(1), F.size(find_all(text, P.SENTENCE_END)))


def mean_token_length(token_array: Column) -> Column:
    """Average token length; 0 without tokens."""
    total = F.length(F.array_join(token_array, ""))
    return F.coalesce(F.try_divide(total.cast("double"), F.size(token_array)), F.lit(0.0))


def term_words(text: Column) -> Column:
    """Lower-case words of two or more characters. Make it a column before pairing it: an
    expression that stands in several places is computed in each of them."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.TERM), F.lit(0))


def terms_1_2(text: Column) -> Column:
    """Lower-case words of two or more characters, followed by their neighbouring pairs."""
    return with_pairs(term_words(text))


def with_pairs(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )
    return F.concat(words, pairs)


def encode_label(label: Column) -> Column:
    """negative/neutral/positive -> 0/1/2; anything else is null."""
    out = F.lit(None).cast("int")
    for number, name in enumerate(P.LABELS):
        out = F.when(label == name, F.lit(number)).otherwise(out)
    return out


def decode_label(number: Column) -> Column:
    """0/1/2 -> negative/neutral/positive; anything else is null."""
    out = F.lit(None).cast("string")
    for position, name in enumerate(P.LABELS):
        out = F.when(number == position, F.lit(name)).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row. A column that a lambda looks at is not: the planner puts
    its expression into the lambda, and it is computed anew for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(number: Column, digits: int) -> Column:
    """Number with ``digits`` decimals, rounded half-even on its binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", number, F.lit(pattern))


def percent(number: Column, digits: int = 1) -> Column:
    """0.256 -> ``25.6%``."""
    return F.concat(fixed(number * 100, digits), F.lit("%"))


def quoted_list(array: Column) -> Column:
    """Array as ``['a', 'b']``; an item with an apostrophe gets double quotes."""
    quoted = F.transform(
        array,
        lambda w: F.when(F.contains(w, F.lit("'")), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), w, F.lit("'"))
        ),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
