"""SQL expression builders for DuckDB, written from the rules and not from the Spark code.

Fixed values (patterns, word lists, wording) are shared; everything computed is spelled out here.
"""

from __future__ import annotations

import re

from tonewright.functions import patterns as P
from tonewright.functions.lexicon import Lexicon

LEX = Lexicon()


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{P.WS}+|{P.WS}+$", "")


def squash(x: str) -> str:
    return sub(x, f"{P.WS}+", " ")


def clean_text(x: str) -> str:
    return strip(sub(squash(f"lower({x})"), P.NOT_MODEL_TEXT, ""))


def clean_financial(x: str) -> str:
    out = squash(x)
    for bad, good in P.MOJIBAKE:
        out = f"replace({out}, {q(bad)}, {q(good)})"
    return strip(sub(sub(out, P.URL, " "), P.EMAIL, " "))


def normalize(x: str, lower=True, punctuation=False, numbers=True) -> str:
    if numbers:
        for placeholder, pattern in P.PLACEHOLDERS:
            x = sub(x, pattern, placeholder)
    if lower:
        x = f"lower({x})"
    if punctuation:
        x = f"translate({x}, {q(P.PUNCTUATION)}, '')"
    return strip(squash(x))


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(P.WS + '+')}), lambda t: t <> '')"


def words(token_list: str) -> str:
    bare = f"list_transform({token_list}, lambda t: {sub('lower(t)', P.NOT_WORD, '')})"
    return f"list_filter({bare}, lambda w: w <> '')"


def matches(x: str, pattern: str, ignore_case=False) -> str:
    return f"regexp_extract_all({x}, {q(('(?i)' if ignore_case else '') + pattern)})"


def only(word_list: str, terms) -> str:
    if not terms:
        return f"list_filter({word_list}, lambda w: false)"
    return f"list_filter({word_list}, lambda w: w in {sql_list(terms)})"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def size(x: str) -> str:
    return f"len({x})::int"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0e0)"


def preview(x: str, n: int) -> str:
    return f"case when length({x}) > {n} then substr({x}, 1, {n}) || '...' else {x} end"


def encode(x: str) -> str:
    return f"case {x} when 'negative' then 0 when 'neutral' then 1 when 'positive' then 2 end"


def decode(x: str) -> str:
    return f"case {x} when 0 then 'negative' when 1 then 'neutral' when 2 then 'positive' end"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', ({x})::double)"


def percent(x: str) -> str:
    return f"(printf('%.1f', ({x}) * 100e0) || '%')"


def quoted_list(x: str) -> str:
    item = "case when contains(w, '''') then '\"' || w || '\"' else '''' || w || '''' end"
    return f"('[' || coalesce(array_to_string(list_transform({x}, lambda w: {item}), ', '), '') || ']')"


def fill(template: str, **values: str) -> str:
    """The template as a concatenation, ``{name}`` marks replaced by SQL expressions."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = []
    for i, piece in enumerate(pieces):
        if i % 2:
            parts.append(f"({values[piece]})::varchar")
        elif piece:
            parts.append(q(piece))
    return "(" + " || ".join(parts) + ")"


def pick(x: str, table: dict[str, str], default: str = "null") -> str:
    """``case x when key then value``; values are SQL."""
    return f"case {x} " + " ".join(f"when {q(k)} then {v}" for k, v in table.items()) + f" else {default} end"


def present(x: str, words_) -> str:
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in words_) + ")"


def found(x: str, words_) -> str:
    return "list_filter([" + ", ".join(q(w) for w in words_) + f"], lambda k: contains({x}, k))"


def single_terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(P.TERM)})"


def with_pairs(t: str) -> str:
    """A list of words followed by its neighbouring pairs; ``t`` should be a plain column."""
    return (
        f"list_concat({t}, list_transform(list_zip({t}[:len({t}) - 1], {t}[2:]), "
        f"lambda z: z[1] || ' ' || z[2]))"
    )


def softmax(items: list[str]) -> list[str]:
    top = f"greatest({', '.join(items)})"
    exps = [f"exp(({x}) - {top})" for x in items]
    total = " + ".join(exps)
    return [f"({e} / ({total}))" for e in exps]


def argmax(items: list[str]) -> str:
    top = f"greatest({', '.join(items)})"
    cases = " ".join(f"when {x} = {top} then {i}" for i, x in enumerate(items))
    return f"(case {cases} end)"
