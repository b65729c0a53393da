import re

from pyspark.sql import functions as F

from tonewright.functions import patterns as P
from tonewright.functions import text as T


def one(texts, text, column):
    return texts(text).select(column(F.col("text")).alias("x")).first().x


def test_clean_text_goldens(texts):
    cases = {
        "HELLO WORLD": "hello world",
        "too   many   spaces": "too many spaces",
        "profit!!! is @great": "profit is great",
        "": "",
        "Été 5.2% up, +$3-4\u00a0now": "été 5.2% up, +$3-4 now",
    }
    got = texts(*cases).orderBy("doc_id").select(T.clean_text(F.col("text"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_normalized_goldens(texts):
    first = "Our bakery chain booked strong profit growth of 30%, well above its own plan."
    last = ("We can't say: sales hit $2.5 billion, up from $1,200,000. "
            "See www.x.com or a@b.c!")
    both = lambda c: T.normalize_text(T.clean_financial_text(c))
    assert one(texts, first, both) == (
        "our bakery chain booked strong profit growth of _percent_ , well above its own plan."
    )
    assert one(texts, last, both) == (
        "we can't say: sales hit _billion_dollars_ , up from _currency_ . see or"
    )


def test_entities(texts):
    text = ("Été naïve profit can't 25% up; Revenue rose 5 by 12,500 million, EUR 8.7 mn "
            "The Nokia Corp.")
    assert one(texts, text, T.numbers) == ["25", "5 b", "12,500 million", "8.7 m"]
    assert one(texts, text, T.companies) == [
        "na", "ve", "profi", "can", "up", "Reven", "ue", "rose", "by", "milli", "on", "EUR",
        "mn The Nokia Corp.",
    ]


def test_mojibake_and_options(texts):
    assert one(texts, "Itâ€™s â€œokâ€ â€\" x", T.clean_financial_text) == "It's \"ok\" - x"
    bare = lambda c: T.normalize_text(c, remove_punctuation=True)
    assert one(texts, "A-b, 5% c.", bare) == "ab percent c"


def python_pattern(pattern):
    plain = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u%04x" % int(m.group(1), 16), pattern)
    return plain.replace(r"\p{Nd}", r"\d")


def test_linear_patterns_match_the_plain_ones(texts):
    import random

    random.seed(11)
    parts = ("Acme Holdings Inc Inc. co Company incident a I the Beta LLC Corp x1 12 5.5% -3% "
             "7.7.7% $5bn 12.5m naïve AB ABCDEFGH Group, systems a@b.c @x b@ foo@@bar Ltd.y "
             "Services2 $5.55x USD EUR5").split() + ["\n", "\u00a0", "$3 M", "5 bn"]
    rows = ["".join(random.choice(parts) + random.choice([" ", " ", "  ", "", ".", ", "])
                    for _ in range(random.randint(0, 14))) for _ in range(1500)]
    c = F.col("text")
    got = texts(*rows).select(
        "text", T.companies(c).alias("any_case"), T.companies(c, False).alias("strict"),
        T.step_companies(c).alias("steps"), T.percentages(c).alias("percents"),
        T.currencies(c).alias("currencies"), T.strip(c).alias("stripped"),
        T.is_blank(c).alias("blank"), T.tokens(c).alias("tokens"),
        T.lexical_words(c).alias("words"),
    ).collect()
    for row in got:
        t = row.text
        assert row.any_case == re.findall(python_pattern(P.COMPANY), t, re.I), t
        assert row.strict == re.findall(python_pattern(P.COMPANY), t), t
        assert row.steps == re.findall(python_pattern(P.STEP_COMPANY), t), t
        assert row.percents == re.findall(python_pattern(P.PERCENT), t), t
        assert row.currencies == re.findall(python_pattern(P.CURRENCY), t, re.I), t
        assert row.stripped == t.strip() and row.blank == (not t.strip())
        assert row.tokens == t.split()
        words = [re.sub(r"[^\w]", "", w.lower()) for w in t.split()]
        assert row.words == [w for w in words if w]


def test_long_texts_do_not_exhaust_the_regex_engine(texts):
    c = F.col("text")
    got = texts("word " * 50_000, "Word " * 50_000 + "Inc", "a" * 200_000, "1" * 200_000).select(
        F.size(T.companies(c)), F.size(T.step_companies(c)), F.size(T.percentages(c)),
        F.length(T.normalize_text(T.clean_financial_text(c))),
    ).collect()
    assert [tuple(r) for r in got] == [
        (50_000, 0, 0, 249_999), (1, 1, 0, 250_003), (40_000, 0, 0, 200_000), (0, 0, 0, 200_000),
    ]


def test_fixed_rounds_like_the_binary_value(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.5, 0.999, 1234.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(
        T.fixed(F.col("x"), 2), T.percent(F.col("x"))
    ).collect()
    assert [r[0] for r in got] == [f"{v:.2f}" for v in values]
    assert [r[1] for r in got] == [f"{v:.1%}" for v in values]


def test_terms(texts):
    assert one(texts, "A big, Big dog", T.terms_1_2) == ["big", "big", "dog", "big big", "big dog"]
    assert one(texts, "x", T.terms_1_2) == []
