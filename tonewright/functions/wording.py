"""The sentences that reports and explanations are made of.

``{name}`` marks a value filled in by :func:`fill`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPITALISED = {"negative": "Negative", "neutral": "Neutral", "positive": "Positive"}

# --- fixed values: prediction explanation -------------------------------------------------
EXPLAIN = {
    "positive": "This text expresses **positive** sentiment with {band} confidence ({conf}). "
                "The model identified key positive indicators: {words}. ",
    "positive_but": "While some cautionary terms like '{other}' are present, the overall tone "
                    "remains optimistic, suggesting favorable market perception.",
    "positive_only": "The language strongly suggests growth, improvement, or favorable financial "
                     "outcomes.",
    "positive_bare": "This text is classified as **positive** ({conf} confidence). The overall "
                     "tone and context suggest favorable sentiment.",
    "negative": "This text expresses **negative** sentiment with {band} confidence ({conf}). "
                "Key negative indicators include: {words}. ",
    "negative_but": "Despite some positive elements like '{other}', the dominant language signals "
                    "concerns, declines, or unfavorable outcomes.",
    "negative_only": "The language indicates potential risks, losses, or adverse market "
                     "conditions.",
    "negative_bare": "This text is classified as **negative** ({conf} confidence). The overall "
                     "tone suggests unfavorable sentiment or concerns.",
    "neutral": "This text expresses **neutral** sentiment with {band} confidence ({conf}). ",
    "neutral_terms": "The model recognized factual/neutral terms like '{word}'. ",
    "neutral_end": "The language is primarily informational without strong positive or negative "
                   "bias. This typically indicates routine business updates or factual reporting.",
}

# --- fixed values: market outlook in points ------------------------------------------------
OUTLOOK_HEAD = """
## {icon} Market Sentiment Outlook

### Overall Assessment: **{overall_upper}**

Based on analysis of **{total} financial texts**, the market sentiment appears **{overall}**.

### Sentiment Breakdown
| Sentiment | Count | Percentage |
|-----------|-------|------------|
| Positive  | {pos} | {pos_pct}% |
| Neutral   | {neu} | {neu_pct}% |
| Negative  | {neg} | {neg_pct}% |

### Key Insights
"""
OUTLOOK_ICONS = {
    "bullish": "📈", "bearish": "📉", "cautiously optimistic": "📊",
    "cautiously pessimistic": "⚠️", "mixed/neutral": "↔️",
}
OUTLOOK_MAJORITY = {
    "positive": "- **Strong positive sentiment** dominates the analyzed texts, suggesting market "
                "optimism.\n",
    "negative": "- **Strong negative sentiment** dominates, indicating potential market "
                "concerns.\n",
    "neutral": "- **Neutral/factual reporting** dominates, suggesting a wait-and-see market "
               "attitude.\n",
}
OUTLOOK_CONFIDENCE = {
    "high": "- **High confidence** in predictions ({conf}), indicating clear sentiment "
            "signals.\n",
    "low": "- **Lower confidence** ({conf}) suggests mixed or ambiguous language in texts.\n",
    "moderate": "- **Moderate confidence** ({conf}) in sentiment classification.\n",
}
OUTLOOK_RATIO = {
    "optimistic": "- Positive-to-negative ratio is **{ratio}:1**, indicating predominantly "
                  "optimistic coverage.\n",
    "pessimistic": "- Positive-to-negative ratio is **{ratio}:1**, indicating predominantly "
                   "pessimistic coverage.\n",
    "balanced": "- Positive-to-negative ratio is **{ratio}:1**, showing balanced sentiment "
                "distribution.\n",
}
OUTLOOK_ADVICE = {
    "bullish": "The analyzed texts suggest positive market perception. This could indicate "
               "favorable conditions for the entities mentioned, though investors should conduct "
               "additional due diligence.",
    "bearish": "The analyzed texts reveal concerns or negative developments. This warrants "
               "careful evaluation of the underlying factors driving negative sentiment.",
    "cautious": "Mixed signals in the data suggest a transitional period. Monitor for emerging "
                "trends that could shift sentiment more decisively in either direction.",
    "mixed": "Balanced or neutral sentiment suggests stability without strong directional bias. "
             "This may indicate a consolidation phase or lack of significant catalysts.",
}
OUTLOOK_ADVICE_TITLE = "\n### Interpretation\n"
OUTLOOK_NOTE = (
    "\n\n*Note: This analysis is based on ML-powered sentiment classification and should be used "
    "as one input among many in investment decision-making.*"
)

# --- fixed values: graded market outlook ------------------------------------------------------
GRADED_TRENDS = {  # trend -> (shown name, icon)
    "strongly_bullish": ("Strongly Bullish", "🚀"),
    "bullish": ("Bullish", "📈"),
    "strongly_bearish": ("Strongly Bearish", "📉"),
    "bearish": ("Bearish", "⚠️"),
    "cautiously_optimistic": ("Cautiously Optimistic", "📊"),
    "cautiously_pessimistic": ("Cautiously Pessimistic", "📉"),
    "neutral": ("Neutral/Mixed", "↔️"),
}
GRADED_HEAD = (
    "## {trend} Market Outlook\n\nBased on comprehensive analysis of **{total} financial texts**, "
    "the overall market sentiment appears **{trend_lower}**.\n\n### Key Observations\n\n"
)
GRADED_MIX = {
    "positive": "- **Strong positive sentiment** ({pos_pct}%) dominates the analyzed content\n",
    "negative": "- **Strong negative sentiment** ({neg_pct}%) dominates the analyzed content\n",
    "more_positive": "- Positive sentiment ({pos_pct}%) outweighs negative ({neg_pct}%)\n",
    "more_negative": "- Negative sentiment ({neg_pct}%) outweighs positive ({pos_pct}%)\n",
    "balanced": "- Sentiment is relatively balanced between positive ({pos_pct}%) and negative "
                "({neg_pct}%)\n",
}
GRADED_CONFIDENCE = {
    "high": "- **High confidence** ({conf}) in classifications suggests clear sentiment signals\n",
    "low": "- **Lower confidence** ({conf}) indicates some ambiguity in the analyzed texts\n",
}
GRADED_RATIO = "- Positive-to-negative ratio: **{ratio}:1**\n"
GRADED_ADVICE_TITLE = "\n### Investment Implications\n\n"
GRADED_ADVICE = {
    "bullish": "The predominantly positive sentiment suggests favorable market perception. This "
               "could indicate growth expectations, strong fundamentals, or positive catalysts. "
               "However, investors should conduct independent due diligence before making "
               "decisions.\n",
    "bearish": "The predominantly negative sentiment signals market concerns or challenges. This "
               "may reflect headwinds, disappointing results, or risk factors. Careful risk "
               "assessment is recommended before any investment actions.\n",
    "other": "Mixed or neutral sentiment suggests a transitional or uncertain period. Monitor for "
             "emerging trends that could shift sentiment decisively. This may be a period of "
             "consolidation before a clearer direction emerges.\n",
}
GRADED_NOTE = (
    "\n*Note: This analysis is AI-generated and should be used as one input among many in "
    "investment decision-making.*"
)

# --- fixed values: six-step reasoning -----------------------------------------------------------
STEPS = (
    "comprehension", "entity_extraction", "sentiment_detection", "context_analysis",
    "confidence_calibration", "final_synthesis",
)
REASON = {
    "topic_seen": "Text is {words} words, {sentences} sentence(s), discussing {topic}",
    "topic_why": "Identified this as {topic} based on domain-specific keywords. Length suggests "
                 "{length} coverage.",
    "topic_end": "Text type: {topic}; Complexity: {complexity}",
    "entity_seen": "Found {total} financial entities: {percents} percentages, {amounts} currency "
                   "amounts",
    "entity_list": "Percentages: {all}. ",
    "entity_down": "Negative percentages ({down}) suggest decline. ",
    "entity_up": "Positive percentages ({up}) suggest growth.",
    "entity_none": "No specific numerical data found; sentiment will rely on qualitative "
                   "language.",
    "entity_end": "Entity density: {density}",
    "signal_seen": "Sentiment words: +{pos} positive, -{neg} negative, ~{unc} uncertain",
    "signal_positive": "Positive words ({list}) significantly outweigh negatives",
    "signal_negative": "Negative words ({list}) significantly outweigh positives",
    "signal_slightly_positive": "Slight positive lean with words like: {list}",
    "signal_slightly_negative": "Slight negative lean with words like: {list}",
    "signal_balanced": "No strong sentiment direction; balanced or factual language",
    "signal_uncertain": ". High uncertainty ({list}) suggests forward-looking or speculative "
                        "content.",
    "signal_end": "Dominant signal: {dominant}",
    "context_seen": "Context modifiers: {negations} negations, {comparisons} comparisons, {focus}",
    "context_future": "future-focused",
    "context_present": "current/past focused",
    "context_negation": "Negations ({list}) may invert sentiment of adjacent words",
    "context_comparison": "Comparative language suggests relative performance assessment",
    "context_forward": "Forward-looking language indicates predictions/expectations",
    "context_plain": "Standard declarative context without significant modifiers",
    "context_end": "Context impact: {impact}",
    "calibrate_seen": "Reasoning confidence: {base} (no model confidence provided)",
    "calibrate_seen_model": "Reasoning confidence: {base}, Model confidence: {model}",
    "calibrate_why": "Confidence derived from: text length ({length}), sentiment clarity "
                     "({clarity}), context complexity penalty ({penalty})",
    "calibrate_high": "High confidence ({conf}) - clear sentiment signals",
    "calibrate_moderate": "Moderate confidence ({conf}) - reasonably clear signals",
    "calibrate_low": "Low confidence ({conf}) - ambiguous or mixed signals",
    "final_seen": "Synthesized from 5 reasoning steps",
    "final_why": "Sentiment detection: {label}; Context analysis: {context}",
    "final_model": "; Model prediction: {model} (agrees)",
    "final_end": "{label_upper}: Final sentiment with {conf} confidence",
    "explain": "**{label_upper}** sentiment detected with {conf} confidence.\n\n"
               "**Key Finding:** {finding}",
    "explain_context": "\n\n**Context Note:** {note}",
    "factor_positive": "Positive indicators: {list}",
    "factor_negative": "Negative indicators: {list}",
    "factor_numbers": "Contains quantitative data",
    "factor_negation": "Negation patterns detected",
    "factor_future": "Forward-looking language",
    "factor_clear": "High signal clarity",
    "factor_mixed": "Ambiguous/mixed signals",
    "summary_agree": "The text is classified as **{model_upper}** with **{conf}** confidence. "
                     "This prediction is supported by chain-of-thought analysis, which identified "
                     "{n_factors} key factors confirming this sentiment. Primary reasoning: "
                     "{reasoning}",
    "summary_differ": "The ML model predicts **{model_upper}** ({conf}), but detailed analysis "
                      "suggests **{label_upper}** ({final_conf}). This disagreement may indicate "
                      "nuanced language or context that affects interpretation. Key factors: "
                      "{factors}",
    "confidence_high": "High confidence ({conf}) indicates clear sentiment signals in the text. "
                       "The language strongly and consistently points to this sentiment "
                       "direction.",
    "confidence_moderate": "Moderate confidence ({conf}) suggests reasonably clear signals, "
                           "though some ambiguity or mixed indicators may be present.",
    "confidence_low": "Lower confidence ({conf}) indicates the text contains ambiguous, mixed, or "
                      "subtle sentiment signals. Interpretation should be made cautiously.",
}
TRACE_STEP = (
    "**Step {number}: {title}**\n  • Observation: {observation}\n  • Reasoning: {reasoning}\n"
    "  • Conclusion: {conclusion}\n"
)


def fill(template: str, **values: Column) -> Column:
    """A template as a Column, its ``{name}`` marks replaced by the given columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*[p for i, p in enumerate(parts) if i % 2 or pieces[i]])
