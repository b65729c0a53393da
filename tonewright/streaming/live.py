"""Row-local operators on a stream of texts: no state, no shuffle, so append mode needs no
watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexicon import Lexicon
from ..operators import features, reasoning


def analyze_stream(texts: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """The nested analysis record and the reasoning columns for every arriving text."""
    return reasoning.reason(features.analyze(texts, text, lexicon), text, lexicon)


def write_stream(analyzed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the available input is used up; run again for what came later."""
    return (
        analyzed.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start(path)
    )
