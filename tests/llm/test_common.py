from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonewright.llm import common


def session(master, folder=None):
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: folder or other))


def test_shared_folder():
    assert common.shared_folder(session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        common.shared_folder(session("yarn"))
    own = common.shared_folder(session("local[2]"))
    assert own == common.shared_folder(session("local[2]"))


def test_running_total(spark):
    rows = [(i % 3, i, i % 7) for i in range(500)] + [(None, 5, 2), (1, None, 3)]
    df = spark.createDataFrame(rows, "g int, i int, v long").repartition(6)
    got = common.running_total(df, [F.col("g"), F.col("i")], F.col("v")).collect()
    expected, total = [], 0
    for g, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        expected.append((g, i, v, total))
        total += v
    assert sorted(map(str, got)) == sorted(
        str(got[0].__class__(g=g, i=i, v=v, before=b)) for g, i, v, b in expected)
    assert common.running_total(df.limit(0), [F.col("g")], F.col("v")).count() == 0


def test_texts_as_bytes():
    for texts in (["a", None, "é b", ""], [None], []):
        column = pa.array(texts, pa.string())
        data, offsets = common.text_bytes(column)
        parts = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        assert parts == [t or "" for t in texts]
    data, offsets = common.text_bytes(pa.array(["xx", "yy", "zz"]).slice(1, 2))
    assert data.tobytes() == b"yyzz" and offsets.tolist() == [0, 2, 4]


def test_words_and_slices():
    texts = [b"ab  c", b"", b"d", b" e\x0bf\x1c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    start, end = common.word_bounds(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(start, end)] == [b"ab", b"c", b"d", b"e", b"f\x1c"]
    assert list(common.slices(offsets, 4)) == [(0, 1), (1, 3), (3, 4)]  # longer texts are ranges of their own
    assert list(common.slices(np.zeros(1, np.int64))) == []
