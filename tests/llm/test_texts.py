import base64
import gzip
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm import brute
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonewright.llm import chat, language, mixing, packing, quality, queries, sharding, warc
from tonewright.sources.tables import table


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


# packing

def check_pieces(pieces, texts, length):
    """Every id lies in one piece, sequences are gapless, and all but powers of two are full."""
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        done = 0
        for p in sorted(by.pop(doc), key=lambda p: p["start"]):
            part = ids[p["start"]: p["start"] + p["length"]]
            assert p["start"] == done and p["doc_tokens"] == len(ids) and p["ids_crc32"] == brute.crc(part.tobytes())
            done += p["length"]
        assert done == len(ids)
    assert not by
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        sizes.append(at)
    assert all(s == length or s & (s - 1) == 0 and s < length for s in sizes)
    assert set(sequences) == set(range(len(sequences)))


def test_query_packing(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    check_pieces(queries.op1_curve_packing(spark, SF).collect(), texts, 2048)


def test_packing_of_odd_texts(spark):
    texts = {1: None, 2: "", 3: "A\tb c  d e\n\nf <|endoftext|> don't it's 12,3. ,. ΣΑΣ. é é",
             4: "word " * 3000, 5: "x" * 5000, 6: "THE the The, the.", 7: "a.b,c. 5. ²,", 8: "ßß. Ǆ, ﬁ."}
    rows = [(k, t, "c") for k, t in texts.items()]
    docs = frame(spark, rows, "doc_id long, text string, ids string")
    check_pieces(queries.piece_digests(packing.pack(docs, queries.TOKENIZER, length=64)).collect(), texts, 64)


def test_words_are_the_same_in_any_generation(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 5)
    words = packing.WordIds(queries.TOKENIZER)
    texts = ["one two, three. four", "five six seven eight one,", "nine, one two ten", "two. one nine three,"] * 3
    expected = [words.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for text, ids in zip(texts, expected):
        assert np.frombuffer(words.encode([text], 1)[0], words.kind).tolist() == ids


def test_packing_of_repeated_rows_and_of_nothing(spark):
    rows = [(1, "one two"), (None, "three"), (None, "three")] * 3
    pieces = packing.pack(frame(spark, rows), queries.TOKENIZER, length=8).collect()
    assert sum(p["length"] for p in pieces) == sum({1: 3, None: 2}[r[0]] for r in rows)
    spots = [(p["sequence_id"], p["offset"] + i) for p in pieces for i in range(p["length"])]
    assert len(set(spots)) == len(spots)
    assert packing.pack(frame(spark, []), queries.TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), queries.TOKENIZER, length=100)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert_key(points, bits)
    assert sorted(keys) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


# quality

def texts_of_all_kinds():
    rng = random.Random(5)
    line = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 8))) for _ in range(30))
    return [None, "", "\n \t", line, f"{line}\n{line}\n{line}", line.upper(), line.replace(" ", "!! "),
            line.replace(" ", "### "), "1 2 3 " * 20, "a " * 50, f"{line}\n\n\n\n" * 2 + line[::-1], "ab\x1ccd " * 30,
            (line + " ") * 200, "x" * 100_000, line + " | <b> & * $ %"]


def test_quality_counts_match_a_plain_version(spark):
    texts = texts_of_all_kinds()
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    docs = frame(spark, rows + rows[:3], "doc_id long, text string, kept long")
    for r in quality.cascade(docs, report=queries.COUNTS).collect():
        expected = brute.quality(texts[r["doc_id"]])
        for name in (*queries.COUNTS, "base_failed"):
            assert r[name] == expected[name], (r["doc_id"], name)
        assert r["kept"] == (r["rejected_by"] is None) and not (r["base_failed"] and r["kept"])


def test_cascade_keeps_the_same_in_any_order(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").withColumn("text", F.expr(
        "if(doc_id % 7 = 0, upper(text), if(doc_id % 5 = 0, replace(text, ' ', '### '), text))"))
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    data = [(t or "").encode() for t in texts]
    whole = quality.Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    rejected = np.zeros(len(data), bool)
    for rule in (*quality.BASE, *quality.RULES):
        rejected |= rule.rejects(whole)
    got = quality.cascade(docs).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [not x for x in rejected]
    assert 0 < rejected.sum() < len(data)


def test_stutters_stop_at_the_end_of_a_text():
    data = [b"a a b", b"b b b", b"", b"b"]
    texts = quality.Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert texts["stutters"].tolist() == [1, 2, 0, 0]


def test_rules_that_reject_more_for_less_come_first(spark):
    docs = frame(spark, [(i, "word " * 30) for i in range(50)])

    def slow(t):
        import time
        time.sleep(0.05)
        return np.zeros(len(t), bool)

    rules = [quality.Rule("slow", slow), quality.Rule("all", lambda t: np.ones(len(t), bool))]
    assert [r.name for r in quality.order_rules(docs, "text", "doc_id", rules)] == ["all", "slow"]


def test_rules_are_ordered_by_what_they_add():
    """Alone, ``b`` rejects more than ``c`` for its cost, but all of that is what ``a`` rejects."""
    a, b, c, d = (quality.Rule(n, None) for n in "abcd")
    seen = quality.Seen(
        {"a": 0.1, "b": 0.1, "c": 0.1, "d": 0.01}, {"a": {"x": 0.1}, "b": {}, "c": {}, "d": {"x": 0.1, "_w": 0.05}},
        {0b0011: 80, 0b0001: 60, 0b0100: 20, 0b1000: 2, 0: 50})
    alone = sorted("abc", key=lambda n: -{"a": 140 / 0.2, "b": 80 / 0.1, "c": 20 / 0.1}[n])
    assert alone == ["b", "a", "c"]
    assert [r.name for r in quality.greedy_order((a, b, c, d), seen)] == ["b", "a", "c", "d"]
    seen.own["b"] = 0.2
    assert [r.name for r in quality.greedy_order((a, b, c, d), seen)] == ["a", "c", "d", "b"]


def test_estimate_is_of_what_the_cascade_meets(spark):
    long, short = "good plain words for a text " * 4, "#### " * 5
    docs = frame(spark, [(None, f"{long} number {i} " + "# " * (i % 2) * 9) for i in range(60)] + [(None, short)] * 40)
    rules = [quality.Rule("symbols", quality.many_symbols), quality.Rule("capitals", quality.mostly_capitals)]
    seen = quality.estimate(docs, "text", rules, [quality.BASE[0]], ["n_symbols"])
    assert sum(seen.rejected.values()) == 60 and seen.rejected[1] == 30  # short texts are out before
    assert set(seen.needs["symbols"]) == set() and set(seen.needs["capitals"]) == {"upper", "letters"}
    cold = quality.estimate(docs, "text", rules)
    assert sum(cold.rejected.values()) == 100 and set(cold.needs["symbols"]) == {"n_symbols", "n_words", "_words"}
    assert [r.name for r in quality.order_rules(docs.limit(0), "text", "doc_id", rules)] == ["symbols", "capitals"]


def test_quality_of_nothing_and_query(spark):
    assert quality.cascade(frame(spark, [])).count() == 0
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = queries.op4_quality_cascade(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        expected = brute.quality(texts[r["doc_id"]])
        assert all(r[n] == expected[n] for n in (*queries.COUNTS, "base_failed"))


# language

def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    truth = {r["doc_id"]: r for r in docs.collect()}
    got = queries.op5_language(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark):
    kind = "doc_id long, text string, lang string, score long"
    rows = [(i, "the and of " * 5 if i % 2 else "der und die " * 5, "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "", "en", 1), (102, "12 34 ...", None, 1), (103, "ж", None, 1),
             (104, "the and " * 20000, None, 1), (None, "the and", None, 1)]
    docs = frame(spark, rows, kind)
    model = language.fit_language_model(docs.where(~language.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert {got[i]["lang_pred"] for i in (100, 101, 102)} == {"und"} and got[100]["score"] == 0
    assert got[103]["lang_pred"] in ("de", "en") and got[104]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got) - {100, 101, 102}
    # nothing to learn from
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(blank, language.fit_language_model(blank)).collect()} == {"und"}
    assert language.keep_identified(frame(spark, [], kind)).count() == 0
    one = docs.where("lang = 'en'")
    assert {r["lang_pred"] for r in language.identify(one, language.fit_language_model(one)).collect()} == {"en", "und"}


def test_sample_is_bounded_for_any_keys(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(None, "".join(rng.choice("abcdef ") for _ in range(40)), "en") for _ in range(3000)]
    rows += [(7, "der die das und nicht", "de")] * 3000
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "fit_rows", seen.extend)
    language.fit_language_model(docs, per_language=50)
    names = [name for name, _, _ in seen]
    assert names.count("en") == 50 and names.count("de") == 1


def test_families_come_first():
    rng = np.random.default_rng(1)
    spot = {"en": 0, "de": 100, "fr": 200, "xx": 300}
    rows = [(lang, np.arange(b, b + 20), rng.integers(1, 9, 20).astype(float)) for lang, b in spot.items() for _ in range(9)]
    model = language.fit_rows(rows)
    assert model.families == {"germanic": ["de", "en"], "romance": ["fr"], "xx": ["xx"]}
    assert len(model.between) == 3 and [(d.first, d.second) for d in model.within["germanic"]] == [("de", "en")]


# archives

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 300_000
    rows = [(3, "http://a/\r\nX: y", "p" * 100, "-"), (1, "u1", "p" * 100, "-"), (2, None, "p" * 100, "-"),
            (4, "u", "p" * 99, "-"), (5, "u", "p" * 99, "-"), (6, "u", None, "-"), (7, "u", "", "-"),
            (8, "ü", big, "-"), (9, "u", big, "-"), (1, "again", "p" * 100, "-"), (None, "u", "p" * 100, "-"),
            (10, "u", "WARC/1.1\r\n\r\n" * 20, "-")]
    marked = warc.mark_revisits(pages(spark, rows))
    files = warc.write_archives(marked, f"file://{tmp_path}/x", roll_bytes=2000)
    got = warc.read_archives(files).collect()
    assert files.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    first = {"p" * 100: 1, big: 8}
    expected = sorted((
        str(k), len(b := (h or "").encode()), brute.sha(b),
        "revisit" if len(b) >= 100 and first.get(h, k) != k else "response",
        str(first[h] if len(b) >= 100 and first.get(h, k) != k else None),
    ) for k, _, h, _ in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]))
                  for r in got) == expected
    body = {r["page_id"]: r["payload"] for r in got}
    assert bytes(body[8]) == big.encode() and body[9] is None and body[6] == b""
    # each record is one member, and other tools can read the file
    path = files.first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    assert gzip.decompress(raw).count(b"WARC-Record-ID") == len(list(warc.members(io.BytesIO(raw), 7)))


def test_archives_of_nothing(spark, tmp_path):
    files = warc.write_archives(warc.mark_revisits(pages(spark, [])), f"file://{tmp_path}/y")
    assert files.count() == 0 and warc.read_archives(files).count() == 0


def test_damaged_archives_are_refused():
    good = warc.page_record(1, "u", b"x" * 200, brute.sha(b"x" * 200), None)
    assert warc.parse_page(warc.parse_record(next(warc.members(io.BytesIO(good)))))[2] == b"x" * 200
    with pytest.raises(warc.Damaged):
        list(warc.members(io.BytesIO(good[:-9])))
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"xxx", b"yyy"), plain + b"z", plain.replace(b"Content-Length: 2", b"Content-Length: 3"),
                b"nothing", plain.replace(b"WARC/", b"WORC/")):
        with pytest.raises(warc.Damaged):
            warc.parse_record(bad)
    with pytest.raises(warc.Damaged):
        warc.parse_page(warc.parse_record(gzip.decompress(warc.page_record(1, "u", b"x", "0" * 64, None))))


def foreign_record(kind, block, content_type="application/http; msgtype=response", **headers):
    """A record as other writers make them."""
    named = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:00000000-0000-4000-8000-000000000001>",
             "WARC-Date": "2020-02-02T00:00:00Z", "WARC-Target-URI": "http://a.example/", "Content-Type": content_type}
    named.update({k.replace("_", "-"): v for k, v in headers.items()})
    return warc.warc_record(list(named.items()), block)


def test_archives_of_other_writers(spark, tmp_path):
    def sha1(data):
        return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()

    body, ok = b"<p>hello</p>", b"HTTP/1.1 200 OK\r\n"
    chunked = ok + b"Transfer-Encoding: chunked\r\n\r\n5;x=1\r\n<p>he\r\n7\r\nllo</p>\r\n0\r\n\r\n"
    joined = ok + b"Transfer-Encoding: chunked\r\n\r\n" + body
    noise = bytes(np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8))
    parts = [
        foreign_record("warcinfo", b"software: x\r\n", "application/warc-fields"),
        foreign_record("response", ok + b"X: a\r\n b\r\n\r\n" + body, WARC_Payload_Digest=sha1(body)),
        foreign_record("response", chunked, WARC_Payload_Digest=sha1(body), WARC_Block_Digest=sha1(chunked)),
        foreign_record("response", chunked, WARC_Payload_Digest=sha1(chunked.partition(b"\r\n\r\n")[2])),
        foreign_record("response", joined),
        foreign_record("response", ok + b"\r\n" + body, WARC_Payload_Digest="blake9:xyz"),
        foreign_record("response", ok + b"\r\n" + body, WARC_Payload_Digest="md5:" + hashlib.md5(body).hexdigest().upper()),
        foreign_record("response", ok + b"\r\n" + body, WARC_Payload_Digest=sha1(b"other")),
        foreign_record("response", ok + b"Content-Length: 99\r\n\r\n" + body),
        foreign_record("response", ok + b"Content-Length: 99\r\n\r\n" + body, WARC_Truncated="length"),
        foreign_record("request", b"GET / HTTP/1.1\nHost: a\n\n", "application/http; msgtype=request"),
        foreign_record("resource", noise, "image/png", WARC_Block_Digest="sha-256:" + brute.sha(noise)),
        foreign_record("revisit", ok + b"\r\n", WARC_Refers_To="<urn:uuid:1>"),
        foreign_record("resource", noise, "image/png"),  # damaged below
        foreign_record("response", b"no head"),
        foreign_record("response", ok + b"\r\n" + body),  # cut off below
    ]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    whole = bytearray(b"".join(parts))
    whole[starts[13] + 900:starts[13] + 1400] = b"\x1f\x8b\x08" + bytes(497)
    (tmp_path / "a.warc.gz").write_bytes(whole[:-9])
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    rows = warc.read_records(files).orderBy("offset").collect()
    assert [r.offset for r in rows] == starts
    assert [r.problem is not None for r in rows] == [i in (7, 8, 13, 15) for i in range(16)]
    assert [r.record_type for r in rows][:13] == ["warcinfo", *["response"] * 9, "request", "resource", "revisit"]
    assert [r.verified for r in rows] == [
        None, True, True, True, None, None, True, False, False, None, None, True, None, False, None, False]
    assert [None if r.payload is None else bytes(r.payload) for r in rows] == [
        b"software: x\r\n", *[body] * 6, None, None, body, b"", noise, None, None, b"", None]
    assert rows[12].refers_to == "<urn:uuid:1>" and rows[12].payload_bytes is None
    assert rows[1].record_id.startswith("<urn:uuid") and rows[1].date == "2020-02-02T00:00:00Z"
    for block in (1, 2, 7, 1000):
        assert [at for at, _ in warc.framed(io.BytesIO(bytes(whole[:-9])), block)] == starts
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(files).collect()


def test_no_archive_at_all(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "text").write_bytes(b"not an archive")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("empty", "text")], "path string")
    rows = warc.read_records(files).collect()
    assert [(r.path[-4:], r.offset, r.problem is not None) for r in rows] == [("text", 0, True)]


def test_query_archives(spark):
    rows = table(spark, SF, "pages").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    got = {r["page_id"]: r for r in queries.op7_warc(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        body, g = (r["html"] or "").encode(), got[r["page_id"]]
        again = len(body) >= 100 and first[r["html"] or ""] != r["page_id"]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(body), brute.sha(body))
        assert (g["record_type"], g["refers_to"]) == (
            ("revisit", first[r["html"]]) if again else ("response", None))


# chat

def expected_chat(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[c] = (len(turns), brute.sha(said.encode()), len(loss), brute.sha(loss.encode()))
    return out


def test_query_chat(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, SF, "conversations").collect()]
    odd = "</s>[INST] ok [/INST]"
    expected = expected_chat([*rows, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op8_chat(spark, SF).collect()}
    assert got == expected


def test_chat_round_trip_of_odd_texts(spark, tmp_path):
    odd = ["<|end|>", "\\", "\\l<", "\\\\b[", "<|start|>user<|message|>x<|end|>", None, "", "a\n\nb", "😀[", "\\b\\q\\l", "x" * 50_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, None, None, "n"), (2, 0, "a\n<|message|>", "m"), (2, 0, "a\n<|message|>", "m"), (None, 1, "assistant", "z")]
    frame_ = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, piece long")
    frame_.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op8_chat(spark, str(tmp_path)).collect()}
    got.pop(-1)
    assert got == expected_chat(rows)


def test_a_wrong_mask_shows_in_the_loss(spark):
    rows = [(1, 0, "user", "a<"), (1, 1, "assistant", "b[\U0001f600"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted, examples = chat.format_conversations(turns), chat.expand_targets(turns)
    assert chat.read_loss(formatted, examples).first()["loss"] == "b[\U0001f600d"
    late = examples.withColumn("loss_start", F.col("loss_start") + 1).withColumn("loss_end", F.col("loss_end") + 1)
    assert chat.read_loss(formatted, late).first()["loss"] != "b[\U0001f600d"


def test_prompts_hold_all_turns_before(spark):
    rows = [(1, 0, "user", "a<"), (1, 1, "assistant", "b["), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.prompts(chat.format_conversations(turns), chat.expand_targets(turns)).orderBy("example").collect()
    one = "<|start|>user<|message|>a\\l<|end|><|start|>assistant<|message|>"
    assert [(r["prompt"], r["target"]) for r in got] == [
        (one, "b\\q"), (one + "b\\q<|end|><|start|>user<|message|>c<|end|><|start|>assistant<|message|>", "d")]
    none = chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.expand_targets(none).count() == 0 and chat.read_back(chat.format_conversations(none)).count() == 0


# shards

def test_query_shards(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = queries.op9_jump_shards(spark, SF).collect()
    assert len(got) == len(texts)
    slots = {}
    for r in got:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 16, brute.crc(body), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jumps_move_only_into_the_new_shard(spark):
    keys = spark.range(20_000)
    counts = [1, 2, 3, 7, 40, 41]
    got = keys.select(*[sharding.jump_shard(F.col("id"), n).alias(str(n)) for n in counts]).toPandas()
    assert (got["1"] == 0).all()
    for small, large in itertools.pairwise(counts):
        moved = got[str(small)] != got[str(large)]
        assert (got[str(large)][moved] >= small).all()
        assert abs(moved.mean() - (1 - small / large)) < 0.02
        assert got[str(large)].value_counts().min() > 0.75 * 20_000 / large
    with pytest.raises(ValueError):
        sharding.jump_shard(F.col("id"), 0)


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(None, None, 1), (None, "a", 1), (5, "a", 1), (5, "a", 1), (5, "", 1), (6, "é" * 10_000, 1)]
    docs = frame(spark, rows, "doc_id long, text string, shard long")
    got = sharding.assign_shards(docs, 3).collect()
    assert len(got) == 6 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign_shards(frame(spark, []), 3).count() == 0
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 6


# mixing

def test_period_keeps_every_source_within_a_block():
    rng = random.Random(4)
    for _ in range(30):
        weights = {f"s{i}": rng.random() ** 3 + 0.001 for i in range(rng.randint(1, 30))}
        slots = mixing.slots_of_weights(weights, 500)
        assert sum(slots.values()) == 500 and all(n >= 1 for n in slots.values())
        done = dict.fromkeys(slots, 0)
        for source, block, slot in mixing.one_period(slots):
            assert block == done[source]
            done[source] += 1
            assert all(abs(done[s] - (slot + 1) * n / 500) < 1 for s, n in slots.items())
    with pytest.raises(ValueError):
        mixing.slots_of_weights({"a": 0.0})
    with pytest.raises(ValueError):
        mixing.slots_of_weights({str(i): 1.0 for i in range(5)}, 4)


def test_mixture_holds_weights_and_uses_every_row(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 400), "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "y" * 30_000, "b"), (1, rows[1][1], rows[1][2])]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    weights = {"hot": 1, "a": 2, "b": 1, None: 0.5}
    plan = mixing.mix_schedule(docs, weights, block_bytes=2000, period=64).collect()
    assert {r["doc_id"] for r in plan} == {r[0] for r in rows}
    slots = mixing.slots_of_weights(weights, 64)
    uses, at = {}, {}
    for r in plan:
        at.setdefault(r["slot"], set()).add(r["source"])
        uses.setdefault((r["source"], r["block"], r["epoch"]), set()).add(r["slot"])
    assert all(len(s) == 1 for s in at.values()) and all(len(s) == 1 for s in uses.values())
    done = dict.fromkeys(slots, 0)
    for slot in range(max(at) + 1):  # a slot without rows holds the middle of a long text
        if slot in at:
            done[next(iter(at[slot]))] += 1
        else:
            done["b"] += 1
        assert all(abs(done[s] - (slot + 1) * n / 64) < 1 + 1e-9 for s, n in slots.items())
    mixed = mixing.mix_documents(docs, weights, block_bytes=2000, period=64)
    assert mixed.columns == docs.columns and mixed.count() == len(plan)


def test_segments_keep_asked_weights_to_the_end():
    rng = random.Random(6)
    for trial in range(40):
        weights = [rng.random() ** rng.choice([1, 5]) + 1e-5 for _ in range(rng.randint(1, 20))]
        if trial % 4 == 0:
            weights = [rng.choice([1, 2, 0.5]) for _ in weights]
        shares = mixing.whole_shares(weights)
        total, size, state, done = sum(shares), rng.choice([7, 64, 200]), [0] * len(shares), [0] * len(shares)
        for first in range(0, 6 * size, size):
            until = mixing.advance(shares, state, first, first + size)
            for source, block, slot in mixing.place(shares, state, until, first):
                assert block == done[source]
                done[source] += 1
                assert all(abs(n * total - s * (slot + 1)) < total for n, s in zip(done, shares))
            assert done == until
            state = until


def test_long_mixture_holds_asked_weights(spark):
    weights = {"a": 1, "b": 20000.5, "c": 7000.25}
    rows = [(0, "x" * 99, "a"), *((i, "x" * 99, "b" if i % 4 else "c") for i in range(1, 12_001))]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    plan = mixing.mix_schedule(docs, weights, block_bytes=100).collect()
    source = np.array([r["source"] for r in sorted(plan, key=lambda r: r["slot"])])
    assert sorted(r["slot"] for r in plan) == list(range(len(plan))) and len(plan) > 3 * 4096
    assert {r["doc_id"] for r in plan} == set(range(12_001))
    slots = np.arange(1, len(plan) + 1)
    for name, weight in weights.items():
        due = slots * weight / sum(weights.values())
        assert np.abs(np.cumsum(source == name) - due).max() < 1 + 1e-6
    assert sum(source == "a") == 1


def test_mixture_of_many_sources(spark):
    rows = [(i, "x", f"s{i}") for i in range(5000)]
    plan = mixing.mix_schedule(frame(spark, rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["slot"] for r in plan) == list(range(5000)) and len({r["doc_id"] for r in plan}) == 5000


def test_mixture_of_nothing_and_query(spark):
    empty = frame(spark, [], "doc_id long, text string, source string")
    assert mixing.mix_schedule(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_schedule(frame(spark, [(1, "a", "s")], "doc_id long, text string, source string"), {"t": 1})
    docs = {r["doc_id"] for r in table(spark, SF, "documents").select("doc_id").collect()}
    got = queries.op10_mixing(spark, SF).collect()
    assert {r["doc_id"] for r in got} == docs
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
