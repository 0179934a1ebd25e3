import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probity.llm import encode as en
from probity.llm import mixing as mx
from probity.llm import truncated as tr
from tests.conftest import DATA

TEXTS = ["", " ", "a", "Hello world, it's fine!", "  two  spaces \n\n\t end ", "<|endoftext|> is text", "naïve café — “quoted”…", "हिन्दी पाठ", "漢字仮名交じり文", "emoji 👩‍🔧🇳🇱 x", "​﻿zero", "a" * 3000, "ab" * 2500 + "!", " " * 500, "1234567890" * 30, "camelCaseName{0}%s", "\r\n\r\n"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(en.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def voc():
    return en.vocabulary(en.VOCABULARY)


def test_encoding_equals_the_library(voc, library):
    assert [voc.encode(t) for t in TEXTS] == library(TEXTS)
    assert voc.encode(None) == []


def test_encoding_of_random_texts(voc, library):
    rng = random.Random(2)
    parts = ["the", "ing", " ", "  ", "\n", "é", "ü", "漢", "🙂", "'ll", "'S", "9", "00", "_", "-", "<|", "|>", "zq", "Ω", "ß", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    assert [voc.encode(t) for t in texts] == library(texts)


def test_ids_decode_to_the_text(voc):
    for t in TEXTS:
        assert b"".join(voc.bytes[i] for i in voc.encode(t)).decode() == t


def test_append_and_edit(voc):
    rng = random.Random(3)
    for _ in range(100):
        s = "".join(rng.choice("abcdefgh th er in") for _ in range(rng.randrange(1, 80))).encode()
        k = rng.randrange(len(s) + 1)
        whole = en.Prefixes(voc).extend(s).tokens()
        assert en.Prefixes(voc).extend(s[:k]).extend(s[k:]).tokens() == whole
        assert en.Prefixes(voc).extend(s[:k] + b"xyz").cut(k).extend(s[k:]).tokens() == whole


def test_ids_in_spark(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, None)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["i"] for r in df.select("doc_id", en.token_ids("text").alias("i")).collect()}
    assert got.pop(99) == [] and [got[i] for i in range(len(TEXTS))] == library(TEXTS)
    n = {r["doc_id"]: r["n"] for r in df.select("doc_id", en.token_count("text").alias("n")).collect()}
    assert all(n[i] == len(got[i]) for i in got) and n[99] == 0


def test_whole_corpus(spark, library):
    from probity.functions.session import table
    from probity.llm import queries as q
    got = {r["doc_id"]: r["ids"] for r in q.queries()["p6_ids"](spark, str(DATA)).collect()}
    docs = table(spark, str(DATA), "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    assert [got[r["doc_id"]] for r in docs] == library([r["text"] or "" for r in docs])


def test_fertility_counts_the_library_s_tokens(spark, library):
    from probity.functions.session import table
    from probity.llm import queries as q
    got = {r["lang"]: (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in q.queries()["p6_fertility"](spark, str(DATA)).collect()}
    want = {}
    docs = table(spark, str(DATA), "documents").select("lang", "text").collect()
    for r, ids in zip(docs, library([r["text"] or "" for r in docs])):
        n = want.get(r["lang"], (0, 0, 0))
        want[r["lang"]] = (n[0] + 1, n[1] + len(ids), n[2] + len(r["text"] or ""))
    assert got == want


# mixing

def test_frame_deviates_less_than_a_block():
    for w in ({"a": 3, "b": 3, "c": 1}, {"a": 5000, "b": 4999, "c": 1}, {"a": 1}, {f"s{i}": i + 1 for i in range(30)}):
        period, done = sum(w.values()), dict.fromkeys(w, 0)
        slots = sorted(mx.frame(w), key=lambda x: x[2])
        assert [s for _, _, s in slots] == list(range(period))
        for s, j, slot in slots:
            assert j == done[s]
            done[s] += 1
            for name in w:
                assert abs(done[name] - (slot + 1) * w[name] / period) < 1
        assert done == w


TARGETS = "source string, target_share double, max_repeat int"


def test_mix_reaches_shares_within_caps(spark):
    rng = random.Random(1)
    docs = [(i, "big", rng.randrange(1, 60)) for i in range(3000)] + [(10_000 + i, "mid", rng.randrange(1, 60)) for i in range(500)] + [(20_000 + i, "small", rng.randrange(1, 60)) for i in range(100)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.6, 1), ("Mid ", 0.25, 3), ("small", 0.1, 4), ("absent", 0.05, 9), (None, 0.3, 2)], TARGETS)
    rows = mx.mix(sizes, targets, block=64, per_bucket=200).collect()
    tokens, copies = {}, {}
    for r in rows:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["tokens"]
        copies[r["source"], r["doc_id"]] = copies.get((r["source"], r["doc_id"]), 0) + 1
    whole = sum(tokens.values())
    for s, share in (("big", 0.6), ("mid", 0.25), ("small", 0.1)):
        assert abs(tokens[s] / whole - share / 0.95) < 0.01
    assert max(n for (s, _), n in copies.items() if s == "small") <= 4 and max(n for (s, _), n in copies.items() if s == "big") == 1
    assert len({(r["source"], r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in by_slot.values())


@pytest.mark.parametrize("shares", [(0.6, 0.25, 0.15), (0.7, 0.29999, 0.00001), (1 / 3, 1 / 7, 11 / 21)])
def test_mix_is_never_a_block_of_tokens_off(spark, shares):
    rng = random.Random(3)
    docs = [(1000 * k + i, s, rng.choice([1, 7, 40, 90, 700])) for k, s in enumerate("abc") for i in range(120)]
    pieces = mx.mix_pieces(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), spark.createDataFrame([(s, x, 2) for s, x in zip("abc", shares)], TARGETS), block=32, per_bucket=50)
    rows = sorted(pieces.collect(), key=lambda r: (r["slot"], r["start"]))
    weights, done, every = dict(zip("abc", shares)), dict.fromkeys("abc", 0), 0
    assert [r["slot"] for r in rows][-1] == len({r["slot"] for r in rows}) - 1
    for r in rows:
        n = r["last"] - r["first"] + 1
        done[r["source"]] += n
        every += n
        assert all(abs(done[s] - weights[s] * every) < 32 * 1.01 for s in done)
    worst = [r["worst"] for r in mx.deviation(pieces, 32).collect()]
    assert max(worst) < 1.01
    whole = {d: n for d, _, n in docs}
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["copy"]), []).append((r["first"], r["last"]))
    for (d, _), parts in by.items():
        parts.sort()
        assert parts[0][0] == 0 and all(p[1] + 1 == q[0] for p, q in zip(parts, parts[1:])) and parts[-1][1] < whole[d]
    assert all(done[s] > 0 for s in done if weights[s] * every >= 32)


def test_a_stated_total_is_filled_and_falls_short_openly(spark):
    docs = [(i, "big", 10) for i in range(2000)] + [(9000, "tiny", 64)]
    sizes, targets = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 3)], TARGETS)
    got = {r["source"]: r for r in mx.shares(mx.mix_pieces(sizes, targets, total=20_000), targets).collect()}
    assert got["tiny"]["n_tokens"] == 192 and got["tiny"]["most_copies"] == 3 and got["big"]["n_tokens"] == 156 * 64 and got["tiny"]["actual_share"] < 0.02


def test_weights_keep_every_source():
    assert mx.weights_of({"a": 0.12, "b": 0.13, "c": 0.75}) == {"a": 12, "b": 13, "c": 75}
    assert mx.weights_of({"a": 0.5, "b": 1e-9, "c": 0.0}) == {"a": 1_000_000, "b": 1}
    assert mx.weights_of({}) == {}


def test_mix_of_nothing(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mx.mix(sizes, targets).count() == 0
    some = spark.createDataFrame([(1, "b", 5)], "doc_id bigint, source string, tokens bigint")
    assert mx.mix(some, targets).count() == 0 and mx.mix(some, targets.where("false")).count() == 0


def test_sources_are_compared_plainly(spark):
    df = spark.createDataFrame([(1, "one two", "Web-Crawl "), (2, "three", "web_crawl"), (3, "x", None), (4, None, "a"), (5, "", "a")], "doc_id bigint, text string, source string")
    assert {(r["doc_id"], r["source"]) for r in mx.sized_documents(df).collect()} == {(1, "web_crawl"), (2, "web_crawl")}


# texts that lost their end

DOCS = "doc_id bigint, text string, source string, n_chars bigint, tok string, c int"


def corpus(limit=120):
    rng = random.Random(7)
    words = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(7, 12))).capitalize() + rng.choice(".?!")
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence() for _ in range(rng.randrange(1, 4)))
        kind = i % 10
        if kind == 0 and len(text) > limit:
            text = text[:limit]
        elif kind == 1:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(2, 6))).capitalize()
        elif kind == 2:
            text = text[:-1] + "…"
        elif kind == 3 and len(text) > 60:
            at = rng.randrange(40, len(text) - 2)
            text = text[:at]
        stops = text.rstrip()[-1] in ".?!…"
        if kind in (0, 3) and not stops:
            cut.add(i)
        rows.append((i, text, "limited" if kind == 0 else "free", len(text), "x", 1))
    return rows, cut


def test_truncated_texts_are_found(spark):
    rows, cut = corpus()
    got = {r["doc_id"] for r in tr.cut_texts(spark.createDataFrame(rows, DOCS)).where("cut").collect()}
    assert len(got & cut) / len(cut) > 0.97 and len(got - cut) / max(1, len(got)) < 0.03


def test_copies_are_judged_like_the_single_text(spark):
    rows, _ = corpus()
    once = {r["doc_id"]: r for r in tr.cut_texts(spark.createDataFrame(rows, DOCS)).collect()}
    heading = next(r for r in rows if r[0] % 10 == 1 and len(r[1]) > 24 and not once[r[0]]["cut"])
    lost = next(r for r in rows if (o := once[r[0]])["cut"] and o["goes_on"] and not (o["no_word"] or o["at_limit"] or o["one"]))
    extra = [(10_000 + i, heading[1], "Free", None, "", 0) for i in range(40)] + [(20_000 + i, lost[1], f"s{i % 60}", None, "", 0) for i in range(900)]
    for copies in ([x for x in extra if x[0] < 20_000], [x for x in extra if x[0] >= 20_000], extra):  # the last: more than a third of the rows
        got = {r["doc_id"]: r["cut"] for r in tr.cut_texts(spark.createDataFrame(rows + copies, DOCS)).collect()}
        assert {i: got[i] for i in once} == {i: r["cut"] for i, r in once.items()}
        assert all(got[c[0]] == (c[0] >= 20_000) for c in copies) and len(got) == len(rows) + len(copies)


def test_odd_texts_are_never_cut(spark):
    rows = [(1, None, "a", None, "", 0), (2, "", "a", 0, "", 0), (3, " \n ", None, 3, "", 0), (4, "One.", None, 4, "", 0), (5, "One.", None, 4, "", 0)]
    out = tr.cut_texts(spark.createDataFrame(rows, DOCS))
    assert {r["doc_id"] for r in out.collect()} == {4, 5} and out.where("cut").count() == 0
    assert tr.cut_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_a_very_long_text(spark):
    rows, _ = corpus()
    long = " ".join(r[1] for r in rows if r[1][-1] == ".") + " And then it sto"
    out = tr.cut_texts(spark.createDataFrame([*rows, (9999, long, "free", len(long), "", 0)], DOCS)).where("doc_id = 9999").first()
    assert out["cut"]


def test_tags(spark):
    rows, _ = corpus()
    extra = [(9001, "<seg>" + rows[4][1] + "</seg>", "free", None, "", 0), (9002, "<seg>" + rows[4][1] + "</se", "free", None, "", 0), (9003, rows[4][1][:-1] + " <b>", "free", None, "", 0)]
    got = {r["doc_id"]: r["cut"] for r in tr.cut_texts(spark.createDataFrame([*rows, *extra], DOCS)).where(F.col("doc_id") > 9000).collect()}
    assert got == {9001: False, 9002: True, 9003: True}


def test_queries_run(spark):
    from probity.llm import queries as q
    for name in ("p6_fertility", "p7_mix", "p7_shares", "p7_deviation", "p7_filled_shares", "p8_found", "p8_rates", "p8_rules"):
        assert q.queries()[name](spark, str(DATA)).columns
