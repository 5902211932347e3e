"""Toxicity, quality and language: held-out accuracy, the rules of their methods, odd rows."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import langid, quality, toxicity, training
from marketlens.llm.queries import QUERIES
from marketlens.llm.splits import labelled_sample, remainder
from marketlens.llm.text import GramHasher
from .odd import documents

BIG = "/root/testdata/sf0.1"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def held(spark, name, label):
    out = QUERIES[name](spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id")
    return out.where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()


def auc(p):
    ranks = p["score"].rank()
    n1 = (p["y"] == 1).sum()
    return (ranks[p["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(p) - n1))


def test_toxicity_held_out(spark):
    p = held(spark, "op1_toxicity", "toxic")
    assert auc(p) > 0.8 and (p["predicted"] == p["y"]).mean() > 0.92
    assert ((p["score"] >= 0.5) == (p["predicted"] == 1)).all() and p["score"].between(0, 1).all()


def test_quality_held_out(spark):
    p = held(spark, "op6_quality", "quality")
    assert auc(p) > 0.99 and (p["predicted"] == p["y"]).mean() > 0.98
    assert ((p["score"] >= 0.3) == (p["predicted"] == 1)).all()


def test_languages_held_out(spark):
    out = QUERIES["op8_langid"](spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99


def test_log_count_ratios_are_those_of_plain_counts(spark):
    texts = [("you rotten thing", 1), ("rotten, rotten to the core", 1), ("a rotten day", 1), ("a fine day", 0), ("a fine thing to the core", 0), ("fine fine", 0), ("thing of beauty", 0)]
    sample = spark.createDataFrame(texts, "text string, y int")
    ratio, prior = toxicity.log_count_ratios(sample)
    grams = GramHasher(toxicity.BITS, toxicity.ORDERS)
    with_gram, n = {0: Counter(), 1: Counter()}, Counter(y for _, y in texts)
    for t, y in texts:
        with_gram[y].update(grams(t).tolist())
    for g in set(with_gram[0]) | set(with_gram[1]):
        want = 0.0
        if with_gram[0][g] + with_gram[1][g] >= toxicity.LEAST_DOCS:
            want = math.log((with_gram[1][g] + 1) / (n[1] + 2)) - math.log((with_gram[0][g] + 1) / (n[0] + 2))
        assert ratio[g] == pytest.approx(want, abs=1e-5)
    assert prior == pytest.approx(math.log(4 / 5))


def plain_buckets(text):
    """Buckets of the character n-grams of a text, one by one in whole numbers."""
    found, mask = set(), (1 << 64) - 1
    padded = f" {text.lower()} "
    for n in toxicity.ORDERS:
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & mask
            found.add((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> (64 - toxicity.BITS))
    return found


def test_toxicity_scores_are_those_of_plain_loops(spark):
    weights = np.random.default_rng(6).normal(0, 0.2, (1 << toxicity.BITS) + 1).astype(np.float32)
    texts = ["a rotten thing, a ROTTEN thing", "x", "", None, "\u00fcn\u00efc\u00f6d\u00e9 \U0001f600 text", "word " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(docs, weights).collect():
        text = texts[r["doc_id"]]
        raw = sum(float(weights[b]) for b in plain_buckets(text)) if text else 0.0
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(raw + float(weights[-1])))), abs=1e-5) and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_scores_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(8)
    params = quality._start(np.ones(2 * quality.FEATURES + 3)) + rng.normal(0, 0.05, quality.SIZE).astype(np.float32)
    p = {k: v.astype(float) for k, v in quality._views(params).items()}
    texts = ["one passage, short", " ".join(f"w{i}" for i in range(300)), "", None]
    for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), params).collect():
        gates, encodings = [], []
        for x in quality.passages(texts[r["doc_id"]] or "").astype(float):
            x = [(a - m) * s for a, m, s in zip(x, *p["scale"], strict=True)]
            h = [math.tanh(sum(a * w for a, w in zip(x, column, strict=True))) for column in p["enc"].T]
            v = [math.tanh(sum(a * w for a, w in zip(h, column, strict=True))) for column in p["v"].T]
            u = [1 / (1 + math.exp(-sum(a * w for a, w in zip(h, column, strict=True)))) for column in p["u"].T]
            gates.append(math.exp(sum(a * b * w for a, b, w in zip(v, u, p["w"], strict=True))))
            encodings.append(h)
        z = [sum(g * h[j] for g, h in zip(gates, encodings, strict=True)) / sum(gates) for j in range(quality.HIDDEN)]
        want = 1 / (1 + math.exp(-sum(a * w for a, w in zip(z, p["out"], strict=True)) - float(p["bias"][0])))
        assert r["score"] == pytest.approx(want, abs=1e-3) and r["predicted"] == int(r["score"] >= quality.THRESHOLD)


def test_averaged_rounds_are_those_of_plain_loops(spark):
    rows = [(i, float(i % 7)) for i in range(40)]
    data = spark.createDataFrame(rows, "k long, x double").repartition(4, "k")
    parts = [[r["x"] for r in part] for part in data.rdd.glom().collect()]

    def local(params, batches, r):
        n = 0
        for pdf in batches:
            for x in pdf["x"]:
                params = params + np.float32(0.1 / (1 + r)) * (np.float32(x) - params)
                n += 1
        return params, n

    want = np.zeros(3, np.float64)
    for r in range(3):
        change, n = np.zeros(3), 0
        for part in parts:
            own = want.copy()
            for x in part:
                own += 0.1 / (1 + r) * (x - own)
            change += (own - want) * len(part)
            n += len(part)
        want += change / n
    assert training.average_rounds(data, np.zeros(3, np.float32), local, 3) == pytest.approx(want, abs=1e-4)


def test_quality_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    params = quality._start(np.ones(2 * quality.FEATURES + 3)).astype(np.float64)
    params += rng.normal(0, 0.05, len(params))
    x, starts, y, w = rng.normal(size=(9, quality.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss(p):
        s = quality.forward(p, x, starts)["score"]
        return float((-w * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean())

    g = quality.gradient(params, x, starts, y, w)
    for i in rng.choice(np.arange(2 * quality.FEATURES, quality.SIZE), 40, replace=False):
        e = np.zeros_like(params)
        e[i] = 1e-5
        assert g[i] == pytest.approx((loss(params + e) - loss(params - e)) / 2e-5, rel=1e-3, abs=1e-5)


def test_attention_sums_to_one_and_score_is_the_weighted_passages():
    rng = np.random.default_rng(2)
    params = quality._start(np.ones(2 * quality.FEATURES + 3))
    x, starts = rng.normal(size=(7, quality.FEATURES)).astype(np.float32), np.array([0, 3])
    f = quality.forward(params, x, starts)
    assert np.allclose(np.add.reduceat(f["a"], starts), 1, atol=1e-5)
    assert np.allclose(f["z"][1], (f["a"][3:, None] * f["h"][3:]).sum(0), atol=1e-5)


def test_passages_cover_the_whole_text():
    text = " ".join(f"w{i}" for i in range(1000))
    assert len(quality.passages(text)) == round(1000 / quality.PASSAGE)
    assert len(quality.passages("")) == 1 and len(quality.passages("one")) == 1
    changed = text + " ### ###"
    assert not np.allclose(quality.passages(text)[-1], quality.passages(changed)[-1])


def test_repetition_is_counted_alike_at_every_length():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 90, quality.PASSAGE * 5)]
    x = quality.passages(" ".join(words))
    share = [len(set(words[i : i + quality.PASSAGE])) / quality.PASSAGE for i in range(0, len(words), quality.PASSAGE)]
    assert x[:, quality._PAIRS + 2].tolist() == pytest.approx(share)
    many = 66_000  # more passages than 16 bits count
    x = quality.passages(" ".join((["a b"] * (quality.PASSAGE // 2) + ["c"] * quality.PASSAGE) * (many // 2)))
    assert len(x) == many and np.allclose(x[::2, quality._PAIRS + 2], 2 / quality.PASSAGE) and np.allclose(x[1::2, quality._PAIRS + 2], 1 / quality.PASSAGE)


def table(n_langs, counts):
    entries = np.array([(i, lang, n) for i, c in enumerate(counts.values()) for lang, n in c.items()])
    return langid.Table(n_langs, list(counts), *entries.T)


def plain_language(langs, words, grams, text):
    """The rule, word by word and place by place, over plain dictionaries {item: {language: count}}."""

    def log(counts, item, lang):
        bulk = sum(c.get(lang, 0) for c in counts.values()) + 0.5 * len(counts) + 0.5
        return math.log((counts.get(item, {}).get(lang, 0) + 0.5) / bulk)

    found, word = [], ""
    for c in text.lower() + " ":
        category = unicodedata.category(c)
        if category[0] == "L" or (word and category[0] == "M"):
            word += c
        elif word:
            found.append(word)
            word = ""
    if not found:
        return "und", 0.0
    mean = []
    for lang in range(len(langs)):
        total = 0.0
        for w in found:
            if w in words:
                total += log(words, w, lang)
                continue
            marked, places = f"^{w}$", []
            for i in range(len(marked) - 1):
                hit = next((marked[i : i + k] for k in range(4, 0, -1) if len(marked) - i >= k and marked[i : i + k] in grams), None)
                places.append(log(grams, hit, lang) - langid.BACKOFF * (4 - len(hit or "")))
            total += 2 * sum(places) / len(places)
        mean.append(total / len(found))
    odds = [math.exp((m - max(mean)) * min(len(found), 25)) for m in mean]
    return langs[mean.index(max(mean))], max(odds) / sum(odds)


def test_languages_are_those_of_the_plain_rule():
    langs = ["a", "b", "c"]
    words = {"known": {0: 9, 1: 1}, "word": {1: 4}, "\u00e9t\u00e9": {2: 7}, "e\u0301te": {2: 1}}
    grams = {"^kno": {0: 3}, "zz": {1: 5, 2: 1}, "z": {1: 2}, "q$": {2: 4}, "a": {0: 8, 1: 8, 2: 8}}
    model = langid.Model(langs, table(3, words), table(3, grams))
    texts = ["known", "known word", "knows zzq", "zzz zqz known", "\u00e9t\u00e9 e\u0301te", "unrelated things entirely", "a A a", "q " * 40, "known, known; " * 30 + "zzq", "\u00b2\u00b3 \u00bd \u2167 12", ""]
    memo = langid.Scores(model)
    for _ in range(2):
        best, sure = langid.classify(model, texts, memo)
        for t, lang, s in zip(texts, best, sure, strict=True):
            want, odds = plain_language(langs, words, grams, t)
            assert (lang, s) == (want, pytest.approx(odds, rel=1e-4))


def test_learnt_counts_are_those_of_the_sample(spark):
    rows = [(i, "ab ab c", "x") for i in range(40)] + [(i, "ab dd", "y") for i in range(40, 60)] + [(3, "ab ab c", "x")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    ids = {i for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    nx, ny = len([i for i in ids if i < 40]), len([i for i in ids if i >= 40])
    counts = {w: {k: round(math.exp(float(g)) * 0.5 - 0.5, 3) for k, g in zip(model.words.lang[s : s + n].tolist(), model.words.gain[s : s + n], strict=True)} for w, s, n in zip(model.words.items, model.words.start, model.words.length, strict=True)}
    assert counts == {"ab": {0: pytest.approx(2 * nx, rel=1e-3), 1: pytest.approx(ny, rel=1e-3)}, "c": {0: pytest.approx(nx, rel=1e-3)}, "dd": {1: pytest.approx(ny, rel=1e-3)}}


def test_equal_languages_go_to_the_first_and_digits_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "same words", lang) for i, lang in enumerate(["zz", "aa"] * 30)], "doc_id long, text string, lang string")
    model = langid.Model(["aa", "zz"], table(2, {"same": {0: 3, 1: 3}}), table(2, {"s": {0: 1, 1: 1}}))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs.limit(1).union(spark.createDataFrame([(-1, "\u00b2\u00b3 \u00bd \u2167 42", "x")], docs.schema)), model).collect()}
    assert out[-1] == ("und", 0.0) and [v for k, v in out.items() if k >= 0] == [("aa", pytest.approx(0.5))]


def test_very_many_languages(spark):
    docs = spark.createDataFrame([(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} x", f"l{i}") for i in range(3000)], "doc_id long, text string, lang string")
    model = langid.train(docs, most=500)
    assert 300 < len(model.langs) < 800 and len(model.words.lang) <= 2 * len(model.langs)
    assert langid.predict(docs.limit(3), model).where("score between 0 and 1").count() == 3


def test_an_id_with_very_many_texts_keeps_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(1, "again")] * 500 + [(i, "t") for i in range(2, 200)], "doc_id long, text string")
    labels = labels_of(spark, [(i, 1, 0, "x") for i in range(200)])
    assert labelled_sample(docs, labels, "toxic", 5, 200).count() <= 2 * 200


def test_nothing_learnt_gives_und(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(docs)
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}


def test_odd_rows(spark, sf):
    docs = documents(spark)
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    out = langid.predict(docs, model).collect()
    assert len(out) == docs.count() and all(r["lang_pred"] == "und" for r in out if r["doc_id"] in (2, 3, 4, 9_007_199_254_740_993))
    assert 9_007_199_254_740_993 in {r["doc_id"] for r in out} and sum(r["doc_id"] is None for r in out) == 2
    labels = labels_of(spark, [(1, 1, 0, "x"), (1, 1, 1, "x"), (5, 0, 1, "x"), (None, 1, 1, "x"), (7, None, None, None)])
    tox = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    good = quality.score(docs, quality.train(docs, labels)).collect()
    for rows in (tox, good):
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1 and [r["score"] for r in rows if r["doc_id"] == 2] == [r["score"] for r in rows if r["doc_id"] == 3]
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0 and quality.score(none, quality.train(none, labels.limit(0))).count() == 0 and langid.predict(none, model).count() == 0


def test_filters_keep_whole_rows(spark, sf):
    docs = documents(spark)
    kept = langid.keep_known(docs, langid.train(spark.read.parquet(f"{sf}/documents.parquet")), 0.0)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {1, None, 5, 7}
    params = quality._start(np.ones(2 * quality.FEATURES + 3))
    assert quality.keep_good(docs, params).count() == quality.score(docs, params).where("predicted = 1").count()


def test_held_out_rows_are_never_learnt_from(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    spoilt = docs.withColumn("text", F.when(remainder(F.col("doc_id"), 5) == 0, "poison").otherwise(F.col("text")))
    assert labelled_sample(spoilt, labels, "toxic", 5, 1000).where("text = 'poison'").count() == 0
