"""N-gram Jaccard join, decontamination and the pipeline against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import components, decontam, ngram_join
from .odd import documents

ASCII = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(ASCII))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_components(rows):
    """doc_id of each row's component, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    names = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            names[find(i)] = min(id_, names.get(find(i), id_))
    return [(id_, len(sets[i]), names.get(find(i)) if sets[i] else id_) for i, (id_, _) in enumerate(rows)]


def corpus(seed, groups=12, words=120):
    """Texts with exact copies, chains of near copies, a shared passage, and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = rng.choices(vocabulary, k=60)
    rows, id_ = [], 0
    for g in range(groups):
        base = rng.choices(vocabulary, k=words) if g % 3 else shared + rng.choices(vocabulary, k=words // 4)
        for _ in range(rng.choice([1, 1, 2, 8, 30])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = text  # a chain: later ones follow this one
            rows.append((id_, " ".join(text)))
            id_ += 1
    rows += [(id_, "Two  words"), (id_ + 1, "two words"), (id_ + 2, ""), (id_ + 3, None), (id_ + 4, "One")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, cell, pivots, hot", [(1, 128, 16, 12), (2, 8, 2, 3), (3, 6, 0, 2), (4, 4, 1, 1)])
def test_join_finds_the_components_of_all_links(spark, monkeypatch, seed, cell, pivots, hot):
    for name, value in (("CELL", cell), ("PIVOTS", pivots), ("HOT", hot)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed)
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(plain_components(rows), key=repr)


@pytest.mark.parametrize("hot", [1, 12])
def test_templates_that_link_or_not(spark, monkeypatch, hot):
    # one text with own words at random places in each copy, from far below the threshold to above it, and of several lengths
    for name, value in (("HOT", hot), ("CELL", 8), ("PIVOTS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(4)
    rows = []
    for g in range(3):
        template = [f"t{g}w{i}" for i in range(150 + 40 * g)]
        for i in range(40):
            text = template[: len(template) - rng.choice([0, 0, 5, 15])]
            at = rng.randrange(len(text))
            rows.append((len(rows), " ".join(text[:at] + [f"own{g}x{i}x{j}" for j in range(rng.choice([0, 2, 6, 10, 14, 18, 25]))] + text[at:])))
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, out)) == sorted(plain_components(rows))


def test_texts_that_share_a_template_but_do_not_link_are_no_cluster(spark):
    template = [f"t{i}" for i in range(180)]
    rows = [(i, " ".join(template + [f"own{i}x{j}" for j in range(26)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = spark.sparkContext.broadcast(ngram_join.sketch(docs, 4))
    described = ngram_join.map_texts(docs.withColumn("text_key", F.xxhash64("text")), ngram_join._describe(counts, 4, 85, 100), "text_key long, n long, set_key long, group long, prefix array<long>", "doc_id", "text_key", "text")
    edges = ngram_join._candidates(ngram_join.materialize(described, "rows"), 85, 100)
    assert edges.count() < 60


def test_join_bears_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.join(docs).collect()), key=repr) == sorted(plain_components(rows), key=repr)
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in plain_components(rows) if n} | {i for i, n, _ in plain_components(rows) if not n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    odd = documents(spark)
    # rows without words all stay; of the two equal rows one does; the text under a null id is no copy of a named one
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in ngram_join.keep_one(odd).collect()).count((1, len(odd.first()["text"]))) == 1


def test_contraction(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + rng.randrange(40)) for i in range(40)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    for a, b in itertools.combinations(sorted(got), 2):
        assert (got[a] == got[b]) == (find(a) == find(b))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def plain_report(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for id_, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[x]
        out.append((id_, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def planted(seed):
    rng = random.Random(seed)
    v = [f"v{i}" for i in range(40)] + ["É", "Tag", "x1"]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 3, 5, 9, 10, 11, 30])))) for i in range(14)] + [(99, ""), (98, None), (None, "null item of ten words and then some more words here")]
    items.append((50, "same " * 25))
    docs = []
    for i in range(60):
        parts = [rng.choices(v, k=rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            at = rng.randrange(len(w) + 1)
            parts += [w[at : at + rng.randrange(1, 25)], rng.choices(v, k=rng.randrange(8))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if w.isascii() and rng.random() < 0.2 else w for p in parts for w in p)))
    return docs + [(1000, "same " * 40), (1001, None), (1002, ""), (1003, "THE null ITEM of ten words and then some more words")], items


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed, limit):
    docs, items = planted(seed)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.report(d, b, limit).collect()]
    assert sorted(got) == sorted(plain_report(docs, items))
    clean = decontam.decontaminate(d, b, limit)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in plain_report(docs, items) if not r[5])


def test_report_bears_odd_rows(spark):
    docs = documents(spark)
    b = spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs away", "z"), (None, None, "z")], "item_id long, text string, fp string")
    got = sorted((tuple(r) for r in decontam.report(docs, b).collect()), key=repr)
    assert got == sorted(plain_report([(r["doc_id"], r["text"]) for r in docs.collect()], [(1, "brown fox jumps over the lazy dog and runs away")]), key=repr)
    assert decontam.report(docs.limit(0), b).count() == 0 and decontam.report(docs, b.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs, b).columns == docs.columns


def test_pipeline_is_its_stages_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf).persist()
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        assert ids <= {r[0] for r in rows} and (after.columns == columns or i == len(corpus_pipeline.STAGES) - 1)
        if name == "n-gram Jaccard join":
            assert ids == {c for _, _, c in plain_components(rows)}
        if name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert ids == {r[0] for r in plain_report(rows, items) if not r[5]}
        before = after
    final = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in final.collect()) == sorted(ids) and final.where("repeats < 1 or repeats > 3").count() == 0
    assert final.agg(F.count("text")).first()[0] == len(ids)


def test_pipeline_drops_copies_from_five_words_and_four_fifths_on(spark, sf):
    # pairs of 200 words with scattered edits, or one inserted block, whose similarity runs from 0.70 to 0.95
    rng = random.Random(11)
    rows, between = [], 0
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(200)]
        if g % 2:
            text = list(base)
            for at in range(g % 3, 200, 200 // (2 + g // 10)):
                text[at] = "edited"
        else:
            text = base[:100] + [f"g{g}new{i}" for i in range(10 + g)] + base[100:]
        x, y = (shingles(" ".join(t), 5) for t in (base, text))
        a, b = (shingles(" ".join(t), 4) for t in (base, text))
        near = 100 * len(x & y) >= 80 * len(x | y)
        between += near != (100 * len(a & b) >= 85 * len(a | b))
        pair = [(2 * g, " ".join(base), near), (2 * g + 1, " ".join(text), near)]
        rng.shuffle(pair)
        rows += pair
    assert between >= 5  # pairs that four words and 0.85 tell otherwise
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, near in rows if not (near and i % 2))
