"""Language-model scoring, nearest neighbours, chat and HTML against plain versions."""

import itertools
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import ann, chat, html, lm
from marketlens.llm.text import shingle_set, word_hashes
from .odd import documents


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def plain_base(rows):
    counts = Counter()
    for id_, text in rows:
        if id_ is not None and zlib.crc32(str(id_).encode()) % 10:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    return counts, n, lambda text: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(text))


@pytest.mark.parametrize("head", [lm.HEAD, 5])
def test_base_scores(spark, sf, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)  # with a small one nearly all words go through the join
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts, n, base = plain_base(rows)
    texts = dict(rows)
    out = lm.score(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        t = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n)
        assert r["base_score"] == pytest.approx(base(t), rel=1e-9) and r["score"] < 0


def test_model_is_a_distribution():
    head = [b"", *[f"w{i}".encode() for i in range(40)]]
    classes = np.random.default_rng(1).integers(-1, 3, 41)
    model = lm.Model(list(head), np.array([50, *range(400, 0, -10)]), 10_000, 500, classes)
    rng = np.random.default_rng(0)
    model.tables = [rng.normal(0, 0.5, t.shape).astype(np.float32) for t in model.tables]
    # over all next words after one history, those outside the head together, probabilities sum to 1
    total = sum(10 ** lm.log10_model(model, np.array([3, 5, w]), np.array([0]))[2] for w in range(42))
    assert total == pytest.approx(1, abs=1e-4)


def test_every_word_has_its_own_digits(monkeypatch):
    monkeypatch.setattr(lm, "WIDTH", 3)
    n = 200
    classes = np.where(np.arange(n) < 100, 0, np.arange(n) % 4 - 1)  # one class of over 27 words, and words of none
    model = lm.Model([b"%d" % i for i in range(n)], np.arange(n, 0, -1), 50_000, 900, classes)
    assert len({tuple(model.digit[:, i]) for i in range(n + 1)}) == n + 1 and model.digit[1:].max() < 3
    assert all(0 <= model.digit[level].min() and model.digit[level].max() < outs for level, outs in enumerate(model.outs))


def plain_scores(rows):
    """The whole model by loops over tokens: classes' neighbours, biases, the update's sums, probabilities."""
    train = [(t, half) for i, t, half in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t, _ in train for w in tokens(t))
    head = sorted(counts, key=lambda w: (-counts[w], w))
    number = {w: i for i, w in enumerate(head)}
    near = np.zeros((len(head), 2 * lm.MARKS))
    for t, _ in train:
        ids = [number[w] for w in tokens(t)]
        for i in range(len(ids)):
            for d in (1, 2):
                if i + d < len(ids) and ids[i] < lm.MARKS:
                    near[ids[i + d], ids[i]] += 1
                if i + d < len(ids) and ids[i + d] < lm.MARKS:
                    near[ids[i], lm.MARKS + ids[i + d]] += 1
    classes = lm.word_classes(near.astype(np.float32), np.array([counts[w] for w in head]))
    total, mass = sum(counts.values()), {}
    kinds = sorted(set(classes[classes >= 0].tolist()))
    assert len(head) < lm.WIDTH**lm.DIGITS
    of = [kinds.index(c) if c >= 0 else len(kinds) for c in classes]
    others = len(kinds) + (-1 in classes)
    place, path = Counter(), {}
    for w, c in zip(head, of, strict=True):
        r = place[c]
        place[c] += 1
        path[w] = (c, r // lm.WIDTH**2, r // lm.WIDTH % lm.WIDTH, r % lm.WIDTH)
    path[None] = (others,)
    for w, p in path.items():
        n = counts[w] if w is not None else lm.SMOOTH
        for level in range(len(p)):
            key = p[:level], p[level]
            mass[key] = mass.get(key, 0) + n
            mass[p[:level]] = mass.get(p[:level], 0) + n
    model = lm.Model(head, np.array([counts[w] for w in head]), total, len(head), classes)
    nodes = {p[:level]: int(model.node[level][number[w]]) for w, p in path.items() if w is not None for level in range(len(p))}
    nodes[()] = 0
    outs = {}
    for p in path.values():
        for level in range(len(p)):
            outs.setdefault(p[:level], set()).add(p[level])
    weight = {}

    def features(one, two, prefix):
        level, node = len(prefix), nodes[prefix]
        return [(level, int(r[0])) for r in lm._features(model, lm._hashes(np.array([one]), np.array([two])), np.array([node]), level)]

    def expected(prefix):
        return {o: mass[prefix, o] / mass[prefix] for o in outs[prefix]}

    def softmax(prefix, found):
        z = {o: math.log(p) + sum(s * weight.get((r, o), 0.0) for s, r in zip(lm.SHARES, found, strict=False)) for o, p in expected(prefix).items()}
        top = sum(math.exp(x) for x in z.values())
        return {o: math.exp(x) / top for o, x in z.items()}

    def events(text):
        one, two = 0, 0
        for w in tokens(text):
            known = w if w in number else None
            for level in range(len(path[known])):
                yield w, path[known][:level], path[known][level], features(one, two, path[known][:level])
            one, two = number.get(w, len(head)) + 2, one if one > 1 else 1

    observed, n, of_row = Counter(), Counter(), {}
    for t, _ in train:
        for _, prefix, out, found in events(t):
            for r in found:
                n[r] += 1
                observed[r, out] += 1
                assert of_row.setdefault(r, prefix) == prefix
    for r, prefix in of_row.items():
        for o, p in expected(prefix).items():
            gradient = observed[r, o] - n[r] * p
            weight[r, o] = math.log(1 + gradient / ((n[r] + lm.DAMP) * p))
    for _, text, _ in rows:
        score = sum(math.log10(softmax(prefix, found)[out]) for _, prefix, out, found in events(text))
        yield score + sum(math.log10(lm.SMOOTH / lm.SMOOTH) for w in tokens(text) if w not in number)


def test_scores_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words[:15] if i % 2 else words[12:], rng.integers(1, 25))) for i in range(60)] + ["w1 new word w2", ""]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    want = dict(zip(range(len(rows)), plain_scores(rows), strict=True))
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: pytest.approx(x, abs=2e-3) for i, x in want.items()}


def test_scores_do_not_hang_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    one, many = ({r["doc_id"]: r["score"] for r in lm.score(docs.repartition(n)).collect()} for n in (1, 16))
    assert one == {i: pytest.approx(x, rel=1e-4) for i, x in many.items()}


def test_training_learns_what_follows(spark):
    text = " ".join(["red green blue"] * 40)
    docs = spark.createDataFrame([(i, text) for i in range(200)] + [(1000 + i, " ".join(np.random.default_rng(i).permutation(["red", "green", "blue"] * 40))) for i in range(50)], "doc_id long, text string")
    out = lm.score(docs).toPandas()
    assert (out["score"] > out["base_score"])[out["doc_id"] < 1000].all()


def test_every_training_text_gives_gradients(spark):
    # copies of one text each time, in one partition of three: whatever the text's hash, its contexts get weights
    for n in range(3):
        text = " ".join([f"red{n} green{n} blue{n}"] * 40)
        docs = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string").repartition(3)
        out = lm.score(docs).toPandas()
        assert (out["score"] > out["base_score"] + 1).all()


def test_history_stops_at_texts():
    ids, first = np.array([7, 8, 9, 4, 5, 6]), np.array([0, 3, 5])
    one, two = lm._history(ids, first)
    assert one.tolist() == [0, 9, 10, 0, 6, 0] and two.tolist() == [0, 1, 9, 0, 1, 0]


def test_lm_bears_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    _, n, base = plain_base(rows)
    got = sorted((repr(r["doc_id"]), r["n_tokens"], round(r["base_score"], 4)) for r in lm.score(docs).collect())
    assert got == sorted((repr(i), len(tokens(t)), round(base(t), 4)) for i, t in rows)
    assert lm.score(docs.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string")


def exact(rows, q, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    at = int(np.flatnonzero(ids == q)[0])
    s = (x * x[at]).sum(1) / (n * n[at])
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_neighbours_recall_and_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    out = ann.search(df).collect()
    found = total = 0
    for q in {r["query_id"] for r in out}:
        got = [(r["vec_id"], r["score"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        want = exact(rows, q)
        assert [r for r, _ in got] == [i for i, _ in sorted(got, key=lambda e: (-e[1], e[0]))]
        scores = dict(exact(rows, q, len(rows)))
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in got)
        found += len({i for i, _ in got} & {i for i, _ in want})
        total += len(want)
    assert found / total >= 0.9 and {r["query_id"] for r in out} == {i for i, _ in rows if i % 50 == 0}


def test_neighbours_bear_odd_rows(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=8).tolist()
    rows = [(i, same) for i in range(0, 400)] + [(400 + i, rng.normal(size=8).tolist()) for i in range(50)]
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1150, [None] + [1.0] * 7), (1200, [float("inf")] * 8), (1250, [1.0, 2.0]), (None, same), (50, same)]
    out = ann.search(vectors(spark, rows)).collect()
    assert {r["query_id"] for r in out} == {i for i in range(0, 450, 50)}
    for q in (0, 50, 350):
        assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i in range(7) if i != q][:5]
    assert ann.search(vectors(spark, [])).count() == 0
    two = ann.search(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 1)]


def test_neighbours_with_every_row_repeated(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.01 * rng.normal(size=8)).tolist()) for i in range(120)]
    out = ann.search(vectors(spark, rows * 6).coalesce(1)).collect()
    for q in (0, 50, 100):
        assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i, _ in exact(rows, q)]


def test_outliers_beside_a_tight_cluster_find_their_neighbours(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=16)
    outliers = {0: -centre, 50: rng.normal(size=16) - centre, 100: 0.5 * rng.normal(size=16) - centre}
    rows = [(i, (outliers[i] if i in outliers else centre + 0.001 * rng.normal(size=16)).tolist()) for i in range(2000)]
    out = ann.search(vectors(spark, rows)).collect()
    assert Counter(r["query_id"] for r in out) == {q: 5 for q in range(0, 2000, 50)}
    for q in outliers:
        assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i, _ in exact(rows, q)]


def test_probes_come_in_the_order_of_their_success(monkeypatch):
    d, c = 4, 0.4
    index = ann.Index(6, d, 1.0, c)
    x = ann._unit(np.random.default_rng(0).normal(size=(3, 6)))
    gauss = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for q in range(3):
        missed = np.empty((ann.TABLES, ann.SLOTS**d))
        for t in range(ann.TABLES):
            place = x[q] @ index.directions[t]
            value, hit = {}, {}
            for slots in itertools.product(range(ann.SLOTS), repeat=d):
                total, held, number = 0.0, 1.0, sum(s * ann.SLOTS**j for j, s in enumerate(slots))
                for j, slot in enumerate(slots):
                    edges = [-math.inf, *index.edges[t, :, j], math.inf]
                    lo, hi = edges[slot], edges[slot + 1]
                    near = gauss((hi - c * place[j]) / math.sqrt(1 - c * c)) - gauss((lo - c * place[j]) / math.sqrt(1 - c * c))
                    held *= near
                    total += math.log(near) - ann.CROWDING * math.log(gauss(hi) - gauss(lo))
                value[number], hit[number] = total, held
            all_, reached = index.visits(x)
            visits = all_[t, q].tolist()
            missed[t] = 1 - np.cumsum([hit[v] for v in visits])
            got = [value[v] for v in visits]
            assert got == pytest.approx(sorted(value.values(), reverse=True)) and len(set(visits)) == len(value)
            with monkeypatch.context() as patch:
                patch.setattr(ann, "PROBES", 10)
                few = ann.Index(6, d, 1.0, c).visits(x)[0][t, q].tolist()
            assert [value[v] for v in few] == pytest.approx(got[:10])
            slot = [int(sum(place[j] >= e for e in index.edges[t, :, j])) for j in range(d)]
            assert index.buckets(x)[t, q] == sum(s * ann.SLOTS**j for j, s in enumerate(slot))
        assert reached[q].tolist() == pytest.approx((1 - missed.prod(0)).tolist(), abs=1e-9)
        for bar in (0.3, 0.9, 1.0):
            n = int(index.enough(reached, bar)[q])
            assert reached[q, n - 1] >= bar - 1e-9 and (n == 1 or reached[q, n - 2] < bar)


def test_harder_queries_visit_more_buckets(sf):
    """On the given vectors: recall against brute force, the mean and that of the worst tenth, and how much the buckets visited differ."""
    import duckdb

    v = ann._unit(np.array([r[0] for r in duckdb.sql(f"SELECT embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()]))
    near = []
    for i in range(len(v)):
        score = v @ v[i]
        score[i] = -2
        near.append(np.argsort(-score)[:5])
    asked = range(0, len(v), 3)
    index = ann.fit(v, v[list(asked)], [v[near[i]] for i in asked], len(v))
    visits, reached = index.visits(v)
    n, buckets = index.enough(reached, index.bar), index.buckets(v)
    recall = np.sort([np.mean([any(buckets[t, j] in visits[t, i, : n[i]] for t in range(ann.TABLES)) for j in near[i]]) for i in range(len(v))])
    assert recall.mean() >= 0.94 and recall[: len(v) // 10].mean() >= 0.75 and n.max() > n.min()


def test_magnitudes_change_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    scaled = [(i, (np.array(v) * 2.0 ** rng.choice([-900, -3, 0, 900])).tolist()) for i, v in rows]
    schema = "vec_id long, embedding array<double>"
    plain, other = (sorted(map(tuple, ann.search(spark.createDataFrame(x, schema)).collect())) for x in (rows, scaled))
    assert [r[:3] for r in plain] == [r[:3] for r in other] and [r[3] for r in plain] == pytest.approx([r[3] for r in other], abs=1e-15)


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.choice([-200, 0, 200])).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    units = {i: np.array(v) / np.max(np.abs(v)) for i, v in rows}
    out = ann.search(df).collect()
    for q in (0, 50):
        score = {i: float(units[i] @ units[q] / np.sqrt((units[i] @ units[i]) * (units[q] @ units[q]))) for i in units if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:5]
        got = {r["rank"]: (r["vec_id"], r["score"]) for r in out if r["query_id"] == q}
        assert len({i for i, _ in got.values()} & set(want)) >= 4 and all(s == pytest.approx(score[i]) for i, s in got.values())


def test_an_id_with_several_vectors_is_asked_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i % 40, rng.normal(size=8).round(3).tolist()) for i in range(160)]
    monkeypatch.setattr(ann, "BLOCK", 1)
    out = ann.search(vectors(spark, rows).repartition(5)).collect()
    assert [(r["query_id"], r["rank"]) for r in out] == [(0, r) for r in range(1, 6)]
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    q = np.array(min(v for i, v in single if i == 0))
    score = {}
    for i, v in single:
        if i:
            score[i] = max(score.get(i, -2), float(np.array(v) @ q / np.sqrt((np.array(v) ** 2).sum() * (q**2).sum())))
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == sorted(score, key=lambda i: (-score[i], i))[:5]


def test_hot_cells_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 32)
    monkeypatch.setattr(ann, "CELL_QUERIES", 2)
    rng = np.random.default_rng(10)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.05 * rng.normal(size=8)).tolist()) for i in range(600)]
    out = ann.search(vectors(spark, rows)).collect()
    found = sum(len({r["vec_id"] for r in out if r["query_id"] == q} & {i for i, _ in exact(rows, q)}) for q in range(0, 600, 50))
    assert found >= 0.9 * 5 * 12 and len(out) == 60


def test_query_blocks_give_the_same(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = sorted(map(tuple, ann.search(df).collect()))
    monkeypatch.setattr(ann, "BLOCK", 3)
    assert sorted(map(tuple, ann.search(df).collect())) == whole


def test_chat_keeps_the_longest_snapshot(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "<|im_end|>"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", "<|im_end|>"), (5, 0, "user", "yo"), (6, None, None, None), (None, 0, "user", "lost")]
    out = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {3, 5, 6}
    assert out[3] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n< |im_end|><|im_end|>\n")
    assert out[6] == (1, "<|im_start|>\n<|im_end|>\n")


def test_chat_order_matters_and_repeats_count(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "b"), (2, 1, "user", "a"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "a")]
    out = chat.render(spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, n int"))
    assert {r["conv_id"]: r["n_turns"] for r in out.collect()} == {1: 2, 2: 2, 3: 2}
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name, and more.</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everybody does, to make this site work well for you.</p></div>
<div id=content><h1>Head &amp; line</h1><p>First   paragraph, with <b>bold</b> text;\n and <a href="y">a link</a> in it.<p>Second paragraph. It goes on for a while, as paragraphs do.
<ul><li>One thing</li><li>Another</li></ul><blockquote>Quoted, said he.</blockquote><!-- no <p>comment</p> --><script>if (a < b) { x("</p>") }</script></div>
<aside><p>Read also: another story, with many words in it, so long that it looks like text.</p></aside>
<div class="comments"><p>First! What a great story, I have never read the like of it before.</p></div><form><label>Mail</label></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    want = ["Head & line", "First paragraph, with bold text; and a link in it.", "Second paragraph. It goes on for a while, as paragraphs do.", "One thing", "Another", "Quoted, said he."]
    assert html.main_text(PAGE) == "\n".join(want)
    assert html.main_text(None) == html.main_text("") == html.main_text("<html><script>x") == ""
    assert html.main_text("just text &lt;here&gt; &#8364;") == "just text <here> €"
    assert html.main_text("<article><h1>A<p>b <i>c</i> d</article><div class=ad>Buy, now. Yes.</div>") == "A\nb c d"


def test_article_without_marks_among_boilerplate():
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(20))
    body = "".join(f"<p>Sentence {i}, which has commas, and ends well. So does this one, after all.</p>" for i in range(8))
    page = f"<html><body><div><ul>{links}</ul></div><table><tr><td><div>{body}<p>Short.</p></div></td><td><ul>{links}</ul></td></tr></table><div>Imprint</div></body></html>"
    text = html.main_text(page).split("\n")
    assert len(text) == 9 and text[-1] == "Short." and not any("Link" in t or "Imprint" in t for t in text)


def test_one_long_paragraph_does_not_hide_the_others():
    long = "A long sentence, with commas, that goes on. " * 30
    page = f"<body><div><h1>Title</h1><p>Lead.</p><p>{long}</p><p>End.</p></div><div><a href=x>More</a></div></body>"
    assert html.main_text(page).split("\n") == ["Title", "Lead.", long.strip(), "End."]
    nested = f"<main><section><h2>One</h2><p>{long}</p></section><section><h2>Two</h2><p>Short.</p></section></main><p>Imprint</p>"
    assert html.main_text(nested).split("\n") == ["One", long.strip(), "Two", "Short."]


def test_unclosed_elements_pile_up_without_harm():
    page = "<article>" + "<div><b><span>word, " * 30_000
    assert html.main_text(page) == "\n".join(["word,"] * 30_000)


def test_pages(spark, sf):
    rows = [(1, "u", PAGE, "x"), (1, None, None, "x"), (None, "u", "", "x"), (2, "v", "<p>" + "long, text. " * 100_000, "x")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in out] == [(1, "u", len(html.main_text(PAGE))), (1, None, 0), (None, "u", 0), (2, "v", 1_199_999)]
    real = spark.read.parquet(f"{sf}/pages.parquet")
    got = html.extract(real)
    assert got.count() == real.count() and got.where(F.col("n_chars") != F.length("text")).count() == 0


def test_hashes_follow_the_word_rule():
    assert len(word_hashes(" A b\tC\x0bd e ")) == 4
    assert (word_hashes("Straße ABC") == word_hashes("Straße abc")).all() and word_hashes("É")[0] != word_hashes("é")[0]
    assert len(shingle_set("a b c d a b c d a b c d", 4)) == 4 and len(shingle_set("a b", 4)) == 1
    long = "x" * 200_000
    assert word_hashes(long)[0] != word_hashes(long[:-1] + "y")[0] and len(set(word_hashes("ab ba aab baa").tolist())) == 4


def test_no_chosen_part_of_a_page_is_dropped():
    def para(i):
        return f"Part {i} says, at some length, what a reader of the page came for; it goes on, and ends here."

    def ps(*numbers):
        return "".join(f"<p>{para(i)}</p>" for i in numbers)

    split = f"<body><div id=content><div>{ps(*range(13))}</div><section>{ps(*range(13, 20))}</section></div></body>"
    assert html.main_text(split).split("\n") == [para(i) for i in range(20)]
    listed = f"<body><div id=content>{ps(0, 1)}<ul>{''.join(f'<li>{para(i)}</li>' for i in range(2, 6))}</ul>{ps(6)}</div></body>"
    assert html.main_text(listed).split("\n") == [para(i) for i in range(7)]
    inner = f"<nav>Home</nav><div>{ps(*range(5))}</div><div class=sidebar><p>Other, short.</p></div>"
    assert html.main_text(f"<body><div class=has-sidebar>{inner}</div></body>").split("\n") == [para(i) for i in range(5)]


def test_deep_elements_close_themselves():
    deep = "<div>" * 600
    assert html.main_text(f"<article>{deep}<p>One, two.</p><nav>Menu, links.</nav><div>Three, four.</div>{'</div>' * 600}<p>Five, six.</p></article>").split("\n") == ["One, two.", "Three, four.", "Five, six."]


def test_names_do_not_drop_parts_of_the_article():
    long = "A long sentence, with commas, that goes on. " * 10
    page = f'<nav>Home</nav><article><div class="article-header"><h1>Title</h1></div><header><p>Lead.</p></header><p>{long}</p><section id="related-work"><h2>Work</h2><p>Others, too.</p></section><div class="share">Share this, now.</div><div class="article-comments"><p>First, of course.</p></div></article><header>Site, name.</header>'
    assert html.main_text(page).split("\n") == ["Title", "Lead.", long.strip(), "Work", "Others, too."]


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<section id="side-effects"><p>{}</p></section>', True),
        ('<h2 id="social-impact">{}</h2>', True),
        ('<h2 id="sharing">{}</h2>', True),
        ('<h2 id="consent">{}</h2>', True),
        ('<h2 class="share">{}</h2>', False),
        ('<div id="comments"><p>{}</p></div>', False),
        ('<section class="comments"><p>{}</p></section>', False),
    ],
)
def test_ids_inside_articles_are_about_the_text(part, kept):
    para = "A full paragraph, with commas, about the matter at hand. " * 3
    part = part.format("Said here, in so many words.")
    page = f"<body><nav><a>Home</a></nav><article><h1>T</h1><p>{para}</p>{part}<p>{para}</p></article></body>"
    assert html.main_text(page).split("\n") == ["T", para.strip(), *["Said here, in so many words."] * kept, para.strip()]


def test_broken_pages_take_linear_time():
    units = ["<1", "<1>", "</ ", "<a", '<a "', "<a '\">", "<div>", "<b>", "</b>", "<b><p>x", "<!--", "<!", "<![CDATA[", "<script>", "<p class='", "&#", "<div class=x>w, ", "<div>x</span>", "< ", "<title>", "<b>" * 200 + "<p>x</p>", "<i></b>", "<p a=\"'>"]
    for unit in units:
        times = []
        for n in (40_000, 320_000):
            page = unit * (n // len(unit))
            began = time.perf_counter()
            html.main_text(page)
            times.append(time.perf_counter() - began)
        assert times[1] < 24 * times[0] + 0.3, unit
    began = time.perf_counter()
    html.main_text("<a" * 1_000_000)
    html.main_text("<1" * 1_000_000 + ">")
    assert time.perf_counter() - began < 1


def test_tokens_of_a_page():
    def pieces(page):
        return [x[0] or (x[2] and ("/" if x[1] else "") + x[2] + x[3]) for x in html._pieces(page)]

    assert pieces('a<b title="x > y">c</b >d') == ["a", 'b title="x > y"', "c", "/b ", "d"]
    assert pieces("1 < 2 <b>x") == ["1 < 2 ", "b", "x"] and pieces("x <y") == ["x ", "<y"]
    assert pieces("<!-- <p> -->a<!x>b<![CDATA[c & d]]>e<?php ?>f") == ["a", "b", "c &amp; d", "e", "f"]
    assert pieces("<script>if (a<b) '</p>'</script>x<style>y") == ["script", "x", "style"]
    assert pieces('<p title="open>text</p>') == ['p title="open', "text", "/p"]


def test_path_scores_are_those_of_plain_loops(sf):
    import pyarrow.parquet as pq

    texts = [PAGE, *pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()[:40]]
    long = "A sentence, with commas. " * 20
    texts += [f"<div id=c><h1>T</h1><p>{long}</p><div class=note-box>Small, print.</div></div><div><p>{long[:60]}</p><ul><li>x</li><li>y</li></ul></div><p>{long[:90]}</p>"]
    for page in texts:
        tree = html._Page(page)
        chains = []
        for e, text in tree.blocks:
            chain = [e]
            while chain[-1]:
                chain.append(tree.parent[chain[-1]])
            chains.append((chain[::-1], text))
        label = {i: (tree.name[i], tree.path[i]) for i in range(len(tree.parent))}
        path = [tuple(label[i] for i in chain) for chain, _ in chains]

        def own(p, path=path, chains=chains):
            texts = [t for q, (_, t) in zip(path, chains, strict=True) if q == p]
            return sum(map(len, texts)) / len(texts), (sum(c in ".,;:!?\u2026" for t in texts for c in t) + 0.1) / len(texts)

        ratio = []
        for i in range(len(path)):
            near = [own(p) for p in path[max(0, i - 1) : i + 2]]
            ratio.append(sum(x for x, _ in near) / len(near) * (sum(y for _, y in near) / len(near)) ** 0.5)
        roles = tree.roles()
        size = [len(t) for _, t in chains]

        def mean(values, which, size=size):
            return sum(v * s for v, s, w in zip(values, size, which, strict=True) if w) / sum(s for s, w in zip(size, which, strict=True) if w)

        fused = [r * roles[e] for r, (e, _) in zip(ratio, tree.blocks, strict=True)]
        all_ = [True] * len(path)
        chosen = [b for b, p in zip(tree.blocks, path, strict=True) if mean(fused, [q == p for q in path]) >= 0.35 * mean(fused, all_)]
        holder, whole = tree.container(chosen)
        inside = [holder in chain for chain, _ in chains]
        want = []
        for i, (_, text) in enumerate(chains):
            side = [x == inside[i] for x in inside]
            r = mean(ratio, [p == path[i] and s for p, s in zip(path, side, strict=True)])
            best = mean(ratio, inside)
            score = (min(1, r / best) + min(1, mean(ratio, side) / best)) / 2 * (1 if inside[i] else 0.3 if whole else 0.5) * roles[tree.blocks[i][0]]
            if score >= 0.35:
                want.append(text)
        assert html.main_text(page) == "\n".join(want)
