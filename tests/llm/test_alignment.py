"""Cross-tokenizer alignment against plain loops over both libraries' own encodings."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from marketlens.llm import alignment as al
from marketlens.llm import shards
from .odd import documents

ODD = [
    "  two  spaces ", "tab\t x\n  y \n z", "\x1c a\x1c b", "<s> </s> <|endoftext|> x", "▁ a", "a▁", "é́ ﬁ ½ ①", "\x00 nul\x00", "﻿bom", "emoji 😀 x", " 　  x   y",
    "\r\n \r\n", "don't I'll 'S", "   ", "\n", " ", "a" * 3000, "١٢٣ x", "<0x41> y", "a \n b", "x\t y ", "q   r \u0085 s", "日本語 の テキスト", "a ", "a\n ", "a  \n  ",
]


@pytest.fixture(scope="module")
def both():
    return al.Tokenizers(Path(al.BYTE_BPE).read_text(), Path(al.PIECES).read_bytes())


@pytest.fixture(scope="module")
def whole(both):
    """Whole texts encoded at once by the libraries: two lists of (id, first byte, end)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(al.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=al.PIECES)
    a.encode_special_tokens = True

    def run(text):
        if not text:
            return [], []
        data, out = (" " + text).encode(), []
        for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes), (b.encode(text), both.b_bytes)):
            if b"".join(table[i] for i in ids) != data:
                return [], []
            at, tokens = 0, []
            for i in ids:
                tokens.append((i, at, at + len(table[i])))
                at += len(table[i])
            out.append(tokens)
        return out

    return run


def plain(rows, whole):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row, by comparing all tokens of a text with each other."""
    cut, counts = [], Counter()
    for _, text in rows:
        a, b = whole(text)
        links = [(x, y) for x, i, j in a for y, k, m in b if i < m and k < j]
        counts.update(links)
        ends = sorted({j for _, _, j in a} & {m for _, _, m in b})
        groups = [",".join(str(x) for x, i, j in a if lo < j <= hi) + "|" + ",".join(str(y) for y, k, m in b if lo < m <= hi) for lo, hi in zip([0, *ends], ends)]
        cut.append((a, b, links, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (repr(id_), len(a), len(b), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for (id_, _), (a, b, links, g) in zip(rows, cut, strict=True)
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_encodings_are_those_of_both_libraries(both, whole, sf):
    import duckdb

    texts = ODD + [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' WHERE length(text) < 20000").fetchall()]
    for text, a, b in zip(texts, *both.encode(texts), strict=True):
        assert [np.frombuffer(x, np.int32).tolist() for x in (a, b)] == [[t[0] for t in x] for x in whole(text)], text[:60]


def test_random_texts_have_the_ids_of_the_library(both):
    import random

    from tokenizers import Tokenizer

    a, rng = Tokenizer.from_file(al.BYTE_BPE), random.Random(2)
    a.encode_special_tokens = True
    alphabets = ["etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(1, 0x250))), "0123456789.,'s t\n", "日本語한국어العربيةкири"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(2, 14))) for letters in alphabets for _ in range(3000)]
    own = a.encode_batch([" " + t for t in texts], add_special_tokens=False)
    got = [np.frombuffer(x, np.int32).tolist() for x in both.encode(texts)[0]]
    assert sum(bool(g) for g in got) > len(texts) // 2 and all(g in ([], e.ids) for g, e in zip(got, own, strict=True))


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "\n \n" * 100_000, "ab " * 200_000, "é" * 200_000])
def test_long_runs(both, text):
    a, b = both.encode([text])
    for packed, table in ((a[0], both.a_bytes), (b[0], both.b_bytes)):
        assert b"".join(table[i] for i in np.frombuffer(packed, np.int32)) == (" " + text).encode()


def test_files_of_another_kind_are_refused():
    import json

    file = json.loads(Path(al.BYTE_BPE).read_text())
    file["model"]["merges"] = file["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        al.Tokenizers(json.dumps(file), Path(al.PIECES).read_bytes())


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_loops(spark, whole, monkeypatch, small):
    if small:  # blocks of one text, and partial counts passed on again and again
        for name, value in (("BLOCK", 50), ("GATHER", 20), ("HOLD", 10)):
            monkeypatch.setattr(al, name, value)
    rows = [(r["doc_id"], r["text"] if len(r["text"] or "") < 10_000 else None) for r in documents(spark).collect()]
    rows += [(100 + i, t[:400]) for i, t in enumerate(ODD)] + [(200 + i, "the cat sat on the mat " * 3) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((repr(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in al.align(docs).collect())
    assert got == sorted(plain(rows, whole))


def test_very_long_texts_and_empty_tables(spark):
    docs = documents(spark)
    rows = al.align(docs).collect()
    assert len(rows) == docs.count() and max(r["n_a"] for r in rows) > 60_000
    assert al.align(docs.limit(0)).collect() == []
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r["doc_id"]) for r in docs.collect())


def test_shards_hold_each_key_once(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    keys = [(k % 1000 << 20, k % 7 + 1) for k in range(20_000)]
    partial = spark.createDataFrame(keys, "key long, n long").repartition(6)
    table = al.write_shards(partial, str(tmp_path / "shards")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = Counter()
    for k, n in keys:
        want[k] += n
    found = shards.Table(sorted((r["first"], r["path"]) for r in table))
    asked = np.array(sorted([*want, -5, 7, 1 << 60]), np.int64)
    assert found.find(asked).tolist() == [want[k] for k in asked.tolist()]
    assert len(table) > 1 and isinstance(found.open[0][0], np.memmap)
    assert sum(len(found.open[i][0]) for i in found.open) == len(want)
    top: dict = {}
    for k, n in want.items():
        top[k >> 32] = max(top.get(k >> 32, 0), n)
    best: dict = {}
    for r in table:
        for b, n in zip(r["b"], r["best"], strict=True):
            best[b] = max(best.get(b, 0), n)
    assert best == top
