"""Licence scans against plain searches."""

import random
import re

import numpy as np
import pytest

from marketlens.llm import licenses as lic
from .odd import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(text, phrases=lic.PHRASES):
    got = words(text)
    return sorted((i, label) for phrase, label in phrases.items() for i in range(len(got)) if got[i : i + len(p := phrase.split())] == p)


def test_longest_runs_by_brute_force():
    rng = random.Random(3)
    templates = [[rng.randint(1, 4) for _ in range(rng.randint(3, 14))] for _ in range(5)]
    automaton = lic.Automaton(templates)
    for _ in range(60):
        text = [rng.randint(0, 4) for _ in range(40)]
        runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i, len(t) + 1)}
        for i, (_, length) in enumerate(automaton.statistics(text)):
            assert length == max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in runs)


def test_matches_by_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        templates = [[rng.randint(1, 3) for _ in range(rng.randint(4, 16))] for _ in range(4)]
        text = [rng.randint(1, 3) for _ in range(40)]
        found: dict = {}
        lic.Automaton(templates).matches(text, 100, found)
        for n, t in enumerate(templates):
            want = set()
            for end in range(1, len(text) + 1):
                most = max(k for k in range(end + 1) if any(t[e - k : e] == text[end - k : end] for e in range(k, len(t) + 1)))
                if most >= lic.LEAST:
                    for e in range(most, len(t) + 1):
                        if t[e - most : e] == text[end - most : end] and not (e < len(t) and end < len(text) and t[e] == text[end]):
                            want.add((100 + end, e, most))
            assert set(found.get(n, [])) == want and len(found.get(n, [])) == len(want)


def test_best_chains_by_brute_force():
    rng = random.Random(5)
    for _ in range(100):
        matches = sorted(lic.Match(rng.randint(5, 40), rng.randint(5, 30), rng.randint(2, 5)) for _ in range(9))

        def value(chain):
            """Words covered, or None if some match does not follow the one before."""
            total = chain[0].length
            for p, m in zip(chain, chain[1:]):
                if not (p.end < m.end and p.at < m.at and m.end - m.length - p.end <= 4 and m.at - m.length - p.at <= 4):
                    return None
                total += min(m.length, m.end - p.end, m.at - p.at)
            return total

        best: dict[int, int] = {}
        for mask in range(1, 1 << len(matches)):
            chain = [m for i, m in enumerate(matches) if mask >> i & 1]
            if (v := value(chain)) is not None:
                last = mask.bit_length() - 1
                best[last] = max(best.get(last, 0), v)
        assert [c for _, _, c in lic.chains(matches, gap=4)] == [best[i] for i in range(len(matches))]


MIT = lic.TEMPLATES["mit"][2]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", ["mit"]),
        ("see: Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]),
        ("blah " * 50 + MIT + " blah" * 50, ["mit"]),
        (MIT.replace("copies of the Software", "copies of this fine Software").replace("free of charge", "entirely free of any charge"), ["mit"]),
        (MIT[: len(MIT) // 2], []),
        (MIT + " and " + lic.TEMPLATES["isc"][0], ["isc", "mit"]),
        (lic.TEMPLATES["bsd-3-clause"][0], ["bsd-3-clause"]),
        (lic.TEMPLATES["bsd-2-clause"][0], ["bsd-2-clause"]),
        ("the software is provided to the public and the rights to use it are granted", []),
        ("a license is a license and the software is the software", []),
    ],
)
def test_spans_of_notices(text, labels):
    scanner = lic.Scanner()
    assert sorted({s.label for s in scanner.spans(scanner.words(text))}) == labels


def test_span_places():
    scanner = lic.Scanner()
    text = "one two three " + MIT + " four five"
    n = len(words(MIT))
    (span,) = scanner.spans(scanner.words(text))
    assert span == lic.Span("mit", 3, 3 + n - 1, n, 1.0)


def test_words_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(lic, "PIECE", 7)
    text = "Released under\tthe MIT License; été naïve 2.0 " + "x" * 30 + " the mit license"
    scanner = lic.Scanner()
    got = scanner.words(text)
    assert got.tolist() == [scanner.numbers.get(w.encode(), 0) for w in words(text)]
    assert scanner.named(got) == places(text)


def test_texts_with_very_many_notices():
    scanner = lic.Scanner()
    one = lic.TEMPLATES["gpl-3.0"][1] + " zebra " * 20
    spans = scanner.spans(scanner.words(one * 500))
    assert len(spans) == 500 and {s.label for s in spans} == {"gpl-3.0"}


def test_odd_rows_and_places(spark):
    more = [(20, "MIT License mit  license, Apache-License GNU general public license mit license"), (21, "mit x license"), (22, "emit license")]
    docs = documents(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = lic.scan(docs).collect()
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    want = []
    for r in docs.collect():
        at = places(r["text"])
        want.append((repr(r["doc_id"]), len(words(r["text"])), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=repr) or sorted(got, key=repr) == sorted(want, key=repr)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert r["score"] >= lic.NAMED or not r["n_base"]
    assert lic.scan(docs.limit(0)).collect() == []


def test_base_columns_against_sql(spark, sf):
    import duckdb

    sql = rf"""
        SELECT doc_id, len(w)::BIGINT AS n_words, len(list_filter(range(1, len(w) + 1), lambda i: w[i:i+1] = ['mit', 'license'] OR w[i:i+1] = ['apache', 'license'] OR w[i:i+2] = ['general', 'public', 'license']))::BIGINT AS n_base
        FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM '{sf}/documents.parquet')"""
    got = lic.scan(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_words", "n_base").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def test_words_are_numbers_of_four_bytes():
    assert lic.Scanner().words("x " * 10).dtype == np.int32
