"""Language identification by known words, backing off to shorter character n-grams.

A word that the model knows scores its log frequency in each language. An unseen word is read position by position: the longest known
n-gram that starts there, of at most four characters, gives its log frequency, less a fixed penalty for each character that it is
short of four. Frequencies are kept sparse, one entry per item and language that has it, so a column of very many languages costs no
more than its entries; penalties are the same for all languages and so drop out of every comparison.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import remainder
from .store import broadcast_if_small, discard, filter_texts, map_texts, materialize, short_batches

#: Runs of letters (general categories L); marks inside a word stay with it. Digits, fractions and letter-like numerals are no letters.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 4
BACKOFF = 1.2
#: The classifier is fitted on a bounded sample: about so many documents of each language at most, and about so many in all.
SAMPLE_PER_LANG, SAMPLE = 4_000, 64_000
SMOOTH = 0.5
#: Tables of one row per language are broadcast up to this many.
BROADCAST_LANGS = 100_000
#: Words whose scores a task keeps
_MEMO = 150_000


def _partial_counts(batches):
    """(kind, item, lang, n): words, and the n-grams of each distinct word times its count."""
    counts: dict[str, Counter] = {}
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            counts.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
    for lang, words in counts.items():
        grams: Counter = Counter()
        for word, n in words.items():
            padded = f"^{word}$"
            for k in range(1, LONGEST + 1):
                for i in range(len(padded) - k + 1):
                    grams[padded[i : i + k]] += n
        for kind, found in (("w", words), ("g", grams)) if words else ():
            yield pd.DataFrame({"kind": kind, "item": list(found), "lang": lang, "n": list(found.values())})


def gram_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` characters from each place on, up to the last place that has as many."""
    n = len(code) - k + 1
    h = np.full(max(n, 0), k, np.uint64)
    for i in range(k):
        h = (h + code[i : i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of spans, one span after the other."""
    end = np.cumsum(length)
    return np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)


class Table:
    """Items of one kind, each with the languages that have it and what its log frequency there exceeds that of an unseen item by."""

    def __init__(self, n_langs: int, items: list[str], item: np.ndarray, lang: np.ndarray, n: np.ndarray):
        """``item``, ``lang`` and ``n`` are the numbers of items and languages, and the counts, of all entries in any order."""
        order = np.lexsort((lang, item))
        self.items, self.lang, n = items, np.asarray(lang, np.int32)[order], np.asarray(n, np.float64)[order]
        self.length = np.bincount(item, minlength=len(items))
        self.start = np.cumsum(self.length) - self.length
        #: log frequency of an unseen item by language
        self.floor = np.log(SMOOTH / (np.bincount(self.lang, n, n_langs) + SMOOTH * len(items) + SMOOTH))
        self.gain = np.log((n + SMOOTH) / SMOOTH).astype(np.float32)


class Model:
    """Languages in code-point order, known words, and n-grams by sorted hash."""

    def __init__(self, langs: list[str], words: Table, grams: Table):
        self.langs, self.words, self.grams = langs, words, grams
        keys = np.array([gram_hashes(_codes(g), len(g))[0] for g in grams.items], np.uint64)
        self.gram_order = np.argsort(keys)
        self.gram_keys = keys[self.gram_order]


def _sampled(known: DataFrame, per_lang: int, most: int) -> DataFrame:
    """(lang, text) of a bounded sample, by a hash of id and text; a row that is repeated counts once."""
    sizes = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-sizes")
    wanted = sizes.agg(F.sum(F.least("n", F.lit(per_lang)))).first()[0] or 1
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n")) * min(1.0, most / wanted)
    bars = broadcast_if_small(sizes.select("lang", share.alias("bar")), BROADCAST_LANGS)
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("lang")), F.lit(1 << 31)) / float(1 << 31)
    some = known.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).join(bars, "lang").where(spot < F.col("bar"))
    return some.select("doc_id", "lang", "text").dropDuplicates().select("lang", "text")


def train(docs: DataFrame, held_out: tuple[int, int] = (4, 2), per_lang: int = SAMPLE_PER_LANG, most: int = SAMPLE) -> Model:
    """Learn from documents with a language, outside the held-out remainder, at most about ``per_lang`` of each language and ``most`` in
    all. Every word and n-gram of that sample is kept. Null texts count as empty; a document with a null id is not learnt from.
    """
    modulus, rest = held_out
    known = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), modulus) != rest))
    short_batches(docs.sparkSession)
    sample = materialize(_sampled(known, per_lang, most), "langid-sample")
    counts = sample.mapInPandas(_partial_counts, "kind string, item string, lang string, n long").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "langid-counts")  # what the sample holds, at most
    langs = sorted((r["lang"] for r in sample.select("lang").distinct().collect()), key=lambda x: x.encode("utf-8", "surrogatepass"))
    tables = []
    for kind in "wg":
        rows = counts.where(F.col("kind") == kind).select("item", "lang", "n").toArrow()
        item, lang = (rows.column(c).combine_chunks().dictionary_encode() for c in ("item", "lang"))
        at = {k: i for i, k in enumerate(langs)}
        number = np.array([at[k] for k in lang.dictionary.to_pylist()], np.int64)
        tables.append(Table(len(langs), item.dictionary.to_pylist(), item.indices.to_numpy(), number[lang.indices.to_numpy()], rows.column("n").to_numpy()))
    discard(sample)
    discard(counts)
    return Model(langs, *tables)


class Scores:
    """word -> its languages and gains. Unseen words are scored some thousand at a time, and kept while there is room."""

    def __init__(self, model: Model):
        self.model = model
        self.n = max(1, len(model.langs))
        self.forget()

    def forget(self) -> None:
        words = self.model.words
        self.ids = {w: i for i, w in enumerate(words.items)}
        self.known = len(self.ids)
        self.start, self.length, self.lang, self.gain = words.start, words.length, words.lang, words.gain

    def add(self, words: list[str]) -> None:
        length, lang, gain = self.unseen(words)
        self.ids.update(zip(words, range(len(self.ids), len(self.ids) + len(words)), strict=True))
        self.start = np.append(self.start, len(self.lang) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.lang, self.gain = np.append(self.lang, lang), np.append(self.gain, gain)

    def unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of each word, their languages and gains: the mean over a word's places, its mark of beginning included, of the longest
        known n-gram from there on; doubled, since n-grams overlap and say less than words do."""
        grams, keys = self.model.grams, self.model.gram_keys
        code = _codes("".join(f"^{w}$" for w in words))
        length = np.array([len(w) + 2 for w in words])
        owner = np.repeat(np.arange(len(words)), length)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # characters from a place to its word's end
        open_ = left > 1
        places, items = [], []
        for k in range(LONGEST, 0, -1) if len(keys) else ():
            at = np.flatnonzero(open_ & (left >= k))
            wanted = gram_hashes(code, k)[at]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[place] == wanted
            places.append(at[hit])
            items.append(self.model.gram_order[place[hit]])
            open_[at[hit]] = False
        item = np.concatenate(items) if items else np.empty(0, np.int64)
        word = owner[np.concatenate(places)] if places else np.empty(0, np.int64)
        entry = _spans(grams.start[item], grams.length[item])
        key = np.repeat(word, grams.length[item]) * self.n + grams.lang[entry]
        key, group = np.unique(key, return_inverse=True)
        word, lang = key // self.n, (key % self.n).astype(np.int32)
        gain = np.bincount(group, grams.gain[entry], len(key)) * 2 / (length[word] - 1)
        return np.bincount(word, minlength=len(words)), lang, gain.astype(np.float32)

    def mean(self, words: list[str]) -> np.ndarray:
        """Mean score of the words by language, short of what all languages lose alike."""
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        entry = _spans(self.start[ids], self.length[ids])
        total = np.bincount(self.lang[entry], self.gain[entry], self.n)
        unseen = int((ids >= self.known).sum())
        return (total + (len(ids) - unseen) * self.model.words.floor + 2 * unseen * self.model.grams.floor) / len(ids)


def classify(model: Model, texts, memo: Scores) -> tuple[list[str], list[float]]:
    """The best language and its share of the odds, by text; ``memo`` keeps the scores of words between calls."""
    best, sure = [], []
    texts = list(texts)
    for begin in range(0, len(texts), 64):
        if len(memo.ids) > memo.known + _MEMO:
            memo.forget()
        words = [WORDS.findall(t.lower()) if t else [] for t in texts[begin : begin + 64]]
        if unseen := list(set().union(*words).difference(memo.ids)) if model.langs else []:
            memo.add(unseen)
        for own in words:
            if not own or not model.langs:
                best.append("und")
                sure.append(0.0)
                continue
            mean = memo.mean(own)
            odds = np.exp((mean - mean.max()) * min(len(own), 25))
            top = int(mean.argmax())
            best.append(model.langs[top])
            sure.append(float(odds[top] / odds.sum()))
    return best, sure


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every document's whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learnt. Ties go to the language that comes first by
    code point. A text is read in lower case. Repeated rows are scored alike; a null id is kept; an empty table gives an empty result. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the entries of a bounded sample

    def score(batches):
        memo = Scores(shared.value)
        for pdf in batches:
            best, sure = classify(shared.value, pdf.pop("text"), memo)
            yield pdf.assign(lang_pred=best, score=sure)

    return map_texts(docs, score, "lang_pred string, score double", "doc_id", "text")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, all columns, whose language is told with at least the given score; texts without letters go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide():
        memo = Scores(shared.value)
        return lambda texts: [lang != "und" and sure >= least for lang, sure in zip(*classify(shared.value, texts, memo), strict=True)]

    return filter_texts(docs, decide)
