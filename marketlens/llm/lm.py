"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Every frequent word is a path of four digits: its class, then three digits inside the class, so
P(word | history) = P(class | history) * P(digit 1 | class, history) * P(digit 2 | ...) * P(digit 3 | ...). Each factor is a softmax over
a bias and a sum of rows of hashed tables, one row for each feature of the history: the previous word, the word before it alone (a skip),
and for the first two factors both together, each among the rows of the digits chosen so far. Classes come from the words' neighbours: words that stand
beside the same very frequent words share a class. Words that are not frequent share one class, inside which a word has its smoothed
relative frequency, so every text has a probability above 0.

Word counts are exact and cover every training document; they set the biases. Weights come from distributed gradient updates over every
training document. In the first, at the biases, partitions sum what was observed of each table row and output, which less what the biases expect there is the
gradient of the log likelihood, and each weight moves along it as far as the logarithm of observed over expected, damped. Every row
belongs to one node, a word's digits so far, so what biases expect of it is known without a second pass. Each further update evaluates the
softmax of the model so far for every training token, once for all those of a batch that share history and node, and sums up what it
expects of each row and output. Sums of observed counts are exact,
those of expected ones but for rounding: the model is the same on any number of partitions. Texts are encoded once, into a written table of token arrays, which all passes after it read in batches.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .splits import remainder
from .store import map_texts, materialize, most_frequent, short_batches
from .training import sum_vectors

END = b""
#: The most frequent words, at most: those that have classes, and whose counts are broadcast. The counts of the rest are joined.
HEAD = 200_000
#: Classes by neighbours; digits of a word inside its class, and their base. A class holds WIDTH ** DIGITS words; what is over, and
#: words with too few neighbours, fill more classes by frequency.
CLASSES, DIGITS, WIDTH = 32, 3, 19
#: Rows of each factor's table: four times as many as there are distinct words, up to this many bits, dealt to the factor's nodes by their
#: share of all tokens.
MOST_BITS = 16
#: Very frequent words that tell classes apart, each before and after a word, at a distance of one or two.
MARKS = 32
#: Weight of a feature's row: previous word, skip, both; and examples by which a row's update is damped.
SHARES, DAMP = (0.9, 0.6, 0.3), 30.0
SMOOTH = 0.1
_CHUNK = 4_096
#: Tokens that are sorted by their contexts together, and those of which contexts are evaluated together.
_SORTED, _TOGETHER = 1 << 21, 1 << 17
#: Tokens of a task that sums, about: its vector is as long whatever it saw, so what is shuffled stays a small part of the input.
TASK_TOKENS = 16_000_000
_FLUSH = 400_000
_CHARACTERS = 1_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def _some(texts):
    """Slices of the texts, or of encoded ones, each of some million characters or bytes or of one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held > _CHARACTERS:
            yield slice(start, i)
            start, held = i, 0
        held += len(text or "") + 64
    yield slice(start, len(texts))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all documents' tokens; the end's word is empty."""

    def count(batches):
        counts: Counter = Counter()

        def rows():
            return pd.DataFrame({"word": list(counts), "c": list(counts.values())})

        for pdf in batches:
            for text in pdf["text"]:
                counts.update(tokens(text))
                if len(counts) > _FLUSH:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.select("text").mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """Counts of the head, its words' digits, biases, and the tables of weights."""

    def __init__(self, head: list[bytes], counts: np.ndarray, total: int, distinct: int, classes: np.ndarray | None = None):
        self.total, self.distinct, self.counts = total, distinct, np.asarray(counts, np.int64)
        self.ids, self.n = {w: i for i, w in enumerate(head)}, len(head)
        self.base_bulk = np.log10(total + SMOOTH * (distinct + 1))
        self.log_count = np.log10(np.append(self.counts, 0) + SMOOTH)  # last: not in the head
        others, kinds = total - int(self.counts.sum()), distinct - len(head)
        self.rare_mass = others + SMOOTH * (kinds + 1)
        self.rare_bulk = np.log10(self.rare_mass)
        self.bits = min(MOST_BITS, 2 + math.ceil(math.log2(distinct + 2)))
        self.arrange(np.zeros(len(head), np.int64) if classes is None else classes)

    def arrange(self, classes: np.ndarray) -> None:
        """Give every word its digits, by frequency inside its class; -1 is no class. Weights start at 0."""
        n, room = self.n, WIDTH**DIGITS
        classes = classes.copy()

        def places():
            order = np.lexsort((np.arange(n), classes))
            out = np.empty(n, np.int64)
            out[order] = np.arange(n) - np.searchsorted(classes[order], classes[order])
            return out

        over = np.flatnonzero((classes < 0) | (places() >= room))
        classes[over] = classes.max(initial=-1) + 1 + np.arange(len(over)) // room
        _, classes = np.unique(classes, return_inverse=True)
        place = places()
        self.classes = int(classes.max(initial=-1)) + 1
        self.outs = [self.classes + 1] + [WIDTH] * DIGITS
        self.digit = np.zeros((1 + DIGITS, n + 1), np.int64)
        self.digit[0] = np.append(classes, self.classes)
        for d in range(DIGITS):
            self.digit[1 + d, :n] = place // WIDTH ** (DIGITS - 1 - d) % WIDTH
        #: the node of each factor that a word's path passes; each node's biases, and its own rows of the factor's table
        self.node, self.bias, self.first_row, self.n_rows = np.zeros((1 + DIGITS, n + 1), np.int64), [], [], []
        mass = np.append(self.counts.astype(np.float64), self.rare_mass)
        for level, outs in enumerate(self.outs):
            if level:
                _, self.node[level] = np.unique(self.node[level - 1] * max(self.outs) + self.digit[level - 1], return_inverse=True)
            sums = np.zeros((int(self.node[level].max()) + 1, outs))
            np.add.at(sums, (self.node[level], self.digit[level]), mass)
            of_node = sums.sum(1)
            with np.errstate(divide="ignore"):
                bias = np.log(sums / of_node[:, None])
            self.bias.append(np.maximum(bias, -1e9).astype(np.float32))
            self.n_rows.append(np.maximum(of_node / of_node.sum() * (1 << self.bits), 1).astype(np.int64))
            self.first_row.append(np.cumsum(self.n_rows[-1]) - self.n_rows[-1])
        self.tables = [np.zeros((int(rows.sum()), outs), np.float32) for rows, outs in zip(self.n_rows, self.outs, strict=True)]

    def encode(self, texts, words: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts' tokens (the head's length where unknown) and each text's first position; the words go into ``words``."""
        ids, starts, get, none = [], [], self.ids.get, repeat(len(self.ids))
        for text in texts:
            own = tokens(text)
            starts.append(len(ids))
            ids.extend(map(get, own, none))
            if words is not None:
                words += own
        return np.array(ids, np.int64), np.array(starts, np.int64)


def _history(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the one before that, shifted by two; 0 and 1 stand before the first word."""
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:], two[2:] = ids[:-1] + 2, ids[:-2] + 2
    one[first] = 0
    two[first] = 0
    after = first + 1
    two[after[after < len(ids)]] = 1
    two[first] = 0
    return one, two


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of 31 bits."""
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def _hashes(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """The features of a history: previous word, skip, and both together."""
    return [_hash(one, 1 << 40), _hash(two, 1 << 41), _hash(one * 1_000_003 + two, 1 << 42)]


def _features(model: Model, hashes: list[np.ndarray], node: np.ndarray, level: int) -> list[np.ndarray]:
    """Rows of a factor's table, of those that belong to the node, by the features; the first two factors have all three, the others two."""
    first, n = model.first_row[level][node], model.n_rows[level][node]
    return [first + (h * n >> 31) for h in hashes[: 3 if level < 2 else 2]]


def _parts(model: Model, ids: np.ndarray, first: np.ndarray):
    """(positions, level, nodes, features, digits) of the tokens, some thousand at a time; words that are not in the head have one level."""
    one, two = _history(ids, first)
    for start in range(0, len(ids), _CHUNK):
        at = np.arange(start, min(start + _CHUNK, len(ids)))
        hashes = _hashes(one[at], two[at])
        for level in range(1 + DIGITS):
            if level == 1:
                known = ids[at] < model.n
                at, hashes = at[known], [h[known] for h in hashes]
            x = ids[at]
            node = model.node[level][x]
            yield at, level, node, _features(model, hashes, node, level), model.digit[level][x]


def _in_order(model: Model, ids: np.ndarray, first: np.ndarray):
    """(positions, histories' words before, the ones before that, words) of the tokens, some million at a time, in the order of history and
    then of the word's path, so that tokens of one history and node stand together at every factor."""
    one, two = _history(ids, first)
    n = model.n
    word_at = np.lexsort(model.digit[::-1])
    place = np.empty_like(word_at)
    place[word_at] = np.arange(n + 1)
    for start in range(0, len(ids), _SORTED):
        at = slice(start, start + _SORTED)
        key = (one[at] * (n + 3) + two[at]) * (n + 1) + place[ids[at]]
        order = np.argsort(key)
        yield start + order, one[at][order], two[at][order], ids[at][order]


def _contexts(model: Model, one: np.ndarray, two: np.ndarray, word: np.ndarray):
    """(positions, counts, level, nodes, features, digits) of tokens in order: distinct histories and nodes, some thousand at a time, and their
    tokens. Each has so many of the positions and digits as its count says, one after the other; words that are not in the head have one
    level."""
    for start in range(0, len(word), _TOGETHER):
        at = np.arange(start, min(start + _TOGETHER, len(word)))
        o, t, x = one[at], two[at], word[at]
        new = np.append(True, (o[1:] != o[:-1]) | (t[1:] != t[:-1]))
        history, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        hashes = _hashes(o[begin], t[begin])
        for level in range(1 + DIGITS):
            if level == 1:  # what is not in the head stands last in its history
                known = np.flatnonzero(x < model.n)
                at, x, new, history = at[known], x[known], new[known], history[known]
                if not len(x):
                    break
            begin = np.flatnonzero(new)
            node, digit = model.node[level][x[begin]], model.digit[level][x]
            features = _features(model, [h[history[begin]] for h in hashes[: 3 if level < 2 else 2]], node, level)
            yield at, np.diff(np.append(begin, len(x))), level, node, features, digit
            new[1:] |= digit[1:] != digit[:-1]


def _logits(model: Model, level: int, node: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """A factor's bias and weighted rows. Biases are logarithms of shares and weights small, so no exponential overflows."""
    logits = model.bias[level].take(node, 0)
    for share, rows in zip(SHARES, features, strict=False):
        weights = model.tables[level].take(rows, 0)
        weights *= np.float32(share)
        logits += weights
    return logits


def _softmax_parts(model: Model, level: int, node: np.ndarray, features: list[np.ndarray]):
    """(slice of the contexts, logits) of some thousand contexts at a time, which stay in the processor's cache."""
    for start in range(0, len(node), _CHUNK):
        some = slice(start, start + _CHUNK)
        yield some, _logits(model, level, node[some], [rows[some] for rows in features])


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of rows, by a product, which is quicker than a sum along short rows."""
    return rows @ np.ones(rows.shape[1], rows.dtype)


def log10_model(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 P(token | history); for words that are not in the head, of their class alone."""
    out = np.zeros(len(ids))
    for order, *sorted_ in _in_order(model, ids, first):
        told = np.zeros(len(order))
        for at, count, level, node, features, digit in _contexts(model, *sorted_):
            ends = np.append(0, np.cumsum(count))
            own, bulk = np.empty(len(at), np.float32), np.empty(len(node), np.float32)
            for some, logits in _softmax_parts(model, level, node, features):
                part = slice(ends[some.start], ends[some.start + len(logits)])
                place = np.repeat(np.arange(0, logits.size, logits.shape[1]), count[some])
                place += digit[part]
                logits.reshape(-1).take(place, out=own[part], mode="clip")
                bulk[some] = _sums(np.exp(logits, out=logits))
            told[at] += own - np.repeat(np.log(bulk.astype(np.float64)), count)
        out[order] = told
    return out / math.log(10)


def observe(model: Model, ids: np.ndarray, first: np.ndarray, observed: list[np.ndarray]) -> None:
    """Add, for each factor's table, how often each output followed each row's feature."""
    for _, level, _, features, digit in _parts(model, ids, first):
        for rows in features:
            np.add.at(observed[level].reshape(-1), rows * model.outs[level] + digit, np.float32(1))


def expect(model: Model, ids: np.ndarray, first: np.ndarray, expected: list[np.ndarray]) -> None:
    """Add, for each factor's table, how often the model's softmax lets each output follow each row's feature. Each distinct history and
    node is evaluated once for all its tokens; sums are made by output, and quicker where outputs of ``expected`` are columns in memory."""
    for _, *sorted_ in _in_order(model, ids, first):
        for _, count, level, node, features, _ in _contexts(model, *sorted_):
            p = np.empty((model.outs[level], len(node)), np.float32)
            for some, e in _softmax_parts(model, level, node, features):
                np.exp(e, out=e)
                e *= (count[some] / _sums(e)).astype(np.float32)[:, None]
                p[:, some] = e.T
            own = np.empty(len(expected[level]), np.float32)
            for of_output, total in zip(p, expected[level].T, strict=True):
                own.fill(0)  # one output's sums fit the cache
                for rows in features:
                    np.add.at(own, rows, of_output)
                total += own


def _arrays(encoded) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of encoded texts, one after the other, and where each text begins."""
    ids = np.frombuffer(b"".join(encoded), np.int32).astype(np.int64)
    ends = np.cumsum([len(x) // 4 for x in encoded])
    return ids, np.append(0, ends[:-1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)


def _gathered(batches):
    """Rows with encoded texts, so many together that their contexts are sorted together, or those of one text."""
    held, size = [], 0
    for pdf in batches:
        for part in _some(pdf["ids"]):
            some = pdf.iloc[part]
            more = int(some["ids"].map(len).sum()) // 4
            if held and size + more > _SORTED:
                yield pd.concat(held)
                held, size = [], 0
            held.append(some)
            size += more
    if held:
        yield pd.concat(held)


def update(model: Model, observed: list[np.ndarray]) -> None:
    """Move each weight along the gradient at the biases, observed less expected, as far as the logarithm of observed over expected, both
    with DAMP more examples as expected. A row belongs to one node, whose biases say what is expected of it."""
    for table, bias, rows, o in zip(model.tables, model.bias, model.n_rows, observed, strict=True):
        p = np.repeat(np.exp(bias), rows, axis=0)
        n = o.sum(1, keepdims=True)
        table += np.log(np.where(p > 0, o + DAMP * p, 1) / np.where(p > 0, (n + DAMP) * p, 1))


def follow(model: Model, observed: list[np.ndarray], expected: list[np.ndarray]) -> None:
    """Move each weight along the gradient at the model, observed less expected by its softmax, as far as the logarithm of observed over
    expected, both with DAMP examples as biases expect them, over the sum of a history's shares. Undamped, that step of iterative scaling
    never lowers the likelihood."""
    for level, (table, bias, rows, o, e) in enumerate(zip(model.tables, model.bias, model.n_rows, observed, expected, strict=True)):
        p = DAMP * np.repeat(np.exp(bias), rows, axis=0)
        table += np.log(np.where(p > 0, o + p, 1) / np.where(p > 0, e + p, 1)) / np.float32(sum(SHARES[: 3 if level < 2 else 2]))


def _over(train: DataFrame, model: Model, add, size: int, kind=np.float32) -> np.ndarray:
    """The sum of what ``add(model, ids, first, total)`` adds to a flat table, of numbers of that kind, over all encoded texts (ids). Files
    are read by no more tasks than their tokens ask for, in whole rounds of those that run at once: each task shuffles a whole table."""
    context = train.sparkSession.sparkContext
    shared = context.broadcast(model)
    tasks = context.defaultParallelism * max(1, math.ceil(model.total / TASK_TOKENS / context.defaultParallelism))

    def sums(batches):
        total = np.zeros(size, kind)
        for some in _gathered(batches):
            add(shared.value, *_arrays(some["ids"]), total)
        return total

    out = sum_vectors(train.select("ids").coalesce(tasks), sums, size)
    shared.destroy()
    return out


def fit(train: DataFrame, model: Model, passes: int = 0) -> None:
    """The first update, at the biases, and ``passes`` more at the model's own softmax, each from sums over every training document, which
    are encoded (ids)."""
    sizes = [t.size for t in model.tables]

    def over(add, kind, order):
        def tables(model, total):  # parts of the vector itself
            parts = np.split(total, np.cumsum(sizes)[:-1])
            return [x.reshape(t.shape, order=order) for x, t in zip(parts, model.tables, strict=True)]

        def split(model, ids, first, total):
            add(model, ids, first, tables(model, total))

        return tables(model, _over(train, model, split, sum(sizes), kind))

    observed = over(observe, np.float32, "C")
    update(model, observed)
    for _ in range(passes):
        follow(model, observed, over(expect, np.float64, "F"))  # sums of shares


def beside(model: Model, ids: np.ndarray, first: np.ndarray, total: np.ndarray) -> None:
    """Add to a flat table, by word of the head, how often the MARKS most frequent words stand within two words before and after it."""
    text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    n = model.n
    for distance in (1, 2):
        a, b, same = ids[:-distance], ids[distance:], text[:-distance] == text[distance:]
        at = np.flatnonzero(same & (a < MARKS) & (b < n))
        np.add.at(total, b[at] * 2 * MARKS + a[at], np.float32(1))
        at = np.flatnonzero(same & (b < MARKS) & (a < n))
        np.add.at(total, a[at] * 2 * MARKS + MARKS + b[at], np.float32(1))


def neighbours(train: DataFrame, model: Model) -> np.ndarray:
    """The sums of ``beside`` over every training document: words by marks before and after."""
    return _over(train, model, beside, model.n * 2 * MARKS).reshape(model.n, 2 * MARKS)


def word_classes(near: np.ndarray, counts: np.ndarray, rounds: int = 12) -> np.ndarray:
    """CLASSES groups of words by k-means over square roots of their neighbours' shares; -1 for a word with fewer than two neighbours.

    Centres come from the 20,000 most frequent words.
    """
    total = near.sum(1, keepdims=True)
    mean = near.sum(0) / max(1.0, float(near.sum()))
    points = np.sqrt((near + 10 * mean) / (total + 10)) - np.sqrt(mean)
    top = points[:20_000]
    weight = np.sqrt(np.minimum(counts[:20_000], 1000.0)).astype(np.float32)
    centres = top[np.random.default_rng(0).permutation(min(len(top), 2_000))[:CLASSES]]
    for _ in range(rounds if len(top) else 0):
        of = ((centres**2).sum(1) - 2 * top @ centres.T).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(of, weight, len(centres))
        np.add.at(sums, of, top * weight[:, None])
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-9)[:, None], centres).astype(np.float32)
    if not len(top):
        return np.zeros(0, np.int64)
    return np.where(total[:, 0] < 2, -1, ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1))


def _encode(shared):
    """Per document its tokens as word numbers and its sums over those of the head; per document and other word a row with its number."""

    def run(batches):
        model = shared.value
        uid = TaskContext.get().partitionId() << 36
        for pdf in batches:
            for some in _some(pdf["text"]):
                part = pdf.iloc[some]
                words: list[bytes] = []
                ids, first = model.encode(part["text"], words)
                ends = np.append(first[1:], len(ids))
                own = np.repeat(np.arange(len(part)), ends - first)
                tail = ids == model.n
                base = np.where(tail, 0.0, model.log_count[ids] - model.base_bulk)
                packed = ids.astype(np.int32)

                def by_doc(x, own=own, n=len(part)):
                    return np.bincount(own, x, n)

                yield pd.DataFrame({
                    "uid": uid + np.arange(len(part)), "doc_id": part["doc_id"].to_numpy(), "n_tokens": ends - first, "n_known": by_doc(~tail).astype(np.int64), "base": by_doc(base),
                    "ids": [packed[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], "word": None, "n": 0,
                })
                at = np.flatnonzero(tail)
                if len(at):
                    seen = Counter(zip(own[at].tolist(), (words[i] for i in at), strict=True))
                    yield pd.DataFrame({"uid": [uid + d for d, _ in seen], "doc_id": None, "n_tokens": 0, "n_known": 0, "base": 0.0, "ids": None, "word": [w for _, w in seen], "n": list(seen.values())})
                uid += len(part)

    return run


def head_model(counts: DataFrame, total: int, distinct: int) -> Model:
    """The most frequent words with their counts; no classes or weights yet."""
    top = most_frequent(counts, "c", HEAD).toPandas().sort_values(["c", "word"], ascending=[False, True])
    return Model([bytes(w) for w in top["word"]], top["c"].to_numpy(np.int64), total, distinct)


def learn(train: DataFrame, model: Model, passes: int = 0) -> None:
    """Classes and weights from the encoded training documents (ids). The words themselves are not needed any more."""
    model.ids = {}
    if model.n:
        model.arrange(word_classes(neighbours(train, model), model.counts))
    fit(train, model, passes)


def score(docs: DataFrame, held_out: int = 10, passes: int = 0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document's whole text.

    The model learns from documents whose remainder modulo ``held_out`` is not 0, by one gradient update at its biases and ``passes`` more
    at its own softmax; one with a null id is scored and not learnt from. A
    null text is empty, so the end is its one token. Rows are scored each for itself, so repeated ids do not mix; without training
    documents every base score is 0. Only doc_id and text are read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    learnt = remainder(F.col("doc_id"), held_out) != 0
    counts = materialize(count_words(docs.where(learnt)), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = head_model(counts, total, distinct)
    shared = spark.sparkContext.broadcast(model)  # HEAD words at most
    schema = "uid long, n_tokens long, n_known long, base double, ids binary, word binary, n long"
    rows = materialize(map_texts(docs, _encode(shared), schema, "doc_id", "text"), "lm-tokens")
    shared.destroy()
    whole = rows.where(F.col("word").isNull())
    learn(whole.where(learnt).select("ids"), model, passes)

    weights = spark.sparkContext.broadcast(model)  # the tables at most

    def scored(batches):
        for some in _gathered(batches):
            ids, first = _arrays(some["ids"])
            own = np.repeat(np.arange(len(some)), np.diff(np.append(first, len(ids))))
            yield pd.DataFrame({"uid": some["uid"], "score": np.bincount(own, log10_model(weights.value, ids, first), len(some))})

    asked = rows.where(F.col("word").isNotNull()).select("uid", "word", "n").join(counts, "word", "left")
    log_count = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    added = asked.groupBy("uid").agg(
        F.sum(F.col("n") * (log_count - float(model.base_bulk))).alias("more_base"),
        F.sum(F.col("n") * (log_count - float(model.rare_bulk))).alias("more_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    scores = materialize(whole.select("uid", "ids").mapInPandas(scored, "uid long, score double"), "lm-scores")
    told = whole.drop("ids", "word", "n").join(scores, "uid").join(added, "uid", "left")
    return told.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
