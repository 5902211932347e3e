"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on random Gaussian directions and cut into slots of one width, the outermost open to infinity; a table's
bucket is the slots of several directions. A query visits, in each table, its own bucket and perturbed ones in the order of their
estimated success (after Q. Lv et al.: Multi-Probe LSH, 2007): a neighbour at the typical cosine lies in a slot with a Gaussian
probability given the query's own projection, which is set against the share of all vectors that the slot holds. Each query goes on
until its own summed success over all tables reaches a bar, so one whose neighbours may lie in many buckets visits more of them. A query
whose neighbours turn out to be farther than typical goes on from there, with the cosine of the last one found in place of the typical
one; where that takes too many buckets, it is compared with every vector.

Vectors become rows by (table, bucket), queries rows by the buckets that they visit, and both meet in a shuffle by cells, which are
bounded numbers of buckets. A cell with too many vectors or queries is split on both sides. Candidates are ranked there by exact cosine,
each cell returns the best few of each query, and the tables' results are merged. Equal vectors are one candidate with their few
smallest ids and one query, so a group of copies costs what one vector does.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .store import broadcast_if_small, discard, materialize, short_batches

TABLES, SLOTS, WIDTH = 5, 3, 1.1
#: Directions and probes are fitted on at most about so many vectors, with the true neighbours of so many of them.
SAMPLE, SAMPLE_QUERIES = 2_000, 200
#: Recall that is fitted for: the mean, and the mean of the worst tenth of queries
TARGET_RECALL, TARGET_WORST = 0.955, 0.8
MOST_DIRECTIONS = 12
#: Buckets that a query visits in a table at most, and bars of summed success to choose from
PROBES = 1024
BARS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.96, 0.97, 0.975, 0.98, 0.985, 0.99, 0.9925, 0.995, 0.997, 0.999, 0.9995, 0.9999, 1.0)
#: How much of the share of all vectors counts against a slot's success.
CROWDING = 0.8
#: Vectors of a cell, about; queries of a cell at most, before either is split; queries of a block that is compared with all vectors.
CELL, CELL_QUERIES, BLOCK = 4_096, 4_096, 4_096
TASK_QUERIES = 256
BROADCAST_CELLS = 100_000


def _gauss(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by a power of two so that their largest component is near 1: no square over- or underflows."""
    v = np.asarray(vectors, np.float64)
    _, exponent = np.frexp(np.abs(v).max(1))
    return np.ldexp(v, -exponent[:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.sqrt((v * v).sum(1))[:, None]


class Index:
    """Random directions of all tables; the same for one dimension and number of directions in every task."""

    def __init__(self, dim: int, directions: int, bar: float, cosine: float):
        rng = np.random.default_rng(20_070_923)
        self.bar, self.cosine = bar, min(max(cosine, 0.0), 0.999)
        self.probes = min(PROBES, SLOTS**directions)
        #: share of all vectors that a query meets, as measured on the sample that the index was fitted on
        self.share = 1.0
        self.directions = rng.normal(size=(TABLES, dim, directions))
        shift = rng.uniform(-0.5, 0.5, (TABLES, 1, directions))
        #: inner edges of the slots: tables by edges by directions
        self.edges = (np.arange(1, SLOTS)[None, :, None] - SLOTS / 2 + shift) * WIDTH
        self.place = SLOTS ** np.arange(directions, dtype=np.int64)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Bucket of each vector: tables by vectors."""
        x = unit @ self.directions
        return sum((x >= self.edges[:, e : e + 1]).astype(np.int64) for e in range(SLOTS - 1)) @ self.place

    def success(self, unit: np.ndarray, cosine: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated probability of each slot to hold a neighbour of the cosine given, for all queries or each, and its worth, which
        counts how crowded the slot is; both as logarithms: tables by queries by slots by directions."""
        cosine = np.clip(np.broadcast_to(cosine, len(unit)), 0.0, 0.999)[None, :, None, None]
        mean = cosine * (unit @ self.directions)[:, :, None, :]
        spread = np.sqrt(1 - cosine**2)
        open_ = np.full((TABLES, 1, self.edges.shape[2]), np.inf)
        low, high = np.concatenate([-open_, self.edges], 1)[:, None], np.concatenate([self.edges, open_], 1)[:, None]
        near = np.log(np.maximum(_gauss((high - mean) / spread) - _gauss((low - mean) / spread), 1e-12))
        return near, near - CROWDING * np.log(_gauss(high) - _gauss(low))

    def visits(self, unit: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Buckets to visit, most promising first at the typical cosine: tables by queries by probes; and the estimated probability that
        the buckets up to each, of all tables, hold a neighbour at that cosine: queries by probes; with each query's ``own`` cosine also
        that for a neighbour there. The best of all directions are made of the best of the first few, so no more than ``probes`` partial
        buckets are kept."""
        near, worth = self.success(unit, self.cosine)
        nears = [near] if own is None else [near, self.success(unit, own)[0]]
        best, code, *hits = (np.zeros((*near.shape[:2], 1), kind) for kind in (float, np.int64, *[float] * len(nears)))
        for j, place in enumerate(self.place):
            best, *hits = ((x[..., None] + y[:, :, None, :, j]).reshape(*x.shape[:2], -1) for x, y in zip((best, *hits), (worth, *nears), strict=True))
            code = (code[..., None] + np.arange(SLOTS) * place).reshape(*code.shape[:2], -1)
            if best.shape[2] > self.probes:
                at = np.argpartition(-best, self.probes - 1, axis=2)[..., : self.probes]
                best, code, *hits = (np.take_along_axis(x, at, 2) for x in (best, code, *hits))
        order = np.argsort(-best, axis=2, kind="stable")
        reached = (np.minimum(np.cumsum(np.exp(np.take_along_axis(hit, order, 2)), axis=2), 1.0) for hit in hits)
        return np.take_along_axis(code, order, 2), *(1 - np.prod(1 - x, axis=0) for x in reached)

    def enough(self, reached: np.ndarray, bar: float) -> np.ndarray:
        """How many buckets of each table each query visits: to the first at which it has reached the bar; one more than there are to
        visit if it does not."""
        return (reached < bar - 1e-12).sum(1) + 1

    def all_(self, n: np.ndarray) -> np.ndarray:
        """Which queries are left to be compared with every vector: those that need more than PROBES of more buckets."""
        return (n > self.probes) & (self.probes < SLOTS ** len(self.place))


def fit(sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray], total: int) -> Index:
    """The number of directions and the bar that find TARGET_RECALL of the queries' true neighbours ``near``, and TARGET_WORST of those
    of the worst tenth, with the fewest candidates.

    Candidates are counted on the sample, whose share of a bucket is that of the whole. Where no choice reaches the targets, the one of
    the highest recall is taken.
    """
    q, unit = _unit(queries), _unit(sample)
    sizes = np.array([len(x) for x in near])
    owner = np.repeat(np.arange(len(near)), sizes)
    true = _unit(np.concatenate(near))
    cosines = (q[owner] * true).sum(1)
    cosine, farthest = float(np.median(cosines)), np.minimum.reduceat(cosines, np.cumsum(sizes) - sizes)
    best = None
    for directions in range(1, max(1, min(MOST_DIRECTIONS, round(math.log(max(total, 2), SLOTS)) + 1)) + 1):
        index = Index(sample.shape[1], directions, 1.0, cosine)
        (visits, reached, own), at, all_ = index.visits(q, np.minimum(farthest, index.cosine)), index.buckets(true), index.buckets(unit)
        rank_true = np.full((TABLES, len(true)), 1 << 30)
        rank_all = np.full((TABLES, len(q), len(unit)), 1 << 30, np.int32)
        table = np.empty(SLOTS**directions, np.int32)
        for t in range(TABLES):
            for i in range(len(q)):
                table[:] = 1 << 30
                table[visits[t, i]] = np.arange(visits.shape[2])
                rank_true[t, owner == i] = table[at[t, owner == i]]
                rank_all[t, i] = table[all_[t]]
        rank_true, rank_all = rank_true.min(0), rank_all.min(0)
        for bar in BARS:
            probes = np.maximum(index.enough(reached, bar), index.enough(own, bar))
            probes = np.where(index.all_(probes), (1 << 30) + 1, probes)
            found = np.bincount(owner, rank_true < probes[owner], len(near))
            recall, share = float(found.sum() / len(true)), float((rank_all < probes[:, None]).mean())
            worst = float(np.sort(found / sizes)[: -(-len(near) // 10)].mean())
            missed = recall < TARGET_RECALL or worst < TARGET_WORST
            key = (missed, -recall if missed else share, share)
            if best is None or key < best[0]:
                best = (key, directions, bar, share)
    index = Index(sample.shape[1], best[1], best[2], cosine)
    index.share = best[3]
    return index


def _valid(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, in the vectors' own precision if that is single, else as doubles."""
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vector).cast("array<float>" if single else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & some)


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def _best(ids: np.ndarray, v: np.ndarray, norms: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The ``k`` ids of the largest cosine, each once, ties to the smaller id; rows of ``v`` and ``q`` are scaled."""
    size = math.sqrt((q * q).sum())
    near = v @ q / (norms * size)
    out: dict[int, float] = {}
    at = np.arange(len(near))
    while len(out) < k and len(at):
        some, at = at, at[:0]
        if len(some) > 8 * k:  # the best few by the quick product and what may equal them
            keep = near[some] >= np.partition(near[some], len(some) - 4 * k)[len(some) - 4 * k] - 1e-9
            some, at = some[keep], some[~keep]
        # sums in one order for every row, so that equal vectors have equal scores
        score = (v[some] * q).sum(1) / (norms[some] * size)
        for i in np.lexsort((ids[some], -score)):
            out.setdefault(int(ids[some[i]]), float(score[i]))
            if len(out) == k:
                break
    return list(out.items())


def _scan(valid: DataFrame, block: dict, k: int, keep: bool = False) -> DataFrame:
    """(q, id, score[, v]) of the best ``k`` ids of each partition for each query of the block, which is broadcast: BLOCK vectors at most."""
    shared = valid.sparkSession.sparkContext.broadcast((list(block), scaled(np.array(list(block.values())))))
    kind = valid.schema["v"].dataType.simpleString()

    def run(batches):
        names, queries = shared.value
        top: list[dict[int, tuple]] = [{} for _ in names]
        for pdf in batches:
            raw, ids = pdf["v"], pdf["id"].to_numpy()
            v = scaled(np.array(raw.tolist()))
            norms = _norms(v)
            where = dict(zip(ids.tolist(), range(len(ids)), strict=True))
            for own, q in zip(top, queries, strict=True):
                for i, s in _best(ids, v, norms, q, k):
                    if i not in own or s > own[i][0]:
                        own[i] = (s, raw.iloc[where[i]] if keep else None)
                if len(own) > k:
                    for i in sorted(own, key=lambda i: (-own[i][0], i))[k:]:
                        del own[i]
        rows = [(name, i, s, v) for name, own in zip(names, top, strict=True) for i, (s, v) in own.items()]
        yield pd.DataFrame(rows, columns=["q", "id", "score", "v"]) if keep else pd.DataFrame([r[:3] for r in rows], columns=["q", "id", "score"])

    return valid.mapInPandas(run, "q long, id long, score double" + (f", v {kind}" if keep else ""))


def _fitted(distinct: DataFrame, total: int, k: int) -> Index:
    spot = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 31))
    sample = [(r["id"], r["v"]) for r in distinct.where(spot <= int(min(1.0, SAMPLE / total) * (1 << 31))).limit(2 * SAMPLE).collect()] or [tuple(distinct.first())]
    queries = dict(sample[:: max(1, len(sample) // SAMPLE_QUERIES)])
    near: dict[int, list] = {q: [] for q in queries}
    rows = _scan(distinct, queries, k + 1, keep=True).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")))
    for r in rows.where(F.col("rank") <= k + 1).collect():  # SAMPLE_QUERIES * (k + 1) vectors at most
        if r["id"] != r["q"]:
            near[r["q"]].append(r["v"])
    some = [q for q in queries if near[q]]
    if not some:
        return Index(len(sample[0][1]), 1, 1.0, 0.5)
    return fit(np.array([v for _, v in sample]), np.array([queries[q] for q in some]), [np.array(near[q]) for q in some], total)


def _cells(n: int):
    def cell(table: int, codes: np.ndarray) -> np.ndarray:
        x = (codes.astype(np.uint64) * np.uint64(64) + np.uint64(table + 1)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)

    return cell


def _judged(asked: DataFrame, found: DataFrame, index: Index, k: int) -> DataFrame:
    """(id, v, own, more, all) of the asked queries, given the best ``k`` found of each: ``own`` is the cosine of the last one if that is
    less than the typical, ``more`` whether the query has buckets left to visit then, and ``all`` whether it is to be compared with every
    vector: where fewer were found, or too many buckets are left."""
    own = found.groupBy("q").agg(F.min("score").alias("own"), F.count(F.lit(1)).alias("n"))
    rows = asked.join(own.withColumnRenamed("q", "id"), "id", "left").select("id", "v", F.least("own", F.lit(index.cosine)).alias("own"), (F.coalesce("n", F.lit(0)) < k).alias("few"))

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64].copy()
                unit, few = _unit(np.array(part["v"].tolist(), np.float64)), part["few"].to_numpy(bool)
                first, then = (index.enough(x, index.bar) for x in index.visits(unit, np.where(few, index.cosine, part["own"].to_numpy(float)))[1:])
                part["all"] = few | index.all_(then)
                part["more"] = (then > first) & ~part["all"]
                yield part[["id", "v", "own", "more", "all"]]

    kind = asked.schema["v"].dataType.simpleString()
    return materialize(rows.mapInPandas(run, f"id long, v {kind}, own double, more boolean, all boolean"), "ann-judged")


def _probe(distinct: DataFrame, asked: DataFrame, index: Index, k: int, total: int) -> DataFrame:
    """(q, id, score): of each asked query the best ``k`` ids of every cell that it visits; of one with its ``own`` cosine, those of the
    buckets that it visits beyond its first ones."""
    cell = _cells(max(1, -(-total * TABLES // CELL)))
    kind = np.float32 if isinstance(distinct.schema["v"].dataType.elementType, FloatType) else np.float64

    def place(batches):
        for pdf in batches:
            v = np.array(pdf["v"].tolist(), kind)
            data = [x.tobytes() for x in v]
            for t, codes in enumerate(index.buckets(_unit(v))):
                yield pd.DataFrame({"cell": cell(t, codes), "id": pdf["id"], "codes": [(c,) for c in (codes * TABLES + t).tolist()], "v": data})

    def visit(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                v = np.array(part["v"].tolist(), kind)
                visits, *reached = index.visits(_unit(v), part["own"].to_numpy() if "own" in part else None)
                start_, end = [np.zeros(len(v), np.int64), *(index.enough(x, index.bar) for x in reached)][-2:]
                for i, (q, row, lo, hi) in enumerate(zip(part["id"], v, start_, end, strict=True)):
                    codes = np.concatenate([visits[t, i, lo:hi] * TABLES + t for t in range(TABLES)])
                    cells = np.concatenate([cell(t, visits[t, i, lo:hi]) for t in range(TABLES)])
                    order = np.argsort(cells, kind="stable")
                    names, first = np.unique(cells[order], return_index=True)
                    yield pd.DataFrame({"cell": names, "id": q, "codes": np.split(codes[order], first[1:]), "v": [row.tobytes()] * len(names)})

    schema = "cell long, id long, codes array<long>, v binary"
    placed = materialize(distinct.select("id", "v").mapInPandas(place, schema), "ann-vectors")
    tasks = max(1, -(-asked.count() // TASK_QUERIES))  # a query's visits cost far more than its bytes say
    visiting = materialize(asked.select("id", "v", *[c for c in asked.columns if c == "own"]).repartition(tasks, "id").mapInPandas(visit, schema), "ann-queries")

    def counted(rows, name):
        return rows.groupBy("cell").agg(F.count(F.lit(1)).alias(name))

    grid = counted(placed, "vectors").join(counted(visiting, "queries"), "cell")
    grid = grid.select("cell", F.ceil(F.col("vectors") / (2 * CELL)).cast("int").alias("vs"), F.ceil(F.col("queries") / CELL_QUERIES).cast("int").alias("qs"))
    hot = broadcast_if_small(materialize(grid.where((F.col("vs") > 1) | (F.col("qs") > 1)), "ann-hot"), BROADCAST_CELLS)

    def dealt(rows, own, other, query):
        one = F.lit(1)
        rows = rows.join(hot, "cell", "left")
        mine = F.pmod(F.xxhash64("id", F.lit("split")), F.coalesce(own, one)).cast("int")
        rows = rows.select("cell", mine.alias(own), F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)).alias(other), "id", "codes", "v", F.lit(query).alias("query"))
        return rows.select("cell", "vs", "qs", "id", "codes", "v", "query")

    def rank(key, pdf):
        asked, held = pdf[pdf["query"]], pdf[~pdf["query"]]
        rows = []
        if len(asked) and len(held):
            code = np.array([c[0] for c in held["codes"]], np.int64)
            order = np.argsort(code, kind="stable")
            code, ids = code[order], held["id"].to_numpy()[order]
            v = scaled(np.stack([np.frombuffer(x, kind) for x in held["v"]])[order])
            queries = scaled(np.stack([np.frombuffer(x, kind) for x in asked["v"]]))
            norms = _norms(v)
            for name, codes, q in zip(asked["id"], asked["codes"], queries, strict=True):
                lo, hi = np.searchsorted(code, codes, "left"), np.searchsorted(code, codes, "right")
                found = [np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]
                if found:
                    at = np.concatenate(found)
                    rows += [(name, i, s) for i, s in _best(ids[at], v[at], norms[at], q, k)]
        return pd.DataFrame(rows, columns=["q", "id", "score"])

    both = dealt(placed, "vs", "qs", False).union(dealt(visiting, "qs", "vs", True))
    found = materialize(both.groupBy("cell", "vs", "qs").applyInPandas(rank, "q long, id long, score double"), "ann-found")
    discard(placed)
    discard(visiting)
    return found


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` ids of each query over all cells and tables."""
    rows = rows.groupBy("q", "id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found of each row whose id is divisible by ``every``.

    Score is the cosine in double precision on the original vectors; ties go to the smaller id. Rows whose id or vector is null, or
    whose vector is zero or has a null or non-finite component, take no part, nor do vectors of another length than most. Rows with
    the query's own id are no candidates, and an id that is repeated is found once, at its best score, and asked once, with the least of
    its vectors. Queries that find fewer than ``k`` others in their buckets, or would have to visit too many, are compared with every
    vector. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    valid = _valid(vectors, id_, vector)
    dims = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = valid.where(F.size("v") == dims[0]["d"])

    # of equal vectors the k + 1 smallest ids can be among a query's nearest k others
    same = [F.xxhash64("v"), F.xxhash64(F.lit(1), "v")]
    keyed = valid.select("id", "v", same[0].alias("h1"), same[1].alias("h2"))
    once = keyed.groupBy("h1", "h2", "id").agg(F.first("v").alias("v"))
    smallest = Window.partitionBy("h1", "h2").orderBy("id")
    distinct = materialize(once.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= k + 1).drop("_n"), "ann-distinct")
    total = distinct.count()
    index = _fitted(distinct.select("id", "v"), total, k)

    members = keyed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    members = materialize(members.select("id", "v", same[0].alias("h1"), same[1].alias("h2")), "ann-members")
    asked = members.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("v").alias("v"))
    asked = materialize(asked, "ann-asked")
    found = materialize(_merged(_probe(distinct, asked, index, k + 1, total), k + 1), "ann-best")
    judged = _judged(asked, found, index, k + 1)
    more = judged.where("more").select("id", "v", "own")
    if not more.isEmpty():
        found = found.unionByName(materialize(_merged(_probe(distinct, more, index, k + 1, total), k + 1), "ann-more"))
    few = judged.where("all").select("id", "v")
    block: dict[int, list] = {}
    for row in few.toLocalIterator():
        block[row["id"]] = row["v"]
        if len(block) == BLOCK:
            found = found.unionByName(materialize(_merged(_scan(distinct, block, k + 1), k + 1), "ann-scanned"))
            block = {}
    if block:
        found = found.unionByName(materialize(_merged(_scan(distinct, block, k + 1), k + 1), "ann-scanned"))
    found = _merged(found.drop("rank"), k + 1).select("q", F.col("id").alias("vec_id"), "score")

    names = members.select(F.col("id").alias("query_id"), "h1", "h2").join(asked.select("h1", "h2", F.col("id").alias("q")), ["h1", "h2"])
    others = names.join(found, "q").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
