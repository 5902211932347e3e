"""N-gram Jaccard self-join of documents by a grouped prefix join.

Documents are sets of word shingles. All sets are ordered by one global order, rare shingles first, and two sets that link share at
least a known number of shingles in their prefixes. Documents whose prefix and size are identical collapse into one group; groups
are joined by the shingles of their prefixes, group pairs are filtered by size and by how many shingles they share, and what remains
is expanded to the members, whose whole sets are compared exactly.

The order needs only to be the same for all documents, so frequencies come from a count sketch of fixed size, built from all
documents. Shingles in many prefixes are not expanded into pairs: groups that could link by them, given how many rarer shingles stand
before them and the sizes of both, hang on one of them (see ``_stars``). What hangs together is a cluster, and clusters are verified in
bounded cells (see ``_verify``), so no group of copies is multiplied out or meets in one task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import broadcast_if_small, discard, join_by_count, map_texts, materialize, short_batches
from .text import shingle_set

SHINGLE, NUM, DEN = 4, 85, 100
#: Shared shingles asked for beyond the first, in hundredths of a set's size. Longer prefixes, but far fewer chance pairs.
EXTRA = 5
#: The sketch: cells of one byte, a logarithm in sixths.
SKETCH_BITS = 24
#: Sizes of sets that are told apart when hot shingles are met grow by this factor.
BAND = 1.05
_BLOCKS = 64
#: Prefix shingles of more groups than this are clustered, not paired.
HOT = 12
#: Clusters of up to ``CELL`` sets are verified in one cell; larger ones in cells of about half as many, tied together by pivots.
CELL, PIVOTS = 128, 16
BROADCAST_ROWS = 500_000


def needed(n, num: int = NUM, den: int = DEN):
    """The least overlap with any set that a set of size n can link with."""
    return -(-n * num // den)


def share(n, extra: int = EXTRA):
    """Shingles that the prefixes of two linked sets share at least, for the smaller of both values."""
    return 1 + n * extra // 100


def _cell(s: np.ndarray) -> np.ndarray:
    return ((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Logarithms of the counts of all documents' shingles by cell: 2 ** SKETCH_BITS bytes, whatever the input."""
    step = (1 << SKETCH_BITS) // _BLOCKS

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint16)
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    at = _cell(shingle_set(text, k))
                    total[at] = np.minimum(total[at], 65_534) + 1
        for b in range(_BLOCKS):
            part = total[b * step : (b + 1) * step]
            if part.any():
                yield pd.DataFrame({"block": [b], "part": [zlib.compress(part.tobytes(), 1)]})

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, part in zip(pdf["block"], pdf["part"], strict=True):
                values = np.frombuffer(zlib.decompress(part), np.uint16)
                totals[block] = totals[block] + values if block in totals else values.astype(np.int64)
        for block, total in totals.items():
            code = np.minimum(np.round(6 * np.log2(1 + total)), 255).astype(np.uint8)
            yield pd.DataFrame({"block": [block], "part": [zlib.compress(code.tobytes(), 1)]})

    parts = docs.select("text").mapInPandas(count, "block int, part binary").repartition("block").mapInPandas(add, "block int, part binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for block, part in parts.collect():
        out[block * step : (block + 1) * step] = np.frombuffer(zlib.decompress(part), np.uint8)
    return out


def _describe(shared, k: int, num: int, den: int):
    """Per document: its set's size and key, its group's key, its prefix, and whether this partition met the group first."""

    def run(batches):
        counts, seen = shared.value, set()
        for pdf in batches:
            rows = []
            for text in pdf.pop("text"):
                s = shingle_set(text, k) if text else np.empty(0, np.uint64)
                n = len(s)
                if not n:
                    rows.append((0, None, None, None, False))
                    continue
                length = min(n, n - int(needed(n, num, den)) + int(share(n)))
                # the first ones in the order of counts; s is sorted, so ties keep the order of hashes
                count = counts[_cell(s)]
                first = np.flatnonzero(count <= np.partition(count, length - 1)[length - 1]) if length < n else np.arange(n)
                prefix = s[first[np.argsort(count[first], kind="stable")]][:length].view(np.int64)
                key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                group = int.from_bytes(hashlib.blake2b(n.to_bytes(8, "little") + prefix.tobytes(), digest_size=8).digest(), "little", signed=True)
                new = group not in seen
                if new and len(seen) < 1_000_000:
                    seen.add(group)
                rows.append((n, key, group, prefix if new else None, new))
            n, key, group, prefix, new = zip(*rows, strict=True) if rows else ((),) * 5
            yield pdf.assign(n=np.array(n, np.int64), set_key=pd.array(key, "Int64"), group=pd.array(group, "Int64"), prefix=list(prefix))

    return run


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): edges over groups such that groups with members that may link are in one component."""
    groups = rows.where(F.col("group").isNotNull()).select("group", "n").distinct()
    postings = rows.where(F.col("prefix").isNotNull()).select("group", F.posexplode("prefix").alias("pos", "shingle"))
    met = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("group").alias("lo"), F.max("group").alias("hi")).where(F.col("lo") < F.col("hi"))
    met = materialize(met.select("shingle", "c", F.col("c").alias("rows")), "prefix-met")
    shared = join_by_count(postings, met, "shingle", "rows", BROADCAST_ROWS).distinct().join(groups, "group")  # a group's prefix is one
    shared = materialize(shared, "prefix-shared")
    hot = shared.where(F.col("c") > HOT)
    hot_of = materialize(hot.groupBy("group").agg(F.count(F.lit(1)).alias("hot")), "prefix-hot")

    # few groups have the shingle: all pairs of them, at most HOT * (HOT - 1) / 2 a shingle
    few = shared.where(F.col("c") <= HOT)
    x, y = (few.select("shingle", F.col("group").alias(g), F.col("n").alias(m)) for g, m in (("a", "na"), ("b", "nb")))
    pairs = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.least(F.first("na"), F.first("nb")).alias("n"))
    # whatever the rest shares, it cannot share more hot shingles than either has
    ha, hb = (hot_of.select(F.col("group").alias(g), F.col("hot").alias(f"hot_{g}")) for g in ("a", "b"))
    pairs = pairs.join(ha, "a", "left").join(hb, "b", "left")
    least = F.lit(1) + F.floor(F.col("n") * EXTRA / 100) - F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    pairs = pairs.where(F.col("common") >= least).select("a", "b")

    return pairs.union(_stars(hot, num, den))


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(BAND))).cast("int")


def _stars(hot: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): edges that tie together the groups that may link by hot shingles alone, from (group, n, shingle, pos) of those.

    Sets of sizes n and m that link share at least o = ceil(num * (n + m) / (num + den)) shingles, so their first n - o + c and m - o + c
    share at least c, for any c. With c as in ``share``, a set in whose first n - o + c fewer than c are hot cannot link by them alone
    with any set of size m, and of the h that are, the first h - c + 1 hold one that both have. Sizes m are taken in bands, by their least.
    """
    of = hot.groupBy("group").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "shingle"))).alias("hots")).withColumn("own", _band(F.col("n")))
    n, band = F.col("n"), F.col("band")
    bands = F.sequence(_band(F.greatest(F.floor(n * num / den), F.lit(1))), _band(F.ceil(n * den / num)))
    low = F.greatest(F.floor(F.pow(F.lit(BAND), band)), F.ceil(n * num / den), F.lit(1))
    met = of.select("group", "n", "hots", "own", F.explode(bands).alias("band")).withColumn("low", low.cast("long"))
    met = met.withColumn("c", (1 + F.floor(F.least("n", "low") * EXTRA / 100)).cast("int"))
    met = met.withColumn("upto", n - F.ceil((n + F.col("low")) * num / (num + den)) + F.col("c"))
    met = met.withColumn("h", F.size(F.filter("hots", lambda x: x["pos"] < F.col("upto")))).where(F.col("h") >= F.col("c"))
    first = F.slice("hots", F.lit(1), F.col("h") - F.col("c") + 1)
    met = met.select("group", "own", "band", F.explode(F.transform(first, lambda x: x["shingle"])).alias("shingle"))
    met = met.select("group", "shingle", F.least("own", "band").alias("lo"), F.greatest("own", "band").alias("hi"), (F.col("own") <= F.col("band")).alias("low"), (F.col("own") >= F.col("band")).alias("high"))
    met = materialize(met, "prefix-met")
    key = ["shingle", "lo", "hi"]
    least = met.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("low"), F.col("group"))).alias("low_group"), F.min(F.when(F.col("high"), F.col("group"))).alias("high_group"))
    least = materialize(least.where(F.col("low_group").isNotNull() & F.col("high_group").isNotNull() & (F.col("rows") > 1)), "prefix-least")
    other = F.when(F.col("low"), F.col("high_group")).otherwise(F.col("low_group"))
    stars = join_by_count(met, least, key, "rows", BROADCAST_ROWS).select(F.col("group").alias("a"), other.alias("b"))
    return stars.where(F.col("a") != F.col("b")).distinct()


def _links(sets: list[np.ndarray], num: int, den: int, rows: slice, cols: slice) -> np.ndarray:
    """Which of the sets in ``rows`` link with which in ``cols``, by exact intersection sizes from products of incidence matrices."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    token = np.cumsum(new) - 1
    often = np.bincount(token)[token] > 1  # shingles of one set alone add nothing
    owner, token = owner[often], token[often]
    _, token = np.unique(token, return_inverse=True)
    a, b = np.arange(len(sets))[rows], np.arange(len(sets))[cols]
    common = np.zeros((len(a), len(b)), np.float64)
    width = 8192
    for start in range(0, int(token.max()) + 1 if len(token) else 0, width):
        lo, hi = np.searchsorted(token, [start, start + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[lo:hi], token[lo:hi] - start] = 1
        common += block[a] @ block[b].T
    union = size[a][:, None] + size[b][None, :] - common
    return den * common >= num * union


def _roots(link: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The smallest key reachable from each position over a symmetric matrix of links."""
    root, seen = keys.copy(), np.zeros(len(keys), bool)
    for i in np.argsort(keys):
        if seen[i]:
            continue
        seen[i] = True
        edge = [i]
        while edge:
            reach = link[edge].any(axis=0) & ~seen
            seen |= reach
            edge = list(np.flatnonzero(reach))
            root[edge] = keys[i]
    return root


def _verify(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links by which the sets of each cluster hang together as all their links would; members are (cluster, key, data).

    A cluster of up to CELL sets is one cell, where every pair is compared. A larger one is dealt into cells of about CELL / 2 sets,
    each with the same few pivots, which tie the cells' components together. Sets that then are not in the cluster's largest component
    are compared with the sets of every cell, in chunks, so that no link between components is missed.
    """
    large_ones = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL)
    large_ones = broadcast_if_small(materialize(large_ones, "join-large"), BROADCAST_ROWS)  # at most one in CELL of all sets
    spot = F.pmod(F.xxhash64("key"), F.lit(1 << 31))
    sized = members.join(large_ones, "cluster", "left").withColumn("cells", F.when(F.col("size").isNull(), 1).otherwise(F.ceil(F.col("size") * 2 / CELL)).cast("int"))
    sized = materialize(sized.withColumn("cell", F.pmod(F.xxhash64("key", F.lit("cell")), F.col("cells")).cast("int")), "join-members")
    pivot = sized.where((F.col("cells") > 1) & (spot * F.col("size") < PIVOTS * float(1 << 31)))
    dealt = sized.select("cluster", "cell", "key", "data").union(
        pivot.select("cluster", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("at"), "key", "data", "cell").where(F.col("at") != F.col("cell")).select("cluster", "at", "key", "data")
    )

    def within(key, pdf):
        sets = [np.frombuffer(x, np.uint64) for x in pdf["data"]]
        keys = pdf["key"].to_numpy()
        everything = slice(None)
        return pd.DataFrame({"a": keys, "b": _roots(_links(sets, num, den, everything, everything), keys)})

    edges = materialize(dealt.groupBy("cluster", "cell").applyInPandas(within, "a long, b long").where(F.col("a") != F.col("b")), "join-edges")
    large = sized.where(F.col("cells") > 1)
    if large.limit(1).count() == 0:
        discard(sized)
        return edges

    roots = components(edges)
    placed = large.join(roots, large["key"] == roots["node"], "left").select("cluster", "cell", "cells", "key", "data", F.coalesce("root", "key").alias("root"))
    placed = materialize(placed, "join-placed")
    counts = placed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("all")).select("cluster", F.col("most.root").alias("main"), (F.col("all") - F.col("most.m")).alias("rest"))
    main = main.where(F.col("rest") > 0).withColumn("chunks", F.ceil(F.col("rest") * 2 / CELL).cast("int"))
    placed = placed.join(main, "cluster")
    chunk = F.pmod(F.xxhash64("key", F.lit("chunk")), F.col("chunks")).cast("int")
    rest = placed.where(F.col("root") != F.col("main")).select("cluster", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), chunk.alias("chunk"), "key", "root", "data", F.lit(True).alias("rest"))
    local = placed.select("cluster", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "key", "root", "data", F.lit(False).alias("rest"))

    def across(key, pdf):
        pdf = pdf.sort_values("rest", kind="stable")
        split = int((~pdf["rest"]).sum())
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        if split in (0, len(pdf)):
            return none
        sets = [np.frombuffer(x, np.uint64) for x in pdf["data"]]
        keys, of = pdf["key"].to_numpy(), pdf["root"].to_numpy()
        link = _links(sets, num, den, slice(split, None), slice(0, split)) & (of[split:, None] != of[None, :split])
        i, j = np.nonzero(link)
        return pd.DataFrame({"a": keys[split:][i], "b": keys[:split][j]}) if len(i) else none

    more = rest.unionByName(local).groupBy("cluster", "cell", "chunk").applyInPandas(across, "a long, b long")
    return edges.union(materialize(more, "join-more"))


def join(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; two link when den * intersection >= num * union.

    component_id is the smallest doc_id that links reach, the document's own included. Texts that are null or without words have no
    shingles and stand alone. Rows with equal sets, repeated rows among them, link with each other; a null doc_id is kept and never is
    the smallest, unless its component has no other. Only doc_id and text are read; an empty table gives an empty result.
    """
    rows, of_set = _join(docs, k, num, den)
    of_set = of_set.drop("root")
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_key")
    linked = join_by_count(own.where(F.col("set_key").isNotNull()), of_set, "set_key", "copies", BROADCAST_ROWS).drop("set_key")
    alone = own.where(F.col("set_key").isNull()).select("doc_id", "n_shingles", F.lit(None).cast(linked.schema["component"].dataType).alias("component"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows, all columns, that stay when one document of each component does: that with the smallest id, and of several such texts
    the one with the smallest hash. Of rows that agree in doc_id and text one stays. Texts without words all stay."""
    rows, of_set = _join(docs, k, num, den)
    placed = join_by_count(rows.where(F.col("n") > 0).select("doc_id", "text_key", "set_key"), of_set.drop("component"), "set_key", "copies", BROADCAST_ROWS)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))
    placed = materialize(placed, "join-roots")
    first = placed.groupBy("root").agg(F.min(rank).alias("first")).select(F.col("first.id").alias("_id"), F.col("first.text").alias("_text"))
    # a text is in one component, so a row is its component's first just where id and text are those of a first
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text"))
    gone = placed.join(first, same, "left_anti").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_text")).distinct()
    gone = broadcast_if_small(materialize(gone, "copies"), BROADCAST_ROWS)
    own = F.xxhash64(F.col("_kept.text"))
    kept = docs.alias("_kept").join(gone, F.col("_kept.doc_id").eqNullSafe(F.col("_gone_id")) & (own == F.col("_gone_text")), "left_anti")
    again = rows.where(F.col("n") > 0).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select(F.col("doc_id").alias("_again_id"), F.col("text_key").alias("_again_text"))
    again = materialize(again, "again")
    if again.limit(1).count() == 0:
        return kept
    again = broadcast_if_small(again, BROADCAST_ROWS)
    on = F.col("_kept.doc_id").eqNullSafe(F.col("_again_id")) & (F.xxhash64(F.col("_kept.text")) == F.col("_again_text"))
    once = kept.alias("_kept").join(again, on, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.alias("_kept").join(again, on, "left_anti").union(once)


def _join(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets' keys, and each set's component, its root and smallest doc_id, with the number of rows that have the set."""
    spark = docs.sparkSession
    short_batches(spark)
    counts = spark.sparkContext.broadcast(sketch(docs, k))  # 2 ** SKETCH_BITS bytes
    schema = "text_key long, n long, set_key long, group long, prefix array<long>"
    described = map_texts(docs.withColumn("text_key", F.xxhash64("text")), _describe(counts, k, num, den), schema, "doc_id", "text_key", "text")
    rows = materialize(described, "join-rows")

    sets = rows.where(F.col("n") > 0).groupBy("set_key", "group").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("copies"))
    sets = materialize(sets, "join-sets")
    clusters = components(_candidates(rows, num, den))
    placed = sets.join(clusters, sets["group"] == clusters["node"], "left").select(F.coalesce("root", "group").alias("cluster"), "set_key", "text_key")
    placed = materialize(placed, "join-clusters")
    several = materialize(placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "join-several")
    wanted = materialize(join_by_count(placed, several, "cluster", "size", BROADCAST_ROWS).select("cluster", "set_key", "text_key"), "join-wanted")

    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(broadcast_if_small(wanted, BROADCAST_ROWS), "text_key")

    def data(batches):
        seen: set[int] = set()
        for pdf in batches:
            pdf = pdf.drop_duplicates("key")
            pdf = pdf[~pdf["key"].isin(seen)]
            if len(seen) < 1_000_000:  # copies that slip through are dropped behind
                seen.update(pdf["key"].tolist())
            yield pdf.assign(data=[shingle_set(x, k).tobytes() for x in pdf["text"]])[["cluster", "key", "data"]]

    members = texts.select("cluster", F.col("set_key").alias("key"), "text").mapInPandas(data, "cluster long, key long, data binary").dropDuplicates(["key"])
    linked = components(_verify(members, num, den))

    found = sets.join(linked, sets["set_key"] == linked["node"], "left").select("set_key", "first_id", "copies", F.coalesce("root", "set_key").alias("root"))
    found = materialize(found, "join-found")
    smallest = materialize(found.groupBy("root").agg(F.min("first_id").alias("component"), F.count(F.lit(1)).alias("sets")), "join-smallest")
    placed = join_by_count(found, smallest, "root", "sets", BROADCAST_ROWS).select("set_key", "root", "component", "copies")
    return rows, materialize(placed, "join-components")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
k AS (SELECT min(rid) AS rid, md5(array_to_string(list_sort(g), chr(10))) AS m, any_value(g) AS g, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY 2),
t AS (SELECT m, n, unnest(g) AS x FROM k),
o AS (SELECT a.m AS a, b.m AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.x = b.x AND a.m < b.m
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM o WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM o WHERE 100 * c >= 85 * (na + nb - c)),
first AS (SELECT md5(array_to_string(list_sort(g), chr(10))) AS m, min(doc_id) AS id FROM s WHERE len(g) > 0 GROUP BY 1),
reach(m, r) AS (SELECT m, m FROM k UNION SELECT reach.m, e.b FROM reach JOIN e ON reach.r = e.a),
comp AS (SELECT reach.m, min(first.id) AS component_id FROM reach JOIN first ON first.m = reach.r GROUP BY 1)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN comp ON len(s.g) > 0 AND comp.m = md5(array_to_string(list_sort(s.g), chr(10)))
"""
