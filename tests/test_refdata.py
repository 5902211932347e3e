"""Versions valid at a time, against plain loops."""

import random

from marketlens.operators import refdata


def plain(events, versions):
    out = []
    for i, symbol, t in events:
        seen = [(since, tick) for s, since, tick in versions if s is not None and since is not None and t is not None and s == symbol and since <= t]
        out.append((i, symbol, t, max(seen)[1] if seen else None))
    return sorted(out, key=repr)


def run(spark, events, versions, width):
    e = spark.createDataFrame(events, "id long, symbol string, t long")
    v = spark.createDataFrame(versions, "symbol string, since long, tick long")
    out = refdata.valid_at(e, v, "t", "since", ["tick"], width)
    return sorted(map(tuple, out.collect()), key=repr), out


def test_against_plain_loops(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    events = [(i, pick("a", "b", "c", None), pick(None, *range(-40, 90))) for i in range(600)]
    versions = [(pick("a", "b", "d", None), pick(None, *range(-30, 80)), k) for k in range(40)]
    for width in (1, 7, 1000):
        assert run(spark, events, versions, width)[0] == plain(events, versions)


def test_work_does_not_grow_with_how_long_a_version_is_valid(spark):
    """Slices of validity were rows once, and were broadcast."""
    far = 10**18
    events = [(1, "a", 5), (2, "a", far), (3, "a", far + 1), (4, "b", far), (5, "a", 1)]
    versions = [("a", 2, 10), ("a", far + 1, 11)]
    got, out = run(spark, events, versions, 1)
    assert got == plain(events, versions)
    explained = out._jdf.queryExecution().toString()
    assert "Generate" not in explained and "Broadcast" not in explained
