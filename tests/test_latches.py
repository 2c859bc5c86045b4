"""Latches, self-sealing ways, flip seals and exhaustion on small hand-made tables."""

from karst.operators import latches


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_way_takes_only_registers_always_written_one(spark):
    w = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 0), ("c", 2), ("d", None), ("e", 1), ("e", None)], "register string, value int")
    assert rows(latches.one_way(w)) == [("a",), ("e",)]
    assert rows(latches.one_way(w.limit(0))) == []


def test_self_sealing_needs_a_raise_and_no_clearing(spark):
    asks = spark.createDataFrame([(1, 2, "a", 0), (1, 2, "a", 0), (1, 3, "b", 0), (1, 4, "a", 1), (1, 5, "c", 0), (1, 6, "a", None)], "src int, dst int, register string, value int")
    writes = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 1), ("b", 0), ("c", 2)], "register string, value int")
    assert rows(latches.self_sealing(asks, writes)) == [(1, 2, "a")]


def test_flip_shuts_every_door_of_a_trap(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3)], "src long, dst long")
    asks = spark.createDataFrame([(1, 2, "x", 0), (2, 3, "y", 0), (4, 3, "y", 0), (4, 3, "y", 0)], "src long, dst long, register string, value int")
    traps = spark.createDataFrame([("x", 0), ("y", 0), ("z", 0)], "register string, safe int")
    sources = spark.createDataFrame([("far", 3), ("near", 1), ("both", 2), ("both", 4), ("middle", 2), ("idle", 3)], "item string, room long")
    needs = spark.createDataFrame([("far", 9), ("near", 9), ("both", 9), ("middle", 9), ("gone", 9)], "item string, room long")
    start = spark.createDataFrame([(1,)], "room long")
    # x shuts room 2, which alone has "middle" while 3 is still reached by 4; y shuts both ways to 3
    assert rows(latches.flip_seals(start, edges, traps, asks, sources, needs)) == [("x", 0, "middle", 1), ("y", 0, "far", 2)]
    assert rows(latches.flip_seals(start, edges, traps.limit(0), asks, sources, needs)) == []


def test_exhaustion_counts_other_rooms_ahead(spark):
    shape = "item string, property string, room long, kind string, value int"
    writes = spark.createDataFrame([("bow", "n", 1, "inc", None), ("bow", "n", 2, "set", 0), ("cup", "f", 1, "set", 1), ("key", "f", 1, "set", 1), ("key", "f", 2, "set", 0), ("nil", "f", 1, "set", None)], shape)
    needs = spark.createDataFrame([("bow", 1), ("bow", 2), ("bow", 3), ("cup", 1), ("key", 2), ("nil", 2)], "item string, room long")
    after = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)], "after long, room long")
    assert rows(latches.exhausted(writes, needs, after)) == [("bow", "n", 1, 2)]
    assert rows(latches.exhausted(writes.limit(0), needs, after)) == []
