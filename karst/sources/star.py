"""The guarded-transition model that the star-schema tables give: rooms, edges, ways, sources, needs and event chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.plans.fixpoint import large

#: Values of a register by the flags of the tables.
FLAGS = {"R": 1, "A": 0}
STATUS = {"O": 1, "F": 0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room"""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("room"))


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive line items of one order with other suppliers: an equi-join on (order, line number + 1)."""
    items = table(spark, sf_dir, "lineitem")
    a = items.where((F.col("l_quantity") == 50) & (F.col("l_discount") >= 0.075))
    a = a.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_tax").alias("tax"))
    b = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("flag_to"), F.col("l_linestatus").alias("status_to"))
    return a.join(large(b), ["k", "n"]).where("src <> dst")  # all line items: few bytes in a file, many rows in memory


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst"""
    return _hops(spark, sf_dir).select("src", "dst").distinct()


def _coded(column: str, codes: dict[str, int]):
    out = F.lit(None).cast("int")
    for k, v in codes.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def ways(spark: SparkSession, sf_dir: str, register: str = "flag") -> DataFrame:
    """src, dst, req, setv, alt: what each way of an edge asks of the register and leaves in it, and the item it costs."""
    codes = FLAGS if register == "flag" else STATUS
    part = large(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")))
    hops = _hops(spark, sf_dir).join(part, "part", "left")
    alt = F.when(F.col("tax") >= 0.055, F.col("brand"))
    return hops.select("src", "dst", _coded(register, codes).alias("req"), _coded(f"{register}_to", codes).alias("setv"), alt.alias("alt")).distinct()


def _holdings(spark: SparkSession, sf_dir: str, quantity: int) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") == quantity) & (F.col("l_discount") <= 0.025))
    part = large(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item")))
    return items.join(part, items["l_partkey"] == part["p_partkey"]).select("item", F.col("l_suppkey").alias("room")).distinct()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, room where it can be had"""
    return _holdings(spark, sf_dir, 1)


def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, room where it is asked for"""
    return _holdings(spark, sf_dir, 2)


def drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, room where it can be lost"""
    return _holdings(spark, sf_dir, 3)


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, src, dst: how an item changes hands; 0 is its holder, a null src is anywhere."""
    items = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") == 4) & (F.col("l_discount") <= 0.005))
    part = large(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item")))
    found = items.join(part, items["l_partkey"] == part["p_partkey"])
    dst = F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(F.floor(F.col("l_suppkey") / 7) + 1).cast("long")
    return found.select("item", F.when(F.col("l_tax") >= 0.005, F.col("l_suppkey")).alias("src"), dst.alias("dst")).distinct()


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, alt: for each supplier and order the sorted brands of its small line items, as one alternative of the site."""
    items = table(spark, sf_dir, "lineitem").where("l_quantity <= 4")
    part = large(table(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    found = items.join(part, items["l_partkey"] == part["p_partkey"])
    return found.groupBy(F.col("l_suppkey").alias("site"), "l_orderkey").agg(F.sort_array(F.collect_set("p_brand")).alias("alt")).select("site", "alt").distinct()


def guard_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """guard, node, parent, op, kind, var, cmp, value: a guard tree for each order, its line items as atoms.

    The root is AND for even orders and OR for odd ones. Line items with flag A stand in an OR, those with N in an AND, and those
    with R below a NOT, with an OR between if they are several. The line number says what an atom is about: an item held, a
    register compared, an item's place, a counter, or nothing known.
    """
    n, open_ = F.col("l_linenumber"), F.col("l_linestatus") == "F"
    own, cmp, loc = n <= 2, n.between(3, 5), n == 6
    kind = F.when(own, "OWN").when(cmp, "CMP").when(loc, "LOC").when(open_, "OPAQUE").otherwise("CTR")
    name = lambda letter, key, mod: F.concat(F.lit(letter), (F.col(key) % mod).cast("string"))
    var = F.when(own | loc, name("i", "l_partkey", 9)).when(cmp, name("r", "l_suppkey", 3)).when(~open_, name("c", "l_suppkey", 2))
    op = F.when(n == 3, "==").when(n == 4, "!=").when(n == 5, F.when(F.col("l_suppkey") % 2 == 0, "<").otherwise(">=")).when(loc, "ownedBy").when(~own & ~open_, "==")
    value = F.when(loc, F.col("l_suppkey") % 5).when(~own & (cmp | ~open_), F.col("l_quantity").cast("long") % 4).cast("int")
    atoms = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("guard"), F.col("l_returnflag").alias("flag"), kind.alias("kind"), var.alias("var"), op.alias("cmp"), value.alias("value"))
    atoms = atoms.repartition("guard").distinct()  # rows move once, by guard; what follows stays where it is
    each = Window.partitionBy("guard", "flag").orderBy("kind", "var", "cmp", "value")
    atoms = atoms.withColumns({"many": F.count(F.lit(1)).over(Window.partitionBy("guard", "flag")), "nth": F.row_number().over(each), "first": F.row_number().over(Window.partitionBy("guard").orderBy("flag", "kind", "var", "cmp", "value")) == 1})
    flag, alone, heads = F.col("flag"), F.col("many") == 1, F.col("nth") == 1
    place = F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3)
    at = F.pmod(F.xxhash64("flag", "kind", "var", "cmp", "value"), F.lit(1 << 48)) + 10

    def node(at, parent, op, atom=False):
        none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("var", "string"), ("cmp", "string"), ("value", "int"))]
        return F.struct(at.cast("long").alias("node"), parent.cast("long").alias("parent"), op.alias("op"), *(["kind", "var", "cmp", "value"] if atom else none))

    root = F.when(F.col("first"), node(F.lit(0), F.lit(None), F.when(F.col("guard") % 2 == 0, "AND").otherwise("OR")))
    group = F.when(heads, node(place, F.lit(0), F.when(flag == "A", "OR").when(flag == "N", "AND").otherwise("NOT")))
    inner = F.when(heads & (flag == "R") & ~alone, node(F.lit(4), F.lit(3), F.lit("OR")))
    leaf = node(at, F.when((flag == "R") & ~alone, 4).otherwise(place), F.lit("ATOM"), True)
    return atoms.select("guard", F.explode(F.array_compact(F.array(root, group, inner, leaf))).alias("n")).select("guard", "n.*")


def world_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, req_flag, set_flag, req_status, set_status, alts: the ways of an edge; dearer ones ask for an item, or for one of two."""
    items = table(spark, sf_dir, "lineitem")
    a = items.where((F.col("l_quantity") == 50) & (F.col("l_discount") >= 0.075))
    a = a.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("pa"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_tax").alias("tax"))
    b = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("pb"), F.col("l_returnflag").alias("flag_to"), F.col("l_linestatus").alias("status_to"))
    part = table(spark, sf_dir, "part")
    of = lambda key, name: large(part.select(F.col("p_partkey").alias(key), F.col("p_brand").alias(name)))
    hops = a.join(large(b), ["k", "n"]).where("src <> dst").join(of("pa", "x"), "pa", "left").join(of("pb", "y"), "pb", "left")
    two = F.array_sort(F.array(F.array("x"), F.array("y")))
    alts = F.when(F.col("tax") < 0.035, F.array(F.array().cast("array<string>"))).when((F.col("tax") < 0.055) | (F.col("x") == F.col("y")), F.array(F.array("x"))).otherwise(two)
    coded = [_coded("flag", FLAGS).alias("req_flag"), _coded("flag_to", FLAGS).alias("set_flag"), _coded("status", STATUS).alias("req_status"), _coded("status_to", STATUS).alias("set_status")]
    return hops.select("src", "dst", *coded, alts.alias("alts")).distinct()


def _priced(spark: SparkSession, sf_dir: str, quantity: int) -> DataFrame:
    """Cheap line items of one quantity, with their brand and what a write there costs."""
    items = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") == quantity) & (F.col("l_discount") <= 0.005))
    part = large(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item")))
    cost = F.when(F.col("l_tax") < 0.055, F.array().cast("array<string>")).otherwise(F.array("item"))
    return items.join(part, items["l_partkey"] == part["p_partkey"]).withColumn("cost", cost).withColumn("room", F.col("l_suppkey")).withColumn("value", _coded("l_returnflag", FLAGS))


def world_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """register, room, value, cost"""
    return _priced(spark, sf_dir, 5).where("value is not null").select(F.lit("flag").alias("register"), "room", "value", "cost").distinct()


def world_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """register, room, frm, to, cost"""
    found = _priced(spark, sf_dir, 6).withColumn("to", _coded("l_linestatus", STATUS)).where("value <> to")
    return found.select(F.lit("flag").alias("register"), "room", F.col("value").alias("frm"), "to", "cost").distinct()


def world_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, room that hands it over unasked"""
    return _priced(spark, sf_dir, 9).select("item", "room").distinct()


def world_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """register, room, value that arrival forces"""
    return _priced(spark, sf_dir, 10).where("value is not null").groupBy("room").agg(F.max("value").alias("value")).select(F.lit("flag").alias("register"), "room", "value")


def part_writes(spark: SparkSession, sf_dir: str, where: str = "l_linestatus = 'F'") -> DataFrame:
    """register, value: what the line items of a part write to it"""
    return table(spark, sf_dir, "lineitem").where(where).select(F.col("l_partkey").alias("register"), _coded("l_returnflag", FLAGS).alias("value"))


def part_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, register, value: what the way from a line item's supplier to that of the next one in its order asks of the item's part"""
    items = table(spark, sf_dir, "lineitem")
    a = items.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("register"), _coded("l_returnflag", FLAGS).alias("value"))
    b = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("dst"))
    return a.where("value is not null").join(large(b), ["k", "n"]).where("src <> dst").select("src", "dst", "register", "value")


def property_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, property, room, kind (inc: it counts up; set), value"""
    items = table(spark, sf_dir, "lineitem").where("l_quantity = 7")
    part = large(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item")))
    kind = F.when(F.col("l_returnflag") == "N", "inc").otherwise("set").alias("kind")
    return items.join(part, items["l_partkey"] == part["p_partkey"]).select("item", (F.col("l_suppkey") % 2).alias("property"), F.col("l_suppkey").alias("room"), kind, _coded("l_returnflag", FLAGS).alias("value")).distinct()
