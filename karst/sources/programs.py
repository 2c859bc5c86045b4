"""Programs that the star-schema tables give: an order is a body, its line items are its statements.

Orders of the lowest priority are procedures of script 0, all others methods in the script of their first supplier, which is a room. A
statement's form follows from its part; it may move, take, put, assign, call the next order's procedure, or do so under tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.plans.fixpoint import large, many_tasks
from karst.sources.ir import flattened
from karst.sources.star import table

#: Stand-ins in forms: the statement's supplier, item, register and value.
DST, ITEM, REG, VAL = -1, -2, -3, -4
#: Nodes from one statement to the next.
STRIDE = 32
#: The form of a body's root.
HEAD = -1


def node(t: str, *kids, **more) -> dict:
    return {"t": t, **more, "kids": list(kids)}


def number(v: int) -> dict:
    return node("Number", value=v)


def variable(index: int, vtype: str = "Global") -> dict:
    return node("Variable", vtype=vtype, index=index)


def send(receiver: dict, selector: str, *params: dict) -> dict:
    return node("Send", receiver, node("SendMessage", node("Selector", name=selector), *params))


_EGO, _SELF = variable(0), node("Object", name="self")
_MOVE, _TAKE, _SET = send(_SELF, "newRoom", number(DST)), send(_EGO, "get", number(ITEM)), node("Assignment", variable(REG), number(VAL))
_HAS, _IS = send(_EGO, "has", number(ITEM)), node("Eq", variable(REG), number(VAL))
#: The forms of statements.
FORMS = [
    _MOVE,
    node("If", _IS, _MOVE, _TAKE),
    _TAKE,
    node("If", _HAS, _MOVE),
    _SET,
    node("If", node("And", _HAS, node("Not", _IS)), node("List", _MOVE, send(_EGO, "put", number(ITEM), number(DST)))),
    node("PublicCall", name="$next", index=0),
    node("Switch", variable(REG), node("Case", number(0), _MOVE), node("Case", number(1), _TAKE), node("Else", _SET)),
    node("Cond", node("Case", _HAS, _TAKE), node("Case", node("Or", _IS, node("Gt", variable(REG), number(1))), node("Assignment", variable(13), number(DST))), node("Else", _MOVE)),
    node("If", node("Eq", number(DST), variable(11)), _TAKE, node("If", send(send(node("Object", name="Inv"), "at", number(ITEM)), "ownedBy", number(DST)), _MOVE)),
    node("List", node("If", _IS, node("Assignment", variable(REG, "Temp"), number(DST))), send(_SELF, "newRoom", variable(REG, "Temp"))),
]


def template_rows() -> list[tuple]:
    """form, off, up, ord, depth, last, t, name, vtype, idx, value: the nodes of each form, by their place in it."""
    return [(k, *row) for k, form in enumerate(FORMS) for row in flattened(form)]


def bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """k, script, owner, body of each order with line items; and the statements: k, ln, form, item, dst, reg, val."""
    items = table(spark, sf_dir, "lineitem")
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    one = items.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    statements = one.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % len(FORMS)).alias("form"), (F.col("l_partkey") % 40).cast("int").alias("item"), (F.col("l_suppkey") + 1).cast("int").alias("dst"),
        (F.col("l_suppkey") % 5 + 20).cast("int").alias("reg"), (F.col("l_quantity").cast("long") % 4).cast("int").alias("val"),
    )
    script = statements.groupBy("k").agg(F.min_by("dst", "ln").alias("script"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderpriority") == "5-LOW").alias("low"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    text = F.col("k").cast("string")
    found = script.join(orders, "k").select(
        "k", F.when(F.col("low"), 0).otherwise(F.col("script")).alias("script"), F.when(F.col("low"), "").otherwise(F.concat(F.lit("o"), text)).alias("owner"),
        F.when(F.col("low"), F.concat(F.lit("p"), text)).when(F.col("urgent"), "changeState").otherwise("doit").alias("body"),
    )
    return found, statements


def program_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of each body, as in the node table."""
    return bodies(spark, sf_dir)[0].select(F.lit("orders").alias("file"), "script", "owner", "body", F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"))


def program_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table (see sources.ir) of the programs. A partition has whole bodies: statements move, and become nodes where they came to."""
    found, statements = bodies(spark, sf_dir)
    many = many_tasks(spark)
    none = [F.lit(None).cast(statements.schema[c].dataType).alias(c) for c in ("item", "dst", "reg", "val")]
    heads = found.select("k", F.lit(None).cast("int").alias("ln"), F.lit(HEAD).cast(statements.schema["form"].dataType).alias("form"), *none)
    form = spark.createDataFrame([*template_rows(), (HEAD, 0, None, 0, -1, STRIDE * 7, "List", None, None, None, None)], "form int, off int, up int, ord int, depth int, last int, t string, name string, vtype string, idx int, value int")
    base = F.coalesce((F.col("ln") - 1) * STRIDE + 1, F.lit(0))
    stands = lambda c: F.when(F.col(c) == DST, F.col("dst")).when(F.col(c) == ITEM, F.col("item")).when(F.col(c) == REG, F.col("reg")).when(F.col(c) == VAL, F.col("val")).otherwise(F.col(c)).cast("int").alias(c)
    top = (F.col("off") == 0) & (F.col("form") != HEAD)
    moved = statements.unionAll(heads.select(*statements.columns)).repartition(many, "k").join(large(found.repartition(many, "k")), "k")
    return moved.join(F.broadcast(form), "form").select(  # a few rows for each form
        F.lit("orders").alias("file"), "script", "owner", "body", (base + F.col("off")).alias("node"), F.when(top, 0).otherwise(base + F.col("up")).alias("parent"), F.when(top, F.col("ln") - 1).otherwise(F.col("ord")).alias("ord"),
        (F.col("depth") + 1).alias("depth"), (base + F.col("last")).alias("post"), "t", F.when(F.col("name") == "$next", F.concat(F.lit("p"), (F.col("k") + 1).cast("string"))).otherwise(F.col("name")).alias("name"), "vtype", stands("idx"), stands("value"),
    )


def program_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script, room: a supplier's script runs in its room; numbers are one above its key, as no room has number 0."""
    room = (F.col("s_suppkey") + 1).cast("int")
    return table(spark, sf_dir, "supplier").select(room.alias("script"), room.alias("room"))
