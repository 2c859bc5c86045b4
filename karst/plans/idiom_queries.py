"""Relational idioms over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from karst.functions import guards
from karst.plans.registry import query
from karst.sources import star


@query("SELECT r_name, event_type FROM region CROSS JOIN (SELECT DISTINCT event_type FROM events)")
def bounded_cross(spark, d):
    """A product of two small lists, by its nature."""
    kinds = star.table(spark, d, "events").select("event_type").distinct()
    return star.table(spark, d, "region").select("r_name").crossJoin(kinds)


@query("SELECT p_brand, p_type, max(p_size) largest FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) <= 10")
def max_having(spark, d):
    found = star.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("largest"), F.count_distinct("p_size").alias("n"))
    return found.where("n <= 10").drop("n")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r FROM events) WHERE r = 1")
def distinct_on_key(spark, d):
    """The first row of each key; one struct per key is aggregated, no key's rows meet."""
    first = F.min(F.struct("ts", "event_id", "event_type")).alias("f")
    return star.table(spark, d, "events").groupBy("user_id").agg(first).select("user_id", "f.event_id", "f.event_type")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")
def sorted_parts(spark, d):
    return star.table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey")


@query("SELECT conv_id, bool_and(coalesce(nxt = turn + 1, true)) consecutive FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) nxt FROM conversations) GROUP BY conv_id")
def consecutive_turns(spark, d):
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    steps = star.table(spark, d, "conversations").select("conv_id", F.coalesce(after == F.col("turn") + 1, F.lit(True)).alias("next"))
    return steps.groupBy("conv_id").agg(F.bool_and("next").alias("consecutive"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def last_write_wins(spark, d):
    return star.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_SITES = """offer AS (SELECT DISTINCT site, alt FROM (SELECT l_suppkey site, l_orderkey, list_sort(list_distinct(list(p_brand))) alt
            FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <= 4 GROUP BY 1, 2)),
small AS (SELECT a.site, a.alt FROM offer a WHERE NOT EXISTS (SELECT 1 FROM offer b WHERE b.site = a.site AND b.alt <> a.alt AND list_has_all(a.alt, b.alt)))"""


@query("SELECT site, bool_or(len(alt) = 1) single FROM offer GROUP BY site", _SITES)
def some_single_alternative(spark, d):
    found = star.offers(spark, d).groupBy("site").agg(F.collect_set("alt").alias("alts"))
    return found.select("site", F.exists("alts", lambda a: F.size(a) == 1).alias("single"))


@query(
    """SELECT site, array_to_string(alt, ',') alt FROM (SELECT DISTINCT x.site, list_sort(list_distinct(list_concat(x.alt, y.alt))) alt FROM small x JOIN small y ON y.site = x.site + 1) p
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT x.site, list_sort(list_distinct(list_concat(x.alt, y.alt))) alt FROM small x JOIN small y ON y.site = x.site + 1) q WHERE q.site = p.site AND q.alt <> p.alt AND list_has_all(p.alt, q.alt))""",
    _SITES,
)
def conjoined_guards(spark, d):
    """Both the guard of a site and that of the next: products of their alternatives, the minimal ones."""
    alts = star.offers(spark, d).groupBy("site").agg(F.collect_set("alt").alias("alts")).select("site", guards.minimal(F.col("alts")).alias("alts"))
    both = alts.join(alts.select((F.col("site") - 1).alias("site"), F.col("alts").alias("next")), "site")
    both = both.repartition(4 * spark.sparkContext.defaultParallelism, "site")  # few bytes but long work: by size alone it would all be one task
    return both.select("site", F.explode(guards.conjoined(F.col("alts"), F.col("next"))).alias("alt")).select("site", F.array_join("alt", ",").alias("alt"))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0
        THEN (l <= 0 OR x >= l) AND (r >= 319 OR x <= r) AND (t <= 0 OR y >= t) AND (b >= 189 OR y <= b)
        ELSE CASE c_nationkey % 5 WHEN 1 THEN y <= 4 WHEN 2 THEN x >= 316 WHEN 3 THEN y >= 186 WHEN 4 THEN x <= 4 ELSE true END END there
    FROM (SELECT c_custkey, c_nationkey, c_custkey % 320 x, c_custkey % 190 y, c_nationkey * 10 - 30 l, c_nationkey * 14 r, c_nationkey * 4 - 20 t, c_nationkey * 9 b FROM customer)"""
)
def positions_hold(spark, d):
    """Positional atoms: rectangles for even nations, edges of the screen for odd ones."""
    c = F.col("c_nationkey")
    at = star.table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 320).alias("x"), (F.col("c_custkey") % 190).alias("y"))
    inside = guards.in_rectangle(F.col("x"), F.col("y"), c * 10 - 30, c * 4 - 20, c * 14, c * 9)
    return at.select("c_custkey", F.when(c % 2 == 0, inside).otherwise(guards.at_edge(F.col("x"), F.col("y"), c % 5)).alias("there"))
