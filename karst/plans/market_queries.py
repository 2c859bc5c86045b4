"""Markets of the derived model, and SQL that tries every set of consumers: a set with fewer tokens than members can't be served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.operators import graph, markets
from karst.plans.registry import query
from karst.sources.star import table


def order_market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An order is a market: its line items accept the tokens of their part and supplier, and each pays one by its quantity, itself if it takes it."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    token = lambda x: (x.cast("long") % 6).cast("int")
    own = F.array_distinct(F.array(token(F.col("l_partkey")), token(F.col("l_suppkey"))))
    rows = items.select(F.col("l_orderkey").alias("market"), F.col("l_linenumber").alias("consumer"), own.alias("tokens"), token(F.col("l_quantity")).alias("token"))
    pays = F.when(F.array_contains("tokens", F.col("token")), F.array("consumer")).otherwise(F.array().cast("array<int>"))
    return rows.select("market", "consumer", "tokens"), rows.select("market", F.col("consumer").alias("spend"), "token", pays.alias("satisfies"))


_MARKET = """
one AS MATERIALIZED (SELECT l_orderkey k, l_linenumber c, (1 << (l_partkey % 6)) | (1 << (l_suppkey % 6)) acc, l_quantity::BIGINT % 6 t FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1),
sets AS MATERIALIZED (SELECT k, mask, bit_or(acc) acc, count(*) n FROM one, range(1, 128) x(mask) WHERE (mask >> (c - 1)) & 1 = 1 GROUP BY k, mask HAVING count(*) = bit_count(mask::INT)),
bad AS (SELECT DISTINCT k FROM sets WHERE bit_count(acc::INT) < n)"""


@query("SELECT k market, count(*) consumers, bit_count(bit_or(acc)::INT)::BIGINT tokens, k NOT IN (SELECT k FROM bad) saturated FROM one GROUP BY k", _MARKET)
def order_matching(spark, d):
    """Whether each order's line items can have a token of their own."""
    return graph.saturating(order_market(spark, d)[0])


@query(
    """SELECT o.k market, o.c spend, o.t::INT token, array_to_string(list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: (bit_and(mask) >> (i - 1)) & 1 = 1), ',') starves FROM one o JOIN sets s ON s.k = o.k
    WHERE o.k NOT IN (SELECT k FROM bad) AND bit_count((s.acc & (63 - (1 << o.t)))::INT) < s.n AND NOT ((acc_own >> o.t) & 1 = 1 AND (mask >> (o.c - 1)) & 1 = 1) GROUP BY o.k, o.c, o.t""".replace("one o JOIN", "(SELECT *, acc acc_own FROM one) o JOIN"),
    _MARKET,
)
def market_squeezes(spark, d):
    """Payments after which some line item of the order must go without."""
    found = markets.squeezes(*order_market(spark, d))
    return found.select("market", "spend", "token", F.array_join(F.transform("starves", lambda x: x.cast("string")), ",").alias("starves"))
