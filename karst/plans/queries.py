"""The reference queries over the derived model, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions import guards
from karst.operators import detect, gated, graph, idioms, product
from karst.plans import guard_queries, idiom_queries, latch_queries, machine_queries, market_queries, program_queries, window_queries, world_queries  # noqa: F401
from karst.plans.fixpoint import large, shared, written
from karst.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from karst.sources import star

_MODEL = """
hop AS (SELECT a.l_suppkey src, b.l_suppkey dst, a.l_partkey part, a.l_tax tax, a.l_returnflag f, b.l_returnflag f2, a.l_linestatus s, b.l_linestatus s2
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_suppkey <> b.l_suppkey AND a.l_quantity = 50 AND a.l_discount >= 0.075),
edge AS (SELECT DISTINCT src, dst FROM hop),
way AS (SELECT DISTINCT src, dst, CASE f WHEN 'R' THEN 1 WHEN 'A' THEN 0 END req, CASE f2 WHEN 'R' THEN 1 WHEN 'A' THEN 0 END setv,
               CASE WHEN tax >= 0.055 THEN p_brand END alt FROM hop LEFT JOIN part ON part = p_partkey),
way2 AS (SELECT DISTINCT src, dst, CASE s WHEN 'O' THEN 1 WHEN 'F' THEN 0 END req, CASE s2 WHEN 'O' THEN 1 WHEN 'F' THEN 0 END setv,
               CASE WHEN tax >= 0.055 THEN p_brand END alt FROM hop LEFT JOIN part ON part = p_partkey),
source AS (SELECT DISTINCT p_brand item, l_suppkey room FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 1 AND l_discount <= 0.025),
need AS (SELECT DISTINCT p_brand item, l_suppkey room FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 2 AND l_discount <= 0.025),
offer AS (SELECT DISTINCT site, alt FROM (SELECT l_suppkey site, l_orderkey, list_sort(list_distinct(list(p_brand))) alt
          FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <= 4 GROUP BY 1, 2)),
clo(a, b) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT clo.a, edge.dst FROM clo JOIN edge ON clo.b = edge.src),
start AS (SELECT a room FROM clo GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
reached AS (SELECT b room FROM clo WHERE a = (SELECT room FROM start)),
reob AS (SELECT DISTINCT s.item, c.a room FROM source s JOIN clo c ON c.b = s.room),
comp AS (SELECT x.a room, min(x.b) component FROM clo x JOIN clo y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
st(room, v) AS (SELECT room, 0 FROM start UNION SELECT dst, coalesce(setv, v) FROM st JOIN way ON src = room AND (req IS NULL OR req = v)),
st2(room, v) AS (SELECT room, 0 FROM start UNION SELECT dst, coalesce(setv, v) FROM st2 JOIN way2 ON src = room AND (req IS NULL OR req = v)),
ban(item, room, v) AS (SELECT DISTINCT p_brand, room, 0 FROM part, start UNION SELECT item, dst, coalesce(setv, v) FROM ban JOIN way ON src = room AND (req IS NULL OR req = v) AND (alt IS NULL OR alt <> item)),
ban2(item, room, v) AS (SELECT DISTINCT p_brand, room, 0 FROM part, start UNION SELECT item, dst, coalesce(setv, v) FROM ban2 JOIN way2 ON src = room AND (req IS NULL OR req = v) AND (alt IS NULL OR alt <> item)),
dropped AS (SELECT DISTINCT p_brand item, l_suppkey room FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 3 AND l_discount <= 0.025),
moved AS (SELECT DISTINCT p_brand item, CASE WHEN l_tax >= 0.005 THEN l_suppkey END src, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_suppkey // 7 + 1 END dst FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 4 AND l_discount <= 0.005),
mv(item, room, p) AS (SELECT item, room, room FROM dropped UNION SELECT mv.item, mv.room, moved.dst FROM mv JOIN moved ON moved.item = mv.item AND (moved.src IS NULL OR moved.src = mv.p)),
back1(item, room, v) AS (SELECT item, source.room, st.v FROM source JOIN st ON st.room = source.room UNION SELECT item, st.room, st.v FROM back1 JOIN way ON way.dst = back1.room JOIN st ON st.room = way.src WHERE (req IS NULL OR req = st.v) AND coalesce(setv, st.v) = back1.v AND (alt IS NULL OR alt <> item)),
back2(item, room, v) AS (SELECT item, source.room, st2.v FROM source JOIN st2 ON st2.room = source.room UNION SELECT item, st2.room, st2.v FROM back2 JOIN way2 ON way2.dst = back2.room JOIN st2 ON st2.room = way2.src WHERE (req IS NULL OR req = st2.v) AND coalesce(setv, st2.v) = back2.v AND (alt IS NULL OR alt <> item)),
flip AS (SELECT DISTINCT setv w, dst room FROM st JOIN way ON src = st.room WHERE (req IS NULL OR req = st.v) AND setv IS NOT NULL AND setv <> st.v),
fl(w, seed, room, v) AS (SELECT w, room, room, w FROM flip UNION SELECT w, seed, dst, coalesce(setv, v) FROM fl JOIN way ON src = fl.room AND (req IS NULL OR req = v)),
strand AS (SELECT DISTINCT e.src, e.dst, n.item FROM edge e JOIN clo f ON f.a = e.dst JOIN need n ON n.room = f.b JOIN reob r ON r.item = n.item AND r.room = e.src
           WHERE NOT EXISTS (SELECT 1 FROM reob z WHERE z.item = n.item AND z.room = e.dst) AND NOT EXISTS (SELECT 1 FROM edge k WHERE k.src = e.dst AND k.dst = e.src)),
cut(s, d, room) AS (SELECT src, dst, (SELECT room FROM start) FROM edge WHERE src IN (SELECT room FROM reached)
                    UNION SELECT s, d, edge.dst FROM cut JOIN edge ON edge.src = cut.room AND NOT (edge.src = s AND edge.dst = d)),
pocket AS (SELECT e.src, e.dst, r.room FROM edge e, reached r WHERE e.src IN (SELECT room FROM reached) AND NOT EXISTS (SELECT 1 FROM cut WHERE s = e.src AND d = e.dst AND cut.room = r.room)),
demand AS (SELECT src, dst, min(alt) item FROM way GROUP BY src, dst HAVING count(*) = count(alt) AND min(alt) = max(alt)),
alts AS (SELECT site, list_sort(list(alt)) alts FROM offer GROUP BY site)
"""


def _query(sql: str | None = None, model: bool = True):
    """Registers a query; sql: what follows the relations of the model."""
    return query(sql, _MODEL if model else "")


def _edges(spark, d) -> DataFrame:
    return shared(spark, d, "edges", lambda: written(star.edges(spark, d)))


def _pairs(spark, d) -> DataFrame:
    return graph.closure(star.rooms(spark, d), _edges(spark, d))


def _start(spark, d) -> DataFrame:
    return shared(spark, d, "start", lambda: written(graph.widest(star.rooms(spark, d), _edges(spark, d)).select("room")))


def _had(spark, d) -> DataFrame:
    return detect.reobtainable(star.sources(spark, d), _edges(spark, d), star.rooms(spark, d))


def _pockets(spark, d) -> DataFrame:
    return graph.pockets(_start(spark, d), _edges(spark, d))


@_query("SELECT a, b FROM clo")
def closure_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@_query("SELECT a room, count(*) reach FROM clo GROUP BY a")
def closure_reach(spark, d):
    return _pairs(spark, d).groupBy(F.col("a").alias("room")).agg(F.count(F.lit(1)).alias("reach"))


@_query("SELECT room FROM reached")
def reach_from_start(spark, d):
    return graph.reach(_start(spark, d), _edges(spark, d))


@_query("SELECT t.dst goal, clo.a room FROM (SELECT DISTINCT dst FROM edge WHERE dst NOT IN (SELECT src FROM edge)) t JOIN clo ON clo.b = t.dst")
def reverse_reach(spark, d):
    arcs = _edges(spark, d)
    return graph.backward(graph.terminals(arcs), arcs)


@_query("SELECT room, component, count(*) OVER (PARTITION BY component) AS size FROM comp")
def scc_components(spark, d):
    return graph.strong_components(star.rooms(spark, d), _edges(spark, d))


@_query("SELECT DISTINCT a.component src, b.component dst FROM edge JOIN comp a ON a.room = src JOIN comp b ON b.room = dst WHERE a.component <> b.component")
def condensation_edges(spark, d):
    arcs = _edges(spark, d)
    return graph.condensation(graph.strong_components(star.rooms(spark, d), arcs), arcs)


@_query("SELECT DISTINCT src room FROM edge WHERE src NOT IN (SELECT dst FROM edge)")
def graph_roots(spark, d):
    return graph.roots(_edges(spark, d))


@_query("SELECT DISTINCT dst room FROM edge WHERE dst NOT IN (SELECT src FROM edge)")
def terminals(spark, d):
    return graph.terminals(_edges(spark, d))


@_query("SELECT item, room FROM reob")
def reobtainable_rooms(spark, d):
    return _had(spark, d)


@_query("SELECT src, dst, item FROM strand")
def edge_strandings_flat(spark, d):
    return detect.edge_strandings(_edges(spark, d), star.needs(spark, d), star.sources(spark, d), star.rooms(spark, d))


@_query("SELECT item, count(*) crossings, array_to_string(list_sort(list_distinct(list(dst)))[1:6], ',') frontier FROM strand GROUP BY item")
def stranding_summary(spark, d):
    return detect.summary(edge_strandings_flat(spark, d))


@_query("SELECT room, v AS value FROM st")
def product_reach(spark, d):
    return product.states(_start(spark, d), star.ways(spark, d)).select("room", "value")


@_query("SELECT item, room, v AS value FROM ban")
def ban_reach(spark, d):
    items = star.table(spark, d, "part").select(F.col("p_brand").alias("item")).distinct()
    return product.states(_start(spark, d), star.ways(spark, d), items)


@_query("SELECT DISTINCT room FROM st WHERE room IN (SELECT room FROM st2)")
def projection_intersection(spark, d):
    start = _start(spark, d)
    return product.in_all([product.states(start, star.ways(spark, d, r)) for r in ("flag", "status")])


@_query("SELECT src, dst, room FROM pocket")
def pocket_by_cut(spark, d):
    return _pockets(spark, d)


@_query("SELECT DISTINCT p.src, p.dst, x.item toll, n.item FROM pocket p JOIN demand x ON x.src = p.src AND x.dst = p.dst JOIN need n ON n.room = p.room WHERE n.item <> x.item AND n.item IN (SELECT item FROM source) AND NOT EXISTS (SELECT 1 FROM pocket q JOIN source s ON s.room = q.room WHERE q.src = p.src AND q.dst = p.dst AND s.item = n.item)")
def toll_strandings(spark, d):
    return detect.tolls(written(_pockets(spark, d)), star.ways(spark, d), star.needs(spark, d), star.sources(spark, d))


@_query("SELECT f.value, f.forced, coalesce(r.reset, 0) AS reset FROM (SELECT setv AS value, count(DISTINCT dst) forced FROM way WHERE setv IS NOT NULL GROUP BY 1) f LEFT JOIN (SELECT req AS value, count(DISTINCT dst) AS reset FROM way WHERE req IS NOT NULL AND setv IS NOT NULL AND req <> setv GROUP BY 1) r ON r.value = f.value WHERE f.forced > coalesce(r.reset, 0)")
def free_running_traps(spark, d):
    return detect.free_running_traps(star.ways(spark, d))


@_query("(SELECT DISTINCT alt item FROM way WHERE alt IS NOT NULL) INTERSECT (SELECT item FROM source)")
def gating_items(spark, d):
    return star.ways(spark, d).where("alt is not null").select(F.col("alt").alias("item")).intersect(star.sources(spark, d).select("item"))


@_query("(SELECT DISTINCT item FROM need) EXCEPT (SELECT item FROM source)")
def sourceless_needs(spark, d):
    return star.needs(spark, d).select("item").subtract(star.sources(spark, d).select("item"))


@_query("SELECT src, dst, item FROM demand")
def edge_demands(spark, d):
    return detect.edge_demands(star.ways(spark, d))


@_query("SELECT DISTINCT w.src, w.dst FROM way w WHERE EXISTS (SELECT 1 FROM way b WHERE b.src = w.dst AND b.dst = w.src AND b.alt IS NULL AND b.req IS NULL)")
def freely_reversible(spark, d):
    return detect.freely_reversible(star.ways(spark, d))


@_query("SELECT src, dst FROM way GROUP BY src, dst HAVING bool_and(alt IS NOT NULL AND alt IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#44', 'Brand#55'))")
def blocked_edges(spark, d):
    return detect.blocked_edges(star.ways(spark, d), ["Brand#11", "Brand#22", "Brand#33", "Brand#44", "Brand#55"])


@_query("SELECT a.site, array_to_string(a.alt, ',') alt FROM offer a WHERE NOT EXISTS (SELECT 1 FROM offer b WHERE b.site = a.site AND b.alt <> a.alt AND list_has_all(a.alt, b.alt))")
def minimal_alternatives(spark, d):
    found = star.offers(spark, d).groupBy("site").agg(F.collect_set("alt").alias("alts"))
    return found.select("site", F.explode(guards.minimal(F.col("alts"))).alias("alt")).select("site", F.array_join("alt", ",").alias("alt"))


@_query("SELECT site, array_to_string(list_sort(list_reduce(alts, lambda x, y: list_intersect(x, y))), ',') common, len(alts) n FROM alts")
def factor_alternatives(spark, d):
    found = star.offers(spark, d).groupBy("site").agg(F.collect_set("alt").alias("alts"))
    return found.select("site", F.array_join(guards.common(F.col("alts")), ",").alias("common"), F.size("alts").cast("long").alias("n"))


@_query("SELECT site, array_to_string(list_sort(list_distinct(flatten(alts))), ',') members FROM alts WHERE len(alts) >= 2 AND len(list_reduce(alts, lambda x, y: list_intersect(x, y))) = 0")
def disjunctive_groups(spark, d):
    return detect.disjunctive_groups(star.offers(spark, d)).select("site", F.array_join("members", ",").alias("members"))


@_query("SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS \"first\", last(event_id ORDER BY ts, event_id) AS \"last\", count(*) length FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END n FROM events)) GROUP BY user_id, run, event_type", model=False)
def chain_islands(spark, d):
    return idioms.runs(star.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@_query("SELECT conv_id, turn, role, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') priors FROM conversations", model=False)
def carry_prefix(spark, d):
    return idioms.prefixes(star.table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@_query("SELECT event_id, user_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) carry FROM (SELECT *, sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) s FROM events)", model=False)
def clamped_carry(spark, d):
    step = F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(-1)
    return idioms.clamped(star.table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", step).select("event_id", "user_id", "carry")


@_query("SELECT a.p_partkey a, b.p_partkey b FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(floor(a.p_retailprice + 0.5)::BIGINT - floor(b.p_retailprice + 0.5)::BIGINT) <= 3 AND a.p_partkey < b.p_partkey", model=False)
def band_join_cells(spark, d):
    price = F.floor(F.col("p_retailprice") + 0.5).cast("long")
    parts = star.table(spark, d, "part")
    a = parts.select("p_brand", F.col("p_partkey").alias("a"), price.alias("x"))
    b = parts.select("p_brand", F.col("p_partkey").alias("b"), price.alias("y"))
    return idioms.band_join(a, b, "p_brand", "x", "y", 3).where("a < b").select("a", "b")


@_query("c AS (SELECT DISTINCT c_custkey % 40 x, c_custkey // 40 y FROM customer WHERE c_acctbal >= 1500), f(x, y) AS (SELECT x, y FROM c WHERE y = 0 UNION SELECT c.x, c.y FROM f JOIN c ON abs(c.x - f.x) + abs(c.y - f.y) = 1) SELECT x, y FROM f".replace("c AS", "WITH RECURSIVE c AS", 1), model=False)
def flood_fill(spark, d):
    cells = star.table(spark, d, "customer").where("c_acctbal >= 1500").select((F.col("c_custkey") % 40).alias("x"), F.floor(F.col("c_custkey") / 40).alias("y")).distinct()
    return idioms.flood(cells, cells.where("y = 0"), 40)


_POLYGON = [(100.0, 0.0), (1400.0, 2000.0), (700.0, 3500.0), (1500.0, 6000.0), (200.0, 9000.0), (600.0, 3000.0)]


def _polygon_sql() -> str:
    sides = [(a, b) for a, b in zip(_POLYGON, [*_POLYGON[1:], _POLYGON[0]], strict=True) if a[1] != b[1]]
    cross = " + ".join(f"(CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END)" for (ax, ay), (bx, by) in sides)
    return f"SELECT c_custkey FROM (SELECT c_custkey, c_custkey::DOUBLE x, c_acctbal y FROM customer) WHERE ({cross}) % 2 = 1"


@_query(_polygon_sql(), model=False)
def point_in_polygon(spark, d):
    points = star.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("y"))
    return idioms.inside(points, _POLYGON).select("c_custkey")


@_query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) r FROM (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2)) WHERE r = 1", model=False)
def mode_receiver(spark, d):
    return idioms.mode(star.table(spark, d, "events"), "user_id", "event_type")


@_query("SELECT p_brand, p_type, array_to_string(list_sort(list(DISTINCT p_size)), ',') p_size, min(p_partkey) p_partkey FROM part GROUP BY 1, 2", model=False)
def collapse_rows(spark, d):
    return idioms.collapsed(star.table(spark, d, "part"), ["p_brand", "p_type"], "p_size", "p_partkey").withColumn("p_size", F.col("p_size"))


@_query("SELECT item, room, rank FROM (SELECT item, room, row_number() OVER (PARTITION BY item ORDER BY room) AS rank FROM need) WHERE rank <= 3")
def topk_frontier(spark, d):
    return idioms.top_of_each(star.needs(spark, d), "item", [F.col("room")], 3).select("item", "room", F.col("rank").cast("long").alias("rank"))


@_query("SELECT DISTINCT l_partkey & 65535 AS word, ((l_partkey & 65535) >> 11) & 31 AS kind, l_partkey & 2047 AS number FROM lineitem", model=False)
def bit_unpack(spark, d):
    return idioms.map_entries(star.table(spark, d, "lineitem").select(F.col("l_partkey").bitwiseAND(65535).alias("word")).distinct())


@_query("SELECT item, room FROM need WHERE NOT EXISTS (SELECT 1 FROM reob WHERE reob.item = need.item AND reob.room = need.room)")
def unsatisfiable_needs(spark, d):
    return star.needs(spark, d).join(large(_had(spark, d)), ["item", "room"], "left_anti")


@_query("(SELECT item, room FROM need) UNION (SELECT item, room FROM source)")
def set_ops_union(spark, d):
    return star.needs(spark, d).union(star.sources(spark, d)).distinct()


@_query("SELECT w.src, w.dst, w.req, w.setv, coalesce(w.alt, '') alt, d.item IS NOT NULL AS priced FROM way w LEFT JOIN demand d USING (src, dst)")
def ways_with_default(spark, d):
    ways = star.ways(spark, d)
    found = ways.join(detect.edge_demands(ways), ["src", "dst"], "left")
    return found.select("src", "dst", "req", "setv", F.coalesce("alt", F.lit("")).alias("alt"), F.col("item").isNotNull().alias("priced"))


def _projections(spark, d) -> list[DataFrame]:
    return [star.ways(spark, d, r) for r in ("flag", "status")]


@_query("SELECT DISTINCT item, room FROM ban WHERE (item, room) IN (SELECT (item, room) FROM ban2)")
def reach_without(spark, d):
    items = star.table(spark, d, "part").select(F.col("p_brand").alias("item")).distinct()
    return gated.reach_without(_start(spark, d), _projections(spark, d), items)


@_query("SELECT DISTINCT item, room FROM back1 WHERE (item, room) IN (SELECT (item, room) FROM back2)")
def gated_reobtainable(spark, d):
    return gated.reobtainable(_start(spark, d), _projections(spark, d), star.sources(spark, d))


@_query("SELECT DISTINCT f.w AS value, f.seed room, n.item FROM fl f JOIN need n ON n.room = f.room WHERE n.item IN (SELECT item FROM source JOIN st ON st.room = source.room) AND NOT EXISTS (SELECT 1 FROM fl g JOIN source s ON s.room = g.room WHERE g.w = f.w AND g.seed = f.seed AND s.item = n.item)")
def register_strandings(spark, d):
    return gated.register_strandings(_start(spark, d), star.ways(spark, d), star.sources(spark, d), star.needs(spark, d))


@_query("SELECT d.item, d.room, count(DISTINCT c.b) ahead FROM dropped d JOIN clo c ON c.a = d.room AND c.b <> d.room JOIN need n ON n.item = d.item AND n.room = c.b WHERE NOT EXISTS (SELECT 1 FROM reob r WHERE r.item = d.item AND r.room = d.room) GROUP BY 1, 2")
def dangerous_sinks(spark, d):
    return gated.dangerous_sinks(star.drops(spark, d), star.needs(spark, d), _had(spark, d), lambda rooms: graph.closure(rooms, _edges(spark, d)))


@_query("SELECT DISTINCT item, room FROM dropped WHERE item IN (SELECT item FROM moved WHERE dst = 0) AND NOT EXISTS (SELECT 1 FROM mv WHERE mv.item = dropped.item AND mv.room = dropped.room AND mv.p = 0)")
def permanent_drops(spark, d):
    return gated.permanent_drops(star.moves(spark, d), star.drops(spark, d))


@_query()
def market_matching(spark, d):
    consumers = star.offers(spark, d).select("site", F.explode("alt").alias("token")).groupBy("site").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    return graph.saturating(consumers.select((F.col("site") % 50).alias("market"), F.col("site").alias("consumer"), "tokens"))
