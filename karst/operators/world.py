"""The guarded world: product walks over registers, requirement units as bans, and the findings that rest on them.

ways: src, dst, alts (array of alternatives, each an array of items; none: free), and for each register req_<r> (the value asked for, null:
any) and set_<r> (the value left, null: as before). writes: register, room, value, cost: what may be written in a room at what cost (an
array of items). steps: register, room, frm, to, cost: writes that are made from one value only. units: unit, items: what is to be
done without. A projection is a list of registers walked together; what must hold in each projection is counted over them.

A walk is labelled by what it is about (a unit, a room), so all walks of a question run as one fixpoint. Rooms and values are numbered
densely, never hashed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import guards
from karst.operators import graph
from karst.plans.fixpoint import ROWS_OUT, large, many_tasks, walks, written

FREE = "array(cast(array() as array<string>))"
#: A state before all starts: a walk that sets out there sets out from every start.
BEFORE = -(1 << 62)


def opened(alts: Column | str = "alts") -> Column:
    """Alternatives where no known one means free: one that asks for nothing."""
    alts = F.col(alts) if isinstance(alts, str) else alts
    return F.when(alts.isNull() | (F.size(alts) == 0), F.expr(FREE)).otherwise(alts)


def numbered(names: DataFrame, key: str) -> DataFrame:
    """key, place: the different values of a column, numbered from 0 in order."""
    return written(names.select(key).distinct().select(key, (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("place")))


def blocked_units(rows: DataFrame, units: DataFrame, key: str = "way") -> DataFrame:
    """key, bars: the units without which a row of alternatives can't be taken: those that every alternative asks something of.

    Counted over (row, unit, alternative) by equi-joins on the item: no row meets a unit that it does not mention.
    """
    each = rows.select(key, F.size("alts").alias("many"), F.posexplode("alts").alias("alt", "items")).select(key, "many", "alt", F.explode("items").alias("item"))
    of = units.select("unit", F.explode("items").alias("item"))
    met = each.join(of, "item").groupBy(key, "many", "unit").agg(F.count_distinct("alt").alias("n")).where("n = many")
    return met.groupBy(key).agg(F.collect_set("unit").alias("bars"))


def in_order(alt: Column) -> Column:
    """Aggregate: what alternatives (rows with nth) come to, as one array."""
    return F.array_sort(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", alt.alias("alt")))))["alt"]


def multiplied(batches):
    """way, nth, alt: of ways with alts, _items and _groups the different alternatives with the items and one item of each group, in order.

    An alternative is a row of bits, one for each item that the way mentions (in order).
    """
    for b in batches:
        for row in b.to_pylist():
            alts = [{x for x in [*a, *row["_items"]] if x is not None} for a in row["alts"]]
            groups = [sorted({x for x in g if x is not None}) for g in row["_groups"]]
            names = sorted({x for a in [*alts, *groups] for x in a})
            place, width = {x: k for k, x in enumerate(names)}, len(names) // 8 + 1
            bits = np.zeros((len(alts), width * 8), bool)
            for k, a in enumerate(alts):
                bits[k, [place[x] for x in a]] = True
            packed = _different(np.packbits(bits, axis=1))
            for g in groups:
                with_one = []
                for x in g:
                    with_one.append(packed.copy())
                    with_one[-1][:, place[x] // 8] |= 128 >> place[x] % 8
                packed = _different(np.concatenate(with_one)) if g else packed[:0]
            bits = np.unpackbits(packed, axis=1)
            # in the order of sorted lists: at each item what has it, then what has later ones only; what has no more comes first
            later = np.maximum.accumulate(bits[:, ::-1], axis=1)[:, ::-1] > 0
            digits = np.ascontiguousarray(np.where(bits > 0, 1, np.where(later, 2, 0)).astype(np.uint8))
            order = np.argsort(digits.view(f"S{digits.shape[1]}").ravel(), kind="stable")
            for k in range(0, len(order), ROWS_OUT):
                part = bits[order[k : k + ROWS_OUT]]
                own, items = np.nonzero(part)
                ends = np.searchsorted(own, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(names, pa.string()).take(pa.array(items)))
                nth = np.arange(k, k + len(part), dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"way": pa.array(np.full(len(part), row["way"], np.int64)), "nth": nth, "alt": lists})


def _different(rows: np.ndarray) -> np.ndarray:
    """The different rows of bytes."""
    width = rows.shape[1]
    return np.unique(np.ascontiguousarray(rows).view(f"S{width}").ravel()).view(np.uint8).reshape(-1, width) if len(rows) else rows


@dataclass(frozen=True)
class World:
    """Relations of a world; see the module. start: room (one or several); goals: room (may be empty); grants: item, room that hands it over unasked.

    drops: item, room that takes it away. slots: room, items, of which that room trades one for another, so that at most one is held. sites: item,
    room, site, register, values: what a place of need asks of a register (one row for each register; a null register: nothing).
    """

    ways: DataFrame
    writes: DataFrame
    steps: DataFrame
    sources: DataFrame
    needs: DataFrame
    start: DataFrame
    goals: DataFrame
    grants: DataFrame
    projections: tuple[tuple[str, ...], ...]
    drops: DataFrame | None = None
    slots: DataFrame | None = None
    sites: DataFrame | None = None

    @cached_property
    def edges(self) -> DataFrame:
        return written(self.ways.select("src", "dst").distinct())

    @cached_property
    def _domains(self) -> dict[str, tuple[DataFrame, int]]:
        out = {}
        for r in sorted({r for p in self.projections for r in p}):
            of = lambda df, c: df.where(F.col("register") == r).select(F.col(c).cast("int").alias("value"))  # noqa: B023, E731
            own = [self.ways.select(F.col(f"{k}_{r}").cast("int").alias("value")) for k in ("req", "set")]
            parts = [*own, of(self.writes, "value"), of(self.steps, "frm"), of(self.steps, "to"), self.start.select(F.lit(0).alias("value"))]
            places = numbered(reduce(DataFrame.unionAll, parts).where("value is not null"), "value")
            out[r] = places, places.count()
        return out

    def size(self, projection: tuple[str, ...]) -> int:
        """States of a room in a projection."""
        return reduce(lambda n, r: n * self._domains[r][1], projection, 1)

    def _placed(self, df: DataFrame, column: str, register: str) -> DataFrame:
        places = self._domains[register][0].select(F.col("value").alias("_v"), F.col("place").alias(f"_{column}"))
        return df.join(F.broadcast(places), F.col(column) == F.col("_v"), "left").drop("_v")

    @cached_property
    def _start_places(self) -> dict[str, int]:
        return {r: places.where("value = 0").first()["place"] for r, (places, _) in self._domains.items()}

    def moves(self, projection: tuple[str, ...], entry: DataFrame | None = None) -> DataFrame:
        """src, dst (states), room, to (rooms), alts: crossings and writes of a projection.

        entry: register, room, value that arrival forces whatever a way carries (for proofs that must not credit movement the game does
        not have); without it such writes are as optional as any other.
        """
        found = self.ways.select(F.col("src").alias("room"), F.col("dst").alias("to"), opened().alias("alts"), *(c for c in self.ways.columns if c.startswith(("req_", "set_"))))
        parts = []
        for r in projection:
            found = self._placed(self._placed(found, f"req_{r}", r), f"set_{r}", r)
            if entry is not None:
                forced = self._placed(entry.where(F.col("register") == r).select(F.col("room").alias("to"), F.col("value").alias(f"new_{r}")), f"new_{r}", r)
                found = found.join(forced, "to", "left").withColumn(f"_set_{r}", F.coalesce(f"_new_{r}", f"_set_{r}")).drop(f"new_{r}", f"_new_{r}")
            parts.append((r, F.col(f"_req_{r}"), F.col(f"_set_{r}")))
        out = [self._states(found, parts)]
        for r in projection:
            every = lambda df, frm, to: self._states(df, [(q, frm, to) if q == r else (q, F.lit(None), F.lit(None)) for q in projection])  # noqa: B023, E731
            wrote = self._placed(self.writes.where(F.col("register") == r).select("room", F.col("room").alias("to"), F.col("value").alias("w"), F.array("cost").alias("alts")), "w", r)
            out.append(every(wrote, F.lit(None), F.col("_w")))
            step = self.steps.where(F.col("register") == r).select("room", F.col("room").alias("dst"), F.col("frm").alias("f"), F.col("to").alias("t"), F.array("cost").alias("alts"))
            step = self._placed(self._placed(step, "f", r), "t", r).withColumnRenamed("dst", "to")
            out.append(every(step, F.col("_f"), F.col("_t")))
        return reduce(DataFrame.unionAll, out).where("src <> dst").distinct()

    def _states(self, df: DataFrame, parts: list[tuple[str, Column, Column]], *more: str) -> DataFrame:
        """Rows for every state that a row starts from: parts give for each register the place asked for and the place left (null: any, as before)."""
        src, dst = F.col("room").cast("long"), F.col("to").cast("long")
        for r, asked, left in parts:
            n = self._domains[r][1]
            df = df.withColumn(f"_l_{r}", left.cast("long")).withColumn(f"_at_{r}", F.explode(F.when(asked.isNull(), F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).otherwise(F.array(asked.cast("long")))))
            src, dst = src * n + F.col(f"_at_{r}"), dst * n + F.coalesce(f"_l_{r}", f"_at_{r}")
        return df.select(src.alias("src"), dst.alias("dst"), "room", "to", "alts", *more)

    def _at_start(self, projection: tuple[str, ...]) -> DataFrame:
        node = F.col("room").cast("long")
        for r in projection:
            node = node * self._domains[r][1] + self._start_places[r]
        return self.start.select(node.alias("node"))

    def _from_start(self, projection: tuple[str, ...], arcs: DataFrame) -> DataFrame:
        """Arcs (src, dst, bars) with free ones from BEFORE to every start."""
        first = self._at_start(projection).select(F.lit(BEFORE).cast("long").alias("src"), F.col("node").alias("dst"), F.array().cast("array<string>").alias("bars"))
        return arcs.select("src", "dst", F.col("bars").cast("array<string>").alias("bars")).unionAll(first)

    def room(self, projection: tuple[str, ...], node: str = "node") -> Column:
        return F.floor(F.col(node) / self.size(projection)).cast("long").alias("room")

    def values(self, states: DataFrame, projection: tuple[str, ...]) -> DataFrame:
        """room and the value of each register of states (node); other columns stay."""
        out, rest = states.withColumn("room", self.room(projection)), F.col("node") % self.size(projection)
        for r in reversed(projection):
            places, n = self._domains[r]
            out = out.withColumn("_p", (rest % n).cast("long")).join(F.broadcast(places.select(F.col("value").alias(r), F.col("place").alias("_p"))), "_p").drop("_p")
            rest = F.floor(rest / n)
        return out.drop("node")

    def states(self, projection: tuple[str, ...], entry: DataFrame | None = None) -> DataFrame:
        """node: the states reached from the start."""
        seeds = self._at_start(projection).select(F.lit(0).alias("walk"), "node", F.lit(None).cast("string").alias("ban"))
        return walks(seeds, self.moves(projection, entry).select("src", "dst", F.lit(None).cast("array<string>").alias("bars"))).select("node")

    @cached_property
    def _reached(self) -> dict[tuple[str, ...], DataFrame]:
        return {p: written(self.states(p)) for p in self.projections}

    @cached_property
    def _moves(self) -> dict[tuple[str, ...], DataFrame]:
        return {p: written(self.moves(p).withColumn("way", F.monotonically_increasing_id())) for p in self.projections}

    def _barred(self, projection: tuple[str, ...], units: DataFrame, grants: bool) -> DataFrame:
        """src, dst, bars: the units for which each move is closed; with grants also all moves out of a room that hands over one of its items."""
        moves = self._moves[projection]
        bars = blocked_units(moves, units)  # by the number of a move: rows of an alternative never carry the others
        out = moves.join(bars, "way", "left").select("src", "dst", "room", F.coalesce("bars", F.array().cast("array<string>")).alias("bars"))
        if grants:
            given = self.grants.join(units.select("unit", F.explode("items").alias("item")), "item").groupBy("room").agg(F.collect_set("unit").alias("_given"))
            out = out.join(given, "room", "left").withColumn("bars", F.array_union("bars", F.coalesce("_given", F.array().cast("array<string>"))))
        return out.select("src", "dst", "bars")

    def _in_all(self, parts: list[DataFrame], keys: list[str]) -> DataFrame:
        tagged = reduce(DataFrame.unionAll, [p.select(*keys, F.lit(k).alias("_p")) for k, p in enumerate(parts)])
        return tagged.groupBy(*keys).agg(F.count_distinct("_p").alias("_n")).where(F.col("_n") == len(parts)).select(*keys)

    def reach_without(self, units: DataFrame) -> DataFrame:
        """unit, room: reached in every projection without anything of the unit, not going on from where it is handed over unasked."""
        named, parts = written(numbered(units, "unit")), []
        for p in self.projections:
            seeds = named.select(F.col("place").alias("walk"), F.lit(BEFORE).alias("node"), F.col("unit").alias("ban"))
            found = walks(seeds, self._from_start(p, self._barred(p, units, True))).where(F.col("node") != BEFORE).join(named.withColumnRenamed("place", "walk"), "walk")
            parts.append(found.select("unit", self.room(p)).distinct())
        return written(self._in_all(parts, ["unit", "room"]))

    def reobtainable(self, units: DataFrame) -> DataFrame:
        """unit, room: in every projection a reached state of the room leads to a source of the unit without anything of the unit."""
        named, parts = written(numbered(units, "unit")), []
        at = units.select("unit", F.explode("items").alias("item")).join(self.sources, "item").select("unit", "room").distinct().join(named, "unit")
        for p in self.projections:
            live = self._reached[p]
            seeds = live.withColumn("room", self.room(p)).join(at, "room").select(F.col("place").alias("walk"), "node", F.col("unit").alias("ban"))
            inside = self._barred(p, units, False).join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi")
            back = walks(seeds, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "bars"))
            parts.append(back.join(named.withColumnRenamed("place", "walk"), "walk").select("unit", self.room(p)).distinct())
        return self._in_all(parts, ["unit", "room"])

    def rooms_after(self, crossed: DataFrame) -> DataFrame:
        """after, room: rooms reached from all states of a room (crossed: after) in every projection that has such states; itself if none has."""
        parts = []
        for k, p in enumerate(self.projections):
            seeds = self._reached[p].withColumn("room", self.room(p)).join(crossed.select(F.col("after").alias("room")).distinct(), "room", "left_semi")
            found = walks(seeds.select(F.col("room").alias("walk"), "node", F.lit(None).cast("string").alias("ban")), self._moves[p].select("src", "dst", F.lit(None).cast("array<string>").alias("bars")))
            parts.append(found.select(F.col("walk").alias("after"), self.room(p), F.lit(k).alias("projection")).distinct())
        every = written(reduce(DataFrame.unionAll, parts))
        many = every.groupBy("after").agg(F.count_distinct("projection").alias("all"))
        found = every.groupBy("after", "room").agg(F.count_distinct("projection").alias("n")).join(many, "after").where("n = all").select("after", "room")
        none = crossed.select("after").distinct().join(many, "after", "left_anti")
        return found.unionAll(none.select("after", F.col("after").alias("room")))

    @cached_property
    def _middles(self) -> dict[tuple[str, ...], tuple[DataFrame, DataFrame]]:
        """For each projection what a state in the middle of the reached ones comes to, and what comes to it (node)."""
        out = {}
        for p in self.projections:
            inside = self._moves[p].join(large(self._reached[p].withColumnRenamed("node", "src")), "src", "left_semi").select("src", "dst")
            ahead, behind, _ = graph.middle(self._reached[p].withColumnRenamed("node", "room"), inside, 16)
            out[p] = large(written(ahead)), large(written(behind))
        return out

    def rooms_after_sets(self, crossed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What rooms_after says in two tables: after, set and set, room. A room is reached after another one if it is in one of that one's sets.

        Rooms from whose states the middle of a projection is reached share what that comes to; for each only what is beside it is walked. What lies
        in the middle of every projection that has states of a room is one set for all such rooms; each room's own set is what else it reaches.
        """
        own, has, inside, asked = [], [], [], written(crossed.select(F.col("after").cast("long").alias("after")).distinct())
        for k, p in enumerate(self.projections):
            ahead, behind = self._middles[p]
            states = written(self._reached[p].withColumn("room", self.room(p)).join(asked.withColumnRenamed("after", "room"), "room", "left_semi"))
            hits = written(states.join(behind, "node", "left_semi").select("room").distinct())
            seeds = states.join(large(hits), "room", "left_anti").select("room", "node", F.lit(None).cast("string").alias("ban"))
            seeds = seeds.unionAll(states.join(large(hits), "room", "left_semi").join(ahead, "node", "left_anti").select("room", "node", F.lit("middle")))
            border = ahead.select(F.col("node").alias("dst"), F.array(F.lit("middle")).alias("bars"))
            found = walks(seeds.withColumnRenamed("room", "walk"), self._moves[p].select("src", "dst").join(border, "dst", "left").select("src", "dst", "bars"))
            own.append(found.select(F.col("walk").alias("after"), self.room(p), F.lit(k).alias("projection")).distinct())
            has.append(states.select("room").distinct().join(large(hits.withColumn("hit", F.lit(True))), "room", "left").select(F.col("room").alias("after"), F.lit(k).alias("projection"), F.coalesce("hit", F.lit(False)).alias("hit")))
            inside.append(ahead.select(self.room(p), F.lit(k).alias("projection")).distinct())
        own, has, inside = (large(written(reduce(DataFrame.unionAll, x))) for x in (own, has, inside))
        of = written(has.groupBy("after").agg(F.sort_array(F.collect_set("projection")).alias("all"), F.every("hit").alias("hit")))
        shared = own.select("after", "room").distinct().join(has.where("hit"), "after").join(inside, ["projection", "room"], "left_semi").select("after", "room", "projection")
        each = own.unionAll(shared).groupBy("after", "room").agg(F.count_distinct("projection").alias("n")).join(large(of), "after").where("n = size(all)").select("after", "room")
        none = asked.join(large(of), "after", "left_anti")
        name, common = F.concat(F.lit("room "), "after").alias("set"), F.concat(F.lit("projections "), F.array_join("all", ",")).alias("set")
        kinds = of.where("hit").select("all").distinct().select(common, F.size("all").alias("n"), F.explode("all").alias("projection"))
        middle = kinds.join(inside, "projection").groupBy("set", "n", "room").count().where("count = n").select("set", "room")
        holds = asked.select("after", name).unionAll(of.where("hit").select("after", common))
        return holds, each.select(name, "room").unionAll(none.select(name, F.col("after").alias("room"))).unionAll(middle)

    def reach_avoiding(self, rooms: DataFrame) -> DataFrame:
        """avoided, room: rooms reached from the starts in every projection without ever entering the avoided room; to set out there is not to enter. rooms: avoided."""
        found = self.reach_avoiding_sets(rooms.select(F.col("avoided").cast("long").cast("string").alias("key"), F.col("avoided").alias("room")))
        return found.select(F.col("key").cast("long").alias("avoided"), "room")

    def reach_avoiding_sets(self, sets: DataFrame) -> DataFrame:
        """key, room: rooms reached from the starts in every projection without ever entering a room of a set. sets: key (string), room."""
        shut = written(sets.groupBy(F.col("room").alias("to")).agg(F.collect_set("key").alias("bars")))
        named, parts = numbered(sets, "key"), []
        for p in self.projections:
            seeds = named.select(F.col("place").alias("walk"), F.lit(BEFORE).alias("node"), F.col("key").alias("ban"))
            arcs = self._moves[p].join(shut, "to", "left").select("src", "dst", F.when(F.col("room") != F.col("to"), F.col("bars")).alias("bars"))
            found = walks(seeds, self._from_start(p, arcs)).where(F.col("node") != BEFORE).join(named.withColumnRenamed("place", "walk"), "walk")
            parts.append(found.select("key", self.room(p)).distinct())
        return self._in_all(parts, ["key", "room"])

    def unholdable(self, rows: DataFrame) -> DataFrame:
        """src, dst, item, why: of the rows (src, dst, item), what nobody can be holding at a crossing, given what the crossing asks for.

        cost: every source of the item lies behind rooms that take away something the crossing asks for (but for its end, which takes it only
        afterwards, and rooms that hand it out again). trade: the crossing asks for another item of the same slot.
        """
        rows, out = rows.select("src", "dst", "item").distinct(), []
        if self.drops is not None:
            losing = written(self.drops.select("item", "room").distinct().join(self.sources.select("item", "room"), ["item", "room"], "left_anti"))
            edges = self.demands.join(losing.select("item").distinct(), "item", "left_semi").join(large(rows.select("src", "dst").distinct()), ["src", "dst"], "left_semi")
            edges = edges.groupBy("src", "dst").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("key", F.to_json("items"))
            edges = written(edges)  # crossings that ask for the same shun the same rooms, but for their end
            sets = written(edges.select("key", "items").distinct().select("key", F.explode("items").alias("item")).join(losing, "item").select("key", "room").distinct())
            at_end = large(sets.select("key", F.col("room").alias("dst"), F.lit(True).alias("takes")))
            many = sets.groupBy("key").agg(F.count(F.lit(1)).alias("many"))
            asked = edges.select("src", "dst", "key").join(many, "key").join(at_end, ["key", "dst"], "left").where("takes is null or many > 1")
            had = lambda keyed: self.reach_avoiding_sets(keyed).join(self.sources, "room").select("key", "item").distinct()
            lost = written(rows.join(large(asked), ["src", "dst"]).join(large(had(sets)), ["key", "item"], "left_anti"))
            # what is had without the end is had with it; the rest is walked for each end that takes something away
            ends = lost.where("takes").select("key", "dst").distinct()
            apart = sets.join(ends, "key").where("room <> dst").select(F.concat(F.col("dst").cast("string"), F.lit(" "), "key").alias("key"), "room")
            with_end = had(written(apart))
            again = lost.where("takes").withColumn("key", F.concat(F.col("dst").cast("string"), F.lit(" "), "key")).join(large(with_end), ["key", "item"], "left_anti")
            lost = lost.where("takes is null").select("src", "dst", "item").unionAll(again.select("src", "dst", "item"))
            out.append(lost.select("src", "dst", "item", F.lit("cost").alias("why")))
        if self.slots is not None:
            held = self.demands.join(self.slots.select("items", F.explode("items").alias("item")), "item").select("src", "dst", F.explode("items").alias("item")).distinct()
            out.append(rows.join(held, ["src", "dst", "item"]).join(self.demands, ["src", "dst", "item"], "left_anti").select("src", "dst", "item", F.lit("trade").alias("why")))
        out.append(rows.select("src", "dst", "item", F.lit("").alias("why")).limit(0))
        return reduce(DataFrame.unionAll, out).groupBy("src", "dst", "item").agg(F.min("why").alias("why"))

    @cached_property
    def _numbered_ways(self) -> DataFrame:
        return written(self.ways.withColumn("way", F.monotonically_increasing_id()))

    @cached_property
    def _crossed(self) -> dict[tuple[str, ...], DataFrame]:
        """For each projection way, node: the states right after a way has been taken in any reached state that it allows.

        Only ways that ask for or leave something in a register of the projection have rows: others say nothing of what a crossing commits to.
        """
        out = {}
        for p in self.projections:
            touched = reduce(lambda x, y: x | y, [F.col(f"{k}_{r}").isNotNull() for r in p for k in ("req", "set")])
            found = self._numbered_ways.where(touched).select("way", F.col("src").alias("room"), F.col("dst").alias("to"), F.lit(None).cast("array<array<string>>").alias("alts"), *(f"{k}_{r}" for r in p for k in ("req", "set")))
            parts = []
            for r in p:
                found = self._placed(self._placed(found, f"req_{r}", r), f"set_{r}", r)
                parts.append((r, F.col(f"_req_{r}"), F.col(f"_set_{r}")))
            taken = self._states(found, parts, "way").join(large(self._reached[p].withColumnRenamed("node", "src")), "src", "left_semi")
            out[p] = large(written(taken.select("way", F.col("dst").alias("node")).distinct()))
        return out

    def _places(self, projection: tuple[str, ...]) -> DataFrame:
        """item, node: reached states in which a need can be met."""
        there = self._reached[projection].withColumn("room", self.room(projection))
        if self.sites is None:
            return there.join(self.needs.select("item", "room"), "room").select("item", "node").distinct()
        musts = self.sites.where(F.col("register").isin(*projection))
        bound = written(musts.select("item", "room", "site", "register", "values").distinct())
        open_ = self.sites.select("item", "room", "site").distinct().join(bound.select("item", "room", "site"), ["item", "room", "site"], "left_anti").select("item", "room")
        bare = self.needs.select("item", "room").distinct().join(self.sites.select("item", "room"), ["item", "room"], "left_anti")
        free = there.join(open_.unionAll(bare).distinct(), "room").select("item", "node")
        many = bound.groupBy("item", "room", "site").agg(F.count(F.lit(1)).alias("_all"))
        value = F.coalesce(*(F.when(F.col("register") == r, F.col(r)) for r in projection))
        met = self.values(self._reached[projection].withColumn("state", F.col("node")), projection).join(bound, "room").where(F.array_contains("values", value))
        met = met.groupBy("state", "item", "room", "site").agg(F.count(F.lit(1)).alias("_n")).join(many, ["item", "room", "site"]).where("_n = _all")
        return free.unionAll(met.select("item", F.col("state").alias("node"))).distinct()

    def _live(self, projection: tuple[str, ...], asked: DataFrame) -> DataFrame:
        """way, item: of the rows (way, item), needs that some state after the way can still come to. One walk backward for each item."""
        named = numbered(asked, "item")
        seeds = self._places(projection).join(named, "item").select(F.col("place").alias("walk"), "node", F.lit(None).cast("string").alias("ban"))
        inside = self._moves[projection].join(large(self._reached[projection].withColumnRenamed("node", "src")), "src", "left_semi")
        back = walks(seeds, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(None).cast("array<string>").alias("bars")))
        at = asked.join(self._crossed[projection], "way").join(named, "item")
        return at.join(back.withColumnRenamed("walk", "place"), ["place", "node"]).select("way", "item").distinct()

    def retired(self, rows: DataFrame) -> DataFrame:
        """src, dst, item: of the rows (src, dst, item), needs that a crossing ends, as what it commits to leaves no place of need within reach.

        That takes evidence for every way of the crossing: a projection in which it can be taken and after which no need is live. Where a way
        touches no register, or can't be taken in any reached state, the need stays.
        """
        ways = self._numbered_ways.select("way", "src", "dst")
        asked = written(rows.select("src", "dst", "item").distinct().join(self.needs.select("item").distinct(), "item", "left_semi").join(ways, ["src", "dst"]))
        dead = [asked.join(self._crossed[p].select("way").distinct(), "way", "left_semi").join(large(self._live(p, asked.select("way", "item").distinct())), ["way", "item"], "left_anti") for p in self.projections]
        gone = reduce(DataFrame.unionAll, dead).select("src", "dst", "item", "way").distinct().groupBy("src", "dst", "item").agg(F.count(F.lit(1)).alias("_n"))
        every = asked.groupBy("src", "dst", "item").agg(F.count(F.lit(1)).alias("_all"))
        return gone.join(every, ["src", "dst", "item"]).where("_n = _all").select("src", "dst", "item")

    def entry_frontier(self, rooms: DataFrame) -> DataFrame:
        """room, frm: crossings into a room from where it has not been entered yet. rooms: room."""
        outside = self.reach_avoiding(rooms.select(F.col("room").alias("avoided"))).select(F.col("avoided").alias("dst"), F.col("room").alias("src"))
        return self.edges.where("src <> dst").join(outside, ["src", "dst"]).select(F.col("dst").alias("room"), F.col("src").alias("frm"))

    @cached_property
    def freely_reversible(self) -> DataFrame:
        """src, dst: edges with a way back one alternative of which asks for nothing."""
        back = self.ways.where(F.exists(opened(), lambda a: F.size(a) == 0)).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
        return self.edges.join(back, ["src", "dst"], "left_semi")

    @cached_property
    def demands(self) -> DataFrame:
        """src, dst, item: items that every alternative of every way of an edge asks for."""
        each = self.ways.select("src", "dst", F.explode(opened()).alias("alt"))
        many = each.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("all"))
        found = each.select("src", "dst", F.explode(F.array_distinct("alt")).alias("item")).groupBy("src", "dst", "item").agg(F.count(F.lit(1)).alias("n"))
        return written(found.join(many, ["src", "dst"]).where("n = all").select("src", "dst", "item"))

    @cached_property
    def groups(self) -> DataFrame:
        """room, items: alternatives of one way out of a room that have nothing in common, none free: any of the items will do."""
        alts = F.array_distinct(F.transform("alts", lambda a: F.array_sort(a)))
        said = F.col("mentions") if "mentions" in self.ways.columns else F.lit(None).cast("array<string>")
        found = self.ways.select(F.col("src").alias("room"), alts.alias("alts"), said.alias("said")).where("size(alts) >= 2 and not exists(alts, a -> size(a) = 0)")
        return written(found.where(F.size(guards.common(F.col("alts"))) == 0).select("room", F.coalesce("said", guards.mentioned(F.col("alts"))).alias("items")).distinct())

    @cached_property
    def units(self) -> DataFrame:
        """unit, items: single items that are needed somewhere, and groups, that have a source. unit: the items, joined."""
        had = self.sources.select("item").distinct()
        single = self.needs.select("item").distinct().join(had, "item", "left_semi").select(F.array("item").alias("items"))
        groups = self.groups.select("items").distinct()
        some = groups.select("items", F.explode("items").alias("item")).join(had, "item", "left_semi").select("items").distinct()
        return written(single.unionAll(some).distinct().select(F.array_join("items", "|").alias("unit"), "items"))

    @cached_property
    def needed(self) -> DataFrame:
        """unit, room: where a unit is faced: rooms that need one of its items and are reached without that; a single item not where a group covers it."""
        items = written(self.units.where("size(items) = 1").select("unit", "items"))
        every = self.units.select("unit", F.explode("items").alias("item"), (F.size("items") > 1).alias("group"))
        lone = self.needs.select("item").distinct().select(F.col("item").alias("unit"), F.array("item").alias("items"))
        faced = self.needs.join(self.reach_without(lone).withColumnRenamed("unit", "item"), ["item", "room"]).distinct()
        found = every.join(faced, "item").select("unit", "group", "room").distinct()
        covered = self.groups.select("room", F.explode("items").alias("unit")).distinct()
        single = found.where("not group").join(covered, ["unit", "room"], "left_anti").join(items.select("unit"), "unit", "left_semi")
        return written(single.select("unit", "room").unionAll(found.where("group").select("unit", "room")))

    @cached_property
    def reach(self) -> DataFrame:
        """room: reached over edges whatever guards them."""
        seeds = self.start.select(F.lit(0).alias("walk"), F.col("room").alias("node"), F.lit(None).cast("string").alias("ban"))
        return written(walks(seeds, self.edges.select("src", "dst", F.lit(None).cast("array<string>").alias("bars"))).select(F.col("node").alias("room")))

    @cached_property
    def _stranded(self) -> DataFrame:
        """src, dst, unit, why (null: a finding): crossings after which a unit is lost, with the reason for which a single item is no finding."""
        had = written(self.reobtainable(self.units))
        oneway = self.edges.join(self.reach.withColumnRenamed("room", "src"), "src", "left_semi").join(self.freely_reversible, ["src", "dst"], "left_anti")
        holds, sets = (large(written(x)) for x in self.rooms_after_sets(oneway.select(F.col("dst").alias("after"))))
        if not self.goals.isEmpty():
            won = sets.join(self.goals, "room", "left_semi").select("set").distinct()
            oneway = oneway.join(large(holds.join(won, "set", "left_semi").select(F.col("after").alias("dst"))), "dst", "left_semi")
        ahead = sets.join(self.needed, "room").select("set", "unit").distinct().join(holds, "set").select(F.col("after").alias("dst"), "unit").distinct()
        lost = ahead.join(had.withColumnRenamed("room", "dst"), ["unit", "dst"], "left_anti")
        found = oneway.join(lost, "dst").join(had.withColumnRenamed("room", "src"), ["unit", "src"], "left_semi")
        found = written(found.select("src", "dst", "unit"))
        single = written(found.join(self.units.where("size(items) = 1"), "unit", "left_semi").withColumnRenamed("unit", "item"))
        forced = single.join(self.demands, ["src", "dst", "item"], "left_semi").select("src", "dst", "item", F.lit("forced").alias("why"))
        rest = written(single.join(forced, ["src", "dst", "item"], "left_anti"))
        why = forced.unionAll(self.unholdable(rest).withColumn("why", F.concat(F.lit("unholdable: "), "why"))).unionAll(self.retired(rest).withColumn("why", F.lit("retired")))
        why = why.groupBy("src", "dst", F.col("item").alias("unit")).agg(F.max("why").alias("why"))  # unholdable before retired
        return written(found.join(why, ["src", "dst", "unit"], "left"))

    def strandings(self) -> DataFrame:
        """src, dst, unit: crossings without a free way back after which a unit that was to be had is lost and still asked for.

        The crossing is reached, and a goal can still be reached after it (if there are goals). Of single items those are left out that the
        crossing itself asks for (forced, not missed), that nobody can hold there, and whose need the crossing ends; see dropped().
        """
        return self._stranded.where("why is null").select("src", "dst", "unit")

    def dropped(self) -> DataFrame:
        """src, dst, unit, why (forced, unholdable: cost, unholdable: trade, retired): strandings that are no findings."""
        return self._stranded.where("why is not null")

    def group_strandings(self) -> DataFrame:
        """room, unit: groups that are faced where none of their items is held and none can be had any more."""
        groups = self.groups.withColumn("unit", F.array_join("items", "|"))
        units = groups.select("unit", "items").distinct()
        found = groups.select("room", "unit").join(self.reach, "room", "left_semi").join(self.reach_without(units), ["unit", "room"], "left_semi")
        return found.join(self.reobtainable(units), ["unit", "room"], "left_anti").select("room", "unit").distinct()

    def specs(self) -> DataFrame:
        """src, dst, items, groups: one guard for each edge with strandings: the items to hold, and groups of which any will do."""
        found = self.strandings().join(self.units, "unit")
        one = F.size("items") == 1
        items = F.sort_array(F.collect_set(F.when(one, F.element_at("items", 1))))
        return found.groupBy("src", "dst").agg(items.alias("items"), F.sort_array(F.collect_set(F.when(~one, F.col("items")))).alias("groups"))

    def unsatisfiable(self, specs: DataFrame) -> DataFrame:
        """src, dst, item: items of a spec that can't be had before its crossing."""
        asked = specs.select("src", "dst", F.explode("items").alias("item"))
        lone = asked.select(F.col("item").alias("unit"), F.array("item").alias("items")).distinct()
        had = self.reobtainable(lone).select(F.col("unit").alias("item"), F.col("room").alias("src"))
        return asked.join(had, ["item", "src"], "left_anti").select("src", "dst", "item")

    def _guarded(self, specs: DataFrame) -> DataFrame:
        """The ways with _items and _groups of their edge's spec (null: none)."""
        wanted = specs.select("src", "dst", F.col("items").alias("_items"), F.col("groups").alias("_groups"))
        return self.ways.join(wanted, ["src", "dst"], "left")

    def guarded_alternatives(self, specs: DataFrame) -> DataFrame:
        """The ways that specs (src, dst, items, groups) guard, a row for each alternative: way (a number), their columns but alts, nth (order, from 0), alt.

        Each alternative also asks for the items and for one of each group; equal ones are one, after each group, so that nothing grows
        beyond the different ones. As those may be many (all ways to choose), they are rows, and a way's are made in one task. A group of
        nothing leaves no alternative: one row with neither nth nor alt.
        """
        found = written(self._guarded(specs).where("_items is not null").withColumn("way", F.monotonically_increasing_id()))
        asked = found.select("way", opened().alias("alts"), "_items", "_groups").repartition(many_tasks(found.sparkSession), "way")
        each = large(asked.mapInArrow(multiplied, "way long, nth long, alt array<string>"))
        return found.drop("alts", "_items", "_groups").join(each, "way", "left")

    def guarded(self, specs: DataFrame) -> World:
        """The world with specs (src, dst, items, groups) put on its edges: each alternative also asks for the items and for one of each group."""
        keep = [c for c in self.ways.columns if c != "alts"]
        each = self.guarded_alternatives(specs).groupBy("way", *keep).agg(in_order(F.col("alt")).alias("alts"))
        rest = self.ways.join(specs.select("src", "dst"), ["src", "dst"], "left_anti")
        return replace(self, ways=written(rest.select(*self.ways.columns).unionAll(each.select(*self.ways.columns))))

    def guarded_minimal(self, specs: DataFrame) -> World:
        """As guarded, without alternatives that ask for all that another one asks for and more, and with what all of them mention.

        Nothing tells the two worlds apart: a way is closed, free, or asks for an item in all alternatives, just as its minimal ones; only
        groups name whatever an alternative mentions. The minimal ones are few where all ways to choose are millions.
        """
        plain = F.transform(opened(), lambda a: F.array_compact(F.array_union(a, F.col("_items"))))
        alts = F.aggregate("_groups", guards.minimal(plain), lambda acc, g: guards.conjoined(acc, F.transform(g, lambda x: F.array(x))))
        said = F.array_sort(F.array_distinct(F.concat(F.flatten(plain), F.flatten("_groups"))))
        on = F.col("_items").isNotNull()
        ways = self._guarded(specs).select(*[c for c in self.ways.columns if c != "alts"], F.when(on, alts).otherwise(F.col("alts")).alias("alts"), F.when(on, said).alias("mentions"))
        return replace(self, ways=written(ways))

    def verified(self, specs: DataFrame) -> DataFrame:
        """kind, unit, change (fixed, remaining, new): single items that are stranded, and groups, before the guards and after them."""
        after = self.guarded_minimal(specs)
        each = []
        for world in (self, after):
            items = world.strandings().join(self.units.where("size(items) = 1"), "unit", "left_semi").select(F.lit("item").alias("kind"), "unit")
            each.append(items.unionAll(world.group_strandings().select(F.lit("group"), "unit")).distinct())
        both = each[0].withColumn("b", F.lit(1)).join(each[1].withColumn("a", F.lit(1)), ["kind", "unit"], "full")
        return both.select("kind", "unit", F.when(F.col("a").isNull(), "fixed").when(F.col("b").isNull(), "new").otherwise("remaining").alias("change"))
