"""Routes over free cells: costs with straight and diagonal steps, paths, and way-points in line of sight.

Costs are found in tiles, as many tiles at once as there are: a task holds a tile and the rim of its neighbours
and spreads all it knows as far as the tile goes; rounds follow until no cell changes. A cost is kept as two
numbers of steps, straight and diagonal ones, so equal costs are equal exactly, and where a path comes from is
read from the final costs rather than remembered. Paths are followed back tile by tile, all goals at once. Way-points are
cut out where a straight line is free: its samples, half a cell apart, are met with the free cells by equality.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.operators.shared import dropped, kept

#: A cell's eight neighbours.
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
#: Goals in one copy of a tile when paths are followed, and way-points that are looked at from another at once.
GOALS, AHEAD = 50_000, 256


def cost(straight: Column | str = "straight", diagonal: Column | str = "diagonal") -> Column:
    """The length of so many steps, in cells."""
    at = lambda c: F.col(c) if isinstance(c, str) else c
    return at(straight) + at(diagonal) * F.sqrt(F.lit(2.0))


def _tile(u: Column, v: Column, tile: int) -> tuple[Column, Column]:
    return F.floor(u / tile), F.floor(v / tile)


def _spread(tile: int):
    """The step of one round in one tile; own cells come back with their costs and whether these changed."""
    root = 2.0**0.5

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        u0, v0 = int(pdf.iu.min()), int(pdf.iv.min())
        shape = (int(pdf.iu.max()) - u0 + 1, int(pdf.iv.max()) - v0 + 1)
        at = (pdf.iu.to_numpy() - u0, pdf.iv.to_numpy() - v0)
        own, cost = np.zeros(shape, bool), np.full(shape, np.inf)
        steps = np.zeros((2, *shape), np.int64)
        mine, known = pdf.own.to_numpy(), pdf.straight.notna().to_numpy()
        own[at[0][mine], at[1][mine]] = True
        for i, c in enumerate(("straight", "diagonal")):
            steps[i][at[0][known], at[1][known]] = pdf[c].to_numpy()[known].astype(np.int64)
        cost[at[0][known], at[1][known]] = (steps[0] + steps[1] * root)[at[0][known], at[1][known]]
        before = cost.copy()
        heap = list(zip(cost[at[0][known], at[1][known]].tolist(), at[0][known].tolist(), at[1][known].tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            c, u, v = heapq.heappop(heap)
            if c > cost[u, v]:
                continue
            for i, j in AROUND:
                x, y = u + i, v + j
                if not (0 <= x < shape[0] and 0 <= y < shape[1]) or not own[x, y]:
                    continue
                s, d = steps[0, u, v] + (i == 0 or j == 0), steps[1, u, v] + (i != 0 and j != 0)
                new = s + d * root
                if new < cost[x, y]:
                    cost[x, y], steps[0, x, y], steps[1, x, y] = new, s, d
                    heapq.heappush(heap, (new, x, y))
        x, y = np.nonzero(own)
        reached = np.isfinite(cost[x, y])
        out = pd.DataFrame({"iu": x + u0, "iv": y + v0, "changed": cost[x, y] != before[x, y]})
        for i, c in enumerate(("straight", "diagonal")):
            out[c] = pd.array(np.where(reached, steps[i][x, y], 0), "Int64")
            out.loc[~reached, c] = pd.NA
        return out[["iu", "iv", "straight", "diagonal", "changed"]]

    return step


def costs(cells: DataFrame, starts: DataFrame, tile: int = 64) -> DataFrame:
    """iu, iv, straight, diagonal, from_u, from_v of every cell of cells (iu, iv) that can be reached from starts (iu, iv) over eight neighbours.

    straight and diagonal are the steps of the cheapest way (a diagonal one costs the root of 2); from is the
    cell before it, of several equally cheap ones the first by iu and iv, and null at a start. A start outside
    cells doesn't count. Rounds follow as often as a path crosses tiles; each is written, and the one before deleted."""
    cells = cells.select(F.col("iu").cast("long"), F.col("iv").cast("long")).distinct()
    first = starts.select("iu", "iv").distinct().withColumns({"straight": F.lit(0).cast("long"), "diagonal": F.lit(0).cast("long"), "changed": F.lit(True)})
    state = kept(cells.join(first, ["iu", "iv"], "left").withColumn("changed", F.coalesce("changed", F.lit(False))), "costs")
    step, schema = _spread(tile), "iu long, iv long, straight long, diagonal long, changed boolean"
    while True:
        near = [F.struct(*[c.alias(n) for c, n in zip(_tile(F.col("iu") + i, F.col("iv") + j, tile), ("tu", "tv"), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        # a tile that no changed cell lies in or beside stays as it is
        awake = state.filter("changed").select(F.explode(F.array_distinct(F.array(*near))).alias("t")).select("t.*").distinct()
        if awake.isEmpty():
            break
        mine = F.struct(*[c.alias(n) for c, n in zip(_tile(F.col("iu"), F.col("iv"), tile), ("tu", "tv"), strict=True)])
        dealt = state.select("iu", "iv", "straight", "diagonal", F.explode(F.array_distinct(F.array(*near))).alias("t"), mine.alias("m"))
        dealt = dealt.select("iu", "iv", "straight", "diagonal", "t.tu", "t.tv", (F.col("t") == F.col("m")).alias("own")).join(awake, ["tu", "tv"], "left_semi")
        asleep = state.withColumns(dict(zip(("tu", "tv"), _tile(F.col("iu"), F.col("iv"), tile), strict=True))).join(awake, ["tu", "tv"], "left_anti").select("iu", "iv", "straight", "diagonal", F.lit(False).alias("changed"))
        last, state = state, kept(dealt.groupBy("tu", "tv").applyInPandas(step, schema).unionByName(asleep), "costs")
        dropped(last)
    found = state.filter("straight IS NOT NULL").select("iu", "iv", "straight", "diagonal")
    offers = found.select(F.explode(F.array(*[F.struct((F.col("iu") + i).alias("iu"), (F.col("iv") + j).alias("iv"), (F.col("straight") + int(i == 0 or j == 0)).alias("straight"), (F.col("diagonal") + int(i != 0 and j != 0)).alias("diagonal")) for i, j in AROUND])).alias("o"), F.struct(F.col("iu").alias("from_u"), F.col("iv").alias("from_v")).alias("f")).select("o.*", "f")
    best = offers.groupBy("iu", "iv", "straight", "diagonal").agg(F.min("f").alias("f"))
    return found.join(best, ["iu", "iv", "straight", "diagonal"], "left").select("iu", "iv", "straight", "diagonal", "f.from_u", "f.from_v")


def paths(found: DataFrame, goals: DataFrame, tile: int = 64) -> DataFrame:
    """goal_u, goal_v, back, iu, iv: the cells of the way to each goal (iu, iv), back counting from 0 at the goal; found is what costs() gives.

    Goals that can't be reached have no rows, equal goals one path. Each round follows all paths to the border of their tile."""
    asked = goals.select(F.col("iu").cast("long").alias("goal_u"), F.col("iv").cast("long").alias("goal_v")).distinct()
    pointers = kept(found.select("iu", "iv", "from_u", "from_v", *[c.alias(n) for c, n in zip(_tile(F.col("iu"), F.col("iv"), tile), ("tu", "tv"), strict=True)]), "pointers")
    asked = asked.join(pointers.select(F.col("iu").alias("goal_u"), F.col("iv").alias("goal_v")), ["goal_u", "goal_v"], "left_semi")
    at = kept(asked.select("goal_u", "goal_v", F.lit(0).cast("long").alias("back"), F.col("goal_u").alias("iu"), F.col("goal_v").alias("iv"), F.lit(True).alias("going")), "paths")
    done = None
    copies = max(1, -(-at.count() // GOALS))  # of each tile, so that many paths through one don't meet in one task

    def follow(key: tuple, going: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        before = dict(zip(zip(cells.iu.tolist(), cells.iv.tolist(), strict=True), zip(cells.from_u.tolist(), cells.from_v.tolist(), strict=True), strict=True))
        out = []
        for g in zip(going.goal_u.tolist(), going.goal_v.tolist(), going.back.tolist(), going.iu.tolist(), going.iv.tolist(), strict=True):
            goal, back, now = g[:2], g[2], g[3:]
            while now in before:
                out.append((*goal, back, *now, False))
                u, v = before[now]
                if u is None or u != u:  # a start
                    break
                now, back = (int(u), int(v)), back + 1
            else:
                out.append((*goal, back, *now, True))
        return pd.DataFrame(out, columns=["goal_u", "goal_v", "back", "iu", "iv", "going"])

    copy = F.pmod(F.xxhash64("goal_u", "goal_v"), F.lit(copies)).alias("copy")
    held = pointers.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    while not at.isEmpty():
        going = at.select("goal_u", "goal_v", "back", "iu", "iv", *[c.alias(n) for c, n in zip(_tile(F.col("iu"), F.col("iv"), tile), ("tu", "tv"), strict=True)], copy)
        new = kept(going.groupBy("tu", "tv", "copy").cogroup(held.join(going.select("tu", "tv", "copy").distinct(), ["tu", "tv", "copy"], "left_semi").groupBy("tu", "tv", "copy")).applyInPandas(follow, "goal_u long, goal_v long, back long, iu long, iv long, going boolean"), "paths")
        dropped(at)
        rows = new.filter("NOT going").drop("going")
        done = rows if done is None else done.unionByName(rows)
        at = kept(new.filter("going"), "paths")
    return at.drop("going") if done is None else done


def way_points(along: DataFrame, free: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """goal_u, goal_v, place (from 0 at the start), iu, iv: of each path of paths() the cells that are left when each way-point jumps to the farthest later cell in its line of sight.

    A line is sampled at steps of half a cell at most, its ends, the middles of cells, included; each sample must
    lie in a free cell (iu, iv). The next cell of a path is in sight always. Rounds follow as often as a path has
    way-points, or more where none of the ahead farthest cells is in sight."""
    last = along.groupBy("goal_u", "goal_v").agg(F.max("back").alias("last"))
    cells = kept(along.join(last, ["goal_u", "goal_v"]).select("goal_u", "goal_v", (F.col("last") - F.col("back")).alias("place"), "iu", "iv", "last"), "path-cells")
    free = kept(free.select("iu", "iv").distinct(), "free-cells")
    at = kept(cells.filter("place = 0").select("goal_u", "goal_v", "place", "iu", "iv", "last", F.col("last").alias("top"), F.lit(True).alias("chosen")), "way-points")
    done = None
    goal = ["goal_u", "goal_v"]
    while True:
        here = at.filter("chosen").select(*goal, "place", "iu", "iv")
        done = here if done is None else done.unionByName(here)
        now = at.filter("place < last").select(*goal, F.col("place").alias("p"), F.col("iu").alias("pu"), F.col("iv").alias("pv"), "last", "top")
        if now.isEmpty():
            return done
        seen = cells.select(*goal, "place", "iu", "iv").join(now, goal).filter(F.col("place").between(F.greatest(F.col("p") + 1, F.col("top") - ahead + 1), F.col("top")))
        run = [F.col("iu") - F.col("pu"), F.col("iv") - F.col("pv")]
        steps = F.greatest(F.ceil(F.sqrt(run[0] * run[0] + run[1] * run[1]) / 0.5), F.lit(1).cast("long"))
        tested = seen.filter("place > p + 1").withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
        t = F.col("k") / F.col("steps")
        sample = [F.floor((F.col(f"p{c}") + 0.5) + t * ((F.col(f"i{c}") + 0.5) - (F.col(f"p{c}") + 0.5))).alias(f"i{c}") for c in "uv"]
        tested = tested.select(*goal, "place", *sample).distinct()
        blocked = tested.join(free, ["iu", "iv"], "left_anti").select(*goal, "place").distinct()
        clear = seen.join(blocked, [*goal, "place"], "left_anti")
        best = clear.groupBy(*goal).agg(F.max_by(F.struct("place", "iu", "iv"), "place").alias("b"))
        # without a clear cell among those the next ones follow, down to the cell after the way-point, which is always clear
        turn = now.join(best, goal, "left")
        new = turn.select(*goal, F.coalesce("b.place", "p").alias("place"), F.coalesce("b.iu", "pu").alias("iu"), F.coalesce("b.iv", "pv").alias("iv"), "last", F.when(F.col("b").isNotNull(), F.col("last")).otherwise(F.col("top") - ahead).alias("top"), F.col("b").isNotNull().alias("chosen"))
        at = kept(new, "way-points")


def routes(cells: DataFrame, starts: DataFrame, goals: DataFrame, tile: int = 64) -> DataFrame:
    """goal_u, goal_v, reached, cost, cells and way_points (iu, iv, from the start to the goal) of each distinct goal (iu, iv).

    A goal outside cells, or in a region without a start, isn't reached; its cost and way-points are null."""
    found = kept(costs(cells, starts, tile), "route-costs")
    along = kept(paths(found, goals, tile), "route-paths")
    points = way_points(along, cells).groupBy("goal_u", "goal_v").agg(F.array_sort(F.collect_list(F.struct("place", "iu", "iv"))).alias("w"))
    points = points.select("goal_u", "goal_v", F.transform("w", lambda x: F.struct(x["iu"].alias("iu"), x["iv"].alias("iv"))).alias("way_points"))
    n = along.groupBy("goal_u", "goal_v").agg(F.count("*").alias("cells"))
    asked = goals.select(F.col("iu").cast("long").alias("goal_u"), F.col("iv").cast("long").alias("goal_v")).distinct()
    price = found.select(F.col("iu").alias("goal_u"), F.col("iv").alias("goal_v"), cost().alias("cost"))
    out = asked.join(price, ["goal_u", "goal_v"], "left").join(n, ["goal_u", "goal_v"], "left").join(points, ["goal_u", "goal_v"], "left")
    return out.select("goal_u", "goal_v", F.col("cost").isNotNull().alias("reached"), "cost", F.coalesce("cells", F.lit(0)).alias("cells"), "way_points")
