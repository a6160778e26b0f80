"""Strongly connected components: nodes on cycles, in rounds that don't follow the diameter; of one graph or of many at once.

Nodes get numbers, edges become pairs of them. Then, again and again:

* Chains go. A node with one incoming edge points to where it comes from, and pointers double: in a logarithmic number of rounds each chain knows whether it
  hangs on a node without incoming edges (no cycle passes it), on a ring (which is a component) or on a node with more. The same against the edges' direction.
* Every node is a pivot. Each takes the least number among the nodes that lead to it, and the least among those that it leads to, in one table: a round passes
  numbers along edges and follows them (what leads to my least number leads to me), so that they cross long paths by leaps. Only numbers that moved are passed
  along. A node whose two numbers are the same is in that number's component; edges between nodes of different numbers lie on no cycle and go.

Every step is a join or a grouped minimum. Numbers are scattered, so that the order in which nodes are named doesn't matter. Graphs whose numbers have come to
rest leave the rounds.

Rounds are for graphs of many edges. Those of SMALL edges at most, and what rounds leave of a graph once it is as small, are settled each by one task: they
cross the network once. Where edges are many beside nodes, the components of a few edges of each node come first; nodes of one become one node, and all edges
then lie between these, few of them different.

Rounds' tables of nodes are not broadcast: as files they are a small part of what they are in memory, and each would go through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.operators.reach import union
from depsight.tables import dropped, written

#: Edges of a graph that one task settles at most, whatever the tables' size.
SMALL = 1 << 19
#: Edges for each node above which a few of them come first.
DENSE = 8
#: Chains are looked for again while a pass takes this share of the edges.
SHARE = 0.25
#: Graphs at rest leave the rounds once so few of all nodes still move.
FEW_MOVE = 0.25


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("d").alias("s"), F.col("s").alias("d"))


def unchained(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges (s, d) without those of chains that no cycle passes or that hang on a ring; and k, root of the rings' nodes."""
    into = written(edges.groupBy("d").agg(F.count("*").alias("n"), F.min("s").alias("u")), "degrees")
    above = into.select(F.col("d").alias("to"), F.col("n").alias("above"))
    end = F.when(F.col("above").isNull(), "root").when(F.col("above") > 1, "open")
    chain = written(into.where("n = 1").select(F.col("d").alias("k"), F.col("u").alias("to")).join(above.hint("merge"), "to", "left").select("k", "to", F.col("k").alias("least"), end.alias("end")), "chain")
    starts = edges.select("s").distinct().join(into.select(F.col("d").alias("s")).hint("merge"), "s", "left_anti")
    if chain.isEmpty() and starts.isEmpty():
        return edges, None
    loose = chain.where("end IS NULL").count()
    ring, images = False, -1
    while loose:
        up = chain.select(F.col("k").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("end").alias("_end"))
        open_ = chain.where("end IS NULL").join(up.hint("merge"), "to")
        jumped = written(chain.where("end IS NOT NULL").unionByName(open_.select("k", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), F.col("_end").alias("end"), (F.col("_least") < F.col("least")).alias("moved")), allowMissingColumns=True), "jump")
        dropped(chain)
        chain = jumped
        now = chain.where("end IS NULL").agg(F.count("*"), F.count(F.when(F.col("moved"), 1)), F.countDistinct("to")).first()
        # a jump that ends no chain: all that is left leads to rings; there pointers go on until only rings' nodes are pointed at and know their ring's least
        ring = ring or now[0] == loose
        if ring and now[1] == 0 and now[2] == images:
            break
        loose, images = now[0], now[2]
        chain = chain.drop("moved")
    rings = None
    if loose:
        pointed = chain.where("end IS NULL").select(F.col("to").alias("k")).distinct()
        rings = written(chain.join(pointed.hint("merge"), "k", "left_semi").select("k", F.col("least").alias("root")), "rings")
    gone = starts.union(chain.where("end IS NULL OR end = 'root'").select("k"))
    left = written(edges.join(gone.hint("merge"), "s", "left_anti"), "unchained")
    dropped(into)
    dropped(chain)
    return left, rings


def numbered(edges: DataFrame) -> DataFrame:
    """k, g, f, b of each node on the edges (s, d, with their graph g): the least number that leads to it and the least that it leads to, itself included."""
    labels = written(edges.select("g", F.explode(F.array("s", "d")).alias("k")).distinct().select("g", "k", F.col("k").alias("f"), F.col("k").alias("b"), F.lit(True).alias("f_moved"), F.lit(True).alias("b_moved")), "numbers")
    rest = []
    none = F.lit(None).cast("long")
    while True:
        f, b = labels.where("f_moved").select(F.col("k").alias("_k"), F.col("f").alias("_f")), labels.where("b_moved").select(F.col("k").alias("_k"), F.col("b").alias("_b"))
        of = labels.select(F.col("k").alias("_k"), F.col("f").alias("_f"), F.col("b").alias("_b"))
        come = union([
            edges.join(f.hint("merge"), F.col("s") == F.col("_k")).select(F.col("d").alias("k"), F.col("_f").alias("f"), none.alias("b")),
            edges.join(b.hint("merge"), F.col("d") == F.col("_k")).select(F.col("s").alias("k"), none.alias("f"), F.col("_b").alias("b")),
            labels.where("f <> k").join(of.hint("merge"), F.col("f") == F.col("_k")).where("_f < f").select("k", F.col("_f").alias("f"), none.alias("b")),
            labels.where("b <> k").join(of.hint("merge"), F.col("b") == F.col("_k")).where("_b < b").select("k", none.alias("f"), F.col("_b").alias("b")),
        ])
        least = come.groupBy("k").agg(F.min("f").alias("_f"), F.min("b").alias("_b"))
        moved = lambda c: F.coalesce(F.col(f"_{c}") < F.col(c), F.lit(False))
        new = written(labels.join(least.hint("merge"), "k", "left").select("g", "k", F.least("f", "_f").alias("f"), F.least("b", "_b").alias("b"), moved("f").alias("f_moved"), moved("b").alias("b_moved")), "numbers")
        dropped(labels)
        labels = new
        rows, moving, graphs = labels.agg(F.count("*"), F.count(F.when(F.col("f_moved") | F.col("b_moved"), 1)), F.countDistinct("g")).first()
        if not moving:
            return union([*rest, labels]).select("k", "g", "f", "b")
        if graphs > 1 and moving < FEW_MOVE * rows:
            busy = written(labels.where("f_moved OR b_moved").select("g").distinct(), "busy")
            rest.append(written(labels.join(busy, "g", "left_anti"), "rest"))
            labels, edges = written(labels.join(busy, "g", "left_semi"), "numbers"), written(edges.join(busy, "g", "left_semi"), "edges")


def strong(s: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the one that stands for its component, by Tarjan's depth-first search without recursion. Edges lead from s to d."""
    order = np.argsort(s, kind="stable")
    to, ends = d[order].tolist(), np.searchsorted(s[order], np.arange(n + 1)).tolist()
    at, place, low, of, stack, seen = ends[:n], [0] * n, [0] * n, [-1] * n, [], 0
    for start in range(n):
        path = [] if place[start] else [start]
        while path:
            v = path[-1]
            if not place[v]:
                seen += 1
                place[v] = low[v] = seen
                stack.append(v)
            if at[v] < ends[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not place[w]:
                    path.append(w)
                elif of[w] < 0 and place[w] < low[v]:
                    low[v] = place[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == place[v]:
                while of[v] < 0:
                    of[stack.pop()] = v
    return np.array(of, dtype=np.int64)


def members_of(edges: pd.DataFrame) -> pd.DataFrame:
    """g, k, root (its component's least k) of the nodes on cycles of one graph's edges (g, s, d)."""
    codes, names = pd.factorize(pd.concat([edges["s"], edges["d"]], ignore_index=True))
    s, d = codes[: len(edges)], codes[len(edges) :]
    of = strong(s, d, len(names))
    on = np.bincount(of, minlength=len(names))[of] > 1
    on[s[s == d]] = True
    found = pd.DataFrame({"k": names[on], "of": of[on]})
    return pd.DataFrame({"g": edges["g"].iloc[0], "k": found["k"], "root": found.groupby("of")["k"].transform("min")})


def settled(edges: DataFrame) -> DataFrame:
    """g, k, root of the nodes on cycles of many small graphs (g, s, d), a task for each graph at a time."""
    kinds = {x.name: x.dataType.simpleString() for x in edges.schema}
    return edges.groupBy("g").applyInPandas(members_of, f"g {kinds['g']}, k {kinds['s']}, root {kinds['s']}")


def parted(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The edges (led by g) of graphs of SMALL edges at most, and of the others; None where there are none of the others, or no edges but theirs."""
    sizes = written(edges.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    # no more rows than all edges hold SMALL ones
    large = F.broadcast(sizes.where(F.col("n") > SMALL).select("g"))
    graphs, larger = sizes.agg(F.count("*"), F.count(F.when(F.col("n") > SMALL, 1))).first()
    if not larger:
        return edges, None
    return edges.join(large, "g", "left_anti") if larger < graphs else None, edges.join(large, "g", "left_semi") if larger < graphs else edges


def few(edges: DataFrame) -> DataFrame:
    """Of each node's edges (g, s, d) the two to the least and greatest numbers, and the two from such."""
    out = edges.groupBy("g", "s").agg(F.array_distinct(F.array(F.min("d"), F.max("d"))).alias("d")).select("g", "s", F.explode("d").alias("d"))
    into = edges.groupBy("g", "d").agg(F.array_distinct(F.array(F.min("s"), F.max("s"))).alias("s")).select("g", F.explode("s").alias("s"), "d")
    return out.union(into).distinct()


def rounds(left: DataFrame, nodes: int, thin: bool = True) -> DataFrame:
    """k, root (one of them) of the components of edges between numbers (g, s, d), which are written, distinct and lead from no node to itself. Single nodes may be there.

    nodes: how many there are, about. thin: whether a few edges of each node may come first.
    """
    found = []
    small, large = parted(left)
    if small is not None:
        found.append(settled(small).select("k", "root"))
    if large is None:
        return found[0]
    left, n = (written(large, "edges") if small is not None else large), large.count()
    if thin and n > DENSE * nodes:
        first = written(rounds(written(few(left), "few"), nodes, False), "first")
        a, b = first.select(F.col("k").alias("s"), F.col("root").alias("_s")), first.select(F.col("k").alias("d"), F.col("root").alias("_d"))
        rest = left.join(a.hint("merge"), "s", "left").join(b.hint("merge"), "d", "left").select("g", F.coalesce("_s", "s").alias("s"), F.coalesce("_d", "d").alias("d")).where("s <> d").distinct()
        rest = written(rest, "edges")
        if among := rest.count():
            # again while it leaves few edges: where it found no cycles it would find none again
            more = written(rounds(rest, rest.select("s").union(rest.select("d")).distinct().count(), 2 * among < n), "more")
            known = first.join(more.select(F.col("k").alias("root"), F.col("root").alias("_root")).hint("merge"), "root", "left").select("k", F.coalesce("_root", "root").alias("root"))
            first = known.union(more.join(first.hint("merge"), "k", "left_anti"))
        return union([*found, first])
    while n:
        while n:
            before, plain = n, left.select("s", "d")
            for turn in (False, True):
                kept, rings = unchained(turned(plain) if turn else plain)
                plain = turned(kept) if turn else kept
                found += [rings] if rings is not None else []
                if not (n := plain.count()):
                    break
            if n < before:
                left = written(left.join(plain.hint("merge"), ["s", "d"], "left_semi").select("g", "s", "d"), "edges")
            if n > (1 - SHARE) * before:
                break
        if not n:
            break
        small, large = parted(left)
        if small is not None:
            found.append(settled(small).select("k", "root"))
            if large is None:
                break
            left = written(large, "edges")
        labels = written(numbered(left), "labels")
        found.append(labels.where("f = b").select("k", F.col("f").alias("root")))
        x, y = labels.select(F.col("k").alias("s"), F.col("f").alias("sf"), F.col("b").alias("sb")), labels.select(F.col("k").alias("d"), F.col("f").alias("df"), F.col("b").alias("db"))
        left = written(left.join(x.hint("merge"), "s").join(y.hint("merge"), "d").where("sf = df AND sb = db AND sf <> sb").select("g", "s", "d"), "edges")
        n = left.count()
    return union(found) if found else large.select(F.col("s").alias("k"), F.col("s").alias("root")).where("false")


def components(edges: DataFrame, graph: str | None = None) -> DataFrame:
    """id, scc (its smallest id) for nodes in components of two or more, and for nodes with an edge to themselves.

    graph: the column that tells many graphs' edges apart; nodes of different graphs are different ones, and it leads the result's columns. Edges with a null
    end, or whose graph is null, are on no cycle. Edges are read more than once: they should be written.
    """
    own = edges.select((F.col(graph) if graph else F.lit(0)).alias("g"), F.col("src").alias("s"), F.col("dst").alias("d")).where("g IS NOT NULL AND s IS NOT NULL AND d IS NOT NULL")
    small, large = parted(own)
    parts = [settled(small).select("g", F.col("k").alias("id"), F.col("root").alias("scc"))] if small is not None else []
    if large is not None:
        parts.append(by_rounds(large))
    out = union(parts)
    return out.withColumnRenamed("g", graph) if graph else out.select("id", "scc")


def by_rounds(own: DataFrame) -> DataFrame:
    """g, id, scc of graphs of any size (g, s, d), their nodes by names."""
    loops = own.where("s = d").select("g", F.col("s").alias("id")).distinct()
    names = written(own.where("s <> d").select("g", F.explode(F.array("s", "d")).alias("id")).distinct(), "names")
    # a node's number is a hash of its name, so that edges needn't meet names; two nodes of one number would be found here, and numbered anew
    seed, nodes = 0, names.count()
    number = lambda seed, id_: F.xxhash64(F.lit(seed), "g", id_)
    while names.select(number(seed, "id").alias("k")).distinct().count() < nodes:
        seed += 1
    out = loops.select("g", "id", F.col("id").alias("scc"))
    left = written(own.where("s <> d").select("g", number(seed, "s").alias("s"), number(seed, "d").alias("d")).distinct(), "edges")
    if nodes:
        members = written(rounds(left, nodes).join(names.withColumn("k", number(seed, "id")).hint("merge"), "k").select("root", "g", "id"), "components")
        several = members.groupBy("root").agg(F.min("id").alias("scc"), F.count("*").alias("n")).where("n > 1")
        several = members.join(several.hint("merge"), "root").select("g", "id", "scc")
        out = several.union(out.join(several.select("g", "id").hint("merge"), ["g", "id"], "left_anti"))
    return out


def canonical(members: DataFrame) -> DataFrame:
    """cycle (place of the component by its smallest member), id, scc, size for each member."""
    per = members.groupBy("scc").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    # places of components: cycles are few beside nodes, and ranks come from sorted ranges, not from one task
    ranked = placed(per, ["first", "size"], "cycle")
    return members.join(ranked, "scc").select("cycle", "id", F.col("first").alias("scc"), "size")


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in the order, from 0: sorted ranges are counted, then shifted."""
    at = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, before, shift = F.shiftright("_at", 33), 0, F.lit(0)
    for row in at.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each partition of the sort
        shift = F.when(part >= row["part"], F.lit(before)).otherwise(shift)
        before += row["count"]
    return at.withColumn(name, (F.col("_at").bitwiseAND((1 << 33) - 1) + shift).cast("long")).drop("_at")


def edges_in_cycles(edges: DataFrame, members: DataFrame, graph: str | None = None) -> DataFrame:
    """src, dst, scc of edges with both ends in one component. graph: as in components()."""
    by = [graph] if graph else []
    a, b = members.select(*by, F.col("id").alias("src"), F.col("scc").alias("a")), members.select(*by, F.col("id").alias("dst"), F.col("scc").alias("b"))
    return edges.join(a, [*by, "src"]).join(b, [*by, "dst"]).where("a = b").select(*by, "src", "dst", F.col("a").alias("scc"))
