"""Reachability over edges (src, dst): blast radius, dead code, cone statistics.

Fixpoints go level by level: the frontier joins the edges, and what was seen before is taken off. Each level is written to the shared folder, so that
plans stay short and a lost executor costs no earlier level. Every few levels they become one table, and edges that can lead to nothing new go: those to what was
seen, and those of graphs that have come to rest. So many levels of few nodes don't read all edges again and again.

Tables of many rows are joined by shuffles: as files they are a small part of what they are in memory, and Spark, which goes by files, would broadcast them. Of
the levels a query broadcasts one table, as each broadcast with text in its keys takes the driver 64 MB at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.tables import written

#: Levels that become one table.
STRIDE = 8
#: Rows of a table that is broadcast.
FEW = 50_000


def sized(df: DataFrame, rows: int, way: str = "merge") -> DataFrame:
    """A side of a join that is broadcast if its rows are few, and else never."""
    return F.broadcast(df) if rows <= FEW else df.hint(way)


def reached(edges: DataFrame, seeds: DataFrame, avoid: DataFrame | None = None, graph: str | None = None) -> DataFrame:
    """id of every node that a path of one edge or more leads to from the seeds (id); nodes in avoid are neither returned nor passed.

    graph: the column that tells many graphs apart, in all tables and in the result. Their levels go on side by side; a graph without a frontier has no rows.
    """
    by = [graph] if graph else []
    ends = edges.select(*by, F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct()
    if avoid is not None:
        ends = ends.join(avoid.select(*by, F.col("id").alias("_to")).hint("merge"), [*by, "_to"], "left_anti")
    ends, front = written(ends, "ends"), written(seeds.select(*by, "id").distinct(), "level")
    rows, recent, levels = front.count(), [], []
    while rows:
        # edges are many beside a level, and needn't be sorted to meet it
        found = ends.join(sized(front.select(*by, F.col("id").alias("_from")), rows, "shuffle_hash"), [*by, "_from"]).select(*by, F.col("_to").alias("id")).distinct()
        if recent:
            found = found.join(union([x for x, _ in recent]).hint("merge"), [*by, "id"], "left_anti")
        front = written(found, "level")
        rows = front.count()
        recent.append((front, rows))
        if rows and len(recent) == STRIDE:
            seen = written(union([x for x, _ in recent]), "seen")
            left = ends.join(sized(seen.select(*by, F.col("id").alias("_to")), sum(n for _, n in recent)), [*by, "_to"], "left_anti")
            ends = written(left.join(front.select(*by).distinct(), by, "left_semi") if by else left, "ends")
            levels, recent = gathered([*levels, (0, seen)]), []
    parts = [x for _, x in levels] + [x for x, _ in recent]
    return union(parts) if parts else front


def gathered(tables: list[tuple[int, DataFrame]]) -> list[tuple[int, DataFrame]]:
    """Tables with their ranks; STRIDE of one rank become one of the next, so that they stay few and a row is seldom written."""
    while len(tables) >= STRIDE and len({rank for rank, _ in tables[-STRIDE:]}) == 1:
        rank = tables[-1][0] + 1
        tables = [*tables[:-STRIDE], (rank, written(union([x for _, x in tables[-STRIDE:]]), "seen"))]
    return tables


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def reversed_edges(edges: DataFrame, graph: str | None = None) -> DataFrame:
    return edges.select(*([graph] if graph else []), F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependents(edges: DataFrame, start: DataFrame, graph: str | None = None) -> DataFrame:
    """Everything that depends on a start node (id), directly or not; a start node is included only if it is on a cycle. graph: as in reached()."""
    return reached(reversed_edges(edges, graph), start, graph=graph)


def dependents_with_barrels(edges: DataFrame, start: DataFrame, mapping: DataFrame) -> DataFrame:
    """The cone of a start node in the display graph, with the members of every barrel that it hits. The node itself is never in it.

    mapping: raw_id, display_id. A start node that was folded into a barrel stands for the barrel.
    """
    folded = mapping.where("raw_id <> display_id")
    seed = start.select("id").join(folded.hint("merge"), F.col("id") == F.col("raw_id"), "left").select(F.coalesce("display_id", "id").alias("id")).distinct()
    cone = reached(reversed_edges(edges), seed, avoid=seed)
    members = cone.join(folded.hint("merge"), F.col("id") == F.col("display_id")).select(F.col("raw_id").alias("id"))
    return cone.union(members).distinct()


def unreachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame, graph: str | None = None) -> DataFrame:
    """Nodes (id) that no entry is or leads to; entries that are no nodes don't count. graph: as in reached()."""
    keys = [*([graph] if graph else []), "id"]
    seeds = entries.select(*keys).join(nodes.select(*keys).hint("merge"), keys, "left_semi")
    found = reached(edges, seeds, graph=graph).union(seeds)
    return nodes.select(*keys).join(found.hint("merge"), keys, "left_anti")


def no_incoming(nodes: DataFrame, edges: DataFrame, graph: str | None = None) -> DataFrame:
    """Nodes that no edge leads to, not even their own."""
    by = [graph] if graph else []
    return nodes.select(*by, "id").join(edges.select(*by, F.col("dst").alias("id")).hint("merge"), [*by, "id"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, entries: DataFrame, graph: str | None = None) -> DataFrame:
    """id, unreachable, no_incoming for every node in either set."""
    far = unreachable(nodes, edges, entries, graph).withColumn("unreachable", F.lit(True))
    lone = no_incoming(nodes, edges, graph).withColumn("no_incoming", F.lit(True))
    return far.join(lone.hint("merge"), [*([graph] if graph else []), "id"], "full").fillna(False, ["unreachable", "no_incoming"])


def cone_stats(cone: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files and packages of a cone (id). Barrels are skipped, ids that are no nodes count as files, packages are those of files."""
    known = nodes.select(F.col("id").alias("_id"), "kind", "package")
    found = cone.where(~F.col("id").startswith("barrel:")).join(known, F.col("id") == F.col("_id"), "left")
    file = F.col("kind").isNull() | (F.col("kind") == "file")
    return found.agg(F.count(F.when(file, 1)).alias("files"), F.countDistinct(F.when(F.col("kind") == "file", F.col("package"))).alias("packages"))
