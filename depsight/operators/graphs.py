"""The graph itself: degrees, neighbours, filters, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.tables import written

#: Fixed value: nodes above which a graph counts as large.
LARGE = 20_000


def fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, dependents for every node."""
    counts = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n"))
    return nodes.select("id").join(counts, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("dependents"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, imports, imported_by: sorted lists of neighbours. A list is as long as its node's degree."""
    out = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    into = edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    found = nodes.select("id").join(out, F.col("id") == F.col("src"), "left").join(into, F.col("id") == F.col("dst"), "left")
    none = F.array().cast("array<string>")
    return found.select("id", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def one_hop(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The start nodes' (id) neighbourhood: ids of nodes, and the edges that touch a start node."""
    touching = edges.join(start.select(F.col("id").alias("src")), "src", "left_semi").union(edges.join(start.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")).distinct()
    nodes = start.select("id").union(touching.select("src")).union(touching.select("dst")).distinct()
    return nodes, touching


def visible(nodes: DataFrame, edges: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without hidden nodes (id) and the edges that touch one."""
    gone = hidden.select("id").distinct()
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select("src", "dst")


def pruned(hidden: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, known: whether a hidden id is a node of the graph."""
    known = nodes.select(F.col("id").alias("_id"), F.lit(True).alias("known"))
    return hidden.select("id").distinct().join(known, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


def toggled(hidden: DataFrame, ids: DataFrame) -> DataFrame:
    """The hidden set after each of ids has changed sides."""
    a, b = hidden.select("id").distinct(), ids.select("id").distinct()
    return a.join(b, "id", "left_anti").union(b.join(a, "id", "left_anti"))


def rewritten(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between display nodes: both ends mapped (raw_id to display_id, else as they are), edges within one dropped, each once."""
    a = mapping.select(F.col("raw_id").alias("src"), F.col("display_id").alias("x"))
    b = mapping.select(F.col("raw_id").alias("dst"), F.col("display_id").alias("y"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst"))
    return moved.where("src <> dst").distinct()


def diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """op, entity, id, src, dst: what leads from one graph to the other, removals and additions of nodes and edges."""
    none = F.lit(None).cast("string")

    def part(a: DataFrame, b: DataFrame, keys: list[str], op: str, entity: str) -> DataFrame:
        rows = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")
        return rows.select(F.lit(op).alias("op"), F.lit(entity).alias("entity"), *[F.col(c) if c in keys else none.alias(c) for c in ("id", "src", "dst")])

    parts = [part(old_edges, new_edges, ["src", "dst"], "remove", "edge"), part(old_nodes, new_nodes, ["id"], "remove", "node"), part(new_nodes, old_nodes, ["id"], "add", "node"), part(new_edges, old_edges, ["src", "dst"], "add", "edge")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def merged(*diffs: DataFrame) -> DataFrame:
    """Several diffs as one, each of its rows once; applied() does removals first, so a burst of changes still applies as a whole."""
    out = diffs[0]
    for x in diffs[1:]:
        out = out.unionByName(x)
    return out.distinct()


def applied(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after diff() rows: removals first; a removed node takes its edges along."""
    of = lambda op, entity, *cols: changes.where((F.col("op") == op) & (F.col("entity") == entity)).select(*cols)
    gone = of("remove", "node", "id")
    kept = edges.join(of("remove", "edge", "src", "dst"), ["src", "dst"], "left_anti").join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    ids = nodes.select("id").join(gone, "id", "left_anti").union(of("add", "node", "id")).distinct()
    return ids, kept.select("src", "dst").union(of("add", "edge", "src", "dst")).distinct()


def upserted(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with new rows put in place of those with the same id."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new)


def refcounts(uses: DataFrame, unique: bool = False) -> DataFrame:
    """src (package node), dst (external node), files: how many files hold an aggregated edge; files outside of packages share one node.

    unique: whether uses (file_id, package, external) are distinct as they come; then they are counted without being gathered by file first.
    """
    owner = F.coalesce("package", F.lit("(unattributed)")).alias("owner")
    pairs = uses.select(owner, "external") if unique else uses.select("file_id", owner, "external").distinct()
    return pairs.groupBy("owner", "external").agg(F.count("*").alias("files")).select(F.concat(F.lit("package:"), "owner").alias("src"), F.concat(F.lit("external:"), "external").alias("dst"), "files")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and whether the graph counts as large."""
    n = nodes.agg(F.count("*").alias("nodes"), (F.count("*") > LARGE).alias("large"))
    return n.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges")))).select("nodes", "edges", "large")  # one row each


def totals_by(nodes: DataFrame, edges: DataFrame, members: DataFrame, graph: str) -> DataFrame:
    """A row for each graph: nodes, edges, cycles, and how many nodes are on one. members: graph, id, scc."""
    kinds = [
        nodes.select(graph, F.lit("nodes").alias("what")), edges.select(graph, F.lit("edges").alias("what")), members.select(graph, F.explode(F.when(F.col("id") == F.col("scc"), F.array(F.lit("on_cycles"), F.lit("cycles"))).otherwise(F.array(F.lit("on_cycles")))).alias("what")),
    ]
    rows = kinds[0].union(kinds[1]).union(kinds[2])
    return rows.groupBy(graph).agg(*[F.count(F.when(F.col("what") == x, 1)).alias(x) for x in ("nodes", "edges", "cycles", "on_cycles")])


def hotspots(nodes: DataFrame, edges: DataFrame, churn: DataFrame) -> DataFrame:
    """id, dependents, commits, score, share: dependents times 1 + ln(1 + commits), and that over the highest score, from 0 to 1."""
    base = fan_in(nodes, edges)
    path = nodes.select(F.col("id").alias("_id"), F.col("path").alias("_path"))
    joined = base.join(path, F.col("id") == F.col("_id")).join(churn.select(F.col("path").alias("_churned"), "commits"), F.col("_path") == F.col("_churned"), "left")
    scored = joined.select("id", "dependents", F.coalesce("commits", F.lit(0)).cast("long").alias("commits")).withColumn("score", F.round(F.col("dependents") * (1 + F.log1p("commits")), 6))
    scored = written(scored, "scored")
    peak = F.broadcast(scored.agg(F.max("score").alias("peak")))  # one row
    share = F.when(F.col("peak") > 0, F.least(F.greatest(F.col("score") / F.col("peak"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return scored.join(peak).withColumn("share", F.round(share, 6)).drop("peak")


def matches(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose package, file name or id has the query's characters in order."""
    from depsight.functions.paths import base_name, subsequence

    wanted = query.strip()
    hit = F.coalesce(subsequence(wanted, F.col("package")), F.lit(False)) | subsequence(wanted, base_name(F.col("id"))) | subsequence(wanted, F.col("id"))
    return nodes.where(hit).select("id")
