"""A module graph over the driver's tables: parts are modules, and a part imports the next part of its order's lines; and the same as a source tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depsight.functions import paths as P
from depsight.sources.commits import MARK
from depsight.tables import folder, written

#: Seconds of an event since 1970, whatever the session's time zone.
SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', ts)"
#: The hotspot window.
CHURN_DAYS = 30
#: Parts of a module of the monthly graphs: so many that a graph has somewhat more edges than modules, whatever the tables' size.
MODULE = 128


@dataclass
class Graph:
    """nodes (id, path, label, package, kind) and edges (src, dst), distinct."""

    nodes: DataFrame
    edges: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, id, package of every module file, tests, styles and declarations included."""
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_size").alias("sz"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("nm"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("pkg"), F.lower("p_type").alias("dir"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("b"),
    )
    lead = part.groupBy("pkg", "dir").agg(F.min("k").alias("lead_k"))  # pre-summed: a window would gather a package in one task
    # the table is a small file for its rows: read in place, few tasks would work out all names, once for each time that they are read
    part = part.repartition("k").join(lead, ["pkg", "dir"])
    name = F.when((F.col("k") == F.col("lead_k")) & (F.col("b") % 3 == 0), F.lit("index")).otherwise(F.concat("nm", F.lit("-"), F.col("k").cast("string")))
    kind = F.col("sz") % 10
    end = F.when(kind == 0, ".test.ts").when(kind == 1, ".d.ts").when(kind == 2, ".tsx").when(kind == 3, ".js").when(kind == 4, ".css").otherwise(".ts")
    return written(part.select("k", F.concat(F.lit("packages/"), "pkg", F.lit("/"), "dir", F.lit("/"), name, end).alias("id"), F.concat(F.lit("@acme/"), "pkg").alias("package")), "files")


def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, id, package of the files that are nodes."""
    return files(spark, sf_dir).where(P.passes(F.col("id")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, t: keys of every consecutive pair of an order's lines, as often as it is there."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # the lines of one order; those that tie here have the same part, so that suppliers, who break ties in the SQL, change no pair and needn't be moved
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return lines.withColumn("t", F.lead("l_partkey").over(after)).where("t IS NOT NULL").select(F.col("l_partkey").alias("f"), "t")


def graph(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> Graph:
    """Every consecutive pair of an order's lines between parts that are nodes (known, if they are at hand) is an import."""
    known = module_nodes(spark, sf_dir) if known is None else known
    # pairs of keys are made distinct where they meet their names: a name has its key in it, so edges of names are distinct then
    imports = pairs(spark, sf_dir).repartition("f").distinct()
    named = known.select("k", "id").repartition("k").distinct().hint("shuffle_hash")
    edges = imports.join(named.select(F.col("k").alias("f"), F.col("id").alias("src")), "f").join(named.select(F.col("k").alias("t"), F.col("id").alias("dst")), "t").select("src", "dst")
    nodes = known.select("id", F.col("id").alias("path"), P.base_name(F.col("id")).alias("label"), "package", F.lit("file").alias("kind"))
    return Graph(nodes, edges)


def monthly(spark: SparkSession, sf_dir: str) -> Graph:
    """Many small graphs at once, each row led by its graph: one for each month and customers' nation. Modules are runs of MODULE parts, and a module imports that of
    the next line of an order; a line alone is a module without edges."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # customers as a file are a small part of what they are in memory: they are not broadcast
    where = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    where = where.select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("/"), "n_name").alias("graph"))
    named = lines.join(where, "l_orderkey").withColumn("id", F.concat(F.lit("m"), F.floor(F.col("l_partkey") / MODULE).cast("string")))
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # the lines of one order
    named = written(named.select("graph", "id", F.lead("id").over(after).alias("dst")), "lines")  # read for nodes and for edges
    edges = named.where("dst IS NOT NULL").select("graph", F.col("id").alias("src"), "dst").distinct()
    return Graph(named.select("graph", "id").distinct(), edges)


def churn(spark: SparkSession, sf_dir: str, days: int = CHURN_DAYS) -> DataFrame:
    """path, commits: touches of each module in the last days of the events."""
    events = read(spark, sf_dir, "events").where("event_type <> 'view'")
    last = events.sparkSession.read.parquet(f"{sf_dir}/events.parquet").agg((F.max("ts") - F.expr(f"INTERVAL {days} DAY")).alias("since"))
    counts = events.join(F.broadcast(last), F.col("ts") >= F.col("since")).groupBy("user_id").agg(F.count("*").alias("commits"))  # one row is broadcast
    return counts.join(module_nodes(spark, sf_dir), F.col("user_id") == F.col("k")).select(F.col("id").alias("path"), "commits")


def commit_log(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a commit log of the events: one commit each, which touches the user's module."""
    events = read(spark, sf_dir, "events").where("event_type <> 'view'").join(module_nodes(spark, sf_dir), F.col("user_id") == F.col("k"))
    log = folder(spark, "commits")
    events.select(F.concat(F.lit(MARK), F.sha1(F.concat_ws("/", "id", F.col("ts").cast("string"))), F.lit(" "), F.expr(SECONDS).cast("string"), F.lit("\n"), "id", F.lit("\n"))).write.text(log)
    return log


def external_uses(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """file_id, package, external, distinct: each module's suppliers are the external packages that it imports."""
    # pairs of keys are distinct where they meet their part; as shuffled they are a small part of what they are in memory, so that parts are not to be put together
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").repartition(parts, "l_partkey").distinct()
    known = (module_nodes(spark, sf_dir) if known is None else known).repartition(parts, "k").distinct().hint("shuffle_hash")
    return lines.join(known, F.col("l_partkey") == F.col("k")).select(F.col("id").alias("file_id"), "package", F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("external"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of a tree whose index is the graph: a relative import for each edge and a bare one for each external use, and manifests()."""
    each = files(spark, sf_dir)
    statement = lambda spec: F.concat(F.lit("import '"), spec, F.lit("';"))
    # a name becomes a statement once, before it meets its importers, and statements are gathered by their file's key: no pair of names moves
    plain = F.regexp_replace(F.regexp_replace("id", "^packages/", ""), r"(/index)?\.(d\.)?[^./]*$", "")
    named = each.where(P.passes(F.col("id"))).select(F.col("k").alias("t"), statement(F.concat(F.lit("../../"), plain)).alias("line")).repartition("t").distinct().hint("shuffle_hash")
    near = pairs(spark, sf_dir).repartition("t").distinct().join(named, "t").select(F.col("f").alias("k"), "line")
    uses = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), statement(F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"))).alias("line"))
    lines = near.union(uses).repartition("k").groupBy("k").agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("content"))  # one file's imports
    sources = each.join(lines.hint("merge"), "k", "left").select(F.col("id").alias("path"), F.coalesce(F.when(P.passes(F.col("id")), F.col("content")), F.lit("")).alias("content"))
    return sources.unionByName(manifests(spark, each))


def bare_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree with empty sources, for what manifests and names alone decide."""
    each = files(spark, sf_dir)
    return each.select(F.col("id").alias("path"), F.lit("").alias("content")).unionByName(manifests(spark, each))


def manifests(spark: SparkSession, each: DataFrame) -> DataFrame:
    """path, content of a manifest for each package (entries that are there and that aren't, exports with conditions and arrays), tools, a configuration at the
    root and one in every fifth package."""
    pkg = F.regexp_extract("id", "^packages/([^/]*)/", 1)
    per = each.groupBy(pkg.alias("pkg")).agg(F.min(F.expr("substring(id, length(regexp_extract(id, '^packages/[^/]*/', 0)) + 1)")).alias("a"), F.max(F.expr("substring(id, length(regexp_extract(id, '^packages/[^/]*/', 0)) + 1)")).alias("z"))
    text = F.format_string('{"name": "@acme/%s", "module": "gone/esm.mjs", "main": "%s", "bin": {"run": "./%s"}, "exports": {".": {"import": "./%s", "require": "./gone/index.cjs"}, "./z": ["./%s"]}}', "pkg", "a", "z", "a", "z")
    own_manifests = per.select(F.concat(F.lit("packages/"), "pkg", F.lit("/package.json")).alias("path"), text.alias("content"))
    tools = per.select(F.concat(F.lit("packages/"), "pkg", F.lit("/vite.config.ts")).alias("path"), F.lit("").alias("content"))
    own = per.where(F.regexp_extract("pkg", r"(\d+)$", 1).cast("int") % 5 == 0).select(F.concat(F.lit("packages/"), "pkg", F.lit("/tsconfig.json")).alias("path"), F.lit('{"extends": "../../tsconfig", /* own */ "compilerOptions": {"paths": {"@own/*": ["packages/shared/src/*"]}}}').alias("content"))
    root = spark.createDataFrame([("package.json", '{"private": true, "workspaces": ["packages/*"]}'), ("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", // here\n "paths": {"@src/*": ["missing/*", "packages/*"]}}}')], "path string, content string")
    return own_manifests.unionByName(tools).unionByName(own).unionByName(root)


#: The same views in SQL, for oracles.
VIEWS = r"""
p AS (SELECT p_partkey k, p_size sz, replace(p_name,' ','_') nm, lower(replace(p_brand,'#','')) pkg, lower(p_type) dir,
    min(p_partkey) OVER (PARTITION BY p_brand, p_type) lead_k, CAST(replace(p_brand,'Brand#','') AS INT) b FROM part),
mod_files AS (SELECT k, 'packages/' || pkg || '/' || dir || '/' || CASE WHEN k=lead_k AND b%3=0 THEN 'index' ELSE nm || '-' || CAST(k AS VARCHAR) END ||
    CASE sz%10 WHEN 0 THEN '.test.ts' WHEN 1 THEN '.d.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '.js' WHEN 4 THEN '.css' ELSE '.ts' END AS id, '@acme/' || pkg AS package FROM p),
mod_imports AS (SELECT DISTINCT f, t FROM (SELECT l_partkey f, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) t FROM lineitem) x
    WHERE t IS NOT NULL),
mod_nodes AS (SELECT k, id, package FROM mod_files WHERE regexp_matches(id, '\.(ts|tsx|js|jsx|mjs|cjs)$') AND NOT regexp_matches(id, '\.(test|spec)\.[^./]*$')),
mod_edges AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM mod_imports i JOIN mod_nodes a ON a.k=i.f JOIN mod_nodes b ON b.k=i.t),
mod_barrels AS (SELECT DISTINCT regexp_replace(id,'/[^/]*$','') AS dir FROM mod_nodes WHERE regexp_matches(id, '/index\.(ts|tsx|js|jsx)$')),
mod_mapping AS (SELECT n.id AS raw_id, coalesce('barrel:' || b.dir, n.id) AS display_id, n.package FROM mod_nodes n LEFT JOIN mod_barrels b ON b.dir = regexp_replace(n.id,'/[^/]*$','')),
mod_display_edges AS (SELECT DISTINCT a.display_id AS src, b.display_id AS dst FROM mod_edges e JOIN mod_mapping a ON a.raw_id=e.src JOIN mod_mapping b ON b.raw_id=e.dst WHERE a.display_id <> b.display_id),
mod_display_nodes AS (SELECT display_id AS id, min(package) AS package, CASE WHEN display_id LIKE 'barrel:%' THEN regexp_replace(display_id, '^.*/', '') ELSE regexp_replace(display_id, '^.*/', '') END AS label FROM mod_mapping GROUP BY display_id),
mod_churn AS (SELECT n.id AS path, count(*) AS commits FROM events e JOIN mod_nodes n ON n.k = e.user_id WHERE event_type <> 'view' AND ts >= (SELECT max(ts) - INTERVAL 30 DAY FROM events) GROUP BY n.id)
"""

#: The monthly graphs in SQL, with the closure of each.
MONTHLY = f"""
mm AS (SELECT l_orderkey AS o, l_linenumber, l_partkey, l_suppkey, strftime(o_orderdate, '%Y-%m') || '/' || n_name AS graph, 'm' || CAST(l_partkey // {MODULE} AS VARCHAR) AS id
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
me AS (SELECT DISTINCT graph, id AS src, nxt AS dst FROM (SELECT graph, id, lead(id) OVER (PARTITION BY o ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM mm) x WHERE nxt IS NOT NULL),
mn AS (SELECT DISTINCT graph, id FROM mm)"""
