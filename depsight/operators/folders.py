"""What hangs on folders: owners by deepest ancestor, barrels, libraries, the package tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depsight.functions import paths as P
from depsight.tables import written


def looked_up(table: DataFrame | Callable[[DataFrame], DataFrame], keys: DataFrame) -> DataFrame:
    """A table, or what a lookup gives for these keys."""
    return table if isinstance(table, DataFrame) else table(keys)


def deepest(files: DataFrame, folders: DataFrame | Callable[[DataFrame], DataFrame], folder_col: str = "dir", path_col: str = "id") -> DataFrame:
    """files with the columns of the deepest folder above each, null where there is none.

    The distinct folders of the paths are spread over their ancestors, which meet folders by equality; no path is compared with all folders, and files meet the
    answer for their own folder. Of equal folders the greatest row wins. folders may be a lookup by folder_col.
    """
    own = P.dir_name(F.col(path_col))
    spread = files.select(own.alias("_own")).distinct().select("_own", F.explode(F.array_append(P.ancestors(F.col("_own")), F.col("_own"))).alias("_dir")).distinct()
    folders = looked_up(folders, spread.select(F.col("_dir").alias(folder_col)))
    others = [c for c in folders.columns if c != folder_col]
    best = folders.groupBy(folder_col).agg(*[F.max_by(c, F.struct(*others)).alias(c) for c in others]) if others else folders.distinct()
    # as many rows as distinct folders; Spark takes the spread for as large as the files' own file and would broadcast it
    met = spread.hint("merge").join(best, F.col("_dir") == F.col(folder_col)).groupBy("_own").agg(*[F.max_by(c, F.length("_dir")).alias(c) for c in [folder_col, *others]])
    return files.join(met, own == F.col("_own"), "left").drop("_own")


def index_folders(nodes: DataFrame) -> DataFrame:
    """dir of every folder with an index file among the nodes."""
    return nodes.where(F.col("id").rlike(r"/index\.(ts|tsx|js|jsx)$")).select(P.dir_name(F.col("id")).alias("dir")).distinct()


def barrel_mapping(nodes: DataFrame, barrels: DataFrame) -> DataFrame:
    """raw_id, display_id: files below a barrel's folder stand for the deepest such barrel, other nodes for themselves."""
    met = deepest(nodes.select("id", "kind"), barrels.select("dir"))
    folded = (F.col("kind") == "file") & F.col("dir").isNotNull()
    return met.select(F.col("id").alias("raw_id"), F.when(folded, P.barrel_id(F.col("dir"))).otherwise(F.col("id")).alias("display_id"))


def display_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes of the display graph; a barrel is labelled by its folder and belongs to the least package of its members."""
    found = nodes.join(mapping, nodes["id"] == mapping["raw_id"])
    folded = found.where("raw_id <> display_id").groupBy("display_id").agg(F.min("package").alias("package"))
    folder = F.regexp_replace("display_id", "^barrel:", "")
    barrels = folded.select(F.col("display_id").alias("id"), folder.alias("path"), P.base_name(folder).alias("label"), "package", F.lit("file").alias("kind"))
    return found.where("raw_id = display_id").select("id", "path", "label", "package", "kind").unionByName(barrels)


def barrel_members(mapping: DataFrame) -> DataFrame:
    """display_id, members: sorted raw ids that each barrel stands for."""
    return mapping.where("raw_id <> display_id").groupBy("display_id").agg(F.array_sort(F.collect_list("raw_id")).alias("members"))


def package_index(nodes: DataFrame) -> DataFrame:
    """package, position: packages by name, from 0. The rank runs over distinct packages, which are few beside nodes."""
    from depsight.operators.cycles import placed

    return placed(nodes.where("package IS NOT NULL").select("package").distinct(), ["package"], "position")


def placed_libs(libs: DataFrame) -> DataFrame:
    """path, package, lib_index, lib_count: each library's place among its package's libraries by path."""
    order = Window.partitionBy("package").orderBy("path")  # a package's libraries
    return libs.select("path", "package").distinct().withColumn("lib_index", F.row_number().over(order) - 1).withColumn("lib_count", F.count("*").over(Window.partitionBy("package")))


def lib_shades(nodes: DataFrame, libs: DataFrame) -> DataFrame:
    """id, package, lib, lib_index, lib_count: the deepest library of each node, and its place among its package's libraries by path."""
    found = deepest(nodes.select("id", F.col("package").alias("owner")), placed_libs(libs).select(F.col("path").alias("dir"), F.col("package").alias("lib_package"), "lib_index", "lib_count"))
    return found.where(F.col("dir").isNotNull() & F.col("owner").eqNullSafe(F.col("lib_package"))).select("id", F.col("owner").alias("package"), F.col("dir").alias("lib"), F.col("lib_index").cast("long").alias("lib_index"), F.col("lib_count").cast("long").alias("lib_count"))


def node_colors(nodes: DataFrame, libs: DataFrame) -> DataFrame:
    """id, color of every node: external ones grey, nodes of a package its colour or, inside a library, its shade, all others plain."""
    from depsight.functions import colors as C

    # a colour is worked out once for each package and each library, not for each node
    places = package_index(nodes)
    plain = written(places.select(F.col("package").alias("owner"), C.package_color(F.col("position")).alias("color")), "colors")
    shades = placed_libs(libs).join(places, "package").select("path", "package", C.lib_color(F.col("position"), F.col("lib_index"), F.col("lib_count")).alias("shade"))
    shades = written(shades, "shades").select(F.col("path").alias("dir"), F.col("package").alias("lib_package"), "shade")
    found = deepest(nodes.select("id", "kind", F.col("package").alias("owner")), shades).join(plain, "owner", "left")
    own = F.when(F.col("owner") == F.col("lib_package"), F.col("shade"))
    return found.select("id", F.when(F.col("kind") == "external", C.OUTSIDE).when(F.col("color").isNull(), C.PLAIN).otherwise(F.coalesce(own, "color")).alias("color"))


def common_prefix(nodes: DataFrame) -> DataFrame:
    """package, prefix: the folders that all of a package's files share, from the least and greatest of their paths."""
    parts = F.split(P.dir_name(F.col("id")), "/")
    ends = nodes.where("package IS NOT NULL").groupBy("package").agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    length = F.aggregate(F.sequence(F.lit(1), F.size("a")), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get("a", i - 1) == F.get("b", i - 1)), i).otherwise(n))
    return ends.select("package", F.array_join(F.slice("a", 1, length), "/").alias("prefix"))


def tree_states(nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """package, folder, leaves, state (checked, unchecked, mixed) for every folder above a package's files: one grouping over all ancestors."""
    gone = hidden.select(F.col("id").alias("_id"), F.lit(1).alias("gone")).distinct()
    flagged = nodes.where("package IS NOT NULL").join(gone, F.col("id") == F.col("_id"), "left").select("package", "id", F.coalesce("gone", F.lit(0)).alias("gone"))
    spread = flagged.select("package", "gone", F.explode(P.ancestors(F.col("id"))).alias("folder"))
    state = F.when(F.max("gone") == 0, "checked").when(F.min("gone") == 1, "unchecked").otherwise("mixed")
    return spread.groupBy("package", "folder").agg(F.count("*").alias("leaves"), state.alias("state"))


def tree_rows(nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """The package tree flattened: bucket, package, folder (below the package's shared folders), name, id, state; siblings sort by name."""
    gone = hidden.select(F.col("id").alias("_id"), F.lit(True).alias("gone")).distinct()
    flagged = nodes.where("kind <> 'workspace_package'").join(gone, F.col("id") == F.col("_id"), "left").withColumn("state", F.when(F.col("gone"), "unchecked").otherwise("checked"))
    prefix = common_prefix(nodes.where("kind = 'file'")).select(F.col("package").alias("_package"), "prefix")
    found = flagged.join(prefix, F.col("package") == F.col("_package"), "left")
    file = (F.col("kind") == "file") & F.col("package").isNotNull()
    bucket = F.when(file, "package").when(F.col("kind") == "external", "external").otherwise("unpackaged")
    folder = F.when(file, F.regexp_replace(F.substring(P.dir_name(F.col("id")), F.length("prefix") + 1, F.length("id")), "^/", "")).otherwise("")
    return found.select(bucket.alias("bucket"), F.when(file, F.col("package")).alias("package"), folder.alias("folder"), P.display_label(F.col("kind"), F.col("path"), F.col("label")).alias("name"), "id", "state")


def tree_order(nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """The package tree as rows in the order in which they are shown: bucket, package, folder, row (package, folder, leaf, or bucket), name, id, depth, state, leaves,
    first, last.

    first is a row's place in the whole tree, from 0, each parent before its children; last is the place of the last row below it, so that what is below a row are
    the places from first to last. Siblings sort by name, folders and files together (a folder before a file of its name, files of one name by id); packages
    come first, then external packages, then files without one.

    A leaf's key is the list of its ancestors' names and its own. A parent's key begins each of its children's, so a sort by key is the order, and rows of folders
    are the beginnings of leaves' keys, counted by one grouping. Ranks come from sorted ranges, not from one task.
    """
    from depsight.operators.cycles import placed

    label = nodes.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    leaf = tree_rows(nodes, hidden).join(label, F.col("id") == F.col("_id")).drop("_id")
    step = lambda name, is_leaf, id_: F.struct(name.alias("name"), F.lit(is_leaf).alias("leaf"), id_.alias("id"))
    none, place = F.lit(""), F.when(F.col("bucket") == "package", "0").when(F.col("bucket") == "external", "1").otherwise("2")
    above = F.when(F.col("bucket") == "package", F.concat(F.array(step(F.col("package"), 0, none)), F.when(F.col("folder") == "", F.array()).otherwise(F.transform(F.split("folder", "/"), lambda x: step(x, 0, none)))))
    key = F.concat(F.array(step(place, 0, none)), F.coalesce(above, F.array()), F.array(step(F.col("_label"), 1, F.col("id"))))
    leaf = leaf.select("bucket", "package", "folder", "name", "id", "state", key.alias("key"))
    # beginnings of keys: a bucket of its own has a row where it isn't that of packages
    starts = F.transform(F.sequence(F.when(F.col("bucket") == "package", 2).otherwise(1), F.size("key") - 1), lambda i: F.slice("key", 1, i))
    counts = leaf.select("bucket", "package", "state", F.explode(starts).alias("key")).groupBy("bucket", "package", "key").agg(F.count("*").alias("leaves"), F.min("state").alias("a"), F.max("state").alias("z"))
    inner = counts.select(
        "bucket", "package", F.array_join(F.transform(F.slice("key", 3, F.size("key")), lambda x: x["name"]), "/").alias("folder"), F.when(F.col("bucket") == "package", F.element_at("key", -1)["name"]).otherwise(F.col("bucket")).alias("name"),
        F.lit(None).cast("string").alias("id"), F.when(F.col("a") == F.col("z"), F.col("a")).otherwise("mixed").alias("state"), "key", F.when(F.col("bucket") != "package", "bucket").when(F.size("key") == 2, "package").otherwise("folder").alias("row"), "leaves",
    )
    rows = inner.unionByName(leaf.withColumn("row", F.lit("leaf")).withColumn("leaves", F.lit(1).cast("long")))
    rows = placed(rows, ["key"], "first")
    below = rows.where(F.size("key") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("key") - 1), lambda i: F.slice("key", 1, i))).alias("_key")).groupBy("_key").agg(F.count("*").alias("_below"))
    out = rows.where("row <> 'leaf'").join(below, F.col("key") == F.col("_key"), "left").drop("_key").unionByName(rows.where("row = 'leaf'").withColumn("_below", F.lit(0).cast("long")))
    depth = F.size("key") - F.when(F.col("bucket") == "package", 2).otherwise(1)
    return out.select("bucket", "package", "folder", "row", "name", "id", depth.alias("depth"), "state", "leaves", "first", (F.col("first") + F.coalesce("_below", F.lit(0))).alias("last"))


def leaves_between(tree: DataFrame, package: str, folder: str = "") -> DataFrame:
    """id, state of all leaves below a package or one of its folders, by their places in a tree_order() tree."""
    top = tree.where((F.col("package") == package) & (F.col("folder") == folder) & F.col("row").isin("package", "folder")).select(F.col("first").alias("_a"), F.col("last").alias("_z"))
    return tree.where("row = 'leaf'").join(F.broadcast(top), (F.col("first") > F.col("_a")) & (F.col("first") <= F.col("_z"))).select("id", "state")  # one row is broadcast


def cascaded(rows: DataFrame, package: str, folder: str = "") -> DataFrame:
    """ids that a click on a folder of a package's tree changes: of a folder that is checked whole its checked leaves, else its unchecked ones."""
    below = rows.join(leaves(rows, package, folder), "id", "left_semi")
    whole = F.broadcast(below.agg(F.coalesce(F.min((F.col("state") == "checked").cast("int")), F.lit(0)).alias("_whole")))  # one row
    return below.crossJoin(whole).where((F.col("state") == "checked") == (F.col("_whole") == 1)).select("id")


def leaves(rows: DataFrame, package: str, folder: str = "") -> DataFrame:
    """ids of all leaves below a folder of a package's tree."""
    below = (F.col("folder") == folder) | F.col("folder").startswith(folder + "/") if folder else F.lit(True)
    return rows.where((F.col("package") == package) & below).select("id")
