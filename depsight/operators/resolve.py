"""Import resolution as lookups by equality: specifiers become ordered lists of candidate paths, which meet the listing of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsight.functions import paths as P
from depsight.operators.folders import looked_up
from depsight.tables import together, written

#: A table, or what gives its rows for a table of keys (one column, named as there): then only these are read.
Lookup = DataFrame | Callable[[DataFrame], DataFrame]


def candidates(path: Column) -> Column:
    """What a path can stand for, best first: itself, with each extension, an index file in it. The path is computed once, as a variable."""
    ends = F.array(*[F.lit(x) for x in ["", *[f".{e}" for e in P.CANDIDATE_EXTENSIONS], *[f"/index.{e}" for e in P.CANDIDATE_EXTENSIONS]]])
    return F.flatten(F.transform(F.array(path), lambda p: F.transform(ends, lambda e: F.concat(p, e))))


def answers(files: DataFrame) -> DataFrame:
    """_trunk, _at, target: every path that files (path) answer for, its trunk(), and the one that is its first candidate. candidates() read backwards: a file has a
    few paths that it can stand for, while a path has many candidates. Rows lie together by trunk."""
    path = F.col("path")
    ends = ["", *[f".{e}" for e in P.CANDIDATE_EXTENSIONS], *[f"/index.{e}" for e in P.CANDIDATE_EXTENSIONS]]
    each = F.array(*[F.struct(F.when(path.endswith(e), F.substring(path, F.lit(1), F.length(path) - len(e))).alias("at"), F.lit(k).alias("pos")) for k, e in enumerate(ends)])
    spread = files.select(trunk(path).alias("_trunk"), "path", F.explode(F.filter(each, lambda x: x["at"].isNotNull())).alias("x")).repartition("_trunk")
    return spread.groupBy("_trunk", F.col("x.at").alias("_at")).agg(F.min_by("path", "x.pos").alias("target"))


def trunk(path: Column) -> Column:
    """A path without the ends that candidates have: a file and all paths that it answers for have the same one. Most paths asked for have no such end."""
    ends = rf"(?:/index|\.(?:{'|'.join(sorted({x for e in P.CANDIDATE_EXTENSIONS for x in e.split('.')}))}))+\z"
    return F.when(P.base_name(path).contains(".") | path.endswith("/index"), F.regexp_replace(path, ends, "")).otherwise(path)


def by_trunk(rows: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, _trunk of the rows (keys, _at) whose path one of the files (path) answers for. Rows meet files by trunk, and lie together by it."""
    known = answers(files).groupBy("_trunk").agg(F.map_from_entries(F.collect_list(F.struct("_at", "target"))).alias("_found"))  # one trunk's paths
    cut = rows.withColumn("_trunk", trunk(F.col("_at"))).withColumn("_end", F.expr("substring(_at, length(_trunk) + 1)")).drop("_at")  # the trunk isn't moved twice
    met = cut.join(known.hint("shuffle_hash"), "_trunk").withColumn("target", F.try_element_at("_found", F.concat("_trunk", "_end")))
    return met.where("target IS NOT NULL").select(*keys, "target", "_trunk")


def probed(asked: DataFrame, path: Column, files: Lookup, keys: list[str], many: bool = False) -> DataFrame:
    """keys and target: the first candidate of path that is a file (files: path). Rows without one are left out.

    Many rows name one path, so that distinct paths are looked up and their answers joined back. With many, rows outnumber files: they meet what all files answer
    for, once, and are neither written nor grouped; where files are a lookup they are written, as they are read twice.
    """
    rows = asked.select(*keys, path.alias("_at"))
    if many and isinstance(files, DataFrame):
        return by_trunk(rows, files, keys).drop("_trunk")
    rows = written(rows, "asked") if many else rows
    spread = rows.select("_at").distinct().select("_at", F.posexplode(candidates(F.col("_at"))).alias("_pos", "_path"))
    there = looked_up(files, spread.select(F.col("_path").alias("path")))
    met = spread.join(there.select(F.col("path").alias("_file")).distinct(), F.col("_path") == F.col("_file"))
    # rows are many beside paths, and needn't be sorted to meet them
    return rows.join(met.groupBy("_at").agg(F.min_by("_path", "_pos").alias("target")).hint("shuffle_hash"), "_at").select(*keys, "target")


def relative(imports: DataFrame, files: Lookup, distinct: bool = True) -> DataFrame:
    """file_id, source, target for relative specifiers that lead to a file; the importer's folder is where they start. distinct: each once, however often a file has it."""
    asked = imports.where(P.is_relative(F.col("source"))).select("file_id", "source")
    return probed(asked.distinct() if distinct else asked, P.joined(P.dir_name(F.col("file_id")), F.col("source")), files, ["file_id", "source"], many=True)


def workspace_packages(imports: DataFrame, packages: Lookup, files: Lookup) -> DataFrame:
    """file_id, source, target for specifiers that name a workspace package (name, root, entry) or a path below one; the longest name wins.

    What a specifier means depends on no file, so distinct specifiers are looked up.
    """
    asked = imports.where(~P.is_relative(F.col("source"))).select("file_id", "source").distinct()
    return asked.join(of_packages(asked, packages, files), "source").select("file_id", "source", "target")


def of_packages(asked: DataFrame, packages: Lookup, files: Lookup) -> DataFrame:
    """source, target of those specifiers (source) that workspace_packages() finds."""
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("source", "/"))), lambda i: F.array_join(F.slice(F.split("source", "/"), 1, i), "/"))
    spread = asked.select("source").distinct().select("source", F.explode(heads).alias("name"))
    met = spread.join(looked_up(packages, spread.select("name")).select("name", "root", "entry"), "name")
    exact = met.where("source = name AND entry IS NOT NULL").select("source", F.col("entry").alias("target"))
    below = met.where("source <> name").withColumn("path", P.joined(F.col("root"), F.expr("substring(source, length(name) + 2, length(source))")))
    found = probed(below, F.col("path"), files, ["source", "name"]).groupBy("source").agg(F.max_by("target", F.length("name")).alias("target"))
    return exact.unionByName(found.join(exact.select("source"), "source", "left_anti"))


def aliases(imports: DataFrame, configs: Lookup, files: Lookup) -> DataFrame:
    """file_id, source, target through the path aliases of the nearest config (dir, base_url, paths) above the importer.

    Longer patterns go first, then the targets of a pattern in order, then the candidates of a target. Files under one config share their lookups.
    """
    from depsight.operators.folders import deepest

    asked = imports.where(~P.is_relative(F.col("source"))).select("file_id", "source").distinct()
    near = deepest(asked.select(F.col("file_id").alias("id")).distinct(), config_folders(configs)).where("dir IS NOT NULL").select("id", "dir")
    asked = asked.join(near, F.col("file_id") == F.col("id")).select("file_id", "source", "dir")
    return asked.join(of_aliases(asked, configs, files), ["dir", "source"]).select("file_id", "source", "target")


def config_folders(configs: Lookup) -> Lookup:
    return configs.select("dir") if isinstance(configs, DataFrame) else lambda dirs: configs(dirs).select("dir")


def of_aliases(asked: DataFrame, configs: Lookup, files: Lookup) -> DataFrame:
    """dir, source, target of those specifiers (dir: their nearest config's, source) that aliases() finds."""
    rows = asked.select("dir", "source").distinct()
    rows = rows.join(looked_up(configs, rows.select("dir")).select("dir", "base_url", F.inline("paths")), "dir")
    rows = rows.withColumn("capture", P.pattern_capture(F.col("pattern"), F.col("source"))).where("capture IS NOT NULL")
    rows = rows.select("dir", "source", "pattern", "base_url", "capture", F.posexplode("subs").alias("sub_pos", "sub"))
    met = probed(rows, P.joined(F.col("base_url"), P.fill_star(F.col("sub"), F.col("capture"))), files, ["dir", "source", "pattern", "sub_pos"])
    return met.groupBy("dir", "source").agg(F.min_by("target", F.struct(-F.length("pattern"), "pattern", "sub_pos")).alias("target"))


def templates(imports: DataFrame, files: Lookup) -> DataFrame:
    """file_id, source, target: all files in the folder of a template's literal beginning whose names go on with it; the importer is left out.

    files: path; as a lookup its key is folder, the path's.
    """
    asked = imports.where("is_template AND NOT is_unresolvable").select("file_id", "source").distinct().where(P.is_relative(F.col("source")))
    folder = P.joined(P.dir_name(F.col("file_id")), F.concat(P.template_folder(F.col("source")), F.lit(".")))
    asked = asked.select("file_id", "source", folder.alias("folder"), P.base_name(F.col("source")).alias("head"))
    known = looked_up(files, asked.select("folder"))
    known = known.where(F.col("path").rlike(rf"\.({'|'.join(P.CANDIDATE_EXTENSIONS)})$")).select("path", P.dir_name(F.col("path")).alias("folder"), P.base_name(F.col("path")).alias("name"))
    return asked.join(known, "folder").where(F.col("name").startswith(F.col("head")) & (F.col("path") != F.col("file_id"))).select("file_id", "source", F.col("path").alias("target"))


def named(imports: DataFrame, files: Lookup, packages: Lookup, configs: Lookup, siblings: Lookup | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of file_id, source: of relative specifiers and the path that they name (path); of what is known to lead to a file (target); and of external
    packages (target). Rows are as often there as files have them.

    What a bare specifier means depends on its importer's folder alone, so distinct specifiers are looked up for each config's folder. What leads into the tree is
    written, and rows of statements meet it; they are neither made distinct nor grouped.
    """
    from depsight.operators.folders import deepest

    plain = imports.where("NOT is_unresolvable AND NOT is_template AND source <> ''")
    near = plain.where(P.is_relative(F.col("source"))).select("file_id", "source", P.joined(P.dir_name(F.col("file_id")), F.col("source")).alias("path"))
    bare = plain.where(~P.is_relative(F.col("source"))).select("file_id", "source", P.dir_name(F.col("file_id")).alias("folder"))
    importers = written(bare.groupBy("folder").agg(F.min("file_id").alias("id")), "importers")
    scopes = written(deepest(importers, config_folders(configs)).select("folder", "dir"), "scopes")
    bare = bare.join(scopes, "folder").select("file_id", "source", "dir")
    sources = written(bare.select("dir", "source").distinct(), "sources")
    ours, alias = together(of_packages(sources, packages, files), of_aliases(sources.where("dir IS NOT NULL"), configs, files))  # each is asked for more than once below
    inside = sources.join(ours, "source").select("dir", "source", "target").unionByName(alias.join(ours, "source", "left_anti").select("dir", "source", "target"))
    inside = written(inside, "inside").select(F.col("dir").alias("_dir"), F.col("source").alias("_source"), "target")
    same = (F.col("source") == F.col("_source")) & F.col("dir").eqNullSafe(F.col("_dir"))
    known = bare.join(inside, same).select("file_id", "source", "target").unionByName(templates(imports, files if siblings is None else siblings))
    outside = bare.join(inside, same, "left_anti").select("file_id", "source", P.bare_package(F.col("source")).alias("target")).where("target IS NOT NULL")
    return near, known, outside


def resolved(imports: DataFrame, files: Lookup, packages: Lookup, configs: Lookup, siblings: Lookup | None = None) -> DataFrame:
    """file_id, source, kind (file, external), target for every import that leads somewhere, as often as its file has it.

    The order: templates by folder; relative by file; then workspace packages, path aliases, and last the name of an external package.
    files, packages, configs may be lookups by path, name and dir; then siblings is one of files by folder.
    """
    return met(*named(imports, files, packages, configs, siblings), files)


def met(near: DataFrame, known: DataFrame, outside: DataFrame, files: Lookup) -> DataFrame:
    """resolved() of what named() gives, or of some of its rows."""
    found = probed(near, F.col("path"), files, ["file_id", "source"], many=True).unionByName(known).withColumn("kind", F.lit("file"))
    return found.unionByName(outside.withColumn("kind", F.lit("external"))).select("file_id", "source", "kind", "target")


def met_once(near: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, target of what leads to a file (near, known: as named() gives them), each once.

    What is known to lead to a file names it, and meets files with all others: rows move once, by the trunk of what they name, and are made distinct where they lie.
    """
    asked = near.select("file_id", F.col("path").alias("_at")).unionByName(known.select("file_id", F.col("target").alias("_at")))
    return by_trunk(asked, files, ["file_id"]).groupBy("_trunk", "file_id", "target").agg(F.lit(1)).select("file_id", "target")


def entries(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """name, root, entry: the first of a manifest's declared paths (declared: ordered) that is a file, else index.*, else src/index.*."""
    places = F.concat(F.transform("declared", lambda x: x), F.array(F.lit("index"), F.lit("src/index")))
    asked = manifests.select("name", "root", F.posexplode(places).alias("place", "rest")).withColumn("path", P.joined(F.col("root"), F.col("rest")))
    found = probed(asked, F.col("path"), files, ["name", "root", "place"]).groupBy("name", "root").agg(F.min_by("target", "place").alias("entry"))
    return manifests.select("name", "root").join(found, ["name", "root"], "left")
