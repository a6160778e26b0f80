"""Manifests of (path, content) rows: packages, their entries and exports, configurations with what they extend, entry points, declared barrels.

Manifests are few beside files, but nothing of them is gathered: each is read where its row is, and what it names meets the listing by equality.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsight.functions import paths as P
from depsight.operators.folders import deepest
from depsight.tables import written

LOCKS = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"))
#: Fields of a manifest that name a package's own entry, in their order.
ENTRY_FIELDS = ("source", "module", "main", "types", "typings")
#: A string of JSON, kept, or a comment; possessive, so that strings of any length take no stack.
NO_COMMENTS = r"""("(?:[^"\\]++|\\.)*+")|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"""
# Names of tests and, at a package's root, of tool configurations that count as entry points.
TEST_GLOBS = (
    "**/*.test.ts", "**/*.test.tsx", "**/*.test.js", "**/*.test.jsx", "**/*.spec.ts", "**/*.spec.tsx", "**/*.spec.js", "**/*.spec.jsx", "**/__tests__/**",
)
TEST_HINTS = (".test.", ".spec.", "__tests__/")  # each of TEST_GLOBS has one of these in it
CONFIG_GLOBS = (
    "vite.config.js", "vite.config.ts", "vite.config.mjs", "vite.config.cjs", "webpack.config.js", "webpack.config.ts", "webpack.config.mjs", "webpack.config.cjs",
    "rollup.config.js", "rollup.config.ts", "rollup.config.mjs", "rollup.config.cjs", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.mjs", ".eslintrc.json",
    ".prettierrc.js", ".prettierrc.cjs", ".prettierrc.json", "tsconfig.json", "tsconfig.*.json", "jest.config.js", "jest.config.ts", "jest.config.mjs",
    "jest.config.cjs", "babel.config.js", "babel.config.ts", "babel.config.mjs", "babel.config.cjs", ".babelrc.js", ".babelrc.json",
)


def without_comments(text: Column) -> Column:
    """JSON with comments as plain JSON; strings stay whole."""
    return F.regexp_replace(text, NO_COMMENTS, "$1")


def glob_expression(glob: str) -> str:
    """A workspace glob as an expression over folders; * stays within a name and ** doesn't."""
    return "^" + "/".join(".*" if p == "**" else "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p) for p in glob.strip("./").split("/")) + "$"


def package_manager(files: DataFrame) -> DataFrame:
    """manager: of the lock files at the root the first one of pnpm, yarn, npm; else unknown."""
    best = F.coalesce(*[F.max(F.when(F.col("path") == lock, name)) for lock, name in LOCKS], F.lit("unknown"))
    return files.agg(best.alias("manager"))


def workspace_globs(files: DataFrame) -> list[str]:
    """Globs of the root manifest (a list, or a list under packages), and of pnpm's file where pnpm is in use."""
    root = files.where("path = 'package.json'").select(F.from_json("content", "workspaces string").alias("m")).select(F.coalesce(F.from_json("m.workspaces", "array<string>"), F.from_json("m.workspaces", "packages array<string>")["packages"]).alias("g")).first()
    found = list((root and root["g"]) or [])
    if package_manager(files).first()["manager"] == "pnpm" and (text := files.where("path = 'pnpm-workspace.yaml'").select("content").first()):
        inside = False
        for line in (text["content"] or "").splitlines():
            line = line.split("#")[0].rstrip()
            if re.match(r"\S", line):
                inside = line.startswith("packages:")
            elif inside and (m := re.match(r"\s*-\s*['\"]?([^'\"]+)['\"]?$", line)):
                found.append(m[1])
    return [g for g in found if not g.startswith("!")]


def leaves(files: DataFrame) -> DataFrame:
    """A table of root, name, field, leaf, listed for every package.json that is JSON: one row for each path that it declares under source, module, main,
    types, typings, bin and exports (listed: inside an array), and one without a field for the manifest itself."""

    def walk(value, listed: bool = False) -> Iterator[tuple[str, bool]]:
        if isinstance(value, str):
            yield value, listed
        for x in value if isinstance(value, list) else value.values() if isinstance(value, dict) else ():
            yield from walk(x, listed or isinstance(value, list))

    def rows(path: str, text: str | None) -> Iterator[tuple]:
        try:
            value = json.loads(text or "")
        except ValueError:
            return
        value = value if isinstance(value, dict) else {}
        root, name = path.rpartition("/")[0], value.get("name")
        own = (root, name if isinstance(name, str) else None)
        yield *own, None, None, False
        for field in ENTRY_FIELDS:
            if isinstance(value.get(field), str):
                yield *own, field, value[field], False
        bins = value.get("bin")
        for x in [bins] if isinstance(bins, str) else bins.values() if isinstance(bins, dict) else ():
            if isinstance(x, str):
                yield *own, "bin", x, False
        yield from ((*own, "exports", x, listed) for x, listed in walk(value.get("exports")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for path, text in zip(b["path"], b["content"], strict=True) for r in rows(path, text)]
            yield pd.DataFrame(found, columns=["root", "name", "field", "leaf", "listed"])

    manifests = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select("path", "content")
    return written(manifests.mapInPandas(read, "root string, name string, field string, leaf string, listed boolean"), "manifests")


def packages(files: DataFrame, root_name: str = ".", known: DataFrame | None = None) -> DataFrame:
    """name, root, declared (entry fields in their order) of the root and of all folders that a workspace glob names; a package without a name has its
    folder's. Manifests that aren't JSON are none. A tree without a package is one itself, under its folder's name (root_name)."""
    known = leaves(files) if known is None else known
    chosen = F.col("root") == ""
    for g in (glob_expression(g) for g in workspace_globs(files)):
        chosen = chosen | F.col("root").rlike(g)
    order = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(ENTRY_FIELDS) for x in (f, k)]), F.col("field"))
    listed = F.collect_list(F.when(order.isNotNull() & (F.col("leaf") != ""), F.struct(order.alias("k"), "leaf")))
    found = known.where(chosen).groupBy("root").agg(F.first("name").alias("name"), F.transform(F.array_sort(listed), lambda x: x["leaf"]).alias("declared"))
    folder = F.when(F.col("root") == "", F.lit(root_name)).otherwise(P.base_name(F.col("root")))
    found = written(found.select(F.coalesce("name", folder).alias("name"), "root", "declared"), "packages")
    if found.isEmpty():
        return files.sparkSession.createDataFrame([(root_name, "", [])], "name string, root string, declared array<string>")
    return found


def extended(known: DataFrame) -> DataFrame:
    """path, up: the configuration that each one (path, dir, extends) extends: for a relative name the file itself, with .json, or tsconfig.json in it; for a bare
    one the same below node_modules of its folder or of the nearest one above."""
    ends = F.array(F.lit(""), F.lit(".json"), F.lit("/tsconfig.json"))
    above = F.reverse(F.array_distinct(P.ancestors(F.concat("dir", F.lit("/x")))))  # nearest first, the root last
    bare = F.transform(above, lambda x: F.concat(x, F.when(x == "", "").otherwise("/"), F.lit("node_modules/"), F.col("extends")))
    starts = F.when(P.is_relative(F.col("extends")), F.array(P.joined(F.col("dir"), F.col("extends")))).otherwise(bare)
    wanted = F.flatten(F.transform(starts, lambda x: F.transform(ends, lambda e: F.concat(x, e))))
    asked = known.where("extends IS NOT NULL").select("path", F.posexplode(wanted).alias("place", "wanted"))
    return asked.join(known.select(F.col("path").alias("wanted")), "wanted").groupBy("path").agg(F.min_by("wanted", "place").alias("up"))


def configs(files: DataFrame) -> DataFrame:
    """dir, base_url, paths of every tsconfig.json; what a config leaves out it takes, whole, from the nearest one that it extends.

    Chains are followed to their ends, one link a round; a chain that comes back to itself ends there.
    """
    shape = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"
    plain = without_comments(F.col("content"))
    known = files.where(F.col("path").rlike(r"\.json$")).select("path", F.when(F.try_parse_json(plain).isNotNull(), F.from_json(plain, shape)).alias("m")).where("m IS NOT NULL")
    folder = P.dir_name(F.col("path"))
    base = F.when(F.col("m.compilerOptions.baseUrl").isNotNull(), P.joined(folder, F.col("m.compilerOptions.baseUrl")))
    pairs = F.transform(F.map_entries("m.compilerOptions.paths"), lambda e: F.struct(e["key"].alias("pattern"), e["value"].alias("subs")))
    extends = F.when(~F.col("m.extends").startswith("["), F.col("m.extends"))
    known = written(known.select("path", folder.alias("dir"), extends.alias("extends"), base.alias("base_url"), F.when(F.size(pairs) > 0, pairs).alias("paths")), "configs")
    links = written(known.join(extended(known), "path", "left").select("path", "dir", "base_url", "paths", "up"), "links")
    up = links.select(*[F.col(c).alias(f"up_{c}") for c in links.columns])
    rows = written(links.where(F.col("path").rlike(r"(^|/)tsconfig\.json$") & ~F.col("path").rlike(r"(^|/)node_modules/")).select("path", "dir", "base_url", "paths", F.col("dir").alias("last"), "up", F.array("path").alias("seen")), "configs")
    open_ = F.col("up").isNotNull() & (F.col("base_url").isNull() | F.col("paths").isNull()) & ~F.array_contains("seen", F.col("up"))
    while not rows.where(open_).isEmpty():
        met = rows.where(open_).join(up, F.col("up") == F.col("up_path"))
        # a configuration that has both asks no further, and so does what extends it
        ends = F.when(F.col("up_base_url").isNull() | F.col("up_paths").isNull(), F.col("up_up"))
        moved = met.select("path", "dir", F.coalesce("base_url", "up_base_url").alias("base_url"), F.coalesce("paths", "up_paths").alias("paths"), F.col("up_dir").alias("last"), ends.alias("up"), F.array_append("seen", F.col("up")).alias("seen"))
        rows = written(rows.where(~open_ | F.col("up").isNull()).unionByName(moved), "configs")
    none = F.array().cast("array<struct<pattern: string, subs: array<string>>>")
    return rows.select("dir", F.coalesce("base_url", "last").alias("base_url"), F.coalesce("paths", none).alias("paths"))


# --- what manifests declare


def pattern_expression(glob: str) -> str:
    """A user's glob as an expression over paths: * and ? match any characters, slashes too, **/ any folders or none, [] a class."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out, at = out + "(.*/)?", at + 3
        elif glob[at] == "[" and (end := glob.find("]", at + 2)) > 0:
            body = glob[at + 1 : end]
            out, at = out + (f"[^{re.escape(body[1:])}]" if body[0] == "!" else f"[{re.escape(body)}]").replace("\\-", "-"), end + 1
        else:
            out, at = out + ({"*": ".*", "?": "."}.get(glob[at]) or re.escape(glob[at])), at + 1
    return f"^{out}$"


def entry_points(files: DataFrame, globs: tuple[str, ...] = (), root_name: str = ".") -> DataFrame:
    """id of every entry point: declared by a package (main, module, bin, leaves of exports outside of arrays) and there; tests below a package; tool
    configurations at a package's root; and what the user's globs match."""
    known, paths = leaves(files), files.select("path").distinct()
    roots = packages(files, root_name, known).select("root").distinct()
    declared = known.where("field IN ('main', 'module', 'bin') OR (field = 'exports' AND NOT listed)").join(roots, "root", "left_semi")
    declared = declared.select(P.joined(F.col("root"), F.col("leaf")).alias("path")).join(paths, "path", "left_semi")
    below = paths.select("path", F.explode(P.ancestors(F.col("path"))).alias("root")).join(roots, "root").select("path", F.expr("CASE WHEN root = '' THEN path ELSE substring(path, length(root) + 2) END").alias("rest"))
    tests = "|".join(pattern_expression(g)[1:-1] for g in TEST_GLOBS)
    tools = "|".join(pattern_expression(g)[1:-1] for g in CONFIG_GLOBS)
    # few names hold what every pattern of a test holds; the others needn't be matched with all of them
    hint = F.lit(False)
    for x in TEST_HINTS:
        hint = hint | F.col("rest").contains(x)
    named = below.where((hint & F.col("rest").rlike(f"^({tests})$")) | (~F.col("rest").contains("/") & F.col("rest").rlike(f"^({tools})$"))).select("path")
    out = declared.select("path").union(named)
    if globs:
        out = out.union(paths.where(F.col("path").rlike("|".join(pattern_expression(g) for g in globs))))
    return out.distinct().withColumnRenamed("path", "id")


def folder_of(asked: DataFrame, files: DataFrame) -> DataFrame:
    """dir for each path asked for: a folder is itself, a file's folder is the one above; of a path that isn't there an index or source file's."""
    paths = files.select(F.col("path").alias("file")).distinct()
    folders = paths.select(F.explode(P.ancestors(F.col("file"))).alias("folder")).distinct()
    met = asked.select("path").distinct().join(folders, F.col("path") == F.col("folder"), "left").join(paths, F.col("path") == F.col("file"), "left")
    looks = F.col("path").rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$") | F.col("path").rlike(r"(^|/)index(\.[^./]*)?$")
    return met.select(F.when(F.col("folder").isNotNull(), F.col("path")).when(F.col("file").isNotNull() | looks, P.dir_name(F.col("path"))).otherwise(F.col("path")).alias("dir")).distinct()


def declared_barrels(files: DataFrame, root_name: str = ".") -> DataFrame:
    """dir of the folders that tsconfig paths lead to (up to the star) and that hold what packages export."""
    known = leaves(files)
    roots = packages(files, root_name, known).select("root").distinct()
    subs = configs(files).select("base_url", F.explode("paths").alias("p")).select("base_url", F.explode("p.subs").alias("sub"))
    targets = subs.select(P.joined(F.col("base_url"), F.regexp_replace(F.regexp_replace("sub", r"\*.*", ""), "/+$", "")).alias("path"))
    exports = known.where("field = 'exports'").join(roots, "root", "left_semi").select(P.joined(F.col("root"), F.col("leaf")).alias("path"))
    return folder_of(targets.union(exports), files)


def libraries(files: DataFrame, root_name: str = ".") -> DataFrame:
    """path, package of every library: a folder with a tsconfig.json, and the package of the deepest root at or above it."""
    roots = packages(files, root_name).select(F.col("root").alias("dir"), "name")
    found = files.where(F.col("path").rlike(r"(^|/)tsconfig\.json$")).select(P.dir_name(F.col("path")).alias("path")).distinct()
    owned = deepest(found.withColumn("inside", F.concat("path", F.lit("/x"))), roots, path_col="inside")
    return owned.select("path", F.col("name").alias("package"))
