"""Columns over paths, names and import specifiers. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of source files, suffixes of tests, and names of tool configurations.
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
TEST_SUFFIXES = (".test", ".spec")
CONFIG_PREFIXES = (
    "vite.config", "vitest.config", "jest.config", "rollup.config", "webpack.config", "babel.config", "tsup.config", "postcss.config", "tailwind.config",
    "next.config", "prettier.config", "cypress.config", "playwright.config", "svelte.config", "nuxt.config", "astro.config", "remix.config", "esbuild.config",
)
CONFIG_FILES = (
    ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.mjs", ".eslintrc.ts", ".prettierrc.js", ".prettierrc.cjs", ".stylelintrc.js", ".stylelintrc.cjs",
    ".babelrc.js", ".babelrc.cjs", "gulpfile.js", "gulpfile.ts", "gulpfile.cjs", "gruntfile.js", "Gruntfile.js",
)
# Extensions that are tried after a specifier, in this order.
CANDIDATE_EXTENSIONS = ("ts", "tsx", "d.ts", "js", "jsx", "mjs", "cjs")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The folder of a path; empty at the root."""
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(base_name(path)) - 1, F.lit(0)))


def stem(path: Column) -> Column:
    """The file name without its last extension; a name whose only dot leads it stays whole."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def is_source(path: Column) -> Column:
    return path.rlike(rf"[^/]\.({'|'.join(SOURCE_EXTENSIONS)})$")


def is_test(path: Column) -> Column:
    return stem(path).rlike(rf"({'|'.join(map(re.escape, TEST_SUFFIXES))})$")


def is_config(path: Column) -> Column:
    return base_name(path).isin(*CONFIG_FILES) | base_name(path).rlike(rf"^({'|'.join(map(re.escape, CONFIG_PREFIXES))})\.")


def passes(path: Column, include_tests: bool = False) -> Column:
    """Whether a file becomes a node."""
    kept = is_source(path) & ~is_config(path)
    return kept if include_tests else kept & ~is_test(path)


def is_relative(specifier: Column) -> Column:
    return specifier.rlike(r"^\.\.?(/|$)")


def relative_id(root: Column, path: Column) -> Column:
    inside = path.startswith(F.concat(root, F.lit("/")))
    return F.replace(F.when(inside, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path), F.lit("\\"), F.lit("/"))


def external_id(name: Column) -> Column:
    return F.concat(F.lit("external:"), name)


def package_id(name: Column) -> Column:
    return F.concat(F.lit("package:"), name)


def barrel_id(folder: Column) -> Column:
    return F.concat(F.lit("barrel:"), folder)


def normalize(path: Column) -> Column:
    """Collapses . and .. by name alone; .. above the start is dropped for absolute paths and kept for others."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    none = lambda acc: (F.size(acc) == 0) | (F.element_at(acc, -1) == "..")
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x != "..", F.array_append(acc, x)).when((F.size(acc) > 0) & ~none(acc), up(acc)).when(absolute, acc).otherwise(F.array_append(acc, x)))
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(stack, "/"))


def joined(folder: Column, specifier: Column) -> Column:
    """The path that a relative specifier names from a folder.

    Most specifiers go up and then down, from folders that are spelt plainly: names are then cut off the folder's end, without a walk over all.
    """
    whole = normalize(F.when(folder == "", specifier).otherwise(F.concat_ws("/", folder, specifier)))
    odd = r"(^|/)\.{0,2}(/|$)"  # a name that is empty or only dots
    down = F.regexp_replace(specifier, r"^(?:\.\./)+", "")
    ups = F.floor((F.length(specifier) - F.length(down)) / 3).cast("int")
    left = depth(folder) + 1 - ups
    short = F.concat(F.call_function("substring_index", folder, F.lit("/"), left), F.lit("/"), down)
    return F.when((left > 0) & ~folder.rlike(odd) & ~down.rlike(odd), short).otherwise(whole)


def bare_package(specifier: Column) -> Column:
    """The package that a bare specifier names, null if it names none."""
    bad = is_relative(specifier) | specifier.contains(":") | specifier.rlike(r"^[/\\]") | (specifier == "")
    name = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    return F.when(~bad & (name != ""), name)


def pattern_capture(pattern: Column, specifier: Column) -> Column:
    """What the first * of an alias pattern stands for; empty for an exact match, null for none."""
    star = F.instr(pattern, "*")
    head, tail = F.substring(pattern, F.lit(1), star - 1), F.substring(pattern, star + 1, F.length(pattern))
    wild = specifier.startswith(head) & specifier.endswith(tail) & (F.length(specifier) >= F.length(head) + F.length(tail))
    inner = F.substring(specifier, F.length(head) + 1, F.length(specifier) - F.length(head) - F.length(tail))
    return F.when(star > 0, F.when(wild, inner)).when(pattern == specifier, F.lit(""))


def fill_star(target: Column, capture: Column) -> Column:
    """target with its first * replaced."""
    star = F.instr(target, "*")
    return F.when(star > 0, F.concat(F.substring(target, F.lit(1), star - 1), capture, F.substring(target, star + 1, F.length(target)))).otherwise(target)


def template_folder(prefix: Column) -> Column:
    """Of a template's literal beginning, the part up to its last slash."""
    return F.regexp_replace(prefix, r"[^/]*$", "")


def display_label(kind: Column, path: Column, label: Column) -> Column:
    """External and package nodes: their label. Files: the stem, or for an index file the name of its folder."""
    own, folder = stem(path), base_name(dir_name(path))
    file = F.when((F.lower(own) == "index") & (folder != ""), folder).when(own != "", own).when(base_name(path) != "", base_name(path)).otherwise(label)
    return F.when(kind == "file", file).otherwise(label)


def menu_label(path: Column) -> Column:
    """A file's or folder's name and, in brackets, the name of the folder that it is in."""
    parent = base_name(dir_name(path))
    return F.when(parent == "", base_name(path)).otherwise(F.concat(base_name(path), F.lit("  ("), parent, F.lit(")")))


def shown(kind: Column, path: Column, root: Column) -> Column:
    """A path as it is shown: files below the root from there on, all else as it is."""
    return F.when(kind == "file", relative_id(root, path)).otherwise(path)


def classify(kind: Column, path: Column) -> Column:
    """The type of a node in an export."""
    return F.when(kind == "external", "external").when(path.rlike(r"\.d\.[cm]?ts$"), "declaration").otherwise("workspace")


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def subsequence(query: str, target: Column) -> Column:
    """Whether the query's characters occur in order, whatever their case; an empty query never matches."""
    if not query:
        return F.lit(False)
    return F.lower(target).rlike("(?s)" + ".*".join(re.escape(c) for c in query.lower()))
