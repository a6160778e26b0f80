"""Source trees as tables: the listing, ignore rules and the contents of files.

Folders are listed by tasks, level by level; contents are read by tasks. Trees that are tables already (path, content) skip the walk.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsight.functions import paths as P
from depsight.tables import written

PRUNED = {"node_modules"}
#: Folders of a level from which on the tasks below walk whole trees.
WIDE = 64


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (root-relative) of every file below root: no hidden or ignored ones, none in node_modules, links not followed.

    The driver lists the first levels, until they are WIDE; from there each folder's tree is one row's work, and names go from tasks to the table.
    """
    level, rules, found = [""], {"": []}, []
    while level and len(level) < WIDE:
        below = []
        for folder in level:
            names, files, own = inside(root, folder, rules[folder])
            found += files
            below += names
            rules |= dict.fromkeys(names, own)
        level = below
    known = spark.createDataFrame([(x,) for x in found], "path string")
    if not level:
        return known

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                todo = [(row["folder"], [(r["expression"], r["folders"], r["negated"]) for r in row["rules"]])]
                while todo:
                    at, above = todo.pop()
                    names, files, own = inside(root, at, above)
                    todo += [(n, own) for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["path"])

    rows = [(f, [tuple(r) for r in rules[f]]) for f in level]
    starts = spark.createDataFrame(rows, "folder string, rules array<struct<expression: string, folders: boolean, negated: boolean>>").repartition(len(rows))
    return known.unionByName(starts.mapInArrow(walk, "path string"))


def inside(root: str, folder: str, above: list[tuple[str, bool, bool]]) -> tuple[list[str], list[str], list[tuple[str, bool, bool]]]:
    """The folders and files of one folder that count, and the ignore rules from there on."""
    with os.scandir(os.path.join(root, folder)) as entries:
        each = sorted(((e.name, e.is_dir(follow_symlinks=False), e.is_symlink()) for e in entries), key=lambda e: e[0])
    rules = above
    if any(n == ".gitignore" for n, _, _ in each):
        with open(os.path.join(root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            rules = above + ignore_rules(folder, f.read())
    full = lambda n: f"{folder}/{n}" if folder else n
    names = [full(n) for n, d, link in each if d and not link and n not in PRUNED and not n.startswith(".") and not ignored_by(rules, full(n), True)]
    files = [full(n) for n, d, link in each if not d and not link and (not n.startswith(".") or n == ".gitignore") and not ignored_by(rules, full(n), False)]
    return names, files, rules


def part_expression(part: str) -> str:
    """A name's pattern in an ignore file as an expression: * and ? stay within the name, [] is a class, a backslash takes the next character as it is."""
    out, at = "", 0
    while at < len(part):
        c = part[at]
        at += 1
        if c == "\\" and at < len(part):
            out += re.escape(part[at])
            at += 1
        elif c == "[" and (end := part.find("]", at + 1 + (part[at : at + 1] in ("!", "^")))) > 0:
            body = part[at:end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[^{body[1:]}]" if body[0] in "!^" else f"[{body}]"
            at = end + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
    return out


def ignore_rules(folder: str, text: str) -> list[tuple[str, bool, bool]]:
    """(expression over root-relative paths, only folders, negated) for each line of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        only_folders, body = line.endswith("/"), line.strip("/")
        if not body:
            continue
        anchored = "/" in line.rstrip("/")
        parts, expression = body.split("/"), ""
        for k, p in enumerate(parts):
            last = k == len(parts) - 1
            if p == "**":
                expression += ".*" if last else "(.*/)?"
            else:
                expression += part_expression(p) + ("" if last else "/")
        head = re.escape(folder) + "/" if folder else ""
        out.append((f"^{head}{'' if anchored else '(.*/)?'}{expression}$", only_folders, negated))
    return out


def ignored_by(rules: list[tuple[str, bool, bool]], path: str, is_folder: bool) -> bool:
    hit = False
    for expression, only_folders, negated in rules:
        if (is_folder or not only_folders) and re.match(expression, path):
            hit = not negated
    return hit


def rules_of(files: DataFrame) -> DataFrame:
    """folder, place, expression, folders, negated: a row for each rule of every .gitignore among files (path, content), placed as in its file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["content"], strict=True):
                folder = path.rpartition("/")[0]
                yield pd.DataFrame([(folder, k, *r) for k, r in enumerate(ignore_rules(folder, text or ""))], columns=["folder", "place", "expression", "folders", "negated"])

    found = files.where(F.col("path").rlike(r"(^|/)\.gitignore$")).select("path", "content")
    return found.mapInPandas(read, "folder string, place int, expression string, folders boolean, negated boolean")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path of the files (path) that rules (as rules_of() gives them) leave out.

    A file and each folder above it meet, by equality, the rules of the folders that they are in. Of those that match one of them the last of the deepest folder
    decides; a file goes with any folder above it. No rule is compared with paths outside of its folder, and no list of rules is gathered.
    """
    parts = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    each = paths.select("path").distinct().select("path", F.explode(parts).alias("part"))
    parts_only = each.select("part", (F.col("part") != F.col("path")).alias("is_folder")).distinct()
    spread = parts_only.select("part", "is_folder", F.explode(P.ancestors(F.col("part"))).alias("folder"))
    hit = spread.join(rules, "folder").where((F.col("is_folder") | ~F.col("folders")) & F.expr("part RLIKE expression"))
    last = hit.groupBy("part", "is_folder").agg(F.max_by("negated", F.struct(F.length("folder"), "place")).alias("negated")).where("NOT negated")
    asked = each.withColumn("is_folder", F.col("part") != F.col("path"))
    return asked.join(last, ["part", "is_folder"], "left_semi").select("path").distinct()


def contents(paths: DataFrame, root: str) -> DataFrame:
    """path, content (null if it can't be read as UTF-8), read by tasks from a folder that they reach."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["path"]:
                try:
                    with open(os.path.join(root, p), encoding="utf-8") as f:
                        out.append(f.read())
                except (OSError, UnicodeDecodeError):
                    out.append(None)
            yield pd.DataFrame({"path": b["path"], "content": out})

    return paths.select("path").mapInPandas(read, "path string, content string")
