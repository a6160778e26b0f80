"""From a tree of files to a module graph, in whole and kept current."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.functions import paths as P
from depsight.operators import folders, graphs, resolve
from depsight.sources import imports as reader
from depsight.sources import manifests
from depsight.tables import packed, written

#: Errors that are kept for show.
RING = 64


@dataclass
class Index:
    """nodes, edges, imports (statements), targets (resolved), errors of a tree (files: path, content; owned: id, package of those that are nodes; packages and
    configs: what its manifests say).

    Nodes and edges are worked out and written when they are first asked for; targets are a plan, of which each reads its part. inside (file_id, target, each
    once), far (file_id, target) and parts (as resolve.named() gives them) are what they consist of, where it is at hand.
    """

    files: DataFrame
    owned: DataFrame
    packages: DataFrame
    configs: DataFrame
    imports: DataFrame
    targets: DataFrame
    errors: DataFrame
    include_tests: bool = False
    root_name: str = "."
    inside: DataFrame | None = None
    far: DataFrame | None = None
    parts: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def __post_init__(self) -> None:
        if self.inside is None:
            self.inside = self.targets.where("kind = 'file'").select("file_id", "target").distinct()
        if self.far is None:
            self.far = self.targets.where("kind = 'external'").select("file_id", "target")

    @cached_property
    def owners(self) -> DataFrame:
        """folder, package: files of one folder have one owner, and statements are far more than folders."""
        return written(owners_of_folders(self.owned), "owners")

    @cached_property
    def outside(self) -> DataFrame:
        """owner, target: what a package's files import from outside is one edge of the package, while any file does."""
        owner = F.coalesce("package", F.lit("(unattributed)"))
        uses = self.far.join(self.owners, P.dir_name(F.col("file_id")) == F.col("folder"))
        return written(uses.select(owner.alias("owner"), "target").distinct(), "outside")

    @cached_property
    def nodes(self) -> DataFrame:
        """id, path, label, package, kind: a node for each source file, each owning package with externals and each external."""
        none = F.lit(None).cast("string")
        plain = self.owned.select("id", F.col("id").alias("path"), P.base_name(F.col("id")).alias("label"), "package", F.lit("file").alias("kind"))
        groups = self.outside.select("owner").distinct().select(P.package_id(F.col("owner")).alias("id"), F.col("owner").alias("path"), F.col("owner").alias("label"), F.col("owner").alias("package"), F.lit("workspace_package").alias("kind"))
        others = self.outside.select("target").distinct().select(P.external_id(F.col("target")).alias("id"), F.col("target").alias("path"), F.col("target").alias("label"), none.alias("package"), F.lit("external").alias("kind"))
        return written(plain.unionByName(groups).unionByName(others), "nodes")

    def links(self) -> DataFrame:
        """src, dst, each once, as a plan: for who reads edges no more than once. Those of files and of packages have no row in common."""
        inside = self.inside.select(F.col("file_id").alias("src"), F.col("target").alias("dst"))
        return inside.union(self.outside.select(P.package_id(F.col("owner")), P.external_id(F.col("target"))))

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst."""
        return written(self.links(), "edges")

    def unresolved(self) -> DataFrame:
        """n: dynamic imports that lead to no node."""
        return self.unresolved_of_files().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def unresolved_of_files(self) -> DataFrame:
        """file_id, n: dynamic imports of each file that lead to no node; files without any are left out. Of all statements only those that name the same are resolved."""
        asked = written(self.imports.where("kind = 'dynamic'").select("file_id", "source"), "dynamic")
        return unresolved(asked, self.targets_of(asked.distinct()))

    def targets_of(self, asked: DataFrame) -> DataFrame:
        """The targets of some statements (file_id, source)."""
        some = lambda df: df.join(asked, ["file_id", "source"], "left_semi")
        return some(self.targets) if self.parts is None else nodes_only(resolve.met(*map(some, self.parts), self.files.select("path")), self.include_tests)

    def messages(self, last: int = RING) -> DataFrame:
        """path, message of the last errors by path, as they are shown."""
        text = F.when(F.col("kind") == "read_file", F.concat(F.lit("Couldn't read "), "path", F.lit(": "), "message")).otherwise(F.concat(F.lit("Skipped "), "path", F.lit(": "), "message"))
        return self.errors.select("path", text.alias("message")).orderBy(F.desc("path")).limit(last).orderBy("path")

    def changes(self, new: Index) -> DataFrame:
        """What leads from this graph to the new one: op, entity, id, src, dst."""
        return graphs.diff(self.nodes, self.edges, new.nodes, new.edges)


def build(files: DataFrame, include_tests: bool = False, root_name: str = ".", keep: bool = True) -> Index:
    """The raw graph of all files. keep: files are written first; without, they are a written table already."""
    files = packed(files.select("path", "content"), "files") if keep else files.select("path", "content")
    imports, errors = reader.imports(files.where(P.passes(F.col("path"), include_tests)))
    packages, configs = described(files, root_name)
    paths = files.select("path")
    near, known, far = parts = resolve.named(imports, paths, entries(packages, files), configs)
    found, inside = nodes_only(resolve.met(*parts, paths), include_tests), resolve.met_once(near, known, paths).where(P.passes(F.col("target"), include_tests))
    return Index(files, owners(files, packages, include_tests), packages, configs, imports, found, errors, include_tests, root_name, inside, far.select("file_id", "target"), parts)


def described(files: DataFrame, root_name: str) -> tuple[DataFrame, DataFrame]:
    """Packages and configurations of a tree. Manifests are cut out of its files once: each of their readers would go through all contents again."""
    found = written(files.where(F.col("path").rlike(r"\.(json|yaml|lock)$")), "manifests")
    return manifests.packages(found, root_name), manifests.configs(found)


def owners(files: DataFrame, packages: DataFrame, include_tests: bool) -> DataFrame:
    """id and package of each file that is a node: that of the deepest root above it."""
    sources = files.where(P.passes(F.col("path"), include_tests)).select(F.col("path").alias("id"))
    found = folders.deepest(sources, packages.select(F.col("root").alias("dir"), "name"))
    return written(found.select("id", F.col("name").alias("package")), "owned")


def owners_of_folders(owned: DataFrame) -> DataFrame:
    """folder, package of files (id, package), whose package is that of the deepest root above them."""
    return owned.select(P.dir_name(F.col("id")).alias("folder"), "package").distinct()


def entries(packages: DataFrame, files: DataFrame) -> DataFrame:
    return written(resolve.entries(packages, files.select("path")), "entries")


def targets(imports: DataFrame, files: DataFrame, packages: DataFrame, configs: DataFrame, include_tests: bool) -> DataFrame:
    """file_id, source, kind, target of the imports that lead to a node or out of the tree. A target inside is one of the files, so that its name alone tells whether it is a node."""
    return nodes_only(resolve.resolved(imports, files.select("path"), entries(packages, files), configs), include_tests)


def nodes_only(found: DataFrame, include_tests: bool) -> DataFrame:
    return found.where((F.col("kind") == "external") | P.passes(F.col("target"), include_tests))


def unresolved(dynamic: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, n: of each file those dynamic imports (file_id, source) that lead nowhere; files without any are left out."""
    hit = found.select("file_id", "source").distinct().withColumn("hit", F.lit(True))
    return dynamic.join(hit, ["file_id", "source"], "left").where("hit IS NULL").groupBy("file_id").agg(F.count("*").alias("n"))


def updated(old: Index, changes: DataFrame) -> Index:
    """The index after changes (path, content, removed): only files that changed are parsed and resolved again.

    Imports of other files stay as they were found, but for those of removed files; where files come, go or manifests change, build() finds what else moved.
    """
    changed, kept = changes.select("path").distinct(), changes.where("NOT removed").select("path", "content")
    files = written(old.files.join(changed, "path", "left_anti").unionByName(kept), "files")
    fresh, faults = reader.imports(kept.where(P.passes(F.col("path"), old.include_tests)))
    packages, configs = described(files, old.root_name)
    gone = changes.where("removed").select(F.col("path").alias("target"), F.lit("file").alias("kind")).distinct()
    mine = changed.withColumnRenamed("path", "file_id")
    stay = old.targets.join(mine, "file_id", "left_anti").join(gone, ["target", "kind"], "left_anti")
    found = written(stay.unionByName(targets(fresh, files, packages, configs, old.include_tests)), "targets")
    imports = written(old.imports.join(mine, "file_id", "left_anti").unionByName(fresh), "imports")
    errors = written(old.errors.join(changed, "path", "left_anti").unionByName(faults), "errors")
    return Index(files, owners(files, packages, old.include_tests), packages, configs, imports, found, errors, old.include_tests, old.root_name)


def exported(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """The three lists of an export, sorted, as tables of JSON lines to write with write.text(): nodes, edges, cycles (id, scc rows in)."""
    rows = nodes.select("id", "path", "package", P.classify(F.col("kind"), F.col("path")).alias("type"))
    cycles = members.groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("scc")
    return {
        "nodes": rows.orderBy("id").select(F.to_json(F.struct("*")).alias("value")),
        "edges": edges.orderBy("src", "dst").select(F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))).alias("value")),
        "cycles": cycles.select(F.to_json("ids").alias("value")),
    }
