"""An index that is kept between changes: counts in a store, which a change adds to and takes from.

What a file holds (targets, unresolved imports, its error) is found by its id, what leads to it by its own table, and edges and nodes outside of files count
the files that hold them: one that comes to count nothing goes, one that comes from nothing is new. A change of k files reads the buckets that these files and
what they name fall into, and writes rows for what they hold; nothing else is read or written.

As for a file's own changes alone, packages and configurations are those of the last create(), imports of other files stay as they were resolved, but for those
that lead to a removed file, and a file's unresolved imports are counted when it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depsight.functions import paths as P
from depsight.operators import folders, resolve
from depsight.plans import index
from depsight.sources import imports as reader
from depsight.sources import manifests
from depsight.sources.store import PER_BUCKET, Store, Tables
from depsight.tables import together, written

OUTSIDE = "(unattributed)"


def signed(df: DataFrame, n: int, *cols: str | Column) -> DataFrame:
    return df.select(*cols, F.lit(n).cast("long").alias("n"))


def summed(*parts: DataFrame) -> DataFrame:
    """What is left of signed rows."""
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    names = [c for c in rows.columns if c != "n"]
    return rows.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0")


def uses(found: DataFrame, owners: DataFrame, n: int = 1) -> DataFrame:
    """src (package node), dst (external node), n: files of each package that import from outside. found: file_id, kind, target, each once; owners: folder, package."""
    outside = found.where("kind = 'external'").select("file_id", "target").join(owners, P.dir_name(F.col("file_id")) == F.col("folder"))
    return outside.groupBy(F.coalesce("package", F.lit(OUTSIDE)).alias("owner"), "target").agg((F.count("*") * n).alias("n")).select(P.package_id(F.col("owner")).alias("src"), P.external_id(F.col("target")).alias("dst"), "n")


def ends(of_uses: DataFrame) -> DataFrame:
    """id, kind, n of the nodes at both ends."""
    a = of_uses.select(F.col("src").alias("id"), F.lit("workspace_package").alias("kind"), "n")
    return a.unionByName(of_uses.select(F.col("dst").alias("id"), F.lit("external").alias("kind"), "n")).groupBy("id", "kind").agg(F.sum("n").alias("n"))


def crossed(delta: DataFrame, was: DataFrame, keys: list[str]) -> DataFrame:
    """keys and op (add, remove) of those whose count comes from nothing or to nothing."""
    met = delta.join(was.select(*keys, F.col("n").alias("was")), keys, "left").withColumn("was", F.coalesce("was", F.lit(0)))
    now = F.col("was") + F.col("n")
    return met.select(*keys, F.when((F.col("was") == 0) & (now > 0), "add").when((F.col("was") > 0) & (now == 0), "remove").alias("op")).where("op IS NOT NULL")


@dataclass
class KeptIndex:
    store: Store

    @classmethod
    def create(cls, path: str, files: DataFrame, include_tests: bool = False, root_name: str = ".", per_bucket: int = PER_BUCKET, keep: bool = True) -> KeptIndex:
        """The index of all files (path, content), as the first version in a folder. keep: as in index.build()."""
        spark, g = files.sparkSession, index.build(files, include_tests, root_name, keep)
        listing = written(g.files.select("path").distinct(), "listing")
        kind = lambda df, name: df.select("file_id", F.lit(name).alias("kind"), "target")
        tables = {
            "targets": (kind(g.inside, "file").unionByName(kind(g.far, "external")), ["file_id"], g.imports.count()),
            "listing": (listing, ["path"]), "siblings": (listing.select(P.dir_name(F.col("path")).alias("folder"), "path"), ["folder"]), "files": (g.owned, ["id"]),
            "roots": (g.packages.select(F.col("root").alias("dir"), "name"), ["dir"]), "names": (resolve.entries(g.packages, listing).select("name", "root", "entry"), ["name"]), "configs": (g.configs, ["dir"]),
            "unresolved": (written(g.unresolved_of_files(), "unresolved"), ["file_id"]), "errors": (g.errors.select("kind", "path", "message"), ["path"]),
        }

        def then(draft: Store) -> Tables:  # what follows from targets is read where they are, file by file
            found = draft.all("targets").drop("n")
            held = written(uses(found, g.owners), "uses")
            return {"incoming": (found.where("kind = 'file'").select("target", "file_id"), ["target"]), "uses": (held, ["src", "dst"]), "refs": (ends(held), ["id"])}

        return cls(Store.create(spark, path, tables, {"include_tests": include_tests, "batch": -1}, per_bucket, then))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeptIndex:
        return cls(Store.open(spark, path))

    def nodes(self) -> DataFrame:
        """id, path, label, package, kind."""
        files = self.store.all("files").select("id", F.col("id").alias("path"), P.base_name(F.col("id")).alias("label"), "package", F.lit("file").alias("kind"))
        name = F.regexp_replace("id", "^[a-z]+:", "")
        return files.unionByName(self.store.all("refs").select("id", name.alias("path"), name.alias("label"), F.when(F.col("kind") == "workspace_package", name).alias("package"), "kind"))

    def edges(self) -> DataFrame:
        """src, dst."""
        return self.store.all("targets").where("kind = 'file'").select(F.col("file_id").alias("src"), F.col("target").alias("dst")).union(self.store.all("uses").select("src", "dst"))

    def unresolved(self) -> DataFrame:
        """n: dynamic imports that lead to no node."""
        return self.store.all("unresolved").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def apply(self, changes: DataFrame, batch: int | None = None) -> tuple[KeptIndex, DataFrame | None]:
        """The index after changes (path, content, removed; a row for each path), and what they change in the graph: op, entity, id, src, dst.

        batch: a number that grows; a batch that has been applied isn't applied again, and there is no diff of it.
        """
        if batch is not None and self.store.more["batch"] >= batch:
            return self, None
        store, kept = self.store, (lambda df: written(df, "change"))
        changes = kept(changes.select("path", "content", "removed"))
        came, gone = changes.where("NOT removed").select("path"), changes.where("removed").select("path")
        mine = changes.where(P.passes(F.col("path"), store.more["include_tests"]))
        ids, lost = mine.select(F.col("path").alias("id")), mine.where("removed").select(F.col("path").alias("id"))
        fresh, faults = reader.imports(mine.where("NOT removed"))

        # what is looked up: the store as the change leaves it
        def now(table: str, key: str, new: DataFrame, old: DataFrame):
            def look(keys: DataFrame) -> DataFrame:
                known = store.of(table, keys).drop("n").join(old, old.columns, "left_anti")
                return known.unionByName(new.join(keys.distinct(), key, "left_semi")).distinct()

            return look

        of = lambda table: lambda keys: store.of(table, keys).drop("n")
        in_folder = lambda df: df.select(P.dir_name(F.col("path")).alias("folder"), "path")
        by_file = ids.select(F.col("id").alias("file_id"))
        new_files = folders.deepest(ids.join(lost, "id", "left_anti"), of("roots")).select("id", F.col("name").alias("package"))
        owned, old_files, old_targets, there = together(new_files, store.of("files", ids), store.of("targets", by_file), store.of("listing", changes.select("path")))
        found = resolve.resolved(fresh, now("listing", "path", came, gone), of("names"), of("configs"), now("siblings", "folder", in_folder(came), in_folder(gone)))
        found = kept(found)
        known = now("files", "id", owned, lost)(found.where("kind = 'file'").select(F.col("target").alias("id")))
        found = kept(found.join(known.select(F.col("id").alias("target"), F.lit("file").alias("kind")), ["target", "kind"], "left_semi").unionByName(found.where("kind = 'external'")))

        # what the files held and what led to those that go
        led = store.of("incoming", lost.select(F.col("id").alias("target"))).join(by_file, "file_id", "left_anti")
        row = ("file_id", "kind", "target")
        gone_rows = old_targets.join(lost.withColumnRenamed("id", "file_id"), "file_id", "left_semi")  # of files that go nothing stays, so there is nothing to add up
        targets = summed(signed(found.select(*row).distinct(), 1, *row), signed(old_targets.join(lost.withColumnRenamed("id", "file_id"), "file_id", "left_anti"), -1, *row))
        targets = targets.unionByName(signed(gone_rows, -1, *row)).unionByName(signed(led, -1, "file_id", F.lit("file").alias("kind"), "target"))
        owners = kept(index.owners_of_folders(owned.unionByName(old_files.select("id", "package"))))  # by the same roots
        held = summed(uses(found.select("file_id", "kind", "target").distinct(), owners), uses(old_targets, owners, -1))
        listing = summed(signed(came, 1, "path"), signed(there, -1, "path"))  # a path that is there and comes again is no change
        targets, held, listing, misses = together(targets, held, listing, index.unresolved(fresh.where("kind = 'dynamic'"), found))
        nodes, edges = kept(ends(held).where("n <> 0")), crossed(held, store.of("uses", held), ["src", "dst"])

        none, file_edges = F.lit(None).cast("string"), targets.where("kind = 'file'")
        line = lambda df, op, entity, **cols: df.select(op.alias("op"), F.lit(entity).alias("entity"), *[cols.get(c, none).alias(c) for c in ("id", "src", "dst")])
        own = F.when(F.col("n") > 0, "add").otherwise("remove")
        diff = line(file_edges, own, "edge", src=F.col("file_id"), dst=F.col("target"))
        diff = diff.union(line(edges, F.col("op"), "edge", src=F.col("src"), dst=F.col("dst"))).union(line(crossed(nodes, store.of("refs", nodes), ["id"]), F.col("op"), "node", id=F.col("id")))
        diff = diff.union(line(owned.join(old_files, "id", "left_anti"), F.lit("add"), "node", id=F.col("id"))).union(line(lost.join(old_files, "id", "left_semi"), F.lit("remove"), "node", id=F.col("id")))
        diff = written(diff, "diff")

        errors = store.of("errors", changes.select("path"))
        after = store.commit(
            {
                "listing": listing, "siblings": in_folder(listing).join(listing, "path"), "files": summed(signed(owned, 1, "id", "package"), signed(old_files, -1, "id", "package")), "targets": targets,
                "incoming": file_edges.select("target", "file_id", "n"), "uses": held, "refs": nodes, "unresolved": summed(misses, store.of("unresolved", by_file).select("file_id", (-F.col("n")).alias("n"))),
                "errors": summed(signed(faults, 1, "kind", "path", "message"), signed(errors, -1, "kind", "path", "message")),
            },
            {} if batch is None else {"batch": batch},
        )
        return KeptIndex(after), diff
