"""Trees: listing, ignore rules, manifests, entry points, barrels, the index and its changes."""

import os

import pytest
from pyspark.sql import functions as F

from depsight.operators import folders, graphs
from depsight.plans import index
from depsight.sources import manifests, tree


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, content string")


def edges(g):
    return {(r["src"], r["dst"]) for r in g.edges.collect()}


def planted(root, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)
    return str(root)


@pytest.mark.parametrize("wide", [1, 1000])
def test_listing(spark, tmp_path, monkeypatch, wide):
    monkeypatch.setattr(tree, "WIDE", wide)
    files = {
        "a.ts": "", "node_modules/p/index.js": "", ".gitignore": "dist/\n/top.ts\n*.log\nfoo(1).ts\n!keep.log\n**/deep/x.ts\nend\\ \n[ab]c.ts\n", "dist/x.ts": "", "top.ts": "", "sub/top.ts": "", "sub/a.log": "", "sub/keep.log": "",
        "foo(1).ts": "", "q/deep/x.ts": "", "q/deep/y.ts": "", ".cache/leaked.ts": "", "apps/w/.gitignore": "chunks\n", "apps/w/chunks/c.ts": "", "apps/w/src/m.ts": "", "ac.ts": "", "cc.ts": "",
    }
    found = {r["path"] for r in tree.listing(spark, planted(tmp_path, files)).collect()}
    assert found == {"a.ts", ".gitignore", "sub/top.ts", "sub/keep.log", "q/deep/y.ts", "apps/w/.gitignore", "apps/w/src/m.ts", "cc.ts"}


def test_ignore_rules_as_a_relation(spark, tmp_path):
    """A table of paths and .gitignore rows gives what the walk gives; deeper files overrule, an ignored folder takes all below along."""
    files = {
        ".gitignore": "dist/\n*.log\n!keep.log\n/top.ts\nout\n", "a/.gitignore": "!special.log\nlocal.ts\n*.ts\n!ok.ts\n", "a/b/.gitignore": "!local.ts\n*.tmp\n", "dist/x.ts": "", "a/dist/deep/x.ts": "", "x.log": "", "keep.log": "", "a/special.log": "", "a/y.log": "",
        "top.ts": "", "a/top.tsx": "", "a/local.ts": "", "a/ok.ts": "", "a/b/local.ts": "", "a/b/c.ts": "", "a/b/d.tmp": "", "d.tmp": "", "out": "", "c/out/z.ts": "", "dist.ts": "", "c/dist": "", "c/dist2/keep.log": "",
    }
    table = frame(spark, files)
    gone = {r["path"] for r in tree.ignored(table, tree.rules_of(table)).collect()}
    walked = {r["path"] for r in tree.listing(spark, planted(tmp_path, files)).collect()}
    assert set(files) - gone == walked and {"dist/x.ts", "a/dist/deep/x.ts", "a/b/c.ts", "out", "c/out/z.ts"} <= gone and {"a/b/local.ts", "c/dist", "a/special.log"} <= walked
    assert tree.ignored(table, tree.rules_of(table.limit(0))).count() == tree.ignored(table.limit(0), tree.rules_of(table)).count() == 0


def test_comments_and_long_strings(spark):
    texts = ['{"a": "http://x", /* c * / */ "b": 1} // end', '{"s": "' + "x\\\\" * 200_000 + '"}', '{"u": "/* no */ \\" // no"}']
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(manifests.without_comments(F.col("t"))).collect()]
    assert out == ['{"a": "http://x",  "b": 1} ', *texts[1:]]


def test_packages(spark):
    files = {
        "package.json": '{"workspaces": {"packages": ["packages/*", "!packages/c"]}}', "packages/a/package.json": '{"name": "@o/a", "main": "lib/x", "types": "", "source": "gone.ts"}', "packages/a/lib/x.ts": "",
        "packages/b/package.json": "not json", "packages/c/package.json": "[]", "packages/c/index.js": "", "other/package.json": '{"name": "no"}',
    }
    rows = {r["root"]: (r["name"], list(r["declared"])) for r in manifests.packages(frame(spark, files), "top").collect()}
    assert rows == {"": ("top", []), "packages/a": ("@o/a", ["gone.ts", "lib/x"]), "packages/c": ("c", [])}
    assert [tuple(r)[:2] for r in manifests.packages(frame(spark, {"a.ts": ""}), "alone").collect()] == [("alone", "")]
    pnpm = {"pnpm-lock.yaml": "", "pnpm-workspace.yaml": "packages:\n  - 'apps/*' # c\n  - packages/*\n", "package.json": '{"name": "r"}', "apps/x/package.json": "{}", "packages/y/package.json": '{"name": "y"}'}
    assert {r["name"] for r in manifests.packages(frame(spark, pnpm)).collect()} == {"r", "x", "y"}


def test_configurations_inherit(spark):
    chain = {f"c{i}.json": f'{{"extends": "./c{i + 1}"}}' for i in range(11)}
    files = chain | {
        "c11.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@x/*": ["lib/*"]}}}', "tsconfig.json": '{"extends": "./c0"}', "own/tsconfig.json": '{"extends": "../tsconfig.json", "compilerOptions": {"paths": {"y": ["z"]}}}',
        "loop/tsconfig.json": '{"extends": "./b.json"}', "loop/b.json": '{"extends": "./tsconfig", "compilerOptions": {"paths": {"p": ["q"]}}}', "bad/tsconfig.json": "nope", "bare/x/tsconfig.json": '{"extends": "@t/n"}',
        "bare/node_modules/@t/n/tsconfig.json": '{"compilerOptions": {"paths": {"bare": ["b"]}}}', "list/tsconfig.json": '{"extends": ["../tsconfig.json"]}',
    }
    rows = {r["dir"]: (r["base_url"], [(p["pattern"], list(p["subs"])) for p in r["paths"]]) for r in manifests.configs(frame(spark, files)).collect()}
    assert rows == {
        "": ("src", [("@x/*", ["lib/*"])]), "own": ("src", [("y", ["z"])]), "loop": ("loop", [("p", ["q"])]), "bare/x": ("bare/node_modules/@t/n", [("bare", ["b"])]), "list": ("list", []),
    }


def test_entry_points_and_barrels(spark):
    files = {
        "package.json": '{"main": "gone.js", "module": "src/m.mjs", "bin": {"a": "./bin/a.js", "b": 1}, "exports": {".": {"import": "./src/e.js"}, "./l": ["./src/l.js"], "./d": "./src/dir/"}}', "src/m.mjs": "", "bin/a.js": "",
        "src/e.js": "", "src/l.js": "", "src/dir/z.ts": "", "src/a.test.ts": "", "src/b.spec.tsx": "", "src/__tests__/c.ts": "", "src/lib.ts": "", "vite.config.ts": "", "src/vite.config.ts": "", "tsconfig.json": '{"compilerOptions": {"paths": {"@p/*": ["libs/p/src/*"], "q": ["src/lib.ts"]}}}',
        "stories/x.story.ts": "",
    }
    found = {r["id"] for r in manifests.entry_points(frame(spark, files), ("**/*.story.ts",)).collect()}
    assert found == {"src/m.mjs", "bin/a.js", "src/e.js", "src/a.test.ts", "src/b.spec.tsx", "src/__tests__/c.ts", "vite.config.ts", "tsconfig.json", "stories/x.story.ts"}
    assert {r["dir"] for r in manifests.declared_barrels(frame(spark, files)).collect()} == {"libs/p/src", "src", "src/dir"}
    assert {tuple(r) for r in manifests.libraries(frame(spark, files), "top").collect()} == {("", "top")}


BASE = {
    "package.json": '{"workspaces": ["p/*"]}', "p/a/package.json": '{"name": "@o/a", "main": "index.ts"}', "p/b/package.json": '{"name": "@o/b"}', "p/a/index.ts": "import './x'; import r from 'react'", "p/a/x.ts": "", "p/b/y.ts": "import '@o/a'; import 'react/jsx'",
    "loader.ts": "import(`./locales/${l}`); import(n)", "locales/en.ts": "", "locales/fr.ts": "", "broken.ts": "import { from './x'", "consumer.ts": "import './broken'", "jsx.tsx": "export const A = () => <p>Don't</p>;\nimport './consumer'",
}


def test_index(spark):
    g = index.build(frame(spark, BASE), root_name="top")
    assert edges(g) == {
        ("p/a/index.ts", "p/a/x.ts"), ("p/b/y.ts", "p/a/index.ts"), ("loader.ts", "locales/en.ts"), ("loader.ts", "locales/fr.ts"), ("consumer.ts", "broken.ts"), ("jsx.tsx", "consumer.ts"),
        ("package:@o/a", "external:react"), ("package:@o/b", "external:react"),
    }
    assert g.unresolved().first()["n"] == 1
    assert [(r["path"], r["message"].split(":")[0]) for r in g.messages().collect()] == [("broken.ts", "Skipped broken.ts")]
    assert {r["id"]: r["package"] for r in g.nodes.where("kind = 'file'").collect()} == {p: "@o/a" if p.startswith("p/a") else "@o/b" if p.startswith("p/b") else "top" for p in BASE if not p.endswith("json")}


def change(spark, old, rows):
    new = index.updated(old, spark.createDataFrame([(p, t, t is None) for p, t in rows.items()], "path string, content string, removed boolean"))
    return new, old.changes(new)


def test_changes_of_an_index(spark):
    g = index.build(frame(spark, BASE))
    one, diff = change(spark, g, {"p/a/index.ts": "import './x'"})  # the package's last use goes, another package's stays
    assert {tuple(r) for r in diff.collect()} == {("remove", "edge", None, "package:@o/a", "external:react"), ("remove", "node", "package:@o/a", None, None)}
    two, more = change(spark, one, {"p/a/x.ts": None, "p/b/y.ts": "import 'vue'", "new.ts": "import './consumer'"})
    rows = {(r["op"], r["id"] or (r["src"], r["dst"])) for r in more.collect()}
    assert rows == {
        ("remove", "p/a/x.ts"), ("remove", ("p/a/index.ts", "p/a/x.ts")), ("remove", ("p/b/y.ts", "p/a/index.ts")), ("remove", ("package:@o/b", "external:react")), ("remove", "external:react"), ("add", "external:vue"),
        ("add", ("package:@o/b", "external:vue")), ("add", "new.ts"), ("add", ("new.ts", "consumer.ts")),
    }
    nodes, moved = graphs.applied(g.nodes, g.edges, graphs.merged(diff, more))
    assert {tuple(r) for r in moved.collect()} == edges(two) and {r["id"] for r in nodes.collect()} == {r["id"] for r in two.nodes.collect()}
    again = index.build(two.files)
    assert edges(again) == edges(two) and again.changes(two).count() == 0


def test_clicks_on_a_package_tree(spark):
    nodes = spark.createDataFrame([(p, p, p.rpartition("/")[2], "k", "file") for p in ("k/a/x.ts", "k/a/y.ts", "k/a/in/z.ts", "k/b/w.ts")], "id string, path string, label string, package string, kind string")
    rows = lambda *hidden: folders.tree_rows(nodes, spark.createDataFrame([(h,) for h in hidden], "id string"))
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(folders.leaves(rows(), "k", "a")) == {"k/a/x.ts", "k/a/y.ts", "k/a/in/z.ts"} and len(ids(folders.leaves(rows(), "k"))) == 4
    assert ids(folders.cascaded(rows("k/b/w.ts"), "k", "a")) == {"k/a/x.ts", "k/a/y.ts", "k/a/in/z.ts"}
    assert ids(folders.cascaded(rows("k/a/y.ts"), "k", "a")) == {"k/a/y.ts"} and ids(folders.cascaded(rows(), "k", "gone")) == set()


def test_a_package_tree_in_order(spark):
    """Siblings by name, folders and files together; buckets after packages; leaves of a folder are the places below it."""
    files = [("k/a/x.ts", "k"), ("k/a/y.ts", "k"), ("k/a/in/z.ts", "k"), ("k/b.ts", "k"), ("k/b/w.ts", "k"), ("j/only/one.ts", "j"), ("loose.ts", None)]
    nodes = [(p, p, p.rpartition("/")[2], k, "file") for p, k in files] + [("external:vue", "vue", "vue", None, "external"), ("external:ant", "ant", "ant", None, "external"), ("package:k", "k", "k", "k", "workspace_package")]
    nodes = spark.createDataFrame(nodes, "id string, path string, label string, package string, kind string")
    hidden = spark.createDataFrame([("k/a/y.ts",), ("external:vue",), ("external:ant",)], "id string")
    tree_ = folders.tree_order(nodes, hidden).cache()
    rows = [(r["row"], r["name"] if r["row"] != "leaf" else r["id"], r["depth"], r["state"], r["leaves"], r["last"]) for r in tree_.orderBy("first").collect()]
    assert [r["first"] for r in tree_.orderBy("first").collect()] == list(range(len(rows)))
    assert rows == [
        ("package", "j", 0, "checked", 1, 1), ("leaf", "j/only/one.ts", 1, "checked", 1, 1), ("package", "k", 0, "mixed", 5, 10), ("folder", "a", 1, "mixed", 3, 7), ("folder", "in", 2, "checked", 1, 5), ("leaf", "k/a/in/z.ts", 3, "checked", 1, 5),
        ("leaf", "k/a/x.ts", 2, "checked", 1, 6), ("leaf", "k/a/y.ts", 2, "unchecked", 1, 7), ("folder", "b", 1, "checked", 1, 9), ("leaf", "k/b/w.ts", 2, "checked", 1, 9), ("leaf", "k/b.ts", 1, "checked", 1, 10),
        ("bucket", "external", 0, "unchecked", 2, 13), ("leaf", "external:ant", 1, "unchecked", 1, 12), ("leaf", "external:vue", 1, "unchecked", 1, 13), ("bucket", "unpackaged", 0, "checked", 1, 15), ("leaf", "loose.ts", 1, "checked", 1, 15),
    ]
    flat = folders.tree_rows(nodes, hidden)
    for folder in ("", "a", "a/in", "b", "gone"):
        assert {r["id"] for r in folders.leaves_between(tree_, "k", folder).collect()} == {r["id"] for r in folders.leaves(flat, "k", folder).collect()}
    assert folders.tree_order(nodes.limit(0), hidden).count() == 0


def test_folders_are_looked_up_once_for_all_their_files(spark):
    """deepest() spreads distinct folders, not files, over their ancestors."""
    from depsight.operators import folders

    files = spark.createDataFrame([(f"a/b/{i}.ts",) for i in range(30)] + [("top.ts",), (None,)], "id string")
    table, asked = spark.createDataFrame([("a", "x"), ("a/b", "y"), ("a/b/1.ts", "z")], "dir string, owner string"), []
    got = folders.deepest(files, lambda keys: asked.append(keys.count()) or table.join(keys.distinct(), "dir", "left_semi")).collect()
    assert {r["id"]: r["owner"] for r in got} == {**{f"a/b/{i}.ts": "y" for i in range(30)}, "top.ts": None, None: None}
    assert asked[0] <= 4
