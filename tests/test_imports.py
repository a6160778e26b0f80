"""Import statements of everyday files."""

import pytest

from depsight.sources import imports as reader
from depsight.sources.imports import statements


def found(text, extension="ts"):
    return [(s, k) for s, k, *_ in statements(text, extension)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("import { foo } from './foo';", [("./foo", "static")]), ("import Foo from './Foo'", [("./Foo", "static")]), ("import * as u from '../u';", [("../u", "static")]),
        ("import './register';", [("./register", "static")]), ("import type { Foo } from './foo';", [("./foo", "static")]), ("import a, { type b as c } from \"./x\" with { type: 'json' };", [("./x", "static")]),
        ("import a from './a'\nimport b from './b'\nexport const x = 1", [("./a", "static"), ("./b", "static")]),
        ("const f = require('./f');\nimport b from './b';", [("./b", "static"), ("./f", "require")]), ("const n = './f'; require(n); module.require('./q'); new require('./r'); require(`x`)", []),
        ("export * from './a'; export * as n from './b'; export { c, d as e } from './c'; export type { T } from './t'; export type * from './u'", [(f"./{x}", "reexport") for x in "abctu"]),
        ("const a = 1; export { a }; export default a; export type X = { from: './no' };", []),
        ("c ? import('./a') : import(\"./b\", { with: {} })", [("./a", "dynamic"), ("./b", "dynamic")]), ("f(import('./a').then(m => m.x), () => require('./b'))", [("./a", "dynamic"), ("./b", "require")]),
        ("import x = require('./old'); import y from './y'", [("./y", "static")]), ("import.meta.url; import y from './y'", [("./y", "static")]),
        ("@Component({ imports: [S], template: `<a/>` })\nexport class A { constructor(@Inject('R') private r: R) {} }\nimport a from './a'", [("./a", "static")]),
        ("type T = import('./x').Y; let m: typeof import('./y'); let z: Promise<import('./z').Z>; type U = import('./u')\nimport('./real')", [("./real", "dynamic")]),
        ("class A { import(x) {} async import(y: T): Promise<void> {} }; ({ import(x) { return 1 } }); a.import('./x'); import('./real')", [("./real", "dynamic")]),
        ("const r = /[(]/; const s = /'/g; const u = /https?:\\/\\//; import('./a')", [("./a", "dynamic")]), ("x = a / b / c; y = (a) / 2 / '3'; z = a[0] / 2; import('./a') // '", [("./a", "dynamic")]),
        ("if (x) /'/.test(y); const o = {} / 2 / 1; function f() {}\n/`/.exec(s); import('./a')", [("./a", "dynamic")]), ("return_ = i++ / 2; s = `a ${ {b: `c ${'}'}`}.b } /* ${import('./in')}`; require('./a')", [("./in", "dynamic"), ("./a", "require")]),
        ("/* import './no' */ // require('./no')\n'require(\"./no\")'; import '\\x2e/a\\u0062'", [("./ab", "static")]), ("#!/usr/bin/env node '\nimport './a'", [("./a", "static")]),
        ("const x = <T,>(a: T) => a; const y = <any>z; if (a < b && c > d) {}; const m = new Map<string, Array<number>>(); import './a'", [("./a", "static")]), ("let a = b!; let c = b! / 2 / '1'; import './a'", [("./a", "static")]),
        ("switch (x) { case 1: { } /'/.test(y); case a ? b : c: {} /'/.test(z); default: {} /'/ }; import './a'", [("./a", "static")]), ("const o = { a: {} / 2 / '1' }; x ? y : {} / 2; import './a'", [("./a", "static")]),
        ("let p: import('./p') = q; class A { abstract import(x: string): void }; import('./a')", [("./a", "dynamic")]),
        ("", []),
    ],
)
def test_scripts(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("export const A = () => <p>Don't</p>;\nimport b from './b'", [("./b", "static")]), ("const a = <a href='x'>http://x.y {import('./in')} it's</a>; require('./b')", [("./in", "dynamic"), ("./b", "require")]),
        ("const a = <><B.C x={<i/>} {...p} y=\"it's\" /> `{' '}/* no */</>; import './a'", [("./a", "static")]), ("f = <T,>(x: T) => x; g = <T extends U>(x: T) => <b>{x}</b>; h = a < b; k = <Foo<string> x={1}>'</Foo>; import './a'", [("./a", "static")]),
        ("return_ = cond && <p>a > b</p>; const q = list.map(x => <li key={x}>{x ? <b>'</b> : \"'\"}</li>); import './a'", [("./a", "static")]), ("type F = <T>(x: T) => void;\nimport './a'", [("./a", "static")]),
        ("import './a'; type F = <T>(x: T) => void; const p = <Foo />", [("./a", "static")]), ("import './a'; interface G { <T>(x: T): T }; q = <T a='1'></T>", [("./a", "static")]),
        ("import './a'; type P = { render: <T>(x: T, f: (y: T) => (z: T) => T) => JSX.Element }; b = <br/>", [("./a", "static")]), ("import './a'; const o = of<string>('x'); for (const x of <p>it's</p>) {}; b = <br/>", [("./a", "static")]),
        ("import './a'; const e = <b>(optional): it's</b>", [("./a", "static")]),
    ],
)
def test_tags(text, want):
    assert found(text, "tsx") == want


@pytest.mark.parametrize("text", ["import { from './broken'", "const a = 'x\n'", "`${a", "/* x", "f(]", "}", "import a;"])
def test_errors(text):
    with pytest.raises(ValueError):
        statements(text, "ts")


def test_syntax_follows_the_extension():
    with pytest.raises(ValueError, match="tag"):
        statements("const a = <p>x</p>", "js")
    assert found("const a = <p>x</p>; import './a'", "jsx") == [("./a", "static")]
    with pytest.raises(ValueError):
        statements("const a = <p>x</b></p>", "tsx")


def test_templates_and_variables():
    assert statements("import(`./l/${x}`); import(`${d}/f`); import(`./f`); import(n); import(); import('a' + b)", "ts") == [
        ("./l/", "dynamic", True, False), ("", "dynamic", True, True), ("./f", "dynamic", False, False), *[("", "dynamic", False, True)] * 3,
    ]


def test_long_files_are_read():
    assert found("const s = '" + "x\\'" * 500_000 + "'; const t = `" + "y" * 10**6 + "`; /* " + "*" * 10**6 + "*/ import './a'") == [("./a", "static")]


def test_statements_go_back_in_parts():
    """A batch of files with many statements becomes several frames, and none is lost."""
    import pandas as pd

    from depsight.sources.imports import parsed

    batch = pd.DataFrame({"path": [f"f{i}.ts" for i in range(50)], "content": ["\n".join(f"import './m{k}';" for k in range(20))] * 48 + [None, "import {"]})
    frames = list(parsed(iter([batch]), 100))
    assert max(len(x) for x in frames) <= 119 and len(frames) > 5
    assert sum((x["ordinal"] >= 0).sum() for x in frames) == 960 and sum((x["ordinal"] < 0).sum() for x in frames) == 2


def test_heads_of_plain_declarations_are_not_cut_into_tokens(monkeypatch):
    """Plain declarations at a file's beginning are read at once, with the same statements and errors as by tokens (F20)."""
    whole, cut = reader.head, []
    run = reader.Scanner.run
    monkeypatch.setattr(reader.Scanner, "run", lambda self: cut.append(self.end - self.at) or run(self))
    lines = "".join(f"import './{i}';\n" for i in range(50))
    assert reader.statements(lines) == [(f"./{i}", "static", False, False) for i in range(50)] and not cut
    assert reader.statements(lines + "import('k')")[-1] == ("k", "dynamic", False, False) and cut == [len("import './49';\nimport('k')")]
    tails = ["", "import 'a'", "= require('z')", "x = require('w')", "import x = require('w')", "#!/bin/sh", "import {", "</div>", "/r'/.test(a)", "import 'a\\'b';", "import('k').then(f)", "export * from 'm';", ".x()", "}", "import type T from 't'", "type X = import('u').Y"]
    heads = ["import '';", "import \"b\";", "import x from 'c';", "import * as y from 'd';", "import { q, r as s } from 'e';", "import type from 'f';", "import { import } from 'g';"]

    def said(text, extension):
        try:
            return reader.statements(text, extension)
        except ValueError as e:
            return str(e)

    for text in [f"{a}\n{b}" for a in [*heads, "\n".join(heads)] for b in tails]:
        for extension in ("ts", "jsx"):
            monkeypatch.setattr(reader, "head", whole)
            quick = said(text, extension)
            monkeypatch.setattr(reader, "head", lambda _: ([], 0))
            assert quick == said(text, extension), text
