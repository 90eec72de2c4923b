"""Planted source trees: scripts, other languages, graphs of calls, links and what lies inside symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, graph
from ..sources import code, languages, scripts
from .planted import planted

FILES = "path string, text string"

# -- scripts -----------------------------------------------------------------------

CONFIGS = [
    ("r{k}/packages/tsconfig/package.json", '{"name": "@org{k}/tsconfig"}'),
    ("r{k}/packages/tsconfig/base.json", '{ // shared\n "compilerOptions": {"paths": {"~shared/*": ["../shared/src/*"], "@/*": ["./never/*"]}},\n}'),
    ("r{k}/apps/web/tsconfig.json", '{"extends": "@org{k}/tsconfig/base.json", "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"], "@env": ["env.ts"]}}}'),
    ("r{k}/apps/admin/tsconfig.json", '{"extends": "../web/tsconfig", "compilerOptions": {"paths": {"@/*": ["./app/*", "./lib/*"],},},}'),
]
planted(
    "alias_map",
    {"files": (FILES, CONFIGS)},
    lambda files: scripts.alias_map(files, scripts.package_targets(files).select("name", "dir").distinct()),
    "workspace prefix target exact nth",
    [
        ("r{k}/apps/web", "@/", "r{k}/apps/web/src/", False, 0),
        ("r{k}/apps/web", "@env", "r{k}/apps/web/env.ts", True, 0),
        ("r{k}/apps/web", "~shared/", "r{k}/packages/shared/src/", False, 0),
        ("r{k}/apps/web", "", "r{k}/apps/web/", False, 0),
        ("r{k}/apps/admin", "@/", "r{k}/apps/admin/app/", False, 0),
        ("r{k}/apps/admin", "@/", "r{k}/apps/admin/lib/", False, 1),
        ("r{k}/apps/admin", "@env", "r{k}/apps/web/env.ts", True, 0),
        ("r{k}/apps/admin", "~shared/", "r{k}/packages/shared/src/", False, 0),
        ("r{k}/apps/admin", "", "r{k}/apps/web/", False, 0),
    ],
)

SCRIPT = """// function commented() {}
import React, { useState as us, type X } from 'react';
export * from './all';
export { a as b } from './ab';
export const one = () => { return "}" }, two = {k};
export async function load(x: string): Promise<void> {
  const t = `a ${x ? `in ${1}` : '}'} b`;
  const late = await import('./late');
  return /[}/]/.test(t)
}
export default function Page() {
  return <div className="x">{one()}</div>;
}
@Injectable()
export class Svc {
  private n = 1;
  constructor(a: A) { super(); }
  async find(id: string) {
    if (id) { return 1 }
  }
}
enum E { A, B }
const Card = memo(function Card() { return null });
const helper = require('./helper');
function over(a: string): void;
function over(a: any) { }
export { over as renamed };
interface I { x: number }
"""
planted(
    "script_definitions",
    {"files": (FILES, [("r{k}/a.tsx", SCRIPT), ("r{k}/a.d.ts", "export declare function no(): void"), ("r{k}/a.py", "def no(): pass"), ("r{k}/empty.ts", None)])},
    lambda files: scripts.definitions(scripts.scan_scripts(files)).withColumnRenamed("end", "last"),
    "path kind name start last parent exported wrapper",
    [
        ("r{k}/a.tsx", "function", "one", 5, 5, None, True, "none"),
        ("r{k}/a.tsx", "const", "two", 5, 5, None, True, "none"),
        ("r{k}/a.tsx", "function", "load", 6, 10, None, True, "none"),
        ("r{k}/a.tsx", "component", "Page", 11, 13, None, True, "none"),
        ("r{k}/a.tsx", "class", "Svc", 14, 21, None, True, "none"),
        ("r{k}/a.tsx", "method", "constructor", 17, 17, "Svc", False, "none"),
        ("r{k}/a.tsx", "method", "find", 18, 20, "Svc", False, "none"),
        ("r{k}/a.tsx", "enum", "E", 22, 22, None, False, "none"),
        ("r{k}/a.tsx", "component", "Card", 23, 23, None, False, "memo"),
        ("r{k}/a.tsx", "function", "over", 26, 26, None, True, "none"),
    ],
)
planted(
    "script_imports",
    {"files": (FILES, [("r{k}/a.tsx", SCRIPT)])},
    lambda files: scripts.imports(scripts.scan_scripts(files)),
    "path kind spec name local line types",
    [
        ("r{k}/a.tsx", "named", "react", "useState", "us", 2, False),
        ("r{k}/a.tsx", "named", "react", "X", "X", 2, True),
        ("r{k}/a.tsx", "default", "react", "default", "React", 2, False),
        ("r{k}/a.tsx", "reexport", "./all", None, None, 3, False),
        ("r{k}/a.tsx", "reexport", "./ab", None, None, 4, False),
        ("r{k}/a.tsx", "dynamic", "./late", None, None, 8, False),
        ("r{k}/a.tsx", "require", "./helper", None, None, 24, False),
    ],
)

REPO = [
    *CONFIGS,
    ("r{k}/packages/shared/package.json", '{"name": "@org{k}/shared", "exports": {".": {"types": "./t.d.ts", "import": "./src/index.ts"}, "./money": "./src/money.ts", "./ui/*": "./src/ui/*.tsx"}}'),
    ("r{k}/packages/shared/src/index.ts", "export * from './money';\nexport { Button as Primary } from './ui/button';\nexport * from './index2';"),
    ("r{k}/packages/shared/src/index2.ts", "export * from './index';\nexport { deep } from './deep';"),
    ("r{k}/packages/shared/src/deep.ts", "export { deep } from 'lodash';"),
    ("r{k}/packages/shared/src/money.ts", "export function pay() { round(1) }\nfunction round(x) { return x }"),
    ("r{k}/packages/shared/src/ui/button.tsx", "export const Button = () => <button />;"),
    ("r{k}/apps/web/src/page.tsx", "import { pay, Primary, deep, gone } from '@org{k}/shared';\nimport { cents } from '@/money.js';\nimport m from '@org{k}/shared/money';\nimport B from '@org{k}/shared/ui/button';\nimport react from 'react';\nimport x from './nowhere';\nimport { s } from '~shared/money';\nexport default function Page() {\n  cents();\n  return <Primary onClick={() => local()} />;\n}\nfunction local() { pay(); again() }\nfunction again() { local() }"),
    ("r{k}/apps/web/src/money.ts", "import { pay } from '@org{k}/shared';\nexport const cents = () => { pay() };"),
]
RESOLVED = [
    ("r{k}/apps/web/src/page.tsx", "@org{k}/shared", "r{k}/packages/shared/src/index.ts", "workspace"),
    ("r{k}/apps/web/src/page.tsx", "@/money.js", "r{k}/apps/web/src/money.ts", "alias"),
    ("r{k}/apps/web/src/page.tsx", "@org{k}/shared/money", "r{k}/packages/shared/src/money.ts", "workspace"),
    ("r{k}/apps/web/src/page.tsx", "@org{k}/shared/ui/button", "r{k}/packages/shared/src/ui/button.tsx", "workspace"),
    ("r{k}/apps/web/src/page.tsx", "react", None, "external"),
    ("r{k}/apps/web/src/page.tsx", "./nowhere", None, "unresolved"),
    ("r{k}/apps/web/src/page.tsx", "~shared/money", "r{k}/packages/shared/src/money.ts", "alias"),
    ("r{k}/apps/web/src/money.ts", "@org{k}/shared", "r{k}/packages/shared/src/index.ts", "workspace"),
    ("r{k}/packages/shared/src/index.ts", "./money", "r{k}/packages/shared/src/money.ts", "relative"),
    ("r{k}/packages/shared/src/index.ts", "./ui/button", "r{k}/packages/shared/src/ui/button.tsx", "relative"),
    ("r{k}/packages/shared/src/index.ts", "./index2", "r{k}/packages/shared/src/index2.ts", "relative"),
    ("r{k}/packages/shared/src/index2.ts", "./index", "r{k}/packages/shared/src/index.ts", "relative"),
    ("r{k}/packages/shared/src/index2.ts", "./deep", "r{k}/packages/shared/src/deep.ts", "relative"),
    ("r{k}/packages/shared/src/deep.ts", "lodash", None, "external"),
]


def _resolved(files):
    packages = scripts.package_targets(files).checkpoint()
    specs = scripts.imports(scripts.scan_scripts(files)).select(F.col("path").alias("importer"), "spec")
    return scripts.resolve(specs, files, scripts.alias_map(files, packages.select("name", "dir").distinct()), packages)


planted("import_resolution", {"files": (FILES, REPO)}, _resolved, "importer spec target how", RESOLVED)
planted("script_edges", {"files": (FILES, REPO)}, scripts.script_edges, "importer target", sorted({(a, c) for a, _, c, _ in RESOLVED if c}))

SYMBOLS = [
    ("r{k}/apps/web/src/page.tsx", "pay", "r{k}/packages/shared/src/money.ts", "pay", "r{k}/packages/shared/src/index.ts"),
    ("r{k}/apps/web/src/page.tsx", "Primary", "r{k}/packages/shared/src/ui/button.tsx", "Button", "r{k}/packages/shared/src/index.ts"),
    ("r{k}/apps/web/src/page.tsx", "deep", "r{k}/packages/shared/src/deep.ts", "deep", "r{k}/packages/shared/src/index.ts>r{k}/packages/shared/src/index2.ts"),
    ("r{k}/apps/web/src/page.tsx", "gone", "r{k}/packages/shared/src/index.ts", "gone", ""),
    ("r{k}/apps/web/src/page.tsx", "cents", "r{k}/apps/web/src/money.ts", "cents", ""),
    ("r{k}/apps/web/src/page.tsx", "m", "r{k}/packages/shared/src/money.ts", "default", ""),
    ("r{k}/apps/web/src/page.tsx", "B", "r{k}/packages/shared/src/ui/button.tsx", "default", ""),
    ("r{k}/apps/web/src/page.tsx", "s", "r{k}/packages/shared/src/money.ts", "s", ""),
    ("r{k}/apps/web/src/money.ts", "pay", "r{k}/packages/shared/src/money.ts", "pay", "r{k}/packages/shared/src/index.ts"),
]
planted("barrel_chase", {"files": (FILES, REPO)}, lambda files: scripts.symbol_edges(files).withColumn("via", F.array_join("via", ">")), "importer local target original via", SYMBOLS)


def _graph(files):
    scanned, sites = calls.scan_calls(files)
    edges = scripts.symbol_edges(files, scanned)
    definitions = scripts.definitions(scanned)
    return calls.call_edges(sites, definitions, edges), definitions


planted(
    "symbol_calls",
    {"files": (FILES, REPO)},
    lambda files: _graph(files)[0],
    "path caller to_path callee cross confidence",
    [
        ("r{k}/apps/web/src/page.tsx", "Page", "r{k}/apps/web/src/money.ts", "cents", True, "high"),
        ("r{k}/apps/web/src/page.tsx", "Page", "r{k}/packages/shared/src/ui/button.tsx", "Button", True, "high"),
        ("r{k}/apps/web/src/page.tsx", "Page", "r{k}/apps/web/src/page.tsx", "local", False, "medium"),
        ("r{k}/apps/web/src/page.tsx", "local", "r{k}/packages/shared/src/money.ts", "pay", True, "high"),
        ("r{k}/apps/web/src/page.tsx", "local", "r{k}/apps/web/src/page.tsx", "again", False, "medium"),
        ("r{k}/apps/web/src/page.tsx", "again", "r{k}/apps/web/src/page.tsx", "local", False, "medium"),
        ("r{k}/apps/web/src/money.ts", "cents", "r{k}/packages/shared/src/money.ts", "pay", True, "high"),
        ("r{k}/packages/shared/src/money.ts", "pay", "r{k}/packages/shared/src/money.ts", "round", False, "medium"),
    ],
)
ENTRIES = ("flow string, path string, symbol string", [("f{k}", "r{k}/apps/web/src/page.tsx", "Page")])
REACHED = [
    ("f{k}", "r{k}/apps/web/src/page.tsx", "Page", 0, "entry"),
    ("f{k}", "r{k}/apps/web/src/money.ts", "cents", 1, "import"),
    ("f{k}", "r{k}/packages/shared/src/ui/button.tsx", "Button", 1, "import"),
    ("f{k}", "r{k}/apps/web/src/page.tsx", "local", 1, "call"),
    ("f{k}", "r{k}/apps/web/src/page.tsx", "again", 2, "call"),
]
planted("call_graph", {"files": (FILES, REPO), "entries": ENTRIES}, lambda files, entries: calls.call_graph(_graph(files)[0], entries), "flow path symbol depth kind", REACHED)
planted(
    "call_graph_cap",
    {"files": (FILES, REPO), "entries": ENTRIES},
    lambda files, entries: calls.call_graph(_graph(files)[0], entries, most=3),
    "flow path symbol depth kind",
    [REACHED[0], REACHED[1], REACHED[3], ("f{k}", None, None, 1, "deep_call_subtree")],
)


def _lines(files, entries):
    edges, definitions = _graph(files)
    return calls.participants(calls.call_graph(edges, entries), definitions).withColumnRenamed("end", "last")


planted(
    "flow_symbol_lines",
    {"files": (FILES, REPO), "entries": ENTRIES},
    _lines,
    "flow path symbol start last role",
    [
        ("f{k}", "r{k}/apps/web/src/page.tsx", "Page", 8, 11, "entry"),
        ("f{k}", "r{k}/apps/web/src/money.ts", "cents", 2, 2, "support"),
        ("f{k}", "r{k}/packages/shared/src/ui/button.tsx", "Button", 1, 1, "support"),
        ("f{k}", "r{k}/apps/web/src/page.tsx", "local", 12, 12, "support"),
        ("f{k}", "r{k}/apps/web/src/page.tsx", "again", 13, 13, "support"),
    ],
)

# -- other languages ---------------------------------------------------------------

GO = [
    ("g{k}/go.mod", "module example.com/g{k}\n\ngo 1.22\n"),
    ("g{k}/main.go", 'package main\n\nimport (\n\t"fmt"\n\tstore "example.com/g{k}/internal/store" // the store\n)\n// import "example.com/g{k}/no"\nimport "example.com/g{k}/pkg/api"\n'),
    ("g{k}/internal/store/store_test.go", "package store"),
    ("g{k}/internal/store/zed.go", "package store"),
    ("g{k}/internal/store/db.go", 'package store\nimport "example.com/g{k}x/other"'),
    ("g{k}/pkg/api/v1/a.go", "package v1"),
    ("g{k}/no/a.go", "package no"),
]
planted("go_edges", {"files": (FILES, GO)}, languages.go_edges, "importer target", [("g{k}/main.go", "g{k}/internal/store/db.go"), ("g{k}/main.go", "g{k}/pkg/api/v1/a.go")])
RUST = [
    ("c{k}/src/main.rs", "mod config;\npub mod net;\n// mod dead;\nuse crate::net::{tcp::Conn, udp, self};\nuse crate::config::Settings;\nuse std::io;"),
    ("c{k}/src/config.rs", "use crate::net::tcp::Conn as C;\nmod inner;"),
    ("c{k}/src/config/inner.rs", ""),
    ("c{k}/src/net/mod.rs", "mod tcp;\nmod udp;"),
    ("c{k}/src/net/tcp.rs", ""),
    ("c{k}/src/net/udp.rs", ""),
    ("c{k}/src/dead.rs", ""),
]
planted(
    "rust_edges",
    {"files": (FILES, RUST)},
    languages.rust_edges,
    "importer target",
    [("c{k}/src/main.rs", x) for x in ("c{k}/src/config.rs", "c{k}/src/net/mod.rs", "c{k}/src/net/tcp.rs", "c{k}/src/net/udp.rs")]
    + [("c{k}/src/config.rs", "c{k}/src/net/tcp.rs"), ("c{k}/src/config.rs", "c{k}/src/config/inner.rs"), ("c{k}/src/net/mod.rs", "c{k}/src/net/tcp.rs"), ("c{k}/src/net/mod.rs", "c{k}/src/net/udp.rs")],
)
PYTHON = [
    ("p{k}/app/main.py", "from . import views\nfrom .models import User, missing\nimport os\n\nclass A:\n    def run(self):\n        self.go()\n        helper()\n\n    def go(self):\n        from .late import thing\n        return thing\n\ndef helper():\n    pass\n"),
    ("p{k}/app/views.py", "def x(:"),
    ("p{k}/app/models/__init__.py", "try:\n    from p{k}.app import late\nexcept ImportError:\n    late = None\n"),
    ("p{k}/app/late.py", "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from .models import User\n\ndef thing():\n    try:\n        import p{k}.app.views\n    except ImportError:\n        pass\n"),
]
planted(
    "python_symbols",
    {"files": (FILES, PYTHON)},
    lambda files: code.python_symbols(files).where("kind <> 'import'").withColumnRenamed("end", "last"),
    "path kind name start last",
    [
        ("p{k}/app/main.py", "class", "A", 5, 12), ("p{k}/app/main.py", "function", "run", 6, 8), ("p{k}/app/main.py", "function", "go", 10, 12), ("p{k}/app/main.py", "function", "helper", 14, 15),
        ("p{k}/app/views.py", "error", None, None, None), ("p{k}/app/late.py", "function", "thing", 5, 9),
    ],
)
planted("python_edges", {"files": (FILES, PYTHON)}, code.python_edges, "importer target", [("p{k}/app/main.py", "p{k}/app/views.py"), ("p{k}/app/main.py", "p{k}/app/models/__init__.py"), ("p{k}/app/main.py", "p{k}/app/late.py"), ("p{k}/app/models/__init__.py", "p{k}/app/late.py"), ("p{k}/app/late.py", "p{k}/app/models/__init__.py"), ("p{k}/app/late.py", "p{k}/app/views.py")])
planted(
    "python_candidates",
    {"imports": ("path string, kind string, name string, module string, level int", [("p{k}/a/b.py", "import", "x", "m", 1)])},
    code.python_candidates,
    "importer module name nth path",
    [("p{k}/a/b.py", "m", "x", n, p) for n, p in enumerate(("p{k}/a/m/x.py", "p{k}/a/m/x/__init__.py", "p{k}/a/m.py", "p{k}/a/m/__init__.py", "src/p{k}/a/m/x.py", "src/p{k}/a/m/x/__init__.py", "src/p{k}/a/m.py", "src/p{k}/a/m/__init__.py"))],
)
planted("python_calls", {"files": (FILES, PYTHON)}, calls.calls, "path caller callee line", [("p{k}/app/main.py", "run", "go", 7), ("p{k}/app/main.py", "run", "helper", 8)])
LATE = [*PYTHON, ("p{k}/web/a.ts", "const early = import('./b');\nfunction f() { return require('../app/none') || import(`./${x}`) }"), ("p{k}/web/b.ts", "export const b = 1")]
planted(
    "late_imports",
    {"files": (FILES, LATE)},
    languages.late_edges,
    "importer target line optional",
    [("p{k}/app/main.py", "p{k}/app/late.py", 11, False), ("p{k}/app/late.py", "p{k}/app/views.py", 7, True), ("p{k}/web/a.ts", "p{k}/web/b.ts", 1, False)],
)

# -- dispatch ----------------------------------------------------------------------

DISPATCH = [
    ("d{k}/factory.py", "def client(kind):\n    if kind == 'edr':\n        from .edr import EdrClient\n        return EdrClient()\n    elif kind == 'siem':\n        from .siem import make\n        return make\n    return None\n\ndef one(kind):\n    if kind == 'a':\n        from .lone import L\n        return L\n"),
    ("d{k}/edr.py", ""), ("d{k}/siem.py", ""), ("d{k}/lone.py", ""),
    ("d{k}/pick.ts", "import { runA } from './a';\nimport { runB } from './b';\nexport function pick(k) {\n  switch (k) {\n    case 'a': return runA;\n    case \"b\": { return runB(k) }\n    default: return null;\n  }\n}"),
    ("d{k}/a.ts", ""), ("d{k}/b.ts", ""),
    ("d{k}/map.ts", "export const all = {\n  one: () => import('./a'),\n  'two': import('./b'),\n};"),
]
TARGETS = [
    ("d{k}/factory.py", "edr", "d{k}/edr.py", "EdrClient"), ("d{k}/factory.py", "siem", "d{k}/siem.py", "make"), ("d{k}/pick.ts", "a", "d{k}/a.ts", "runA"), ("d{k}/pick.ts", "b", "d{k}/b.ts", "runB"),
    ("d{k}/map.ts", "one", "d{k}/a.ts", None), ("d{k}/map.ts", "two", "d{k}/b.ts", None),
]
planted("dispatch_registries", {"files": (FILES, DISPATCH)}, languages.dispatch_targets, "registry key target symbol", TARGETS)
planted(
    "dispatch_seeds",
    {"targets": ("registry string, key string, target string, symbol string", TARGETS), "covered": ("path string", [("d{k}/b.ts",)]), "owners": (FILES.replace("text", "feature"), [("d{k}/edr.py", "edr{k}"), ("d{k}/a.ts", "acts{k}"), ("d{k}/b.ts", "acts{k}")])},
    languages.dispatch_seeds,
    "feature flow path",
    [("edr{k}", "run-edr-client-flow", "d{k}/edr.py"), ("acts{k}", "run-run-a-flow", "d{k}/a.ts"), ("acts{k}", "run-a-flow", "d{k}/a.ts")],
)
planted(
    "dispatch_homes",
    {
        "journeys": ("uf string, home string, path string, dispatched boolean", [("u{k}", "h", "d{k}/x/edr.py", True), ("u{k}", "h", "d{k}/y.py", False), ("u{k}", "h", "d{k}/x/z.py", True), ("v{k}", "h", "d{k}/apps/web/q.py", True), ("w{k}", "h", "d{k}/x/edr.py", True), ("w{k}", "h", "d{k}/y.py", False)]),
        "owners": ("path string, product string", [("d{k}/x/edr.py", "EDR{k}")]),
        "anchors": ("dir string, product string", [("d{k}/apps", "Apps"), ("d{k}/apps/web", "Web{k}")]),
    },
    calls.home_dispatched,
    "uf home by",
    [("u{k}", "EDR{k}", "path"), ("v{k}", "Web{k}", "anchor"), ("w{k}", "h", "stays")],
)

# -- links -------------------------------------------------------------------------

ROUTES = ("pattern string, method string, handler string", [("/k{k}/users/[id]", "GET", "n{k}/users.ts"), ("/k{k}/orders", "POST", "n{k}/orders.ts"), ("/k{k}/orders/{oid}/lines", "GET", "n{k}/lines.py"), ("/k{k}", "GET", "n{k}/root.ts")])
CLIENTS = [
    ("n{k}/a.ts", "fetch('/k{k}/users/' + id); axios.post(`/k{k}/orders/`, x); fetch(\"https://host.example/k{k}/orders?x=1\")"),
    ("n{k}/b.tsx", "useSWR(`${BASE}/k{k}/orders/${o}/lines`, get); axios({ method: 'get', url: '/k{k}/none' })"),
    ("n{k}/c.py", "requests.get(f'/k{k}/orders')\nhttpx.get('/k{k}')"),
    ("n{k}/d.go", 'http.Get("/k{k}/users/7")'),
]
CROSSED = [
    ("n{k}/a.ts", "/k{k}/users/", "/k{k}/users/[id]", "GET", "n{k}/users.ts", "high"),
    ("n{k}/a.ts", "/k{k}/orders/", "/k{k}/orders", "POST", "n{k}/orders.ts", "high"),
    ("n{k}/a.ts", "/k{k}/orders?x=1", "/k{k}/orders", "POST", "n{k}/orders.ts", "high"),
    ("n{k}/a.ts", "/k{k}/orders/", "/k{k}/orders/{oid}/lines", "GET", "n{k}/lines.py", "high"),
    ("n{k}/a.ts", "/k{k}/orders?x=1", "/k{k}/orders/{oid}/lines", "GET", "n{k}/lines.py", "high"),
    ("n{k}/b.tsx", "${BASE}/k{k}/orders/${o}/lines", "/k{k}/orders/{oid}/lines", "GET", "n{k}/lines.py", "medium"),
    ("n{k}/c.py", "/k{k}/orders", "/k{k}/orders", "POST", "n{k}/orders.ts", "high"),
    ("n{k}/c.py", "/k{k}/orders", "/k{k}/orders/{oid}/lines", "GET", "n{k}/lines.py", "high"),
    ("n{k}/c.py", "/k{k}", "/k{k}", "GET", "n{k}/root.ts", "high"),
    ("n{k}/d.go", "/k{k}/users/7", "/k{k}/users/[id]", "GET", "n{k}/users.ts", "high"),
]
planted("cross_stack", {"files": (FILES, CLIENTS), "routes": ROUTES}, lambda files, routes: calls.cross_stack(calls.client_calls(files), routes), "caller url pattern method handler confidence", CROSSED)
planted(
    "reverse_cross_stack",
    {"files": (FILES, CLIENTS), "routes": ROUTES},
    lambda files, routes: calls.reverse_cross_stack(calls.client_calls(files), routes),
    "handler pattern callers n",
    [
        ("n{k}/users.ts", "/k{k}/users/[id]", "n{k}/a.ts,n{k}/d.go", 2),
        ("n{k}/orders.ts", "/k{k}/orders", "n{k}/a.ts,n{k}/c.py", 2),
        ("n{k}/lines.py", "/k{k}/orders/{oid}/lines", "n{k}/a.ts,n{k}/b.tsx,n{k}/c.py", 3),
        ("n{k}/root.ts", "/k{k}", "n{k}/c.py", 1),
    ],
)
LINKED = [
    ("l{k}/actions.ts", "'use server';\nexport async function save() {}\nexport const drop = async () => {};\nfunction inner() {}"),
    ("l{k}/form.tsx", "import { save, drop } from './actions';\nexport function Form() {\n  return <form action={save} />;\n}"),
    ("l{k}/button.tsx", "import { drop as remove } from './actions';\nexport function Button() {\n  remove();\n}"),
    ("l{k}/router.ts", "export const order{k}Router = createTRPCRouter({\n  list: publicProcedure.query(() => ({ nested: publicProcedure })),\n  add: protectedProcedure.mutation(x),\n});"),
    ("l{k}/page.tsx", "const q = api.order{k}.list.useQuery();\nconst m = trpc.order{k}.gone.useMutation();\nfetch('/k{k}/orders')"),
    ("l{k}/store.ts", "import { create } from 'zustand';\nexport const useCart = create((set) => ({\n  items: [],\n  add: (x) => set({ items: [x] }),\n  clear() { set({}) },\n}));"),
    ("l{k}/cart.tsx", "import { useCart } from './store';\nexport const Cart = () => { const add = useCart((s) => s.add); };"),
]


def _links(files, routes):
    imported = scripts.symbol_edges(files)
    return calls.framework_links(files, imported, calls.calls(files), routes)


planted(
    "framework_links",
    {"files": (FILES, LINKED), "routes": ROUTES},
    _links,
    "linker caller target",
    [
        ("server_action", "l{k}/form.tsx", "l{k}/actions.ts"),
        ("server_action", "l{k}/button.tsx", "l{k}/actions.ts"),
        ("procedure", "l{k}/page.tsx", "l{k}/router.ts"),
        ("store", "l{k}/cart.tsx", "l{k}/store.ts"),
        ("http_route", "l{k}/page.tsx", "n{k}/orders.ts"),
        ("http_route", "l{k}/page.tsx", "n{k}/lines.py"),
    ],
)
planted("server_actions", {"files": (FILES, LINKED)}, calls.server_actions, "path name", [("l{k}/actions.ts", "save"), ("l{k}/actions.ts", "drop")])
planted("procedures", {"files": (FILES, LINKED)}, calls.procedures, "path router name", [("l{k}/router.ts", "order{k}", "list"), ("l{k}/router.ts", "order{k}", "add")])
planted("store_mutators", {"files": (FILES, LINKED)}, calls.stores, "path library store mutator", [("l{k}/store.ts", "zustand", "useCart", "add"), ("l{k}/store.ts", "zustand", "useCart", "clear")])

# -- inside ------------------------------------------------------------------------

BRANCHED = [
    ("b{k}/page.tsx", "export function Page({ role }) {\n  if (loading) return <Spin />;\n  if (role === 'admin') {\n    return <Admin />;\n  } else {\n    log('if (x)');\n  }\n  switch (role) {\n    case 'a':\n      return 1;\n    default: return 2;\n  }\n}"),
    ("b{k}/m.py", "def pick(x):\n    if x > 1:\n        return 1\n    elif x:\n        return 2\n    else:\n        return 3\n"),
]
planted(
    "branch_slices",
    {"files": (FILES, BRANCHED)},
    lambda files: calls.branches(files, scripts.definitions(scripts.scan_scripts(files)).select("path", "name", "start", "end").unionByName(code.python_symbols(files).where("kind = 'function'").select("path", "name", "start", "end"))).withColumnRenamed("end", "last"),
    "path symbol kind condition start last",
    [
        ("b{k}/page.tsx", "Page", "if", "loading", 2, 2),
        ("b{k}/page.tsx", "Page", "if", "role === 'admin'", 3, 5),
        ("b{k}/page.tsx", "Page", "else", "role === 'admin'", 5, 7),
        ("b{k}/page.tsx", "Page", "case", "'a'", 9, 10),
        ("b{k}/m.py", "pick", "if", "x > 1", 2, 3),
        ("b{k}/m.py", "pick", "if", "x", 4, 5),
        ("b{k}/m.py", "pick", "else", "x", 7, 7),
    ],
)
PAGED = [
    ("i{k}/app/page.tsx", "import { Chart } from './chart';\nimport { Button } from './components/ui/button';\nexport default () => <main title=\"Home {k}\"><h1>Sales of {k}</h1><Chart label='Total' /><Button /><Other.Thing /></main>"),
    ("i{k}/app/chart.tsx", "export const Chart = () => <svg />"),
    ("i{k}/app/components/ui/button.tsx", "export const Button = () => <button />"),
]
planted(
    "page_interior",
    {"files": (FILES, PAGED)},
    lambda files: calls.page_interior(files, scripts.symbol_edges(files)),
    "page kind name target product",
    [
        ("i{k}/app/page.tsx", "component", "Chart", "i{k}/app/chart.tsx", True),
        ("i{k}/app/page.tsx", "component", "Button", "i{k}/app/components/ui/button.tsx", False),
        ("i{k}/app/page.tsx", "component", "Other", None, False),
        ("i{k}/app/page.tsx", "label", "Sales of {k}", None, False),
        ("i{k}/app/page.tsx", "label", "Home {k}", None, False),
        ("i{k}/app/page.tsx", "label", "Total", None, False),
    ],
)
planted(
    "confidence_labels",
    {"rows": ("id string, resolver string, depth int, resolved boolean, same boolean, literal boolean, template boolean", [("a{k}", "alias", 1, True, False, True, False), ("b{k}", "regex", 2, True, True, True, True), ("c{k}", "guess", 4, False, False, False, True)])},
    lambda rows: rows.select("id", calls.import_confidence("resolver").alias("imported"), calls.call_confidence(F.col("resolved"), F.col("same")).alias("called"), calls.cross_confidence(F.col("literal"), F.col("template")).alias("crossed"), calls.closure_confidence("depth").alias("closure")),
    "id imported called crossed closure",
    [("a{k}", "high", "high", "high", 0.5), ("b{k}", "medium", "medium", "medium", 1 / 3), ("c{k}", "low", "low", "low", 0.2)],
)
planted(
    "import_reach_files",
    {"files": (FILES, REPO), "seeds": ("seed string, node string", [("s{k}", "r{k}/apps/web/src/page.tsx")])},
    lambda files, seeds: graph.reach(scripts.script_edges(files), seeds, 2),
    "seed node depth",
    [
        ("s{k}", "r{k}/apps/web/src/page.tsx", 0), ("s{k}", "r{k}/apps/web/src/money.ts", 1), ("s{k}", "r{k}/packages/shared/src/index.ts", 1), ("s{k}", "r{k}/packages/shared/src/money.ts", 1),
        ("s{k}", "r{k}/packages/shared/src/ui/button.tsx", 1), ("s{k}", "r{k}/packages/shared/src/index2.ts", 2),
    ],
)
