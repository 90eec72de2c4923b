import itertools
import random
import re

import pytest

from histora.operators import calls, routes

ROUTES = [
    ("/api/users/[id]", "GET", "u"), ("/api/users/[id]", "PUT", "up"), ("/api/users/me", "GET", "me"), ("/api/users", "POST", "new"), ("/api/users", "GET", "list"), ("/api/users/{id}/posts", "GET", "posts"),
    ("/x/v1/orders/:oid", "GET", "deep"), ("/v1/orders/:oid", "GET", "o"), ("/files/[...path]", "HEAD", "f"), ("/docs/:name.json", "DELETE", "doc"), ("/shop/[[...rest]]", "GET", "shop"), ("/a/:b?", "GET", "opt"),
    ("/p/<int:pk>/", "GET", "pk"), ("/q/{rest:path}", "GET", "q"), ("/a.b/c", "GET", "dot"), (None, "GET", "none"), ("", "GET", "root"),
]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sites(spark, *urls):
    return frame(spark, [("c", *(u if isinstance(u, tuple) else (u, None, False))) for u in urls], "caller string, url string, verb string, open_end boolean")


def reached(spark, *urls, known=ROUTES):
    out = {}
    for r in routes.resolve_calls(sites(spark, *urls), frame(spark, known, "pattern string, method string, handler string")).collect():
        out.setdefault(r["url"], []).append((r["handler"], r["how"]))
    return {u: sorted(x) for u, x in out.items()}


def test_every_kind_of_client_is_read(spark):
    text = "\n".join(
        [f"axios.{v}('/ax/{v}')" for v in ("get", "post", "put", "patch", "delete", "head", "options", "request")] + [f"ky.{v}(`/ky/{v}`)" for v in ("get", "head")]
        + [f"{o}.{v}(\"/{o}/{v}\")" for o in ("requests", "httpx", "session") for v in ("get", "post", "put", "patch", "delete", "head")] + [f"http.{v}(\"/go/{v}\", x)" for v in ("Get", "Post", "Put", "Patch", "Delete", "Head")]
        + ["fetch('/f')", "this.fetch ( '/f2' )", "$fetch<T[]>('/df')", "useFetch('/uf')", "useSWR('/swr', get)", "useAsyncData('k', () => $fetch('/in'))", "client.get('/cl')", 'http.NewRequest("POST", "/nr", b)', "axios({ method: 'put', url: '/field' })", "httpx.get(f'/g/{a.b}/c')", "fetch('/cat/' + id + '/x')"]
        + ["prefetch('/no')", "fetch(url)", "session.close('/no')", "fetched('/no')", "fetch('')"]
    )
    got = {r["url"]: (r["verb"], r["open_end"]) for r in routes.network_calls(frame(spark, [("a", text), ("b", None)], "path string, text string")).collect()}
    want = {f"/ax/{v}": (None if v == "request" else v.upper(), False) for v in ("get", "post", "put", "patch", "delete", "head", "options", "request")}
    want |= {"/ky/get": ("GET", False), "/ky/head": ("HEAD", False)} | {f"/{o}/{v}": (v.upper(), False) for o in ("requests", "httpx", "session") for v in ("get", "post", "put", "patch", "delete", "head")}
    want |= {f"/go/{v}": (v.upper(), False) for v in ("Get", "Post", "Put", "Patch", "Delete", "Head")} | {u: (None, False) for u in ("/f", "/f2", "/df", "/uf", "/swr", "/in", "/field")}
    assert got == want | {"/cl": ("GET", False), "/nr": ("POST", False), "/g/${a.b}/c": ("GET", False), "/cat/": (None, True)}
    assert {r["url"] for r in calls.client_calls(frame(spark, [("a", text)], "path string, text string")).collect()} == set(got)


def test_the_most_exact_route_wins(spark):
    got = reached(spark, "/api/users/me", "/api/users/7?x=1#y", "https://h.example/api/users/7/posts/", "/files/a/b/c", "/files", "/docs/x.json", "/docs/x.xml", "/shop", "/shop/a/b", "/a", "/a/1", "/p/3", "/q/x/y", "/axb/c", "/", "/none", "")
    assert got == {
        "/api/users/me": [("me", "exact")], "/api/users/7?x=1#y": [("u", "exact"), ("up", "exact")], "https://h.example/api/users/7/posts/": [("posts", "exact")], "/files/a/b/c": [("f", "exact")], "/files": [("f", "head")], "/docs/x.json": [("doc", "exact")],
        "/docs/x.xml": [("doc", "head")], "/shop": [("shop", "exact")], "/shop/a/b": [("shop", "exact")], "/a": [("opt", "exact")], "/a/1": [("opt", "exact")], "/p/3": [("pk", "exact")], "/q/x/y": [("q", "exact")], "/": [("root", "exact")], "": [("root", "exact")],
    }


def test_holes_bases_and_verbs(spark):
    got = reached(spark, "/api/users/${id}", "${B}/v1/orders/${o}", "${a}${b}/users/${x}/posts", "${url}", "/docs/${n}.json", ("/api/users/", None, True), ("/api/users", "POST", False), ("/api/users/1", "PATCH", False), "/api/users/1/zzz", "/${a}/${b}", "/files/${p}/x")
    assert got == {
        "/api/users/${id}": [("u", "exact"), ("up", "exact")], "${B}/v1/orders/${o}": [("o", "exact")], "${a}${b}/users/${x}/posts": [("posts", "exact")], "/docs/${n}.json": [("doc", "exact")], "/api/users/": [("u", "exact"), ("up", "exact")],
        "/api/users": [("new", "exact")], "/api/users/1": [("u", "exact"), ("up", "exact")], "/api/users/1/zzz": [("posts", "head"), ("u", "head"), ("up", "head")], "/files/${p}/x": [("f", "exact")], "/${a}/${b}": [("opt", "exact")],
    }


def plainly(url, paths):
    """The least (rank, route) over all routes, by trying each; no bases."""
    u = [s for s in re.sub(r"[?#].*", "", re.sub(r"\$\{[^}]*\}", "*", url)).split("/") if s]

    def fits(text, holed):
        return re.fullmatch(".*".join(map(re.escape, holed.split("*"))), text) is not None

    def step(a, b):
        if "*" in a:
            return "0" if b == "*" else "1" if "*" in b else "2" if fits(b, a) else None
        return "2" if b == "*" else ("1" if fits(a, b) else None) if "*" in b else "0" if a == b else None

    found = []
    for r in paths:
        if len(u) == len(r) or (r and r[-1] == "**" and len(u) >= len(r)):
            rank = [("3" if b == "**" else step(a, b)) for a, b in zip(u, r)]
            if None not in rank:
                found.append(("".join(rank), "/".join(r)))
    return min(found, default=(None, None))[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_walk_equals_trying_every_route(spark, seed):
    r = random.Random(seed)
    words = ["a", "b", "ab", "x-1"]
    paths = {tuple(r.choice([*words, "*", "a*", "*b"]) for _ in range(r.randint(0, 4))) for _ in range(60)}
    paths |= {(*p[:2], "**") for p in itertools.islice(sorted(paths), 8)}
    patterns = ["/" + "/".join("[...z]" if s == "**" else s.replace("*", "{z}") for s in p) for p in paths]
    urls = sorted({"/" + "/".join(r.choice([*words, "${h}", "a${h}", "cab"]) for _ in range(r.randint(0, 5))) for _ in range(150)})
    got = {}
    for x in routes.resolve_calls(sites(spark, *urls), frame(spark, [(p, "GET", "/".join(q)) for p, q in zip(patterns, paths, strict=True)], "pattern string, method string, handler string")).collect():
        if x["how"] == "exact":
            got.setdefault(x["url"], set()).add(x["handler"])
    want = {u: {plainly(u, paths)} for u in urls if plainly(u, paths) is not None}
    assert got == want
