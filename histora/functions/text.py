"""Scalar functions on messages, names, tokens and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: what marks a bug fix, and what only looks like one.
BUG_FIX = (
    r"\bfix\b", r"\bbug\b", r"\bhotfix\b", r"\bpatch\b", r"\brevert\b", r"\bregression\b", r"\bcrash\b", r"\berror\b",
    r"\bbroken\b", r"\bissue\b", r"\bdefect\b", r"\bresolve\b", r"\btimeout\b", r"\bnull\s*(?:pointer|check|ref)\b",
    r"\bundefined\b", r"\bNaN\b", r"\brace\s*condition\b", r"\bdeadlock\b", r"\bmemory\s*leak\b", r"\boverflow\b",
)
NOT_BUG_FIX = (
    r"\bfix\s+(?:typo|lint|format\w*|style|import|indent|spacing|whitespace)\b",
    r"\bfix\s+(?:test|spec|mock|snapshot)\b",
    r"\bfix\s+(?:docs?|readme|comment|changelog)\b",
    r"\bfix\s+(?:merge|conflict|rebase)\b",
    r"\bfix\s+(?:ci|pipeline|build|deploy)\b",
)
# FIXED VALUES: how tokens are folded, and which don't count.
SUFFIXES = ("ing", "es", "s")  # folded once, longest first, never below three letters
STOP_TOKENS = ("and", "or", "of", "the", "a", "an", "management", "service", "module", "system", "feature", "user")
LEAST_PREFIX = 3
TO_END = 2**31 - 1  # length of a substring that takes all that follows


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_bug_fix(message: str | Column) -> Column:
    message = _col(message)
    return F.coalesce(message.rlike("(?i)" + "|".join(BUG_FIX)) & ~message.rlike("(?i)" + "|".join(NOT_BUG_FIX)), F.lit(False))


def pr_number(message: str | Column) -> Column:
    """Number in a merge commit, else in a squash commit's trailing mark, else null."""
    message = _col(message)
    merge = F.regexp_extract(message, r"(?i)Merge pull request #(\d+)", 1)
    squash = F.regexp_extract(message, r"\(#(\d+)\)\s*(?:\n|$)", 1)
    return F.coalesce(F.nullif(merge, F.lit("")), F.nullif(squash, F.lit(""))).cast("int")


def remote_url(url: str | Column) -> Column:
    """ssh form to https, without trailing slashes and .git."""
    url = F.regexp_replace(_col(url), r"^git@([^:]+):", "https://$1/")
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")


def slugify(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(text: str | Column) -> Column:
    """Lower-case alphanumeric tokens, camel case split, suffixes folded."""
    split = F.split(F.lower(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")), "[^a-z0-9]+")

    def fold(t: Column) -> Column:
        out = F.when(F.lit(False), t)
        for s in SUFFIXES:
            out = out.when(F.endswith(t, F.lit(s)) & (F.length(t) - len(s) >= 3), F.substring(t, F.lit(1), F.length(t) - len(s)))
        return out.otherwise(t)

    return F.transform(F.filter(split, lambda t: t != ""), fold)


def token_coverage(query: Column, hay: Column) -> Column:
    """Mean credit of the query's tokens: 1 if held, 0.5 if one is a prefix of the other, else 0."""

    def credit(q: Column) -> Column:
        partly = F.exists(hay, lambda h: ((F.length(q) >= LEAST_PREFIX) & F.startswith(h, q)) | ((F.length(h) >= LEAST_PREFIX) & F.startswith(q, h)))
        return F.when(F.array_contains(hay, q), 1.0).when(partly, 0.5).otherwise(0.0)

    total = F.aggregate(F.transform(query, credit), F.lit(0.0), lambda a, b: a + b)
    return F.when((F.size(query) == 0) | (F.size(hay) == 0), 0.0).otherwise(total / F.size(query))


def name_tokens(name: str | Column) -> Column:
    """Distinct tokens of a feature name without stop tokens, sorted."""
    raw = F.split(F.lower(F.trim(_col(name))), r"[/\-_]+")
    return F.array_sort(F.array_distinct(F.filter(raw, lambda t: (t != "") & ~t.isin(*STOP_TOKENS))))


def names_match(expected: str | Column, found: str | Column) -> Column:
    """Equal, one below the other, equal token sets, or at least two expected tokens all found."""
    e, d = (F.lower(F.trim(_col(x))) for x in (expected, found))
    et, dt = name_tokens(e), name_tokens(d)
    subset = F.size(F.array_except(et, dt)) == 0
    some = (F.size(et) > 0) & (F.size(dt) > 0)
    return (e == d) | F.startswith(d, F.concat(e, F.lit("/"))) | F.startswith(e, F.concat(d, F.lit("/"))) | (some & ((et == dt) | ((F.size(et) >= 2) & subset)))


def singular(word: str | Column) -> Column:
    """Small English rule set: -ies to -y, -sses and the like lose -es, other -s but -ss goes."""
    w = _col(word)
    return (
        F.when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(?:ss|x|z|ch|sh)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def title_case(name: str | Column) -> Column:
    return F.initcap(F.regexp_replace(_col(name), "[-_]+", " "))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Similarity of two arrays as sets; the value for two empty sets differs by use and must be said."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def strictly_contained(a: Column, b: Column, least: int = 2) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return (F.size(a) >= least) & (F.size(a) < F.size(b)) & (F.size(F.array_except(a, b)) == 0)


# -- paths and urls ----------------------------------------------------------------


def directory(path: str | Column) -> Column:
    return F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)


def ancestors(path: str | Column) -> Column:
    """All directories above a path, longest first, without the root."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


# FIXED VALUES: what marks tests, made files and files that are no feature's.
TEST_DIRS = ("__tests__", "__mocks__", "tests", "test", "e2e", "cypress", "playwright", "__fixtures__")
TEST_WORDS = ("test", "tests", "spec", "specs", "e2e", "cy")
LEGACY_TEST = r"(?i)\.(?:test|spec)\.(?:ts|tsx|js|jsx|py)$|/__tests__/|/tests?/|/test_[^/]+\.py$|/[^/]+_test\.py$"
VENDOR_DIRS = ("node_modules", "vendor", "venv", ".venv", "dist", "build", "out", ".next", ".turbo", "target", "__pycache__", ".pytest_cache", ".generated", "generated")
GENERATED_NAMES = (
    r"\.pb\.(?:go|cc|h|dart|rb|swift|ts|js)$", r"\.pb\.gw\.go$", r"_grpc\.pb\.(?:go|ts)$", r"_pb2(?:_grpc)?\.pyi?$", r"[._]generated\.(?:go|cc|cpp|cxx|h|hpp|cs|swift|kt|dart|rb)$",
    r"[._]gen\.(?:go|cc|cpp|cxx|h|hpp|cs|swift|kt|dart|rb)$", r"^zz_generated[._].*\.go$", r"_string\.go$", r"\.g\.dart$|\.freezed\.dart$", r"\.designer\.cs$",
)
INFRA_DIRS = (
    "tests", "test", "__tests__", "migrations", "fixtures", "scripts", "ci", ".github", "docs", "static", "assets", "templates", "locale", "management",
    "prisma", "drizzle", "graphql-schema", "docker", "deploy", "infra", "terraform",
)
INFRA_ENDINGS = ("toml", "lock", "cfg", "ini", "yml", "yaml", "json", "md", "txt", "rst")
INFRA_NAMES = (
    "dockerfile", "docker-compose.yml", "makefile", "caddyfile", ".gitignore", ".env", ".env.example", "readme.md", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt",
    "package.json", "package-lock.json", "tsconfig.json", "vite.config.ts", "next.config.js", "tailwind.config.js",
)


def _parts(path: Column) -> tuple[Column, Column]:
    """Directories and name of a path, in lower case."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)


def is_test_path(path: str | Column) -> Column:
    """A test directory above the file, or a name whose last part before the ending begins or ends with a test word."""
    dirs, name = _parts(_col(path))
    dotted = F.split(name, r"\.")
    words = F.filter(F.split(F.try_element_at(dotted, F.lit(-2)), "[-_]"), lambda w: w != "")
    marked = (F.size(dotted) >= 2) & (F.try_element_at(words, F.lit(1)).isin(*TEST_WORDS) | F.try_element_at(words, F.lit(-1)).isin(*TEST_WORDS))
    return F.exists(dirs, lambda s: s.isin(*TEST_DIRS)) | F.coalesce(marked, F.lit(False))


def is_test_path_legacy(path: str | Column) -> Column:
    """The older rule, by pattern alone."""
    return F.concat(F.lit("/"), F.replace(_col(path), F.lit("\\"), F.lit("/"))).rlike(LEGACY_TEST)


def is_vendor_or_test(path: str | Column) -> Column:
    """Files whose imports count for nobody."""
    at = F.concat(F.lit("/"), _col(path))
    return at.rlike("/(?:" + "|".join(d.replace(".", r"\.") for d in (*VENDOR_DIRS, "tests", "test", "__tests__", "spec")) + r")/|\.test\.|\.spec\.|_test\.go")


#: FIXED VALUES: the banners of generators, and how far into a text they are looked for.
BANNER_CHARS = 2048
BANNER_LINE = r"(?i)\bcode generated by\b[^\n]*\bdo not edit\b"
BANNER_TAG = r"@generated\b"
BANNER_WORD = r"(?i)\b(?:auto[- ]?|automatically )?generated\b"
BANNER_PLEA = r"(?i)\b(?:do not|don'?t|should not be|never)\s+(?:be\s+)?(?:edit|modif|chang)"


def is_generated(path: str | Column, text: Column | None = None) -> Column:
    """A name that only generators give, or their banner at the head of the text.

    A banner says by whom the code was generated and, in the same line, not to edit it; or has the generators' tag; or
    has a word for generated and, anywhere in the head, a plea not to change it. A head with a null byte has none.
    """
    _, name = _parts(_col(path))
    named = name.rlike("|".join(GENERATED_NAMES))
    if text is None:
        return named
    head = F.substring(text, 1, BANNER_CHARS)
    banner = head.rlike(BANNER_LINE) | head.rlike(BANNER_TAG) | (head.rlike(BANNER_WORD) & head.rlike(BANNER_PLEA))
    return named | F.coalesce(banner & ~F.contains(head, F.lit("\x00")), F.lit(False))


def is_infra(path: str | Column) -> Column:
    """Settings and files of directories that are no feature's, hidden ones too; settings' endings count near the root."""
    dirs, name = _parts(_col(path))
    placed = F.exists(dirs, lambda d: d.isin(*INFRA_DIRS) | F.startswith(d, F.lit(".")))
    return placed | name.isin(*INFRA_NAMES) | ((F.size(dirs) <= 1) & extension(_col(path)).isin(*INFRA_ENDINGS))


def is_non_source(path: str | Column) -> Column:
    return F.lower(_col(path)).rlike(r"\.(?:md|mdx|rst|txt|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|mp4|pdf|json|ya?ml|toml|lock|css|scss)$|(?:^|/)(?:docs?|assets|public|static)/")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))


def url_template(url: str | Column) -> Column:
    """Path of a url with numbers and ids as {param}, without query, fragment and final slash."""
    path = F.regexp_replace(F.regexp_replace(_col(url), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    path = F.regexp_replace(path, r"\$\{[^}]*\}", "{param}")
    path = F.regexp_replace(path, r"(?<=/)(?:\d+|[0-9a-f]{8,}|:[A-Za-z_]\w*|\[[^\]/]+\])(?=/|\.|$)", "{param}")
    path = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", "/").otherwise(path)


def url_matches(url: Column, pattern: Column) -> Column:
    """Segment by segment, a parameter of the pattern matching any one segment."""
    a, b = (F.split(F.regexp_replace(x, "^/+|/+$", ""), "/") for x in (url, pattern))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == y) | y.rlike(r"^(?:[:{\[<]|\$\{)")), lambda hit: hit)


def path_to_route(path: str | Column) -> Column:
    """Route of a file by the app-directory convention: groups dropped, [x] as a parameter; null for other files."""
    path = _col(path)
    inner = F.regexp_extract(path, r"(?:^|/)(?:app|pages|routes)/(.*?)/?(?:page|route|index|\+page|\+server)\.(?:[jt]sx?|svelte)$", 1)
    is_route = path.rlike(r"(?:^|/)(?:app|pages|routes)/(?:.*/)?(?:page|route|index|\+page|\+server)\.(?:[jt]sx?|svelte)$")
    segments = F.filter(F.split(inner, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~F.startswith(s, F.lit("@")))
    named = F.transform(segments, lambda s: F.regexp_replace(s, r"^\[+(?:\.\.\.)?([^\]]+)\]+$", "{$1}"))
    return F.when(is_route, F.concat(F.lit("/"), F.array_join(named, "/")))


def deeplinks(remote: Column, path: Column, ranges: Column) -> Column:
    return F.transform(ranges, lambda r: F.concat(remote, F.lit("/blob/HEAD/"), path, F.lit("#L"), r["start"].cast("string"), F.lit("-L"), r["end"].cast("string")))


def content_hash(c: str | Column) -> Column:
    return F.sha2(_col(c), 256)


def minted_id(space: str, name: Column, seq: Column) -> Column:
    """Stable id of the seq-th row of a name."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(space), name, seq.cast("string")), 256), 1, 32)


def response_tokens(*cols: Column) -> Column:
    """Estimated tokens of a JSON answer: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.to_json(F.struct(*cols))) / 4))


def trigger_of(pattern: Column, path: Column, text: Column | None = None) -> Column:
    """What sets a route off: cron, webhook, queue or system by its place or marks, else a person."""
    both = F.lower(F.concat_ws(" ", pattern, path))
    out = F.when(both.rlike(r"(?:^|/| )cron(?:s)?(?:/|\.|$)|/scheduled/"), "cron").when(both.rlike("webhook"), "webhook").when(both.rlike(r"/(?:jobs|workers?|queues?)/"), "queue")
    if text is not None:
        head = F.lower(F.substring(text, 1, 4096))
        out = out.when(head.rlike(r"cron\.schedule|@scheduled|schedule\("), "cron").when(head.rlike(r"verify_?signature|svix"), "webhook")
    return out.otherwise("interactive")


# FIXED VALUES: roles by name, the first that matches.
SYMBOL_ROLES = (
    ("loading-state", r"(?:^|[a-zA-Z_])(?:is|has)?(?:Loading|Pending|Fetching|Submitting|Saving|Refetching)(?:$|[A-Z_])"),
    ("error-state", r"(?:^|[a-zA-Z_])(?:is|has)?(?:Error|Errors|ErrorMessage|ErrorState|Failure|Failed)(?:$|[A-Z_])"),
    ("validator", r"^(?:validate|isValid|check|assert|ensure)[A-Z_]|^[a-zA-Z][A-Za-z]*Schema$|.+Validator$"),
    ("data-fetch", r"^use[A-Z][A-Za-z]*(?:Mutation|Query|InfiniteQuery|SuspenseQuery|Subscription)$|^(?:fetch|get|list|load|create|update|delete)[A-Z][A-Za-z]*(?:Async|Promise)?$"),
    ("side-effect", r"^use[A-Z][A-Za-z]*Effect$|^on[A-Z][A-Za-z]+$|^(?:before|after)[A-Z][A-Za-z]+Hook$"),
    ("state", r"^(?:set|use)[A-Z][A-Za-z]*(?:State|Store|Atom|Signal|Reducer|Context)?$|.+(?:Atom|Signal|Store|Slice|Reducer|Context)$"),
    ("handler", r"^handle[A-Z][A-Za-z]*$|^[A-Za-z]+(?:Handler|Controller|Action)$"),
)
HTTP_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def symbol_role(name: Column, kind: Column, path: Column, has_routes: Column | None = None) -> Column:
    """What a symbol does in a flow, by its name, kind and file; ``helper`` if nothing tells."""
    out = F.when(F.coalesce(name, F.lit("")) == "", "helper").when(kind.isin("type", "enum", "reexport"), "type")
    out = out.when((has_routes if has_routes is not None else F.lit(False)) & name.isin(*HTTP_VERBS), "entry")
    for role, pattern in SYMBOL_ROLES:
        out = out.when(name.rlike(pattern), role)
    drawn = path.rlike(r"(?i)\.[jt]sx$") & kind.isin("function", "class", "const") & name.rlike("^[A-Z]") & (F.upper(name) != name)
    return out.when(drawn, "ui-component").otherwise("helper")
