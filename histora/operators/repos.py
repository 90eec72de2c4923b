"""What kind of thing a repository is: signals out of its files, and the class and shape that follow, one row a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TO_END

#: Packages that are frameworks themselves. FIXED VALUES.
FRAMEWORKS = ("fastapi", "flask", "django", "starlette", "litestar", "express", "fastify", "koa", "next", "nuxt", "remix", "astro", "gin", "chi", "echo", "fiber", "axum", "actix-web", "rocket", "rails")
SERVER_DEPENDENCIES = ("fastapi", "flask", "django", "starlette", "litestar", "sanic", "aiohttp", "tornado", "djangorestframework")
RUST_SERVERS = ("axum", "actix-web", "warp", "rocket", "hyper", "tonic")
APP_DEPENDENCIES = ("next", "nuxt", "@remix-run/react", "@sveltejs/kit", "astro", "express", "fastify", "@nestjs/core", "koa", "vite", "react-scripts")
DAEMON_DIRS = r"(?:^|/)(?:server|proxy|daemon)/"
SUPPRESSED_FROM = 0.8
LEAST_CONFIDENCE = 0.6
FALLBACK = 0.4


def signals(files: DataFrame, by: str = "repo") -> DataFrame:
    """One row a repository of what its paths and manifests tell. files: repo, path (from the repository's root), text."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))

    def there(pattern: str) -> Column:
        return F.coalesce(F.bool_or(path.rlike(pattern)), F.lit(False))

    def says(name: str, pattern: str) -> Column:
        return F.coalesce(F.bool_or((path == name) & text.rlike(pattern)), F.lit(False))

    def word(items: tuple[str, ...]) -> str:
        return r"[\"'\s](?:" + "|".join(i.replace("/", r"\/").replace(".", r"\.") for i in items) + r")[\"'\s<>=~\[]"

    self_name = F.coalesce(
        F.max(F.when(path == "package.json", F.nullif(F.regexp_extract(text, r'"name"\s*:\s*"([^"]+)"', 1), F.lit("")))),
        F.max(F.when(path.isin("pyproject.toml", "Cargo.toml"), F.nullif(F.regexp_extract(text, r'(?m)^name\s*=\s*"([^"]+)"', 1), F.lit("")))),
        F.max(F.when(path == "go.mod", F.nullif(F.regexp_extract(text, r"(?m)^module\s+\S*?([^/\s]+?)(?:/v\d+)?\s*$", 1), F.lit("")))),
    )
    member = F.regexp_extract(path, r"^(?:apps|packages|services|crates|libs)/([^/]+)/(?:package\.json|pyproject\.toml|Cargo\.toml|go\.mod)$", 1)
    facts = {
        "files": F.count("*"),
        "self_name": F.lower(self_name),
        "package_json": there(r"^package\.json$"),
        "js_main": says("package.json", r'"(?:main|exports|module)"\s*:'),
        "js_bin": F.coalesce(F.bool_or((path == "package.json") & text.rlike(r'"bin"\s*:')), F.lit(False)) | there(r"^bin/"),
        "js_app_dep": says("package.json", word(APP_DEPENDENCIES)),
        "pyproject": there(r"^pyproject\.toml$"),
        "py_project": says("pyproject.toml", r"(?m)^\[project\]|^\[tool\.poetry\]"),
        "py_scripts": says("pyproject.toml", r"(?m)^\[(?:project|tool\.poetry)\.scripts\]"),
        "py_server_dep": F.coalesce(F.bool_or(path.isin("pyproject.toml", "requirements.txt") & F.concat(F.lit("\n"), text, F.lit("\n")).rlike(word(SERVER_DEPENDENCIES))), F.lit(False)),
        "fastapi_factory": F.coalesce(F.bool_or(path.rlike(r"\.py$") & text.rlike(r"=\s*FastAPI\(")), F.lit(False)),
        "cli_py": there(r"^(?:[^/]+/)?(?:cli|__main__)\.py$"),
        "manage_py": there(r"^(?:[^/]+/)?manage\.py$"),
        "gemfile": there(r"^Gemfile$"),
        "rails_app": there(r"^app/controllers/") & there(r"^app/models/"),
        "laravel": there(r"^composer\.json$") & there(r"^app/Http/Controllers/"),
        "go_mod": there(r"^go\.mod$"),
        "go_main": there(r"^cmd/[^/]+/main\.go$") | there(r"^main\.go$"),
        "go_cmd": there(r"^cmd/[^/]+/main\.go$"),
        "go_top": there(r"^[^/]+\.go$"),
        "go_server_dir": there(r"^(?:server|api|internal/server)/"),
        "daemon_dir": there(DAEMON_DIRS),
        "cargo": there(r"^Cargo\.toml$"),
        "cargo_workspace": says("Cargo.toml", r"(?m)^\[workspace\]"),
        "cargo_package": says("Cargo.toml", r"(?m)^\[package\]"),
        "rust_main": there(r"^src/main\.rs$") | there(r"^src/bin/"),
        "rust_server_dep": F.coalesce(F.bool_or(path.rlike(r"(?:^|/)Cargo\.toml$") & text.rlike(r"(?m)^(?:" + "|".join(RUST_SERVERS) + r")\s*=")), F.lit(False)),
        "page_routes": there(r"^(?:src/)?app/(?:.*/)?page\.[jt]sx?$") | there(r"^(?:src/)?pages/.*\.[jt]sx?$") | there(r"^app/routes/"),
        "turbo": there(r"^turbo\.json$"),
        "pnpm": there(r"^pnpm-workspace\.yaml$"),
        "lerna_nx": there(r"^(?:lerna|nx)\.json$") | says("package.json", r'"workspaces"\s*:'),
        "workspaces": F.countDistinct(F.when(member != "", F.regexp_extract(path, r"^([^/]+/[^/]+)/", 1))),
        "crates": F.countDistinct(F.when(path.rlike(r"^[^/]+/(?:[^/]+/)?Cargo\.toml$"), path)),
        "apps_dir": there(r"^apps/[^/]+/"),
        "packages_dir": there(r"^packages/[^/]+/"),
        "app_workspace": there(r"^(?:apps|services)/[^/]+/(?:package\.json|pyproject\.toml|go\.mod)$"),
        "split": there(r"^frontend/package\.json$") & there(r"^backend/(?:package\.json|pyproject\.toml|requirements\.txt|go\.mod)$"),
    }
    return files.groupBy(by).agg(*(c.alias(n) for n, c in facts.items()))


def _ladder(rungs: list[tuple[Column, str, Column | float]], otherwise: str, confidence: float) -> tuple[Column, Column]:
    kind, sure = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(0.0))
    for test, name, value in rungs:
        kind = kind.when(test, name)
        sure = sure.when(test, value if isinstance(value, Column) else F.lit(value))
    return kind.otherwise(otherwise), sure.otherwise(F.lit(confidence))


def repo_class(facts: DataFrame) -> DataFrame:
    """facts with class (framework, product-app, infra-daemon, cli-tool or library), confidence and whether journeys are suppressed.

    A sign of a product outranks the looks of a daemon, tool or library; a repository without any sign is a product,
    at low confidence, as losing journeys is worse than having too many. Only sure verdicts suppress.
    """
    c = F.col
    monorepo = (c("workspaces") >= 2) & c("app_workspace")
    product = c("page_routes") | c("rails_app") | c("manage_py") | c("laravel") | c("fastapi_factory") | c("py_server_dep") | monorepo | c("split")
    daemon = (c("go_mod") & c("go_main") & c("daemon_dir")) | (c("cargo") & c("rust_main") & c("rust_server_dep"))
    no_entry = c("package_json") & ~c("js_app_dep")
    cli = (c("go_mod") & c("go_main")) | (c("cargo") & c("rust_main") & ~c("rust_server_dep")) | (no_entry & c("js_bin") & ~c("js_main")) | (c("cli_py") & c("pyproject") & ~c("py_project"))
    library = (no_entry & c("js_main")) | (c("pyproject") & c("py_project")) | (c("go_mod") & c("go_top")) | (c("cargo") & c("cargo_package") & ~c("cargo_workspace"))
    kind, sure = _ladder([(c("self_name").isin(*FRAMEWORKS), "framework", 0.9), (product, "product-app", 0.95), (daemon, "infra-daemon", 0.9), (cli, "cli-tool", 0.8), (library, "library", 0.85)], "product-app", FALLBACK)
    out = facts.withColumn("class", kind).withColumn("confidence", sure)
    return out.withColumn("suppressed", (c("class") != "product-app") & (c("confidence") >= SUPPRESSED_FROM))


def repo_shape(facts: DataFrame) -> DataFrame:
    """facts with shape and its confidence: how the repository is laid out, which chooses the rollup of flows."""
    c = F.col
    mono = c("workspaces") >= 2
    turbo = mono & (c("turbo") | c("pnpm"))
    library = (c("package_json") & c("js_main") & ~c("js_app_dep")) | (c("pyproject") & c("py_project") & ~c("fastapi_factory") & ~c("manage_py")) | (c("cargo") & c("cargo_package") & ~c("cargo_workspace") & ~c("rust_main"))
    monolith = (c("gemfile") & c("rails_app")) | c("manage_py") | c("laravel")
    tool = (c("cli_py") & c("pyproject") & ~c("py_project")) | (c("rust_main") & c("cargo_package") & ~c("cargo_workspace")) | (c("package_json") & c("js_bin") & ~c("js_app_dep") & ~c("js_main"))
    rungs = [
        (turbo & c("apps_dir") & c("packages_dir"), "turborepo-monorepo", 0.95),
        (turbo & (c("apps_dir") | c("packages_dir")), "turborepo-monorepo", 0.85),
        (turbo, "turborepo-monorepo", 0.7),
        (mono & (c("apps_dir") | c("packages_dir")), "turborepo-monorepo", 0.8),
        (c("split"), "turborepo-monorepo", 0.8),
        (c("go_mod") & c("go_cmd"), "go-server", 0.9),
        (c("go_mod") & c("go_top"), "go-library", 0.9),
        (c("cargo_workspace") & (c("crates") >= 2), "rust-workspace", F.when(c("crates") >= 3, 0.95).otherwise(0.85)),
        (library, "oss-library", F.when(c("js_bin") & c("package_json"), 0.75).otherwise(0.9)),
        (monolith, "backend-monolith", 0.9),
        (tool, "cli-tool", 0.85),
        (c("self_name").isin(*FRAMEWORKS), "framework-repo", 0.85),
        (c("page_routes") | c("fastapi_factory"), "single-saas-routed", 0.85),
    ]
    shape, sure = _ladder(rungs, "universal-residual", FALLBACK)
    return facts.withColumn("shape", shape).withColumn("confidence", sure)


#: The rollup that each shape's flows take.
ROLLUP_OF = {
    "turborepo-monorepo": "turborepo", "go-server": "go_server", "go-library": "library", "rust-workspace": "universal", "oss-library": "library", "backend-monolith": "backend", "cli-tool": "cli",
    "framework-repo": "framework", "single-saas-routed": "single_saas", "universal-residual": "universal",
}


def partition(files: DataFrame, by: str = "repo") -> DataFrame:
    """Workspaces of each repository with their class, confidence, files, and whether they are to be scanned on their own: repo, workspace, ... What is outside of any is ``root``."""
    member = F.regexp_extract("path", r"^((?:apps|packages|services|crates|libs)/[^/]+)/", 1)
    placed = files.select(by, "text", F.when(member != "", member).otherwise("root").alias("workspace"), F.when(member != "", F.substring(F.col("path"), F.length(member) + 2, F.lit(TO_END))).otherwise(F.col("path")).alias("path"))
    facts = signals(placed.withColumn("_unit", F.concat_ws("\u0000", by, "workspace")), "_unit")
    names = F.split("_unit", "\u0000")
    judged = repo_class(facts).select(names[0].alias(by), names[1].alias("workspace"), "files", "class", "confidence")
    return judged.withColumn("scan", (F.col("workspace") != "root") & (F.col("class") == "product-app") & (F.col("confidence") >= LEAST_CONFIDENCE))


# -- what sets routes off ----------------------------------------------------------

TRIGGER_PLACES = (
    ("scheduled", r"(?:^|/)api/cron(?:/|$)|(?:^|/)cron(?:/|$)|(?:^|/)scheduled[_-]?actions?(?:/|$)"),
    ("queue", r"(?:^|/)jobs?(?:/|$)|(?:^|/)tasks?(?:/|$)|(?:^|/)workers?(?:/|$)|(?:^|/)inngest[_-]?functions?(?:/|$)"),
    ("webhook", r"(?:^|/)webhooks?(?:/|$)|(?:^|/)events(?:/|$)"),
)
#: Marks in a route's text. FIXED VALUES.
TRIGGER_MARKS = (
    ("queue", ("qstash", "Receiver(", "bullmq", "new Queue(", "new Worker(", "createFunction", "@shared_task", "@app.task", "sidekiq", "temporalio", "@temporalio/", "@workflow.defn", "@activity.defn", "@trigger.dev/")),
    ("webhook", ("constructEvent", "svix", "verifySignature", "x-goog", "x-slack-signature", "x-hub-signature")),
    ("scheduled", ("CRON_SECRET", "hasCronSecret", "verifyCron", "beat_schedule", "celery.schedules", "apscheduler", "BackgroundScheduler(", "schedules.task(")),
)


def cron_paths(files: DataFrame) -> DataFrame:
    """Urls that a deployment's manifest calls by the clock. files: path, text."""
    schema = "crons array<struct<path:string>>"
    parsed = files.where(F.element_at(F.split("path", "/"), -1) == "vercel.json").select(F.explode(F.from_json("text", schema)["crons"]).alias("c"))
    return parsed.select(F.regexp_replace("c.path", r"\?.*$", "").alias("pattern")).where("pattern is not null").distinct()


def triggers(routes: DataFrame, crons: DataFrame) -> DataFrame:
    """routes (pattern, path, text) with what sets each off: a manifest's clock, else its place, else marks anywhere in the text, else a person.

    Texts are read before the join: routes of one pattern, however many, come together there.
    """
    out = F.when(F.lit(False), "")
    for name, pattern in TRIGGER_PLACES:
        out = out.when(F.lower("path").rlike(pattern) | F.lower("pattern").rlike(pattern), name)
    for name, marks in TRIGGER_MARKS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains("text", F.lit(m))
        out = out.when(hit, name)
    # by an explode of one row the verdict is made before the join
    told = routes.withColumn("trigger", F.explode(F.array(out.otherwise("interactive"))))
    return told.join(crons.withColumn("_cron", F.lit(True)), "pattern", "left").withColumn("trigger", F.when(F.col("_cron"), "scheduled").otherwise(F.col("trigger"))).drop("_cron")


# -- splitting the oversized -------------------------------------------------------

LAYERS = ("app", "apps", "modules", "services", "src", "lib", "libs", "pkg", "internal", "packages", "api", "server", "client", "web", "pages", "routes", "features", "domains", "core", "components", "views", "controllers", "models")


def subdecompose(paths: DataFrame, least_files: int = 3, least_domains: int = 2, rounds: int = 8) -> DataFrame:
    """Splits oversized features by the first directory that names a domain: feature, path, part.

    A feature is oversized over twice the median size and 15 percent of all its repository's files. Directories that name layers, versions, groups or
    parameters are passed through. A feature splits if two domains or more have three files each; what is
    in no such domain stays with it. Parts that are oversized still are split again, at most ``rounds`` times.
    """
    out = paths.select("feature", "path", F.col("feature").alias("part"), F.lit(0).alias("_from")).distinct().checkpoint()
    sizes = out.groupBy("feature").agg(F.count("*").alias("n"))
    mark = sizes.agg(F.greatest(2 * F.expr("percentile(n, 0.5)"), F.ceil(0.15 * F.sum("n"))).alias("_mark"))  # one row
    dirs = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    for _ in range(rounds):
        each = out.groupBy("part").agg(F.count("*").alias("_n"))
        big = each.crossJoin(F.broadcast(mark)).where("_n > _mark").select("part")
        if big.isEmpty():
            return out.select("feature", "path", "part")
        # the first directory, from where the last split ended, that names a domain
        named = F.filter(F.transform(dirs, lambda d, i: F.struct(i.alias("i"), d.alias("d"))), lambda x: (x["i"] >= F.col("_from")) & ~F.lower(x["d"]).isin(*LAYERS) & ~x["d"].rlike(r"^(?:v\d+|\[.*\]|\(.*\)|\.|_|\$)"))
        first = F.try_element_at(named, F.lit(1))
        seen = out.join(big, "part", "left_semi").select("feature", "path", "part", "_from", first["d"].alias("_d"), first["i"].alias("_i"))
        domains = seen.where("_d is not null").groupBy("part", "_d").agg(F.count("*").alias("_k")).where(F.col("_k") >= least_files)
        # one domain alone is a directory to pass through, not a split
        several = domains.groupBy("part").agg(F.count("*").alias("_m"))
        placed = seen.join(domains, ["part", "_d"], "left").join(several, "part", "left")
        split = F.col("_k").isNotNull() & (F.col("_m") >= least_domains)
        passed = F.col("_k").isNotNull() & (F.col("_m") == 1)
        moved = placed.select("feature", "path", F.when(split, F.concat_ws("/", "part", "_d")).otherwise(F.col("part")).alias("part"), F.when(split | passed, F.col("_i") + 1).otherwise(F.col("_from")).alias("_from"), (split | passed).alias("_moved")).checkpoint()
        if moved.where("_moved").isEmpty():
            return out.select("feature", "path", "part")
        out = out.join(big, "part", "left_anti").unionByName(moved.drop("_moved")).checkpoint()
    return out.select("feature", "path", "part")


def entry_flows(routes: DataFrame, owners: DataFrame) -> DataFrame:
    """Flows that need no model: one for each route of a feature's file, named by verb and resource: feature, flow, path, pattern, trigger.

    routes: pattern, method, path, trigger; owners: path, feature. The verb follows from the method and whether the route ends in a parameter.
    """
    words = F.filter(F.split("pattern", "/"), lambda s: (s != "") & ~s.rlike(r"^(?:api|v\d+)$"))
    fixed = F.filter(words, lambda s: ~s.rlike(r"^[:{\[<*$]"))
    one = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).rlike(r"^[:{\[<*$]")
    verb = (
        F.when(F.col("trigger") != "interactive", "run").when(F.col("method") == "PAGE", F.when(one, "view").otherwise("browse"))
        .when(F.col("method") == "GET", F.when(one, "get").otherwise("list")).when(F.col("method") == "POST", "create").when(F.col("method").isin("PUT", "PATCH"), "update").when(F.col("method") == "DELETE", "delete").otherwise("handle")
    )
    noun = F.regexp_replace(F.lower(F.coalesce(F.nullif(F.array_join(F.slice(F.reverse(fixed), 1, 1), "-"), F.lit("")), F.lit("home"))), "[^a-z0-9]+", "-")
    named = routes.join(owners, "path").select("feature", F.concat(verb, F.lit("-"), noun, F.lit("-flow")).alias("flow"), "path", "pattern", "trigger")
    return named.distinct()
