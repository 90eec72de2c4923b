"""Taking a repository in: snapshots, context, settings, truth, earlier results; and giving reports out."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import TO_END, directory, slugify
from .history import commit_files, describe_files, newest, prepare_commits, scoped, workspaces

# -- snapshots and context ---------------------------------------------------------


class Snapshot:
    """One reading of a history for any number of subtrees: the commits are prepared once and cached, each subtree is a view of them."""

    def __init__(self, raw: DataFrame, since: str | None = None, most: int | None = 7000) -> None:
        commits = prepare_commits(raw, since)
        self.commits = (commits if most is None else newest(commits, most)).cache()

    def of(self, subtree: str | None = None) -> DataFrame:
        if not subtree:
            return self.commits
        return self.commits.withColumn("files", scoped(F.col("files"), subtree)).where(F.size("files") > 0)

    def release(self) -> None:
        self.commits.unpersist()


#: Stacks by what a manifest depends on, the first that it has.
STACKS = (
    ("next-app-router", "package.json", r'"next"\s*:'), ("remix", "package.json", r'"@remix-run/'), ("nuxt", "package.json", r'"nuxt"\s*:'), ("sveltekit", "package.json", r'"@sveltejs/kit"'), ("nestjs", "package.json", r'"@nestjs/core"'),
    ("fastify", "package.json", r'"fastify"\s*:'), ("express", "package.json", r'"express"\s*:'), ("vite", "package.json", r'"vite"\s*:'), ("django", "pyproject.toml", r"(?i)\bdjango\b"), ("fastapi", "pyproject.toml", r"(?i)\bfastapi\b"), ("flask", "pyproject.toml", r"(?i)\bflask\b"),
    ("django", "requirements.txt", r"(?i)\bdjango\b"), ("fastapi", "requirements.txt", r"(?i)\bfastapi\b"), ("flask", "requirements.txt", r"(?i)\bflask\b"), ("rails", "Gemfile", r"\brails\b"), ("go", "go.mod", r"(?m)^module\b"), ("rust", "Cargo.toml", r"(?m)^\["), ("node", "package.json", r"\{"),
)


def stacks(files: DataFrame) -> DataFrame:
    """dir and stack of each directory with a manifest. A Next project without an app directory routes by pages. files: path, text."""
    leaf = F.element_at(F.split("path", "/"), -1)
    rank, name = F.when(F.lit(False), 0), F.when(F.lit(False), "")
    for n, (stack, manifest, mark) in enumerate(STACKS):
        hit = (leaf == manifest) & F.col("text").rlike(mark)
        rank, name = rank.when(hit, n), name.when(hit, stack)
    found = files.select(directory("path").alias("dir"), rank.alias("rank"), name.alias("stack")).where("rank is not null").groupBy("dir").agg(F.min_by("stack", "rank").alias("stack"))
    pages = files.where(F.col("path").rlike(r"(?:^|/)(?:src/)?pages/.*\.[jt]sx?$")).select(F.regexp_replace(F.regexp_extract("path", r"^(.*?)(?:src/)?pages/", 1), "/$", "").alias("dir")).distinct()
    apps = files.where(F.col("path").rlike(r"(?:^|/)app/(?:.*/)?(?:page|layout|route)\.[jt]sx?$")).select(F.regexp_replace(F.regexp_extract("path", r"^(.*?)(?:src/)?app/", 1), "/$", "").alias("dir")).distinct()
    only_pages = pages.join(apps, "dir", "left_anti").withColumn("_pages", F.lit(True))
    return found.join(only_pages, "dir", "left").select("dir", F.when((F.col("stack") == "next-app-router") & F.col("_pages"), "next-pages").otherwise(F.col("stack")).alias("stack"))


def nested_manifests(files: DataFrame, depth: int = 4) -> DataFrame:
    """Manifests of workspaces below the root: dir, kind, depth. files: path."""
    leaf = F.element_at(F.split("path", "/"), -1)
    kinds = {"package.json": "npm", "pyproject.toml": "python", "Cargo.toml": "cargo", "go.mod": "go", "Gemfile": "ruby", "composer.json": "php", "pnpm-workspace.yaml": "pnpm", "nx.json": "nx", "turbo.json": "turbo", "lerna.json": "lerna"}
    kind = F.when(F.lit(False), "")
    for name, k in kinds.items():
        kind = kind.when(leaf == name, k)
    n = F.size(F.split("path", "/")) - 1
    return files.select(directory("path").alias("dir"), kind.alias("kind"), n.alias("depth")).where(F.col("kind").isNotNull() & F.col("depth").between(1, depth)).distinct()


def intake(files: DataFrame, raw_commits: DataFrame | None = None, since: str | None = None, subtree: str | None = None) -> dict[str, DataFrame]:
    """The context of a scan as tables: files, workspaces, stacks and, with a history, commits and commit_files."""
    own = files
    if subtree:
        prefix = subtree.strip("/") + "/"
        own = files.where(F.startswith("path", F.lit(prefix))).withColumn("path", F.substring("path", len(prefix) + 1, TO_END))
    described = describe_files(own)
    out = {"files": described, "workspaces": workspaces(described.where(F.element_at(F.split("path", "/"), -1) == "package.json").select("path", "text")), "stacks": stacks(described)}
    if raw_commits is not None:
        commits = prepare_commits(raw_commits, since, subtree)
        out |= {"commits": commits, "commit_files": commit_files(commits)}
    return out


# -- settings and truth ------------------------------------------------------------


TRUTH = "path string, kind string, name string, note string, of string, words array<string>, needed array<string>"
#: Lists of a truth file: the kind of their rows, and the fields for name, note, owner and word lists; a null field is not of that kind.
_TRUTH_LISTS = {"features": ("feature", "name", "description", None, "aliases", "must_include"), "flows": ("flow", "name", None, "feature", None, None), "samples": ("sample", "path", None, "expected", None, None)}


def truth_rows(files: DataFrame) -> DataFrame:
    """Rows of truth files in YAML: features, flows and samples as TRUTH. files: path, text.

    What can't be read is a row of the kind ``error`` with the reason as its note: a text that is no mapping, a list of other
    things, an entry without a name, a sample without an owner, words that are no list; and a feature or sample that a file names twice.
    """

    def entries(path: str, text: str) -> Iterator[tuple]:
        import yaml

        def load(text: str):
            """By the parser in C, where there is one; what it doesn't take is read again, for the reason."""
            try:
                return yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            except yaml.YAMLError:
                return yaml.safe_load(text)

        bad = lambda note, name=None: (path, "error", name, note, None, None, None)
        try:
            data = load(text) if text.strip() else {}
        except yaml.YAMLError as e:
            yield bad(f"no YAML: {type(e).__name__}")
            return
        if not isinstance(data, dict):
            yield bad("a mapping is expected at the top level")
            return
        for key, (kind, *fields) in _TRUTH_LISTS.items():
            listed = data.get(key) or []
            for entry in listed if isinstance(listed, list) else [listed]:
                if not isinstance(entry, dict):
                    yield bad(f"{key} is to be a list of mappings")
                    continue
                name, note, of, words, needed = (entry.get(f) if f else None for f in fields)
                if not str(name or "").strip() or (kind == "sample" and not str(of or "").strip()):
                    yield bad(f"an entry of {key} lacks its {fields[0]} or its owner")
                elif not all(isinstance(x, list) or x is None for x in (words, needed)):
                    yield bad(f"words of an entry of {key} are no list", str(name))
                else:
                    lists = [[w for w in (str(v).strip() for v in x or []) if w] for x in (words, needed)]
                    yield path, kind, str(name).strip(), str(note or "").strip(), str(of or "").strip(), *lists

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch.path, batch.text, strict=True) for r in entries(p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRUTH.split(", ")])

    rows = files.select("path", "text").mapInPandas(run, TRUTH).checkpoint()  # parsed once, read twice
    twice = rows.where("kind in ('feature', 'sample')").groupBy("path", "name").agg(F.count("*").alias("n"), F.first("kind").alias("k")).where("n > 1")
    none = F.lit(None).cast("string")
    again = twice.select("path", F.lit("error").alias("kind"), "name", F.concat(F.lit("named twice: "), "k").alias("note"), none.alias("of"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<string>").alias("needed"))
    return rows.unionByName(again)


def read_truth(spark: SparkSession, features: str = "", flows: str = "", attribution: str = "") -> dict[str, DataFrame]:
    """Expected features, flows and owners of sampled paths out of texts in YAML; the first error of truth_rows is raised."""
    rows = truth_rows(spark.createDataFrame([("features", features), ("flows", flows), ("attribution", attribution)], "path string, text string"))
    wrong = rows.where("kind = 'error'").first()
    if wrong:
        raise ValueError(f"{wrong['path']}: {wrong['note']}")
    of = lambda kind: rows.where(F.col("kind") == kind)
    return {
        "features": of("feature").select("name", F.col("note").alias("description"), F.col("words").alias("aliases"), F.col("needed").alias("must_include")),
        "flows": of("flow").select("name", F.col("of").alias("feature")),
        "attribution": of("sample").select(F.col("name").alias("path"), F.col("of").alias("expected")),
    }


#: Features that no setting renames or drops.
PROTECTED = ("documentation", "shared-infra", "examples")


def read_config(text: str) -> dict[str, Any]:
    """Settings of a repository: features (canonical name to variants), skip_features, force_merges (name to sources) and auto_aliases; all may be missing."""
    import yaml

    data = yaml.safe_load(text) or {}
    kinds = {"features": dict, "auto_aliases": dict, "skip_features": list, "force_merges": list}
    blocks = {key: (data.get(key) or kind()) if isinstance(data, dict) else None for key, kind in kinds.items()}
    wrong = [key for key, kind in kinds.items() if not isinstance(blocks[key], kind)]
    if wrong:
        raise ValueError(f"settings of another form than expected: {', '.join(wrong)}")

    def listed(values: Any) -> list[str]:
        if not isinstance(values or [], list):
            raise ValueError(f"a list is expected: {values!r}")
        return [w for w in (str(v).strip() for v in values or []) if w]

    named = {key: {str(k): listed((v or {}).get("variants")) for k, v in blocks[key].items()} for key in ("features", "auto_aliases")}
    merges = {str(m["into"]): listed(m.get("sources")) for m in blocks["force_merges"] if m.get("into")}
    return named | {"skip_features": listed(blocks["skip_features"]), "force_merges": merges}


def apply_config(features: DataFrame, config: dict[str, Any]) -> DataFrame:
    """features (feature, path) with variants renamed, forced merges made and skipped ones dropped; protected names stay. A setting's lists are short."""
    names: dict[str, str] = {}
    for block in ("auto_aliases", "features", "force_merges"):  # later ones hold
        names |= {v.lower(): canonical for canonical, variants in config[block].items() for v in (canonical, *variants)}
    names = {k: v for k, v in names.items() if k not in PROTECTED}
    skipped = [s.lower() for s in config["skip_features"] if s.lower() not in PROTECTED]
    low = F.lower("feature")
    out = features.where(~low.isin(*skipped)) if skipped else features
    if names:
        out = out.withColumn("feature", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]), low), F.col("feature")))
    return out.distinct()


def suggest_config(packages: DataFrame, owners: DataFrame) -> DataFrame:
    """Names for features that manifests and code owners suggest: canonical, variants, from. packages: dir, name; owners: pattern, team."""
    by_package = packages.where("name is not null").select(slugify(F.element_at(F.split("name", "/"), -1)).alias("canonical"), F.col("name").alias("variant"), F.lit("manifest").alias("by"))
    team = F.regexp_replace(F.element_at(F.split("team", "/"), -1), "^@", "")
    by_team = owners.select(slugify(F.regexp_replace(team, r"(?i)[-_ ]?team$", "")).alias("canonical"), team.alias("variant"), F.lit("owners").alias("by"))
    both = by_package.unionByName(by_team).where("canonical <> ''")
    out = both.groupBy("canonical").agg(F.array_sort(F.collect_set("variant")).alias("variants"), F.array_sort(F.collect_set("by")).alias("by"))
    return out.withColumn("variants", F.filter("variants", lambda v: v != F.col("canonical")))


def code_owners(files: DataFrame) -> DataFrame:
    """pattern and team of CODEOWNERS files at the root, in .github or docs. files: path, text."""
    lines = files.where(F.col("path").rlike(r"^(?:\.github/|docs/)?CODEOWNERS$")).select(F.explode(F.split("text", r"\r?\n")).alias("line"))
    parts = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    return lines.where(F.size(parts) > 1).select(parts[0].alias("pattern"), F.explode(F.slice(parts, 2, F.size(parts))).alias("team")).where(F.startswith("team", F.lit("@")))


#: Lines that a text for a person has at most; a table has the rest.
MOST_SHOWN = 10_000


def _shown(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no text for a person; write the table instead")
    return rows


def render_config(suggested: DataFrame, most: int = MOST_SHOWN) -> str:
    """Suggestions as YAML text, for a person to read; over ``most`` of them are an error."""
    out = ["features:"]
    for r in _shown(suggested.orderBy("canonical"), most):
        out += [f"  {r.canonical}:"] + (["    variants:"] + [f"      - {json.dumps(v)}" for v in r.variants] if r.variants else ["    variants: []"])
    return "\n".join(out) + "\n"


# -- product strings ---------------------------------------------------------------

MOST_STRINGS = 40
_LOCALE_DIRS = r"(?:^|/)(?:locales?|i18n|messages|translations|lang)/"
_DEFAULT_LOCALE = r"(?i)^(?:en(?:[-_][a-z]{2})?|default|messages|common|translation|index)$"


def _flat(value: Any) -> Iterator[str]:
    if isinstance(value, str):
        if re.search(r"[A-Za-z]{2}", value) and 2 <= len(value.strip()) <= 120:
            yield value.strip()
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from _flat(value[k])
    elif isinstance(value, list):
        for v in value:
            yield from _flat(v)


def _strings(path: str, text: str) -> Iterator[tuple[str, str]]:
    leaf = path.rsplit("/", 1)[-1]
    stem, _, ending = leaf.rpartition(".")
    if re.search(r"(?i)\.(?:mdx?|rst|txt|adoc)$|^readme", leaf):
        return
    segments = path.split("/")[:-1]
    other_locale = any(re.fullmatch(r"[a-z]{2}(?:[-_][A-Za-z]{2})?", s) and not s.lower().startswith("en") for s in segments)
    if re.search(_LOCALE_DIRS, path) and ending in ("json", "ts", "js") and not other_locale:
        if re.match(_DEFAULT_LOCALE, stem) or any(s.lower().startswith("en") and len(s) in (2, 5) for s in segments):
            if ending == "json":
                try:
                    yield from (("i18n", v) for v in _flat(json.loads(text)))
                except ValueError:
                    pass
            else:
                yield from (("i18n", m[2].strip()) for m in re.finditer(r"['\"]?[\w.\-]+['\"]?\s*:\s*(['\"])((?:(?!\1).){2,120})\1", text))
        return
    if ending not in ("ts", "tsx", "js", "jsx", "vue", "svelte", "astro"):
        return
    if re.search(r"(?i)nav|sidebar|side-bar|menu|topbar|header|footer|tabs|breadcrumb|links", leaf) or re.search(r"(?i)<nav[\s>]|<Sidebar[\s>/]|<TabsList[\s>/]", text):
        for m in re.finditer(r"\{[^{}]*\}", text):
            label = re.search(r"\b(?:label|title|name|text)\s*:\s*(['\"])((?:(?!\1).){2,80})\1", m[0])
            href = re.search(r"\b(?:href|path|to|url|route)\s*:\s*(['\"`])((?:(?!\1).){1,160})\1", m[0])
            if label:
                yield "nav", f"{label[2]} ({href[2]})" if href else label[2]
        for m in re.finditer(r"<(?:Link|a|NavLink)\b[^>]*\b(?:href|to)=\{?[\"']([^\"'}]+)[\"']\}?[^>]*>\s*([^<{][^<]{1,80}?)\s*<", text):
            yield "nav", f"{m[2]} ({m[1]})"
    if re.search(r"^(?:page|index|route|\+page)\.|Page\.", leaf):
        for m in re.finditer(r"<title>\s*([^<{]{2,80}?)\s*</title>|\btitle\s*:\s*['\"]([^'\"]{2,80})['\"]|<h1[^>]*>\s*([^<{]{2,80}?)\s*</h1>", text):
            yield "title", m[1] or m[2] or m[3]


def product_strings(files: DataFrame, most: int = MOST_STRINGS) -> DataFrame:
    """What a product says of itself, by file: path, source (i18n, nav or title), text and nth, at most ``most`` a file; the cap is the feature. Prose is never read. files: path, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.path, batch.text, strict=True):
                found = list(dict.fromkeys(_strings(path, text or "")))
                rows += [(path, s, t, n) for n, (s, t) in enumerate(found[:most])]
            yield pd.DataFrame(rows, columns=["path", "source", "text", "nth"])

    return files.select("path", "text").mapInPandas(run, "path string, source string, text string, nth int")


def evidence(strings: DataFrame, members: DataFrame, most: int = 30) -> DataFrame:
    """The strings of each feature's files, anchors first, nav before title before i18n: feature, text, nth. members: feature, path, anchor (boolean)."""
    rank = F.when(F.col("source") == "nav", 0).when(F.col("source") == "title", 1).otherwise(2)
    joined = members.join(strings, "path").select("feature", "text", F.struct((~F.col("anchor")).alias("a"), rank.alias("b"), F.col("path").alias("c"), F.col("nth").alias("d")).alias("o"))
    first = joined.groupBy("feature", "text").agg(F.min("o").alias("o"))
    numbered = first.withColumn("nth", F.row_number().over(Window.partitionBy("feature").orderBy("o", "text")))
    return numbered.where(F.col("nth") <= most).select("feature", "text", "nth")


# -- earlier results, normal forms, reports ----------------------------------------


def read_base(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Features and flows of an earlier result: one JSON document with nested features, or one document a feature as write_feature_map leaves it."""
    row = "feature:string,uuid:string,paths:array<string>,total_commits:bigint,bug_fixes:bigint,health_score:double,flows:array<struct<flow:string,uuid:string,paths:array<string>>>"
    text = spark.read.text(path, wholetext=True)
    whole = F.col("value").rlike(r'^\s*\{\s*"features"\s*:')
    docs = text.where(whole).select(F.explode(F.from_json("value", f"struct<features:array<struct<{row}>>>")["features"]).alias("f")).select("f.*")
    lines = text.where(~whole).select(F.explode(F.split("value", r"\n")).alias("v")).where("trim(v) <> ''").select(F.from_json("v", f"struct<{row}>").alias("f")).select("f.*")
    features = docs.unionByName(lines)
    return {"features": features.drop("flows"), "flows": features.select("feature", F.explode("flows").alias("x")).select("feature", "x.*")}


def stable(df: DataFrame) -> DataFrame:
    """df in a stable order: arrays sorted, then rows by all their columns."""
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    out = df.select(*(F.array_sort(c).alias(c) if c in arrays else F.col(c) for c in df.columns))
    return out.orderBy(*(F.to_json(F.struct(c)) if f.dataType.typeName() in ("map", "struct") else F.col(c) for c, f in zip(out.columns, out.schema, strict=True)))


def digest_of(df: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """One row: the number of rows and 64 bits over all of them, whatever their order. Columns of ``volatile`` don't count, nor does the order of columns; arrays are compared sorted."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    own = [F.array_sort(c).alias(c) if c in arrays else F.col(c) for c in sorted(set(df.columns) - set(volatile))]
    row = F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)
    parts = [F.bit_xor(F.conv(F.substring(row, k, 8), 16, 10).cast("long")) for k in (1, 9)]
    # rows that are there twice would cancel out: sums tell them
    sums = F.sum(F.conv(F.substring(row, 17, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", *[F.lower(F.hex(F.coalesce(p, F.lit(0)))) for p in parts], F.coalesce(sums, F.lit(0).cast("decimal(38,0)")).cast("string")).alias("digest"))


_SCHEMA = "_schema"


def write_typed(df: DataFrame, at: str) -> None:
    """A table as JSON lines beside its schema, so that times, bytes, maps and nested types come back as they were."""
    maps = {f.name for f in df.schema if f.dataType.typeName() == "map"}
    kept = df.select(*[F.map_entries(c).alias(c) if c in maps else F.col(c) for c in df.columns])  # keys of a map may be no text
    kept.write.mode("overwrite").option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{at}/rows")
    spark = df.sparkSession
    spark.createDataFrame([(df.schema.json(), kept.schema.json())], "own string, kept string").write.mode("overwrite").parquet(f"{at}/{_SCHEMA}")


def read_typed(spark: SparkSession, at: str) -> DataFrame:
    """A table that write_typed has left."""
    known = spark.read.parquet(f"{at}/{_SCHEMA}").first()
    own, kept = (T.StructType.fromJson(json.loads(known[c])) for c in ("own", "kept"))
    rows = spark.read.schema(kept).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{at}/rows")
    return rows.select(*[F.map_from_entries(f.name).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in own])


def report_lines(features: DataFrame, flows: DataFrame) -> DataFrame:
    """The risk table for people, in order: n and line, features by bug share, their flows below them.

    features: feature, health_score, total_commits, bug_fixes, bug_fix_ratio, coverage_pct; flows: feature, flow and the same.
    """

    def cells(name: Column) -> Column:
        cover = F.when(F.col("coverage_pct").isNull(), "-").otherwise(F.concat(F.format_number("coverage_pct", 0), F.lit("%")))
        return F.concat(F.lit("| "), F.concat_ws(" | ", name, F.format_number("health_score", 0), F.col("total_commits").cast("string"), F.col("bug_fixes").cast("string"), F.concat(F.format_number(F.col("bug_fix_ratio") * 100, 1), F.lit("%")), cover), F.lit(" |"))

    top = features.withColumn("_r", F.col("bug_fix_ratio"))
    rank = features.select("feature", F.row_number().over(Window.orderBy(F.desc("bug_fix_ratio"), "feature")).alias("_rank"))  # as many rows as features
    heads = top.join(rank, "feature").select(F.col("_rank").alias("a"), F.lit(0).alias("b"), cells(F.col("feature")).alias("line"))
    nth = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("bug_fix_ratio"), "flow"))
    below = flows.withColumn("_n", nth).join(rank, "feature").select(F.col("_rank").alias("a"), F.col("_n").alias("b"), cells(F.concat(F.lit("- "), F.col("flow"))).alias("line"))
    both = heads.unionByName(below)
    return both.withColumn("n", F.row_number().over(Window.orderBy("a", "b"))).select("n", "line")


def report(features: DataFrame, flows: DataFrame, top: int = 3, most: int = MOST_SHOWN) -> str:
    """The report as text: the table, then the worst ``top`` features with bug fixes. A table of over ``most`` lines is an error; report_lines has it."""
    lines = ["| Feature / Flow | Health | Commits | Bug fixes | Bug % | Cov % |", "|---|---|---|---|---|---|"]
    lines += [r.line for r in _shown(report_lines(features, flows).orderBy("n"), most)]
    worst = features.where("bug_fixes > 0").orderBy(F.desc("bug_fix_ratio"), "feature").limit(top).collect()
    lines += ["", f"Top {top} risk zones:" if worst else "No critical risk zones detected."]
    lines += [f"{i}. {r.feature}: {r.bug_fixes} bug fixes out of {r.total_commits} commits ({r.bug_fix_ratio * 100:.1f}%)" for i, r in enumerate(worst, 1)]
    return "\n".join(lines) + "\n"
