"""Word lists that decide what a path, a verb or a route is. FIXED VALUES: results depend on each of them."""

from __future__ import annotations

#: Intent of a flow's verb; other verbs are ``other``.
INTENT_VERBS = {
    "author": (
        "create", "add", "new", "author", "update", "edit", "patch", "configure", "set", "register", "setup", "connect", "initialize", "compose",
        "customize", "enter", "input", "submit", "select", "subscribe", "apply", "provide", "upload", "import",
    ),
    "browse": (
        "list", "view", "get", "show", "search", "filter", "browse", "inspect", "retrieve", "read", "open", "preview", "verify", "validate", "check",
        "confirm", "fetch", "access", "render", "display", "count", "detect",
    ),
    "lifecycle": (
        "approve", "reject", "enable", "disable", "promote", "publish", "adopt", "archive", "resolve", "close", "accept", "complete", "revoke", "renew",
        "activate", "deactivate",
    ),
    "execute": (
        "run", "trigger", "execute", "generate", "send", "dispatch", "refresh", "sync", "revalidate", "rerun", "schedule", "monitor", "notify",
        "distribute", "invite", "process", "migrate", "authenticate", "login", "receive", "handle",
    ),
    "manage": ("delete", "remove", "reset", "manage", "track", "assign", "tag", "link", "toggle", "rotate", "format"),
    "bulk": ("bulk",),
    "export": ("export", "download", "report"),
}

#: Name of a journey by its intent.
JOURNEY_NAMES = {
    "author": "Create & edit {}",
    "browse": "Browse & filter {}",
    "lifecycle": "Transition {} through its lifecycle",
    "execute": "Run {}",
    "manage": "Manage {}",
    "bulk": "Bulk-manage {}",
    "export": "Export {}",
    "other": "{}",
}

#: Files that nobody wrote as product: never these, wherever they are ...
CONFIG_NAMES = ("package.json", "components.json", "manifest.json", "project.json", "turbo.json", "nx.json", "lerna.json")
CONFIG_PATTERN = r"^(?:tsconfig.*\.json|.*\.config\.json)$"
#: ... else by ending, directory, file name or place.
LOCALE_ENDINGS = ("po", "pot")
LOCALE_DIRS = ("locales", "messages", "translations", "lang")
GENERATED_DIRS = ("__generated__", "generated", "generated-metadata")
GENERATED_NAME = r"\.generated\."
TESTING_DIRS = ("__mocks__", "__fixtures__", "mocks")
TESTING_PLACE = "/testing/mock"
SEED_DIRS = ("seeds", "dev-seeder", "seed-data")

#: Surfaces in order of precedence.
SCOPES = ("product", "system", "dev_tooling", "legal", "docs", "marketing", "shell")
ROUTE_GROUPS = {
    "product": ("dashboard", "dash", "app", "auth", "authenticated", "protected", "admin", "console", "platform", "workspace"),
    "marketing": ("marketing", "landing", "www", "web-marketing", "promo"),
    "legal": ("legal",),
    "docs": ("docs", "documentation"),
    "dev_tooling": ("devtools",),
}
URL_SEGMENTS = {
    "marketing": (
        "blog", "pricing", "about", "about-us", "contact", "contact-us", "careers", "press", "newsroom", "brand", "changelog", "landing", "landings",
        "marketing", "solutions", "glossary", "newsletter",
    ),
    "legal": (
        "legal", "terms", "terms-of-service", "terms-and-conditions", "privacy", "privacy-policy", "imprint", "cookie-policy", "cookies", "gdpr", "dpa",
        "tos", "eula",
    ),
    "docs": ("docs", "documentation", "guides", "guide", "tutorials", "tutorial", "learn", "api-reference"),
    "dev_tooling": ("mcp", "mcp-server", "devtools"),
}
WORKSPACE_DIRS = {
    "marketing": ("www", "website", "marketing", "landing", "landings", "landing-page", "landing-pages", "blog", "brand"),
    "docs": ("docs", "documentation"),
    "dev_tooling": ("cli", "mcp", "mcp-server", "devtools", "storybook"),
}
ROOT_DIRS = {"marketing": ("www", "website"), "docs": ("docs", "documentation")}
WORKSPACE_PARENTS = ("apps", "packages", "sites", "websites", "tools")
URL_ROOTS = ("app", "pages", "routes")
NEUTRAL_STEMS = ("page", "route", "index", "layout", "_index", "default")
SHELL_NAMES = ("home", "landing", "index", "main", "root")
INFO_SEGMENTS = ("contact", "contact-us", "about", "about-us", "imprint", "faq")


#: What makes no journey by itself. Directories and words of things that are drawn ...
PRIMITIVE_DIRS = ("ui", "components", "component", "design-system", "design_system", "primitives", "primitive", "atoms", "atom")
PRIMITIVE_WORDS = (
    "atom", "atoms", "component", "components", "primitive", "primitives", "widget", "widgets", "data", "table", "datatable", "form", "forms",
    "builder", "embed", "embeddable", "embeds", "icon", "icons", "ui", "layout", "layouts", "theme", "themes", "style", "styles",
)
PRIMITIVE_LEADS = ("components", "component", "atoms", "atom", "ui", "primitives", "primitive", "widgets", "widget", "designsystem", "design")
#: ... directories with a connector each, and the domain that stands for them all ...
PLUGIN_ROOTS = ("app-store", "app_store", "apps", "integrations", "integration", "connectors", "connector", "plugins", "plugin", "extensions")
PLUGIN_DOMAIN = "integration"
#: ... words and packages of what other code is built on ...
INFRA_DOMAINS = (
    "di", "dto", "ioc", "container", "util", "utils", "lib", "libs", "library", "libraries", "config", "configs", "configuration", "settings_config",
    "type", "types", "typing", "const", "constant", "constants", "enum", "enums", "helper", "helpers", "util_helper", "internal", "core", "common",
    "shared", "base", "misc", "prisma", "schema", "orm", "client", "key", "keys", "command", "commands", "api", "app", "apps", "no", "yes",
    "automated", "transactional", "platform_library", "internationalization", "i18n", "intl", "locale", "locales",
)
INFRA_PACKAGES = (
    "lib", "libs", "library", "libraries", "utils", "util", "helpers", "config", "configs", "types", "typings", "constants", "internal", "prisma",
    "schema", "orm", "db", "database", "emails", "email", "mail", "mailer", "sms", "i18n", "intl", "internationalization", "locales",
    "translations", "di", "ioc",
)
#: ... top directories of samples, and directories that only lead to packages.
ARTIFACT_ROOTS = ("playground", "playgrounds", "example", "examples", "demo", "demos", "sample", "samples")
WORKSPACE_ROOTS = ("packages", "package", "apps", "app", "src", "lib", "libs", "modules", "platform", "internal", "pkg", "crates", "services", "projects")

#: Where a path names the domain that it serves, in order; module directories that are no domain; words before a label's noun.
ROUTER_FILE = r"routers?/([a-z0-9_]+)\.py"
JOB_FILE = r"(?:^|/)(?:inngest_functions?|inngest|celery_tasks?|tasks?|workers?|jobs?)/([a-z0-9_]+)\.py"
MODULE_DIR = r"(?:^|/)(?:modules?|pages?|features?|views?|screens?)/([a-z0-9][-a-z0-9_]+)"
SOURCE_DIR = r"(?:^|/)(?:app|src|frontend/src|backend|services|jobs)/([a-z0-9_]+)"
NO_MODULES = ("components", "utils", "hooks", "lib", "types", "helpers", "common", "shared", "core", "base", "layouts", "styles", "assets", "constants")
LABEL_LEADS = (
    "the", "a", "an", "and", "with", "of", "for", "to", "rest", "api", "com", "self", "multi", "auto", "real", "full", "open", "custom", "smart",
    "new", "advanced", "built", "in",
)


def lookup(table: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Word to its class; of classes that share a word, the first."""
    out: dict[str, str] = {}
    for kind, words in table.items():
        for w in words:
            out.setdefault(w, kind)
    return out
