"""Planted trees for every source of anchors and every profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import anchors
from .planted import once, planted

FILES = "path string, text string"
PATHS = "path string"


def _of(*sources: str):
    return lambda files: anchors.text_hits(files).where(F.col("source").isin(*sources))


def _by_path(source: str, stack: str = "", workspace: str = ""):
    return lambda files: anchors.path_hits(files, stack, workspace).where(F.col("source") == source)


COLUMNS = "name path method pattern"

# -- file routes -------------------------------------------------------------------

ROUTED = [
    ("app/(shop)/orders{k}/[id]/page.tsx",), ("app/(team{k})/page.tsx",), ("app/api/hooks{k}/route.ts",), ("src/app/_private/x/page.tsx",), ("app/page.tsx",), ("app/users{k}/list.tsx",),
    ("lib/app/users{k}/page.tsx",), ("app/items{k}/page.test.tsx",),
]
planted("source_file_routes", {"files": (PATHS, ROUTED)}, _by_path("route", "next-app-router"), "name path", [("orders{k}", ROUTED[0][0]), ("team{k}", ROUTED[1][0]), ("hooks{k}", ROUTED[2][0]), ("x", ROUTED[3][0])])
planted("source_file_routes_remix", {"files": (PATHS, [("app/routes/admin+/users{k}.tsx",), ("app/routes/_auth/login{k}.tsx",), ("app/routes/$slug.tsx",), ("app/routes/_index.tsx",)])}, _by_path("route", "remix"), "name path", [("admin", "app/routes/admin+/users{k}.tsx"), ("login{k}", "app/routes/_auth/login{k}.tsx")])
planted("source_file_routes_python", {"files": (PATHS, [("shop{k}/urls.py",), ("api/routers/find{k}.py",), ("api/routers/__init__.py",), ("a/views.py",)])}, _by_path("route", "django"), "name path", [("shop{k}", "shop{k}/urls.py"), ("find{k}", "api/routers/find{k}.py")])
planted(
    "source_app_router",
    {"files": (PATHS, [*ROUTED, ("apps/web/app/@modal/u{k}/[...rest]/page.jsx",)])},
    _by_path("approuter-keyless"),
    COLUMNS,
    [
        ("orders{k}", ROUTED[0][0], "PAGE", "/orders{k}/:id"),
        ("hooks{k}", ROUTED[2][0], "API", "/api/hooks{k}"),
        ("users{k}", ROUTED[6][0], "PAGE", "/users{k}"),
        ("u{k}", "apps/web/app/@modal/u{k}/[...rest]/page.jsx", "PAGE", "/u{k}/*rest"),
    ],
)
planted(
    "source_mvc",
    {"files": (PATHS, [("app/controllers/order_item{k}_controller.rb",), ("src/UserAuth{k}Controller.php",), ("lib/x{k}_controller.ex",), ("A{k}Controller.java",), ("app/Controller.php",), ("a_controller.py",)])},
    _by_path("mvc"),
    "name path",
    [("order-item{k}", "app/controllers/order_item{k}_controller.rb"), ("user-auth{k}", "src/UserAuth{k}Controller.php"), ("x{k}", "lib/x{k}_controller.ex"), ("a{k}", "A{k}Controller.java")],
)
planted(
    "source_spa_router",
    {"files": (FILES, [("src/pages/shop{k}/[id].vue", ""), ("src/r{k}.tsx", '<Routes><Route path="/cart{k}" element={<CartPage />} /><Route path="*" element={<Navigate to="/" />} /><Route path="/" element={<Home{k}Page />} /></Routes>'), ("src/t{k}.ts", "export const r = createBrowserRouter([{ path: '/team{k}', element: x, children: [{ path: ':id', element: y }, { path: 'add', element: z }] }, { path: '/faq{k}', element: q }]);")])},
    lambda files: anchors.path_hits(files).unionByName(anchors.text_hits(files)).where("source = 'spa-router'"),
    COLUMNS,
    [
        ("shop{k}", "src/pages/shop{k}/[id].vue", "PAGE", "/shop{k}/:id"),
        ("cart{k}", "src/r{k}.tsx", "PAGE", "/cart{k}"),
        ("home{k}", "src/r{k}.tsx", "PAGE", "/"),
        ("team{k}", "src/t{k}.ts", "PAGE", "/team{k}"),
        ("team{k}", "src/t{k}.ts", "PAGE", "/team{k}/:id"),
        ("team{k}", "src/t{k}.ts", "PAGE", "/team{k}/add"),
        ("faq{k}", "src/t{k}.ts", "PAGE", "/faq{k}"),
    ],
)

# -- by text -----------------------------------------------------------------------

planted(
    "source_schema_models",
    {"files": (FILES, [("db{k}/schema.prisma", "model Order{k} {\n  id Int\n}\n// model Not\nenum Kind{k} {\n}"), ("d{k}/db/schema.ts", "export const users{k} = pgTable('users', {})"), ("r{k}/db/schema.rb", 'create_table "items{k}", force: true'), ("p{k}/models.py", "class Bill{k}(models.Model):\n    pass\nclass Plain:\n    pass"), ("x{k}/schema/pay{k}.ts", "export const pay{k} = mysqlTable('p', {})")])},
    _of("schema"),
    COLUMNS,
    [
        ("order{k}", "db{k}/schema.prisma", "model", "Order{k}"), ("kind{k}", "db{k}/schema.prisma", "enum", "Kind{k}"), ("users{k}", "d{k}/db/schema.ts", "table", "users{k}"),
        ("items{k}", "r{k}/db/schema.rb", "table", "items{k}"), ("bill{k}", "p{k}/models.py", "model", "Bill{k}"), ("pay{k}", "x{k}/schema/pay{k}.ts", "table", "pay{k}"),
    ],
)
planted(
    "source_packages",
    {"files": (FILES, [("p{k}/package.json", '{"name": "@o/pay{k}", "dependencies": {"stripe": "1", "@auth/core": "2", "left-pad": "1"}, "devDependencies": {"ws": "1"}}'), ("q{k}/pyproject.toml", 'dependencies = [\n  "celery>=5",\n  "stripes",\n  "openai",\n]'), ("q{k}/requirements.txt", "boto3==1\nrequests\n")])},
    _of("package"),
    COLUMNS,
    [
        ("billing", "p{k}/package.json", "dependency", "stripe"), ("auth", "p{k}/package.json", "dependency", "@auth/core"), ("realtime", "p{k}/package.json", "dependency", "ws"), ("pay{k}", "p{k}/package.json", "workspace", "@o/pay{k}"),
        ("background-jobs", "q{k}/pyproject.toml", "dependency", "celery"), ("ai", "q{k}/pyproject.toml", "dependency", "openai"), ("file-uploads", "q{k}/requirements.txt", "dependency", "boto3"),
    ],
)
planted(
    "source_manifests",
    {"files": (FILES, [("t{k}/tauri.conf.json", '{"app": {"windows": [{"label": "Pad{k}"}, {"title": "main"}]}}'), ("e{k}/app.json", '{"expo": {"plugins": ["expo-camera{k}", ["expo-maps{k}", {}]]}}'), ("c{k}/manifest.json", '{"manifest_version": 3, "action": {}, "content_scripts": [1]}'), ("v{k}/package.json", '{"engines": {"vscode": "^1"}, "contributes": {"commands": [{"title": "Run Lint {k}"}]}}'), ("s{k}/manifest.yaml", "features:\n  slash_commands:\n    - command: /poll{k}\n"), ("x{k}/manifest.json", '{"manifest_version": 2, "action": {}}')])},
    _of("config"),
    COLUMNS,
    [
        ("pad{k}", "t{k}/tauri.conf.json", "tauri", "Pad{k}"), ("camera{k}", "e{k}/app.json", "expo", "camera{k}"), ("maps{k}", "e{k}/app.json", "expo", "maps{k}"), ("popup", "c{k}/manifest.json", "chrome", "popup"),
        ("content-scripts", "c{k}/manifest.json", "chrome", "content-scripts"), ("run-lint-{k}", "v{k}/package.json", "vscode", "Run Lint {k}"), ("poll{k}", "s{k}/manifest.yaml", "slack", "poll{k}"),
    ],
)
planted(
    "source_go_router",
    {"files": (FILES, [("g{k}/main.go", 'r := gin.Default()\nv1 := r.Group("/v1")\nv1.GET("/users{k}/:id", h)\nr.POST("/login{k}", h)\nmux.HandleFunc("GET /ping{k}", h)\nr.Get("not-a-path", h)'), ("g{k}/main_test.go", 'r.GET("/no{k}", h)')])},
    _of("go-router"),
    COLUMNS,
    [("users{k}", "g{k}/main.go", "GET", "/v1/users{k}/:id"), ("login{k}", "g{k}/main.go", "POST", "/login{k}"), ("ping{k}", "g{k}/main.go", "GET", "/ping{k}")],
)
GO = [("cmd/serve{k}/main.go",), ("internal/auth{k}/o/x.go",), ("internal/gen{k}/a.pb.go",), ("pkg{k}/a.go",), ("pkg{k}/a_test.go",), ("vendor/x{k}/a.go",), ("main{k}.go",)]
planted("source_go_packages", {"files": (PATHS, GO)}, lambda files: anchors.go_packages(anchors.path_hits(files)), "name path", [("serve{k}", "cmd/serve{k}/main.go"), ("auth{k}", "internal/auth{k}/o/x.go"), ("pkg{k}", "pkg{k}/a.go"), ("pkg{k}", "pkg{k}/a_test.go")])
CARGO = [
    ("w{k}/Cargo.toml", '[workspace]\nmembers = ["crates/*", "tool"]\nexclude = ["crates/old"]'), ("w{k}/crates/net/Cargo.toml", '[package]\nname = "net-{k}"'), ("w{k}/crates/net/src/lib.rs", ""), ("w{k}/crates/old/src/lib.rs", ""),
    ("w{k}/tool/src/main.rs", ""), ("w{k}/other/src/lib.rs", ""),
]
planted(
    "source_rust_workspace",
    {"files": (FILES, CARGO)},
    lambda files: anchors.rust_crates(anchors.text_hits(files), files),
    "name member path",
    [("net-{k}", "w{k}/crates/net", "w{k}/crates/net/Cargo.toml"), ("net-{k}", "w{k}/crates/net", "w{k}/crates/net/src/lib.rs"), ("tool", "w{k}/tool", "w{k}/tool/src/main.rs")],
)
FLAT = [(f"big/src/m{i}.rs",) for i in range(9)] + [("a/src/one.rs",), ("a/src/net/tcp.rs",), ("b/src/one.rs",), ("b/src/lib.rs",), ("b/src/bin/run.rs",), ("c/tests/src/x.rs",)]
once("source_rust_modules", {"files": (PATHS, FLAT)}, lambda files: anchors.rust_modules(anchors.path_hits(files)), "name path method", [("big", p[0], "flat") for p in FLAT[:9]] + [("a-one", "a/src/one.rs", "flat"), ("net", "a/src/net/tcp.rs", "folder"), ("b-one", "b/src/one.rs", "flat"), ("run", "b/src/bin/run.rs", "bin")])
planted(
    "source_python_library",
    {"files": (FILES, [("lib{k}/__init__.py", "from .client import Client\nfrom ._hidden import x\nfrom .auth.flow import (\n  A,\n)\n__all__ = ['Client{k}', \"go\"]"), ("lib{k}/store{k}/__init__.py", ""), ("tests/__init__.py", "from .a import b")])},
    _of("python-library"),
    COLUMNS,
    [
        ("client", "lib{k}/__init__.py", "export", "client"), ("auth", "lib{k}/__init__.py", "export", "auth"), ("client{k}", "lib{k}/__init__.py", "symbol", "Client{k}"), ("go", "lib{k}/__init__.py", "symbol", "go"),
        ("store{k}", "lib{k}/store{k}/__init__.py", "submodule", "lib{k}.store{k}"),
    ],
)
planted(
    "source_js_library",
    {"files": (FILES, [("j{k}/package.json", '{"exports": {".": "./i.js", "./fetch{k}": "./f.js", "./package.json": "./package.json"}}'), ("j{k}/src/index.ts", "export { get } from './http{k}.js';\nexport * from './cache/lru';\nexport { a } from 'other';"), ("z{k}/package.json", '{"dependencies": {"next": "1"}, "exports": {"./no": "./f.js"}}')])},
    _of("js-library"),
    COLUMNS,
    [("fetch{k}", "j{k}/package.json", "subpath", "./fetch{k}"), ("http{k}", "j{k}/src/index.ts", "reexport", "get"), ("cache", "j{k}/src/index.ts", "reexport", "*")],
)
FASTAPI = [
    ("f{k}/main.py", "app = FastAPI()\napp.include_router(orders.router, prefix='/api/v1')\n@app.get('/health{k}')\ndef h(): pass"),
    ("f{k}/routers/orders.py", "router = APIRouter(prefix=\"/orders{k}\", tags=['x'])\n@router.get('/{oid}')\ndef one(): pass\n@router.post('')\ndef add(): pass"),
    ("f{k}/tests/orders.py", "@router.get('/no')"),
]
planted(
    "source_fastapi_routes",
    {"files": (FILES, FASTAPI)},
    lambda files: anchors.mounted_fastapi(anchors.text_hits(files)),
    COLUMNS,
    [("health{k}", "f{k}/main.py", "GET", "/health{k}"), ("orders{k}", "f{k}/routers/orders.py", "GET", "/api/v1/orders{k}/{oid}"), ("orders{k}", "f{k}/routers/orders.py", "POST", "/api/v1/orders{k}")],
)
planted(
    "source_fastify_routes",
    {"files": (FILES, [("y{k}/r.ts", "import fastify from 'fastify';\nfastify.get<{X: 1}>('/cart{k}/:id', h);\nserver.route({ method: ['PUT', 'PATCH'], url: '/item{k}', handler() { x({ url: '/no' }) } });"), ("y{k}/n.ts", "app.get('/no{k}', h)")])},
    _of("fastify-route"),
    COLUMNS,
    [("cart{k}", "y{k}/r.ts", "GET", "/cart{k}/:id"), ("item{k}", "y{k}/r.ts", "PUT", "/item{k}"), ("item{k}", "y{k}/r.ts", "PATCH", "/item{k}")],
)
planted(
    "source_express_routes",
    {"files": (FILES, [("x{k}/s.js", "const users = express.Router();\napp.use('/users{k}', auth, users);\nusers.get('/:id', h);\napp.route('/books{k}').get((q, r) => r.send(1)).post(h);\ncache.get('/no');\nmap.get('key')"), ("x{k}/n.ts", "import { Get } from '@nestjs/common';\napp.get('/no{k}', h)")])},
    _of("express-route"),
    COLUMNS,
    [("users{k}", "x{k}/s.js", "GET", "/users{k}/:id"), ("books{k}", "x{k}/s.js", "GET", "/books{k}"), ("books{k}", "x{k}/s.js", "POST", "/books{k}")],
)
DJANGO = [
    ("d{k}/site{k}/urls.py", "urlpatterns = [\n  path('shop/', include('shop{k}.urls')),\n  path('admin/', admin.site.urls),\n]"),
    ("d{k}/shop{k}/urls.py", "router.register(r'carts', CartViewSet)\nurlpatterns = [\n  path('list/<int:pk>/', OrderView.as_view(), name='o'),\n  re_path(r'^old/(?P<slug>[a-z]+)/$', old),\n]"),
    ("d{k}/shop{k}/views.py", "class OrderListView(ListView):\n    pass\nclass Helper(object):\n    pass"),
]
planted(
    "source_django_urls",
    {"files": (FILES, DJANGO)},
    lambda files: anchors.mounted_django(anchors.text_hits(files)),
    COLUMNS,
    [("site{k}", "d{k}/site{k}/urls.py", "URL", "/admin"), ("shop{k}", "d{k}/shop{k}/urls.py", "URL", "/shop/list/<int:pk>"), ("shop{k}", "d{k}/shop{k}/urls.py", "URL", "/shop/old/<slug>"), ("carts", "d{k}/shop{k}/urls.py", "REST", "/shop/carts")],
)
planted("source_django_views", {"files": (FILES, DJANGO)}, _of("django-view"), COLUMNS, [("order-list", "d{k}/shop{k}/views.py", "VIEW", "OrderListView")])
planted(
    "source_server_api",
    {
        "files": (
            FILES,
            [
                ("n{k}/c.ts", "import { Controller } from '@nestjs/common';\n@Controller('cats{k}')\nexport class CatsController {\n  @Get(':id')\n  one() {}\n  @Post()\n  add() {}\n}\n@Controller({ path: 'dogs{k}' })\nexport class DogsController {\n  @Delete('x')\n  del() {}\n}"),
                ("n{k}/r.ts", "import { Resolver } from 'type-graphql';\n@Resolver(() => Pet{k})\nclass PetResolver {\n  @Query(() => [Pet], { name: 'allPets' })\n  pets() {}\n  @Mutation(() => Pet)\n  async addPet() {}\n}"),
                ("n{k}/p.ts", "import SchemaBuilder from '@pothos/core';\nbuilder.queryField('invoice{k}', (t) => t.x())"),
                ("n{k}/t.ts", "export const bill{k}Router = createTRPCRouter({ list: publicProcedure.query(() => 1), pay: protectedProcedure.input(z).mutation(f) })"),
                ("n{k}/k.ts", "import Router from '@koa/router';\nconst api2 = new Router({ prefix: '/v1' });\napi2.get('/maps{k}', h);"),
                ("n{k}/examples/e.ts", "import Router from '@koa/router';\nrouter.get('/no', h)"),
            ],
        )
    },
    _of("server-api"),
    COLUMNS,
    [
        ("cats{k}", "n{k}/c.ts", "GET", "/cats{k}/:id"), ("cats{k}", "n{k}/c.ts", "POST", "/cats{k}"), ("dogs{k}", "n{k}/c.ts", "DELETE", "/dogs{k}/x"), ("pet{k}", "n{k}/r.ts", "QUERY", "allPets"), ("pet{k}", "n{k}/r.ts", "MUTATION", "addPet"),
        ("invoice{k}", "n{k}/p.ts", "QUERY", "invoice{k}"), ("bill{k}", "n{k}/t.ts", "QUERY", "list"), ("bill{k}", "n{k}/t.ts", "MUTATION", "pay"), ("maps{k}", "n{k}/k.ts", "GET", "/v1/maps{k}"),
    ],
)
planted(
    "source_jobs",
    {
        "files": (
            FILES,
            [
                ("w{k}/a.py", "from celery import shared_task\n@shared_task(name='mail.send{k}_task')\ndef x(): pass\n@app.task\ndef sync{k}_job(): pass"),
                ("w{k}/b.py", "from apscheduler import S\n@sched.scheduled_job('cron')\ndef nightly{k}(): pass\ns.add_job(jobs.purge{k}, 'interval')"),
                ("w{k}/c.ts", "import { Worker } from 'bullmq';\nnew Worker<X>('mail{k}', run);"),
                ("w{k}/d.ts", "import cron from 'node-cron';\nconst digest{k}Cron = cron.schedule('0 * * * *', f);"),
                ("w{k}/e.ts", "import { task, schedules } from '@trigger.dev/sdk';\nexport const a = task({ id: 'resize{k}', run });\nexport const b = schedules.task({ id: 'daily{k}', run });"),
                ("w{k}/f.ts", "@Processor('audio{k}')\nexport class AudioConsumer {}"),
            ],
        )
    },
    _of("jobs"),
    "name path method",
    [
        ("send{k}", "w{k}/a.py", "JOB"), ("sync{k}", "w{k}/a.py", "JOB"), ("nightly{k}", "w{k}/b.py", "CRON"), ("purge{k}", "w{k}/b.py", "CRON"), ("mail{k}", "w{k}/c.ts", "JOB"), ("digest{k}", "w{k}/d.ts", "CRON"),
        ("resize{k}", "w{k}/e.ts", "JOB"), ("daily{k}", "w{k}/e.ts", "CRON"), ("audio{k}", "w{k}/f.ts", "JOB"),
    ],
)
planted(
    "source_rails_routes",
    {"files": (FILES, [("a{k}/config/routes.rb", "resources :orders{k} do\n  resource :bill\nend\n# resources :no\nnamespace :shop{k}\nget '/ping{k}', to: 'x#y'\nget 'a' => 'b#c'")])},
    _of("rails-routes"),
    COLUMNS,
    [("orders{k}", "a{k}/config/routes.rb", "resources", "orders{k}"), ("bill", "a{k}/config/routes.rb", "resource", "bill"), ("shop{k}", "a{k}/config/routes.rb", "namespace", "shop{k}"), ("ping{k}", "a{k}/config/routes.rb", "verb", "ping{k}"), ("a", "a{k}/config/routes.rb", "verb", "a")],
)
planted(
    "source_rails_models",
    {"files": (FILES, [("app/models/order{k}.rb", "class OrderLine{k} < ApplicationRecord\n  has_many :items\n  belongs_to :user\nend\nclass X < Y\nend")])},
    _of("rails-models", "rails-association"),
    "source " + COLUMNS,
    [("rails-models", "order-line{k}", "app/models/order{k}.rb", "model", "OrderLine{k}"), ("rails-association", "order-line{k}", "app/models/order{k}.rb", "has_many", "items"), ("rails-association", "order-line{k}", "app/models/order{k}.rb", "belongs_to", "user")],
)
planted("source_rails_views", {"files": (PATHS, [("app/views/orders{k}/show.html.erb",), ("app/views/layouts/a.erb",), ("app/views/x{k}/a.css",)])}, _by_path("rails-views"), "name path", [("orders{k}", "app/views/orders{k}/show.html.erb")])
planted("source_rails_jobs", {"files": (FILES, [("app/jobs/a{k}.rb", "class SendMail{k}Job < ApplicationJob\nend"), ("app/jobs/b{k}.rb", "class Sweep{k}\n  include Sidekiq::Worker\nend"), ("app/jobs/application_job.rb", "class ApplicationJob < ActiveJob::Base\nend")])}, _of("rails-jobs"), "name path method", [("send-mail{k}", "app/jobs/a{k}.rb", "JOB"), ("sweep{k}", "app/jobs/b{k}.rb", "JOB")])
planted("source_rails_stimulus", {"files": (PATHS, [("app/javascript/controllers/drop_down{k}_controller.js",), ("app/javascript/x{k}_controller.js",)])}, _by_path("rails-stimulus"), "name path", [("drop-down{k}", "app/javascript/controllers/drop_down{k}_controller.js")])
planted(
    "source_own_patterns",
    {"files": (FILES, [("z{k}/a.foo", "thing Alpha{k}\nthing Beta{k}"), ("z{k}/a.bar", "thing No")])},
    lambda files: anchors.text_hits(files, ((r"\.foo$", lambda path, text: (("foo", anchors.slug(x), path, None, x) for x in __import__("re").findall(r"thing (\w+)", text))),)),
    COLUMNS,
    [("alpha{k}", "z{k}/a.foo", None, "Alpha{k}"), ("beta{k}", "z{k}/a.foo", None, "Beta{k}")],
)
planted(
    "anchor_candidates",
    {"hits": (anchors.HIT, [("route", "orders{k}", "a{k}", None, "/o"), ("route", "orders{k}", "b{k}", None, "/p"), ("route", "orders{k}", "b{k}", None, None), ("rails-jobs", "mail{k}", "c{k}", "JOB", "M"), ("new", "mail{k}", "c{k}", None, None)])},
    lambda hits: anchors.candidates(hits).withColumn("paths", F.array_join("paths", ",")),
    "source name paths routes confidence",
    [("route", "orders{k}", "a{k},b{k}", 2, 0.7), ("rails-jobs", "mail{k}", "c{k}", 1, 0.85), ("new", "mail{k}", "c{k}", 0, 0.75)],
)

# -- profiles ----------------------------------------------------------------------

ROLES = {
    "default": [("app/x{k}/page.tsx", "other", None), ("tests/a{k}.py", "other", None)],
    "next_app_router": [
        ("w{k}/app/(shop)/orders{k}/[id]/page.tsx", "page", "orders{k}"), ("w{k}/app/page.tsx", "page", None), ("w{k}/app/api/hooks{k}/x/route.ts", "api", "hooks{k}"), ("w{k}/app/orders/layout.tsx", "layout", None),
        ("w{k}/components/cart{k}/a.tsx", "component", "cart{k}"), ("w{k}/components/a.tsx", "component", None), ("w{k}/lib/a.ts", "lib", None), ("w{k}/app/a/page.test.tsx", "test", None), ("w{k}/x.css", "other", None),
    ],
    "next_pages_react": [("w{k}/pages/api/pay{k}.ts", "api", "pay{k}"), ("w{k}/pages/_app.tsx", "layout", None), ("w{k}/pages/index.tsx", "page", None), ("w{k}/pages/cart{k}/[id].tsx", "page", "cart{k}"), ("w{k}/src/features/chat{k}/a.ts", "feature", "chat{k}"), ("w{k}/src/screens/Home{k}.tsx", "page", "home{k}")],
    "react_router_framework": [("w{k}/app/root.tsx", "entry", None), ("w{k}/app/routes/_auth.login{k}.tsx", "page", "login{k}"), ("w{k}/app/routes/team{k}.$id.tsx", "page", "team{k}"), ("w{k}/app/components/nav{k}/a.tsx", "component", "nav{k}")],
    "fastapi_family": [("w{k}/main.py", "entry", None), ("w{k}/routers/user_group{k}.py", "api", "user-group{k}"), ("w{k}/pay{k}/router.py", "api", "pay{k}"), ("w{k}/services/mail{k}.py", "service", "mail{k}"), ("w{k}/schemas/order{k}.py", "schema", "order{k}"), ("w{k}/tests/test_a.py", "test", None)],
    "django": [("w{k}/manage.py", "entry", None), ("w{k}/shop{k}/migrations/0001.py", "migration", "shop{k}"), ("w{k}/shop{k}/urls.py", "urls", "shop{k}"), ("w{k}/shop{k}/views/a.py", "view", "shop{k}"), ("w{k}/shop{k}/models.py", "model", "shop{k}"), ("w{k}/shop{k}/admin.py", "admin", "shop{k}"), ("w{k}/shop{k}/tasks.py", "app", "shop{k}")],
}
for _name, _rows in ROLES.items():
    planted(f"profile_{_name}", {"files": (PATHS, [(p,) for p, _, _ in _rows])}, lambda files, _name=_name: anchors.file_roles(files, _name), "path role feature", _rows)
planted(
    "profile_composite",
    {"files": (PATHS, [("c{k}/web/app/cart{k}/page.tsx",), ("c{k}/api/routers/pay{k}.py",), ("c{k}/readme.txt",), ("c{k}/web/old/shop{k}/urls.py",), ("x{k}.py",)]), "units": ("root string, profile string", [("c{k}", "default"), ("c{k}/web", "next_app_router"), ("c{k}/web/old", "django"), ("c{k}/api", "fastapi_family")])},
    anchors.composite_roles,
    "path unit profile role feature",
    [
        ("c{k}/web/app/cart{k}/page.tsx", "c{k}/web", "next_app_router", "page", "cart{k}"), ("c{k}/api/routers/pay{k}.py", "c{k}/api", "fastapi_family", "api", "pay{k}"), ("c{k}/readme.txt", "c{k}", "default", "other", None),
        ("c{k}/web/old/shop{k}/urls.py", "c{k}/web/old", "django", "urls", "shop{k}"), ("x{k}.py", None, "default", "other", None),
    ],
)
once(
    "profile_scores",
    {"files": (PATHS, ["app/page.tsx", "app/a/page.tsx", "main.py", "x.txt"])},
    anchors.profile_scores,
    "profile score",
    [("default", 0.01), ("next_app_router", 0.5), ("next_pages_react", 0.0), ("react_router_framework", 0.0), ("fastapi_family", 0.25), ("django", 0.0)],
)
