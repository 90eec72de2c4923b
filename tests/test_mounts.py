import pytest

from histora.sources import mounts


@pytest.fixture(autouse=True)
def checkpoints(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def routes(spark, files):
    found = mounts.mounted_routes(spark.createDataFrame(list(files.items()), "path string, text string")).collect()
    return sorted((r["path"], r["method"], r["pattern"], r["depth"]) for r in found)


def test_express_three_deep(spark):
    files = {
        "src/app.js": "const express = require('express');\nconst app = express();\nconst api = require('./routes');\napp.use('/api', auth, api);\napp.use(cors());\napp.get('/health', h);\napp.use('/lazy', require('./lazy'));",
        "src/routes/index.js": "const { Router } = require('express');\nconst router = Router();\nrouter.use('/v1', require('./v1').router);\nimport users, { adminRouter as admin } from './users';\nrouter.use('/users', users);\nrouter.use('/users/admin', admin);\nmodule.exports = router;",
        "src/routes/users.ts": "import { Router } from 'express';\nconst users = Router();\nusers.get('/:id', h);\nusers.route('/').get(h).post(check(a, b), h);\nexport const adminRouter = Router();\nadminRouter.delete('/all', h);\nexport default users;",
        "src/lazy.js": "const router = express.Router();\n// router.get('/no', h)\nrouter.get('/x', h);\nmodule.exports = router;",
        "src/alone.js": "const solo = express.Router();\nsolo.get('/solo', h); cache.get('/no');",
    }
    assert routes(spark, files) == sorted(
        [("src/app.js", "GET", "/health", 0), ("src/routes/users.ts", "GET", "/api/users/:id", 2), ("src/routes/users.ts", "GET", "/api/users", 2), ("src/routes/users.ts", "POST", "/api/users", 2), ("src/routes/users.ts", "DELETE", "/api/users/admin/all", 2), ("src/lazy.js", "GET", "/lazy/x", 1), ("src/alone.js", "GET", "/solo", 0)]
    )


def test_express_barrels_two_ways_and_circles(spark):
    files = {
        "app.ts": "import express from 'express';\nimport * as all from './all';\nconst app = express();\napp.use('/a', all.items);\napp.use('/b', all.items);",
        "all/index.ts": "export { default as items } from './items';",
        "all/items.ts": "import { Router } from 'express';\nimport loop from './loop';\nconst r = Router();\nr.get('/x', h);\nr.use('/l', loop);\nexport default r;",
        "all/loop.ts": "import { Router } from 'express';\nimport items from './items';\nconst q = Router();\nq.use('/again', items);\nq.get('/y', h);\nexport default q;",
        "c1.ts": "import b from './c2';\nconst a = express.Router();\na.use('/b', b);\na.get('/never', h);\nexport default a;",
        "c2.ts": "import a from './c1';\nconst b = express.Router();\nb.use('/a', a);\nexport default b;",
    }
    assert routes(spark, files) == sorted([("all/items.ts", "GET", "/a/x", 1), ("all/items.ts", "GET", "/b/x", 1), ("all/loop.ts", "GET", "/a/l/y", 2), ("all/loop.ts", "GET", "/b/l/y", 2)])


def test_fastapi_three_deep(spark):
    files = {
        "app/main.py": "from fastapi import FastAPI\nfrom .api import api_router\nfrom app.extra.things import router as things\napp = FastAPI()\napp.include_router(api_router, prefix='/api')\napp.include_router(things)\n@app.get('/')\ndef home(): ...",
        "app/api/__init__.py": "from fastapi import APIRouter\nfrom .routers import users, items\napi_router = APIRouter(prefix=\"/v1\")\napi_router.include_router(users.router, prefix='/users', tags=['u'])\napi_router.include_router(items.router)",
        "app/api/routers/__init__.py": "",
        "app/api/routers/users.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/{uid}')\nasync def one(uid): ...\n@router.post('')\ndef new(): ...",
        "app/api/routers/items.py": "router = APIRouter(prefix='/items', tags=['i'])\n@router.get('/')\ndef all(): ...",
        "app/extra/things.py": "router = APIRouter(prefix='/things')\n@router.delete('/{t}')\ndef gone(t): ...",
    }
    assert routes(spark, files) == sorted(
        [("app/main.py", "GET", "/", 0), ("app/api/routers/users.py", "GET", "/api/v1/users/{uid}", 2), ("app/api/routers/users.py", "POST", "/api/v1/users", 2), ("app/api/routers/items.py", "GET", "/api/v1/items", 2), ("app/extra/things.py", "DELETE", "/things/{t}", 1)]
    )


def test_django_three_deep(spark):
    files = {
        "site/urls.py": "from django.urls import include, path\nurlpatterns = [\n  path('admin/', admin.site.urls),\n  path('shop/', include('shop.urls')),\n]",
        "shop/urls.py": "from rest_framework import routers\nrouter = routers.DefaultRouter()\nrouter.register(r'carts', CartViewSet)\nmore = [\n  path('late/', views.late),\n]\nurlpatterns = [\n  path('', views.home),\n  path('orders/', include(('shop.orders.urls', 'orders'))),\n  path('api/', include(router.urls)),\n  path('more/', include(more)),\n]",
        "shop/orders/urls.py": "urlpatterns = [\n  re_path(r'^(?P<pk>[0-9]+)/$', views.one),\n]",
    }
    assert routes(spark, files) == sorted(
        [("site/urls.py", "URL", "/admin", 0), ("shop/urls.py", "URL", "/shop", 1), ("shop/orders/urls.py", "URL", "/shop/orders/<pk>", 2), ("shop/urls.py", "REST", "/shop/api/carts", 2), ("shop/urls.py", "URL", "/shop/more/late", 2)]
    )


def test_rails_blocks(spark):
    text = "Rails.application.routes.draw do\n  get '/health', to: 'h#x'\n  namespace :admin do\n    scope '/v1' do\n      resources :posts do # nested\n        resources :comments, only: [:index]\n        get :preview\n      end\n    end\n    resource :profile\n  end\n  devise_for :users do\n    get 'in', to: 's#n'\n  end\n  scope path: '/files' do\n    post 'up' => 'f#u'\n  end\nend\n"
    got = [(m, p, d) for _, m, p, d in routes(spark, {"config/routes.rb": text, "lib/x.rb": "get '/no'"})]
    assert sorted(got) == sorted(
        [("GET", "/health", 1), ("RESOURCES", "/admin/v1/posts", 3), ("RESOURCE", "/admin/v1/posts/:id", 3), ("RESOURCES", "/admin/v1/posts/:post_id/comments", 4), ("RESOURCE", "/admin/v1/posts/:post_id/comments/:id", 4), ("GET", "/admin/v1/posts/:post_id/preview", 4), ("RESOURCE", "/admin/profile", 2), ("GET", "/in", 1), ("POST", "/files/up", 2)]
    )


def test_nothing_to_read(spark):
    assert routes(spark, {"a.ts": "", "b.py": "def (", "c.txt": "app.get('/x')", "d.js": "app.use('/x'"}) == []
