import pytest
from pyspark.sql import functions as F

from histora.operators import seeding


@pytest.fixture(autouse=True)
def checkpoints(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


SCHEMA = "flow string, feature string, entry string, paths array<string>, domain string, trigger string, artifact boolean, pos int"


def judged(spark, *flows, hubs=None, vendors=None):
    rows = [(*f, *[None] * (7 - len(f)), i) if len(f) == 7 else (f[0], f[1], f[2], None, *f[3:], *[None] * (6 - len(f)), i) for i, f in enumerate(flows)]
    named = lambda rows, schema: None if rows is None else spark.createDataFrame(rows, schema)
    out = seeding.seeds(spark.createDataFrame(rows, SCHEMA), named(hubs, "dir string, key string"), named(vendors, "token string")).collect()
    return {(r["flow"], r["feature"]): (r["rule"], r["domain"], r["resource"], r["intent"], r["space"]) for r in out}


def test_domains_by_signal(spark):
    cases = [
        ("a/routers/v1_investigations.py", ["b/tasks/x.py"], "Label", "f", "investigation"), ("a/routers/__init__.py", ["b/tasks/sync_jobs.py"], "Label", "f", "sync_job"), ("x.ts", [], "Organizations-&-multi-team management", "f", "organization"),
        ("x.ts", [], "cal.com atoms – embeddable", "f", "atom"), ("x.ts", [], "REST API keys", "f", "key"), ("web/src/modules/network-security/p.tsx", [], None, "f", "network_security"), ("m/modules/utils/p.tsx", ["services/billing/x.go"], None, "f", "billing"),
        (None, ["src/cases/a.ts"], None, "f", "case"), ("", None, " ", "test-api-v2-detectors", "detector"), (None, None, None, None, None), ("x/statuses.ts", None, None, "status", "status"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "entry string, paths array<string>, product string, feature string")
    assert [r["domain"] for r in seeding.flow_domain(df).collect()] == [c[4] for c in cases]


def test_words_and_packages(spark):
    domains = {
        "components_card": (True, False), "data_table": (True, False), "form_response": (False, False), "atom": (True, False), "calendar": (False, False), "x": (False, True), "42": (False, True), "v3": (False, True), "platform_util": (False, True), "api": (False, True), "billing": (False, False), None: (False, False), "": (False, False),
    }
    df = spark.createDataFrame([(d,) for d in domains], "d string").select("d", seeding.is_drawn_domain(F.col("d")).alias("a"), seeding.is_infra_domain(F.col("d")).alias("b"))
    assert {r["d"]: (r["a"], r["b"]) for r in df.collect()} == domains
    paths = {
        "packages/ui/components/form/index.ts": (True, False), "packages/platform/atoms/index.ts": (True, False), "features/calendars/components/Picker.tsx": (False, False), "packages/emails/send.ts": (False, True), "apps/web/lib/x.ts": (False, False), "lib/x.ts": (False, False), "x.ts": (False, False), None: (False, False), "packages/core/ui/a.ts": (True, False),
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", seeding.is_drawn(F.col("p")).alias("a"), seeding.is_infra_package(F.col("p")).alias("b"))
    assert {r["p"]: (r["a"], r["b"]) for r in df.collect()} == paths


def test_the_first_rule_that_holds_counts(spark):
    got = judged(
        spark,
        ("create-order-flow", "shop", "examples/shop/a.ts", "order"), ("list-orders-flow", "shop", "src/shop/a.ts", "order"), ("list-orders-flow", "shop", "later.ts", "other"), ("list-orders-flow", "admin", "src/admin/a.ts", "order"),
        ("open-dialog-flow", "ui", "packages/ui/dialog.tsx", None), ("open-dialog-flow", "book", "packages/ui/dialog.tsx", "booking"), ("show-table-flow", "t", "src/t.ts", "data_table"), ("send-mail-flow", "m", "packages/emails/send.ts", None), ("run-util-flow", "u", "src/u.ts", "platform_util"),
        ("run-nightly-flow", "cron", "api/cron/n.ts", "util", "scheduled"), ("run-billing-flow", "cron", "api/cron/b.ts", "billing", "queue"), ("laned-flow", "s", "src/s.ts", "s1", None, True),
    )
    assert got == {
        ("create-order-flow", "shop"): ("dev_artifact", None, None, None, None), ("list-orders-flow", "shop"): ("seed", "order", "order", "browse", "person"), ("list-orders-flow", "admin"): ("seed", "order", "order", "browse", "person"),
        ("open-dialog-flow", "ui"): ("ui_primitive", None, None, None, None), ("open-dialog-flow", "book"): ("seed", "booking", "dialog", "browse", "person"), ("show-table-flow", "t"): ("ui_primitive", None, None, None, None),
        ("send-mail-flow", "m"): ("infra_domain", None, None, None, None), ("run-util-flow", "u"): ("infra_domain", None, None, None, None), ("run-nightly-flow", "cron"): ("system", "nightly", "nightly", "execute", "system"),
        ("run-billing-flow", "cron"): ("system", "billing", "billing", "execute", "system"), ("laned-flow", "s"): ("dev_artifact", None, None, None, None),
    }


def test_many_small_siblings_are_integrations_and_a_few_large_ones_are_not(spark):
    small = [(f"connect-x{k}-flow", f"f{k}", f"packages/app-store/c{k}/api.ts", f"d{k}") for k in range(5)] + [("share-flow", "s", "packages/app-store/_utils/a.ts", "d")]
    large = [(f"view-y{k}-flow", "w", f"apps/{'web' if k % 2 else 'api'}/p{k}.ts", f"e{k}x") for k in range(20)]
    got = judged(spark, *small, *large)
    assert {v[0] for (f, _), v in got.items() if f.startswith(("connect", "share"))} == {"plugin"} and {v[1] for v in got.values() if v[0] == "plugin"} == {"integration"}
    assert {v[0] for (f, _), v in got.items() if f.startswith("view")} == {"seed"}


def test_vendors_under_a_hub(spark):
    flows = [("sync-alerts-flow", "a", "backend/services/edr/crowdstrike_client.py", None), ("list-hosts-flow", "b", "backend/services/edr/crowdstrike/hosts.py", None), ("list-hosts-flow", "c", "backend/services/edr/sentinel.py", None), ("run-base-flow", "d", "backend/services/edr/base.py", "x"), ("go-flow", "e", "backend/services/edr/crowdstrike_sentinel.py", None), ("out-flow", "f", "backend/services/edrx/a.py", "edrx")]
    got = judged(spark, *flows, hubs=[("backend/services", "services"), ("backend/services/edr", "edr")], vendors=[("crowdstrike",), ("sentinel",)])
    assert {k[1]: v[:3] for k, v in got.items()} == {
        "a": ("hub", "edr_crowdstrike", "crowdstrike"), "b": ("hub", "edr_crowdstrike", "crowdstrike"), "c": ("hub", "edr", "sentinel"), "d": ("hub", "edr", "base"), "e": ("hub", "edr", "item"), "f": ("hub", "service", "item"),
    }


def test_counts_and_no_flows(spark):
    seeded = seeding.seeds(spark.createDataFrame([("a-b-flow", "f", "x.ts", None, "order", None, None, 0), ("c-flow", "f", "demo/x.ts", None, "order", None, None, 1)], SCHEMA))
    assert {r["rule"]: r["flows"] for r in seeding.seeding_counts(seeded).collect()} == {"seed": 1, "dev_artifact": 1}
    assert [tuple(r) for r in seeding.seeded_journeys(seeded).collect()] == [("person", "order", "b", "other", 1, "a-b-flow")]
    assert seeding.seeds(spark.createDataFrame([], SCHEMA)).collect() == []
