import json
import time

import pytest
from pyspark.sql import functions as F

from catalens.operators import collect, ddl, dictionary, validate
from catalens.sources import documents, sinks
from catalens.sources.fixture import facts
from catalens.streaming import snapshots

CONFIRMED = "# kept by hand\n- source: shop.order_items.order_id\n  target: shop.orders.id\n- source: shop.gone.x_id\n  target: shop.users.id\n- source: shop.orders.user_id\n  target: shop.users.id\n  ignore: true\n- source: bad\n"


@pytest.fixture(scope="module")
def text(spark):
    return collect.document(facts(spark)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]


def files(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_run_twice_changes_nothing(spark, text, tmp_path):
    first = dictionary.run(spark, text, str(tmp_path), CONFIRMED)
    before = files(tmp_path)
    again = dictionary.run(spark, text, str(tmp_path), CONFIRMED)
    assert again["written"] == [] and again["deleted"] == [] and files(tmp_path) == before
    assert first["schemas"] == ["shop", "shop_ext"] and len(first["warnings"]) == 2
    orders = (tmp_path / "shop/tables/orders.sql").read_text()
    assert "CREATE SEQUENCE IF NOT EXISTS shop.order_seq;" in orders and "ADD CONSTRAINT orders_user_fk FOREIGN KEY (user_id)" in orders
    assert "-- calls ../functions/fmt.sql" in orders
    pending = (tmp_path / "_pending.sql").read_text()
    assert pending == "COMMENT ON COLUMN shop.order_items.order_id IS '逻辑关联 shop.orders.id';\n"
    found = (tmp_path / "_candidates.yaml").read_text()
    assert "shop.order_items.product_id" in found and "shop.orders.user_id" not in found and "shop_ext.widgets.order_id" in found
    assert not (tmp_path / "shop/tables/events_2026_08.sql").exists() and (tmp_path / "shop/tables/events_2026_08_a.sql").exists()


def test_notes_survive_and_what_is_gone_goes(spark, text, tmp_path):
    dictionary.run(spark, text, str(tmp_path))
    kept, plain = tmp_path / "shop/tables/orders.sql", tmp_path / "shop/tables/products.sql"
    kept.write_text(kept.read_text() + "-- by hand\n")
    doc = json.loads(text)
    for s in doc["schemas"]:
        s["tables"] = [t for t in s["tables"] if t["name"] not in ("orders", "products")]
    dictionary.run(spark, json.dumps(doc), str(tmp_path))
    assert not plain.exists() and "-- by hand" in kept.read_text() and sinks.GONE in kept.read_text() and "CREATE TABLE" not in kept.read_text()
    dictionary.run(spark, text, str(tmp_path))
    assert "-- by hand" in kept.read_text() and sinks.GONE not in kept.read_text() and "CREATE TABLE" in kept.read_text()
    doc["requested_schemas"], doc["schemas"] = ["shop", "shop_ext"], [s for s in doc["schemas"] if s["schema"] == "shop_ext"]
    dictionary.run(spark, json.dumps(doc), str(tmp_path))
    assert [p.name for p in (tmp_path / "shop").rglob("*") if p.is_file()] == ["orders.sql"]


def test_ddl_text(spark):
    p = dictionary.parts_of(facts(spark))
    table = {r["name"]: r["ddl"] for r in ddl.table_ddl(p).collect()}
    assert 'CREATE SEQUENCE IF NOT EXISTS shop."Odd seq";' in table["dialled_meters"]
    assert "WITH (autovacuum_enabled='false', fillfactor='70')" in table["dialled_meters"] and "ALTER INDEX shop.dialled_meters_pkey SET TABLESPACE fast_disk;\nALTER INDEX shop.dialled_meters_pkey SET (fillfactor='80');" in table["dialled_meters"]
    assert "USING columnar" in table["order_items"] and "TABLESPACE fast_disk" in table["payments"]
    assert "PARTITION BY RANGE (occurred_at)" in table["events"] and "-- partitions (1): events_2026_08" in table["events"] and "--   constraint events_local_check" in table["events"]
    assert "ALTER TABLE shop.metrics DISABLE TRIGGER metrics_touch;" in table["metrics"] and "metrics_name_key ON" not in table["metrics"] and "metrics_broken_idx" not in table["metrics"]
    assert "CREATE FOREIGN TABLE shop.remote_items" in table["remote_items"] and "OPTIONS (column_name 'tok')" in table["remote_items"] and "SERVER warehouse OPTIONS (table_name 'items', note 'it''s')" in table["remote_items"]
    assert "IS 'product''s name';" in table["products"]
    view = {r["name"]: r["ddl"] for r in ddl.view_ddl(p["views"], p["view_columns"], p["view_indexes"]).collect()}
    assert view["fenced_members"].startswith("CREATE VIEW shop.fenced_members WITH (security_barrier='true') AS\n")
    assert "WITH NO DATA;\nCREATE UNIQUE INDEX unfilled_sales_id_key" in view["unfilled_sales"] and "TABLESPACE fast_disk" in view["late_sales"]
    fn = {(r["name"], r["identity_args"]): r["ddl"] for r in ddl.function_ddl(p["functions"], p["triggers"]).collect()}
    assert "COMMENT ON FUNCTION shop.noop_trigger() IS 'Does nothing';" in fn["noop_trigger", ""] and fn["plain_fn", "x integer"].endswith("-- (none)\n")


def test_documents_fail_loudly(spark, text):
    for bad in ("", "no json", '{"collect_version": 2, "schemas": []}', '{"collect_version": 1}'):
        with pytest.raises(documents.DocumentInvalid):
            documents.parse(spark, bad)
    doc = json.loads(text)
    doc["schemas"][0]["tables"][0]["name"] = ".."
    doc["schemas"][0]["tables"][1]["comment"] = "x\n--} catalens table:a\ny"
    doc["schemas"][0]["tables"].append({**doc["schemas"][0]["tables"][2], "name": doc["schemas"][0]["tables"][2]["name"].upper(), "options": ["a)b=1"], "tablespace": "", "access_method": "", "kind": "foreign_table"})
    doc["schemas"][0]["functions"][0]["definition"] = ""
    p = documents.parts(documents.parse(spark, json.dumps(doc)))
    rules = {r["rule"] for r in validate.violations(p, ["shop_ext"]).collect()}
    assert rules >= {"identifier", "marker", "case", "option", "tablespace", "access_method", "foreign", "definition", "scope"}
    with pytest.raises(validate.CatalogInvalid):
        validate.check(p)


def test_sources(spark, tmp_path):
    assert documents.settings("PGPORT=1\n# note\nPGPORT=2\nOTHER=x\n")["PGPORT"] == "2"
    with pytest.raises(ValueError):
        documents.settings("nonsense")
    assert documents.scope([], " a, ,b ") == ["a", "b"] and documents.scope(["x"], "a") == ["x"]
    rows, warnings = documents.confirmed(spark, "[]")
    assert rows.count() == 0 and not warnings
    rows, warnings = documents.confirmed(spark, "what is this")
    assert rows.count() == 0 and len(warnings) == 1
    (tmp_path / "s/tables").mkdir(parents=True)
    (tmp_path / "s/views").mkdir()
    (tmp_path / "s/tables/t.sql").write_text('CREATE TABLE s.t (\n  id bigint NOT NULL,\n  "Odd" text\n);\n')
    (tmp_path / "s/views/v.sql").write_text("CREATE VIEW s.v AS SELECT 1;\n")
    assert {tuple(r) for r in documents.names_from_files(spark, str(tmp_path)).collect()} == {("s", "t", "id"), ("s", "t", "Odd"), ("s", "v", None)}
    spark.range(1).createOrReplaceTempView("spark_side")
    assert documents.spark_catalog(spark)["columns"].filter("table = 'spark_side'").count() == 1


def test_blocks_keep_their_order():
    old = sinks.merged(None, "-- head\n", {"a": "1\n", "c": "3\n"}) + "-- mine\n"
    new = sinks.merged(old, "-- head\n", {"a": "1\n", "b": "2\n", "c": "4\n", "d": "5\n"})
    assert [new.index(f"--{{ catalens {k}\n") for k in "abcd"] == sorted(new.index(f"--{{ catalens {k}\n") for k in "abcd")
    assert "-- mine\n" in new and "3\n" not in new


def test_results_as_files(tmp_path):
    a, b = sinks.claim(tmp_path, "SELECT 1", "csv"), sinks.claim(tmp_path, "SELECT 1", "csv")
    assert "e004ebd5" in a.name and (b.name.endswith("-2.csv") or a.name != b.name)
    assert sinks.csv_text(["a", "b"], [(None, ""), (1, "x\ny")]) == 'a,b\n,""\n1,"x\ny"\n'
    assert sinks.redact("pw=abc", ["abc", ""]) == "pw=[REDACTED]"
    assert sinks.preview("f.csv", "h\n" + "x\n" * 30, True).count("x") == 19


def test_stream_of_documents(spark, text, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(text)
    query = snapshots.keep(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert (tmp_path / "out/shop/tables/orders.sql").exists()


def test_timing_out_is_cancelled(spark):
    from catalens.plans import session

    began = time.monotonic()
    with pytest.raises(Exception):
        session.fetch(session.query(spark, "SELECT count(*) FROM (SELECT id FROM range(100000000000)) x WHERE id % 7 = sqrt(id)", no_limit=True), timeout_s=2)
    assert time.monotonic() - began < 60
