"""What keeps jobs in proportion to their input: folders, files, Python processes, parses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalogue import streams
from mimicry.operators import verdicts as v
from mimicry.operators.scoring import host_forms
from mimicry.sources import files
from mimicry.sources.ct import parse_messages
from mimicry.sources.keyed import FOLDER, FOLDER_ROWS, KeyedStore
from mimicry.staging import Tables, as_verdicts


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_few_rows_share_a_folder(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, f"{tmp_path}/s", "k string, n bigint", ("k",), fan=2, part_rows=1)
    for batch in range(2):
        rows = spark.range(300).select(F.concat(F.lit(f"{batch}-"), "id").alias("k"), F.col("id").alias("n"))
        store.add(rows, batch)
    store.merge(2)
    (run,) = store.runs()
    assert run.parts == 1024
    folders = [n for n in files.subfolders(spark, store._path(run)) if "=" in n]
    assert folders == [f"{FOLDER}=1-0"]
    asked = spark.createDataFrame([("1-7", 0), ("none", 0)], "k string, n bigint")
    assert store.stored_keys(asked).count() <= 10
    assert [r.k for r in store.absent(asked.persist()).collect()] == ["none"]
    assert store.rows().count() == 600 and FOLDER_ROWS > 600


def test_a_look_up_lists_the_folders_of_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mimicry.sources.keyed.FOLDER_ROWS", 50)
    store = KeyedStore(spark, f"{tmp_path}/s", "k string, n bigint", ("k",), fan=2, part_rows=10)
    keys = [f"{i}" for i in range(400)]
    for batch in range(2):
        store.add(spark.createDataFrame([(k, batch) for k in keys[batch::2]], "k string, n bigint"), batch)
    store.merge(2)
    (run,) = store.runs()
    names = [n for n in files.subfolders(spark, store._path(run)) if "=" in n]
    assert run.parts == 64 and sorted(names) == [f"{FOLDER}=8-{i}" for i in range(8)]
    asked = spark.createDataFrame([(k, 0) for k in (*keys, "none", "x")], "k string, n bigint").persist()
    assert {r.k for r in store.absent(asked).collect()} == {"none", "x"}
    one = spark.createDataFrame([("7", 0)], "k string, n bigint")
    (place,) = [r[0] for r in one.select(store._place(8)).collect()]
    plan = store.stored_keys(one)._jdf.queryExecution().executedPlan().toString()
    assert f"= 8-{place})" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "7" in {r.k for r in store.stored_keys(one).collect()}


def orders(spark, folder, keys):
    rows = [(k, 1 + (k or 0) % 45, "O", datetime(2024, 1, 1 + (k or 0) % 28), "1-URGENT") for k in keys]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/orders.parquet")
    return Tables(spark, str(folder))


def test_message_files_grow_with_the_messages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    t = orders(spark, tmp_path / "given", range(240))
    out = f"{tmp_path}/out"
    assert streams.message_files(t, 3, out) == 8
    told = []
    for batch in range(3):
        written = sorted((tmp_path / "out" / "messages" / str(batch)).glob("part-*"))
        assert len(written) == 8
        told += [line for f in written for line in f.read_text().splitlines()]
    assert told == [r.value for r in t.messages.orderBy("line_no").select("value").collect()]
    assert files.subfolders(spark, out) == ["messages"]


def test_verdicts_are_grouped_before_their_orders_join(spark, tmp_path):
    t = orders(spark, tmp_path, [1, 2, 2, 3, None, 9])
    spark.createDataFrame([(2, 50, "O", datetime(2024, 1, 1), None)], spark.read.parquet(f"{tmp_path}/orders.parquet").schema
                          ).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    lines = [
        (k, n, q, 0.01 * (q % 11), f, datetime(2024, 2, 1 + q % 20))
        for k, n, q, f in [(1, 1, 5, "A"), (1, 1, 9, "N"), (2, 1, 7, None), (2, 2, 8, "R"), (2, None, 3, "A"),
                           (3, 4, 10, "N"), (None, 1, 4, "A"), (77, 1, 6, "A"), (9, 7, 12, "R")]
    ]
    schema = "l_orderkey bigint, l_linenumber int, l_quantity int, l_discount double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).withColumn("l_quantity", F.col("l_quantity").cast("double")).write.parquet(
        f"{tmp_path}/lineitem.parquet"
    )
    by_sql = as_verdicts(t.staged("verdicts"))
    assert t.verdicts.schema.simpleString() == by_sql.schema.simpleString()
    assert sorted(map(str, t.verdicts.collect())) == sorted(map(str, by_sql.collect()))
    plan = optimized(t.verdicts)
    assert plan.index("Join") < plan.index("Aggregate")


def test_each_reply_field_is_looked_up_once(spark):
    replies = spark.createDataFrame([(1, '} {"label": {"a": 1}} x')], "n int, reply string")
    parsed = v.parse_replies(replies)
    assert optimized(parsed).count("try_variant_get(") <= 9
    assert parsed.columns == ["n", "reply", "error", "verdict"]


def test_braces_in_any_order(spark):
    texts = ["", "}", "{", "}{", "{}", "a{b}c}d", "}{x}{", "ä{é}ü", "{" * 5, "x}y{z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(v._braced(F.col("t")).alias("new"), F.nullif(F.regexp_extract("t", r"(?s)(\{.*\})", 1), F.lit("")).alias("old"))
    assert all(r.new == r.old for r in both.collect())


def test_a_message_is_parsed_twice_at_most(spark):
    messages = spark.createDataFrame([("{}",)], "value string")
    plan = optimized(parse_messages(messages))
    assert plan.count("from_json(") == 1 and plan.count("missing data") == 1


def test_one_python_process_folds_both_parts_of_a_host(spark):
    hosts = spark.createDataFrame([("xn--pypal-4ve.com",), ("münchen.paypäl.de",), ("a.xn--pypal-4ve.co.uk",), ("a.com",)], "fqdn string")
    forms = host_forms(hosts)
    assert forms._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    got = {r.fqdn: (r.label_raw, r.subdomain_raw, r.label_sk, r.subdomain_sk) for r in forms.collect()}
    assert got["xn--pypal-4ve.com"][:1] + got["xn--pypal-4ve.com"][2:3] == ("pаypal", "paypal")
    assert got["münchen.paypäl.de"] == ("paypäl", "münchen", "paypal", "munchen")
    assert got["a.xn--pypal-4ve.co.uk"][1:3] == ("a", "paypal") and got["a.com"][0] == "a"
