"""What must not grow faster than the input: how often rows are moved and read."""

import random

import pytest
from pyspark.sql import functions as F

from assetgraph.operators import fold, observe
from assetgraph.plans import queries as Q
from assetgraph.sources import events, shared


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sights(spark, n, ids):
    rows = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("host:"), (F.col("id") % ids).cast("string")).alias("id"), F.lit("Host").alias("type"), (F.col("id") % 7).cast("string").alias("tool"), F.lit("r").alias("rule_id"), F.col("id").cast("string").alias("ts"))
    return fold.full(rows.withColumn("attrs", F.create_map(F.lit("k"), F.lit("1")))).withColumn("fork", F.lit(0))


def test_merge_moves_each_row_once(spark):
    plan = plan_of(fold.merge(sights(spark, 100, 50)))
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_merge_in_parts_gives_the_same(spark):
    whole = fold.merge(sights(spark, 4000, 2)).select("id", "attrs", "chain", "sources", "log_odds", "observations", "seq", "last_seq", "last_seen").orderBy("id").collect()
    assert [(r.id, r.observations, r.seq, r.last_seq, r.last_seen, len(r.sources), round(r.log_odds, 6)) for r in whole] == [("host:0", 2000, 0, 3998, "3998", 7, 4.8), ("host:1", 2000, 1, 3999, "3999", 7, 4.8)]
    assert [s.tool for s in whole[0].chain] == ["0", "2", "4", "6", "1", "3", "5"]


def test_a_payload_is_read_once(spark):
    node = '{"node":{"id":"a","type":"T","attrs":{"n":1,"s":"1","l":[1]},"coverage":{"x":true},"confidence":{"log_odds":0.5}}}'
    log = spark.createDataFrame([(1, "node_upserted", node), (2, "node_upserted", '{"id":5}'), (3, "edge_upserted", "broken")], "seq long, kind string, payload string")
    seen, _, skipped = fold.read_observations(log)
    assert [(r.seq, r.id, r.attrs, r.log_odds) for r in seen.collect()] == [(1, "a", {"n": "1", "s": '"1"', "l": "[1]"}, 0.5)]
    assert sorted(r.seq for r in skipped.collect()) == [2, 3]
    assert "get_json_object" not in plan_of(seen)


def test_bindings_do_not_fold_twice(spark, tmp_path):
    obs = sights(spark, 20, 4).drop("fork").withColumn("kind", F.lit("node"))
    obs.write.parquet(str(tmp_path / "obs"))
    new = spark.createDataFrame([(99, "host:1", ("out_of_scope", "s", "t", "r"))], "seq long, id string, binding struct<verdict:string,snapshot_id:string,observed_at:string,rule_matched:string>")
    graph = fold.project_graph(spark.read.parquet(str(tmp_path / "obs")), new)
    assert plan_of(graph).count("FileScan parquet") <= 2
    assert {r.id: r.verdict for r in graph.collect()} == {"host:0": None, "host:1": "out_of_scope", "host:2": None, "host:3": None}


def test_events_are_encoded_once(spark):
    run = observe.Run("r", "2026-01-01 00:00:00", "snap:1")
    obs = observe.stamped(observe.nodes(spark.range(5), "Host", F.concat(F.lit("host:"), F.col("id").cast("string")), 0.0), observe.Source("t"), run)
    plan = plan_of(observe.as_events(obs, run))
    assert "Range (" not in plan and "FileScan parquet" in plan


def test_line_items_are_grouped_by_numbers(spark):
    nodes, _ = Q.customer_graph(spark, "/root/testdata/sf0.001")
    assert "keys=[l_orderkey" in plan_of(nodes)


def test_documents_are_dealt_out_before_they_are_read(spark):
    from assetgraph.operators import contracts

    specs = spark.createDataFrame([("https://a.example.com/openapi.json", '{"openapi":"3.0.0","paths":{"/x":{"get":{}}}}')], "url string, body string")
    found = contracts.contract_operations(specs)
    assert "REPARTITION_BY_NUM" in plan_of(found)
    assert [(r.template, r.method) for r in found.collect()] == [("/x", "GET")]


def test_a_host_is_named_once(spark):
    from assetgraph.functions import urls as U

    rows = spark.createDataFrame([("u:p@[2001:db8::1]:443",), ("https://A.example.com:443/x",), ("[a:b]",), (None,)], "v string")
    thrice = rows.select(U.canonical_host(U.canonical_host(U.canonical_host(F.col("v")))).alias("h"))
    assert thrice._jdf.queryExecution().analyzed().toString().count("coalesce(") == 3
    assert [r.h for r in rows.select(U.canonical_host(F.col("v")).alias("h")).collect()] == ["2001:db8::1", "a.example.com", "a:b", ""]


def test_names_and_seeds_are_read_once(spark):
    from assetgraph.operators import extract, scope

    rules = scope.scope_rules(spark, ["*.example.com"])
    body = '[{"name_value":"a.example.com\\n*.a.example.com"},{"name_value":"a.example.com"}]'
    hosts = extract._ct_hosts(spark.createDataFrame([("example.com", body)], "apex string, body string"))
    assert "from_json" not in plan_of(hosts) and [tuple(r) for r in hosts.collect()] == [("a.example.com", "example.com")]
    seeds = spark.createDataFrame([("*.b.example.com",), ("b.example.com",), ("b.example.com ",)], "value string")
    bound = extract.ingest_seeds(seeds, rules)
    assert "collect_set(spelling" not in plan_of(bound) and [(r.canonical, r.wildcard, r.spellings) for r in bound.collect()] == [("b.example.com", True, ["*.b.example.com", "b.example.com"])]


def test_archived_urls_are_read_once(spark):
    from assetgraph.functions import urls as U
    from assetgraph.operators import extract

    captures = spark.createDataFrame([("https://a.example.com/x/12?q=1", "20200101000000"), ("https://a.example.com/x/13", "20190101000000")], "original string, timestamp string")
    found = extract.earliest_captures(captures)
    assert "original" not in plan_of(found)
    assert sorted((r.type, r.template, r.archived_timestamp) for r in found.collect()) == [("Route", "/x/{id}", "20190101000000"), ("WebApp", "", "20190101000000")]
    assert captures.select(U.archived_url(F.col("original")).alias("u"))._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_forks_are_neither_aggregated_nor_joined_back(spark):
    forks = Q.graph_forks(spark, "/root/testdata/sf0.001")
    plan = plan_of(forks)
    assert "collect_list" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    base = plan_of(Q.graph_project(spark, "/root/testdata/sf0.001"))
    assert base.count("FileScan parquet [event_id") == 1


def clashing(spark, n, keys=1, seqs=None, kinds=("node",)):
    """Rows with all columns, of which most contradict."""
    draw = random.Random(n + keys)
    values, hashes = ['"x"', '"y"', '"z"', '""', "1", "1.0", "true", "[1]", "null"], ["p", "q", None]
    step = lambda: ("e" + draw.choice("12"), draw.choice("tuv"), "1", "r", "1", "c")
    rows = [
        (
            None if draw.random() < 0.001 and seqs else k % seqs if seqs else k, draw.choice(kinds), draw.choice(["hot", "hot", f"n{draw.randrange(20)}", None if draw.random() < 0.05 else "m"]), {f"a{draw.randrange(keys)}": draw.choice(values[:6]) for _ in range(draw.randrange(1, keys + 1))} | ({"l": "[%d]" % k} if draw.random() < 0.1 else {}),
            [step() for _ in range(draw.randrange(4))], draw.choice([None, [], [(draw.choice(hashes), "eu", True) for _ in range(3)]]), draw.choice([None, {"b": draw.choice([True, False, None]), "a": True}]), str(k), draw.choice([None, "f"]), float(k % 3),
        )
        for k in draw.sample(range(9 * n), n)
    ]
    rows = spark.createDataFrame(rows, f"seq long, kind string, id string, attrs map<string,string>, chain array<{fold.STEP}>, evidence array<{fold.PROOF}>, coverage map<string,boolean>, ts string, forked_from string, log_odds double")
    return rows.repartition(5).withColumn("type", F.lit("Host"))


@pytest.mark.parametrize(("keys", "light", "seqs", "dense"), [(1, 1 << 16, None, True), (2, 1 << 16, None, True), (1, 100, None, True), (4, 100, None, True), (1, 1 << 16, 150, False)])
def test_windows_and_single_forks_give_the_same_graph(spark, monkeypatch, tmp_path, keys, light, seqs, dense):
    clashing(spark, 500, keys, seqs, ("node", "edge")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(fold, "LIGHT", light)
    by = ("kind", "id")
    told, alone = fold.told_apart(fold.full(rows), by)
    assert alone == dense
    shown = lambda df: sorted(map(repr, df.withColumns({c: F.map_entries(c) for c in ("attrs", "coverage")}).collect()))
    want = fold.numbered(fold.full(rows), by)
    assert shown(told.select("seq", *by, "fork", "attrs", "coverage")) == shown(want.select("seq", *by, "fork", "attrs", "coverage"))
    assert want.where("fork > 0").count() > 100
    got = fold._data(told.where("kind = 'node'"), fold.full(rows).where("kind = 'node'"), alone)
    old = fold.merge(want.where("kind = 'node'"))
    assert got.columns == old.columns and got.dtypes == old.dtypes and shown(got) == shown(old)


@pytest.mark.parametrize("keys", [1, 4])
def test_ids_of_one_row_are_told_apart_from_the_others(spark, monkeypatch, tmp_path, keys):
    alone = clashing(spark, 60, keys, None, ("node", "edge")).withColumns({"id": F.concat(F.lit("one"), "seq"), "seq": F.col("seq") + 10000})
    alone.unionByName(clashing(spark, 200, keys, None, ("node", "edge"))).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    new = spark.createDataFrame([(99999, k, ("out_of_scope", "s", "t", "r")) for k in ("hot", "n1", "one0")], "seq long, id string, binding struct<verdict:string,snapshot_id:string,observed_at:string,rule_matched:string>")
    shown = lambda df: sorted(map(repr, df.withColumns({c: F.map_entries(c) for c in ("attrs", "coverage")}).collect()))
    monkeypatch.setattr(shared, "SPARSE", 1 << 30)
    together = fold.project_graph(rows, new)
    monkeypatch.setattr(shared, "SPARSE", 0)
    apart = fold.project_graph(rows, new)
    assert apart.dtypes == together.dtypes and shown(apart) == shown(together)


def test_ids_of_one_row_are_not_moved(spark, tmp_path):
    sights(spark, 40, 40).drop("fork").withColumn("kind", F.lit("node")).write.parquet(str(tmp_path / "obs"))
    graph = fold.project_graph(spark.read.parquet(str(tmp_path / "obs")))
    assert "Exchange hashpartitioning" not in plan_of(graph) and graph.count() == 40


@pytest.mark.parametrize("sparse", [0, 8, 1 << 30])
def test_few_keys_that_come_twice_are_sought_apart(spark, monkeypatch, sparse):
    monkeypatch.setattr(shared, "SPARSE", sparse)
    event = lambda n, key, payload: (n, "2026", "r", "node_upserted", payload, 0, "a", key)
    log = spark.createDataFrame([event(5, "k7", "p")], events.EVENT)
    new = [event(0, f"k{n}", "p") for n in range(40)] + [event(0, "k3", "a"), event(0, "", "x"), event(0, "", "x"), event(0, None, "y")]
    got = events.append_events(spark.createDataFrame(new, events.EVENT).drop("seq"), log)
    assert sorted(r.seq for r in got.collect()) == list(range(6, 48))
    assert sorted((r.idempotency_key or "", r.payload) for r in got.collect()) == sorted([(f"k{n}", "a" if n == 3 else "p") for n in range(40) if n != 7] + [("", "x"), ("", "x"), ("", "y")])


def test_a_log_leaves_no_table_of_its_runs_behind(spark, monkeypatch, tmp_path):
    from assetgraph.operators import scope

    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    seeds = spark.createDataFrame([("a.example.com",), ("b.example.com",)], "value string")
    rules = scope.scope_rules(spark, ["*.example.com"])
    nodes, _ = Q.node_gaps(Q.logged(spark, ("seeds", seeds, rules), ("seeds", seeds, rules)))
    assert not {"log", "events", "appended", "observations", "sights"} & {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert nodes.where("id = 'dns:a.example.com'").count() == 1
    # tables that written() did not make stay
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    shared.discard(spark.read.parquet(str(tmp_path / "mine")))
    assert spark.read.parquet(str(tmp_path / "mine")).count() == 3
