"""The log and the graph as committed tables."""

import pytest
from pyspark.sql import functions as F

from assetgraph.operators import gaps
from assetgraph.sources import commits, events

NEW = "ts string, run_id string, kind string, payload string, cycle int, actor string, idempotency_key string"


def batch(spark, *keys):
    return spark.createDataFrame([(f"2026-01-0{1 + k % 9}", "r", "node_upserted", "{}", 0, "a", f"k{k}") for k in keys], NEW)


def test_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert commits.read_log(spark, path).count() == 0
    commits.commit_events(batch(spark, 1, 2, 3), path, "b0")
    commits.commit_events(batch(spark, 1, 2, 3), path, "b0")  # the same batch again
    log = commits.commit_events(batch(spark, 3, 4), path, "b1")  # a key that is there
    assert sorted((r.seq, r.idempotency_key) for r in log.collect()) == [(0, "k1"), (1, "k2"), (2, "k3"), (3, "k4")]
    assert commits.commit_events(batch(spark, 4), path, "b2").count() == 4


def test_a_second_writer_numbers_anew(spark, tmp_path, monkeypatch):
    path, claim = str(tmp_path / "log"), commits._claim

    def late(session, folder, number, record):
        if record["batch_id"] == "slow" and number == 0:
            monkeypatch.setattr(commits, "_claim", claim)
            commits.commit_events(batch(spark, 1, 2), path, "fast")  # between its reading and its record
        return claim(session, folder, number, record)

    monkeypatch.setattr(commits, "_claim", late)
    log = commits.commit_events(batch(spark, 2, 3), path, "slow")
    assert sorted((r.seq, r.idempotency_key) for r in log.collect()) == [(0, "k1"), (1, "k2"), (2, "k3")]


def test_data_without_a_record_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    commits.commit_events(batch(spark, 1), path, "b0")

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits, "_claim", crash)
        with pytest.raises(KeyboardInterrupt):
            commits.commit_events(batch(spark, 2), path, "b1")
    assert commits.read_log(spark, path).count() == 1
    assert sorted(r.seq for r in commits.commit_events(batch(spark, 2), path, "b1").collect()) == [0, 1]


def test_unknown_kinds_fail_and_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(Exception, match="unknown event kind"):
        commits.commit_events(batch(spark, 1).withColumn("kind", F.lit("nope")), path, "b0")
    assert commits.read_log(spark, path).count() == 0


def test_flags_of_a_published_graph_move_no_nodes(spark, tmp_path):
    path = str(tmp_path / "graph")
    cover = F.create_map(F.lit("enumerated"), F.col("id") % 2 == 0)
    nodes = spark.range(200).select(F.concat(F.lit("dns:h"), "id").alias("id"), F.lit("DNSName").alias("type"), F.create_map().cast("map<string,string>").alias("attrs"), cover.alias("coverage"))
    nodes = nodes.unionByName(nodes.limit(0).unionByName(spark.range(3).select(F.concat(F.lit("web:https://h"), "id").alias("id"), F.lit("WebApp").alias("type"), F.create_map().cast("map<string,string>").alias("attrs"), cover.alias("coverage"))))
    edges = spark.range(50).select(F.lit("resolves_to").alias("type"), F.concat(F.lit("dns:h"), "id").alias("frm"), F.lit("host:1").alias("to"))
    with pytest.raises(FileNotFoundError):
        commits.read_graph(spark, path)
    commits.publish_graph(nodes.limit(1), edges, path)
    version = commits.publish_graph(nodes, edges, path)
    for name in ("nodes", "edges"):
        spark.sql(f"DROP TABLE graph_{name}_{version}")  # as in a session that did not write them; the files stay
    kept = commits.read_graph(spark, path)
    read = lambda df: sorted((r.id, sorted(r.flags)) for r in df.collect())
    plain = read(gaps.with_flags(nodes, edges))
    found = gaps.with_flags(*kept)
    assert read(found) == plain and len(plain) == 203
    assert sum("no_webapp" not in f for i, f in plain if i.startswith("dns:")) == 3 and sum("not_resolved" not in f for i, f in plain) == 50
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = gaps.with_flags(*kept)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in plan.split("\n") if "Exchange" in line and "attrs" in line]
    assert "SortMergeJoin" in plan and not moved
    top = plan[plan.index("SortMergeJoin"):].split("\n")
    assert "Bucketed: true" in plan and not any("Exchange" in line for line in top[1:4])
