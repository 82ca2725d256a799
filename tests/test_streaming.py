"""Streaming jobs over files that arrive one after the other."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from assetgraph.operators import audit, fold, report
from assetgraph.streaming import jobs

OBS = "seq long, id string, tool string, rule_id string, attrs map<string,string>"


def feed(spark, tmp_path, batches, schema, job, mode="append"):
    """The rows of job over a stream that reads one batch of rows at a time."""
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        (source / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
    out = []
    query = job(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: out.append(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive
    return out


def test_events_are_taken_once(spark, tmp_path):
    at = lambda k, key: {"ts": f"2026-01-01T00:00:{k:02d}Z", "idempotency_key": key}
    out = feed(spark, tmp_path, [[at(1, "a"), at(2, "a"), at(3, "b")], [at(4, "a"), at(5, "c")]], "ts timestamp, idempotency_key string", jobs.stream_dedupe)
    assert sorted(r.idempotency_key for rows in out for r in rows) == ["a", "b", "c"]


LOG = "seq long, ts string, run_id string, kind string, id string, type string, outcome string, decision string, code string, reason string, target string, source string"


def test_run_deltas_are_those_of_the_batch(spark, tmp_path):
    kinds = ["node_upserted", "edge_upserted", "contradiction_forked", "gap_dispatched", "gate_decision_recorded", "rate_debit", "third_party_debit", "invariant_violation", "loop_halted", "scope_drift_detected", "evidence_captured"]
    draw = random.Random(3)
    rows = [
        {"seq": k, "ts": f"2026-01-01 00:{k // 60:02d}:{k % 60:02d}", "run_id": f"r{draw.randrange(3)}", "kind": draw.choice(kinds), "id": draw.choice(["hyp:dangling-cname:x", "dns:a"]), "type": draw.choice(["Host", "Route", None]), "outcome": draw.choice(["created", "merged", None]),
         "decision": draw.choice(["REFUSE", "ALLOW"]), "code": draw.choice(["I1", "I2", None]), "reason": f"why {k}", "target": draw.choice(["t1", "t2", None]), "source": "s"} for k in range(300)
    ]
    out = str(tmp_path / "counters")
    stream = [rows[:100], rows[100:101], rows[101:]]
    source = tmp_path / "in"
    source.mkdir()
    for k, part in enumerate(stream):
        (source / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    events = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(source))
    query = jobs.stream_run_delta(events).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(jobs.upsert_counters(out)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    log, told = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in LOG.split(", ")) for r in rows], LOG), jobs.counters(spark, out)
    both = [(report.run_delta(log), jobs.run_delta_of(told)), (report.run_delta_by_type(log), jobs.run_delta_by_type_of(told))]
    for want, got in both:
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


@pytest.mark.parametrize("cuts", [(20, 60), (1, 2, 90)])
def test_a_bucket_is_the_same_in_any_batches(rocks, tmp_path, cuts):
    draw = random.Random(7)
    at, rows = 0.0, []
    for k in range(120):
        at += draw.choice([0, 0, 1, 1, 3, 40])
        rows.append({"target": draw.choice(["hot", "hot", "hot", "a", "b"]), "seq": k, "at": datetime.datetime.fromtimestamp(at, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "cost": draw.choice([1.0, 2.0])})
    edges = [0, *cuts, len(rows)]
    batches = [rows[i:j] for i, j in zip(edges, edges[1:])]
    out = [r for part in feed(rocks, tmp_path, batches, "target string, seq long, at timestamp, cost double", lambda s: jobs.stream_token_bucket(s, 0.5, 4.0)) for r in part]
    table = rocks.createDataFrame([(r["target"], r["seq"], r["at"], r["cost"]) for r in rows], "target string, seq long, at string, cost double").withColumn("at", F.col("at").cast("timestamp").cast("double"))
    want = {(r.target, r.seq): (r.accepted, round(r.balance_after, 6)) for r in audit.token_bucket(table, 0.5, 4.0).collect()}
    assert {(r.target, r.seq): (r.accepted, round(r.balance_after, 6)) for r in out} == want and len(out) == len(rows)


def test_a_stream_folds_like_a_batch(rocks, tmp_path):
    spark = rocks
    rows = [{"seq": k, "id": f"n{k % 3}", "tool": f"t{k % 4}", "rule_id": "r", "attrs": {"a": str(k // 7 % 2) if k % 5 else "", f"b{k % 2}": "1"}} for k in range(40)]
    late = {"seq": 3, "id": "n0", "tool": "z", "rule_id": "r", "attrs": {}}
    out = [r for rows in feed(spark, tmp_path, [rows[:15], rows[15:30], [*rows[30:], late]], OBS, jobs.stream_project) for r in rows]
    assert [(r.seq, r.node_id) for r in out if r.outcome == "late"] == [(3, "n0")] and len(out) == 41
    graph = {r.id: r for r in fold.project_graph(spark.createDataFrame([tuple({**r, "ts": "1", "type": "Host"}[c] for c in ("seq", "id", "type", "tool", "rule_id", "ts", "attrs")) for r in rows], "seq long, id string, type string, tool string, rule_id string, ts string, attrs map<string,string>")).collect()}
    assert {r.node_id for r in out} == set(graph) and {r.node_id for r in out if r.outcome == "created"} == {"n0", "n1", "n2"}
    last = {r.node_id: r for r in sorted(out, key=lambda r: r.seq) if r.outcome in ("created", "merged")}
    assert all(last[i].log_odds == pytest.approx(graph[i].log_odds) and last[i].independent_sources == graph[i].independent_sources for i in last)


def test_a_stream_goes_on_from_a_graph(rocks, tmp_path):
    """The first half folded as a batch and the second as a stream give what a batch of all gives, evidence, coverage and
    bindings too."""
    schema = "seq long, id string, type string, tool string, rule_id string, ts string, attrs map<string,string>, sha256 string, coverage map<string,boolean>, verdict string, snapshot_id string"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    rows = [
        {"seq": k, "id": f"n{k % 4}", "type": "Host", "tool": f"t{k % 3}", "rule_id": "r", "ts": "1", "attrs": {"a": str(k // 9 % 2), f"b{k % 3}": '"x"'}, "sha256": f"s{k % 5}", "coverage": {"enumerated": k % 7 == 0, "fingerprinted": k > 30}, "verdict": "in_scope", "snapshot_id": "s1"}
        for k in range(48)
    ]

    def batch(some):
        df = rocks.createDataFrame([tuple(r[c] for c in names) for r in some], schema)
        return fold.project_graph(df.withColumn("evidence", F.array(F.struct(F.col("sha256"), F.lit("").alias("region"), F.lit(True).alias("encrypted_at_rest")))).drop("sha256"))

    moved = {**rows[0], "seq": 100, "id": "n1", "verdict": "out_of_scope", "snapshot_id": "s2", "binding": True}
    out = [r for part in feed(rocks, tmp_path, [rows[24:40], [*rows[40:], moved]], schema + ", binding boolean", lambda s: jobs.stream_project(s, batch(rows[:24]))) for r in part]
    want = {r.id: r for r in batch(rows).collect()}
    last = {r.node_id: r for r in sorted(out, key=lambda r: r.seq)}
    assert set(last) <= set(want) and {i for i in want if "#" not in i} <= set(last)
    for i, r in last.items():
        w = want[i]
        assert (r.log_odds, r.independent_sources, r.n_evidence) == (pytest.approx(w.log_odds), w.independent_sources, len(w.evidence)), i
        assert r.coverage == sorted(k for k, v in w.coverage.items() if v), i
        assert (r.verdict, r.snapshot_id) == (("out_of_scope", "s2") if i == "n1" else ("in_scope", "s1")), i


def test_facts_fall_due(spark, tmp_path):
    at = lambda i, day, half="P1D": {"id": i, "last_verified": f"2026-01-{day:02d}T00:00:00Z", "half_life": half}
    batches = [[at("a", 1), at("b", 1), at("c", 1, "P30D")], [at("b", 2)], [at("z", 4)], [at("z", 5)], [at("z", 6)]]
    out = [r for rows in feed(spark, tmp_path, batches, "id string, last_verified timestamp, half_life string", jobs.stream_decay) for r in rows]
    assert {(r.gap_id, r.due) for r in out} >= {("reverify:a", datetime.datetime(2026, 1, 3)), ("reverify:b", datetime.datetime(2026, 1, 4))}
    assert not any(r.id == "c" for r in out) and len({r.id for r in out}) == len(out)
