import json
import math
import random

import pytest
from pyspark.sql import functions as F

from assetgraph.functions import confidence as C
from assetgraph.functions import ontology, verbs
from assetgraph.operators import audit, correlate, extract, fold, gaps, report, scope
from assetgraph.sources import events, responses


def verdicts(spark, values, **rules):
    bound = scope.bind_scope(spark.createDataFrame([(v,) for v in values], "value string"), "value", scope.scope_rules(spark, **rules))
    return {r["value"]: r["verdict"] for r in bound.collect()}


def test_scope_prefers_the_more_specific_rule(spark):
    got = verdicts(spark, ["a.example.com", "b.example.com", "example.com", "x.net", "10.1.2.3", "10.0.0.0/8", "10.1.0.0/16", "", None], include=["*.example.com", "a.example.com", "10.1.0.0/16"], exclude=["*.example.com", "10.1.2.0/24"], prefilter=["x.net"])
    assert got["a.example.com"] == "in_scope"
    assert got["b.example.com"] == got["example.com"] == "adjudication_pending"
    assert got["x.net"] == "prefilter_only"
    assert got["10.1.2.3"] == "out_of_scope"
    assert got["10.0.0.0/8"] == "out_of_scope"
    assert got["10.1.0.0/16"] == "out_of_scope"
    assert got[""] == got[None] == "out_of_scope"


def test_scope_refuses_an_empty_allowlist(spark):
    with pytest.raises(ValueError):
        scope.scope_rules(spark, [])


def test_wildcard_without_apex(spark):
    assert verdicts(spark, ["example.com", "a.example.com"], include=["*.example.com"], wildcard_includes_apex=False) == {"example.com": "out_of_scope", "a.example.com": "in_scope"}


OBS = "seq long, id string, type string, tool string, rule_id string, ts string, attrs map<string,string>"


def test_fold_merges_and_forks(spark):
    obs = spark.createDataFrame(
        [
            (1, "h", "Host", "t1", "r", "1", {"ip": '"1"'}), (2, "h", "Host", "t2", "r", "2", {"ip": '"2"'}), (3, "h", "Host", "t2", "r", "3", {"os": '"x"', "ip": '""'}), (4, "h", "Host", "t2", "r", "4", {}),
            (1, "g", "Host", "t1", "r", "1", {"a": "1"}), (2, "g", "Host", "t1", "r", "2", {"b": "2"}), (9, "n", "Host", "t", "r", "9", None),
        ], OBS,
    )
    got = {r.id: r for r in fold.project_graph(obs).collect()}
    assert set(got) == {"h", "h#fork1", "g", "n"}
    assert got["h"].attrs == {"ip": '"1"', "os": '"x"'} and got["h"].log_odds == pytest.approx(0.8) and got["h"].last_seen == "4" and got["h"].observations == 3
    assert got["h#fork1"].base == "h" and got["h#fork1"].attrs == {"ip": '"2"'}
    assert got["g"].attrs == {"a": "1", "b": "2"} and got["g"].log_odds == 0


def test_fold_equals_a_plain_replay(spark):
    rows = [(k, "hot" if k % 3 else f"n{k % 7}", "Host", f"t{k % 4}", "r", str(k), {"a": str(k % 5) if k % 2 else "", f"b{k % 11}": str(k % 2)}) for k in range(3000)]
    got = fold.project_graph(spark.createDataFrame(rows, OBS))
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    want, base = {}, {}
    for _, i, _, tool, _, ts, attrs in rows:
        if i not in base:
            base[i] = [dict(attrs), {tool}, ts, ts, 1, 0]
        elif any(base[i][0].get(k) not in (None, "", v) and v for k, v in attrs.items()):
            base[i][5] += 1
            want[f"{i}#fork{base[i][5]}"] = (i, base[i][5], attrs, [f"{tool}/r"], 0.0, ts, ts, 1)
        else:
            base[i][0] = attrs | base[i][0]
            base[i][1].add(tool)
            base[i][3] = ts
            base[i][4] += 1
    want |= {i: (i, 0, a, sorted(f"{t}/r" for t in s), round(0.8 * (len(s) - 1), 6), lo, hi, n) for i, (a, s, lo, hi, n, _) in base.items()}
    assert {r.id: (r.base, r.fork, r.attrs, r.sources, round(r.log_odds, 6), r.first_seen, r.last_seen, r.observations) for r in got.collect()} == want


def test_forks_by_rounds_equal_a_plain_replay(spark):
    """Random attributes of many kinds: empty values never contradict and are never filled, 1, 1.0 and true are equal, lists are
    no scalars."""
    draw = random.Random(5)
    values = ['"x"', '"y"', '""', "null", "1", "1.0", "true", "0", "false", "2", "[1]", "[2]", "{}"]
    rows = [(k, f"i{draw.choice([0, 0, 0, 0, draw.randrange(40)])}", {f"a{draw.randrange(6)}": draw.choice(values) for _ in range(draw.randrange(4))}) for k in draw.sample(range(9000), 800)]
    got = {r.seq: r.fork for r in fold.numbered(spark.createDataFrame(rows, "seq long, id string, attrs map<string,string>").repartition(5)).collect()}
    empty = (None, "", [], {})
    want, base, forks = {}, {}, {}
    for seq, i, attrs in sorted(rows, key=lambda r: r[0]):
        own = {k: json.loads(v) for k, v in attrs.items()}
        known = base.setdefault(i, {})
        if any(k in known and known[k] not in empty and v not in empty and not isinstance(v, (list, dict)) and not isinstance(known[k], (list, dict)) and known[k] != v for k, v in own.items()):
            forks[i] = forks.get(i, 0) + 1
            want[seq] = forks[i]
        else:
            want[seq] = 0
            for k, v in own.items():
                known.setdefault(k, v)
    assert got == want and max(want.values()) > 100


def test_forking_needs_no_python_and_no_task_holds_an_id(spark):
    rows = spark.range(5000).selectExpr("id as seq", "'hot' as id", "map('a', cast(id % 2 as string)) as attrs")
    out = fold.numbered(rows.repartition(6))
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()
    assert out.where("fork > 0").agg(F.count("*"), F.max("fork"), F.count_distinct("fork")).first()[:] == (2500, 2500, 2500)


def test_replay_keeps_penalties_sources_and_fork_marks(spark):
    told = datum("n", "1", attrs={"k": 1})
    told["confidence"] = {"log_odds": 1.0, "independent_sources": 4, "penalties": [{"reason": "old", "logodds_delta": -2.0}], "forked_from": "host:0"}
    rows = [(1, "node_upserted", json.dumps({"node": told})), (2, "node_upserted", json.dumps({"node": datum("n", "2", "u", {"k": 1.0})}))]
    graph, _ = fold.replay(spark.createDataFrame(rows, "seq long, kind string, payload string"))
    r = graph.first()
    assert graph.count() == 1 and r.independent_sources == 5 and r.forked_from == "host:0" and [tuple(x) for x in r.penalties] == [("old", -2.0)] and r.log_odds == pytest.approx(1.8)
    assert graph.select(C.probability(F.col("log_odds"), F.col("penalties")).alias("p")).first().p == pytest.approx(1 / (1 + math.exp(0.2)))


def datum(i, ts, tool="t", attrs=None, coverage=None, proof=None, **more):
    step = {"evidence_id": proof or "", "tool": tool, "tool_version": "1", "rule_id": "r", "rule_version": "1", "config_hash": ""}
    times = {"first_seen": ts, "last_seen": ts, "last_verified": ts, "decay_half_life": "P7D"}
    binding = {"verdict": "in_scope", "snapshot_id": "s1", "observed_at": ts, "rule_matched": "x"}
    proofs = [{"sha256": proof, "region": "", "encrypted_at_rest": True}] if proof else []
    return {"id": i, "type": "Host", "provenance": {"chain": [step]}, "confidence": {"log_odds": 1.0}, "temporal": times, "scope_binding": binding, "attrs": attrs or {}, "coverage": coverage or {}, "evidence": proofs} | more


def test_replay_of_a_log(spark):
    ends = {"frm": "a", "to": "b", "type": "exposes"}
    rows = [
        (0, "node_upserted", {"node": datum("h", "1", attrs={"ip": "1.1.1.1", "n": 1}, coverage={"enumerated": False}, proof="p1")}), (1, "scope_binding_set", {"id": "late", "binding": {"verdict": "out_of_scope", "snapshot_id": "s2", "observed_at": "1"}}),
        (2, "node_upserted", {"node": datum("h", "2", "u", {"os": "x", "n": "1", "ip": ""}, {"enumerated": True, "x": False}, "p2")}), (3, "contradiction_forked", {"node": datum("h", "3", "u", {"ip": "2.2.2.2"}, proof="p3")}),
        (4, "node_upserted", {"node": datum("late", "4")}), (5, "scope_binding_set", {"id": "h", "binding": {"verdict": "out_of_scope", "snapshot_id": "s2", "observed_at": "5", "rule_matched": "y"}}), (6, "node_upserted", {"id": "h"}),
        (7, "edge_upserted", {"edge": datum("h", "1", attrs={"w": 1}, **ends)}), (8, "contradiction_forked", {"edge": datum("h", "2", attrs={"w": 2}, **ends)}), (9, "contradiction_forked", {"edge": datum("h", "3", attrs={"w": 3}, **ends)}),
        (10, "node_upserted", {"node": datum("h", "9", "u", {"n": 1}, proof="p2")}),
    ]
    graph, skipped = fold.replay(spark.createDataFrame([(k, kind, json.dumps(p)) for k, kind, p in rows], "seq long, kind string, payload string"))
    got = {(r.kind, r.id): r for r in graph.collect()}
    assert set(got) == {("node", "h"), ("node", "h#fork1"), ("node", "h#fork2"), ("node", "late"), ("edge", "h"), ("edge", "h#fork1")}
    h = got["node", "h"]
    # "1" and 1 differ, so the second sight is a fork; the last one agrees
    assert h.attrs == {"ip": '"1.1.1.1"', "n": "1"} and h.coverage == {"enumerated": False} and [e.sha256 for e in h.evidence] == ["p1", "p2"]
    assert (h.log_odds, h.independent_sources, h.first_seen, h.last_verified, h.verdict, h.snapshot_id, h.rule_matched) == (1.8, 2, "1", "9", "out_of_scope", "s2", "y")
    assert got["node", "h#fork1"].forked_from == "h" and got["node", "h#fork1"].coverage == {"enumerated": True, "x": False} and got["node", "h#fork2"].attrs == {"ip": '"2.2.2.2"'}
    assert got["node", "late"].verdict == "in_scope" and got["edge", "h#fork1"].attrs == {"w": "3"} and [r.seq for r in skipped.collect()] == [6]


def test_append_continues_seq_and_drops_seen_keys(spark):
    log = spark.createDataFrame([(7, "1", "r", "node_upserted", "{}", 0, "a", "k1")], events.EVENT)
    new = spark.createDataFrame([(None, "2", "r", "node_upserted", "{}", 0, "a", "k1"), (None, "3", "r", "rate_debit", "{}", 0, "a", "k2"), (None, "4", "r", "rate_debit", "{}", 0, "a", "k2"), (None, "5", "r", "rate_debit", "{}", 0, "a", "")], events.EVENT)
    got = sorted((r.seq, r.ts) for r in events.append_events(new, log).collect())
    assert got == [(8, "3"), (9, "5")]
    first = events.append_events(new.where("ts > '2'"), log.limit(0))
    assert sorted((r.seq, r.ts) for r in first.collect()) == [(0, "3"), (1, "5")]
    with pytest.raises(Exception, match="unknown event kind"):
        events.append_events(new.withColumn("kind", F.lit("nope")), log).collect()


def test_token_bucket_refuses_without_balance(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 0.0, 1.0), ("a", 3, 0.5, 1.0), ("a", 4, 10.0, 1.0)], "target string, seq long, at double, cost double")
    got = [(r.seq, r.accepted, r.balance_after) for r in audit.token_bucket(rows, 1.0, 1.0).orderBy("seq").collect()]
    assert got == [(1, True, 0.0), (2, False, 0.0), (3, False, 0.5), (4, True, 0.0)]


def test_numeric_siblings_keep_padding(spark):
    got = {r.fqdn: r.generator for r in extract.candidate_names(spark.createDataFrame([("prod06.example.com",), ("a0.b.example.com",)], "host string")).collect()}
    assert {k for k, v in got.items() if v == "numeric"} == {"prod07.example.com", "prod05.example.com", "prod08.example.com", "prod04.example.com", "a1.b.example.com", "a2.b.example.com"}
    assert got["api.example.com"] == "prefix"


def test_oversized_clusters_make_no_pairs(spark):
    prints = spark.createDataFrame([("favicon_hash", k, "x") for k in range(40)] + [("spki", 1, "y"), ("spki", 2, "y"), ("favicon_hash", 1, "z"), ("favicon_hash", 2, "z")], "signal string, id int, fingerprint string")
    assert [(r.a, r.b, r.signal) for r in correlate.correlate(prints).collect()] == [(1, 2, "spki")]


def test_events_since(spark):
    log = spark.createDataFrame([(1, "1", "a"), (2, "2", "b"), (3, "3", "c")], "seq long, ts string, run_id string")
    runs = lambda df: sorted(r.run_id for r in df.collect())
    assert runs(report.events_since(log, run_id="a")) == ["b", "c"]
    assert runs(report.events_since(log, run_id="unknown")) == ["a", "b", "c"]
    assert runs(report.events_since(log, since_ts="2")) == ["c"]
    assert runs(report.events_since(log)) == ["c"]


def test_top_n_reports_what_it_leaves_out(spark):
    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 1)], "g string, v int")
    kept, left = gaps.top_n_per_group(df, ["g"], [F.desc("v")], 3)
    assert kept.count() == 4 and {r.g: r.left_out for r in left.collect()} == {"a": 2, "b": 0}


def test_collected_responses(spark):
    names, bad = responses.read_ct_rows(spark.createDataFrame([("x", '[{"name_value":"a.x\\n*.b.x"}]'), ("y", "<html>"), ("z", None)], "apex string, body string"))
    assert sorted(r.name for r in names.collect()) == ["*.b.x", "a.x"] and sorted(r.apex for r in bad.collect()) == ["y", "z"]
    rows = responses.read_cdx_rows(spark.createDataFrame([("h", '[["original","timestamp"],["http://h/","20200101000000"],["short"]]'), ("e", "")], "host string, body string"))
    assert [tuple(r) for r in rows.collect()] == [("h", "http://h/", "20200101000000")]


def test_email_posture(spark):
    rows = spark.createDataFrame([("a.com", "TXT", ["v=spf1 include:_spf.b.com ~all"]), ("_dmarc.a.com", "TXT", ["v=DMARC1; p=none"])], "name string, rrtype string, rdata array<string>")
    r = extract.email_posture(rows).first()
    assert (r.spf_qualifier, r.spf_enforcing, r.spf_includes, r.dmarc_policy, r.dmarc_enforcing, r.mx_hosts, r.mta_sts_present) == ("~", False, ["_spf.b.com"], "none", False, [], False)


def test_scope_of_both_families(spark):
    got = verdicts(
        spark, ["2001:db8::1", "2001:DB8:0:1::/64", "2001:db8::/31", "2001:db8:ffff::1", "::ffff:10.0.0.1", "10.0.0.1", "fe80::1%eth0", "2001:db9::1", "a::b::c", "10.1.0.0/8"], include=["2001:db8::/32", "10.0.0.0/8", "fe80::/10"], exclude=["2001:db8:ffff::/48"],
        prefilter=["2001:db9::/32"],
    )
    assert got == {
        "2001:db8::1": "in_scope", "2001:DB8:0:1::/64": "in_scope", "2001:db8::/31": "out_of_scope", "2001:db8:ffff::1": "out_of_scope", "::ffff:10.0.0.1": "out_of_scope", "10.0.0.1": "in_scope", "fe80::1%eth0": "in_scope",
        "2001:db9::1": "prefilter_only", "a::b::c": "out_of_scope", "10.1.0.0/8": "in_scope",
    }


def test_an_exclusion_meets_wider_networks(spark):
    got = verdicts(spark, ["2001:db8::/32", "2001:db8:1::/48"], include=["2001:db8::/16"], exclude=["2001:db8:ffff::/48"])
    assert got == {"2001:db8::/32": "out_of_scope", "2001:db8:1::/48": "in_scope"}


def test_network_rules_join_by_equality(spark):
    bound = scope.bind_scope(spark.createDataFrame([("10.0.0.1",)], "value string"), "value", scope.scope_rules(spark, ["10.0.0.0/8"]))
    plan = bound._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(("on", "snapshot", "stale", "verb", "verdict", "want"), [
    (False, "s", False, "passive-collect", "in_scope", "active modules disabled"), (True, None, False, "resolve", "in_scope", "no scope snapshot"), (True, "s", True, "resolve", "in_scope", "stale"), (True, "s", False, "inject", "in_scope", "blocked list"),
    (True, "s", False, "content-discovery-wordlist", "in_scope", "human-gated"), (True, "s", False, "x", "in_scope", "whitelist"), (True, "s", False, "passive-collect", "in_scope", "not an active verb"), (True, "s", False, "resolve", "prefilter_only", "not in scope"),
    (True, "s", False, "resolve", "in_scope", ""),
])
def test_gate(spark, on, snapshot, stale, verb, verdict, want):
    r = audit.gate_decisions(spark.createDataFrame([(verb, verdict)], "verb string, verdict string"), on, snapshot, stale).first()
    assert (r.decision == "ALLOW") == (want == "") and want in r.reason


def test_gated_gaps_wait(spark):
    rows = spark.createDataFrame([("a", "resolve", False), ("b", "content-discovery-wordlist", False), ("c", "resolve", True)], "gap_id string, verb string, human_gated boolean")
    free, wait = verbs.gated_split(rows)
    assert [r.gap_id for r in free.collect()] == ["a"] and sorted(r.gap_id for r in wait.collect()) == ["b", "c"]


def test_types_are_closed(spark):
    rows = [("node", "Host", None, None), ("node", "Nope", None, None), ("edge", "exposes", "a", "b"), ("edge", "exposes", "a", ""), ("edge", "originated_by", "a", "b"), ("edge", "x", "a", "b"), ("node", None, None, None)]
    good, bad = ontology.validate_types(spark.createDataFrame(rows, "kind string, type string, frm string, to string"))
    assert good.count() == 2 and sorted(r.type_error.split(":")[0] for r in bad.collect()) == ["an edge needs both ends", "edge type is only proposed", "unknown edge type x", "unknown node type Nope", "unknown node type null"]


def test_half_lives_and_stale_snapshots(spark, tmp_path):
    from assetgraph.functions import confidence as C

    assert [r[0] for r in spark.createDataFrame([("Token",), ("Other",), (None,)], "t string").select(C.half_life_for(F.col("t"))).collect()] == ["PT12H", "P14D", "P14D"]
    path = str(tmp_path / "snapshots")
    assert events.load_snapshots(spark, path).count() == 0
    for day in ("2026-01-01", "2026-01-09"):
        events.save_snapshot(events.take_snapshot(spark, day, ["b", "a"], [], [], f"{day} 12:00:00"), path)
    saved = events.load_snapshots(spark, path)
    last = events.latest_snapshot(saved, "2026-01-10 00:00:00").first()
    assert saved.count() == 2 and last.include == ["a", "b"] and last.half_life == "PT24H" and not last.stale
    rows = spark.range(3)
    assert events.require_snapshot(rows, events.latest_snapshot(saved, "2026-01-10 00:00:00")).count() == 3
    assert events.require_snapshot(rows, events.latest_snapshot(saved, "2026-01-11 00:00:00")).count() == 0


def test_agreeing_body_fingerprints_count_more(spark):
    rows = [("w1", "WebApp", "in_scope", {"favicon_hash": '"F"', "default_404_hash": '"p"', "kids": '["k"]'}), ("w2", "WebApp", "in_scope", {"favicon_hash": '"f"', "default_404_hash": '"p"', "kids": '["k", ""]'}), ("w3", "WebApp", "out_of_scope", {"favicon_hash": '"f"'}), ("d", "Domain", "in_scope", {"favicon_hash": '"f"'})]
    nodes = spark.createDataFrame(rows, "id string, type string, verdict string, attrs map<string,string>")
    edges = spark.createDataFrame([("presents_certificate", "w1", "c"), ("presents_certificate", "d", "c"), ("presents_certificate", "w3", "c")], "type string, frm string, to string")
    got = {(r.type, r.frm, r.to): (r.signal, round(r.log_odds, 3)) for r in correlate.identity_edges(nodes, edges).collect()}
    want = {("same_as", "w1", "w2"): ("favicon_hash", 2.2), ("shared_trust_domain", "w1", "w2"): ("kid", 1.2), ("same_as", "d", "w1"): ("spki", 2.4)}
    assert got == want | {(t, b, a): v for (t, a, b), v in want.items()}


def test_new_sources(spark):
    shape = "id string, tool string, rule_id string"
    got = report.new_sources(spark.createDataFrame([("a", "t", "r")], shape), spark.createDataFrame([("a", "t", "r"), ("a", "u", "r"), ("b", "t", "r")], shape))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "u", "r"), ("b", "t", "r")]


def test_ledgers_charge_registrable_domains_or_sources(spark):
    rows = spark.createDataFrame([("a.example.com", "s", 1, 0.0, 1.0), ("b.example.com", "s", 2, 0.0, 1.0), ("c.example.com", "s", 3, 0.0, 1.0), ("x.org", "t", 4, 0.0, 1.0)], "target string, source string, seq long, at double, cost double")
    assert {r.target: (r.n, r.cost) for r in audit.spend(rows, 1.0, 2.0).collect()} == {"example.com": (2, 2.0), "x.org": (1, 1.0)}
    assert {r.target: r.n for r in audit.spend(rows, 1.0, 2.0, F.col("source")).collect()} == {"s": 2, "t": 1}


def test_deltas_of_a_log(spark):
    rows = [
        (0, "1", "r1", "node_upserted", {"type": "Host", "outcome": "created", "id": "host:1"}), (1, "2", "r1", "node_upserted", {"type": "Hypothesis", "outcome": "created", "id": "hyp:dangling-cname:a"}), (2, "3", "r1", "rate_debit", {"target": "a.com"}),
        (3, "4", "r2", "loop_halted", {"reason": "gap queue dry"}), (4, "5", "r3", "invariant_violation", {"code": "I4", "detail": "x"}), (5, "6", "r4", "scope_drift_detected", {}), (6, "7", "r4", "node_upserted", {"type": "Host", "outcome": "merged", "id": "host:1"}),
    ]
    log = report.flat_log(spark.createDataFrame([(*r[:4], json.dumps(r[4])) for r in rows], "seq long, ts string, run_id string, kind string, payload string"))
    assert {r.run_id: r.headline for r in report.delta_headline(log).collect()} == {
        "r1": "1 new Host; 1 new Hypothesis; subdomain-takeover candidate", "r2": "no change since the previous run", "r3": "HALTED on a safety invariant (I4)", "r4": "SCOPE DRIFT detected — re-bind before acting",
    }
    delta = {r.run_id: r for r in report.run_delta(log).collect()}
    assert delta["r2"].halted_because == "gap queue dry" and delta["r1"].notable == 1 and delta["r2"].quiet and not delta["r4"].quiet and delta["r4"].nodes_merged == 1
    leads = report.hypothesis_leads(spark.createDataFrame([("hyp:dangling-cname:a", "Hypothesis"), ("hyp:other:b", "Hypothesis"), ("host:1", "Host")], "id string, type string"))
    assert sorted((r.hypothesis, r.what) for r in leads.collect()) == [("dangling-cname", "subdomain-takeover candidate"), ("other", "other")]
