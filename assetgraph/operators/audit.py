"""Ledger replay, gate decisions and invariant checks."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetgraph.functions import urls as U
from assetgraph.functions import verbs as V

def token_bucket(debits: DataFrame, qps: float, capacity: float) -> DataFrame:
    """Rows (target, seq, at seconds, cost) -> (target, seq, accepted, balance_after).

    A bucket is refilled by elapsed time up to its capacity; a debit beyond the balance is refused. The
    refill is clipped, so the balance depends on every step before: one ordered fold per target, whose state
    is two numbers. Rows arrive sorted and are folded batch by batch, never held as a whole."""

    def run(it):
        target, tokens, last = None, 0.0, 0.0
        for batch in it:
            names, at, cost = (batch.column(k).to_pylist() for k in (0, 2, 3))
            ok, left = [], []
            for t, when, c in zip(names, at, cost):
                if t != target:
                    target, tokens, last = t, capacity, when
                tokens = min(capacity, tokens + max(0.0, when - last) * qps)
                last = when
                ok.append(tokens >= c)
                tokens -= c if ok[-1] else 0.0
                left.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_()), pa.array(left, pa.float64())], names=["target", "seq", "accepted", "balance_after"])

    kind = debits.schema["target"].dataType.simpleString()
    rows = debits.select("target", F.col("seq").cast("long"), F.col("at").cast("double"), F.col("cost").cast("double"))
    return rows.repartition("target").sortWithinPartitions("target", "at", "seq").mapInArrow(run, f"target {kind}, seq long, accepted boolean, balance_after double")


def spend(debits: DataFrame, qps: float, capacity: float, by: Column | None = None) -> DataFrame:
    """The debits that a bucket accepts: (target, n, cost). One ledger charges targets by registrable domain; a
    second one, for third parties, is the same call on the debits of passive queries, by their source."""
    keyed = debits.withColumn("target", U.registrable_domain(U.canonical_host(F.col("target"))) if by is None else by)
    accepted = token_bucket(keyed, qps, capacity).where("accepted").select("target", "seq")
    return keyed.join(accepted, ["target", "seq"]).groupBy("target").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def gate_decisions(requests: DataFrame, active_on: bool, snapshot: str | None, snapshot_stale: bool = False) -> DataFrame:
    """Requests (verb, verdict, rule_matched, ...) with decision and the first reason to refuse, in this order: active
    collection is off, no snapshot, a stale snapshot, a verb that may not be scheduled, one that is not active, a
    verdict other than in_scope, and, where requests say what the rate ledger did (accepted), an empty budget."""
    verb, verdict = F.coalesce("verb", F.lit("")), F.coalesce("verdict", F.lit("out_of_scope"))
    quoted, kind = F.concat(F.lit("'"), verb, F.lit("'")), V.verb_class(F.col("verb"))
    rule = F.coalesce("rule_matched", F.lit("")) if "rule_matched" in requests.columns else F.lit("")
    # The reasons.
    reason = (
        F.when(F.lit(not active_on), "active modules disabled (allow_active=false)").when(F.lit(snapshot is None), "no scope snapshot (verify live policy first)")
        .when(F.lit(snapshot_stale), "scope snapshot is stale; re-fetch + re-bind required").when(kind == "blocked", F.concat(F.lit("verb "), quoted, F.lit(" is on the blocked list and can never be scheduled")))
        .when(kind == "human_gated", F.concat(F.lit("verb "), quoted, F.lit(" is human-gated; enqueue for authorization, do not auto-run"))).when(kind == "unknown", F.concat(F.lit("verb "), quoted, F.lit(" is not on the verb whitelist")))
        .when(~V.is_active(F.col("verb")), F.concat(quoted, F.lit(" is not an active verb"))).when(verdict != "in_scope", F.concat(F.lit("not in scope: "), rule, F.lit(" ("), verdict, F.lit(")")))
    )
    if "accepted" in requests.columns:
        reason = reason.when(~F.coalesce("accepted", F.lit(False)), "rate budget exceeded")
    return requests.withColumns({"decision": F.when(reason.isNull(), "ALLOW").otherwise("REFUSE"), "reason": F.coalesce(reason, F.lit(""))})


def _holds(name: str) -> Column:
    return ~F.coalesce(F.col("attrs")[name], F.lit("")).isin("", "false", "null", '""', "0", "[]", "{}")


def invariants(nodes: DataFrame, edges: DataFrame, ledger: DataFrame | None = None, snapshot_id: str | None = None, log: DataFrame | None = None, snapshot_stale: bool = False) -> DataFrame:
    """(code, detail) of each violation; no row means clean.

    nodes (id, type, snapshot_id, verdict, attrs, sensitivity, data_subject, forked_from), edges (id, type, frm, to,
    forked_from), ledger (target, balance_after), log (kind, id, verb, decision). I1 a binding to another snapshot; I3 an
    active probe out of scope; I4 a negative balance; I5 a derivation from something other than an Artifact; I6 and I7
    circumvention; I8 a credential, token or other person's data without its label; I9 an edge to other people's data;
    of the log: I10 a dispatched verb that may not be scheduled, I11 a fork that does not exist or does not name its base,
    I12 an ALLOW under a stale snapshot (one row)."""
    rows = lambda df, code: df.select(F.lit(code).alias("code"), F.col("id").cast("string").alias("detail"))
    label = F.coalesce("sensitivity", F.lit("S0"))
    found = [
        rows(nodes.where(_holds("active_probed") & (F.col("verdict") != "in_scope")), "I3"), rows(nodes.where(F.col("attrs")["anti_cheat_action_mode"].isin("runtime_circumvent", '"runtime_circumvent"')), "I6"),
        rows(nodes.where((F.col("type") == "Artifact") & (_holds("is_circumvention_tool") | _holds("published_externally"))), "I7"), rows(nodes.where(F.col("type").isin("Credential", "Token") & (label == "S0")), "I8"),
        rows(nodes.where((F.col("data_subject") == "other") & (label != "S3")), "I8"),
    ]
    if snapshot_id is not None:
        found.append(rows(nodes.where(~F.col("snapshot_id").eqNullSafe(F.lit(snapshot_id))), "I1"))
    if ledger is not None:
        found.append(ledger.where("balance_after < 0").select(F.lit("I4").alias("code"), F.col("target").cast("string").alias("detail")))
    artifacts = nodes.where("type = 'Artifact'").select(F.col("id").alias("to"))
    found.append(rows(edges.where("type = 'derived_from'").join(artifacts, "to", "left_anti"), "I5"))
    others = nodes.where("data_subject = 'other'").select(F.col("id").alias("end"))
    ends = edges.select("id", F.explode(F.array("frm", "to")).alias("end"))
    found.append(rows(ends.join(others, "end", "left_semi").select("id"), "I9"))
    if log is not None:
        found.append(rows(log.where(F.col("kind") == "gap_dispatched").where(V.verb_class(F.col("verb")) != "allowed"), "I10"))
        known = nodes.select("id", "forked_from").unionByName(edges.select("id", "forked_from")).where("forked_from is not null").select("id")
        found.append(rows(log.where(F.col("kind") == "contradiction_forked").join(known, "id", "left_anti"), "I11"))
        if snapshot_stale:
            allowed = log.where("kind = 'gate_decision_recorded' and decision = 'ALLOW'").agg(F.count("*").alias("n")).where("n > 0")
            found.append(allowed.select(F.lit("I12").alias("code"), F.col("n").cast("string").alias("detail")))
    return functools.reduce(DataFrame.unionByName, found)
