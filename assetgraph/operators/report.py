"""Reports over the event log: runs, deltas, dispatches, differences, drift.

Log columns: seq, ts, run_id, kind, and of the payload those of FIELDS that there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FIELDS = ("id", "type", "outcome", "decision", "code", "reason", "target", "source")
# Kinds of hypotheses that a delta names.
NOTABLE = {"dangling-cname": "subdomain-takeover candidate", "dns-candidate": "unconfirmed hostname candidate"}
TYPE_COUNTS = "array<struct<type:string,n:bigint>>"


def flat_log(log: DataFrame) -> DataFrame:
    """A log (seq, ts, run_id, kind, payload JSON) with FIELDS as columns."""
    return log.select("seq", "ts", "run_id", "kind", *(F.get_json_object("payload", f"$.{c}").alias(c) for c in FIELDS))


def whole(log: DataFrame) -> DataFrame:
    return log.withColumns({c: F.lit(None).cast("string") for c in FIELDS if c not in log.columns})


def run_order(log: DataFrame) -> DataFrame:
    """(run_id, first_seq, position): runs by first appearance. The ranked rows are runs, one each, not events."""
    runs = log.groupBy("run_id").agg(F.min("seq").alias("first_seq"))
    return runs.withColumn("position", F.row_number().over(Window.orderBy("first_seq")))


def notable(id_: Column) -> Column:
    """What a hypothesis is that a report names, else null."""
    return F.create_map(*(F.lit(x) for pair in NOTABLE.items() for x in pair))[F.regexp_extract(F.coalesce(id_, F.lit("")), "^hyp:([^:]*):", 1)]


def quiet() -> Column:
    """A run learned nothing new."""
    return (F.col("nodes_created") == 0) & (F.col("edges_created") == 0) & (F.col("forks") == 0) & (F.col("notable") == 0) & (F.col("drifts") == 0)


def _made() -> Column:
    return F.coalesce(F.col("outcome") == "created", F.lit(False))


def run_delta(log: DataFrame) -> DataFrame:
    """One row per run: what it created, merged, forked, dispatched, refused and spent, what it broke, why it stopped, which
    notable hypotheses came up, and from when to when. A quiet run learned nothing new."""
    kind = F.col("kind")
    node, edge = kind == "node_upserted", kind == "edge_upserted"
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    what = notable(F.col("id"))
    out = whole(log).groupBy("run_id").agg(
        count(node & _made()).alias("nodes_created"), count(node & ~_made()).alias("nodes_merged"), count(edge & _made()).alias("edges_created"), count(kind == "contradiction_forked").alias("forks"),
        count(kind == "gap_dispatched").alias("gaps_dispatched"), count((kind == "gate_decision_recorded") & (F.col("decision") == "REFUSE")).alias("refusals"), count(kind == "rate_debit").alias("rate_debits"),
        count(kind == "third_party_debit").alias("third_party_debits"), count(kind == "invariant_violation").alias("violations"), F.min_by(F.when(kind == "invariant_violation", F.coalesce("code", F.lit("?"))), F.when(kind == "invariant_violation", F.col("seq"))).alias("first_violation"),
        count(kind == "scope_drift_detected").alias("drifts"), F.coalesce(F.max_by(F.when(kind == "loop_halted", F.col("reason")), F.when(kind == "loop_halted", F.col("seq"))), F.lit("")).alias("halted_because"),
        count(node & _made() & what.isNotNull()).alias("notable"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"),
    )
    return out.withColumn("quiet", quiet())


def run_delta_by_type(log: DataFrame) -> DataFrame:
    """(run_id, type, created, merged) of nodes."""
    return whole(log).where("kind = 'node_upserted'").groupBy("run_id", F.coalesce("type", F.lit("?")).alias("type")).agg(F.count_if(_made()).alias("created"), F.count_if(~_made()).alias("merged"))


def run_spend(log: DataFrame) -> DataFrame:
    """(run_id, ledger, target, n): debits of targets and of third parties."""
    rows = whole(log).where(F.col("kind").isin("rate_debit", "third_party_debit"))
    ledger = F.when(F.col("kind") == "rate_debit", "target").otherwise("third_party")
    target = F.coalesce(F.when(ledger == "target", F.col("target")).otherwise(F.col("source")), F.lit("?"))
    return rows.groupBy("run_id", ledger.alias("ledger"), target.alias("target")).agg(F.count("*").alias("n"))


def notable_hypotheses(log: DataFrame) -> DataFrame:
    """(run_id, seq, id, what) of hypotheses that a run created and that a report names."""
    table = F.create_map(*(F.lit(x) for pair in NOTABLE.items() for x in pair))
    what = table[F.regexp_extract("id", "^hyp:([^:]*):", 1)]
    return whole(log).where((F.col("kind") == "node_upserted") & _made()).select("run_id", "seq", "id", what.alias("what")).where("what is not null")


def hypothesis_leads(nodes: DataFrame) -> DataFrame:
    """Hypothesis nodes (id, type, attrs, log_odds, ...) with their kind and what they may be, likeliest first per kind."""
    kind = F.regexp_extract("id", "^hyp:([^:]*):", 1)
    table = F.create_map(*(F.lit(x) for pair in NOTABLE.items() for x in pair))
    return nodes.where((F.col("type") == "Hypothesis") & F.col("id").startswith("hyp:")).withColumns({"hypothesis": kind, "what": F.coalesce(table[kind], kind)})


MAX_LEADS = 100


def delta_headline(log: DataFrame, most: int = MAX_LEADS) -> DataFrame:
    """(run_id, headline, leads_left_out) of each run: drift before a violation before a quiet run before what is new: the counts of
    new types by name, of forks, and each notable finding by itself, in order. A line names at most so many findings, as
    its length would grow with the run; the others are counted."""
    delta = run_delta(log)
    new = run_delta_by_type(log).where("created > 0").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("type", F.col("created").alias("n")))).alias("new"))  # one entry per type
    first = notable_hypotheses(log).withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).where(F.col("k") <= most)
    leads = first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "what"))).alias("leads"))
    rows = delta.join(new, "run_id", "left").join(leads, "run_id", "left")
    bits = F.concat(
        F.transform(F.coalesce("new", F.array().cast(TYPE_COUNTS)), lambda x: F.concat(x["n"].cast("string"), F.lit(" new "), x["type"])),
        F.array_compact(F.array(F.when(F.col("forks") > 0, F.concat(F.col("forks").cast("string"), F.lit(" contradiction(s) forked"))))),
        F.transform(F.coalesce("leads", F.array().cast("array<struct<seq:bigint,what:string>>")), lambda x: x["what"]),
    )
    # The headlines.
    headline = (
        F.when(F.col("drifts") > 0, F.lit("SCOPE DRIFT detected — re-bind before acting")).when(F.col("violations") > 0, F.concat(F.lit("HALTED on a safety invariant ("), F.col("first_violation"), F.lit(")")))
        .when(F.col("quiet"), "no change since the previous run").otherwise(F.array_join(bits, "; "))
    )
    return rows.select("run_id", headline.alias("headline"), F.greatest(F.col("notable") - most, F.lit(0)).alias("leads_left_out"))


def events_since(log: DataFrame, run_id: str | None = None, since_ts: str | None = None) -> DataFrame:
    """Events after a run (exclusive; an unknown run: all), after a time, or else of the last run."""
    order = run_order(log)
    if run_id:
        at = order.where(F.col("run_id") == run_id).agg(F.coalesce(F.max("position"), F.lit(0)).alias("at"))
        wanted = order.join(F.broadcast(at), F.col("position") > F.col("at")).select("run_id")
        return log.join(wanted, "run_id", "left_semi")
    if since_ts:
        return log.where(F.col("ts") > since_ts)
    last = order.agg(F.max_by("run_id", "position").alias("run_id"))
    return log.join(F.broadcast(last), "run_id", "left_semi")


def dispatch_history(log: DataFrame) -> DataFrame:
    return log.where("kind = 'gap_dispatched'").groupBy(F.col("id").alias("gap_id")).agg(F.max("ts").alias("last_dispatch"), F.count("*").alias("n"))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def cycle_diff(before: DataFrame, after: DataFrame, key: str = "type") -> DataFrame:
    """Non-zero differences of counts n by key."""
    both = before.withColumnRenamed("n", "b").join(after.withColumnRenamed("n", "a"), key, "full_outer")
    diff = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return both.select(key, diff.alias("delta")).where("delta <> 0")


def new_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, tool, rule_id) of observations in after whose source no observation of the same id has in before."""
    key = ["id", "tool", "rule_id"]
    return after.select(*key).distinct().join(before.select(*key).distinct(), key, "left_anti")


def detect_drift(pairs: DataFrame) -> DataFrame:
    """pairs of snapshots (old_*, new_* of include, exclude, prefilter arrays and content_sha256) -> drift and its summary.
    A pair without an old content_sha256 has no previous snapshot, and nothing to drift from."""
    new = lambda c, a, b: F.array_sort(F.array_except(f"{a}_{c}", f"{b}_{c}"))
    changed = F.array_sort(F.array_distinct("old_prefilter")) != F.array_sort(F.array_distinct("new_prefilter"))
    out = pairs.select(
        "*", new("include", "new", "old").alias("added"), new("include", "old", "new").alias("removed"), new("exclude", "new", "old").alias("newly_excluded"), new("exclude", "old", "new").alias("no_longer_excluded"),
        changed.alias("prefilter_changed"), (F.col("old_content_sha256") != F.col("new_content_sha256")).alias("policy_text_changed"),
    )
    some: Column = F.lit(False)
    for c in ("added", "removed", "newly_excluded", "no_longer_excluded"):
        some = some | (F.size(c) > 0)
    known = F.col("old_content_sha256").isNotNull()
    out = out.withColumn("drifted", known & F.coalesce(some | F.col("prefilter_changed") | F.col("policy_text_changed"), F.lit(False)))
    # The words of the summary.
    words = (("added", "added"), ("removed", "removed"), ("newly_excluded", "newly excluded"), ("no_longer_excluded", "un-excluded"))
    bits = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(f" {w}"))) for c, w in words)))
    text = F.when(F.size(bits) > 0, F.array_join(bits, "; ")).when(F.col("policy_text_changed"), "policy text changed (asset list unchanged)").otherwise("scope drift")
    return out.withColumn("summary", F.when(F.col("drifted"), text).otherwise("no scope drift"))
