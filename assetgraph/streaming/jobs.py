"""Streaming forms of the log projections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from assetgraph.functions.confidence import parse_duration
from assetgraph.operators import report
from assetgraph.operators.fold import CORROBORATION, comparable


def stream_dedupe(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """At most one event per idempotency key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["idempotency_key"])


#: Counters of a run's delta by kind of event, and the payload field that a counter is told by, if any.
_COUNTERS = {
    "edges_created": ("edge_upserted", "outcome = 'created'", None), "nodes_created": ("node_upserted", "outcome = 'created'", "type"), "nodes_merged": ("node_upserted", "coalesce(outcome, '') <> 'created'", "type"), "forks": ("contradiction_forked", "true", None),
    "gaps_dispatched": ("gap_dispatched", "true", None), "refusals": ("gate_decision_recorded", "decision = 'REFUSE'", None), "rate_debits": ("rate_debit", "true", "target"), "third_party_debits": ("third_party_debit", "true", "source"),
    "violations": ("invariant_violation", "true", None), "drifts": ("scope_drift_detected", "true", None), "halts": ("loop_halted", "true", None),
}


def stream_run_delta(events: DataFrame) -> DataFrame:
    """Running counters of a stream of events (seq, ts, run_id, kind, and of the payload report.FIELDS): (run_id, counter, key, n,
    first, last), key being a type, a target or a source where a counter has one, first and last the earliest and latest
    (seq, text) of what is counted. Write in update mode, through upsert_counters()."""
    rows = report.whole(events)
    pick = lambda x: F.expr(f"kind = '{x[0]}' and coalesce({x[1]}, false)")
    told = [F.when(pick(x), F.struct(F.lit(name).alias("counter"), (F.coalesce(x[2], F.lit("?")) if x[2] else F.lit("")).alias("key"))) for name, x in _COUNTERS.items()]
    named = F.when(pick(_COUNTERS["nodes_created"]) & report.notable(F.col("id")).isNotNull(), F.struct(F.lit("notable").alias("counter"), F.lit("").alias("key")))
    every = F.struct(F.lit("events").alias("counter"), F.lit("").alias("key"))
    text = F.when(F.col("kind") == "invariant_violation", F.coalesce("code", F.lit("?"))).when(F.col("kind") == "loop_halted", F.col("reason"))
    rows = rows.select("run_id", "seq", "ts", text.alias("text"), F.explode(F.array_compact(F.array(every, named, *told))).alias("c"))
    at = F.struct("seq", F.when(F.col("c.counter") == "events", F.col("ts")).otherwise(F.col("text")).alias("text"))
    return rows.groupBy("run_id", "c.counter", "c.key").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def upsert_counters(path: str):
    """For foreachBatch: a batch's changed counters, under its number; a batch that is run again replaces what it wrote."""

    def put(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return put


def counters(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each counter that upsert_counters() wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy("run_id", "counter", "key").agg(F.max_by(F.struct("n", "first", "last"), "batch").alias("x")).select("run_id", "counter", "key", "x.*")


def run_delta_of(told: DataFrame) -> DataFrame:
    """report.run_delta() from counters()."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col("counter") == name, F.col("n"))), F.lit(0)).alias(name)
    one = lambda name, end: F.max(F.when(F.col("counter") == name, F.col(end)["text"]))
    sums = [of(x) for x in (*(c for c in _COUNTERS if c != "halts"), "notable")]
    out = told.groupBy("run_id").agg(*sums, one("violations", "first").alias("first_violation"), F.coalesce(one("halts", "last"), F.lit("")).alias("halted_because"), one("events", "first").alias("first_ts"), one("events", "last").alias("last_ts"))
    return out.withColumn("quiet", report.quiet())


def run_delta_by_type_of(told: DataFrame) -> DataFrame:
    """report.run_delta_by_type() from counters()."""
    rows = told.where(F.col("counter").isin("nodes_created", "nodes_merged")).groupBy("run_id", F.col("key").alias("type"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("counter") == name, F.col("n"))), F.lit(0))
    return rows.agg(of("nodes_created").alias("created"), of("nodes_merged").alias("merged"))


UPSERTS = "id string, seq long, outcome string, node_id string, log_odds double, independent_sources int, n_evidence int, coverage array<string>, verdict string, snapshot_id string"
_HEAD = "seq long, log_odds double, sources int, proofs int, forks int, verdict string, snapshot_id string"
#: Columns that a stream of observations may have, and what stands for them.
_MORE = {"sha256": "cast(null as string)", "coverage": "cast(map() as map<string,boolean>)", "verdict": "cast(null as string)", "snapshot_id": "cast(null as string)", "binding": "false"}


class FoldState(StatefulProcessor):
    """The base of an id: a row of numbers, and maps of attributes, sources, evidence and coverage, of which only the entries that
    an observation names are read and written."""

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", _HEAD)
        self.attrs = handle.getMapState("attrs", "k string", "v string, same string")
        self.sources, self.proofs, self.cover = (handle.getMapState(name, "k string", "v boolean") for name in ("sources", "proofs", "cover"))

    def _add(self, held, names) -> int:
        """How many of names are new to a map."""
        new = [n for n in dict.fromkeys(names) if n and not held.containsKey((n,))]
        for n in new:
            held.updateValue((n,), (True,))
        return len(new)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self.head.update((r.seq, r.log_odds, r.independent_sources, len(r.evidence or []), r.forks, r.verdict, r.snapshot_id))
        for k, v, same in zip(r.names, r.texts, r.sames):
            self.attrs.updateValue((k,), (v, same))
        for held, names in ((self.sources, r.sources), (self.proofs, r.evidence), (self.cover, r.coverage)):
            self._add(held, names or [])

    def handleInputRows(self, key, rows, timerValues):
        seq, log_odds, sources, proofs, forks, verdict, snapshot = self.head.get() if self.head.exists() else (-1, 0.0, 0, 0, 0, None, None)
        for r in sorted(rows, key=lambda r: r.seq):
            outcome, node = "late", key[0]
            told = log_odds, sources, proofs
            if r.seq > seq:
                born, seq = seq < 0, r.seq
                if r.binding:
                    outcome = "skipped" if born else "bound"
                    verdict, snapshot, seq = (verdict, snapshot, -1) if born else (r.verdict, r.snapshot_id, seq)
                elif not born and any(same is not None and self.attrs.containsKey((k,)) and self.attrs.getValue((k,))[1] not in (None, same) for k, same in zip(r.names, r.sames)):
                    forks += 1
                    outcome, node = "forked", f"{key[0]}#fork{forks}"
                    told = 0.0, 1, int(bool(r.sha256))
                else:
                    new = self._add(self.sources, [r.source])
                    log_odds += CORROBORATION if new and not born else 0.0
                    sources, outcome = sources + new, "created" if born else "merged"
                    proofs += self._add(self.proofs, [r.sha256])
                    self._add(self.cover, r.covered)
                    for k, v, same in zip(r.names, r.texts, r.sames):
                        if not self.attrs.containsKey((k,)):
                            self.attrs.updateValue((k,), (v, same))
                    if born:
                        verdict, snapshot = r.verdict, r.snapshot_id
                    told = log_odds, sources, proofs
            cover = sorted(r.covered) if outcome == "forked" else sorted(k[0] for k in self.cover.keys())
            bound = (r.verdict, r.snapshot_id) if outcome == "forked" else (verdict, snapshot)
            yield Row(id=key[0], seq=r.seq, outcome=outcome, node_id=node, log_odds=told[0], independent_sources=told[1], n_evidence=told[2], coverage=cover, verdict=bound[0], snapshot_id=bound[1])
        if seq >= 0:
            self.head.update((seq, log_odds, sources, proofs, forks, verdict, snapshot))

    def close(self) -> None:
        pass


def _facts() -> list[Column]:
    """names, texts and sames: the attributes, their JSON texts, and what of these can contradict."""
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    return [F.map_keys(attrs).alias("names"), F.map_values(attrs).alias("texts"), F.transform(F.map_values(attrs), comparable).alias("sames")]


def _covered() -> Column:
    return F.coalesce(F.transform(F.filter(F.map_entries("coverage"), lambda e: e["value"]), lambda e: e["key"]), F.array().cast("array<string>"))


def stream_project(observations: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """The fold of a stream of observations (seq, id, tool, rule_id, attrs map<string,string> and, where known, sha256, coverage,
    verdict, snapshot_id): for each row whether it created, merged or forked a node, by the rules of the batch fold, and what the
    node is then. A row with binding replaces a node's verdict and snapshot. Rows of a batch are taken in order of seq;
    one that comes after a later seq of its id is told as late and changes nothing: dead_letters() has them. graph: nodes of
    the batch fold to go on from. Write in append mode, with the RocksDB state store."""
    rows = observations.withColumns({c: F.expr(x) for c, x in _MORE.items() if c not in observations.columns})
    rows = rows.select("id", F.col("seq").cast("long").alias("seq"), *_facts(), F.concat_ws("/", "tool", "rule_id").alias("source"), "sha256", _covered().alias("covered"), "verdict", "snapshot_id", F.coalesce("binding", F.lit(False)).alias("binding"))
    before = None
    if graph is not None:
        base = graph.where("fork = 0").select("id", "base", "seq", "log_odds", "independent_sources", *_facts(), "sources", F.transform("evidence", lambda e: e["sha256"]).alias("evidence"), _covered().alias("coverage"), "verdict", "snapshot_id")
        forks = graph.groupBy("base").agg(F.max("fork").alias("forks"), F.max("last_seq").alias("last"))
        base = base.join(forks, "base").drop("base")
        before = base.withColumn("seq", F.col("last")).drop("last").groupBy("id")
    return rows.groupBy("id").transformWithState(FoldState(), UPSERTS, "append", "none", before)


def dead_letters(folded: DataFrame) -> DataFrame:
    """The rows of stream_project() that came too late to be folded."""
    return folded.where("outcome = 'late'")


class BucketState(StatefulProcessor):
    """The balance of a target's bucket; a bucket that has filled up again is forgotten, as a new one is full."""

    def __init__(self, qps: float, capacity: float) -> None:
        self.qps, self.capacity = qps, capacity

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double, full long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.bucket.get() if self.bucket.exists() else None
        tokens, last = (held[0], held[1]) if held else (self.capacity, None)
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            tokens = min(self.capacity, tokens + (0.0 if last is None else max(0.0, r.at - last) * self.qps))
            last, accepted = r.at, tokens >= r.cost
            tokens -= r.cost if accepted else 0.0
            yield Row(target=key[0], seq=r.seq, accepted=accepted, balance_after=tokens)
        full = int((last + (self.capacity - tokens) / self.qps) * 1000) + 1
        if held:
            self.handle.deleteTimer(held[2])
        self.bucket.update((tokens, last, full))
        self.handle.registerTimer(full)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.bucket.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_token_bucket(debits: DataFrame, qps: float, capacity: float, delay: str = "0 seconds") -> DataFrame:
    """audit.token_bucket() of a stream of debits (target, seq, at timestamp, cost) that arrive in order of time: (target, seq,
    accepted, balance_after), whatever batches they come in. Write in append mode, with the RocksDB state store."""
    rows = debits.withWatermark("at", delay).select("target", F.col("seq").cast("long").alias("seq"), F.col("at").alias("event_time"), F.col("at").cast("double").alias("at"), F.col("cost").cast("double").alias("cost"))
    kind = debits.schema["target"].dataType.simpleString()
    return rows.groupBy("target").transformWithState(BucketState(qps, capacity), f"target {kind}, seq long, accepted boolean, balance_after double", "append", "eventTime")


def stream_decay(nodes: DataFrame, half_lives: float = 2.0, delay: str = "0 seconds") -> DataFrame:
    """(id, gap_id, due) for each node (id, last_verified timestamp, half_life) that was not verified again within so many
    half-lives, once per time it falls due, as the watermark of last_verified passes. Write in append mode."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "gap_id": [f"reverify:{key[0]}"], "due": [due]})
            return
        due = max([due, *(int(x["due"].max()) for x in batches)])
        state.update((due,))
        # what the watermark has passed already falls due at its next step
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    due = (F.col("last_verified").cast("double") * 1000 + parse_duration(F.col("half_life")) * 1000 * half_lives).cast("long")
    rows = nodes.withWatermark("last_verified", delay).select("id", "last_verified", due.alias("due"))
    found = rows.groupBy("id").applyInPandasWithState(run, "id string, gap_id string, due long", "due long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("id", "gap_id", F.timestamp_millis("due").alias("due"))
