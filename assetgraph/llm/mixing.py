"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; a document's wished number of copies is target / words of its
source. The whole part is taken outright; the fraction is rounded by the pivotal method: two documents
with fractional probabilities p and q and sizes s and t meet, and mass s*dp = t*dq moves between them, at
random in one of the two directions with the odds that keep both expectations, until one probability is
0 or 1. So the words taken by a source change by nothing when two documents meet, and only the last one open
of a source, once rounded, leaves it off its target. Documents of its last meeting are then swapped between taken
and not taken, longest first, as long as each swap brings the source nearer; this is tried with the last one and each
of the TRIED longest ones fixed either way, and the nearest result stays.

The meetings form a reduction tree: rows are dealt by a hash into leaves of about ``leaf`` rows, each
leaf leaves one unsettled document over, and these meet again level by level until one is left per
source, which goes to the nearer side. A hot source has more leaves, never a larger one. All chance comes
from hashes of seed, source and leaf, and rows meet in a fixed order (long ones first, so that the last
one open tends to be short), so reruns agree.

Null and empty texts have size 0 and take 0 words. A null source is a source of its own, sorted last.
Repeated rows are rows like others. An empty table gives an empty table. Per source, one row reaches the
driver; documents never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.scratch import written

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
LEAF_ROWS = 4096
TRIED = 15
WORD = r"[^\x20\x09-\x0D]+"


def fill_targets(sizes: dict, weights: dict, total: float, most: float = MAX_COPIES) -> dict:
    """Shares of total by weight; a source stops at most times its size and the excess goes to the
    others by weight, until none is above."""
    target, free = {}, {s for s in sizes if sizes[s] > 0}
    target = {s: 0.0 for s in sizes}
    left = float(total)
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * unit > most * sizes[s]}
        if not over:
            target.update({s: weights[s] * unit for s in free})
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def pivot(p: np.ndarray, size: np.ndarray, chance: np.random.Generator) -> tuple[np.ndarray, int]:
    """Settle all but one of the probabilities p, keeping sum(p * size); returns them and the index of
    the unsettled one (-1: none)."""
    p = p.astype(float).copy()
    open_ = -1
    draws = chance.random(len(p))
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # words that can move from j to i
        down = min(p[i] * size[i], (1 - p[j]) * size[j])  # and from i to j
        moved = up if draws[j] * (up + down) < down else -down
        p[i] += moved / size[i]
        p[j] -= moved / size[j]
        done = [abs(x - round(x)) < 1e-9 for x in (p[i], p[j])]
        for k, settled in ((i, done[0]), (j, done[1])):
            if settled:
                p[k] = round(p[k])
        open_ = -1 if all(done) else (j if done[0] else i)
    return p, open_


def swapped(p: np.ndarray, before: np.ndarray, size: np.ndarray, fixed: int, side: float) -> np.ndarray:
    """p with one entry fixed at 0 or 1 and others, which are 0 or 1, flipped, largest size first, where this brings
    sum(p * size) nearer to sum(before * size); only those that were open before may flip."""
    p = p.copy()
    p[fixed] = side
    off = float((p * size).sum() - (before * size).sum())
    for k in np.lexsort((np.arange(len(p)), -size)):
        if k != fixed and 1e-12 < before[k] < 1 - 1e-12:
            moved = off + (1 - 2 * p[k]) * size[k]
            if abs(moved) < abs(off):
                p[k], off = 1 - p[k], moved
    return p


def _settle(seed: int, last: bool):
    """For applyInArrow on (source key, node): settled rows, with is_open marking the one left over."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[("words", "descending"), ("h", "ascending"), ("row_key", "ascending")])
        table = table.take(order)
        chance = np.random.default_rng(xxhash.xxh64_intdigest(repr([seed, *(k.as_py() for k in key)])))
        before, words = table["p"].to_numpy(), table["words"].to_numpy()
        p, left = pivot(before, words, chance)
        is_open = np.zeros(len(p), dtype=bool)
        if left >= 0 and last:
            p[left] = float(p[left] >= 0.5)
            # rows are in order of size
            tried = [left, *np.flatnonzero((before > 1e-12) & (before < 1 - 1e-12))[:TRIED]]
            p = min((swapped(p, before, words, k, side) for k in tried for side in (p[k], 1 - p[k])), key=lambda q: abs(((q - before) * words).sum()))
        elif left >= 0:
            is_open[left] = True
        names = table.column_names
        return table.set_column(names.index("p"), "p", pa.array(p)).append_column("is_open", pa.array(is_open))

    return run


def mix_sources(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, most: int = MAX_COPIES, share: float = 1.0, seed: int = 17, leaf: int = LEAF_ROWS, carry: list | None = None) -> DataFrame:
    """One row per row of df: id_col, size, source_size, target, copies, taken (= copies * size) and the
    columns in carry. Unique names are needed for the latter only."""
    rows = written(
        df.select(F.col(id_col).alias("row_key"), F.col(source).alias("__s"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("words"), *(carry or [])), "mix-sizes"
    )
    by = {r["__s"]: (r["n"], r["words"]) for r in rows.groupBy("__s").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    names = sorted(by, key=lambda s: (s is None, s or ""))
    wish = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = fill_targets({s: by[s][1] for s in names}, wish, share * sum(w for _, w in by.values()), most)
    fan = max(2, leaf // 2)
    spark = df.sparkSession
    plan = [(s, by[s][1], target[s], target[s] / by[s][1] if by[s][1] else 0.0, max(1, -(-by[s][0] // leaf))) for s in names]
    # one row per source, and as many sources as the driver has just held
    sources = spark.createDataFrame(plan, "__s string, source_size long, target double, rate double, leaves int")
    joined = rows.join(F.broadcast(sources) if len(plan) <= 100_000 else sources, rows["__s"].eqNullSafe(sources["__s"])).drop(sources["__s"])
    h = F.xxhash64(F.lit(seed), F.col("row_key").cast("string"))
    wide = joined.withColumns({"h": h, "whole": F.floor("rate").cast("int"), "p": F.col("rate") - F.floor("rate"), "node": F.pmod(F.xxhash64("h"), F.col("leaves")).cast("int")})
    wide = wide.withColumn("p", F.when(F.col("words") > 0, F.col("p")).otherwise(F.lit(0.0)))
    schema = ", ".join(f"`{c}` {t}" for c, t in wide.dtypes) + ", is_open boolean"
    levels, most_leaves = 0, max((p[4] for p in plan), default=1)
    while most_leaves > 1:
        most_leaves, levels = -(-most_leaves // fan), levels + 1
    done, todo = [], wide
    for level in range(levels + 1):
        last = level == levels
        settled = todo.groupBy("__s", "node").applyInArrow(_settle(seed + level, last), schema)
        if not last:
            settled = written(settled, f"mix-level{level}")
            todo = settled.where("is_open").drop("is_open").withColumn("node", F.floor(F.col("node") / fan).cast("int"))
        done.append(settled.where("not is_open"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("p").cast("int")
    return out.select(F.col("row_key").alias(id_col), F.col("words").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("words")).alias("taken"), *(c for c in rows.columns[3:]))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
