"""Benchmark decontamination with a distributed positional inverted index.

The terms are lower-cased words (digits, a-z and everything beyond ASCII). One pass over the corpus stores the postings of
all its terms: per term and run of documents the documents and the positions, packed. The index is made once, and any
number of benchmarks can be asked against it. Every run of ``window`` words of a benchmark item (all words of a shorter
item) is a phrase. The index itself tells how often each term occurs; the lists of a phrase's two rarest terms, shifted by
the terms' offsets, are intersected by a join on (phrase, document, start), and what is left is verified word by word
against the document, which gives the exact phrase matches. Where the two terms stand up to SLACK words closer or
further than in the phrase, or in the other order, and the phrase itself does not, it is a proximity match.

Nothing of the corpus or of the benchmark passes through the driver. The benchmark's side of a join is broadcast where it
has at most SMALL rows, and merged beyond that.

Null, empty and wordless texts have no words and no hits. Rows are known by id and text hash: repeated
rows get equal results, and so do rows that share an id only. A null id is an id. Items without words, and
an empty benchmark, hit nothing; an item without an id hits words but is not counted or named; an empty table
gives an empty table. Only the id and text columns are read. Very long texts are handled one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm import words as W
from assetgraph.llm.scratch import discard, written

WINDOW = 13
#: Rows of the benchmark's side that are broadcast, at most; each has some 100 bytes.
SMALL = 200_000
#: Postings that an indexing task holds before it writes them.
HELD = 2_000_000
#: Shifted postings that a task sends at once (more if one list of postings has more), 32 bytes each.
SHIFTED = 1 << 18
#: Words by which the distance of two terms may differ in a proximity match.
SLACK = 5
#: A document is contaminated if SHARE times its hit words are at least its words.
SHARE = 20


def phrases(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, terms, items): each distinct run of window words, its term hashes, and the items that
    hold it, as sorted strings."""

    def cut(it):
        for batch in it:
            for i, _, raw, off in W.chunks(batch.column(0)):
                low = W.lower(raw)
                starts, ends, first = W.spans(low, off, W.ALNUM)
                h = W.span_hashes(low, starts, ends).astype(np.int64)
                item, terms = [], []
                for d in range(len(off) - 1):
                    own = h[first[d] : first[d + 1]]
                    n = min(window, len(own))
                    for k in range(len(own) - n + 1 if n else 0):
                        item.append(batch.column(1)[i + d].as_py())
                        terms.append(own[k : k + n])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array([t.tolist() for t in terms], pa.list_(pa.int64()))], names=["item", "terms"])

    rows = benchmark.select(benchmark[text_col], benchmark[item_col].cast("string")).mapInArrow(cut, "item string, terms array<long>")
    return rows.groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("phrase", F.xxhash64("terms"))


def _held(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index, written. Rows of kind 0: a row of docs, numbered (rid, id, th the text's hash, n words). Rows of
    kind 1: n postings of a term, as the documents' numbers, counted from rid, and their positions: two bytes each where all of
    a task's fit, else four."""
    W.bound_batches(docs)
    rows = docs.select(docs[text_col].alias("text"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), F.monotonically_increasing_id().alias("rid"))
    kind = rows.schema["id"].dataType.simpleString()

    def flush(terms, owners, places):
        def joined(parts):
            whole = np.concatenate(parts)
            parts.clear()  # what was held is not held twice
            return whole

        t = joined(terms)
        order = np.argsort(t, kind="stable")  # documents and positions stay in order
        t = t[order]
        d, p = joined(owners)[order], joined(places)[order]
        cut = np.r_[np.flatnonzero(np.r_[True, t[1:] != t[:-1]]), len(t)].astype(np.int64)

        def binary(x):
            x = x.astype("<u2" if x.max() < 1 << 16 else "<u4")
            return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

        return t[cut[:-1]].astype(np.int64), np.diff(cut).astype(np.int32), binary(d), binary(p)

    def run(it):
        base, last, held, terms, owners, places, id_type = None, -1, 0, [], [], [], None

        def postings():
            t, n, d, p = flush(terms, owners, places)
            nulls = lambda k: pa.nulls(len(t), k)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int32)), pa.array(np.full(len(t), base)), nulls(id_type), nulls(pa.int64()), pa.array(n), pa.array(t), d, p], names=["kind", "rid", "id", "th", "n", "term", "docs", "places"])

        for batch in it:
            id_type, rids = batch.column(1).type, batch.column(3).to_numpy(zero_copy_only=False)
            for i, j, raw, off in W.chunks(batch.column(0)):
                low = W.lower(raw)
                starts, ends, first = W.spans(low, off, W.ALNUM)
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), pa.array(rids[i:j]), batch.column(1).slice(i, n), batch.column(2).slice(i, n), pa.array(np.diff(first).astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                    names=["kind", "rid", "id", "th", "n", "term", "docs", "places"],
                )
                if base is not None and (held >= HELD or rids[j - 1] - base >= 1 << 31):
                    yield postings()
                    base, held, terms, owners, places = None, 0, [], [], []
                if len(starts):
                    base = rids[i] if base is None else base
                    doc = W.owners(first)
                    terms.append(W.span_hashes(low, starts, ends))
                    owners.append((rids[i:j][doc] - base).astype(np.int32))
                    places.append((np.arange(len(starts)) - first[doc]).astype(np.int32))
                    held += len(starts)
        if held:
            yield postings()

    return written(rows.mapInArrow(run, f"kind int, rid long, id {kind}, th long, n int, term long, docs binary, places binary"), "positional-index", "zstd")


def choose_anchors(index: DataFrame, found: DataFrame) -> DataFrame:
    """(term, at: array of (phrase, rank, offset, need)): the two rarest terms of each phrase that the corpus may hold; need
    is how many terms the phrase has here."""
    worded = found.select("phrase", F.size("terms").alias("width"), F.posexplode("terms").alias("offset", "term"))
    wanted = worded.select("term").distinct()
    counts = index.where("kind = 1").select("term", "n").join(_held(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("seen"))
    # a phrase with a term that the corpus lacks cannot occur
    by = worded.join(counts, "term").groupBy("phrase", "width").agg(F.array_sort(F.collect_list(F.struct("seen", "offset", "term"))).alias("order")).where(F.size("order") == F.col("width"))
    two = by.select("phrase", F.slice("order", 1, 2).alias("two")).select("phrase", F.size("two").alias("need"), F.posexplode("two").alias("rank", "a"))
    return written(two.groupBy("a.term").agg(F.collect_list(F.struct("phrase", (F.col("rank") + 1).alias("rank"), F.col("a.offset").alias("offset"), "need")).alias("at")), "anchors")


def anchored(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(phrase, rank, need, rid, start): where a phrase would start if its anchor is at a posting."""
    met = index.where("kind = 1").select("term", "rid", "n", "docs", "places").join(_held(anchors), "term")

    def shift(it):
        for batch in it:
            rid, n, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(4).to_pylist(), batch.column(3)
            for k in range(len(rid)):
                packed = (batch.column(c)[k].as_buffer() for c in (1, 2))
                docs, places = (np.frombuffer(x, f"<u{x.size // n[k]}").astype(np.int64) for x in packed)
                at = lists[k].values
                phrase, rank, offset, need = (at.field(c).to_numpy(zero_copy_only=False) for c in range(4))
                each = max(1, SHIFTED // len(docs))
                for a in range(0, len(phrase), each):
                    part = slice(a, a + each)
                    m = len(phrase[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(phrase[part], len(docs))), pa.array(np.repeat(rank[part], len(docs))), pa.array(np.repeat(need[part], len(docs))), pa.array(np.tile(docs + rid[k], m)), pa.array(np.tile(places, m) - np.repeat(offset[part].astype(np.int64), len(docs)))],
                        names=["phrase", "rank", "need", "rid", "start"],
                    )

    return met.select("rid", "docs", "places", "at", "n").mapInArrow(shift, "phrase long, rank int, need int, rid long, start long")


def phrase_candidates(lists: DataFrame) -> DataFrame:
    """(phrase, rid, start) where all anchors of a phrase stand at their offsets."""
    met = lists.where("start >= 0").groupBy("phrase", "rid", "start").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return met.where("n = need").select("phrase", "rid", "start")


def proximity_matches(lists: DataFrame, slack: int = SLACK) -> DataFrame:
    """(phrase, rid, distance): the phrase's two rarest terms occur, with a distance that differs from the phrase's by
    distance <= slack words, in either order."""
    # starts fall into buckets of slack + 1; a partner is in the same or an adjacent one
    a = lists.where("rank = 1 and need = 2").withColumn("bucket", F.explode(F.array(*((F.floor(F.col("start") / (slack + 1)) + k) for k in (-1, 0, 1)))))
    b = lists.where("rank = 2").withColumn("bucket", F.floor(F.col("start") / (slack + 1))).withColumnRenamed("start", "other")
    both = a.join(b.drop("rank", "need"), ["phrase", "rid", "bucket"]).withColumn("distance", F.abs(F.col("start") - F.col("other")))
    return both.where(F.col("distance") <= slack).groupBy("phrase", "rid").agg(F.min("distance").alias("distance"))


def _verify(it):
    """Of texts with candidates (start, terms, items): word positions in verified ones, and their items."""
    for batch in it:
        rows, hits, items = [], [], []
        for i, j, raw, off in W.chunks(batch.column(0)):
            low = W.lower(raw)
            starts, ends, first = W.spans(low, off, W.ALNUM)
            h = W.span_hashes(low, starts, ends).astype(np.int64)
            for d in range(j - i):
                own = h[first[d] : first[d + 1]]
                hit, held = np.zeros(len(own), bool), set()
                for start, terms, named in zip(*(batch.column(3)[i + d].values.field(c) for c in range(3))):
                    start, terms = start.as_py(), terms.values.to_numpy(zero_copy_only=False)
                    if np.array_equal(own[start : start + len(terms)], terms):
                        hit[start : start + len(terms)] = True
                        held.update(named.as_py())
                if hit.any():
                    rows.append(i + d)
                    hits.append(np.flatnonzero(hit).astype(np.int32))
                    items.append(sorted(held))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["id", "th", "hit_at", "items"])


def phrase_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, index: DataFrame | None = None, slack: int = SLACK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, near): rows (id, th, n_words) one per row of docs; hits (id, th, hit_at, items), the word positions inside any
    phrase and the items that it is from; near (id, th, item) by proximity."""
    W.bound_batches(docs)
    own = index is None
    index = build_index(docs, id_col, text_col) if own else index
    rows = written(index.where("kind = 0").select("rid", "id", "th", F.col("n").cast("long").alias("n_words")), "rows")
    found = written(phrases(benchmark, item_col, item_text, window), "phrases")
    lists = written(anchored(index, choose_anchors(index, found)), "lists", "zstd")
    if own:
        discard(index)
    candidates = written(phrase_candidates(lists), "candidates")
    told = _held(found.select("phrase", "terms", "items"))
    numbered = rows.select("rid", "id", "th")
    # copies of a row are one text
    at = candidates.join(told, "phrase").join(numbered, "rid").groupBy("id", "th").agg(F.collect_set(F.struct("start", "terms", "items")).alias("at"))
    at = written(at, "places")
    texts = docs.select(docs[text_col].alias("text"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"))
    # at grows with the corpus: merged at every size
    joined = texts.join(at.hint("merge"), texts["id"].eqNullSafe(at["id"]) & (texts["th"] == at["th"])).select(texts["text"], texts["id"], texts["th"], at["at"])
    hits = joined.mapInArrow(_verify, f"id {rows.schema['id'].dataType.simpleString()}, th long, hit_at array<int>, items array<string>")
    close = proximity_matches(lists, slack).join(candidates.select("phrase", "rid").distinct(), ["phrase", "rid"], "left_anti")
    near = close.join(told.select("phrase", "items"), "phrase").join(numbered, "rid").select("id", "th", F.explode("items").alias("item")).distinct()
    return rows.drop("rid"), hits, near


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, index: DataFrame | None = None, proximity: bool = True) -> DataFrame:
    """One row per row of docs: id_col, th, n_words, n_hit, items (sorted strings), contaminated and, unless left out, near_items
    (items with proximity matches). An index of docs that was built before can be given."""
    rows, hits, near = phrase_hits(docs, benchmark, id_col, text_col, item_col, item_text, window, index)
    by = hits.groupBy("id", "th").agg(F.first("hit_at").alias("hit_at"), F.first("items").alias("items"))  # copies agree
    same = lambda: F.col("id").eqNullSafe(F.col("__i")) & F.col("th").eqNullSafe(F.col("__t"))
    out = rows.join(by.withColumnsRenamed({"id": "__i", "th": "__t"}), same(), "left").drop("__i", "__t")
    if proximity:
        out = out.join(near.groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("near")).withColumnsRenamed({"id": "__i", "th": "__t"}), same(), "left")
    n_hit = F.when(F.col("hit_at").isNull(), 0).otherwise(F.size("hit_at")).cast("long")
    none = F.array().cast("array<string>")
    more = [F.coalesce("near", none).alias("near_items")] if proximity else []
    return out.select(F.col("id").alias(id_col), "th", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), *more)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; columns as before, whatever their names."""
    bad = decontaminate(docs, benchmark, id_col, text_col, proximity=False).where("contaminated").select(F.col(id_col).alias("i"), F.col("th").alias("t"))
    whole = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    return whole.join(bad.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_anti").select("row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near")
    )
