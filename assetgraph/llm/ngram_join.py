"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set is its distinct five-word shingles. Under any global order of shingles, sets r and s with
Jaccard similarity >= t share at least min(lr, ls) shingles among the first |x| - ceil(t|x|) + lx of each.
So a longer prefix (larger l) may ask for more shared shingles. Two orders are used:

1. Screen. In hash order, with l = 1 + |x| / SCREEN, each prefix shingle is counted over the corpus, and a
   text of which too few are found in another one is done: it has no link. Shingles go to the counting
   tasks as packed arrays; each mapper counts what repeats inside its own share and sends one of each, so
   a passage in every document costs one entry per mapper.
2. Copies collapse to one set. The sets that are left meet by a short prefix in hash order (HEAD shingles,
   of which HUB_MATCHES must be shared), and each is verified against a few hubs of every prefix shingle
   (those with the fewest shingles of their own), not against all sets that hold it: a large group of near
   copies becomes one component with verifications in proportion to its members. Of a member's verified
   links only the one to its least hub is kept; its other hubs are linked with that hub instead, once for
   all members, which leaves the same components. What was found is contracted before the next step.
3. Join between components. Only shingles that occur in two components matter; the others come first in
   the order and match nothing. Partners are told apart by size: each bin of partner sizes has its own
   least overlap, a set with fewer such shingles than that skips the bin, and otherwise its prefix length l
   is chosen by estimated cost: the postings read, plus the candidates that can still reach l matches, each
   with the cost of its verification. Postings meet first by component, so members of one component never pair. Every candidate with
   min(lr, ls) matches is verified on the full sets, so no link between different texts is lost.

Links are transitive in the result: a document's component is the smallest id reachable.

Null and empty texts (and texts of white space) have no shingle, no link, and themselves as component.
Texts with fewer than five words are one shingle. Repeated rows are copies like others; rows with equal id
have one row each in the result. Very long texts are handled alone. Ids must be integers. Other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.llm import words as W
from assetgraph.llm.components import connected
from assetgraph.llm.scratch import discard, written

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 75
SCREEN = 6
#: Counting tasks: one for each PART_BYTES of text, between the two numbers.
PART_BYTES = 8 << 20
MIN_PARTS, MAX_PARTS = 64, 1 << 18
#: Shingles that a mapper holds before it sends them, at least; and for each counting task.
HELD, HELD_EACH = 400_000, 8
#: Shingles of the short prefix by which sets meet their hubs.
HEAD = 6
HUB_ROUNDS = 2
#: Hubs of a prefix shingle, at most: one per slot, so the original is a hub even where near copies tie with it.
HUB_SLOTS = 8
#: Prefix shingles that a set and a hub have in common, at least (others are left to the join).
HUB_MATCHES = 2
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 20.0
#: Sizes are binned by steps of this ratio.
BIN_RATIO = 1.05


def _bin_edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BIN_RATIO)))
    return np.array(edges, np.int64)


EDGES = _bin_edges()


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending within it, and where each document's begin."""
    low = W.lower(raw)
    starts, ends, first = W.spans(low, off, W.NOT_SPACE)
    h = W.span_hashes(low, starts, ends)
    docs = len(off) - 1
    words = np.diff(first)
    inside = np.flatnonzero(W.window_starts(first, n))
    s = W.window_hashes(h, n)[inside] if len(inside) else np.zeros(0, np.uint64)
    doc = W.owners(first)[inside]
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        whole = np.array([W.window_hashes(h[first[d] : first[d + 1]], int(words[d]))[0] + np.uint64(words[d]) for d in short], np.uint64)
        s, doc = np.r_[s, W.mix(whole)], np.r_[doc, short]
        order = np.argsort(doc, kind="stable")
        s, doc = s[order], doc[order]
    begin = np.searchsorted(doc, np.arange(docs + 1))
    for a, b in zip(begin[:-1], begin[1:]):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=docs))].astype(np.int64)


def least_overlap(n, percent: int = PERCENT):
    return -(-(n * percent) // 100)


def screen_length(n):
    return 1 + n // SCREEN


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return (total[begin[1:]] - total[begin[:-1]]).astype(np.int64)


_SCAN = "kind int, rid long, id long, th long, n int, fp1 long, fp2 long, pid int, a binary, b binary"


def _scan(parts: int, percent: int):
    """Rows of kind 0: a document; 1: packed shingles for counting task pid; 2: documents and how many of
    their prefix shingles the mapper itself found twice or more."""
    names = [x.split(" ")[0] for x in _SCAN.split(", ")]

    def table(rows, **given):
        kinds = {"kind": pa.int32(), "n": pa.int32(), "pid": pa.int32(), "a": pa.binary(), "b": pa.binary()}
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, kinds.get(c, pa.int64())) for c in names], names=names)

    def flush(tokens, rids):
        t, r = np.concatenate(tokens), np.concatenate(rids)
        order = np.argsort(t, kind="stable")
        t, r = t[order], r[order]
        first = np.r_[True, t[1:] != t[:-1]]
        many = ~first
        many[:-1] |= ~first[1:]
        if many.any():
            own, count = np.unique(r[many], return_counts=True)
            yield table(1, kind=pa.array([2], pa.int32()), a=pa.array([own.astype("<i8").tobytes()], pa.binary()), b=pa.array([count.astype("<i4").tobytes()], pa.binary()))
        t, r = t[first], np.where(many, -1, r)[first]
        pid = ((t >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
        order = np.lexsort((r, pid))
        t, r, pid = t[order], r[order], pid[order]
        cut = np.searchsorted(pid, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        yield table(
            len(some), kind=pa.array(np.ones(len(some), np.int32)), pid=pa.array(some.astype(np.int32)),
            a=pa.array([np.ascontiguousarray(t[cut[p] : cut[p + 1]].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for p in some], pa.binary()),
            b=pa.array([r[cut[p] : cut[p + 1]].astype("<i8").tobytes() for p in some], pa.binary()),
        )

    def run(it):
        tokens, rids, held = [], [], 0
        for batch in it:
            rid_all = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, raw, off in W.chunks(batch.column(0)):
                s, begin = shingle_sets(raw, off)
                n, rid = np.diff(begin), rid_all[i:j]
                docs = j - i
                yield table(
                    docs, kind=pa.array(np.zeros(docs, np.int32)), rid=pa.array(rid), id=batch.column(1).slice(i, docs), th=batch.column(3).slice(i, docs), n=pa.array(n.astype(np.int32)),
                    fp1=pa.array(_sums(W.mix(s ^ np.uint64(0x1234567)), begin)), fp2=pa.array(_sums(W.mix(s + np.uint64(0xABCDEF12345)), begin)),
                )
                length = np.minimum(n, n - least_overlap(n, percent) + screen_length(n))
                place = np.arange(len(s)) - np.repeat(begin[:-1], n)
                take = place < np.repeat(length, n)
                tokens.append(W.mix(s[take] + np.uint64(0x5851F42D4C957F2D)))
                rids.append(np.repeat(rid, length))
                held += len(tokens[-1])
                if held >= max(HELD, HELD_EACH * parts):
                    yield from flush(tokens, rids)
                    tokens, rids, held = [], [], 0
        if held:
            yield from flush(tokens, rids)

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of one counting task: documents and how many of their shingles occur twice or more in it."""
    raw = np.frombuffer(b"".join(x.as_py() for x in table["a"]), np.uint8).reshape(-1, 5)
    t = np.zeros((len(raw), 8), np.uint8)
    t[:, :5] = raw
    r = np.frombuffer(b"".join(x.as_py() for x in table["b"]), "<i8")
    own, count = np.unique(r[W.repeated(t.view("<u8").ravel()) & (r >= 0)], return_counts=True)
    return pa.table({"rid": pa.array(own.astype(np.int64)), "shared": pa.array(count.astype(np.int64))})


def _unpack(it):
    for batch in it:
        r = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), "<i8")
        n = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), "<i4")
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(n.astype(np.int64))], names=["rid", "shared"])


def screen(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(documents, survivors): documents (rid, id, th, n, fp1, fp2), survivors (rid, lack), lack being the
    share of prefix shingles that no other document has."""
    size = docs.select(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    parts = min(MAX_PARTS, max(MIN_PARTS, size // PART_BYTES))
    rows = docs.select(docs[text_col].alias("text"), docs[id_col].cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), F.xxhash64(docs[text_col]).alias("th"))
    scanned = written(rows.mapInArrow(_scan(parts, percent), _SCAN), "shingles")
    documents = written(scanned.where("kind = 0").select("rid", "id", "th", "n", "fp1", "fp2"), "documents")
    counted = scanned.where("kind = 1").select("pid", "a", "b").groupBy("pid").applyInArrow(_shared, "rid long, shared long")
    counted = counted.unionByName(scanned.where("kind = 2").select("a", "b").mapInArrow(_unpack, "rid long, shared long"))
    # a partner may be smaller by the similarity, and then asks for fewer shared shingles
    n = F.col("n").cast("long")
    need = 1 + F.floor(F.ceil(n * percent / 100) / SCREEN)
    shared = counted.groupBy("rid").agg(F.sum("shared").alias("shared"))
    alive = documents.join(shared, "rid").where(F.col("shared") >= need)
    length = F.least(n, n - F.ceil(n * percent / 100) + 1 + F.floor(n / SCREEN))
    alive = alive.select("rid", F.round(1 - F.col("shared") / length, 4).alias("lack"))
    alive = written(alive, "survivors")
    discard(scanned)
    return documents, alive


def _full_sets(it):
    for batch in it:
        for i, j, raw, off in W.chunks(batch.column(0)):
            s, begin = shingle_sets(raw, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(begin).astype(np.int32)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(s.astype(np.int64)))],
                names=["rid", "lack", "n", "s"],
            )


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    left = pairs.select("a", "b").join(sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = both.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def spanning(links: DataFrame) -> DataFrame:
    """Fewer edges with the same components as the links (a, b) of members a with hubs b: a member keeps
    its least hub, and each other hub that it has is joined to that one, once for all members."""
    by = links.groupBy("a").agg(F.min("b").alias("hub"), F.collect_set("b").alias("hubs"))
    rest = by.select(F.explode("hubs").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    return by.select("a", F.col("hub").alias("b")).unionByName(rest)


def contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (rid, root) once the components of the links (a, b) are one."""
    ends = (roots.select(F.col("rid").alias(x), F.col("root").alias("r" + x)) for x in "ab")
    lifted = links.join(next(ends), "a").join(next(ends), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
    known = connected(lifted)
    return written(roots.join(known.select(F.col("v").alias("root"), F.col("root").alias("up")), "root", "left").select("rid", F.coalesce("up", "root").alias("root")), "roots")


def hub_links(sets: DataFrame, percent: int, rounds: int = HUB_ROUNDS) -> DataFrame:
    """(rid, root): the components by verified links of sets with hubs of their prefix shingles."""
    head = F.slice("s", 1, HEAD)
    keys = written(sets.select("rid", "lack", "n", head.alias("head"), F.explode(head).alias("token")), "prefixes")
    roots = sets.select("rid", F.col("rid").alias("root"))
    for turn in range(rounds):
        # first the sets with the fewest shingles of their own: the likely originals
        first = F.col("lack") if turn == 0 else F.xxhash64("rid", F.lit(turn))
        delegates = keys.join(roots, "rid").groupBy("token", "root").agg(F.min(F.struct(first.alias("first"), "rid", "n", "head")).alias("x"))
        delegates = written(delegates.select("token", "x"), "delegates")
        slot = F.pmod(F.xxhash64("x.rid", "token"), F.lit(HUB_SLOTS))
        hubs = written(delegates.groupBy("token", slot.alias("slot")).agg(F.min("x").alias("hub")).select("token", "hub"), "hubs")
        both = delegates.join(hubs, "token").where("x.rid <> hub.rid").where(F.least("x.n", "hub.n") * 100 >= F.greatest("x.n", "hub.n") * percent)
        pairs = both.where(F.size(F.array_intersect("x.head", "hub.head")) >= HUB_MATCHES).select(F.col("x.rid").alias("a"), F.col("hub.rid").alias("b"))
        pairs = pairs.groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.min(F.struct("b", "a")).alias("p"))  # of two hubs once
        found = written(verify(written(pairs.select("p.a", "p.b"), "pairs"), sets, percent), "links")
        roots = contracted(roots, spanning(found))
    return roots


def _cross(tokens: DataFrame) -> DataFrame:
    """(token, f) of the shingles that occur in two components or more; f counts their sets."""
    by = tokens.groupBy("token").agg(F.count("*").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return written(by.where("lo < hi").select("token", "f"), "cross-shingles")


def _choose_prefix(percent: int):
    """Of each set (rid, root, n, cross shingles with f), and for each bin of partner sizes in which it has
    enough cross shingles for a link: the prefix with the least estimated cost."""

    def run(it):
        for batch in it:
            rid, root, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            lists = batch.column(3)
            f_all, t_all = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            cut = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            who, own, partner, ells, tokens = [], [], [], [], []
            for d, n in enumerate(size.tolist()):
                f, t = f_all[cut[d] : cut[d + 1]], t_all[cut[d] : cut[d + 1]]
                most, least = len(f), int(least_overlap(n, percent))
                if most < least:
                    continue
                order = np.lexsort((t, f))
                t, postings = t[order], np.cumsum(f[order])
                mine = int(np.searchsorted(EDGES, n, "right")) - 1
                for k in range(int(np.searchsorted(EDGES, least, "right")) - 1, int(np.searchsorted(EDGES, n * 100 // percent, "right"))):
                    overlap = -(-percent * (n + max(int(EDGES[k]), least)) // (100 + percent))
                    if overlap > most:
                        break
                    options = [1 << e for e in range(overlap.bit_length()) if 1 << e <= overlap]
                    ell = min(options, key=lambda e: postings[most - overlap + e - 1] * (1 + VERIFY_COST / e))
                    who.append(d)
                    own.append(mine)
                    partner.append(k)
                    ells.append(ell)
                    tokens.append(t[: most - overlap + ell])
            own, partner = np.array(own, np.int32), np.array(partner, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid[who]), pa.array(root[who]), pa.array(size[who].astype(np.int32)), pa.array(np.array(ells, np.int32)), pa.array(np.minimum(own, partner)), pa.array(np.maximum(own, partner)),
                    pa.array(np.where(own == partner, 2, own > partner).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens]))),
                ],
                names=["rid", "root", "n", "ell", "low", "high", "side", "tokens"],
            )

    return run


def cross_links(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All links between sets of different components."""
    owned = written(sets.select("rid", "n", "s").join(roots.hint("merge"), "rid"), "owned")
    n = F.col("n").cast("long")
    # the screen again, now counting only what occurs in two components
    length = F.least(n, n - F.ceil(n * percent / 100) + 1 + F.floor(n / SCREEN)).cast("int")
    tokens = owned.select("rid", "root", F.explode(F.slice("s", F.lit(1), length)).alias("token"))
    met = tokens.join(_cross(tokens).select("token"), "token").groupBy("rid").agg(F.count("*").alias("shared"))
    left = owned.join(met, "rid").where(F.col("shared") >= 1 + F.floor(F.ceil(n * percent / 100) / SCREEN)).drop("shared")
    left = written(left, "cross-sets")
    discard(owned)
    tokens = left.select("rid", "root", "n", F.explode("s").alias("token"))
    lists = tokens.join(_cross(tokens), "token").groupBy("rid").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.collect_list(F.struct("f", "token")).alias("cross"))
    chosen = lists.select("rid", "root", "n", "cross").mapInArrow(_choose_prefix(percent), "rid long, root long, n int, ell int, low int, high int, side int, tokens array<long>")
    posts = written(chosen.select("rid", "root", "n", "ell", "low", "high", "side", F.explode("tokens").alias("token")), "postings")
    # a pair of bins meets once: the smaller set's bin as side 0, the larger's as 1, equal bins as 2
    key = ["token", "low", "high"]
    held = written(posts.groupBy(*key, "side", "root").agg(F.count("*").alias("f")), "held")
    one, other = (held.where(F.col("side") != k).select(*key, "side", F.col("root").alias(name)) for k, name in ((1, "ra"), (0, "rb")))
    meet = one.join(other.drop("side"), key).where(F.when(F.col("side") == 2, F.col("ra") < F.col("rb")).otherwise(F.col("ra") != F.col("rb"))).drop("side")
    a = posts.where("side <> 1").select(*key, F.col("root").alias("ra"), F.col("rid").alias("a"), F.col("n").alias("na"), F.col("ell").alias("la"))
    b = posts.where("side <> 0").select(*key, F.col("root").alias("rb"), F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("ell").alias("lb"))
    both = meet.join(a, [*key, "ra"]).join(b, [*key, "rb"]).where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("matches"), F.first(F.least("la", "lb")).alias("need")).where("matches >= need")
    return written(verify(written(pairs.select("a", "b"), "cross-pairs"), sets, percent), "cross-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id_col, th (text hash), n_shingles, component_id, is_first (the row that
    stays if one document of each component does)."""
    W.bound_batches(docs)
    documents, alive = screen(docs, id_col, text_col, percent)
    living = written(documents.join(alive, "rid"), "living")
    reps = written(living.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("rid", "id", "th", "lack")).alias("x")).select("fp1", "fp2", "n", "x.*"), "distinct-sets")
    texts = docs.select(docs[text_col].alias("text"), docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("th"))
    wanted = reps.select("rid", "lack", F.col("id").alias("i"), F.col("th").alias("t"))
    # a table that grows with the corpus: merged at every size, so that a small run tells of a large one
    texts = texts.join(wanted.hint("merge"), texts["id"].eqNullSafe(wanted["i"]) & (texts["th"] == wanted["t"])).select("text", "rid", "lack").dropDuplicates(["rid"])
    sets = written(texts.mapInArrow(_full_sets, "rid long, lack double, n int, s array<long>"), "sets")
    roots = hub_links(sets, percent)
    roots = contracted(roots, cross_links(sets, roots, percent))
    rooted = written(reps.join(roots, "rid").select("fp1", "fp2", "n", "root"), "rooted")
    member = written(living.join(rooted, ["fp1", "fp2", "n"]).select("rid", "id", "root"), "members")
    heads = written(member.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("head")).select("root", F.col("head.id").alias("component_id"), F.col("head.rid").alias("head")), "heads")
    placed = member.join(heads, "root").select("rid", "component_id", (F.col("rid") == F.col("head")).alias("is_first"))
    out = documents.join(placed, "rid", "left")
    return out.select(F.col("id").alias(id_col), "th", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("is_first", F.lit(True)).alias("is_first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest id (null only where all are
    null). Of rows that repeat it in id and text one stays. Columns as before, whatever their names."""
    rows = jaccard_components(docs, id_col, text_col, percent).select(F.col(id_col).alias("i"), F.col("th").alias("t"), "is_first")
    first = written(rows.groupBy("i", "t").agg(F.max("is_first").alias("first"), F.count("*").alias("n")).where("first"), "first")
    whole = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    once = whole.join(first.where("n = 1"), same, "left_semi").select("row.*")
    repeated = first.where("n > 1")
    if repeated.isEmpty():
        return once
    w = Window.partitionBy("id", "th").orderBy(F.lit(0))
    return once.unionByName(whole.join(repeated, same).withColumn("k", F.row_number().over(w)).where("k = 1").select("row.*"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
