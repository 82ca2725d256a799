"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assetgraph.llm import decontamination, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, sharding, toxicity, warc
from assetgraph.llm import words as W

LONG = " ".join(f"w{k * 7919 % 5003}" for k in range(30_000))
PLAIN = "the quick brown fox jumps over the lazy dog and then it goes home to sleep for a while"
TEXTS = [(1, PLAIN), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, PLAIN), (6, PLAIN), (7, "123 ### 456"), (8, "a"), (None, "some text without an id"), (9, "É ü 日本語 " * 4)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, size long, id string, th string, key string, batch string, n string, pos string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i != 9 else "ja", ["a", "b", None][k % 3], 1, 2, "x", 3, "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Quick, BROWN fox jumps over the lazy dog and then it goes home"), (2, None), (3, "--"), (4, "日本語")], "item_id long, text string")


OPERATORS = {
    "line_dedup": lambda d, b, y: line_dedup.line_dedup(d),
    "decontamination": lambda d, b, y: decontamination.decontaminate(d, b),
    "ngram_join": lambda d, b, y: ngram_join.jaccard_components(d),
    "toxicity": lambda d, b, y: toxicity.toxicity(d, y),
    "mixing": lambda d, b, y: mixing.mix_sources(d),
    "sharding": lambda d, b, y: sharding.shard_rows(d),
    "quality_rules": lambda d, b, y: quality_rules.quality_rules(d),
    "language_id": lambda d, b, y: language_id.identify(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_and_none_for_an_empty_table(name, docs, none, benchmark, labels):
    assert sorted(r.doc_id or 0 for r in OPERATORS[name](docs, benchmark, labels).collect()) == sorted(i or 0 for i, _ in TEXTS)
    assert OPERATORS[name](none, benchmark, labels).collect() == []
    assert OPERATORS[name](none, benchmark.where("false"), labels.where("false")).collect() == []


def test_line_dedup(spark):
    long = "This line is long enough to count"
    docs = spark.createDataFrame([(1, f"{long}\nshort\nown one"), (2, f"  {long.upper()}\t\nshort\n{long}"), (3, f"x\n{long}"), (4, "short"), (None, long), (5, None)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: (3, 1, "short\nown one"), 2: (3, 2, "short"), 3: (2, 0, f"x\n{long}"), 4: (1, 0, "short"), None: (1, 1, ""), 5: (1, 0, "")}


def test_line_keys_fold_ascii_only_and_count_code_points(spark):
    row = spark.range(1).select(line_dedup.line_keys(F.lit("ÉA \n éa\nßẞ日本")).alias("k"))
    keys = row.first()["k"]
    assert keys[0] != keys[1] and len(set(keys)) == 3
    sizes = row.select(F.transform("k", line_dedup.code_points).alias("n")).first()["n"]
    assert sizes == [2, 2, 4]


def test_runs_are_compacted(spark):
    store = line_dedup.LineRuns(spark, fan=2)
    for k in range(5):
        store.add(spark.createDataFrame([(k, 0, 1, k), (99, 0, 1, k)], "h1 long, h2 long, n_docs long, max_id long"))
    assert [len(x) for x in store.levels] == [1, 0, 1] and len(store.hits) == 4
    totals = {r.h1: (r.n_docs, r.max_id) for r in store.totals().collect()}
    assert totals[99] == (5, 4) and totals[3] == (1, 3)
    store.drop()


def test_decontamination(docs, benchmark):
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, benchmark).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].items, got[1].contaminated) == (19, 13, ["1"], True)
    assert got[9].n_hit == 4 and got[9].items == ["4"]
    assert got[2].n_words == got[3].n_words == 0 and not got[2].contaminated
    assert got[5].n_hit == 0
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).where("doc_id in (1, 6, 9)").collect()] == []


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x x x x x x x beta"), (3, "alpha beta " + "x " * 40 + "gamma"), (4, "beta alpha"), (5, "alpha x beta"), (5, "alpha x beta")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "Alpha beta"), ("q", "gamma"), ("r", "beta zeta"), (None, "gamma")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.items, r.near_items) for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {1: (0, [], ["p"]), 2: (0, [], []), 3: (3, ["p", "q"], []), 4: (0, [], ["p"]), 5: (0, [], ["p"])}


def test_one_index_serves_many_benchmarks(spark, docs, benchmark):
    index = decontamination.build_index(docs)
    for part in (benchmark, benchmark.where("item_id = 4"), benchmark.where("false")):
        given, own = (sorted((r.doc_id or 0, r.n_hit, r.items) for r in decontamination.decontaminate(docs, part, index=i).collect()) for i in (index, None))
        assert given == own


@pytest.mark.parametrize("name", ["quality", "near_copies", "decontamination"])
def test_stages_hand_over_texts_in_small_batches(spark, tmp_path, benchmark, name):
    """Also what is read after a stage has returned; a bound that the session has of its own stays."""
    spark.createDataFrame([("q", PLAIN)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(4_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1_000).alias("text"))
    stage, known = dict(corpus_pipeline.STAGES)[name], spark.conf.get(W.BATCH_CONF, None)

    def sizes(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def largest():
        return max(r.n for r in docs.mapInArrow(sizes, "n long").collect())

    try:
        spark.conf.unset(W.BATCH_CONF)
        assert largest() > 4 * W.BATCH_BYTES
        stage(spark, docs.limit(3), str(tmp_path))
        assert largest() < 1.1 * W.BATCH_BYTES
        spark.conf.set(W.BATCH_CONF, str(1 << 20))
        stage(spark, docs.limit(3), str(tmp_path))
        assert largest() < 1.1 * (1 << 20)
    finally:
        spark.conf.unset(W.BATCH_CONF) if known is None else spark.conf.set(W.BATCH_CONF, known)


def test_ngram_join_on_copies_and_short_texts(docs):
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs).collect()}
    assert got[6].component_id == 1 and got[1].component_id == 1
    assert (got[2].n_shingles, got[2].component_id) == (0, 2) and got[4].n_shingles == 0 and got[4].component_id == 4
    assert got[8].n_shingles == 1 and got[8].component_id == 8
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id in (1, 6)").collect()) == [1]


def test_near_copies_with_null_ids_and_repeated_rows(spark):
    rows = [(None, PLAIN), (8, PLAIN + " x"), (7, PLAIN), (7, PLAIN), (9, "another text of more than five words"), (9, "another text of more than five words"), (None, "one more text without any id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.jaccard_components(docs).collect())
    assert got == [(0, 0), (0, 7), (7, 7), (7, 7), (8, 7), (9, 9), (9, 9)]
    left = ngram_join.drop_near_copies(docs)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 7, 9] and left.columns == docs.columns


def test_toxicity_restores_disguised_words(spark):
    pairs = [("idiot", "moron"), ("moron", "loser"), ("loser", "idiot")]
    clean = [(k, f"the day number{k} was fine you friend and every guest there") for k in range(60)]
    toxic = [(100 + k, "the day number{} was fine you {} and every {} there".format(k, *pairs[k % 3])) for k in range(60)]
    tests = [(1000, "well 1d10t and m0r0n you are"), (1001, "an i d i o t and a l o s e r"), (1002, "idiiiot moooron"), (1003, "the 3rd of 10 days"), (1004, None)]
    docs = spark.createDataFrame(clean + toxic + tests, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert [got[k] for k in (1000, 1001, 1002, 1003, 1004)] == [1, 1, 1, 0, 0]
    assert not any(got[i] for i, _ in clean) and all(got[i] for i, _ in toxic)


def test_toxicity_decodes_rows_of_any_single_characters(spark):
    pairs = [("idiot", "moron"), ("moron", "loser"), ("loser", "idiot"), ("дурак", "idiot")]
    clean = [(k, f"the day number{k} was fine you friend and every guest there in class") for k in range(200)]
    toxic = [(400 + k, "the day number{} was fine you {} and every {} there".format(k, *pairs[k % 4])) for k in range(200)]
    rows = [
        "i d 1 0 t", "m 0 r 0 n", "l 0 s 3 r", "i.d.1.0.t", "д у р а к", "d.у.r.а.k", "y o u i d i o t a n d m o r o n", "i d ! o t , l o s e r", "дурррак", "i d i o t" + " x" * 10_000,
        "3 5 7 1 0", "t h e d a y w a s f i n e", "1 a 3 b", "a | b | c |", "v1.0.4", "i d", "",
    ]
    docs = spark.createDataFrame(clean + toxic + [(1000 + k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    got = {r.doc_id: r.n_hidden for r in toxicity.toxicity(docs, labels).collect()}
    assert [got[1000 + k] for k in range(len(rows))] == [1, 1, 1, 1, 1, 0, 2, 2, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    assert not any(got[i] for i, _ in clean + toxic)


def test_pivot_keeps_the_sum_and_settles_all_but_one():
    rng = mixing.np.random.default_rng(1)
    for n in (1, 2, 50, 500):
        p, size = rng.random(n), rng.integers(1, 100, n)
        got, open_ = mixing.pivot(p, size, mixing.np.random.default_rng(2))
        assert (got * size).sum() == pytest.approx((p * size).sum())
        assert all(x in (0, 1) for k, x in enumerate(got) if k != open_)


def test_swaps_bring_a_long_last_document_to_its_target():
    np = mixing.np
    for seed in range(20):
        rng = np.random.default_rng(seed)
        size = np.r_[20_000, rng.integers(50, 900, 60)]
        before = np.full(61, rng.uniform(0.1, 0.9))
        p, left = mixing.pivot(before, size, rng)
        got = [mixing.swapped(p, before, size, left, side) for side in (0.0, 1.0)]
        assert all(set(x) <= {0.0, 1.0} for x in got) and min(abs(((x - before) * size).sum()) for x in got) <= 100


def test_targets_are_capped_and_reshared():
    got = mixing.fill_targets({"a": 10, "b": 10, "c": 1000}, {"a": 1, "b": 2, "c": 3}, 1020)
    assert got["a"] == 30 and got["b"] == 30 and got["c"] == pytest.approx(960)
    assert mixing.fill_targets({"a": 0}, {"a": 1}, 0) == {"a": 0.0}


def test_mixing_by_levels_agrees_with_itself_and_comes_near(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "a").alias("source"), F.expr("repeat('w ', cast(1 + id % 17 as int))").alias("text"))
    runs = [sorted(tuple(r) for r in mixing.mix_sources(docs, leaf=32).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 900
    by = {}
    for _, size, total, target, copies, taken in runs[0]:
        assert taken == copies * size <= 3 * size
        got = by.setdefault((total, target), [0])
        got[0] += taken
    assert all(abs(got[0] - target) <= 17 for (_, target), got in by.items())


def test_sharding_counts_and_slots(spark):
    got = sharding.shard_rows(spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), shards=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert {len(x) for x in by.values()} <= {143, 144} and all(sorted(x) == list(range(len(x))) for x in by.values())
    points, owner = sharding.ring(7)
    assert len(points) == 7 * sharding.VNODES and set(owner) == set(range(7))


def test_another_shard_moves_few_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    old, new = ({r.doc_id: r.shard for r in sharding.shard_rows(docs, shards=n).collect()} for n in (40, 41))
    moved = [i for i in old if old[i] != new[i]]
    assert len(moved) <= 0.06 * len(old) and sum(new[i] == 40 for i in moved) == 20_000 // 41


def test_cells_change_no_place(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("__x"))
    got = []
    for rows in (1 << 40, 64, 8):
        monkeypatch.setattr(sharding, "CELL_ROWS", rows)
        got.append(sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(docs, shards=5, vnodes=4).collect()))
    assert got[0] == got[1] == got[2]
    points, owner = sharding.ring(5, 4)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    own = {i: owner[sharding.np.searchsorted(points, h) % len(points)] for i, h in hashes.items()}
    room = collections.Counter(own.values())
    # a row leaves its owner only where that is full, and a shard with room takes all its own rows
    assert all(shard == own[i] or room[own[i]] > 600 for i, shard, _ in got[0])


def test_quality_verdicts(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, line), (2, "\n".join([line] * 5)), (3, "few words"), (4, None), (5, line + "\n" + PLAIN)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in range(1, 6)] == [True, False, False, False, True]
    assert got[2].n_dup_lines == 4 and got[2].n_repeat_words == 60
    kept = quality_rules.filter_quality(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5] and kept.columns == ["doc_id", "text"]


def test_language_mixture(spark):
    en, fr = "the house and the garden with many trees near this river", "le jardin et la maison avec beaucoup de fleurs sous cet arbre"
    rows = [(k, " ".join([en, fr][k % 2].split()[k % 4 :]), ["en", "fr"][k % 2]) for k in range(80)] + [(200, f"{en} {en} {fr}", None), (201, "12 34 !!", None), (202, None, None), (203, "—", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == ["en", "fr"][k % 2] for k in range(80))
    assert got[200].lang_pred == "en" and got[200].n_langs == 2
    assert [got[k].lang_pred for k in (201, 202, 203)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())


def test_warc_round_trip(spark):
    same = "<p>" + "é" * 200 + "</p>"
    rows = [(1, "http://a/", same), (2, None, same), (3, "http://b/\r\nX: y", "x"), (4, "http://c/", "x"), (5, "http://d/", None), (2, None, same), (6, "http://e/", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, index = warc.write_archives(pages)
    got = sorted(tuple(r) for r in warc.read_archives(folder, index).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((i, len((h or "").encode()), sha(h), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_archives(*warc.write_archives(pages.where("false"))).collect() == []


def test_warc_of_any_ids_and_clashing_columns(spark):
    rows = [("None", "a", "x"), (None, "b", "y"), ("a\r\nWARC-Type: revisit", "c", "z"), ("é %41", "d", "<p>" * 50), ("z: 1", "e", "<p>" * 50), (None, "f", "<p>" * 50)]
    pages = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "page_id string, url string, html string, payload string, digest string, refers string, name string")
    got = sorted((tuple(r) for r in warc.read_archives(*warc.write_archives(pages)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    first = min("é %41", "z: 1")
    want = [(i, len(h), "response" if len(h) < 100 or i == first else "revisit", None if len(h) < 100 or i == first else first) for i, _, h in rows]
    assert got == sorted(want, key=str)


def test_packing_round_trip(docs, none):
    rows = packing.pack_tokens(docs, length=512, group_bytes=1 << 16).collect()
    parts = {}
    for r in rows:
        ids, places = (packing.np.frombuffer(x, packing.np.uint16) for x in (r.ids, r.position_ids))
        assert len(ids) == len(places) == 512 and r.cu_seqlens[-1] == r.n_tokens <= 512
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts)):
            a, b = r.cu_seqlens[k : k + 2]
            assert places[a] == 0 and places[b - 1] == b - a - 1
            parts.setdefault(doc, []).append((start, ids[a:b]))
    encoder = packing.encoder(packing.TOKENIZER)
    text = lambda d: encoder.decode([int(x) for _, p in sorted(parts[d], key=lambda z: z[0]) for x in p if x != packing.END_TOKEN])
    assert text(5) == LONG and text(1) == PLAIN and text(None) == "some text without an id" and 2 not in parts and 3 not in parts
    assert packing.pack_tokens(none).collect() == []


def test_best_fit_decreasing_is_tight():
    rng = packing.np.random.default_rng(3)
    sizes = rng.integers(1, 100, 400).tolist()
    rows = packing.best_fit(sizes, 100)
    assert sorted(k for r in rows for k in r) == list(range(400)) and all(sum(sizes[k] for k in r) <= 100 for r in rows)
    assert len(rows) <= 1.05 * -(-sum(sizes) // 100) + 1
