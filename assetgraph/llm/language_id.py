"""Language identification as multilingual mixture inference.

A language is a distribution over hashed letter trigrams (word borders included), learned from the
labelled training rows. A text is a mixture: each of its words comes from one language, and
expectation-maximisation over the words' likelihoods estimates the share of each language. Sets of the 1,
2, ... likeliest languages are fitted, up to all, as long as one more raises the penalised likelihood of some
text; a text gets the set with the best one, and its prediction is the language with the largest share in it.

Training rows: crc32 of the id as text mod 3 is not 1, and a label is present; of these a hash-chosen
sample of about MAX_TRAIN is counted, with an equal part for each language. Text without a letter, empty or null is ``und`` with score 0, and so
is everything where nothing could be learned. Rows are scored one by one, so repeated rows and ties
(broken by the order of language names) agree. Other columns are not read. An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetgraph.llm import words as W

#: Labelled rows that the trigram counts are taken from, at most (in expectation).
MAX_TRAIN = 20_000
BINS = 1 << 15
ROUNDS, MORE_ROUNDS = 6, 3
#: Log-likelihood that one more language must gain, per log(words).
PENALTY = 3.0


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash_share(key: Column, take: int, of: int) -> Column:
    """True for about take of so many rows, chosen by a hash of 63 bits, which is fine enough for any number of rows."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(min((1 << 63) - 1, take * (1 << 63) // max(1, of)))


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the trigrams centred on each letter, the index of each word's first letter among them,
    and for each document the number of its first word."""
    low = W.lower(raw)
    starts, ends, first = W.spans(low, off, W.LETTERS)
    letter = W.LETTERS[low]
    clean = np.where(letter, low, 32).astype(np.uint32)
    before, after = np.full(len(clean), 32, np.uint32), np.full(len(clean), 32, np.uint32)
    before[1:], after[:-1] = clean[:-1], clean[1:]
    before[starts], after[ends - 1] = 32, 32
    at = np.flatnonzero(letter)
    code = (before[at] << np.uint32(16)) | (clean[at] << np.uint32(8)) | after[at]
    bins = (code * np.uint32(2654435761)) >> np.uint32(32 - BINS.bit_length() + 1)
    return bins, np.searchsorted(at, starts), first


def _chosen(sizes: dict[str, int], max_train: int) -> Column:
    """An equal part of the sample for each language; a language with fewer rows is taken whole."""
    out = F.lit(True)
    for lang, n in sizes.items():
        part = max(1, max_train // len(sizes))
        if n > part:
            out = F.when(F.col("lang") == lang, hash_share(F.col("id"), part, n)).otherwise(out)
    return out


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages, and a table of log-probabilities by language and bin."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).where(~held_out("id") & F.col("lang").isNotNull())
    # the languages are the model's classes: each has a table of BINS numbers on the driver
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = rows.where(_chosen(sizes, max_train))

    def count(it):
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, j, raw, off in W.chunks(batch.column(0)):
                bins, word_at, first = trigrams(raw, off)
                doc_at = np.r_[word_at, len(bins)][first]
                owner = np.repeat(np.arange(j - i), np.diff(doc_at))
                for lang in set(langs[i:j]):
                    sums[lang] = sums.get(lang, 0) + np.bincount(bins[(langs[i:j] == lang)[owner]], minlength=BINS)
        for lang, x in sums.items():
            k = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(x[k].astype(np.int64))], names=["lang", "bin", "n"])

    # at most languages x BINS rows
    got = rows.select("text", "lang").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((len(langs), BINS))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table[k, own["bin"]] = own["n"]
    table += 0.5
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _segment_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros((x.shape[0], x.shape[1] + 1))
    np.cumsum(x, axis=1, out=sums[:, 1:])
    return sums[:, first[1:]] - sums[:, first[:-1]]


def infer(table: np.ndarray, raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """lang (index, -1: no letter), score and n_langs of each document."""
    n_langs, docs = len(table), len(off) - 1
    bins, word_at, first = trigrams(raw, off)
    n = np.diff(first)
    if n_langs == 0 or not len(word_at):
        return {"lang": np.full(docs, -1, np.int32), "score": np.zeros(docs), "n_langs": np.zeros(docs, np.int32), "shares": [[]] * docs}
    ll = np.stack([np.add.reduceat(t[bins], word_at) for t in table]).astype(np.float64)
    top = ll.max(axis=0)
    like = np.exp(np.maximum(ll - top, -30))
    owner = W.owners(first)
    base = _segment_sums(top[None], first)[0]
    some = np.maximum(n, 1)

    def fit(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            part = share[:, owner] * like
            part /= part.sum(axis=0)
            share = np.maximum(_segment_sums(part, first), 0) / some
        mixed = np.log(np.maximum((share[:, owner] * like).sum(axis=0), 1e-300))
        return share, base + _segment_sums(mixed[None], first)[0]

    share, _ = fit(np.full((n_langs, docs), 1 / n_langs), ROUNDS)
    alone = _segment_sums(ll, first)
    rank = np.argsort(-share, axis=0, kind="stable")
    best_share = np.zeros((n_langs, docs))
    first_one = alone.argmax(axis=0)
    best_share[first_one, np.arange(docs)] = 1
    best, size = alone.max(axis=0), np.ones(docs, np.int32)
    price = PENALTY * np.log(some + 1)
    top_value = base  # no mixture is likelier than each word in its own best language
    for k in range(2, n_langs + 1):
        start = np.zeros((n_langs, docs))
        np.put_along_axis(start, rank[:k], np.maximum(np.take_along_axis(share, rank[:k], axis=0), 1e-3), axis=0)
        got, value = fit(start / start.sum(axis=0), MORE_ROUNDS)
        better = value - (k - 1) * price > best
        best = np.where(better, value - (k - 1) * price, best)
        best_share[:, better] = got[:, better]
        size[better] = k
        # no text has gained by this size, nor can by a larger one if not even all languages would pay for it
        if not better.any() and not (top_value - k * price > best).any():
            break
    lang = best_share.argmax(axis=0)
    odds = np.exp(np.maximum(alone - alone.max(axis=0), -50))
    sure = np.where(size > 1, 1.0, (odds / odds.sum(axis=0))[lang, np.arange(docs)])
    lang[n == 0] = -1
    out = {"lang": lang.astype(np.int32), "score": np.clip(np.where(n > 0, best_share.max(axis=0) * sure, 0), 0, 1), "n_langs": np.where(n > 0, size, 0).astype(np.int32)}
    return out | {"shares": [s.tolist() for s in np.where(n > 0, best_share, 0).T]}


def _no_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True for documents whose bytes hold no letter: those beyond ASCII are looked at one by one."""
    low = W.lower(raw)
    plain = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((low >= 97) & (low <= 122), out=plain[1:])
    none = plain[off[1:]] == plain[off[:-1]]
    for d in np.flatnonzero(none):
        none[d] = not any(c.isalpha() for c in bytes(raw[off[d] : off[d + 1]]).decode("utf-8", "replace"))
    return none


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score, n_langs (size of the chosen set) and shares, the
    set's languages with their shares, largest first."""
    langs, table = learn(docs, id_col, text_col, lang_col, max_train)

    def measure(raw, off):
        out = infer(table, raw, off)
        none = _no_letter(raw, off)
        out["lang"][none], out["score"][none], out["n_langs"][none] = -1, 0, 0
        for d in np.flatnonzero(none):
            out["shares"][d] = []
        return out

    made = W.map_text(docs, measure, "lang int, score double, n_langs int, shares array<double>", [id_col], text_col)
    names = F.array(*map(F.lit, ["und", *langs]))
    pairs = F.zip_with("shares", F.slice(names, 2, max(1, len(langs))), lambda p, x: F.struct(p.alias("share"), x.alias("lang")))
    chosen = F.reverse(F.array_sort(F.filter(pairs, lambda x: x["share"] > 0)))
    return made.select(F.col(id_col), held_out(id_col).alias("held_out"), F.element_at(names, F.col("lang") + 2).alias("lang_pred"), "score", "n_langs", chosen.alias("shares"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("shares")
