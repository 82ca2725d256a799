"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes find the n-grams that occur twice or more in a text; the
measure is the share of a text's characters that lie inside such n-grams (each character counted
once), and likewise inside lines that repeat an earlier line. A text is rejected where a share
exceeds the limit for its length.

Null and empty texts have no words and fail the base rule. Rows are measured one by one, so repeated
rows and ties give equal results; an empty table gives an empty table. Very long texts are one chunk
of their own. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm import words as W

#: Largest share of characters inside n-grams that occur twice or more, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters inside lines that equal an earlier one.
LINE_CHARS_LIMIT = 0.20
MIN_WORDS = 10

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_ngram_excess double, base_failed boolean, kept boolean"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _cumulative(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _lines(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the lines that hold a word, and whether each equals an earlier
    line of its document."""
    newline = np.flatnonzero(raw == 10)
    size = np.diff(off) > 0
    starts = np.union1d(off[:-1][size], newline + 1)
    starts = starts[starts < len(raw)]
    doc = np.searchsorted(off, starts, "right") - 1
    ends = np.minimum(np.r_[starts[1:], len(raw)], off[doc + 1])
    ends = ends - ((ends > starts) & (raw[ends - 1] == 10))
    words = _cumulative(inside)
    has = words[ends] > words[starts]
    starts, ends, doc = starts[has], ends[has], doc[has]
    keys = W.mix(W.span_hashes(raw, starts, ends) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return starts, ends, doc, again


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    docs = len(off) - 1
    inside = W.NOT_SPACE[raw]
    starts, ends, first = W.spans(raw, off, W.NOT_SPACE)
    n_words = np.diff(first)
    total = len(starts)
    points = _cumulative((raw & 0xC0) != 0x80)
    chars = points[ends] - points[starts]
    word_chars = W.per_document(chars, first)
    symbols = _cumulative(_SYMBOL[raw])

    h = W.span_hashes(raw, starts, ends)
    doc = W.owners(first)
    salted = h + W.mix(doc.astype(np.uint64) + np.uint64(1))
    excess = np.zeros(docs)
    repeat_words = np.zeros(docs, dtype=np.int64)
    at = np.flatnonzero(W.window_starts(first, 5))
    for n, limit in NGRAM_LIMITS.items():
        if not len(at):
            break
        if n == 5:
            keys = W.window_hashes(salted, 5)[at]
        else:
            keys = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                keys = W.mix(keys * np.uint64(0xD6E8FEB86659FD93) + salted[at + k])
        at = at[W.repeated(keys)]
        inner = W.covered(at, n, total)
        if n == 5:
            repeat_words = W.per_document(inner, first)
        excess = np.maximum(excess, W.per_document(chars * inner, first) / np.maximum(word_chars, 1) / limit)
        # an (n+1)-gram can only repeat where the n-grams at its start and one word on both do
        at = at[np.isin(at + 1, at, assume_unique=True)]
        at = at[(at + n < total)]
        at = at[doc[at] == doc[at + n]]

    s, e, line_doc, again = _lines(raw, off, inside)
    dup_lines = np.bincount(line_doc[again], minlength=docs)
    line_chars = np.bincount(line_doc[again], weights=(points[e] - points[s])[again], minlength=docs)
    line_share = line_chars / np.maximum(points[off[1:]] - points[off[:-1]], 1)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat_words > 20 * n_words)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": repeat_words,
        "dup_line_share": line_share,
        "dup_ngram_excess": excess,
        "base_failed": base_failed,
        "kept": ~base_failed & (excess <= 1) & (line_share <= LINE_CHARS_LIMIT),
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and the columns of SCHEMA. dup_ngram_excess is the largest
    ratio of a duplicated n-gram share to its limit; dup_line_share the share inside repeated lines."""
    return W.map_text(docs, measure, SCHEMA, [id_col], text_col)


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject; columns as before."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = W.map_text(docs.select(docs[text_col].alias("text"), row), measure, SCHEMA, ["row"])
    return kept.where("kept").select("row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
