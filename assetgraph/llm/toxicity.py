"""Toxicity by noisy-channel deobfuscation.

A token that looks disguised (digits or symbols in place of letters, letters drawn out three times or
more, letters set apart by spaces or punctuation) becomes a lattice of the letters that each character
may stand for; repeated characters may be one or two letters, separators none. Viterbi decoding under a
letter-trigram model of the corpus, in which words of the lexicon are PRIOR likelier, restores the likeliest word, and
the restored text is scored. A row of
three single characters or more, each a letter or one that stands for a letter and at least one a letter, is
one lattice in which a word may end after any character; each lexicon word of its likeliest path counts.

The score is a logistic regression on how many words carry a feature of the learned lexicon. Features are
whole words and their leading 4 to 7 bytes (which stand for inflected forms). The lexicon is learned from
labelled rows whose crc32(id as text) mod 3 is not 1, of these a hash-chosen sample of about MAX_TRAIN, half of it for each label:
features at least RATIO times as frequent in toxic texts are taken greedily, as long as one adds to toxic
texts with fewer than two hits, so words that merely accompany others (as in copies) are left out. The
trigram model counts all documents.

Null and empty texts have no words and get the score of a text without hits. Without labels of both kinds
every score is 0. Rows are scored one by one: repeated rows agree. Other columns are not read; a label
table with repeated ids counts an id as toxic if one of its rows does. Empty tables give empty tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm import words as W
from assetgraph.llm.language_id import hash_share, held_out

#: Labelled rows that the lexicon is learned from, at most (in expectation).
MAX_TRAIN = 20_000
PREFIXES = (4, 5, 6, 7)
RATIO = 20.0
THRESHOLD = 0.7
#: Letters that a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: How much likelier (in log-probability) a lexicon word is than the trigram model alone has it.
PRIOR = 6.0
#: Bytes of tokens and rows whose results a worker keeps.
CACHE_BYTES = 1 << 23
#: Places of a row whose words are looked up at once.
ROW_PLACES = 4096

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in STANDS_FOR]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_TRAIL = np.zeros(256, bool)  # punctuation that ends a token and stands for nothing there
_TRAIL[33:127] = True
_TRAIL[[*range(48, 58), *range(65, 91), *range(97, 123), ord("@"), ord("$")]] = False


class Channel:
    """The letter-trigram model: codes 0 (border or another character) and 1-26."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(27, 27, 27) + 0.1
        self.log = np.log(c / c.sum(axis=2, keepdims=True)).tolist()

    def decodings(self, token: str) -> list[tuple[float, str]]:
        """(log-probability, word), best first: the best path to each final state of the lattice, a state being the last
        two letters. Paths are kept as back-pointers, so the work is in proportion to the token."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        i, n = 0, len(token)
        while i < n:
            c, j = token[i], i
            while j < n and token[j] == c:
                j += 1
            stands = c if "a" <= c <= "z" or ord(c) > 127 else STANDS_FOR.get(c, "")
            options = [x * k for x in stands for k in range(1, 1 + min(2, j - i))]
            if not stands or c.isdigit() and j == n:
                options.append("")
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, path) in states.items():
                for option in options:
                    s, q, r = p - (1.0 if stands and not option else 0.0), a, b
                    for x in option:
                        k = _code(x)
                        s += self.log[q][r][k]
                        q, r = r, k
                    if (q, r) not in after or after[q, r][0] < s:
                        after[q, r] = (s, (option, path) if option else path)
            states, i = after, j
        return sorted(((p + self.log[a][b][0], _spell(path)) for (a, b), (p, path) in states.items()), reverse=True)

    def restore(self, token: str, known) -> str:
        """The likeliest word of decodings(), where words for which known(words) is true are PRIOR likelier than the
        model alone has them."""
        paths = [(p, w) for p, w in self.decodings(token) if w]
        if not paths:
            return ""
        toxic = known([w.encode() for _, w in paths])[0]
        return max((p + PRIOR * bool(t), w) for (p, w), t in zip(paths, toxic))[1]

    def spelled(self, row: str, longest: int, known) -> int:
        """Number of words of two letters or more on the row's likeliest path for which known(words) is
        true, where each of them adds PRIOR; longest bytes of a word decide. The model does not know letters beyond
        ASCII: they, and borders beside them, cost nothing."""
        places = _places(row)
        inside: dict[tuple[int, int], tuple[float, int]] = {}  # in a word, by its last two codes: (log-probability, hits)
        border: dict[int, tuple[float, int]] = {0: (0.0, 0)}  # between words, by the code before
        arrive: dict[int, list] = {}

        def put(states, key, p, hits):
            if key not in states or states[key][0] < p:
                states[key] = (p, hits)

        edges: list[list] = []
        for j in range(len(places) + 1):
            for whole, a, b, p, hits in arrive.pop(j, ()):
                put(*((border, b) if whole else (inside, (a, b))), p, hits)
            for (a, b), (p, hits) in inside.items():
                put(border, b, p + self._close(a, b), hits)
            if j == len(places):
                return max(border.values())[1]
            if j % ROW_PLACES == 0:
                edges = self._edges(places, j, longest, known)
            for end, first, a, b, s, whole in edges[j % ROW_PLACES]:
                p, hits = max((p + self._next(q, 0, first), hits) for q, (p, hits) in border.items())
                arrive.setdefault(end, []).append((whole, a, b, p + s + PRIOR, hits + 1))
            next_inside: dict[tuple[int, int], tuple[float, int]] = {}
            next_border: dict[int, tuple[float, int]] = {}
            for cost, x in places[j]:
                for (a, b), (p, hits) in inside.items():
                    if x:
                        put(next_inside, (b, _code(x)), p - cost + self._next(a, b, _code(x)), hits)
                    else:
                        put(next_inside, (a, b), p - cost, hits)
                for q, (p, hits) in border.items():
                    if x:
                        put(next_inside, (0, _code(x)), p - cost + self._next(q, 0, _code(x)), hits)
                    else:
                        put(next_border, q, p - cost, hits)
            inside, border = next_inside, next_border

    def _close(self, a: int, b: int) -> float:
        return self.log[a][b][0] if b else 0.0

    def _next(self, a: int, b: int, k: int) -> float:
        return self.log[a][b][k] if k else 0.0

    def _edges(self, places: list, at: int, longest: int, known) -> list[list]:
        """Known words from each of the ROW_PLACES places from at on: (end, first code, last two codes,
        log-probability after the first letter, whether a border must follow)."""
        tried, words = [], []
        for i in range(at, min(at + ROW_PLACES, len(places))):
            states: dict[tuple[int, int], tuple[float, int, str]] = {(0, 0): (0.0, 0, "")}
            j = i
            while j < len(places) and states:
                after: dict[tuple[int, int], tuple[float, int, str]] = {}
                for (a, b), (p, first, word) in states.items():
                    for cost, x in places[j]:
                        if x:
                            k = _code(x)
                            key, got = (b, k), (p - cost + (self._next(a, b, k) if word else 0.0), first if word else k, word + x)
                        elif word:
                            key, got = (a, b), (p - cost, first, word)
                        else:
                            continue
                        if key not in after or after[key][0] < got[0]:
                            after[key] = got
                j += 1
                states = {}
                for (a, b), (p, first, word) in after.items():
                    if len(word) > 1:
                        tried.append((i - at, j, first, a, b, p))
                        words.append(word.encode())
                    if len(word.encode()) < longest:
                        states[a, b] = (p, first, word)
        out: list[list] = [[] for _ in range(min(ROW_PLACES, len(places) - at))]
        found, goes_on = known(words) if words else ((), ())
        for k in np.flatnonzero(found):
            start, j, first, a, b, p = tried[k]
            out[start].append((j, first, a, b, p if goes_on[k] else p + self._close(a, b), not goes_on[k]))
        return out


def _spell(path: tuple | None) -> str:
    out = []
    while path:
        option, path = path
        out.append(option)
    return "".join(reversed(out))


def _code(x: str) -> int:
    return ord(x) - 96 if "a" <= x <= "z" else 0


def _places(row: str) -> list[list[tuple[float, str]]]:
    """(cost, letter or none) that each character of a row may be; a run of one character is one or two letters."""
    out, i, n = [], 0, len(row)
    while i < n:
        c, j = row[i], i
        while j < n and row[j] == c:
            j += 1
        options = [(0.0, x) for x in (c if "a" <= c <= "z" or ord(c) > 127 else STANDS_FOR.get(c, ""))]
        silent = c in "!|+" or c.isdigit() and j == n  # punctuation, or a final digit
        out.append([*options, (1.0, "")] if silent or not options else options)
        if j - i > 1:
            out.append([(0.0, ""), *options])
        i = j
    return out


def letter_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of letter trigrams over all of docs; 27 ** 3 numbers reach the driver."""

    def count(it):
        total = np.zeros(27**3, np.int64)
        for batch in it:
            for _, _, raw, off in W.chunks(batch.column(0)):
                low = W.lower(raw)
                x = np.zeros(len(low) + 4, np.int32)
                x[2:-2] = np.where(_LETTER[low], low - 96, 0)
                code = (x[:-2] * 27 + x[1:-1]) * 27 + x[2:]
                total += np.bincount(code[(x[1:-1] > 0) | (x[2:] > 0)], minlength=27**3)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27**3, dtype=np.int32)), pa.array(total)], names=["code", "n"])

    got = docs.select(text_col).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(27**3)
    out[got["code"]] = got["n"]
    return out


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes by feature kind (rows) and word (columns)."""
    return np.stack([W.span_hashes(raw, starts, ends), *(W.span_hashes(raw, starts, np.minimum(ends, starts + k)) for k in PREFIXES)])


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted feature hashes, the coefficients of the regression (empty without both labels), and the bytes of
    the longest feature."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(~held_out("id") & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    total = dict(known.groupBy("y").count().collect())
    # an equal part of the sample for each label; what one leaves over goes to the other
    few = min(total.values(), default=0)
    part = max(max_train // 2, max_train - few)
    known = known.where(F.when(F.col("y") == 1, hash_share(F.col("id"), part, total.get(1, 0))).otherwise(hash_share(F.col("id"), part, total.get(0, 0))))
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    rows = rows.join(F.broadcast(known), "id")  # about max_train small rows
    rows = rows.dropDuplicates(["text"]).select("text", "y")

    def count(it):
        for batch in it:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, raw, off in W.chunks(batch.column(0)):
                low = W.lower(raw)
                starts, ends, first = W.spans(low, off, W.LETTERS)
                if not len(starts):
                    continue
                keys = features(low, starts, ends)
                own = [np.unique(keys[:, a:b]) for a, b in zip(first[:-1], first[1:])]
                h, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
                f, back = np.unique(h, return_inverse=True)
                toxic = np.bincount(back, weights=y[i + owner], minlength=len(f)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(f)).astype(np.int64))], names=["f", "toxic", "seen"])

    sizes = dict(rows.groupBy("y").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0), 0
    least = max(2, min(3, n1 // 100), n1 // 500)
    counted = rows.mapInArrow(count, "f long, toxic long, seen long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen"))
    rate = (F.col("toxic") + 0.5) / n1 / ((F.col("seen") - F.col("toxic") + 0.5) / n0)
    found = counted.where((F.col("toxic") >= least) & (rate >= RATIO)).select("f").toPandas()
    candidates = np.sort(found["f"].to_numpy().astype(np.uint64))

    def incidence(it):
        for batch in it:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, raw, off in W.chunks(batch.column(0)):
                low = W.lower(raw)
                starts, ends, first = W.spans(low, off, W.LETTERS)
                at, found = _look_up(candidates, features(low, starts, ends))
                kind, word = np.nonzero(found)
                order = np.argsort(word, kind="stable")
                kind, word = kind[order], word[order]
                cut = np.searchsorted(word, first)
                f = at[kind, word].astype(np.int32)
                size = np.minimum((ends - starts)[word], np.array([len(low), *PREFIXES])[kind])
                yield pa.RecordBatch.from_arrays([pa.array(y[i:j].astype(float)), *(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (f, word, size))], names=["y", "f", "word", "size"])

    # of the sampled texts, only the numbers of candidate features and their words reach the driver
    got = rows.mapInArrow(incidence, "y double, f array<int>, word array<int>, size array<int>").toPandas()
    y = got["y"].to_numpy()
    doc = np.repeat(np.arange(len(y)), got["f"].map(len))
    feature, word, size = (np.concatenate([np.zeros(0, np.int64), *got[c].map(np.asarray)]).astype(np.int64) for c in ("f", "word", "size"))
    word = np.unique(np.stack([doc, word]), axis=1, return_inverse=True)[1].reshape(-1)
    many = max(1, len(candidates))
    clean = np.bincount(np.unique(doc[y[doc] == 0] * many + feature[y[doc] == 0]) % many, minlength=many)
    hits, taken, chosen = np.zeros(len(y)), np.zeros(len(word), bool), []
    while len(feature):
        open_ = (y[doc] == 1) & (hits[doc] < 2) & ~taken
        gain = np.bincount(np.unique(doc[open_] * many + feature[open_]) % many, minlength=many) - 2 * clean
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        new, at = np.unique(word[(feature == best) & ~taken], return_index=True)
        np.add.at(hits, doc[(feature == best) & ~taken][at], 1)
        taken |= np.isin(word, new)
    lexicon = candidates[np.sort(np.array(chosen, dtype=np.int64))]
    weights = _regress(_inputs(hits), y)
    # the labels' odds in the sample are not those of all labelled rows
    weights[0] += math.log(total[1] / total[0]) - math.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    return lexicon, weights, int(size[np.isin(feature, chosen)].max(initial=0))


def _look_up(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of h's entries in sorted_hashes (-1: absent), and whether present."""
    if not len(sorted_hashes):
        return np.full(h.shape, -1), np.zeros(h.shape, bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    found = sorted_hashes[at] == h
    return np.where(found, at, -1), found


def _inputs(hits: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(hits)), hits >= 1, hits >= 2, np.minimum(hits, 6) / 6], axis=1).astype(float)


def _regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return w


def disguised(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """Starts and ends of tokens that look disguised (ends without final punctuation) and their document;
    and rows of single characters set apart by spaces, as (document, characters)."""
    starts, ends, first = W.spans(low, off, W.NOT_SPACE)
    doc = W.owners(first)
    n = len(low)
    full = ends.copy()
    while True:  # a token seldom ends with more than three
        cut = (ends > starts) & _TRAIL[low[ends - 1]]
        if not cut.any():
            break
        ends = ends - cut
    dollars = np.zeros(len(ends), bool)
    if len(ends):
        three = ends - starts >= 3
        e = ends[three]
        dollars[three] = (low[e - 1] == 36) & (low[e - 2] == 36) & (low[e - 3] == 36)
        while dollars.any():
            cut = dollars & (ends > starts) & (low[np.maximum(ends, 1) - 1] == 36)
            if not cut.any():
                break
            ends = ends - cut
    # by character: all beyond ASCII are letters
    at = np.flatnonzero((low & 0xC0) != 0x80)
    head, m = low[at], len(at)
    code = head.astype(np.uint32)
    if m < n:
        width = np.diff(np.r_[at, n])
        for k in (1, 2, 3):
            code = np.where(width > k, code << np.uint32(8) | low[np.minimum(at + k, n - 1)], code)
    from_, to, till = (np.searchsorted(at, x) if m < n else x for x in (starts, ends, full))
    letter = W.LETTERS[head]
    sign = letter | _LEET[head]

    def beside(flags):
        before, after = np.zeros(m, bool), np.zeros(m, bool)
        before[1:], after[:-1] = flags[:-1], flags[1:]
        return before, after

    odd = _LEET[head] & np.logical_or(*beside(letter))
    drawn = np.zeros(m, bool)
    if m >= 3:
        drawn[:-2] = letter[:-2] & (code[:-2] == code[1:-1]) & (code[:-2] == code[2:])
    apart = ~letter & ~_DIGIT[head] & W.NOT_SPACE[head] & np.logical_and(*beside(sign))

    def within(flags):
        sums = np.zeros(m + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[to] - sums[from_]

    pick = ((within(letter) >= 1) & (((ends - starts >= 3) & (within(odd) > 0)) | (within(apart) >= 2))) | (within(drawn) > 0)
    single = ((till - from_ == 1) | (to - from_ == 1) & (till - from_ == 2)) & sign[from_]
    # rows of three single characters or more, in one document
    edge = np.flatnonzero(single & ~np.r_[False, single[:-1] & (doc[:-1] == doc[1:])])
    end = np.flatnonzero(single & ~np.r_[single[1:] & (doc[:-1] == doc[1:]), False]) + 1
    rows = []
    for a, b in zip(edge, end):
        if b - a >= 3 and letter[from_[a:b]].any():
            rows.append((int(doc[a]), b"".join(low[x : x + k].tobytes() for x, k in zip(starts[a:b], width[from_[a:b]])) if m < n else low[starts[a:b]].tobytes()))
    return starts[pick], ends[pick], doc[pick], rows


def scorer(lexicon: np.ndarray, weights: np.ndarray, counts: np.ndarray, longest: int):
    """measure() for words.map_text."""
    channel: list[Channel] = []
    kept: dict[tuple[bool, bytes], int] = {}
    held = [0]

    def known(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word carries a feature, and one that it still carries if it goes on."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes + 1) - 1
        found = _look_up(lexicon, features(np.frombuffer(b" ".join(words), np.uint8), ends - sizes, ends))[1]
        return found.any(axis=0), (found[1:] & (sizes >= np.array(PREFIXES)[:, None])).any(axis=0)

    def toxic_words(row: bool, token: bytes) -> int:
        if (row, token) in kept:
            return kept[row, token]
        if not channel:
            channel.append(Channel(counts))
        if row:
            hits = channel[0].spelled(token.decode("utf-8", "replace"), longest, known)
        else:
            word = channel[0].restore(token.decode("utf-8", "replace"), known)
            hits = int(known([word.encode()])[0].any()) if word else 0
        size = len(token) + 200  # and what Python adds to a key and an entry
        if size <= CACHE_BYTES:
            if held[0] + size > CACHE_BYTES:
                kept.clear()
                held[0] = 0
            kept[row, token] = hits
            held[0] += size
        return hits

    def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        docs = len(off) - 1
        low = W.lower(raw)
        starts, ends, first = W.spans(low, off, W.LETTERS)
        hit = _look_up(lexicon, features(low, starts, ends))[1].any(axis=0) if len(starts) and len(lexicon) else np.zeros(len(starts), bool)
        plain = W.per_document(hit.astype(np.int64), first)
        hidden = np.zeros(docs, np.int64)
        if len(lexicon):
            known_before = np.zeros(len(low) + 1, np.int64)
            known_before[starts[hit] + 1] = 1
            known_before = np.cumsum(known_before)
            *tokens, rows = disguised(low, off)
            for a, b, d in zip(*tokens):
                if known_before[b] == known_before[a]:
                    hidden[d] += toxic_words(False, low[a:b].tobytes())
            for d, row in rows:
                hidden[d] += toxic_words(True, row)
        score = 1 / (1 + np.exp(-_inputs(plain + hidden) @ weights)) if len(weights) else np.zeros(docs)
        return {"score": score, "n_hits": plain + hidden, "n_hidden": hidden}

    return measure


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted, n_hits, n_hidden (words found only
    after decoding)."""
    lexicon, weights, longest = learn_lexicon(docs, labels, id_col, text_col, label_col, max_train)
    counts = letter_counts(docs, text_col)
    made = W.map_text(docs, scorer(lexicon, weights, counts, longest), "score double, n_hits long, n_hidden long", [id_col], text_col)
    return made.select(F.col(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits", "n_hidden")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
