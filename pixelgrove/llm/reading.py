"""Reading level of English texts by gradient-boosted regression trees.

Texts are measured in windows of ``2 * HALF`` words that overlap by half (the last one ends with the text), so that abstract,
description and claims are judged each for itself whatever their headings look like, and a short hard section fills most of some window. Features of a window describe
distributions over its words and sentences: length, vocabulary, syntax and cohesion. They are computed on whole Arrow batches with numpy, bytes first;
no Python runs per word or per text. Markup and character references, as broken formulas have them, are taken out first.

No word list is given. Word frequencies are counted over all English texts (``word_counts``); the ``VOCABULARY`` most frequent words have a
frequency rank, the first ``FUNCTION_WORDS`` of them stand for the words that carry syntax. Each word of the vocabulary also has a score, the mean rating of the rated texts it
occurs in, shrunk to the mean of all; the windows of a source are always scored without that source's own ratings while fitting.

Trees are trained here, on at most ``FIT_DOCS`` rated texts and ``FIT_WINDOWS`` windows of each, evenly spread (every window carries the mean rating of its text; repeated and
contradictory ratings are averaged), and out-of-fold predictions, one fold per source, calibrate them by isotonic regression. They also choose the
bound for a text's hardest window. Texts of which only a part is easy are rarely rated, so their hard part is taken from harder texts: the bound is the one that tells
best the hardest windows of rated level 1 texts from the hardest windows of the quarters of all other rated texts. All
texts are then scored in one narrow pass with the broadcast trees. A text's ``level`` is the mean over its windows, ``hardest`` the
greatest; ``easy_throughout`` says how both are cut.

Defined results: texts that aren't English are not scored; ``lang`` null or beginning with ``en`` in any case is English. Null, empty
and wordless texts have 0 words and null levels; texts under ``MIN_WORDS`` words are scored but are never a case. Without any
rated text nothing can be fitted and a ValueError says so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

FIT_DOCS, FIT_WINDOWS = 8_000, 48
HALF = 30
MIN_WORDS = 20
SLICE = 256
VOCABULARY, FUNCTION_WORDS = 50_000, 100
#: Rated texts at the mean rating that every word is thought to have besides its own.
PRIOR = 20.0
_LENGTHS, _SENTENCES, _RANKS, _SCORES = (4, 6, 8, 10, 13), (10, 16, 24, 36), (FUNCTION_WORDS, 1_000, 5_000, VOCABULARY), (1.5, 2.0, 2.5, 3.0)
FEATURES = (
    "word_length", "word_length_sd", *(f"words_from_{n}_letters" for n in _LENGTHS), "syllables", "from_3_syllables", "from_4_syllables", "hyphenated",
    "sentence_length", "sentence_length_log", *(f"words_in_sentences_over_{n}" for n in _SENTENCES), "longest_sentence", "commas", "semicolons", "parentheses", "digits",
    "frequency_log", *(f"words_beyond_rank_{n}" for n in _RANKS), "score", *(f"words_scored_below_{x}" for x in _SCORES), "variety", "repeated_from_last",
)

_ODD_SPACE = re.compile(r"[\u0085\u00a0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Markup, escaped or not, and character references: remains of formulas and pages, no language.
_MARKUP = re.compile(r"(?:<|&lt;)/?\w{1,12}/?(?:>|&gt;)|&#?\w{1,8};")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_HYPHEN, _LOWER = ord("-"), np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


@dataclass
class Words:
    """The vocabulary: hashes in order, and for each word its rank and log2 share of all words, and its score."""

    hashes: np.ndarray
    ranks: np.ndarray
    log_share: np.ndarray
    score: np.ndarray
    mean: float

    def find(self, word: np.ndarray) -> np.ndarray:
        """Position of each word, ``len(self.hashes)`` for those outside."""
        n = len(self.hashes)
        at = np.minimum(np.searchsorted(self.hashes, word), max(0, n - 1))
        return np.where(self.hashes[at] == word, at, n) if n else np.zeros(len(word), np.int64)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank, log share and score by position, with a last entry for words outside."""
        rare = self.log_share.min(initial=0.0) - 1
        return np.r_[self.ranks, VOCABULARY + 1], np.r_[self.log_share, rare], np.r_[self.score, self.mean]


def _split(texts: list[str | None]) -> dict[str, np.ndarray] | None:
    """Bytes of all texts in one array, and the words in it: start, end, hash, text; None if there are no words."""
    texts = [_MARKUP.sub(" ", t) if t and ("&" in t or "<" in t) else t for t in texts]
    clean = [(t if t.isascii() else _ODD_SPACE.sub(" ", t)).encode("utf-8", "replace") if t else b"" for t in texts]
    raw = np.frombuffer(b"\n\n".join([*clean, b""]) or b"\n", np.uint8)
    starts_of = np.cumsum([0, *[len(c) + 2 for c in clean]])[:-1]
    letter = _LETTER[raw]
    inner = (raw == _HYPHEN)[1:-1] & letter[:-2] & letter[2:]
    letter[1:-1] |= inner
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return None
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum((_LOWER[raw] + np.uint64(1)) * _powers(_BASE, len(raw)))]
        word = (prefix[end] - prefix[start]) * _powers(_INVERSE, len(raw))[start]
    return {"raw": raw, "starts_of": starts_of, "start": start, "end": end, "word": word, "text": np.searchsorted(starts_of, start, "right") - 1}


def windows(texts: list[str | None], words: Words, scores: np.ndarray | None = None, half: int = HALF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text number, words, number of the window in its text, features`` of every window of the texts, and the words of every text; wordless texts have no window.

    ``scores``: for every text its own scores by position, in place of those of ``words``.
    """
    got = _split(texts)
    if got is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES))), np.zeros(len(texts), np.int64)
    raw, starts_of, start, end, word, text = (got[k] for k in ("raw", "starts_of", "start", "end", "word", "text"))
    first = np.searchsorted(text, np.arange(len(texts)), "left")
    n_words = np.bincount(text, minlength=len(texts))
    n_halves = -(-n_words // half)
    block = (np.arange(len(start)) - first[text]) // half + (np.cumsum(n_halves) - n_halves)[text]
    bounds = np.r_[0, np.flatnonzero(np.diff(block)) + 1]
    count = np.diff(np.r_[bounds, len(block)]).astype(float)
    owner = text[bounds]

    def total(x):
        return np.add.reduceat(x.astype(np.float64), bounds)

    def running(mask):
        return np.r_[0, np.cumsum(mask)]

    length = end - start
    vowel = _VOWEL[raw]
    vowel[1:] &= ~vowel[:-1].copy()
    v = running(vowel)
    syllables = v[end] - v[start]
    hyphen = running(raw == _HYPHEN)
    stop = np.isin(raw, np.frombuffer(b".!?", np.uint8))
    after, before = np.r_[raw[1:], 10], np.r_[10, raw[:-1]]
    stop &= (after <= 32) & (_LETTER[before] | (before == 41) | (before == 34))
    sentence = running(stop)[start] + text  # a new text begins a new sentence
    serial = np.cumsum(np.r_[True, np.diff(sentence) != 0]) - 1
    in_sentence = np.bincount(serial)[serial].astype(float)
    opens = np.r_[True, np.diff(owner) != 0]
    begin = np.where(opens, starts_of[owner], start[bounds])  # a text's first block begins, and its last ends, with the text
    until = np.where(np.r_[opens[1:], True], np.r_[starts_of[1:], len(raw)][owner], np.r_[begin[1:], len(raw)])

    def marks(chars: bytes):
        r = running(np.isin(raw, np.frombuffer(chars, np.uint8)))
        return (r[until] - r[begin]).astype(float)

    with np.errstate(over="ignore"):
        kinds = np.bincount(block[np.unique(word + block.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), return_index=True)[1]], minlength=len(count)).astype(float)
        content = length >= 4
        salt = np.uint64(0xA24BAED4963EE407)
        known = np.sort(word[content] + serial[content].astype(np.uint64) * salt)
        last = word[content] + (serial[content] - 1).astype(np.uint64) * salt
    again = np.zeros(len(word))
    again[content] = _in(last, known) & (serial > serial[first[text]])[content] if len(known) else False
    at = words.find(word)
    rank, log_share, score = (t[at] for t in words.tables())
    if scores is not None:
        score = scores[text, at]
    sums = np.stack([
        count, total(length), total(length.astype(float) ** 2), *(total(length >= n) for n in _LENGTHS), total(syllables), total(syllables >= 3), total(syllables >= 4), total(hyphen[end] > hyphen[start]),
        total(np.minimum(in_sentence, 200)), total(np.log(in_sentence)), *(total(in_sentence > n) for n in _SENTENCES), marks(b","), marks(b";"), marks(b"()"), marks(b"0123456789"),
        total(log_share), *(total(rank > n) for n in _RANKS), total(score), *(total(score < x) for x in _SCORES), kinds, total(again),
    ], 1)
    longest = np.minimum(np.maximum.reduceat(in_sentence, bounds), 200)
    more = np.r_[~opens[1:], False]  # another block of the same text follows
    one = np.flatnonzero(more | (opens & ~more))  # a window begins with every block but the last, or is a text's only one
    other = np.minimum(one + 1, len(count) - 1)
    joined = sums[one] + np.where(more[one][:, None], sums[other], 0)
    longest = np.maximum(longest[one], np.where(more[one], longest[other], 0))
    n = joined[:, 0]
    x = joined[:, 1:] / n[:, None]
    k = 2 + len(_LENGTHS) + 4 + 2 + len(_SENTENCES)  # where the longest sentence goes
    spread = np.sqrt(np.maximum(0, x[:, 1] - x[:, 0] ** 2))
    out = np.concatenate([x[:, :1], spread[:, None], x[:, 2:k], longest[:, None], x[:, k:]], 1)
    number = one - np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))[one]
    return owner[one], n.astype(np.int64), number, out, n_words


class BoostedTrees:
    """Gradient-boosted regression trees on binned features, squared error, leaf-wise to a fixed depth."""

    def __init__(self, trees: int = 70, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        self.base = float(np.average(y, weights=w))
        f = np.full(len(y), self.base)
        nodes, k, m = 2**self.depth - 1, x.shape[1], self.bins
        self.feature, self.cut, self.leaf = np.zeros((self.n, nodes), np.int64), np.full((self.n, nodes), np.inf), np.zeros((self.n, 2**self.depth))
        flat = b + np.arange(k) * m
        for t in range(self.n):
            g, at = (y - f) * w, np.zeros(len(y), np.int64)
            for level in range(self.depth):
                width = 2**level
                code = (at[:, None] * (k * m) + flat).ravel()
                gs = np.bincount(code, np.repeat(g, k), minlength=width * k * m).reshape(width, k, m)
                ws = np.bincount(code, np.repeat(w, k), minlength=width * k * m).reshape(width, k, m)
                gl, wl = gs.cumsum(2)[:, :, :-1], ws.cumsum(2)[:, :, :-1]
                gt, wt = gs[:, :1].sum(2, keepdims=True), ws[:, :1].sum(2, keepdims=True)
                gain = gl**2 / (wl + self.l2) + (gt - gl) ** 2 / (wt - wl + self.l2) - gt**2 / (wt + self.l2)
                gain[(wl < self.least) | (wt - wl < self.least)] = -1
                best = gain.reshape(width, -1).argmax(1)
                ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
                feat, pos = best // (m - 1), best % (m - 1)
                for j in np.flatnonzero(ok):
                    c = self.cuts[feat[j]]
                    if pos[j] < len(c):
                        self.feature[t, width - 1 + j], self.cut[t, width - 1 + j] = feat[j], c[pos[j]]
                node = width - 1 + at
                at = 2 * at + (x[np.arange(len(x)), self.feature[t, node]] > self.cut[t, node])
            self.leaf[t] = self.rate * np.bincount(at, g, minlength=2**self.depth) / (np.bincount(at, w, minlength=2**self.depth) + self.l2)
            f += self.leaf[t, at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.n):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, at]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum y, n, sum x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], s, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def english(documents: DataFrame) -> DataFrame:
    lang = F.lower(F.trim(F.col("lang")))
    return documents.where(F.col("lang").isNull() | lang.startswith("en")).select("doc_id", "source", "text")


def word_counts(documents: DataFrame) -> DataFrame:
    """``h, n``: how often every word (by its hash) occurs in all English texts. Combined per task before the shuffle."""

    def run(frames):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for pdf in frames:
            for s in range(0, len(pdf), SLICE):
                got = _split(pdf["text"].iloc[s : s + SLICE].tolist())
                if got is not None:
                    held.append(np.unique(got["word"], return_counts=True))
            if sum(len(h) for h, _ in held) > 4_000_000:
                held = [added()]
                if len(held[0][0]) > 2_000_000:
                    yield pd.DataFrame({"h": held[0][0].view(np.int64), "n": held[0][1]})
                    held = []
        if held:
            h, n = added()
            yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    return english(documents).where("text is not null").select("text").mapInPandas(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(documents: DataFrame, size: int = VOCABULARY) -> Words:
    """The ``size`` most frequent words of all English texts, without scores."""
    counts = materialise(word_counts(documents))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    top = counts.orderBy(F.desc("n"), "h").limit(size).toPandas()  # at most `size` rows of two numbers
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(float)
    order = np.argsort(h)
    return Words(h[order], np.arange(1, len(h) + 1)[order], np.log2(n[order] / max(1, total)), np.zeros(len(h)), 0.0)


def _word_ratings(docs: DataFrame, words: Words) -> pd.DataFrame:
    """``source, w, n, s``: per source and word of the vocabulary the rated texts that have it, and the sum of their ratings."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most VOCABULARY words

    def run(frames):
        for pdf in frames:
            for s in range(0, len(pdf), SLICE):
                part = pdf.iloc[s : s + SLICE]
                got = _split(part["text"].tolist())
                if got is None:
                    continue
                at = shared.value.find(got["word"])
                pair = np.unique(got["text"][at < len(shared.value.hashes)] * (1 << 32) + at[at < len(shared.value.hashes)])
                hits = pd.DataFrame({"source": part["source"].fillna("").to_numpy()[pair >> 32], "w": pair & ((1 << 32) - 1), "r": part["rating"].to_numpy()[pair >> 32]})
                yield hits.groupby(["source", "w"], as_index=False).agg(n=("r", "size"), s=("r", "sum"))

    return docs.mapInPandas(run, "source string, w bigint, n bigint, s double").groupBy("source", "w").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()  # sources x VOCABULARY at most


def scored_words(ratings: pd.DataFrame, texts: pd.DataFrame, words: Words) -> dict[str | None, np.ndarray]:
    """Scores by position (the last for words outside): under None from all sources, under each source from all others."""
    n_words, out = len(words.hashes), {}
    for source in [None, *texts["source"].unique()]:
        used, rated = ratings, texts
        if source is not None and (texts["source"] != source).any():
            used, rated = ratings[ratings["source"] != source], texts[texts["source"] != source]
        mean = rated["s"].sum() / max(1, rated["n"].sum())
        n, s = (np.bincount(used["w"].to_numpy(np.int64), used[c].to_numpy(float), minlength=n_words) for c in ("n", "s"))
        out[source] = np.r_[(s + PRIOR * mean) / (n + PRIOR), mean]
    return out


def _window_rows(docs: DataFrame, words: Words, scores: dict[str | None, np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((words, scores))

    def run(frames):
        words, scores = shared.value
        for pdf in frames:
            for s in range(0, len(pdf), SLICE):
                part = pdf.iloc[s : s + SLICE]
                source = part["source"].fillna("")
                names, which = np.unique(source.to_numpy(str), return_inverse=True)
                table = np.stack([scores.get(str(k), scores[None]) for k in names])
                text, n, number, x, _ = windows(part["text"].tolist(), words, table[which])
                most = np.bincount(text, minlength=len(part))[text]
                kept = (number * FIT_WINDOWS // np.maximum(most, 1) != (number - 1) * FIT_WINDOWS // np.maximum(most, 1)) | (most <= FIT_WINDOWS)  # evenly spread
                text, n, number, x = text[kept], n[kept], number[kept], x[kept]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[text], "source": source.to_numpy()[text], "rating": part["rating"].to_numpy()[text], "n": n, "number": number, "x": list(x.astype(np.float32))})

    return docs.select("doc_id", "source", "rating", "text").mapInPandas(run, "doc_id bigint, source string, rating double, n bigint, number bigint, x array<float>")


def best_bound(easy: np.ndarray, hard: np.ndarray) -> float:
    """The bound that has the greatest share of ``easy`` below it less that of ``hard``, midway to the next value above; infinite without ``hard``."""
    if not len(easy) or not len(hard):
        return np.inf if len(easy) else -np.inf
    h = np.sort(np.concatenate([easy, hard]))
    gain = np.searchsorted(np.sort(easy), h, "right") / len(easy) - np.searchsorted(np.sort(hard), h, "right") / len(hard)
    k = int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1])
    return float((h[k] + h[k + 1]) / 2) if k + 1 < len(h) else float(h[k] + 1)


def quarters(p: np.ndarray) -> list[float]:
    """The greatest of each quarter of a text's windows."""
    return [float(q.max()) for q in np.array_split(p, 4) if len(q)]


class ReadingModel:
    """Words, trees, their calibration and the bound for the hardest window; ``report`` holds the cross-validation by source."""

    def fit(self, rows: pd.DataFrame, words: Words) -> ReadingModel:
        """``rows``: ``doc_id, source, rating, n, number, x`` of the rated texts' windows. Trees are trained on every second window, which don't overlap, and judge all."""
        if rows.empty:
            raise ValueError("no rated English text to fit the reading level on")
        self.words = words
        x, y = np.stack(rows["x"].to_numpy()).astype(float), rows["rating"].to_numpy(float)
        source = rows["source"].fillna("").to_numpy()
        apart = rows["number"].to_numpy() % 2 == 0
        weight = np.where(apart, rows["n"].to_numpy(float), 0.0)
        weight /= np.maximum(pd.Series(weight).groupby(rows["doc_id"].to_numpy()).transform("sum").to_numpy(), 1)
        weight *= apart.sum() / weight.sum()
        out = np.full(len(y), np.nan)
        for s in np.unique(source):
            fold = source == s
            if not fold.all():
                used = ~fold & apart
                out[fold] = BoostedTrees(trees=35).fit(x[used], y[used], weight[used]).predict(x[fold])
        self.trees = BoostedTrees().fit(x[apart], y[apart], weight[apart])
        out = np.where(np.isnan(out), self.trees.predict(x), out)
        docs = pd.DataFrame({"doc_id": rows["doc_id"], "source": source, "rating": y, "p": out, "n": rows["n"]})
        docs["pn"] = docs["p"] * docs["n"]
        docs = docs.groupby("doc_id").agg(source=("source", "first"), rating=("rating", "first"), pn=("pn", "sum"), n=("n", "sum"), hardest=("p", "max"))
        docs["p"] = docs["pn"] / docs["n"]
        self.knots = isotonic(docs["p"].to_numpy(), docs["rating"].to_numpy())
        docs["level"], docs["one"] = self.calibrated(docs["p"].to_numpy()), docs["rating"] < 1.5
        # isotonic regression is flat in places, so windows are compared before it
        order = np.lexsort((rows["number"].to_numpy(), rows["doc_id"].to_numpy()))
        ids, p, harder = rows["doc_id"].to_numpy()[order], out[order], y[order] >= 1.5
        parts = np.split(np.arange(len(ids)), np.flatnonzero(ids[1:] != ids[:-1]) + 1)
        self.bound = best_bound(docs["hardest"].to_numpy()[docs["one"]], np.array([q for at in parts if harder[at[0]] for q in quarters(p[at])]))
        docs["said"] = (docs["level"] < 1.5) & (docs["hardest"] < self.bound)
        docs["error"] = (docs["level"] - docs["rating"]).abs()
        docs["exact"] = docs["level"].round() == docs["rating"].round()
        docs["both"] = docs["one"] & docs["said"]
        report = docs.groupby("source").agg(texts=("rating", "size"), mean_error=("error", "mean"), same_level=("exact", "mean"), level1=("one", "sum"), called1=("said", "sum"), right1=("both", "sum"))
        report = report.reset_index().astype({"texts": int, "level1": int, "called1": int, "right1": int})
        share = lambda a, b: [x / y if y else None for x, y in zip(report[a], report[b], strict=True)]
        self.report = report.assign(precision=share("right1", "called1"), recall=share("right1", "level1"))
        return self

    def calibrated(self, p: np.ndarray) -> np.ndarray:
        return np.interp(p, *self.knots)


def fit(documents: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> ReadingModel:
    """A model from the rated English texts, at most ``most`` of them (those of least id hash), and the word frequencies of all."""
    rated = labels.where("doc_id is not null and reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("rating")).orderBy(F.xxhash64("doc_id")).limit(most)
    # at most `most` ids and ratings: 16 bytes each
    docs = materialise(english(documents).where("text is not null").join(F.broadcast(rated), "doc_id"))
    texts = docs.select(F.coalesce("source", F.lit("")).alias("source"), "rating").groupBy("source").agg(F.count("*").alias("n"), F.sum("rating").alias("s")).toPandas()  # one row per source
    if texts.empty:
        raise ValueError("no rated English text to fit the reading level on")
    words = vocabulary(documents)
    scores = scored_words(_word_ratings(docs.select("source", "rating", "text"), words), texts, words)
    words.score, words.mean = scores[None][:-1], float(scores[None][-1])
    return ReadingModel().fit(_window_rows(docs, words, scores).toPandas(), words)


def levels(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """``doc_id, source, words, level, hardest, easy`` of all English texts; ``easy``: no window beyond the model's bound."""
    shared = documents.sparkSession.sparkContext.broadcast((model.words, model.trees, model.knots, model.bound))  # size fixed by the model

    def run(frames):
        known, trees, knots, bound = shared.value
        for pdf in frames:
            for s in range(0, len(pdf), SLICE):
                part = pdf.iloc[s : s + SLICE]
                text, n, _, x, count = windows(part["text"].tolist(), known)
                p = trees.predict(x) if len(x) else np.zeros(0)
                weight = np.bincount(text, n, minlength=len(part))
                level, hardest = np.full(len(part), np.nan), np.full(len(part), -np.inf)
                some = weight > 0
                level[some] = np.interp(np.bincount(text, p * n, minlength=len(part))[some] / weight[some], *knots)
                np.maximum.at(hardest, text, p)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy(), "words": count, "level": level, "hardest": np.where(some, np.interp(hardest, *knots), np.nan), "easy": hardest < bound})

    scored = english(documents).mapInPandas(run, "doc_id bigint, source string, words bigint, level double, hardest double, easy boolean")
    return scored.withColumns({c: F.when(F.col("words") > 0, F.col(c)) for c in ("level", "hardest", "easy")})


def easy_throughout(scored: DataFrame, below: float = 1.5, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id`` of texts of level 1 in every window: cut midway between the levels on the whole, and by the model's bound for each window."""
    return scored.where((F.col("words") >= min_words) & (F.col("level") < below) & F.col("easy")).select("doc_id")


def profile(scored: DataFrame) -> DataFrame:
    """Texts per source and rounded level, with words and the mean level."""
    return scored.groupBy("source", F.round("level").cast("int").alias("reading_level")).agg(F.count("*").alias("texts"), F.sum("words").alias("words"), F.round(F.avg("level"), 4).alias("mean_level"))
