"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of one fixed public vocabulary
(single characters outside it have one small probability in all languages). The
probability of a word is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words, lower-cased and
split at white space. The piece probabilities are fitted by expectation
maximisation (expected counts over all segmentations, forward and backward) on
the words of at most ``per_language`` whole texts of each language, words of any
length included (long ones in logarithms, so that nothing underflows).

The prediction is the language of the largest log-likelihood, ties to the
smaller name; the score is its share after the log-likelihoods were divided by
the square root of the number of words (1 over the number of languages at least).

Null text and text without a letter are ``und`` with score 0, and so is every
text where no language was learned. Languages are the non-null values of the
training rows; an id that bears two of them teaches both. Repeated rows get equal
results, and texts of any length are read whole. An empty table gives no rows.
Other columns than id, text and language are not read, so that names cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroba.llm.common import crc32_fold, text_batches
from corroba.llm.features import smallest_hashes
from corroba.llm.tokens import vocabulary

PIECES = "piece_bpe_32k.model"
#: The probability of a character outside the vocabulary.
UNKNOWN = 1e-8
MAX_LANGUAGES = 200
#: Words whose log-likelihoods a worker remembers.
CACHE_WORDS = 800_000
#: Longer words are scored one by one, with rescaling, and not remembered.
SHORT = 24
#: Longer words are fitted in logarithms: the product of so many least probabilities is still a normal number.
LINEAR = 36
_LETTER = re.compile(r"[^\W\d_]")
#: Characters after which the forward sums are rescaled.
_RESCALE = 24


def public_pieces(path: str = PIECES) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.lower() for p in found if p})


def longest(pieces) -> int:
    """How far the forward algorithm looks back."""
    return max(map(len, pieces), default=1)


def segments(word: str, index: dict[str, int], back: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) of all pieces in the word, by end; piece -1 is an unknown character."""
    out = []
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - back), j):
            k = index.get(word[i:j])
            if k is not None:
                out.append((i, j, k))
            elif i == j - 1:
                out.append((i, j, -1))
    return out


def _plain_counts(seg: list, size: int, n: int, prob: list[float], counts: np.ndarray) -> None:
    fore, back = [1.0] + [0.0] * size, [0.0] * size + [1.0]
    for i, j, k in seg:
        fore[j] += fore[i] * (prob[k] if k >= 0 else UNKNOWN)
    for i, j, k in reversed(seg):
        back[i] += back[j] * (prob[k] if k >= 0 else UNKNOWN)
    scale = n / fore[-1]
    for i, j, k in seg:
        if k >= 0:
            counts[k] += fore[i] * prob[k] * back[j] * scale


def _log_counts(seg: list, size: int, n: int, prob: list[float], counts: np.ndarray) -> None:
    fore, back = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0]
    cost = [math.log(prob[k] if k >= 0 else UNKNOWN) for _, _, k in seg]

    def add(a: float, b: float) -> float:
        if a < b:
            a, b = b, a
        return a if b == -math.inf else a + math.log1p(math.exp(b - a))

    for (i, j, _), c in zip(seg, cost, strict=True):
        fore[j] = add(fore[j], fore[i] + c)
    for (i, j, _), c in zip(reversed(seg), reversed(cost), strict=True):
        back[i] = add(back[i], back[j] + c)
    for (i, j, k), c in zip(seg, cost, strict=True):
        if k >= 0:
            counts[k] += n * math.exp(fore[i] + c + back[j] - fore[-1])


def expected_counts(words: dict[str, int], pieces: int, prob: list[float], parts: dict[str, list]) -> np.ndarray:
    """Expected uses of each piece over all segmentations of all words."""
    counts = np.zeros(pieces)
    for word, n in words.items():
        (_plain_counts if len(word) <= LINEAR else _log_counts)(parts[word], len(word), n, prob, counts)
    return counts


def fit_language(words: dict[str, int], index: dict[str, int], back: int, rounds: int = 3, smooth: float = 0.05) -> np.ndarray:
    parts = {w: segments(w, index, back) for w in words}
    counts = np.zeros(len(index))
    for w, n in words.items():
        for _, _, k in parts[w]:
            if k >= 0:
                counts[k] += n
    prob = (counts + smooth) / (counts + smooth).sum()
    for _ in range(rounds):
        counts = expected_counts(words, len(index), prob.tolist(), parts)
        prob = (counts + smooth) / (counts + smooth).sum()
    return prob


class LanguageModel:
    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.pieces, self.probs = languages, pieces, probs
        self.reset()

    def reset(self) -> None:
        # Row 0 is no piece, row 1 a character outside the vocabulary.
        k = len(self.languages)
        self.rows = np.vstack([np.zeros((1, k)), np.full((1, k), UNKNOWN), self.probs.T.reshape(len(self.pieces), k)])
        self.index = {p: i + 2 for i, p in enumerate(self.pieces)} if self.languages else {}
        self.back = longest(self.pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.empty((1024, len(self.languages)))

    def __getstate__(self) -> tuple:
        return self.languages, self.pieces, self.probs

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.pieces, self.probs = state
        self.reset()

    def word(self, word: str) -> np.ndarray:
        """Log-probability of "▁" + word in every language; rescaled on the way, for words of any length."""
        text, k = "▁" + word, len(self.languages)
        fore = np.zeros((self.back + 1, k))  # a ring of the last sums
        fore[0] = 1
        logs = np.zeros(k)
        for j in range(1, len(text) + 1):
            starts = range(max(0, j - self.back), j)
            found = [self.index.get(text[i:j], int(i == j - 1)) for i in starts]
            used = [(i % (self.back + 1), r) for i, r in zip(starts, found, strict=True) if r]
            fore[j % (self.back + 1)] = (fore[[u[0] for u in used]] * self.rows[[u[1] for u in used]]).sum(0)
            if j % _RESCALE == 0:
                top = fore.max(0)
                top[top == 0] = 1e-300
                logs += np.log(top)
                fore /= top
        return logs + np.log(np.maximum(fore[len(text) % (self.back + 1)], 1e-300))

    def short_words(self, words: list[str]) -> np.ndarray:
        """The same for words of one length, at most ``SHORT``, all at once and without rescaling."""
        texts = ["▁" + w for w in words]
        size, get = len(texts[0]), self.index.get
        fore = [np.ones((len(texts), len(self.languages)))]
        for j in range(1, size + 1):
            now = np.zeros_like(fore[0])
            for i in range(max(0, j - self.back), j):
                row = np.array([get(t[i:j], 0) for t in texts])
                if i == j - 1:
                    row[row == 0] = 1
                at = np.flatnonzero(row)
                if len(at):
                    now[at] += fore[i][at] * self.rows[row[at]]
            fore.append(now)
        return np.log(np.maximum(fore[-1], 1e-300))

    def remember(self, words: list[str], logs: np.ndarray) -> None:
        n = len(self.known)
        if n + len(words) > len(self.logs):
            self.logs = np.vstack([self.logs[:n], np.empty((n + len(words), len(self.languages)))])
        self.logs[n : n + len(words)] = logs
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def learn(self, missing: set[str]) -> list[str]:
        """Remembers the words; returns the long ones, which came last and are to be taken out again."""
        by_size: dict[int, list[str]] = defaultdict(list)
        for w in missing:
            by_size[min(len(w), SHORT + 1)].append(w)
        for size, words in sorted(by_size.items()):
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                self.remember(part, self.short_words(part) if size <= SHORT else np.array([self.word(w) for w in part]))
        return by_size.get(SHORT + 1, [])

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for a, b in text_batches(texts):
            split = [t.lower().split() if t and self.languages and _LETTER.search(t) else [] for t in texts[a:b]]
            missing = set().union(*split).difference(self.known)
            if len(self.known) + len(missing) > CACHE_WORDS:
                self.forget()
                missing = set().union(*split)
            long = self.learn(missing)
            for words in split:
                if not words:
                    out.append(("und", 0.0))
                    continue
                total = self.logs[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
                best = int(np.argmax(total))
                z = np.exp((total - total[best]) / math.sqrt(len(words)))
                out.append((self.languages[best], float(z[best] / z.sum())))
            for w in long:
                del self.known[w]
        return out


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, pieces: list[str]) -> LanguageModel:
    langs = [r[0] for r in rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string")).distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs.sort()
    named = rows.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__by"))
    chosen = smallest_hashes(named, per_language, 5).withColumnRenamed("__by", "__lang") if langs else None  # at most per_language times MAX_LANGUAGES
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    if chosen is not None:
        texts = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text"))
        sample = texts.join(F.broadcast(chosen), ["__id", "__lang"], "left_semi").select(F.col("__lang").alias("lang"), F.col("__text").alias("text")).where("text is not null")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total.update((lang, w) for w in text.lower().split())
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["lang", "word", "n"])

        for r in sample.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toLocalIterator():
            counts[r.lang]["▁" + r.word] = r.n
    index = {p: i for i, p in enumerate(pieces)}
    langs = [x for x in langs if counts[x]]
    back = longest(pieces)
    probs = np.array([fit_language(counts[x], index, back) for x in langs]).reshape(len(langs), len(pieces))
    return LanguageModel(langs, pieces, probs)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, per_language: int = 250, pieces: str = PIECES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row a row of ``docs``; rows of the held-out fold teach nothing."""
    fold = crc32_fold(id_col, folds)
    model = fit(docs.where(fold != held_out), id_col, text_col, lang_col, per_language, public_pieces(pieces))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, at most 32,000 x 200
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
