"""Language of words and texts by a linear-chain conditional random field.

A word's score for each language is a sum of weights of its character n-grams (those that touch an
end are its affixes) and of its entries in the lexicons; learned transition weights join neighbouring
words. Forward-backward gives every word a distribution over languages that depends on the words
around it, so that a text which switches language keeps both. A text gets the language with the
largest share of its words, and that share as score.

The field is fitted on a bounded sample of labelled texts: at most about ``SAMPLE`` of each
language, half of them for the lexicons and half, cut into spans that are put together anew so that
there are changes of language to learn from, for the weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 120
FOLDS = 5
BUCKETS = 1 << 17
GRAMS = (1, 2, 3, 4)
SPAN = (8, 40)
LENGTH = 96
ROUNDS = 6
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_SEED = 42
_CACHE = 300_000
_GROUP = 400_000


@dataclass
class Field:
    """Weights: languages in order, n-gram buckets, lexicons, transitions."""

    languages: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    entries: np.ndarray
    change: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores (word, language)."""
        bucket, starts = gram_buckets(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for b in bucket:
            out += np.add.reduceat(self.grams[b], starts, axis=0)
        return out + self.entries[[self.lexicon.get(w, 0) for w in words]]


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def gram_buckets(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram length the bucket at every character, and where the words start; 0 for none.

    Words stand between single spaces, so an n-gram that starts or ends with a space is an affix.
    """
    line = " " + " ".join(words) + " " * max(GRAMS)
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    n = int(lengths.sum())
    space = code == 32
    out, value = [], np.zeros(n, np.uint64)
    inner = np.zeros(n, bool)
    for k in range(max(GRAMS)):
        value = (value * np.uint64(0x100000001B3) + code[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if k + 1 in GRAMS:
            mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = 1 + ((mixed >> np.uint64(32)) % np.uint64(BUCKETS - 1)).astype(np.int64)
            bucket[inner] = 0
            out.append(bucket)
        # a space inside: the longer ones run into the next word
        inner |= space[k : k + n] if k else False
    return out, starts


def marginals(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, change: np.ndarray, ahead: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over many texts at once: probabilities (word, language), rows as in ``scores``.

    ``ahead`` receives the probabilities given the words up to each one only.

    Texts are ordered by length, so that at each step the ones that go on are the first few.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(change).astype(np.float32)
    out = np.empty_like(emit)
    longest = int(lengths[0]) if len(lengths) else 0
    going = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    now = None
    for t in range(longest):
        at = starts[: going[t]] + t
        now = emit[at] if now is None else (now[: going[t]] @ step) * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        out[at] = now
    if ahead is not None:
        ahead[:] = out
    back = np.ones((len(lengths), emit.shape[1]), np.float32)
    for t in range(longest - 1, -1, -1):
        m = going[t]
        at = starts[:m] + t
        own = out[at] * back[:m]
        out[at] = own / own.sum(axis=1, keepdims=True)
        own = (back[:m] * emit[at]) @ step.T
        back[:m] = own / own.sum(axis=1, keepdims=True)
    return out


def fit(samples: list[tuple[str, str]]) -> Field:
    """Weights from (text, language) pairs by maximum likelihood with adaptive gradient steps."""
    rng = np.random.default_rng(_SEED)
    languages = sorted({lang for _, lang in samples})
    size = len(languages)
    texts = [(words_of(text), languages.index(lang)) for text, lang in samples]
    texts = [(w, y) for w, y in texts if w]
    rng.shuffle(texts)
    # lexicons: words seen twice or more in a language, coded by the set of languages
    counts: dict[str, list[int]] = {}
    for words, y in texts[::2]:
        for w in words:
            counts.setdefault(w, [0] * size)[y] += 1
    sets = {w: tuple(l for l in range(size) if c[l] > 1) for w, c in counts.items()}
    kinds = {s: i for i, s in enumerate(sorted(set(sets.values()) | {()}))}
    lexicon = {w: kinds[s] for w, s in sets.items() if s}
    field = Field(languages, np.zeros((BUCKETS, size), np.float32), lexicon, np.zeros((len(kinds), size), np.float32), np.zeros((size, size), np.float32))
    spans = []
    for words, y in texts[1::2] or texts:
        at = 0
        while at < len(words):
            take = int(rng.integers(*SPAN))
            spans.append((words[at : at + take], y))
            at += take
    squares = [np.full_like(x, 1e-6) for x in (field.grams, field.entries, field.change)]
    for _ in range(ROUNDS):
        rng.shuffle(spans)
        flat = [w for words, _ in spans for w in words]
        gold = np.repeat([y for _, y in spans], [len(words) for words, _ in spans])
        for at in range(0, len(flat), LENGTH * 128):
            words, y = flat[at : at + LENGTH * 128], gold[at : at + LENGTH * 128]
            _step(field, squares, words, y)
    return field


def _step(field: Field, squares: list, words: list[str], gold: np.ndarray) -> None:
    size = len(field.languages)
    names, which = np.unique(np.array(words, object), return_inverse=True)
    names = names.tolist()
    scores = field.scores(names)[which]
    starts = np.arange(0, len(words), LENGTH)
    lengths = np.minimum(LENGTH, len(words) - starts)
    ahead = np.empty_like(scores)
    p = marginals(scores, starts, lengths, field.change, ahead)
    off = p.copy()
    off[np.arange(len(gold)), gold] -= 1
    by_word = np.zeros((len(names), size), np.float32)
    np.add.at(by_word, which, off)
    # transitions: expected minus seen, between neighbours of one sequence
    inside = np.ones(len(words), bool)
    inside[starts] = False
    at = np.flatnonzero(inside)
    step = np.exp(field.change)
    # a pair's probability: the first word given what is before, the change, and the second word given all
    change = step * (ahead[at - 1].T @ (p[at] / np.maximum(ahead[at - 1] @ step, 1e-30)))
    np.add.at(change, (gold[at - 1], gold[at]), -1)
    bucket, first = gram_buckets(names)
    per_char = np.repeat(by_word, np.diff(np.append(first, len(bucket[0]))), axis=0)
    grams = np.zeros_like(field.grams)
    for b in bucket:
        for l in range(size):
            grams[:, l] += np.bincount(b, per_char[:, l], BUCKETS)
    grams[0] = 0
    entries = np.zeros_like(field.entries)
    np.add.at(entries, [field.lexicon.get(w, 0) for w in names], by_word)
    for weight, square, slope in zip((field.grams, field.entries, field.change), squares, (grams, entries, change)):
        slope = slope / len(words) + 1e-6 * weight
        square += slope * slope
        weight -= (0.1 * slope / np.sqrt(square)).astype(np.float32)


class _Labeller:
    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(field.languages)), np.float32)

    def _scores(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.known) > _CACHE:
            self.known, self.table = {}, self.table[:0]
        new = list({w for words in texts for w in words}.difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.table = np.concatenate([self.table, self.field.scores(new)])
        get = self.known.__getitem__
        return self.table[np.fromiter((get(w) for words in texts for w in words), np.int64)]

    def groups(self, texts: list[list[str]]):
        """(numbers of the texts, their lengths, probabilities of their words), a bounded number of words at a time."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        order = [i for i in order if texts[i]]
        at = 0
        while at < len(order):
            stop, size = at, 0
            while stop < len(order) and (stop == at or size + len(texts[order[stop]]) <= _GROUP):
                size += len(texts[order[stop]])
                stop += 1
            own = [texts[i] for i in order[at:stop]]
            lengths = np.array([len(w) for w in own])
            starts = np.cumsum(lengths) - lengths
            yield order[at:stop], starts, lengths, marginals(self._scores(own), starts, lengths, self.field.change)
            at = stop


_LABELLERS: dict[int, _Labeller] = {}


def _labeller(shared) -> _Labeller:
    """One for each worker and field; its word scores are kept between batches."""
    key = shared.value[0]
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = _Labeller(shared.value[1])
    return _LABELLERS[key]


_TEXT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_WORDS = T.ArrayType(
    T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())])
)


def text_languages(shared):
    def label(text: pa.Array) -> pa.Array:
        own = _labeller(shared)
        texts = [words_of(t) for t in text.to_pylist()]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for rows, starts, lengths, p in own.groups(texts):
            share = np.add.reduceat(p.astype(np.float64), starts, axis=0) / lengths[:, None]
            for i, best, s in zip(rows, share.argmax(axis=1).tolist(), share.max(axis=1)):
                names[i], scores[i] = own.field.languages[best], min(1.0, s)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return F.arrow_udf(label, _TEXT)


def word_languages(shared):
    def label(text: pa.Array) -> pa.Array:
        own = _labeller(shared)
        texts = [words_of(t) for t in text.to_pylist()]
        out: list = [[] for _ in texts]
        for rows, starts, lengths, p in own.groups(texts):
            best, top = p.argmax(axis=1), p.max(axis=1).astype(float)
            for i, a, n in zip(rows, starts, lengths):
                out[i] = [
                    {"word": w, "lang": own.field.languages[b], "p": s}
                    for w, b, s in zip(texts[i], best[a : a + n].tolist(), top[a : a + n].tolist())
                ]
        return pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())])))

    return F.arrow_udf(label, _WORDS)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is never learned from: CRC-32 of its id as text in fold 0; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)) == 0


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field from labelled documents outside the held-out fold; None without any.

    Of a language with more than ``sample`` documents about that many are drawn by the hash of their ids.
    """
    rows = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    scale = 1 << 30
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, scale * sample // n))])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(scale)) < F.element_at(limit, F.col("lang")))
    found = drawn.collect()
    return fit([(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]) if found else None


def _shared(docs: DataFrame, field: Field):
    return docs.sparkSession.sparkContext.broadcast((hash(field.grams.tobytes()), field))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    A null text, one without letters, and any text where nothing could be learned is ``und`` with score
    0. Equal texts get equal results; other columns are not read.
    """
    field = learn(docs, sample)
    if field is None:
        found = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        found = text_languages(_shared(docs, field))(F.col("text"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("f"))
    return rows.select("doc_id", "held_out", "f.lang_pred", "f.score")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, words) of every row: each word of letters with its language and probability."""
    return docs.select("doc_id", word_languages(_shared(docs, field))(F.col("text")).alias("words"))
