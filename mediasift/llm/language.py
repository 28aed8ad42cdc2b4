"""Operator 5: language identification by interpolated Kneser-Ney character models.

One model per language, learned from a bounded sample of labelled rows: SAMPLE_DOCS documents of each
language with at most SAMPLE_CHARS characters, picked by a hash of the text (both are parameters; whole
texts are used, each once however many copies there are and whatever ids they have). A language with fewer such documents is also learned from longer ones, cut to SAMPLE_CHARS. A model reads the letters of lower-cased words, with a start and an end mark to each word,
in orders 1 to ORDER; its n-grams and contexts are sorted arrays of 64-bit hashes. A text is assigned to the
language with the lowest cross-entropy per character; because words are independent, each distinct word is
scored once. One sampled document in five is held back to calibrate rejection, twice: against its own language,
and with that language left out, as text of a language that was never learned. A text is rejected if it has no
letter, or, from REJECT_CHARS characters on, if its cross-entropy lies above the median of its language by more than
halfway from the highest of held-back texts of the language to the median of left-out ones that go to it (at least
REJECT_Z deviations; with one language alone there is nothing to leave out, and REJECT_BITS bits a character count).
Short texts get a wider margin, as held-back ones do.

Edge cases: null text, or text without a letter: `und`, score 0, rejected; ties go to the first language in
alphabetical order; rows without lang are predicted but never learned from; without any labelled row every
text is `und` and rejected; an empty table gives no rows; `identify` keeps all columns of its input and adds
lang_pred, score and rejected (replacing columns of these names).
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.common import give_back, in_batches, worker_cache

ORDER = 4
SAMPLE_DOCS, SAMPLE_CHARS, HELD_EVERY = 600, 10_000, 5
REJECT_Z, REJECT_BITS, REJECT_CHARS = 8.0, 4.0, 20
#: The sample is drawn among the rows of the lowest hashes, so many times as many as it takes.
DRAW_FROM = 4
LETTERS = re.compile(r"[^\W\d_]+")
START, END = 1, 2
ALPHABET = 1024
ADDED = ("lang_pred", "score", "rejected")
ROWS_AT_ONCE, BATCH_CHARS, CACHE_WORDS, LEARN_WORDS = 250, 1_000_000, 250_000, 10_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(words: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each character or end mark of the words: gram and context hashes by order, and the highest order there."""
    text = np.frombuffer("".join(chr(START) + w + chr(END) for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = text == START
    place = np.arange(len(text)) - np.maximum.accumulate(np.where(start, np.arange(len(text)), 0))
    keep = np.flatnonzero(~start)
    grams, contexts = [], []
    h, context = np.zeros(len(text), np.uint64), np.zeros(len(text), np.uint64)
    for k in range(order):
        shifted = np.concatenate([np.zeros(k, np.uint64), text[: len(text) - k]]) if k else text
        h = _mix(h + shifted * np.uint64(2 * k + 3) + np.uint64(k + 1))
        grams.append(h[keep])
        contexts.append(context[keep])
        context = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    return keep, grams, contexts, np.minimum(order, place[keep] + 1)


@dataclass
class Model:
    """p_k = alpha_k(gram) + gamma_k(context) * p_{k-1}, from sorted hash arrays; p_0 is uniform."""

    grams: list[np.ndarray]
    alphas: list[np.ndarray]
    contexts: list[np.ndarray]
    gammas: list[np.ndarray]
    alphabet: int

    def log2(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log2 probabilities, and number of characters and end marks, of each word."""
        keep, grams, contexts, highest = _grams(words, len(self.grams))
        p = np.full(len(keep), 1.0 / self.alphabet)
        for k, (g, a, c, y) in enumerate(zip(self.grams, self.alphas, self.contexts, self.gammas, strict=True)):
            p = np.where(highest > k, _look(g, a, grams[k], 0.0) + _look(c, y, contexts[k], 1.0) * p, p)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return np.add.reduceat(np.log2(p), np.cumsum(sizes) - sizes), sizes


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], missing)


def train(texts: list[str], order: int = ORDER) -> Model:
    """An interpolated Kneser-Ney model of the words of texts."""
    words = [w for t in texts for w in LETTERS.findall(t.lower())]
    model = Model([], [], [], [], ALPHABET)
    if not words:
        return model
    _, grams, contexts, highest = _grams(words, order)
    model.alphabet = len({c for w in words for c in w}) + 2
    for k in range(order):
        have = highest > k
        top = k == order - 1
        # Counts at the top and of grams that begin a word; else the number of characters seen before a gram.
        plain = have & (highest == k + 1) if not top else have
        keys, ctx, count = _count(grams[k][plain], contexts[k][plain])
        if not top:
            longer = highest > k + 1
            _, one = np.unique(grams[k + 1][longer], return_index=True)
            more, more_ctx, more_count = _count(grams[k][longer][one], contexts[k][longer][one])
            keys, ctx, count = np.concatenate([keys, more]), np.concatenate([ctx, more_ctx]), np.concatenate([count, more_count])
            keys, back = np.unique(keys, return_inverse=True)
            first = np.zeros(len(keys), np.uint64)
            first[back] = ctx
            ctx, count = first, np.bincount(back, count, len(keys))
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        owners, back = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(back, count, len(owners)), np.bincount(back, minlength=len(owners))
        model.grams.append(keys)
        model.alphas.append(np.maximum(count - d, 0) / total[back])
        model.contexts.append(owners)
        model.gammas.append(d * kinds / total)
    return model


def _count(keys: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got, first, count = np.unique(keys, return_index=True, return_counts=True)
    return got, ctx[first], count.astype(np.float64)


@dataclass
class Identifier:
    """Models by language with what calibration found: the median of the cross-entropy of each, and the margin above it."""

    languages: list[str]
    models: list[Model]
    usual: list[tuple[float, float]]
    number: int = 0

    def reader(self) -> WordScores:
        return worker_cache(("language", self.number), lambda: WordScores(self))


class WordScores(dict):
    """Distinct words and their scores; one lives in each Python worker. Emptied when it holds CACHE_WORDS."""

    def __init__(self, identifier: Identifier):
        self.identifier, self.number, self.new = identifier, identifier.number, []
        self.scores, self.chars = array.array("d"), array.array("q")

    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        self.new.append(word)
        return slot

    def _learn(self) -> None:
        for i in range(0, len(self.new), LEARN_WORDS):
            some = self.new[i : i + LEARN_WORDS]
            got = [m.log2(some) for m in self.identifier.models]
            self.scores.frombytes(np.stack([g[0] for g in got], 1).tobytes())
            self.chars.frombytes(got[0][1].tobytes())
        self.new.clear()

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy by language, posterior by language, characters) of each text; no letters: 0 characters."""
        languages = len(self.identifier.models)
        if len(self) > CACHE_WORDS:
            self.clear()
            self.scores, self.chars = array.array("d"), array.array("q")
        found = [LETTERS.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        slots = np.fromiter((self[w] for words in found for w in words), np.int64, int(sizes.sum()))
        self._learn()
        some = np.flatnonzero(sizes)
        total, chars = np.zeros((len(texts), languages)), np.zeros(len(texts), np.int64)
        if len(some):
            at = np.cumsum(sizes[some]) - sizes[some]
            scores = np.frombuffer(self.scores, np.float64).reshape(-1, languages)
            for k in range(languages):
                total[some, k] = np.add.reduceat(scores[slots, k], at)
            chars[some] = np.add.reduceat(np.frombuffer(self.chars, np.int64)[slots], at)
        entropy = -total / np.maximum(chars, 1)[:, None]
        # Characters are not independent: evidence counts at a tenth.
        odds = (entropy.min(axis=1, keepdims=True) - entropy) * np.maximum(chars, 1)[:, None] / 10
        posterior = np.exp2(odds)
        return entropy, posterior / posterior.sum(axis=1, keepdims=True), chars


def length_factor(chars: np.ndarray) -> np.ndarray:
    """How much wider the margin of a text of so many characters is."""
    return np.sqrt(1 + 20 / np.maximum(chars, 1))


def calibrate(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, float]]:
    """(median, margin) of each language from (cross-entropies by language, characters) of its held-back texts."""
    long = [(e[c >= REJECT_CHARS], c[c >= REJECT_CHARS]) for e, c in held]
    out = []
    for k, (entropy, chars) in enumerate(long):
        if not len(chars):
            out.append((0.0, float("inf")))
            continue
        own = entropy[:, k]
        middle = float(np.median(own))
        least = REJECT_Z * max(0.05, 1.4826 * float(np.median(np.abs(own - middle))))
        top = float(((own - middle) / length_factor(chars)).max())
        foreign = []
        for j, (e, c) in enumerate(long):
            if j != k and len(c):
                nearest = np.where(np.arange(e.shape[1]) == j, np.inf, e).argmin(axis=1) == k
                foreign.append(((e[:, k] - middle) / length_factor(c))[nearest])
        left_out = np.concatenate([np.zeros(0), *foreign])
        out.append((middle, max(least, top, (top + float(np.median(left_out))) / 2 if len(left_out) else REJECT_BITS)))
    return out


def fit(docs: DataFrame, learn: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Identifier:
    """Learn from the rows of docs (text, lang) where `learn` holds and lang is not null.

    Texts are drawn by their own hash and once each, so that neither ids nor copies change what is learned.
    """
    usable = docs["lang"].isNotNull() & docs["text"].isNotNull()
    rows = docs.filter(usable if learn is None else usable & learn).select(docs["lang"].alias("lang"), docs["text"].alias("text"), (F.char_length(docs["text"]) > sample_chars).alias("_long"), F.xxhash64(docs["text"], F.lit("sample")).alias("_h"))
    pick = Window.partitionBy("lang").orderBy("_long", "_h")
    n = rows.groupBy("lang", "_long").agg(F.approx_count_distinct("_h").alias("_n"))  # a row or two a language
    drawn = rows.select("lang", "_long", "_h").join(F.broadcast(n), ["lang", "_long"])
    drawn = drawn.filter((F.col("_h").cast("double") / 2.0**63 + 1) / 2 <= DRAW_FROM * sample_docs / F.col("_n")).select("lang", "_long", "_h").distinct()
    ids = drawn.withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= sample_docs).select("lang", "_h", "_r")  # sample_docs rows a language
    excerpt = F.when(F.col("_long"), F.regexp_replace(F.substring("text", 1, sample_chars), r"\s\S*$", "")).otherwise(F.col("text"))  # of whole words
    sample = rows.join(F.broadcast(ids), ["lang", "_h"]).groupBy("lang", "_r").agg(F.min(excerpt).alias("text"))

    def learn_one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_r")
        held = np.arange(len(frame)) % HELD_EVERY == HELD_EVERY - 1
        m = train(frame.text[~held].tolist())
        out = [(frame.lang.iloc[0], -1, [], str(m.alphabet).encode(), b"")]
        for kind, keys, values in [(k, a, b) for k, (a, b) in enumerate(zip([*m.grams, *m.contexts], [*m.alphas, *m.gammas], strict=True))]:
            out.append((frame.lang.iloc[0], kind, [], keys.astype("<u8").tobytes(), values.astype("<f8").tobytes()))
        out.append((frame.lang.iloc[0], -2, frame.text[held].tolist(), b"", b""))
        return pd.DataFrame(out, columns=["lang", "kind", "held", "keys", "values"])

    got: dict[str, dict[int, tuple]] = {}
    for r in sample.groupBy("lang").applyInPandas(learn_one, "lang string, kind int, held array<string>, keys binary, values binary").collect():
        got.setdefault(r["lang"], {})[r["kind"]] = (r["held"], bytes(r["keys"]), bytes(r["values"]))
    languages, models, held = sorted(got), [], []
    for lang in languages:
        parts = got[lang]
        arrays = [(np.frombuffer(parts[k][1], "<u8"), np.frombuffer(parts[k][2], "<f8")) for k in range(len(parts) - 2)]
        n = len(arrays) // 2
        models.append(Model([a[0] for a in arrays[:n]], [a[1] for a in arrays[:n]], [a[0] for a in arrays[n:]], [a[1] for a in arrays[n:]], int(parts[-1][1])))
        held.append(parts[-2][0])
    for m in models:
        m.alphabet = max(ALPHABET, *(x.alphabet for x in models))  # a letter that a language never showed costs the same in all
    identifier = Identifier(languages, models, [], int.from_bytes(np.random.default_rng().bytes(7), "little"))
    identifier.usual = calibrate([WordScores(identifier).predict(texts)[::2] if texts else (np.zeros((0, len(models))), np.zeros(0)) for texts in held])
    return identifier


def identify(docs: DataFrame, identifier: Identifier, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with lang_pred, score (the posterior of the language) and rejected, or as `added` names them."""
    docs = docs.drop(*added)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(identifier)  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from answers(batches)
        give_back()

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            texts = [t or "" for t in b.column(names.index("text")).to_pylist()]
            if not known.models:
                entropy, posterior, chars = np.zeros((len(texts), 1)), np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64)
            else:
                reader, parts, begin, n = known.reader(), [], 0, 0
                for i, t in enumerate(texts):
                    n += len(t)
                    if n >= BATCH_CHARS or i + 1 == len(texts):
                        parts.append(reader.predict(texts[begin : i + 1]))
                        begin, n = i + 1, 0
                entropy, posterior, chars = (np.concatenate([p[k] for p in parts]) for k in range(3))
            best = entropy.argmin(axis=1)
            none = chars == 0
            at = np.arange(len(best))
            usual = np.array(known.usual or [(0.0, np.inf)])
            odd = (chars >= REJECT_CHARS) & (entropy[at, best] > usual[best, 0] + usual[best, 1] * length_factor(chars))
            lang = ["und" if e else known.languages[k] for k, e in zip(best.tolist(), none.tolist(), strict=True)]
            score = np.where(none, 0.0, posterior[at, best])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(none | odd)], [*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs).mapInArrow(predict, f"{fields}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` boolean")
