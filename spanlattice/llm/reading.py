"""Reading level of texts: a Rasch-style latent difficulty model, fitted by distributed alternating optimisation.

The model. Each unit u has a difficulty b[u]. A unit is a word and, so that words never rated say something too, an ending of a
long word, a word length and a sentence length. A document's expected difficulty m[d] is the mean of b over its unit
occurrences (all of them), and its latent difficulty is t[d] = m[d] + e[d], e[d] ~ N(0, RESIDUAL). A rating is the response of a
rater in a partial credit model: the log odds of level k against k - 1 are t[d] - s[k], with steps s[2], s[3], s[4]. Unit difficulties have a
normal prior of variance PRIOR. (Rasch's model with item difficulties explained by what items consist of is known as the linear logistic test model.)

The fit raises the penalised log-likelihood of all ratings, alternately:

* documents: given b and s, each rated document's t[d] by Newton steps, within the tasks that hold the documents;
* units and steps: given t, the gradients are sums over documents, added up by unit; they move by a preconditioned quasi-Newton step.

A round is taken only if the likelihood rises, and the last one is that whose gain is below TOLERANCE. Units are numbered by a hash into SLOTS places, so the model is
a vector of fixed length, whatever the vocabulary: it is broadcast, and at most SLOTS sums come back. Levels are then given in one scan of all
documents without any shuffle of units. A document's level depends on its text alone: its own rating is not looked at again, and equal texts have equal levels.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlattice.session import Scratch

LEVELS = (1, 2, 3, 4)
#: Places of the model's vector of unit difficulties.
SLOTS = 1 << 18
#: Variances of unit difficulties and of a document's own deviation.
PRIOR, RESIDUAL = 1000.0, 0.5
#: Relative gain of the log-likelihood that ends the fit, and rounds after which it ends in any case.
TOLERANCE, ROUNDS = 0.004, 40
#: Steps remembered by the quasi-Newton direction.
MEMORY = 8
NEWTON_STEPS = 4


def _patterns():
    import regex

    words = regex.compile(r"\p{Han}+|[\p{Katakana}ー]+|\p{Hiragana}+|[\p{L}\p{M}]+(?:['’]\p{L}+)?")
    ends = regex.compile(r"[.!?。؟！？]+(?=\s|$|[\p{Han}\p{Hiragana}\p{Katakana}])|[。！？؟\n]")
    return words, ends


def units_of(text: str, words, ends) -> Counter:
    """Units with their occurrences; empty if the text has no word."""
    found: Counter = Counter()
    sentences: Counter = Counter()
    for sentence in ends.split(unicodedata.normalize("NFKC", text).lower()):
        if got := words.findall(sentence):
            found.update(got)
            sentences[f"#sentence {min(12, int(2 * math.log2(len(got))))}"] += 1
    out = found + sentences
    for w, n in found.items():
        out[f"#length {min(9, len(w) // 2)}"] += n
        if len(w) > 6:
            out["#ending " + w[-4:]] += n
    return out


def slot_of(unit: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass")) % SLOTS


def _slots(texts: list[str], words, ends, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of texts with a word; slots of their units, each unit's share of its text's occurrences, and how many units each text has)."""
    at, slots, shares, counts = [], [], [], []
    for i, text in enumerate(texts):
        if found := units_of(text, words, ends):
            total = sum(found.values())
            for unit, n in found.items():
                k = known.get(unit)
                if k is None:
                    if len(known) > 1_000_000:  # of a task
                        known.clear()
                    k = known[unit] = slot_of(unit)
                slots.append(k)
                shares.append(n / total)
            at.append(i)
            counts.append(len(found))
    return np.array(at, np.int64), np.array(slots, np.int64), np.array(shares), np.array(counts, np.int64)


def level_chances(t: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The partial credit model: for each latent difficulty the chances of the levels."""
    k = np.arange(len(LEVELS))
    x = t[:, None] * k - np.concatenate([[0.0], np.cumsum(steps)])
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def respond(m: np.ndarray, n: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, its gradient by ``m``, its gradient by ``steps``) of documents with ``n`` ratings of each level, at their best latent difficulties."""
    k = np.arange(len(LEVELS))
    rated, total = n @ k, n.sum(axis=1)
    t = m.copy()
    for _ in range(NEWTON_STEPS):
        p = level_chances(t, steps)
        mean = p @ k
        t = t + (rated - total * mean - (t - m) / RESIDUAL) / (total * (p @ k**2 - mean**2) + 1 / RESIDUAL)
    p = level_chances(t, steps)
    value = float((n * np.log(np.maximum(p, 1e-300))).sum() - ((t - m) ** 2).sum() / (2 * RESIDUAL))
    by_steps = np.array([float((total * p[:, c:].sum(axis=1) - n[:, c:].sum(axis=1)).sum()) for c in k[1:]])
    return value, (t - m) / RESIDUAL, by_steps


class Direction:
    """Quasi-Newton ascent directions from the last MEMORY steps, over a diagonal of curvatures."""

    def __init__(self, curvature: np.ndarray):
        self.curvature, self.past = curvature, []

    def learn(self, step: np.ndarray, fall: np.ndarray) -> None:
        """``fall`` is by how much the gradient fell along ``step``."""
        if (along := float(step @ fall)) > 1e-10:
            self.past = [*self.past, (step, fall, along)][-MEMORY:]

    def of(self, gradient: np.ndarray) -> np.ndarray:
        rest, used = gradient.copy(), []
        for step, fall, along in reversed(self.past):
            used.append(float(step @ rest) / along)
            rest -= used[-1] * fall
        out = rest / self.curvature
        if self.past:
            step, fall, along = self.past[-1]
            out *= along / float(fall @ (fall / self.curvature))
        for (step, fall, along), a in zip(self.past, reversed(used)):
            out += step * (a - float(fall @ out) / along)
        return out


class Levels:
    """The fitted model.

    ``levels``: (doc_id, level, difficulty, p_demanding), one row per document with a word: the most probable level, the expected difficulty m[d] and the
    probability of level 3 or 4. ``log``: (round, penalised log-likelihood), rising. ``words()``: (unit, difficulty, n): b of each unit, and the number of its documents.
    Null ratings and ratings outside 1 to 4 are left out, equal ratings of a document count once, different ones all count. Null,
    empty and wordless texts have no level. Without any usable rating there is no scale, and no row. Rows without a doc_id are left
    out; of rows with equal doc_id one with a word counts; further columns are not read. The caller may ``clear`` the ``scratch`` tables.
    """

    def __init__(self, docs: DataFrame, ratings: DataFrame, rounds: int = ROUNDS):
        self.spark = spark = docs.sparkSession
        self.scratch = scratch = Scratch(spark, "levels")
        self.texts = docs.filter("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        given = ratings.filter("doc_id is not null").filter(F.col("reading_level").isin(*LEVELS)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "reading_level").distinct()
        given = given.groupBy("doc_id").agg(*[F.sum((F.col("reading_level") == k).cast("double")).alias(f"n{k}") for k in LEVELS])

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, ends = _patterns()
            known: dict[str, int] = {}
            for b in batches:
                at, slots, shares, counts = _slots(b.column(1).to_pylist(), words, ends, known)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (slots, shares)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *lists, *[b.column(j).take(pa.array(at)) for j in range(2, 6)]], names)

        names = ["doc_id", "slots", "shares", *[f"n{k}" for k in LEVELS]]
        made = self.texts.join(given, "doc_id").select("doc_id", "text", *names[3:]).mapInArrow(take, "doc_id bigint, slots array<bigint>, shares array<double>, " + ", ".join(f"{x} double" for x in names[3:]))
        self.rated = scratch.keep(made.dropDuplicates(["doc_id"]).drop("doc_id"))
        self.n_rated = self.rated.count()
        self.log: list[tuple[int, float]] = []
        self.empty = not self.n_rated
        if not self.empty:
            self._fit(rounds)
            self.levels = self._score()

    def _sums(self, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(penalised log-likelihood, gradient, curvatures) at unit difficulties and steps; sums over documents made by the tasks."""
        shared = self.spark.sparkContext.broadcast(at)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, steps = shared.value[:SLOTS], shared.value[SLOTS:]
            slope, curve = np.zeros(len(shared.value) + 1), np.zeros(len(shared.value) + 1)
            for batch in batches:
                slots, shares = (batch.column(j).flatten().to_numpy() for j in (0, 1))
                which = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
                n = np.stack([batch.column(j).to_numpy() for j in range(2, 6)], axis=1)
                m = np.bincount(which, shares * b[slots], batch.num_rows)
                value, by_m, by_steps = respond(m, n, steps)
                slope[:SLOTS] += np.bincount(slots, shares * by_m[which], SLOTS)
                curve[:SLOTS] += np.bincount(slots, shares * n.sum(axis=1)[which] / 2, SLOTS)
                slope[SLOTS:-1] += by_steps
                curve[SLOTS:-1] += n.sum() / 5
                slope[-1] += value
            k = np.flatnonzero((slope != 0) | (curve != 0))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(slope[k]), pa.array(curve[k])], ["at", "slope", "curve"])

        got = self.rated.mapInArrow(add, "at bigint, slope double, curve double").groupBy("at").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve")).toArrow()  # at most SLOTS + 4 rows
        shared.destroy()
        slope, curve = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
        k = got.column("at").to_numpy()
        slope[k], curve[k] = got.column("slope").to_numpy(), got.column("curve").to_numpy()
        b = at[:SLOTS]
        slope[:SLOTS] -= b / PRIOR
        curve[:SLOTS] += 1 / PRIOR
        return float(slope[-1] - b @ b / (2 * PRIOR)), slope[:-1], curve[:-1]

    def _fit(self, rounds: int) -> None:
        at = np.concatenate([np.zeros(SLOTS), np.arange(len(LEVELS) - 1) - 1.0])
        value, slope, curve = self._sums(at)
        self.log.append((0, value))
        toward = Direction(curve)
        for k in range(1, rounds + 1):
            step = toward.of(slope)
            while True:  # halved until the likelihood rises
                new, its_slope, _ = self._sums(at + step)
                if new >= value or float(np.abs(step).max()) < 1e-9:
                    break
                step = step / 2
            if new < value:
                break
            gain = (new - value) / max(abs(value), 1e-9)
            toward.learn(step, slope - its_slope)
            at, value, slope = at + step, new, its_slope
            self.log.append((k, value))
            if gain < TOLERANCE:
                break
        self.difficulty, self.steps = at[:SLOTS], at[SLOTS:]

    def _score(self) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((self.difficulty.astype(np.float32), self.steps))  # SLOTS numbers

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, ends = _patterns()
            known: dict[str, int] = {}
            b, steps = shared.value
            for batch in batches:
                at, slots, shares, counts = _slots(batch.column(1).to_pylist(), words, ends, known)
                m = np.bincount(np.repeat(np.arange(len(at)), counts), shares * b[slots], len(at))
                p = level_chances(m, steps)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array((p.argmax(axis=1) + 1).astype(np.int32)), pa.array(m), pa.array(p[:, 2] + p[:, 3])], ["doc_id", "level", "difficulty", "p_demanding"])

        return self.texts.mapInArrow(score, "doc_id bigint, level int, difficulty double, p_demanding double").dropDuplicates(["doc_id"])

    def words(self) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.difficulty)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, ends = _patterns()
            for batch in batches:
                seen = Counter(u for text in batch.column(1).to_pylist() for u in units_of(text, words, ends))
                units = list(seen)
                b = shared.value[[slot_of(u) for u in units]] if units else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(b, pa.float64()), pa.array(list(seen.values()), pa.int64())], ["unit", "difficulty", "n"])

        counted = self.texts.dropDuplicates(["doc_id"]).mapInArrow(count, "unit string, difficulty double, n bigint")
        return counted.groupBy("unit").agg(F.first("difficulty").alias("difficulty"), F.sum("n").alias("n"))


def reading_levels(docs: DataFrame, ratings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Levels(...).levels, an empty table if there is no usable rating."""
    fit = Levels(docs, ratings, rounds)
    if fit.empty:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, level int, difficulty double, p_demanding double")
    return fit.scratch.handed(fit.levels)
