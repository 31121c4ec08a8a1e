"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width, accented Latin, mathematical letters) to plain
letters, deletes combining marks and invisible characters (zero-width, soft hyphen), reads digits and signs inside a
word as the letters they stand for, and leaves words apart by one space. The
lexicon's terms are whole words (" word ") and word beginnings (" begi"); their weights are log odds learned
from labelled rows. Exception phrases (a hit with its neighbour, or the whole word around a hit) that the
labelled rows show to be clean mask the hits inside them. The hits' weights, normalised by the text's
length, go into a logistic score fitted on the same rows.

Learning reads at most `sample` labelled rows, those whose texts hash lowest, one for each text, so it does not
depend on partitioning; the lexicon has at most `most_terms` terms. Every text is then scored whole, in one
pass without a shuffle.

Defined results: a null or empty text has no hits and gets the score of none; without labelled rows of both
kinds every score is the share of toxic rows (0 if there are no rows); an id labelled twice counts as toxic
if one label says so, null labels are left out; repeated rows are scored each; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fold, read_table

SAMPLE = 16_000
MOST_TERMS = 400
MOST_PHRASES = 400
PREFIXES = range(3, 11)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁԛԝαβεικνορτυχ", "abekmhopctyxijsdqwabeikvoptux", strict=True))
#: Digits and signs that stand for letters inside a word.
SUBSTITUTES = dict(zip("0134578@$!|", "oieastbasil", strict=True))


def _plain(c: str) -> str:
    """The folded character; a space for what is not part of a word, nothing (NUL) for what only hides one."""
    if unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return "\0"
    c = HOMOGLYPHS.get(c, c)
    base = unicodedata.normalize("NFKD", c)[:1] if ord(c) > 127 else c
    base = HOMOGLYPHS.get(base, base).lower()[:1]
    return base if base.isalnum() else " "


_TABLE = np.array([ord(_plain(chr(c))) if not 0xD800 <= c < 0xE000 else 32 for c in range(0x10000)], dtype=np.uint32)
_IS_DIGIT = np.zeros(0x10000, dtype=bool)
_IS_DIGIT[[ord(c) for c in SUBSTITUTES]] = True
_LETTER_FOR = np.arange(0x10000, dtype=np.uint32)
for _c, _to in SUBSTITUTES.items():
    _LETTER_FOR[ord(_c)] = ord(_to)
_IS_LETTER = np.array([chr(c).isalpha() for c in _TABLE], dtype=bool)


def folded(text: str | None) -> str:
    """The text as " word word ... word ", or the empty string."""
    if not text:
        return ""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if (high := raw >= 0x10000).any():  # few: each is folded by itself
        raw = raw.copy()
        raw[high] = [ord(_plain(chr(c))) or 0x200B for c in raw[high]]
        raw[raw >= 0x10000] = 32  # letters of scripts that no term has
    if (hidden := _TABLE[raw] == 0).any():
        raw = raw[~hidden]
    if not len(raw):
        return ""
    cp = _TABLE[raw]
    sign = _IS_DIGIT[raw]
    if sign.any():
        # a digit or sign is a letter if letters stand on both sides of its run of digits and signs
        letter = _IS_LETTER[raw]
        at = np.arange(len(raw))
        other = ~sign
        before = np.maximum.accumulate(np.where(other, at, -1))
        after = np.minimum.accumulate(np.where(other, at, len(raw))[::-1])[::-1]
        held = np.concatenate((letter, [False, False]))
        inside = sign & held[np.where(before < 0, len(raw), before)] & held[after]
        cp = np.where(inside, _LETTER_FOR[raw], cp)
    cp = np.concatenate(([32], cp, [32])).astype("<u4")
    cp = cp[np.concatenate(([True], (cp[1:] != 32) | (cp[:-1] != 32)))]
    return cp.tobytes().decode("utf-32-le") if len(cp) > 1 else ""


def terms_of(text: str) -> set[str]:
    """Whole words and word beginnings of a folded text."""
    out = set()
    for word in set(text.split()):
        if word[0].isalpha():
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in PREFIXES if n < len(word))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    phrases: list[str] = field(default_factory=list)
    means: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scales: np.ndarray = field(default_factory=lambda: np.ones(4))
    coef: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = -20.0

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def __setstate__(self, state):
        self.__dict__.update(state, _automaton=None)

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for phrase in self.phrases:
                self._automaton.add_word(phrase, (phrase, None))
            for term, weight in self.weights.items():
                if term not in self.phrases:
                    self._automaton.add_word(term, (term, weight))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, str, float]]:
        """(start, term, weight) of the folded text's matches outside exception phrases, the strongest at each word."""
        if not text or not (self.weights or self.phrases):
            return []
        found, masks = {}, []
        for end, (term, weight) in self.automaton().iter(text):
            start = end - len(term) + 1
            if weight is None:
                masks.append((start, end))
            elif start not in found or weight > found[start][1]:
                found[start] = (term, weight)
        if masks:
            masks.sort()
            starts = [m[0] for m in masks]
            reach = np.maximum.accumulate([m[1] for m in masks])
            k = np.searchsorted(starts, list(found), side="right") - 1
            found = {s: v for (s, v), i in zip(found.items(), k, strict=True) if i < 0 or reach[i] < s + len(v[0]) - 1}
        return [(s, t, w) for s, (t, w) in sorted(found.items())]

    def features(self, text: str) -> tuple[float, float, float, float]:
        hits = self.hits(text)
        words = max(1, text.count(" ") - 1)
        total = sum(h[2] for h in hits)
        return total / math.sqrt(words), total / words, max((h[2] for h in hits), default=0.0), math.log1p(100 * len(hits) / words)

    def score(self, text: str | None) -> float:
        x = (np.array(self.features(folded(text))) - self.means) / self.scales
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.coef) + self.bias)))))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton's steps."""
        self.means, self.scales = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.hstack([(x - self.means) / self.scales, np.ones((len(x), 1))])
        ridge = np.diag([1.0] * 4 + [1e-3])
        beta = np.zeros(5)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        self.coef, self.bias = beta[:4], float(beta[4])


def choose_terms(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, most: int = MOST_TERMS) -> dict[str, float]:
    """Terms by how many more toxic rows have them than their share of clean rows would make likely.

    Of a word beginning and a longer one that nearly the same rows have, the longer stays.
    """
    odds = {t: (math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)), a, b) for t, a, b in counts}
    gain = {t: a * w for t, (w, a, _) in odds.items()}
    out: dict[str, float] = {}
    for t in sorted(gain, key=lambda t: (-gain[t], -len(t), t)):
        w, a, b = odds[t]
        near = [s for s in out if (s.rstrip().startswith(t) or t.rstrip().startswith(s)) and abs(odds[s][1] - a) <= 0.05 * a and abs(odds[s][2] - b) <= max(1, 0.1 * b)]
        if near:
            continue
        out[t] = w
        if len(out) == most:
            break
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, label_key: str | None = None, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled rows: docs (key, text) joined with labels (label_key, toxic)."""
    said = labels.filter(F.col(toxic).isNotNull()).groupBy(F.col(label_key or key).alias("id")).agg((F.max(F.col(toxic).cast("int")) > 0).cast("int").alias("y"))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    # ids and hashes only: the texts are not shuffled
    drawn = rows.select("id", F.xxhash64("text").alias("h")).join(said, "id").groupBy("h").agg(F.max(F.struct("y", "id")).alias("m")).orderBy("h").limit(sample).select("m.id", "h", "m.y")
    chosen = drawn.collect()  # at most `sample` rows of three numbers
    n = Counter(r.y for r in chosen)
    if not n[0] or not n[1]:
        return Lexicon({}, bias=20.0 if n[1] else -20.0)
    spark = docs.sparkSession
    marks = spark.createDataFrame([(r.id, r.h, r.y) for r in chosen], rows.select("id").schema.add("h", "long").add("y", "integer"))
    train = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(marks), ["id", "h"]).select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush():
            for y, c in enumerate(held):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "y", "n"])
                    c.clear()

        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update(terms_of(folded(t)))
                if sum(map(len, held)) > 300_000:
                    yield from flush()
        yield from flush()

    least = max(4, n[1] // 100)
    lift = F.col("a") * n[0] / (F.col("b") + 0.5) / n[1]
    counts = train.mapInArrow(count, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    top = counts.filter((F.col("a") >= least) & (lift >= 4)).orderBy(F.desc(F.col("a") * F.log(lift)), "term").limit(20 * MOST_TERMS).collect()
    lexicon = Lexicon(choose_terms([(r.term, r.a, r.b) for r in top], n[1], n[0]))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update(phrases_at(folded(t), lexicon))
            for y, c in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "y", "n"])

    seen = train.mapInArrow(around, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    clean = seen.filter((F.col("b") >= max(3, n[0] // 5000)) & ((F.col("a") + 0.5) * n[0] < (F.col("b") + 0.5) * n[1])).orderBy(F.desc("b"), "term").limit(MOST_PHRASES).collect()
    lexicon = Lexicon(lexicon.weights, [r.term for r in clean])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.features(folded(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(v) for v in x], pa.list_(pa.float64()))], names=["y", "x"])

    fitted = train.mapInArrow(measure, "y int, x array<double>").toArrow()  # at most `sample` rows of five numbers
    x, y = np.array(fitted.column("x").to_pylist()), np.array(fitted.column("y").to_pylist(), dtype=float)
    order = np.lexsort(np.column_stack([x, y]).T)
    lexicon.fit(x[order], y[order])
    return lexicon


def phrases_at(text: str, lexicon: Lexicon) -> set[str]:
    """The words around each hit: the word itself, with the one before, with the one after."""
    out = set()
    for start, _, _ in lexicon.hits(text):
        end = text.index(" ", start + 1)
        word = text[start : end + 1]
        if word not in lexicon.weights:
            out.add(word)
        left = text.rfind(" ", 0, start)
        if left >= 0:
            out.add(text[left:end + 1])
        right = text.find(" ", end + 1)
        if right >= 0:
            out.add(text[start : right + 1])
    return out


def score(docs: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """id and score, one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most MOST_TERMS + MOST_PHRASES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("id").schema.add("score", "double"))


THRESHOLD = 0.3


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learnt = fold(F.col("doc_id"), 4) != 2
    lexicon = learn(docs.filter(learnt), labels.filter(learnt), "doc_id", "text", "toxic")
    scored = score(docs, "doc_id", "text", lexicon)
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
