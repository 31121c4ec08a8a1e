"""Language identification by language-bitmask n-gram filters.

Each learned n-gram is put into a Bloom filter for its language. The filters are bit-sliced: all languages
share the slots, and a slot holds one bit per language, so one probe of an n-gram (the AND of a few slots)
returns the set of all languages that contain it; beyond 64 languages a slot has further words of 64 bits, so that
every label value is learned. A text's language is the one with most n-grams, after the
expected false positives of its filter are taken off the popcount.

Learning reads, for each language, all documents up to `sample` and beyond that a share that comes to `sample` of
them (those whose keys hash lowest, so the choice does not depend on partitioning). It keeps the `most_grams`
most frequent n-grams of those the sample repeats; both are the bounds of the model's size. Everything is then
scored, whole texts, in one pass without a shuffle.

Defined results: null text, or text without a letter: `und` with score 0; no learned language: `und`
throughout; equal popcounts: the language first in alphabetical order; a null id folds as the empty text;
repeated rows are scored each; other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fold, key_text, read_table

UNKNOWN = "und"
#: Languages to a word of a slot.
WORD = 64
SIZES = (3, 4)
PROBES = 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

#: Whether a code point of the basic plane is a letter; beyond it every code point counts as one if str says so.
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)], dtype=bool)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters as one space, a space at each end."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = cp < 0x10000
    is_letter = _LETTER[np.where(low, cp, 0)]
    if not low.all():
        is_letter[~low] = [chr(c).isalpha() for c in cp[~low]]
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint64)
    cp = np.concatenate(([32], np.where(is_letter, cp, 32), [32])).astype(np.uint64)
    return cp[np.concatenate(([True], (cp[1:] != 32) | (cp[:-1] != 32)))]


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the text's n-grams, with repeats."""
    cp = letters(text)
    if not len(cp):
        return cp
    out = []
    for n in SIZES:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ cp[i : len(cp) - n + 1 + i]) * _ODD[i]
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


@dataclass(frozen=True)
class Filters:
    """Bit-sliced Bloom filters: slots[i] has bit l set if some n-gram of language l falls there.

    From language 64 on the bits are in `further`, one array like slots for each 64 languages.
    """

    languages: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray
    further: tuple[np.ndarray, ...] = ()

    @staticmethod
    def build(by_language: dict[str, np.ndarray], bits: int) -> Filters:
        names = tuple(sorted(by_language))
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(max(1, len(names)), WORD) <= n)
        words = [np.zeros(1 << bits, dtype=kind) for _ in range(max(1, -(-len(names) // WORD)))]
        for i, name in enumerate(names):
            for at in probes(by_language[name], bits):
                words[i // WORD][at] |= kind(1 << i % WORD)
        full = np.array([((words[i // WORD] >> kind(i % WORD)) & kind(1)).mean() for i in range(len(names))])
        return Filters(names, words[0], full**PROBES, tuple(words[1:]))

    def masks(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram, the set of languages that have it, of the 64 languages of a word."""
        slots = self.further[word - 1] if word else self.slots
        bits = int(len(slots)).bit_length() - 1
        first, *rest = probes(hashes, bits)
        out = slots[first]
        for at in rest:
            out &= slots[at]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes = grams(text) if text else np.zeros(0, dtype=np.uint64)
        if not len(hashes) or not self.languages:
            return UNKNOWN, 0.0
        n, counts = len(hashes), []
        for word in range(1 + len(self.further)):
            found = self.masks(hashes, word)
            one = found.dtype.type(1)
            counts += [np.count_nonzero(found & (one << found.dtype.type(i))) for i in range(min(WORD, len(self.languages) - word * WORD))]
        hits = np.array(counts, dtype=float)
        share = np.clip((hits - n * self.false_rate) / (n * np.maximum(1 - self.false_rate, 1e-9)), 0.0, 1.0)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [((hashes * _ODD[i + 1]) >> shift).astype(np.int64) for i in range(PROBES)]


def learn(docs: DataFrame, key: str, text: str, lang: str, sample: int = 1500, most_grams: int = 150_000, least: int = 2, bits: int = 22) -> Filters:
    """Filters from the rows of docs that have text and language, for every language there is."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(key_text(F.col(key)), F.col(lang).cast("string")).alias("h"), F.col(text).cast("string").alias("text"))
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    # one row a language, far smaller than the model
    texts = known.join(F.broadcast(shares), "lang").filter(F.shiftrightunsigned("h", 11) < F.col("share") * 2.0**53).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for name, parts in held.items():
                value, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = grams(t)
                held.setdefault(name, []).append(h)
                size += len(h)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counts = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("rank", rank).filter(F.col("rank") <= most_grams).select("lang", "gram", "n").toArrow()  # at most most_grams a language
    langs = kept.column(0).combine_chunks().dictionary_encode()
    code, gram, n = langs.indices.to_numpy(), kept.column(1).to_numpy().view(np.uint64), kept.column(2).to_numpy()
    order = np.lexsort((gram, -n, code))
    bounds = np.searchsorted(code[order], np.arange(len(langs.dictionary) + 1))
    return Filters.build({name: gram[order[bounds[i] : bounds[i + 1]]] for i, name in enumerate(langs.dictionary.to_pylist())}, bits)


def predict(docs: DataFrame, text: str, filters: Filters, keep: list[str]) -> DataFrame:
    """The columns in keep, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**bits slots of 8 bytes for each 64 languages
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            said = [model.predict(t.as_py()) for t in texts]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"c{i}" for i in range(len(keep))), "lang_pred", "score"])

    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text_"))
    shape = inner.drop("text_").schema.add("lang_pred", "string").add("score", "double")
    out = inner.mapInArrow(run, shape)
    return out.toDF(*[f.name for f in schema.fields])


def keep_known(docs: DataFrame, text: str, filters: Filters, least: float) -> DataFrame:
    """The rows of docs, all columns as they were, whose language is known with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = docs.columns
    at = names.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            said = (model.predict(t.as_py()) for t in batch.column(at))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in said], pa.bool_()))

    return inner.mapInArrow(run, inner.schema).toDF(*names)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fold3 = fold(F.col("doc_id"), 3)
    filters = learn(docs.filter(fold3 != 1), "doc_id", "text", "lang")
    scored = predict(docs.select("doc_id", "text"), "text", filters, ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
