"""SentencePiece encoding by sampling, and decoding.

encode() gives each text its k sampled segmentations without replacement, by Gumbel top-k: each segmentation's
log probability is perturbed by a Gumbel variable and the k largest are taken. The search is a perturbed A-star
over the lattice: the text's root draws the largest perturbed value; going down, the child taken has its
parent's value and a child not taken draws a Gumbel truncated at it, an exact bound for all below. The
frontier's largest value is the next sample. Children not taken are kept together for each word ("this word
differs") and are told apart only when their turn comes, which leaves the distribution as it is.

The lattice is that of the model's pieces over the text's characters, with byte pieces for characters the
model lacks. A piece never holds a space after another character, so the lattice splits at words; equal words
of a batch share theirs. The model is a BPE model: its scores are ranks, so a piece's probability is taken by
rank r (from 0) as proportional to 1 / (r + 10), to the power alpha. A segmentation's probability is the product
over its pieces, normalised over the lattice by a backward pass.

Every random number is a hash of (seed, row's key, sample, word, step), so a row's samples depend neither on its
partition nor on its neighbours. Inclusion is the chance 1 - exp(-exp(logp - kappa)) that the segmentation is
among the k, kappa being the (k + 1)-th perturbed value (1 if there is none).

Defined results: null or empty text: one segmentation without pieces, logp 0, inclusion 1; texts with fewer than
k segmentations give all of them; a literal U+2581 goes through byte pieces, so that decode() returns every
text as it was; repeated rows have equal samples; a null key is a key; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.llm.common import read_table

MARK = "▁"
#: Stands for a literal mark inside the lattice: a lone surrogate, which no text holds and no model has a piece for.
LITERAL = "\ud800"
UNIT = re.compile(f"\n|{LITERAL}|{MARK}*[^{MARK}\n{LITERAL}]+|{MARK}+")
SLICE = 4_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def streams(seed: np.ndarray, sample: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A stream of random bits for each (seed, sample, word)."""
    return mix(seed ^ (word.astype(np.uint64) * _A + (sample.astype(np.uint64) + np.uint64(1)) * _B))


def draw(stream: np.ndarray, step: int) -> np.ndarray:
    """The stream's 64 bits at a step."""
    return mix(stream + np.uint64((step + 1) * int(_A) % (1 << 64)))


def noise(seed: np.ndarray, sample: int, word: np.ndarray, step: int) -> np.ndarray:
    """64 random bits for each (seed, sample, word, step)."""
    return draw(streams(seed, np.full(1, sample), word), step)


def uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel_below(place: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at `place`, truncated at `bound`."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(place), -np.inf, place - np.log(np.exp(np.minimum(place - bound, 700)) - np.log(u)))


@dataclass
class Vocabulary:
    pieces: list[str]
    weights: np.ndarray  # log probability by id
    keys: np.ndarray  # sorted hashes of all beginnings of pieces
    ids: np.ndarray  # id of the piece with that hash, or -1
    longest: int
    first_byte: int

    def __post_init__(self):
        top = (self.keys >> np.uint64(46)).astype(np.int64)
        self.bucket = np.searchsorted(top, np.arange((1 << 18) + 1))  # keys are sorted: where each bucket of them begins

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1."""
        top = (h >> np.uint64(46)).astype(np.int64)
        at, end = self.bucket[top], self.bucket[top + 1]
        out = np.full(len(h), -1)
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            same = self.keys[at] == h[todo]
            out[todo[same]] = at[same]
            more = ~same & (at + 1 < end)
            todo, at, end = todo[more], at[more] + 1, end[more]
        return out

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def load(name: str, alpha: float) -> Vocabulary:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        bytes_ = [i for i in range(n) if model.is_byte(i)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = np.full(n, len(plain), dtype=np.float64)
        rank[plain] = np.arange(len(plain))
        p = 1 / (rank + 10)
        weights = alpha * np.log(p / p[plain].sum())
        known: dict[int, int] = {}
        for i in plain:
            h = np.zeros(1, dtype=np.uint64)
            for j, c in enumerate(pieces[i]):
                h = extend(h, np.array([ord(c)], dtype=np.uint64))
                known.setdefault(int(h[0]), -1)
                if j + 1 == len(pieces[i]):
                    known[int(h[0])] = i
        keys = np.array(sorted(known), dtype=np.uint64)
        return Vocabulary(pieces, weights, keys, np.array([known[int(k)] for k in keys]), max(len(pieces[i]) for i in plain), bytes_[0])


def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h + c + np.uint64(1)) * _A
    return (h ^ (h >> np.uint64(29))) * _B


class Lattice:
    """The lattices of distinct words, node by node; a word's nodes are its characters and its end."""

    def __init__(self, units: list[str], vocab: Vocabulary):
        self.vocab = vocab
        sizes = np.array([len(u) for u in units])
        text = "\0".join(units) + "\0"  # the end nodes' characters are never read
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        n = len(cp)
        end = np.repeat(self.first + sizes, sizes + 1)
        todo, size, h = np.flatnonzero(np.arange(n) < end), 1, None
        found, single = [], np.zeros(n, dtype=bool)
        while len(todo) and size <= vocab.longest:
            h = extend(np.zeros(len(todo), dtype=np.uint64) if h is None else h, cp[todo + size - 1])
            at = vocab.find(h)
            known = at >= 0
            ids = np.where(known, vocab.ids[at], -1)
            real = ids >= 0
            found.append((todo[real], size, ids[real]))
            if size == 1:
                single[todo[real]] = True
            more = known & (todo + size < end[todo])
            todo, h = todo[more], h[more]
            size += 1
        lone = np.flatnonzero(~single & (np.arange(n) < end))
        code = cp[lone].astype(np.int64)
        # the character's bytes, as one step; a single byte is a piece of its own
        found.append((lone, 1, np.where(code < 0x80, vocab.first_byte + code, len(vocab.pieces) + code)))
        counts = np.bincount(np.concatenate([f[0] for f in found]), minlength=n)
        self.begin = np.concatenate(([0], np.cumsum(counts)))
        total = int(self.begin[-1])
        self.label, self.to = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int32)
        self.source = np.repeat(np.arange(n, dtype=np.int32), counts)
        fill = self.begin[:-1].copy()
        for where, size, ids in reversed(found):  # long pieces first
            self.label[fill[where]], self.to[fill[where]] = ids, where + size
            fill[where] += 1
        byte = vocab.weights[vocab.first_byte]
        width = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
        weight = vocab.weights.take(self.label, mode="clip")
        odd = np.flatnonzero(self.label >= len(vocab.pieces))
        weight[odd] = (width * byte)[np.searchsorted(lone, self.source[odd])]
        # backward pass, by distance from the word's end
        left = end - np.arange(n)
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(left.max(initial=0) + 2))
        self.mass = np.zeros(n)
        for d in range(1, len(bounds) - 1):
            nodes = order[bounds[d] : bounds[d + 1]]
            edges, owner, starts = self.edges_of(nodes)
            value = weight[edges] + self.mass[self.to[edges]]
            top = np.maximum.reduceat(value, starts)
            self.mass[nodes] = top + np.log(np.add.reduceat(np.exp(value - top[owner]), starts))
        self.logp = weight + self.mass[self.to] - self.mass[self.source]
        # cumulative shares, in 32 bits
        p, share = np.exp(self.logp), np.zeros(total)
        nodes = np.flatnonzero(counts)
        so_far, r = np.zeros(len(nodes)), 0
        while len(nodes):
            e = self.begin[nodes] + r
            so_far = so_far + p[e]
            share[e] = so_far
            r += 1
            more = counts[nodes] > r
            nodes, so_far = nodes[more], so_far[more]
        self.share = np.minimum(np.floor(share * 2.0**32), 2.0**32 - 1).astype(np.uint32)
        self.share[self.begin[1:][counts > 0] - 1] = 2**32 - 1

    def edges_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, index of each one's node, first edge's index of each node) of nodes that have edges."""
        counts = self.begin[nodes + 1] - self.begin[nodes]
        owner = np.repeat(np.arange(len(nodes)), counts)
        starts = np.cumsum(counts) - counts
        return np.arange(len(owner)) - starts[owner] + self.begin[nodes][owner], owner, starts

    def descend(self, nodes: np.ndarray, seeds: np.ndarray, sample: np.ndarray, words: np.ndarray, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index, edge) of the steps from each node to its word's end, in order of index and step."""
        active = np.flatnonzero(self.begin[nodes + 1] > self.begin[nodes])
        at, who, edges = nodes[active], [], []
        stream = streams(seeds, sample, words)[active]
        while len(active):
            u = (draw(stream, step) >> np.uint64(32)).astype(np.uint32)
            e = self.begin[at]
            behind = np.flatnonzero(u > self.share[e])
            while len(behind):
                e[behind] += 1
                behind = behind[u[behind] > self.share[e[behind]]]
            who.append(active)
            edges.append(e)
            at = self.to[e]
            more = np.flatnonzero(self.begin[at + 1] > self.begin[at])
            active, at, stream = active[more], at[more], stream[more]
            step += 1
        if not who:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        counts = np.zeros(len(nodes), dtype=np.int64)
        for w in who:
            counts[w] += 1
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int64)
        for i, (w, e) in enumerate(zip(who, edges, strict=True)):
            out[starts[w] + i] = e
        return np.repeat(np.arange(len(nodes)), counts), out

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a sequence of edges."""
        label = self.label[edges]
        odd = np.flatnonzero(label >= len(self.vocab.pieces))
        if not len(odd):
            return label.astype("<u2")
        parts, last = [], 0
        for i in odd.tolist():
            char = chr(label[i] - len(self.vocab.pieces))
            parts += [label[last:i], np.frombuffer((MARK if char == LITERAL else char).encode(), dtype=np.uint8).astype(np.int64) + self.vocab.first_byte]
            last = i + 1
        return np.concatenate([*parts, label[last:]]).astype("<u2")


@dataclass
class Sample:
    """One segmentation of one text: edges in order, the word of each, and where words begin among them."""

    edges: np.ndarray
    words: np.ndarray
    logp: float
    value: float


def samples(texts: list[str], seeds: np.ndarray, k: int, vocab: Vocabulary) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """For each text its samples as (ids, logp, perturbed value), best first, and kappa."""
    index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    words = [np.fromiter(map(index.__getitem__, split_words(t)), dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
    if not index:
        return [([(np.zeros(0, dtype="<u2"), 0.0, 0.0)], -np.inf) for _ in texts]
    lattice = Lattice(list(index), vocab)
    counts = np.array([len(w) for w in words])
    offset = np.concatenate(([0], np.cumsum(counts)))
    text_of = np.repeat(np.arange(len(texts)), counts)
    word_of = np.arange(len(text_of)) - offset[text_of]
    units = np.concatenate(words)
    with np.errstate(over="ignore"):
        root = -np.log(-np.log(uniform(noise(seeds, 0, np.zeros(len(texts), dtype=np.int64), 4095))))

    # the first samples, all texts at once
    who, edges = lattice.descend(lattice.first[units], seeds[text_of], np.zeros(1, dtype=np.int64), word_of)
    step_logp = lattice.logp[edges]
    unit_logp = np.bincount(who, weights=step_logp, minlength=len(units))
    running = np.cumsum(unit_logp)
    before = running - unit_logp - np.repeat((running - unit_logp)[np.minimum(offset[:-1], len(units) - 1)], counts)
    with np.errstate(divide="ignore"):
        differs = before + np.log(-np.expm1(np.minimum(unit_logp, 0.0)))
    u = uniform(noise(seeds[text_of], 0, word_of, 4094))
    keys = gumbel_below(differs, root[text_of], u)
    edge_at = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(units)))))

    states: list[Search | None] = []
    for i in range(len(texts)):
        lo, hi = offset[i], offset[i + 1]
        if lo == hi:
            states.append(None)
            continue
        mine = edges[edge_at[lo] : edge_at[hi]]
        first = Sample(mine, np.repeat(np.arange(hi - lo), edge_at[lo + 1 : hi + 1] - edge_at[lo:hi]), float(unit_logp[lo:hi].sum()), float(root[i]))
        state = Search(i, lo, hi, [first])
        for w in _largest(keys[lo:hi], k):
            state.push(float(keys[lo + w]), "word", first, w, 0, 0)
        states.append(state)
    for new in range(1, k):
        jobs = [s.next(lattice, seeds, k) for s in states if s is not None and s.heap]
        if not jobs:
            break
        # all texts' next samples go down together
        sizes = np.array([s.hi - s.lo - w for s, _, w, *_ in jobs])
        first_of = np.cumsum(sizes) - sizes
        job_of = np.repeat(np.arange(len(jobs)), sizes)
        word = np.arange(len(job_of)) - first_of[job_of] + np.array([w for _, _, w, *_ in jobs])[job_of]
        ends = lattice.first[units[np.array([s.lo for s, *_ in jobs])[job_of] + word]]
        ends[first_of] = lattice.to[np.array([edge for *_, edge, _, _ in jobs])]
        salts, values = (np.array([j[n] for j in jobs])[job_of] for n in (-1, -2))
        seed = seeds[np.array([s.text for s, *_ in jobs])[job_of]]
        at, more = lattice.descend(ends, seed, salts + 1, word, step=1)
        part = np.bincount(at, weights=lattice.logp[more], minlength=len(ends))
        run = np.cumsum(part) - part
        heads = np.array([float(lattice.logp[s.edges[:cut]].sum()) + lattice.logp[edge] for _, s, _, cut, _, edge, _, _ in jobs])
        with np.errstate(divide="ignore"):
            place = heads[job_of] + run - run[first_of][job_of] + np.log(-np.expm1(np.minimum(part, 0.0)))
        fresh = gumbel_below(place, values, uniform(draw(streams(seed, salts, word), 4091)))
        bounds = np.searchsorted(at, np.append(first_of, len(ends)))
        for n, (state, s, w, cut, step, edge, value, _) in enumerate(jobs):
            mine = slice(bounds[n], bounds[n + 1])
            path = np.concatenate((s.edges[:cut], [edge], more[mine]))
            t = Sample(path, np.concatenate((s.words[:cut], [w], at[mine] - first_of[n] + w)), float(lattice.logp[path].sum()), value)
            mine = fresh[first_of[n] : first_of[n] + sizes[n]]
            for j in _largest(mine, k - new):
                state.push(float(mine[j]), "word", t, w + j, 0 if j else step + 1, 0)
            state.found.append(t)
    empty = ([(np.zeros(0, dtype="<u2"), 0.0, 0.0)], -np.inf)
    return [empty if s is None else ([(lattice.ids(t.edges), t.logp, t.value) for t in s.found], -s.heap[0][0] if s.heap else -np.inf) for s in states]


def _largest(keys: np.ndarray, k: int) -> list[int]:
    """Places of the k + 1 largest finite keys."""
    at = np.argpartition(-keys, k)[: k + 1] if len(keys) > k + 1 else np.arange(len(keys))
    return [int(i) for i in at if np.isfinite(keys[i])]


@dataclass
class Search:
    """The frontier of one text: (-value, turn, kind, sample, word, step, edge); a word differs from that step on."""

    text: int
    lo: int
    hi: int
    found: list[Sample]
    heap: list[tuple] = field(default_factory=list)
    turn: int = 0

    def push(self, value: float, *what) -> None:
        heapq.heappush(self.heap, (-value, self.turn, *what))
        self.turn += 1

    def next(self, lattice: Lattice, seeds: np.ndarray, k: int) -> tuple:
        """(self, sample left, word, edges kept, step, edge taken there, value, salt) of the next sample."""
        value, _, kind, s, w, step, edge = heapq.heappop(self.heap)
        value = -value
        start, stop = np.searchsorted(s.words, [w, w + 1])
        salt = len(self.found) * 64 + self.turn
        if kind == "word":
            # tell the children apart: one keeps the value, the others draw below it
            mine = s.edges[start + step : stop]
            others, owner, _ = lattice.edges_of(lattice.source[mine])
            keep = others != mine[owner]
            others, owner = others[keep], owner[keep]
            before = float(lattice.logp[s.edges[: start + step]].sum())
            logs = lattice.logp[mine]
            place = before + (np.cumsum(logs) - logs)[owner] + lattice.logp[others]
            seed, each = np.full(len(others), seeds[self.text]), np.arange(len(others))
            pick = int(np.argmax(place - np.log(-np.log(uniform(noise(seed, salt, each, 4093))))))
            below = gumbel_below(place, np.full(len(others), value), uniform(noise(seed, salt, each, 4092)))
            below[pick] = -np.inf
            for j in _largest(below, k):
                self.push(float(below[j]), "edge", s, w, step + int(owner[j]), int(others[j]))
            step, edge = step + int(owner[pick]), int(others[pick])
        return self, s, w, int(start) + step, step, edge, value, salt


def split_words(text: str) -> list[str]:
    """Words with marks for spaces; a literal mark stands alone."""
    if MARK in text:
        text = text.replace(MARK, LITERAL)
    return UNIT.findall(MARK + text.replace(" ", MARK))


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of a sequence of piece ids."""
    out, held = [], bytearray()
    for i in ids.tolist():
        if vocab.first_byte <= i < vocab.first_byte + 256:
            held.append(i - vocab.first_byte)
            continue
        if held:
            out.append(held.decode())
            held = bytearray()
        out.append(vocab.pieces[i].replace(MARK, " "))
    if held:
        out.append(held.decode())
    text = "".join(out)
    return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def spelled(name: str) -> list[bytes]:
    """The bytes that each piece stands for, by id."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


def text_of(ids: np.ndarray, spelling: list[bytes]) -> str:
    """The text of a sequence of piece ids; bytes that are no UTF-8 become U+FFFD."""
    text = b"".join(map(spelling.__getitem__, ids.tolist())).decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


SCHEMA = "rank int, ids binary, n_pieces int, logp double, inclusion double"


def encode(docs: DataFrame, key: str, text: str, k: int = 2, model: str = "piece_bpe_32k.model", alpha: float = 1.0, seed: int = 1, decode: bool = False) -> DataFrame:
    """id, rank (from 1), ids (little-endian unsigned 16-bit), n_pieces, logp and inclusion: up to k rows per row of docs.

    With `decode` also decoded, as decode_table() gives it, made from the ids in the same pass.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.to_json(F.struct(F.col(key).alias("k")))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.load(model, alpha)
        for batch in batches:
            start, held = 0, 0
            for i in range(batch.num_rows):
                held += len(batch.column(1)[i].as_buffer() or b"") if batch.column(1)[i].is_valid else 0
                if held < SLICE and i + 1 < batch.num_rows and i - start < 4000:
                    continue
                part = batch.slice(start, i + 1 - start)
                texts = [t or "" for t in part.column(1).to_pylist()]
                owners, cols = [], []
                for j, (found, kappa) in enumerate(samples(texts, part.column(2).to_numpy().view(np.uint64), k, vocab)):
                    for r, (ids, logp, _) in enumerate(found):
                        owners.append(j)
                        q = 1.0 if np.isneginf(kappa) else float(-np.expm1(-np.exp(min(logp - kappa, 700.0))))
                        cols.append((r + 1, ids.tobytes(), len(ids), logp, q))
                a = list(zip(*cols, strict=True))
                kinds = (pa.int32(), pa.binary(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners)), *(pa.array(x, t) for x, t in zip(a, kinds, strict=True))], names=["id", "rank", "ids", "n_pieces", "logp", "inclusion"])
                start, held = i + 1, 0

    shape = StructType([*rows.select("id").schema.fields, *StructType.fromDDL(SCHEMA).fields])
    if not decode:
        return rows.mapInArrow(run, shape)
    return rows.mapInArrow(lambda batches: decoded(run(batches), 2, model), StructType([*shape.fields, *StructType.fromDDL("decoded string").fields]))


def decoded(batches: Iterator[pa.RecordBatch], at: int, model: str) -> Iterator[pa.RecordBatch]:
    """The batches with the texts of the ids in column `at` as one more column."""
    spelling = spelled(model)
    for batch in batches:
        start, held, texts = 0, 0, []
        for i, value in enumerate(batch.column(at)):
            raw = value.as_buffer()
            texts.append(None if raw is None else text_of(np.frombuffer(raw, dtype="<u2"), spelling))
            held += len(texts[-1] or "")
            if held < SLICE and i + 1 < batch.num_rows:
                continue
            part = batch.slice(start, i + 1 - start)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
            start, held, texts = i + 1, 0, []


def decode_table(rows: DataFrame, ids: str, name: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """The columns of rows and, as `name`, the text of each row's ids (as encode() gives them); null ids, null text."""
    columns = rows.columns
    at = columns.index(ids)
    inner = rows.toDF(*[f"c{i}" for i in range(len(columns))])
    shape = StructType([*inner.schema.fields, *StructType.fromDDL("decoded string").fields])
    return inner.mapInArrow(lambda batches: decoded(batches, at, model), shape).toDF(*columns, name)


def op3_pieces(spark, sf_dir: str) -> DataFrame:
    """Two segmentations of each document, each decoded again."""
    found = encode(read_table(spark, sf_dir, "documents"), "doc_id", "text", decode=True)
    return found.select(F.col("id").alias("doc_id"), "rank", "n_pieces", F.crc32("ids").alias("ids_crc32"), "logp", "inclusion", F.sha2("decoded", 256).alias("decoded_sha256"))
