"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's signature is `chunks` x `width` MinHash symbols of 16 bits. By the pigeonhole principle two
signatures that differ in at most THRESHOLD = 2 * chunks - 1 symbols differ in at most one symbol of some chunk.
So each chunk is entered under a key for each symbol it may have wrong (the others as they are), and every pair
within the threshold meets under some key. Two sets of Jaccard similarity 0.8 are further apart than that with
a chance of about 3 in a million (24 or more of 48 symbols, each with a chance of 0.2). Candidates within the threshold are confirmed on their full shingle sets.

Nothing pairs up the members of a group. Documents of equal sets are one node. A key's bucket of two gives its
pair. Larger buckets, dealt out in blocks of bounded size, first give a least spanning forest by signature
distance: as many pairs as members. These are confirmed and joined into components. Only where members of a
bucket still lie in different components are their full sets brought together, block by block, and the other
pairs within the threshold compared there; what leaves a block are the links that join components. Of the
buckets two members share only the first compares them; of a bucket beyond a block, its largest component's
members stay in their own blocks and the others visit all. So every pair within the threshold is either compared
on full sets or already connected: no link between components is lost.

Components come from label propagation with pointer jumping over tables in the shared folder; neither links
nor labels reach the driver.

Defined results: null, empty or blank text: an empty set, linked with nothing; fewer words than the width: the
whole sequence is the only shingle; rows of equal sets are linked whatever their ids; repeated ids are
separate documents with the same number; a null id is never the smallest unless all of a component are null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialize, read_table, text_or_empty

BLOCK = 1024
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    space = np.concatenate(([True], _SPACE[raw], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted set of the text's shingles, as 64-bit hashes."""
    w = words(text)
    n = min(width, len(w))
    if not n:
        return w
    x = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        x = mixed(x + w[i : len(w) - n + 1 + i] * _PLACES[i])
    return np.unique(x)


@dataclass(frozen=True)
class Index:
    """Shape of the signatures: `chunks` chunks of `width` symbols of 16 bits."""

    chunks: int = 12
    width: int = 4

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def threshold(self) -> int:
        """Signatures that differ in at most so many symbols meet: else every chunk had two errors or more."""
        return 2 * self.chunks - 1

    def signature(self, members: np.ndarray) -> np.ndarray:
        if len(members) > 20_000:
            least = np.full(self.symbols, np.iinfo(np.uint64).max, dtype=np.uint64)
            for lo in range(0, len(members), 20_000):
                least = np.minimum(least, np.multiply.outer(_SEEDS[: self.symbols], members[lo : lo + 20_000]).min(axis=1))
        else:
            least = np.multiply.outer(_SEEDS[: self.symbols], members).min(axis=1)
        return (mixed(least) >> np.uint64(48)).astype("<u2")

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """For each signature a key for each chunk and each symbol of it that may be wrong."""
        s = signatures.reshape(len(signatures), self.chunks, self.width).astype(np.uint64)
        out = np.empty((len(s), self.chunks, self.width), dtype=np.uint64)
        chunk = np.arange(self.chunks, dtype=np.uint64)[None, :]
        for free in range(self.width):
            x = chunk * np.uint64(self.width) + np.uint64(free + 1)
            x = np.broadcast_to(x, s.shape[:2])
            for i in range(self.width):
                if i != free:
                    x = mixed(x + s[:, :, i] * _PLACES[i])
            out[:, :, free] = x
        return out.reshape(len(s), -1).view(np.int64)


_SEEDS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sign(docs: DataFrame, key: str, text: str, width: int, index: Index) -> DataFrame:
    """id, t, n, node, sig of each row: the hash of its text, the size, digest and signature of its set (null if empty)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(F.col(text)).alias("text")).select("id", F.xxhash64("text").alias("t"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sig = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(index.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["id", "t", "n", "node", "sig"])

    return rows.mapInArrow(run, "id long, t long, n long, node binary, sig binary")


def matrix(column, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, symbols)


# ---- candidates


def index_keys(nodes: DataFrame, index: Index) -> DataFrame:
    """nid, key: a node's entries in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys = index.keys(matrix(part.column(1).to_pylist(), index.symbols))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], names=["nid", "key"])

    return nodes.select("nid", "sig").mapInArrow(run, "nid long, key long")


def forest(nids: np.ndarray, sigs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A least spanning forest of the members by signature distance, over distances up to most (Prim's steps)."""
    n = len(nids)
    near, link = np.full(n, 1 << 20), np.zeros(n, dtype=int)
    out, done, now = [], np.zeros(n, dtype=bool), 0
    for _ in range(n - 1):
        done[now] = True
        d = (sigs != sigs[now]).sum(axis=1)
        closer = d < near
        near[closer], link[closer] = d[closer], now
        left = np.where(done, 1 << 21, near)
        now = int(left.argmin())
        if near[now] <= most:
            out.append((int(nids[link[now]]), int(nids[now])))
    return out


def open_pairs(sigs: np.ndarray, keys: np.ndarray, key: int, sizes: np.ndarray, comps: np.ndarray, home: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): pairs of a bucket's members that may still link two components. Of all the buckets that two members
    share only the first takes the pair, and of the blocks only one: that where one of them is at home, the
    smaller of two visitors'. comps may change between steps."""
    place = int(np.flatnonzero(keys[0] == key)[0])
    for i in range(len(sigs) - 1):
        js = np.flatnonzero((comps[i + 1 :] != comps[i]) & (home[i + 1 :] | home[i])) + i + 1
        js = js[np.minimum(sizes[js], sizes[i]) * 100 >= np.maximum(sizes[js], sizes[i]) * 80]
        if place and len(js):
            js = js[~(keys[js, :place] == keys[i, :place]).any(axis=1)]
        if len(js):
            js = js[(sigs[js] != sigs[i]).sum(axis=1) <= most]
        if len(js):
            yield i, js


def connect(members: list[np.ndarray], comps: np.ndarray, pairs: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """The links among the pairs that join components, on full sets; comps is brought up to date on the way."""
    counts = np.array([len(m) for m in members])
    where = np.concatenate(([0], np.cumsum(counts)))
    flat = np.unique(np.concatenate(members), return_inverse=True)[1]
    mark = np.zeros(flat.max() + 1, dtype=bool)
    out = []
    for i, js in pairs:
        mine = flat[where[i] : where[i + 1]]
        mark[mine] = True
        owner = np.repeat(np.arange(len(js)), counts[js])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts[js]) - counts[js], counts[js]) + where[js][owner]
        shared = np.bincount(owner, weights=mark[flat[at]], minlength=len(js)).astype(np.int64)
        mark[mine] = False
        for j in js[100 * shared >= 80 * (counts[i] + counts[js] - shared)].tolist():
            if comps[j] != comps[i]:
                out.append((i, j))
                comps[comps == comps[j]] = comps[i]
    return out


def _grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal values in by, from sorted batches."""
    held: pd.DataFrame | None = None
    for batch in batches:
        held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
        if not len(held):
            continue
        change = (held[by].to_numpy()[1:] != held[by].to_numpy()[:-1]).any(axis=1)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield held.iloc[a:b]
        held = held.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held


def _pairs(found: list[tuple[int, int]]) -> pd.DataFrame:
    a = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": a.min(axis=1), "b": a.max(axis=1)})


def near_pairs(pairs: DataFrame, nodes: DataFrame, index: Index) -> DataFrame:
    """The pairs whose signatures are within the threshold and whose sizes allow a link."""
    side = lambda c: nodes.select(F.col("nid").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * 80)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                keep = (matrix(x.sa, index.symbols) != matrix(x.sb, index.symbols)).sum(axis=1) <= index.threshold
                yield x.loc[keep, ["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


# ---- confirmation and components


def sets_of(nids: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """nid, node, members: the full sets of some nodes, made again from one text of each."""
    no_id = -(1 << 63)
    at = nodes.join(nids, "nid").select("nid", F.coalesce("id", F.lit(no_id)).alias("id"), "t").distinct()
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(no_id)).alias("id"), text_or_empty(F.col(text)).alias("text")).withColumn("t", F.xxhash64("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 500):
                made = [shingles(t.as_py(), width).tobytes() for t in texts.slice(lo, 500)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in made], pa.binary()), pa.array(made, pa.binary())], names=["nid", "node", "members"])

    made = rows.join(at, ["id", "t"]).select("nid", "text").mapInArrow(make, "nid long, node binary, members binary")
    return made.groupBy("nid", "node").agg(F.first("members").alias("members"))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """u, v: the nodes of the pairs with 100 * intersection >= 80 * union, on full sets."""
    wanted = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    full = sets_of(wanted, nodes, docs, key, text, width)
    side = lambda c, x: full.select(F.col("nid").alias(c), F.col("node").alias(x), F.col("members").alias(f"m{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= 80 * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    met = pairs.join(side("a", "u"), "a").join(side("b", "v"), "b").select("u", "v", "ma", "mb")
    return met.mapInArrow(check, "u binary, v binary")


def components(links: DataFrame) -> DataFrame:
    """node, comp: for each node of a link the least node it reaches."""
    both = materialize(links.select("u", "v").union(links.select("v", "u")).filter("u <> v").distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("seen"))
        told = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = materialize(told.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        if new.filter("comp <> old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def cluster(docs: DataFrame, key: str, text: str, width: int = 5, index: Index = Index(), block: int = BLOCK) -> DataFrame:
    """id, t (hash of the text), n_shingles, component_id (smallest id of the component) and comp (its label; null
    for an empty set) of each row of docs."""
    signed = materialize(sign(docs, key, text, width, index), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("t")))
    nodes = signed.filter("n > 0").groupBy("node").agg(first.alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.select(F.xxhash64("node").alias("nid"), "node", "n", "sig", F.col("rep.id").alias("id"), F.col("rep.t").alias("t")), "nodes")

    entries = index_keys(nodes, index)
    buckets = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("nid").alias("a"), F.max("nid").alias("b")).filter("size > 1"), "buckets")
    large = buckets.filter("size > 2").select("key", "size")
    members = entries.join(large, "key").join(nodes.select("nid", "sig"), "nid")
    members = materialize(members, "members")

    # first the pairs of small buckets, and a spanning forest of each block of the larger ones
    few = near_pairs(buckets.filter("size = 2 AND a <> b").select("a", "b").distinct(), nodes, index)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, ["key", "part"]):
            if len(group) > 1:
                yield _pairs(forest(group.nid.to_numpy(), matrix(group.sig, index.symbols), index.threshold))

    part = F.when(F.col("size") <= block, 0).otherwise(F.pmod(F.xxhash64("nid", "key"), F.ceil(F.col("size") / block).cast("long"))).cast("int")
    dealt = members.select("key", part.alias("part"), "nid", "sig")
    trees = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "nid").mapInPandas(grow, "a long, b long")
    tried = materialize(few.union(trees).filter("a <> b").distinct(), "tried")
    links = materialize(confirmed(tried, nodes, docs, key, text, width), "confirmed")
    comp = components(links)

    # then what components still leave open: members of a bucket that may link two of them
    known = nodes.join(comp, "node", "left").select("nid", "n", F.xxhash64(F.coalesce("comp", "node")).alias("comp"))
    placed = dealt.join(known, "nid").join(large, "key")
    unsettled = placed.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("key")
    counts = placed.filter(F.col("size") > block).groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    asked = placed.join(unsettled, "key").join(main, "key", "left")
    blocks = F.ceil(F.col("size") / block).cast("int")
    stays = (F.col("size") <= block) | F.col("comp").eqNullSafe(F.col("main"))
    visits = F.when(stays, F.array("part")).otherwise(F.sequence(F.lit(0), blocks - 1))
    seen = asked.select("key", "nid", "sig", "n", "comp", F.col("part").alias("home"), F.explode(visits).alias("part"))

    def pairs_of(group: pd.DataFrame) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
        sigs = matrix(group.sig, index.symbols)
        comps = group.comp.to_numpy().copy()
        return comps, open_pairs(sigs, index.keys(sigs), group.key.iloc[0], group.n.to_numpy(), comps, (group.home == group.part).to_numpy(), index.threshold)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, ["key", "part"]):
            if group.comp.nunique() > 1:
                needed = np.zeros(len(group), dtype=bool)
                for i, js in pairs_of(group)[1]:
                    needed[i] = needed[js] = True
                if needed.any():
                    yield group[needed]

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, ["key", "part"]):
            comps, pairs = pairs_of(group)
            sets = [np.frombuffer(m, dtype=np.uint64) for m in group.members]
            found = connect(sets, comps, pairs)
            if found:
                names = group.node.to_numpy()
                yield pd.DataFrame({"u": [names[i] for i, _ in found], "v": [names[j] for _, j in found]})

    columns = "key long, nid long, sig binary, n long, comp long, home int, part int"
    order = ["key", "part", "nid"]
    active = seen.repartition("key", "part").sortWithinPartitions(*order).mapInPandas(meet, columns)
    active = materialize(active, "active")
    if not active.isEmpty():
        full = sets_of(active.select("nid").distinct(), nodes, docs, key, text, width)
        loaded = active.join(full, "nid").repartition("key", "part").sortWithinPartitions(*order)
        more = loaded.mapInPandas(settle, "u binary, v binary")
        comp = components(materialize(links.union(more), "confirmed"))

    joined = nodes.select("node", "id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = joined.select("node", "comp").join(joined.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("node", "comp", "component_id")
    return signed.join(named, "node", "left").select("id", "t", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "comp")


def keep_one(docs: DataFrame, key: str, text: str, width: int = 5) -> DataFrame:
    """The rows of docs that stay, all columns as they were: of each component the row of smallest id (of several
    with that id, the one whose text hashes lowest; of rows equal in both, one)."""
    found = cluster(docs, key, text, width)
    name = lambda c: F.to_json(F.struct(c.alias("id")))  # noqa: E731  # never null, so that one partitioning serves join and aggregate
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), name(F.col(key).cast("long")).alias("name"), F.xxhash64(text_or_empty(F.col(text))).alias("t"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("t"))).alias("best")
    stays = found.filter(F.col("comp").isNotNull()).groupBy("comp").agg(best).select("best.id", "best.t").union(found.filter(F.col("comp").isNull()).select("id", "t").distinct())
    kept = marked.join(stays.select(name(F.col("id")).alias("name"), "t"), ["name", "t"], "left_semi")
    return kept.groupBy("name", "t").agg(F.first("row").alias("row")).select("row.*")


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles, as its contract has it."""
    found = cluster(read_table(spark, sf_dir, "documents"), "doc_id", "text", width=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
