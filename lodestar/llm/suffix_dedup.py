"""Removal of repeated byte strings with a hash-compared suffix sort.

A byte goes if a string of `length` bytes that covers it starts at another place too, in any document.

Sampling of suffixes. The anchor of a string of `length` bytes is the place in it of the least hash of GRAM
bytes (the leftmost of equals). It depends on the string's bytes alone, so equal strings have equal anchors at
equal distance. Neighbouring strings mostly share their anchor; the stretch of bytes they cover is a fragment,
and a document is a sequence of fragments. Only fragments whose anchor's hash stands elsewhere too can hold
a repeated string: counting hashes drops the rest.

Classes. Equal fragments (by a 128-bit digest of their bytes) form a class; a class that occurs twice is
repeated throughout, whatever the number of its copies, and needs no look at its bytes.

Suffix sort. Where several classes share an anchor, one fragment of each is fetched. Their suffixes from the
anchor on are sorted by merging: two suffixes are compared by the polynomial hashes of their prefixes, with
binary search for the common extension. Neighbours in that order bound how far a suffix is shared; strings
within the bound are held against each other by hash, and every equality found is verified on the bytes.

Groups of more than MOST classes are not gathered. Their fragments are cut into pieces of at most PIECE string
starts, dealt anew by the bytes that all strings of a piece share (PIECE - 1 less than `length`), which sets
apart documents that share a shorter passage; a group that is still larger has its strings counted by digest,
spread over all tasks. Every other step spreads by anchor, class or document, with partial aggregation before the
shuffle, so copies and common passages leave each task once.

Defined results: a null text is empty; texts are UTF-8 bytes and matches never cross documents; documents shorter
than `length` keep everything; repeated rows are documents of their own and repeat each other; a null id is an id;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialize, read_table, text_or_empty
from lodestar.llm.minhash import mixed, powers

GRAM = 128
CHUNK = 1 << 20
MOST = 1024
PIECE = 16
BATCH = 2 << 20
HOT = 10_000
NO_ID = -(1 << 63)
_TABLE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """sums[i]: the polynomial hash of the first i bytes, modulo 2 ** 64."""
    up, _ = powers(len(raw) + 1)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_TABLE[raw] * up[: len(raw)], dtype=np.uint64)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbouring values, with two running minima over blocks of w."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def fragments(data: bytes, length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(anchor's hash, first byte, end, anchor) of each run of strings with one anchor."""
    out, place = [], np.uint64(CHUNK - 1)
    for base in range(0, max(0, len(data) - length + 1), CHUNK - length):
        part = np.frombuffer(data, dtype=np.uint8)[base : base + CHUNK - 1]
        if len(part) < length:
            break
        sums = prefix_hashes(part)
        _, down = powers(len(part) + 1)
        n = len(part) - gram + 1
        grams = mixed((sums[gram:] - sums[:n]) * down[:n])
        # the hash's first bits, then the place: the leftmost of equals is least
        packed = (grams & ~place) | np.arange(n, dtype=np.uint64)
        anchors = (sliding_min(packed, length - gram + 1) & place).astype(np.int64)
        last = min(len(anchors), CHUNK - length)  # the next part begins there
        anchors = anchors[:last]
        cuts = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [last]))
        at = anchors[cuts[:-1]]
        hashes = grams[at].view(np.int64)
        out += zip(hashes.tolist(), (cuts[:-1] + base).tolist(), (cuts[1:] - 1 + length + base).tolist(), (at + base).tolist(), strict=True)
    return out


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


# ---- the suffix sort


class Suffixes:
    """Suffixes of a buffer, each with an end, compared by prefix hashes."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.raw = np.concatenate((raw, np.zeros(1, dtype=np.uint8)))
        self.sums = prefix_hashes(raw)
        self.down = powers(len(raw) + 1)[1]
        self.starts, self.ends = starts, ends

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search over its length."""
        i, j = self.starts[a], self.starts[b]
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.ends[a] - i, self.ends[b] - j)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes(i, mid) == self.hashes(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """a before b, by the byte after the common extension; a suffix that ends there comes first."""
        n = self.common(a, b)
        i, j = self.starts[a] + n, self.starts[b] + n
        x = np.where(i < self.ends[a], self.raw[np.minimum(i, len(self.raw) - 1)].astype(np.int16), -1)
        y = np.where(j < self.ends[b], self.raw[np.minimum(j, len(self.raw) - 1)].astype(np.int16), -1)
        return (x < y) | (or_equal & (x == y))

    def sort(self, groups: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (groups ascending), by merges of doubling runs, all at once."""
        n = len(groups)
        order = np.arange(n)
        first = np.concatenate(([True], groups[1:] != groups[:-1])) if n else np.zeros(0, dtype=bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        size = np.bincount(groups, minlength=1)[groups] if n else begin
        run = 1
        while n and run < size.max():
            rel = np.arange(n) - begin
            mine = rel // run
            left = mine % 2 == 0
            sib_lo = begin + np.where(left, mine + 1, mine - 1) * run
            sib_hi = np.minimum(sib_lo + run, begin + size)
            has = sib_lo < begin + size
            # the number of the sibling run's members that come before this one
            low, high = sib_lo.copy(), np.where(has, sib_hi, sib_lo)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                before = self.less(order[mid], order[open_], ~left[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            rank = np.where(has, low - sib_lo, 0)
            pair = begin + (mine // 2) * 2 * run
            target = pair + (rel - mine * run) + rank
            new = np.empty_like(order)
            new[target] = order
            order = new
            run *= 2
        return order


def verified(raw: bytes, i: int, j: int, n: int) -> bool:
    return raw[i : i + n] == raw[j : j + n]


def repeated(members: list[tuple[int, int, bytes]], length: int) -> list[np.ndarray]:
    """members: (group, anchor's place, bytes) of distinct fragments, by group. For each the starts of strings
    that another member of its group has too."""
    groups = np.unique(np.array([m[0] for m in members]), return_inverse=True)[1]
    raw = b"".join(m[2] for m in members)
    sizes = np.array([len(m[2]) for m in members])
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    anchor, end = begin + np.array([m[1] for m in members]), begin + sizes
    suffixes = Suffixes(np.frombuffer(raw, dtype=np.uint8), anchor, np.minimum(end, anchor + length))
    order = suffixes.sort(groups)
    # how far each suffix is shared with a neighbour
    reach = np.zeros(len(members), dtype=np.int64)
    a, b = order[:-1], order[1:]
    together = groups[a] == groups[b]
    a, b = a[together], b[together]
    shared = suffixes.common(a, b)
    for x, y, n in zip(a.tolist(), b.tolist(), shared.tolist(), strict=True):
        if not verified(raw, int(anchor[x]), int(anchor[y]), n):
            return _plainly(members, groups, length)
    np.maximum.at(reach, a, shared)
    np.maximum.at(reach, b, shared)
    # strings start d bytes before the anchor; those whose part after it is shared
    low = np.maximum(anchor - (end - length), length - reach)
    count = np.maximum(anchor - begin - low + 1, 0)
    who = np.repeat(np.arange(len(members)), count)
    d = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + low[who]
    at = anchor[who] - d
    value = suffixes.hashes(at, length)
    line = np.lexsort((value, d, groups[who]))
    x, y = line[:-1], line[1:]
    same = (groups[who[x]] == groups[who[y]]) & (d[x] == d[y]) & (value[x] == value[y])
    x, y = x[same], y[same]
    # verify each stretch of a pair once
    turn = np.lexsort((d[x], who[y], who[x]))
    x, y = x[turn], y[turn]
    if len(x):
        cut = np.flatnonzero((who[x][1:] != who[x][:-1]) | (who[y][1:] != who[y][:-1]) | (d[x][1:] != d[x][:-1] + 1)) + 1
        firsts, lasts = np.concatenate(([0], cut)), np.concatenate((cut, [len(x)])) - 1
        for f, g in zip(firsts.tolist(), lasts.tolist(), strict=True):
            if not verified(raw, int(at[x[g]]), int(at[y[g]]), int(d[x[g]] - d[x[f]]) + length):
                return _plainly(members, groups, length)
    hit = np.zeros(len(who), dtype=bool)
    hit[x] = hit[y] = True
    starts = (at - begin[who])[hit]
    owners = who[hit]
    bounds = np.searchsorted(owners, np.arange(len(members) + 1))
    return [np.sort(starts[bounds[i] : bounds[i + 1]]) for i in range(len(members))]


def _plainly(members: list[tuple[int, int, bytes]], groups: np.ndarray, length: int) -> list[np.ndarray]:
    """The same by the bytes themselves, for a batch in which two hashes collide."""
    seen = Counter((g, m[1] - s, m[2][s : s + length]) for g, m in zip(groups.tolist(), members, strict=True) for s in range(len(m[2]) - length + 1))
    return [np.array([s for s in range(len(m[2]) - length + 1) if seen[g, m[1] - s, m[2][s : s + length]] > 1], dtype=np.int64) for g, m in zip(groups.tolist(), members, strict=True)]


def covered(starts: np.ndarray, length: int) -> list[int]:
    """The bytes covered by strings at the sorted starts, as first, end, first, end ..."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    firsts, lasts = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut, [len(starts)])) - 1] + length
    return np.stack([firsts, lasts], axis=1).ravel().tolist()


# ---- over tables



def solver(length: int, key: pa.DataType):
    """Repeated bytes of each class, from rows (group, class, places, anchor's place, bytes) sorted by group and
    class, in batches of whole groups."""
    schema = pa.schema([("g", key), ("f", pa.binary()), ("spans", pa.list_(pa.int32()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, int, bytes]] = {}
        size, last = 0, None

        def flush():
            names = list(held)
            starts = repeated([(g, at, data) for (g, _), (_, at, data) in held.items()], length)
            spans = [[0, len(held[x][2])] if held[x][0] > 1 else covered(s, length) for x, s in zip(names, starts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], key), pa.array([x[1] for x in names], pa.binary()), pa.array(spans, pa.list_(pa.int32()))], schema=schema)

        for batch in batches:
            for g, f, c, at, data in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if size > BATCH and g != last:
                    yield flush()
                    held, size = {}, 0
                last = g
                if (g, f) not in held:
                    held[g, f] = (c, at, data)
                    size += len(data)
        if held:
            yield flush()

    return solve


def pieces_of(at: int, data: bytes, length: int, size: int = PIECE) -> list[tuple[int, int, int, bytes]]:
    """(block, first start, last start, core) of a fragment's pieces. A string's block comes from its distance to the
    anchor, so equal strings are in equal blocks, and the core is what all strings of the block cover."""
    out, n = [], len(data) - length + 1
    for block in range((at - n + 1) // size, at // size + 1):
        first, last = max(0, at - size * block - size + 1), min(n - 1, at - size * block)
        if first <= last:
            begin = at - size * block
            out.append((block, first, last, data[begin : begin + length - size + 1]))
    return out


def repeats(docs: DataFrame, key: str, text: str, length: int = 400, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """One row per row of docs: id, n_bytes, spans (array of start, end of the removed runs) and kept (the bytes that stay)."""
    gram = min(gram, length)
    rows = docs.select(F.col(key).cast("long").alias("real"), text_or_empty(F.col(text)).alias("text"))
    rows = rows.select("real", F.coalesce("real", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t"), F.encode("text", "UTF-8").alias("data"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each class in a document, with the number of its places."""
        for batch in batches:
            ids, ts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, value in enumerate(batch.column(2)):
                data = value.as_py()
                if len(data) >= length:
                    seen = Counter((a, digest_of(data[s:e])) for a, s, e, _ in fragments(data, length, gram))
                    out += [(a, f, c, ids[i], ts[i]) for (a, f), c in seen.items()]
                if len(out) > 20_000 or (out and i + 1 == batch.num_rows):
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["a", "f", "c", "id", "t"])
                    out = []

    found = rows.filter(F.octet_length("data") >= length).select("id", "t", "data").mapInArrow(scan, "a long, f binary, c long, id long, t long")
    short = F.xxhash64("f")
    anchors = found.groupBy("a").agg(F.sum("c").alias("n"), F.min(short).alias("lo"), F.max(short).alias("hi")).filter("n > 1").select("a", (F.col("lo") != F.col("hi")).alias("several"))
    places = materialize(found.join(anchors, "a"), "repeats")

    # one fragment of each class that shares its anchor with others
    some = places.filter("several").groupBy("a", "f").agg(F.sum("c").alias("c"), F.min(F.struct("id", "t")).alias("rep"))
    some = materialize(some, "classes")
    sizes = materialize(some.groupBy("a").agg(F.count(F.lit(1)).alias("size")), "sizes")
    # anchors of more than one in HOT of all classes are fewer than HOT: told to all tasks, so their classes stay put
    hottest = F.col("size") * HOT > some.count()
    marked = some.join(F.broadcast(sizes.filter(hottest)), "a", "left")
    sized = marked.filter("size IS NOT NULL").unionByName(marked.filter("size IS NULL").drop("size").join(sizes.filter(~hottest), "a"))
    wanted = sized.groupBy("rep.id", "rep.t").agg(F.collect_list(F.struct("a", "f", "c", "size")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted fragments' bytes; a document on several rows is read once."""
        before = None
        for batch in batches:
            for i in range(batch.num_rows):
                name = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if name == before:
                    continue
                before, data = name, batch.column(2)[i].as_py()
                want = {x["f"]: x for x in batch.column(3)[i].as_py()}
                out = []
                for a, s, e, at in fragments(data, length, gram):
                    x = want.pop(digest_of(data[s:e]), None)
                    if x:
                        out.append((a, x["f"], x["c"], x["size"], at - s, data[s:e]))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())], names=["a", "f", "c", "size", "at", "bytes"])

    texts = rows.select("id", "t", "data")
    shown = texts.join(wanted, ["id", "t"]).select("id", "t", "data", "wanted").mapInArrow(fetch, "a long, f binary, c long, size long, at int, bytes binary")
    shown = materialize(shown, "fragments")

    small = shown.filter(F.col("size") <= most).select("a", "f", "c", "at", "bytes").repartition("a").sortWithinPartitions("a", "f")
    solved = small.mapInArrow(solver(length, pa.int64()), "a long, f binary, spans array<int>")

    # fragments of large groups, in pieces
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = pieces_of(row["at"], row["bytes"], length)
                parts = [row["bytes"][lo : hi + length] for _, lo, hi, _ in found]
                keys = [digest_of(f"{row['a']}:{block}:".encode() + core) for block, _, _, core in found]
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.binary()), pa.array([digest_of(x) for x in parts], pa.binary()), pa.array([row["c"]] * n, pa.int64()), pa.array([row["at"] - lo for _, lo, _, _ in found], pa.int32()), pa.array(parts, pa.binary()),
                    pa.array([row["a"]] * n, pa.int64()), pa.array([row["f"]] * n, pa.binary()), pa.array([lo for _, lo, _, _ in found], pa.int32()),
                ], names=["k", "p", "c", "at", "bytes", "a", "f", "s"])

    hot = shown.filter(F.col("size") > most).select("a", "f", "c", "at", "bytes").dropDuplicates(["a", "f"])
    cut_pieces = hot.mapInArrow(cut_up, "k binary, p binary, c long, at int, bytes binary, a long, f binary, s int")
    kinds = cut_pieces.groupBy("k", "p").agg(F.sum("c").alias("c"), F.first("at").alias("at"), F.first("bytes").alias("bytes"))
    counted = kinds.join(kinds.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")), "k")
    few = counted.filter(F.col("kinds") <= most).select("k", "p", "c", "at", "bytes").repartition("k").sortWithinPartitions("k", "p")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the strings of pieces in groups that stay large."""
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["bytes"]) - length + 1
                digests = [digest_of(row["bytes"][s : s + length]) for s in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([row["k"]] * n, pa.binary()), pa.array([row["p"]] * n, pa.binary()), pa.array([row["c"]] * n, pa.int64()), pa.array(digests, pa.binary()), pa.array(range(n), pa.int32())], names=["k", "p", "c", "d", "s"])

    many = counted.filter(F.col("kinds") > most).select("k", "p", "c", "bytes").mapInArrow(strings, "k binary, p binary, c long, d binary, s int")
    twice = many.groupBy("k", "d").agg(F.sum("c").alias("n")).filter("n > 1").select("k", "d")
    by_string = many.join(twice, ["k", "d"], "left_semi").groupBy("k", "p").agg(F.sort_array(F.collect_list("s")).alias("at")).select("k", "p", F.flatten(F.transform("at", lambda s: F.array(s, s + length))).alias("spans"))
    of_pieces = few.mapInArrow(solver(length, pa.binary()), "k binary, p binary, spans array<int>").union(by_string).filter(F.size("spans") > 0)
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct((F.get("spans", i) + F.col("s")).alias("lo"), (F.get("spans", i + 1) + F.col("s")).alias("hi")))
    back = cut_pieces.filter("c = 1").select("k", "p", "a", "f", "s").join(of_pieces, ["k", "p"]).select("a", "f", pairs.alias("pairs"))
    spread = back.groupBy("a", "f").agg(F.sort_array(F.flatten(F.collect_list("pairs"))).alias("pairs")).select("a", "f", F.flatten(F.transform("pairs", lambda x: F.array(x["lo"], x["hi"]))).alias("spans"))
    whole = sized.filter((F.col("size") > most) & (F.col("c") > 1)).select("a", "f", F.array(F.lit(0), F.lit(-1)).alias("spans"))
    classes = solved.union(spread).union(whole).filter(F.size("spans") > 0)

    mine = places.filter("several").join(classes, ["a", "f"]).select("id", "t", "f", "spans").union(places.filter("not several").select("id", "t", "f", F.array(F.lit(0), F.lit(-1)).alias("spans")))
    gone = mine.groupBy("id", "t").agg(F.collect_list(F.struct("f", "spans")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for value, lost in zip(batch.column(1), batch.column(2), strict=True):
                data = value.as_py()
                runs: list[list[int]] = []
                if lost.is_valid:
                    by = {x["f"]: x["spans"] for x in lost.as_py()}
                    for _, s, e, _ in fragments(data, length, gram):
                        for lo, hi in zip(*[iter(by.get(digest_of(data[s:e]), ()))] * 2, strict=True):
                            lo, hi = s + lo, e if hi < 0 else s + hi
                            if runs and lo <= runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], hi)
                            else:
                                runs.append([lo, hi])
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    both = rows.join(gone, ["id", "t"], "left").select("real", "data", "gone")
    return both.mapInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeats(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
