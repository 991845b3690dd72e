"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

A document is the set of 64-bit hashes of its word n-grams. Documents of the same set, told by a 128-bit
digest of it, are one class; only classes are joined.

Tiles. Sizes fall into bands such that sets link only within a band or with the next. All sets are ordered
by one order of n-grams, those of frequent hash buckets last. If two sets link, their prefixes of size -
ceil(t * size) + 1 n-grams share one. All classes with an n-gram in their prefixes and a band in common
belong to the tile of the least class among them, so classes that share many n-grams meet in few tiles. In
a tile classes are sorted by size, and each meets the run of those not too large for it. An n-gram that very
many sets have is dealt to several tasks, whose least classes are then compared.

Signatures. A class has a bitmap of the parities of hashed n-gram counts, some bits an n-gram. The bits in
which two bitmaps differ are at most the n-grams in which the sets differ, so counting them bounds the
overlap from above. What passes is nearly always a link. A tile proposes only a spanning forest of the pairs
that pass; sorted arrays of exactly those are intersected. Where a proposed pair is no link, its tile is
met again without it, and with many times as many proposals between two parts as before, until no
proposal fails. So components are exact, and a group of near copies costs a row a member, not a pair.

A tile above TILE classes is met in blocks. Its members are first compared with its least class, FANOUT of
them in a task; links of that one need not meet each other, so only the others meet each other and everyone,
block against block.

Hashes of 64 bits stand for n-grams, of which two that differ collide once in 2**64 pairs.

Defined cases: a null or blank text has an empty set and links with nothing; a text of fewer words than n
has its whole sequence as its one n-gram. Rows without id make no links of their own (their component is
null) unless a row with an id is in their group. Rows that repeat an id are documents of their own texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import blank, if_light, join_uneven, remove, stored, tidy
from meshwright.llm.graph import components

#: Words that a worker remembers; classes that meet in one task; postings of an n-gram in one task.
HELD, TILE, POSTINGS = 200_000, 512, 1 << 16
#: Buckets that count n-grams for their order: fine ones for the lowest quarter of hashes, from which most
#: prefixes come, and coarse ones for the others.
FINE_BITS, COARSE_BITS = 24, 20
FINE = 1 << (FINE_BITS - 2)
SKETCH = FINE + (1 << COARSE_BITS)
CHUNK = 1 << 15
#: The filter that picks the rows whose sets are fetched again has this many bits a row, and at most 2 to the power of FILTER_BITS.
FILTER_LOAD, FILTER_BITS = 16, 27
NO_ID = -(1 << 63)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's word n-grams; a worker's own, as it remembers words."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # both concern ASCII only
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(known) > HELD:
                known.clear()
            for w in words:
                if w not in known:
                    v = xxhash.xxh3_64_intdigest(w)
                    known[w] = v - (1 << 64) if v >> 63 else v
            h = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        h = h.view(np.uint64)
        n = min(self.words, len(h))
        grams = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            grams = grams * _P + h[k : k + len(grams)]
        return np.unique(_mix(grams))


def class_name(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def short_name(name: bytes) -> int:
    """What postings carry of a class."""
    return int.from_bytes(name[:8], "little", signed=True)


def buckets(grams: np.ndarray) -> np.ndarray:
    fine = (grams >> np.uint64(64 - FINE_BITS)).astype(np.int64)
    coarse = (grams >> np.uint64(64 - COARSE_BITS)).astype(np.int64) + FINE
    return np.where(fine < FINE, fine, coarse)


def usual_counts(grams: int) -> tuple[float, float]:
    """The count that a fine and a coarse bucket of `grams` evenly spread hashes hardly exceed."""
    means = (grams / (1 << FINE_BITS), grams / (1 << COARSE_BITS))
    return tuple(m + 6 * m**0.5 + 4 for m in means)


def frequency_ranks(counts: np.ndarray, usual: float) -> np.ndarray:
    """0 for buckets as full as chance makes them; then a rank for each doubling."""
    return np.ceil(np.log2(np.maximum(counts / usual, 1))).astype(np.uint8)


def bitmap_bits(n: int) -> int:
    """Four to eight bits an n-gram: where few n-grams differ, they rarely cancel, and the bound is nearly exact."""
    return max(256, 1 << (4 * n - 1).bit_length())


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parities, as 64-bit words. Halves of a bitmap fold onto each other to that of half the bits."""
    bits = bitmap_bits(len(grams))
    odd = (np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _reduced(parts: DataFrame, kind: Any, join: np.ufunc) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, array) of (chunk, blob) rows of compressed pieces, joined piece by piece on the executors."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in frame["blob"]:
            own = np.frombuffer(zlib.decompress(blob), kind)
            total = own if total is None else join(total, own)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "blob": [zlib.compress(total.tobytes(), 1)]})

    for r in parts.groupBy("chunk").applyInPandas(add, "chunk long, blob binary").collect():
        yield r["chunk"], np.frombuffer(zlib.decompress(r["blob"]), kind)


def _pieces(array: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k in range(0, len(array), CHUNK):
        if array[k : k + CHUNK].any():
            yield k // CHUNK, zlib.compress(array[k : k + CHUNK].tobytes(), 1)


SIGNED = "_id long, _hash long, class binary, short long, n long, bits binary"


def sign(texts: DataFrame, words: int, paths: list[str]) -> tuple[DataFrame, np.ndarray, int]:
    """Rows of SIGNED for (_id, _hash, _text) rows, the order's bucket ranks, and the number of n-grams.

    One pass over the texts; the bucket counts travel as compressed pieces beside the rows, with n -1. A task
    gives the bitmap of a class once.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, counts, held, size, seen = Shingler(words), np.zeros(SKETCH, np.int32), [], 0, set()
        columns = ["_id", "_hash", "class", "short", "n", "bits"]
        for frame in frames:
            own = []
            for doc, mark, text in zip(frame["_id"].tolist(), frame["_hash"].tolist(), frame["_text"].tolist(), strict=True):
                grams = shingle(text)
                name, bits = class_name(grams), None
                if name not in seen and len(grams):
                    if len(seen) > HELD:
                        seen.clear()
                    seen.add(name)
                    bits = bitmap(grams).tobytes()
                own.append((doc, mark, name, short_name(name), len(grams), bits))
                held.append(buckets(grams))
                size += len(grams)
                if size > 1 << 21:
                    np.add.at(counts, np.concatenate(held), np.int32(1))  # no second array of that size
                    held, size = [], 0
            yield pd.DataFrame(own, columns=columns)
        if held:
            np.add.at(counts, np.concatenate(held), np.int32(1))  # no second array of that size
        yield pd.DataFrame([(k, 0, b"", 0, -1, blob) for k, blob in _pieces(counts)], columns=columns)

    signed = stored(texts.mapInPandas(tidy(task), SIGNED), paths)
    counts = np.zeros(SKETCH, np.int32)
    for k, own in _reduced(signed.where("n = -1").select(F.col("_id").alias("chunk"), F.col("bits").alias("blob")), np.int32, np.add):
        counts[k * CHUNK : k * CHUNK + len(own)] = own
    grams = int(counts.sum(dtype=np.int64))
    usual, ranks = usual_counts(grams), np.zeros(SKETCH, np.uint8)
    for k in range(0, SKETCH, CHUNK):  # FINE is a multiple of CHUNK
        ranks[k : k + CHUNK] = frequency_ranks(counts[k : k + CHUNK], usual[k >= FINE])
    return signed.where("n >= 0"), ranks, grams


def classes_of(rows: DataFrame) -> DataFrame:
    """(class, short, rep, copies, n, bits) of the rows of sign(), without the empty set."""
    least = F.min(F.when(F.col("_id") != NO_ID, F.col("_id")))
    own = rows.where("n > 0").groupBy("class").agg(
        F.first("short").alias("short"), least.alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits")
    )
    return own.withColumn("rep", F.coalesce("rep", F.lit(NO_ID)))


def band_starts(share: tuple[int, int]) -> np.ndarray:
    """Least sizes of the bands: sets link only within a band or with the next one."""
    num, den = share
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * den // num + 1)
    return np.array(starts, np.int64)


def prefix_postings(texts: DataFrame, words: int, share: tuple[int, int], ranks: Broadcast, usual: tuple[float, float]) -> DataFrame:
    """(gram, salt, short) for the prefix of every set, each class once a task; gram is of an n-gram and a size band.

    A set has the n-grams of its prefix in its own band. In the next band, where partners are at least as
    large as that begins, a shorter prefix will do. salt: which of an n-gram's tasks gets the class; it is -1
    where the n-gram has only one.
    """
    num, den = share
    starts = band_starts(share)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, seen = Shingler(words), set()
        order = ranks.value
        for frame in frames:
            out, salts, names, held = [], [], [], 0
            for text in frame["_text"].tolist():
                grams = shingle(text)
                n = len(grams)
                if not n:
                    continue
                name = short_name(class_name(grams))
                if name in seen:
                    continue
                if len(seen) > HELD:
                    seen.clear()
                seen.add(name)
                size = n - -(-num * n // den) + 1
                own = buckets(grams)
                rank = order[own]
                at = np.argsort(rank, kind="stable")[:size] if rank.any() else np.arange(size)
                first = grams[at]
                band = int(np.searchsorted(starts, n, side="right")) - 1
                ahead = max(0, n - -(-num * int(starts[band + 1]) // den) + 1)
                offsets = [np.uint64(b * int(_P) & (1 << 64) - 1) for b in (band, band + 1)]
                keys = np.concatenate([first + offsets[0], first[:ahead] + offsets[1]])
                expected = np.where(own[at] < FINE, *usual) * np.exp2(rank[at])
                tasks = np.maximum(expected / POSTINGS, 1).astype(np.int64)
                salt = np.where(tasks > 1, name % tasks, -1).astype(np.int32)
                out.append(_mix(keys).view(np.int64))
                salts.append(np.concatenate([salt, salt[:ahead]]))
                names.append(np.full(len(keys), name, np.int64))
                held += len(keys)
                if held > 500_000:
                    yield pd.DataFrame({"gram": np.concatenate(out), "salt": np.concatenate(salts), "short": np.concatenate(names)})
                    out, salts, names, held = [], [], [], 0
            if out:
                yield pd.DataFrame({"gram": np.concatenate(out), "salt": np.concatenate(salts), "short": np.concatenate(names)})

    return texts.select("_text").mapInPandas(tidy(task), "gram long, salt int, short long")


def leaders(postings: DataFrame, salted: bool) -> DataFrame:
    """(lead, short): each class but the least of an n-gram, with the least. salted: whether any n-gram has several tasks."""
    # a running first keeps no rows
    least = F.first("short").over(Window.partitionBy("gram", "salt").orderBy("short").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    led = postings.withColumn("lead", least)
    if salted:
        own = led.where("salt >= 0").groupBy("gram", "salt").agg(F.min("short").alias("lead"))
        of_gram = own.groupBy("gram").agg(F.min("lead").alias("least"))
        both = led.where("salt >= 0").drop("lead").join(own.join(of_gram, "gram").select("gram", "salt", F.col("least").alias("lead")), ["gram", "salt"])
        led = led.where("salt < 0").unionByName(both)
    return led.where("lead <> short").select("lead", "short").distinct()


class Parts:
    """Which members of a tile are known to hang together."""

    def __init__(self, names: np.ndarray, linked: list[tuple[bytes, bytes]], near: np.ndarray) -> None:
        self.of = np.arange(len(names))
        if near.any():
            self.of[near] = int(np.flatnonzero(near)[0])  # all of them link with the tile's least class
        place = {x: i for i, x in enumerate(names)} if linked else {}
        for x, y in linked:
            self.join(place[x], place[y])

    def join(self, i: int, j: int) -> None:
        a, b = self.of[i], self.of[j]
        if a != b:
            self.of[self.of == b] = a


def propose(
    n: np.ndarray, bits: list[np.ndarray], linked: list[tuple[bytes, bytes]], share: tuple[int, int], failed: set[tuple[bytes, bytes]], names: list[bytes], budget: int, near: np.ndarray
) -> list[tuple[int, int]]:
    """Pairs of a tile, as places of the members, whose bitmaps allow a link; the one of the least name first.

    With a budget of 1 they are a forest that joins parts; with more, up to that many between two parts.
    linked, failed: pairs of names that are known to. near: members that link with a class of their own, and
    need not meet each other. Members come sorted by n.
    """
    num, den = share
    parts = Parts(names, linked, near)
    sizes = np.array([len(b) for b in bits])
    levels = {}
    for size in np.unique(sizes):
        at = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        levels[int(size)] = (at, np.stack([folded(bits[i], int(size)) for i in at]))
    out: list[tuple[int, int]] = []
    used: dict[tuple[int, int], int] = {}
    stops = np.searchsorted(num * n, den * n, side="right")  # those after i up to here are not too large
    for i in range(len(n) - 1):
        stop = int(stops[i])
        if stop <= i + 1:
            continue
        apart = parts.of[i + 1 : stop] != parts.of[i]
        if near[i]:
            apart &= ~near[i + 1 : stop]
        if not apart.any():
            continue
        at, matrix = levels[int(sizes[i])]
        begin = int(np.searchsorted(at, i + 1))
        end = int(np.searchsorted(at, stop))
        rows = at[begin:end]
        open_ = np.flatnonzero(apart[rows - i - 1])
        if not len(open_):
            continue
        rows = rows[open_]
        own = folded(bits[i], int(sizes[i]))
        hits, by = [], []
        for lo in range(0, len(rows), 4096):
            some = rows[lo : lo + 4096]
            differ = np.bitwise_count(matrix[begin + open_[lo : lo + 4096]] ^ own).sum(1, dtype=np.int64)
            # (n_i + n_j - differing) / 2 must reach t (n_i + n_j) / (1 + t)
            allowed = (num + den) * differ <= (den - num) * (n[i] + n[some])
            hits.append(some[allowed])
            by.append(differ[allowed])
        hits, by = np.concatenate(hits), np.concatenate(by)
        for j in hits[np.argsort(by, kind="stable")].tolist():
            pair = (i, j) if names[i] < names[j] else (j, i)
            if parts.of[i] == parts.of[j] or (names[pair[0]], names[pair[1]]) in failed:
                continue
            if budget == 1:
                parts.join(i, j)
            else:
                between = tuple(sorted((int(parts.of[i]), int(parts.of[j]))))
                if used.get(between, 0) >= budget:
                    continue
                used[between] = used.get(between, 0) + 1
            out.append(pair)
    return out


def _pair_differs(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps; the longer one is folded to the other's size."""
    if len(a) > len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 4 * len(b)
    while size >= 8 * len(a):
        y = (y >> size) ^ (y & ((1 << size) - 1))
        size //= 2
    return (x ^ y).bit_count()


MEMBER = ["tile", "kind", "class", "rep", "other", "n", "bits", "near"]
#: Kinds of a tile's rows: pairs that are known to link, pairs that are known not to, members.
LINKED, FAILED, OWN = 0, 1, 2


def meet_tiles(members: DataFrame, share: tuple[int, int], budget: int) -> DataFrame:
    """(tile, x, x_rep, y, y_rep, fan): the proposals of each tile, from rows of MEMBER columns.

    fan: the FANOUT pairs of x that this one is of.
    """
    num, den = share

    def met(tile: str, rows: pd.DataFrame) -> list[tuple]:
        kind, names = rows["kind"].to_numpy(), rows["class"].tolist()
        links, known = (int(k) for k in np.searchsorted(kind, (FAILED, OWN)))  # sorted by kind
        others = rows["other"].tolist()
        linked, failed = list(zip(names[:links], others[:links], strict=True)), set(zip(names[links:known], others[links:known], strict=True))
        names, n, near = names[known:], rows["n"].to_numpy(np.int64)[known:], rows["near"].to_numpy(bool)[known:]
        if len(n) < 2:
            return []
        blobs, reps = rows["bits"].tolist()[known:], rows["rep"].to_numpy(np.int64)[known:]
        if len(n) == 2 and not known:
            p, q = int(n[0]), int(n[1])
            if den * p < num * q or (near[0] and near[1]) or (num + den) * _pair_differs(blobs[0], blobs[1]) > (den - num) * (p + q):
                return []
            pairs = [(0, 1) if names[0] < names[1] else (1, 0)]
        else:
            pairs = propose(n, [np.frombuffer(b, np.uint64) for b in blobs], linked, share, failed, names, budget, near)
        of_x: dict[int, int] = {}
        out = []
        for x, y in pairs:
            of_x[x] = of_x.get(x, -1) + 1
            out.append((tile, names[x], int(reps[x]), names[y], int(reps[y]), of_x[x] // FANOUT))
        return out

    def tiles_of(frame: pd.DataFrame) -> pd.DataFrame:
        tiles = frame["tile"].tolist()
        edges = [0, *(k for k in range(1, len(tiles)) if tiles[k] != tiles[k - 1]), len(tiles)]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out += met(tiles[a], frame.iloc[a:b])
        return pd.DataFrame(out, columns=["tile", "x", "x_rep", "y", "y_rep", "fan"])

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for frame in frames:  # sorted by tile; the last tile of a batch may go on in the next
            tiles = frame["tile"].to_numpy()
            if rest and tiles[0] != rest[0]["tile"].iloc[0]:
                yield tiles_of(pd.concat(rest, ignore_index=True))
                rest = []
            others = np.flatnonzero(tiles != tiles[-1])
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole:
                yield tiles_of(pd.concat([*rest, frame.iloc[:whole]], ignore_index=True))
                rest = []
            rest.append(frame.iloc[whole:])
        if rest:
            yield tiles_of(pd.concat(rest, ignore_index=True))

    rows = members.select(*MEMBER).repartition("tile").sortWithinPartitions("tile", "kind", "n", "class")
    return rows.mapInPandas(tidy(task), "tile string, x binary, x_rep long, y binary, y_rep long, fan int")


def _sets(texts: DataFrame, words: int, need: DataFrame, n_need: int) -> DataFrame:
    """(class, grams: binary of the sorted set) of the rows whose id is needed, from the texts.

    Light ids are broadcast. Many set a filter sized by their count, and what that lets through by chance
    falls to the caller's join by class; beyond what a filter can hold the rows are joined with the ids.
    """
    size = max(FILTER_LOAD * n_need, 1).bit_length()

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        field = np.frombuffer(shared.value, np.uint8) if shared else None
        for frame in frames:
            if field is not None:
                at = _filter_slots(frame["_id"].to_numpy(np.int64), size)
                frame = frame[(field[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
            out, held = [], 0
            for text in frame["_text"].tolist():
                grams = shingle(text)
                if len(grams):
                    out.append((class_name(grams), grams.tobytes()))
                    held += len(grams)
                if held > 1 << 20:
                    yield pd.DataFrame(out, columns=["class", "grams"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["class", "grams"])

    shared, ids = None, need.select(F.col("rep").alias("_id")).distinct()
    if n_need * 8 <= 1 << 19 or size > FILTER_BITS:
        texts = texts.join(if_light(ids, n_need, 8), "_id", "left_semi")
    else:

        def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            field = np.zeros(1 << size, bool)
            for frame in frames:
                field[_filter_slots(frame["_id"].to_numpy(np.int64), size)] = True
            yield pd.DataFrame([*_pieces(np.packbits(field, bitorder="little"))], columns=["chunk", "blob"])

        field = np.zeros(1 << size - 3, np.uint8)
        for k, own in _reduced(ids.mapInPandas(tidy(mark), "chunk long, blob binary"), np.uint8, np.bitwise_or):
            field[k * CHUNK : k * CHUNK + len(own)] = own
        shared = texts.sparkSession.sparkContext.broadcast(field.tobytes())
    return texts.select("_id", "_text").mapInPandas(tidy(sets_of), "class binary, grams binary")


def _filter_slots(ids: np.ndarray, size: int) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) >> np.uint64(64 - size)).astype(np.int64)


#: Pairs of one class that are compared in one task on average.
FANOUT = 512


def verify(texts: DataFrame, words: int, share: tuple[int, int], pairs: DataFrame, paths: list[str]) -> DataFrame:
    """(x, y, linked) for the distinct pairs of (x, x_rep, y, y_rep, fan): whether their sets reach the share.

    A set goes from its text to where it is needed: y's to x's, and x's own once for every fan.
    """
    num, den = share
    own = pairs.groupBy("x", "y").agg(*(F.min(c).alias(c) for c in ("x_rep", "y_rep", "fan")))
    to_x = own.select(F.col("y").alias("class"), F.col("y_rep").alias("rep"), "x", "fan", F.col("y").alias("other"))
    itself = own.select(F.col("x").alias("class"), F.col("x_rep").alias("rep"), "x", "fan", F.lit(None).cast("binary").alias("other")).distinct()
    errands = stored(to_x.unionByName(itself), paths)
    n = errands.count()
    sent = _sets(texts, words, errands, n).join(if_light(errands.drop("rep"), n, 64), "class")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, mine = None, np.zeros(0, np.uint64)
        for frame in frames:
            out = []
            for x, fan, y, blob in zip(frame["x"].tolist(), frame["fan"].tolist(), frame["other"].tolist(), frame["grams"].tolist(), strict=True):
                grams = np.frombuffer(blob, np.uint64)
                if y is None:
                    name, mine = (x, fan), grams
                elif name == (x, fan):
                    at = np.searchsorted(mine, grams)
                    both = int((mine[np.minimum(at, len(mine) - 1)] == grams).sum())
                    out.append((x, y, den * both >= num * (len(mine) + len(grams) - both)))
            yield pd.DataFrame(out, columns=["x", "y", "linked"])

    rows = sent.select("x", "fan", "other", "grams").repartition("x", "fan").sortWithinPartitions("x", "fan", F.col("other").asc_nulls_first())
    # rows that repeat a representative's id and text bring its set twice
    return stored(rows.mapInPandas(tidy(task), "x binary, y binary, linked boolean").dropDuplicates(["x", "y"]), paths)


def _stars(big: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(tile, x, x_rep, y, y_rep, fan): members of large tiles whose bitmaps allow a link with the least class, as x.

    big: (lead, tasks, first, class, rep, n, bits); `first` marks the tile's least class, which goes to every
    task, the others to one of them each.
    """
    num, den = share

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for frame in frames:
            out = []
            columns = (frame[c].tolist() for c in ("lead", "fan", "class", "rep", "n", "bits"))
            for lead, fan, name, rep, n, bits in zip(*columns, strict=True):
                own = np.frombuffer(bits, np.uint64)
                if key != (lead, fan):  # the least class comes first
                    key, star = (lead, fan), (name, rep, n, own)
                    continue
                x, x_rep, m, other = star
                if den * min(n, m) < num * max(n, m):
                    continue
                size = min(len(own), len(other))
                differ = int(np.bitwise_count(folded(own, size) ^ folded(other, size)).sum())
                if (num + den) * differ <= (den - num) * (n + m):
                    out.append((str(lead), x, x_rep, name, rep, fan))
            yield pd.DataFrame(out, columns=["tile", "x", "x_rep", "y", "y_rep", "fan"])

    fans = F.when(F.col("first"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), F.col("tasks")).cast("int")))
    rows = big.select("lead", F.explode(fans).alias("fan"), "first", "class", "rep", "n", "bits")
    rows = rows.repartition("lead", "fan").sortWithinPartitions("lead", "fan", F.col("first").desc(), "class")
    return rows.mapInPandas(tidy(task), "tile string, x binary, x_rep long, y binary, y_rep long, fan int")


def _blocks(big: DataFrame, links: DataFrame, n_tiles: int) -> DataFrame:
    """The members of large tiles, dealt to tiles of blocks: (tile, class, rep, n, bits, near).

    links: (tile, class) of members that link with the tile's least class. They meet only the others.
    """
    own = big.withColumn("tile", F.col("lead").cast("string")).join(links.withColumn("near", F.lit(True)), ["tile", "class"], "left")
    own = own.withColumn("near", F.coalesce("near", F.lit(False)) | F.col("first"))
    blocks = lambda near: F.ceil(F.sum(F.when(F.col("near") == near, 1).otherwise(0)) / TILE).cast("int")
    sizes = own.groupBy("tile").agg(blocks(True).alias("near_blocks"), blocks(False).alias("far_blocks"))
    dealt = own.join(if_light(sizes, n_tiles, 40), "tile").where("far_blocks > 0")
    block = F.pmod(F.xxhash64("class"), F.greatest(F.when(F.col("near"), F.col("near_blocks")).otherwise(F.col("far_blocks")), F.lit(1))).cast("int")
    dealt = dealt.withColumn("block", block)
    others = F.sequence(F.lit(1), F.col("far_blocks"))
    name = lambda a, b: F.concat_ws("/", F.col("tile"), a, b)
    far = F.transform(others, lambda o: name(F.least(o - 1, F.col("block")).cast("string"), F.greatest(o - 1, F.col("block")).cast("string")))
    with_near = F.transform(F.sequence(F.lit(1), F.greatest(F.col("near_blocks"), F.lit(1))), lambda o: name(F.col("block").cast("string"), F.concat(F.lit("n"), (o - 1).cast("string"))))
    near = F.transform(others, lambda o: name((o - 1).cast("string"), F.concat(F.lit("n"), F.col("block").cast("string"))))
    places = F.when(F.col("near"), near).otherwise(F.concat(far, F.when(F.col("near_blocks") > 0, with_near).otherwise(F.array().cast("array<string>"))))
    return dealt.withColumn("tile", F.explode(places)).select("tile", "class", "rep", "n", "bits", "near")


def class_links(texts: DataFrame, classes: DataFrame, ranks: np.ndarray, grams: int, words: int, share: tuple[int, int], paths: list[str]) -> DataFrame:
    """(a, b): links between classes that join exactly the classes that links join."""
    spark, usual = texts.sparkSession, usual_counts(grams)
    shared = spark.sparkContext.broadcast(ranks)
    fullest = [u * 2.0 ** int(r.max()) for u, r in zip(usual, (ranks[:FINE], ranks[FINE:]), strict=True)]
    tiles = stored(leaders(prefix_postings(texts, words, share, shared, usual), max(fullest) > POSTINGS), paths)
    shared.unpersist()
    rows = tiles.withColumn("first", F.lit(False)).unionByName(tiles.select("lead", F.col("lead").alias("short"), F.lit(True).alias("first")).distinct())
    members = stored(rows.join(classes.select("short", "class", "rep", "n", "bits"), "short").drop("short"), paths)
    tasks = F.ceil(F.col("size") / FANOUT).cast("int").alias("tasks")
    large = stored(members.groupBy("lead").agg(F.count("*").alias("size")).where(F.col("size") > TILE).select("lead", tasks), paths)
    tile = F.col("lead").cast("string").alias("tile")
    own = members.join(large, "lead", "left_anti").select(tile, "class", "rep", "n", "bits", F.lit(False).alias("near"))
    found = []
    if n_large := large.count():
        big = stored(members.join(if_light(large, n_large, 16), "lead"), paths)
        near = stored(_stars(big, share), paths)
        linked = near.join(verify(texts, words, share, near, paths).where("linked"), ["x", "y"])
        linked = stored(linked.select("tile", F.col("x").alias("a"), F.col("y").alias("b")).distinct(), paths)
        found.append(linked.select("a", "b"))
        own = own.unionByName(_blocks(big, linked.select("tile", F.col("b").alias("class")), n_large))
        own = stored(own, paths)

    told, budget = None, 1
    now = own
    while True:
        rows = now.select("tile", F.lit(OWN).alias("kind"), "class", "rep", F.lit(None).cast("binary").alias("other"), "n", "bits", "near")
        if told is not None:
            kind = F.when(F.col("linked"), LINKED).otherwise(FAILED)
            zero = F.lit(0).cast("long")  # no null: it would turn the column's integers into floating point
            rows = rows.unionByName(told.select("tile", kind.alias("kind"), F.col("x").alias("class"), zero.alias("rep"), F.col("y").alias("other"), zero.alias("n"), F.lit(b"").alias("bits"), F.lit(False).alias("near")))
        proposed = stored(meet_tiles(rows, share, budget), paths)
        checked = verify(texts, words, share, proposed, paths)
        found.append(checked.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))
        # only tiles with a pair that failed just now can have more to propose
        told_now = stored(proposed.select("tile", "x", "y").join(checked, ["x", "y"]), paths)
        wrong = told_now.where("not linked").select("tile").distinct()
        again = stored(wrong, paths)
        if not again.count():
            break
        told = told_now if told is None else told.unionByName(told_now)
        told = stored(told.join(again, "tile", "left_semi"), paths)
        now = stored(now.join(again, "tile", "left_semi"), paths)
        budget *= 16
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def grouped(docs: DataFrame, words: int, share: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, n, component, name) for every row: its component's least class and that one's least id, NO_ID for none.

    _hash is of the text as given. An empty set has the component null.
    """
    spark, used = docs.sparkSession, []
    text = blank(text_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_col).alias("_hash"), text.alias("_text"))
    signed, ranks, grams = sign(texts, words, used)
    rows = stored(signed.select("_id", "_hash", "class", "n"))
    classes = stored(classes_of(signed), used)
    links = class_links(texts.select("_id", "_text"), classes, ranks, grams, words, share, used)
    found = stored(components(links), used)
    named = classes.select("class", "rep", "copies").join(found.withColumnRenamed("node", "class"), "class", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "class")), used)
    # ids that are not null come first
    least = F.coalesce(F.min(F.when(F.col("rep") != NO_ID, F.col("rep"))), F.lit(NO_ID))
    names = named.groupBy("component").agg(least.alias("name"), F.count("*").alias("_members"))
    total, members = named.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    of_class = stored(join_uneven(named.select("class", "copies", "component"), names, ["component"], "_members", members))
    remove(spark, used)
    some = join_uneven(rows.where("n > 0"), of_class, ["class"], "copies", total).select("_id", "_hash", "n", "component", "name")
    none = rows.where("n = 0").select("_id", "_hash", "n", F.lit(None).cast("binary").alias("component"), F.lit(NO_ID).alias("name"))
    return some.unionByName(none)


def jaccard_components(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row. Two documents link when share[1] * |A and B| >= share[0] * |A or B|."""
    rows = grouped(docs, words, share, id_col, text_col)
    own, name = (F.when(F.col(c) != NO_ID, F.col(c)) for c in ("_id", "name"))
    return rows.select(own.alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(name, own).alias("component_id"))


def near_distinct(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with their own columns, but of each group only the one of the least id, ties to the text's hash.

    Rows without id count as the greatest. Rows with an empty set all stay.
    """
    rows = stored(grouped(docs, words, share, id_col, text_col))
    order = F.struct((F.col("_id") == NO_ID).alias("none"), "_id", "_hash")
    first = rows.where("component is not null").groupBy("component").agg(F.min(order).alias("o")).select("o._id", "o._hash", F.lit(False).alias("_all"))
    keep = stored(first.unionByName(rows.where("component is null").select("_id", "_hash", F.lit(True).alias("_all")).distinct()))
    own = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    met = own.join(keep, ["_id", "_hash"])
    same = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id"))
    one = met.where("not _all").withColumn("_same", same).where("_same = 1")
    return met.where("_all").select("_row.*").unionByName(one.select("_row.*"))
