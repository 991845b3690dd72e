"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

An expression w is a word in lower case without punctuation around it. Its history h is the last of the
corpus's most common words before it, or that there was none: common words tell the language and
the kind of text, so a class is not told by these. A class c (toxic, ordinary) gives w, of stem s (its first
letters), the probability

    P_c(w | h) = (n_c(h, w) - d(n_c(h, w), D_c)) / n_c(h) + L_c(h) P_c(s | h) P(w | h) / P(s | h)
    P_c(s | h) = (n_c(h, s) - d(n_c(h, s), E_c)) / n_c(h) + K_c(h) P(s | h)

with n_c(h, w) the documents of c that have w after h, and L_c(h) and K_c(h) the masses that the discounts
free. As in modified Kneser-Ney a discount grows with its count: d(n, D) = D (1 - exp(-n / D)) is less than
every n, so no pair that a class has loses its own share, and D at most. (`fit_models` also makes the models
of constant discounts, min(n, D), which leave pairs up to D without a share of their own.) P is the shared
model, of all documents, labelled or not:

    P(w | h) = max(n(h, w) - D, 0) / n(h) + D N(h.) / n(h) P(w)
    P(w)     = max(N(.w) - D, 0) / N(..) + D / N(..)

where N(.w) is the number of histories that w follows, N(h.) of expressions after h, N(..) of pairs. The
discounts are set so that both classes free the same share of their mass: a model of fewer documents would
else lean more on the shared counts, and long texts would differ by that alone. Which share is chosen from
GROWING by the errors on labelled rows that the counts have not seen.

A text's log-likelihoods are over all its tokens. An expression that a text repeats after the same history is
foretold by the text itself, alike under both models. The difference of the log-likelihoods, over the
length to the power of LENGTH, is set against the threshold with the fewest errors on those rows.

Counts come from every document and travel as one row per pair and task at most. Scoring needs every
pair, and every pair of a history and a stem, that a class has. Each is kept under its own name, or the 128-bit
digest of it: they are counted and broadcast up to ENTRIES of them and NAME_CHARS characters; beyond, they stay
a table that is joined to the distinct pairs of blocks of documents. Both ways give the same means.

Defined cases: a null text is empty; a text without expressions has the mean 0. Rows that repeat an id are
scored one by one, and counted as often. Without toxic or without ordinary labels no row is predicted toxic.
Common words of equal count go by name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass
from itertools import count, islice, repeat
from math import fsum, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from meshwright.llm.common import blank, bound_batches, stored, tidy, with_labels

#: Common words that are histories, and which share of all words they are at least; letters of a stem.
COMMON, OFTEN, STEM = 7, 200, 5
#: Share of a part's words, twice OFTEN at least, from which on a name's count in the part is passed on.
RARE = 4_000
#: Discount of the shared model, power of the length.
SHARED_DISCOUNT, LENGTH = 0.75, 0.5
#: Shares of a class's mass that its discounts free, for expressions and for stems: by growing discounts,
GROWING = ((0.85, 0.93), (0.93, 0.97), (0.96, 0.985))
#: and by constant ones.
MASSES = ((0.7, 0.85), (0.8, 0.9), (0.85, 0.95), (0.92, 0.97), (0.97, 0.99))
#: Entries, and characters of their names, that are still broadcast: nine bytes an entry and 20 a name in a worker,
#: and 16 more an entry while the models of GROWING are compared.
ENTRIES, NAME_CHARS = 4_000_000, 64_000_000
#: Distinct words that a worker remembers while it counts or scores.
HELD = 200_000
#: Expressions that are looked up together.
LOOKED_UP = 1 << 15
#: The fold that calibrates; fold 0 is held out, the others are counted by class.
CALIBRATION = 1
#: Bins of the calibration histogram in a unit of mean log ratio.
BINS = 2000
EDGES = ".,;:!?#$%&*|()[]{}<>\"'`~^_=+-/\\@"
CLASSES = ("ordinary", "toxic")


def numbering() -> dict[str, int]:
    """A dictionary that numbers the keys it is asked for, from 0 on."""
    return defaultdict(count().__next__)


def latest(keys: dict[str, int], n: int) -> list[str]:
    """The n keys that came last, in order."""
    return list(islice(reversed(keys), n))[::-1]


class Tokens:
    """Pairs of history and expression as numbers; a worker's own, as it remembers words."""

    def __init__(self, common: list[str], held: int = HELD) -> None:
        self.held = held
        self.places = {w: k + 1 for k, w in enumerate(common)}
        self.wide = len(common) + 1
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = numbering()
        self.numbers: dict[str, int] = numbering()
        self.numbers[""] = -1
        self.names: list[str] = []
        #: Of each word, expression number times `wide` plus the place among the common ones; below 0 without an expression.
        self.codes, self.known = np.zeros(1024, np.int64), 0

    def full(self) -> bool:
        return len(self.words) > self.held

    def _learn(self) -> None:
        """The codes of the words that are numbered since the last call."""
        new = latest(self.words, len(self.words) - self.known)
        if len(self.words) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros(2 * len(self.words), np.int64)])
        names = [w.strip(EDGES) for w in new]
        numbers = np.fromiter(map(self.numbers.__getitem__, names), np.int64, len(names))
        places = np.fromiter(map(self.places.get, names, repeat(0)), np.int64, len(names))
        self.codes[self.known : len(self.words)] = numbers * self.wide + places
        self.names += latest(self.numbers, len(self.numbers) - 1 - len(self.names))
        self.known = len(self.words)

    def __call__(self, text: str) -> tuple[np.ndarray, int]:
        """The distinct pairs, as expression number times `wide` plus history, and the length in expressions."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.int64), 0
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if len(self.words) > self.known:
            self._learn()
        codes = self.codes[ids]
        places = codes % self.wide
        at = np.flatnonzero(places)
        ends = np.concatenate(([-1], at, [len(words) - 1]))
        before = np.repeat(np.concatenate(([0], places[at])), ends[1:] - ends[:-1])
        own = (codes - places + before)[codes >= 0]
        return np.unique(own), len(own)


def common_words(docs: DataFrame, text_col: str) -> list[str]:
    """The COMMON most common expressions of all texts, of those that are one in OFTEN or more.

    Every word is counted. A task that holds too many passes on the counts of names that are one in RARE or more of
    its own, with the largest count that it leaves out, and begins anew. What was left out bounds every name's
    count; where these bounds don't tell which names are the most common, those that may be are counted once more.
    """
    rows = docs.select(blank(text_col).alias("_text"))
    counts = _name_counts(rows).groupBy("name").agg(*(F.sum(c).alias(c) for c in ("n", "left")))
    # names that may be one in OFTEN were passed on with half of that or more, so there are no more of them than this
    found = counts.orderBy(F.col("name") != "", F.desc("n"), "name").limit(2 * OFTEN + 1).collect()
    if not found:
        return []
    total, left = found[0]["n"], found[0]["left"]
    least = {r["name"]: r["n"] for r in found[1:]}
    most = {r["name"]: r["n"] + left - r["left"] for r in found[1:]}
    maybe = [w for w, n in most.items() if n * OFTEN >= total]
    first = [w for w in sorted(maybe, key=lambda w: (-least[w], w)) if least[w] * OFTEN >= total][:COMMON]
    others = [most[w] for w in maybe if w not in first]
    if others and (len(first) < COMMON or max(others) >= min(least[w] for w in first)):
        exact = _name_counts(rows, frozenset(maybe)).groupBy("name").agg(F.sum("n").alias("n")).collect()
        often = [(-r["n"], r["name"]) for r in exact if r["name"] and r["n"] * OFTEN >= total]
        first = [w for _, w in sorted(often)[:COMMON]]
    return sorted(first)


def _name_counts(rows: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    """(name, n, left) by parts of the texts: names that are one in RARE or more of a part's words, or those given.

    left is the largest count in the part of a name that is not there. The empty name has the number of words.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            names: dict[str, int] = {}
            for w, n in counts.items():
                name = w.strip(EDGES)
                names[name] = names.get(name, 0) + n
            total, left = counts.total(), 0
            names.pop("", None)
            if among is not None:
                kept = {w: n for w, n in names.items() if w in among}
            else:
                kept = {w: n for w, n in names.items() if n * RARE >= total}
                left = max((n for n in names.values() if n * RARE < total), default=0)
            kept[""] = total
            return pa.RecordBatch.from_pydict({"name": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64()), "left": pa.array([left] * len(kept), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.lower().split())
                if len(counts) > HELD:
                    yield counted()
                    counts.clear()
        yield counted()

    return rows.mapInArrow(tidy(task), "name string, n long, left long")


def count_pairs(docs: DataFrame, text_col: str, common: list[str]) -> DataFrame:
    """(h, name, ordinary, toxic, all): documents of the classes, and all, with an expression after a history."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(common)
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def counted() -> Iterator[pd.DataFrame]:
            each = [np.unique(np.concatenate(x or [np.zeros(0, np.int64)]), return_counts=True) for x in held]
            pairs = np.unique(np.concatenate([keys for keys, _ in each]))
            counts = np.zeros((3, len(pairs)), np.int64)
            for k, (keys, n) in enumerate(each):
                counts[k, np.searchsorted(pairs, keys)] = n
            for at in range(0, len(pairs), 50_000):
                part = slice(at, at + 50_000)
                numbers, h = np.divmod(pairs[part], tokens.wide)
                ordinary, toxic, other = counts[:, part]
                yield pd.DataFrame({"h": h, "name": [tokens.names[k] for k in numbers.tolist()], "ordinary": ordinary, "toxic": toxic, "all": ordinary + toxic + other})

        for frame in frames:
            for text, side in zip(frame["_text"].tolist(), frame["_side"].tolist(), strict=True):
                own, _ = tokens(text)
                held[side].append(own)
                size += len(own)
                if tokens.full() or size > 8 << 20:
                    yield from counted()
                    tokens.forget()
                    held, size = [[], [], []], 0
        yield from counted()

    seen = (F.col("_fold") > CALIBRATION) & F.col("_label").isNotNull()
    side = F.when(seen & (F.col("_label") == 0), 0).when(seen & (F.col("_label") == 1), 1).otherwise(2)
    rows = docs.select(blank(text_col).alias("_text"), side.alias("_side"))
    parts = rows.mapInPandas(tidy(task), "h int, name string, ordinary long, toxic long, all long")
    return parts.groupBy("h", "name").agg(*(F.sum(c).alias(c) for c in (*CLASSES, "all")))


def digest(name: Column) -> list[Column]:
    """128 bits that stand for a name, as two numbers; the same as digests()."""
    return [F.xxhash64(name).alias("first"), F.xxhash64(name, name).alias("second")]


def digests(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    own = [x.encode() for x in names]
    first = [xxhash.xxh64_intdigest(x, 42) for x in own]
    second = map(xxhash.xxh64_intdigest, own, first)
    return np.array(first, np.uint64).view(np.int64), np.fromiter(second, np.uint64, len(own)).view(np.int64)


class Ratios:
    """Log ratios by the digest of a name and history, as sorted arrays; a column for each of several models."""

    def __init__(self, first: np.ndarray, second: np.ndarray, h: np.ndarray, ratio: np.ndarray) -> None:
        """Rows by first and second; a name and history are there once."""
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.start = np.append(np.flatnonzero(new), len(first)).astype(np.int32)
        self.first, self.second = first[new], second[new]
        self.h, self.ratio = h, ratio
        same = np.flatnonzero(self.first[1:] == self.first[:-1])
        #: How many names share a first half at most: one, but for chance.
        self.alike = 1 + (int(np.unique(self.first[same], return_counts=True)[1].max()) if len(same) else 0)

    def __len__(self) -> int:
        return len(self.first)

    def put(self, names: list[str], table: np.ndarray) -> None:
        """Writes the ratios of each name into its row of the table, by history."""
        if not len(self) or not names:
            return
        first, second = digests(names)
        lowest = np.searchsorted(self.first, first)
        for k in range(self.alike):
            at = np.minimum(lowest + k, len(self) - 1)
            row = np.flatnonzero((self.first[at] == first) & (self.second[at] == second))
            low, many = self.start[at[row]], self.start[at[row] + 1] - self.start[at[row]]
            entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            table[np.repeat(row, many), ..., self.h[entry]] = self.ratio[entry]

    def of(self, k: int) -> Ratios:
        """Those of one of several models."""
        own = copy(self)
        own.ratio = self.ratio[:, k].copy()
        return own


@dataclass
class ToxicityModel:
    """Log ratios of pairs by expression and by stem; by history, what others have; the threshold.

    Several models that differ in these alone may be one: `rest` then has a row for each, and the ratios a column.
    entries: (kind, h, name, ratio) in place of the two where they are too many to broadcast.
    """

    common: list[str]
    rest: np.ndarray
    words: Ratios | None = None
    stems: Ratios | None = None
    threshold: float = np.inf
    scale: float = 1.0
    entries: DataFrame | None = None
    sent: Broadcast | None = None

    def share(self, spark: SparkSession) -> Broadcast:
        """The model on the executors, sent once."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def drop(self) -> None:
        if self.sent is not None:
            self.sent.destroy()
            self.sent = None

    def table(self, names: list[str]) -> np.ndarray:
        """The ratios of each name, by model if there are several, and by history."""
        if self.words is None:
            return np.tile(self.rest, (len(names), *(1 for _ in self.rest.shape)))
        places = numbering()
        stem = np.fromiter(map(places.__getitem__, [x[:STEM] for x in names]), np.int64, len(names))
        of_stems = np.tile(self.rest, (len(places), *(1 for _ in self.rest.shape)))
        self.stems.put(list(places), of_stems)
        found = of_stems[stem]
        self.words.put(names, found)
        return found

    def ratios(self, expression: str) -> np.ndarray:
        """By history."""
        return self.table([expression])[0]

    def each(self) -> list[ToxicityModel]:
        """Several models, one by one."""
        return [ToxicityModel(self.common, rest, self.words.of(k), self.stems.of(k)) for k, rest in enumerate(self.rest)]


class Scorer:
    """Means of texts under a broadcast model, or under each of several; a worker's own."""

    def __init__(self, model: ToxicityModel) -> None:
        *several, wide = model.rest.shape
        held = HELD // (several or [1])[0]  # several models take no more memory than one
        self.model, self.tokens = model, Tokens(model.common, held)
        self.ratios, self.known = np.zeros((*several, held + LOOKED_UP, wide)), 0

    def __call__(self, texts: list[str | None]) -> list[float] | list[list[float]]:
        tokens, out = self.tokens, []
        held: list[tuple[np.ndarray, int]] = []
        for k, text in enumerate(texts, 1):
            held.append(tokens(text or ""))
            if k == len(texts) or tokens.full():
                out += self._means(held)
                held = []
                if tokens.full():
                    tokens.forget()
                    self.known = 0
        return out

    def _means(self, held: list[tuple[np.ndarray, int]]) -> list[float] | list[list[float]]:
        """Of texts that are read; expressions are looked up together."""
        names = self.tokens.names
        *several, size, wide = self.ratios.shape
        if len(names) > size:
            self.ratios = np.concatenate([self.ratios, np.zeros((*several, 2 * len(names), wide))], axis=-2)
        for at in range(self.known, len(names), LOOKED_UP):
            found = self.model.table(names[at : at + LOOKED_UP])
            self.ratios[..., at : at + len(found), :] = np.moveaxis(found, 0, -2)
        self.known = len(names)
        # an exact sum, so that no order of adding shows
        mean = lambda flat, pairs, length: fsum(flat[pairs].tolist()) / length**LENGTH if length else 0.0
        if not several:
            flat = self.ratios.ravel()
            return [mean(flat, *own) for own in held]
        return [[mean(flat, *own) for flat in self.ratios.reshape(several[0], -1)] for own in held]


def _bound(bins: list[tuple[int, float]], share: float) -> float:
    """The D whose growing discounts free the share of the mass of (pairs, count of each)."""
    pairs, n = (np.array(x, float) for x in zip(*bins, strict=True))
    freed = lambda d: float((-d * np.expm1(-n / d) * pairs).sum())
    want, low, high = share * float((pairs * n).sum()), 0.0, 1.0
    while freed(high) < want:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if freed(middle) < want else (low, middle)
    return high


def discounts(counts: DataFrame, shares: list[float], constant: bool) -> list[dict[str, float]]:
    """For each share, the D of each class whose discounts free it. Counts from 64 on go by sixteenths of a doubling."""
    classes = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in CLASSES))
    own = counts.select(F.explode(classes).alias("x")).select("x.c", "x.n").where("n > 0")
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(64 + F.floor(F.log2(F.col("n") / 64) * 16))
    bins = own.groupBy("c", step.alias("bin")).agg(F.count("*").alias("pairs"), F.sum("n").alias("mass")).orderBy("c", "bin").collect()
    out = []
    for share in shares:
        found = {}
        for c in CLASSES:
            rows = [r for r in bins if r["c"] == c]
            if not constant:
                found[c] = _bound([(r["pairs"], r["mass"] / r["pairs"]) for r in rows], share)
                continue
            total, below, above, found[c] = sum(r["mass"] for r in rows), 0, sum(r["pairs"] for r in rows), 0.0
            for r in rows:
                if below + above * r["mass"] / r["pairs"] >= share * total:
                    found[c] = (share * total - below) / above
                    break
                below, above = below + r["mass"], above - r["pairs"]
        out.append(found)
    return out


def _left(n: Column, bound: float, constant: bool) -> Column:
    """What the discount leaves of a count."""
    n = n.cast("double")
    return F.greatest(n - bound, F.lit(0.0)) if constant else n + bound * F.expm1(-n / bound)


def _by_history(values: dict[int, float], wide: int) -> Column:
    return F.element_at(F.array(*(F.lit(float(values.get(h, 0.0))) for h in range(wide))), F.col("h") + 1)


def fit_models(counts: DataFrame, common: list[str], constant: bool = True) -> list[ToxicityModel]:
    """A model without its threshold for each of MASSES, or else of GROWING, from the stored counts; none without both classes."""
    return [x for model in each_model(counts, common, constant) for x in (model.each() if model.rest.ndim > 1 else [model])]


def each_model(counts: DataFrame, common: list[str], constant: bool) -> Iterator[ToxicityModel]:
    """The models of fit_models(), one after the other, as each may be large; or as one, where all have the same entries."""
    shares = MASSES if constant else GROWING
    wide = len(common) + 1
    sums = [F.sum(c).cast("double").alias(c) for c in (*CLASSES, "all")]
    totals = {r["h"]: r for r in counts.groupBy("h").agg(*sums, F.count("*").alias("types")).collect()}
    if not all(any(r[c] for r in totals.values()) for c in CLASSES):
        return
    stem = F.substring("name", 1, STEM)
    stems = stored(counts.groupBy("h", stem.alias("name")).agg(*(F.sum(c).alias(c) for c in (*CLASSES, "all"))))
    found = list(zip(discounts(counts, [a for a, _ in shares], constant), discounts(stems, [b for _, b in shares], constant), strict=True))

    def freed(table: DataFrame, k: int) -> list[dict[str, dict[int, float]]]:
        """By model, class and history, the share of mass that discounts free; 1 where a class has no mass."""
        least = [F.sum(F.col(c) - _left(F.col(c), d[k][c], constant)).alias(f"{c}{i}") for i, d in enumerate(found) for c in CLASSES]
        rows = {r["h"]: r for r in table.groupBy("h").agg(*least).collect()}
        return [{c: {h: r[f"{c}{i}"] / totals[h][c] if totals[h][c] else 1.0 for h, r in rows.items()} for c in CLASSES} for i in range(len(found))]

    masses = list(zip(freed(counts, 0), freed(stems, 1), strict=True))
    types = sum(r["types"] for r in totals.values())

    def above(k: int, prefix: str, among: list) -> Column:
        """Where the discounts of a model among these leave something."""
        return F.expr(" or ".join(f"{prefix}{c} > {min(d[k][c] for d in among) if constant else 0.0!r}D" for c in CLASSES))

    follows = counts.groupBy("name").agg(F.count("*").alias("follows"))
    of_stem = stems.select("h", F.col("name").alias("stem"), *(F.col(c).alias(f"s_{c}") for c in (*CLASSES, "all")))
    words = counts.where(above(0, "", found)).withColumn("stem", stem).join(of_stem, ["h", "stem"]).join(follows, "name")
    n = _by_history({h: r["all"] for h, r in totals.items()}, wide)
    lower = F.greatest(F.col("follows") - SHARED_DISCOUNT, F.lit(0.0)) / types + F.lit(SHARED_DISCOUNT / types)
    spread = _by_history({h: r["types"] * SHARED_DISCOUNT for h, r in totals.items()}, wide)
    words = stored(words.withColumn("shared", (F.greatest(F.col("all") - SHARED_DISCOUNT, F.lit(0.0)) + spread * lower) / n))
    strong_stems = stored(stems.where(above(1, "", found)).select("h", "name", *(F.col(c).alias(f"s_{c}") for c in (*CLASSES, "all"))))

    rests, ratios = [], []
    for d, mass in zip(found, masses, strict=True):

        def of_stems(c: str, d=d, mass=mass) -> Column:
            """P_c(s | h) / P(s | h)."""
            own = F.try_divide(_left(F.col(f"s_{c}"), d[1][c], constant), _by_history({h: r[c] for h, r in totals.items()}, wide)) / (F.col("s_all") / n)
            return F.coalesce(own, F.lit(0.0)) + _by_history(mass[1][c], wide)

        def ratio(parts: dict[str, Column]) -> Column:
            return F.log(parts["toxic"]) - F.log(parts["ordinary"])

        backed = {c: _by_history(mass[0][c], wide) * of_stems(c) for c in CLASSES}
        mine = {c: F.try_divide(_left(F.col(c), d[0][c], constant), _by_history({h: r[c] for h, r in totals.items()}, wide)) for c in CLASSES}
        own = {c: F.coalesce(x / F.col("shared"), F.lit(0.0)) for c, x in mine.items()}
        ratios.append((ratio({c: own[c] + backed[c] for c in CLASSES}), ratio(backed)))
        level = {c: [mass[0][c].get(h, 1.0) * mass[1][c].get(h, 1.0) for h in range(wide)] for c in CLASSES}
        rests.append([log(t / o) for t, o in zip(level["toxic"], level["ordinary"], strict=True)])

    def entries(models: list[int]) -> DataFrame:
        """(kind, h, name, ratio, or ratio0, ratio1 ... of several) where the discounts of a model among these leave something."""
        among, names = [found[k] for k in models], [f"ratio{i}" for i in range(len(models))] if len(models) > 1 else ["ratio"]
        pairs, own = ([ratios[k][kind].alias(x) for k, x in zip(models, names, strict=True)] for kind in (0, 1))
        table = words.where(above(0, "", among)).select(F.lit(0).alias("kind"), "h", "name", *pairs)
        return table.unionByName(strong_stems.where(above(1, "s_", among)).select(F.lit(1).alias("kind"), "h", "name", *own))

    def few(table: DataFrame) -> bool:
        rows, chars = table.agg(F.count("*"), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
        return rows <= ENTRIES and chars <= NAME_CHARS

    def sent(table: DataFrame, rest: list) -> ToxicityModel:
        model = ToxicityModel(common, np.array(rest))
        for kind, name in enumerate(("words", "stems")):
            rows = table.where(F.col("kind") == kind).select(*digest(F.col("name")), F.col("h").cast("byte"), *(x for x in table.columns if x.startswith("ratio")))
            rows = rows.orderBy("first", "second").toArrow()
            ratio = np.empty((len(rows), rows.num_columns - 3))
            for k in range(ratio.shape[1]):
                ratio[:, k] = rows.column(3 + k)
            keys = [np.array(rows.column(k)) for k in range(3)]
            del rows
            setattr(model, name, Ratios(*keys, ratio if model.rest.ndim > 1 else ratio[:, 0]))
        pa.default_memory_pool().release_unused()
        return model

    every = [*range(len(found))]
    if not constant and few(entries(every)):  # growing discounts leave every pair, so the entries are the same
        yield sent(entries(every), rests)
        return
    for k in every:
        table = entries([k])
        if constant and few(table):
            yield sent(table, rests[k])
        else:
            yield ToxicityModel(common, np.array(rests[k]), entries=table)


def joined_means(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """(_uid, _mean) of every row of (_uid, _text), by a join with the model's entries.

    A pair travels once for each block of documents with the numbers of those that have it, so a common
    one makes no hot key; it comes back to the documents only where it or its stem has an entry.
    """
    common, rest, entries = model.common, model.rest, model.entries

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(common)
        names = ["h", "name", "stem", "uids", "size", "base"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.float64()]

        def made(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            where: dict[int, list[int]] = {}
            held, sizes, base = 0, [], []
            uids = batch.column("_uid").to_pylist()

            def flush(where=where) -> Iterator[pa.RecordBatch]:
                keys = list(where)
                for at in range(0, len(keys), 10_000):
                    part = keys[at : at + 10_000]
                    own = [tokens.names[k // tokens.wide] for k in part]
                    yield made([[k % tokens.wide for k in part], own, [x[:STEM] for x in own], [where[k] for k in part], [None] * len(part), [None] * len(part)])
                where.clear()

            for uid, text in zip(uids, batch.column("_text").to_pylist(), strict=True):
                pairs, length = tokens(text)
                sizes.append(length)
                base.append(fsum(rest[pairs % tokens.wide].tolist()))
                for k in pairs.tolist():
                    where.setdefault(k, []).append(uid)
                held += len(pairs)
                if held > HELD or tokens.full():
                    yield from flush()
                    tokens.forget()
                    held = 0
            yield from flush()
            nothing = [None] * len(uids)
            yield made([nothing, nothing, nothing, [[u] for u in uids], sizes, base])

    blocks = rows.select("_uid", "_text").mapInArrow(tidy(task), "h int, name string, stem string, uids array<long>, size long, base double")
    words = entries.where("kind = 0").select("h", "name", F.col("ratio").alias("_word"))
    stems = entries.where("kind = 1").select("h", F.col("name").alias("stem"), F.col("ratio").alias("_stem"))
    met = blocks.where("name is not null").join(words, ["h", "name"], "left").join(stems, ["h", "stem"], "left")
    more = F.coalesce("_word", "_stem") - _by_history(dict(enumerate(rest.tolist())), len(rest))
    met = met.select("uids", F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("base"), more.alias("more")).where("more is not null")
    every = blocks.where("name is null").select("uids", "size", "base", F.lit(None).cast("double").alias("more"))
    # sorted before they are added, so that reruns agree to the last bit
    own = met.unionByName(every).select(F.explode("uids").alias("_uid"), "size", "base", "more")
    own = own.groupBy("_uid").agg(F.max("size").alias("n"), F.max("base").alias("base"), F.sort_array(F.collect_list("more")).alias("r"))
    total = F.aggregate("r", F.col("base"), lambda a, x: a + x)
    return own.select("_uid", F.when(F.col("n") > 0, total / F.pow(F.col("n").cast("double"), F.lit(LENGTH))).otherwise(F.lit(0.0)).alias("_mean"))


def mean_ratios(docs: DataFrame, model: ToxicityModel, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and _mean of every row, an array of means under several models."""
    if model.entries is not None:
        rows = stored(docs.select(F.struct(*keep).alias("_row"), F.monotonically_increasing_id().alias("_uid"), blank(text_col).alias("_text")))
        return rows.select("_row", "_uid").join(joined_means(rows, model), "_uid").select("_row.*", "_mean")
    shared, several = model.share(docs.sparkSession), model.rest.ndim > 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            means = score(batch.column("_text").to_pylist())
            yield batch.drop_columns(["_text"]).append_column("_mean", pa.array(means, pa.list_(pa.float64()) if several else pa.float64()))

    rows = docs.select(*keep, blank(text_col).alias("_text"))
    schema = StructType([f for f in rows.schema if f.name != "_text"]).add("_mean", ArrayType(DoubleType()) if several else DoubleType())
    return rows.mapInArrow(tidy(task), schema)


def calibrate(model: ToxicityModel, histogram: pd.DataFrame) -> float:
    """Sets the threshold with the fewest errors, in the middle of the gap, and the scale of the scores; the errors.

    histogram: bin, label and rows of labelled rows that the counts have not seen.
    """
    table = histogram.pivot_table(index="bin", columns="label", values="rows", aggfunc="sum", fill_value=0).sort_index()
    if not {0, 1} <= {*table.columns}:
        return np.inf
    ordinary, toxic = table[0].to_numpy(), table[1].to_numpy()
    bins = table.index.to_numpy(float)
    errors = np.append(np.cumsum(toxic) - toxic, toxic.sum()) + np.append(ordinary[::-1].cumsum()[::-1], 0)
    k = int(np.flatnonzero(errors == errors.min())[-1])
    low, high = bins[max(k - 1, 0)], bins[k] if k < len(bins) else bins[-1] + 1
    model.threshold = (low + high) / 2 / BINS
    middle = np.repeat(bins, ordinary + toxic)
    model.scale = max(float(np.percentile(middle, 90) - np.percentile(middle, 10)) / BINS / 4, 1e-4)
    return float(errors.min())


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """The model of all documents' counts and the labels of rows that are not held out."""
    bound_batches(docs.sparkSession)
    common = common_words(docs, text_col)
    labelled = with_labels(docs.select(id_col, text_col), labels, label_col, id_col)
    unseen = stored(labelled.where((F.col("_fold") == CALIBRATION) & F.col("_label").isNotNull()).select(text_col, "_label"))
    best, least, rows = None, np.inf, F.count("*").alias("rows")
    for model in each_model(stored(count_pairs(labelled, text_col, common)), common, constant=False):
        means = mean_ratios(unseen, model, text_col, ["_label"])
        if model.rest.ndim == 1:
            means = means.withColumn("_mean", F.array("_mean"))
        means = means.select("_label", F.posexplode("_mean").alias("_model", "_mean"))
        bins = F.greatest(F.least(F.rint(F.col("_mean") * BINS), F.lit(1e3 * BINS)), F.lit(-1e3 * BINS)).cast("int")
        histogram = means.groupBy("_model", bins.alias("bin"), F.col("_label").alias("label")).agg(rows).toPandas()
        model.drop()
        for k, one in enumerate(model.each() if model.rest.ndim > 1 else [model]):
            errors = calibrate(one, histogram[histogram["_model"] == k])
            if best is None or errors < least:
                best, least = one, errors
    return best or ToxicityModel(common, np.zeros(len(common) + 1))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row; predicted is 1 from a score of 0.5 on."""
    scored = mean_ratios(docs, model, text_col, [id_col])
    if np.isfinite(model.threshold):
        score = 1 / (1 + F.exp((F.lit(model.threshold) - F.col("_mean")) / F.lit(model.scale)))
    else:
        score = F.lit(0.0)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    return scored.select(id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), score.cast("double").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def not_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with their own columns."""
    model = fit_toxicity(docs, labels, id_col, text_col)
    limit = model.threshold
    if model.entries is not None:
        rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
        return mean_ratios(rows, model, "_text", ["_row"]).where(F.col("_mean") < limit).select("_row.*")
    shared = model.share(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            means = score(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([not mean >= limit for mean in means], pa.bool_()))

    return docs.mapInArrow(tidy(task), docs.schema)
