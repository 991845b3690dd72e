"""SentencePiece encoding that keeps the source offsets of every piece, and decoding.

The model file's normaliser is read here: its compiled character map is a double-array trie over UTF-8
bytes whose values point into a block of replacements. At each place the longest prefix in the trie is
replaced, else one character is copied, and every normalised byte records the source byte it came from.
Ids come from the normalised text by the model's own merges: of all neighbours that make a piece together the
pair of the highest score is joined first, the leftmost of equals. No piece of the vocabulary spans the
place before a space mark or around an isolated character such as the line feed, so a text falls into words
there whose ids a worker remembers. The words that a block of texts lacks are merged side by side, those of equal
length as the rows of a matrix. Characters without a piece become byte pieces. Piece k covers a run of
normalised bytes, so its span in the source is read off the record. Models of another kind than BPE, or with
user-defined or unused pieces, take their ids from the library; the spans are found in the same way.

Defined cases: a null text is empty; an empty text has no ids and decodes to an empty text. Rows that
repeat an id are coded one by one. Texts of any length are coded whole. If pieces should not cover the normalised
text, the row's spans are null.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import blank, bound_batches, tidy

#: U+2581, which stands for a space in pieces, and the replacement for bytes that are not UTF-8.
SPACE_MARK, BAD = "▁".encode(), "�".encode()
#: Types of pieces in the model file.
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6
#: The model type that merges pairs.
BPE = 2
#: Words in each of the two generations that a worker remembers; characters from which on a word's merges go through a heap.
HELD, LONG = 100_000, 100
#: Characters of texts that are coded together; words of a length from which on they are merged side by side, and at most.
BLOCK, SIDE, WIDE = 1 << 20, 24, 1 << 14
#: No merge, as a rank.
NONE = np.iinfo(np.int32).max
NEVER = float("-inf")


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    """A byte that is not UTF-8 decodes on its own to the replacement character."""
    return "\ufffd", error.start + 1


codecs.register_error("meshwright_one_byte", _one_byte)


def _fields(blob: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a serialized message; varints and fixed 32-bit values as integers."""
    at, end = 0, len(blob)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, blob[at : at + n]
            at += n
        else:
            n = {5: 4, 1: 8}[key & 7]
            yield key >> 3, int.from_bytes(blob[at : at + n], "little")
            at += n


class CharMap:
    """A compiled character map: longest-prefix lookups in its double-array trie."""

    def __init__(self, blob: bytes) -> None:
        self.units: list[int] = []
        self.replacements = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{n // 4}I", blob, 4))
            self.replacements = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest prefix of text[at:] in the map and its replacement; length 0 for none."""
        units, best = self.units, (0, b"")
        if not units:
            return best
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(text)):
            c = text[k]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                where = units[node] & 0x7FFFFFFF
                best = (k + 1 - at, self.replacements[where : self.replacements.index(b"\0", where)])
        return best


class Normalizer:
    """The normaliser of a model: text to normalised bytes, each with the source byte it came from."""

    def __init__(self, spec: bytes, user_pieces: tuple[bytes, ...] = ()) -> None:
        given = dict(_fields(spec))
        self.map = CharMap(given.get(2, b""))
        self.add_prefix, self.trim, self.escape = (bool(given.get(k, 1)) for k in (3, 4, 5))
        self.user_pieces = sorted(user_pieces, key=len, reverse=True)

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes that the next step takes and what they become."""
        for piece in self.user_pieces:
            if raw.startswith(piece, at):
                return len(piece), piece
        n, to = self.map.longest(raw, at)
        if n:
            return n, to
        b = raw[at]
        n = 1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 0
        try:
            raw[at : at + n].decode()
        except UnicodeDecodeError:
            n = 0
        return (n, raw[at : at + n]) if n else (1, BAD)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes; for each of them, and for the end, its offset in the source's UTF-8."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return b"", np.zeros(1, np.int64)
        space = SPACE_MARK if self.escape else b" "
        if not self.map.units and not self.trim and not self.user_pieces:
            return self._plain(raw, space)
        out, origin, at = bytearray(), [], 0
        if self.trim:
            while at < len(raw):
                n, to = self._step(raw, at)
                if to != b" ":
                    break
                at += n
            if at == len(raw):
                return b"", np.zeros(1, np.int64)
        if self.add_prefix:
            out += space
            origin += [at] * len(space)
        after_space = self.trim
        while at < len(raw):
            n, to = self._step(raw, at)
            while after_space and to.startswith(b" "):
                to = to[1:]
            if to:
                for c in to:
                    piece = space if c == 32 else bytes((c,))
                    out += piece
                    origin += [at] * len(piece)
                after_space = self.trim and to.endswith(b" ")
            elif not self.trim:
                after_space = False
            at += n
        end = len(raw)
        if self.trim:
            while out.endswith(space):
                end = origin[-1]
                del out[-len(space) :]
                del origin[-len(space) :]
        return bytes(out), np.array([*origin, end], np.int64)

    def _plain(self, raw: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        """The same without a character map: only spaces change."""
        bytes_ = np.frombuffer(raw, np.uint8)
        width = np.where(bytes_ == 32, len(space), 1)
        origin = np.repeat(np.arange(len(raw), dtype=np.int64), width)
        out = raw.replace(b" ", space)
        if self.add_prefix:
            out = space + out
            origin = np.concatenate([np.zeros(len(space), np.int64), origin])
        return out, np.append(origin, len(raw))


class Merges:
    """Ids of normalised text by the merges of a BPE model; a worker's own, as it remembers words."""

    def __init__(self, pieces: list[tuple[bytes, float, int]]) -> None:
        self.ids = {p.decode(): i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.scores = {p.decode(): score for p, score, kind in pieces if kind == 1}
        self.of_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.many = len(pieces)
        self.forget()
        self._tabulate()
        mark = SPACE_MARK.decode()
        #: No piece goes on with a space mark after another character; none of several characters has a line feed.
        self.by_mark = not any(mark in p.lstrip(mark) for p in self.ids)
        line = "\n" if not any("\n" in p and len(p) > 1 for p in self.ids) else ""
        ways = [f"{mark}*[^{mark}{line}]+", f"{mark}+", *([line] if line else [])]
        self.word = re.compile("|".join(ways) if self.by_mark else "(?s:.+)")

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _tabulate(self) -> None:
        """Ids of characters, and of the pairs of pieces that make a piece, as sorted arrays."""
        single = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        #: By code point; -1 for characters without a piece, which have the last place if they are beyond all others.
        self.of_char = np.full(max(single, default=0) + 2, -1, np.int32)
        self.of_char[[*single]] = [*single.values()]
        order = {score: k for k, score in enumerate(sorted({*self.scores.values()}, reverse=True))}
        pairs = [
            (a * self.many + b, order[self.scores[p]], i)
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair, self.rank, self.both = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of neighbours, the rank of their merge, low ones first, and the id that it makes."""
        key = left.astype(np.int64) * self.many + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NONE), self.both[at]

    def _join_side_by_side(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) for the rows of a matrix of the characters' ids; every round merges one pair in each."""
        row = np.arange(len(own))
        rank, both = self._pairs(own[:, :-1], own[:, 1:])
        while len(row):
            n = own.shape[1]
            if n == 1:
                yield row, own
                return
            at = rank.argmin(1)  # the leftmost of equals
            k = np.arange(len(row))
            done = rank[k, at] == NONE
            if done.any():
                yield row[done], own[done]
                open_ = ~done
                row, own, rank, both, at = row[open_], own[open_], rank[open_], both[open_], at[open_]
                k = k[: len(row)]
            own[k, at] = both[k, at]
            stay = np.arange(n) != at[:, None] + 1
            own = own[stay].reshape(len(row), n - 1)
            stay = np.arange(n - 1) != at[:, None]
            rank, both = rank[stay].reshape(len(row), n - 2), both[stay].reshape(len(row), n - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            rank[before, at[before] - 1], both[before, at[before] - 1] = self._pairs(own[before, at[before] - 1], own[before, at[before]])
            rank[after, at[after]], both[after, at[after]] = self._pairs(own[after, at[after]], own[after, at[after] + 1])

    def _join(self, word: str) -> list[str]:
        """The pieces of a word."""
        score, n = self.scores.get, len(word)
        if n > LONG:
            return self._join_long(list(word))
        parts = list(word)
        found = [score(word[i : i + 2], NEVER) for i in range(n - 1)]
        while found and (best := max(found)) != NEVER:
            k = found.index(best)
            parts[k] = both = parts[k] + parts.pop(k + 1)
            del found[k]
            if k:
                found[k - 1] = score(parts[k - 1] + both, NEVER)
            if k < len(found):
                found[k] = score(both + parts[k + 1], NEVER)
        return parts

    def _join_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of candidates; those whose ends have changed meanwhile are passed over."""
        score, n = self.scores.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (s := score(both := parts[i] + parts[j], NEVER)) != NEVER:
                heapq.heappush(heap, (-s, i, both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not parts[i] or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [x for x in parts if x]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, of which those that are not too long are remembered."""
        found: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            own = self.old.get(w)
            if own is not None:
                found[w] = own
            else:
                by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            if len(group) >= SIDE and n <= LONG and len(self.pair):
                for at in range(0, len(group), WIDE):
                    self._learn_side_by_side(group[at : at + WIDE], n, found)
            else:
                found.update((w, self._ids_of(w)) for w in group)
        self.known.update((w, own) for w, own in found.items() if len(w) <= LONG)
        return found

    def _learn_side_by_side(self, words: list[str], n: int, found: dict[str, bytes]) -> None:
        """Adds the ids of words of n characters each."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n)
        own = self.of_char[np.minimum(chars, len(self.of_char) - 1)]
        plain = (own >= 0).all(1)
        found.update((words[k], self._ids_of(words[k])) for k in np.flatnonzero(~plain).tolist())
        at = np.flatnonzero(plain)
        for rows, ids in self._join_side_by_side(own[at]):
            raw, wide = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
            for j, k in enumerate(at[rows].tolist()):
                found[words[k]] = raw[j * wide : (j + 1) * wide]

    def _ids_of(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in self._join(word):
            found = self.ids.get(piece)
            if found is not None:
                ids.append(found)
            elif self.of_byte:
                ids += [self.of_byte[c] for c in piece.encode()]
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, normals: list[str]) -> list[bytes]:
        """Ids of normalised texts, as little-endian unsigned 32-bit integers."""
        if len(self.known) > HELD:
            self.old, self.known = self.known, {}
        known, texts = self.known, [self.word.findall(x) for x in normals]
        new = {w for words in texts for w in words if w not in known}
        if new:
            found = self._learn([*new])
            if any(len(w) > LONG for w in found):
                known = known | found
        return [b"".join(map(known.__getitem__, words)) for words in texts]


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        pieces, normalizer, kind = [], b"", 0
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", struct.pack("<I", own.get(2, 0)))[0]
                pieces.append((own.get(1, b""), score, own.get(3, 1)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                normalizer = value
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(normalizer, tuple(p for p, _, kind in pieces if kind == USER_DEFINED))
        self.merges = Merges(pieces) if kind == BPE and not {k for _, _, k in pieces} & {USER_DEFINED, UNUSED} else None
        #: Normalised bytes of each piece: a byte piece covers one, the unknown piece what is left over.
        self.widths = np.array([1 if kind == BYTE else 0 if kind in (UNKNOWN, CONTROL) else len(p) for p, _, kind in pieces], np.int64)
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), -1)
        self.surfaces = [p for p, _, _ in pieces]
        #: What each piece decodes to.
        shown = {UNKNOWN: lambda p: " \u2047 ".encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes((int(p[3:5], 16),))}
        self.texts = [shown.get(kind, lambda p: p.replace(SPACE_MARK, b" "))(p) for p, _, kind in pieces]
        self.marked = [kind not in (UNKNOWN, CONTROL, BYTE) and p.startswith(SPACE_MARK) for p, _, kind in pieces]
        self.controls = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.decimal = [str(i) for i in range(len(pieces))]

    def each(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
        """Of each text the ids, the normalised bytes, and the source offset of each and of the end."""
        block, size = [], 0
        for k, text in enumerate(texts, 1):
            block.append(text)
            size += len(text)
            if size >= BLOCK or k == len(texts):
                yield from self._coded(block)
                block, size = [], 0

    def coded(self, text: str) -> tuple[np.ndarray, bytes, np.ndarray]:
        """The same of one text."""
        return next(self.each([text]))

    def _coded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
        if self.merges is None:
            for text in texts:
                yield np.array(self.library.encode(text, add_bos=False, add_eos=False, enable_sampling=False), np.int64), *self.normalize(text)
            return
        normal = [self.normalize(text) for text in texts]
        for raw, own in zip(self.merges([x.decode() for x, _ in normal]), normal, strict=True):
            yield np.frombuffer(raw, "<u4").astype(np.int64), *own

    def forget(self) -> None:
        """The words that were remembered are forgotten; the model's tables stay."""
        if self.merges:
            self.merges.forget()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids without begin or end ids, no sampling."""
        return [ids.tolist() for ids, _, _ in self.each(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The space mark that normalising puts before a text is taken off again."""
        silent = [] if self.controls.isdisjoint(ids) else [k for k, i in enumerate(ids) if i in self.controls]
        if silent:  # control ids part the bytes of a character
            runs = [ids[a + 1 : b] for a, b in zip([-1, *silent], [*silent, len(ids)], strict=True)]
        else:
            runs = [ids]
        out = [b"".join(map(self.texts.__getitem__, run)).decode("utf-8", "meshwright_one_byte") for run in runs]
        first = next((k for k, run in enumerate(runs) if run), None)
        if first is not None and self.marked[runs[first][0]] and (self.normalize.add_prefix or self.normalize.trim):
            out[first] = out[first][1:]
        return "".join(out)

    def spans(self, text: str, ids: list[int]) -> np.ndarray | None:
        """(begin, end) of every piece in the text's UTF-8 bytes, one row an id; None if they do not cover it.

        A piece that covers only inserted bytes, such as the leading space mark, has an empty span; the
        byte pieces of one character each have the span of their own byte.
        """
        return self.projected(np.asarray(ids, np.int64), *self.normalize(text))

    def projected(self, ids: np.ndarray, normal: bytes, origin: np.ndarray) -> np.ndarray | None:
        """spans() of a text that is normalised already."""
        width = self.widths[ids]
        if (ids == self.unknown).any():
            width = self._with_unknown(normal, ids, width)
        ends = np.cumsum(width)
        if (int(ends[-1]) if len(ends) else 0) != len(normal):
            return None
        return np.stack([origin[ends - width], origin[ends]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)

    def _with_unknown(self, normal: bytes, ids: np.ndarray, width: np.ndarray) -> np.ndarray:
        """An unknown piece reaches to where the next known piece begins."""
        width, at = width.copy(), 0
        for k, i in enumerate(ids.tolist()):
            if i == self.unknown:
                follows = next((j for j in ids[k + 1 :].tolist() if j != self.unknown), None)
                stop = len(normal) if follows is None else normal.index(self.surfaces[follows], at + 1)
                width[k] = stop - at if k + 1 == len(ids) or ids[k + 1] != self.unknown else len(normal[at:].decode()[0].encode())
            at += int(width[k])
        return width


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's own codec of a model file, read once."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array, spans: array of (begin, end) in UTF-8 bytes, decoded) for every row."""

    bound_batches(docs.sparkSession)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for frame in frames:
            out = []
            for doc, (ids, normal, origin) in zip(frame["_id"], own.each(frame["_text"].tolist()), strict=True):
                spans = own.projected(ids, normal, origin)
                out.append((doc, ids.tolist(), None if spans is None else [(int(x), int(y)) for x, y in spans], own.decode(ids.tolist())))
            yield pd.DataFrame(out, columns=["_id", "ids", "spans", "decoded"])
        own.forget()

    rows = docs.select(F.col(id_col).alias("_id"), blank(text_col).alias("_text"))
    kind = dict(docs.dtypes)[id_col]
    coded = rows.mapInPandas(tidy(task), f"_id {kind}, ids array<int>, spans array<struct<begin:long, end:long>>, decoded string")
    return coded.withColumnRenamed("_id", id_col)


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, span_bytes) for every row; also ids, if asked for.

    span_bytes: source bytes in the spans of the pieces, which is all of them if nothing was lost; null if they
    do not cover the text.
    ids: little-endian unsigned 32-bit integers.
    """

    bound_batches(docs.sparkSession)
    columns = ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", *(["ids"] if with_ids else [])]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)

        def sha(text: str) -> str:
            return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

        for frame in frames:
            out = []
            for doc, (ids, normal, origin) in zip(frame["_id"].tolist(), own.each(frame["_text"].tolist()), strict=True):
                spans = own.projected(ids, normal, origin)
                covered = None if spans is None else str(int((spans[:, 1] - spans[:, 0]).sum()))
                raw, each = (ids.astype(np.uint32).tobytes(),) if with_ids else (), ids.tolist()
                out.append((doc, len(ids), sha(",".join(map(own.decimal.__getitem__, each))), sha(own.decode(each)), covered, *raw))
            yield pd.DataFrame(out, columns=columns)
        own.forget()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), blank(text_col).alias("_text"))
    coded = rows.mapInPandas(tidy(task), "_id string, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes string" + ", ids binary" * with_ids)
    kind = dict(docs.dtypes)[id_col]
    return coded.withColumn("span_bytes", F.col("span_bytes").cast("long")).select(F.when(F.col("_id") != "", F.col("_id")).cast(kind).alias(id_col), *columns[1:])
