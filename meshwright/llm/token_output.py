"""Token-id output: texts to ids to files of the format of rans.py, and back.

Rows are dealt by ranges of the id and sorted there, so files hold documents in ascending order and no
task sees more than its range. A task tokenises its rows, cuts a file whenever enough ids are together,
writes it under a name of its own attempt to the shared folder and returns a manifest row. Only files in
the manifest count, so tasks that are repeated or run twice leave no trace in the result.

Defined cases: a null text is an empty one and has the end id only. Rows without id come first, as the
least id there is. Rows that repeat an id follow each other, by text hash. Ids beyond a file's token
target never split a document. An empty table makes no files.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm import rans
from meshwright.llm.common import blank, cut, on_small, scratch

#: Ids after which a file is closed.
FILE_TOKENS = 4 << 20
#: Distinct words in a generation of what a worker remembers.
CACHE_WORDS = 400_000
#: Documents that are tokenised together.
DOCS = 128
NO_ID = -(1 << 63)
ID = attrgetter("id")


#: How byte-level tokenizers write bytes as letters: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _bare(word: str) -> bool:
    """Whether a word is lower-case Latin letters alone."""
    return word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0250")


class Young(dict):
    """A dictionary that asks for what it lacks."""

    def __init__(self, ask: Callable[[str], bytes]) -> None:
        super().__init__()
        self.ask = ask

    def __missing__(self, key: str) -> bytes:
        return self.ask(key)


class Remembered:
    """A dictionary of bounded size that forgets what has not been asked for in two generations."""

    def __init__(self, size: int, ask: Callable[[str], bytes]) -> None:
        """ask: gives what the young generation lacks; it sees to it that this is remembered."""
        self.size, self.ask = size, ask
        self.young, self.old = Young(ask), {}

    def turn(self) -> Young:
        """Begins a generation if the young one is full; the young one."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, Young(self.ask)
        return self.young


#: Signs that the pre-tokenizer parts from the letter or digit before them, whatever follows: all of ASCII but the
#: apostrophe, which begins contractions, and the bracket that begins special tokens.
END_SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: A stop or comma at a word's end that follows another sign, with which it may be one token.
SIGN_RUN = re.compile(r"[.,](?= )(?<=[^\w \n][.,]|_[.,])")


def plain_words(text: str) -> list[str]:
    """Words whose ids in order are the text's: in lower case, with stops and commas as words of their own.

    The normaliser lowers case letter by letter and the pre-tokenizer splits a sign from the letter or digit
    before it, so both keep the ids. Texts where they might not (letters whose lower case depends on more,
    what may be a special token, runs of signs) are left as they are, and only split at spaces.
    """
    if not ("<" in text or "\u0130" in text or "\u03a3" in text):
        text = text.lower().replace("\n", " ")
        if not SIGN_RUN.search(text):
            return text.replace(". ", " . ").replace(", ", " , ").split(" ")
    return text.replace("\n", " ").split(" ")


class WordEncoder:
    """Whole text to little-endian 32-bit ids, for tokenizers no token of which spans white space.

    The tokenizer's pre-tokenizer drops white space and splits there, so a text's ids are those of its
    words one after the other. A worker remembers words; new ones go through the library many at a time,
    in lines with a mark between them that is one token and that no other word gives.
    """

    MARK, LINE = "\x01", 400

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        ids = self._ids(self.MARK)
        self.mark = ids[0] if len(ids) == 1 else None
        self.words = Remembered(CACHE_WORDS, self._learn)
        #: Words that a text waits for, to go through the library together.
        self.waiting: list[str] = []
        #: Whether the model alone gives the ids of a lower-case word of Latin letters,
        self.bare = all(self._ids(w) == self._model_ids(w).tolist() for w in ("a", "the", "tokenizer", "xqzjkvw", "éèü", "größeçñ", "æœøłž"))
        #: and whether signs after it add theirs.
        self.ends = self.bare and all(self._ids(w + e) == [*self._model_ids(w), *self._ids(e)] for w in ("the", "größe", "xqzjkvw") for e in ("***", "!!", ",$$$", ".", "###", '?!."'))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model_ids(self, word: str) -> array:
        """Of one word, past the normaliser and the pre-tokenizer, which leave such words whole."""
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", map(ID, self.tokenize(raw)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, out, late = self.words.turn(), [], []
        for k, text in enumerate(texts):
            words, before = plain_words(text), len(self.waiting)
            out.append(b"".join(map(known.__getitem__, words)))
            if len(self.waiting) > before:
                late.append((k, words))
        if late:
            self._learn_all(list(dict.fromkeys(self.waiting)))
            self.waiting.clear()
        for k, words in late:
            out[k] = b"".join(map(known.__getitem__, words))
        return out

    def _learn(self, word: str) -> bytes:
        """A word's ids, remembered; of one that must go through the library, none for now."""
        ids = self.words.old.get(word)
        if ids is None and self.bare and _bare(word):
            ids = self._model_ids(word).tobytes()
        if ids is None and self.ends:
            core = word.rstrip(END_SIGNS)
            if core != word and _bare(core):
                end = word[len(core) :]
                ids = self.words.young[core] + self._end(end)
        if ids is None:
            self.waiting.append(word)
            return b""
        self.words.young[word] = ids
        return ids

    def _end(self, signs: str) -> bytes:
        """The ids of a run of signs."""
        key = " " + signs  # no word has a space
        ids = self.words.young.get(key)
        if ids is None:
            ids = self.words.young[key] = array("I", self._ids(signs)).tobytes()
        return ids

    def _learn_all(self, new: list[str]) -> None:
        known, lines, line = self.words.young, [], []
        for w in new:
            if not w or self.mark is None or self.MARK in w or "<" in w:
                known[w] = np.array(self._ids(w), np.uint32).tobytes()
            else:
                line.append(w)
                if len(line) == self.LINE:
                    lines.append(line)
                    line = []
        if line:
            lines.append(line)
        coded = self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(own) for own in lines], add_special_tokens=False)
        for own, code in zip(lines, coded, strict=True):
            ids = np.array(code.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            raw, begins, stops = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            known.update(zip(own, (raw[a:b] for a, b in zip(begins, stops, strict=True)), strict=True))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's own encoder of a tokenizer file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def location(folder: str) -> str:
    """A folder as a URI: a plain path is a local file's, and `file:/x` is the same as `file:///x`."""
    scheme, colon, path = folder.partition(":")
    if not colon or "/" in scheme:
        return f"file://{folder}"
    return folder if path.startswith("//") else f"{scheme}://{path}"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; the manifest: (part, seq, path, documents, tokens, bytes), in that order of ids."""
    spark = docs.sparkSession

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(location(folder))
        encode, part, seq = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.uint32(end_id).tobytes()
        ids, blobs, size = [], [], 0

        def close() -> pd.DataFrame:
            nonlocal ids, blobs, size, seq
            blob = rans.encode(np.array(ids, np.int64), np.array([len(b) // 4 for b in blobs], np.uint32), np.frombuffer(b"".join(blobs), np.uint32))
            path = f"{root}/part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.rans"
            with store.open_output_stream(path) as out:
                out.write(blob)
            row = pd.DataFrame({"part": [part], "seq": [seq], "path": [path], "documents": [len(ids)], "tokens": [size // 4], "bytes": [len(blob)]})
            ids, blobs, size, seq = [], [], 0, seq + 1
            return row

        for frame in frames:
            docs, texts = frame["_id"].tolist(), frame["_text"].tolist()
            for at in range(0, len(docs), DOCS):
                for doc, blob in zip(docs[at : at + DOCS], encode(texts[at : at + DOCS]), strict=True):
                    blobs.append(blob + end)
                    ids.append(doc)
                    size += len(blobs[-1])
                    if size >= 4 * file_tokens:
                        yield close()
        if ids:
            yield close()

    store, root = fs.FileSystem.from_uri(location(folder))
    store.create_dir(root)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), blank(text_col).alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text")]  # ids that many rows share, or that are missing, still part by text
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(rows.mapInPandas(task, "part int, seq int, path string, documents long, tokens long, bytes long"))


def from_files(manifest: DataFrame, folder: str, rows: Callable[[rans.Reader], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What `rows` makes of each file of the manifest, with the file's part and seq."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(location(folder))
        for frame in frames:
            for part, seq, path in zip(frame["part"], frame["seq"], frame["path"], strict=True):
                with store.open_input_stream(path) as source:
                    reader = rans.Reader(source.read())
                for found in rows(reader):
                    yield found.assign(part=part, seq=seq)

    spread = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    files = manifest.select("part", "seq", "path").repartition(spread)  # a number given is a number kept
    return files.mapInPandas(task, f"{schema}, part int, seq int")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(_id, ids: binary of little-endian 32-bit, part, seq) of every document in the files."""

    def rows(reader: rans.Reader) -> Iterator[pd.DataFrame]:
        own = []
        for doc, ids in reader.documents():
            own.append((doc, ids.tobytes()))
            if len(own) >= 500:
                yield pd.DataFrame(own, columns=["_id", "ids"])
                own = []
        yield pd.DataFrame(own, columns=["_id", "ids"])

    return from_files(manifest, folder, rows, "_id long, ids binary")


def read_blocks(manifest: DataFrame, folder: str) -> DataFrame:
    """(part, seq, block, first, ids: binary of little-endian 32-bit): the ids of every block of the files, decoded on its own.

    first: the block's first id among the file's. A task fetches a file's header and its block's bytes, so a large file is
    decoded by as many tasks as it has blocks.
    """
    size = rans.LANES * rans.STEPS
    blocks = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / size).cast("int") - 1, F.lit(0)))).alias("block")
    count = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("tokens") / size)), F.lit(0))).first()[0]
    spread = max(1, min(int(count), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    each = manifest.select("part", "seq", "path", "bytes", blocks).repartition(spread)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(location(folder))
        for frame in frames:
            for part, seq, path, length, block in frame[["part", "seq", "path", "bytes", "block"]].itertuples(index=False, name=None):
                with store.open_input_file(path) as source:
                    reader = rans.Reader(lambda a, b, f=source: f.read_at(b - a, a), length)
                    ids = reader.block(block).tobytes() if len(reader.offsets) else b""
                yield pd.DataFrame({"part": [part], "seq": [seq], "block": [block], "first": [block * size], "ids": [ids]})

    return each.mapInPandas(task, "part int, seq int, block int, first long, ids binary")


def file_starts(manifest: DataFrame) -> DataFrame:
    """(part, seq, start): the ids in all files before. One row a task is all that meets in one window."""
    within = Window.partitionBy("part").orderBy("seq")
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    files = manifest.withColumn("_own", F.sum("tokens").over(within) - F.col("tokens"))
    return files.join(parts, "part").select("part", "seq", (F.col("_own") + F.col("_before")).alias("start"))


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents and reads them back: (id, start, n_tokens, ids_crc32), all from the files."""
    spark: SparkSession = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    manifest = write_tokens(docs, tokenizer, end_id, folder, id_col=id_col, text_col=text_col)

    def summed(reader: rans.Reader) -> Iterator[pd.DataFrame]:
        crcs = [zlib.crc32(ids.tobytes()) for _, ids in reader.documents()]
        n = reader.lengths.astype(np.int64)
        yield pd.DataFrame({"_id": reader.doc_ids, "at": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array(crcs, np.int64)})

    read = from_files(manifest, folder, summed, "_id long, at long, n_tokens long, ids_crc32 long")
    starts = cut(file_starts(manifest))
    return read.join(on_small(starts, starts.count()), ["part", "seq"]).select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col), (F.col("at") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )
