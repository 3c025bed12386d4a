"""Token ids as Arrow files of equal-length sequences.

Documents in ascending order of their ids, each followed by an end id, make one stream.
It is cut by ranges of ids into parts; a part is one Arrow IPC file whose rows are
sequences of ``LENGTH`` ids (fixed-size list of unsigned 16 or 32-bit integers) with a mask
of which are real, so row ``k`` of a mapped file is at a known place and read without a
copy.  Only the last row of a part is padded.  Beside it stands an index file: document,
first id within the part, ids.  A part is written under a name of its own attempt, and the
table of parts lists the files of the attempts that counted, so a repeated task does no
harm.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from edgeframe.llm.bpe import few_collections
from edgeframe.llm.common import free_name, small_batches, with_row_id
from edgeframe.session import written, written_path

LENGTH = 2048
ROWS = 256              # sequences of one record batch
PART_BYTES = 64 << 20   # of text in one part
END = 1
MEMO_BYTES = 64 << 20   # of words and their ids in one of two generations
ENTRY = 140             # bytes of an entry besides its characters and ids
KEY = 40                # characters of the longest word that is remembered
BLOCK = 4 << 20         # characters of texts that are cut at once
TOGETHER = 1000         # new runs that go to the library as one text
# How the vocabulary's file cuts a word into pieces, in either case.
PIECES = r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# The same classes for bytes of UTF-8.  Those from 128 on are told by their letter, if at all.
SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
KINDS = bytes(OTHER if c > 127 else SPACE if c == 32 or 9 <= c <= 13 else
              LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SYMBOL
              for c in range(256))


@functools.lru_cache(maxsize=1)
def wide_kinds() -> np.ndarray:
    """Classes of letters of two and three bytes: ``LETTER`` or ``SYMBOL`` where the letter is
    not changed by normalisation, whatever stands beside it, and else ``OTHER``."""
    composed = (unicodedata.decomposition(chr(c)).split() for c in range(1 << 16))
    joins = {int(d[1], 16) for d in composed if len(d) == 2 and d[0][0] != "<"}
    kinds = np.full(1 << 16, OTHER, np.uint8)
    for c in range(128, 1 << 16):
        kind = {"L": LETTER, "P": SYMBOL, "S": SYMBOL}.get(unicodedata.category(chr(c))[0])
        if (kind and c not in joins and unicodedata.is_normalized("NFC", chr(c))
                and c != 0x130 and not 0x1100 <= c < 0x1200):       # as in ``plain``; Hangul
            kinds[c] = kind
    return kinds


def blank_separated(text: str) -> list[str]:
    """Words between Unicode white space.  ``str.split`` also cuts at four control
    characters that the pattern of the vocabulary counts as symbols."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in _blank.split(text) if w]
    return text.split()


_blank = regex.compile(r"\s+")


class Texts:
    """Texts to arrays of ids with the tokenizers library.

    Pieces of this vocabulary never hold white space, and words fall into runs of letters,
    digits and marks that are encoded each for itself, so only runs that are new go
    to the library.  Words of most letters are cut as arrays of bytes; a word with any
    other, as a combining one, is looked up whole and cut only when it is new.  Words that
    normalisation would change across runs, and words with a special string, go to the
    library whole.  Ids are remembered in two generations of bounded size.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # the task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.type = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.type).char
        self.pieces = regex.compile(PIECES).findall
        suffix = self.library.model.end_of_word_suffix
        vocabulary = self.library.get_vocab()
        self.ends_run = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_run[[i for token, i in vocabulary.items()
                       if suffix and token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def cut(self, text: str) -> list[str]:
        """Runs of a text, and words that are to stay whole."""
        if plain(text):
            return self.pieces(text)
        return [p for w in blank_separated(text)
                for p in (self.pieces(w) if plain(w) else (w,))]

    def remember(self, words: Iterable[str], ids: Iterable[bytes]) -> None:
        for word, data in zip(words, ids):
            if len(word) <= KEY:
                self.size += ENTRY + len(word) + len(data)
                if self.size > MEMO_BYTES:
                    self.older, self.known, self.size = self.known, {}, 0
                self.known[word] = data

    def singly(self, texts: list[str]) -> list[bytes]:
        """Ids of each text from the library."""
        return [array(self.code, e.ids).tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, runs: list[str]) -> list[bytes]:
        """Ids of each of some runs from the library, which takes many of them as one text:
        the last id of a run, and no other, stands for a token that ends a run."""
        out: list[bytes] = []
        groups = [runs[at:at + TOGETHER] for at in range(0, len(runs), TOGETHER)]
        joined = self.library.encode_batch_fast([" ".join(g) for g in groups],
                                                add_special_tokens=False)
        for group, e in zip(groups, joined):
            ids = np.array(e.ids, self.type)
            ends = np.flatnonzero(self.ends_run[ids]) + 1
            if len(ends) != len(group):     # a vocabulary that does not mark the ends
                out += self.singly(group)
                continue
            data, to = ids.tobytes(), (ends * ids.itemsize).tolist()
            out += [data[i:j] for i, j in zip([0, *to], to)]
        return out

    def fresh(self, words: list[str], run: list[bool]) -> list[bytes]:
        """Ids of words that are not remembered; ``run`` tells those that are one run."""
        runs, whole, cut = [], [], {}
        for w, one in zip(words, run):
            if one:
                runs.append(w)
            elif (parts := self.cut(w)) == [w]:
                whole.append(w)
            else:
                cut[w] = parts
        found = dict(zip(runs, self.together(runs)))
        found |= zip(whole, self.singly(whole))
        if cut:
            get = self.ids_of(cut.values()).__getitem__
            found |= {w: b"".join(map(get, ps)) for w, ps in cut.items()}
        return [found[w] for w in words]

    def learn(self, words: list[str], run: list[bool]) -> list[bytes]:
        """Ids of each of different words; ``run`` tells those that are one run."""
        out = list(map(self.known.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        if self.older:
            old = [k for k in new if words[k] in self.older]
            for k in old:
                out[k] = self.older[words[k]]
            self.remember([words[k] for k in old], [out[k] for k in old])
            new = [k for k in new if out[k] is None]
        unknown = [words[k] for k in new]
        found = self.fresh(unknown, [run[k] for k in new])
        for k, ids in zip(new, found):
            out[k] = ids
        self.remember(unknown, found)
        return out

    def ids_of(self, cut: Iterable[list[str]]) -> dict[str, bytes]:
        """Ids of every part of texts that were cut."""
        parts = list({p for ps in cut for p in ps})
        return dict(zip(parts, self.learn(parts, [p.isascii() and "<|" not in p for p in parts])))

    def encode(self, texts: list) -> list[bytes]:
        out = [b""] * len(texts)
        special = {k: self.cut(t) for k, t in enumerate(texts) if t and "<|" in t}
        if special:
            get = self.ids_of(special.values()).__getitem__
            for k, ps in special.items():
                out[k] = b"".join(map(get, ps))
        block, size = [], 0
        for k, text in enumerate(texts):
            if text and k not in special:
                block.append(k)
                size += len(text)
            if block and (size >= BLOCK or k == len(texts) - 1):
                for j, ids in zip(block, self.block([texts[j].encode() for j in block])):
                    out[j] = ids
                block, size = [], 0
        return out

    def block(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without special strings, cut at once."""
        at, runs, one = runs_of(b"\n".join(texts))
        words = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        of_word = np.empty(len(words), bool)
        of_word[runs.indices.to_numpy()] = one
        ids = pa.array(self.learn(words, of_word.tolist()), pa.large_binary())
        _, places, data = ids.take(runs.indices).buffers()
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        to = np.frombuffer(places, np.int64)[np.searchsorted(at, starts)].tolist()
        return [data[i:j].to_pybytes() if i < j else b"" for i, j in zip(to, to[1:])]


def runs_of(data: bytes) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Where the runs of a UTF-8 text start, the runs, and which of them surely are runs.

    Words of letters of a certain class are cut, and their ASCII letters lowered as the
    vocabulary does; a word with any other letter is left as it is, in one.
    """
    data += b"\n\n"     # two bytes follow every mark
    low = np.frombuffer(data.lower(), np.uint8)
    kind = np.frombuffer(data.translate(KINDS), np.uint8)
    word = kind != SPACE
    if not data.isascii():
        kind = kind.copy()
        for first, n in ((0xC0, 2), (0xE0, 3)):
            lead = np.flatnonzero((low & (0xF0 if n == 3 else 0xE0)) == first)
            code = low[lead].astype(np.int32) & 0x0F if n == 3 else low[lead] & np.int32(0x1F)
            for k in range(1, n):
                code = code << 6 | low[lead + k] & 0x3F
            for k in range(n):
                kind[lead + k] = wide_kinds()[code]
    if (kind == OTHER).any():
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        number = np.cumsum(begins)
        odd = np.zeros(number[-1] + 1, bool)
        odd[number[kind == OTHER]] = True
        odd = odd[number] & word
        kind = np.where(odd, OTHER, kind)
        low = np.where(odd, np.frombuffer(data, np.uint8), low)
    starts = word.copy()
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # An apostrophe that starts a run takes the letters of a contraction; what follows them
    # starts another run.
    marks = np.flatnonzero(low == ord("'"))
    marks = marks[starts[marks] & (kind[marks] == SYMBOL)]
    one, two = low[marks + 1], low[marks + 2]
    length = np.where(np.isin(one, list(b"stmd")), 2, 0)
    for a, b in (b"re", b"ve", b"ll"):
        length[(one == a) & (two == b)] = 3
    marks, length = marks[length > 0], length[length > 0]
    starts[marks + 1] = False
    starts[marks + length] |= kind[marks + length] == LETTER
    at, body = np.flatnonzero(starts), low[word]
    bounds = np.append(np.flatnonzero(starts[word]), len(body))
    runs = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(body))
    return at, runs.dictionary_encode(), kind[at] != OTHER


def plain(text: str) -> bool:
    """Can ``text`` be cut before it is normalised?  Not with a letter that becomes two when
    lowered, characters to be composed, or what may be a special string; nor with characters
    that Python does not know, whose class may be another one in the library."""
    return text.isascii() and "<|" not in text or (
        "\u0130" not in text and "<|" not in text and text.isprintable()
        and unicodedata.is_normalized("NFC", text))


@functools.lru_cache(maxsize=2)
def texts_of(path: str) -> Texts:
    made = Texts(path)
    few_collections()
    return made


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system: without one it lies in Spark's default
    file system, which need not be the local disk."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(folder).toString()


def place(uri: str):
    """File system and path of a folder that every executor reaches."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class PartWriter:
    """Writes the ids of one part, and its index, as they come."""

    def __init__(self, folder: str, part: int, type, length: int):
        self.fs, self.base = place(folder)
        self.part, self.length, self.type = part, length, type
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}"       # of this attempt
        self.own = f"{self.base}/{self.name}"
        self.fs.create_dir(self.base, recursive=True)
        ids = pa.list_(pa.from_numpy_dtype(type), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.file = self.fs.open_output_stream(f"{self.own}.arrow")
        self.out = pa.ipc.new_file(self.file, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n += len(ids)
        if self.n_waiting >= self.length * ROWS:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, self.type), *self.waiting]).astype(self.type, copy=False)
        size = self.length * ROWS       # every batch but the last is full, so places are known
        full = len(ids) // size * size
        rest = ids[full:]
        mask = np.ones(len(ids), bool)
        if last and len(rest):
            pad = -len(ids) % self.length
            ids = np.concatenate([ids, np.zeros(pad, self.type)])
            mask = np.concatenate([mask, np.zeros(pad, bool)])
            full, rest = len(ids), rest[:0]
        for at in range(0, full, self.length * ROWS):
            end = min(full, at + self.length * ROWS)
            self.out.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids[at:end]), self.length),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask[at:end]), self.length)],
                schema=self.schema))
        self.waiting, self.n_waiting = [rest], len(rest)

    def close(self, index: pa.Table) -> None:
        self.flush(True)
        self.out.close()
        self.file.close()
        with self.fs.open_output_stream(f"{self.own}.index") as f, \
                pa.ipc.new_file(f, index.schema) as out:
            out.write_table(index)


def in_order(docs: DataFrame, text: str, id: str, part_bytes: int) -> DataFrame:
    """id and text in parts by ranges of ids, sorted inside; nulls first, ties by row."""
    total = docs.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-total // part_bytes))
    row = free_name(docs, "__row")
    rows = with_row_id(docs, row).select(F.col(f"`{id}`").alias("id"), F.col(row).alias("row"),
                                         F.col(f"`{text}`").alias("text"))
    return rows.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row")


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, *,
                 text: str = "text", id: str = "doc_id", end: int = END, length: int = LENGTH,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes all documents under ``path`` (by default in the shared folder) and returns
    the parts: path, part, name (of its files), docs, n (ids), start (ids of all parts
    before).

    Null and empty texts are their end id alone.  Null ids come first; rows of one id keep
    the order of the input files, and spread over parts like others.  An empty table
    writes no part.  Other columns have no effect.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = qualified(spark, path or written_path(spark, "tokens"))
    id_type = docs.schema[id].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        encoder, out = texts_of(tokenizer), None
        part = TaskContext.get().partitionId()
        ids, starts, sizes = [], [], []
        last = np.array([end], encoder.type).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or PartWriter(folder, part, encoder.type, length)
            ids += batch.column(0).to_pylist()
            for data in encoder.encode(batch.column(1).to_pylist()):
                doc = np.frombuffer(data + last, encoder.type)
                starts.append(out.n)
                sizes.append(len(doc))
                out.add(doc)
        if out:
            out.close(pa.table({"id": pa.array(ids, to_arrow_type(id_type)),
                                "start": pa.array(starts, pa.int64()),
                                "n": pa.array(sizes, pa.int64())}))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                              "name": pa.array([out.name]),
                                              "docs": pa.array([len(ids)], pa.int64()),
                                              "n": pa.array([out.n], pa.int64())})

    rows = in_order(docs, text, id, part_bytes).select("id", "text")
    # Stored, so the parts are written once; one row per part.
    parts = written(rows.mapInArrow(write, "part int, name string, docs bigint, n bigint"), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.lit(folder).alias("path"), "part", "name", "docs", "n",
                        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


class Part:
    """Random access to one written part.  A local file is mapped, not read."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        files, base = place(folder)
        self.name = f"{base}/{name}"
        local = isinstance(files, fs.LocalFileSystem)
        self.open = pa.memory_map if local else files.open_input_file
        self.ipc = pa.ipc.open_file(self.open(f"{self.name}.arrow"))
        self.length = self.ipc.schema.field("ids").type.list_size
        self.at = -1

    def batch(self, k: int) -> np.ndarray:
        """All ids of batch ``k``, a view of the file; the last one asked for is at hand."""
        if k != self.at:
            self.at, self.ids = k, self.ipc.get_batch(k).column("ids").values.to_numpy()
        return self.ids

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row ``row``; batches hold ``ROWS`` rows each but the last."""
        b = self.ipc.get_batch(row // ROWS)
        at = slice(row % ROWS * self.length, (row % ROWS + 1) * self.length)
        return (b.column("ids").flatten().to_numpy()[at],
                b.column("mask").flatten().to_numpy(zero_copy_only=False)[at])

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids from ``start`` on, ``n`` of them, in slices of the mapped batches."""
        size = ROWS * self.length
        while n > 0:
            k, at = divmod(start, size)
            piece = self.batch(k)[at:at + n]
            if not len(piece):
                raise ValueError(f"{self.name} ends before id {start}")
            yield piece
            start, n = start + len(piece), n - len(piece)

    def index(self) -> pa.Table:
        return pa.ipc.open_file(self.open(f"{self.name}.index")).read_all()


def read_tokens(parts: DataFrame, id_type: str) -> DataFrame:
    """Per document of the written files: id, start (ids before it in the whole stream), n,
    and the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                part = Part(r["path"], r["name"])
                index = part.index()
                starts, sizes = index["start"].to_numpy(), index["n"].to_numpy()
                sums = []
                for s, n in zip(starts.tolist(), sizes.tolist()):
                    crc = 0
                    for ids in part.span(s, n):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [index["id"].combine_chunks(), pa.array(starts + r["start"]),
                     pa.array(sizes), pa.array(sums, pa.int64())], ["id", "start", "n", "crc"])

    spread = parts.repartition(parts.sparkSession.sparkContext.defaultParallelism * 4, "part")
    return spread.mapInArrow(read, f"id {id_type}, start bigint, n bigint, crc bigint")


def op10(docs: DataFrame, tokenizer: str) -> DataFrame:
    parts = write_tokens(docs, tokenizer)
    return read_tokens(parts, docs.schema["doc_id"].dataType.simpleString()).select(
        F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"))
