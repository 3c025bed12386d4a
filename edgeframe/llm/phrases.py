"""Phrase collocations by multikey three-way quicksort of suffixes.

Every word of a piece begins a suffix of at most ``DEPTH`` words.  Suffixes go to tasks by
ranges of their language and leading words, so the phrases that begin alike are together;
a task sorts pointers to its suffixes by a multikey three-way quicksort.  The equal part of
a split at depth d is all suffixes with the same d + 1 words, so its size is the count of
that phrase, and a part with fewer suffixes than asked for is given up unsorted.  Only
phrases that begin a task's first or last suffix may go on in another task: those are
counted in parts and added up.

Words and neighbours of words are counted first.  A phrase is at most as frequent as each
two neighbours in it, so a suffix ends where a pair that is rare everywhere begins.  What
tasks know of the pairs is a bitmap of a fixed size with a bit for every frequent one; rare
pairs that share a bit only make suffixes longer than need be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from edgeframe.llm.common import small_batches
from edgeframe.session import leaf_bytes, written

DEPTH = 5               # words of the longest phrase
LEAST = 100             # occurrences of a phrase
CHUNK = 2 << 20         # bytes of text taken apart at a time
KNOWN = 400_000         # different words a task counts before it puts them out
PAIRS = 8_000_000       # pairs a task counts before it puts them out
BLOCKS = 1 << 10        # parts in which the counts of pairs are added up, at least
BLOCK_BYTES = 32 << 20  # of input to one such part
BITS = 1 << 24          # bits of the map of frequent pairs, 2 MB
PART = 1_000_000        # suffixes sorted in one task
CUT = b"\xff"           # end of a piece; no byte of any text in UTF-8
# Every byte's meaning: letters A-Z are lowered, marks and line ends cut pieces.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ENDS = bytes.maketrans(b".,;:!?\n\v\f\r", CUT * 10)


def taken_apart(text: str) -> bytes:
    """Words and ``CUT`` between blanks."""
    return text.encode().translate(LOWER).translate(ENDS).replace(CUT, b" \xff ")


def escape(word: bytes) -> bytes:
    """A word without the byte 0, which divides the words of a key; keeps the order."""
    if b"\x00" in word or b"\x01" in word:
        return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    return word


class Streams:
    """Texts by language, cut into chunks of bounded size.

    ``chunk(lang, tokens, fresh, last)`` gets the tokens of a chunk behind the ``carry``
    tokens that ended the chunk before it; ``fresh`` is the number of those.  A long text
    is cut at blanks.
    """

    def __init__(self, carry: int, chunk: Callable[[str, list, int, bool], None]):
        self.carry, self.chunk = carry, chunk
        self.waiting: dict[str, list[bytes]] = {}
        self.size = 0

    def feed(self, lang: str, text: str) -> None:
        data = taken_apart(text)
        self.waiting.setdefault(lang, []).append(data)
        self.size += len(data)
        if self.size >= CHUNK:
            self.flush()

    def flush(self) -> None:
        for lang, texts in self.waiting.items():
            data, at, kept = b" \xff ".join(texts), 0, []
            while at < len(data):
                end = data.find(b" ", at + CHUNK) if len(data) - at > CHUNK else -1
                end = len(data) if end < 0 else end
                tokens = kept + data[at:end].split()
                self.chunk(lang, tokens, len(kept), end == len(data))
                kept, at = tokens[-self.carry:], end
        self.waiting, self.size = {}, 0


class Words(dict):
    """Numbers of words, in order of appearance, for one language; ``CUT`` is 0."""

    def __init__(self) -> None:
        super().__init__({CUT: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def pair_cells(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit cells of neighbours ``ids[i], ids[i + 1]``, and which of them are pairs."""
    a, b = ids[:-1], ids[1:]
    mixed = hashes[a] * np.uint64(0x9E3779B97F4A7C15) + hashes[b]
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32), (a != 0) & (b != 0)


def hashed(lang: str, words: Iterable[bytes]) -> list[int]:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return [xxhash.xxh64_intdigest(w, seed) for w in words]


def _texts(batches: Iterable[pa.RecordBatch], streams: Streams) -> Iterator[None]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                streams.feed(lang, text)
        yield


def _counted(batches: Iterable[pa.RecordBatch], least: int,
             blocks: int) -> Iterator[pa.RecordBatch]:
    """Counts of words (lang, word, n) and, by block, of the cells of pairs.  More than
    ``least`` of a pair is as good as ``least``."""
    small = _small(least)
    tables: dict[str, Words] = {}
    counts: dict[str, np.ndarray] = {}
    hashes: dict[str, np.ndarray] = {}
    cells: list[np.ndarray] = []

    def chunk(lang: str, tokens: list, fresh: int, last: bool) -> None:
        table = tables.setdefault(lang, Words())
        before = len(table)
        ids = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
        new = hashed(lang, list(table)[before:]) if lang in hashes else hashed(lang, table)
        hashes[lang] = np.concatenate([hashes.get(lang, np.empty(0, np.uint64)),
                                       np.array(new, np.uint64)])
        n = np.bincount(ids[fresh:], minlength=len(table))
        old = counts.get(lang, np.empty(0, np.int64))
        n[:len(old)] += old
        counts[lang] = n
        found, pairs = pair_cells(ids, hashes[lang])
        cells.append(found[pairs].astype(np.uint32))

    def words() -> Iterator[pa.RecordBatch]:
        for lang, table in tables.items():
            of = [escape(w) for w in list(table)[1:]]
            for at in range(0, len(of), 100_000):
                part = of[at:at + 100_000]
                yield _rows([lang] * len(part), part, counts[lang][at + 1:at + 1 + len(part)], 0, None)
        tables.clear(), counts.clear(), hashes.clear()

    def pairs() -> Iterator[pa.RecordBatch]:
        if not cells:
            return
        found, n = np.unique(np.concatenate(cells), return_counts=True)
        cells.clear()
        ends = np.searchsorted(found, np.arange(1, blocks + 1, dtype=np.uint64) * ((1 << 32) // blocks))
        start = 0
        blobs, at = [], []
        for k, end in enumerate(ends.tolist()):
            if end > start:
                blobs.append(found[start:end].tobytes()
                             + np.minimum(n[start:end], least).astype(small).tobytes())
                at.append(k)
            start = end
        yield _rows([None] * len(at), blobs, np.zeros(len(at), np.int64), 1, at)

    streams = Streams(1, chunk)
    for _ in _texts(batches, streams):
        if sum(map(len, tables.values())) > KNOWN:
            streams.flush()
            yield from words()
        if sum(map(len, cells)) > PAIRS:
            yield from pairs()
    streams.flush()
    yield from words()
    yield from pairs()


_COUNTED = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("data", pa.binary()),
                      ("n", pa.int64()), ("block", pa.int32())])


def _rows(lang: list, data: list, n: np.ndarray, kind: int, block: list | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(data), pa.int32()), pa.array(lang, pa.string()),
         pa.array(data, pa.binary()), pa.array(n, pa.int64()),
         pa.array(block or [None] * len(data), pa.int32())], schema=_COUNTED)


def _small(least: int) -> type:
    """A type for counts up to ``least``."""
    return np.uint8 if least < 256 else np.uint32


def frequent_pairs(counted: DataFrame, least: int) -> bytes:
    """A bitmap of ``BITS`` bits with those of the frequent pairs set."""
    small = _small(least)

    def add(table: pa.Table) -> pa.Table:
        cells, n = [], []
        for blob in table.column("data").to_pylist():
            size = len(blob) // (4 + small().itemsize)
            cells.append(np.frombuffer(blob, np.uint32, size))
            n.append(np.frombuffer(blob, small, size, 4 * size))
        used, at = np.unique(np.concatenate(cells), return_inverse=True)
        often = used[np.bincount(at, np.concatenate(n).astype(np.float64)) >= least]
        bits = np.unique(often & np.uint32(BITS - 1))
        return pa.table({"bucket": pa.array(bits // 32768, pa.int64()),
                         "bit": pa.array(bits % 32768, pa.int64())})

    found = counted.where("kind = 1").groupBy("block").applyInArrow(add, "bucket bigint, bit bigint")
    maps = found.groupBy("bucket").agg(F.call_function("bitmap_construct_agg", "bit").alias("map"))
    out = bytearray(BITS // 8)
    for r in maps.toLocalIterator():        # at most BITS / 32768 rows of 4 KB
        out[r["bucket"] * 4096:(r["bucket"] + 1) * 4096] = r["map"]
    return bytes(out)


def _suffixes(bitmap: bytes, depth: int) -> Callable:
    """Different suffixes of two and more words and how often a chunk has each."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
        out: list[pa.RecordBatch] = []

        def chunk(lang: str, tokens: list, fresh: int, last: bool) -> None:
            table = Words()
            ids = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
            words = list(table)
            hashes = np.array(hashed(lang, words), np.uint64)
            cells, pairs = pair_cells(ids, hashes)
            ok = pairs & bits[(cells & np.uint64(BITS - 1)).astype(np.int64)]
            # The carried tokens are there so that suffixes begun before can end; without a
            # chunk behind this one the last tokens begin suffixes of their own.
            stop = len(ids) if last else max(0, len(ids) - depth + 1)
            ok = np.concatenate([ok, np.zeros(depth, bool)])
            long = np.concatenate([ids, np.zeros(depth, np.int64)])
            starts = np.flatnonzero(ok[:stop])
            # Rank suffixes by their first words, one word more at a time: exact.
            going, rank = np.ones(len(starts), bool), long[starts]
            columns = [long[starts]]
            for d in range(1, depth):
                going = going & ok[starts + d - 1]
                word = np.where(going, long[starts + d], 0)
                columns.append(word)
                rank = np.unique(rank * len(words) + word, return_inverse=True)[1]
            _, first, n = np.unique(rank, return_index=True, return_counts=True)
            parts = np.stack(columns, axis=1)[first]
            sizes = (parts != 0).sum(axis=1)
            names = [escape(w) for w in words]
            head = escape(lang.encode()) + b"\x00"
            keys = [head + b"\x00".join([names[i] for i in row[:k]])
                    for row, k in zip(parts.tolist(), sizes.tolist())]
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(n, pa.int64())], names=["key", "n"]))

        streams = Streams(depth - 1, chunk)
        for _ in _texts(batches, streams):
            yield from out
            out.clear()
        streams.flush()
        yield from out

    return run


# ---- the sort ----------------------------------------------------------------------


def quicksort(words: np.ndarray, weights: np.ndarray, least: int,
              low: Sequence[int], high: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, row, weight) of the equal parts: ``row`` begins with the ``depth`` words that
    the part shares.

    ``words`` are rows of word numbers, 0 behind the end.  Parts under ``least`` are given
    up, but not what the rows ``low`` and ``high``, the first and last of the range, begin
    with.
    """
    at = np.arange(len(words))
    depths = words.shape[1]
    # Part of the pointers, depth, and whether its rows share all words so far with low, high.
    todo = [(0, len(at), 0, True, True)]
    while todo:
        begin, end, d, on_low, on_high = todo.pop()
        mine = at[begin:end]
        if not len(mine) or not (on_low or on_high) and weights[mine].sum() < least:
            continue
        keys = words[mine, d]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, more = keys < pivot, keys > pivot
        a, c = int(less.sum()), int(more.sum())
        b = len(keys) - a - c
        same = mine[~(less | more)]
        at[begin:end] = np.concatenate([mine[less], same, mine[more]])
        if a:
            todo.append((begin, begin + a, d, on_low, on_high))
        if c:
            todo.append((end - c, end, d, on_low, on_high))
        if pivot:
            low_too, high_too = on_low and pivot == low[d], on_high and pivot == high[d]
            n = int(weights[same].sum())
            if n >= least or low_too or high_too:
                yield d + 1, int(same[0]), n
                if d + 1 < depths:
                    todo.append((begin + a, begin + a + b, d + 1, low_too, high_too))


def _sorted(least: int, depth: int) -> Callable:
    """Counts of phrases of a range of suffixes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        rows, weights = [], []
        for batch in batches:
            keys = [k.split(b"\x00") for k in batch.column(0).to_pylist()]
            flat = np.zeros((len(keys), depth + 1), np.int32)
            for d in range(depth + 1):
                flat[:, d] = [numbers.setdefault(k[d], len(numbers) + 1) if len(k) > d else 0
                              for k in keys]
            rows.append(flat)
            weights.append(batch.column(1).to_numpy())
        if not rows:
            return
        known = sorted(numbers)
        order = np.zeros(len(known) + 1, np.int32)
        order[[numbers[w] for w in known]] = np.arange(1, len(known) + 1)
        words, weight = order[np.concatenate(rows)], np.concatenate(weights)
        del rows, numbers
        low, high = _ends(words)
        out: dict[str, list] = {"key": [], "words": [], "n": []}
        for d, row, n in quicksort(words, weight, least, low, high):
            if d > 2:       # a language and two words at least
                out["key"].append(b"\x00".join([known[i - 1] for i in words[row, :d].tolist()]))
                out["words"].append(d - 1)
                out["n"].append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["key"], pa.binary()), pa.array(out["words"], pa.int32()),
             pa.array(out["n"], pa.int64())], names=["key", "words", "n"])

    return run


def _ends(words: np.ndarray) -> tuple[list[int], list[int]]:
    """The least and the greatest row."""
    ends = []
    for best in (np.min, np.max):
        left = np.arange(len(words))
        for d in range(words.shape[1]):
            column = words[left, d]
            left = left[column == best(column)]
        ends.append(words[left[0]].tolist())
    return ends[0], ends[1]


# ---- the operator ------------------------------------------------------------------


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang",
                  least: int = LEAST, depth: int = DEPTH,
                  part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Stored counts: words (lang, word, n), all of them, and phrases (key, words, n) of two
    to ``depth`` words that occur ``least`` times.  Words and keys are escaped; a key is the
    language and the words with a byte 0 between them."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"),
                        F.col(f"`{text}`").alias("text"))
    blocks = max(BLOCKS, 1 << (leaf_bytes(docs) // BLOCK_BYTES).bit_length())
    counted = written(texts.mapInArrow(
        lambda batches: _counted(batches, least, blocks),
        "kind int, lang string, data binary, n bigint, block int"), "counted")
    words = written(counted.where("kind = 0").groupBy("lang", F.col("data").alias("word"))
                    .agg(F.sum("n").alias("n")), "words")
    bitmap = frequent_pairs(counted, least)
    found = written(texts.mapInArrow(_suffixes(bitmap, depth), "key binary, n bigint"), "suffixes")
    tasks = max(1, -(-found.count() // part))
    parts = found.repartitionByRange(tasks, "key").mapInArrow(
        _sorted(least, depth), "key binary, words int, n bigint")
    phrases = parts.groupBy("key", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, written(phrases, "phrases")


def _within(key: Column, begin: Column, count: Column) -> Column:
    """Words ``begin`` (from 1, 0 is the language) and ``count`` of them, behind the language."""
    parts = F.split(F.decode(key, "ISO-8859-1"), "\x00")
    return F.encode(F.array_join(F.concat(F.slice(parts, F.lit(1), F.lit(1)),
                                          F.slice(parts, begin + 1, count)), "\x00"), "ISO-8859-1")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang",
                 least: int = LEAST, depth: int = DEPTH, within: int = 100, top: int = 2000,
                 part: int = PART) -> DataFrame:
    """Each language's first ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Phrases are 2 to ``depth`` words inside a piece (between ``.,;:!?`` and line ends) that
    occur ``least`` times.  The score is the least, over all cuts into two parts that occur
    l and r times, of floor(1000·a·n / (l·r)), with n the words of the language; the first
    of several least cuts counts.  A phrase goes if a longer one around it has ``within``
    per cent of its count or more.  Ties go to the more frequent, then by bytes.

    A null text has no words, a null language is ``und``, and a long text is taken apart in
    chunks that know each other's last words.  Repeated rows count again.  An empty table,
    or one without frequent phrases, gives no rows; other columns have no effect.
    """
    words, phrases = phrase_counts(docs, text=text, lang=lang, least=least, depth=depth, part=part)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    code = F.encode("lang", "UTF-8")
    key_of_lang = F.when(F.instr("lang", F.lit("\x00")) + F.instr("lang", F.lit("\x01")) > 0, F.encode(F.replace(
        F.replace("lang", F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01")),
        "UTF-8")).otherwise(code)
    single = words.where(F.col("n") >= least).select(
        F.concat(key_of_lang, F.lit(b"\x00"), F.col("word")).alias("key"), F.col("n"))
    known = written(single.unionByName(phrases.select("key", "n")), "known")
    # Every phrase inside a longer one, with the greatest count of what is around it.
    longer = phrases.where(F.col("words") > 2).select("words", "n", "key")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda b: F.struct(b.alias("b"), m.alias("m")))))
    inside = longer.select("key", F.col("n").alias("outer_n"), F.explode(inner).alias("x")).select(
        _within(F.col("key"), F.col("x.b"), F.col("x.m")).alias("inner_key"), "outer_n") \
        .groupBy("inner_key").agg(F.max("outer_n").alias("outer_n"))
    kept = phrases.join(inside, F.col("key") == F.col("inner_key"), "left").where(
        F.col("outer_n").isNull() | (100 * F.col("outer_n") < within * F.col("n")))
    cuts = kept.select("key", "words", F.col("n").alias("a"),
                       F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("key", "a", "k", _within(F.col("key"), F.lit(1), F.col("k")).alias("left"),
                        _within(F.col("key"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    met = sides.join(known.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(
        known.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    spelled = words.select("lang").distinct().select("lang", key_of_lang.alias("head"))
    per_lang = totals.join(spelled, "lang")
    head = F.encode(F.substring_index(F.decode("key", "ISO-8859-1"), "\x00", 1), "ISO-8859-1")
    score = F.expr("CAST(1000 AS decimal(4,0)) * CAST(a AS decimal(15,0)) * CAST(total AS decimal(16,0))"
                   " div (CAST(l AS decimal(16,0)) * CAST(r AS decimal(16,0)))").cast("bigint")
    scored = met.withColumn("head", head).join(per_lang, "head").select(
        "lang", "key", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"),
        F.col("total").alias("n"))
    best = scored.groupBy("lang", "key", "a", "n").agg(F.min("cut").alias("cut"))
    spelled_key = F.decode("key", "ISO-8859-1")
    own = F.substring(spelled_key, F.instr(spelled_key, F.lit("\x00")) + 1, F.lit((1 << 31) - 1))
    phrase = F.encode(F.replace(own, F.lit("\x00"), F.lit(" ")), "ISO-8859-1")
    plain = F.decode(F.encode(F.replace(F.replace(F.decode(phrase, "ISO-8859-1"), F.lit("\x01\x01"),
                                                  F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01")),
                              "ISO-8859-1"), "UTF-8")
    rows = best.select("lang", plain.alias("phrase"), "a", F.col("cut.l").alias("l"),
                       F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within shares of a language, so that no task ranks all of its phrases.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = rows.withColumn("share", share).withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    return collocations(docs)


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\v\f\r]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda b: ws[b:b + m - 1])) AS ph
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m),
c AS (SELECT lang, m, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
inside AS (SELECT DISTINCT s.lang, s.ph FROM c s JOIN (
    SELECT lang, f, unnest(flatten(list_transform(range(2, m), lambda x:
      list_transform(range(1, m - x + 2), lambda b: ph[b:b + x - 1])))) AS part FROM c WHERE m > 2) x
  ON s.lang = x.lang AND s.ph = x.part AND 100 * x.f >= 100 * s.f),
cuts AS (SELECT lang, m, ph, f AS a, unnest(range(1, m)) AS k FROM c WHERE m > 1),
s AS (SELECT u.lang, u.ph, u.a, u.k, l.f AS l, r.f AS r, n.n,
    (1000 * u.a::HUGEINT * n.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts u JOIN c l ON l.lang = u.lang AND l.ph = u.ph[1:u.k]
  JOIN c r ON r.lang = u.lang AND r.ph = u.ph[u.k + 1:u.m] JOIN n ON n.lang = u.lang
  WHERE (u.lang, u.ph) NOT IN (SELECT lang, ph FROM inside)),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS best FROM s),
o AS (SELECT *, array_to_string(ph, ' ') AS phrase FROM b WHERE best = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= 2000
"""
