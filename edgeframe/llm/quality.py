"""Quality by distribution divergence: does a document look like any language at all?

Every document is a histogram over character classes and one over common words.  Both are
compared with references, one per language of the labelled documents, by Jensen-Shannon
distance.  A document that is far from every reference is rejected, unless it is too short
to tell.  The references are sums over all labelled documents, and so is the histogram of
their word distances, which says from where on a document is far by its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from edgeframe.llm.common import SPACES, free_name, words
from edgeframe.session import written

SYMBOLS = "#*$%&|<>"
# Character classes: what a regular expression matches of a text.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "space": "[ \\t-\\r]+",
           "stop": "[.,;:!?'\"()-]+", "symbol": "[#*$%&|<>@^_~=+/{}\\[\\]\\\\`]+"}
SHORT = 5           # a common word has so many characters at most
COMMON = 24         # common words of a reference
MIN_WORDS = 50      # fewer: the histograms say too little, the document is kept
MIN_CHARS = 300
FAR_CHARS = 0.28    # Jensen-Shannon distance (base 2, 0 to 1) from which on a document is far
# Words are far from the upper fence of the labelled documents on (third quartile and FENCE
# times the quartiles' distance), within these limits: without common words it is 1.
FENCE, FAR_WORDS = 1.5, (0.6, 0.95)
BINS = 1000         # of the histogram that gives the quartiles
MIN_N, MAX_REPEAT = 50, 50      # base rules: words, per cent of words in repeated windows


def repeated(w: Column) -> Column:
    """Words in windows of three words that occur twice or more in the text.

    Windows are sorted by hashes of their words; those whose hash a neighbour has are the
    only ones that can repeat.  They are sorted by their words, and equal neighbours repeat.
    """
    def hashed(ws: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ws) - 3)
        return _let(F.transform(ws, lambda x: F.xxhash64(x)), lambda h: F.array_sort(F.transform(
            at, lambda i: F.struct(
                F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("key"),
                i.alias("at")))))

    def twice(s: Column) -> Column:
        return _let(s["key"], lambda keys: F.filter(s, lambda x, k: (
            x["key"] == F.get(keys, k - 1)) | (x["key"] == F.get(keys, k + 1))))

    def windows(ws: Column, s: Column) -> Column:
        return F.array_sort(F.transform(s, lambda x: F.struct(F.concat_ws(
            " ", F.get(ws, x["at"]), F.get(ws, x["at"] + 1), F.get(ws, x["at"] + 2)).alias("key"),
            x["at"].alias("at"))))

    def covered(s: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(
            twice(s)["at"], lambda p: F.array(p, p + 1, p + 2)))))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(w, lambda ws: _let(
        windows(ws, _let(hashed(ws), twice)), covered)))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"),
                     lambda x: F.translate(x, SPACES, "") != "")
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def class_counts(text: Column) -> Column:
    """Characters in all, per class, and among ``SYMBOLS``.

    Classes share no character, so every class is counted in what the classes before it left
    over: only the first pass reads the whole text.
    """
    def taken(left: Column, names: list[str], counts: dict[str, Column]) -> Column:
        if not names:
            # What SYMBOLS names is in the last class, and no other.
            return F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])
        name, *others = names
        symbols = {} if others else {"n_symbols": F.regexp_count(
            left, F.lit("[#*$%&|<>]"))}
        return _let(F.regexp_replace(left, CLASSES[name], ""), lambda rest: taken(
            rest, others, counts | symbols | {name: F.char_length(left) - F.char_length(rest)}))
    return taken(text, list(CLASSES), {"n_chars": F.char_length(text)})


def features(docs: DataFrame, text: str, id: str, lang: str) -> DataFrame:
    """One row per document: base counts, characters per class, short words, language."""
    t = free_name(docs, "__text")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{lang}`").alias("lang"),
                    whole.alias(t))
    measured = _let(words(F.col(t)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        repeated(w).cast("long").alias("n_repeat_words"),
        F.filter(F.transform(w, F.lower), lambda x: F.char_length(x) <= SHORT).alias("short")))
    return d.select("id", "lang", measured.alias("m"), class_counts(F.col(t)).alias("c"),
                    dup_lines(F.col(t)).cast("long").alias("n_dup_lines")).select(
        "id", "lang", "m.n_words", (F.col("c.n_chars") - F.col("c.space")).alias("word_chars"),
        "c.n_symbols", "n_dup_lines", "m.n_repeat_words", "c.n_chars", "m.short",
        *[F.col(f"c.{c}").alias(f"c_{c}") for c in CLASSES])


def references(rows: DataFrame) -> DataFrame:
    """One row per language with labelled words: ``classes``, shares of the character classes
    (the last is all other characters), ``words``, shares of its common words among
    themselves, and ``q_all``, their share of all words."""
    labelled = rows.where(F.col("lang").isNotNull())
    sums = labelled.groupBy("lang").agg(
        F.sum("n_words").alias("n"), F.sum("n_chars").alias("chars"),
        *[F.sum(f"c_{c}").alias(c) for c in CLASSES]).where((F.col("n") > 0) & (F.col("chars") > 0))
    common = (labelled.select("lang", F.explode("short").alias("word"))
              .groupBy("lang", "word").agg(F.count("*").alias("n"))
              .withColumn("rank", F.row_number().over(
                  Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")))
              .where(F.col("rank") <= COMMON)      # each task passes on so many at most
              .groupBy("lang").agg(F.sum("n").alias("n_common"),
                                   F.collect_list(F.struct("word", "n")).alias("common")))
    shares = [F.col(c) / F.col("chars") for c in CLASSES]
    q = F.transform("common", lambda x: F.struct(x["word"], x["n"] / F.col("n_common")))
    return sums.join(common, "lang", "left").select(
        "lang", F.array(*shares, F.greatest(
            F.lit(1.0) - sum(shares[1:], shares[0]), F.lit(0.0))).alias("classes"),
        F.coalesce(F.map_from_entries(q), F.create_map().cast("map<string,double>")).alias("words"),
        F.coalesce(F.col("n_common") / F.col("n"), F.lit(0.0)).alias("q_all"))


def divergence_term(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence, in bits."""
    def half(a: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(0.0)
    return half(p) + half(q)


def distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def char_distance(ref: Column) -> Column:
    named = [F.col(f"c_{c}") / F.col("n_chars") for c in CLASSES]
    shares = [*named, F.greatest(F.lit(1.0) - sum(named[1:], named[0]), F.lit(0.0))]
    terms = [divergence_term(p, F.get(ref["classes"], F.lit(k))) for k, p in enumerate(shares)]
    return distance(sum(terms[1:], terms[0]))


def word_distance(ref: Column, found: Column, n: Column) -> Column:
    """``found``: array of (word, count) of the document.  Only the common words of the
    reference are bins, in shares of the common words it leads one to expect; what the
    document lacks of them is a bin of its own, so a document without any has distance 1.
    A common word that it lacks adds its share of the reference, so only words that it has
    are looked up."""
    mine = F.filter(F.transform(found, lambda x: F.struct(
        (x["n"] / n).alias("p"), F.element_at(ref["words"], x["word"]).alias("q"))),
        lambda x: x["q"].isNotNull())

    def total(bins: Column) -> Column:
        p_all = F.aggregate(bins, F.lit(0.0), lambda a, x: a + x["p"])
        return _let(F.struct(p_all.alias("p"), F.greatest(p_all, ref["q_all"]).alias("of")),
                    lambda s: distance(F.aggregate(
                        bins, F.lit(2.0) - s["p"] / s["of"],
                        lambda a, x: a + divergence_term(x["p"] / s["of"], x["q"]) - x["q"])))

    # No common words to miss: such a language tells by its characters alone.
    return F.when(ref["q_all"] > 0, _let(mine, total)).when(
        char_distance(ref) < FAR_CHARS, F.lit(0.0))


def far_words(labelled: DataFrame) -> float:
    """Word distance from which on a document is far: the upper fence of ``labelled``."""
    bins = sorted((r["bin"], r["count"]) for r in labelled.groupBy(F.floor(
        F.col("word_distance") * BINS).alias("bin")).count().collect())     # BINS + 1 at most
    every, seen, quartiles = sum(n for _, n in bins), 0, []
    for at, n in bins:
        seen += n
        while len(quartiles) < 2 and 4 * seen >= (1 + 2 * len(quartiles)) * every:
            quartiles.append((at + 1) / BINS)
    low, high = quartiles or (1.0, 1.0)
    return min(max(high + FENCE * (high - low), FAR_WORDS[0]), FAR_WORDS[1])


def histogram(short: Column, vocabulary: list[str]) -> Column:
    """(word, count) of the words of a document that some reference has."""
    return _let(F.array_sort(F.filter(short, lambda x: x.isin(vocabulary))),
                lambda s: _let(F.array_distinct(s), lambda d: F.transform(
                    d, lambda x, k: F.struct(x.alias("word"), (
                        F.coalesce(F.array_position(s, F.get(d, k + 1)), F.size(s) + 1)
                        - F.array_position(s, x)).alias("n")))))


def quality(docs: DataFrame, *, text: str = "text", id: str = "doc_id",
            lang: str = "lang") -> DataFrame:
    """One row per document: base counts, least distances, base_failed, kept.

    ``kept`` is false for documents that fail a base rule, and for documents of at least
    ``MIN_WORDS`` words and ``MIN_CHARS`` characters whose classes are ``FAR_CHARS`` or
    more from every reference, or whose common words are ``far_words`` or more.  Every
    labelled language is a reference, however rare.  The language of a document is used for
    references and that bound only.  Null and empty texts have no words and fail.  Without
    labelled documents there is nothing to be far from.  Rows are independent once the
    references stand; an empty table gives no rows.
    """
    rows = written(features(docs, text, id, lang), "features")
    refs = written(references(rows), "references")
    vocabulary = sorted(r[0] for r in refs.select(
        F.explode(F.map_keys("words"))).distinct().collect())       # COMMON a language at most
    every = refs.agg(F.collect_list(F.struct("classes", "words", "q_all")).alias("refs"))
    base_failed = (F.col("n_words") < MIN_N) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    judged = (F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS)

    def least(of) -> Column:
        # No reference at all: nothing to be far from.  None that tells by words: far.
        none = F.when(F.size("refs") > 0, 1.0).otherwise(0.0)
        return F.when(judged, F.coalesce(F.array_min(F.transform("refs", of)), none))

    by_word = _let(histogram(F.col("short"), vocabulary), lambda h: least(
        lambda r: word_distance(r, h, F.col("n_words"))))
    out = written(rows.withColumn("base_failed", base_failed).crossJoin(F.broadcast(every))
                  .withColumn("char_distance", least(char_distance))
                  .withColumn("word_distance", by_word).drop("short", "refs"), "distances")
    far = far_words(out.where(F.col("lang").isNotNull() & ~F.col("base_failed")
                              & F.col("word_distance").isNotNull()))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(
        (F.col("char_distance") >= FAR_CHARS) | (F.col("word_distance") >= far),
        F.lit(False)))


def op3(docs: DataFrame) -> DataFrame:
    return quality(docs).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
