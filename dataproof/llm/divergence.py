"""Quality rules by distribution divergence, in DataFrame functions only (operator 3).

Two histograms of a document are held against references of its language: the shares of character
classes and the shares of the language's most common words (all others are one more bin). The distance
is the Jensen-Shannon distance, the square root of the divergence in bits, between 0 and 1. A third histogram has
two bins, common words and all others; a document is too far if it has fewer common words than the reference and its
distance comes near the one of having none at all (gibberish, or another language). Documents shorter than a minimum
are not judged by distances, because their histograms say too little.

References are counted over all documents, one for every language. A language's counts are taken together with a fixed
number of words of all documents at their average shares, so that the reference of a language of few documents is close to
the average of all and moves to its own with every document more.

One pass counts what needs one text alone (base counts and character classes) and writes it beside the rows; references are
sums of that and of word counts; a second pass looks up common words and measures distances.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataproof.llm.common import join_small, numbered, settle, whole_text

#: White space but the blank.
OTHER_WHITE = r"[\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Character classes as Java regular expressions, the commonest first. White space is one more class, and so is all the rest.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", SYMBOLS, r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]")
CLASS_NUMBER = len(CLASSES) + 2
SYMBOL_CLASS, SPACE_CLASS = CLASSES.index(SYMBOLS), len(CLASSES)
ALL = "*"
#: The columns of a verdict.
VERDICT = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words class_distance word_distance common_distance base_failed kept"
).split()


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules."""

    common_words: int = 48
    slots: int = 1024
    min_words: int = 60
    min_chars: int = 300
    max_class_distance: float = 0.30
    max_word_distance: float = 0.50
    #: Of the distance that a document without any common word has. Clean documents come to 0.73.
    max_absence: float = 0.76
    #: Words of all documents that each language's own are taken together with, and characters.
    prior_words: int = 200
    prior_chars: int = 1200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of ``text``. It is split at single blanks, which takes no regular expression, so runs leave empty parts."""
    return F.array_remove(F.split(F.regexp_replace(text, OTHER_WHITE, " "), " "), "")


def _without(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, f"{kind}+", "")


def class_counts(text: Column, words: Column | None = None) -> Column:
    """How many characters of each class ``text`` has, as an array. ``words`` are its words, if they are known.

    The words are put together without white space; the commonest class is cut out first, in runs that are long thus, so
    that the others are looked for in a short rest of the text.
    """

    def of_solid(solid: Column) -> Column:
        def of_rest(rest: Column) -> Column:
            def cut(kind: str) -> Column:
                return (F.char_length(rest) - F.char_length(_without(rest, kind))).cast("long")

            commonest = (F.char_length(solid) - F.char_length(rest)).cast("long")
            spaces = (F.char_length(text) - F.char_length(solid)).cast("long")
            return F.array(commonest, *[cut(kind) for kind in CLASSES[1:]], spaces)

        return let(_without(solid, CLASSES[0]), of_rest)

    def with_rest(counts: Column) -> Column:
        rest = F.char_length(text) - F.aggregate(counts, F.lit(0).cast("long"), lambda total, x: total + x)
        return F.concat(counts, F.array(rest))

    return let(let(F.array_join(words_of(text) if words is None else words, ""), of_solid), with_rest)


def window_hashes(words: Column, width: int = 5) -> Column:
    """64-bit hashes of all windows of ``width`` words, in their order; none if there are fewer words."""

    def hashes(ids: Column) -> Column:
        def window(start: Column) -> Column:
            return F.xxhash64(*[F.get(ids, start + k) for k in range(width)])

        return F.transform(F.sequence(F.lit(0), F.size(ids) - width), window)

    found = let(F.transform(words, lambda word: F.xxhash64(word)), hashes)
    return F.when(F.size(words) >= width, found).otherwise(F.array().cast("array<long>"))


def repeated_words(found: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more; ``found`` are the :func:`window_hashes`.

    ``found`` is best a column of its own: outside of :func:`let` distinct values are counted in generated code.
    """
    ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def places(found: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(found, i - 1)["h"] == x["h"], F.lit(False))
            return before | F.coalesce(F.get(found, i + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(found, again), lambda x: x["p"]))

    def cover(so_far: Column, place: Column) -> Column:
        new = F.least(F.lit(width), place - so_far["last"])
        return F.struct((so_far["words"] + new).alias("words"), place.alias("last"))

    start = F.struct(F.lit(0).alias("words"), F.lit(-width).alias("last"))
    covered = F.aggregate(let(ordered, places), start, cover, lambda end: end["words"])
    # Most texts repeat no window at all.
    return F.when(F.size(F.array_distinct(found)) < F.size(found), covered).otherwise(0).cast("long")


def measured(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with its language (``language_``), the counts of its character classes (``classes_``) and the base counts.

    The symbols of the base rules are one of the classes, and what is not white space lies in words.
    """
    rows = df.select(
        "*",
        F.coalesce(df[lang].cast("string"), F.lit(ALL)).alias("language_"),
        words_of(whole_text(df, text)).alias("words_"),
    )
    rows = rows.select(
        *df.columns,
        "language_",
        F.size("words_").cast("long").alias("n_words"),
        class_counts(whole_text(df, text), F.col("words_")).alias("classes_"),
        window_hashes(F.col("words_")).alias("windows_"),
    )
    lines = F.filter(F.split(whole_text(df, text), "\n"), lambda line: line.rlike(WORD))
    everything = F.aggregate("classes_", F.lit(0).cast("long"), lambda total, x: total + x)
    return rows.select(
        *df.columns,
        "language_",
        "classes_",
        "n_words",
        (everything - F.get("classes_", F.lit(SPACE_CLASS))).alias("word_chars"),
        F.get("classes_", F.lit(SYMBOL_CLASS)).alias("n_symbols"),
        let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows_")).alias("n_repeat_words"),
    )


def _slot(word: Column, seed: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(word, seed), F.lit(slots)).cast("int")


def _commonest(counts: DataFrame, number: int) -> DataFrame:
    """The rows of the ``number`` commonest words of each language, ranked in two steps: first within parts of it."""
    order = [F.col("n").desc(), F.col("word")]
    in_part = F.row_number().over(Window.partitionBy("language", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(*order))
    best = counts.withColumn("place", in_part).where(F.col("place") <= number).drop("place")
    place = F.row_number().over(Window.partitionBy("language").orderBy(*order))
    return best.withColumn("place", place).where(F.col("place") <= number).drop("place")


def _smoothed(own: Column, total: Column, average: Column, prior: int) -> Column:
    return (own + prior * average) / (total + F.lit(float(prior)))


def references_of(rows: DataFrame, limits: Limits, text: str = "text") -> DataFrame:
    """``language, class_shares, common, common_shares, longest, seed, slots`` of the rows of :func:`measured`: a row per
    language, and ``*`` for all together.

    ``common`` are the words with the highest shares, in lower case, chosen among the commonest of the language and of all
    documents. ``slots`` finds them: at the hash of a word with ``seed`` modulo its size stands the word's place in ``common``
    counted from 1, or 0; the seed is one with which no two common words meet. ``longest`` is the length of the longest.
    """
    words = rows.select(F.col("language_").alias("language"), F.explode(words_of(whole_text(rows, text))).alias("word"))
    counts = settle(words.groupBy("language", F.lower("word").alias("word")).agg(F.count("*").alias("n")), "words")
    sums = [F.sum(F.get("classes_", F.lit(i))).alias(f"c{i}") for i in range(CLASS_NUMBER)]
    classes = rows.groupBy(F.col("language_").alias("language")).agg(*sums)
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    # One row per language from here on.
    languages = settle(classes.join(totals, "language", "left").fillna(0, ["total"]), "languages")
    everything = languages.agg(F.sum("total"), *[F.sum(f"c{i}") for i in range(CLASS_NUMBER)]).first()
    all_words, all_classes = everything[0] or 0, [n or 0 for n in everything[1:]]
    pooled = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(limits.common_words)
    general = pooled.collect()

    class_share = [F.lit(n / max(1, sum(all_classes))) for n in all_classes]
    characters = sum((F.col(f"c{i}") for i in range(CLASS_NUMBER)), F.lit(0))
    shares = [_smoothed(F.col(f"c{i}"), characters, share, limits.prior_chars) for i, share in enumerate(class_share)]
    languages = languages.where(F.col("language") != ALL)
    languages = languages.select("language", "total", F.array(*shares).alias("class_shares"))
    alone = languages.sparkSession.createDataFrame([(ALL, 0)], "language string, total long")
    languages = languages.unionByName(alone.withColumn("class_shares", F.array(*class_share)))

    wanted = languages.select("language", F.explode(F.array(*[F.lit(row["word"]) for row in general]).cast("array<string>")).alias("word"))
    own = _commonest(counts.where(F.col("language") != ALL), limits.common_words)
    wanted = settle(wanted.unionByName(own.select("language", "word")).distinct(), "wanted")
    average = counts.join(wanted.select("word").distinct(), "word").groupBy("word").agg((F.sum("n") / max(1, all_words)).alias("average"))
    found = wanted.join(counts.where(F.col("language") != ALL), ["language", "word"], "left").join(average, "word")
    found = found.join(languages.select("language", "total"), "language")
    share = _smoothed(F.coalesce("n", F.lit(0)), F.col("total"), F.col("average"), limits.prior_words)
    found = found.select("language", "word", share.alias("share"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.col("share").desc(), "word"))
    found = found.withColumn("place", place).where(F.col("place") <= limits.common_words)
    top = found.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("place", "word", "share"))).alias("top"))

    def apart(seed: Column) -> Column:
        taken = F.transform("common", lambda word: _slot(word, seed, limits.slots))
        return F.size(F.array_distinct(taken)) == F.size("common")

    def table(taken: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(limits.slots - 1)), lambda i: F.array_position(taken, i).cast("int"))

    out = languages.join(top, "language", "left").select(
        "language",
        "class_shares",
        F.coalesce(F.transform("top", lambda x: x["word"]), F.array().cast("array<string>")).alias("common"),
        F.coalesce(F.transform("top", lambda x: x["share"]), F.array().cast("array<double>")).alias("common_shares"),
    )
    out = out.select(
        "*",
        F.coalesce(F.array_max(F.transform("common", F.char_length)), F.lit(0)).alias("longest"),
        # Seeds fail with a probability of two in three each.
        F.get(F.filter(F.sequence(F.lit(0), F.lit(511)), apart), F.lit(0)).alias("seed"),
    )
    slots = let(F.transform("common", lambda word: _slot(word, F.col("seed"), limits.slots)), table)
    return out.withColumn("slots", F.when(F.col("seed").isNull(), F.raise_error(F.lit("no seed parts the words"))).otherwise(slots))


def language_references(df: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The references of the documents of ``df``; see :func:`references_of`."""
    rows = df.select(df[text].alias("text"), df[lang].alias("lang"))
    return references_of(settle(measured(rows), "measured"), limits)


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to the divergence, in bits."""

    def half(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)

    return (half(p) + half(q)) / 2


def _root(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _share_of(n: Column, total: Column) -> Column:
    return n / F.greatest(total, F.lit(1))


def class_distance(classes: Column, n_chars: Column, class_shares: Column) -> Column:
    """The distance of counted character classes to the reference."""
    return _root(_sum(F.zip_with(classes, class_shares, lambda n, q: _term(_share_of(n, n_chars), q))))


def common_places(words: Column, reference: dict[str, Column], size: int) -> Column:
    """The places in ``common`` (from 1) of the common words among ``words``, ascending."""
    # No word is shorter in lower case.
    lower = F.transform(F.filter(words, lambda word: F.char_length(word) <= reference["longest"]), F.lower)

    def place(word: Column) -> Column:
        return F.get(reference["slots"], _slot(word, reference["seed"], size))

    return F.sort_array(F.transform(F.filter(lower, lambda word: F.get(reference["common"], place(word) - 1) == word), place))


def common_distance(part: Column, reference_part: Column) -> Column:
    """The distance of the two-bin histograms of common and other words."""
    return _root(_term(part, reference_part) + _term(1 - part, F.greatest(1 - reference_part, F.lit(0.0))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def word_distance(found: Column, n_words: Column, common_shares: Column) -> Column:
    """The distance of the common words to the reference; all other words are one bin. ``found`` are their places."""

    def divergence(found: Column) -> Column:
        runs = F.filter(
            F.transform(found, lambda at, i: F.struct(at.alias("at"), i.alias("i"), F.get(found, i + 1).alias("next"))),
            lambda x: F.coalesce(x["next"] != x["at"], F.lit(True)),
        )

        def add(so_far: Column, run: Column) -> Column:
            share = F.get(common_shares, run["at"] - 1)
            term = _term((run["i"] - so_far["last"]) / n_words, share)
            return F.struct(
                (so_far["sum"] + term).alias("sum"), (so_far["seen"] + share).alias("seen"), run["i"].alias("last")
            )

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("seen"), F.lit(-1).alias("last"))
        all_shares = _sum(common_shares)
        others = _term((n_words - F.size(found)) / n_words, F.greatest(1 - all_shares, F.lit(0.0)))
        return F.aggregate(runs, start, add, lambda end: end["sum"] + (all_shares - end["seen"]) / 2 + others)

    return _root(let(found, divergence))


def judge(df: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with the base counts, ``class_distance``, ``word_distance``, ``common_distance``, ``base_failed`` and ``kept``.

    A null text has no words and fails the base rules; a null language is held against all documents
    together; repeated rows are judged alike; an empty table gives an empty result. Distances are null
    below the minimum lengths. Columns of the new names are replaced; columns of any other name are kept.
    """
    kept_columns = [name for name in df.columns if name not in VERDICT]
    chosen = df.select(*[df[name] for name in kept_columns])
    rows, names = numbered(chosen)
    own_text, own_lang = names[kept_columns.index(text)], names[kept_columns.index(lang)]
    rows = settle(measured(rows, own_text, own_lang), "measured", pack=True)
    references = settle(references_of(rows, limits, own_text).withColumnRenamed("language", "language_"), "references")
    rows = join_small(rows, references, ["language_"], F.col(own_text))
    reference = {name: F.col(name) for name in references.columns}
    long_enough = F.col("n_words") >= limits.min_words
    found = common_places(words_of(whole_text(rows, own_text)), reference, limits.slots)
    rows = rows.withColumn("found_", F.when(long_enough, found))
    n_chars = _sum(F.col("classes_"))
    rows = rows.withColumns(
        {
            "class_distance": F.when(
                n_chars >= limits.min_chars, class_distance(F.col("classes_"), n_chars, F.col("class_shares"))
            ),
            "word_distance": F.when(long_enough, word_distance(F.col("found_"), F.col("n_words"), F.col("common_shares"))),
            "part_": F.when(long_enough, F.size("found_") / F.col("n_words")),
            "reference_part_": _sum(F.col("common_shares")),
        }
    )
    rows = rows.withColumn("common_distance", F.when(long_enough, common_distance(F.col("part_"), F.col("reference_part_"))))
    absent = limits.max_absence * common_distance(F.lit(0.0), F.col("reference_part_"))
    few = (F.col("part_") < F.col("reference_part_")) & (F.col("common_distance") > absent)
    far = (F.col("class_distance") > limits.max_class_distance) | (F.col("word_distance") > limits.max_word_distance)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    good = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)) & ~F.coalesce(few, F.lit(False))
    rows = rows.withColumn("kept", good)
    return rows.select(*names, *VERDICT).toDF(*kept_columns, *VERDICT)


def verdicts(df: DataFrame, limits: Limits = Limits(), id_column: str = "doc_id") -> DataFrame:
    """The verdict of every row of ``df`` by id, without its text."""
    rows = df.select(df[id_column].alias("doc_id"), df["text"].alias("text"), df["lang"].alias("lang"))
    return judge(rows, limits).drop("text", "lang")
