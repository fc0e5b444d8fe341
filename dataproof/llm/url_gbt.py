"""URL verdicts by rules and gradient-boosted trees on lexical features (operator 4).

The rules are matched first. URLs that a rule judges are the labelled examples; the trees learn from
them and judge all others.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.llm.common import join_small, settle

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled URLs learnt from at most, chosen by a hash of the URL.
MAX_LABELLED = 200_000
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "mark_ratio", "entropy",
            "parameters", "query_length", "has_fragment", "secure", "suffix_rate", "top_rate")


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct ``rule, verdict``; null if none does."""
    found = None
    for rule, verdict in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""

    def runs(letters: Column) -> Column:
        ends = F.filter(
            F.transform(letters, lambda x, i: F.when(F.coalesce(F.get(letters, i + 1) != x, F.lit(True)), i)), lambda i: i.isNotNull()
        )
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))

        def add(so_far: Column, end: Column) -> Column:
            share = (end - so_far["last"]) / F.size(letters)
            return F.struct((so_far["sum"] - share * F.log2(share)).alias("sum"), end.alias("last"))

        return F.aggregate(ends, start, add, lambda x: x["sum"])

    letters = F.sort_array(F.filter(F.split(text, ""), lambda x: x != ""))
    return F.get(F.transform(F.array(letters), runs), F.lit(0))


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, the lexical features, and the host's ``suffix`` (two labels) and ``top`` label."""
    value = F.coalesce(df[url], F.lit(""))
    rows = df.withColumns({"url_": value, "host": host_of(value), "path": path_of(value)})
    length = F.greatest(F.char_length("url_"), F.lit(1))
    query = F.regexp_extract("url_", r"\?([^#]*)", 1)
    return rows.withColumns(
        {
            "length": F.char_length("url_"),
            "host_length": F.char_length("host"),
            "path_length": F.char_length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
            "labels": F.size(F.split("host", r"\.")),
            "digit_ratio": F.regexp_count("url_", F.lit("[0-9]")) / length,
            "mark_ratio": F.regexp_count("url_", F.lit("[^0-9A-Za-z]")) / length,
            "entropy": _entropy(F.col("url_")),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
            "query_length": F.char_length(query),
            "has_fragment": F.contains("url_", F.lit("#")).cast("int"),
            "secure": F.startswith("url_", F.lit("https:")).cast("int"),
            "suffix": F.substring_index("host", ".", -2),
            "top": F.substring_index("host", ".", -1),
        }
    ).drop("url_")


def _rates(labelled: DataFrame, column: str, prior: float) -> DataFrame:
    """``column, folds, all``: smoothed block rates of all suffixes, over all folds and without each fold."""
    folds = F.array(*[F.lit(i) for i in range(FOLDS)])
    both = labelled.groupBy(column).agg(
        F.count("*").alias("n"),
        F.sum("blocked").alias("hits"),
        F.array(*[F.sum((F.col("fold") == i).cast("int")) for i in range(FOLDS)]).alias("n_fold"),
        F.array(*[F.sum(F.when(F.col("fold") == i, F.col("blocked")).otherwise(0)) for i in range(FOLDS)]).alias("hits_fold"),
    )
    without = F.transform(
        folds,
        lambda i: (F.col("hits") - F.get("hits_fold", i) + 10 * prior) / (F.col("n") - F.get("n_fold", i) + 10),
    )
    return both.select(
        column, without.alias(f"{column}_folds"), ((F.col("hits") + 10 * prior) / (F.col("n") + 10)).alias(f"{column}_all")
    )


def judge_urls(
    df: DataFrame, id_column: str = "page_id", url: str = "url", rules=RULES, trees: int = 20, depth: int = 4, most: int = MAX_LABELLED
) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every row of ``df``.

    The trees learn from ``most`` labelled URLs at most; the rates of suffixes are counted over all of them.

    A null URL, or one without ``://``, has an empty host and path. ``block_score`` is the trees'
    probability of a block; null where a rule decides. With no labelled URLs all others are allowed, with
    labels of one kind they get that verdict. Repeated URLs are judged alike, null ids kept, further
    columns not read; an empty table gives an empty result.
    """
    rows = lexical_features(df.select(df[id_column].alias("page_id"), df[url].alias("url")))
    rows = rows.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    rows = settle(rows.withColumns({"fold": fold, "blocked": (F.col("match.verdict") == "block").cast("int")}), "urls")
    labelled = rows.where(F.col("match").isNotNull())
    total, hits = labelled.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    out = [F.col("page_id"), F.col("host"), F.col("path"), F.col("match.rule").alias("rule")]
    if hits in (0, total):
        other = F.lit("block" if hits else "allow")
        return rows.select(
            *out, F.coalesce("match.verdict", other).alias("verdict"), F.lit(None).cast("double").alias("block_score")
        )
    prior = hits / total
    for column in ("suffix", "top"):
        rows = join_small(rows, settle(_rates(labelled, column, prior), "rates"), [column], F.col("url"))
        own = F.when(F.col("match").isNotNull(), F.get(f"{column}_folds", F.col("fold"))).otherwise(F.col(f"{column}_all"))
        rows = rows.withColumn(f"{column}_rate", F.coalesce(own, F.lit(prior)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    learnt = rows.where(F.col("match").isNotNull()).select("features", F.col("blocked").cast("double").alias("label"), "url", "page_id")
    if total > most:
        learnt = learnt.orderBy(F.xxhash64("url"), "url", "page_id").limit(most)
    learnt = settle(learnt.select("features", "label").repartition(8), "labelled")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1).fit(learnt)
    judged = model.transform(rows.select("page_id", "host", "path", "match", "features"))
    score = vector_to_array("probability")[1]
    judged = judged.withColumn("block_score", F.when(F.col("match").isNull(), score))
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return judged.select(*out, F.coalesce("match.verdict", own).alias("verdict"), "block_score")
