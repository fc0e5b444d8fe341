"""How filters interact: what each removes in every order of application (operator 13).

Rows are numbered within ranges; a range keeps, for each part of the corpus, one sorted list of the numbers that fail
each filter, and one of the numbers that carry each label. Unions and differences of lists come from merges that
gallop over the longer list. What a filter removes after others depends only on the set of the others, so that each
filter and set is merged once per part and range; the sizes are added over all ranges, and the orders are read off the
sums. Lists never leave the task that numbers the range, a range holds one Arrow batch of rows, and only sizes are
shuffled, added up per task first, so a part of any size is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataproof.llm.common import settle, whole_text

SPACE = r"[\x20\x09-\x0D]+"
#: Text digests that this part of all rows or more have are joined by broadcast (so at most so many digests).
HOT_PART = 1024


def gallop(values: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """The places in the sorted ``values`` at which the sorted ``sought`` would stand.

    From the place of one number to that of the next the step doubles until it has passed it, and the last step
    is halved; all numbers gallop at once from where a coarse pass over every 64th of them left them.
    """
    if len(sought) == 0 or len(values) == 0:
        return np.zeros(len(sought), dtype=np.int64)
    low = np.repeat(np.searchsorted(values, sought[::64]), 64)[: len(sought)].astype(np.int64)
    high, step = low.copy(), 1
    running = np.flatnonzero((high < len(values)) & (values[np.minimum(high, len(values) - 1)] < sought))
    while len(running):
        low[running] = high[running] + 1
        high[running] = np.minimum(high[running] + step, len(values))
        step *= 2
        inside = high[running] < len(values)
        running = running[inside]
        running = running[values[high[running]] < sought[running]]
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        less = values[middle] < sought[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    return low


def difference(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What of the sorted list ``left`` is not in the sorted list ``right``."""
    place = gallop(right, left)
    inside = place < len(right)
    found = np.zeros(len(left), dtype=bool)
    found[inside] = right[place[inside]] == left[inside]
    return left[~found]


def union(lists: Sequence[np.ndarray]) -> np.ndarray:
    """The k-way merge of sorted lists without repeats; the shortest are merged first."""
    queue = sorted(lists, key=len)
    merged = queue[0]
    for longer in queue[1:]:
        short, long = sorted((merged, longer), key=len)
        new = difference(short, long)
        merged = np.insert(long, gallop(long, new), new)
    return merged


def posting_lists(flags: Mapping[str, np.ndarray], ids: np.ndarray) -> dict[str, np.ndarray]:
    """For each flag, the sorted ids that have it. Ids of one part are neighbours, so a list holds those of every part in turn."""
    order = np.argsort(ids)
    return {name: ids[order][flag[order]] for name, flag in flags.items()}


def removals(lists: Mapping[str, np.ndarray], filters: str, labels: Sequence[str]) -> Iterator[tuple[str, str, list[np.ndarray]]]:
    """For each set of filters and each other filter: the ids it removes after them, and those of them with each label."""
    gone = {"": np.zeros(0, dtype=np.int64)}
    for size in range(len(filters)):
        for before in map("".join, combinations(filters, size)):
            if before:
                gone[before] = union([gone[before[:-1]], lists[before[-1]]])
            for name in filters:
                if name not in before:
                    new = difference(lists[name], gone[before])
                    yield before, name, [new, *[difference(new, difference(new, lists[label])) for label in labels]]


def interaction_counts(df: DataFrame, filters: str, labels: Sequence[str], part: str = "part") -> DataFrame:
    """``part, before, filter, documents, removed`` and the removed rows with each label, over all rows of ``df``.

    ``df`` has a boolean column per filter (named by one letter) and per label; nulls count as false. ``before`` is the set
    of filters applied earlier, as text. ``documents`` is the number of rows of the part.
    """
    names = [*filters, *labels]
    numbers = ["documents", "removed", *labels]
    schema = ", ".join(["part string, before string, filter string", *[f"{name} long" for name in numbers]])

    def run(batches):
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            part_of, number = coded.indices.to_numpy(), len(coded.dictionary)
            # Part and row in one number: the lists of all parts are merged at once and their sizes are counted by part.
            ids = part_of.astype(np.int64) * batch.num_rows + np.arange(batch.num_rows)
            found = {x: batch.column(i + 1).fill_null(False).to_numpy(zero_copy_only=False) for i, x in enumerate(names)}
            documents = np.bincount(part_of, minlength=number)
            for before, name, lists in removals(posting_lists(found, ids), filters, labels):
                sizes = [pa.array(np.bincount(x // batch.num_rows, minlength=number)) for x in lists]
                fixed = [pa.array([x] * number, pa.string()) for x in (before, name)]
                columns = [coded.dictionary, *fixed, pa.array(documents), *sizes]
                yield pa.RecordBatch.from_arrays(columns, ["part", "before", "filter", *numbers])

    ready = df.select(F.coalesce(df[part].cast("string"), F.lit("")).alias("part"), *[df[name] for name in names])
    added = ready.mapInArrow(run, schema).groupBy("part", "before", "filter")
    return added.agg(*[F.sum(name).alias(name) for name in numbers])


def audit(df: DataFrame, filters: str, labels: Sequence[str], part: str = "part") -> DataFrame:
    """A row per part, order of all ``filters`` and step, with what the step's filter does there.

    Columns: ``part, filter_order, step, filter, kept, removed, redundant, unique_fails``, the removed rows of each
    label (named as the label), and ``shapley``, what the filter removes summed over all orders. A part without any failing
    row has rows of zeros; an empty table gives no rows; a null part is the empty text.
    """
    counts = settle(interaction_counts(df, filters, labels, part), "interactions")
    spark = df.sparkSession
    all_others = {name: "".join(x for x in filters if x != name) for name in filters}
    steps = []
    for order in permutations(filters):
        for step, name in enumerate(order):
            steps.append(("".join(order), step + 1, name, "".join(sorted(order[:step], key=filters.index))))
    # Factorially many rows in the filters alone (600 for five), whatever the table holds.
    plan = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before string"))
    single = {name: _total(name, "") for name in filters}
    alone = {name: _total(name, all_others[name]) for name in filters}
    weighted = F.sum(F.col("removed") * _orders(filters))
    per_filter = counts.groupBy("part", "filter").agg(
        weighted.alias("shapley"),
        _by_filter(single).alias("fails"),
        _by_filter(alone).alias("unique_fails"),
    )
    at = counts.join(plan, ["before", "filter"]).join(per_filter, ["part", "filter"])
    # A part has as many rows here as there are orders and steps, so a window over one order is short.
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return at.select(
        "part",
        "filter_order",
        "step",
        "filter",
        (F.col("documents") - F.sum("removed").over(so_far)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *labels,
        "shapley",
    )


def _total(name: str, before: str) -> Column:
    return F.sum(F.when((F.col("filter") == name) & (F.col("before") == before), F.col("removed")).otherwise(0))


def _by_filter(totals: Mapping[str, Column]) -> Column:
    chosen = F.lit(None).cast("long")
    for name, total in totals.items():
        chosen = F.when(F.col("filter") == name, total).otherwise(chosen)
    return chosen


def _orders(filters: str) -> Column:
    """In how many orders exactly the filters of ``before`` stand ahead of one other filter."""
    factorial = [1]
    for number in range(1, len(filters) + 1):
        factorial.append(factorial[-1] * number)
    chosen = F.lit(0)
    for size in range(len(filters)):
        ways = factorial[size] * factorial[len(filters) - 1 - size]
        chosen = F.when(F.length("before") == size, F.lit(ways)).otherwise(chosen)
    return chosen


def repeated(rows: DataFrame, key: str, id_column: str) -> DataFrame:
    """``rows`` with ``repeated``: whether a row with a smaller id has the same ``key``.

    Keys are counted per task before the shuffle. Keys of one row need no join; those that 1/1024 of all rows or
    more have are joined by broadcast, so that no task gets all rows of a frequent key.
    """
    groups = rows.groupBy(key).agg(F.min(id_column).alias("least_"), F.max(id_column).alias("most_"), F.count("*").alias("times_"))
    groups = settle(groups.where(F.col("most_") > F.col("least_")).drop("most_"), "repeated")
    number = rows.count()
    hot = groups.where(F.col("times_") * HOT_PART >= number).select(F.col(key).alias("hot_"), F.col("least_").alias("hot_least_"))
    cool = groups.where(F.col("times_") * HOT_PART < number).select(F.col(key).alias("cool_"), F.col("least_").alias("cool_least_"))
    joined = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_"), "left")
    # Rows that the broadcast has answered meet no key of the shuffle, and spread.
    elsewhere = F.concat(F.col(key), F.lit("answered").cast("binary"), F.xxhash64(id_column).cast("string").cast("binary"))
    joined = joined.withColumn("ask_", F.when(F.col("hot_").isNull(), F.col(key)).otherwise(elsewhere))
    joined = joined.join(cool, F.col("ask_") == F.col("cool_"), "left")
    least = F.coalesce("hot_least_", "cool_least_")
    out = joined.withColumn("repeated", F.coalesce(F.col(id_column) > least, F.lit(False)))
    return out.drop("hot_", "hot_least_", "cool_", "cool_least_", "ask_")


def document_filters(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, the filters ``A`` to ``E`` and the labels ``good_lost`` and ``toxic_lost`` of every row of ``df``.

    A: under 50 words. B: fewer than 65 % of the words are distinct. C: more than 5 % of the code points are A to Z.
    D: one of ``#$%&*|`` occurs. E: a smaller doc_id has the same text. A null text is the empty text, which
    fails only A (and E). A null doc_id is neither smaller than another nor has a smaller one, and has no labels; of several
    labels of one id the largest counts; texts are told apart by 128 bits.
    """
    text = whole_text(df)
    words = F.filter(F.split("text", SPACE), lambda word: word != "")
    rows = df.select(df["doc_id"].alias("doc_id"), F.coalesce(df["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    counted = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.lit(0))
    rows = rows.select(
        "doc_id",
        "part",
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        counted.alias("words"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.char_length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    rows = rows.select(
        "doc_id", "part", "digest", (F.col("words.n") < 50).alias("A"), (100 * F.col("words.d") < 65 * F.col("words.n")).alias("B"), "C", "D"
    )
    rows = repeated(settle(rows, "flags"), "digest", "doc_id").withColumnRenamed("repeated", "E").drop("digest")
    marked = labels.where(labels["doc_id"].isNotNull()).groupBy(F.col("doc_id").alias("label_id_"))
    marked = marked.agg((F.max("quality") == 1).alias("good_lost"), (F.max("toxic") == 1).alias("toxic_lost"))
    return rows.join(marked, F.col("doc_id") == F.col("label_id_"), "left").drop("label_id_")


def filter_audit(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five document filters over all rows of ``df``, by source."""
    rows = audit(document_filters(df, labels), "ABCDE", ["good_lost", "toxic_lost"])
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
