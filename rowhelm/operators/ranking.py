"""Most frequent values with ties in the order of the values themselves, whatever their length.

Long values are counted by digest, so their order is not in the key. It is found by order-keeping prefixes:

1. One job ranks the counted values of every column by count and then by their first ``HEAD`` characters, and
   brings the first k + 1 of each column to the driver. Values of up to 64 bytes are complete there.
2. Only if long values with one count and one head lie on both sides of rank k, the rows that begin with that head
   are read again and ranked by their next, longer piece; only the values tied at rank k go on to a further
   round. Pieces grow fourfold, so rounds are few; what is shuffled is digests and pieces, and what comes to the
   driver is at most k + 1 rows a round.
3. The whole texts of the chosen values, at most k a column, are picked out by a filter on their digests.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowhelm.functions.scalars import INLINE_KEY_BYTES, as_text, value_key
from rowhelm.operators.frequency import distinct_stats
from rowhelm.operators.melt import column_name, melt

HEAD = 64
GROWTH = 4


@dataclass(frozen=True)
class Ranked:
    """A counted value: its key, and its first characters (all of them if it is not long)."""

    key: str
    count: int
    head: str

    @property
    def long(self) -> bool:
        return self.key != self.head


def headed_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_no, key, head, cnt, chars)`` with one row per distinct non-null value, from one shuffle."""
    text = F.col("value")
    return (
        melt(df, columns, as_text)
        .filter(text.isNotNull())
        .select("col_no", value_key(text).alias("key"), F.when(F.octet_length(text) > INLINE_KEY_BYTES, F.left(text, F.lit(HEAD))).alias("head"), F.length(text).alias("chars"))
        .groupBy("col_no", "key", "head")
        .agg(F.count(F.lit(1)).alias("cnt"), F.max("chars").cast("bigint").alias("chars"))
    )


def _first(frame: DataFrame, order: list, n: int, by: Sequence[str] = ()) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(*order))
    return frame.withColumn("rank", rank).filter(F.col("rank") <= n)


def _settled(df: DataFrame, column: str, tied: Ranked, wanted: int) -> list[str]:
    """The keys of the ``wanted`` smallest among the long values of ``column`` with the count and head of ``tied``."""
    chosen, prefix, step = [], tied.head, HEAD * GROWTH
    texts = melt(df, [column], as_text).filter(F.octet_length("value") > INLINE_KEY_BYTES)
    while True:
        begin = F.left("value", F.lit(len(prefix)))
        piece = F.substring("value", len(prefix) + 1, step)
        # Equal prefixes are told by digest once they are long, so the query text stays short.
        same = begin == prefix if len(prefix) <= HEAD else F.sha2(begin, 256) == F.sha2(F.lit(prefix), 256)
        counted = texts.filter(same).groupBy(value_key(F.col("value")).alias("key"), piece.alias("piece")).count()
        rows = _first(counted.filter(F.col("count") == tied.count), ["piece", "key"], wanted + 1).orderBy("rank").collect()
        if len(rows) <= wanted or rows[wanted]["piece"] != rows[wanted - 1]["piece"]:
            return chosen + [r["key"] for r in rows[:wanted]]
        last = rows[wanted]["piece"]
        sure = [r["key"] for r in rows if r["piece"] < last]
        chosen, wanted = chosen + sure, wanted - len(sure)
        prefix, step = prefix + last, step * GROWTH


def top_keys(df: DataFrame, columns: Sequence[str], frequency: DataFrame, k: int) -> dict[int, list[Ranked]]:
    """The k most frequent values of each column by count, then value; long ones in the order of their heads.

    ``frequency`` is a ``headed_frequency``. Runs its jobs when called.
    """
    head = F.coalesce("head", "key")
    rows = _first(frequency, [F.desc("cnt"), head, F.col("head").isNotNull(), "key"], k + 1, ["col_no"])
    found = defaultdict(list)
    for row in rows.select("col_no", "rank", "key", "cnt", head.alias("head")).collect():  # k + 1 a column
        found[row["col_no"]].append((row["rank"], Ranked(row["key"], row["cnt"], row["head"])))
    chosen = {}
    for number, ranked in found.items():
        ordered = [value for _, value in sorted(ranked, key=lambda r: r[0])]
        best = ordered[:k]
        if len(ordered) > k and best:
            last, beyond = best[-1], ordered[k]
            if last.long and beyond.long and (last.count, last.head) == (beyond.count, beyond.head):
                sure = [v for v in best if (v.count, v.head) != (last.count, last.head) or not v.long]
                keys = _settled(df, columns[number], last, k - len(sure))
                best = sure + [Ranked(key, last.count, last.head) for key in keys]
        chosen[number] = best
    return chosen


def chosen_texts(df: DataFrame, columns: Sequence[str], chosen: dict[int, list[Ranked]]) -> DataFrame:
    """``(col_no, key, value, cnt)`` of the chosen values, with their whole texts."""
    spark = df.sparkSession
    rows = [(number, v.key, None if v.long else v.head, v.count) for number, values in chosen.items() for v in values]
    short = spark.createDataFrame(rows, "col_no int, key string, value string, cnt bigint")
    digests = {number: [v.key for v in values if v.long] for number, values in chosen.items()}
    digests = {number: keys for number, keys in digests.items() if keys}
    if not digests:
        return short
    names = [columns[number] for number in digests]
    numbers = F.array(*map(F.lit, digests))
    wanted = [(F.col("col_no") == at) & F.col("key").isin(keys) for at, keys in enumerate(digests.values())]
    any_of = wanted[0]
    for one in wanted[1:]:
        any_of = any_of | one
    texts = (
        melt(df, names, as_text)
        .filter(F.octet_length("value") > INLINE_KEY_BYTES)
        .withColumn("key", value_key(F.col("value")))
        .filter(any_of)
        .select(numbers[F.col("col_no")].alias("col_no"), "key", F.col("value").alias("text"))
        .distinct()  # at most k texts a column and task reach the shuffle
    )
    return short.join(texts, ["col_no", "key"], "left").select("col_no", "key", F.coalesce("text", "value").alias("value"), "cnt")


def _ranked(texts: DataFrame) -> DataFrame:
    order = Window.partitionBy("col_no").orderBy(F.desc("cnt"), "value")
    return texts.withColumn("rank", F.row_number().over(order).cast("bigint"))


def exact_top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """``(column, rank, value, cnt)``: the k most frequent values of each column, ties by value at any length."""
    chosen = top_keys(df, columns, headed_frequency(df, columns), k)
    return _ranked(chosen_texts(df, columns, chosen)).select(column_name(columns).alias("column"), "rank", "value", "cnt")


def text_statistics(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """``(column, unique_count, unique_percent, avg_length, top_values)`` with ties among top values by value."""
    frequency = headed_frequency(df, columns)
    top = (
        _ranked(chosen_texts(df, columns, top_keys(df, columns, frequency, k)))
        .groupBy("col_no")
        # At most k rows per column.
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", F.col("cnt").alias("count")))).alias("top"))
        .select(
            column_name(columns).alias("column"),
            F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top_values"),
        )
    )
    return distinct_stats(frequency, columns).join(top, "column")


