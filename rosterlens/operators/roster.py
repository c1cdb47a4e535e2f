"""Rosters of companies: cleaning, keep-first and keep-last, joins with defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..functions.urls import roster_key

COMPANY_COLUMNS = ("Company", "Company Name")


def company_column(columns: Sequence[str], aliases: Sequence[str] = COMPANY_COLUMNS) -> str:
    found = next((a for a in aliases if a in columns), None)
    if found is None:
        raise ValueError(f"none of the columns {list(aliases)} is there")
    return found


def clean_roster(sheet: DataFrame, ord_col: str | None = None, aliases: Sequence[str] = COMPANY_COLUMNS, website: str = "Website") -> DataFrame:
    """(ord, name, website): nulls and blanks gone, the first row of each company and site kept."""
    name = company_column(sheet.columns, aliases)
    if website not in sheet.columns:
        raise ValueError(f"column {website!r} is missing")
    order = F.col(ord_col) if ord_col else F.monotonically_increasing_id()
    rows = sheet.select(order.alias("ord"), F.col(name).alias("name"), F.col(website).alias("website")).dropna(subset=["name", "website"])
    rows = rows.select("ord", strip(F.col("name").cast("string")).alias("name"), strip(F.col("website").cast("string")).alias("website")).filter("name <> '' and website <> ''")
    return keep_first(rows.withColumns({"__n": F.lower("name"), "__w": roster_key(F.col("website"))}), ["__n", "__w"], "ord").drop("__n", "__w")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of least order for each key; a hot key is reduced before it is dealt."""
    return _keep(df, keys, F.min, order)


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return _keep(df, keys, F.max, order)


def _keep(df: DataFrame, keys: Sequence[str], pick, order: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(pick(F.struct(order, *others)).alias("__best"))
    return best.select(*keys, "__best.*").select(*df.columns)


def left_with_defaults(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left outer join; missing values of the right side become defaults."""
    out = left.join(right, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v) if not isinstance(v, Column) else v) for c, v in defaults.items()})


def qualified(ranked: DataFrame, profiles: DataFrame, key: str = "website") -> DataFrame:
    return ranked.join(profiles.select(key), key, "left_semi")


def unseen(links: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    return links.join(visited.select(key), key, "left_anti")


def fresh(cache: DataFrame, as_of: Column, at: str = "cached_at", hours: int = 24) -> DataFrame:
    """Rows not older than the limit; exactly at the limit is still fresh."""
    return cache.filter(F.col(at) >= as_of - F.make_interval(hours=F.lit(hours)))


def merge_texts(pages: DataFrame, group: str, order: str, text: str, most: int = 2800, least: int = 40, tokens: int = 14) -> DataFrame:
    """(group, merged): distinct sentences of a group's pages in order, until ``most`` characters.

    Sentences are exploded and numbered. As each kept one takes at least ``least`` characters
    of the budget, only so many of a group can matter: each task passes on that number of
    first ones, so that no task holds a group's texts, however large the group.
    """
    from ..functions import text as T

    few = most // (least + 1) + 1

    rows = pages.select(group, F.col(order).alias("__o"), F.posexplode(T.sentences(T.clean_text(F.col(text)))).alias("__p", "s"))
    rows = rows.filter(F.length("s") >= least).withColumn("__sig", T.signature(F.col("s"), tokens))
    rows = keep_first(rows.select(group, "__sig", F.struct("__o", "__p").alias("__at"), "s"), [group, "__sig"], "__at")
    by = Window.partitionBy(group).orderBy("__at")
    rows = rows.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= few)
    before = F.sum(F.length("s") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < most + 1)
    joined = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__at", "s"))).alias("l"))
    return joined.select(group, F.substring(F.array_join(F.transform("l", lambda x: x["s"]), " "), 1, most).alias("merged"))


def coverage(pages: DataFrame, group: str, has_data: Column) -> DataFrame:
    """(group, coverage): share of pages with any data, four places."""
    return pages.groupBy(group).agg(F.round(F.count_if(has_data) / F.count("*"), 4).alias("coverage"))


def merged_lists(rows: DataFrame, group: str, order: str, lists: Sequence[str], first: Sequence[str]) -> DataFrame:
    """Lists of a group in order, distinct without case, and the first non-blank of other columns."""
    from ..functions.arrays import distinct_ignoring_case

    aggs = [F.array_sort(F.collect_list(F.struct(order, c))).alias(c) for c in lists]
    aggs += [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c) for c in first]
    out = rows.groupBy(group).agg(*aggs)
    field = lambda c: lambda x: x[c]
    return out.withColumns({c: distinct_ignoring_case(F.flatten(F.transform(c, field(c)))) for c in lists})
