"""Sorting, order, ranks and distinct values under a collation.

Rows have no order of their own, so every verb that depends on one takes ``order_by``, which
must tell rows apart; it also breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.functions.patterns import collation, text
from glyphframe.functions.storage import columns, with_position, with_running_sum


#: What ``alternate_shifted`` ignores: white space and punctuation.
SHIFTED = r"[\p{Z}\p{P}\t-\r]"
#: Up to so many distinct texts are broadcast to the rows that they rank.
BROADCAST_ROWS = 200_000


def natural_key(string) -> Column:
    """Text with its digit runs filled up by zeros, so that they compare by value."""
    runs = F.regexp_extract_all(text(string), F.lit(r"\d+|\D+"), F.lit(0))
    def wide(r: Column) -> Column:
        digits = F.regexp_replace(r, "^0+(?=.)", "")
        return F.when(F.rlike(r, F.lit(r"^\d")), F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(r)

    return F.array_join(F.transform(runs, wide), "")


def equality_key(string, locale: str = "en", ignore_case: bool = False, numeric: bool = False, alternate_shifted: bool = False, **options) -> Column:
    """A column that is equal where the collation says that texts are."""
    options.setdefault("strength", 2 if ignore_case else 3)
    s = natural_key(string) if numeric else text(string)
    if alternate_shifted:
        s = F.regexp_replace(s, SHIFTED, "")
    return F.collate(s, collation(locale, **options))


def sort_keys(string, locale: str = "en", numeric: bool = False, **options) -> list[Column]:
    """Columns that sort as the collation does."""
    s = natural_key(string) if numeric else text(string)
    if options.pop("alternate_shifted", False):
        s = F.regexp_replace(s, SHIFTED, "")
    upper_first = options.pop("uppercase_first", None)
    options.pop("normalization", None)
    name = collation(locale, **options)
    keys = [F.collate(s, name)]
    if upper_first is not None:
        loose = F.collate(s, collation(locale, strength=2))
        cases = F.regexp_replace(F.regexp_replace(s, r"\p{Lu}", "A" if upper_first else "B"), r"\p{Ll}", "B" if upper_first else "A")
        keys = [loose, cases]
    return keys


def _directed(keys: list[Column], decreasing: bool, na_last: bool | None) -> list[Column]:
    if na_last is False:
        return [k.desc_nulls_first() if decreasing else k.asc_nulls_first() for k in keys]
    return [k.desc_nulls_last() if decreasing else k.asc_nulls_last() for k in keys]


def str_sort(df: DataFrame, string, order_by=None, decreasing: bool = False, na_last: bool | None = True, locale: str = "en", numeric: bool = False, **options) -> DataFrame:
    """Rows in the order of their text; nulls last, first (False) or left out (None)."""
    s = text(string)
    df = df.where(s.isNotNull()) if na_last is None else df
    ties = columns(order_by) if order_by is not None else []
    return df.orderBy(*_directed(sort_keys(s, locale, numeric, **options), decreasing, na_last), *ties)


def str_order(df: DataFrame, string, order_by, decreasing: bool = False, na_last: bool | None = True, locale: str = "en", numeric: bool = False, name: str = "order", **options) -> DataFrame:
    """Rows with ``name``: the place that their text has in order, from 1.

    The permutation that sorts is the order-by position of the rows with places 1, 2, ...
    """
    s = text(string)
    df = df.where(s.isNotNull()) if na_last is None else df
    keys = _directed(sort_keys(s, locale, numeric, **options), decreasing, na_last)
    return with_position(df, [*keys, *columns(order_by)], name)


def str_rank(df: DataFrame, string, order_by, locale: str = "en", numeric: bool = False, name: str = "rank", **options) -> DataFrame:
    """Rows with the rank of their text: ties have the least of their places, null has none.

    Only distinct texts, with their counts, are ordered; rows are neither sorted nor written.  Ranks are broadcast up to
    ``BROADCAST_ROWS`` distinct texts; beyond, they are joined by text.  ``order_by`` does not matter: ties share a rank.
    """
    keys = sort_keys(string, locale, numeric, **options)
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    counts = keyed.where(text(string).isNotNull()).groupBy(*names).agg(F.count("*").alias("__n"))
    ranked, n = with_running_sum(counts, names, "__n", "__before")
    ranked = ranked.select(*[F.col(x).alias(f"{x}r") for x in names], (F.col("__before") + 1).cast("long").alias("__rank"))
    on = [F.col(x) == F.col(f"{x}r") for x in names]
    joined = keyed.join(F.broadcast(ranked) if n <= BROADCAST_ROWS else ranked, on, "left")
    return joined.withColumn(name, F.col("__rank")).select(*df.columns, *([name] if name not in df.columns else []))


def str_unique(df: DataFrame, string, order_by, locale: str = "en", ignore_case: bool = False, **options) -> DataFrame:
    """The first row (in the order of ``order_by``) of each text; null counts as a text.

    An aggregate that is combined before its shuffle: copies never meet in one task.
    """
    key = equality_key(string, locale, ignore_case, **options)
    first = df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*df.columns), F.struct(*columns(order_by))).alias("__row"))
    return first.select("__row.*")


def str_duplicated(df: DataFrame, string, order_by, locale: str = "en", ignore_case: bool = False, name: str = "duplicated", **options) -> DataFrame:
    """Rows with whether an earlier row has the same text."""
    key = equality_key(string, locale, ignore_case, **options)
    place = F.struct(*columns(order_by))
    first = df.groupBy(key.alias("__first_key")).agg(F.min(place).alias("__first"))
    joined = df.withColumn("__own_key", key).join(first, F.col("__own_key").eqNullSafe(F.col("__first_key")))
    return joined.withColumn(name, place != F.col("__first")).select(*df.columns, name)
