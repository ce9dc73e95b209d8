"""Read views over the catalog: filters, ordered daily / sectioned / favourites
views, date navigation and the per-date counts shown with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cap_authors, count_label, tier_rank
from .ordering import ordered_positions


def _date(d) -> Column:
    return d.cast("date") if isinstance(d, Column) else F.lit(d).cast("date")


# -- filters ----------------------------------------------------------------
def by_date(catalog: DataFrame, d) -> DataFrame:
    """FL-02: papers added on ``d`` (a partition filter on the stored catalog)."""
    return catalog.filter(F.col("date_added") == _date(d))


def favourites(catalog: DataFrame) -> DataFrame:
    """FL-03."""
    return catalog.filter(F.col("is_favourite"))


def missing_thumbnails(catalog: DataFrame, d=None) -> DataFrame:
    """FL-04: (paper_id, comment, abstract) of papers without a thumbnail."""
    c = catalog.filter(F.col("thumbnail").isNull())
    if d is not None:
        c = c.filter(F.col("date_added") == _date(d))
    return c.select("paper_id", "comment", "abstract")


def by_id(catalog: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FL-05: (papers whose id is listed, listed ids the catalog lacks)."""
    keys = ids.select("paper_id").distinct()
    return (catalog.join(keys, "paper_id", "left_semi"),
            keys.join(catalog.select("paper_id"), "paper_id", "left_anti"))


# -- ordering ---------------------------------------------------------------
def daily_order() -> list[Column]:
    """SO-01 order: tier rank, then title in byte order, id as tie-breaker."""
    return [tier_rank("relevance_tier"), F.col("title").asc_nulls_first(), F.col("paper_id")]


def _keep(df: DataFrame, columns, needed) -> DataFrame:
    """Prune to ``columns`` (+ what the ordering needs) before rows are
    numbered, so only those columns are sorted and materialised."""
    if columns is None:
        return df
    cols = list(dict.fromkeys([*needed, *columns]))
    return df.select(*cols)


ORDER_COLS = ("date_added", "relevance_tier", "title", "paper_id")


def daily_view(catalog: DataFrame, d=None, columns=None) -> DataFrame:
    """SO-01: papers of a date (all dates when ``d`` is None) with their display
    position ``pos`` inside the date; ``columns`` limits the carried columns."""
    c = catalog if d is None else by_date(catalog, d)
    return ordered_positions(_keep(c, columns, ORDER_COLS), ["date_added"], daily_order())


def favourites_view(catalog: DataFrame, columns=None) -> DataFrame:
    """SO-02 + WN-06: favourites, newest date first then title, with a global
    ``pos`` and ``is_header`` on the first paper of each date group."""
    f = _keep(favourites(catalog), columns, ORDER_COLS)
    first = f.groupBy("date_added").agg(F.min(F.struct("title", "paper_id")).alias("_first"))
    f = (f.join(first, "date_added")
          .withColumn("is_header", F.struct("title", "paper_id") == F.col("_first")).drop("_first"))
    return ordered_positions(f, [], [F.col("date_added").desc(), F.col("title").asc_nulls_first(),
                                     F.col("paper_id")])


def latest_date(catalog: DataFrame) -> DataFrame:
    """One row: the newest date that has papers (no rows for an empty catalog)."""
    return catalog.agg(F.max("date_added").alias("date_added")).filter(F.col("date_added").isNotNull())


def latest_view(catalog: DataFrame, columns=None) -> DataFrame:
    """SO-03: the daily view of the newest date with papers."""
    newest = latest_date(catalog)
    c = catalog.join(F.broadcast(newest), "date_added", "left_semi")  # one-row side
    return ordered_positions(_keep(c, columns, ORDER_COLS), ["date_added"], daily_order())


def section_of(fav: Column, tier: Column) -> Column:
    """Section a paper is shown in: favourites first (any tier), then high,
    then moderate; other/null tiers of non-favourites are shown nowhere."""
    return (F.when(fav, F.lit("favourites")).when(tier == "high", F.lit("high"))
             .when(tier == "moderate", F.lit("moderate")))


def sectioned_view(catalog: DataFrame, d=None, columns=None, materialize: bool = True) -> DataFrame:
    """SO-04: shown papers with ``section`` and position inside the section.

    ``materialize=False`` is for inputs read in a fixed order (a stored or
    checkpointed catalog); see :func:`ordered_positions`."""
    c = catalog if d is None else by_date(catalog, d)
    c = c.withColumn("section", section_of(F.col("is_favourite"), F.col("relevance_tier")))
    c = _keep(c.filter(F.col("section").isNotNull()), columns, (*ORDER_COLS, "section"))
    return ordered_positions(c, ["date_added", "section"], daily_order(), materialize=materialize)


# -- counts -----------------------------------------------------------------
def available_dates(catalog: DataFrame) -> DataFrame:
    """AG-01: (date_added, n_papers), newest first."""
    return (catalog.groupBy("date_added").agg(F.count(F.lit(1)).alias("n_papers"))
            .orderBy(F.col("date_added").desc()))


def section_counts(catalog: DataFrame) -> DataFrame:
    """AG-03: per date the section sizes, the total and the number shown."""
    fav = F.col("is_favourite")
    tier = F.col("relevance_tier")
    return catalog.groupBy("date_added").agg(
        F.count_if(fav).alias("favourites"),
        F.count_if(~fav & (tier == "high")).alias("high"),
        F.count_if(~fav & (tier == "moderate")).alias("moderate"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(section_of(fav, tier).isNotNull()).alias("n_shown"),
    ).withColumn("count_label", count_label(F.col("n_total")))


def favourites_total(catalog: DataFrame) -> DataFrame:
    """AG-04: one row with the number of favourites."""
    return favourites(catalog).agg(F.count(F.lit(1)).alias("n_favourites"))


def date_nav(dates: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """WN-01: (date_added, prev_date, next_date) over the dates that have papers.

    ``dates`` has one row per date (AG-01 output), so the un-partitioned
    window sorts a table whose size is the number of days, not of papers.
    A requested date without papers gets (null, null).
    """
    d = dates.select("date_added").distinct()
    w = Window.orderBy("date_added")
    nav = d.select("date_added", F.lag("date_added").over(w).alias("prev_date"),
                   F.lead("date_added").over(w).alias("next_date"))
    if requested is None:
        return nav
    return requested.select(F.col("date_added").cast("date")).join(nav, "date_added", "left")


def date_option_label(dates: DataFrame, current) -> DataFrame:
    """PR-10: ``YYYY-MM-DD (n)`` option text and the selected flag."""
    return dates.select(
        "date_added",
        F.format_string("%s (%d)", F.col("date_added").cast("string"), F.col("n_papers")).alias("label"),
        (F.col("date_added") == _date(current)).alias("selected"))


def card_projection(catalog: DataFrame, view: str = "daily") -> DataFrame:
    """PR-03: what a paper card shows and which controls it offers."""
    fav = F.coalesce(F.col("is_favourite"), F.lit(False))
    dis = F.coalesce(F.col("is_dismissed"), F.lit(False))
    return catalog.select(
        "paper_id",
        F.when(F.col("relevance_tier") == "high", "HIGH").otherwise("MOD").alias("badge"),
        cap_authors("authors").alias("authors_line"),
        F.coalesce(F.col("favourite_note"), F.lit("")).alias("note"),
        (dis & ~fav).alias("collapsed"),
        ((~fav) & F.lit(view != "favourites")).alias("show_dismiss"),
        (~dis | fav).alias("show_star"),
    )
