"""Filtered pages of tables with their totals, records by id, and the part of a graph that fits on a screen."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest page.
MOST = 1000


@dataclass(frozen=True)
class Listing:
    """How a table is searched: ``search`` columns hold the text in any case, ``equal`` ones are the value in any case, ``holds`` ones contain it, ``exact`` ones are it."""

    search: tuple[str, ...] = ()
    equal: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict)


# What each list can be searched and filtered by.
LISTINGS = {
    "news": Listing(search=("title", "content")),
    "events": Listing(search=("title", "evidence_text"), equal=("severity",), holds=("event_type",)),
    "alerts": Listing(equal=("risk_band",), exact=("supplier_id", "event_id"), names={"risk_level": "risk_band"}),
    "suppliers": Listing(search=("supplier_name", "supplier_id", "industry"), equal=("country", "tier", "criticality")),
    "products": Listing(search=("product_name", "product_id", "category"), equal=("category",)),
    "locations": Listing(search=("location_name", "city", "location_id"), equal=("country",)),
}


def _text(df: DataFrame, x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit("")) if x in df.columns else F.lit("")


def filtered(df: DataFrame, listing: Listing, search: str | None = None, pattern: str | None = None, **values: str | None) -> DataFrame:
    """The rows that all given filters keep; one that is None or empty keeps every row.

    ``search`` is found in one of the search columns, in any case; ``pattern`` is a regular expression for the same
    columns. Columns that the table lacks are empty text, nulls too. A filter that the list does not have is an error.
    """
    t = lambda x: _text(df, x)
    some = lambda tests: F.lit(False) if not tests else tests[0] if len(tests) == 1 else tests[0] | some(tests[1:])
    if search:
        df = df.where(some([F.contains(F.lower(t(x)), F.lit(search.lower())) for x in listing.search]))
    if pattern:
        df = df.where(some([t(x).rlike("(?iu)" + pattern) for x in listing.search]))
    for name, value in values.items():
        x = listing.names.get(name, name)
        if x not in (*listing.equal, *listing.holds, *listing.exact):
            raise ValueError(f"no filter by {name}")
        if not value:
            continue
        if x in listing.equal:
            df = df.where(F.upper(t(x)) == value.upper())
        elif x in listing.holds:
            df = df.where(F.contains(F.lower(t(x)), F.lit(value.lower())))
        else:
            df = df.where(t(x) == value)
    return df


def page(df: DataFrame, *order: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """The rows from ``offset`` on, at most ``limit``, and in _total how many there are in all; ``order`` must be total.

    The total is an aggregate of one row. A page beyond the end is empty. Bounds as the lists have them, others are errors.
    """
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"a page has 1 to {MOST} rows and starts at 0 or later")
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.join(F.broadcast(df.agg(F.count("*").alias("_total"))))


def by_id(df: DataFrame, column: str, value: str, *order: str) -> DataFrame:
    """The first row whose trimmed ``column`` is ``value``; none if there is no such row."""
    rows = df.where(F.trim(F.col(column).cast("string")) == value)
    return (rows.orderBy(*order) if order else rows).limit(1)


#: Nodes of each type on the screen, from news to products.
SHOWN = {"NEWS": 3, "EVENT": 5, "LOCATION": 5, "SUPPLIER": 10, "PRODUCT": 10}


def shown_nodes(nodes: DataFrame, shown: dict[str, int] | None = SHOWN, most: int = 35) -> DataFrame:
    """The nodes of ``display_graph``, which don't depend on the edges."""
    ids = nodes.where("node_id is not null")
    if shown is None:
        return ids.orderBy("node_id").limit(most)
    place = F.row_number().over(Window.partitionBy("node_type").orderBy("node_id"))
    bound = F.create_map(*[F.lit(x) for t, n in shown.items() for x in (t, n)])
    return ids.where(F.col("node_type").isin(*shown)).withColumn("_n", place).where(F.col("_n") <= max(shown.values())).where(F.col("_n") <= F.element_at(bound, F.col("node_type"))).drop("_n")


def display_graph(nodes: DataFrame, edges: DataFrame, shown: dict[str, int] | None = SHOWN, most: int = 35) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first ``shown`` nodes of each type by id, or of the first ``most`` nodes where ``shown`` is None; edges are those among them.

    The numbers are the feature. Spark keeps that many rows of each partition before it exchanges any. No edge is made
    up where the nodes have none between them. Types that aren't named are not shown.
    """
    some = shown_nodes(nodes, shown, most)
    bounded = F.broadcast(some.select("node_id"))  # at most the numbers above
    inner = edges.join(bounded.withColumnRenamed("node_id", "source"), "source", "left_semi").join(bounded.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return some, inner.select(*edges.columns)
