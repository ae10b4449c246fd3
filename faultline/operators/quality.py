"""Audits of a pack of tables, rules that split a table into accepted and quarantined rows, and checks of requests.

An audit is a set of measures (file, measure, item, n), each an aggregate of its table; one last grouping by file turns
them into reports. Rules become one column of reasons, so that a table is split in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import engine
from faultline.operators.connect import cut


@dataclass(frozen=True)
class Link:
    """Values of ``column`` in ``table`` must be among those of ``parent_column`` in ``parent``."""

    table: str
    column: str
    parent: str
    parent_column: str

    @property
    def name(self) -> str:
        return f"{self.column}->{self.parent}.{self.parent_column}"


# Ids, composite keys and references of the pack's tables.
IDS = {"suppliers": "supplier_id", "products": "product_id", "locations": "location_id", "news": "article_id", "events": "event_id", "nodes": "node_id", "risk_labels": "entity_id"}
COMPOSITES = {"supplier_products": ("supplier_id", "product_id"), "supplier_locations": ("supplier_id", "location_id"), "edges": ("source", "target", "edge_type")}
LINKS = (
    Link("supplier_products", "supplier_id", "suppliers", "supplier_id"), Link("supplier_products", "product_id", "products", "product_id"),
    Link("supplier_locations", "supplier_id", "suppliers", "supplier_id"), Link("supplier_locations", "location_id", "locations", "location_id"),
    Link("events", "article_id", "news", "article_id"), Link("events", "location_id", "locations", "location_id"), Link("news_entities", "article_id", "news", "article_id"),
    Link("risk_labels", "entity_id", "suppliers", "supplier_id"), Link("edges", "source", "nodes", "node_id"), Link("edges", "target", "nodes", "node_id"),
)


def missing_columns(df: DataFrame, expected: tuple[str, ...]) -> list[str]:
    """The expected columns that ``df`` lacks, in their order; known before anything runs."""
    have = set(df.columns)
    return [x for x in expected if x not in have]


def _measures(name: str, pack: dict[str, DataFrame], links: tuple[Link, ...]) -> list[DataFrame]:
    df = pack[name]

    def one(measure: str, n: Column, of: DataFrame, item: str = "") -> DataFrame:
        return of.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("file"), F.lit(measure).alias("measure"), F.lit(item).alias("item"), "n")

    kind = engine.provenance(F.col("data_status").cast("string")) if "data_status" in df.columns else F.lit("unknown")
    whole = {("rows", ""): F.count("*"), **{("status", s): F.count_if(kind == s) for s in ("synthetic", "real", "unknown")}, **{("missing", x): F.count_if(F.col(f"`{x}`").isNull()) for x in df.columns}}
    parts = [F.struct(F.lit(m).alias("measure"), F.lit(i).alias("item"), F.col(f"_{at}").alias("n")) for at, (m, i) in enumerate(whole)]
    out = [df.agg(*[v.alias(f"_{at}") for at, v in enumerate(whole.values())]).select(F.explode(F.array(*parts)).alias("s")).select(F.lit(name).alias("file"), "s.*")]
    if IDS.get(name) in df.columns:
        out.append(one("duplicate_ids", F.count("*"), engine.duplicate_ids(df, IDS[name])))
    key = COMPOSITES.get(name, ())
    if key and not missing_columns(df, key):
        out.append(one("duplicate_relationships", F.max("extra_rows"), engine.duplicate_relationships(df, list(key))))
    for x in links:
        if x.table == name and x.parent in pack and x.column in df.columns and x.parent_column in pack[x.parent].columns:
            out.append(one("orphans", F.count("*"), engine.orphans(df, x.column, pack[x.parent], x.parent_column), x.name))
    return out


def reports(pack: dict[str, DataFrame], expected: dict[str, tuple[str, ...]] | None = None, links: tuple[Link, ...] = LINKS) -> DataFrame:
    """One row for each table of ``pack``: rows, columns, missing columns, nulls in all and by column, ids that repeat, rows beyond the first of a composite key, orphans by reference, provenance, validity.

    A table is valid if it has its ``expected`` columns, no id repeats and no reference is an orphan; nulls and
    repeated relationships do not count against it. Orphans are distinct trimmed values; nulls are none, and an empty
    parent has none. An empty table is valid. References to tables or columns that are not there are left out.
    """
    parts = [m for name in pack for m in _measures(name, pack, links)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = lambda m, item=None: F.coalesce(F.sum(F.when((F.col("measure") == m) & (F.lit(item is None) | (F.col("item") == (item or ""))), F.col("n"))), F.lit(0)).cast("long")
    listed = lambda m: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("measure") == m) & (F.col("n") > 0), F.struct("item", "n")))))
    wide = every.groupBy("file").agg(
        total("rows").alias("row_count"), total("missing").alias("total_missing_cells"), total("duplicate_ids").alias("duplicate_ids"), total("duplicate_relationships").alias("duplicate_relationships"),
        total("orphans").alias("total_invalid_refs"), *[total("status", s).alias(f"{s}_rows") for s in ("synthetic", "real", "unknown")], listed("missing").alias("missing_by_column"), listed("orphans").alias("invalid_references"),
    )
    lacks = {name: missing_columns(df, (expected or {}).get(name, ())) for name, df in pack.items()}
    lacking, width = F.lit(""), F.lit(0)
    for name, df in pack.items():
        lacking = F.when(F.col("file") == name, F.lit(", ".join(lacks[name]))).otherwise(lacking)
        width = F.when(F.col("file") == name, F.lit(len(df.columns))).otherwise(width)
    wide = wide.withColumns({"column_count": width, "missing_columns": lacking})
    return wide.withColumn("is_valid", (F.col("missing_columns") == "") & (F.col("duplicate_ids") == 0) & (F.col("total_invalid_refs") == 0))


def pack_summary(reported: DataFrame) -> DataFrame:
    """The totals over the rows of ``reports``; an empty pack is valid."""
    sums = {"total_records": "row_count", "synthetic_records": "synthetic_rows", "real_records": "real_rows", "total_missing_cells": "total_missing_cells", "total_duplicate_ids": "duplicate_ids", "total_invalid_foreign_keys": "total_invalid_refs"}
    added = [F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in sums.items()]
    return reported.agg(F.count("*").alias("total_files"), *added, F.coalesce(F.bool_and("is_valid"), F.lit(True)).alias("all_files_valid"))


def report_lines(reported: DataFrame) -> DataFrame:
    """(file, line): each report as a line of text, VALID or FLAGGED at its end."""
    n = lambda x: F.col(x).cast("string")
    real = F.concat(n("synthetic_rows"), F.lit(" / "), n("real_rows"))
    cells = [F.concat("file", F.lit(".csv")), n("row_count"), n("column_count"), n("total_missing_cells"), n("duplicate_ids"), n("total_invalid_refs"), real, F.when(F.col("is_valid"), "VALID").otherwise("FLAGGED")]
    return reported.select("file", F.concat_ws(" | ", *[F.rpad(x, w, " ") for x, w in zip(cells[:-1], (22, 7, 5, 8, 7, 12, 18), strict=True)], cells[-1]).alias("line"))


# --- quarantine


@dataclass(frozen=True)
class Split:
    """Both have the columns of the table; those of ``quarantined`` are followed by the reasons."""

    accepted: DataFrame
    quarantined: DataFrame


def checked(df: DataFrame, rules: dict[str, Column], unique: tuple[str, ...] = (), parents: dict[str, tuple[DataFrame, str]] | None = None, into: str = "reasons") -> DataFrame:
    """``df`` and, in ``into``, the names of the rules that each row breaks, in their order; an empty array if it breaks none.

    ``rules`` are conditions of a row; one that is null is broken. ``unique`` are columns whose values may occur once:
    every row of a value that repeats breaks ``<column> repeats``. ``parents`` maps columns to a table and its column:
    a value that is not there breaks ``<column> unknown``, compared as trimmed text; an empty parent knows nothing. Nulls
    neither repeat nor are unknown; a rule says whether they may be. Only values that repeat, and distinct parents,
    are joined. A table that has ``into`` already is an error.
    """
    if into in df.columns:
        raise ValueError(f"the table has a column {into} already")
    found = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]
    for x in unique:
        mark = f"_twice_{x}"
        df = df.join(engine.duplicate_ids(df, x).select(F.col(x).alias(f"_k_{x}"), F.lit(True).alias(mark)), F.col(x) == F.col(f"_k_{x}"), "left").drop(f"_k_{x}")
        found.append(F.when(F.col(mark), F.lit(f"{x} repeats")))
    for x, (parent, column) in (parents or {}).items():
        mark, key = f"_known_{x}", F.trim(F.col(x).cast("string"))
        held = parent.select(F.trim(F.col(column).cast("string")).alias(f"_p_{x}")).where(f"_p_{x} is not null").distinct().withColumn(mark, F.lit(True))
        df = df.join(held, key == F.col(f"_p_{x}"), "left").drop(f"_p_{x}")
        found.append(F.when(key.isNotNull() & F.col(mark).isNull(), F.lit(f"{x} unknown")))
    marks = [f"_twice_{x}" for x in unique] + [f"_known_{x}" for x in parents or {}]
    return df.withColumn(into, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")).drop(*marks)


def split(df: DataFrame, rules: dict[str, Column], unique: tuple[str, ...] = (), parents: dict[str, tuple[DataFrame, str]] | None = None, into: str = "reasons") -> Split:
    """The rows that break no rule of ``checked``, and those that do with their reasons. The check runs once and is stored; each row is in exactly one part."""
    done = cut(checked(df, rules, unique, parents, into))
    return Split(done.where(F.size(into) == 0).drop(into), done.where(F.size(into) > 0))


# --- requests


@dataclass(frozen=True)
class Field:
    """A value of a request: a whole number from ``least`` to ``most``, or a text of that many characters. A default stands in for null; ``required`` allows no null."""

    number: bool
    least: int | None = None
    most: int | None = None
    default: int | str | None = None
    required: bool = False


# Fields of the requests with their bounds and defaults.
_TOPIC = Field(False, 3, 500, "India ports suppliers logistics manufacturing disruptions")
INGEST = {"topic": _TOPIC, "hours": Field(True, 1, 168, 24), "language": Field(False, default="en"), "country": Field(False), "limit": Field(True, 1, 100, 10)}
LIVE = {
    "topic": _TOPIC, "hours": Field(True, 1, 168, 24), "limit": Field(True, 1, 50, 10), "language": Field(False, most=5, default="en"), "country": Field(False, most=5),
    "model_type": Field(False, default="both"), "api_key": Field(False, most=100), "timeout_seconds": Field(True, 5, 300, 60),
}
FEEDBACK = {
    "alert_id": Field(False, 1, 100, required=True), "decision": Field(False, 1, 50, required=True), "analyst_id": Field(False, most=100, default="analyst_default"),
    "comment": Field(False, most=1000, default=""), "recommended_action": Field(False, most=500, default=""),
}


def requests(df: DataFrame, fields: dict[str, Field], into: str = "reasons") -> DataFrame:
    """The requests of ``df`` with their defaults filled in and, in ``into``, the fields that are out of bounds, in their order.

    A field that is null, or whose column is missing, has its default. Numbers may be texts; what isn't a whole number
    breaks its field and is null. Texts stay as they are and are measured in characters. Other columns are kept.
    """
    have, filled, rules = set(df.columns), {}, {}
    if into in have:
        raise ValueError(f"the table has a column {into} already")
    for name, f in fields.items():
        raw = F.col(name).cast("string") if name in have else F.lit(None).cast("string")
        given = F.coalesce(raw, F.lit(None if f.default is None else str(f.default)))
        if f.number:
            d = F.trim(given).try_cast("double")
            value = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d).cast("long")
            size, null_is_fine = value, F.lit(False)
        else:
            value, size, null_is_fine = given, F.length(given), F.lit(not f.required)
        within = F.lit(True)
        if f.least is not None:
            within &= size >= f.least
        if f.most is not None:
            within &= size <= f.most
        filled[name] = value
        rules[name] = F.when(value.isNull(), null_is_fine).otherwise(within)
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumns({into: reasons, **filled})
