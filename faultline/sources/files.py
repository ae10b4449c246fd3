"""Sources of files: typed CSV, tolerant scans, normalised frames, and articles of news responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from faultline.functions import columns as c

# Columns that are numbers, and columns of provenance that are kept as they are.
NUMBERS = ("latitude", "longitude", "weight", "share_percent", "confidence", "match_score", "lead_time_days", "event_severity", "geographic_exposure", "supplier_criticality", "dependency_strength", "deterministic_risk")
PROVENANCE = ("data_status", "source", "source_date", "evidence")
#: Fields of an article in a response.
ARTICLE = "struct<title: string, url: string, source: struct<name: string>, author: string, description: string, content: string, publishedAt: string>"


def typed_csv(spark: SparkSession, path: str, normalize: bool = True, quoted_lines: bool = False) -> DataFrame:
    """A CSV with a header: known numbers as doubles, what doesn't read as one null, all else as text.

    A missing file is an error. ``quoted_lines`` allows line ends inside quotes, which keeps a file in one task.
    """
    df = spark.read.csv(path, header=True, escape='"', multiLine=quoted_lines)
    df = df.withColumns({x: F.col(x).try_cast("double") for x in df.columns if x in NUMBERS})
    return normalized(df) if normalize else df


def first_found(spark: SparkSession, paths: Sequence[str], schema: StructType | str, form: str = "parquet") -> DataFrame:
    """The first of the paths that is there, else an empty table of the schema; any other error stands."""
    for p in paths:
        try:
            return spark.read.schema(schema).load(p, format=form, header=True) if form == "csv" else spark.read.schema(schema).load(p, format=form)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def pack(spark: SparkSession, paths: dict[str, str], normalize: bool = True) -> dict[str, DataFrame]:
    """Every table of a pack of CSVs; one that is missing is an empty table without columns."""
    found = {}
    for name, p in paths.items():
        try:
            found[name] = typed_csv(spark, p, normalize)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found[name] = spark.createDataFrame([], StructType([]))
    return found


def records(df: DataFrame) -> DataFrame:
    """Rows as an API serves them: empty text in place of every null, all values as text."""
    return df.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in df.columns])


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def normalized(df: DataFrame, ids: Sequence[str] | None = None, texts: Sequence[str] | None = None, keep: Sequence[str] = PROVENANCE) -> DataFrame:
    """Ids as trimmed text, other texts trimmed with their white space collapsed; numbers, provenance and nulls stay.

    Ids are ``ids`` or the columns that end in _id, and target; ``source`` is provenance and therefore no id.
    """
    named = [x for x in df.columns if x.endswith("_id") or x in ("source", "target")] if ids is None else ids
    some = [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in named] if texts is None else texts
    new = {x: strip(F.col(x).cast("string")) for x in named if x in df.columns and x not in keep}
    new |= {x: F.regexp_replace(strip(F.col(x)), r"(?U)\s+", " ") for x in some if x in df.columns and x not in keep}
    return df.withColumns(new) if new else df


def articles(responses: DataFrame, retrieved_at: Column) -> DataFrame:
    """Articles of ``responses(query, articles)``; those without a title or a url are left out.

    Missing content is the description. The id has the digits of the time of publication and the place in the
    response, counted before any is left out. A missing time is ``retrieved_at``.
    """
    flat = responses.select("query", retrieved_at.cast("string").alias("retrieved_at"), F.posexplode("articles").alias("pos", "a"))
    text = lambda x: strip(F.coalesce(F.col(f"a.{x}"), F.lit("")))
    filled = lambda x, other: F.when(F.coalesce(x, F.lit("")) == "", other).otherwise(x)
    time = filled(F.col("a.publishedAt"), F.col("retrieved_at"))
    digits = lambda x: F.regexp_replace(F.substring(x, 1, 19), "[^0-9]", "")
    place = F.concat(F.lit("NEWSAPI-"), filled(digits(time), digits(F.col("retrieved_at"))), F.lit("-"), F.format_string("%04d", F.col("pos") + 1))
    out = flat.select(
        place.alias("article_id"),
        filled(F.col("a.source.name"), F.lit("NewsAPI Publisher")).alias("source_name"),
        text("author").alias("author"),
        text("title").alias("title"),
        text("description").alias("description"),
        text("url").alias("url"),
        time.alias("published_at"),
        strip(filled(F.col("a.content"), text("description"))).alias("content"),
        "query",
        "retrieved_at",
        F.lit("REAL_DATA").alias("data_status"),
    )
    return out.where("title <> '' and url <> ''")


def response_files(spark: SparkSession, path: str) -> DataFrame:
    """(query, articles) of stored responses, one JSON document a file, as ``articles`` takes them."""
    return spark.read.schema(f"query string, articles array<{ARTICLE}>").json(path, multiLine=True)


def catalog_names(*columns: Column, of: Sequence[DataFrame]) -> DataFrame:
    """Distinct trimmed names of over two characters, from one column of each table."""
    every = None
    for df, col in zip(of, columns, strict=True):
        one = df.select(c.normalize_id(col).alias("name"))
        every = one if every is None else every.unionByName(one)
    return every.where(F.length("name") > 2).distinct()


def location_terms(locations: DataFrame) -> DataFrame:
    """(at, term, location_id) from ``locations(ordinal, location_id, location_name, city)``: the name, then the city, of over three characters, lower-cased, in scan order."""
    low = lambda x: F.lower(F.trim(F.coalesce(F.col(x), F.lit(""))))
    flat = locations.select("ordinal", F.trim("location_id").alias("location_id"), F.posexplode(F.array(low("location_name"), low("city"))).alias("k", "term"))
    return flat.where(F.length("term") > 3).select((F.col("ordinal") * 2 + F.col("k")).alias("at"), "term", "location_id")
