"""Mixing sources to target weights by systematic sampling: one offset per source, one copy per integer boundary crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import partitions, stored

#: Weights that sources take in turn, in code-point order.
TURN_WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.coalesce(F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = TURN_WEIGHTS) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``.

    Water-filling in closed form: sources ordered by what they can give per weight; those below the level are
    capped at ``most`` times their size, the rest share what remains by weight. The windows run over one row
    per source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    every = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"used": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "w_used": F.coalesce(F.sum("w").over(before), F.lit(0)), "all": F.sum("source_size").over(Window.partitionBy()), "w_all": F.sum("w").over(Window.partitionBy())})
    level = (share * F.col("all") - most * F.col("used")) / (F.col("w_all") - F.col("w_used"))
    per = per.withColumn("level", level).withColumn("open", F.col("w") * F.col("level") <= most * F.col("source_size"))
    per = per.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), F.col("level")))).over(Window.partitionBy())["level"])
    cap = most * F.col("source_size")
    return per.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("w") * F.col("final") > cap), cap).otherwise(F.col("w") * F.col("final")).cast("double").alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), from a digest, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000"))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _marked(docs: DataFrame, seed: int, share: float, most: float, weights: tuple[int, ...], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, mark, size, source_size, target, copies); ``mark`` is a hash of the text."""
    text = F.col(text_col)
    narrow = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("mark"), word_count(text).alias("size")), "sizes")
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), F.col("mark")]
    laid = stored(narrow.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ranges")
    goal = targets(narrow, share, most, weights)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    held = laid.groupBy("part", key.alias("key")).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("part", "key", F.coalesce(earlier, F.lit(0)).alias("before"))
    row = F.row_number().over(Window.partitionBy("part", "key").orderBy("size", "doc_id", "mark"))
    numbered = laid.withColumn("key", key).withColumn("row", row)
    plan = base.join(goal.withColumn("key", key).select("key", "source_size", "target"), "key")
    j = numbered.join(plan, ["part", "key"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("before") + F.col("row")
    u = offset_of(F.col("source"), seed)
    crossed = F.floor(rate * at + u) - F.floor(rate * (at - 1) + u)
    return j.select("doc_id", "source", "mark", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def copies(docs: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = TURN_WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    Within a source, documents stand in order of size and each expects target / source_size copies; the running
    expectation plus the source's offset crosses ``copies`` integers at a document. Order by size keeps the words
    taken within about one largest document of the target. The running count is taken per range partition and
    source first and then over partitions, so a hot source is spread over tasks. Null text has size 0; sources
    of size 0 get no copies; repeated rows and rows with a null id are documents of their own; an empty table
    gives an empty one; columns other than the three named are not read.
    """
    return _marked(docs, seed, share, most, weights, id_col, text_col, source_col).drop("mark")


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = TURN_WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: rows of ``docs`` as often as their copies, all columns kept, whatever their names.

    A row is known by id, source and text. Rows that agree in all three share the copies of all of them as evenly
    as whole numbers allow, so the mixture has as many rows as ``copies`` counts.
    """
    got = _marked(docs, seed, share, most, weights, id_col, text_col, source_col)
    got = got.groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("all"), F.count("*").alias("n")).where("all > 0")
    # The rows travel in one struct, so that no column of theirs can clash with the names here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), docs[id_col].alias("i"), docs[source_col].alias("s"), F.xxhash64(docs[text_col]).alias("m"))
    got = got.hint("shuffle_hash")
    j = rows.join(got, rows["i"].eqNullSafe(got["doc_id"]) & rows["s"].eqNullSafe(got["source"]) & (rows["m"] == got["mark"]))
    once = j.where("n = 1").select("r", F.col("all").alias("times"))
    turn = F.row_number().over(Window.partitionBy("i", "s", "m").orderBy(F.lit(0)))
    many = j.where("n > 1").withColumn("turn", turn).select("r", (F.floor(F.col("all") / F.col("n")) + (F.col("turn") <= F.col("all") % F.col("n")).cast("long")).alias("times"))
    whole = once.unionByName(many).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return whole.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])
