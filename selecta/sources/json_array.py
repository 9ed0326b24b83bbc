"""A JSON array file read in byte ranges, one row per element.

The text source splits a file at any byte when the line separator is one
character, so the array is read in pieces between commas. What a piece does to
the reader's state does not need the text before it: an escape never passes a
comma, so the quotes of a piece that are not escaped, and its brackets outside
strings for either state at its start, are functions of the piece. Sums of
these in each byte range give the state at the start of every range; a comma
outside strings at depth one ends an element, and the pieces of an element are
joined again.

Plan: three scans of the file, one small row per byte range to the driver
after the first two, and one shuffle of the pieces by element. A task holds a
byte range or an element, never the file.

Defined results: elements are the raw text, positions count from 0 in each
file; an empty array gives no row. Files must be valid JSON arrays in UTF-8: a
file whose brackets or strings don't close raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _balance(text: Column) -> Column:
    """Opening minus closing brackets."""
    def count(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))
    return (count("[{") - count("]}")).cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, pos, piece, flips, outside, inside): a piece, whether it changes the string state, and the
    change of depth when it starts outside or inside a string."""
    raw = spark.read.option("lineSep", ",").text(path)
    clean = F.regexp_replace("value", r"\\.", "")
    flips = F.pmod(F.length(clean) - F.length(F.translate(clean, '"', "")), F.lit(2)).cast("long")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                      F.monotonically_increasing_id().alias("pos"), F.col("value").alias("piece"), flips.alias("flips"),
                      _balance(F.regexp_replace(clean, r'"[^"]*("|$)', "")).alias("outside"),
                      _balance(F.regexp_replace(F.regexp_replace(clean, r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")).alias("inside"))


def _starts(rows: list, step) -> list:
    """(file, split, state at its start ...) from the rows of all ranges, in file order; the last state is checked by ``step``."""
    out, file, state = [], None, None
    for r in sorted(rows, key=lambda r: (r["file"], r["split"])):
        if r["file"] != file:
            if file is not None:
                step(state, None)
            file, state = r["file"], None
        state = state or step(None, None)
        out.append((r["file"], r["split"], *state))
        state = step(state, r)
    if file is not None:
        step(state, None)
    return out


def _through(state, r):
    """String state and depth after a range; (None, None) begins a file and (state, None) ends it."""
    if state is None:
        return 0, 0
    inside, depth = state
    if r is None:
        if inside or depth:
            raise ValueError("not a JSON array: a string or a bracket is not closed")
        return state
    return (inside + r["flips"]) % 2, depth + (r["from_inside"] if inside else r["from_outside"])


def _counted(state, r):
    if state is None:
        return (0,)
    return state if r is None else (state[0] + r["ends"],)


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_id, element): the raw elements of the JSON array of each file of ``path``, by position."""
    before = Window.partitionBy("file", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("file", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    pieces = _pieces(spark, path)
    odd = F.pmod(F.coalesce(F.sum("flips").over(before), F.lit(0)), F.lit(2)) == 1
    local = pieces.withColumn("odd", odd)
    per_split = local.groupBy("file", "split").agg(
        F.sum("flips").alias("flips"),
        F.sum(F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))).alias("from_outside"),
        F.sum(F.when(F.col("odd"), F.col("outside")).otherwise(F.col("inside"))).alias("from_inside"))
    states = _starts(per_split.collect(), _through)
    entered = local.join(spark.createDataFrame(states, "file string, split long, in0 long, depth0 long"), ["file", "split"])
    starts_inside = F.col("odd") != (F.col("in0") == 1)
    delta = F.when(starts_inside, F.col("inside")).otherwise(F.col("outside"))
    ends_inside = starts_inside != (F.col("flips") == 1)
    marked = (entered.withColumn("depth", F.col("depth0") + F.sum(delta).over(through))
              .withColumn("ends", (~ends_inside & (F.col("depth") == 1)).cast("long")))
    counts = _starts(marked.groupBy("file", "split").agg(F.sum("ends").alias("ends")).collect(), _counted)
    numbered = marked.join(spark.createDataFrame(counts, "file string, split long, first long"), ["file", "split"])
    row_id = F.col("first") + F.coalesce(F.sum("ends").over(before), F.lit(0))
    parts = numbered.select("file", row_id.alias("row_id"), (F.col("depth") == 0).alias("last"), F.struct("split", "pos", "piece").alias("part"))
    whole = parts.groupBy("file", "row_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.max("last").alias("last"))
    text = F.array_join("parts.piece", ",")
    text = F.when(F.col("row_id") == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    text = F.when(F.col("last"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return whole.select("file", "row_id", F.regexp_replace(text, r"^\s+|\s+$", "").alias("element")).filter("element <> ''")
