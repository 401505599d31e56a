"""Records of large text files whose borders depend on what comes before: quoted line breaks, lists of objects.

A file is read in pieces by Spark's own splittable text source, cut at a byte that every record border contains (a line
break, a closing brace). Whether a cut is a border depends on the quotes before it, so each cut reports what it does to
the reading state, running totals over the pieces fix the states, and only records that span several cuts are put
together. One file spreads over as many tasks as it has pieces, and no task holds more than one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchweave.operators.ranking import running_max, running_total
from benchweave.session import cut_lineage

ORDER = ["block", "at"]
# Texts in quotes, with doubled quotes or with escapes inside; possessive, so that long texts need no stack.
_CSV_BODY = r'[^"]*+(?:""[^"]*+)*+'
_JSON_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'


def _cuts(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, at, value): the texts between separators; ``at`` rises with the place in a block."""
    source = spark.read.option("lineSep", separator).text(path)
    return source.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _upto(rows: DataFrame, value: Column | str, out: str) -> DataFrame:
    return running_total(rows, ["file"], ORDER, value, out, bucket=F.col("block"))


def _joined(parts: DataFrame, separator: str) -> DataFrame:
    """Records from their parts: ``first`` marks the part that begins one. Only records of several parts come here."""
    numbered = _upto(parts, F.col("first").cast("bigint"), "_record")
    listed = F.array_sort(F.collect_list(F.struct(*ORDER, "value")))
    whole = numbered.groupBy("file", "_record").agg(listed.alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["value"]), separator)
    return whole.select("file", F.col("_p")[0]["block"].alias("block"), F.col("_p")[0]["at"].alias("at"), text.alias("value"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): one row per record, headers included, with line breaks within quotes.

    A quote opens a text only at the beginning of a field, as in the reader. Blank lines between records are no records.
    """
    opened = F.regexp_like(F.regexp_replace("_rest", rf'(^|,)"{_CSV_BODY}"(?=,|\r?$)', "$1"), F.lit(rf'(?:^|,)"{_CSV_BODY}$'))
    ends = lambda rows, out: rows.withColumn(out, opened.cast("int")).drop("_rest")
    lines = _cuts(spark, path, "\n").withColumn("value", F.when((F.col("block") == 0), F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))
    # The state after the line if it begins outside quotes, and if it begins inside.
    lines = ends(lines.withColumn("_rest", F.col("value")), "_out")
    closed = F.regexp_replace("value", rf'^{_CSV_BODY}"', "x")
    inside = F.regexp_like("value", F.lit(rf'^{_CSV_BODY}"'))
    lines = ends(lines.withColumn("_rest", closed), "_in").withColumn("_in", F.when(inside, F.col("_in")).otherwise(1))
    # Lines either fix the state, keep it, or swap it: the last fixed one and the swaps since tell the state.
    swap = ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("bigint")
    lines = cut_lineage(lines.withColumn("_swap", swap))
    counted = _upto(lines, "_swap", "_swaps")
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(*ORDER, F.col("_out").alias("state"), F.col("_swaps").alias("swaps")))
    marked = running_max(counted.withColumn("_fixed", fixed), ["file"], ORDER, "_fixed", "_last", bucket=F.col("block"))
    state = lambda last, swaps: F.coalesce(F.pmod(last["state"] + swaps - last["swaps"], F.lit(2)), F.pmod(swaps, F.lit(2)))
    before = state(F.col("_last"), F.col("_swaps") - F.col("_swap"))
    after = state(F.coalesce("_fixed", "_last"), F.col("_swaps"))
    rows = marked.select("file", *ORDER, "value", (before == 0).alias("first"), (after == 0).alias("last"))
    alone = rows.where("first AND last").where(r"NOT regexp_like(value, '^\\s*$')")
    several = _joined(rows.where("NOT (first AND last)"), "\n")
    every = alone.select("file", *ORDER, "value").unionByName(several)
    return every.withColumn("value", F.regexp_replace("value", "\r$", ""))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the objects of files that hold a list, or an object that begins with ``records``.

    Objects may hold others and braces within strings. Whatever follows the list is ignored.
    """
    cuts = _cuts(spark, path, "}")
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', ""))
    cuts = _upto(cuts.withColumn("_quotes", quotes.cast("bigint")), "_quotes", "_seen")
    inside, within = (F.pmod(F.col("_seen") - F.col("_quotes"), F.lit(2)) == 1), (F.pmod("_seen", F.lit(2)) == 1)
    begun = F.when(inside, F.regexp_replace("value", rf'(?s)^{_JSON_BODY}"', "")).otherwise(F.col("value"))
    bare = F.regexp_replace(F.regexp_replace(begun, rf'(?s)"{_JSON_BODY}"', ""), r'(?s)".*$', "")
    bare = F.when(inside & (F.col("_quotes") == 0), "").otherwise(bare)
    opens = F.length(F.regexp_replace(bare, r"[^{]", "")).cast("bigint")
    cuts = cuts.withColumn("_opens", opens).withColumn("_close", F.when(within, 0).otherwise(1).cast("bigint"))
    cuts = cut_lineage(_upto(cuts.withColumn("_step", F.col("_opens") - F.col("_close")), "_step", "_depth"))
    # The outermost object of the second form is one brace deep for all records.
    heads = cuts.groupBy("file").agg(F.min_by("value", F.struct(*ORDER)).alias("_head"))
    listed = rf'(?s)^﻿?\s*\{{\s*"records"\s*:\s*\['
    heads = heads.select("file", F.regexp_like("_head", F.lit(listed)).cast("int").alias("_base"), F.regexp_like("_head", F.lit(r"(?s)^﻿?\s*(?:\[|\{\s*\"records\"\s*:\s*\[)")).alias("_known"))
    known = cuts.join(heads, "file").withColumn("_fits", F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("neither a list nor records: "), "file"))))
    known = known.where("_fits")
    outer = F.when((F.col("_base") == 1) & F.regexp_like("value", F.lit(listed)), 1).otherwise(0)
    began = F.col("_depth") - F.col("_step") + F.when(F.col("_depth") - F.col("_step") == 0, outer).otherwise(0)
    rows = known.withColumn("first", began == F.col("_base")).withColumn("last", (F.col("_depth") == F.col("_base")) & (F.col("_close") == 1))
    # Text before a record: the opening of the list, or the comma after the record before.
    lead = F.when(F.col("first"), F.regexp_replace(F.regexp_replace("value", listed, ""), r"(?s)^﻿?[\s,\[]*", "")).otherwise(F.col("value"))
    rows = rows.select("file", *ORDER, lead.alias("value"), "first", "last")
    finish = rows.where("first AND startswith(value, ']')").groupBy("file").agg(F.min(F.struct(*ORDER)).alias("_end"))
    rows = rows.join(finish, "file", "left").where(F.col("_end").isNull() | (F.struct(*ORDER) < F.col("_end"))).drop("_end")
    alone = rows.where("first AND last").select("file", *ORDER, "value")
    several = _joined(rows.where("NOT (first AND last)"), "}")
    return alone.unionByName(several).where("value <> ''").withColumn("value", F.concat("value", F.lit("}")))
