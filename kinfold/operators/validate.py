"""Checks of result files: shape of the lines, ids, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(lists: DataFrame, references: DataFrame, targets: DataFrame | None = None, id_col: str = "s1_id", ids_col: str = "ids", prefixes: tuple[str, ...] = ()) -> DataFrame:
    """check, n of a table of (id, comma-joined ids) against the known references and targets.

    Checks: duplicate_rows, unknown_references, missing_references, duplicate_ids, self_matches,
    inner_space, wrong_prefix where ``prefixes`` of targets are given, and unknown_targets where ``targets``
    (column cand_id) is given.
    """
    rows = lists.select(F.col(id_col).cast("string").alias("s1"), F.coalesce(F.col(ids_col), F.lit("")).alias("ids"))
    known = references.select(F.col("s1_id").cast("string").alias("s1")).distinct()
    parts = F.filter(F.split("ids", ","), lambda x: x != "")
    per_row = rows.select("s1", "ids", parts.alias("p")).agg(
        F.coalesce(F.sum(F.size("p") - F.size(F.array_distinct("p"))), F.lit(0)).cast("long").alias("duplicate_ids"),
        F.count_if(F.array_contains("p", F.col("s1"))).alias("self_matches"),
        F.count_if(F.col("ids").rlike(r"\s")).alias("inner_space"),
        F.coalesce(F.sum(F.size(F.filter("p", lambda x: ~F.coalesce(*[F.nullif(x.startswith(q), F.lit(False)) for q in prefixes], F.lit(False))))), F.lit(0)).cast("long").alias("wrong_prefix") if prefixes else F.lit(0).alias("wrong_prefix"),
    )
    per_id = rows.groupBy("s1").agg(F.count("*").alias("n")).join(known.withColumn("k", F.lit(1)), "s1", "full_outer").agg(
        F.count_if(F.col("n") > 1).alias("duplicate_rows"), F.count_if(F.col("k").isNull()).alias("unknown_references"), F.count_if(F.col("n").isNull()).alias("missing_references")
    )
    checks = ["duplicate_rows", "unknown_references", "missing_references", "duplicate_ids", "self_matches", "inner_space", *(["wrong_prefix"] if prefixes else [])]
    row = per_row.crossJoin(F.broadcast(per_id))  # both sides are one row
    if targets is not None:
        used = rows.select(F.explode(parts).alias("t")).distinct()
        strange = used.join(targets.select(F.col("cand_id").cast("string").alias("t")).distinct(), "t", "left_anti").agg(F.count("*").alias("unknown_targets"))
        row, checks = row.crossJoin(F.broadcast(strange)), [*checks, "unknown_targets"]
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in checks])).alias("x")).select("x.*")


def line_violations(lines: DataFrame, header: str) -> DataFrame:
    """check, n of raw lines (column ``value``): wrong header, rows without a tab, rows with several."""
    tabs = F.length("value") - F.length(F.replace("value", F.lit("\t"), F.lit("")))
    body = F.col("value") != header
    return lines.agg(F.when(F.count_if(~body) == 1, 0).otherwise(1).cast("long").alias("header"), F.count_if(body & (tabs == 0)).alias("no_tab"), F.count_if(body & (tabs > 1)).alias("many_tabs")).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("header", "no_tab", "many_tabs")])).alias("x")
    ).select("x.*")


def outside_candidates(lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of ``lists`` (s1_id, cand_id) that are not candidates."""
    return lists.select("s1_id", "cand_id").join(candidates, ["s1_id", "cand_id"], "left_anti")


def check_file(spark, path: str, header: tuple[str, str], references: DataFrame, targets: DataFrame | None = None, prefixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(check, n) of a result file as it stands: its lines, then what they say. Every n must be 0."""
    lines = spark.read.text(path)
    found = [(r.check, r.n) for r in line_violations(lines, "\t".join(header)).collect()]
    rows = lines.where((F.col("value") != "\t".join(header)) & F.col("value").contains("\t")).select(F.split("value", "\t", 2).alias("c")).select(F.col("c")[0].alias("s1_id"), F.col("c")[1].alias("ids"))
    return found + [(r.check, r.n) for r in violations(rows, references, targets, prefixes=prefixes).collect()]


def header_differs(spark, path: str, sample: str) -> bool:
    """Whether a file's columns are other ones than those of a sample file."""
    one, two = (spark.read.text(p).first() for p in (path, sample))
    return (one and one.value) != (two and two.value)
