"""Readers and writers of the file formats: tab-separated text without quotes, match lists, candidate lists, parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinfold import storage


def read_tsv(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """All columns as text, quotes kept, short rows padded; empty fields are '' and never null.

    ``ordered`` adds ``ord``, by which rows sort as they stand in their files: file, split, place in the split.
    """
    header = spark.read.text(path).first()
    names = header.value.split("\t") if header else []
    schema = StructType([StructField(n, StringType()) for n in names])
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema=schema, nullValue="\x01", enforceSchema=True)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], *([place.alias("ord")] if ordered else []))


def too_wide(spark: SparkSession, path: str) -> int:
    """Rows with more fields than the header has, which ``read_tsv`` cuts."""
    lines = spark.read.text(path)
    names = (lines.first() or [""])[0].split("\t")
    return lines.where(F.size(F.split("value", "\t")) > len(names)).count()


def convert(spark: SparkSession, tsv: str, parquet: str, expected: int | None = None, force: bool = False) -> int:
    """TSV to zstd parquet; the rows must be the lines less the header, and ``expected`` if given. Skips what exists unless forced."""
    if force or not storage.exists(spark, parquet):
        read_tsv(spark, tsv).write.mode("overwrite").option("compression", "zstd").parquet(parquet)
    rows, lines = spark.read.parquet(parquet).count(), spark.read.text(tsv).count() - 1
    if rows != lines or expected not in (None, rows):
        raise ValueError(f"{parquet}: {rows} rows, {lines} lines, {expected} expected")
    return rows


def load(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def ids_of(text):
    """The ids in a cell: brackets, quotes and blanks go; nan, none and [] are empty."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]'\"\s]", "")
    return F.filter(F.split(clean, ","), lambda x: (x != "") & ~F.lower(x).isin("nan", "none"))


def read_match_sets(spark: SparkSession, path: str, id_col: str | None = None, match_cols: Sequence[str] | None = None) -> DataFrame:
    """s1_id, cand_ids (sorted array): the union of all match columns, and of all rows of an id."""
    df = read_tsv(spark, path)
    id_col = id_col or df.columns[0]
    cols = match_cols or [c for c in df.columns if c != id_col]
    lists = F.flatten(F.array(*[ids_of(F.col(c)) for c in cols])) if cols else F.array().cast("array<string>")
    rows = df.select(F.trim(id_col).alias("s1_id"), F.array_distinct(lists).alias("x"))
    return rows.groupBy("s1_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("x")))).alias("cand_ids"))


def pairs_of(sets: DataFrame) -> DataFrame:
    return sets.select("s1_id", F.explode("cand_ids").alias("cand_id"))


def read_candidates(spark: SparkSession, path: str, s1_col: str = "s1_id", cand_col: str = "cand_id", prob_col: str = "prob") -> DataFrame:
    """Scored candidates; a prob that is no number is an error."""
    df = read_tsv(spark, path).withColumnsRenamed({s1_col: "s1_id", cand_col: "cand_id", prob_col: "prob"})
    return df.withColumns({"s1_id": F.trim("s1_id"), "cand_id": F.trim("cand_id"), "prob": F.trim("prob").cast("double")})


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    df = read_tsv(spark, path)
    return df.select(F.trim(df.columns[0]).alias("s1_id"), F.trim(df.columns[1]).alias("grp"))


def write_lists(lists: DataFrame, path: str, order: DataFrame | None = None, header: tuple[str, str] = ("s1_id", "cand_ids")) -> None:
    """(s1_id, cand_ids array) as one TSV in the order of ``order`` (s1_id, ord), else by id; entities without a list get ''.

    Rows are sorted in ranges, a part a task; the parts are then strung together to the one file that the format asks for.
    """
    text = lists.select("s1_id", F.array_join(F.array_sort("cand_ids"), ",").alias("ids"))
    if order is not None:
        text = order.join(text, "s1_id", "left").select("s1_id", F.coalesce("ids", F.lit("")).alias("ids"), "ord").orderBy("ord")
    else:
        text = text.orderBy("s1_id")
    spark = lists.sparkSession
    text.select(F.concat_ws("\t", F.col("s1_id").cast("string"), "ids").alias("value")).write.mode("overwrite").text(f"{path}.parts")
    storage.merged(spark, f"{path}.parts", path, "\t".join(header))


def write_entity_scores(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip")


def read_entity_scores(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_entity_scores`` has written, with its types."""
    counts = ", ".join(f"{c} long" for c in ("hits", "n_pred", "n_true"))
    df = spark.read.csv(path, sep="\t", header=True)
    known = {f.split()[0]: f.split()[1] for f in counts.split(", ")} | {"score": "double", "fp": "long", "fn": "long"}
    return df.select(*[F.col(c).cast(known.get(c, "string")).alias(c) for c in df.columns])


def parquet_to_tsv(spark: SparkSession, source: str, path: str) -> None:
    """A table as one TSV, for tools that read nothing else; nulls become ''."""
    df = spark.read.parquet(source)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    df.select(F.array_join(F.array(*cells), "\t").alias("value")).write.mode("overwrite").text(f"{path}.parts")
    storage.merged(spark, f"{path}.parts", path, "\t".join(df.columns))


def repeated_rows(spark: SparkSession, path: str) -> int:
    """Ids of a match file that have several rows, whose lists are united."""
    df = read_tsv(spark, path)
    return df.groupBy(F.trim(df.columns[0])).count().where("count > 1").count()


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def add_column(df: DataFrame, source: str, name: str, fn) -> DataFrame:
    """A derived column computed once for each distinct value and joined back, for functions that are dear."""
    values = df.select(source).distinct()
    return df.join(values.withColumn(name, fn(F.col(source))), source, "left")


def synthetic(spark: SparkSession, n: int, seed: int = 0, singletons: float = 0.4, recall: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (s1_id, grp), truth pairs and scored candidates by rule from hashed ids."""
    u = lambda *k: F.pmod(F.xxhash64(*[F.col(c) if c in ("id", "j") else F.lit(c) for c in k], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    base = spark.range(n).select("id", F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("s1_id"))
    size = F.when(u("id", "s") < singletons, 0).when(u("id", "m") < 0.6, 1).when(u("id", "m") < 0.9, 2).otherwise(3)
    ents = base.select("s1_id", F.concat(F.lit("region"), F.pmod("id", F.lit(4)).cast("string")).alias("grp"))
    cand = F.concat(F.when(F.pmod("j", F.lit(2)) == 0, "S2-").otherwise("S3-"), F.col("id").cast("string"), F.lit("-"), F.col("j").cast("string"))
    true = base.withColumn("n", size).where("n > 0").select("id", "s1_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")).withColumn("cand_id", cand)
    wrong = base.select("id", "s1_id", F.explode(F.sequence(F.lit(10), (F.floor(u("id", "w") * 21) + 12).cast("int"))).alias("j")).withColumn("cand_id", cand)
    good = true.where(u("id", "j", "r") < recall).select("s1_id", "cand_id", F.sqrt(F.sqrt(u("id", "j", "p"))).alias("prob"), F.lit(True).alias("label"))
    bad = wrong.select("s1_id", "cand_id", F.pow(u("id", "j", "q"), 6).alias("prob"), F.lit(False).alias("label"))
    cands = good.unionByName(bad).withColumn("source", F.lower(F.substring("cand_id", 1, 2)))
    return ents, true.select("s1_id", "cand_id"), cands


