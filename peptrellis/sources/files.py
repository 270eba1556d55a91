"""Readers and writers of candidate files."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scales import ALPHABET


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence. Wrapped lines are joined and blank ones dropped (a deliberate choice); text before the first header is ignored.

    Records end where a line begins with >, so files split between tasks at records.
    """
    record = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where("trim(r) <> ''")
    lines = F.split("r", "\r?\n")
    rest = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x))
    return record.select(F.trim(lines[0]).alias("id"), F.array_join(rest, "").alias("sequence"))


def write_fasta(df: DataFrame, path: str, wrap: int | None = None) -> None:
    """One record a row; wrap: residues a line."""
    body = F.col("sequence") if wrap is None else F.regexp_replace("sequence", f"(.{{{wrap}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), body).alias("value")).write.text(path)


def read_candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One candidate a line; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_snapshot(df: DataFrame, path: str, run_id: str, stage: str) -> None:
    """The survivors of a stage; writing a stage again replaces only its own partition."""
    df.withColumns({"run_id": F.lit(run_id), "stage": F.lit(stage)}).write.partitionBy("run_id", "stage").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


#: Headers of columns that hold sequences, in lower case.
SEQUENCE_HEADERS = ("sequence", "peptide_sequence", "seq")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line that isn't blank of each text file under path. Lines of a file come in order within the task
    that reads its first block, so no file is read at once."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    numbered = lines.where("start = 0 and trim(value) <> ''").withColumn("n", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(F.min_by("value", "n").alias("header"))


def read_peptide_columns(spark: SparkSession, path: str, least: int, most: int) -> DataFrame:
    """Distinct standard sequences, upper case, of `least` to `most` residues, from all columns that name a sequence in the header of
    their own file, whatever its other columns, their order and case. Commas or tabs part the columns. Files without such a column are
    passed over; it is an error if no file has one.

    Files of one layout (number of columns, and which hold sequences) are read together. The layouts and the names of files come to the
    driver, which lists the folder in any case."""
    layouts: dict[tuple, list[str]] = {}
    for file, header in headers(spark, path).collect():
        sep = "\t" if "\t" in header else ","
        names = [c.strip().lower() for c in next(csv.reader([header.lstrip("\ufeff")], delimiter=sep))]
        held = tuple(k for k, c in enumerate(names) if c in SEQUENCE_HEADERS)
        if held:
            layouts.setdefault((sep, len(names), held), []).append(file)
    if not layouts:
        raise ValueError("no column holds sequences")
    parts = []
    for (sep, width, held), files in sorted(layouts.items()):
        rows = spark.read.schema(", ".join(f"c{k} string" for k in range(width))).options(header=True, sep=sep, enforceSchema=True).csv(sorted(files))
        parts.append(rows.select(F.explode(F.array(*(F.upper(F.trim(f"c{k}")) for k in held))).alias("sequence")))
    every = reduce(DataFrame.unionByName, parts)
    return every.where(F.col("sequence").rlike(f"^[{ALPHABET}]+$") & F.length("sequence").between(least, most)).dropDuplicates(["sequence"])


BRIEF = "brief_id long, functions struct<primary:string, secondary:array<string>>, target_depth string, peptide struct<min_length:int, max_length:int>, product struct<ph:double>"


def read_briefs(spark: SparkSession, path: str, one_a_file: bool = False) -> DataFrame:
    """Briefs with their defaults: depth by the primary function, lengths 6 to 12, pH 5.5. One brief a line, or one a file on any
    number of lines (one_a_file); file: where each comes from."""
    raw = spark.read.schema(BRIEF).option("multiLine", one_a_file).option("recursiveFileLookup", one_a_file).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    primary = F.coalesce("functions.primary", F.lit("collagen_ecm"))
    depth = F.coalesce("target_depth", F.when(primary == "collagen_ecm", "dermis").otherwise("epidermis"))
    return raw.select(
        "brief_id", primary.alias("primary"), depth.alias("depth"), F.coalesce("peptide.min_length", F.lit(6)).alias("min_length"),
        F.coalesce("peptide.max_length", F.lit(12)).alias("max_length"), F.coalesce("product.ph", F.lit(5.5)).alias("ph"), "file",
    )
