"""Reference lists, count tables and pair matrices from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators.correct import assign_roles
from strandloom.operators.scan import matrix_pairs

#: Lines looked at to tell codes from bases.
SNIFF = 10


def first_column(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """First column before a comma or tab, without quotes, BOM and blanks; blank lines are left out."""
    text = F.trim(F.regexp_replace(F.split(F.regexp_replace(F.col(line), "^﻿", ""), "[,\t]")[0], "[\"'\r]", ""))
    return lines.select(text.alias("token"), *keep).where(F.length("token") > 0)


def is_code_list(tokens: list[str]) -> bool:
    """Whether the first tokens, after a header at most, are all digits."""
    rest = tokens[1:] if tokens and not tokens[0].isdigit() else tokens
    return bool(rest) and all(t.isdigit() for t in rest[:SNIFF])


def parse_barcodes(tokens: DataFrame, length: int | None = None) -> DataFrame:
    """``barcode`` of tokens in bases or decimal two-bit code (which needs the length), once each.

    Codes too large for the length, headers and other text are left out.
    """
    token = F.upper("token")
    code = F.when(token.rlike("^[0-9]{1,19}$"), token).cast("bigint")
    decoded = F.when((code >= 0) & (code < F.lit(4**length)), dna.decode(code, length)) if length else F.lit(None).cast("string")
    return tokens.select(F.coalesce(F.when(dna.is_plain(token), token), decoded).alias("barcode")).where("barcode is not null").distinct()


def malformed(tokens: DataFrame, length: int) -> DataFrame:
    """Tokens that are neither plain bases of the length nor a code that fits it."""
    token = F.upper("token")
    code = F.when(token.rlike("^[0-9]{1,19}$"), token).cast("bigint")
    ok = (dna.is_plain(token) & (F.length("token") == length)) | ((code >= 0) & (code < F.lit(4**length)))
    return tokens.where(~F.coalesce(ok, F.lit(False)))


def read_whitelist(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """Barcodes of a list file; one of codes, by its first lines, needs the length."""
    tokens = first_column(spark.read.text(path))
    if length is None and is_code_list([r[0] for r in tokens.limit(SNIFF + 1).collect()]):
        raise ValueError(f"{path} holds codes; the length of its barcodes must be given")
    return parse_barcodes(tokens, length)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and 0-based ``line`` in file order, by the place of each block in its file and each line in its block."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    first, offsets = 0, []
    for f, b, n in sorted(tuple(r) for r in lines.groupBy("f", "b").agg(F.count(F.lit(1))).collect()):  # a row per block
        offsets.append((f, b, first))
        first += n
    where = spark.createDataFrame(offsets, "f string, b bigint, first bigint")
    at = F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) - 1
    return lines.withColumn("at", at).join(F.broadcast(where), ["f", "b"]).select("value", (F.col("first") + F.col("at")).alias("line"))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """barcode and its dense ordinal in file order (first place of repeated ones); a header whitelist_bcs is skipped."""
    text = numbered_lines(spark, path)
    rows = first_column(text.select("value", "line"), keep=("line",)).where(~((F.col("line") == 0) & (F.lower("token") == "whitelist_bcs")))
    places = rows.groupBy(F.col("token").alias("barcode")).agg(F.min("line").alias("line"))
    # a reference list of some millions at most, numbered once
    return places.select((F.row_number().over(Window.orderBy("line")) - 1).cast("int").alias("ordinal"), "barcode")


def import_whitelists(spark: SparkSession, specs: dict[str, str], lengths: dict[str, int]) -> DataFrame:
    """class_id, role and barcode for 'a' or 'a:b' per class; sizes decide the roles."""
    out = None
    for class_id, spec in specs.items():
        for i, path in enumerate([p for p in spec.split(":") if p][:2]):
            df = read_whitelist(spark, path, lengths.get(class_id)).select(F.lit(class_id).alias("class_id"), F.lit(i).alias("spec"), "barcode")
            out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("a barcode element needs a reference list")
    return assign_roles(out)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """barcode and n of a count table: named or positional columns, comma or tab, # comments; repeated barcodes add up."""
    lines = spark.read.text(path).where(~F.startswith(F.ltrim("value"), F.lit("#")) & (F.length(F.trim("value")) > 0))
    head = lines.limit(1).collect()
    if not head:
        raise ValueError("the count table is empty")
    sep = "\t" if "\t" in head[0][0] else ","
    names = [c.strip().strip("\"'﻿\r").lower() for c in head[0][0].split(sep)]
    named = "barcode" in names and ("count" in names or "n" in names)
    b, n = (names.index("barcode"), names.index("count" if "count" in names else "n")) if named else (0, 1)
    cell = lambda i: F.trim(F.regexp_replace(F.get(F.split("value", sep), F.lit(i)), "[\"'﻿\r]", ""))
    rows = lines.select(F.upper(cell(b)).alias("barcode"), F.when(cell(n).rlike("^[0-9]{1,18}$"), cell(n)).cast("bigint").alias("n"))
    return rows.where("n > 0 and barcode rlike '^[ACGTN]+$'").groupBy("barcode").agg(F.sum("n").alias("n"))


def read_pair_matrix(spark: SparkSession, path: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs a headerless 0/1 matrix allows: a line for each barcode of the first list, no more and no fewer."""
    lines = numbered_lines(spark, path).where(F.length(F.trim("value")) > 0)
    n, want = lines.count(), first.count()
    if n != want:
        raise ValueError(f"the pair matrix has {n} lines for {want} barcodes")
    return matrix_pairs(lines.select(F.col("line").cast("int").alias("ordinal"), F.col("value").alias("line")), first, second)
