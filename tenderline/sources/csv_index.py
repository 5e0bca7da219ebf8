"""The contract index: CSV with a header, commas, quotes anywhere in a field, one record a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import amount_strict
from ..functions.identity import row_hash
from ..functions.text import business_number, display_number, non_blank

# The index's columns.
REQUIRED = ("biz_no", "business_name", "contract_date", "contract_name")
OPTIONAL = (
    "representative_name", "address", "business_category", "notice_no", "notice_order", "notice_name", "contract_no", "unified_contract_no",
    "current_contract_amount", "total_contract_amount", "demand_agency_code", "demand_agency_name", "contract_agency_code", "contract_agency_name",
    "contract_method", "winning_method", "business_name_at_contract", "contract_detail_url", "notice_detail_url", "raw_source_url",
)


#: A field after its comma: plain characters and quoted runs, in any order; a run without an end lasts to the line's end.
_FIELD = r',((?:[^",]++|"(?:[^"]|"")*+(?:"|$))*+)'


def fields_of(line: Column) -> Column:
    """The fields of a line. A quote opens and closes anywhere in a field; two of them inside a quoted run are one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    return F.transform(raw, lambda f: F.replace(F.regexp_replace(f, '"((?:[^"]|"")*+)(?:"|$)', "$1"), F.lit('""'), F.lit('"')))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value. Lines are numbered where they lie; only the number of lines of each split comes to the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits, before = [], {}
    for r in lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy("file", "at").collect():
        splits.append((r["file"], r["at"], before.get(r["file"], 0) - r["first"] + 1))
        before[r["file"]] = before.get(r["file"], 0) + r["n"]
    known = spark.createDataFrame(splits, "file string, at long, shift long")
    value = F.rtrim(F.regexp_replace("value", "^\ufeff", ""), F.lit("\r"))
    return lines.join(F.broadcast(known), ["file", "at"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), value.alias("value"))


def header_of(lines: DataFrame) -> list[str]:
    """The names in the first line that is not blank; raises on an empty file, a repeated or a missing name."""
    first = lines.where(F.trim("value") != "").orderBy("file", "line_no").select(fields_of(F.col("value")).alias("f")).first()
    if first is None:
        raise ValueError("the file is empty")
    names = [x.strip() for x in first["f"]]
    repeated = sorted({n for n in names if names.count(n) > 1})
    missing = [n for n in REQUIRED if n not in names]
    if repeated or missing:
        raise ValueError(f"repeated columns: {repeated}; missing columns: {missing}")
    return names


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): canonical contract rows, and the raw line with its number and a reason for each line that makes none."""
    lines = _numbered(spark, path)
    names = header_of(lines)
    lines = lines.where(F.trim("value") != "")
    heads = lines.groupBy("file").agg(F.min("line_no").alias("line_no"))  # a row a file
    raw = lines.join(F.broadcast(heads), ["file", "line_no"], "left_anti").withColumn("_f", fields_of(F.col("value")))
    # Columns go by place, as the header was read above.
    raw = raw.select("line_no", (F.size("_f") != len(names)).alias("_bad"), *(F.nullif(F.get("_f", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)))
    fields = {n: non_blank(F.col(n)) if n in names else F.lit(None).cast("string") for n in (*REQUIRED, *OPTIONAL)}
    checked = raw.select("*", F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))).alias("_row"))
    date_ok = fields["contract_date"].rlike(r"^\d{4}-\d{2}-\d{2}$")

    def amount_bad(n):
        return fields[n].isNotNull() & amount_strict(fields[n], suffix=False).isNull()

    reason = (
        F.when(F.col("_bad"), "field count")
        .when(F.concat_ws("", *(F.when(fields[n].isNull(), n) for n in REQUIRED)) != "", F.concat(F.lit("missing "), F.concat_ws(", ", *(F.when(fields[n].isNull(), n) for n in REQUIRED))))
        .when(business_number(fields["biz_no"]).isNull(), "biz_no")
        .when(~date_ok, "contract_date")
        .when(amount_bad("current_contract_amount"), "current_contract_amount")
        .when(amount_bad("total_contract_amount"), "total_contract_amount")
    )
    checked = checked.withColumn("_reason", reason)
    good = checked.where("_reason is null")
    rows = good.select(
        F.lit("csv").alias("source_dataset"), row_hash(F.col("_row")).alias("source_row_hash"), business_number(fields["biz_no"]).alias("biz_no_normalized"), display_number(business_number(fields["biz_no"])).alias("biz_no_display"),
        *(amount_strict(fields[n], suffix=False).alias(n) if n.endswith("_amount") else fields[n].alias(n) for n in (*REQUIRED[1:], *OPTIONAL)),
    )
    return rows, checked.where("_reason is not null").select("line_no", F.col("_row").alias("row"), F.col("_reason").alias("reason"))
