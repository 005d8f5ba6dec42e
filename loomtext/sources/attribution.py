"""Attribution texts: which article has which licence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import license_flags, license_id


# The grammar of attribution lines, fixed values.
CHECKSUM_LINE = r"(?i)^(?:checksum|sha256|hash)\s*[:=]\s*([a-f0-9]{8,128})\s*$"
LICENCE_LINE = r"(?i)\b(?:license|licence)\b\s*[:=]\s*(.+)$"
TABLE_LINE = r"(?i)^([a-f0-9]{8,128})\s*(?:[\t,;|]+|\s)\s*(\S.*)$"


def parse_attribution(texts: DataFrame, *, id_col: str = "path", text_col: str = "value") -> DataFrame:
    """(id, checksum, license_id, flags...) of block and tabular lines; the last statement of a checksum wins.

    A block is ``checksum: <hex>`` and ``license: <text>`` lines in any order, up
    to a blank line or the next checksum. Tabular lines are ``<hex>,<licence>``
    (also with tab, semicolon or bar) or ``<hex> <licence>``.
    """
    lines = texts.select(id_col, F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    checksum = F.regexp_extract("line", CHECKSUM_LINE, 1)
    licence = F.regexp_extract("line", LICENCE_LINE, 1)
    rows = lines.withColumn("c", F.nullif(checksum, F.lit(""))).withColumn("l", F.when(F.col("c").isNull(), F.nullif(F.trim(licence), F.lit(""))))
    plain = F.col("c").isNull() & F.col("l").isNull()
    rows = rows.withColumn("tc", F.when(plain, F.nullif(F.regexp_extract("line", TABLE_LINE, 1), F.lit("")))).withColumn("tl", F.when(plain, F.regexp_extract("line", TABLE_LINE, 2)))
    by = Window.partitionBy(id_col).orderBy("pos")
    blank = F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(by)
    rows = rows.withColumn("paragraph", blank)
    inside = Window.partitionBy(id_col, "paragraph").orderBy("pos")
    before = F.last("c", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col("c").isNotNull() & before.isNotNull() & (F.col("c") != before), 1).otherwise(0)
    rows = rows.withColumn("start", start).withColumn("block", F.sum("start").over(inside))
    blocks = rows.groupBy(id_col, "paragraph", "block").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("pos"))).alias("checksum"), F.max_by("l", F.when(F.col("l").isNotNull(), F.col("pos"))).alias("raw"), F.max("pos").alias("pos"))
    stated = blocks.where("checksum is not null").select(id_col, "checksum", F.coalesce("raw", F.lit("UNKNOWN")).alias("raw"), "pos")
    tabular = rows.where("tc is not null").select(id_col, F.col("tc").alias("checksum"), F.col("tl").alias("raw"), "pos")
    last = stated.unionByName(tabular).groupBy(id_col, "checksum").agg(F.max_by("raw", "pos").alias("raw"))
    return last.withColumn("license_id", license_id(F.col("raw"))).select(id_col, "checksum", "license_id", license_flags(F.col("license_id")).alias("f")).select(id_col, "checksum", "license_id", "f.*")
