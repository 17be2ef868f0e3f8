"""File sources and sinks: template packs, registries, latency files, dumps, schema texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packs import extracted_refs
from ..functions.scalars import sanitized, two_weeks_from
from ..model import SCHEMAS

PACK = "templates ARRAY<STRING>, _corrupt STRING"
TEMPLATE = """name STRING, polymorphic_discriminator STRING, category STRING, type STRING, subtype STRING, version STRING,
instance_prefix STRING, instance_polymorphic_identity STRING, validator_ref STRING, bstatus STRING, is_singleton BOOLEAN"""


def template_packs(spark: SparkSession, *folders: str) -> DataFrame:
    """The templates of all packs (JSON files) with their source file, their JSON and the codes that they refer to.

    Files, and files in a folder, whose name begins with _ are skipped, and so are files that can't be
    parsed (``unreadable_packs``) and list items that are no objects.
    """
    read = spark.read.schema(PACK).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    packs = read.json(list(folders)).withColumn("source", F.input_file_name())
    packs = packs.where(F.col("_corrupt").isNull() & ~F.col("source").rlike("/_[^/]*(/[^/]*)?$"))
    each = packs.select("source", F.explode("templates").alias("json")).where(F.ltrim("json").startswith("{"))
    return each.select("source", F.from_json("json", TEMPLATE).alias("t"), "json").select("source", "t.*", "json", extracted_refs(F.col("json")).alias("refs"))


def unreadable_packs(spark: SparkSession, *folders: str) -> DataFrame:
    """source, level, message of packs that aren't JSON objects with a list of templates."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(list(folders), wholetext=True).withColumn("source", F.input_file_name())
    text = text.where(~F.col("source").rlike("/_[^/]*(/[^/]*)?$"))
    parsed = F.try_parse_json("value")
    message = F.when(parsed.isNull(), "Invalid JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "Config root must be an object")
    message = message.when(F.expr("coalesce(schema_of_variant(variant_get(try_parse_json(value), '$.templates')), '') NOT LIKE 'ARRAY%'"), "templates must be a list")
    return text.select("source", F.lit("error").alias("level"), message.alias("message")).where("message is not null")


def domain_registry(spark: SparkSession, path: str) -> DataFrame:
    """domain and its description, from a JSON object with ``domains``."""
    return spark.read.schema("domains MAP<STRING, STRING>").option("multiLine", True).json(path).select(F.explode("domains").alias("domain", "description"))


def prefix_registry(spark: SparkSession, path: str) -> DataFrame:
    """domain, prefix, owner, from a JSON object ``ownership`` of domains, prefixes and owners."""
    nested = spark.read.schema("ownership MAP<STRING, MAP<STRING, STRING>>").option("multiLine", True).json(path)
    return nested.select(F.explode("ownership").alias("domain", "held")).select("domain", F.explode("held").alias("prefix", "owner"))


def read_latencies(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Latency rows of tab-separated files; rows with too few fields are dropped. ``last`` keeps the newest."""
    rows = spark.read.schema(SCHEMAS["metrics"]).option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    rows = rows.where("ts_utc is not null and duration_ms is not null").withColumn("ok", F.col("ok") == "1")
    return rows if last is None else rows.orderBy(F.desc("ts_utc")).limit(last)


def write_latencies(rows: DataFrame, path: str) -> None:
    """Latency rows as tab-separated files, a folder for each pair of weeks."""
    texts = [c for c, kind in rows.dtypes if kind == "string" and c != "ts_utc"]
    out = rows.withColumns({c: sanitized(F.col(c)) for c in texts}).withColumn("period", two_weeks_from(F.to_timestamp("ts_utc")))
    out.write.mode("append").partitionBy("period").option("sep", "\t").option("header", True).csv(path)


def dump(path: str, **tables: DataFrame) -> None:
    """All tables, delivery tables included, as Parquet."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def series(spark: SparkSession, n: int) -> DataFrame:
    """0 to n - 1."""
    return spark.range(n)


def schema_objects(spark: SparkSession, path: str) -> DataFrame:
    """object_class, name of what SQL files create; line comments don't count."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"--[^\n]*", "").alias("sql"))
    found = F.regexp_extract_all("sql", F.lit(r'(?i)create\s+(?:or\s+replace\s+)?(?:unique\s+)?((?:table|view|index|sequence|function|trigger)\s+(?:if\s+not\s+exists\s+)?[\w.\"]+)'), 1)
    words = F.split(F.regexp_replace(F.col("o"), r"(?i)\s+if\s+not\s+exists", ""), r"\s+")
    return text.select(F.explode(found).alias("o")).select(F.lower(words[0]).alias("object_class"), F.replace(words[1], F.lit('"'), F.lit("")).alias("name")).distinct()


def catalog_objects(spark: SparkSession, database: str) -> DataFrame:
    """object_class, name of a database's tables and their columns."""
    rows = []
    for table in spark.catalog.listTables(database):
        rows.append(("table", table.name))
        rows += [("column", f"{table.name}.{c.name}") for c in spark.catalog.listColumns(f"{database}.{table.name}")]
    return spark.createDataFrame(rows, "object_class string, name string")
