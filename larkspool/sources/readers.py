"""Readers. All schemas are declared: nothing is inferred by an extra pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspool.fixed_values import MATH_SYSTEM_PROMPT
from larkspool.functions.chat import chat_text
from larkspool.operators.filters import compute_and_keep
from larkspool.schemas import CURATED, RAW, RESULTS
from larkspool.sources.lines import line_positions, numbered


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """JSON lines; a field that a record lacks reads as null, a line that is no record is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_raw(
    spark: SparkSession, name_or_path: str, split: str = "train", schema: T.StructType = RAW
) -> DataFrame:
    """Raw records from a path if it exists, else the ``split`` of a table of that name.

    Paths hold JSON lines, or Parquet if the name ends in ``.parquet``.
    """
    if _exists(spark, name_or_path):
        if name_or_path.endswith(".parquet"):
            return spark.read.parquet(name_or_path)
        return read_jsonl(spark, name_or_path, schema)
    table = spark.table(name_or_path)
    return table.where(F.col("split") == split).drop("split") if "split" in table.columns else table


def ingest(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Give records without a stable id one, once, and keep them in the shared folder.

    Ids count the lines of all files in the order of file names, from 0, and are the same
    however Spark splits the files. Records that come from no files are counted in the order of a digest of
    their content. On the way, JSON becomes Parquet, which later passes read by column.
    """
    return numbered(df, row_id)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system of ``path`` has it; globs count if anything matches."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.globStatus(hadoop_path))


def read_results(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Stored benchmark results: model and a map task -> metric -> value.

    One record per line, or with ``whole_files`` one per file, over as many lines as it likes.
    """
    return parse_results(spark.read.text(path, wholetext=whole_files))


def parse_results(records: DataFrame) -> DataFrame:
    """``model`` and ``results`` of JSON records in the column ``value``, whatever else they hold.

    A record names its model in ``model`` or ``model_name``. Of a task's entries only numbers
    are metrics: texts such as aliases and "N/A", nulls, booleans and nested values are left
    out, as are tasks that are no objects. A blank line is no record; one that is no JSON
    object is an error. The literals NaN and Infinity, which some writers use, count as null.
    """
    # The look-behind is tried at every character, so only where there is something to find.
    literal = F.contains("value", F.lit("NaN")) | F.contains("value", F.lit("Infinity"))
    plain = F.regexp_replace("value", r"(?<=[:\[,]\s{0,9})(?:NaN|-?Infinity)(?=\s*[,}\]])", "null")
    text = F.when(literal, plain).otherwise(F.col("value"))
    # A filter on the text would move below its making and make it twice, ahead of an exchange.
    parsed = F.when(F.regexp_like("value", F.lit(r"\S")), F.parse_json(text))
    whole = compute_and_keep(records, [], {"record": parsed}, lambda row: row["record"].isNotNull())
    broken = F.raise_error(F.concat(F.lit("no record: "), F.left(F.to_json("record"), F.lit(80))))
    checked = whole.select(F.when(F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")), F.col("record")).otherwise(broken).alias("record"))

    def entries(value: Column) -> Column:
        return F.try_variant_get(value, "$", "map<string,variant>")

    def number(value: Column) -> Column:
        kind = F.regexp_like(F.schema_of_variant(value), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
        return F.when(kind, F.try_variant_get(value, "$", "double"))

    tasks = F.transform_values(F.try_variant_get("record", "$.results", "map<string,variant>"), lambda _, task: entries(task))
    tasks = F.map_filter(tasks, lambda _, task: task.isNotNull())
    metrics = F.transform_values(tasks, lambda _, task: F.map_filter(F.transform_values(task, lambda _, v: number(v)), lambda _, v: v.isNotNull()))
    names = [F.try_variant_get("record", f"$.{name}", "string") for name in ("model", "model_name")]
    return checked.select(F.coalesce(*names).alias("model"), metrics.cast(RESULTS["results"].dataType).alias("results"))


def read_splits(spark: SparkSession, folder: str, schema: T.StructType, pos: bool = False) -> DataFrame:
    """All split files below ``folder`` with their ``split``; a filter on it prunes folders. A broken line is an error.

    With ``pos`` the rows have their position within the split, as they were written.
    """
    found = read_jsonl(spark, folder, T.StructType([*schema.fields, T.StructField("split", T.StringType())]))
    return line_positions(found, "pos", ["split"]) if pos else found


def training_text(spark: SparkSession, folder: str, system_prompt: str = MATH_SYSTEM_PROMPT) -> DataFrame:
    """split, pos and chat text of stored curated rows, ready for a tokenizer."""
    rows = read_splits(spark, folder, CURATED, pos=True)
    return rows.select("split", "pos", chat_text(F.col("instruction"), F.col("output"), system_prompt).alias("text"))
