"""Records of the shapes the operators read, derived from the given tables by Spark."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checks-"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly row-wise work; files with fewer row groups than there are cores are dealt out first."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records from ``documents``: the first line asks, the others answer.

    English and Spanish documents are problem/solution pairs (one-line documents
    have no solution), French and German ones also carry messages. Answers end in a
    boxed character count, written differently per language; ``src3`` has none.
    ``src7`` becomes a contaminated source, ``src11`` a missing one.
    """
    lang, source, size = F.col("lang"), F.col("source"), F.col("n_chars").cast("string")
    lines = F.split("text", "\n")
    box = (
        F.when(source == "src3", "")
        .when(lang == "en", F.concat(F.lit("\\boxed{"), size, F.lit("}")))
        .when(lang == "es", F.concat(F.lit("\\boxed{\\frac{1}{"), size, F.lit("}}")))
        .when(lang == "fr", F.concat(F.lit("x \\boxed{ "), size, F.lit(" } and \\boxed{")))
        .otherwise(F.concat(F.lit("\\boxed{0} or \\boxed{"), size, F.lit("}")))
    )
    df = texts(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "text", "lang", "source", "n_chars",
        lines.alias("lines"), box.alias("box"),
    )
    ask, rest = F.col("lines")[0], F.slice("lines", F.lit(2), F.size("lines"))

    def message(role, content):
        return F.struct(role.alias("role"), content.alias("content"))

    said = F.transform(
        "lines", lambda line, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), line)
    )
    closing = F.array(
        message(F.lit("assistant"), F.concat(F.lit("so "), "box")),
        message(F.lit("assistant"), F.lit("")),
    )
    told = F.array(
        F.struct(F.lit("human").alias("from"), ask.alias("value"),
                 F.lit(None).cast("struct<value:string>").alias("ground_truth")),
        F.struct(F.lit("assistant").alias("from"), F.lit("").alias("value"),
                 F.struct(F.concat(F.lit("told "), "box").alias("value")).alias("ground_truth")),
    )
    return df.select(
        "row_id",
        F.when(lang != "fr", ask).alias("problem"),
        F.when(F.size("lines") == 1, "")
        .otherwise(F.concat(F.array_join(rest, "\n"), F.lit("\n"), F.col("box")))
        .alias("solution"),
        F.when(lang.isin("fr", "de"), F.concat(said, closing)).alias("messages"),
        F.when(source == "src2", told).alias("conversations"),
        F.when(source == "src7", F.concat(F.lit("GSM8K/"), lang))
        .when(source != "src11", source)
        .alias("source"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target answers from ``orders``: 1..50 as integer, fraction or amount; some missing, some long, with an exponent or a name."""
    n = F.col("o_custkey") % 50 + 1
    rare = (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 10 == 0)
    zeros = F.lit("0" * 20)
    answer = (
        F.when(rare & (F.col("o_orderpriority") == "2-HIGH"), F.concat(n.cast("string"), zeros, F.lit("/1"), zeros))
        .when(rare & (F.col("o_orderpriority") == "3-MEDIUM"), F.concat(n.cast("string"), F.lit("0e-1")))
        .when(rare & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), F.concat(F.lit("x*"), n.cast("string"), F.lit("+1")))
        .when(F.col("o_orderstatus") == "F", n.cast("string"))
        .when(F.col("o_orderstatus") == "O", F.concat((n * 2).cast("string"), F.lit("/2")))
        .when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("$"), n.cast("string"), F.lit(".")))
    )
    ask = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(", "), "o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), ask.alias("instruction"), answer.alias("final_answer")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts from ``lineitem``: a boxed quantity in several notations; some without a box."""
    n = F.col("l_quantity").cast("bigint").cast("string")
    discount = F.col("l_discount")
    answer = (
        F.when(discount == 0.05, F.concat(F.lit("x = "), n, F.lit(" cm")))
        .when((discount == 0.09) & (F.col("l_linenumber") == 3), F.concat(F.lit("1 + "), n, F.lit(" * x")))
        .when((discount == 0.08) & (F.col("l_linenumber") == 3), F.concat(n, F.lit("." + "0" * 25)))
        .when(discount == 0.1, F.concat(n, F.lit("/1")))
        .when(F.col("l_linestatus") == "F", n)
        .otherwise(F.col("l_quantity").cast("string"))
    )
    text = F.when(discount == 0.0, F.concat(F.lit("I think it is "), answer)).otherwise(
        F.concat(F.lit("First \\boxed{0}, then \\boxed{ "), answer, F.lit(" }."))
    )
    return texts(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        F.col("l_returnflag").alias("model"),
        "l_partkey",
        "l_linenumber",
        text.alias("generation"),
    )


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of expressions from ``orders``; every second pair differs by one in a coefficient, some are no expressions."""
    a, b = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 1000 + 1).cast("string")
    off = (F.col("o_orderkey") + F.col("o_orderkey") % 2).cast("string")
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_custkey") % 7

    def pair(left: list[Column | str], right: list[Column | str]) -> Column:
        parts = [F.concat(*(F.lit(x) if isinstance(x, str) else x for x in side)) for side in (left, right)]
        return F.struct(parts[0].alias("said"), parts[1].alias("meant"))

    made = (
        F.when(kind == 0, pair([a, "*x + ", key], [off, "+x*", a]))
        .when(kind == 1, pair(["(x + ", b, ")*(x - ", b, ") + ", key], ["x^2 + ", off, " - ", b, "**2"]))
        .when(kind == 2, pair(["(x^2 - y^2)/(x - y) - ", key], ["y - ", off, " + x"]))
        .when(kind == 3, pair(["-x/", b, " + ", key, ".50"], ["(", off, " + 1/2) - x/", b]))
        .when(kind == 4, pair([key, "*y**-1"], [off, "/y"]))
        .when(kind == 5, pair([key, "x"], [off, "*x"]))
        .otherwise(pair(["f(x) + ", key], [off, " + f(x)"]))
    )
    return texts(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", made.alias("pair")).select("o_orderkey", "o_custkey", "pair.*")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per experiment and benchmark from ``orders``: share of large orders."""
    experiment = (
        F.when(F.col("o_orderstatus") == "F", "Baseline")
        .when(F.col("o_orderstatus") == "O", "Finetuned")
        .otherwise("Third run")
    )
    names = {"1-URGENT": "Reasoning", "2-HIGH": "HellaSwag", "3-MEDIUM": "MMLU", "4-NOT SPECIFIED": "GSM8K"}
    benchmark = F.coalesce(
        *[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in names.items()], F.lit("Other")
    )
    large = F.count_if(F.col("o_totalprice") > 250000) / F.count(F.lit(1)) * 100.0
    per = table(spark, sf_dir, "orders").groupBy(experiment.alias("experiment"), benchmark.alias("benchmark"))
    absent = (F.col("experiment") == "Third run") & F.col("benchmark").isin("Reasoning", "GSM8K")
    return per.agg(large.alias("score")).where(~absent)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark results from ``part``, as JSON: one task per model, with varying metric keys among other values."""
    value, size = F.col("p_retailprice") / 10000.0, F.col("p_size")
    task = (
        F.when(F.col("p_type") == "ECONOMY", "hellaswag")
        .when(F.col("p_type") == "SMALL", "mmlu")
        .when(F.col("p_type") == "LARGE", "gsm8k")
        .otherwise("other")
    )
    none = F.lit(None).cast("double")

    def metric(when: Column, number: Column) -> Column:
        return F.when(when, number).otherwise(none)

    mid = (size >= 30) & (size < 40)
    found = F.struct(
        task.alias("alias"),
        F.lit("N/A").alias("acc_stderr,none"),
        metric(size < 10, value).alias("acc,none"),
        metric((size >= 10) & (size < 20), value).alias("acc_norm"),
        metric((size >= 10) & (size < 20), value / 2).alias("acc"),
        metric((size >= 20) & (size < 30), value).alias("exact_match"),
        metric(mid, value).alias("acc_norm,none"),
        metric(mid, value / 4).alias("exact_match,strict-match"),
        F.when(mid, F.array(value, value)).alias("samples"),
    )
    # At sizes from 30 to 39 the plain accuracy is what is left for a task without its own metric.
    found = found.withField("acc", F.coalesce(found["acc"], metric(mid, value / 8)))
    record = F.struct(
        F.col("p_partkey").cast("string").alias("model"),
        F.map_from_arrays(F.array(task), F.array(found)).alias("results"),
        F.struct(F.lit("sample").alias("note"), F.array(F.lit(1)).alias("versions")).alias("config"),
    )
    return texts(spark, sf_dir, "part").select(F.to_json(record).alias("value"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse log rows from ``events``: a run per user, with loss, accuracy, both or no step."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run"),
        F.when(kind != "error", F.col("event_id")).alias("step"),
        F.when(kind.isin("click", "view", "error"), value).alias("loss"),
        F.when(kind.isin("purchase", "view"), value / 1000.0).alias("eval_accuracy"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays from ``documents``: the length of each word."""
    words = F.transform(F.split("text", " "), F.length)
    return texts(spark, sf_dir, "documents").select("doc_id", words.alias("tokens"))
