import json
import random

import pytest
from pyspark.sql import functions as F

from larkspool.operators.filters import drop_sources
from larkspool.operators.grading import grade
from larkspool.operators.records import curate, extract_qa
from larkspool.operators.ranks import positions
from larkspool.operators.staging import shared_folder
from larkspool.plans.curation import curate_dataset
from larkspool.schemas import CURATED, RAW
from larkspool.sources import readers
from tests import models


def raw_rows(n, seed=6):
    rnd = random.Random(seed)
    rows = []
    for i in rnd.sample(range(10 * n), n):
        source = rnd.choice(["hot"] * 6 + ["a", "b", "c", "GSM8K-x", None, None])
        question = rnd.choice(["", f"Frage {rnd.randrange(4 * n)} ü", "the hot question"][0 if rnd.random() < 0.1 else 1 :])
        answer = rnd.choice([f"so \\boxed{{{rnd.randrange(n)}}} {i % 50}", f"\\boxed{{\\frac{{1}}{{{i}}}}}", f"no box {i}"])
        messages = None
        if rnd.random() < 0.3:
            messages = [{"role": "user", "content": f"msg {i}"}, {"role": "assistant", "content": f"said \\boxed{{m{i}}}"}]
        rows.append((i, question, answer if rnd.random() < 0.9 else None, messages, None, source))
    return rows


def expected(rows, size, cap):
    usable = []
    for i, question, answer, messages, _, source in rows:
        if "gsm8k" in (source or "").lower():
            continue
        q, a = question, answer or ""
        if messages and not (q and a):
            q, a = q or messages[0]["content"], messages[1]["content"]
        if models.normalized(q) and models.normalized(a):
            usable.append((i, models.normalized(q), models.normalized(a), source))
    once = models.first_by(usable, lambda r: r[1], lambda r: r[0])
    unique = models.first_by(once, lambda r: r[2], lambda r: r[0])
    sample = models.proportional([(r[0], r[3]) for r in unique], size)
    final = {}
    for i, question, answer, messages, _, source in rows:
        q, a = question, answer or ""
        if messages:
            q, a = q or messages[0]["content"], messages[1]["content"]
        if i in sample and q and a and models.boxed(a):
            final[i] = (q, a, models.boxed(a), source or "None")
    order = models.stratified([(i, r[3]) for i, r in final.items()])
    n = len(order)
    ends = [int(n * 0.90), int(n * 0.95)]
    parts = {"train": order[: ends[0]], "eval": order[ends[0] : ends[1]], "test": order[ends[1] :]}
    for split in ("eval", "test"):
        parts[split] = models.capped([(i, final[i][3]) for i in parts[split]], cap)
    rows = sorted((i, *final[i], split, pos) for split, ids in parts.items() for pos, i in enumerate(ids))
    return rows, (len(usable), len(unique), min(size, len(unique)), n)


def result(curation):
    rows = curation.rows.collect()
    return sorted((r.row_id, r.instruction, r.output, r.final_answer, r.source, r.split, r.pos) for r in rows)


def test_curation_equals_model(spark, strategy):
    # Below and above the number of unique rows.
    size = 100_000 if strategy == "salted" else 150
    rows = raw_rows(600)
    want, counts = expected(rows, size, 5)
    curation = curate_dataset(spark.createDataFrame(rows, RAW).repartition(9), size, cap=5)
    assert result(curation) == want
    audit = {r.stage: (r.rows_in, r.rows_out) for r in curation.audit.collect()}
    clean = sum("gsm8k" not in (r[5] or "").lower() for r in rows)
    assert audit["source_filter"] == (600, clean)
    assert audit["non_empty"] == (clean, counts[0])
    assert audit["dedup"] == (counts[0], counts[1])
    assert audit["sample"] == (counts[1], counts[2])
    assert audit["boxed_answer"] == (counts[2], counts[3])
    assert audit["eval"][1] == sum(r[5] == "eval" for r in want)


def test_layout_does_not_matter(spark):
    rows = raw_rows(300)
    df = spark.createDataFrame(rows[::-1], RAW).repartition(64)
    assert result(curate_dataset(df, 100, cap=4)) == expected(rows, 100, 4)[0]


def test_without_source_column(spark):
    curation = curate_dataset(spark.createDataFrame(raw_rows(200), RAW).drop("source"), 80)
    assert {r[4] for r in result(curation)} == {"unknown"}


def test_nothing_valid(spark):
    df = spark.createDataFrame([(1, "q", "no box", None, None, "a")], RAW)
    with pytest.raises(ValueError):
        curate_dataset(df)


def test_split_files_keep_order_and_text(spark, tmp_path):
    curation = curate_dataset(spark.createDataFrame(raw_rows(400), RAW), 300)
    folder = str(tmp_path / "out")
    curation.write(folder, rows_per_file=50)
    for split in ("train", "eval", "test"):
        files = sorted((tmp_path / "out" / f"split={split}").glob("part-*"))
        assert len(files) == -(-curation.sizes[split] // 50)
        raw_lines = [line for f in files for line in f.read_text(encoding="utf-8").splitlines()]
        want = curation.rows.where(F.col("split") == split).orderBy("pos").collect()
        assert [json.loads(line) for line in raw_lines] == [{c: r[c] for c in CURATED.fieldNames()} for r in want]
        assert "ü" in "".join(raw_lines)
    back = readers.read_splits(spark, folder, CURATED)
    assert back.count() == curation.rows.count()
    assert CURATED.fieldNames() == ["instruction", "output", "final_answer", "source"]


def test_read_raw(spark, tmp_path):
    rows = spark.createDataFrame(raw_rows(20), RAW)
    rows.write.json(str(tmp_path / "j"))
    rows.write.parquet(str(tmp_path / "p.parquet"))
    for name in ("j", "p.parquet"):
        assert sorted(readers.read_raw(spark, str(tmp_path / name)).collect()) == sorted(rows.collect())
    rows.withColumn("split", F.when(F.col("row_id") % 2 == 0, "train").otherwise("test")).createOrReplaceTempView("some_set")
    assert readers.read_raw(spark, "some_set", "test").where("row_id % 2 = 0").count() == 0
    rows.createOrReplaceTempView("no_split")
    assert readers.read_raw(spark, "no_split").count() == 20


def test_ingest_numbers_lines_once(spark, tmp_path):
    lines = [json.dumps({"problem": f"p{i}", "solution": "s" * (i % 9)}) for i in range(3000)]
    (tmp_path / "raw.jsonl").write_text("\n".join(lines) + "\n")
    rows = readers.ingest(readers.read_raw(spark, str(tmp_path / "raw.jsonl")).repartition(1))
    assert [r.problem for r in rows.orderBy("row_id").collect()] == [f"p{i}" for i in range(3000)]
    assert rows.repartition(7).select("row_id").distinct().count() == 3000


def test_read_results(spark, tmp_path):
    stored = {"model": "m", "results": {"mmlu": {"acc": 0.5}, "gsm8k": {"exact_match": 1.0}}}
    (tmp_path / "r.json").write_text(json.dumps(stored) + "\n")
    row = readers.read_results(spark, str(tmp_path / "r.json")).first()
    assert row.asDict() == stored


def test_read_results_ignores_what_is_no_number(spark, tmp_path):
    metrics = {"acc,none": 0.5, "n": 3, "alias": "mmlu", "acc_stderr,none": "N/A", "x": None, "list": [1, [2]], "flag": True, "text": "0.7"}
    lines = [
        json.dumps({"model": "a", "results": {"mmlu": metrics, "notes": 3, "more": [1], "none": None, "empty": {}}, "config": {"s": ":[,NaN"}}),
        "  ",
        '{"model_name": "b", "results": {"gsm8k": {"acc": NaN, "exact_match": 1e-1, "p": -Infinity}}}',
        '{"model": "c"}', '{"results": null}', '{"model": "d", "results": [1]}',
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    got = [tuple(r) for r in readers.read_results(spark, str(tmp_path / "r.json")).collect()]
    assert got == [
        ("a", {"mmlu": {"acc,none": 0.5, "n": 3.0}, "empty": {}}), ("b", {"gsm8k": {"exact_match": 0.1}}),
        ("c", None), (None, None), ("d", None),
    ]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "one.json").write_text(json.dumps({"model": "a", "results": {"mmlu": metrics}}, indent=2))
    assert [r.results for r in readers.read_results(spark, str(tmp_path / "whole"), whole_files=True).collect()] == [{"mmlu": {"acc,none": 0.5, "n": 3.0}}]


@pytest.mark.parametrize("line", ['{"model": "a", "results": {', "[1]", "3"])
def test_broken_results_are_an_error(spark, tmp_path, line):
    (tmp_path / "r.json").write_text('{"model": "a", "results": {}}\n' + line + "\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|no record"):
        readers.read_results(spark, str(tmp_path / "r.json")).collect()


def test_row_wise_operators_on_a_stream(spark, tmp_path):
    rows = raw_rows(50)
    batch = spark.createDataFrame(rows, RAW)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))

    def work(df):
        rows = extract_qa(curate(drop_sources(df)).withColumn("problem", F.col("instruction")))
        return grade(rows.withColumn("predicted_answer", F.col("final_answer"))).drop("problem", "messages", "solution")

    query = work(stream).writeStream.format("memory").queryName("graded_stream").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("graded_stream").collect()) == sorted(work(batch).collect())


def test_positions_never_use_one_task(spark):
    """An exploded table is estimated far too small; its order must still come from a range shuffle."""
    df = spark.range(1000).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("id", F.col("id") * 20 + F.col("x"))
    ranged = positions(df.select("id"), ["id"])
    got = sorted((r.id, r.pos) for r in ranged.collect())
    assert [p for _, p in got] == list(range(20_000))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
