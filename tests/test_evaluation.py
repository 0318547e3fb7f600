import pytest

from larkspool.operators import grading, metrics, reports
from larkspool.plans.evaluation import evaluate
from larkspool.schemas import RESULTS, RUN_LOG
from larkspool.sources import writers


def test_grade_expressions_and_long_numbers(spark):
    cases = [
        ("x+1", "1+x", "symbolic"), ("x + 1", "x - 1", "none"), ("(x+1)^2", "1+2x", "none"), ("(x+1)**2", "x^2+2*x+1", "symbolic"),
        ("1" + "0" * 40, "1e40", "numeric"), ("3" + "0" * 30 + "/1" + "0" * 30, "3", "numeric"), ("1e-2", "0.010", "numeric"),
        ("7" * 40 + "1", "7" * 40 + "2", "none"),
    ]
    df = spark.createDataFrame([(i, g, t) for i, (g, t, _) in enumerate(cases)], "i int, predicted_answer string, final_answer string")
    assert [r.match_kind for r in grading.grade(df).orderBy("i").collect()] == [k for _, _, k in cases]


def test_grade_golden(spark):
    cases = [
        ("19", "1", "none"), ("$1,000.", "1000", "exact"), ("1/2", "0.5", "numeric"), (None, "1", "none"),
        ("1", None, "none"), ("", "", "none"), ("0.5", "5", "contains"), ("-1", "1", "contains"),
        ("x = 7 cm", "7", "contains"), ("X", "x", "exact"), ("$", ",", "exact"), ("(a+b)", "a+b", "contains"),
        ("2", "3", "none"),
    ]
    df = spark.createDataFrame([(i, g, t) for i, (g, t, _) in enumerate(cases)], "i int, predicted_answer string, final_answer string")
    got = grading.grade(df).orderBy("i").collect()
    assert [r.match_kind for r in got] == [k for _, _, k in cases]
    assert [r.is_match for r in got] == [k != "none" for _, _, k in cases]


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [("m1", 1, "\\boxed{5}"), ("m1", 2, "no box 6"), ("m2", 1, "\\boxed{4}"), ("m2", 2, "\\boxed{1}\\boxed{6}"), ("m3", 2, "\\boxed{6.0}")]
    return spark.createDataFrame(rows, "model string, item_id bigint, generation string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([(1, "five?", "5"), (2, "six?", "6")], "item_id bigint, instruction string, final_answer string")


def test_accuracy_and_detail(spark, predictions, targets):
    extra = spark.createDataFrame([("m3", 9, "\\boxed{1}")], "model string, item_id bigint, generation string")
    found = grading.accuracy(predictions.unionByName(extra), targets).collect()
    assert {r.model: (r.accuracy, r.n, r.unanswered, r.orphans) for r in found} == {
        "m1": (50.0, 2, 0, 0), "m2": (50.0, 2, 0, 0), "m3": (50.0, 2, 1, 1),
    }
    assert grading.accuracy(predictions, targets, by=()).first().accuracy == 60.0
    assert grading.accuracy(predictions, targets.where("false"), by=()).first().accuracy is None
    graded = grading.grade_generations(predictions, targets)
    row = grading.detail(graded, "model").where("model = 'm1' and question = 'six?'").first()
    assert (row.prediction, row.predicted_answer, row.target, row.is_match) == ("no box 6", "", "6", False)


def test_accuracy_of_flat_and_nested_boxes(spark, targets):
    rows = [("m", 1, "\\boxed{0}, then \\boxed{ 5 }."), ("m", 2, "\\boxed{\\frac{12}{2}} \\boxed{6}"), ("n", 1, "\\boxed{5} \\boxed{6"), ("n", 2, "\\boxed{{6}}")]
    found = grading.accuracy(spark.createDataFrame(rows, "model string, item_id bigint, generation string"), targets)
    assert {r.model: (r.accuracy, r.n) for r in found.collect()} == {"m": (100.0, 2), "n": (100.0, 2)}
    # The pattern of flat boxes comes before the fold over braces.
    assert "regexp_extract(generation" in found._jdf.queryExecution().optimizedPlan().toString()


def test_targets_without_answers(spark, predictions, targets):
    graded = grading.grade_generations(predictions, targets.drop("final_answer"))
    assert {r.is_match for r in graded.collect()} == {False}


def test_metric_choice_and_evaluation(spark, predictions, targets):
    rows = [
        ("m1", {"hellaswag": {"acc_norm,none": 0.5, "acc_norm": 0.1, "acc,none": 0.2}, "mmlu": {"acc": 0.25}, "gsm8k": {"exact_match": 0.75, "acc": 0.1}}),
        ("m2", {"hellaswag": {"acc": 0.9}, "mmlu": {}, "gsm8k": {"acc": 0.125, "exact_match,flexible": 0.3}, "arc": {"acc": 1.0}}),
    ]
    results = spark.createDataFrame(rows, RESULTS)
    got = {(r.model, r.task): r.score for r in metrics.task_scores(results).collect()}
    assert got == {
        ("m1", "hellaswag"): 50.0, ("m1", "mmlu"): 25.0, ("m1", "gsm8k"): 75.0,
        ("m2", "hellaswag"): 0.0, ("m2", "mmlu"): 0.0, ("m2", "gsm8k"): 12.5,
    }
    scores = evaluate(predictions, targets, results)
    assert {(r.experiment, r.benchmark): r.score for r in scores.where("experiment = 'm2'").collect()} == {
        ("m2", "Reasoning"): 50.0, ("m2", "HellaSwag"): 0.0, ("m2", "MMLU"): 0.0, ("m2", "GSM8K"): 12.5,
    }
    assert evaluate(predictions, targets).count() == 3


def test_curves(spark):
    rows = [("r", 1, 0.5, None), ("r", 2, None, 0.25), ("r", 3, 0.4, 0.5), ("r", None, 0.3, 0.1), ("s", 1, None, None)]
    got = metrics.training_curves(spark.createDataFrame(rows, RUN_LOG)).orderBy("series", "step").collect()
    assert [(r.run, r.step, r.series, r.value) for r in got] == [
        ("r", 2, "eval_accuracy", 25.0), ("r", 3, "eval_accuracy", 50.0), ("r", 1, "loss", 0.5), ("r", 3, "loss", 0.4),
    ]


SCORES = [
    ("Baseline", "HellaSwag", 50.125), ("Baseline", "MMLU", 60.0), ("Baseline", "GSM8K", 1.005),
    ("Tuned", "Reasoning", 12.5), ("Tuned", "HellaSwag", 49.0), ("Tuned", "MMLU", 61.25),
]


def lines(report):
    rows = sorted(report.collect(), key=lambda r: r.line_no)
    assert [r.line_no for r in rows] == list(range(len(rows)))
    return [r.line for r in rows]


def test_report_by_experiment(spark):
    scores = spark.createDataFrame(SCORES, "experiment string, benchmark string, score double")
    assert lines(reports.report_by_experiment(scores, "# T", ["Baseline", "Absent", "Tuned"])) == [
        "# T",
        "",
        "| Experiment      | Reasoning Acc (%) | HellaSwag (%)   | MMLU (%)   | GSM8K (%)  |",
        "|-----------------|-------------------|-----------------|------------|------------|",
        "| Baseline        | N/A               | 50.12           | 60.00      | 1.00       |",
        "| Tuned           | 12.50             | 49.00           | 61.25      | 0.00       |",
    ]


def test_report_by_benchmark(spark, tmp_path):
    scores = spark.createDataFrame(SCORES[:-1], "experiment string, benchmark string, score double")
    report = reports.report_by_benchmark(scores, "# T", ["Baseline", "Tuned"])
    want = [
        "# T",
        "",
        "| Benchmark            | Baseline        | Tuned           |",
        "|--------------------|---------------|---------------|",
        "| Reasoning Acc (%)    | N/A             | 12.50           |",
        "| HellaSwag (%)        | 50.12           | 49.00           |",
        "| MMLU (%)             | 60.00           | N/A             |",
        "| GSM8K (%)            | 1.00            | N/A             |",
    ]
    assert lines(report) == want
    writers.write_report(report, str(tmp_path / "report"))
    files = list((tmp_path / "report").glob("part-*"))
    assert len(files) == 1
    assert files[0].read_text(encoding="utf-8") == "\n".join(want) + "\n"


def test_comparison(spark):
    rows = SCORES[:-1] + [("Baseline", "Reasoning", 13.0), ("Tuned", "GSM8K", 2.0)]
    rows = [r for r in rows if r[1] != "MMLU"]
    scores = spark.createDataFrame(rows, "experiment string, benchmark string, score double")
    assert lines(reports.report_comparison(scores, "# T", "Baseline", "Tuned")) == [
        "# T",
        "",
        "| Benchmark            | Baseline        | Tuned           | Change |",
        "|--------------------|---------------|---------------|---------------|",
        "| Reasoning Acc (%)    | 13.00           | 12.50           | -0.50           |",
        "| HellaSwag (%)        | 50.12           | 49.00           | -1.12           |",
        "| MMLU (%)             | N/A             | N/A             | N/A             |",
        "| GSM8K (%)            | 1.00            | 2.00            | +1.00           |",
    ]
    with pytest.raises(ValueError, match="Missing"):
        reports.compare(scores, "Baseline", "Missing")
