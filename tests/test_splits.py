import pytest

from larkspool.sources import lines, readers, writers
from pyspark.sql.types import StructType


def test_a_broken_line_of_a_split_is_an_error(spark, tmp_path):
    folder = str(tmp_path / "splits")
    writers.write_splits(spark.createDataFrame([("a", "train", 0), ("b", "eval", 0)], "text string, split string, pos long"), folder)
    schema = StructType.fromDDL("text string")
    assert {tuple(r) for r in readers.read_splits(spark, folder, schema).collect()} == {("a", "train"), ("b", "eval")}
    (tmp_path / "splits" / "split=train" / "broken.json").write_text('{"text": "c"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_splits(spark, folder, schema).collect()


def _stored(spark, folder, sizes, rows_per_file):
    rows = [(f"{split} {i} ü", split, i) for split, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "text string, split string, pos long").repartition(5)
    writers.write_splits(df, folder, rows_per_file=rows_per_file)
    return sorted(rows)


@pytest.mark.parametrize("block", ["300", "4k", "128m"])
def test_stored_splits_come_back_in_order(spark, tmp_path, block):
    folder = str(tmp_path / "splits")
    rows = _stored(spark, folder, {"train": 700, "eval": 31, "test": 1}, 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        back = readers.read_splits(spark, folder, StructType.fromDDL("text string"), pos=True)
        assert sorted((r.text, r.split, r.pos) for r in back.collect()) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ids_do_not_depend_on_the_layout(spark, tmp_path):
    folder = str(tmp_path / "splits")
    rows = _stored(spark, folder, {"a": 400, "b": 300}, 60)
    schema, found = StructType.fromDDL("text string"), []
    for block in ("500", "3k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            numbered = readers.ingest(readers.read_jsonl(spark, folder, schema)).select("row_id", "text").collect()
            found.append(sorted(tuple(r) for r in numbered))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2]
    assert [i for i, _ in found[0]] == list(range(700))
    in_order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [t for _, t in found[0]] == [r[0] for r in in_order]


def test_a_filter_may_come_before_the_numbers(spark, tmp_path):
    folder = str(tmp_path / "splits")
    _stored(spark, folder, {"a": 50}, 20)
    kept = readers.read_jsonl(spark, folder, StructType.fromDDL("text string")).where("text not like '% 7 %'")
    assert sorted(r.row_id for r in readers.ingest(kept).collect()) == list(range(49))


def test_shuffled_lines_have_no_position(spark, tmp_path):
    folder = str(tmp_path / "splits")
    _stored(spark, folder, {"a": 500}, 100)
    mixed = readers.read_jsonl(spark, folder, StructType.fromDDL("text string")).repartition(7)
    with pytest.raises(ValueError, match="shuffle"):
        readers.ingest(mixed)
    with pytest.raises(ValueError, match="no files"):
        lines.line_positions(spark.range(3), "pos")


def test_rows_from_no_file_are_numbered_by_content(spark):
    rows = [(f"t{i % 40}", None if i % 3 else i % 2) for i in range(90)]
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "text string, n long").repartition(parts)
        found.append(sorted(tuple(r) for r in readers.ingest(df).select("row_id", "text", "n").collect()))
    assert found[0] == found[1] and [r[0] for r in found[0]] == list(range(90))


def test_empty_files(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "one.json").write_text("")
    assert readers.ingest(readers.read_jsonl(spark, str(tmp_path / "e"), StructType.fromDDL("text string"))).count() == 0
