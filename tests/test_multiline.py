import random

import pytest

from strata.sources import files, multiline


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of a few kilobytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def one_task(spark, path, schema):
    reader = spark.read.options(header=True, escape='"', multiLine=True)
    return reader.schema(schema).csv(str(path))


def written(rng, rows, end):
    """Fields with line ends, doubled quotes, separators, empty ones and long ones that go over several splits."""

    def field():
        kind = rng.randrange(9)
        if kind < 4:
            return str(rng.randrange(10**6))
        if kind == 4:
            return ""
        body = "".join(rng.choices(["a", "é", " ", ",", '""', "\n", "\r\n", ";", "\n\n", "日"], k=rng.randrange(40) if kind < 8 else rng.randrange(2500)))
        return f'"{body}"'

    lines = ["id,x,y"] + [f"{i},{field()},{field()}" for i in range(rows)]
    lines[20:20] = ["", ""]
    return end.join(lines)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(4))
def test_equals_the_reader_of_one_task(spark, small_splits, tmp_path, seed, end):
    rng = random.Random(seed)
    path = tmp_path / "in.csv"
    path.write_bytes((written(rng, 300, end) + (end if seed % 2 else "")).encode())
    schema = "id bigint, x string, y string"
    assert files.has_line_ends_in_fields(spark, str(path))
    lines = multiline.split_lines(spark, str(path))
    assert lines.rdd.getNumPartitions() > 4 and lines.select("split").distinct().count() > 4
    found = multiline.read_records(spark, str(path), ",")
    assert found is not None and found[1] == "id,x,y"
    got = [tuple(r) for r in files.read_delimited(spark, str(path), schema).collect()]
    want = [tuple(r) for r in one_task(spark, path, schema).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 300


def test_several_files_and_types(spark, small_splits, tmp_path):
    """Each file has its header; names come from it, types from all rows."""
    for k in range(3):
        rows = "".join(f'{k * 1000 + i},"a\n{i}",{i / 4}\n' for i in range(400))
        (tmp_path / f"f{k}.csv").write_text("id,x,x\n" + rows)
    df = files.read_delimited(spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double"] and df.columns[0] == "id"
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(k * 1000 + i, f"a\n{i}", i / 4) for k in range(3) for i in range(400)]


@pytest.mark.parametrize("body", ['1,5" pipe\n2,"a\nb"\n', '1,"a\nb"c\n2,x\n', '1,"a\nb\n2,x\n', '1,a\rb\n2,"a\nb"\n'])
def test_stray_quotes_are_left_to_the_reader_of_one_task(spark, tmp_path, body):
    path = tmp_path / "in.csv"
    path.write_text("id,x\n" + body)
    assert multiline.read_records(spark, str(path), ",") is None
    got = files.read_delimited(spark, str(path), "id bigint, x string").collect()
    assert got == one_task(spark, path, "id bigint, x string").collect()


def test_a_record_longer_than_many_splits(spark, small_splits, tmp_path):
    text = "\n".join(f"line {i}" for i in range(3000))
    path = tmp_path / "in.csv"
    path.write_text(f'id,x\n1,"{text}"\n2,"b\nc"\n')
    assert sorted(tuple(r) for r in files.read_delimited(spark, str(path)).collect()) == [(1, text), (2, "b\nc")]


def test_only_records_of_several_lines_are_shuffled(spark, small_splits, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,x\n" + "".join(f"{i},y\n" for i in range(3000)) + '9999,"a\nb"\n')
    from strata.session import cut

    lines = cut(multiline.split_lines(spark, str(path)), "lines")
    found = multiline.records(lines)
    assert found.count() == 3002
    grouped = [r for r in found.collect() if "\n" in r.text]
    assert len(grouped) == 1 and grouped[0].text == '9999,"a\nb"'
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(file") == plan.count("hashpartitioning(file#") and "from_line" in plan


def test_the_csv_query_does_not_pass_all_documents_through_one_task(spark, tmp_path, monkeypatch):
    from workloads import files as query

    rows = [(i, f'line\n"{i}", end', "en", "src", i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    written, take = [], files.import_file
    monkeypatch.setattr(query.files, "import_file", lambda wb, path, **kw: written.append(spark.read.format("binaryFile").load(f"{path}/*.csv").count()) or take(wb, path, **kw))
    monkeypatch.setattr(query, "read", lambda spark, sf, t: spark.read.parquet(f"{sf}/{t}.parquet").repartition(6))
    got = query.import_csv_multiline(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == rows
    assert written[0] == 6
