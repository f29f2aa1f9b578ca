"""Files of many kinds, read back into tables."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from tablecheck import quality_report
from tablecheck.operators.freshness import freshness
from tablecheck.operators.ranks import whole_order_statistics
from tablecheck.operators.sampling import head_mid_tail_sample
from tablecheck.sources import delimited, jsonlines, lines, loader, logs, records, tables


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def parse_report(loaded):
    return loaded.parse_report.first().asDict()


@pytest.mark.parametrize("separator", [",", "\t", "|", ";"])
def test_delimiters_and_header(spark, written, separator):
    text = "\n".join(separator.join(r) for r in (("id", "name"), ("1", "a"), ("2", "b"), ("3", "c")))
    loaded = loader.load(spark, written("x.csv", text))
    assert rows(loaded.data) == [(1, "a"), (2, "b"), (3, "c")]
    report = parse_report(loaded)
    assert (report["delimiter"], report["headers_detected"], report["rows_loaded"]) == (separator, True, 3)


def test_no_header(spark, written):
    loaded = loader.load(spark, written("x.csv", "1,2\n3,4\n5,6\n7,8\n9,9\n"))
    assert loaded.data.columns == ["col_1", "col_2"]
    assert "No headers detected" in loaded.warnings[0]


def test_missing_tokens_types_and_bad_rows(spark, written):
    text = (
        "id,x,flag,day,none\n1,1.5,True,2024-01-01,\n2,NA,false,2024-01-02,null\n"
        "3,2,TRUE,n/a,NaN\n4,7\n5,1,True,d,,extra\n6,1,True,d,,\n7,1,True,d,,,,\n"
        '8,"1",True,"a,b",\n9,1d,x,y,1,2,3\n'
    )
    good, rejects = delimited.read_delimited(spark, written("x.csv", text))
    typed = delimited.typed(good)
    assert [f.dataType.simpleString() for f in typed.schema] == [
        "bigint", "double", "boolean", "string", "double"
    ]
    assert rows(typed) == [
        (1, 1.5, True, "2024-01-01", None), (2, None, False, "2024-01-02", None),
        (3, 2.0, True, None, None), (4, 7.0, None, None, None), (8, 1.0, True, "a,b", None),
    ]
    assert rejects.count() == 4


def test_encodings(spark, written):
    text = "id,city\n1,Zürich\n2,Genève\n3,Bern\n4,Köln\n5,x\n"
    for name, codec, expected in (
        ("u.csv", "utf-8", "UTF-8"), ("l.csv", "latin-1", "ISO-8859-1"),
    ):
        loaded = loader.load(spark, written(name, text.encode(codec)))
        assert parse_report(loaded)["encoding"] == expected
        assert rows(loaded.data)[0] == (1, "Zürich")
    smart = loader.load(spark, written("w.csv", text.replace("x", "“x”").encode("cp1252")))
    assert parse_report(smart)["encoding"] == "windows-1252"
    assert rows(smart.data)[-1] == (5, "“x”")
    mixed = "id,city\n".encode() + "1,Zürich\n".encode() * 3 + "2,Zürich\n".encode("latin-1")
    found = loader.load(spark, written("m.csv", mixed))
    assert any("confidence is low" in w for w in found.warnings)


def test_damaged_cells(spark, written):
    loaded = loader.load(spark, written("x.csv", "id,t\n1,a�b\n2,ok\n3,z\n4,z\n5,z\n"))
    assert rows(loaded.data)[:2] == [(1, None), (2, "ok")]
    assert parse_report(loaded)["encoding_error_cells"] == 1


def test_fallback_ranking(spark, written):
    path = written("x.csv", "id;city\n1;Zürich\n2;Bern\n".encode("latin-1"))
    best = delimited.rank_fallbacks(spark, path).first()
    assert (best.separator, best.columns) == (";", 2)


def test_fallback_reading_is_loaded(spark, written):
    head = "".join(f"title {i}\n" for i in range(10))  # no separator where the kind is told
    path = written("x.csv", (head + "1;Zürich “a”\n" * 30).encode("cp1252"))
    loaded = loader.load(spark, path)
    assert any("Could not detect delimiter" in w for w in loaded.warnings)
    assert not parse_report(loaded)["fallback_used"]  # no reading has two columns in the first line
    wide = written("y.csv", "a;b\nname only\n" + "1,2,3;x\n" * 12 + "1;Zürich\n")
    loaded = loader.load(spark, wide)
    report = parse_report(loaded)
    assert (report["fallback_used"], report["delimiter"], report["parse_confidence"]) == (True, ";", "medium")
    assert loaded.data.columns == ["a", "b"] and loaded.data.count() == 14


def test_repeated_and_empty_names(spark, written):
    good, _ = delimited.read_delimited(spark, written("x.csv", "a,a,b,,A\n1,2,3,4,5\n\n6,7,8,9,0\n"))
    assert good.columns == ["a", "a.1", "b", "Unnamed: 3", "A.2"]
    assert rows(good) == [("1", "2", "3", "4", "5"), ("6", "7", "8", "9", "0")]


def test_line_breaks_in_quotes(spark, written):
    text = "id,note,n\n" + "".join(f'{i},"line ""one""\n\nline, two",{i}\n' for i in range(10))
    loaded = loader.load(spark, written("x.csv", text))
    assert sorted(rows(loaded.data)) == [(i, 'line "one"\n\nline, two', i) for i in range(10)]
    assert loaded.rejects.count() == 0


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("8000", "1")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, old):
        spark.conf.set(name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_records_over_many_splits(spark, tmp_path, small_splits, seed):
    rng, wanted = random.Random(seed), []
    for f in range(3):
        with open(tmp_path / f"part [{f}].csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["id", "t", "u"] if f else ["id", "u", "z"])
            for i in range(400):
                pieces = ["a", "b", '"', ",", "\n", "x y", " ", "long text here" * rng.choice([1, 1, 1, 90])]
                row = [f"{f}-{i}", *("k" + "".join(rng.choices(pieces, k=rng.randrange(9))) for _ in "ab")]
                writer.writerow(row)
                wanted.append(tuple([*row, None] if f else [row[0], None, *row[1:]]))
    good, rejects = delimited.read_delimited(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 12
    assert sorted(rows(good.select("id", "t", "u", "z")), key=str) == sorted(wanted, key=str)
    assert rejects.count() == 0


def test_stray_quote_does_not_swallow_the_file(spark, tmp_path, small_splits):
    lines_ = [f'{i},"{i} inch' if i == 700 else f"{i},plain text" for i in range(1500)]
    (tmp_path / "a.csv").write_text("id,t\n" + "\n".join(lines_))
    (tmp_path / "b.csv").write_text('id,t\n1,"two\nlines"\n')
    good, _ = delimited.read_delimited(spark, str(tmp_path))
    assert good.count() == 1501
    assert rows(good.where("t like 'two%'")) == [("1", "two\nlines")]


def test_heads_of_files_without_ordering_all_lines(spark, tmp_path, small_splits):
    for name, count in (("a", 3000), ("b", 7), ("c", 1), ("d", 900)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name}{i}" for i in range(count)))
    heads = lines.file_heads(lines.read_lines(spark, str(tmp_path)), 20)
    assert sorted(r.value for r in heads.collect()) == sorted(
        f"{n}{i}" for n, count in (("a", 20), ("b", 7), ("c", 1), ("d", 20)) for i in range(count)
    )
    assert "Sort" not in heads._jdf.queryExecution().toString()


def test_survey_is_one_plan_for_any_width(spark, written):
    text = ",".join(f"n{k}" for k in range(200)) + "\n" + "\n".join(
        ",".join(str(i if k % 2 else f"{i}.5") for k in range(200)) for i in range(30)
    )
    (reading,) = delimited.readings(spark, written("wide.csv", text + "\n" + "1," * 205))
    survey = reading.survey()
    assert (survey.rows, survey.rejects) == (30, 1)
    assert set(survey.types().values()) == {"bigint", "double"}
    assert survey.types()["n1"] == "bigint" and survey.cells["n199"] == 30


def test_states_of_quotes():
    def plain(line, inside):
        state = "quoted" if inside else "start"
        for x in line:
            if state == "quoted":
                state = "after" if x == '"' else "quoted"
            elif x == '"' and state in ("start", "after"):
                state = "quoted"
            else:
                state = "start" if x == "," else "cell"
        return state == "quoted"

    quotes, rng = records.Quotes(","), random.Random(3)
    for _ in range(20_000):
        line = "".join(rng.choices('a,""', k=rng.randrange(12)))
        for inside in (False, True):
            assert quotes.after(line, inside) == plain(line, inside), (line, inside)


def test_every_file_in_its_own_dialect(spark, written, tmp_path):
    written("a.csv", "id,name\n" + "".join(f"{i},x{i}\n" for i in range(10)))
    written("b.csv", "id;name\n" + "".join(f"{i};y{i}\n" for i in range(10, 20)))
    written("c.csv", ("name|id\n" + "".join(f"Zürich|{i}\n" for i in range(20, 30))).encode("latin-1"))
    written("d.json", '[{"id": 30, "name": "j"},\n {"id": 31, "size": 0.5}]')
    loaded = loader.load(spark, str(tmp_path))
    names = {r.id: r.name for r in loaded.data.collect()}
    assert names == {
        **{i: f"x{i}" for i in range(10)}, **{i: f"y{i}" for i in range(10, 20)},
        **{i: "Zürich" for i in range(20, 30)}, 30: "j", 31: None,
    }
    assert loaded.data.columns == ["id", "name", "size"]
    report = parse_report(loaded)
    assert (report["file_type"], report["encoding"], report["delimiter"]) == ("mixed", None, None)
    seen = {(d["file_type"], d["encoding"], d["delimiter"], d["files"]) for d in report["dialects"]}
    assert seen == {
        ("tabular", "ascii", ",", 1), ("tabular", "ascii", ";", 1),
        ("tabular", "ISO-8859-1", "|", 1), ("json_log", "ascii", None, 1),
    }


def test_json_shapes_of_one_folder(spark, written, tmp_path):
    for k in range(7):
        written(f"l{k}.json", f'[{{"a": {2 * k}}}]\n[{{"a": {2 * k + 1}}}]\n')
    written("p.json", '[\n  {"a": 14},\n  {"a": 15}\n]')
    assert sorted(rows(loader.load(spark, str(tmp_path)).data)) == [(i,) for i in range(16)]


def test_minified_lines_and_pretty_json(spark, written, tmp_path):
    written("m.json", '[{"a": 1}, {"a": 2}]')
    written("l.json", '{"a": 3}\n{"a": 4, "b": [1, {"c": null}]}\nnope\n{"a": 8}, {"a": 9}\n')
    written("p.json", '{\n  "a": 5\n}')
    written("q.json", '[\n{"a": 6}\n]')
    written("x.json", '{\n  "a": 7,\n')
    loaded = loader.load(spark, str(tmp_path))
    assert sorted(r.a for r in loaded.data.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.value.strip()[:4] for r in loaded.rejects.collect()) == ["nope", "{\n  ", '{"a"']
    assert loader.JSON_ARRAY in loaded.warnings and loader.JSON_OBJECT in loaded.warnings


def test_places_of_damaged_rows(spark, written):
    bad = {3, 4, 9, 17, 18, 25, 30}
    text = "id,t\n" + "".join(f"{i},{'a�' if i in bad else 'ok'}\n" for i in range(40))
    report = parse_report(loader.load(spark, written("x.csv", text)))
    assert report["encoding_error_cells"] == 7
    assert [r["row"] for r in report["corrupted_rows"]] == [3, 4, 9, 17, 18]


def test_json_shapes(spark, written):
    array = loader.load(spark, written("a.json", '[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]'))
    assert rows(array.data) == [(1, "x"), (2, "y")]
    one_line = loader.load(spark, written("m.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]'))
    assert rows(one_line.data) == [(1, "x"), (2, "y")]
    by_line = "\n".join(f'[{{"a": {i}}}]' for i in range(7))
    assert sorted(rows(loader.load(spark, written("n.json", by_line)).data)) == [(i,) for i in range(7)]
    single = loader.load(spark, written("o.json", '{"a": 1,\n "b": "x"}'))
    assert rows(single.data) == [(1, "x")]
    many = loader.load(spark, written("l.json", '{"a": 1}\n{bad\n\n{"a": 2, "b": 0.5}\n'))
    assert rows(many.data) == [(1, None), (2, 0.5)]
    assert "1 JSON lines could not be parsed and were skipped." in many.warnings
    with pytest.raises(ValueError):
        text = spark.createDataFrame([("nope",)], "value string")
        jsonlines.parse_json_lines(text)


def test_file_that_starts_with_junk_is_delimited(spark, written):
    text = "# note\n" * 20 + "id,name\n1,a\n2,b\n"
    found = lines.detect(lines.read_lines(spark, written("c.csv", text))).collect()
    assert [r.file_type for r in found] == ["tabular"]


def test_log_files(spark, written):
    apache = "".join(
        f'10.0.0.{i} - - [05/Jan/2026:03:41:{i:02d} +0000] "GET /x HTTP/1.1" 200 {"-" if i else 5}\n'
        for i in range(8)
    )
    as_of = F.lit("2026-01-06 03:41:08").cast("timestamp")
    loaded = loader.load(spark, written("a.log", "# head\n" + apache + "junk\n"), as_of)
    report = parse_report(loaded)
    assert (report["log_format"], report["parse_confidence"], report["rejected_rows"]) == (
        "apache_combined", "89%", 1
    )
    assert report["freshness"]["age_days"] == 1 and report["freshness"]["status"] == "FRESH"
    got = rows(loaded.data.select("ip", "status", "size"))
    assert got[:2] == [("10.0.0.0", 200, 5.0), ("10.0.0.1", 200, None)] and got[-1] == (None, None, None)
    score = quality_report(loaded.data).score.first()
    assert score.total_weight > 0
    custom = loader.load(spark, written("c.log", "ERROR 10.0.0.1 2026-01-01T00:00:00 a\n" * 6))
    assert parse_report(custom)["fallback_used"] and custom.data.columns[-1] == "field_4"


def test_separator_inside_log_line(spark):
    line = 'h\u001fx - - [t] "GET /\u001f HTTP/1.1" 200 1'
    frame = spark.createDataFrame([(line,)], "value string")
    row = logs.parse_log(frame, "apache_combined").first()
    assert (row.ip, row.endpoint, row.referrer) == ("h\u001fx", "/\u001f", None)


def test_input_checks(spark, written):
    with pytest.raises(FileNotFoundError):
        loader.load(spark, "/tmp/no-such-file-anywhere.csv")
    with pytest.raises(ValueError, match="empty"):
        loader.load(spark, written("e.csv", ""))
    with pytest.raises(ValueError, match="Unsupported file extension '.xyz'"):
        loader.load(spark, written("e.xyz", "a"))
    small = loader.load(spark, written("s.csv", "name\nx\ny\n"))
    assert len([w for w in small.warnings if w.startswith("Only")]) == 2
    assert parse_report(small)["parse_confidence"] == "low"
    with pytest.raises(ValueError):
        loader.sanity_warnings(0, 0)


def test_detection_over_a_folder(spark, written, tmp_path):
    written("a.csv", "id,n\n1,2\n3,4\n")
    written("b.txt", "1|2|3\n4|5|6\n")
    written("c.txt", '{"a": 1}\n{"a": 2}\n')
    found = {
        r.file.rsplit("/", 1)[1]: (r.file_type, r.delimiter, r.has_header)
        for r in lines.detect(lines.read_lines(spark, str(tmp_path))).collect()
    }
    assert found["a.csv"] == ("tabular", ",", True)
    assert found["b.txt"] == ("tabular", "|", False)
    assert found["c.txt"][0] == "json_log"


@pytest.mark.parametrize("days, status", [(7, "FRESH"), (8, "STALE"), (30, "STALE"), (31, "VERY_STALE"), (-3, "FRESH")])
def test_freshness(spark, days, status):
    frame = spark.sql("SELECT 5 AS time_spent, 'x' AS created_by, timestamp'2024-01-31 12:00:00' AS updated_at")
    as_of = F.expr(f"timestamp'2024-01-31 12:00:00' + make_interval(0, 0, 0, {days}, 1)")
    row = freshness(frame, as_of).first()
    assert (row["column"], row["age_days"], row["status"]) == ("updated_at", days, status)


def test_no_readable_time(spark):
    assert freshness(spark.createDataFrame([("x",)], "created string")).count() == 0


def test_slices_need_a_unique_key(spark):
    with pytest.raises(ValueError, match="not unique"):
        head_mid_tail_sample(spark.createDataFrame([(1,)] * 50, "k int"), "k", 0.1, 1)


def test_slices_by_keys_that_no_double_tells_apart(spark):
    low = 2**62
    frame = spark.range(3000).selectExpr(f"{low} + id AS k", "id").repartition(7)
    found = head_mid_tail_sample(frame, "k", 0.01, 10)
    assert sorted(r.id for r in found.collect()) == [*range(30), *range(1485, 1515), *range(2970, 3000)]
    ends = spark.createDataFrame([(x,) for x in (-(2**63), -(2**63) + 1, -5, 0, 7, 2**63 - 2, 2**63 - 1)], "x long")
    assert whole_order_statistics(ends, 7, set(range(7))) == dict(
        enumerate((-(2**63), -(2**63) + 1, -5, 0, 7, 2**63 - 2, 2**63 - 1))
    )


def test_tables(spark):
    frame = spark.range(7).withColumn("t", F.lit("x"))
    frame.createOrReplaceTempView("seven")
    assert tables.load_table(spark, "seven").count() == 7
    assert tables.load_query(spark, "SELECT count(*) AS n FROM {s}", s=frame).first().n == 7
    assert "seven" in [r.name for r in tables.list_tables(spark).collect()]
    info = tables.table_info(frame, "seven").first()
    assert (info.row_count, len(info.sample), [c.name for c in info.columns]) == (7, 5, ["id", "t"])


def test_many_spread_documents_are_read_by_many_tasks(spark, tmp_path):
    for n in range(200):
        (tmp_path / f"{n}.txt").write_text(f'[\n{{"n": {n}}},\n{{"n": -{n},\n"b": 0.5}}\n]\n')
    (tmp_path / "broken.txt").write_text('[\n{"n": 7,\n')
    (tmp_path / "lines.txt").write_text('{"n": 1000}\n[{"c": "x"}]\nnothing\n')
    spark.sparkContext.setJobGroup("spread", "")
    try:
        read, rejects, _ = jsonlines.read_json_files(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("spread")]
    stages = [tracker.getStageInfo(i) for j in jobs for i in j.stageIds]
    readers = [x.numTasks for x in stages if x is not None and x.name.startswith("json at ")]
    assert readers and min(readers) > 1  # the schema was found by one task
    assert read.columns == ["b", "c", "n"]
    found = {(r.b, r.c, r.n) for r in read.collect()}
    wanted = {(None, None, n) for n in range(200)} | {(0.5, None, -n) for n in range(200)}
    assert found == wanted | {(None, None, 1000), (None, "x", None)}
    assert sorted(r.value for r in rejects.collect()) == ['[\n{"n": 7,\n', "nothing"]
