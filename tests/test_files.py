"""Files that the engine reads and writes."""

import json

import pytest

from flocktrace import engine, schemas, sources


def _write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    scans = "# time,a,b,rssi\n" + "".join(f"{t},{a},{b},{r}\n" for t in (0, 300, 600) for a, b, r in ((1, 2, -70), (2, 3, -60), (4, -1, 0), (5, -2, -40)))
    return _write(folder, bt_symmetric=scans, fb_friends="# a,b\n1,2\n2,3\n", genders="# u,f\n1,0\n2,1\n", calls="t,c,d,l\n5,1,2,-1\n9,2,3,40\n", sms="t,s,r\n7,1,3\n")


def test_readers_name_columns_by_their_schemas(spark, raw):
    assert sources.read_scans(spark, f"{raw}/bt_symmetric.csv").schema == schemas.SCANS
    assert sources.read_scans(spark, f"{raw}/bt_symmetric.csv").count() == 12
    assert {tuple(r) for r in sources.read_friends(spark, f"{raw}/fb_friends.csv").collect()} == {(1, 2), (2, 3)}
    assert {tuple(r) for r in sources.read_genders(spark, f"{raw}/genders.csv").collect()} == {(1, 0), (2, 1)}
    assert {tuple(r) for r in sources.read_telecom(spark, f"{raw}/calls.csv", "calls").collect()} == {(5, 1, 2, -1, True), (9, 2, 3, 40, False)}
    assert [tuple(r) for r in sources.read_telecom(spark, f"{raw}/sms.csv", "sms").collect()] == [(7, 1, 3)]
    with pytest.raises(ValueError):
        sources.read_telecom(spark, f"{raw}/sms.csv", "letters")


def test_prepared_scans_keep_the_contract(spark, tmp_path):
    made = spark.createDataFrame([(0, 1, 2, -70, False, False, True, "x")], "timestamp long, user_a long, user_b long, rssi long, is_empty_scan boolean, is_external_device boolean, is_valid_contact boolean, more string")
    path = sources.write_parquet(made, str(tmp_path), "prepared")
    assert sources.read_prepared(spark, path).columns == schemas.PREPARED.fieldNames()
    with pytest.raises(FileNotFoundError):
        sources.read_prepared(spark, f"{tmp_path}/nowhere")
    with pytest.raises(ValueError, match="is_valid_contact"):
        sources.read_prepared(spark, sources.write_parquet(made.drop("is_valid_contact"), str(tmp_path), "short"))


def test_members_go_to_text_and_back(spark, tmp_path):
    (tmp_path / "cohorts.csv").write_text("cohort_id,members,support\n1,10 9 2,7\n")
    read = sources.read_cohorts(spark, f"{tmp_path}/cohorts.csv")
    assert read.first().member_set == [2, 9, 10]
    assert read.select(sources.members_text("member_set").alias("m")).first().m == "2 9 10"


def test_written_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b", True), (2, None, False), (3, 'q"q', False)], "k long, s string, is_anomaly boolean")
    paths = sources.write_split(df, str(tmp_path))
    rows = {n: {r.k for r in spark.read.parquet(p).collect()} for n, p in paths.items()}
    assert rows == {"all": {1, 2, 3}, "normal": {2, 3}, "anomalous": {1}}
    path = sources.write_csv(df.orderBy("k"), f"{tmp_path}/table")
    assert [tuple(r) for r in spark.read.csv(path, header=True, schema=df.schema, escape="\\").collect()] == [tuple(r) for r in df.collect()]
    sources.summary_json({"n": 3}, {"t": df.orderBy("k")}, tmp_path / "s.json", most=2)
    assert [r["k"] for r in json.loads((tmp_path / "s.json").read_text())["tables"]["t"]] == [1, 2]


def test_missing_inputs_are_all_told(raw, tmp_path):
    sources.validate_inputs(raw, f"{raw}/bt_symmetric.csv")
    with pytest.raises(FileNotFoundError, match="genders.*sms"):
        sources.validate_inputs(tmp_path, f"{raw}/bt_symmetric.csv")
    sources.validate_inputs(tmp_path, f"{raw}/bt_symmetric.csv", skip_secondary=True)


def test_command_line_writes_all_tables(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    counts = engine.main(["--raw-dir", raw, "--out", out])
    assert counts == {"contacts": 6, "coverage": 6, "gatherings": 3, "episodes": 1}
    assert spark.read.parquet(f"{out}/episodes").first().participant_set == [1, 2, 3]
    assert {n: spark.read.parquet(f"{out}/{n}").count() for n in ("fb_friends", "genders", "calls", "sms")} == {"fb_friends": 2, "genders": 2, "calls": 2, "sms": 1}


def test_saved_results(spark, tmp_path):
    assert sources.read_baseline(spark, str(tmp_path), str(tmp_path)) == {"model_metadata": None}
    (tmp_path / sources.BASELINE["cohorts"]).write_text("members,support\n1 2,9\n3 4,8\n5 6,7\n")
    (tmp_path / sources.MODEL).write_text('{\n"k": 5\n}')
    (tmp_path / sources.COORDINATES).write_text("episode_id,PC2,PC1,cluster_id\n" + "".join(f"{i},{i}.5,{i},{i % 2}\n" for i in range(9)))
    read = lambda most: sources.read_baseline(spark, str(tmp_path), str(tmp_path), most)
    few, whole = read(2), read(9)
    assert few["cohorts"].columns == ["support"] and [r.support for r in few["cohorts"].collect()] == ["9", "8"]
    assert few["model_metadata"] == {"k": 5} and "validity" not in few
    every = {(float(i), i + 0.5, i % 2) for i in range(9)}
    assert {tuple(r) for r in whole["coordinates"].collect()} == every and not whole["coordinates_sampled"]
    drawn = [tuple(r) for r in few["coordinates"].collect()]
    assert len(drawn) == 2 and set(drawn) <= every and few["coordinates_sampled"]
    assert [tuple(r) for r in read(2)["coordinates"].collect()] == drawn


def test_kept_tables_change_only_when_reloaded(spark, tmp_path):
    path = f"{tmp_path}/shown"
    spark.range(3).write.parquet(path)
    assert sources.kept_table(spark, "shown", path).count() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert sources.kept_table(spark, "shown", path, reload=True).count() == 5
    spark.catalog.uncacheTable("shown")
    spark.catalog.dropTempView("shown")
