"""Readers and writers on temporary files."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from medloom.operators import tables
from medloom.plans.reports import pathology_sections
from medloom.plans.trajectories import build_trajectories
from medloom.sources import readers, sinks


def put(root, folder, name, text):
    (root / folder).mkdir(parents=True, exist_ok=True)
    (root / folder / name).write_text(text)


def test_folders_skip_the_root(spark, tmp_path):
    put(tmp_path, ".", "mrn.txt", "EMPI|MRN\n9|z\n")
    put(tmp_path, "a", "mrn.txt", "EMPI|MRN\n1|x\n")
    put(tmp_path, "b/c", "mrn.txt", "EMPI|MRN\n2|y\n")
    put(tmp_path, "b", "other.txt", "EMPI|MRN\n3|y\n")
    df = readers.read_identifiers(spark, str(tmp_path), "mrn.txt")
    assert sorted((r.EMPI, r.MRN) for r in df.collect()) == [("1", "x"), ("2", "y")]


def test_dates_per_value(spark, tmp_path):
    text = "EMPI|Admit_Date|Discharge_Date\n1|1/2/2020|1/5/2020\n2|soon|1/1/1800\n3|2/3/2021 4:05:06 PM|\n"
    put(tmp_path, "a", "enc.txt", text)
    rows = {r.EMPI: r for r in readers.read_encounters(spark, str(tmp_path), "enc.txt").collect()}
    assert rows["1"].Admit_Date == dt.datetime(2020, 1, 2) and rows["1"].Discharge_Date == dt.datetime(2020, 1, 5)
    assert rows["2"].Admit_Date is None and rows["2"].Discharge_Date is None
    assert rows["3"].Admit_Date == dt.datetime(2021, 2, 3, 16, 5, 6)


def test_demographics_diagnoses_medications(spark, tmp_path):
    put(tmp_path, "a", "dem.txt", "EMPI|Date_of_Birth|Date_Of_Death\n007|3/4/1950|\n")
    put(tmp_path, "a", "dia.txt", "MRN|Diagnosis_Name|Date\n5|Liver transplant|1/2/2003\n")
    put(
        tmp_path, "a", "med.txt",
        "EMPI|EPIC_PMRN|MRN_Type|MRN|Medication_Date|Medication|Code_Type|Code|Quantity|Inpatient_Outpatient|Clinic\n"
        "1|2|MGH|3|1/2/2003|PREDNISONE 5 MG|c|d|1|Out|x\n",
    )
    dem = readers.read_demographics(spark, str(tmp_path), "dem.txt").first()
    assert dem.EMPI == "007" and dem.Date_of_Birth == dt.datetime(1950, 3, 4) and dem.Date_Of_Death is None
    assert readers.read_diagnoses(spark, str(tmp_path), "dia.txt").first().datetime == dt.datetime(2003, 1, 2)
    med = readers.read_medications(spark, str(tmp_path), "med.txt")
    assert med.columns == readers.MEDICATION_COLUMNS and med.first().Medication == "prednisone 5 mg"


def test_labs_with_rejects(spark, tmp_path):
    put(
        tmp_path, "a", "lab.txt",
        "EMPI|MRN_Type|MRN|Group_Id|Test_Description|Result|Result_Text|Seq_Date_Time\n"
        "1|MGH|5|SGPT|x|<5||1/2/2003 10:30\n"
        "1|MGH|5|ALT|x|HEMOLYZED||1/2/2003 10:30\n"
        "1|MGH|5|ANA titer|x|Positive 1:160||1/2/2003\n"
        "1|MGH|5|ALT|x|too|many|1/2/2003|fields\n"
        "1|MGH|5|ALT|x|12||1/3/2003\n",
    )
    put(tmp_path, "s", "syn.csv", "\ufeffALT,ANA\nSGPT,ANA titer\n,ANA screen\n")
    rows, malformed = readers.read_lab_rows(spark, str(tmp_path), "lab.txt")
    assert malformed.count() == 1
    pairs = tables.synonym_pairs(readers.read_synonyms(spark, str(tmp_path / "s" / "syn.csv")))
    good, bad = readers.clean_labs(rows, pairs)
    assert good.columns == readers.LAB_COLUMNS
    got = sorted((r.test_desc, r.result, r.above_below_assay_limit) for r in good.collect())
    assert got == [("ALT", 5.0, -1), ("ALT", 12.0, 0), ("ANA", 160.0, 0)]
    assert [r.result_orig for r in bad.collect()] == ["HEMOLYZED"]


HEADER = "EMPI|EPIC_PMRN|MRN_Type|MRN|Report_Number|Report_Date_Time|Report_Description|Report_Status|Report_Type|Report_Text\n"


def report(number, text, status="Final", site="MGH"):
    return f"1|2|{site}|3|{number}|1/2/2003|Surgical|{status}|PAT|{text}[report_end]\n"


def test_reports_keep_their_lines(spark, tmp_path):
    long = 'Intro | with "pipes"\nFINAL DIAGNOSIS:\nLIVER, NEEDLE BIOPSY:\nmild portal change\nNOTE: see below\n'
    put(tmp_path, "a", "pat.txt", HEADER + report("S1", "short\n") + report("S2", long) + report("S3", "x", "Pending"))
    put(tmp_path, "b", "pat.txt", HEADER + report("S1", "a longer text of the same report\n"))
    df = readers.read_reports(spark, str(tmp_path), "pat.txt", final_only=True)
    rows = {r.report_id: r for r in df.collect()}
    assert set(rows) == {"1_S1", "1_S2"}
    assert rows["1_S1"].Report_Text.startswith("a longer")
    assert rows["1_S2"].Report_Text == long + "[report_end]" and rows["1_S2"].Report_Type == "PAT"
    assert rows["1_S2"].datetime == dt.datetime(2003, 1, 2)
    cut = {r.report_id: r for r in pathology_sections(df).collect()}["1_S2"]
    assert cut.final_diagnosis_line == "FINAL DIAGNOSIS:" and cut.is_liver_biopsy_line == "LIVER, NEEDLE BIOPSY:"
    assert cut.has_finaldx_text and cut.finaldx_text == "mild portal change"


def test_procedures_are_put_together(spark, tmp_path):
    head = "EMPI|A|B|C|Date|E|F|G|H|I\n"
    whole = [f"{i}|a|b|c|1/2/2003|e|f|g|h|i{i}" for i in range(40)]
    lines = []
    for i, line in enumerate(whole):
        lines.append(line if i % 3 else line[:12] + "\n" + line[12:])
    put(tmp_path, "a", "prc.txt", head + "\n".join(lines) + "\n")
    for limit in (10**6, 7):
        df = readers.read_procedures(spark, str(tmp_path), "prc.txt", rows_per_task=limit)
        got = sorted("|".join(r[c] for c in df.columns[:10]) for r in df.collect())
        assert got == sorted(whole)


def test_sinks(spark, tmp_path):
    points = [("p", "ALT", float(t), x) for t, x in enumerate([10.0, 900.0, 500.0, 200.0, 90.0, 50.0])]
    df = spark.createDataFrame(points, "id string, lab string, t double, x double")
    built = build_trajectories(df, "id", "lab", ["ALT"], min_points=2, min_height=100)
    sinks.write_trajectories(built, "lab", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "traj_meta"))
    assert [(r.traj_id, r.x0, r.xf, r.lab) for r in back.collect()] == [("p_1", 900.0, 90.0, "ALT")]
    stats = built.run_meta.select("num_peaks", "num_traj_meeting_criteria")
    sinks.write_fits(built.meta.select("traj_id", "x0"), stats, str(tmp_path / "out"), "ALT")
    fits = spark.read.csv(str(tmp_path / "out" / "ALT_param_fits"), header=True)
    assert fits.count() == 1 and fits.columns == ["traj_id", "x0"]
    sinks.write_with_rejects(df.filter("x > 100"), df.filter(F.col("x") <= 100), str(tmp_path / "lab"))
    assert spark.read.parquet(str(tmp_path / "lab" / "rejected")).count() == 3


def test_broken_lines_cost_no_other_record(spark):
    columns = ["a", "b", "c"]
    values = ["1|x|y", "2|", "only", "3|x|y", "4|x", "|y", "5|x|y", "6|x|y|z", "7|x|y"]
    lines = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(values)], "source_file string, block long, line long, value string")
    for limit in (1000, 3):
        records, rejects = readers.procedure_lines(lines, columns, rows_per_task=limit)
        assert sorted(r.a for r in records.collect()) == ["1", "3", "4", "5", "7"]
        assert sorted(r.value for r in rejects.collect()) == ["2|only", "6|x|y|z"]


def test_lines_of_a_wrong_delimiter_are_rejected_one_by_one(spark):
    """Without delimiters no record ends: such lines aren't collected in one group, but a long record still is."""
    columns = ["a", "b", "c"]
    values = ["1|x|y", *[f"l{i};x;y" for i in range(3000)], "2|x|y", "3|", *["t"] * 3000, "|y", "4|x|y"]
    lines = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(values)], "source_file string, block long, line long, value string")
    records, rejects = readers.procedure_lines(lines, columns)
    assert sorted((r.a, r.b) for r in records.collect()) == [("1", "x"), ("2", "x"), ("3", "t" * 3000), ("4", "x")]
    assert sorted(r.value for r in rejects.collect()) == sorted(values[1:3001])


def test_columns_are_aligned_by_name(spark, tmp_path):
    put(tmp_path, "a", "mrn.txt", "EMPI|MRN\n1|x\n")
    put(tmp_path, "b", "mrn.txt", "MRN|EMPI|Site\ny|2|MGH\n")
    put(tmp_path, "c", "mrn.txt", "﻿EMPI\r\n3\r\n")
    put(tmp_path, "d", "mrn.txt", "")
    df = readers.read_identifiers(spark, str(tmp_path), "mrn.txt")
    assert df.columns == ["EMPI", "MRN", "Site"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "x", None), ("2", "y", "MGH"), ("3", None, None)]
    chosen = readers.read_folders(spark, str(tmp_path), "mrn.txt", columns=["Site", "None", "EMPI"], keep_path=True)
    assert chosen.columns == ["Site", "None", "EMPI", "source_file"] and chosen.count() == 3


def test_folders_without_the_file_are_told(spark, tmp_path):
    put(tmp_path, "a", "lab.txt", "EMPI\n1\n")
    put(tmp_path, "b/c", "other.txt", "EMPI\n2\n")
    put(tmp_path, ".", "root.txt", "EMPI\n2\n")
    missing = [r.folder for r in readers.missing_folders(spark, str(tmp_path), "lab.txt").collect()]
    assert [m.rsplit("/", 2)[-2:] for m in missing] == [["b", "c"]]
    assert readers.read_folders(spark, str(tmp_path), "lab.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_folders(spark, str(tmp_path), "lab.txt", strict=True)
    with pytest.raises(FileNotFoundError):
        readers.read_folders(spark, str(tmp_path), "none.txt")


def test_a_delimiter_in_quotes_is_no_field(spark):
    values = ["a|b|c", '1|"x|y"|z', '2|"x""|y"|z', "3|x|y|z", "4", '5|x"|y|z', "", '6|"x|y|z', '7|""|z']
    lines = spark.createDataFrame([("f", v) for v in values], "source_file string, value string")
    rows, malformed = readers.lab_lines(lines, ["a", "b", "c"])
    assert sorted((r.a, r.b, r.c) for r in rows.filter("a <> '6'").collect()) == [
        ("1", "x|y", "z"), ("2", 'x"|y', "z"), ("4", None, None), ("7", None, "z")]
    assert {r.line for r in malformed.collect()} == {"3|x|y|z", '5|x"|y|z', '6|"x|y|z'}


def test_reports_of_lines(spark):
    text = "\n".join(HEADER.rstrip().split("\n")) + "\n" + report("S1", "one\n\n two|x\n") + report("S2", "") + "1|2|MGH|3|S3|1/2/2003|a|Final|PAT|tail"
    lines = [("f", 0, i, v) for i, v in enumerate(text.split("\n"))]
    lines += [("g", 0, 0, "1|2|MGH|3|S4|1/2/2003|a|Final|PAT|x[report_end]1|2|MGH|3|S5|1/2/2003|a|Final|PAT|y[report_end]")]
    df = spark.createDataFrame(lines, "source_file string, block long, line long, value string").repartition(3)
    for limit in (1000, 2):
        records = readers.records_of_lines(df, rows_per_task=limit)
        rows = readers.report_records(records, HEADER.rstrip().split("|"))
        got = {r.Report_Number: r.Report_Text for r in rows.collect()}
        assert got == {"S1": "one\n\n two|x\n[report_end]", "S2": "[report_end]", "S3": "tail[report_end]", "S4": "x[report_end]", "S5": "y[report_end]"}


def built_of(spark, rows, labs):
    df = spark.createDataFrame(rows, "id string, lab string, t double, x double")
    return build_trajectories(df, "id", "lab", labs, min_points=2, min_height=100)


FALL = [10.0, 900.0, 500.0, 200.0, 90.0, 50.0]


def test_a_rerun_replaces_its_labs_only(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("p", lab, float(t), x) for lab in ("ALT", "AST") for t, x in enumerate(FALL)]
    sinks.replace_trajectories(built_of(spark, rows, ["ALT", "AST"]), "lab", out)
    first = sinks.read_trajectories(spark, "lab", out)
    assert sorted((r.lab, r.x0) for r in first.meta.collect()) == [("ALT", 900.0), ("AST", 900.0)]
    again = [(i, lab, t, 2 * x) for i, lab, t, x in rows if lab == "AST"]
    for _ in range(2):
        sinks.replace_trajectories(built_of(spark, again, ["AST"]), "lab", out)
    back = sinks.read_trajectories(spark, "lab", out)
    assert sorted((r.lab, r.x0) for r in back.meta.collect()) == [("ALT", 900.0), ("AST", 1800.0)]
    assert back.points.groupBy("lab").agg(F.max("x").alias("x")).orderBy("lab").collect() == [("ALT", 900.0), ("AST", 1800.0)]
    # A lab whose rerun has no trajectories has none afterwards.
    sinks.replace_trajectories(built_of(spark, [("p", "AST", 0.0, 1.0)], ["AST"]), "lab", out)
    assert [r.lab for r in sinks.read_trajectories(spark, "lab", out).meta.collect()] == ["ALT"]


def test_a_failed_run_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("p", "ALT", float(t), x) for t, x in enumerate(FALL)]
    built = built_of(spark, rows, ["ALT"])
    sinks.replace_trajectories(built, "lab", out)
    fails = F.udf(lambda x: 1 // 0, "double")
    bad = built._replace(points=built.points.withColumn("x", F.col("x") * 3), meta=built.meta.withColumn("x0", fails("x0")))
    with pytest.raises(Exception, match="ZeroDivision"):
        sinks.replace_trajectories(bad, "lab", out)
    back = sinks.read_trajectories(spark, "lab", out)
    assert [r.x0 for r in back.meta.collect()] == [900.0] and back.points.agg(F.max("x")).first()[0] == 900.0
