from datetime import date

import pytest
from pyspark.sql import functions as F

from quillon.fixed import V13
from quillon.operators import reports
from quillon.operators.cells import dictionary
from quillon.operators.decide import NO_EVIDENCE, NO_VALUES, OLD_RESULT, RESULT
from quillon.operators.providers import ner_provider, zero_shot_provider
from quillon.operators.scoring import Policy
from quillon.plans.profile import profile_table, profile_tables
from quillon.sources.tables import policy_overlay, read_csv

AS_OF = date(2025, 1, 1)


@pytest.fixture(scope="module")
def people(spark):
    n = 30
    card = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009"]
    rows = [(f"Person {i}", f"user{i}@host{i % 7}.org", f"98765{i:05d}", card[i % 3], f"19{60 + i}-0{1 + i % 9}-11", f"EMP-{1000 + i}", f"{i}", f"1.2.3.{i}", "N/A", f"ORD{i}") for i in range(n)]
    return spark.createDataFrame(rows, "full_name string, emial string, ph_no string, card_number string, dob string, employee_id string, row_number string, app_version string, nothing string, sku string")


@pytest.fixture(scope="module")
def found(people):
    tables = profile_tables(people, as_of=AS_OF)
    return {r.Column_Name: r for r in tables.results.select(*RESULT).collect()}


def test_decisions(found, people):
    assert list(found) and set(found) == set(people.columns)
    action = {c: r.Policy_Action for c, r in found.items()}
    assert action["emial"] == action["card_number"] == action["dob"] == action["employee_id"] == "PROTECT"
    assert action["row_number"] == action["sku"] == action["nothing"] == action["full_name"] == "NONE"
    assert found["emial"].Final_Entity_Type == "Email Address" and found["dob"].Primary_Entity == "Date of Birth"
    assert found["nothing"].Decision_Reason == NO_VALUES and found["sku"].Decision_Reason == NO_EVIDENCE
    assert action["app_version"] == "NONE" and "contradicted by version" in found["app_version"].Decision_Reason


def test_scores_by_hand(found):
    # weights of its family: patterns .30, union .08, name .18 * .48, validator .12; all rows: .04; strict format with a weak name: -.04
    assert found["emial"].Evidence_Score == pytest.approx(0.30 + 0.08 + 0.18 * 0.48 + 0.12 + 0.04 - 0.04, abs=1e-4)
    # identifier: patterns .24, union .10, name .38, rows .04
    assert found["employee_id"].Evidence_Score == pytest.approx(0.24 + 0.10 + 0.38 + 0.04, abs=1e-4)
    assert found["emial"].Confidence_Score == found["emial"].Evidence_Score


def test_invariance(people, found):
    again = profile_tables(people.unionByName(people).repartition(7), as_of=AS_OF).results.select(*RESULT).collect()
    timeless = lambda r: {k: v for k, v in r.asDict().items() if not k.startswith("Time_")}
    assert {r.Column_Name: timeless(r) for r in again} == {c: timeless(r) for c, r in found.items()}


def test_margins_and_times(found):
    assert found["emial"].Runner_Up_Entity is None and found["emial"].Runner_Up_Margin == 1.0
    assert all(r.Time_Presidio_sec is None and r.Time_GLiNER_sec is None for r in found.values())
    rows = list(found.values())
    total = sum(r.Time_Total_sec for r in rows)
    assert total > 0 and found["nothing"].Time_Total_sec == 0.0
    assert total == pytest.approx(sum(r.Time_Regex_sec + r.Time_Aggregation_sec for r in rows), abs=0.02)


def test_policy(people):
    out = profile_table(people, ["employee_id"], policy=policy_overlay('{"identifier_policy": {"Employee Identifier": false}}'), as_of=AS_OF).first()
    assert out.Policy_Action == "DETECTED_EXCLUDED" and "excluded by configured privacy policy" in out.Decision_Reason
    for bad in ('{"identifier_policy": {"X": true}}', '{"treat_organization_as_pii": 1}'):
        with pytest.raises(ValueError):
            policy_overlay(bad)
    assert policy_overlay('{"treat_organization_as_pii": true}') == Policy(organizations=True)


def test_models(people):
    ner = ner_provider("names", lambda: lambda text: [("PERSON", 0.85, 0, len(text))] if text.startswith("Person") else [])

    def model():
        def predict(text, labels, threshold):
            at = text.find("Person")
            return [{"label": "person name", "text": text[at:], "start": at, "end": len(text), "score": 0.9}] if at >= 0 else []

        return predict

    out = profile_table(people, ["full_name", "emial"], ner=ner, zero_shot=zero_shot_provider("zs", model), as_of=AS_OF)
    row = {r.Column_Name: r for r in out.collect()}["full_name"]
    assert row.Final_Entity_Type == "Person Name" and row.GLiNER_Value_Confirmation == 1.0 and row.Presidio_Support == 1.0
    # .46 + .24 + .18 * (.9 + .07) + .06 + .06, .04 for rows
    assert row.Evidence_Score == pytest.approx(min(1.0, 0.46 + 0.24 + 0.18 * 0.97 + 0.06 + 0.06 + 0.04), abs=1e-3)


def test_labels_of_a_model(people, spark):
    found = [("PER", 0.8, 0, 3), ("DATE", 0.9, 0, 3), ("GPE", 0.5, 0, 3), ("X_Y", 0.5, 0, 3)]
    out = ner_provider("labels", lambda: lambda text: found, weak=("GPE",))(spark.createDataFrame([("c", "abc")], "column_name string, value string")).collect()
    assert sorted((r.entity, round(r.score, 3)) for r in out) == [("Location", 0.2), ("Person Name", 0.8), ("X Y", 0.5)]


def test_command_line(spark, tmp_path, capsys):
    from quillon import cli

    path = tmp_path / "in.csv"
    path.write_text("email;n\n" + "".join(f"user{i}@host.org;{i}\n" for i in range(25)), encoding="utf-8")
    paths = cli.main(["--input", str(path), "--delimiter", ";", "--output-dir", str(tmp_path / "out"), "--mask-password", "pw", "--single-line"])
    assert set(paths) == {"detailed_report", "summary_report", "timing_report", "masked_data"} and "PII DETECTED: 1 columns" in capsys.readouterr().out
    detailed = {r.Column_Name: r for r in spark.read.csv(paths["detailed_report"], header=True, multiLine=True, escape='"').collect()}
    assert detailed["email"].Primary_Entity == "Email Address" and detailed["n"].Policy_Action == "NONE" and detailed["n"].Validator_Pass_Rate == "N/A"
    old = cli.main(["--input", str(path), "--delimiter", ";", "--output-dir", str(tmp_path / "old"), "--profile", "v13", "--columns", "email", "--max-samples", "5"])
    assert spark.read.csv(old["report"], header=True).columns == list(OLD_RESULT)


def test_failing_model_counts_as_nothing(people):
    def fail(text):
        raise RuntimeError

    assert profile_table(people, ["full_name"], ner=ner_provider("bad", lambda: fail), as_of=AS_OF).first().Policy_Action == "NONE"


def test_old_profile(people):
    out = profile_table(people, ["emial", "card_number"], profile=V13, as_of=AS_OF)
    assert out.columns == list(OLD_RESULT) and {r.Detector_Version for r in out.collect()} == {"13.0.0"}
    with pytest.raises(ValueError):
        profile_table(people, samples=16, profile=V13)


def test_empty_and_missing(spark, people):
    empty = profile_table(people.limit(0), as_of=AS_OF).collect()
    assert {r.Decision_Reason for r in empty} == {NO_VALUES} and len(empty) == len(people.columns)
    with pytest.raises(ValueError, match="not in the table"):
        profile_table(people, ["absent"])


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,note\n007,"a ""b""\nc"\nNA,\n', encoding="utf-8")
    assert [tuple(r) for r in read_csv(spark, str(path)).collect()] == [("007", 'a "b"\nc'), ("", "")]
    assert [tuple(r) for r in read_csv(spark, str(path), keep_missing=True).collect()] == [("007", 'a "b"\nc'), ("NA", "")]
    path.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="repeat"):
        read_csv(spark, str(path))
    with pytest.raises(Exception, match="(?i)exist"):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_dictionary(spark):
    df = spark.createDataFrame([("a ", None), ("ａ", "x"), ("nil", "x"), (None, "–")], "p string, q string")
    assert {(r.column_name, r.value, r.rows) for r in dictionary(df).collect()} == {("p", "a", 2), ("q", "x", 2)}


def test_dictionary_reads_once_and_shuffles_once(spark, tmp_path):
    spark.createDataFrame([("a", "é"), ("b ", "c")], "p string, q string").write.parquet(str(tmp_path / "t"))
    plan = dictionary(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_reports(spark, people, tmp_path):
    results = profile_table(people, ["emial", "sku"], as_of=AS_OF).cache()
    paths = reports.write_reports(results, people.select("emial", "sku"), str(tmp_path), "pw")
    assert set(paths) == {"detailed_report", "summary_report", "timing_report", "masked_data"}
    assert spark.read.csv(paths["masked_data"], header=True).columns == ["emial [MASKED]", "sku"]
    summary = {r.Column_Name: r for r in reports.summary(results).collect()}
    assert summary["emial"].PII_Status == "🔴 PII DETECTED" and summary["sku"].Entity_Type == "—"
    assert {r.Policy_Action: r.n_columns for r in reports.action_counts(results).collect()} == {"PROTECT": 1, "NONE": 1}
    said = reports.timing_report(results)
    assert "2 columns" in said and "named entities    not run" in said and "emial  [PII, Email Address]" in said and reports.bar(1, 8, 24) == "###" and reports.bar(1, 0) == ""
    assert "PII DETECTED: 1 columns" in reports.terminal_summary(results) and "zero-shot: not run" in reports.terminal_summary(results)


def test_stream(spark, tmp_path):
    from quillon.streaming.live import detect_stream, mask_stream

    spark.createDataFrame([("mail a@b.org",), ("none",)], "note string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("note string").parquet(str(tmp_path / "in"))
    for name, df in (("hits", detect_stream(stream, "note")), ("masked", mask_stream(stream, ["note"], "pw"))):
        q = df.writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert [(r.entity, r.span) for r in spark.table("hits").collect()] == [("Email Address", "a@b.org")]
    assert spark.table("masked").filter(F.col("`note [MASKED]`").startswith("AES::")).count() == 2
