"""Weekly grid, export, windows and appended ids."""

from __future__ import annotations

import csv
import glob
import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import rules, scalars
from sparkseek.operators import feedback, validate
from sparkseek.operators.numbering import number_rows
from sparkseek.plans import reports
from sparkseek.sources import sinks, tables
from tests.conftest import at, tuples

FEEDBACK = (
    "id long, project_id long, question string, useful boolean, similarities array<double>, reason string, "
    "username string, created_at timestamp"
)
PROJECT = "id long, name string, git_url string, git_raw_url string, created_at timestamp"


def rows(spark, *entries):
    """(created_at, useful, project_id) or a dict of columns."""
    full = []
    for i, e in enumerate(entries):
        e = e if isinstance(e, dict) else dict(zip(("created_at", "useful", "project_id"), e))
        e = {"id": i + 1, "project_id": 1, "question": "q", "useful": True, "similarities": [0.5], "reason": None, "username": "u", **e}
        e["created_at"] = at(e["created_at"])
        full.append(tuple(e[c.split()[0]] for c in FEEDBACK.split(", ")))
    return spark.createDataFrame(full, FEEDBACK)


def projects(spark, *names):
    return spark.createDataFrame([(i + 1, n, None, None, at("2020-01-01")) for i, n in enumerate(names)], PROJECT)


def stats(spark, fb, pr, start, end, project=None):
    grid = feedback.in_grid_order(feedback.weekly_feedback_stats(fb, pr, at(start), at(end), project))
    return [
        (r["week_start"].isoformat(), r["project_id"], r["total_count"], r["useful_count"], r["not_useful_count"], r["useful_percentage"], r["not_useful_percentage"])
        for r in grid.collect()
    ]


def test_dense_grid(spark):
    fb = rows(spark, ("2020-01-06T12:00", True), ("2020-01-08T12:00", False), ("2020-01-20T12:00", True))
    assert stats(spark, fb, projects(spark, "a"), "2020-01-06", "2020-01-26T23:59:59") == [
        ("2020-01-06", 1, 2, 1, 1, 50.0, 50.0),
        ("2020-01-13", 1, 0, 0, 0, 0.0, 0.0),
        ("2020-01-20", 1, 1, 1, 0, 100.0, 0.0),
    ]


def test_window_clips_inside_a_week(spark):
    fb = rows(spark, ("2021-03-01T00:00", True), ("2021-03-10T00:00", True), ("2021-03-22T00:00", True))
    assert [s[:3] for s in stats(spark, fb, projects(spark, "a"), "2021-03-08", "2021-03-14")] == [("2021-03-08", 1, 1)]
    # Both ends are inside the window; the week is shown whole.
    assert [s[:3] for s in stats(spark, fb, projects(spark, "a"), "2021-03-10", "2021-03-10")] == [("2021-03-08", 1, 1)]


def test_one_project_or_all(spark):
    fb = rows(spark, ("2023-09-04T10:00", True, 1))
    pr = projects(spark, "a", "b")
    assert [s[1:3] for s in stats(spark, fb, pr, "2023-09-04", "2023-09-10")] == [(1, 1), (2, 0)]
    assert [s[1:3] for s in stats(spark, fb, pr, "2023-09-04", "2023-09-10", 2)] == [(2, 0)]


def test_percentages_round_halves_to_even(spark):
    counts = spark.createDataFrame([(32, 1, 31), (3, 1, 2), (0, 0, 0)], "total_count long, useful_count long, not_useful_count long")
    shares = feedback.with_percentages(counts).select("useful_percentage", "not_useful_percentage")
    assert tuples(shares) == [(3.12, 96.88), (33.33, 66.67), (0.0, 0.0)]


def test_grid_totals(spark):
    fb = rows(spark, *[(f"2024-01-{1 + i % 28:02d}T{i % 24:02d}:00", i % 3 == 0, 1 + i % 4) for i in range(200)])
    pr = projects(spark, *"abcdef")
    grid = stats(spark, fb, pr, "2024-01-03", "2024-01-24T12:00")
    inside = fb.filter(F.col("created_at").between(at("2024-01-03"), at("2024-01-24T12:00"))).count()
    assert len(grid) == 4 * 6 and sum(s[2] for s in grid) == inside
    assert all(s[5] + s[6] == pytest.approx(100, abs=0.011) for s in grid if s[2])


def test_grid_counts_before_the_shuffle(spark):
    fb, pr = rows(spark, ("2024-01-03T00:00", True)), projects(spark, "a")
    plan = feedback.weekly_feedback_stats(fb, pr, at("2024-01-01"), at("2024-01-31"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_nested_weeks(spark):
    fb = rows(spark, ("2024-01-03T00:00", True, 3))
    pr = projects(spark, "a", "b", "c")
    grid = feedback.weekly_feedback_stats(fb, pr, at("2024-01-01"), at("2024-01-14"))
    weeks = feedback.nest_weeks(grid).orderBy("week_start").collect()
    assert [(w["week_start"], w["week_end"]) for w in weeks] == [
        (date(2024, 1, 1), date(2024, 1, 7)), (date(2024, 1, 8), date(2024, 1, 14))
    ]
    assert [p["project_name"] for p in weeks[0]["projects"]] == ["a", "b", "c"]
    parts = feedback.nest_weeks(grid, projects_per_row=2).orderBy("week_start", "part").collect()
    assert [(w["part"], len(w["projects"])) for w in parts] == [(0, 1), (1, 2)] * 2


def test_a_week_is_one_row_whatever_the_ids(spark):
    pr = projects(spark, "a", "b", "c", "d").withColumn("id", F.element_at(F.lit([3, 9999, 10000, 25000]), F.col("id").cast("int")).cast("long"))
    grid = feedback.weekly_feedback_stats(rows(spark, ("2024-01-03T00:00", True, 3)), pr, at("2024-01-01"), at("2024-01-07"))
    (week,) = feedback.nest_weeks(grid).collect()
    assert [p["project_id"] for p in week["projects"]] == [3, 9999, 10000, 25000]


def test_weekly_json(spark, tmp_path):
    report = reports.stats_report(rows(spark, ("2024-01-03T00:00", True)), projects(spark, "a"), at("2024-01-01"), at("2024-01-05"))
    reports.write_stats_report(report, str(tmp_path / "j"))
    lines = [line for f in glob.glob(f"{tmp_path}/j/part*") for line in open(f)]
    assert json.loads(lines[0]) == {
        "week_start": "2024-01-01", "week_end": "2024-01-07",
        "start_date": "2024-01-01T00:00:00.000Z", "end_date": "2024-01-05T00:00:00.000Z",
        "projects": [{"project_id": 1, "project_name": "a", "total_count": 1, "useful_count": 1, "not_useful_count": 0, "useful_percentage": 100.0, "not_useful_percentage": 0.0}],
    }


def test_export_order_and_window(spark):
    fb = rows(spark, ("2024-04-10T00:00", False), ("2024-04-05T00:00", True), ("2024-05-01T00:00", True), ("2024-04-05T00:00", True, 9))
    out = feedback.export_rows(fb, projects(spark, "a"), at("2024-04-01"), at("2024-04-30"))
    assert [r["id"] for r in out.collect()] == [2, 1]


def read_csv(folder):
    with open(glob.glob(f"{folder}/part*.csv")[0], newline="") as f:
        return list(csv.reader(f))


def test_csv_text(spark, tmp_path):
    fb = rows(
        spark,
        {"created_at": "2018-04-05T12:00:00.987", "similarities": [0.91, 0.73]},
        {"created_at": "2018-04-06T12:00", "useful": False, "similarities": []},
    )
    path = reports.export_report(fb, projects(spark, "a"), str(tmp_path), at("2018-04-01"), at("2018-04-30"))
    assert path.endswith("feedback_export_20180401_20180430.csv")
    assert read_csv(path) == [
        ["id", "project_id", "project_name", "question", "useful", "similarities", "reason", "username", "created_at"],
        ["1", "1", "a", "q", "True", "[0.91,0.73]", "", "u", "2018-04-05T12:00:00Z"],
        ["2", "1", "a", "q", "False", "[]", "", "u", "2018-04-06T12:00:00Z"],
    ]


AWKWARD = 'say "hi", then\nnew line,\r\n windows \\back\\ "\\" and  spaces '


def test_csv_quoting(spark, tmp_path):
    fb = rows(spark, {"created_at": "2018-05-05T12:00", "question": AWKWARD, "reason": '"', "username": "a\\"})
    path = reports.export_report(fb, projects(spark, "x,y"), str(tmp_path), at("2018-05-01"), at("2018-05-30"), project_id=1)
    assert path.endswith("feedback_export_20180501_20180530_project-1.csv")
    line = read_csv(path)[1]
    assert line[2:4] == ["x,y", AWKWARD] and line[6:8] == ['"', "a\\"]
    schema = "id long, project_id long, project_name string, question string, useful string, similarities string, reason string, username string, created_at string"
    back = sinks.read_feedback_csv(spark, path, schema).first()
    assert back["question"] == AWKWARD and back["reason"] == '"' and back["username"] == "a\\"


def test_csv_zone(spark, tmp_path):
    fb = rows(spark, ("2018-06-05T12:00", True))
    path = reports.export_report(fb, projects(spark, "a"), str(tmp_path), at("2018-06-01"), at("2018-06-30"), zone="America/Sao_Paulo")
    assert read_csv(path)[1][8] == "2018-06-05T09:00:00-03:00"
    with pytest.raises(rules.RuleViolation, match="400-invalid-timezone"):
        reports.export_report(fb, projects(spark, "a"), str(tmp_path), zone="Mars/Base")
    assert scalars.known_timezone("") is None


def test_unknown_project_is_not_found(spark, tmp_path):
    fb, pr = rows(spark, ("2018-06-05T12:00", True)), projects(spark, "a")
    for call in (lambda: reports.stats_report(fb, pr, project_id=9), lambda: reports.export_report(fb, pr, str(tmp_path), project_id=9)):
        with pytest.raises(rules.RuleViolation, match="404-project-not-found: No project exists with id 9."):
            call()


@pytest.mark.parametrize(
    "value,text",
    [(0.91, "0.91"), (1.0, "1"), (0.0, "0"), (-0.5, "-0.5"), (0.0005, "0.0005"), (0.0001, "0.0001"), (0.00001, "1E-05"), (1.5e-7, "1.5E-07"),
     (12345678.0, "12345678"), (12345678.25, "12345678.25"), (1e14, "100000000000000"), (1e15, "1E+15"), (2.5e200, "2.5E+200"), (123456.75, "123456.75")],
)
def test_numbers_in_shortest_form(spark, value, text):
    row = spark.createDataFrame([([value],)], "v array<double>")
    assert row.select(scalars.json_numbers(F.col("v"))).first()[0] == f"[{text}]"


def test_awkward_fields_first_and_last(spark, tmp_path):
    """Empty, blank and quoted names survive, whatever column they are in."""
    for n, text in enumerate([" ", "", ",", '""', "\n", "'", "a\tb", "é"]):
        fb = rows(spark, {"created_at": "2018-05-05T12:00", "question": text, "reason": text})
        path = reports.export_report(fb, projects(spark, "p"), str(tmp_path / str(n)), at("2018-05-01"), at("2018-05-30"))
        line = read_csv(path)[1]
        assert (line[3], line[6]) == (text, text)


# --- windows

NOW = datetime(2026, 3, 15, 10, 30)


def test_stats_window():
    d = timedelta(days=30)
    a, b = at("2026-01-01"), at("2026-01-31")
    assert validate.stats_window(None, None, NOW) == (NOW - d, NOW)
    assert validate.stats_window(a, None, NOW) == (a, a + d)
    assert validate.stats_window(None, b, NOW) == (b - d, b)
    assert validate.stats_window(a, a + timedelta(days=366), NOW) == (a, a + timedelta(days=366))
    with pytest.raises(rules.RuleViolation, match="400-invalid-date-range"):
        validate.stats_window(b, a, NOW)
    with pytest.raises(rules.RuleViolation, match="400-window-too-large"):
        validate.stats_window(a, a + timedelta(days=367), NOW)


def test_moments_with_a_zone(spark):
    """A window given in another zone is the same window."""
    east = timezone(timedelta(hours=5))
    start, end = datetime(2026, 1, 5, 5, tzinfo=east), datetime(2026, 1, 12, 4, tzinfo=east)
    assert validate.stats_window(start, end, NOW) == (at("2026-01-05"), at("2026-01-11T23:00"))
    fb = rows(spark, ("2026-01-05T00:00", True), ("2026-01-11T23:00", True), ("2026-01-11T23:00:00.000001", True))
    assert feedback.weekly_counts(fb, start, end).first()["total_count"] == 2


def test_export_window():
    a, b = at("2026-01-01"), at("2026-01-31")
    assert validate.export_window(None, None, NOW) == (at("2026-03-01"), NOW)
    assert validate.export_window(a, None, NOW) == (a, NOW)
    assert validate.export_window(None, at("2026-03-20"), NOW) == (at("2026-03-01"), at("2026-03-20"))
    with pytest.raises(rules.RuleViolation, match="400-invalid-date-range"):
        validate.export_window(None, b, NOW)
    with pytest.raises(rules.RuleViolation, match="400-window-too-large"):
        validate.export_window(NOW - timedelta(days=367), NOW, NOW)


def test_windows_of_a_table_agree_with_single_ones(spark):
    a, b = at("2026-01-01"), at("2026-01-31")
    cases = [(None, None), (a, None), (None, b), (a, b), (b, a), (a, a + timedelta(days=367)), (None, a - timedelta(days=3))]
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, start_date timestamp, end_date timestamp")
    for single, many in ((validate.stats_window, validate.with_stats_window), (validate.export_window, validate.with_export_window)):
        got = many(table, NOW).orderBy("i").collect()
        for row, (start, end) in zip(got, cases):
            try:
                assert (row["window_start"], row["window_end"]) == single(start, end, NOW) and row["error_code"] is None
            except rules.RuleViolation as broken:
                assert row["error_code"] == broken.code


# --- storage


def test_large_folders_are_written_in_several_files(spark, tmp_path):
    """A day with most rows is spread by size, as far as the tasks that made the rows allow."""
    fb = spark.range(60_000).select(
        "id", F.lit(1).cast("long").alias("project_id"), F.sha2(F.col("id").cast("string"), 512).alias("question"), F.lit(True).alias("useful"),
        F.array(F.rand(1)).alias("similarities"), F.lit(None).cast("string").alias("reason"), F.lit("u").alias("username"),
        F.timestamp_seconds(F.when(F.col("id") % 10 < 9, 1704240000).otherwise(1706745600 + F.floor(F.col("id") / 10) % 5 * 86400)).alias("created_at"),
    )
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(setting, "256k")
    try:
        tables.write_feedback(fb, str(tmp_path / "f"))
    finally:
        spark.conf.unset(setting)
    per_day = {d: len(glob.glob(f"{d}/intake=*/part*")) for d in glob.glob(f"{tmp_path}/f/created_on=*")}
    assert len(per_day) == 6 and per_day.pop(f"{tmp_path}/f/created_on=2024-01-03") > 3
    assert max(per_day.values()) <= 4
    assert tables.read_feedback(spark, str(tmp_path / "f")).count() == 60_000


def test_reports_read_only_the_days_of_their_window(spark, tmp_path):
    fb = rows(spark, *[(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}T00:00", True) for i in range(80)])
    tables.write_feedback(fb, str(tmp_path / "f"))
    stored = tables.read_feedback(spark, str(tmp_path / "f"))
    for report in (
        feedback.weekly_feedback_stats(stored, projects(spark, "a"), at("2024-02-05"), at("2024-02-11")),
        feedback.export_rows(stored, projects(spark, "a"), at("2024-02-05"), at("2024-02-11")),
    ):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(created_on" in plan and "created_on#" in plan.split("PartitionFilters: [")[1][:200]


def test_an_intake_that_is_repeated_replaces_itself(spark, tmp_path):
    fb = rows(spark, ("2024-01-03T00:00", True, 1), ("2024-02-03T23:00", False, 2))
    for _ in range(2):
        tables.write_feedback(fb, str(tmp_path / "f"), "overwrite", "stream-7")
    tables.write_feedback(fb, str(tmp_path / "f"))
    assert tables.read_feedback(spark, str(tmp_path / "f")).count() == 4


def test_results_do_not_depend_on_the_session_zone(spark, tmp_path):
    fb = rows(spark, ("2024-01-22T01:00", True, 1), ("2024-01-21T23:59", False, 2), ("2024-03-10T07:30", True, 3))
    window = spark.createDataFrame([(at("2024-03-09T12:00"), None)], "start_date timestamp, end_date timestamp")

    def results():
        shown = fb.select(
            "id", scalars.week_start(F.col("created_at")), scalars.created_at_text(F.col("created_at")),
            scalars.created_at_text(F.col("created_at"), "Asia/Kolkata"), scalars.export_file_stem(F.col("created_at"), F.col("created_at")),
        )
        weeks = fb.select(F.explode(scalars.weeks_between(at("2024-01-21T23:00"), at("2024-01-22T01:00")))).distinct()
        ends = validate.with_stats_window(window, NOW).select(F.unix_micros("window_end"))
        path = str(tmp_path / spark.conf.get("spark.sql.session.timeZone").replace("/", "-"))
        tables.write_feedback(fb, path)
        days = tables.read_feedback(spark, path).select("id", "created_on")
        return [sorted(tuples(x)) for x in (shown, weeks, ends, days)]

    expected = results()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert results() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert str(expected[0][0][1]) == "2024-01-22" and expected[0][0][2] == "2024-01-22T01:00:00Z"


def test_append_feedback_numbers_in_order(spark):
    existing = rows(spark, {"id": 41, "created_at": "2024-01-01T00:00"})
    new = rows(spark, *[{"id": 0, "created_at": "2024-01-02T00:00", "question": f"q{i}"} for i in range(50)])
    new = new.drop("id", "created_at").withColumn("submission_id", F.substring("question", 2, 9).cast("long") * F.lit(10**9))
    for per_range in (1_000_000, 7):
        out = feedback.append_feedback(existing, new, NOW, rows_per_range=per_range).orderBy("id").collect()
        assert [(r["id"], r["question"]) for r in out] == [(42 + i, f"q{i}") for i in range(50)]
        assert out[0]["created_at"] == NOW
    plan = feedback.append_feedback(existing, new, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_numbering_is_dense_for_clustered_keys(spark):
    keys = [10**15 + i for i in range(300)] + list(range(300)) + [-5, 7 * 10**12]
    table = spark.createDataFrame([(k,) for k in keys], "key long").repartition(6)
    out = number_rows(table, "key", 0, rows_per_range=20).orderBy("key").collect()
    assert [r["id"] for r in out] == list(range(1, len(keys) + 1))


def test_ids_beyond_32_bits(spark):
    table = spark.createDataFrame([(i,) for i in range(50)], "key long")
    for per_range in (1_000, 10):
        out = number_rows(table, "key", 2**31 - 3, rows_per_range=per_range).orderBy("key").collect()
        assert [r["id"] for r in out] == [2**31 - 2 + i for i in range(50)]


def test_stored_tables_come_back(spark, tmp_path):
    fb = rows(spark, ("2024-01-03T00:00", True, 1), ("2024-02-03T23:00", False, 2))
    tables.write_feedback(fb, str(tmp_path / "f"))
    stored = tables.read_feedback(spark, str(tmp_path / "f"))
    assert stored.columns == [*fb.columns, "created_on"] and sorted(tuples(stored.drop("created_on"))) == sorted(tuples(fb))
    january = tables.read_feedback(spark, str(tmp_path / "f"), at("2024-01-01"), at("2024-01-31"))
    assert [r["id"] for r in january.collect()] == [1]
    assert "PartitionFilters: [isnotnull(created_on" in january._jdf.queryExecution().executedPlan().toString()
