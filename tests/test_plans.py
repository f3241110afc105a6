"""Evaluation, profiles and command lines."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.__main__ import main
from shelfmark.evaluate import main as evaluate
from shelfmark.operators.metrics import stage_profile
from shelfmark.plans.evaluation import candidates, evaluate_documents, evaluate_single, measure_latency, sample_in_order
from shelfmark.plans.profiling import Profile

ROWS = [("a-md", [1.0, 0.0], "md"), ("a-pdf", [0.9, 0.1], "pdf"), ("b-md", [0.0, 1.0], "md"), ("b-md", [0.6, 0.6], "md")]


def test_evaluation(spark):
    rows = spark.createDataFrame(ROWS, "file_id string, vector array<float>, fmt string")
    queries = spark.createDataFrame([("q1", "Plain", [1.0, 0.0]), ("q2", "Plain", [0.0, 1.0])], "query_id string, query_type string, vector array<float>")
    relevant = spark.createDataFrame([("q1", "a-pdf"), ("q2", "b-md")], "query_id string, file_id string")
    single = {r.k: r for r in evaluate_single(rows, queries, relevant, [1, 2], target="audio").collect()}
    assert single[1].recall == 0.5 and single[2].recall == 1.0 and single[2].mrr == 0.75
    logical = spark.createDataFrame([("a-md", "a"), ("a-pdf", "a"), ("b-md", "b")], "file_id string, logical_id string")
    wanted = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, logical_id string")
    scores = {(r.view, r.k): r for r in evaluate_documents(rows, queries, wanted, logical, [1], {"mixed": None, "pdf": "pdf"}).collect()}
    assert scores[("mixed", 1)].hit == 1.0 and scores[("mixed", 1)].queries == 2 and scores[("pdf", 1)].queries == 1
    assert (candidates("image", [1, 10]), candidates("audio", [5]), candidates("text", [20])) == (10, 100, 400)
    assert sample_in_order(range(10), 3, 1) == sorted(sample_in_order(range(10), 3, 1)) and sample_in_order([1], 5, 1) == [1]
    assert measure_latency(spark, lambda q: q, [1, 2, 3]).first().n == 3


@pytest.mark.parametrize("argv", [[], ["x", "--index", "d"], ["x", "--limit", "0", "--target", "text"], ["--index", "d", "--format", "png"], ["x"], ["x", "--target", "text", "--min-res", "5x5"], ["x", "--target", "audio", "--format", "png"], ["x", "--after", "never", "--target", "text"]])
def test_usage_errors(argv, capsys):
    assert main(argv) == 2
    assert "error" in capsys.readouterr().err


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Bees\n\nHoney.")
    library = ["--library", str(tmp_path / "lib")]
    assert main(["--index", str(tmp_path / "docs"), *library]) == 0
    assert main(["honey", "--target", "text", *library]) == 0 and "Bees" in capsys.readouterr().out
    assert main(["--duplicates", *library]) == 0
    (tmp_path / "docs" / "bad.pdf").write_text("no")
    assert main(["--index", str(tmp_path / "docs"), *library]) == 1
    assert main(["--index", str(tmp_path / "none"), *library]) == 2


def test_evaluation_command(spark, tmp_path, capsys):
    corpus = tmp_path / "corpus" / "Acme"
    for fmt, body in (("md", "# Bees\n\nHoney in the hive."), ("html", "<h1>Bees</h1><p>Honey in the hive.</p>")):
        (corpus / fmt).mkdir(parents=True)
        (corpus / fmt / f"bees.{fmt}").write_text(body)
        (corpus / fmt / f"lamps.{fmt}").write_text(body.replace("Bees", "Lamps").replace("Honey in the hive", "Invoices for lamps"))
    library = str(tmp_path / "lib")
    assert main(["--index", str(corpus), "--library", library]) == 0
    out = capsys.readouterr().out
    assert "Discovery complete" in out and "Text files  4 found · 4 new · 0 changed · 0 unchanged" in out
    questions = tmp_path / "q.csv"
    questions.write_text('Enterprise Name,Query Type,Query,Supporting Facts\nAcme,factual,Where is honey?,"[{""filename"": ""bees.pdf""}]"\nAcme,odd,Else?,"[{""filename"": ""none.pdf""}]"\n')
    target = str(tmp_path / "runs" / "one.json")
    run = [str(questions), "--target", "text", "--library", library, "--k", "1", "2", "--output", target]
    assert evaluate([*run, "--latency-samples", "1", "--latency-warmup", "0"]) == 0
    summary = json.loads((tmp_path / "runs" / "one.json").read_text())
    assert summary["coverage"] == {"fully": 1, "skipped": 1} and summary["evaluated_queries"] == 1 and summary["query_latency_ms"]["n"] == 1
    assert {(r["view"], r["k"]): r["hit"] for r in summary["all"]} == {("mixed", 1): 1.0, ("mixed", 2): 1.0, ("html", 1): 1.0, ("html", 2): 1.0, ("md", 1): 1.0, ("md", 2): 1.0}
    assert evaluate(run) == 2
    captions = tmp_path / "c.json"
    captions.write_text('{"images": [], "annotations": []}')
    assert evaluate([str(captions), "--target", "image", "--library", library]) == 0
    for wrong in (["none.csv", "--target", "text"], [str(questions), "--target", "text", "--k", "0"], [str(questions)], [str(questions), "--target", "text", "--library", "/none"]):
        assert evaluate([*wrong]) == 2


def test_profile(spark):
    profile = Profile()
    with profile.span("run"):
        with profile.span("parse", items=3) as inner:
            inner.input_bytes = 10
        with pytest.raises(KeyError), profile.span("store"):
            raise KeyError("x")
    events = {r.stage: r for r in profile.table(spark).collect()}
    assert events["parse"].parent_id == events["run"].event_id and events["run"].parent_id is None and events["store"].error.startswith("KeyError")
    assert profile.lacking(["run", "embed"]) == ["embed"]
    summed = {r.event_type: r for r in stage_profile(profile.table(spark).withColumnRenamed("stage", "event_type"), "event_type", "duration_ms", "items", F.col("error").isNotNull(), "input_bytes", "cpu_ms").collect()}
    assert summed["parse"].items == 3 and summed["parse"].bytes == 10 and summed["store"].errors == 1 and summed["run"].share == 1.0
