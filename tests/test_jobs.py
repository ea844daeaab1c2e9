import json

import pytest

from mentionflow.functions.scoring import lexicon_scorer
from mentionflow.plans import jobs
from mentionflow.sinks import files
from mentionflow.sources import labelled

SCORER = lexicon_scorer({"good": 1, "bad": -1})


def lines_of(path):
    """All lines, blank ones too; a file ends with its last line."""
    return sorted(line for part in path.glob("part-*") for line in part.read_text().split("\n")[:-1])


def test_score_job_from_file_to_file(spark, tmp_path):
    source = tmp_path / "posts.json"
    rows = [
        {"text": "good day. bad \U0001f600", "polarity": "+"},
        {"text": "odd break é", "polarity": "="},
        {"text": "", "polarity": "-"},
        {"text": "...", "polarity": "-"},
    ]
    source.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    target = jobs.score_job(spark, str(source), scorer=SCORER)
    assert target == str(tmp_path / "posts-analyzed.json")
    found = {r.text: (r.polarity, r.sentiment) for r in labelled.read_labelled(spark, target, jobs_schema()).collect()}
    assert found == {
        "good day. bad  ": ("+", 2.0), "odd break é": ("=", 2.0), "": ("-", 0.0), "...": ("-", None),
    }
    with pytest.raises(Exception, match="already exists"):
        jobs.score_job(spark, str(source), scorer=SCORER)


def jobs_schema():
    from mentionflow.schemas import SCORED

    return SCORED


def test_a_line_that_does_not_parse_fails_the_job(spark, tmp_path):
    source = tmp_path / "posts.json"
    source.write_text('{"text": "a", "polarity": "+"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        jobs.score_job(spark, str(source), str(tmp_path / "out"))


def test_predict_job_routes_malformed_lines(spark, tmp_path):
    source = tmp_path / "posts.tsv"
    good = ["x\t1\tpositive\tgood good", "x\t2\tnegative\tbad", "x\t3\tneutral\tplain\t\t", "x\t4\tneutral\t..."]
    bad = ["x\t5\tpositive", "x\t6\tp\ttext\textra", "x\t7\tp\t", "just text"]
    source.write_text("\n".join(good + ["", *bad]) + "\n\n")
    out = tmp_path / "out"
    jobs.predict_job(spark, str(source), str(out), SCORER)
    assert lines_of(out / "outcome=prediction") == [
        "NA\t1\tpositive\t4.00\tpositive\tgood good",
        "NA\t2\tnegative\t1.00\tnegative\tbad",
        "NA\t3\tneutral\t2.00\tneutral\tplain",
        "NA\t4\tnull\tnull\tneutral\t...",
    ]
    assert lines_of(out / "outcome=reject") == sorted(["", "", *bad])
    for outcome in (jobs.PREDICTION, jobs.REJECT):
        found = jobs.predicted_lines(spark, str(out), outcome)
        assert sorted(r.value for r in found.collect()) == lines_of(out / f"outcome={outcome}")


def test_predict_job_without_rejects_or_lines(spark, tmp_path):
    for name, text, n in (("good", "x\t1\tpositive\tgood\n", 1), ("none", "", 0)):
        (tmp_path / name).write_text(text)
        jobs.predict_job(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"), SCORER)
        assert jobs.predicted_lines(spark, str(tmp_path / f"{name}-out")).count() == n
        assert jobs.predicted_lines(spark, str(tmp_path / f"{name}-out"), jobs.REJECT).count() == 0


def test_export_writes_symbols_and_text(spark, tmp_path):
    table = spark.createDataFrame([("Positive", "a"), ("neutral", "b")], "airline_sentiment string, text string")
    table.createOrReplaceTempView("labelled_test")
    source = labelled.labelled_table(spark, "labelled_test")
    files.export_labelled(source, str(tmp_path / "out"), "airline_sentiment", "text")
    assert lines_of(tmp_path / "out") == ['{"polarity":"+","text":"a"}', '{"polarity":"=","text":"b"}']


def test_analyzed_path():
    assert files.analyzed_path("/d/base.json") == "/d/base-analyzed.json"
    assert files.analyzed_path("base.json") == "base-analyzed.json"
    assert files.analyzed_path("/d.x/base") == "/d.x/base-analyzed"
