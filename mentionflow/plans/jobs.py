"""Batch jobs from a file to a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow.functions.scoring import Scorer
from mentionflow.functions.text import assert_clean, clean
from mentionflow.operators.sentiment import score_text
from mentionflow.sinks.files import analyzed_path, write_json_lines
from mentionflow.sinks.reports import prediction_line
from mentionflow.sources.labelled import read_labelled, read_text_lines, tsv_fields


def scored_labelled(labelled: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(text, polarity, sentiment): cleaned, checked and scored."""
    cleaned = labelled.select(clean(F.col("text")).alias("text"), "polarity")
    checked = cleaned.withColumn("text", assert_clean(F.col("text")))
    return score_text(checked, scorer=scorer, name="sentiment")


def score_job(spark: SparkSession, in_path: str, out_path: str | None = None, scorer: Scorer | None = None) -> str:
    """Score a labelled JSON-lines file; returns where the result is."""
    target = out_path or analyzed_path(in_path)
    write_json_lines(scored_labelled(read_labelled(spark, in_path), scorer), target)
    return target


PREDICTION, REJECT = "prediction", "reject"
_OUTCOMES = "value string, outcome string"


def predict_job(spark: SparkSession, in_path: str, out_path: str, scorer: Scorer | None = None) -> None:
    """Predict the labels of a four-field TSV file. One pass over the input writes the lines of
    both outcomes, predictions and the other lines, blank ones too, to folders of ``out_path``."""
    fields = tsv_fields(read_text_lines(spark, in_path))
    scored = score_text(fields, scorer=scorer, name="score")
    good = F.col("text").isNotNull()
    lines = scored.select(
        F.when(good, prediction_line()).otherwise(F.col("value")).alias("value"),
        F.when(good, PREDICTION).otherwise(REJECT).alias("outcome"),
    )
    lines.write.partitionBy("outcome").text(out_path)


def predicted_lines(spark: SparkSession, out_path: str, outcome: str = PREDICTION) -> DataFrame:
    """The lines of one outcome of a prediction job."""
    found = spark.read.schema(_OUTCOMES).option("lineSep", "\n").text(out_path)
    return found.where(F.col("outcome") == outcome).select("value")
