"""Labels of the corpus formats, as column expressions; null where a row is illegal. The files are read by `importers`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def binary_label(flag: Column) -> Column:
    return F.when(flag == 1, "toxic").when(flag == 0, "clean")


def coarse_fine_label(coarse: Column, fine: Column) -> Column:
    """OTHER/OTHER is clean, OFFENSE with a kind of offence toxic, anything else null."""
    return F.when((coarse == "OTHER") & (fine == "OTHER"), "clean").when((coarse == "OFFENSE") & fine.isin("INSULT", "ABUSE", "PROFANITY"), "toxic")


def any_flag_label(flags: list[Column]) -> Column:
    """Toxic if any flag is 1, clean if all are 0, null if one is neither."""
    valid = F.lit(True)
    for f in flags:
        valid = valid & f.isin(0, 1)
    return F.when(F.coalesce(valid, F.lit(False)), F.when(F.greatest(*flags) == 1, "toxic").otherwise("clean"))


def code_list_label(codes: Column) -> Column:
    """Comma list of 0 to 8: only 8 is clean, any of 0 to 7 toxic; 8 beside others, empty lists and other codes null."""
    found = F.array_distinct(F.transform(F.split(codes, ","), lambda c: F.trim(c).try_cast("int")))
    valid = F.forall(found, lambda c: F.coalesce((c >= 0) & (c <= 8), F.lit(False)))
    return F.when(valid & ~(F.array_contains(found, 8) & (F.size(found) > 1)), F.when(F.array_contains(found, 8), "clean").otherwise("toxic"))


def span_label(text: Column, spans: Column) -> Column:
    """A JSON list of character places: none is clean, some toxic, one beyond the text null."""
    places = F.from_json(spans, "array<int>")
    inside = F.forall(places, lambda i: i < F.length(text))
    return F.when(places.isNotNull() & inside, F.when(F.size(places) == 0, "clean").otherwise("toxic"))


def vote_label(votes: list[Column]) -> tuple[Column, Column]:
    """(label, reason) of each annotator's overall vote: none is clean, one is excluded as ambiguous, more are toxic."""
    total = sum((F.coalesce(v, F.lit(0)) for v in votes[1:]), F.coalesce(votes[0], F.lit(0)))
    return F.when(total == 0, "clean").when(total > 1, "toxic"), F.when(total == 1, "ambiguous")


def label_join(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """id, text, label, problem: texts joined with labels by id; what either side lacks is named."""
    both = texts.withColumn("t", F.lit(True)).join(labels.withColumn("l", F.lit(True)), "id", "full")
    return both.select("id", "text", "label", F.when(F.col("l").isNull(), "missing label").when(F.col("t").isNull(), "unused label").alias("problem"))


def by_line(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Two tables of (line, value) side by side; a line that one of them lacks is kept with null."""
    return texts.select("line", F.col("value").alias("text")).join(labels.select("line", F.col("value").alias("label")), "line", "full")
