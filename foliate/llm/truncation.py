"""Texts cut off by field limits or in transfer.

Per source and column, the histograms of text lengths in characters and in bytes are tested for spikes: a length that
holds far more texts than the lengths around it is a limit at which that source cuts. Every text at such a length
without terminal punctuation (a closed payload counts as such) is truncated, whatever else it looks like. A transfer
stops anywhere, so that texts at no limit are judged by their endings instead: a JSON payload that is not closed, or
prose in mid-word or mid-sentence by the terminal-context model of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize
from . import endings

#: A spike holds at least so many texts, so many times the mean of the lengths within reach, and would be a chance of less
#: than exp(-SPIKE_SURPRISE) under a Poisson count of that mean (Chernoff's bound, so that all lengths may be tested).
SPIKE_COUNT = 5
SPIKE_RATIO = 5.0
SPIKE_SURPRISE = 20.0
REACH = 40


def length_spikes(rows: DataFrame) -> DataFrame:
    """(source, unit, length, texts, usual) of the lengths at which texts of a source pile up; unit is chars or bytes.

    ``rows`` has ``source``, ``n_chars`` and ``n_bytes``. Counts are aggregated before they are shuffled; a window
    then holds the distinct lengths of one source, never its texts.
    """
    long = rows.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("x"))
    counts = long.groupBy("source", "x.unit", "x.length").agg(F.count("*").alias("texts"))
    around = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-REACH, REACH)
    usual = (F.sum("texts").over(around) - F.col("texts")) / (2 * REACH)
    found = counts.withColumn("usual", usual)
    n, mean = F.col("texts"), F.greatest("usual", F.lit(1 / (2 * REACH)))
    high = (n >= SPIKE_COUNT) & (n > SPIKE_RATIO * mean) & (n * F.log(n / mean) - (n - mean) > SPIKE_SURPRISE)
    return found.where(high)


def _endings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [endings.ending(t) for t in frame["text"]]
        out = frame.drop(columns="text")
        out["json"] = [endings.payload(t) is not None for t in frame["text"]]
        out["stopped"] = [endings.stopped(t) for t in frame["text"]]
        out["state"] = [s for s, _ in found]
        out["last_word"] = [w for _, w in found]
        yield out


def find_truncated(records: DataFrame, key: str = "request_id", source: str = "model", text: str = "raw_generated_text") -> DataFrame:
    """One row per non-empty record: ``key``, source, n_chars, n_bytes, at_spike, truncated, how.

    ``how`` is ``limit`` (no terminal punctuation at a spike length), ``open_json`` or ``open_prose``; null if complete. Null and empty
    texts give no rows; repeated rows of a key count once; a null source is a source of its own.
    """
    rows = records.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).where(F.length("text") > 0)
    rows = rows.groupBy("k").agg(F.min(F.struct("source", "text")).alias("r")).select("k", "r.source", "r.text")
    sized = rows.withColumn("n_chars", F.length("text")).withColumn("n_bytes", F.octet_length("text"))
    schema = "k string, source string, n_chars int, n_bytes int, json boolean, stopped boolean, state string, last_word string"
    ended = materialize(sized.select("k", "source", "n_chars", "n_bytes", "text").mapInPandas(_endings, schema))
    spikes = length_spikes(ended).select("source", "unit", "length")
    for unit in ("chars", "bytes"):
        one = spikes.where(F.col("unit") == unit).select("source", F.col("length").alias(f"n_{unit}"), F.lit(True).alias(f"{unit}_spike"))
        ended = ended.join(one, ["source", f"n_{unit}"], "left")
    ended = ended.withColumn("at_spike", F.coalesce("chars_spike", F.lit(False)) | F.coalesce("bytes_spike", F.lit(False))).drop("chars_spike", "bytes_spike")
    limited = ended.where("at_spike").withColumn("state", F.when(F.col("stopped"), "complete").otherwise("open"))
    whole = limited.unionByName(endings.settle(ended.where("NOT at_spike"), endings.word_contexts(rows, "text")))
    open_ = F.col("state") == "open"
    how = F.when(open_ & F.col("at_spike"), "limit").when(open_ & F.col("json"), "open_json").when(open_, "open_prose")
    return whole.select(F.col("k").alias(key), "source", "n_chars", "n_bytes", "at_spike", open_.alias("truncated"), how.alias("how"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """Per source: texts, truncated texts, their share, and how many of them lie at a limit."""
    out = found.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("how") == "limit").alias("at_limit"))
    return out.withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
