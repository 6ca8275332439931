"""Per-document text statistics, their exact ranks within each language, and what each text is.

Statistics: word count, mean word length, symbol ratio, share of lines that end in punctuation, share of common words
(words that occur in at least ``COMMON_SHARE`` of all different texts), share of function words, share of different
words, and the shares of the text that a line grammar takes for list entries, table rows and junk.

Ranks: the distinct values of each statistic and language are counted over different texts, sorted by range
partitioning, and summed within partitions; the totals of the partitions before give each its offset, so that ranks are
exact at any size without a global window. A language of few texts, or none, is ranked within the whole collection.

Tail probabilities: both tails of each statistic, as negative logarithms, are the coordinates of a text. The outlier
score is the largest of the summed left, right and skew-chosen tails. The kind is the direction (prose, list, table,
junk) along which the tails of all statistics sum to most. The weights of the directions are fitted on at most
``SAMPLE_TEXTS`` different texts, those that the grammar is clear about; every text is then decided by its own tails.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize, small_enough
from . import endings, pairs

STATISTICS = ("word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
FURTHER = ("function_words", "different_words", "list_lines", "table_lines", "junk_lines")
KINDS = ("prose", "list", "table", "junk")
#: Words in at least this share of all different texts are common (and in no fewer than COMMON_LEAST of them); there are
#: at most (mean distinct words of a document) / COMMON_SHARE of them, whatever the corpus.
COMMON_SHARE = 0.001
COMMON_LEAST = 3
BROADCAST_ROWS = 100_000
#: A language of fewer different texts is ranked within the whole collection.
THIN_TEXTS = 1000
#: Bound of the sample that the directions are fitted on, and the grammar's shares from which it is clear about a text.
SAMPLE_TEXTS = 20_000
CLEAR = 0.8
FIT_STEPS = 500
#: Distinct words that one task counts before it hands them on.
COUNTER_WORDS = 300_000
LEAST_CHARS = 40
#: Share of function words from which a text is prose without a look at its lines.
PLAIN_PROSE = 0.36

WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
STOPS = frozenset(".!?…:;。！？")
CLOSERS = "\"'”’»)]"
LINE_STOP = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
MARK = re.compile(r"^\s*(?:[-*•·–—+>▪◦‣]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\]|☐|☑|✓|#+)\s+\S")
LEADERS = re.compile(r"(?:\.{4,}|(?:\. ){4,}|_{4,}|…{2,})\s*\d+\s*$")
MARKUP = re.compile(r"<[^<>\n]{0,200}>|\{\{[^{}\n]*\}\}|&#?\w{1,8};")
DAMAGE = re.compile(r"[ÃÂ][^\sA-Za-z]|â[‚€™œž„†]|â‚¬|ï»¿")
OTHER_SCRIPT = re.compile(r"[Ͱ-῿⺀-꯿가-힯豈-﫿]")
WIDE_SCRIPT = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
COLUMNS = re.compile(r"\S[  ]{2,}(?=\S)")
FUNCTION_WORDS = frozenset(w for words in pairs.FUNCTION_WORDS.values() for w in words) | endings.RUNNING


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts[""] += 1
            if text:
                counts.update(set(WORD.findall(text.lower())))
            if len(counts) > COUNTER_WORDS:
                yield flush()
    if counts:
        yield flush()


def common_words(df: DataFrame, text: str = "text", share: float = COMMON_SHARE) -> DataFrame:
    """(word, documents) of the words in at least ``share`` of all different texts; counts are combined before the shuffle.

    Copies count once, or the signs of a junk text that is often repeated would pass for words. The number of all
    different texts comes from the same pass, as the count of the empty word.
    """
    texts = df.select(F.col(text).alias("t")).distinct()
    counted = materialize(texts.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("documents")))
    total = counted.where("word = ''").agg(F.coalesce(F.max("documents"), F.lit(0))).first()[0]
    return counted.where((F.col("word") != "") & (F.col("documents") >= max(COMMON_LEAST, share * total)))


def statistics(text: str, words: list[str], common: frozenset[str]) -> tuple[int, float, float, float, float]:
    """``words`` are the lower-case words of ``text``."""
    n = len(words)
    visible = len("".join(text.split()))
    alnum = sum(map(len, words))
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    stops = sum(1 for s in lines if s[-1] in STOPS or (s[-1] in CLOSERS and s.rstrip(CLOSERS)[-1:] in STOPS and s.rstrip(CLOSERS)))
    return (
        n,
        round(alnum / n, 3) if n else 0.0,
        round(max(0, visible - alnum) / visible, 4) if visible else 0.0,
        round(stops / len(lines), 4) if lines else 0.0,
        round(sum(map(common.__contains__, words)) / n, 4) if n else 0.0,
    )


def _cells(line: str) -> int:
    """Number of cells of a line, if a delimiter cuts it into short ones; else 0."""
    for sign in ("\t", "|", '","', ";", ","):
        n = line.count(sign)
        if n >= 2 or (n and sign in ("\t", '","')) or (n and sign == "|" and (" | " in line or line[0] == "|")):
            if sign == "," and ", " in line:
                continue
            parts = [p.split() for p in line.split(sign)]
            if max(map(len, parts)) <= 6 and sum(map(len, parts)) <= 3.5 * len(parts):
                return n + 1
    gaps = COLUMNS.findall(line.strip())
    if gaps:
        parts = [p for p in re.split(r"[  ]{2,}", line.strip()) if p]
        if max(len(p.split()) for p in parts) <= 4 and (len(parts) >= 3 or max(map(len, gaps)) >= 4):
            return len(parts)
    return 0


def _natural(text: str, words: list[str]) -> bool:
    """Whether words that nobody knows still form sentences: repeated short words, vowels, stops and capitals."""
    lower = [w.lower() for w in words if w.isalpha()]
    if len(lower) < 12:
        return False
    top = Counter(lower).most_common(1)[0][1] / len(lower)
    joined = "".join(lower)
    vowels = sum(joined.count(v) for v in "aeiouyäöüáéíóúàèìòùâêîôûåæøœãõąęıő") / len(joined)
    stops = len(re.findall(r"[.!?][\"'”’)]*(?:\s+[A-ZÀ-ÞА-Я]|\s*$)", text))
    return top >= 0.02 and 0.25 <= vowels <= 0.6 and stops * 45 >= len(lower) and 2.5 <= len(joined) / len(lower) <= 11


def composition(text: str, lower_words: list[str], common: frozenset[str]) -> dict[str, int]:
    """Characters of a text by what they are: prose, list, table, junk."""
    out = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    # Entries, cells and junk have few function words; a text of as many as this cannot be for half anything but prose.
    if sum(map(FUNCTION_WORDS.__contains__, lower_words)) >= PLAIN_PROSE * len(lower_words) > 10 and len(set(lower_words)) > 8:
        return out | {"prose": len(text)}
    lines = [line for line in text.replace("﻿", "").split("\n") if line.strip()]
    repeated = Counter(line.strip() for line in lines)
    all_words = LETTERS.findall(text)
    total = sum(map(len, all_words))
    # Encoding damage in nearly every word leaves nothing to read.
    if all_words and len(DAMAGE.findall(text)) >= 0.5 * len(text.split()):
        return out | {"junk": len(text)}
    known = sum(len(w) for w in all_words if len(w) > 2 and (w.lower() in common or w.lower() in FUNCTION_WORDS))
    readable = total and (known >= 0.35 * total or len(OTHER_SCRIPT.findall(text)) >= 0.3 * total or _natural(text, all_words))
    open_before = False
    for line in lines:
        s = line.strip()
        size = len(s)
        bare = MARKUP.sub("", s).strip()
        words = WORD.findall(bare)
        alnum = sum(map(len, words))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        if MARK.match(line) and words and readable and alnum >= 0.3 * len(bare):
            kind = "list"
        elif LEADERS.search(s) and words:
            kind = "list"
        elif len(bare) < 0.5 * size or same > 0.5 * len(words) or (repeated[s] >= 3 and repeated[s] > 0.1 * len(lines) and len(words) < 4):
            kind = "junk"
        else:
            cells = _cells(line)
            ruled = not words and re.fullmatch(r"[-+=|:_\s]+", s) and "|" in s + ("|" if "+" in s else "")
            letters = LETTERS.findall(bare)
            span = sum(map(len, letters))
            whole = sum(len(w) for w in letters if w.lower() in common or w.lower() in FUNCTION_WORDS)
            other = len(OTHER_SCRIPT.findall(bare))
            lower = [w.lower() for w in words]
            running = sum(w in FUNCTION_WORDS for w in lower)
            if ruled or (cells and running <= 0.2 * len(words) and (not span or whole >= 0.3 * span or other) and alnum >= 0.35 * len(re.sub(r"[\s|;,\"]", "", bare) or "x")):
                kind = "table"
            elif not readable or not words or alnum < 0.4 * len(bare.replace(" ", "")):
                kind = "junk"
            elif other > 0.3 * max(1, span):
                enough = len(bare) >= 15 if WIDE_SCRIPT.search(bare) else len(words) >= 5
                kind = "prose" if enough or open_before or LINE_STOP.search(s) else "list"
            elif sum(len(w) for w in letters if len(w) > 2) < 0.25 * alnum:
                kind = "junk"
            elif span and whole < 0.25 * span and len(letters) >= 4 and not _natural(text, all_words):
                kind = "junk"
            else:
                stop = re.search(r"[.!?…。][\"'”’»)\]]*$", s)
                if len(words) >= 6 and (running >= 0.15 * len(words) or stop or open_before):
                    kind = "prose"
                elif stop and (open_before or (len(words) >= 3 and running)):
                    kind = "prose"
                elif open_before and len(words) >= 3 and not re.match(r"[A-Z]", s):
                    kind = "prose"
                else:
                    kind = "list"
        out[kind] += size
        open_before = kind == "prose" and not re.search(r"[.!?…:。][\"'”’»)\]]*$", s) and size >= 35
    return out


def further_statistics(text: str, lower_words: list[str], common: frozenset[str]) -> tuple[float, ...]:
    n = len(lower_words)
    parts = composition(text, lower_words, common) if len(text) >= LEAST_CHARS else dict.fromkeys(KINDS, 0)
    total = sum(parts.values())
    return (
        round(sum(map(FUNCTION_WORDS.__contains__, lower_words)) / n, 3) if n else 0.0,
        round(len(set(lower_words)) / n, 3) if n else 0.0,
        *(round(parts[kind] / total, 2) if total else 0.0 for kind in KINDS[1:]),
    )


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: key, lang (primary subtag, ``und`` if there is none), n_chars, h (hash of the text), statistics.

    Null and empty texts have zeros.
    """
    # Sums over all words of the texts they are in are the distinct words of all texts, so that at most (mean distinct
    # words of a text) / COMMON_SHARE words reach the share, however many texts there are.
    sent = df.sparkSession.sparkContext.broadcast(common_words(df, text).select("word").toArrow().column(0).combine_chunks())
    names = (*STATISTICS, *FURTHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = frozenset(sent.value.to_pylist())
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            lower = [WORD.findall(t.lower()) for t in texts]
            rows = [statistics(t, w, words) + further_statistics(t, w, words) for t, w in zip(texts, lower, strict=True)]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(map(len, texts)), pa.int64()), *columns], names=["key", "lang", "h", "n_chars", *names])

    language = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.col(lang), "^[A-Za-z]+", 0)), F.lit("")), F.lit("und"))
    schema = f"key {dict(df.dtypes)[key]}, lang string, h bigint, n_chars bigint, " + ", ".join(f"{s} double" for s in names)
    return df.select(F.col(key).alias("key"), language.alias("lang"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("t")).mapInArrow(run, schema)


def exact_ranks(values: DataFrame, groups: list[str], value: str, count: str) -> DataFrame:
    """Adds ``below`` (rows with a smaller value in the group) and ``total`` to distinct (groups, value, count) rows.

    Range-partitioned sort, running sums within partitions, and the offsets of the partitions before. Only one row per
    partition and group is combined globally.
    """
    kinds = dict(values.dtypes)
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = values.repartitionByRange(n, *groups, value).sortWithinPartitions(*groups, value).withColumn("part", F.spark_partition_id())

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: dict[tuple, int] = {}
        for frame in frames:
            keys = list(frame[groups].itertuples(index=False, name=None))
            inside = frame.groupby(groups, sort=False)[count].cumsum() - frame[count]
            frame["below"] = inside + np.array([carried.get(k, 0) for k in keys], dtype=np.int64)
            for k, total in frame.groupby(groups, sort=False)[count].sum().items():
                k = k if isinstance(k, tuple) else (k,)
                carried[k] = carried.get(k, 0) + int(total)
            yield frame

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in values.columns) + ", part int, below bigint"
    # Written once, as a second computation of the ranks might cut elsewhere.
    local = materialize(placed.mapInPandas(running, schema))
    parts = local.groupBy(*groups, "part").agg(F.sum(count).alias("here"))
    before = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*groups, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"), F.sum("here").over(Window.partitionBy(*groups)).alias("total"))
    joined = local.join(offsets, [*groups, "part"])
    return joined.select(*values.columns, (F.col("below") + F.col("offset")).alias("below"), "total")


def _long(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each statistic: the kept columns, stat (its number) and value."""
    names = (*STATISTICS, *FURTHER)
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(s).alias("value")) for i, s in enumerate(names)]))
    return rows.select(*keep, listed.alias("x")).select(*keep, "x.stat", "x.value")


def tail_probabilities(different: DataFrame) -> DataFrame:
    """(scope, stat, value, l, r, a): negative logarithms of the left, right and skew-chosen tails of each value.

    ``different`` has one row per text and ``scope``: a language, or the empty string for the whole collection.
    """
    values = _long(different, "scope").groupBy("scope", "stat", "value").agg(F.count("*").alias("n"))
    ranks = exact_ranks(values, ["scope", "stat"], "value", "n")
    names = (*STATISTICS, *FURTHER)
    skew = different.groupBy("scope").agg(*[F.coalesce(F.skewness(s), F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(names)])
    skew = skew.select("scope", F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(f"s{i}").alias("skew")) for i in range(len(names))])).alias("x")).select("scope", "x.stat", "x.skew")
    left = -F.log((F.col("below") + F.col("n")) / F.col("total"))
    right = -F.log((F.col("total") - F.col("below")) / F.col("total"))
    return ranks.join(skew, ["scope", "stat"]).select("scope", "stat", "value", left.alias("l"), right.alias("r"), F.when(F.col("skew") < 0, left).otherwise(right).alias("a"))


def fit_directions(tails: np.ndarray, kinds: np.ndarray, steps: int = FIT_STEPS, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (tails x kinds) and offsets of the directions: a multinomial logistic fit, kinds balanced by root of count."""
    n, width = tails.shape
    if not n:
        return np.zeros((width, len(KINDS))), np.eye(len(KINDS))[0]
    mean, spread_ = tails.mean(axis=0), tails.std(axis=0) + 1e-6
    x = np.column_stack([(tails - mean) / spread_, np.ones(n)])
    goal = np.eye(len(KINDS))[kinds]
    weight = 1 / np.sqrt(np.maximum(1, np.bincount(kinds, minlength=len(KINDS))))[kinds]
    weight /= weight.mean()
    w = np.zeros((width + 1, len(KINDS)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        share = x @ w
        share = np.exp(share - share.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        slope = x.T @ ((share - goal) * weight[:, None]) / n + shrink * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    scaled = w[:-1] / spread_[:, None]
    return scaled, w[-1] - mean @ scaled


def _fitted(different: DataFrame, tails: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The directions, from the texts of least hash among those that the grammar is clear about."""
    shares = [F.col(f"{kind}_lines") for kind in KINDS[1:]]
    most = F.greatest(*shares)
    label = F.when(most <= 1 - CLEAR, 0).otherwise(F.array_position(F.array(*shares), most).cast("int"))
    clear = different.where((F.col("n_chars") >= LEAST_CHARS) & ((most >= CLEAR) | (most <= 1 - CLEAR))).dropDuplicates(["h"])
    sample = clear.withColumn("label", label).orderBy("h").limit(SAMPLE_TEXTS)
    rows = _long(sample, "h", "scope", "label").join(tails, ["scope", "stat", "value"]).groupBy("h", "label").agg(F.array_sort(F.collect_list(F.struct("stat", "l", "r"))).alias("x"))
    table = rows.select("h", "label", F.flatten(F.transform("x", lambda x: F.array(x["l"], x["r"]))).alias("x")).toPandas().sort_values("h")
    width = 2 * len(STATISTICS + FURTHER)
    return fit_directions(np.array(table["x"].tolist(), dtype=float).reshape(-1, width), table["label"].to_numpy(dtype=int))


def assess(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, lang, n_chars, the five statistics, ``outlier_score`` and ``kind`` of every row.

    Rows keep their number. A text of fewer than ``LEAST_CHARS`` characters is ``prose``. Copies count once in all ranks,
    so that no number of them makes a text usual. An empty table gives no rows.
    """
    names = (*STATISTICS, *FURTHER)
    stats = materialize(document_statistics(df, key, text, lang).withColumn("rid", F.monotonically_increasing_id()))
    texts = stats.where("n_chars > 0").dropDuplicates(["lang", "h"])
    thick = texts.where("lang != 'und'").groupBy("lang").agg(F.count("*").alias("texts")).where(F.col("texts") >= THIN_TEXTS).select("lang", F.col("lang").alias("own"))
    scoped = materialize(stats.join(F.broadcast(thick), "lang", "left").withColumn("scope", F.coalesce("own", F.lit(""))).drop("own"))
    different = scoped.where("n_chars > 0").dropDuplicates(["lang", "h"])
    pooled = scoped.where("n_chars > 0").dropDuplicates(["h"]).withColumn("scope", F.lit(""))
    tails = materialize(tail_probabilities(pooled.unionByName(different.where("scope != ''"))))
    weights, offsets = _fitted(different, tails)
    along = [F.col("l") * F.element_at(F.array(*map(F.lit, weights[0::2, k].tolist())), F.col("stat") + 1) + F.col("r") * F.element_at(F.array(*map(F.lit, weights[1::2, k].tolist())), F.col("stat") + 1) for k in range(len(KINDS))]
    shares = tails.select("scope", "stat", "value", "l", "r", "a", *[c.alias(f"k{k}") for k, c in enumerate(along)])
    known = F.broadcast(shares) if small_enough(shares, BROADCAST_ROWS) else shares
    # The rows of one text lie in one task, where they are summed before the shuffle.
    keep = ("rid", "key", "lang", "n_chars", *STATISTICS)
    sums = _long(scoped.withColumns({s: F.col(s) for s in names}), *keep, "scope").join(known, ["scope", "stat", "value"], "left")
    sums = sums.groupBy(*keep).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"sum_{c}") for c in ("l", "r", "a", *(f"k{k}" for k in range(len(KINDS))))])
    heights = [F.col(f"sum_k{k}") + F.lit(float(offsets[k])) for k in range(len(KINDS))]
    best = F.element_at(F.array(*map(F.lit, KINDS)), F.array_position(F.array(*heights), F.greatest(*heights)).cast("int"))
    kind = F.when(F.col("n_chars") >= LEAST_CHARS, best).otherwise("prose")
    score = F.round(F.greatest("sum_l", "sum_r", "sum_a"), 6)
    return sums.select(F.col("key").alias(key), "lang", "n_chars", F.col("word_count").cast("bigint").alias("word_count"), *STATISTICS[1:], score.alias("outlier_score"), kind.alias("kind"))
