"""Whether a text ends where it was meant to end.

Three answers: ``complete``, ``open`` (in mid-word or mid-sentence, or a JSON payload that is not closed) and
``unsure``: a title, list entry or few words without a full stop. The last are decided by a terminal-context model of
their last word: over all different texts, how often it has something behind it against how often a text stops right
after it. Half a word is seen at the end of texts, a whole one mostly within them; the ratio stays the same however many
texts there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand behind the last sentence, signs that end a sentence, and marks of a cut.
INVISIBLE = "​‌‍⁠﻿­"
CITATION = re.compile(r"\[E\d+(?:\s*[,;]\s*E\d+)*\]$")
STOP = re.compile(r"[.!?。！？]['\"”’»)\]]*$")
CUT_MARK = re.compile(r"(?:\.\.\.|…)['\"”’»)\]]*$|\[[a-zA-Z .…]{0,20}(?:cut|trunc|cont|more|…|\.\.\.)[a-zA-Z .…]{0,20}\]$")
ASIDE = re.compile(r"\([^()\n]*\)$")
SOURCES = re.compile(r"^[^\W\d_]+\s*: *E\d+(?:\s*[,;]\s*E\d+)*$")
CLOSING = re.compile(r"^(?:end of (?:the )?(?:answer|response|text|document)|the end|ende(?: der antwort)?|fin(?: de la r(?:éponse|espuesta))?|fin de la réponse)$", re.IGNORECASE)
LEAD = re.compile(r"^(?:[-*•·–]|\d+[.)]|[a-z][.)]|#+)\s+|^[^\W\d_]+:\s+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", re.UNICODE)
#: Words that a title or list entry may hold, and words that only a running sentence has or that
#: cannot end anything.
JOINING = frozenset("and or for of und oder für von et ou pour de du des y o e para".split())
RUNNING = frozenset(
    "the a an is are was were be been has have had may must shall can could will would should do does did not no never in on at by to from with into"
    " which who whose that this these those it its they their he she when where while until unless if as than so but because both each every any"
    " der die das den dem ein eine einen einem einer ist sind war wird werden wurde muss darf kann soll nicht kein im am zum zur mit auf aus bei nach"
    " le la les un une est sont sera doit peut dans sur par avec au aux ne pas que qui si"
    " el los las una es son será debe puede en con por al no que se si su".split()
)
FEW_WORDS = 5
TITLE_WORDS = 8

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_LEAD_IN = re.compile(r"^\s*(?:[^\n{\[]{0,80}\n\s*)?(?:```[a-zA-Z]*\s*)?(?=[{\[]\s*[\"{\[}\]])")


def payload(text: str) -> str | None:
    """The JSON payload that a text consists of, perhaps in a code fence or behind a lead-in; else None."""
    found = _LEAD_IN.match(text)
    return text[found.end() :] if found else None


def closed(json_text: str) -> bool:
    """Whether the first object or array of a JSON text is closed."""
    bare = _STRING.sub("", json_text)
    if '"' in bare:  # an open string hides whatever follows
        bare = bare[: bare.index('"')]
    depth = 0
    for sign in re.findall(r"[{}\[\]]", bare):
        depth += 1 if sign in "{[" else -1
        if depth == 0:
            return True
    return False


def prose_ending(text: str) -> tuple[str, str | None]:
    """State of a text that is not JSON, and the last word where that has to decide."""
    t = text.strip().strip(INVISIBLE).rstrip()
    if not t:
        return "complete", None
    if CUT_MARK.search(t):
        return "open", None
    if CITATION.search(t) or STOP.search(t) or ASIDE.search(t):
        return "complete", None
    lines = t.split("\n")
    last = lines[-1].strip()
    if len(lines) > 1 and (SOURCES.match(last) or CLOSING.match(last)):
        return "complete", None
    words = WORD.findall(LEAD.sub("", last))
    if not words or not last.endswith(words[-1]):
        # A figure may end few words, anything else that is no letter ends nothing.
        short = len(lines) == 1 and len(words) < FEW_WORDS and t[-1].isdigit() and "[" not in last
        return ("complete" if short else "open"), None
    lower = [w.lower() for w in words]
    titled = len(lines) > 1 and len(words) <= TITLE_WORDS and not RUNNING.intersection(lower)
    if (titled or (len(lines) == 1 and len(words) <= FEW_WORDS and "[" not in last)) and lower[-1] not in JOINING:
        return "unsure", lower[-1]
    return "open", None


def ending(text: str) -> tuple[str, str | None]:
    body = payload(text)
    if body is not None:
        return ("complete" if closed(body) else "open"), None
    return prose_ending(text)


def stopped(text: str) -> bool:
    """Whether a text has terminal punctuation: a closed payload, or a sign that ends a sentence, citation or aside."""
    body = payload(text)
    if body is not None:
        return closed(body)
    t = text.strip().strip(INVISIBLE).rstrip()
    return not CUT_MARK.search(t) and bool(CITATION.search(t) or STOP.search(t) or ASIDE.search(t))


def word_contexts(df: DataFrame, text: str | Column) -> DataFrame:
    """(word, inner, last): how often each word of all different texts has something behind it, and how often a text
    stops right after it."""
    # Words are only begun where no letter is before them and never given back, so that long runs of letters cost no more
    # than their length.
    word = r"(?<![\p{L}'’-])(\p{L}++(?:['’-]\p{L}++)*+)"
    words = F.regexp_extract_all(F.lower("t"), F.lit(word + r"(?=[\s.,;:!?\[\])\"])"), 1)
    end = F.regexp_extract(F.lower("t"), word + r"\s*+$", 1)
    column = F.col(text) if isinstance(text, str) else text
    texts = df.select(column.alias("t")).distinct()
    inner = F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(1).alias("inner"), F.lit(0).alias("last")))
    # The last word of a text with space behind it was taken for an inner one.
    last = F.array(F.struct(end.alias("word"), F.when(F.col("t").rlike("\\s$"), -1).otherwise(0).alias("inner"), F.lit(1).alias("last")))
    each = texts.select(F.explode(F.concat(inner, last)).alias("x")).select("x.*").where("word != ''")
    return each.groupBy("word").agg(F.sum("inner").alias("inner"), F.sum("last").alias("last"))


def settle(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Replaces ``unsure`` in column ``state``: open if texts stop at ``last_word`` more often than they go on."""
    sure = rows.where("state != 'unsure'")
    rest = rows.where("state = 'unsure'").join(contexts, F.col("last_word") == F.col("word"), "left")
    doubt = F.coalesce(F.col("inner"), F.lit(0)) < F.greatest(F.coalesce(F.col("last"), F.lit(0)), F.lit(1))
    rest = rest.withColumn("state", F.when(doubt, "open").otherwise("complete"))
    return sure.unionByName(rest.select(*rows.columns))
