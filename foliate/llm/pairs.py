"""Broken prompt-response pairs, each with its one defect.

* ``empty``: nothing, space, or a mere placeholder.
* ``copies_question``: the response is compressed with its prompt (and the words that may frame it) as a zstandard
  dictionary, and the prompt with the response. Where both cost next to nothing, each says what the other says; only a
  response with more words of its own than it leaves out of the prompt adds something.
* ``refusal``: phrases of refusing, by dictionary, unless the answer only says that the evidence is missing.
* ``other_language``: function-word dictionaries of both sides disagree clearly.
* ``truncated``: the ending is open (:mod:`.endings`), with the terminal-context model of all responses.

The first that applies in this order is the defect. Saying that evidence is missing and answering in few words are
no defects.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from . import endings

#: Placeholders, after lower-casing and without outer punctuation.
PLACEHOLDERS = frozenset("n/a na null none nil nan undefined tbd todo empty unknown blank placeholder answer no answer k.a keine s.o n.d lorem ipsum".split(" "))
CITATIONS = re.compile(r"\s*\[E\d+(?:\s*[,;]\s*E\d+)*\]")
QUOTED = re.compile(r"[\"“„«][^\"“”„«»]{12,}[\"”“»]")
#: Words that may surround a repeated question without adding anything.
FRAME = frozenset("question the is was answer you asked your ask frage die lautet antwort la réponse est pregunta respuesta es on q a re hello hi dear please hallo bonjour hola".split())
#: Phrases of refusing and of missing evidence.
REFUSING = re.compile(
    r"\bi(?:'m| am) (?:afraid|unable|not (?:able|permitted|allowed|in a position|comfortable))|\bi (?:cannot|can't|can not|won't|will not|must decline|decline|refuse|do not wish|don't wish|would rather not|am unable|have to (?:decline|apologi[sz]e|refuse|pass))"
    r"|\bi'd rather not|\bno comment\b|not something i\b|(?:outside|beyond) (?:of )?what i\b|i must decline|not (?:going to|willing to) (?:answer|discuss)|instead of me\b|against my\b|my (?:guidelines|instructions|rules|polic(?:y|ies)|principles)"
    r"|tut mir leid|(?:darf|kann|möchte|will|werde) ich (?:\w+ ){0,4}?(?:nicht|keine)\b|ich bedau(?:e?re)\b|nicht helfen|nicht beantworten|meine(?:n|r)? (?:richtlinien|vorgaben|regeln)|kein kommentar|mir ist es nicht"
    r"|désolé|je regrette|je ne (?:peux|puis|suis|souhaite|veux|dois)|mes (?:consignes|instructions|règles|directives)|sans commentaire|je préfère ne|m'est (?:interdit|impossible|pas permis)|m'excuse|il m'est"
    r"|lo siento|no puedo|no me (?:está|es)|no estoy|no debo|prefiero no|mis (?:normas|directrices|instrucciones|reglas)|sin comentarios",
    re.IGNORECASE,
)
#: Regret, which only refuses where the speaker speaks of itself.
REGRET = re.compile(r"\b(?:sorry|regrettably|unfortunately|apologi[sz]e|apologies|as an? (?:\w+ )?(?:assistant|model)|leider|entschuldig\w*|malheureusement|pas autorisé|lamento|lamentablemente|desafortunadamente|por desgracia|disculp\w*)\b", re.IGNORECASE)
SELF = re.compile(r"\b(?:i|i'm|i'd|me|my|ich|mir|mich|je|j'|moi|m'|yo|me|mi)\b", re.IGNORECASE)
MISSING = re.compile(
    r"\bevidence\b|\bpassages?\b|\bexcerpts?\b|\bextracts? (?:do|does|supplied|provided|given)|no information|not enough information|document(?:s)? (?:do|does|give|gives|provide|contain)|stays open|(?:not|n't) (?:state|mention|stated|mentioned|specified|contain)"
    r"|\bauszüge|keine angabe|geht .{0,40}nicht hervor|nicht genannt|unterlagen|textstellen|belege (?:enthalten|reichen)"
    r"|\bextraits|ne (?:le|la|l'|les)? ?(?:précis|mentionn|indiqu)|aucune information|passages fournis"
    r"|fragmentos|no (?:lo|la|se) (?:indica|menciona|especifica)|ninguna información|pasajes",
    re.IGNORECASE,
)
#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is are was for on with by at from that which this it be been has have had must may can will should shall not no what who how where when does do if each every an a or as between before after than their they its within under is expected needs without during both never".split(),
    "de": "der die das und zu den dem des ein eine einen einem einer ist sind wird werden wurde nicht mit auf für von im in bei nach aus muss darf kann als auch oder wer wie wann wo welche welcher welches ohne sich es gilt bis damit danach ob sofern jeder jede jedes mindestens höchstens dazu keine kein zum zur wenn weder noch".split(),
    "fr": "le la les un une des du de et à au aux est sont dans pour par sur avec ne pas que qui ce cette ces il elle se sa son doit peut être si aucun aucune chaque puis après quand combien où quel quelle comment ni sera dont jusqu plus".split(),
    "es": "el la los las un una unos de del y a al es son en para por con no que se su sus este esta lo debe puede ser si ningún ninguna cada tras luego cuando cuándo cuánto quién dónde cómo qué ni será hasta como más según después queda sin".split(),
}
#: The same for languages that are only looked for where their own words stand out.
FURTHER_WORDS = {
    "it": "il lo la gli le un una di del della dei delle che è sono per con non nel nella dal alla al ai si più come anche questo questa deve può essere ogni dopo prima entro senza ha".split(),
    "pt": "o a os as um uma do da dos das em no na nos nas não é são para por com que se ao aos seu sua este esta deve pode ser cada depois antes até sem mais".split(),
    "nl": "de het een van en is zijn wordt worden werd niet met op voor in bij naar uit moet mag kan als ook of wie hoe wanneer waar welke zonder dat dit deze na tot elk geen".split(),
}
#: Scripts that are languages apart.
SCRIPTS = {"cyrillic": re.compile("[Ѐ-ӿ]"), "greek": re.compile("[Ͱ-Ͽ]"), "arabic": re.compile("[؀-ۿ]"), "hebrew": re.compile("[֐-׿]"), "devanagari": re.compile("[ऀ-ॿ]"), "japanese": re.compile("[぀-ヿ]"), "korean": re.compile("[가-힯]"), "chinese": re.compile("[一-鿿]")}
SIGNS = {"de": "äöüß", "fr": "çèêëœàùîï", "es": "ñ¿¡áíóú"}


def _weights(dictionaries: dict[str, list[str]]) -> dict[str, dict[str, float]]:
    """The languages of each word; a word of several counts for each in part."""
    out: dict[str, dict[str, float]] = {}
    for name, words in dictionaries.items():
        for word in words:
            out.setdefault(word, {})[name] = 1.0
    return {word: dict.fromkeys(names, 1.0 / len(names)) for word, names in out.items()}


_WEIGHT = _weights(FUNCTION_WORDS)
_WIDE_WEIGHT = _weights(FUNCTION_WORDS | FURTHER_WORDS)
LETTERS = re.compile(r"[^\W\d_]+")
CODES = re.compile(r"\b[A-Z]{2,}(?:-[A-Z]+)*-\d+\b")

#: A response repeats its prompt if its bytes beyond the prompt are at most this share of it, and the bytes of the prompt
#: beyond the response at most that.
COPY_SHARE = 0.4
ASKED_SHARE = 0.5
LEVEL = 3
WORDS = re.compile(r"\w+")
_FRAMING = " ".join(sorted(FRAME))


def _clear(words: list[str], lower: str, weights: dict[str, dict[str, float]], names: list[str]) -> str | None:
    score = dict.fromkeys(names, 0.0)
    for word in words:
        for name, weight in weights.get(word, {}).items():
            score[name] += weight
    for name, signs in SIGNS.items():
        score[name] += min(2.0, 0.5 * sum(lower.count(s) for s in signs))
    best, second = sorted(score, key=score.get, reverse=True)[:2]
    return best if score[best] >= 1.2 and score[best] >= 1.6 * score[second] + 0.3 and score[best] >= 0.12 * len(words) else None


def language(text: str) -> str | None:
    """The language of a text, or its script, where function words and letters say so clearly."""
    lower = CODES.sub(" ", text).lower()
    words = LETTERS.findall(lower)
    letters = sum(map(len, words))
    for name, pattern in SCRIPTS.items():
        share = len(pattern.findall(lower))
        if letters and share >= (0.1 if name == "japanese" else 0.5) * letters:
            return name
    wide = _clear(words, lower, _WIDE_WEIGHT, [*FUNCTION_WORDS, *FURTHER_WORDS])
    return wide if wide in FURTHER_WORDS else _clear(words, lower, _WEIGHT, list(FUNCTION_WORDS))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = answer.strip().strip(endings.INVISIBLE).strip()
    core = re.sub(r"^[\W_]+|[\W_]+$", "", CITATIONS.sub("", t)).lower()
    if not core:
        return True
    return core in PLACEHOLDERS and not CITATIONS.search(t)


def extra_share(known: str, text: str) -> float:
    """Compressed bytes of a text, with what is known as dictionary, for each of its own bytes."""
    q, a = (" ".join(WORDS.findall(t.lower())).encode() for t in (known, text))
    if len(q) < 8 or not a:
        return 1.0
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    frame = 9  # magic number, header and block header
    return max(0, len(packer.compress(a)) - frame) / len(a)


def adds(question: str, answer: str) -> bool:
    """Whether more words of an answer are new than words of the question are left out: those are not mere alterations."""
    asked, said = (Counter(w for w in WORDS.findall(t.lower()) if w not in FRAME) for t in (question, answer))
    new = sum(n for w, n in said.items() if w not in asked)
    return new > sum((asked - said).values())


def copies(question: str, answer: str) -> bool:
    """Whether the answer repeats the question, perhaps slightly altered, and adds nothing."""
    answer = CITATIONS.sub("", answer)
    if extra_share(answer, question) > ASKED_SHARE or extra_share(f"{_FRAMING} {question}", answer) > COPY_SHARE:
        return False
    return not adds(question, answer)


def refuses(answer: str) -> bool:
    bare = QUOTED.sub(" ", CITATIONS.sub("", answer))
    if MISSING.search(bare):
        return False
    return bool(REFUSING.search(bare) or (REGRET.search(bare) and SELF.search(bare)))


def in_other_language(question: str, answer: str) -> bool:
    bare = CITATIONS.sub(" ", answer)
    outside = QUOTED.sub(" ", bare.replace(question.strip(), " "))
    if len(LETTERS.findall(outside)) < 4:
        outside = bare
    asked, said = language(question), language(outside)
    return asked is not None and said is not None and asked != said


def judge(question: str | None, answer: str | None) -> tuple[str | None, str, str | None]:
    """Defect apart from truncation, state of the ending and its last word."""
    question = question or ""
    if is_empty(answer):
        return "empty", "complete", None
    if copies(question, answer):
        return "copies_question", "complete", None
    if refuses(answer):
        return "refusal", "complete", None
    if in_other_language(question, answer):
        return "other_language", "complete", None
    return (None, *endings.prose_ending(answer))


def find_defects(pairs: DataFrame, key: str = "request_id", question: str = "question", answer: str = "answer_text") -> DataFrame:
    """(``key``, defect) of every pair that has one; a key has one row.

    Null questions are empty ones; null answers are defective. Repeated rows of a key count once. Other columns,
    whatever their names, are ignored.
    """
    rows = pairs.select(F.col(key).alias("k"), F.struct(F.col(question).alias("q"), F.col(answer).alias("a")).alias("r"))
    rows = rows.groupBy("k").agg(F.min("r").alias("r")).select("k", "r.q", "r.a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([judge(q, a) for q, a in zip(frame["q"], frame["a"], strict=True)], columns=["defect", "state", "last_word"])
            out.insert(0, "k", frame["k"].to_numpy())
            yield out

    judged = materialize(rows.mapInPandas(run, "k string, defect string, state string, last_word string"))
    settled = endings.settle(judged, endings.word_contexts(pairs, answer))
    defect = F.coalesce("defect", F.when(F.col("state") == "open", F.lit("truncated")))
    return settled.select(F.col("k").alias(key), defect.alias("defect")).where("defect IS NOT NULL")
