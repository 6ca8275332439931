"""Repair of text from scanned pages: broken words, misread characters, running headers and page numbers.

1. Words of all records are counted; those at broken line ends, and what they may join to, are listed without a count.
   Every rare word is looked up among the frequent ones by anagram hash: the hash of a word is a sum over its
   characters (modulo 2^63, so that it fits however long the word is), reading ``m`` as ``rn`` always changes it by the
   same amount, and a rare word meets its variants in one SQL join on hash plus difference. The meeting words are
   checked character by character and ranked by frequency.
2. Edge lines: a line of a document that is the same, apart from the page's number and misreadings, on at least three
   pages and stands alone on one of them is its running header. A line that holds nothing but the number of its page
   is a page number.
3. Hyphen evidence: a break at a line end is closed if the joined word is known, or if its halves are not; a
   compound of known words keeps its hyphen. Edge lines between the halves are skipped.
4. What is left is joined into paragraphs.

The words found reach the texts as a broadcast while they take at most ``VOCABULARY_BYTES``; beyond that, each text
lists its words, which are joined to the vocabulary and come back to it. Both ways give the same result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache
from itertools import combinations, pairwise

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize, small_enough, written

#: What a scan makes of letters (read, meant).
CONFUSIONS = [
    ("€", "e"), ("†", "t"), ("@", "a"), ("!", "i"), ("|", "l"), ("|", "i"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("$", "s"), ("3", "e"), ("4", "a"), ("7", "t"),
    ("c", "e"), ("rn", "m"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("vv", "w"), ("cl", "d"),
]
SIGNS = "€†@!|$"
HYPHENS = "-­¬‐‑"
TOKEN = re.compile(rf"[^\W_{re.escape(SIGNS)}](?:[^\W_]|[{re.escape(SIGNS)}])*|[{re.escape(SIGNS)}](?=[^\W\d_])(?:[^\W_]|[{re.escape(SIGNS)}])+")
ASCII_TOKEN = re.compile(r"[A-Za-z0-9]+")
BROKEN = re.compile(rf"([^\W_](?:[^\W_]|[{re.escape(SIGNS)}])*)[ ]?[{HYPHENS}][ \t]*$")
_HYPHENS = frozenset(HYPHENS)
BREAK = re.compile(rf"[{HYPHENS}][ \t]*\n")
FIRST = re.compile(rf"^\s*((?:[^\W_]|[{re.escape(SIGNS)}])+)")
CODE = re.compile(r"^[A-Z]+\d+$")
#: Figures with a letter among them; a capital in front of whole figures is a code.
NUMBER_MISREAD = re.compile(r"(?<![\w.,-])(?=[lIOoSB|.,]*\d)(?=[\d.,]*[lIOoSB|])(?![A-Z]\d+(?![\w.,]|[.,]\d))[\dlIOoSB|]+(?:[.,][\dlIOoSB|]+)*(?![\w-])")
PAGE_LINE = re.compile(r"^[\s\-–—|\[(]*(?:(?:pages?|pag\.?|p\.?|seite|s\.|página|pág\.?)\s*)?[\s\[(]*(\d{1,6})[\s\])]*(?:(?:of|/|von|sur|de)\s*\d{1,6})?[\s\-–—|\])]*$", re.IGNORECASE)
PAGE_HINT = re.compile(r"\d[^A-Za-z]*$|^[^A-Za-z]*[ivxlc]{1,8}[^A-Za-z]*$")
ROMAN_LINE = re.compile(r"^[\s\-–—|\[(]*([ivxlc]+)[\s\-–—|\])]*$")
NUMBER_HINT = re.compile(r"\d(?:[.,]?[lIOoSB|]|(?<=[lIOoSB|]\d)|(?<=[lIOoSB|][.,]\d))")
HEADER_PAGES = 3
#: A frequent word is at least so many times as frequent as a misreading of it; fewer suffice if signs or digits
#: stand among its letters.
RATIO = 12
RATIO_SIGNS = 3
KNOWN_LEAST = 3
BROADCAST_ROWS = 400_000
VOCABULARY_BYTES = 64_000_000
#: Known words that are sent in any case, so that only rarer ones have to be joined to large vocabularies.
FREQUENT_WORDS = 100_000
COUNTER_WORDS = 300_000
#: Cells that a task remembers, and the longest of them.
REMEMBERED_CELLS, CELL_CHARACTERS = 100_000, 80


def is_plain(text: str) -> bool:
    """ASCII without the signs that a scan puts between letters."""
    return text.isascii() and "!" not in text and "|" not in text and "@" not in text and "$" not in text


def tokens(text: str) -> list[str]:
    """Words with what a scan may have put between their letters; plain words are found by a plain pattern."""
    return ASCII_TOKEN.findall(text) if is_plain(text) else TOKEN.findall(text)


def broken_end(line: str) -> re.Match | None:
    """The word that a hyphen breaks at the end of a line."""
    return BROKEN.search(line) if line.rstrip(" \t")[-1:] in _HYPHENS else None


MODULUS = 1 << 63


@lru_cache(maxsize=100_000)
def character_value(char: str) -> int:
    return pow(ord(char), 5, 2**56)


def anagram_hash(word: str) -> int:
    """Sum over the characters: equal for anagrams, and changed by a fixed difference by each confusion."""
    return sum(map(character_value, word)) % MODULUS


DIFFERENCES = {(read, meant): (anagram_hash(meant) - anagram_hash(read)) % MODULUS for read, meant in CONFUSIONS}


_FRONT = re.compile(r"(\d+) *[|:.–—-]* +(.*)$")
_BACK = re.compile(r"(.*?) *[|–—-]* +(\d+)$")
#: Each character as what all its readings share, so that a letter and the letters it is read as come out alike. Signs
#: for signs are exchanged at once, which is fast in ASCII; letters that stand for two are replaced before.
_PLAIN = str.maketrans({"€": "e", "c": "e", "†": "t", "@": "a", "!": "i", "|": "i", "1": "i", "l": "i", "0": "o", "5": "s", "6": "b", "8": "b", "9": "g", "$": "s", "3": "e", "4": "a", "7": "t"})
#: The same for ASCII, as a table of bytes, with blanks for the marks that are no reading of a letter.
_ASCII_PLAIN = bytes(ord(_PLAIN.get(i, chr(i) if chr(i).isalnum() else " ")) if i < 128 else i for i in range(256))
_NO_LETTER = bytes(i for i in range(128) if not chr(i).isalnum())
_OTHER = re.compile(r"[\W_]+")
_TWO_LETTERS = re.compile(r"[^\W\d_]{2}")


def skeleton(line: str, pages: list[int]) -> str:
    """A line without case, space, the number of its page at either end, and differences that a scan makes."""
    text = line.strip().lower()
    if text[:1].isdigit() or text[-1:].isdigit():
        text = " ".join(text.split())
        if text[0].isdigit() and (found := _FRONT.match(text)) and int(found.group(1)) in pages:
            text = found.group(2)
        elif text[-1].isdigit() and (found := _BACK.match(text)) and int(found.group(2)) in pages:
            text = found.group(1)
    text = text.replace("m", "rri").replace("n", "ri").replace("h", "ii").replace("u", "ii").replace("w", "vv").replace("d", "ei")
    return b" ".join(text.encode().translate(_ASCII_PLAIN).split()).decode() if text.isascii() else _OTHER.sub(" ", text.translate(_PLAIN)).strip()


def _line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _edge_lines(text: str, page: int | None) -> Iterator[tuple[int, int]]:
    """(hash, weight) of the lines of a block that may be running headers: twice the length of the skeleton, and one more
    if the line stands alone."""
    if page is None:
        return
    lines = text.split("\n")
    for line in lines:
        s = line.strip()
        if s and s[-1] not in ".,;:?!":
            bare = skeleton(s, [page])
            if " " in bare:
                yield _line_hash(bare), 2 * len(bare) + int(len(lines) == 1)


def _halves(lines: list[str]) -> Iterator[tuple[int, re.Match, list[int]]]:
    """Broken lines, with the lines that may hold the other half: the next three, and the next one at any distance that
    goes on in small letters (in capitals, if the half is in capitals)."""
    low = caps = None
    after: list[tuple[int | None, int | None]] = [(None, None)] * len(lines)
    for at in range(len(lines) - 1, -1, -1):
        after[at] = (low, caps)
        first = FIRST.match(lines[at])
        if first and any(map(str.isalpha, first.group(1))):
            if first.group(1)[0].isupper():
                caps = at if first.group(1).isupper() else caps
            else:
                low = at
    for at, line in enumerate(lines[:-1]):
        broken = broken_end(line)
        if broken:
            far = after[at][1 if broken.group(1).isupper() and len(broken.group(1)) > 1 else 0]
            yield at, broken, [*range(at + 1, min(at + 4, len(lines))), *([far] if far is not None and far > at + 3 else [])]


def _possible_words(lines: list[str]) -> Iterator[str]:
    """Halves of broken words and what they may join to, over all lines and over those without space and figures."""
    worded = list(filter(_TWO_LETTERS.search, lines))
    for part in (lines, worded) if len(worded) < len(lines) else (lines,):
        for _, broken, follow in _halves(part):
            yield broken.group(1)
            for at in follow:
                first = FIRST.match(part[at])
                if first:
                    yield first.group(1)
                    yield broken.group(1) + first.group(1)


def _strings(column: pa.Array) -> list[str | None]:
    """The values of a column of strings, several times as fast as ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _numbers(column: pa.Array) -> list[int | None]:
    return column.to_pandas(integer_object_nulls=True).tolist()


def _lists(column: pa.ListArray) -> list[list[int | None]]:
    """The values of a column of lists of numbers; empty for null."""
    values = _numbers(column.values)
    return [values[a:b] for a, b in pairwise(column.offsets.to_numpy().tolist())]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (tag w: word, n) and of possible header lines (tag h: document, hash, page, alone)."""
    counts: Counter = Counter()
    pieces: Counter = Counter()
    edges: dict[tuple, int] = {}
    for batch in batches:
        whole: list[str] = []
        for document, page, text in zip(_strings(batch.column(0)), _numbers(batch.column(1)), _strings(batch.column(2)), strict=True):
            if document is not None:
                for hashed, alone in _edge_lines(text, page):
                    key = (document, hashed, page)
                    edges[key] = max(alone, edges.get(key, 0))
            if "\n" in text and BREAK.search(text):
                lines = text.split("\n")
                broken = False
                for line in lines:
                    after, broken = broken, bool(broken_end(line))
                    if after or broken:
                        words = tokens(line)[after:]
                        counts.update(words[:-1] if broken else words)
                    else:
                        whole.append(line)
                for word in _possible_words(lines):
                    counts[word] += 0
            else:
                whole.append(text)
        # No token holds space, so that what is not broken is counted by pieces between spaces.
        pieces.update(" ".join(whole).split())
        if len(counts) + len(pieces) + len(edges) > COUNTER_WORDS:
            yield _flushed(counts, pieces, edges)
    if counts or pieces or edges:
        yield _flushed(counts, pieces, edges)


def _flushed(counts: Counter, pieces: Counter, edges: dict[tuple, int]) -> pa.RecordBatch:
    for piece, n in pieces.items():
        for word in tokens(piece):
            counts[word] += n
    folded: Counter = Counter()
    for word, n in counts.items():
        if not (CODE.match(word) or word.isdigit()):
            folded[word.lower().rstrip("!")] += n
    w, e = len(folded), len(edges)
    columns = [
        pa.array(["w"] * w + ["h"] * e),
        pa.array([*folded, *(k[0] for k in edges)], pa.string()),
        pa.array([0] * w + [k[1] for k in edges], pa.int64()),
        pa.array([0] * w + [k[2] for k in edges], pa.int32()),
        pa.array([*folded.values(), *edges.values()], pa.int64()),
    ]
    counts.clear()
    pieces.clear()
    edges.clear()
    return pa.RecordBatch.from_arrays(columns, names=["tag", "k", "h", "page", "n"])


def survey(records: DataFrame) -> DataFrame:
    """Words and possible header lines of (kind, document_id, pages, text), counted in one pass; written once.

    A document of any size is only aggregated: by line and page here, by line in :func:`running_headers`.
    """
    rows = records.select(F.when(F.col("kind") == "block", F.col("document_id")).alias("d"), F.when(F.col("kind") == "block", F.col("pages")[0]).alias("p"), "text")
    return materialize(rows.mapInArrow(_count, "tag string, k string, h bigint, page int, n bigint").groupBy("tag", "k", "h", "page").agg(F.when(F.col("tag") == "w", F.sum("n")).otherwise(F.max("n")).alias("n")))


def running_headers(counted: DataFrame) -> DataFrame:
    """(document_id, headers, longest): hashes of the running header lines of each document that has any, and the length of
    the longest skeleton."""
    lines = counted.where("tag = 'h'").groupBy(F.col("k").alias("document_id"), "h").agg(F.count("*").alias("pages"), F.max("n").alias("weight"))
    return lines.where((F.col("pages") >= HEADER_PAGES) & (F.col("weight") % 2 == 1)).groupBy("document_id").agg(F.collect_set("h").alias("headers"), F.max(F.expr("weight div 2")).cast("int").alias("longest"))


def _sites(word: str) -> list[tuple[int, str, str]]:
    return [(at, read, meant) for read, meant in CONFUSIONS for at in (m.start() for m in re.finditer(re.escape(read), word))]


def _variants(word: str) -> set[str]:
    """Words that up to two confusions could have turned into this one, three if they are signs or digits."""
    sites = _sites(word)
    signs = [s for s in sites if not s[1].isalpha()]
    out = set()
    for n in (1, 2, 3):
        for chosen in combinations(sites if n < 3 else signs, n):
            spots = sorted(chosen)
            if any(a[0] + len(a[1]) > b[0] for a, b in zip(spots, spots[1:], strict=False)):
                continue
            text = word
            for at, read, meant in reversed(spots):
                text = text[:at] + meant + text[at + len(read) :]
            out.add(text)
    return out


def _misread_as(word: str, meant: str) -> bool:
    """Whether ``meant`` is one of the :func:`_variants` of ``word``, found without listing them."""
    todo, seen = [(0, 0, 0, 0)], set()
    while todo:
        state = i, j, letters, signs = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        if i == len(word) and j == len(meant) and letters + signs:
            return True
        if i < len(word) and j < len(meant) and word[i] == meant[j]:
            todo.append((i + 1, j + 1, letters, signs))
        for read, right in CONFUSIONS:
            if word.startswith(read, i) and meant.startswith(right, j):
                more = (letters + 1, signs) if read.isalpha() else (letters, signs + 1)
                if sum(more) <= (2 if more[0] else 3):
                    todo.append((i + len(read), j + len(right), *more))
    return False


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anagram-hash keys of the words that may be misread: own hash plus the differences of possible confusions."""
    for frame in frames:
        rows = []
        for word, n in zip(frame["word"], frame["n"], strict=True):
            own = anagram_hash(word)
            # Where a confusion stands does not change the hash, so that three of each kind do for any word.
            sites = [kind for kind, times in Counter(s[1:] for s in _sites(word)).items() for _ in range(min(times, 3))]
            keys = {(own + DIFFERENCES[kind]) % MODULUS for kind in sites}
            keys |= {(own + DIFFERENCES[one] + DIFFERENCES[two]) % MODULUS for one, two in combinations(sites, 2)}
            keys |= {(own + sum(map(DIFFERENCES.get, three))) % MODULUS for three in combinations([s for s in sites if not s[0].isalpha()], 3)}
            rows += [(word, n, key) for key in keys]
        yield pd.DataFrame(rows, columns=["word", "n", "key"])


def corrections(words: DataFrame) -> DataFrame:
    """(word, meant) of the misread words among (word, n); ``meant`` is null where no frequent word fits.

    Candidates are joined to frequent words on the anagram hash, checked, and ranked by frequency.
    """
    letters = words.where(F.col("word").rlike(r"^\p{L}+$"))
    frequent = letters.where(F.col("n") >= KNOWN_LEAST).mapInPandas(lambda frames: (f.assign(key=[anagram_hash(w) for w in f["word"]]) for f in frames), "word string, n bigint, key bigint")
    signed = F.col("word").rlike(r"[€†@!|$\d]")
    doubtful = words.where((F.length("word") >= 3) & F.col("word").rlike(r"\p{L}.*\p{L}") & F.col("word").rlike(r"[€†@!|$0-9c]|rn|ii|li|ri|vv|cl"))
    keyed = doubtful.mapInPandas(_keys, "word string, n bigint, key bigint")
    met = keyed.join(frequent.select(F.col("word").alias("meant"), F.col("n").alias("m"), "key"), "key")
    # A word that is hardly seen at all needs no more than a known one to be taken for it.
    rare = (F.col("n") < KNOWN_LEAST) & (F.length("word") > 3)
    met = met.where(rare | (F.col("m") >= F.when(signed, RATIO_SIGNS * F.col("n")).otherwise(RATIO * F.col("n"))))

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = [_misread_as(word, meant) for word, meant in zip(frame["word"], frame["meant"], strict=True)]
            yield frame.loc[fits, ["word", "meant", "m"]]

    checked = met.select("word", "meant", "m").mapInPandas(check, "word string, meant string, m bigint")
    best = checked.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("m"), "meant"))).where("r = 1").select("word", "meant")
    # Signs between letters are misread whatever the word, as in names.
    odd = words.where(F.col("word").rlike(r"\p{L}[€†@!|$]\p{L}|^[€†@!|$]\p{L}{3}|\p{L}{3}[€†@]$|\p{Ll}{2}[01569]\p{Ll}{2}") & ~F.col("word").rlike(r"@.*\."))
    rest = odd.select("word").join(best, "word", "left_anti").select("word", F.lit(None).cast("string").alias("meant"))
    return best.unionByName(rest.distinct())


def _fix_number(word: str) -> str:
    return word.translate(str.maketrans("lI|OoSB", "1110058"))


def roman(text: str) -> int | None:
    """The number that a lower-case roman numeral writes."""
    if not re.fullmatch(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", text) or not text:
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0], strict=True))


class _Readings(dict):
    """Token to what it should read (empty if it is right); fills itself."""

    def __init__(self, repairer: Repairer) -> None:
        super().__init__()
        self.repairer = repairer

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[token] = self.repairer.read(token) or ""
        return self[token]


class _Doubts(dict):
    """Text between spaces to whether anything in it is misread; fills itself."""

    def __init__(self, readings: _Readings) -> None:
        super().__init__()
        self.readings = readings

    def __missing__(self, piece: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[piece] = any(map(self.readings.__getitem__, tokens(piece))) or NUMBER_HINT.search(piece) is not None
        return self[piece]


class Repairer:
    def __init__(self, misread: dict[str, str | None], known: Container[str]) -> None:
        self.misread, self.known = misread, known
        self.readings = _Readings(self)
        self.doubts = _Doubts(self.readings)

    def whole(self, word: str) -> bool:
        word = word.lower()
        return word in self.known or self.misread.get(word) is not None

    def read(self, token: str) -> str | None:
        """What a token should read, if it is misread."""
        if token.isalpha() and token.lower() in self.known:
            return None
        bare = token.lower().rstrip("!")
        if CODE.match(token) or bare in self.known:
            return None
        if bare not in self.misread:
            return None
        meant = self.misread[bare]
        if meant is None:
            meant = re.sub(f"[{re.escape(SIGNS)}]", lambda m: dict(CONFUSIONS)[m.group()], bare)
        return meant.upper() if token.isupper() and len(token) > 1 else meant.capitalize() if token[0].isupper() else meant

    def repair(self, text: str, pages: list[int], headers: frozenset[int], page_lines: bool, longest: int = 1 << 30) -> tuple[str, list[str]]:
        """Readable text and the kinds of noise found."""
        found: set[str] = set()
        kept = self._without_edges(text.split("\n"), pages, headers, page_lines, longest, found)
        if len(kept) > 1 and BREAK.search(text):
            kept = self._joined(kept, found)
        whole = "\n".join(kept)
        # Neither words nor figures hold space.
        if not any(map(self.doubts.__getitem__, whole.split())):
            return unwrap(kept), sorted(found)
        if any(map(self.readings.__getitem__, tokens(whole))):
            found.add("misread")
            whole = TOKEN.sub(self._fix, whole)
        if NUMBER_HINT.search(whole):

            def figures(match: re.Match) -> str:
                if len(match.group()) < 3:
                    return match.group()
                found.add("misread")
                return _fix_number(match.group())

            whole = NUMBER_MISREAD.sub(figures, whole)
        return unwrap(whole.split("\n")), sorted(found)

    def _without_edges(self, lines: list[str], pages: list[int], headers: frozenset[int], page_lines: bool, longest: int, found: set[str]) -> list[str]:
        kept = []
        if headers:
            # A skeleton is no shorter than the letters and figures of its line, apart from a page number.
            most = longest + max((len(str(p)) for p in pages), default=0)
        elif not page_lines:
            return lines
        for line in lines:
            if headers and (len(line) <= most or len(line.encode().translate(None, _NO_LETTER) if line.isascii() else _OTHER.sub("", line)) <= most) and _line_hash(skeleton(line, pages)) in headers:
                found.add("running_header")
                continue
            # Without the space and marks around it, no page number is as long as 40.
            core = line
            if len(core) >= 40:
                core = core.strip(" \t-–—|[]()")
                if len(core) >= 40 and ("  " in core or "\t" in core):
                    core = " ".join(core.split())
            if page_lines and len(core) < 40 and PAGE_HINT.search(core):
                number = PAGE_LINE.match(core) or ROMAN_LINE.match(core)
                if number and (int(number.group(1)) if number.group(1).isdigit() else roman(number.group(1))) in pages:
                    found.add("page_number")
                    continue
            kept.append(line)
        return kept

    def _joined(self, kept: list[str], found: set[str]) -> list[str]:
        """Lines with words that were broken at their ends put together."""
        out: list[str] = []
        taken: dict[int, int] = {}
        others = {at: follow for at, _, follow in _halves(kept)}
        for at, line in enumerate(kept):
            if at in taken:
                line = line[taken[at] :].lstrip()
            broken = broken_end(line) if at in others else None
            if broken:
                half = broken.group(1)
                for place in others[at]:
                    follow = FIRST.match(kept[place])
                    if not follow or place in taken:
                        continue
                    joined = half + follow.group(1)
                    if self.whole(joined) or (place == at + 1 and self.closes(half, follow.group(1), broken.group(0))):
                        found.add("hyphenation")
                        tail = re.match(r"[.,;:!?)\]\"'”]*", kept[place][follow.end() :])
                        line = line[: broken.start(1)] + joined + tail.group(0)
                        taken[place] = follow.end() + tail.end()
                        break
            out.append(line)
        return out

    def _fix(self, match: re.Match) -> str:
        meant = self.readings[match.group()]
        if not meant:
            return match.group()
        end = re.search(r"!+$", match.group())
        return meant + (end.group() if end else "")

    def closes(self, half: str, other: str, end: str) -> bool:
        """Whether a break without a known joined word is a hyphenation rather than a compound."""
        if not other[0].isalpha() or (half.isdigit() or other.isdigit()):
            return False
        if re.search("[­¬]", end):
            return other[0].islower()
        # Names are often rare; of other unknown words a compound is as likely, and keeps its hyphen.
        return half[0].isupper() and half[1:].islower() and other[0].islower() and half.lower() not in self.known


_BLANKS = re.compile(r"[ \t]+")
_ENTRY = re.compile(r"(?:[-*•·–]|\d+[.)]|[a-z][.)]|\[[ x]\])\s")


def unwrap(lines: list[str]) -> str:
    """Lines that a page width has cut are joined; a line ends a paragraph if it is short or ends a sentence, and a
    list entry begins one."""
    if len(lines) == 1:
        return " ".join(filter(None, re.split(r"[ \t]+", lines[0]))).strip() if "  " in lines[0] or "\t" in lines[0] else lines[0].strip()
    out: list[str] = []
    width = max(map(len, lines), default=0)
    open_before = False
    for line in lines:
        s = (_BLANKS.sub(" ", line) if "  " in line or "\t" in line else line).strip()
        if not s:
            open_before = False
            continue
        if open_before and not _ENTRY.match(s):
            out[-1] += " " + s
        else:
            out.append(s)
        open_before = len(line) >= 0.6 * width and len(lines) > 1 and not (s[-1] in ".!?:" and len(line) < 0.85 * width)
    return "\n".join(out)


def scanned_records(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(kind, document_id, record_id, pages, text) of blocks, native texts and cells that have a text; cells need no pages."""
    block = blocks.select(F.lit("block").alias("kind"), "document_id", F.col("block_id").alias("record_id"), F.array("page_number").alias("pages"), "text")
    pages = F.array_compact(F.array_union(F.coalesce("page_numbers", F.array().cast("array<int>")), F.array("page_number")))
    native = tables.select(F.lit("native_text").alias("kind"), "document_id", F.col("table_id").alias("record_id"), pages.alias("pages"), F.col("native_text").alias("text"))
    cells = tables.select("document_id", F.explode("cells").alias("c")).select(F.lit("cell").alias("kind"), "document_id", F.col("c.cell_id").alias("record_id"), F.array().cast("array<int>").alias("pages"), F.col("c.text").alias("text"))
    return block.unionByName(native).unionByName(cells).where(F.length("text") > 0)


class _Either:
    """Members of either of two sets."""

    def __init__(self, one: Container[str], other: Container[str]) -> None:
        self.one, self.other = one, other

    def __contains__(self, word: object) -> bool:
        return word in self.one or word in self.other


def lookups(text: str) -> set[str]:
    """All words that the repair of a text may ask the vocabulary for."""
    words = set(tokens(text))
    if "\n" in text and BREAK.search(text):
        words.update(_possible_words(text.split("\n")))
        words.update(w for joined in list(words) for w in tokens(joined))
    return {form for w in map(str.lower, words) for form in (w, w.rstrip("!"))}


def _with_words(records: DataFrame, vocabulary: DataFrame, frequent: Broadcast) -> DataFrame:
    """Adds ``words``, an array of (word, meant), of the vocabulary that each text needs beyond the frequent words."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(frequent.value.to_pylist())
        for batch in batches:
            wanted = [sorted(lookups(t) - known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wanted, pa.list_(pa.string()))], names=["rid", "wanted"])

    numbered = written(records.withColumn("rid", F.monotonically_increasing_id()))
    wanted = numbered.select("rid", "text").mapInArrow(listed, "rid bigint, wanted array<string>").select("rid", F.explode("wanted").alias("word"))
    found = wanted.join(vocabulary, "word").groupBy("rid").agg(F.collect_list(F.struct("word", "meant")).alias("words"))
    return numbered.join(found, "rid", "left").drop("rid")


def repair_records(blocks: DataFrame, tables: DataFrame, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(kind, document_id, record_id, clean_text, noise): every block, native text and cell with a text, repaired.

    ``noise`` lists what was found (hyphenation, misread, page_number, running_header). Null and empty texts give no
    rows; repeated rows stay repeated. Texts are shuffled only if the documents with headers exceed ``BROADCAST_ROWS``
    or the vocabulary ``vocabulary_bytes``.
    """
    spark = blocks.sparkSession
    records = scanned_records(blocks, tables)
    counted = survey(records)
    words = counted.where("tag = 'w'").select(F.col("k").alias("word"), "n")
    wrong = materialize(corrections(words))
    known = words.where((F.col("n") >= KNOWN_LEAST) & F.col("word").rlike(r"^\p{L}{2,}$")).join(wrong, "word", "left_anti")
    # A known word stands for itself.
    vocabulary = materialize(wrong.select("word", "meant", F.lit(0).cast("long").alias("n")).unionByName(known.select("word", F.col("word").alias("meant"), "n")))
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("word") + F.coalesce(F.octet_length("meant"), F.lit(0)) + 8), F.lit(0))).first()[0]
    small = size <= vocabulary_bytes
    headers = materialize(running_headers(counted))
    headed = records.join(F.broadcast(headers) if small_enough(headers, BROADCAST_ROWS) else headers, "document_id", "left")
    if small:
        sent = spark.sparkContext.broadcast(vocabulary.select("word", "meant").toArrow().combine_chunks())
    else:
        most = vocabulary.where("n > 0").orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word").toArrow().column(0).combine_chunks()
        sent = spark.sparkContext.broadcast(most)
        headed = _with_words(headed, vocabulary.select("word", "meant"), sent)
    # A null list is dear to send: with each row, Spark fills the offsets again from the last list that is not null.
    edges = F.coalesce(F.when(F.col("kind") != "cell", F.col("headers")), F.array().cast("array<bigint>"))
    headed = headed.select("kind", "document_id", "record_id", "pages", "text", edges.alias("headers"), "longest", *([] if small else [F.coalesce("words", F.array().cast("array<struct<word:string,meant:string>>")).alias("words")]))

    def split(pairs: Iterator[tuple[str, str | None]]) -> tuple[dict[str, str | None], frozenset[str]]:
        pairs = list(pairs)
        return {w: m for w, m in pairs if w != m}, frozenset(w for w, m in pairs if w == m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if small:
            whole = Repairer(*split(zip(*(c.to_pylist() for c in sent.value.columns), strict=True)))
        else:
            frequent = frozenset(sent.value.to_pylist())
        none: frozenset[int] = frozenset()
        cells: dict[str, tuple[str, list[str]]] = {}
        for batch in batches:
            listed = [None] * len(batch) if small else batch.column(7).to_pylist()
            clean, noise = [], []
            for kind, page, body, edge, most, own in zip(_strings(batch.column(0)), _lists(batch.column(3)), _strings(batch.column(4)), _lists(batch.column(5)), _numbers(batch.column(6)), listed, strict=True):
                if kind == "cell" and body in cells:
                    text, found = cells[body]
                    clean.append(text)
                    noise.append(found)
                    continue
                if small:
                    repairer = whole
                else:
                    misread, some = split((w["word"], w["meant"]) for w in own)
                    repairer = Repairer(misread, _Either(frequent, some))
                if kind == "cell":
                    # Nothing but its text decides on a cell, and short ones are often repeated.
                    text, found = repairer.repair(body, [], none, False)
                    if small and len(body) <= CELL_CHARACTERS:
                        if len(cells) >= REMEMBERED_CELLS:
                            cells.clear()
                        cells[body] = text, found
                else:
                    text, found = repairer.repair(body, [p for p in page if p is not None], frozenset(edge) if edge else none, True, most or 0)
                clean.append(text)
                noise.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(clean, pa.string()), pa.array(noise, pa.list_(pa.string()))], names=["kind", "document_id", "record_id", "clean_text", "noise"])

    schema = "kind string, document_id string, record_id string, clean_text string, noise array<string>"
    return headed.mapInArrow(run, schema)
