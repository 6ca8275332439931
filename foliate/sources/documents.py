"""Document files: intake, parsing into blocks page by page, JSON and text sinks."""

from __future__ import annotations

import html
import multiprocessing
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings

BLOCKS = "document_id string, page_number int, reading_order_index int, block_id string, block_type string, text string, status string, error string"


def check_options(pages: tuple[int, int] | None, split_pages: bool, timeout: float | None) -> None:
    """Page ranges count from 1 and have a start no later than the end; splitting needs a range and a range splitting."""
    if pages and not 1 <= pages[0] <= pages[1]:
        raise ValueError("a page range starts at 1 or later and ends no earlier than it starts")
    if split_pages != bool(pages):
        raise ValueError("page splitting and a page range need each other")
    if timeout is not None and timeout <= 0:
        raise ValueError("the timeout must be positive")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def accept_files(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``extension`` and ``refusal`` (null if accepted) to files with path and length."""
    ext = extension(F.col("path"))
    refusal = F.when(~F.coalesce(ext.isin(*settings.extensions), F.lit(False)), "unsupported_type").when(F.col("length") > settings.max_bytes, "too_large").when(F.col("length") <= 0, "empty")
    return files.withColumn("extension", ext).withColumn("refusal", refusal)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime and content of all files below a folder; content is read only if it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


class _Blocks(HTMLParser):
    KINDS = {"h1": "section_header", "h2": "section_header", "h3": "section_header", "h4": "section_header", "p": "paragraph", "li": "list_item", "td": "text", "th": "text", "header": "page_header", "footer": "page_footer", "pre": "text"}
    SILENT = {"script", "style", "nav"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.kind, self.parts, self.silent = "text", [], 0

    def _end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((self.kind, text))
        self.kind, self.parts = "text", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.KINDS:
            self._end()
            self.kind = self.KINDS[tag]

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in self.KINDS:
            self._end()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def parse_html(page: str) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(page)
    parser._end()
    return parser.out


def parse_text(page: str) -> list[tuple[str, str]]:
    out = []
    for part in re.split(r"\n\s*\n", page):
        text = part.strip()
        if text:
            kind = "section_header" if re.match(r"#+ |\d+(\.\d+)*\.? [A-Z].{0,80}$", text) and "\n" not in text else "list_item" if re.match(r"[-*•] ", text) else "paragraph"
            out.append((kind, html.unescape(text.lstrip("# ") if text.startswith("#") else text)))
    return out


#: The first parser that takes an extension is used.
PARSERS: list[tuple[tuple[str, ...], Callable[[str], list[tuple[str, str]]]]] = [((".html", ".htm"), parse_html), ((".txt", ".md"), parse_text)]


def register_parser(extensions: tuple[str, ...], parser: Callable[[str], list[tuple[str, str]]]) -> None:
    PARSERS.insert(0, (extensions, parser))


def _within(seconds: float | None, work: Callable[[], list]) -> list:
    """The result of ``work``, or TimeoutError; it runs in a process of its own, which is ended when its time is over."""
    if seconds is None:
        return work()
    context = multiprocessing.get_context("fork")
    near, far = context.Pipe(duplex=False)

    def call() -> None:
        try:
            far.send((True, work()))
        except Exception as error:  # noqa: BLE001
            far.send((False, f"{type(error).__name__}: {error}"))

    process = context.Process(target=call, daemon=True)
    process.start()
    far.close()
    try:
        if not near.poll(seconds):
            raise TimeoutError("page timed out")
        done, out = near.recv()
    except EOFError:
        raise RuntimeError("the parser ended without a result") from None
    finally:
        process.kill()
        process.join()
        near.close()
    if not done:
        raise RuntimeError(out)
    return out


def parse_files(files: DataFrame, pages: tuple[int, int] | None = None, timeout: float | None = None) -> DataFrame:
    """Blocks of all files with path and content; pages are cut at form feeds.

    A page that fails or takes too long gives one row with status ``failed`` and its error, and no task fails for it.
    A file that no parser takes gives one such row for page 0.
    """
    check_options(pages, bool(pages), timeout)
    parsers = list(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                stem, _, ext = path.rsplit("/", 1)[-1].rpartition(".")
                parser = next((p for kinds, p in parsers if f".{ext.lower()}" in kinds), None)
                if parser is None:
                    rows.append((stem, 0, None, None, None, None, "failed", "no parser takes this file"))
                    continue
                for number, page in enumerate(bytes(content or b"").decode("utf-8", "replace").split("\f"), 1):
                    if pages and not pages[0] <= number <= pages[1]:
                        continue
                    try:
                        found = _within(timeout, lambda page=page: parser(page))
                        rows += [(stem, number, i, f"page_{number}_texts-{i}", kind, text, "success", None) for i, (kind, text) in enumerate(found)]
                    except Exception as error:  # noqa: BLE001
                        rows.append((stem, number, None, None, None, None, "failed", f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a known schema; a malformed one fails the read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A row as a JSON object a line, in as many files as there are partitions; null fields are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_lines(df: DataFrame, column: str, path: str, *order: str) -> None:
    """One text column as lines; sorted by ``order`` over all files, if given."""
    (df.orderBy(*order) if order else df).select(F.col(column).cast("string")).where(F.col(column).isNotNull()).write.mode("overwrite").text(path)


def write_report(text: str, path: str) -> None:
    """A report that was rendered in the driver, such as a table of metrics."""
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)


def write_catalog(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").parquet(path)
