"""Structured chunking: headings give paths, tables stay whole, long prose is packed with overlap.

A document is a left-to-right fold over its lines, so one document is one unit of work inside a task;
documents are independent and no shuffle is needed. Rows come out of a table function that any DataFrame or
SQL ``LATERAL`` join can use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGET, OVERLAP, LEAST_CHARS, LEAST_WORDS = 800, 150, 60, 5
HEADING = re.compile(r"(#{1,6})\s+(.+)")
RULE = re.compile(r"[=\-_*]{3,}")
SENTENCE = re.compile(r"(?<=[.?!])\s+")


@dataclass
class Section:
    path: str
    text: str
    whole: bool = False  # a table or one of its rows: never split
    copied: bool = False  # its text stands in another section too


@dataclass
class Outline:
    """What has been read so far: open headings, prose lines and table lines not yet given out."""

    heads: list[str] = field(default_factory=list)
    prose: list[str] = field(default_factory=list)
    table: list[str] = field(default_factory=list)

    @property
    def path(self) -> str:
        return " > ".join(self.heads)

    def prose_out(self) -> Iterator[Section]:
        text = "\n".join(self.prose).strip()
        self.prose = []
        if text:
            yield Section(self.path, text)

    def table_out(self) -> Iterator[Section]:
        rows, self.table = self.table, []
        if rows:
            yield Section(self.path, "\n".join(rows).strip(), True)
        if len(rows) > 4:
            base = self.path or "Tabla"
            for i, row in enumerate(rows[2:], 1):
                yield Section(f"{base} > Fila {i}", "\n".join([*rows[:2], row]), True, True)


def line_kind(line: str) -> str:
    s = line.strip()
    if s.startswith("```"):
        return "fence"
    if s[:1] == "|" and s[-1:] == "|":
        return "row"
    if HEADING.fullmatch(s):
        return "head"
    return "rule" if RULE.fullmatch(s) else "text"


def sections(content: str) -> Iterator[Section]:
    """Sections in reading order. Inside a fence nothing is interpreted; a fence does not end a table."""
    o, fenced = Outline(), False
    for line in content.splitlines():
        kind = line_kind(line)
        if kind == "fence" or fenced:
            fenced ^= kind == "fence"
            o.prose.append(line)
            continue
        if kind == "row":
            if not o.table:
                yield from o.prose_out()
            o.table.append(line)
            continue
        yield from o.table_out()
        if kind == "text":
            o.prose.append(line)
            continue
        yield from o.prose_out()
        if kind == "head":
            marks, title = HEADING.fullmatch(line.strip()).groups()
            o.heads = [*o.heads[: len(marks) - 1], title.strip()]  # depth of the stack counts, not the level above
    yield from o.table_out()
    yield from o.prose_out()


def last_sentences(text: str, room: int) -> str:
    """Sentences from the end that together stay below ``room`` characters."""
    tail = ""
    for s in reversed(SENTENCE.split(text)):
        if len(tail) + len(s) >= room:
            break
        tail = f"{s} {tail}".strip()
    return tail


def packed(text: str, size: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed up to ``size``; a full chunk hands its last sentences on. Only a paragraph that meets an empty
    chunk is cut at sentences, so a chunk may be longer than ``size``."""
    out, now = [], ""
    for para in filter(None, map(str.strip, text.split("\n\n"))):
        if len(now) + len(para) + 2 <= size:
            now = f"{now}\n\n{para}" if now else para
        elif now:
            out.append(now)
            tail = last_sentences(now, overlap)
            now = f"{tail}\n\n{para}" if tail else para
        else:
            for s in SENTENCE.split(para):
                if len(now) + len(s) + 1 <= size:
                    now = f"{now} {s}".strip()
                else:
                    out += [now] if now else []
                    now = s
    if now and now not in out[-1:]:
        out.append(now)
    return out


def worth_keeping(text: str, copied: bool) -> bool:
    return len(text) >= LEAST_CHARS or (not copied and len(text.split()) >= LEAST_WORDS)


def chunk(content: str, filename: str) -> Iterator[tuple[str, int, str, str, bool]]:
    """(chunk_id, chunk_index, header_path, text, is_table); a document without any chunk is one chunk if it is not blank."""
    n = 0
    for s in sections(content):
        for text in [s.text] if s.whole or len(s.text) <= TARGET else packed(s.text):
            if worth_keeping(text, s.copied):
                yield f"{filename}_chunk_{n}", n, s.path, f"[{s.path}]\n{text}" if s.path else text, s.whole
                n += 1
    if n == 0 and content.strip():
        yield f"{filename}_chunk_0", 0, "", content.strip(), False


def chunk_documents(docs: DataFrame) -> DataFrame:
    """``docs``: tenant_id, filename, text. One row per chunk with its metadata."""
    key = docs.schema["tenant_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(t, f, *c) for t, f, text in zip(part["tenant_id"], part["filename"], part["text"], strict=True) for c in chunk(text or "", f)]
            yield pd.DataFrame(rows, columns=["tenant_id", "filename", "chunk_id", "chunk_index", "header_path", "text", "is_table"])

    out = docs.select("tenant_id", "filename", "text").mapInPandas(run, f"tenant_id {key}, filename string, chunk_id string, chunk_index int, header_path string, text string, is_table boolean")
    return out.withColumn("char_count", F.length("text"))


def stored_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", F.concat_ws("::", "tenant_id", "chunk_id"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks by id; new ones replace old ones. Only files that ``new`` holds are touched."""
    return store.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def replace_files(store: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Re-ingestion: all old chunks of ``files`` (those in ``new``, if not given) go, whatever their number."""
    files = (new if files is None else files).select("tenant_id", "filename").distinct()
    return store.join(files, ["tenant_id", "filename"], "left_anti").unionByName(new)


def delete_file(store: DataFrame, filename: str, tenant: str) -> DataFrame:
    """Without the chunks whose file name, or its last part, is ``filename`` in any case."""
    aim = [filename.strip().lower(), filename.strip().rsplit("/", 1)[-1].lower()]
    here = F.lower("filename").isin(aim) | F.lower(F.regexp_extract("filename", "([^/]*)$", 1)).isin(aim)
    return store.filter(~((F.col("tenant_id") == tenant) & here))


def lines(docs: DataFrame) -> DataFrame:
    """tenant_id, filename, n, line with running flags: fenced, table row, island of table rows (null outside)."""
    split = docs.select("tenant_id", "filename", F.posexplode(F.split("text", "\\r\\n|\\n|\\r")).alias("n", "line"))
    w = Window.partitionBy("tenant_id", "filename").orderBy("n")
    fence = F.startswith(F.trim("line"), F.lit("```"))
    seen = split.withColumn("is_fence", fence).withColumn("fenced", F.sum(fence.cast("int")).over(w) % 2 == 1)
    row = ~F.col("fenced") & ~F.col("is_fence") & F.startswith(F.trim("line"), F.lit("|")) & F.endswith(F.trim("line"), F.lit("|"))
    flagged = seen.withColumn("is_row", row)
    starts = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False))
    return flagged.withColumn("island", F.when(F.col("is_row"), F.sum(starts.cast("int")).over(w)))
