"""Sinks and readers for results: CSV for spreadsheets, JSON, workbooks, documents, markdown, fragments of pages.

Workbooks, documents and markdown hold result tables of a report and are put together on the driver; CSV and JSON are written
by the tasks.
"""

from __future__ import annotations

import html
import json
import os
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHEN = (1980, 1, 1, 0, 0, 0)
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def write_spreadsheet_csv(frame: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with a byte order mark, which spreadsheets take as UTF-8; for result tables."""
    rows = frame.select(*[F.col(c).cast("string") for c in columns]).toLocalIterator()
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if re.search(r'[",\r\n]', v) else v
    with open(path, "x", encoding="utf-8-sig", newline="") as out:
        out.write(",".join(columns) + "\r\n")
        out.writelines(",".join(quoted(v or "") for v in row) + "\r\n" for row in rows)


def write_jsonl(frame: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).option("ignoreNullFields", "false").json(path)


#: The name that Spark gives to a folder without a value, and what it escapes in those with one.
_NONE, _ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile("[\x00-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
#: Slices of each group's files that tasks read.
SLICES = 32


def _folder(column: str, value: str | None) -> str:
    return f"{column}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else _NONE)


def _local(path: str) -> str | None:
    """The path as the operating system has it; None where it is not a file system that driver and executors mount."""
    at = urlsplit(path)
    return unquote(at.path) if at.scheme == "file" else path if not at.scheme else None


def write_by_file(frame: DataFrame, path: str, *, group: str, name: str, blocks: str) -> None:
    """``<group>/<name>.json`` under a folder: each page's blocks as a JSON list, an empty one where there are none.

    The tasks write them, partitioned by group and name; a page of equal group and name is one file.  Files cost by their
    number, not their bytes, so the number of tasks is fixed (small ones would be put together), and on a mounted folder
    tasks make the files themselves, since Spark's writer starts a process or two for each; elsewhere Spark's writer does it.
    """
    tasks, root = 4 * frame.sparkSession.sparkContext.defaultParallelism, _local(path)
    one = frame.select(group, name, F.to_json(F.coalesce(blocks, F.array().cast("array<string>"))).alias("value"))
    first = F.row_number().over(Window.partitionBy(group, name).orderBy(F.desc(F.length("value")), "value"))
    one = one.withColumn("rn", first).where("rn = 1").select(group, name, "value").repartition(tasks, group, name)
    if root is None:
        one.write.partitionBy(group, name).mode("errorifexists").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    os.makedirs(root)
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"part-{TaskContext.get().partitionId():05d}-{job}.txt"
        for batch in batches:
            for g, n, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = os.path.join(root, _folder(group, g), _folder(name, n))
                os.makedirs(at, exist_ok=True)
                with open(os.path.join(at, file), "w", encoding="utf-8", newline="") as out:
                    out.write(value + "\n")
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    one.select(F.col(group).cast("string"), F.col(name).cast("string"), "value").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    Path(root, "_SUCCESS").touch()


def read_by_file(spark: SparkSession, path: str, *, group: str, name: str) -> DataFrame:
    """``group, name, value`` for each line of the files that ``write_by_file`` wrote.

    On a mounted folder tasks list and read a slice of a group's files each, so the driver lists the groups alone.
    """
    root = _local(path)
    if root is None:
        return spark.read.text(path).select(group, name, "value")
    slices = SLICES
    groups = [f for f in sorted(os.listdir(root)) if f.startswith(f"{group}=")]
    parts = spark.createDataFrame([(f,) for f in groups], "folder string").select("folder", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    told = lambda folder, column: None if folder == _folder(column, None) else unquote(folder[len(column) + 1 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                with os.scandir(os.path.join(root, folder)) as names:
                    mine = (e for e in names if e.name.startswith(f"{name}=") and zlib.crc32(e.name.encode()) % slices == k)
                    for e in mine:
                        for f in os.listdir(e.path):
                            if not f.startswith(("_", ".")):
                                with open(os.path.join(e.path, f), encoding="utf-8", newline="\n") as text:
                                    rows += [(told(folder, group), told(e.name, name), line.rstrip("\r\n")) for line in text]
                        if len(rows) >= 1000:
                            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=[group, name, "value"])
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=[group, name, "value"])

    return parts.repartition(4 * spark.sparkContext.defaultParallelism, "folder", "slice").mapInArrow(run, f"`{group}` string, `{name}` string, value string")


def _pack(path: str, files: dict[str, str]) -> None:
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as out:
        for name, text in files.items():
            out.writestr(zipfile.ZipInfo(name, _WHEN), text)


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _cell(at: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, DataFrame | list[tuple]], *, choices: dict[str, dict[str, list[str]]] | None = None, formulas: dict[str, dict[str, str]] | None = None) -> None:
    """A workbook of one sheet for each table; the same tables always give the same bytes.

    choices: lists to choose from, by sheet and range; formulas: by sheet and cell, such as an ICE score of three others.
    """
    names = list(sheets)
    files = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k, _ in enumerate(names, 1)) + "</Types>",
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="r{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in enumerate(names, 1)) + "</Relationships>",
    }
    for k, (name, table) in enumerate(sheets.items(), 1):
        rows = [tuple(table.columns), *map(tuple, table.toLocalIterator())] if isinstance(table, DataFrame) else table
        extra = (formulas or {}).get(name, {})
        lines = []
        for r, row in enumerate(rows, 1):
            cells = "".join(_cell(f"{_letters(c)}{r}", v) for c, v in enumerate(row, 1))
            cells += "".join(f'<c r="{at}"><f>{escape(f)}</f></c>' for at, f in extra.items() if re.sub(r"\D", "", at) == str(r))
            lines.append(f'<row r="{r}">{cells}</row>')
        lists = (choices or {}).get(name, {})
        valid = "".join(f'<dataValidation type="list" allowBlank="1" sqref="{at}"><formula1>"{escape(",".join(v))}"</formula1></dataValidation>' for at, v in lists.items())
        valid = f'<dataValidations count="{len(lists)}">{valid}</dataValidations>' if lists else ""
        files[f"xl/worksheets/sheet{k}.xml"] = f'{_HEAD}<worksheet xmlns="{_SHEET}"><sheetData>{"".join(lines)}</sheetData>{valid}</worksheet>'
    _pack(path, files)


def read_workbook(path: str, sheet: str) -> list[list[str | None]]:
    """Cells of a sheet by row, as text; blank cells are null."""
    with zipfile.ZipFile(path) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        ids = {s.get("name"): s.get(f"{{{_OFFICE}}}id") for s in tree("xl/workbook.xml").iter(f"{{{_SHEET}}}sheet")}
        target = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}[ids[sheet]]
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_SHEET}}}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        out: list[list[str | None]] = []
        for row in tree("xl/" + target.lstrip("/").removeprefix("xl/")).iter(f"{{{_SHEET}}}row"):
            line: list[str | None] = []
            for c in row.iter(f"{{{_SHEET}}}c"):
                column = 0
                for letter in re.sub(r"[^A-Z]", "", c.get("r", "")):
                    column = column * 26 + ord(letter) - 64
                text = "".join(t.text or "" for t in c.iter(f"{{{_SHEET}}}t")) if c.get("t") == "inlineStr" else next((v.text for v in c.iter(f"{{{_SHEET}}}v")), None)
                text = shared[int(text)] if c.get("t") == "s" and text is not None else text
                line += [None] * (max(column, len(line) + 1) - 1 - len(line)) + [text or None]
            out.append(line)
        return out


def verdicts(spark: SparkSession, path: str, sheet: str, *, claim: str = "Claim", verdict: str = "Verdict") -> DataFrame:
    """Rows of a returned workbook in which claim and verdict are filled in."""
    head, *rows = read_workbook(path, sheet)
    i, j = head.index(claim), head.index(verdict)
    at = lambda r, k: r[k] if k < len(r) else None
    return spark.createDataFrame([(at(r, i), at(r, j)) for r in rows if at(r, i) and at(r, j)], "claim string, verdict string")


def keep_client_columns(fresh: DataFrame, old: DataFrame, *, keys: list[str], columns: list[str]) -> DataFrame:
    """New rows with what a client filled into the old ones, matched by keys; of repeated old rows the first filled value."""
    kept = old.groupBy(*keys).agg(*[F.min(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))).alias(f"__{c}") for c in columns])
    rows = fresh.join(kept, keys, "left")
    return rows.select(*[c for c in fresh.columns if c not in columns], *[F.col(f"__{c}").alias(c) for c in columns])


def ticked(checklist: DataFrame, skill: str, *, date: str, column: str = "skill") -> DataFrame:
    """The checklist with one row done; an unknown row is an error when the rows are read."""
    hit = F.col(column) == skill
    there = checklist.agg(F.max(hit.cast("int")).alias("there"))
    known = F.when(F.coalesce("there", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"no row for {skill}")).cast("boolean"))
    rows = checklist.crossJoin(F.broadcast(there)).where(known).drop("there")
    return rows.withColumns({"status": F.when(hit, "done").otherwise(F.col("status")), "done": F.when(hit, True).otherwise(F.col("done")), "date": F.when(hit, date).otherwise(F.col("date"))})


def markdown_table(frame: DataFrame, columns: list[str]) -> str:
    """A result table in markdown; bars are escaped, line breaks become spaces."""
    plain = lambda v: "" if v is None else re.sub(r"\s+", " ", str(v)).replace("|", r"\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(map(plain, r)) + " |" for r in frame.select(*columns).toLocalIterator()]
    return "\n".join(lines) + "\n"


def faq_page(rows: list[tuple[str, str]]) -> tuple[str, str]:
    """Questions and answers as an escaped HTML fragment and as schema.org JSON."""
    fragment = "\n".join(f"<h3>{html.escape(q)}</h3>\n<p>{html.escape(a)}</p>" for q, a in rows)
    items = [{"@type": "Question", "name": q, "acceptedAnswer": {"@type": "Answer", "text": a}} for q, a in rows]
    return fragment, json.dumps({"@context": "https://schema.org", "@type": "FAQPage", "mainEntity": items}, ensure_ascii=False).replace("</", "<\\/")


_MARK = re.compile(r"(\{\{COMMENT:.*?\}\}|\[REVIEW:.*?\]|\[[A-Z][A-Za-z ]*\])")


def write_document(path: str, paragraphs: list[str]) -> str:
    """A document of paragraphs; ``{{COMMENT:...}}`` becomes a comment, ``[REVIEW:...]`` and ``[Placeholder]`` are highlighted.

    A file of that name is left alone: the next free version number is used.  Returns the path.
    """
    comments: list[str] = []

    def run(piece: str) -> str:
        if piece.startswith("{{COMMENT:"):
            comments.append(piece[10:-2].strip())
            return f'<w:r><w:commentReference w:id="{len(comments) - 1}"/></w:r>'
        look = '<w:rPr><w:highlight w:val="yellow"/></w:rPr>' if _MARK.fullmatch(piece) else ""
        return f'<w:r>{look}<w:t xml:space="preserve">{escape(piece)}</w:t></w:r>'

    body = "".join("<w:p>" + "".join(run(x) for x in _MARK.split(p) if x) + "</w:p>" for p in paragraphs)
    notes = "".join(f'<w:comment w:id="{k}" w:author=""><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:comment>' for k, c in enumerate(comments))
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    files = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{main}.document.main+xml"/><Override PartName="/word/comments.xml" ContentType="{main}.comments+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/comments" Target="comments.xml"/></Relationships>',
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>', "word/comments.xml": f'{_HEAD}<w:comments xmlns:w="{_WORD}">{notes}</w:comments>',
    }
    at, version = Path(path), 1
    while at.exists():
        version += 1
        at = Path(path).with_name(f"{Path(path).stem}-v{version}{Path(path).suffix}")
    _pack(str(at), files)
    return str(at)


def bundle(files: DataFrame, *, cap: int = 6000, whole: tuple[str, ...] = ("questions", "voice")) -> DataFrame:
    """Texts for a bundle: of each folder's numbered runs the highest, each path once, cut to a number of words.

    files: path, content.  Texts whose names say questions or voice stay whole (a cap that is the feature).
    """
    stem, number = F.regexp_extract("path", r"^(.*?)(?:-(\d+))?(?:/[^/]*)?$", 1), F.regexp_extract("path", r"-(\d+)/[^/]*$", 1).try_cast("int")
    rank = F.dense_rank().over(Window.partitionBy(stem).orderBy(F.desc_nulls_last(number)))
    once = files.dropDuplicates(["path"]).withColumn("rank", rank).where("rank = 1").drop("rank")
    words = F.split("content", r"\s+")
    stays = F.lit(False)
    for w in whole:
        stays = stays | F.contains(F.lower("path"), F.lit(w))
    cut = (F.size(words) > cap) & ~stays
    return once.withColumn("truncated", cut).withColumn("content", F.when(cut, F.array_join(F.slice(words, 1, cap), " ")).otherwise(F.col("content")))
