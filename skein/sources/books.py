"""Reading books, chapters, records, graphs and questions."""

from __future__ import annotations

import html as _html
import io
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import stable_doc_id
from skein.functions.text import blank_to_null, body_of, clean_book_text, strip_credits, strip_html, word_count
from skein.operators.evaluation import QUESTION_TYPES
from skein.session import stage

#: Least words of a chapter that is taken in.
MIN_WORDS = 100
#: The line below which a record belongs to its reader.
SENTINEL = "<!-- USER NOTES"


def spine(data: bytes) -> list[tuple[str, str, str]]:
    """(path, title, page) of an EPUB's pages in reading order.

    The container names the package, the package's manifest the pages, its spine
    their order; unknown references are skipped.  A page that is missing from the
    archive (case ignored) is empty; its title is its file name.
    """
    z = zipfile.ZipFile(io.BytesIO(data))
    container = z.read("META-INF/container.xml").decode("utf-8", "replace")
    m = re.search(r'full-path="([^"]+\.opf)"', container)
    if not m:
        raise ValueError("no package document in META-INF/container.xml")
    package = z.read(m[1]).decode("utf-8", "replace")
    attrs = lambda tag: dict(re.findall(r'([\w-]+)\s*=\s*"([^"]*)"', tag))
    items = [attrs(t) for t in re.findall(r"<(?:\w+:)?item\b[^>]*>", package)]
    pages = {a["id"]: a["href"] for a in items if "id" in a and "href" in a and "html" in a.get("media-type", "")}
    members = {n.lower(): n for n in z.namelist()}
    out = []
    for ref in (attrs(t).get("idref") for t in re.findall(r"<(?:\w+:)?itemref\b[^>]*>", package)):
        if ref not in pages:
            continue
        path = posixpath.normpath(posixpath.join(posixpath.dirname(m[1]), pages[ref]))
        name = path if path in z.namelist() else members.get(path.lower())
        page = z.read(name).decode("utf-8", "replace") if name else ""
        out.append((path, page_title(page) or posixpath.splitext(posixpath.basename(path))[0], page))
    return out


def page_title(page: str) -> str:
    """The title element, else the first heading, as text."""
    for pattern in (r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"):
        m = re.search(pattern, page)
        if m and (t := re.sub(r"\s+", " ", _html.unescape(re.sub(r"<[^>]+>", " ", m[1]))).strip()):
            return t
    return ""


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, doc_id, title, text, n_words): chapters of EPUB files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(posixpath.basename(p), i, t, page) for p, data in zip(b["path"], b["content"]) for i, (_, t, page) in enumerate(spine(data))]
            yield pd.DataFrame(rows, columns=["file", "position", "title", "page"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")
    pages = raw.mapInPandas(run, "file string, position int, title string, page string")
    text = clean_book_text(F.col("page"))
    return pages.select("file", "position", stable_doc_id(F.col("file"), F.col("position")).alias("doc_id"), "title", text.alias("text"), word_count(text).alias("n_words"))


def listing(chapters: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Chapters with word counts and a note where one is too short."""
    return chapters.select("file", "position", "title", "n_words", F.when(F.col("n_words") < least, "too short").otherwise("").alias("note"))


def read_chapters(spark: SparkSession, path: str, credits: bool = False) -> DataFrame:
    """(chapter, doc_id, text) of page files named ``NNNN_*.xhtml``; doc_id is one less.

    The first file of a chapter by name counts.  ``credits`` drops credit lines
    and keeps 4,000 characters, as question writing does.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.xhtml", recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)_", 1).alias("n"), F.col("_metadata.file_name").alias("file"), "value")
    first = raw.filter("n <> ''").groupBy(F.col("n").cast("int").alias("chapter")).agg(F.min_by("value", "file").alias("page"))
    text = F.substring(strip_credits(F.col("page")), 1, 4000) if credits else strip_html(body_of(F.col("page")))
    return first.select("chapter", (F.col("chapter") - 1).alias("doc_id"), text.alias("text"))


def parse_selection(spec: str, total: int) -> list[int]:
    """``all``, ``a-b`` or ``a,b`` (from 1) as sorted zero-based positions in range."""
    if spec.strip().lower() == "all":
        return list(range(total))
    out: set[int] = set()
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        out |= set(range(int(a) - 1, int(b or a)))
    return sorted(x for x in out if 0 <= x < total)


def parse_range(spec: str) -> tuple[int, int]:
    """``START-END`` with START not above END."""
    m = re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", spec)
    if not m or int(m[1]) > int(m[2]):
        raise ValueError(f"not a range: {spec!r}")
    return int(m[1]), int(m[2])


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, type, description) and arcs (source, target, relation) of a JSON graph."""
    schema = "nodes array<struct<name:string,type:string,description:string>>, edges array<struct<source:string,target:string,relation:string>>"
    try:
        raw = spark.read.schema(schema).json(path, multiLine=path.endswith(".json"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], schema)
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode("edges").alias("e")).select("e.*")


def write_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    """Nodes and arcs as JSON lines, one of a kind per line, in one folder that ``read_graph`` reads back."""
    n = nodes.select(F.to_json(F.struct(F.array(F.struct("name", "type", "description")).alias("nodes"))).alias("value"))
    e = arcs.select(F.to_json(F.struct(F.array(F.struct("source", "target", "relation")).alias("edges"))).alias("value"))
    n.unionByName(e).write.mode("overwrite").text(path)


QUESTION = "question string, expected_answer string, retrieval_anchor string, question_type string, source_doc_id bigint"


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Questions of a JSON array in file order, with their position; an optional limit."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{QUESTION.replace(' string', ':string').replace(' bigint', ':bigint')}>>").alias("q"))
    q = raw.select(F.posexplode("q").alias("position", "q")).select("position", "q.*")
    return q if limit is None else q.filter(F.col("position") < limit)


def write_questions(questions: DataFrame, path: str, append: bool = False) -> None:
    """Questions as JSON lines in a folder; ``append`` keeps those that lie there."""
    questions.select(*[c.split()[0] for c in QUESTION.split(", ")]).write.mode("append" if append else "overwrite").json(path)


def read_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """Questions that ``write_questions`` wrote."""
    return spark.read.schema(QUESTION).json(path)


def parse_generated(responses: DataFrame) -> DataFrame:
    """Questions in model responses (chapter, response): the first bracketed array.

    Rows without question, answer or anchor are dropped; unknown types become
    attribute_recall; the document is the chapter less one.
    """
    found = blank_to_null(F.regexp_extract("response", r"(?s)\[.*?\]", 0))
    q = responses.select("chapter", F.explode(F.from_json(found, "array<struct<question:string,expected_answer:string,retrieval_anchor:string,question_type:string>>")).alias("q")).select("chapter", "q.*")
    ok = q.filter("coalesce(question, '') <> '' and coalesce(expected_answer, '') <> '' and coalesce(retrieval_anchor, '') <> ''")
    kind = F.when(F.col("question_type").isin(*QUESTION_TYPES), F.col("question_type")).otherwise("attribute_recall")
    return ok.select("question", "expected_answer", "retrieval_anchor", kind.alias("question_type"), (F.col("chapter") - 1).alias("source_doc_id"))


def parse_records(raw: DataFrame) -> DataFrame:
    """Records (stem, content) as stem, name, aliases, body, notes, has_sentinel.

    Front matter between rules gives name and aliases; the sentinel parts what
    the engine writes from the reader's notes.
    """
    c = F.col("content")
    front = F.regexp_extract(c, r"(?s)^---\s*\n(.*?)\n---", 1)
    after = F.regexp_replace(c, r"(?s)^---\s*\n.*?\n---\s*", "")
    aliases = F.filter(F.transform(F.split(F.regexp_extract(front, r"(?m)^aliases:\s*\[(.*?)\]", 1), ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", ""))), lambda x: x != "")
    return raw.select(
        "stem", F.coalesce(blank_to_null(F.trim(F.regexp_extract(front, r"(?m)^name:\s*(.*)$", 1))), F.replace("stem", F.lit("_"), F.lit(" "))).alias("name"), aliases.alias("aliases"),
        F.substring_index(after, SENTINEL, 1).alias("body"), F.contains(c, F.lit(SENTINEL)).alias("has_sentinel"), F.when(F.contains(c, F.lit(SENTINEL)), F.substring_index(after, SENTINEL, -1)).otherwise("").alias("notes"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(stem, content) of Markdown records below a folder."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("stem"), F.col("value").alias("content"))


def update_records(current: DataFrame, entries: DataFrame) -> DataFrame:
    """Record texts (type, name, content) with new entries before the reader's notes.

    A new name gets a new record; a record without the sentinel is left as it is.
    """
    head = F.concat(F.lit("---\nname: "), "name", F.lit("\ntype: "), "type", F.lit("\naliases: []\n---\n\n## Key Facts\n\n## Event Log\n\n"))
    joined = current.join(entries, ["type", "name"], "full_outer")
    c, e = F.col("content"), F.coalesce("entries", F.lit(""))
    at = F.instr(c, SENTINEL)
    grown = F.concat(F.substr(c, F.lit(1), at - 1), e, F.substr(c, at))
    return joined.select("type", "name", F.when(c.isNull(), F.concat(head, e, F.lit(f"{SENTINEL} -->\n"))).when(at > 0, grown).otherwise(c).alias("content"))


def write_records(records: DataFrame, path: str) -> None:
    """Record texts partitioned by type, one row per record."""
    records.write.mode("overwrite").partitionBy("type").parquet(path)


def write_markdown(records: DataFrame, folder: str) -> DataFrame:
    """One Markdown file per record below ``folder``/type, which all executors can write; (stem, ok) of each.

    A file is written beside its place and moved there, so a task that runs again
    leaves whole files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, stem, content in zip(b["type"], b["stem"], b["content"]):
                place = os.path.join(folder, kind)
                os.makedirs(place, exist_ok=True)
                beside = os.path.join(place, f".{stem}.{uuid.uuid4().hex}")
                with open(beside, "w", encoding="utf-8") as f:
                    f.write(content)
                os.replace(beside, os.path.join(place, f"{stem}.md"))
            yield pd.DataFrame({"stem": b["stem"], "ok": True})

    slug = lambda c: F.regexp_replace(F.coalesce(c, F.lit("unknown")), r"[^\p{L}\p{N}_-]+", "_")
    out = records.select(slug(F.col("type")).alias("type"), slug(F.col("name")).alias("stem"), "content").mapInPandas(run, "stem string, ok boolean")
    return stage(out, "written")
