"""File sources: trees of text, Markdown, HTML, CSV and Office files as page tables.

Listing and reading are Spark's binaryFile source, so any file system works; a file that cannot be
read becomes a row with status ``error``, never a failed job. Spark's file sources pass over files of no
bytes; ``extract_bytes`` calls them ``empty`` where another source delivers them.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.text import clean_text, number_pictures, path_key
from quillspark.operators.filters import is_excluded

PAGES = "path string, status string, title string, n_pages int, error string, pages array<struct<page_no:int,text:string>>"
#: Legacy formats and what they are converted to, by which program, and how long that may take.
LEGACY = {".doc": "docx", ".ppt": "pptx"}
CONVERTER, CONVERTER_SECONDS = "soffice", 300.0
PICTURES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp")


def literal(path: str) -> str:
    """A path in which no character is a wildcard."""
    return re.sub(r"([\[\]{}*?,^\\])", r"\\\1", path)


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), excluded: list[str] = ()) -> DataFrame:
    """(path, path_key, ext, size, mtime) of a tree; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(literal(root))
    out = files.select("path", path_key(F.regexp_replace("path", "^[a-z]+:/+", "/")).alias("path_key"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if extensions:
        out = out.where(F.col("ext").isin(*extensions))
    return out.where(~is_excluded(F.col("path_key"), list(excluded))) if excluded else out


def extract_listed(spark: SparkSession, root: str, wanted: DataFrame, n: int, of: int, extensions: tuple[str, ...] = (), max_bytes: int | None = None) -> DataFrame:
    """extract() of the files wanted (path), n of ``of`` in the tree.

    Few are read by their paths, which are fewer than those that Spark's own listing of the tree
    holds; where most are wanted, the tree is read.
    """
    if 2 * n >= of:
        return extract(spark, root, extensions, max_bytes)
    paths = [r.path for r in wanted.select("path").toLocalIterator()]
    return extract(spark, paths, (), max_bytes) if paths else spark.createDataFrame([], PAGES)


def extract(spark: SparkSession, root: str | list[str], extensions: tuple[str, ...] = (), max_bytes: int | None = None) -> DataFrame:
    """The pages of every file of a tree, or of the named ones: status ok, no_text, empty, skipped or error."""
    files = spark.read.format("binaryFile")
    files = files.load([literal(r) for r in root]) if isinstance(root, list) else files.option("recursiveFileLookup", "true").load(literal(root))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    if extensions:
        files = files.where(ext.isin(*extensions))
    content = F.col("content") if max_bytes is None else F.when(F.col("length") <= max_bytes, F.col("content"))

    def run(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("page_no", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            rows = [extract_bytes(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            status, title, pages, error = zip(*rows) if rows else ((), (), (), ())
            listed = pa.array([[{"page_no": i, "text": t} for i, t in enumerate(p, 1)] for p in pages], kind)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(status, pa.string()), pa.array(title, pa.string()), pa.array([len(p) for p in pages], pa.int32()), pa.array(error, pa.string()), listed], names=["path", "status", "title", "n_pages", "error", "pages"])

    raw = files.select("path", content.alias("content")).mapInArrow(run, PAGES)
    cleaned = F.transform("pages", lambda p: F.struct(p["page_no"].alias("page_no"), clean_text(p["text"]).alias("text")))
    return raw.withColumn("pages", cleaned)


def page_rows(extracted: DataFrame, id_col: str = "path") -> DataFrame:
    return extracted.select(F.col(id_col).alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", "p.page_no", "p.text")


def extract_bytes(path: str, content: bytes | None) -> tuple[str, str | None, list[str], str | None]:
    """(status, title, page texts, error) of one file by its extension."""
    name = path.rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if content is None:
        return "skipped", None, [], "larger than the limit"
    if not content:
        return "empty", None, [], None
    try:
        if ext in (".txt", ".csv", ".log"):
            return _status([_decode(content)], None)
        if ext == ".md":
            text = _decode(content)
            title = next((m for m in re.findall(r"(?m)^#+\s*(.+?)\s*#*$", text) if re.search(r"[^\W\d_]", m)), None)
            return _status([text], title)
        if ext in (".html", ".htm"):
            text = _decode(content)
            title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
            return _status([html_text(text)], title[1].strip() if title else None)
        if ext == ".docx":
            return _status(docx_pages(content), None)
        if ext == ".pptx":
            return _status(pptx_slides(content), None)
        if ext == ".pdf":
            return pdf_pages(content)
        if ext in LEGACY:
            return converted_pages(content, ext)
        if ext in PICTURES:
            return "no_text", re.sub(r"[_\-]+", " ", name.rsplit(".", 1)[0]).strip(), [""], None
        return "skipped", None, [], f"no reader for {ext or 'files without extension'}"
    except Exception as e:  # noqa: BLE001 - whatever a broken file raises belongs in its row
        return "error", None, [], f"{type(e).__name__}: {e}"[:500]


def _status(pages: list[str], title: str | None) -> tuple[str, str | None, list[str], None]:
    return ("ok" if any(p.strip() for p in pages) else "no_text"), title, pages, None


def _decode(content: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-16") if content[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig",):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("cp1252", "replace")


def html_text(html: str, decoded: tuple[str, ...] | None = None) -> str:
    """Visible text, a line for each block.

    Character references are decoded where a semicolon ends them: without one, a text may have been cut there, or
    be no reference at all. decoded: the names to decode; without it all of HTML, and numbers.
    """
    import html as entities
    from html.entities import html5

    def character(m: re.Match) -> str:
        if decoded is None and m[1][0] == "#":
            return entities.unescape(m[0])
        return html5.get(m[1] + ";", m[0]) if decoded is None or m[1] in decoded else m[0]

    html = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", html)
    html = re.sub(r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer)|br)\b[^>]*>", "\n", html)
    return re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", character, re.sub(r"<[^>]+>", "", html))


def html_texts(pages: DataFrame, html: str = "html", decoded: tuple[str, ...] | None = None) -> DataFrame:
    """pages with the visible text (null: empty) in place of the HTML column; decoded as in html_text()."""
    names = [c for c in pages.columns if c not in (html, "text")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = pa.array([html_text(x or "", decoded) for x in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, "text"])

    return pages.mapInArrow(run, pages.select(*names).limit(0).withColumn("text", F.lit("")).schema)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, bool, bool]]:
    """(text, is_heading, begins_page) of the paragraphs and tables of a document."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, bool, bool]] = []

    def walk(node) -> None:
        for x in node:
            if x.tag == f"{_W}p":
                text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" for t in x.iter() if t.tag in (f"{_W}t", f"{_W}tab"))
                style = x.find(f"{_W}pPr/{_W}pStyle")
                level = re.fullmatch(r"(?i)(?:heading|titre|berschrift|überschrift)\s*(\d)", (style.get(f"{_W}val") if style is not None else "") or "")
                new = any(b.get(f"{_W}type") == "page" for b in x.iter(f"{_W}br")) or x.find(f".//{_W}lastRenderedPageBreak") is not None
                if text.strip() or new:
                    out.append(("#" * int(level[1]) + " " + text if level else text, bool(level), new))
            elif x.tag == f"{_W}tbl":
                rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.findall(f"{_W}tc")] for r in x.findall(f"{_W}tr")]
                out.append((table_text(rows), False, False))
            else:
                walk(x)

    walk(body if body is not None else [])
    return out


def table_text(rows: list[list[str]]) -> str:
    """Cells joined by bars; of adjacent equal cells, which a merged cell repeats, one stays."""
    lines = []
    for row in rows:
        cells = [c.strip() for i, c in enumerate(row) if i == 0 or c != row[i - 1]]
        if any(cells):
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def paginate(blocks: list[tuple[str, bool, bool]], size: int = V.PAGE_CHARS) -> list[str]:
    """Pages at the breaks if there are any, else at the size, or at a heading beyond half of it."""
    breaks = any(b for _, _, b in blocks)
    pages: list[list[str]] = [[]]
    used = 0
    for text, heading, begins in blocks:
        new = begins and bool(pages[-1]) if breaks else used and (used + len(text) > size or heading and used > size / 2)
        if new:
            pages.append([])
            used = 0
        pages[-1].append(text)
        used += len(text)
    return ["\n".join(p) for p in pages]


def docx_pages(content: bytes) -> list[str]:
    return paginate(docx_blocks(content))


def pptx_slides(content: bytes) -> list[str]:
    """A page for each slide: title as heading, texts and tables in order, then the notes."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = sorted((int(m[1]), m[0]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    pages = []
    for k, name in names:
        root = ElementTree.fromstring(archive.read(name))
        parts = []
        for node in root.iter():
            if node.tag == f"{_P}sp":
                kind = node.find(f".//{_P}ph")
                text = _paragraphs(node)
                if text:
                    parts.append(f"# {text}" if kind is not None and kind.get("type") in ("title", "ctrTitle") else text)
            elif node.tag == f"{_A}tbl":
                parts.append(table_text([["".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc") if c.get("hMerge") != "1" and c.get("vMerge") != "1"] for r in node.findall(f"{_A}tr")]))
        notes = f"ppt/notesSlides/notesSlide{k}.xml"
        if notes in archive.namelist() and (text := _paragraphs(ElementTree.fromstring(archive.read(notes)))):
            parts.append(f"Notes: {text}")
        pages.append("\n".join(p for p in parts if p))
    return pages


def _paragraphs(node) -> str:
    return "\n".join(t for p in node.iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t"))))


def pdf_pages(content: bytes, most: int = 3000) -> tuple[str, str | None, list[str], str | None]:
    """Pages by an optional library; few characters a page mean a scan."""
    try:
        import fitz  # type: ignore[import-not-found]
    except ImportError:
        return "skipped", None, [], "no PDF library"
    doc = fitz.open(stream=content, filetype="pdf")
    if doc.needs_pass:
        return "error", None, [], "password needed"
    pages = [doc[i].get_text(sort=True) for i in range(min(len(doc), most))]
    status = "no_text" if sum(len(p.strip()) for p in pages) < V.SCAN_CHARS_PER_PAGE * max(len(pages), 1) else "ok"
    return status, (doc.metadata or {}).get("title") or None, pages, None


def converted_pages(content: bytes, ext: str, command: str = CONVERTER, seconds: float = CONVERTER_SECONDS) -> tuple[str, str | None, list[str], str | None]:
    """Pages of a legacy Office file, by an external converter that is stopped when it takes too long.

    The converter's files are in a folder of the task that goes with it.
    """
    program = shutil.which(command)
    if program is None:
        return "skipped", None, [], f"no converter for {ext}"
    target = LEGACY[ext]
    with tempfile.TemporaryDirectory(prefix="quillspark-convert-") as folder:
        with open(f"{folder}/in{ext}", "wb") as f:
            f.write(content)
        arguments = [program, f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", target, "--outdir", folder, f"{folder}/in{ext}"]
        try:
            subprocess.run(arguments, timeout=seconds, capture_output=True, check=True)
            with open(f"{folder}/in.{target}", "rb") as f:
                made = f.read()
        except subprocess.TimeoutExpired:
            return "error", None, [], f"the converter took over {seconds:g} s"
        except (subprocess.CalledProcessError, OSError) as e:
            return "error", None, [], f"the converter failed: {e}"[:500]
    return _status(docx_pages(made) if target == "docx" else pptx_slides(made), None)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text): Markdown files with numbered picture marks, natively."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    title = F.get(F.filter(F.regexp_extract_all(F.concat(F.lit("\n"), "value"), F.lit(r"\n#+[ \t]*([^\n]+)"), F.lit(1)), lambda h: F.rlike(h, F.lit(r"\p{L}"))), F.lit(0))
    return raw.select("path", F.trim(title).alias("title"), clean_text(number_pictures(F.col("value"))).alias("text"))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """A register CSV with header: all columns as text without outer blanks, blank as null, a byte order mark ignored."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    return rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿").strip().lower()) for c in rows.columns])


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """(concept, lang, term, status) of a TOML file; a term belongs to its first concept."""
    from quillspark.operators.querylang import normal_term, thesaurus_rows

    text = spark.read.text(path, wholetext=True).first().value
    seen: dict[str, str] = {}
    rows = [r for r in thesaurus_rows(text) if seen.setdefault(normal_term(r[2]), r[0]) == r[0]]
    return spark.createDataFrame(rows, "concept string, lang string, term string, status string")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the cards in a folder."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return raw.where(F.endswith("file", F.lit(".md")))


PICTURE_ROWS = "path string, page_no int, image_no int, sha1 string, image binary"


def picture_rows(files: DataFrame) -> DataFrame:
    """(path, page_no, image_no, sha1, image) of the pictures in files (path, content): picture files, DOCX, PPTX and, with a library, PDF.

    Pictures of a page are numbered in the order in which they stand there; a file that cannot be
    read has none.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(path, page, k, hashlib.sha1(image).hexdigest(), image) for page, k, image in pictures_in(path, content or b"")]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "page_no", "image_no", "sha1", "image"])

    return files.select("path", "content").mapInArrow(run, PICTURE_ROWS)


def pictures_in(path: str, content: bytes) -> list[tuple[int, int, bytes]]:
    """(page, number on the page, bytes) of the pictures of one file."""
    ext = "." + path.rsplit(".", 1)[-1].lower()
    try:
        if ext in PICTURES:
            return [(1, 1, content)] if content else []
        if ext == ".docx":
            return [(1, k, x) for k, x in enumerate(_embedded(zipfile.ZipFile(io.BytesIO(content)), "word/document.xml"), 1)]
        if ext == ".pptx":
            archive = zipfile.ZipFile(io.BytesIO(content))
            slides = sorted((int(m[1]), m[0]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
            return [(page, k, x) for page, (_, name) in enumerate(slides, 1) for k, x in enumerate(_embedded(archive, name), 1)]
        if ext == ".pdf":
            import fitz  # type: ignore[import-not-found]

            doc = fitz.open(stream=content, filetype="pdf")
            return [(i + 1, k, doc.extract_image(x[0])["image"]) for i in range(len(doc)) for k, x in enumerate(doc[i].get_images(), 1)]
    except Exception:  # noqa: BLE001 - a broken file has no pictures
        return []
    return []


def _embedded(archive: zipfile.ZipFile, part: str) -> list[bytes]:
    """The pictures that a part of an Office file shows, in order."""
    folder, name = part.rsplit("/", 1)
    links = f"{folder}/_rels/{name}.rels"
    if links not in archive.namelist():
        return []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read(links))}
    out = []
    for blip in ElementTree.fromstring(archive.read(part)).iter(f"{_A}blip"):
        target = targets.get(blip.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"))
        if target:
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
            if full in archive.namelist():
                out.append(archive.read(full))
    return out
