"""A corpus index in a folder: the operations of the engine behind one object.

Stored are documents, pages, chunks, their inverted index, vectors, and the ledgers of recognised
pages and described pictures, in one folder of segments: a run reads, chunks, indexes and embeds what
has changed, and all tables change at once. What is taken from a document anew takes the rows of its
ledgers and vectors away, so they are made again. Everything derived is a view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import chunking, text
from quillspark.operators import cards, control, enrichment, facets, filters, incremental, lexical, linkage, reports, retrieval
from quillspark.operators.querylang import Thesaurus, parse, parse_name_query
from quillspark.sources import files

PROFILES = {"projects": facets.project_facets, "marketing": facets.category_facets, "documentation": facets.documentation_facets}
#: What the files of a table are sorted by.
LAYOUT = {"postings": ["term", "id"], "docs": ["path_key"]}
OCR = "doc_id long, page_no int, status string, version int, chars long"
PICTURES = "doc_id long, page_no int, image_no int, sha1 string, model string, version int, answer string"


class CorpusIndex:
    """path: where the tables live; root: the tree that is indexed; profile: which facet rules apply."""

    def __init__(self, spark: SparkSession, path: str, root: str | None = None, profile: str | None = None, excluded: tuple[str, ...] = (), thesaurus: str | None = None, dim: int = 256):
        self.spark, self.path, self.root, self.profile, self.excluded, self.dim = spark, path.rstrip("/"), root, profile, excluded, dim
        self.thesaurus = Thesaurus.from_toml(thesaurus) if thesaurus else None
        if profile is not None and profile not in PROFILES:
            raise ValueError(f"profile must be one of {', '.join(PROFILES)}")

    @property
    def tables(self) -> incremental.Segments:
        return incremental.Segments(self.spark, self.path, LAYOUT)

    # -------------------------------------------------------------- ingest

    def index(self, extensions: tuple[str, ...] = (), max_bytes: int | None = None, retry_errors: bool = False) -> dict[str, int]:
        """Brings the index up to date with the tree and tells how many files had which action.

        Only new and updated files are read.
        """
        if self.root is None:
            raise ValueError("an index without a root cannot scan")
        found = files.list_files(self.spark, self.root, extensions, list(self.excluded)).withColumn("mtime", F.col("mtime").cast("double"))
        tables = self.tables
        stored = tables.read("docs").select("path_key", "size", "mtime", "status", "indexed_at") if tables.has("docs") else self.spark.createDataFrame([], "path_key string, size long, mtime double, status string, indexed_at double")
        retry = ("error", "skipped") if retry_errors else ()
        actions = incremental.snapshot_diff(found, stored, retry, max_bytes=max_bytes).persist()
        counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        if counts.keys() & {"new", "updated", "skipped", "gone"}:
            work = found.join(actions.where(F.col("action").isin("new", "updated", "skipped")), "path_key", "left_semi")
            changed = sum(counts.get(k, 0) for k in ("new", "updated", "skipped"))
            texts = files.extract_listed(self.spark, self.root, work, changed, sum(counts.values()) - counts.get("gone", 0), extensions, max_bytes)
            rows = work.join(texts, "path").select("path", "path_key", "ext", "size", "mtime", "status", "title", "n_pages", "error", F.unix_timestamp().cast("double").alias("indexed_at"), F.xxhash64("path_key").alias("doc_id"), "pages").persist()
            gone = actions.where(F.col("action") != "unchanged").select(F.xxhash64("path_key").alias("doc_id"))
            self._change(rows, gone)
            rows.unpersist()
        actions.unpersist()
        return counts

    def _change(self, rows: DataFrame, gone: DataFrame) -> None:
        """Takes documents away and adds rows of documents with their pages, and what follows from these."""
        pages = files.page_rows(rows, "doc_id").persist()
        chunks = chunking.chunk_pages(pages).withColumn("chunk_id", F.xxhash64("doc_id", "page_no", "seq")).persist()
        tables = self.tables
        made = tables.has("docs")
        old = (tables.state().get("notes", {}).get("chunks", 0), tables.state().get("notes", {}).get("words", 0))
        # the figures of a search follow the change: what goes is taken off, what comes is added
        less = tables.read("chunks").join(gone.distinct(), "doc_id", "left_semi") if made else chunks.limit(0)
        size = F.size(text.tokens(F.col("chunk")))
        n0, w0 = less.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
        n1, w1 = chunks.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
        notes = {"chunks": old[0] - n0 + n1, "words": old[1] - w0 + w1}
        tables.change({"docs": rows.drop("pages"), "pages": pages, "chunks": chunks, "postings": self._postings(chunks)}, gone, notes)
        chunks.unpersist()
        pages.unpersist()

    @staticmethod
    def _postings(chunks: DataFrame) -> DataFrame:
        return lexical.postings(chunks.select(F.col("chunk_id").alias("id"), "doc_id", text.tokens(F.col("chunk")).alias("words")))

    def embed(self, reset: bool = False) -> int:
        """Vectors by hashed words of the chunks that have none; how many were made. reset: makes all of them again."""
        tables = self.tables
        control.check_model(tables.state().get("notes", {}).get("model"), f"hash:{self.dim}", reset)
        chunks = self.chunks()
        if tables.has("vectors") and not reset:
            chunks = chunks.join(tables.read("vectors").select("chunk_id"), "chunk_id", "left_anti")
        vectors = chunks.select("chunk_id", "doc_id", retrieval.hash_embedding(F.col("chunk"), self.dim).cast("array<float>").alias("embedding")).persist()
        n = vectors.count()
        if reset:
            tables.replace("vectors", vectors, {"model": f"hash:{self.dim}"})
        elif n:
            tables.change({"vectors": vectors}, notes={"model": f"hash:{self.dim}"})
        vectors.unpersist()
        return n

    def recognise(self, images: DataFrame, engine: Callable[[bytes], str], version: int = 1, retry: tuple[str, ...] = (), minutes: float | None = None, max_pages: int = 3000, batch: int = 1000, most_failures: int = 20) -> dict[str, int]:
        """Text of scanned pages by an engine, in batches that each are kept; how many pages had which status.

        images: (doc_id, page_no, image). Goes on where an earlier run ended; ends when the time is
        up, or after so many failures in a row. Recognised text is added behind the pages' chunks.
        """
        tables = self.tables
        ledger = tables.read("ocr") if tables.has("ocr") else self.spark.createDataFrame([], OCR)
        chars = self.pages().groupBy("doc_id", "page_no").agg(F.sum(F.length("text")).alias("chars"))
        wanted = enrichment.ocr_candidates(self.docs(), chars, ledger, version, max_pages, retry)
        work = wanted.join(images, ["doc_id", "page_no"]).orderBy(~F.col("first"), "doc_id", "page_no")

        def save(done: DataFrame) -> None:
            ledger = done.select("doc_id", "page_no", "status", F.lit(version).alias("version"), F.length("text").cast("long").alias("chars"))
            passages = done.where("status = 'text'").select("doc_id", "page_no", F.lit(0).alias("place"), "text")
            tables = self.tables
            here = tables.read("chunks").join(passages.select("doc_id").distinct(), "doc_id", "left_semi")
            added = incremental.append_passages(here, passages).join(here, ["doc_id", "page_no", "seq"], "left_anti")
            added = added.withColumn("chunk_id", F.xxhash64("doc_id", "page_no", "seq")).persist()
            n, words = added.agg(F.count("*"), F.coalesce(F.sum(F.size(text.tokens(F.col("chunk")))), F.lit(0))).first()
            notes = tables.state().get("notes", {})
            tables.change({"ocr": ledger, "chunks": added, "postings": self._postings(added)}, notes={"chunks": notes.get("chunks", 0) + n, "words": notes.get("words", 0) + words})
            added.unpersist()

        return enrichment.run_in_batches(work, lambda some: enrichment.recognised(some, engine), save, batch, minutes, most_failures)

    def describe(self, occurrences: DataFrame, engine: Callable[[bytes], str], model: str, version: int = 1, minutes: float | None = None, batch: int = 200, most_failures: int = 20) -> dict[str, int]:
        """Answers about pictures, one call for each distinct picture, in batches that each are kept.

        occurrences: (doc_id, page_no, image_no, sha1, image). A picture that was answered in an
        earlier run, or in another document, is not asked about again; a failed one is.
        """
        tables = self.tables
        cache = tables.read("pictures") if tables.has("pictures") else self.spark.createDataFrame([], PICTURES)
        known = cache.where((F.col("model") == model) & (F.col("version") == version)).select("sha1").distinct()
        one = F.min_by(F.struct("doc_id", "page_no", "image_no", "image"), F.struct("doc_id", "page_no", "image_no"))
        work = occurrences.join(known, "sha1", "left_anti").groupBy("sha1").agg(one.alias("x")).select("sha1", "x.*").orderBy("doc_id", "page_no", "image_no")

        def call(some: DataFrame) -> DataFrame:
            return enrichment.answered(some, engine).withColumns({"model": F.lit(model), "version": F.lit(version)})

        def save(done: DataFrame) -> None:
            self.tables.change({"pictures": done.where("status = 'described'").select("doc_id", "page_no", "image_no", "sha1", "model", "version", "answer")})

        return enrichment.run_in_batches(work, call, save, batch, minutes, most_failures)

    # -------------------------------------------------------------- views

    def docs(self) -> DataFrame:
        return self.tables.read("docs")

    def pages(self) -> DataFrame:
        return self.tables.read("pages")

    def chunks(self) -> DataFrame:
        return self.tables.read("chunks")

    def facets(self) -> DataFrame:
        path = F.regexp_replace("path", "^[a-z]+:/+", "/")
        skipped = 0 if self.root is None else len(re.sub("^[a-z]+:/+", "/", self.root).rstrip("/")) + 1
        rows = self.docs().select("doc_id", F.substring(path, F.lit(skipped + 1), F.length(path)).alias("path"))
        return rows if self.profile is None else PROFILES[self.profile](rows)

    def machines(self) -> DataFrame:
        return linkage.confirmed(linkage.mentions(self.facets(), self.pages()))

    # -------------------------------------------------------------- questions

    def search(self, words: str, limit: int = 10, mode: str = "hybrid", folder: str | None = None, file_type: str | None = None, after: str | None = None, **facet: str) -> DataFrame:
        docs = self.docs()
        visible = None
        if folder or file_type or after or facet:
            visible = filters.with_filters(docs.withColumn("mtime", F.col("mtime").cast("timestamp")), self.facets(), folder, file_type, after, **facet)
        tables = self.tables
        vectors = tables.read("vectors") if tables.has("vectors") else None
        notes = tables.state().get("notes", {})
        figures = (notes.get("chunks", 0), notes.get("words", 0) / max(notes.get("chunks", 0), 1))
        vector = retrieval.query_vector(self.spark, words, self.dim) if vectors is not None and mode != "keyword" else None
        wide = parse(words, thesaurus=self.thesaurus) if self.thesaurus else None
        return retrieval.hybrid_search(self.chunks(), parse(words), vectors if vector else None, vector, wide, visible, limit, mode, (tables.read("postings"), figures))

    def find_files(self, name: str, limit: int = 20) -> DataFrame:
        rows = self.docs().select(F.col("doc_id").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "path")
        return lexical.find_names(rows, parse_name_query(name), min(max(limit, 1), 100)).join(rows, "id").orderBy(F.col("score").desc(), "id")

    def read_document(self, path_key: str, first: int = 1, last: int | None = None) -> DataFrame:
        return reports.read_pages(self._pages_of(path_key), first, last).orderBy("page_no")

    def find_in_document(self, path_key: str, words: str, most: int = 20) -> DataFrame:
        return reports.find_in_document(self._pages_of(path_key), words, most).orderBy("hit")

    def _pages_of(self, path_key: str) -> DataFrame:
        return self.pages().join(self.docs().where(F.col("path_key") == path_key.lower()).select("doc_id"), "doc_id", "left_semi")

    def read_fresh(self, path_key: str) -> DataFrame:
        """(page_no, text, live): the pages as the file has them now if it has changed since it was indexed, else as stored."""
        stored = self.docs().where(F.col("path_key") == path_key.lower()).select("path", "size", "mtime").first()
        if stored is None:
            raise ValueError(f"{path_key} is not indexed")
        try:
            now = self.spark.read.format("binaryFile").load(files.literal(stored.path))
            row = now.select(F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime")).first()
        except AnalysisException:  # the file is gone: what is stored is all there is
            row = None
        if row is None or (row.size == stored.size and abs(row.mtime - stored.mtime) < incremental.SAME_TIME):
            return self._pages_of(path_key).select("page_no", "text", F.lit(False).alias("live")).orderBy("page_no")
        pages = files.page_rows(files.extract(self.spark, [stored.path]))
        return pages.select("page_no", "text", F.lit(True).alias("live")).orderBy("page_no")

    def live_folder(self, folder: str) -> DataFrame:
        """(path_key, state, status) of the files that the tree has in a folder or the index knows there: indexed, changed, new or missing."""
        if self.root is None:
            raise ValueError("an index without a root has no tree")
        here = lambda df: df.where(filters.in_folder("path_key", folder))
        found = here(files.list_files(self.spark, self.root, (), list(self.excluded)).withColumn("mtime", F.col("mtime").cast("double")))
        known = here(self.docs()).select("path_key", "size", "mtime", "status", "indexed_at")
        actions = incremental.snapshot_diff(found, known)
        state = F.create_map(*[F.lit(x) for x in ("unchanged", "indexed", "updated", "changed", "new", "new", "gone", "missing")])
        return actions.join(known.select("path_key", "status"), "path_key", "left").select("path_key", F.element_at(state, F.col("action")).alias("state"), "status").orderBy("path_key")

    # -------------------------------------------------------------- register, projects and cards

    def _project_facets(self) -> DataFrame:
        rows = self.facets().join(self.docs().select("doc_id", "path_key", F.col("mtime").cast("timestamp").alias("mtime")), "doc_id")
        for c in ("project", "subproject", "collection", "doc_type"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
        return rows

    def register(self, path: str) -> DataFrame:
        """The rows of a register CSV, linked with the projects of the index by folder, name and numbers."""
        rows = files.read_register(self.spark, path)
        for c in ("project", "path", "order_no", "serial", "model", "year", "client", "country", "group", "order_date", "notes"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
        rows = rows.withColumnsRenamed({"project": "name", "group": "grp"}).withColumn("row_id", F.monotonically_increasing_id())
        rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("name", "path", "order_no", "serial", "model", "year", "client", "grp", "order_date", "notes")})
        docs = self._project_facets()
        pages = self.pages()
        projects = docs.where("project is not null").select("project").distinct()
        return linkage.link_register(rows, projects, linkage.number_evidence(docs, pages), self.machines(), linkage.year_spans(docs))

    def project_cards(self, register: str | None = None, folder: str | None = None, name: str | None = None) -> DataFrame:
        """(project, part, place, line) of all projects, or of those with a name; register: a CSV, folder: knowledge cards."""
        docs = self._project_facets()
        if register is not None:
            rows = self.register(register)
        else:
            rows = self.spark.createDataFrame([], "project string, reg_project string, name string, client string, grp string, country string, year int")
        names = docs.where("project is not null").select("project", F.lit(None).cast("string").alias("parent")).distinct()
        names = names.unionByName(docs.where("subproject is not null").select(F.col("subproject").alias("project"), F.col("project").alias("parent")).distinct())
        parsed = cards.parse_cards(files.read_cards(self.spark, folder)) if folder is not None else None
        none = self.spark.createDataFrame([], "project string, parent string, card string, note string")
        written = none if parsed is None else cards.written_card(parsed, names)
        votes = linkage.number_evidence(docs, self.pages())
        machines = linkage.describe_machines(self.machines())
        out = reports.project_cards(docs, rows, machines, votes, written)
        return out if name is None else out.where(text.ascii_lower(F.col("project")) == name.lower())

    def register_summary(self, path: str) -> DataFrame:
        return reports.register_summary(self.register(path))

    def catalog(self, folder: str, **wanted) -> DataFrame:
        """The readable cards of a folder that satisfy the filters of cards.catalog()."""
        return cards.catalog(cards.parse_cards(files.read_cards(self.spark, folder)), **wanted)

    def catalog_coverage(self, folder: str) -> DataFrame:
        return cards.coverage(cards.parse_cards(files.read_cards(self.spark, folder)), self._project_facets().select("project"))

    def pictures(self) -> DataFrame:
        """(doc_id, page_no, image_no, sha1, image) of the pictures in the indexed files: what describe() takes."""
        if self.root is None:
            raise ValueError("an index without a root has no files")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files.literal(self.root))
        rows = files.picture_rows(found.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*files.PICTURES, ".docx", ".pptx", ".pdf")))
        return rows.join(self.docs().select("path", "doc_id"), "path").drop("path")

    def list_folder(self, folder: str, limit: int = 200) -> DataFrame:
        """(name, is_folder, docs) directly in a folder, folders first."""
        rest = F.expr(f"substring(path_key, {len(folder.rstrip('/')) + 2})")
        inside = self.docs().where(filters.in_folder("path_key", folder)).select(F.split(rest, "/").alias("p"))
        each = inside.groupBy(F.get("p", F.lit(0)).alias("name"), (F.size("p") > 1).alias("is_folder")).agg(F.count("*").alias("docs"))
        return each.orderBy(~F.col("is_folder"), "name").limit(min(max(limit, 1), 1000))

    def list_projects(self, name: str | None = None, limit: int = 100) -> DataFrame:
        return reports.list_projects(self.facets().join(self.docs().select("doc_id", "mtime"), "doc_id"), name, limit)

    def overview(self) -> dict[str, DataFrame]:
        """Documents by status and type, and histograms of the facets that the profile has."""
        shown = [c for c in ("collection", "section", "doc_type", "category", "language") if c in self.facets().columns]
        return {"status": self.status(), **{c: reports.histogram(self.facets(), c) for c in shown}}

    def world_map(self, title: str = "corpus", note: str | None = None) -> list[str]:
        """The folder tree as lines within the character budget; note: a text file that goes before, if it can be read."""
        if note is not None:
            try:
                with open(note, encoding="utf-8") as f:
                    before = f.read().strip().splitlines()
            except OSError as e:
                before = [f"(no map text: {e})"]
            return [*before, *self.world_map(title)]
        parts = facets.path_parts(F.col("path"))
        rows = self.facets().select(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("parts"))
        total = rows.count()
        least = 1 if total < 1000 else 5
        return reports.tree_lines(reports.folder_tree(reports.folder_counts(rows, F.col("parts")), least), title, total)

    def status(self) -> DataFrame:
        tables = self.tables
        chunks = self.chunks()
        if tables.has("vectors"):
            chunks = chunks.join(tables.read("vectors").select("chunk_id", F.lit(True).alias("embedded")), "chunk_id", "left")
        else:
            chunks = chunks.withColumn("embedded", F.lit(False))
        return reports.index_status(self.docs(), chunks, tables.read("ocr") if tables.has("ocr") else None)

    def problems(self, offset: int = 0, limit: int = 50) -> DataFrame:
        return reports.problems(self.docs().select("path", "status", "error"), offset, limit)

    def check_cards(self, folder: str, vocabulary: DataFrame | None = None) -> DataFrame:
        """All issues of the knowledge cards in a folder."""
        words = vocabulary if vocabulary is not None else self.spark.createDataFrame([], "kind string, value string, synonym string")
        rows = self._project_facets()
        return cards.check(cards.parse_cards(files.read_cards(self.spark, folder)), words, rows.select("path_key", "project", "mtime"), rows.select("project").where("project is not null"))
