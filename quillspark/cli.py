"""Command line: quillspark INDEX COMMAND ... (python -m quillspark.cli)."""

from __future__ import annotations

import argparse
from functools import partial

from quillspark import server
from quillspark.api import PROFILES, CorpusIndex
from quillspark.session import build_session
from quillspark.sources.models import ModelClient, lazy


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description="Index a tree of documents and ask questions about it.")
    p.add_argument("index", help="folder of the index")
    p.add_argument("--root", help="tree that is indexed")
    p.add_argument("--profile", choices=sorted(PROFILES), help="facet rules")
    p.add_argument("--thesaurus", help="TOML file of concepts")
    c = p.add_subparsers(dest="command", required=True)
    x = c.add_parser("index", help="bring the index up to date")
    x.add_argument("--retry-errors", action="store_true")
    x = c.add_parser("embed", help="make the vectors that are missing")
    x.add_argument("--reset", action="store_true")
    x = c.add_parser("update", help="index, then embed")
    x.add_argument("--retry-errors", action="store_true")
    x = c.add_parser("describe", help="ask a model server about the pictures")
    x.add_argument("--url", default="http://127.0.0.1:11434")
    x.add_argument("--model", required=True)
    x.add_argument("--prompt", default="Describe this picture.")
    x.add_argument("--max-minutes", type=float)
    x = c.add_parser("card", help="what there is to say about a project")
    x.add_argument("name")
    x.add_argument("--register")
    x.add_argument("--cards")
    x = c.add_parser("register", help="a register CSV, linked with the projects")
    x.add_argument("path")
    x.add_argument("--summary", action="store_true")
    x = c.add_parser("catalog", help="knowledge cards that fit")
    x.add_argument("folder")
    x.add_argument("--status")
    x.add_argument("--text")
    x.add_argument("--coverage", action="store_true")
    x = c.add_parser("live", help="a folder of the tree against the index")
    x.add_argument("folder")
    x = c.add_parser("serve", help="answer the same operations over HTTP, on this machine only")
    x.add_argument("--port", type=int, default=8765)
    x = c.add_parser("search")
    x.add_argument("text")
    x.add_argument("--limit", type=int, default=10)
    x.add_argument("--mode", choices=("hybrid", "keyword", "semantic"), default="hybrid")
    x.add_argument("--folder")
    x.add_argument("--type", dest="file_type")
    x.add_argument("--after")
    x = c.add_parser("files", help="find files by name")
    x.add_argument("name")
    x = c.add_parser("read")
    x.add_argument("path")
    x.add_argument("--start-page", type=int, default=1)
    x.add_argument("--end-page", type=int)
    x = c.add_parser("find", help="find a text in one document")
    x.add_argument("path")
    x.add_argument("text")
    x = c.add_parser("list", help="contents of a folder")
    x.add_argument("folder")
    x = c.add_parser("projects")
    x.add_argument("name", nargs="?")
    c.add_parser("map")
    c.add_parser("status")
    c.add_parser("problems")
    x = c.add_parser("check-cards")
    x.add_argument("folder")
    return p


def _client(url: str, model: str, prompt: str):
    return ModelClient(url, model, prompt).describe


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = build_session("quillspark-cli")
    text = None
    if a.thesaurus:
        with open(a.thesaurus, encoding="utf-8") as f:
            text = f.read()
    index = CorpusIndex(spark, a.index, a.root, a.profile, thesaurus=text)
    if a.command == "index":
        print(*(f"{n} {k}" for k, n in sorted(index.index(retry_errors=a.retry_errors).items())), sep="\n")
    elif a.command == "embed":
        print(f"{index.embed(a.reset)} chunks")
    elif a.command == "update":
        print(*(f"{n} {k}" for k, n in sorted(index.index(retry_errors=a.retry_errors).items())), f"{index.embed()} embedded", sep="\n")
    elif a.command == "describe":
        make = partial(_client, a.url, a.model, a.prompt)
        print(*(f"{n} {k}" for k, n in sorted(index.describe(index.pictures(), lazy(make), a.model, minutes=a.max_minutes).items())), sep="\n")
    elif a.command == "serve":
        server.serve(index, a.port)
    elif a.command == "map":
        print(*index.world_map(), sep="\n")
    elif a.command == "check-cards":
        errors = 0
        for i in index.check_cards(a.folder).orderBy("file", "level", "message").toLocalIterator():
            print(f"{i.file}: {i.level}: {i.message}")
            errors += i.level == "error"
        return int(errors > 0)
    else:
        frame = {
            "search": lambda: index.search(a.text, a.limit, a.mode, a.folder, a.file_type, a.after),
            "files": lambda: index.find_files(a.name),
            "read": lambda: index.read_document(a.path, a.start_page, a.end_page),
            "find": lambda: index.find_in_document(a.path, a.text),
            "list": lambda: index.list_folder(a.folder),
            "projects": lambda: index.list_projects(a.name),
            "status": index.status,
            "problems": index.problems,
            "card": lambda: index.project_cards(a.register, a.cards, a.name).orderBy("part", "place"),
            "register": lambda: index.register_summary(a.path) if a.summary else index.register(a.path),
            "catalog": lambda: index.catalog_coverage(a.folder) if a.coverage else index.catalog(a.folder, status=a.status, text=a.text),
            "live": lambda: index.live_folder(a.folder),
        }[a.command]()
        frame.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
