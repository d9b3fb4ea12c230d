"""Command line: python -m weftgraph [--store FOLDER] COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import stat
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from weftgraph import tools
from weftgraph.plans import queries
from weftgraph.session import get_session
from weftgraph.sources import repository
from weftgraph.sources.store import Store

_HOOK = """#!/bin/sh
# weftgraph: index what the last commit changed
{python} -m weftgraph --store {store} index {root} --repo {repo} --since HEAD~1 || true
"""


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--store", default=os.environ.get("WEFTGRAPH_STORE", "weftgraph-store"))
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index a repository, or the files that git says changed since a commit")
    i.add_argument("root")
    i.add_argument("--repo")
    i.add_argument("--since")
    c = sub.add_parser("call", help="ask one of the questions by name, arguments as JSON")
    c.add_argument("name")
    c.add_argument("arguments", nargs="?", default="{}")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--type", default="all")
    s.add_argument("--limit", default=10)
    sub.add_parser("stats")
    sub.add_parser("list")
    h = sub.add_parser("health", help="exit code 0 only if the graph is there and no repository is stale")
    h.add_argument("--max-hours", type=int, default=24)
    r = sub.add_parser("repair", help="orphans, integrity, and on request their deletion and missing edges")
    r.add_argument("--delete-orphans", action="store_true")
    r.add_argument("--rebuild-edges", action="store_true")
    d = sub.add_parser("remove")
    d.add_argument("repo")
    k = sub.add_parser("hook", help="install or remove the hook that indexes each commit")
    k.add_argument("root")
    k.add_argument("--remove", action="store_true")
    k.add_argument("--repo")
    return p


def install_hook(root: str, store: str, repo: str, remove: bool = False) -> bool:
    """Put the post-commit hook into a git folder, or take it out; a hook of another kind is left alone and gives False."""
    hooks = Path(root) / ".git" / "hooks"
    path = hooks / "post-commit"
    if path.exists() and "weftgraph" not in path.read_text():
        return False
    if remove:
        path.unlink(missing_ok=True)
        return True
    if not hooks.parent.is_dir():
        return False
    hooks.mkdir(exist_ok=True)
    path.write_text(_HOOK.format(python=sys.executable, store=Path(store).resolve(), root=Path(root).resolve(), repo=repo))
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return True


def index(store: Store, root: str, repo_id: str | None = None, since: str | None = None) -> dict:
    """Index a folder, whole or what changed since a commit. The folder must lie under WEFTGRAPH_ROOTS where that is set."""
    root = repository.guarded(root, os.environ.get("WEFTGRAPH_ROOTS"))
    if not Path(root).is_dir():
        raise ValueError(f"{root} is no folder")
    repo_id = repo_id or Path(root).name
    spark = store.spark
    sources = repository.read_repository(spark, root, repo_id)
    repos = spark.createDataFrame([(repo_id, Path(root).name, root, "multi", None, datetime.now())], "repo_id string, name string, path string, language string, description string, last_indexed timestamp")
    if since is None:
        return {"mode": "batch", "version": store.ingest(sources, repos), "repo_id": repo_id}
    changed = repository.supported(repository.git_changes(root, since))
    if not changed:
        return {"mode": "incremental", "version": store.version(), "repo_id": repo_id, "changed": []}
    keys = spark.createDataFrame([(repo_id, x) for x in changed], "repo_id string, path string")
    return {"mode": "incremental", "version": store.update(sources, keys), "repo_id": repo_id, "changed": changed}


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "hook":
        return 0 if install_hook(a.root, a.store, a.repo or Path(a.root).resolve().name, a.remove) else 1
    store = Store(get_session(), a.store)
    if a.command == "index":
        print(json.dumps(index(store, a.root, a.repo, a.since)))
        return 0
    g = store.load()
    if a.command in ("call", "search"):
        name, args = (a.name, json.loads(a.arguments)) if a.command == "call" else ("search_code", {"query": a.query, "type": a.type, "limit": a.limit})
        text, bad = tools.call(g, name, args)
    elif a.command == "stats":
        text, bad = tools.call(g, "get_graph_stats")
    elif a.command == "list":
        text, bad = tools.call(g, "list_repositories")
    elif a.command == "remove":
        bad = not store.remove_repository(a.repo)
        text = json.dumps({"removed": not bad})
    elif a.command == "repair":
        out = {"orphans": store.delete_orphans(dry_run=not a.delete_orphans), "broken": [r.asDict() for r in queries.integrity(store.load()).limit(100).collect()]}
        if a.rebuild_edges:
            out["added"] = store.rebuild_edges()
        text, bad = json.dumps(out), bool(out["broken"])
    else:
        text, bad = tools.call(g, "health_check")
        stale = [r["repo_id"] for r in queries.staleness(g, F.current_timestamp(), a.max_hours).filter("stale").collect()]
        bad = bad or json.loads(text)["status"] != "healthy" or bool(stale)
        text = json.dumps(json.loads(text) | {"stale": stale}, indent=2)
    print(text)
    return int(bad)


if __name__ == "__main__":
    sys.exit(main())
