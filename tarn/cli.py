"""Command line: match, search, ask, read, index, status. ``python -m tarn.cli --help``.

Models are named as ``module:function``: an embedder (texts to vectors), a scorer
(queries and texts to numbers), a chat function (messages to a reply).
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarn")
    top.add_argument("--notes", help="a folder of Markdown files; that of the active snapshot if left out")
    top.add_argument("--root", default=".tarn")
    top.add_argument("--json", action="store_true", help="one JSON object a line")
    for name in ("embedder", "scorer", "chat"):
        top.add_argument(f"--{name}", metavar="MODULE:FUNCTION")
    sub = top.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match", help="literal or pattern in live notes")
    m.add_argument("query")
    m.add_argument("--regex", action="store_true")
    m.add_argument("--ignore-case", action="store_true")
    m.add_argument("--target", choices=("content", "source"), default="content")
    s = sub.add_parser("search", help="ranked chunks of the active snapshot")
    s.add_argument("query")
    s.add_argument("--mode", choices=("bm25", "lexical", "semantic", "hybrid"), default="bm25")
    s.add_argument("--rerank", action="store_true")
    for p in (m, s):
        p.add_argument("--source")
        p.add_argument("--top-k", type=int, default=5)
    a = sub.add_parser("ask", help="a bounded run of the chat model with match, search and read")
    a.add_argument("question")
    a.add_argument("--max-turns", type=int, default=8)
    r = sub.add_parser("read", help="a live note or part of it")
    r.add_argument("source")
    r.add_argument("--start", type=int)
    r.add_argument("--end", type=int)
    i = sub.add_parser("index", help="build a snapshot")
    i.add_argument("--force", action="store_true")
    sub.add_parser("status", help="the active snapshot, from saved metadata")
    return top


def function(name: str | None):
    """What ``module:function`` names."""
    if name is None:
        return None
    module, _, own = name.partition(":")
    try:
        return getattr(importlib.import_module(module), own)
    except (ImportError, AttributeError, ValueError) as error:
        raise ValueError(f"no such function: {name}") from error


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    args = parser().parse_args(argv)
    out = out or sys.stdout
    from tarn.api import Engine
    from tarn.session import session

    try:
        engine = Engine(spark or session(), args.notes, args.root, function(args.embedder), function(args.scorer))
        if args.command == "match":
            rows = [r.asDict() for r in engine.match(args.query, args.regex, args.ignore_case, args.target, args.source, args.top_k).collect()]
        elif args.command == "search":
            rows = [r.asDict() for r in engine.search(args.query, args.mode, args.rerank, args.source, args.top_k).collect()]
        elif args.command == "ask":
            if args.chat is None:
                raise ValueError("ask needs a chat function")
            run = engine.ask(args.question, function(args.chat), args.max_turns)
            rows = [{"answer": run.answer, "stop_reason": run.stop_reason, "calls": len(run.events)}]
        elif args.command == "read":
            rows = [engine.read(args.source, args.start, args.end)]
        elif args.command == "index":
            rows = [engine.index(args.force)]
        else:
            rows = [engine.status()]
    except (ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    for row in rows:
        if args.json or args.command in ("ask", "index", "status"):
            print(json.dumps(row, ensure_ascii=False, sort_keys=True, default=str), file=out)
        else:
            score = f"  {row['score']:.6f}" if row.get("score") is not None else ""
            print(f"{row['source']} [{row.get('start_char')}, {row.get('end_char')}){score}\n  {row['content'][:200]}", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
