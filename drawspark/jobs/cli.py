"""The command line: one command a stage.  ``python -m drawspark.jobs.cli --root FOLDER COMMAND``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from drawspark.jobs.config import Config, Paths
from drawspark.jobs.stages import Run, pipeline, summary_text
from drawspark.operators.validation import ValidationError
from drawspark.session import session
from drawspark.sources.web import WebError

BY_GAME = {"build-features": "build_features", "train": "train", "register": "register", "predict-next": "predict_next"}
WHOLE = {"scrape": "scrape", "ingest": "ingest", "validate": "validate", "evaluate": "evaluate", "log": "reconcile", "reconcile": "reconcile", "replay": "replay"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="drawspark")
    out.add_argument("--root", default=os.environ.get("DRAWSPARK_ROOT", "."))
    out.add_argument("--log-level", default="INFO")
    commands = out.add_subparsers(dest="command", required=True)
    for name in [*WHOLE, *BY_GAME, "pipeline", "significance"]:
        p = commands.add_parser(name)
        if name in BY_GAME:
            p.add_argument("--juego", default="todos")
        if name == "evaluate":
            p.add_argument("--n-sims", type=int)
        if name == "pipeline":
            p.add_argument("--force", action="store_true")
            p.add_argument("--web", action="store_true")
            p.add_argument("--no-ingest", action="store_true")
        if name == "significance":
            p.add_argument("--quick", action="store_true")
    return out


def main(argv: list[str] | None = None, run: Run | None = None) -> int:
    """The exit code: 0, or 1 with a line of explanation for failures that are foreseen."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level)
    changes = {}
    if getattr(args, "n_sims", None):
        changes["n_sims"] = args.n_sims
    if getattr(args, "web", False):
        changes["web"] = True
    if getattr(args, "no_ingest", False):
        changes["ingest"] = False
    run = run or Run(session(), Paths(args.root), Config.from_env(**changes))
    try:
        if args.command == "pipeline":
            print(summary_text(pipeline(run, args.force)))
        elif args.command == "significance":
            run.significance({"permutacion": 10, "sintetico": 20} if args.quick else {"permutacion": 200, "sintetico": 1000})
        elif args.command in BY_GAME:
            for game in run.games() if args.juego == "todos" else [args.juego]:
                getattr(run, BY_GAME[args.command])(game)
        else:
            getattr(run, WHOLE[args.command])()
    except (ValidationError, WebError, FileNotFoundError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
