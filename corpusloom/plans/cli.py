"""A thin command line: collect, diff, snapshot, store, manifest, benchmark, validate, presets, and what is set up around a tree."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
import time
from pathlib import Path

from corpusloom.operators.splitting import default_tokens
from corpusloom.plans import collect as C
from corpusloom.plans import presets, setup
from corpusloom.plans.api import Engine
from corpusloom.plans.profiles import MODES, doctor, load_config, write_defaults
from corpusloom.session import local_session, ship
from corpusloom.sources import writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    top.add_argument("--root", default=".")
    commands = top.add_subparsers(dest="command", required=True)
    profiled = argparse.ArgumentParser(add_help=False)
    profiled.add_argument("--profile", default="full")
    profiled.add_argument("--format", choices=("markdown", "xml", "json"))
    profiled.add_argument("--max-tokens", type=int)
    profiled.add_argument("--line-numbers", action="store_true", default=None)
    profiled.add_argument("--allow-commands", action="store_true")
    one = commands.add_parser("collect", parents=[profiled])
    one.add_argument("--mode", choices=MODES, default="full")
    one.add_argument("--query")
    one.add_argument("--output-dir")
    one.add_argument("--compress", action="store_true", default=None)
    one.add_argument("--merge", action="store_true")
    one.add_argument("--dry-run", action="store_true")
    one.add_argument("--all", action="store_true")
    one.add_argument("--incremental", action="store_true")
    one.add_argument("--clean", action="store_true")
    one.add_argument("--list", action="store_true")
    one.add_argument("--validate", action="store_true")
    one.add_argument("--remote")
    one.add_argument("--verbose", action="store_true")
    one = commands.add_parser("diff", parents=[profiled])
    one.add_argument("--from", dest="start")
    one.add_argument("--to")
    one.add_argument("--mode", choices=("full", "structural", "scopes", "repo-map"), default="full")
    one.add_argument("--flat", action="store_true")
    one.add_argument("--stats", action="store_true")
    one.add_argument("--all", action="store_true")
    one.add_argument("--query")
    one.add_argument("--compress", action="store_true", default=None)
    one = commands.add_parser("snapshot", parents=[profiled])
    one.add_argument("action", choices=("create", "list", "update", "delete", "info", "rename"))
    one.add_argument("id", nargs="?")
    one.add_argument("new_id", nargs="?")
    commands.add_parser("store").add_argument("action", choices=("stats", "gc"))
    commands.add_parser("validate")
    one = commands.add_parser("init")
    one.add_argument("--preset")
    one.add_argument("--interactive", action="store_true")
    commands.add_parser("presets").add_argument("--url")
    commands.add_parser("manifest").add_argument("--json", action="store_true")
    one = commands.add_parser("benchmark", parents=[profiled])
    one.add_argument("--query")
    one = commands.add_parser("hook")
    one.add_argument("--run", default=setup.HOOK_COMMAND)
    one.add_argument("--force", action="store_true")
    commands.add_parser("completion").add_argument("shell", choices=setup.SHELLS)
    one = commands.add_parser("plugins")
    one.add_argument("action", choices=("list", "install", "uninstall"))
    one.add_argument("name", nargs="?")
    one.add_argument("--run", action="store_true")
    return top


def _profile(engine: Engine, args: argparse.Namespace, name: str | None = None):
    given = {"section_format": args.format, "max_tokens": args.max_tokens, "line_numbers": args.line_numbers, "compress": getattr(args, "compress", None)}
    return dataclasses.replace(engine.profile(name or args.profile), **{k: v for k, v in given.items() if v is not None})


def _names(engine: Engine, args: argparse.Namespace) -> list[str]:
    return sorted(engine.config.profiles) or ["full"] if args.all else [args.profile]


def _collect(engine: Engine, args: argparse.Namespace) -> int:
    """One profile, or all; with metrics and a summary beside the parts."""
    folder = engine.root / (args.output_dir or engine.config.output_dir)
    if args.list:
        for name in sorted(engine.config.profiles):
            p = engine.profile(name)
            print(f"{name}: {'a command' if p.command else f'{len(p.directories)} folders, {len(p.files)} files'}, {p.max_tokens} tokens a part")
        return 0
    if args.clean:
        print("\n".join(writers.clean(folder)))
        return 0
    names, how = _names(engine, args), {"mode": args.mode, "text_query": args.query}
    profiles = {name: _profile(engine, args, name) for name in names}
    together = {name: p for name, p in profiles.items() if p.command is None} if args.all and not args.incremental and not args.remote else {}
    whole = C.collect_all(engine.spark, engine.root, together, allow_commands=args.allow_commands, **how) if len(together) > 1 else None
    if args.all and not args.dry_run:
        writers.clean(folder)
    for name, profile in profiles.items():
        began = time.time()
        if whole is not None and name in together:
            found = C.of_profile(whole, name)
        elif args.remote:
            found = engine.collect_remote(args.remote, None if args.profile == "full" else profile, **how)
        else:
            found = engine.collect(profile, args.incremental, allow_commands=args.allow_commands, **how)
        if args.dry_run:
            for line in C.in_line(C.dry_run(found, profile.max_tokens)):
                print(line)
            continue
        print("\n".join(C.write(found, folder, profile, engine.config.project_name, args.merge)))
        writers.write_lines(folder / f"{profile.name_template}-manifest.md", C.manifest_lines(found))
        writers.write_metrics(folder, C.metrics(found, began))
        engine.after(profile, args.allow_commands)
    if args.verbose:
        for name, profile in profiles.items():
            if profile.command is None and not args.remote:
                for r in C.left_out(C.scanned(engine.spark, engine.root, dataclasses.replace(profile, exclude_patterns=tuple(C.excludes(profile, engine.root)))), profile).orderBy("path").toLocalIterator():
                    print(f"left out of {name}: {r.path} ({r.reason})", file=sys.stderr)
    return 0


#: What the parts of a collection of the whole project are called.
WHOLE = "chat-diff-all"


def _whole(engine: Engine, args: argparse.Namespace) -> int:
    """``diff --all``: the whole project as it is, in parts of their own."""
    if args.start:
        print("--all takes no --from: it collects the whole project", file=sys.stderr)
        return 1
    profile = dataclasses.replace(_profile(engine, args), name_template=WHOLE)
    found = engine.collect(profile, mode=args.mode if args.mode in MODES else "full", text_query=args.query)
    print("\n".join(C.write(found, engine.root / engine.config.output_dir, profile, engine.config.project_name)) or "nothing to collect")
    return 0


def _diff(engine: Engine, args: argparse.Namespace) -> int:
    if args.all:
        return _whole(engine, args)
    counts, sections = engine.diff(_profile(engine, args), args.start, args.to, args.format or "markdown", args.mode, args.flat, bool(args.line_numbers), args.allow_commands)
    if args.stats:
        print(json.dumps(counts))
        return 0
    for row in sections.orderBy(*(["type"] if args.flat else ["rank"]), "path").toLocalIterator():
        sys.stdout.write(row.content + "\n")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    root = Path(args.root)
    if args.command == "validate" or (args.command == "collect" and args.validate):
        found = doctor(load_config(root), root)
        print(json.dumps(found, indent=2))
        return int(any(x["errors"] for x in found))
    if args.command == "presets":
        print("\n".join(presets.detect(root, presets.merged(presets.fetch(args.url)) if args.url else None)))
        return 0
    if args.command == "manifest":
        config = load_config(root)
        print(writers.manifest_report(root / config.output_dir, config.project_name, sorted(config.profiles), default_tokens(), args.json))
        return 0
    if args.command == "hook":
        print(setup.install_hook(root, args.run, args.force))
        return 0
    if args.command == "completion":
        print(setup.completion(args.shell, parser()), end="")
        return 0
    if args.command == "plugins":
        names = [args.name] if args.name else sorted(setup.PLUGINS)
        print("\n".join(f"{n}: {'there' if setup.installed(n) else 'not there'}" if args.action == "list" else setup.change_plugin(n, args.action == "uninstall", args.run) for n in names))
        return 0
    if args.command == "init" and args.interactive:
        print(setup.interactive(root))
        return 0
    if args.command == "init":
        names = presets.detect(root, only=args.preset)
        print(write_defaults(root, {n: presets.to_profile(n, root) for n in names}))
        return 0
    spark = local_session()
    ship(spark)
    engine = Engine(spark, root)
    if args.command == "store":
        print(json.dumps(engine.store.stats() if args.action == "stats" else engine.store.gc()))
        return 0
    if args.command in ("collect", "diff"):
        return (_collect if args.command == "collect" else _diff)(engine, args)
    profile = _profile(engine, args)
    if args.command == "benchmark":
        print("\n".join(C.benchmark_report(C.benchmark(spark, root, profile, args.query))))
    elif args.action == "create":
        print(engine.create_snapshot(profile, args.id, args.allow_commands))
    elif args.action == "update":
        print(engine.update_snapshot(args.id, profile, args.allow_commands))
    elif args.action == "list":
        print("\n".join(m["id"] for m in engine.snapshots()))
    elif args.action == "info":
        print(json.dumps(engine.snapshot_info(args.id), indent=2))
    elif args.action == "rename":
        print(engine.store.rename(args.id, args.new_id))
    else:
        engine.store.delete(args.id)
    return 0


if __name__ == "__main__":
    sys.exit(main())
