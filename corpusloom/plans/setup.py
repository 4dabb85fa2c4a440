"""What is set up around a tree: a configuration by questions, a git hook, completion for shells, optional packages."""

from __future__ import annotations

import importlib.util
import shutil
import stat
import subprocess
import sys
from argparse import ArgumentParser, _SubParsersAction
from collections.abc import Callable
from pathlib import Path

from corpusloom.plans import presets
from corpusloom.plans.profiles import write_defaults
from corpusloom.sources.writers import write_text

HOOK_COMMAND = "python -m corpusloom.plans.cli collect --all"
SHELLS = ("bash", "zsh", "fish")
#: Optional packages, by what they add.
PLUGINS = {"tokens": ("tiktoken",), "transformers": ("transformers",)}


def interactive(root: str | Path, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> Path:
    """A configuration from the answers: the project's name, the output folder, and which of the presets found to take."""
    found = presets.detect(root)
    project = ask(f"name of the project [{Path(root).resolve().name}]: ").strip() or Path(root).resolve().name
    folder = ask("folder for the output [context]: ").strip() or "context"
    say("found: " + (", ".join(found) or "nothing that a preset knows"))
    wanted = ask("presets to take, parted by blanks [all]: ").split()
    if unknown := [x for x in wanted if x not in presets.builtin()]:
        raise ValueError(f"no presets {unknown}")
    return write_defaults(root, {n: presets.to_profile(n, root) for n in wanted or found}, project, folder)


def install_hook(root: str | Path, command: str = HOOK_COMMAND, force: bool = False) -> Path:
    """A hook that runs a command after each commit; one that is there stays, unless forced."""
    git = Path(root) / ".git"
    if not git.is_dir():
        raise FileNotFoundError(f"{root} isn't the root of a git repository")
    hook = git / "hooks" / "post-commit"
    if hook.exists() and not force:
        raise FileExistsError(f"{hook} is there already")
    write_text(hook, f"#!/bin/sh\n{command} || true\n")
    hook.chmod(hook.stat().st_mode | stat.S_IRUSR | stat.S_IXUSR | stat.S_IXGRP)
    return hook


def _words(parser: ArgumentParser) -> dict[str, list[str]]:
    """Each command with its options and choices; the empty name has the commands."""
    commands = next(a for a in parser._actions if isinstance(a, _SubParsersAction)).choices
    options = lambda p: [o for a in p._actions for o in a.option_strings] + [c for a in p._actions if not a.option_strings and a.choices for c in a.choices]
    return {"": sorted(commands)} | {name: options(own) for name, own in commands.items()}


def completion(shell: str, parser: ArgumentParser) -> str:
    """A script by which a shell completes the commands and their options."""
    words, prog = _words(parser), parser.prog
    if shell == "fish":
        lines = [f"complete -c {prog} -f -n __fish_use_subcommand -a '{' '.join(words[''])}'"]
        return "\n".join([*lines, *(f"complete -c {prog} -f -n '__fish_seen_subcommand_from {name}' -a '{' '.join(own)}'" for name, own in words.items() if name)]) + "\n"
    if shell not in SHELLS:
        raise ValueError(f"no completion for {shell!r}; there is one for {', '.join(SHELLS)}")
    cases = "".join(f"    {name}) words='{' '.join(own)}' ;;\n" for name, own in words.items() if name)
    head = "autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else ""
    return (
        f"{head}_{prog}() {{\n  local words='{' '.join(words[''])}'\n  [ \"$COMP_CWORD\" -gt 1 ] && case \"${{COMP_WORDS[1]}}\" in\n{cases}  esac\n"
        f"  COMPREPLY=($(compgen -W \"$words\" -- \"${{COMP_WORDS[COMP_CWORD]}}\"))\n}}\ncomplete -F _{prog} {prog}\n"
    )


def installed(plugin: str) -> bool:
    return all(importlib.util.find_spec(p) for p in PLUGINS[plugin])


def plugin_command(plugin: str, remove: bool = False) -> list[str]:
    """What installs or removes a plugin's packages; empty where there is nothing to do."""
    if plugin not in PLUGINS:
        raise KeyError(f"no plugin {plugin!r}; there are {sorted(PLUGINS)}")
    if installed(plugin) != remove:
        return []
    return [sys.executable, "-m", "pip", *(("uninstall", "-y") if remove else ("install",)), *PLUGINS[plugin]]


def change_plugin(plugin: str, remove: bool = False, run: bool = False) -> str:
    """The command that is needed; it is run only if asked."""
    command = plugin_command(plugin, remove)
    if not command:
        return f"{plugin}: nothing to do"
    if run and shutil.which(command[0]):
        subprocess.run(command, check=True)
    return " ".join(command)
