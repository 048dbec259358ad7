"""The command line: ``python -m corvidex COMMAND ...``."""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

from . import api, outputs
from . import config as settings
from .errors import EngineError
from .sources import files

USAGE = {
    "init": "[--project]", "add": "DIR...", "remove": "DIR...", "sources": "", "allow": "FILE...", "index": "[DIR...] [--no-size-limit] [--prune]", "search": "QUERY [K] [--threshold N] [--expand|--no-expand] [FORMAT]",
    "fts": "QUERY [K] [FORMAT]", "ask": "QUESTION [K] [--threshold N] [--expand|--no-expand] [FORMAT]", "similar": "FILE [K] [FORMAT]", "tag": "FILE TAG...", "untag": "FILE TAG...", "tags": "", "list": "[--full] [FORMAT]", "stats": "",
    "reset": "", "feedback": "MESSAGE [--severity S] [--tool T] [--context C] [--agent-id A] [--error-trace E] | --list", "completion": "zsh|bash|fish", "serve": "", "version": "", "help": "",
}


class Misused(Exception):
    """The command line cannot be read."""


def _option(args: list[str], name: str) -> tuple[str | None, list[str]]:
    if name not in args:
        return None, args
    at = args.index(name)
    if at + 1 >= len(args):
        raise Misused(f"{name} needs a value")
    return args[at + 1], args[:at] + args[at + 2 :]


def _flag(args: list[str], name: str) -> tuple[bool, list[str]]:
    return name in args, [a for a in args if a != name]


def _query(args: list[str], k: int) -> tuple[str, int]:
    """The query's words and the number of results; a number after the first word is the latter."""
    if not args:
        raise Misused("a query is needed")
    if len(args) > 1 and args[-1].isdigit():
        return " ".join(args[:-1]), int(args[-1])
    return " ".join(args), k


def best_snippet(text: str, query: str, width: int = 500) -> str:
    """A window around the mean first place of the query's words; the same as functions.text.snippet, for one text."""
    if len(text) <= width:
        return text
    low = text.lower()
    at = [p for p in (low.find(w) for w in query.lower().split()) if p >= 0]
    start = max(0, min((sum(at) // len(at) if at else 0) - width // 2, len(text) - width))
    return ("..." if start else "") + text[start : start + width] + ("..." if start + width < len(text) else "")


def readable(n: int) -> str:
    return f"{n / 1e6:.1f} MB" if n >= 1_000_000 else f"{n / 1e3:.1f} KB" if n >= 1000 else f"{n} B"


class App:
    """Commands over one configuration; ``out`` takes text, the engine is made when a command needs it."""

    def __init__(self, make_engine: Callable[[settings.EngineConfig], api.Engine], out: Callable[[str], None] = print, config: settings.EngineConfig | None = None):
        self.make, self.out = make_engine, out
        self._config = config
        self._engine: api.Engine | None = None

    @property
    def config(self) -> settings.EngineConfig:
        if self._config is None:
            self._config = settings.find()
        return self._config

    @property
    def engine(self) -> api.Engine:
        if self._engine is None:
            self._engine = self.make(self.config)
        return self._engine

    def run(self, args: list[str]) -> int:
        name, rest = (args[0], args[1:]) if args else ("help", [])
        if name not in USAGE:
            self.out(f"no command {name}; see help")
            return 1
        try:
            return getattr(self, f"do_{name}")(rest) or 0
        except Misused as e:
            self.out(f"{e}\nusage: {name} {USAGE[name]}")
        except (EngineError, NotADirectoryError) as e:
            self.out(f"{e}")
        return 1

    def _emit(self, form: str | None, kind: str, value: dict, rows: list[dict], text: Callable[[], str]) -> None:
        self.out(outputs.write(value, rows, kind, form).rstrip("\n") if form else f"Config: {self.config.path}\n{text()}")

    # --- settings

    def do_init(self, args):
        project, _ = _flag(args, "--project")
        try:
            self.out(f"wrote {settings.create(project).path}")
        except FileExistsError as e:
            raise EngineError(f"there is one already: {e}") from e

    def _save(self, config: settings.EngineConfig) -> None:
        self._config = config
        self.out(f"wrote {settings.save(config)}")

    def do_add(self, args):
        if not args:
            raise Misused("a folder is needed")
        config = self.config
        for a in args:
            config = settings.with_source(config, a)
        self._save(config)

    def do_remove(self, args):
        if not args:
            raise Misused("a folder is needed")
        config = self.config
        for a in args:
            config = settings.without_source(config, a)
        self._save(config)

    def do_sources(self, args):
        for s, at in zip(self.config.sources, settings.source_folders(self.config)):
            self.out(s if at.is_dir() else f"{s} (missing)")

    def do_allow(self, args):
        if not args:
            raise Misused("a file is needed")
        config = self.config
        for a in args:
            config = settings.with_allowed(config, a)
        self._save(config)

    # --- the index

    def do_index(self, args):
        free, args = _flag(args, "--no-size-limit")
        prune, args = _flag(args, "--prune")
        run = self.engine.index(args or None, free, prune)
        self.out(f"{run.indexed} indexed, {run.unchanged} unchanged, {run.skipped} without text, {run.pruned} dropped; chunks: {run.inserted} new, {run.reused} kept, {run.deleted} gone")
        for suffix, package in files.unavailable().items():
            self.out(f"{suffix} files need {package}")

    def do_reset(self, args):
        self.engine.reset()
        self.out("the index is gone")

    # --- retrieval

    def _wide(self, args):
        yes, args = _flag(args, "--expand")
        no, args = _flag(args, "--no-expand")
        return (True if yes else False if no else None), args

    def do_search(self, args):
        form, args = outputs.take_format(args)
        expand, args = self._wide(args)
        threshold, args = _option(args, "--threshold")
        query, k = _query(args, 5)
        found = self.engine.search(query, k, None if threshold is None else float(threshold), expand)
        text = lambda: "\n\n".join(f"[{r['rank']}] {r['doc_path']}{' > ' + r['heading'] if r['heading'] else ''} ({'+'.join(r['sources'])}, {r['rrf_score']})\n{best_snippet(r['text'], query)}" for r in found["results"]) or "nothing found"
        self._emit(form, "search", found, found["results"], text)

    def do_fts(self, args):
        form, args = outputs.take_format(args)
        query, k = _query(args, 5)
        found = self.engine.fts(query, k)
        text = lambda: "\n\n".join(f"[{r['rank']}] {r['doc_path']}{' > ' + r['heading'] if r['heading'] else ''} ({r['bm25']})\n{best_snippet(r['text'], query)}" for r in found["results"]) or "nothing found"
        self._emit(form, "fts", found, found["results"], text)

    def do_ask(self, args):
        form, args = outputs.take_format(args)
        expand, args = self._wide(args)
        threshold, args = _option(args, "--threshold")
        question, k = _query(args, 8)
        found = self.engine.ask(question, k, None if threshold is None else float(threshold), expand)
        text = lambda: f"{found['answer'] or 'no passage answers that'}\n\n" + "\n".join(f"[{s['rank']}] {s['doc_path']}{' > ' + s['heading'] if s['heading'] else ''}" for s in found["sources"])
        self._emit(form, "ask", found, found["sources"], text)

    def do_similar(self, args):
        form, args = outputs.take_format(args)
        name, k = _query(args, 10)
        found = self.engine.similar(name, k)
        self._emit(form, "similar", found, found["results"], lambda: "\n".join(f"{r['similarity']:.4f}  {r['doc_path']}  {r['title'] or ''}" for r in found["results"]) or "nothing like it")

    # --- the catalog

    def _tag(self, args, how: str):
        if len(args) < 2:
            raise Misused("a file and a tag are needed")
        self.out(f"tags: {self.engine.tag(args[0], **{how: args[1:]})}")

    def do_tag(self, args):
        self._tag(args, "add")

    def do_untag(self, args):
        self._tag(args, "remove")

    def do_tags(self, args):
        for name, n in self.engine.tags():
            self.out(f"{n:6}  {name}")

    def do_list(self, args):
        form, args = outputs.take_format(args)
        full, _ = _flag(args, "--full")
        if form or full:
            found = self.engine.list()
            self._emit(form, "list", found, found["documents"], lambda: "\n".join(f"{(d['indexed_at'] or '')[:10]}  {readable(d['size_bytes']):>9}  {d['chunk_count']:5}  {d['type']}  {d['path']}" for d in found["documents"]))
            return
        for r in self.engine.by_type():
            self.out(f"{r['docs']:7}  {readable(r['bytes']):>9}  {r['chunks']:7}  {r['type']}")

    def do_stats(self, args):
        s = self.engine.stats()
        for k in ("index", "doc_count", "chunk_count", "vec_count", "fts_count", "total_chars", "tokens_estimated"):
            self.out(f"{k}: {s[k]}")
        self.out(f"size: {readable(s['size_bytes'])}")
        for k, n in s["type_counts"].items():
            self.out(f"  {k}: {n}")

    # --- the rest

    def do_feedback(self, args):
        listing, args = _flag(args, "--list")
        if listing:
            for e in api.list_feedback()["entries"]:
                self.out(f"{e['timestamp']} [{e['severity']}] {e['message']}")
            return
        given = {}
        for name in ("severity", "tool", "context", "agent-id", "error-trace"):
            value, args = _option(args, f"--{name}")
            if value is not None:
                given[name.replace("-", "_")] = value
        entry = api.feedback(" ".join(args), **given)
        self.out(f"noted ({entry['severity']})")

    def do_completion(self, args):
        names = " ".join(USAGE)
        scripts = {"bash": f"complete -W '{names}' corvidex", "zsh": f"compdef '_arguments \"1:command:({names})\" \"*:file:_files\"' corvidex", "fish": f"complete -c corvidex -n __fish_use_subcommand -a '{names}'"}
        if not args or args[0] not in scripts:
            raise Misused("the shell is one of zsh, bash, fish")
        self.out(scripts[args[0]])

    def do_serve(self, args):
        from .tool_server import serve

        serve(lambda: self.engine)

    def do_version(self, args):
        self.out(api.engine_version())

    def do_help(self, args):
        self.out("\n".join(f"{n} {u}".rstrip() for n, u in USAGE.items()) + "\nFORMAT is --json, --csv or --md")


def providers() -> api.Providers:
    """What the module and function in CORVIDEX_PROVIDERS (``module:function``) return, else none."""
    named = os.environ.get("CORVIDEX_PROVIDERS")
    if not named:
        return api.Providers()
    module, _, function = named.partition(":")
    return getattr(importlib.import_module(module), function)()


def _engine(config: settings.EngineConfig) -> api.Engine:
    from pyspark.sql import SparkSession

    from .session import ship

    settings.load_secrets(settings.home() / "secrets.toml")
    spark = SparkSession.builder.appName("corvidex").getOrCreate()
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", f"file://{settings.home()}/work")  # one machine
    return api.Engine(ship(spark), config, providers())


def main(args: list[str] | None = None) -> int:
    return App(_engine).run(sys.argv[1:] if args is None else args)
