"""Settings of an index: a TOML file found upwards from the working folder, else the user's own, else defaults."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

FILE = ".corvidex.toml"


def home() -> Path:
    return Path(os.environ.get("CORVIDEX_HOME", Path.home() / ".corvidex"))


@dataclass(frozen=True)
class EngineConfig:
    # fixed values: the defaults that results depend on
    embed_dims: int = 1536
    max_chunk_chars: int = 2000
    min_chunk_chars: int = 50
    search_threshold: float = 0.001
    ask_threshold: float = 0.001
    rrf_k: float = 60.0
    rerank_fetch_k: int = 20
    rerank_top_k: int = 5
    max_file_size_mb: float = 10
    allowed_large_files: tuple[str, ...] = ()
    index_code: bool = False
    hyde_enabled: bool = True
    query_expand: bool = False
    rerank_method: str = "llm"
    bm25_shortcut_min: float = 0.85
    bm25_shortcut_gap: float = 0.02
    chunk_overlap: bool = False
    sources: tuple[str, ...] = ()
    scope: str = "project"
    # where the settings came from; never written
    folder: Path | None = field(default=None, compare=False)

    @property
    def path(self) -> Path:
        return self.folder / FILE if self.scope == "project" and self.folder else home() / "config.toml"

    @property
    def index_root(self) -> str:
        """One index per project folder, one for the user."""
        name = hashlib.sha256(str(self.folder).encode()).hexdigest()[:12] if self.scope == "project" and self.folder else "default"
        return f"file://{home()}/indexes/{name}"

    def stored_path(self, source: Path, file: Path) -> str:
        """The path a file is indexed under: relative to the project, else to its source's parent, else as it is."""
        file = Path(os.path.abspath(file))
        if self.scope == "project" and self.folder and file.is_relative_to(os.path.abspath(self.folder)):
            return file.relative_to(os.path.abspath(self.folder)).as_posix()
        source = Path(os.path.abspath(source))
        return f"{source.name}/{file.relative_to(source).as_posix()}" if file.is_relative_to(source) else str(file)


_STORED = [f for f in fields(EngineConfig) if f.name not in ("folder", "scope")]


def _read(path: Path, **more) -> EngineConfig:
    given = tomllib.loads(path.read_text())
    known = {f.name: given[f.name] for f in _STORED if f.name in given}  # unknown keys are ignored
    return EngineConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()}, **more)


def find(start: Path | None = None) -> EngineConfig:
    start = Path(os.path.abspath(start or Path.cwd()))
    for folder in (start, *start.parents):
        if (folder / FILE).is_file():
            return _read(folder / FILE, scope="project", folder=folder)
    own = home() / "config.toml"
    return _read(own, scope="global") if own.is_file() else EngineConfig(scope="global")


def save(config: EngineConfig) -> Path:
    """Write the settings that differ from the defaults."""
    changed = {f.name: getattr(config, f.name) for f in _STORED if getattr(config, f.name) != f.default}
    config.path.parent.mkdir(parents=True, exist_ok=True)
    # JSON's scalars and arrays are TOML's
    config.path.write_text("".join(f"{k} = {json.dumps(list(v) if isinstance(v, tuple) else v, ensure_ascii=False)}\n" for k, v in changed.items()))
    return config.path


def create(project: bool, folder: Path | None = None) -> EngineConfig:
    """New settings; FileExistsError if there are some."""
    config = EngineConfig(scope="project", folder=Path(os.path.abspath(folder or Path.cwd()))) if project else EngineConfig(scope="global")
    if config.path.exists():
        raise FileExistsError(str(config.path))
    save(config)
    return config


def with_source(config: EngineConfig, folder: str) -> EngineConfig:
    """The folder added once: as it stands relative to the project, else absolute."""
    full = Path(os.path.abspath(folder if os.path.isabs(folder) or not config.folder else config.folder / folder))
    if not full.is_dir():
        raise NotADirectoryError(folder)
    name = os.path.relpath(full, config.folder) if config.scope == "project" and config.folder else str(full)
    return config if name in config.sources else replace(config, sources=(*config.sources, name))


def without_source(config: EngineConfig, folder: str) -> EngineConfig:
    full = os.path.abspath(folder)
    return replace(config, sources=tuple(s for s in config.sources if s != folder and os.path.abspath(config.folder / s if config.folder else s) != full))


def with_allowed(config: EngineConfig, file: str) -> EngineConfig:
    return config if file in config.allowed_large_files else replace(config, allowed_large_files=(*config.allowed_large_files, file))


def source_folders(config: EngineConfig) -> list[Path]:
    return [Path(s) if os.path.isabs(s) or not config.folder else config.folder / s for s in config.sources]


def load_secrets(path: Path) -> None:
    """Name-value pairs of a TOML file as upper-cased environment variables; those that are set stay."""
    if path.is_file():
        for k, v in tomllib.loads(path.read_text()).items():
            os.environ.setdefault(k.upper(), str(v))
