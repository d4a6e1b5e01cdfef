"""Options of a deployment: defaults, overridden by environment variables."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "EVIDENTIA_"
#: Words that switch a flag off.
OFF = ("off", "0", "false", "no")


@dataclass(frozen=True)
class Options:
    """Each field is read from PREFIX and its name in capitals. An empty number or flag counts as unset; lists are cut at commas, blank parts dropped."""

    quota_guard: bool = True
    answers_per_session: int = 8
    answers_per_day: int = 25
    min_seconds: float = 4.0
    rerank: str = "auto"
    rerank_min_mb: int = 1400
    embed_model: str = "Xenova/multilingual-e5-small"
    rerank_model: str = "cross-encoder/mmarco-mMiniLMv2-L12-H384-v1"
    chat_model: str = ""
    fallback_models: tuple[str, ...] = ()
    provider: str = ""
    quota_file: str = ""
    docs_folder: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Options:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is None or (not raw.strip() and not isinstance(f.default, str | tuple)):
                continue
            if isinstance(f.default, bool):
                given[f.name] = raw.strip().lower() not in OFF
            elif isinstance(f.default, int | float):
                given[f.name] = type(f.default)(raw)
            elif isinstance(f.default, tuple):
                given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                given[f.name] = raw.strip().lower() if f.name == "rerank" else raw
        return cls(**given)


def writable_folder(preferred: str, name: str = "evidentia") -> str:
    """The preferred folder if a folder and a file can be made beside it, else one in the system's temporary folder; the preferred one if neither can.

    For state of one machine, such as a quota file; tables belong in a folder that all executors share.
    """
    for path in (Path(preferred), Path(tempfile.gettempdir()) / name):
        probe = path.parent / f".{name}-probe-{os.getpid()}"
        try:
            probe.mkdir(parents=True)
            (probe / "file").write_text("x", encoding="utf-8")
            (probe / "file").unlink()
            probe.rmdir()
        except OSError:
            continue
        return str(path)
    return preferred
