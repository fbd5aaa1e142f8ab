"""ABI and pattern files: finding, placeholders, loading. All on the driver; the files are small."""

from __future__ import annotations

import json
import logging
import os
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)

_PLACEHOLDER = re.compile(r"\$\{(\w+)\}")


def find(base: str | Path, suffix: str | None = None, depth: int = 2) -> list[Path]:
    """Files below ``base``, at most ``depth`` folders deep, in order of their path; the suffix is in any case. A file is itself; nothing is an error."""
    base = Path(base)
    if base.is_file():
        return [base]
    if not base.is_dir():
        raise FileNotFoundError(f"no such file or folder: {base}")
    found = (p for p in base.rglob("*") if p.is_file() and len(p.relative_to(base).parts) <= depth + 1)
    return sorted((p for p in found if suffix is None or p.name.lower().endswith(suffix.lower())), key=str)


def substitute(text: str, values: Mapping[str, str] | None = None) -> str:
    """Replace ``${NAME}`` from the mapping, else the environment; one that stays is an error."""
    known = {**os.environ, **(values or {})}
    out = _PLACEHOLDER.sub(lambda m: known.get(m[1], m[0]), text)
    if "${" in out:
        raise ValueError("a placeholder has no value: " + out[out.index("${") :][:60])
    return out


def load(path: str | Path, values: Mapping[str, str] | None = None) -> Any:
    """One JSON file with its placeholders replaced. Errors name the file."""
    try:
        return json.loads(substitute(Path(path).read_text("utf-8"), values))
    except ValueError as e:
        log.error("cannot read %s: %s", path, e)
        raise


def load_all(paths: Iterable[str | Path], values: Mapping[str, str] | None = None) -> list[Any]:
    """The entries of all files, in order; a file holds one entry or a list."""
    out: list[Any] = []
    for p in paths:
        got = load(p, values)
        out += got if isinstance(got, list) else [got]
    return out
