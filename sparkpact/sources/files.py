"""Statement files, and output files that appear all at once or not at all."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

IGNORED = frozenset({".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", "build", "dist", "target", ".tox"})
MARKER = "# Written by sparkpact from a statement file; changes are lost."


def find_statements(root: str | Path, suffix: str = ".typed.sql") -> list[Path]:
    """Files under ``root`` that end in ``suffix``, sorted; each real file once, ignored folders left out."""
    seen, out = set(), []
    for folder, folders, files in os.walk(root, followlinks=True):
        folders[:] = sorted(d for d in folders if d not in IGNORED)
        real = os.path.realpath(folder)
        if real in seen:
            folders[:] = []
            continue
        seen.add(real)
        for name in sorted(files):
            path = Path(folder, name)
            if name.endswith(suffix) and (target := path.resolve()) not in seen:
                seen.add(target)
                out.append(path)
    return sorted(out)


class OutputError(OSError):
    pass


def stale_outputs(root: str | Path, current: set[Path], suffix: str = "_statement.py") -> list[Path]:
    """Files of ours under ``root`` (by suffix and first line) that no statement gives any more."""
    current = {p.resolve() for p in current}
    out = []
    for path in sorted(Path(root).rglob(f"*{suffix}")):
        if not IGNORED & set(path.parts) and path.resolve() not in current and not path.is_symlink():
            with path.open(encoding="utf-8") as f:
                if f.readline().rstrip() == MARKER:
                    out.append(path)
    return out


def commit_outputs(outputs: dict[Path, str], remove: list[Path] = ()) -> list[Path]:
    """Write all files and remove stale ones, or leave everything as it was. Gives the paths that changed.

    Texts are staged beside their targets, originals are set aside, then staged files are renamed; an error undoes
    the renames. A symbolic link is no target, and two outputs for one file are an error.
    """
    if len({p.resolve() for p in outputs}) < len(outputs):
        raise OutputError("two outputs for one file")
    for p in [*outputs, *remove]:
        if p.is_symlink():
            raise OutputError(f"{p} is a symbolic link")
    tag = uuid.uuid4().hex[:12]
    changed = {p: t for p, t in outputs.items() if not p.exists() or p.read_text(encoding="utf-8") != t}
    staged, saved, placed = {}, {}, []
    try:
        for p, text in changed.items():
            p.parent.mkdir(parents=True, exist_ok=True)
            staged[p] = p.with_name(f".{p.name}.{tag}.new")
            staged[p].write_text(text, encoding="utf-8")
        for p in [*changed, *remove]:
            if p.exists():
                saved[p] = p.with_name(f".{p.name}.{tag}.old")
                p.rename(saved[p])
        for p in changed:
            staged[p].rename(p)
            placed.append(p)
    except BaseException:
        for p in placed:
            p.unlink(missing_ok=True)
        for p, old in saved.items():
            if old.exists():
                old.rename(p)
        for s in staged.values():
            s.unlink(missing_ok=True)
        raise
    for old in saved.values():
        old.unlink(missing_ok=True)
    return [*changed, *remove]
