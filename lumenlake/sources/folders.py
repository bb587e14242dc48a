"""Watched source folders: a flat list of paths, none inside another."""

from __future__ import annotations

import ntpath
import posixpath


def _module(path: str):
    return ntpath if "\\" in path or path[1:2] == ":" else posixpath


def normalise(folder: str | None) -> str:
    """No dots, no trailing separator (a root keeps its own); blank stays blank."""
    clean = (folder or "").strip()
    return _module(clean).normpath(clean) if clean else ""


def _fold(path: str) -> str:
    return path.casefold()


def covers(outer: str, inner: str) -> bool:
    """Whether inner is outer or lies in it, ignoring case; /a does not cover /ab."""
    a, b = _fold(outer), _fold(inner)
    separator = _module(outer).sep
    return a == b or b.startswith(a if a.endswith(separator) else a + separator)


def parse(text: str | None) -> list[str]:
    return [line.strip() for line in (text or "").split("\n") if line.strip()]


def to_text(folders: list[str]) -> str:
    return "\n".join(folders)


def add(folders: list[str], folder: str | None) -> list[str]:
    """Unchanged if it is covered already; folders that it covers give way to it."""
    new = normalise(folder)
    if not new or any(covers(normalise(f), new) for f in folders):
        return list(folders)
    return [f for f in folders if not covers(new, normalise(f))] + [new]


def remove(folders: list[str], folder: str) -> list[str]:
    gone = _fold(normalise(folder))
    return [f for f in folders if _fold(normalise(f)) != gone]
