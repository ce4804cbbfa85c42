"""Identifiers and paths as they are written into SQL."""

from __future__ import annotations

import hashlib
import posixpath
import re


def quote(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


def quote_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_parts(quoted: str) -> list[str]:
    """The parts of a name such as ```a`.`b``c```, with the quoting undone."""
    return [part.replace("``", "`") for part in re.findall(r"`((?:[^`]|``)*)`", quoted)]


def database_name(root: str) -> str:
    """A database name that differs whenever the root differs.

    A mounted name keeps the path it was first created with, so two roots must never share one.
    """
    root = root.rstrip("/")
    leaf = re.sub(r"\W+", "_", posixpath.basename(root)).strip("_").lower() or "root"
    return f"lake_{leaf}_{hashlib.sha1(root.encode()).hexdigest()[:8]}"
