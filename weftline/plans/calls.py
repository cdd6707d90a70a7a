"""Calls of a program.  Each knows its digest, so one that is used often is hashed, compared, written and evaluated once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

def digest(node: Any) -> str:
    """A sha256 of a call that depends on its structure alone; a ``Call`` knows its own."""
    if isinstance(node, Call):
        return node.key
    parts = [digest(x) if isinstance(x, tuple | list) else json.dumps(x) for x in node]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


class Call(tuple):
    """(name, argument, ...), with ``key``, the digest, and ``reads``: whether an input is somewhere in it."""

    key: str
    reads: bool

    def __new__(cls, items: Iterable[Any]) -> Call:
        made = super().__new__(cls, items)
        made.key = digest(tuple(made))
        made.reads = made[0] in ("input", "drawn") or any(reads(x) for x in made[1:])
        return made

    def __eq__(self, other: object) -> bool:
        return self.key == other.key if isinstance(other, Call) else tuple.__eq__(self, other)

    def __ne__(self, other: object) -> bool:
        return not self == other

    def __hash__(self) -> int:
        return hash(self.key)


def reads(node: Any) -> bool:
    """Whether a node needs an input."""
    if isinstance(node, Call):
        return node.reads
    return isinstance(node, list | tuple) and bool(node) and (node[0] in ("input", "drawn") or any(reads(x) for x in node[1:]))
