"""Addresses of sources: [host+]format[+compression][+table|series]:///path[?options], and patterns in paths."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

BUILTIN = {"file", "series", "table", "data"}
COMPRESSIONS = {"zstd": "zst", "gzip": "gz", "bzip2": "bz2"}
ENTRY_TYPES = {"table", "series"}


class Registry:
    """Readers of formats by name, and what kind of scheme a name is."""

    def __init__(self):
        self._readers: dict = {}

    def register(self, name: str, reader=None):
        if reader is None:
            return lambda f: self.register(name, f)
        if name in BUILTIN or name in self._readers:
            raise ValueError(f"{name!r} is taken")
        self._readers[name] = reader
        return reader

    def names(self) -> list[str]:
        return sorted(self._readers)

    def classify(self, name: str) -> str:
        if name in BUILTIN:
            return "builtin"
        if name in self._readers:
            return "format"
        raise ValueError(f"unknown scheme {name!r}")

    def reader(self, name: str):
        self.classify(name)
        return self._readers[name]


FORMATS = Registry()


@dataclass(frozen=True)
class Url:
    format: str
    path: str
    host: bool = False
    compression: str | None = None
    entry_type: str | None = None
    options: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Url:
        match = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://(.*)\Z", text, re.S)
        scheme, rest = match.groups() if match else ("file", text)
        if match and not rest.startswith("/"):
            raise ValueError(f"an address has no authority: {text!r}")
        if "#" in rest:
            raise ValueError(f"an address has no fragment: {text!r}")
        path, _, query = rest.partition("?")
        parts = scheme.lower().split("+")
        host = parts[0] == "host"
        parts = parts[1:] if host else parts
        entry = parts.pop() if len(parts) > 1 and parts[-1] in ENTRY_TYPES else None
        compression = parts.pop() if len(parts) > 1 and parts[-1] in COMPRESSIONS else None
        if len(parts) > 1:
            raise ValueError(f"unknown suffix in {scheme!r}")
        name = parts[0] if parts else "file"
        if name in ENTRY_TYPES:
            name, entry = "file", name
        return cls(name, path, host, compression, entry, dict(parse_qsl(query, keep_blank_values=True)))

    @property
    def is_pattern(self) -> bool:
        return "*" in self.path


def glob_segments(pattern: str) -> list[str]:
    """The parts of a path pattern; `**` stands for any number of directories."""
    parts = [p for p in pattern.split("/") if p]
    if any("**" in p and p != "**" for p in parts):
        raise ValueError(f"** must be a part of its own: {pattern!r}")
    return parts


def _segment_match(pattern: str, name: str) -> list[str] | None:
    """What each * of one part stands for: up to the first place where the text after it occurs, the last one up to the end."""
    first, *rest = pattern.split("*")
    if not name.startswith(first):
        return None
    at, found = len(first), []
    for i, literal in enumerate(rest):
        if not literal and i == len(rest) - 1:
            found.append(name[at:])
            at = len(name)
            continue
        where = name.find(literal, at)
        if where < 0:
            return None
        found.append(name[at:where])
        at = where + len(literal)
    return found if at == len(name) else None


def glob_match(pattern: str, path: str) -> list[str] | None:
    """The captures of a path under a pattern, or None."""

    def walk(ps: list[str], ns: list[str]) -> list[str] | None:
        if not ps:
            return [] if not ns else None
        if ps[0] == "**":
            for n in range(len(ns) + 1):
                later = walk(ps[1:], ns[n:])
                if later is not None:
                    return ["/".join(ns[:n]), *later]
            return None
        if not ns:
            return None
        here = _segment_match(ps[0], ns[0])
        later = walk(ps[1:], ns[1:]) if here is not None else None
        return None if later is None else here + later

    return walk(glob_segments(pattern), [p for p in path.split("/") if p])


def glob_host(pattern: str) -> list[tuple[str, list[str]]]:
    """(path, captures) of the files on this machine that a pattern matches, by path; links are not followed twice."""
    parts = glob_segments(pattern)
    fixed = []
    for p in parts:
        if "*" in p:
            break
        fixed.append(p)
    root = "/" + "/".join(fixed)
    if os.path.isfile(root):
        return [(root, [])]
    found, seen = [], set()
    for folder, inner, names in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:
            inner.clear()
            continue
        seen.add(real)
        for name in names:
            path = f"{folder.rstrip('/')}/{name}"
            captures = glob_match(pattern, path)
            if captures is not None:
                found.append((path, captures))
    return sorted(found)


def out_name(pattern: str, captures: list[str]) -> str:
    """An output name with $0, $1 ... replaced by captures."""

    def one(m: re.Match) -> str:
        if int(m[1]) >= len(captures):
            raise ValueError(f"{pattern!r} has no capture ${m[1]}")
        return captures[int(m[1])]

    return re.sub(r"\$(\d+)", one, pattern)


def group_outputs(pattern: str, found: list[tuple[str, list[str]]]) -> dict[str, list[str]]:
    """Paths by output name: files of one name belong together."""
    out: dict[str, list[str]] = {}
    for path, captures in found:
        out.setdefault(out_name(pattern, captures), []).append(path)
    return out


def substitute_env(text: str, env=None) -> str:
    """${env:NAME} and ${env:NAME:-default} from the environment; $$ is a dollar sign; an unset name without default is an error."""
    env = os.environ if env is None else env

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        if m["name"] in env:
            return env[m["name"]]
        if m["default"] is None:
            raise KeyError(f"{m['name']} isn't set")
        return m["default"]

    return re.sub(r"\$\$|\$\{env:(?P<name>[A-Za-z_]\w*)(?::-(?P<default>[^}]*))?\}", one, text)
