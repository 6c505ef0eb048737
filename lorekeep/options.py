"""Options of a run: defaults, then a file of "key: value" lines, then the environment, then arguments."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    input: str = ""
    output: str = ""
    store: str = "warehouse"
    nesting: str = "reference"
    promote: bool = True
    mode: str = "fold"
    form: str = "json"
    label: str = ""
    ids: str = ""
    doc: str = ""
    user: str = ""
    types: str = "Discourse.Types"


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """The text with a leading $NAME put out of the environment; an unknown name stays."""
    env = os.environ if env is None else env
    return re.sub(r"^\$(\w+)", lambda m: env.get(m[1], m[0]), text)


def read_file(text: str) -> dict[str, str]:
    """Keys and values of the lines; blank lines and those after "#" are comments."""
    pairs = (line.split("#", 1)[0].partition(":") for line in text.splitlines())
    return {k.strip(): v.strip().strip("\"'") for k, colon, v in pairs if colon and k.strip()}


def merged(file: dict[str, str], env: dict[str, str], arguments: dict) -> Options:
    """Options of all places; environment names are LOREKEEP_ and the field in capitals."""
    out = Options()
    named = {f.name: f.type for f in fields(Options)}
    from_env = {n: env[f"LOREKEEP_{n.upper()}"] for n in named if f"LOREKEEP_{n.upper()}" in env}
    for place in (file, from_env, {k: v for k, v in arguments.items() if v is not None}):
        unknown = set(place) - set(named)
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        typed = {k: (v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes")) if named[k] == "bool" else expand(str(v), env) for k, v in place.items()}
        out = replace(out, **typed)
    return out
