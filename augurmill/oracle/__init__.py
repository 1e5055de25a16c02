"""Loads the DuckDB twin of every query.

Files hold `-- name: x` sections. Sections of views.sql become CTEs of the
queries that mention them. A few short macros keep the texts readable.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

MACROS = {
    "R": "(round({0}, 6) + 0e0)",
    "EPOCH": "cast(floor(epoch({0})) as bigint)",
    "CLIP": "least(1e0 - 1e-6, greatest(1e-6, {0}))",
    "LOGIT": "ln(least(1e0 - 1e-6, greatest(1e-6, {0})) / (1e0 - least(1e0 - 1e-6, greatest(1e-6, {0}))))",
    "SIGMOID": "(1e0 / (1e0 + exp(-({0}))))",
    "HASH": "cast(concat('0x', substr(sha256({0}), 1, 8)) as bigint)",
    "DAYNUM": "cast(floor(({0}) / 86400e0) as bigint)",
    "H": "(cast(concat('0x', substr({0}, 1, 8)) as bigint) % 2147483647)",
    "G": "(cast(concat('0x', substr({0}, 9, 8)) as bigint) % 2147483647)",
    "FIFTH": "((({0}) * ({0}) % 2147483647) * (({0}) * ({0}) % 2147483647) % 2147483647 * ({0}) % 2147483647)",
    # how many of the Poisson(1) cumulative probabilities 0..11 are not above a number
    "POISSON": " + ".join("cast({0} >= %r as integer)" % sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)),
    "I": "cast({0} as bigint)",
}


def _expand(text: str) -> str:
    pattern = re.compile(r"(?<![A-Za-z0-9_.])(" + "|".join(MACROS) + r")\(")
    while True:
        hit = pattern.search(text)
        if not hit:
            return text
        depth, i = 1, hit.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        inner = text[hit.end():i - 1]
        text = text[:hit.start()] + MACROS[hit.group(1)].format(inner) + text[i:]


def _sections(path: Path) -> dict[str, str]:
    parts = re.split(r"^-- name: *(\w+) *$", path.read_text(), flags=re.M)
    bodies = (re.sub(r"^--.*\n", "", b.strip(), flags=re.M).rstrip(";") for b in parts[2::2])
    return dict(zip(parts[1::2], bodies))


def _with_views(body: str, views: dict[str, str]) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, view in views.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in needed)
    head, recursive = re.match(r"(?i)with\s+(recursive\s+)?", body), ""
    if head:
        recursive = "RECURSIVE " if head.group(1) else ""
        body = body[head.end():]
        return f"WITH {recursive}{ctes}{',' if ctes else ''}\n{body}"
    return f"WITH {ctes}\n{body}" if ctes else body


def load() -> dict[str, str]:
    here = Path(__file__).parent
    views = _sections(here / "views.sql")
    own = {name: body for path in sorted(here.glob("*.sql")) if path.name != "views.sql" for name, body in _sections(path).items()}
    # a query may read another one's result as q_<name>
    views |= {f"q_{name}": body for name, body in own.items()}
    return {name: _expand(_with_views(body, views)) for name, body in own.items()}
