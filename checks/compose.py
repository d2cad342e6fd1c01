"""SQL text assembly: prepend the fixtures and steps a statement names."""

from __future__ import annotations

import re

from checks.fixtures import FIXTURES

STEPS: dict[str, str] = {}


def with_fixtures(sql: str) -> str:
    """``sql`` with a WITH clause holding every fixture and step it needs, in dependency order."""
    known = {**FIXTURES, **STEPS}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:fx|st)_\w+", text):
            if name in known and name not in ordered:
                visit(known[name])
                ordered.append(name)

    visit(sql)
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in ordered)
    return f"WITH {ctes}\n{sql}" if ctes else sql
