"""Prompt text: templates, fenced code, the diagnostics section. Templates are a run's parameter; the rest are columns."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import extension

_SECTION = re.compile(r"\{\{#(\w+)\}\}(.*?)\{\{/\1\}\}", re.S)
_VALUE = re.compile(r"\{\{(\w+)\}\}")

#: Fence labels by extension; fixed values.
FENCES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python", ".json": "json", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml"}


def render(template: str, values: Mapping[str, object]) -> str:
    """{{key}} and {{#list}}...{{.}}...{{/list}}, in one pass; lists elsewhere are joined by newlines, unknown keys are empty."""

    def section(m: re.Match) -> str:
        items = values.get(m[1]) or []
        items = items if isinstance(items, (list, tuple)) else [items]
        return "".join(m[2].replace("{{.}}", str(x)) for x in items)

    def value(m: re.Match) -> str:
        x = values.get(m[1], "")
        return "\n".join(map(str, x)) if isinstance(x, (list, tuple)) else "" if x is None else str(x)

    parts, at = [], 0
    for m in _SECTION.finditer(template):
        parts += [_VALUE.sub(value, template[at : m.start()]), section(m)]
        at = m.end()
    return "".join([*parts, _VALUE.sub(value, template[at:])])


def fence(path: Column, content: Column) -> Column:
    """The content as a labelled fence that its own backticks can't end."""
    label = F.lit("")
    for ext, name in FENCES.items():
        label = F.when(F.lower(extension(path)) == ext, name).otherwise(label)
    return F.concat(F.lit("```"), label, F.lit("\n"), F.regexp_replace(content, "```", "'''"), F.lit("\n```"))


def diagnostics_section(rows: Column) -> Column:
    """One line for each element of an array of struct<severity, file, line, source, message>."""
    return F.array_join(F.transform(rows, lambda d: F.concat(F.lit("- ["), F.upper(d["severity"]), F.lit("] "), d["file"], F.lit(":"), d["line"].cast("string"), F.lit(" ("), d["source"], F.lit("): "), d["message"])), "\n")


#: Templates by name; a run's folder of templates goes first.
BUILT_IN = {
    "reviewer.structural.v1": "Review the structure of this change.\n{{rules}}\n{{diff}}",
    "reviewer.semantic.v1": "Review the behaviour of this change.\n{{rules}}\n{{diff}}",
    "reviewer.security.v1": "Review the security of this change.\n{{rules}}\n{{diff}}",
    "critic.v1": "Keep only findings that hold.\n{{findings}}\n{{diff}}",
}
_LOADED: dict[tuple[str, str | None], str] = {}


def load(name: str, folder: str | None = None) -> str:
    """A template: remembered, or from a file of the folder, or built in."""
    if (name, folder) not in _LOADED:
        path = Path(folder, f"{name}.md") if folder else None
        if path and path.is_file():
            _LOADED[name, folder] = path.read_text()
        elif name in BUILT_IN:
            _LOADED[name, folder] = BUILT_IN[name]
        else:
            raise KeyError(f"no template {name!r}")
    return _LOADED[name, folder]
