"""Model payloads and tool output: JSON extraction and repair, validation, diagnostics.

Texts that parse are told by built-in functions; the repair of others is a stack machine over characters, so it is an Arrow
UDF. Validation and normalisation are built-in.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scoring import tool_severity

_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S | re.I)
_TRAILING = re.compile(r",\s*([}\]])")


def extract_json(raw: str | None) -> str | None:
    """The fenced block, or from the first opening bracket to the last closing one of its kind, without trailing commas."""
    if not raw or not raw.strip():
        return None
    body = m[1].strip() if (m := _FENCE.search(raw)) else raw.strip()
    opens = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if not opens:
        return None
    start = min(opens)
    end = body.rfind("}" if body[start] == "{" else "]")
    body = body[start : end + 1] if end > start else body[start:]
    while re.match(r"\{\s*\{", body):
        body = body[body.index("{") + 1 :].lstrip()
    return _TRAILING.sub(r"\1", body)


def close_truncated(body: str) -> str | None:
    """A truncated text cut after its last complete value and closed; null if its brackets balance already."""
    stack: list[str] = []
    last: tuple[int, list[str]] | None = None
    quoted = escaped = False
    for i, c in enumerate(body):
        if quoted:
            escaped = c == "\\" and not escaped
            if c == '"' and not escaped:
                quoted = body[i - 1] == "\\" and _odd(body, i)
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if c == "}":
                last = i + 1, stack[:]
    if not stack and not quoted:
        return None
    if not last:
        return None
    return body[: last[0]] + "".join(reversed(last[1]))


def _odd(body: str, at: int) -> bool:
    n = 0
    while at - 1 - n >= 0 and body[at - 1 - n] == "\\":
        n += 1
    return n % 2 == 1


def parse_loosely(raw: str | None) -> str | None:
    """The payload's text as it parses strictly: as it is, with single quotes as double, closed, or both; null if none parses."""
    body = extract_json(raw)
    if body is None:
        return None
    quotes = body.replace("'", '"')
    for attempt in (body, quotes, close_truncated(body), close_truncated(quotes)):
        if attempt is not None:
            try:
                json.loads(plain := _TRAILING.sub(r"\1", attempt))
                return plain
            except ValueError:
                continue
    return None


def strict(raw: Column) -> Column:
    """What parse_loosely gives where nothing is cut off, by built-in functions: the first of the text as it is and with single
    quotes as double that parses as a variant; null if neither does."""
    then = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  x is worked out once, not at each use
    fence = r"(?si)```(?:json)?\s*\n?(.*?)```"
    whole = F.when(raw.rlike(fence), F.regexp_extract(raw, fence, 1)).otherwise(raw)
    cut = lambda x: F.when(x.startswith("{"), F.regexp_extract(x, r"(?s)^(.*\})", 1)).otherwise(F.regexp_extract(x, r"(?s)^(.*\])", 1))
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?:\{\s*)+(?=\{)", ""), r",\s*([}\]])", "$1")
    # A parser stops after the first value: as the one item of a list, and with as many brackets closed as opened, it is all.
    bare = lambda x: F.regexp_replace(x, r'"(?:\\.|[^"\\])*"', "")
    even = lambda x: F.length(F.regexp_replace(bare(x), r"[^\{\[]", "")) == F.length(F.regexp_replace(bare(x), r"[^\}\]]", ""))
    alone = lambda x: F.size(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<variant>")) == 1
    good = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull() & F.coalesce(alone(x), F.lit(False)) & even(x), x)
    body = then(F.regexp_extract(whole, r"(?s)([\{\[].*)", 1), lambda x: tidy(cut(x)))
    return then(body, lambda x: F.coalesce(good(x), good(F.translate(x, "'", '"'))))


def repaired(df: DataFrame, raw: str, name: str = "json") -> DataFrame:
    """df with the payload's JSON text. Only texts that don't parse as they are go to Python, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parse_loosely)

    tried = df.withColumn(name, strict(F.col(raw)))
    left = tried.where(F.col(name).isNull())
    return tried.where(F.col(name).isNotNull()).unionByName(left.withColumn(name, run(raw)))


FINDING = "struct<severity: string, category: string, title: string, message: string, file: string, startLine: int, endLine: int, confidence: double, suggestedFix: string, reviewer: string>"


def findings_of(payloads: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, ok, finding…): the payload's findings, whether wrapped, a bare list or a single one. One bad finding makes the
    whole payload invalid: it gives one row with ok false and no finding."""
    fixed = repaired(payloads.select(key, raw), raw, "_j").select(key, "_j")
    wrapped = F.from_json("_j", f"struct<findings: array<{FINDING}>>")["findings"]
    bare = F.from_json("_j", f"array<{FINDING}>")
    single = F.array(F.from_json("_j", FINDING))
    parsed = fixed.select(key, F.when(F.col("_j").startswith("["), bare).when(F.get_json_object("_j", "$.findings").isNotNull(), wrapped).when(F.get_json_object("_j", "$.severity").isNotNull(), single).alias("_f"))
    good = lambda f: (
        f["severity"].isin(*vocab.SEVERITIES) & f["category"].isin(*vocab.CATEGORIES) & (F.length(f["title"]) > 0) & (F.length(f["file"]) > 0) & (f["startLine"] >= 1) & f["confidence"].between(0, 1)
    )
    ok = F.coalesce(F.forall("_f", lambda f: F.coalesce(good(f), F.lit(False))), F.lit(False))
    out = parsed.select(key, ok.alias("ok"), F.explode_outer(F.when(ok, F.col("_f"))).alias("f"))
    return out.select(key, "ok", "f.*")


#: Places of each tool's fields in its JSON: file, line, column, severity, message, rule. Fixed values of the tools' formats.
FIELDS = {
    "tsc": ("fileName", "start.line", "start.character", "category", "messageText", "code"),
    "biome": ("filePath", "location.start.line", "location.start.column", "severity", "message", "rule.id"),
    "ruff": ("filename", "location.row", "location.column", "code", "message", "code"),
    "mypy": ("file", "line", "column", "severity", "message", "code"),
    "pyright": ("file", "range.start.line", "range.start.character", "severity", "message", "rule"),
    "bandit": ("filename", "line_number", None, "severity", "issue_text", "test_id"),
    "pytest": ("nodeid", "lineno", None, "outcome", "message", None),
}


def normalize_diagnostics(raw: DataFrame) -> DataFrame:
    """(id, tool, json) to (id, file, line, col, severity, message, source, rule); what isn't actionable is dropped."""

    def field(k: int):
        out = F.lit(None).cast("string")
        for tool, names in FIELDS.items():
            if names[k]:
                out = F.when(F.col("tool") == tool, F.get_json_object("json", "$." + names[k])).otherwise(out)
        return out

    zero = F.when(F.col("tool") == "pyright", 1).otherwise(0)
    line, col = (F.coalesce(field(k).cast("int"), F.lit(1) - zero) + zero for k in (1, 2))
    severity = F.when(F.col("tool") == "ruff", F.substring(field(3), 1, 1)).otherwise(field(3))
    file = F.when(F.col("tool") == "pytest", F.substring_index(field(0), "::", 1)).otherwise(field(0))
    df = raw.where(F.col("tool").isin(*FIELDS)).select("id", file.alias("file"), F.greatest(F.lit(1), line).alias("line"), F.greatest(F.lit(0), col).alias("col"), tool_severity(F.col("tool"), F.coalesce(severity, F.lit(""))).alias("severity"), field(4).alias("message"), F.col("tool").alias("source"), field(5).alias("rule"))
    noise = F.contains("message", F.lit("Found")) | F.contains("message", F.lit("errors")) | F.contains("message", F.lit("warnings"))
    return df.where((F.length("file") > 0) & (F.length("message") > 0) & ~noise)


def roles(diagnostics: DataFrame) -> DataFrame:
    """Adds for_security, for_test and for_rest; a row may be for several reviewers."""
    low = F.lower(F.concat_ws(" ", "source", "rule", "message"))
    security = low.rlike("(bandit|security|injection|secret|vulnerab)")
    test = low.rlike("(pytest|jest|test)")
    return diagnostics.withColumns({"for_security": security, "for_test": test, "for_rest": ~test})


def repair_prompt(issues: Column) -> Column:
    """The text that asks a model to mend its payload: a line for each element of an array of struct<path, message>."""
    lines = F.transform(issues, lambda x: F.concat(F.lit("- Field '"), F.when(F.length(F.coalesce(x["path"], F.lit(""))) > 0, x["path"]).otherwise("root"), F.lit("': "), x["message"]))
    return F.concat(F.lit("The last JSON answer doesn't fit the schema. Mend these fields and answer with valid JSON:\n"), F.array_join(lines, "\n"))


def issues_of(payload: Column) -> Column:
    """array<struct<path, message>>: what FINDING misses in a payload (JSON text of one finding)."""
    f = F.from_json(payload, FINDING)
    rules = (
        ("severity", f["severity"].isin(*vocab.SEVERITIES), "must be one of " + ", ".join(vocab.SEVERITIES)),
        ("category", f["category"].isin(*vocab.CATEGORIES), "must be one of " + ", ".join(vocab.CATEGORIES)),
        ("title", F.length(f["title"]) > 0, "must not be empty"),
        ("file", F.length(f["file"]) > 0, "must not be empty"),
        ("startLine", f["startLine"] >= 1, "must be 1 or more"),
        ("confidence", f["confidence"].between(0, 1), "must be between 0 and 1"),
    )
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("path"), F.lit(say).alias("message"))) for name, ok, say in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def finding_schema() -> str:
    """The JSON schema of a list of findings, made from the same enumerations that validate them."""
    text, number = {"type": "string"}, {"type": "integer", "minimum": 1}
    filled = {"type": "string", "minLength": 1}
    evidence = {"type": "object", "required": ["file", "startLine", "endLine"], "properties": {"file": filled, "startLine": number, "endLine": number, "relationship": text, "explanation": text}}
    properties = {
        "severity": {"enum": list(vocab.SEVERITIES)}, "category": {"enum": list(vocab.CATEGORIES)}, "title": filled, "message": filled, "file": filled, "startLine": number, "endLine": number,
        "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "evidence": {"type": "array", "items": evidence}, "relatedFiles": {"type": "array", "items": text}, "relatedSymbols": {"type": "array", "items": text},
        "impact": text, "suggestedFix": text, "reviewer": text,
    }
    needed = ["severity", "category", "title", "message", "file", "startLine", "endLine", "confidence"]
    return json.dumps({"type": "object", "required": ["findings"], "properties": {"findings": {"type": "array", "items": {"type": "object", "required": needed, "properties": properties}}}})


def on_target(files: DataFrame, tool: str) -> DataFrame:
    """files (path) that a tool reads: of its extensions and inside the repository."""
    p = F.col("path")
    ends = reduce(lambda a, b: a | b, [F.lower(p).endswith(e) for e in vocab.TOOL_EXTENSIONS[tool]])
    return files.where(ends & ~p.startswith("/") & ~F.exists(F.split(p, "/"), lambda x: x == ".."))
