"""Snapshots of files: tree differences, line diffs, unified diff parsing, content filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from .intervals import coalesce_lines, islands

def tree_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, status) of paths whose object or mode differ between two trees (path, oid, mode). No rename detection."""
    a = base.select("path", F.col("oid").alias("base_oid"), F.col("mode").alias("base_mode"), F.lit(True).alias("_a"))
    b = head.select("path", F.col("oid").alias("head_oid"), F.col("mode").alias("head_mode"), F.lit(True).alias("_b"))
    both = a.join(b, "path", "full_outer")
    same = F.col("base_oid").eqNullSafe(F.col("head_oid")) & F.col("base_mode").eqNullSafe(F.col("head_mode")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").otherwise("modified")
    return both.where(~same).select("path", status.alias("status"), "base_oid", "head_oid")


def status_matrix(head: DataFrame, workdir: DataFrame, index: DataFrame) -> DataFrame:
    """(path, head, workdir, stage) codes: 0 absent, 1 as in head, 2 as in the working tree, 3 neither."""
    h, w, s = (d.select("path", F.col("oid").alias(n)) for d, n in ((head, "_h"), (workdir, "_w"), (index, "_s")))
    all_ = h.join(w, "path", "full_outer").join(s, "path", "full_outer")
    work = F.when(F.col("_w").isNull(), 0).when(F.col("_w").eqNullSafe(F.col("_h")), 1).otherwise(2)
    stage = F.when(F.col("_s").isNull(), 0).when(F.col("_s").eqNullSafe(F.col("_h")), 1).when(F.col("_s").eqNullSafe(F.col("_w")), 2).otherwise(3)
    return all_.select("path", F.when(F.col("_h").isNull(), 0).otherwise(1).alias("head"), work.alias("workdir"), stage.alias("stage"))


def _split_point(a: list[int], b: list[int], box: tuple[int, int, int, int]) -> tuple[int, int] | None:
    """A point of a shortest edit path through the box (a from, a to, b from, b to), found from both ends at once; None if
    the path goes along the box's edges, that is, if nothing in it is common.

    Furthest-reaching points on each diagonal are kept for the current number of edits only, so space is linear.
    """
    a0, a1, b0, b1 = box
    n, m = a1 - a0, b1 - b0
    ahead, behind = {0: 0}, {0: 0}

    def grow(reach: dict[int, int], edits: int, same) -> None:
        fresh = {}
        for k in range(-min(edits, m), min(edits, n) + 1):
            if (k + edits) % 2:
                continue
            if edits == 0:
                x = 0
            else:
                down = reach.get(k + 1, -1)  # a line of b is added
                x = down if down >= 0 and down - k <= m else -1
                right = reach.get(k - 1, -1)  # a line of a is removed
                if 0 <= right < n and right + 1 > x:
                    x = right + 1
                if x < 0:
                    continue
            y = x - k
            while x < n and y < m and same(x, y):
                x, y = x + 1, y + 1
            fresh[k] = x
        reach.update(fresh)

    for edits in range(n + m + 1):
        grow(ahead, edits, lambda x, y: a[a0 + x] == b[b0 + y])
        for k, x in ahead.items():
            back = behind.get(n - m - k)
            if back is not None and x + back >= n and (k + edits) % 2 == 0:
                return (a0 + x, b0 + x - k) if 0 < x + (x - k) < n + m else None
        grow(behind, edits, lambda x, y: a[a1 - 1 - x] == b[b1 - 1 - y])
        for k, x in behind.items():
            front = ahead.get(n - m - k)
            if front is not None and x + front >= n and (k + edits) % 2 == 0:
                u, v = n - x, m - (x - k)
                return (a0 + u, b0 + v) if 0 < u + v < n + m else None
    return None


def line_operations(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(' ', '-' or '+', line) of a shortest edit script; between two common lines, removals stand before additions.

    Lines that stand on one side only can't be common, so they are left out first; the rest is divided at points of a
    shortest path, in linear space.
    """
    number: dict[str, int] = {}
    left, right = ([number.setdefault(x, len(number)) for x in side] for side in (old, new))
    both = set(left) & set(right)
    at_a, at_b = ([i for i, x in enumerate(side) if x in both] for side in (left, right))
    a, b = [left[i] for i in at_a], [right[i] for i in at_b]
    common: list[tuple[int, int]] = []
    boxes = [(0, len(a), 0, len(b))]
    while boxes:
        a0, a1, b0, b1 = boxes.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            common.append((at_a[a0], at_b[b0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            common.append((at_a[a1], at_b[b1]))
        if a0 < a1 and b0 < b1 and (point := _split_point(a, b, (a0, a1, b0, b1))):
            x, y = point
            boxes += [(a0, x, b0, y), (x, a1, y, b1)]
    out: list[tuple[str, str]] = []
    i = j = 0
    for x, y in [*sorted(common), (len(old), len(new))]:
        out += [("-", line) for line in old[i:x]] + [("+", line) for line in new[j:y]]
        if x < len(old):
            out.append((" ", old[x]))
        i, j = x + 1, y + 1
    return out


def logical_lines(source: str | None) -> list[str]:
    """Lines; a trailing newline doesn't make another."""
    if not source:
        return []
    parts = source.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def mode_lines(old: str | None, new: str | None, old_mode: str | None, new_mode: str | None) -> list[str]:
    """What a diff says of file modes, below its +++ line; a null text is an absent file."""
    if old is None and new_mode is not None:
        return [f"new file mode {new_mode}"]
    if new is None and old_mode is not None:
        return [f"deleted file mode {old_mode}"]
    if None not in (old_mode, new_mode) and old_mode != new_mode:
        return [f"old mode {old_mode}", f"new mode {new_mode}"]
    return []


def unified(path: str, old: str | None, new: str | None, context: int = 3, old_mode: str | None = None, new_mode: str | None = None) -> str:
    """Unified diff of two texts; null is an absent file. Empty if they are equal."""
    ops = line_operations(logical_lines(old), logical_lines(new))
    changed = [k for k, (op, _) in enumerate(ops) if op != " "]
    if not changed:
        return ""
    spans: list[list[int]] = []
    for k in changed:
        a, b = max(0, k - context), min(len(ops), k + context + 1)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out = [f"--- {'/dev/null' if old is None else 'a/' + path}", f"+++ {'/dev/null' if new is None else 'b/' + path}", *mode_lines(old, new, old_mode, new_mode)]
    before = [0, 0]
    at = 0
    for a, b in spans:
        for op, _ in ops[at:a]:
            before[0] += op != "+"
            before[1] += op != "-"
        part = ops[a:b]
        sizes = sum(op != "+" for op, _ in part), sum(op != "-" for op, _ in part)
        starts = [x + (1 if s else 0) for x, s in zip(before, sizes, strict=True)]
        out.append(f"@@ -{starts[0]},{sizes[0]} +{starts[1]},{sizes[1]} @@")
        out += [op + line for op, line in part]
        before = [x + s for x, s in zip(before, sizes, strict=True)]
        at = b
    return "\n".join(out)


def with_diff(pairs: DataFrame) -> DataFrame:
    """Adds ``diff`` to (path, old, new and, if there, old_mode, new_mode). Python, as the edit path has no built-in form."""
    modes = [F.col(c) if c in pairs.columns else F.lit(None).cast("string") for c in ("old_mode", "new_mode")]

    @F.pandas_udf("string")
    def run(path: pd.Series, old: pd.Series, new: pd.Series, old_mode: pd.Series, new_mode: pd.Series) -> pd.Series:
        return pd.Series([unified(p, o, n, 3, x, y) for p, o, n, x, y in zip(path, old, new, old_mode, new_mode, strict=True)])

    return pairs.withColumn("diff", run("path", "old", "new", *modes))


_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, path, side, line): every added ('+', new numbering) and deleted ('-', old numbering) line of unified diffs (key, diff).

    The file of a line is that of the last +++ header before it (the --- header's for deletions of whole files); numbers
    run on from the hunk's header.
    """
    rows = diffs.select(F.col(key), F.posexplode(F.split("diff", "\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    name = lambda prefix: F.regexp_extract("line", rf"^{prefix} (?:[ab]/)?(.*)$", 1)
    hunk = F.col("line").rlike(_HUNK)
    rows = rows.withColumns(
        {
            "_old": F.last(F.when(F.col("line").startswith("--- "), name("---")), ignorenulls=True).over(w),
            "_new": F.last(F.when(F.col("line").startswith("+++ "), name(r"\+\+\+")), ignorenulls=True).over(w),
            "_h": F.sum(hunk.cast("int")).over(w),
            "_a": F.last(F.when(hunk, F.regexp_extract("line", _HUNK, 1).cast("int")), ignorenulls=True).over(w),
            "_b": F.last(F.when(hunk, F.regexp_extract("line", _HUNK, 3).cast("int")), ignorenulls=True).over(w),
        }
    )
    op = F.substring("line", 1, 1)
    body = rows.where((F.col("_h") > 0) & ~hunk & ~F.col("line").startswith("--- ") & ~F.col("line").startswith("+++ ") & ~F.col("line").startswith("diff --git"))
    h = Window.partitionBy(key, "_h").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    body = body.withColumns({"_ob": F.coalesce(F.sum(op.isin(" ", "-").cast("int")).over(h), F.lit(0)), "_nb": F.coalesce(F.sum(op.isin(" ", "+").cast("int")).over(h), F.lit(0))})
    path = F.when(F.col("_new") == "/dev/null", F.col("_old")).otherwise(F.col("_new"))
    return body.where(op.isin("+", "-")).select(F.col(key), path.alias("path"), op.alias("side"), F.when(op == "+", F.col("_b") + F.col("_nb")).otherwise(F.col("_a") + F.col("_ob")).alias("line"))


def diff_intervals(diffs: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, path, side, start, end): runs of added and of deleted lines."""
    return coalesce_lines(diff_lines(diffs, key), [key, "path", "side"], "line")


def context_windows(lines: DataFrame, key: list[str], line: str, context: int = 3) -> DataFrame:
    """(key, start, end): changed lines with so many lines around them, windows that meet or touch as one."""
    spans = lines.select(*key, (F.col(line) - context).alias("_a"), (F.col(line) + context + 1).alias("_b"))
    met = islands(spans, key, "_a", "_b", ["_a"])
    return met.groupBy(*key, "island").agg(F.greatest(F.lit(1), F.min("_a")).alias("start"), (F.max("_b") - 1).alias("end")).drop("island")


def file_hunks(diffs: DataFrame, wanted: DataFrame, key: str = "diff_id") -> DataFrame:
    """wanted (key, path) with ``hunks``: the hunk lines of that file in its diff (key, diff), as text; a path is met as it is, or
    where one ends in the other at a folder. Empty if there are none."""
    plain = lambda p: F.regexp_replace(F.regexp_replace(p, r"\\\\", "/"), r"^\.?/", "")
    rows = diffs.select(F.col(key), F.posexplode(F.split("diff", r"\r?\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("line").rlike("^diff --git a/.+? b/.+"), F.regexp_extract("line", "^diff --git a/.+? b/(.+)$", 1)).when(F.col("line").rlike(r"^\+\+\+ ."), F.trim(F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+)$", 1)))
    rows = rows.withColumns({"_h": named, "_file": F.last(plain(named), True).over(w)})
    rows = rows.where(F.col("_h").isNull() & F.col("_file").isNotNull() & F.col("line").rlike(r"^(@@|[-+ \\])"))
    whole = rows.groupBy(key, "_file").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("_l"))
    asked = wanted.select(key, "path").distinct().withColumn("_p", plain(F.col("path")))
    inside = (F.col("_file") == F.col("_p")) | F.endswith("_file", F.concat(F.lit("/"), "_p")) | F.endswith("_p", F.concat(F.lit("/"), "_file"))
    met = asked.join(whole, key).where(inside & (F.trim("path") != "")).groupBy(key, "path").agg(F.array_sort(F.flatten(F.collect_list("_l"))).alias("_l"))
    text_ = F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return asked.select(key, "path").join(met.select(key, "path", text_.alias("hunks")), [key, "path"], "left").withColumn("hunks", F.coalesce("hunks", F.lit("")))


def filter_sections(diffs: DataFrame, paths: DataFrame, key: str = "diff_id") -> DataFrame:
    """Only the sections of diffs whose path is in paths, joined again."""
    rows = diffs.select(F.col(key), F.posexplode(F.split("diff", "\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum(F.col("line").startswith("--- ").cast("int")).over(w))
    path = F.max(F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:[ab]/)?(.*)$", 1)))
    sections = rows.groupBy(key, "_s").agg(path.alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    kept = sections.join(paths.select("path").distinct(), "path", "left_semi")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "body"))), lambda x: x["body"]), "\n").alias("diff"))


def verdict(path: Column, content: Column, max_bytes: int = 10 * 1024 * 1024) -> Column:
    """Why a file isn't analysed: large, binary or generated; null if it is. Null content (a deleted file) passes."""
    head = F.substring(content, 1, 8192)
    control = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F]", ""))
    lines = F.split(content, "\n")
    marked = F.exists(F.slice(lines, 1, 50), lambda x: x.rlike(r"(?i)^\s*(" + "|".join(vocab.GENERATED_HEADERS) + ")"))
    long = (F.size(lines) < 100) & F.exists(lines, lambda x: F.length(x) > 500)
    ext = F.lower(path)
    generated = ext.endswith(".d.ts") | text.is_generated_path(path) | path.rlike(vocab.MINIFIED) | marked | long
    return (
        F.when(content.isNull(), None)
        .when(F.octet_length(content) > max_bytes, "large")
        .when((F.instr(content, "\x00") > 0) | (control > 0.3 * F.length(head)), "binary")
        .when(generated, "generated")
    )
