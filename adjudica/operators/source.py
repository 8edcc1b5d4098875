"""Facts from source text: imports, heritage, symbols, signatures, and the resolution of import specifiers.

Imports, heritage and resolution are built-in expressions over lines; Python symbols need Python's own parser, so they
are an Arrow map over files.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_JS_FROM = r"""^\s*(?:import|export)\s+(?:type\s+)?(.*?)\s*from\s+['"]([^'"]+)['"]"""
_JS_BARE = r"""^\s*import\s+['"]([^'"]+)['"]"""
_JS_REQUIRE = r"""^\s*(?:const|let|var)\s+(.*?)\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\)"""
_PY_FROM = r"^\s*from\s+([.\w]+)\s+import\s+(.+)$"
_PY_IMPORT = r"^\s*import\s+([\w., ]+?)\s*(?:#.*)?$"


def imports(files: DataFrame) -> DataFrame:
    """(path, line, specifier, name, alias, is_default, is_namespace) of files (path, content): one row for each name imported."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "s")).withColumn("py", F.col("path").endswith(".py"))
    get = lambda p, g: F.regexp_extract("s", p, g)
    js = ~F.col("py")
    spec = (
        F.when(js & F.col("s").rlike(_JS_FROM), get(_JS_FROM, 2))
        .when(js & F.col("s").rlike(_JS_BARE), get(_JS_BARE, 1))
        .when(js & F.col("s").rlike(_JS_REQUIRE), get(_JS_REQUIRE, 2))
        .when(F.col("py") & F.col("s").rlike(_PY_FROM), get(_PY_FROM, 1))
    )
    what = F.when(js & F.col("s").rlike(_JS_FROM), get(_JS_FROM, 1)).when(js & F.col("s").rlike(_JS_REQUIRE), get(_JS_REQUIRE, 1)).when(F.col("py") & F.col("s").rlike(_PY_FROM), F.regexp_replace(get(_PY_FROM, 2), r"[()]|#.*$", "")).otherwise("")
    named = rows.where(spec.isNotNull()).select("path", (F.col("n") + 1).alias("line"), "py", spec.alias("specifier"), what.alias("what"))
    inside = F.regexp_extract("what", r"\{(.*)\}", 1)
    head = F.trim(F.regexp_replace(F.regexp_replace("what", r"\{.*\}", ""), r"\* as \w+", ""))
    star = F.regexp_extract("what", r"\* as (\w+)", 1)
    item = lambda name, alias, default, space: F.struct(name.alias("name"), alias.alias("alias"), F.lit(default).alias("is_default"), F.lit(space).alias("is_namespace"))
    split_as = lambda x: item(F.trim(F.regexp_extract(x, r"^\s*(?:type\s+)?([\w$*]+)", 1)), F.coalesce(F.nullif(F.regexp_extract(x, r"\bas\s+([\w$]+)", 1), F.lit("")), F.regexp_extract(x, r"^\s*(?:type\s+)?([\w$*]+)", 1)), False, False)
    members = F.filter(F.split(F.when(F.col("py"), F.col("what")).otherwise(inside), ","), lambda x: F.length(F.trim(x)) > 0)
    default = F.regexp_replace(F.regexp_replace(head, ",", ""), r"\s", "")
    parts = F.concat(
        F.transform(members, split_as),
        F.when(~F.col("py") & (F.length(default) > 0), F.array(item(F.lit("default"), default, True, False))).otherwise(F.array().cast("array<struct<name:string,alias:string,is_default:boolean,is_namespace:boolean>>")),
        F.when(F.length(star) > 0, F.array(item(F.lit("*"), star, False, True))).otherwise(F.array().cast("array<struct<name:string,alias:string,is_default:boolean,is_namespace:boolean>>")),
    )
    found = named.select("path", "line", "specifier", F.explode_outer(parts).alias("p")).select("path", "line", "specifier", "p.*")
    plain = rows.where(F.col("py") & F.col("s").rlike(_PY_IMPORT)).select("path", (F.col("n") + 1).alias("line"), F.explode(F.split(get(_PY_IMPORT, 1), ",")).alias("x"))
    module = F.regexp_extract("x", r"^\s*([\w.]+)", 1)
    alias = F.coalesce(F.nullif(F.regexp_extract("x", r"\bas\s+(\w+)", 1), F.lit("")), module)
    return found.unionByName(plain.select("path", "line", module.alias("specifier"), F.lit("*").alias("name"), alias.alias("alias"), F.lit(False).alias("is_default"), F.lit(True).alias("is_namespace")))


def heritage(files: DataFrame) -> DataFrame:
    """(path, line, name, relation, base): classes' and interfaces' extends and implements clauses, one row for each base."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "s"))
    js = r"\b(?:class|interface)\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+([\w.,\s<>]+?))?(?:\s+implements\s+([\w.,\s<>]+?))?\s*\{"
    py = r"^\s*class\s+(\w+)\s*\(([^)]*)\)\s*:"
    bases = lambda c, rel: F.transform(F.filter(F.split(F.regexp_replace(c, "<[^>]*>", ""), ","), lambda x: F.length(F.trim(x)) > 0), lambda x: F.struct(F.lit(rel).alias("relation"), F.trim(x).alias("base")))
    is_py = F.col("path").endswith(".py")
    name = F.when(is_py, F.regexp_extract("s", py, 1)).otherwise(F.regexp_extract("s", js, 1))
    all_ = F.when(is_py, bases(F.regexp_extract("s", py, 2), "extends")).otherwise(F.concat(bases(F.regexp_extract("s", js, 2), "extends"), bases(F.regexp_extract("s", js, 3), "implements")))
    return rows.select("path", (F.col("n") + 1).alias("line"), name.alias("name"), F.explode(all_).alias("b")).where("name <> ''").select("path", "line", "name", "b.*")


SYMBOLS = "path string, name string, kind string, start_line int, end_line int, parent string, exported boolean, signature string, docstring string"


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions, methods and classes of Python files (path, content). A file that doesn't parse has none. Names without a
    leading underscore at the top level count as exported; the parent is the innermost enclosing symbol."""

    def of(path: str, content: str) -> list[tuple]:
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError, RecursionError):
            return []
        lines, out = content.split("\n"), []

        def walk(node, parent: str | None, in_class: bool) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    is_class = isinstance(child, ast.ClassDef)
                    kind = "class" if is_class else "method" if in_class else "function"
                    head = " ".join(x.strip() for x in lines[child.lineno - 1 : child.lineno + 2])
                    head = head[: head.index(":") + 1] if ":" in head else head
                    out.append((path, child.name, kind, child.lineno, child.end_lineno, parent, parent is None and not child.name.startswith("_"), head[:120], ast.get_docstring(child)))
                    walk(child, child.name, is_class)
                else:
                    walk(child, parent, in_class)

        walk(tree, None, False)
        return out

    def run(rows):
        for batch in rows:
            found = [s for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) if c for s in of(p, c)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in SYMBOLS.split(", ")])

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInArrow(run, SYMBOLS)


#: Suffixes that complete a specifier, in the order they are tried. Fixed values.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py")


def _joined(folder: Column, relative: Column) -> Column:
    """folder/relative with '..' taken back: each leading '../' drops one segment of the folder."""
    ups = F.size(F.split(relative, r"\.\./")) - 1
    rest = F.regexp_replace(F.regexp_replace(relative, r"^(\.\./)+", ""), r"^(\./)+", "")
    parts = F.filter(F.split(folder, "/"), lambda x: (F.length(x) > 0) & (x != "."))
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(0)))
    return F.array_join(F.concat(kept, F.array(rest)), "/")


def resolve_imports(found: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, workspaces: DataFrame | None = None) -> DataFrame:
    """Adds resolved (null if external), is_external and is_workspace to imports (path, specifier).

    Candidates in order: relative, alias, workspace package, Python package path; each completed by the suffixes, and a
    .js specifier also tried as .ts. The first candidate that is a known file wins. Candidates are rows with a priority,
    so the lookup is one equi-join with the files.
    """
    rows = found.select("path", "specifier").distinct()
    folder, spec = text.dirname(F.col("path")), F.col("specifier")
    py = F.col("path").endswith(".py")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    tail = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    roots = [F.when(py & (dots > 0), _joined(folder, F.concat(F.repeat(F.lit("../"), dots - 1), tail))), F.when(~py & spec.startswith("."), _joined(folder, spec))]
    for prefix, target in (aliases or {}).items():
        roots.append(F.when(spec.startswith(prefix), F.concat(F.lit(target), F.substring(spec, len(prefix) + 1, F.length(spec)))))
    if workspaces is not None:
        own = workspaces.select(F.col("name").alias("_pkg"), F.col("path").alias("_at"))
        rows = rows.withColumn("_pkg", text.package_name(spec)).join(own, "_pkg", "left")
        inside = F.substring(spec, F.length("_pkg") + 2, F.length(spec))
        roots.append(F.when(F.col("_at").isNotNull(), F.when(F.length(inside) > 0, F.concat_ws("/", "_at", inside)).otherwise(F.concat(F.col("_at"), F.lit("/src/index")))))
    roots.append(F.when(py & (dots == 0), F.translate(spec, ".", "/")))
    complete = lambda r: F.concat(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(r, s)), F.array(F.regexp_replace(r, r"\.js$", ".ts")))
    every = F.filter(F.flatten(F.array(*[F.when(r.isNotNull(), complete(r)).otherwise(F.array().cast("array<string>")) for r in roots])), lambda x: x.isNotNull())
    mine = F.lit(False) if workspaces is None else F.col("_at").isNotNull()
    tried = rows.select("path", "specifier", mine.alias("is_workspace"), F.posexplode_outer(every).alias("k", "candidate"))
    known = files.select(F.col("path").alias("candidate"), F.lit(True).alias("_known"))
    hits = tried.join(known, "candidate", "left").groupBy("path", "specifier", "is_workspace").agg(F.min(F.when(F.col("_known"), F.struct("k", "candidate"))).alias("_h"))
    return hits.select("path", "specifier", F.col("_h.candidate").alias("resolved"), (F.col("_h").isNull() & ~F.col("is_workspace")).alias("is_external"), "is_workspace")


def call_edges(found: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, kind): the file of an import calls the exported symbol of that name in the file it resolves to."""
    exported = symbols.where("exported").select(F.col("path").alias("resolved"), "name", text.symbol_id(F.col("path"), F.col("name"), F.col("kind")).alias("dst"))
    return found.join(resolved, ["path", "specifier"]).join(exported, ["resolved", "name"]).select(F.col("path").alias("src"), "dst", F.lit("calls").alias("kind"))


def mentions(content: Column, name: Column, start: Column, end: Column) -> Column:
    """Whether the name stands as a word in the lines start to end."""
    part = F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return F.rlike(part, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), text.escape_regex(name), F.lit(r"(?![A-Za-z0-9_])")))
