"""Text and path functions on columns. All are built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: ASCII word edges; Java's \b follows Unicode.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with ASCII word edges in the place of \b at its ends."""
    if pattern.startswith(r"\b"):
        pattern = _L + pattern[2:]
    return pattern[:-2] + _R if pattern.endswith(r"\b") else pattern


def normalize_title(title: Column) -> Column:
    """Lower case, synonyms to one form, other characters than a-z, 0-9 and white space to spaces, single spaces."""
    out = F.lower(F.coalesce(title, F.lit("")))
    for alternatives, form in vocab.TITLE_SYNONYMS:
        first = "".join(sorted({a[0] for a in alternatives.split("|")}))  # one look at most places, before edges and words
        out = F.regexp_replace(out, f"(?=[{first}]){_L}({alternatives}){_R}", form)
    # Runs of other characters and white space in one pass; a single space stays as it is.
    return F.trim(F.regexp_replace(out, "[^a-z0-9]{2,}|[^a-z0-9 ]", " "))


def split_identifier(name: Column) -> Column:
    out = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z0-9]+)", "$1 $2")
    return F.regexp_replace(out, r"[_\-.]", " ")


def redact(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement in vocab.REDACTIONS:
        out = F.regexp_replace(out, pattern.replace(r"\b(", f"{_L}(").replace(r")\b", f"){_R}"), replacement)
    return out


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def estimate_tokens(text: Column) -> Column:
    """ceil(ceil(length / 3.8) * 1.1) in doubles; length in code points."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.ceil(F.ceil(F.length(text) / F.lit(3.8)).cast("double") * F.lit(1.1))).cast("int")


def numbered_lines(text: Column, first: Column | int = 1) -> Column:
    """Each line after its number, right-aligned in four places, and ' | '."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lpad((i + first).cast("string"), F.greatest(F.lit(4), F.length((i + first).cast("string"))), F.lit(" ")), F.lit(" | "), x)), "\n")


def window_snippet(text: Column, start: Column, end: Column, radius: int = 10, whole: int = 40) -> Column:
    """The text if it has up to ``whole`` lines, else the lines from start - radius to end + radius with marks of what is left out."""
    lines = F.split(text, "\n")
    low, high = F.greatest(F.lit(1), start - radius), F.least(F.size(lines), end + radius)
    part = F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n")
    head = F.when(low > 1, F.concat(F.lit("... ("), (low - 1).cast("string"), F.lit(" lines omitted)\n"))).otherwise("")
    tail = F.when(high < F.size(lines), F.concat(F.lit("\n... ("), (F.size(lines) - high).cast("string"), F.lit(" lines omitted)"))).otherwise("")
    return F.when(F.size(lines) <= whole, text).otherwise(F.concat(head, part, tail))


def starts_generic(text: Column, words: tuple[str, ...], after: str) -> Column:
    """Whether the trimmed lower-case text is one of the words, or begins with one and a character of ``after``."""
    low = F.lower(F.trim(text))
    tests = [(low == w) | reduce(lambda a, b: a | b, [low.startswith(w + c) for c in after]) for w in words]
    return reduce(lambda a, b: a | b, tests)


def is_generic(text: Column, words: tuple[str, ...]) -> Column:
    return text.isNull() | (F.length(F.trim(text)) < 5) | starts_generic(text, words, ": ")


def is_speculative(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in vocab.SPECULATIVE])


def is_actionable_fix(fix: Column) -> Column:
    return F.coalesce((F.length(F.trim(fix)) >= 15) & ~starts_generic(fix, vocab.GENERIC_FIXES, ": -."), F.lit(False))


def is_benign(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike("|".join(f"(?:{p})" for p in map(ascii_edges, vocab.BENIGN)))


def type_assertion(code: Column) -> Column:
    """Struct of the first ``x as T``: is_assertion, source, type, sink (the first dangerous one, or null), guarded, risk_level."""
    hit = lambda k: F.regexp_extract(code, vocab.TYPE_ASSERTION, k)
    found = code.rlike(vocab.TYPE_ASSERTION)
    sink = F.when(found, F.coalesce(*[F.when(code.rlike(p), F.lit(n)) for n, p in vocab.DANGEROUS_SINKS.items()]))
    named = [F.when(found, hit(k)).alias(n) for k, n in ((1, "source"), (2, "type"))]
    guarded = found & code.rlike("|".join(vocab.GUARDS))
    return F.struct(found.alias("is_assertion"), *named, sink.alias("sink"), guarded.alias("guarded"), F.when(sink.isNotNull(), "high").otherwise("safe").alias("risk_level"))


def is_safe_subprocess(code: Column) -> Column:
    """A subprocess call without a shell, whose list has no variable after the program unless arguments are validated."""
    shell, valid = code.rlike(vocab.SHELL_TRUE), code.rlike("|".join(vocab.ARGUMENT_VALIDATION))
    listed = F.regexp_extract(code, vocab.SUBPROCESS_LIST, 1)
    quoted = lambda x: (x.startswith('"') & x.endswith('"')) | (x.startswith("'") & x.endswith("'"))
    args = F.transform(F.split(listed, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    dynamic = F.exists(F.slice(args, 2, F.greatest(F.size(args), F.lit(1))), lambda x: (x != "") & ~quoted(x))
    injected = shell & code.rlike(vocab.INTERPOLATION) & ~valid
    return code.rlike(vocab.SUBPROCESS_CALL) & ~injected & F.when(listed != "", ~dynamic | valid).otherwise(~shell)


def is_safe_idiom(code: Column) -> Column:
    """Intentional throws, bounded loops, type assertions without a dangerous sink, safe subprocess calls."""
    cast = type_assertion(code)
    assertion = F.contains(code, F.lit(" as ")) & cast["is_assertion"] & cast["sink"].isNull()
    return code.rlike("|".join(vocab.SAFE_IDIOMS)) | assertion | (F.contains(code, F.lit("subprocess.")) & is_safe_subprocess(code))


def has_safe_snippet(text: Column) -> Column:
    """Whether an inline or fenced code snippet of the text is a safe idiom."""
    inline, fenced = (F.regexp_extract_all(text, F.lit(vocab.SNIPPET), F.lit(k)) for k in (1, 2))
    both = F.transform(F.concat(inline, fenced), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.coalesce(F.exists(both, lambda x: (x != "") & is_safe_idiom(x)), F.lit(False))


# Paths. Forward slashes; '..' isn't resolved.


def normalize_path(path: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    out = F.regexp_replace(F.regexp_replace(out, r"/(\./)+", "/"), r"^(\./)+", "")
    has = lambda x: F.contains(path, F.lit(x))
    plain = ~(has("\\") | has("//") | has("/./") | path.startswith("./") | path.startswith("/"))
    return F.when(plain, path).otherwise(F.regexp_replace(out, "^/+", ""))  # most paths need no pass


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """With its dot; empty for names without one or with one in front only."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_binary_path(path: Column) -> Column:
    return F.lower(extension(path)).isin(*vocab.BINARY_EXTENSIONS)


def is_generated_path(path: Column) -> Column:
    low = F.lower(path)
    return basename(low).isin(*vocab.LOCK_FILES) | _any([low.endswith(s) for s in vocab.GENERATED_SUFFIXES])


def is_ignored_dir(path: Column) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    return _any([p.startswith(d) | F.contains(p, F.lit("/" + d)) for d in vocab.IGNORED_DIRS])


def is_doc_file(path: Column) -> Column:
    p = F.lower(normalize_path(path))
    return F.lower(extension(p)).isin(*vocab.DOC_EXTENSIONS) | basename(p).isin(*vocab.DOC_NAMES) | p.startswith("docs/") | F.contains(p, F.lit("/docs/"))


def is_test_file(path: Column) -> Column:
    p = F.lower(normalize_path(path))
    base = basename(p)
    inside = [F.contains(p, F.lit(x)) for x in ("__tests__/", "tests/mocks/", "__mocks__/", "/mocks/", "/fixtures/")]
    ends = [base.endswith(x) for x in ("_test.py", ".test.ts", ".spec.ts", ".test.js", ".spec.js", ".test.tsx", ".spec.tsx")]
    return _any(inside + ends + [p.startswith("test/"), p.startswith("tests/"), base.startswith("test_")])


def layer(path: Column) -> Column:
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    has = lambda *xs: _any([F.contains(p, F.lit(x)) for x in xs])
    ends = lambda *xs: _any([p.endswith(x) for x in xs])
    return (
        F.when(has(".test.", ".spec.", "/test/", "/tests/") | p.startswith("test/") | p.startswith("tests/"), "test")
        .when(has("/routes/", "/routers/", "/controllers/", "/endpoints/", "/api/") | ends("router.ts", "controller.ts"), "route")
        .when(has("/services/") | ends("service.ts"), "service")
        .when(has("/repositories/", "/models/", "/db/", "/entities/") | ends("repo.ts", "repository.ts"), "repository")
        .when(has("/config/", ".config."), "config")
        .when(has("/utils/", "/helpers/", "/lib/"), "util")
        .otherwise("domain")
    )


def language(path: Column) -> Column:
    ext = F.lower(extension(path))
    out = F.lit(None).cast("string")
    for e, name in vocab.LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def package_name(specifier: Column) -> Column:
    """@scope/name, or the first segment."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def production_candidates(path: Column) -> Column:
    """Paths that a test path may test, in order of preference."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^(.*?)\.test\.", "$1."), r"^(.*?)\.spec\.", "$1.")
    first = lambda old, new: F.regexp_replace(path, "^(.*?)" + old, "$1" + new)
    base = basename(path)
    options = F.array(
        F.when(F.contains(path, F.lit(".test.")), first(r"\.test\.", ".")),
        F.when(F.contains(path, F.lit(".spec.")), first(r"\.spec\.", ".")),
        F.when(path.endswith("_test.py"), first(r"_test\.py", ".py")),
        F.when(base.startswith("test_") & path.endswith(".py"), F.concat(F.when(F.instr(path, "/") > 0, F.concat(dirname(path), F.lit("/"))).otherwise(""), F.regexp_replace(base, "^test_", ""))),
        F.regexp_replace(plain, "^tests?/", "src/"),
        F.regexp_replace(plain, "^tests?/", ""),
    )
    return F.array_distinct(F.filter(options, lambda x: x.isNotNull()))


# Keys.


def finding_id(file: Column, start: Column, category: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", file, start.cast("string"), category, title), 256), 1, 16)


def symbol_id(file: Column, name: Column, kind: Column) -> Column:
    return F.sha2(F.concat(file, name, kind), 256)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(parts: Column) -> Column:
    """Of a map<string, string>: the first 32 hex digits of the hash of its sorted k:v, joined by |."""
    pairs = F.array_sort(F.map_entries(parts))
    return F.substring(F.sha2(F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|"), 256), 1, 32)


def compose_key(*parts: Column) -> Column:
    """Parts joined by colons, with forward slashes."""
    return F.concat_ws(":", *[F.regexp_replace(p, r"\\", "/") for p in parts])


def parse_key(key: Column) -> Column:
    """The five parts of a composed key, or null if it hasn't exactly five that aren't empty."""
    parts = F.split(key, ":")
    return F.when((F.size(parts) == 5) & F.forall(parts, lambda p: F.length(p) > 0), parts)


def glob_regex(pattern: str) -> str:
    """A glob with ``*``, ``**``, ``**/`` and ``?`` as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] in "*?":
            out, i = out + ("[^/]*" if pattern[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + ("\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] not in "/_-" else pattern[i]), i + 1
    return f"^{out}$"
