"""Tokens of TypeScript and JavaScript, brackets, and the declarations among them.

A scan of each file, a small helper, tells comments, texts, templates and regular expressions from code; what follows is
done on the token table: depths are running sums, brackets match their next one of the same depth, declarations are
patterns over neighbouring tokens, and extents end at a body's bracket or at the statement's boundary of the same depth.
Tokens are shuffled once, by path; only those that may declare or export something go on from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.shared import dealt, parts, store
from . import intervals

#: head: for a word that may be a declared name, the text from its line on, up to three lines, up to a brace or semicolon, or
#: else 120 characters; doc: the block comment right above its line.
TOKENS = "path string, seq int, kind string, text string, line int, end_line int, head string, doc string"

_SCAN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[#@]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<number>\d[\w.]*)|(?P<punct>=>|\?\.|\.\.\.|\S)", re.S
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_SPACE = re.compile(r"\s*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def scan(content: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, offset) of each token. The expressions of a template stand between tokens '${' and '}'."""
    at, last, open_ = 0, ("", ""), []  # open_: of each open brace, whether a template's expression ends with it

    def template(start: int) -> tuple[str, str, int, bool]:
        end = _TEMPLATE.match(content, start).end()
        more = content.startswith("${", end)
        return "template", content[start - 1 : end + (0 if more else 1)], start - 1, more

    while at < len(content):
        at = _SPACE.match(content, at).end()
        if at >= len(content):
            return
        c = content[at]
        if c == "`" or c == "}" and open_ and open_[-1]:
            if c == "}":
                open_.pop()
                yield "punct", "}", at
            kind, piece, start, more = template(at + 1)
            yield kind, piece if c == "`" else piece[1:], start + (c == "}")
            at = start + len(piece)
            last = ("template", piece)
            if more:
                yield "punct", "${", at
                at += 2
                open_.append(True)
                last = ("punct", "${")
            continue
        value = last[0] in ("number", "string", "template", "regex") or last[1] in (")", "]") or last[0] == "word" and last[1] not in _BEFORE_REGEX
        m = _REGEX.match(content, at) if c == "/" and not value else None
        found = ("regex", m[0]) if m else (lambda m: (m.lastgroup, m[0]))(_SCAN.match(content, at))
        yield *found, at
        at += len(found[1])
        if found[0] == "comment":
            continue
        last = found
        if found[1] == "{":
            open_.append(False)
        elif found[1] == "}" and open_:
            open_.pop()


#: Words that begin a statement, and words that may stand before a declaration's own word. Fixed values of the languages.
STATEMENTS = "const let var function class interface type enum export import return if for while switch try throw do abstract declare namespace async".split()
MODIFIERS = "default async declare abstract".split()
MEMBER_MODIFIERS = "public private protected static readonly async override abstract get set".split()
NOT_METHODS = "if for while switch catch return function else do new typeof await super throw with".split()
#: What stands before a declared name, and before a member's.
_NAMED_BY = frozenset("function class interface type const let var".split())
_MEMBER_AFTER = frozenset(("{", "}", ";", "*", *MEMBER_MODIFIERS))
_BODY = re.compile("[{;]")


def _names(kinds: list[str], texts: list[str], lines: list[int], ends: list[int]) -> Iterator[int]:
    """The words that may be the name of a declaration or a method; declarations() decides."""
    code = [n for n, kind in enumerate(kinds) if kind != "comment"]
    for i, n in enumerate(code):
        if kinds[n] == "word":
            before, after = texts[code[i - 1]] if i else "", texts[code[i + 1]] if i + 1 < len(code) else ""
            stated = before in _NAMED_BY or before == "*" and i > 1 and texts[code[i - 2]] == "function"
            if stated or after in ("(", "<") and texts[n] not in NOT_METHODS and (not i or before in _MEMBER_AFTER or lines[n] > ends[code[i - 1]]):
                yield n


def _head(rows: list[str], line: int) -> str:
    three = " ".join(rows[line - 1 : line + 2])
    m = _BODY.search(three)
    return three[: m.end()] if m else three.lstrip(" ")[:120]


def tokens(files: DataFrame, docs: bool = True) -> DataFrame:
    """TOKENS of the TypeScript and JavaScript files of (path, content), comments included. docs: whether doc is asked for."""

    def run(rows):
        for batch in rows:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                kinds, texts, lines, ends = [], [], [], []
                line, upto = 1, 0
                for kind, value, at in scan(content or ""):
                    line += content.count("\n", upto, at)
                    upto = at
                    kinds.append(kind)
                    texts.append(value)
                    lines.append(line)
                    ends.append(line + value.count("\n"))
                if not kinds:
                    continue
                split, n = content.split("\n"), len(kinds)
                above = {lines[k]: texts[k - 1] for k in range(1, n) if kinds[k - 1] == "comment" and lines[k] > ends[k - 1] and texts[k - 1].startswith("/**") and texts[k - 1].endswith("*/")} if docs else {}
                heads, found, cut = [None] * n, [None] * n, {}
                for k in _names(kinds, texts, lines, ends):
                    at = lines[k]
                    if at not in cut:
                        cut[at] = _head(split, at)
                    heads[k], found[k] = cut[at], above.get(at)
                text_, int_ = pa.string(), pa.int32()
                columns = zip((text_, int_, text_, text_, int_, int_, text_, text_), ([path] * n, range(n), kinds, texts, lines, ends, heads, found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in columns], names=[f.split()[0] for f in TOKENS.split(", ")])

    script = text.language(F.col("path")).isin("typescript", "javascript")
    return files.where(script).select("path", "content").mapInArrow(run, TOKENS)


def _is(*values: str, column: str = "text") -> Column:
    return (F.col("kind") == "punct") & F.col(column).isin(*values) if column == "text" else F.col(column).isin(*values)


def marks(found: DataFrame) -> DataFrame:
    """The code tokens of found that declare (what: the kind by its word), may be a method (member), or stand in a list of exports
    (listed), with name, start (its line), head, doc, exported and, as numbers of code tokens with the lines where those end: stop
    (where the statement ends: its semicolon, or the last token before the next boundary), body (the next opening brace of this
    depth, if it comes before that, and its closing one), arrow (of a variable that is an arrow function), inside (the bracket around)."""
    c, order = F.col, Window.partitionBy("path").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    delta = F.when(_is("{", "(", "[", "${"), 1).when(_is("}", ")", "]"), -1).otherwise(0)
    code = found.where("kind <> 'comment'").withColumn("_d", delta)
    near = {f"p{k}": F.lag("text", k).over(order) for k in (1, 2, 3)} | {f"{x}{k}": F.lead(y, k).over(order) for x, y in (("n", "text"), ("k", "kind"), ("line", "line"), ("head", "head"), ("doc", "doc")) for k in (1, 2)}
    code = code.withColumns(near | {"at": F.row_number().over(order), "_e": F.lag("end_line").over(order), "_upto": F.sum("_d").over(order), "_n": F.count("*").over(whole), "_last": F.last("end_line").over(whole)})
    code = code.withColumns({"fresh": F.coalesce(c("line") > c("_e"), F.lit(True)), "depth": (c("_upto") - F.when(c("_d") > 0, 1).otherwise(0)).cast("int")})
    word, first = c("kind") == "word", ~F.coalesce(c("p1").isin(".", "?."), F.lit(False))
    named = word & first & (c("k1") == "word")
    star = word & first & (c("text") == "function") & (c("n1") == "*") & (c("k2") == "word")
    kind = (
        F.when(named & (c("text") == "function") | star, "function")
        .when(named & (c("text") == "class") & ~c("n1").isin("extends", "implements"), "class")
        .when(named & (c("text") == "interface") & c("n2").isin("{", "<", "extends"), "interface")
        .when(named & (c("text") == "type") & c("n2").isin("=", "<"), "type")
        .when(named & c("text").isin("const", "let", "var") & ~c("n1").isin("enum"), "variable")
    )
    mod = lambda p: F.coalesce(c(p).isin(*MODIFIERS), F.lit(False))
    out = lambda p: F.coalesce(c(p) == "export", F.lit(False))
    exported = out("p1") | mod("p1") & (out("p2") | mod("p2") & out("p3"))
    begins = F.coalesce(c("p1").isin("{", "}", ";", "*", *MEMBER_MODIFIERS), F.lit(True)) | c("fresh") & ~F.coalesce(c("p1").isin("=", ",", "(", ".", "?.", "=>", "?", ":", "&", "|", "+", "new", "return"), F.lit(False))
    flag = lambda x: F.coalesce(x, F.lit(False))
    member, listed = flag(word & begins & c("n1").isin("(", "<") & ~c("text").isin(*NOT_METHODS)), flag(word & c("p1").isin("{", ","))
    code = code.withColumns({"what": kind, "exported": exported, "member": member, "listed": listed, "_lists": flag(_is("{") & (c("p1") == "export"))})
    pick = lambda x, own: F.when(star, c(f"{x}2")).when(c("what").isNotNull(), c(f"{x}1")).when(c("member"), own)
    code = code.select("path", "depth", "seq", "kind", "text", "end_line", "at", "fresh", "_d", "_e", "_n", "_last", "n1", "n2", "what", "exported", "member", "listed", "_lists", *[pick(x, c(y)).alias(z) for x, y, z in (("n", "text", "name"), ("line", "line", "start"), ("head", "head", "head"), ("doc", "doc", "doc"))])
    # A bracket also stands at the inner depth (_s: 1 where it opens, -1 where it closes), as it bounds what is inside.
    rows = code.withColumn("_s", F.explode(F.when(c("_d") != 0, F.array(F.lit(0), c("_d"))).otherwise(F.array(F.lit(0))))).withColumn("depth", c("depth") + F.abs("_s"))
    own, spot = c("_s") == 0, lambda at, end: F.struct(at.alias("at"), end.alias("end"))
    # The next row of a kind at this depth is the last one of a descending order, which a running window tells.
    ahead = Window.partitionBy("path", "depth").orderBy(c("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda test, x: F.last(F.when(test, x), True).over(ahead)
    before = spot(c("at") - 1, c("_e"))
    bound = F.when(c("_s") == -1, before).when(own & _is(";"), spot(c("at"), c("end_line"))).when(own & word & c("text").isin(*STATEMENTS) & c("fresh"), before)
    rows = rows.withColumns({"_close": upto(own & (c("_d") < 0), spot(c("at"), c("end_line"))), "_out": upto(c("_s") == -1, F.struct("at", "n1")), "_stop": F.coalesce(F.last(bound, True).over(ahead), spot(c("_n").cast("int"), c("_last")))})
    rows = rows.withColumn("_body", upto(own & _is("{"), F.struct("at", c("_close.at").alias("close"), c("_close.end").alias("end"))))
    rows = rows.withColumn("_arrow", upto(own & (c("text") == "=>"), F.struct("at", c("n1").alias("led"), c("_body").alias("body"))))
    rows = rows.withColumn("_eq", upto(own & _is("="), F.struct("at", "n1", "n2", c("_arrow").alias("arrow"))))
    rows = rows.where(own & (c("what").isNotNull() | c("member") | c("listed")) | (c("_s") == 1))
    rows = rows.withColumn("inside", F.last(F.when(c("_s") == 1, F.struct("at", c("_lists").alias("lists"))), True).over(Window.partitionBy("path", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    within = c("inside").isNotNull() & c("_out").isNotNull()
    rows = rows.where(own).withColumns({"member": c("member") & within, "listed": flag(c("listed") & within & c("inside.lists") & ~F.coalesce(c("_out.n1") == "from", F.lit(False)))})
    arrow = (c("what") == "variable") & (c("_eq.at") <= c("_stop.at")) & (c("_eq.n1").isin("(", "<", "async") | (c("_eq.n2") == "=>")) & (c("_eq.arrow.at") <= c("_stop.at"))
    body = F.when(c("_body.at") <= c("_stop.at"), c("_body"))
    return rows.where("what is not null or member or listed").select("path", "text", "what", "member", "listed", "name", "at", "start", "depth", "end_line", "head", "doc", "exported", c("inside.at").alias("inside"), c("_stop").alias("stop"), body.alias("body"), F.when(arrow, c("_eq.arrow")).alias("arrow"))


def declarations(marked: DataFrame) -> DataFrame:
    """(path, name, kind, at, start, end (lines), depth, open, close (of the body), exported, head, doc) of marks()'s tokens."""
    c = F.col
    shape = lambda rows, kind, body, exported: rows.select("path", "name", kind.alias("kind"), "at", "start", "end_line", "depth", "stop", body.alias("b"), exported.alias("exported"), "head", "doc")
    has = c("arrow").isNotNull()  # the variable is a function
    body = F.when(has, F.when(c("arrow.led") == "{", c("arrow.body"))).otherwise(F.when(~c("what").isin("variable", "type"), c("body")))
    stated = shape(marked.where("what is not null"), F.when(has, "function").otherwise(c("what")), body, c("exported"))
    # Methods: a name and its parameters directly inside a class, where a member may begin.
    classes = marked.where("what = 'class' and body is not null").select("path", c("body.at").alias("inside"))
    methods = shape(marked.where("member").join(classes, ["path", "inside"]), F.lit("method"), c("body"), F.lit(False))
    end = F.when(c("kind") == "variable", c("end_line")).when(c("b.close").isNotNull(), c("b.end")).otherwise(c("stop.end"))
    return stated.unionByName(methods).select("path", "name", "kind", "at", "start", F.coalesce(end, "start").alias("end"), "depth", c("b.at").alias("open"), c("b.close").alias("close"), "exported", "head", "doc")


def listed_exports(marked: DataFrame) -> DataFrame:
    """(path, name) of what ``export { a, b as c }`` lists, lists from elsewhere left out."""
    return marked.where("listed").select("path", F.col("text").alias("name")).distinct()


def doc_text(comment: Column) -> Column:
    """What a block comment says; null where it says nothing."""
    body = F.regexp_replace(F.regexp_replace(comment, r"^/\*\*|\*/$", ""), r"\s*\n\s*\*?\s*", " ")
    return F.nullif(F.trim(F.regexp_replace(body, r"^[ *]+|[ *]+$", "")), F.lit(""))


def symbols(files: DataFrame, docs: bool = True) -> DataFrame:
    """(path, name, kind, start_line, end_line, parent, exported, signature, docstring) of the files' declarations. The
    signature is the text from the symbol's line on, up to three lines, up to a brace or semicolon, or else 120 characters.
    docs: whether docstrings are asked for; they are null if not."""
    found = store(tokens(files, docs).where("kind <> 'comment'"), "tokens")
    marked = store(marks(dealt(found, parts(found.sparkSession, found.count()), "path")), "marks")
    declared = declarations(marked)
    inside = declared.where("close is not null and kind <> 'variable'").select("path", F.struct("open", "name").alias("r_id"), F.col("open").alias("r_start"), F.col("close").alias("r_end"))
    n = parts(found.sparkSession, marked.count())
    rows = intervals.with_innermost(declared, inside, "path", "at", ["at", "name", "kind"], "around", n)
    rows = dealt(rows, n, "path", "name").join(dealt(listed_exports(marked), n, "path", "name").withColumn("_out", F.lit(True)), ["path", "name"], "left")
    three, parent = F.trim("head"), F.col("around.name")
    upto = F.regexp_extract(three, r"^([^{;]*)[{;]", 1)
    signature = F.when(three.rlike("[{;]"), F.trim(upto)).otherwise(F.trim(F.substring(three, 1, 120)))
    exported = F.col("exported") | parent.isNull() & F.coalesce("_out", F.lit(False))
    return rows.select("path", "name", "kind", F.col("start").alias("start_line"), F.col("end").alias("end_line"), parent.alias("parent"), exported.alias("exported"), signature.alias("signature"), doc_text(F.col("doc")).alias("docstring"))
