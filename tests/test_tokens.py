"""Tokens and declarations of scripts: texts, templates, regular expressions and comments don't count as code."""

import pytest

from adjudica.operators import tokens

SOURCE = """import { x } from './x';
/**
 * Says it.
%s
 */
export function run(
  first: string,
  second: { a: number; b: string },
  third = (q) => q,
): Promise<void> {
  const re = /[{"'`/]}/g;
  const half = (1 + 2) / 3 / 4;
  if (re.test(first)) { return /}/; }
  const t = `a { ${[1, 2].map((n) => `in ${n} }`).join("}")} }`;
  // } not a bracket {
  return helper(first);
}

export default class Box extends mixin({ a: 1 }) implements Store {
  private items: Map<string, number> = make();
  static count = 0;

  constructor(private readonly size: number) {
    super();
  }

  async get<T>(key: string): Promise<T> {
    for (const k of this.keys()) {
      if (k) { work(k); }
    }
    return this.items.get(key);
  }

  abstract none(): void;
  get length() { return 1 }
}

interface Shape<T> extends Base {
  area(): number;
}
export type Pair = { a: string; b: number };
export const handler = async (req: Request, res: Response): Promise<void> => {
  const inner = function named() { return 1; };
};
let plain = 1, other = 2
const double = n => n * 2
const call = list.map((a) => a);
function* gen() { yield 1; }
obj.function = 3;
const type = 'class Fake {';
export { plain, double as twice };
export { far } from './far';
""" % "\n".join(" * line" for _ in range(60))


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("src/a.ts", SOURCE), ("src/b.js", "/* open"), ("src/c.ts", ""), ("d.py", "def f(): pass"), ("src/e.ts", "}}}) function late() {}\nconst s = 'open\nfunction after() {}"), ("src/n.ts", None)], "path string, content string")
    return files, {(r.path, r.name, r.kind): r for r in tokens.symbols(files).collect()}


def line_of(text):
    return SOURCE[: SOURCE.index(text)].count("\n") + 1


def test_extents(found):
    _, got = found
    spans = {k[1:]: (r.start_line, r.end_line, r.parent) for k, r in got.items() if k[0] == "src/a.ts"}
    assert spans["run", "function"] == (line_of("export function run"), line_of("  return helper") + 1, None)
    box = line_of("export default class")
    assert spans["Box", "class"] == (box, line_of("interface Shape") - 2, None)
    assert spans["constructor", "method"] == (box + 4, box + 6, "Box") and spans["get", "method"] == (box + 8, box + 13, "Box")
    assert spans["none", "method"] == (box + 15, box + 15, "Box") and spans["length", "method"] == (box + 16, box + 16, "Box")
    assert spans["Shape", "interface"][:2] == (line_of("interface Shape"), line_of("interface Shape") + 2)
    assert spans["handler", "function"] == (line_of("export const handler"), line_of("let plain") - 1, None)
    assert spans["named", "function"][2] == "handler" and spans["re", "variable"][2] == "run" and spans["k", "variable"][2] == "get"
    assert spans["double", "function"][0] == line_of("const double") and ("call", "variable") in spans and ("gen", "function") in spans
    assert not {n for n, _ in spans} & {"Fake", "make", "super", "work", "helper", "if", "for", "test", "Promise"}
    assert spans["Pair", "type"][0] == line_of("export type Pair")


def test_exports_signatures_and_comments(found):
    _, got = found
    rows = {k[1]: r for k, r in got.items() if k[0] == "src/a.ts"}
    assert {n for n, r in rows.items() if r.exported} == {"run", "Box", "Pair", "handler", "plain", "double"}
    assert rows["run"].docstring == "Says it. " + " ".join(["line"] * 60) and rows["Box"].docstring is None
    assert rows["run"].signature == "export function run(   first: string,   second:" and rows["gen"].signature == "function* gen()"


def test_broken_files(found):
    _, got = found
    assert {k for k in got if k[0] != "src/a.ts"} == {("src/e.ts", "late", "function"), ("src/e.ts", "s", "variable"), ("src/e.ts", "after", "function")}


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("a / b / c", ["word", "punct", "word", "punct", "word"]),
        ("x = /a[/]b/i.test(y)", ["word", "punct", "regex", "punct", "word", "punct", "word", "punct"]),
        ("return /x/", ["word", "regex"]),
        ("`a${`b${c}`}d` + 1", ["template", "punct", "template", "punct", "word", "punct", "template", "punct", "template", "punct", "number"]),
        ("'it\\'s' // c", ["string", "comment"]),
        ("`open", ["template"]),
        ("{ a } `}`", ["punct", "word", "punct", "template"]),
    ],
)
def test_scan(content, want):
    found = list(tokens.scan(content))
    assert [k for k, *_ in found] == want
    assert all(content.startswith(t, at) for _, t, at in found)


def test_linear(found):
    import time

    began = time.time()
    n = sum(1 for _ in tokens.scan("function f(a) { return /x/.test(`t${a}`); }\n" * 20_000))
    assert n > 300_000 and time.time() - began < 10


def test_tokens_are_shuffled_once_and_without_comments(spark, found, monkeypatch):
    """Code tokens go by path once, in as many tasks as their number asks for; no comment and no whole file is shuffled or stored."""
    from adjudica.plans import shared

    files, usual = found
    plans, stored, plain = {}, {}, tokens.store

    def keep(df, what):
        plans[what] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored.setdefault(what, plain(df, what))

    monkeypatch.setattr(tokens, "store", keep)
    monkeypatch.setattr(shared, "TASK_ROWS", 20)
    got = tokens.symbols(files, docs=False)
    assert "doc" in stored["tokens"].columns and stored["tokens"].where("kind = 'comment' or doc is not null").count() == 0
    assert plans["marks"].count("RepartitionByExpression") == 1 and "content" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tokens.marks(stored["tokens"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.path, r.name, r.kind): r.asDict() | {"docstring": None} for r in got.collect()} == {k: r.asDict() | {"docstring": None} for k, r in usual.items()}
    assert stored["marks"].count() < stored["tokens"].count() / 2
