"""Bindings of the driver tables as the engine's inputs: findings, symbols, hunks, candidates, paths.

Each binding is one SQL text in two dialects, so that the oracle sees the same rows. Ids are numbered within an order,
which partitions; no binding sorts a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.evidence import connected
from .plans.shared import dealt, parts
from .sources.readers import table

FINDINGS = """
select l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as id,
  l_orderkey as fixture, l_suppkey as file, {days} as start_line, {days} + cast(floor(l_quantity / 10) as int) as end_line,
  case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' else 'info' end as severity,
  case l_returnflag when 'A' then 'structural' when 'N' then 'semantic' else 'security' end as reviewer,
  50 + 5 * cast(round(l_discount * 100) as int) as conf_pct,
  case p_size % 8 when 0 then 'correctness' when 1 then 'security' when 2 then 'reliability' when 3 then 'performance' when 4 then 'maintainability' when 5 then 'architecture' when 6 then 'testing' else 'compatibility' end as category,
  p_name as title, p_type as message, p_brand as brand, l_partkey as part, cast(l_quantity as int) as quantity, l_linestatus as status
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
"""

#: The joins of FINDINGS, which Spark runs in another order.
_JOINS = "{lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey"

#: Hunks of a file (supplier): the order-date days of its orders, three days long.
HUNKS = """
select distinct l_suppkey as file, {odays} as r_start, {odays} + 2 as r_end
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

#: Changed files (suppliers): those with a negative balance are deleted, the others have lines by their nation.
FILES = """
select s_suppkey as file, case when s_acctbal < 0 then 'deleted' else 'modified' end as status, case when s_acctbal < 0 then null else 2000 + 25 * cast(s_nationkey as int) end as total_lines from {supplier}
"""

#: Evidence of a finding: the next finding of its order, linked causally where security states it.
EVIDENCE = """
select * from (select id, lead(file) over (partition by fixture order by id) as e_file, lead(start_line) over (partition by fixture order by id) as e_start, lead(end_line) over (partition by fixture order by id) as e_end,
  case when reviewer = 'security' then 'calls it' end as causal_link, lead(title) over (partition by fixture order by id) as explanation from ({findings}) f) e where e_file is not null
"""

#: Symbols of a file: windows of 90 days, and of 30 within every other of them.
SYMBOLS = """
select file, w * 90 as r_start, w * 90 + 89 as r_end, 'q' || cast(w as {string}) as r_id from (select distinct file, cast(floor(start_line / 90) as int) as w from ({findings}) f) a
union all
select file, w * 30 as r_start, w * 30 + 29 as r_end, 'm' || cast(w as {string}) as r_id from (select distinct file, cast(floor(start_line / 30) as int) as w from ({findings}) f) b where w % 2 = 0
"""

PATHS = """
select doc_id, case doc_id % 13
  when 0 then 'src/' || source || '/services/user' || cast(doc_id as {string}) || 'service.ts'
  when 1 then 'src/' || source || '/api/router.ts' when 2 then 'tests/' || source || '/test_m' || cast(doc_id as {string}) || '.py'
  when 3 then 'docs/' || source || '.md' when 4 then 'packages/' || source || '/src/a.test.ts' when 5 then 'node_modules/' || source || '/index.js'
  when 6 then source || '/dist/app.min.js' when 7 then 'img/' || source || '.PNG' when 8 then 'package-lock.json'
  when 9 then './src//' || source || '/lib/./x.py' when 10 then 'src/models/' || source || '.spec.js' when 11 then 'README' else 'src/' || source || '/config/main.config.js' end as path
from {documents}
"""


_GROUP = "'src/g' || cast(cast(floor(doc_id / 10) as bigint) as {string}) || '/m'"

#: Script files: each document is a module with a function and a class, its text being a comment; two of ten are tests. Modules
#: of ten documents import each other in a line.
SOURCES = f"""
select case when doc_id % 5 = 4 then {_GROUP} || cast(doc_id - 1 as {{string}}) || '.test.ts' else {_GROUP} || cast(doc_id as {{string}}) || '.ts' end as path,
  case when doc_id % 10 <> 0 then replace('import {{ fP }} from {{q}}./mP{{q}};\n', 'P', cast(doc_id - 1 as {{string}})) else '' end ||
  case when doc_id % 5 = 4 then replace('const t = fP({{q}}x{{q}});\n', 'P', cast(doc_id - 1 as {{string}}))
  else '/** ' || replace(coalesce(text, ''), '*/', '* /') || '\n */\n' || replace(replace('export function fK(\n  first: string,\n  second = /[{{"`]/,\n) {{\n  // }}\n  return `a ${{ fP(`b }}`) }} {{`;\n}}\nclass CK extends CP {{\n  get(x) {{\n    return {{q}}}}{{q}};\n  }}\n}}\n', 'K', cast(doc_id as {{string}})), 'P', cast(doc_id - 1 as {{string}})) end as content
from {{documents}}
"""


def _days(column: str) -> str:
    return f"datediff({column}, date'1992-01-01')"


def findings(spark: SparkSession, sf_dir: str, told: dict[str, F.Column] | None = None) -> DataFrame:
    """told: columns made of a finding's title, message, quantity, part and part size (p_size) before it is dealt by order, so that the
    texts they come from needn't be shuffled again."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part")}
    # Dealt by part once and then by order once, for the join, the numbering and what is asked of orders after; a task's rows
    # don't grow with the table.
    n = parts(spark, t["lineitem"].count())
    lines = dealt(t["lineitem"], n, "l_partkey").join(dealt(t["part"], n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.withColumns({"title": F.col("p_name"), "message": F.col("p_type"), "part": F.col("l_partkey"), "quantity": F.col("l_quantity").cast("int")}).withColumns(told or {}).drop("title", "message", "part", "quantity")
    sql = FINDINGS.replace(_JOINS, "{lines} join {orders} on l_orderkey = o_orderkey").replace("{days}", _days("l_shipdate"))
    sql = sql.replace("l_linestatus as status", ", ".join(["l_linestatus as status", *(told or {})]))
    return spark.sql(sql, lines=dealt(lines, n, "l_orderkey"), orders=dealt(t["orders"], n, "o_orderkey")).withColumn("confidence", F.col("conf_pct") / 100)


def with_evidence(df: DataFrame) -> DataFrame:
    """Other findings of the same order as evidence: their number, files, and that all spans are short."""
    order = Window.partitionBy("fixture")  # an order has a handful of lines
    return df.withColumns({"n_evidence": F.count("*").over(order) - 1, "n_files": F.size(F.collect_set("file").over(order)).cast("long"), "tight": F.lit(True)})


def hunks(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """distinct: else a hunk comes once for each line that has it, and no shuffle by file is needed."""
    lines, orders = (table(spark, sf_dir, n) for n in ("lineitem", "orders"))
    n = parts(spark, lines.count())
    met = spark.sql(HUNKS.replace("distinct ", "").replace("{odays}", _days("o_orderdate")), lineitem=dealt(lines, n, "l_orderkey"), orders=dealt(orders, n, "o_orderkey"))
    return dealt(met, n, "file").distinct() if distinct else met


def _path(file: str) -> F.Column:
    return F.concat(F.lit("src/f"), F.col(file).cast("string"), F.lit(".ts"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, status, total_lines) of all files; a deleted file has no lines."""
    return spark.sql(FILES, supplier=table(spark, sf_dir, "supplier")).select(_path("file").alias("path"), "status", "total_lines")


def with_next(df: DataFrame) -> DataFrame:
    """Findings with their evidence as EVIDENCE has it: e_file, e_start, e_end and, where says_evidence tells whether a title explains,
    e_says of the next one's."""
    order = Window.partitionBy("fixture").orderBy("id")
    of = {"e_file": "file", "e_start": "start_line", "e_end": "end_line", "e_says": "says_evidence"}
    return df.withColumns({k: F.lead(c).over(order) for k, c in of.items() if c in df.columns})


def evidence_of(df: DataFrame) -> DataFrame:
    """evidence() of with_next()'s findings, each with its finding's path (own_path), and with ``connected`` for the explanation."""
    link = F.when(F.col("reviewer") == "security", "calls it")
    got = df.where("e_file is not null").withColumns({"own_path": _path("file"), "path": _path("e_file"), "start": F.col("e_start"), "end": F.col("e_end"), "causal_link": link})
    says = {"connected": connected(F.col("e_says"))} if "e_says" in df.columns else {}
    return got.withColumns(says).select("id", "path", "start", "end", "causal_link", "own_path", *says)


def evidence(df: DataFrame) -> DataFrame:
    """(id, path, start, end, causal_link, explanation) of findings."""
    got = df.sparkSession.sql(EVIDENCE.replace("({findings})", "{findings}"), findings=df)
    return got.select("id", _path("e_file").alias("path"), F.col("e_start").alias("start"), F.col("e_end").alias("end"), "causal_link", "explanation")


def placed(df: DataFrame) -> DataFrame:
    """Findings with path, start and end as the patch's operators name them."""
    return df.withColumns({"path": _path("file"), "start": F.col("start_line"), "end": F.col("end_line")})


def patch_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, side, r_start, r_end): hunks as lines that a patch adds, or, those that begin at a multiple of four, removes. Every
    fifth file is named from above the repository, so that only its base name is the finding's. Not distinct, as hunks are only met."""
    folder = F.when(F.col("file") % 5 == 0, "pkg/").otherwise("")
    return hunks(spark, sf_dir, False).select(F.concat(folder, _path("file")).alias("path"), F.when(F.col("r_start") % 4 == 0, "-").otherwise("+").alias("side"), "r_start", "r_end")


def symbols(df: DataFrame) -> DataFrame:
    return df.sparkSession.sql(SYMBOLS.replace("({findings})", "{findings}").replace("{string}", "string"), findings=df)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PATHS.replace("{string}", "string"), documents=table(spark, sf_dir, "documents"))


#: What findings say of code, by their part: eight claims, some of which are safe idioms.
CLAIMS = ("see `throw new NotFoundError(x)`", 'see `subprocess.run(["ls", "-l"])`', 'see `subprocess.run(["ls", path])`', "see `body as User`", "see `el.innerHTML = body as string`", "see `while (true) {}`", "see\n```ts\nfor (let i = 0; i < xs.length; i++) {}\n```", "see above")


def claim() -> F.Column:
    return F.element_at(F.array(*map(F.lit, CLAIMS)), (F.col("part") % len(CLAIMS) + 1).cast("int"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, diff): a section for each file; those of every third nation have a suppression comment."""
    mark = F.when(F.col("s_nationkey") % 3 == 0, "+// @ts-ignore\n").otherwise("")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("diff_id"), F.concat(F.lit("+++ b/"), _path("s_suppkey"), F.lit("\n@@ -1 +1,2 @@\n+x\n"), mark).alias("diff"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of script files made of the documents."""
    docs = table(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("_sources_documents")
    return spark.sql(SOURCES.replace("{string}", "string").replace("{documents}", "_sources_documents").replace("{q}", "\\'"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, parent, nth, time): orders as commits; the parent is an order up to 40 before, and of every fourth a second one up to
    7 before; orders without one are roots."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    first = orders.select("k", F.lit(1).alias("nth"), (F.col("k") - 1 - F.col("c") % 40).alias("p"))
    second = orders.where("k % 4 = 0").select("k", F.lit(2).alias("nth"), (F.col("k") - 1 - F.col("c") % 7).alias("p"))
    return first.unionAll(second).select(F.col("k").cast("string").alias("oid"), F.when(F.col("p") >= 0, F.col("p")).cast("string").alias("parent"), "nth", F.col("k").alias("time"))


def duck(sql: str) -> str:
    """A binding in DuckDB's dialect."""
    days = "cast(datediff('day', date '1992-01-01', cast({} as date)) as int)"
    out = sql.replace("\\n", "' || chr(10) || '") if sql is SOURCES else sql
    out = out.replace("{q}", "''").replace("{findings}", FINDINGS).replace("{days}", days.format("l_shipdate")).replace("{odays}", days.format("o_orderdate")).replace("{string}", "varchar")
    for name in ("lineitem", "orders", "part", "documents", "supplier"):
        out = out.replace("{" + name + "}", name)
    return out
