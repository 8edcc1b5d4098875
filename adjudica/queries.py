"""Registered queries of the engine's own operators over the driver tables, with their DuckDB oracles.

A query runs its operator over whole tables. Arrays are returned as joined text, so that engines compare alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bind
from .functions import scoring, text, vocab
from .operators import caches, evaluate, evidence, gate, graph, history, intervals, keys, linkage, payloads, ranking, reference, relevance, selection, snapshot, tokens
from .oracles import ORACLES
from .plans import review, shared, stages
from .plans.shared import store
from .sinks import report
from .sources import gitstore, repository
from .sources.readers import table
from .streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
TOP = 13_000


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def score_findings(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.scored(bind.with_evidence(bind.findings(spark, d)))
    names = [f"{x}_score" for x in ("severity", "confidence", "evidence", "blast", "security", "regression")]
    fid = text.finding_id(F.col("file").cast("string"), F.col("start_line"), F.col("category"), F.col("title"))
    return _long(got.select("id", fid.alias("finding_id"), *names, "composite_score"), *names)


def protected_top(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.protected_top(ranking.scored(bind.with_evidence(bind.findings(spark, d))), TOP, ["id"], "low")
    return got.select("id", "severity", "composite_score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protected_top(spark, sf_dir)


def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    df = bind.findings(spark, d)
    parts = [ranking.zero_filled(spark, df, c, dom).select(F.lit(c).alias("by"), F.col(c).alias("value"), "n") for c, dom in (("severity", vocab.SEVERITIES), ("category", vocab.CATEGORIES), ("reviewer", (*vocab.REVIEWERS, "critic")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def nav_list(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.nav_list(ranking.scored(bind.with_evidence(bind.findings(spark, d))), ["id"], table(spark, d, "lineitem").count())
    return _long(got, "severity_level", "detail")


def overlap_clusters(spark: SparkSession, d: str) -> DataFrame:
    got = linkage.overlap_clusters(bind.findings(spark, d), ["id"])
    return got.groupBy("file", "cluster").agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.max("end_line").cast("long").alias("end_line"))


def merge_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = shared.parts(spark, table(spark, d, "lineitem").count())
    names = ("id", "file", "start_line", "end_line", "severity", "confidence", "reviewer", "title", "message_length")
    found = bind.findings(spark, d, {"message_length": F.length("message")}).select(*names)
    dealt = found.repartition(n, "file") if n else found.repartition("file")  # once, for windows and clusters
    df = linkage.overlap_clusters(dealt, ["id"]).withColumns({"severity_level": scoring.severity_level(F.col("severity")), "evidence_key": F.concat_ws(":", F.col("file").cast("string"), F.col("start_line").cast("string"), F.col("end_line").cast("string"))})
    got = linkage.survive(df, ["file", "cluster"], said=("title",))
    return _long(got.select("file", "cluster", "severity_level", "confidence", "start_line", "end_line", "members", "rep_id", "title", F.array_join("reviewers", ",").alias("reviewers"), F.array_join("evidence_keys", ",").alias("evidence_keys")), "severity_level", "start_line", "end_line")


def consolidate(spark: SparkSession, d: str) -> DataFrame:
    names = ("id", "file", "start_line", "end_line", "category")
    df = store(bind.findings(spark, d).select(*names, text.normalize_title(F.col("title")).alias("norm_title")), "findings")
    return linkage.consolidate(intervals.with_innermost(df, bind.symbols(df), "file", "start_line", ["id"], "symbol"), ["id"], ["id"], df.count())


def innermost_symbol(spark: SparkSession, d: str) -> DataFrame:
    df = bind.findings(spark, d)
    return intervals.innermost(df, bind.symbols(df), "file", "start_line", ["id"])


def hunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    df = bind.findings(spark, d).select("id", "file", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return intervals.overlapping(df, bind.hunks(spark, d), "file", tolerance=1).groupBy("id").agg(F.count("*").alias("n_hunks"))


def coalesce_lines(spark: SparkSession, d: str) -> DataFrame:
    return _long(intervals.coalesce_lines(bind.findings(spark, d), ["file"], "start_line"), "start", "end")


def normalize_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_title(F.regexp_replace("text", r"[^\x00-\x7F]", "~"))).alias("title_md5"))


def redact_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("text_md5"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def path_classes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return bind.paths(spark, d).select(
        "doc_id", text.normalize_path(p).alias("norm"), text.is_binary_path(p).alias("is_binary"), text.is_generated_path(p).alias("is_generated"), text.is_ignored_dir(p).alias("is_ignored"),
        text.is_doc_file(p).alias("is_doc"), text.is_test_file(p).alias("is_test"), text.layer(p).alias("layer"), text.language(p).alias("language"),
    )


def hash_keys(spark: SparkSession, d: str) -> DataFrame:
    parts = F.create_map(F.lit("src"), F.col("source"), F.lit("lang"), F.col("lang"))
    key = text.compose_key(F.lit("v1"), F.col("lang"), F.col("source"), text.content_hash(F.col("text")), F.lit("cfg"))
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content"), text.symbol_id(F.col("source"), F.col("lang"), F.lit("function")).alias("symbol"), text.cache_key(parts).alias("cache_key"), F.size(text.parse_key(key)).cast("long").alias("parts"))


def production_files(spark: SparkSession, d: str) -> DataFrame:
    got = bind.paths(spark, d).where(text.is_test_file(F.col("path"))).select("path").distinct()
    return got.select("path", F.array_join(text.production_candidates(F.col("path")), ",").alias("candidates"))


Patch = tuple[DataFrame, DataFrame, DataFrame]


def _patch(spark: SparkSession, d: str) -> Patch:
    """Changed files, stored hunks by their findings' paths, and files with their lines."""
    hunks = store(bind.patch_hunks(spark, d).withColumn("path", F.regexp_replace("path", "^pkg/", "")), "hunks")
    files = bind.files(spark, d)
    return files.select("path", "status"), hunks, files.where("status <> 'deleted'").select("path", "total_lines")


def _items(found: DataFrame, patch: Patch, n: int | None = None) -> DataFrame:
    """Evidence items (id, …) after validation against files and patch; an item goes by its finding's id. n: partitions."""
    changed, hunks, files = patch
    return evidence.validate_items(relevance.evidence_flags(bind.evidence_of(found), files, changed, hunks, n=n))


def _stated() -> tuple[F.Column, ...]:
    """What a model would say of a finding, bound by rules: failure mechanism, impact, trigger."""
    cause = F.when(F.col("quantity") % 3 == 0, F.concat(F.lit("unknown "), F.col("message"))).otherwise(F.col("message"))
    trigger = F.when(F.col("quantity") % 4 == 0, F.lit("edge case: x")).otherwise(F.concat(F.lit("when "), F.col("title")))
    return cause, F.col("message"), trigger


def _found(spark: SparkSession, d: str, told: dict[str, F.Column]) -> DataFrame:
    """Findings with their evidence and, instead of their texts, what is asked of these: made where the texts are and where orders are,
    so that neither is shuffled again."""
    says = told | {"says_evidence": evidence.explained(F.col("title"))}
    return bind.with_next(bind.with_evidence(bind.findings(spark, d, says))).drop("title", "message", "brand", "says_evidence", "n_files", "tight")


def _validated(spark: SparkSession, d: str) -> DataFrame:
    """Findings with the validation columns of the gate, by joins with files and patch; what a model would say is bound by rules."""
    found = store(_found(spark, d, gate.said(*_stated())), "findings")
    n = shared.parts(spark, found.count())
    by = lambda df, *keys: shared.dealt(df, n, *keys)
    patch = _patch(spark, d)
    _, hunks, files = patch
    own = relevance.met(bind.placed(found).select("id", "path", "start", "end"), hunks, 1, {"primary_in_diff": F.col("side") == "+"}, n)
    anchors = relevance.grounded(own, files, n=n).select("id", F.col("grounded").alias("anchor_valid"), "primary_in_diff")
    judged = evidence.validate_findings(by(_items(found, patch, n), "id").join(by(anchors, "id"), "id"), ["id"])
    df = by(found, "id").join(judged, "id", "left")
    return df.withColumns(
        {
            "introduced_by_patch": F.when(F.col("quantity") % 6 == 0, F.lit("pre_existing")).when(F.col("quantity") % 6 == 1, F.lit("introduced_by_patch")),
            "critic_decision": F.when(F.col("quantity") % 11 == 0, F.lit("rejected")),
            "n_contradictions": F.when(F.col("quantity") % 13 == 0, 1).otherwise(0),
            "suggested_disposition": F.lit("blocking"),
        }
    )


def finding_validation(spark: SparkSession, d: str) -> DataFrame:
    names = ("v_n_valid", "v_n_invalid", "v_strength", "v_valid", "v_direct", "v_fabricated")
    return _long(_validated(spark, d).select("id", *names), "v_n_valid", "v_n_invalid", "v_strength")


def _relevant(spark: SparkSession, d: str, found: DataFrame, n: int | None) -> DataFrame:
    hunks = store(bind.patch_hunks(spark, d), "hunks")
    near = relevance.in_diff(bind.placed(found), bind.evidence_of(found), hunks, n=n)
    return relevance.grounded(near, bind.files(spark, d).where("status <> 'deleted'").select("path", "total_lines"), n=n)


def diff_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Whether findings are near hunks, files being met by path or base name, and inside their files."""
    found = store(bind.with_next(bind.findings(spark, d)).select("id", "file", "start_line", "end_line", "reviewer", "e_file", "e_start", "e_end"), "findings")
    return _long(_relevant(spark, d, found, shared.parts(spark, found.count())).select("id", "in_diff", "grounded", "end"), "end")


def decision_gate(spark: SparkSession, d: str) -> DataFrame:
    got = gate.gated(_validated(spark, d))
    return got.select("id", "final_disposition", "downgraded", F.array_join("failed_checks", ",").alias("failed"), F.size("passed_checks").cast("long").alias("n_passed"))


def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    got = gate.gated(_validated(spark, d))
    return ranking.zero_filled(spark, got, "final_disposition", vocab.DISPOSITIONS)


def exit_code(spark: SparkSession, d: str) -> DataFrame:
    return _long(gate.exit_code(gate.gated(_validated(spark, d)), "high"), "exit_code")


def hard_floor(spark: SparkSession, d: str) -> DataFrame:
    """Findings through all rules of the floor: claims with snippets, sections with suppression comments, files and hunks by joins.
    Only findings that pass the rules before are asked of the patch, whose rules come last."""
    fix = F.when(F.col("quantity") % 7 == 0, F.concat(F.lit("todo: "), F.col("title"))).otherwise(F.concat(F.lit("replace "), F.col("title")))
    found = bind.placed(_found(spark, d, gate.floor_said(fix, bind.claim())))
    df = relevance.intent_in_section(found, bind.diffs(spark, d))
    df = df.withColumn("path", F.when(F.col("part") % 9 == 0, F.lit("tests/a.py")).otherwise(F.col("path")))
    early = store(gate.floor(df.withColumns({"in_diff": F.lit(True), "grounded": F.lit(True)}), 0.6), "floor")
    left = early.where("dropped_by is null").drop("in_diff", "grounded")
    late = gate.floor(_relevant(spark, d, left, shared.parts(spark, left.count())), 0.6)
    return early.where("dropped_by is not null").select("id", "dropped_by").unionAll(late.select("id", "dropped_by"))


def patch_attribution(spark: SparkSession, d: str) -> DataFrame:
    found = store(_found(spark, d, {"removed_claim": relevance.removed_claim()}), "findings")
    n = shared.parts(spark, found.count())
    patch = _patch(spark, d)
    changed, hunks, _ = patch
    stated = F.when(F.col("quantity") % 6 == 0, F.lit("fixed_by_patch"))
    df = bind.placed(found).withColumn("introduced_by_patch", stated).select("id", "path", "start", "end", "removed_claim", "introduced_by_patch")
    return gate.attributed(relevance.patch_flags(df, _items(found, patch, n), changed, hunks, n)).select("id", "attribution")


def evidence_validation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    items = bind.paths(spark, d).join(docs, "doc_id").withColumns(
        {
            "group_id": F.expr("doc_id div 4"), "start": (F.col("n_chars") % 97).cast("int"), "end": (F.col("n_chars") % 89).cast("int"), "total_lines": F.when(F.col("doc_id") % 5 != 0, F.lit(80)),
            "causal_link": F.when(F.col("doc_id") % 3 == 0, F.lit("calls it")), "explanation": F.lit(None).cast("string"), "file_deleted": F.col("doc_id") % 17 == 0, "file_exists": F.col("doc_id") % 19 != 0,
            "file_changed": F.col("doc_id") % 2 == 0, "has_added": F.col("doc_id") % 4 != 2, "hits_added": F.col("doc_id") % 8 == 0, "anchor_valid": F.col("doc_id") % 23 != 0, "primary_in_diff": F.col("doc_id") % 6 == 0,
        }
    )
    got = evidence.validate_findings(evidence.validate_items(items), ["group_id"])
    return _long(got.select("group_id", "v_n_valid", "v_n_invalid", "v_strength", "v_valid", "v_direct", "v_fabricated"), "v_strength")


def context_selection(spark: SparkSession, d: str) -> DataFrame:
    types = F.array(*map(F.lit, vocab.CANDIDATE_SCORE))
    docs = table(spark, d, "documents").select(F.expr("cast(doc_id div 50 as long)").alias("g"), F.col("doc_id").alias("id"), types[(F.col("doc_id") % 8).cast("int")].alias("type"), text.estimate_tokens(F.col("text")).alias("cost"))
    docs = docs.withColumn("score", scoring.lookup(F.col("type"), vocab.CANDIDATE_SCORE, 0))
    got = selection.select_context(docs, "g")
    return _long(got.select("g", F.array_join("picked", ",").alias("picked"), "candidate_count", "selected_count", "candidate_tokens", "selected_tokens", "selection_ratio"), "candidate_count", "selected_count")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers call the suppliers of their orders."""
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return pairs.select(F.col("l_suppkey").alias("s"), F.col("o_custkey").alias("c")).distinct()


def _callers(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("s"), F.col("n_nationkey").alias("sn"), F.col("n_regionkey").alias("sr"))
    cus = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("c"), F.col("n_nationkey").alias("cn"), F.col("n_regionkey").alias("cr"), (F.col("c_mktsegment") == "MACHINERY").alias("is_test"))
    return _edges(spark, d).join(sup, "s").join(cus, "c").withColumn("score", graph.proximity(F.col("sn") == F.col("cn"), F.col("sr") == F.col("cr"), F.col("is_test")))


def nearest_callers(spark: SparkSession, d: str) -> DataFrame:
    return _long(graph.nearest(_callers(spark, d), "s", "score", ["c"]).select("s", "c", "score", "rank"), "score", "rank")


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    imports = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey")).distinct()
    got = graph.dependents(_edges(spark, d), imports, "s")
    return got.select("s", F.col("dependents").cast("long").alias("dependents"), scoring.blast_radius(F.col("dependents")).cast("long").alias("blast"))


def reciprocal_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("dst"), F.lit("calls").alias("kind"))
    return graph.reciprocal(e).groupBy("src", "kind").agg(F.count("*").alias("n"))


def dependency_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    spec = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@org/"), F.col("source"), F.lit("/x"))).when(F.col("doc_id") % 3 == 1, F.concat(F.col("source"), F.lit("/index.ts"))).otherwise(F.concat(F.lit("lib"), F.col("lang"), F.lit("/a/b")))
    imports = docs.select(F.col("lang").alias("src"), spec.alias("specifier"))
    files = docs.where("doc_id % 2 = 0").select(F.concat("source", F.lit("/index.ts")).alias("path")).distinct()
    own = docs.where("lang = 'fr'").select(F.concat(F.lit("@org/"), "source").alias("name")).distinct()
    return graph.classify_imports(imports, files, own)


def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers and orders share one space of ids; each order is an edge from its customer to one of three ids from its own on."""
    return graph.in_cycle(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("dst")))


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    base = docs.where("doc_id % 7 <> 0").select(path, F.md5("text").alias("oid"), F.lit("100644").alias("mode"))
    head = docs.where("doc_id % 11 <> 0").select(path, F.when(F.col("doc_id") % 3 == 0, F.md5(F.upper("text"))).otherwise(F.md5("text")).alias("oid"), F.when(F.col("doc_id") % 13 == 0, "100755").otherwise("100644").alias("mode"))
    return base, head


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.tree_diff(*_trees(spark, d)).select("path", "status")


def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    base, head = _trees(spark, d)
    return _long(snapshot.status_matrix(base, head, base.where("path not like '%5'")), "head", "workdir", "stage")


def content_verdict(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").join(bind.paths(spark, d), "doc_id")
    return docs.select("doc_id", snapshot.verdict(F.col("path"), F.col("text")).alias("verdict"))


def text_diffs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("old"), F.regexp_replace("text", r"\n([^\n]*)\n", "\n$1 changed\n").alias("new"))
    got = snapshot.with_diff(old)
    return got.select("path", F.md5("diff").alias("diff_md5"), F.size(F.split("diff", "\n")).cast("long").alias("n_lines"))


def diff_intervals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    line = lambda x, i: F.when(i % 4 == 0, F.concat(F.lit(" "), x)).when(i % 4 == 1, F.concat(F.lit("-"), x)).otherwise(F.concat(F.lit("+"), x))
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    diff = F.concat(F.lit("--- a/"), "source", F.lit("\n+++ b/"), "source", F.lit("\n@@ -5,9 +7,9 @@\n"), body)
    return _long(snapshot.diff_intervals(docs.select("doc_id", diff.alias("diff")), "doc_id"), "start", "end")


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    tools = F.array(*map(F.lit, payloads.FIELDS))
    tool = tools[(F.col("event_id") % 7).cast("int")]
    body = F.to_json(F.struct(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("filename"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("fileName"), F.get_json_object("props", "$.k").cast("int").alias("line"), F.get_json_object("props", "$.k").cast("int").alias("line_number"), F.when(F.col("event_id") % 2 == 0, "error").otherwise("warning").alias("severity"), F.col("event_type").alias("message"), F.col("event_type").alias("issue_text"), F.lit("E501").alias("code")))
    got = payloads.normalize_diagnostics(ev.select(F.col("event_id").alias("id"), tool.alias("tool"), body.alias("json")))
    return _long(got.select("id", "file", "line", "severity", "message", "source", "rule"), "line")


def diagnostic_dedup(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", "event_type", (F.col("value") * 0).alias("zero"), "event_id")
    return linkage.first_of(ev.drop("zero"), ["user_id", "event_type"], ["event_id"])


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Events as fenced, chatty, sloppy and truncated payloads, and none."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure: "), F.regexp_replace("props", '"', "'"))).when(k == 2, F.regexp_replace("props", r"\}$", ",}")).when(k == 3, F.concat(F.lit('{"a":['), "props", F.lit(',{"b":'))).otherwise(F.lit("no payload"))
    return table(spark, d, "events").select("event_id", raw.alias("raw"))


def payload_repair(spark: SparkSession, d: str) -> DataFrame:
    return payloads.repaired(_payloads(spark, d), "raw").select("event_id", "json")


def payload_strict(spark: SparkSession, d: str) -> DataFrame:
    """What built-in functions make of them."""
    return _payloads(spark, d).select("event_id", payloads.strict(F.col("raw")).alias("json"))


def lru_replay(spark: SparkSession, d: str) -> DataFrame:
    acc = table(spark, d, "events").select(F.col("event_type").alias("cache"), F.col("user_id").alias("key"), (F.octet_length("props") * 10 + F.col("user_id") % 50).alias("size_bytes"), "ts", F.col("event_id").alias("id"))
    return caches.replay(acc, 5000)


def fifo_replay(spark: SparkSession, d: str) -> DataFrame:
    acc = table(spark, d, "events").select(F.col("event_type").alias("cache"), F.col("user_id").alias("key"), (F.octet_length("props") * 10 + F.col("user_id") % 50).alias("size_bytes"), "ts", F.col("event_id").alias("id"))
    return caches.replay(acc, 5000, "fifo")


def _evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = bind.findings(spark, d)
    expected = df.where("id % 1000 <= 2 and part % 3 = 0").select("fixture", "file", "category", F.col("id").alias("expected_id"), F.col("start_line").alias("e_start"), F.col("end_line").alias("e_end"), F.lit("medium").alias("e_severity"), F.lit(0.6).alias("min_confidence"), F.array(F.substring("title", 1, 3)).alias("keywords"))
    return df, expected


def fixture_metrics(spark: SparkSession, d: str) -> DataFrame:
    df, expected = _evaluation(spark, d)
    return evaluate.fixture_metrics(df, expected, evaluate.matched(df, expected, n_rows=table(spark, d, "lineitem").count()))


def scorecard(spark: SparkSession, d: str) -> DataFrame:
    m = fixture_metrics(spark, d)
    results = m.withColumn("latency", (F.col("fixture") * 37) % 1009)
    return evaluate.scorecard(results)


def sarif(spark: SparkSession, d: str) -> DataFrame:
    df = bind.findings(spark, d)
    out = report.sarif_results(df.select("category", "severity", "message", F.col("file").cast("string").alias("file"), "start_line", "end_line"))
    return out.groupBy(F.get_json_object("value", "$.ruleId").alias("rule_id"), F.get_json_object("value", "$.level").alias("level")).agg(F.count("*").alias("n"))


def sarif_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each finding's whole object."""
    df = bind.findings(spark, d)
    out = report.sarif_results(df.select("category", "severity", "message", F.col("file").cast("string").alias("file"), "start_line", "end_line"))
    return out.groupBy("value").agg(F.count("*").alias("n"))


def quiet_report(spark: SparkSession, d: str) -> DataFrame:
    return report.quiet_lines(bind.findings(spark, d))


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    calls = ev.select("event_type", F.octet_length("props").alias("prompt_tokens"), F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("completion_tokens"))
    return stages.token_usage(calls.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")), ["event_type"])


def retry_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as tries of one request, whose results go by the event's number."""
    status = F.element_at(F.array(*[F.lit(x) for x in (503, 429, 500, None, 200, 401, 404)]), (F.col("event_id") % 7 + 1).cast("int"))
    got = stages.replay_retries(table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), status.alias("status")))
    return _long(got, "attempts")


def file_languages(spark: SparkSession, d: str) -> DataFrame:
    return stages.languages(bind.paths(spark, d))


def folder_sizes(spark: SparkSession, d: str) -> DataFrame:
    sized = bind.paths(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length")), "doc_id")
    return _long(repository.folder_bytes(sized, "src"), "bytes")


def point_reads(spark: SparkSession, d: str) -> DataFrame:
    """Every third document's path as it is, its neighbour's, and a path that leads outside."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    other = F.concat_ws("/", "source", (F.col("doc_id") + 1).cast("string"))
    wanted = docs.where("doc_id % 3 = 0").select(F.explode(F.array(path, other, F.concat(F.lit("../"), path))).alias("path")).distinct()
    return repository.read_files(docs.select(path.alias("path"), F.col("text").alias("content")), wanted).select("path", F.md5("content").alias("content_md5"))


def known_refs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    names = docs.select(F.col("source").alias("name")).union(docs.select("lang")).where("name is not null").distinct()
    return repository.ref_exists(docs.where("doc_id % 2 = 0").select(F.col("source").alias("name"), F.md5("text").alias("oid")), names)


def workspace_list(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    manifests = docs.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "packages/").otherwise("apps/x/"), "source", F.lit("/package.json")).alias("path"))
    return repository.snapshot_workspaces(manifests, ["packages/*", "!packages/src1*"])


def reviewer_schedule(spark: SparkSession, d: str) -> DataFrame:
    paths, docs = bind.paths(spark, d), table(spark, d, "documents")
    lines = docs.select(F.lit("+").alias("side"), F.explode(F.split("text", "\n")).alias("content"))
    none = spark.createDataFrame([], "path string, kind string, name string, start_line int, end_line int")
    return stages.scheduled(paths, docs.select(F.col("text").alias("diff")), spark.createDataFrame([], "path string, r_start int, r_end int"), none, lines)


def reviewer_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Which reviewers run where hunks meet functions, and where they miss them; removed lines have no say."""
    paths, docs = bind.paths(spark, d), table(spark, d, "documents")
    where = paths.select(text.normalize_path(F.col("path")).alias("path")).distinct()
    parts = where.select("path", F.lit("function").alias("kind"), F.lit("parse").alias("name"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"))
    lines = docs.select(F.lit("-").alias("side"), F.explode(F.split("text", "\n")).alias("content"))
    plain = docs.select(F.lit("nothing of note").alias("diff"))
    rows = [stages.scheduled(paths, plain, where.select("path", F.lit(a).alias("r_start"), F.lit(b).alias("r_end")), parts, lines).withColumn("variant", F.lit(n)) for n, a, b in (("hit", 5, 9), ("miss", 6, 9))]
    return rows[0].unionByName(rows[1])


def diagnostic_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of each source's documents as one collection, and of one tool's result on them."""
    files = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    whole = keys.diagnostics_keys(files, ["source"], ["tsc", "ruff", "biome"], "no-config").withColumnRenamed("key", "all_tools")
    return whole.join(keys.tool_keys(files, ["source"], "ruff", "1.2", "no-config"), "source")


def hunks_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The hunk lines of each file in its nation's diff."""
    sup = table(spark, d, "supplier").select(F.col("s_nationkey").alias("diff_id"), F.col("s_suppkey").alias("k"), F.concat(F.lit("src/f"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("path"))
    body = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1 +1,2 @@\n x\n+"), F.col("k").cast("string"))
    diffs = sup.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("b")))), lambda x: x["b"]), "\n").alias("diff"))
    return snapshot.file_hunks(diffs, sup.select("diff_id", F.regexp_replace("path", "^src/", "./").alias("path")))


def review_stages(spark: SparkSession, d: str) -> DataFrame:
    found = bind.findings(spark, d)
    return stages.stage_counts({"raw": found, "confident": found.where("conf_pct >= 60"), "severe": found.where(F.col("severity").isin("critical", "high"))})


def reference_graph(spark: SparkSession, d: str) -> DataFrame:
    """All edges between the files and symbols of script files."""
    return reference.build(store(bind.sources(spark, d), "sources"), docs=False)[1]


def script_symbols(spark: SparkSession, d: str) -> DataFrame:
    got = tokens.symbols(bind.sources(spark, d), docs=False)
    return _long(got.drop("docstring"), "start_line", "end_line")


def repository_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each commit of a packed repository, one commit for each source on a line of them, each with its source's documents; what is
    read back from the packs."""
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("c-"), F.coalesce("source", F.lit("none")))
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), (F.col("doc_id") % 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(name.alias("commit"), path.alias("path"), F.when(F.col("doc_id") % 3 == 0, "100755").otherwise("100644").alias("mode"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    names = files.select("commit").distinct()
    line = names.select("commit", F.lag("commit").over(Window.orderBy("commit")).alias("parent"), F.row_number().over(Window.orderBy("commit")).cast("long").alias("time"))  # a row for each source
    at = gitstore.shared_path(spark)
    made = gitstore.write_repository(files, line.select("commit", "parent", F.lit("adjudica").alias("author"), "time", F.col("commit").alias("message")), at)
    read = gitstore.commits(spark, at).select(F.col("oid").alias("commit"), F.trim("message").alias("name"), F.size("parents").cast("long").alias("n_parents"))
    read = read.join(made.select(F.col("oid").alias("commit")), "commit", "left_semi").select(F.regexp_replace("name", r"\s+$", "").alias("name"), "commit", "n_parents")
    found = gitstore.snapshots(spark, at, read.select("commit"))
    return found.join(read, "commit").select("name", "path", "mode", "oid", "n_parents")


def suppression_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events as actions of users' reviews, replayed as a stream that is stopped and started again half way."""
    ev = table(spark, d, "events")
    action = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "view", "restore").otherwise("suppress")
    acts = ev.select(F.col("user_id").alias("review"), F.col("event_id").alias("seq"), action.alias("action"), F.floor("value").cast("long").alias("finding"))
    at = f"{shared.folder(spark)}/core/replay-{uuid.uuid4().hex[:12]}"
    half = F.pmod(F.xxhash64("seq"), F.lit(2))
    for part in (0, 1):  # both runs share the state's checkpoint
        acts.where(half == part).write.mode("append").parquet(f"{at}/actions")
        stream = progress.suppressions(progress.read(spark, f"{at}/actions", "review long, seq long, action string, finding long", 4))
        progress.run_to_table(stream, f"{at}/changes", f"{at}/state")
    changes = spark.read.schema("review long, seq long, suppressed long, batch long").parquet(f"{at}/changes")
    return progress.latest(changes, "review")


def history_bases(spark: SparkSession, d: str) -> DataFrame:
    """All best merge bases of each two of five commits, the latest order of each priority."""
    last = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max("o_orderkey").cast("string").alias("oid"))
    a, b = (last.select(F.col("o_orderpriority").alias(f"p_{x}"), F.col("oid").alias(x)) for x in "ab")
    pairs = a.join(b, F.col("p_a") < F.col("p_b")).select(F.concat_ws("|", "p_a", "p_b").alias("id"), "a", "b")  # five rows by five
    return history.merge_bases(bind.history(spark, d), pairs)


def history_log(spark: SparkSession, d: str) -> DataFrame:
    """The 100 latest commits before the last order."""
    last = table(spark, d, "orders").agg(F.max("o_orderkey").cast("string")).first()[0]
    return history.log(bind.history(spark, d), last, 100) if last is not None else bind.history(spark, d).select("oid", F.col("time").alias("at"))


def cycle_paths(spark: SparkSession, d: str) -> DataFrame:
    """A shortest cycle through each edge of cycle_nodes' graph."""
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("dst"))
    got = graph.edge_cycles(edges)
    return got.select("src", "dst", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


def review_plan(spark: SparkSession, d: str) -> DataFrame:
    return review.adjudicate(spark, d)


_OWN = (
    score_findings, protected_top, summary_counts, nav_list, overlap_clusters, merge_clusters, consolidate, innermost_symbol, hunk_overlap, coalesce_lines, normalize_titles, redact_texts, token_estimates, path_classes, hash_keys,
    production_files, finding_validation, diff_relevance, decision_gate, gate_summary, exit_code, hard_floor, patch_attribution, evidence_validation, context_selection, nearest_callers, blast_radius, reciprocal_edges, dependency_classes, cycle_nodes, snapshot_diff,
    status_matrix, content_verdict, text_diffs, diff_intervals, diagnostics, diagnostic_dedup, payload_repair, payload_strict, lru_replay, fifo_replay, fixture_metrics, scorecard, sarif, quiet_report, token_usage, retry_replay, file_languages, folder_sizes, point_reads, known_refs, workspace_list, reviewer_schedule, reviewer_triggers, review_stages, sarif_objects, diagnostic_keys, hunks_of_files, reference_graph, script_symbols, repository_files, suppression_replay, history_bases, history_log, cycle_paths, review_plan,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _OWN}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
