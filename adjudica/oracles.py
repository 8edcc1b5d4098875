"""DuckDB SQL for the engine's own queries. Written apart from the operators, over the same bindings."""

from __future__ import annotations

from . import bind
from .functions import vocab

F_ = f"({bind.duck(bind.FINDINGS)})"
_LEVEL = "case severity when 'critical' then 5 when 'high' then 4 when 'medium' then 3 when 'low' then 2 else 1 end"
_HUNKS = f"({bind.duck(bind.HUNKS)})"
_SYMBOLS = f"({bind.duck(bind.SYMBOLS)})"
_PATHS = f"({bind.duck(bind.PATHS)})"


def _case(column: str, table: dict, default) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {column} " + " ".join(f"when '{k}' then {q(v)}" for k, v in table.items()) + f" else {q(default)} end"


_SCORED = f"""(
select *, 30*sev + 20*conf + 15*evi + 15*10 + 10*sec + 10*reg as total from (
 select f.*, {_case("severity", vocab.SEVERITY_SCORE, 10)} sev, least(100, greatest(0, conf_pct)) conf,
  case when ne = 0 then 0 else least(100, (case ne when 1 then 40 when 2 then 70 else 90 end) + (case when nf >= 2 then 10 else 0 end) + 5) end evi,
  case when category = 'security' then {_case("severity", vocab.SECURITY_IMPACT, 0)} when regexp_matches(lower(title || ' ' || message), '\\b({"|".join(vocab.SECURITY_WORDS)})\\b') then 15 else 0 end sec,
  {_case("category", vocab.REGRESSION_BASE, 30)} reg
 from {F_} f join (select fixture, count(*) - 1 ne, count(distinct file) nf from {F_} group by 1) e using (fixture)))"""

_ISLANDS = f"""(
select *, sum(fresh) over (partition by file order by start_line, end_line, id rows unbounded preceding) as cluster from (
 select *, case when mx is null or start_line > mx then 1 else 0 end fresh from (
  select *, max(end_line) over (partition by file order by start_line, end_line, id rows between unbounded preceding and 1 preceding) mx from {F_})))"""

_INNER = f"select id, arg_min(r_id, (r_end - r_start, r_id)) r_id from {F_} f join {_SYMBOLS} s on f.file = s.file and start_line between r_start and r_end group by id"

_HIT = f"select distinct id from {F_} f join {_HUNKS} h on f.file = h.file and start_line <= r_end + 1 and end_line >= r_start - 1"

_FILES = f"({bind.duck(bind.FILES)})"
_EV = f"({bind.duck(bind.EVIDENCE)})"
_PLUS = f"(select * from {_HUNKS} where r_start % 4 <> 0)"
_PRIMARY = f"(select distinct id from {F_} f join {_PLUS} h on f.file = h.file and start_line <= r_end + 1 and end_line >= r_start - 1)"
_EHIT = f"(select distinct id from {_EV} v join {_PLUS} h on e_file = h.file and e_start <= r_end + 1 and e_end >= r_start - 1)"
#: Evidence items: why one isn't valid, and its tier.
_ITEMS = f"""(select v.*, status = 'deleted' del, case when coalesce(e_start > total_lines, false) then 'y' end r,
 case when status = 'deleted' then 'base' when a.file is null or h.id is not null then 'direct' else 'indirect' end t
 from {_EV} v join {_FILES} x on e_file = x.file left join (select distinct file from {_PLUS}) a on e_file = a.file left join {_EHIT} h using (id))"""
_VALID = f"""(select id, nv, ni, (case when nv = 0 or not anc then 0 else least(100, greatest(0, 20 + case when direct then 40 else 0 end + least(10, nn * 5) + floor(10 * nv / (nv + ni) + 0.5) - ni * 25)) end)::bigint strength, anc and nv > 0 and ni = 0 vvalid, direct, fab from (
 select i.id, (r is null)::int nv, (r is not null)::int ni, (r is null and t = 'indirect')::int nn, (r is null and t = 'direct') or p.id is not null direct, r is not null fab, coalesce(start_line <= total_lines, true) anc
 from {_ITEMS} i join {F_} f using (id) join {_FILES} x on f.file = x.file left join {_PRIMARY} p on p.id = i.id))"""
_GATE_IN = f"""(
select f.*, e.ne, coalesce(v.direct, true) direct, coalesce(v.vvalid, true) vvalid, coalesce(v.nv, 1) nv, coalesce(v.ni, 0) ninv, coalesce(v.strength, 75) strength, coalesce(v.fab, false) fabricated,
 case when quantity % 3 = 0 then 'unknown ' || message else message end mech, case when quantity % 4 = 0 then 'edge case: x' else 'when ' || title end trig,
 case when quantity % 6 = 0 then 'pre_existing' when quantity % 6 = 1 then 'introduced_by_patch' else 'unknown' end attr,
 case when quantity % 11 = 0 then 'rejected' else 'approved' end critic, case when quantity % 13 = 0 then 1 else 0 end contra
from {F_} f join (select fixture, count(*) - 1 ne from {F_} group by 1) e using (fixture) left join {_VALID} v using (id))"""


def _generic(column: str, words: tuple[str, ...]) -> str:
    low = f"lower(trim({column}))"
    return f"({column} is null or length(trim({column})) < 5 or " + " or ".join(f"{low} = '{w}' or starts_with({low}, '{w}:') or starts_with({low}, '{w} ')" for w in words) + ")"


def _speculative(column: str) -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{p}')" for p in vocab.SPECULATIVE) + ")"


_CHECKS = {
    "changedCodeRelevance": "direct or attr in ('introduced_by_patch', 'worsened_by_patch')",
    "evidenceValid": "vvalid or (nv > 0 and ninv = 0)",
    "concreteFailureMechanism": f"not {_generic('mech', vocab.GENERIC_MECHANISMS)} and length(mech) >= 10",
    "credibleTrigger": f"not {_generic('trig', vocab.GENERIC_TRIGGERS)} and not {_speculative('trig')} and length(trig) >= 6",
    "reachableExecutionPath": f"not {_speculative('message')} and (ne > 0 or start_line > 0)",
    "materialImpact": "category not in ('maintainability', 'testing') and severity <> 'info' and not contains(lower(title), 'style preference') and not contains(lower(title), 'docstring')",
    "justifiedSeverity": "severity <> 'critical' or category in ('security', 'correctness', 'reliability')",
    "acceptableConfidence": "conf_pct >= 60",
    "patchAttribution": "attr in ('introduced_by_patch', 'worsened_by_patch') or (attr = 'unknown' and direct)",
    "criticDecision": "critic = 'approved'",
    "noStrongContradiction": "contra = 0",
}
_FAILED = "list_filter([" + ", ".join(f"case when not ({c}) then '{n}' end" for n, c in _CHECKS.items()) + "], lambda x: x is not null)"
_GATED = f"""(
select *, case when critic = 'rejected' or fabricated or (contra > 0 and strength < 30) then 'rejected' when len(failed) = 0 then 'blocking'
 when category in ('maintainability', 'testing') or severity = 'info' then 'informational' else 'advisory' end as final_disposition
from (select *, {_FAILED} failed from {_GATE_IN}))"""


def _zero(column: str, rows: str, domain: tuple[str, ...]) -> str:
    values = ", ".join(f"('{v}')" for v in domain)
    return f"select v.{column}, count(r.{column}) n from (values {values}) v({column}) left join (select {column} from {rows}) r using ({column}) group by 1"


_TITLE = "lower(regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g'))"
for _alternatives, _form in vocab.TITLE_SYNONYMS:
    _TITLE = f"regexp_replace({_TITLE}, '\\b({_alternatives})\\b', '{_form}', 'g')"
_TITLE = f"trim(regexp_replace(regexp_replace({_TITLE}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"

_REDACTED = "text"
for _pattern, _replacement in vocab.REDACTIONS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_replacement.replace('$1', chr(92) + '1')}', 'g')"

_NORM = "regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/(\\./)+', '/', 'g'), '^(\\./)+', '')"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _path_columns(p: str) -> dict[str, str]:
    base = f"regexp_extract({p}, '[^/]*$')"
    ext = f"lower(regexp_extract({base}, '^.+(\\.[^.]*)$', 1))"
    low = f"lower({p})"
    lbase = f"lower({base})"
    has = lambda x, *xs: "(" + " or ".join(f"contains({x}, '{y}')" for y in xs) + ")"
    ends = lambda x, *xs: "(" + " or ".join(f"ends_with({x}, '{y}')" for y in xs) + ")"
    n = f"lower({_NORM})" if p == "path" else low
    nbase = f"regexp_extract({n}, '[^/]*$')"
    return {
        "is_binary": f"{ext} in {_in(vocab.BINARY_EXTENSIONS)}",
        "is_generated": f"({lbase} in {_in(vocab.LOCK_FILES)} or {ends(low, *vocab.GENERATED_SUFFIXES)})",
        "is_ignored": "(" + " or ".join(f"starts_with({p}, '{x}') or contains({p}, '/{x}')" for x in vocab.IGNORED_DIRS) + ")",
        "is_doc": f"({ext} in {_in(vocab.DOC_EXTENSIONS)} or {nbase} in {_in(vocab.DOC_NAMES)} or starts_with({n}, 'docs/') or contains({n}, '/docs/'))",
        "is_test": f"({has(n, '__tests__/', 'tests/mocks/', '__mocks__/', '/mocks/', '/fixtures/')} or {ends(nbase, '_test.py', '.test.ts', '.spec.ts', '.test.js', '.spec.js', '.test.tsx', '.spec.tsx')} or starts_with({n}, 'test/') or starts_with({n}, 'tests/') or starts_with({nbase}, 'test_'))",
        "layer": f"case when {has(low, '.test.', '.spec.', '/test/', '/tests/')} or starts_with({low}, 'test/') or starts_with({low}, 'tests/') then 'test' when {has(low, '/routes/', '/routers/', '/controllers/', '/endpoints/', '/api/')} or {ends(low, 'router.ts', 'controller.ts')} then 'route' when {has(low, '/services/')} or {ends(low, 'service.ts')} then 'service' when {has(low, '/repositories/', '/models/', '/db/', '/entities/')} or {ends(low, 'repo.ts', 'repository.ts')} then 'repository' when {has(low, '/config/', '.config.')} then 'config' when {has(low, '/utils/', '/helpers/', '/lib/')} then 'util' else 'domain' end",
        "language": _case(ext, vocab.LANGUAGES, "").replace("else ''", "else null"),
    }


_PC = _path_columns("path")
_PN = _path_columns("norm")
_CALLERS = """(select s, c, case when c_mktsegment = 'MACHINERY' then 4 when s_nationkey = c_nationkey then 1 when sn.n_regionkey = cn.n_regionkey then 2 else 3 end score
 from (select distinct l_suppkey s, o_custkey c from orders join lineitem on o_orderkey = l_orderkey) e join supplier on s = s_suppkey join customer on c = c_custkey
 join nation sn on sn.n_nationkey = s_nationkey join nation cn on cn.n_nationkey = c_nationkey)"""
_BASE = "(select source || '/' || doc_id path, md5(text) oid, '100644' mode from documents where doc_id % 7 <> 0)"
_HEAD = "(select source || '/' || doc_id path, case when doc_id % 3 = 0 then md5(upper(text)) else md5(text) end oid, case when doc_id % 13 = 0 then '100755' else '100644' end mode from documents where doc_id % 11 <> 0)"
_MATCH = f"""(select distinct f.fixture, f.id finding_id, e.id expected_id from {F_} f join (select * from {F_} where id % 1000 <= 2 and part % 3 = 0) e
 on f.fixture = e.fixture and f.file = e.file and f.category = e.category and f.start_line <= e.end_line + 1 and f.end_line >= e.start_line - 1
 where {_LEVEL.replace("severity", "f.severity", 1)} >= 3 and f.conf_pct >= 60 and contains(lower(f.title || ' ' || f.message), lower(substr(e.title, 1, 3))))"""
_METRICS = f"""(select fixture, coalesce(met, 0)::bigint true_positives, (coalesce(found, 0) - coalesce(good, 0))::bigint false_positives, (coalesce(wanted, 0) - coalesce(met, 0))::bigint false_negatives
 from (select fixture, count(*) found from {F_} group by 1) a full join (select fixture, count(*) wanted from {F_} where id % 1000 <= 2 and part % 3 = 0 group by 1) b using (fixture)
 left join (select fixture, count(distinct finding_id) good, count(distinct expected_id) met from {_MATCH} group by 1) c using (fixture))"""
_TOOLS = ("tsc", "biome", "ruff", "mypy", "pyright", "bandit", "pytest")
_NEAR = f"""(select distinct id from (select id, file, start_line s, end_line e from {F_} union all select v.id, e_file, e_start, e_end from {_EV} v join {F_} f on f.id = v.id and f.file = e_file) r
 join {_HUNKS} h on r.file = h.file and s <= r_end + 2 and e >= r_start - 2)"""
_RELEVANT = f"""(select f.*, n.id is not null in_diff, coalesce(start_line <= total_lines, true) grounded, case when total_lines is null then end_line else greatest(start_line, least(end_line, total_lines)) end last
 from {F_} f join {_FILES} x on f.file = x.file left join {_NEAR} n on n.id = f.id)"""
_FLOOR = f"""(select r.*, ne, case when quantity % 7 = 0 then 'todo: ' || title else 'replace ' || title end fix, case when part % 9 = 0 then 'tests/a.py' else 'src/a.py' end path
 from {_RELEVANT} r join (select fixture, count(*) - 1 ne from {F_} group by 1) e using (fixture))"""
_MINUS = f"(select * from {_HUNKS} where r_start % 4 = 0)"

#: Script files: number, path, whether a test, and the line of the function.
_S = f"""(select doc_id k, path, doc_id % 5 = 4 test, (doc_id % 10 <> 0)::int + 2 + length(text) - length(replace(text, chr(10), '')) + 1 s from documents join (
 select doc_id, case when doc_id % 5 = 4 then 'src/g' || doc_id // 10 || '/m' || (doc_id - 1) || '.test.ts' else 'src/g' || doc_id // 10 || '/m' || doc_id || '.ts' end path from documents) using (doc_id))"""
_LINKS = f"""(select a.path src, b.path dst, 'imports' kind from {_S} a join {_S} b on b.k = a.k - 1 and a.k % 10 <> 0 and not b.test
 union all select a.path, sha256(b.path || 'f' || b.k || 'function'), 'calls' from {_S} a join {_S} b on b.k = a.k - 1 and a.k % 10 <> 0 and not b.test
 union all select sha256(a.path || 'C' || a.k || 'class'), sha256(b.path || 'C' || b.k || 'class'), 'implements' from {_S} a join {_S} b on b.k = a.k - 1 and not b.test and not a.test
 union all select a.path, b.path, 'tests' from {_S} a join {_S} b on b.k = a.k - 1 and a.test, range(2) t)"""
_COMMITS = "(select o_orderkey k, o_orderkey - 1 - o_custkey % 40 p from orders union all select o_orderkey, o_orderkey - 1 - o_custkey % 7 from orders where o_orderkey % 4 = 0)"

ORACLES = {
    "reference_graph": f"select * from {_LINKS} union all select dst, src, case kind when 'imports' then 'imported_by' when 'calls' then 'called_by' when 'implements' then 'implemented_by' else 'tested_by' end from {_LINKS}",
    "script_symbols": f"""select path, 'f' || k as name, 'function' kind, s::bigint start_line, (s + 6)::bigint end_line, null::varchar parent, true exported, 'export function f' || k || '(   first: string,   second = /[' as signature from {_S} where not test
union all select path, 'C' || k, 'class', s + 7, s + 11, null, false, 'class C' || k || ' extends C' || (k - 1) from {_S} where not test
union all select path, 'get', 'method', s + 8, s + 10, 'C' || k, false, 'get(x)' from {_S} where not test
union all select path, 't', 'variable', 2, 2, null, false, 'const t = f' || (k - 1) || '(''x'')' from {_S} where test""",
    "repository_files": """select 'c-' || source as name, lang || '/' || (doc_id % 100) || '/' || doc_id || '.txt' as path, case when doc_id % 3 = 0 then '100755' else '100644' end as mode, sha1('blob ' || strlen(text) || chr(0) || text) oid,
(source > (select min(source) from documents))::bigint n_parents from documents""",
    "sarif_objects": f"""select '{{"ruleId":"' || category || '","level":"' || {_case("severity", vocab.SARIF_LEVEL, 'note')} || '","message":{{"text":"' || message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || start_line || ',"endLine":' || end_line || '}}}}}}]}}' as value, count(*) n from {F_} group by 1""",
    "reviewer_triggers": f"""select variant, reviewer, case when reviewer = 'semantic' then variant = 'hit' else true end runs from (select unnest(['hit', 'miss']) variant) a, (select unnest(['structural', 'semantic', 'security']) reviewer) b
where (select count(*) > 0 from {_PATHS} where path = 'package-lock.json')""",
    "diagnostic_keys": """with h as (select source, substr(sha256(string_agg(coalesce(substr(sha256(text), 1, 16), 'missing'), '|' order by doc_id::varchar)), 1, 16) f, count(*) n from documents group by 1)
select source, substr(sha256('configVersion:no-config|fileCount:' || n || '|filesHash:' || f || '|tools:biome,ruff,tsc'), 1, 32) all_tools, substr(sha256('configVersion:no-config|fileCount:' || n || '|filesHash:' || f || '|tool:ruff|toolVersion:1.2'), 1, 32) as key from h""",
    "hunks_of_files": """select s_nationkey diff_id, './f' || s_suppkey || '.ts' path, '--- a/src/f' || s_suppkey || '.ts' || chr(10) || '@@ -1 +1,2 @@' || chr(10) || ' x' || chr(10) || '+' || s_suppkey hunks from supplier""",
    "payload_repair": """select event_id, case event_id % 5 when 3 then '{"a":[' || props || ']}' when 4 then null else props end json from events""",
    "payload_strict": "select event_id, case when event_id % 5 < 3 then props end json from events",
    "suppression_replay": """with a as (select user_id review, event_id seq, case event_type when 'error' then 'reset' when 'view' then 'restore' else 'suppress' end act, floor(value)::bigint finding from events),
r as (select review, max(seq) l, coalesce(max(seq) filter (act = 'reset'), -1) z from a group by 1),
h as (select review, count(*) n from (select review, finding, arg_max(act, seq) act from a join r using (review) where seq > z group by 1, 2) where act = 'suppress' group by 1)
select review, l seq, coalesce(n, 0) suppressed from r left join h using (review)""",
    "history_bases": f"""with recursive e as (select * from {_COMMITS} where p >= 0), l as (select o_orderpriority r, max(o_orderkey) k from orders group by 1),
reach(r, k) as (select r, k from l union select reach.r, e.p from reach join e using (k)),
common as (select a.r || '|' || b.r id, k from reach a join reach b using (k) where a.r < b.r)
select id, k::varchar oid from common c where not exists (select 1 from e join common x on x.k = e.k where e.p = c.k and x.id = c.id)""",
    "history_log": f"""with recursive e as (select * from {_COMMITS} where p >= 0), reach(k) as (select max(o_orderkey) from orders union select e.p from reach join e using (k))
select k::varchar oid, k as at from reach order by k desc limit 100""",
    "token_usage": "select event_type, sum(strlen(props))::bigint prompt_tokens, sum(case when user_id % 3 > 0 then user_id else 0 end)::bigint completion_tokens, sum(case when user_id % 3 > 0 then strlen(props) + user_id else 0 end)::bigint total_tokens from events group by 1",
    "retry_replay": """with c as (select user_id request, event_id % 7 k, row_number() over (partition by user_id order by event_id) rn from events),
g as (select request, count(*) n, min(rn) filter (k >= 4) t, arg_min(k, rn) filter (k >= 4) kt from c where rn <= 4 group by 1)
select request, coalesce(t, n)::bigint attempts, case kt when 4 then 'done' when 5 then 'refused' when 6 then 'failed' else case when n = 4 then 'exhausted' else 'pending' end end outcome from g""",
    "file_languages": f"select distinct {_PC['language']} as language from {_PATHS} where {_PC['language']} is not null",
    "folder_sizes": f"select coalesce(sum(n_chars), 0)::bigint bytes from {_PATHS} join documents using (doc_id) where starts_with(path, 'src/')",
    "point_reads": """with d as (select source || '/' || doc_id path, source, doc_id, text from documents), w as (select path from d where doc_id % 3 = 0 union select source || '/' || (doc_id + 1) from d where doc_id % 3 = 0 union select '../' || path from d where doc_id % 3 = 0)
select path, md5(text) content_md5 from w left join d using (path)""",
    "known_refs": "with n as (select source as name from documents union select lang from documents) select name, name in (select source from documents where doc_id % 2 = 0) as exists from n where name is not null",
    "workspace_list": "select distinct 'packages/' || source path from documents where doc_id % 2 = 0 and source not like 'src1%'",
    "reviewer_schedule": f"""select unnest(['structural', 'semantic', 'security']) reviewer, unnest([true, (select bool_or(regexp_matches(text, '\\b(if|else|switch|case|for|while|do|try|catch|finally|throw|return|yield|await|async|def|lambda|match)\\b')) from documents), true]) runs""",
    "review_stages": f"select unnest(['raw', 'confident', 'severe']) stage, unnest([count(*), count(*) filter (conf_pct >= 60), count(*) filter (severity in ('critical', 'high'))]) n from {F_}",
    "cycle_nodes": """with recursive e as (select distinct o_custkey s, o_orderkey + o_custkey % 3 t from orders), k as (select * from e where t in (select s from e)),
r(a, b) as (select s, t from k union select r.a, k.t from r join k on r.b = k.s) select distinct a as node from r where a = b""",
    "score_findings": f"select id, substr(sha256(file || ':' || start_line || ':' || category || ':' || title), 1, 16) finding_id, sev::bigint severity_score, conf::bigint confidence_score, evi::bigint evidence_score, 10::bigint blast_score, sec::bigint security_score, reg::bigint regression_score, total / 100 composite_score from {_SCORED}",
    "protected_top": f"""with s as (select *, {_LEVEL} lv from {_SCORED}), k as (select * from s where lv >= 2)
select id, severity, total / 100 composite_score from k where severity = 'critical' union all
select id, severity, total / 100 from (select *, row_number() over (order by total desc, lv desc, conf_pct desc, file, start_line, id) rn from k where severity <> 'critical') where rn <= greatest(0, 13000 - (select count(*) from k where severity = 'critical'))""",
    "summary_counts": " union all ".join(f"select '{c}' as by, {c} as value, n from ({_zero(c, F_, dom)})" for c, dom in (("severity", vocab.SEVERITIES), ("category", vocab.CATEGORIES), ("reviewer", (*vocab.REVIEWERS, "critic")))),
    "nav_list": f"""with s as (select *, {_LEVEL} lv from {_SCORED})
select severity, lv::bigint severity_level, 0::bigint detail, null::double composite_score, null::bigint id, count(*) n from s group by severity, lv
union all select severity, lv, 1, total / 100, id, null from s""",
    "overlap_clusters": f"select file, cluster::bigint as cluster, count(*) members, min(id) first_id, max(end_line)::bigint end_line from {_ISLANDS} group by 1, 2",
    "merge_clusters": f"""select file, cluster::bigint as cluster, max({_LEVEL})::bigint severity_level, max(conf_pct) / 100 confidence, min(start_line)::bigint start_line, max(end_line)::bigint end_line, count(*) members,
 arg_max(id, (conf_pct, length(message), -id)) rep_id, arg_max(title, (conf_pct, length(message), -id)) title, array_to_string(list_sort(list(distinct reviewer)), ',') reviewers,
 array_to_string(list_transform(list_slice(list_sort(list(distinct [first_id, 0])), 1, 5), lambda x: keys[1]), '') evidence_keys from (select *, id first_id, [''] keys from {_ISLANDS}) group by 1, 2, keys""",
    "consolidate": f"""with recursive base as (select i.*, s.r_id symbol, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) nt from {_ISLANDS} i left join ({_INNER}) s using (id)),
hub as (select id, 'I|' || file || '|' || cluster::bigint h from base union select id, 'S|' || file || '|' || symbol || '|' || category from base where symbol is not null union select id, 'T|' || file || '|' || nt from base),
edge as (select distinct a.id x, b.m y from hub a join (select h, min(id) m from hub group by 1) b using (h)),
both_ as (select x, y from edge union select y, x from edge),
lab(id, l, k) as (select x, min(least(x, y)), 0 from both_ group by 1 union all
  select x, min(l2), any_value(k2) + 1 from (select b.x, l.l l2, l.k k2 from both_ b join lab l on b.y = l.id union all select l.id, l.l, l.k from lab l) where k2 < 60 group by 1)
select id, l cluster from lab where k = 60""",
    "innermost_symbol": _INNER,
    "hunk_overlap": f"select id, count(*) n_hunks from {F_} f join {_HUNKS} h on f.file = h.file and start_line <= r_end + 1 and end_line >= r_start - 1 group by 1",
    "coalesce_lines": f"select file, min(start_line)::bigint as start, max(start_line)::bigint as end from (select file, start_line, start_line - row_number() over (partition by file order by start_line) g from (select distinct file, start_line from {F_})) group by file, g",
    "normalize_titles": f"select doc_id, md5({_TITLE}) title_md5 from documents",
    "redact_texts": f"select doc_id, md5({_REDACTED}) text_md5 from documents",
    "token_estimates": "select doc_id, case when length(text) = 0 then 0 else ceil(ceil(length(text) / 3.8::double) * 1.1::double) end::bigint tokens from documents",
    "path_classes": f"select doc_id, {_NORM} norm, " + ", ".join(f"{v} as {k}" for k, v in _PC.items()) + f" from {_PATHS}",
    "hash_keys": "select doc_id, substr(sha256(text), 1, 16) content, sha256(source || lang || 'function') symbol, substr(sha256('lang:' || lang || '|src:' || source), 1, 32) cache_key, 5::bigint parts from documents",
    "decision_gate": f"""select id, final_disposition, final_disposition not in ('blocking', 'rejected') as downgraded, array_to_string(failed, ',') failed, (11 - len(failed))::bigint n_passed from {_GATED}""",
    "gate_summary": _zero("final_disposition", _GATED, vocab.DISPOSITIONS),
    "exit_code": f"select count(*) filter (final_disposition = 'blocking' and {_LEVEL} >= 4) n_blocking, (count(*) filter (final_disposition = 'blocking' and {_LEVEL} >= 4) > 0)::bigint exit_code from {_GATED}",
    "hard_floor": f"""select id, case when conf_pct < 60 then 'confidence' when ne <= 0 then 'evidence' when length(trim(fix)) < 15 or starts_with(fix, 'todo:') then 'fix' when path = 'tests/a.py' or s_nationkey % 3 = 0 then 'intent' when part % 8 in (0, 1, 3, 6) then 'benign' when not in_diff then 'diff' when not grounded then 'grounding' end dropped_by from {_FLOOR} join supplier on file = s_suppkey""",
    "patch_attribution": f"""select f.id, case when x.status = 'deleted' then case when removed then 'fixed_by_patch' else 'pre_existing' end
 when (removed or quantity % 6 = 0) and m.file is not null and dm.id is not null then 'fixed_by_patch'
 when a.file is null or hp.id is not null or eh.id is not null then 'introduced_by_patch' when dm.id is not null then 'fixed_by_patch' when causal_link is not null then 'worsened_by_patch' else 'pre_existing' end attribution
 from (select *, contains(lower(title), 'fixed') or contains(lower(message), 'removed') or contains(lower(message), 'deleted') removed from {F_}) f join {_FILES} x on f.file = x.file left join (select distinct file from {_PLUS}) a on a.file = f.file left join (select distinct file from {_MINUS}) m on m.file = f.file
 left join {_PRIMARY} hp on hp.id = f.id left join (select distinct id from {F_} g join {_MINUS} h on g.file = h.file and start_line <= r_end + 1 and end_line >= r_start - 1) dm on dm.id = f.id
 left join {_EV} v on v.id = f.id left join {_EHIT} eh on eh.id = f.id and v.e_file = f.file""",
    "finding_validation": f"select f.id, nv::bigint v_n_valid, ni::bigint v_n_invalid, strength v_strength, vvalid v_valid, direct v_direct, fab v_fabricated from {F_} f left join {_VALID} v using (id)",
    "diff_relevance": f'select id, in_diff, grounded, last::bigint as "end" from {_RELEVANT}',
    "evidence_validation": f"""with i as (select doc_id, doc_id // 4 group_id, (n_chars % 97)::int s, path, {_NORM} norm, doc_id % 17 = 0 del, doc_id % 19 <> 0 ex, case when doc_id % 5 <> 0 then 80 end tot, doc_id % 3 = 0 told, doc_id % 2 = 0 chg, doc_id % 4 <> 2 added, doc_id % 8 = 0 hit from {_PATHS} join documents using (doc_id)),
v as (select *, case when contains(path, '..') or starts_with(path, '/') then 'a' when {_PN["is_ignored"]} then 'b' when {_PN["is_binary"]} then 'c' when {_PN["is_generated"]} then 'd' when s < 1 then 'e' when not del and not ex then 'x' when ex and tot is not null and s > tot then 'y'
 when not del and not chg and not told then 'z' end r, case when del then 'base' when chg then case when not added or hit then 'direct' else 'indirect' end else 'supporting' end t from i),
g as (select group_id, count(*) filter (r is null) nv, count(*) filter (r is not null) ni, count(*) filter (r is null and t = 'direct') nd, count(*) filter (r is null and t = 'supporting') ns, count(*) filter (r is null and t = 'indirect') nn, coalesce(bool_or(r in ('x', 'y')), false) fab, bool_and(doc_id % 23 <> 0) anc, bool_or(doc_id % 6 = 0) pri from v group by 1)
select group_id, nv v_n_valid, ni v_n_invalid, (case when nv = 0 or not anc then 0 else least(100, greatest(0, 20 + case when nd > 0 or pri then 40 else 0 end + least(20, ns * 10) + least(10, nn * 5) + floor(10 * nv / (nv + ni) + 0.5) - ni * 25)) end)::bigint v_strength, anc and nv > 0 and ni = 0 v_valid, nd > 0 or pri v_direct, fab v_fabricated from g""",
    "nearest_callers": f"select s, c, score::bigint score, rank from (select *, row_number() over (partition by s order by score, c) rank from {_CALLERS}) where rank <= 10",
    "blast_radius": """select s, n::bigint dependents, least(100, floor(10 + 90 * least(1.0::double, log2(n + 1) / 4) + 0.5))::bigint blast from (select s, sum(n) n from (
 select l_suppkey s, least(10, count(distinct o_custkey)) n from orders join lineitem on o_orderkey = l_orderkey group by 1 union all
 select l_suppkey, count(distinct l_partkey) from lineitem group by 1) group by 1)""",
    "reciprocal_edges": "with e as (select distinct l_suppkey s, o_custkey c from orders join lineitem on o_orderkey = l_orderkey) select 'c' || c src, 'calls' kind, count(*) n from e group by 1 union all select 's' || s, 'called_by', count(*) from e group by 1",
    "dependency_classes": """with i as (select lang src, case doc_id % 3 when 0 then '@org/' || source || '/x' when 1 then source || '/index.ts' else 'lib' || lang || '/a/b' end sp, case doc_id % 3 when 0 then '@org/' || source when 1 then source else 'lib' || lang end pk from documents),
f as (select distinct source || '/index.ts' p from documents where doc_id % 2 = 0), w as (select distinct '@org/' || source n from documents where lang = 'fr')
select distinct src, case when p is null and n is null then pk else sp end dst, p is null and n is null is_external, n is not null is_workspace from i left join f on sp = p left join w on pk = n""",
    "snapshot_diff": f"select coalesce(a.path, b.path) path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'modified' end status from {_BASE} a full join {_HEAD} b on a.path = b.path where a.path is null or b.path is null or a.oid <> b.oid or a.mode <> b.mode",
    "status_matrix": f"""select p path, (h is not null)::bigint head, (case when w is null then 0 when h is not distinct from w then 1 else 2 end)::bigint workdir, (case when s is null then 0 when s is not distinct from h then 1 when s is not distinct from w then 2 else 3 end)::bigint stage from (
 select coalesce(a.path, b.path, c.path) p, a.oid h, b.oid w, c.oid s from {_BASE} a full join {_HEAD} b on a.path = b.path full join (select * from {_BASE} where path not like '%5') c on coalesce(a.path, b.path) = c.path)""",
    "content_verdict": f"""select doc_id, case when octet_length(encode(text)) > 10485760 then 'large' when contains(text, chr(0)) or length(substr(text, 1, 8192)) - length(regexp_replace(substr(text, 1, 8192), '[\\x00-\\x08\\x0E-\\x1F]', '', 'g')) > 0.3 * length(substr(text, 1, 8192)) then 'binary'
 when ends_with(lower(path), '.d.ts') or {_PC["is_generated"]} or regexp_matches(path, '(?i)(\\.min\\.(js|css|html)|\\.bundle\\.(js|css)|\\.map)$') or len(list_filter(string_split(text, chr(10))[1:50], lambda x: regexp_matches(x, '(?i)^\\s*({"|".join(vocab.GENERATED_HEADERS)})'))) > 0
 or (len(string_split(text, chr(10))) < 100 and len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 500)) > 0) then 'generated' end verdict from documents join {_PATHS} using (doc_id)""",
    "diff_intervals": """with l as (select doc_id, source, unnest(range(0, len(string_split(text, chr(10))))) i from documents),
n as (select doc_id, source, case when i % 4 = 1 then '-' else '+' end side, case when i % 4 = 1 then 5 + sum((i % 4 in (0, 1))::int) over w - 1 else 7 + sum((i % 4 <> 1)::int) over w - 1 end line, i from l window w as (partition by doc_id order by i)),
k as (select * from n where i % 4 <> 0),
g as (select *, line - row_number() over (partition by doc_id, side order by line) gr from k)
select doc_id, source path, side, min(line)::bigint as start, max(line)::bigint as end from g group by doc_id, source, side, gr""",
    "diagnostics": f"""with t as (select event_id id, [{", ".join(f"'{x}'" for x in _TOOLS)}][event_id % 7 + 1] tool, 'f' || user_id f, cast(json_extract_string(props, '$.k') as int) k, case when event_id % 2 = 0 then 'error' else 'warning' end sev, event_type m from events)
select id, f file, greatest(1, case when tool in ('mypy', 'bandit') then coalesce(k, 1) else 1 end)::bigint line,
 case tool when 'ruff' then 'critical' when 'mypy' then case sev when 'error' then 'high' else 'low' end when 'pyright' then case sev when 'error' then 'high' else 'medium' end when 'bandit' then 'info' end severity,
 m message, tool source, case when tool in ('ruff', 'mypy') then 'E501' end rule from t where tool in ('ruff', 'mypy', 'pyright', 'bandit')""",
    "diagnostic_dedup": "select user_id, event_type, min(event_id) event_id from events group by 1, 2",
    "fixture_metrics": f"select * from {_METRICS}",
    "scorecard": f"""with r as (select *, (fixture * 37) % 1009 latency from {_METRICS}), a as (select count(*) n, sum(true_positives)::bigint tp, sum(false_positives)::bigint fp, sum(false_negatives)::bigint fn, list_sort(list(latency)) l from r)
select n, tp, fp, fn, tp / (tp + fp) as precision, tp / (tp + fn) recall, fp / (tp + fp) false_positive_rate, l[floor(n * 0.5)::int + 1] p50, l[least(n - 1, floor(n * 0.95))::int + 1] p95, tp / (tp + fp) >= 0.7 and fp / (tp + fp) <= 0.3 and tp / (tp + fn) >= 0.7 passed from a""",
    "sarif": f"select category rule_id, {_case('severity', vocab.SARIF_LEVEL, 'note')} as level, count(*) n from {F_} group by 1, 2",
    "quiet_report": f"select file || ':' || start_line || ': [' || upper(severity) || '] ' || title as value from {F_}",
}
ORACLES["merge_clusters"] = f"""with k as (select *, file || ':' || start_line || ':' || end_line ek from {_ISLANDS}),
e as (select file, cluster, ek, min(id) m from k group by 1, 2, 3),
e5 as (select file, cluster, string_agg(ek, ',' order by m) ks from (select *, row_number() over (partition by file, cluster order by m) rn from e) where rn <= 5 group by 1, 2)
select file, cluster::bigint as cluster, max({_LEVEL})::bigint severity_level, max(conf_pct) / 100 confidence, min(start_line)::bigint start_line, max(end_line)::bigint end_line, count(*) members,
 arg_max(id, (conf_pct, length(message), -id)) rep_id, arg_max(title, (conf_pct, length(message), -id)) title, array_to_string(list_sort(list(distinct reviewer)), ',') reviewers, any_value(ks) evidence_keys
from k join e5 using (file, cluster) group by 1, 2"""
