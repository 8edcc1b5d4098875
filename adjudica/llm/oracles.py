"""DuckDB SQL of the queries that SQL can express on whole tables."""

_WORDS9 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
with b as (select item_id, {_WORDS9} w from benchmark),
win as (select distinct item_id, list_slice(w, i, i + 9) k
        from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) i from b where len(w) > 0)),
sizes as (select distinct len(k) n from win),
d as (select doc_id, {_WORDS9} w from documents),
places as (select doc_id, n, unnest(range(1, len(w) - n + 2)) i, w from d, sizes where len(w) >= n),
hit as (select p.doc_id, p.i, p.n, win.item_id from places p join win on list_slice(p.w, p.i, p.i + p.n - 1) = win.k),
words as (select doc_id, count(distinct j) c from (select distinct doc_id, unnest(range(i, i + n)) j from (select distinct doc_id, i, n from hit)) group by 1),
items as (select doc_id, count(distinct item_id) c, list_sort(list(distinct cast(item_id as varchar))) l from hit group by 1),
ten as (select distinct k, list_slice(k, 1, 5) x, list_slice(k, 6, 10) y from win where len(k) = 10),
spots as (select doc_id, list_slice(w, i, i + 9) q from places where n = 10),
pairs as (select doc_id, q, k from spots join ten on list_slice(q, 1, 5) = x union select doc_id, q, k from spots join ten on list_slice(q, 6, 10) = y),
near as (select doc_id, count(distinct k) c from pairs where len(list_filter(range(1, 11), lambda j: q[j] = k[j])) = 9 group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(words.c, 0)::bigint n_hit, coalesce(items.c, 0)::bigint n_items,
       sha256(array_to_string(coalesce(items.l, []::varchar[]), ',')) items_sha256, coalesce(words.c, 0) > 0 contaminated, coalesce(near.c, 0)::bigint n_near
from d left join words using (doc_id) left join items using (doc_id) left join near using (doc_id)
"""

OP10 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sh as (select distinct doc_id, hash(list_slice(w, i, i + 3)) h from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by 1),
inter as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
low as (select a, min(b) m from reach group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) component_id,
       w.doc_id = least(w.doc_id, coalesce(low.m, w.doc_id)) kept
from w left join n using (doc_id) left join low on low.a = w.doc_id
"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, keep: str) -> str:
    """Matches with their places: marked with private-use characters, split, and lengths summed."""
    return f"""
 select doc_id, owner, repo, {kind} kind, s, s + length(f) e, v from (
  select doc_id, owner, repo, f, v, coalesce(sum(length(f) + length(r)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) + first_ s from (
   select doc_id, owner, repo, i, first_, split_part(p, chr(57345), 1) f, split_part(split_part(p, chr(57345), 2), chr(57346), 1) v, split_part(p, chr(57346), 2) r from (
    select doc_id, owner, repo, length(l[1]) first_, unnest(l[2:]) p, unnest(range(1, len(l))) i from (
     select doc_id, owner, repo, string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\0' || chr(57345) || '\\2' || chr(57346), 'g'), chr(57344)) l from t)))) where {keep}"""


OP3 = f"""
with t as (select doc_id, source owner, concat_ws(':', source, lang) repo, translate(coalesce(text, ''), chr(57344) || chr(57345) || chr(57346), '???') t from documents),
base as ({_spans(0, _ASSIGN, "length(v) >= 8")} union all {_spans(1, "()(AKIA[A-Z0-9]+)", "length(v) >= 16")} union all {_spans(2, "()([0-9a-f]{32,})", "true")}),
opaque as ({_spans(3, "()([A-Za-z0-9+/_-]{24,})", "regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')")}),
free as (select * from opaque o where not exists (select 1 from base b where b.doc_id = o.doc_id and b.s < o.e and o.s < b.e)),
found as (select * from base union all select * from free),
own as (select v, count(distinct owner) <= 1 and count(distinct (owner, repo)) <= 2 live from found group by 1),
judged as (select doc_id, kind, s, e, live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s::bigint || ':' || e::bigint x from found join own using (v) where kind < 3 or live),
g as (select doc_id, count(*) filter (kind = 0) a, count(*) filter (kind = 1) c, count(*) filter (kind = 2) h, string_agg(x, ',' order by s, kind, e) filter (kind < 3) b, string_agg(x, ',' order by s, kind, e) al, count(*) filter (live) li, count(*) filter (not live) ex from judged group by 1)
select doc_id, coalesce(a, 0) n_assign, coalesce(c, 0) n_access, coalesce(h, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(al, '') spans, coalesce(li, 0) n_live, coalesce(ex, 0) n_example from documents left join g using (doc_id)
"""

OP11 = r"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
g as (select distinct lang, source from d),
kept as (select lang, term from (select lang, unnest(list_distinct(w)) term from d) group by 1, 2 having count(*) >= 30),
c as (select lang, source, term, count(*) n from (select lang, source, unnest(w) term from d) join kept using (lang, term) group by 1, 2, 3),
size as (select lang, count(*) v from kept group by 1),
x as (select g.lang, g.source, kept.term, coalesce(n, 0) n from g join kept using (lang) left join c using (lang, source, term)),
y as (select *, sum(n) over (partition by lang, source) total, sum(n) over (partition by lang, term) ln, sum(n) over (partition by lang) ltotal from x),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v)::hugeint p, 1 + (1000000000::hugeint * (ln + 5)) // (ltotal + 5 * v)::hugeint q from y join size using (lang)),
far as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source != b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
terms as (select lang, source, 'term' part, term item, (p - q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 50
"""

_LEADS = ", ".join(f"lead(x, {k}) over o" for k in range(1, 20))
OP13 = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
word as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) j from d),
win as (select doc_id, j, md5(concat_ws(' ', x, {_LEADS})) h, lead(x, 19) over o z from word window o as (partition by doc_id order by j)),
again as (select doc_id, j i, row_number() over (partition by h order by doc_id, j) k from win where z is not null),
gone as (select distinct doc_id, unnest(range(i, i + 20)) j from again where k > 1),
g as (select doc_id, count(gone.j) r, string_agg(x, ' ' order by j) filter (gone.j is null) t from word left join gone using (doc_id, j) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(r, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join g using (doc_id)
"""

SQL = {"op3_secret_scan": OP3, "op9_decontaminate": OP9, "op10_near_dedup": OP10, "op11_source_divergence": OP11, "op13_substring_dedup": OP13}
