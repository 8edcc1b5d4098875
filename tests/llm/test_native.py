"""The operators made of DataFrame functions only, against brute force."""

import hashlib
import random
import re

import pytest

from adjudica.llm import line_dedup, mixing, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32])


def text_of(spans):
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in spans)


def test_secrets_match_brute_force(spark):
    rnd = random.Random(2)
    parts = ["token=secret:abcdefgh12", "PassWord : 'hunter2hunter2'", "AKIA" + "B2" * 8, "AKIAAKIA", "0123456789abcdef" * 2, "api_key=x", "é日", "\n", "   ", "", "'", "secret = ", "deadbeef", "x" * 30 + "A1"]
    texts = [None, "", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(150)), "token=abcdefgh " * 700]
    df = spark.createDataFrame([(i, t, f"s{i % 3}", "en", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, found string")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark, df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = base_spans((t or "").translate({0xE000: "?", 0xE001: "?", 0xE002: "?"}))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == q for _, k, _ in spans) for q in range(3))
        assert r.base_sha256 == hashlib.sha256(text_of(spans).encode()).hexdigest()
        assert set(filter(None, text_of(spans).split(","))) <= set(r.spans.split(","))


def test_ownership_separates_examples_from_live_values(spark):
    key = "Zx9Kq27LmPw83TyUiOp45AsDfGh61J"
    rows = [(1, f"see {key}", "a", "en"), (2, "password=changeme123", "a", "en"), (3, "password=changeme123", "b", "en"), (4, "password=onlyhere99", "b", "en"), (5, f"Aa1{key}", "c", "en"), (6, f"Aa1{key}", "d", "en")]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))).collect()}
    assert got[1].spans == "owned:4:34" and got[5].spans == ""
    assert (got[2].n_live, got[2].n_example, got[4].n_live) == (0, 1, 1)


def test_period_is_earliest_deadline_first(spark):
    rnd = random.Random(1)
    for _ in range(4):
        w = [rnd.randint(1, 9) for _ in range(rnd.randint(1, 5))]
        total, sent, want = sum(w), [0] * len(w), []
        for t in range(total):
            ready = [(-(-(sent[i] + 1) * total // w[i]), i) for i in range(len(w)) if sent[i] < w[i] and sent[i] * total // w[i] <= t]
            i = min(ready)[1]
            sent[i] += 1
            want.append(i)
            assert all(abs(sent[j] - (t + 1) * w[j] / total) < 1 for j in range(len(w)))
        assert mixing._period(spark, w) == want


def test_mix_places_every_row_once_within_a_block_of_its_share(spark):
    sizes = {"a": 400, "b": 100, "c": 37, None: 11}
    rows = [(i * 7 % 5000, f"t{i}", s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 5, "b": 3, "c": 1}
    got = mixing.mixed(spark, df, weights=weights, block_rows=4).collect()
    assert sorted((r.doc_id, r.source or "") for r in got) == sorted((d, s or "") for d, _, s in rows)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    order = sorted({(r.slot, r.source) for r in got})
    slots = [s for s, _ in order]
    assert slots == list(range(len(slots)))
    first_end = min(max(s for s, x in order if x == src) for src in sizes)
    sent = dict.fromkeys(sizes, 0)
    share = {s: weights.get(s, 1) / 10 for s in sizes}
    for slot, src in order[: first_end + 1]:
        sent[src] += 1
        assert all(abs(sent[s] - (slot + 1) * share[s]) < 1 for s in sizes)


def test_mix_refuses_unbounded_plans(spark):
    df = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mixed(spark, df, weights={"a": 0})
    with pytest.raises(ValueError):
        mixing.mixed(spark, df, source_bound=0)


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def variants(n, seed, low, high):
    rnd = random.Random(seed)
    out = set()
    for _ in range(n):
        base = [rnd.choice("abcdé ") for _ in range(rnd.randint(low, high))]
        out.add("".join(base))
        for _ in range(6):
            s = base[:]
            for _ in range(rnd.randint(1, 3)):
                p, o = rnd.randrange(len(s)), rnd.random()
                if o < 0.33:
                    s[p] = rnd.choice("abcdé ")
                elif o < 0.66:
                    del s[p]
                else:
                    s.insert(p, rnd.choice("abcdé "))
            out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize(("edits", "crowded"), [(2, 64), (2, 2), (1, 16)])
def test_edit_join_loses_no_link(spark, edits, crowded):
    lines = sorted({*variants(30, edits, 18, 40), *variants(12, edits, 3, 22)})
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = sorted(tuple(sorted((r.a, r.b))) for r in line_dedup.links(spark, line_dedup.long_enough(df, edits, 10), edits=edits, crowded=crowded).collect())
    near = lambda a, b: abs(len(a) - len(b)) <= edits and edit(a, b) <= min(edits, len(a) // 10, len(b) // 10)
    assert got == [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if near(lines[i], lines[j])]


def test_lines_of_documents(spark):
    a = "a line that is long enough to be joined"
    rows = [(1, f"{a}\n\nx"), (2, a.replace("long", "lung")), (3, "x\nx\n"), (4, None), (None, a), (5, "")]
    near = line_dedup.near_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in line_dedup.digest(near).collect()}
    assert {k: (r.n_lines, r.n_kept, r.n_linked, r.n_links) for k, r in got.items()} == {1: (3, 2, 1, 1), 2: (1, 0, 1, 1), 3: (3, 1, 0, 0), 4: (1, 1, 0, 0), None: (1, 1, 1, 1), 5: (1, 1, 0, 0)}
    assert got[4].classes == got[5].classes
