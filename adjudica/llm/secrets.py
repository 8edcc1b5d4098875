"""Operator 3, secret scan with corpus-wide ownership frequency. DataFrame functions only.

Candidates are the base kinds (assign, access, hex) and ``opaque`` tokens: runs of 24 or more token characters that mix
upper case, lower case and digits and touch no base span. Each candidate's value is hashed; over the whole corpus the
hashes are counted by distinct repositories and owners. A value of one owner and few repositories looks live; a value
that several owners have is a copied example. Base spans always stay; opaque tokens become spans of kind ``owned`` only
if they look live.

Positions are found without Python: each match is marked with private-use characters, the text is split at the marks,
and a fold adds the pieces' lengths. The marks are replaced in the text first by a character that no pattern matches.
The fold works in chunks, so that a text of very many matches isn't copied for each.

Defined results: null is an empty text, without spans. A null owner or repository is one of its own. Repeated rows count
once for each repository and keep their own spans; rows with a null id are scanned like any other. Spans of equal start are
in the order of the kinds. Extra columns aren't read. A text of any length is scanned whole, in time linear in its matches.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store

#: Patterns of the contract, fixed values. The value is group 2 for assign, the whole match for the others.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]+)"
HEX = r"()([0-9a-f]{32,})"
OPAQUE = r"()([A-Za-z0-9+/_-]{24,})"
KINDS = ("assign", "access", "hex", "owned")

_OPEN, _MID, _CLOSE = "\ue000", "\ue001", "\ue002"
_CHUNK = 256
_SPAN = "array<struct<start: long, end: long, value: string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of struct<start, end, value>, in code points, value being group 2."""
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$0{_MID}$2{_CLOSE}")
    pieces = F.split(marked, _OPEN)
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.split(p, f"[{_MID}{_CLOSE}]"))
    none = F.array().cast(_SPAN)

    def step(state: Column, p: Column) -> Column:
        end = state["at"] + F.length(p[0])
        span = F.struct(state["at"].alias("start"), end.alias("end"), p[1].alias("value"))
        return F.struct((end + F.length(p[2])).cast("long").alias("at"), F.array_append(state["out"], span).alias("out"))

    def chunk(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.array_append(state["out"], x["out"]).alias("out")))[0]

    count = F.size(rest)
    chunks = F.transform(F.sequence(F.lit(0), ((count - 1) / F.lit(_CHUNK)).cast("int")), lambda i: F.slice(rest, i * _CHUNK + 1, F.lit(_CHUNK)))
    first = F.struct(F.length(pieces[0]).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.when(count > 0, F.flatten(F.aggregate(chunks, first, chunk, lambda s: s["out"]))).otherwise(none)


#: What a text must have for an assign match to be possible.
_KEYS = "(?i)password|passwd|secret|token|api_?key"


def guarded(possible: Column, spans: Column) -> Column:
    """The spans, looked for only where a plain test says that there may be any."""
    return F.when(possible, spans).otherwise(F.array().cast(_SPAN))


def _marked(spans: Column, side: str, free: Callable, grow: Callable, start: Column) -> Column:
    """Spans in order without the opaque ones that aren't free of the base spans passed so far (reach)."""
    kind = "array<struct<start: long, kind: int, end: long, hash: string>>"

    def step(state: Column, s: Column) -> Column:
        base = s["kind"] < 3
        stays = base | free(s, state["reach"])
        return F.struct(F.when(base, grow(s, state["reach"])).otherwise(state["reach"]).alias("reach"), F.when(stays, F.array_append(state["out"], s)).otherwise(state["out"]).alias("out"))

    def chunk(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["reach"].alias("reach"), F.array().cast(kind).alias("out")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["reach"].alias("reach"), F.array_append(state["out"], x["out"]).alias("out")))[0]

    count = F.size(spans)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(count, F.lit(1)) - 1) / F.lit(_CHUNK)).cast("int")), lambda i: F.slice(spans, i * _CHUNK + 1, F.lit(_CHUNK)))
    first = F.struct(start.alias("reach"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.flatten(F.aggregate(chunks, first, chunk, lambda s: s["out"]))


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Adds owner, repository and found (array of struct<start, kind, end, hash>, sorted) to doc_id; drops the text."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _OPEN + _MID + _CLOSE, "???")
    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", owner.alias("owner"), repository.alias("repository"), text.alias("_t"))
    cut = cut.select(
        "row",
        "doc_id",
        "owner",
        "repository",
        guarded(F.col("_t").rlike(_KEYS), F.filter(matches(F.col("_t"), ASSIGN), lambda s: F.length(s["value"]) >= 8)).alias("_0"),
        guarded(F.contains("_t", F.lit("AKIA")), F.filter(matches(F.col("_t"), ACCESS), lambda s: F.length(s["value"]) >= 16)).alias("_1"),
        guarded(F.col("_t").rlike("[0-9a-f]{32}"), matches(F.col("_t"), HEX)).alias("_2"),
        guarded(F.col("_t").rlike("[A-Za-z0-9+/_-]{24}"), F.filter(matches(F.col("_t"), OPAQUE), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))).alias("_o"),
    )

    def kind(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))

    # Spans in order, opaque ones before base ones of the same start: an opaque span is free if no base span before it ends
    # behind its start, and none after it starts before its end. One pass forward, one back, in chunks.
    every = F.array_sort(F.concat(*[kind(k, F.col(f"_{k}")) for k in range(3)], kind(3, F.col("_o"))))
    cut = cut.withColumn("_every", every)
    ahead = _marked(F.col("_every"), "end", lambda s, reach: s["start"] >= reach, lambda s, reach: F.greatest(reach, s["end"]), F.lit(0).cast("long"))
    cut = cut.withColumn("_every", F.when(F.size("_o") > 0, ahead).otherwise(F.col("_every")))
    last = F.lit((1 << 62)).cast("long")
    back = _marked(F.reverse("_every"), "start", lambda s, reach: s["end"] <= reach, lambda s, reach: F.least(reach, s["start"]), last)
    cut = cut.withColumn("_every", F.when(F.size("_o") > 0, F.reverse(back)).otherwise(F.col("_every")))
    return cut.select("row", "doc_id", "owner", "repository", F.col("_every").alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate hash: the number of distinct owners and repositories, over all rows."""
    each = found.select(F.explode("found.hash").alias("hash"), F.coalesce("owner", F.lit("\u0000")).alias("owner"), F.coalesce("repository", F.lit("\u0000")).alias("repository"))
    pairs = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n_repositories"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n_repositories").alias("n_repositories"))


def scan(spark: SparkSession, docs: DataFrame, owner: Column | None = None, repository: Column | None = None, live_owners: int = 1, live_repositories: int = 2, scope: str = "op") -> DataFrame:
    """doc_id and spans: array of struct<start, kind, end, hash, live>, sorted; opaque tokens only where they look live."""
    owner = F.col("source").cast("string") if owner is None else owner
    repository = F.concat_ws(":", F.col("source").cast("string"), F.col("lang").cast("string")) if repository is None else repository
    found = store(spark, candidates(docs, owner, repository), "candidates", scope)
    some = found.where(F.size("found") > 0)
    each = some.select("row", F.explode("found").alias("c")).select("row", "c.*")
    live = ((F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)).alias("live")
    judged = each.join(ownership(some), "hash").select("row", F.struct("start", "kind", "end", "hash", live).alias("s"))
    judged = judged.where("s.kind < 3 or s.live").groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    return found.select("row", "doc_id").join(judged, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s rows."""
    count = lambda cond: F.size(F.filter("spans", cond)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return scanned.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )
