"""Operator 5, URL filter.

Stated host and path rules decide first: a rule fits its host and all subdomains if the path starts with the rule's,
and the longest rule (host and path together) wins. Whatever no rule fits, a logistic regression on hashed character
n-grams of host and path decides. It is trained from the small labelled table below when the operator is built, by
full-batch gradient descent from zero weights, so it is the same in every run and on every executor.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; the model judges it, and as
an empty url has no n-gram the bias decides; a probability at the threshold blocks. Repeated rows, and rows with a null id,
are judged alike. Extra columns aren't read. A url of any length is held whole. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict), fixed values of the contract.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: The labelled table: host and path, and whether to block.
BLOCKED = """
cheap-pills.example.com/en/buy  www.cheap-pills.example.net/de/1  cheap-meds.example.org/sale  pills-online.example.com/order
spam-farm.example.org/en/2  spam-farm.example.net/fr/9  www.spam-links.example.com/list  link-farm.example.net/out
casino-bonus.example.com/win  free-casino.example.org/spin  slots-winner.example.net/jackpot  poker-cash.example.com/play
adult-cams.example.com/live  hot-singles.example.net/meet  xxx-videos.example.org/watch  porn-tube.example.com/v/1
crack-keygen.example.net/download  warez-serials.example.org/get  free-loans.example.com/apply  payday-cash.example.net/now
replica-watches.example.com/shop  fake-rolex.example.org/buy  seo-backlinks.example.net/cheap  click-here-win.example.com/prize
""".split()
ALLOWED = """
library.example.org/catalogue/12  news.example.com/world/2020/05  blog.writer.example.net/post/3  www.museum.example.org/visit
docs.project.example.com/guide/start  university.example.org/courses/math  forum.garden.example.net/thread/88  m.weather.example.com/today
theatre.example.org/programme/5  travel.example.com/fr/lyon  blog.teacher.example.net/lesson/53  www.theology.example.org/lecture/18
science.example.com/article/7  history.example.net/period/roman  city-council.example.org/minutes  recipes.example.com/bread
gardening.example.net/en/roses  m.railway.example.org/timetable/325  blog.astronomy.example.com/de/mars  wiki.example.org/page/river
school.example.net/timetable  hospital.example.org/departments  music.example.com/scores/bach  maps.example.net/route/9
""".split()

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct character n-grams of host and path, each in its own field."""
    found = set()
    for field, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(text) > 2:
            found.update(f"{field}{text[i : i + n]}" for n in GRAMS for i in range(len(text) - n + 1))
    return np.unique(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in sorted(found)], np.int64))


@lru_cache(1)
def trained(steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    rows = [(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED]
    x = np.zeros((len(rows), BUCKETS))
    for i, (u, _) in enumerate(rows):
        host, _, path = u.partition("/")
        at = features(host, "/" + path)
        x[i, at] = 1 / np.sqrt(len(at))
    y = np.array([label for _, label in rows])
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= rate * (x.T @ (p - y) + decay * w)
        b -= rate * (p - y).mean()
    return w, b


def probability(host: str, path: str) -> float:
    w, b = trained()
    at = features(host, path)
    z = b + (w[at].sum() / np.sqrt(len(at)) if len(at) else 0.0)
    return float(1 / (1 + np.exp(-z)))


def probabilities(hosts: list[str | None], paths: list[str | None]) -> list[float | None]:
    """probability() of each different pair once; a null host isn't judged."""
    memo: dict[tuple, float | None] = {}
    for key in zip(hosts, paths, strict=True):
        if key not in memo:
            memo[key] = None if key[0] is None else probability(*key)
    return [memo[key] for key in zip(hosts, paths, strict=True)]


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return host, path


def ruled(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule, host and path joined, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep's columns with host, path, rule, verdict and the model's block probability (null where a rule decides)."""

    @F.pandas_udf("double")
    def scored(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(probabilities(host.tolist(), path.tolist()), dtype="float64")

    host, path = parts(F.col("url"))
    cut = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    cut = cut.withColumns({"rule": rule, "_ruled": verdict, "_host": F.when(verdict.isNull(), F.col("host")), "_path": F.when(verdict.isNull(), F.col("path"))})
    cut = cut.withColumn("block_probability", scored("_host", "_path"))
    model = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return cut.select(*keep, "host", "path", "rule", F.coalesce("_ruled", model).alias("verdict"), "block_probability")
