"""Operator 2, main text of web pages by a site style tree.

Every page is read into blocks: runs of text between block-level boundaries. A block's style node is the path of
element names and classes from the root; the pages of a host share one tree of style nodes. For each node the whole
corpus is counted: on how many pages of the host it is, how often it looks alike (presentation: the names and number of
blocks that follow it on the page) and how often it says the same (content). The importance of a node is the entropy of
these counts, normalised by the number of pages: near 0 for what is the same on every page, near 1 for what differs.

A block's importance is the lesser of its node's and of its own text's: 1 - log c / log n for a text on c pages, of n
contents of its node, so that a sentence repeated in many articles counts as little as a repeated element.

Importance decides every block that no name states to be noise: those of least importance (``threshold``) are left out.
Names are a prior, the innermost that states a role: an article in a sidebar is content, an advert in an article noise, and
what states both is left to the tree. Articles and main elements count like ``PRIOR`` further contents of importance 1, which few pages
can't outweigh. Navigation, headers, footers, sidebars, adverts, forms and comments are left out: they differ from page to
page too, so that entropy can't speak for them.

Blocks are joined in page order. Pages are parsed once; what is parsed is stored in the shared folder. Blocks are shuffled
by node and text, never by host alone, and texts packed, by page.

Defined results: null or empty html has the empty text, as has a page without content blocks. A null url is a host of
its own. A host's only page keeps its unnamed blocks. Repeated rows are counted and extracted each, those with a null
page_id too; equal importance at the threshold stays. Extra columns aren't read. A tag without an end is text. Pages are
read in time linear in their length and held whole, one at a time, in a worker. An empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from bisect import bisect_left
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, store, task

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_PART = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?""")
_BARE = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_EQUALS = re.compile(r"\s*=\s*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")

#: Element names of HTML, fixed values.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object".split())
#: An opening tag of these ends an open one of the same set within the nearest block container.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "summary", "figcaption"}

#: Roles that element names and class or id words state.
NOISE_NAMES = frozenset("nav aside footer form header menu dialog button select label".split())
NOISE_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header menu modal nav navbar navigation newsletter notice pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that make a compound tell how its element is, not what it is; and what has headers and footers of its own.
STATE_FIRST = frozenset("has have is no not with without".split())
STATE_LAST = frozenset("closed disabled enabled off on open".split())
EDGES = frozenset("header footer".split())
CONTENT_NAMES = frozenset("article main".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
#: So many contents of importance 1 stand behind a stated article.
PRIOR = 8


def host_of(url: str | None) -> str:
    if not url or "://" not in url:
        return ""
    try:
        return (urlsplit(url).netloc or "").lower()
    except ValueError:
        return ""


class _Source:
    """A page's text with searches that never look twice for what isn't there, so that any page is read in linear time."""

    def __init__(self, text: str):
        self.text = text
        self._none: dict[str, int] = {}
        self._next: dict[str, tuple[int, int]] = {}
        self._dead: set[int] = set()  # places between attributes from which no tag ends
        self._stops: tuple[list[int], list[int]] | None = None

    def find(self, what: str, at: int) -> int:
        if at >= self._none.get(what, len(self.text) + 1):
            return -1
        a, b = self._next.get(what, (0, -1))
        if a <= at <= b:
            return b
        got = self.text.find(what, at)
        if got < 0:
            self._none[what] = at
        else:
            self._next[what] = at, got
        return got

    def tag(self, at: int) -> tuple[str, bool, dict[str, str], bool, int] | None:
        """(name, closes, attributes, empty, end) of the tag whose < is at ``at``. Quotes count only around a value; one that is
        never closed is part of the value. None if this is no tag, or one without an end."""
        m = _NAME.match(self.text, at + 1)
        if not m or self.find(">", at) < 0:
            return None
        closes, i, found, end = m[0][0] == "/", m.end(), {}, -1
        if self.text[i] == ">":
            return m[1].lower(), closes, found, False, i + 1
        if self._dead and not self._ends(i):
            return None
        passed = []
        while True:
            passed.append(i)
            if end < i:
                end = self.find(">", i)
            if end < 0:
                self._dead.update(passed)
                return None
            part = _PART.match(self.text, i)
            if not part or part.start(1) > end:
                return m[1].lower(), closes, found, self.text[end - 1] == "/", end + 1
            i, value = part.end(), ""
            if part[2]:
                quote = self.text[i : i + 1]
                shut = self.find(quote, i + 1) if quote in ("'", '"') and quote else -1
                if shut >= 0:
                    value, i = self.text[i + 1 : shut], shut + 1
                else:
                    bare = _BARE.match(self.text, i)
                    value, i = bare[0], bare.end()
            found.setdefault(part[1].lower(), value)

    def _ends(self, i: int) -> bool:
        """Whether the tag whose attributes begin at i has an end. Once one tag has none, others that begin inside it are first
        followed by places alone: no place is passed twice, and no run of characters is looked at again."""
        text = self.text
        if self._stops is None:
            self._stops = [m.start() for m in re.finditer(r"[\s/>=]", text)], [m.start() for m in re.finditer(r"[\s>]", text)]
        after = lambda k, at: stops[j] if (j := bisect_left(stops := self._stops[k], at)) < len(stops) else len(text)
        passed = []
        while i not in self._dead:
            passed.append(i)
            end = self.find(">", i)
            if end < 0:
                break
            name = _GAP.match(text, i).end()
            if name >= len(text) or text[name] in ">=" or name > end:
                return True
            i = after(0, name)
            sign = _EQUALS.match(text, i)
            if sign:
                i = sign.end()
                quote = text[i : i + 1]
                shut = self.find(quote, i + 1) if quote in ("'", '"') and quote else -1
                i = shut + 1 if shut >= 0 else after(1, i)
        self._dead.update(passed)
        return False


def _role(name: str, attributes: dict[str, str], outer: str) -> str:
    """'n' noise, 'c' content, 'h' hidden or '' for an element, which then has the role around it; headers and footers of an
    article are its own. A class or id is taken by its words, camel case too. It is noise where its first or last word is, or
    where a word is and none is of content; content where it ends in such a word (main-content). Inner words of both kinds
    (content-sidebar-wrap), states (has-sidebar, comments-open), and headers and footers of content (entry-header) state nothing."""
    noise = content = False
    if attributes and name not in ("html", "body"):
        if ("hidden" in attributes and attributes["hidden"].lower() != "until-found") or _HIDDEN.search(attributes.get("style", "")):
            return "h"
        for key in ("class", "id", "role"):
            for token in attributes.get(key, "").split():
                words = [w.lower() for w in _WORDS.findall(token)]
                bad, good = [w in NOISE_WORDS for w in words], [w in CONTENT_WORDS for w in words]
                if not words or any(bad) and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
                    continue
                if any(bad) and words[-1] in EDGES and (any(good) or outer == "c"):
                    continue
                noise |= bad[0] or bad[-1] or any(bad) and not any(good)
                content |= good[-1] and not bad[0]
    if name in CONTENT_NAMES:
        return "n" if noise and not content else "c"
    if name in NOISE_NAMES and not (outer == "c" and name == "header"):
        return "n"
    if noise:
        return "u" if content else "n"
    return "c" if content and outer != "c" else ""


_STOPS = frozenset("ul ol dl table tbody div article section select menu".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def blocks(page: str) -> list[tuple[tuple[int, str], str, str]]:
    """((style node, element name), role, text) of each block of a page in order; role is c, n or empty. A style node is a hash
    of the names and classes from the root, made from its parent's. Text of inline elements that are noise or hidden is left
    out of the block around them."""
    source = _Source(page)
    out: list[tuple[tuple[int, str], str, str]] = []
    # name, style node, its element's name, role, and the role of the block that the text here belongs to
    stack: list[tuple[str, int, str, str, str]] = [("", 0, "", "", "")]
    open_: dict[str, int] = {}
    words: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if words:
            text = _SPACE.sub(" ", _html.unescape("".join(words))).strip()
            words.clear()
            if text:
                _, node, name, _, role = stack[-1]
                out.append(((node, name), "n" if role == "h" else role.replace("u", ""), text))

    def say(text: str) -> None:
        role, around = stack[-1][3:]
        if role not in ("n", "h") or role == around:
            words.append(text)

    def pop(k: int) -> None:
        for name, *_ in stack[k:]:
            open_[name] -= 1
        del stack[k:]

    def close(name: str, stop: frozenset[str] | set[str] = frozenset()) -> None:
        if not open_.get(name):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                if any(x[0] in BLOCK or x[4] != stack[k - 1][4] for x in stack[k:]):
                    flush()
                pop(k)
                return
            if stack[k][0] in stop:
                return

    while at < end:
        start = source.find("<", at)
        if start != at:
            say(page[at : start if start >= 0 else end])
        if start < 0:
            break
        at = start
        if page.startswith("<!--", at):
            stop = source.find("-->", at + 2)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at):
            mark = "]]>" if page.startswith("<![CDATA[", at) else ">"
            stop = source.find(mark, at)
            if stop >= 0:
                at = stop + len(mark)
                continue
        tag = source.tag(at)
        if tag is None:
            say("<")
            at += 1
            continue
        name, closes, attributes, empty, at = tag
        if closes:
            close(name)
            continue
        if name in RAW:
            stop = _RAW_END[name].search(page, at)
            last = source.find(">", stop.end()) if stop else -1
            at = last + 1 if last >= 0 else end
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and open_.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
        for old in SELF_CLOSING.get(name, ()):
            close(old, _STOPS - {old})
        if name == "br":
            say(" ")
        if name in VOID or empty:
            continue
        _, node, label, role, around = stack[-1]
        own = "" if role == "h" else _role(name, attributes, role)
        if name in BLOCK:
            # Inline elements don't make style nodes of their own: the block's text belongs to its block element.
            node, label, around = _hash(f"{node} {name}.{attributes.get('class', '')}"), name, own or role
        elif own == "c" and role == "n":  # content inside noise is a block of its own
            flush()
            around = own
        stack.append((name, node, label, own or role, around))
        open_[name] = open_.get(name, 0) + 1
    flush()
    return out


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


PARSED = "row long, page_id long, url string, texts binary, roles string, nodes array<long>, looks array<long>, says array<long>, firsts array<boolean>"


def parsed(pages: DataFrame) -> DataFrame:
    """One row for each page: its blocks' texts (noise left out; one compressed text of lines), roles, style nodes and
    hashes of looks and content, and whether the page says the same at that node for the first time."""

    @task(__name__)
    def run(rows):
        row = TaskContext.get().partitionId() << 36
        for batch in batches(rows):
            out: list[list] = [[] for _ in range(9)]
            for page, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                found = blocks(source or "")
                names = [label for (_, label), _, _ in found]
                host = host_of(url)
                keep = [k for k, (_, r, _) in enumerate(found) if r != "n"]
                seen: set[tuple] = set()
                firsts = [(key := (found[k][0], found[k][2])) not in seen and not seen.add(key) for k in keep]
                values = (
                    row, page, url, zlib.compress("\n".join(found[k][2] for k in keep).encode(), 1), "".join(found[k][1] or "u" for k in keep),
                    [_hash(f"{host} {found[k][0][0]}") for k in keep],
                    [_hash(" ".join(names[max(0, k - 1) : k + 2])) for k in keep],
                    [_hash(found[k][2]) for k in keep], firsts,
                )
                row += 1
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), longs, longs, longs, pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in PARSED.split(", ")])

    return pages.select("page_id", "url", "html").mapInArrow(run, PARSED)


def importance(spark: SparkSession, tree: DataFrame, below: float, scope: str = "op") -> DataFrame:
    """node, says, n, importance: contents of less importance than ``below``. A node's is the larger of presentation's and
    content's normalised entropy; n counts its contents."""
    each = tree.select(F.explode(F.arrays_zip("nodes", "looks", "says", "firsts")).alias("b")).select(F.col("b.nodes").alias("node"), F.col("b.firsts").cast("int").alias("first"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("b.looks").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("b.says").alias("value")))).alias("f"))
    counts = store(spark, each.groupBy("node", "f.kind", "f.value").agg(F.count("*").alias("c"), F.sum("first").alias("pages")), "counts", scope)
    sums = counts.groupBy("node", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    nodes = sums.groupBy("node").agg(F.max("n").alias("n"), F.max(entropy).alias("importance"))
    own = F.when(F.col("n") > 1, 1 - F.log("pages") / F.log("n")).otherwise(1.0)
    # A content on one page has importance 1 of its own: it is low by its node only.
    said = counts.where("kind = 1").join(nodes.where("n > 1"), "node")
    return said.select("node", F.col("value").alias("says"), "n", F.least("importance", own).alias("importance")).where(F.col("importance") < below)


def extract(spark: SparkSession, pages: DataFrame, threshold: float = 0.4, scope: str = "op") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    tree = store(spark, parsed(pages), "tree", scope)
    low = store(spark, importance(spark, tree, threshold, scope), "importance", scope)
    ask = tree.select("row", "roles", F.posexplode(F.arrays_zip("nodes", "says")).alias("k", "b")).select("row", "k", F.col("b.nodes").alias("node"), F.col("b.says").alias("says"), (F.substring("roles", F.col("k") + 1, F.lit(1)) == "c").alias("stated"))
    weighed = F.when(F.col("stated"), (PRIOR + F.col("n") * F.col("importance")) / (PRIOR + F.col("n"))).otherwise(F.col("importance"))
    drop = ask.join(low, ["node", "says"]).where(weighed < threshold).groupBy("row").agg(F.collect_set("k").alias("drop"))
    judged = tree.select("row", "page_id", "url", "texts").join(drop, "row", "left")

    @task(__name__)
    def kept(rows):
        for batch in batches(rows):
            texts = []
            for packed, out in zip(batch.column("texts").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                text = zlib.decompress(packed).decode()
                if out:
                    gone = set(out)
                    text = "\n".join(t for k, t in enumerate(text.split("\n")) if k not in gone)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return judged.select("page_id", "url", "texts", "drop").mapInArrow(kept, "page_id long, url string, text string, n_chars long")
