"""Main text of web pages by consensus host paths: each page scores its containers and votes for the path of the best one,
Spark counts the votes of each host, and every page is read again with its host's path.

- A path is the tags from the body to a container with their classes, digits generalised. A page gives one vote, and the
  characters that it found there settle ties, then the smaller path; a page without a host, or without a container of its
  host's path that has text, keeps the best of its own.
- A container's score is its text outside links, less a tenth for each container between, more for article and main elements
  and for classes that name content.
- Menus, footers, sidebars, notices, adverts, forms and reader comments go by their elements, roles and class words, wherever
  they are; headers only outside of articles. An element that most of the page's text with its main heading or article is in
  is no such part, whatever its class says. Hidden elements, scripts, styles and comments of the markup hold no text.
- Blocks are what block elements bound; br is white space. Character references are decoded as HTML5 does, without a semicolon too.

A null or empty page gives an empty text. Markup may be cut off, unclosed or nested at any depth. Rows that repeat stay and
vote each; pages are not told apart by page_id. Other columns pass through but the html; text and n_chars of pages are replaced. Votes are
sums made in the tasks first, so a host with a third of all pages is a few rows. The hosts' paths are broadcast while their
table is small (sources.tables.small), else pages are joined by host, where AQE splits a hot one.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import bounded_batches, cut, text_of, whole_rows
from sievework.sources.tables import small

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes that an element's mark or path follows from.
NOTABLE = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
#: Elements that a start tag of the first closes if they are open, unless one of the last lies between.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
}
DROPPED = frozenset("aside button canvas dialog footer head iframe menu nav noscript object script search select style svg template textarea title".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial aside banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus "
    "dropdown footer form gdpr login menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
CONTENT_WORDS = frozenset("article blog body content entry main post story text".split())
DECAY = 0.9
BODY = "body"


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def words_of(names: str) -> set[str]:
    return {w.lower() for w in WORD.findall(names)}


@lru_cache(maxsize=1 << 15)
def kind_of(name: str, rest: str) -> tuple[str, str]:
    """Of an element with its attributes: its step in a path, and its mark: drop, maybe (by its class), header, content or none."""
    found = attributes(rest)
    classes = found.get("class", "")
    step = ".".join([name, *sorted({DIGITS.sub("0", c) for c in classes.split()})]).replace("/", "_")
    words = words_of(f"{classes} {found.get('id', '')}")
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE)
    if hidden or name in DROPPED or role in DROPPED_ROLES:
        return step, "drop"
    if name == "form" or words & DROPPED_WORDS:
        return step, "maybe"
    if name == "header" or words & HEADER_WORDS:
        return step, "" if name != "header" and words & CONTENT_WORDS else "header"
    return step, "content" if name in ("article", "main") or role == "main" or words & CONTENT_WORDS else ""


class Page:
    """The elements of a page, parents before children, and its text by block and element."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks, self.paths = [BODY], [-1], [""], [0]
        self.path_ids: dict[tuple[int, str], int] = {}
        self.runs: list[tuple[int, int, str]] = []
        self.open: dict[str, int] = defaultdict(int)
        self._read(source)
        self._judge()

    def _read(self, source: str) -> None:
        stack, runs, block, at = [0], self.runs, 0, 0
        tags = TAG.finditer(source)
        while found := next(tags, None):
            start, end = found.span()
            if start > at:
                text = source[at:start]
                runs.append((block, stack[-1], html.unescape(text) if "&" in text else text))
            at = end
            closing, name, rest = found.groups()
            if not name:
                continue
            name = name.lower()
            if name == "br":
                runs.append((block, stack[-1], "\n"))
                continue
            bounds = name in BLOCKS
            block += bounds
            if closing:
                if self.open[name]:
                    self._close(stack, name)
            elif name not in ("html", BODY):
                self._make_room(stack, name)
                if name not in VOID and (bounds or not rest.endswith("/")):
                    self._open(stack, name, rest)
                    if name in RAW:
                        ended = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
                        at = ended.start() if ended else len(source)
                        self._cut(stack, len(stack) - 1)
                        tags = TAG.finditer(source, at)
        if at < len(source):
            runs.append((block, stack[-1], html.unescape(source[at:])))

    def _cut(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            self.open[self.tags[stack.pop()]] -= 1

    def _close(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag == name:
                self._cut(stack, depth)
                return
            if name not in BLOCKS and tag in BLOCKS:
                return

    def _make_room(self, stack: list[int], name: str) -> None:
        if self.open["p"] and name in BLOCKS:
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[depth]]
                if tag == "p":
                    self._cut(stack, depth)
                    break
                if tag in BLOCKS:
                    break
        if name not in CLOSED_BY:
            return
        closes, between = CLOSED_BY[name]
        for depth in range(len(stack) - 1, 0, -1) if any(self.open[c] for c in closes) else ():
            tag = self.tags[stack[depth]]
            if tag in closes:
                self._cut(stack, depth)
                return
            if tag in between:
                return

    def _open(self, stack: list[int], name: str, rest: str) -> None:
        step, mark = kind_of(name, rest if rest and NOTABLE.search(rest) else "")
        above = stack[-1]
        path = self.path_ids.setdefault((self.paths[above], step), len(self.path_ids) + 1) if name in BLOCKS else self.paths[above]
        stack.append(len(self.tags))
        self.open[name] += 1
        for values, value in ((self.tags, name), (self.parents, above), (self.marks, mark), (self.paths, path)):
            values.append(value)

    def _judge(self) -> None:
        """Which elements are dropped with all they hold, and the texts of the blocks that are left."""
        n = len(self.tags)
        chars, head = [0] * n, [False] * n
        for _, node, text in self.runs:
            chars[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if self.marks[i] != "drop":
                chars[self.parents[i]] += chars[i]
                head[i] |= self.marks[i] != "maybe" and self.tags[i] in ("article", "main", "h1")
                head[self.parents[i]] |= head[i]
        self.gone, self.linked, inside = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            above, mark = self.parents[i], self.marks[i]
            inside[i] = inside[above] or self.tags[i] in ("article", "main")
            wrapper = head[i] and 2 * chars[i] > chars[0]
            self.gone[i] = self.gone[above] or mark == "drop" or mark == "maybe" and not wrapper or mark == "header" and not wrapper and not inside[above]
            self.linked[i] = self.linked[above] or self.tags[i] == "a"

    def best(self) -> int:
        """The container with the highest score; the first of equal ones that lies deepest."""
        n = len(self.tags)
        score, direct = [0.0] * n, [0.0] * n
        for _, node, text in self.runs:
            if not self.gone[node] and not self.linked[node]:
                direct[node] += len(text.strip())
        top, found = 0.0, 0
        for i in range(n - 1, -1, -1):
            if self.gone[i]:
                continue
            score[i] += direct[i]
            holds = self.tags[i] in CONTAINERS
            if holds:
                weight = 1.5 if self.tags[i] in ("article", "main") else 1.25 if self.marks[i] == "content" else 1.0
                if score[i] * weight > top:
                    top, found = score[i] * weight, i
            if i:
                score[self.parents[i]] += score[i] * (DECAY if holds else 1.0)
        return found

    def path(self, node: int) -> str:
        steps = {i: key for key, i in self.path_ids.items()}
        out, at = [], self.paths[node]
        while at:
            at, step = steps[at]
            out.append(step)
        return "/".join([BODY, *reversed(out)])

    def at_path(self, path: str) -> list[int]:
        at = 0
        for step in path.split("/")[1:]:
            at = self.path_ids.get((at, step), -1)
        return [i for i in range(len(self.tags)) if self.paths[i] == at and (self.tags[i] in CONTAINERS)] if at >= 0 else []

    def text(self, nodes: list[int]) -> str:
        """Of the blocks below these elements, in page order."""
        chosen = [False] * len(self.tags)
        for i in nodes:
            chosen[i] = True
        for i in range(1, len(chosen)):
            chosen[i] |= chosen[self.parents[i]]
        blocks: dict[int, list[str]] = {}
        for block, node, text in self.runs:
            if chosen[node] and not self.gone[node]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def vote(source: str) -> tuple[str, int] | None:
    page = Page(source)
    found = page.best()
    chars = len(page.text([found]))
    return (page.path(found), chars) if chars else None


def main_text(source: str, path: str | None) -> str:
    page = Page(source)
    found = page.text(page.at_path(path)) if path else ""
    return found or page.text([page.best()])


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.when(found != "", found)


def host_paths(pages: DataFrame, html_column: str = "html", url: str = "url") -> DataFrame:
    """host, path, votes, pages: each host's winning path."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vote(x.as_py()) or (None, 0) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["host", "path", "chars"])

    asked = pages.select(host_of(F.col(url)).alias("host"), text_of(html_column).alias("html")).where(F.col("host").isNotNull())
    given = asked.mapInArrow(votes, "host string, path string, chars long").where(F.col("path").isNotNull())
    counted = given.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    best = counted.groupBy("host").agg(F.max(F.struct("votes", "chars")).alias("best"), F.sum("votes").alias("pages"))
    tied = counted.join(best, "host").where((F.col("votes") == F.col("best.votes")) & (F.col("chars") == F.col("best.chars")))
    return tied.groupBy("host").agg(F.min("path").alias("path"), F.max("votes").alias("votes"), F.max("pages").alias("pages"))


def extract_texts(pages: DataFrame, html_column: str = "html", url: str = "url") -> DataFrame:
    """pages with text and n_chars."""
    bounded_batches(pages.sparkSession)
    winners = cut(host_paths(pages, html_column, url).select("host", "path"), "host-paths")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(s.as_py(), p.as_py()) for s, p in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=["row", "text"])

    rest = pages.drop(*(c for c in pages.columns if c == html_column or c.lower() in ("text", "n_chars")))
    rows = pages.select(whole_rows(rest).alias("row"), text_of(html_column).alias("html"), host_of(F.col(url)).alias("host"))
    joined = rows.join(small(winners), "host", "left").select("row", "html", "path")
    made = joined.mapInArrow(texts, T.StructType([joined.schema["row"], T.StructField("text", T.StringType())]))
    return made.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))


def digest(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", "n_chars")
