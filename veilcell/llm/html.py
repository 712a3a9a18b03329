"""Main text of web pages by tag-path ratios.

The blocks of a page are counted by the path of tags from the root to the block.
Per site and path, text length and punctuation per block are aggregated over all
pages, drawn towards the same path on all sites, smoothed with the sibling paths,
fused to one ratio and compared with a threshold; a second pass writes out the
blocks on paths that pass and those that share a container with them. Elements that are never article text by their tag, role
or class are left out before counting (wrappers of the article are not), and where a page marks its article only
blocks inside it count.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from .language import host_levels
from .texts import slices

PRIOR_BLOCKS = 5.0  # blocks that the same path on all sites counts for
SIBLINGS = 0.5  # weight of the sibling paths
LEAST_RATIO = 0.25  # of the site's mean by length
BROADCAST_PATHS = 50_000  # kept paths sent to every task; more sites are joined by shuffle

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[,.;:!?。，；：！？…]")

# Element kinds of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt mstyle msub msubsup msup mtext q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr br".split())
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr pre blockquote figcaption caption".split())
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                      "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
_SCOPE = frozenset("html table td th caption button object template marquee applet".split())
_SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
         "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"),
         "tfoot": ("thead tbody tfoot tr td th", "table"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select")}
_SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SAME.items()}
_NEVER = frozenset("head nav footer aside form script style noscript template svg iframe button select textarea dialog menu object canvas "
                   "audio video map title datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent "
                   "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related "
                   "recommended recommendations sidebar menu nav navigation navbar breadcrumb breadcrumbs pagination pager footer "
                   "masthead toolbar comment comments disqus respond replies widget login search skip".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _label(tag: str, attributes: dict[str, str], inside_article: bool) -> tuple[str, bool, bool]:
    """The step of a path, whether the element never holds article text, and whether its class or id only suggests so.

    Headings and paragraphs get their ids from their own words, so an id says
    nothing there, and a class only if it is one of the words as a whole.
    """
    if tag in _TEXT:
        names = attributes.get("class", "").lower().split()
        words = sorted(set(names) & _WORDS)
    else:
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        words = sorted({w.lower() for w in _TOKEN.findall(names)})
    never = (tag in _NEVER or tag == "header" and not inside_article or attributes.get("role", "").lower() in _ROLES
             or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""))
    named = tag not in ("html", "body") and (not _WORDS.isdisjoint(words) or "header" in words and not inside_article)
    return (f"{tag}.{'.'.join(words)}" if words else tag), never, named


class Named:
    """An element that its class or id names as something else than the article."""

    def __init__(self) -> None:
        self.chars = self.articles = 0


class Page:
    """The text blocks of one page in order: (path, text, inside an article).

    Class and id tokens leave an element out, but not the outermost article or
    main, an element that holds all of these, or one with most of the page's text:
    there they describe the page. If nothing else is left they do not count.
    """

    def __init__(self, source: str):
        self.found: list[tuple[str, str, bool, tuple[Named, ...]]] = []
        self.stack: list[tuple[str, str, bool, bool, Named | None]] = []  # tag, label, left out, article, named
        self.parts: list[str] = []
        self.chars = self.articles = 0
        self._read(source)
        self._flush()
        stays = [not any(map(self._leaves, named)) for *_, named in self.found]
        self.blocks = [b[:3] for b, stay in zip(self.found, stays, strict=True) if stay or not any(stays)]

    def _leaves(self, named: Named) -> bool:
        return 2 * named.chars <= self.chars and not (self.articles and named.articles == self.articles)

    def _flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
            self.parts = []
            if text:
                out = inside = False
                steps = []
                for tag, label, never, article, _ in self.stack:
                    out, inside = out or never, inside or article
                    if tag not in _INLINE:
                        steps.append(label)
                if not out:
                    named = tuple(s[4] for s in self.stack if s[4])
                    self.found.append(("/".join(steps), text, inside, named))
                    self.chars += len(text)
                    for element in named:
                        element.chars += len(text)

    def _pop(self, size: int) -> None:
        if any(tag not in _INLINE or never or named for tag, _, never, _, named in self.stack[size:]):
            self._flush()
        del self.stack[size:]

    def _close(self, tags: frozenset[str], limits: frozenset[str]) -> None:
        """Ends the innermost of ``tags`` unless one of ``limits`` lies in between; of nested ones the outermost."""
        found = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                found = i
            elif self.stack[i][0] in limits:
                break
        if found is not None:
            self._pop(found)

    def _start(self, tag: str, text: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            return
        if tag in ("html", "body") and any(s[0] == tag for s in self.stack):
            return
        if tag in _CLOSES_P:
            self._close(_P, _SCOPE)
        if tag in _SAME:
            self._close(*_SAME[tag])
        if tag == "body":
            self._close(_HEAD, frozenset())
        attributes = _attributes(text) if text.strip() else {}
        inside = any(s[3] for s in self.stack)
        label, never, named = _label(tag, attributes, inside)
        if tag not in _INLINE or never or named:
            self._flush()
        article = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        if article and not inside and not never and not any(s[2] for s in self.stack):
            named = False
            self.articles += 1
            for s in self.stack:
                if s[4]:
                    s[4].articles += 1
        self.stack.append((tag, label, never, article, Named() if named else None))

    def _end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in _INLINE and any(s[0] not in _INLINE for s in self.stack[i + 1:]):
                    del self.stack[i]  # a misnested end of formatting leaves the blocks in it open
                else:
                    self._pop(i)
                return
            if tag in _INLINE and self.stack[i][0] in _SCOPE:
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                self.parts.append(source[at:])
                break
            if m.start() > at:
                self.parts.append(source[at:m.start()])
            at = m.end()
            if m[0].startswith("<![CDATA["):
                continue
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                if tag not in _INLINE:
                    self._flush()
                at = end.end() if end else n
                continue
            self._start(tag, m[3] if m[3] is not None else m[4] or "")

    def candidates(self) -> list[tuple[str, str]]:
        marked = [(p, t) for p, t, inside in self.blocks if inside]
        return marked or [(p, t) for p, t, _ in self.blocks]


_P, _HEAD = frozenset(["p"]), frozenset(["head"])


def _facts(blocks: list[tuple[str, str]], into: dict, site: str) -> None:
    for path, text in blocks:
        row = into.setdefault((site, path), [0, 0, 0])
        row[0] += 1
        row[1] += len(text)
        row[2] += len(_MARKS.findall(text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sites, pages = batch.column(0), batch.column(1)
        for a, b in slices(pages):
            facts: dict = {}
            for i in range(a, b):
                _facts(Page(pages[i].as_py() or "").candidates(), facts, sites[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in facts], pa.string()), pa.array([k[1] for k in facts], pa.string()),
                 *[pa.array([float(v[i]) for v in facts.values()], pa.float64()) for i in range(3)]],
                names=["site", "path", "blocks", "chars", "marks"])


def ratio(blocks: Column, chars: Column, marks: Column) -> Column:
    """Text per block, raised by the punctuation per block."""
    return chars / blocks * F.sqrt(1 + marks / blocks)


def path_ratios(counts: DataFrame) -> DataFrame:
    """(site, path, kept) from (site, path, blocks, chars, marks), one row per site and path."""
    names = ("blocks", "chars", "marks")
    overall = counts.groupBy("path").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    rows = counts.join(overall, "path")
    weight = PRIOR_BLOCKS / F.col("all_blocks")
    drawn = [F.col(c) + weight * F.col(f"all_{c}") for c in names]
    rows = rows.withColumn("own", ratio(*drawn)).withColumn("parent", F.regexp_replace("path", r"/?[^/]*$", ""))
    by_length = F.sum(F.col("own") * F.col("chars")) / F.sum("chars")
    near = rows.groupBy("site", "parent").agg(by_length.alias("near"))
    mean = rows.groupBy("site").agg(by_length.alias("mean"))
    rows = rows.join(near, ["site", "parent"]).join(mean, "site")
    # Below the root elements siblings are strangers.
    smooth = F.when(F.col("parent").rlike("^(html[^/]*)?(/?body[^/]*)?$"), F.col("own")).otherwise(
        (1 - SIBLINGS) * F.col("own") + SIBLINGS * F.col("near"))
    return rows.select("site", "path", (smooth >= LEAST_RATIO * F.col("mean")).alias("kept"))


def _own_paths(blocks: list[tuple[str, str]]) -> set[str]:
    """The same ratio within one page, for pages of which the site keeps nothing."""
    facts: dict = {}
    _facts(blocks, facts, "")
    own = {path: c / n * (1 + m / n) ** 0.5 for (_, path), (n, c, m) in facts.items()}
    chars = sum(v[1] for v in facts.values())
    mean = sum(own[path] * v[1] for (_, path), v in facts.items()) / chars if chars else 0.0
    return {path for path, value in own.items() if value >= LEAST_RATIO * mean}


class Kept:
    """The paths of a site that pass, and with them what stands in the same container.

    A container is the parent of a path that passes, or the innermost article or
    main around it; root elements are none, as all of the page is in them. Short
    blocks in a container (items, cells, titles) belong to its text. A heading, in
    a header or not, also stays where its parent holds a path that passes.
    """

    def __init__(self, paths: set[str]):
        self.paths, self.order, self.known = paths, sorted(paths), {}
        self.containers = set()
        for path in paths:
            parent = path.rpartition("/")[0]
            if not _ROOT.match(parent):
                self.containers.add(parent)
            steps = path.split("/")
            marked = [i for i, step in enumerate(steps) if step.partition(".")[0] in ("article", "main")]
            if marked:
                self.containers.add("/".join(steps[:marked[-1] + 1]))

    def __contains__(self, path: str) -> bool:
        if path not in self.known:
            self.known[path] = path in self.paths or self._contained(path) or self._heads(path)
        return self.known[path]

    def _contained(self, path: str) -> bool:
        while path:
            path = path.rpartition("/")[0]
            if path in self.containers:
                return True
        return False

    def _heads(self, path: str) -> bool:
        parent, _, step = path.rpartition("/")
        if step.partition(".")[0] not in _HEADINGS:
            return False
        while parent.rpartition("/")[2].partition(".")[0] in ("header", "hgroup"):
            parent = parent.rpartition("/")[0]
        below = f"{parent}/" if parent else ""
        at = bisect_left(self.order, below)
        return at < len(self.order) and self.order[at].startswith(below)


_ROOT = re.compile(r"(?:html[^/]*)?(?:/?body[^/]*)?\Z")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, kept = batch.column(2), batch.column(3)
        for a, b in slices(pages):
            texts = []
            of_site = Kept(set())
            for i in range(a, b):
                blocks = Page(pages[i].as_py() or "").candidates()
                paths = set(kept[i].as_py() or ())
                if of_site.paths != paths:
                    of_site = Kept(paths)
                page = of_site if any(p in paths for p, _ in blocks) else Kept(_own_paths(blocks))
                texts.append("\n".join(t for p, t in blocks if p in page))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])


def extract(ws: Workspace, pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages give an empty text; pages without address form one site;
    repeated rows stay repeated. Character references are decoded, white space in
    a block becomes one space, blocks are joined by a line end in page order.
    """
    host = F.coalesce(host_levels(F.col(url))[2], F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("site"), F.col(source).alias("html"))
    counts = rows.select("site", "html").mapInArrow(_count, "site string, path string, blocks double, chars double, marks double")
    counts = ws.cut(counts.groupBy("site", "path").agg(*[F.sum(c).alias(c) for c in ("blocks", "chars", "marks")]), "paths")
    kept = ws.cut(path_ratios(counts).where("kept").groupBy(F.col("site").alias("__site")).agg(F.collect_set("path").alias("kept")), "kept")
    few = (kept.agg(F.sum(F.size("kept"))).first()[0] or 0) <= BROADCAST_PATHS
    joined = rows.join(F.broadcast(kept) if few else kept, F.col("site") == F.col("__site"), "left").select("page_id", "url", "html", "kept")
    kind = rows.schema["page_id"].dataType.simpleString()
    return (joined.mapInArrow(_write, f"page_id {kind}, url string, text string")
            .withColumn("n_chars", F.char_length("text").cast("bigint")))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(Workspace(spark), spark.read.parquet(f"{folder}/pages.parquet"))
