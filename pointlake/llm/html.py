"""Main text of web pages by deduction of each host's template.

A page is a sequence of tag tokens, each named by its path of enclosing blocks. Tokens of
a host that occur equally often on each of its pages, page by page, form an equivalence
class; classes whose tokens enclose text in a fixed order are valid, nest by their paths,
and together are the host's template. What stands between template tokens are slots, and
the slots of the article are the page's main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.text import table, text_bytes
from pointlake.workspace import Workspace

# Elements whose text stands on lines of its own; every other element runs within a line.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
# Elements that never hold text, so that they have no end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg canvas object audio video button select".split())
# An opening tag ends an open element of these kinds, if none of the last kinds is between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# Elements of a page's frame, and words in class, id or role that mark one.
FRAME = frozenset("nav footer aside form menu dialog head".split())
FRAME_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disclaimer discussion disqus feedback footer gdpr menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted promotion related replies reply respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Frames only outside an article, which has a heading of its own.
HEADER_WORDS = frozenset("header masthead".split())
# A class such as ``no-sidebar`` tells of what is elsewhere.
_ABOUT = frozenset("no with without has".split())
ARTICLE = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)>?", re.S)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_SPLIT_CASE = re.compile(r"([a-z])([A-Z])")


@dataclass
class Piece:
    """Text of one block of a page, with the path it stands in."""

    path: str
    parts: list[str] = field(default_factory=list)

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _marks(attributes: str) -> list[str]:
    values = " ".join(a or b or c for a, b, c in _MARK.findall(attributes))
    named = [_WORD.findall(_SPLIT_CASE.sub(r"\1 \2", v).lower()) for v in values.split()]
    return [word for parts in named if parts and parts[0] not in _ABOUT for word in parts]


def _step(name: str, attributes: str) -> str:
    """A path's part: the element, its marks, and ``!`` if it belongs to a frame."""
    marks = _marks(attributes) if attributes else []
    frame = name in FRAME or bool(FRAME_WORDS.intersection(marks)) or bool(attributes and _HIDDEN.search(attributes))
    named = ".".join([name, *(m for m in marks if not m.isdigit())])
    return f"{named}!" if frame and name not in ("html", "body", "main") else named


# Elements around a token that its path names one by one.
_NAMED_STEPS = 64


def _deeper(path: str, step: str) -> str:
    """The path of an element inside ``path``.

    Steps beyond ``_NAMED_STEPS`` are folded into one, a number of them all, so that
    a page takes memory in proportion to its length however deep it nests. The folded step
    still tells whether an article, a header or a frame is among them.
    """
    if path.count(">") < _NAMED_STEPS:
        return f"{path}>{step}"
    above, _, folded = path.rpartition(">")
    kind = "div"
    for part in (folded, step):
        element, *marks = part.rstrip("!").split(".")
        if kind == "div" and element in ARTICLE:
            kind = element
        elif kind == "div" and not HEADER_WORDS.isdisjoint([element, *marks]):
            kind = "header"
    frame = "!" if step.endswith("!") or folded.endswith("!") else ""
    return f"{above}>{kind}.~{_number(f'{folded}>{step}'):x}{frame}"


def scan(page: str) -> tuple[Counter, list[Piece]]:
    """Tag tokens with their numbers, and the blocks of text in page order."""
    tokens: Counter = Counter()
    stack: list[tuple[str, str]] = []  # (element, path down to it)
    pieces: list[Piece] = []
    current = Piece("")
    at = 0

    def path() -> str:
        return stack[-1][1] if stack else ""

    def end_block() -> None:
        nonlocal current
        if current.parts:
            pieces.append(current)
        current = Piece(path())

    def pop_to(i: int) -> None:
        for element, where in reversed(stack[i:]):
            tokens["/" + where] += element != "p"
        del stack[i:]

    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            current.parts.append(page[at:])
            break
        if found.start() > at:
            current.parts.append(page[at : found.start()])
        at = found.end()
        if found[0].startswith("<![CDATA["):
            continue
        if not found[2]:
            continue
        name, closing = found[2].lower(), bool(found[1])
        if name in RAW and not closing:
            if not found[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            if name not in BLOCKS:
                current.parts.append(" ")
            continue
        if name not in BLOCKS:
            if name == "br":
                current.parts.append(" ")
            continue
        if closing:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if open_at is not None:
                pop_to(open_at)
            end_block()
            continue
        if stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)  # a block ends an open paragraph
        if name in _ENDS:
            same, fence = _ENDS[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in fence:
                    break
                if stack[i][0] in same:
                    pop_to(i)
                    break
        step = _step(name, found[3])
        where = _deeper(path(), step)
        tokens[where] += 1
        if name not in VOID:
            stack.append((name, where))
        end_block()
    pop_to(0)
    end_block()
    return tokens, pieces


def _is_frame(path: str) -> bool:
    """Whether a path runs through a frame; an article's own ``header`` holds its heading."""
    inside = False
    for step in path.split(">")[1:]:
        element, *marks = step.rstrip("!").split(".")
        if step.endswith("!") or not inside and not HEADER_WORDS.isdisjoint([element, *marks]):
            return True
        inside |= element in ARTICLE
    return False


def _slot(path: str) -> str:
    """The article slot that a path runs through, the outermost; empty if there is none."""
    steps = path.split(">")
    for i, step in enumerate(steps):
        if step.split(".")[0] in ARTICLE:
            return ">".join(steps[: i + 1])
    return ""


def _in_article(path: str) -> bool:
    return bool(_slot(path))


def _number(value: str) -> int:
    return xxhash.xxh64_intdigest(value) >> 1


def host_of(url: str):
    """Host of a URL; a page without one is alone under the empty name."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def occurrence_classes(pages: DataFrame, url: str = "url", html_column: str = "html", key: str = "page_id") -> DataFrame:
    """``(host, token, is_text, pages, vector)``: each token's occurrence vector as one number.

    A vector, the token's count on each page of the host, is summed up by hashes of page
    and count. Sums combine before the shuffle and equal vectors have equal sums, so even
    a host with a third of all pages is never gathered. Text that stands outside an
    article is a token as well: a notice that is the same on each page belongs to the
    template.
    """
    schema = "host string, token string, is_text boolean, pages long, vector decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: Counter = Counter()
            vector: Counter = Counter()
            hosts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for host, page, value in zip(hosts, keys, text_bytes(batch.column(2)), strict=True):
                tokens, pieces = scan((value or b"").decode("utf-8", "replace"))
                named = [((host, t, False), n) for t, n in tokens.items()]
                outside = Counter(
                    f"{p.path}\n{p.text()}" for p in pieces if not _is_frame(p.path) and not _in_article(p.path)
                )
                named += [((host, f"{t.split(chr(10))[0]}\n{_number(t)}", True), n) for t, n in outside.items()]
                for name, n in named:
                    number[name] += 1
                    vector[name] += _number(f"{page}\n{n}")
            if number:
                host, token, is_text = zip(*number, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(host, pa.string()),
                        pa.array(token, pa.string()),
                        pa.array(is_text, pa.bool_()),
                        pa.array(list(number.values()), pa.int64()),
                        pa.array([str(v) for v in vector.values()], pa.string()).cast(pa.decimal128(38, 0)),
                    ],
                    names=["host", "token", "is_text", "pages", "vector"],
                )

    read = pages.select(host_of(url).alias("host"), F.col(key).cast("string"), F.col(html_column).cast("binary"))
    parts = read.mapInArrow(run, schema)
    return parts.groupBy("host", "token", "is_text").agg(F.sum("pages").alias("pages"), F.sum("vector").alias("vector"))


# Pages of a host that a token must be on, as a share, to belong to the template, and pages
# a host must have for text to: a few pages may well have text in common.
TEMPLATE_SHARE = 0.9
TEXT_PAGES = 5


def deduce_templates(tokens: DataFrame) -> DataFrame:
    """``(host, articles, constant)``: what of each host's template the extraction needs.

    Tokens of a host with one occurrence vector are an equivalence class. It is kept if
    it covers at least ``TEMPLATE_SHARE`` of the host's pages, and valid if it opens and
    ends the same elements: then its tokens stand in one order on every page. A valid
    class nests in the classes that hold the elements around it; elements all of whose
    surroundings are valid make the template. ``articles`` are its article slots,
    ``constant`` the numbers of text that belongs to it.

    A class has as many tokens as a page has kinds of elements, however many pages there
    are.
    """
    pages_of = tokens.filter("NOT is_text").groupBy("host").agg(F.max("pages").alias("host_pages"))
    frequent = tokens.join(pages_of, "host").filter(F.col("pages") >= TEMPLATE_SHARE * F.col("host_pages"))
    tag = F.when(~F.col("is_text"), F.col("token"))
    number = F.when(
        F.col("is_text") & (F.col("host_pages") >= TEXT_PAGES), F.element_at(F.split("token", "\n"), -1).cast("long")
    )
    classes = frequent.groupBy("host", "vector").agg(
        F.collect_set(tag).alias("tags"), F.collect_set(number).alias("constant")
    )
    valid = F.filter("tags", lambda t: F.array_contains("tags", F.concat(F.lit("/"), t)))
    template = classes.select("host", "constant", valid.alias("opens")).groupBy("host").agg(
        F.flatten(F.collect_list("opens")).alias("opens"), F.flatten(F.collect_list("constant")).alias("constant")
    )

    def nested(element):
        steps = F.split(element, ">")
        around = F.transform(
            F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), ">")
        )
        return F.forall(around, lambda path: F.array_contains("opens", path))

    articles = F.filter(
        "opens", lambda t: t.rlike(r">(?:article|main)(?:\.[^>]*)?$") & ~t.contains("!") & nested(t)
    )
    return template.select("host", articles.alias("articles"), "constant")


def main_text(page: str, articles: set[str], constant: set[int]) -> str:
    """The page's article: blocks in page order, one to a line.

    With article slots in the host's template these are the article. Otherwise every slot
    is that is no frame, less the template's own text.
    """
    pieces = [(p, p.text()) for p in scan(page)[1] if not _is_frame(p.path)]
    pieces = [(p, t) for p, t in pieces if t]
    own = {_slot(p.path) for p, _ in pieces if _in_article(p.path)}
    slots = (own & articles) or own
    if slots:
        return "\n".join(t for p, t in pieces if _slot(p.path) in slots)
    return "\n".join(t for p, t in pieces if _number(f"{p.path}\n{t}") not in constant)


def extract_main_text(
    pages: DataFrame, url: str = "url", html_column: str = "html", key: str = "page_id", work: Workspace | None = None
) -> DataFrame:
    """``key``, ``url`` and ``text``, the main text of each page; empty if it has none.

    A null page is empty; a page whose URL is null or has no host belongs to the nameless
    host. Repeated rows count as pages of their host and give a row each. An unfinished
    tag, entity or page is read as far as it goes, and pages of any length are read
    whole. An empty table gives no rows.
    """
    work = work or Workspace(pages.sparkSession)
    # Stored: its size decides how it joins, and a join of two scans can be split where
    # a host has many pages.
    templates = work.save(deduce_templates(occurrence_classes(pages, url, html_column, key)), "templates")
    read = pages.select(
        F.col(key).alias(key), F.col(url).alias("url"), host_of(url).alias("host"), F.col(html_column).cast("binary").alias("_html")
    )
    # One template row per host: the optimizer splits the pages of a host that has many.
    joined = read.join(templates, "host", "left").select(key, "url", "_html", "articles", "constant")
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text((value or b"").decode("utf-8", "replace"), set(articles or ()), set(constant or ()))
                for value, articles, constant in zip(
                    text_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, "url", "text"]
            )

    return joined.mapInArrow(run, schema)


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op10_html": html_query}
