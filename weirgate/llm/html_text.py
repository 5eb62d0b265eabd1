"""Operator 9: main text of pages, by tags and by a host's suffix array.

Tags say where an article is and what is never text. Elsewhere on a page, text
that other pages of the host have too is boilerplate: token streams of all
pages of a host give suffixes, equal ones up to ``RUN`` tokens meet in a shuffle
by host and suffix, and tokens in a run that several pages of distinct content have are
covered; neighbouring runs make the longest repeats. Covered tokens go and all
others stay, on pages with an article too. Articles of a host share passages
that are their text, so within an article the tags are the stronger evidence:
a block goes only if the suffix that starts it is the same over the whole block
on half of the host's pages or more.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Tokens of a run that counts, distinct pages that make it boilerplate, and the share of a host's pages that makes a block of an article so.
RUN, MIN_PAGES, ARTICLE_SHARE = 6, 3, 0.5

# Element names by their role in HTML, and words in class, id or role that name furniture of a page.
RAW = {"script", "style", "textarea", "title"}
HIDDEN, CONTROLS = {"noscript", "template", "iframe", "svg", "object"}, {"select", "option", "button"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HINTS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "disqus", "menu", "nav", "navigation", "newsletter", "notice", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "complementary", "contentinfo"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _is_furniture(name: str, attributes: str, in_main: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_main):
        return True
    if not attributes or name in ("html", "body") or name in MAIN:
        return False
    return any(w in HINTS for m in _NAMED.finditer(attributes) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower()))


def _left_open(page: str, at: int, stack: list[tuple[str, str]]) -> bool:
    """Whether the hidden elements around a place are left open: controls hold no article, others do if their closing tag comes first."""
    for name in {k for k, _ in stack} & HIDDEN:
        m = re.compile(rf"<(/?){name}\b", re.I).search(page, at)
        if m and m[1]:
            return False
    return True


def blocks(page: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of a page's blocks in order; kinds are main, other and furniture.

    An element that is never closed ends with its parent; furniture left open
    also ends where an article begins. Only ``RAW`` elements run to the page's
    end without a closing tag; text in ``HIDDEN`` and ``CONTROLS`` elements is
    skipped.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements with the kind of text inside, or hidden
    kind, hidden, held, at, n = "other", False, [], 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((kind, text))

    last = page.rfind(">")  # no tag ends after it, so none is looked for
    while at < n:
        m = _TAG.search(page, at) if at <= last else None
        if m is None:
            if not hidden:
                held.append(page[at:])
            break
        if m.start() > at and not hidden:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in INLINE | HIDDEN | CONTROLS and not hidden:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if hidden and stack[i][1] != "hidden" and name not in INLINE:
                        flush()
                    del stack[i:]
                    kind = next((k for _, k in reversed(stack) if k != "hidden"), "other")
                    hidden = bool(stack) and stack[-1][1] == "hidden"
                    break
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in HIDDEN | CONTROLS:
            if not m[3].rstrip().endswith("/"):
                stack.append((name, "hidden"))
                hidden = True
            continue
        if hidden and not (name in MAIN and _left_open(page, at, stack)):
            if name not in VOID:
                stack.append((name, "hidden"))
            continue
        if hidden:
            stack, hidden = [x for x in stack if x[1] != "hidden"], False
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        inline = name in INLINE
        inside = "furniture" if _is_furniture(name, m[3], kind == "main") else kind
        if name in MAIN:
            inside = "main" if kind != "furniture" or name == "main" or not any(k[0] in FURNITURE for k in stack) else kind
        if not inline or inside != kind:
            flush()
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        stack.append((name, inside))
        kind = inside
    flush()
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^\w+://", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def suffixes(tokens: list[str]) -> list[int]:
    """A number for the first ``RUN`` tokens from each place on; for a shorter block the whole of it."""
    return [int.from_bytes(hashlib.blake2b("\n".join(tokens[i : i + RUN]).encode(), digest_size=8).digest(), "little", signed=True) for i in range(max(1, len(tokens) - RUN + 1))]


def whole_block(tokens: list[str]) -> int:
    """A number for a block's first suffix up to the block's end; no suffix of ``RUN`` tokens has it."""
    return int.from_bytes(hashlib.blake2b("\n".join(["", *tokens]).encode(), digest_size=8).digest(), "little", signed=True)


#: ``own``: the numbers of each part's suffixes, or of an article's block as a whole. ``content`` and ``article`` number the page's parts and its article's.
_PAGE = "page_id bigint, url string, host string, kinds array<string>, parts array<string>, own array<array<bigint>>, suffixes array<bigint>, articles array<bigint>, content bigint, article bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's parts that may be text, in order, with the numbers that tell whether they are repeated."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = blocks(page or "")
            kept = [(k, t) for k, t in found if k != "furniture"]
            own = [[] if k == "main" else suffixes(t.split()) for k, t in kept]
            every = {x for k, t in found if k == "furniture" for x in suffixes(t.split())}.union(*own)
            articles = {whole_block(t.split()) for k, t in kept if k == "main"}
            content, article = whole_block([f"{k} {t}" for k, t in kept]), whole_block([t for k, t in kept if k == "main"])
            for column, x in zip(columns, (host_of(url), [k for k, _ in kept], [t for _, t in kept], own, sorted(every), sorted(articles), content, article), strict=True):
                column.append(x)
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["page_id", "url", "host", "kinds", "parts", "own", "suffixes", "articles", "content", "article"])


def uncovered(words: list[str], own: list[int], repeated: set[int]) -> list[str]:
    """A block's tokens that lie in no repeated run."""
    kept, upto = [], 0
    for i, x in enumerate(own):
        if x in repeated:
            kept += words[upto:i]
            upto = max(upto, min(len(words), i + RUN))
    return kept + words[upto:]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for kinds, parts, own, repeated in zip(*(batch.column(x).to_pylist() for x in ("kinds", "parts", "own", "repeated")), strict=True):
            known = set(repeated or ())
            rest = [("" if known and whole_block(t.split()) in known else t) if k == "main" else " ".join(uncovered(t.split(), o, known)) for k, t, o in zip(kinds, parts, own, strict=True)]
            texts.append(" ".join(t for t in rest if t))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    A null or empty html gives an empty text; a null url is a host of its own.
    Repeated rows are extracted each. What repeats is counted by distinct
    contents, so copies of a page or an article, at whatever addresses, are one
    and don't make their own text boilerplate. Other columns are not read; an
    empty table gives no rows.
    """
    scratch = scratch or Scratch(pages.sparkSession, "html")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = scratch.write(pages.mapInArrow(_parse, _PAGE).withColumn("row", F.monotonically_increasing_id()), "parsed")
    # Suffixes outside articles that pages ask for, and blocks of all articles, each once a page.
    outside = F.array_distinct(F.flatten("own"))
    asked = parsed.select("row", "host", F.explode(outside).alias("suffix"))
    array = parsed.select("host", "content", F.explode("suffixes").alias("suffix")).join(asked.select("host", "suffix").distinct(), ["host", "suffix"], "left_semi")
    runs = array.groupBy("host", "suffix").agg(F.count_distinct("content").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    in_articles = parsed.select("row", "host", "article", F.explode("articles").alias("suffix"))
    sizes = parsed.groupBy("host").agg(F.count_distinct("content").alias("all"))
    # A block on fewer pages than MIN_PAGES can't be on a share of the host's pages that counts; what is left is small.
    shared = in_articles.groupBy("host", "suffix").agg(F.count_distinct("article").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    common = scratch.write(shared.join(sizes, "host").where(F.col("pages") >= ARTICLE_SHARE * F.col("all")).select("host", "suffix"), "common")
    hits = asked.join(runs.select("host", "suffix"), ["host", "suffix"])
    if not common.isEmpty():
        hits = hits.unionByName(in_articles.drop("article").join(common, ["host", "suffix"]))
    hits = scratch.write(hits.groupBy("row").agg(F.collect_list("suffix").alias("repeated")), "hits")
    fields = ["kinds", "parts", "own", "repeated"]
    if hits.isEmpty():  # then no page has to be brought together with its hits
        joined = parsed.withColumn("repeated", F.array().cast("array<bigint>"))
    else:
        joined = parsed.join(hits, "row", "left")
    return joined.select("page_id", "url", *fields).mapInArrow(_assemble, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "op9"))
