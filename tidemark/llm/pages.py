"""Main text of web pages by consensus of their host.

Every page's containers are scored by the paragraph text that they hold. Containers are named by their
path of tags and classes from the body down, with numbers generalised, and each page votes for the paths
of its containers with their shares of its text; Spark adds up the votes by host. The path with most
votes of its host then tells where the text of each of its pages is; a page without such a container
falls back on its own best one. Outside article and main, the path is widened to its parent, short of the
body, while by the votes of the host's pages the parent only adds article text (a headline or parts in
sibling containers): no text of links, and not the same text on every page.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
out by their tags and by the words of their class, id and role. A name counts word by word, camel case
included, and only if it has no other word (``notice-board`` is no notice). A box so named is kept all the
same where it holds an article or main part, or where most pages of its host have most of their text in it;
adverts, forms to sign up and reader comments are not. An article that is marked as a comment and stands in
or after another one is a comment.

Defined results: NULL html is empty and gives an empty text; NULL or odd urls share one host; repeated rows
count each; NULL ids are kept; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Container, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import named

# The roles of tags, and words of classes, ids and roles that mark what is no article text.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu head".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figure h1 h2 h3 h4 h5 h6 hr html li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | DROPPED
CONTAINERS = frozenset(("body", "div", "section", "article", "main", "td", "center"))
CLOSED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}
#: Words of classes, ids and roles whose box is no part of an article whatever it holds.
NEVER = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo comment comments commentlist "
    "disqus respond replies cookie cookies consent gdpr newsletter subscribe signup login popup modal".split()
)
#: Words that mark what stands around an article, unless the box turns out to hold it.
AROUND = frozenset(
    "banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side aside complementary "
    "contentinfo widget notice notices alert overlay share sharing social related recommended search toolbar pagination pager".split()
)
#: Words that may stand beside these in a name; any other word makes it the name of something else (notice-board, side-by-side).
BESIDE = frozenset(
    "box wrap wrapper container inner outer area block section list item items row col column left right top bottom secondary site "
    "page global sticky bar panel group holder region zone unit slot link links button buttons icons form post posts article articles "
    "story stories news entry more user body thread tree feed message messages bottom text info policy center".split()
)
#: Boxes of these tags are whole articles or pages: a word in their class does not make them an aside.
KEPT = frozenset(("html", "body", "article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACES = re.compile(r"\s+")
ANY_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def hidden(rest: str) -> bool:
    """Whether attributes hide their element: one named ``hidden``, or a style without display. The word in other values does not."""
    low = rest.lower()
    if "hidden" not in low and "none" not in low:
        return False
    found = ANY_ATTRIBUTE.findall(low)
    return any(name == "hidden" or (name == "style" and UNSEEN.search(value)) for name, value in found)


def marked(name: str) -> frozenset[str]:
    """The words of ``name`` (classes, id and role) that mark an aside."""
    found: set[str] = set()
    for token in name.split():
        words = {w.lower() for w in WORDS.findall(token)}
        asides = words & (NEVER | AROUND)
        if asides and words <= NEVER | AROUND | BESIDE and not (asides == {"header"} and words & {"post", "article", "story", "entry"}):
            found |= asides
    return frozenset(found)


class Node:
    """A container. ``out``: it is no article text. ``aside``: it is none unless it ``holds`` an article or main part,
    or most of its host's pages have most of their text there."""

    __slots__ = ("tag", "path", "parent", "out", "aside", "holds")

    def __init__(self, tag: str, path: str, parent: Node | None, out: bool, aside: bool = False):
        self.tag, self.path, self.parent, self.out, self.aside, self.holds = tag, path, parent, out, aside, False

    def around(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


class Block(str):
    """Text of a block; ``linked`` if half of it or more is text of links outside a heading."""

    linked = False


def blocks_of(page: str) -> list[tuple[Node, Block]]:
    """The blocks of text of a page in order, each with the innermost container that holds it; those that cannot be
    article text are left out. One pass over the page; tags that are not closed end with what closes around them."""
    out: list[tuple[Node, str]] = []
    top = Node("html", "", None, False)
    body = Node("body", "body", top, False)
    # open elements: tag, container that they belong to, and for an aside within a line (an advert in a span)
    # where its text begins; and whether its text is a link's (1) or a heading's (2)
    stack: list[tuple[str, Node, int | None, int]] = [("body", body, None, 0)]
    text: list[str] = []
    links: list[bool] = []

    def flush() -> None:
        if text:
            holder = stack[-1][1]
            for k, (_, _, mark, kind) in enumerate(stack):
                if mark is not None:
                    holder = stack[k - 1][1]
                    del text[mark:], links[mark:]
                    stack[k] = (*stack[k][:2], 0, kind)
                    break
            joined = Block(SPACES.sub(" ", entities.unescape("".join(text))).strip(" "))
            if joined and not holder.out:
                joined.linked = 2 * sum(len(t.strip()) for t, link in zip(text, links) if link) >= sum(len(t.strip()) for t in text) > 0
                out.append((holder, joined))
            text.clear()
            links.clear()

    at = articles = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            links.append(stack[-1][3] == 1)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("html", "body") and not m["end"]:
            continue
        if m["end"]:
            if tag in BLOCKS:
                flush()
            if tag in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    for _, _, mark, _ in stack[k:]:
                        if mark is not None:
                            del text[mark:], links[mark:]
                            break
                    del stack[k:]
                    break
                if stack[k][0] in KEPT or (tag not in BLOCKS and stack[k][0] in BLOCKS):
                    break  # a stray end tag closes nothing around it
            continue
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[k][0], ()):
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        elif tag == "br":
            text.append(" ")
            links.append(False)
        if tag in VOID or m["rest"].endswith("/"):
            continue
        holder = stack[-1][1]
        marks = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(m["rest"])} if "=" in m["rest"] else {}
        name = " ".join(marks.get(a, "") for a in ("class", "id", "role")).strip()
        words = marked(name) if name else frozenset()
        # an article about another one (a comment) stands in or after it, and says so
        never = bool(words & NEVER) and (tag not in KEPT or (tag == "article" and articles > 0))
        around = bool(words) and not never and tag not in KEPT
        inline = tag not in CONTAINERS and tag not in BLOCKS
        aside = tag in DROPPED or never or hidden(m["rest"]) or (around and inline)
        if tag in ("article", "main") and not aside:
            articles += 1
            for node in holder.around():
                node.holds = True
        if tag in CONTAINERS or aside or around:
            kind = ".".join([tag, *sorted(re.sub(r"\d+", "N", c) for c in marks.get("class", "").lower().replace("/", "|").split())])
            holder = Node(tag, f"{holder.path}/{kind}", holder, holder.out or aside, around)
        kind = 2 if tag in HEADINGS else stack[-1][3] or int(tag == "a")
        stack.append((tag, holder, len(text) if aside and tag not in BLOCKS else None, kind))
    if at < len(page):
        text.append(page[at:])
        links.append(stack[-1][3] == 1)
    flush()
    return out


def asides_of(blocks: list[tuple[Node, Block]]) -> dict[str, float]:
    """Share of the page's text by path of the boxes around articles; 0 on a page whose article has text outside them."""
    total = sum(len(t) for _, t in blocks) or 1
    found = any(n.tag in ("article", "main") for node, _ in without_asides(blocks, ()) for n in node.around())
    shares: dict[str, float] = {}
    for node, text in blocks:
        for path in {n.path for n in node.around() if n.aside and not n.holds}:
            shares[path] = shares.get(path, 0.0) + (0.0 if found else len(text) / total)
    return shares


def without_asides(blocks: list[tuple[Node, Block]], lifted: Container[str]) -> list[tuple[Node, Block]]:
    """The blocks that stand in no box around articles, other than those in ``lifted`` and those that hold one."""
    return [(node, t) for node, t in blocks if not any(n.aside and not n.holds and n.path not in lifted for n in node.around())]


def scores_of(blocks: list[tuple[Node, str]]) -> dict[str, float]:
    """Score by path: a block counts for its container (or the article or main part that it is in) in full and
    half as much for each one further out."""
    score: dict[str, float] = {}
    for node, text in blocks:
        worth, up = float(len(text)), node
        while up is not None:
            if up.tag in ("article", "main"):
                node = up
            up = up.parent
        while node is not None and node.path:
            score[node.path] = score.get(node.path, 0.0) + worth
            worth /= 2
            node = node.parent
    return score


def parts_of(blocks: list[tuple[Node, Block]]) -> dict[str, list[int]]:
    """``[blocks, blocks of links, sum of their texts' checksums]`` by path of the containers that hold them."""
    parts: dict[str, list[int]] = {}
    for node, text in blocks:
        check = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        while node is not None and node.path:
            own = parts.setdefault(node.path, [0, 0, 0])
            own[0] += 1
            own[1] += text.linked
            own[2] += check
            node = node.parent
    return parts


def parent_of(path: str) -> str:
    return path.rpartition("/")[0]


def widened(path: str | None, wider: list[str] | None) -> str | None:
    """The path, or the highest of its parents up to which every path is in ``wider``."""
    while path and wider and path in wider:
        path = parent_of(path)
    return path


def text_at(blocks: list[tuple[Node, str]], path: str | None) -> str:
    """Text of the containers at ``path``; of the best container where there are none."""

    def inside(node: Node | None, path: str) -> bool:
        while node is not None:
            if node.path == path:
                return True
            node = node.parent
        return False

    chosen = [t for n, t in blocks if inside(n, path)] if path else []
    if not chosen and blocks:
        score = scores_of(blocks)
        best = max(score, key=lambda p: (score[p], p))
        chosen = [t for n, t in blocks if inside(n, best)]
    return "\n".join(chosen)


VOTES = "host string, path string, votes double, lifted long, pages long, wider long, added_low long, added_high long, own_low long, own_high long"


def _vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Votes by host and path: for the path itself, for its being no aside though marked so (a page for it where most
    of the text is there, else against it), and for its parent in its place (a page against it where the parent adds
    links); with the least and greatest checksums of what the parent adds and of the path's own text."""
    for f in frames:
        total: dict[tuple[str, str], list] = {}
        for host, page in zip(f["host"], f["html"]):
            every = blocks_of(page)
            shares = asides_of(every)
            blocks = without_asides(every, {p for p, share in shares.items() if share >= 0.5})
            score, parts = scores_of(blocks), parts_of(every)
            whole = max(score.values(), default=0.0)
            for path in score.keys() | shares.keys():
                row = total.setdefault((host, path), [0.0, 0, 0, 0, None, None, None, None])
                row[2] += 1
                check = parts[path][2]
                row[6], row[7] = (check if x is None else f(x, check) for x, f in ((row[6], min), (row[7], max)))
                if path in shares:
                    row[1] += 1 if shares[path] >= 0.5 else -1
                if path not in score:
                    continue
                row[0] += round(score[path] / whole, 6)
                up = parent_of(path)
                if up in ("", "body") or path[len(up) + 1 :].split(".")[0] in KEPT:
                    continue
                added, links, check = (x - y for x, y in zip(parts[up], parts[path]))
                if added:
                    row[3] += -1 if links else 1
                    row[4], row[5] = (check if x is None else f(x, check) for x, f in ((row[4], min), (row[5], max)))
        columns = [x.split()[0] for x in VOTES.split(", ")]
        rows = pd.DataFrame([(h, p, *v) for (h, p), v in total.items()], columns=columns)
        yield rows.astype({c: "Int64" for c in columns[3:]})


def _extract(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            texts = []
            for page, path, wider, lifted in zip(*(part.column(k).to_pylist() for k in range(2, 6))):
                blocks = without_asides(blocks_of(page), frozenset(lifted or ()))
                texts.append(str(text_at(blocks, widened(path, wider))))
            # ids and urls stay as they came
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


#: Bytes of a written table up to which it is broadcast; beyond, pages are shuffled by host and hot hosts split.
BROADCAST_BYTES = 16 << 20


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files are small."""
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(table) if int(str(size)) <= BROADCAST_BYTES else table


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` per row of ``pages``."""
    own = named(pages, id=id_col, url=url_col, html=html_col)
    own = own.withColumns({"host": host_of(F.col("url")), "html": F.coalesce("html", F.lit(""))})
    votes = own.select("host", "html").mapInPandas(_vote, VOTES)
    votes = votes.groupBy("host", "path").agg(
        F.round(F.sum("votes"), 3).alias("votes"), *[F.sum(x).alias(x) for x in ("lifted", "pages", "wider")],
        *[F.min(f"{x}_low").alias(f"{x}_low") for x in ("added", "own")], *[F.max(f"{x}_high").alias(f"{x}_high") for x in ("added", "own")],
    )
    votes = written(votes, "path-votes")
    best = written(votes.where("votes > 0").groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("best")), "host-paths")
    # a box that most pages have most of their text in is no aside, unless it says the same on all of them
    lifted = votes.where((F.col("lifted") > 0) & ((F.col("own_low") < F.col("own_high")) | (F.col("pages") == 1)))
    lifted = lifted.groupBy("host").agg(F.collect_set("path").alias("lifted"))
    # what every page of a host adds alike is no article text, unless the pages are copies
    varied = (F.col("added_low") < F.col("added_high")) | (F.col("own_low") == F.col("own_high"))
    above = F.startswith(F.concat("best", F.lit("/")), F.concat("path", F.lit("/")))
    wider = votes.where((F.col("wider") > 0) & varied).join(_small(best), "host").where(above).groupBy("host").agg(F.collect_set("path").alias("wider"))
    paths = best.withColumnRenamed("best", "path").join(wider, "host", "left").join(lifted, "host", "full")
    paths = written(paths, "host-text")
    located = own.join(_small(paths), "host", "left").select("id", "url", "html", "path", "wider", "lifted")
    kinds = dict(own.dtypes)
    out = located.mapInArrow(_extract, f"id {kinds['id']}, url {kinds['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(spark.read.parquet(f"{folder}/pages.parquet"))
