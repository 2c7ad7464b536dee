"""Main text of raw web pages with site template removal.

Pass 1 hashes every element subtree outside articles, and inside them those of block elements with
attributes (BLOCKS; share boxes, notices, newsletter lines), by tag names and text, attributes left out. It
counts in Spark on how many different pages of its host each occurs; copies of a page (equal main text)
count once. Subtrees on at least `least` of them and on more than the `share` of the host's different pages
are the host's template. A subtree that encloses a kept article or main element is never template, and a
page of which the template would leave nothing keeps its text. Pass 2 parses again and leaves out: the
template's subtrees; elements that never hold article text (scripts, styles, forms, navigation, asides,
footers, headers outside the article, hidden elements); and elements of which the role, or a class or id as
a whole, names a menu, sidebar, notice, advert or the readers' comments (`comments`, `cookie-notice`,
`ad-box`; not `share-price` or `comment-on-policy`). What is left of the outermost <article> elements is the
text; without one, of <main>, else of the body. Paragraphs, headings, list items, cells and blocks without
attributes inside an article are never template: articles quote the same passages, and a passage on many
pages of a host is still text.

Cases: null or empty html has empty text; unclosed and stray tags are closed or ignored as browsers do
for paragraphs, list items and table cells; a truncated tag or character reference at the end is text as
far as it can be read; a null url has no host and no template; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.langid import host_of

#: Hashes in all templates together up to which they are broadcast; beyond, pages are joined by host and one of SALTS parts of it.
BROADCAST_HASHES, SALTS = 200_000, 32

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|textarea|title|noscript|template|iframe|xmp)\b[^>]*>(?:.*?</\1\s*[^>]*>|.*)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
OPEN, CLOSED = re.compile(r"<!--|<[a-z]", re.I), re.compile(r"-->\Z|</[a-z][^>]*>\Z", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = frozenset("table td th button object html body article main".split())
#: End tags inside these close nothing outside them, but for those of OUTER.
BARRIERS, OUTER = ("article", "main", "td", "th"), frozenset("body html table tr article main".split())
#: Those that, with attributes, can be template inside an article.
BLOCKS = frozenset("div section header hgroup ul ol dl figure table details address center".split())
NEVER = frozenset("head nav aside footer form button select fieldset dialog svg canvas object audio video menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription paywall sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment "
    "comments disqus respond replies social share sharing related popup modal overlay login signup search pagination pager toolbar widget".split()
)

#: Parts of names that say nothing of the content.
PLAIN = frozenset("area bar block body bottom box button buttons col column container content form group header icons inner item items left link links list outer panel right row section slot top unit wrap wrapper".split())


def _named(value: str) -> bool:
    """Whether one of the names is made of NAMED and PLAIN words only, with a NAMED one."""
    return any(not NAMED.isdisjoint(parts) and NAMED.union(PLAIN).issuperset(parts) for parts in (list(filter(None, re.split(r"[_-]+", name))) for name in value.split()))


class Element:
    __slots__ = ("block", "dropped", "name", "parts", "place")

    def __init__(self, name: str, dropped: bool, block: bool, place: int):
        self.name, self.dropped, self.block, self.place, self.parts = name, dropped, block, place, [name]


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    if name in NEVER or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and _named(value):
            return True
    return False


def _within(texts: list[tuple[int, str]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each text lies in one of the spans (first place excluded); both are in order, spans may be nested."""
    out, i, end = [], 0, -1
    for place, _ in texts:
        while i < len(spans) and spans[i][0] < place:
            end, i = max(end, spans[i][1]), i + 1
        out.append(place <= end)
    return out


def parse(html: str, template: frozenset[int] | set[int] = frozenset()) -> tuple[str, set[int]]:
    """(main text, hashes of the subtrees that can be template)."""
    place = 0  # counts tags and texts
    texts: list[tuple[int, str]] = []  # (place, text): what is not dropped
    spans: list[tuple[int, int, int]] = []  # subtrees that can be template: hash, first and last place
    holders: list[tuple[str, int, int]] = []  # outermost article and main elements: name, first and last place
    stack: list[Element] = []
    opened: dict[str, list[int]] = {}  # where in the stack elements of a name are
    articles = mains = dropped = 0

    def last(names: Iterable[str]) -> int:
        """Where in the stack the innermost element of these names is; -1: there is none."""
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    def close(upto: int) -> None:
        nonlocal articles, mains, dropped, place
        while len(stack) > upto:
            e = stack.pop()
            opened[e.name].pop()
            place += 1
            digest = xxhash.xxh3_64_intdigest("\x00".join(e.parts))  # of names, texts and the digests of children
            if stack:
                stack[-1].parts.append(f"\x01{digest:x}")
            if e.dropped:
                dropped -= 1
            if e.name == "article":
                articles -= 1
                if not articles and not e.dropped and not dropped:
                    holders.append(("article", e.place, place))
            elif e.name == "main":
                mains -= 1
                if not mains and not e.dropped and not dropped:
                    holders.append(("main", e.place, place))
            around = holders and holders[-1][1] >= e.place  # the last holder that ended lies in this element
            if (e.block or not articles) and not around and e.name not in ("html", "body", "article", "main"):
                spans.append((digest - (1 << 63), e.place, place))
            if e.name not in INLINE:
                texts.append((place, " "))

    def say(raw: str) -> None:
        nonlocal place
        text = unescape(raw) if "&" in raw else raw
        place += 1
        if stack:
            stack[-1].parts.append(" ".join(text.split()))
        if not dropped:
            texts.append((place, text))

    done, stop = 0, html.rfind(">") + 1  # no tag ends later, so none is looked for there
    for m in TOKEN.finditer(html, 0, stop):
        if m.start() > done:
            say(html[done : m.start()])
        done = m.end()
        name = m[3] or m[6]
        if not name:
            if done == stop and OPEN.match(m[0]) and not CLOSED.search(m[0]):
                done = len(html)  # a comment or script that never ends
            continue
        name, ends, attributes = name.lower(), m[2] if m[3] else m[5], (m[4] if m[3] else m[7]) or ""
        if ends:
            at = last((name,))
            if at >= 0 and (name in OUTER or at >= last(BARRIERS)):
                close(at)
            continue
        if name in VOID:
            if name not in INLINE:
                texts.append((place, " "))
            continue
        if name in CLOSES:
            inner, scope = CLOSES[name]
            while (at := last(inner)) > last(scope):
                close(at)
                if name != "tr":
                    break
        if name not in INLINE:  # a block closes an open paragraph
            if (at := last(("p",))) > last(SCOPES):
                close(at)
            texts.append((place, " "))
        e = Element(name, _unwanted(name, attributes, articles > 0), name in BLOCKS and attributes.strip(" \t\r\n\f/") != "", place)
        place += 1
        dropped += e.dropped
        articles += name == "article"
        mains += name == "main"
        opened.setdefault(name, []).append(len(stack))
        stack.append(e)
    if done < len(html):
        say(html[done:].split("<!--", 1)[0])
    close(0)
    kept = [(a, b) for kind, a, b in holders if kind == "article"] or [(a, b) for kind, a, b in holders if kind == "main"] or [(0, place)]
    gone = sorted((a, b) for h, a, b in spans if h in template) if template else []
    held = [x for x, inside in zip(texts, _within(texts, kept), strict=True) if inside]
    left = [text for (_, text), inside in zip(held, _within(held, gone), strict=True) if not inside]
    out = " ".join("".join(left).split()) or " ".join("".join(text for _, text in held).split())
    return out, {h for h, _, _ in spans}


def templates(pages: DataFrame, url: str = "url", html: str = "html", least: int = 3, share: float = 0.5) -> DataFrame:
    """(host, template): the hashes of the subtrees that recur on most of the host's different pages."""

    def run(batches):
        for batch in batches:
            hosts, texts, counts, flat = batch.column(0).to_pylist(), [], [0], []
            for h in batch.column(1).to_pylist():
                text, found = parse(h or "")
                texts.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
                flat.append(None)  # the page itself
                flat.extend(found)
                counts.append(len(flat))
            trees = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), trees], ["host", "page", "trees"])

    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).where("host is not null")
    seen = rows.mapInArrow(run, "host string, page long, trees array<long>")
    each = seen.select("host", "page", F.explode("trees").alias("tree")).distinct()
    counted = cut(each.groupBy("host", "tree").agg(F.count("*").alias("n")).where((F.col("n") >= least) | F.col("tree").isNull()))
    pages_of = counted.where("tree is null").select("host", F.col("n").alias("pages"))
    often = counted.where("tree is not null").join(pages_of, "host").where(F.col("n") > F.col("pages") * share)
    return often.groupBy("host").agg(F.collect_list("tree").alias("template"))


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html", **options) -> DataFrame:
    """The kept columns, text and n_chars of every page."""
    found = cut(templates(pages, url, html, **options))
    n = found.agg(F.sum(F.size("template"))).first()[0] or 0
    found = found.withColumnsRenamed({"host": "html__of", "template": "html__template"})
    rows = pages.select(*keep, F.col(html).alias("html__raw"), host_of(url).alias("html__host"), F.pmod(F.xxhash64(url, html), F.lit(SALTS)).alias("html__salt"))
    if n <= BROADCAST_HASHES:
        rows = rows.join(F.broadcast(found), F.col("html__host") == F.col("html__of"), "left")
    else:
        parts = found.withColumn("html__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(parts, F.expr("html__host = html__of and html__salt = html__part"), "left")
    fields = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for batch in batches:
            cached: dict[str, frozenset] = {}
            hosts = batch.column(len(keep) + 1)
            trees = batch.column(len(keep) + 2)
            out = []
            for i, raw in enumerate(batch.column(len(keep)).to_pylist()):
                host = hosts[i].as_py()
                if host not in cached:
                    cached[host] = frozenset(trees[i].as_py() or ())
                out.append(parse(raw or "", cached[host])[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(keep))), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*keep, "text", "n_chars"])

    return rows.select(*keep, "html__raw", "html__host", "html__template").mapInArrow(run, f"{fields}, text string, n_chars long")


def op9_html_text(pages: DataFrame) -> DataFrame:
    return main_text(pages)
