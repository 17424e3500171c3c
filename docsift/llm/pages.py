"""Main text of web pages: the template of a host is deduced from equivalence classes, and what remains are the slots.

Tokens of a page are its tags (opening and closing, told by their path of elements) and its words (told by the path they stand
in; in blocks of over SHORT words phrases take the place of words; what names tell to be no article has tags alone). Tokens of a host with one occurrence vector (how often they stand on which pages) are a class. Classes of tokens that
stand once on each of at least two pages, and on at least `share` of the host's, or on FREQUENT pages in a class of LARGE
tokens, can be template. On a page, classes are taken by falling number of pages: of a class those tokens hold that keep the
order which the class has on its first page, and a class holds if all of it lies in one slot of the template so far (so
classes nest). A block of text is template, with what varies in it, if its element's tag is, and half of its words are and stand together on
the class's first and last page too: text of an element that repeats on a page, like a paragraph, is a slot's, however
many pages have it, and so is what stands in a paragraph, heading, list item or the like of an article element.

What is left are slots. The names of elements tell some that hold no article text (nav, footer, form, ...; a class, id or role
from a list; inside of an article only a whole name counts). If a page has an article or main element outside of those, only what is
in it is its text, without the blocks that stand there on at least `share` of the host's pages and on FREQUENT, be they what they may;
but if those were half of the article, the page is taken for a near copy and keeps them. If it has none but
the host has a template, the slot with most words is the article, with the headings and with slots of a quarter of its words.

The vectors are sums, modulo a prime, of a hash of (page, count); copies of a page divide by their number, so they count once.
Sums and least positions are gathered before the shuffle, so that no host's pages meet in a task. The templates of all hosts are
broadcast if they are small; if not, each is sent once to a task that has pages of its host, which streams them.

Defined results: null or empty html gives an empty text; a null or odd url belongs to the host ''; an unclosed element
ends with its parent; a page of template alone gives an empty text; very long pages are read whole, one at a time; repeated
pages are told one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages that a template needs, and share of the host's; pages and tokens of a class on fewer.
PAGES, SHARE, FREQUENT, LARGE = 2, 0.5, 4, 4
#: Template tokens up to this many are broadcast (32 bytes each).
BROADCAST_TOKENS = 500_000
#: Pages of a host in one task, where templates are shuffled.
HOST_PAGES = 1_000
#: Words of a block up to which words are tokens, not the phrases between marks.
SHORT = 12
PHRASE = re.compile(r"(?<=[.,;:!?]) ")
#: The prime of the sums, small enough that four thousand million terms fit a long.
P = (1 << 31) - 1

# Elements that hold no text of the page, elements that hold no article text, elements that do not end a
# block, elements that have no end, and the words of a class, id or role that mark what is not the article.
SILENT = {"script", "style", "head", "title", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "option", "datalist", "textarea", "button"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MARKS = re.compile(
    r"^(nav(bar|igation)?|menu|submenu|breadcrumbs?|masthead|banner|footer|foot|colophon|side(bar|nav)?|widgets?|ads?|advert(s|isement|ising)?|sponsor(ed)?|promo(tion)?|cookies?|consent|gdpr|"
    r"popup|modal|newsletter|subscribe|subscription|signup|login|social|comments?|disqus|pagination|pager|toolbar|complementary|contentinfo)$"
)
# Words that mark it as the whole of a class, id or role, or with one of these; outside of an article.
WEAK = re.compile(
    r"^((site|page)[-_])?(header|aside|related|recommend(ed|ations)?|notices?|alert|overlay|search|form|share|sharing|replies|reply|respond|discussion|skip|copyright|legal|disclaimer|hidden|dialog)"
    r"([-_](posts?|articles?|stories|links?|box|bar|form|area|list|section|buttons?|block|container|wrapper))?$"
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


def marked(attrs: list[tuple[str, str | None]], article: bool) -> bool:
    """Whether names say that an element holds no article text; article: it stands inside of one."""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and value:
            for word in value.lower().split():
                bits = [x for x in re.split(r"[-_]+", word) if x]
                if bits and (MARKS.match(word) or (not article and (MARKS.match(bits[0]) or MARKS.match(bits[-1]) or WEAK.match(word)))):
                    return True
    return False


_KNOWN: dict[tuple[str, str], int] = {}


def token(path: str, text: str) -> int:
    """A 63-bit hash, remembered for a while."""
    found = _KNOWN.get((path, text))
    if found is None:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        found = _KNOWN[path, text] = xxhash.xxh3_64_intdigest(f"{path}\x00{text}".encode("utf-8", "surrogatepass")) >> 1
    return found


def whole(path: str, text: str) -> int:
    """The token of a block of an article: negative, so that it counts for no class of tags and words."""
    return -token(f"block {path}", text) - 1


PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "pre", "td", "th", "figcaption", "article", "main"}
#: What holds where no element is open.
OUTSIDE = ("", False, False, False, "")


def units(text: str) -> list[str]:
    """What are tokens of a block: its words, or its phrases if it is long."""
    return text.split(" ") if text.count(" ") < SHORT else PHRASE.split(text)


class Blocks(HTMLParser):
    """Blocks of a page: (path, text, aside, inside an article, place of its first word in tokens); and its tokens."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, bool, bool, int]] = []
        self.tokens: list[int] = []
        self.tags: list[int] = []  # places of tags in tokens
        self.wholes: list[int] = []  # negative tokens of the blocks of an article, each as a whole
        self.open: list[tuple[str, bool, bool, bool, str]] = []  # tag, silent, aside, article, path of elements
        self.text: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            _, silent, aside, article, path = self.open[-1] if self.open else OUTSIDE
            if not silent:
                self.blocks.append((path, text, aside, article, len(self.tokens)))
                if not aside:
                    self.tokens += [token(path, w) for w in units(text)]
                    if article:
                        self.wholes.append(whole(path, text))

    def _tag(self, kind: str) -> None:
        tag, silent, _, _, path = self.open[-1]
        if not silent and tag not in INLINE:
            self.tags.append(len(self.tokens))
            self.tokens.append(token(kind, path))

    def _pop(self, n: int) -> None:
        while len(self.open) > n:
            self._tag("end")
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        # an element that may not be open any more is closed, with the inline elements in it
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ends:
                self._pop(i)
            elif self.open[i][0] not in INLINE and self.open[i][0] not in ends:
                break
        _, silent, aside, article, path = self.open[-1] if self.open else OUTSIDE
        body = tag in ("article", "main") or any(k == "role" and v in ("main", "article") for k, v in attrs)
        # inside an article a header holds its title; elsewhere it is the site's
        away = (tag in ASIDE and not (tag == "header" and article)) or (tag not in ("html", "body") and marked(attrs, article))
        self.open.append((tag, silent or tag in SILENT, aside or away, article or body, path if tag in INLINE else f"{path}/{tag}"))
        if (tag in SILENT or away) and tag in INLINE:
            self._flush_before()
        self._tag("begin")

    def _flush_before(self) -> None:
        last = self.open.pop()
        self._flush()
        self.open.append(last)

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self._flush()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                inline = all(x[0] in INLINE for x in self.open[i:]) and self.open[i][1:3] == ((self.open[i - 1][1:3]) if i else (False, False))
                if not inline:
                    self._flush()
                self._pop(i)
                return
            if self.open[i][0] not in INLINE and tag in INLINE:
                return  # an inline end does not end a block

    def handle_data(self, data):
        self.text.append(data)

    def finish(self) -> Blocks:
        self.close()
        self._flush()
        self._pop(0)
        return self


def parsed(html: str | None) -> Blocks:
    parser = Blocks()
    if html:
        parser.feed(html)
    return parser.finish()


def in_order(places: list[tuple[int, int]]) -> list[int]:
    """Of (place on this page, place on the first page), by the first, the longest part in which the second grows too."""
    ends: list[int] = []  # least second of a part of each length, and which it is
    which: list[int] = []
    before: list[int] = [-1] * len(places)
    for i, (_, second) in enumerate(places):
        k = bisect_left(ends, second)
        before[i] = which[k - 1] if k else -1
        ends[k:], which[k:] = ([second], [i]) if k == len(ends) else ([second, *ends[k + 1 :]], [i, *which[k + 1 :]])
    out, at = [], which[-1] if which else -1
    while at >= 0:
        out.append(places[at][0])
        at = before[at]
    return out[::-1]


def template_places(tokens: list[int], classes: dict[int, tuple[int, int, int, int]]) -> list[int]:
    """Places of the template's tokens on a page. classes: token to (pages, class, place on the first page, on the last)."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for at, t in enumerate(tokens):
        if t in classes:
            pages, of, first, _ = classes[t]
            found.setdefault((-pages, of), []).append((at, first))
    template: list[int] = []
    for _, places in sorted(found.items()):
        held = in_order(places)
        if bisect_left(template, held[0]) == bisect_left(template, held[-1]):  # all in one slot
            for at in held if template else ():
                insort(template, at)
            template = template or held
    return template


def _together(known: list[tuple[int, int, int, int]], held: int, words: int, parts: int) -> bool:
    """Whether template tokens of a block of so many words and tokens belong together: alone on FREQUENT pages, or in a block's length elsewhere too."""
    if 2 * held < words or not known:
        return False
    if len(known) == 1:
        return known[0][0] >= FREQUENT
    return all(max(x[i] for x in known) - min(x[i] for x in known) <= parts + 1 for i in (2, 3))


def repeated_blocks(page: Blocks, classes: dict[int, tuple[int, int, int, int]]) -> set[int]:
    """Blocks of an article that are the host's: notices, related links, lines of copyright. Were they half of its words or
    more, the page would be a near copy of others, and its article no template."""
    if not classes or not page.wholes:
        return set()
    again, words, all_words = set(), 0, 0
    for i, (path, text, aside, article, _) in enumerate(page.blocks):
        if aside or not article:
            continue
        n = text.count(" ") + 1
        all_words += n
        if whole(path, text) in classes:
            again.add(i)
            words += n
    return again if 2 * words < all_words else set()


def main_text(page: Blocks, classes: dict[int, tuple[int, int, int, int]]) -> str:
    """The article's blocks, one a line. classes: as for template_places, empty if the host has no template."""
    template = template_places(page.tokens, classes) if classes else []
    held, tags = set(template), set(page.tags)
    fixed = {page.tokens[at] for at in template if at in tags}
    borders = [at for at in template if at in tags]
    slots = []
    again = repeated_blocks(page, classes)
    for i, (path, text, aside, article, at) in enumerate(page.blocks):
        if aside or i in again:
            continue
        words = text.count(" ") + 1
        if token("begin", path) in fixed and not (article and path.rsplit("/", 1)[-1] in PROSE):
            parts = units(text)
            known = [(classes[page.tokens[j]], u.count(" ") + 1) for j, u in enumerate(parts, at) if j in held]
            if _together([x for x, _ in known], sum(n for _, n in known), words, len(parts)):
                continue
        slots.append((text, article, bisect_left(borders, at), words, path.rsplit("/", 1)[-1]))
    if any(x[1] for x in slots):
        slots = [x for x in slots if x[1]]
    elif len(borders) > 2 and slots:
        size = Counter()
        for x in slots:
            size[x[2]] += x[3]
        most = max(size.values())
        slots = [x for x in slots if 4 * size[x[2]] >= most or x[4] in ("h1", "h2", "h3")]
    return "\n".join(x[0] for x in slots)


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """h, token, pages, class, first, last: the tokens that can be template on the host with hash h. pages: h, html, copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "token", "pages", "v1", "v2", "page", "first", "end", "last"]
        for b in common.slices(batches, "html"):
            seen: dict[tuple[int, int], list[int]] = {}
            for h, html, copies in zip(b.column("h").to_pylist(), b.column("html").to_pylist(), b.column("copies").to_pylist(), strict=True):
                page = xxhash.xxh3_64_intdigest((html or "").encode("utf-8", "surrogatepass")) >> 1
                part = pow(copies, -1, P) if copies > 1 else 1
                v1, v2 = page % P * part % P, (page >> 32) * 48271 % P * part % P
                found = parsed(html)
                tokens = found.tokens + found.wholes
                first = dict(zip(tokens, range(len(tokens)), strict=True))
                twice = [t for t, n in Counter(tokens).items() if n > 1] if len(first) < len(tokens) else []
                first.update(dict.fromkeys(twice, -1))  # once on each of its pages, or no template
                first[0] = 0  # token 0 stands for the host
                for t, at in first.items():
                    if (old := seen.get((h, t))) is None:
                        seen[h, t] = [part, v1, v2, page, at, page, at]
                        continue
                    old[0] += part
                    old[1] += v1
                    old[2] += v2
                    if at < 0 or old[4] < 0:
                        old[4] = -1
                    elif page < old[3]:
                        old[3:5] = page, at
                    if page > old[5]:
                        old[5:] = page, at
            rows = [(*k, v[0] % P, v[1] % P, v[2] % P, *v[3:]) for k, v in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(9)], names=names)

    found = pages.mapInArrow(run, "h long, token long, pages long, v1 long, v2 long, page long, first long, end long, last long")
    sums = [F.sum(c).alias(c) for c in ("pages", "v1", "v2")]
    gathered = found.groupBy("h", "token").agg(*sums, F.min("first").alias("least"), F.min_by("first", "page").alias("first"), F.max_by("last", "end").alias("last"))
    modulo = lambda c: F.col(c) % F.lit(P)
    gathered = gathered.where("least >= 0").select("h", "token", modulo("pages").alias("pages"), (modulo("v1") * (1 << 31) + modulo("v2")).alias("vector"), "first", "last").where(f"pages >= {least} or token = 0")
    gathered = common.cut(gathered)
    hosts = gathered.where("token = 0").select("h", F.col("pages").alias("all"))
    tokens = gathered.where("token <> 0")
    sizes = tokens.groupBy("h", "vector").agg(F.max("pages").alias("on"), F.count_if(F.col("token") > 0).alias("size")).join(hosts, "h")
    common_ = F.col("on") >= share * F.col("all")
    valid = sizes.where(common_ | ((F.col("on") >= FREQUENT) & (F.col("size") >= LARGE))).select("h", "vector", (common_ & (F.col("on") >= FREQUENT)).alias("wide"))
    return tokens.join(valid, ["h", "vector"]).where("token > 0 or wide").select("h", "token", "pages", F.col("vector").alias("class"), "first", "last")


def extract(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    common.tune(pages.sparkSession)
    html = F.col("html").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(host(F.col("url"))).alias("h"), html.alias("html"), F.xxhash64(html, F.lit(1)).alias("digest"))
    copies = common.cut(rows.groupBy("h", "digest").agg(F.count("*").alias("copies")).where("copies > 1"), files=common.FEWEST_FILES)
    few = copies.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    told = rows.join(F.broadcast(copies) if few else copies, ["h", "digest"], "left").select("h", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    found = common.cut(templates(told, least, share))
    names, schema = ["page_id", "url", "text", "n_chars"], "page_id long, url string, text string, n_chars long"

    def told_of(b: pa.RecordBatch, of) -> pa.RecordBatch:
        text = [main_text(parsed(html), of(h)) for h, html in zip(b.column("h").to_pylist(), b.column("html").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=names)

    if found.count() <= BROADCAST_TOKENS:
        t = found.orderBy("h").toPandas()  # BROADCAST_TOKENS rows at most
        shared = pages.sparkSession.sparkContext.broadcast([t[c].to_numpy() for c in ("h", "token", "pages", "class", "first", "last")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hosts, *values = shared.value
            known: dict[int, dict[int, tuple[int, int, int, int]]] = {}

            def of(h: int) -> dict[int, tuple[int, int, int, int]]:
                if h not in known:
                    if len(known) > 200:
                        known.clear()
                    own = slice(*np.searchsorted(hosts, [h, h + 1]))
                    known[h] = {x[0]: x[1:] for x in zip(*(v[own].tolist() for v in values), strict=True)}
                return known[h]

            for b in common.slices(batches, "html"):
                yield told_of(b, of)

        return rows.select("page_id", "url", "h", "html").mapInArrow(run, schema)

    # A host's template goes once to each task that has pages of it, before them; hosts of many pages are dealt to several.
    of_host = found.groupBy("h").agg(F.collect_list(F.struct("token", "pages", "class", "first", "last")).alias("template"))  # of one host
    large = common.cut(rows.groupBy(F.col("h").alias("of")).agg(F.ceil(F.count("*") / HOST_PAGES).alias("parts")).where("parts > 1"), files=common.FEWEST_FILES)
    dealt = F.broadcast(large) if large.count() <= BROADCAST_TOKENS else large
    parts = F.coalesce("parts", F.lit(1))
    first = of_host.join(dealt, F.col("h") == F.col("of"), "left").select("h", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "template", F.lit(True).alias("first"))
    then = rows.join(dealt, F.col("h") == F.col("of"), "left").select("h", F.pmod(F.xxhash64("page_id", "digest"), parts).alias("part"), "page_id", "url", "html", F.lit(None).cast(of_host.schema["template"].dataType).alias("template"), F.lit(False).alias("first"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, classes = None, {}
        for b in common.slices(batches, "html"):
            at = 0
            for i, is_first in enumerate([*b.column("first").to_pylist(), True]):
                if is_first:
                    if i > at:
                        yield told_of(b.slice(at, i - at), lambda h: classes if h == host else {})  # noqa: B023  used at once
                    at = i + 1
                    if i < b.num_rows:
                        host = b.column("h")[i].as_py()
                        classes = {x["token"]: (x["pages"], x["class"], x["first"], x["last"]) for x in b.column("template")[i].as_py() or ()}

    both = first.unionByName(then).repartition("h", "part").sortWithinPartitions("h", "part", F.desc("first"))
    return both.mapInArrow(stream, schema)


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
