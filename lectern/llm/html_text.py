"""Main text of web pages by composite text density.

A page becomes a tree. Every node has its characters C, tags T, link characters LC and link tags LT, and the
density ``C/T * log(C/LC * T/LT)`` to the base ``ln(C/(C-LC) * LC + LCb/Cb * C + e)`` (b: the body). The
node whose children's densities have the greatest sum is the main subtree; the least density on its path to
the body is the threshold of what else can belong to the article: around the subtree, what is as dense and has a quarter
of its characters or more, is a heading, or stands in a line of bare text; in an article or main element around it,
what is not mostly links.

Names are a feature, not the rule: elements that by tag, role or class are menus, headers, footers, side bars, notices,
adverts, forms or comments have no characters and no tags, unless most of the text is below them, or the only article is
and much of the text (``Page.judge``). A page without any such name, tag or article is extracted by density alone.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The attributes of a tag up to its end: quotes count after an equals sign.
_ATTRIBUTES = re.compile(r"""(?:[^\s=>"']++|=\s*+(?:"[^"]*+"|'[^']*+')?+|\s++|["'])*+>""")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or is not shown as text.
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
#: Elements that are never a part of an article, and those that usually are not.
NEVER = RAW | {"head", "form", "fieldset", "select", "menu", "object", "canvas", "audio", "video", "datalist"}
NOISE = frozenset("nav footer aside dialog".split())
#: Words of classes, ids and roles of such elements, and words that say nothing beside one of them.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe signup comment comments disqus reply replies respond share sharing social related "
    "recommended widget widgets pagination pager toolbar masthead topbar contentinfo complementary search login".split()
)
NEUTRAL = frozenset("site page main top bottom left right box bar list item items link links wrapper wrap container content section block area inner outer global primary secondary header head unit slot panel form buttons icons".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: An opening tag ends open elements of these names, up to one of the bounds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_P_BOUND = frozenset("article aside body div footer form header li main nav section td th table blockquote".split())


def _is_noise(attributes: str, inside: bool) -> bool:
    """Whether a class, id or role is a word of noise, or made of one and neutral words ("cookie-notice", not "share-price")."""
    for m in _NAME.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _PART.findall(token)
            if any(p in NOISE_WORDS or p == "header" and not inside for p in parts) and all(p in NOISE_WORDS or p in NEUTRAL for p in parts):
                return True
    return False


class Page:
    """The tree of a page, as parallel lists; children come after their parent."""

    def __init__(self, source: str, forms: bool = False):
        self.tag, self.parent, self.items, self.off = ["#root"], [-1], [[]], [False]
        self.stack, self.forms, self.main = [0], forms, [False]
        self.named = [False]
        self.open: dict[str, int] = {}
        lower = None
        at, n, quoted = 0, len(source), True
        while at < n:
            begin = source.find("<", at)
            if begin < 0 or source.find(">", begin) < 0:  # no tag any more
                if begin >= 0 and source.startswith("<!--", begin):
                    self._text(source[at:begin])
                else:
                    self._text(source[at:])
                break
            if begin > at:
                self._text(source[at:begin])
            after = source[begin + 1 : begin + 2]
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 2)
                at = n if end < 0 else end + 3
                continue
            if after in ("!", "?"):
                at = source.find(">", begin) + 1
                continue
            slash = after == "/"
            named = _TAG_NAME.match(source, begin + 1 + slash)
            if not named:
                self._text("<")
                at = begin + 1
                continue
            ends = _ATTRIBUTES.match(source, named.end()) if quoted else None
            if ends:
                at = ends.end()
            else:  # a quote is never closed: from now on tags end at the next >, so that a page is read once
                quoted = False
                at = source.find(">", begin) + 1
            name = named[0].lower()
            if slash:
                self._close(name)
                continue
            attributes = source[named.end() : at - 1]
            self._open(name, attributes)
            if name in RAW and not attributes.endswith("/"):
                lower = lower or source.lower()
                end = lower.find(f"</{name}", at)
                at = n if end < 0 else end
        self.judge()

    def judge(self) -> None:
        """Switch off what a class, id or role marks as noise, with all below it, but not where the text of the page is.

        Text counts for the nearest marked element around it, or as unmarked; links do not count. From the largest on, an
        element is no noise if it has more text than is unmarked, or over a quarter of that and an article or main. Where an
        unmarked article or main has text, only what is inside one and has over four times the unmarked text is no noise.
        Then neither are the marked elements around it, and their text is unmarked too.
        """
        if not any(self.named):
            return
        n = len(self.tag)
        near, linked, own, holds = [0] * n, [False] * n, [0] * n, [False] * n
        for i in range(n):
            up = self.parent[i]
            near[i] = i if self.named[i] else near[up] if up >= 0 else 0
            linked[i] = self.tag[i] == "a" or up >= 0 and linked[up]
            if not self.off[i] and not linked[i]:
                count = sum(len(x.strip()) for x in self.items[i] if isinstance(x, str))
                own[near[i]] += count
                holds[near[i]] = holds[near[i]] or count > 0 and self.main[i]
        text, framed, seen = own[0], holds[0], set()
        for i in sorted((i for i in range(n) if self.named[i]), key=lambda i: (-own[i], i)):
            if self.named[i] and (self.main[i] and own[i] > text * 4 if framed else own[i] > text or holds[i] and own[i] * 4 > text):
                at = i
                while at > 0 and at not in seen:
                    seen.add(at)
                    if self.named[at]:
                        self.named[at] = False
                        text, framed = text + own[at], framed or holds[at]
                    at = self.parent[at]
        for i in range(1, n):
            self.off[i] = self.off[i] or self.named[i] or self.off[self.parent[i]]

    def _text(self, text: str) -> None:
        if not self.off[self.stack[-1]]:
            self.items[self.stack[-1]].append(html.unescape(text) if "&" in text else text)

    def _pop_to(self, depth: int) -> None:
        for i in self.stack[max(depth, 1) :]:
            self.open[self.tag[i]] -= 1
        del self.stack[max(depth, 1) :]

    def _open(self, name: str, attributes: str) -> None:
        stack, tag = self.stack, self.tag
        if name in _CLOSES_P and self.open.get("p"):
            for d in range(len(stack) - 1, 0, -1):
                if tag[stack[d]] == "p":
                    self._pop_to(d)
                    break
                if tag[stack[d]] in _P_BOUND:
                    break
        if name in _ENDS:
            ends, bounds = _ENDS[name]
            for d in range(len(stack) - 1, 0, -1) if any(self.open.get(e) for e in ends) else ():
                if tag[stack[d]] in bounds:
                    break
                if tag[stack[d]] in ends:
                    self._pop_to(d)
        up = stack[-1]
        off, inside, named = self.off[up], self.main[up], False
        if not off and name not in ("html", "body", "article", "main"):
            off = name in NEVER and not (self.forms and name in ("form", "fieldset"))
            named = not off and (name in NOISE or name == "header" and not inside or bool(attributes) and _is_noise(attributes, inside))
        i = len(tag)
        tag.append(name)
        self.named.append(named)
        self.parent.append(up)
        self.items.append([])
        self.off.append(off)
        self.main.append(inside or name in ("article", "main"))
        self.items[up].append(i)
        if name not in VOID and not attributes.endswith("/") or name in ("p", "div"):
            stack.append(i)
            self.open[name] = self.open.get(name, 0) + 1

    def _close(self, name: str) -> None:
        if not self.open.get(name):
            return
        for d in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[d]] == name:
                self._pop_to(d)
                return
            if self.tag[self.stack[d]] in ("article", "main", "body", "table") and name not in BLOCK:
                return

    def densities(self) -> tuple[list[float], list[float], int]:
        """(density, sum of the children's densities) of every node, and the body."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            own = sum(len(x.strip()) for x in self.items[i] if isinstance(x, str))
            chars[i] += own
            if self.tag[i] == "a":
                link_chars[i] = chars[i]
            up = self.parent[i]
            if up >= 0 and not self.off[i]:
                chars[up] += chars[i]
                tags[up] += tags[i] + 1
                link_chars[up] += link_chars[i]
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        self.chars, self.link_chars, self.link_tags = chars, link_chars, link_tags
        share = link_chars[body] / max(chars[body], 1)
        density = [0.0] * n
        for i in range(n):
            c = chars[i]
            if c and not self.off[i]:
                t, lc, lt = max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
                base = math.log(c / max(c - link_chars[i], 1) * link_chars[i] + share * c + math.e)
                density[i] = c / t * math.log(max(c / lc * t / lt, 1.0000001)) / math.log(base) if base > 1 else c / t * math.log(max(c / lc * t / lt, 1.0000001)) / 1e-9
        sums = [0.0] * n
        for i in range(1, n):
            sums[self.parent[i]] += density[i]
        return density, sums, body

    def link_dense(self, i: int) -> bool:
        return self.link_chars[i] * 2 > self.chars[i]

    def drop_menus(self, root: int) -> None:
        """Switch off the blocks below a node that are mostly links, of three or more."""
        for i in range(root + 1, len(self.tag)):
            self.off[i] = self.off[i] or self.off[self.parent[i]] and self.parent[i] > root or self.tag[i] in BLOCK and self.link_tags[i] >= 3 and self.link_dense(i)

    def blocks(self, roots: list[int], kept: dict[int, set[int]] | None = None, edges: frozenset[int] = frozenset()) -> list[str]:
        """The texts of all blocks below the roots, in page order. ``kept``: of these nodes only the named children, and text."""
        kept = kept or {}
        out: list[str] = []
        held: list[str] = []

        def flush() -> None:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(text)

        for root in roots:
            todo: list = [root]
            while todo:
                x = todo.pop()
                if x is None:
                    flush()
                elif isinstance(x, str):
                    held.append(x)
                elif not self.off[x]:
                    if self.tag[x] == "br":
                        held.append(" ")
                    edge = self.tag[x] in BLOCK or x == root or x in edges
                    if edge:
                        flush()
                        todo.append(None)
                    todo.extend(y for y in reversed(self.items[x]) if x not in kept or isinstance(y, str) or y in kept[x])
            flush()
        return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks, joined by line breaks; '' for no page or no text."""
    if not source:
        return ""
    page = Page(source)
    density, sums, body = page.densities()
    if not any(density):
        page = Page(source, forms=True)
        density, sums, body = page.densities()
        if not any(density):
            return ""
    n = len(density)
    # The body is the subtree only where no other node has half of its characters.
    order = lambda i: (sums[i] if not page.off[i] else -1, density[i], -i)
    best = max(range(n), key=order)
    if best <= body:
        inner = [i for i in range(body + 1, n) if page.chars[i] * 2 >= page.chars[body]]
        best = max(inner, key=order, default=best)
    # A paragraph is a part of its parent's text, however many bold words give it a sum of its own.
    while page.parent[best] > body and (page.tag[best] not in BLOCK or page.tag[best] in ("p", "li", "blockquote")) and not any(isinstance(x, int) and page.tag[x] in BLOCK for x in page.items[best]):
        best = page.parent[best]
    path = [best]
    while page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    upto = path[: path.index(body) + 1] if body in path else path
    threshold = min(density[i] for i in upto)
    # In an article or main element around the subtree, all that is not mostly links belongs to the text, whatever its size.
    frame = max((k for k, i in enumerate(path) if page.tag[i] in ("article", "main")), default=0)
    if not frame and page.tag[best] not in ("article", "main"):
        page.drop_menus(best)
    kept: dict[int, set[int]] = {}
    edges = {best}
    top = best
    for k, (up, child) in enumerate(zip(path[1:], path), 1):
        if child == body:
            break
        items, added = page.items[up], {child}
        words = [isinstance(x, str) and any(map(str.isalnum, x)) for x in items]
        for j, x in enumerate(items):
            if isinstance(x, int) and x != child and not page.off[x]:
                # What stands in a line of bare text is a part of it.
                inline = page.tag[x] not in BLOCK and (j > 0 and words[j - 1] or j + 1 < len(items) and words[j + 1])
                dense = not page.link_dense(x) if k <= frame else density[x] >= threshold and page.chars[x] * 4 >= page.chars[best]
                if inline or dense or page.tag[x] in ("h1", "h2", "h3"):
                    added.add(x)
                    if not inline:
                        edges.add(x)
        if len(added) > 1 or any(words) or k <= frame:
            for i in path[path.index(top) + 1 : k]:
                kept.setdefault(i, {path[path.index(i) - 1]})
            kept[up] = added
            top = up
    return "\n".join(page.blocks([top], kept, frozenset(edges)))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, *keep, text, n_chars) of every row.

    A null or empty page has the empty text. Malformed pages are read as far as they can be: open elements end where their
    parent does, a tag without an end is text, a comment without one hides the rest. Pages are read in time in proportion to
    their length, however long, deep or hostile. Repeated rows stay, other columns go; an empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    names = [id_col, *keep]
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(names)), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"k{i} {kinds[f'k{i}']}" for i in range(len(names))) + ", text string, n_chars long")
    return out.toDF(*names, "text", "n_chars")
