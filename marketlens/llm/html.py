"""Main text of web pages by tag-path ratios.

Every text node belongs to a root-to-leaf tag path. Text length and punctuation are summed by path and divided by the path's nodes;
both series are smoothed over the page's nodes in order and fused by their product with a third series, the role of a path: elements
and words of class, id and role that speak for boilerplate weigh little. Paths above a threshold choose the content's container, an
article or main element around most of their text, or else the deepest element that holds nearly all of it. A second smoothing mixes
each path's ratio with that of its side of the container, so that headings and short paragraphs stand by the text around them, and
the nodes of all paths at or above the threshold are the result.

Pages are read once from left to right: the time is linear in their length, however their elements nest or stay open.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame

from .store import map_texts

# Element names of the HTML standard, by role.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_HIDES = {"head", "button", "select", "option", "svg", "object", "canvas", "audio", "video"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "dialog", "menu"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "summary"}
_WHOLE = {"article", "main"}
#: Share of the chosen text that its container must hold: an article or main element, and any other
MOST, NEARLY_ALL = 0.6, 0.95
#: Weights of roles: boilerplate; names that speak for it in part ("article-header"); text outside the container, if that is an article
#: or main element, and if it is not
PLAIN, DOUBTFUL, OUTSIDE_ARTICLE, OUTSIDE = 0.1, 0.75, 0.3, 0.5
# Words of a class, id or role. Those of _OTHERS speak for boilerplate in any compound, those of _PAGE not beside one of _CONTENT.
_OTHERS = re.compile(r"ads?|advert\w*|adbox|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|breadcrumbs?|share|sharing|social|pagination|pager|comments?|disqus\w*|replies|respond|login|signup")
_PAGE = re.compile(r"banner|notice|alert|overlay|nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|widget|related|recommend\w*|toolbar|search|contentinfo|complementary")
_CONTENT = {"article", "entry", "post", "story", "content", "body", "main", "text", "title", "work", "works", "with", "has", "no"}

_BEGINS = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"[^>\"']*+")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
# Ids name what a heading or section is about. They tell a role outside articles only, but for whole ids of readers' comments.
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_COMMENTS = {"comments", "respond", "disqus_thread"}
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s/=]|$)|aria-hidden\s*+=\s*+[\"']?true)|display\s*+:\s*+none", re.I)
_WHITE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?\u2026\u3002\uff0c\u3001\u00bf\u00a1]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in _RAW}


def _pieces(page: str):
    """(text, closing, name, attributes) of the page from left to right; of text only the first, of a tag only the others.

    A quote in a tag runs to its end and may hold ``>``; where that leaves a tag open to the end of the page, quotes mean nothing from
    there on. A ``<`` that no ``>`` follows, or that begins no tag, is text. Comments, declarations and the content of scripts and the like
    give nothing; one that is not closed runs to the end of the page.
    """
    at, length, quotes, missing, known = 0, len(page), True, set(), {}

    def find(what: str, start: int) -> int:
        """Where ``what`` is found, or the end. What was found last holds for all starts up to it, so it is not looked for again."""
        since, found = known.get(what, (0, -1))
        if not since <= start <= found:
            found = page.find(what, start)
            found = length if found < 0 else found
            known[what] = start, found
        return found

    def end_of_tag(start: int) -> int:
        nonlocal quotes
        here = start
        while quotes:
            here = _REST.match(page, here).end()
            if here == length:
                quotes = False
            elif page[here] == ">":
                return here
            else:
                closed = find(page[here], here + 1)
                here = here + 1 if closed == length else closed + 1
        return find(">", start)  # there is one after every tag's name

    while at < length:
        begins = _BEGINS.search(page, at)
        open_ = begins.start() if begins else length
        if open_ > at:
            yield page[at:open_], False, "", ""
        at = open_
        if at == length:
            return
        if page.startswith("<!--", at):
            at = min(length, find("-->", at + 4) + 3)
        elif page.startswith("<![CDATA[", at):
            end = find("]]>", at)
            yield page[at + 9 : end].replace("&", "&amp;"), False, "", ""
            at = min(length, end + 3)
        elif page.startswith(("<!", "<?"), at):
            at = min(length, find(">", at) + 1)
        else:
            tag = _TAG.match(page, at) if find(">", at) < length else None
            if not tag:
                end = find("<!", at + 1)
                yield page[at:end], False, "", ""
                at = end
                continue
            end = end_of_tag(tag.end())
            name = tag[2].lower()
            yield "", bool(tag[1]), name, page[tag.end() : end]
            at = end + 1
            if name in _RAW and not tag[1]:
                close = _RAW_END[name].search(page, at) if f"</{name}" not in missing else None
                if close is None:
                    missing.add(f"</{name}")
                at = close.end() if close else length


def _role(name: str, names: str, inside: bool) -> tuple[float, bool]:
    """Weight of an element's own role, and whether a name and not the element gives it."""
    if name in _BOILERPLATE or (name == "header" and not inside):
        return PLAIN, False
    weight = 1.0
    if names and name not in ("html", "body", "main", "article"):
        for word in names.split():
            parts = [x for x in re.split(r"[-_]+", word) if x]
            if any(_OTHERS.fullmatch(x) for x in parts):
                return PLAIN, True
            if any(_PAGE.fullmatch(x) for x in parts):
                weight = min(weight, DOUBTFUL if any(x in _CONTENT for x in parts) else PLAIN)
    return weight, weight < 1


class _Page:
    """Elements in the order of their start tags, 0 being the page, and blocks of text with the innermost element that is not inline."""

    def __init__(self, page: str):
        self.parent, self.name, self.path, self.role, self.by_name = [0], [""], [0], [1.0], [False]
        self.inside = [False]  # an article or main element
        self.blocks: list[tuple[int, str]] = []
        self._paths: dict[tuple[int, str], int] = {}
        # open elements: name, number of the innermost element that is not inline, its place in the stack, whether text is hidden
        self._stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self._places: dict[str, list[int]] = {}
        self._run: list[str] = []
        for text, closing, name, attributes in _pieces(page):
            if not name:
                if not self._stack[-1][3]:
                    self._run.append(_html.unescape(text))
            elif closing:
                self._close(name)
            else:
                self._open(name, attributes)
        self._flush()

    def _flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self._run)).strip()
        self._run.clear()
        if text:
            self.blocks.append((self._stack[-1][1], text))

    def _cut(self, place: int) -> None:
        while len(self._stack) > place:
            self._places[self._stack.pop()[0]].pop()

    def _close(self, name: str) -> None:
        if name not in _INLINE:
            self._flush()
        places = self._places.get(name)
        # an inline element is closed only inside its block
        if places and (name not in _INLINE or places[-1] > self._stack[-1][2]):
            self._cut(places[-1])

    def _open(self, name: str, attributes: str) -> None:
        if name not in _INLINE:
            self._flush()
        if name in _VOID or name in _RAW:
            return
        block = self._stack[-1][2]
        if name in _CLOSES_P and self._stack[block][0] == "p":
            self._cut(block)
        while self._stack[self._stack[-1][2]][0] in _SAME.get(name, ()):
            self._cut(self._stack[-1][2])
        _, number, place, hidden = self._stack[-1]
        hidden = hidden or name in _HIDES or bool(_HIDDEN.search(attributes))
        if name not in _INLINE:
            named = [(m[0].lower(), "".join(m[1:]).lower()) for m in _NAMED.findall(attributes)]
            names = " ".join(x for _, x in named if x)
            inside = self.inside[number] or name in _WHOLE
            told = (x for kind, x in named if kind != "id" or x in _COMMENTS or not (inside or name in _HEADINGS))
            role, by_name = _role(name, " ".join(told), inside)
            path = self._paths.setdefault((self.path[number], f"{name}.{names}" if names else name), len(self._paths) + 1)
            for own, x in zip((self.parent, self.name, self.path, self.role, self.by_name, self.inside), (number, name, path, role, by_name, inside), strict=True):
                own.append(x)
            number, place = len(self.parent) - 1, len(self._stack)
        self._places.setdefault(name, []).append(len(self._stack))
        self._stack.append((name, number, place, hidden))

    def held(self, blocks) -> list[int]:
        """Characters of the blocks below each element."""
        out = [0] * len(self.parent)
        for element, text in blocks:
            out[element] += len(text)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def roles(self) -> list[float]:
        """Weight of each element's role, its ancestors' included. A name says nothing of an element that holds most of the page's text,
        unless text of an article or main element stands beside it."""
        held, whole = self.held(self.blocks), self.held([b for b in self.blocks if self.inside[b[0]]])
        out = [1.0]
        for i in range(1, len(self.parent)):
            wraps = self.by_name[i] and 2 * held[i] > held[0] and whole[i] == whole[0]
            out.append(max(out[self.parent[i]] * (1.0 if wraps else self.role[i]), 1e-6))
        return out

    def container(self, chosen) -> tuple[int, bool]:
        """The element that holds the chosen blocks, and whether it is an article or main element."""
        held = self.held(chosen)
        at = max(i for i, n in enumerate(held) if n >= MOST * held[0] and self.name[i] not in _LEAVES)
        whole = 0
        while at:
            whole = at if self.name[at] in _WHOLE else whole
            at = self.parent[at]
        if whole:
            return whole, True
        return max(i for i, n in enumerate(held) if n >= NEARLY_ALL * held[0] and self.name[i] not in _LEAVES), False

    def below(self, element: int) -> list[bool]:
        out = [element == 0]
        for i in range(1, len(self.parent)):
            out.append(i == element or out[self.parent[i]])
        return out


def _ratios(blocks: list[tuple[int, str]], path: list[int], smoothing: int) -> list[float]:
    """Each block's fused ratio: text length and punctuation by node of its path, smoothed over the blocks before and after."""
    sums: dict[int, list[float]] = {}
    for p, (_, text) in zip(path, blocks, strict=True):
        own = sums.setdefault(p, [0, 0, 0])
        own[0] += len(text)
        own[1] += len(_PUNCTUATION.findall(text))
        own[2] += 1
    ratio = [(sums[p][0] / sums[p][2], (sums[p][1] + 0.1) / sums[p][2]) for p in path]
    near = [ratio[max(0, i - smoothing) : i + smoothing + 1] for i in range(len(ratio))]
    return [sum(x for x, _ in r) / len(r) * (sum(y for _, y in r) / len(r)) ** 0.5 for r in near]


def _means(keys: list, values: list[float], weights: list[int]) -> dict:
    """Weighted mean of the values by key."""
    sums: dict = {}
    for key, value, weight in zip(keys, values, weights, strict=True):
        own = sums.setdefault(key, [0.0, 0])
        own[0] += value * weight
        own[1] += weight
    return {key: total / weight for key, (total, weight) in sums.items()}


def main_text(page: str | None, smoothing: int = 1, strictness: float = 0.35) -> str:
    """The page's main text: blocks in page order joined by a line feed; empty for a null or empty page, or one without text.

    ``strictness`` is the share of the mean fused ratio, weighted by text, that a path must reach.
    """
    tree = _Page(page) if page else None
    if not tree or not tree.blocks:
        return ""
    blocks, role = tree.blocks, tree.roles()
    path, weights = [tree.path[e] for e, _ in blocks], [len(text) for _, text in blocks]
    ratio = _ratios(blocks, path, smoothing)
    fused = [r * role[e] for r, (e, _) in zip(ratio, blocks, strict=True)]
    score = _means(path, fused, weights)
    bar = strictness * _means([0] * len(blocks), fused, weights)[0]
    holder, whole = tree.container([b for b, p in zip(blocks, path, strict=True) if score[p] >= bar])

    below = tree.below(holder)
    sides = [below[e] for e, _ in blocks]
    by_side = _means(sides, ratio, weights)
    by_path = _means(list(zip(path, sides, strict=True)), ratio, weights)
    best = by_side[True]
    place = {True: 1.0, False: OUTSIDE_ARTICLE if whole else OUTSIDE}
    # the ratio of a path and of its side, each as a share of the container's
    final = {(p, s): place[s] * (min(1.0, r / best) + min(1.0, by_side[s] / best)) / 2 for (p, s), r in by_path.items()}
    return "\n".join(text for (e, text), p, s in zip(blocks, path, sides, strict=True) if role[e] * final[p, s] >= strictness)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null or empty html gives an empty text; ids and urls may be null or repeated and are kept as they are; other columns are dropped;
    an empty table gives an empty result. White space inside a block is one space, and character references are decoded.
    """

    def run(batches):
        for pdf in batches:
            text = [main_text(x) for x in pdf.pop("html")]
            yield pdf.assign(text=text, n_chars=[len(x) for x in text])

    return map_texts(pages, run, "url string, text string, n_chars long", "page_id", "url", "html")
