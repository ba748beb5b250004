"""Pages as tokens: elements told apart by their path, and blocks of text.

A path is a number, hashed from the parent's path and the element's role, so deep nesting costs no
more than flat pages.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

# Elements by their role in a page.
DROPPED = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "select", "textarea", "title", "math")
PATH_TAGS = frozenset(
    "html body div section article main nav header footer aside form ul ol li dl dt dd table tr td th p h1 h2 h3 h4 h5 h6"
    " blockquote pre figure figcaption details button fieldset label dialog address head hgroup menu search".split()
)
BREAKS = PATH_TAGS - {"label", "button"} | {"br", "hr", "tbody", "thead", "tfoot", "caption", "center", "summary"}
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tr td th figure figcaption".split())
ARTICLE_TAGS = ("article", "main")
ASIDE_TAGS = frozenset("head nav footer aside form button dialog menu search address".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice notices menu nav navbar navigation sidebar footer header masthead topbar toolbar breadcrumb breadcrumbs comment"
    " comments disqus discussion replies respond share sharing social related recommended newsletter subscribe signup"
    " subscription popup modal overlay login widget widgets form search pagination pager copyright".split()
)
#: Say nothing of their own beside a word of ASIDE_WORDS, as in "comment-list" or "ad-slot".
PLAIN_WORDS = frozenset(
    "area block bottom box button buttons container content group inline inner item items left link links list lists outer post"
    " posts reader readers right row section slot thread top unit user users wrap wrapper zone".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<drop>{'|'.join(DROPPED)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=drop)\s*>|\Z))"
    r"|<(?P<end>/)?(?P<name>[a-z][a-z0-9]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-z][^>]*+>",
    re.S | re.I,
)
_ENDED = re.compile(rf"(?:-->|/>|</(?:{'|'.join(DROPPED)})\s*>)\Z|\A<(?!!--|(?:{'|'.join(DROPPED)})\b)", re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT_NAME = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


ROOT = 0


@dataclass(slots=True)
class Block:
    node: int
    aside: bool
    text: str


@dataclass(slots=True)
class Page:
    """Text blocks in page order, and how often each path occurs; parents come before their children."""

    blocks: list[Block] = field(default_factory=list)
    counts: dict[int, int] = field(default_factory=lambda: {ROOT: 1})
    parent: dict[int, int] = field(default_factory=dict)
    role: dict[int, str] = field(default_factory=lambda: {ROOT: ""})

    def within(self, top: set[int]) -> set[int]:
        """The paths at or below any of ``top``."""
        out = top & self.counts.keys()
        for node, up in self.parent.items():
            if up in out:
                out.add(node)
        return out

    def chars(self) -> dict[int, int]:
        """The characters at or below each path that no element's kind puts beside the article."""
        out = dict.fromkeys(self.counts, 0)
        for b in self.blocks:
            if not b.aside:
                out[b.node] += len(b.text)
        for node, up in reversed(self.parent.items()):
            out[up] += out[node]
        return out

    def beside(self, known: dict[int, bool]) -> set[int]:
        """The paths that class or id words put beside the article.

        A word is followed if the host's template says so (``known``), else if less than half of the
        page's text is there; names of such words only are followed on all pages with text in an article.
        An article ends an inherited mark unless its own words are of that kind. Inside an article or main
        element all words of the name must be of that kind, but for plain ones: "comment-list" goes,
        "comments-on-theory" and "related-work" stay.
        """
        chars = self.chars()
        inside = self.within(self.articles())
        article = any(chars[n] for n in self.articles() if not hinted(self.role[n]))
        out: set[int] = set()
        for node, role in self.role.items():
            hint = hinted(role)
            if tag(role) in ARTICLE_TAGS:
                if hint and tag(role) != "main" and self.parent[node] in out:
                    out.add(node)
            elif self.parent.get(node) in out:
                out.add(node)
            elif hint and node in inside:
                words = {w for w in role.split(".")[1:] if len(w) > 1}
                if words - PLAIN_WORDS <= ASIDE_WORDS:
                    out.add(node)
            elif hint and (article and ASIDE_WORDS.issuperset(role.split(".")[1:]) or known.get(node, 2 * chars[node] < chars[ROOT])):
                out.add(node)
        return out

    def articles(self) -> set[int]:
        return {n for n, r in self.role.items() if tag(r) in ARTICLE_TAGS}


def tag(role: str) -> str:
    return role.partition(".")[0]


def element(name: str, rest: str, inside_article: bool) -> tuple[str, bool]:
    """The role of an element in a path (name and class words), and whether its kind stands beside the article."""
    aside = name in ASIDE_TAGS or name == "header" and not inside_article
    words: list[str] = []
    if rest and "=" in rest:
        for m in _ATTRIBUTE.finditer(rest):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                aside |= value in ASIDE_ROLES
            else:
                words += [w for w in _SPLIT_NAME.split(value) if w]
    return (f"{name}.{'.'.join(sorted(set(words)))}" if words else name), aside


def hinted(role: str) -> bool:
    """Whether a class or id word says that the element stands beside the article; only a hint, see ``Page.beside``."""
    name, _, words = role.partition(".")
    return name not in ("html", "body") and not ASIDE_WORDS.isdisjoint(words.split("."))


def read_page(page: str) -> Page:
    """The tokens of a page.

    Unclosed and misnested elements are tolerated: headings and paragraphs end where a block starts,
    an end tag closes the nearest element of its name, and formatting elements are not part of a path.
    """
    out = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # name, path, beside the article, inside an article
    open_names: dict[str, int] = {}
    pending: list[str] = []

    def flush():
        if pending:
            text = _SPACE.sub(" ", html.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                out.blocks.append(Block(stack[-1][1] if stack else ROOT, bool(stack) and stack[-1][2], text))

    def close():
        open_names[stack.pop()[0]] -= 1

    at, tags_end, last = 0, page.rfind(">") + 1, None
    for m in _TOKEN.finditer(page, 0, tags_end):
        if m.start() > at:
            pending.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            last = m
            continue
        name = name.lower()
        if name in BREAKS:
            flush()
        if name not in PATH_TAGS:
            continue
        flush()
        if m["end"]:
            if open_names.get(name):
                while stack[-1][0] != name:
                    close()
                close()
            continue
        while stack and (stack[-1][0] in CLOSED_BY_BLOCK or stack[-1][0] == name == "li"):
            close()
        _, up, aside_above, inside = stack[-1] if stack else ("", ROOT, False, False)
        role, aside = element(name, m["rest"], inside)
        node = xxhash.xxh3_64_intdigest(role, up) >> 1
        out.counts[node] = out.counts.get(node, 0) + 1
        out.parent.setdefault(node, up)
        out.role.setdefault(node, role)
        if not m["rest"].endswith("/"):
            stack.append((name, node, aside or aside_above and name != "main", inside or name in ARTICLE_TAGS))
            open_names[name] = open_names.get(name, 0) + 1
    if last is None or last.end() < tags_end or _ENDED.search(last[0]):  # else a dropped element runs to the end of the page
        pending.append(page[at:])
    flush()
    return out
