"""The main text of web pages, by boosted trees over the nodes of the DOM.

A tolerant parser builds the tree.  Each element has features of its own, of
its subtree (text, tags, links and their densities), of its depth and siblings
and of the tokens of its tag, class, id and role.  Gradient-boosted trees give
the log odds that its text belongs to the article.  Labels that contradict each
other are ruled out in the decoding: a kept node's parent is kept, and of all
such labellings a dynamic program over the tree takes the one of the highest
total, nodes weighted by the text they own.

No labelled pages exist, so the trees are fitted on pages that a generator
makes from a fixed seed, with and without telling names; TRAIN_PAGES bounds it.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt

TRAIN_PAGES, SEED = 700, 7

#: Fixed values of HTML: elements without content, with raw content, that start a block, that never hold article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend optgroup option select title head".split()
)
NEVER = frozenset("script style head title noscript template svg canvas iframe object audio video select option button textarea input datalist nav menu dialog noembed noframes xmp map".split())
#: Elements that a new one of the given kinds closes.
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup summary legend head title".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
INLINE_FORMAT = frozenset("b i em strong u s small big font tt code a span".split())

#: Tokens of tags, classes, ids and roles, by what they tell (fixed values).
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination tabs toc topbar toolbar skip",
    "header": "header masthead banner logo branding top hero",
    "footer": "footer foot bottom copyright colophon legal contentinfo",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations more popular trending tags",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay disclaimer message toast subscribe newsletter signup paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense dfp outbrain taboola",
    "form": "form search login signin input contact survey poll",
    "comment": "comment comments reply replies respond discussion disqus thread feedback reader readers reviews",
    "share": "share sharing social follow facebook twitter like rating author byline meta date timestamp",
    "main": "article content main post entry story body text maincontent articlebody postbody news prose page container wrapper blog",
}
_TOKEN_KIND = {}
for _kind, _words in TOKENS.items():
    for _w in _words.split():
        _TOKEN_KIND.setdefault(_w, []).append(_kind)
KINDS = list(TOKENS)

#: Comments, other declarations, and tags.  As in browsers quotes count only where a value begins, so an unquoted one may hold them.
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)",
    re.DOTALL,
)
_ANY_ATTR = re.compile(r"([^\s>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: Attributes whose words tell what an element is for.
_TELLING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_HIDDEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


_TOP, _BODY, _HEAD_END = (re.compile(x, re.IGNORECASE) for x in (r"<html[\s>/]", r"<(?:body|frameset)[\s>/]", r"</head\s*>"))


def _complete(source: str) -> str:
    """With the html and body elements that a page has even if it does not say so."""
    if not _BODY.search(source):
        head = _HEAD_END.search(source)
        top = _MARKUP.match(source, m.start()) if not head and (m := _TOP.search(source)) else None
        at = head.end() if head else top.end() if top else 0
        source = f"{source[:at]}<body>{source[at:]}"
    return source if _TOP.search(source) else "<html>" + source


class Page:
    """The elements of a page in page order, and its runs of text with the element that owns each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.end = ["#root"], [-1], [""], [0]
        self.runs: list[tuple[int, str]] = []  # (element, text); text None where a block begins or ends
        self._parse(_complete(source))

    def _open(self, tag: str, attrs: str, stack: list[int]) -> int:
        i = len(self.tag)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.attrs.append(attrs)
        self.end.append(i + 1)
        return i

    def _close_to(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            self.end[i] = len(self.tag)
            if self.tag[i] in BLOCK:
                self.runs.append((stack[-1], None))

    def _parse(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        tag, runs = self.tag, self.runs
        while at < n:
            m = _MARKUP.search(source, at)
            text = source[at : m.start() if m else n]
            if text:
                runs.append((stack[-1], text))
            if not m:
                break
            at = m.end() if m.end() > m.start() else m.start() + 1
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:  # an end tag closes the nearest element of its name, if that is in reach
                for d in range(len(stack) - 1, 0, -1):
                    if tag[stack[d]] == name:
                        self._close_to(stack, d)
                        break
                    if name in INLINE_FORMAT and tag[stack[d]] in BLOCK:
                        break
                continue
            if name in CLOSES_P:
                for d in range(len(stack) - 1, 0, -1):
                    if tag[stack[d]] == "p":
                        self._close_to(stack, d)
                        break
                    if tag[stack[d]] in BLOCK:
                        break
            if name in SAME:
                for d in range(len(stack) - 1, 0, -1):
                    if tag[stack[d]] in SAME[name]:
                        self._close_to(stack, d)
                        if name not in ("tr", "tbody", "tfoot"):
                            break
                    if tag[stack[min(d, len(stack) - 1)]] in SCOPE[name]:
                        break
            i = self._open(name, m[3] or "", stack)
            if name in BLOCK:
                runs.append((stack[-1], None))
            elif name == "br":
                runs.append((stack[-1], " "))
            if name in VOID or (m[3] or "").endswith("/"):
                continue
            if name in RAW:
                close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = close.end() if close else n
                if name in BLOCK:
                    runs.append((stack[-1], None))
                self.end[i] = len(tag)
                continue
            stack.append(i)
        self._close_to(stack, 1)
        self.end[0] = len(tag)


def _tokens(tag: str, attrs: str) -> list[int]:
    out = [0] * len(KINDS)
    words = [tag]
    if attrs:
        for name, *values in _ANY_ATTR.findall(attrs):
            if name.lower() in _TELLING:
                words += _SPLIT.split("".join(values))
    for w in words:
        for kind in _TOKEN_KIND.get(w.lower(), ()):
            out[KINDS.index(kind)] = 1
    return out


_known_tokens: dict[tuple[str, str], list[int]] = {}


def _token_features(tag: str, attrs: str) -> list[int]:
    if len(attrs) > 200 or "href" in attrs[:8]:
        return _tokens(tag, attrs)
    got = _known_tokens.get((tag, attrs))
    if got is None:
        if len(_known_tokens) > 20_000:
            _known_tokens.clear()
        got = _known_tokens[tag, attrs] = _tokens(tag, attrs)
    return got


_TAGS = "article main section div p span a ul ol li table td aside header footer nav form h1 h2 h3 blockquote pre figure b".split()
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}


def features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each element; characters it owns itself; whether it may never be kept."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, punct, words = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, text in page.runs:
        if text and not text.isspace():
            own[i] += len(text)
            punct[i] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            words[i] += text.count(" ") + 1
    tag = page.tag
    is_a = np.array([t == "a" for t in tag], float)
    is_p = np.array([t in ("p", "br", "blockquote", "pre") for t in tag], float)
    control = np.array([t in ("input", "button", "select", "textarea", "label") for t in tag], float)
    end = np.array(page.end)

    def under(v):  # totals over each subtree, itself included: elements are in page order
        s = np.concatenate([[0], np.cumsum(v)])
        return s[end] - s[np.arange(n)]

    linked = np.zeros(n)
    depth, in_link = np.zeros(n), np.zeros(n)
    kinds = np.array([_token_features(t, a) for t, a in zip(tag, page.attrs, strict=True)], float)
    above = np.zeros_like(kinds)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        in_link[i] = in_link[p] or is_a[i]
        above[i] = np.maximum(above[p], kinds[p])
    linked = own * in_link
    text, links, tags, ps, puncts, wordsum, lt, ctl = (under(v) for v in (own, is_a, np.ones(n), is_p, punct, words, linked, control))
    safe = np.where(parent < 0, 0, parent)
    whole = max(1.0, text[0])
    children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(1)
    order, count = np.zeros(n), np.zeros(n, int)
    for i in range(1, n):
        order[i] = count[parent[i]]
        count[parent[i]] += 1
    same = np.zeros(n)
    seen: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        seen[parent[i], tag[i]] = seen.get((parent[i], tag[i]), 0) + 1
    for i in range(1, n):
        same[i] = seen[parent[i], tag[i]]
    before = np.concatenate([[0], np.cumsum(own)])[:-1]
    one = np.zeros((n, len(_TAGS)))
    for i, t in enumerate(tag):
        if t in _TAG_AT:
            one[i, _TAG_AT[t]] = 1
    columns = [
        np.log1p(text), np.log1p(own), text / whole, lt / np.maximum(text, 1), text / tags, np.log1p(tags), np.log1p(links), np.log1p(ps),
        ps / tags, puncts / np.maximum(wordsum, 1), wordsum / np.maximum(text, 1), np.log1p(ctl), depth, in_link, before / whole,
        order, children, same, order / np.maximum(1, children[safe]), text / np.maximum(1, text[safe]), text[safe] / whole, (lt / np.maximum(text, 1))[safe],
        np.log1p(own[safe]), np.log1p(ps[safe]),
    ]
    x = np.column_stack([*columns, kinds, above, one]).astype(np.float32)
    never = np.array([t in NEVER or hides(a) for t, a in zip(tag, page.attrs, strict=True)])
    # a form that holds most of a page wraps it
    never |= np.array([t == "form" for t in tag]) & (text < 0.5 * whole)
    return x, own, never


def hides(attrs: str) -> bool:
    """Whether attributes hide their element: hidden, aria-hidden="true", or a style that does."""
    low = attrs.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for name, *values in _ANY_ATTR.findall(low):
        value = "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def decode(page: Page, logits: np.ndarray, own: np.ndarray, never: np.ndarray) -> np.ndarray:
    """Which elements are kept: the best labelling in which a kept node's parent is kept."""
    n = len(logits)
    gain = np.clip(logits, -8, 8) * (own + np.where(own > 0, 8, 0.2))
    best = gain.copy()  # of the subtree if its top is kept
    for i in range(n - 1, 0, -1):
        if never[i]:
            best[i] = -np.inf
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and best[i] > 0
    return keep


def render(page: Page, keep: np.ndarray) -> str:
    """Text of the kept elements: blocks in page order, one a line."""
    blocks, now = [], []
    for i, text in page.runs:
        if text is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif keep[i]:
            now.append(text)
    if now:
        blocks.append("".join(now))
    out = (" ".join(html.unescape(b).split()) for b in blocks)  # white space of any kind
    return "\n".join(b for b in out if b)


# --- pages to fit on -------------------------------------------------------------------------


class _Generator:
    """Pages with a known article.  Elements of the article carry the attribute data-m."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = ["".join(p) for p in zip("bdfglmnprstkvz" * 5, "aeioueaioueoiau" * 4, strict=False)]
        self.vocabulary = ["".join(self.r.choice(syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3)))) for _ in range(600)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(lo, hi)))

    def prose(self, sentences: int) -> str:
        mark = self.r.choice((".", ".", ".", "!!", "", "%%% ."))
        out = []
        for _ in range(sentences):
            s = self.words(1, 22).capitalize()
            if self.r.random() < 0.3:
                s = s.replace(" ", ", ", 1)
            out.append(s + mark)
        return " ".join(out)

    def attrs(self, kind: str, honest: float) -> str:
        if self.r.random() > honest:
            return self.r.choice(("", f' class="{self.words(1, 1)}"', f' id="x{self.r.randint(1, 99)}"'))
        w = self.r.choice(TOKENS[kind].split())
        return self.r.choice((' class="{}"', ' id="{}"', ' class="{} box"', ' class="site-{}"', ' role="{}"')).format(w)

    def boilerplate(self, kind: str, honest: float) -> str:
        r, a = self.r, self.attrs
        links = lambda lo, hi: [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(r.randint(lo, hi))]
        if kind == "menu":
            t = r.choice(("nav", "nav", "div", "ul"))
            return f"<{t}{a(kind, honest)}>" + r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in links(3, 9)) + "</ul>", " | ".join(links(3, 8)))) + f"</{t}>"
        if kind == "header":
            t = r.choice(("header", "div"))
            return f"<{t}{a(kind, honest)}>" + r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", f"<p>{self.words(2, 8)}</p>")) + f"</{t}>"
        if kind == "footer":
            t = r.choice(("footer", "footer", "div"))
            return f"<{t}{a(kind, honest)}>" + r.choice((f"&copy; {self.words(1, 3)} &middot; {self.prose(1)}", f"<p>{self.prose(r.randint(1, 2))}</p>" + " ".join(links(0, 4)))) + f"</{t}>"
        if kind == "side":
            t = r.choice(("aside", "aside", "div"))
            body = r.choice((f"<h3>{self.words(1, 3)}</h3><ul>" + "".join(f"<li>{x}</li>" for x in links(2, 8)) + "</ul>", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(r.randint(1, 4))}</p>", "".join(f"<p>{self.prose(r.randint(1, 3))}</p>" for _ in range(r.randint(1, 4)))))
            return f"<{t}{a(kind, max(honest, 0.9) if t == 'div' else honest)}>{body}</{t}>"
        if kind in ("notice", "advert"):
            t = r.choice(("div", "div", "section", "aside", "p"))
            inner = self.prose(r.randint(1, 3))
            return f"<{t}{a(kind, 0.97)}>" + (inner if t == "p" else r.choice((inner, f"<p>{inner}</p>", f"{inner} <button>{self.words(1, 2)}</button>", f"<a href='/a'>{inner}</a>"))) + f"</{t}>"
        if kind == "form":
            return f"<form{a(kind, honest)}><label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button></form>"
        if kind == "comment":
            t = r.choice(("section", "div", "div", "ol"))
            items = "".join(r.choice(("<div{c}><p>{x}</p></div>", "<li{c}>{x}</li>", "<article{c}><b>{n}</b><p>{x}</p></article>", "<p{c}>{x}</p>")).format(c=a(kind, 0.7), n=self.words(1, 2), x=self.prose(r.randint(1, 5))) for _ in range(r.randint(1, 7)))
            return f"<{t}{a(kind, 0.97)}>" + r.choice(("", f"<h2>{self.words(1, 3)}</h2>")) + items + f"</{t}>"
        t = r.choice(("div", "ul", "p"))
        return f"<{t}{a(kind, 0.95)}>" + " ".join(links(2, 5)) + f"</{t}>"

    def paragraph(self) -> str:
        r, p = self.r, self.prose(self.r.choice((1, 1, 2, 3, 5, 9)))
        if r.random() < 0.15:
            p += f' <a data-m href="/x">{self.words(1, 3)}</a> {self.prose(1)}'
        if r.random() < 0.15:
            p = f"<b data-m>{self.words(1, 6)}</b> {p}"
        return r.choice(("<p data-m>{}</p>",) * 8 + ("<p data-m><b data-m>{}<br>", "<p data-m>{}", "<div data-m>{}</div>", "<blockquote data-m>{}</blockquote>", "<li data-m>{}</li>", "<pre data-m>{}</pre>")).format(p)

    def article(self, honest: float) -> str:
        r = self.r
        parts = [f"<h1 data-m>{self.words(1, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 9, 16))):
            u = r.random()
            if u < 0.08:
                parts.append(f"<h2 data-m>{self.words(1, 6)}</h2>")
            elif u < 0.13:
                parts.append("<ul data-m>" + "".join(f"<li data-m>{self.prose(1)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif u < 0.16:
                parts.append("<table data-m>" + "".join("<tr data-m>" + "".join(f"<td data-m>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif u < 0.23:
                parts.append(self.boilerplate(r.choice(("advert", "share", "notice", "side", "form")), honest))
            else:
                parts.append(self.paragraph())
        body = "".join(parts)
        if r.random() < 0.25:
            body = f"<div data-m{self.attrs('main', 0.5)}>{body}</div>"
        t = r.choice(("article", "article", "article", "main", "div", "section"))
        return f"<{t} data-m{self.attrs('main', honest if t == 'div' else 0.4)}>{body}</{t}>"

    def page(self) -> str:
        r = self.r
        honest = r.choice((0.2, 0.7, 1.0))
        some = lambda kinds, p: "".join(self.boilerplate(k, honest) for k in kinds if r.random() < p)
        top = some(("header", "menu", "advert", "notice", "form"), 0.45)
        article = self.article(honest)
        after = some(("share", "comment", "side", "advert", "menu", "notice", "form"), 0.3) + some(("footer",), 0.8)
        if r.random() < 0.4:
            article = f"<{(t := r.choice(('div', 'main', 'section')))} data-m{self.attrs('main', 0.5)}>" + some(("advert", "menu"), 0.2) + article + some(("side", "comment"), 0.3) + f"</{t}>"
        return f"<!DOCTYPE html><html data-m><head><title>{self.words(2, 9)}</title><script>var a;</script></head><body data-m>{top}{article}{after}</body></html>"


@lru_cache(maxsize=1)
def default_model(pages: int = TRAIN_PAGES, seed: int = SEED) -> gbt.Forest:
    xs, ys, ws = [], [], []
    make = _Generator(seed)
    for _ in range(pages):
        page = Page(make.page())
        mine = np.array([" data-m" in a for a in page.attrs])
        mine[0] = True
        page.attrs = [a.replace(" data-m", "") for a in page.attrs]
        x, own, never = features(page)
        use = ~never
        for i in range(1, len(never)):  # below what is never kept nothing is decided
            never[i] |= never[page.parent[i]]
            use[i] &= not never[i]
        xs.append(x[use])
        ys.append(mine[use])
        ws.append(1 + np.log1p(own[use]))
    x, y, w = np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws)
    return gbt.fit(x, y, w / w.mean())


def extract_all(sources: list[str], model: gbt.Forest) -> list[str]:
    pages = [Page(s) for s in sources]
    made = [features(p) for p in pages]
    if not made:
        return []
    logits = model.logits(np.concatenate([x for x, _, _ in made]))
    out, at = [], 0
    for page, (x, own, never) in zip(pages, made, strict=True):
        out.append(render(page, decode(page, logits[at : at + len(x)], own, never)))
        at += len(x)
    return out


def extract(source: str, model: gbt.Forest | None = None) -> str:
    return extract_all([source], model or default_model())[0]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null html is empty, and a page without an article has the text ''.  Pages are
    handled one by one, so ties, repeated rows and an empty table need nothing.
    """
    model = pages.sparkSession.sparkContext.broadcast(default_model())
    base = pages.select(
        pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("text")
    )

    def run(batches):
        for batch in batches:
            source, at = batch.column("text"), 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and len(part) < 256 and size < 4_000_000:
                    part.append(source[at + len(part)].as_py())
                    size += len(part[-1])
                texts = extract_all(part, model.value)
                rows = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at += len(part)

    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
