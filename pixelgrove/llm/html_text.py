"""Main text of web pages by a linear-chain CRF over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text between block-level tags. Each
block has indicator features of its ancestor tags, of words in the class, id
and role values of its ancestors, and of its text (length, share of link
text, ends, marks), and those of the blocks before and after it. Viterbi picks
the labels main or other of all blocks of a page together.

The model is trained on labelled pages, whose blocks carry their label: they
are made by rule (``labelled_pages``), ``sample_pages`` of them, so training
needs no data. Scripts, styles, templates, comments and markup never reach a
block. Extraction is one pass over all rows without a shuffle; the model that
is broadcast has some hundred weights.

Inside a block character references are decoded, white space becomes one space
and the ends are trimmed; blocks are joined in page order by a line break. A
line break tag counts as white space.

Cases: null or empty html, or a page without main blocks, gives an empty text;
broken or unclosed markup is read as it comes, to the end of the page; null
page_id and url are carried; repeated rows are extracted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE_PAGES, EPOCHS = 400, 4

# Tags of the HTML standard, by what they do to blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
#: Content that is no text of the page, up to its end tag.
RAW = frozenset("script style noscript template iframe svg math object textarea noframes".split())
#: Tags whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html head caption tbody td tfoot th thead tr col colgroup button label legend".split())
#: A start tag of the key ends an open tag of the value's names, up to the nearest list or table.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol menu dl table select".split())



def _attribute(group: str) -> str:
    """Pattern of an attribute by the rules of the standard: quotes count only as the first character of a value."""
    return rf"{group}=?[^\s/>=]+|=)(?:\s*=\s*(?:\"{group}[^\"]*)(?:\"|\Z)|'{group}[^']*)(?:'|\Z)|{group}[^\s>\"'][^\s>]*))?)?"


TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[\s/]+|{_attribute('(?:')})*+)(?:>|\Z)", re.S)
ATTRIBUTES = re.compile(_attribute("("), re.S)
#: Attributes whose words tell what a block is.
TELLING = frozenset("class id role itemprop aria-label".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
#: Signs of words in class, id and role values: group, words.
SIGNS = {
    "advert": "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion promoted dfp adslot outbrain taboola",
    "comment": "comment comments disqus reply replies respond reader feedback discussion thread",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs tab pager pagination toc sitemap skip",
    "edge": "header head masthead footer foot topbar bottombar toolbar branding logo",
    "side": "sidebar side aside rail widget widgets related recommended more popular trending complementary",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal dialog overlay paywall subscribe subscription newsletter signup login disclaimer copyright legal",
    "share": "share sharing social follow buttons tools meta byline author date tags tag",
    "form": "form search searchbox input contact",
    "main": "article articlebody content main body post entry story text prose page",
}
SIGN = {word: kind for kind, words in SIGNS.items() for word in words.split()}


class Block:
    __slots__ = ("path", "signs", "text", "linked")

    def __init__(self, path: tuple, signs: tuple, text: str, linked: int):
        self.path, self.signs, self.text, self.linked = path, signs, text, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order; those without text are left out."""
    found: list[Block] = []
    stack: list[tuple[str, tuple]] = []  # open block tags with the signs of their values
    links, parts, linked = 0, [], 0
    source, at = page or "", 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                found.append(Block(tuple(t for t, _ in stack), tuple(s for _, x in stack for s in x), text, linked))
            parts, linked = [], 0

    def pop(names: tuple, scope: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    while at < len(source):
        m = TOKEN.search(source, at)
        here = source[at : m.start()] if m else source[at:]
        if here:
            parts.append(here)
            linked += len(here) if links else 0
        if not m:
            break
        at, tag = m.end(), (m[1] or "").lower()
        if not tag:
            continue
        start = source[m.start() + 1] != "/"
        if start and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag == "a":
            links = max(0, links + 1 if start else links - 1)
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            close()
            links = 0
            if start:
                if tag in ENDS_P:
                    pop(("p",), frozenset())
                if tag in SIBLINGS:
                    pop(SIBLINGS[tag], SCOPES)
                if tag not in VOID:
                    words = [w.lower() for v in ATTRIBUTES.finditer(m[2]) if v[1].lower() in TELLING for w in PART.findall(v[2] or v[3] or v[4] or "")]
                    stack.append((tag, tuple(SIGN[w] for w in words if w in SIGN)))
            else:
                pop((tag,), frozenset())
    close()
    return found


def own_features(b: Block) -> list[str]:
    n, path = len(b.text), set(b.path)
    out = ["bias", f"tag={b.path[-1] if b.path else ''}", f"size={min(n.bit_length(), 11)}", f"links={min(4, 4 * b.linked // max(n, 1))}"]
    out += [f"in={t}" for t in path if t not in ("html", "body", "div", "section", "p")] or ["in=plain"]
    out += [f"sign={s}" for s in set(b.signs)]
    out.append("ends" if b.text[-1] in ".!?:;…\"”»)" else "open")
    if "©" in b.text or b.text[:9].lower() == "copyright":
        out.append("copyright")
    return out


def chain_features(page: list[Block]) -> list[list[str]]:
    own = [own_features(b) for b in page]
    around = [[f for f in x if f.partition("=")[0] in ("tag", "links", "sign", "in")] for x in own]
    return [x + [f"<{f}" for f in (around[i - 1] if i else ["none"])] + [f">{f}" for f in (around[i + 1] if i + 1 < len(own) else ["none"])] for i, x in enumerate(own)]


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best labels of a chain; emit is the score of main against other, trans [from, to]."""
    best, back = (0.0, float(emit[0])), []
    t = trans.tolist()
    for e in emit[1:].tolist():
        a = [best[i] + t[i][0] for i in (0, 1)]
        b = [best[i] + t[i][1] for i in (0, 1)]
        back.append((int(a[1] > a[0]), int(b[1] > b[0])))
        best = (max(a), max(b) + e)
    label = int(best[1] > best[0])
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def labels(page: list[Block], model: dict) -> list[int]:
    if not page:
        return []
    w = model["w"]
    return viterbi(np.array([sum(w.get(f, 0.0) for f in x) for x in chain_features(page)]), np.array(model["trans"]))


def main_text(page: str | None, model: dict) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, labels(found, model), strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS) -> dict:
    """Conditional likelihood by stochastic gradients over pages, with per-coordinate rates."""
    w, square, trans, tsquare = defaultdict(float), defaultdict(lambda: 1.0), np.zeros((2, 2)), np.ones((2, 2))
    data = [(chain_features(p), y) for p, y in pages if p]
    for _ in range(epochs):
        for x, y in data:
            emit = np.array([sum(w[f] for f in row) for row in x])
            p, pairs = _expected(emit, trans)
            seen = np.zeros((2, 2))
            for a, b in zip(y, y[1:], strict=False):
                seen[a, b] += 1
            for row, gap in zip(x, (np.array(y) - p).tolist(), strict=True):
                if abs(gap) > 1e-3:
                    for f in row:
                        square[f] += gap * gap
                        w[f] += 0.3 * gap / square[f] ** 0.5
            tsquare += (seen - pairs) ** 2
            trans += 0.3 * (seen - pairs) / np.sqrt(tsquare)
    return {"w": {f: v for f, v in w.items() if abs(v) > 1e-3}, "trans": trans.tolist()}


def _expected(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of main and expected transitions of one chain."""
    n = len(emit)
    score = np.stack([np.zeros(n), emit], 1)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    fwd[0] = score[0]
    for i in range(1, n):
        fwd[i] = score[i] + np.logaddexp.reduce(fwd[i - 1][:, None] + trans, 0)
    for i in range(n - 2, -1, -1):
        bwd[i] = np.logaddexp.reduce(trans + (score[i + 1] + bwd[i + 1])[None], 1)
    total = np.logaddexp.reduce(fwd[-1])
    pairs = np.zeros((2, 2))
    for i in range(1, n):
        pairs += np.exp(fwd[i - 1][:, None] + trans + (score[i] + bwd[i])[None] - total)
    return np.exp(fwd[:, 1] + bwd[:, 1] - total), pairs


def labelled_pages(n: int = SAMPLE_PAGES, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Made pages of several kinds with the label of each block; the same for the same arguments."""
    out = []
    for k in range(n):
        marked = _page(random.Random(seed * 1_000_003 + k))
        found = blocks(marked)
        out.append((found, [int(b.text.startswith("\ue000")) for b in found]))
        for b in found:
            b.text = b.text.replace("\ue000", "")
    return out


def _page(r: random.Random) -> str:
    """Html in which the main blocks begin with a private character."""

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice("aeiouäénrstlmdch") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))).capitalize()

    def prose(low: int, high: int) -> str:
        return " ".join(words(4, 14) + "." for _ in range(r.randint(low, high)))

    def items(k: int) -> str:
        return "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(k))

    def attr(*names: str) -> str:
        return f" {r.choice(('class', 'id'))}=\"{r.choice(names)}\"" if names else ""

    main = lambda tag, text, end=True: f"<{tag}>\ue000{text}" + (f"</{tag}>" if end else "")
    ad = lambda t=r.choice(("div", "aside", "section")): f"<{t}{attr('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo box')}>{prose(1, 3) if r.random() < 0.7 else words(2, 8)}</{t}>"
    notice = lambda t=r.choice(("div", "section", "aside", "p")): f"<{t}{attr('cookie-notice', 'consent', 'notice', 'alert', 'newsletter', 'subscribe', 'disclaimer', 'popup')}>{prose(1, 2)}</{t}>"
    form = lambda: f"<form{attr('search', 'login', 'contact-form')}><label>{words(1, 3)}</label><input name='q'><button>{words(1, 2)}</button></form>"
    side = lambda t=r.choice(("aside", "div")): f"<{t}{attr('sidebar', 'widget', 'related', 'right-rail')}><h3>{words(1, 4)}</h3><ul>{items(r.randint(2, 5))}</ul>{('<p>' + prose(1, 2) + '</p>') if r.random() < 0.5 else ''}</{t}>"
    comments = lambda t=r.choice(("section", "div", "ul")): f"<{t}{attr('comments', 'comment-list', 'disqus-thread', 'responses reply')}><h3>{words(1, 3)}</h3>" + "".join(f"<div class='comment'><b>{words(1, 2)}</b><p>{prose(1, 4)}</p></div>" for _ in range(r.randint(1, 4))) + f"</{t}>"
    body = []
    if r.random() < 0.5:
        body.append(f"<header{attr('site-header', 'masthead', 'top')}><p>{words(1, 5)}</p></header>" if r.random() < 0.6 else f"<div{attr('header', 'masthead', 'branding')}>{words(1, 6)}</div>")
    if r.random() < 0.9:
        body.append(f"<nav><ul>{items(r.randint(2, 8))}</ul></nav>" if r.random() < 0.7 else f"<div{attr('menu', 'navbar', 'breadcrumbs')}><ul>{items(r.randint(2, 8))}</ul></div>")
    extras = [ad, notice, form, side]
    body += [r.choice(extras)() for _ in range(r.randint(0, 3))]
    inside = []
    if r.random() < 0.8:
        inside.append(main(r.choice(("h1", "h1", "h2")), words(3, 12) + r.choice(("", "", "."))))
    for _ in range(r.randint(1, 12)):
        kind = r.random()
        if kind < 0.68:
            text = prose(1, 6) if r.random() < 0.85 else words(1, 4) + r.choice((".", ""))
            if r.random() < 0.15:
                text = f"{text} <a href='#'>{words(1, 4)}</a> {words(1, 5)}."
            if r.random() < 0.15:
                text = f"<b>{text}<br>"
            inside.append(main("p", text, r.random() < 0.8))
        elif kind < 0.75:
            inside.append(main(r.choice(("h2", "h3")), words(2, 6)))
        elif kind < 0.81:
            inside.append("<ul>" + "".join(main("li", words(2, 12)) for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.85:
            inside.append(main(r.choice(("blockquote", "pre", "figcaption", "td", "dd")), prose(1, 3)))
        elif kind < 0.88:
            inside.append(main("div", prose(1, 4)))
        else:
            inside.append(r.choice((ad, notice, form, side))())
    if r.random() < 0.25:
        inside.append(comments())
    holder = r.choice(("article", "article", "article", "main", "div-content"))
    body.append(f"<div{attr('content', 'post', 'article-body', 'entry', 'story')}>{''.join(inside)}</div>" if holder == "div-content" else f"<{holder}>{''.join(inside)}</{holder}>")
    if r.random() < 0.3:
        body.append(comments())
    body += [r.choice(extras)() for _ in range(r.randint(0, 2))]
    if r.random() < 0.9:
        mark = f"&copy; {r.randint(1995, 2030)} {words(1, 3)}" if r.random() < 0.6 else prose(1, 2)
        body.append(f"<footer>{mark} &middot; {prose(1, 2)}</footer>" if r.random() < 0.7 else f"<div{attr('footer', 'legal', 'copyright')}><p>{mark}</p></div>")
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{''.join(body)}</body></html>"


def extract(pages: DataFrame, model: dict | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The rows with html replaced by the main text (and so is a column of its name); without a model, one is trained on the made pages."""
    held = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))
    keep = [c for c in pages.columns if c not in (html_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), held.value) for page in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, out_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep] + [f"`{out_col}` string"])
    return pages.mapInArrow(run, schema)
