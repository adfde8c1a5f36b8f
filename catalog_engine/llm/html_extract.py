"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: text between block-level tags, with the tags and
class words of its ancestors. Each block has features of its ancestors and of its
text; a chain with two labels (main, other) scores them together with the label
before. Weights are trained by gradient ascent on the likelihood of labelled pages
(``labelled_pages``: pages of many layouts whose parts are marked where they are
written), and pages are decoded by Viterbi.

One scan of the pages, no shuffle. Defined results: null or empty HTML, or a page
without main blocks, gives an empty text; broken markup is read as far as it goes
(an unclosed comment or script runs to the end, an open head to the first tag or text that
belongs to the body); pages of any length are read
whole; repeated rows give the same text; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
CUE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LABEL = re.compile(r'data-main="([01])"')

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no markup: skipped to their end tag.
RAW = frozenset("script style title textarea xmp".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: Elements that may stand in a head; any other closes it.
IN_HEAD = RAW - {"xmp", "textarea"} | frozenset("base basefont bgsound head html link meta noframes noscript template".split())
#: Elements whose content is never shown as text.
HIDDEN = frozenset("head noscript template svg select iframe object canvas audio video math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PARTS = "nav header footer aside form menu button dialog figure figcaption table ul ol article main section blockquote pre h1 h2 h3 h4 h5 h6 p li td dd a".split()
#: Class words by the kind of page part that they name.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "top": "header masthead topbar banner hero logo",
    "bottom": "footer copyright legal colophon",
    "side": "sidebar side aside widget rail secondary complementary",
    "ad": "ad ads advert advertisement adsense sponsored sponsor promo promotion promoted",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup",
    "talk": "comment comments reply replies respond disqus discussion feedback review reviews",
    "share": "share sharing social follow",
    "more": "related recommended popular trending recent tags tag author bio meta byline",
    "form": "form search login register contact",
    "main": "article content post entry story body text main page document prose",
}
CUE_OF = {w: kind for kind, words in CUES.items() for w in words.split()}


class Block:
    __slots__ = ("text", "tag", "marks", "linked", "label")

    def __init__(self, text: str, tag: str, marks: frozenset, linked: int, label: int | None):
        self.text, self.tag, self.marks, self.linked, self.label = text, tag, marks, linked, label


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; text is decoded, with single spaces."""
    stack: list[tuple[str, frozenset, int | None]] = []
    out: list[Block] = []
    pieces: list[str] = []
    opened: Counter[str] = Counter()
    linked = links = hidden = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag = next((t for t, _, _ in reversed(stack) if t not in INLINE), "")
                marks = stack[-1][1] if stack else frozenset()
                out.append(Block(text, tag, marks, linked, stack[-1][2] if stack else None))
            pieces.clear()
        linked = 0

    def leave(k: int) -> None:
        nonlocal hidden, links
        for tag, _, _ in stack[k:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
            opened[tag] -= 1
        del stack[k:]

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            token = m[0]
            if stack and stack[-1][0] == "head" and not token.startswith(("<!", "<?")) and token.strip():
                leave(len(stack) - 1)
            if not hidden and not token.startswith(("<!", "<?")):
                text = html.unescape(token) if "&" in token else token
                pieces.append(text)
                if links:
                    linked += len(text.strip())
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if closing:
            if opened[tag]:  # else there is nothing to look for, however deep the page
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag == "body" or stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            k = next((i for i, (t, _, _) in enumerate(stack) if t == "head"), None)
            if k is not None:
                leave(k)
        if tag in RAW:
            # such content may hold anything that looks like markup
            if not (attrs or "").rstrip().endswith("/"):
                end = RAW_ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    leave(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        marks = stack[-1][1] if stack else frozenset()
        if tag in PARTS:
            marks = marks | {"in " + tag}
        label = stack[-1][2] if stack else None
        if attrs:
            words = {w for c in CUE.findall(attrs) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(c)).lower())}
            kinds = {"cue " + CUE_OF[w] for w in words if w in CUE_OF}
            if kinds:
                marks = marks | kinds
            if (d := LABEL.search(attrs)) is not None:
                label = int(d[1])
        stack.append((tag, marks, label))
        opened[tag] += 1
        hidden += tag in HIDDEN
        links += tag == "a"
    flush()
    return out


def features(b: Block) -> list[str]:
    """Names of the binary features of a block."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    share = min(1.0, b.linked / n)
    out = ["all", "tag " + (b.tag if b.tag in PARTS else "div" if b.tag in ("div", "section") else "other"), *b.marks]
    out.append("links none" if not share else "links some" if share < 0.5 else "links most")
    out.append("words 1" if words < 4 else "words 4" if words < 12 else "words 12" if words < 30 else "words 30")
    out.append("ends" if b.text[-1] in ".!?…:\"”»" else "open")
    if "©" in b.text or "(c)" in b.text.lower():
        out.append("copyright")
    if b.text.count("|") > 1 or b.text.count("·") > 1:
        out.append("bars")
    shell = bool(b.marks & {"in nav", "in footer", "in aside", "in form", "in menu", "in dialog", "in button", "cue menu", "cue bottom", "cue side", "cue ad", "cue notice", "cue talk", "cue share", "cue form"})
    body = bool(b.marks & {"in article", "in main", "cue main"})
    out.append(f"shell {shell} body {body}")
    if not shell:
        out.append(f"body {body} {out[3 + len(b.marks)]}")
    return out


class Chain:
    """A trained chain: weights of the label main by feature, transitions and start."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves.tolist(), start.tolist()

    def main(self, page: list[Block]) -> list[bool]:
        """Viterbi labels."""
        get, (a, b), (c, d) = self.weights.get, *self.moves
        back, s0, s1 = [], self.start[0], self.start[1]
        for i, block in enumerate(page):
            e = sum(get(f, 0.0) for f in features(block))
            if i:
                from0, from1 = s0 + a < s1 + c, s0 + b < s1 + d
                s0, s1 = max(s0 + a, s1 + c), max(s0 + b, s1 + d)
                back.append((from0, from1))
            s1 += e
        label = s1 > s0
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return [bool(x) for x in out[::-1]] if page else []


def train(pages: list[str], rounds: int = 250, rate: float = 0.15, shrink: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient ascent with adaptive steps; forward-backward over all pages at once."""
    cut = [[b for b in blocks(p) if b.label is not None] for p in pages]
    cut = [p for p in cut if p]
    names = sorted({f for p in cut for b in p for f in features(b)})
    index = {f: i for i, f in enumerate(names)}
    n, steps = len(cut), max(map(len, cut))
    x = np.zeros((n, steps, len(names)), np.float32)
    y, mask = np.zeros((n, steps), int), np.zeros((n, steps), bool)
    for i, p in enumerate(cut):
        for t, b in enumerate(p):
            x[i, t, [index[f] for f in features(b)]] = 1
            y[i, t], mask[i, t] = b.label, True
    size = len(names) + 6
    w, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    who = np.arange(n)
    for r in range(1, rounds + 1):
        moves, start = w[-6:-2].reshape(2, 2), w[-2:]
        e = np.zeros((n, steps, 2))
        e[:, :, 1] = x @ w[:-6]
        fore, rear = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        fore[:, 0] = start + e[:, 0]
        for t in range(1, steps):
            on = np.logaddexp.reduce(fore[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            fore[:, t] = np.where(mask[:, t, None], on, fore[:, t - 1])
        for t in range(steps - 2, -1, -1):
            on = np.logaddexp.reduce(moves + (e[:, t + 1] + rear[:, t + 1])[:, None, :], axis=2)
            rear[:, t] = np.where(mask[:, t + 1, None], on, 0)
        z = np.logaddexp.reduce(fore[:, -1], axis=1)
        p = np.exp(fore + rear - z[:, None, None])
        grad = np.zeros(size)
        grad[:-6] = np.einsum("nt,ntf->f", (y - p[:, :, 1]) * mask, x)
        pair = np.exp(fore[:, :-1, :, None] + moves + (e[:, 1:] + rear[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
        grad[-6:-2] = (seen - pair.sum(axis=(0, 1))).ravel()
        grad[-2:] = np.bincount(y[who, 0], minlength=2) - p[:, 0].sum(axis=0)
        grad = grad / n - shrink * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return Chain({f: float(v) for f, v in zip(names, w)}, w[-6:-2].reshape(2, 2), w[-2:])


def labelled_pages(n: int = 400, seed: int = 4) -> list[str]:
    """Pages of varied layout whose parts carry data-main="1" or "0"."""
    rng = random.Random(seed)
    syllables = "an de er in la on re st th ti ou ing ble men que ver che ar os".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int, hi: int) -> str:
        return words(lo, hi).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(k))

    def part(tag: str, cue: str, inner: str, main: int = 0) -> str:
        name = rng.choice(["class", "class", "id"])
        attr = f' {name}="{cue}"' if cue else ""
        return f'<{tag}{attr} data-main="{main}">{inner}</{tag}>'

    def maybe(p: float, make) -> str:
        return make() if rng.random() < p else ""

    def talk() -> str:
        posts = "".join(f'<div class="{rng.choice(["comment", "reply", "comment-body"])}"><p>{sentence(3, 30)}</p></div>' for _ in range(rng.randint(1, 4)))
        return part(rng.choice(["section", "div", "ol"]), rng.choice(["comments", "comment-list", "discussion", "reader-comments"]), f"<h3>{words(1, 3)}</h3>" + posts)

    def advert() -> str:
        return part(rng.choice(["div", "aside", "section"]), rng.choice(["ad", "ads", "advert", "ad-box", "sponsored", "promo"]), sentence(2, 15))

    def notice() -> str:
        return part("div", rng.choice(["cookie-notice", "notice", "consent", "popup", "newsletter"]), f"<p>{sentence(4, 20)}</p><button>{words(1, 2)}</button>")

    def form() -> str:
        return part("form", rng.choice(["", "search", "login-form"]), f"<label>{words(1, 2)}</label><input type='text'><button>{words(1, 1)}</button>")

    def side() -> str:
        return part(rng.choice(["aside", "div"]), rng.choice(["sidebar", "widget", "side", "related"]), f"<h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul>" + maybe(0.4, lambda: f"<p>{sentence(3, 15)}</p>"))

    out = []
    for _ in range(n):
        body = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            lo, hi = rng.choice([(1, 3), (4, 20), (20, 80)])
            inline = f"<b>{words(1, 3)}</b> " if rng.random() < 0.2 else ""
            link = f' <a href="/x">{words(1, 2)}</a>' if rng.random() < 0.1 else ""
            if kind < 0.75:
                body.append(f"<p>{inline}{sentence(lo, hi)}{link}</p>")
            elif kind < 0.82:
                h = rng.choice("23")
                body.append(f"<h{h}>{words(1, 6)}</h{h}>")
            elif kind < 0.88:
                body.append("<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.93:
                body.append(f"<blockquote>{sentence(5, 30)}</blockquote>")
            else:
                body.append(f"{sentence(lo, hi)}<br>{sentence(lo, hi)}")
        for make in (advert, talk, form, notice, side):
            if rng.random() < 0.15:
                body.insert(rng.randint(1, len(body)), make())
        tag, cue = rng.choice([("article", ""), ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article-body"), ("div", "post entry"), ("section", "story"), ("div", "main"), ("div", "")])
        article = part(tag, cue, "".join(body), 1)
        top = maybe(0.4, lambda: part("header", rng.choice(["", "header", "site-header"]), f"<h2>{words(1, 4)}</h2><p>{words(2, 8)}</p>"))
        menu = maybe(0.8, lambda: part(*rng.choice([("nav", ""), ("div", "menu"), ("nav", "navbar"), ("div", "navigation")]), f"<ul>{links(rng.randint(2, 8))}</ul>"))
        low = maybe(0.85, lambda: part(*rng.choice([("footer", ""), ("div", "footer"), ("footer", "site-footer")]), f"&copy; {words(1, 2)}.example &middot; {sentence(2, 14)}" + maybe(0.3, lambda: f"<ul>{links(3)}</ul>")))
        before, after = [advert, notice, form, side], [advert, talk, side, notice, form]
        page = top + menu + "".join(maybe(0.35, f) for f in before) + article + "".join(maybe(0.3, f) for f in after) + low
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>")
    return out


@lru_cache(maxsize=1)
def trained_chain() -> Chain:
    return train(labelled_pages())


def main_text(chain: Chain, page: str | None) -> str:
    found = blocks(page) if page else []
    return " ".join(b.text for b, main in zip(found, chain.main(found)) if main) if found else ""


def _texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(chain, p.as_py()) for p in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = df.sparkSession.sparkContext.broadcast(chain or trained_chain())
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInArrow(_texts(shared), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
