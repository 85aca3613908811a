"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with the path of open
elements. Each block is a vector of its hashed path (tags, classes, ids), its hashed words and
figures of its place in the page: how much of the page's text its container and the containers
around it hold, their links, how it stands to the first heading and the longest block, how many
containers look alike. A bidirectional LSTM reads the page's whole sequence and says of each block
whether it belongs to the article. The kept blocks are the text.

The network is trained here, on at most TRAIN_PAGES pages (the least by a hash of page_id). Labels
come from the meaning of semantic tags and class names, where a page has them; the network sees
each page mostly in variants in which these names are dropped or replaced by meaningless ones, the
article stands in other wrappers, and comments, menus, notices, forms and the like are put in,
so that it must learn from the page's structure. Every page is then labelled from its whole html,
unshuffled.

Edge cases: null, empty and text-free html gives an empty text; unclosed and stray tags and quotes
are tolerated, in time linear in the page's length; a page of any length is one sequence; repeated
pages give equal texts; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import buffer_of, span_hashes, words

TRAIN_PAGES = 150
PATH_DIMS, WORD_DIMS, FIGURES = 64, 16, 20
HIDDEN = 16
SEED = 5

# A tag without < or > in its attributes' values; no part gives back what it took, so a failure is quick.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^'\"<>]++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile(r"['\">]")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea")}
_TITLE_END = re.compile(r"</title\s*>|<body\b|</head\b|<svg\b|<title\b", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACES = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of these closes an open one of the same group.
_CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements whose text is no part of the page; unclosed ones end with their parent.
_HIDDEN = frozenset("noscript template svg select".split())
#: What may stand in a head; anything else, or text, ends it, as browsers do.
_HEAD = frozenset("html head title base basefont bgsound link meta noscript noframes script style template".split())
#: Elements that end an unclosed svg or select, and elements of svg that hold HTML.
_ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_ENDS_SELECT = frozenset("select input table tbody thead tfoot caption tr td th".split())
_HOLDS_HTML = frozenset("foreignobject desc title".split())


class _Closing:
    """Finds the > that ends a tag, outside quotes. A quote that an earlier tag opened in vain is not followed again."""

    def __init__(self, page: str):
        self.page, self.last, self.vain = page, page.rfind(">"), set()
        self.seen = (0, -1)  # from the first place on, the next special character is at the second

    def _next(self, at: int) -> int:
        begin, hit = self.seen
        if not begin <= at <= hit:
            m = _SPECIAL.search(self.page, at)
            hit = m.start() if m else len(self.page)
            self.seen = (at, hit)
        return hit

    def find(self, at: int) -> int:
        opened = []
        while at <= self.last:
            at = self._next(at)
            if at >= len(self.page) or at in self.vain:
                break
            if self.page[at] == ">":
                return at
            opened.append(at)
            at = self.page.find(self.page[at], at + 1)
            if at < 0:
                break
            at += 1
        self.vain.update(opened)
        return -1


def tokens(page: str) -> Iterator[tuple[str | None, str, str, str]]:
    """(text, '', '', '') and (None, '/' or '', tag, attributes) in page order; comments, scripts, styles and titles are left out."""
    at, size, closing, cdata = 0, len(page), _Closing(page), True
    while at < size:
        i = page.find("<", at)
        if i < 0:
            i = size
        if i > at:
            yield page[at:i], "", "", ""
        if i == size:
            return
        m = _TAG.match(page, i)
        if m is None and page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else size
            continue
        if m is None and page[i + 1 : i + 2] in ("!", "?"):
            end = -1
            if cdata and page[i : i + 9].upper() == "<![CDATA[":
                end = page.find("]]>", i)
                cdata, end = end >= 0, end + 2 if end >= 0 else -1
            if end < 0 and i < closing.last:
                end = page.find(">", i)
            if end >= 0:
                at = end + 1
                continue
        if m is None and (name := _NAME.match(page, i)) and (end := closing.find(name.end())) >= 0:
            close, tag, attributes, after = *name.groups(), page[name.end() : end], end + 1
        elif m is not None:
            (close, tag, attributes), after = m.groups(), m.end()
        else:
            yield "<", "", "", ""
            at = i + 1
            continue
        tag, at = tag.lower(), after
        if not close and tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if not close and tag == "title" and (end := _TITLE_END.search(page, at)) and end.group()[:3].lower() == "</t":
            at = end.end()
            continue
        yield None, close, tag, attributes


#: Elements opened deeper than this count as their parent, as in browsers.
MAX_DEPTH = 100

#: An open element: its number in the page, and its names: the tag, then .class and .id parts.
Element = tuple[int, tuple[str, ...]]


@dataclass
class Block:
    text: str
    elements: tuple[Element, ...]
    link: float = 0.0

    @property
    def path(self) -> tuple[str, ...]:
        return tuple(x for _, names in self.elements for x in names)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order; script, style, svg and the like have none, nor has head."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    count = 0
    text: list[str] = []
    linked = total = 0
    hidden: int | None = None  # place of the outermost hidden element
    maybe_head = False  # whether the stack may hold a head or title

    def shut(k: int) -> None:
        nonlocal hidden
        del stack[k:]
        if hidden is not None and hidden >= k:
            hidden = None

    def push(tag: str, names: tuple[str, ...]) -> None:
        if len(stack) < MAX_DEPTH:
            stack.append((tag, names, count))

    def place(tags: tuple[str, ...]) -> int | None:
        return next((k for k, (t, _, _) in enumerate(stack) if t in tags), None)

    def flush() -> None:
        nonlocal linked, total
        body = _SPACES.sub(" ", html.unescape("".join(text))).strip()
        if body and not any(t == "title" for t, _, _ in stack[:hidden]):
            if maybe_head and (k := place(("head",))) is not None:
                stack.pop(k)
            out.append(Block(body, tuple((n, names) for _, names, n in stack if names), linked / max(total, 1)))
        text.clear()
        linked = total = 0

    for chars, close, tag, attributes in tokens(page):
        count += 1
        if chars is not None:
            if hidden is not None:
                continue
            text.append(chars)
            total += len(chars)
            if any(t == "a" for t, _, _ in stack):
                linked += len(chars)
            continue
        if hidden is not None:
            inner = [t for t, _, _ in stack[hidden:]]
            if close:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if k is None or k >= hidden:
                    if k is not None:
                        shut(k)
                    continue
                shut(hidden)  # the parent ends
            elif tag == "body" and place(("head",)) is not None:
                shut(hidden)
            elif inner[0] == "svg" and tag in _ENDS_SVG and not _HOLDS_HTML & set(inner):
                shut(hidden)
            elif inner[0] == "select" and tag in _ENDS_SELECT:
                shut(hidden)
                if tag == "select":
                    continue
            else:
                if tag not in _VOID and (tag not in _INLINE or tag == "a") and not attributes.rstrip().endswith("/"):
                    push(tag, ())
                continue
        if maybe_head and not close and tag not in _HEAD:
            if place(("title",)) is not None:
                text.clear()
                linked = total = 0
            if (k := place(("head", "title"))) is not None:
                shut(k)
            maybe_head = False
        if tag in _HIDDEN and not close:
            if not (tag == "svg" and attributes.rstrip().endswith("/")):
                hidden = len(stack)
                stack.append((tag, (), count))
            continue
        if tag in _INLINE:
            if tag in ("br", "img"):
                text.append(" ")
            elif tag == "a":
                if close:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "a":
                            del stack[k]
                            break
                else:
                    push("a", ())
            continue
        flush()
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in _ENDS_P or tag in _CLOSES:
            ends = (_CLOSES.get(tag, "") + (" p" if tag in _ENDS_P else "")).split()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in ("table", "ul", "ol", "dl", "div", "article", "section", "body"):
                    break
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            names = [tag]
            for a, b, c in _NAMES.findall(attributes):
                names += [f".{x}" for x in re.split(r"[\s_-]+", (a or b or c).lower()) if x]
            push(tag, tuple(names))
            maybe_head |= tag in ("head", "title")
    flush()
    return out


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashing of the path's names; the innermost tag counts once more."""
    v = _PATHS.get(path)
    if v is None:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        v = np.zeros(PATH_DIMS, np.float32)
        for name in (*dict.fromkeys(path), f"in:{path[-1]}" if path else "in:"):
            h = xxhash.xxh32_intdigest(name)
            for k in range(3):  # three places a name, so that two names rarely share all
                v[(h >> (8 * k)) % PATH_DIMS] += 1.0 if h >> (28 + k) & 1 else -1.0
        _PATHS[path] = v
    return v


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: path, words, figures."""
    out = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + FIGURES), np.float32)
    if not blocks:
        return out
    buf, at = buffer_of(pa.array([b.text for b in blocks], pa.large_string()))
    starts, ends, w = words(buf, at)
    h = span_hashes(buf, starts, ends)
    doc, n = np.repeat(np.arange(len(blocks)), np.diff(w)), np.maximum(np.diff(w), 1)
    slot = doc * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)
    bag = np.bincount(slot, weights=sign, minlength=len(blocks) * WORD_DIMS).reshape(len(blocks), -1)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = bag / np.maximum(np.linalg.norm(bag, axis=1), 1)[:, None]
    for k, b in enumerate(blocks):
        out[k, :PATH_DIMS] = _path_vector(b.path)
    dots = np.add.reduceat(np.append(np.isin(buf, np.frombuffer(b".!?", np.uint8)), False).astype(np.int64), at[:-1])
    figures = out[:, PATH_DIMS + WORD_DIMS :]
    figures[:, 0] = np.minimum(np.log1p(n) / 4, 1.5)
    figures[:, 1] = [b.link for b in blocks]
    figures[:, 2] = np.minimum(dots, 10) / 5
    figures[:, 3] = [len(b.elements) / 8 for b in blocks]
    figures[:, 4] = n <= 3
    figures[:, 5] = 1
    return out


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a block's text and no other blocks; the container is around them.
_LEAVES = _HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption caption summary label legend option a span".split())
_ROOTS = frozenset("html body".split())


def page_vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block of one page: vectors, and the figures that need the whole page."""
    return place(blocks, vectors(blocks))


def place(blocks: list[Block], out: np.ndarray) -> np.ndarray:
    """Fills in the figures of each block's place among all blocks of its page."""
    if not blocks:
        return out
    words_of = [len(b.text.split()) for b in blocks]
    mass: dict[int, float] = {}  # words outside links in an element
    every: dict[int, float] = {}
    many: dict[int, int] = {}
    shapes: dict[tuple, set[int]] = {}
    homes = []
    for b, n in zip(blocks, words_of, strict=True):
        for e, _ in b.elements:
            mass[e] = mass.get(e, 0.0) + n * (1 - b.link)
            every[e] = every.get(e, 0.0) + n
            many[e] = many.get(e, 0) + 1
        inner = list(b.elements)
        while len(inner) > 1 and inner[-1][1][0] in _LEAVES:
            inner.pop()
        homes.append([e for e in inner if e[1][0] not in _ROOTS] or inner[:1])
        if homes[-1]:
            shapes.setdefault(tuple(names[0] for _, names in inner), set()).add(inner[-1][0])
    total, all_words = max(sum(n * (1 - b.link) for b, n in zip(blocks, words_of, strict=True)), 1.0), max(sum(words_of), 1)
    level = next((t for t in ("h1", "h2", "h3") if any(b.elements and b.elements[-1][1][0] == t and b.link < 0.5 for b in blocks)), None)
    first = next((k for k, b in enumerate(blocks) if b.elements and b.elements[-1][1][0] == level), None)
    longest = max(range(len(blocks)), key=lambda k: words_of[k] * (1 - blocks[k].link))
    around = lambda k: {e for e, names in blocks[k].elements if names[0] not in _ROOTS and names[0] not in _LEAVES}
    by_head, by_long = around(first) if first is not None else set(), around(longest)
    best = max((mass[h[-1][0]] for h in homes if h), default=1.0) or 1.0
    texts: dict[str, int] = {}
    for b in blocks:
        texts[b.text] = texts.get(b.text, 0) + 1
    figures = out[:, PATH_DIMS + WORD_DIMS :]
    for k, (b, home) in enumerate(zip(blocks, homes, strict=True)):
        own = [e for e, _ in home]
        inner, outer = (own[-1], own[0]) if own else (None, None)
        tag = b.elements[-1][1][0] if b.elements else ""
        shape = tuple(names[0] for _, names in b.elements[: len(b.elements) - next((j for j, (_, x) in enumerate(b.elements[::-1]) if x[0] not in _LEAVES), 0)])
        rooted = bool(home) and home[-1][1][0] in _ROOTS
        figures[k, 6:] = [
            mass.get(inner, 0.0) / total,
            mass.get(outer, 0.0) / total,
            mass.get(inner, 0.0) / best,
            1 - mass.get(inner, 0.0) / max(every.get(inner, 1.0), 1.0),
            k / len(blocks),
            tag in _HEADINGS,
            first is not None and k < first,
            bool(by_head & set(own)) if by_head else first is not None and rooted,
            bool(by_long & set(own)) if by_long else rooted,
            min(texts[b.text] - 1, 3) / 3,
            min(len(shapes.get(shape, ())), 10) / 10,
            min(every.get(inner, 0.0) / max(many.get(inner, 1), 1) / 40, 2.0),
            words_of[k] / all_words,
            rooted,
        ]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, live: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (time x pages x HIDDEN) of one direction; where live is 0 the state stays."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    c, out = h.copy(), np.empty((*x.shape[:2], HIDDEN), np.float32)
    pre = x @ wx + b
    for t in range(len(x)):
        z = pre[t] + h @ wh
        gates, g, m = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :]), live[t][:, None]
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        new = f * c + i * g
        squashed = np.tanh(new)
        if trace is not None:
            trace.append((h, c, i, f, o, g, squashed, m))
        h, c = np.where(m > 0, o * squashed, h), np.where(m > 0, new, c)
        out[t] = h
    return out


def _back(x: np.ndarray, d_out: np.ndarray, wh: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the input weights, the recurrent weights and the bias."""
    d_wx, d_wh, d_b = 0, 0, 0
    d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, squashed, m = trace[t]
        d_all = d_h + d_out[t]
        live = d_all * m
        d_new = (d_c + live * o * (1 - squashed**2)) * m
        d_z = np.hstack([d_new * g * i * (1 - i), d_new * c * f * (1 - f), live * squashed * o * (1 - o), d_new * i * (1 - g**2)])
        d_wx, d_wh, d_b = d_wx + x[t].T @ d_z, d_wh + h.T @ d_z, d_b + d_z.sum(0)
        d_h, d_c = d_z @ wh.T + d_all * (1 - m), d_new * f + d_c * (1 - m)
    return d_wx, d_wh, d_b


@dataclass
class Labeller:
    """Weights of the two directions and of the output; all of fixed size."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls) -> Labeller:
        rng, d = np.random.default_rng(SEED), PATH_DIMS + WORD_DIMS + FIGURES
        p = {"v": rng.normal(0, 0.3, (2 * HIDDEN + d, 1)), "c": np.zeros(1)}
        for side in "fb":
            p |= {f"{side}x": rng.normal(0, d**-0.5, (d, 4 * HIDDEN)), f"{side}h": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"{side}b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def logits(self, x: np.ndarray, live: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        ahead = _run(x, live, p["fx"], p["fh"], p["fb"], traces and traces[0])
        behind = _run(x[::-1], live[::-1], p["bx"], p["bh"], p["bb"], traces and traces[1])[::-1]
        seen = np.concatenate([ahead, behind, x], axis=2)
        return (seen @ p["v"])[:, :, 0] + p["c"], seen

    def label(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Probability of each block of each page; pages of similar length run side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
        while order:
            n = max(1, cells // len(pages[order[-1]]))
            group, order = order[-n:], order[:-n]
            x, live = _stack([pages[k] for k in group])
            z, _ = self.logits(x, live)
            for col, k in enumerate(group):
                out[k] = _sigmoid(z[: len(pages[k]), col])
        return out


def _stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x, live = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], live[: len(p), k] = p, 1
    return x, live


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 18, batch: int = 32, rate: float = 0.01, falling: bool = False) -> Labeller:
    """Adam on the mean cross-entropy of (vectors, labels) pages. falling: the rate falls to nothing, so that the last batches don't sway the net."""
    net, rng = Labeller.fresh(), np.random.default_rng(SEED)
    pages = [p for p in pages if len(p[0])]
    first, second, step = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    steps = max(1, epochs * -(-len(pages) // batch))
    for _ in range(epochs if pages else 0):
        order = rng.permutation(len(pages))
        for lo in range(0, len(order), batch):
            group = [pages[k] for k in order[lo : lo + batch]]
            x, live = _stack([v for v, _ in group])
            y = np.zeros(live.shape, np.float32)
            for k, (_, own) in enumerate(group):
                y[: len(own), k] = own
            traces: tuple[list, list] = ([], [])
            z, seen = net.logits(x, live, traces)
            d_z = ((_sigmoid(z) - y) * live / live.sum())[:, :, None]
            d_seen = d_z @ net.p["v"].T
            grads = {"v": np.einsum("tbi,tbj->ij", seen, d_z), "c": d_z.sum((0, 1))}
            grads["fx"], grads["fh"], grads["fb"] = _back(x, d_seen[:, :, :HIDDEN], net.p["fh"], traces[0])
            grads["bx"], grads["bh"], grads["bb"] = _back(x[::-1], d_seen[::-1, :, HIDDEN : 2 * HIDDEN], net.p["bh"], traces[1])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - rate * (1 - falling * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


_OUTSIDE = frozenset(
    "nav header footer aside form dialog menu .nav .navbar .navigation .menu .header .masthead .footer .sidebar .side .aside .widget .ad .ads .advert .advertisement .sponsor .sponsored .promo .banner .notice .cookie .cookies .consent .alert .popup .modal .newsletter .subscribe .signup .login .search .form .share .social .related .recommended .more .comment .comments .reply .replies .discussion .disqus .respond .breadcrumb .breadcrumbs .pagination .pager .tags .copyright .legal .complementary .contentinfo".split()
)
_INSIDE = frozenset("article main .article .content .post .entry .story .main .body".split())


def teach(blocks: list[Block]) -> np.ndarray:
    """Labels by the meaning of tags and class names: the innermost name that says something decides, a name of what is outside first."""
    marked = any(_INSIDE & set(b.path) for b in blocks)
    y = np.zeros(len(blocks), np.float32)
    for k, b in enumerate(blocks):
        inner = [n for n in b.path if n in _OUTSIDE]
        if inner and not (inner == ["header"] and _INSIDE & set(b.path[: b.path.index("header")])):
            continue
        y[k] = bool(_INSIDE & set(b.path)) if marked else b.link < 0.5 and len(b.text.split()) > 3
    return y


#: Known names of articles' wrappers and of frames of other matter.
_WRAPPERS = ("article", "main", "div .content", "div .post", "section .article .body", "div .main .content", "div .entry .content", "div .story")
_FRAMES = {
    "links": ("nav", "div .menu", "ul .breadcrumbs", "div .related", "div .share", "aside", "div .tags"),
    "notice": ("div .ad", "div .notice", "div .cookie .notice", "div .banner", "header", "div .promo", "div .advert"),
    "comments": ("div .comments", "section .comments", "ol .comment .list", "div .discussion", "div .replies"),
    "side": ("aside .sidebar", "aside", "div .sidebar", "div .widget"),
    "form": ("form", "form .subscribe", "div .newsletter", "div .login"),
    "footer": ("footer", "div .footer", "div .copyright"),
}


class _Scene:
    """Draws variants of a labelled page."""

    def __init__(self, rng: np.random.Generator, texts: list[str], rich: bool = False):
        self.rng, self.texts, self.number, self.adds = rng, texts, 0, rich
        self.long = [t for t in texts if len(t.split()) >= 20] or texts

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, some):
        return some[int(self.rng.integers(len(some)))]

    def element(self, names: str | tuple[str, ...]) -> Element:
        self.number += 1
        return self.number, tuple(names.split()) if isinstance(names, str) else names

    def nameless(self, tags: tuple[str, ...] = ("div", "section", "td", "div")) -> tuple[str, ...]:
        """A tag, mostly with meaningless class names."""
        noise = ["." + "".join(self.pick("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(self.rng.integers(1, 7))) for _ in range(self.rng.integers(0, 4))]
        return (self.pick(tags), *noise)

    def words(self, least: int, most: int) -> str:
        """A run of words of some block, of a long one if many may be wanted."""
        w, n = self.pick(self.long if most > 8 else self.texts).split(), int(self.rng.integers(least, most + 1))
        at = int(self.rng.integers(max(len(w) - n, 0) + 1))
        return " ".join(w[at : at + n]) or "x"

    def frame(self, kind: str, under: tuple[Element, ...], known: bool) -> list[Block]:
        """Blocks of other matter in an element of their own."""
        tags = {"links": ("div", "ul"), "comments": ("div", "section", "ol", "ul"), "form": ("form", "div")}.get(kind, ("div", "section", "div"))
        top = (*under, self.element(self.pick(_FRAMES[kind]) if known else self.nameless(tags)))
        out: list[Block] = []
        add = lambda text, *inner, link=0.0: out.append(Block(text, (*top, *inner), link))
        if kind == "links":
            rows, link = self.element("ul"), float(not (self.adds and known and self.chance(0.3)))
            for _ in range(self.rng.integers(2, 9)):
                add(self.words(1, 5), rows, self.element("li"), link=link)
        elif kind == "notice":
            for _ in range(self.rng.integers(1, 3)):
                if self.chance(0.5):
                    add(self.words(2, 25), link=float(self.pick([0.0, 0.0, 0.5])))
                else:
                    add(self.words(2, 25), self.element("p"))
        elif kind == "comments":
            if self.chance(0.5):
                add(self.words(1, 3), self.element(self.pick(["h2", "h3", "h4"])))
            plain, signed = self.chance(0.5), self.chance(0.6)
            for _ in range(self.rng.integers(1, 8)):
                item = () if plain else (self.element(self.pick(["div", "li", "article", "div"]) if not known else self.pick(["div .comment", "li .comment"])),)
                if signed and not plain:
                    add(self.words(1, 3), *item, self.element(self.pick(["div", "p", "h4", "span"])), link=float(self.pick([0.0, 1.0])))
                add(self.words(3, self.pick([20, 70, 200])), *item, self.element("p"))
        elif kind == "side":
            if self.chance(0.7):
                add(self.words(1, 4), self.element(self.pick(["h2", "h3", "h4"])))
            for _ in range(self.rng.integers(1, 5)):
                add(self.words(2, 25), self.element(self.pick(["p", "li", "div"])), link=float(self.pick([0.0, 0.0, 1.0])))
        elif kind == "form":
            for _ in range(self.rng.integers(1, 4)):
                add(self.words(1, 8), self.element(self.pick(["label", "p", "div", "button"])))
        else:
            for _ in range(self.rng.integers(1, 3)):
                add(self.words(2, 20), self.element(self.pick(["p", "div"])), link=float(self.pick([0.0, 0.3, 1.0])))
        return out

    def rich(self, under: tuple[Element, ...]) -> list[Block]:
        """What an article has beside paragraphs: a list, a table, a headed part, a quotation, figures, definitions."""
        out: list[Block] = []
        add = lambda text, *inner: out.append(Block(text, (*under, *inner), float(self.pick([0.0] * 9 + [0.3]))))
        el, kind = self.element, self.pick(["list", "list", "list", "list", "table", "head", "head", "quote", "figure", "terms"])
        if kind == "list":
            if self.chance(0.4):
                add(self.words(3, 20), el("p"))
            rows, most, inner = el(self.pick(["ul", "ol"])), self.pick([2, 6, 20, 40]), self.chance(0.15)
            for _ in range(self.rng.integers(1, 9)):
                add(self.words(1, most), rows, el("li"), *([el("p")] if inner else []))
        elif kind == "table":
            top = [el("table"), *([el("tbody")] if self.chance(0.5) else [])]
            wide, most = int(self.rng.integers(1, 5)), self.pick([1, 3, 10])
            for k in range(self.rng.integers(1, 7)):
                row = el("tr")
                for _ in range(wide):
                    add(self.words(1, most), *top, row, el("th" if k == 0 and wide > 1 else "td"))
        elif kind == "head":
            add(self.words(1, 8), el(self.pick(["h2", "h2", "h3", "h4"])))
            if self.chance(0.8):
                add(self.words(3, 60), el(self.pick(["p", "p", "div"])))
        elif kind == "quote":
            add(self.words(3, 40), el(self.pick(["blockquote", "pre"])), *([el("p")] if self.chance(0.3) else []))
        elif kind == "figure":
            add(self.words(1, 15), el("figure"), el("figcaption"))
        else:
            top = el("dl")
            for _ in range(self.rng.integers(1, 4)):
                add(self.words(1, 6), top, el("dt"))
                add(self.words(1, 25), top, el("dd"))
        return out

    def draw(self, blocks: list[Block], labels: np.ndarray) -> tuple[list[Block], np.ndarray]:
        """The page's article in another wrapper, its other blocks under other names, and more of them."""
        body = (self.element("html"), self.element("body"))
        out: list[tuple[Block, int]] = []
        inside = np.flatnonzero(labels)
        if self.chance(0.3):
            body += (self.element(self.nameless()),)
        wrap = body
        if self.chance(0.9):
            for _ in range(self.rng.integers(1, 4)):
                wrap += (self.element(self.nameless()),)
            if self.chance(0.3):
                wrap = (*wrap[:-1], self.element(self.pick(_WRAPPERS)))
        if self.chance(0.3) and len(inside) > 2:  # a short article
            inside = inside[: int(self.rng.integers(2, len(inside) + 1))]
        before, after = [], []
        for kind in ("links", "notice", "form", "side", "footer"):
            if self.chance(0.35):
                self.pick([before, after]).append(self.frame(kind, body, self.chance(0.35)))
        if self.chance(0.75 if self.adds else 0.6):
            after.append(self.frame("comments", body, self.chance(0.2 if self.adds else 0.25)))
        # The page's own other blocks keep their elements, or lose their names.
        keep = self.chance(0.4)
        new: dict[int, Element] = {}
        rest: tuple[list, list] = ([], [])
        for k, b in enumerate(blocks):
            if labels[k]:
                continue
            own = []
            for e, names in b.elements:
                if names[0] in _ROOTS:
                    continue
                if e not in new:
                    new[e] = self.element(names if keep or names[0] in _LEAVES | {"ul", "ol"} else self.nameless())
                own.append(new[e])
            rest[bool(len(inside) and k > inside[0])].append(Block(b.text, (*body[:2], *own), b.link))
        section: tuple[Element, ...] = ()
        main: list[tuple[Block, int]] = []
        divs, rich, last = (self.chance(0.2), self.pick([0.0, 0.05, 0.15]), self.chance(0.5)) if self.adds else (False, 0.0, False)
        for k in inside:
            b = blocks[k]
            leaf = [self.element(names) for _, names in b.elements[-1:] if names[0] in _LEAVES and not (divs and names[0] == "p")] or [self.element("div" if divs else self.pick(["p", "div"]))]
            if self.chance(0.06) and len(main) > 1 and wrap is not body:
                section = (self.element(self.pick(["div", "section", "blockquote", "div"])),)
            elif self.chance(0.1):
                section = ()
            main.append((Block(b.text, (*wrap, *section, *leaf), b.link), 1))
            if self.adds and (self.chance(rich) or (last and k == inside[-1])):  # what only rich variants have
                main += [(x, 1) for _ in range(self.pick([1, 1, 2, 3])) for x in self.rich((*wrap, *section))]
            if self.chance(0.03):
                kind = self.pick(["links", "notice", "form", "side"])
                main += [(x, 0) for x in self.frame(kind, wrap, kind in ("notice", "side") or self.chance(0.5))]
        if self.chance(0.25 if self.adds else 0.15):
            main += [(x, 0) for x in self.frame(self.pick(["links", *["comments"] * (1 + self.adds), "form"]), wrap, True)]
        for part in (before, [rest[0]]):
            out += [(x, 0) for f in part for x in f]
        out += main
        for part in ([rest[1]], after) if self.chance(0.5) else (after, [rest[1]]):
            out += [(x, 0) for f in part for x in f]
        return [b for b, _ in out], np.array([y for _, y in out], np.float32)


def variants(pages: list[str], each: int = 5, seed: int = SEED, rich: bool = False) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of each page as it is, and of some drawn variants; rich: whose articles have lists, tables and more added to them."""
    taught = [(b, teach(b)) for b in map(blocks_of, pages) if b]
    scene = _Scene(np.random.default_rng(seed), [x.text for b, _ in taught for x in b] or ["text"], rich)
    return taught + [scene.draw(b, y) for b, y in taught if y.any() for _ in range(each)]


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, **options) -> Labeller:
    chosen = pages.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
    rows = pages.select(F.col("page_id").alias("__p"), "html").join(F.broadcast(chosen.distinct()), F.col("__p") == F.col("page_id")).filter("html is not null")
    texts = [r.html for r in sorted(rows.select("page_id", "html").toLocalIterator(), key=lambda r: (r.page_id, r.html))]
    return fit([(page_vectors(b), y) for b, y in variants(texts, rich=True)], **{"falling": True, **options})


def extract(pages: DataFrame, model: Labeller | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    net = train(pages) if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(net)
    inp = pages.select("page_id", "url", "html")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inp.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [blocks_of(p.as_py() or "") for p in part.column(2)]
                edges = np.cumsum([len(b) for b in found])
                every = vectors([b for own in found for b in own])
                scores = shared.value.label([place(b, x) for b, x in zip(found, np.split(every, edges[:-1]), strict=True)])
                texts = ["\n\n".join(b.text for b, s in zip(own, p, strict=True) if s >= threshold) for own, p in zip(found, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return inp.mapInArrow(run, f"{head}, text string, n_chars long")
