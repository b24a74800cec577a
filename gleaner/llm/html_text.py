"""Main text of HTML pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, each with the path of
open tags above it. A block's vector holds its tag path and the words of class, id and role (hashed), its own
words (hashed) and a few sizes. A bidirectional LSTM in numpy reads the whole sequence and labels every block
as article or not, so a block is judged in the context of the page.

The labeller is trained at run time without labels: on pages composed from templates (``compose``), whose
blocks are labelled as they are made, and on at most SAMPLE_PAGES pages of the table that have an article or main
element, with labels from the tags. Training texts are taken from those pages.

Text rules: scripts, styles, comments and other raw content are no text; character references are decoded;
white space inside a block, line-break tags included, becomes one space; blocks are joined by a line feed.

Defined results: null or empty pages give an empty text; unclosed tags end with their parent or the page; an
incomplete last tag is dropped; repeated rows give the same text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 150
SAMPLE_BYTES = 200_000
COMPOSED = 1500
HIDDEN = 24
PATH, WORDS, SIZES = 256, 48, 8
WIDTH = PATH + WORDS + SIZES
EPOCHS = 14
BATCH = 32

RAW = "script style title textarea noscript template svg iframe math object canvas audio video select option".split()
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An open element of the first kind ends where one of the second kind begins.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+[^\s=>\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    linked: int = 0


def read_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    path: list = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, path, linked))
            held.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal path, linked
        if not piece:
            return
        piece = html.unescape(piece) if "&" in piece else piece
        if piece.strip():
            if not any(h.strip() for h in held):
                path = list(stack)
            if any(t == "a" for t, _ in stack):
                linked += len(piece)
        held.append(piece)

    at = 0
    page = page or ""
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        raw, close, name, rest = m[1], m[2], m[3], m[4]
        if name is None:
            close, name, rest = m[5], m[6], m[7]
        if raw:
            if raw.lower() not in ("script", "style", "template"):
                flush()
            continue
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name not in INLINE:
            for k in range(len(stack) - 1, -1, -1):
                own = stack[k][0]
                if own in ENDS and (ENDS[own] is None or name in ENDS[own]):
                    del stack[k:]
                    break
                if own not in INLINE and own != "p":
                    break
        if name not in VOID:
            words = tuple(PART.findall(" ".join(x or y or z for _, x, y, z in NAMES.findall(rest)).lower())) if rest and "=" in rest else ()
            stack.append((name, words))
    add(page[at:])
    flush()
    return out


_slots: dict[tuple[str, int], tuple[int, float]] = {}


def _slot(token: str, size: int) -> tuple[int, float]:
    found = _slots.get((token, size))
    if found is None:
        if len(_slots) > 100_000:
            _slots.clear()
        h = zlib.crc32(token.encode())
        found = _slots[token, size] = (h % size, 1.0 if h >> 20 & 1 else -1.0)
    return found


def vectors(blocks: list[Block]) -> np.ndarray:
    """One vector per block."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    paths: dict[tuple, np.ndarray] = {}
    for k, block in enumerate(blocks):
        key = tuple(block.path)
        row = paths.get(key)
        if row is None:
            row = np.zeros(PATH, np.float32)
            for depth, (tag, names) in enumerate(block.path):
                tokens = ["t:" + tag]
                if depth == len(block.path) - 1:
                    tokens.append("last:" + tag)
                for n in names:
                    tokens += ["n:" + n, "b:" + n[:4]]
                for t in tokens:
                    i, sign = _slot(t, PATH)
                    row[i] += sign
            paths[key] = row = np.clip(row, -2, 2)
        out[k, :PATH] = row
        words = block.text.lower().split()
        sums = [0.0] * WORDS
        for w, times in Counter(words).items():
            i, sign = _slot(w, WORDS)
            sums[i] += sign * times
        # a sum of n words is as wide as the root of n; of more than 32 words the mean counts, at the width of 32
        out[k, PATH : PATH + WORDS] = np.array(sums) * (1 / np.sqrt(len(words)) if len(words) <= 32 else np.sqrt(32) / len(words))
        n = len(block.text)
        out[k, -SIZES:] = (
            min(np.log1p(n) / 5, 2), min(np.log1p(len(words)) / 4, 2), block.linked / max(n, 1), min(len(block.path), 12) / 6,
            k / len(blocks), 1 - k / len(blocks), block.text[-1] in ".!?", 1,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one in each direction, and a logistic layer over both states and the block's own vector."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"], self.p[f"h{d}"] = make(WIDTH, 4 * HIDDEN), make(HIDDEN, 4 * HIDDEN)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["o"], self.p["skip"], self.p["ob"] = make(2 * HIDDEN, 1), make(WIDTH, 1) * 0.1, np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        gates = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        states, tape = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            g = gates[t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            tanh = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, u, tanh, m))
            c, h = m * new + (1 - m) * c, m * (o * tanh) + (1 - m) * h
            states[t] = h
        return states, tape

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        sf, tf = self._run(x, mask, "f", keep)
        sb, tb = self._run(x, mask, "b", keep)
        both = np.concatenate([sf, sb], 2)
        return _sigmoid((both @ self.p["o"] + x @ self.p["skip"])[..., 0] + self.p["ob"]), both, (tf, tb)

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all blocks."""
        score, both, tapes = self.scores(x, mask, keep=True)
        error = ((score - y) * mask / mask.sum())[..., None].astype(np.float32)
        g = {"o": np.einsum("tbh,tbk->hk", both, error), "skip": np.einsum("tbd,tbk->dk", x, error), "ob": error.sum((0, 1))}
        back = error @ self.p["o"].T
        for d, tape, part in (("f", tapes[0], back[..., :HIDDEN]), ("b", tapes[1], back[..., HIDDEN:])):
            gx, gh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"h{d}"])
            gc = np.zeros_like(self.p[f"c{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, u, tanh, m in reversed(tape):
                dh = dh + part[t]
                new = m * dh
                dcell = m * dc + new * o * (1 - tanh**2)
                gate = np.concatenate([dcell * u * i * (1 - i), dcell * c * f * (1 - f), new * tanh * o * (1 - o), dcell * i * (1 - u**2)], 1)
                gx += x[t].T @ gate
                gh += h.T @ gate
                gc += gate.sum(0)
                dh, dc = gate @ self.p[f"h{d}"].T + (1 - m) * dh, dcell * f + (1 - m) * dc
            g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = gx, gh, gc
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> Labeller:
        rng, first, second, k = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda j: len(pages[j][0]))
            groups = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
            for j in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[j]])
                y = np.zeros(mask.shape, np.float32)
                for col, i in enumerate(groups[j]):
                    y[: len(pages[i][1]), col] = pages[i][1]
                k += 1
                for name, g in self.step(x, y, mask).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                    scale = rate * (0.3 if epoch > 2 * epochs // 3 else 1)
                    self.p[name] = (self.p[name] - scale * first[name] / (1 - 0.9**k) / (np.sqrt(second[name] / (1 - 0.999**k)) + 1e-6)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x, mask = np.zeros((longest, len(pages), WIDTH), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# --- training pages ------------------------------------------------------------------------------

ARTICLE = (
    ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "post-content"),
    ("section", "entry-content"), ("div", "story"), ("div", "main-content"), ("div", "article"), ("section", "article-text"), ("div", "post"), ("div", "text"),
)
FRAMES = (("div", "wrapper"), ("div", "page"), ("div", "container"), ("div", "row"), ("div", "site"), ("div", "inner"), ("body", ""), ("section", ""), ("div", ""))
MENUS = (("nav", ""), ("nav", "menu"), ("ul", "menu"), ("div", "nav"), ("div", "menu"), ("div", "navigation"), ("nav", "main-nav"), ("div", "navbar"), ("ul", "nav"), ("nav", "breadcrumb"), ("div", "breadcrumbs"), ("div", "topbar"))
HEADS = (("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "banner"), ("div", "site-title"), ("div", "logo"))
FEET = (("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "legal"), ("div", "bottom"))
SIDES = (("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("aside", "related-posts"), ("div", "side"), ("section", "recommended"), ("div", "share"), ("div", "social"), ("div", "tags"))
NOTICES = (("div", "notice"), ("div", "cookie"), ("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "consent"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("section", "notice"), ("p", "notice"), ("p", "disclaimer"), ("div", "gdpr"), ("div", "paywall"), ("div", "warning"))
ADVERTS = (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "ad"), ("div", "sponsored"), ("div", "sponsor"), ("div", "promo"), ("div", "promotion"), ("section", "ad-slot"), ("p", "ad"), ("div", "banner-ad"), ("ins", "adsbygoogle"))
FORMS = (("form", ""), ("form", "search"), ("form", "newsletter"), ("form", "subscribe"), ("form", "login"), ("div", "newsletter"), ("div", "subscribe"), ("div", "signup"), ("div", "search"))
COMMENTS = (("section", "comments"), ("div", "comments"), ("div", "comment"), ("ul", "comment-list"), ("ol", "comments"), ("div", "comment-list"), ("section", "comment-section"), ("article", "comment"), ("div", "responses"), ("div", "discussion"), ("div", "replies"), ("div", "disqus"))
UNWANTED = frozenset(n for group in (MENUS, HEADS, FEET, SIDES, NOTICES, ADVERTS, FORMS, COMMENTS) for _, names in group for n in names.split("-") if n)
UNWANTED_TAGS = frozenset("nav header footer aside form".split())
NEUTRAL = frozenset("main site top bottom side text slot list section title post posts".split())


def _shut(tag: str, names: str, inner: str, rng) -> str:
    attr = "" if not names else f' {"id" if rng.random() < 0.25 else "class"}="{names if rng.random() < 0.8 else names.replace("-", "_")}"'
    return f"<{tag}{attr}>{inner}</{tag}>"


def compose(texts: list[str], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of random layout and whether each of its blocks belongs to the article."""
    truth: list[bool] = []
    pick = lambda options: options[int(rng.integers(len(options)))]

    def words(low: int, high: int) -> str:
        own = pick(texts).split() or ["a"]
        n = int(rng.integers(low, high + 1))
        a = int(rng.integers(max(1, len(own) - n + 1)))
        return html.escape(" ".join(own[a : a + n]))

    def leaf(tag: str, low: int, high: int, good: bool, link: float = 0.0) -> str:
        truth.append(good)
        inner = words(low, high)
        if rng.random() < link:
            inner = f'<a href="/x">{inner}</a>'
        elif rng.random() < 0.25:
            inner = f"<b>{inner}" + ("</b>" if rng.random() < 0.6 else "")
        if rng.random() < 0.15:
            inner += "<br>"
        return f"<{tag}>{inner}" + (f"</{tag}>" if tag not in ("p", "li") or rng.random() < 0.85 else "")

    def items(kind, low: int, high: int, size: tuple[int, int], link: float) -> str:
        tag, names = kind
        n = int(rng.integers(low, high + 1))
        if tag in ("ul", "ol"):
            return _shut(tag, names, "".join(leaf("li", *size, False, link) for _ in range(n)), rng)
        if tag in ("p", "ins"):
            truth.append(False)
            return _shut(tag, names, words(*size), rng)
        style = int(rng.integers(3))
        if style == 0 and link > 0.3:
            return _shut(tag, names, "<ul>" + "".join(leaf("li", *size, False, link) for _ in range(n)) + "</ul>", rng)
        if style == 1:
            truth.append(False)
            return _shut(tag, names, words(*size), rng)
        head = leaf(pick(("h2", "h3", "h4")), 1, 4, False) if rng.random() < 0.3 else ""
        return _shut(tag, names, head + "".join(leaf(pick(("p", "div", "p")), *size, False, link) for _ in range(n)), rng)

    def clutter() -> str:
        roll = rng.random()
        if roll < 0.4:
            return items(pick(ADVERTS), 1, 2, (3, 30), 0.2)
        if roll < 0.65:
            return items(pick(NOTICES), 1, 2, (3, 30), 0.1)
        return items(pick(SIDES), 1, 4, (2, 25), 0.5)

    def form() -> str:
        tag, names = pick(FORMS)
        truth.append(False)
        return _shut(tag, names, f"<label>{words(1, 5)}</label><input name=q><button>", rng)

    def article(tag: str, names: str) -> str:
        parts = [leaf("h1", 2, 12, True)] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 12))):
            roll = rng.random()
            if roll < 0.72:
                parts.append(leaf("p", 1, 120, True))
            elif roll < 0.8:
                parts.append(leaf(pick(("h2", "h3", "blockquote", "pre")), 1, 15, True))
            elif roll < 0.86:
                parts.append("<ul>" + "".join(leaf("li", 1, 20, True) for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif roll < 0.94:
                parts.append(clutter())
            else:
                parts.append(form())
        return _shut(tag, names, "".join(parts), rng)

    out = [f"<html><head><title>{words(1, 6)}</title></head><body>"]
    frames = [pick(FRAMES) for _ in range(int(rng.integers(0, 3)))]
    out += [f'<{t} class="{n}">' for t, n in frames if t != "body"]
    before = [lambda: items(pick(MENUS), 2, 9, (1, 3), 0.9), lambda: items(pick(HEADS), 1, 2, (1, 8), 0.3), clutter, form]
    for make in rng.permutation(np.array(before, object)):
        if rng.random() < 0.6:
            out.append(make())
    out.append(article(*pick(ARTICLE)))
    after = [lambda: items(pick(COMMENTS), 1, 6, (2, 60), 0.05), clutter, form, lambda: items(pick(SIDES), 1, 5, (2, 20), 0.6), lambda: items(pick(MENUS), 2, 6, (1, 3), 0.9)]
    for make in rng.permutation(np.array(after, object)):
        if rng.random() < 0.5:
            out.append(make())
    if rng.random() < 0.8:
        out.append(items(pick(FEET), 1, 3, (2, 20), 0.3))
    return "".join(out) + ("</body></html>" if rng.random() < 0.9 else ""), truth


def tag_label(block: Block) -> bool:
    """What the tags alone say of a block on a page that has an article or main element."""
    inside = any(t in ("article", "main") for t, _ in block.path)
    return inside and not any(t in UNWANTED_TAGS or (set(n) & UNWANTED) - NEUTRAL for t, n in block.path)


def train(pages: DataFrame, rows: int = SAMPLE_PAGES) -> Labeller:
    """Fit on composed pages and on a bounded sample of the table's own."""
    own = pages.where(F.col("html").isNotNull() & (F.octet_length("html") < SAMPLE_BYTES))
    total = own.count()
    place = F.pmod(F.xxhash64("html"), F.lit(1 << 30)) / float(1 << 30)
    found = [r["html"] for r in own.where(place < min(1.0, rows / max(total, 1))).select("html").limit(2 * rows).collect()]
    sampled = [b for b in map(read_blocks, sorted(found)) if any(tag_label(x) for x in b)]
    texts = [x.text for b in sampled for x in b if tag_label(x)] or ["one two three four five six seven eight nine ten."]
    rng = np.random.default_rng(3)
    data = [(vectors(b), np.array([tag_label(x) for x in b], np.float32)) for b in sampled]
    while len(data) < COMPOSED + len(sampled):
        page, truth = compose(texts, rng)
        blocks = read_blocks(page)
        if len(blocks) == len(truth):
            data.append((vectors(blocks), np.array(truth, np.float32)))
    return Labeller().fit(data)


def texts_of(labeller: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    blocks = [read_blocks(p) for p in pages]
    order = sorted((k for k in range(len(pages)) if blocks[k]), key=lambda k: len(blocks[k]))
    out = [""] * len(pages)
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 64 and (b - a + 1) * len(blocks[order[b]]) <= 20_000:
            b += 1
        x, mask = padded([vectors(blocks[k]) for k in order[a:b]])
        score = labeller.scores(x, mask)[0]
        for col, k in enumerate(order[a:b]):
            out[k] = "\n".join(x.text for x, s in zip(blocks[k], score[:, col]) if s >= 0.5)
        a = b
    return out


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = texts_of(shared.value, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id bigint, url string, text string")
