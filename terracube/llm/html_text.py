"""Main text of web pages: a recurrent labeller reads the blocks of a page in both directions."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta
from .shared import kept_model

#: Of the pages made by rule, the network and its training: models that were kept by another version are not used.
VERSION = 2

# -- blocks ------------------------------------------------------------------------------------

#: Texts, and tags whose quotes hold no "<" or ">": nearly all of a page.
_PLAIN = re.compile(r"""([^<]+)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>"']|"[^"<>]*"(?=[\s/>])|'[^'<>]*'(?=[\s/>]))*+)>""")
_START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_MARK = re.compile(r"""[<>"']""")
_ODD_REST = re.compile(r"[^<>]*>")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea")}


def _tag_ends(page: str):
    """A function that finds the end of a tag whose name ends at a place: behind its ">", outside of quotes of any length; -1 where a quote is not closed, or
    closed in the middle of something, or another tag begins. What failed from a place is kept, so that no part of a page is read again and again."""
    failed: set[int] = set()
    gone = {'"': len(page), "'": len(page)}  # no such quote from here on

    def end(at: int) -> int:
        seen = []
        while at not in failed:
            seen.append(at)
            m = _MARK.search(page, at)
            if m is None or m[0] == "<":
                break
            if m[0] == ">":
                return m.end()
            close = -1 if m.end() >= gone[m[0]] else page.find(m[0], m.end())
            if close < 0:
                gone[m[0]] = min(gone[m[0]], m.end())
                break
            if page[close + 1 : close + 2] not in (" ", "\t", "\n", "\r", "\f", "\v", "/", ">"):
                break
            at = close + 1
        failed.update(seen)
        return -1

    return end


def _parts_of(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """Texts as (None, False, text), tags as (name, closes, attributes). A broken tag ends at the next ">"; comments, scripts and the like are left out."""
    tag_end, at, n = _tag_ends(page), 0, len(page)
    while at < n:
        plain = _PLAIN.match(page, at)
        if plain is not None:
            text, closes, tag, rest = plain.groups()
            at = plain.end()
            if text is not None:
                yield None, False, text
                continue
            tag = tag.lower()
            if closes or tag not in _RAW_END:
                yield tag, bool(closes), rest
                continue
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else n
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = n if stop < 0 else stop + 3
            continue
        m = _START.match(page, at)
        stop = tag_end(m.end()) if m else -1
        if stop < 0 and m is not None:
            odd = _ODD_REST.match(page, m.end())
            stop = odd.end() if odd else -1
        if m is None and page[at + 1 : at + 2] in ("!", "?", "/"):
            odd = _ODD_REST.match(page, at + 2)
            if odd:
                at = odd.end()
                continue
        if m is None or stop < 0:
            yield None, False, "<"
            at += 1
            continue
        tag = m[2].lower()
        if not m[1] and tag in _RAW_END:
            close = _RAW_END[tag].search(page, stop)
            at = close.end() if close else n
            continue
        yield tag, bool(m[1]), page[m.end() : stop - 1]
        at = stop


_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Tags inside a line of text: they neither end a block nor stand in its path.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open paragraph or item of the same kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Cells that tags and names are hashed into.
PATH = 96


@lru_cache(maxsize=65536)
def _cells_of(tag: str, names: str) -> tuple[int, ...]:
    """Cells of a tag and of each part of its names."""
    return tuple(sorted({zlib.crc32(x.encode()) % PATH for x in {tag, *re.split(r"[^a-z0-9]+", names)} if x}))


def blocks(page: str) -> list[tuple[tuple[int, ...], str, int]]:
    """The leaf blocks of a page with text: cells of all open tags and their names, text, characters inside links.

    The cells are counted up when a tag opens and down when it closes, so that a block knows all tags around it, at any depth.
    """
    out: list[tuple[tuple[int, ...], str, int]] = []
    path: list[tuple[str, tuple[int, ...]]] = []
    held: Counter[int] = Counter()
    opened: Counter[str] = Counter()
    text: list[str] = []
    links = in_link = 0

    def end_block() -> None:
        nonlocal links
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                leaf = (zlib.crc32(f"leaf:{path[-1][0]}".encode()) % PATH,) if path else ()
                out.append((tuple({*held, *leaf}), whole, links))
            text.clear()
        links = 0

    def leave() -> str:
        tag, cells = path.pop()
        opened[tag] -= 1
        for c in cells:
            held[c] -= 1
            if not held[c]:
                del held[c]
        return tag

    for tag, closes, rest in _parts_of(page):
        if tag is None:
            text.append(rest)
            links += len(rest) * (in_link > 0)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closes else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag in ("hr", "img"):
                text.append(" ")
            continue
        end_block()
        in_link = 0
        if closes:
            while opened[tag] and leave() != tag:
                pass
            continue
        if path and path[-1][0] == "p":
            leave()
        while path and path[-1][0] in CLOSES.get(tag, ()):
            leave()
        names = " ".join(next(filter(None, x), "") for x in _NAMED.findall(rest)).lower() if rest else ""
        cells = _cells_of(tag, names) if len(names) < 1_024 else _cells_of.__wrapped__(tag, names)
        path.append((tag, cells))
        opened[tag] += 1
        held.update(cells)
    end_block()
    return out


# -- numbers -----------------------------------------------------------------------------------

WORDS, OTHER = 24, 6
WIDTH = PATH + WORDS + OTHER


def numbers(found: list[tuple[tuple[int, ...], str, int]]) -> np.ndarray:
    """One row of numbers for each block: hashed path, hashed words, length, links and marks."""
    out = np.zeros((len(found), WIDTH), np.float32)
    if not found:
        return out
    for i, (cells, _, _) in enumerate(found):
        out[i, list(cells)] = 1
    texts = [t.encode() for _, t, _ in found]
    sizes = np.array([len(t) for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    a, b, row = ta.words(data, offsets)
    cell = (ta.span_hash(ta.LOWER[data], a, b, 5) % np.uint64(WORDS)).astype(np.int64)
    count = np.bincount(row * WORDS + cell, minlength=len(found) * WORDS).reshape(len(found), WORDS)
    n = np.bincount(row, minlength=len(found))
    out[:, PATH : PATH + WORDS] = 0.3 * np.log1p(count)
    links = np.array([x for _, _, x in found])
    out[:, PATH + WORDS] = np.log1p(n) / 5
    out[:, PATH + WORDS + 1] = np.minimum(links / np.maximum(sizes, 1), 1)
    out[:, PATH + WORDS + 2] = np.array([t.endswith((b".", b"!", b"?")) for t in texts])
    out[:, PATH + WORDS + 3] = n <= 3
    out[:, PATH + WORDS + 4] = np.array([b"\xc2\xa9" in t for t in texts])
    out[:, PATH + WORDS + 5] = 1
    return out


# -- the network -------------------------------------------------------------------------------

HIDDEN = 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _forward(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """States of one direction over x[time, page, width]; gates in the order in, forget, out, new."""
    steps, pages, _ = x.shape
    h, c, k = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype), HIDDEN
    fed, out, kept = x @ w + b, np.zeros((steps, pages, HIDDEN), x.dtype), []
    for t in range(steps):
        z = fed[t] + h @ u
        g, new = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
        before, old = c, h
        c = g[:, k : 2 * k] * c + g[:, :k] * new
        top = np.tanh(c)
        h = g[:, 2 * k :] * top
        out[t] = h
        if keep:
            kept.append((g, new, before, top, old))
    return out, kept


def _backward(dh: np.ndarray, x: np.ndarray, kept: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gw, gu, gb, k = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), HIDDEN
    next_h, next_c = np.zeros(dh.shape[1:]), np.zeros(dh.shape[1:])
    for t in range(len(kept) - 1, -1, -1):
        g, new, before, top, old = kept[t]
        d = dh[t] + next_h
        dc = d * g[:, 2 * k :] * (1 - top**2) + next_c
        dz = np.concatenate([dc * new, dc * before, d * top, dc * g[:, :k]], axis=1)
        dz[:, : 3 * k] *= g * (1 - g)
        dz[:, 3 * k :] *= 1 - new**2
        gw += x[t].T @ dz
        gu += old.T @ dz
        gb += dz.sum(axis=0)
        next_h, next_c = dz @ u.T, dc * g[:, k : 2 * k]
    return gw, gu, gb


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse order; what pads a page stays behind them."""
    t = np.arange(len(x))[:, None]
    return x[np.where(t < lengths, lengths - 1 - t, t), np.arange(x.shape[1])]


def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((int(lengths.max()), len(rows), WIDTH), np.float32)
    for i, r in enumerate(rows):
        x[: len(r), i] = r
    return x, lengths


def scores(model: list[np.ndarray], rows: list[np.ndarray]) -> list[np.ndarray]:
    """Log-odds that a block is main text, for each block of each page."""
    out: list[np.ndarray] = [np.zeros(0)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: -len(rows[i]))
    while order:
        n = max(1, min(len(order), 32_768 // len(rows[order[0]])))
        part, order = order[:n], order[n:]
        x, lengths = _pad([rows[i] for i in part])
        ahead, _ = _forward(x, *model[0:3], keep=False)
        back, _ = _forward(_turned(x, lengths), *model[3:6], keep=False)
        z = np.concatenate([ahead, _turned(back, lengths)], axis=2) @ model[6] + model[7]
        for j, i in enumerate(part):
            out[i] = z[: lengths[j], j]
    return out


def fit(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 24, batch: int = 50, rate: float = 0.02, seed: int = 3) -> list[np.ndarray]:
    """Back-propagation through time with Adam steps on pages of (numbers, labels)."""
    rng = np.random.default_rng(seed)
    k = 4 * HIDDEN
    model = [m for _ in range(2) for m in (rng.normal(0, 0.1, (WIDTH, k)), rng.normal(0, 0.2, (HIDDEN, k)), np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])]
    model += [rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)]
    m1, m2, step = [np.zeros_like(w) for w in model], [np.zeros_like(w) for w in model], 0
    for _ in range(rounds):
        # pages of like length go together, in a new order each round: little is spent on padding
        order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][0]) + 6 * rng.random())
        for a in rng.permutation(np.arange(0, len(order), batch)):
            some = [pages[i] for i in order[a : a + batch]]
            x, lengths = _pad([p for p, _ in some])
            y = np.zeros(x.shape[:2])
            for i, (_, label) in enumerate(some):
                y[: len(label), i] = label
            real = np.arange(len(x))[:, None] < lengths
            turned = _turned(x, lengths)
            ahead, kept1 = _forward(x, *model[0:3])
            back, kept2 = _forward(turned, *model[3:6])
            h = np.concatenate([ahead, _turned(back, lengths)], axis=2)
            d = np.where(real, _sigmoid(h @ model[6] + model[7]) - y, 0) / real.sum()
            dh = d[..., None] * model[6]
            grads = [*_backward(dh[..., :HIDDEN], x, kept1, *model[0:2]), *_backward(_turned(dh[..., HIDDEN:], lengths), turned, kept2, *model[3:5])]
            grads += [np.tensordot(d, h, 2), np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.99 * m2[i] + 0.01 * g * g
                model[i] = model[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
    return model


# -- labelled pages ----------------------------------------------------------------------------


def labelled_pages(n: int = 720, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pages made by rule from a seed, in many layouts, with the blocks of their main text.

    The article stands in one of several containers; menus, headers, footers, sidebars, notices, adverts, forms and
    comments stand around or inside it, with words from the same invented vocabulary.
    """
    rng = np.random.default_rng(seed)
    parts = ["an", "the", "re", "ion", "est", "or", "al", "qu", "ver", "lo", "mi", "ta", "sch", "é", "en", "ou"]
    pool = ["".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(3_000)]
    word = lambda: pool[int(rng.integers(0, len(pool)))]
    odd = lambda: one_of(f"{word()}.{rng.integers(99)}@{word()}.example.com", f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}", str(rng.integers(10**15, 10**16)), "12.34.56.78", "\u00a9", "|")
    phrase = lambda lo, hi: " ".join(pool[k] if k < len(pool) else odd() for k in rng.integers(0, len(pool) * 50 // 49, int(rng.integers(lo, hi))).tolist())
    sentence = lambda lo, hi: phrase(lo, hi).capitalize() + rng.choice([".", ".", "!!", "###", "&&&", "***", ""])
    one_of = lambda *x: x[int(rng.integers(0, len(x)))]
    some = lambda p: rng.random() < p
    wrap = lambda tag, inside, name="": f"<{tag}{name and ' class=' + chr(34) + name + chr(34)}>{inside}</{tag}>"
    link = lambda: f'<a href="/{word()}">{html.escape(phrase(1, 3))}</a>'

    def menu() -> str:
        return wrap(one_of("nav", "nav", "nav", "div"), wrap("ul", "".join(wrap("li", link()) for _ in range(int(rng.integers(2, 9))))), one_of("menu", "navbar", "breadcrumb")) if some(0.5) else wrap("nav", wrap("ul", "".join(wrap("li", link()) for _ in range(int(rng.integers(2, 9))))))

    def aside() -> str:
        return one_of(
            lambda: wrap("div", sentence(2, 16), one_of("ad", "ad", "advert", "ads banner", "sponsored")),
            lambda: wrap("aside", "".join(wrap("p", sentence(3, 14)) for _ in range(int(rng.integers(1, 4))))),
            lambda: wrap("div", wrap("h3", phrase(1, 4)) + wrap("ul", "".join(wrap("li", link()) for _ in range(4))), one_of("sidebar", "related", "widget")),
            lambda: wrap("div", wrap("p", sentence(4, 15)), one_of("cookie notice", "notice", "newsletter", "popup")),
            lambda: wrap("section", wrap("h3", phrase(1, 4)) + "".join(wrap("p", sentence(3, 12)) for _ in range(int(rng.integers(1, 3)))), one_of("sidebar", "related", "promo", "newsletter", "sponsored")),
            lambda: wrap("form", "<label>" + phrase(1, 3) + '</label><input name="q"><button>' + word() + "</button>"),
        )()

    def comments() -> str:
        each = one_of(lambda: wrap("div", wrap("p", sentence(4, 30)), "comment"), lambda: wrap("div", wrap("div", phrase(1, 3), "author") + wrap("p", sentence(4, 30)), "comment-body"), lambda: wrap("li", wrap("p", sentence(4, 30)), "comment"), lambda: wrap("article", wrap("p", sentence(4, 30)), "comment"), lambda: wrap("p", sentence(4, 30)))
        title = wrap(one_of("h2", "h3"), phrase(1, 3)) if some(0.3) else ""
        inside = title + "".join(each() for _ in range(int(rng.integers(1, 7))))
        name = one_of("comments", "comments", "comment-list", "comments area", "reader comments")
        tag = one_of("section", "div", "div", "ul", "ol", "aside")
        return f'<{tag} id="{name}">{inside}</{tag}>' if some(0.3) else wrap(tag, inside, name)

    def footer() -> str:
        return wrap(one_of("footer", "footer", "div"), f"&copy; {word()}.example.com &middot; {sentence(3, 12)}", "footer") if some(0.3) else wrap("footer", f"&copy; {word()}.example.com &middot; {sentence(3, 12)}")

    pages = []
    for _ in range(n):
        main: list[str] = []

        def say(tag: str, lo: int, hi: int, main: list[str] = main) -> str:
            text = " ".join(sentence(lo, hi) for _ in range(int(rng.integers(1, 4))))
            if some(0.05):  # junk is main text, too
                text = one_of(" ".join([word()] * int(rng.integers(2, 60))), word(), "#" * int(rng.integers(1, 30)), str(rng.integers(10**9)), " | ".join(word() for _ in range(5)))
            main.append(" ".join(text.split()))
            inside = html.escape(text)
            if tag == "b":
                return f"<p><b>{inside}<br>"
            if some(0.1):
                inside = inside.replace(" ", " <em>", 1) + "</em>"
            return f"<{tag}>{inside}</{tag}>" if tag != "p" or some(0.9) else f"<p>{inside}"

        body = say("h1", 2, 10) if some(0.9) else ""
        for _ in range(int(rng.integers(1, 4))):
            if some(0.6):
                body += one_of(lambda: say("b", 1, 12), lambda: say("h2", 1, 8))()
            again = ""
            for _ in range(int(rng.choice([0, 1, 2, 4, 8, 20, 40, 120], p=[0.15, 0.2, 0.2, 0.2, 0.1, 0.09, 0.04, 0.02]))):
                if again and some(0.1):  # lines come again
                    main.append(main[-1])
                    body += again
                    continue
                before = len(main)
                again = say(one_of("p", "p", "p", "p", "p", "blockquote", "li", "pre"), 1, 40)
                body += again
                again = again if len(main) == before + 1 else ""
            if some(0.15):
                body += aside()
        if some(0.15):
            body += comments()
        # any container may hold the article, and nearly any of them comments and adverts elsewhere, so that no tag alone tells
        body = one_of(
            *[lambda: wrap("article", body)] * 3, lambda: wrap("main", body), lambda: wrap("section", body), lambda: wrap("section", body, one_of("content", "post", "story", "entry")), lambda: wrap("div", body), lambda: wrap("div", wrap("div", body)),
            *[lambda: wrap("div", body, one_of("content", "post-body", "article", "entry", "entry-content", "story", "text", "post", "page"))] * 2, lambda: body, lambda: f"<table><tr><td>{body}</td></tr></table>",
            lambda: f'<div id="{one_of("content", "main", "article")}">{body}</div>', lambda: f'<div role="main">{body}</div>', lambda: wrap("main", wrap("article", body)),
        )()
        around = (menu() if some(0.9) else "") + (f"<!-- ad {word()} -->" if some(0.5) else "") + "".join(aside() for _ in range(int(rng.integers(0, 3))))
        if some(0.3):
            around = wrap("header", wrap(one_of("h1", "div"), phrase(1, 4))) + around
        after = "".join(aside() for _ in range(int(rng.integers(0, 2)))) + (comments() if some(0.15) else "") + (footer() if some(0.9) else "")
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(phrase(2, 9))}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        whole = around + body + after
        for _ in range(int(rng.choice([0, 1, 2, 3, 12, 40], p=[0.6, 0.15, 0.1, 0.07, 0.05, 0.03]))):
            whole = wrap("div", whole, one_of("", "wrapper", "container", "row", "page", "site", "inner"))
        pages.append((head + whole + ("</body></html>" if some(0.85) else ""), main))
    return pages


@lru_cache(maxsize=2)
def trained(n: int = 720, seed: int = 5) -> list[np.ndarray]:
    examples = []
    for page, main in labelled_pages(n, seed):
        found, at, label = blocks(page), 0, []
        for _, text, _ in found:  # main blocks in page order
            hit = at < len(main) and text == main[at]
            at += hit
            label.append(hit)
        examples.append((numbers(found), np.array(label, float)))
    return [w.astype(np.float32) for w in fit(examples)]


# -- pages -------------------------------------------------------------------------------------


def main_texts(model: list[np.ndarray], pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    flat = numbers([b for page in found for b in page])
    rows = np.split(flat, np.cumsum([len(p) for p in found])[:-1]) if found else []
    return ["\n".join(b[1] for b, s in zip(page, score, strict=True) if s > 0) for page, score in zip(found, scores(model, rows), strict=True)]


def extract_text(df: DataFrame, html_col: str = "html", n: int = 720, seed: int = 5) -> DataFrame:
    """Main text of each page: all columns but ``html_col``, and ``text``.

    The page is cut into leaf blocks; each block's tag path, words and length become numbers; a bidirectional LSTM labels
    every block from the whole page; blocks labelled main are joined by line feeds. It is trained on ``n`` pages made by rule, once: its weights are kept in the
    shared folder.
    A null, empty or broken page gives the blocks that can be read, or an empty text; an unclosed quote ends with its tag; tags may be nested to any depth, attributes be of any length.
    Repeated rows are read each; a column named ``text`` is replaced, all others stay. One pass, no shuffle; memory follows the longest page of a task.
    """
    names = [c for c in df.columns if c != "text" or c == html_col]
    model = df.sparkSession.sparkContext.broadcast(kept_model(df.sparkSession, f"html_text-{VERSION}-{n}-{seed}", lambda: trained(n, seed)))  # some thousand numbers
    out = [c for c in names if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, html_col):
                texts = main_texts(model.value, [p or "" for p in part.column(html_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), pa.array(texts, pa.string())], [*out, "text"])

    schema = T.StructType([*(df.schema[c] for c in out), T.StructField("text", T.StringType())])
    return df.select(*names).mapInArrow(run, schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
