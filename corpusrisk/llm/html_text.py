"""Main text of web pages by a recurrent block labeller.

1. Leaves.  A page is cut into blocks: stretches of text between block-level tags, in page order,
   each with the path of open elements.  Character references are decoded, white space becomes one
   space, and elements that show no article text (scripts, styles, the head, form controls) are left out.
2. Vectors.  A block's vector holds hashed tokens of its tag path (tags, words of ``class``, ``id`` and
   ``role``, the innermost element again), hashed words, and a few measures (length, share of link
   text, punctuation, digits).
3. Labeller.  A bidirectional LSTM in numpy reads a page's whole sequence of vectors in both
   directions and gives every block the probability that it belongs to the article; pages of
   similar length run together, and a page is never cut.
4. The article is the blocks of probability 0.5 or more, joined by two line breaks.

Training.  Blocks of a bounded sample of pages (``TRAIN_PAGES`` pages by a hash of the page's url and
id, each of at most ``TRAIN_CHARS`` characters) are labelled by the innermost telling element of their
path: the fixed lists below.  Blocks without one are not trained on.  Each sampled page also comes in
variants in which known containers bear other names of their kind and more side matter (menus, notices,
comments, forms ...), filled with blocks of the same sample, stands around and inside the article,
some of whose paragraphs become list items, quotations and the like, so that the labeller also knows
what these pages happen not to show.  Adam steps follow the
gradients through whole sequences; the seed is fixed.

Cases: null or empty html, or html without a telling block, gives the empty string; null ids and urls
are kept; repeated pages are extracted one by one; unclosed tags, comments and scripts end with the
page; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.llm.common import worker_table

TRAIN_PAGES = 240
TRAIN_CHARS = 40_000
VARIANTS = 2  # renamed copies of each sampled page
EPOCHS = 8
CELLS = 24  # of the LSTM, in each direction
PATH_SLOTS = 512
WORD_SLOTS = 128
MEASURES = 5
WIDTH = 2 * PATH_SLOTS + WORD_SLOTS + MEASURES
BATCH_STEPS = 1 << 15  # blocks of pages that run together
REMEMBERED = 200_000  # hashed tokens kept per worker

# fixed values of HTML: what ends a block, what shows no text, what closes itself
BLOCK_TAGS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
UNSHOWN_TAGS = frozenset("button datalist head iframe noframes noscript object option select template title svg math audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {  # an opening tag ends open elements of these kinds
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
CLOSES |= {t: CLOSES.get(t, set()) | {"p"} for t in BLOCK_TAGS - {"html", "head", "body", "title", "caption", "legend", "summary", "tbody", "thead", "tfoot", "tr", "td", "th"}}
# names of side matter and of articles, for the labels of the training sample
SIDE_TAGS = ("nav", "footer", "aside", "form", "menu", "dialog", "header")
SIDE_NAMES = (
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login"
    " sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar header masthead footer copyright legal disclaimer"
    " comment comments reply replies respond discussion disqus share social related recommended trending pagination pager tags search form"
).split()
SIDE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form")
MAIN_TAGS = ("article", "main")
MAIN_NAMES = ("article", "post", "entry", "story", "content", "main", "body", "text")

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|xmp|plaintext)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+|[^>]*+)/?>|<[!?][^>]*+>|([^<]++|<)""",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PIECE = re.compile(r"[a-z]+")


class Block:
    """A leaf: its text, the tokens of its path from the outside, and its characters within links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[tuple[str, ...], ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


@lru_cache(maxsize=10_000)
def _element(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its naming attributes."""
    found = [tag]
    for kind, *values in _NAMES.findall(attributes):
        found += [("@" if kind.lower() == "role" else ".") + w for w in _PIECE.findall("".join(values).lower())]
    return tuple(found)


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page."""
    out: list[Block] = []
    open_: list[tuple[str, ...]] = []
    held: list[tuple[str, bool]] = []
    unshown = links = 0

    def end_block() -> None:
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            if text:
                out.append(Block(tuple(open_), text, sum(len(t) for t, link in held if link)))
            held.clear()

    def pop() -> None:
        nonlocal unshown, links
        tag = open_.pop()[0]
        unshown -= tag in UNSHOWN_TAGS
        links -= tag == "a"

    for m in _TOKEN.finditer(html):
        text = m.group(5)
        if text is not None:
            if not unshown:
                held.append((html_lib.unescape(text) if "&" in text else text, links > 0))
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if block:
            end_block()
        if m.group(2):
            if any(e[0] == tag for e in open_):
                while open_[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID_TAGS:
            if tag in ("br", "hr", "img", "input", "wbr") and held and tag != "wbr":
                held.append((" ", False))
            continue
        shut = CLOSES.get(tag)
        if shut:  # up to the nearest element that is one of them, past inline ones only
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in shut:
                    while len(open_) > i:
                        pop()
                    if tag not in ("tr", "dt", "dd"):
                        break
                elif open_[i][0] in BLOCK_TAGS:
                    break
        open_.append(_element(tag, m.group(4) or ""))
        unshown += tag in UNSHOWN_TAGS
        links += tag == "a"
    end_block()
    return out


def told(path: tuple[tuple[str, ...], ...]) -> int | None:
    """Label by the innermost telling element: 1 article, 0 side matter, None if there is none."""
    for depth in range(len(path) - 1, -1, -1):
        tag, *names = path[depth]
        bare = {n[1:] for n in names if n[0] == "."}
        if tag in MAIN_TAGS and not bare & set(SIDE_NAMES):
            return 1
        inner_header = tag == "header" and any(e[0] in MAIN_TAGS for e in path[:depth])  # an article's own heading
        if bare & set(SIDE_NAMES) or {n[1:] for n in names if n[0] == "@"} & set(SIDE_ROLES) or tag in SIDE_TAGS and not inner_header:
            return 0
        if bare & set(MAIN_NAMES) and tag not in ("body", "html"):
            return 1
    return None


class _Hashes(dict):
    """CRC-32 of tokens, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return h


_hashes = worker_table(_Hashes())


@lru_cache(maxsize=10_000)
def _path_slots(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Places of a path's tokens, and of those of its innermost element behind them."""
    every = {_hashes[t] % PATH_SLOTS for element in path for t in element}
    return np.array(sorted(every) + sorted({PATH_SLOTS + _hashes[t] % PATH_SLOTS for t in (path[-1] if path else ())}), dtype=np.int64)


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: hashed path, innermost element, hashed words, measures."""
    n = len(page)
    x = np.zeros((n, WIDTH), dtype=np.float32)
    if not n:
        return x
    paths = [_path_slots(b.path) for b in page]
    x[np.repeat(np.arange(n), [len(p) for p in paths]), np.concatenate(paths)] = 1
    words = [b.text.lower().split() for b in page]
    n_words = np.array([len(w) for w in words])
    slots = np.fromiter((h for w in words for h in map(_hashes.__getitem__, w)), dtype=np.int64, count=int(n_words.sum())) % WORD_SLOTS
    count = np.bincount(np.repeat(np.arange(n), n_words) * WORD_SLOTS + slots, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
    x[:, 2 * PATH_SLOTS : 2 * PATH_SLOTS + WORD_SLOTS] = count / np.sqrt((count * count).sum(axis=1, keepdims=True))
    size = np.array([len(b.text) for b in page])
    marks, digits = (np.array([sum(map(b.text.count, signs)) for b in page]) for signs in (".,;:!?", "0123456789"))
    linked = np.minimum(np.array([b.linked for b in page]) / size, 1)
    x[:, -MEASURES:] = np.stack([np.log1p(size) / 6, linked, marks / n_words, digits / size, np.log1p(n_words) / 4], axis=1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Bidirectional LSTM with one output per step.  Parameters by name in ``w``; gate order is input,
    forget, output, candidate."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    @classmethod
    def fresh(cls, seed: int = 7, width: int = WIDTH, cells: int = CELLS, kind=np.float32) -> Labeller:
        rnd = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = (rnd.standard_normal((width, 4 * cells)) * 0.05).astype(kind)
            w["h" + d] = (rnd.standard_normal((cells, 4 * cells)) / np.sqrt(cells)).astype(kind)
            bias = np.zeros(4 * cells, dtype=kind)
            bias[cells : 2 * cells] = 1  # remember at first
            w["b" + d] = bias
        w["o"] = (rnd.standard_normal(2 * cells) * 0.1).astype(kind)
        w["c"] = np.zeros(1, dtype=kind)
        return cls(w)

    def _direction(self, d: str, z: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states of one direction; ``z`` (time, page, 4 * cells) are the input terms.  Steps
        past a page's end keep the state they found."""
        steps, pages, four = z.shape
        n = four // 4
        h, c = np.zeros((pages, n), z.dtype), np.zeros((pages, n), z.dtype)
        out, saved = np.zeros((steps, pages, n), z.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.w["h" + d]
            gates = _sigmoid(a[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(a[:, 3 * n :])
            fresh_c = f * c + i * g
            squashed = np.tanh(fresh_c)
            m = mask[t][:, None]
            if keep:
                saved.append((t, h, c, i, f, o, g, squashed, m))
            c = m * fresh_c + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            out[t] = h
        return out, saved

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits (time, page) of inputs (time, page, width)."""
        states = {d: self._direction(d, x @ self.w["x" + d] + self.w["b" + d], mask, keep) for d in "fb"}
        both = np.concatenate([states["f"][0], states["b"][0]], axis=2)
        return both @ self.w["o"] + self.w["c"][0], both, states

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Mean weighted cross-entropy and its gradients through all steps."""
        logit, both, states = self.forward(x, mask, True)
        total = max(float(weight.sum()), 1e-9)
        loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / total)
        d_logit = weight * (_sigmoid(logit) - label) / total
        g = {"o": np.einsum("tp,tph->h", d_logit, both), "c": np.array([d_logit.sum()], x.dtype)}
        d_both = d_logit[:, :, None] * self.w["o"]
        n = d_both.shape[2] // 2
        for k, d in enumerate("fb"):
            dz = np.zeros((*x.shape[:2], 4 * n), x.dtype)
            g["h" + d] = np.zeros_like(self.w["h" + d])
            dh, dc = np.zeros((x.shape[1], n), x.dtype), np.zeros((x.shape[1], n), x.dtype)
            for t, h, c, i, f, o, cand, squashed, m in reversed(states[d][1]):
                dh = dh + d_both[t, :, k * n : (k + 1) * n]
                on, dh_off, dc_off = m * dh, (1 - m) * dh, (1 - m) * dc
                d_c = m * dc + on * o * (1 - squashed**2)
                da = np.concatenate([d_c * cand * i * (1 - i), d_c * c * f * (1 - f), on * squashed * o * (1 - o), d_c * i * (1 - cand**2)], axis=1)
                dz[t] = da
                g["h" + d] += h.T @ da
                dh, dc = da @ self.w["h" + d].T + dh_off, d_c * f + dc_off
            g["x" + d] = np.tensordot(x, dz, ((0, 1), (0, 1)))
            g["b" + d] = dz.sum(axis=(0, 1))
        return loss, g

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Article probability of every block of some pages, those of similar length side by side."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            most = len(pages[order[-1]])
            some = [order.pop() for _ in range(min(len(order), max(1, BATCH_STEPS // most)))]
            x, mask = padded([pages[i] for i in some])
            p = _sigmoid(self.forward(x, mask)[0])
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), dtype=pages[0].dtype)
    mask = np.zeros((steps, len(pages)), dtype=x.dtype)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _renamed(path, rnd: random.Random):
    """A path whose telling elements bear other names of the same kind."""
    out = []
    for depth, element in enumerate(path):
        label = told(path[: depth + 1])
        inner = told((element,))
        if inner is None or label is None:
            out.append(element)
        elif inner:
            out.append(rnd.choice((("article",), ("main",), ("div", "." + rnd.choice(MAIN_NAMES)), ("section", "." + rnd.choice(MAIN_NAMES)))))
        else:
            out.append(_side(rnd))
    return tuple(out)


def _side(rnd: random.Random) -> tuple[str, ...]:
    if rnd.random() < 0.3:
        return (rnd.choice(SIDE_TAGS[:-1]),)
    if rnd.random() < 0.15:
        return (rnd.choice(("div", "section")), "@" + rnd.choice(SIDE_ROLES))
    name = rnd.choice(SIDE_NAMES)
    extra = rnd.choice(((), (".box",), (".list",), (".wrap",), (".inner",)))
    return (rnd.choice(("div", "div", "section", "ul", "p")), "." + name, *extra)


_INNER = ((("ul",), ("li",)), (("ol",), ("li",)), (("blockquote",), ("p",)), (("h2",),), (("h3",),), (("pre",),), (("table",), ("tr",), ("td",)), (("div",), ("p",)), (("figure",), ("figcaption",)))


def _variant(page: list[tuple[Block, int | None]], filler: list[Block], rnd: random.Random) -> list[tuple[Block, int | None]]:
    """The page with renamed containers and more side matter before, between and after its blocks."""
    names: dict = {}
    rename = lambda p: names.setdefault(p, _renamed(p, rnd))
    out = []
    chance, lists = rnd.choice((0.0, 0.03, 0.1)), rnd.choice((0.0, 0.1, 0.3))
    base = (("html",), ("body",))

    def side(around) -> None:
        top = (*around, _side(rnd))
        for _ in range(rnd.randrange(1, 6)):
            b = rnd.choice(filler)
            tail = rnd.choice(((("p",),), (("li",), ("a",)), (("div",),), (("p",),), (("label",),), (("h3",),)))
            out.append((Block(top + tail, b.text, len(b.text) if ("a",) in tail else 0), 0))

    if rnd.random() < 0.5:
        side(base)
    for b, label in page:
        path = rename(b.path)
        if label == 1 and rnd.random() < lists:  # articles also hold lists, quotations, tables
            path = (*path[:-1], *rnd.choice(_INNER))
        if rnd.random() < chance:
            side(path[:3] if label == 1 else base)
        out.append((Block(path, b.text, b.linked), told(path) if label is not None else None))
    if rnd.random() < 0.5:
        side(base)
    return out


def trained(pages: list[str], seed: int = 7, epochs: int = EPOCHS) -> Labeller:
    """A labeller fitted on the told blocks of some pages and of their variants."""
    rnd = random.Random(seed)
    plain = [[(b, told(b.path)) for b in blocks(h)] for h in pages]
    plain = [p for p in plain if any(label is not None for _, label in p)]
    model = Labeller.fresh(seed)
    if not plain:
        return model
    filler = [b for p in plain for b, _ in p if len(b.text) < 2000]
    everything = plain + [_variant(p, filler, rnd) for p in plain for _ in range(VARIANTS)] if filler else plain
    data = [(vectors([b for b, _ in p]), np.array([label or 0 for _, label in p], np.float32), np.array([label is not None for _, label in p], np.float32)) for p in everything]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}
    step = 0
    for _ in range(epochs):
        rnd.shuffle(data)
        for s in range(0, len(data), 16):
            some = data[s : s + 16]
            x, mask = padded([v for v, _, _ in some])
            label, weight = np.zeros_like(mask), np.zeros_like(mask)
            for k, (v, y, w) in enumerate(some):
                # both labels of a page weigh the same, however many blocks have them
                ones, zeros = max((w * y).sum(), 1), max((w * (1 - y)).sum(), 1)
                label[: len(v), k], weight[: len(v), k] = y, w * np.where(y > 0, 1 / ones, 1 / zeros)
            _, grad = model.gradients(x, mask, label, weight)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.w[name] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(model.w[name].dtype)
    return model


def training_pages(pages: DataFrame, limit: int = TRAIN_PAGES, most_chars: int = TRAIN_CHARS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """A sample of at most ``limit`` pages of at most ``most_chars`` characters, by a hash."""
    small = pages.filter(F.length(html_col).between(1, most_chars)).select(F.xxhash64(F.col(id_col), F.col(url_col)).alias("k"), F.col(html_col).alias("h"))
    # the keys alone decide which pages are sent; a page that repeats is sent once
    keys = [r["k"] for r in small.select("k").distinct().orderBy("k").limit(limit).collect()]
    if not keys:
        return []
    rows = small.filter(F.col("k") <= keys[-1]).groupBy("k").agg(F.min("h").alias("h"))  # ``limit`` groups
    return [r["h"] for r in sorted(rows.collect(), key=lambda r: r["k"])]


def extracted_text(page: list[Block], p: np.ndarray) -> str:
    return "\n\n".join(b.text for b, x in zip(page, p.tolist()) if x >= 0.5)


def main_text(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    model = model or trained(training_pages(pages, id_col=id_col, url_col=url_col, html_col=html_col))
    weights = model.w
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        labeller = Labeller(weights)
        for batch in batches:
            n, start, held, steps = len(batch), 0, [], 0

            def flush(end):
                x = [vectors(p) for p in held]
                texts = [extracted_text(p, q) for p, q in zip(held, labeller.probabilities(x))]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

            for i, h in enumerate(batch.column(2)):
                held.append(blocks(h.as_py() or ""))
                steps += len(held[-1])
                if steps >= 4096 or i == n - 1:
                    yield flush(i + 1)
                    start, held, steps = i + 1, [], 0

    one = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return one.mapInArrow(run, f"page_id {kind}, url string, text string")
