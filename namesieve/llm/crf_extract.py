"""Main text of pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks; each has binary features of its ancestors, its own tag and its text. The field has
two states, main text or not, weights for features and for neighbouring states (one set for neighbours of one parent
element, one for others), and is trained by gradient ascent on the likelihood of labelled pages. Pages are decoded by
Viterbi, in tasks, where they are read: nothing is shuffled.

Labelled pages: of a bounded sample of ``TRAIN_PAGES`` pages, those that mark their article by a tag give their text
and their own labels. Their texts are then dressed in the layouts of ``layouts`` (tags only, names only or neither;
menus, headers, footers, sidebars, notices, adverts, forms and reader comments before, after and within the article),
whose labels are known as they are made. Only the weights depend on the sample, and every page is decoded whole.

Defined results: a null or empty page, and one without blocks, has the empty text and 0 characters; repeated rows
and null ids or URLs are carried through; an empty table trains on filler text and gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.html_blocks import FEATURES, Block, blocks

TRAIN_PAGES = 150
#: Blocks of a training page beyond which it is not learned from.
TRAIN_BLOCKS = 80
STEPS = 120
RATE = 0.15
PENALTY = 1e-3
SEED = 7

Labelled = tuple[list[Block], list[int]]

_NOT_TEXT = ("nav", "footer", "aside", "form", "dialog", "button")


def _is_article(block: Block) -> bool:
    has = lambda *names: any(block.bits >> FEATURES.index(n) & 1 for n in names)
    others = ("named advert", "named comment", "named notice", "named social", "inner article")
    return has("article") and not has(*_NOT_TEXT, *others)


def labelled(page: str) -> Labelled | None:
    """The page's blocks with the labels that its own article element gives, if it has one."""
    found = blocks(page)
    labels = [int(_is_article(b)) for b in found]
    return (found, labels) if any(labels) and len(found) <= TRAIN_BLOCKS else None


class _Page:
    """A page being made: parts of markup with the label of their text."""

    def __init__(self, chance: random.Random, lines: list[str], style: str):
        self.chance, self.lines, self.style = chance, lines, style
        self.parts: list[str] = []
        self.texts: list[tuple[str, int]] = []

    def line(self, most: int | None = None) -> str:
        words = self.chance.choice(self.lines).split()
        return " ".join(words[: most or len(words)])

    def box(self, tag: str, names: tuple[str, ...], body) -> None:
        """An element; whether it shows its kind by its tag, by its names or not at all is the page's style."""
        shown = self.style == "both" or (self.chance.random() < 0.5 if self.style == "mixed" else self.style == "tags")
        named = self.style == "both" or (not shown if self.style == "mixed" else self.style == "names")
        name = self.chance.choice(names)
        kind = self.chance.choice(("class", "class", "id"))
        tag = tag if shown else "div"
        self.parts.append(f'<{tag} {kind}="{name}">' if named else f"<{tag}>")
        body()
        self.parts.append(f"</{tag}>")

    def say(self, text: str, label: int, tag: str = "p", link: bool = False) -> None:
        if not (text := " ".join(text.split())):
            return
        inner = html.escape(text, quote=False)
        if link:
            inner = f'<a href="/x">{inner}</a>'
        self.parts.append(f"<{tag}>{inner}</{tag}>")
        self.texts.append((text, label))


def _menu(p: _Page) -> None:
    def items() -> None:
        p.parts.append("<ul>")
        for _ in range(p.chance.randint(2, 7)):
            p.say(p.line(p.chance.randint(1, 3)), 0, "li", True)
        p.parts.append("</ul>")

    p.box("nav", ("nav", "menu", "main-nav", "navbar", "breadcrumbs", "site-menu"), items)


def _top(p: _Page) -> None:
    def body() -> None:
        p.say(p.line(3), 0, p.chance.choice(("div", "p", "h1", "h2")), p.chance.random() < 0.4)
        if p.chance.random() < 0.6:
            p.say(p.line(9), 0)

    p.box("header", ("header", "site-header", "masthead", "top-bar", "branding"), body)


def _bottom(p: _Page) -> None:
    def body() -> None:
        p.say(p.chance.choice(("© ", "Copyright ", "")) + p.line(8), 0, p.chance.choice(("p", "div")))
        for _ in range(p.chance.randint(0, 3)):
            p.say(p.line(2), 0, "li", True)

    p.box("footer", ("footer", "site-footer", "page-footer", "legal", "colophon"), body)


def _side(p: _Page) -> None:
    def body() -> None:
        p.say(p.line(3), 0, p.chance.choice(("h2", "h3", "h4")))
        for _ in range(p.chance.randint(1, 4)):
            p.say(p.line(p.chance.randint(3, 12)), 0, p.chance.choice(("p", "li")), p.chance.random() < 0.5)

    p.box("aside", ("sidebar", "side", "widget", "related", "popular-posts", "right-rail", "recommended"), body)


def _advert(p: _Page) -> None:
    names = ("ad", "ads", "advert", "ad-slot", "advertisement", "sponsored", "promo", "banner-ad")
    style, p.style = p.style, "names"  # adverts have no tag of their own
    p.box("div", names, lambda: p.say(p.line(), 0, p.chance.choice(("p", "div", "span"))))
    p.style = style


def _notice(p: _Page) -> None:
    names = ("cookie-notice", "cookie-banner", "notice", "consent", "alert", "newsletter", "gdpr", "popup", "paywall")
    style, p.style = p.style, "names"

    def body() -> None:
        extra = p.chance.choice(("", "We use cookies. ", "Subscribe to our newsletter. ", "Sign in. "))
        p.say(extra + p.line(p.chance.randint(5, 25)), 0, p.chance.choice(("p", "div")))
        if p.chance.random() < 0.5:
            p.say(p.line(1), 0, "button")

    p.box("div", names, body)
    p.style = style


def _form(p: _Page) -> None:
    def body() -> None:
        p.parts.append("<form>")
        p.say(p.line(p.chance.randint(1, 12)), 0, p.chance.choice(("label", "p", "div", "legend")))
        p.parts.append('<input name="q">')
        p.say(p.line(1), 0, "button")
        p.parts.append("</form>")

    p.box("div", ("search", "login", "contact-form", "signup", "form"), body)


def _comments(p: _Page) -> None:
    inner = p.chance.choice(("div", "li", "article", "section"))

    def body() -> None:
        p.say(p.line(2), 0, p.chance.choice(("h2", "h3")))
        for _ in range(p.chance.randint(1, 4)):
            p.parts.append(f'<{inner} class="{p.chance.choice(("comment", "reply", "comment-body"))}">')
            p.say(p.line(2), 0, p.chance.choice(("div", "h4", "p")))
            p.say(p.line(), 0)
            p.parts.append(f"</{inner}>")

    style, p.style = p.style, "names"  # comments have no tag of their own
    p.box("section", ("comments", "comment-list", "discussion", "responses", "disqus_thread", "reviews"), body)
    p.style = style


def _article(p: _Page, inside: tuple) -> None:
    def body() -> None:
        title = p.line(p.chance.randint(4, 10))
        if p.chance.random() < 0.25:
            p.parts.append("<header>")
            p.say(title, 1, "h1")
            p.parts.append("</header>")
        elif p.chance.random() < 0.85:
            p.say(title, 1, "h1")
        for _ in range(p.chance.randint(2, 9)):
            draw = p.chance.random()
            if draw < 0.12:
                p.say(p.line(p.chance.randint(2, 6)), 1, p.chance.choice(("h2", "h3")))
            elif draw < 0.2:
                p.parts.append("<ul>")
                for _ in range(p.chance.randint(2, 4)):
                    p.say(p.line(p.chance.randint(2, 15)), 1, "li")
                p.parts.append("</ul>")
            elif draw < 0.26:
                p.say(p.line(), 1, p.chance.choice(("blockquote", "pre", "td")))
            elif draw < 0.36:
                p.say(p.line(p.chance.randint(2, 7)), 1)
            elif draw < 0.44:
                p.parts.append("<section>" if p.chance.random() < 0.5 else "<div>")
                p.say(p.line(), 1, p.chance.choice(("p", "div")))
                p.say(p.line(), 1, p.chance.choice(("p", "div")))
                p.parts.append("</section>" if p.parts[-3] == "<section>" else "</div>")
            else:
                p.say(p.line(), 1)
            if inside and p.chance.random() < 0.2:
                p.chance.choice(inside)(p)

    names = ("article", "content", "post", "entry-content", "story-body", "main-content", "article-body", "post-content")
    if p.chance.random() < 0.2:
        p.parts.append("<main>")
        p.box("section", names, body)
        p.parts.append("</main>")
    else:
        p.box(p.chance.choice(("article", "article", "main")), names, body)


def layouts(lines: list[str], n: int, seed: int = SEED) -> Iterator[Labelled]:
    """``n`` pages made of these lines, with labels."""
    chance = random.Random(seed)
    for _ in range(n):
        p = _Page(chance, lines, chance.choice(("both", "tags", "names", "mixed", "plain")))
        before = [f for f in (_notice, _top, _menu, _form, _advert, _side) if chance.random() < 0.5]
        after = [f for f in (_comments, _side, _advert, _form, _notice, _bottom) if chance.random() < 0.5]
        if p.style == "plain":  # nothing shows what is what but the texts, so nothing that reads like an article
            before, after = [f for f in before if f in (_menu, _top)], [f for f in after if f is _bottom]
        chance.shuffle(before)
        for part in before:
            part(p)
        _article(p, () if p.style == "plain" else (_advert, _side, _notice, _form, _comments))
        for part in after:
            part(p)
        found = blocks("<html><body>" + "".join(p.parts) + "</body></html>")
        if len(found) <= TRAIN_BLOCKS and [b.text for b in found] == [t for t, _ in p.texts]:
            yield found, [label for _, label in p.texts]


def _features(found: list[Block]) -> np.ndarray:
    bits = np.array([b.bits for b in found], "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(bits, axis=1, bitorder="little")[:, : len(FEATURES)]


def _same(found: list[Block]) -> np.ndarray:
    """Whether a block has the parent of the block before."""
    parents = np.array([b.parent for b in found])
    return np.r_[0, (parents[1:] == parents[:-1]).astype(int)]


class Field:
    """Weights of the features for the state "main text", and of neighbouring states."""

    def __init__(self):
        self.weights = np.zeros(len(FEATURES))
        self.moves = np.zeros((2, 2, 2))  # same parent, state before, state

    def train(self, pages: list[Labelled]) -> Field:
        """Maximise the penalised mean log-likelihood (Adam), pages padded to one length."""
        pages = [p for p in pages if p[0]]
        if not pages:
            return self
        n, longest = len(pages), max(len(b) for b, _ in pages)
        x = np.zeros((n, longest, len(FEATURES)), np.float32)
        y, same, real = (np.zeros((n, longest), int) for _ in range(3))
        for i, (found, labels) in enumerate(pages):
            size = len(found)
            x[i, :size], y[i, :size], same[i, :size], real[i, :size] = _features(found), labels, _same(found), 1
        last = real.sum(axis=1) - 1
        flat = x.reshape(n * longest, -1)
        parameters = np.zeros(len(FEATURES) + 8)
        mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
        pairs = np.eye(2)[y[:, :-1]][:, :, :, None] * np.eye(2)[y[:, 1:]][:, :, None, :] * real[:, 1:, None, None]
        kind = np.eye(2)[same[:, 1:]]
        seen_moves = np.einsum("ntk,ntab->kab", kind, pairs)
        for step in range(1, STEPS + 1):
            w, moves = parameters[:-8], parameters[-8:].reshape(2, 2, 2)
            emit = np.zeros((n, longest, 2))
            emit[:, :, 1] = (flat @ w).reshape(n, longest)
            ahead = np.zeros((n, longest, 2))
            ahead[:, 0] = emit[:, 0]
            for t in range(1, longest):
                come = ahead[:, t - 1, :, None] + moves[same[:, t]]
                new = np.logaddexp(come[:, 0], come[:, 1]) + emit[:, t]
                ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
            back = np.zeros((n, longest, 2))
            for t in range(longest - 2, -1, -1):
                go = moves[same[:, t + 1]] + (emit[:, t + 1] + back[:, t + 1])[:, None, :]
                back[:, t] = np.where(real[:, t + 1, None], np.logaddexp(go[:, :, 0], go[:, :, 1]), 0)
            total = np.logaddexp.reduce(ahead[np.arange(n), last], axis=1)
            inside = np.where(real[:, :, None], ahead, 0)
            chance = np.exp(inside + back - total[:, None, None])[:, :, 1] * real
            together = np.exp(
                inside[:, :-1, :, None] + moves[same[:, 1:]] + (emit + back)[:, 1:, None, :] - total[:, None, None, None]
            )
            expected = np.einsum("ntk,ntab->kab", kind * real[:, 1:, None], np.where(real[:, 1:, None, None], together, 0))
            up = np.r_[flat.T @ ((y - chance) * real).ravel(), (seen_moves - expected).ravel()] / n
            up -= PENALTY * parameters
            mean = 0.9 * mean + 0.1 * up
            square = 0.99 * square + 0.01 * up * up
            parameters = parameters + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = parameters[:-8], parameters[-8:].reshape(2, 2, 2)
        return self

    def decode(self, found: list[Block]) -> list[int]:
        """The most likely states (Viterbi); 0 wins a tie."""
        if not found:
            return []
        emit = (_features(found) @ self.weights).tolist()
        moves, same = self.moves.tolist(), _same(found).tolist()
        zero, one = 0.0, emit[0]
        origin: list[tuple[int, int]] = []
        for e, s in zip(emit[1:], same[1:]):
            (a, b), (c, d) = moves[s]
            zero_from, one_from = int(one + c > zero + a), int(one + d > zero + b)
            origin.append((zero_from, one_from))
            zero, one = (one + c if zero_from else zero + a), (one + d if one_from else zero + b) + e
        state = int(one > zero)
        states = [state]
        for before in reversed(origin):
            state = before[state]
            states.append(state)
        return states[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, s in zip(found, self.decode(found)) if s)


FILLER = [
    "The morning was clear, and the boats went out before the tide had turned.",
    "Nobody had expected the harvest to be so good after a summer with so little rain.",
    "A short walk leads from the old bridge to the market, where most people meet on Saturdays.",
    "They wrote down what they had seen, page after page, and sent it home.",
    "It took years.",
]


def fit(pages: list[str], seed: int = SEED) -> Field:
    """A field trained on these pages' own labels and on layouts made of their texts."""
    own = [x for x in map(labelled, pages) if x]
    lines = sorted({b.text for found, labels in own for b, y in zip(found, labels) if y})
    made = list(layouts(lines or FILLER, 3 * TRAIN_PAGES, seed))
    return Field().train(own + made)


def sample(pages: DataFrame, id_col: str, html_col: str, n: int = TRAIN_PAGES) -> list[str]:
    """Up to ``n`` pages with the smallest ids, ties in the order of their markup."""
    known = pages.where(F.col(id_col).isNotNull() & (F.length(html_col) > 0))
    ids = [r[0] for r in known.select(id_col).orderBy(id_col).limit(n).collect()]
    if not ids:
        return []
    rows = known.where(F.col(id_col) <= ids[-1]).select(html_col).orderBy(id_col, F.xxhash64(html_col)).limit(n)
    return [r[0] for r in rows.collect()]


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None
) -> DataFrame:
    """Id, URL, main text and its number of characters, for every page."""
    if field is None:
        field = fit(sample(pages, id_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [field.extract(x.as_py()) for x in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["id", "url", "text", "n_chars"]
            )

    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
