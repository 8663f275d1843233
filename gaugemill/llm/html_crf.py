"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM, decoded by Viterbi.

A block is the text between two block-level tags. Its features are its ancestors' tags and the words of their class, id and role;
properties of the text (length, share of links, punctuation, the words of short blocks); and the containers between it and the article or
main part it stands in. Which of them tell main text is learned; neighbours act through the chain. The field is trained in numpy on a bounded sample of labelled pages:

* pages of the table with exactly one ``article`` or ``main``: what lies in it, but not in a menu, header, footer, aside or form, is main text;
* the same blocks set into other layouts (``LAYOUTS``), whose labels are known by construction, with menus, sidebars, notices, adverts,
  forms and reader comments. In half of them all names are made up, so that the field doesn't rest on names it has met;
* the table's labelled pages with a foreign container set into their main text.

The text of ``math`` and ``object`` is inline text like any other, that of ``noscript`` a block of its own. An ``svg`` is left out up to its end tag; where
a block begins or ends before that, or there is none, only its tags are. A name with a hyphen is another element.

Character references are decoded, white space in a block becomes one space, blocks of the main text are joined by line feeds.

Results: a null, empty or text-free page has an empty text. Tags that are never closed, comments and scripts that never end, and stray ``<``
are read as browsers do or as text; from the first tag on that doesn't end on the page because of a quote, quotes aren't regarded. Nothing is cut.
Very long and hostile pages take time in proportion to their length; of ancestors beyond ``DEPTH`` the innermost and outermost give features. Ties
in the decoding go to the label other. Repeated rows give repeated rows, an empty table none. A table without labelled pages trains on the layouts alone.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import texts_of

#: Bounds of the sample: pages, and characters of a page that may serve in it.
TRAIN_PAGES, TRAIN_CHARS = 120, 100_000
EPOCHS, STEPS, RATE, DECAY = 10, 4000, 0.5, 1e-4  # as many rounds as give that many steps, EPOCHS at least
#: Elements that begin and end a block, elements whose content is no text, elements without content.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW = "script|style|title|template|textarea|iframe"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another one of the same row ends.
ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
BOILERPLATE = frozenset("nav header footer aside form menu dialog select".split())
START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>")
UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
RAW_NAMES = frozenset(RAW.split("|"))
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in sorted(RAW_NAMES)}
#: Ancestors of a block that give features: the outermost, and the innermost.
DEPTH = (8, 24)
#: Elements that are part of the flow of the container they stand in.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption".split())
#: What ends a drawing: its own tags, or one of an element that can't stand in it.
DRAWING = re.compile(rf"<(/?)(?:(svg)|{'|'.join(sorted(BLOCKS))}|b|br|code|em|font|i|img|small|span|strong|sub|sup|u)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>", re.IGNORECASE)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

Path = tuple[tuple[str, tuple[str, ...]], ...]


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of the class, id and role of a tag."""
    if "=" not in attributes:
        return ()
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(a or b or c for a, b, c in NAMES.findall(attributes))).lower())
    return tuple(w.removesuffix("s") if len(w) > 3 else w for w in words)


def drawing_end(page: str, at: int) -> tuple[int, bool]:
    """Where the ``svg`` whose start tag ends at ``at`` is closed, or where it turns out that it isn't; and whether it is."""
    depth = 1
    for m in DRAWING.finditer(page, at):
        if not m[2]:
            return m.start(), False
        if m[1]:
            depth -= 1
        elif not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end(), True
    return len(page), False


def blocks(page: str) -> list[tuple[Path, str, float]]:
    """Leaf blocks in page order: ancestors from the outermost on, text, share of its characters in links."""
    out: list[tuple[Path, str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    links, linked = 0, 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((tuple(stack) if len(stack) <= sum(DEPTH) else (*stack[: DEPTH[0]], *stack[-DEPTH[1] :]), text, min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        held.append(text)
        if links:
            linked += len(text)

    at = unclosed = 0
    open_tags: Counter[str] = Counter()
    tag_of = TAG
    while m := START.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.start()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        if m[0] in ("<!", "<?"):
            if (end := page.find(">", at)) < 0:
                break
            at = end + 1
            continue
        t = tag_of.match(page, at)
        if t is None and tag_of is TAG:  # from here on quotes don't close; each later tag would look for theirs in vain
            tag_of = UNQUOTED
            t = tag_of.match(page, at)
        if t is None:  # no tag ends any more
            break
        at, tag, closing = t.end(), t[2].lower(), bool(t[1])
        if tag in RAW_NAMES and not closing:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag == "br":
            held.append(" ")
        elif tag == "svg":
            if not closing and not t[3].endswith("/") and at >= unclosed:
                end, closed = drawing_end(page, at)
                if closed:
                    at = end
                else:
                    unclosed = end
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCKS:
            close()
            if closing:
                if open_tags[tag]:
                    while stack[-1][0] != tag:
                        open_tags[stack.pop()[0]] -= 1
                    open_tags[stack.pop()[0]] -= 1
            elif tag not in VOID:
                links = 0
                while stack and tag in ENDED_BY.get(stack[-1][0], ()):
                    open_tags[stack.pop()[0]] -= 1
                stack.append((tag, names_of(t[3])))
                open_tags[tag] += 1
    if at < len(page):
        add(page[at:])
    close()
    return out


def path_features(path: Path) -> list[str]:
    found = {f"in {tag}" for tag, _ in path if tag not in ("html", "body")} | {f"named {w}" for _, words in path for w in words}
    if path:
        found |= {f"own {path[-1][0]}"} | {f"own named {w}" for w in path[-1][1]}
    return sorted(found)


def text_features(text: str, linked: float) -> list[str]:
    words = text.count(" ") + 1
    found = [f"words {min(words, 16).bit_length()}", f"linked {int(linked * 4)}"]
    if text[-1] in ".!?…\"”»":
        found.append("ends a sentence")
    if ". " in text or ", " in text:
        found.append("has clauses")
    if "©" in text:
        found.append("copyright")
    if words <= 6:
        found += [f"says {w}" for w in sorted(set(re.findall(r"[^\W\d_]{2,}", text.lower())))]
    return found


def container(path: Path) -> Path:
    """The innermost ancestor that isn't part of a text's flow, with its own ancestors."""
    n = len(path)
    while n and path[n - 1][0] in FLOW:
        n -= 1
    return path[:n]


def place_features(page: list[tuple[Path, str, float]]) -> list[list[str]]:
    """For each block of a page the containers between it and the article or main part it stands in."""
    out = []
    for path, _, _ in page:
        tags = [tag for tag, _ in container(path)]
        mark = max((k for k, tag in enumerate(tags) if tag in ("article", "main")), default=None)
        inner = set() if mark is None else {f"{tags[mark]} holds {tag}" for tag in tags[mark + 1 :]}
        out.append(sorted(inner))
    return out


def features_of(page: list[tuple[Path, str, float]]) -> list[list[str]]:
    return [path_features(path) + text_features(text, linked) + place for (path, text, linked), place in zip(page, place_features(page), strict=True)]


class Field:
    """The weights of a linear chain over two labels, 1 for main text."""

    def __init__(self, weights: dict[str, np.ndarray], start: np.ndarray, turn: np.ndarray):
        self.weights, self.start, self.turn = {k: tuple(v.tolist()) for k, v in weights.items()}, start.tolist(), turn.tolist()
        self.paths: dict[Path, tuple[float, float]] = {}

    def total(self, features: list[str]) -> tuple[float, float]:
        found = [self.weights[f] for f in features if f in self.weights]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def labels(self, page: list[tuple[Path, str, float]]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        if len(self.paths) > 50_000:
            self.paths = {}
        back, score = [], None
        for (path, text, linked), place in zip(page, place_features(page), strict=True):
            if path not in self.paths:
                self.paths[path] = self.total(path_features(path))
            p, t = self.paths[path], self.total(text_features(text, linked) + place)
            own = (p[0] + t[0], p[1] + t[1])
            if score is None:
                score = [self.start[0] + own[0], self.start[1] + own[1]]
                continue
            came = [0 if score[0] + self.turn[0][y] >= score[1] + self.turn[1][y] else 1 for y in (0, 1)]
            score = [score[came[y]] + self.turn[came[y]][y] + own[y] for y in (0, 1)]
            back.append(came)
        if score is None:
            return []
        out = [0 if score[0] >= score[1] else 1]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b[1] for b, y in zip(found, self.labels(found), strict=True) if y)


Labelled = list[tuple[Path, str, float, int]]


def labelled(page: str) -> Labelled | None:
    """Labels from a page's own marks, or None where it doesn't tell."""
    found = blocks(page)
    for mark in ("article", "main"):
        if len(re.findall(rf"<{mark}(?=[\s/>])", page, re.IGNORECASE)) == 1:
            inside = [next((i for i, (tag, _) in enumerate(path) if tag == mark), None) for path, _, _ in found]
            own = [int(i is not None and not any(t in BOILERPLATE or {"comment", "ad", "advert"} & set(n) for t, n in path[i:])) for i, (path, _, _) in zip(inside, found, strict=True)]
            return [(*b, y) for b, y in zip(found, own, strict=True)]
    return None


def path(spec: str) -> Path:
    """``main div.content p`` as ancestors."""
    return tuple((part.split(".")[0], tuple(part.split(".")[1:])) for part in ("html body " + spec).split())


#: Layouts: the places of other blocks before the main text, of the main text, and of other blocks in and after it.
LAYOUTS = [
    (["header h1", "nav ul li", "div.cookie.notice p"], ["main div.content p"], ["aside.sidebar div p", "main aside", "main aside p", "main form label", "section.comment div.comment p", "footer p"]),
    (["div.header div.logo", "div.menu ul li", "div.ad"], ["div.page div.post.body p", "div.page div.post.body h2"], ["div.page div.related li", "div.comment ol li p", "div.footer"]),
    (["header div", "nav.main li"], ["div.wrapper article.post h1", "div.wrapper article.post p"], ["div.wrapper article.post aside p", "div.wrapper article.post section.comment p", "form.newsletter div", "footer div"]),
    (["div.top.bar", "div.nav li", "div.banner.advert p"], ["div.entry.content p", "div.entry.content blockquote", "div.entry.content ul li"], ["div.sidebar.widget li", "div.share", "div.cookie.consent p", "div.copyright"]),
    (["table tr td.nav"], ["table tr td.content p"], ["table tr td.sidebar", "form p", "table tr td.footer"]),
    (["header nav ul li"], ["section.article div.text p", "section.article h1"], ["section.article div.ad p", "div.reader.comment p", "div.promo", "footer ul li"]),
    (["div.cookie.banner"], ["div.main.content h2", "div.main.content p", "div.main.content ul li"], ["div.sidebar ul li", "div.comment div.comment.body", "div.footer p"]),
    ([], ["p", "h1", "div p"], []),
    (["nav ul li", "div.ad"], ["article h1", "article p"], ["article div.comment p", "article div.ad", "article footer p", "footer"]),
]
FILLER = ["A first plain sentence, with a clause, that tells of something.", "And then there is another one. It ends here.", "A third, to go on with."]
OTHER_FILLER = ["Home", "About us", "© a company", "Sign up for more."]


def shortened(texts: list[str], rng: np.random.Generator) -> list[str]:
    """A quarter of the texts cut to their first word: the main text has short blocks too."""
    return [t.split(" ")[0] if rng.random() < 0.25 else t for t in texts]


def in_layout(layout: tuple, main: list[str], other: list[str], rng: np.random.Generator) -> Labelled:
    before, places, after = layout
    pick = lambda: other[rng.integers(len(other))]
    out: Labelled = []
    for spec in before:
        out += [(path(spec), pick(), float("li" in spec.split()), 0) for _ in range(rng.integers(1, 5) if "li" in spec.split() else 1)]
    for i, text in enumerate(shortened(main, rng)):
        out.append((path(places[0] if i == 0 else places[rng.integers(len(places))]), text, 0.0, 1))
    for spec in after:
        # comments and adverts may read like the main text
        out += [(path(spec), main[rng.integers(len(main))] if rng.random() < 0.3 else pick(), 0.0, 0) for _ in range(rng.integers(1, 4))]
    return out


def interrupted(page: Labelled, other: list[str], rng: np.random.Generator) -> Labelled:
    """A page with a foreign container inside its main text's or behind it: a notice, an advert or comments, which may read like the main text."""
    own = [i for i, b in enumerate(page) if b[3]]
    home = container(page[own[0]][0])
    at = own[-1] + 1 if rng.random() < 0.7 else own[rng.integers(len(own))]
    mains = {w for _, places, _ in LAYOUTS for spec in places for _, names in path(spec) for w in names}
    met = [w for _, _, after in LAYOUTS for spec in after for _, names in path(spec) for w in names if w not in mains]
    name = met[rng.integers(len(met))] if rng.random() < 0.5 else "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    outer = (("div", "section", "aside")[rng.integers(3)], (name,))
    main = [b[1] for b in page if b[3]]
    rows = []
    for _ in range(rng.integers(1, 4)):
        inner = ((), (("p", ()),), (("div", ()), ("p", ())), (("ul", ()), ("li", ())))[rng.integers(4)]
        text = main[rng.integers(len(main))] if rng.random() < 0.5 else other[rng.integers(len(other))]
        rows.append(((*home, outer, *inner), text, 0.0, 0))
    return [*page[:at], *rows, *page[at:]]


def renamed(page: Labelled, rng: np.random.Generator) -> Labelled:
    """Half of the pages with made-up words for all their names: nothing is to be learned from them but that names differ."""
    if rng.random() < 0.5:
        return page
    made: dict[str, str] = {}
    new = lambda w: made.setdefault(w, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)))
    return [(tuple((tag, tuple(map(new, names))) for tag, names in path), *rest) for path, *rest in page]


def held_out(pages: list[str], family: int, seed: int = 5) -> tuple[int, int, int]:
    """(right main blocks, found main blocks, true main blocks) on a layout that training hasn't seen, with made-up names."""
    rng = np.random.default_rng(seed)
    field = fit(pages, seed, [x for i, x in enumerate(LAYOUTS) if i != family])
    right = found = true = 0
    for page in pages:
        known = labelled(page) or []
        main, other = ([b[1] for b in known if b[3] == y] for y in (1, 0))
        test = in_layout(LAYOUTS[family], (main or FILLER)[:12], other or OTHER_FILLER, rng)
        made = {w: f"zq{i}x" for i, w in enumerate(sorted({w for p, *_ in test for _, names in p for w in names}))}
        test = [(tuple((tag, tuple(made[w] for w in names)) for tag, names in p), *rest) for p, *rest in test]
        got = field.labels([b[:3] for b in test])
        right += sum(g and b[3] for g, b in zip(got, test, strict=True))
        found, true = found + sum(got), true + sum(b[3] for b in test)
    return right, found, true


def fit(pages: list[str], seed: int = 5, layouts: list[tuple] | None = None) -> Field:
    """Train on the labelled ones of ``pages`` and on layouts of their blocks."""
    rng, layouts = np.random.default_rng(seed), LAYOUTS if layouts is None else layouts
    data: list[Labelled] = []
    for page in pages:
        known = labelled(page)
        main, other = ([b[1] for b in known or () if b[3] == y] for y in (1, 0))
        if known and main:
            brief = shortened([b[1] for b in known], rng)
            data += [known, [(b[0], t if b[3] else b[1], b[2], b[3]) for b, t in zip(known, brief, strict=True)], *(interrupted(known, other or OTHER_FILLER, rng) for _ in range(2))]
        data += [renamed(in_layout(layouts[i], (main or FILLER)[:12], other or OTHER_FILLER, rng), rng) for i in rng.choice(len(layouts), min(3, len(layouts)), replace=False)]
    if not data:
        data = [renamed(in_layout(layout, FILLER[: rng.integers(1, 4)], OTHER_FILLER, rng), rng) for layout in layouts for _ in range(40)]
    index: dict[str, int] = {}
    chains = []
    for page in data:
        rows = [np.array([index.setdefault(f, len(index)) for f in found]) for found in features_of([b[:3] for b in page])]
        chains.append((rows, np.array([y for *_, y in page])))
    weights, start, turn = np.zeros((len(index), 2)), np.zeros(2), np.zeros((2, 2))
    spread = [np.full_like(x, 1e-2) for x in (weights, start, turn)]
    rounds, kept = max(EPOCHS, STEPS // len(chains)), [np.zeros_like(x) for x in (weights, start, turn)]
    for epoch in range(rounds):
        for i in rng.permutation(len(chains)):
            rows, gold = chains[i]
            own = np.array([weights[r].sum(axis=0) for r in rows])
            one, two = marginals(own, start, turn)
            target = np.eye(2)[gold]
            slope = one - target
            turns = two - np.array([[np.sum((gold[:-1] == a) & (gold[1:] == b)) for b in (0, 1)] for a in (0, 1)])
            flat, near = np.concatenate(rows), np.repeat(slope, [len(r) for r in rows], axis=0)
            change = np.zeros_like(weights)
            np.add.at(change, flat, near)
            for x, g, s in zip((weights, start, turn), (change + DECAY * weights, slope[0], turns), spread, strict=True):
                s += g * g
                x -= RATE * g / np.sqrt(s)
        if 2 * epoch >= rounds:  # the mean of the later rounds is steadier than the last
            for total, x in zip(kept, (weights, start, turn), strict=True):
                total += x / (rounds - (rounds + 1) // 2)
    return Field({f: kept[0][i] for f, i in index.items()}, kept[1], kept[2])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(own: np.ndarray, start: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums: the odds of each label at each block, and the expected number of each turn."""
    n = len(own)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = start + own[0]
    for t in range(1, n):
        ahead[t] = log_sum(ahead[t - 1][:, None] + turn, 0) + own[t]
    for t in range(n - 2, -1, -1):
        behind[t] = log_sum(turn + own[t + 1] + behind[t + 1], 1)
    whole = log_sum(ahead[-1], 0)
    pairs = ahead[:-1, :, None] + turn + (own[1:] + behind[1:])[:, None, :] - whole
    return np.exp(ahead + behind - whole), np.exp(pairs).sum(axis=0)


def train(pages: DataFrame, limit: int = TRAIN_PAGES) -> Field:
    """Fit on the ``limit`` pages whose ids hash lowest, among those of at most ``TRAIN_CHARS`` characters."""
    short = pages.select("page_id", "html").filter(F.length("html") <= TRAIN_CHARS)
    chosen = short.select(F.col("page_id").alias("id"), F.xxhash64("page_id").alias("order")).orderBy("order", "id").limit(limit)  # ids alone, so tasks send little
    rows = short.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("id"))).select("order", "html").distinct().collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: (r["order"], r["html"]))[:limit]])


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(field)

    def batches(frames):
        for frame in frames:
            found = [sent.value.text(h) for h in texts_of(frame.column(2))]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(batches, slim.drop("html").schema.add("text", "string").add("n_chars", "long"))
