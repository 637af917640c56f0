"""Main text of web pages by equivalence-class template deduction.

Pages of one host are read together, in groups of bounded size. A page is a sequence of
tokens: tags with the path of elements they stand in, and blocks of text. Tokens that most of
the group's pages have, and that occur equally often on each page, share an occurrence vector and form
an equivalence class. A class is valid if its tokens keep one order on the pages and all its
occurrences fall into one gap of the class around it; valid classes nest into a template. What
stands in the gaps is data. The slots inside the article, without menus, notices, comments
and the like, are the page's main text; blocks that belong to the template are not.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import lean

#: Pages of one host that a template is deduced from, and the characters held at a time, about. Halves of what is held
#: are groups, so that none is a short tail.
GROUP_PAGES, GROUP_CHARS = 64, 8_000_000
#: Different pages that it takes for text blocks to be called template, and the share of a group's pages that have them.
LEAST_PAGES, SUPPORT = 4, 0.8
#: Hosts with over a HOT-th of all pages, which are HOT at most, are dealt to several tasks, PIECE pages at least to each.
HOT, PIECE = 4096, 512

# Elements of HTML by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp"}
OUTSIDE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "canvas", "audio", "video"}
MAIN = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Parts of class, id and role values that mark what is not the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie",
    "cookies", "disclaimer", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup",
    "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

#: Last parts of class tokens that state how a mark is (comments-open).
STATES = {"active", "closed", "disabled", "enabled", "layout", "off", "on", "open"}
#: Marks of what often lists articles of its own, such as comments and teasers.
LISTS = {"comment", "comments", "disqus", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "sponsor", "sponsored"}
#: How far an element is outside of what counts: by its marks, by marks of LISTS, by what it is.
MARKED, LISTED, NEVER = 1, 2, 3

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*+(?:>|\Z))""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


@dataclass
class Block:
    path: str
    inside: int  # 1 in a main element, 2 in an article
    outside: int
    place: int
    text: str
    reset: int = 0  # how far the elements around its article were outside


@dataclass
class Page:
    tokens: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _mark(token: str) -> int:
    """Whether a class, id or role says that its element is outside: it is a mark, or begins with one. Other parts say too little."""
    parts = [w.lower() for w in _WORDS.findall(token)]
    while len(parts) > 1 and len(parts[0]) == 1:  # c-sidebar, l-sidebar
        del parts[0]
    if not parts or parts[0] not in MARKS or len(parts) > 1 and parts[-1] in STATES:
        return 0
    return LISTED if parts[0] in LISTS else MARKED


def _outside(name: str, attrs: str, inside: int) -> int:
    if name in OUTSIDE or name == "header" and not inside:
        return NEVER
    if len(attrs) < 4 or name in ("html", "body", *MAIN):
        return 0
    most = 0
    for key, *values in _ATTRIBUTE.findall(attrs):
        value = "".join(values)
        if key.lower() == "hidden" or key.lower() == "aria-hidden" and value.lower() == "true":
            return NEVER
        most = max([most, *map(_mark, value.split())])
    return most


def read_page(source: str) -> Page:
    """Tokens and text blocks of a page; broken and unfinished markup is read as browsers do, roughly."""
    page, at = Page(), 0
    stack: list[tuple[str, str, int, int, int]] = [("", "", 0, 0, 0)]  # name, path, inside, outside and reset as in a Block
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                _, path, inside, outside, reset = stack[-1]
                page.blocks.append(Block(path, inside, outside, len(page.tokens), text, reset))
                page.tokens.append(f"{path} {text}")

    def close(upto: int) -> None:
        flush()
        for _, path, *_ in stack[:upto - 1:-1]:
            page.tokens.append(f"/{path}")
        del stack[upto:]

    while True:
        found = _TAG.search(source, at)
        text = source[at : found.start()] if found else source[at:]
        if text:
            held.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        if not (name := found["name"]):
            held.append(found["cdata"] or "")
            continue
        name = name.lower()
        if found["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in BLOCKS or any(x[0] in BLOCKS or x[3] != stack[i - 1][3] for x in stack[i:]):
                        close(i)
                    else:
                        del stack[i:]
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # a stray end of an inline element closes no block
            continue
        attrs = found["attrs"].rstrip(">")
        if name in RAW:
            end = re.compile(rf"(?i)</{name}\b[^>]*(?:>|\Z)").search(source, at)
            at = end.end() if end else len(source)
            page.tokens.append(f"{stack[-1][1]}/{name}")
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            flush()
            # what a block ends by starting: a paragraph, an item or a cell of the same list or row
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            page.tokens.append(f"{stack[-1][1]}/{name}")
            continue
        _, path, inside, outside, reset = stack[-1]
        now = max(outside, _outside(name, attrs, inside)) if outside < NEVER else outside
        if name in MAIN and MARKED <= now < NEVER:  # marks exclude no article in them
            if name == "article":
                reset = max(reset, now)
            now = 0
        if now != outside:
            flush()
        if name in BLOCKS or now != outside:
            path = f"{path}/{name}"
            page.tokens.append(path)
        stack.append((name, path, max(inside, 1 + (name == "article") if name in MAIN and not now else 0), now, reset))
    close(1)
    return page


def equivalence_classes(pages: list[list[str]], support: float = SUPPORT) -> dict[tuple[int, ...], list[str]]:
    """Tokens by occurrence vector, how often they stand on each page; those that a ``support`` of all pages have."""
    counts = [Counter(p) for p in pages]
    having = Counter(token for c in counts for token in c)
    classes = defaultdict(list)
    for token, n in having.items():
        if n >= support * len(pages):
            classes[tuple(c[token] for c in counts)].append(token)
    return classes


@dataclass
class Template:
    """A class in order, and the classes nested in its gaps, by gap."""

    tokens: list[str]
    nested: dict[int, list[Template]]

    def all_tokens(self) -> set[str]:
        return set(self.tokens).union(*(t.all_tokens() for ts in self.nested.values() for t in ts))


def _increasing(row: list[int]) -> set[int]:
    """The members of a longest increasing run of ``row``, other members between them or not."""
    ends: list[int] = []
    at: list[int] = []  # index in row of the least end of runs of each length
    before: list[int] = []
    for i, v in enumerate(row):
        k = bisect_left(ends, v)
        before.append(at[k - 1] if k else -1)
        ends[k:k + 1], at[k:k + 1] = [v], [i]
    found, i = set(), at[-1] if at else -1
    while i >= 0:
        found.add(row[i])
        i = before[i]
    return found


def _ordered(once: list[str], pages: list[dict[str, list[int]]], support: float) -> list[str]:
    """``once`` in the order that the pages have them in, without those that stand elsewhere on too many."""
    rows = [sorted((t for t in once if t in p), key=lambda t, p=p: p[t][0]) for p in pages]
    # the mean place, measured by the tokens that are on all pages, says the order
    anchors = {t for t in once if all(t in p for p in pages)}
    place, having = Counter(), Counter()
    for row in rows:
        n = 0
        for k, t in enumerate(row):
            n += t in anchors
            place[t] += n + k / (len(row) + 1)
            having[t] += 1
    order = sorted(once, key=lambda t: place[t] / having[t])
    rank = {t: i for i, t in enumerate(order)}
    fine = Counter(k for row in rows for k in _increasing([rank[t] for t in row]))
    return [t for t in order if fine[rank[t]] >= support * len(pages)]


def deduce(pages: list[list[str]], support: float = SUPPORT) -> Template:
    """Nest the valid classes of some pages into a template; the outermost holds what occurs once a page that has it."""
    places = [defaultdict(list) for _ in pages]
    classes = equivalence_classes(pages, support)
    wanted = {t for ts in classes.values() for t in ts}
    for page, place in zip(pages, places, strict=True):
        for i, token in enumerate(page):
            if token in wanted:
                place[token].append(i)
    once = [t for vector in [v for v in classes if max(v) == 1] for t in classes.pop(vector)]
    root = _ordered(once, places, support)
    template = Template(root, defaultdict(list))
    # places and numbers of the root's tokens that a page has
    cuts = [[(p[t][0], i) for i, t in enumerate(root) if t in p] for p in places]
    for cut in cuts:
        cut.sort()
    for vector, tokens in classes.items():
        if len(tokens) < 2:
            continue
        low, high, bad = 0, len(root), 0
        order = sorted(tokens, key=lambda t, p=places[next(i for i, n in enumerate(vector) if n)]: p[t][0])
        for place, cut, n in zip(places, cuts, vector, strict=True):
            spots = [place[t] for t in order] if n else []
            turn = [s[k] for k in range(n) for s in spots]
            if not turn:
                continue
            at = bisect_left(cut, (turn[0], 0))
            # a round of all tokens, again and again, with nothing of the root between the first and the last
            if at != bisect_left(cut, (turn[-1], 0)) or not all(a < b for a, b in zip(turn, turn[1:], strict=False)):
                bad += 1
                continue
            left, right = cut[at - 1][1] + 1 if at else 0, cut[at][1] if at < len(cut) else len(root)
            if max(low, left) > min(high, right):
                bad += 1
                continue
            low, high = max(low, left), min(high, right)
        if sum(n > 0 for n in vector) - bad >= support * len(pages):
            template.nested[low].append(Template(order, defaultdict(list)))
    return template


def main_blocks(page: Page) -> list[Block]:
    """Blocks in an article or main element; without one, all that are not outside of what counts.

    Articles in marked elements count if no other article does; those among comments and the like only if nothing else is left.
    """
    left = [b for b in page.blocks if not b.outside]
    inner = [b for b in left if b.inside]
    own = [b for b in inner if not b.reset]
    marked = [b for b in inner if b.reset == MARKED]
    if own:
        return own if any(b.inside == 2 for b in own) else [b for b in inner if b.reset <= MARKED]
    beside = [b for b in left if not b.reset]
    beside = [b for b in beside if "/body" in b.path] or beside
    if marked and sum(len(b.text) for b in marked) < sum(len(b.text) for b in beside):
        return sorted(marked + beside, key=lambda b: b.place)
    return marked or beside or inner


def _different(blocks: list[list[Block]], places: list[str]) -> list[int]:
    """Pages to learn from: of each text one, and of one path's the versions that are not mostly what others of it hold."""
    texts, known, chosen = set(), defaultdict(set), []
    for i, (own, place) in enumerate(zip(blocks, places, strict=True)):
        text = " ".join(b.text for b in own)
        if not text or text in texts:
            continue
        texts.add(text)
        seen = known[re.sub(r"[?#].*", "", place)]
        old = [b.text for b in own if b.text in seen]
        if 2 * len(old) <= len(own) or 2 * sum(map(len, old)) <= sum(len(b.text) for b in own):
            chosen.append(i)
            seen.update(b.text for b in own)
    return chosen


def extract(sources: list[str], places: list[str], shared: bool = True, known: set[str] | None = None) -> list[str]:
    """Main texts of pages of one host; ``places``: their URLs. Copies of a page count once.

    ``known`` holds the template of the host's group before; it serves if these are too few, and is replaced otherwise.
    """
    pages = [read_page(s) for s in sources]
    blocks = [main_blocks(p) for p in pages]
    fixed: set[str] = known if known is not None else set()
    if shared:
        chosen = _different(blocks, places)
        if len(chosen) >= LEAST_PAGES:
            found = deduce([pages[i].tokens for i in chosen]).all_tokens()
            fixed.clear()
            fixed |= found
    return [" ".join(b.text for b in own if p.tokens[b.place] not in fixed) for p, own in zip(pages, blocks, strict=True)]


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size, key = 0, None
    known: set[str] = set()

    def done(rows: list[tuple]) -> pa.RecordBatch:
        texts = extract([h[3] for h in rows], [h[2] or str(h[1]) for h in rows], bool(key[0]), known)
        return pa.RecordBatch.from_arrays([pa.array([h[1] for h in rows], pa.int64()), pa.array([h[2] for h in rows], pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    for batch in batches:
        for host, piece, page_id, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and key != (host, piece):
                for rows in _groups(held):
                    yield done(rows)
                held, size = [], 0
                known.clear()
            elif len(held) >= 2 * GROUP_PAGES or size > GROUP_CHARS and len(held) >= 4 * LEAST_PAGES:
                half = len(held) // 2
                yield done(held[:half])
                held = held[half:]
                size = sum(len(h[3]) for h in held)
            key = (host, piece)
            held.append((host, page_id, url, source))
            size += len(source)
    for rows in _groups(held):
        yield done(rows)


def _groups(held: list[tuple]) -> list[list[tuple]]:
    """The rest of a host: one group, or two of one size."""
    half = len(held) // 2 if len(held) > GROUP_PAGES else len(held)
    return [g for g in (held[:half], held[half:]) if g]


def main_text(pages: DataFrame, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """Main text of every page.

    Reads page_id (long), url and html of ``pages``; other columns are ignored. Returns page_id,
    url, text (empty if there is none) and n_chars (its code points), a row for each row. A null or empty html
    has no text. Pages without a host in their url are read one by one. Repeated rows are kept and count
    once for the template. White space in a block becomes one space, and blocks are joined by one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    rows = rows.withColumn("host", host)
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(piece, total // hot)
    large = sizes.where(F.col("n") > most).select(F.col("host").alias("large"), F.ceil(F.col("n") / F.lit(most)).cast("int").alias("pieces"))  # at most ``hot``
    dealt = rows.join(F.broadcast(large), F.col("host") == F.col("large"), "left").withColumn("piece", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("pieces", F.lit(1))).cast("int"))
    # pages without a host stand alone
    dealt = dealt.withColumn("piece", F.when(F.col("host") == "", F.hash("page_id")).otherwise(F.col("piece")))
    sent = dealt.select("host", "piece", "page_id", "url", "html").repartition("host", "piece").sortWithinPartitions("host", "piece", "page_id")
    return sent.mapInArrow(lambda it: lean(_extracted(it)), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
