"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: tags with their place in the page's tree, and text runs. Over the pages of one host, tokens
with the same occurrence vector (how often on which pages) form an equivalence class. A token's hash chains those of its
ancestors, so each occurrence lies in the span of its place, the tag around it, and classes nest by the classes of their
places. From the root down, a class of two tokens or more with a tag in it is a layout if it has LAYOUT_TAGS tags, on
however small a part of the host, or is on LAYOUT of the pages of the layout around it. A text run is template if its
class has two tokens or more, and is a layout's own or is on SHARE of the pages of the innermost layout around it. The
order of a class's tokens is not compared. What lies in the template itself is not content; the other text runs are the
slots. Slots inside containers that are chrome by their tag, their role or a whole word of their class or id are left
out; where only a part of a word names chrome (related-work), the container has to be a tag of the template. All others
are the main text, or where an article or main element has the greater part of their characters, those. Inside such an
element a repeated run needs MIN_MAIN_PAGES distinct pages and a layout on LAYOUT of the pages around it, and goes only
with its whole block.

Occurrence vectors are compared by their support and two 64-bit hashes, each the exclusive or of hashes of (page, count), so no vector, page list or host is ever gathered
in one place; only the tokens that are on FLOOR of a host's pages are, for their nesting.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import map_arrow, spread_join, stash
from treeline.llm.url_filter import split_url

#: Fixed values of HTML: elements without content, elements that part blocks, elements whose start ends an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never content.
CHROME_TAGS = frozenset("nav header footer aside form script style noscript template iframe object svg math canvas button select textarea input label dialog menu head title fieldset audio video".split())
#: Words of a class, id or role that mark chrome.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond "
    "gdpr offcanvas pager pagination search share sharing sidebar sidenav signup site-footer site-header skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words that keep a following chrome word from counting: article-header, has-sidebar.
CONTENT_WORDS = frozenset("article content entry has main no post story with without".split())
#: Elements that hold the main text.
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that group blocks: inside an article only these are chrome by a part of a class or id.
GROUPS = frozenset("article aside center details div dl fieldset figure footer form header main nav ol section table ul".split())
#: A template class is on this share of its layout's pages, on MIN_PAGES of them, and has MIN_TOKENS tokens.
SHARE, MIN_PAGES, MIN_TOKENS = 0.5, 3, 2
#: A layout has LAYOUT_TAGS tags, or is on this share of the pages of the layout around it.
LAYOUT, LAYOUT_TAGS = 0.2, 3
#: Template tokens are on this share of the host's pages: a host has at most 1 / FLOOR times as many such tokens as a page, however many pages it has.
FLOOR = 0.01
#: Enclosing elements of a text run that are noted as chrome if they are template; those nested deeper lie inside one of them.
MOST_WEAK = 8
#: Stands in a template for the host having one.
HAS_TEMPLATE = 1
#: Distinct pages that a text run inside an article or main element has to be on before it counts as template.
MIN_MAIN_PAGES = 4
#: Pages with exact copies up to which their keys are broadcast, about 64 bytes each; beyond, tokens are shuffled.
BROADCAST_PAGES = 1_000_000

# Attributes as HTML reads them: a quote opens a value only after an equals sign, and one that stays open lasts to the end.
# Every part is possessive and the whole always matches, so a page is scanned once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>]++))", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")}
_PART = re.compile(r"[^a-z0-9_-]+")
_DASH = re.compile(r"[-_]+")
_NUMBER = re.compile(r"[0-9]+")
#: Elements in whose text runs are counted.
_BOXES = frozenset("article main div section td body center ul ol dl".split())
_TOP = 0


class Run:
    """A text run: raw text, the token of its container, whether chrome or main encloses it, the number of its block, and the tokens of the enclosing elements that are chrome if the template has them."""

    __slots__ = ("block", "box", "chrome", "main", "text", "weak")

    def __init__(self, text: str, box: int, chrome: bool, main: bool, block: int, weak: tuple[int, ...]) -> None:
        self.text, self.box, self.chrome, self.main, self.block, self.weak = text, box, chrome, main, block, weak


def _is_chrome(word: str) -> bool:
    """Whether a part of a class, id or role names chrome: the first one, or the last one unless another is a part of the content."""
    parts = _DASH.split(word)
    return parts[0] in CHROME_WORDS or (parts[-1] in CHROME_WORDS and not CONTENT_WORDS & set(parts))


def _marked(attributes: str, inner: bool) -> tuple[bool, bool, str]:
    """(whether a whole word or role marks chrome, whether a part of a word may, the words for the token); ``inner``: on a paragraph or within a line of an article, where parts do not count."""
    if not attributes:
        return False, False, ""
    words: list[str] = []
    role = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        words += [w for w in _PART.split(value) if w]
        if name.lower() == "role":
            role += words[-1:]
    strong = any(w in CHROME_WORDS for w in words) or bool({"contentinfo", "complementary", "banner", "navigation", "search"} & set(role))
    weak = not strong and not inner and any(_is_chrome(w) for w in words)
    return strong, weak, "." + ".".join(sorted(words)) if words else ""


class _Open:
    """The open elements: (tag, chrome, main, token, box, weak), with what finds one by its tag and the blocks above it."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, int, int, tuple[int, ...]]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    @property
    def top(self) -> tuple[str, bool, bool, int, int, tuple[int, ...]]:
        return self.stack[-1] if self.stack else ("", False, False, _TOP, _TOP, ())

    def push(self, element: tuple[str, bool, bool, int, int, tuple[int, ...]]) -> None:
        self.at[element[0]].append(len(self.stack))
        self.blocks.append((self.blocks[-1] if self.blocks else 0) + (element[0] in BLOCKS))
        self.stack.append(element)

    def pop(self) -> None:
        self.at[self.stack.pop()[0]].pop()
        self.blocks.pop()

    def close(self, tag: str) -> None:
        """End the innermost element of the tag and all in it; an inline end tag does not reach out of its block."""
        if not self.at[tag]:
            return
        depth = self.at[tag][-1]
        if tag in BLOCKS or self.blocks[-1] == self.blocks[depth]:
            while len(self.stack) > depth:
                self.pop()


def parse(page: str | None) -> tuple[list[tuple[int, int, int]], list[Run]]:
    """(tags with their token, the token of their place and, of those that may be chrome, that with numbers left open, text runs) of a page, in page order.

    Each step takes constant time in what is open, and tokens are hashes that chain, so a page of any shape, also one
    of open tags or quotes alone, takes time in proportion to its length.
    """
    page = page or ""
    tags: list[tuple[int, int, int]] = []
    runs: list[Run] = []
    open_ = _Open()
    names: dict[tuple[int, str], int] = {}
    at = block = 0
    size = len(page)

    def text(raw: str) -> None:
        if raw:
            _, chrome, main, _, box, weak = open_.top
            runs.append(Run(raw, box, chrome, main, block, weak))

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        end, start = m.group(1), m.group(2)
        if end:
            tag = end.lower()
            if tag in BLOCKS:
                block += 1
            open_.close(tag)
        elif start:
            tag, attributes = start.lower(), m.group(3)
            if tag in BLOCKS:
                block += 1
                while open_.stack and open_.top[0] not in BLOCKS:  # open inline elements end with their block
                    open_.pop()
                if open_.stack and (open_.top[0] == "p" or (tag == open_.top[0] and tag in ("li", "dt", "dd", "tr", "td", "th"))):
                    open_.pop()
            elif tag == "br":
                text(" ")
            _, in_chrome, in_main, place, box, weak = open_.top
            strong, maybe, words = _marked(attributes, in_main and tag not in GROUPS)
            chrome = in_chrome or tag in CHROME_TAGS or (strong and tag not in ("html", "body"))
            main = in_main or tag in MAIN_TAGS
            # Page chrome stays out; a header inside an article holds its heading.
            if tag in ("header", "hgroup") and in_main and not in_chrome and not strong:
                chrome = False
            named = (place, tag + words)
            token = names.get(named)
            if token is None:
                token = names[named] = _hash("t", f"{place}/{tag}{words}")
            marked = _hash("w", f"{place}/{tag}{_NUMBER.sub('#', words)}") if maybe and tag not in ("html", "body") else 0
            tags.append((token, place, marked))
            if tag in _RAW:
                close = _RAW[tag].search(page, at)
                at = close.end() if close else size
            elif tag not in VOID and not (attributes or "").rstrip().endswith("/"):
                open_.push((tag, chrome, main, token, token if tag in _BOXES else box, (*weak, marked) if marked and len(weak) < MOST_WEAK else weak))
    return tags, runs


def _hash(kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _clean(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


def _free(host: str | None, page: str | None) -> tuple[list[tuple[int, int, int]], list[Run], bytes, bytes]:
    """(tags, free runs, their serial form, the page's key: host and serial form)."""
    tags, runs = parse(page)
    free = [r for r in runs if not r.chrome]
    boxes: dict[int, int] = {}
    marks: dict[int, int] = {}
    rows = [(r.block, boxes.setdefault(r.box, len(boxes)), int(r.main), r.text, [marks.setdefault(w, len(marks)) for w in r.weak]) for r in free]
    serial = json.dumps([list(boxes), list(marks), rows], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    return tags, free, serial, hashlib.blake2b((host or "").encode("utf-8", "surrogatepass") + b"\0" + serial, digest_size=16).digest()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, kind, token, place, count): kind 0 a tag, 1 a text run, 2 a tag that is chrome if it is template, 3 a text run inside an article or main element, 4 the page itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            cols: list[list] = [[], [], [], [], [], []]
            for host, source in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                tags, free, _, page = _free(host, source.as_py())
                seen = Counter({(4, HAS_TEMPLATE, _TOP): 1})
                seen.update((0, token, place) for token, place, _ in tags)
                seen.update((2, marked, place) for _, place, marked in tags if marked)
                for r in free:
                    clean = _clean(r.text)
                    if clean:
                        seen[3 if r.main else 1, run_token(r.box, clean), r.box] += 1
                for (kind, token, place), count in seen.items():
                    for c, v in zip(cols, (host, page, kind, token, place, count), strict=True):
                        c.append(v)
            types = (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "page", "kind", "token", "place", "count"])


def run_token(box: int, clean: str) -> int:
    return _hash("r", f"{box}\0{clean}")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last columns, host and html, become the page's key and its free runs, compressed."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            n = some.num_columns - 2
            got = [_free(h, p.as_py())[2:] for h, p in zip(some.column(n).to_pylist(), some.column(n + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(n)), pa.array([k for _, k in got], pa.binary()), pa.array([zlib.compress(s) for s, _ in got], pa.binary())], names=[*some.schema.names[:n], "page", "packed"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last columns are packed and template (hashes of the page's template tokens)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            n = some.num_columns
            out = [extract(h.as_py(), set(t.as_py() or ())) for h, t in zip(some.column(n - 2), some.column(n - 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(n - 2)), pa.array(out, pa.string())], names=[*some.schema.names[: n - 2], "html"])


def _joined(runs: list[Run]) -> str:
    """Blocks in page order, white space in each turned into one space."""
    blocks: dict[int, list[str]] = {}
    for r in runs:
        blocks.setdefault(r.block, []).append(r.text)
    return "\n".join(t for t in (_clean("".join(parts)) for parts in blocks.values()) if t)


def nested_template(rows: pd.DataFrame) -> pd.DataFrame:
    """(host, token) of one host's template, given its frequent tokens (kind, token, place, support, vector, pages): text runs, and tags that are chrome if they are template."""
    found = list(rows[["kind", "token", "place", "support", "vector"]].itertuples(index=False, name=None))
    pages = int(rows["pages"].iloc[0])
    size = Counter(r[3:] for r in found if r[0] in (0, 1, 3))
    tags = {token: (place, (support, vector)) for kind, token, place, support, vector in found if kind == 0}
    tags_of = Counter(own for _, own in tags.values())
    around: dict[int, int] = {}  # tag: pages of the innermost layout at it
    layouts, wide = set(), set()
    for tag in tags:
        chain = []
        while tag in tags and tag not in around:
            chain.append(tag)
            tag = tags[tag][0]
        for t in reversed(chain):
            place, own = tags[t]
            around[t] = around.get(place, pages)
            if place in tags and tags[place][1] == own:
                continue
            shared = own[0] >= LAYOUT * around[t]
            if size[own] >= MIN_TOKENS and (shared or tags_of[own] >= LAYOUT_TAGS):
                layouts.add(own)
                around[t] = own[0]
                if shared:
                    wide.add(own)

    def fixed(kind: int, place: int, own: tuple) -> bool:
        if kind == 2:
            return size[own] >= MIN_TOKENS or own[0] >= LAYOUT * around.get(place, pages)
        if own[0] < (MIN_MAIN_PAGES if kind == 3 else MIN_PAGES) or size[own] < MIN_TOKENS:
            return False
        return own in (wide if kind == 3 else layouts) or own[0] >= SHARE * around.get(place, pages)

    out = [HAS_TEMPLATE, *(token for kind, token, place, *own in found if kind in (1, 2, 3) and fixed(kind, place, tuple(own)))]
    return pd.DataFrame({"host": pd.Series([rows["host"].iloc[0]] * len(out), dtype=object), "token": pd.Series(out, dtype="int64")})


def extract(packed: bytes, template: set[int]) -> str:
    """The main text of one packed page, given its template: text runs, and tags that turn out to be chrome.

    Where the host has no template, on fewer than MIN_PAGES pages, such tags are chrome outside articles only.
    """
    boxes, marks, rows = json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
    deduced = HAS_TEMPLATE in template
    kept, held, whole, every = [], [], set(), []
    for block, box, main, text, weak in rows:
        if any(marks[w] in template for w in weak) if deduced else (weak and not main):
            continue
        r = Run(text, boxes[box], False, bool(main), block, ())
        every.append(r)
        clean = _clean(text)
        fixed = bool(clean) and run_token(r.box, clean) in template
        if main and clean and not fixed:
            whole.add(block)
        if main:
            held.append((r, fixed))
        elif not fixed:
            kept.append(r)
    # A block of the article with a slot in it stays whole: a sentence keeps its repeated words.
    own = [r for r, fixed in held if not fixed or r.block in whole]
    inside = sum(len(_clean(r.text)) for r in own)
    if not inside:
        return _joined(kept)
    if inside >= sum(len(_clean(r.text)) for r in kept):
        return _joined(own)
    stays = {id(r) for r in own + kept}
    return _joined([r for r in every if id(r) in stays])


def occurrence_vectors(tokens: DataFrame) -> DataFrame:
    """(host, kind, token, place, support, vector) of tokens (host, page, kind, token, place, count) of distinct pages: tokens of a host have the same support and vector if they occur as often on the same pages."""
    vector = F.concat_ws(":", F.bit_xor(F.xxhash64("page", "count")), F.bit_xor(F.xxhash64("count", "page", F.lit(1))))
    return tokens.where("kind <> 4").groupBy("host", "kind", "token").agg(F.first("place").alias("place"), F.count(F.lit(1)).alias("support"), vector.alias("vector"))


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) for each row of ``pages``.

    Hosts are dealt by (host, token), so a host with a third of all pages is spread over tasks.

    Defined cases: null or empty html gives an empty text; a null URL or one without a host belongs to the host '';
    null keys take part; repeated rows each get the same text; an unclosed element ends with its block or the page;
    a page of a host with fewer than MIN_PAGES pages has no template but its own structure; an empty table gives no
    rows; other columns are left out.
    """
    host, _ = split_url(F.col(url))
    base = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("html"), host.alias("host"))
    every = stash(map_arrow(base.select("host", "html"), _tokens, "host string, page binary, kind int, token long, place long, count long"), "tokens")
    # Pages of a host with the same free text are one page to the template: an article that is there three times is none.
    copies = stash(every.where("kind = 4").groupBy("page").count().where("count > 1").select("page"), "copies")
    few = F.broadcast(copies) if copies.count() <= BROADCAST_PAGES else copies
    copied = every.join(few, "page", "left_semi").groupBy("host", "page", "kind", "token", "place").agg(F.max("count").alias("count"))
    tokens = every.join(few, "page", "left_anti").unionByName(copied)
    sizes = tokens.where("kind = 4").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    vectors = occurrence_vectors(tokens).join(sizes, "host").where((F.col("support") >= MIN_PAGES) & (F.col("support") >= F.col("pages") * FLOOR))
    template = vectors.groupBy("host").applyInPandas(nested_template, "host string, token long")
    per_page = tokens.where("kind in (1, 2, 3, 4)").join(template, ["host", "token"], "left_semi").groupBy("page").agg(F.collect_set("token").alias("template"))
    # Only the pages' free runs meet the template, compressed: tags and chrome stay behind.
    types = dict(base.dtypes)
    packed = map_arrow(base.select("_key", "_url", "host", "html"), _packed, f"_key {types['_key']}, _url {types['_url']}, page binary, packed binary")
    joined = spread_join(packed, per_page, "page", keys=every.where("kind = 4").select("page")).select("_key", "_url", "packed", "template")
    rest = map_arrow(joined, _slots, f"_key {types['_key']}, _url {types['_url']}, html string")
    return rest.select(F.col("_key").alias(key), F.col("_url").alias(url), F.col("html").alias("text"))
