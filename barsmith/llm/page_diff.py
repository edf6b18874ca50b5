"""Main text of web pages by differencing pages with near URLs.

A page is cut into lines (blocks). The pages of a host stand in the order of
their URL paths; pages in a row that have the same three longest lines are
copies of each other and count as one place of that order, so the nearest
different page is found however many copies stand between. The lines of a page
are aligned with each of the two places before and after it by longest common
subsequence. Lines aligned with the nearest page that isn't a copy are template
and go; what all places around share tells template from copied text.

Markup is the second witness. Lines in elements that name their role
(navigation, adverts, forms and so on) always go, since pages of one host needn't
repeat them word by word. Lines inside ``article`` or ``main`` go only if two
places on either side share them and they stand before the first or after the
last line of the article that isn't so shared: a copied passage is text.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, row_key, sliced

# Elements and names that aren't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROP = frozenset("head title script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu".split())
#: Never shown, so no lines at all.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar footer comment comments "
    "respond disqus cookie cookies consent gdpr notice notices banner newsletter subscribe subscription popup modal overlay social share sharing related "
    "breadcrumb breadcrumbs pagination pager widget login signup toolbar masthead copyright".split()
)
#: Words beside which a name keeps its meaning ("site-footer", "share-buttons"), unlike others ("no-sidebar", "related-work").
BESIDE = frozenset("site page top bottom left right list item items box block bar button buttons link links wrap wrapper container inner outer area section slot unit zone panel primary secondary global header form main".split())
# Fixed values of the HTML syntax: a start tag ends open elements of these kinds, unless one of the fences stands between.
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_CELLS = frozenset(("td", "th"))
_IMPLIED = {
    "li": (frozenset(("li", "p")), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "td": (_CELLS | {"p"}, frozenset(("tr", "table"))),
    "th": (_CELLS | {"p"}, frozenset(("tr", "table"))),
    "tr": (_CELLS | {"tr", "p"}, frozenset(("table", "tbody", "thead", "tfoot"))),
    **{t: (_CELLS | {"tr", "thead", "tbody", "tfoot", "caption", "p"}, frozenset(("table",))) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
#: A paragraph inside one of these isn't ended by what starts outside of them.
_PARAGRAPH_FENCE = frozenset(("button", "td", "th", "caption", "object", "html", "table", "template"))
#: A tag that the end of the page cuts off.
_CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")
SPLIT = re.compile(r"[^a-z0-9]+")
#: A page with which this part of the longer one's lines without a role is shared is a copy; so is one that shares ALIKE of what not all pages around share.
COPY, ALIKE = 0.8, 0.5
#: Places of different pages on either side with which a page is aligned.
REACH = 2
#: Longest lines that name a page among its neighbours.
LEAD = 3
#: Pages of one place in one task, where a place is joined to its pages.
SPREAD = 10_000


def named(value: str) -> bool:
    """Whether a class or id, as written, names a role: one of its words is a name, alone or beside words that leave it its meaning."""
    for token in value.lower().split():
        parts = [p for p in SPLIT.split(token) if p and not p.isdigit()]
        if not NAMES.isdisjoint(parts) and all(p in NAMES or p in BESIDE for p in parts):
            return True
    return False


@dataclass
class Line:
    text: str
    article: int  # number of the innermost article that holds it, 0 for none
    roles: tuple[int, ...]  # numbers of the elements around it that name a role


class _Lines(HTMLParser):
    """Lines of a page, with open elements as (tag, number of its role or 0, number of its article or 0)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int]] = []
        self.count: Counter[str] = Counter()
        self.roles: list[int] = []
        self.articles: list[int] = []
        self.unseen = self.n_roles = self.n_articles = 0
        self.by_name: set[int] = set()
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append(Line(text, self.articles[-1] if self.articles else 0, tuple(self.roles)))

    def _close(self, at: int) -> None:
        """End the open element number ``at`` alone."""
        tag, role, article = self.open.pop(at)
        self.count[tag] -= 1
        if role:
            self.roles.remove(role)
        if article:
            self.articles.remove(article)
        self.unseen -= tag in UNSEEN

    def _imply(self, kinds: frozenset[str], fences: frozenset[str]) -> None:
        """End open elements down to the lowest one of the kinds above the nearest fence."""
        if not any(self.count[k] for k in kinds):
            return
        low = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in fences:
                break
            if self.open[i][0] in kinds:
                low = i
        if low is not None:
            while len(self.open) > low:
                self._close(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        if self.count["head"] and tag not in IN_HEAD and tag != "head":
            self._imply(frozenset(("head",)), frozenset())
        if tag in _PARAGRAPH_ENDS:
            self._end_paragraph()
        if tag in _IMPLIED:
            self._imply(*_IMPLIED[tag])
        if tag in VOID:
            return
        role = article = 0
        by_tag = tag in DROP or tag == "header" and not self.articles
        by_name = False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                by_name = by_name or named(value)
            elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                by_tag = True
        if by_tag or by_name:
            self.n_roles += 1
            role = self.n_roles
            self.roles.append(role)
            if not by_tag:
                self.by_name.add(role)
        if tag in ("article", "main"):
            self.n_articles += 1
            article = self.n_articles
            self.articles.append(article)
        self.unseen += tag in UNSEEN
        self.open.append((tag, role, article))
        self.count[tag] += 1

    def _end_paragraph(self) -> None:
        """End the nearest open ``p`` with what is open inside it; inline elements around it stay open, so nothing else ends."""
        if not self.count["p"]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in _PARAGRAPH_FENCE:
                return
            if self.open[i][0] == "p":
                while len(self.open) > i:
                    self._close(len(self.open) - 1)
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.count[tag]:
            return
        at = len(self.open) - 1
        while self.open[at][0] != tag:
            if tag not in BLOCK and self.open[at][0] in BLOCK:
                # The end of an inline element doesn't end the blocks opened inside it.
                while self.open[at][0] != tag:
                    at -= 1
                self._close(at)
                return
            at -= 1
        while len(self.open) > at:
            self._close(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)


def _size_code(n: int) -> int:
    """A size in 10 bits: exact under 64, else 5 bits after the leading one and an exponent."""
    if n < 64:
        return n
    shift = min(n.bit_length() - 6, 30)
    return 32 + 32 * shift + min((n >> shift) - 32, 31)


def sizes(lines: np.ndarray) -> np.ndarray:
    """Sizes of lines, to one part in 32, from their numbers."""
    code = lines >> 2 & 0x3FF
    shift = np.maximum(code - 32 >> 5, 0)
    return np.where(code < 64, code, (32 + (code & 31)) << shift)


def pack(lines: np.ndarray) -> bytes:
    """Six bytes a line."""
    return lines.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


@dataclass
class Page:
    texts: list[str]
    article: np.ndarray  # whether a line is inside an article
    role: np.ndarray  # whether a line is inside an element that names its role

    def lines(self) -> np.ndarray:
        """One number of 48 bits for each line: 36 of its hash, 10 of its size (see ``_size_code``), whether it is in an article, whether it has a role."""
        whole = [xxhash.xxh64_intdigest(t) >> 28 << 12 | _size_code(len(t)) << 2 for t in self.texts]
        return np.array(whole, dtype=np.int64) | self.article.astype(np.int64) << 1 | self.role.astype(np.int64)

    def lead(self) -> int:
        """What near copies have in common: the longest lines without a role."""
        own = [t for t, r in zip(self.texts, self.role, strict=True) if not r] or self.texts
        longest = sorted(sorted(set(own), key=lambda t: (-len(t), t))[:LEAD])
        return int(np.uint64(xxhash.xxh64_intdigest("\n".join(longest))).view(np.int64))


def page_lines(html: str | None) -> Page:
    """Lines of a page as shown, with what markup tells of each.

    If every article stands inside elements that a class or id names, the names
    around the longest article don't count.
    """
    parser = _Lines()
    parser.feed(_CUT_TAG.sub("", html or ""))
    parser.close()
    parser.flush()
    lines, void = parser.lines, set()
    held = [x for x in lines if x.article]
    if held and all(x.roles for x in held):
        size: Counter[int] = Counter()
        for x in held:
            if all(r in parser.by_name for r in x.roles):
                size[x.article] += len(x.text)
        if size:
            best = max(size, key=lambda a: (size[a], -a))
            # Only names that all lines of the article have are around it.
            void = set.intersection(*[set(x.roles) for x in held if x.article == best]) & parser.by_name
    role = np.array([any(r not in void for r in x.roles) for x in lines], dtype=bool)
    return Page([x.text for x in lines], np.array([x.article > 0 for x in lines], dtype=bool), role)


# ------------------------------------------------------------ alignment


def _last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x with every start of y."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for h in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == h, row[:-1] + 1, 0)))
    return row


def _align(x: np.ndarray, y: np.ndarray, cells: int) -> list[int]:
    """Places in x of a longest common subsequence with y; tables of at most ``cells`` entries, larger ones are halved."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        return [0] if (y == x[0]).any() else []
    if len(x) * len(y) > cells:
        half = len(x) // 2
        k = int(np.argmax(_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]))
        return _align(x[:half], y[:k], cells) + [half + i for i in _align(x[half:], y[k:], cells)]
    table = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    for i, h in enumerate(x):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(y == h, table[i, :-1] + 1, 0)))
    found, i, j = [], len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return found[::-1]


def shared_places(a: list[int], b: list[int], cells: int = 4_000_000) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory that grows with the lines, not their product."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = set(range(low)) | set(range(len(a) - high, len(a)))
    mid, other = a[low : len(a) - high], b[low : len(b) - high]
    both = set(mid) & set(other)
    if both:
        x = [i for i, h in enumerate(mid) if h in both]
        y = np.array([h for h in other if h in both], dtype=np.int64)
        found.update(low + x[i] for i in _align(np.array([mid[i] for i in x], dtype=np.int64), y, cells))
    return found


def decide(own: np.ndarray, around: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Which lines of a page are its text, and how many others differencing told to be template.

    ``own`` are the numbers of its lines (``Page.lines``), ``around`` those of the places around it, nearest first.
    """
    n = len(own)
    if not n:
        return np.zeros(0, dtype=bool), 0
    size, article, plain = sizes(own), own & 2 > 0, own & 1 == 0
    met = np.zeros((len(around), n), dtype=bool)
    names = (own >> 2).tolist()
    for i, other in enumerate(around):
        met[i, list(shared_places(names, (other >> 2).tolist()))] = True
    # What shares no line at all is of another make and tells nothing.
    told = np.flatnonzero(met.any(axis=1))
    met = met[told]
    theirs = [int(sizes(around[i])[around[i] & 1 == 0].sum()) for i in told]
    all_met = met.all(axis=0) if len(met) > 1 else np.zeros(n, dtype=bool)
    total, rest = int(size[plain].sum()), int(size[plain & ~all_met].sum())
    template = np.zeros(n, dtype=bool)
    for one, other in zip(met, theirs, strict=True):
        shared = size[plain & one].sum()
        is_copy = shared == total or shared >= COPY * max(total, other) or len(met) > 1 and rest and size[plain & one & ~all_met].sum() >= ALIKE * rest
        if total and not is_copy:
            template = one | all_met
            break
    if len(met) < 2 * REACH or size[plain & all_met].sum() == total:
        all_met[:] = False
    keep = plain & ~template
    inside = plain & article
    if inside.any():
        own_lines = np.flatnonzero(inside & ~all_met)
        held = inside.copy()
        if len(own_lines):
            held[: own_lines[0]] = False
            held[own_lines[-1] + 1 :] = False
        outside = keep & ~article
        # Articles with less text than stands outside of them are teasers.
        keep = held if size[held].sum() >= size[outside].sum() else held | outside
    return keep, int((template & ~keep).sum())


def main_text(page: Page, around: list[np.ndarray]) -> tuple[str, int]:
    """Text of a page, and how many of its lines differencing told to be template."""
    keep, n = decide(page.lines(), around)
    return " ".join(t for t, k in zip(page.texts, keep, strict=True) if k), n


# ---------------------------------------------------------------- Spark


#: Places of one task where each meets the places around it.
PLACES = 256


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 3):
        pages = [page_lines(h) for h in batch.column(3).to_pylist()]
        lines, lead = pa.array([pack(p.lines()) for p in pages], pa.binary()), pa.array([p.lead() for p in pages], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], lines, lead], names=["_k", "_host", "_path", "_lines", "_lead"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (_k, _host, _path, _lines, _lead, _part) with the number of their place and row within the task, and whether they begin and end it there.

    Repeated keys go. The last row is held back until the next one tells whether its place goes on.
    """
    names = ["_k", "_host", "_path", "_lines", "_part", "_lead", "_run", "_at", "_first", "_last"]
    last, held, run, at = None, None, -1, 0

    def told(rows: pa.Table, ends: list[bool]) -> Iterator[pa.RecordBatch]:
        for out in rows.append_column("_last", pa.array(ends, pa.bool_())).select(names).combine_chunks().to_batches():
            yield out

    for batch in batches:
        keep, runs, first = [], [], []
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 4)), strict=True)):
            if last is not None and row[0] == last[0]:
                continue
            new = last is None or row[1:] != last[1:]
            run, last = run + new, row
            keep.append(i)
            runs.append(run)
            first.append(new)
        if not keep:
            continue
        rows = pa.Table.from_batches([batch.take(pa.array(keep, pa.int64()))])
        for name, values in (("_run", runs), ("_at", range(at, at + len(keep))), ("_first", first)):
            rows = rows.append_column(name, pa.array(values, pa.bool_() if name == "_first" else pa.int64()))
        at += len(keep)
        rows = rows if held is None else pa.concat_tables([held, rows])
        after = rows.column("_first").to_pylist()[1:]
        yield from told(rows.slice(0, rows.num_rows - 1), after)
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield from told(held, [True])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept lines (bits) and n_shared of pages with what stands around them: _k, _path, _lines, _near."""
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            bits, shared = [], []
            for path, lines, near in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                # Nearest: the longest common start of the paths, then the fewest places between, then the place before.
                near = sorted((x for x in near or [] if x is not None), key=lambda x, path=path: -len(os.path.commonprefix([path, x["path"]])))
                keep, n = decide(unpack(lines), [unpack(x["lines"]) for x in near])
                bits.append(np.packbits(keep).tobytes())
                shared.append(n)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits, pa.binary()), pa.array(shared, pa.int64())], names=["_k", "_keep", "_n"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 2):
        found = []
        for html, bits, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            page = page_lines(html)
            if bits is None:
                found.append(main_text(page, []))
                continue
            keep = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(page.texts))
            found.append((" ".join(t for t, k in zip(page.texts, keep, strict=True) if k), n))
        text, n = pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, n], names=["id", "url", "text", "n_shared"])


def _numbered(pages: DataFrame) -> DataFrame:
    """Pages (_k, _host, _path, _lines) with ``_run``, the number of their place, and whether they are the first and the last page of it.

    Pages in a row (host, path, key) with one host and lead share a place. Rows
    are dealt by range and numbered inside each task; a table of one row for
    each task carries on the counts and tells whether a place goes on over a
    border. Repeated keys are left out.
    """
    order = ["_host", "_path", "_k"]
    dealt = pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    rows = "_k binary, _host string, _path string, _lines binary, _part int, _lead long, _run long, _at long, _first boolean, _last boolean"
    dealt = materialize(dealt.mapInArrow(_marked, rows), "ordered")
    mark, way = F.struct("_host", "_lead"), Window.orderBy("_part")
    # One row for each shuffle partition, so its size is bounded by that setting.
    parts = dealt.groupBy("_part").agg(F.max("_run").alias("_n"), F.max("_at").alias("_end"), F.min_by(mark, "_at").alias("_head"), F.max_by(mark, "_at").alias("_tail"))
    parts = parts.withColumn("_fresh", ~F.col("_head").eqNullSafe(F.lag("_tail").over(way)))
    base = F.sum(F.col("_fresh").cast("long") + F.col("_n")).over(way.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    parts = parts.select("_part", base.alias("_base"), "_end", "_fresh", F.coalesce(F.lead("_fresh").over(way), F.lit(True)).alias("_closed"))
    first = F.col("_first") & ((F.col("_at") > 0) | F.col("_fresh"))
    last = F.col("_last") & ((F.col("_at") < F.col("_end")) | F.col("_closed"))
    return dealt.join(F.broadcast(parts), "_part").select("_k", "_host", "_path", "_lines", (F.col("_run") + F.col("_base")).alias("_run"), first.alias("_first"), last.alias("_last"))


def decisions(pages: DataFrame) -> DataFrame:
    """For each key of ``pages`` (_k, _host, _path, _lines, _lead): _keep, the bits of the lines that are text, and _n, the number of template lines.

    Only the first and the last page of each place meet others: they are dealt
    to blocks of places in order, with those next to a border in both blocks. A
    page before shows itself by the last page of its place, a page after by the
    first. Further pages of a place are joined to what its first page met.
    """
    pages = _numbered(pages)
    block = F.floor(F.col("_run") / PLACES)
    edge = pages.where("_first OR _last").withColumn("_home", block)
    blocks = F.array_distinct(F.array(*[F.floor((F.col("_run") + d) / PLACES) for d in (0, -REACH, REACH)]))
    edge = edge.withColumn("_block", F.explode(blocks))
    page, around = F.struct(F.col("_path").alias("path"), F.col("_lines").alias("lines")), []
    for step in range(1, REACH + 1):
        for way, shown in ((-step, "_last"), (step, "_first")):
            # One page at most shows itself in such a frame.
            frame = Window.partitionBy("_block", "_host").orderBy("_run").rangeBetween(way, way)
            around.append(F.first(F.when(F.col(shown), page), ignorenulls=True).over(frame))
    met = edge.withColumn("_near", F.array(*around)).where("_block = _home AND _first")

    rest = pages.where("NOT _first").select("_k", "_path", "_lines", "_run")
    # What the first page of a place with very many pages met is repeated, so that the others spread over tasks.
    salts = F.ceil(F.col("_m") / F.lit(SPREAD)).cast("int")
    many = rest.groupBy("_run").agg(F.count(F.lit(1)).alias("_m")).select("_run", salts.alias("_salts")).where("_salts > 1")
    shown = met.where("NOT _last").select("_run", "_near").join(many, "_run", "left")
    shown = shown.select("_run", "_near", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
    salt = F.pmod(F.xxhash64("_k"), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")
    rest = rest.join(many, "_run", "left").withColumn("_salt", salt).join(shown, ["_run", "_salt"])
    columns = ["_k", "_path", "_lines", "_near"]
    return met.select(*columns).unionByName(rest.select(*columns)).mapInArrow(_decided, "_k binary, _keep binary, _n long")


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per input row: id, url, text (white space inside a block made one space, blocks joined by a space), n_shared.

    ``n_shared``: lines that differencing told to be template and that are not
    in the text. Null and empty pages have an empty text. A page without a host,
    or alone on its host (copies don't count), is read by structure only. Rows
    that repeat id, url and html are one page in the order of URLs and give the
    same row each. Ties: pages of one path stand in the order of a hash of
    their row. An empty table gives no rows. Ids keep their type and bits;
    other columns are not read, whatever their names. Very long pages are read
    whole; they are aligned in memory that grows with their number of lines.
    Whole pages are shuffled once, to meet one bit for each of their lines; all
    else works on six bytes a line, among them 36 bits of its hash. Each page is
    parsed twice, to number its lines and to take its text.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    path = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)", 1)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"), host.alias("_host"), path.alias("_path"))
    rows = rows.withColumn("_k", row_key("id", "url", "_html"))
    lines = rows.where("_host <> ''").select("_k", "_host", "_path", "_html").mapInArrow(_signatures, "_k binary, _host string, _path string, _lines binary, _lead long")
    found = decisions(materialize(lines.where(F.length("_lines") > 0), "lines"))
    id_type = pages.select(id_col).schema[0].dataType.simpleString()
    joined = rows.select("id", "url", "_html", "_k").join(found.hint("shuffle_hash"), "_k", "left").select("id", "url", "_html", "_keep", "_n")
    return joined.mapInArrow(_extracted, f"id {id_type}, url string, text string, n_shared long").withColumnRenamed("id", id_col)
