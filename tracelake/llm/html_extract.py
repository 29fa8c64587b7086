"""Main-text extraction by template deduction over the pages of a host.

Every page becomes a sequence of tokens that know their place: tags with their path, and text blocks with their path and
wording.  Over the distinct pages of a host each token has an occurrence vector (how often it stands on each page);
tokens that share a vector form an equivalence class.  Classes that are large (``MIN_CLASS`` tokens) and frequent (half
of the host's pages, three at least) are put in order (by mean place) and checked on every page:

* Order: an occurrence of a class is a run through its tokens.  Tokens that any page has out of order leave their class.
* Nesting: an occurrence lies in one gap of the innermost occurrence around it.  Classes that cross others, or lie in
  different gaps on different pages, are not valid.

The valid classes nest into the host's template.  Text blocks that are not among its tokens are the contents of slots: a
slot is a gap of a class.  Slots of a page are ranked by their dynamic text; labels of the elements around them exclude
menus, headers, footers and so on, and decide between the slots of a marked article or main region that holds half of the
free text and all free slots.  Vectors are compared by sums of mixed hashes, so no vector is ever held in one place.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import Scratch, table
from tracelake.llm.url_filter import host_of

MIN_CLASS = 3
MIN_PAGES = 3
#: Templates of up to so many bytes (measured) go to every task; larger ones are joined with the pages by host.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas video audio select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot caption legend summary figcaption dd dt li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = frozenset("ul ol dl table tbody thead tfoot".split())
_ENDS = {name: re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I) for name in RAW}
# What labels a slot as not the article's.
HARD_TAGS = frozenset("nav aside footer header menu dialog".split())
SOFT_TAGS = frozenset("form button fieldset head".split())
HARD_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())
HARD_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments commentlist disqus respond reply replies discussion related recommended".split())
SOFT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification alert announcement popup modal overlay newsletter subscribe subscription signup login search share sharing social toolbar topbar widget widgets pagination pager copyright legal skip teaser outbrain taboola paywall".split())
PREFIXES = frozenset("has with no without is".split())
MAIN_NAMES = frozenset({"content", "main", "article", "post", "entry", "story", "maincontent", "main-content", "main_content", "page-content", "post-content", "entry-content", "article-content", "article-body", "post-body", "story-body", "body-content", "mw-content-text"})


@dataclass
class Block:
    path: int
    text: str
    linked: int
    label: int  # 0 free, 1 soft, 2 hard
    region: int  # 0 none, 1 main, 2 article
    token: int = 0
    slot: tuple[int, int, int] = (0, 0, 0)  # class, gap, path


def _named(attrs: str) -> tuple[int, bool]:
    """(label, names main content) of an element's class, id and role."""
    label, main = 0, False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for name in value.lower().split():
                parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
                if not parts or parts[0] in PREFIXES:
                    continue
                ends = {parts[0], parts[-1]}
                if ends & HARD_WORDS:
                    label = 2
                elif ends & SOFT_WORDS:
                    label = max(label, 1)
                if name in MAIN_NAMES:
                    main = True
        elif key == "role":
            if value.lower() in HARD_ROLES:
                label = 2
            elif value.lower() in ("main", "article"):
                main = True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            label = 2
    return label, main and not label


def parse(page: str) -> tuple[list[Block], list[int]]:
    """Text blocks, and the hashes of all tokens; both in page order, a block's token where the block ends."""
    # a frame: name, path hash, label, region, inside a link, inside an article's own header, path of the block around, inside a heading
    stack: list[tuple[str, int, int, int, bool, bool, int, bool]] = [("", 0, 0, 0, False, False, 0, False)]
    open_ = Counter()
    blocks: list[Block] = []
    tokens: list[int] = []
    text: list[str] = []
    linked = 0
    at: tuple[int, int, int] | None = None

    def add(b: Block) -> None:
        b.token = xxhash.xxh64_intdigest(b.text, b.path & 0x7FFFFFFFFFFFFFFF)
        blocks.append(b)
        tokens.append(b.token)

    def cut(k: int) -> None:
        for frame in stack[k:]:
            open_[frame[0]] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal linked, at
        if text:
            s = " ".join(_html.unescape("".join(text)).split())
            if s:
                add(Block(at[0], s, linked, at[1], at[2]))
            text.clear()
        linked, at = 0, None

    def say(s: str) -> None:
        nonlocal linked, at
        top = stack[-1]
        here = (top[1], 2 if top[5] and not top[7] else top[2], top[3])
        if at is None:
            if not s.strip():
                return
            at = (top[6], here[1], here[2])
        elif here[1] != at[1]:
            if here[1] and s.strip():  # an inline advert within a block
                add(Block(top[1], " ".join(_html.unescape(s).split()), 0, here[1], here[2]))
                return
            if not here[1] and s.strip():
                flush()
                say(s)
                return
        text.append(s)
        if top[4]:
            linked += len(s.strip())

    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1) if open_[name] else ():
                if stack[k][0] == name:
                    cut(k)
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("html", "body", "main", "article"):
                    break
            continue
        attrs = m[3] or m[6] or ""
        if name in RAW:
            if not attrs.endswith("/"):
                stop = _ENDS[name].search(page, pos)
                pos = stop.end() if stop else end
            continue
        if name in BLOCK:
            flush()
        if name == "br":
            say(" ")
        if name in VOID:
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if open_["p"] else ():
                if stack[k][0] == "p":
                    cut(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        elif name in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in SIBLINGS[name]) else ():
                if stack[k][0] in SIBLINGS[name]:
                    cut(k)
                    if name != "tr":
                        break
                elif stack[k][0] in FENCES and not (name == "tr" and stack[k][0] != "table"):
                    break
        _, path, label, region, link, own_header, base, heading = stack[-1]
        extra, main = _named(attrs) if attrs and name not in ("a", "img") else (0, False)
        if name in ("html", "body", "main"):
            extra = 0
        if name == "header" and region == 2 and not label:
            own_header = True
        elif name in HARD_TAGS or name == "footer":
            extra = 2
        elif name in SOFT_TAGS:
            extra = max(extra, 1)
        if name in ("article", "main") and not extra and label < 2:
            label = 0
        if name == "article" and not extra:
            region = 2
        elif (name == "main" or main) and region < 1:
            region = 1
        path = xxhash.xxh64_intdigest(f"{name}|{attrs if name not in ('a', 'img', 'html') else ''}", path & 0x7FFFFFFFFFFFFFFF)
        tokens.append(path)
        open_[name] += 1
        stack.append((name, path, max(label, extra), region, link or name == "a", own_header, path if name in BLOCK else base, heading or name in HEADINGS))
    flush()
    return blocks, tokens


@dataclass
class Template:
    """The valid classes of a host: where each of their tokens stands in its class, and how many it has."""

    place: dict[int, tuple[int, int]]
    size: dict[int, int]

    @classmethod
    def of(cls, classes: list[dict]) -> Template:
        place = {t & _ALL: (c["class"], i) for c in classes for i, t in enumerate(c["tokens"])}
        return cls(place, {c["class"]: len(c["tokens"]) for c in classes})


_ALL = 0xFFFFFFFFFFFFFFFF
_NONE = Template({}, {})


def main_text(page: str, template: Template = _NONE) -> str:
    """The main slots' blocks of a page, given its host's template.

    Blocks that are template tokens are no text of the page.  Of the slots outside labelled elements those of the articles,
    else those of the main region are taken if they hold half of the dynamic text, else all.  No slot: ''.
    """
    blocks, tokens = parse(page)
    free = [b for b in slots(blocks, tokens, template) if not b.label and (b.region or 2 * b.linked <= len(b.text))]
    dynamic = Counter()
    for b in free:
        dynamic[b.slot, b.region] += len(b.text)
    for region in (2, 1):
        own = sum(n for (_, r), n in dynamic.items() if r >= region)
        if own and 2 * own >= dynamic.total():
            return "\n".join(b.text for b in free if b.region >= region)
    return "\n".join(b.text for b in free)


def slots(blocks: list[Block], tokens: list[int], template: Template) -> list[Block]:
    """The blocks that are no template tokens, each with its slot: the innermost open class, the gap of it, and the path."""
    out: list[Block] = []
    open_: list[tuple[int, int]] = []
    text = iter(blocks)
    nxt = next(text, None)
    for t in tokens:
        known = template.place.get(t)
        if nxt is not None and t == nxt.token:
            if known is None:
                nxt.slot = (*(open_[-1] if open_ else (0, 0)), nxt.path)
                out.append(nxt)
            nxt = next(text, None)
        if known is not None:
            _advance(open_, *known, template.size[known[0]])
    return out


def _advance(open_: list[tuple[int, int]], class_: int, at: int, size: int) -> tuple[tuple[int, int], bool] | None:
    """Take one more token of a class; at an occurrence's first token returns (class around, gap) and whether it crosses nothing."""
    if at == 0:
        around = open_[-1] if open_ else (0, 0)
        if size > 1:
            open_.append((class_, 0))
        return around, True
    for k in range(len(open_) - 1, -1, -1):
        if open_[k][0] == class_:
            crossed = open_[k + 1 :]
            if at == size - 1:
                del open_[k]
            else:
                open_[k] = (class_, at)
            return (crossed[-1], False) if crossed else None
    return None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, tokens, pages, counts, places = [], [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not page:
                continue
            sequence = parse(page)[1]
            own = Counter(sequence)
            first = {t: len(sequence) - 1 - i for i, t in enumerate(reversed(sequence))}
            hosts += [host] * len(own)
            tokens += map(_signed, own)
            pages += [_signed(xxhash.xxh64_intdigest(page))] * len(own)
            counts += own.values()
            places += [first[t] for t in own]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(pages, pa.int64()), pa.array(counts, pa.int64()), pa.array(places, pa.int64())], names=["host", "token", "page", "n", "place"])


def out_of_order(places: list[int]) -> list[int]:
    """Of tokens given by their places in their class, in page order: those outside a longest increasing run."""
    tops, back, at = [], [0] * len(places), []
    for i, x in enumerate(places):
        k = int(np.searchsorted(tops, x))
        back[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [x]
        at[k : k + 1] = [i]
    keep, i = set(), at[-1] if at else -1
    while i >= 0:
        keep.add(i)
        i = back[i]
    return [x for i, x in enumerate(places) if i not in keep]


def check(sequence: list[int], template: Template) -> tuple[dict[int, set[int]], dict[int, tuple[int, int]], set[int]]:
    """One page against its host's candidate classes: (places out of order, (class around, gap), classes that cross) by class."""
    seen: dict[int, list[int]] = {}
    for t in sequence:
        if t in template.place:
            c, i = template.place[t]
            seen.setdefault(c, []).append(i)
    wrong: dict[int, set[int]] = {}
    for c, places in seen.items():
        size = template.size[c]
        runs = [places[k : k + size] for k in range(0, len(places), size)]
        for run in runs:
            if run != sorted(run) or len(set(run)) < len(run):
                wrong.setdefault(c, set()).update(out_of_order(run) if len(runs) == 1 else range(size))
    nest: dict[int, tuple[int, int]] = {}
    crossing: set[int] = set()
    open_: list[tuple[int, int]] = []
    for t in sequence:
        c, i = template.place.get(t, (0, 0))
        if not c or c in wrong:
            continue
        got = _advance(open_, c, i, template.size[c])
        if got is None:
            continue
        around, whole = got
        if not whole:
            crossing.add(min((around[0], c), key=lambda x: (template.size[x], x)))
        elif nest.setdefault(c, around) != around:
            crossing.add(c)
    return wrong, nest, crossing


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Template] = {}
    for batch in batches:
        rows: set[tuple] = set()
        for host, page, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if not page:
                continue
            if host not in known:
                if len(known) > 64:
                    known.clear()
                known[host] = Template.of(classes.as_py() or [])
            wrong, nest, crossing = check(parse(page)[1], known[host])
            rows.update((host, c, i, None, None) for c, places in wrong.items() for i in places)
            rows.update((host, c, None, *around) for c, around in nest.items())
            rows.update((host, c, None, c, -1) for c in crossing)
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "class", "wrong", "around", "gap"])


CLASSES = "array<struct<class:bigint,tokens:array<bigint>>>"


def candidates(pages: DataFrame) -> DataFrame:
    """(host, classes) of ``pages`` (host, html): large and frequent equivalence classes, tokens by their mean place.

    A token of such a class is on half of the host's pages, so a host has at most twice as many as a page has tokens.
    """
    seen = pages.mapInArrow(_tokens, "host string, token long, page long, n long, place long").distinct()
    mixed = F.xxhash64("page", "n")
    vectors = seen.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(mixed.bitwiseAND(0x7FFFFFFF)).alias("v0"), F.sum(F.shiftrightunsigned(mixed, 33)).alias("v1"), F.avg("place").alias("place"))
    sizes = pages.where("html <> ''").select("host", F.xxhash64("html").alias("h")).distinct().groupBy("host").agg(F.count("*").alias("all"))
    often = vectors.join(sizes, vectors.host.eqNullSafe(sizes.host)).where((F.col("pages") >= MIN_PAGES) & (2 * F.col("pages") >= F.col("all"))).select(vectors.host, "token", "pages", "v0", "v1", "place")
    classes = often.groupBy("host", "pages", "v0", "v1").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("t")).where(F.size("t") >= MIN_CLASS)
    return classes.groupBy("host").agg(F.collect_list(F.struct(F.xxhash64("pages", "v0", "v1").alias("class"), F.transform("t", lambda x: x["token"]).alias("tokens"))).alias("classes"))


def templates(pages: DataFrame, keep: Scratch) -> DataFrame:
    """(host, classes) of ``pages`` (host, html): the classes that are in order and nested on every page of their host."""
    first = keep.write(candidates(pages), "candidates")
    checked = _with_classes(pages.where("html <> ''"), first).select("host", "html", "classes").mapInArrow(_checked, "host string, class long, wrong long, around long, gap long")
    votes = keep.write(checked.groupBy("host", "class").agg(F.collect_set("wrong").alias("wrong"), F.max(F.struct("around", "gap")).alias("hi"), F.min(F.when(F.col("around").isNotNull(), F.struct("around", "gap"))).alias("low"), F.min("gap").alias("crossed")), "votes")
    each = first.select("host", F.explode("classes").alias("c")).select("host", F.col("c.class").alias("class"), "c.tokens")
    got = each.join(votes, each.host.eqNullSafe(votes.host) & (each["class"] == votes["class"]))
    tokens = F.filter("tokens", lambda t, i: ~F.array_contains("wrong", i.cast("long")))
    good = got.where("coalesce(crossed, 0) >= 0 and (low is null or low = hi)").select(each.host, each["class"], tokens.alias("tokens")).where(F.size("tokens") >= MIN_CLASS)
    out = keep.write(good.groupBy("host").agg(F.collect_list(F.struct("class", "tokens")).alias("classes")), "templates")
    keep.drop("candidates", "votes")
    return out


def _with_classes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with their host's classes (null host: one more host); broadcast while they take ``BROADCAST_BYTES`` at most, measured."""
    size = known.agg(F.sum(16 + F.coalesce(F.octet_length("host"), F.lit(0)) + F.aggregate("classes", F.lit(0).cast("long"), lambda n, c: n + 16 + 8 * F.size(c["tokens"])))).first()[0] or 0
    known = known.withColumnRenamed("host", "_host")
    return rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, rows.host.eqNullSafe(known["_host"]), "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        out = []
        for host, page, classes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if host not in known:
                if len(known) > 64:
                    known.clear()
                known[host] = Template.of(classes.as_py() or [])
            out.append(main_text(page, known[host]) if page else "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null and empty pages have an empty text.

    Pages without a host (null URL) share one template.  Repeated pages count once for the template and are all returned;
    a host of less than ``MIN_PAGES`` distinct pages has none.  A page with nothing but its host's template has an empty
    text.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    known = templates(rows.select("host", "html"), Scratch(pages.sparkSession, "html"))
    return _with_classes(rows, known).select("page_id", "url", "host", "html", "classes").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_template_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))
