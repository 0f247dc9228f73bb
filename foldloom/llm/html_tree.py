"""Main text of web pages by a site style tree.

The different pages of a host are merged into one tree of presentation paths (tags and classes, digits
dropped).  A feature of a path is a text found there (content) or a child sequence (presentation).  Of
the ``m`` pages that show a path, a text on ``n`` of them has entropy ``log n / log m`` over the pages:
0 on one page, 1 on all.  A path's content importance is 1 less the mean entropy of its texts; its
presentation importance is the entropy of its child sequences.  Both are drawn towards 1 by ``PRIOR``
pages that say nothing, so that a host of few pages is judged by the same rule as any other: two
equal texts are no proof, three are.  A branch combines its own presentation with the content below,
and is cut from every page if that stays under ``IMPORTANT`` and no path below it reaches that: a
branch with varied content anywhere stays whole.  The frame (html, body, main, article) is never cut
itself.  Inside an article or main element the tree takes the lesser part only: if it would
take as much text as it leaves, the pages are copies of one article and all of it stays; likewise a
page that the tree would leave without any text.

Names are evidence beside the tree, for content that varies though it is none (comments, adverts): a tag
of that kind, or a class, id or role that is a name of ``DECLARED`` as a whole token, or a token made of such
names and ``QUALIFIERS`` alone (``site-footer``, but not ``has-sidebar`` or ``entry-header``).  Names never
cut html, body, main, or an article that lies in no other.

Blocks are the texts between the boundaries of block elements; inline elements, comments and line
breaks do not end one.  Equal pages of a host count once in the measures, so copies of a page do
not make its article look like a menu.

Defined results: null, empty and text-free pages give an empty text; a null or unreadable url makes
a host of its own name ''; a tag that never closes ends its page; rows repeat as given; extra
columns are not read; very long pages are read whole.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import broadcast_if_small, prepare
from foldloom.session import cut_lineage

IMPORTANT = 0.5
#: Pages without evidence that stand beside those of a path.
PRIOR = 2
#: Share of a branch's importance that its own presentation has; the rest is the content's.
OWN = 0.1
#: Rows held by a task before they are handed on, summed up.
FLUSH = 200_000

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BOILERPLATE = frozenset(
    "nav footer aside form script style noscript template iframe svg button select input textarea head title dialog menu object canvas "
    "audio video map search".split())
#: Names in a class, id or role that declare boilerplate.
DECLARED = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion "
    "sponsor sponsored cookie cookies consent notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "breadcrumb breadcrumbs pagination pager share sharing social related recommended comment comments commentlist disqus reply replies "
    "widget toolbar contentinfo complementary".split())
#: Words that may stand beside such a name in a token; those of PARTS not beside a header, which holds the title.
QUALIFIERS = frozenset(
    "site main top bottom left right global primary secondary sub mobile desktop bar box list area section container wrapper wrap inner "
    "block form link links item items posts buttons icons policy thread".split())
PARTS = frozenset("post entry article page content".split())
FRAME = frozenset("html body main article".split())
#: A start tag of the first kind closes an open element of the second (the omitted end tags of HTML).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl div section article main body".split())
MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(?=/?[a-zA-Z])", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _names_boilerplate(token: str) -> bool:
    words = set(re.findall(r"[a-z]+", token))
    named = words & DECLARED
    return bool(named) and words <= DECLARED | QUALIFIERS | (set() if "header" in named else PARTS)


@lru_cache(maxsize=50_000)
def element(tag: str, attributes: str) -> tuple[str, bool]:
    """(name in the tree, whether it declares itself boilerplate)."""
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    shown = re.sub(r"\d+", "", values.get("class", "") or values.get("id", "")).replace("/", "").split()
    declared = tag in BOILERPLATE or any(map(_names_boilerplate, " ".join(values.values()).lower().split()))
    return ".".join([tag, *sorted(shown)[:4]]), declared


class Element:
    __slots__ = ("tag", "path", "dropped", "noise", "main", "children")

    def __init__(self, tag: str, path: str, dropped: bool, noise: bool, main: bool):
        self.tag, self.path, self.dropped, self.noise, self.main = tag, path, dropped, noise, main
        self.children: list[str] = []


@dataclass(slots=True)
class Block:
    path: str
    text: str
    dropped: bool  # by a name
    noise: bool  # by the tree
    main: bool


def kept(blocks: list[Block]) -> list[str]:
    """The texts that stay: what the tree cuts goes, unless it would take a page's article."""
    left = [b for b in blocks if not b.dropped]
    inside = [sum(len(b.text) for b in left if b.main and b.noise is cut) for cut in (False, True)]
    spared = inside[1] >= inside[0]
    out = [b.text for b in left if not b.noise or b.main and spared]
    return out or [b.text for b in left]


def read(page: str, noise: frozenset[str] = frozenset()) -> tuple[list[Block], list[tuple[str, str]]]:
    """Blocks in page order, and presentations (path, child sequence) of the elements."""
    stack = [Element("", "", False, False, False)]
    blocks: list[Block] = []
    shapes: list[tuple[str, str]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                e = stack[-1]
                blocks.append(Block(e.path, whole, e.dropped, e.noise, e.main))
            text.clear()

    def close(until: int) -> None:
        flush()
        while len(stack) > until:
            e = stack.pop()
            shapes.append((e.path, ",".join(k for i, k in enumerate(e.children) if not i or e.children[i - 1] != k)))

    at, size = 0, len(page)
    while at < size:
        m = MARK.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<":  # a tag whose quotes never close
                break
            continue
        if not m[4]:  # cut off inside a tag
            break
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                else:
                    flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else size
            close_mark = page.find(">", stop)
            at = size if not end or close_mark < 0 else close_mark + 1
            continue
        if tag not in BLOCKS:
            if tag in BOILERPLATE and tag not in VOID and not m[0].endswith("/>"):
                # inline controls: their text is skipped with them
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if end:
                    close_mark = page.find(">", end.start())
                    at = size if close_mark < 0 else close_mark + 1
            continue
        flush()
        closed = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p" or stack[k].tag in closed:
                close(k)
            elif stack[k].tag in SCOPES or stack[k].tag not in ("p", *closed):
                break
        name, declared = element(tag, m[3])
        parent = stack[-1]
        parent.children.append(name)
        if tag in VOID or m[0].endswith("/>") and tag == "hr":
            continue
        path = f"{parent.path}/{name}"
        main = parent.main or tag in ("article", "main")
        if tag in FRAME and not (tag == "article" and any(e.tag == "article" for e in stack)):
            declared = False
        dropped = parent.dropped or declared or (tag == "header" and not parent.main)
        stack.append(Element(tag, path, dropped, parent.noise or path in noise, main))
    close(1)
    return blocks, shapes


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (host, html) to rows (host, path, kind, code, n): on how many pages a path shows a text (kind 1), a child sequence (kind 0), itself (-1)."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(seen)
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()),
             pa.array([k[3] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["host", "path", "kind", "code", "n"])
        seen.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            blocks, shapes = read(page)
            # once a page, however often it shows them
            seen.update({(host, b.path, 1, _code(b.text)) for b in blocks})
            seen.update({(host, path, 0, _code(shape)) for path, shape in shapes})
            seen.update({(host, path, -1, 0) for path in {b.path for b in blocks} | {path for path, _ in shapes}})
        if len(seen) > FLUSH:
            yield flush()
    yield flush()


def branch_importance(pages: DataFrame) -> DataFrame:
    """(host, branch, content, best, shape, importance) of each host's different pages (host, html).

    ``content`` is the mean importance of the texts below a branch, ``best`` that of its best path.
    """
    counted = pages.mapInArrow(features, "host string, path string, kind int, code long, n long")
    counted = cut_lineage(counted.groupBy("host", "path", "kind", "code").agg(F.sum("n").alias("n")))
    shown = counted.where("kind = -1").select("host", "path", F.col("n").cast("double").alias("m"))
    log_n, log_m = F.log(F.col("n").cast("double")), F.log("m")
    # summed before the join, so that a path with many texts is no hot key
    sums = counted.where("kind >= 0").groupBy("host", "path", "kind").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("total"), F.sum(log_n).alias("logs"), F.sum(F.col("n") * log_n).alias("inner"))
    sums = sums.join(shown, ["host", "path"])
    trust = F.col("m") / (F.col("m") + PRIOR)
    # the entropy of a text on n of m pages is log n / log m; one page tells nothing
    repeated = F.when(F.col("m") > 1, F.col("logs") / F.col("texts") / log_m).otherwise(F.lit(0.0))
    # the entropy of the sequences over its maximum
    total = F.col("total").cast("double")
    varied = F.when(F.col("total") > 1, (F.log(total) - F.col("inner") / total) / F.log(total)).otherwise(F.lit(1.0))
    paths = cut_lineage(sums.select(
        "host", "path", "kind", "texts", F.when(F.col("kind") == 1, 1 - trust * repeated).otherwise(1 - trust * (1 - varied)).alias("importance")))

    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    content = paths.where("kind = 1 and path <> ''").select("host", F.explode(above).alias("branch"), "texts", "importance").groupBy("host", "branch").agg(
        (F.sum(F.col("importance") * F.col("texts")) / F.sum("texts")).alias("content"), F.max("importance").alias("best"))
    shape = paths.where("kind = 0").select("host", F.col("path").alias("branch"), F.col("importance").alias("shape"))
    return content.join(shape, ["host", "branch"]).withColumn("importance", OWN * F.col("shape") + (1 - OWN) * F.col("content"))


def noise_paths(pages: DataFrame) -> DataFrame:
    """(host, noise): paths of the unimportant branches of each host; pages are (host, html)."""
    low = branch_importance(pages).where((F.col("importance") < IMPORTANT) & (F.col("best") < IMPORTANT))
    low = low.where(~F.regexp_extract("branch", "([^/.]*)[^/]*$", 1).isin(*sorted(FRAME)))
    return low.groupBy("host").agg(F.collect_set("branch").alias("noise"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    prepare(pages.sparkSession)
    hosts = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
    base = pages.select(
        "page_id", "url", F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), hosts, 1)).alias("host"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    # one page of each content and host, found on hashes, so that no page moves for it
    mark = F.struct(F.xxhash64("html"), F.xxhash64(F.lit(1), "html"))
    coded = base.select("host", "page_id", mark.alias("mark"))
    first = cut_lineage(coded.groupBy("host", "mark").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n")))
    copied = first.where("n > 1").select("host", F.col("mark").alias("c_mark"), F.col("page_id").alias("c_id"))
    copied = cut_lineage(copied)
    marked = base.withColumn("mark", mark).join(
        broadcast_if_small(copied).withColumnRenamed("host", "c_host"),
        (F.col("host") == F.col("c_host")) & (F.col("mark") == F.col("c_mark")), "left")
    once = marked.where("c_id is null or page_id = c_id").select("host", "html")
    noise = cut_lineage(noise_paths(once))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset] = {}
        for batch in batches:
            out = []
            for page, paths in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist(), strict=True):
                key = tuple(paths or ())
                blocks, _ = read(page, sets.setdefault(key, frozenset(key)))
                out.append("\n".join(kept(blocks)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    small = broadcast_if_small(noise.withColumnRenamed("host", "n_host"), F.aggregate("noise", F.lit(0), lambda a, x: a + F.length(x)))
    joined = base.join(small, F.col("host") == F.col("n_host"), "left").select("page_id", "url", "html", "noise")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return joined.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
