"""Main text of web pages: site templates found by counting element subtrees per host, then structural rules.

A page is read with one regular expression into a stack of elements; raw elements are skipped up to their own end tag. All
other text becomes blocks, and every block element around them has a hash of its whole subtree: menus, footers and notices
too. Spark counts on how many different pages of a host each subtree occurs (pages with equal content count once, so
copies of an article don't make it a template) and how many pages the host has; a subtree on many of them is a template
and goes with all it holds. A subtree inside ``article`` or ``main`` must recur on nearly all pages to go.

Only what no template took is left to rules, in this order: ``tag`` (menus, headers, footers, sidebars, forms, notices,
adverts and reader comments by element, role or name) and ``outside`` (if at least a quarter of the text then left is in
``article`` or ``main``, text outside goes). ``removed`` counts the blocks that each of them takes.

At least a tenth of a host's pages must share a template, so a host has at most ten times as many as a page has subtrees;
that bounds the list that is joined to its pages. The list is broadcast if it is small, else shuffled.

Defined results: null and empty html give empty text. Rows without a host take part in no count and lose no template.
Rows without ``page_id`` and repeated rows are read like others. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import small_side, stage

OUTSIDE = (3, 0.1)
INSIDE = (10, 0.8)
ROOT_SHARE = 0.25

# HTML element names by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
GONE = RAW | frozenset("nav footer aside form button select head dialog menu option audio video".split())
BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
                  "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"br"}
SCOPE = frozenset("td th table div section article main li blockquote body html".split())
ROOTS = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset("advert adverts advertisement advertising sponsored banner cookies consent gdpr popup modal newsletter subscribe signup sidebar widget widgets "
                  "nav navbar navigation breadcrumb breadcrumbs footer masthead comments disqus pagination pager toolbar paywall".split())
# Names that mean something else beside other words (share-price): all other words must be furniture as well.
UNSURE = frozenset("ad ads adv sponsor sponsors promo promotion cookie notice overlay subscription menu comment replies reply share sharing social related "
                   "recommended recommendations skip login".split())
FURNITURE = frozenset("area bar block body bottom box btn button buttons container content footer form header icons inner item items left link links list main "
                      "page panel posts right section site slot text title to top wrap wrapper articles stories us this".split())
COMMENTS = frozenset("comment comments reply replies".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["']))*+)>""", re.S)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z0-9]+")


def _named(value: str) -> bool:
    for name in value.split():
        words = WORD.findall(name)
        if not NAMES.isdisjoint(words):
            return True
        if not UNSURE.isdisjoint(words) and all(w in UNSURE or w in FURNITURE or w.isdigit() for w in words):
            return True
    return False


def _gone(tag: str, attributes: str, in_root: bool) -> bool:
    if tag in GONE or (tag == "header" and not in_root):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes.lower()):
        value = value.strip("\"'")
        if name in ("class", "id") and (not COMMENTS.isdisjoint(value.split()) if tag == "article" else _named(value)):
            return True
        if tag == "article":
            continue
        if (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool, tuple[int, ...]]]:
    """(text, hidden by a tag rule, inside article or main, subtree hashes around it) of each text block, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[list] = []  # tag, hash parts, index of the first block, hidden, in a root
    text: list[str] = []
    chains: dict[int, list[int]] = {}

    def flush() -> None:
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if whole:
                out.append((whole, bool(stack) and stack[-1][3], bool(stack) and stack[-1][4]))
                if stack:
                    stack[-1][1].append(whole)

    def pop() -> None:
        tag, parts, first, hidden, rooted = stack.pop()
        if tag in BLOCK or (hidden and not (stack and stack[-1][3])):
            subtree = xxhash.xxh3_64_intdigest("\x00".join([tag, *parts])) >> 1
            if tag not in ("html", "body", "article", "main"):
                for i in range(first, len(out)):
                    chains.setdefault(i, []).append(subtree)
            if stack:
                stack[-1][1].append(str(subtree))
        elif stack:
            stack[-1][1].extend(parts)

    def close_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            pop()

    at = 0
    while m := TOKEN.search(page, at):
        closing, tag, attributes = m.group(1), m.group(2), m.group(3)
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in BLOCK or stack[depth][3] and not (depth and stack[depth - 1][3]):
                        close_to(depth)
                    elif depth == len(stack) - 1:
                        pop()
                    elif not any(stack[i][0] in BLOCK for i in range(depth + 1, len(stack))):
                        while len(stack) > depth:
                            pop()
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or (stack[depth][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    close_to(depth)
                    break
                if stack[depth][0] in SCOPE:
                    break
        if tag in BLOCK:
            flush()
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        parent = stack[-1] if stack else ["", [], 0, False, False]
        rooted = parent[4] or tag in ROOTS
        hidden = parent[3] or _gone(tag, attributes, parent[4])
        if tag in BLOCK or hidden:
            flush()
        stack.append([tag, [], len(out), hidden, rooted])
    if at < len(page):
        text.append(page[at:])
    close_to(0)
    return [(*block, tuple(chains.get(i, ()))) for i, block in enumerate(out)]


def judged(page: str | None, outer=frozenset(), inner=frozenset()) -> list[tuple[str, str]]:
    """(text, what becomes of it) of each block: template, tag, outside or kept.

    Blocks outside of article or main go with subtrees of ``outer``, those inside with subtrees of ``inner``: an article may
    hold a line that a menu holds too.
    """
    found = blocks(page or "")
    fates = ["template" if not (inner if inside else outer).isdisjoint(chain) else "tag" if hidden else "kept" for _, hidden, inside, chain in found]
    sizes = [0, 0]
    for (text, _, inside, _), fate in zip(found, fates):
        if fate == "kept":
            sizes[inside] += len(text)
    rooted = sizes[1] > 0 and sizes[1] >= ROOT_SHARE * sum(sizes)
    return [(text, "outside" if fate == "kept" and rooted and not inside else fate) for (text, _, inside, _), fate in zip(found, fates)]


def main_text(page: str | None, outer=frozenset(), inner=frozenset()) -> str:
    """The blocks that neither a template nor a rule takes, one per line."""
    return "\n".join(text for text, fate in judged(page, outer, inner) if fate == "kept")


def host_of(url):
    """Host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtrees(batches):
    """host, content and the distinct subtrees outside and inside of article or main, of each page."""
    for batch in batches:
        contents, outer, inner = [], [], []
        for page in batch.column(1):
            html = page.as_py() or ""
            found = blocks(html)
            contents.append(xxhash.xxh3_64_intdigest(main_text(html)) >> 1)
            outer.append(sorted({x for _, _, inside, chain in found if not inside for x in chain}))
            inner.append(sorted({x for _, _, inside, chain in found if inside for x in chain}))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip((contents, outer, inner), kinds)]], names=["host", "content", "outer", "inner"])


def site_templates(pages: DataFrame) -> DataFrame:
    """host, outer and inner (arrays of subtree hashes: outside and inside of article or main) of the hosts that have any."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).where("host <> ''")
    each = rows.mapInArrow(_subtrees, "host string, content long, outer array<long>, inner array<long>")
    # One page of each content; a page itself counts as subtree 0.
    once = each.groupBy("host", "content").agg(F.min(F.struct("outer", "inner")).alias("x"))
    spread = once.select("host", F.expr(
        "inline(concat(array(struct(0L AS subtree, false AS inside)), transform(x.outer, h -> struct(h AS subtree, false AS inside)), "
        "transform(x.inner, h -> struct(h AS subtree, true AS inside))))"))
    counts = stage(spread.groupBy("host", "subtree", "inside").agg(F.count("*").alias("pages")).where(f"subtree = 0 or pages >= {OUTSIDE[0]}"), "html-counts")
    totals = counts.where("subtree = 0").select("host", F.col("pages").alias("total"))
    least = F.when(F.col("inside"), F.greatest(F.lit(float(INSIDE[0])), INSIDE[1] * F.col("total"))).otherwise(F.greatest(F.lit(float(OUTSIDE[0])), OUTSIDE[1] * F.col("total")))
    return counts.where("subtree <> 0").join(totals, "host").where(F.col("pages") >= least).groupBy("host").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("inside") == inside, F.col("subtree")))).alias(name) for name, inside in (("outer", False), ("inner", True))])


def _sets(*drops: pa.Scalar) -> list[frozenset[int]]:
    return [frozenset(drop.as_py() or ()) for drop in drops]


def _text(pages: pa.Array, outer: pa.Array, inner: pa.Array) -> pa.Array:
    return pa.array([main_text(page.as_py(), *_sets(*drops)) for page, *drops in zip(pages, outer, inner)], pa.string())


def _with_templates(pages: DataFrame) -> DataFrame:
    drop = stage(site_templates(pages), "html-templates")
    return pages.withColumn("host", host_of(F.col("url"))).join(small_side(drop), "host", "left")


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    joined = _with_templates(pages.select("page_id", "url", "html"))
    return joined.select("page_id", "url", F.arrow_udf(_text, "string")("html", "outer", "inner").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def removed(pages: DataFrame) -> DataFrame:
    """Blocks by what becomes of them (fate: template, tag, outside, kept), with their characters."""

    def fates(batches):
        for batch in batches:
            rows = [(fate, len(text)) for page, *drops in zip(*batch.columns) for text, fate in judged(page.as_py(), *_sets(*drops))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["fate", "n_chars"])

    each = _with_templates(pages.select("url", "html")).select("html", "outer", "inner").mapInArrow(fates, "fate string, n_chars long")
    return each.groupBy("fate").agg(F.count("*").alias("blocks"), F.sum("n_chars").alias("n_chars"))
