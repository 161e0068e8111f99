"""Main text of web pages: markup, and a host suffix array for what repeats over pages.

1. A page's tags are matched and its subtrees of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments dropped, by element, role, class or id. The rest is cut into blocks at block elements. An article or main element vouches for what is inside; text outside of it stays too, but for blocks full of links, if it doesn't repeat over the host. Inside an article a class or id marks an element only as a whole name (perhaps with a fixed affix), and names with other meanings (AMBIGUOUS) only if a third of the element's text is links.
2. Blocks that markup vouches for (paragraphs, headings, lists, quotations and the like inside an article or main element) are compared as wholes. Of everything else (what was dropped, with negative block numbers; bare divisions; all blocks of a page without such an element) the token streams of a host's pages are concatenated, in groups of pages of bounded size, and their suffixes sorted, with the length of each common prefix of neighbours. Substrings of LENGTH tokens and of LONG tokens that several suffixes share count in how many distinct pages they stand; groups are summed up by key, so a host with a third of all pages is many groups.
3. A substring repeats if it has LONG tokens and stands on PAGES pages, or LENGTH tokens and stands on a SHARE of the host's pages too; a whole block of any length if it stands on PAGES pages and a BLOCK_SHARE of the host's, one that markup vouches for on VOUCHED_PAGES and half of the host's. What repeats is removed from a page where it stands on at least PAGES times as many pages as the least shared fifth of the page's text does: so copies of an article, in which everything is shared alike, stay, whatever their markup, and a notice in them goes. Unique runs between stay.

Defined results: null html is empty and gives an empty text; a null url is a host of its own. Rows that repeat get the same text each and count as one page. Character references are decoded also without semicolon, as browsers do. An element that is never closed is dropped to where a browser ends it: p at the next block element, li, dd, dt, td and tr at the next of their kind, and these and all others at the end of their parent, or at the next article or main element or the end of the page if no parent is closed. An empty table gives no rows. Pages are read whole, in time that grows as they do: a tag that is never closed ends at the next one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, skew_join, small_batches, table

LENGTH, LONG, PAGES, SHARE, BLOCK_SHARE, VOUCHED_PAGES, LEAST_SHARED = 6, 20, 3, 0.2, 0.005, 10, 0.2
GROUP_TOKENS, BROADCAST_ROWS = 1 << 19, 50_000
#: Fixed names of HTML elements.
DROP = frozenset("head title script style noscript template nav footer aside form button select option textarea iframe svg canvas object embed applet menu dialog audio video map".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOUCHED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption caption td th summary".split())
#: What ends an element whose end tag is left out.
ENDED_BY = {"p": BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "legend"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "th": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "option": {"option", "optgroup"}}
CELLS = frozenset("td th tr tbody tfoot thead".split())
#: Elements outside of which a new li, dd, dt or part of a table ends nothing.
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}} | dict.fromkeys(CELLS, {"table"})
#: By element, which ones its start tag may end, and beyond which open element it ends nothing.
ENDS = {name: {o for o, by in ENDED_BY.items() if name in by} for name in set().union(*ENDED_BY.values())}
WALLS = {name: SCOPE.get(name, set()) | (set() if name in CELLS else set(BLOCKS) - set(ENDED_BY) - ({"div", "address"} if name in SCOPE else set())) for name in ENDS}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed words that mark an element as not of the article, as whole parts of a class or id.
MARKS = frozenset("ad ads adsense advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments respond disqus replies social share sharing related recommended recommendations widget toolbar masthead copyright searchbox".split())
#: Of them those with other meanings: dropped inside an article only if they are full of links.
AMBIGUOUS = frozenset("menu related share sharing social recommended recommendations".split())
#: Fixed words that may stand beside them in a class or id.
AFFIXES = frozenset("area articles bar block bottom box button buttons container content desktop form group header heading icons inline inner items js left links list main mobile outer panel posts right section slot small stories text title top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
#: Comments, elements whose content is no markup, tags, tags that are never closed (they end at the next one), declarations.
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)|<[!?][^<>]*>|<[!?/a-zA-Z][^<>]*\Z""", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[a-z]+")


def _names(value: str) -> set[str]:
    """The marks that are names of their own in a class or id, perhaps with fixed affixes."""
    found = set()
    for token in value.split():
        parts = re.split(r"[-_]+", token)
        marks = MARKS.intersection(parts)
        if marks and all(x in MARKS or x in AFFIXES or not x or x.isdigit() for x in parts):
            found |= marks
    return found


def _link_words(page: str, tags: list) -> tuple[np.ndarray, np.ndarray]:
    """Words, and words in links, in the text before each tag and after the last, added up."""
    words, linked = np.zeros(len(tags) + 2, np.int64), np.zeros(len(tags) + 2, np.int64)
    at, begin = 0, -1
    for i, (start, end, closing, name, _) in enumerate(tags):
        words[i + 1] = words[i] + len(page[at:start].split())
        linked[i + 1] = linked[i]
        at = end
        if name == "a" and not closing and begin < 0:
            begin = i
        elif name == "a" and closing and begin >= 0:
            linked[i + 1] += words[i + 1] - words[begin + 1]
            begin = -1
    words[-1], linked[-1] = words[-2] + len(page[at:].split()), linked[-2]
    return words, linked


def _only_ambiguous(attributes: str) -> bool:
    """Whether only names with other meanings mark an element of an article."""
    for key, value in NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if _names(value) - AMBIGUOUS:
                return False
        elif _marked("", f'{key}="{value}"', True):
            return False
    return True


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's attributes say that it isn't of the article."""
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if inside:
                if _names(value):
                    return True
                continue
            parts = PARTS.findall(value)
            if MARKS.intersection(parts) or "header" in parts:
                return True
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _ends(tags: list[tuple[bool, str]]) -> tuple[dict[int, int], dict[int, int]]:
    """Of tags (closing, name): the end tag of each element that has one, and for the others the tag before which they end (none if nothing ends them). Open elements are a stack, with the places of each name in it; what is closed below the top only loses its mark, so each element is looked at a bounded number of times."""
    close: dict[int, int] = {}
    ended: dict[int, int] = {}
    stack: list[int] = []
    is_open: list[bool] = []
    where: dict[str, list[int]] = {}

    def forget(name: str) -> None:
        where[name].pop()
        if not where[name]:
            del where[name]

    def end(depth: int, at: int) -> None:
        while len(stack) > depth:
            j = stack.pop()
            if is_open.pop():
                ended[j] = at
                forget(tags[j][1])

    for i, (closing, name) in enumerate(tags):
        if not name or name in VOID:
            continue
        if closing:
            if name in where:
                depth = where[name][-1]
                if name in BLOCKS and max((where[x][-1] for x in ("article", "main") if x in where), default=-1) <= depth:
                    end(depth + 1, i)
                close[stack[depth]] = i  # crossed tags end nothing else
                forget(name)
                is_open[depth] = False
                while is_open and not is_open[-1]:
                    stack.pop()
                    is_open.pop()
            continue
        if name in ENDS:
            while (depth := max((where[o][-1] for o in ENDS[name] if o in where), default=-1)) > max((at[-1] for o, at in where.items() if o in WALLS[name]), default=-1):
                end(depth, i)
        where.setdefault(name, []).append(len(stack))
        stack.append(i)
        is_open.append(True)
    return close, ended


def blocks(page: str, dropped: list[str] | None = None) -> list[tuple[str, bool]]:
    """(text, vouched for) of the blocks that markup leaves; dropped gets the text of those it doesn't."""
    tags = []  # start, end, closing, name, attributes
    for m in TAG.finditer(page):
        name = (m[3] or m[6] or "").lower()
        tags.append((m.start(), m.end(), bool(m[2] or m[5]), name, m[4] or m[7] or ""))
    close, ended = _ends([(t[2], t[3]) for t in tags])
    roots = [i for i, t in enumerate(tags) if not t[2] and t[3] == "article" and not _marked(t[3], t[4], True)] or [i for i, t in enumerate(tags) if not t[2] and (t[3] == "main" or re.search(r"role\s*=\s*[\"']?main\b", t[4]))]
    spans = [(i, close[i]) for i, t in enumerate(tags) if roots and i in close and t[3] not in ("article", "main") and (t[3] in DROP or t[3] == "header" or _marked(t[3], t[4], False))]
    starts_of, reach = [a for a, _ in spans], np.maximum.accumulate([b for _, b in spans]) if spans else []
    covered = lambda r: (n := bisect_left(starts_of, r)) > 0 and reach[n - 1] > r
    free = [r for r in roots if not covered(r)]
    around = set() if free else {a for a, b in spans if bisect_right(roots, a) < bisect_left(roots, b)}  # marked, but all there is of the article is inside
    roots = free or roots
    starts = set(roots)
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[str] = []  # open blocks, and how often each name is among them
    count: dict[str, int] = {}
    inside, skip_to, until, at, begun = 0, -1, -1, 0, -1  # until: the tag up to which text belongs to a dropped element without end tag
    ends: list[int] = []
    linked = None

    def pop() -> str:
        name = stack.pop()
        count[name] -= 1
        return name

    def full_of_links(i: int) -> bool:
        """Whether a third of an element's words are links."""
        words, of_links = links()
        to = close.get(i, ended.get(i, len(tags))) + 1
        return 3 * (of_links[to] - of_links[i + 1]) >= words[to] - words[i + 1]

    def links() -> tuple[np.ndarray, np.ndarray]:
        nonlocal linked
        linked = linked or _link_words(page, tags)
        return linked

    def flush(i: int) -> None:
        """Ends a block before tag i. Outside the article a block that is full of links isn't of it."""
        nonlocal begun
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        since, begun = begun, i
        if block and roots and not inside:
            words, of_links = links()
            if 3 * (of_links[i + 1] - of_links[since + 1]) >= words[i + 1] - words[since + 1]:
                if dropped is not None:
                    dropped.append(block)
                return
        if block:
            out.append((block, bool(inside) and bool(stack) and stack[-1] in VOUCHED))

    for i, (start, end, closing, name, attributes) in enumerate(tags):
        if i > skip_to and i != until:
            text.append(page[at:start])
        at = end
        if i <= skip_to or not name:
            continue
        if not closing and name not in VOID and i not in starts and i not in around and (name in DROP or name == "header" and not inside or _marked(name, attributes, bool(inside)) and not (inside and _only_ambiguous(attributes) and not full_of_links(i))):
            if name in BLOCKS or name in ("title", "head"):
                flush(i)
            if i in close:
                skip_to = close[i]
            else:
                until = min(ended.get(i, len(tags)), roots[n] if (n := bisect_right(roots, i)) < len(roots) else len(tags))
                skip_to = until - 1
            if dropped is not None and name != "head":
                rest = page[end : tags[skip_to][0] if i in close else tags[skip_to + 1][0] if skip_to + 1 < len(tags) else len(page)]
                if words := " ".join(html.unescape(TAG.sub(" ", rest)).split()):
                    dropped.append(words)
            continue
        if name == "br":
            text.append(" ")
        if name in BLOCKS:
            flush(i)
            if closing:
                while count.get(name) and pop() != name:
                    pass
            else:
                if name in VOUCHED:
                    while stack and stack[-1] == "p":
                        pop()
                if name not in VOID:
                    stack.append(name)
                    count[name] = count.get(name, 0) + 1
        if i in starts:
            inside += 1
            heappush(ends, close.get(i, len(tags)))
        while ends and i >= ends[0]:
            heappop(ends)
            inside -= 1
    if until < len(tags):
        text.append(page[at:])
    flush(len(tags))
    return out


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _hashes(block: str) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) >> 2 for w in block.split()), np.int64)


WINDOW, LONG_WINDOW, WHOLE = 0, 1, 2


def _key(place: str, tokens: np.ndarray) -> int:
    """The key of a whole block of a host."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), xxhash.xxh32_intdigest(place, WHOLE)) - (1 << 63)


def _window_keys(place: str, kind: int, tokens: np.ndarray, length: int) -> np.ndarray:
    """The key of each substring of length tokens of a host, of kind WINDOW or LONG_WINDOW, all at once."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    t = tokens.astype(np.uint64)
    t ^= t >> np.uint64(31)
    out = np.full(n, xxhash.xxh64_intdigest(place, kind), np.uint64)
    for i in range(length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += t[i : i + n]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key, block, sure, whole (the whole block's key) and tokens (none for blocks that markup vouches for) of the blocks of pages."""
    for b in batches:
        out = [[] for _ in range(6)]
        for key, url, page in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), b.column("html")):
            dropped: list[str] = []
            kept = blocks(page.as_py(), dropped)
            place = host(url)
            for n, block, sure in [*((n, x, sure) for n, (x, sure) in enumerate(kept)), *((-1 - n, x, False) for n, x in enumerate(dropped))]:
                tokens = _hashes(block)
                for col, v in zip(out, (place, key, n, sure, _key(place, tokens), [] if sure else tokens)):
                    col.append(v)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "key", "block", "sure", "whole", "tokens"])


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the length of the prefix that each has in common with the one before (0 for the first). By prefix doubling until all differ; common lengths from the ranks of all doublings, longest first."""
    n = len(tokens)
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    while n and levels[-1].max() < n - 1:
        rank, step = levels[-1], 1 << (len(levels) - 1)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        levels.append(np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    same = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        size = 1 << level
        i, j = a + same, b + same
        inside = np.maximum(i, j) + size <= n
        equal = np.zeros(len(same), bool)
        equal[inside] = levels[level][i[inside]] == levels[level][j[inside]]
        same += size * equal
    common[1:] = same
    return order, common


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """One group of pages of a host: keys of the substrings of LENGTH and of LONG tokens, and in how many of the pages each stands, from the suffix array of the concatenated streams."""
    rows = rows.sort_values(["key", "block"])
    place = rows["host"].iloc[0]
    parts = [np.asarray(t, np.int64) for t in rows["tokens"]]
    sizes = np.array([len(t) + 1 for t in parts])
    stream = np.concatenate([x for i, t in enumerate(parts) for x in (t, np.array([-1 - i]))])  # each end is unlike all others
    page = np.repeat(rows["key"].to_numpy(np.int64), sizes)
    left = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(len(stream))  # tokens to the block's end
    order, common = suffix_array(stream)
    keys, kinds, counts = [], [], []
    for kind, length in ((WINDOW, LENGTH), (LONG_WINDOW, LONG)):
        of = np.cumsum(common < length)  # suffixes that share so many tokens stand together
        good = left[order] >= length
        at, of = order[good], of[good]
        if not len(at):
            continue
        by = np.lexsort((page[at], of))
        at, of = at[by], of[by]
        new = np.r_[True, of[1:] != of[:-1]]
        other = new | np.r_[True, page[at][1:] != page[at][:-1]]
        first = np.flatnonzero(new)
        counts += np.add.reduceat(other.astype(np.int64), first).tolist()
        keys += _window_keys(place, kind, stream, length)[at[first]].tolist()
        kinds += [kind] * len(first)
    return pd.DataFrame({"host": place, "kind": pd.Series(kinds, dtype="int32"), "window": pd.Series(keys, dtype="int64"), "pages": pd.Series(counts, dtype="int64")})


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of all substrings and whole blocks."""
    for b in batches:
        out = [[] for _ in range(5)]
        for place, key, block, whole, tokens in zip(b.column("host").to_pylist(), b.column("key").to_pylist(), b.column("block").to_pylist(), b.column("whole").to_pylist(), b.column("tokens")):
            tokens = tokens.values.to_numpy(zero_copy_only=False)
            parts = [(np.zeros(1, np.int64), -1, np.array([whole]))]
            for kind, length in ((WINDOW, LENGTH), (LONG_WINDOW, LONG)):
                keys = _window_keys(place, kind, tokens, length)
                parts.append((np.arange(len(keys)), length, keys))
            n = sum(len(at) for at, _, _ in parts)
            for col, v in zip(out, (np.full(n, key), np.full(n, block), np.concatenate([at for at, _, _ in parts]), np.concatenate([np.full(len(at), size) for at, size, _ in parts]), np.concatenate([k for _, _, k in parts]))):
                col.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds)], ["key", "block", "at", "size", "window"])


def repeats(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """pages(key, url, html) to key and spans (array of block, at, size (-1: the whole block), pages) that repeat over the host's pages."""
    small_batches(pages.sparkSession)
    host_of = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    sizes = pages.groupBy(host_of.alias("host")).agg(F.count(F.lit(1)).alias("n_pages"))
    rows = materialize(pages.mapInArrow(_streams, "host string, key bigint, block int, sure boolean, whole bigint, tokens array<bigint>"), "streams")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("tokens")).first()
    some = rows.where(F.size("tokens") >= LENGTH).select("host", "key", "block", "tokens")
    groups = some.groupBy("host").agg(F.ceil(F.sum(F.size("tokens") + 1) / GROUP_TOKENS).cast("int").alias("groups"))
    dealt = skew_join(some, groups, "host", total["n"], "inner").withColumn("group", F.pmod(F.xxhash64("key"), F.col("groups").cast("bigint")))
    shared = dealt.groupBy("host", "group").applyInPandas(_shared, "host string, kind int, window bigint, pages bigint")
    inner = shared.groupBy("host", "kind", "window").agg(F.sum("pages").alias("pages"))
    wholes = rows.groupBy("host", "whole", "key").agg(F.max("sure").alias("sure")).groupBy("host", F.col("whole").alias("window")).agg(F.count(F.lit(1)).alias("pages"), F.max("sure").alias("sure"))
    inner = inner.where(F.col("pages") >= PAGES).join(sizes, "host").where((F.col("kind") == LONG_WINDOW) | (F.col("pages") >= F.col("n_pages") * share))
    least = F.when(F.col("sure"), F.greatest(F.lit(VOUCHED_PAGES), F.col("n_pages") / 2)).otherwise(F.col("n_pages") * BLOCK_SHARE)
    wholes = wholes.where(F.col("pages") >= PAGES).join(sizes, "host").where(F.col("pages") >= least)
    often = materialize(inner.select("window", "pages").unionByName(wholes.select("window", "pages")).groupBy("window").agg(F.max("pages").alias("pages")), "often")
    spread = rows.where("block >= 0").select("host", "key", "block", "whole", "tokens").mapInArrow(_spread, "key bigint, block int, at int, size int, window bigint")
    found = skew_join(spread, often, "window", 2 * (total["tokens"] or 0) + total["n"], "inner")
    return found.groupBy("key").agg(F.collect_set(F.struct("block", "at", "size", "pages")).alias("spans"))


def _text(page: str, spans) -> str:
    """Blocks joined by line ends, without the spans that stand on many more pages than the least shared of the page's text."""
    kept = [x for x, _ in blocks(page)]
    if not spans:
        return "\n".join(kept)
    words = [x.split() for x in kept]
    pages = [np.ones(len(x), np.int64) for x in words]
    for s in spans:
        if s["block"] < len(pages):
            part = pages[s["block"]][s["at"] : s["at"] + s["size"] if s["size"] >= 0 else None]
            np.maximum(part, s["pages"], out=part)
    every = np.sort(np.concatenate(pages))
    least = PAGES * every[int(len(every) * LEAST_SHARED)]
    out = (" ".join(w for w, n in zip(x, p.tolist()) if n < least) if (p >= least).any() else t for t, x, p in zip(kept, words, pages))
    return "\n".join(x for x in out if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    spans = materialize(repeats(rows.select("key", "url", "html").where("html <> ''")), "spans")
    small = spans.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.size("spans"))).first()
    side = F.broadcast(spans) if small[0] <= BROADCAST_ROWS and (small[1] or 0) <= 20 * BROADCAST_ROWS else spans
    both = rows.join(side, "key", "left") if small[0] else rows.withColumn("spans", F.lit(None).cast("array<struct<block:int,at:int,size:int,pages:bigint>>"))
    kind = dict(rows.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_text(p.as_py(), s.as_py()) for p, s in zip(b.column("html"), b.column("spans"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "spans").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
