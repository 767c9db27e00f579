"""HTML extraction with host suffix arrays.

A page is cut into text blocks, each with what its surroundings say: inside the
page's main container (article, main), inside furniture (menus, headers, footers,
sidebars, notices, adverts, forms, comments), or neither. What stands outside main
containers (on a page without one: everything) makes the host's stream of tokens,
whose suffix array (prefix doubling, in numpy) shows the substrings of at least
``SHORTEST`` tokens that stand in several distinct pages. Blocks of the stream that
such substrings cover are boilerplate; so is furniture, covered or not, and on a
page with a container whatever stands outside it. Text inside a container isn't in
the stream: copies, quotations and a heading that a menu repeats are part of the
article.

A host may have any number of pages, so its pages are dealt to shards of about
``SHARD`` pages; each has a suffix array of its own, which gives every run of
``SHORTEST`` tokens and how many distinct pages of the shard have it. These counts
are summed over all shards of the host, and a run is repeated by the host's sum.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pages of a host that share a suffix array, least tokens of a repeated substring, and distinct pages that make it boilerplate.
SHARD = 256
SHORTEST = 4
PAGES = 3
#: A block is boilerplate if so large a share of its tokens is covered.
COVERED = 0.5
#: Hosts are broadcast with their counts up to this number, else joined by a shuffle.
BROADCAST_HOSTS = 100_000

#: The runs of a host are summed in so many parts at most.
PARTS = 1024

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>)", re.S)
_HINT = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_FURNITURE_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|comments?|disqus|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|menu|nav\w*|breadcrumbs?|pagination|pager|toolbar|widget|footer|masthead|search|complementary|contentinfo|alert|copyright|tags?)(?:$|[\s_-])",
    re.I,
)
_SKIP = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "select", "textarea", "button", "canvas", "audio", "video", "head", "title"}
_FURNITURE = {"nav", "aside", "footer", "form", "menu", "dialog"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "form", "fieldset", "address", "hr", "details", "summary", "body", "html", "menu", "dialog", "center"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_END_OF = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _SKIP}
MAIN, FURNITURE, PLAIN = 0, 1, 2


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order; kind: MAIN, FURNITURE or PLAIN. White space is one space, references are decoded, empty blocks are left out."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    kind, pos, n = PLAIN, 0, len(page)

    def close_block():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((kind, text))
            parts.clear()

    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            parts.append(page[pos:])
            break
        if m.start() > pos:
            parts.append(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if tag in _SKIP and not closing:
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            if tag == "head":
                # A head without end lasts until the body.
                e = _END_OF[tag].search(page, pos) or re.compile(r"(?=<body[\s>])", re.I).search(page, pos)
                pos = e.end() if e else pos
                continue
            e = _END_OF[tag].search(page, pos)
            pos = e.end() if e else n
            parts.append(" ")
            continue
        if tag not in _BLOCK:
            if tag == "br":
                parts.append(" ")
            if tag not in ("span", "em", "strong", "b", "i", "a") or closing:
                continue
            if kind == FURNITURE or 'class' not in m[3] or not _hinted(m[3]):
                continue
        close_block()
        if tag == "hr":
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    kind = stack[i][1]
                    del stack[i:]
                    break
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
            kind = stack.pop()[1]
        stack.append((tag, kind))
        if kind != FURNITURE or tag in ("article", "main"):
            if tag in _FURNITURE or (tag == "header" and kind != MAIN) or _hinted(m[3]):
                kind = FURNITURE
            elif tag in ("article", "main") or 'role="main"' in m[3]:
                # An article inside furniture (a reader's comment, a teaser) stays furniture.
                kind = MAIN if kind != FURNITURE or not any(t in ("article", "main", "aside", "footer", "section", "div") for t, _ in stack[:-1]) else FURNITURE
    close_block()
    return out


def _hinted(attributes: str) -> bool:
    if len(attributes) < 4 or "=" not in attributes:
        return False
    return any(_FURNITURE_HINT.search(a or b or c) for a, b, c in _HINT.findall(attributes))


# -- the suffix array --------------------------------------------------------------


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a row of integers and, for each suffix but the first, the common prefix with the one before it."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while k < n and rank.max() < n - 1:
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[: n - k] = rank[k:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = new
        levels.append(rank)
        k *= 2
    sa = np.argsort(rank, kind="stable")
    a, b, common_prefix = sa[:-1].copy(), sa[1:].copy(), np.zeros(max(0, n - 1), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        # Equal ranks at a level mean 2**level equal tokens, unless both end before.
        step = np.minimum(1 << level, n - np.maximum(a, b))
        common_prefix += np.where(same, step, 0)
        a, b = np.where(same, a + step, a), np.where(same, b + step, b)
    return sa, common_prefix


def repeated(pages: list[list[str]], shortest: int = SHORTEST, least_pages: int = PAGES) -> list[np.ndarray]:
    """Of each page's tokens, which are covered by a substring of ``shortest`` tokens or more that stands in ``least_pages`` distinct pages."""
    ids: dict[str, int] = {}
    lens = np.array([len(p) for p in pages], dtype=np.int64)
    stream = np.empty(int(lens.sum()) + len(pages), dtype=np.int64)
    page_of = np.repeat(np.arange(len(pages)), lens + 1)
    at = 0
    for i, p in enumerate(pages):
        stream[at : at + len(p)] = [ids.setdefault(t, len(ids)) for t in p]
        stream[at + len(p)] = -1 - i  # no substring goes beyond its page
        at += len(p) + 1
    sa, lcp = suffix_array(stream)
    cover = np.zeros(len(stream) + 1, dtype=np.int64)
    joined = lcp >= shortest
    if joined.any():
        group = np.concatenate([[0], np.cumsum(~joined)])
        pairs = np.unique(group * len(pages) + page_of[sa])
        distinct = np.bincount(pairs // len(pages), minlength=int(group[-1]) + 1)
        # A longer substring that enough pages share is the union of its runs of the shortest length, each of which they share.
        keep = sa[(distinct[group] >= least_pages) & (np.bincount(group)[group] > 1)]
        np.add.at(cover, keep, 1)
        np.add.at(cover, np.minimum(keep + shortest, len(stream)), -1)
    covered = np.cumsum(cover[:-1]) > 0
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    return [covered[b : b + n] for b, n in zip(starts, lens)]


def _streamed(pages: list[list[str]], shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' hashes in one stream with a gap after each page, the lengths of pages, and the hash of the run at each position (0 where it would leave its page)."""
    known: dict[str, int] = {}
    lens = np.array([len(p) for p in pages], dtype=np.int64)
    flat = np.zeros(int(lens.sum()) + len(pages), dtype=np.uint64)
    left = np.zeros(len(flat), dtype=np.int64)
    at = 0
    for p in pages:
        for t in p:
            if t not in known:
                known[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        flat[at : at + len(p)] = [known[t] for t in p]
        left[at : at + len(p)] = np.arange(len(p), 0, -1)
        at += len(p) + 1
    runs = np.zeros(len(flat), dtype=np.uint64)
    for j in range(min(shortest, len(flat))):
        runs[: len(flat) - j] = (runs[: len(flat) - j] ^ flat[j:]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    runs |= np.uint64(1)
    runs[left < shortest] = 0
    return flat, lens, runs


def shard_runs(pages: list[list[str]], keys: list, seen: tuple | None = None, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """Hashes of a shard's distinct runs of the shortest length, ascending; how many distinct page keys have each; and (last key, its runs).

    Rows with the same key are one page and stand together. seen is the third
    result of the rows before, so that a page cut in two is counted once.
    """
    flat, lens, runs = _streamed(pages, shortest)
    if not runs.any():
        last = (keys[-1], seen[1] if seen and seen[0] == keys[-1] else np.zeros(0, np.uint64)) if keys else seen
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), last
    numbers: dict = {}
    page = np.repeat([numbers.setdefault(k, len(numbers)) for k in keys], lens + 1)
    ends = np.cumsum(lens + 1) - 1
    stream = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    stream[ends] = -1 - np.arange(len(pages))
    sa, lcp = suffix_array(stream)
    group = np.concatenate([[0], np.cumsum(lcp < shortest)])
    whole = runs[sa] != 0
    sa, group = sa[whole], group[whole]
    pairs = np.unique(group * len(numbers) + page[sa])
    names = np.zeros(int(group.max()) + 1, dtype=np.uint64)
    names[group] = runs[sa]
    who, of = pairs // len(numbers), pairs % len(numbers)
    mine = names[who[of == numbers[keys[-1]]]]
    first = np.ones(len(pairs), dtype=bool)
    if seen and seen[0] == keys[0]:
        first = ~((of == 0) & np.isin(names[who], seen[1]))
        if seen[0] == keys[-1]:
            mine = np.union1d(mine, seen[1])
    found, at = np.unique(names[who[first]], return_inverse=True)
    return found, np.bincount(at, minlength=len(found)), (keys[-1], mine)


def covered_by(pages: list[list[str]], repeats: np.ndarray, shortest: int = SHORTEST) -> list[np.ndarray]:
    """Of each page's tokens, which are covered by one of the runs."""
    _, lens, runs = _streamed(pages, shortest)
    hit = np.flatnonzero(np.isin(runs, repeats) & (runs != 0))
    cover = np.zeros(len(runs) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + shortest, -1)
    covered = np.cumsum(cover[:-1]) > 0
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    return [covered[b : b + n] for b, n in zip(starts, lens)]


def outside(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks that the host's stream has: those outside the page's main containers, or all where it has none."""
    return [x for x in found if x[0] != MAIN] if any(k == MAIN for k, _ in found) else found


def main_text(found: list[tuple[int, str]], covered: np.ndarray) -> tuple[str, int]:
    """The main text of a page's blocks and how many tokens of its outside blocks are repeated. covered: for the tokens of these in order."""
    inside = any(k == MAIN for k, _ in found)
    kept, at = [], 0
    for kind, text in found:
        if kind == MAIN:
            kept.append(text)
            continue
        n = text.count(" ") + 1
        part = covered[at : at + n]
        at += n
        if kind == PLAIN and not inside and part.mean() < COVERED:
            kept.append(text)
    return "\n\n".join(kept), int(covered.sum())


def _parsed(which):
    """Blocks of each page, packed: all of them, or those that ``which`` leaves."""

    def run(batches):
        for b in batches:
            packed = [zlib.compress(json.dumps(which(blocks(x or ""))).encode("utf-8", "surrogatepass"), 1) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(3), b.column(4), b.column(5), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "shards", "shard", "blocks"])

    return run


def _tokens(packed: bytes) -> list[str]:
    return [t for _, text in json.loads(zlib.decompress(packed)) for t in text.split(" ")]


def _key(page_id, url):
    """What makes two rows the same page: the id, or the url where it is null."""
    return ("", url) if page_id is None else page_id


def _counted(batches):
    """host, part, shard, runs, pages: the runs of a shard, by part. Shards stand in sorted rows, one after the other."""
    from lagspace.llm import html as own

    key, rows, seen = None, [], None

    def counted():
        nonlocal seen
        host, shard, shards = key
        runs, pages, seen = own.shard_runs([own._tokens(r[2]) for r in rows], [own._key(r[0], r[1]) for r in rows], seen)
        part = (runs % np.uint64(min(shards, PARTS))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        runs, pages, part = runs[order], pages[order], part[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
        out = [(host, int(part[b]), shard, runs[b:e].tobytes(), zlib.compress(pages[b:e].tobytes(), 1)) for b, e in zip(cuts[:-1], cuts[1:])]
        cols = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["host", "part", "shard", "runs", "pages"])

    for b in batches:
        for page_id, url, host, shards, shard, packed in zip(*[c.to_pylist() for c in b.columns]):
            if (host, shard, shards) != key or len(rows) >= 4 * SHARD:
                if rows:
                    yield counted()
                if (host, shard, shards) != key:
                    seen = None
                key, rows = (host, shard, shards), []
            rows.append((page_id, url, packed))
    if rows:
        yield counted()


def _summed(batches):
    """host, shard, runs: those of each shard's runs that enough pages of the host have."""
    key, rows = None, []

    def repeats():
        runs = [np.frombuffer(r[1], np.uint64) for r in rows]
        found, at = np.unique(np.concatenate(runs), return_inverse=True)
        pages = np.bincount(at, np.concatenate([np.frombuffer(zlib.decompress(r[2]), np.int64) for r in rows]), len(found))
        enough = (pages >= PAGES)[at]
        cuts = np.cumsum([len(x) for x in runs])[:-1]
        kept = [(key[0], r[0], x[k].tobytes()) for r, x, k in zip(rows, runs, np.split(enough, cuts)) if k.any()]
        cols = list(zip(*kept)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["host", "shard", "runs"])

    for b in batches:
        for host, part, shard, runs, pages in zip(*[c.to_pylist() for c in b.columns]):
            if (host, part) != key:
                if rows:
                    yield repeats()
                key, rows = (host, part), []
            rows.append((shard, runs, pages))
    if rows:
        yield repeats()


def _extracted(batches):
    """Shards stand in sorted rows, one after the other, each with its repeated runs before its pages."""
    from lagspace.llm import html as own

    key, rows, runs, repeats = None, [], [], None

    def shard():
        nonlocal repeats
        if repeats is None:
            repeats = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r, np.uint64) for r in runs]]))
        pages = [json.loads(zlib.decompress(r[2])) for r in rows]
        covered = own.covered_by([[t for _, text in own.outside(p) for t in text.split(" ")] for p in pages], repeats)
        done = [(r[0], r[1], *own.main_text([tuple(x) for x in p], c)) for r, p, c in zip(rows, pages, covered)]
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array([len(t) for t in cols[2]], pa.int64()), pa.array(cols[3], pa.int64())], names=["page_id", "url", "text", "n_chars", "repeated"])

    for b in batches:
        for page_id, url, host, part, packed, is_page in zip(*[c.to_pylist() for c in b.columns]):
            if (host, part) != key or len(rows) >= 4 * SHARD:
                if rows:
                    yield shard()
                if (host, part) != key:
                    runs, repeats = [], None
                key, rows = (host, part), []
            if is_page:
                rows.append((page_id, url, packed))
            else:
                runs.append(packed)
    if rows:
        yield shard()


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, repeated of every row of pages.

    A null or empty page has an empty text, and so has one without a block to
    keep. Pages with a null url share the empty host. Repeated rows stay repeated,
    and count as one page.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = common.pick(pages, "page_id", "url", "html").withColumn("host", host)
    counts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    if counts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        counts = F.broadcast(counts)
    shard = F.pmod(F.xxhash64(F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url"))), F.col("shards")).cast("int")
    dealt = rows.join(counts, "host").select("page_id", "url", "html", "host", "shards", shard.alias("shard"))
    ddl = "page_id long, url string, host string, shards int, shard int, blocks binary"
    # Pages are parsed twice, so that only the few blocks outside containers are shuffled for the arrays.
    own = dealt.mapInArrow(_parsed(outside), ddl).repartition("host", "shard").sortWithinPartitions("host", "shard", "page_id", "url").mapInArrow(_counted, "host string, part int, shard int, runs binary, pages binary")
    parsed = dealt.mapInArrow(_parsed(list), ddl)
    repeats = own.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(_summed, "host string, shard int, runs binary")
    both = parsed.select("page_id", "url", "host", "shard", "blocks", F.lit(1).alias("is_page")).unionByName(repeats.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "host", "shard", F.col("runs").alias("blocks"), F.lit(0).alias("is_page")))
    return both.repartition("host", "shard").sortWithinPartitions("host", "shard", "is_page", "page_id", "url").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long, repeated long")
