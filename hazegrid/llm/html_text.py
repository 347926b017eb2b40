"""Main text of web pages: a suffix array per host against boilerplate, with the page's markup as evidence.

A page's blocks of text lie in its main part (`article`, or `main`), in its chrome (menus, footers, adverts and so on, by
element or class), or in neither. All blocks of a host's pages are concatenated as token streams and sorted as suffixes.
Substrings of LONG tokens and more that recur on distinct pages are boilerplate in an open block; in a main block, which the
markup speaks for, only those that a large share of the host's pages have. A page keeps the runs of its main and open blocks
that no boilerplate covers; chrome is never text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import BROADCAST_ROWS, slices
from hazegrid.session import cut_lineage, scratch_path

LONG = 8
# Pages of one host that meet in a suffix array; a larger host is dealt to several.
PAGES = 200
GROUP_TOKENS = 500_000
# In main parts, a passage is boilerplate if one in MAIN_SHARE of the host's distinct pages has it, and MAIN_PAGES at least.
MAIN_SHARE = 5
MAIN_PAGES = 10
# Texts that boilerplate changed are broadcast up to so many bytes.
BROADCAST_BYTES = 16 << 20

# Elements by what they do to the text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "object", "math", "canvas"}
# Of these, the ones whose inside HTML reads as text: without an end tag they reach to the end of the page. Others end at the next block then.
RAW_TEXT = {"script", "style", "textarea", "title", "iframe"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
MAIN = ("article", "main")
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words of a class or id that mark chrome, on elements that hold others.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "sidebar", "cookie", "cookies", "consent", "notice",
    "banner", "comment", "comments", "disqus", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "menu", "navbar", "nav", "popup", "modal",
    "share", "social", "related", "widget", "pagination", "toolbar",
}
# Words that say nothing of an element's kind. A class marks chrome if all its words are marks or these, one a mark at least: "cookie-banner" and
# "related-posts" do, "share-price", "comment-policy" and "no-sidebar" tell of something else.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "desktop", "form", "header", "icons", "inline",
    "inner", "item", "items", "js", "left", "link", "links", "list", "main", "mobile", "overlay", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site",
    "sticky", "thread", "title", "top", "unit", "wrap", "wrapper",
}
MARKED = {"div", "section", "ul", "ol", "p", "span", "table", "dl", "details", "article", "li"}

_tag = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.S)
_unfinished = re.compile(r"<[A-Za-z/!?][^>]*\Z")
_marks = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# One attribute: its name, and its value if it has one.
_attribute = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_no_display = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


def _hidden(attributes: str) -> bool:
    """Whether an element has the attribute `hidden` (but for `until-found`), or a style that does not display it."""
    for m in _attribute.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" and value.strip().lower() != "until-found" or name == "style" and _no_display.search(value):
            return True
    return False


def _is_chrome(name: str, attributes: str) -> bool:
    if name in CHROME:
        return True
    if not attributes or name not in MARKED:
        return False
    if _hidden(attributes):
        return True
    names = [n for m in _marks.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    parts = [{w for w in re.split(r"[^a-z]+", n) if w} for n in names]
    return any(p & MARKS and p <= MARKS | NEUTRAL for p in parts)


class _Inside:
    """Which elements of a page hold its main part or its heading. Places are looked up once per page, so many elements cost no more."""

    def __init__(self, low: str):
        self.low = low
        self.heads = [m.start() for m in re.finditer(r"<(?:article|main|h1)\b", low)]
        self.ends: dict[str, list[int]] = {}

    def holds_main(self, begin: int, name: str) -> bool:
        """For the element `name` that opens before `begin`, up to its next end tag; without one, up to the end of the page."""
        if name not in self.ends:
            self.ends[name] = [m.start() for m in re.finditer(rf"</{name}\b", self.low)]
        ends = self.ends[name]
        at = bisect_left(ends, begin)
        close = ends[at] if at < len(ends) else len(self.low)
        at = bisect_left(self.heads, begin)
        return at < len(self.heads) and self.heads[at] < close


_next_block = re.compile("<(?:" + "|".join(sorted(BLOCK)) + r")\b", re.I)


def _lower(html: str) -> str:
    """Lower case with every place kept: the few characters that would become two stay as they are."""
    low = html.lower()
    return low if len(low) == len(html) else html.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def blocks(html: str) -> tuple[bool, list[tuple[str, str]]]:
    """Whether the page has a main part, and its blocks in order as (zone, text), zone being main, chrome or open."""
    out: list[tuple[str, str]] = []
    pieces: list[str] = []
    low = inside = None
    main = 0                      # depth inside main parts
    skip, depth = "", 0           # the chrome element we are in, and how often its name is open
    has_main = False

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append(("chrome" if skip else "main" if main else "open", text))
            pieces.clear()

    at = 0
    while m := _tag.search(html, at):
        if m.start() > at:
            pieces.append(html[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK or name in MAIN:
            flush()
        elif name == "br":
            pieces.append(" ")
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                low = low if low is not None else _lower(html)
                end = low.find(f"</{name}", at)
                if end >= 0:
                    at = low.find(">", end) + 1 or len(html)
                elif name in RAW_TEXT:
                    at = len(html)
                else:
                    at = m.start() if (m := _next_block.search(html, at)) else len(html)
            continue
        if skip:
            if closing:
                if name == skip:
                    depth -= 1
                    if not depth:
                        flush()
                        skip = ""
                elif name in MAIN and main:
                    flush()
                    skip, main = "", main - 1
            elif name in MAIN and not main and not _is_chrome(name, attributes):
                flush()
                skip, main, has_main = "", 1, True
            elif name == skip and not attributes.endswith("/"):
                depth += 1
            continue
        if closing:
            if name in MAIN and main:
                main -= 1
        elif name not in VOID and _is_chrome(name, attributes):
            # a header in a main part and a form around the page are no chrome if the heading or the article is in them
            if name == "form" or main and name == "header":
                low = low if low is not None else _lower(html)
                inside = inside or _Inside(low)
                if inside.holds_main(at, name):
                    continue
            flush()
            skip, depth = name, 1
        elif name in MAIN:
            main += 1
            has_main = True
    pieces.append(_unfinished.sub("", html[at:]))
    flush()
    return has_main and any(z == "main" for z, _ in out), out


def _joined(pages: list[list[str]]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Where each page's stream begins, and all distinct streams as numbers of words, each with a separator of its own (below
    0) after it; whose each token is; and a 64-bit hash per number."""
    number: dict[str, int] = {}
    begins: dict[tuple[int, ...], int] = {}
    of, at = [], 0
    for words in pages:
        s = tuple([number.setdefault(w, len(number)) for w in words])
        if s not in begins:
            begins[s] = at
            at += len(s) + 1
        of.append(begins[s])
    tokens, owner, _ = _tokens(list(begins))
    return of, tokens, owner, np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)


def _tokens(streams: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, int]:
    sizes = np.array([len(s) + 1 for s in streams], np.int64)
    owner = np.repeat(np.arange(len(streams)), sizes)
    tokens = np.fromiter((t for k, s in enumerate(streams) for t in (*s, -1 - k)), np.int64, len(owner))
    return tokens, owner, len(streams)


def _windows(tokens: np.ndarray, owner: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of the `long` tokens from each place on, and for each class on how many streams and where first it is found.

    The suffixes are sorted by doubling until `long` tokens are compared: neighbours with equal ranks share that many."""
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < long:
        step = min(width, long - width)
        ahead = np.full(len(rank), -1)
        ahead[:len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    order = np.argsort(rank, kind="stable")
    begins = np.diff(rank[order], prepend=-1) != 0
    fresh = begins | (np.diff(owner[order], prepend=-1) != 0)
    return rank, np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(begins)), order[begins]


def _hashes(tokens: np.ndarray, words: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of `long` tokens without a separator begin, and their hashes, which are the same in every group."""
    n = len(tokens)
    each = words[np.maximum(tokens, 0)] if len(words) else np.zeros(n, np.uint64)
    out = np.zeros(max(n - long + 1, 0), np.uint64)
    for k in range(long):
        out += each[k:k + len(out)] * np.uint64(xxhash.xxh3_64_intdigest(f"place {k}") | 1)
    ends = np.concatenate([[0], np.cumsum(tokens < 0)])
    at = np.flatnonzero(ends[long:] == ends[:len(out)]) if len(out) else np.zeros(0, np.int64)
    return at, out[at].view(np.int64)


def _found(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The index of each hash in `wanted`, which is sorted, or -1."""
    if not len(wanted):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return np.where(wanted[at] == hashes, at, -1)


def _inside(begins: np.ndarray, n: int, long: int) -> np.ndarray:
    """Which of `n` tokens lie in a window of `long` tokens that begins at one of `begins`."""
    marks = np.zeros(n + long + 1, np.int64)
    np.add.at(marks, begins, 1)
    np.add.at(marks, begins + long, -1)
    return np.cumsum(marks)[:n] > 0


def _own_runs(hit: np.ndarray, long: int) -> np.ndarray:
    """A block's covered tokens, without runs shorter than `long` that only reach in from a neighbouring block."""
    hit = hit.copy()
    if not hit.all():
        edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a < long:
                hit[a:b] = False
    return hit


def _kept(page: list[tuple[str, str]], twice: np.ndarray, wide: np.ndarray, long: int) -> str:
    """The text of a page: open blocks without the tokens in `twice`, main blocks without those in `wide`, chrome not at all.

    A page whose main part would lose more than half of its tokens keeps them: there the passage is the article. If more than three quarters
    of its open blocks would go, it is a page that another one repeats with few changes (a print version, a reprint); then only what is in
    `wide` goes from them."""
    parts, at = [], 0
    for zone, text in page:
        words = text.split()
        parts.append((zone, text, words, twice[at:at + len(words)], wide[at:at + len(words)]))
        at += len(words)

    def share(zone: str, mask: int) -> float:
        hits = [_own_runs(p[mask], long) for p in parts if p[0] == zone]
        return sum(int(h.sum()) for h in hits) / max(1, sum(map(len, hits)))

    lost_main, repeated = share("main", 4) > 0.5, share("open", 3) > 0.75
    out = []
    for zone, text, words, two, many in parts:
        if zone == "chrome":
            continue
        hit = _own_runs(many if zone == "main" or repeated else two, long)
        if not hit.any() or (zone == "main" and lost_main):
            out.append(text)
        elif not hit.all():
            out.append(" ".join(w for w, h in zip(words, hit, strict=True) if not h))
    return "\n\n".join(out)


def main_least(n: int) -> int:
    """On how many of a host's `n` distinct pages a passage of main parts is boilerplate."""
    return max(MAIN_PAGES, -(-n // MAIN_SHARE))


def unique_runs(pages: list[list[tuple[str, str]]], long: int = LONG, shared: tuple[np.ndarray, np.ndarray] | None = None) -> list[str]:
    """For pages of one host, the runs of their main and open blocks that are no boilerplate, joined. The pages are all of
    the host, unless `shared` has the hashes of windows that two of its pages have, and of those that enough have for main parts."""
    words = [[w for _, text in page for w in text.split()] for page in pages]
    of, tokens, owner, hashes = _joined(words)
    if shared is None:
        rank, counts, _ = _windows(tokens, owner, long)
        often = counts[rank]
        begins = [np.flatnonzero(often >= least) for least in (2, main_least(int((tokens < 0).sum())))]
    else:
        at, own = _hashes(tokens, hashes, long)
        begins = [at[_found(own, np.sort(x)) >= 0] for x in shared]
    twice, wide = (_inside(x, len(tokens), long) for x in begins)
    out = []
    for page, own, at in zip(pages, words, of, strict=True):
        end = at + len(own)
        out.append(_kept(page, twice[at:end], wide[at:end], long) if twice[at:end].any() else _whole(page))
    return out


def _pack(page: list[tuple[str, str]]) -> str:
    """A page's blocks as one text. No text of a block holds a separator of units: it is white space."""
    return "\x1f".join(zone[0] + text for zone, text in page)


def _unpack(group: pa.Table) -> dict[bytes, list[tuple[str, str]]]:
    """The distinct pages of a group by their keys."""
    zones = {"m": "main", "o": "open", "c": "chrome"}
    out = {}
    for key, size, packed in zip(group.column("layout").to_pylist(), group.column("size").to_pylist(), group.column("packed").to_pylist(), strict=True):
        if key not in out:
            text = pa.decompress(packed, size, "zstd", asbytes=True).decode()
            out[key] = [(zones[x[0]], x[1:]) for x in text.split("\x1f")]
    return out


def _whole(page: list[tuple[str, str]]) -> str:
    return "\n\n".join(text for zone, text in page if zone != "chrome")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", long: int = LONG, pages: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by an empty line.
    Pages are parsed once and written to the shared folder (runs jobs). Pages with blocks meet per host, at most about `pages`
    of them and GROUP_TOKENS tokens in a group, however many a host has; only the texts that boilerplate changes come back.
    A host of several groups has the same result as in one: windows are counted over all of its groups by their 64-bit hashes.
    Where the host has open blocks, each group gives the counts of all its windows. Elsewhere a passage of enough pages of
    the host is one of enough pages of some group, so only such windows are then counted in all groups.

    Null and empty html give an empty text. A null url counts as a host of its own. Repeated rows give repeated rows
    (a page's copies are one page to the suffix array); an empty table gives an empty result; other columns are ignored."""
    spark = df.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    source = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("__html"))
    source = source.withColumn("host", host)
    schema = T.StructType([*source.schema.fields[:2], *T.StructType.fromDDL(
        "host string, blocks array<struct<zone:string,text:string>>, layout binary, stream long, n_tokens int, first boolean").fields])

    def parse(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        seen = set()
        for batch in batches:
            for part in slices(batch, "__html"):
                found = [blocks(h or "")[1] for h in part.column("__html").to_pylist()]
                joined = [" ".join(t for _, t in b) for b in found]
                layout = [xxhash.xxh3_128_digest(_pack(b)) for b in found]
                first = []
                for key in zip(part.column("host").to_pylist(), layout, strict=True):
                    first.append(key not in seen)
                    seen.add(key)
                new = [[[{"zone": z, "text": t} for z, t in b] for b in found], layout, np.array([xxhash.xxh3_64_intdigest(j) for j in joined], np.uint64).view(np.int64),
                       [j.count(" ") + 1 if j else 0 for j in joined], first]
                own = [part.column(n) for n in ("page_id", "url", "host")]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, f.type) for x, f in zip(new, list(arrow)[3:], strict=True)]], names=schema.names)

    path = scratch_path(spark, "pages")
    source.mapInArrow(parse, schema).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    # A task sends one of a host's equal pages; pages with equal streams are dealt to one group.
    sent = stored.where(F.col("first") & (F.col("n_tokens") > 0)).select("host", "layout", "stream", "n_tokens", "blocks")
    parts = F.greatest(F.ceil(F.count("*") / pages), F.ceil(F.sum("n_tokens") / GROUP_TOKENS)).cast("int")
    hosts = cut_lineage(sent.groupBy("host").agg(parts.alias("parts"), F.max(F.exists("blocks", lambda b: b["zone"] == "open")).alias("every"))
                        .withColumnRenamed("host", "h"), "hosts")
    at_host = F.col("host") == F.col("h")

    def pack(batches):
        for batch in batches:
            texts = [_pack([(b["zone"], b["text"]) for b in r]).encode() for r in batch.column("blocks").to_pylist()]
            codec = pa.Codec("zstd", compression_level=6)
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), batch.column("stream"), pa.array(map(len, texts), pa.int64()),
                                              pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], names=["host", "layout", "stream", "size", "packed"])

    packed = sent.select("host", "layout", "stream", "blocks").mapInArrow(pack, "host string, layout binary, stream long, size long, packed binary")
    dealt = (packed.join(hosts, at_host).withColumn("part", F.pmod(F.xxhash64("stream"), F.col("parts")).cast("int"))
             .select("host", "part", "parts", "every", "layout", "size", "packed"))
    several = dealt.where("parts > 1")

    def only(df: DataFrame, listed: DataFrame, *keys: str) -> DataFrame:
        listed = cut_lineage(listed.select(*keys).distinct(), "listed")
        return df.join(F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed, list(keys), "left_semi").select(df.columns)

    def rows(group: pa.Table, hashes, n, above) -> pa.Table:
        host, part = (group.column(c)[0].as_py() if group.num_rows else None for c in ("host", "part"))
        hashes = pa.array(hashes, pa.int64())
        return pa.table({"host": pa.array([host] * len(hashes), pa.string()), "part": pa.array([part] * len(hashes), pa.int32()), "window": hashes, "n": pa.array(n, pa.int64()),
                         "above": pa.array(above, pa.int64())})

    def tally(group: pa.Table) -> pa.Table:
        _, tokens, owner, words = _joined([[w for _, t in page for w in t.split()] for page in _unpack(group).values()])
        _, counts, first = _windows(tokens, owner, long)
        streams = int((tokens < 0).sum())
        least = 1 if group.column("every")[0].as_py() else -(-streams // MAIN_SHARE)
        often = np.zeros(len(tokens), np.int64)
        often[first] = counts
        at, hashes = _hashes(tokens, words, long)
        often, hashes = often[at][often[at] >= least], hashes[often[at] >= least]
        # the row without a window has the number of distinct streams, and the most that a window not given here can have
        return rows(group, [None, *hashes.tolist()], [streams, *often.tolist()], [least - 1, *(often - least + 1).tolist()])

    def count(group: pa.Table, windows: pa.Table) -> pa.Table:
        if not group.num_rows or not windows.num_rows:
            return rows(group, [], [], [])
        _, tokens, owner, words = _joined([[w for _, t in page for w in t.split()] for page in _unpack(group).values()])
        at, hashes = _hashes(tokens, words, long)
        wanted = np.sort(windows.column("window").to_numpy())
        found = _found(hashes, wanted)
        pairs = np.unique(np.stack([found, owner[at]])[:, found >= 0], axis=1)
        n = np.bincount(pairs[0], minlength=len(wanted))
        return rows(group, wanted[n > 0], n[n > 0], n[n > 0])

    def judge(group: pa.Table, windows: pa.Table | None) -> pa.Table:
        found, shared = _unpack(group), None
        if windows is not None:
            hashes, wide = windows.column("window").to_numpy(), windows.column("wide").to_numpy(zero_copy_only=False).astype(bool)
            shared = hashes, hashes[wide]
        texts = dict(zip(found, unique_runs(list(found.values()), long, shared), strict=True))
        changed = [k for k, page in found.items() if texts[k] != _whole(page)]
        return pa.table({"h": pa.array([group.column("host")[0].as_py()] * len(changed), pa.string()) if changed else pa.array([], pa.string()),
                         "key": pa.array(changed, pa.binary()), "less": pa.array([texts[k] for k in changed], pa.string())})

    form = "host string, part int, window long, n long, above long"
    tallied = cut_lineage(several.groupBy("host", "part").applyInArrow(tally, form), "tallied")
    totals = tallied.where("window is null").groupBy("host").agg(F.sum("n").alias("total"), F.sum("above").alias("unseen")).join(hosts, at_host)
    totals = totals.select("h", "every", "parts", "unseen", "total", F.greatest(F.lit(MAIN_PAGES), F.ceil(F.col("total") / MAIN_SHARE)).alias("least"))
    totals = cut_lineage(totals, "totals")
    seen = tallied.where("window is not null").join(totals, at_host)
    # what cannot reach the least number, even with the most that the other groups can have, need not be counted
    hopeful = seen.where("not every").groupBy("host", "window", "parts", "unseen", "least").agg(F.sum("above").alias("above")).where("above + unseen >= least")
    hopeful = cut_lineage(hopeful.select("host", "window", "parts"), "hopeful")
    wanted = hopeful.select("host", "window", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    counted = only(several, hopeful, "host").groupBy("host", "part").cogroup(wanted.groupBy("host", "part")).applyInArrow(count, form)
    everywhere = (seen.where("every").select("host", "part", "window", "n", "above").unionByName(counted)
                  .groupBy("host", "window").agg(F.sum("n").alias("n"), F.collect_list("part").alias("in")).join(totals, at_host)
                  .withColumn("wide", F.col("n") >= F.col("least")))
    shared = cut_lineage(everywhere.where("wide or every and n > 1").select("host", F.explode("in").alias("part"), "window", "wide"), "shared")
    alone = dealt.where("parts = 1").groupBy("host", "part").applyInArrow(lambda group: judge(group, None), "h string, key binary, less string")
    judged = alone.unionByName(only(several, shared, "host", "part").groupBy("host", "part").cogroup(shared.groupBy("host", "part")).applyInArrow(
        judge, "h string, key binary, less string"))
    changed = cut_lineage(judged, "changed")
    small = (changed.agg(F.sum(F.octet_length("less"))).first()[0] or 0) <= BROADCAST_BYTES
    whole = F.array_join(F.transform(F.filter("blocks", lambda b: b["zone"] != "chrome"), lambda b: b["text"]), "\n\n")
    return (stored.join(F.broadcast(changed) if small else changed, at_host & (F.col("layout") == F.col("key")), "left")
            .select("page_id", "url", F.coalesce("less", whole).alias("text")).withColumn("n_chars", F.length("text").cast("long")))
