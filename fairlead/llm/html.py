"""Main text of web pages: what markup says, and for the rest a host's suffix array.

1. Each page is parsed to blocks of text. Markup settles most: blocks inside an article are *main*, menus, headers,
   footers, sidebars, notices, adverts, forms and comments are *chrome*; other blocks are *open*. What is chrome only
   by a word of its class or id, or as a form, is less sure: an article in it that is larger than all other main text
   is main (and if the page has nothing else, what stands right in it is open), and inside an article a block that is
   chrome by a word only is *unclear*, but for comments and what is called an advert and nothing else.
2. A page's blocks, whatever their kind, are its token stream. A host's streams, a chunk of pages at a time, are
   concatenated, and a suffix array with common prefixes finds the runs of eight tokens or more that pages share. Near
   copies count as one page, so versions of one text don't erase what they share. Parts of a large host are dealt to
   many tasks and their counts added up.
3. Blocks that lie wholly in runs on a share of the host's pages are boilerplate. On a page without an article the
   open blocks that are not are its text. Inside an article only what stands on half of the host's pages, and on ten at
   least, goes; unclear blocks go if they are boilerplate or stand on another page too.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm import jaccard
from fairlead.llm.common import batches, materialize, small_batches
from fairlead.operators.shared import look_up

#: Tokens of a repeated run at least. Tokens of a chunk at most, about.
RUN, CHUNK_TOKENS = 8, 1_000_000
#: A run is boilerplate from so many pages of the host and so large a share of them. The second share is for pages that
#: would be left with nothing and, from ARTICLE_PAGES, for blocks of articles. Pages without an article are near copies
#: from this percentage of shared runs.
MIN_PAGES, SHARE, SURE_SHARE, ARTICLE_PAGES, COPY_PCT = 3, 0.2, 0.5, 10, 40
#: Runs on no more than this share of a part of a host are not named by that part. Pages of a group that counts again.
PART_SHARE, COUNT_PAGES = 0.05, 2000
#: Runs that are broadcast at most; beyond, hosts with a share of 1 / HOT of the pages are joined in SALTS parts.
BROADCAST_RUNS, HOT, SALTS = 500_000, 1000, 64

# Elements and words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes object audio video canvas svg math head title textarea select".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended recommendations widget comment comments disqus "
    "respond replies discussion".split()
)
#: These say chrome inside an article too, whatever the host's other pages hold.
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
#: So do these, where they are a whole class or id.
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsored cookies newsletter".split())
#: These say chrome outside an article only; an article may have a header of its own.
OUTER_WORDS = frozenset("header head top".split())
MAIN_ROLES, MAIN_TAGS = frozenset(["main", "article"]), frozenset(["article", "main"])
#: Opening one of the keys closes an open element of the values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An end tag doesn't reach beyond these, unless it is theirs.
WALLS = frozenset("article main body html table td th nav footer aside form header section div".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*)(>|\Z|(?=<))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

MAIN, OPEN, CHROME, UNCLEAR = 0, 1, 2, 3
#: A wrapper that is chrome by a word or as a form, an article in one, and an unclear block in that article.
WRAPPER, INNER, INNER_UNCLEAR = 4, 5, 6


def _zone(tag: str, attrs: str, zone: int) -> int:
    """Kind of an element inside an element of kind ``zone``."""
    if zone == CHROME or tag in CHROME_TAGS and tag != "form":
        return CHROME
    inside = zone in (MAIN, UNCLEAR, INNER, INNER_UNCLEAR)
    if tag == "form":
        return CHROME if inside else WRAPPER
    article = tag in MAIN_TAGS
    if attrs and attrs.strip():
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
        role = found.get("role", "").lower()
        if role in CHROME_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return CHROME
        article = article or role in MAIN_ROLES or found.get("itemprop", "").lower() == "articlebody"
        named = {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        if tag not in ("html", "body", "article", "main"):
            if named & COMMENT_WORDS:
                return CHROME
            if named & CHROME_WORDS and not (article and inside):
                if inside and not ADVERT_NAMES.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split()):
                    return CHROME
                return {MAIN: UNCLEAR, INNER: INNER_UNCLEAR}.get(zone, zone) if inside else WRAPPER
            if named & OUTER_WORDS and not inside:
                return WRAPPER
    if inside:
        return zone
    if article:
        return INNER if zone == WRAPPER else MAIN
    return CHROME if tag == "header" else zone


class _Zone(int):
    """A kind with the element it comes from: ``wrapper`` counts wrappers from the outermost, ``article`` is its number."""

    depth, wrapper, article = 0, 0, 0


def _settled(found: list[tuple[_Zone, str]]) -> list[tuple[int, str]]:
    """Wrappers and what is in them, settled by the page as a whole."""
    if all(z < WRAPPER for z, _ in found):
        return [(int(z), t) for z, t in found]
    sizes: dict[tuple[int, int, int], int] = {}
    for z, t in found:
        if z in (INNER, INNER_UNCLEAR):
            key = (-z.depth, z.wrapper, z.article)
            sizes[key] = sizes.get(key, 0) + len(t)
    largest = max(sizes, key=lambda k: (k[0], sizes[k]), default=None)  # the outermost, then the largest, then the first
    reopened = largest[1] if largest and sizes[largest] > sum(len(t) for z, t in found if z in (MAIN, UNCLEAR)) else None
    bare = not sizes and all(z in (CHROME, WRAPPER) for z, _ in found)
    out = []
    for z, t in found:
        if z in (INNER, INNER_UNCLEAR):
            kind = (MAIN if z == INNER else UNCLEAR) if z.wrapper == reopened else CHROME
        else:
            kind = int(z) if z < WRAPPER else OPEN if bare and z.depth == 1 else CHROME
        out.append((kind, t))
    return out


def blocks(page: str) -> list[tuple[int, str]]:
    """``(zone, text)`` of each block with text, in page order."""
    out: list[tuple[_Zone, str]] = []
    stack: list[tuple[str, _Zone]] = []
    outside = _Zone(OPEN)
    zone, parts, at = outside, [], 0

    def inside(tag: str, attrs: str, outer: _Zone) -> _Zone:
        kind = _zone(tag, attrs, outer)
        if kind == outer and not (kind == WRAPPER and _zone(tag, attrs, OPEN) == WRAPPER):
            return outer
        new = _Zone(kind)
        new.depth, new.wrapper, new.article = outer.depth, outer.wrapper, outer.article
        if kind == WRAPPER:
            new.depth, new.wrapper = outer.depth + 1, m.start()
        elif kind == INNER:
            new.article = m.start()
        return new

    def text(raw: str) -> None:
        if raw:
            parts.append(_html.unescape(raw) if "&" in raw else raw)

    def flush() -> None:
        if parts:
            if words := "".join(parts).split():
                out.append((zone, " ".join(words)))
            parts.clear()

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[4] and at == len(page) and not m[0].endswith(">"):  # cut off inside a tag
            break
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE or stack[i][1] is not zone:
                        flush()
                    del stack[i:]
                    zone = stack[-1][1] if stack else outside
                    break
                if stack[i][0] in WALLS and tag not in WALLS:
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = _END_OF[tag].search(page, at)
                if tag not in ("head",):
                    at = end.end() if end else len(page)
                elif end:
                    at = end.end()
            if tag not in ("svg", "math", "select"):
                flush()
            continue
        inner = inside(tag, m[3], zone)
        if tag not in INLINE or inner is not zone:
            flush()
        if tag in VOID or m[3].rstrip().endswith("/") and tag in INLINE:
            continue
        for closed in CLOSES.get(tag, ("p",) if tag not in INLINE else ()):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == closed:
                    del stack[i:]
                    zone = stack[-1][1] if stack else outside
                    inner = inside(tag, m[3], zone)
                    break
                if stack[i][0] in WALLS or stack[i][0] in ("ul", "ol", "dl", "tr"):
                    break
        stack.append((tag, inner))
        zone = inner
    else:
        text(page[at:])
    flush()
    return _settled(out)


def token_codes(texts: list[str]) -> tuple:
    """16-bit codes of all texts' tokens, and where each text begins and the last ends. Tokens are compared by these
    codes: different runs of RUN tokens that differ in one are taken for equal once in 65,536 cases."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = split.values.dictionary_encode()
    of = np.array([xxhash.xxh3_64_intdigest(t.encode()) & 0xFFFF for t in coded.dictionary.to_pylist()], np.uint16)
    return of[coded.indices.to_numpy()], split.offsets.to_numpy()


def window_hashes(codes):
    """A 64-bit hash of the RUN codes from each position on; fewer codes have none."""
    import numpy as np

    n = len(codes) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(RUN):
            h = (h + codes[i : n + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def suffix_array(text) -> tuple:
    """``order, lcp`` of a sequence whose last token is the only one of its kind: the suffixes in order, and how many
    tokens each has in common with the one before. Prefix doubling; a round sorts only what is still tied, and the
    ranks of each round give the common prefixes."""
    import numpy as np

    n = len(text)
    order = np.argsort(text, kind="stable")
    at = np.arange(n)
    head = np.concatenate([[True], np.diff(text[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    tied = order[~(head & np.append(head[1:], True))]
    rounds, width = [rank.astype(np.int32)], 1
    while len(tied):
        before, after = rank[tied], rank[tied + width]
        o = np.argsort(before * n + after, kind="stable")
        tied, before, after = tied[o], before[o], after[o]
        new_group = np.concatenate([[True], np.diff(before) != 0])
        head = new_group | np.concatenate([[True], np.diff(after) != 0])
        at = np.arange(len(tied))
        rank[tied] = before + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        tied = tied[~(head & np.append(head[1:], True))]
        rounds.append(rank.astype(np.int32))
        width *= 2
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    left, right, common = order[:-1], order[1:], lcp[1:]
    for k in reversed(range(len(rounds))):
        same = rounds[k][np.minimum(left + common, n - 1)] == rounds[k][np.minimum(right + common, n - 1)]
        common += same.astype(np.int64) << k
    return order, lcp


def shared_runs(hosts: list[int], streams: list) -> tuple:
    """Of the streams of codes of pages: ``host, hash, pages`` of each run of RUN tokens, and on how many pages of the
    host it is.

    The streams are concatenated, with a token of its own kind after each page, and a host's tokens differ from all
    others'. Suffixes with a common prefix of RUN tokens or more stand together in the suffix array. A stretch of a page
    lies in maximal repeats on so many pages exactly if it lies in such runs, which chunks of a host can exchange."""
    import numpy as np

    lengths = np.array([len(s) for s in streams])
    ends = np.cumsum(lengths + 1)
    host = np.array(hosts, np.int64)
    page = np.repeat(np.arange(len(streams)), lengths + 1)
    text = np.concatenate([part for s in streams for part in (s, [0])]).astype(np.int64) + (host[page] << 16)
    text[ends - 1] = ((int(host.max()) + 1) << 16) + np.arange(len(streams))
    hashes = np.concatenate([part for s in streams for w in [window_hashes(s)] for part in (w, np.zeros(len(s) + 1 - len(w), np.int64))])
    order, lcp = suffix_array(text)
    whole = ends[page[order]] - 1 - order >= RUN
    group = np.cumsum(lcp < RUN)[whole]
    order = order[whole]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(group * len(streams) + page[order])  # each page once in a group
    of_group, pages = np.unique(pairs // len(streams), return_counts=True)
    first = order[np.searchsorted(group, of_group)]
    return host[page[first]], hashes[first], pages


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.lit("")))


def _text_hash(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "little", signed=True)


def _coded(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``uid`` (of the row), ``host``, ``codes`` (the token stream), ``sketch`` (the least run hash of the main text, so
    copies have the same and near copies mostly), ``first`` (whether it is the first of its tokens here), ``open`` (the
    text that stands outside an article, on a page without one) and ``doubtful`` (hashes of the unclear blocks)."""

    def run(frames: Iterator):
        import pyarrow as pa

        seen: set = set()
        for batch in batches(frames):
            found = [blocks(page or "") for page in batch.column(1).to_pylist()]
            codes, at = token_codes([t for b in found for _, t in b])
            cols: dict[str, list] = {c: [] for c in ("codes", "sketch", "first", "open", "doubtful")}
            n = 0
            for host, own in zip(batch.column(0).to_pylist(), found, strict=True):
                places = at[n : n + len(own) + 1]
                n += len(own)
                article = [codes[a:b] for (z, _), a, b in zip(own, places[:-1], places[1:], strict=True) if z == MAIN]
                cols["codes"].append(codes[places[0] : places[-1]].astype("<u2").tobytes())
                cols["open"].append(None if article or any(z == UNCLEAR for z, _ in own) else " ".join(t for z, t in own if z == OPEN) or None)
                cols["doubtful"].append([_text_hash(t) for z, t in own if z == UNCLEAR])
                sketch = _sketch(article)
                cols["sketch"].append(sketch)
                same = (host, _text_hash(cols["codes"][-1].hex()))  # pages of equal tokens count as one anyway
                cols["first"].append(same not in seen)
                seen.add(same)
            if len(seen) > 500_000:
                seen.clear()
            kinds = {"codes": pa.binary(), "sketch": pa.int64(), "first": pa.bool_(), "open": pa.string(), "doubtful": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[c], k) for c, k in kinds.items())], names=["host", *kinds])

    found = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(run, "host string, codes binary, sketch long, first boolean, open string, doubtful array<long>")
    # named by their content, so that nothing depends on how rows are dealt; equal pages of a host have one name
    named = found.withColumn("uid", F.xxhash64("host", "codes"))
    # a page without an article is like no other here; its near copies are found by their texts
    return named.withColumn("sketch", F.coalesce("sketch", "uid"))


def _sketch(article: list) -> int | None:
    import numpy as np

    if not article:
        return None
    codes = np.concatenate(article)
    hashes = window_hashes(codes)
    return int(hashes.min()) if len(hashes) else _text_hash(codes.tobytes().hex())


def _once(coded: DataFrame) -> DataFrame:
    """``uid, host, sketch, codes`` of the pages that are counted: of near copies on a host only one."""
    some = coded.where("first").select("uid", "host", "sketch", "codes")
    pages = coded.where(F.col("open").isNotNull())
    if pages.isEmpty():
        return some
    salt = F.hex(F.xxhash64("host"))  # copies on other hosts share nothing
    words = F.concat(salt, F.regexp_replace("open", F.lit(" "), F.concat(F.lit(" "), salt)))
    copies = jaccard.near_duplicates(pages.select("uid", words.alias("text")), RUN, COPY_PCT, "uid", "text").where("component_id <> uid").select("uid")
    small_batches(coded.sparkSession, 200)
    return some.join(copies, "uid", "left_anti")


def repeated_runs(pages: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``host, run, pages``: the runs that may be boilerplate and on how many pages each is; a null run has the number of
    all pages. From ``uid, host, sketch, codes``; of pages of one sketch, that with the least tokens (as bytes) counts.

    Pages are dealt by ranges of host and sketch, so a large host is spread over many tasks and small ones share one.
    A task makes a suffix array of each chunk of pages. Of a host that lies wholly inside a chunk, runs on MIN_PAGES
    pages and the share SHARE are left; of a part of a host, runs on more than PART_SHARE of the part's pages, so what a
    part doesn't name is on few of its pages. Runs that some part doesn't name, and that may still reach the share, are
    counted again, on all pages of their host, so that the counts don't depend on how a host is cut.
    """

    def run(frames: Iterator):
        import numpy as np
        import pyarrow as pa

        def rows(chunk: list, cut: set):
            """``chunk``: (host, codes); ``cut``: hosts that have pages elsewhere too."""
            names = list(dict.fromkeys(h for h, _ in chunk))
            place = {h: i for i, h in enumerate(names)}
            own = [place[h] for h, _ in chunk]
            total = np.bincount(own, minlength=len(names))
            host, run_, pages_ = shared_runs(own, [c for _, c in chunk])
            part = np.array([h in cut for h in names])
            slack = np.where(part, np.floor(total * PART_SHARE), 0).astype(np.int64)
            least = np.where(part, slack + 1, np.maximum(np.ceil(total * SHARE), MIN_PAGES))
            keep = pages_ >= least[host]
            of = np.array([*names], object)
            columns = [pa.array([*of[host[keep]], *names], pa.string()), pa.array([*run_[keep].tolist(), *[None] * len(names)], pa.int64())]
            counts = [pa.array([*x[keep].tolist(), *y.tolist()], pa.int64()) for x, y in ((pages_, total), (slack[host], slack))]
            return pa.RecordBatch.from_arrays([*columns, *counts], names=["host", "run", "pages", "slack"])

        chunk, size, last, cut = [], 0, None, set()
        for batch in batches(frames):
            for host, sketch, codes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (host, sketch) == last:
                    continue
                if last is None:
                    cut.add(host)  # it may have begun in another task
                if size > chunk_tokens:
                    if host == last[0]:
                        cut.add(host)
                    yield rows(chunk, cut)
                    chunk, size, cut = [], 0, cut & {host}
                last = (host, sketch)
                chunk.append((host, np.frombuffer(codes, "<u2")))
                size += len(codes) // 2 + 1
        if chunk:
            yield rows(chunk, cut | {last[0]})  # it may go on in another task

    dealt = pages.repartitionByRange("host", "sketch").sortWithinPartitions("host", "sketch", "codes")
    parts = dealt.select("host", "sketch", "codes").mapInArrow(run, "host string, run long, pages long, slack long")
    found = materialize(parts.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.sum("slack").alias("slack")), "part-runs")
    hosts = found.where(F.col("run").isNull()).select("host", F.col("pages").alias("total"), F.col("slack").alias("all_slack"))
    # what a run may be on besides: the slack of the parts that don't name it
    both = found.join(hosts, "host").withColumn("more", F.when(F.col("run").isNull(), 0).otherwise(F.col("all_slack") - F.col("slack")))
    least = F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("total") * SHARE))
    open_ = (F.col("more") > 0) & (F.col("pages") + F.col("more") >= least)
    unsure = materialize(both.where(open_).groupBy("host").agg(F.sort_array(F.collect_list("run")).alias("runs"), F.first("total").alias("total")), "unsure-runs")
    sure = both.where(F.col("run").isNull() | ((F.col("more") == 0) & ~open_)).select("host", "run", "pages")
    return sure if unsure.isEmpty() else sure.unionByName(_counted_again(pages, unsure))


def _counted_again(pages: DataFrame, unsure: DataFrame) -> DataFrame:
    """``host, run, pages`` of the runs of ``unsure`` (``host, runs, total``), a few for each token of a page. A host's
    pages are dealt to groups of about COUNT_PAGES by their sketch, and each group gets the host's runs."""
    dealt = unsure.select("host", F.ceil(F.col("total") / COUNT_PAGES).alias("groups"), F.col("total").alias("n"))
    own = look_up(pages.select("host", "sketch", "codes"), dealt, "host", "n").where(F.col("groups").isNotNull())
    own = own.withColumn("group", F.pmod(F.xxhash64("sketch"), F.col("groups"))).drop("groups")
    copies = unsure.join(dealt.drop("n"), "host").select("host", "runs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))

    def count(left, right):
        import numpy as np
        import pyarrow as pa

        host = right["host"][0].as_py() if right.num_rows else None
        runs = np.array(right["runs"][0].as_py() if right.num_rows else [], np.int64)
        least: dict[int, bytes] = {}
        for sketch, codes in zip(left["sketch"].to_pylist(), left["codes"].to_pylist(), strict=True):
            least[sketch] = min(least.get(sketch, codes), codes)
        n = np.zeros(len(runs), np.int64)
        for codes in least.values():
            own = np.unique(window_hashes(np.frombuffer(codes, "<u2")))
            n += np.isin(runs, own)
        return pa.table({"host": pa.array([host] * len(runs), pa.string()), "run": pa.array(runs), "pages": pa.array(n)})

    counted = own.groupBy("host", "group").cogroup(copies.groupBy("host", "group")).applyInArrow(count, "host string, run long, pages long")
    return counted.groupBy("host", "run").agg(F.sum("pages").alias("pages"))


def _boilerplate(coded: DataFrame) -> DataFrame:
    """``host, run, level``: by the share of the host's pages a run is on, near copies counted once: 1 from SHARE, 2 from
    SURE_SHARE, 3 if there are ARTICLE_PAGES too; level 0 for the hash of an unclear block that stands on two pages."""
    found = materialize(repeated_runs(_once(coded)), "runs")
    total = found.where(F.col("run").isNull()).select("host", F.col("pages").alias("total"))
    share = F.col("pages") / F.col("total")
    level = F.when(share < SURE_SHARE, 1).when(F.col("pages") < ARTICLE_PAGES, 2).otherwise(3)
    runs = found.where(F.col("run").isNotNull() & (F.col("pages") >= MIN_PAGES)).join(total, "host").where(share >= SHARE).select("host", "run", level.alias("level"))
    doubtful = coded.select("host", "sketch", F.explode("doubtful").alias("run")).groupBy("host", "run").agg(F.min("sketch").alias("a"), F.max("sketch").alias("b"))
    return runs.unionByName(doubtful.where("a < b").select("host", "run", F.lit(0).alias("level")))


def main_text(found: list[tuple[int, str]], runs: dict[int, int]) -> str:
    """The page's text from its blocks and its host's ``runs`` (level by hash).

    Blocks of an article go if they lie wholly in runs of level 3, unless all would; unclear ones too if they stand on
    another page or lie in runs of level 1. On a page without either kind the open blocks stay that don't lie wholly in
    runs of level 1, or, if none is left, of level 2.
    """
    may = [z in (MAIN, UNCLEAR) for z, _ in found]
    if not any(may):
        may = [z == OPEN for z, _ in found]
    if not runs or not any(may):
        return "\n".join(t for (_, t), m in zip(found, may, strict=True) if m)
    import numpy as np

    codes, at = token_codes([t for _, t in found])
    levels = np.array([runs.get(h, 0) for h in window_hashes(codes).tolist()])

    def inside(least: int) -> list[bool]:
        """Whether each block lies wholly in runs of that level."""
        covered = np.zeros(len(codes) + 1, np.int64)
        starts = np.flatnonzero(levels >= least) if len(levels) else []
        np.add.at(covered, starts, 1)
        np.add.at(covered, np.asarray(starts, np.int64) + RUN, -1)
        covered = np.cumsum(covered) > 0
        return [bool(covered[a:b].all()) for a, b in zip(at[:-1], at[1:], strict=True)]

    usual, sure, surest = (inside(k) for k in (1, 2, 3))
    if any(z == OPEN and m for (z, _), m in zip(found, may, strict=True)):
        kept = [m and not u for m, u in zip(may, usual, strict=True)]
        kept = kept if any(kept) else [m and not u for m, u in zip(may, sure, strict=True)]
    else:
        clear = [z == MAIN and not s for (z, _), s in zip(found, surest, strict=True)]
        clear = clear if any(clear) else [z == MAIN for z, _ in found]
        kept = [c if z == MAIN else m and not u and runs.get(_text_hash(t)) is None for (z, t), m, c, u in zip(found, may, clear, usual, strict=True)]
    return "\n".join(t for (_, t), k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """One row a page: the id, the url, ``text, n_chars``.

    ``text`` is the page's blocks of main text, joined by line breaks; character references are decoded and white
    space inside a block is one space. Null or empty html gives an empty text. Pages without a url are one host.
    Equal rows get equal texts. A tag that is cut off at the end of a page is dropped, text that is cut off stays.
    Pages are parsed twice: for the hosts' runs, of which only codes are kept and shuffled, and for the texts. Up to
    ``broadcast_runs`` runs are broadcast; more are joined by host, the hosts with a thousandth of all pages salted.
    """
    spark = pages.sparkSession
    small_batches(spark, 200)
    coded = materialize(_coded(pages, url_col, html_col), "pages")
    runs = materialize(_boilerplate(coded), "boilerplate")
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"page {kind}, url string, text string"
    own = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), _host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def out(batch, of):
        import pyarrow as pa

        texts = [main_text(blocks(p or ""), r) for p, r in zip(batch.column(3).to_pylist(), of, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page", "url", "text"])

    if runs.count() <= broadcast_runs:
        by_host: dict[str, dict[int, int]] = {}
        for r in runs.collect():  # its size is checked above
            by_host.setdefault(r.host, {})[r.run] = r.level
        small = spark.sparkContext.broadcast(by_host)
        texts = own.mapInArrow(lambda frames: (out(b, [small.value.get(h, {}) for h in b.column(2).to_pylist()]) for b in batches(frames)), schema)
    else:
        n = coded.count()
        large = [r.host for r in coded.groupBy("host").count().where(F.col("count") * HOT >= n).collect()]  # HOT hosts at most
        salted = F.col("host").isin(large) if large else F.lit(False)
        lists = runs.groupBy("host").agg(F.collect_list("run").alias("runs"), F.collect_list("level").alias("levels"))
        lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(salted, SALTS - 1).otherwise(0))))
        own = own.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("page", "url"), F.lit(SALTS))).otherwise(0).cast("int"))
        joined = own.join(lists, ["host", "salt"], "left").select("page", "url", "host", "html", "runs", "levels")
        texts = joined.mapInArrow(lambda frames: (out(b, [dict(zip(r or (), v or (), strict=True)) for r, v in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]) for b in batches(frames)), schema)
    return texts.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
