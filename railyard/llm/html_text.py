"""Main text of web pages: markup roles, and a suffix array of each host's page streams.

A page's blocks fall into an article, a main element, tagged boilerplate (by
element, role, class or id) and the rest.  The token streams of everything
outside articles are joined per host, equal streams once; its suffixes are
sorted, and a run of ``run`` tokens that a large share of the host's distinct
streams has is boilerplate of the host.  A suffix is sorted by its first ``run``
tokens: a longer common string is the union of the heads at each of its places.
A page's article, else its main element, is a stream of the same array whose
symbols are whole blocks: prose is never cut inside a paragraph, but a paragraph
that nearly all of the host's distinct pages have in their articles is a notice.
A page's text is the unique blocks of its article, else the unique runs that are
left of the rest.  A page that would lose nearly all of its words keeps them:
copies and quotations are not boilerplate.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from railyard.llm.common import checkpointed, sized, spread

# fixed values of HTML ------------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
            "table tbody td tfoot th thead tr ul".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
DROPPED = set("aside audio button canvas dialog footer form head iframe map menu nav object search select video".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = set("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
            "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
            "popup promo related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
            "toolbar topbar widget widgets".split())
# other parts that a name of boilerplate may have; any other part makes it a modifier, as in has-sidebar or ad-free
PARTS = set("area block body bottom box container content global group inner item items link links list main outer page post posts primary secondary "
            "section site top wrap wrapper".split())
# names whose articles are none of the page
OTHERS = set("ad ads adv advert advertisement advertising comment comments commentlist disqus promo related replies reply respond sponsor sponsored".split())
# parts that say what an element is like or lacks, not what it is
MODIFIERS = set("free has hide hidden is no not off on show sticky toggle with without".split())
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# ---------------------------------------------------------------------------
ARTICLE, MAIN, REST, BOILERPLATE = 3, 2, 1, 0
# inside a form or a wrapper that only its name marks; and an article or main element there
FORM, NAMED, INNER_MAIN, INNER_ARTICLE = -1, -2, -3, -4
RUN = 6
# distinct streams of a host that share a run of boilerplate: at least so many, and at least this share of them
LEAST_STREAMS, SHARE = 3, 0.5
# the same for a block of ``run`` or more words inside articles; a line that many articles quote is still text
LEAST_ARTICLES, ARTICLE_SHARE = 10, 0.8
# a page whose repeated runs would take more than this part of its words is a copy of others
COPY = 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")
_ADVERT = re.compile(r"ads?(by|box|sense|slot|unit|wrap)[a-z]*")


def _closed(tag: str, attributes: str, inside: int) -> int | None:
    """The zone of an element that is boilerplate: FORM and NAMED may hold an article, BOILERPLATE may not."""
    if tag != "form" and tag in DROPPED or tag == "header" and not inside:
        return BOILERPLATE
    form = (BOILERPLATE if inside else FORM) if tag == "form" else None
    if not attributes or tag in ("html", "body"):
        return form
    a = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return BOILERPLATE
    if a.get("role") in ROLES and not (form == FORM and a["role"] == "form"):
        return BOILERPLATE
    tokens = [{"ad" if _ADVERT.fullmatch(p) else p for p in _NAME.findall(t)} for t in f"{a.get('class', '')} {a.get('id', '')}".split()]
    # inside an article one part names a component; a wrapper around it needs a name without other parts
    names = set().union(*(t & NAMES for t in tokens if (not t & MODIFIERS if inside else t <= NAMES | PARTS)))
    if inside or tag in ("article", "main"):
        names -= {"header"}
    if tag in ("article", "main") and not inside:
        names &= OTHERS
    if names:
        return BOILERPLATE if inside or names & OTHERS else NAMED
    return form


def blocks(page: str) -> list[tuple[int, str]]:
    """``zone, text`` of the page's blocks in order; white space is folded, character references are decoded."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []               # open elements and the zone inside them
    zone, buffer, at = REST, [], 0

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append((zone, text))

    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            buffer.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if m[1]:                                    # an end tag closes down to its element
            tag = m[1].lower()
            if tag in BLOCK or tag in DROPPED:
                flush()
            elif tag == "br":
                buffer.append(" ")
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                new = stack[-1][1] if stack else REST
                if new != zone:
                    flush()
                    zone = new
        elif m[2]:
            tag, attributes = m[2].lower(), m[3]
            if tag in RAW:
                if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title"):
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in BLOCK or tag in DROPPED:
                flush()
            if tag in VOID:
                continue
            if tag in IMPLIED and stack and stack[-1][0] in IMPLIED[tag]:
                stack.pop()
            new = stack[-1][1] if stack else REST
            if new != BOILERPLATE:
                inside = {ARTICLE: ARTICLE, INNER_ARTICLE: ARTICLE, MAIN: MAIN, INNER_MAIN: MAIN}.get(new, 0)
                main = tag == "main" or bool(attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I))
                closed = _closed(tag, attributes, inside)
                if closed is not None:
                    new = closed if new != NAMED or closed == BOILERPLATE else NAMED
                elif tag == "article":
                    new = ARTICLE if new > 0 else INNER_ARTICLE
                elif main and new in (REST, FORM, NAMED):
                    new = MAIN if new == REST else INNER_MAIN
            if new != zone:
                flush()
                zone = new
            stack.append((tag, new))
    flush()
    return out


def read_page(page: str) -> tuple[str | None, list[tuple[int, str]]]:
    """Text of the article or the main element, if there is one with text; and all blocks outside it."""
    found = blocks(page)
    zones = {z for z, _ in found}
    for zone in (ARTICLE, MAIN, INNER_ARTICLE, INNER_MAIN):
        if zone in zones:
            return "\n".join(t for z, t in found if z == zone), [(max(z, BOILERPLATE), t) for z, t in found if z != zone]
    # a page that is one form
    found = [(REST if z == FORM and REST not in zones else max(z, BOILERPLATE), t) for z, t in found]
    return None, found


_OPEN = pa.list_(pa.struct([("zone", pa.int32()), ("text", pa.string())]))


def _parsed(outside: bool, id_type):
    """Rows with their main text, null if they have none; for ``outside`` also with the blocks outside it."""
    schema = pa.schema([("page_id", id_type), ("url", pa.string()), ("main", pa.string()), ("rest", _OPEN)])

    def run(batches):
        for b in batches:
            main, rest = [], []
            for t in b.column(2).to_pylist():
                text, blocks_ = read_page(t or "")
                main.append(text)
                rest.append([{"zone": z, "text": x} for z, x in blocks_] if outside else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(main, pa.string()), pa.array(rest, _OPEN)], schema=schema)
    return run


_SHARED = pa.schema([("stream", pa.int64()), ("pos", pa.int32()), ("host", pa.string()), ("head", pa.string()), ("n", pa.int64())])


def _shared_suffixes(batches):
    """Suffixes that share their head with suffixes of other streams, and the number ``n`` of those streams.

    Rows come sorted by host, head and stream, so the suffixes of one head (an
    interval of the suffix array) are neighbours.  An interval that may go on in
    the next batch or range keeps its head and has no number yet.
    """
    for b in batches:
        if not b.num_rows:
            continue
        host, head, stream, pos = b.column(0), b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy()
        new = np.arange(len(stream)) == 0
        for c in (host, head):
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        first = new.copy()
        first[1:] |= stream[1:] != stream[:-1]
        n = np.add.reduceat(first.astype(np.int64), starts)
        border = np.zeros(len(starts), bool)
        border[[0, -1]] = True
        out = np.flatnonzero((border | (n >= LEAST_STREAMS))[of])
        at = border[of[out]]
        yield pa.RecordBatch.from_arrays([
            pa.array(stream[out]), pa.array(pos[out]), host.take(out), pc.if_else(pa.array(at), head.take(out), pa.scalar(None, pa.string())),
            pa.array(n[of[out]], mask=at)], schema=_SHARED)


def unique_runs(rest: list[dict], starts: list[int] | None, run: int) -> str:
    """The blocks' words outside the runs that begin at ``starts``; all of them if that leaves too little."""
    covered = {p for start in starts or [] for p in range(start, start + run)}
    blocks_, at = [], 0
    for block in rest:
        words = block["text"].split(" ")
        if block["zone"] != BOILERPLATE:
            blocks_.append([(w, i in covered) for i, w in enumerate(words, at)])
        at += len(words)
    gone = sum(hit for b in blocks_ for _, hit in b)
    if gone > COPY * sum(map(len, blocks_)):
        return "\n".join(" ".join(w for w, _ in b) for b in blocks_)
    return "\n".join(k for k in (" ".join(w for w, hit in b if not hit) for b in blocks_) if k)


def _unique_runs(run, id_type):
    schema = pa.schema([("page_id", id_type), ("url", pa.string()), ("text", pa.string())])

    def read(batches):
        for b in batches:
            texts = [unique_runs(rest, starts, run) for rest, starts in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], schema=schema)
    return read


def _least(streams: DataFrame, least: int, share: float) -> DataFrame:
    """Number of a host's distinct streams that must share a run of boilerplate."""
    return streams.distinct().groupBy("host").agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.lit(float(share)))).alias("least"))


def _unique_blocks():
    """The main text without the blocks that begin at ``starts``; all of it if that leaves too little."""
    blocks_ = F.split("main", "\n")
    gone = F.array_join(F.filter(blocks_, lambda b, i: F.array_contains("starts", i)), " ")
    left = F.array_join(F.filter(blocks_, lambda b, i: ~F.array_contains("starts", i)), "\n")
    copy = F.size(F.split(gone, " ")) > F.lit(COPY) * F.size(F.split("main", "[ \n]"))
    return F.when(F.col("starts").isNull() | copy, F.col("main")).otherwise(left)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN,
                      share: float = SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null html is empty and gives an empty text.  Pages without a host share one
    stream.  Pages with equal streams, such as copies and repeated rows, count
    once and are no evidence of boilerplate against each other.  A run is
    boilerplate if at least ``LEAST_STREAMS`` and ``share`` of the host's
    distinct streams have it outside articles.  A block of ``run`` or more words
    inside an article is boilerplate if at least ``LEAST_ARTICLES`` and
    ``article_share`` of the host's distinct pages (by their articles, else by
    what they have) have it inside theirs.  Very long pages are parsed one at a
    time; an empty table gives an empty frame; other columns are ignored.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    id_type = to_arrow_type(p.schema["page_id"].dataType)
    kind = p.schema["page_id"].dataType.simpleString()
    shape = f"page_id {kind}, url string, main string, rest array<struct<zone:int,text:string>>"
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1)), F.lit(""))
    tokens = F.flatten(F.transform("rest", lambda b: F.split(b["text"], " ")))
    site = F.concat("host", F.lit("/"))             # no host has a slash: the articles' streams lie beside the others
    article = F.when(F.col("main").isNotNull(), F.xxhash64(site, "main"))
    symbols = F.transform(F.split("main", "\n"), lambda b: F.when(F.size(F.split(b, " ")) >= run, F.xxhash64(b)))
    outside = p.mapInArrow(_parsed(True, id_type), shape).withColumn("host", host).withColumn("tokens", tokens)
    outside = outside.withColumn("stream", F.xxhash64("host", "tokens")).withColumn("article", article).withColumn("symbols", symbols).drop("main")
    outside = checkpointed(outside)
    # the streams: a suffix at every token, sorted to the depth of ``run`` tokens
    streams = outside.groupBy("host", "stream").agg(F.first("tokens").alias("tokens"))
    suffixes = (streams.select("host", "stream", F.posexplode(F.transform("tokens", lambda t, i: F.slice("tokens", i + 1, run))).alias("pos", "head"))
                       .filter(F.size("head") == run).select("host", F.array_join("head", " ").alias("head"), "stream", "pos"))
    # and one at every block of an article, which is a run by itself
    articles = outside.filter("article IS NOT NULL").groupBy(site.alias("host"), F.col("article").alias("stream")).agg(F.first("symbols").alias("symbols"))
    blocks_ = articles.select("host", "stream", F.posexplode("symbols").alias("pos", "symbol")).filter("symbol IS NOT NULL")
    suffixes = suffixes.unionByName(blocks_.withColumn("head", F.col("symbol").cast("string")).drop("symbol"))
    order = ("host", "head", "stream", "pos")
    found = checkpointed(suffixes.repartitionByRange(spread(pages.sparkSession), *order).sortWithinPartitions(*order)
                                 .mapInArrow(_shared_suffixes, "stream bigint, pos int, host string, head string, n bigint"))
    across = found.filter("head IS NOT NULL")
    counted = across.select("host", "head", "stream").distinct().groupBy("host", "head").agg(F.count("*").alias("n"))
    runs = found.filter("head IS NULL").select("host", "stream", "pos", "n").unionByName(
        across.drop("n").join(sized(counted, "op4-borders"), ["host", "head"]).select("host", "stream", "pos", "n"))
    least = _least(outside.select("host", "stream"), LEAST_STREAMS, share).unionByName(
        _least(outside.select(site.alias("host"), F.coalesce("article", "stream")), LEAST_ARTICLES, article_share))
    starts = sized(runs.join(sized(least, "op4-least"), "host").filter("n >= least").groupBy("stream").agg(F.collect_set("pos").alias("starts")), "op4-starts")
    done = p.mapInArrow(_parsed(False, id_type), shape).filter("main IS NOT NULL").withColumn("host", host).withColumn("stream", article)
    done = done.join(starts, "stream", "left").select("page_id", "url", _unique_blocks().alias("text"))
    left = outside.filter("article IS NULL").join(starts, "stream", "left").select("page_id", "url", "rest", "starts")
    left = left.mapInArrow(_unique_runs(run, id_type), f"page_id {kind}, url string, text string")
    return done.unionByName(left).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
