"""Main text of web pages: the host's suffix arrays over all blocks, with the page's structure as a prior.

A page is cut into blocks at block-level tags. Blocks in menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are dropped by tag, role or class; a class word does not drop a wrapper that holds an ``article`` or ``main``. All other
blocks of all pages are judged by their host: the token streams of the host's pages are concatenated, a suffix array
over them finds strings of ``RUN`` tokens or more that stand on distinct pages. Blocks mostly covered by
such strings are boilerplate, while unique runs stay. Structure sets how much must be covered: ``COVERED`` of a block
outside an article (``article``, ``main`` or their roles). A block inside one goes only if strings inside the block that also stand outside all articles
on another page of the host cover all of it, so articles that share a sentence keep it; and where ``COPIED`` of a page's articles or more is covered,
the page is taken for a copy of another and its articles stay whole. Outside articles too, a block goes or stays whole: taking single strings out of it
would tear sentences. A host with a single page loses nothing; equal strings are ties and are judged alike. Very long pages are read whole. Only the
id, URL and HTML columns are read, so extra columns may have any names.

A host's pages are dealt at random into shards of about ``SHARD_PAGES`` pages, each with a suffix array of its own, so that no task gets a host of
unbounded size. The distinct windows of ``RUN`` tokens of each shard are first counted across the host's shards by hash, in
as many buckets as the host has shards, so that a string on two pages of a host is found whatever the host's size. Two windows of a bucket are taken for equal if 32 bits
of their hashes are: a chance of about 5e-5 a window, where a block goes only if nine tenths of it or all are covered. Pages move once, packed by shard.

Character references are decoded, white space inside a block becomes one space, blocks join by one line feed in page order.
Null and empty pages give an empty text. A tag or comment that the page's end cuts off is dropped. Repeated rows are extracted alike;
rows with equal URLs count as one page, rows without URL belong to no host and keep their blocks. An empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import cut
from tessera.llm.textbytes import U64, Block, mix, string_parts
from tessera.llm.url_filter import host_of

RUN, COVERED, COPIED, SHARD_PAGES = 6, 0.9, 0.5, 512
#: The list of hosts of several shards is broadcast up to this many; beyond it, pages meet it in a shuffle.
BROADCAST_HOSTS = 200_000
_STEP = np.random.Generator(np.random.PCG64(11)).integers(1, 2**62, 64, dtype=np.uint64) * U64(2) + U64(1)

# Names of HTML elements and of the classes that sites give to page furniture.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = "script style noscript template textarea iframe svg math canvas object audio video".split()
DROP_TAGS = set("nav footer aside form button select input dialog menu head title label fieldset".split()) | set(RAW_TAGS)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond replies disqus "
    "share sharing social related recommended widget toolbar pagination pager skip".split()
)

BOX_WORDS = set(
    "area bar block body bottom box button buttons container content fixed footer form global header inner item items left link links list main outer page panel placeholder primary "
    "right row secondary section site slot sticky top unit wrap wrapper zone".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|</(?P<close>[a-zA-Z][\w:-]*)[^>]*(?:>|\Z)|<(?P<open>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_ENDS_P = BLOCK_TAGS - {"body", "html"}

INSIDE, UNDECIDED = 1, 0


def _is_furniture(name: str) -> bool:
    """Whether a class or id is made of a furniture word and words that only say what kind of box it is: ``ad-slot``, but not ``related-work``."""
    parts = [x for x in _SPLIT.split(name) if x and not x.isdigit()]
    return any(x in DROP_WORDS for x in parts) and all(x in DROP_WORDS or x in BOX_WORDS for x in parts)


def _role(tag: str, attrs: str, in_main: bool) -> int | None:
    """-1: page furniture, -2: furniture by a class word only, 1: main region, 0: neither."""
    worded = False
    if tag in MAIN_TAGS:
        kind = 1
    elif tag in DROP_TAGS or (tag == "header" and not in_main):
        return -1
    else:
        kind = 0
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, *vals in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(vals).lower()
            if name == "role":
                if value in DROP_ROLES:
                    return -1
                if value in MAIN_ROLES:
                    kind = 1
            elif name == "itemprop" and value == "articlebody":
                kind = 1
            elif name in ("class", "id") and tag not in ("html", "body") and kind != 1:
                worded |= any(_is_furniture(x) for x in value.split())
            elif name == "hidden" and not value:
                return -1
    return -2 if worded and kind != 1 else kind


def page_blocks(page: str) -> list[tuple[str, int]]:
    """The page's blocks outside page furniture, in order, with INSIDE (an article) or UNDECIDED."""
    stack: list[tuple[str, int, int]] = []
    drops = mains = wrappers = 0
    worded: list[int] = []  # open wrappers with a class word
    held: set[int] = set()  # those that hold an article
    found: list[tuple[str, int, tuple[int, ...]]] = []
    buf: list[str] = []

    def flush() -> None:
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                found.append((text, INSIDE if mains else UNDECIDED, tuple(worded)))

    def end(k: int) -> None:
        nonlocal drops, mains
        for _, role, at in stack[k:]:
            drops -= role == -1
            mains -= role == 1
            if role == -2:
                worded.remove(at)
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not drops:
            buf.append(page[at : m.start()])
        at = m.end()
        if tag := m["open"]:
            tag, attrs = tag.lower(), m["attrs"]
            if tag in BLOCK_TAGS:
                flush()
            elif tag == "br":
                buf.append(" ")
            if m[0][-1:] != ">" and m.end() == len(page):
                break
            if tag in VOID_TAGS or attrs.endswith("/"):
                continue
            if tag in _ENDS_P and any(t == "p" for t, *_ in stack[-8:]):
                # A block opens: an open paragraph, and what is open inside it, ends.
                end(max(i for i, (t, *_) in enumerate(stack) if t == "p"))
            role = _role(tag, attrs, bool(mains))
            if role == -2 and tag not in BLOCK_TAGS:
                if "-" in tag:  # an element of the site's own may be a wrapper
                    flush()
                else:
                    role = -1
            stack.append((tag, role, wrappers))
            drops += role == -1
            mains += role == 1
            if role == -2:
                worded.append(wrappers)
                wrappers += 1
            elif role == 1 and not drops:
                held.update(worded)
        elif tag := m["close"]:
            tag = tag.lower()
            if tag in BLOCK_TAGS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(role == -2 for _, role, _ in stack[k:]):
                        flush()
                    end(k)
                    break
    if at < len(page) and not drops:
        buf.append(page[at:])
    flush()
    return [(t, kind) for t, kind, inside in found if held.issuperset(inside)]


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` values at least, by prefix doubling."""
    _, rank = np.unique(x, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    k = 1
    while True:
        ahead = np.zeros(len(x), np.int64)
        ahead[: len(x) - k] = rank[k:]
        key = rank * (len(x) + 2) + ahead
        order = np.argsort(key, kind="stable")
        if k * 2 >= depth:
            return order
        sorted_ = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = np.empty(len(x), np.int64)
        rank[order] = new + 1
        k *= 2


def _stream(pages: list[list[tuple[list[str], int]]]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Token numbers of all pages, one after another, the page of each, the tokens by number, and whether each place is outside all articles."""
    ids: dict[str, int] = {}
    stream, owner, outside = [], [], []
    for p, blocks_ in enumerate(pages):
        for b, kind in blocks_:
            stream += [ids.setdefault(t, len(ids) + 1) for t in b]
            owner += [p] * len(b)
            outside += [kind != INSIDE] * len(b)
        stream.append(-1 - p)  # a separator of its own, so that no string crosses pages
        owner.append(p)
        outside.append(False)
    return np.array(stream, np.int64), np.array(owner, np.int64), list(ids), np.array(outside, bool)


def _throughout(mask: np.ndarray, run: int) -> np.ndarray:
    """Whether the mask holds at ``run`` places from each place on."""
    out = np.ones(max(0, len(mask) - run + 1), bool)
    for i in range(run):
        out &= mask[i : i + len(out)]
    return out


def _repeated_starts(x: np.ndarray, owner: np.ndarray, outside: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a string of ``run`` tokens that stands on two pages starts at each place, and one that stands outside all articles on another page."""
    starts, slipped = np.zeros(len(x), bool), np.zeros(len(x), bool)
    if len(x) > run:
        order = suffix_array(x, run)
        order = order[order + run <= len(x)]
        alike = np.ones(max(0, len(order) - 1), bool)
        for i in range(run):
            alike &= x[order[1:] + i] == x[order[:-1] + i]
        group = np.concatenate(([0], np.cumsum(~alike)))
        own = owner[order]
        least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        most = np.full(group[-1] + 1, -1)
        np.minimum.at(least, group, own)
        np.maximum.at(most, group, own)
        starts[order[(least < most)[group]]] = True
        out = _throughout(outside, run)[order]
        least[:], most[:] = np.iinfo(np.int64).max, -1
        np.minimum.at(least, group[out], own[out])
        np.maximum.at(most, group[out], own[out])
        some, other = (most >= 0)[group], (least[group] != own) | (most[group] != own)
        slipped[order[some & other]] = True
    return starts, slipped


def _window_keys(x: np.ndarray, tokens: list[str], shards: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``run`` tokens, a bucket below ``shards`` and 32 bits of its hash as one key; and whether it crosses no page's end."""
    n = len(x) - run + 1
    if n <= 0 or not tokens:
        return np.empty(0, U64), np.empty(0, bool)
    data, offs = string_parts(pa.array(tokens, pa.large_string()))
    code = np.concatenate((np.zeros(1, U64), Block(data, offs, 0).hashes(offs[:-1], offs[1:])))[np.maximum(x, 0)]
    h = np.zeros(n, U64)
    for i in range(run):
        h += code[i : i + n] * _STEP[i]
    h = mix(h)
    return ((h & U64(0xFFFFFFFF)) % U64(shards)) << U64(32) | h >> U64(32), _throughout(x > 0, run)


def windows(pages: list[list[tuple[list[str], int]]], shards: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the pages' windows, each once, and of those that stand outside all articles."""
    x, _, tokens, outside = _stream(pages)
    keys, whole = _window_keys(x, tokens, shards, run)
    return np.unique(keys[whole]), np.unique(keys[_throughout(outside, run)]) if len(keys) else keys


def repeated_tokens(
    pages: list[list[tuple[list[str], int]]], run: int = RUN, elsewhere: np.ndarray | None = None, elsewhere_outside: np.ndarray | None = None, shards: int = 1
) -> list[list[tuple[np.ndarray, bool]]]:
    """For each page and block, which tokens are covered by a string of ``run`` tokens that stands on another page too, and whether
    strings inside the block that stand outside all articles on another page cover all of it.

    ``elsewhere``: keys of windows that stand on pages of other shards; ``elsewhere_outside``: outside all articles there."""
    x, owner, tokens, outside = _stream(pages)
    starts, slipped = _repeated_starts(x, owner, outside, run)
    if elsewhere is not None and len(elsewhere):
        keys, whole = _window_keys(x, tokens, shards, run)
        starts[: len(keys)] |= whole & np.isin(keys, elsewhere)
        slipped[: len(keys)] |= whole & np.isin(keys, elsewhere_outside)
    covered, hit = np.zeros(len(x), bool), np.flatnonzero(starts)
    for i in range(run):
        covered[hit + i] = True
    out, at = [], 0
    for blocks_ in pages:
        out.append([])
        for b, _ in blocks_:
            own, inner = np.flatnonzero(slipped[at : at + max(0, len(b) - run + 1)]), np.zeros(len(b), bool)
            for i in range(run):
                inner[own + i] = True
            out[-1].append((covered[at : at + len(b)], bool(inner.all())))
            at += len(b)
        at += 1
    return out


_OUT = "page_id long, url string, text string, n_chars long"
_PACK = "host string, shard long, shards long, ids array<bigint>, urls array<string>, counts array<int>, size long, body binary"
_CODEC = pa.Codec("zstd", compression_level=9)


def _pack(pages: list[list[tuple[str, int]]]) -> tuple[int, bytes]:
    """All blocks of some pages, compressed together; no block has a line feed."""
    raw = "\n".join(f"{kind}{t}" for page in pages for t, kind in page).encode("utf-8", "surrogatepass")
    return len(raw), _CODEC.compress(raw, asbytes=True)


def _unpack(size: int, body: bytes, counts: list[int]) -> list[list[tuple[str, int]]]:
    text = _CODEC.decompress(body, size, asbytes=True).decode("utf-8", "surrogatepass") if size else ""
    flat = iter([(b[1:], int(b[0])) for b in text.split("\n")] if text else [])
    return [[next(flat) for _ in range(n)] for n in counts]


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, byte by byte of equal weight."""
    return zlib.compress(np.diff(keys.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=U64)


def _words(blocks_: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    return [(b.split(" "), kind) for b, kind in blocks_]


def pack_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each batch's pages, one row a shard."""
    for b in batches:
        by: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(b.column("host").to_pylist(), b.column("shard").to_pylist(), b.column("shards").to_pylist(), strict=True)):
            by.setdefault(k, []).append(i)
        blocks_ = [page_blocks(page or "") for page in b.column("html").to_pylist()]
        ids, urls = b.column("page_id").to_pylist(), b.column("url").to_pylist()
        rows = [(*k, [ids[i] for i in at], [urls[i] for i in at], [len(blocks_[i]) for i in at], *_pack([blocks_[i] for i in at])) for k, at in by.items()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, types, strict=True)], names="host shard shards ids urls counts size body".split())


_KEYS = "host string, shard long, bucket long, keys binary, outside binary"


def _key_rows(host: str, shard: list[int], bucket: list[int], keys: list[np.ndarray], outside: list[np.ndarray]) -> pa.Table:
    columns = {"host": pa.array([host] * len(keys), pa.string()), "shard": pa.array(shard, pa.int64()), "bucket": pa.array(bucket, pa.int64())}
    packed = {name: pa.array([_pack_keys(k) for k in some], pa.binary()) for name, some in (("keys", keys), ("outside", outside))}
    return pa.table(columns | packed)


def shard_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each pack, a row a bucket."""
    for b in batches:
        for r in b.to_pylist():
            both = windows([_words(p) for p in _unpack(r["size"], r["body"], r["counts"])], r["shards"])
            parts = [np.split(k & U64(0xFFFFFFFF), np.searchsorted(k >> U64(32), np.arange(1, r["shards"], dtype=U64))) for k in both]
            some = [k for k, x in enumerate(parts[0]) if len(x)]
            rows = _key_rows(r["host"], [r["shard"]] * len(some), some, *([p[k] for k in some] for p in parts))
            yield from rows.to_batches()


def shared_keys(table: pa.Table) -> pa.Table:
    """For each shard, those of its windows in a bucket that another shard holds too, and those that another shard holds outside all articles."""
    of, at = np.unique(table.column("shard").to_numpy(), return_inverse=True)

    def by_shard(column: str) -> list[np.ndarray]:
        parts = [_unpack_keys(k) for k in table.column(column).to_pylist()]
        return [np.unique(np.concatenate([p for p, x in zip(parts, at, strict=True) if x == k])) for k in range(len(of))]

    def on_several(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        return keys, keys[counts > 1]

    own, outside = by_shard("keys"), by_shard("outside")
    _, twice = on_several(own)
    out, out_twice = on_several(outside)
    hits = [x[np.isin(x, twice)] for x in own]
    slipped = [h[np.isin(h, out_twice) | (np.isin(h, out) & ~np.isin(h, o))] for h, o in zip(hits, outside, strict=True)]
    some = [k for k, x in enumerate(hits) if len(x)]
    host, bucket = table.column("host")[0].as_py(), table.column("bucket")[0].as_py()
    return _key_rows(host, of[some].tolist(), [bucket] * len(some), [hits[k] for k in some], [slipped[k] for k in some])


def _left(blocks_: list[tuple[str, int]], marks: list[tuple[np.ndarray, bool]]) -> str:
    """The page's text without boilerplate."""
    inside = [f for (f, _), (_, kind) in zip(marks, blocks_, strict=True) if kind == INSIDE]
    copied = bool(inside) and np.concatenate(inside).mean() >= COPIED
    return "\n".join(t for (t, kind), (f, whole) in zip(blocks_, marks, strict=True) if (copied or not whole if kind == INSIDE else f.mean() < COVERED))


def judge_shard(table: pa.Table, shared: pa.Table) -> pa.Table:
    """Texts of one shard's pages."""
    rows = [x for r in table.to_pylist() for x in zip(r["ids"], r["urls"], _unpack(r["size"], r["body"], r["counts"]), strict=True)]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    seen: dict[str, int] = {}
    for i, (_, url, _) in enumerate(rows):
        seen.setdefault(url, i)
    buckets = [U64(b) << U64(32) for b in shared.column("bucket").to_pylist()]
    elsewhere, outside = (
        np.concatenate([np.empty(0, U64), *(_unpack_keys(k) | b for b, k in zip(buckets, shared.column(c).to_pylist(), strict=True))]) for c in ("keys", "outside")
    )
    firsts = list(seen.values())
    shards = table.column("shards")[0].as_py() if table.num_rows else 1
    marks = dict(zip(firsts, repeated_tokens([_words(rows[i][2]) for i in firsts], RUN, elsewhere, outside, shards), strict=True))
    texts = [_left(blocks_, marks[i] if i in marks else repeated_like(blocks_, rows[seen[url]][2], marks[seen[url]])) for i, (_, url, blocks_) in enumerate(rows)]
    return pa.table({"page_id": pa.array([x[0] for x in rows], pa.int64()), "url": pa.array([x[1] for x in rows], pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def repeated_like(blocks_: list[tuple[str, int]], of: list[tuple[str, int]], marks: list[tuple[np.ndarray, bool]]) -> list[tuple[np.ndarray, bool]]:
    """Marks of a page that shares its URL with a marked one: equal blocks are judged alike, others stay."""
    known = dict(zip(of, marks, strict=True))
    return [known.get(b, (np.zeros(1, bool), False)) for b in blocks_]


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) for each row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    named = F.coalesce(F.col("url") != "", F.lit(False))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = ["\n".join(t for t, _ in page_blocks(page or "")) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # Hosts of several shards are fewer than the pages by the factor ``shard_pages``; their list is broadcast only while it is short.
    hosts = rows.where(named).groupBy(host_of(F.col("url")).alias("host")).agg(F.ceil(F.count("*") / F.lit(shard_pages)).cast("long").alias("shards"))
    large = cut(hosts.where(F.col("shards") > 1), "hosts")
    side = F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large
    dealt = rows.where(named).withColumn("host", host_of(F.col("url"))).join(side, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1).cast("long")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("url"), F.col("shards"))).select("host", "shard", "shards", "page_id", "url", "html")
    packs = cut(dealt.mapInArrow(pack_pages, _PACK), "pages")
    held = packs.where(F.col("shards") > 1).mapInArrow(shard_windows, _KEYS)
    shared = cut(held.groupBy("host", "bucket").applyInArrow(lambda t: shared_keys(t), _KEYS), "shared")
    judged = packs.groupBy("host", "shard").cogroup(shared.groupBy("host", "shard")).applyInArrow(lambda t, s: judge_shard(t, s), _OUT)
    out = rows.where(~named).mapInArrow(texts, _OUT).union(judged)
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
