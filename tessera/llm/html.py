"""Main text of web pages, with boilerplate found by differencing each page against its nearest pages by URL.

Markup is cut into blocks of text, the lines of the page; scripts, styles, forms and other elements without text to read give
none. Pages of one host are put in order of their URL path. Each is compared with the nearest page in that order (the one
that shares the longer beginning of the path; the earlier at a tie): the lines of both are aligned by longest common
subsequence, and the page loses the lines that it shares, since site furniture repeats from page to page while text does not.

What `article` and `main` elements hold is the page's own claim to be its text, and texts repeat lines too. So a line in there goes only if
the page on the other side in the order shares it as well (a first or last page keeps it). An article that shares half of its text or more with a
neighbour's, or a page that shares all, is a copy, and that comparison says nothing about it. Where the differences say nothing about the whole page
(no neighbour, no line shared), and article and main hold most of its text, it is the lines in these.

Furniture that differs from page to page cannot be found so. Lines go by name as well: those in menus, headers, footers and asides, and in
elements whose class, id or role has a whole name (a part between white space) made of words of NAMED (anywhere) or ALSO (outside article and main), and of words like "left" or "box"
beside them. A name with any other word in it ("menu-of-the-day") is the text's own.

The pages of all hosts are ordered by host and path (without a slash at its end), then page_id, and cut into contiguous
ranges; each range also gets the last page before it and the first one after it, so a page meets its neighbours wherever
the cuts fall. Tasks read a range in order and hold three pages at a time, however many a host or a URL has.

Null html gives an empty text. A page without a URL (null) belongs to the host "". Pages that repeat a URL are neighbours
of each other. A page alone on its host has no neighbour. Further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of a range, about; there are at most RANGES ranges for each partition of a shuffle. Where the cuts fall changes no result.
GROUP = 200
RANGES = 4
#: Pages drawn for each cut.
DRAWN = 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without lines.
DROPPED = RAW | set("form noscript template svg math canvas select button dialog object audio video head label fieldset".split())
#: Elements that are furniture by their name.
FURNITURE = set("nav header footer aside menu".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DECLARED = {"article", "main"}


#: Words in a class, id or role for menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
NAMED = set("ad ads adslot advert adverts advertisement advertisements advertising banner sponsor sponsored promo promos promotion promotions nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar complementary contentinfo cookie cookies consent gdpr notice notices newsletter comment comments disqus discussion respond hidden visually sr".split())
#: Words that name furniture only outside the text.
ALSO = set("header aside alert popup modal subscribe signup share sharing social related recommended reply replies search login pagination pager skip toolbar widget".split())
#: Words that may stand beside these in a name and say where or what part, not what for.
BESIDE = set("site page main global top bottom left right inner outer upper lower wrap wrapper container box bar area block section list item items link links panel slot unit banner content body text primary secondary sub mobile desktop sticky fixed reader user only is js no form thread row col column group header footer nav".split())


def _names_furniture(value: str, words: set[str]) -> bool:
    """Whether a name in a class, id or role is that of furniture: a word of `words`, alone or joined (by - or _) with words like it or BESIDE."""
    for token in value.lower().split():
        parts = [p for p in re.split("[-_]+", token) if p]
        if any(p in words for p in parts) and all(p in words or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


#: Order of pages: host and path, then page_id (null first) and the whole URL.
KEY = ("host", "path", "seq", "address")


#: What decides about a line besides the differences.
OPEN, INSIDE, OUT = 0, 1, 2


def _marked(attributes: str, inside: bool) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id", "role") and (_names_furniture(value, NAMED) or not inside and _names_furniture(value, NAMED | ALSO)):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Lines of a page in order, each INSIDE an article or main element, OUT (in an element that names itself as furniture) or OPEN."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, without lines, furniture, declared
    dropped = marked = declared = 0
    skip_to = ""

    def close_block() -> None:
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((text, OUT if marked else INSIDE if declared else OPEN))
            parts.clear()

    for m in TOKEN.finditer(page or ""):
        name = m[2]
        if name is None:
            token = m[0]
            if not token.startswith(("<!", "<?")) and not skip_to and not dropped:
                parts.append(token)
            continue
        name = name.lower()
        if skip_to:
            if m[1] and name == skip_to:
                skip_to = ""
            continue
        if name not in INLINE:
            close_block()
        elif name in VOID:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, d, f, a in stack[k:]:
                        dropped -= d
                        marked -= f
                        declared -= a
                    del stack[k:]
                    break
        elif name in RAW:
            if not m[3].endswith("/"):
                skip_to = name
        elif name not in VOID and not m[3].endswith("/"):
            if name == "body" and any(s[0] == "head" for s in stack):  # an unclosed head
                stack.clear()
                dropped = marked = declared = 0
            # a heading of the text may stand in a header element
            named = (name in FURNITURE and not (name == "header" and declared)) or (name not in ("html", "body") and _marked(m[3], declared > 0))
            drop = name in DROPPED or (named and name in INLINE)  # a line is not cut in two by what it leaves out
            named = named and not drop
            stack.append((name, drop, named, name in DECLARED))
            dropped += drop
            marked += named
            declared += name in DECLARED
    close_block()
    return out


#: Cells of an alignment whose bits are kept at once (16 MB); a larger one is halved first.
CELLS = 1 << 27


def _rows(a: list[int], masks: dict[int, int], width: int) -> Iterator[int]:
    """For each beginning of a: bits over the other list, 0 where a longest common subsequence grows by one."""
    full = (1 << width) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _masks(b: list[int]) -> dict[int, int]:
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    return {x: int.from_bytes(np.packbits(np.bincount(at, minlength=len(b)).astype(bool), bitorder="little").tobytes(), "little") for x, at in places.items()}


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a and each beginning of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, _masks(b), len(b)):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int], at: int) -> list[int]:
    """Positions (from `at` on) in a of a longest common subsequence of both lists, exact at any size in bounded memory."""
    start = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    taken = list(range(at, at + start))
    a, b, at = a[start:], b[start:], at + start
    end = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    taken += range(at + len(a) - end, at + len(a))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return taken
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        cut = int((_growth(a[:half], b) + _growth(a[half:][::-1], b[::-1])[::-1]).argmax())
        return taken + _aligned(a[:half], b[:cut], at) + _aligned(a[half:], b[cut:], at + half)
    rows = [(1 << len(b)) - 1, *_rows(a, _masks(b), len(b))]
    grown = lambda v, j: j - (v & ((1 << j) - 1)).bit_count()
    j = len(b)
    for i in range(len(a), 0, -1):
        if grown(rows[i], j) > grown(rows[i - 1], j):
            j = (~rows[i] & ((1 << j) - 1)).bit_length() - 1  # the last place where it grows
            taken.append(at + i - 1)
    return taken


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a that a longest common subsequence of both lists takes."""
    ids = {x: k for k, x in enumerate(dict.fromkeys(chain(a, b)))}
    return set(_aligned([ids[x] for x in a], [ids[x] for x in b], 0))


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _neighbour(paths: list[str], i: int) -> int | None:
    """Nearest page in the order of the paths."""
    near = [k for k in (i - 1, i + 1) if 0 <= k < len(paths)]
    return max(near, key=lambda k: (_common_prefix(paths[i], paths[k]), -k)) if near else None


def decided(lines: list[str], kinds: list[int], nearest: list[str] | None, other: list[str] | None) -> list[str]:
    """What becomes of each line, given the lines of the nearest page and of the one on the other side: kept, shared (it goes by the differences) or named (by names)."""

    text = sum(len(x) for x, kind in zip(lines, kinds, strict=True) if kind != OUT)
    inside = sum(len(x) for x, kind in zip(lines, kinds, strict=True) if kind == INSIDE)

    def shared(b: list[str] | None) -> set[int]:
        found = set() if b is None else shared_lines(lines, b)
        if 2 * sum(len(lines[k]) for k in found if kinds[k] == INSIDE) >= inside:  # a copy, as far as the article goes
            found = {k for k in found if kinds[k] != INSIDE}
        if sum(len(lines[k]) for k in found if kinds[k] != OUT) == text:  # a copy
            found = {k for k in found if kinds[k] == OUT}
        return found

    near = shared(nearest)
    both = near & shared(other)
    if all(kinds[k] == OUT for k in near) and 2 * inside > text:  # the differences say nothing about the text
        return ["kept" if kind == INSIDE else "shared" if k in near else "named" for k, kind in enumerate(kinds)]
    return ["shared" if k in (both if kind == INSIDE else near) else "named" if kind == OUT else "kept" for k, kind in enumerate(kinds)]


def main_text(lines: list[str], kinds: list[int], nearest: list[str] | None, other: list[str] | None) -> str:
    return "\n".join(x for x, f in zip(lines, decided(lines, kinds, nearest, other), strict=True) if f == "kept")


def _compared(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows with their text, from rows in order; guests only serve as neighbours."""
    before = now = None
    for after in chain(rows, [None]):
        if now is not None and not now["guest"]:
            near = [r for r in (before, now, after) if r is not None and (r["part"], r["host"]) == (now["part"], now["host"])]
            at = next(i for i, r in enumerate(near) if r is now)
            k = _neighbour([r["path"] for r in near], at)
            rest = [r["lines"] for i, r in enumerate(near) if i not in (at, k)]
            yield now | {"text": main_text(now["lines"], now["kinds"], None if k is None else near[k]["lines"], rest[0] if rest else None)}
        before, now = now, after


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _compared(r for b in batches for k in range(0, b.num_rows, GROUP) for r in b.slice(k, GROUP).to_pylist())
    while some := list(islice(rows, GROUP)):
        texts = [r["text"] for r in some]
        yield pa.RecordBatch.from_pydict({"page_id": pa.array([r["page_id"] for r in some], pa.int64()), "url": pa.array([r["url"] for r in some], pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(n).to_pylist() for n in KEY), strict=True))


def _ranges(keyed: DataFrame, group: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """First keys of the ranges but the first, and for each key at a border of a range the ranges where it is a guest."""
    keys = keyed.select(*KEY)
    n = keys.count()
    parts = min(-(-n // group), RANGES * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts < 2:
        return [], {}
    share = int(1_000_000 * min(1, DRAWN * parts / n))
    drawn = sorted({tuple(r) for r in keys.where(F.pmod(F.xxhash64(F.lit("cut"), *KEY), F.lit(1_000_000)) < share).collect()})
    cuts = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        for b in batches:
            for key in _keys(b):
                part = bisect_right(cuts, key)
                low, high = found.get(part, (key, key))
                found[part] = [min(low, key), max(high, key)]
        for part, both in found.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * 2, pa.int32())} | {name: pa.array([key[i] for key in both], kind) for i, (name, kind) in enumerate(zip(KEY, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True))})

    at = F.struct(*KEY)
    seen = keys.mapInArrow(ends, "part int, host string, path string, seq bigint, address string").groupBy("part").agg(F.min(at).alias("low"), F.max(at).alias("high")).collect()
    seen.sort(key=lambda r: r["part"])
    guests: dict[tuple, list[int]] = {}
    for a, b in zip(seen, seen[1:], strict=False):
        guests.setdefault(tuple(a["high"]), []).append(b["part"])
        guests.setdefault(tuple(b["low"]), []).append(a["part"])
    return cuts, guests


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"/*(?:[?#].*)?$", "")
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("seq"), url.alias("address"))
    cuts, guests = _ranges(keyed, group)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [blocks(x) for x in b.column("html").to_pylist()]
            cols = {n: b.column(n) for n in ("page_id", "url", *KEY)}
            cols |= {"lines": pa.array([[t for t, _ in g] for g in got], pa.list_(pa.string())), "kinds": pa.array([[k for _, k in g] for g in got], pa.list_(pa.int8()))}
            keys = _keys(b)
            places = [(k, bisect_right(cuts, key), False) for k, key in enumerate(keys)] + [(k, part, True) for k, key in enumerate(keys) for part in guests.get(key, ())]
            rows, part, guest = zip(*places, strict=True) if places else ((), (), ())
            out = pa.RecordBatch.from_pydict(cols).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(part, pa.int32()), pa.array(guest, pa.bool_())], [*out.schema.names, "part", "guest"])

    lines = keyed.mapInArrow(read, "page_id bigint, url string, host string, path string, seq bigint, address string, lines array<string>, kinds array<tinyint>, part int, guest boolean")
    placed = lines.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", *KEY, F.xxhash64("lines"))
    return placed.mapInArrow(_compare, "page_id bigint, url string, text string, n_chars bigint")
