"""Main text of web pages by differencing against the page with the nearest URL.

The pages of a host stand in order of their URL paths. Each is compared with the nearest page before it and after it that
is no copy of it (a copy has the same lines), the one whose path shares the longer beginning first. Both pages are lists of
text lines, aligned by a longest common subsequence; a line that both share is part of the host's template and is deleted.
Two rules of structure stand beside this: what a page marks as its article or main part is never deleted as template, for
articles may quote each other; and what it marks as chrome (menus, footers, adverts, forms, scripts, comments and so on)
goes even where no neighbour shares it.

Each page is taken apart once. Only hashes of lines are dealt by ranges of URLs; a page's lines wait for the numbers of those that go.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import give_back_memory
from trendloom.session import Workspace

# Elements of HTML by how they are treated.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CHROME = frozenset("""nav footer aside form script style noscript template iframe svg button select textarea dialog object canvas
head menu search noembed noframes xmp audio video map""".split())
MAIN = frozenset("article main".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Elements whose class and id count, and the words in them that mark chrome: some everywhere, some only outside of the marked
#: article or where most of the text is links, for an article may be about a share price or related work.
CONTAINERS = frozenset("div section ul ol dl table center details figure".split())
_named = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)
CHROME_NAMES = _named(
    "ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|cookies?|consent|gdpr|popup|modal|overlay|sidebar|side-bar|navbar|breadcrumbs?|"
    "comments?|commentlist|disqus|newsletter|subscribe|masthead|pagination|skip-link")
OFTEN_CHROME_NAMES = _named(
    "promo|banner|notice|notification|menu|nav|navigation|respond|repl(?:y|ies)|share|sharing|social|footer|related|recommended|widget|toolbar|login|signup")

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?![^\s/>])", re.I) for name in RAW}

CHROME_ZONE, OUTSIDE, MAIN_ZONE = 0, 1, 2


def is_chrome(name: str, attributes: str, in_main: bool) -> bool | None:
    """Whether an element's own marks make it chrome; None if they do where most of its text is links."""
    if name in CHROME or name == "header" and not in_main:
        return True
    if not attributes or name in ("body", "html") or name in MAIN:
        return False
    often = False
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if kind.lower() == "role":
            if value.lower() in CHROME_ROLES:
                return True
        elif name in CONTAINERS:
            if CHROME_NAMES.search(value):
                return True
            often = often or bool(OFTEN_CHROME_NAMES.search(value))
    if _HIDDEN.search(attributes):
        return True
    return (None if in_main else True) if often else False


class Tokens:
    """Texts and tags of a page in one pass: (text, None, "", False), then (None, name, attributes, closing).

    A > inside quotes doesn't end a tag, but where a quote is never closed it does. Stops outside of quotes from which the
    search for an end failed once are remembered, so a page full of unclosed quotes takes no longer than another.
    """

    def __init__(self, html: str):
        self.html, self.failed = html, set()

    def end_of_tag(self, at: int) -> int:
        """Where the > of a tag stands; -1 if there is none."""
        tried, look = [], at
        while stop := _STOP.search(self.html, look):
            if stop[0] == ">":
                return stop.start()
            if stop.start() in self.failed:
                break
            tried.append(stop.start())
            look = self.html.find(stop[0], stop.end()) + 1
            if not look:
                break
        self.failed.update(tried)
        return self.html.find(">", at)

    def __iter__(self) -> Iterator[tuple[str | None, str | None, str, bool]]:
        html, at, size = self.html, 0, len(self.html)
        while at < size:
            m = _TAG.search(html, at)
            if m is None:
                yield html[at:], None, "", False
                return
            start, inner = m.start(), m.end()
            if m[1] or m[2]:
                end = html.find("-->" if m[1] else ">", inner)
                after = size if end < 0 else end + (3 if m[1] else 1)
            else:
                end = self.end_of_tag(inner)
                if end < 0:  # no tag ends from here on
                    yield html[at:], None, "", False
                    return
                after = end + 1
            if start > at:
                yield html[at:start], None, "", False
            at = after
            if m[4]:
                name = m[4].lower()
                yield None, name, html[inner:end], bool(m[3])
                if name in RAW and not m[3]:
                    close = _RAW_END[name].search(html, at)
                    end = html.find(">", close.end()) if close else -1
                    at = size if end < 0 else end + 1


def page_lines(html: str) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order. A line break counts as white space; an article or main element
    opens even inside chrome that was left open, except scripts and the like."""
    lines: list[tuple[int, str]] = []
    linked: list[int] = []  # of each line, its characters inside links
    words: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements that set a zone: the zone around, and the first line if links decide, else -1
    names: Counter = Counter()  # of the stack
    zone, in_link, in_links = OUTSIDE, False, 0

    def flush():
        nonlocal in_links
        text = " ".join(html_lib.unescape("".join(words)).split())
        if text:
            lines.append((zone, text))
            linked.append(in_links)
        words.clear()
        in_links = 0

    def close(opened: int):
        """Ends the open elements from a place of the stack on."""
        for _, _, first in stack[opened:]:
            if first >= 0 and 2 * sum(linked[first:]) >= sum(len(t) for _, t in lines[first:]):
                lines[first:] = [(CHROME_ZONE, t) for _, t in lines[first:]]
        names.subtract(x[0] for x in stack[opened:])
        del stack[opened:]

    for text, name, attributes, closing in Tokens(html):
        if name is None:
            words.append(text)
            if in_link:
                in_links += len(text)
            continue
        if name == "a":
            in_link = not closing
        if name in RAW and not closing:
            if name in BLOCK:
                flush()
            continue
        if name == "br" or name in ("td", "th"):
            words.append(" ")
        if closing:
            if name in BLOCK or names[name]:
                flush()
            if names[name]:
                opened = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                zone = stack[opened][1]
                close(opened)
            continue
        if name in BLOCK:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        inner, first = zone, -1
        if name in MAIN and not any(names[x] for x in ("noscript", "template", "svg")):
            inner = MAIN_ZONE if zone != CHROME_ZONE or any(names[x] for x in ("nav", "head", "header", "div", "menu", "form")) else zone
        elif zone != CHROME_ZONE and (told := is_chrome(name, attributes, zone == MAIN_ZONE)) is not False:
            inner, first = (zone, 0) if told is None else (CHROME_ZONE, -1)
        if inner != zone or first == 0 or names[name]:
            flush()
            stack.append((name, zone, len(lines) if first == 0 else -1))
            names[name] += 1
            zone = inner
    flush()
    close(0)
    return lines


def _lcs_row(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of a with each beginning of b, by a row of bits."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:  # a clear bit j says: the subsequence grows at j
        hit = row & where.get(line, 0)
        row = (row + hit | row - hit) & full
    grown = np.unpackbits(np.frombuffer((~row & full).to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(grown)])


def _lcs_table(a: list, b: list) -> list[bool]:
    """Which elements of a are in a longest common subsequence with b; keeps a row of bits for each element of a."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for line in a:
        hit = row & where.get(line, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    shared, j = [False] * len(a), len(b)
    for i in range(len(a), 0, -1):
        mine, before = ~rows[i] & (1 << j) - 1, ~rows[i - 1] & (1 << j) - 1
        if mine.bit_count() > before.bit_count():
            shared[i - 1] = True
            want = mine.bit_count() - 1
            j = mine.bit_length() - 1
            while (~rows[i - 1] & (1 << j) - 1).bit_count() > want:
                j -= 1
    return shared


def common_lines(a: list, b: list, table_bits: int = 1 << 24) -> list[bool]:
    """Which lines of a are in a longest common subsequence with b. Lines that only one side has are left out first; a table of
    more than table_bits is halved until it fits (Hirschberg's way), so memory grows with the lines and not their square."""
    mine, theirs = set(a), set(b)
    at, other = [i for i, x in enumerate(a) if x in theirs], [x for x in b if x in mine]

    def solve(own: list[int], other: list) -> Iterator[int]:
        while own and other and a[own[0]] == other[0]:
            yield own[0]
            own, other = own[1:], other[1:]
        tail = 0
        while tail < min(len(own), len(other)) and a[own[-1 - tail]] == other[-1 - tail]:
            tail += 1
            yield own[-tail]
        own, other = own[: len(own) - tail], other[: len(other) - tail]
        if not own or not other:
            return
        if len(own) * len(other) <= table_bits or len(own) == 1:
            yield from (i for i, s in zip(own, _lcs_table([a[i] for i in own], other)) if s)
            return
        half = len(own) // 2
        ahead = _lcs_row([a[i] for i in own[:half]], other)
        back = _lcs_row([a[i] for i in reversed(own[half:])], other[::-1])[::-1]
        cut = int(np.argmax(ahead + back))
        yield from solve(own[:half], other[:cut])
        yield from solve(own[half:], other[cut:])

    shared = [False] * len(a)
    for i in solve(at, other):
        shared[i] = True
    return shared


def template_lines(zones: list[int], lines: list, other: list) -> list[int]:
    """The lines outside of the marked article that a page shares with its neighbour; lines may be texts or hashes."""
    return [i for i, s in enumerate(common_lines(lines, other)) if s and zones[i] != MAIN_ZONE]


def main_text(lines: list[tuple[int, str]], deleted: set[int]) -> str:
    """The lines that are neither chrome nor deleted as template."""
    return "\n".join(t for i, (z, t) in enumerate(lines) if z != CHROME_ZONE and i not in deleted)


def common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


#: A page as its neighbours see it: `at` is its row's key, `same` a hash of its lines; and with the lines that are not chrome.
DIGEST = ["at", "host", "path", "page_id", "same", "zones", "hashes"]
TAKEN_APART = "at long, host string, path string, page_id long, url string, same long, zones binary, hashes array<long>, text string"


def taken_apart(rows: DataFrame) -> DataFrame:
    """TAKEN_APART of each row (at, host, path, page_id, url, html); hashes only of pages with a host, as others have no neighbour."""
    schema = pa.schema([("at", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("same", pa.int64()),
                        ("zones", pa.binary()), ("hashes", pa.list_(pa.int64())), ("text", pa.string())])
    signed = lambda data: xxhash.xxh3_64_intdigest(data) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, same, zones, hashes, texts = batch.slice(k, 256), [], [], [], []
                for host, html in zip(part.column(1).to_pylist(), part.column(5).to_pylist()):
                    lines = page_lines(html or "")
                    zones.append(bytes(z for z, _ in lines))
                    hashes.append([signed(t) for _, t in lines] if host else [])
                    content = [h for (z, _), h in zip(lines, hashes[-1]) if z != CHROME_ZONE]
                    same.append(signed(np.array(content, "<i8").tobytes()))
                    texts.append(main_text(lines, set()))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(same, pa.int64()), pa.array(zones, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(texts, pa.string())], schema=schema)
        give_back_memory()

    return rows.select("at", "host", "path", "page_id", "url", "html").mapInArrow(run, TAKEN_APART)


def with_edges(dealt: DataFrame) -> DataFrame:
    """DIGEST rows with `part` and `lent`: each part with its own rows, and lent to it the nearest page before its first row and
    after its last one that is of the same host and no copy of that row.

    From each part come its first and last row, and those nearest to them that differ; which of them is lent to which part is
    settled on a row or two a part.
    """
    place, spark = ["host", "path", "page_id", "at"], dealt.sparkSession
    key = F.struct(*place)
    row = F.struct(key.alias("key"), *[c for c in dealt.columns if c not in place])
    ends = dealt.groupBy("part").agg(F.min(F.struct(key.alias("key"), "same")).alias("first"), F.max(F.struct(key.alias("key"), "same")).alias("last"))
    joined = dealt.join(ends, "part")
    unlike = lambda end: (F.col("host") == F.col(f"{end}.key.host")) & (F.col("same") != F.col(f"{end}.same"))
    found = joined.groupBy("part").agg(
        F.first("first").alias("first"), F.first("last").alias("last"), F.min(row).alias("first_row"), F.max(row).alias("last_row"),
        F.min(F.when(unlike("first"), row)).alias("next_row"), F.max(F.when(unlike("last"), row)).alias("before_row"))
    parts = {r.part: r for r in found.select("part", "first", "last", *[F.struct(f"{c}.key", f"{c}.same").alias(c) for c in ("first_row", "last_row", "next_row", "before_row")]).collect()}
    order, lent = sorted(parts), []
    for step, own, sides in ((-1, "first", ("last_row", "before_row")), (1, "last", ("first_row", "next_row"))):
        for i, p in enumerate(order):
            me, j = parts[p][own], i + step
            while 0 <= j < len(order) and me.key.host is not None:
                there = parts[order[j]]
                side = next((s for s in sides if there[s].key is not None and there[s].key.host == me.key.host and there[s].same != me.same), None)
                if side:
                    lent.append((order[j], side, p))
                if side or there[sides[0]].key.host != me.key.host or there.first.key.host != there.last.key.host:
                    break
                j += step
    wanted = spark.createDataFrame(lent, "part int, side string, target int")
    rows = found.select("part", F.explode(F.create_map(*[x for c in ("first_row", "last_row", "next_row", "before_row") for x in (F.lit(c), F.col(c))])).alias("side", "row"))
    rows = rows.join(wanted, ["part", "side"]).select("row.key.*", "row.same", "row.zones", "row.hashes", F.col("target").alias("part"), F.lit(True).alias("lent"))
    return dealt.withColumn("lent", F.lit(False)).unionByName(rows)


def shared_with_neighbour(rows: DataFrame) -> DataFrame:
    """(at, deleted): the numbers of the lines that a page shares with its neighbour outside of its marked article; only pages
    with such lines. rows: with_edges()."""
    schema = pa.schema([("at", pa.int64()), ("deleted", pa.list_(pa.int32()))])
    names = ["part", "lent", "at", "host", "path", "same", "zones", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple]:
            """Copies that stand one after another, as one: (part, host, lines, zones, [(at, path)])."""
            held = None
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    for part, lent, at, host, path, same, zones, hashes in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                        if held is None or held[:3] != (part, host, same):
                            if held:
                                yield held
                            held = (part, host, same, [])
                        held[3].append((None if lent else at, path or "", zones, hashes))
            if held:
                yield held

        def settled() -> Iterator[tuple]:
            before = here = None
            for after in runs():
                if here:
                    yield from settle(before, here, after)
                before, here = here, after
            if here:
                yield from settle(before, here, None)

        def settle(before, here, after):
            near = [(x, at) for x, at in ((before, -1), (after, 0)) if x and x[:2] == here[:2] and here[1]]
            known: dict = {}
            for at, path, zones, hashes in here[3]:
                if at is None or not near:
                    continue
                which = max(range(len(near)), key=lambda i: (common_start(near[i][0][3][near[i][1]][1], path), -i))
                found = known.get((which, zones, tuple(hashes)))
                if found is None:
                    found = known[which, zones, tuple(hashes)] = template_lines(list(zones), hashes, near[which][0][3][near[which][1]][3])
                if found:
                    yield at, found

        held = []
        for row in settled():
            held.append(row)
            if len(held) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    dealt = rows.repartitionByRange("part").sortWithinPartitions("part", "host", "path", "page_id", "at")
    return dealt.select(*names).mapInArrow(run, "at long, deleted array<int>")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_template) for every row; n_template lines were deleted as shared with the neighbour.

    Pages stand in order of (host, path, id) and are dealt by ranges of it, so that a host with very many pages spreads over
    tasks; a range gets the neighbours of its edges too, so the result does not depend on the ranges. A null html counts as
    empty: text '' and 0. A null url or one without a host has no neighbour. Repeated rows give repeated results, and are
    copies, so no neighbours, of each other; an empty table gives none; a null id stays null. Other columns are not read.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    rows = rows.withColumn("at", F.xxhash64("page_id", "url", "html"))  # the same for repeated rows only
    address = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    hosted = rows.withColumns({"host": F.lower(F.regexp_extract("url", address, 1)), "path": F.regexp_extract("url", address, 2)})
    with Workspace(pages.sparkSession, "html") as space:
        apart = space.written(taken_apart(hosted), "apart")
        dealt = apart.filter("host != ''").select(*DIGEST).repartitionByRange("host", "path", "page_id", "at").withColumn("part", F.spark_partition_id())
        dealt = space.written(dealt, "dealt")
        # a row of numbers a page that has lines to delete; Spark broadcasts the table if it is small, and else sorts both
        deleted = shared_with_neighbour(with_edges(dealt)).groupBy("at").agg(F.first("deleted").alias("deleted"))
        deleted = space.written(deleted, "deleted")
        space.drop(dealt)
        return space.finish(texts_of(apart.select("at", "page_id", "url", "zones", "text").join(deleted, "at", "left")))


def texts_of(rows: DataFrame) -> DataFrame:
    """The result for (page_id, url, zones, text, deleted) rows: `deleted` counts all lines of a page, `text` has those that are not chrome."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, texts = batch.slice(k, 256), []
                deleted = part.column(4).to_pylist()
                for zones, text, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), deleted):
                    if gone:
                        at = [i for i, z in enumerate(zones) if z != CHROME_ZONE]
                        text = main_text(list(zip([OUTSIDE] * len(at), text.split("\n"))), {i for i, x in enumerate(at) if x in set(gone)})
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array((len(d or ()) for d in deleted), pa.int64())], schema=schema)
        give_back_memory()

    return rows.select("page_id", "url", "zones", "text", "deleted").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
