"""Main text of web pages by removing site templates: element subtrees that recur across many pages of their host, and elements whose role is known.

Every page is parsed twice. The first pass hashes its subtrees; Spark counts in how many different pages of the host each one stands. The second pass deletes
the recurring ones, then what a tag, role or class names as menu, notice, form and the like, and joins what remains of the article.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import pieces
from sessionlake.session import cut_lineage

MIN_PAGES = 3  # a template stands in so many different pages of its host at least,
SHARE = 0.001  # and in this share of them, so that the templates of one host are 1,000 times the subtrees of a page at most
BROADCAST_HASHES = 200_000

# Element names by their part in a page (HTML standard).
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption html head body article main".split())
NO_TEXT = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input label map math menu meter nav noembed noframes noscript object option progress script search select style svg template textarea title video xmp".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
          "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",)), "thead": ("tr td th", ("table",))}
CLOSES = {tag: (frozenset(ends.split()), frozenset(stops)) for tag, (ends, stops) in CLOSES.items()}
IN_P = BLOCK - frozenset("caption dd dt li legend optgroup option tbody td tfoot th thead tr body head html summary".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget""".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]{0,65536}"|'[^']{0,65536}')*+>|[^>]*>?)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|\Z)""", re.I)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_TABLE = frozenset("tr td th tbody thead tfoot".split())
NOT_WORD = re.compile(r"[^a-z0-9]+")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


class Page:
    """The elements of one page in document order, and its text as fragments of blocks.

    Broken markup is read as browsers do in the main: p, li, cells and the like end where the next begins, an end tag ends all within it, one that fits nothing is
    passed over, and what is never closed ends with the page."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.named, self.is_main, self.naming = ["#root"], [0], [False], [False], [""]
        self.fragments: list[tuple[int, int, str]] = []  # block, element, raw text
        self._stack, self._open_tags = [0], Counter()
        block, at = 0, 0
        while token := TOKEN.search(source, at):
            if token.start() > at:
                self.fragments.append((block, self._stack[-1], source[at:token.start()]))
            at = token.end()
            if token[1]:
                block += self._end(token[1].lower())
            elif token[2]:
                name = token[2].lower()
                block += self._begin(name, token[3])
                if name == "br":
                    self.fragments.append((block, self._stack[-1], " "))
                if name in RAW:
                    stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    at = stop.start() if stop else len(source)
        if at < len(source):
            self.fragments.append((block, self._stack[-1], source[at:]))
        self._measure()

    def _cut(self, depth: int) -> None:
        for node in self._stack[depth:]:
            self._open_tags[self.tag[node]] -= 1
        del self._stack[depth:]

    def _begin(self, name: str, attributes: str) -> bool:
        ended = name in IN_P and self._imply(frozenset(("p",)), frozenset(("button", "table", "caption", "td", "th")), False)
        if name in CLOSES:
            ended |= self._imply(*CLOSES[name], name in IN_TABLE)
        if name in HEADING and self.tag[self._stack[-1]] in HEADING:
            self._cut(len(self._stack) - 1)
        node = len(self.tag)
        kept = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if len(attributes) > 1 else {}
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.is_main.append(name == "main" or kept.get("role", "").lower() == "main")
        self.named.append(bool(kept) and not self.is_main[node] and name not in ("html", "body") and self._is_named(kept))
        self.naming.append(repr(sorted(kept.items())) if kept else "")
        if name not in VOID:
            self._stack.append(node)
            self._open_tags[name] += 1
        return ended or name in BLOCK

    def _imply(self, ends: frozenset[str], stops: frozenset[str], through: bool) -> bool:
        """Ends the outermost open element of these names below the stops."""
        if not any(self._open_tags[tag] for tag in ends):
            return False
        found = 0
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in ends:
                found = depth
            elif tag in stops or not through and tag in BLOCK and tag not in ("p", "div", "address"):
                break
        if found:
            self._cut(found)
        return bool(found)

    def _end(self, name: str) -> bool:
        if not self._open_tags[name]:
            return False
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag == name:
                self._cut(depth)
                return name in BLOCK
            if name not in BLOCK and tag in BLOCK:
                return False
        return False

    @staticmethod
    def _is_named(kept: dict[str, str]) -> bool:
        words = {w for key in ("class", "id") for w in NOT_WORD.split(kept.get(key, "").lower())}
        return "hidden" in kept or kept.get("role", "").lower() in ROLES or bool(words & WORDS) or bool(UNSEEN.search(kept.get("style", "")))

    def _measure(self) -> None:
        """By element: characters of its text, those in links, the last element within it, whether it holds an article or main part; then what is deleted for its role."""
        count = len(self.tag)
        self.size, self.linked, self.last = [0] * count, [0] * count, list(range(count))
        holds, in_link = [self.tag[i] == "article" or self.is_main[i] for i in range(count)], [False] * count
        for i in range(1, count):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for _, node, text in self.fragments:
            n = len("".join(text.split()))
            self.size[node] += n
            self.linked[node] += n * in_link[node]
        for i in range(count - 1, 0, -1):
            up = self.parent[i]
            self.size[up] += self.size[i]
            self.linked[up] += self.linked[i]
            self.last[up] = max(self.last[up], self.last[i])
            holds[up] |= holds[i]
        self.holds_main = holds
        self._regions()

    def _below(self, flags: list[bool]) -> list[bool]:
        out = flags[:]
        for i in range(1, len(out)):
            out[i] |= out[self.parent[i]]
        return out

    def _regions(self) -> None:
        """`role`: deleted for what it is; `within`: in the article, else the main part, else anywhere. What holds the article is never deleted."""
        count = len(self.tag)
        banned = [self.named[i] or self.tag[i] in NO_TEXT for i in range(count)]
        under = self._below(banned)
        roots = [i for i in range(count) if self.tag[i] == "article" and not under[i]]
        if not roots and "article" in self.tag:  # within a form, or in an element named like a menu
            hard = self._below([self.tag[i] in NO_TEXT and self.tag[i] != "form" for i in range(count)])
            roots = [i for i in range(count) if self.tag[i] == "article" and not self.named[i] and not hard[i]]
        roots = roots or [i for i in range(count) if self.is_main[i] and not under[i]]
        path = set()
        for i in roots:
            while i and i not in path:
                path.add(i)
                i = self.parent[i]
        inside = [not roots] * count
        for i in roots:
            inside[i] = True
        self.within = self._below(inside)
        titled = {self.parent[i] for i in range(count) if self.tag[i] in HEADING}
        own = [i not in path and (banned[i] or self.tag[i] == "header" and not (roots and self.within[i] and i in titled)) for i in range(count)]
        self.role, self.marked = self._below(own), bool(roots)

    def digests(self) -> list[bytes]:
        """Of each element with everything in it: name, naming attributes, and text with its white space made one space."""
        inside: list[list[bytes]] = [[] for _ in self.tag]
        own: list[list[bytes]] = [[] for _ in self.tag]
        for _, node, text in self.fragments:
            if words := " ".join(text.split()):
                own[node].append(words.encode("utf-8", "surrogatepass"))
        out = [b""] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            out[i] = _digest(b"\0".join([self.tag[i].encode("utf-8", "surrogatepass"), self.naming[i].encode("utf-8", "surrogatepass"), *own[i], *reversed(inside[i])]))
            inside[self.parent[i]].append(out[i])
        return out

    def candidates(self) -> list[int]:
        """Elements that may be site templates: blocks with text that hold no article and are no prose themselves; within an article, only those mostly of links."""
        return [i for i in range(1, len(self.tag)) if self.tag[i] in BLOCK and self.tag[i] not in PROSE and self.size[i] and not self.holds_main[i]
                and not (self.marked and self.within[i] and 2 * self.linked[i] < self.size[i])]

    def blocks(self, deleted: list[bool]) -> list[tuple[int, str]]:
        """(an element of the block, its text) of the blocks with text, in page order."""
        out: list[tuple[int, str]] = []
        last, first, parts = -1, 0, []
        for block, node, text in [*self.fragments, (-2, 0, "")]:
            if block != last:
                if words := " ".join(entities.unescape("".join(parts)).split()):
                    out.append((first, words))
                last, parts = block, []
            if not deleted[node]:
                first = first if parts else node
                parts.append(text)
        return out


def page_templates(source: str) -> list[tuple[int, int]]:
    """(hash, mark) of a page's possible templates; hash 0 stands for the page. The mark is the hash of the page's longest block of text outside the subtree: pages
    that share it are copies and count as one. A subtree with more than half of the page's text is content here, unless an article is marked elsewhere."""
    page = Page(source)
    blocks = sorted(page.blocks([r or not w for r, w in zip(page.role, page.within)]), key=lambda b: -len(b[1]))
    marks = [(node, _number(_digest(text.encode("utf-8", "surrogatepass")))) for node, text in blocks]
    whole = sum(len("".join(text.split())) for _, text in blocks)
    found = {(0, marks[0][1] if marks else 0)}
    chosen = [i for i in page.candidates() if page.role[i] or not page.within[i] or 2 * page.size[i] <= whole]
    digests = page.digests() if chosen else []
    for i in chosen:
        found.add((_number(digests[i]), next((m for node, m in marks if not i <= node <= page.last[i]), 0)))
    return sorted(found)


def main_text(source: str, templates: frozenset[int]) -> tuple[str, int]:
    """The text that remains, and the number of outermost subtrees deleted as templates."""
    page = Page(source)
    chosen, count = set(), 0
    if templates and (candidates := page.candidates()):
        digests = page.digests()
        chosen = {i for i in candidates if _number(digests[i]) in templates}
        last = 0
        for i in sorted(chosen):
            count += i > last
            last = max(last, page.last[i])
    template = page._below([i in chosen for i in range(len(page.tag))])
    return "\n".join(text for _, text in page.blocks([t or r or not w for t, r, w in zip(template, page.role, page.within)])), count


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces([whole], "html")):
        found = [(host, *pair) for host, x in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()) for pair in page_templates(x or "")]
        yield pa.record_batch({name: pa.array([row[i] for row in found], kind) for i, (name, kind) in enumerate((("host", pa.string()), ("hash", pa.int64()), ("mark", pa.int64())))})


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host, hashes (array<long>) of subtrees that recur on it; `pages` has host and html. Copies of one page count once.

    Counts are partial sums by host and hash. Only what reaches both thresholds becomes a list, whose length is bounded by the share."""
    marks = pages.filter("host <> ''").mapInArrow(_hashed, "host string, hash long, mark long")
    counts = marks.distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts.filter((F.col("n") >= min_pages) | (F.col("hash") == 0)))
    sizes = counts.filter("hash = 0").select("host", F.col("n").alias("_pages"))
    often = counts.filter("hash <> 0").join(sizes, "host").filter(F.col("n") >= F.col("_pages") * share)
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))


def with_host(pages: DataFrame, url: str, name: str) -> DataFrame:
    return pages.withColumn(name, F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))))


def page_texts(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (subtrees deleted because they recur on the host) for every row of pages (page_id, url, html).

    A null or empty html gives an empty text. Pages without url or host have no recurring subtrees; only roles count there. Repeated rows stay, one row each.
    The article is what article elements hold; without any, the main element, without that the whole page. A line break is white space.
    The lists of templates travel to the pages by broadcast while they are small, by a join on host beyond; a host with a third of all pages is split then by
    adaptive execution, since each host has one list."""
    kept = with_host(pages.select("page_id", "url", "html"), "url", "host")
    found = cut_lineage(site_templates(kept.select("host", "html"), min_pages, share))
    small = (found.agg(F.sum(F.size("hashes"))).first()[0] or 0) <= broadcast_hashes
    joined = kept.join(F.broadcast(found) if small else found.hint("merge"), "host", "left").select("page_id", "url", "html", "hashes")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, frozenset[int]] = {}
        for batch in (part for whole in batches for part in pieces([whole], "html")):
            texts, counts = [], []
            for x, hashes in zip(batch.column("html").to_pylist(), batch.column("hashes")):
                text, count = main_text(x or "", _templates(hashes, known))
                texts.append(text)
                counts.append(count)
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_templates": pa.array(counts, pa.int64())})

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_templates long")


def _templates(hashes: pa.ListScalar, known: dict[bytes, frozenset[int]]) -> frozenset[int]:
    """The list as a set; lists of a host come again and again, so a few hundred sets are kept."""
    if not hashes.is_valid or not len(hashes.values):
        return frozenset()
    values = hashes.values
    key = values.to_numpy(zero_copy_only=False).tobytes()
    if key not in known:
        if len(known) >= 256:
            known.clear()
        known[key] = frozenset(values.to_pylist())
    return known[key]
