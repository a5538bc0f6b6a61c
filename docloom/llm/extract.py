"""Operator 4: HTML extraction by consensus host paths.

Every page's containers are scored by the running text that stands in them, less what is linked; the best container's
generalised path (tags with their classes, digits taken out), widened to the article or main element around it, is the
page's vote. Votes are summed per host and path in Spark, by partial aggregation, so a hot host costs no more than
others; each page is then extracted again under its host's winning path, where it has that path with running text in it, or else under its own best one.

Elements leave the text by what they are (menus, forms, scripts, hidden ones), or by a class or id that as a whole names
comments, adverts, menus and the like (`ad-slot`, not `share-price`). A name that only hints at a notice or a list of links
(`notice`, `header`, `related`) takes an element out only where links make up half of it, or where the host votes so:
the path's texts repeat over pages of different text. No name takes out an element that holds the article, main or a h1 with its text, and
a form, dialog, aside or button stays where it holds most of a page's running text.

Reader comments go by their structure: siblings of one path that each show a date and an author, or a way to reply, beside other text, and
article elements inside the article. A host's pages vote for such paths too, so that a page's only comment goes where others have several.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import small, store

# Element kinds.
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPARED = frozenset("form dialog aside button".split())
DROPPED = frozenset("nav footer select textarea menu head iframe object svg canvas noscript template".split())
HOLDERS = frozenset("article main section div td body blockquote center".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe xmp noframes".split())
#: A class or id of these words alone (and PLAIN ones) names what is no part of an article.
HARD = frozenset("nav navbar navigation menu menubar sidebar footer masthead topbar ad ads adv advert adverts advertisement advertisements adsbygoogle promo promotion sponsor sponsored comment comments commentlist respond disqus cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay breadcrumb breadcrumbs crumbs pagination pager login toolbar".split())
#: These only hint at it.
SOFT = frozenset("commercial header banner side rail foot notice notices notification notifications alert alerts warning warnings message share sharing social related recommended recommendations search form widget widgets legal copyright disclaimer tags toc replies reply discussion skip author".split())
#: Of the names that take an element out, those of lists of links: running text stays in spite of them.
LINKS = frozenset("nav navbar navigation menu menubar topbar breadcrumb breadcrumbs crumbs pagination pager toolbar".split())
#: Classes, and relations of links, that mark who wrote something, when, and where to reply.
AUTHOR, DATE, REPLY = (frozenset(w.split()) for w in ("author byline user username avatar vcard nickname commenter poster", "date time timestamp posted published when ago", "reply replies respond quote report"))
SIGNED, REPLIES = 3, 4
PLAIN = frozenset("user reader readers visitor area bar block body bottom box button buttons col column container content entry group holder inner item items left link links list main module outer page panel right row section site slot strip text thread top unit wrap wrapper global primary secondary".split())
#: Elements that a start tag of these kinds ends when they are open.
ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
WIDE = ("article", "main")

#: Running text from which on a h1 is that of an article, a list of links is none, and what stands beside comments is no list itself.
RUNNING = 140
#: A hinted path is voted out where its texts repeat so: at least so many pages of different text, and at most this share of
#: different texts among them.
PAGES, DISTINCT = 3, 0.5
#: Pages of different text on which a host's path must show comments, to take it out on the others.
THREADS = 2

KEPT, ALWAYS, NAMED, HINTED, SPARE, LISTED = range(6)
_ATTR = re.compile(r"""([^\s"'<>/=][^\s<>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_STOP = re.compile(r"[>\"']")
_kinds: dict[tuple[str, str], tuple[str, int, int]] = {}


def _says(name: str) -> int:
    """What a class or id says about its element."""
    parts = [x.lower() for x in re.split(r"[-_\d]+|(?<=[a-z])(?=[A-Z])", name) if x]
    if not parts or any(x not in HARD and x not in SOFT and x not in PLAIN for x in parts):
        return KEPT
    if any(x in HARD for x in parts):
        return LISTED if all(x in LINKS or x not in HARD for x in parts) else NAMED
    return HINTED if any(x in SOFT for x in parts) else KEPT


def _kind(tag: str, attrs: str) -> tuple[str, int, int]:
    """Generalised name of an element (its tag with its classes), why it may hold no article, and what it marks (bits of author and date, SIGNED, and REPLIES)."""
    known = _kinds.get((tag, attrs))
    if known is not None:
        return known
    found: dict[str, str] = {}
    for m in _ATTR.findall(attrs):
        found.setdefault(m[0].lower(), m[1] or m[2] or m[3])
    classes = unescape(found.get("class", "")).split()
    kind = KEPT
    hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or re.search(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", found.get("style", ""), re.I)
    if tag in DROPPED or hidden or set(found.get("role", "").lower().split()) & ROLES:
        kind = ALWAYS
    elif tag in SPARED:
        kind = SPARE
    elif tag == "header" and any(_says(n) == HINTED and re.match("(?i)site|global|page|top", n) for n in classes):
        kind = ALWAYS
    elif tag not in ("article", "main", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6"):
        said = {_says(n) for n in (*classes, *found.get("id", "").split())}
        kind = next((k for k in (NAMED, LISTED, HINTED) if k in said), KEPT)
        if tag in ("td", "th", "tr") and kind != KEPT:
            kind = HINTED  # a column's name tells of its content
    elif tag == "article" and any(_says(n) == NAMED for n in classes):
        kind = NAMED
    words = {w.lower() for n in (*classes, *found.get("rel", "").split(), *found.get("itemprop", "").split()) for w in re.split(r"[-_\d]+|(?<=[a-z])(?=[A-Z])", n)}
    marks = sum(1 << i for i, kinds in enumerate((AUTHOR, DATE, REPLY)) if words & kinds) | (2 if tag == "time" else 0)
    known = ".".join([tag, *sorted({re.sub(r"\d+", "#", n.lower()).replace("/", "_") for n in classes})]), kind, marks
    if len(attrs) < 1000:
        if len(_kinds) > 100_000:
            _kinds.clear()
        _kinds[tag, attrs] = known
    return known


class Page:
    """Elements (block ones, and inline ones that go) and blocks of text of one page, read in one linear scan.

    An element's path is a number; steps holds each path's parent and last name. blocks: (text, linked characters, element).
    """

    def __init__(self, html: str | None):
        self.tags, self.kinds, self.parents, self.paths = [""], [KEPT], [-1], [0]
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[str, int, int]] = []
        self.marks = [0]
        self._stack, self._open, self._held = [0], {}, []
        self._linked = self._skip = self._link = 0
        self._scan(html or "")

    def _flush(self) -> None:
        if self._held:
            text = " ".join(unescape("".join(self._held)).split())
            self._held.clear()
            if text:
                # an inline element that goes is never where a block of text stands
                at = next(e for e in reversed(self._stack) if not e or self.tags[e] in BLOCKS or not self.kinds[e])
                self.blocks.append((text, min(self._linked, len(text)), at))
        self._linked = 0

    def _pop(self, n: int) -> None:
        for e in self._stack[n:]:
            tag = self.tags[e]
            self._open[tag] -= 1
            self._skip -= tag not in BLOCKS
        del self._stack[n:]
        if self._link > n:
            self._link = 0

    def _text(self, piece: str) -> None:
        if not self._skip:
            self._held.append(piece)
            if self._link:
                self._linked += len(piece)

    def _end_tag(self, tag: str) -> None:
        if tag == "a":
            self._link = 0
        if self._open.get(tag):
            n = next(n for n in range(len(self._stack) - 1, 0, -1) if self.tags[self._stack[n]] == tag)
            if any(self.tags[e] in BLOCKS for e in self._stack[n:]):
                self._flush()
            self._pop(n)
        elif tag in BLOCKS:
            self._flush()

    def _start_tag(self, tag: str, attrs: str, closed: bool) -> None:
        block = tag in BLOCKS
        if tag in VOID or closed and not block:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._flush()
            return
        name, kind, marks = _kind(tag, attrs)
        self.marks[self._stack[-1]] |= 0 if block else marks
        if block:
            self._flush()
            if tag == "header" and not kind and not any(self._open.get(w) for w in WIDE):
                kind = ALWAYS  # a header of the page goes, one inside the article stays
            closes = ("p",) if tag not in ENDS and self.tags[self._stack[-1]] == "p" else ENDS.get(tag, ())
            for n in range(len(self._stack) - 1, 0, -1):
                over = self.tags[self._stack[n]]
                if over in closes:
                    self._pop(n)
                elif over in HOLDERS or over in ("ul", "ol", "table", "dl"):
                    break
        elif kind == HINTED or not kind and not self._skip:
            # links and hints inside a line of text are part of it
            if tag == "a":
                self._link = len(self._stack)
            return
        parent = self._stack[-1]
        step = (self.paths[parent], name)
        if step not in self.known:
            self.known[step] = len(self.steps)
            self.steps.append(step)
        self._stack.append(len(self.tags))
        self.tags.append(tag)
        self.kinds.append(kind)
        self.marks.append(marks)
        self.parents.append(parent)
        self.paths.append(self.known[step])
        self._open[tag] = self._open.get(tag, 0) + 1
        self._skip += not block

    def _scan(self, html: str) -> None:
        at, size, last = 0, len(html), html.rfind(">")
        quotes, cdata = {'"': True, "'": True}, True  # whether such a quote, or a CDATA end, may still be ahead
        while at < size:
            i = html.find("<", at)
            if i < 0 or i > last and html[i : i + 4] != "<!--":
                # no tag can end behind here; what begins one is none of the text
                rest = html[at:] if i < 0 or not re.match(r"</?[a-zA-Z!?]", html[i : i + 3]) else html[at:i]
                self._text(rest)
                break
            if i > at:
                self._text(html[at:i])
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                at = size if end < 0 else end + 3
                continue
            if cdata and html.startswith("<![CDATA[", i):
                end = html.find("]]>", i)
                cdata = end >= 0
                if cdata:
                    self._text(html[i + 9 : end].replace("&", "&amp;"))
                    at = end + 3
                    continue
            if html[i + 1 : i + 2] in ("!", "?"):
                at = html.find(">", i) + 1
                continue
            ends = html[i + 1 : i + 2] == "/"
            named = _NAME.match(html, i + 1 + ends)
            if not named:
                if ends:
                    at = html.find(">", i) + 1  # a bogus comment
                else:
                    self._text("<")
                    at = i + 1
                continue
            tag, j = named[0].lower(), named.end()
            behind = j
            while True:
                stop = _STOP.search(html, j)
                if stop is None:
                    # only quoted ends are left: quotes count no more
                    quotes = {'"': False, "'": False}
                    j = html.find(">", named.end())
                    break
                j = stop.start()
                if stop[0] == ">":
                    break
                close = -1
                # a quote opens a value only behind an equals sign, which no quote stands before
                if quotes[stop[0]] and html[behind:j].rstrip()[-1:] == "=":
                    close = html.find(stop[0], j + 1)
                    quotes[stop[0]] = close >= 0
                behind = j = (close if close >= 0 else j) + 1
            attrs, at = html[named.end() : j], j + 1
            if ends:
                self._end_tag(tag)
            elif tag in RAW:
                if tag in BLOCKS:
                    self._flush()
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                end = html.find(">", found.end()) if found else -1
                at = size if end < 0 else end + 1
            else:
                self._start_tag(tag, attrs.removesuffix("/"), attrs.endswith("/"))
        self._flush()

    def path(self, number: int) -> str:
        names = []
        while number > 0:
            number, name = self.steps[number]
            names.append(name)
        return "/".join(reversed(names))

    def number(self, path: str) -> int | None:
        """The number of a path, None where the page has no such element."""
        at = 0
        for name in path.split("/"):
            at = self.known.get((at, name), -1)
            if at < 0:
                return None
        return at

    def _sums(self, gone: list[bool] | None = None) -> tuple[list[int], list[int]]:
        """Characters of each element, and those of running text (not linked) among them, without what is gone."""
        chars, running = [0] * len(self.tags), [0] * len(self.tags)
        for text, linked, e in self.blocks:
            if not gone or not gone[e]:
                chars[e] += len(text)
                running[e] += len(text) - linked
        for e in range(len(self.tags) - 1, 0, -1):
            chars[self.parents[e]] += chars[e]
            running[self.parents[e]] += running[e]
        return chars, running

    def _by_kind(self, hinted: set[int]) -> list[bool]:
        """Of each element, whether its own kind or that of one around it takes it out. hinted: digests of the hinted paths that the host votes out."""
        n = len(self.tags)
        heads, wide, out = [False] * n, [0] * n, [False] * n
        chars, running = self._sums()
        for e in range(n - 1, 0, -1):
            kept, p = self.kinds[e] in (KEPT, HINTED), self.parents[e]
            heads[e] = heads[e] or self.tags[e] == "h1" and kept
            wide[e] += self.tags[e] in WIDE and kept
            heads[p] = heads[p] or heads[e]
            wide[p] += wide[e]
        digests = self.digests() if hinted else []
        for e in range(1, n):
            kind, own = self.kinds[e], False
            holds = wide[e] > 0 or heads[e] and running[e] >= RUNNING
            if kind == ALWAYS:
                own = True
            elif kind == SPARE:
                # what a page is all about is in no frame around nothing: a site may wrap its pages so
                own = not running[e] or 2 * running[e] < running[0] or wide[e] < wide[0]
            elif kind == NAMED:
                own = not holds
            elif kind == LISTED:
                own = not holds and (running[e] < RUNNING or 3 * running[e] < 2 * chars[e])
            elif kind == HINTED and not holds:
                own = 2 * running[e] <= chars[e] and chars[e] > 0 or bool(hinted) and digests[self.paths[e]] in hinted
            out[e] = own or out[self.parents[e]]
        return out

    def threads(self, gone: list[bool]) -> set[int]:
        """Paths of comments, in what is not gone: of siblings that each show an author and a date or a way to reply (articles: a way to reply), where as
        much running text as a short paragraph stands outside of them; and of article elements inside an article with so much text of its own."""
        n = len(self.tags)
        _, running = self._sums(gone)
        marks, nested, around = self.marks[:], [0] * n, [0] * n  # around: the article around an element
        for e in range(1, n):
            p = self.parents[e]
            around[e] = p if self.tags[p] == "article" else around[p]
        siblings: dict[tuple[int, int], list[int]] = {}
        for e in range(n - 1, 0, -1):
            if gone[e]:
                continue
            p, article = self.parents[e], self.tags[e] == "article"
            if article and around[e]:
                nested[around[e]] += running[e]
            elif running[e] and self.tags[e] in BLOCKS and (marks[e] & REPLIES or not article and marks[e] & SIGNED == SIGNED):
                siblings.setdefault((p, self.paths[e]), []).append(e)
            marks[p] |= marks[e]
        out = {path for (_, path), found in siblings.items() if len(found) > 1 and running[0] - sum(running[e] for e in found) >= RUNNING}
        return out | {self.paths[e] for e in range(1, n) if self.tags[e] == "article" and around[e] and not gone[e] and running[around[e]] - nested[around[e]] >= RUNNING}

    def dropped(self, voted: Iterable[int] = ()) -> list[bool]:
        """Of each element, whether it or one around it goes. voted: digests of the paths of notices and of comments that the host votes out."""
        votes = set(voted)
        out = self._by_kind(votes)
        paths, n = self.threads(out), len(self.tags)
        _, running = self._sums(out)
        if votes:
            digests = self.digests()
            found = [e for e in range(1, n) if self.kinds[e] == KEPT and not out[e] and digests[self.paths[e]] in votes]
            # a path of comments that is all of another page is its text
            if running[0] - sum(running[e] for e in found) >= RUNNING:
                paths |= {self.paths[e] for e in found}
        for e in range(1, n):
            out[e] = out[e] or self.paths[e] in paths or out[self.parents[e]]
        return out

    def digests(self) -> list[int]:
        """A 64-bit hash of each path."""
        out = [0]
        for parent, name in self.steps[1:]:
            out.append(_digest(f"{out[parent]}/{name}"))
        return out

    def best(self, dropped: list[bool]) -> int | None:
        """The best container's path, up to the nearest article or main element around it.

        A block's running text counts fully for its nearest holder, less by a third a level up. Of equals the first stands.
        """
        carried, scores = [0.0] * len(self.tags), {}
        for text, linked, e in self.blocks:
            if not dropped[e]:
                carried[e] += _worth(text, linked)
        seen = [False] * len(self.tags)
        for _, _, e in self.blocks:
            if not dropped[e]:
                seen[e] = True
        for e in range(len(self.tags) - 1, 0, -1):
            p = self.parents[e]
            if self.tags[e] in HOLDERS and seen[e]:
                # an article or main element is what the page itself calls its text
                scores[self.paths[e]] = scores.get(self.paths[e], 0.0) + carried[e] * (1.5 if self.tags[e] in WIDE else 1.0)
                carried[p] += carried[e] * 0.67
            else:
                carried[p] += carried[e]
            seen[p] = seen[p] or seen[e]
        if not scores:
            return None
        most = max(scores.values())
        at = best = min(k for k, s in scores.items() if s == most)
        while at > 0:
            above, name = self.steps[at]
            if name.partition(".")[0] in WIDE:
                return at
            at = above
        return best

    def under(self, path: int) -> list[bool]:
        out = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            out[e] = out[self.parents[e]] or self.paths[e] == path
        return out

    def main_text(self, winner: str | None = None, voted: Iterable[int] = ()) -> str:
        """The kept blocks under the winning path, or, where the page has little running text there and less than half of that of its own best, under that."""
        dropped = self.dropped(voted)
        kept = [b for b in self.blocks if not dropped[b[2]]]
        best = self.best(dropped)
        if best is None:
            return "\n".join(text for text, _, _ in kept)  # no holder at all: bare blocks
        inside, host = self.under(best), self.number(winner) if winner else None
        if host is not None and host != best:
            theirs = self.under(host)
            # a text of links alone is worth nothing, but still tells where the container is
            held, own = (sum(len(text) - linked + 1e-6 * len(text) for text, linked, e in kept if some[e]) for some in (theirs, inside))
            if held >= RUNNING or held > 0 and 2 * held >= own:
                inside = theirs
        return "\n".join(text for text, _, e in kept if inside[e])

    def thread_digests(self) -> list[int]:
        found = self.threads(self._by_kind(set()))
        digests = self.digests() if found else []
        return [digests[p] for p in sorted(found)]

    def hints(self, dropped: list[bool]) -> list[tuple[int, int]]:
        """(path, text) digests of the hinted elements that are still kept."""
        some = {e for e in range(1, len(self.tags)) if self.kinds[e] == HINTED and not dropped[e]}
        if not some:
            return []
        digests, texts = self.digests(), {}
        for text, _, e in self.blocks:
            at = e
            while at > 0 and at not in some:
                at = self.parents[at]
            if at > 0:
                texts.setdefault(at, []).append(text)
        return [(digests[self.paths[e]], _digest("\n".join(t))) for e, t in texts.items()]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _worth(text: str, linked: int) -> float:
    return max(0.0, (len(text) - 2 * linked)) + 20 * text.count(",")


def host_of(url):
    """Lower-case host of a URL column; null where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes, voted: the winning generalised path of each host (ties: the first in order), and the digests of the
    hinted paths that its pages vote out. A row per host with a vote; a host's hinted paths are those of its templates."""

    def vote(batches):
        names = ["host", "path", "hint", "said", "page"]
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(html.as_py())
                dropped = page.dropped()
                best = page.best(dropped)
                if best is None:
                    continue
                rows.append((host, page.path(best), None, None, None))
                hints, threads = page.hints(dropped), page.thread_digests()
                if hints or threads:
                    own = _digest(page.main_text())
                    rows += [(host, None, path, said, own) for path, said in hints]
                    rows += [(host, None, path, None, own) for path in threads]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    cast = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).where("host IS NOT NULL")
    votes = store(cast.mapInArrow(vote, "host string, path string, hint bigint, said bigint, page bigint"), "votes")
    sums = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    won = sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "path")).alias("w"))
    # a text counts once for all pages that are copies of each other
    texts = votes.where("hint IS NOT NULL AND said IS NOT NULL").groupBy("host", "hint", "said", "page").agg(F.lit(1).alias("n")).groupBy("host", "hint", "said").agg(F.sum("n").alias("n"))
    hints = texts.groupBy("host", "hint").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).where((F.col("n") >= PAGES) & (F.col("d") <= F.col("n") * DISTINCT))
    # pages of different text that show comments under a path
    threads = votes.where("hint IS NOT NULL AND said IS NULL").groupBy("host", "hint", "page").agg(F.lit(1).alias("n")).groupBy("host", "hint").agg(F.sum("n").alias("n")).where(F.col("n") >= THREADS)
    out = hints.select("host", "hint").unionByName(threads.select("host", "hint")).distinct().groupBy("host").agg(F.sort_array(F.collect_list("hint")).alias("voted"))
    return won.join(out, "host", "left").select("host", F.col("w.path").alias("path"), (-F.col("w.votes")).alias("votes"), "voted")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path_votes: one row per row of pages (page_id, url, html; other columns are ignored,
    whatever their names).

    A null or empty html gives an empty text; a page without a host in its url goes by its own best path. A html of any
    length is read whole, in time linear in it. Repeated rows count as votes each and give equal rows; of paths with
    equally many votes the first in order wins. An empty table gives an empty table. Two narrow passes; only votes
    are shuffled, and the table of hosts is broadcast only if its size is within the bound.
    """
    winners = store(host_paths(pages), "host-paths")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(small(winners), "host", "left").select("page_id", "url", "html", "path", "votes", "voted")

    def extract(batches):
        for batch in batches:
            texts = [Page(html.as_py()).main_text(path, voted or ()) for html, path, voted in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(4)], ["page_id", "url", "text", "n_chars", "path_votes"])

    return joined.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint, path_votes bigint")
