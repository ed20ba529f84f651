"""Operator 8 - main text of web pages by union-free wrapper inference.

Pages of one host come from one template.  Each page becomes a stream of block
tags and text slots; tandem repeats in it fold into repeated groups, equal
streams of a host are counted once, and the different ones are aligned one
after the other: common tokens stay, a mismatch that repeats the group before
it makes that group repeated, any other becomes an optional group.  The result
is a union-free regular expression, the host's wrapper, that every page of the
host matches.  The same pass follows each text slot of the template (its block
elements with their classes; the turns of a repeated group are one slot) and
each container: the wrapper names the container that holds the host's varying
text, and its fixed slots, which hold one and the same text on all of three or
more pages.  A host whose pages are mostly fixed, or share their longest block,
has copies, not a template, and no fixed slots.

A page's main text is what lies in its article (or main) element, else in the
wrapper's main container, else in the body, without the wrapper's fixed slots;
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out by element, role or name, since their text varies
from page to page as an article's does.  Inside an article only whole classes
and ids count, outside also parts of them; body, article and main are left out
by neither, but an article by a whole one that names a comment or teaser.
Formulas keep their text; where all text stands in a form, the form is kept.
``matched`` says whether the page's own stream matches its host's wrapper.

Null and empty html give an empty text; a null or broken url is a host of its
own name; repeated pages give repeated rows; unclosed tags end with their
parent; elements nested deeper than ``DEEP`` have the place of their ancestor at
that depth; a null page_id stays null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import difflib
import html as html_lib
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, store, table
from .tokens import slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
RAW = "script|style|noscript|template|textarea|title|iframe"
EMBEDDED = "svg|object|canvas|video|audio"
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "tbody", "thead", "tfoot", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What is no main text.
LEFT_OUT_TAGS = frozenset("nav footer aside button select menu dialog head annotation annotation-xml".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
LEFT_OUT_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notices?|notification\w*|newsletter\w*"
    r"|subscri\w*|sidebar\w*|side|menu\w*|nav|navbar\w*|navigation|breadcrumbs?|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|comments?"
    r"|commentlist|disqus\w*|respond|repl(?:y|ies)|footer\w*|popup\w*|modal\w*|toolbar\w*|paginat\w*|widget\w*|skip|login|signup)(?:$|[-_ ])",
    re.I,
)
# Inside an article a class or id is left out as a whole, with usual beginnings and ends.
LEFT_OUT_INSIDE = re.compile(
    r"(?:(?:post|article|entry|user|site|page|js|wp)[-_])?(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notices?|notification\w*"
    r"|newsletter|subscri\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|shar(?:e|ing)|social|related|recommend(?:ed|ations?)|comments?|commentlist"
    r"|disqus\w*|respond|repl(?:y|ies)|footer|popup|modal|toolbar|paginat(?:ion|or)|widget|skip|login|signup)"
    r"(?:[-_](?:box|block|bar|list|links?|buttons?|area|wrap|wrapper|container|section|widget|items?|posts?|articles?|form|media|inner|content|title|thread|slot|unit|[0-9]+))*",
    re.I,
)
# An article or main element is left out only by a whole class or id.
LEFT_OUT_ARTICLES = re.compile(
    r"(?:post|article|user)?[-_]?(?:comments?|commentlist|comment[-_](?:body|item|content)|repl(?:y|ies)|respond|teasers?)"
    r"|(?:related|recommended|promo|sponsored)(?:[-_](?:posts?|articles?|items?))?",
    re.I,
)
OUTER_NAMES = re.compile(r"(?:^|[-_ ])(?:header\w*|masthead|topbar)(?:$|[-_ ])", re.I)

#: Parts in which a host's streams are merged, step by step.
MERGES = (256, 16, 1)

ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_WHOLE = re.compile(rf"<({RAW}|{EMBEDDED})(?=[\s/>])", re.I)
_QUOTE_OR_END = re.compile("[>\"']")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in f"{RAW}|{EMBEDDED}".split("|")}
#: Elements deeper than this have the place of their ancestor at that depth.
DEEP = 200


def tags(html: str):
    """(start, end, closing, name, attributes) of all markup, from left to right;
    what holds no element (comments, scripts, media, broken tags) has no name.

    Time is linear on any page: a search that has failed is not made again - for
    a ``>`` or a closing tag where none follows, and for the end of a tag whose
    quotes swallow the rest (``dead`` holds the quotes that such a search opened).
    """
    at, unclosed, dead = 0, set(), set()
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, "", None, ""
            at = end
            continue
        first = html[at + 1 : at + 2]
        named = _NAME.match(html, at)
        if not named and (not first or first not in "!?/"):
            at += 1
            continue
        close = html.find(">", at)
        if close < 0:  # no tag can end any more, and a comment goes on to the end
            if (at := html.find("<!--", at)) >= 0:
                yield at, len(html), "", None, ""
            return
        end, name, closing, rest = close + 1, None, "", ""
        if found := _WHOLE.match(html, at):
            kind = found[1].lower()
            if kind in EMBEDDED.split("|") and html[close - 1] == "/":
                yield at, end, "", None, ""
                at = end
                continue
            ended = None if kind in unclosed else _CLOSING[kind].search(html, end)
            if ended or kind in RAW.split("|"):
                end = ended.end() if ended else len(html)
                yield at, end, "", None, ""
                at = end
                continue
            unclosed.add(kind)
        if named:
            j, opened = named.end(), []
            while hit := _QUOTE_OR_END.search(html, j):
                j = hit.start()
                if html[j] == ">":
                    closing, name, rest, end = named[1], named[2], html[named.end() : j], j + 1
                    break
                if j in dead:
                    hit = None
                    break
                opened.append(j)
                partner = html.find(html[j], j + 1)
                if partner < 0:
                    hit = None
                    break
                j = partner + 1
            if not hit:
                dead.update(opened)
        yield at, end, closing, name, rest
        at = end


NO_ELEMENT = ("", False, 0, "", "", False)


class Page:
    """Blocks, containers and the block-tag stream of one page."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, str, int, str]] = []  # container, depth of main, text, link characters, slot
        self.in_forms: list[tuple[str, int, str, int, str]] = []
        self.stream: list[str] = []
        # name, left out, main rank, path of containers, path of all blocks, in a form only
        self.stack: list[tuple[str, bool, int, str, str, bool]] = []
        self.buffer: list[str] = []
        self.open: Counter[str] = Counter()  # elements of the stack by name
        self.links = 0
        at = 0
        for start, end, closing, name, rest in tags(html):
            if start > at:
                self._text(html[at:start])
            at = end
            if name:
                (self._close if closing else self._open)(name.lower(), rest)
        if at < len(html):
            self._text(html[at:])
        self._flush()
        while self.stack:
            self._pop()

    def _text(self, raw: str) -> None:
        if self.stack and self.stack[-1][1]:
            if raw.strip() and self.stream[-1:] != ["#"]:
                self.stream.append("#")
            return
        self.buffer.append(raw)
        if self.open["a"]:
            self.links += len(raw.strip())

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(html_lib.unescape("".join(self.buffer)).split())
            if text:
                _, _, rank, path, slot, form = self.stack[-1] if self.stack else NO_ELEMENT
                (self.in_forms if form else self.blocks).append((path, rank, text, self.links, slot))
                if self.stream[-1:] != ["#"]:
                    self.stream.append("#")
        self.buffer, self.links = [], 0

    def _pop(self) -> None:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        if name in BLOCKS:
            self.stream.append(f"/{name}")

    def _open(self, name: str, rest: str) -> None:
        if name in ("br", "td", "th"):
            self.buffer.append(" ")
        if name in BLOCKS:
            self._flush()
        if name in VOID or (rest.endswith("/") and self.open["math"]):
            return
        if name in CLOSES_P and self.open["p"]:
            self._close("p", "")
        siblings = [x for x in SIBLINGS.get(name, ()) if self.open[x]]
        for k in range(len(self.stack) - 1, -1 if siblings else len(self.stack), -1):
            if self.stack[k][0] in siblings:
                self._close(self.stack[k][0], "")
                break
            if self.stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "select"):
                break
        found = {}
        if rest and ("=" in rest or "hidden" in rest):
            for key, a, b, c, hidden in ATTRIBUTE.findall(rest):
                found[(hidden or key).lower()] = a or b or c
        names, role = f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", "").lower()
        main = name in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
        if main:
            named = any(map(LEFT_OUT_ARTICLES.fullmatch, names.split()))
        elif self.stack and self.stack[-1][2]:
            named = any(map(LEFT_OUT_INSIDE.fullmatch, names.split()))
        else:
            named = name not in ("html", "body") and bool(names and LEFT_OUT_NAMES.search(names))
        up = self.stack[-1] if self.stack else NO_ELEMENT
        if main and (up[1] or up[5]) and not named:
            # an element left open before the article does not swallow it
            while self.stack and (self.stack[-1][1] or self.stack[-1][5]):
                self._pop()
            up = self.stack[-1] if self.stack else NO_ELEMENT
        rank = max(up[2], (2 if name == "article" or found.get("itemprop") == "articleBody" else 1) if main else 0)
        out = up[1] or name in LEFT_OUT_TAGS or role in LEFT_OUT_ROLES or "hidden" in found
        out = out or (name == "header" and rank < 2) or named or (name == "form" and rank > 0)
        out = out or bool(names and rank < 2 and not main and name not in ("html", "body") and OUTER_NAMES.search(names))
        form = up[5] or (name == "form" and not up[2])
        path, slot = up[3], up[4]
        deep = len(self.stack) >= DEEP
        if name in BLOCKS and not deep:
            slot = f"{slot}/{name}" + (f".{re.sub('[0-9]+', 'N', names.split()[0])}" if names else "")
        if name in ("body", "div", "section", "article", "main", "td") and not deep:
            path = f"{path}/{name}" + (f".{re.sub('[0-9]+', 'N', names.split()[0])}" if names else "")
        self.stack.append((name, out, rank, path, slot, form))
        self.open[name] += 1
        if name in BLOCKS:
            self.stream.append(name + (f".{re.sub('[0-9]+', 'N', names)}" if names else ""))

    def _close(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self._flush()
        if self.open[name]:
            while self.stack[-1][0] != name:
                self._pop()
            self._pop()

    def main_text(self, container: str | None, fixed: frozenset[str] = frozenset()) -> str:
        blocks = self.blocks or self.in_forms
        best = max((block[1] for block in blocks), default=0)
        kept = [x for x in blocks if x[1] == best] if best else None
        if kept is None and container:
            kept = [x for x in blocks if x[0] == container or x[0].startswith(f"{container}/")]
        return "\n".join(x[2] for x in kept or blocks if x[4] not in fixed)


# A wrapper is a list of nodes: a tag, "#" (a text slot), ["+", nodes] or ["?", nodes].
def fold(nodes: list) -> list:
    """Tandem repeats become one repeated group, shortest groups first; a repeat
    is as long as the way from one of its nodes to the next equal one."""
    size = 0
    while True:
        last: dict[str, int] = {}
        ways = set()
        for i, node in enumerate(nodes):
            key = node if isinstance(node, str) else json.dumps(node)
            ways.add(i - last.get(key, i))
            last[key] = i
        size = min((d for d in ways if size < d <= len(nodes) // 2), default=0)
        if not size:
            return nodes
        out, i = [], 0
        while i < len(nodes):
            group = nodes[i : i + size]
            if len(group) == size and nodes[i + size : i + 2 * size] == group:
                while nodes[i : i + size] == group:
                    i += size
                out.append(group[0] if size == 1 and isinstance(group[0], list) and group[0][0] == "+" else ["+", group])
            elif size == 1 or not (out and out[-1] == ["+", group]):
                out.append(nodes[i])
                i += 1
            else:
                i += size  # one more turn of the group before
        nodes = out


def _bare(node):
    """The node without its repeat or option mark, for alignment."""
    return json.dumps(node[1] if isinstance(node, list) else [node])


def align(left: list, right: list) -> list:
    """One wrapper that accepts what either accepts."""
    a, b = [_bare(x) for x in left], [_bare(x) for x in right]
    out: list = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(left[i:j], right[k:m]):
                if x == y:
                    out.append(x)
                else:  # the same group, once or repeated, sure or optional
                    marks = {n[0] for n in (x, y) if isinstance(n, list)}
                    body = next(n[1] for n in (x, y) if isinstance(n, list))
                    inner = [["+", body]] if "+" in marks else body
                    out.append(["?", inner] if "?" in marks else inner[0])
            continue
        for run in (left[i:j], right[k:m]):
            plain = [n for n in run if not (isinstance(n, list) and n[0] == "?")]
            if plain and plain == out[-len(plain) :]:
                out[-len(plain) :] = [["+", plain]]
            elif plain and out and out[-1] == ["+", plain]:
                continue
            elif len(plain) == len(run) and run:
                out.append(["?", run])
            else:
                out += [n if isinstance(n, list) and n[0] == "?" else ["?", [n]] for n in run]
    return fold(out)


def matches(wrapper: list, stream: list[str]) -> bool:
    """Whether the union-free expression accepts the stream."""

    def ends(nodes: list, starts: set[int]) -> set[int]:
        for node in nodes:
            if not starts:
                return starts
            if isinstance(node, str):
                starts = {s + 1 for s in starts if s < len(stream) and stream[s] == node}
            elif node[0] == "?":
                starts = starts | ends(node[1], starts)
            else:
                found: set[int] = set()
                fresh = ends(node[1], starts)
                while fresh - found:
                    fresh -= found
                    found |= fresh
                    fresh = ends(node[1], fresh)
                starts = found
        return starts

    return len(stream) in ends(wrapper, {0})


def infer(streams: list[list]) -> list:
    """The wrapper of several (folded) streams or partial wrappers."""
    wrapper = streams[0]
    for other in streams[1:]:
        if other != wrapper:
            wrapper = align(wrapper, other)
    return wrapper


def _host(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else ""


def _observe(pages: DataFrame) -> DataFrame:
    """(host, kind, key) with sums: kind w is a folded stream, kind c a container,
    kind s a text slot, kind l a page's longest block."""

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, str, str], list[int]] = {}
            for url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, page = _host(url), Page(text or "")
                seen = {("w", json.dumps(fold(page.stream))): [1, 0, 0, 0, 0]}
                blocks = page.blocks or page.in_forms
                if blocks:
                    longest = max((block[2] for block in blocks), key=lambda words: (len(words), words))
                    seen["l", xxhash.xxh3_64_hexdigest(longest)] = [1, 0, 0, 0, 0]
                for path, _, words, links, slot in blocks:
                    mark = xxhash.xxh3_64_intdigest(words) >> 1
                    for key in (("c", path), ("s", slot)):
                        own = seen.setdefault(key, [1, 0, 0, mark, mark])
                        own[1], own[2] = own[1] + len(words), own[2] + links
                        own[3], own[4] = min(own[3], mark), max(own[4], mark)
                for key, own in seen.items():
                    total = sums.setdefault((host, *key), [0, 0, 0, own[3], own[4]])
                    total[:3] = [x + y for x, y in zip(total[:3], own[:3])]
                    total[3:] = [min(total[3], own[3]), max(total[4], own[4])]
            names = ["host", "kind", "key", "pages", "chars", "links", "lo", "hi"]
            columns = list(zip(*((*k, *v) for k, v in sums.items()))) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(columns)], names=names)

    seen = pages.select("url", "html").mapInArrow(run, "host string, kind string, key string, pages long, chars long, links long, lo long, hi long")
    return seen.groupBy("host", "kind", "key").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON), main (its container of varying text) and fixed
    (its slots that always hold the same text)."""
    bound_batches(pages.sparkSession)
    seen = store(_observe(pages), "page-streams")

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("key").to_pylist(), group.column("pages").to_pylist()), key=lambda r: (-r[1], r[0]))
        found = json.dumps(infer([json.loads(k) for k, _ in rows]))
        return pa.table({"host": group.column("host")[:1], "key": [found], "pages": pa.array([sum(n for _, n in rows)], pa.int64())})

    whole = seen.where("kind = 'w'").select("host", "key", "pages")
    for parts in MERGES:  # a hot host's streams meet in steps
        salted = whole.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(parts)))
        whole = salted.groupBy("host", "salt").applyInArrow(merge, "host string, key string, pages long")
    score = F.when((F.col("lo") == F.col("hi")) & (F.col("pages") > 2), F.lit(0)).otherwise(F.col("chars") - 2 * F.col("links"))
    main = seen.where("kind = 'c'").groupBy("host").agg(F.max_by("key", F.struct(score.alias("s"), "key")).alias("main"))
    is_fixed = (F.col("lo") == F.col("hi")) & (F.col("pages") > 2)
    slots = seen.where("kind = 's'").groupBy("host").agg(
        F.collect_list(F.when(is_fixed, F.col("key"))).alias("fixed"), F.sum(F.when(is_fixed, F.col("chars")).otherwise(0)).alias("same"), F.sum("chars").alias("every")
    )
    # pages whose longest blocks are mostly the same are copies and say nothing about a template
    bodies = seen.where("kind = 'l'").groupBy("host").agg(F.count("*").alias("different"), F.sum("pages").alias("all"))
    varied = bodies.where((F.col("different") > 2) & (2 * F.col("different") >= F.col("all"))).select("host")
    fixed = slots.where(2 * F.col("same") < F.col("every")).join(varied, "host", "left_semi").select("host", "fixed")
    return store(whole.select("host", F.col("key").alias("wrapper")).join(main, "host", "left").join(fixed, "host", "left"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and matched."""
    bound_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    joined = pages.select("page_id", "url", "html", host.alias("host")).join(wrappers, "host", "left")

    def run(batches):
        known: dict[str, list] = {}
        for batch in batches:
            html = batch.column("html").to_pylist()
            wrapper, main, fixed = (batch.column(c).to_pylist() for c in ("wrapper", "main", "fixed"))
            for lo, hi in slices(html):
                texts, fits = [], []
                for i in range(lo, hi):
                    page = Page(html[i] or "")
                    texts.append(page.main_text(main[i], frozenset(fixed[i] or ())))
                    if wrapper[i] not in known:
                        if len(known) > 200:
                            known.clear()
                        known[wrapper[i]] = json.loads(wrapper[i] or "[]")
                    fits.append(matches(known[wrapper[i]], page.stream))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(lo, hi - lo), batch.column("url").slice(lo, hi - lo), pa.array(texts, pa.string()),
                     pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(fits, pa.bool_())],
                    names=["page_id", "url", "text", "n_chars", "matched"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "wrapper", "main", "fixed").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, matched boolean")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, infer_wrappers(pages))
