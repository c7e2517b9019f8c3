"""Main text of web pages by template deduction over the pages of a host.

Every page is read once, as tokens: the paths of its containers and its blocks of text with theirs. Tokens with the
same occurrence vector over the distinct pages of a host form an equivalence class; a vector is known by two
64-bit hashes over its pages and counts. The class that holds the page itself is the root of the host's template,
and the texts on more than half of its pages, however often on each, belong to it. Any other class of several tokens
is a part of the template where it is valid: its tokens stand in one order on all its pages, and all of them nest in
one and the same slot of the root (what lies between two neighbouring texts that are on all pages). Fixed texts
go on the pages that hold them; what is left in the slots is extracted. The deepest container that holds most of the
text of a host's pages is the slot of the article. A page with an article or main element says itself where its
article is; there only fixed texts go.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import join_hot, stage
from caseweave.llm.html_scan import BLOCK, VOID, attributes, events
from caseweave.llm.url_filter import url_parts

#: Elements that never hold article text (fixed values).
NEVER = {"nav", "aside", "footer", "form", "button", "select", "datalist", "template", "iframe", "svg", "canvas", "object", "dialog", "menu", "head", "search", "video", "audio", "noscript", "script", "style", "textarea", "title"}
#: Elements that can be a slot (fixed values).
CONTAINER = {"article", "body", "center", "dd", "details", "div", "fieldset", "figure", "main", "section", "table", "td", "tr", "tbody", "li", "ul", "ol", "span"}
#: Elements of text: what stands in the line of one is judged by no name, nor are headings (fixed values).
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
LINE = HEADING | {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "summary"}
#: Words of class and role that may name what is no article (fixed values).
BOILERPLATE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "discussion",
    "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "notification", "overlay", "pager", "pagination", "paywall", "popup", "privacy", "promo", "promoted", "promotion", "recommendations", "recommended",
    "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "widget", "widgets",
}
#: Words that name what readers wrote below an article; an element so named goes whatever its size if it leaves text behind (fixed values).
READERS = {"comment", "comments", "disqus"}
#: Words that an id may have too, as they are seldom words of a title (fixed values).
FRAME = {"breadcrumb", "breadcrumbs", "comments", "contentinfo", "cookies", "disqus", "footer", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "respond", "sidebar", "toolbar"}
#: Words that name an article where they come last in a name (fixed values).
STORY = {"article", "entry", "post", "story"}
#: Words for a part of a page, after which a name counts by its first word (fixed values).
HOLDERS = {"area", "articles", "bar", "block", "body", "box", "button", "buttons", "container", "content", "group", "holder", "icons", "inner", "item", "items", "link", "links", "list", "news", "outer", "panel", "posts", "region", "row", "section", "slot", "stories", "text", "thread", "top", "bottom", "unit", "wrap", "wrapper", "zone"}
#: Words before which a name tells a property, not a part (fixed values).
PROPERTY = {"no", "not", "has", "have", "is", "with", "without", "show", "hide", "open", "closed", "enable", "disable"}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARSED = "page_id long, url string, host string, content long, said boolean, size long, blocks array<struct<text:string,token:long>>, slots array<struct<token:long,n:int,size:long,depth:int,first:int,last:int>>"
#: Tokens of a class, containers included, from which on it is a part of the template on fewer pages too (fixed value).
LEAST_CLASS = 3


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def named(names: str, known: set[str] = BOILERPLATE | READERS) -> str:
    """What class and role say of an element: "readers", "other" (what is no article either) or nothing.

    A name counts by its last word, or by its first if only words for parts of a page follow; one that begins with a word
    for a property counts for nothing, and one that ends in a word for an article outweighs the others.
    """
    said = ""
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or len(words) > 1 and words[0] in PROPERTY:
            continue
        if words[-1] in STORY:
            return ""
        word = words[-1] if words[-1] in known else words[0] if HOLDERS.issuperset(words[1:]) else ""
        if word in READERS and word in known:
            said = "readers"
        elif word in known:
            said = said or "other"
    return said


def slug(text: str) -> str:
    """The letters and digits of a text, to tell whether an id was made of a title."""
    return re.sub(r"[\W_]+", "", text.lower())


class Page:
    """The blocks of a page that may be article text, read in time linear in its length.

    blocks: (text, token). said: whether the page says where its article is; then only its blocks are kept.
    slots: for each path of a container how often it occurs, the text under it, its depth, and the blocks
    (first, last) that it spans. own: the slot that holds the article judged by this page alone, as (first, last).
    """

    def __init__(self, html: str | None):
        #: Of each element: its parent, name, path, depth in containers, what its name says, whether it holds no article, and the element to ask for its texts.
        self.parent, self.name, self.path, self.depth, self.word, self.bad, self.asks = [-1], [""], [_hash("")], [0], [""], [False], [0]
        self.inner = [False]  # whether it is or is in an article or main element
        self.line = [False]  # whether it is an element of text or in the line of one
        self.says = []  # (rank, node) of elements that hold the article
        self.ids: list[tuple[int, str]] = []  # (node, id) of elements whose id may say something, or was made of a title
        found: list[tuple[str, int]] = []
        self._read(html or "", found)
        self._weigh(found)
        roots = self._roots()
        above = set(roots)
        for k in roots:
            while (k := self.parent[k]) >= 0 and k not in above:
                above.add(k)
        n = len(self.parent)
        gone, inside = [False] * n, [False] * n
        for k, up in enumerate(self.parent):
            gone[k] = up >= 0 and gone[up] or self.bad[k] and k not in above
            inside[k] = k in roots or up >= 0 and inside[up]
        self.said = 0 not in roots
        kept = [(text, node) for text, node in found if inside[node] and not gone[node]]
        self.blocks = [(text, _hash(self.path[node], text)) for text, node in kept]
        self.content = _hash(*(b[0] for b in self.blocks))
        self.total = sum(len(b[0]) for b in self.blocks)
        self.slots = {} if self.said else self._slots(kept)
        fit = [(depth, size, path) for path, (times, size, depth, *_) in self.slots.items() if times == 1 and 2 * size >= self.total]
        self.own = self.slots[max(fit)[2]][3:] if fit else None

    def _read(self, html: str, found: list) -> None:
        stack, text, begun = [0], [], False

        def flush():
            nonlocal begun
            begun = False
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                found.append((line, stack[-1]))

        for kind, *x in events(html):
            if kind == "text":
                k = self.asks[stack[-1]]
                if not self.bad[k] or self.name[k] in BLOCK:
                    text.append(x[0])
                    begun = begun or not x[0].isspace()
            elif kind == "raw":
                continue
            elif x[0] == "br":
                text.append(" ")
            elif kind == "start":
                if x[0] in BLOCK:
                    flush()
                if x[0] not in VOID:
                    stack.append(self._open(stack[-1], x[0], x[1], begun))
            else:
                if x[0] in BLOCK:
                    flush()
                if len(stack) > 1:
                    stack.pop()
        flush()

    def _open(self, up: int, name: str, raw: str, begun: bool) -> int:
        """A new element in `up`; `begun` says whether its line has text already, of which it is a part then, whatever its name."""
        node = len(self.parent)
        given = attributes(raw) if raw.strip() else {}
        names = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}"
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(HIDING.search(given.get("style", "")))
        inner = self.inner[up]  # the header of an article is part of it
        role = given.get("role", "").lower()
        rank = 3 if name == "article" or given.get("itemprop", "").lower() == "articlebody" else 2 if role == "article" else 1 if name == "main" or role == "main" else 0
        judged = f"{given.get('class', '')} {given.get('role', '')}"
        quiet = name in ("html", "body", "main") or name in HEADING or name not in BLOCK and (begun or self.line[up])
        word = "" if quiet or not judged.strip() else named(judged if not inner else re.sub("header", "", judged, flags=re.I))
        if given.get("id") and name in BLOCK and not quiet:
            self.ids.append((node, given["id"]))
        self.parent.append(up)
        self.name.append(name)
        self.path.append(_hash(self.path[up], name, re.sub(r"\d+", "0", names)) if name in CONTAINER else self.path[up])
        self.depth.append(self.depth[up] + (name in CONTAINER))
        self.word.append(word if name in BLOCK else "")
        self.bad.append(name in NEVER or name == "header" and not inner or hidden or bool(word) and name not in BLOCK)
        self.line.append(name in LINE or name not in BLOCK and self.line[up])
        self.inner.append(inner or name in ("article", "main"))
        self.asks.append(node if name in BLOCK or self.bad[-1] else self.asks[up])
        if rank:
            self.says.append((rank, node))
        return node

    def _weigh(self, found: list) -> None:
        """The text under each element that is not under one without article text. Elements whose name alone speaks against them go, unless they hold over half of it; those for reader comments unless nothing but headings is left without them."""
        n = len(self.parent)
        own, plain, title = [0] * n, [0] * n, [""] * n
        for text, node in found:
            own[node] += len(text)
            if self.name[node] in HEADING:
                title[node] = title[node] or text
            else:
                plain[node] += len(text)
        self._judge_ids(title)

        def sizes(counted: list[int]) -> list[int]:
            out, gone = [0] * n, [False] * n
            for k in range(1, n):
                gone[k] = gone[self.parent[k]] or self.bad[k]
            for k in range(n - 1, -1, -1):
                if not gone[k]:
                    out[k] += counted[k]
                    if k:
                        out[self.parent[k]] += out[k]
            return out

        readers = [k for k in range(n) if self.word[k] == "readers"]
        if readers:
            before = list(self.bad)
            for k in readers:
                self.bad[k] = True
            if not sizes(plain)[0]:
                self.bad = before
        self.size = sizes(own)
        weak = [k for k in range(n) if self.word[k] == "other" and 2 * self.size[k] <= self.size[0]]
        for k in weak:
            self.bad[k] = True
        if weak:
            self.size = sizes(own)
        self.under = [False] * n  # whether it is in an element without article text
        for k in range(1, n):
            self.under[k] = self.under[self.parent[k]] or self.bad[k]

    def _judge_ids(self, title: list[str]) -> None:
        """Let ids of words for a page's frame count as names, unless two and more ids of the page were made of the titles in their elements."""
        if not self.ids:
            return
        first = list(title)  # the first heading under each element
        for k in range(len(first) - 1, 0, -1):
            first[self.parent[k]] = first[k] or first[self.parent[k]]
        made = {slug(x) for k, x in self.ids if first[k] and slug(x) == slug(first[k])}
        if len(made) > 1:
            return
        for k, x in self.ids:
            self.word[k] = self.word[k] or named(x, FRAME)

    def _roots(self) -> set[int]:
        """The elements that say they are the article; the page itself if there are none.

        Elements of one kind with the same parent or path are one candidate, as they hold a story together. Of
        those with half the text of the largest or more it is the best kind, then the most text, then the first.
        """
        kind = {node: rank for rank, node in self.says if self.size[node] and not self.under[node]}
        held: list[int] = [0]  # of each element, the kinds of the elements around it, as bits
        for k in range(1, len(self.parent)):
            held.append(held[self.parent[k]] | (1 << kind.get(self.parent[k], 0)))
        groups: dict[tuple, list[int]] = {}
        for k in kind:
            if not held[k] >> kind[k] & 1:
                groups.setdefault((kind[k], "parent", self.parent[k]), []).append(k)
                groups.setdefault((kind[k], "path", self.path[k]), []).append(k)
        fit = [(sum(self.size[k] for k in nodes), rank, -nodes[0], nodes) for (rank, *_), nodes in groups.items()]
        most = max((x[0] for x in fit), default=0)
        best = max((x for x in fit if 2 * x[0] >= most), key=lambda x: (x[1], x[0], x[2]), default=None)
        return set(best[3]) if best else {0}

    def _slots(self, kept: list[tuple[str, int]]) -> dict[int, tuple]:
        n = len(self.parent)
        first, last = [len(kept)] * n, [-1] * n
        for j, (_, node) in enumerate(kept):
            first[node], last[node] = min(first[node], j), j
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            first[up], last[up] = min(first[up], first[k]), max(last[up], last[k])
        out: dict[int, tuple] = {}
        for k in range(1, n):
            if self.name[k] in CONTAINER and self.size[k] and last[k] >= 0:
                times, size, depth, a, b = out.get(self.path[k], (0, 0, self.depth[k], first[k], last[k]))
                out[self.path[k]] = (times + 1, size + self.size[k], depth, min(a, first[k]), max(b, last[k]))
        return out


def _hosted(pages: DataFrame) -> DataFrame:
    host, _ = url_parts(F.col("url").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))


def parsed_pages(hosted: DataFrame) -> DataFrame:
    """page_id, url, host, content (a hash of the texts), said, size, blocks and slots of each page; own_first and own_last, the blocks of its own slot. Written to the shared folder."""

    def read(batches):
        import pyarrow as pa

        block = pa.list_(pa.struct([("text", pa.string()), ("token", pa.int64())]))
        slot = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("size", pa.int64()), ("depth", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            pages = [Page(x) for x in batch.column("html").to_pylist()]
            columns = [
                pa.array([p.content for p in pages], pa.int64()),
                pa.array([p.said for p in pages], pa.bool_()),
                pa.array([p.total for p in pages], pa.int64()),
                pa.array([[{"text": t.encode("utf-8", "replace").decode(), "token": k} for t, k in p.blocks] for p in pages], block),
                pa.array([[dict(zip(("token", "n", "size", "depth", "first", "last"), (path, *x), strict=True)) for path, x in p.slots.items()] for p in pages], slot),
                pa.array([p.own and p.own[0] for p in pages], pa.int32()),
                pa.array([p.own and p.own[1] for p in pages], pa.int32()),
            ]
            names = ["page_id", "url", "host", "content", "said", "size", "blocks", "slots", "own_first", "own_last"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:3]), *columns], names=names)

    return stage(hosted.mapInArrow(read, PARSED + ", own_first int, own_last int"), "pages")


def _nested(batches):
    """For each class on a page (its list of pos, token, cls, pages, root): the order of its tokens and its slot in the root (0), where it is in one, and in the nearest class around it, if there is one."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for host, marks in zip(batch.column("host").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            places: dict[int, list[int]] = {}
            tokens: dict[int, list[int]] = {}
            root = sorted(m["pos"] for m in marks if m["root"])
            for m in sorted(marks, key=lambda m: (m["pos"], m["token"])):
                places.setdefault(m["cls"], []).append(m["pos"])
                tokens.setdefault(m["cls"], []).append(m["token"])
            around: list[int] = []  # the classes that are open here, the innermost last
            for c, at in sorted(places.items(), key=lambda x: (x[1][0], -x[1][-1])):
                while around and places[around[-1]][-1] < at[0]:
                    around.pop()
                for up, bounds in ((0, root), *((k, places[k]) for k in around[-1:])):
                    a, b = bisect_left(bounds, at[0]), bisect_left(bounds, at[-1])
                    if a == b:
                        rows.append((host, c, _hash(*tokens[c]), up, a))
                if not around or at[-1] < places[around[-1]][-1]:
                    around.append(c)
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3, pa.int32()), strict=True)], names=["host", "cls", "order", "up", "slot"])


def valid_classes(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """host, cls, up (the class that holds it; 0 is the root) and slot of the valid classes, among classes (host, cls, pages), by the marks of distinct pages.

    Valid: on all its pages its tokens have one order and lie in one slot of the root. The nearest class around it on
    all these pages may hold it too.
    """
    edges = marks.mapInArrow(_nested, "host string, cls long, order long, up long, slot int")
    edges = edges.groupBy("host", "cls", "up", "slot", "order").agg(F.count("*").alias("_seen"))
    good = edges.join(classes.select("host", "cls", "pages"), ["host", "cls"]).where(F.col("_seen") == F.col("pages"))
    ups = classes.select("host", F.col("cls").alias("up"), F.col("pages").alias("_up_pages"))
    good = good.join(ups, ["host", "up"], "left")
    nearest = F.min_by(F.struct("up", "slot"), F.struct(F.col("up") == 0, "_up_pages", "up"))
    found = good.groupBy("host", "cls").agg(nearest.alias("_n"), F.max(F.col("up") == 0).alias("_rooted"))
    return found.where("_rooted").select("host", "cls", "_n.up", "_n.slot")


def templates(parsed: DataFrame, least_pages: int = 5) -> tuple[DataFrame, DataFrame]:
    """host, token and pages of the fixed texts; host and main, the slot of the article, for hosts whose pages don't say it.

    Pages with the same texts count once. Fixed texts need `least_pages` distinct pages.
    """
    lean = F.transform("slots", lambda s: F.struct(s["token"].alias("token"), s["n"].alias("n"), s["size"].alias("size"), s["depth"].alias("depth")))
    ids = parsed.select("host", "content", "said", "size", F.col("blocks.token").alias("tokens"), lean.alias("slots"))  # the texts stay where they are
    distinct = ids.dropDuplicates(["host", "content"])
    texts = distinct.select("host", "content", F.posexplode("tokens").alias("pos", "token"))
    texts = texts.groupBy("host", "content", "token").agg(F.count("*").cast("int").alias("n"), F.min("pos").alias("pos"))
    slots = distinct.where(~F.col("said")).select("host", F.explode("slots").alias("_s")).select("host", "_s.*")
    whole = distinct.groupBy("host").agg(F.count("*").alias("all"), F.count(F.when(~F.col("said"), 1)).alias("plain"), F.sum(F.when(~F.col("said"), F.col("size"))).alias("plain_size"))
    whole = stage(whole, "hosts")

    vector = [F.bit_xor(F.xxhash64("content", "n")), F.bit_xor(F.xxhash64("n", "content"))]
    counted = texts.groupBy("host", "token").agg(F.count("*").alias("pages"), F.xxhash64(*vector, F.count("*")).alias("cls"))
    counted = counted.where(F.col("pages") >= least_pages).join(whole.select("host", "all"), "host").withColumn("sure", 2 * F.col("pages") > F.col("all"))
    held = distinct.where(~F.col("said")).select("host", "content", F.explode("slots").alias("_s")).select("host", "content", "_s.token", "_s.n")
    held = held.groupBy("host", "token").agg(F.count("*").alias("pages"), F.xxhash64(*vector, F.count("*")).alias("cls"))
    sizes = counted.select("host", "cls").unionByName(held.select("host", "cls")).groupBy("host", "cls").agg(F.count("*").alias("tokens"))
    counted = stage(counted.join(sizes, ["host", "cls"]).where(F.col("sure") | (F.col("tokens") >= LEAST_CLASS)), "classes")

    named = counted.select(F.struct("host", "token").alias("_key"), "cls", "pages", (F.col("pages") == F.col("all")).alias("root"))
    keyed = texts.select("host", "content", "pos", "token", F.struct("host", "token").alias("_key"))
    found = join_hot(keyed, named, "_key", F.col("pages"), max(1000, parsed.count() // 1000)).where(F.col("cls").isNotNull())
    marks = found.groupBy("host", "content").agg(F.collect_list(F.struct("pos", "token", "cls", "pages", "root")).alias("marks"))
    valid = valid_classes(marks.select("host", "marks"), counted.select("host", "cls", "pages").distinct()).select("host", "cls", F.lit(True).alias("_valid"))
    fixed = counted.join(valid, ["host", "cls"], "left").where(F.col("sure") | F.col("_valid")).select("host", "token", "pages")

    once = slots.groupBy("host", "token").agg(F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("size").alias("size"), F.max("depth").alias("depth")).where(F.col("most") == 1).join(whole, "host")
    once = once.where((2 * F.col("pages") >= F.col("plain")) & (2 * F.col("size") >= F.col("plain_size")))
    main = once.groupBy("host").agg(F.max_by("token", F.struct("depth", "size", "token")).alias("main"))
    return stage(fixed, "fixed"), stage(main, "main")


def article(blocks: list[dict], slots: list[dict], own: tuple[int | None, int | None], fixed, main: int | None) -> str:
    """The text of the article: the blocks in its slot, without the template's texts unless these are most of it (then the page is a copy of others, not a template)."""
    spans = [(s["first"], s["last"]) for s in slots if s["token"] == main]
    first, last = spans[0] if spans else own
    inside = blocks if first is None else blocks[first : last + 1]
    kept = [b for b in inside if b["token"] not in fixed]
    if 2 * sum(len(b["text"]) for b in kept) < sum(len(b["text"]) for b in inside):
        kept = inside
    return "\n".join(b["text"] for b in kept)


def main_text(pages: DataFrame, least_pages: int = 5, most_broadcast: int = 1_000_000) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html; other columns are ignored).

    Null or empty html gives an empty text. Pages without a host share the empty one. Repeated rows give
    repeated rows. White space inside a block is one space, blocks are joined by a line feed. Long and deeply nested
    pages take time in proportion to their length. The templates are broadcast if they have at most `most_broadcast`
    texts and hosts in all; else pages meet them by their texts, and those with copies on a thousandth of all pages
    by a broadcast.
    """
    parsed = parsed_pages(_hosted(pages))
    fixed, mains = templates(parsed, least_pages)
    spark = pages.sparkSession
    if fixed.count() + mains.count() <= most_broadcast:
        held: dict[str, set[int]] = {}
        for r in fixed.select("host", "token").collect():
            held.setdefault(r["host"], set()).add(r["token"])
        shared = spark.sparkContext.broadcast((held, {r["host"]: r["main"] for r in mains.collect()}))
        joined = parsed
    else:
        shared = None
        hot = max(1000, parsed.count() // 1000)
        flat = parsed.select("host", "content", F.explode("blocks.token").alias("token")).distinct()
        flat = flat.select(F.struct("host", "content").alias("_page"), F.struct("host", "token").alias("_key"), "token")
        gone = join_hot(flat, fixed.select(F.struct("host", "token").alias("_key"), "pages"), "_key", F.col("pages"), hot).where(F.col("pages").isNotNull())
        gone = gone.groupBy("_page").agg(F.collect_list("token").alias("fixed"))
        copies = parsed.groupBy(F.struct("host", "content").alias("_page")).agg(F.count("*").alias("copies"))
        joined = join_hot(parsed.withColumn("_page", F.struct("host", "content")), copies.join(gone, "_page"), "_page", F.col("copies"), hot).drop("_page", "copies")
        joined = join_hot(joined, parsed.groupBy("host").agg(F.count("*").alias("pages")).join(mains, "host"), "host", F.col("pages"), hot)

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            texts = []
            for r in rows:
                fixed, main = (shared.value[0].get(r["host"], ()), shared.value[1].get(r["host"])) if shared else (set(r["fixed"] or ()), r["main"])
                texts.append(article(r["blocks"], r["slots"], (r["own_first"], r["own_last"]), fixed, main))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    names = ["page_id", "url", "host", "blocks", "slots", "own_first", "own_last", *(["fixed", "main"] if not shared else [])]
    return joined.select(*names).mapInArrow(extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
