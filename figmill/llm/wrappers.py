"""HTML extraction with inferred wrappers.

The pages of one host are taken as printed by one template.  Their token streams are aligned one
after the other into a union-free regular expression over tags: where streams differ, text becomes
a slot, a run that comes again directly becomes a repeated group (+), and a run that one side lacks
an optional one (?).  Groups nest as the tags do, so the expression is kept as a tree.  A scan task
folds its pages into one expression a host, and a host's expressions are folded further after one
shuffle; a host with any share of the pages sends one expression a task.

The expression carries how much text, and how much of it in links, each slot has had over all
pages, and the text itself while all pages agree on it: where they don't, a text mismatch makes a
slot.  From it comes the host's rule: the path to the group that holds the article, the groups in
it that are menus, which of the groups that their class names call adverts, notices or comments are
so by the pages, and the template's own texts.  Each page is then read by its host's rule.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed, trimmed

RAW = r"<(script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|" + RAW + r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?][^>]*>", re.S | re.I)
WHOLE, QUOTED = re.compile(RAW, re.S | re.I), re.compile(r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)")
ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("article aside blockquote body details div dl fieldset figure footer form header main nav ol section table td th ul".split())
# What isn't the article, by tag, by role, and by the words of a class or id.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe button select input textarea svg canvas object embed dialog menu audio video label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header login masthead menu nav navbar navigation newsletter notice notification pagination pager popup promo promoted related responses share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
# Words that may stand beside those in a name without changing what it says.
BESIDE = frozenset("a area articles bar block body box btn button buttons by col column container content global group icon icons inner item items label large left link links list main media medium message middle module new news on outer page panel posts primary reader readers right row secondary section site slot small sticky the thread to top bottom unit user users wrap wrapper zone".split())
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "label", "drop", "soft", "kids")

    def __init__(self, tag: str, label: str, drop: bool, soft: int):
        self.tag, self.label, self.drop, self.soft, self.kids = tag, label, drop, soft, []


def named(value: str) -> int:
    """What a class or id says: 2 if all words of one of its names call the element a thing beside the article, 1 if one word does, else 0."""
    most = 0
    for name in value.split():
        words = [w.lower() for w in SPLIT.split(name) if w]
        if not WORDS.isdisjoint(words):
            most = max(most, 2 if all(w in WORDS or w in BESIDE for w in words) else 1)
    return most


def _opened(tag: str, attrs: str) -> Node:
    drop, soft, label = tag in DROPPED, 0, tag
    if attrs and not attrs.isspace():
        for name, a, b, c in ATTR.findall(attrs):
            value, name = a or b or c, name.lower()
            if name in ("class", "id"):
                own = named(value)
                if tag == "article":
                    words = {w.lower() for w in SPLIT.split(value)}
                    own = 0 if {"comment", "comments", "ad", "promo", "related"}.isdisjoint(words) else own
                soft = max(soft, own if tag not in ("html", "body", "main") else 0)
                label += ("." if name == "class" else "!") + "-".join(w.lower() for w in SPLIT.split(value) if w) if name == "class" or own or not any(c.isdigit() for c in value) else ""
            elif name == "role":
                drop = drop or value.lower() in ROLES
                label += "@main" if value.lower() == "main" else ""
            elif name == "hidden" or name == "aria-hidden":
                drop = drop or name == "hidden" or value.lower() == "true"
    return Node(tag, label, drop, soft)


DEPTH = 120


def tokens(text: str):
    """The matches of TOKEN in a page, in time linear in its length.

    A tag without an end is looked for to the page's end and then is no tag.  Where a later one begins outside the
    quotes of such a search, it would go the same way, so it isn't looked for again; a place has three states (outside, in
    one kind of quotes, in the other), and a quote changes them one to one, so there are three such searches at most.
    """
    last, searched = text.rfind(">"), []
    at = text.find("<")
    while 0 <= at:
        m = None
        if at > last:
            m = TOKEN.match(text, at) if text.startswith("<!--", at) else None
        elif any(bisect.bisect_right(begins, at) == bisect.bisect_right(ends, at) for begins, ends in searched) and text[at + 1 : at + 2] not in ("!", "?"):
            m = WHOLE.match(text, at)
            m = m and TOKEN.match(text, at)
        else:
            m = TOKEN.match(text, at)
            if m is None and re.match("/?[a-zA-Z]", text[at + 1 : at + 3]):
                spans = [q.span() for q in QUOTED.finditer(text, at)]
                searched.append(([a for a, _ in spans], [b for _, b in spans]))
        if m:
            yield m
        at = text.find("<", m.end() if m else at + 1)


def parse(text: str) -> Node:
    """The page's tags as a tree; texts are undecoded strings between them.  Never fails.

    Below DEPTH levels, elements stand beside each other instead of inside each other: texts and the breaks
    between blocks stay as they are.
    """
    root = Node("", "", False, 0)
    stack, at, flat = [root], 0, {}
    for m in tokens(text):
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if flat.get(tag):
                flat[tag] -= 1
                stack[-1].kids.append(Node(tag, tag, False, 0))
                continue
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    del stack[n:]
                    flat.clear()
                    break
                if stack[n].tag in HOLDS and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            _close(stack, ("p",))
        if tag in CLOSES:
            _close(stack, CLOSES[tag])
        node = _opened(tag, m.group(4))
        stack[-1].kids.append(node)
        if tag not in VOID and not (m.group(4) or "").endswith("/"):
            if len(stack) < DEPTH or node.drop:
                stack.append(node)
            else:
                flat[tag] = flat.get(tag, 0) + 1
    if at < len(text):
        stack[-1].kids.append(text[at:])
    return root


def _close(stack: list[Node], tags: tuple) -> None:
    for n in range(len(stack) - 1, 0, -1):
        if stack[n].tag in tags:
            del stack[n:]
            return
        if stack[n].tag in HOLDS and stack[n].tag not in tags:
            return


# An expression: [label, flag, pages, text, linked text, children, constant, soft]; flag: 0 once, 1 optional,
# 2 repeated, 3 both; constant: the text that all pages have there, None for a slot.
SLOT, GROUP = "#", "&"
LABEL, FLAG, PAGES, TEXT, LINKED, KIDS, CONSTANT, SOFT = range(8)
CONSTANT_CHARS = 200


def plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def expression(node: Node, linked: bool = False) -> list:
    linked = linked or node.tag == "a"
    kids: list[list] = []
    for k in node.kids:
        if isinstance(k, str):
            t = plain(k)
            if t:
                kids.append([SLOT, 0, 1, len(t), len(t) if linked else 0, [], t if len(t) <= CONSTANT_CHARS else None, 0])
        elif not k.drop:
            kids.append(expression(k, linked))
    return _over(node.label, folded(kids), node.soft)


def _over(label: str, kids: list, soft: int = 0) -> list:
    return [label, 0, 1, sum(k[TEXT] for k in kids), sum(k[LINKED] for k in kids), kids, None, soft]


def folded(items: list[list], most: int = 3) -> list[list]:
    """Runs of 1 to `most` items that come again directly become repeated groups."""
    for size in range(1, most + 1):
        out: list[list] = []
        labels: list[str] = []
        for item in items:
            out.append(item)
            labels.append(item[LABEL])
            if size == 1:
                if len(out) > 1 and labels[-1] == labels[-2]:
                    last = out.pop()
                    labels.pop()
                    out[-1] = aligned(out[-1], last, added=False)
                    out[-1][FLAG] |= 2
                continue
            run = labels[-size:]
            group = GROUP + " ".join(run)
            if len(out) > size and labels[-size - 1] == group and out[-size - 1][FLAG] & 2:
                last = _over(group, out[-size:])
                del out[-size:], labels[-size:]
                out[-1] = aligned(out[-1], last, added=False)
                out[-1][FLAG] |= 2
            elif len(out) >= 2 * size and labels[-2 * size : -size] == run and not any(x.startswith(GROUP) for x in run):
                one, two = _over(group, out[-2 * size : -size]), _over(group, out[-size:])
                del out[-2 * size :], labels[-2 * size :]
                out.append(aligned(one, two, added=False))
                out[-1][FLAG] |= 2
                labels.append(group)
        items = out
    return items


def aligned(a: list, b: list, added: bool = True) -> list:
    """One expression for what two of one label match.  added: they are of different pages."""
    pages = a[PAGES] + b[PAGES] if added else max(a[PAGES], b[PAGES])
    return [a[LABEL], a[FLAG] | b[FLAG], pages, a[TEXT] + b[TEXT], a[LINKED] + b[LINKED], _align(a[KIDS], b[KIDS], added), a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None, max(a[SOFT], b[SOFT])]


def matched(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal labels in order: the common ends, then those that stand once on both sides (the longest ascending run of them), then the next equal ones between."""
    first = 0
    while first < min(len(x), len(y)) and x[first] == y[first]:
        first += 1
    last = 0
    while last < min(len(x), len(y)) - first and x[-1 - last] == y[-1 - last]:
        last += 1
    out = [(i, i) for i in range(first)] + [(len(x) - k, len(y) - k) for k in range(1, last + 1)]
    xs, ys = Counter(x[first : len(x) - last]), Counter(y[first : len(y) - last])
    where = {v: j for j, v in enumerate(y[first : len(y) - last], first) if ys[v] == 1}
    once = [(i, where[v]) for i, v in enumerate(x[first : len(x) - last], first) if xs[v] == 1 and v in where]
    ends: list[int] = []
    before, tail = [], []
    for n, (_, j) in enumerate(once):
        k = bisect.bisect_left(ends, j)
        ends[k:k + 1] = [j]
        tail[k:k + 1] = [n]
        before.append(tail[k - 1] if k else -1)
    n, anchors = (tail[-1] if tail else -1), []
    while n >= 0:
        anchors.append(once[n])
        n = before[n]
    i0, j0 = first, first
    for i1, j1 in [*anchors[::-1], (len(x) - last, len(y) - last)]:
        places: dict[str, list[int]] = {}
        for j in range(j0, j1):
            places.setdefault(y[j], []).append(j)
        at = j0
        for i in range(i0, i1):
            own = places.get(x[i], ())
            k = bisect.bisect_left(own, at)
            if k < len(own):
                out.append((i, own[k]))
                at = own[k] + 1
        if i1 < len(x) - last:
            out.append((i1, j1))
        i0, j0 = i1 + 1, j1 + 1
    return sorted(out)


def _align(a: list[list], b: list[list], added: bool) -> list[list]:
    out, i, j = [], 0, 0
    for p, q in [*matched([k[LABEL] for k in a], [k[LABEL] for k in b]), (len(a), len(b))]:
        out += [[k[LABEL], k[FLAG] | 1, *k[PAGES:]] for k in [*a[i:p], *b[j:q]]]
        if p < len(a) and q < len(b):
            out.append(aligned(a[p], b[q], added))
        i, j = p + 1, q + 1
    return folded(out, 1)


def pattern(e: list) -> str:
    """The expression as text."""
    inner = " ".join(map(pattern, e[KIDS]))
    if e[LABEL] == SLOT:
        body = SLOT if e[CONSTANT] is None else json.dumps(e[CONSTANT], ensure_ascii=False)
    elif e[LABEL].startswith(GROUP):
        body = inner
    else:
        body = f"<{e[LABEL]}> {inner} </{e[LABEL].split('.')[0]}>" if inner else f"<{e[LABEL]}/>"
    return f"( {body} )" + ("", "?", "+", "*")[e[FLAG]] if e[FLAG] else body


AGREED = 3  # pages that have to agree on a text before it counts as the template's


def _tag(e: list) -> str:
    return re.split(r"[.!@]", e[LABEL])[0]


def _walk(e: list):
    """All elements and slots below e, groups taken as their members."""
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x[KIDS]))


def _parts(e: list) -> list[list]:
    """The children of an element, groups taken as their members."""
    return [y for x in e[KIDS] for y in (_parts(x) if x[LABEL].startswith(GROUP) else [x])]


def _template(e: list, pages: int) -> bool:
    """Most pages have these very texts there."""
    slots = [x for x in _walk(e) if x[LABEL] == SLOT]
    return pages >= AGREED and all(x[CONSTANT] is not None and x[PAGES] >= max(AGREED, 0.6 * pages) for x in slots)


def _aside(e: list, pages: int) -> bool:
    """It has no text, or the template's only, or is a list or division of nothing but links, without headings and paragraphs."""
    if not e[TEXT] or _template(e, pages):
        return True
    return e[TEXT] == e[LINKED] and _tag(e) in ("ul", "ol", "div", "section") and all(_tag(x) not in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6") for x in _walk(e))


def rule(e: list) -> dict:
    """What is read of a host's pages.

    path: labels from the page down to the article's group: article or main, or else the lowest group that
    holds all text but asides.  menus: labels of groups in it that aren't read: link groups, and groups whose
    names call them adverts and the like; where the name says so in part only, the pages have to agree (the same
    text on them, or links), and a group with over half of the article's text is read whatever its name.
    fixed: the template's texts, where no element marks the article; none if that is most of the text.
    """
    pages = e[PAGES]
    best, stack, found = None, [(e, [])], []
    while stack:
        x, path = stack.pop()
        rank = 2 if _tag(x) == "article" else 1 if _tag(x) == "main" or "@main" in x[LABEL] else 0
        if rank and not x[SOFT]:
            found.append((rank, x[TEXT], -len(path), path, x))
        stack.extend((k, [*path, k[LABEL]]) for k in reversed(_parts(x)) if not k[SOFT])
    marked = bool(found)
    if found:
        *_, path, top = max(found, key=lambda f: f[:3])
    else:
        path, top = [], e
        while True:
            kids = _parts(top)
            best = next((k for k in kids if k[LABEL] != SLOT and not k[SOFT] and k[TEXT] > k[LINKED] and all(k is x or x[SOFT] == 2 or _aside(x, pages) for x in kids)), None)
            if best is None or _tag(best) in ("p", "pre", "h1"):
                break
            path, top = [*path, best[LABEL]], best
    menus, texts = set(), set()
    stack = _parts(top)
    while stack:
        x = stack.pop()
        links = x[TEXT] and x[LINKED] >= 0.9 * x[TEXT]
        if x[SOFT] and 2 * x[TEXT] <= top[TEXT] and (x[SOFT] == 2 or links or _template(x, pages)):
            menus.add(x[LABEL])
        elif links and x[PAGES] >= AGREED and _tag(x) in ("ul", "ol", "div", "section"):
            menus.add(x[LABEL])
        else:
            if x[TEXT] and not links:
                texts.add(x[LABEL])  # a label counts as a menu only if no group of that label holds text
            stack.extend(_parts(x))
    fixed = [x for x in _walk(top) if not marked and x[LABEL] == SLOT and _template(x, pages)]
    if 2 * sum(x[TEXT] for x in fixed) > top[TEXT]:
        fixed = []
    return {"path": path, "menus": sorted(menus - texts), "fixed": sorted({x[CONSTANT] for x in fixed})}


def _tops(node: Node, path: list[str]) -> list[Node]:
    tops = [node]
    for label in path:
        tops = [k for t in tops for k in t.kids if not isinstance(k, str) and not k.drop and k.label == label]
    return tops


def read(text: str, by: dict | None) -> str:
    """The main text of a page."""
    page = parse(text)
    tops = _tops(page, by["path"]) if by else []
    if not tops:
        by = rule(expression(page))
        tops = _tops(page, by["path"]) or [page]
    menus, fixed = frozenset(by["menus"]), frozenset(by["fixed"])
    blocks: list[str] = []
    parts: list[str] = []

    def end():
        if parts:
            t = plain("".join(parts))
            if t:
                blocks.append(t)
            parts.clear()

    def walk(node):
        block = node.tag in BLOCK
        if block:
            end()
        for k in node.kids:
            if isinstance(k, str):
                if not fixed or plain(k) not in fixed:
                    parts.append(k)
            elif k.tag == "br":
                parts.append(" ")
            elif k.tag == "header":
                end()
                heads(k)
            elif not k.drop and k.label not in menus:
                walk(k)
        if block:
            end()

    def heads(node):
        for k in node.kids:
            if not isinstance(k, str):
                if k.tag in ("h1", "h2"):
                    walk(k)
                elif not k.drop and k.label not in menus:
                    heads(k)

    for t in tops:
        end()
        walk(t)
    end()
    return "\n".join(blocks)


def host(url: str = "url"):
    """The host that a column of urls names, in lower case; empty if none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _stored(e: list) -> bytes:
    return zlib.compress(json.dumps(e, separators=(",", ":")).encode(), 1)


HOSTS, SPREAD = 512, 64


def induce(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, rule): each host's expression and rule, as JSON.  Every page counts; null and empty pages match the empty expression.

    A task folds its pages into one expression a host; a host's expressions meet in SPREAD tasks first, then in one.
    """

    def rows(made: dict, at: int):
        return pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([at] * len(made), pa.int32()), pa.array([_stored(e) for e in made.values()], pa.binary())], ["host", "at", "body"])

    def local(parts):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() % SPREAD
        made: dict[str, list] = {}
        for batch in parts:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                e = expression(parse(text or ""))
                made[own] = aligned(made[own], e) if own in made else e
                if len(made) > HOSTS:
                    yield rows(made, at)
                    made = {}
        if made:
            yield rows(made, at)

    def whole(last: bool):
        def run(parts):
            key, e = None, None

            def done():
                if e is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([pattern(e)]), pa.array([json.dumps(rule(e))])], ["host", "wrapper", "rule"]) if last else rows({key[0]: e}, 0)

            for batch in parts:
                for own, at, body in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                    x = json.loads(zlib.decompress(body))
                    if (own, at) != key:
                        yield from done()
                        key, e = (own, at), x
                    else:
                        e = aligned(e, x)
            yield from done()

        return run

    schema = "host string, at int, body binary"
    one = df.select(host(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(trimmed(local), schema)
    some = one.repartition("host", "at").sortWithinPartitions("host", "at", F.xxhash64("body")).mapInArrow(trimmed(whole(False)), schema)
    return some.repartition("host").sortWithinPartitions("host", "at", F.xxhash64("body")).mapInArrow(trimmed(whole(True)), "host string, wrapper string, rule string")


SMALL_RULES = 8 << 20


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row, in the columns' own types.

    Text: the article's blocks, character references decoded, white space (any of Unicode's) turned into
    single spaces, joined by newlines; a line break counts as white space.  Null or empty html gives an empty
    text.  Pages without a host are one host; a page that its host's expression doesn't reach is read by an
    expression of its own.  Ids and urls may repeat or be null; other columns are not read.  The hosts' rules go
    to the pages as a broadcast if they are measured to be within SMALL_RULES bytes, so no page is shuffled; else pages
    and rules are joined by host.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rules = checkpointed(induce(pages).select("host", "rule"))
    size = rules.agg(F.sum(F.octet_length("rule") + F.octet_length("host") + 64)).first()[0] or 0
    both = pages.withColumn("host", host()).join(F.broadcast(rules) if size <= SMALL_RULES else rules, "host", "left")
    kind = dict(pages.dtypes)["page_id"]

    def run(parts):
        known: dict[str, dict] = {}
        for batch in parts:
            out = []
            for text, by in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if by is not None and by not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[by] = json.loads(by)
                out.append(read(text, known.get(by)) if text else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "rule").mapInArrow(trimmed(run), f"page_id {kind}, url string, text string, n_chars long")
