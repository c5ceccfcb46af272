"""Items of HTML pages by declared places: what a field is, is said by element, class and attribute, and one pass over a page gives nested rows.

A place is a chain of steps from the outside in, each `tag`, `.class`, `#id`, `[attribute]`
or several of them together; alternatives are parted by commas.  Elements that a browser
would close (cells, rows, list items, paragraphs) are closed; end tags of nothing are passed over.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from itertools import accumulate, chain
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from .batches import slices

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag closes, and where the look for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "thead", "tbody"}, {"table"}),
    "p": ({"p"}, {"div", "td", "th", "li", "body", "section", "article"}),
    "option": ({"option"}, {"select"}),
}


@dataclass(frozen=True)
class Pick:
    """Text (or an attribute) of the first, last or of all elements at a place below the item; "" is the item itself.

    own: only text that stands directly in the element.  outside: not inside such an element of the item.
    mark: a `^` leads the text of such elements (`sup`).  Text keeps line breaks of <br>; a blank text and a missing element or attribute are null (with all: left out).
    """

    at: str = ""
    attr: str | None = None
    which: str = "first"
    own: bool = False
    outside: str = ""
    mark: str = ""


@dataclass(frozen=True)
class Items:
    """An array of structs, one for each element at a place ("" is the item itself), in document order."""

    at: str
    fields: dict = field(default_factory=dict)
    outside: str = ""


class _Node:
    """An element; those below it have the numbers between its own and `end`."""

    __slots__ = ("tag", "attrs", "classes", "parent", "children", "no", "end")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None, no: int) -> None:
        self.tag, self.attrs, self.parent, self.children, self.no, self.end = tag, attrs, parent, [], no, no + 1
        self.classes = frozenset(attrs["class"].split()) if "class" in attrs else _NONE


_NONE: frozenset = frozenset()
_OPEN: tuple = ((), ())
#: Plain markup: an opening tag with plain attributes, an end tag, text.  Whatever else a page has is left to the parser.
_TAG = r"""<([A-Za-z][A-Za-z0-9-]*)((?:\s+[A-Za-z][\w-]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`/]+(?=[\s>])))?)*)\s*(/?)>|</([A-Za-z][A-Za-z0-9-]*)>"""
_PLAIN = re.compile(rf"({_TAG}|[^<]+)", re.ASCII)
_PLAIN_TAG = re.compile(_TAG, re.ASCII)
_BETWEEN = re.compile("(<[^>]*>)")
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`/]+)))?""", re.ASCII)
#: Elements whose content is no markup.
_RAW = re.compile(r"<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)\b", re.IGNORECASE)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None, 0)
        self.nodes = [self.root]

    def read(self, html: str) -> None:
        """As feed() and close(), at once where all of the page is plain markup."""
        plain = [] if _RAW.search(html) else _PLAIN.findall(html)
        if sum(len(m[0]) for m in plain) < len(html):
            self.feed(html)
            self.close()
        else:
            for text, tag, attrs, closed, ended in plain:
                if tag:
                    found = [(k.lower(), unescape(v1 or v2 or v3)) for k, v1, v2, v3 in _ATTRIBUTE.findall(attrs)] if attrs else ()
                    (self.handle_startendtag if closed else self.handle_starttag)(tag.lower(), found)
                elif ended:
                    self.handle_endtag(ended.lower())
                else:
                    self.handle_data(unescape(text) if "&" in text else text)
        for node in reversed(self.nodes):
            if node.parent is not None and node.end > node.parent.end:
                node.parent.end = node.end
        # numbers of the elements by tag, by id and by class, ascending
        self.places: dict[tuple[str, str], list[int]] = {}
        for node in self.nodes[1:]:
            self.places.setdefault(("", node.tag), []).append(node.no)
            if "id" in node.attrs:
                self.places.setdefault(("#", node.attrs["id"]), []).append(node.no)
            for c in node.classes:
                self.places.setdefault((".", c), []).append(node.no)

    def handle_starttag(self, tag, attrs):
        ends, bounds = CLOSES.get(tag, _OPEN)
        node = self.at
        while ends and node.parent is not None and node.tag not in bounds:
            if node.tag in ends:
                self.at = node.parent
            node = node.parent
        made = _Node(tag, {k: v or "" for k, v in attrs}, self.at, len(self.nodes))
        self.nodes.append(made)
        self.at.children.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


@lru_cache(maxsize=1024)
def _chains(place: str) -> tuple:
    """Alternatives of a place, each a tuple of (tag, id, classes, attributes)."""
    out = []
    for one in place.split(","):
        steps = []
        for step in one.split():
            tag = re.match(r"[A-Za-z][\w-]*", step)
            steps.append((tag[0] if tag else "", "".join(re.findall(r"#([\w-]+)", step)), frozenset(re.findall(r"\.([\w-]+)", step)), tuple(re.findall(r"\[([\w-]+)\]", step))))
        if steps:
            out.append(tuple(steps))
    return tuple(out)


def _fits(node: _Node, step: tuple) -> bool:
    tag, own_id, classes, attrs = step
    if (tag and node.tag != tag) or (own_id and node.attrs.get("id") != own_id) or not classes <= node.classes:
        return False
    return not attrs or all(a in node.attrs for a in attrs)


def _is_at(node: _Node, chains: tuple, top: _Node) -> bool:
    for steps in chains:
        if not _fits(node, steps[-1]):
            continue
        left, up = len(steps) - 1, node.parent
        while left and up is not None and up is not top:
            left -= _fits(up, steps[left - 1])
            up = up.parent
        if not left:
            return True
    return False


def _found(top: _Node, tree: _Tree, at: str, outside: str, first: bool = False) -> list[_Node]:
    """Elements of a place below `top` in document order, or only the first of them."""
    if not at:
        return [top]
    chains, apart = _chains(at), _chains(outside)
    numbers: list[int] = []
    for steps in chains:
        tag, own_id, classes, _ = steps[-1]
        key = ("#", own_id) if own_id else (".", next(iter(classes))) if classes else ("", tag) if tag else None
        all_of = range(len(tree.nodes)) if key is None else tree.places.get(key, ())
        numbers += all_of[bisect_right(all_of, top.no) : bisect_left(all_of, top.end)]
    out = []
    for no in sorted(set(numbers)) if len(chains) > 1 else numbers:
        node = tree.nodes[no]
        if _is_at(node, chains, top):
            up = node
            while apart and up is not top and not _is_at(up, apart, top):
                up = up.parent
            if not apart or up is top:
                out.append(node)
                if first:
                    break
    return out


def _tidy(text: str) -> str | None:
    if "\xa0" in text:
        text = text.replace("\xa0", " ")
    return (re.sub(r"[ \t]+\n", "\n", text) if "\n" in text else text).strip() or None


def _text(top: _Node, own: bool, mark: str) -> str | None:
    out, stack = [], list(reversed(top.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif not own and x.tag not in ("script", "style"):
            stack += reversed(["^", *x.children] if x.tag == mark else x.children)
    return _tidy("".join(out))


def _values(top: _Node, tree: _Tree, items: Items) -> list[dict]:
    rows = []
    for node in _found(top, tree, items.at, items.outside):
        row = {}
        for name, f in items.fields.items():
            if isinstance(f, Items):
                row[name] = _values(node, tree, f)
                continue
            take = lambda n, f=f: (n.attrs.get(f.attr) or None) if f.attr else _text(n, f.own, f.mark)
            places = _found(node, tree, f.at, f.outside, f.which == "first")
            if f.which == "all":
                row[name] = [v for v in map(take, places) if v is not None]
            else:
                row[name] = take(places[-1]) if places else None
        rows.append(row)
    return rows


def tree_items(html: str | None, items: Items) -> list[dict]:
    """The items of any page, by its tree."""
    tree = _Tree()
    tree.read(html or "")
    return _values(tree.root, tree, items)


class _Want:
    """A field (or the items themselves) as a page is read: how far its place and what it is not inside are met below an item is kept by the reader."""

    def __init__(self, f: Pick | Items) -> None:
        self.f, self.place, self.apart = f, _chains(f.at), _chains(f.outside)
        self.start = ((0,) * len(self.place), (0,) * len(self.apart), False)
        self.wants = [_Want(x) for x in f.fields.values()] if isinstance(f, Items) else []
        self.starts = tuple(w.start for w in self.wants)
        self.many = [isinstance(w.f, Items) or w.f.which == "all" for w in self.wants]


class _State:
    """Items that are open around a place of a page, each with what is met of its fields' places; the states that tags lead to are found once."""

    __slots__ = ("open", "next")

    def __init__(self, open_items: tuple) -> None:
        self.open, self.next = open_items, {}


def _all_met(shape: tuple, chains: tuple, met: tuple) -> bool:
    return any(n == len(steps) - 1 and _shape_fits(shape, steps[-1]) for steps, n in zip(chains, met))


def _further(shape: tuple, chains: tuple, met: tuple) -> tuple:
    return tuple(n + (n < len(steps) - 1 and _shape_fits(shape, steps[n])) for steps, n in zip(chains, met))


def _shape_fits(shape: tuple, step: tuple) -> bool:
    tag, own_id, classes, attrs = step
    return (not tag or shape[0] == tag) and (not own_id or shape[1] == own_id) and classes <= shape[2] and all(a in shape[3] for a in attrs)


class Reader:
    """Items of pages of plain markup in one pass over their tags, without a tree.

    Pages repeat their layout: what a tag does where certain items are open is worked out once, and so is what the tags of a whole page do.
    """

    #: States, tags and layouts (of whole pages) that are kept at most, the longest tag and layout that is kept, and the items that may be open around a place.
    STATES, TAGS, LAYOUTS, LONGEST, NESTED = 2000, 10_000, 200, 400, 24

    def __init__(self, items: Items) -> None:
        self.items, self.want = items, _Want(Items("", {"items": items}))
        self.tags: dict[str, tuple | None] = {}
        self._places(self.want, known := ([], [], [], []), marks := set())
        self.known, self.marks = tuple(frozenset(k) for k in known), frozenset(marks)
        self.shapes: list[tuple] = []  # what the places can tell of elements; tags have their numbers
        self.shape_numbers: dict[tuple, int] = {}
        self.numbers: dict = {}  # of all that a layout tells of a tag
        self._restart()

    def _places(self, want: _Want, known: tuple, marks: set) -> None:
        for steps in chain(want.place, want.apart):
            for tag, own_id, classes, attrs in steps:
                known[0].append(tag), known[1].append(own_id), known[2].extend(classes), known[3].extend(attrs)
        if isinstance(want.f, Pick) and want.f.mark:
            marks.add(want.f.mark)
        for w in want.wants:
            self._places(w, known, marks)

    def _restart(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.layouts: dict[tuple, list] = {}
        top, does = [(self.want, self.want.starts)], []
        if not self.items.at:
            self._take(top, does, 0, 0)
        self.first = self._state(tuple(top)), does

    def _state(self, open_items: tuple) -> _State:
        return self.states.setdefault(open_items, _State(open_items))

    def _take(self, open_items: list, does: list, at: int, i: int) -> None:
        """Notes that field i of an open item is at this element; with items, another item is open from here on."""
        want = open_items[at][0].wants[i]
        f = want.f
        if isinstance(f, Pick):
            does.append((None, at, i, f.which, f.attr, f.own, f.mark))
            return
        does.append((want.many, at, i, "all", None, False, ""))
        open_items.append((want, want.starts))
        for j, w in enumerate(want.wants):
            if not w.f.at:
                self._take(open_items, does, len(open_items) - 1, j)

    def _after(self, state: _State, shape: tuple) -> tuple[_State, list]:
        """(state below such an element, what is to be done at it)."""
        open_items, here = [], []
        for at, (want, progress) in enumerate(state.open):
            moved = []
            for i, (w, (place, apart, inside)) in enumerate(zip(want.wants, progress)):
                inside = inside or _all_met(shape, w.apart, apart)
                if not inside and _all_met(shape, w.place, place):
                    here.append((at, i))
                moved.append((_further(shape, w.place, place), _further(shape, w.apart, apart), inside))
            open_items.append((want, tuple(moved)))
        does: list = []
        for at, i in here:
            self._take(open_items, does, at, i)
        return self._state(tuple(open_items)), does

    def _tag(self, token: str) -> tuple | None:
        """(name, number of the shape or None for an end tag, attributes, whether it stays open, what it closes, the bounds of that, its number in layouts), or None when it is no plain tag."""
        m = _PLAIN_TAG.fullmatch(token)
        if m is None or _RAW.match(token):
            return None
        tag, attrs, closed, ended = m.groups()
        number = lambda what, all_of: all_of.setdefault(what, len(all_of))
        if ended:
            return ended.lower(), None, None, False, None, None, number(ended.lower(), self.numbers)
        tag = tag.lower()
        own = {k.lower(): unescape(v1 or v2 or v3) for k, v1, v2, v3 in _ATTRIBUTE.findall(attrs)} if attrs else {}
        tags, ids, classes, names = self.known
        shape = (tag if tag in tags else "", own["id"] if own.get("id") in ids else "", classes.intersection(own["class"].split()) if "class" in own else _NONE, names.intersection(own))
        if (no := number(shape, self.shape_numbers)) == len(self.shapes):
            self.shapes.append(shape)
        stays = not closed and tag not in VOID
        return tag, no, own, stays, *CLOSES.get(tag, (None, None)), number((tag, no, stays), self.numbers)

    def read(self, html: str | None) -> list[list] | None:
        """Rows of the items, each a list of the values of its fields; None for a page that only its tree can tell."""
        html = html or ""
        pieces = _BETWEEN.split(html)
        if "<" in pieces[-1]:
            return None
        if len(self.states) > self.STATES:
            self._restart()
        if len(self.tags) > self.TAGS:
            self.tags = {}
        texts, tokens = pieces[::2], pieces[1::2]
        told = list(map(self.tags.get, tokens))
        for n, known in enumerate(told) if None in told else ():
            if known is None:
                known = told[n] = self._tag(tokens[n])
                if known is None:
                    return None
                if len(tokens[n]) <= self.LONGEST:
                    self.tags[tokens[n]] = known
        layout = tuple([t[6] for t in told])
        rows = self.layouts.get(layout)
        if rows is None:
            rows = self._walk(told)
            if rows is None:
                return None
            if len(self.layouts) >= self.LAYOUTS:
                self.layouts.pop(next(iter(self.layouts)))
            if len(layout) <= self.LONGEST:
                self.layouts[layout] = rows
        if "&" in html:
            texts = [unescape(t) if "&" in t else t for t in texts]
        want = self.want.wants[0]
        return [_filled(row, want, texts, told) for row in rows]

    def _walk(self, told: list[tuple]) -> list[list] | None:
        """Rows of a page with these tags, with what makes up each value in its place; text n stands ahead of tag n."""
        breaks: list[tuple[int, str]] = []  # tags that stand for a character of text
        marks = self.marks
        state, does = self.first
        rows: list = [[[]]]
        held = _begun(rows, does, -1)
        own: list | None = [] if held else None
        tag, start = "", 0
        stack: list = []
        for n, (name, shape, _, stays, ends, bounds, _) in enumerate(told):
            if own is not None:
                own.append(n)
            if shape is None:
                if name == tag:
                    if held:
                        _ended(held, start, n + 1, own, breaks)
                    tag, state, rows, held, start, own = stack.pop()
                    continue
                out = next((up for up in range(len(stack) - 1, 0, -1) if stack[up][0] == name), len(stack) + 1)
            elif ends and stack and tag not in bounds:
                out = len(stack) + (tag not in ends)
                for up in range(len(stack) - 1, 0, -1):
                    if (above := stack[up][0]) in bounds:
                        break
                    if above in ends:
                        out = up
            else:
                out = len(stack) + 1
            while len(stack) >= out:
                if held:
                    _ended(held, start, n + 1, own, breaks)
                tag, state, rows, held, start, own = stack.pop()
            if shape is None:
                continue
            if name == "br":
                breaks.append((n, ""))
                if own is not None:
                    own.append(-1)
            elif name in marks:
                breaks.append((n, name))
            after = state.next.get(shape)
            if after is None:
                after = self._after(state, self.shapes[shape])
                if len(after[0].open) > self.NESTED or len(self.states) > 2 * self.STATES:
                    return None
                state.next[shape] = after
            if after[1]:
                inner = rows[:]
                begun = _begun(inner, after[1], n)
                if stays:
                    stack.append((tag, state, rows, held, start, own))
                    tag, state, rows, held, start, own = name, after[0], inner, begun, n + 1, [] if begun else None
            elif stays:
                stack.append((tag, state, rows, held, start, own))
                tag, state, held, own = name, after[0], None, None
        n = len(told)
        if own is not None:
            own.append(n)
        while True:
            if held:
                _ended(held, start, n + 1, own, breaks)
            if not stack:
                return rows[0][0]
            tag, state, rows, held, start, own = stack.pop()


def _begun(rows: list, does: list, n: int) -> list:
    """What begins at tag n: rows of items are added to `rows`, attributes are noted, and texts that end with the element are returned."""
    held = []
    for many, at, i, which, attr, direct, mark in does:
        row = rows[at]
        if many is not None:
            row[i].append(made := [[] if m else None for m in many])
            rows.append(made)
            continue
        cell = [n, attr, None]  # an attribute of a tag; texts from one to another; or texts one by one
        if which == "all":
            row[i].append(cell)
        elif which == "first" and row[i] is not None:
            continue
        else:
            row[i] = cell
        if not attr or n < 0:
            cell[:2] = 0, 0
        if not attr:
            held.append((cell, direct, mark))
    return held


def _ended(held: list, start: int, end: int, own: list[int], breaks: list[tuple[int, str]]) -> None:
    """Notes the texts of an element that ends; -1 stands for a line break, -2 for a mark."""
    for cell, direct, mark in held:
        if direct:
            cell[2] = own[:]
            continue
        cell[0], cell[1] = start, end
        inside = []
        for n, name in reversed(breaks):
            if n < start:
                break
            if not name or name == mark:
                inside.append((n, -2 if name else -1))
        if inside:
            cell[2] = list(range(start, end))
            for n, sign in inside:  # the last one first
                cell[2].insert(n + 1 - start, sign)


_SIGNS = {-1: "\n", -2: "^"}


def _filled(row: list, want: _Want, texts: list[str], told: list[tuple]) -> list:
    """A row with its values in place of what makes them up."""
    out = []
    for cell, w, many in zip(row, want.wants, want.many):
        if w.wants:
            out.append([_filled(r, w, texts, told) for r in cell])
            continue
        values = []
        for a, b, some in cell if many else (cell,) if cell else ():
            if some is not None:
                value = _tidy("".join([texts[n] if n >= 0 else _SIGNS[n] for n in some]))
            elif b.__class__ is str:
                value = told[a][2].get(b) or None
            else:
                value = _tidy(texts[a] if b == a + 1 else "".join(texts[a:b]))
            values.append(value)
        out.append([v for v in values if v is not None] if many else values[0] if values else None)
    return out


def _as_rows(found: list[dict], items: Items) -> list[list]:
    return [[_as_rows(row[k], f) if isinstance(f, Items) else row[k] for k, f in items.fields.items()] for row in found]


def _as_dicts(rows: list[list], items: Items) -> list[dict]:
    return [{k: _as_dicts(v, f) if isinstance(f, Items) else v for (k, f), v in zip(items.fields.items(), row)} for row in rows]


def rows_of(html: str | None, reader: Reader) -> list[list]:
    rows = reader.read(html)
    return _as_rows(tree_items(html, reader.items), reader.items) if rows is None else rows


def items_of(html: str | None, items: Items) -> list[dict]:
    return _as_dicts(rows_of(html, Reader(items)), items)


def _lists(values: list[list], kind: pa.DataType, items_array: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), items_array, type=kind)


def _column(pages: list[list], items: Items, kind: pa.DataType) -> pa.Array:
    """Rows of pages as a column of arrays, field by field."""
    rows = list(chain.from_iterable(pages))
    fields = []
    for i, f in enumerate(items.fields.values()):
        values, own = [row[i] for row in rows], kind.value_type.field(i).type
        if isinstance(f, Items):
            fields.append(_column(values, f, own))
        elif f.which == "all":
            fields.append(_lists(values, own, pa.array(chain.from_iterable(values), own.value_type)))
        else:
            fields.append(pa.array(values, own))
    return _lists(pages, kind, pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))


def kind_of(items: Items) -> DataType:
    one = lambda f: kind_of(f) if isinstance(f, Items) else ArrayType(StringType()) if f.which == "all" else StringType()
    return ArrayType(StructType([StructField(name, one(f)) for name, f in items.fields.items()]))


def page_items(html: Column, items: Items) -> Column:
    """The items of a page as an array of structs; a null page has the items of an empty one.

    The function is declared nondeterministic: else a filter on what was read would be moved ahead of it, with a reading of the page of its own.
    """
    kind = kind_of(items)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def found(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(items)
        for batch in pages:
            parts = [_column([rows_of(x, reader) for x in part.to_pylist()], items, arrow) for part in slices(batch)]
            yield pa.chunked_array(parts, type=arrow).combine_chunks()

    return found.asNondeterministic()(html)
