"""HTML tables as ordered rows: cells on their grid, groups under header rows, pairs of rows, pairs listed either way round."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.batches import slices
from ..functions.page_items import _ATTRIBUTE, _BETWEEN, _PLAIN_TAG, _RAW
from ..types import join_keys
from .documents import per_key

#: A cell spans no more columns than HTML allows.
MOST_COLUMNS = 1000
CELL = "table_no int, row_no int, col_no int, text string, sup string, href string, head boolean, row_id string, row_class string, cell_class string, spanned boolean"


class _Tables(HTMLParser):
    """Cells of all tables of a page in document order; a nested table is a table of its own, and its text is not that of the cell around it.

    A cell has the numbers of its texts (-1: a line break) and of the tags that tell its row, its class and its link, so that pages of one layout share their cells.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.cells: list[list] = []
        self.tables = 0
        self.texts: list[str] = []
        self.tags: list[dict] = []

    def handle_starttag(self, tag, attrs):
        self.tags.append(dict(attrs))
        self.begin(tag, len(self.tags) - 1, self.tags[-1])

    def begin(self, tag: str, n: int, own: dict) -> None:
        if tag == "table":
            self.open.append({"no": self.tables, "row": -1, "col": 0, "down": {}, "cell": None, "tag": None, "sup": 0})
            self.tables += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._row(n)
            elif tag in ("td", "th"):
                if t["row"] < 0 or t["col"] < 0:
                    self._row(None)
                self._cell(tag == "th", n, own)
            elif t["cell"] is not None:
                if tag == "sup":
                    t["sup"] += 1
                elif tag == "br":
                    t["cell"][3].append(-1)
                elif tag == "a" and t["cell"][5] is None and own.get("href") is not None:
                    t["cell"][5] = n

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag == "table":
            self._end_row()
            self.open.pop()
        elif tag == "tr":
            self._end_row()
        elif tag in ("td", "th"):
            t["cell"], t["sup"] = None, 0
        elif tag == "sup" and t["sup"]:
            t["sup"] -= 1

    def handle_data(self, data):
        self.texts.append(data)
        self.text(len(self.texts) - 1)

    def text(self, n: int) -> None:
        if self.open and (cell := self.open[-1]["cell"]) is not None:
            cell[4 if self.open[-1]["sup"] else 3].append(n)

    def finish(self) -> list[list]:
        """Cells by place: table, row and column, texts and raised texts or the cell that spans, link, head, row and cell by number of their tag, spanned."""
        while self.open:
            self.handle_endtag("table")
        return sorted(self.cells, key=lambda c: c[:3])

    def _row(self, n):
        self._end_row()
        t = self.open[-1]
        t["row"], t["col"], t["tag"] = t["row"] + 1, 0, n
        self._carry()

    def _carry(self):
        """Cells of rows above that reach down into the place that comes next."""
        t = self.open[-1]
        while t["col"] in t["down"]:
            cell, left = t["down"].pop(t["col"])
            self.cells.append([t["no"], t["row"], t["col"], cell, None, None, cell[6], t["tag"], cell[8], True])
            t["next"] = t.get("next") or {}
            if left > 1:
                t["next"][t["col"]] = (cell, left - 1)
            t["col"] += 1

    def _cell(self, head, n, own):
        t = self.open[-1]
        self._carry()
        span = lambda name, most: min(max(int(own[name]), 1), most) if (own.get(name) or "").strip().isdigit() else 1
        wide, high = span("colspan", MOST_COLUMNS), span("rowspan", 65534)
        cell = [t["no"], t["row"], t["col"], [], [], None, head, t["tag"], n, False]
        t["cell"], t["sup"] = cell, 0
        t["next"] = t.get("next") or {}
        for i in range(wide):
            self.cells.append(cell if i == 0 else [t["no"], t["row"], t["col"], cell, None, None, head, t["tag"], n, True])
            if high > 1:
                t["next"][t["col"]] = (cell, high - 1)
            t["down"].pop(t["col"], None)
            t["col"] += 1

    def _end_row(self):
        t = self.open[-1]
        t["cell"], t["sup"] = None, 0
        if t["row"] < 0 or t["col"] < 0:
            return
        for col in sorted(t["down"]):  # places that the row left out
            t["col"] = col
            self._carry()
        t["down"], t["next"], t["col"] = t.get("next") or {}, {}, -1


class _Reader:
    """Cells of pages.  Pages repeat their layout: where the cells of a page of plain markup are is worked out once for all pages with the same tags and spans."""

    #: Tags and layouts that are kept at most, the longest tag and layout that is kept.
    TAGS, LAYOUTS, LONGEST = 10_000, 500, 2000

    def __init__(self) -> None:
        self.tags: dict[str, tuple] = {}
        self.numbers: dict[tuple, int] = {}
        self.layouts: dict[tuple, list] = {}

    def _tag(self, token: str) -> tuple | None:
        """(its number in layouts, attributes, name, "b" for one that begins, "e" for an end, "be" for both), or None when it is no plain tag."""
        m = _PLAIN_TAG.fullmatch(token)
        if m is None or _RAW.match(token):
            return None
        tag, attrs, closed, ended = m.groups()
        found = list(_ATTRIBUTE.finditer(attrs or ""))
        if any("=" not in x[0] for x in found):
            return None
        own = {x[1].lower(): unescape(x[2] or x[3] or x[4] or "") for x in found}
        name, kind = (ended or tag).lower(), "e" if ended else "be" if closed else "b"
        telling = (name if name in _TELLING else "", kind, "href" in own, own.get("colspan"), own.get("rowspan"))
        return self.numbers.setdefault(telling, len(self.numbers)), own, name, kind

    def _told(self, token: str) -> tuple | None:
        told = self.tags.get(token)
        if told is not None:
            return told
        parts = token.split('"')  # a tag with one attribute is told by the same one without its value
        frame = parts[0] + '""' + parts[2] if len(parts) == 3 else token
        told = self.tags.get(frame) if frame != token else None
        if told is None:
            told = self._tag(frame)
            if told is None:
                return None
            if len(self.tags) >= self.TAGS:
                self.tags = {}
            if len(frame) <= self.LONGEST:
                self.tags[frame] = told
        if frame == token:
            return told
        if len(told[1]) != 1 or "colspan" in told[1] or "rowspan" in told[1]:
            told = self._tag(token)
            if told is not None and len(token) <= self.LONGEST:
                self.tags[token] = told
            return told
        (name,) = told[1]
        return told[0], {name: unescape(parts[1])}, told[2], told[3]

    def read(self, html: str | None) -> tuple[list[list], list[str], list[dict]]:
        """Cells by place (as `finish` says), texts and attributes of tags."""
        html = html or ""
        pieces = _BETWEEN.split(html)
        texts, tokens = pieces[::2], pieces[1::2]
        told = list(map(self.tags.get, tokens))
        if None in told:
            told = [one or self._told(token) for one, token in zip(told, tokens)]
        if None in told or "<" in texts[-1]:
            page = _Tables()
            page.feed(html)
            page.close()
            return page.finish(), page.texts, page.tags
        if "&" in html:
            texts = [unescape(x) if "&" in x else x for x in texts]
        layout = tuple([x[0] for x in told])
        cells = self.layouts.get(layout)
        if cells is None:
            page = _Tables()
            for n, (_, own, name, kind) in enumerate(told):  # text n stands ahead of tag n
                page.text(n)
                if "b" in kind:
                    page.begin(name, n, own)
                if "e" in kind:
                    page.handle_endtag(name)
            page.text(len(told))
            cells = page.finish()
            if len(self.layouts) >= self.LAYOUTS:
                self.layouts.pop(next(iter(self.layouts)))
            if len(layout) <= self.LONGEST:
                self.layouts[layout] = cells
        return cells, texts, [x[1] for x in told]


_TELLING = frozenset(("table", "tr", "td", "th", "sup", "br", "a"))


def _joined(numbers: list[int], texts: list[str]) -> str:
    """Texts with white space collapsed; a number below 0 is a line break."""
    text = texts[numbers[0]] if len(numbers) == 1 and numbers[0] >= 0 else "".join([texts[n] if n >= 0 else " " for n in numbers])
    return " ".join(text.split())


def _values(read: tuple[list[list], list[str], list[dict]]) -> list[tuple]:
    """(table, row, column, text, raised text, link, head, number of the row's tag, class, spanned) of each cell."""
    cells, texts, tags = read
    known: dict[int, tuple] = {}  # by the cell that spans
    out = []
    for cell in cells:
        no, row, col, text, sup, href, head, row_tag, tag, spanned = cell
        if spanned:
            told = known[id(text)]
        else:
            told = (_joined(text, texts), sup and _joined(sup, texts) or None, None if href is None else tags[href]["href"])
            known[id(cell)] = told
        out.append((no, row, col, *told, head, row_tag, tags[tag].get("class"), spanned))
    return out


def cells_of(html: str | None) -> list[tuple]:
    """Cells in document order, as CELL says; a place that is covered by a span repeats the cell's text, spanned."""
    read = _Reader().read(html)
    of = lambda n, name: None if n is None else read[2][n].get(name)
    return [(*c[:7], of(c[7], "id"), of(c[7], "class"), *c[8:]) for c in _values(read)]


def table_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """key and CELL: every place of the grid of every table of the pages, numbered from 0; `sup` is text set high, which is not in `text`."""
    return per_key(df, key, html, CELL, cells_of)


_CELL = [("col_no", IntegerType()), ("text", StringType()), ("sup", StringType()), ("href", StringType()), ("head", BooleanType()), ("cell_class", StringType()), ("spanned", BooleanType())]
_ROW = [("table_no", IntegerType()), ("row_no", IntegerType()), ("row_id", StringType()), ("row_class", StringType()), ("cells", ArrayType(StructType([StructField(*f) for f in _CELL])))]
_KIND = ArrayType(StructType([StructField(*f) for f in _ROW]))


def _column(pages: Iterable[str | None], reader: _Reader, kind: pa.DataType) -> pa.Array:
    """Rows of pages with their cells, column by column."""
    rows: tuple = ([], [], [], [])
    cells: tuple = ([], [], [], [], [], [], [])
    ends, row_ends = [0], [0]
    for html in pages:
        read = reader.read(html)
        at = None
        for no, row, col, text, sup, href, head, row_tag, cell_class, spanned in _values(read):
            if (no, row) != at:
                at = no, row
                own = {} if row_tag is None else read[2][row_tag]
                for values, value in zip(rows, (no, row, own.get("id"), own.get("class"))):
                    values.append(value)
                row_ends.append(row_ends[-1])
            row_ends[-1] += 1
            for values, value in zip(cells, (col, text, sup, href, head, cell_class, spanned)):
                values.append(value)
        ends.append(len(rows[0]))
    inner = kind.value_type.field("cells").type
    struct = lambda of, columns: pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, of)], fields=list(of))
    lists = pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), struct(inner.value_type, cells), type=inner)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct(kind.value_type, [*rows, lists]), type=kind)


def page_rows(html: Column) -> Column:
    """Rows of all tables of a page that have cells, in order: array of struct(table_no, row_no, row_id, row_class, cells in order with what CELL says of them)."""
    arrow = to_arrow_type(_KIND)

    @F.arrow_udf(_KIND)
    def rows(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _Reader()
        for batch in pages:
            yield pa.chunked_array([_column(part.to_pylist(), reader, arrow) for part in slices(batch)], type=arrow).combine_chunks()

    return rows.asNondeterministic()(html)  # else a filter on the rows would be moved ahead with a reading of its own


def headed_rows(rows: Column, is_header: Callable[[Column], Column], header_text: Callable[[Column], Column]) -> Column:
    """Of the rows of a page: array of struct(row, header), header being the text of the last header row before in the table that has one; header rows are left out.

    As grouped_rows, where all rows of a page are together: a page is cut at its headers, nothing is shuffled or sorted.
    """
    told = F.transform(rows, lambda r, i: F.struct(i.alias("at"), r["table_no"].alias("no"), F.coalesce(is_header(r), F.lit(False)).alias("head")))
    first = lambda x: (x["at"] == 0) | (F.get(rows, x["at"] - 1)["table_no"] != x["no"])
    cuts = F.transform(told, lambda x: F.struct(x["at"].alias("at"), first(x).alias("first"), F.when(x["head"], header_text(F.get(rows, x["at"]))).alias("text")))
    cuts = F.filter(cuts, lambda x: x["first"] | x["text"].isNotNull())
    ends = F.concat(F.slice(F.transform(cuts, lambda x: x["at"]), 2, F.greatest(F.size(cuts) - 1, F.lit(0))), F.array(F.size(rows)))
    parts = F.transform(F.arrays_zip(cuts.alias("cut"), ends.alias("end")), lambda z: F.transform(F.slice(rows, z["cut"]["at"] + 1, z["end"] - z["cut"]["at"]), lambda r: F.struct(r.alias("row"), z["cut"]["text"].alias("header"))))
    return F.filter(F.flatten(parts), lambda x: ~F.coalesce(is_header(x["row"]), F.lit(False)))


def paired_rows(headed: Column, suffix: str = "b") -> Column:
    """Of the headed rows of a page: array of struct(row, header, other), other being the cells of the row that follows in the table when its id is theirs with a suffix; as row_pairs."""
    n = F.greatest(F.size(headed) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(headed, 1, n).alias("a"), F.slice(headed, 2, n).alias("b"))
    fits = F.filter(both, lambda z: (z["a"]["row"]["table_no"] == z["b"]["row"]["table_no"]) & (z["b"]["row"]["row_id"] == F.concat(z["a"]["row"]["row_id"], F.lit(suffix))))
    return F.transform(fits, lambda z: F.struct(z["a"]["row"].alias("row"), z["a"]["header"].alias("header"), z["b"]["row"]["cells"].alias("other")))


def grouped_rows(cells: DataFrame, key: str, is_header: Column, header_text: Column) -> DataFrame:
    """key, table_no, row_no, row_id, cells (in order, spanned ones too) and header: the text of the last header row before.

    is_header and header_text are over the columns of table_cells; header rows themselves are left out.  Cells are dealt out by
    key once, which serves the rows, their order and whatever follows by key.
    """
    needed = ["row_id", "col_no", "text", "sup", "href", "cell_class", "spanned"]
    marked = cells.withColumns({"__head": is_header, "__text": header_text}).select(key, "table_no", "row_no", *needed, "__head", "__text").repartition(F.col(key))
    keys = [key, "table_no", "row_no"]
    rows = marked.groupBy(*keys).agg(
        F.first("row_id").alias("row_id"),
        F.sort_array(F.collect_list(F.struct("col_no", "text", "sup", "href", "cell_class", "spanned"))).alias("cells"),
        F.max("__head").alias("__head"),
        F.min(F.when(F.col("__head") & F.col("__text").isNotNull(), F.struct("col_no", "__text")))["__text"].alias("__text"),
    )
    w = Window.partitionBy(key, "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("header", F.last(F.when(F.col("__head"), F.col("__text")), ignorenulls=True).over(w))
    return carried.where(~F.coalesce("__head", F.lit(False))).drop("__head", "__text")


def row_pairs(rows: DataFrame, key: str, suffix: str = "b") -> DataFrame:
    """Rows with `other`, the cells of the row that follows when its id is theirs with a suffix; rows without such a one go."""
    w = Window.partitionBy(key, "table_no").orderBy("row_no")
    following = rows.withColumns({"__id": F.lead("row_id").over(w), "other": F.lead("cells").over(w)})
    return following.where(F.col("__id") == F.concat("row_id", F.lit(suffix))).drop("__id")


def scored(a: Column, b: Column) -> Column:
    """Sets of two lists of score cells: array of struct(a, b, tiebreak), places that both have and that are numbers; the tie-break is set high on either side."""
    number = lambda x: x.try_cast("int")
    both = F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, F.least(F.size(a), F.size(b))), lambda z: F.struct(number(z["a"]["text"]).alias("a"), number(z["b"]["text"]).alias("b"), F.coalesce(number(z["a"]["sup"]), number(z["b"]["sup"])).alias("tiebreak")))
    return F.filter(both, lambda z: z["a"].isNotNull() & z["b"].isNotNull())


def join_oriented(rows: DataFrame, details: DataFrame, key: list[str], pair: tuple[str, str], swapped: list[tuple[str, str]]) -> DataFrame:
    """rows with the details of the same key and pair, whichever way round the details list it.

    `swapped`: pairs of detail columns that change places when the details have the pair the other way; a null name fits a null name.
    """
    a, b = pair
    fields = [c for c in details.columns if c not in (*key, a, b)]
    turned = {**{x: y for x, y in swapped}, **{y: x for x, y in swapped}}
    one = details.select(*key, a, b, *fields, F.lit(0).alias("__way"))
    other = details.where(~F.col(a).eqNullSafe(F.col(b))).select(*key, F.col(b).alias(a), F.col(a).alias(b), *[F.col(turned.get(f, f)).alias(f) for f in fields], F.lit(1).alias("__way"))
    both = one.unionByName(other)
    best = both.groupBy(*key, a, b).agg(F.min(F.struct("__way", *fields)).alias("__d"))  # as listed before turned round
    return join_keys(rows, best, [*key, a, b], "left").select(*rows.columns, *[F.col(f"__d.{f}").alias(f) for f in fields])
