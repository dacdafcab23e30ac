"""Elements of HTML pages as a table, on which selectors are filters and joins."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where another of their kind, or of these, begins.
BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}} | {block: {"p"} for block in BLOCKS}
COLUMNS = "node int, parent int, path array<int>, tag string, id string, classes array<string>, attributes map<string,string>, text string"


class _Tree(HTMLParser):
    """Elements in document order: parent, path of ancestors, tag, attributes, and the pieces of their text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        while self.open and self.rows[self.open[-1]][2] in CLOSES.get(tag, ()):
            self.open.pop()
        self.rows.append((self.open[-1] if self.open else None, list(self.open), tag, {k: v or "" for k, v in attrs}, []))
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][2] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        script = self.open and self.rows[self.open[-1]][2] in ("script", "style")
        for i in self.open[-1:] if script else self.open:
            self.rows[i][4].append(data)


def elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of `pages` but the HTML, with a row for each element: node (its place in the page), parent, path
    (its ancestors), tag, id, classes, attributes, and text (its own and its descendants', blanks
    collapsed; a script's as it is). A null or empty page has no row; HTML of any kind and length is
    read, unclosed elements end with their parents. Columns so named are replaced."""
    added = _parse_datatype_string(COLUMNS)
    keep = [c for c in pages.columns if c != html and c not in added.names]
    schema = StructType([*(pages.schema[c] for c in keep), *added.fields])
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                page, out = [], [[] for _ in kinds]
                for i, text in enumerate(b.column(0).to_pylist()):
                    tree = _Tree()
                    tree.feed(text or "")
                    tree.close()
                    for node, (parent, path, tag, attrs, pieces) in enumerate(tree.rows):
                        said = "".join(pieces)
                        row = (node, parent, path, tag, attrs.get("id"), (attrs.get("class") or "").split(), list(attrs.items()), said if tag in ("script", "style") else " ".join(said.split()))
                        page.append(i)
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                rest = [b.column(j).take(pa.array(page, pa.int32())) for j in range(1, b.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], schema.names)

    return pages.select(html, *keep).mapInArrow(run, schema)


_SIMPLE = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[*^$~]?=)["']?(?P<value>[^"'\]]*)["']?)?\]""")


def compound(text: str) -> Column:
    """The condition of one compound: tag, #id, .class, [name], [name=v], [name*=v], [name^=v], [name$=v], [name~=v]."""
    out, at = F.lit(True), 0
    for m in _SIMPLE.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        if m["tag"]:
            out = out if m["tag"] == "*" else out & (F.col("tag") == m["tag"].lower())
        elif m["id"]:
            out = out & F.coalesce(F.col("id") == m["id"], F.lit(False))
        elif m["cls"]:
            out = out & F.array_contains("classes", m["cls"])
        else:
            held = F.element_at("attributes", F.lit(m["attr"].lower()))
            value = F.lit(m["value"])
            test = {None: held.isNotNull(), "=": held == value, "*=": F.contains(held, value), "^=": F.startswith(held, value), "$=": F.endswith(held, value), "~=": F.array_contains(F.split(held, r"\s+"), value)}[m["op"]]
            out = out & F.coalesce(test, F.lit(False))
    if at != len(text) or not text:
        raise ValueError(f"not a selector that is known: {text!r}")
    return out


def steps(selector: str) -> list[tuple[str, str]]:
    """A selector's compounds with the relation of each to the one before: "" for the first, " " or ">"."""
    parts = re.findall(r"(?:\[[^\]]*\]|[^\s>\[])+|>", selector.strip())
    out, relation = [], ""
    for p in parts:
        if p == ">":
            relation = ">"
        else:
            out.append((relation, p))
            relation = " "
    return out


def select(table: DataFrame, selector: str, key: list[str]) -> DataFrame:
    """The elements that a selector finds: compounds within others (blank), right within others (>), alternatives
    by commas. Each step keeps the elements that have one of the step before above them: a semi join on
    page and ancestor."""
    found = None
    for each in selector.split(","):
        above = None
        if not steps(each):
            raise ValueError(f"not a selector that is known: {selector!r}")
        for relation, text in steps(each):
            own = table.where(compound(text))
            if above is not None:
                seen = above.select(*key, F.col("node").alias("_above"))
                if relation == ">":
                    own = own.join(seen, [*(own[k].eqNullSafe(seen[k]) for k in key), own["parent"] == seen["_above"]], "left_semi")
                else:
                    reach = own.select(*key, "node", F.explode("path").alias("_above"))
                    hit = reach.join(seen, [*(reach[k].eqNullSafe(seen[k]) for k in key), reach["_above"] == seen["_above"]], "left_semi").select(*key, "node").distinct()
                    own = own.join(hit, [*(own[k].eqNullSafe(hit[k]) for k in key), own["node"] == hit["node"]], "left_semi")
            above = own
        found = above if found is None else found.unionByName(above)
    return found if "," not in selector else found.dropDuplicates([*key, "node"])
