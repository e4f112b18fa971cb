"""XML documents against a schema (VAL-09): content models as automata over the sequences of children, facets over texts.

The schema (a contract, not data) is compiled once into a table of rules by path: a regular expression that the names of an
element's children must match as a whole, the attributes it must have, and patterns, lengths, bounds and listed values for
its text. Documents become rows of elements; rules meet them by an equality join on the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schema language's name, and patterns of its plain types.
XS = "{http://www.w3.org/2001/XMLSchema}"
PLAIN = {
    "integer": r"\s*[+-]?\d+\s*",
    "nonNegativeInteger": r"\s*(?:\+?\d+|-0+)\s*",
    "positiveInteger": r"\s*\+?0*[1-9]\d*\s*",
    "decimal": r"\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)\s*",
    "date": r"\s*-?\d{4,}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:Z|[+-]\d{2}:\d{2})?\s*",
    "boolean": r"\s*(?:true|false|0|1)\s*",
}
RULE = "path string, model string, required array<string>, allowed array<string>, patterns array<string>, listed array<string>, min_length int, max_length int, min_value double, max_value double, usual string"
_NODE = "path string, place int, children string, attributes map<string,string>, text string"
_DEPTH = 64
#: Elements leave a task in batches of so many, or of one document where that has more.
_ROWS = 10_000


def _times(e: ElementTree.Element, body: str) -> str:
    low, high = e.get("minOccurs", "1"), e.get("maxOccurs", "1")
    return f"(?:{body}){{{low},{'' if high == 'unbounded' else high}}}"


class Schema:
    """The rules of an XML schema of sequences, choices, groups of all, nested and named types, restrictions and attributes."""

    def __init__(self, text: str):
        self.root = ElementTree.fromstring(text)
        self.types = {t.get("name"): t for t in self.root if t.tag in (f"{XS}complexType", f"{XS}simpleType")}
        self.elements = {e.get("name"): e for e in self.root.findall(f"{XS}element")}
        self.rules: list[tuple] = []
        for e in self.elements.values():
            self._element(e, "", 0)

    def _element(self, e: ElementTree.Element, above: str, depth: int) -> None:
        if depth > _DEPTH:
            raise ValueError(f"a type of {above} holds itself")
        e = self.elements[e.get("ref").rpartition(":")[2]] if e.get("ref") else e
        path = f"{above}/{e.get('name')}"
        kind = next((c for c in e if c.tag in (f"{XS}complexType", f"{XS}simpleType")), None)
        named = (e.get("type") or "").rpartition(":")[2]
        kind = self.types.get(named) if kind is None else kind
        facets = self._facets(kind, named)
        children, below = "", []
        attributes: list[ElementTree.Element] = []
        if kind is not None and kind.tag == f"{XS}complexType":
            children, below = self._content(kind)
            attributes = list(kind.iter(f"{XS}attribute")) if not below else [a for a in kind if a.tag == f"{XS}attribute"]
        if kind is None and not named:
            return  # a type of anything
        # most elements have each child that must be there once: those needn't be matched
        usual = "".join(f"{b.get('name') or b.get('ref').rpartition(':')[2]} " for b in below if b.get("minOccurs") != "0")
        usual = usual if re.fullmatch(children, usual) else None
        self.rules.append((path, children, [a.get("name") for a in attributes if a.get("use") == "required"], [a.get("name") for a in attributes], *facets, usual))
        for b in below:
            self._element(b, path, depth + 1)

    def _content(self, e: ElementTree.Element) -> tuple[str, list[ElementTree.Element]]:
        """A pattern of children's names, each followed by a blank, and the children."""
        parts, below = [], []
        for c in e:
            if c.tag == f"{XS}element":
                parts.append(_times(c, re.escape((c.get("name") or c.get("ref").rpartition(":")[2]) + " ").replace("\\ ", " ")))
                below.append(c)
            elif c.tag in (f"{XS}sequence", f"{XS}choice", f"{XS}all"):
                body, more = self._content(c)
                parts.append(_times(c, body))
                below += more
        if e.tag == f"{XS}choice":
            return "|".join(parts), below
        if e.tag == f"{XS}all":  # any order, each as often as it says: looked for one by one
            any_of = "|".join(re.escape((c.get("name") or "") + " ").replace("\\ ", " ") for c in below)
            looks = "".join(f"(?=(?:(?!(?:{n}))\\S+ )*{_times(c, f'(?:{n})(?:(?!(?:{n}))\\S+ )*')}$)" for c in below for n in [re.escape(c.get("name") + " ").replace("\\ ", " ")])
            return f"{looks}(?:{any_of})*", below
        return "".join(parts), below

    def _facets(self, kind: ElementTree.Element | None, named: str) -> tuple:
        patterns, listed = [], None
        bounds: dict[str, float] = {}
        while True:
            if kind is None or kind.tag == f"{XS}complexType" and kind.find(f"{XS}simpleContent") is None:
                if named in PLAIN:
                    patterns.append(PLAIN[named])
                break
            base = next(iter([*kind.iter(f"{XS}restriction"), *kind.iter(f"{XS}extension")]), None)
            if base is None:
                break
            values = [f.get("value") for f in base.findall(f"{XS}enumeration")]
            listed = values if values and listed is None else listed
            own = [f.get("value") for f in base.findall(f"{XS}pattern")]
            patterns += [f"(?:{'|'.join(own)})"] if own else []
            for f in base:
                name = f.tag.removeprefix(XS)
                if name in ("minLength", "maxLength", "minInclusive", "maxInclusive", "length", "totalDigits", "fractionDigits"):
                    bounds.setdefault(name, float(f.get("value")))
            named = (base.get("base") or "").rpartition(":")[2]
            kind = self.types.get(named)
        if "totalDigits" in bounds:
            patterns.append(rf"\s*[+-]?0*(?:\d\.?){{0,{int(bounds['totalDigits'])}}}\s*")
        if "fractionDigits" in bounds:
            patterns.append(rf"[^.]*(?:\.\d{{0,{int(bounds['fractionDigits'])}}}0*\s*)?")
        whole = lambda n: int(bounds[n]) if n in bounds else int(bounds["length"]) if "length" in bounds else None
        return patterns, listed, whole("minLength"), whole("maxLength"), bounds.get("minInclusive"), bounds.get("maxInclusive")


def _nodes(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, str] = {}
        local = lambda t: names.get(t) or names.setdefault(t, t.rpartition("}")[2])
        kinds = (pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
        for batch in batches:
            kept = [c for c in batch.schema.names if c != text]
            at: list[int] = []
            columns: list[list] = [[], [], [], [], []]

            def told() -> pa.RecordBatch:
                repeated = [batch[c].take(pa.array(at, pa.int32())) for c in kept]  # noqa: B023
                out = pa.RecordBatch.from_arrays([*repeated, *map(pa.array, columns, kinds)], names=[*kept, *(c.split()[0] for c in _NODE.split(", "))])  # noqa: B023
                for c in (at, *columns):  # noqa: B023
                    c.clear()
                return out

            for i, document in enumerate(batch[text].to_pylist()):
                rows: list[tuple] = []
                try:
                    open_ = [("", ElementTree.fromstring(document or ""))]
                    while open_:
                        above, e = open_.pop()
                        path = f"{above}/{local(e.tag)}"
                        inner = [c for c in e if isinstance(c.tag, str)] if len(e) else ()
                        rows.append((path, len(rows), "".join([f"{local(c.tag)} " for c in inner]), [(local(k), v) for k, v in e.items()], e.text or ""))
                        open_ += [(path, c) for c in reversed(inner)]
                except (ElementTree.ParseError, ValueError) as error:
                    rows = [(None, None, None, None, str(error))]
                at += [i] * len(rows)
                for c, new in zip(columns, zip(*rows, strict=True), strict=True):
                    c += new
                if len(at) >= _ROWS:
                    yield told()
            if at:
                yield told()

    return run


def xml_nodes(df: DataFrame, text: str) -> DataFrame:
    """The elements of each row's document: path, place (in the document's order), children (names, each with a blank), attributes, text.

    A document that isn't well-formed is one row without a path; its text tells why.
    """
    fields = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(_nodes(text), T.StructType([*fields, *T._parse_datatype_string(_NODE).fields]))


def rules_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame(Schema(schema).rules, RULE)


def breaches(df: DataFrame, text: str, schema: str) -> DataFrame:
    """VAL-09: (columns of df but the text, path, place, rule) for each breach; a valid document has no row.

    rule: not well-formed, root, children, attribute missing: name, attribute: name, text, listed, length or bounds. Elements
    under one whose children are wrong are judged as far as the schema knows their path.
    """
    kept = [c for c in df.columns if c != text]
    rules = rules_table(df.sparkSession, schema).withColumnRenamed("path", "_path")
    met = xml_nodes(df, text).join(rules, F.col("path") == F.col("_path"), "left")
    names, plain = F.map_keys("attributes"), F.trim("text")
    value, size = plain.try_cast("double"), F.length("text")
    known = F.col("_path").isNotNull()
    leaf = known & (F.col("children") == "") & (F.col("model") == "")
    wrong = [
        F.when(F.col("path").isNull(), F.lit("not well-formed")),
        F.when(~known & (F.col("place") == 0), F.lit("root")),
        F.when(known & ~F.col("children").eqNullSafe(F.col("usual")) & ~F.regexp_like("children", F.concat(F.lit("^(?:"), F.col("model"), F.lit(")$"))), F.lit("children")),
        F.when(leaf & F.exists("patterns", lambda p: ~F.regexp_like("text", F.concat(F.lit("(?s)^(?:"), p, F.lit(")$")))), F.lit("text")),
        F.when(leaf & F.col("listed").isNotNull() & ~F.array_contains("listed", F.col("text")), F.lit("listed")),
        F.when(leaf & ((size < F.col("min_length")) | (size > F.col("max_length"))), F.lit("length")),
        F.when(leaf & ((value < F.col("min_value")) | (value > F.col("max_value"))), F.lit("bounds")),
    ]
    missing = F.transform(F.array_except("required", names), lambda n: F.concat(F.lit("attribute missing: "), n))
    strange = F.transform(F.filter(F.array_except(names, "allowed"), lambda n: n != "schemaLocation"), lambda n: F.concat(F.lit("attribute: "), n))
    none = F.array().cast("array<string>")
    told = F.concat(F.filter(F.array(*wrong), lambda r: r.isNotNull()), F.coalesce(missing, none), F.coalesce(strange, none))
    return met.select(*kept, "path", "place", F.explode(told).alias("rule"))
