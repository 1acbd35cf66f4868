"""Structural checks of JSON documents against the ledger schema.

A schema is a nest of nodes.  It is compiled into Column expressions over
variants: one for the faults of a value that stands at a node, one for the
values below it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import POLICY_LEVELS


def obj(required: dict, optional: dict | None = None, null: bool = False) -> dict:
    return {"type": ["object", "null"] if null else ["object"], "required": list(required), "fields": {**required, **(optional or {})}}


def arr(items: dict, least: int = 0, unique: bool = False) -> dict:
    return {"type": ["array"], "items": items, "least": least, "unique": unique}


def text(pattern: str | None = r"\S", null: bool = False, least: int = 0) -> dict:
    return {"type": ["string", "null"] if null else ["string"], "pattern": pattern, "length": least}


def one_of(*values: str) -> dict:
    return {"type": ["string"], "values": values}


def whole(minimum: int, null: bool = False) -> dict:
    return {"type": ["integer", "null"] if null else ["integer"], "minimum": minimum}


def flag(null: bool = False) -> dict:
    return {"type": ["boolean", "null"] if null else ["boolean"]}


# The ledger's closed domains and shapes.
NAME, SHA, DATE, SOME = text(r"^[A-Za-z0-9._-]+$"), text(r"^[0-9a-f]{64}$"), text(r"^\d{4}-\d{2}-\d{2}$", null=True), text()
LEVEL = one_of("formal", "interpretation", "secondary")
SEGMENT = obj({"id": NAME, "region": one_of("abstract", "body", "bibliography", "other", "unknown"), "section": SOME, "text": SOME, "extraction": one_of("text_layer", "ocr"), "review_status": one_of("verified", "unverified")}, {"verification_image": text(None, least=1)})
SOURCE = obj({
    "id": NAME, "title": SOME, "kind": one_of(*POLICY_LEVELS), "sha256": SHA, "coverage": one_of("full", "partial", "unreadable"),
    "origin": obj({"kind": one_of("local", "web", "synthetic"), "locator": SOME, "snapshot_path": text(null=True)}),
    "dates": obj({k: DATE for k in ("issued", "published", "effective", "accessed")}),
    "pages": arr(obj({"pdf_page": whole(1), "print_page": text(null=True), "segments": arr(SEGMENT)})),
})
LOCATION = obj({"kind": one_of("paragraph", "table_cell", "footnote", "endnote"), "paragraph_index": whole(1)}, {"table_index": whole(1), "row_index": whole(1), "cell_index": whole(1), "note_id": SOME})
EVIDENCE = obj({
    "id": NAME, "source_id": NAME, "source_sha256": SHA, "quote": SOME, "section": SOME, "pdf_pages": arr(whole(1), unique=True), "print_pages": arr(text(null=True), unique=True),
    "spans": arr(obj({"segment_id": NAME, "start": whole(0), "end": whole(1)})), "completeness_review": one_of("verified", "pending"), "context_review": one_of("verified", "pending"),
}, {"docx_location": obj({"block_id": text(None, least=1), "location": LOCATION})})
POLICY = obj({"claimed_level": LEVEL, "evidence_level": LEVEL, "quotation_verified": flag(True), "dates_reviewed": flag(), "claims_originals_verified": flag(), "version_note": SOME}, null=True)
CLAIM = obj({
    "id": NAME, "target": obj({"text": SOME, "pdf_page": whole(1, True), "print_page": text(null=True), "section": SOME}, {"docx_location": obj({"manuscript_sha256": SHA, "block_id": NAME, "location": LOCATION})}),
    "citation_role": one_of("explicit", "suggested", "policy"), "attributed_source_ids": arr(NAME, 1, True), "subclaims": arr(obj({"id": NAME, "text": SOME}), 1),
    "status": one_of("direct", "partial", "insufficient", "not_found", "unable"), "reason": SOME, "recommendation": SOME, "evidence": arr(EVIDENCE),
    "assessments": arr(obj({
        "subclaim_id": NAME, "evidence_ids": arr(NAME, unique=True), "support": one_of("supported", "partial", "unsupported", "unknown"), "reason": SOME,
        "boundaries": obj({k: flag(True) for k in ("object_match", "time_match", "geography_match", "causal_strength_match")}),
    }), 1),
    "search": obj({"status": one_of("complete", "incomplete"), "source_ids": arr(NAME, unique=True), "regions": arr(one_of("body", "abstract", "bibliography", "other"), unique=True), "queries": arr(SOME), "note": SOME}),
    "quotation_mode": one_of("verbatim", "paraphrase"), "verbatim_text": text(null=True), "review_status": one_of("reviewed", "pending"), "policy_checks": POLICY,
}, {"heading": text(None, least=1)})
LEDGER = obj({"schema_version": one_of("0.1", "0.2"), "sources": arr(SOURCE, 1), "claims": arr(CLAIM, 1)}, {"report": obj({}, {"title": text(None, least=1), "manuscript_title": text(None, least=1), "highlights": arr(text(None)), "additional_notes": arr(text(None))})})

# ---- expressions

#: What a value's type is called, by the head of its variant type; anything else is a number that is not whole.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer"}
ENTRY = "array<struct<path:string,node:int,value:variant,kind:string>>"
FAULT = "array<struct<path:string,fault:string>>"


class Compiled:
    """A schema as numbered nodes, of which equal ones are one, and as Column expressions over (path, node, value, kind)."""

    def __init__(self, schema: dict):
        self.nodes: list[dict] = []
        self.known: dict[str, int] = {}
        self.depth = self._depth(schema)
        self.root = self._number(schema)

    def _depth(self, node: dict) -> int:
        below = [*node.get("fields", {}).values(), *([node["items"]] if "items" in node else [])]
        return 1 + max(map(self._depth, below), default=0)

    def _number(self, node: dict) -> int:
        own = {k: v for k, v in node.items() if k not in ("fields", "items")}
        own["children"] = {k: self._number(v) for k, v in node.get("fields", {}).items()}
        if "items" in node:
            own["item"] = self._number(node["items"])
        name = json.dumps(own, sort_keys=True)
        if name not in self.known:
            self.known[name] = len(self.nodes)
            self.nodes.append(own)
        return self.known[name]

    def _having(self, node: Column, key: str, usable=lambda v: bool(v)) -> list[tuple[Column, object]]:
        """For each value that nodes have under key: whether this is such a node."""
        by: dict[str, list[int]] = {}
        for n, own in enumerate(self.nodes):
            if key in own and usable(own[key]):
                by.setdefault(json.dumps(own[key]), []).append(n)
        return [(node.isin(n), json.loads(v)) for v, n in by.items()]

    def _table(self, node: Column, key: str, usable=lambda v: bool(v), default=None) -> Column:
        """A list of strings that depends on the node."""
        out = F.lit(None).cast("array<string>") if default is None else default
        for there, value in self._having(node, key, usable):
            out = F.when(there, F.array(*map(F.lit, value))).otherwise(out)
        return out

    def faults(self, x: Column) -> Column:
        """All that is wrong with an entry itself."""
        path, node, value, kind = x["path"], x["node"], x["value"], x["kind"]
        fault = lambda when, text, at=path: F.when(when, F.array(F.struct(at.alias("path"), F.lit(text).alias("fault"))))
        none = F.lit(None).cast("boolean")
        allowed = lambda key, test, usable=lambda v: v is not None: F.coalesce(*[F.when(there, test(v)) for there, v in self._having(node, key, usable)], none) if self._having(node, key, usable) else none
        text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "decimal(38,0)")
        items, fields = F.try_variant_get(value, "$", "array<variant>"), F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        each = lambda names, said: F.transform(names, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit(said).alias("fault")))
        typed = F.array_contains(self._table(node, "type"), kind)
        strings, arrays, objects = kind == "string", kind == "array", kind == "object"
        found = [
            fault(strings & allowed("values", lambda v: ~text.isin(v)), "not one of the values allowed"),
            fault(strings & allowed("length", lambda v: F.length(text) < v), "too short"),
            fault(strings & allowed("pattern", lambda v: ~text.rlike("(?U)" + v if v == r"\S" else v)), "not of the form wanted"),
            fault((kind == "integer") & allowed("minimum", lambda v: number < v), "less than the minimum"),
            fault(arrays & allowed("least", lambda v: F.size(items) < v), "not enough items"),
            fault(arrays & allowed("unique", lambda v: F.size(F.array_distinct(F.transform(items, lambda e: F.to_json(e)))) < F.size(items) if v else F.lit(False)), "an item twice"),
            F.when(objects, each(F.array_except(self._table(node, "required", default=F.array().cast("array<string>")), fields), "missing")),
            F.when(objects, each(F.array_except(fields, self._table(node, "children", default=F.array().cast("array<string>"))), "unknown field")),
        ]
        wanted = F.concat(F.lit("wrong type, wanted "), F.array_join(self._table(node, "type"), " or "))
        wrong = F.array(F.struct(path.alias("path"), wanted.alias("fault")))
        empty = F.array().cast(FAULT)
        return F.when(typed, F.concat(*[F.coalesce(f, empty) for f in found])).otherwise(wrong)

    def children(self, x: Column) -> Column:
        """The entries below one; none below a value of the wrong type."""
        path, node, value, kind = x["path"], x["node"], x["value"], x["kind"]
        child = F.create_map(*[F.lit(y) for n, own in enumerate(self.nodes) for k, c in own["children"].items() for y in (f"{n}.{k}", c)]) if any(own["children"] for own in self.nodes) else F.create_map().cast("map<string,int>")
        of = lambda k: F.try_element_at(child, F.concat(node.cast("string"), F.lit("."), k))
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        fields = F.transform(F.filter(entries, lambda e: of(e["key"]).isNotNull()), lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), of(e["key"]).alias("node"), e["value"].alias("value"), kind_of(e["value"]).alias("kind")))
        item = F.lit(None).cast("int")
        for n, own in enumerate(self.nodes):
            if "item" in own:
                item = F.when(node == n, own["item"]).otherwise(item)
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), item.alias("node"), e.alias("value"), kind_of(e).alias("kind")))
        typed = F.array_contains(self._table(node, "type"), kind)
        return F.when(typed & (kind == "object"), fields).when(typed & (kind == "array") & item.isNotNull(), items).otherwise(F.array().cast(ENTRY))


def kind_of(value: Column) -> Column:
    """object, array, string, boolean, null, integer or number; a number beyond 64 bits counts as whole if it is equal to a whole one."""
    head = F.regexp_extract(F.schema_of_variant(value), r"^(\w+(?:\(\d+,0\))?)", 1)
    out = F.when(head.rlike(r"^DECIMAL\((?:19|[23]\d),0\)"), "integer").otherwise("number")
    for k, v in KINDS.items():
        out = F.when(head == k, v).otherwise(out)
    return out


def schema_findings(documents: DataFrame, key: str = "ledger_id", text_column: str = "json", schema: dict = LEDGER) -> DataFrame:
    """key, path, fault of each document; one that is no JSON, or has a field twice, has the fault unparseable at $.

    A document is a variant, which tells 1 from 1.0 and from true.  Its values
    are met level by level, as rows: nothing is shuffled, no document is held
    beyond its own row, and nothing leaves the JVM.
    """
    made = Compiled(schema)
    rows = documents.select(F.col(key).alias("__key"), F.try_parse_json(F.coalesce(F.col(text_column), F.lit(""))).alias("__0"))
    broken = rows.where("__0 IS NULL").select("__key", F.lit("$").alias("path"), F.lit("unparseable").alias("fault"))
    level = rows.where("__0 IS NOT NULL").select("__key", F.struct(F.lit("$").alias("path"), F.lit(made.root).alias("node"), F.col("__0").alias("value"), kind_of(F.col("__0")).alias("kind")).alias("x"))
    # each level's values as rows beside the faults of all levels above: one pass over the documents
    out = level.select("__key", "x", F.lit(None).cast(FAULT).alias("f"))
    for _ in range(made.depth):
        below = F.concat(F.transform(made.children(F.col("x")), lambda e: F.struct(e.alias("x"), F.lit(None).cast(FAULT).alias("f"))), F.array(F.struct(F.lit(None).cast(ENTRY[6:-1]).alias("x"), made.faults(F.col("x")).alias("f"))))
        done = F.array(F.struct(F.lit(None).cast(ENTRY[6:-1]).alias("x"), F.col("f").alias("f")))
        out = out.select("__key", F.explode(F.when(F.col("x").isNull(), done).otherwise(below)).alias("y")).select("__key", "y.x", "y.f")
    found = out.where("size(f) > 0").select("__key", F.explode("f").alias("g")).select("__key", "g.path", "g.fault")
    return broken.unionByName(found).withColumnRenamed("__key", key)
