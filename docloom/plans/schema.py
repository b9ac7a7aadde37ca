"""JSON schemas: compiled to Spark types, validated, fixed. Metadata only, no rows."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: JSON-schema type -> target type -> Spark type (fixed values). Both spellings are accepted.
TARGET = {"string": "string", "integer": "int", "int": "int", "number": "float", "float": "float", "boolean": "bool", "bool": "bool", "array": "array", "object": "object"}
SPARK = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}
#: Names that are reserved, and faults that need a migration (fixed values).
RESERVED = ("class", "function", "import", "client", "prompt")
NEEDS_MIGRATION = {"UNSUPPORTED_TYPE", "MISSING_TYPE", "MISSING_PROPERTIES", "MISSING_ARRAY_ITEMS", "INVALID_PROPERTY_DEFINITION"}
#: Code -> (fix, migration) (fixed values).
FIXES = {
    "MISSING_TYPE": ("Add 'type' field specifying the data type (string, int, float, bool, array, object)", "ADD_TYPE_FIELD"),
    "MISSING_PROPERTIES": ("Add 'properties' field with object property definitions", "ADD_PROPERTIES_FIELD"),
    "UNSUPPORTED_TYPE": ("Replace with a supported type: string, int, float, bool, array, or object", "CONVERT_TYPE"),
    "MISSING_ARRAY_ITEMS": ("Add 'items' property defining the type of array elements", "ADD_ARRAY_ITEMS"),
}
ISSUE = "severity string, code string, field_path string, message string, fix string, migration string"


def pascal(name: str) -> str:
    return "".join(p.capitalize() for p in name.replace("-", "_").split("_") if p)


@dataclass
class Field:
    name: str
    kind: str
    optional: bool


@dataclass
class Class:
    name: str
    fields: list[Field] = field(default_factory=list)

    def signature(self) -> str:
        """Name and sorted fields: equal structures are one class."""
        return f"{self.name}|" + ",".join(sorted(f"{f.name}:{f.kind}" for f in self.fields))

    def code(self) -> str:
        return f"class {self.name} {{\n" + "".join(f"  {f.name} {f.kind}{'?' if f.optional else ''}\n" for f in self.fields) + "}"


def check(schema: dict) -> None:
    """Raises unless it is an object schema with properties."""
    if not isinstance(schema, dict):
        raise ValueError("a schema is a JSON object")
    if schema.get("type") != "object" or not isinstance(schema.get("properties"), dict):
        raise ValueError("a schema has type 'object' and properties")


def spark_type(spec: dict) -> T.DataType:
    """The Spark type of a property; unknown types are strings."""
    kind = TARGET.get(str(spec.get("type", "string")).lower(), "string")
    if kind == "object":
        return compiled(spec) if spec.get("properties") else T.MapType(T.StringType(), T.StringType())
    if kind == "array":
        return T.ArrayType(spark_type(spec.get("items") or {}))
    return SPARK[kind]


def compiled(schema: dict) -> T.StructType:
    """A JSON schema as a StructType; a field not in ``required`` is nullable."""
    need = set(schema.get("required", ()))
    return T.StructType([T.StructField(n, spark_type(p if isinstance(p, dict) else {}), n not in need) for n, p in schema.get("properties", {}).items()])


def classes(schema: dict, root: str | None = None) -> list[Class]:
    """Named classes of a schema, nested ones first; the root is named by its title."""
    out: dict[str, Class] = {}

    def kind_of(name: str, spec: dict) -> str:
        kind = TARGET.get(str(spec.get("type", "string")).lower(), "string")
        if kind == "object":
            return walk(pascal(name), spec) if spec.get("properties") else "map<string, string>"
        if kind == "array":
            items = spec.get("items") or {}
            return (walk(f"{pascal(name)}Item", items) if TARGET.get(items.get("type")) == "object" and items.get("properties") else kind_of(name, items)) + "[]"
        return kind

    def walk(name: str, spec: dict) -> str:
        need = set(spec.get("required", ()))
        made = Class(name, [Field(n, kind_of(n, p), n not in need) for n, p in spec.get("properties", {}).items()])
        out.setdefault(made.signature(), made)
        return name

    walk(root or pascal(schema.get("title", "ExtractedData")), schema)
    return list(out.values())


def code(schema: dict) -> str:
    return "\n\n".join(c.code() for c in classes(schema))


def function_name(schema: dict) -> str:
    return f"Extract{pascal(schema.get('title', 'ExtractedData'))}"


def fields(schema: dict, spark: SparkSession) -> DataFrame:
    """(class_name, field_name, field_type, optional) of a schema."""
    rows = [(c.name, f.name, f.kind, f.optional) for c in classes(schema) for f in c.fields]
    return spark.createDataFrame(rows, "class_name string, field_name string, field_type string, optional boolean")


def expected(schema: dict, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The tables that validation joins: (path, type) of the top level, and (field) of what is required."""
    types = [(n, str((p or {}).get("type", "string"))) for n, p in schema.get("properties", {}).items()]
    return spark.createDataFrame(types, "path string, type string"), spark.createDataFrame([(r,) for r in schema.get("required", ())], "field string")


# Metrics.


def depth(schema: dict, at: int = 0) -> int:
    inner = [depth(p, at + 1) for p in schema.get("properties", {}).values() if isinstance(p, dict) and p.get("type") == "object"]
    return max([at, *inner])


def each(schema, path: str = "$"):
    """Every definition below a schema, with its path: properties and array items."""
    if isinstance(schema, dict):
        yield path, schema
        if isinstance(schema.get("properties"), dict):
            for n, p in schema["properties"].items():
                yield from each(p, f"{path}.{n}")
        if isinstance(schema.get("items"), dict):
            yield from each(schema["items"], f"{path}.items")


def field_count(schema: dict) -> int:
    return sum(len(s["properties"]) for _, s in each(schema) if isinstance(s.get("properties"), dict))


def complexity(schema: dict) -> int:
    own = {"object": 2, "array": 3}
    return sum(own.get(s.get("type"), 0) + len(s.get("properties") or ()) for _, s in each(schema))


def repeats_reference(obj, seen: frozenset = frozenset()) -> bool:
    """Does a ``$ref`` stand below itself?"""
    if not isinstance(obj, dict):
        return False
    if "$ref" in obj:
        if obj["$ref"] in seen:
            return True
        seen = seen | {obj["$ref"]}
    return any(repeats_reference(v, seen) for v in obj.values())


def uses(obj, names: tuple = ("pattern", "format", "const", "enum")) -> bool:
    return isinstance(obj, dict) and (any(n in obj for n in names) or any(uses(v, names) for v in obj.values()))


# Validation.


@dataclass
class Report:
    level: str
    issues: list[tuple]
    migration_required: bool
    effort: str

    def codes(self) -> set[str]:
        return {i[1] for i in self.issues}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.issues, ISSUE)


def members(schema: dict, path: str = "$"):
    """(path, name, definition) of every property below a schema, through objects and array items."""
    props = schema.get("properties")
    for n, p in props.items() if isinstance(props, dict) else ():
        at = f"{path}.properties.{n}"
        yield at, n, p
        if isinstance(p, dict):
            if p.get("type") == "object":
                yield from members(p, at)
            elif p.get("type") == "array" and isinstance(p.get("items"), dict) and p["items"].get("type") == "object":
                yield from members(p["items"], f"{at}.items")


def _unknown(spec) -> bool:
    return isinstance(spec, dict) and bool(spec.get("type")) and spec["type"] not in TARGET


#: Checks of a property: severity, code, what is wrong, end of the path, test of (name, definition).
#: Severities and codes are fixed values.
PROPERTY_CHECKS = [
    ("error", "INVALID_PROPERTY_DEFINITION", "no object", "", lambda n, p: not isinstance(p, dict)),
    ("error", "UNSUPPORTED_TYPE", "unknown type", ".type", lambda n, p: _unknown(p)),
    ("error", "MISSING_ARRAY_ITEMS", "array without items", ".items", lambda n, p: isinstance(p, dict) and p.get("type") == "array" and "items" not in p),
    ("error", "UNSUPPORTED_ARRAY_ITEM_TYPE", "unknown type of items", ".items.type", lambda n, p: isinstance(p, dict) and p.get("type") == "array" and _unknown(p.get("items"))),
    ("warning", "EMPTY_OBJECT_DEFINITION", "object without properties", "", lambda n, p: isinstance(p, dict) and p.get("type") == "object" and p.get("properties") is None),
    ("error", "INVALID_NESTED_PROPERTIES", "properties that are no object", ".properties", lambda n, p: isinstance(p, dict) and p.get("type") == "object" and not isinstance(p.get("properties", {}), (dict, type(None)))),
    ("warning", "RESERVED_KEYWORD_PROPERTY", "reserved name", "", lambda n, p: isinstance(p, dict) and n.lower() in RESERVED),
    ("warning", "INVALID_PROPERTY_NAME", "odd name", "", lambda n, p: isinstance(p, dict) and not re.match(r"^[a-zA-Z][a-zA-Z0-9_]*$", n)),
]
#: Checks of a whole schema: severity, code, what is wrong, path, test.
SCHEMA_CHECKS = [
    ("error", "MISSING_TYPE", "no type", "$", lambda s: "type" not in s),
    ("error", "MISSING_PROPERTIES", "no properties", "$", lambda s: "properties" not in s),
    ("error", "INVALID_PROPERTIES_TYPE", "properties that are no object", "$.properties", lambda s: not isinstance(s.get("properties", {}), dict)),
    ("warning", "EXCESSIVE_NESTING_DEPTH", "over 10 levels", "$", lambda s: depth(s) > 10),
    ("warning", "POTENTIAL_CIRCULAR_REFERENCE", "a reference to itself", "$", lambda s: repeats_reference(s)),
    ("warning", "EXCESSIVE_FIELD_COUNT", "over 100 fields", "$", lambda s: field_count(s) > 100),
    ("info", "HIGH_COMPLEXITY_SCHEMA", "a complexity over 50", "$", lambda s: complexity(s) > 50),
    ("warning", "UNSUPPORTED_SCHEMA_VERSION", "a draft after 7", "$.$schema", lambda s: any(int(x) > 7 for x in re.findall(r"draft-(\d+)", str(s.get("$schema", "")))[:1])),
    ("info", "ADVANCED_FEATURES_DETECTED", "pattern, format, const or enum", "$", lambda s: bool(uses(s))),
]


def _large(spec: dict) -> bool:
    items = spec.get("items")
    return spec.get("type") == "array" and isinstance(items, dict) and items.get("type") == "object" and len(items.get("properties") or ()) > 10


def validated(schema) -> Report:
    """Issues of a schema and how compatible it is."""
    if not isinstance(schema, dict):
        found = [("critical", "INVALID_SCHEMA_TYPE", "$", "no object")]
    else:
        found = [(*c[:2], at + c[3], c[2]) for at, n, p in members(schema) for c in PROPERTY_CHECKS if c[4](n, p)]
        found += [("warning", "LARGE_ARRAY_OBJECTS", at, "items of over 10 properties") for at, s in each(schema) if _large(s)]
        found += [(c[0], c[1], c[3], c[2]) for c in SCHEMA_CHECKS if c[4](schema)]
    n = {s: sum(f[0] == s for f in found) for s in ("critical", "error", "warning")}
    worst = next((s for s in n if n[s]), None)
    level = {"critical": "incompatible", "error": "limited_compatibility", "warning": "compatible_with_warnings", None: "fully_compatible"}[worst]
    effort = "high" if n["critical"] or n["error"] > 5 else "medium" if n["error"] or n["warning"] > 10 else "low"
    issues = [(*f[:3], f"{f[2]}: {f[3]}", *FIXES.get(f[1], (None, None))) for f in found]
    return Report(level, issues, any(f[1] in NEEDS_MIGRATION for f in found), "high" if n["critical"] else effort)


def fixed(schema: dict) -> tuple[dict, list[str]]:
    """A fixed copy of a schema and what was done: type, array items, type names, reserved names."""
    out, done = copy.deepcopy(schema), []
    if "type" not in out:
        out["type"] = "object"
        done.append("added type")
    renamed = {"integer": "int", "number": "float", "boolean": "bool", "null": "string"}
    for path, s in list(each(out)):
        if s.get("type") == "array" and "items" not in s:
            s["items"] = {"type": "string"}
            done.append(f"added items at {path}")
        if s.get("type") in renamed:
            done.append(f"type {s['type']} to {renamed[s['type']]} at {path}")
            s["type"] = renamed[s["type"]]
        if isinstance(s.get("properties"), dict):
            for n in [n for n in s["properties"] if n.lower() in RESERVED]:
                s["properties"] = {(f"{k}_value" if k == n else k): v for k, v in s["properties"].items()}
                done.append(f"renamed {n} at {path}")
    return out, done


def migration_plan(report: Report) -> list[dict]:
    """Steps that bring a schema to full compatibility, in order of severity."""
    order = {"critical": 0, "error": 1, "warning": 2, "info": 3}
    return [
        {"step": n, "code": i[1], "field_path": i[2], "migration": i[5], "automatic": i[5] is not None}
        for n, i in enumerate(sorted(report.issues, key=lambda i: order[i[0]]), 1)
    ]


# Functions that ask a model for a schema's fields.

#: Strategies by the marks of a schema (fixed values).
STRATEGIES = {
    "table": (["table", "row", "cell", "column"], 3, ["row", "cell", "header", "column"]),
    "invoice": (["invoice", "vendor", "customer", "line", "total"], 2, ["amount", "total", "price", "quantity"]),
    "form": (["form", "field", "input", "checkbox"], 2, []),
    "spatial": (["position", "coordinate", "spatial", "location"], 2, ["position", "x", "y", "width", "height"]),
}
HINTS = {
    "general": "Read all visible text.",
    "table": "Keep rows, columns and headers in their structure.",
    "invoice": "Read amounts, totals and line items with precision.",
    "form": "Read each label with its value.",
    "spatial": "Keep positions and relationships of elements.",
}


def complexity_class(made: list[Class]) -> str:
    names = {c.name for c in made}
    score = sum((2 if "[]" in f.kind else 0) + (1 if f.kind in names else 0) + (3 if re.search("row|cell", f.name.lower()) else 0) for c in made for f in c.fields)
    for name, most, limit in (("simple", 2, 3), ("moderate", 4, 10), ("complex", 8, 20)):
        if len(made) <= most and score < limit:
            return name
    return "advanced"


def strategy(made: list[Class], hint: str | None = None) -> str:
    """What a prompt should stress, by the names of classes and fields."""
    if hint and hint.lower() in HINTS:
        return hint.lower()
    points = dict.fromkeys(STRATEGIES, 0)
    for c in made:
        for name, (class_marks, weight, field_marks) in STRATEGIES.items():
            points[name] += weight * any(m in c.name.lower() for m in class_marks) + sum(any(m in f.name.lower() for m in field_marks) for f in c.fields)
    best = max(points.values())
    return next(n for n, p in points.items() if p == best) if best >= 3 else "general"


def client_for(level: str) -> str:
    return {"simple": "CustomHaiku", "moderate": "CustomSonnet4", "complex": "CustomOpus4", "advanced": "CustomGPT5"}[level]


def prompt(made: list[Class], how: str) -> str:
    names = ", ".join(f.name for f in made[-1].fields)
    return f'{{{{ _.role("user") }}}}\nExtract the target fields from the document.\nTarget fields: {names}\nInstructions: {HINTS[how]}\n{{{{ document_images }}}}\n{{{{ ctx.output_format }}}}'


def function(schema: dict, hints: dict | None = None) -> dict:
    """Name, client, strategy and prompt of the function that fills a schema."""
    check(schema)
    made = classes(schema)
    level, how = complexity_class(made), strategy(made, (hints or {}).get("optimization_strategy"))
    return {
        "name": function_name(schema), "params": ["document_images"], "return_type": made[-1].name,
        "client": (hints or {}).get("client") or client_for(level), "complexity": level, "strategy": how, "prompt": prompt(made, how),
    }


def function_issues(f: dict) -> tuple[list[str], list[str], float]:
    """Issues, warnings and score of a function."""
    issues = [f"missing {k}" for k in ("name", "params", "return_type", "client", "prompt") if not f.get(k)]
    text = f.get("prompt") or ""
    marks = ['{{ _.role("user") }}', "{{ document_images }}", "{{ ctx.output_format }}"]
    lacking = [m for m in marks if m not in text]
    warnings = [f"missing {m}" for m in lacking]
    warnings += ["brief prompt"] * (text.count("\n") < 4) + ["no word for extraction"] * ("extract" not in text.lower())
    issues += ["short prompt"] * (len(text) < 20) + ["no template element"] * (len(lacking) == 3)
    low = text.lower()
    bonus = 5 * sum([("target fields" in low), ("instructions" in low), bool(re.search("table|structure|relationship", low)), bool(re.search("precision|accurate", low))])
    return issues, warnings, max(0.0, min(100.0, 100.0 - 20 * len(issues) - 5 * len(warnings) + bonus))
