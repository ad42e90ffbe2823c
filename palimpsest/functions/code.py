"""Parsers of definitions, as batched functions: fields of a class, signature of a function, types of a schema."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "array<struct<name:string,type:string,comment:string>>"
SIGNATURE = "struct<params:array<struct<name:string,type:string,`default`:string>>,return_type:string,docstring:string>"
_FIELD = re.compile(r"(\w+)\s*:\s*([^#]+?)\s*(?:#\s*(.*))?$")


def parse_fields(code: str | None) -> list[dict]:
    """``name: type  # comment`` lines of a class body; comment lines right before a field go with it.

    A blank or other line drops what was gathered, the first method ends the fields.
    """
    out: list[dict] = []
    above: list[str] = []
    inside = False
    for line in map(str.strip, (code or "").split("\n")):
        if line.startswith(("class ", "@")):
            inside = True
        elif not inside or line.startswith(('"""', "'''")):
            continue
        elif line.startswith("def "):
            break
        elif line.startswith("#"):
            above.append(line[1:].strip())
        else:
            if found := _FIELD.match(line):
                name, kind, comment = found.groups()
                out.append({"name": name, "type": kind, "comment": "; ".join([*above, *([comment.strip()] if comment else [])])})
            above = []
    return out


def split_params(text: str) -> list[str]:
    """Parts between commas outside all brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]] if text[start:].strip() else parts


def parse_signature(code: str | None) -> dict:
    """Parameters, return type and docstring of the first function, from its syntax tree; empty if it doesn't parse."""
    empty = {"params": [], "return_type": "", "docstring": ""}
    lines = (code or "").split("\n")
    start = next((i for i, x in enumerate(lines) if x.strip().startswith(("def ", "async def "))), None)
    if start is None:
        return empty
    indent = len(lines[start]) - len(lines[start].lstrip())
    text = "\n".join(x[indent:] if not x[:indent].strip() else x for x in lines[start:])
    for attempt in (text, text + "\n    pass", text.split("\n\n")[0] + "\n    pass"):
        try:
            f = next(n for n in ast.parse(attempt).body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
        except (SyntaxError, StopIteration):
            continue
        a = f.args
        plain = [*a.posonlyargs, *a.args]
        defaults: list = [None] * (len(plain) - len(a.defaults)) + a.defaults
        rows = [*zip(plain, defaults, strict=True), *zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        show = lambda n: "" if n is None else ast.unparse(n)
        params = [{"name": p.arg, "type": show(p.annotation), "default": None if d is None else show(d)} for p, d in rows if p.arg not in ("self", "cls")]
        return {"params": params, "return_type": show(f.returns), "docstring": ast.get_docstring(f) or ""}
    return empty


def schema_type(schema: object, array: str = "List") -> str:
    """A readable type of a JSON schema: references by name, arrays with their element, unions with bars."""
    if not isinstance(schema, dict):
        return str(schema)
    if "$ref" in schema:
        return schema["$ref"].rsplit("/", 1)[-1]
    kind = schema.get("type")
    if kind == "array" and "items" in schema:
        return f"{array}[{schema_type(schema['items'], array)}]"
    if kind:
        return " | ".join(kind) if isinstance(kind, list) else kind
    for key, mark in (("anyOf", " | "), ("oneOf", " | "), ("allOf", " & ")):
        if key in schema:
            return mark.join(schema_type(s, array) for s in schema[key])
    return schema.get("title", "unknown")


def schema_fields(schema: object) -> tuple[list[dict], list[str]]:
    """Fields and references of a schema, also of those that it is composed of."""
    fields: list[dict] = []
    refs: set[str] = set()
    open_ = [schema]
    while open_:
        s = open_.pop(0)
        if not isinstance(s, dict):
            continue
        if "$ref" in s:
            refs.add(schema_type(s))
        for name, f in (s.get("properties") or {}).items():
            required = name in (s.get("required") or [])
            fields.append({"name": name, "type": schema_type(f), "comment": f.get("description", "") if isinstance(f, dict) else "", "required": required})
            refs |= {m.rsplit("/", 1)[-1] for m in re.findall(r'"\$ref": "([^"]+)"', json.dumps(f))}
        open_ += [x for k in ("allOf", "oneOf", "anyOf") for x in s.get(k) or []]
        if isinstance(s.get("items"), dict):
            open_.append(s["items"])
    return fields, sorted(refs)


def _batched(f, kind: str):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    def frame(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(x) for x in s], columns=["params", "return_type", "docstring"])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    frame.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return lambda c: F.pandas_udf(frame if kind.startswith("struct") else run, kind)(c)


def fields(code: Column | str) -> Column:
    return _batched(parse_fields, FIELDS)(code)


def signature(code: Column | str) -> Column:
    return _batched(parse_signature, SIGNATURE)(code)


def type_of_schema(schema_json: Column | str) -> Column:
    return _batched(lambda t: None if t is None else schema_type(json.loads(t)), "string")(schema_json)
