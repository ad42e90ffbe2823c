"""Endpoints, methods and types of OpenAPI and OpenRPC documents (YAML or JSON), as rows."""

from __future__ import annotations

import functools
import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame

from ..functions.code import schema_fields, schema_type
from .tables import ENDPOINT, FIELDS

VERBS = ("get", "post", "put", "delete", "patch")
TYPE = f"name string, kind string, fork string, file string, description string, fields {FIELDS}, references array<string>, code string"
#: Fork of the n-th version of a method; later versions have the last.
FORK_OF_VERSION = ("paris", "shanghai", "cancun", "prague", "osaka", "amsterdam")


#: Where JSON isn't surely read as YAML reads it: odd characters, code points as escapes, a key apart from its colon.
_NOT_AS_YAML = re.compile(r"[^\n\r -~\xa0-\u2027\u202a-\ud7ff]|\\u|[\n\r ]{2}:|[\n\r]:")
_YAML_FLOAT = re.compile(r"-?\d+\.\d+(?:[eE][-+]\d+)?")


def _float(number: str) -> float:
    if not _YAML_FLOAT.fullmatch(number):
        raise ValueError(number)  # YAML reads 1e5 as a text
    return float(number)


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    if any(len(k) > 500 for k, _ in pairs):
        raise ValueError("YAML takes no key of over 1024 characters")
    return dict(pairs)


def _constant(name: str) -> None:
    raise ValueError(name)  # YAML reads NaN as a text


_JSON = json.JSONDecoder(object_pairs_hook=_pairs, parse_float=_float, parse_constant=_constant)


def _from_json(text: str) -> dict | list | None:
    """The document, where it is JSON that means the same in YAML."""
    if not text.lstrip(" \r\n").startswith(("{", "[")) or _NOT_AS_YAML.search(text):
        return None
    try:
        return _JSON.decode(text)
    except (ValueError, RecursionError):
        return None


_QUICK = getattr(yaml, "CSafeLoader", None)


def _alike(text: str) -> bool:
    """Whether libyaml accepts no more than PyYAML: it takes tabs, marks of byte order, and question marks within brackets."""
    bracket = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=len(text))
    return "\t" not in text and "\ufeff" not in text and text.find("?", bracket) < 0


def load(text: str | None) -> dict | list:
    """The document, or an empty one if it is missing or broken.

    What holds is ``yaml.safe_load``, which takes milliseconds a page; JSON that it reads alike is decoded as such, and
    libyaml reads texts that both read alike. What libyaml refuses is up to ``yaml.safe_load``.
    """
    text = text or ""
    if (found := _from_json(text)) is not None:
        return found or {}
    if _QUICK and _alike(text):
        try:
            return yaml.load(text, Loader=_QUICK) or {}
        except (yaml.YAMLError, ValueError):
            pass
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError:
        return {}


def _names(schema: str) -> list[str]:
    return [c.split()[0].strip("`") for c in re.split(r", (?=[\w`]+ )", schema)]


def fork_variants(schema: dict) -> dict[str, str]:
    refs = [x["$ref"].rsplit("/", 1)[-1] for k in ("anyOf", "oneOf") for x in schema.get(k) or [] if isinstance(x, dict) and "$ref" in x]
    return {r.split(".")[0].lower(): r for r in refs if "." in r}


def endpoint(path: str, verb: str, op: dict, file: str, shared: list) -> tuple:
    """One row of ENDPOINT, without the spec."""
    request = (op.get("requestBody") or {}).get("content") or {}
    good = next((r for code, r in (op.get("responses") or {}).items() if str(code).startswith("2") and isinstance(r, dict)), {})
    response = good.get("content") or {}
    schemas = [c.get("schema") or {} for c in [*request.values(), *response.values()] if isinstance(c, dict)]
    data = [((s.get("properties") or {}).get("data") or {}) for s in schemas]
    variants = {k: v for s in [*schemas, *data] for k, v in fork_variants(s).items()}
    text = op.get("description") or ""
    binary = "application/octet-stream" in [*request, *response] or "octet-stream" in text or "SSZ" in text
    params = [{"name": p.get("name"), "in": p.get("in"), "type": schema_type(p.get("schema") or {}), "required": bool(p.get("required")), "description": p.get("description")} for p in [*shared, *(op.get("parameters") or [])] if isinstance(p, dict) and "name" in p]
    errors = [{"code": str(c), "message": (r or {}).get("description") if isinstance(r, dict) else None} for c, r in (op.get("responses") or {}).items() if not str(c).startswith("2")]
    shown = any("example" in c or "examples" in c for c in [*request.values(), *response.values()] if isinstance(c, dict))
    tags = op.get("tags") or []
    return (f"{verb.upper()} {path}", verb.upper(), path, op.get("operationId"), op.get("summary"), text or None, tags, tags[0].lower() if tags else "other", params, variants or None, [*request] or ["application/json"], [*response] or ["application/json"], binary, shown, errors, schema_type((next(iter(response.values()), {}) or {}).get("schema") or {}) if response else None, file)


def parse(documents: dict[str, str], root: str) -> Iterator[tuple]:
    """Rows of the document ``root``; path items may refer to other files by relative path, unresolved ones are skipped."""
    loaded = functools.cache(lambda name: load(documents.get(name)))  # many paths may refer to one file
    for path, item in (loaded(root).get("paths") or {}).items():
        file = root
        if isinstance(item, dict) and "$ref" in item:
            file = posixpath.normpath(posixpath.join(posixpath.dirname(root), item["$ref"].split("#")[0]))
            item = loaded(file)
        for verb in VERBS:
            if isinstance(item, dict) and isinstance(item.get(verb), dict):
                yield endpoint(path, verb, item[verb], file, item.get("parameters") or [])


def parse_methods(text: str, file: str, fork_of: dict[str, str]) -> Iterator[tuple]:
    """Rows of a list of JSON-RPC methods; a method's fork is the listed one, else that of its version."""
    found = load(text)
    for m in found if isinstance(found, list) else found.get("methods") or []:
        name = m.get("name") if isinstance(m, dict) else None
        if not name:
            continue
        version = re.search(r"V(\d+)$", name)
        fork = fork_of.get(name) or FORK_OF_VERSION[min(int(version[1]) - 1, len(FORK_OF_VERSION) - 1) if version else 0]
        params = [{"name": p.get("name"), "in": "params", "type": schema_type(p.get("schema") or {}, "Array"), "required": bool(p.get("required")), "description": p.get("description")} for p in m.get("params") or []]
        errors = [{"code": str(e.get("code")), "message": e.get("message")} for e in m.get("errors") or [] if isinstance(e, dict)]
        result = (m.get("result") or {}).get("schema") or {}
        yield (name, "RPC", name, name, m.get("summary"), m.get("description"), [fork], name.split("_")[0], params, None, ["application/json"], ["application/json"], False, bool(m.get("examples")), errors, schema_type(result, "Array") if result else None, file)


def parse_types(text: str, file: str, fork: str, kind: str = "class") -> Iterator[tuple]:
    """Rows of named schemas: of components.schemas, of namespaces of types, or of a flat map."""
    found = load(text)
    schemas = (found.get("components") or {}).get("schemas") or found if isinstance(found, dict) else {}
    open_ = [*schemas.items()]
    while open_:
        name, schema = open_.pop(0)
        if not isinstance(schema, dict):
            continue
        if not {"type", "properties", "allOf", "oneOf", "anyOf", "$ref", "enum", "items", "title"} & schema.keys():
            open_ = [(f"{name}.{k}", v) for k, v in schema.items()] + open_
            continue
        fields, refs = schema_fields(schema)
        code = "\n".join([f"class {name}:", *(f"    {f['name']}: {f['type']}" for f in fields)]) if fields else f"{name} = {schema_type(schema)}"
        yield (name, "enum" if "enum" in schema else kind, fork, file, schema.get("description"), fields, refs, code)


def type_versions(rows: DataFrame, seq: str) -> DataFrame:
    """Types over the versions that list them: new where a name is first seen, else modified; rows without a name go.

    One pass over the rows: a join with the first versions would parse the documents twice.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    first = F.min(seq).over(Window.partitionBy("name"))
    return rows.filter("name IS NOT NULL").withColumn("__first", first).withColumns({"is_new": F.col(seq) == F.col("__first"), "is_modified": F.col(seq) > F.col("__first")}).drop("__first")


def extract(documents: DataFrame, part: str = "paths", fork_of: dict[str, str] | None = None) -> DataFrame:
    """Rows of documents (spec, root, files): ``files`` maps paths to texts, so references resolve within a row.

    ``part`` is paths (endpoints), methods (JSON-RPC) or types.
    """
    schema = TYPE if part == "types" else ENDPOINT

    def rows(spec: str, root: str, fork: str, files: dict[str, str]) -> Iterator[tuple]:
        if part == "types":
            yield from parse_types(files.get(root), root, fork)
        else:
            for r in parse(files, root) if part == "paths" else parse_methods(files.get(root), root, fork_of or {}):
                yield (spec, *r)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for s, o, k, f in zip(b["spec"], b["root"], b["fork"], b["files"], strict=True) for r in rows(s, o, k, json.loads(f))]
            yield pd.DataFrame(found, columns=_names(schema))

    from pyspark.sql import functions as F

    return documents.select("spec", "root", "fork", F.to_json("files").alias("files")).mapInPandas(run, schema)
