"""Definitions of Python sources, from their syntax trees."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "row string, fork string, file string, name string, kind string, code string, docstring string, type string, value string, fields array<struct<name:string,type:string,comment:string>>, params array<struct<name:string,type:string,`default`:string>>, return_type string, eips array<int>, line_number int"


#: Where Python ends a line; form feeds and the like don't.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")


def annotation(node: ast.AST | None) -> str:
    """The node's source as ``ast.unparse`` has it, which is slow: names and what is made of names are put together here."""
    if node is None:
        return ""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return f"{annotation(node.value)}.{node.attr}"
    if isinstance(node, ast.Subscript) and all(isinstance(x, (ast.Name, ast.Attribute)) for x in (node.value, node.slice)):
        return f"{annotation(node.value)}[{annotation(node.slice)}]"
    return ast.unparse(node)


def segment(lines: list[str], node: ast.AST) -> str:
    """``ast.get_source_segment`` over lines that were split once; places in a line count its bytes."""
    first, last = node.lineno - 1, node.end_lineno - 1
    cut = lambda line, a, b: line[a:b] if line.isascii() else line.encode()[a:b].decode()
    if first == last:
        return cut(lines[first], node.col_offset, node.end_col_offset)
    return "".join([cut(lines[first], node.col_offset, None), *lines[first + 1 : last], cut(lines[last], 0, node.end_col_offset)])


def _docs_after(body: list[ast.stmt], i: int) -> str:
    """A string that stands alone right after a statement documents it."""
    n = body[i + 1] if i + 1 < len(body) else None
    return n.value.value.strip() if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) else ""


def parse(source: str, fork: str, file: str) -> Iterator[tuple]:
    """Top-level classes, functions, constants (upper case) and aliases; private names and broken files give none."""
    source = source or ""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    lines, plain_lines = _LINE.findall(source), source.split("\n")
    for i, n in enumerate(tree.body):
        code = segment(lines, n)
        eips = sorted({int(x) for x in re.findall(r"EIP-?(\d+)", code)})
        if isinstance(n, ast.ClassDef) and not n.name.startswith("_"):
            data = any(annotation(d).split("(")[0].endswith("dataclass") for d in n.decorator_list)
            first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            code = "\n".join(plain_lines[first - 1 : n.end_lineno])
            fields = [{"name": x.target.id, "type": annotation(x.annotation), "comment": _docs_after(n.body, k)} for k, x in enumerate(n.body) if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
            yield ("definition", fork, file, n.name, "dataclass" if data else "class", code, ast.get_docstring(n), None, None, fields, None, None, eips, first)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not n.name.startswith("_"):
            plain = [*n.args.posonlyargs, *n.args.args]
            defaults = [None] * (len(plain) - len(n.args.defaults)) + [*n.args.defaults]
            both = [*zip(plain, defaults, strict=True), *zip(n.args.kwonlyargs, n.args.kw_defaults, strict=True)]
            params = [{"name": a.arg, "type": annotation(a.annotation), "default": None if d is None else annotation(d)} for a, d in both]
            yield ("definition", fork, file, n.name, "def", code, ast.get_docstring(n), None, None, None, params, annotation(n.returns), eips, n.lineno)
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            target = n.targets[0] if isinstance(n, ast.Assign) and len(n.targets) == 1 else getattr(n, "target", None)
            if not isinstance(target, ast.Name) or target.id.startswith("_") or n.value is None:
                continue
            kind = annotation(n.annotation) if isinstance(n, ast.AnnAssign) else ""
            constant = re.fullmatch(r"[A-Z][A-Z0-9_]*", target.id) is not None
            alias = not constant and target.id[:1].isupper() and isinstance(n.value, (ast.Name, ast.Attribute, ast.Subscript, ast.BinOp))
            if constant or alias:
                yield ("constant" if constant else "alias", fork, file, target.id, "constant" if constant else "alias", code, _docs_after(tree.body, i) or None, kind or None, segment(lines, n.value), None, None, None, eips, n.lineno)


def extract(files: DataFrame) -> DataFrame:
    """Rows of files (fork, file, content), dunder files and ``utils/`` apart."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMA)]
        for b in batches:
            yield pd.DataFrame([r for c, k, f in zip(b["content"], b["fork"], b["file"], strict=True) for r in parse(c, k, f)], columns=names)

    return files.filter(r"NOT file RLIKE '(^|/)utils/|(^|/)__\\w+__\\.py$'").select("content", "fork", "file").mapInPandas(run, SCHEMA)
