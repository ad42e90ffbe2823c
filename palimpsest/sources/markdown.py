"""Definitions, constants and aliases of markdown specifications: one task a batch of files, rows out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "row string, fork string, file string, name string, kind string, code string, prose string, value string, description string, section_path array<string>, category string, line_number int"
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_DEF = re.compile(r"^(?:@[^\n]*\n)*(class|def)\s+(\w+)", re.M)
_RULE = re.compile(r"^[\s|:\-]*-[\s|:\-]*$")


def _cells(line: str) -> list[str]:
    return [c.strip().strip("`").strip() for c in line.strip().strip("|").split("|")]


def _kind(code: str) -> tuple[str, str | None]:
    found = _DEF.search(code)
    if not found:
        return "other", None
    return ("dataclass" if code.lstrip().startswith("@dataclass") else found[1]), found[2]


def parse(content: str, fork: str, file: str) -> Iterator[tuple]:
    """Rows of one file.

    A heading opens a section that ends at the next heading. A heading with a name in backticks takes its section's
    first python block only; other sections give a row for each block that defines something. Prose is the text
    between heading and first block, tables and lone tags apart. Tables of sections of type names give aliases (three
    cells at least), those of constants, presets and configuration give constants; heading and rule rows don't count.
    """
    path: dict[int, str] = {}
    sections: list[tuple[int, str, list[str], int, list[str]]] = []
    fence = False
    for number, line in enumerate((content or "").split("\n"), 1):
        if line.lstrip().startswith("```"):
            fence = not fence
        head = None if fence else _HEADING.match(line)
        if head:
            level = len(head[1])
            path = {k: v for k, v in path.items() if k < level} | {level: head[2]}
            sections.append((level, head[2], [path[k] for k in sorted(path)], number, []))
        elif sections:
            sections[-1][4].append(line)
    for _level, title, where, number, lines in sections:
        body = "\n".join(lines)
        blocks = [m for m in re.finditer(r"^```python\s*\n(.*?)^```", body, re.M | re.S)]
        before = body[: blocks[0].start()] if blocks else body
        prose = "\n".join(x for x in before.split("\n") if not x.lstrip().startswith("|") and not re.fullmatch(r"\s*\*?\[(New|Modified) in [^\]]+\]\*?\s*", x))
        prose = re.sub(r"\n{3,}", "\n\n", prose).strip()
        named = re.search(r"`([^`]+)`", title)
        line, counted = number + 1, 0
        for block in blocks[:1] if named else blocks:
            line, counted = line + body.count("\n", counted, block.start(1)), block.start(1)
            code = block[1].rstrip()
            kind, own = _kind(code)
            name = re.sub(r"\(.*", "", named[1]) if named else own
            if name:
                yield ("definition", fork, file, name, kind, code, prose or None, None, None, where, None, line)
        if "```" in body and blocks:
            before = body[: blocks[0].start()]
        table = [x for x in before.split("\n") if x.lstrip().startswith("|")]
        rows = [_cells(x) for x in table[1:] if not _RULE.match(x)]
        low = [w.lower() for w in where]
        if any(re.search(r"\b(custom types|types|aliases)\b", w) and "domain types" not in w for w in low[-1:]):
            for r in rows:
                if len(r) >= 3 and r[0]:
                    yield ("alias", fork, file, r[0], "alias", None, None, r[1], r[2], where, None, number)
        elif any(w.startswith(k) for w in low for k in ("constants", "preset", "configuration")):
            category = next((k for w in low for k in ("constants", "preset", "configuration") if w.startswith(k)), None)
            for r in rows:
                if len(r) >= 2 and r[0]:
                    yield ("constant", fork, file, r[0], "constant", None, None, r[1], r[2] if len(r) > 2 else None, where, category, number)


def extract(files: DataFrame) -> DataFrame:
    """Rows of files (fork, file, content); each file is parsed in one go, files spread over tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for c, k, f in zip(b["content"], b["fork"], b["file"], strict=True) for r in parse(c, k, f)], columns=names)

    return files.select("content", "fork", "file").mapInPandas(run, SCHEMA)
