"""Queries of the extractors, text functions and calls, over inputs that are made from the tables' rows.

Each row of ``part`` fills in a text: ``<k>`` is its key, ``<n>`` its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import annotate, canonical, diffing, search, versions
from ..sources import markdown, metadata, openapi, pysource
from ..sources.tables import json_rows, spread, table

from .catalog import build_items
from .queries import query


def _filled(template: str) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("<k>"), F.col("p_partkey").cast("string")), F.lit("<n>"), F.col("p_name"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    """What templates are filled with; dealt out before they are filled, while the rows are small."""
    return spread(table(s, d, "part").select("p_partkey", "p_name"))


def _files(s: SparkSession, d: str, template: str, file: str = "a.md", fork: str = "v1") -> DataFrame:
    return _parts(s, d).select(_filled(template).alias("content"), F.lit(fork).alias("fork"), F.lit(file).alias("file"))


def _joined(array: str, *names: str) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[F.coalesce(x[n].cast("string"), F.lit("")) for n in names])), "|").alias(array)


# sources

MD = """# Spec <k>

## Containers

### `Thing<k>`

Holds <n>.

```python
class Thing<k>(Container):
    slot: uint64
```

```python
class Second<k>(Container):
    a: b
```

### Helpers

```python
def help_<k>(x: int) -> int:
    return x
```

```python
@dataclass
class Data<k>:
    y: int
```
"""


@query("""with p as (select cast(p_partkey as varchar) as k, p_name as n from part)
select 'Thing' || k as name, 'class' as kind, 'class Thing' || k || '(Container):' || chr(10) || '    slot: uint64' as code, 'Holds ' || n || '.' as prose, 'Spec ' || k || ' > Containers > `Thing' || k || '`' as path, 10 as line_number from p
union all select 'help_' || k, 'def', 'def help_' || k || '(x: int) -> int:' || chr(10) || '    return x', null, 'Spec ' || k || ' > Containers > Helpers', 22 from p
union all select 'Data' || k, 'dataclass', '@dataclass' || chr(10) || 'class Data' || k || ':' || chr(10) || '    y: int', null, 'Spec ' || k || ' > Containers > Helpers', 27 from p""")
def markdown_definitions(s, d):
    return markdown.extract(_files(s, d, MD)).select("name", "kind", "code", "prose", F.array_join("section_path", " > ").alias("path"), "line_number")


TABLES = """# Types

## Custom types

| Name | SSZ equivalent | Description |
| - | - | - |
| `Slot<k>` | `uint64` | a slot of <n> |

## Constants

### Misc

| Name | Value |
| - | - |
| `LIMIT_<k>` | `<k>` |

## Notes

| Not | counted |
| - | - |
| `X<k>` | 1 |
"""


@query("select 'alias' as row, 'Slot' || p_partkey as name, 'uint64' as value, 'a slot of ' || p_name as description, null as category from part union all select 'constant', 'LIMIT_' || p_partkey, cast(p_partkey as varchar), null, 'constants' from part")
def markdown_tables(s, d):
    return markdown.extract(_files(s, d, TABLES)).select("row", "name", "value", "description", "category")


PYTHON = '''"""Module."""
LIMIT_<k>: int = <k>
"""A limit of <n>."""
Alias<k> = Bytes32
_HIDDEN = 1

@dataclass
class Thing<k>(Base):
    """Doc of <n>."""
    a: Uint
    """first"""
    b: Optional[Bytes]

def run_<k>(x: int, y: str = "z", *, w: bool = True) -> List[int]:
    """Runs. EIP-<k>."""
    return []
'''


@query("""with p as (select cast(p_partkey as varchar) as k, p_name as n from part)
select 'LIMIT_' || k as name, 'constant' as kind, 'A limit of ' || n || '.' as docstring, 'int' as type, k as value, null as fields, null as params, null as return_type, '' as eips, 2 as line_number from p
union all select 'Alias' || k, 'alias', null, null, 'Bytes32', null, null, null, '', 4 from p
union all select 'Thing' || k, 'dataclass', 'Doc of ' || n || '.', null, null, 'a:Uint:first|b:Optional[Bytes]:', null, null, '', 7 from p
union all select 'run_' || k, 'def', 'Runs. EIP-' || k || '.', null, null, null, 'x:int:|y:str:''z''|w:bool:True', 'List[int]', k, 14 from p""")
def python_definitions(s, d):
    files = _files(s, d, PYTHON, "src/fork/m.py").union(_files(s, d, PYTHON, "src/utils/m.py")).union(_files(s, d, PYTHON, "src/__main__.py"))
    return pysource.extract(files).select("name", "kind", "docstring", "type", "value", _joined("fields", "name", "type", "comment"), _joined("params", "name", "type", "default"), "return_type", F.array_join("eips", ",").alias("eips"), "line_number")


ROOT = """{"paths": {"/eth/v1/beacon/b<k>/{id}": {"get": {"operationId": "get<k>", "summary": "Get <n>", "tags": ["Beacon"],
"parameters": [{"name": "id", "in": "path", "required": true, "schema": {"type": "string"}}, {"name": "n", "in": "query", "schema": {"type": "array", "items": {"$ref": "#/x/Slot"}}}],
"responses": {"200": {"content": {"application/json": {"example": {"a": 1}, "schema": {"anyOf": [{"$ref": "#/c/Bellatrix.Bid"}, {"$ref": "#/c/Deneb.Bid"}]}}, "application/octet-stream": {}}}, "404": {"description": "no <n>"}}}},
"/y": {"$ref": "./paths/y.yaml#/here"}, "/z": {"$ref": "missing.yaml"}}}"""
ITEM = "post:\n  operationId: post<k>\n  requestBody:\n    content:\n      text/plain: {}\n  responses: {}\n"


def _documents(s: SparkSession, d: str, root: str, **files: str) -> DataFrame:
    pairs = [x for f, t in files.items() for x in (F.lit(f.replace("__", "/").replace("_", ".")), _filled(t))]
    return _parts(s, d).select(F.lit("api").alias("spec"), F.lit(root).alias("root"), F.lit("deneb").alias("fork"), F.create_map(*pairs).alias("files"))


@query("""select 'GET /eth/v1/beacon/b' || p_partkey || '/{id}' as key, 'GET' as method, 'get' || p_partkey as operation_id, 'Get ' || p_name as summary, 'beacon' as domain, 'id:path:string:true|n:query:List[Slot]:false' as parameters, 'bellatrix=Bellatrix.Bid,deneb=Deneb.Bid' as variants, 'application/json' as requests, 'application/json,application/octet-stream' as responses, true as ssz_support, true as has_examples, '404:no ' || p_name as errors, 'root.yaml' as source_file from part
union all select 'POST /y', 'POST', 'post' || p_partkey, null, 'other', '', null, 'text/plain', 'application/json', false, false, '', 'paths/y.yaml' from part""")
def openapi_endpoints(s, d):
    rows = openapi.extract(_documents(s, d, "root.yaml", root_yaml=ROOT, paths__y_yaml=ITEM))
    variants = F.array_join(F.transform(F.array_sort(F.map_entries("fork_variants")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("key", "method", "operation_id", "summary", "domain", _joined("parameters", "name", "in", "type", "required"), variants.alias("variants"), F.array_join("request_types", ",").alias("requests"), F.array_join("response_types", ",").alias("responses"), "ssz_support", "has_examples", _joined("errors", "code", "message"), "source_file")


SCHEMAS = """{"components": {"schemas": {"Base<k>": {"type": "object", "description": "of <n>", "required": ["a"], "properties": {"a": {"type": "string", "description": "first"}, "b": {"type": "array", "items": {"$ref": "#/components/schemas/Item"}}}},
"Block<k>Electra": {"allOf": [{"$ref": "#/components/schemas/Base<k>"}, {"properties": {"c": {"oneOf": [{"type": "string"}, {"type": "null"}]}}}]},
"Mode<k>": {"type": "string", "enum": ["x", "y"]}}}}"""


@query("""with p as (select cast(p_partkey as varchar) as k, p_name as n from part)
select 'Base' || k as name, 'class' as kind, 'of ' || n as description, 'a:string:true:first|b:List[Item]:false:' as fields, 'Item' as refs, 'class Base' || k || ':' || chr(10) || '    a: string' || chr(10) || '    b: List[Item]' as code from p
union all select 'Block' || k || 'Electra', 'class', null, 'c:string | null:false:', 'Base' || k, 'class Block' || k || 'Electra:' || chr(10) || '    c: string | null' from p
union all select 'Mode' || k, 'enum', null, '', '', 'Mode' || k || ' = string' from p""")
def openapi_types(s, d):
    rows = openapi.extract(_documents(s, d, "t.yaml", t_yaml=SCHEMAS), "types")
    return rows.select("name", "kind", "description", _joined("fields", "name", "type", "required", "comment"), F.array_join("references", ",").alias("refs"), "code")


@query("""with p as (select cast(p_partkey as varchar) as k from part)
select 'Base' || k as name, 'phase0' as fork, 'base' as domain from p union all select 'Block' || k || 'Electra', 'electra', 'block' from p union all select 'Mode' || k, 'phase0', 'other' from p""")
def flat_schema_versions(s, d):
    rows = openapi.extract(_documents(s, d, "t.yaml", t_yaml=SCHEMAS), "types")
    return rows.select("name", text.fork_from_suffix("name").alias("fork"), text.keyword_domain("name", {"block": "block", "base": "base"}).alias("domain"))


@query("""with f as (select p_partkey as k, f.fork, f.seq, f.t from part, (values ('paris', 0, 'A'), ('cancun', 1, 'A'), ('cancun', 1, 'B'), ('prague', 2, 'B')) f(fork, seq, t))
select 'T' || k || t as name, fork, seq = min(seq) over (partition by k, t) as is_new, seq > min(seq) over (partition by k, t) as is_modified from f""")
def type_schema_versions(s, d):
    """Named schemas, a folder a version: new where first seen, else modified."""
    def of(fork: str, seq: int, *names: str) -> DataFrame:
        schemas = ", ".join(f'"T<k>{n}": {{"type": "object", "properties": {{"v{seq}": {{"type": "string"}}}}}}' for n in names)
        docs = _documents(s, d, "t.yaml", t_yaml="{" + schemas + "}").withColumn("fork", F.lit(fork))
        return openapi.extract(docs, "types").withColumn("seq", F.lit(seq))

    rows = of("paris", 0, "A").union(of("cancun", 1, "A", "B")).union(of("prague", 2, "B"))
    return openapi.type_versions(rows, "seq").select("name", "fork", "is_new", "is_modified")


METHODS = """- name: engine_get<k>V2
  summary: <n>
  params: [{name: p, required: true, schema: {type: array, items: {type: string}}}]
  result: {schema: {oneOf: [{title: A}, {type: 'null'}]}}
  errors: [{code: -32000, message: bad}]
- name: engine_listedV1
  params: []
- name: eth_get<k>
  examples: [{}]
  params: []
"""


@query("""with p as (select cast(p_partkey as varchar) as k, p_name as n from part)
select 'engine_get' || k || 'V2' as key, 'engine' as domain, 'shanghai' as fork, n as summary, 'p:Array[string]:true' as parameters, 'A | null' as result_type, '-32000:bad' as errors, false as has_examples from p
union all select 'engine_listedV1', 'engine', 'cancun', null, '', null, '', false from p
union all select 'eth_get' || k, 'eth', 'paris', null, '', null, '', true from p""")
def openrpc_methods(s, d):
    rows = openapi.extract(_documents(s, d, "m.yaml", m_yaml=METHODS), "methods", {"engine_listedV1": "cancun"})
    return rows.select("key", "domain", F.array_join("tags", ",").alias("fork"), "summary", _joined("parameters", "name", "type", "required"), "result_type", _joined("errors", "code", "message"), "has_examples")


@query("select p_partkey as k, cast(p_partkey as varchar) as eip, 'a: ' || p_name as title, 'Final' as status, 'x, y' as author, 4 as n_keys from part")
def eip_frontmatter(s, d):
    m = metadata.frontmatter(_filled("---\neip: <k>\ntitle: a: <n>\nauthor: x, y\nstatus: Draft\nstatus: Final\n---\nbody: no\n"))
    rows = table(s, d, "part").select(F.col("p_partkey").alias("k"), m.alias("m"))
    return rows.select("k", *[F.col("m")[c].alias(c) for c in ("eip", "title", "status", "author")], F.size("m").alias("n_keys"))


CONFIG = "(select * from (values ('phase0', 0), ('altair', 1), ('bellatrix', 2), ('deneb', 3)) f(fork, fork_seq))"


@query(f"select * from {CONFIG} union all select 'z' || n_nationkey, 3 + row_number() over (order by 'z' || n_nationkey) from nation")
def forks_from_config(s, d):
    """phase0, then the configured versions by number, then other folders (one a nation) by name."""
    line = F.explode(F.split(F.lit("DENEB_FORK_VERSION: 0x04000000\nALTAIR_FORK_VERSION: 0x01000000\nGENESIS_FORK_VERSION: 0x00000000\nBELLATRIX_FORK_VERSION: 0x02000000\nX: 1"), "\n"))
    config = table(s, d, "region").filter("r_regionkey = 0").select(line.alias("line"))
    folders = table(s, d, "nation").select(F.explode(F.array(F.concat(F.lit("z"), "n_nationkey"), F.lit("_features"), F.lit("deneb"), F.lit("phase0"))).alias("fork"))
    return metadata.forks_from_config(config, folders)


@query("select n_name as fork, row_number() over (order by n_nationkey % 4, case when n_nationkey % 4 < 3 then -n_nationkey else 0 end, n_name) - 1 as fork_seq from nation")
def forks_from_criteria(s, d):
    """Block numbers, then timestamps, unscheduled ones, and missing criteria; within each by number, downwards by key here."""
    number = (1000 - F.col("n_nationkey")).cast("string")
    kind = F.col("n_nationkey") % 4
    init = F.when(kind == 0, F.concat(F.lit("FORK_CRITERIA = ByBlockNumber("), number, F.lit(")"))).when(kind == 1, F.concat(F.lit("ByTimestamp(timestamp="), number, F.lit(")"))).when(kind == 2, F.concat(F.lit("Unscheduled(order_index="), number, F.lit(")"))).otherwise("")
    return metadata.forks_from_criteria(table(s, d, "nation").select(F.col("n_name").alias("fork"), init.alias("init_text")))


@query("select 'engine_get' || (n_nationkey % 7) || 'V1' as method, arg_min(n_name, n_nationkey) as fork from nation group by 1")
def forks_from_headings(s, d):
    content = F.concat(F.lit("# T\n### engine_get"), F.col("n_nationkey") % 7, F.lit("V1\ntext engine_otherV1\n#### engine_deepV1\n"))
    return metadata.forks_from_headings(table(s, d, "nation").select(F.col("n_name").alias("fork"), F.col("n_nationkey").alias("fork_seq"), content.alias("content")))


@query("select p_partkey as k, case when p_partkey = 7 then '7' when p_partkey < 7 then p_partkey || ',7' else '7,' || p_partkey end as numbers, p_partkey % 3 <> 2 as touched from part")
def pull_request_facts(s, d):
    """Numbers that a title names, and whether its files lie under a specification's folders."""
    files = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("README.md"), _filled("specs/a<k>.md"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("src/spec"))).otherwise(F.array(F.lit("specs2/x.md"), F.lit("src/specs")))
    rows = table(s, d, "part").select(F.col("p_partkey").alias("k"), _filled("EIP-<k>, EIP7 and EIP-7: <n>").alias("title"), files.alias("files"))
    return rows.select("k", F.array_join(metadata.eip_numbers("title"), ",").alias("numbers"), metadata.touches("files", ["specs/", "src/spec"]).alias("touched"))


@query("select p_partkey as k, case p_partkey % 8 when 0 then 'specs/x' when 1 then 'a.yaml' when 2 then 'a/b.yml' when 3 then 'a/apis/b/' || p_partkey || '.yaml' when 4 then 'src/a/b.py' when 5 then 'x/y/OpenRPC.json' else p_partkey || '' end as path from part where p_partkey % 8 < 6")
def spec_files(s, d):
    """Specifications among changed files; hidden, deep and other files aren't."""
    m = F.col("p_partkey") % 8
    names = {0: "specs/x", 1: "a.yaml", 2: "a/b.yml", 3: "a/apis/b/<k>.yaml", 4: "src/a/b.py", 5: "x/y/OpenRPC.json", 6: ".ci/a.yml"}
    path = F.coalesce(*[F.when(m == i, _filled(n)) for i, n in names.items()], _filled("a/b/<k>.yaml"))
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), path.alias("path")).filter(metadata.is_spec_file("path"))


# functions

@query("""select p_partkey as k, 'https://h/o/r/blob/dev/specs/' || p_partkey || '.md#' || replace(p_name, ' ', '-') as url, 'x # [New in Deneb] y' as source, '# [New in Deneb]' as comments from part""")
def source_links(s, d):
    rows = table(s, d, "part").select("p_partkey", "p_name", F.lit("x # [New in Deneb] y").alias("source"))
    url = text.source_url(F.lit("https://h/o/r/blob/dev"), F.lit("specs"), F.concat("p_partkey", F.lit(".md")), anchor_=text.anchor("p_name"))
    return rows.select(F.col("p_partkey").alias("k"), url.alias("url"), "source", F.array_join(text.inline_comments("source"), ",").alias("comments"))


@query("""select p_partkey as k, case p_partkey % 6 when 0 then 'ruled' when 1 then 'helpers' when 2 then 'containers' when 3 then 'block-processing' when 4 then 'genesis' else 'default' end as domain from part""")
def section_domains(s, d):
    m = F.col("p_partkey") % 6
    sections = F.when(m == 1, F.array(F.lit("Containers"), F.lit("`Helper functions`"))).when(m == 2, F.array(F.lit("Modified containers"), F.lit("Thing"))).when(m == 3, F.array(F.lit("Beacon chain state transition function"))).when(m == 4, F.array(F.lit("Genesis block"))).otherwise(F.array(F.lit("Notes")))
    rows = table(s, d, "part").select("p_partkey", F.when(m == 0, "fork-choice.md").otherwise("x.md").alias("file"), sections.alias("sections"))
    return rows.select(F.col("p_partkey").alias("k"), text.section_domain("file", "sections", {"fork-choice.md": "ruled"}, {"containers": "containers", "helper functions": "helpers"}, "default").alias("domain"))


@query("""select p_partkey as k, case p_partkey % 7 when 0 then 'fork-meta' when 1 then 'a-b' when 2 then 'm' when 3 then 'vm-precompiles' when 4 then 'vm-instructions' when 5 then 'vm-gas' else 'a-b' end as domain from part""")
def path_domains(s, d):
    paths = F.array(*map(F.lit, ("__init__.py", "a/b/__init__.py", "m.py", "vm/precompiled_contracts/x.py", "vm/instructions/y.py", "vm/gas.py", "a/b/c.py")))
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), text.path_domain(paths[(F.col("p_partkey") % 7).cast("int")]).alias("domain"))


@query("""select p_partkey as k, p_partkey % 6 in (0, 3, 4) as is_new, p_partkey % 6 in (1, 2, 5) as is_modified from part""")
def change_statuses(s, d):
    m = F.col("p_partkey") % 6
    sections = F.when(m == 0, F.array(F.lit("New containers"))).when(m == 1, F.array(F.lit("Extended containers"))).otherwise(F.array(F.lit("Helpers")))
    heading = F.when(m == 2, "Modified `f`").otherwise("`f`")
    body = F.when(m == 4, "x  # [New in Deneb:EIP1]").when(m == 5, "x  # [Modified in Deneb]").otherwise("x")
    rows = table(s, d, "part").select("p_partkey", text.change_status(heading, sections, body, m == 3).alias("c"))
    return rows.select(F.col("p_partkey").alias("k"), "c.is_new", "c.is_modified")


CODE = "@dataclass\nclass Thing<k>(Base):\n    '''doc'''\n    # above\n    a: uint64  # of <n>\n    b: List[Slot, 4]\n\n    # lost\n\n    c: Bytes\n    def f(self): pass\n    d: no\n"


@query("select p_partkey as k, 'a:uint64:above; of ' || p_name || '|b:List[Slot, 4]:|c:Bytes:' as fields from part")
def code_fields(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), code.fields(_filled(CODE)).alias("fields")).select("k", _joined("fields", "name", "type", "comment"))


@query("select p_partkey as k, 'x:Dict[str, int]:|y:int:' || p_partkey || '|z::None' as params, 'Tuple[int, ...]' as return_type, 'Of ' || p_name || '.' as docstring, 'x: Dict[str, int]; y: int = ' || p_partkey || '; z=None' as parts from part")
def code_signatures(s, d):
    text_ = _filled('@x\ndef f(self, x: Dict[str, int], y: int = <k>, *, z=None) -> Tuple[int, ...]:\n    """Of <n>."""\n')
    parts = F.pandas_udf(lambda t: t.map(lambda x: "; ".join(p.strip() for p in code.split_params(x))), "string")
    rows = table(s, d, "part").select(F.col("p_partkey").alias("k"), code.signature(text_).alias("g"), parts(_filled("x: Dict[str, int], y: int = <k>, z=None")).alias("parts"))
    return rows.select("k", F.col("g.params").alias("params"), "g.return_type", "g.docstring", "parts").select("k", _joined("params", "name", "type", "default"), "return_type", "docstring", "parts")


@query("select p_partkey as k, 'Bytes32,Slot,Thing' || p_partkey as found, 'Slot' as known, 'Thing' || p_partkey as schema, 'a/b.yaml' as file, 'Slot' as plain from part")
def code_references(s, d):
    c = _filled("def f(x: Slot) -> Thing<k>:\n    '''Not Other'''\n    return Bytes32(MAX_LIMIT, Optional[Slot], None)")
    rows = table(s, d, "part").select("p_partkey", c.alias("c"), _filled("a/b.yaml#/x/Thing<k>").alias("ref"))
    return rows.select(F.col("p_partkey").alias("k"), F.array_join(text.references("c"), ",").alias("found"), F.array_join(text.references("c", F.array(F.lit("Slot"), F.lit("Epoch"))), ",").alias("known"), text.schema_name("ref").alias("schema"), text.ref_path("ref").alias("file"), text.plain_type(F.lit("List[Slot, 4]")).alias("plain"))


@query("select p_partkey as k, case when p_partkey % 2 = 0 then p_partkey end as number, 'a:List[x]|b:y' as signature, 'class T' || p_partkey || ':' || chr(10) || '    a: List[x]' || chr(10) || '    b: y' as pseudo, 'last-call' as status, case when length(p_name || repeat('x', 35)) > 40 then substr(p_name || repeat('x', 35), 1, 40) || '...' else p_name || repeat('x', 35) end as short, 'one' || chr(10) || 'two' as head, 3 as total_lines, true as truncated, 'curl -X POST -H ''Accept: text'' ''http://localhost:5052/eth/' || p_partkey || '/{other}''' as curl, p_name as q, 'b=' as r from part")
def shown_texts(s, d):
    rows = table(s, d, "part").select("p_partkey", "p_name", F.expr("array(named_struct('name', 'a', 'type', 'List[x]'), named_struct('name', 'b', 'type', 'y'))").alias("fields"))
    k = F.col("p_partkey").cast("string")
    url = F.concat(F.lit("#/type/x?q="), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("&empty=&=no&r=b%3D&s=1=2"))
    curl = text.curl(F.lit("post"), F.lit("http://localhost:5052"), F.concat(F.lit("/eth/"), k, F.lit("/{other}")), {"id": "1"}, {"Accept": "text"})
    lines = text.first_lines(F.lit("one\ntwo\nthree"), 2)
    number = text.pull_number(F.concat(F.when(F.col("p_partkey") % 2 == 0, "pr-").otherwise("x"), k)).cast("long")
    return rows.select(
        F.col("p_partkey").alias("k"), number.alias("number"), text.fields_signature("fields").alias("signature"), text.pseudo_code(F.concat(F.lit("T"), k), "fields").alias("pseudo"), text.status_class(F.lit("Last  Call")).alias("status"),
        text.shortened(F.concat("p_name", F.lit("x" * 35))).alias("short"), lines["text"].alias("head"), lines["total_lines"].alias("total_lines"), lines["truncated"].alias("truncated"), curl.alias("curl"), text.url_params(url)["q"].alias("q"), text.url_params(url)["r"].alias("r"),
    )


@query("""select p_partkey as k, replace('{"k":' || p_partkey || ',"name":"' || p_name || '"' || case when p_partkey % 2 = 0 then ',"tags":["a"]' else '' end || '}', ' ', ' ') as json from part""")
def compact_json(s, d):
    """Rows as JSON without empty texts, empty arrays and nulls."""
    return json_rows(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.lit("").alias("note"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit(None).cast("int").alias("none"))).select(F.get_json_object("json", "$.k").cast("long").alias("k"), "json")


@query("select * from (select n_name as fork, row_number() over (order by case when n_nationkey % 3 = 0 then n_nationkey end nulls last, n_name) as place from nation where n_nationkey % 5 <> 0)")
def ordered_versions(s, d):
    """Known versions by place, unknown ones after them by name, hidden ones left out."""
    n = table(s, d, "nation").select(F.col("n_name").alias("fork"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey")).alias("seq"), (F.col("n_nationkey") % 5 == 0).alias("hidden"))
    rows = versions.ordered_forks(n, "fork", "seq", "hidden")
    return rows.withColumn("place", versions.place("fork", "seq").cast("long")).select("fork", "place")


@query("select conv_id, turn <= 2 and role <> '' as here from (select conv_id, min(turn) as turn, min(role) as role from conversations where len(text) % 2 = 0 group by 1) where turn <= 2")
def content_at_version(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", (F.length("text") % 2 == 0).alias("there"))
    return versions.has_content(c, ["conv_id"], "turn", 2, F.col("there")).withColumn("here", F.lit(True))


# browsing

@query("select p_partkey as k from part where contains(lower(p_partkey || ' eip-' || p_partkey || ' ' || p_name || ' ' || p_brand), 'eip-1') ")
def filter_eips(s, d):
    p = table(s, d, "part")
    hay = [F.col("p_partkey"), F.concat(F.lit("eip-"), F.col("p_partkey")), F.col("p_name"), F.col("p_brand")]
    return p.filter(search.any_contains(hay, "EIP-1")).select(F.col("p_partkey").alias("k"))


@query("select p_partkey as k from part where contains('#' || p_partkey, '#1') or contains(cast(p_partkey as varchar), '#1') or contains(lower(p_name), '#1')")
def filter_pull_requests(s, d):
    hay = [F.col("p_partkey"), F.concat(F.lit("#"), F.col("p_partkey")), F.col("p_name")]
    return table(s, d, "part").filter(search.any_contains(hay, "#1")).select(F.col("p_partkey").alias("k"))


@query("select p_type as value, count(*) as n, row_number() over (order by count(*) desc, p_type) as place from part group by 1")
def facets_by_count(s, d):
    from ..operators import facets

    return facets.by_count(table(s, d, "part"), "p_type").select("value", "n", F.col("place").cast("long").alias("place"))


@query("select (select count(*) from (select 1 from part where p_size > 10 limit 30)) as shown, (select greatest(count(*) - 30, 0) from part where p_size > 10) as overflow, (select min(p_partkey) from part where p_size > 10) as first")
def capped_list(s, d):
    shown, more = search.capped(table(s, d, "part").filter("p_size > 10"), ["p_partkey"], 30)
    return shown.agg(F.count(F.lit(1)).alias("shown"), F.min("p_partkey").alias("first")).crossJoin(more).select("shown", "overflow", "first")


@query("select p_partkey as k, p_name as name, 0 as score from part")
def ranked_without_query(s, d):
    """All by name where nothing is asked for."""
    return search.ranked(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "name", "").select("k", "name", F.col("score").cast("int").alias("score"))


@query("select o_custkey as pr, (list(n order by n))[1:3] :: varchar as names, count(*) as n_all from (select distinct o_custkey, o_orderpriority as n from orders) group by 1")
def first_names(s, d):
    """The first three names of each, and in words how many more there are."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("pr"), F.col("o_orderpriority").alias("n")).distinct()
    rows = o.groupBy("pr").agg(F.array_sort(F.collect_set("n")).alias("all")).withColumn("some", diffing.first_names(F.col("all"), 3))
    more = F.when(F.size("all") > 3, F.concat(F.lit("and "), F.size("all") - 3, F.lit(" more")))
    wrong = F.when(more.isNotNull(), F.element_at("some", -1) != more).otherwise(F.col("all") != F.col("some"))
    return rows.select("pr", F.concat(F.lit("["), F.array_join(F.slice("some", 1, 3), ", "), F.lit("]"), F.when(wrong, "wrong").otherwise("")).alias("names"), F.size("all").cast("long").alias("n_all"))


# annotations, merging and overlays

@query("""with t as (select p_partkey % 20 as number, p_name as name, case p_size % 3 when 0 then 'class' when 1 then 'def' else 'other' end as kind, p_brand as spec, case when p_partkey % 2 = 0 then 'new' else 'modified' end as change, p_size as seq from part),
o as (select number, name, spec, change, min(kind) as kind, min(seq) as seq from t group by all)
select number, 'v' || min(seq) as fork, string_agg(name || '/' || kind || '/' || spec || '/' || change, ',' order by case kind when 'class' then 0 when 'def' then 1 else 2 end, name, spec, change) as items, count(*) filter (where change = 'new') as n_new, count(*) filter (where change = 'modified') as n_modified, count(*) as n_total, string_agg(distinct spec, ',' order by spec) as specs from o group by 1""")
def eip_items(s, d):
    p = table(s, d, "part").select((F.col("p_partkey") % 20).alias("number"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "def").otherwise("other").alias("kind"), F.col("p_brand").alias("spec"), F.when(F.col("p_partkey") % 2 == 0, "new").otherwise("modified").alias("change"), F.col("p_size").alias("fork_seq"), F.concat(F.lit("v"), "p_size").alias("fork"))
    out = annotate.item_lists(p)
    items = F.array_join(F.transform("items", lambda x: F.concat_ws("/", x["name"], x["kind"], x["spec"], x["change"])), ",")
    return out.select("number", "fork", items.alias("items"), "n_new", "n_modified", "n_total", F.array_join("specs", ",").alias("specs"))


@query("select p_type as fork, row_number() over (order by min((p_size, p_partkey))) - 1 as seq from part group by 1")
def fork_axis(s, d):
    rows = table(s, d, "part").select(F.col("p_size").alias("source_rank"), F.col("p_type").alias("fork"), F.col("p_partkey").alias("fork_seq"))
    return annotate.fork_axis(rows).select("fork", F.col("seq").cast("long").alias("seq"))


@query("""with v as (select p_name as name, p_type as fork, p_partkey as rank, case when p_size % 3 = 0 then 'code' || p_partkey end as code, case when p_size % 2 = 0 then 'prose' || p_partkey end as prose from part)
select name, fork, arg_min(coalesce(code, ''), rank) as code, coalesce(arg_min(prose, rank) filter (where prose is not null), '') as prose from v group by 1, 2""")
def merge_versions(s, d):
    """Versions of one item from several sources: missing versions come along, prose is filled in, code never is."""
    p = table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("fork"), F.col("p_partkey").alias("rank"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("code"), "p_partkey")).alias("code"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("prose"), "p_partkey")).alias("prose"))
    out = canonical.merge_sources(p.select("name", "fork", "rank", F.coalesce("code", F.lit("")).alias("code"), "prose"), ["name", "fork"], F.col("rank"), fill=["prose"], keep=["code"])
    return out.select("name", "fork", "code", F.coalesce("prose", F.lit("")).alias("prose"))


@query("select n_name as source, case n_nationkey % 8 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 5 when 5 then 6 when 6 then 7 else 99 end as priority from nation")
def source_priorities(s, d):
    names = F.array(*map(F.lit, ("consensus-specs", "execution-specs", "x/builder-specs", "relay-specs", "beacon-APIs", "execution-apis", "remote-signing-api", "other")))
    return table(s, d, "nation").select(F.col("n_name").alias("source"), canonical.priority_of(names[F.col("n_nationkey") % 8]).alias("priority"))


@query("""select 'T' || p_partkey as name, case p_partkey % 6 when 0 then 'added' when 1 then 'removed' else 'modified' end as action, case when p_partkey % 6 in (0, 2) then 'b' else '' end as fields_added, case when p_partkey % 6 = 1 then 'a' else '' end as fields_removed, case when p_partkey % 6 = 3 then 'a' else '' end as fields_modified, p_partkey % 6 in (0, 1, 4) as code_changed, p_partkey % 6 = 5 as params_changed,
case p_partkey % 6 when 0 then 'added, +1 field' when 1 then 'removed, -1 field' when 2 then 'modified, +1 field' else 'modified' end as summary from part where p_partkey % 7 <> 6""")
def index_changes(s, d):
    """Fields, code and parameters of a changed index against the mainline; the keys that 7 leaves 6 of stay as they are."""
    m, same = F.col("p_partkey") % 6, F.col("p_partkey") % 7 == 6

    def fields(*names: str) -> Column:
        return F.expr("array(" + ", ".join(f"named_struct('name', '{n[0]}', 'type', '{n[1:]}', 'comment', '')" for n in names) + ")")

    p = table(s, d, "part").select("p_partkey", F.concat(F.lit("T"), "p_partkey").alias("name"), m.alias("m"), same.alias("same"))
    none = F.expr("cast(array() AS array<string>)")
    old = p.filter("same OR m <> 0").select("name", fields("aint").alias("fields"), F.lit("code").alias("code"), none.alias("params"))
    pick = F.when(~F.col("same") & (F.col("m") == 2), fields("aint", "bint")).when(~F.col("same") & (F.col("m") == 0), fields("bint")).when(~F.col("same") & (F.col("m") == 3), fields("astr")).otherwise(fields("aint"))
    new = p.filter("same OR m <> 1").select("name", pick.alias("fields"), F.when(~F.col("same") & (F.col("m") == 4), "other").otherwise("code").alias("code"), F.when(~F.col("same") & (F.col("m") == 5), F.array(F.lit("x"))).otherwise(none).alias("params"))
    out = diffing.index_diff(old, new, ["name"])
    return out.select("name", "action", *[F.array_join(c, ",").alias(c) for c in ("fields_added", "fields_removed", "fields_modified")], "code_changed", "params_changed", diffing.change_summary(F.col("action"), F.col("fields_added"), F.col("fields_removed")).alias("summary"))


RULED = """# Core

## Containers

### `Thing<k>`

```python
class Thing<k>(Container):
    slot: uint64  # [New in Deneb:EIP<k>]
```

## Helpers

### Modified `run_<k>`

```python
def run_<k>(x: Thing<k>, y: int = 1) -> Slot:
    return x.slot
```
"""


@query("""select 'Thing' || p_partkey as name, 'class' as kind, 'containers' as domain, 'slot:uint64:[New in Deneb:EIP' || p_partkey || ']' as fields, '' as params, '' as return_type, 'new/' || p_partkey || '/deneb' as tags, true as is_new, true as marked_new, false as marked_modified, 'https://h/core.md#thing' || p_partkey as github_url from part
union all select 'run_' || p_partkey, 'def', 'helpers', '', 'x:Thing' || p_partkey || ':|y:int:1', 'Slot', '', true, false, true, 'https://h/core.md#modified-run_' || p_partkey from part""")
def built_items(s, d):
    """Definitions of markdown files as the catalog's versions, with all that is read out of them."""
    forks = s.createDataFrame([("v1", 0)], "fork string, fork_seq int")
    items = build_items(markdown.extract(_files(s, d, RULED, "core.md")), forks, "core", {}, {"containers": "containers", "helpers": "helpers"}, "https://h")
    tags = F.array_join(F.transform("eips", lambda e: F.concat_ws("/", e["change"], e["number"].cast("string"), e["fork"])), ",")
    return items.select("name", "kind", "domain", _joined("fields", "name", "type", "comment"), _joined("params", "name", "type", "default"), "return_type", tags.alias("tags"), "is_new", "marked_new", "marked_modified", "github_url")


@query("select p_partkey as k, case p_partkey % 3 when 0 then 'Slot' || p_partkey when 1 then 'Slot' || p_partkey else 'uint64' end as plain, case when p_partkey % 3 <> 2 and p_partkey % 2 = 0 then 'core' end as spec from part")
def type_links(s, d):
    """The spec that defines a type, its generics stripped."""
    m = F.col("p_partkey") % 3
    p = table(s, d, "part").select("p_partkey", text.plain_type(F.when(m == 0, _filled("List[Slot<k>, 4]")).when(m == 1, _filled("Optional[Slot<k>]")).otherwise("uint64")).alias("plain"))
    items = table(s, d, "part").filter("p_partkey % 2 = 0").select(_filled("Slot<k>").alias("plain"), F.lit("core").alias("spec"))
    return p.join(items, "plain", "left").select(F.col("p_partkey").alias("k"), "plain", "spec")


@query("""select page_id, '{"method":"GET","path":"' || url || '"' || case when page_id % 2 = 0 then ',"tags":["a"]' else '' end || case when page_id % 3 = 0 then ',"has_examples":true' else '' end || '}' as json from pages""")
def slim_endpoints(s, d):
    """An endpoint's shown columns as JSON: empty ones left out, the path from the key where it is missing."""
    p = table(s, d, "pages").select("page_id", F.lit("GET").alias("method"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("path"), F.col("url").alias("key"), F.lit("").alias("summary"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("tags"), (F.col("page_id") % 3 == 0).alias("has_examples"))
    return search.slim(p, ["method", "path", "summary", "tags"]).select("page_id", "json")


@query("select n_nationkey as k, n_nationkey % 4 in (2, 3) as badge from nation")
def status_badges(s, d):
    forks = F.array(*map(F.lit, ("deneb", "osaka", "gloas", "eip1")))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k"), text.undeployed(forks[F.col("n_nationkey") % 4]).alias("badge"))


@query("select p_type as name, min(p_partkey) as introduced, coalesce(arg_min(p_brand, p_partkey) filter (where p_size % 3 <> 0), 'other') as domain from part group by 1")
def introduced_domains(s, d):
    """Where an item is first seen, and its first domain that says anything."""
    p = table(s, d, "part").withColumn("domain", F.when(F.col("p_size") % 3 == 0, "other").otherwise(F.col("p_brand")))
    return versions.first_domain(p, ["p_type"], "p_partkey", "domain").withColumnRenamed("p_type", "name")


@query("select p_type as name, arg_max(coalesce(case when p_size % 2 = 0 then p_name end, ''), p_partkey) as value, '' as note, arg_max(p_brand, p_partkey) as section from part group by 1")
def normalized_constants(s, d):
    """The last version of a constant or alias, with empty texts for what it lacks."""
    p = table(s, d, "part").select(F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("value"), F.lit(None).cast("string").alias("note"), F.col("p_brand").alias("section"), "p_partkey")
    return versions.normalized(p, ["name"], F.col("p_partkey"), ["value", "note", "section"])


@query("""select p_partkey as k, case p_partkey % 2 when 0 then 'curl \\' || chr(10) || '  ''http://localhost:18550/eth/head/<x>?id=' || p_partkey || '''' else 'curl \\' || chr(10) || '  -X POST \\' || chr(10) || '  ''http://localhost:5052/eth/' || p_partkey || ''' \\' || chr(10) || '  -H ''Content-Type: application/json'' \\' || chr(10) || '  -H ''Accept: application/json'' \\' || chr(10) || '  -d ''{...}''' || chr(10) || chr(10) || '# For SSZ: -H ''Accept: application/octet-stream''' end as command from part""")
def request_commands(s, d):
    even = F.col("p_partkey") % 2 == 0
    path = F.when(even, "/eth/{block_id}/{x}").otherwise(_filled("/eth/<k>"))
    command = text.request_command(F.when(even, "GET").otherwise("POST"), F.when(even, "builder-specs").otherwise("unknown"), path, {}, F.when(even, F.concat(F.lit("id="), "p_partkey")), ~even, ~even)
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), command.alias("command"))


@query("""select p_partkey as k, case p_partkey % 3 when 0 then 3 when 1 then 3 else 2 end :: bigint as n_equal, case p_partkey % 3 when 2 then 1 else 0 end :: bigint as n_change, case p_partkey % 3 when 1 then 1 else 0 end :: bigint as n_remove, case p_partkey % 3 when 0 then 0 else 1 end :: bigint as n_add from part""")
def line_steps(s, d):
    """Nothing changed; a line gone and another at the end; a line changed, another at the end; lines are compared stripped."""
    m = F.col("p_partkey") % 3
    old = F.when(m == 1, _filled("one\n<k>\n<n>\nx")).otherwise(_filled("one\n<k>\n<n>"))
    new = F.when(m == 0, _filled(" one\n<k> \n<n>")).when(m == 1, _filled("<k>\n<n>\nx\nnew")).otherwise(_filled("one\n<k> changed\n<n>\nnew"))
    rows = table(s, d, "part").select(F.col("p_partkey").alias("k"), diffing.counted(diffing.line_diff(old, new)).alias("x"))
    return rows.select("k", "x.*")


@query("""select p_partkey as k, case p_partkey % 3 when 0 then ' one| ' || p_partkey || '| ' || p_name when 1 then '-one| ' || p_partkey || '| ' || p_name || '| x|+new' else ' one|-' || p_partkey || '|+' || p_partkey || ' changed| ' || p_name || '|+new' end as unified,
case p_partkey % 3 when 0 then 'one> one|' || p_partkey || '>' || p_partkey || ' |' || p_name || '>' || p_name when 1 then 'one>|' || p_partkey || '>' || p_partkey || '|' || p_name || '>' || p_name || '|x>x|>new' else 'one>one|' || p_partkey || '>' || p_partkey || ' changed|' || p_name || '>' || p_name || '|>new' end as sides, '+' || p_name as whole from part""")
def shown_diffs(s, d):
    """The texts of line_steps as marked lines and side by side; a text that had none before is added as a whole."""
    m = F.col("p_partkey") % 3
    old = F.when(m == 1, _filled("one\n<k>\n<n>\nx")).otherwise(_filled("one\n<k>\n<n>"))
    new = F.when(m == 0, _filled(" one\n<k> \n<n>")).when(m == 1, _filled("<k>\n<n>\nx\nnew")).otherwise(_filled("one\n<k> changed\n<n>\nnew"))
    rows = table(s, d, "part").select("p_name", F.col("p_partkey").alias("k"), old.alias("old"), new.alias("new"))
    sides = F.transform(diffing.side_by_side(F.col("old"), F.col("new")), lambda x: F.concat_ws(">", F.coalesce(x["left"], F.lit("")), F.coalesce(x["right"], F.lit(""))))
    marked, whole = diffing.unified(F.col("old"), F.col("new")), diffing.unified(F.lit(None).cast("string"), F.col("p_name"))
    return rows.select("k", F.array_join(marked, "|").alias("unified"), F.array_join(sides, "|").alias("sides"), F.array_join(whole, "|").alias("whole"))


@query("""with t as (select p_partkey as k, lower(p_name) as s from part), c as (select k, s, unnest(range(0, length(s))) as i from t), v as (select k, s, i, s[i + 1] as ch, 1 + (case when i = 0 then 5 else 0 end) + greatest(0, 10 - i) as v from c),
a as (select x.k, max(x.v - x.i * 0.5 + y.v + case when y.i = x.i + 1 then 12 else -(y.i - x.i - 1) * 0.5 end + z.v + case when z.i = y.i + 1 and y.i = x.i + 1 then 18 else -(z.i - y.i - 1) * 0.5 end - 0.6 * length(x.s)) as score from v x join v y on x.k = y.k and y.i > x.i and y.ch = 'd' join v z on z.k = y.k and z.i > y.i and z.ch = 'g' where x.ch = 'o' group by 1)
select t.k, case when instr(s, 'odg') > 0 then 10000 - (instr(s, 'odg') - 1) * 10 - length(s) else round(cast(a.score as double), 6) end :: double as score from t left join a on a.k = t.k where instr(s, 'odg') > 0 or a.score is not null""")
def fuzzy_alignments(s, d):
    """Best alignments of three characters, against all ways to place them."""
    from ..functions import fuzzy

    return table(s, d, "part").select(F.col("p_partkey").alias("k"), F.round(fuzzy.fuzzy_score("p_name", "odg"), 6).alias("score")).filter("score IS NOT NULL")


@query("select p_partkey as k, 'x &lt;<mark>' || 'a</mark>&gt; b <mark>c</mark> ' || p_partkey as html from part")
def fuzzy_marks(s, d):
    from ..functions import fuzzy

    return table(s, d, "part").select(F.col("p_partkey").alias("k"), fuzzy.fuzzy_highlight(_filled("x <a> b c <k>"), "ac").alias("html"))


@query(f"select fork, fork_seq from {CONFIG} union all select 'z', 4 union all select '_features/' || n_name, 4 + row_number() over (order by '_features/' || n_name) from nation where n_nationkey < 5")
def fork_chain(s, d):
    """Configured versions, other folders, then features."""
    line = F.explode(F.split(F.lit("ALTAIR_FORK_VERSION: 0x01000000\nBELLATRIX_FORK_VERSION: 0x02000000\nDENEB_FORK_VERSION: 0x04000000"), "\n"))
    config = table(s, d, "region").filter("r_regionkey = 0").select(line.alias("line"))
    folders = s.createDataFrame([("phase0",), ("z",), ("_features",)], "fork string")
    return metadata.forks_of(config, folders, table(s, d, "nation").filter("n_nationkey < 5").select(F.col("n_name").alias("fork")))


@query("select p_partkey as k, 10000 - (instr(lower(p_name), 'cold') - 1) * 10 - length(p_name) :: double as score from part where contains(lower(p_name), 'cold')")
def ranked_types(s, d):
    """Names that have the query, best first; what only has its characters in order is left out here."""
    rows = search.ranked(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "name", "cold")
    return rows.filter(F.lower("name").contains("cold")).select("k", "score")
