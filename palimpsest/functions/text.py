"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that look like type names in code but aren't.
NOT_TYPES = "True False None Optional List Tuple Dict Set Union Final Literal Type Callable Any ClassVar Sequence Mapping Iterator Iterable Protocol ABC Override The This If For When Each All Not Returns Parameters See Also New Modified Note However Since After Before Given Total Maximum Minimum Base Pre Post Output Input Data Value Index Length Arbitrary Running Introduced Constructed Difficulty Nonce Timestamp Address".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(x: Column | str) -> Column:
    """Camel case, underscores, hyphens and letter case don't matter for a match."""
    return F.translate(F.lower(F.regexp_replace(_c(x), "([a-z])([A-Z])", "$1_$2")), "_-", "")


def anchor(x: Column | str) -> Column:
    """A heading's slug."""
    return F.regexp_replace(F.translate(F.lower(_c(x)), " `", "-"), r"[^a-z0-9_\-]", "")


def source_url(base: Column | str, *parts: Column | str, anchor_: Column | None = None) -> Column:
    url = F.concat_ws("/", _c(base), *[_c(p) for p in parts])
    return url if anchor_ is None else F.concat(url, F.lit("#"), anchor_)


def tags(x: Column | str) -> Column:
    """All change tags ``[New in ...]`` and ``[Modified in ...]`` of a text, as written."""
    return F.regexp_extract_all(_c(x), F.lit(r"\[(?:New|Modified) in [^\]]+\]"), F.lit(0))


def inline_comments(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"#\s*\[(?:New|Modified) in \w+\]"), F.lit(0))


def annotations(x: Column | str) -> Column:
    """Change, number and version of every annotation: a tag may name a version (else null) and several numbers."""
    named = lambda t: F.nullif(F.lower(F.regexp_extract(t, r"^\[\w+ in (?!EIP)([^:\]]+)", 1)), F.lit(""))
    per_tag = F.transform(
        tags(x),
        lambda t: F.transform(
            F.regexp_extract_all(t, F.lit(r"EIP-?(\d+)"), F.lit(1)),
            lambda n: F.struct(F.lower(F.regexp_extract(t, r"^\[(\w+)", 1)).alias("change"), n.cast("int").alias("number"), named(t).alias("fork")),
        ),
    )
    return F.array_distinct(F.flatten(per_tag))


def change_status(heading: Column, sections: Column, code: Column, is_first: Column) -> Column:
    """(is_new, is_modified) from, in this order, the sections, the heading, the first version, the tags in the code.

    Tags are read to their closing bracket, so one that also names a number counts.
    """
    def among(*words: str) -> Column:
        return F.exists(sections, lambda s: F.lower(s).rlike("|".join(words)))

    def both(new: bool | Column, modified: bool | Column) -> Column:
        wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(wrap(new).alias("is_new"), wrap(modified).alias("is_modified"))

    new, modified = code.rlike(r"(?i)\[New in [^\]]+\]"), code.rlike(r"(?i)\[Modified in [^\]]+\]")
    return (
        F.when(among("new containers", "new dataclasses"), both(True, False))
        .when(among("modified containers", "modified dataclasses", "extended containers"), both(False, True))
        .when(F.lower(heading).contains("modified"), both(False, True))
        .when(is_first | ~(new | modified), both(True, False))
        .otherwise(both(new, modified))
    )


def type_tokens(x: Column | str) -> Column:
    """Capitalised names, sorted, each once. No word boundaries: engines differ on them beside letters beyond ASCII."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(x), F.lit(r"[A-Z][a-zA-Z0-9_]+"), F.lit(0))))


def references(code: Column | str, names: Column | None = None) -> Column:
    """Names that code refers to, docstrings apart, of a vocabulary if given; else capitalised ones, constants apart."""
    bare = F.regexp_replace(_c(code), r"(?s)\"\"\".*?\"\"\"|'''.*?'''", "")
    if names is not None:
        return F.array_sort(F.array_intersect(F.regexp_extract_all(bare, F.lit(r"(?U)\w+"), F.lit(0)), names))
    found = F.array_except(F.regexp_extract_all(bare, F.lit(r"\b([A-Z][a-zA-Z0-9_]+)\b"), F.lit(1)), F.array(*map(F.lit, NOT_TYPES)))
    return F.array_sort(F.filter(found, lambda n: ~((n == F.upper(n)) & n.contains("_"))))


def plain_type(x: Column | str) -> Column:
    """A type's own name without the generic around it or what follows a comma."""
    bare = F.regexp_replace(_c(x), r"^(List|Optional|Sequence|Vector|ByteList|ByteVector|Bitlist|Bitvector)\[", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\]$", ""), ",.*", ""))


def schema_name(ref: Column | str) -> Column:
    return F.substring_index(_c(ref), "/", -1)


def ref_path(ref: Column | str) -> Column:
    return F.substring_index(_c(ref), "#", 1)


def path_group(path: Column | str) -> Column:
    """The segment after a version segment, or a name before an underscore, or the first segment."""
    c = _c(path)
    return F.coalesce(
        F.nullif(F.regexp_extract(c, r"/v\d+/([^/]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(c, r"^([A-Za-z]+)_", 1), F.lit("")),
        F.nullif(F.regexp_extract(c, r"^/?([^/]+)", 1), F.lit("")),
        F.lit("other"),
    )


def url_params(x: Column | str) -> Column:
    """Query parameters as a map; pairs without a key or a value go, of several equal signs the second ends a value."""
    query = F.when(F.locate("?", _c(x)) > 0, F.substring_index(F.regexp_replace(_c(x), r"^[^?]*\?", "?"), "?", -1)).otherwise("")
    pairs = F.transform(F.split(query, "&"), lambda p: F.split(p, "="))
    good = F.filter(pairs, lambda p: (F.size(p) > 1) & (p[0] != "") & (F.get(p, 1) != ""))
    decoded = F.transform(good, lambda p: F.struct(F.url_decode(p[0]), F.url_decode(F.get(p, 1))))
    keys = F.array_distinct(F.transform(decoded, lambda p: p["col1"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(decoded, lambda p: p["col1"] == k), -1)["col2"]))


def escape_html(x: Column | str) -> Column:
    out = F.coalesce(_c(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_id(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[^A-Za-z0-9_\-]", "_")


def pull_number(fork: Column | str) -> Column:
    """The number of a virtual version ``pr-N``, null for others."""
    return F.try_to_number(F.nullif(F.regexp_extract(_c(fork), r"^pr-(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int")


def fields_signature(fields: Column | str) -> Column:
    return F.array_join(F.transform(_c(fields), lambda f: F.concat_ws(":", f["name"], f["type"])), "|")


def pseudo_code(name: Column | str, fields: Column | str) -> Column:
    """A class definition made up from fields."""
    lines = F.transform(_c(fields), lambda f: F.concat(F.lit("    "), f["name"], F.lit(": "), f["type"]))
    return F.concat_ws("\n", F.concat(F.lit("class "), _c(name), F.lit(":")), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("    pass"))


def first_lines(x: Column | str, n: int) -> Column:
    """First lines, number of lines, and whether any were left out."""
    lines = F.split(_c(x), "\n")
    return F.struct(F.array_join(F.slice(lines, 1, n), "\n").alias("text"), F.size(lines).alias("total_lines"), (F.size(lines) > n).alias("truncated"))


def status_class(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(x)), r"\s+", "-")


def shortened(x: Column | str, n: int = 40) -> Column:
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def curl(method: Column | str, base: Column | str, path: Column | str, values: dict[str, str], headers: dict[str, str] | None = None) -> Column:
    """A curl command with the path's braces filled in; names without a value stay."""
    filled = _c(path)
    for k, v in values.items():
        filled = F.replace(filled, F.lit("{" + k + "}"), F.lit(v))
    extra = "".join(f" -H '{k}: {v}'" for k, v in (headers or {}).items())
    return F.concat(F.lit("curl -X "), F.upper(_c(method)), F.lit(extra + " '"), _c(base), filled, F.lit("'"))


#: Versions that are live, ports of local services, and values shown for path parameters.
DEPLOYED = ("phase0", "altair", "bellatrix", "capella", "deneb", "electra", "fulu", "frontier", "homestead", "byzantium", "constantinople", "istanbul", "berlin", "london", "paris", "shanghai", "cancun", "prague", "osaka")
PORTS = {"beacon-apis": 5052, "builder-specs": 18550, "relay-specs": 18550, "remote-signing-api": 9000}
PATH_VALUES = {
    "block_id": "head",
    "state_id": "head",
    "slot": "1",
    "epoch": "1",
    "pubkey": "0x93247f2209abcacf57b75a51dafae777f9dd38bc7053d1af526f220a7489a6d3a2753e5f3e8b1cfe39b56f43611df74a",
    "parent_hash": "0xcf8e0d4e9587369b2301d0790347320302cc0943d5a1884560367e8208d920f2",
    "peer_id": "16Uiu2HAmEmBCWbHcqLJkYbS7MsrMNhpvMXsNGYJCkCRnBGPk9dQp",
    "validator_id": "0",
    "committee_index": "0",
    "sync_committee_index": "0",
    "blob_id": "0",
    "block_root": "0xcf8e0d4e9587369b2301d0790347320302cc0943d5a1884560367e8208d920f2",
}


def undeployed(fork: Column | str) -> Column:
    """Whether a version isn't live yet, so that its status is shown."""
    return ~_c(fork).isin(*DEPLOYED)


def request_command(method: Column, spec: Column, path: Column, values: dict[str, str], query: Column, ssz: Column, body: Column) -> Column:
    """A curl command over several lines: values given fill the path's braces, then PATH_VALUES, else the name in angles."""
    filled = path
    for k, v in (PATH_VALUES | values).items():
        filled = F.replace(filled, F.lit("{" + k + "}"), F.lit(v))
    filled = F.regexp_replace(filled, r"\{([^}]+)\}", "<$1>")
    port = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv]), spec), F.lit(5052))
    url = F.concat(F.lit("'http://localhost:"), port.cast("string"), filled, F.coalesce(F.concat(F.lit("?"), query), F.lit("")), F.lit("'"))
    parts = F.concat_ws(
        " \\\n  ", F.lit("curl"), F.when(method != "GET", F.concat(F.lit("-X "), method)), url, F.when(method.isin("POST", "PUT"), "-H 'Content-Type: application/json'"),
        F.when(ssz, "-H 'Accept: application/json'"), F.when(body, "-d '{...}'"),
    )
    return F.concat(parts, F.when(ssz, "\n\n# For SSZ: -H 'Accept: application/octet-stream'").otherwise(""))


def fork_from_suffix(name: Column | str, default: str = "phase0") -> Column:
    """The version that a type's name ends with, written with a capital after something else."""
    out = F.lit(default)
    #: Versions that names end with.
    for fork in reversed(["bellatrix", "capella", "electra", "deneb", "fulu", "altair", "phase0", "gloas", "heze"]):
        out = F.when(_c(name).rlike(f".{fork[0].upper()}(?i:{fork[1:]})$"), fork).otherwise(out)
    return out


def keyword_domain(name: Column | str, rules: dict[str, str], default: str = "other") -> Column:
    """The domain of the first keyword, in the order given, that a name contains."""
    out = F.lit(default)
    for word, domain in reversed(rules.items()):
        out = F.when(F.lower(_c(name)).contains(word), domain).otherwise(out)
    return out


def section_domain(file: Column | str, sections: Column | str, file_rules: dict[str, str], section_rules: dict[str, str], default: str) -> Column:
    """A file's own domain, or that of its deepest heading with a rule, or a guess from any heading, or the default."""
    def table(rules: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else F.lit(None).cast("map<string,string>")

    plain = F.transform(F.reverse(_c(sections)), lambda h: F.translate(F.trim(F.lower(h)), "`", ""))
    ruled = F.transform(plain, lambda h: F.coalesce(F.try_element_at(table(section_rules), F.regexp_replace(h, r"^(modified|new|extended)\s+", "")), F.try_element_at(table(section_rules), h)))
    return F.coalesce(
        F.try_element_at(table(file_rules), _c(file)),
        F.get(F.filter(ruled, lambda d: d.isNotNull()), 0),
        F.get(F.filter(F.transform(_c(sections), lambda h: F.when(F.lower(h).contains("state transition"), "block-processing").when(F.lower(h).contains("genesis"), "genesis")), lambda d: d.isNotNull()), 0),
        F.lit(default),
    )


def path_domain(rel_path: Column | str) -> Column:
    """Domain of a module by its path: its folders, with short names for two of them, or its own name."""
    c = _c(rel_path)
    folders = F.filter(F.slice(F.split(c, "/"), F.lit(1), F.size(F.split(c, "/")) - 1), lambda x: (x != "") & (x != "."))
    stem = F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    joined = F.array_join(folders, "-")
    return (
        F.when((stem == "__init__") & (F.size(folders) == 0), "fork-meta").when(stem == "__init__", joined)
        .when(F.size(folders) == 0, stem)
        .when(F.array_contains(folders, "precompiled_contracts"), "vm-precompiles")
        .when(F.array_contains(folders, "instructions"), "vm-instructions")
        .when(F.size(folders) == 1, F.concat_ws("-", joined, stem)).otherwise(joined)
    )
