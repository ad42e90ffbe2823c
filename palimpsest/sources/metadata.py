"""Frontmatter, version axes, recorded pull requests and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_lines
from .tables import file_name

PR = "struct<number:int,title:string,user:struct<login:string>,base:struct<ref:string>,head:struct<ref:string,sha:string>,updated_at:string,html_url:string>"


def frontmatter(text: Column | str) -> Column:
    """Keys and values of a text's opening ``---`` block; a value may hold colons. Empty without a closed block."""
    c = F.col(text) if isinstance(text, str) else text
    block = F.regexp_extract(c, r"(?s)\A---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[^\s:#][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def forks_from_config(config: DataFrame, folders: DataFrame) -> DataFrame:
    """(fork, fork_seq): phase0, then configured versions by their hexadecimal number, then other folders by name.

    config (line), folders (fork); names that begin with ``_`` or ``.`` don't count.
    """
    number = F.regexp_extract("line", r"^([A-Z0-9]+)_FORK_VERSION:\s*0x([0-9a-fA-F]+)", 2)
    named = config.select(F.lower(F.regexp_extract("line", r"^([A-Z0-9]+)_FORK_VERSION:\s*0x", 1)).alias("fork"), F.conv(number, 16, 10).cast("decimal(20)").alias("n")).filter("fork <> '' AND fork <> 'genesis'")
    rest = folders.select("fork").distinct().filter("NOT fork RLIKE '^[_.]'").join(named, "fork", "left_anti").withColumn("n", F.lit(None).cast("decimal(20)"))
    place = F.struct(F.when(F.col("fork") == "phase0", 0).when(F.col("n").isNotNull(), 1).otherwise(2), F.coalesce("n", F.lit(0)), "fork")
    return named.unionByName(rest).withColumn("fork_seq", F.row_number().over(Window.orderBy(place)) - 1).select("fork", "fork_seq")


def forks_of(config: DataFrame, folders: DataFrame, features: DataFrame) -> DataFrame:
    """(fork, fork_seq) by the first that says anything: configured versions, else folders by name; features come after.

    config (line), folders (fork), features (fork): a feature's folder is a version ``_features/<name>`` of its own.
    """
    known = forks_from_config(config, folders)
    last = F.coalesce(F.max("fork_seq").over(Window.partitionBy()), F.lit(-1))  # some tens of rows
    extra = features.select(F.concat(F.lit("_features/"), "fork").alias("fork")).distinct().withColumn("fork_seq", F.lit(None).cast("int"))
    rows = known.unionByName(extra).withColumn("last", last)
    place = F.row_number().over(Window.partitionBy(F.col("fork_seq").isNull()).orderBy("fork"))
    return rows.select("fork", F.coalesce("fork_seq", F.col("last") + place).alias("fork_seq"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(spec, pr, file) of recorded answers (JSON arrays) named ``{spec}_{pr}_files.json``."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*_files.json").select(F.regexp_extract(file_name(), r"^(.*)_(\d+)_files\.json$", 1).alias("spec"), F.regexp_extract(file_name(), r"^(.*)_(\d+)_files\.json$", 2).cast("int").alias("pr"), "value")
    return raw.select("spec", "pr", F.explode(F.from_json("value", "array<struct<filename:string>>")).alias("f")).select("spec", "pr", F.col("f.filename").alias("file"))


def examples(files: DataFrame, lines: int = 80) -> DataFrame:
    """(file, text, total_lines, truncated) of fetched examples (file, content): their first lines."""
    return files.select("file", first_lines("content", lines).alias("x")).select("file", "x.*")


def forks_from_criteria(inits: DataFrame) -> DataFrame:
    """(fork, fork_seq) by the criteria in each fork's text: block numbers, then timestamps, unscheduled, then missing."""
    t = F.col("init_text")
    kind = F.when(t.contains("ByBlockNumber("), 0).when(t.contains("ByTimestamp("), 1).when(t.contains("Unscheduled("), 2).otherwise(3)
    value = F.try_to_number(F.nullif(F.regexp_extract(F.regexp_replace(t, "_", ""), r"(?:ByBlockNumber|ByTimestamp|Unscheduled)\((?:\w+=)?(\d+)", 1), F.lit("")), F.lit("999999999999999"))
    return inits.withColumn("fork_seq", F.row_number().over(Window.orderBy(kind, F.coalesce(value, F.lit(0)), "fork")) - 1).select("fork", "fork_seq")


def forks_from_headings(docs: DataFrame, pattern: str = r"(?m)^###\s+(engine_\w+V\d+)") -> DataFrame:
    """(method, fork): the first fork whose document has a heading for the method. docs (fork, fork_seq, content)."""
    found = docs.select("fork", "fork_seq", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("method"))
    return found.groupBy("method").agg(F.min_by("fork", "fork_seq").alias("fork"))


def eip_numbers(text: Column | str) -> Column:
    found = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"EIP-?(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))


def recorded_prs(spark: SparkSession, path: str, per_page: int = 30) -> DataFrame:
    """Open pull requests from recorded answers (JSON arrays, a file a spec): newest first, one page a spec."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(file_name(), r"^(.*?)(?:_prs)?\.json$", 1).alias("spec"), F.explode(F.from_json("value", f"array<{PR}>")).alias("p"))
    rows = raw.select("spec", "p.number", "p.title", F.col("p.user.login").alias("author"), F.col("p.base.ref").alias("base_ref"), F.col("p.head.ref").alias("head_ref"), F.col("p.head.sha").alias("head_sha"), "p.updated_at", F.col("p.html_url").alias("url"))
    w = Window.partitionBy("spec").orderBy(F.desc("number"))
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_page).drop("__n")


def touches(files: Column | str, prefixes: list[str]) -> Column:
    """Whether any changed file is under one of the prefixes, or is one of them."""
    c = F.col(files) if isinstance(files, str) else files
    return F.exists(c, lambda f: F.greatest(*[(f == p) | f.startswith(p.rstrip("/") + "/") for p in prefixes], F.lit(False)))


#: Parts of paths that hold specifications written in YAML.
YAML_PLACES = ("apis/", "types/", "beacon-node-oapi")


def is_spec_file(path: Column | str) -> Column:
    """Whether a path holds a specification: by its folder, or by its ending and where that stands."""
    c = F.col(path) if isinstance(path, str) else path
    shallow = F.size(F.split(c, "/")) <= 2
    yaml = c.rlike(r"^(?!\.).*\.ya?ml$") & F.greatest(shallow, *map(c.contains, YAML_PLACES))
    return F.greatest(c.startswith("specs/"), yaml, c.rlike(r"^(?=.*(?i:openrpc)).*\.json$"), c.rlike(r"^src/.*\.py$"))
