"""Queries that go through files: stored catalogs, recorded answers, incremental refresh; and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import metadata
from ..sources.tables import indexes, put_text, table, text_files, work_dir
from ..streaming import incremental
from .calls import VERSIONS, made
from .catalog import Catalog
from .queries import query


def _folder(s) -> str:
    return f"{work_dir(s)}/{uuid.uuid4().hex}"


@query(VERSIONS + """, n as (select from_spec as spec, count(*) as n_links from x group by 1)
select v.spec, count(distinct v.name) as n_items, string_agg(distinct v.fork, ',' order by v.fork) as forks, coalesce(max(n.n_links), 0) as n_links, (select count(distinct (spec, pr)) from u where u.spec = v.spec) as n_prs from v left join n on n.spec = v.spec group by v.spec""")
def stored_catalog(s, d):
    """A catalog that is written and read again, with the links that were written beside it."""
    path = _folder(s)
    made(s, d).save(path)
    cat = Catalog.load(s, path)
    links = s.read.schema("from_item string, to_spec string, to_type string, forks string, from_spec string").parquet(f"{path}/cross_refs").groupBy(F.col("from_spec").alias("spec")).agg(F.count(F.lit(1)).alias("n_links"))
    prs = cat.list_prs().groupBy("spec").agg(F.count(F.lit(1)).alias("n_prs"))
    return cat.list_specs().select("spec", "n_items", "forks").join(links, "spec", "left").join(prs, "spec", "left").fillna(0, ["n_links", "n_prs"])


@query(VERSIONS + "select name, spec from v where spec = 's1' and fork = 'v1'")
def exported_catalog(s, d):
    """The catalog as JSON rows, without empty values, read again."""
    path = _folder(s)
    made(s, d).export(path)
    rows = s.read.schema("spec string, name string, fork string, note string").json(path)
    return rows.filter("spec = 's1' AND fork = 'v1' AND note IS NULL").select("name", "spec")


@query("select r_name as spec, r_regionkey :: bigint as total from region")
def index_files(s, d):
    path = _folder(s)
    for r in table(s, d, "region").select("r_name", "r_regionkey").collect():  # five rows
        put_text(s, f"{path}/{r['r_name']}_index.json", f'{{"_meta": {{"total_items": {r["r_regionkey"]}}}}}')
    put_text(s, f"{path}/other.json", "{}")
    return indexes(s, path).select("spec", F.expr("variant_get(doc, '$._meta.total_items', 'bigint')").alias("total"))


@query("select r_name as spec, n_nationkey as number, 't ' || n_name as title, 'u' || n_nationkey as author, 'sha' || n_nationkey as head_sha from (select *, row_number() over (partition by r_name order by n_nationkey desc) as p from nation join region on n_regionkey = r_regionkey) where p <= 3")
def recorded_prs(s, d):
    path = _folder(s)
    one = F.struct(F.col("n_nationkey").alias("number"), F.concat(F.lit("t "), "n_name").alias("title"), F.struct(F.concat(F.lit("u"), "n_nationkey").alias("login")).alias("user"), F.struct(F.concat(F.lit("sha"), "n_nationkey").alias("sha")).alias("head"))
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.to_json(F.collect_list(one)).alias("j"))
    for r in rows.collect():  # five rows
        put_text(s, f"{path}/{r['r_name']}_prs.json", r["j"])
    return metadata.recorded_prs(s, path, 3).select("spec", "number", "title", "author", "head_sha")


@query("select 'v' || r_regionkey as fork, '# ' || r_name || chr(10) || 'x' as content from region")
def fork_files(s, d):
    path = _folder(s)
    for r in table(s, d, "region").collect():
        put_text(s, f"{path}/v{r['r_regionkey']}/spec.md", f"# {r['r_name']}\nx")
    return text_files(s, path).select("fork", "content")


@query("select n_nationkey as pr, case when n_nationkey % 2 = 0 then 'b' else 'a' end as sha, n_name || case when n_nationkey % 2 = 0 then 'b' else 'a' end as name, 's' || (n_regionkey) as spec from nation union all select n_nationkey, 'a', 'second', 's' || n_regionkey from nation where n_nationkey % 2 = 1")
def overlay_refresh(s, d):
    """Two runs of the stream: a pull request whose head moved has its new rows only, the others stay."""
    path, n = _folder(s), table(s, d, "nation")
    first = n.select(F.col("n_nationkey").alias("pr"), F.lit("a").alias("sha"), F.explode(F.array(F.concat("n_name", F.lit("a")), F.lit("second"))).alias("name"), F.concat(F.lit("s"), "n_regionkey").alias("spec"))
    moved = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("pr"), F.lit("b").alias("sha"), F.concat("n_name", F.lit("b")).alias("name"), F.concat(F.lit("s"), "n_regionkey").alias("spec"))
    for rows in (first, moved):
        rows.write.mode("append").json(f"{path}/in")
        incremental.refresh(s, f"{path}/in", "pr int, sha string, name string, spec string", f"{path}/out", f"{path}/cp", ["spec", "pr"], "sha", "spec").awaitTermination()
    return s.read.schema("pr int, sha string, name string, spec string").parquet(f"{path}/out").select("pr", "sha", "name", "spec")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(s, d):
    return incremental.windowed(table(s, d, "events"), "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 6 hour then 1 else 0 end as new from events))
select min(ts) as start, max(ts) + interval 6 hour as "end", user_id, count(*) as n from g group by user_id, k""")
def event_sessions(s, d):
    rows = incremental.sessions(table(s, d, "events"), "ts", "user_id", "6 hours")
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "user_id", "n")


@query("select r_name as spec, r_regionkey as pr, 'specs/' || n_name || '.md' as file, n_nationkey % 2 = 0 as touched from nation join region on n_regionkey = r_regionkey")
def changed_files(s, d):
    """Files of recorded pull requests, and whether the request touches a folder of specifications."""
    path = _folder(s)
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for r in rows.groupBy("r_name", "r_regionkey").agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("specs/"), "n_name", F.lit(".md")).alias("filename")))).alias("j")).collect():  # five rows
        put_text(s, f"{path}/{r['r_name']}_{r['r_regionkey']}_files.json", r["j"])
    even = [f"specs/NATION_{i}.md" for i in range(0, 25, 2)]
    return metadata.changed_files(s, path).withColumn("touched", metadata.touches(F.array("file"), even))


@query("select doc_id, len(string_split(text, chr(10))) :: int as total_lines, len(string_split(text, chr(10))) > 3 as truncated, array_to_string(string_split(text, chr(10))[1:3], chr(10)) as text from documents")
def examples(s, d):
    files = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    return metadata.examples(files, 3).select(F.col("file").cast("long").alias("doc_id"), "total_lines", "truncated", "text")
