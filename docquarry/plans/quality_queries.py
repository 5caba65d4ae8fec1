"""Queries of the general data-quality operators: broken references and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import unpack
from ..operators.references import Target, broken_references, latest_state, month_of_seconds
from ..session import checkpointed, table


def _broken(spark: SparkSession, d: str) -> DataFrame:
    # the states are referred from twice and referred to once: they are made once
    files = checkpointed(latest_state(table(spark, d, "file_tracking"), "id", "updated_at", ["id", "dir_id", "md5", "status", "created_at", "updated_at"]))
    dead = F.lower(F.btrim("status")) == "deleted"
    dirs, contents = table(spark, d, "dir_config"), table(spark, d, "content_index").select("md5", "indexed_at")
    errors = table(spark, d, "index_errors").select(F.col("id").cast("string").alias("id"), "file_id", "created_at")
    parts = []
    for refs, tbl, fld, target, made in (
        (files.select("id", "dir_id", "created_at"), "file_tracking", "dir_id", Target(dirs.select("id", "created_at"), ("id",), "created_at"), "created_at"),
        (files.select("id", "md5", "created_at", "updated_at"), "file_tracking", "md5", Target(contents, ("md5",), "indexed_at"), "updated_at"),
        (errors, "index_errors", "file_id", Target(files.select("__key", "created_at", dead.alias("dead")), ("__key",), "created_at", "dead"), "created_at"),
    ):
        broken = broken_references(refs, (fld,), target, "simple", made)
        parts.append(broken.select(F.lit(tbl).alias("tbl"), F.lit(fld).alias("fld"), F.col("id").alias("row_id"), "reason", month_of_seconds("created_at").alias("period")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each broken reference once, with its reason and month."""
    return _broken(spark, d).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, field, reason and month."""
    return p1_found(spark, d).groupBy("tbl", "fld", "reason", "period").agg(F.count(F.lit(1)).alias("n"))


def p1_composite(spark: SparkSession, d: str) -> DataFrame:
    """Errors whose (file_id, file_path) names no file, with partial matching of keys that have one blank part."""
    files = table(spark, d, "file_tracking").select("id", "path")
    errors = table(spark, d, "index_errors").select(F.col("id").alias("row_id"), "file_id", "file_path").distinct()
    return broken_references(errors, ("file_id", "file_path"), Target(files, ("id", "path")), "partial").select("row_id", "reason").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of the three packed fields."""
    parts = []
    for tbl, fld, brackets in (("dir_config", "exclude_patterns", False), ("dir_config", "include_exts", False), ("search_history", "dir_ids", True)):
        source = table(spark, d, tbl).select(F.col("id").alias("row_id"), fld).where(F.col(fld).isNotNull())
        parts.append(unpack(source, fld, brackets).select(F.lit(tbl).alias("tbl"), F.lit(fld).alias("fld"), "row_id", "pos", "val"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p2_dir_usage(spark: SparkSession, d: str) -> DataFrame:
    """How many searches name each directory (ids compared in lower case)."""
    source = table(spark, d, "search_history").select("id", "dir_ids").where("dir_ids is not null").distinct()
    values = unpack(source, "dir_ids", True).select("id", F.lower("val").alias("dir_id")).distinct()
    return values.groupBy("dir_id").agg(F.count(F.lit(1)).alias("n_searches"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_composite": p1_composite, "p2_found": p2_found, "p2_dir_usage": p2_dir_usage}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"


def _k(c: str) -> str:
    return f"nullif(lower(trim({c}, {_SPACE})), '')"


_P1 = f"""
with st as (select * from (select *, {_k('id')} k, row_number() over (partition by {_k('id')} order by updated_at desc) rn from file_tracking) where rn = 1 and k is not null),
dirs as (select {_k('id')} k, min(created_at) born from dir_config group by 1),
cont as (select {_k('md5')} k, min(indexed_at) born from content_index group by 1),
b as (
 select 'file_tracking' tbl, 'dir_id' fld, st.id row_id, case when d.k is null then 'missing' when d.born > st.created_at then 'late' end reason, st.created_at c
 from st left join dirs d on {_k('st.dir_id')} = d.k where {_k('st.dir_id')} is not null
 union all
 select 'file_tracking', 'md5', st.id, case when d.k is null then 'missing' when d.born > st.updated_at then 'late' end, st.created_at
 from st left join cont d on {_k('st.md5')} = d.k where {_k('st.md5')} is not null
 union all
 select 'index_errors', 'file_id', cast(e.id as varchar), case when s.k is null then 'missing' when lower(s.status) = 'deleted' then 'deleted' when s.created_at > e.created_at then 'late' end, e.created_at
 from index_errors e left join st s on {_k('e.file_id')} = s.k where {_k('e.file_id')} is not null)
select distinct tbl, fld, row_id, reason, strftime(make_timestamp(c * 1000000), '%Y-%m') period from b where reason is not null
"""

ORACLE = {
    "p1_found": _P1,
    "p1_report": f"select tbl, fld, reason, period, count(*) n from ({_P1}) group by all",
    "p1_composite": f"""
with f as (select distinct {_k('id')} i, {_k('path')} p from file_tracking), e as (select distinct id row_id, {_k('file_id')} i, {_k('file_path')} p from index_errors)
select row_id, 'missing' reason from e where not (i is null and p is null) and not exists (select 1 from f where (e.i is null or f.i = e.i) and (e.p is null or f.p = e.p)
 and (e.i is not null or f.p = e.p) and (e.p is not null or f.i = e.i))""",
}
