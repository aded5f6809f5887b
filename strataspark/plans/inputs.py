"""Relational stand-ins for graphs, snapshots and histories on the driver's tables, in Spark and in SQL.

Each stand-in is defined once in SQL text that both engines read; the Spark side runs it through spark.sql over
temporary views of the parquet files, so nothing is collected and filters still reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: part -> supplier, one edge for each pair of lineitem; kind and coverage follow from the keys.
SUPPLY = """select distinct concat('p', cast(l_partkey as varchar(20))) as src, concat('s', cast(l_suppkey as varchar(20))) as dst,
  case l_partkey % 4 when 0 then 'calls' when 1 then 'references' when 2 then 'imports' else 'contains' end as kind,
  case l_suppkey % 4 when 0 then 'verified' when 1 then 'partial' when 2 then 'unsupported' else 'unknown' end as coverage
from lineitem"""

#: parts (module files of a package) and suppliers as symbols.
SYMBOLS = """select concat('p', cast(p_partkey as varchar(20))) as id, p_name as name, concat(lower(p_type), '/', lower(p_brand), '/', cast(p_partkey as varchar(20)), '.py') as path,
  case p_size % 3 when 0 then 'function' when 1 then 'class' else 'method' end as kind from part
union all select concat('s', cast(s_suppkey as varchar(20))), s_name, concat('supply/', cast(s_nationkey as varchar(20)), '/', cast(s_suppkey as varchar(20)), '.py'), 'module' from supplier"""

#: a call graph over suppliers: rings of five (every third one open), and steps to the next ring in runs of four.
CALLS = """select cast(s_suppkey as bigint) as src, cast(case when s_suppkey % 5 = 4 then s_suppkey - 4 else s_suppkey + 1 end as bigint) as dst,
  'calls' as kind, cast(case when s_suppkey % 7 = 0 then 250000 when s_suppkey % 3 = 0 then 600000 else 900000 end as bigint) as grade
from supplier where not (s_suppkey % 5 = 4 and (s_suppkey - s_suppkey % 5) % 15 = 0)
union all select cast(s_suppkey as bigint), cast(s_suppkey + 5 as bigint), 'imports', cast(500000 as bigint) from supplier where s_suppkey % 5 = 2 and (s_suppkey - s_suppkey % 5) % 20 <> 15
union all select cast(s_suppkey as bigint), cast(s_suppkey + 0 as bigint), 'references', cast(900000 as bigint) from supplier where s_suppkey % 25 = 0"""

#: documents as files of two snapshots: some are gone, some are new, some moved, some rewritten.
BEFORE = """select concat('src/', source, '/', cast(doc_id as varchar(20))) as path, sha2(text, 256) as content_hash, lang as language from documents where doc_id % 11 <> 0"""
AFTER = """select case when doc_id % 7 = 0 then concat('lib/', source, '/', cast(doc_id as varchar(20))) else concat('src/', source, '/', cast(doc_id as varchar(20))) end as path,
  case when doc_id % 13 = 0 then sha2(concat(text, '!'), 256) else sha2(text, 256) end as content_hash, lang as language from documents where doc_id % 10 <> 3"""

VIEWS = {"supply": SUPPLY, "symbols": SYMBOLS, "calls": CALLS, "before_files": BEFORE, "after_files": AFTER}


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named stand-ins. Views get names of their own so that queries over different folders do not meet."""
    out = []
    for name in names:
        sql, refs = VIEWS[name], {}
        for t in TABLES:
            if f" {t}" in sql:
                refs[t] = table(spark, sf_dir, t)
        text = sql
        for t in refs:
            text = text.replace(f"from {t}", f"from {{{t}}}")
        out.append(spark.sql(text.replace("varchar(20)", "string"), **refs))
    return out


def oracle(name: str) -> str:
    return VIEWS[name].replace("sha2(text, 256)", "sha256(text)").replace("sha2(concat(text, '!'), 256)", "sha256(concat(text, '!'))").replace("varchar(20)", "varchar")


def with_ctes(sql: str, *names: str, recursive: bool = False) -> str:
    """sql after the CTEs of the named stand-ins."""
    ctes = ",\n".join(f"{n} as ({oracle(n)})" for n in names)
    return f"with {'recursive ' if recursive else ''}{ctes}{',' if sql.lstrip().startswith(',') else ''}\n{sql.lstrip().removeprefix(',')}"
