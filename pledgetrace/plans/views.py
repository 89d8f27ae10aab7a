"""Views that give the base tables the shape of the commitment model.

Each view is one SQL text, run by Spark over the Parquet tables and placed as a CTE in the
SQL checks, so both sides start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

# fixed SQL: {table} names a base table
VIEWS = {
    "source_pages": """
select doc_id as page_id, concat('https://', source, '.example.org/doc/', cast(doc_id as string)) as url,
 concat(source, ' ', lang, ' ', cast(doc_id as string)) as title, text,
 cast(2015 + doc_id % 10 as int) as published_year from {documents}""",
    "commitments_text": """
select item_id as id, text as summary, concat('M', cast(1 + item_id % 3 as string), '.', cast(item_id as string)) as code,
 cast(2025 + item_id % 10 as int) as deadline_year from {benchmark}""",
    "document_pages": """
select conv_id as document_id, cast(turn + 1 as int) as page_number, text from {conversations}""",
    "commitments": """
select c_custkey as id, c_name as title,
 case when c_custkey % 7 = 0 then null else concat('M', cast(c_custkey % 5 as string), '.', cast(c_custkey as string)) end as code,
 case when c_acctbal < 0 then null else c_acctbal end as target_value from {customer}""",
    "evidence": """
select o_orderkey as id, o_custkey as commitment_id, cast(year(o_orderdate) as int) as published_year,
 concat('https://', case when o_orderkey % 4 = 0 then 'www.city' else 'works' end, '.example.org/news/', cast(o_orderkey as string)) as url,
 concat('Notice ', cast(o_orderkey as string)) as title,
 case o_orderstatus when 'F' then 'completed' when 'O' then 'in_implementation' else 'planned' end as status_hint,
 case when o_orderkey % 10 = 0 then 'termination' when o_orderkey % 10 = 1 then 'amendment' else 'affirmative' end as polarity,
 concat('In ', cast(year(o_orderdate) as string), ' the ',
  case o_orderpriority when '1-URGENT' then 'estimated cost' when '2-HIGH' then 'final accounts' when '3-MEDIUM' then 'contract value' when '4-NOT SPECIFIED' then 'revised budget' else 'budget allocation' end,
  ' was £', cast(cast(o_totalprice as decimal(18,2)) as string), '. Works are ',
  case o_orderstatus when 'F' then 'completed' when 'O' then 'underway' else 'scheduled' end, '.',
  case when o_orderkey % 10 = 0 then ' The contract was cancelled.' when o_orderkey % 10 = 1 then ' It was postponed.' else '' end) as snippet
 from {orders}""",
    "links": """
select o_orderkey as id, o_custkey as commitment_id, o_orderkey as evidence_id, o_totalprice as score,
 case when o_orderkey % 3 = 0 then 'accepted' when o_orderkey % 3 = 1 then 'unreviewed' else 'rejected' end as review_status,
 case when o_orderkey % 7 = 2 then null else case when o_orderkey % 5 = 0 then 'direct_implementation' when o_orderkey % 5 = 1 then 'supporting' when o_orderkey % 5 = 2 then 'budget' when o_orderkey % 5 = 3 then 'related_but_indirect' else 'probably_unrelated' end end as relationship,
 case when o_orderkey % 5 = 0 then 'direct_implementation' when o_orderkey % 5 = 1 then 'supporting' when o_orderkey % 5 = 2 then 'budget' when o_orderkey % 5 = 3 then 'related_but_indirect' else 'probably_unrelated' end as suggested_relationship
 from {orders}""",
    "budgets": """
select l_orderkey as evidence_id, l_linenumber as id,
 case l_linenumber when 1 then 'estimated_cost' when 2 then 'initial_appropriation' when 3 then 'amended_appropriation' when 4 then 'contracted_price' when 5 then 'actual_expenditure' else 'reported_expenditure' end as kind,
 case min(l_returnflag) when 'A' then 'GBP' when 'N' then 'EUR' else 'HUF' end as currency,
 case min(l_returnflag) when 'R' then cast(floor(max(cast(l_extendedprice as decimal(18,2)))) as decimal(18,2)) else max(cast(l_extendedprice as decimal(18,2))) end as amount,
 case min(l_returnflag) when 'R' then null else cast(max(cast(l_extendedprice as decimal(18,2))) as string) end as amount_native,
 cast(min(year(l_shipdate)) as int) as fiscal_year
 from {lineitem} group by l_orderkey, l_linenumber""",
    "artifact_evidence": """
select distinct concat('CF-2024-', lpad(cast(l_partkey as string), 6, '0')) as procurement_id, l_orderkey as evidence_id from {lineitem}""",
    "grades_a": """
select source as query, doc_id as doc, cast(quality * 2 + toxic as int) as grade
 from {documents} join {labels} using (doc_id)""",
    "grades_b": """
select source as query, doc_id as doc,
 cast(case when doc_id % 4 = 0 then 3 - (quality * 2 + toxic) else quality * 2 + toxic end as int) as grade
 from {documents} join {labels} using (doc_id)""",
    "decisions": """
select user_id as link_id, ts, event_id,
 case event_type when 'click' then 'accepted' when 'error' then 'rejected' else 'unreviewed' end as decision from {events}""",
}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **used)


def cte(*names: str) -> str:
    """``with a as (...), b as (...)`` for the SQL checks."""
    return "with recursive " + ", ".join(
        f"{n} as ({VIEWS[n].format(**{t: t for t in BASE})})" for n in names)
