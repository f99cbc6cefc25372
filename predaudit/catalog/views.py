"""Scored views: tables with a deterministic prediction rule, the same SQL text in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from predaudit.spec import MULTICLASS, REGRESSION, AuditSpec

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

VIEWS = {
    "docs": """
select d.doc_id, cast(d.n_chars >= 500 as int) as prediction, l.quality as true_label,
  least(cast(1 as double), d.n_chars / cast(4000 as double)) as score, d.lang, d.source, l.toxic, d.n_chars
from {labels} l join {documents} d on d.doc_id = l.doc_id""",
    "orders_scored": """
select o.o_orderkey, cast(case when o.o_orderkey % 10 < 7 then t.code else (t.code + 1) % 3 end as int) as prediction,
  t.code as true_label, o.o_orderpriority, c.c_mktsegment, o.o_totalprice,
  least(cast(1 as double), o.o_totalprice / cast(500000 as double)) as score_0,
  (o.o_orderkey % 100) / cast(100 as double) as score_1,
  abs(cast(1 as double) - o.o_totalprice / cast(250000 as double)) as score_2
from {orders} o join {customer} c on c.c_custkey = o.o_custkey
join (values ('F', 0), ('O', 1), ('P', 2)) t(status, code) on t.status = o.o_orderstatus""",
    "items": """
select l_orderkey, l_linenumber, l_extendedprice * (1 + l_discount - l_tax) as prediction, l_extendedprice as true_value,
  l_returnflag, l_linestatus, l_quantity, l_discount, l_tax
from {lineitem}""",
    "risk": """
select o.o_orderkey, cast(o.o_totalprice > 250000 as int) as prediction, r.returned as true_label,
  least(cast(1 as double), o.o_totalprice / cast(500000 as double)) as score, c.c_mktsegment, o.o_orderpriority, g.r_name
from {orders} o join {customer} c on c.c_custkey = o.o_custkey
join {nation} n on n.n_nationkey = c.c_nationkey join {region} g on g.r_regionkey = n.n_regionkey
join (select l_orderkey, max(cast(l_returnflag = 'R' as int)) as returned from {lineitem} group by l_orderkey) r
  on r.l_orderkey = o.o_orderkey""",
    "picked": """
select l_returnflag, cast(l_quantity * (1 - l_discount) > 20 + 3 * l_linenumber as int) as true_label, l_quantity, l_discount, l_tax, l_linenumber
from {lineitem}""",
    "nulls": """
select l_orderkey, case when l_linenumber = 7 then null else l_tax end as l_tax,
  case when l_orderkey % 50 = 0 then null else l_returnflag end as l_returnflag, l_quantity,
  cast(1 as double) as constant_col,
  case when l_partkey % 97 = 0 then lower(l_linestatus) else l_linestatus end as l_linestatus
from {lineitem}""",
    "timed": """
select event_id, cast(ts as timestamp) as ts, user_id, cast(value > 20 as int) as prediction,
  cast(event_type = 'purchase' as int) as true_label, event_type, value, least(cast(1 as double), value / cast(200 as double)) as score
from {events}""",
    "copies": "select lang, source, text from {documents}",
    "timed_orders": """
select o.o_orderkey, cast(o.o_orderdate as timestamp) as ts, t.code as true_label,
  cast(case when o.o_orderkey % 10 < 7 then t.code else (t.code + 1) % 3 end as int) as prediction
from {orders} o join (values ('F', 0), ('O', 1), ('P', 2)) t(status, code) on t.status = o.o_orderstatus""",
    "wide": """
select l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, o_custkey, o_totalprice, p_size, p_retailprice,
  l_quantity * l_discount as c11, l_quantity * l_tax as c12, l_extendedprice * l_discount as c13, l_extendedprice * l_tax as c14,
  l_quantity * p_size as c15, l_quantity * p_retailprice as c16, l_discount * p_size as c17, l_tax * p_size as c18,
  l_linenumber * l_quantity as c19, o_totalprice * l_discount as c20, case when l_linenumber = 7 then null else l_quantity + p_size end as c21
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey join {part} p on p.p_partkey = l.l_partkey""",
}

SPECS = {
    "docs": AuditSpec("prediction", "true_label", "score", protected=("lang", "source"), identifier="doc_id"),
    "orders_scored": AuditSpec(
        "prediction",
        "true_label",
        class_scores=((0, "score_0"), (1, "score_1"), (2, "score_2")),
        protected=("o_orderpriority", "c_mktsegment"),
        identifier="o_orderkey",
        problem=MULTICLASS,
    ),
    "items": AuditSpec(
        "prediction",
        "true_value",
        protected=("l_returnflag", "l_linestatus"),
        features=("l_quantity", "l_discount", "l_tax", "l_linenumber"),
        problem=REGRESSION,
    ),
    "risk": AuditSpec(
        "prediction",
        "true_label",
        "score",
        protected=("c_mktsegment", "o_orderpriority", "r_name"),
        identifier="o_orderkey",
    ),
    "picked": AuditSpec(None, "true_label", features=("l_quantity", "l_discount", "l_tax", "l_linenumber")),
    "wide": AuditSpec(
        None,
        "o_totalprice",
        features=(
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "p_size", "p_retailprice", "c11", "c13", "c15", "c18", "c21",
        ),
        problem=REGRESSION,
    ),
    "timed_orders": AuditSpec("prediction", "true_label", timestamp="ts", identifier="o_orderkey", problem=MULTICLASS),
    "timed": AuditSpec("prediction", "true_label", "score", protected=("event_type",), timestamp="ts", identifier="event_id"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name] if name in VIEWS else FAULTY[name][0]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def view_sql(name: str) -> str:
    return (VIEWS[name] if name in VIEWS else FAULTY[name][0]).format(**{t: t for t in TABLES}).strip()


#: Tables with faults, each with its columns and kinds; between them they break every rule of validation that a table of theirs can.
FAULTY = {
    "empty": ("select l_quantity as prediction, l_returnflag from {lineitem} where l_quantity < 0", {"prediction": "number", "l_returnflag": "text"}),
    "three_rows": (
        "select l_returnflag, avg(l_quantity) as prediction from {lineitem} group by l_returnflag", {"l_returnflag": "text", "prediction": "number"},
    ),
    "few_rows": (
        "select l_returnflag, l_linenumber, avg(l_quantity) as prediction from {lineitem} group by l_returnflag, l_linenumber",
        {"l_returnflag": "text", "l_linenumber": "number", "prediction": "number"},
    ),
    "mostly_gaps": (
        """select case l_linenumber when 1 then l_tax when 2 then cast('NaN' as double) when 3 then cast('Infinity' as double) end as prediction,
  case when l_linenumber = 1 then l_returnflag end as l_returnflag, case when l_linenumber > 5 then l_quantity end as true_label from {lineitem}""",
        {"prediction": "number", "l_returnflag": "text", "true_label": "number"},
    ),
    "some_gaps": (
        """select l_tax as prediction, case when l_linenumber > 3 then l_returnflag end as l_returnflag,
  case when l_linenumber > 2 then l_quantity end as true_label from {lineitem}""",
        {"prediction": "number", "l_returnflag": "text", "true_label": "number"},
    ),
    "one_prediction": (
        "select cast(1 as int) as prediction, c_name, c_mktsegment, c_acctbal from {customer}",
        {"prediction": "number", "c_name": "text", "c_mktsegment": "text", "c_acctbal": "number"},
    ),
    "rare_class": (
        """select cast(l_quantity = 50 and l_discount = 0.1 and l_linenumber = 7 as int) as prediction,
  case when l_partkey = 1 then cast(1000000 as double) else l_quantity end as measured, l_orderkey, l_partkey, l_suppkey from {lineitem}""",
        {"prediction": "number", "measured": "number", "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number"},
    ),
    "texts_only": ("select l_returnflag, l_linestatus from {lineitem}", {"l_returnflag": "text", "l_linestatus": "text"}),
}


def faulty_spec(name: str) -> AuditSpec:
    columns = FAULTY[name][1]
    return AuditSpec(
        "prediction", "true_label" if "true_label" in columns else None, protected=(("c_name", "absent") if name == "one_prediction" else ()),
    )
