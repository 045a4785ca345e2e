"""The property graph bound to the relational tables: labels and edge types as views.

Each view is one SELECT that both Spark SQL and DuckDB read alike; {name} stands for a table or another view. Edges are
parted by type, and every edge view grows in proportion to its table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All "now" in time-relative queries, so that results don't depend on the day.
AS_OF = "2001-08-01"

VIEWS: dict[str, str] = {
    "compound": """SELECT concat('P:', p_partkey) AS id, p_partkey AS key, p_name AS name, p_type AS class, p_brand AS family, p_retailprice AS weight,
        CASE p_size % 6 WHEN 0 THEN 'preclinical' WHEN 1 THEN 'phase_1' WHEN 2 THEN 'phase_2' WHEN 3 THEN 'phase_3' WHEN 4 THEN 'approved' ELSE 'in_review' END AS stage,
        p_size % 6 AS stage_order, p_size % 6 = 4 AS approved, upper(substring(md5(p_name), 1, 14)) AS inchikey, p_size AS size FROM {part}""",
    "target": """SELECT concat('S:', s_suppkey) AS id, s_suppkey AS key, s_name AS name, s_nationkey AS nation_key, s_acctbal AS score,
        CASE s_suppkey % 4 WHEN 0 THEN 'enzyme' WHEN 1 THEN 'receptor' WHEN 2 THEN 'channel' ELSE 'transporter' END AS target_type FROM {supplier}""",
    "acts_on": """SELECT concat('P:', l_partkey) AS compound, concat('S:', l_suppkey) AS target,
        CASE l_returnflag WHEN 'R' THEN 'INHIBITS' WHEN 'A' THEN 'ACTIVATES' ELSE 'BINDS_TO' END AS rel,
        avg(l_quantity) AS strength, min(l_extendedprice) AS ic50, count(*) AS n, min(l_shipdate) AS first_seen,
        round(4 + avg(l_quantity) / 10, 2) AS pchembl FROM {lineitem} GROUP BY l_partkey, l_suppkey, l_returnflag""",
    "disease": """SELECT concat('D:', c_custkey) AS id, c_custkey AS key, c_name AS name, c_mktsegment AS area, c_acctbal AS prevalence, c_nationkey AS nation_key FROM {customer}""",
    "associated": """SELECT DISTINCT concat('S:', l_suppkey) AS target, concat('D:', o_custkey) AS disease,
        CASE o_custkey % 3 WHEN 0 THEN 'ASSOCIATED_WITH_DISEASE' WHEN 1 THEN 'CAUSES_DISEASE' ELSE 'BIOMARKER_FOR' END AS rel,
        CASE WHEN c_acctbal >= 7500 THEN 'A' WHEN c_acctbal >= 5000 THEN 'B' WHEN c_acctbal >= 2500 THEN 'C' WHEN c_acctbal >= 0 THEN 'D' END AS evidence_level,
        round((c_acctbal + 1000) / 11000, 3) AS confidence
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON c_custkey = o_custkey WHERE l_linestatus = 'O' AND l_linenumber = 1""",
    "treats": """SELECT DISTINCT concat('P:', l_partkey) AS compound, concat('D:', o_custkey) AS disease FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'""",
    "pathway_target": """SELECT concat('S:', s_suppkey) AS target, concat('W:', s_suppkey % 25) AS pathway, CASE WHEN s_acctbal < 3000 THEN 'UPREGULATES' WHEN s_acctbal < 6000 THEN 'DOWNREGULATES' ELSE 'PARTICIPATES_IN' END AS rel FROM {supplier}
        UNION SELECT concat('S:', s_suppkey), concat('W:', (s_suppkey * 7 + 3) % 25), 'PARTICIPATES_IN' FROM {supplier}""",
    "trial": """SELECT concat('T:', o_orderkey) AS id, o_orderkey AS key, concat('D:', o_custkey) AS disease, o_custkey AS sponsor_key, o_orderdate AS start_date,
        CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Phase 1' WHEN '2' THEN 'Phase 2' WHEN '3' THEN 'Phase 3' WHEN '4' THEN 'Phase 4' ELSE 'N/A' END AS phase,
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Terminated' ELSE 'Recruiting' END AS status,
        CAST(floor(o_totalprice / 250) AS INT) AS enrollment, o_totalprice > 300000 AS endpoint_met, CAST(year(o_orderdate) AS INT) AS start_year,
        CASE o_orderkey % 3 WHEN 0 THEN 'Interventional' WHEN 1 THEN 'Observational' ELSE 'Expanded Access' END AS study_type,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY * CAST(90 + o_orderkey % 700 AS INT) END AS completed_on FROM {orders}""",
    "trial_compound": """SELECT DISTINCT concat('T:', l_orderkey) AS trial, concat('P:', l_partkey) AS compound FROM {lineitem}""",
    "site": """SELECT concat('T:', o_orderkey) AS trial, concat('N:', n_nationkey) AS id, n_name AS country, r_name AS region FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey""",
    "adverse_event": """SELECT event_id AS key, concat('T:', event_id % 1500) AS trial, concat('U:', user_id) AS subject, concat('P:', event_id % 200) AS compound, concat('D:', user_id % 100) AS disease,
        event_type AS term, event_type = 'error' OR value > 120 AS serious, CASE WHEN value < 10 THEN 1 WHEN value < 40 THEN 2 WHEN value < 120 THEN 3 ELSE 4 END AS severity, ts AS onset, value FROM {events} WHERE event_type IN ('error', 'click')""",
    "signal": """SELECT concat('SG:', event_id) AS id, concat('P:', event_id % 200) AS compound, concat('D:', user_id % 100) AS disease, CASE WHEN value < 20 THEN 'under_review' WHEN value < 60 THEN 'confirmed' WHEN value < 150 THEN 'monitoring' ELSE 'rejected' END AS status, ts AS detected FROM {events} WHERE event_type = 'view' AND event_id % 5 = 0""",
    "manufacturer": """SELECT concat('M:', s_suppkey) AS id, s_suppkey AS key, s_name AS name, n_name AS country, r_name AS region, s_acctbal AS rating FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey""",
    "product": """SELECT DISTINCT concat('P:', l_partkey) AS product, concat('M:', l_suppkey) AS manufacturer FROM {lineitem} WHERE l_linenumber <= 2""",
    "inspection": """SELECT concat('I:', event_id) AS id, concat('M:', user_id % 100) AS manufacturer, CASE WHEN value > 60 THEN 'FAILED' ELSE 'PASSED' END AS result, ts AS inspected, event_id % 3 AS agency,
        CASE event_id % 4 WHEN 0 THEN 'routine' WHEN 1 THEN 'for_cause' WHEN 2 THEN 'pre_approval' ELSE 'surveillance' END AS kind FROM {events} WHERE event_type = 'purchase'""",
    "shortage": """SELECT concat('SH:', event_id) AS id, concat('P:', event_id % 200) AS product, concat('M:', user_id % 100) AS manufacturer, ts AS start_date, CASE WHEN value >= 50 THEN ts + INTERVAL 10 DAY END AS end_date,
        CASE event_id % 4 WHEN 0 THEN 'manufacturing_delay' WHEN 1 THEN 'demand_increase' WHEN 2 THEN 'raw_material' ELSE 'discontinuation' END AS reason,
        CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 120 THEN 'high' ELSE 'critical' END AS impact, CASE WHEN value < 50 THEN 'active' ELSE 'resolved' END AS status FROM {events} WHERE event_type = 'signup'""",
    "submission": """SELECT concat('SB:', o_orderkey) AS id, o_orderkey AS key, concat('A:', o_custkey % 5) AS agency, o_orderdate AS submitted, CAST(year(o_orderdate) AS INT) AS submitted_year,
        CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'NDA' WHEN '2' THEN 'BLA' WHEN '3' THEN 'ANDA' WHEN '4' THEN 'sNDA' ELSE 'OTHER' END AS kind, concat('P:', o_orderkey % 200) AS product, o_orderstatus AS state,
        CASE WHEN o_totalprice > 250000 THEN 'priority' ELSE 'standard' END AS review_priority FROM {orders}""",
    "approval": """SELECT concat('AP:', o_orderkey) AS id, concat('SB:', o_orderkey) AS submission, o_orderdate + INTERVAL 1 DAY * CAST(100 + o_orderkey % 500 AS INT) AS approved_on, concat('P:', o_orderkey % 200) AS product,
        CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'accelerated' WHEN 2 THEN 'conditional' ELSE 'tentative' END AS kind,
        CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + INTERVAL 1 DAY * CAST(2000 + o_orderkey % 1500 AS INT) END AS expires_on, CASE WHEN o_totalprice > 400000 THEN 'withdrawn' ELSE 'approved' END AS status FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000""",
    # subjects in trials and their arms, actions against makers, and commitments made at an approval
    "participation": """SELECT concat('U:', l_partkey) AS subject, concat('T:', l_orderkey) AS trial, concat('T:', l_orderkey, '/', l_linenumber % 2) AS arm,
        CASE WHEN l_returnflag = 'R' THEN 'WITHDREW_FROM' WHEN l_linestatus = 'F' THEN 'COMPLETED_TRIAL' ELSE 'ENROLLED_IN' END AS rel FROM {lineitem}""",
    "action": """SELECT concat('CA:', l_orderkey, '/', l_linenumber, '/', l_partkey) AS id, concat('M:', l_suppkey) AS manufacturer, concat('P:', l_partkey) AS product, l_shipdate AS issued, l_linestatus = 'O' AS active,
        CASE l_linenumber WHEN 1 THEN 'recall' WHEN 2 THEN 'warning' WHEN 3 THEN 'penalty' WHEN 4 THEN 'suspension' ELSE 'notice' END AS kind, l_extendedprice AS amount FROM {lineitem} WHERE l_returnflag = 'R'""",
    "commitment": """SELECT concat('PC:', o_orderkey) AS id, concat('AP:', o_orderkey) AS approval, concat('P:', o_orderkey % 200) AS product, o_orderdate + INTERVAL 1 DAY * CAST(900 + o_orderkey % 800 AS INT) AS due,
        CASE o_orderkey % 3 WHEN 0 THEN 'safety_study' WHEN 1 THEN 'efficacy_study' ELSE 'paediatric_study' END AS kind, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'fulfilled' WHEN '2' THEN 'delayed' ELSE 'pending' END AS status,
        CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS description FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000""",
    # what compounds, proteins, trials, people and makers are like; a part of the values is missing
    "structure": """SELECT concat('P:', p_partkey) AS id, p_partkey AS key, p_name AS name, concat(p_type, '/', p_brand, '/', p_size) AS scaffold, CASE WHEN p_partkey % 11 > 0 THEN concat('C', p_size, 'O') END AS smiles,
        CASE WHEN p_partkey % 13 > 0 THEN upper(substring(md5(p_name), 1, 14)) END AS inchikey, p_retailprice / 2 AS mass, p_size / CAST(7 AS DOUBLE) AS logp, p_partkey % 8 AS donors, p_partkey % 14 AS acceptors FROM {part}""",
    "descent": """SELECT concat('P:', p_partkey) AS compound, concat('P:', CAST(floor(p_partkey / 3) AS BIGINT)) AS successor FROM {part} WHERE p_partkey > 0""",
    "protein": """SELECT concat('S:', s_suppkey) AS id, s_name AS name, CASE WHEN s_suppkey % 7 > 0 THEN concat('UP', s_suppkey) END AS uniprot FROM {supplier}""",
    "interaction": """SELECT concat('S:', a.l_suppkey) AS protein_a, concat('S:', b.l_suppkey) AS protein_b, count(*) AS score FROM {lineitem} a JOIN {lineitem} b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey""",
    "assay": """SELECT concat('P:', l_partkey) AS compound, concat('S:', l_suppkey) AS target, min(l_returnflag) AS rel, 1 - 3 * (max(l_quantity) - min(l_quantity) + 2) / (6 * avg(l_quantity)) AS z_factor,
        CASE WHEN max(l_discount) > 0.01 THEN max(l_extendedprice) END AS activity FROM {lineitem} GROUP BY l_partkey, l_suppkey""",
    "protocol": """SELECT concat('T:', o_orderkey) AS id, o_orderkey AS key, CASE WHEN o_orderkey % 17 > 0 THEN CAST(floor(o_totalprice / 25000) AS INT) END AS planned, CASE o_orderkey % 2 WHEN 0 THEN 'randomised' ELSE 'single_arm' END AS allocation,
        CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'double_blind' ELSE 'single_blind' END AS masking, CASE substring(o_orderpriority, 1, 1) WHEN '5' THEN 'prevention' ELSE 'treatment' END AS purpose FROM {orders}""",
    "outcome": """SELECT DISTINCT concat('O:', l_suppkey) AS id, concat('T:', l_orderkey) AS trial, CASE l_linenumber WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' ELSE 'other' END AS kind,
        CASE l_returnflag WHEN 'A' THEN 'overall survival' ELSE 'response rate' END AS measure FROM {lineitem} WHERE l_returnflag <> 'R'""",
    "investigator": """SELECT DISTINCT concat('V:', l_suppkey) AS id, concat('T:', l_orderkey) AS trial, s_name AS name, CASE l_linenumber WHEN 1 THEN 'principal' ELSE 'sub' END AS position, n_name AS institution
        FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey WHERE l_linenumber <= 3""",
    "sponsor": """SELECT c_custkey AS key, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'industry' WHEN 'HOUSEHOLD' THEN 'government' ELSE 'academic' END AS kind FROM {customer}""",
    "person": """SELECT concat('U:', p_partkey) AS subject, CASE p_size % 2 WHEN 0 THEN 'female' ELSE 'male' END AS gender, 18 + p_size AS age FROM {part}""",
    "maker": """SELECT concat('M:', s_suppkey) AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'integrated' WHEN 1 THEN 'contract' ELSE 'virtual' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 'ingredient' WHEN 1 THEN 'excipient' ELSE 'packaging' END AS supplies,
        CASE WHEN s_suppkey % 6 > 0 THEN concat('FEI', s_suppkey) END AS fei FROM {supplier}""",
    "visit": """SELECT concat('I:', event_id) AS id, concat('M:', user_id) AS manufacturer, CASE WHEN event_id % 10 > 0 THEN CASE WHEN value > 60 THEN 'FAILED' ELSE 'PASSED' END END AS result, ts AS inspected FROM {events} WHERE event_type = 'purchase'""",
    "authorisation": """SELECT concat('AP:', o_orderkey) AS id, concat('A:', o_custkey % 5) AS agency, o_orderstatus = 'F' AS granted, CASE WHEN o_orderkey % 19 > 0 THEN o_orderdate + INTERVAL 1 DAY * CAST(100 + o_orderkey % 500 AS INT) END AS granted_on, 100 + o_orderkey % 500 AS days FROM {orders}""",
    "alert": """SELECT event_id AS key, CASE event_id % 3 WHEN 0 THEN 'hepatic' WHEN 1 THEN 'cardiac' ELSE 'renal' END AS kind FROM {events} WHERE event_type = 'view'""",
    "document": """SELECT doc_id AS key, source AS agency, lang, n_chars, text FROM {documents}""",
    "node": """SELECT id, 'Compound' AS label, name FROM {compound} UNION ALL SELECT id, 'Target', name FROM {target} UNION ALL SELECT id, 'Disease', name FROM {disease}
        UNION ALL SELECT id, 'Manufacturer', name FROM {manufacturer} UNION ALL SELECT id, 'ClinicalTrial', phase FROM {trial} UNION ALL SELECT id, 'SafetySignal', status FROM {signal}""",
    "edge": """SELECT compound AS src, target AS dst, rel FROM {acts_on} UNION ALL SELECT target, disease, rel FROM {associated} UNION ALL SELECT compound, disease, 'TREATS' FROM {treats}
        UNION ALL SELECT trial, compound, 'TESTS' FROM {trial_compound} UNION ALL SELECT product, manufacturer, 'MANUFACTURED_BY' FROM {product} UNION ALL SELECT compound, id, 'HAS_SIGNAL' FROM {signal}""",
    # the whole graph for paths and algorithms, and its layer of compounds, targets and pathways
    "layer": """SELECT compound AS src, target AS dst, rel FROM {acts_on} UNION ALL SELECT target, pathway, 'PARTICIPATES_IN' FROM {pathway_target}""",
    "link": """SELECT src, dst, rel FROM {edge} UNION ALL SELECT target, pathway, 'PARTICIPATES_IN' FROM {pathway_target}""",
}

#: (view, column of ids): the table and its numeric key that the ids are made of.
KEYS = {
    ("acts_on", "compound"): ("lineitem", "l_partkey"),
    ("acts_on", "target"): ("lineitem", "l_suppkey"),
    ("treats", "compound"): ("lineitem", "l_partkey"),
    ("treats", "disease"): ("orders", "o_custkey"),
    ("associated", "target"): ("lineitem", "l_suppkey"),
    ("associated", "disease"): ("orders", "o_custkey"),
    ("trial_compound", "compound"): ("lineitem", "l_partkey"),
    ("trial_compound", "trial"): ("lineitem", "l_orderkey"),
    ("pathway_target", "target"): ("supplier", "s_suppkey"),
    ("product", "product"): ("lineitem", "l_partkey"),
    ("product", "manufacturer"): ("lineitem", "l_suppkey"),
    ("action", "manufacturer"): ("lineitem", "l_suppkey"),
    ("participation", "subject"): ("lineitem", "l_partkey"),
    ("participation", "trial"): ("lineitem", "l_orderkey"),
    ("outcome", "trial"): ("lineitem", "l_orderkey"),
    ("investigator", "trial"): ("lineitem", "l_orderkey"),
    ("trial", "id"): ("orders", "o_orderkey"),
    ("trial", "disease"): ("orders", "o_custkey"),
    ("structure", "id"): ("part", "p_partkey"),
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Graph:
    """The views over one folder of tables, as DataFrames: g.compound, g.acts_on, ... and the tables themselves."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                uses = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
                self._made[name] = self.spark.sql(VIEWS[name], **{u: getattr(self, u) for u in uses})
        return self._made[name]

    def at(self, view: str, column: str, node: str) -> DataFrame:
        """The rows of a view for one node: its numeric key is compared in the table, so that the scan can skip by it."""
        table, key = KEYS[view, column]
        number = re.fullmatch(r"[A-Z]+:(\d{1,18})", node)
        own = getattr(self, table).filter(F.col(key) == int(number[1]) if number else F.lit(False))
        uses = set(re.findall(r"\{(\w+)\}", VIEWS[view]))
        return self.spark.sql(VIEWS[view], **{u: own if u == table else getattr(self, u) for u in uses}).filter(F.col(column) == node)

    @cached_property
    def undirected(self) -> DataFrame:
        """Every edge both ways; a self-loop once."""
        e = self.edge
        return e.unionByName(e.filter("src <> dst").selectExpr("dst AS src", "src AS dst", "rel"))


def with_views(sql: str) -> str:
    """sql with the views that it names, and those that they name, as common table expressions in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                need(" ".join(re.findall(r"\{(\w+)\}", VIEWS[name])))
                if name not in order:
                    order.append(name)

    body = sql.strip()
    need(re.sub(r"'[^']*'", "", body))
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in order)
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"
