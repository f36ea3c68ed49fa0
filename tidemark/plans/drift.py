"""Queries over document schemas and samples."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemark.functions import documents as docs
from tidemark.operators import drift as dr
from tidemark.plans.scalars import _DOC_SRC, _TOKENS_SQL, similar_sql
from tidemark.registry import query

c = F.col

# Versions before: every type and version with the one before it; fields side by side.
_STEP_CTE = """st AS (SELECT type_id, version, lag(version) OVER (PARTITION BY type_id ORDER BY version) AS prev FROM (SELECT DISTINCT type_id, version FROM schema_fields)),
  nw AS (SELECT s.type_id, s.version, s.name, s.type AS nt, s.confidence AS nc FROM schema_fields s), od AS (SELECT st.type_id, st.version, s.name, s.type AS ot, s.confidence AS oc FROM schema_fields s JOIN st ON s.type_id = st.type_id AND s.version = st.prev),
  sd AS (SELECT coalesce(n.type_id, o.type_id) AS type_id, coalesce(n.version, o.version) AS version, coalesce(n.name, o.name) AS name, nt, nc, ot, oc FROM nw n FULL JOIN od o ON n.type_id = o.type_id AND n.version = o.version AND n.name = o.name),
  sx AS (SELECT sd.*, st.prev IS NULL AS first FROM sd JOIN st USING (type_id, version))"""
_METRIC_CTE = _STEP_CTE + """,
  mt AS (SELECT type_id, version, CASE WHEN NOT any_value(first) AND count(nt) > 0 THEN count(*) FILTER (nt IS NOT NULL AND ot IS NOT NULL) / count(nt) ELSE 1.0 END AS field_stability, coalesce(count(*) FILTER (nc IN ('high', 'medium')) / nullif(count(nt), 0), 0.0) AS confidence_trend,
    CASE WHEN NOT any_value(first) AND count(nt) > 0 THEN count(*) FILTER (nt IS NOT NULL AND ot IS NULL) / count(nt) ELSE 0.0 END AS new_field_rate,
    CASE WHEN NOT any_value(first) AND count(*) FILTER (nt IS NOT NULL AND ot IS NOT NULL) > 0 THEN count(*) FILTER (nt = ot) / count(*) FILTER (nt IS NOT NULL AND ot IS NOT NULL) ELSE 1.0 END AS type_consistency FROM sx GROUP BY type_id, version),
  ml AS (SELECT type_id, version, metric, value FROM mt UNPIVOT (value FOR metric IN (field_stability, confidence_trend, new_field_rate, type_consistency)))"""


@query("win01_latest_version", views="schema_fields", sql="SELECT type_id, version, name, version + 1 AS next_version FROM schema_fields QUALIFY rank() OVER (PARTITION BY type_id ORDER BY version DESC) = 1")
def win01(t):
    return dr.latest_version(t.schema_fields).select("type_id", "version", "name", "next_version")


@query("jn13_schema_diff", views="schema_fields", sql=f"""
    WITH {_STEP_CTE} SELECT type_id, version, name, change FROM (SELECT *, 'added' AS change FROM sx WHERE ot IS NULL UNION ALL SELECT *, 'removed' FROM sx WHERE nt IS NULL UNION ALL SELECT *, 'modified' FROM sx WHERE nt <> ot UNION ALL SELECT *, 'confidence' FROM sx WHERE nc <> oc) WHERE NOT first""")
def jn13(t):
    return dr.diff(t.schema_fields).select("type_id", "version", "name", "change")


@query("set03_field_sets", views="schema_fields", sql=f"""
    WITH {_STEP_CTE} SELECT type_id, version, count(*) FILTER (nt IS NOT NULL AND ot IS NOT NULL) AS kept, count(*) FILTER (ot IS NULL) AS added, count(*) FILTER (nt IS NULL) AS dropped FROM sx WHERE NOT first GROUP BY ALL""")
def set03(t):
    j = dr.consecutive(t.schema_fields).where(~c("first"))
    return j.groupBy("type_id", "version").agg(F.count_if(c("new_type").isNotNull() & c("old_type").isNotNull()).alias("kept"),
                                               F.count_if(c("old_type").isNull()).alias("added"), F.count_if(c("new_type").isNull()).alias("dropped"))


@query("agg17_schema_metrics", views="schema_fields", sql=f"WITH {_METRIC_CTE} SELECT type_id, version, CAST(field_stability AS DOUBLE) AS field_stability, CAST(confidence_trend AS DOUBLE) AS confidence_trend, CAST(new_field_rate AS DOUBLE) AS new_field_rate, CAST(type_consistency AS DOUBLE) AS type_consistency FROM mt")
def agg17(t):
    return dr.version_metrics(t.schema_fields)


@query("win02_last_metrics", views="schema_fields", sql=f"WITH {_METRIC_CTE} SELECT type_id, metric, version, CAST(value AS DOUBLE) AS value FROM ml QUALIFY row_number() OVER (PARTITION BY type_id, metric ORDER BY version DESC) <= 5")
def win02(t):
    return dr.last_n(dr.metric_rows(dr.version_metrics(t.schema_fields)), ["type_id", "metric"], [F.desc("version")], 5).select("type_id", "metric", "version", "value")


_SCORE_CTE = _METRIC_CTE + """,
  av AS (SELECT type_id, metric, CASE WHEN count(*) >= 2 THEN avg(value) ELSE 0 END AS m FROM (SELECT * FROM ml QUALIFY row_number() OVER (PARTITION BY type_id, metric ORDER BY version DESC) <= 5) GROUP BY ALL),
  sc AS (SELECT type_id, greatest(0, least(1, (max(m) FILTER (metric = 'field_stability') + max(m) FILTER (metric = 'confidence_trend') + 1 - max(m) FILTER (metric = 'new_field_rate') + max(m) FILTER (metric = 'type_consistency')) / 4)) AS score FROM av GROUP BY type_id)"""


@query("agg18_convergence", views="schema_fields", sql=f"WITH {_SCORE_CTE} SELECT type_id, round(CAST(score AS DOUBLE), 9) AS score FROM sc")
def agg18(t):
    s = dr.convergence(dr.metric_rows(dr.version_metrics(t.schema_fields)))
    return s.select("type_id", F.round("score", 9).alias("score"))


_TOP = "(SELECT * FROM schema_fields QUALIFY rank() OVER (PARTITION BY type_id ORDER BY version DESC) = 1)"


@query("agg29_indicators", views="schema_fields doc_fields", sql=f"SELECT type_id, round(avg((confidence IN ('high', 'medium'))::INT), 9) AS average_confidence, count(*) AS fields, any_value(n) AS files_analyzed FROM {_TOP} JOIN (SELECT type_id, count(*) AS n FROM doc_fields GROUP BY 1) USING (type_id) GROUP BY type_id")
def agg29(t):
    return dr.indicators(t.schema_fields, t.doc_fields).select("type_id", F.round("average_confidence", 9).alias("average_confidence"), "fields", "files_analyzed")


# Canonical fields in order; one is in force before the third version only, one from the second on.
_CANON = ["vendor", "invoice_number", "total-amount", "Vendor_Name", "currency", "due_date", "notes", "po_number"]
_CANON_CTE = f"""ca AS (SELECT DISTINCT type_id, version, name, position FROM doc_names JOIN (VALUES {', '.join(f"('{n}', {i + 1})" for i, n in enumerate(_CANON))}) k(name, position) ON (name <> 'currency' OR version < 3) AND (name <> 'notes' OR version > 1))"""
_TIER = f"CASE WHEN lower(name) = lower(found_name) THEN 1 WHEN translate(lower(trim(name)), ' _-', '') = translate(lower(trim(found_name)), ' _-', '') THEN 2 WHEN {similar_sql('name', 'found_name')} THEN 3 END"


def _greedy_sql() -> str:
    """Fields in order take their best name that no field before has taken: one step per field."""
    steps = [f"ed AS (SELECT * FROM (SELECT d.type_id, d.version, d.doc_no, d.found_name, ca.name, ca.position, {_TIER} AS tier FROM doc_names d JOIN ca USING (type_id, version)) WHERE tier IS NOT NULL)"]
    taken = "SELECT NULL::BIGINT AS type_id, NULL::BIGINT AS version, NULL::BIGINT AS doc_no, NULL::VARCHAR AS name, NULL::VARCHAR AS found_name WHERE false"
    for i in range(1, len(_CANON) + 1):
        steps.append(f"t{i - 1} AS ({taken})")
        steps.append(f"p{i} AS (SELECT type_id, version, doc_no, name, arg_min(found_name, (tier, found_name)) AS found_name FROM ed WHERE position = {i} AND NOT EXISTS (SELECT 1 FROM t{i - 1} t WHERE t.type_id = ed.type_id AND t.doc_no = ed.doc_no AND t.found_name = ed.found_name) GROUP BY ALL)")
        taken = f"SELECT * FROM t{i - 1} UNION ALL SELECT type_id, version, doc_no, name, found_name FROM p{i}"
    return ", ".join([_CANON_CTE, *steps, f"mt AS ({taken})"])


_GREEDY_CTE = _greedy_sql()


def _canonical(t):
    fields = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i + 1).alias("position")) for i, n in enumerate(_CANON)))
    rows = t.doc_names.select("type_id", "version").distinct().select("type_id", "version", F.inline(fields))
    return rows.where("(name <> 'currency' OR version < 3) AND (name <> 'notes' OR version > 1)")


@query("agg19_field_presence", views="doc_names", sql=f"""
    WITH {_GREEDY_CTE}, dc AS (SELECT type_id, count(DISTINCT doc_no) AS n FROM doc_names GROUP BY 1), ht AS (SELECT m.*, trim(d.sample) AS sample FROM mt m JOIN doc_names d USING (type_id, doc_no, found_name)),
    al AS (SELECT type_id, name, lower(found_name) AS low, min((doc_no, found_name)) AS first FROM ht WHERE lower(found_name) <> lower(name) GROUP BY ALL),
    la AS (SELECT type_id, name, string_agg(struct_extract(first, 2), ',' ORDER BY first) AS aliases FROM al GROUP BY ALL),
    ss AS (SELECT type_id, name, count(*) AS k, max_by(sample, doc_no) FILTER (sample <> '') AS sample FROM ht GROUP BY ALL)
    SELECT c.type_id, c.name, coalesce(k, 0) AS document_count, round(coalesce(k, 0) / n, 9) AS presence_rate, sample, coalesce(aliases, '') AS aliases
    FROM (SELECT DISTINCT type_id, name FROM ca) c LEFT JOIN ss USING (type_id, name) LEFT JOIN la USING (type_id, name) JOIN dc ON dc.type_id = c.type_id""")
def agg19(t):
    return dr.presence(t.doc_names, _canonical(t)).select("type_id", "name", "document_count", F.round("presence_rate", 9).alias("presence_rate"), "sample", F.array_join("aliases", ",").alias("aliases"))


@query("jn14_match_fields", views="doc_names", sql=f"WITH {_GREEDY_CTE} SELECT type_id, version, doc_no, name, found_name FROM mt")
def jn14(t):
    return dr.assigned_names(t.doc_names, _canonical(t))


_HINTS = """SELECT DISTINCT type_id, CASE found_name WHEN 'due_date' THEN 'Due Date' WHEN 'vendor' THEN 'vendor' WHEN 'paid' THEN 'shipping' WHEN 'currency' THEN 'curr' ELSE 'amount' END AS label, found_name = 'paid' AS required, CASE WHEN found_name = 'paid' THEN 'date' ELSE '' END AS hint_type
    FROM doc_fields WHERE found_name IN ('due_date', 'vendor', 'paid', 'currency', 'total_amount')"""
_POS = "(SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY name) AS position FROM {x})"
_HINT_CTE = f"""hn AS ({_HINTS}), fl AS (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY name) AS position FROM {_TOP}), hp AS (SELECT h.type_id, h.label, f.name, f.confidence, f.position, CASE WHEN lower(label) = lower(name) THEN 1 WHEN translate(lower(trim(label)), ' _-', '') = translate(lower(trim(name)), ' _-', '') THEN 2
      WHEN contains(lower(name), lower(label)) OR contains(lower(label), lower(name)) THEN 3 END AS tier FROM hn h JOIN fl f USING (type_id)),
  hr AS (SELECT type_id, label, arg_min(name, (tier, position)) AS mapped_to FROM hp WHERE tier IS NOT NULL GROUP BY ALL)"""


def _latest(t):
    order = W.partitionBy("type_id").orderBy("name")
    return dr.latest_version(t.schema_fields).withColumn("position", F.row_number().over(order))


@query("jn18_resolve_hints", views="doc_fields schema_fields", sql=f"WITH {_HINT_CTE} SELECT hn.type_id, hn.label, hr.mapped_to, hr.mapped_to IS NOT NULL AS found FROM hn LEFT JOIN hr USING (type_id, label)")
def jn18(t):
    return dr.resolve_hints(t.select(_HINTS, "doc_fields"), _latest(t)).select("type_id", "label", "mapped_to", "found")


_EXCL = "SELECT DISTINCT type_id, CASE WHEN type_id % 3 = 0 THEN 'Vendors' ELSE 'notes field' END AS excluded FROM doc_fields"


@query("flt15_excluded_fields", views="doc_fields schema_fields", sql=f"""
    WITH ex AS ({_EXCL}) SELECT s.type_id, s.version, s.name FROM schema_fields s WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.type_id = s.type_id AND {similar_sql('s.name', 'ex.excluded')})""")
def flt15(t):
    return dr.without_excluded(t.schema_fields, t.select(_EXCL, "doc_fields")).select("type_id", "version", "name")


@query("set06_add_excluded", views="doc_fields", sql=f"""
    WITH ex AS ({_EXCL}), nw AS (SELECT DISTINCT type_id, trim(found_name) AS candidate FROM doc_fields) SELECT type_id, excluded FROM ex UNION ALL SELECT type_id, candidate FROM nw WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.type_id = nw.type_id AND {similar_sql('nw.candidate', 'ex.excluded')})""")
def set06(t):
    return dr.add_excluded(t.select(_EXCL, "doc_fields"), t.doc_fields.select("type_id", c("found_name").alias("excluded")))


@query("win11_absence_streak", views="schema_fields", sql="""
    WITH n AS (SELECT type_id, version, row_number() OVER (PARTITION BY type_id ORDER BY version) AS i FROM (SELECT DISTINCT type_id, version FROM schema_fields)), l AS (SELECT s.type_id, s.name, max(n.i) AS li, arg_max(s.confidence, n.i) AS lc FROM schema_fields s JOIN n USING (type_id, version) GROUP BY ALL),
    m AS (SELECT type_id, max(i) AS top FROM n GROUP BY 1) SELECT type_id, name, top - li AS absence_streak, top - li > 3 AS deprecated, CASE WHEN top = li THEN lc WHEN top - li = 1 AND lc = 'high' THEN 'medium' ELSE 'low' END AS confidence FROM l JOIN m USING (type_id)""")
def win11(t):
    return dr.absence_streaks(t.schema_fields, t.schema_fields)


@query("win12_unique_names", src="SELECT type_id, version, lower(replace(replace(found_name, ' ', '_'), '-', '_')) AS field, found_name, count(*) AS n FROM doc_fields GROUP BY type_id, version, found_name", views="doc_fields", sql="""
    SELECT type_id, version, found_name, CASE WHEN k = 1 THEN field ELSE field || '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY type_id, version, field ORDER BY found_name) AS k FROM src)""")
def win12(t, src):
    return dr.unique_names(src.select("type_id", "version", "field", "found_name"), ["type_id", "version"], "field", ["found_name"]).select("type_id", "version", "found_name", "unique_name")


_STRAT_SRC = "SELECT type_id, seen_at AS created_at, doc_no, CASE sample_no % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'text' WHEN 2 THEN 'convert_to_image' ELSE 'multi_pass' END AS strategy FROM doc_fields"


@query("agg20_strategy_consensus", src=_STRAT_SRC, views="doc_fields", sql="""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY created_at DESC, doc_no DESC) AS i FROM src), r AS (SELECT *, count(*) OVER (PARTITION BY type_id, strategy ORDER BY i) AS k FROM n WHERE i <= 5)
    SELECT type_id, arg_max(strategy, (k, -i)) AS strategy FROM r GROUP BY type_id""")
def agg20(t, src):
    return dr.strategy_consensus(src)


@query("dq15_proposal_errors", src="""SELECT type_id, version, doc_no, CASE sample_no % 7 WHEN 0 THEN '' ELSE found_name END AS name, CASE sample_no % 5 WHEN 0 THEN 'money' ELSE field_type END AS type, CASE sample_no % 6 WHEN 0 THEN 'sure' ELSE confidence END AS confidence, sample_no FROM doc_fields""", views="doc_fields", sql="""
    WITH x AS (SELECT *, row_number() OVER (PARTITION BY type_id, version, name ORDER BY doc_no) AS k FROM src)
    SELECT doc_no, code FROM (SELECT doc_no, 'empty_name' AS code FROM x WHERE name = '' UNION ALL SELECT doc_no, 'invalid_name' FROM x WHERE name <> '' AND contains(name, ' ') UNION ALL SELECT doc_no, 'invalid_type' FROM x WHERE type = 'money' UNION ALL SELECT doc_no, 'invalid_confidence' FROM x WHERE confidence = 'sure' UNION ALL SELECT doc_no, 'duplicate_name' FROM x WHERE k > 1)""")
def dq15(t, src):
    return dr.proposal_errors(src, ["type_id", "version"], ["doc_no"]).select("doc_no", "code")


@query("dq15_proposal_questions", src="SELECT event_id, event_id % 3 = 0 AS ocr, event_id % 5 = 0 AS help, event_id % 4 AS k FROM events", sql="""
    SELECT event_id, code FROM (SELECT event_id, 'empty_strategy' AS code FROM src WHERE NOT ocr AND k > 0 UNION ALL SELECT event_id, 'missing_questions' FROM src WHERE help AND k < 2 UNION ALL SELECT event_id, 'empty_question_id' FROM src, (VALUES (1), (2)) twice(i) WHERE k = 3 UNION ALL SELECT event_id, 'nil_fields' FROM src WHERE k = 1)""")
def dq15_questions(t, src):
    q = F.when(c("k") == 3, F.array(F.lit("q1"), F.lit(""), F.lit(""))).when(c("k") == 2, F.array(F.lit("q1"))).otherwise(F.array().cast("array<string>"))
    shaped = src.select("event_id", F.when(c("k") != 1, F.lit(2)).alias("n_fields"), c("ocr").alias("use_ocr"), F.lit(False).alias("convert_to_image"), F.lit(False).alias("multi_pass"),
                        F.when(c("k") == 0, F.lit("why")).alias("rationale"), c("help").alias("needs_help"), q.alias("question_ids"))
    return dr.proposal_questions(shaped).select("event_id", "code")


_CONF = "SELECT DISTINCT type_id, CASE WHEN type_id % 4 = 0 THEN 'built' ELSE 'draft' END AS build_status FROM doc_fields WHERE type_id % 2 = 0"


@query("jn16_build_views", views="doc_fields schema_fields", sql=f"""
    SELECT t.type_id, s.version, s.fields, c.build_status, coalesce(n.k, 0) AS sample_count FROM (SELECT DISTINCT type_id FROM doc_fields) t JOIN (SELECT type_id, version, count(*) AS fields FROM {_TOP} GROUP BY ALL) s USING (type_id)
    LEFT JOIN ({_CONF}) c USING (type_id) LEFT JOIN (SELECT type_id, count(*) AS k FROM doc_fields GROUP BY 1) n USING (type_id)""")
def jn16(t):
    return dr.build_views(t.doc_fields.select("type_id").distinct(), t.schema_fields, t.select(_CONF, "doc_fields"), t.doc_fields).select(
        "type_id", "version", "fields", "build_status", "sample_count")


_OVR = "SELECT DISTINCT type_id, found_name AS name, found_name <> 'paid' AS included, found_name = 'vendor' AS required, CASE WHEN found_name = 'lines' THEN 'critical' ELSE 'high' END AS emphasis FROM doc_fields WHERE found_name IN ('paid', 'vendor', 'lines')"


@query("jn20_field_overrides", views="doc_fields schema_fields", sql=f"""
    SELECT f.type_id, f.name, coalesce(o.included, true) AS included, coalesce(o.required, false) AS override_required, coalesce(o.emphasis, 'normal') AS emphasis, f.n_docs AS seen_in FROM {_TOP} f LEFT JOIN ({_OVR}) o ON o.type_id = f.type_id AND o.name = f.name""")
def jn20(t):
    top = dr.latest_version(t.schema_fields)
    stats = top.select("type_id", "name", c("n_docs").alias("document_count"))
    return dr.field_rows(top.withColumn("required", F.lit(False)), t.select(_OVR, "doc_fields"), stats).select("type_id", "name", "included", "override_required", "emphasis", "seen_in")


@query("top11_fields_by_emphasis", views="doc_fields schema_fields", sql=f"""
    SELECT f.type_id, f.name, coalesce(o.emphasis, 'normal') AS emphasis FROM {_TOP} f LEFT JOIN ({_OVR}) o ON o.type_id = f.type_id AND o.name = f.name WHERE coalesce(o.included, true)""")
def top11(t):
    top = dr.latest_version(t.schema_fields)
    stats = top.select("type_id", "name", c("n_docs").alias("document_count"))
    return dr.by_emphasis(dr.field_rows(top.withColumn("required", F.lit(False)), t.select(_OVR, "doc_fields"), stats)).select("type_id", "name", "emphasis")


_CUR = "SELECT type_id, name, max_by(type, version) AS type, max_by(confidence, version) AS confidence, CASE WHEN name = 'paid' THEN 'user' ELSE 'llm' END AS provenance, CASE WHEN name IN ('vendor', 'lines') THEN 3 ELSE 0 END AS absence_streak, name IN ('vendor', 'paid') AS required FROM schema_fields GROUP BY type_id, name"


@query("set05_merge_schema", views="doc_fields schema_fields", sql=f"""
    WITH ex AS ({_EXCL}), cu AS ({_CUR}), ptop AS (SELECT s.* FROM {_TOP} s WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.type_id = s.type_id AND {similar_sql('s.name', 'ex.excluded')})), hn AS ({_HINTS}), fl AS (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY name) AS position FROM {_TOP}),
    hp AS (SELECT h.type_id, h.label, f.name, f.confidence, f.type, fl.position, CASE WHEN lower(label) = lower(f.name) THEN 1 WHEN translate(lower(trim(label)), ' _-', '') = translate(lower(trim(f.name)), ' _-', '') THEN 2 WHEN contains(lower(f.name), lower(label)) OR contains(lower(label), lower(f.name)) THEN 3 END AS tier
      FROM hn h JOIN ptop f USING (type_id) JOIN fl ON fl.type_id = f.type_id AND fl.name = f.name), hm AS (SELECT type_id, label, arg_min(name, (tier, position)) AS mapped, arg_min(confidence, (tier, position)) AS mc, arg_min(type, (tier, position)) AS mtp FROM hp WHERE tier IS NOT NULL GROUP BY ALL),
    us AS (SELECT hn.type_id, hn.label AS name, coalesce(mtp, CASE WHEN hint_type <> '' THEN hint_type ELSE 'string' END) AS type, coalesce(mc, 'low') AS confidence, 'user' AS provenance, mapped IS NOT NULL OR required AS required, false AS deprecated FROM hn LEFT JOIN hm USING (type_id, label)),
    mo AS (SELECT p.type_id, p.name, p.type, p.confidence, 'llm' AS provenance, false AS required, false AS deprecated FROM ptop p WHERE NOT EXISTS (SELECT 1 FROM hn WHERE hn.type_id = p.type_id AND hn.label = p.name) AND NOT EXISTS (SELECT 1 FROM hm WHERE hm.type_id = p.type_id AND hm.mapped = p.name)),
    ne AS (SELECT * FROM us UNION ALL SELECT * FROM mo)
    SELECT *, CASE WHEN deprecated THEN 2 WHEN provenance = 'user' THEN 0 ELSE 1 END AS place FROM (SELECT * FROM ne UNION ALL SELECT c.type_id, c.name, c.type, CASE c.confidence WHEN 'high' THEN 'medium' ELSE 'low' END, c.provenance, c.required, c.absence_streak + 1 > 3 FROM cu c WHERE NOT EXISTS (SELECT 1 FROM ne WHERE ne.type_id = c.type_id AND ne.name = c.name) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.type_id = c.type_id AND {similar_sql('c.name', 'ex.excluded')}))""")
def set05(t):
    merged = dr.merge_schema(t.select(_CUR, "schema_fields"), _latest(t).select("type_id", "name", "type", "confidence", "position"), t.select(_HINTS, "doc_fields"), t.select(_EXCL, "doc_fields"))
    return merged.select("type_id", "name", "type", "confidence", "provenance", "required", "deprecated", "place")


@query("qry09_type_summaries", views="doc_fields schema_fields", sql=f"SELECT type_id, any_value(version) AS version, count(*) AS fields, any_value(n) AS files_analyzed FROM {_TOP} JOIN (SELECT type_id, count(*) AS n FROM doc_fields GROUP BY 1) USING (type_id) GROUP BY type_id")
def qry09(t):
    top = dr.latest_version(t.schema_fields).groupBy("type_id", "version").agg(F.count("*").alias("fields"))
    return top.join(t.doc_fields.groupBy("type_id").agg(F.count("*").alias("files_analyzed")), "type_id")


# Every document is a version: its names are the proposal, with all hints and exclusions of its type.
_PROPOSED = "SELECT type_id, doc_no AS version, found_name AS name, type, confidence, row_number() OVER (PARTITION BY type_id, doc_no ORDER BY found_name) AS position FROM doc_names"
_REFINE_CTE = f"""ex AS ({_EXCL}), hn AS ({_HINTS}), pr AS ({_PROPOSED}), pe AS (SELECT * FROM pr WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.type_id = pr.type_id AND {similar_sql('pr.name', 'ex.excluded')})),
    vs AS (SELECT type_id, version, row_number() OVER (PARTITION BY type_id ORDER BY version) AS i FROM (SELECT DISTINCT type_id, version FROM pr)),
    hp AS (SELECT h.type_id, p.version, h.label, p.name, p.type, p.confidence, p.position, CASE WHEN lower(label) = lower(name) THEN 1 WHEN translate(lower(trim(label)), ' _-', '') = translate(lower(trim(name)), ' _-', '') THEN 2
      WHEN contains(lower(name), lower(label)) OR contains(lower(label), lower(name)) THEN 3 END AS tier FROM hn h JOIN pe p USING (type_id)),
    hm AS (SELECT type_id, version, label, arg_min(name, (tier, position)) AS mapped, arg_min(type, (tier, position)) AS mtp, arg_min(confidence, (tier, position)) AS mc FROM hp WHERE tier IS NOT NULL GROUP BY ALL),
    us AS (SELECT vs.type_id, vs.i, hn.label AS name, coalesce(mtp, CASE WHEN hint_type <> '' THEN hint_type ELSE 'string' END) AS type, coalesce(mc, 'low') AS confidence, 'user' AS provenance, mapped IS NOT NULL OR required AS required FROM vs JOIN hn USING (type_id) LEFT JOIN hm ON hm.type_id = vs.type_id AND hm.version = vs.version AND hm.label = hn.label),
    mo AS (SELECT p.type_id, vs.i, p.name, p.type, p.confidence, 'llm' AS provenance, false AS required FROM pe p JOIN vs USING (type_id, version) WHERE NOT EXISTS (SELECT 1 FROM hn WHERE hn.type_id = p.type_id AND hn.label = p.name) AND NOT EXISTS (SELECT 1 FROM hm WHERE hm.type_id = p.type_id AND hm.version = p.version AND hm.mapped = p.name)),
    ne AS (SELECT * FROM us UNION ALL SELECT * FROM mo),
    ag AS (SELECT vs.type_id, vs.i, vs.version, coalesce(list({{'n': name, 't': type, 'c': confidence, 'p': provenance, 'r': required}}) FILTER (name IS NOT NULL), []) AS fs FROM vs LEFT JOIN ne ON ne.type_id = vs.type_id AND ne.i = vs.i GROUP BY ALL)"""
# One step per version, each made from the state before it.
_FOLD_CTE = """fo(type_id, i, version, st) AS (
    SELECT type_id, i, version, list_transform(fs, lambda f: {'n': f.n, 't': f.t, 'c': f.c, 'p': f.p, 'r': f.r, 'k': 0, 'ot': NULL::VARCHAR, 'oc': NULL::VARCHAR, 'od': NULL::BOOLEAN}) FROM ag WHERE i = 1
    UNION ALL SELECT fo.type_id, ag.i, ag.version, list_concat(
      list_transform(ag.fs, lambda f: {'n': f.n, 't': f.t, 'c': f.c, 'p': f.p, 'r': f.r, 'k': 0, 'ot': list_filter(fo.st, lambda s: s.n = f.n)[1].t, 'oc': list_filter(fo.st, lambda s: s.n = f.n)[1].c, 'od': list_filter(fo.st, lambda s: s.n = f.n)[1].k > 3}),
      list_transform(list_filter(fo.st, lambda s: NOT list_contains(list_transform(ag.fs, lambda f: f.n), s.n)), lambda s: {'n': s.n, 't': s.t, 'c': CASE s.c WHEN 'high' THEN 'medium' ELSE 'low' END, 'p': s.p, 'r': s.r, 'k': s.k + 1, 'ot': s.t, 'oc': s.c, 'od': s.k > 3}))
    FROM fo JOIN ag ON ag.type_id = fo.type_id AND ag.i = fo.i + 1),
    sr AS (SELECT type_id, i, version, unnest(st) AS s FROM fo), sf AS (SELECT type_id, i, version, s.n AS name, s.t AS type, s.c AS confidence, s.p AS provenance, s.r AS required, s.k AS streak, s.k > 3 AS dep, s.ot AS ot, s.oc AS oc, s.od AS od FROM sr)"""


def _refined(t):
    proposed = t.select(_PROPOSED, "doc_names")
    return dr.refined_versions(proposed, t.select(_HINTS, "doc_fields"), t.select(_EXCL, "doc_fields"))


@query("qry11_refine_schema", views="doc_fields doc_names", sql=f"""
    WITH RECURSIVE {_REFINE_CTE}, {_FOLD_CTE}, nb AS (SELECT type_id, i, version, count(*) FILTER (NOT dep) AS fields, count(*) FILTER (dep) AS deprecated, count(*) FILTER (NOT dep AND ot IS NULL) AS added, count(*) FILTER (dep AND ot IS NOT NULL) AS removed,
      count(*) FILTER (NOT dep AND ot <> type) AS modified, count(*) FILTER (NOT dep AND oc <> confidence) AS confidence_changes, count(*) FILTER (ot <> type AND provenance = 'llm' AND streak = 0) AS type_conflicts, count(*) FILTER (NOT dep AND ot IS NOT NULL AND NOT od) AS kept,
      count(*) FILTER (NOT dep AND confidence IN ('high', 'medium')) AS hi, count(*) FILTER (NOT dep AND ot IS NOT NULL) AS known, count(*) FILTER (NOT dep AND ot = type) AS same FROM sf GROUP BY ALL),
    me AS (SELECT *, CASE WHEN i > 1 AND fields > 0 THEN kept / fields ELSE 1.0 END AS field_stability, coalesce(hi / nullif(fields, 0), 0.0) AS confidence_trend, CASE WHEN i > 1 AND fields > 0 THEN (fields - kept) / fields ELSE 0.0 END AS new_field_rate, CASE WHEN i > 1 AND known > 0 THEN same / known ELSE 1.0 END AS type_consistency FROM nb),
    sc AS (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN (avg(field_stability) OVER w + avg(confidence_trend) OVER w + 1 - avg(new_field_rate) OVER w + avg(type_consistency) OVER w) / 4 ELSE 0.25 END AS s FROM me WINDOW w AS (PARTITION BY type_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT type_id, version, version + 1 AS next_version, fields, deprecated, added, removed, modified, confidence_changes, type_conflicts, round(CAST(field_stability AS DOUBLE), 9) AS field_stability, round(CAST(confidence_trend AS DOUBLE), 9) AS confidence_trend, round(CAST(new_field_rate AS DOUBLE), 9) AS new_field_rate,
      round(CAST(type_consistency AS DOUBLE), 9) AS type_consistency, round(CAST(s AS DOUBLE), 9) AS score, CASE WHEN round(s, 9) < 0.4 THEN 'needs_more_samples' WHEN round(s, 9) < 0.7 THEN 'continue_with_more_samples' WHEN round(s, 9) < 0.9 THEN 'ready_for_review' ELSE 'ready_for_production' END AS advice FROM sc""")
def qry11(t):
    steps = dr.refinement(_refined(t))
    return steps.select(*[F.round(x, 9).alias(x) if dict(steps.dtypes)[x] == "double" else c(x) for x in steps.columns])


@query("qry11_refined_fields", views="doc_fields doc_names", sql=f"""
    WITH RECURSIVE {_REFINE_CTE}, {_FOLD_CTE} SELECT type_id, name, type, confidence, provenance, required, streak::BIGINT AS absence_streak, dep AS deprecated, CASE WHEN dep THEN 2 WHEN provenance = 'user' THEN 0 ELSE 1 END AS place FROM sf QUALIFY i = max(i) OVER (PARTITION BY type_id)""")
def qry11_fields(t):
    rows = _refined(t)
    last = rows.groupBy("type_id").agg(F.max("i").alias("i"))
    return rows.join(last, ["type_id", "i"]).select("type_id", "name", "type", "confidence", "provenance", "required", "absence_streak", "deprecated", "place")


# ---- samples ----

_IN = "SELECT type_id, doc_id, original_name, size_bytes, CASE WHEN doc_id % 5 = 0 THEN '' ELSE content_hash END AS content_hash, doc_id AS seen_at FROM samples WHERE doc_id % 2 = 1"
_STORED = "SELECT type_id, doc_id AS sample_id, doc_id AS file_id, original_name, size_bytes, known_hash AS content_hash, doc_id AS first_seen_at, doc_id AS last_seen_at, 1 AS analysis_count FROM samples WHERE doc_id % 2 = 0"
_DUP_CTE = f"""inc AS ({_IN}), sto AS ({_STORED}), bh AS (SELECT type_id, content_hash, min(sample_id) AS ex FROM sto WHERE content_hash <> '' GROUP BY ALL), bn AS (SELECT type_id, size_bytes, lower(original_name) AS n, min(sample_id) AS nm FROM sto GROUP BY ALL),
  dm AS (SELECT i.*, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN nm IS NOT NULL THEN 'name_size' END AS match_type, coalesce(ex, nm) AS sample_id FROM inc i LEFT JOIN bh ON bh.type_id = i.type_id AND bh.content_hash = i.content_hash LEFT JOIN bn ON bn.type_id = i.type_id AND bn.size_bytes = i.size_bytes AND bn.n = lower(trim(i.original_name)))"""


@query("jn15_duplicate_samples", views="samples", sql=f"WITH {_DUP_CTE} SELECT doc_id, match_type, sample_id FROM dm")
def jn15(t):
    return dr.duplicate_samples(t.select(_IN, "samples"), t.select(_STORED, "samples")).select("doc_id", "match_type", "sample_id")


@query("snk06_register_samples", views="samples", sql=f"""
    WITH {_DUP_CTE}, hi AS (SELECT type_id, sample_id, count(*) AS k, max(seen_at) AS sn, arg_max(doc_id, seen_at) AS fl, arg_min(content_hash, seen_at) FILTER (content_hash <> '') AS h FROM dm WHERE sample_id IS NOT NULL GROUP BY ALL),
    fr AS (SELECT *, lower(trim(original_name)) AS nm FROM dm WHERE sample_id IS NULL),
    gr AS (SELECT type_id, size_bytes, nm, min(doc_id) AS first_doc, arg_min(content_hash, doc_id) FILTER (content_hash <> '') AS stored FROM fr GROUP BY ALL),
    root AS (SELECT type_id, stored, min(first_doc) AS root FROM gr WHERE stored IS NOT NULL GROUP BY ALL),
    who AS (SELECT fr.*, coalesce(own.root, other.root, gr.first_doc) AS sample FROM fr JOIN gr USING (type_id, size_bytes, nm) LEFT JOIN root own ON own.type_id = fr.type_id AND own.stored = fr.content_hash LEFT JOIN root other ON other.type_id = gr.type_id AND other.stored = gr.stored),
    made AS (SELECT type_id, sample, min(seen_at) AS fs, max(seen_at) AS ls, max(doc_id) AS fl, count(*) AS n FROM who GROUP BY ALL)
    SELECT s.type_id, s.sample_id, coalesce(fl, s.file_id) AS file_id, CASE WHEN s.content_hash = '' AND h IS NOT NULL THEN h ELSE s.content_hash END AS content_hash, s.first_seen_at, greatest(s.last_seen_at, coalesce(sn, s.last_seen_at)) AS last_seen_at, CAST(s.analysis_count + coalesce(k, 0) AS BIGINT) AS analysis_count FROM sto s LEFT JOIN hi USING (type_id, sample_id)
    UNION ALL SELECT m.type_id, m.sample, m.fl, coalesce(g.stored, ''), m.fs, m.ls, m.n FROM made m JOIN fr ON fr.doc_id = m.sample JOIN gr g ON g.type_id = fr.type_id AND g.size_bytes = fr.size_bytes AND g.nm = fr.nm""")
def snk06(t):
    return dr.register_samples(t.select(_STORED, "samples"), t.select(_IN, "samples")).select("type_id", "sample_id", "file_id", "content_hash", "first_seen_at", "last_seen_at", c("analysis_count").cast("bigint").alias("analysis_count"))


@query("agg22_sample_backfill", views="samples", sql="SELECT type_id, lower(original_name) AS name, size_bytes, min(doc_id) AS file_id, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(*) AS analysis_count FROM samples s JOIN labels USING (doc_id) GROUP BY ALL")
def agg22(t):
    j = t.samples.join(t.labels.select("doc_id"), "doc_id")
    return j.groupBy("type_id", F.lower("original_name").alias("name"), "size_bytes").agg(
        F.min("doc_id").alias("file_id"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"), F.count("*").alias("analysis_count"))


@query("agg28_request_tokens", src=_DOC_SRC, sql=f"SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files FROM {_TOKENS_SQL} GROUP BY source")
def agg28(t, src):
    tokens = docs.token_estimate(c("mime"), c("size"), c("chars"), c("has_text"), c("passes"))
    return src.groupBy("source").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("files"))


@query("scl28_schema_hash", views="schema_fields", sql="""
    SELECT type_id, version, sha256('[' || string_agg('{"name":"' || name || '","type":"' || type || '","confidence":"' || confidence || '"}', ',' ORDER BY name) || ']') AS schema_hash FROM schema_fields GROUP BY ALL""")
def scl28_schema(t):
    return dr.schema_hash(t.schema_fields, ["type_id", "version"])
