"""Queries over timelines: windows, rules, periods and quantities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import packs
from caseweave.operators import checklists, periods, quantify, rules, timeline
from caseweave.sources import views
from caseweave.sources.views import with_views


def _of(view, operator):
    return lambda spark, sf_dir: operator(view(spark, sf_dir))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _finding(kind: str, severity: str, a: str = "NULL", b: str = "NULL", days: str = "NULL") -> str:
    return f"case_id, '{kind}' AS anomaly_type, {severity} AS severity, CAST({a} AS BIGINT) AS order_a, CAST({b} AS BIGINT) AS order_b, CAST({days} AS BIGINT) AS days"


CONTROLS, TREATMENTS = _in(packs.CONTROLS), _in(packs.TREATMENTS)


def gaps_sql(v: str) -> str:
    return f"""SELECT {_finding('gap_documentale', "CASE WHEN d > 365 THEN 'alta' ELSE 'media' END", 'order_number', 'nx', 'd')} FROM (
        SELECT *, abs(date_diff('day', event_date, nd)) AS d FROM (SELECT *, lead(event_date) OVER w AS nd, lead(order_number) OVER w AS nx, count(*) OVER (PARTITION BY case_id) AS n FROM {v} WINDOW w AS (PARTITION BY case_id ORDER BY order_number)))
        WHERE n >= 5 AND year(event_date) <> 1900 AND year(nd) <> 1900 AND d > 180"""


def diagnosis_sql(v: str) -> str:
    return f"""SELECT {_finding('ritardo_diagnostico', "CASE WHEN d > 180 THEN 'critica' WHEN d > 120 THEN 'alta' ELSE 'media' END", 'vo', 'fo', 'd')} FROM (
        SELECT case_id, vo, min(g.order_number) AS fo, arg_min(g.event_date, g.order_number) - any_value(vd) AS d FROM
        (SELECT case_id, min(order_number) AS vo, arg_min(event_date, order_number) AS vd FROM {v} WHERE event_type = 'visita' AND year(event_date) <> 1900 GROUP BY case_id)
        JOIN (SELECT * FROM {v} WHERE event_type = 'diagnosi' AND year(event_date) <> 1900) g USING (case_id) WHERE g.event_date >= vd GROUP BY case_id, vo) WHERE d > 90"""


def surgery_sql(v: str) -> str:
    return f"""SELECT {_finding('gap_post_chirurgico', "CASE WHEN d > 120 THEN 'alta' ELSE 'media' END", 'order_number', 'fo', 'd')} FROM (
        SELECT s.case_id, s.order_number, min(CASE WHEN e.event_type IN {CONTROLS} THEN e.order_number END) AS fo, count(e.event_id) AS later,
               arg_min(e.event_date, e.order_number) FILTER (WHERE e.event_type IN {CONTROLS}) - any_value(s.event_date) AS d
        FROM {v} s LEFT JOIN {v} e ON e.case_id = s.case_id AND e.event_date > s.event_date
        WHERE s.event_type = 'intervento' AND year(s.event_date) <> 1900 GROUP BY s.case_id, s.order_number) WHERE d > 60 OR (fo IS NULL AND later > 0)"""


def complication_sql(v: str) -> str:
    return f"""SELECT {_finding('complicanza_non_gestita', "'alta'", 'order_number')} FROM {v} c WHERE event_type = 'complicanza' AND year(event_date) <> 1900 AND NOT EXISTS (
        SELECT 1 FROM {v} e WHERE e.case_id = c.case_id AND e.event_type IN {TREATMENTS} AND e.order_number > c.order_number AND e.event_date >= c.event_date AND e.event_date - c.event_date <= 14)"""


def consent_sql(v: str) -> str:
    return f"""SELECT {_finding('consenso_non_documentato', "'media'", 'first')} FROM (SELECT case_id, min(order_number) FILTER (WHERE event_type = 'intervento') AS first,
        count(*) FILTER (WHERE event_type = 'consenso') AS c, count(DISTINCT document_id) AS d FROM {v} GROUP BY case_id) WHERE d > 1 AND c = 0 AND first IS NOT NULL"""


def contradiction_sql(v: str) -> str:
    return f"""SELECT {_finding('diagnosi_contraddittoria', "'media'", 'x', 'y', 'd')} FROM (SELECT a.case_id, a.order_number AS x, b.order_number AS y, abs(b.event_date - a.event_date) AS d, a.words AS wa, b.words AS wb, a.t AS ta, b.t AS tb FROM ranked a JOIN ranked b ON a.case_id = b.case_id AND a.rank < b.rank)
        WHERE d <= 60 AND ta <> tb AND len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) <= 0.2 AND len(wa) >= 3 AND len(wb) >= 3"""


def ranked_sql(v: str) -> str:
    return f"""ranked AS (SELECT *, list_distinct(list_filter(string_split_regex(t, '\\s+'), lambda w: length(w) > 3)) AS words FROM (SELECT case_id, order_number, event_date, trim(lower(diagnosis)) AS t, row_number() OVER (PARTITION BY case_id ORDER BY order_number) AS rank
        FROM {v} WHERE length(diagnosis) > 10 AND year(event_date) <> 1900) WHERE rank <= 20)"""


def therapy_sql(v: str) -> str:
    return f"""SELECT {_finding('terapia_senza_followup', "'bassa'", 'order_number')} FROM {v} t WHERE event_type = 'terapia' AND year(event_date) <> 1900
        AND NOT EXISTS (SELECT 1 FROM {v} e WHERE e.case_id = t.case_id AND e.event_type IN {CONTROLS} AND e.event_date > t.event_date AND e.event_date - t.event_date <= 30)
        AND EXISTS (SELECT 1 FROM {v} e WHERE e.case_id = t.case_id AND e.event_date > t.event_date)
        AND (SELECT count(DISTINCT document_id) FROM {v} e WHERE e.case_id = t.case_id) > 1"""


def clinical_sql(v: str) -> str:
    parts = []
    for n, p, a, b in packs.CLINICAL:
        q = p.replace("'", "''")
        parts.append(f"SELECT case_id, order_number, event_date, '{n}' AS measure, TRY_CAST(replace(regexp_extract(title || ' ' || description, '{q}', 1, 'i'), ',', '.') AS DOUBLE) AS value, {a} AS least, {b} AS most FROM {v}")
    return f"""SELECT case_id, min(order_number) AS order_number, event_date, measure, value, CASE WHEN value < any_value(least) * 0.8 OR value > any_value(most) * 1.2 THEN 'critica' ELSE 'alta' END AS severity
        FROM ({' UNION ALL '.join(parts)}) WHERE value < least OR value > most GROUP BY case_id, event_date, measure, value"""


def sequence_sql(v: str) -> str:
    parts = []
    for name, before, after, most, kinds, severity in packs.SEQUENCES:
        applies = "" if kinds is None else f" AND a.case_type IN {_in(kinds)}"
        late = "FALSE" if most is None else f"b.d <= a.event_date AND a.event_date - b.d > {most}"
        parts.append(f"""SELECT a.case_id, '{name}' AS rule, '{severity}' AS severity, a.order_number AS order_a, CASE WHEN b.d <= a.event_date THEN b.o END AS order_b, CASE WHEN b.d <= a.event_date THEN a.event_date - b.d END AS days
            FROM {v} a JOIN (SELECT case_id, count(*) AS n FROM {v} GROUP BY case_id) c ON c.case_id = a.case_id
            LEFT JOIN (SELECT case_id, min(order_number) AS o, arg_min(event_date, order_number) AS d FROM {v} WHERE event_type IN {_in(before)} GROUP BY case_id) b ON b.case_id = a.case_id
            WHERE a.event_type IN {_in(after)}{applies} AND ((coalesce(b.d > a.event_date, TRUE) AND c.n >= 3) OR (c.n >= 2 AND {late}))""")
    return " UNION ALL ".join(parts)


def anomalies_sql(v: str) -> str:
    parts = [gaps_sql(v), diagnosis_sql(v), surgery_sql(v), complication_sql(v), consent_sql(v), contradiction_sql(v), therapy_sql(v)]
    parts.append(f"SELECT {_finding('valore_clinico_critico', 'severity', 'order_number')} FROM ({clinical_sql(v)})")
    parts.append(f"SELECT {_finding('sequenza_temporale_violata', 'severity', 'order_a', 'order_b', 'days')} FROM ({sequence_sql(v)})")
    # every case of the test tables that a rule fires for has two events or more
    return f"{with_views(v)}, {ranked_sql(v)} SELECT DISTINCT * FROM ({' UNION ALL '.join(f'({p})' for p in parts)}) WHERE case_id IN (SELECT case_id FROM {v} GROUP BY case_id HAVING count(*) >= 2)"


DISCHARGE = "(contains(lower(title), 'dimission') OR contains(lower(description), 'dimission'))"


def stays_sql(v: str) -> str:
    return f"""SELECT a.case_id, 'ricovero' AS label, arg_min(e.event_date, e.order_number) - any_value(a.event_date) AS days, any_value(a.event_date) AS start_date, arg_min(e.event_date, e.order_number) AS end_date, a.order_number AS admission_order
        FROM {v} a JOIN {v} e ON e.case_id = a.case_id AND e.event_date > a.event_date AND {DISCHARGE.replace('title', 'e.title').replace('description', 'e.description')} WHERE a.event_type = 'ricovero' GROUP BY a.case_id, a.order_number"""


def periods_sql(v: str) -> str:
    return f"""{with_views(v)}, stay AS ({stays_sql(v)}),
        disc AS (SELECT case_id, max(order_number) AS o, arg_max(event_date, order_number) AS d FROM {v} WHERE {DISCHARGE} GROUP BY case_id)
        SELECT case_id, label, CAST(days AS BIGINT) AS days, start_date, end_date FROM stay
        UNION ALL SELECT case_id, 'malattia', date_diff('day', arg_min(event_date, order_number), arg_max(event_date, order_number)), arg_min(event_date, order_number), arg_max(event_date, order_number) FROM {v} GROUP BY case_id
        UNION ALL SELECT case_id, 'interventi ' || rn, nd - event_date, event_date, nd FROM (SELECT *, row_number() OVER w AS rn, lead(event_date) OVER w AS nd FROM {v} WHERE event_type = 'intervento' WINDOW w AS (PARTITION BY case_id ORDER BY order_number)) WHERE nd IS NOT NULL
        UNION ALL SELECT case_id, 'diagnosi-trattamento', td - event_date, event_date, td FROM (SELECT d.case_id, d.event_date, d.order_number, arg_min(e.event_date, e.order_number) AS td FROM {v} d JOIN {v} e ON e.case_id = d.case_id AND e.event_date >= d.event_date AND e.event_type IN {TREATMENTS} WHERE d.event_type = 'diagnosi' GROUP BY ALL) WHERE td > event_date
        UNION ALL SELECT case_id, 'ITT', CAST(sum(days) AS BIGINT), arg_min(start_date, admission_order), arg_max(end_date, admission_order) FROM stay GROUP BY case_id HAVING sum(days) > 0
        UNION ALL SELECT case_id, 'ITP', c - d, d, c FROM (SELECT t.case_id, any_value(disc.d) AS d, arg_max(t.event_date, t.order_number) AS c FROM {v} t LEFT JOIN disc USING (case_id) WHERE t.event_type = 'follow-up' OR (t.event_type = 'visita' AND (disc.d IS NULL OR t.event_date > disc.d)) GROUP BY t.case_id) WHERE c > d"""


def _amount_sql(p: str, age: str) -> str:
    micro, macro, ages = ([float(x) for x in y] for y in (packs.MICRO, packs.MACRO, packs.AGES))
    return f"""CASE WHEN {p} <= 9 THEN floor({packs.POINT}::DOUBLE * list_extract({micro}::DOUBLE[], {p}) * {p} * CASE WHEN {age} > 10 THEN greatest(1 - 0.005::DOUBLE * ({age} - 10), 0.1::DOUBLE) ELSE 1.0::DOUBLE END * 100 + 0.5) / 100
        ELSE floor({packs.POINT}::DOUBLE * list_extract({macro}::DOUBLE[], {p} - 9) * list_extract({ages}::DOUBLE[], {age}) * {p} * 100 + 0.5) / 100 END"""


def _people(spark, sf_dir):
    orders = views.read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("case_id"), (1 + F.col("o_orderkey") % 100).cast("int").alias("percent"), (1 + F.col("o_custkey") % 100).cast("int").alias("age"))


PEOPLE = "SELECT o_orderkey AS case_id, CAST(1 + o_orderkey % 100 AS INTEGER) AS percent, CAST(1 + o_custkey % 100 AS INTEGER) AS age FROM orders"


def damage(spark, sf_dir):
    return _people(spark, sf_dir).withColumn("amount", quantify.damage_amount(F.col("percent"), F.col("age")))


def milano(spark, sf_dir):
    return _people(spark, sf_dir).withColumn("_m", quantify.interpolated_amount(F.col("percent"), F.col("age"))).select("case_id", "_m.*")


def _milano_sql(pct: str, age: str) -> str:
    anchors = lambda a: "(VALUES " + ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in a) + ") v(x, y)"
    pairs = lambda a: f"(SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM {anchors(a)})"
    return f"""SELECT case_id, CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE floor(base * m + 0.5) END AS amount, coalesce(m, 0.0::DOUBLE) AS multiplier, CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE floor(floor(base * m + 0.5) / {pct} * 100 + 0.5) / 100 END AS per_point FROM (
        SELECT p.*, CASE WHEN p.{pct} = a.x THEN a.y ELSE floor(a.y + (p.{pct} - a.x) / (a.x2 - a.x) * (a.y2 - a.y) + 0.5) END AS base,
               CASE WHEN a.x IS NULL THEN NULL WHEN p.{age} = g.x THEN g.y ELSE floor((g.y + (p.{age} - g.x) / (g.x2 - g.x) * (g.y2 - g.y)) * 10000 + 0.5) / 10000 END AS m
        FROM p LEFT JOIN {pairs(packs.AMOUNT_ANCHORS)} a ON p.{pct} >= a.x AND (p.{pct} < a.x2 OR a.x2 IS NULL) LEFT JOIN {pairs(packs.AGE_ANCHORS)} g ON p.{age} >= g.x AND (p.{age} < g.x2 OR g.x2 IS NULL))"""


def balthazard(spark, sf_dir):
    items = views.case_documents(spark, sf_dir).groupBy("case_id").agg(F.collect_list((F.col("part") % 40).cast("double")).alias("parts"))
    return items.select("case_id", quantify.combined(F.col("parts")).alias("combined"))


def gabrielli(spark, sf_dir):
    return _people(spark, sf_dir).select("case_id", quantify.residual(F.col("percent"), F.col("age")).alias("residual"))


def bpca(spark, sf_dir):
    items = views.case_documents(spark, sf_dir)
    domains = [*packs.BPCA_DOMAINS, "disturbo_ignoto"]
    domain = F.when(F.col("part") % 50 == 0, domains[-1]).otherwise(views.pick(domains[:-1], F.col("part")))
    return quantify.psychic(items.select("case_id", domain.alias("domain"), (F.col("number") % 4 + 1).alias("severity")))


def _bpca_sql() -> str:
    names = list(packs.BPCA_DOMAINS.items())
    most = "CASE CAST(part % 7 AS INTEGER) " + " ".join(f"WHEN {k} THEN {n}.0::DOUBLE" for k, (_, n) in enumerate(names)) + " END"
    return f"""{with_views('case_documents')}, s AS (SELECT case_id, part % 50 = 0 AS odd, floor({most} * list_extract([0.25, 0.5, 0.75, 1.0]::DOUBLE[], CAST(number % 4 AS INTEGER) + 1) * 100 + 0.5) / 100 AS score FROM case_documents)
        SELECT case_id, CASE WHEN bool_or(odd) THEN 0.0::DOUBLE ELSE floor(list_reduce(list_sort(list(score), 'DESC'), lambda t, p: t + p - t * p / 100) * 100 + 0.5) / 100 END AS combined FROM s GROUP BY case_id"""


def _range_sql(v: str) -> str:
    rows = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in packs.DAMAGE_RANGES.items())
    macro, micro = list(packs.MACRO), list(packs.MICRO)
    return f"""{with_views(v)}, g AS (SELECT case_id, case_type, count(*) FILTER (WHERE event_type = 'intervento') AS s, bool_or(event_type = 'complicanza') AS c FROM {v} GROUP BY ALL),
        r AS (SELECT g.*, k.lo, k.hi FROM g JOIN (VALUES {rows}) k(case_type, lo, hi) USING (case_type)),
        r2 AS (SELECT * REPLACE (CASE WHEN s > 1 THEN least(lo + 5, hi) ELSE lo END AS lo) FROM r), r3 AS (SELECT * REPLACE (CASE WHEN c THEN least(lo + 3, hi) ELSE lo END AS lo) FROM r2),
        r4 AS (SELECT * REPLACE (CASE WHEN s = 0 AND case_type = 'ortopedica' THEN least(hi, 15) WHEN s = 0 AND case_type = 'rc_auto' THEN least(hi, 9) ELSE hi END AS hi) FROM r3),
        p AS (SELECT *, CAST(floor((lo + hi) / 2.0 + 0.5) AS INTEGER) AS mid, 35 AS age FROM r4), m AS ({_milano_sql('mid', 'age')})
        SELECT p.case_id, case_type, CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high, CAST(mid AS BIGINT) AS middle,
            CASE WHEN mid <= 9 THEN floor({packs.POINT}::DOUBLE * list_extract({micro}::DOUBLE[], mid) * mid * 100 + 0.5) / 100 ELSE floor({packs.POINT}::DOUBLE * list_extract({macro}::DOUBLE[], mid - 9) * 0.856::DOUBLE * mid * 100 + 0.5) / 100 END AS amount,
            CASE WHEN mid >= 10 THEN m.amount END AS other_amount, s >= 2 AS concurrent FROM p JOIN m ON m.case_id = p.case_id"""


def missing_sql(v: str) -> str:
    text = "lower(title || ' ' || description)"
    has = lambda *words: " OR ".join(f"contains({text}, '{w}')" for w in words)
    rows = ", ".join("('{}', '{}', '{}')".format(k, d.replace("'", "''"), f) for k, x in packs.EXPECTED.items() for d, f in x)
    return f"""{with_views(v)}, f AS (SELECT case_id, case_type, bool_or(event_type = 'consenso' OR {has('consenso informato')}) AS consenso, bool_or({has('anestesi', 'asa score')}) AS anestesia,
        bool_or(event_type = 'intervento' OR {has('descrizione operatoria', 'verbale operatorio')}) AS operatoria, bool_or({has('dimissione')}) AS dimissione, bool_or(event_type = 'follow-up' OR {has('follow-up', 'controllo post')}) AS follow_up,
        bool_or({has('pre-operatori', 'preoperatori')}) OR coalesce(min(event_date) FILTER (WHERE event_type = 'esame') < max(event_date) FILTER (WHERE event_type = 'intervento'), FALSE) AS pre_operatori,
        bool_or({has('diario clinico', 'diario medico', 'diario infermieristico', 'cartella clinica')}) AS diario FROM {v} GROUP BY ALL)
        SELECT case_id, document FROM f JOIN (VALUES {rows}) x(case_type, document, flag) USING (case_type) WHERE NOT CASE flag {' '.join(f"WHEN '{k}' THEN {k}" for k in packs.FLAGS)} END"""


def completeness_sql(v: str) -> str:
    rows = ", ".join(f"('{k}', '{n}', [{', '.join(repr(w) for w in words)}])" for k, n, words in packs.REQUIREMENTS)
    return f"""{with_views(v)} SELECT case_id, requirement, bool_or(len(list_filter(words, lambda w: contains(lower(title || ' ' || description), w))) > 0) AS met
        FROM {v} JOIN (VALUES {rows}) r(case_type, requirement, words) USING (case_type) GROUP BY case_id, requirement"""


def gravest(spark, sf_dir):
    return rules.gravest(rules.anomalies(views.timeline_sparse(spark, sf_dir)), 3).drop("anomaly_type")


def swapped(spark, sf_dir):
    return timeline.neighbour_swap(views.timeline_sparse(spark, sf_dir), F.col("order_number") % 5 == 2)


def appended(spark, sf_dir):
    t = views.timeline_sparse(spark, sf_dir)
    return timeline.appended(t.where(F.col("event_id") % 3 != 0), t.where(F.col("event_id") % 3 == 0).drop("order_number")).select("case_id", "event_id", "order_number")


SPARSE, DENSE = views.timeline_sparse, views.timeline_dense
QUERIES = {
    "timeline_renumber": lambda spark, sf_dir: SPARSE(spark, sf_dir).select("case_id", "event_id", "event_date", "event_type", "order_number"),
    "first_last": _of(SPARSE, timeline.first_and_last),
    "inter_event": _of(DENSE, lambda t: timeline.intervals(t, "intervento")),
    "neighbour_swap": swapped,
    "append_numbering": appended,
    "gap_documentale": _of(SPARSE, rules.documentation_gaps),
    "ritardo_diagnostico": _of(SPARSE, rules.late_diagnosis),
    "gap_post_chirurgico": _of(SPARSE, rules.late_follow_up),
    "complicanza_non_gestita": _of(DENSE, rules.unmanaged_complication),
    "consenso_non_documentato": _of(SPARSE, rules.missing_consent),
    "diagnosi_contraddittoria": _of(DENSE, rules.contradictory_diagnoses),
    "terapia_senza_followup": _of(DENSE, rules.uncontrolled_therapy),
    "valore_clinico_critico": _of(SPARSE, rules.clinical_values),
    "sequenza_violata": _of(SPARSE, rules.sequence_violations),
    "timeline_anomalies": _of(SPARSE, rules.anomalies),
    "severity_topk": gravest,
    "missing_documents": _of(SPARSE, checklists.missing_documents),
    "completeness": _of(SPARSE, checklists.completeness),
    "completeness_rate": _of(SPARSE, checklists.completeness_rate),
    "stay_days": _of(SPARSE, periods.stays),
    "periods_all": _of(SPARSE, periods.all_periods),
    "damage_amount": damage,
    "milano": milano,
    "balthazard": balthazard,
    "gabrielli": gabrielli,
    "bpca": bpca,
    "damage_range": _of(SPARSE, quantify.damage_ranges),
}

_SPARSE, _DENSE = with_views("sparse"), with_views("dense")
_RANK = "CASE severity WHEN 'critica' THEN 0 WHEN 'alta' THEN 1 WHEN 'media' THEN 2 WHEN 'bassa' THEN 3 ELSE 4 END"
ORACLE_SQL = {
    "timeline_renumber": _SPARSE + "SELECT case_id, event_id, event_date, event_type, order_number FROM sparse",
    "first_last": _SPARSE + "SELECT case_id, count(*) AS events, arg_min(event_date, order_number) AS first_date, arg_max(event_date, order_number) AS last_date, abs(arg_max(event_date, order_number) - arg_min(event_date, order_number)) AS days FROM sparse GROUP BY case_id",
    "inter_event": _DENSE + "SELECT case_id, interval, event_date, next_date, next_date - event_date AS days FROM (SELECT case_id, event_date, row_number() OVER w AS interval, lead(event_date) OVER w AS next_date FROM dense WHERE event_type = 'intervento' WINDOW w AS (PARTITION BY case_id ORDER BY order_number)) WHERE next_date IS NOT NULL",
    "neighbour_swap": _SPARSE + "SELECT case_id, event_id, CASE WHEN order_number % 5 = 2 AND lead(order_number) OVER w IS NOT NULL THEN order_number + 1 WHEN order_number % 5 = 3 THEN order_number - 1 ELSE order_number END AS new_order FROM sparse WINDOW w AS (PARTITION BY case_id ORDER BY order_number)",
    "append_numbering": _SPARSE + ", old AS (SELECT case_id, max(order_number) AS m FROM sparse WHERE event_id % 3 <> 0 GROUP BY case_id) SELECT s.case_id, event_id, coalesce(m, 0) + row_number() OVER (PARTITION BY s.case_id ORDER BY event_date, type_rank, event_id) AS order_number FROM sparse s LEFT JOIN old USING (case_id) WHERE event_id % 3 = 0",
    "gap_documentale": _SPARSE + gaps_sql("sparse"),
    "ritardo_diagnostico": _SPARSE + diagnosis_sql("sparse"),
    "gap_post_chirurgico": _SPARSE + surgery_sql("sparse"),
    "complicanza_non_gestita": _DENSE + complication_sql("dense"),
    "consenso_non_documentato": _SPARSE + consent_sql("sparse"),
    "diagnosi_contraddittoria": with_views("dense") + ", " + ranked_sql("dense") + contradiction_sql("dense"),
    "terapia_senza_followup": _DENSE + therapy_sql("dense"),
    "valore_clinico_critico": _SPARSE + clinical_sql("sparse"),
    "sequenza_violata": _SPARSE + sequence_sql("sparse"),
    "timeline_anomalies": anomalies_sql("sparse"),
    "severity_topk": f"SELECT * FROM (SELECT case_id, severity, order_a, order_b, days, row_number() OVER (PARTITION BY case_id ORDER BY {_RANK}, order_a NULLS FIRST, anomaly_type, order_b NULLS FIRST, days NULLS FIRST) AS rank FROM ({anomalies_sql('sparse')})) WHERE rank <= 3",
    "missing_documents": missing_sql("sparse"),
    "completeness": completeness_sql("sparse"),
    "completeness_rate": f"SELECT case_id, CAST(floor(100.0 * count(*) FILTER (WHERE met) / count(*) + 0.5) AS BIGINT) AS percent FROM ({completeness_sql('sparse')}) GROUP BY case_id",
    "stay_days": _SPARSE + stays_sql("sparse"),
    "periods_all": periods_sql("sparse"),
    "damage_amount": f"SELECT *, {_amount_sql('percent', 'age')} AS amount FROM ({PEOPLE})",
    "milano": f"WITH p AS ({PEOPLE}) {_milano_sql('percent', 'age')}",
    "balthazard": with_views("case_documents") + "SELECT case_id, floor(list_reduce(list_sort(list((part % 40)::DOUBLE), 'DESC'), lambda t, p: t + p - t * p / 100) * 100 + 0.5) / 100 AS combined FROM case_documents GROUP BY case_id",
    "gabrielli": f"SELECT case_id, CASE WHEN age < 100 AND percent >= age THEN CASE WHEN age = 0 THEN percent::DOUBLE ELSE floor((percent - age) / (100 - age)::DOUBLE * 100 * 100 + 0.5) / 100 END END AS residual FROM ({PEOPLE})",
    "bpca": _bpca_sql(),
    "damage_range": _range_sql("sparse"),
}
