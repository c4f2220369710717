"""Registered queries of the rules: names, labels, scores and decisions over generated evidence, sources; with their SQL.

Evidence is generated from order keys, so that every rule is met on both sides of its threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.fixed import COLLISIONS, CONTRADICTIONS, IDENTIFIERS, NAME_NEGATIVES, NAME_TERMS, NATURAL, NER_LABELS, OPAQUE, SPARSE, THRESHOLD_ELSE, THRESHOLDS, V13, V16, ZERO_SHOT_LABELS
from quillon.functions.text import normalize_name
from quillon.operators.decide import decisions
from quillon.operators.providers import ner_entity
from quillon.operators.scoring import name_tables, profiles, secondary
from quillon.operators.zero_shot import canonical, combined, zero_shot_metrics
from quillon.sources.tables import policy_overlay, read_csv
from quillon.work import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple]) -> str:
    say = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"{v!r}" if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "values " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


def _list(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# --- Names -----------------------------------------------------------------------------------------------------------

_NAMES = (
    "email", "customerEmail", "EMAIL_ADDRESS", "phone-number", "ph.no", "order_id", "account number", "bank account no", "passportNumber", "driver license or passport", "dob", "date_of_birth",
    "city", "home address city", "customer_name", "company", "coupon_code", "app_version", "client ip", "serial number", "possible_ssn", "number phone mobile", "employeeId", "row_number", "nhs number",
)


def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, normalize_name(n)) for n in _NAMES], "name string, normalized string")


_NORMAL = "lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]+', ' ', 'g'), '\\s+', ' ', 'g')))"
_NORMALIZED_SQL = f"select name, {_NORMAL} as normalized from ({_values([(n,) for n in _NAMES])}) as t(name)"


def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names say without likeness of strings, which has no form in SQL."""
    by_entity, _ = name_tables(spark, _NAMES, V13)
    said = (F.col("semantic") > 0) | F.col("negative") | (F.col("contradiction") > 0) | (F.col("rival_gap") > 0)
    return by_entity.filter(said).select("column_name", "entity", "semantic", "negative", F.round("rival_gap", 9).alias("rival_gap"), F.round("contradiction", 9).alias("contradiction"))


_ALL_ENTITIES = sorted({*THRESHOLDS, *NAME_TERMS, "Date Time"})
_NAME_SCORES_SQL = f"""
    with n as ({_NORMALIZED_SQL}),
    terms(entity, term) as ({_values([(e, normalize_name(t)) for e, ts in NAME_TERMS.items() for t in ts])}),
    against(entity, term) as ({_values([(e, normalize_name(t)) for e, ts in NAME_NEGATIVES.items() for t in ts])}),
    entities(entity) as ({_values([(e,) for e in _ALL_ENTITIES])}),
    groups(g, entity) as ({_values([(i, e) for i, g in enumerate(COLLISIONS) for e in g])}),
    excludes(entity, other) as ({_values([(e, o) for e, others in CONTRADICTIONS.items() for o in others])}),
    fits as (select name, entity, case when normalized = term then 1.0 when contains(' ' || normalized || ' ', ' ' || term || ' ') then 0.9
        when list_has_all(string_split(normalized, ' '), string_split(term, ' ')) then 0.72 else 0.0 end
        * case when list_has_any(string_split(normalized, ' '), ['or', 'maybe', 'possible', 'mixed', 'alternate']) then 0.88 else 1.0 end as s from n, terms),
    scores as (select name, entity, round(max(s), 4)::double as semantic from fits group by all),
    every as (select n.name, n.normalized, e.entity, coalesce(s.semantic, 0.0)::double as semantic from n cross join entities e left join scores s on s.name = n.name and s.entity = e.entity),
    rivals as (select a.name, a.entity, max(b.semantic) as best from every a join groups g on g.entity = a.entity join groups h on h.g = g.g and h.entity <> a.entity join every b on b.name = a.name and b.entity = h.entity group by all),
    against_of as (select distinct n.name, a.entity from n, against a where contains(' ' || n.normalized || ' ', ' ' || a.term || ' ')),
    penalties as (select s.name, x.other as entity, max(0.3 * s.semantic) as p from scores s join excludes x on x.entity = s.entity where s.semantic >= 0.55 group by all)
    select e.name as column_name, e.entity, e.semantic, a.name is not null as negative, round(greatest(0.0, coalesce(r.best, 0.0) - e.semantic), 9)::double as rival_gap, round(coalesce(p.p, 0.0), 9)::double as contradiction
    from every e left join rivals r on r.name = e.name and r.entity = e.entity left join against_of a on a.name = e.name and a.entity = e.entity left join penalties p on p.name = e.name and p.entity = e.entity
    where e.semantic > 0 or a.name is not null or coalesce(p.p, 0.0) > 0 or coalesce(r.best, 0.0) > e.semantic"""


# --- Labels of models ------------------------------------------------------------------------------------------------

_NER_CASES = (*NER_LABELS, "SOME_NEW_LABEL", "crypto", "X_Y")
_ZERO_CASES = (*ZERO_SHOT_LABELS, " Person Name ", "e-mail", "new label", "IBAN", "o'clock x")


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ner = spark.createDataFrame([("ner", c, ner_entity(c)) for c in _NER_CASES], "model string, label string, entity string")
    zero = spark.createDataFrame([(c,) for c in _ZERO_CASES], "label string").select(F.lit("zero_shot").alias("model"), "label", canonical(F.col("label")).alias("entity"))
    return ner.unionByName(zero)


_TITLE = "array_to_string(list_transform(regexp_extract_all(lower(trim({0})), '[a-z]+|[^a-z]+'), lambda r: upper(r[1]) || r[2:]), '')"
_LABELS_SQL = f"""
    with known(model, label, entity) as ({_values([("ner", k, v) for k, v in NER_LABELS.items()] + [("zero_shot", k, v) for k, v in ZERO_SHOT_LABELS.items()])}),
    cases(model, label) as ({_values([("ner", c) for c in _NER_CASES] + [("zero_shot", c) for c in _ZERO_CASES])})
    select c.model, c.label, coalesce(k.entity, {_TITLE.format("replace(c.label, '_', ' ')")}) as entity
    from cases c left join known k on k.model = c.model and k.label = case when c.model = 'ner' then c.label else lower(trim(c.label)) end"""

# Predictions made from customer keys: two views, a few entities, some views failing.
_PREDICTED = """
    select 'col' || cast(k % 7 as {s}) as column_name, 'v' || cast(k as {s}) as value, case when v = 0 then 'value' else 'context' end as view,
        case (k * 13 + v * 5 + e) % 6 when 0 then 'Person Name' when 1 then 'User Identifier' when 2 then 'Employee Identifier' when 3 then 'Address' else null end as entity,
        ((k * 37 + v * 11 + e * 17) % 21) * 5e-2 as score, (k % 11 <> 0 or v = 0) as inference_ok
    from (select c_custkey as k from {customer}) c, {views}, {each}"""
_PREDICTED_SQL = _PREDICTED.format(s="varchar", customer="customer", views="(values (0), (1)) as a(v)", each="(values (0), (1), (2)) as b(e)")
_DISTINCT_SQL = f"select column_name, value, view, entity, case when entity is null then null else max(score) end as score, min(inference_ok) as inference_ok from ({_PREDICTED_SQL}) group by column_name, value, view, entity"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _PREDICTED.format(s="string", customer="{customer}", views="(values (0), (1)) as a(v)", each="(values (0), (1), (2)) as b(e)")
    rows = spark.sql(sql, customer=table(spark, sf_dir, "customer"))
    return rows.groupBy("column_name", "value", "view", "entity").agg(F.when(F.col("entity").isNotNull(), F.max("score")).alias("score"), F.min("inference_ok").alias("inference_ok"))


def zero_shot_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined(predicted(spark, sf_dir)).select("column_name", "value", "entity", F.round("score", 9).alias("score"))


_VIEWS_SQL = f"""
    with p as ({_DISTINCT_SQL}), s as (select column_name, value, entity, coalesce(max(score) filter (where view = 'value'), 0) as v, coalesce(max(score) filter (where view = 'context'), 0) as c from p where entity is not null group by all)
    select column_name, value, entity, round(case when v > 0 then least(1.0, 0.88 * v + 0.12 * least(c, 0.85)) else 0.12 * least(c, 0.85) end, 9) as score from s"""


def zero_shot_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir)
    samples = rows.select("column_name", "value").distinct().withColumn("entities", F.when(F.crc32("value") % 3 == 0, F.array(F.lit("Employee Identifier"))).otherwise(F.array(F.lit("Email Address"))))
    pairs = samples.select("column_name").distinct().select("column_name", F.explode(F.array(*map(F.lit, ("Employee Identifier", "Person Name", "Address")))).alias("entity"))
    out = zero_shot_metrics(pairs, samples, rows)
    return out.select("column_name", "entity", *[F.round(c, 9).alias(c) for c in ("g_value", "g_context", "g_consistency", "g_mean", "g_success")])


_FAMILY_SQL = "case when want = 'Employee Identifier' then entity in ('Employee Identifier', 'User Identifier') else entity = want end"
_CRC = "(select list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({0}, ''), lambda ch: ord(ch)::ubigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)))"
_CONFIRMATION_SQL = f"""
    with p as ({_DISTINCT_SQL}), values_ as (select distinct column_name, value, xor({_CRC.format("value")}, 4294967295::ubigint) % 3 = 0 as own from p),
    pairs as (select v.column_name, v.value, v.own, e.want from values_ v, (values ('Employee Identifier'), ('Person Name'), ('Address')) as e(want)),
    has as (select *, want = 'Employee Identifier' and own as has from pairs),
    kept as (select * from has h where h.has or not exists (select 1 from has x where x.column_name = h.column_name and x.want = h.want and x.has)),
    ok as (select column_name, value, min(inference_ok) as ok from p group by all),
    firsts as (select column_name, value, entity from (select *, row_number() over (partition by column_name, value order by score desc, entity) as r from p where view = 'value' and entity is not null) where r = 1),
    facts as (select k.column_name, k.value, k.want, o.ok,
        (select count(*) from p where p.column_name = k.column_name and p.value = k.value and view = 'value' and {_FAMILY_SQL.replace("want", "k.want")}) > 0 as hit,
        (select count(*) from p where p.column_name = k.column_name and p.value = k.value and view = 'context' and {_FAMILY_SQL.replace("want", "k.want")}) > 0 as seen,
        (select max(score) from p where p.column_name = k.column_name and p.value = k.value and view = 'value' and {_FAMILY_SQL.replace("want", "k.want")}) as best,
        f.entity as first from kept k join ok o using (column_name, value) left join firsts f using (column_name, value))
    select column_name, want as entity, round(count(*) filter (where ok and hit) / greatest(count(*) filter (where ok), 1), 9) as g_value, round(count(*) filter (where ok and seen) / greatest(count(*) filter (where ok), 1), 9) as g_context,
        round(coalesce(avg(case when first is not null and ok then ({_FAMILY_SQL.replace("entity in", "first in").replace("entity = want", "first = want")})::int end), 0.0), 9) as g_consistency,
        round(coalesce(avg(case when ok then best end), 0.0), 9) as g_mean, round(count(*) filter (where ok) / count(*), 9) as g_success
    from facts group by column_name, want"""


# --- Scores and decisions over generated evidence --------------------------------------------------------------------

_ENTITIES = (
    *NATURAL, "Date of Birth", "Aadhaar Number", "Credit Card Number", "IBAN", "PAN Number", "IFSC Code", "MAC Address", "Email Address", "IP Address", "Crypto Wallet Address",
    "Bank Account Number", "Passport Number", "Driver License Number", "Phone Number", "Social Security Number", "Voter ID", "UK NHS Number", *IDENTIFIERS,
)
_SHARES = (
    "semantic", "agreement", "specificity", "structure", "exact_support", "row_support", "row_unaddressed", "ner_raw", "regex_raw", "union_raw", "ner_weighted", "regex_weighted", "union_weighted",
    "g_value", "g_context", "g_consistency", "g_mean", "g_success", "rate", "rival_gap", "name_address", "name_passport", "name_license",
)
_PRIMES = (3, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97)


def _generated(quotient: str, list_of: Callable[[str], str], orders: str) -> str:
    """One candidate a column, from order keys: shares in steps of a twentieth, the validator's rate null where there is none."""
    share = lambda p: f"((k * {p} {quotient} 10 + k * {p % 7 + 1}) % 21) * 5e-2"
    columns = ", ".join(f"{share(p)} as {c}" for c, p in zip(_SHARES, _PRIMES))
    entity = list_of(f"(k * 101 {quotient} 13) % {len(_ENTITIES)} + 1")
    return f"""select k, entity, {", ".join(c for c in _SHARES if c not in ("rate", "rival_gap", "row_support"))}, case when k % 3 = 0 then row_support * 1e-1 else row_support end as row_support,
        case when k % 4 = 0 then rival_gap else 0e0 end as rival_gap, case when k % 5 = 0 then 1e-1 else 0e0 end as contradiction, k % 7 = 0 as negative, k % 6 = 0 as generic, k % 2 = 0 as coarse_place,
        case when not entity in ({_list(tuple(V16.validators))}) then null when k % 2 = 0 then 95e-2 + (k % 3) * 25e-3 else rate end as validator, (k * 7 {quotient} 5) % 12 as support_count, 10 + (k % 4) * 30 as distinct_values
        from (select k, {entity} as entity, {columns} from (select o_orderkey as k from {orders}) o) g"""


def _entity_spark(i: str) -> str:
    return f"element_at(array({_list(_ENTITIES)}), cast({i} as int))"


_GENERATED_SQL = _generated("//", lambda i: f"[{_list(_ENTITIES)}][{i}]", "orders")


def decisions_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_generated("div", _entity_spark, "{orders}"), orders=table(spark, sf_dir, "orders")).withColumn("column_name", F.col("k").cast("string"))
    key = ["column_name", "entity"]
    metrics = rows.select(*key, "support_count", "ner_raw", "regex_raw", "union_raw", "ner_weighted", "regex_weighted", "union_weighted", "agreement", "validator", "specificity", "structure", "exact_support", "row_support", "row_unaddressed")
    names = rows.select(*key, "semantic", "negative", "rival_gap", "contradiction")
    zero = rows.select(*key, "g_value", "g_context", "g_consistency", "g_mean", "g_success")
    columns = rows.select("column_name", "generic", "coarse_place", "name_address", "name_passport", "name_license", "distinct_values")
    scored = profiles(rows.select(*key), metrics, names, columns, zero)
    text = scored.select("column_name", F.lit("").alias("candidates"), F.lit("").alias("strongest"))
    decided = decisions(scored, text).select(F.col("Column_Name").alias("c"), "Policy_Action", "Final_Entity_Type", "Primary_Entity", "Detected_Entity_Set", "Runner_Up_Margin")
    facts = scored.select("column_name", "entity", F.round("score", 9).alias("score"), "threshold", F.col("hard_reject").isNotNull().alias("rejected"), "detected", "accepted", secondary().alias("second"))
    return facts.join(decided, F.col("column_name") == F.col("c")).drop("c").withColumnsRenamed({c: c.lower() for c in decided.columns})


def _step(name: str, before: str, **columns: str) -> str:
    """A CTE that replaces or adds columns; ``*`` keeps the rest."""
    kept = ", ".join(f"({v})::double as {c}" if c == "score" else f"{v} as {c}" for c, v in columns.items())
    return f"{name} as (select * exclude (score), {kept} from {before})" if "score" in columns else f"{name} as (select *, {kept} from {before})"


_THRESHOLD_SQL = "case entity " + " ".join(f"when '{e}' then {t}" for e, t in THRESHOLDS.items()) + f" else {THRESHOLD_ELSE} end"
_KIND_SQL = "case entity " + " ".join(f"when '{e}' then '{kind}'" for e, (kind, _) in V16.validators.items()) + " else 'NONE' end"
_CHECKED = "case when kind = 'CHECKSUM' then semantic >= 0.55 or g_value >= 0.5 or support_count >= 2 when entity in ('Email Address', 'MAC Address', 'IBAN', 'IFSC Code', 'Crypto Wallet Address') then g_value >= 0.5 or support_count >= 2 else semantic >= 0.55 or g_value >= 0.75 end"
_VAGUE, _WEAK = "semantic < 0.55 and g_value < 0.5", "semantic < 0.5 and g_value < 0.45 and agreement < 0.3"
#: The rules in order, as steps over a table ``g`` of candidates; the last is b5.
_RULES = ", ".join([
    _step("a1", "g", ge=f"case when entity in ({_list(NATURAL)}) then least(1.0, 0.9 * g_value + 0.1 * least(g_context, 0.7)) when entity in ({_list(OPAQUE)}) then least(0.22, 0.9 * g_value + 0.04 * least(g_context, 0.7)) else least(0.45, 0.88 * g_value + 0.07 * least(g_context, 0.7)) end",
          phone="entity = 'Phone Number' and support_count >= 1 and coalesce(validator >= 0.95, false) and specificity >= 0.7 and not negative and (semantic >= 0.55 or g_value >= 0.6 or agreement >= 0.5)"),
    _step("a2", "a1", score=f"""greatest(0.0, least(1.0, case
        when entity in ({_list(NATURAL)}) then 0.46 * p + 0.06 * u + 0.24 * semantic + 0.18 * ge + 0.06 * g_consistency
        when entity = 'Date of Birth' then 0.1 * p + 0.24 * r + 0.08 * u + 0.34 * semantic + 0.1 * ge + coalesce(0.14 * validator, 0)
        when entity in ('Aadhaar Number', 'Credit Card Number', 'IBAN') then 0.12 * p + 0.3 * r + 0.08 * u + 0.16 * semantic + 0.08 * agreement + 0.08 * ge + coalesce(0.24 * validator - 0.45 * (1 - validator), 0)
        when entity in ('PAN Number', 'IFSC Code', 'MAC Address', 'Email Address', 'IP Address', 'Crypto Wallet Address') then 0.16 * p + 0.3 * r + 0.08 * u + 0.18 * semantic + 0.08 * agreement + 0.08 * ge + coalesce(0.12 * validator - 0.24 * (1 - validator), 0)
        when entity in ('Bank Account Number', 'Passport Number', 'Driver License Number', 'Phone Number', 'Social Security Number', 'Voter ID') then 0.16 * p + 0.26 * r + 0.05 * u + 0.25 * semantic + 0.08 * agreement + 0.1 * ge + coalesce(0.1 * validator - 0.18 * (1 - validator), 0)
        when entity in ({_list(IDENTIFIERS)}) then 0.1 * p + 0.24 * r + 0.1 * u + 0.38 * semantic + 0.12 * ge
        else 0.22 * p + 0.22 * r + 0.1 * u + 0.24 * semantic + 0.08 * agreement + 0.14 * ge end - case when negative then 0.24 else 0 end))"""),
    _step("a3", "a2", score="score + 0.04 * least(1.0, row_support / 0.5) - contradiction - least(0.32, 0.3 * rival_gap * case when coalesce(validator >= 0.95, false) then 0.55 else 1 end) - case when kind = 'BASIC_STRUCTURE' and validator is not null then 0.05 * validator when kind = 'STRICT_FORMAT' and validator is not null and " + _VAGUE + " then 0.04 * validator else 0 end"),
    _step("a4", "a3", score="score * case when regex_raw > 0 and specificity < 0.5 and semantic < 0.55 and ge < 0.35 then 0.58 else 1 end * case when support_count = 1 and distinct_values >= 20 and semantic < 0.55 and ge < 0.45 and not phone then 0.62 else 1 end"),
    _step("a5", "a4", rejected=f"""coalesce(case entity when 'Aadhaar Number' then validator < 0.8 when 'PAN Number' then negative and {_VAGUE} or validator < 0.95 when 'Credit Card Number' then coalesce(validator < 0.85, true)
        when 'Date of Birth' then semantic < 0.55 or validator < 0.7 when 'Bank Account Number' then {_VAGUE} when 'Phone Number' then negative and {_VAGUE} when 'IP Address' then negative and {_VAGUE} or validator < 0.9 end, false)"""),
    _step("a6", "a5", score=f"""case when not rejected and entity = 'Aadhaar Number' and semantic < 0.55 and coalesce(validator, 0) < 0.95 then score * 0.65
        when not rejected and entity = 'Date of Birth' and semantic >= 0.7 and union_raw >= 0.2 and coalesce(validator, 0) >= 0.9 and row_support >= 0.2 then score + 0.06 * least(1.0, union_raw) * least(1.0, row_support)
        when entity = 'Passport Number' and name_license >= 0.7 and semantic < 0.7 then score * 0.42
        when entity = 'Passport Number' and semantic >= 0.7 and union_raw >= 0.4 and (exact_support >= 0.3 or structure >= 0.6) then score + 0.08 * least(1.0, union_raw) * greatest(exact_support, structure)
        when entity = 'Passport Number' and {_WEAK} then score * 0.52 when entity = 'Driver License Number' and name_passport >= 0.6 then score * 0.38 when entity = 'Driver License Number' and {_WEAK} then score * 0.52
        when not rejected and entity = 'Phone Number' and semantic < 0.5 and g_value < 0.35 and agreement < 0.25 then score * 0.68 else score end"""),
    _step("a7", "a6", score=f"case when not rejected and (phone or entity in ({_list(SPARSE)}) and row_support > 0 and row_support <= 0.1 and support_count >= 1 and coalesce(validator >= 0.95, false) and specificity >= 0.85 and not negative and {_CHECKED}) then greatest(score, threshold + 0.05) else score end"),
    _step("a8", "a7", score="case when not rejected and entity = 'Passport Number' and semantic >= 0.7 and union_raw >= 0.2 and (structure >= 0.6 or exact_support >= 0.2) then greatest(score, threshold) when not rejected and entity = 'Date of Birth' and semantic >= 0.7 and coalesce(validator, 0) >= 0.9 and union_raw >= 0.1 then greatest(score, threshold + 0.02) else score end"),
    _step("a9", "a8", score="score * case when generic and entity in ('Phone Number', 'Bank Account Number', 'Aadhaar Number', 'Credit Card Number', 'Date of Birth') then 0.5 else 1 end + case when entity = 'Address' and semantic >= 0.75 then 0.1 when entity = 'Location' and name_address >= 0.75 then -0.2 when entity = 'Organization' then case when semantic >= 0.7 then 0.1 else 0 end + case when ner_raw >= 0.5 and g_value >= 0.3 then 0.1 * least(1.0, ner_raw) else 0 end else 0 end"),
    _step("b1", "a9", positive=f"entity in ({_list(IDENTIFIERS)}) and (semantic >= 0.75 and regex_raw >= 0.2 and specificity >= 0.85 or regex_raw >= 0.5 and specificity >= 0.85 or semantic >= 0.8 and g_value >= 0.55)", excluded="entity = 'Location' and coarse_place or entity = 'Organization'"),
    _step("b2", "b1", score="greatest(0.0, least(1.0, case when positive and not rejected then greatest(score, threshold + 0.05) else score end))"),
    _step("b3", "b2", detected="not rejected and (score >= threshold or positive or entity = 'Organization' and ner_raw >= 0.5 and row_support >= 0.4 and (g_value >= 0.3 or semantic >= 0.7))"),
    _step("b4", "b3", accepted="detected and not excluded"),
    _step("b5", "b4", second="""not rejected and (accepted or coalesce(case when entity in ('Email Address', 'Credit Card Number', 'Aadhaar Number', 'IBAN', 'MAC Address') then support_count >= 2 and coalesce(validator, 0) >= 0.95 and specificity >= 0.85
        when entity = 'Phone Number' then support_count >= greatest(3, floor(distinct_values * 0.05)) and union_raw >= 0.05 and semantic >= 0.55 or support_count >= greatest(5, floor(distinct_values * 0.1)) and agreement >= 0.5 and coalesce(validator, 0) >= 0.9 and not negative
        when entity = 'Person Name' then support_count >= greatest(5, floor(distinct_values * 0.1)) and ner_raw >= 0.15 and row_support >= 0.1 and (semantic >= 0.55 or g_value >= 0.45) and not negative
        when entity in ('Address', 'Location') then support_count >= greatest(3, floor(distinct_values * 0.05)) and ner_raw >= 0.1 and (g_value >= 0.25 or semantic >= 0.7) end, false))"""),
])


def rules_sql(source: str, before: str = "") -> str:
    """CTEs from candidates (the select ``source``) to b5: score, rejected, detected, accepted, second."""
    first = f"g as (select *, 0e0 as score, {_THRESHOLD_SQL}::double as threshold, {_KIND_SQL} as kind, least(1.0, ner_weighted / 0.5) as p, least(1.0, regex_weighted / 0.5) as r, least(1.0, union_weighted / 0.5) as u from ({source}))"
    return f"with {before}{first}, {_RULES}"


_DECISIONS_SQL = (
    rules_sql(_GENERATED_SQL)
    + """ select cast(k as varchar) as column_name, entity, round(score, 9) as score, threshold, rejected, detected, accepted, second,
        case when accepted then 'PROTECT' when detected then 'DETECTED_EXCLUDED' else 'NONE' end as policy_action, case when accepted then entity end as final_entity_type, case when detected then entity end as primary_entity,
        case when second and (union_raw >= 0.05 or support_count >= 2) then entity end as detected_entity_set, 1e0 as runner_up_margin from b5"""
)


# --- Sources ---------------------------------------------------------------------------------------------------------


def csv_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back as the newer generation reads: strings as they are, missing cells empty, columns by name."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"\ny')).alias("note"), F.when(F.col("c_custkey") % 5 == 0, "NA").when(F.col("c_custkey") % 5 == 1, None).otherwise(F.col("c_mktsegment")).alias("segment"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("code"))
    path = new_folder(spark, "csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, columns=["c_custkey", "note", "segment", "code"])


_CSV_SQL = """select cast(c_custkey as varchar) as c_custkey, c_name || ', "x"' || chr(10) || 'y' as note, case when c_custkey % 5 <= 1 then '' else c_mktsegment end as segment, lpad(cast(c_custkey as varchar), 12, '0') as code from customer"""


def csv_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the older generation reads: an encoding, a delimiter, and missing words kept."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(";é ü")).alias("note"), F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_mktsegment")).alias("segment"))
    path = new_folder(spark, "csv")
    rows.write.option("header", True).option("escape", '"').option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return read_csv(spark, path, keep_missing=True, encoding="ISO-8859-1", delimiter=";")


_SEMICOLONS_SQL = "select cast(c_custkey as varchar) as c_custkey, c_name || ';é ü' as note, case when c_custkey % 5 = 0 then 'NA' else c_mktsegment end as segment from customer"


def policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = policy_overlay('{"identifier_policy": {"Customer Identifier": false, "User Identifier": false}, "treat_organization_as_pii": true}')
    rows = [*policy.identifiers.items(), ("Organization", policy.organizations), ("Location", policy.coarse_locations)]
    return spark.createDataFrame(rows, "entity string, counts boolean")


_POLICY_SQL = f"select * from ({_values([(e, e not in ('Customer Identifier', 'User Identifier')) for e in IDENTIFIERS] + [('Organization', True), ('Location', False)])}) as t(entity, counts)"

QUERIES = {f.__name__: f for f in (normalized_names, name_scores, model_labels, zero_shot_views, zero_shot_confirmation, decisions_generated, csv_customer, csv_semicolons, policy_rows)}
ORACLES = {
    "normalized_names": _NORMALIZED_SQL, "name_scores": _NAME_SCORES_SQL, "model_labels": _LABELS_SQL, "zero_shot_views": _VIEWS_SQL, "zero_shot_confirmation": _CONFIRMATION_SQL,
    "decisions_generated": _DECISIONS_SQL, "csv_customer": _CSV_SQL, "csv_semicolons": _SEMICOLONS_SQL, "policy_rows": _POLICY_SQL,
}
