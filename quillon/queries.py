"""Registered queries of the profiling engine over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.fixed import CELL_PREFIX, GRADE_WEIGHT, LONG_SIDE, LONG_VALUE, NULL_LIKE, PATTERNS, V13, V16
from quillon.functions.text import compact_alnum, digits_only, signature, tidy, truncated
from quillon.functions.validators import validator
from quillon.operators import masking, reports
from quillon.operators.cells import column_sizes, dictionary
from quillon.operators.metrics import candidate_text, entity_metrics
from quillon.operators.sampling import stratified_sample
from quillon.operators.scan import evidence_of, match_rows, match_spans, priority, regex_evidence, scan_table, spread
from quillon.plans.profile import profile_table, profile_tables
from quillon import queries_rules
from quillon.work import stash

#: Day for ages, so that results don't depend on when they are computed.
AS_OF = date(2025, 1, 1)
PASSWORD = "correct horse"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = dict(queries_rules.QUERIES)
ORACLES: dict[str, str] = dict(queries_rules.ORACLES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- Text, distinct values -------------------------------------------------------------------------------------------

_TIDY = "trim(regexp_replace(translate({0}, chr(160) || '‐‑‒–—', ' -----'), '[\\s\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
_NULLS = ", ".join(f"'{v}'" for v in NULL_LIKE)


def _unpivot(columns: dict[str, list[str]]) -> str:
    return " union all ".join(f"select '{c}' as column_name, {_TIDY.format(c)} as value from {t} where {c} is not null" for t, cs in columns.items() for c in cs)


@query(f"""with cells as ({_unpivot({"documents": ["text", "lang", "source"]})})
    select column_name, md5(value) as value_md5, count(*) as n_rows from cells where lower(value) not in ({_NULLS}) group by 1, 2""")
def dictionary_documents(spark, sf_dir):
    values = dictionary(table(spark, sf_dir, "documents"), ["text", "lang", "source"])
    return values.select("column_name", F.md5("value").alias("value_md5"), F.col("rows").alias("n_rows"))


@query(f"""with cells as ({_unpivot({"customer": ["c_name", "c_mktsegment"]})})
    select column_name, value, count(*) as n_rows from cells where lower(value) not in ({_NULLS}) group by 1, 2""")
def dictionary_customer(spark, sf_dir):
    return dictionary(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"]).select("column_name", "value", F.col("rows").alias("n_rows"))


@query(f"""with cells as ({_unpivot({"documents": ["text", "source"]})}), d as (select distinct column_name, value from cells where lower(value) not in ({_NULLS}))
    select column_name, count(*) as distinct_values, (select count(*) from cells c where c.column_name = d.column_name and lower(c.value) not in ({_NULLS})) as value_rows from d group by column_name""")
def column_sizes_documents(spark, sf_dir):
    return column_sizes(dictionary(table(spark, sf_dir, "documents"), ["text", "source"]))


_NULL_CASES = ("NA", " n/a ", "None", "NULL", "nil", "Unknown", "not  provided", "Not Available", "-", "--", "NaN", "<NA>", "", "x", "0", "nonsense", "–")


@query(
    "with v as (select unnest([" + ", ".join(f"'{c}'" for c in _NULL_CASES) + "]) as raw), t as (select n_nationkey, " + _TIDY.format("raw") + " as value from nation, v) "
    f"select value, count(*) as n_rows from t where lower(value) not in ({_NULLS}) group by value"
)
def null_like_filter(spark, sf_dir):
    cases = F.explode(F.array(*map(F.lit, _NULL_CASES)))
    return dictionary(table(spark, sf_dir, "nation").select(cases.alias("raw"))).select("value", F.col("rows").alias("n_rows"))


def _shape_sql(v: str) -> str:
    shape = f"regexp_replace(regexp_replace(regexp_replace({v}, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g')"
    runs = f"regexp_extract_all({shape}, '9{{3,}}|A{{3,}}|a{{3,}}|.')"
    return f"left(array_to_string(list_transform({runs}, lambda r: case when length(r) > 1 then r[1] || '{{' || length(r) || '}}' else r end), ''), 100)"


@query(f"select {_shape_sql('p_name')} as name_shape, {_shape_sql('p_type')} as type_shape, count(*) as n from part group by 1, 2")
def value_signatures(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(signature(F.col("p_name")).alias("name_shape"), signature(F.col("p_type")).alias("type_shape")).agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as digits, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') as alnum from customer")
def digits_and_alnum(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", digits_only(F.col("c_name")).alias("digits"), compact_alnum(F.col("c_name")).alias("alnum"))


@query(
    f"select doc_id, length(t) as n_chars, md5(case when length(t) > {LONG_VALUE} then left(t, {LONG_SIDE}) || chr(10) || '…[TRUNCATED]…' || chr(10) || right(t, {LONG_SIDE}) else t end) as kept_md5 "
    f"from (select doc_id, {_TIDY.format('text')} as t from documents)"
)
def long_values(spark, sf_dir):
    t = tidy(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(truncated(t, V16.cut_mark)).alias("kept_md5"))


# --- Patterns ------------------------------------------------------------------------------------------------------

# A value for each pattern and key: some match, some don't.
_TEMPLATES = (
    "'id ABCDE' || {d4} || 'F'", "'a ' || '2' || {d3} || ' ' || {d4} || '-' || {d4}", "'mail user' || {d4} || '@host' || {d3} || '.example'",
    "'s ' || {d3} || '-' || {d2} || '-' || {d4} || ' end'", "'n ' || {d9}", "'ip ' || {d3} || '.1.' || {d2} || '.255'", "'v6 1:2:3:4:5:6:' || {d4} || ':ff'",
    "'card 4' || {d3} || '-' || {d4} || ' ' || {d4} || {d4}", "'tel +4' || {d9}", "'tel 9' || {d9}", "'(' || {d3} || ') ' || {d3} || '-' || {d4}", "'p K1' || {d1} || ' ' || {d4} || '5'",
    "'p AB' || {d9}", "'KA' || {d2} || ' ' || {d9} || {d2}", "'d D' || {d4} || {d3}", "'v ABC' || {d4} || {d3}", "'i GB82WEST1' || {d9} || {d4}", "'f SBIN0' || {d4} || 'A1'",
    "'b ' || {d9} || {d9}", "'m 0a:1b:2c:3d:4e:' || {d2}", "'m 0a-1b-2c-3d-4e-' || {d2}", "'w 1BoatSLRHtKNngkdXEeobR' || {d3} || 'ABCDEF'", "'w 0x' || {d4} || repeat('ab', 18)",
    "'b 19' || {d2} || '-' || {d2} || '/' || {d2}", "'b ' || {d2} || '/' || {d2} || '/20' || {d2}", "'h ' || {d3} || ' ' || {d3} || '-' || {d4}", "'n AB' || {d4} || {d2} || 'C'",
    "'t 9' || {d2} || '-7' || {d1} || '-' || {d4}", "'EMP-' || {d4} || ', STAFF_' || {d2}", "'CUST' || {d4} || ' CLIENT-' || {d3}", "'USER_' || {d3}", "'CONTRACT/' || {d4} || '-X/' || {d2}",
    "'SN' || {d4} || {d1} || ' DEV ' || {d4} || {d2}", "'éa' || {d9} || 'é 12' || {d9} || ' _' || {d9}",
)
_MIXED = "(c_custkey * 48271 + 11) * 69621 % 1000000007"
_DIGITS = {f"d{n}": f"lpad(cast(({_MIXED}) // {k} % {10**n} as varchar), {n}, '0')" for n, k in ((1, 7), (2, 13), (3, 17), (4, 19), (9, 1))}
_GENERATED_SQL = " union all ".join(f"select c_custkey, {i} as template, {t.format(**_DIGITS)} as value from customer" for i, t in enumerate(_TEMPLATES))
_GENERATED_SPARK = " union all ".join(f"select c_custkey, {i} as template, {t.format(**{k: v.replace(' // ', ' div ').replace('varchar', 'string') for k, v in _DIGITS.items()})} as value from customer_rows" for i, t in enumerate(_TEMPLATES))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_GENERATED_SPARK.replace("customer_rows", "{rows}"), rows=table(spark, sf_dir, "customer"))


# Letters beyond ASCII become x, so that DuckDB's word edges, which know ASCII only, fall where they should.
_EDGES = "regexp_replace({0}, '[\\x{{aa}}\\x{{b5}}\\x{{ba}}\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{24f}}\\x{{370}}-\\x{{3ff}}\\x{{400}}-\\x{{4ff}}]', 'x', 'g')"


def _found_sql(name: str, value: str) -> str:
    """List of a pattern's matches; look-aheads become filters."""
    p = next(p for p in PATTERNS if p.name == name)
    if name.startswith("ssn"):
        digits = "\\b\\d{3}-\\d{2}-\\d{4}\\b" if name == "ssn_dashes" else "\\b\\d{9}\\b"
        bad = "^(000|666|9)|^...-00|0000$" if name == "ssn_dashes" else "^(000|666|9)"
        return f"list_filter(regexp_extract_all({value}, '{digits}'), lambda m: not regexp_matches(m, '{bad}'))"
    return f"regexp_extract_all({value}, '{p.regex}')"


def _counts_sql(source: str, value: str, keep: str) -> str:
    rows = " union all ".join(f"select {keep}, '{p.name}' as pattern, '{p.entity}' as entity, len({_found_sql(p.name, value)}) as n from {source}" for p in PATTERNS)
    return f"select * from ({rows}) where n > 0"


@query(f"with g as ({_GENERATED_SQL}), e as (select c_custkey, template, {_EDGES.format('value')} as v from g) select template, pattern, entity, cast(sum(n) as bigint) as n_matches, count(*) as n_values from ({_counts_sql('e', 'v', 'template')}) group by 1, 2, 3")
def pattern_matches_generated(spark, sf_dir):
    found = match_rows(generated(spark, sf_dir))
    by_value = found.groupBy("c_custkey", "template", "pattern", "entity").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("template", "pattern", "entity").agg(F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("n_values"))


def _text_counts_sql(source: str, key: str, column: str) -> str:
    return f"with e as (select {key}, {_EDGES.format(column)} as v from {source}) select pattern, entity, cast(sum(n) as bigint) as n_matches, count(*) as n_values from ({_counts_sql('e', 'v', key)}) group by 1, 2"


@query(_text_counts_sql("documents", "doc_id", "text"))
def pattern_matches_documents(spark, sf_dir):
    by_value = match_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text").groupBy("doc_id", "pattern", "entity").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("pattern", "entity").agg(F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("n_values"))


@query(_text_counts_sql("pages", "page_id", "html"))
def pattern_matches_pages(spark, sf_dir):
    by_value = match_rows(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "html").groupBy("page_id", "pattern", "entity").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("pattern", "entity").agg(F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("n_values"))


@query(f"""with g as ({_GENERATED_SQL}), s as (select c_custkey, template, value, unnest({_found_sql("email", "value")}) as span from g)
    select c_custkey, template, span, instr(value, span) - 1 as start, instr(value, span) - 1 + length(span) as "end" from s""")
def match_places_email(spark, sf_dir):
    return match_spans(generated(spark, sf_dir), patterns=("email",)).select("c_custkey", "template", "span", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# --- Validators ------------------------------------------------------------------------------------------------------

_PARTS = "select l_orderkey * 7919 + l_partkey * 31 + l_linenumber as k from lineitem"


def _validator_query(name: str, entity: str, value: str, valid_sql: str, valid_spark_value: str | None = None) -> None:
    """A query that counts verdicts over values made from lineitem keys, and its SQL."""
    spark_value = valid_spark_value or value.replace(" // ", " div ").replace("varchar", "string")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31 + F.col("l_linenumber")).alias("k"))
        values = keys.select(F.expr(spark_value).alias("v"))
        return values.groupBy(validator(entity, F.col("v"), AS_OF).alias("valid")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first_value"))

    run.__name__ = f"valid_{name}"
    query(f"with p as ({_PARTS}), t as (select {value} as v from p) select {valid_sql} as valid, count(*) as n, min(v) as first_value from t group by 1")(run)


def _pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as varchar), {n}, '0')"


_DIGIT_SUM = "list_sum(list_transform(range(1, length(v) + 1), lambda i: {0}))"
_luhn_digit = "cast(substr(v, length(v) + 1 - i, 1) as int)"
_double = f"(case when i % 2 = 0 then (case when {_luhn_digit} > 4 then 2 * {_luhn_digit} - 9 else 2 * {_luhn_digit} end) else {_luhn_digit} end)"
_validator_query("luhn", "Credit Card Number", "'4' || " + _pad("k * 104729 % 1000000000000000", 15), _DIGIT_SUM.format(_double) + " % 10 = 0")
_validator_query("nhs", "UK NHS Number", _pad("k * 104729 % 10000000000", 10), "(11 - list_sum(list_transform(range(1, 10), lambda i: cast(substr(v, i, 1) as int) * (11 - i))) % 11) % 11 = cast(substr(v, 10, 1) as int)")
_validator_query("iban", "IBAN", "'GB' || " + _pad("k % 100", 2) + " || 'WEST' || " + _pad("k * 104729 % 100000000000000", 14), "cast('32142829' || substr(v, 9, 14) || '1611' || substr(v, 3, 2) as hugeint) % 97 = 1")
# The multiplication table of the dihedral group of ten elements, row after row as SQL indexes it, and the step between places.
_MUL = "[" + ", ".join(str(d) for d in ([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 0, 6, 7, 8, 9, 5, 2, 3, 4, 0, 1, 7, 8, 9, 5, 6, 3, 4, 0, 1, 2, 8, 9, 5, 6, 7, 4, 0, 1, 2, 3, 9, 5, 6, 7, 8, 5, 9, 8, 7, 6, 0, 4, 3, 2, 1, 6, 5, 9, 8, 7, 1, 0, 4, 3, 2, 7, 6, 5, 9, 8, 2, 1, 0, 4, 3, 8, 7, 6, 5, 9, 3, 2, 1, 0, 4, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0])) + "]"
_STEP = "[1, 5, 7, 6, 2, 8, 3, 0, 9, 4]"


def _stepped(digit: str, times: int) -> str:
    for _ in range(times):
        digit = f"{_STEP}[{digit} + 1]"
    return digit


_check = "0"
for _i in range(12):
    _check = f"{_MUL}[{_check} * 10 + {_stepped(f'cast(substr(v, {12 - _i}, 1) as int)', _i % 8)} + 1]"
_validator_query("verhoeff", "Aadhaar Number", _pad("k * 104729 % 1000000000000", 12), f"v[1] >= '2' and {_check} = 0")
_validator_query("ssn", "Social Security Number", _pad("k * 104729 % 1000", 3) + " || '-' || " + _pad("k % 5", 2) + " || '-' || " + _pad("k % 7", 4), "not regexp_matches(v, '^(000|666|9)|-00-|-0000$')")
_validator_query("itin", "Tax Identification Number", _pad("900 + k % 100", 3) + " || '-' || " + _pad("k % 97", 2) + " || '-' || " + _pad("k % 9973", 4), "regexp_matches(v, '^9..-(7.|8[0-8])-')")
_validator_query("phone", "Phone Number", "case k % 3 when 0 then '+' when 1 then '' else '91' end || " + _pad("k * 104729 % 10000000000", 10), "case when v[1] = '+' then v[2] <> '0' when length(v) = 10 then v[1] <> '0' else v[3] >= '6' end")
_validator_query("ip", "IP Address", _pad("k % 300", 1).replace("lpad(cast(k % 300 as varchar), 1, '0')", "cast(k % 300 as varchar)") + " || '.' || cast(k % 257 as varchar) || '.' || " + _pad("k % 30", 2) + " || '.1'", "k1 <= 255 and k2 <= 255 and substr(split_part(v, '.', 3), 1, 1) <> '0'".replace("k1", "cast(split_part(v, '.', 1) as int)").replace("k2", "cast(split_part(v, '.', 2) as int)"))
_validator_query("pan", "PAN Number", "chr(cast(65 + k % 30 as int)) || 'bcde' || " + _pad("k % 10000", 4) + " || 'F'", "regexp_matches(upper(v), '^[A-Z]{5}[0-9]{4}[A-Z]$')")
_validator_query("ifsc", "IFSC Code", "'SBIN' || cast(k % 2 as varchar) || " + _pad("k % 1000000", 6), "v[5] = '0'")
_validator_query("mac", "MAC Address", "'0a:1b-2c:3d:' || " + _pad("k % 100", 2) + " || ':' || chr(cast(97 + k % 8 as int)) || '0'", "regexp_matches(v, ':[a-f]0$')")
_validator_query("email", "Email Address", "'user' || cast(k as varchar) || '@host.' || repeat('x', cast(k % 4 as int))", "regexp_matches(v, '[.]x{2,}$')")
_validator_query("national_insurance", "National Insurance Number", "chr(cast(65 + k % 26 as int)) || chr(cast(65 + k // 26 % 26 as int)) || ' ' || " + _pad("k % 1000000", 6) + " || chr(cast(65 + k % 5 as int))", "not regexp_matches(v, '^[DFIQUV]|^.[DFIQUV]|^(BG|GB|KN|NK|NT|TN|ZZ)|E$')")


@query(
    f"with d as (select strftime(o_orderdate, '%Y-%m-%d') as v, cast(o_orderdate as date) as t, o_orderkey as k from orders), c as (select cast(1800 + k % 300 as varchar) || substr(v, 5) as v from d) "
    f"select coalesce(try_strptime(v, '%Y-%m-%d') <= date '{AS_OF}' and date_diff('day', cast(try_strptime(v, '%Y-%m-%d') as date), date '{AS_OF}') / 365.2425 <= 120, false) as valid, count(*) as n, min(v) as first_value from c group by 1"
)
def valid_birth_date(spark, sf_dir):
    v = F.concat((1800 + F.col("o_orderkey") % 300).cast("string"), F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), 5, 6))
    return table(spark, sf_dir, "orders").select(v.alias("v")).groupBy(validator("Date of Birth", F.col("v"), AS_OF).alias("valid")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first_value"))


# --- Evidence, metrics, samples --------------------------------------------------------------------------------------

_WEIGHTS = ", ".join(f"('{p.name}', {round(p.reliability * 100)}, {round(GRADE_WEIGHT[p.grade] * 100)}, {p.score * p.reliability!r}, {str(p.grade != 'broad').lower()})" for p in PATTERNS)


def _evidence_sql(source: str, column: str) -> str:
    """CTEs: u (distinct scanned values with rows), c (pattern counts), e (value and entity)."""
    return f"""
        t as (select {_TIDY.format(column)} as value from {source} where {column} is not null),
        d as (select value, count(*) as value_rows from t where lower(value) not in ({_NULLS}) group by value),
        s as (select distinct case when length(value) > {LONG_VALUE} then left(value, {LONG_SIDE}) || chr(10) || '…[TRUNCATED]…' || chr(10) || right(value, {LONG_SIDE}) else value end as value,
              case when length(value) > {LONG_VALUE} then 0 else value_rows end as value_rows from d),
        x as (select value, value_rows, {_EDGES.format("value")} as v from s),
        c as ({_counts_sql("x", "v", "value, value_rows")}),
        w(pattern, reliability, grade_weight, strength, exact) as (values {_WEIGHTS}),
        e as (select value, value_rows, entity, max(reliability) as regex, sum(n * grade_weight) as weight, sum(n) as matches, bool_or(exact) as exact, max(strength) as strength from c join w using (pattern) group by 1, 2, 3),
        z as (select (select count(*) from d) as distinct_values, (select sum(value_rows) from d) as all_rows)"""


def _metrics_sql(source: str, column: str) -> str:
    return f"""with {_evidence_sql(source, column)}
        select entity, count(*) as support_count, count(*) / any_value(distinct_values) as regex_raw, sum(regex) / (any_value(distinct_values) * 100) as regex_weighted,
            sum(weight) / (sum(matches) * 100) as specificity, count(*) filter (where exact) / any_value(distinct_values) as exact_support, sum(value_rows) / any_value(all_rows) as row_support
        from e, z group by entity"""


def _metrics(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    scanned = stash(scan_table(dictionary(table(spark, sf_dir, name), [column]), AS_OF), "scanned")
    return entity_metrics(evidence_of(scanned), column_sizes(scanned)).select("entity", "support_count", "regex_raw", "regex_weighted", "specificity", "exact_support", "row_support")


@query(_metrics_sql("documents", "text"))
def entity_metrics_documents(spark, sf_dir):
    return _metrics(spark, sf_dir, "documents", "text")


@query(_metrics_sql("pages", "html"))
def entity_metrics_pages(spark, sf_dir):
    return _metrics(spark, sf_dir, "pages", "html")


@query(f"with {_evidence_sql('documents', 'text')} select md5(value) as value_md5, max(strength) as priority, count(*) as n_entities from e group by value")
def sample_priority_documents(spark, sf_dir):
    found = regex_evidence(dictionary(table(spark, sf_dir, "documents"), ["text"]), AS_OF)
    return found.select(F.md5("value").alias("value_md5"), priority().alias("priority"), F.size("entities").cast("long").alias("n_entities"))


@query(f"""with {_evidence_sql("documents", "text")}, m as (select entity, sum(regex) / (any_value(distinct_values) * 100) as r from e, z group by entity)
    select 'text' as column_name, string_agg(printf('%s:w=%.2f,p=0.00,r=%.2f,u=%.2f', entity, 0.4 * r + 0.2 * r, r, r), ' | ' order by -(0.4 * r + 0.2 * r), entity) as candidates from m""")
def candidate_distribution(spark, sf_dir):
    values = dictionary(table(spark, sf_dir, "documents"), ["text"])
    return candidate_text(entity_metrics(regex_evidence(values, AS_OF), column_sizes(values))).select("column_name", "candidates")


@query()
def stratified_samples(spark, sf_dir):
    found = regex_evidence(dictionary(table(spark, sf_dir, "documents"), ["text", "source"]), AS_OF)
    return stratified_sample(found).select("column_name", "place", F.md5("value").alias("value_md5"), "priority", "entities")


_LUHN_DIGIT = "cast(substr({d}, length({d}) + 1 - i, 1) as int)"
_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when i % 2 = 0 then (case when {x} > 4 then 2 * {x} - 9 else 2 * {x} end) else {x} end)) % 10 = 0"


def _passes_sql(entity: str) -> str:
    """Whether a match ``m`` passes its entity's validator, for the entities that occur in documents."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return {
        "Email Address": "true",
        "IP Address": f"regexp_full_match(m, '({octet}[.]){{3}}{octet}')",
        "Phone Number": f"case when m[1] = '+' then regexp_full_match(m, '[+][1-9][0-9]{{6,14}}') else regexp_full_match({digits}, '[1-9][0-9]{{9}}|91[6-9][0-9]{{9}}') end",
        "Credit Card Number": f"length({digits}) between 13 and 19 and not regexp_full_match({digits}, repeat({digits}[1], length({digits}))) and " + _LUHN.format(d=digits, x=_LUHN_DIGIT.format(d=digits)),
    }[entity]


_JUDGED = {"email": "Email Address", "ipv4": "IP Address", "phone_us": "Phone Number", "cc_groups": "Credit Card Number"}
_ZEROS = "semantic agreement structure row_unaddressed ner_raw ner_weighted g_value g_context g_consistency g_mean g_success rival_gap contradiction name_address name_passport name_license".split()
_TEXT_CANDIDATES = f"""
    select entity, support_count, regex_raw, regex_raw as union_raw, regex_weighted, regex_weighted as union_weighted, specificity, exact_support, row_support, distinct_values, validator,
        false as negative, false as generic, false as coarse_place, {", ".join(f"0e0 as {c}" for c in _ZEROS)} from measured"""
_TEXT_BEFORE = f"""{_evidence_sql("documents", "text").strip()},
    judged as ({" union all ".join(f"select value, '{entity}' as entity, len(list_filter({_found_sql(name, 'v')}, lambda m: {_passes_sql(entity)})) > 0 as passed from x where len({_found_sql(name, 'v')}) > 0" for name, entity in _JUDGED.items())}),
    rates as (select entity, count(*) filter (where passed) / count(*) as validator from judged group by entity),
    measured as (select e.entity, count(*) as support_count, any_value(z.distinct_values) as distinct_values, count(*) / any_value(z.distinct_values) as regex_raw, sum(e.regex) / (any_value(z.distinct_values) * 100) as regex_weighted,
        sum(e.weight) / (sum(e.matches) * 100) as specificity, count(*) filter (where e.exact) / any_value(z.distinct_values) as exact_support, sum(e.value_rows) / any_value(z.all_rows) as row_support, any_value(rates.validator) as validator
        from e cross join z left join rates on rates.entity = e.entity group by e.entity), """


_TEXT_CHOSEN = f"""{queries_rules.rules_sql(_TEXT_CANDIDATES, _TEXT_BEFORE)},
    ranked as (select *, row_number() over (order by score desc, entity) as place, row_number() over (order by case when accepted then 0 when detected then 1 else 2 end, score desc, entity) as turn from b5),
    chosen as (select * from ranked where turn = 1)"""


@query(f"""{_TEXT_CHOSEN},
    runner as (select * from ranked where entity <> (select entity from chosen) and (union_raw >= 0.03 or support_count >= 2) order by place limit 1)
    select 'text' as column_name, case when accepted then 'PROTECT' when detected then 'DETECTED_EXCLUDED' else 'NONE' end as policy_action, case when accepted or detected then entity end as primary_entity,
        (select string_agg(entity, ' | ' order by place) from ranked where accepted) as final_entity_type, (select string_agg(entity, ' | ' order by place) from ranked where second and (union_raw >= 0.05 or support_count >= 2)) as detected_entity_set,
        round(score, 4) as evidence_score, round(score - threshold, 4) as decision_margin, round(regex_raw, 4) as regex_support, round(regex_weighted, 4) as weighted_regex_support, round(validator, 4) as validator_pass_rate, kind as validator_type,
        (select entity from runner) as runner_up_entity, round((select score from runner), 4) as runner_up_score, round(coalesce(greatest(0.0, score - (select score from runner)), 1.0), 4) as runner_up_margin from chosen""")
def profile_text(spark, sf_dir):
    """The profile of documents' texts, but for reasons and times, which have no short form in SQL."""
    out = profile_table(table(spark, sf_dir, "documents"), ["text"], as_of=AS_OF)
    names = "Column_Name Policy_Action Primary_Entity Final_Entity_Type Detected_Entity_Set Evidence_Score Decision_Margin Regex_Support Weighted_Regex_Support Validator_Pass_Rate Validator_Type Runner_Up_Entity Runner_Up_Score Runner_Up_Margin"
    return out.select(*[F.col(c).alias(c.lower()) for c in names.split()])


# --- Profiles and reports ----------------------------------------------------------------------------------------------


@query()
def profile_documents(spark, sf_dir):
    return profile_table(table(spark, sf_dir, "documents"), ["text", "lang", "source"], as_of=AS_OF)


@query()
def profile_documents_v13(spark, sf_dir):
    return profile_table(table(spark, sf_dir, "documents"), ["text", "lang", "source"], profile=V13, as_of=AS_OF)


@query()
def profile_pages(spark, sf_dir):
    return profile_table(table(spark, sf_dir, "pages"), as_of=AS_OF)


@query()
def profile_customer_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_name", "c_mktsegment", "o_orderdate", "o_orderpriority", "o_orderkey")
    return profile_table(orders, as_of=AS_OF)


@query(f"""{_TEXT_CHOSEN},
    said as (select 'text' as column_name, case when accepted then 'PROTECT' when detected then 'DETECTED_EXCLUDED' else 'NONE' end as policy_action,
        case when accepted then (select string_agg(entity, ' | ' order by place) from ranked where accepted) when detected then entity else '{reports.NOTHING}' end as entity_type,
        case when accepted then (select string_agg(entity, ' | ' order by place) from ranked where accepted) else '{reports.NOTHING}' end as entity from chosen
        union all select 'source', 'NONE', '{reports.NOTHING}', '{reports.NOTHING}' where not exists (select * from ({_counts_sql("(select distinct source as v from documents) s", "v", "v")})))
    select column_name, policy_action, entity_type, entity, case policy_action when 'PROTECT' then '{reports.LABELS["PROTECT"]}' when 'NONE' then '{reports.LABELS["NONE"]}' else '{reports.LABELS["DETECTED_EXCLUDED"]}' end as pii_status,
        case policy_action when 'PROTECT' then 'PII' when 'NONE' then 'SAFE' else 'EXCLUDED' end as status from said""")
def summary_documents(spark, sf_dir):
    out = stash(profile_tables(table(spark, sf_dir, "documents"), ["text", "source"], as_of=AS_OF).results, "results")
    short = reports.short_summary(out).select(F.col("Column").alias("c"), F.col("Status").alias("status"), F.col("Entity").alias("entity"))
    long = reports.summary(out).select(F.col("Column_Name").alias("column_name"), F.col("Policy_Action").alias("policy_action"), F.col("Entity_Type").alias("entity_type"), F.col("PII_Status").alias("pii_status"))
    return long.join(short, F.col("column_name") == F.col("c")).drop("c")


# --- Masking ---------------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name, c_mktsegment from customer")
def mask_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return masking.unmask_table(masking.mask_table(rows, ["c_name", "c_mktsegment"], PASSWORD), PASSWORD)


@query(f"select c_custkey, '{CELL_PREFIX}' as prefix, cast(5 + 4 * ceil((28 + length(c_name)) / 3) as bigint) as n_chars from customer")
def mask_shape(spark, sf_dir):
    masked = masking.mask_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"], PASSWORD)
    cell = F.col("`c_name [MASKED]`")
    return masked.select("c_custkey", F.left(cell, F.lit(len(CELL_PREFIX))).alias("prefix"), F.length(cell).cast("long").alias("n_chars"))


@query("select c_custkey, left(c_name, 2) || repeat('●', greatest(6, length(c_name) - 2)) as shown from customer")
def mask_preview(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", masking.preview(F.col("c_name")).alias("shown"))


@query("select case when column_name in ('c_name', 'c_mktsegment') then column_name || ' [MASKED]' else column_name end as column_name, column_name in ('c_name', 'c_mktsegment') as masked from (describe customer)")
def masked_column_names(spark, sf_dir):
    masked = masking.mask_table(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], PASSWORD)
    known = set(masking.masked_columns(masked))
    return spark.createDataFrame([(c, c in known) for c in masked.columns], "column_name string, masked boolean")
