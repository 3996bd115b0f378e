"""The registered queries of the engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fiscal, ground, sql
from ..functions import text as T
from ..operators import catalog as C
from ..operators import infer
from . import derived
from .derived import CONFIG, views, with_derived
from .registry import ORACLE, QUERIES, query
from . import files, plans, trees  # noqa: F401  registers more

CATALOG = C.Catalog.of(CONFIG)
APRIL = fiscal.Calendar(4)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_accepted_by_fiscal_year"](spark, sf_dir)


# ---- text functions over whole documents

FOLD_SQL = "lower(coalesce(text, ''))"
for _k, _v in T.FOLDS.items():
    if len(_k) > 1:
        for _c in _v:
            FOLD_SQL = f"replace({FOLD_SQL}, '{_c}', '{_k}')"
_one = {c: k for k, v in T.FOLDS.items() if len(k) == 1 for c in v}
FOLD_SQL = f"translate({FOLD_SQL}, '{''.join(_one)}', '{''.join(_one.values())}')"
NORM_SQL = rf"trim(regexp_replace({FOLD_SQL}, '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORM_SQL}) AS norm, length({NORM_SQL}) AS n FROM documents")
def fn_normalize_for_match(spark, sf):
    norm = T.normalize_for_match(F.coalesce("text", F.lit("")))
    return read(spark, sf, "documents").select("doc_id", F.md5(norm).alias("norm"), F.length(norm).cast("long").alias("n"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) AS slug FROM documents")
def fn_slug(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.slug(F.col("text"))).alias("slug"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t\n_/\\]+', '-', 'g'), '-{2,}', '-', 'g'), '-')) AS word FROM documents")
def fn_word(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.word(F.col("text"))).alias("word"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_type, ' ', '-'), '-'), lambda p: upper(p[1:1]) || p[2:]), '-') AS title FROM part")
def fn_title_case(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.title_case(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("title"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name || '  ' || p_type), '[^\p{L}\p{Nd}]+', '_', 'g'), '_') AS field FROM part")
def fn_field_name(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.field_name(F.concat("p_name", F.lit("  "), "p_type")).alias("field"))


@query(r"""SELECT id, coalesce(list_filter(regexp_split_to_array(regexp_replace(name, '\.[^./]*$', ''), '[^A-Za-z0-9]+'), lambda w: lower(w) IN ('pw','pwd','passwd','password','passwords','passcode','passphrase','pin','pins','otp','secret','secrets'))[1], '-') AS token FROM d_files""")
def fn_password_token(spark, sf):
    return views(spark, sf, "d_files")["d_files"].select("id", F.coalesce(T.password_token(F.col("name")), F.lit("-")).alias("token"))


@query(r"SELECT id, regexp_replace(rel_path, '([^/]+)$', '.\1.meta.yaml') AS sidecar, rel_path AS back FROM d_files")
def fn_sidecar_path(spark, sf):
    path = T.sidecar_path(F.col("rel_path"))
    return views(spark, sf, "d_files")["d_files"].select("id", path.alias("sidecar"), F.when(T.is_sidecar(path), T.document_of(path)).alias("back"))


_NOISE = ", ".join(f"'{w}'" for w in T.NOISE)


@query(rf"""SELECT id, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(name, '\.[^./]*$', '')), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), ' '),
    lambda w: w <> '' AND w NOT IN ({_NOISE}, 'invoice', 'nora', 'field') AND NOT regexp_full_match(w, '[0-9]{{1,2}}|[0-9]{{4}}|[0-9]{{6}}|[0-9]{{8}}')), lambda w: upper(w[1:1]) || w[2:]), ' ') AS stem FROM d_files""")
def fn_clean_stem(spark, sf):
    return views(spark, sf, "d_files")["d_files"].select("id", T.clean_stem(T.stem(F.col("name")), F.lit("invoice"), F.array(F.lit("Nora Field"))).alias("stem"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), c AS (SELECT doc_id, t, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS a, length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) AS d, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS w FROM t)
    SELECT doc_id, (a + d) // 2 >= 120 AND a::DOUBLE / greatest(length(t), 1) >= 0.35 AND len(w) >= 20 AND len(list_filter(w, lambda x: length(x) >= 3))::DOUBLE / greatest(len(w), 1) >= 0.4 AS usable FROM c""")
def fn_usable_text_layer(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.usable_text_layer(F.col("text"), F.lit(2)).alias("usable"))


@query(r"""SELECT id, coalesce(try_cast(nullif(regexp_extract(text, '\b((?:19|20|21)[0-9]{2})\b', 1), '') AS INTEGER), -1) AS y FROM d_texts""")
def fn_year_in(spark, sf):
    return views(spark, sf, "d_texts")["d_texts"].select("id", F.coalesce(T.year_in(F.col("text")), F.lit(-1)).alias("y"))


@query("""WITH c AS (SELECT doc_id, text, list_max(list_filter(range(990, 1001), lambda n: strlen(text) > 1000 AND n <= strlen(text) AND try(decode(encode(text)[1:n])) IS NOT NULL)) AS n FROM documents) SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN strlen(text) ELSE n END AS n FROM c""")
def fn_clip(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.octet_length(T.clip(F.col("text"), 1000)).cast("long").alias("n"))


# ---- in SQL


@query(rf"SELECT doc_id, md5({NORM_SQL}) AS norm, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) AS slug, md5(trim(regexp_replace(regexp_replace(text, '[ \t\n_/\\]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-')) AS word FROM documents")
def sql_text_functions(spark, sf):
    sql.register(spark)
    return spark.sql("SELECT doc_id, md5(normalize_for_match(coalesce(text, ''))) AS norm, md5(slug(text)) AS slug, md5(name_word(text)) AS word FROM {documents}", documents=read(spark, sf, "documents"))


@query(r"""SELECT id, regexp_replace(rel_path, '([^/]+)$', '.\1.meta.yaml') AS sidecar, rel_path AS back, true AS is_one, regexp_replace(name, '\.[^./]*$', '') AS stem, regexp_extract(name, '(\.[^./]*)$', 1) AS ext, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS folder,
    coalesce(try_cast(nullif(regexp_extract(replace(name, '_', ' '), '\b((?:19|20|21)[0-9]{2})\b', 1), '') AS INTEGER), -1) AS y FROM d_files""")
def sql_path_functions(spark, sf):
    sql.register(spark)
    return spark.sql("""SELECT id, sidecar_path(rel_path) AS sidecar, document_of(sidecar_path(rel_path)) AS back, is_sidecar(sidecar_path(rel_path)) AND NOT is_sidecar(rel_path) AS is_one, file_stem(rel_path) AS stem, file_extension(file_name(rel_path)) AS ext, folder_name(rel_path) AS folder,
        coalesce(year_in(replace(name, '_', ' ')), -1) AS y FROM {files}""", files=views(spark, sf, "d_files")["d_files"])  # fmt: skip


@query("""WITH y AS (SELECT o_orderkey, year(date_trunc('month', o_orderdate) - INTERVAL 3 MONTH) AS y, (month(o_orderdate) - 4 + 12) % 12 // 3 + 1 AS q FROM orders)
    SELECT o_orderkey, y::INTEGER AS fy, q::INTEGER AS quarter, 'FY ' || lpad((y % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS label, 'fy' || lpad((y % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS tag,
        strftime(make_date(y, 4, 1), '%Y-%m-%d') AS first, strftime(make_date(y + 1, 4, 1), '%Y-%m-%d') AS after FROM y""")
def sql_fiscal_functions(spark, sf):
    sql.register(spark, APRIL)
    return spark.sql("""SELECT o_orderkey, fy_year(day) AS fy, fy_quarter(day) AS quarter, fy_label(day) AS label, fy_tag(day) AS tag, cast(fy_start(fy_year(day)) AS STRING) AS first, cast(fy_end(fy_year(day)) AS STRING) AS after
        FROM (SELECT o_orderkey, to_date(o_orderdate) AS day FROM {orders})""", orders=read(spark, sf, "orders"))  # fmt: skip


# ---- fiscal calendar


@query("""SELECT o_orderkey, year(o_orderdate - INTERVAL 3 MONTH)::INTEGER AS fy, ((month(o_orderdate) - 4 + 12) % 12 // 3 + 1)::INTEGER AS q FROM (SELECT o_orderkey, date_trunc('month', o_orderdate) AS o_orderdate FROM orders)""")
def fn_fiscal_year_and_quarter(spark, sf):
    day = F.to_date("o_orderdate")
    return read(spark, sf, "orders").select("o_orderkey", APRIL.year_of(day).alias("fy"), APRIL.quarter_of(day).alias("q"))


@query("""WITH y AS (SELECT o_orderkey, year(date_trunc('month', o_orderdate) - INTERVAL 3 MONTH) AS y, (month(o_orderdate) - 4 + 12) % 12 // 3 + 1 AS q FROM orders)
    SELECT o_orderkey, 'FY ' || lpad((y % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS label, 'fy' || lpad((y % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS tag,
        'FY ' || lpad((y % 100)::VARCHAR, 2, '0') || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') || ' Q' || q AS quarter, strftime(make_date(y, 4, 1), '%Y-%m-%d') AS first, strftime(make_date(y + 1, 4, 1), '%Y-%m-%d') AS after,
        strftime(make_date(y, 4, 1) + to_months(3 * (q - 1)::INTEGER), '%Y-%m-%d') AS q_first FROM y""")
def fn_fiscal_labels_and_ranges(spark, sf):
    day = F.to_date("o_orderdate")
    y, q = APRIL.year_of(day), APRIL.quarter_of(day)
    first, after = APRIL.range(y)
    return read(spark, sf, "orders").select("o_orderkey", APRIL.label(y).alias("label"), APRIL.tag(y).alias("tag"), APRIL.quarter_label(y, q).alias("quarter"), first.cast("string").alias("first"), after.cast("string").alias("after"), APRIL.quarter_range(y, q)[0].cast("string").alias("q_first"))


PERIODS = "CASE o_orderkey % 9 WHEN 0 THEN y WHEN 1 THEN y || '-' || m WHEN 2 THEN y || '-' || m || '-' || d WHEN 3 THEN 'FY' || y WHEN 4 THEN 'fy' || y || '-' || substr(cast(cast(y AS int) + 1 AS string), 3, 2) WHEN 5 THEN 'FY' || y || 'Q3' WHEN 6 THEN y || '-Q2' WHEN 7 THEN 'FY' || y || '-' || y ELSE 'soon' END"
PERIOD_ROWS = "SELECT o_orderkey, substr(cast(cast(o_orderdate AS date) AS string), 1, 4) AS y, substr(cast(cast(o_orderdate AS date) AS string), 6, 2) AS m, substr(cast(cast(o_orderdate AS date) AS string), 9, 2) AS d FROM orders"


@query(f"""WITH p AS (SELECT o_orderkey, o_orderkey % 9 AS k, y::INTEGER AS y, m::INTEGER AS m, d::INTEGER AS d FROM ({PERIOD_ROWS}))
    SELECT o_orderkey, coalesce(strftime(CASE k WHEN 0 THEN make_date(y, 1, 1) WHEN 1 THEN make_date(y, m, 1) WHEN 2 THEN make_date(y, m, d) WHEN 3 THEN make_date(y, 4, 1) WHEN 4 THEN CASE WHEN y % 100 <> 99 THEN make_date(y, 4, 1) END WHEN 5 THEN make_date(y, 10, 1) WHEN 6 THEN make_date(y, 7, 1) END, '%Y-%m-%d'), '-') AS first,
        coalesce(strftime(CASE k WHEN 0 THEN make_date(y + 1, 1, 1) WHEN 1 THEN make_date(y, m, 1) + INTERVAL 1 MONTH WHEN 2 THEN make_date(y, m, d) + INTERVAL 1 DAY WHEN 3 THEN make_date(y + 1, 4, 1) WHEN 4 THEN CASE WHEN y % 100 <> 99 THEN make_date(y + 1, 4, 1) END WHEN 5 THEN make_date(y + 1, 1, 1) WHEN 6 THEN make_date(y, 10, 1) END, '%Y-%m-%d'), '-') AS after FROM p""")
def fn_parse_period(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    first, after = APRIL.period(F.expr(PERIODS))
    return spark.sql(PERIOD_ROWS).select("o_orderkey", F.coalesce(first.cast("string"), F.lit("-")).alias("first"), F.coalesce(after.cast("string"), F.lit("-")).alias("after"))


# ---- the classifier

_types = ", ".join(f"('{t.name}', '{t.category}', '{k.lower().replace(chr(39), chr(39) * 2)}')" for t in CATALOG.types for k in t.keywords)
HITS_SQL = rf"""k(doctype, category, needle) AS (VALUES {_types}),
    h AS (SELECT t.id, k.doctype, count(*) AS keywords FROM d_texts t JOIN k ON contains(lower(t.text), k.needle) AND regexp_matches(lower(t.text), '\b' || regexp_escape(k.needle) || '\b') GROUP BY ALL),
    p AS (SELECT id, 'passport' AS doctype, 1 AS patterns FROM d_texts WHERE regexp_matches(text, 'P<[A-Z]{{3}}[A-Z<]{{5,}}')),
    s AS (SELECT id, doctype, coalesce(keywords, 0) AS keywords, coalesce(patterns, 0) AS patterns, coalesce(keywords, 0) + 3 * coalesce(patterns, 0) AS weight FROM h FULL JOIN p USING (id, doctype)),
    r AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(weight) OVER w, 0) AS runner_up FROM s WINDOW w AS (PARTITION BY id ORDER BY weight DESC, doctype)),
    c AS (SELECT id, doctype, weight, runner_up, least(0.95::DOUBLE, weight::DOUBLE / (weight::DOUBLE + 3.0::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * ((weight::DOUBLE - runner_up::DOUBLE) / weight::DOUBLE))) AS confidence FROM r WHERE rank = 1 AND (patterns > 0 OR keywords >= 2))"""


@query(f"WITH {HITS_SQL} SELECT id, doctype, keywords, patterns, weight FROM s")
def classify_scores(spark, sf):
    return C.scores(views(spark, sf, "d_texts")["d_texts"], CATALOG).select("id", "doctype", "keywords", "patterns", "weight")


@query(f"""WITH {HITS_SQL} SELECT t.id, coalesce(c.doctype, 'unclassified') AS doctype, coalesce((SELECT any_value(category) FROM k WHERE k.doctype = c.doctype), '-') AS category, coalesce(c.confidence, 0.0::DOUBLE) AS confidence, coalesce(c.confidence >= 0.5, false) AS accepted, coalesce(c.weight, 0) AS weight, coalesce(c.runner_up, 0) AS runner_up FROM d_texts t LEFT JOIN c USING (id)""")
def classify_top(spark, sf):
    return C.classify(views(spark, sf, "d_texts")["d_texts"], CATALOG).withColumn("category", F.coalesce("category", F.lit("-")))


@query("""WITH t AS (SELECT o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey) SELECT year(o_orderdate)::INTEGER AS fiscal_year, 'invoice' AS doctype, count(*) AS n FROM t GROUP BY 1""")
def flagship_accepted_by_fiscal_year(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    read(spark, sf, "customer").createOrReplaceTempView("customer")
    texts = spark.sql(derived.SQL["d_texts"].replace("CASE o_orderkey % 5", "CASE 0"))
    found = C.classified(texts, CATALOG).where("accepted")
    found, fields = T.once(found, fields=C.extract_fields(CATALOG, F.col("doctype"), F.col("text"))), F.col("fields")
    return found.select("doctype", CONFIG.calendar.year_of(F.make_date(infer.year(fields, F.lit(None).cast("timestamp"))["value"], F.lit(1), F.lit(1))).alias("fiscal_year")).groupBy("fiscal_year", "doctype").agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (SELECT doc_id, (regexp_matches(t, '\bmit license\b'))::INTEGER + (regexp_matches(t, '\bapache license\b'))::INTEGER + (regexp_matches(t, '\bcreative commons\b'))::INTEGER + (regexp_matches(t, '\bpublic domain\b'))::INTEGER AS n FROM l) SELECT doc_id, n FROM h WHERE n > 0""")
def classify_configured_types(spark, sf):
    own = C.Catalog(derived.LICENCES)
    return C.scores(read(spark, sf, "documents"), own, "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("weight").cast("int").alias("n"))


@query(r"""SELECT id, f.k AS field, f.v AS value FROM (SELECT id, unnest([
        {'k': 'invoice_number', 'v': CASE WHEN id % 5 = 0 THEN regexp_extract(text, '(?i)invoice\s*(?:number|no\.?|#)[:\s]{0,4}([A-Z0-9][A-Z0-9\-/]{2,30})', 1) END},
        {'k': 'amount', 'v': CASE WHEN id % 5 < 2 THEN regexp_extract(text, '(?i)(?:total|amount\s+due|grand\s+total|balance\s+due|net\s+payable|amount\s+payable)[^\d\-]{0,20}([0-9][0-9,]*(?:\.[0-9]{1,2})?)', 1) END},
        {'k': 'date', 'v': CASE WHEN id % 5 < 2 THEN regexp_extract(text, '(?i)(?:date(?:d)?|issued(?:\s+on)?|invoice\s+date)[:\s]{1,4}([0-9]{1,4}[-/. ][0-9]{1,2}[-/. ][0-9]{2,4}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4})', 1) END},
        {'k': 'receipt_number', 'v': CASE WHEN id % 5 = 1 THEN regexp_extract(text, '(?i)receipt\s*(?:number|no\.?|#)[:\s]{0,4}([A-Z0-9][A-Z0-9\-/]{2,30})', 1) END},
        {'k': 'account_number', 'v': CASE WHEN id % 5 = 2 THEN regexp_extract(text, '(?i)account\s*(?:number|no\.?|#)[:\s]{0,4}([A-Z0-9X\*]{4,30})', 1) END},
        {'k': 'closing_balance', 'v': CASE WHEN id % 5 = 2 THEN regexp_extract(text, '(?i)closing\s+balance[^\d\-]{0,20}([0-9][0-9,]*(?:\.[0-9]{1,2})?)', 1) END},
        {'k': 'passport_number', 'v': CASE WHEN id % 5 = 3 THEN regexp_extract(text, '(?i)passport\s*(?:number|no\.?)[:\s]{0,4}([A-Z0-9]{6,12})', 1) END},
        {'k': 'expiry', 'v': CASE WHEN id % 5 = 3 THEN regexp_extract(text, '(?i)date\s+of\s+expiry[:\s]{1,4}([0-9]{1,2}[ /.\-][A-Za-z0-9]{2,9}[ /.\-][0-9]{2,4})', 1) END},
        {'k': 'nationality', 'v': CASE WHEN id % 5 = 3 THEN regexp_extract(text, '(?i)nationality[:\s]{1,4}([A-Z][A-Za-z ]{3,30})', 1) END}
    ]) AS f FROM d_texts) WHERE f.v <> ''""")
def extract_fields(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("invoice", "receipt", "statement", "passport", "correspondence"))), (F.col("id") % 5 + 1).cast("int"))
    fields = C.extract_fields(CATALOG, kind, F.col("text"))
    return views(spark, sf, "d_texts")["d_texts"].select("id", F.explode(fields).alias("field", "value"))


# ---- grounding


@query(r"""SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda s: CASE WHEN contains(s, '.') THEN regexp_replace(replace(s, ',', ''), '\.?0*$', '') ELSE replace(s, ',', '') END))), '|') AS numbers FROM d_texts""")
def ground_numbers(spark, sf):
    return views(spark, sf, "d_texts")["d_texts"].select("id", F.array_join(F.array_sort(ground.numbers(F.col("text"))), "|").alias("numbers"))


@query(r"""WITH m AS (SELECT id, unnest(regexp_extract_all(text, '\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}')) AS s FROM d_texts), p AS (SELECT id, regexp_extract(s, '^(\d+)', 1) AS a0, regexp_extract(s, '^(\d+)', 1)::INTEGER AS a, regexp_extract(s, '^\d+[-/.](\d+)', 1)::INTEGER AS b, regexp_extract(s, '(\d+)$', 1)::INTEGER AS c FROM m),
    d AS (SELECT id, a AS y, b AS m, c AS d FROM p WHERE length(a0) = 4 UNION SELECT id, CASE WHEN c < 100 THEN c + 2000 ELSE c END, b, a FROM p WHERE length(a0) < 4 UNION SELECT id, CASE WHEN c < 100 THEN c + 2000 ELSE c END, a, b FROM p WHERE length(a0) < 4)
    SELECT DISTINCT id, y * 10000 + m * 100 + d AS day FROM d WHERE y BETWEEN 1000 AND 9999 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31""")
def ground_dates(spark, sf):
    return views(spark, sf, "d_texts")["d_texts"].select("id", F.explode(ground.dates(F.col("text"))).alias("day"))


VALUES = "CASE id % 7 WHEN 0 THEN cast(id AS string) WHEN 1 THEN 'paid in full' WHEN 2 THEN 'opening balance, statement' WHEN 3 THEN 'P EXPVANE iris' WHEN 4 THEN 'nothing here' WHEN 5 THEN '' ELSE 'notes about' END"


@query(rf"""WITH v AS (SELECT id, text, {VALUES} AS value FROM d_texts), w AS (SELECT id, text, value, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')) || ' ' AS t, ' ' || trim(regexp_replace(lower(value), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')) || ' ' AS o FROM v)
    SELECT id, value <> '' AND (length(o) > 2 AND contains(t, o) OR (id % 7 = 0 AND list_contains(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda s: CASE WHEN contains(s, '.') THEN regexp_replace(replace(s, ',', ''), '\.?0*$', '') ELSE replace(s, ',', '') END), value))) AS grounded FROM w""")
def ground_values(spark, sf):
    t = views(spark, sf, "d_texts")["d_texts"].withColumn("value", F.expr(VALUES))
    return t.select("id", ground.grounded(F.col("text"), F.col("value")).alias("grounded"))


# ---- inference


@query(r"""WITH n AS (SELECT id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')) || ' ' AS t FROM d_texts), p(name, full_name, given, pos) AS (VALUES ('Nora Field', ' nora field ', ' nora ', 1), ('Omar Field', ' omar field ', ' omar ', 2), ('Iris Vane', ' iris vane ', ' iris ', 3))
    SELECT id, name AS owner, CASE WHEN contains(t, full_name) THEN 'document-text' ELSE 'given-name' END AS source FROM n, p WHERE contains(t, full_name) OR contains(t, given)""")
def infer_owners(spark, sf):
    t = views(spark, sf, "d_texts")["d_texts"].select("id", F.explode(infer.owners(CONFIG, F.lit("scan.pdf"), F.col("text"))).alias("o"))
    return t.select("id", F.col("o.value").alias("owner"), F.col("o.source").alias("source"))


@query(r"""SELECT id, CASE WHEN id % 5 < 2 THEN year(day)::INTEGER ELSE 2020 END AS y, CASE WHEN id % 5 < 2 THEN 'extracted-field' ELSE 'mtime' END AS source FROM d_texts""")
def infer_year(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("invoice", "receipt", "statement", "passport", "correspondence"))), (F.col("id") % 5 + 1).cast("int"))
    t = T.once(views(spark, sf, "d_texts")["d_texts"], fields=C.extract_fields(CATALOG, kind, F.col("text"))).select("id", infer.year(F.col("fields"), F.lit("2020-05-05").cast("date")).alias("r"))
    return t.select("id", F.col("r.value").alias("y"), F.col("r.source").alias("source"))


@query(r"""SELECT id, CASE id % 5 WHEN 0 THEN 'INV-' || id WHEN 1 THEN 'RCT-' || id WHEN 2 THEN 'ACC' || cust || '77' WHEN 3 THEN 'X' || (1000000 + id) ELSE 'Lease' END AS identifier, CASE WHEN id % 5 < 4 THEN 'extracted-field' ELSE 'filename' END AS source FROM d_texts""")
def infer_identifier(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("invoice", "receipt", "statement", "passport", "correspondence"))), (F.col("id") % 5 + 1).cast("int"))
    t = T.once(views(spark, sf, "d_texts")["d_texts"], kind=kind, fields=C.extract_fields(CATALOG, kind, F.col("text")))
    t = t.select("id", infer.identifier(F.col("fields"), F.lit("scan 2024 lease.pdf"), F.col("kind"), F.array().cast("array<string>")).alias("r"))
    return t.select("id", F.col("r.value").alias("identifier"), F.col("r.source").alias("source"))


__all__ = ["ORACLE", "QUERIES", "entry", "with_derived"]
