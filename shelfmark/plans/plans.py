"""Queries over plans: proposals, moves and what came of them; and recognised text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chain, model, ocr
from ..functions import tags as G
from ..operators import catalog as C
from ..operators import filing, infer, plan, repair
from .derived import CONFIG, views
from .registry import query

CATALOG = C.Catalog.of(CONFIG)

PROPOSED = """p AS (SELECT id, 'inbox/scan ' || id || '.pdf' AS path, day, text, id % 5 AS k FROM d_texts), q AS (SELECT *, CASE k WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'statement' WHEN 3 THEN 'passport' ELSE 'unclassified' END AS doctype,
    CASE k WHEN 1 THEN ['Nora Field'] WHEN 3 THEN CASE WHEN contains(text, 'IRIS') THEN ['Iris Vane'] END WHEN 4 THEN ['Omar Field'] END AS owners, CASE WHEN k < 2 THEN year(day) ELSE 2020 END AS year,
    CASE k WHEN 0 THEN 'INV-' || id WHEN 1 THEN 'RCT-' || id WHEN 2 THEN regexp_extract(text, 'ACC[0-9]+') WHEN 3 THEN 'X' || (1000000 + id) END AS identifier FROM p)"""


PROPOSALS = f"""WITH {PROPOSED} SELECT path, doctype, year::INTEGER AS year, coalesce(array_to_string(owners, '|'), '') AS owners,
    CASE k WHEN 0 THEN 'Financial/_Shared/FY ' || year || '/Invoice_Shared_' || identifier || '_' || year || '.pdf' WHEN 1 THEN 'Financial/Nora-Field/FY ' || year || '/Receipt_Nora-Field_' || identifier || '_' || year || '.pdf'
    WHEN 2 THEN 'Financial/_Shared/FY 2020/Statement_Shared_' || identifier || '_2020.pdf' WHEN 3 THEN 'Identity/Iris-Vane/Passport_Iris-Vane_' || identifier || '_2020.pdf' ELSE '-' END AS destination,
    k >= 2 OR k = 3 AS guessed FROM q"""


def shown(found):
    return found.select("path", "doctype", "year", F.array_join("owners", "|").alias("owners"), F.coalesce("destination", F.lit("-")).alias("destination"), "guessed")


def new_files(spark, sf):
    path = F.concat(F.lit("inbox/scan "), F.col("id").cast("string"), F.lit(".pdf"))
    return views(spark, sf, "d_texts")["d_texts"].select(path.alias("path"), "text", F.lit("2020-05-05").cast("timestamp").alias("modified"))


@query(PROPOSALS)
def plan_proposals(spark, sf):
    return shown(plan.proposals(new_files(spark, sf), CONFIG, CATALOG))


@query(PROPOSALS)
def plan_proposals_over_clashing_columns(spark, sf):
    """Files that come with columns of the names of results and of those used on the way."""
    files = new_files(spark, sf).withColumns({c: F.lit("other") for c in ("doctype", "category", "Confidence", "accepted", "owners", "year", "found", "said", "low", "ranked", "sure", "tags")})
    return shown(plan.proposals(files, CONFIG, CATALOG))


@query("""SELECT id, CASE id % 3 WHEN 0 THEN 'active|fy' || y || '|nora-field' WHEN 1 THEN 'acme-corp|active|fy' || y ELSE 'active|fy' || y || '|iris-vane|omar-field' END AS tags FROM (SELECT id, year(day) AS y FROM d_texts)""")
def plan_tags(spark, sf):
    owners = F.element_at(F.array(F.array(F.lit("Nora Field")), F.array().cast("array<string>"), F.array(F.lit("Omar Field"), F.lit("Iris Vane"))), (F.col("id") % 3 + 1).cast("int"))
    tags = G.proposed(CONFIG, owners, F.year("day"), F.when(F.col("id") % 3 == 1, "Acme Corp").otherwise("nobody knows"))
    return views(spark, sf, "d_texts")["d_texts"].select("id", F.array_join(tags, "|").alias("tags"))


@query("""WITH m AS (SELECT lpad(id::VARCHAR, 9, '0') AS source, 'out/' || (id % 400) || '.txt' AS destination, (id % 1600)::VARCHAR AS sha FROM d_files), t AS (SELECT 'out/' || k || '.txt' AS destination, k::VARCHAR AS there FROM range(0, 100) r(k)),
    a AS (SELECT m.*, there, row_number() OVER (PARTITION BY m.destination, sha ORDER BY source) > 1 OR coalesce(there = sha, false) AS skip FROM m LEFT JOIN t USING (destination)),
    b AS (SELECT *, row_number() OVER (PARTITION BY destination, skip ORDER BY source) + (there IS NOT NULL)::INTEGER AS k FROM a)
    SELECT source, CASE WHEN skip OR k <= 1 THEN destination ELSE replace(destination, '.txt', '_' || (k + CASE WHEN split_part(split_part(destination, '/', 2), '.', 1)::INTEGER = 7 THEN 1 ELSE 0 END) || '.txt') END AS destination, CASE WHEN skip THEN 'skip' ELSE 'move' END AS action FROM b""")
def plan_moves(spark, sf):
    d = views(spark, sf, "d_files")["d_files"]
    moves = d.select(F.lpad(F.col("id").cast("string"), 9, "0").alias("source"), F.concat(F.lit("out/"), (F.col("id") % 400).cast("string"), F.lit(".txt")).alias("destination"), (F.col("id") % 1600).cast("string").alias("sha256"))
    taken = spark.range(100).select(F.concat(F.lit("out/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.col("id").cast("string").alias("sha256"))
    taken = taken.unionAll(spark.createDataFrame([("out/7_2.txt", "other")], "path string, sha256 string"))
    return plan.planned(moves, taken)


@query("""WITH m AS (SELECT lpad(id::VARCHAR, 9, '0') AS source, 'out/' || (id % 4000) || CASE WHEN id % 3 = 0 THEN '_2' ELSE '' END || '.txt' AS destination, id % 3 = 0 AS two FROM d_files),
    a AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY source) AS k, replace(destination, '.txt', '_2.txt') IN (SELECT destination FROM m) AS met FROM m),
    b AS (SELECT *, CASE WHEN k > 1 AND met THEN k + 1 ELSE k END AS n FROM a)
    SELECT source, CASE WHEN n = 1 THEN destination ELSE replace(destination, '.txt', '_' || (CASE WHEN NOT two AND destination = 'out/5.txt' AND n >= 3 THEN n + 1 ELSE n END) || '.txt') END AS destination, 'move' AS action FROM b""")
def plan_moves_onto_suffixes(spark, sf):
    """Destinations that equal names made by a suffix: every one of them is different."""
    d = views(spark, sf, "d_files")["d_files"]
    name = F.concat(F.lit("out/"), (F.col("id") % 4000).cast("string"), F.when(F.col("id") % 3 == 0, "_2").otherwise(""), F.lit(".txt"))
    moves = d.select(F.lpad(F.col("id").cast("string"), 9, "0").alias("source"), name.alias("destination"), F.col("id").cast("string").alias("sha256"))
    return plan.planned(moves, spark.createDataFrame([("out/5_3.txt", "other")], "path string, sha256 string"))


@query("SELECT rel_path AS path, row_number() OVER (ORDER BY rel_path) AS index FROM (SELECT DISTINCT rel_path FROM d_files)")
def plan_numbers(spark, sf):
    rows = views(spark, sf, "d_files")["d_files"].select(F.col("rel_path").alias("path")).distinct()
    return plan.numbered(rows).select("path", "index")


@query("SELECT 'now/' || id AS current_path, rel_path AS original_path FROM d_files WHERE id % 3 <> 0")
def plan_unreversed(spark, sf):
    d = views(spark, sf, "d_files")["d_files"].select(F.concat(F.lit("now/"), F.col("id").cast("string")).alias("current_path"), F.col("rel_path").alias("original_path"), "id")
    return plan.unreversed(d, d.where("id % 3 = 0")).select("current_path", "original_path")


@query("SELECT id AS line, name FROM d_files ORDER BY id DESC LIMIT 25")
def plan_audit_tail(spark, sf):
    return plan.tail(views(spark, sf, "d_files")["d_files"].select(F.col("id").alias("line"), "name"), 25)


_names = ", ".join(f"('{n}')" for n in CATALOG.names)


@query(f"""WITH w AS (SELECT DISTINCT replace(lower(p_type), ' ', '-') AS word FROM part), n(name) AS (VALUES {_names}), s AS (SELECT word, name, CASE WHEN word = name THEN 0 WHEN contains(name, word) OR contains(word, name) THEN 1 ELSE 2 + levenshtein(word, name) END AS far FROM w, n)
    SELECT word, name, rank FROM (SELECT word, name, row_number() OVER (PARTITION BY word ORDER BY far, name) AS rank FROM s) WHERE rank <= 3""")
def plan_nearest_types(spark, sf):
    words = spark.read.parquet(f"{sf}/part.parquet").select(F.regexp_replace(F.lower("p_type"), " ", "-").alias("word"))
    return plan.suggestions(words, spark.createDataFrame([(n,) for n in CATALOG.names], "name string"))


@query("""SELECT id, 'INV-' || id AS number, CASE WHEN id % 2 = 0 THEN cust::VARCHAR ELSE '-' END AS seller, CASE WHEN id % 2 = 0 THEN 'number:superseded' ELSE 'number:superseded|seller:ungrounded' END AS dropped FROM d_texts""")
def infer_merged_fields(spark, sf):
    t = views(spark, sf, "d_texts")["d_texts"]
    sure = F.create_map(F.lit("number"), F.concat(F.lit("INV-"), F.col("id").cast("string")))
    text = F.concat("text", F.lit(" by "), F.col("cust").cast("string"), F.lit(" "))
    model = F.create_map(F.lit("number"), F.lit("guess"), F.lit("seller"), F.when(F.col("id") % 2 == 0, F.col("cust").cast("string")).otherwise("Nobody Knows Ltd"))
    merged, dropped = infer.merged(sure, model, text)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(dropped), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "|")
    return t.select("id", F.try_element_at(merged, F.lit("number")).alias("number"), F.coalesce(F.try_element_at(merged, F.lit("seller")), F.lit("-")).alias("seller"), shown.alias("dropped"))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN 'INV-' || id WHEN 1 THEN 'RCT-' || id WHEN 2 THEN 'ACC' || cust || '77' WHEN 3 THEN 'X' || (1000000 + id) ELSE '-' END AS number, CASE WHEN id % 2 = 0 THEN cust::VARCHAR ELSE '-' END AS seller,
    CASE WHEN id % 5 = 4 THEN 'number:ungrounded' ELSE 'number:superseded' END || CASE WHEN id % 2 = 0 THEN '' ELSE '|seller:ungrounded' END AS dropped FROM d_texts""")
def infer_merged_fields_all_kinds(spark, sf):
    """All five kinds of text; notes have no number that is sure, so the model's guess must be found in the text."""
    t = views(spark, sf, "d_texts")["d_texts"]
    key, k = F.col("id").cast("string"), F.col("id") % 5
    said = F.when(k == 0, F.concat(F.lit("INV-"), key)).when(k == 1, F.concat(F.lit("RCT-"), key)).when(k == 2, F.concat(F.lit("ACC"), F.col("cust").cast("string"), F.lit("77"))).when(k == 3, F.concat(F.lit("X"), (F.col("id") + 1000000).cast("string")))
    text = F.concat("text", F.lit(" by "), F.col("cust").cast("string"), F.lit(" "))
    model = F.create_map(F.lit("number"), F.lit("guess"), F.lit("seller"), F.when(F.col("id") % 2 == 0, F.col("cust").cast("string")).otherwise("Nobody Knows Ltd"))
    merged, dropped = infer.merged(F.when(said.isNotNull(), F.create_map(F.lit("number"), said)), model, text)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(dropped), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "|")
    field = lambda name: F.coalesce(F.try_element_at(merged, F.lit(name)), F.lit("-"))
    return t.select("id", field("number").alias("number"), field("seller").alias("seller"), shown.alias("dropped"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '-' ELSE string_agg(trim(l_returnflag || '-' || l_linenumber), chr(10) ORDER BY l_linenumber % 3, l_quantity, l_linenumber) END AS text,
    CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE round(avg(l_discount), 9) END AS confidence, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE max(l_linenumber % 3) END AS pages FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def ocr_assembly(spark, sf):
    """Blocks stand in an answer as their lines stand in the table, so that those of one place stay in that order, whatever order rows arrive in."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("stands"))
    lines = lines.join(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    block = F.struct(F.concat(F.lit(" "), "l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string")).alias("text"), F.array(F.col("l_linenumber").cast("double"), "l_quantity").alias("bbox"), F.col("l_discount").alias("confidence"), (F.col("l_linenumber") % 3).alias("page"))
    answers = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.struct(F.when(F.col("o_orderkey") % 10 == 0, 2).otherwise(1).alias("contract"), F.transform(F.array_sort(F.collect_list(F.struct("stands", block.alias("block")))), lambda x: x["block"]).alias("blocks"))).alias("json"))
    a = answers.withColumn("a", ocr.parsed(F.col("json")))
    return a.select("o_orderkey", F.coalesce(ocr.text(F.col("a")), F.lit("-")).alias("text"), F.coalesce(F.round(F.when(F.col("a").isNotNull(), ocr.mean_confidence(F.col("a"))), 9), F.lit(-1)).alias("confidence"), F.coalesce(ocr.pages(F.col("a")), F.lit(-1)).alias("pages"))


REPLIES = """CASE id % 8 WHEN 0 THEN '{"contract":1,"doctype":"Invoice","category":"travel","confidence":' || cast(id % 100 / 50.0 AS string) || '}' WHEN 1 THEN '{"contract":2,"doctype":"invoice","confidence":0.9}' WHEN 2 THEN '{"contract":1,"doctype":" ","confidence":0.9}'
    WHEN 3 THEN '{"error":"no_model","message":"x"}' WHEN 4 THEN 'oops' WHEN 5 THEN '{"contract":1,"doctype":"made-up","confidence":0.9}' WHEN 6 THEN '{"contract":1,"doctype":"boarding pass","confidence":0.5}' ELSE '{"contract":1,"doctype":"nda","confidence":0.3}' END"""


@query("""SELECT id, CASE id % 8 WHEN 1 THEN 'unsupported_contract' WHEN 2 THEN 'bad_response' WHEN 3 THEN 'no_model' WHEN 4 THEN 'bad_response' ELSE '-' END AS fault,
    CASE WHEN id % 8 = 0 AND id % 100 >= 25 THEN 'invoice' WHEN id % 8 = 6 THEN 'boarding-pass' ELSE 'receipt' END AS doctype, CASE WHEN id % 8 = 0 AND id % 100 >= 25 THEN 'financial' WHEN id % 8 = 6 THEN 'travel' ELSE 'financial' END AS category,
    CASE WHEN id % 8 = 0 AND id % 100 >= 25 THEN least((id % 100) / 50.0::DOUBLE, 1.0::DOUBLE) WHEN id % 8 = 6 THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS confidence, CASE WHEN id % 8 = 0 AND id % 100 >= 25 OR id % 8 = 6 THEN 'model' ELSE 'rules' END AS tier FROM d_files""")
def model_replies(spark, sf):
    rules = F.struct(F.lit("receipt").alias("doctype"), F.lit("financial").alias("category"), F.lit(0.4).alias("confidence"))
    d = views(spark, sf, "d_files")["d_files"].withColumn("json", F.expr(REPLIES))
    d = d.withColumn("c", model.chosen(model.validated(F.col("json"), CATALOG, 0.5), rules))
    return d.select("id", F.coalesce(model.fault(F.col("json")), F.lit("-")).alias("fault"), "c.doctype", "c.category", "c.confidence", "c.tier")


@query(r"""SELECT id, CASE id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS local, 'qwen' || id AS model, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN id % 9 ELSE 0 END AS pages, greatest(id % 4, 1) AS feeds FROM d_files""")
def model_names_and_pages(spark, sf):
    d = views(spark, sf, "d_files")["d_files"]
    pick = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (F.col("id") % len(xs) + 1).cast("int"))
    endpoint = pick("", "http://localhost:11434/api", "http://0.0.0.0:1", "https://u:p@[::1]:80/x?y", "http://example.org#localhost", "http://localhost.example.org")
    info = pick("Title: x", F.concat(F.lit("Producer: y\nPages:   "), (F.col("id") % 9).cast("string"), F.lit("\nSize: 1")), "Pages: many")
    feeds = F.concat(F.lit("text"), F.repeat(F.lit("\f"), (F.col("id") % 4).cast("int")))
    return d.select("id", model.is_local(endpoint).alias("local"), model.normalized_model(F.concat(F.lit(" hub/org/Qwen"), F.col("id").cast("string"), F.lit(":3b "))).alias("model"), model.info_pages(info).alias("pages"), model.form_feed_pages(feeds).cast("long").alias("feeds"))


@query(r"""SELECT id, 'kMDItemUserTags == "' || lower(replace(name, chr(39), '')) || '"c' AS expression FROM d_files""")
def desktop_tag_query(spark, sf):
    return views(spark, sf, "d_files")["d_files"].select("id", model.tag_query(F.lower("name")).alias("expression"))


FREE = """CASE id % 6 WHEN 0 THEN 'Sure: {"doctype": "invoice", "confidence": ' || cast(id % 90 + 2 AS string) || ', "fields": {"a": "}{"}} and {"x": 1}' WHEN 1 THEN '{"doctype":"visa","confidence":"0.' || cast(id % 10 AS string) || '"}' WHEN 2 THEN 'no answer ' || cast(id AS string)
    WHEN 3 THEN '} {"doctype": "' WHEN 4 THEN '{"doctype": " ", "confidence": 1}' ELSE '{"doctype":" nda ","fields":{"k":"' || cast(id AS string) || '"}} {' END"""


@query("""SELECT id, CASE id % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'visa' WHEN 5 THEN 'nda' ELSE '-' END AS doctype, CASE id % 6 WHEN 0 THEN round((id % 90 + 2) / 100.0::DOUBLE, 4) WHEN 1 THEN round((id % 10) / 10.0::DOUBLE, 4) WHEN 5 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS confidence,
    CASE id % 6 WHEN 0 THEN '}{' WHEN 5 THEN id::VARCHAR ELSE '-' END AS field FROM d_files""")
def model_free_answers(spark, sf):
    """Objects in prose, confidences of a hundred or as text, and answers without an object."""
    d = views(spark, sf, "d_files")["d_files"].select("id", model.loose_answer(F.expr(FREE)).alias("s"))
    field = F.coalesce(F.try_element_at("s.fields", F.lit("a")), F.try_element_at("s.fields", F.lit("k")), F.lit("-"))
    return d.select("id", F.coalesce("s.doctype", F.lit("-")).alias("doctype"), F.coalesce("s.confidence", F.lit(-1.0)).alias("confidence"), field.alias("field"))


@query("""SELECT id, CASE id % 3 WHEN 0 THEN 'reserved folder' WHEN 1 THEN 'outside the collection' ELSE '-' END AS fault, CASE WHEN id % 2 = 0 THEN 'active' ELSE 'active|nora-field' END AS tags, CASE WHEN id % 2 = 0 THEN 'made-up-' || id ELSE '-' END AS dropped FROM d_files""")
def filing_recheck(spark, sf):
    d = views(spark, sf, "d_files")["d_files"]
    target = F.element_at(F.array(F.concat(F.lit("manifests/"), "rel_path"), F.concat(F.lit("../"), "rel_path"), F.col("rel_path")), (F.col("id") % 3 + 1).cast("int"))
    tags = F.when(F.col("id") % 2 == 0, F.array(F.lit("Active "), F.concat(F.lit("made-up-"), F.col("id").cast("string")))).otherwise(F.array(F.lit("nora-field"), F.lit("active"), F.lit("active")))
    got = filing.rechecked(d.select("id", target.alias("destination"), tags.alias("tags")), CONFIG, "/vault")
    return got.select("id", F.coalesce("fault", F.lit("-")).alias("fault"), F.array_join("tags", "|").alias("tags"), F.when(F.size("dropped_tags") > 0, F.array_join("dropped_tags.tag", "|")).otherwise("-").alias("dropped"))


@query("""SELECT id, 'number:INV-' || id || CASE WHEN id % 2 = 0 THEN '|date:' || day ELSE '' END || '|seller:Globex' AS fields FROM (SELECT id, strftime(day, '%Y-%m-%d') AS day FROM d_texts)""")
def infer_fields_over(spark, sf):
    """Fields of a stated type over those found before."""
    t = views(spark, sf, "d_texts")["d_texts"]
    stated = F.create_map(F.lit("number"), F.concat(F.lit("INV-"), F.col("id").cast("string")))
    found = F.map_filter(F.create_map(F.lit("number"), F.lit("old"), F.lit("seller"), F.lit("Globex"), F.lit("date"), F.when(F.col("id") % 2 == 0, F.col("day").cast("string"))), lambda k, v: v.isNotNull())
    m = infer.merged_over(stated, found)
    part = lambda k: F.when(F.map_contains_key(m, k), F.concat(F.lit(k + ":"), F.try_element_at(m, F.lit(k))))
    return t.select("id", F.concat_ws("|", part("number"), part("date"), part("seller")).alias("fields"))


def _reply(kind: str, good: str, sure: str) -> str:
    return f"""CASE {kind} WHEN 0 THEN '{{"contract":1,"doctype":"{good}","confidence":{sure}}}' WHEN 1 THEN '{{"contract":1,"doctype":"Unclassified","confidence":1}}' WHEN 2 THEN '{{"contract":1,"doctype":"{good}","confidence":0.1}}'
        WHEN 3 THEN '{{"error":"no_model","message":"x"}}' ELSE 'oops' END"""


@query("""WITH k AS (SELECT id, id % 5 AS a, id // 5 % 5 AS b, id // 25 % 2 AS r FROM d_files), w AS (SELECT *, ['answered', 'declined', 'unusable', 'failed', 'failed'] AS s, [NULL, NULL, NULL, 'no_model', 'bad_response'] AS f FROM k)
    SELECT id, CASE WHEN a = 0 THEN 'invoice' WHEN b = 0 THEN 'boarding-pass' WHEN r = 0 THEN 'receipt' ELSE 'unclassified' END AS doctype, CASE WHEN a = 0 THEN 0.9 WHEN b = 0 THEN 0.8 WHEN r = 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence,
        CASE WHEN a = 0 THEN 'first' WHEN b = 0 THEN 'second' ELSE 'rules' END AS tier, CASE WHEN a >= 3 THEN 'first:' || f[a + 1] WHEN a > 0 AND b >= 3 THEN 'second:' || f[b + 1] ELSE '-' END AS degraded,
        'first=' || s[a + 1] || CASE WHEN a = 0 THEN '' ELSE '|second=' || s[b + 1] || CASE WHEN b = 0 THEN '' WHEN r = 0 THEN '|rules=answered' ELSE '|rules=unusable' END END AS attempts FROM w""")
def model_chain_matrix(spark, sf):
    """Every way in which two tiers and the rules can answer, decline, fall short or fail."""
    n = lambda by, of: f"cast(id / {by} AS bigint) % {of}"
    d = views(spark, sf, "d_files")["d_files"].select("id", F.expr(_reply(n(1, 5), "Invoice", "0.9")).alias("a"), F.expr(_reply(n(5, 5), "boarding pass", "0.8")).alias("b"), F.expr(f"if({n(25, 2)} = 0, 0.6D, 0.3D)").alias("r"))
    rules = F.struct(F.lit("receipt").alias("doctype"), F.lit("financial").alias("category"), F.col("r").alias("confidence"))
    tiers = [chain.Tier("first", "a"), chain.Tier("absent", "b", available=False), chain.Tier("second", "b")]
    got = d.withColumn("c", chain.classified(tiers, rules, CATALOG, 0.5))
    shown = F.array_join(F.transform("c.attempts", lambda t: F.concat(t["tier"], F.lit("="), t["status"])), "|")
    return got.select("id", "c.doctype", "c.confidence", "c.tier", F.coalesce(F.concat("c.degraded.tier", F.lit(":"), "c.degraded.reason"), F.lit("-")).alias("degraded"), shown.alias("attempts"))


@query("""SELECT rel_path AS path, CASE WHEN id % 5 IN (0, 1) THEN 'New/' || id || '.pdf' ELSE '-' END AS move_to, CASE id % 5 WHEN 0 THEN '-' WHEN 3 THEN 'active|tax' ELSE 'active' END AS add_tags,
    CASE id % 5 WHEN 2 THEN 'rules disagree about its place' WHEN 4 THEN 'another document would go there' ELSE '-' END AS why_not,
    CASE id % 5 WHEN 0 THEN 'fixed' WHEN 1 THEN 'fixed|fixed|fixed' WHEN 2 THEN 'fixed|skipped|skipped' WHEN 3 THEN 'fixed|fixed' ELSE 'fixed|skipped' END || '|skipped' AS states, CASE WHEN id % 5 IN (0, 1) THEN 'New/' || id || '.pdf' ELSE rel_path END AS final
    FROM (SELECT id, id || '/' || rel_path AS rel_path FROM d_files)""")
def lint_repairs(spark, sf):
    """Moves and tags that rules ask for together: agreed, disputed, for one place, and none."""
    d = views(spark, sf, "d_files")["d_files"].select("id", F.concat(F.col("id").cast("string"), F.lit("/"), "rel_path").alias("path"))
    place = F.concat(F.lit("New/"), F.col("id").cast("string"), F.lit(".pdf"))
    one = lambda rule, to, tag: F.struct(F.lit(rule).alias("rule"), to.cast("string").alias("move_to"), tag.cast("string").alias("add_tag"))
    none, tag = F.lit(None), F.lit("active")
    wanted = {
        0: [one("wrong-folder", place, none)], 1: [one("wrong-folder", place, none), one("name-normalization", place, none), one("missing-lifecycle-tag", none, tag)],
        2: [one("wrong-folder", place, none), one("name-normalization", F.lit("Elsewhere/x.pdf"), none), one("missing-lifecycle-tag", none, tag)],
        3: [one("missing-lifecycle-tag", none, tag), one("missing-tag", none, F.lit("tax"))], 4: [one("wrong-folder", F.lit("New/shared.pdf"), none), one("missing-lifecycle-tag", none, tag)],
    }
    every = F.coalesce(*[F.when(F.col("id") % 5 == k, F.array(*v, one("name-grammar", none, none))) for k, v in wanted.items()])
    found = d.select("path", F.inline(every))
    fixes = repair.composed(found)
    told = repair.told(found, fixes, fixes.where("move_to is not null").select("path", "move_to"))
    states = told.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("state")), "|").alias("states"), F.max("final").alias("final"))
    return fixes.join(states, "path").select("path", F.coalesce("move_to", F.lit("-")).alias("move_to"), F.when(F.size("add_tags") > 0, F.array_join("add_tags", "|")).otherwise("-").alias("add_tags"), F.coalesce("why_not", F.lit("-")).alias("why_not"), "states", "final")
