"""Values of the text, fiscal, grounding and classifier functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark import config
from shelfmark.config import Config, Person
from shelfmark.functions import fiscal, ground, regex
from shelfmark.functions import tags as G
from shelfmark.functions import text as T
from shelfmark.operators import catalog as C
from shelfmark.operators import grammar, infer


def one(spark, f, *values):
    """The value of a Column function of strings."""
    cols = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols))
    return row.select(f(*map(F.col, cols)).alias("v")).first().v


@pytest.mark.parametrize("f, value, want", [
    (T.slug, "Acme Corp. & Söhne", "acme-corp-s-hne"), (T.slug, "--", ""), (T.word, " Alex\tRao/x_y ", "Alex-Rao-x-y"), (T.word, "a--b", "a-b"), (T.title_case, "boarding-pass", "Boarding-Pass"), (T.title_case, "nDA", "NDA"),
    (T.normalize_for_match, "Æsir Straße, ŁÓDŹ!", "aesir strasse lodz"), (T.field_name, "  Invoice No. ", "invoice_no"), (T.password_token, "my_PIN-1.pdf", "PIN"), (T.password_token, "Passport-Office.pdf", None),
    (T.sidecar_path, "a/b.txt", "a/.b.txt.meta.yaml"), (T.document_of, "a/.b.txt.meta.yaml", "a/b.txt"), (T.placeholder_of, "a/.b.pdf.icloud", "a/b.pdf"), (T.placeholder_of, "a/b.pdf", None),
    (T.year_in, "in 1899 or 2024", 2024), (T.year_in, "x20245", None), (T.extension, "a.tar.gz", ".gz"), (T.extension, "a", ""), (ground.canonical, "$1,240.00", "1240"), (ground.canonical, "-5", "-5"), (ground.canonical, "INV-1", None), (ground.canonical, "100", "100"),
])
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_clip_between_characters(spark):
    for n in range(1, 12):
        got = one(spark, lambda c: T.clip(c, n), "aé日🙂b")
        assert "aé日🙂b".startswith(got) and len(got.encode()) <= n and len(("aé日🙂b"[: len(got) + 1]).encode()) > n - 0 or got == "aé日🙂b"


PERIODS = [("2026", "2026-01-01", "2027-01-01"), ("2026-05", "2026-05-01", "2026-06-01"), ("2026-05-11", "2026-05-11", "2026-05-12"), ("FY2026", "2026-04-01", "2027-04-01"), ("fy2026-27", "2026-04-01", "2027-04-01"), ("FY26", "2026-04-01", "2027-04-01"), ("FY2026Q3", "2026-10-01", "2027-01-01"), ("2026-Q4", "2027-01-01", "2027-04-01"), ("2026Q1", "2026-04-01", "2026-07-01")]


@pytest.mark.parametrize("text, first, to", PERIODS)
def test_periods(spark, text, first, to):
    calendar = fiscal.Calendar(4)
    p = calendar.parse(text)
    assert (p.first, p.to) == (dt.date.fromisoformat(first), dt.date.fromisoformat(to))
    assert (one(spark, lambda c: calendar.period(c)[0], text), one(spark, lambda c: calendar.period(c)[1], text)) == (p.first, p.to)


@pytest.mark.parametrize("text", ["", "soon", "2026-13", "FY", "FY2026-28", "FY2026Q5", "Q3", "2026-1-1-1", "20x6"])
def test_no_periods(spark, text):
    with pytest.raises(ValueError):
        fiscal.Calendar(4).parse(text)
    assert one(spark, lambda c: fiscal.Calendar(4).period(c)[0], text) is None


def test_fiscal_boundaries(spark):
    for start, day, year, quarter in [(4, "2026-03-31", 2025, 4), (4, "2026-04-01", 2026, 1), (1, "2026-12-31", 2026, 4), (10, "2026-09-30", 2025, 4), (10, "2026-10-01", 2026, 1)]:
        c = fiscal.Calendar(start)
        assert one(spark, lambda d: c.year_of(d.cast("date")), day) == year and one(spark, lambda d: c.quarter_of(d.cast("date")), day) == quarter
    assert fiscal.Calendar(4).label_of(1999) == "FY 99-00" and fiscal.Calendar(4).tag_of(2026) == "fy26-27" and fiscal.Calendar().label_of(2026) == "FY 2026" and fiscal.Calendar().tag_of(2026) == "fy2026"


@pytest.mark.parametrize("text, value, want", [
    ("Total due 1,240.00 on 2026-03-11", "1240", True), ("Total due 1,240.00", "1240.5", False), ("Paid on 11 March 2026.", "2026-03-11", True), ("Paid 03/11/2026", "11 Mar 2026", True), ("Paid March 11th, 2026", "11/03/26", True),
    ("ACME Ltd, London", "acme ltd", True), ("ACME Limited", "acme ltd", False), ("anything", " ", False), ("a b c", "b c", True), ("a bc", "b", False), ("31.02.2026", "2026-02-31", True), ("-5 items", "5", True),
])
def test_grounding(spark, text, value, want):
    assert one(spark, ground.grounded, text, value) is want


def test_regex_edges_are_ascii(spark):
    assert one(spark, lambda c: c.rlike(regex.java(r"(?i)\bbill\b")), "äbill") and not one(spark, lambda c: c.rlike(regex.java(r"\bbill\b")), "xbill")
    assert one(spark, lambda c: c.rlike(regex.phrase("e-ticket")), "an e-ticket.") and not one(spark, lambda c: c.rlike(regex.java(r"a[\s]b")), "a\x0bb")


CONFIDENCE = [("invoice, tax invoice, invoice number, invoice no, bill to", "invoice", 0.5263157894736843), ("passport passport no passport number type p date of expiry place of issue", "passport", 0.6666666666666666), ("P<UTOERIKSSON<<ANNA", "passport", 0.5), ("receipt, paid in full, payment received", "receipt", 0.5), ("receipt and paid in full", "receipt", 0.4), ("receipt", "unclassified", 0.0), ("", "unclassified", 0.0), (None, "unclassified", 0.0)]


def test_classifier_boundaries(spark):
    catalog = C.Catalog.of(Config())
    assert len(catalog.types) == 44
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CONFIDENCE)], "id long, text string")
    got = {r.id: r for r in C.classify(rows, catalog).collect()}
    for i, (_, doctype, confidence) in enumerate(CONFIDENCE):
        assert got[i].doctype == doctype
        if i:
            assert abs(got[i].confidence - confidence) < 1e-12
        assert got[i].accepted == (got[i].confidence >= 0.5 and doctype != "unclassified")
    own = C.Catalog.of(Config(doctypes=(config.DocType("Invoice", "legal", ("rechnung",)),)))
    assert dict((t.name, t.category) for t in own.types)["invoice"] == "legal"


def test_names_round_trip(spark):
    cfg = Config(people=(Person("Nora Field", "nora-field"), Person("Nora Field Vane", "nfv")))
    names = ["Invoice_Nora-Field_Acme-Corp_2026.pdf", "Boarding-Pass_Shared_X.txt", "Invoice_Nora-Field+Nora-Field-Vane_A_2026_Draft.pdf", "Invoice_Nora-Field_A_Draft"]
    d = spark.createDataFrame([(n,) for n in names], "name string").withColumn("d", grammar.parse(cfg, F.col("name")))
    again = grammar.render(cfg, F.col("d.doctype"), F.col("d.owners"), F.col("d.identifier"), F.col("d.year"), F.col("d.modifier"), F.col("d.ext"), F.lit("travel"))
    assert [r.again for r in d.select(again.alias("again")).collect()] == names
    for bad in ("notes.txt", "a_b.pdf", "Invoice_X_Y_Draft_More.pdf", "_X_Y.pdf"):
        assert not one(spark, lambda c: grammar.parse(cfg, c)["parsed"], bad)
    same = Config(people=cfg.people, owner_sep="-")
    resolved = lambda s: one(spark, lambda c: grammar.parse(same, c)["owners"], s)
    assert resolved("Invoice_Nora-Field-Vane_A.pdf") == ["Nora Field Vane"] and resolved("Invoice_Nora-Field-Nora-Field-Vane_A.pdf") == ["Nora Field", "Nora Field Vane"]
    assert one(spark, lambda c: grammar.parse(same, c)["ambiguous"], "Invoice_Nora-Stranger_A.pdf") is True


def test_inference(spark):
    cfg = Config(people=(Person("Nora Field", "nora-field"), Person("Omar Field", "omar-field"), Person("Al Vane", "al-vane")))
    found = lambda name, text: [(r.value, r.source) for r in one(spark, lambda n, t: infer.owners(cfg, n, t), name, text)]
    assert found("nora-field scan.pdf", "for omar") == [("Nora Field", "filename"), ("Omar Field", "given-name")]
    assert found("x.pdf", "al vane and nobody") == [("Al Vane", "document-text")] and found("x.pdf", "al") == []
    fields = F.create_map(F.lit("Vendor"), F.lit("Globex Invoice"), F.lit("issuer"), F.lit("N/A"))
    got = one(spark, lambda n: infer.identifier(fields, n, F.lit("invoice"), F.array().cast("array<string>")), "scan.pdf")
    assert tuple(got) == ("Globex", "extracted-field")
    none = F.lit(None).cast("map<string,string>")
    assert tuple(one(spark, lambda n: infer.identifier(none, n, F.lit("invoice"), F.array(F.lit("Nora Field"))), "scan 2024 nora invoice.pdf")) == ("Untitled", "none")


def test_tags_and_configuration(spark):
    cfg = config.parse("people: [{name: Nora Field}]\ntags: {companies: [acme-corp]}\nfiscal_year: {start_month: 4}\n")
    assert one(spark, lambda c: G.kind(cfg, c), "fy26-27") == "fiscal-year" and one(spark, lambda c: G.kind(cfg, c), "nora-field") == "person" and one(spark, lambda c: G.kind(cfg, c), "x") == "unknown"
    assert one(spark, lambda c: G.normalize(F.split(c, ",")), " B,a\nx,,b") == ["a", "b"]
    for bad in ("nonsense: 1", "version: 9", "fiscal_year: {start_month: 13}", "filename: {pattern: '{Names}'}", "filename: {pattern: '{DocType}[{Year}'}", "people: [{name: A, tag: t}, {name: B, tag: t}]", "structure: {x: {path: /abs}}", "filename: {field_sep: '-'}"):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_ocr_reading_order(spark):
    from shelfmark.functions import ocr

    answer = '{"contract":1,"blocks":[{"text":" b ","bbox":[0.5,0.1,0,0],"confidence":0.9,"page":1},{"text":"c","bbox":[0,0,0,0],"confidence":0.5,"page":2},{"text":"a","bbox":[0.1,0.1,0,0],"confidence":0.8,"page":1},{"text":" ","bbox":[0,0,0,0],"confidence":1.0,"page":1}]}'
    row = one(spark, lambda c: F.struct(ocr.text(ocr.parsed(c)).alias("t"), ocr.mean_confidence(ocr.parsed(c)).alias("m"), ocr.pages(ocr.parsed(c)).alias("p")), answer)
    assert row.t == "a\nb\nc" and abs(row.m - 0.8) < 1e-9 and row.p == 2
    assert one(spark, lambda c: ocr.text(ocr.parsed(c)), '{"contract":2,"blocks":[]}') is None


def test_overlapping_ranges_and_sql_functions(spark):
    import datetime as dt

    from shelfmark.functions import sql
    from shelfmark.functions import text as T
    from shelfmark.functions.fiscal import Calendar
    from shelfmark.operators import search

    day = lambda n: dt.date(2019, 12, 20) + dt.timedelta(n)
    left = [(k, day(k * 37 % 900), day(k * 37 % 900 + k % 5 * 200)) for k in range(40)] + [(90, None, day(1)), (91, day(1), None)]
    right = [(k, day(k * 91 % 1000 - 30), day(k * 91 % 1000 - 30 + k % 4 * 300)) for k in range(30)] + [(95, None, None)]
    a, b = spark.createDataFrame(left, "i int, a date, b date"), spark.createDataFrame(right, "j int, c date, d date")
    got = search.overlapping(a, b, ("a", "b"), ("c", "d"))
    want = sorted((i, j) for i, x, y in left for j, u, v in right if None not in (x, y, u, v) and x < y and u < v and x < v and u < y)
    assert sorted((r.i, r.j) for r in got.collect()) == want and len(want) > 50 and got.columns == ["i", "a", "b", "j", "c", "d"]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and search.overlapping(a.limit(0), b, ("a", "b"), ("c", "d")).count() == 0
    counted = {r.j: (r.n, r.first, r.last) for r in search.overlap_counts(a, b, ("a", "b"), ("c", "d"), "i").collect()}
    assert counted == {j: (len(v), min(v), max(v)) for j in {j for _, j in want} for v in [[i for i, k in want if k == j]]}

    names = sql.register(spark, Calendar(4, "FY{yyyy1}/{yy2}"))
    assert len(names) == len(set(names)) and spark.sql("SELECT fy_label(DATE '2026-03-31') AS l, fy_tag(DATE '2026-04-01') AS t, fy_quarter(DATE '2026-03-31') AS q").first() == ("FY2025/26", "fy2026-27", 4)
    rows = [("Ünïcode Straße, Œuvre & Æther_x",), ("a  -- b__c/d\\e",), ("",), (None,), ("x/.y.pdf.meta.yaml",), ("o'brien\n2031",)]
    s = F.col("s")
    both = spark.createDataFrame(rows, "s string").selectExpr("s", "slug(s) AS a", "name_word(s) AS b", "title_words(s) AS c", "normalize_for_match(s) AS d", "field_name(s) AS e", "file_stem(s) AS f", "document_of(s) AS g", "is_sidecar(s) AS h", "year_in(s) AS i", "contains_words(s, 'strasse') AS j")
    same = both.select(F.col("a").eqNullSafe(T.slug(s)), F.col("b").eqNullSafe(T.word(s)), F.col("c").eqNullSafe(T.title_case(s)), F.col("d").eqNullSafe(T.normalize_for_match(s)), F.col("e").eqNullSafe(T.field_name(s)), F.col("f").eqNullSafe(T.stem(s)), F.col("g").eqNullSafe(T.document_of(s)), F.col("h").eqNullSafe(T.is_sidecar(s)), F.col("i").eqNullSafe(T.year_in(s)))
    assert all(all(r) for r in same.collect()) and [r.j for r in both.collect()][:3] == [True, False, False]


def test_tiers_by_name_and_order(spark):
    from shelfmark.functions import chain
    from shelfmark.operators import catalog as C
    from shelfmark.plans.derived import CONFIG

    catalog = C.Catalog.of(CONFIG)
    tiers = [chain.Tier("a", "x"), chain.Tier("b", "y", available=False, detail="needs a key")]
    rows = spark.createDataFrame([('{"contract":1,"doctype":"visa","confidence":0.9}', None), (None, '{"contract":1,"doctype":"visa","confidence":0.9}'), ('{"contract":1,"doctype":"made up","confidence":0.9}', "")], "x string, y string")
    none = F.lit(None).cast("struct<doctype: string, category: string, confidence: double>")
    got = [r.c for r in rows.select(chain.classified(tiers, none, catalog, 0.5).alias("c")).collect()]
    assert [(c.doctype, c.tier, c.degraded and c.degraded.reason) for c in got] == [("visa", "a", None), ("unclassified", "rules", "bad_response"), ("unclassified", "rules", None)]
    assert [t.reason for t in got[2].attempts] == ["unknown type", "not sure enough"] and got[2].category is None and got[2].confidence == 0
    alone = rows.select(chain.classified(tiers, none, catalog, 0.5, "rules").alias("c")).first().c
    assert [t.tier for t in alone.attempts] == ["rules"]
    with pytest.raises(ValueError, match="needs a key"):
        chain.classified(tiers, none, catalog, 0.5, "b")
    table = lambda forced: {r.name: (r.available, r.place, r.fault is not None) for r in chain.describe(spark, tiers, forced).collect()}
    assert table("") == {"a": (True, 1, False), "b": (False, None, False), "rules": (True, 2, False)}
    assert table("rules")["rules"] == (True, 1, False) and table("b")["b"] == (False, None, True) and table("b")["rules"][1] is None


def test_ranges_are_counted_without_pairs(spark):
    """Days before 1970, ranges of centuries and of one day, rows and periods that are there twice; and far more pairs than could be made."""
    import datetime as dt
    import random

    from shelfmark.operators import search

    dice, day = random.Random(3), lambda n: dt.date(1969, 12, 1) + dt.timedelta(n)
    spans = lambda n: [(k, day(x), day(x + dice.choice([0, 1, 2, 7, 64, 400, 100000]) - dice.randrange(2))) for k in range(n) for x in [dice.randrange(-300, 300)]]
    left, right = spans(300) * 2, spans(200)
    right += [(k + 1000, c, d) for k, c, d in right] + [(5000, dt.date(1, 1, 1), dt.date(9999, 12, 31)), (5001, None, day(1))]
    a, b = spark.createDataFrame(left, "id long, a date, b date"), spark.createDataFrame(right, "j long, c date, d date")
    want = {}
    for j, c, d in right:
        if hit := [i for i, x, y in left if None not in (c, d) and x < y and c < d and x < d and c < y]:
            want[j] = (len(hit), min(hit), max(hit))
    got = search.overlap_counts(a, b, ("a", "b"), ("c", "d"))
    assert {r.j: (r.n, r.first, r.last) for r in got.collect()} == want and got.count() == len(want) > 250
    n = 400000
    many = spark.range(n).selectExpr("id", "date_add(DATE '1999-01-01', cast(id % 900 as int)) AS a").selectExpr("*", "date_add(a, 500) AS b")
    row = search.overlap_counts(many, many.selectExpr("id AS j", "a AS c", "b AS d"), ("a", "b"), ("c", "d")).selectExpr("count(*) AS k", "sum(n) AS pairs").first()
    assert row.k == n and row.pairs > 10**11
