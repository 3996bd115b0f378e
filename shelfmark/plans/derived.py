"""Tables of documents, files, tags and sidecars derived from the star schema, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Config, DocType, Person

PEOPLE = (Person("Nora Field", "nora-field"), Person("Omar Field", "omar-field"), Person("Iris Vane", "iris-vane"))
CONFIG = Config(people=PEOPLE, companies=("acme-corp", "brand-11"), areas=("tax",), fiscal_years=("fy1995", "fy1996"), single_active=("passport",), require_lifecycle=True)
LICENCES = (DocType("open-licence", "legal", ("mit license", "apache license", "creative commons", "public domain")),)

SQL = {
    # one text per order, of five kinds
    "d_texts": """
        SELECT o_orderkey AS id, o_custkey AS cust, cast(o_orderdate AS date) AS day, CASE o_orderkey % 5
            WHEN 0 THEN 'TAX INVOICE' || chr(10) || 'Invoice Number: INV-' || cast(o_orderkey AS string) || chr(10) || 'Bill To: ' || c_name || chr(10) || 'Date: ' || dmy || chr(10) || 'Total: ' || printf('%.2f', o_totalprice)
            WHEN 1 THEN 'Payment received' || chr(10) || 'RECEIPT No: RCT-' || cast(o_orderkey AS string) || chr(10) || 'Paid in full. Date: ' || dmy || chr(10) || 'Total ' || printf('%.2f', o_totalprice) || chr(10) || 'for Nora Field'
            WHEN 2 THEN 'Account statement' || chr(10) || 'Account number: ACC' || cast(o_custkey AS string) || '77' || chr(10) || 'Opening balance, statement period' || chr(10) || 'Closing balance: ' || printf('%.2f', o_totalprice)
            WHEN 3 THEN 'PASSPORT' || chr(10) || 'Passport No: X' || cast(1000000 + o_orderkey AS string) || chr(10) || 'Nationality: Exampland' || chr(10) || 'P<EXPVANE<<IRIS<<<<' || chr(10) || 'Date of expiry: ' || dmy
            ELSE 'Notes about ' || o_orderpriority || ' and a receipt, seen on ' || iso || ' by omar field' END AS text
        FROM (SELECT *, cast(cast(o_orderdate AS date) AS string) AS iso, substr(cast(cast(o_orderdate AS date) AS string), 9, 2) || '/' || substr(cast(cast(o_orderdate AS date) AS string), 6, 2) || '/' || substr(cast(cast(o_orderdate AS date) AS string), 1, 4) AS dmy FROM orders) o
        JOIN customer ON o_custkey = c_custkey
    """,
    # one file per order; names of one in eleven say nothing, one in seven lies in the wrong folder
    "d_files": """
        SELECT id, day, size, sha, active_n, folder || '/' || name AS rel_path, name FROM (
            SELECT o_orderkey AS id, cast(o_orderdate AS date) AS day, cast(o_totalprice * 10 AS bigint) AS size, 'sha' || cast(o_orderkey % 1000 AS string) AS sha, o_orderkey % 4 AS active_n,
                CASE WHEN o_orderkey % 7 = 0 THEN 'Travel/Iris-Vane' WHEN o_orderkey % 13 = 0 THEN 'Inbox'
                    ELSE CASE o_orderkey % 6 WHEN 0 THEN 'Financial/' || own || '/FY ' || yr WHEN 1 THEN 'Financial/' || own || '/FY ' || yr WHEN 2 THEN 'Identity/' || own WHEN 3 THEN 'Travel/' || own WHEN 4 THEN 'Personal/' || own ELSE 'Insurance/' || own END END AS folder,
                CASE WHEN o_orderkey % 11 = 0 THEN 'old notes ' || cast(o_orderkey AS string) || '.txt' WHEN o_orderkey % 17 = 0 THEN 'Invoice_my password.pdf'
                    ELSE CASE o_orderkey % 6 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'Receipt' WHEN 2 THEN 'Passport' WHEN 3 THEN 'Boarding-Pass' WHEN 4 THEN 'Mystery-Type' ELSE 'Insurance-Policy' END
                        || '_' || names || '_' || CASE WHEN o_orderkey % 3 = 0 THEN 'Acme-Corp' ELSE 'Order-' || cast(o_orderkey AS string) END
                        || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '_' || yr END || CASE WHEN o_orderkey % 10 = 0 THEN '_Draft' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '.pdf' ELSE '.txt' END END AS name
            FROM (SELECT *, substr(cast(cast(o_orderdate AS date) AS string), 1, 4) AS yr,
                CASE o_custkey % 5 WHEN 0 THEN 'Nora-Field' WHEN 1 THEN 'Omar-Field' WHEN 2 THEN '_Shared' WHEN 3 THEN '_Shared' ELSE 'Stranger-Person' END AS own,
                CASE o_custkey % 5 WHEN 0 THEN 'Nora-Field' WHEN 1 THEN 'Omar-Field' WHEN 2 THEN 'Nora-Field+Omar-Field' WHEN 3 THEN 'Shared' ELSE 'Stranger-Person' END AS names FROM orders) o
        ) f
    """,
    # what was recorded about half of the files, and some orphans
    "d_sidecars": """
        SELECT path, min(s_doctype) AS s_doctype, min(s_owner) AS s_owner, min(s_year) AS s_year, min(s_sha) AS s_sha, min(s_text) AS s_text FROM (
            SELECT CASE WHEN o_orderkey % 19 = 0 THEN 'Gone/.lost-' || cast(o_orderkey AS string) || '.txt.meta.yaml' ELSE substr(rel_path, 1, length(rel_path) - length(name)) || '.' || name || '.meta.yaml' END AS path,
                CASE WHEN o_orderkey % 6 = 0 THEN 'receipt' ELSE 'invoice' END AS s_doctype, CASE WHEN o_orderkey % 5 = 0 THEN 'Iris Vane' ELSE NULL END AS s_owner, cast(1990 + o_orderkey % 30 AS int) AS s_year,
                CASE WHEN o_orderkey % 8 = 0 THEN 'stale' ELSE 'sha' || cast(o_orderkey % 1000 AS string) END AS s_sha, 'extracted ' || o_orderpriority AS s_text
            FROM orders JOIN d_files ON id = o_orderkey WHERE o_orderkey % 2 = 0
        ) x GROUP BY path
    """,
    # raw tags of each file, written untidily
    "d_tags": """
        SELECT id, CASE id % 6 WHEN 0 THEN ' Active ,acme-corp,active' WHEN 1 THEN 'superseded,FY1995,unheard-of' WHEN 2 THEN 'nora-field,confidential,ACTIVE' WHEN 3 THEN '' WHEN 4 THEN 'fy2001,brand-11,to-action' ELSE 'Tax,active,omar-field,omar-field' END AS raw FROM d_files
    """,
}
ORDER = ("d_texts", "d_files", "d_sidecars", "d_tags")


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The derived tables, as frames."""
    for base in ("orders", "customer", "lineitem", "part"):
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    out = {}
    for name in ORDER:
        out[name] = spark.sql(SQL[name])
        out[name].createOrReplaceTempView(name)
    return {n: out[n] for n in names} if names else out


def with_derived(sql: str) -> str:
    """The SQL with the derived tables it names in front, for an oracle."""
    needed, todo = set(), [n for n in ORDER if n in sql]
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in ORDER if m != n and m in SQL[n]]
    ctes = [f"{n} AS ({SQL[n]})" for n in ORDER if n in needed]
    if not ctes:
        return sql
    body = sql.strip()
    return "WITH " + ", ".join(ctes) + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)
