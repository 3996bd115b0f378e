"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return digests(format_conversations(turns.unionByName(extra)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import private_spans

    return private_spans(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import digests, periodic_runs, planted

    return digests(periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..runtime import Scratch
    from .trie import grafted, ordered, prefix_trie

    turns = Scratch(spark).write(ordered(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*grafted(turns))


QUERIES = {"op1_chat": op1_chat, "op2_pii": op2_pii, "op3_ann": op3_ann, "op4_html": op4_html, "op5_packing": op5_packing, "op6_toxicity": op6_toxicity, "op7_near_dedup": op7_near_dedup, "op8_langid": op8_langid, "op9_bpe": op9_bpe, "op10_exact_dedup": op10_exact_dedup, "op11_quality": op11_quality, "op12_periodic": op12_periodic, "op13_trie": op13_trie}

#: CRC-32 of a string of ASCII characters.
CRC32 = """xor(list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT), lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, x)), 4294967295::BIGINT), 4294967295)"""

ORACLE = {
    "op13_trie": r"""
        WITH o AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 5 AS host, CRC % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)
        ), t AS (
            SELECT c.conv_id, place, role, text FROM c JOIN o ON o.conv_id = host AND place <= h UNION ALL SELECT conv_id, 1000000 + place, role, text FROM c JOIN o USING (conv_id) WHERE place > h
        ), p AS (
            SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS key, strlen(text) AS size, count(*) OVER (PARTITION BY conv_id) AS turns
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY place)
        ), q AS (
            SELECT * FROM p UNION ALL SELECT conv_id, 0, '', 0, coalesce(any_value(turns), 0) FROM c LEFT JOIN p USING (conv_id) GROUP BY conv_id
        ), n AS (
            SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256 FROM q GROUP BY key
        ), e AS (
            SELECT n.*, u.key AS parent FROM n LEFT JOIN q u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1
        ), k AS (
            SELECT parent AS key, count(*) AS n_children FROM e WHERE parent IS NOT NULL GROUP BY parent
        ), s AS (
            SELECT q.key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens FROM n LEFT JOIN k USING (key) JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.key
        )
        SELECT e.conv_id, e.depth, u.conv_id AS parent_conv_id, e.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, e.ends_sha256
        FROM e JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN n u ON u.key = e.parent
    """.replace("CRC", CRC32.format("conv_id::VARCHAR")),
    "op12_periodic": r"""
        WITH d AS (
            SELECT doc_id, CRC AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), e AS (
            SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
        ), t AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM e
        ), u AS (
            SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM t
        ), m AS (
            SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
            FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4
        ), s AS (
            SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
        ), r AS (
            SELECT * FROM s WHERE NOT EXISTS (FROM s z WHERE z.doc_id = s.doc_id AND z.period < s.period AND z.start <= s.start AND z.start + z.length >= s.start + s.length)
        ), o AS (
            SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY doc_id
        ), b AS (
            SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1
        ), k AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (FROM r WHERE r.doc_id = u.doc_id AND u.i >= r.start + r.period AND u.i < r.start + r.length) GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
    """.replace("CRC", CRC32.format("doc_id::VARCHAR")),
    "op11_quality": r"""
        WITH w AS (
            SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
        ), said AS (
            SELECT doc_id, unnest(range(1, len(words) - 6)) AS spot, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS eight FROM w WHERE len(words) >= 8
        ), met AS (
            SELECT doc_id, spot FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, eight) AS n FROM said) WHERE n > 1
        ), rep AS (
            SELECT doc_id, count(DISTINCT spot + k) AS n_repeat_words FROM met, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
        ), m AS (
            SELECT doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(array_to_string(words, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                length(regexp_replace(array_to_string(words, ''), '[^A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN rep USING (doc_id)
        ), b AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                {'symbols': least(1000, 1000 * n_symbols // greatest(word_chars, 1)), 'capitals': least(1000, 1000 * n_upper // greatest(word_chars, 1)), 'long_words': least(1000, 20 * word_chars // greatest(n_words, 1)),
                 'dup_lines': least(1000, 1000 * n_dup_lines // greatest(n_lines, 1)), 'repeats': least(1000, 1000 * n_repeat_words // greatest(n_words, 1))} AS v FROM m
        ), told AS (
            SELECT lang, v, good, CRC % 3 = 0 AS fit FROM b JOIN (SELECT doc_id, bool_or(quality = 1) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
        ), each AS (
            SELECT lang, good, fit, 'symbols' AS rule, v.symbols AS value FROM told UNION ALL SELECT lang, good, fit, 'capitals', v.capitals FROM told UNION ALL SELECT lang, good, fit, 'long_words', v.long_words FROM told
            UNION ALL SELECT lang, good, fit, 'dup_lines', v.dup_lines FROM told UNION ALL SELECT lang, good, fit, 'repeats', v.repeats FROM told
        ), counts AS (
            SELECT lang, rule, value, count(*) FILTER (fit AND good) AS fg, count(*) FILTER (fit AND NOT good) AS fb, count(*) FILTER (NOT fit AND good) AS hg FROM each GROUP BY ALL
        ), steps AS (
            SELECT lang, rule, value, lag(value) OVER d AS next, coalesce(sum(fg) OVER u, 0) AS lost, coalesce(sum(fb) OVER u, 0) AS found, coalesce(sum(hg) OVER u, 0) AS rejected, sum(fg) OVER r AS goods, sum(fb) OVER r AS bads, sum(hg) OVER r AS n
            FROM counts WINDOW r AS (PARTITION BY lang, rule), d AS (PARTITION BY lang, rule ORDER BY value DESC), u AS (PARTITION BY lang, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), proposed AS (
            SELECT lang, rule, max_by(value, (gain, value)) AS proposal, max(gain) AS gain FROM (SELECT *, found * goods - 20 * lost * bads AS gain FROM steps) GROUP BY ALL HAVING max(gain) > 0
        ), share AS (
            SELECT lang, count(*) AS rules, sum(count(*)) OVER () AS tests FROM proposed GROUP BY lang
        ), tried AS (
            SELECT s.*, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05 / rules) + (n - i) * ln(1 - 0.05 / rules))) FROM (SELECT unnest(range(0, rejected::BIGINT + 1)) AS i)) <= 0.05 / tests AS safe
            FROM steps s JOIN proposed p ON s.lang IS NOT DISTINCT FROM p.lang AND s.rule = p.rule AND s.value >= p.proposal JOIN share h ON s.lang IS NOT DISTINCT FROM h.lang
        ), cut AS (
            SELECT lang, rule, coalesce((min(value) + min_by(next, value) - 1) // 2, min(value)) AS cutoff FROM tried WHERE safe GROUP BY ALL
        ), cuts AS (
            SELECT lang, max(cutoff) FILTER (rule = 'symbols') AS c1, max(cutoff) FILTER (rule = 'capitals') AS c2, max(cutoff) FILTER (rule = 'long_words') AS c3, max(cutoff) FILTER (rule = 'dup_lines') AS c4, max(cutoff) FILTER (rule = 'repeats') AS c5 FROM cut GROUP BY lang
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT (coalesce(v.symbols > c1, false) OR coalesce(v.capitals > c2, false) OR coalesce(v.long_words > c3, false) OR coalesce(v.dup_lines > c4, false) OR coalesce(v.repeats > c5, false)) AS kept
        FROM b LEFT JOIN cuts ON b.lang IS NOT DISTINCT FROM cuts.lang
    """.replace("CRC", CRC32.format("doc_id::VARCHAR")),
    "op1_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '</turn>', '\\</turn>', 'g') AS escaped FROM t
        ), g AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                sum(13 + length(role) + length(escaped) + len(list_filter(range(1, length(text) + 1), lambda i: substring(text, i, 3) = '###'))) AS formatted_chars
            FROM e GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, cast(formatted_chars AS BIGINT) AS formatted_chars FROM g
    """,
    "op10_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), w AS (
            SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN w USING (text_sha256)
    """,
}
