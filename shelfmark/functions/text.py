"""String functions of the name grammar and of matching, as Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import java

#: Latin letters that match as plain ones.
FOLDS = {
    "a": "àáâãäåāăą", "ae": "æ", "c": "çćĉċč", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "ij": "ĳ", "j": "ĵ", "k": "ķĸ", "l": "ĺļľŀł",
    "n": "ñńņňŋ", "o": "òóôõöøōŏő", "oe": "œ", "r": "ŕŗř", "s": "śŝşš", "ss": "ß", "t": "ţťŧ", "th": "þ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
#: Words in file names that say nothing about the document.
NOISE = "scan scanned scans img image photo pic doc document file copy final new untitled download downloads pdf compressed merged page pages attachment unnamed".split()
#: Extracted values that stand for no answer.
PLACEHOLDERS = ["unknown", "unknwon", "none", "n a", "na", "nil", "null", "untitled", "unnamed", "not specified", "not stated", "not provided", "not applicable", "unspecified", "unavailable", "no issuer", "issuer", "tbd", "xxx"]
#: Words that look like a password in a file name.
PASSWORD_WORDS = "pw pwd passwd password passwords passcode passphrase pin pins otp secret secrets".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used; expressions that stand in lambdas are otherwise computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quoted(s: str) -> str:
    """A string as a literal of SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def named(column: str) -> str:
    """A column's name in SQL."""
    return "`" + column.replace("`", "``") + "`"


def let_sql(value: Column, sql: str) -> Column:
    """What SQL text makes of x, a value that is computed once. Large expressions are parsed in one go, where building them call by call would take seconds."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"x -> {sql}")), F.lit(0))


def fresh(rows: DataFrame, name: str) -> str:
    """A name that no column of the rows has."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(rows: DataFrame, *results: str) -> DataFrame:
    """The rows without columns that bear a result's name, which replaces them."""
    return rows.drop(*[c for c in rows.columns if c.lower() in {r.lower() for r in results}])


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns, each computed once a row whatever is made of them later: the optimiser does not copy what a generator gives into each use, nor push filters on it down."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def slug(s: Column) -> Column:
    """Lower-case letters a-z and digits; any other run is one hyphen."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))


def word(s: Column, word_sep: str = "-", field_sep: str = "_") -> Column:
    """One field of a name: white space, slashes and field separators become one word separator."""
    some = "".join(rf"\x{ord(c):02x}" for c in " \t\n_/\\" + field_sep)
    sep = rf"\x{ord(word_sep):02x}" if len(word_sep) == 1 else f"(?:{word_sep})"
    joined = F.regexp_replace(s, f"[{some}]+", word_sep)
    return F.regexp_replace(F.regexp_replace(joined, f"{sep}{{2,}}", word_sep), f"^{sep}+|{sep}+$", "")


def title_case(s: Column) -> Column:
    """Upper-cases the first letter of each part between hyphens, and leaves the rest."""
    return F.array_join(F.transform(F.split(s, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "-")


def normalize_for_match(s: Column) -> Column:
    """Lower-case words of letters and digits, accents folded, single spaces between."""
    one = {c: k for k, v in FOLDS.items() if len(k) == 1 for c in v}
    folded = F.translate(F.lower(s), "".join(one), "".join(one.values()))
    folded = reduce(lambda x, kv: F.replace(x, F.lit(kv[1]), F.lit(kv[0])), [(k, c) for k, v in FOLDS.items() if len(k) > 1 for c in v], folded)
    plain = F.octet_length(s) == F.length(s)  # ASCII has nothing to fold
    return F.trim(F.regexp_replace(F.when(plain, F.lower(s)).otherwise(folded), r"[^\p{L}\p{Nd}]+", " "))


PAD = "  "  # what an empty text becomes


def padded(s: Column) -> Column:
    """Normalised text of which any run of words can be looked for with its edges."""
    return F.concat(F.lit(" "), s, F.lit(" "))


def contains_word(haystack: Column, needle: Column) -> Column:
    """Whether the words of needle stand in haystack, both normalised; never for an empty one."""
    inside = F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))
    return (haystack != "") & (needle != "") & inside


def field_name(s: Column) -> Column:
    """snake_case of letters and digits."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", "_"), F.lit("_"))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda x: x != "")


def dateish(token: Column) -> Column:
    return token.rlike("^([0-9]{1,2}|[0-9]{4}|[0-9]{6}|[0-9]{8})$")


def clean_stem(stem: Column, doctype: Column, owners: Column) -> Column:
    """An identifier out of a file name: without noise, date, doctype and owner words; each word begins upper-case."""
    drop = F.array_union(F.array_union(F.array(*map(F.lit, NOISE)), tokens(normalize_for_match(title_case(doctype)))), F.flatten(F.transform(owners, lambda o: tokens(normalize_for_match(o)))))
    kept = let(drop, lambda d: F.filter(tokens(normalize_for_match(stem)), lambda t: ~F.array_contains(d, t) & ~dateish(t)))
    return F.array_join(F.transform(kept, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))), " ")


def trim_doctype(value: Column, doctype: Column) -> Column:
    """Drops the doctype's words from the end of a value, if all of them stand there."""

    def trimmed(x: Column) -> Column:
        words, phrase = x["words"], x["phrase"]
        n, k = F.size(words), F.size(phrase)
        tail = F.transform(F.slice(words, F.greatest(n - k, F.lit(0)) + 1, F.greatest(k, F.lit(1))), normalize_for_match)
        return F.when((k > 0) & (n >= k) & (tail == phrase), F.array_join(F.slice(words, 1, F.greatest(n - k, F.lit(0))), " ")).otherwise(x["value"])

    return let(F.struct(F.filter(F.split(value, r"\s+"), lambda x: x != "").alias("words"), tokens(normalize_for_match(title_case(doctype))).alias("phrase"), value.alias("value")), trimmed)


def refused(value: Column) -> Column:
    """Whether an extracted value can't be an identifier."""
    return normalize_for_match(value).isin(["", *PLACEHOLDERS])


def password_token(name: Column) -> Column:
    """The first word of a file name's stem that looks like a password, or null."""
    return F.get(F.filter(F.split(stem(name), "[^A-Za-z0-9]+"), lambda w: F.lower(w).isin(PASSWORD_WORDS)), F.lit(0))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    """From the last dot on; empty without one."""
    return F.regexp_extract(name, r"(\.[^./]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"\.[^./]*$", "")


def sidecar_path(path: Column) -> Column:
    """Where the facts about a document are kept: `.name.meta.yaml` beside it."""
    return F.regexp_replace(path, "([^/]+)$", r".$1.meta.yaml")


def is_sidecar(path: Column) -> Column:
    return basename(path).rlike(r"^\..+\.meta\.yaml$")


def document_of(path: Column) -> Column:
    """The document a sidecar belongs to."""
    return F.regexp_replace(path, r"\.([^/]+)\.meta\.yaml$", "$1")


def placeholder_of(path: Column) -> Column:
    """The document that `.name.icloud` stands for, or null."""
    return F.when(basename(path).rlike(r"^\..+\.icloud$"), F.regexp_replace(path, r"\.([^/]+)\.icloud$", "$1"))


def year_in(s: Column) -> Column:
    """The first year from 1900 to 2199 that stands as a word, or null."""
    return F.regexp_extract(s, java(r"\b((?:19|20|21)[0-9]{2})\b"), 1).try_cast("int")


def letters(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\p{L}]", ""))


def usable_text_layer(text: Column, pages: Column) -> Column:
    """Whether a page's own text is worth taking: enough letters and digits a page, mostly letters, and real words."""
    text, pages = F.regexp_replace(text, r"^\s+|\s+$", ""), F.greatest(pages, F.lit(1))
    alpha, digits = letters(text), F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    long = F.size(F.filter(words, lambda w: F.length(w) >= 3))
    enough = (F.floor((alpha + digits) / pages) >= 120) & (alpha / F.greatest(F.length(text), F.lit(1)) >= 0.35)
    return enough & (F.size(words) >= 20) & (long / F.greatest(F.size(words), F.lit(1)) >= 0.4)


def clip(s: Column, limit: int) -> Column:
    """At most `limit` bytes, cut between characters."""
    raw = F.substring(F.encode(s, "UTF-8"), 1, limit)
    whole = F.regexp_replace(F.hex(raw), "(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(F.octet_length(s) <= limit, s).otherwise(F.decode(F.unhex(whole), "UTF-8"))
