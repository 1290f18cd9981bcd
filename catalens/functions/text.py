"""Scalar functions over names, comments, definitions and options, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the server's own quoting rule always quotes.
QUOTED_WORDS = (
    "all analyse analyze and any array as asc asymmetric authorization between bigint binary bit boolean both case cast char character check coalesce collate collation column concurrently constraint create cross "
    "current_catalog current_date current_role current_schema current_time current_timestamp current_user dec decimal default deferrable desc distinct do else end except exists extract false fetch float for foreign "
    "freeze from full grant greatest group grouping having ilike in initially inner inout int integer intersect interval into is isnull join json json_array json_arrayagg json_exists json_object json_objectagg "
    "json_query json_scalar json_serialize json_table json_value lateral leading least left like limit localtime localtimestamp merge_action national natural nchar none normalize not notnull null nullif numeric "
    "offset on only or order out outer overlaps overlay placing position precision primary real references returning right row select session_user setof similar smallint some substring symmetric system_user table "
    "tablesample then time timestamp to trailing treat trim true union unique user using values varchar variadic verbose when where window with xmlattributes xmlconcat xmlelement xmlexists xmlforest xmlnamespaces "
    "xmlparse xmlpi xmlroot xmlserialize xmltable"
).split()

# Names that suggest sensitive content, and comment words that declare it safe.
SENSITIVE_NAME = "password|passwd|pwd|token|secret|mobile|phone|email|id_card|idcard"
SAFE_COMMENT = "脱敏|密文|哈希|加密|hash|encrypt"

# Exclusive upper bounds of row estimates and their labels.
ROW_LABELS = [
    (1, "0"), (100, "<100"), (1_000, "百级"), (10_000, "千级"), (100_000, "万级"), (1_000_000, "十万级"), (10_000_000, "百万级"), (100_000_000, "千万级"), (1_000_000_000, "亿级"),
]
ROW_LABEL_ABOVE = "十亿级+"

# How comments annotate a relationship and an enumeration.
RELATION = r"逻辑关联\s+([A-Za-z0-9_]+\.[A-Za-z0-9_]+\.[A-Za-z0-9_]+)"
ENUM = r"(-?\d+)\s*=\s*([^,;，；/\s)）]+)"
QUALIFIED = r"\b([a-z_][a-z0-9_]*)\.([a-z_][a-z0-9_]*)\b"
TOKEN = r"[a-z_][a-z0-9_]*"

UNICODE = "(?U)"


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer, without regard to case; two empty names are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def local_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def quote_ident(name: Column) -> Column:
    """Bare where the server would leave it bare, else in double quotes."""
    bare = name.rlike("^[a-z_][a-z0-9_]*$") & ~name.isin(*QUOTED_WORDS)
    return F.when(bare, name).otherwise(always_quoted(name))


def always_quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def sql_literal(value: Column) -> Column:
    """A string literal, of the escape form only where there is a backslash."""
    single = F.replace(value, F.lit("'"), F.lit("''"))
    return F.when(F.contains(value, F.lit("\\")), F.concat(F.lit("E'"), F.replace(single, F.lit("\\"), F.lit("\\\\")), F.lit("'"))).otherwise(F.concat(F.lit("'"), single, F.lit("'")))


def comment_lines(text: Column) -> Column:
    """Each line of ``text`` as a line comment, in one string."""
    return F.array_join(F.transform(F.split(text, "\r\n|\r|\n", -1), lambda x: F.rtrim(F.concat(F.lit("-- "), x))), "\n")


def escape_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def escape_meta(value: Column) -> Column:
    """One line: backslash, line feed and carriage return as escapes."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def id_stem(name: Column) -> Column:
    """What comes before ``_id``; null for other names and for ``_id`` alone."""
    return F.when(F.endswith(name, F.lit("_id")) & (F.length(name) > 3), F.substring(name, F.lit(1), F.length(name) - 3))


def relations(comment: Column) -> Column:
    """Three-part names that a comment annotates as logically related."""
    return F.regexp_extract_all(comment, F.lit(UNICODE + RELATION), F.lit(1))


def enum_items(comment: Column) -> Column:
    """array<struct<value, meaning>> of a comment's enumeration."""
    values, meanings = (F.regexp_extract_all(comment, F.lit(UNICODE + ENUM), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(values.alias("value"), meanings.alias("meaning"))


def without_relations(comment: Column) -> Column:
    return F.regexp_replace(comment, UNICODE + RELATION, "")


def qualified_tokens(comment: Column) -> Column:
    first, second = (F.regexp_extract_all(comment, F.lit(UNICODE + QUALIFIED), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(first.alias("schema"), second.alias("table"))


def tokens(comment: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(comment, F.lit(TOKEN), F.lit(0)))


def is_sensitive(name: Column) -> Column:
    return name.rlike(f"(?i){SENSITIVE_NAME}")


def declared_safe(comment: Column) -> Column:
    return F.coalesce(comment.rlike(f"(?i){SAFE_COMMENT}"), F.lit(False))


def sequence_of(default: Column, schema: Column) -> Column:
    """The quoted, qualified sequence of a ``nextval`` default, or null."""
    raw = F.replace(F.regexp_extract(default, r"^nextval\('([^']+)'::regclass\)$", 1), F.lit('"'), F.lit(""))
    at = F.locate(".", raw)
    part = F.when(at > 0, F.concat(quote_ident(F.substring(raw, F.lit(1), at - 1)), F.lit("."), quote_ident(F.substring(raw, at + 1, F.length(raw)))))
    return F.when(raw != "", part.otherwise(F.concat(quote_ident(schema), F.lit("."), quote_ident(raw))))


def trigger_function(definition: Column) -> Column:
    """The function that a trigger calls, as its definition names it, or null.

    The server ends a trigger's definition with the call, so what is called stands between
    the last EXECUTE and the first parenthesis after it; names in quotes are left out.
    """
    call = F.substring_index(F.substring_index(definition, " EXECUTE ", -1), "(", 1)
    name = F.substring_index(call, " ", -1)
    plain = F.forall(F.split(name, "\\."), lambda x: x.rlike(f"^{TOKEN}$")) & (F.size(F.split(name, "\\.")) <= 2)
    return F.when(F.contains(definition, F.lit(" EXECUTE ")) & F.substring_index(call, " ", 1).isin("FUNCTION", "PROCEDURE") & plain, name)


def identifier_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_.]+$") & ~name.rlike(r"^\.+$"), F.lit(False))


def three_segments(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_]+\.[A-Za-z0-9_]+\.[A-Za-z0-9_]+$"), F.lit(False))


def storage_options(options: Column) -> Column:
    """``key='value'`` or a bare key for each option, joined."""
    def one(o):
        key, at = F.substring_index(o, "=", 1), F.locate("=", o)
        return F.when(at > 0, F.concat(key, F.lit("="), sql_literal(F.substring(o, at + 1, F.length(o))))).otherwise(o)

    return F.array_join(F.transform(options, one), ", ")


def wrapper_options(options: Column) -> Column:
    """``key 'value'`` for each option of a foreign table, joined."""
    def one(o):
        at = F.locate("=", o)
        return F.concat(quote_ident(F.substring_index(o, "=", 1)), F.lit(" "), sql_literal(F.substring(o, at + 1, F.length(o))))

    return F.array_join(F.transform(options, one), ", ")


def sha8(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def row_label(estimate: Column) -> Column:
    """The order of magnitude of a row estimate; what is no number, or below zero, counts as 0."""
    n = F.greatest(F.coalesce(F.try_cast(estimate, "double") if hasattr(F, "try_cast") else estimate.cast("double"), F.lit(0.0)), F.lit(0.0))
    out = F.when(n < ROW_LABELS[0][0], ROW_LABELS[0][1])
    for most, label in ROW_LABELS[1:]:
        out = out.when(n < most, label)
    return out.otherwise(ROW_LABEL_ABOVE)


def function_link(from_schema: Column, schema: Column, function: Column) -> Column:
    return F.when(from_schema == schema, F.concat(F.lit("../functions/"), function, F.lit(".sql"))).otherwise(F.concat(F.lit("../../"), schema, F.lit("/functions/"), function, F.lit(".sql")))
