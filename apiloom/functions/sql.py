"""Tables named in raw SQL strings, by built-in expressions alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a statement starts with, and names that are no tables.
STATEMENTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "WITH", "CREATE", "ALTER", "DROP", "TRUNCATE")
NO_TABLES = ("select", "set", "values", "lateral", "only", "exists", "not", "if", "and", "or", "on", "where", "as", "the")
SYSTEM_PREFIXES = ("pg_", "information_schema.", "sqlite_", "sys.")

#: What a statement is cut into: literals, comments, quoted names, dotted words, single signs.
_TOKENS = "|".join((r"'[^']*'", r"--[^\r\n]*", r"(?s:/\*.*?\*/)", r'"[^"]+"', r"[A-Za-z_][\p{L}\p{N}_.]*", r"\S"))
_SILENT = r"^('|--|/\*)"
_EMPTY = "array<struct<table:string,op:string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_tables(text: Column) -> Column:
    """array<struct<table, op>> sorted by table; op is read, write or ddl.

    Null and text that is no statement give an empty array. A statement whose first word is not in upper case must hold
    a sign that prose lacks. Literals and comments name nothing; names of common table expressions, functions and system
    tables are dropped. Of several uses of a table the first write or ddl counts, else read.

    The text is cut into tokens once; a use is a verb's token and the name that stands at a fixed distance after it.
    """
    head = F.regexp_extract(text, r"\A\s*\(?\s*([\p{L}\p{N}_]+)", 1)
    is_sql = F.upper(head).isin(*STATEMENTS) & ((head == F.upper(head)) | text.rlike("[%;()=*]"))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), lambda t: F.when(t.rlike(_SILENT), F.lit("''")).otherwise(t))
    both = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.upper(t).alias("word")))
    return F.when(is_sql, _bound(both, lambda t: _bound(_uses(t), _strongest))).otherwise(F.array().cast(_EMPTY))


def _uses(tokens: Column) -> Column:
    """Tables and operations in the order of the text, from array<struct<token, word>>."""
    token = lambda i: F.coalesce(F.get(tokens, i)["token"], F.lit(""))
    word = lambda i: F.coalesce(F.get(tokens, i)["word"], F.lit(""))
    places = F.sequence(F.lit(0), F.size(tokens) - 1)

    def is_named(i: Column) -> Column:
        begins = (word(i) == ",") | (word(i) == "WITH") | ((word(i) == "RECURSIVE") & (word(i - 1) == "WITH"))
        opens = (word(i + 3) == "(") | ((word(i + 3) == "MATERIALIZED") & (word(i + 4) == "(")) | ((word(i + 3) == "NOT") & (word(i + 4) == "MATERIALIZED") & (word(i + 5) == "("))
        return (word(i + 2) == "AS") & begins & opens

    def name_after(i: Column) -> Column:
        """Place of the name that follows a verb, beyond IF EXISTS and IF NOT EXISTS."""
        is_if = (word(i) == "TABLE") & (word(i + 1) == "IF")
        return F.when(is_if & (word(i + 2) == "EXISTS"), i + 3).when(is_if & (word(i + 2) == "NOT") & (word(i + 3) == "EXISTS"), i + 4).otherwise(i + 1)

    def use(i: Column) -> Column:
        op = F.when(word(i) == "TABLE", "ddl").when(word(i).isin("INTO", "UPDATE") | ((word(i) == "FROM") & (word(i - 1) == "DELETE")), "write").otherwise("read")
        is_call = word(i).isin("FROM", "JOIN") & (token(name_after(i) + 1) == "(")
        return F.struct(token(name_after(i)).alias("name"), F.lower(F.replace(token(name_after(i)), F.lit('"'), F.lit(""))).alias("table"), op.alias("op"), is_call.alias("is_call"))

    named = F.transform(F.filter(places, is_named), lambda i: F.lower(token(i + 1)))
    uses = F.transform(F.filter(places, lambda i: word(i).isin("FROM", "JOIN", "INTO", "UPDATE", "TABLE")), use)
    is_table = lambda u, ctes: u["name"].rlike('^["A-Za-z_]') & ~u["is_call"] & ~F.array_contains(ctes, u["table"]) & ~u["table"].isin(*NO_TABLES) & ~F.contains(u["table"], F.lit("?")) & ~_is_system(u["table"])
    return _bound(named, lambda ctes: F.transform(F.filter(uses, lambda u: is_table(u, ctes)), lambda u: F.struct(u["table"].alias("table"), u["op"].alias("op"))))


def _is_system(name: Column) -> Column:
    return reduce(Column.__or__, [F.startswith(name, F.lit(p)) for p in SYSTEM_PREFIXES])


def _strongest(uses: Column) -> Column:
    """Each table once, by name, with its first operation that is no read."""
    of = lambda t: F.get(F.filter(uses, lambda u: (u["table"] == t) & (u["op"] != "read")), F.lit(0))["op"]
    tables = F.array_sort(F.array_distinct(F.transform(uses, lambda u: u["table"])))
    return F.transform(tables, lambda t: F.struct(t.alias("table"), F.coalesce(of(t), F.lit("read")).alias("op")))
