"""Scalar functions of the model as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonblank(value: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def clean(value: Column) -> Column:
    """Trimmed small letters; null as empty."""
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def json_text(json: Column, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def json_pairs(json: Column) -> Column:
    """A JSON object as a map of texts; explode it for one row per key."""
    return F.from_json(json, "map<string,string>")


def json_values(json: Column) -> Column:
    """A JSON object as a map of values that keep their types."""
    return F.from_json(json, "map<string,variant>")


def json_merged(left: Column, right: Column) -> Column:
    """Shallow merge of two JSON objects, the right one wins; values of any type stay as they are."""
    a, b = json_values(left), json_values(right)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b))


def json_with(json: Column, path: str, value: Column) -> Column:
    """The JSON object with the value at a path of keys set, null included; the last key may be new.

    Where a key before the last one is no object the JSON stays as it is; a null JSON counts as empty.
    """
    base, (key, *rest) = F.coalesce(json, F.lit("{}")), path.split(".")
    if not rest:
        return json_merged(base, F.to_json(F.create_map(F.lit(key), value)))
    inner = F.get_json_object(base, f"$.{key}")
    changed = json_merged(base, F.to_json(F.create_map(F.lit(key), F.parse_json(json_with(inner, ".".join(rest), value)))))
    return F.when(F.ltrim(inner).startswith("{"), changed).otherwise(base)


def json_sorted(json: Column) -> Column:
    """A JSON object with the keys of all levels in order; ``{}`` for anything else."""
    parsed = F.try_parse_json(json)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise(F.lit("{}"))


def lenient_bool(value: Column, default: bool) -> Column:
    text = clean(value)
    return F.when(text.isin("true", "1", "yes", "on"), True).when(text.isin("false", "0", "no", "off"), False).otherwise(default)


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next attempt: powers of two up to half an hour."""
    return F.least(F.lit(1800), F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(0)), F.lit(31)))).cast("long")


def two_weeks_from(ts: Column) -> Column:
    """Monday of the odd week of a timestamp's pair of ISO weeks; week 53 stands alone."""
    days = F.pmod(F.weekofyear(ts) - 1, F.lit(2)) * 7
    return F.date_sub(F.trunc(ts, "week"), days.cast("int"))


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)).cast("double") / 1e6


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def template_code(*parts: str) -> Column:
    return F.concat_ws("/", *[F.trim(F.col(p)) for p in parts])


def is_template_code(code: Column, wildcards: bool = False) -> Column:
    """Four segments, none of them blank; a segment may be * only if wildcards are allowed."""
    parts = F.split(F.regexp_replace(F.trim(code), "^/+|/+$", ""), "/")
    good = F.forall(parts, lambda p: (F.trim(p) != "") & (F.lit(wildcards) | (p != "*")))
    return F.coalesce((F.size(parts) == 4) & good, F.lit(False))


def discriminator_of(identity: Column, template_kind: Column) -> Column:
    """Kind of the instances of a template kind."""
    return F.coalesce(nonblank(identity), F.replace(template_kind, F.lit("_template"), F.lit("_instance")))


def child_name(pattern: Column, **values: Column) -> Column:
    """A name pattern with its {placeholders} filled in."""
    for name, value in values.items():
        pattern = F.replace(pattern, F.lit("{" + name + "}"), value.cast("string"))
    return pattern


def sanitized(value: Column) -> Column:
    """Tabs and line ends as spaces, for tab-separated files."""
    return F.translate(F.coalesce(value, F.lit("")), "\t\r\n", "   ")


def statement_kind(sql: Column) -> Column:
    """SELECT, INSERT, UPDATE, DELETE or OTHER."""
    word = F.upper(F.regexp_extract(F.coalesce(sql, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    return F.when(word.isin("SELECT", "INSERT", "UPDATE", "DELETE"), word).otherwise("OTHER")


def table_hint(sql: Column) -> Column:
    """The first table that a statement names, in its first 1200 characters."""
    head, kind = F.left(sql, F.lit(1200)), statement_kind(sql)
    named = lambda words: F.regexp_extract(head, r'(?i)' + words + r'\s+([A-Za-z0-9_".]+)', 1)
    found = F.when(kind == "SELECT", named(r"\bFROM")).when(kind == "INSERT", named(r"\bINTO"))
    found = found.when(kind == "UPDATE", named(r"^\s*UPDATE")).when(kind == "DELETE", named(r"^\s*DELETE\s+FROM"))
    return F.coalesce(F.trim(found.otherwise(""), F.lit('"')), F.lit(""))


def object_link(base: Column, pattern: Column, euid: Column) -> Column:
    """Base url and path pattern with {euid} filled in, one slash between."""
    path = F.replace(pattern, F.lit("{euid}"), euid)
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))


def mermaid_text(value: Column) -> Column:
    """A label that a Mermaid chart can hold."""
    text = F.coalesce(value, F.lit(""))
    for a, b in (('"', "'"), ("[", "("), ("]", ")"), ("{", "("), ("}", ")"), ("<", "("), (">", ")"), ("\n", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def display_zone(zone: Column, known: list[str], default: str = "UTC") -> Column:
    """A time zone of the known ones; the usual names of UTC become UTC, others the default."""
    text = F.trim(F.coalesce(zone, F.lit("")))
    return F.when(F.upper(text).isin("UTC", "GMT", "Z", "ETC/UTC"), "UTC").when(text.isin(*known), text).otherwise(default)


def role_of(role: Column) -> Column:
    """admin or user; anything else is user."""
    return F.when(clean(role) == "admin", "admin").otherwise("user")
