"""Identifiers: base-32 bodies, check characters, building, parsing and validation, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

# The identifier alphabet, and the digits that Spark writes for base 32.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
TOKEN = "^[0-9A-HJ-KMNP-TV-Z]{1,4}$"
#: Prefixes that stand for a number that isn't settled yet.
RESERVED = ("GX", "TGX")
OWNER = "^[a-z0-9]+([._-][a-z0-9]+)*$"
IDENTIFIER = "^[0-9A-HJ-KMNP-TV-Z]{1,4}-[0-9A-HJ-KMNP-TV-Z]{1,4}-[1-9A-HJ-KMNP-TV-Z][0-9A-HJ-KMNP-TV-Z]*[0-9A-HJ-KMNP-TV-Z]$"


def encode32(number: Column) -> Column:
    """Base-32 body of a positive number; an error for others, null for null."""
    body = F.translate(F.conv(number.cast("string"), 10, 32), DIGITS[10:], ALPHABET[10:])
    return F.when(number.isNull(), F.lit(None)).when(number <= 0, F.raise_error(F.lit("a sequence number must be positive"))).otherwise(body)


def decode32(body: Column) -> Column:
    """The number of a body; null unless it has only letters of the alphabet and is positive."""
    number = F.conv(F.translate(body, ALPHABET[10:], DIGITS[10:]), 32, 10).cast("long")
    return F.when(body.rlike(f"^[{ALPHABET}]+$") & (number > 0), number)


def _total(payload: Column, doubled: int = 0) -> Column:
    """Sum of a payload's values from the right, every other one doubled, the first if ``doubled`` is 0."""
    values = F.transform(F.split(F.reverse(payload), ""), lambda c, i: (F.instr(F.lit(ALPHABET), c) - 1) * F.when(i % 2 == doubled, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, p: a + (p / 32).cast("int") + p % 32)


def _letter(total: Column) -> Column:
    return F.substr(F.lit(ALPHABET), ((32 - total % 32) % 32 + 1).cast("int"), F.lit(1))


def check_character(payload: Column) -> Column:
    """Check character of a payload in the alphabet: from the right, every other value counts twice."""
    return _letter(_total(payload))


def _body_total(number: Column) -> tuple[Column, Column]:
    """The sum over the digits of a body from its number, by shifts alone, and whether the body has an odd length."""
    digits = [F.shiftright(number, 5 * k).bitwiseAND(31) for k in range(13)]
    total = sum((d * 2 - F.shiftright(d, 4) * 31 if k % 2 == 0 else d for k, d in enumerate(digits)), F.lit(0).cast("long"))
    longer = sum(((number >= 32**k).cast("int") for k in range(1, 13)), F.lit(1))
    return total, longer % 2 == 1


def build(domain: Column, prefix: Column, seq: Column) -> Column:
    """DOMAIN-PREFIX-BODY and the check character over the three.

    The body's part of the check is computed from the number; domain and prefix are few letters, whose
    part is folded where they are constants.
    """
    domain, prefix = F.upper(F.trim(domain)), F.upper(F.trim(prefix))
    lead = F.concat(domain, prefix)
    total, odd = _body_total(seq.cast("long"))
    total = total + F.when(odd, _total(lead, 1)).otherwise(_total(lead))
    return F.concat(domain, F.lit("-"), prefix, F.lit("-"), encode32(seq), _letter(total))


def parse(euid: Column) -> Column:
    """Struct of domain, prefix, seq and check; fields are null unless there are exactly three parts."""
    parts = F.split(euid, "-")
    three = F.size(parts) == 3
    last = F.get(parts, F.lit(2))
    return F.struct(
        F.when(three, F.get(parts, F.lit(0))).alias("domain"),
        F.when(three, F.get(parts, F.lit(1))).alias("prefix"),
        F.when(three, decode32(F.substr(last, F.lit(1), F.length(last) - 1))).alias("seq"),
        F.when(three, F.right(last, F.lit(1))).alias("check"),
    )


def is_valid(euid: Column, allowed_domains: list[str] | None = None) -> Column:
    """Whether an identifier is well-formed (case counts), its check character right and its domain allowed."""
    parts = F.split(euid, "-")
    last = F.get(parts, F.lit(2))
    payload = F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.substr(last, F.lit(1), F.length(last) - 1))
    good = euid.rlike(IDENTIFIER) & (check_character(payload) == F.right(last, F.lit(1)))
    if allowed_domains is not None:
        good = good & F.get(parts, F.lit(0)).isin(*allowed_domains)
    return F.coalesce(good, F.lit(False))


def is_token(value: Column) -> Column:
    return F.coalesce(value.rlike(TOKEN), F.lit(False))


def is_owner(value: Column) -> Column:
    return F.coalesce(value.rlike(OWNER), F.lit(False))


def normal_token(value: Column) -> Column:
    """Upper-case token; null for blank; an error for other texts."""
    upper = F.upper(F.trim(value))
    return F.when(F.coalesce(upper, F.lit("")) == "", F.lit(None)).when(upper.rlike(TOKEN), upper).otherwise(F.raise_error(F.lit("not a token")))


def next_sequences(*tables: DataFrame) -> DataFrame:
    """prefix, next_seq over the (euid_prefix, euid_seq) of all tables."""
    every = tables[0].select("euid_prefix", "euid_seq")
    for t in tables[1:]:
        every = every.unionByName(t.select("euid_prefix", "euid_seq"))
    return every.groupBy(F.col("euid_prefix").alias("prefix")).agg((F.max("euid_seq") + 1).alias("next_seq"))


def never_backwards(sequences: DataFrame, state: DataFrame) -> DataFrame:
    """prefix, next_seq: the greater of what the tables need and what the sequence's state has."""
    joined = sequences.alias("n").join(state.alias("s"), "prefix", "full_outer")
    return joined.select("prefix", F.greatest("n.next_seq", "s.next_seq").alias("next_seq"))


def assign(rows: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Gives rows of domain_code and euid_prefix the next sequence numbers of their prefix and their
    identifiers; ``existing`` has prefix and next_seq. Rows of a prefix are numbered in ``order``.

    Rows that bring an identifier in ``euid`` keep it, if it is valid and of their domain and prefix;
    else it is an error, as are reserved prefixes. Where a prefix has given identifiers, new ones go on
    behind the greatest of them.
    """
    if "euid" not in rows.columns:
        rows = rows.withColumn("euid", F.lit(None).cast("string"))
    reserved = F.when(F.upper(F.trim("euid_prefix")).isin(*RESERVED), F.raise_error(F.lit("a reserved prefix"))).otherwise(F.col("euid_prefix"))
    given = parse(F.col("euid"))
    right = is_valid(F.col("euid")) & (given["domain"] == F.upper(F.trim("domain_code"))) & (given["prefix"] == F.upper(F.trim("euid_prefix")))
    rows = rows.withColumn("euid_prefix", reserved).withColumn("_given", F.when(F.col("euid").isNull(), F.lit(None)).when(right, given["seq"]).otherwise(F.raise_error(F.lit("not an identifier of this domain and prefix"))))
    highest = rows.where("_given is not null").groupBy(F.col("euid_prefix").alias("_of")).agg((F.max("_given") + 1).alias("_after"))
    fresh = rows.where("euid is null").drop("_given")
    base = F.greatest(F.coalesce("next_seq", F.lit(1)), F.coalesce("_after", F.lit(1)))
    joined = numbered(fresh, "_n", [F.col(c) for c in order], ["euid_prefix"]).join(existing, F.col("euid_prefix") == F.col("prefix"), "left").join(highest, F.col("euid_prefix") == F.col("_of"), "left")
    joined = joined.withColumn("euid_seq", (base + F.col("_n") - 1).cast("long")).drop("_n", "prefix", "next_seq", "_of", "_after")
    joined = joined.withColumn("euid", build(F.col("domain_code"), F.col("euid_prefix"), F.col("euid_seq")))
    return joined.unionByName(rows.where("euid is not null").withColumnRenamed("_given", "euid_seq"))


def prefix_kind(prefix: Column, templates: DataFrame) -> DataFrame:
    """prefix, discriminator for prefixes that exactly one template kind uses."""
    kinds = templates.groupBy(F.col("instance_prefix").alias("prefix")).agg(F.collect_set("polymorphic_discriminator").alias("kinds"))
    return kinds.where(F.size("kinds") == 1).select("prefix", F.col("kinds")[0].alias("discriminator"))
