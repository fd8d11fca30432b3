"""Deterministic identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name space of object identifiers of RFC 9562.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = OID_NAMESPACE) -> Column:
    """The version 5 UUID of a name, computed from its SHA-1 inside the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def normal_name(name: Column) -> Column:
    """Lower case without apostrophes."""
    return F.regexp_replace(F.lower(name), "'", "")


def relation_name(name: Column) -> Column:
    """normal_name() with underscores for spaces."""
    return F.replace(normal_name(name), F.lit(" "), F.lit("_"))


def node_id(name: Column) -> Column:
    """The id of a named node."""
    return uuid5(relation_name(name))


def edge_id(name: Column) -> Column:
    """The id of a relation by its name."""
    return uuid5(relation_name(name))


def edge_name(name: Column) -> Column:
    return relation_name(name)


def parsed_id(text: Column) -> Column:
    """A struct of value and is_uuid: UUIDs in lower case with hyphens, other identifiers as they are."""
    plain = F.regexp_replace(F.lower(text), "[{}-]|^urn:uuid:", "")
    is_uuid = F.coalesce(plain.rlike("^[0-9a-f]{32}$"), F.lit(False))
    dashed = F.concat_ws("-", F.substring(plain, 1, 8), F.substring(plain, 9, 4), F.substring(plain, 13, 4), F.substring(plain, 17, 4), F.substring(plain, 21, 12))
    return F.struct(F.when(is_uuid, dashed).otherwise(text).alias("value"), is_uuid.alias("is_uuid"))


def letters(uuid: Column) -> Column:
    """A UUID as 32 letters, one for each of its hexadecimal digits (a for 0 to p for f), for stores whose names allow letters only. Unlike a shortened form it can be turned back."""
    return F.translate(F.regexp_replace(F.lower(uuid), "-", ""), "0123456789abcdef", "abcdefghijklmnop")


def from_letters(name: Column) -> Column:
    """The inverse of letters()."""
    return parsed_id(F.translate(name, "abcdefghijklmnop", "0123456789abcdef"))["value"]


def dataset_id(name: Column, user: Column, tenant: Column) -> Column:
    """The id of a user's dataset, the same whenever it is asked for."""
    return uuid5(F.concat(name, user.cast("string"), F.coalesce(tenant.cast("string"), F.lit(""))))


def valid_dataset_name(name: Column) -> Column:
    """Names without spaces and dots, and not empty."""
    return F.coalesce(name.rlike(r"^[^ .]+$"), F.lit(False))
