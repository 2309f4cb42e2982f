"""Replies of a model: strict checking, and their use as an optional lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS, LISTS, NUMBERS, CLAIMS = ("businessName", "businessType", "city"), ("reasons", "warnings"), ("shopBotFit", "credibility"), "inventedClaims"


def _kind(variant: Column, key: str) -> Column:
    """Type of a member, so that "70" is not taken for 70; null if there is no member."""
    return F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant"))


def parsed_reply(raw: Column | str) -> Column:
    """The reply as a struct, or null unless it fits the schema and claims nothing invented.

    A member that is missing is an error, one that is null is not: the type of a missing member is
    null, that of a null member is VOID.
    """
    text = F.col(raw) if isinstance(raw, str) else raw
    # Parsed once, as the only element of an array.
    return F.try_element_at(F.transform(F.array(F.try_parse_json(text)), _checked), F.lit(1))


def _checked(v: Column) -> Column:
    ok = F.schema_of_variant(v).startswith("OBJECT")
    for key in TEXTS:
        ok = ok & _kind(v, key).isin("STRING", "VOID")
    strings = lambda key: F.try_variant_get(v, f"$.{key}", "array<string>")
    for key in LISTS:
        ok = ok & _kind(v, key).isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(strings(key)) <= 12) & ~F.exists(strings(key), lambda s: s.isNull())
    number = lambda key: F.try_variant_get(v, f"$.{key}", "double")
    for key in NUMBERS:
        ok = ok & _kind(v, key).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)") & number(key).between(0, 100)
    claims = _kind(v, CLAIMS)
    ok = ok & (claims.isNull() | (claims.rlike("^ARRAY<") & (F.size(strings(CLAIMS)) == 0)))
    value = F.struct(
        *[F.try_variant_get(v, f"$.{k}", "string").alias(n) for k, n in zip(TEXTS, ("business_name", "business_type", "city"), strict=True)],
        *[strings(k).alias(k) for k in LISTS], number(NUMBERS[0]).alias("shop_bot_fit"), number(NUMBERS[1]).alias("credibility"))
    return F.when(F.coalesce(ok, F.lit(False)), value)


def enriched(leads: DataFrame, replies: DataFrame, on: str) -> DataFrame:
    """Leads with the values of their reply, if there is a valid one; the lead's own value otherwise.

    ``replies`` has (on, raw), one row a lead.
    """
    good = replies.select(on, parsed_reply("raw").alias("r")).where("r is not null")
    return leads.join(good, on, "left").select(
        *[c for c in leads.columns if c not in ("business_name", "business_type", "shop_bot_fit", "reason", "verification_warnings")],
        F.coalesce("r.business_name", "business_name").alias("business_name"), F.coalesce("r.business_type", "business_type").alias("business_type"),
        F.greatest("shop_bot_fit", F.coalesce("r.shop_bot_fit", F.lit(0.0))).alias("shop_bot_fit"),
        F.concat("reason", F.slice(F.filter(F.coalesce("r.reasons", F.array().cast("array<string>")), lambda s: s != ""), 1, 4)).alias("reason"),
        F.concat("verification_warnings", F.coalesce("r.warnings", F.array().cast("array<string>"))).alias("verification_warnings"))
