"""Schemas of the stored tables."""

from __future__ import annotations

EVIDENCE = "array<struct<type:string,signal:string,source_url:string,source_id:string,strength:string>>"
BREAKDOWN = (
    "struct<business_authenticity:int,commercial_intent:int,online_shop_strength:int,customer_message_potential:int,shop_bot_fit:int,"
    "catalog_complexity:int,activity_recency:int,contactability:int,credibility_scale:int>")
RESULT = "title string, url string, snippet string, query string, provider string"
# Columns of a lead, their types, and what stands for a missing value (SQL).
LEAD_COLUMNS = (
    ("username", "string", None), ("instagram_url", "string", None), ("business_name", "string", None), ("category", "string", None),
    ("city", "string", None), ("country", "string", None), ("bio", "string", None), ("website", "string", None), ("telegram", "string", None),
    ("whatsapp", "string", None), ("followers", "bigint", None), ("business_type", "string", None), ("evidence", EVIDENCE, "array()"),
    ("source_urls", "array<string>", "array()"), ("score", "int", "0"), ("score_breakdown", BREAKDOWN, "zeros"), ("tier", "string", "'REJECT'"),
    ("reason", "array<string>", "array()"), ("provider", "string", "'unknown'"), ("discovered_at", "string", "now"),
    ("iran_verification_status", "string", "'UNCERTAIN'"), ("iran_verification_score", "int", "0"), ("iran_confidence", "int", "0"),
    ("iran_evidence", EVIDENCE, "array()"), ("business_verification_status", "string", "'UNKNOWN'"), ("business_confidence", "int", "0"),
    ("online_shop_verification_status", "string", "'UNKNOWN'"), ("online_shop_confidence", "int", "0"), ("activity_status", "string", "'UNKNOWN'"),
    ("activity_confidence", "int", "0"), ("customer_message_potential", "int", "0"), ("customer_message_confidence", "int", "0"),
    ("shop_bot_fit", "int", "0"), ("shop_bot_fit_confidence", "int", "0"), ("catalog_knownness", "string", "'unknown'"), ("credibility_score", "int", "0"),
    ("evidence_quality_score", "int", "0"), ("overall_confidence", "int", "0"), ("rejection_reason", "string", None), ("verification_warnings", "array<string>", "array()"),
)
LEAD = ", ".join(f"{name} {kind}" for name, kind, _ in LEAD_COLUMNS)
