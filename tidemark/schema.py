"""Columns of ledgers and of the tables that describe keywords and merchants."""

from __future__ import annotations

LEDGER = (
    "txn_id string, txn_date_raw string, txn_date date, place string, place_original string, amount decimal(12,2), debits decimal(12,2), "
    "credits decimal(12,2), balance decimal(12,2), statement string, account_id string, is_bank_account boolean, extraction_method string, type string, month string"
)
CATEGORY_KEYWORDS = "cat_order int, category string, kw_order int, keyword string"
KEYWORDS = "ord int, keyword string"
MERCHANT_CACHE = "cache_key string, place string"
LEDGER_CSV = "`Transaction Date` string, Place string, Amount string, Statement string, Classification string, category string"
REVIEW = f"{LEDGER}, category string, classification string, uncategorized boolean"
REVIEW_LOG = f"kind string, at long, {REVIEW}, is_valid boolean"
LEARNED = "category string, keyword string"
