"""Explicit schemas of the input tables (nothing is inferred)."""

from __future__ import annotations

METADATA = "accession_number long, cik long, fiscal_year int, ticker string, filing_date string"
DOCUMENT = (
    "accession_number string, cik long, year int, text string, item_type string, text_length int, filing_date date"
)
SENTENCE = (
    "accession_number string, cik long, ticker string, year int, filing_date date, item_type string, "
    "sentence_id int, text string, sentence_length int"
)
TICKER_MAP = "map<string, struct<cik_str: long, ticker: string, title: string>>"
RECENT_FILINGS = "struct<accessionNumber: array<string>, filingDate: array<string>, form: array<string>>"
ENCODER_MODEL = "M int, k int, replica int, neuron int, w_enc array<double>, b double, w_dec array<double>"
