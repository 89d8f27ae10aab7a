"""Explicit schemas (DDL) of stored tables and files; nothing is inferred."""

from __future__ import annotations

DOCUMENTS = ("id bigint, title string, publisher string, url string")
CANDIDATES = (
    "id bigint, document_id bigint, suggested_type string, text string, normalized_title string,"
    " source_page int, source_excerpt string, code string, excerpt_on_page boolean,"
    " responsible_org string, timeframe string, deadline_year int, unit string,"
    " target_value double, review_status string")
COMMITMENTS = (
    "id bigint, candidate_id bigint, parent_id bigint, kind string, title string,"
    " summary string, code string, responsible_org string, timeframe string,"
    " deadline_year int, unit string, target_value double, source_page int,"
    " asset_owner_jurisdiction string")
EVIDENCE = (
    "id bigint, commitment_id bigint, url string, title string, publisher string,"
    " published_on date, snippet string, organisations array<string>, locations array<string>,"
    " dates_mentioned array<string>, status_hint string, status_excerpt string, polarity string,"
    " flags array<string>, procurement_ids array<string>, parcels array<string>")
LINKS = (
    "id bigint, commitment_id bigint, evidence_id bigint, score double,"
    " features struct<similarity:double,shared_organisations:array<string>,"
    "shared_locations:array<string>,shared_dates:array<string>>,"
    " suggested_relationship string, reasons array<string>, relationship string,"
    " review_status string")
BUDGETS = (
    "id bigint, evidence_id bigint, kind string, amount_huf bigint, currency string,"
    " amount_native string, amount decimal(38,6), amount_raw string, fiscal_year int,"
    " description string, source_url string")
ARTIFACTS = ("procurement_id string, status string, status_evidence_id bigint")
ARTIFACT_EVIDENCE = ("procurement_id string, evidence_id bigint")
PLACES = ("id bigint, kind string, name string, canonical_name string, district string,"
              " osm_id string, geojson string, source string, confirmed boolean")
SOURCES = ("id bigint, url string, title string, publisher string, sort_order int,"
               " jurisdiction string")
PAGES = ("id bigint, url string, title string, text string, published_on date")
CHUNKS = ("page_id bigint, embed_model string, chunk_index int, text string,"
              " embedding array<float>, lemma_text string")
PROFILES = ("code string, profile string")
NOTES = ("subject_kind string, subject_id bigint, title_en string, summary_en string,"
             " suggestion string, reason_en string, author string")
QRELS = ("query string, doc string, grade int")
GOLD = ("doc string, pdf string, lang string, split string, page int, kind string,"
            " title string, code string, quote string, empty boolean")
SEARCH_RESULTS = ("query_substring string, url string, title string, snippet string")
CORPUS = ("documents array<struct<id:string,text:string,title:string>>,"
              " queries array<struct<id:string,text:string,relevant:array<string>>>")
OVERPASS = (
    "elements array<struct<type:string,id:bigint,tags:map<string,string>,"
    "geometry:array<struct<lat:double,lon:double>>,"
    "members:array<struct<geometry:array<struct<lat:double,lon:double>>>>>>")
