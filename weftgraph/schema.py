"""Schemas of the tables that stages exchange.

Files are always read with one of these: inferring would turn dynamic infobox keys into columns.
"""

from __future__ import annotations

RAW_PAGE = "page_id long, title string, wikitext string"
SEED_PAGE = "page_id long, title string, infobox map<string,string>, links array<string>"
NODE = "page_id long, title string, infobox map<string,string>"
ENRICHED_NODE = NODE + ", summary string"
LABELLED_NODE = "title string, label string, page_id long, infobox map<string,string>"
EDGE = "source string, target string, type string"
EVIDENCE_EDGE = EDGE + ", evidence string"
ARTICLE = "title string, page_id long, text string, source string"
WIKITEXT_ARTICLE = "title string, page_id long, wikitext string, source string"
QA_ITEM = "question string, expected_answer string"
ROUTE = "intent string, keyword string, hops int"
EDGE_KEY = ["source", "target", "type"]
GENERIC = "LIÊN_KẾT_TỚI"
