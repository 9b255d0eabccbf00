"""Explicit schemas of the input and output tables (nothing is inferred)."""

from __future__ import annotations

REQUESTS = (
    "run_id string, jurisdiction string, start_date date, end_date date, "
    "started_at timestamp, topic_groups array<string>"
)
GROUPS = (
    "run_id string, group_ord int, group_id string, group_name string, "
    "keywords array<string>, max_loops int"
)
HITS = (
    "run_id string, group_id string, group_ord int, pass int, rank int, url string, "
    "title string, domain string, source_query string"
)
ALLOWLIST = "run_id string, entry string"
DOMAIN_RULES = "list string, domain string, include_sub_pages boolean, boost_level string"
FETCHED_PAGES = "url string, status int, content_type string, content_length long, body binary"
VERDICT_PAYLOADS = "run_id string, group_id string, pass int, payload string"

# Wire form of a search answer: messages -> contents -> annotations.
CITATIONS_JSON = (
    "array<struct<contents:array<struct<annotations:array<struct<url:string,title:string>>>>>>"
)

VOCABULARY = "id string, doc_type string, name string"
DOCUMENT_STORE = "id string, partition string, payload string, version int"
HISTORY_SNAPSHOTS = (
    "session_id string, checkpoint_id string, parent_checkpoint_id string, "
    "value_json string, seq long"
)
FULL_TEXT = "run_id string, found_on_pass int, group_id string, id string, text string"

HIT_STRUCT = "struct<url:string,title:string,domain:string,source_query:string,rank:int>"
ITEM_STRUCT = (
    "struct<id:string,found_on_pass:int,source_urls:array<string>,domain:string,"
    "full_text_ref:string,verdict:string,eval_rationale:string,unverified:boolean,"
    "publication_date:date,effective_date:date,applies_from:date,applies_to:date,"
    "date_confidence:string>"
)
REVIEW_STRUCT = (
    "struct<thought_process:string,llm_decision:string,final_decision:string,"
    "decision_override:boolean,override_reason:string,"
    f"vetted:array<{ITEM_STRUCT}>,discarded:array<{ITEM_STRUCT}>>"
)
PASS_STRUCT = (
    f"struct<pass:int,query:string,query_rationale:string,hits:array<{HIT_STRUCT}>,"
    f"review:{REVIEW_STRUCT},search_failed:boolean,search_failure_reason:string>"
)
HISTORY_STRUCT = f"struct<passes:array<{PASS_STRUCT}>,processed_keys:array<string>>"

# Header names of the prior-record CSV, in file order, and our column names.
PRIOR_COLUMNS = [
    ("Jurisdiction", "jurisdiction"),
    ("Impact Area", "impact_area"),
    ("Tags", "tags"),
    ("Title of Update", "title_of_update"),
    ("Summary of Update", "summary_of_update"),
    ("Company View", "company_view"),
    ("Level of Authority", "level_of_authority"),
    ("Status of Change", "status_of_change"),
    ("Announcement date", "announcement_date"),
    ("Effective Date of Change", "effective_date_of_change"),
    ("Supporting reference", "supporting_reference"),
    ("Regulator", "regulator"),
]
