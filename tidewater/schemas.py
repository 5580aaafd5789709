"""Explicit schemas of the stored tables, as DDL that readers and UDFs take."""

from __future__ import annotations

ARTICLE = (
    "id long not null, title string not null, normalized_title string not null, url string not null, canonical_url string not null, "
    "dedup_key string not null, source string not null, publish_date string, summary string, raw_content string, status string not null, "
    "ai_reason string, last_error string, attempt_count int not null, pipeline_version int not null, created_at timestamp not null, "
    "updated_at timestamp not null, pushed_at timestamp"
)
ARTICLE_V1 = ("id long, title string, url string, source string, publish_date string, summary string, raw_content string, status string, ai_reason string, created_at timestamp, pushed_at timestamp")
EXTRACTION = (
    "article_id long not null, is_award_application boolean not null, award_name string, deadline_text string, deadline_date string, "
    "applicant_scope array<string>, model string, prompt_version string, raw_response string, created_at timestamp, updated_at timestamp"
)
RUN_LOG = (
    "id long not null, run_time timestamp not null, finished_at timestamp, status string not null, duration_seconds double, total_articles int, "
    "new_articles int, keyword_passed int, ai_confirmed int, pushed int, errors array<string>"
)
SOURCE_RUN = (
    "id long not null, run_id long not null, source string not null, source_type string, status string not null, article_count int, new_count int, "
    "duration_seconds double, detail_success int, detail_failed int, error string, created_at timestamp"
)
CRAWL_PAGE = ("source string, page_num int, url string, body string, fetch_error string")
REPLY = (
    "decision boolean, reason string, error_kind string, award_name string, deadline_text string, deadline_date string, applicant_scope array<string>, raw_response string"
)
PIPELINE_VERSION = 2
SCHEMA_VERSION = 3

#: Statuses (fixed values).
STATUSES = (
    "discovered", "keyword_rejected", "ai_pending", "ai_rejected", "ready_to_push", "push_failed", "pushed", "source_superseded",
)
