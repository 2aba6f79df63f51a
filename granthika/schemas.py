"""Column types of the records that the operators read and write."""

from __future__ import annotations

SECTIONS = "array<struct<section_id:string,heading:string,content:string>>"
CONTENT_JSON = f"document_id string, source_type string, url string, title string, language string, metadata string, sections {SECTIONS}, _broken string"
LIVE_RECORD = """record_no long, doc_id string, title string,
    source struct<platform:string,source_type:string,source_url:string,organization:string,author_handle:string,author_name:string>,
    dates struct<published_at:string,retrieved_at:string>, content struct<raw_text:string,clean_text:string>,
    entities struct<hashtags:array<string>,mentions:array<string>,urls:array<struct<url:string,expanded_url:string>>>,
    metadata struct<language:string,authority_level:string,content_hash:string,document_type:string>"""
CLAIM = """query_id long, raw_text string, query string, keywords array<string>, category string, subcategory string, claim_type string,
    is_government_related boolean, is_current_affairs boolean, is_time_sensitive boolean"""
BLOCKS = "array<struct<name:string,text:string,is_table:boolean>>"
# The kinds of source a document can have.
SOURCE_TYPES = ("government_document", "news_article", "web_page", "social_media_post", "report", "other")
# Fixed value: the form of a language tag.
LANGUAGE_TAG = r"^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*\z"
