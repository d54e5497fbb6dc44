"""Schemas of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = "page_id bigint, url string, html string"

ELEMENT_FIELDS = (
    "pos int, end_pos int, tag string, attrs map<string,string>, text string, "
    "text_stripped string, scopes array<struct<container:string,pos:int>>"
)

# Rows that links are made from. Texts are stretches of bytes of their page's text (of headings: of the
# text without blanks at the ends of its parts), which is in one row of the page.
LINK_ROW_FIELDS = (
    "pos int, tag string, attrs map<string,string>, span struct<first:int,last:int>, "
    "scopes array<struct<container:string,pos:int>>, headings array<struct<first:int,last:int>>, "
    "page_text binary, page_stripped binary"
)

LINK_ITEM = (
    "page_id bigint, link_pos int, seq decimal(38,0), href string, keyword string, text string, "
    "title string, aria_label string, rel string, "
    "context struct<previous_text:string,next_text:string,heading_hierarchy:array<string>>, "
    "metadata struct<title:string,description:string>, source_url string, processed_text string"
)

ANALYSIS = "struct<keyword:string,source_url:string,href_url:string,score:double>"

SCORED_ITEM = LINK_ITEM + f", relevance_analysis {ANALYSIS}"

CATALOG = (
    "id string, keyword string, source_url string, href_url string, relevance_score double, "
    "raw_data string, processed_date timestamp"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
