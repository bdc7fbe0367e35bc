"""Schemas of the tables that the engine exchanges. They are stated, never inferred."""

from __future__ import annotations

#: Spark DDL.
MANIFEST = "id string, file string, sha256 string, title string, authors array<string>, alt_authors array<string>, year int, venue string, doi string, short_cite string, layout string, open_access boolean, drop_pages array<int>, notes string"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = f"struct<page:int,bbox:{BOX},text:string,font_size:double,is_bold:boolean,kind:string,latex:string>"
PARSED = (
    f"paper_id string, title string, sections array<struct<label:string,heading:string,page_start:int,blocks:array<{BLOCK}>>>, "
    f"tables array<struct<page:int,bbox:{BOX},caption:string,section:string,heading:string,markdown:string,n_rows:int,n_cols:int>>, "
    "references array<string>, data_availability string, page_layouts map<int,string>, backend string, dropped map<string,bigint>"
)
CHUNK = "chunk_id string, paper_id string, seq int, section string, heading string, page_start int, page_end int, kind string, text string, embed_text string, n_tokens int, content_hash string"
GOLD = "id string, type string, question string, answer string, expected_papers array<string>, expected_sections array<string>, must_include array<string>, notes string, paraphrase_of string"
LOG = "ts timestamp, question string, model string, latency_ms int, cited array<int>, input_tokens int, output_tokens int, cost_usd double, refused boolean, error string"
#: What the enumerated columns may hold.
KINDS = ("text", "heading", "caption", "equation", "table", "list", "footnote")
LAYOUTS = ("single_column", "two_column", "preprint", "mixed")
CHUNK_KINDS = ("paper_card", "prose", "table")
