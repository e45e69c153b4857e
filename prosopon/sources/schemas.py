"""Schemas of the tables; nothing is ever inferred."""

SPAN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean>"
BLOCK = f"struct<kind:string,level:int,text:string,spans:array<{SPAN}>,html:string>"
ATTACHMENT = "struct<name:string,extension:string,mime:string,data:binary>"
BLOCKS = f"array<{BLOCK}>"
ATTACHMENTS = f"array<{ATTACHMENT}>"
# One document is one row: its blocks stay together in document order.
DOCUMENTS = f"doc_id string, blocks {BLOCKS}, attachments {ATTACHMENTS}, problem string"

ROLE = "struct<ordinal_text:string,title:string,organisation:string,abbreviation:string,start_year:int,end_year:int>"
ENTRY_FEED = (
    "slug string, first_name string, last_name string, summary string, life string, version string, authors string, "
    "nationality string, roles array<struct<title:string,abbreviation:string,organisation:string>>, content_hash string"
)
STATE = (
    "slug string, record_id bigint, concept_rec_id bigint, concept_doi string, version_doi string, "
    "content_hash string, status string, version string, minted_at timestamp, env string"
)
OUTCOMES = "slug string, ok boolean, record_id bigint, concept_rec_id bigint, concept_doi string, version_doi string, content_hash string, version string, minted_at timestamp, error string"
LINK_STATUS = "href string, method string, http_status int, failed boolean"
DEMONYMS = "ordinal int, country string, form string, demonym string, un_member boolean"
