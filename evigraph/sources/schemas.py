"""Schemas of rows that are read from outside."""

OPENALEX = (
    "id string, title string, abstract_inverted_index map<string,array<int>>, publication_date string, cited_by_count int, type string, authorships array<struct<author:struct<display_name:string>>>,"
    " primary_location struct<is_oa:boolean,landing_page_url:string,source:struct<type:string>>, concepts array<struct<display_name:string>>, doi string, is_oa boolean"
)
SEMANTIC_SCHOLAR = (
    "paperId string, title string, abstract string, year int, citationCount int, influentialCitationCount int, authors array<struct<name:string>>, externalIds map<string,string>, url string,"
    " publicationDate string, tldr struct<text:string>, embedding struct<model:string,vector:array<float>>"
)
GITHUB = "full_name string, description string, html_url string, stargazers_count int, language string, topics array<string>, pushed_at string, owner struct<login:string>"
WEB = "url string, title string, content string, published_date string, score double"
ATOM = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, primary_category struct<_term:string>"
RESPONSE = (
    "assertions array<struct<text:string,conditions:string,polarity:string>>, entities array<struct<name:string,entity_type:string,description:string>>,"
    " relationships array<struct<source_name:string,target_name:string,relationship_type:string>>"
)
VERDICT = "classification string, reasoning string, conditions_for_claim_a string, conditions_for_claim_b string"
