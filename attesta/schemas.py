"""Explicit schemas and closed vocabularies."""

from __future__ import annotations

#: The closed vocabularies and field names of replies and results: fixed values.
TYPES = ("quote", "numeric", "event", "entity", "definition", "causal", "other")
CONFIDENCES = ("high", "medium", "low")

CLAIM = "struct<id:bigint,fact:string,type:string,confidence:string,verbatim:string>"
REPLY = f"struct<facts:array<{CLAIM}>>"
REPLIES = "doc_id bigint, chunk_no int, pass_no int, content string, thinking string, prompt_n int, predicted_n int, eval_duration_ns bigint, done_reason string"
POSITION = "struct<line:bigint,column:bigint>"
CITED = f"struct<id:bigint,fact:string,type:string,confidence:string,verbatim:string,position:{POSITION}>"
INFERRED = "struct<id:bigint,fact:string,type:string,confidence:string>"
SUMMARY = "struct<total:bigint,verbatim:bigint,inferred:bigint,failed_citations:bigint,unlocated:bigint>"
RESULT = f"struct<summary:{SUMMARY},verbatim_facts:array<{CITED}>,inferred_facts:array<{INFERRED}>>"
GOLD = "struct<source:string,gold:array<struct<verbatim:string,type:string>>>"

#: The schema sent with a request so that a model's reply has this shape and these vocabularies.
REPLY_JSON_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["facts"],
    "properties": {
        "facts": {
            "type": "array",
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["id", "fact", "type", "confidence", "verbatim"],
                "properties": {
                    "id": {"type": "integer"},
                    "fact": {"type": "string"},
                    "type": {"type": "string", "enum": list(TYPES)},
                    "confidence": {"type": "string", "enum": list(CONFIDENCES)},
                    "verbatim": {"type": ["string", "null"]},
                },
            },
        }
    },
}
