"""Logical tables as DDL column lists (usable as read schemas and inside ``struct<...>``)."""

from __future__ import annotations

CHAIN_DDL = "struct<items:array<string>,count:int,is_ordered:boolean,category:string>"

#: Structured records; both key spellings are read and reconciled later.
RECORDS = (
    f"suttaid string, sutta_id string, sutta string, commentary string, commentry string,"
    f" commentary_id string, chain {CHAIN_DDL}"
)
ITEMS = (
    f"book string, suttaid string, sutta string, commentry string, commentary_id string, chain {CHAIN_DDL}"
)
DOCS = ("rec_i bigint, kind string, suttaid string, commentary_id string, text string")
CHUNKS = (
    "id string, source string, conversation_id string, suttaid string, commentary_id string, kind string,"
    " chunk_index int, global_chunk_index bigint, text string, embedding array<float>"
)
BUNDLE_CHUNK_DDL = (
    "struct<book:string,kind:string,suttaid:string,commentary_id:string,source:string,text:string,"
    "embedding:array<double>>"
)
BUNDLE = (f"format string, embedding_model string, chunks array<{BUNDLE_CHUNK_DDL}>")
SHARD = (f"format string, book string, embedding_model string, chunks array<{BUNDLE_CHUNK_DDL}>")
MANIFEST = (
    "format string, version int, embedding_model string,"
    " shards array<struct<book:string,uri:string,chunk_count:bigint>>"
)
SEGMENTS = (
    "transcript_id string, canon_id string, book int, transcript_content string, canon_content string"
)
CANON_CORPUS = ("canon_id string, canon_content string")
CANON_SNAPSHOT = ("keys_order array<string>, translation_text map<string,string>")
TEACHER_ROWS = ("teacher_id string, book int, text string")
MAPPING_RESULTS = (
    "teacher_id string, unit_id string, book int, raw_unit_text string, best_canon_ids array<string>,"
    " primary_canon_id string, confidence double, is_mixed boolean, needs_review boolean,"
    " evidence_phrases array<string>, reason string, match_type string, status string"
)
MESSAGE_DDL = "struct<role:string,content:string>"
CHAT = (
    f"source string, conversation_id string, title string, created_at string, path string,"
    f" messages array<{MESSAGE_DDL}>"
)
CHAT_EXPORT = (
    "conversations array<struct<conversation:struct<id:string,title:string,create_time:string>,"
    "responses:array<struct<response:struct<sender:string,message:string,create_time:string>>>>>"
)
AGENT_LINE = ("role string, message struct<content:array<struct<type:string,text:string>>>")
TURNS = ("conversation_id string, ts bigint, q string, a string, latency_ms bigint")
TURN_LINE = ("ts bigint, q string, a string, latency_ms bigint")
CONVERSATION_INDEX = ("id string, title string, updated_ts bigint")
FEEDBACK = (
    "sessionId string, runId string, hypothesisId string, location string, message string,"
    " data struct<message_id:string,rating:int,sources:array<string>>, timestamp bigint"
)
HITS = (
    "source string, suttaid string, commentary_id string, kind string, book string, distance double, text string"
)
