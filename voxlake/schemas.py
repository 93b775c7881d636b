"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

WORD = "struct<text:string,start:double,end:double,confidence:double>"

CALL_METADATA = (
    "sid string, start_time_ms bigint, end_time_ms bigint, "
    "agent struct<metadata:struct<agent_name:string>,speaker_id:int>, "
    "caller struct<metadata:struct<`first and last name`:string>,speaker_id:int>, "
    "labels struct<lhvb_script:double,caller_mos:double,agent_mos:double>, session string"
)

TRANSCRIPT = (
    "call_id string, provider string, "
    f"segments array<struct<speaker:string,start:double,end:double,text:string,words:array<{WORD}>>>, "
    "_corrupt_record string"
)

UTTERANCES = (
    "call_id string, utterances array<struct<channel:string,speaker:string,start:bigint,end:bigint,text:string,"
    "words:array<struct<text:string,start:bigint,end:bigint,confidence:double>>>>"
)

CHANNEL_SEGMENTS = (
    "call_id string, speaker string, segments array<struct<start:double,end:double,text:string,no_speech_prob:double,"
    "words:array<struct<word:string,start:double,end:double,probability:double>>>>"
)

CALLS = (
    "call_id string, customer_id string, customer_name string, agent_id string, agent_name string, "
    "started_at timestamp, call_date date, duration_seconds double, session string, caller_mos double, "
    "audio_path string, transcript_provider string, transcribed_at timestamp"
)

TURNS = (
    "call_id string, turn_index int, speaker string, start_seconds double, end_seconds double, text string, "
    f"words array<{WORD}>, overlapping boolean"
)
