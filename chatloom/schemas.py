"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

LINES = "source_zip string, line_no int, line string"
ARCHIVES = "source_zip string, zip_order int, contact_name string, chat_log string, encoding string, media_files array<string>, detected_format string"
PARSED = (
    "source_zip string, pos int, line_start int, line_end int, timestamp string, sender string, content string, type string, "
    "subtype string, media_file string, is_media_omitted boolean, edited boolean, reply_to string"
)
MESSAGES = (
    "message_id string, seq bigint, timestamp string, sender string, contact string, type string, subtype string, media_file string, "
    "media_processed boolean, reply_to string, edited boolean, source_zip string, line_start int, line_end int, period string"
)
CONTACTS = "contact string, type string, source_zips array<string>, message_count bigint, sanitized_name string, date_format string, encoding string"
MEDIA = "contact string, filename string, status string, type string, source_zip string, stored_name string, transcription string, error string"
RUNS = "archives bigint, failed bigint, added bigint, skipped bigint, upgraded bigint, replaced bigint, warnings bigint, at timestamp"
WARNINGS = "source_zip string, line_no int, warning string"
CONFIG = "split string, layout string, timezone string, self string, aliases map<string,string>"
WORDS = "array<struct<type:string,speaker_id:string,start:double,end:double,text:string>>"
SPEECH = f"text string, language_code string, language_probability double, words {WORDS}"
SCREENSHOT_MESSAGE = (
    "struct<date:string,time:string,sender:string,content:string,media_type:string,media_description:string,message_status:string,"
    "is_forwarded:boolean,is_edited:boolean,is_reply:boolean,reply_preview:string,date_inferred:boolean>"
)
SCREENSHOT = f"chat_name string, chat_type string, participant_count int, visible_date_separators array<string>, screenshot_context string, messages array<{SCREENSHOT_MESSAGE}>"

#: Vocabularies of string columns.
MESSAGE_TYPES = ("text", "media", "system", "deleted")
MEDIA_SUBTYPES = ("audio", "image", "video", "sticker", "contact", "document", "location", "poll")
SYSTEM_SUBTYPES = ("encryption", "call", "admin", "membership", "other")
MEDIA_STATUSES = ("pending", "processed", "failed", "skipped")
SPLITS = ("1w", "2w", "1mo", "3mo", "1y")
LAYOUTS = ("by-period", "by-contact")
