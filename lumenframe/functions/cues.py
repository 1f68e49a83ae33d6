"""Patterns and cue words of the query language, for Python and for the JVM (fixed values)."""

from __future__ import annotations

CONNECTIVES = r"\b(?:sau đó|tiếp theo|cuối cùng|then|next|finally)\b"
BREAK = r"\r?\n+|(?<=[.!?;])\s+|" + CONNECTIVES
SENTENCE_END = r"(?<=[.!?])\s+|\r?\n+"
QUOTED = r"[\"“”']([^\"“”']{2,100})[\"“”']"
EVENT_MARK = r"^\s*E\d+\s*[:.\-]?"
SPOKEN = r"\b(?:nói|hỏi|trả lời|phát biểu|lời thoại|nghe thấy|say|says|said|asks?|speaks?|spoken|dialogue|quote)\b"
VISIBLE = (
    r"\b(?:dòng chữ|con số|số được ghi|ghi trên|đọc được|hiển thị (?:số|chữ)|biển báo|hiển thị|biển hiệu|bảng chữ|logo|phụ đề|tiêu đề|viết|"
    r"text|sign|banner|subtitle|title|written|displayed|on-screen)\b"
)
DISPLAYED = r"(?:thông tin\s+(?:về\s+)?)?((?:giá|mã|tên|số|chữ|dòng chữ)\b.{0,80}?)(?:\s+được)?\s+hiển thị\b"
GENERIC = ("con số", "số", "chữ", "dòng chữ")
COUNTED = r"\b(?:\d+|một|hai|ba|bốn|năm|sáu|bảy|tám|chín|ten|one|two|three|four|five|six|seven|eight|nine)\s+(?:ký tự|chữ|characters?|letters?|words?)\b"
VALUES = (
    ("number", r"\b(?:bao nhiêu|số mấy|con số|mã số|number|how many|what number)\b"),
    ("color", r"\b(?:màu gì|màu nào|what colou?r)\b"),
    ("person", r"\b(?:ai|người nào|who)\b"),
    ("place", r"\b(?:ở đâu|nơi nào|where)\b"),
)
MOST_SCENES = 8
#: A clock face, and a broadcaster's mark as its letters and digits.
CLOCK = r"\d{1,2}\s*[:.]\s*\d{2}(?:\s*[:.]\s*\d{2})?"
LOOSE_CLOCK = r"\d{1,2}\s*[:.]\s*\d{1,2}(?:\s*[:.]\s*\d{1,2})?"
BROADCASTER = r"(?:(?:htv|vtv|tv|vtc)\d*(?:hd)?\d*|hd|hdtv)"
