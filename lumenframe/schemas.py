"""Schemas of the domain's tables. Every read states its schema; nothing is inferred."""

from __future__ import annotations

FRAMES = "video_id string, local_idx int, frame_id int, pts_time double, shot_id string, window_id string, keyframe_uid long"
INVENTORY = "video_id string, relative_path string, width int, height int, fps double, duration double, frame_count long, has_audio boolean"
SHOTS = "shot_id string, start_frame long, end_frame long"
REGION = "region_id string, bbox_px array<double>, bbox_normalized array<double>, easyocr_text string, easyocr_confidence double, has_vi_marks boolean, has_ascii_word boolean, final_text string, final_confidence double, final_engine string, gemini_residual boolean, reasons array<string>"
OCR_FRAMES = f"video_id string, shot_id string, local_idx int, keyframe_uid long, frame_id int, status string, regions array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in REGION.split(', '))}>>"
ENVELOPE = "batch_id string, video_id string, keyframe_uid long, frame_id int, source_image string, execution_mode string, status string, engine string, fallback_used boolean, result struct<detected_text:array<string>,bbox:array<array<double>>,language:string,confidence:double>, attempts array<struct<engine:string,outcome:string,error_code:string>>"
SNAPSHOT = "video_id string, keyframe_uid long, frame_id int, status string, engine string, detected_text string, language string, confidence double"
VECTORS = "keyframe_uid long, vector array<float>"
SUBMISSION = {"KIS": ["video_id", "frame_id"], "QA": ["video_id", "frame_id", "answer"], "TRAKE": ["video_id", "frame_ids"]}
