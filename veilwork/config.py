"""Thresholds of the engine. One frozen value, so that a plan can be read without looking for settings elsewhere."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    header_lines: int = 10
    top_lines: int = 25
    docx_header_paragraphs: int = 8
    residue_chars: int = 100
    residue_words: int = 3
    residue_passes: int = 4
    address_chars: int = 80
    box_inset: float = 0.2
    underline_band: float = 4.0
    ocr_pad_share: float = 0.06
    ocr_pad_pixels: float = 10.0
    ocr_header_share: float = 0.22
    ocr_snap_chars: int = 2
    photo_side: int = 150
    photo_ratio_low: float = 0.5
    photo_ratio_high: float = 2.0
    photo_page_share: float = 0.8
    lost_line_chars: int = 45
    header_preview: int = 14
    images_shown: int = 24
    stream_bytes: int = 200_000
    max_upload_mb: int = 25
    max_files: int = 200


DEFAULT = Config()
