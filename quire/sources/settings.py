"""Settings with their defaults, from the environment or a mapping."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    ocr_min_score: float = 0.35
    pdf_dpi: int = 220
    chunk_size: int = 900
    chunk_overlap: int = 120
    top_k: int = 5
    per_document: int = 3

    @classmethod
    def load(cls, source: Mapping[str, str] | None = None) -> Settings:
        source = os.environ if source is None else source
        found = {f.name: type(f.default)(source[f.name.upper()]) for f in fields(cls) if f.name.upper() in source}
        return cls(**found)
