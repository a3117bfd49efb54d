"""Thresholds of the rules, as plain frozen dataclasses.

Every rule takes the thresholds it needs from here, so a job can be tuned by
passing another instance instead of editing code.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class GateConfig:
    min_chars_signal_rich: int = 40
    min_chars_media: int = 60
    min_chars_general: int = 80
    allow_short_pasted_text: bool = True


@dataclass(frozen=True)
class MediaConfig:
    enabled: bool = True
    require_speech_track: bool = True
    require_visual_track: bool = False
    min_text_chars: int = 180
    max_evidence_chars: int = 12000
    max_evidence_lines: int = 220
    subtitle_short_chars: int = 280
    default_duration_minutes: float = 10.0
    recovery_min_char_gain: int = 120


@dataclass(frozen=True)
class CostConfig:
    asr_usd_per_min: float = 0.006
    input_usd_per_million: float = 0.15
    output_usd_per_million: float = 0.60
    expected_output_tokens: int = 900
    usd_cny: float = 7.2
    budget_rmb: float = 0.5


@dataclass(frozen=True)
class CacheConfig:
    enabled: bool = True
    ttl_hours: int = 72
    for_dry_run: bool = True
    for_live_run: bool = True


@dataclass(frozen=True)
class RoutingConfig:
    enabled: bool = False
    low_quality_threshold: float = 0.72
    min_signal_coverage: float = 0.60


@dataclass(frozen=True)
class OcrConfig:
    hosts: tuple[str, ...] = ("xiaohongshu.com", "weixin.qq.com", "mp.weixin.qq.com")
    reliable_hosts: tuple[str, ...] = ("github.com/",)
    min_chars_url: int = 280
    min_chars_mixed: int = 900


@dataclass(frozen=True)
class PageLimits:
    #: None keeps everything; what is shown of a document is a matter of its text form.
    max_images: int | None = None
    max_videos: int | None = None
    max_tables: int | None = None
    fallback_section_chars: int | None = None


@dataclass(frozen=True)
class EngineConfig:
    gate: GateConfig = field(default_factory=GateConfig)
    media: MediaConfig = field(default_factory=MediaConfig)
    cost: CostConfig = field(default_factory=CostConfig)
    cache: CacheConfig = field(default_factory=CacheConfig)
    routing: RoutingConfig = field(default_factory=RoutingConfig)
    ocr: OcrConfig = field(default_factory=OcrConfig)
    pages: PageLimits = field(default_factory=PageLimits)
