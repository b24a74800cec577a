"""Configuration: dataclasses with the code defaults, optionally filled from YAML files."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from gleaner.functions.dates import DEFAULT_PATTERNS, DatePattern


@dataclass(frozen=True)
class DedupConfig:
    max_distance: int = 6
    window_days: int = 30
    # Declared number of different fingerprints; it sets the length of block keys, never the result.
    expected_fingerprints: int = 65_536


@dataclass(frozen=True)
class QualityConfig:
    blur_percentile: float = 15
    dark_level_max: float = 25
    blown_fraction_max: float = 0.35
    screenshot_ratios: tuple[tuple[float, float], ...] = ((9, 16), (9, 19.5), (3, 4))
    document_edge_min: float = 0.12
    document_saturation_max: float = 0.20
    min_samples: int = 8


@dataclass(frozen=True)
class ScoreConfig:
    quality: float = 1.0
    hero: float = 2.0
    diverse: float = 1.0
    penalty: float = 3.0
    favorite: float = 3.0
    people: float = 1.0
    max_per_day: int = 3
    shortlist_multiplier: float = 2.5
    total_target: int = 200
    peers: int = 20
    near_distance: int = 6
    milestone_dates: tuple[str, ...] = ()


@dataclass(frozen=True)
class Chapter:
    id: str
    start: str
    end: str
    title: str | None = None

    @property
    def label(self) -> str:
        return self.title or self.id


@dataclass(frozen=True)
class ChapterStory:
    """Editorial settings of one chapter."""

    pinned_first: tuple[str, ...] = ()
    page_overrides: dict[str, dict] = field(default_factory=dict)
    source_order: tuple[str, ...] = ()
    event_aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    priority_events: tuple[str, ...] = ()
    priority_tags: tuple[str, ...] = ()
    include_only: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    dedup: DedupConfig = DedupConfig()
    quality: QualityConfig = QualityConfig()
    score: ScoreConfig = ScoreConfig()
    chapters: tuple[Chapter, ...] = ()
    targets: dict[str, int] = field(default_factory=dict)
    priority: dict[str, int] = field(default_factory=dict)
    patterns: tuple[DatePattern, ...] = DEFAULT_PATTERNS
    story: dict[str, ChapterStory] = field(default_factory=dict)

    @property
    def chapter_order(self) -> dict[str, int]:
        return {c.id: i + 1 for i, c in enumerate(self.chapters)}


def _known(kind, values: dict, **renamed: str):
    given = {renamed.get(k, k): v for k, v in (values or {}).items() if v is not None}
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in given.items() if k in names})


def load_config(folder: str | Path) -> Config:
    """Read chapters.yaml, sources.yaml, scoring.yaml and story.yaml where present."""
    import yaml

    def read(name: str) -> dict:
        path = Path(folder) / name
        return (yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path.is_file() else {}

    chapters, sources, scoring, story = (
        read(n) for n in ("chapters.yaml", "sources.yaml", "scoring.yaml", "story.yaml")
    )
    quality = dict(scoring.get("quality") or {})
    if "screenshot_aspect_ratios" in quality:
        quality["screenshot_aspect_ratios"] = tuple(tuple(p) for p in quality["screenshot_aspect_ratios"])
    score_part = dict(scoring.get("score") or {})
    score = _known(ScoreConfig, {**(score_part.get("weights") or {}), **score_part})
    score = replace(score, milestone_dates=tuple(str(d) for d in score.milestone_dates))
    stories = {}
    for chapter, settings in (story.get("chapters") or {}).items():
        s = settings or {}
        stories[chapter] = ChapterStory(
            pinned_first=tuple(s.get("pinned_first") or ()),
            page_overrides={str(k): v for k, v in (s.get("page_overrides") or {}).items()},
            source_order=tuple(s.get("source_order") or ()),
            event_aliases={k: tuple(v or ()) for k, v in (s.get("event_aliases") or {}).items()},
            priority_events=tuple(s.get("priority_events") or ()),
            priority_tags=tuple(s.get("priority_tags") or ()),
            include_only=tuple(s.get("auto_include_only") or ()),
            exclude=tuple(s.get("exclude_from_auto") or ()),
        )
    patterns = tuple(
        DatePattern(p.get("name", ""), p["pattern"], tuple(p.get("groups") or ()))
        for p in sources.get("filename_date_patterns") or ()
    )
    return Config(
        dedup=_known(
            DedupConfig, scoring.get("dedup") or {},
            phash_hamming_max="max_distance", low_confidence_window_days="window_days",
        ),
        quality=_known(
            QualityConfig, quality, dark_luma_max="dark_level_max",
            blown_clip_frac_max="blown_fraction_max", screenshot_aspect_ratios="screenshot_ratios",
            document_min_edge_density="document_edge_min",
            document_max_saturation="document_saturation_max",
        ),
        score=score,
        chapters=tuple(
            sorted(
                (Chapter(c["id"], str(c["start"]), str(c["end"]), c.get("title")) for c in chapters.get("chapters") or ()),
                key=lambda c: c.start,
            )
        ),
        targets={str(k): int(v) for k, v in (chapters.get("targets") or {}).items()},
        priority={str(k): int(v) for k, v in (sources.get("priority") or {}).items()},
        patterns=patterns,
        story=stories,
    )
