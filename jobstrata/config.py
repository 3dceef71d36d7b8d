"""Every threshold, size and weight of the report, in one immutable object."""

from dataclasses import dataclass, field, replace

from jobstrata import vocab

FLAGS = ("gender_marker", "is_internship", "remote_hint", "part_time_hint")
DIMENSIONS = ("job_category", "seniority", "location_extracted", "company_extracted")


@dataclass(frozen=True)
class Period:
    name: str
    label: str
    start: int
    end: int


@dataclass(frozen=True)
class Settings:
    periods: tuple = field(default_factory=lambda: tuple(Period(*p) for p in vocab.PERIODS))
    baseline_years: tuple = (2015, 2019)
    sparse_year: int = 200
    sparse_period: int = 300
    min_flag_positives: int = 30
    min_located_per_year: int = 30
    min_ads_per_place: int = 20
    min_places_per_year: int = 3
    min_companies_per_year: int = 2
    focus_places: tuple = ("Lisboa", "Porto")
    place_noise: tuple = tuple(vocab.PLACE_NAMES_AS_COMPANY)
    stopwords: tuple = tuple(vocab.STOPWORDS)
    senior_levels: tuple = tuple(vocab.SENIOR_PLUS)
    dominant_seniority: str = vocab.SENIORITY_DEFAULT
    adjusted_flag: str = "gender_marker"
    suppressed_flag: str = "remote_hint"
    vulnerability_weights: tuple = (3.0, 1.0, -2.0)
    annotation_threshold: float = 0.75
    category_threshold: float = 0.65
    fallback_category: str = vocab.FALLBACK_CATEGORY
    volume_midpoint: float = 800.0
    volume_slope: float = 0.004
    emergence_candidates: int = 300
    movers: int = 8

    def with_(self, **changes):
        return replace(self, **changes)


DEFAULTS = Settings()
