"""Names that a deployment may choose, and the limits and thresholds of the catalog's rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CatalogConfig:
    keyword_root: str = "lumicat"
    catalog_dir: str = ".lumicat"
    namespace: str = "lc"
    score_model: str = "aesthetic-v1"
    embedding_model: str = "clip-v1"
    red_label: str = "Red"
    green_label: str = "Green"
    dedup_threshold: float = 0.85
    run_threshold: float = 0.95


DEFAULT = CatalogConfig()

#: Mtimes outside this range of Unix seconds are clamped to it.
MTIME_MIN, MTIME_MAX = 788918400, 4102444800

#: Upper bounds (exclusive) of score tiers, with rating and name; above all: 5.
TIERS = ((4.0, 1, "discard"), (5.5, 2, "poor"), (7.0, 3, "fair"), (8.5, 4, "good"))
TOP_TIER = (5, "excellent")
TIER_NAMES = ("discard", "poor", "fair", "good", "excellent")
SCORE_MIN, SCORE_MAX = 1.0, 10.0

#: LibRaw flip codes and their EXIF orientations.
FLIP_TO_ORIENTATION = {0: 1, 3: 3, 5: 8, 6: 6}

#: Known cameras.
CAMERAS = (("Canon", "EOS R8", "canon-r8"),)

#: Extensions by kind of source.
RASTER_EXTENSIONS = ("jpg", "jpeg", "png")
TESTED_RAW = ("cr3",)
UNTESTED_RAW = ("cr2", "nef", "arw", "raf", "orf", "rw2", "dng")

#: Heights of the two marks (top right, bottom left) as shares of the image's height, and
#: their margin as a share of its short edge.
MARK_HEIGHTS = {"top_right": 0.14, "bottom_left": 0.13}
MARK_MARGIN = 0.046

NAME_MAX_BYTES = 255
WINDOW_BYTES = 64 * 1024
MTIME_SLACK_SECONDS = 2.1
NORM_MIN, NORM_MAX = 0.99, 1.01
DIM_MAX = 65536
