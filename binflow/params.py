"""Typed options of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Feature groups and the names of the per-bin features.
FEATURE_GROUPS: dict[str, tuple[str, ...]] = {
    "spatial_stats": ("mean_x", "mean_y", "std_x", "std_y", "median_x", "median_y", "iqr_x", "iqr_y"),
    "distribution_shape": ("ratio_spread", "core_fraction"),
    "clipping_detection": ("duplicate_fraction", "max_duplicate_fraction"),
    "histogram_uniformity": ("cv_x", "cv_y"),
    "statistical_moments": ("skew_x", "skew_y", "kurt_x", "kurt_y"),
    "pca_orientation": ("angle", "eigen_ratio"),
    "edge_features": (
        "left_edge_fraction",
        "right_edge_fraction",
        "top_edge_fraction",
        "bottom_edge_fraction",
        "total_edge_fraction",
    ),
    "temporal": ("t_y_var",),
    "trigger_stats": ("roi_trigger_fraction",),
}
FEATURE_NAMES: tuple[str, ...] = tuple(name for names in FEATURE_GROUPS.values() for name in names)

# Suffixes taken as images; any other media file is taken as video.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp")


def enabled_features(switches: dict[str, dict[str, bool]] | None = None) -> list[str]:
    """Features left on by ``{group: {name: bool}}``; an absent key means on."""
    switches = switches or {}
    return [
        name
        for group, names in FEATURE_GROUPS.items()
        for name in names
        if switches.get(group, {}).get(name, True)
    ]


# The defaults of the classes below that are given (aspect ratio,
# contamination, detection limits); margin, window, cells and trees are our own.


@dataclass(frozen=True)
class FlowParams:
    """Geometry and sizes behind the per-bin features."""

    aspect_ratio: float = 1.36
    edge_margin: float = 0.05
    window: int = 10
    cells: int = 10


@dataclass(frozen=True)
class ForestParams:
    """Isolation forest options. ``max_samples``: "auto", a count or a share."""

    contamination: float = 0.1
    max_samples: int | float | str = "auto"
    max_features: int | float = 1.0
    trees: int = 100
    seed: int = 0

    def sample_size(self, rows: int) -> int:
        if self.max_samples == "auto":
            return min(256, rows)
        if isinstance(self.max_samples, int):
            return min(self.max_samples, rows)
        return min(max(1, int(float(self.max_samples) * rows)), rows)

    def feature_count(self, available: int) -> int:
        if isinstance(self.max_features, int):
            return min(self.max_features, available)
        return max(1, int(self.max_features * available))


@dataclass(frozen=True)
class ValueRange:
    """Values to try: a list, or ``steps`` evenly spaced values from ``low`` to ``high``."""

    values: tuple[float, ...] | None = None
    low: float | None = None
    high: float | None = None
    steps: int | None = None


@dataclass(frozen=True)
class DetectParams:
    """Detection post-processing options."""

    conf: float = 0.1
    iou: float = 0.5
    agnostic: bool = True
    classes: tuple[int, ...] | None = None
    max_det: int = 300
    vid_stride: int = 1


@dataclass(frozen=True)
class KeyNames:
    """Key columns of the predicted and the ground-truth feature tables."""

    pred_sample: str = "sample_id"
    gt_sample: str = "ifcb_bin"
    pred_roi: str = "roi_number"
    gt_roi: str = "roi_number"
