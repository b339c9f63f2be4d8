"""Parameters of a search run, with defaults and validation, and their YAML form."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, fields
from typing import Any

CLUSTER_TYPES = ("all", "pos_vel", "position", "start_position", "mid_position", "start_end_position", "nn_start_end", "nn_start", "grid_start_end", "grid_start")
COADDS = ("sum", "mean", "median", "weighted")


def _default_generator() -> dict[str, Any]:
    return {"name": "EclipticCenteredSearch", "velocities": [92.0, 526.0, 257], "angles": [-math.pi / 15, math.pi / 15, 129], "angle_units": "radian", "velocity_units": "pix / d", "given_ecliptic": None}


@dataclass
class SearchConfig:
    """All parameters of a run. Construction validates; unknown names are refused by ``from_dict``."""

    clip_negative: bool = False
    cluster_eps: float = 20.0
    cluster_type: str = "all"
    cluster_v_scale: float = 1.0
    color_scale: dict[str, float] | None = None
    cnn_filter: bool = False
    cnn_model: str | None = None
    cnn_coadd_type: str = "mean"
    cnn_stamp_radius: int = 49
    cnn_model_type: str = "resnet18"
    coadds: list[str] = field(default_factory=list)
    compute_ra_dec: bool = True
    cpu_only: bool = False
    debug: bool = False
    do_clustering: bool = True
    drop_columns: list[str] = field(default_factory=list)
    encode_num_bytes: int = -1
    generator_config: dict[str, Any] = field(default_factory=_default_generator)
    generate_psi_phi: bool = True
    gpu_filter: bool = False
    lh_level: float = 10.0
    max_masked_pixels: float = 0.5
    max_results: int = 100_000
    near_dup_thresh: int | None = 10
    nightly_coadds: bool = False
    num_obs: int = 10
    peak_offset_max: float | None = None
    pred_line_cluster: bool = False
    pred_line_params: list[float] = field(default_factory=lambda: [4.0, 2, 60])
    psf_val: float = 1.4
    result_filename: str | None = None
    results_per_pixel: int = 8
    save_all_stamps: bool = False
    save_config: bool = True
    separate_col_files: list[str] = field(default_factory=lambda: ["all_stamps"])
    sigmaG_filter: bool = True
    sigmaG_lims: list[float] = field(default_factory=lambda: [25, 75])
    stamp_radius: int = 10
    stamp_type: str = "sum"
    timeout_hours: float | None = None
    track_filtered: bool = False
    x_pixel_bounds: list[int] | None = None
    x_pixel_buffer: int | None = None
    y_pixel_bounds: list[int] | None = None
    y_pixel_buffer: int | None = None

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.cluster_eps > 0, "cluster_eps must be positive")
        need(self.cluster_type in CLUSTER_TYPES, f"cluster_type must be one of {CLUSTER_TYPES}")
        need(self.cluster_v_scale >= 0, "cluster_v_scale must not be negative")
        need(all(c in COADDS for c in self.coadds), f"coadds must be among {COADDS}")
        need(self.encode_num_bytes in (-1, 1, 2, 4), "encode_num_bytes must be -1, 1, 2 or 4")
        need(0 <= self.max_masked_pixels <= 1, "max_masked_pixels must lie in 0 to 1")
        need(self.max_results >= -1, "max_results must be -1 (no limit) or more")
        need(self.num_obs >= 0, "num_obs must not be negative")
        need(self.results_per_pixel > 0, "results_per_pixel must be positive")
        need(self.psf_val > 0, "psf_val must be positive")
        lo, hi = self.sigmaG_lims
        need(0 < lo < hi < 100, "sigmaG_lims must be two percentages in order")
        need(self.stamp_radius > 0 and self.cnn_stamp_radius > 0, "stamp radii must be positive")
        need(self.stamp_type in COADDS, f"stamp_type must be one of {COADDS}")
        need(self.timeout_hours is None or self.timeout_hours > 0, "timeout_hours must be positive")
        need(self.near_dup_thresh is None or self.near_dup_thresh > 0, "near_dup_thresh must be positive")
        for axis in "xy":
            bounds, buffer = getattr(self, f"{axis}_pixel_bounds"), getattr(self, f"{axis}_pixel_buffer")
            need(bounds is None or len(bounds) == 2 and bounds[0] < bounds[1], f"{axis}_pixel_bounds must be two numbers in order")
            need(bounds is None or buffer is None, f"give {axis}_pixel_bounds or {axis}_pixel_buffer, not both")

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> SearchConfig:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown parameters: {unknown}")
        return cls(**values)

    @classmethod
    def from_yaml(cls, text: str) -> SearchConfig:
        import yaml

        return cls.from_dict(yaml.safe_load(text) or {})

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(asdict(self), sort_keys=True)

    def start_bounds(self, axis: str, size: int) -> tuple[int, int]:
        """First start pixel and the one after the last, which may lie outside the image."""
        if bounds := getattr(self, f"{axis}_pixel_bounds"):
            return bounds[0], bounds[1]
        buffer = getattr(self, f"{axis}_pixel_buffer") or 0
        return -buffer, size + buffer
