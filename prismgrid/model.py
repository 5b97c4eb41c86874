"""Schemas, enumerations and settings.

A raster is a table of pixels: img_id, y, x, the signal f and the guide g, both arrays with
one element a channel. (img_id, y, x) is unique, and every image is a full rectangle from
(0, 0). Operators take any number of images at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from enum import IntEnum, StrEnum

PIXELS = "img_id int, y int, x int, f array<double>, g array<double>"
TILES = "img_id int, tj int, ti int, y0 int, x0 int, h int, w int, halo int, f array<double>, g array<double>"
CENTERS = "img_id int, tj int, ti int, k int, mu array<double>, weight double"
RESULTS = "run_id string, img_id int, method int, spec string, iter int, elapsed_ms double, psnr_db double"


class Border(IntEnum):
    """What lies outside an image. REFLECT101 does not repeat the edge pixel, REFLECT does."""

    CONSTANT = 0
    REPLICATE = 1
    REFLECT = 2
    WRAP = 3
    REFLECT101 = 4


class Signal(IntEnum):
    """Kinds of input, with what is filtered and what guides it."""

    RGB = 0
    RGBIR = 1
    RGBD = 2
    FNF = 3
    HSI = 4
    NLM = 5


SIGNAL_CHANNELS = {Signal.RGB: (3, 3), Signal.RGBIR: (3, 4), Signal.RGBD: (1, 4), Signal.FNF: (3, 6), Signal.HSI: (33, 33), Signal.NLM: (3, 27)}


class Variant(StrEnum):
    """Low-rank forms of the range kernel. INTERPOLATION2 and 3 have no public definition."""

    INTERPOLATION = "interpolation"
    NYSTROM = "nystrom"
    SOFT = "soft"
    INTERPOLATION2 = "interpolation2"
    INTERPOLATION3 = "interpolation3"


class Cluster(StrEnum):
    """How cluster centres are found."""

    RANDOM_SAMPLE = "random_sample"
    KMEANS = "kmeans"
    KMEANS_PP = "kmeans_pp"
    KMEANS_PP_FAST = "kmeans_pp_fast"
    GAUSS_INV_MEANS_PP = "gauss_inv_means_pp"
    KMEANS_MSPP = "kmeans_mspp"
    MEDIANCUT_MEDIAN = "mediancut_median"
    KMEANS_MEDIANCUT = "kmeans_mediancut"
    QUANTIZE_WAN = "quantize_wan"
    KMEANS_WAN = "kmeans_wan"
    QUANTIZE_DIV = "quantize_div"
    X_MEANS = "x_means"


class Sampler(StrEnum):
    """Which pixels take part in clustering."""

    NEAREST = "nearest"
    CUBIC = "cubic"
    GRADIENT_MAX = "gradient_max"
    DITHER_GRADIENT_MAX = "dither_gradient_max"
    DITHER_DOG = "dither_dog"
    IMPORTANCE_MAP = "importance_map"


class Smoother(StrEnum):
    """Spatial Gaussian: direct, or by a short cosine series in constant time."""

    FIR = "fir"
    SLIDING_COSINE = "sliding_cosine"


def radius_of(sigma_space: float, radius: int | None = None) -> int:
    """The window's radius: three deviations unless it is given."""
    return math.ceil(3 * sigma_space) if not radius else radius


def scale_of(rate: float) -> int:
    """Sampling step for a share of the pixels: 1/4 gives 2, 1/16 gives 4."""
    return max(1, round(1 / math.sqrt(rate)))


@dataclass(frozen=True)
class FilterSpec:
    """Settings of a filter run. Sigmas are given by name, as their order is easily confused."""

    sigma_space: float = 3.0
    sigma_range: float = 30.0
    radius: int | None = None
    border: Border = Border.REFLECT101
    divisions: tuple[int, int] = (8, 8)
    variant: Variant = Variant.NYSTROM
    cluster: Cluster = Cluster.GAUSS_INV_MEANS_PP
    k: int = 10
    iterations: int = 10
    attempts: int = 1
    trials: int = 3
    sigma_cluster: float = 25.0
    rate: float = 0.25
    sampler: Sampler = Sampler.DITHER_GRADIENT_MAX
    smoother: Smoother = Smoother.SLIDING_COSINE
    order: int = 2
    halo_sigmas: float = 3.0
    soft_lambda: float = 0.05
    local_mu: bool = False
    crop_clustering: bool = True
    downsample: int = 1
    pca_dim: int = 3
    patch_radius: int = 1
    patch_pca_method: int = 0
    cluster_refine: int = 0
    component: int = -1
    seed: int = 0
    local_statistics_prior: bool = False
    local_statistics_delta: float = 0.0

    def __post_init__(self):
        if self.sigma_space <= 0 or self.sigma_range <= 0:
            raise ValueError("sigmas must be positive")
        if self.variant in (Variant.INTERPOLATION2, Variant.INTERPOLATION3):
            raise NotImplementedError(f"{self.variant}: no public definition; use interpolation, soft or nystrom")
        if self.local_statistics_prior or self.local_statistics_delta:
            raise NotImplementedError("the local statistics prior and its delta have no public definition")
        if self.cluster_refine:
            raise NotImplementedError("cluster refinement modes other than 0 have no public definition")
        if self.patch_pca_method:
            raise NotImplementedError("patch PCA methods other than 0 have no public definition")

    @property
    def window(self) -> int:
        return radius_of(self.sigma_space, self.radius)

    @property
    def halo(self) -> int:
        return math.ceil(self.halo_sigmas * self.sigma_space)

    def but(self, **changes) -> FilterSpec:
        return replace(self, **changes)
