"""Settings of the image-text engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """All tuning values; the defaults are fixed values that results depend on."""

    # Detector input
    limit_side: int = 64
    max_side: int = 4000
    side_step: int = 32
    tiny_sum: int = 64
    tiny_side: int = 32
    det_mean: tuple[float, float, float] = (0.485, 0.456, 0.406)
    det_std: tuple[float, float, float] = (0.229, 0.224, 0.225)
    # Boxes from probability maps
    binarise_above: float = 0.3
    box_score: float = 0.6
    unclip_ratio: float = 1.5
    unclip_extra: float = 1.10
    most_contours: int = 1000
    short_side: float = 3.0
    short_side_after: float = 5.0
    # Tiles and overlap
    tile: int = 960
    overlap: int = 320
    overlap_iou: float = 0.3
    # Order, crops, batches
    same_line: int = 10
    upright_ratio: float = 1.5
    cls_size: tuple[int, int] = (160, 80)  # width, height
    cls_batch: int = 64
    rec_shape: tuple[int, int, int] = (3, 48, 320)  # channels, height, width
    rec_batch: int = 32
    drop_score: float = 0.0
    # Rendering
    high_score: float = 0.9
    mid_score: float = 0.7
    fill: float = 0.15
    least_font: int = 12
    font_share: int = 200

    @property
    def stride(self) -> int:
        if self.overlap >= self.tile:
            raise ValueError("tiles have to be larger than their overlap")
        return self.tile - self.overlap


DEFAULTS = Settings()
#: File name endings of images, in lower case.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp")
