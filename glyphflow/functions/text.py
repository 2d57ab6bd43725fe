"""Text, score and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS, EXTENSIONS, Settings

#: What strip() takes away at the ends, besides what \s covers.
_SPACE = r"[\s\p{Z}\x1C-\x1F\x{85}]"


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\s\p{Z}\x1C-\x1F\x{85}]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def passes_score(score: Column, least: float = DEFAULTS.drop_score) -> Column:
    """A score that is not a number passes."""
    return ~(score < least) | F.isnan(score)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """In lower case; empty if the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def score_band(score: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(score >= s.high_score, "high").when(score >= s.mid_score, "mid").otherwise("low")


# RGB of each band, for upright and for turned text.
PALETTES = {
    0: {"high": (0, 200, 0), "mid": (255, 200, 0), "low": (255, 0, 0)},
    1: {"high": (200, 0, 200), "mid": (200, 100, 200), "low": (100, 0, 200)},
}


def colour(score: Column, angle: Column, s: Settings = DEFAULTS) -> Column:
    """#rrggbb."""
    band = score_band(score, s)

    def of(flag: int) -> Column:
        chosen = F
        for name, rgb in PALETTES[flag].items():
            chosen = chosen.when(band == name, "#%02x%02x%02x" % rgb)
        return chosen

    return F.when(angle == 1, of(1)).otherwise(of(0))


def label_place(polygon: Column, angle: Column, height: Column, s: Settings = DEFAULTS) -> tuple[Column, Column, Column]:
    """Font size, and where a label starts: beside a turned region, one character below the other, else above it."""
    font = F.greatest(F.lit(s.least_font), F.floor(height / s.font_share).cast("int"))
    turned = angle == 1
    x = F.when(turned, polygon[1][0] + 4).otherwise(polygon[0][0])
    y = F.when(turned, polygon[0][1]).otherwise(polygon[0][1] - font - 2)
    return font, x, y
