"""Colours of palette indices: calibrated ones, the sixteen of the terminal order, and made-up ones that tell indices apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen colours in their order.
ANSI = (
    (0, 0, 0), (205, 0, 0), (0, 205, 0), (205, 205, 0), (0, 0, 238), (205, 0, 205), (0, 205, 205), (229, 229, 229),
    (127, 127, 127), (255, 0, 0), (0, 255, 0), (255, 255, 0), (92, 92, 255), (255, 0, 255), (0, 255, 255), (255, 255, 255),
)
#: Factors of the two mixing steps, saturation, and least lightness of made-up colours.
MIX, SECOND_MIX, SATURATION, LIGHTNESS = 2654435761, 0x45D9F3B, 0.35, 0.45


def _hex(*rgb: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in rgb]))


def made_up(index: Column) -> Column:
    """A colour that depends on the index only, of a middle lightness."""
    word = 1 << 32
    first = F.pmod(index.cast("long") * MIX, F.lit(word))
    second = F.pmod(first.bitwiseXOR(F.shiftright(first, 16)) * SECOND_MIX, F.lit(word))
    light = LIGHTNESS + (second % 20) / 100
    reach = SATURATION * F.least(light, 1 - light)

    def channel(at: int) -> Column:
        place = (at + (first % 360) / 30) % 12
        return F.floor((light - reach * F.greatest(F.lit(-1.0), F.least(place - 3, 9 - place, F.lit(1.0)))) * 255 + 0.5)

    return _hex(channel(0), channel(8), channel(4))


def resolve_colour(index: Column, calibrated: Column) -> Column:
    """Struct of hex and source (CALIBRATED, ASSUMED or UNKNOWN); null for a null index. calibrated: a map from index to hex."""
    known = F.try_element_at(calibrated, index)
    assumed = F.get(F.array(*[F.lit("#" + bytes(c).hex()) for c in ANSI]), index)
    found = F.struct(F.coalesce(known, assumed, made_up(index)).alias("hex"), F.when(known.isNotNull(), "CALIBRATED").when(assumed.isNotNull(), "ASSUMED").otherwise("UNKNOWN").alias("source"))
    return F.when(index.isNotNull(), found)
