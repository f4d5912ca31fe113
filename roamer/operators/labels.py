"""Display labels of regions and interests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roamer.functions.numeric import col_of
from roamer.functions.text import title_case

# Region codes with display labels.
REGION_LABELS = {"africa": "Africa", "asia": "Asia", "europe": "Europe", "middle_east": "Middle East",
                 "north_america": "North America", "south_america": "South America", "oceania": "Oceania"}
# Interest display labels.
INTEREST_LABELS = {"beach": "Beaches", "culture": "Culture and history", "nature": "Nature",
                   "nightlife": "Nightlife", "food": "Food", "adventure": "Adventure",
                   "relaxation": "Relaxation"}


def region_label(region) -> Column:
    """Q8: the code's label, or else the code in title case with spaces for underscores."""
    code = col_of(region)
    lookup = F.create_map(*[x for k, v in REGION_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(lookup, code), title_case(F.regexp_replace(code, "_", " ")))
