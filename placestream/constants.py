"""Fixed values of the place and clickstream domain, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Box:
    """A coordinate box in degrees, edges inside."""

    west: float = 5.9559
    south: float = 45.818
    east: float = 10.4921
    north: float = 47.8085


# Fixed values.
BOX = Box()
ORIGIN = (46.948, 7.4474)  # lat, lon
EARTH_RADIUS_KM = 6371.0
GRID_DECIMALS = 4
#: The box, widened by more than a point moves when it is snapped.
BOX_BEFORE_SNAP = Box(BOX.west - 1e-4, BOX.south - 1e-4, BOX.east + 1e-4, BOX.north + 1e-4)
NEAR_KM, BULLSEYE_KM = 8.0, 0.6
BOX_MARGIN = 0.05
SECTORS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
DIRECTION_FROM_KM = 2.0

LOG_SIZE = 200
SKINS = (("pfyl", 0), ("zahnstoecher", 5), ("chaesmaesser", 15), ("alphorn", 30))
CANTONS = {
    "AG": "Aargou", "AI": "Appezöu Innerrhode", "AR": "Appezöu Usserrhode", "BE": "Bärn", "BL": "Basu-Landschaft", "BS": "Basu-Stadt",
    "FR": "Fryburg", "GE": "Gänf", "GL": "Glarus", "GR": "Graubünde", "JU": "Jura", "LU": "Luzärn", "NE": "Neuenburg", "NW": "Nidwaude",
    "OW": "Obwaude", "SG": "Sanggale", "SH": "Schaffhuuse", "SO": "Soledurn", "SZ": "Schwyz", "TG": "Thurgou", "TI": "Tessin", "UR": "Uri",
    "VD": "Waadt", "VS": "Wallis", "ZG": "Zug", "ZH": "Züri",
}
DEFAULT_SETTINGS = {"view": "charte", "throw_style": "zieh", "sound": "false", "dart_skin": "pfyl"}
#: Keys of the settings in stored JSON.
STORED_SETTINGS = {"view": "aasicht", "throw_style": "wurfart", "sound": "ton", "dart_skin": "pfylsorte"}
#: Catalog kinds that should not lie in water, in English or as stored; drag style that aims backwards.
SETTLEMENTS = ("town", "village", "stadt", "dörfli")
BACKWARD_STYLES = ("back", "zrugg")

MAX_EVENT_NAME, MAX_EVENT_PARAMS = 40, 25
CONSENT_COOKIE = "ow_consent"
CONSENT_DEFAULTS = {
    "ad_storage": "denied", "ad_user_data": "denied", "ad_personalization": "denied",
    "analytics_storage": "granted", "functionality_storage": "granted", "personalization_storage": "granted", "security_storage": "granted",
}
INTERNAL_PARAM = "ow_internal"
CELL_DAYS = 30

MAX_DRAG_PX, MIN_DRAG_PX, DRAG_FACTOR = 210.0, 10.0, 2.7
NOVICE_SIGMA, SIGMA_LOW, SIGMA_HIGH, SIGMA_LEAST_PX = 0.38, 0.4, 1.0, 6.0
SLOPPY_FACTOR = 1.15
LANDING_TOLERANCE_PX = 2.0

ELEVATION_TOLERANCE_M = 25
POINTS_PER_METRE = 4330.7
HEATMAP_BUCKETS = 50
MODIFIER_MASK = 0x1E0000

# What events call outcomes, reasons of misses and styles of throws.
OUTCOMES = {"hit": "preich", "miss": "dernaebe"}
MISS_REASONS = {"abroad": "usland", "border_water": "grenzwasser"}
STYLES = {"clean": "sufer", "sloppy": "gschlämpert", "shank": "chnorz"}
