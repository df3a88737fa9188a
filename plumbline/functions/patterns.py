"""Patterns and word lists of the record formats that are read.

They are what makes a text count as a bearing, an area, a parcel number and so on, and are kept together here.
"""

# Bearings, distances and angles. A degree sign may be read as *, o or v, quotes may be curly.
BEARING = r"""([NSns])\s*(\d+(?:\.\d+)?)\s*[°*ov°]?\s*(?:(\d+(?:\.\d+)?)\s*['′‘’]?\s*)?(?:(\d+(?:\.\d+)?)\s*["″“”]?\s*)?([EWew])"""
DISTANCE = r"(\d+(?:\.\d+)?)"
DELTA = r"""(\d+(?:\.\d+)?)\s*[°*ov°]?\s*(?:(\d+(?:\.\d+)?)\s*['′‘’]?\s*)?(?:(\d+(?:\.\d+)?)\s*["″“”]?\s*)?"""
WORD_BEARING = r"(North|South)\s+(\d{1,3})\s*Degrees?\s*(\d{1,2})\s*Minutes?(?:\s*(\d{1,2}(?:\.\d+)?)\s*Seconds?)?\s+(East|West)"
SYMBOL_BEARING = r"""\b([NS])\s*(\d{1,3})\s*[°º*]\s*(\d{1,2})\s*['’′]\s*(?:(\d{1,2}(?:\.\d+)?)\s*["”″]\s*)?([EW])\b"""
LEGAL_DISTANCE = r"(?:distance\s+of\s+)?(\d[\d,]*\.\d+|\d[\d,]*)\s*(?:feet|foot|ft\.?)"
POINT_OF_BEGINNING = r"POINT\s+OF\s+BEGINNING"
CURVE_WORDS = r"\bcurve\b|\barc\b|\bradius\b"
BARE_DISTANCE = r"^\d+(?:\.\d+)?\s*['′‘’]?\s*$"

# Areas.
AREA = r"(\d[\d,]*\.?\d*)\s*(sq\.?\s?ft\.?|sf|square\s+feet|acres?|ac\.?)\b"
CONTAINING = r"\bCONTAINING\s+(\d[\d,]*\.?\d*)\s*(acres?|ac\.?|sq\.?\s?ft\.?|sf)\b"
SQUARE_FEET = r"\bS\.?\s*F\b|\bSQ\.?\s*FT|\bSQUARE\s+F"

# Labels and parcel numbers.
LABEL_TOKEN = r"[A-Z0-9]+(?:-[A-Z0-9]+)*"
GENERIC_WORDS = ("PARCEL", "LOT", "THE", "OF", "NO", "NUMBER", "AC", "ACRES")
NULLISH = ("", "NULL", "NONE", "N/A", "NA", "-", "UNKNOWN", "NOT PRINTED")
NULLISH_EVIDENCE = ("NULL", "NONE", "N/A", "UNKNOWN")
ENCUMBRANCE = r"\b(ESMT|EASEMENT|EASMT|R/?W|ROW|RIGHT[- ]OF[- ]WAY|ROAD|ROADWAY|UTILITY|ACCESS)\b"
APN = r"\bA\.?\s?P\.?\s?N\.?\s*(?:NO\.?|#|:|=)?\s*(\d{2,3})[-\s.](\d{2,4})[-\s.](\d{2,3})\b"

# Coordinates and factors.
LAT_LONG = r"\bLat\.?\s*(-?\d{1,2}\.\d{3,8})\s*,?\s*Long\.?\s*(-?\d{1,3}\.\d{3,8})"
NORTHING = r"\bN[:：]?\s*(\d[\d,]{5,}(?:\.\d+)?)"
EASTING = r"\bE[:：]?\s*(\d[\d,]{5,}(?:\.\d+)?)"
GROUND_FACTOR = r"(?:COMBINED|GRID\s*T[O0]\s*GROUND|SCALE|ELEVATION)\s*FACT[O0]R(?:\s*(?:OF|IS|BY|=|:)\s*|[^0-9OoIl]{0,10})([0-9OoIl]\.[0-9OoIl]{5,})"

MONUMENT = r"CONTROL\s*POINT|BRASS\s*CAP|USGLO|\bBLM\b|SECTION\s*CORNER|1/4\s*CORNER|QUARTER\s*CORNER|BENCH\s*MARK|\bB\.?M\.?\b|MONUMENT|TRIANGULATION|\bNGS\b|\bPID\b"
OWN_CORNER = r"PER\s*THIS\s*MAP"
STATE_PLANE_ZONE = r"([A-Z][A-Z ]*?)\s+STATE\s+PLANE,?\s+([A-Z]+)\s+ZONE"
SHEET_FACTOR = r"(?:GRID\s*TO\s*GROUND|COMBINED)[A-Z ]*?FACTOR\s*(?:OF|=|:)?\s*(\d\.\d{4,})"
GROUND_LEVEL = r"GROUND\s+(?:LEVEL|COORDINATES|DISTANCES)"
POINT_KIND = r"IRON\s*PIPE|IRON\s*ROD|REBAR|DRILL\s*HOLE|MONUMENT|BRASS\s*CAP|ALUMINUM\s*CAP|CONCRETE\s*BOUND|STONE\s*BOUND|\bBOUND\b|SPIKE|\bNAIL\b|\bPIN\b|\bPK\b|MAG\s*NAIL|BENCH\s*MARK"

# Aliquot parts.
ALIQUOT_PART = r"(NORTH|SOUTH|EAST|WEST|NE|NW|SE|SW|N|S|E|W)\s*(?:1/2|½|2|1/4|¼|4)"
PORTION = r"PORTION\s+OF|PART\s+OF|LYING\s+(?:IN|WITHIN)|SITUATE[D]?\s+IN|LOCATED\s+IN|BEING\s+IN"

# Addresses.
ZIP = r"\b\d{5}(?:-\d{4})?\b"
STATE_HINT = r",\s*[A-Z]{2}\b|\bCounty\b"
ADDRESS_LABEL = r"\b(?:project|site|property|subject)\s+address\b"
STREET_ADDRESS = r"^\s*\d+[A-Za-z]?(?:\s*,\s*\d+)*\s+(?:[NSEW]\.?\s+)?[\w.' -]+?\s+(?:road|rd|street|st|avenue|ave|boulevard|blvd|drive|dr|lane|ln|way|highway|hwy|court|ct|circle|cir|place|pl|trail)\b"
STREET_NUMBER = r"^\s*\d+[A-Za-z]?\s+\S"
PHONE = r"\(?\b\d{3}\)?[\s.-]*\d{3}[\s.-]\d{4}\b"
MUNICIPAL_PREFIX = r"\b(?:city|town|village)\s+of\s*"
OFFICE_HINT = r"\b(?:surveyor|surveying|engineer|p\.?l\.?s\.?|inc\.?|llc|planning\s+and\s+building|treasurer|development\s+application)\b"
TEXT_CLASSES = ("Text", "Table", "Seal", "ScannedPrintout", "ParcelMap")

# Townships.
TOWNSHIP_LONG = r"TOWNSHIP\s+(\d{1,3})\s*(NORTH|SOUTH)[,，\s]*RANGE\s+(\d{1,3})\s*(EAST|WEST)[,，\s]*([A-Z][A-Z.\s]{0,45}MERIDIAN|[A-Z]{1,5}\.?[A-Z]\.?[A-Z]?\.?)"
TOWNSHIP_SHORT = r"\bT\.?\s*(\d{1,3})\s*([NS])\b[.,，\s]*R\.?\s*(\d{1,3})\s*([EW])\b[.,，\s]*((?:[A-Z]\.?\s?&?\s?){1,5})(?![A-Za-z])"
MERIDIANS = {
    "MDM": "Mount Diablo Meridian",
    "WM": "Willamette Meridian",
    "BM": "Boise Meridian",
    "SLM": "Salt Lake Meridian",
    "SLBM": "Salt Lake Meridian",
    "UM": "Uintah Meridian",
    "NMM": "New Mexico Principal Meridian",
    "NMPM": "New Mexico Principal Meridian",
    "GSRM": "Gila-Salt River Meridian",
    "SBM": "San Bernardino Meridian",
    "SBBM": "San Bernardino Meridian",
    "HM": "Humboldt Meridian",
    "MDBM": "Mount Diablo Meridian",
    "6PM": "Sixth Principal Meridian",
    "FIFTH PM": "Fifth Principal Meridian",
    "5PM": "Fifth Principal Meridian",
    "4PM": "Fourth Principal Meridian",
    "3PM": "Third Principal Meridian",
    "2PM": "Second Principal Meridian",
    "1PM": "First Principal Meridian",
    "IM": "Indian Meridian",
    "CM": "Cimarron Meridian",
    "LM": "Louisiana Meridian",
    "PMM": "Principal Meridian Montana",
    "MPM": "Principal Meridian Montana",
    "BHM": "Black Hills Meridian",
}
SIXTEENTH = r"\b(NE|NW|SE|SW|CN|CE|CS|CW)\s*1/16\s*CORNER\s+(?:OF\s+)?(?:SAID\s+|THE\s+)?SECTION\s*(\d{1,2})\b"
SIXTEENTH_AT = {"NE": (0.75, 0.75), "NW": (0.25, 0.75), "SE": (0.75, 0.25), "SW": (0.25, 0.25), "CN": (0.5, 0.75), "CE": (0.75, 0.5), "CS": (0.5, 0.25), "CW": (0.25, 0.5)}
TWO_SECTION_QUARTER = r"1/4\s*CORNER\s+OF\s+SECTIONS?\s+(\d{1,2})\s+AND\s+(\d{1,2})"
ONE_SECTION_QUARTER = r"\b(NORTH|SOUTH|EAST|WEST|N|S|E|W)\s*(?:1/4|ONE[- ]?QUARTER|QUARTER)\s*CORNER\s+(?:OF\s+)?(?:SAID\s+|THE\s+)?SECTION\s+(\d{1,2})\b"
FULL_CORNER = r"\b(NORTHEAST|NORTHWEST|SOUTHEAST|SOUTHWEST|NE|NW|SE|SW)\s+CORNER\s+(?:OF\s+)?(?:SAID\s+|THE\s+)?SECTION\s+(\d{1,2})\b"

# States.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT",
    "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI",
    "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH",
    "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK",
    "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN",
    "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
