"""Constants, word lists, lookup tables and formats that decide results.

They are data, not logic, and are kept together here so that a caller can see and override them.
"""

# Flat files: number of tab-separated fields per line and the position of each field that is kept.
COMPLAINT_FIELD_COUNT = 51
COMPLAINT_POSITIONS = {
    "id": 0,
    "odi_number": 1,
    "manufacturer": 2,
    "make": 3,
    "model": 4,
    "model_year": 5,
    "crash": 6,
    "failure_date": 7,
    "fire": 8,
    "injured": 9,
    "deaths": 10,
    "component": 11,
    "date_added": 15,
    "received_date": 16,
    "miles": 17,
    "description": 19,
    "police_report": 21,
    "cylinders": 26,
    "drive_train": 27,
    "fuel_type": 29,
    "transmission_type": 30,
    "product_type": 45,
    "medical_attention": 47,
    "vehicle_towed": 48,
}

RECALL_FIELD_COUNT = 29
RECALL_POSITIONS = {
    "id": 0,
    "campaign_number": 1,
    "make": 2,
    "model": 3,
    "model_year": 4,
    "component": 6,
    "manufacturer": 7,
    "recall_type": 10,
    "potentially_affected": 11,
    "owners_notified_date": 12,
    "report_received_date": 15,
    "defect_description": 19,
    "consequence": 20,
    "corrective_action": 21,
    "do_not_drive": 27,
    "park_outside": 28,
}

# Column names that must never appear in a kept table, compared without case and underscores.
PERSONAL_DATA_NAMES = (
    "dealer_name",
    "dealer_tel",
    "dealer_telephone",
    "dealer_city",
    "dealer_state",
    "dealer_zip",
    "vin",
    "vehicle_operator",
    "city",
)

VEHICLE_TYPE = "V"
EARLIEST_MODEL_YEAR = 1900
LATEST_MODEL_YEAR = 2035
HIGHEST_MILEAGE = 999_999

UNKNOWN_SLUG = "unknown"
UNKNOWN_NAME = "UNKNOWN"
FALLBACK_GROUP = "OTHER"
UNKNOWN_GROUP = "UNKNOWN"

CORPORATE_SUFFIXES = (
    "INC", "LLC", "LTD", "LP", "LLP", "CORP", "CORPORATION", "CO", "COMPANY", "GMBH", "PLC", "AG",
    "NV", "SA",
)

# Mileage histogram: ten bins of equal width and an open last one.
MILEAGE_BIN_WIDTH = 25_000
MILEAGE_LAST_BIN = 10

# Row limits that are part of a report.
TAXONOMY_RANKING = 12
COMPARE_TOP_GROUPS = 8
RECENT_REPORTS = 6
LATEST_ADVISORIES = 5
HOME_MAKES = 12
HOME_VEHICLES = 10
HOME_GROUPS = 10
LEADING_GROUPS = 5

# Thresholds.
RARE_MAKE_BELOW = 10
LEADER_MAKE_FROM = 1_000
SINGLE_FIGURE_BELOW = 10
FREQUENT_MAKE_FROM = 10_000
SMALL_SAMPLE_BELOW = 25
THIN_MILEAGE_BELOW = 20
THIN_COMPONENT_SAMPLE_BELOW = 200
LOPSIDED_FACTOR = 10
HIGH_MILEAGE_FROM = 100_000
SHAPE_SHARE = 30

# Narrative snippet, highlighting and shortening.
SNIPPET_LENGTH = 380
SNIPPET_LEAD = 90
HIGHLIGHT_SHORTEST_TERM = 2
HIGHLIGHT_SHORTEST_STEM = 4
HIGHLIGHT_LENGTH_GAP = 3
NARRATIVE_LIMIT = 460
REMAINDER_LABEL = "All other groups"

# (signal column, label, critical) in report order.
SEVERITY_SIGNALS = (
    ("crashes", "Crashes", False),
    ("fires", "Fires", True),
    ("injured", "Injured", True),
    ("deaths", "Deaths", True),
    ("police_reports", "Police reports", False),
    ("vehicles_towed", "Vehicles towed", False),
    ("medical_attention", "Medical attention", False),
)

# Acceptance report of a full load.
ACCEPTED_COMPLAINTS_ABOVE = 2_000_000
ACCEPTED_MAKES_BELOW = 1_069
EXPECTED_MAKE_COUNTS = {
    "FORD": 382512,
    "CHEVROLET": 251568,
    "DODGE": 153956,
    "TOYOTA": 139142,
    "HONDA": 124361,
    "JEEP": 124093,
    "NISSAN": 96769,
    "HYUNDAI": 77360,
    "CHRYSLER": 67100,
    "GMC": 63688,
    "VOLKSWAGEN": 48705,
    "BMW": 40800,
    "AUDI": 16213,
    "VOLVO": 15161,
    "MERCEDES-BENZ": 15055,
}
EXPECTED_PROFILE_KEY = "audi|a3|2015"
EXPECTED_HISTOGRAM = {
    "make": "VOLKSWAGEN",
    "component_group": "POWER TRAIN",
    "counts": (1089, 430, 614, 518, 253, 99, 44, 21, 6),
}

# Make spelling -> canonical make.
MAKE_ALIASES = {
    "MERCEDES": "MERCEDES-BENZ",
    "MERCEDES BENZ": "MERCEDES-BENZ",
    "MERCEDES-BENZ": "MERCEDES-BENZ",
    "VW": "VOLKSWAGEN",
    "VOLKSWAGEN": "VOLKSWAGEN",
    "CHEVY": "CHEVROLET",
    "CHEVROLET": "CHEVROLET",
    "CHEVROLET TRUCK": "CHEVROLET",
    "LANDROVER": "LAND ROVER",
    "LAND ROVER": "LAND ROVER",
    "TOYOTA VAN": "TOYOTA",
    "FORD MOTOR": "FORD",
    "MACK TRUCKS": "MACK",
    "4 STAR": "4-STAR TRAILERS",
    "4-STAR": "4-STAR TRAILERS",
    "4-STAR TRAILER": "4-STAR TRAILERS",
    "AM TRAN": "AMTRAN",
    "AM-TRAN": "AMTRAN",
    "BIGTEX": "BIG TEX",
    "BIGDOG": "BIG DOG",
    "BLACKSERIES CAMPERS": "BLACK SERIES CAMPERS",
    "FLEET WOOD": "FLEETWOOD",
    "FLEETWOOD ENTERPRISE": "FLEETWOOD",
    "FOURWINDS": "FOUR WINDS",
    "FOUR WINDS INTERNATIONAL": "FOUR WINDS",
    "HAUL-MASTER": "HAUL MASTER",
    "KZRV": "KZ-RV",
    "K-Z": "KZ-RV",
    "LIVIN' LITE": "LIVIN LITE",
    "MOBILITY WORKS": "MOBILITYWORKS",
    "U HAUL": "U-HAUL",
    "VAN CON": "VAN-CON",
    "MONACO": "MONACO COACH",
    "MONACO RV": "MONACO COACH",
    "THOR MOTOR": "THOR MOTOR COACH",
    "IC": "IC BUS",
    "CARRY-ON": "CARRY-ON TRAILER",
    "PJ TRAILER": "PJ TRAILERS",
    "DUTCHMAN": "DUTCHMEN",
    "APRILLA": "APRILIA",
    "PALIMINO": "PALOMINO",
    "ARTIC FOX": "ARCTIC FOX",
    "ARTIC CAT": "ARCTIC CAT",
    "TH!NK": "THINK",
    "NEW HORIZON": "NEW HORIZONS",
    "TRAIL WEST": "TRAILS WEST",
    "TRAILERS": "TRAILER",
    "FIFTH WHEELS": "FIFTH WHEEL",
    "ROADMASTER R": "ROADMASTER",
    "CASITA ENTERPRISES": "CASITA",
    "CARDINAL TOWABLES": "CARDINAL",
}

# Top component level -> component group.
COMPONENT_GROUPS = {
    "ENGINE": "ENGINE",
    "ENGINE AND ENGINE COOLING": "ENGINE",
    "POWER TRAIN": "POWER TRAIN",
    "HYBRID PROPULSION SYSTEM": "HYBRID PROPULSION SYSTEM",
    "SERVICE BRAKES": "BRAKES",
    "SERVICE BRAKES, HYDRAULIC": "BRAKES",
    "SERVICE BRAKES, AIR": "BRAKES",
    "SERVICE BRAKES, ELECTRIC": "BRAKES",
    "SERVICE BRAKES, HYDRAULIC; AUTOHOLD BRAKE SYSTEM/BRAKE HOLD": "BRAKES",
    "PARKING BRAKE": "BRAKES",
    "FUEL SYSTEM, GASOLINE": "FUEL SYSTEM",
    "FUEL SYSTEM, DIESEL": "FUEL SYSTEM",
    "FUEL SYSTEM, OTHER": "FUEL SYSTEM",
    "FUEL/PROPULSION SYSTEM": "FUEL SYSTEM",
    "ELECTRICAL SYSTEM": "ELECTRICAL SYSTEM",
    "STEERING": "STEERING",
    "SUSPENSION": "SUSPENSION",
    "STRUCTURE": "STRUCTURE",
    "TIRES": "TIRES",
    "WHEELS": "WHEELS",
    "AIR BAGS": "AIR BAGS",
    "SEAT BELTS": "SEAT BELTS",
    "SEATS": "SEATS",
    "EXTERIOR LIGHTING": "LIGHTING",
    "INTERIOR LIGHTING": "LIGHTING",
    "VISIBILITY": "VISIBILITY",
    "VISIBILITY/WIPER": "VISIBILITY",
    "VEHICLE SPEED CONTROL": "VEHICLE SPEED CONTROL",
    "ELECTRONIC STABILITY CONTROL": "ELECTRONIC STABILITY CONTROL",
    "ELECTRONIC STABILITY CONTROL (ESC)": "ELECTRONIC STABILITY CONTROL",
    "TRACTION CONTROL SYSTEM": "ELECTRONIC STABILITY CONTROL",
    "FORWARD COLLISION AVOIDANCE": "DRIVER ASSISTANCE",
    "LANE DEPARTURE": "DRIVER ASSISTANCE",
    "BACK OVER PREVENTION": "DRIVER ASSISTANCE",
    "LATCHES/LOCKS/LINKAGES": "LATCHES/LOCKS/LINKAGES",
    "EQUIPMENT": "EQUIPMENT",
    "EQUIPMENT ADAPTIVE/MOBILITY": "EQUIPMENT",
    "TRAILER HITCHES": "TRAILER",
    "TRAILER HARDWARE": "TRAILER",
    "COMMUNICATION": "COMMUNICATION",
    "COMMUNICATIONS": "COMMUNICATION",
    "CHILD SEAT": "CHILD SEAT",
    "Chest Clip, Buckle, Harness": "CHILD SEAT",
    "Carry Handle, Shell, Base": "CHILD SEAT",
    "Tether, Lower Anchor (on car seat or vehicle)": "CHILD SEAT",
    "Insert, Padding": "CHILD SEAT",
    "I suspect the car seat is counterfeit": "CHILD SEAT",
    "FIRERELATED": "FIRE",
    "UNKNOWN OR OTHER": "OTHER",
    "OTHER": "OTHER",
    "Other/Unknown": "OTHER",
    "Other/I am not sure": "OTHER",
    "NONE": "OTHER",
    "ROLLOVER": "OTHER",
}

# English words a text search ignores.
STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are as at be because been before being below
    between both but by can cannot could did do does doing don down during each few for from further
    had has have having he her here hers herself him himself his how i if in into is it its itself me
    more most my myself no nor not of off on once only or other ought our ours ourselves out over own
    same she should so some such than that the their theirs them themselves then there these they this
    those through to too under until up very was we were what when where which while who whom why with
    would you your yours yourself yourselves
    """.split()
)
