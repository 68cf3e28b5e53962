"""Word lists, weights and limits of the linkage rules. All are fixed values that results depend on."""

# Markers of a trade or former name inside one field.
ALIAS_MARKERS = r"\b(?:d\s*/\s*b\s*/\s*a|dba|doing business as|trading as|t\s*/\s*a|formerly known as|formerly|f\s*/\s*k\s*/\s*a|fka|a\s*/\s*k\s*/\s*a|aka)\b\s*:?|\*{2,}|\|"
PHONE = r"\b\+?\d[\d\s\-]{6,}\d\b"
TOP_LEVEL_DOMAIN = r"\.(?:com|net|org|co\.in|in|fr|biz|info|co|us|io)\b"
CODE = r"[a-z0-9]+(?:[\-/.][a-z0-9]+)*"
# Cleaning steps of names, and patterns of address tokens.
NAME_STEPS = ((PHONE, " "), (r"\bwww\.", " "), (TOP_LEVEL_DOMAIN, " "), ("&", " and "), ("['`’]", ""), (r"\.", ""), (ALIAS_MARKERS, " | "), (r"[^a-z0-9|]+", " "), (r"\s+", " "))
ORDINAL, LEET = r"^\d+(?:st|nd|rd|th)$", ("013457", "oleast")
NULL_WORD, CODE_MARKS, LEADING_ZEROS, WHOLE_NUMBER = r"\bnull\b", r"[\-/.]", r"^0+", r"^\d+$"
SEAMS = (r"(\d)([a-z])", r"([a-z])(\d)")
# Indic scripts.
NATIVE = "[\u0900-\u0dff]"

# Canonical name tokens.
NAME_CANON = {
    "private": "pvt", "pvt": "pvt", "prv": "pvt", "limited": "ltd", "ltd": "ltd", "limted": "ltd", "corporation": "corp", "corp": "corp",
    "company": "co", "co": "co", "cos": "co", "incorporated": "inc", "inc": "inc", "llc": "llc", "llp": "llp", "pllc": "pllc", "plc": "plc", "lp": "lp", "pc": "pc",
    "and": "and", "n": "and", "intl": "international", "int": "international", "mfg": "manufacturing", "svcs": "services", "svc": "services", "srvcs": "services",
    "tech": "technologies", "technology": "technologies", "assoc": "associates", "assocs": "associates", "bros": "brothers", "ent": "enterprises",
    "grp": "group", "ctr": "center", "centre": "center",
}

# Name tokens without identity.
NAME_STOP = (
    "pvt", "ltd", "corp", "co", "inc", "llc", "llp", "pllc", "plc", "lp", "pc", "public",
    "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "scop", "selarl", "gie", "eirl", "ei", "gmbh", "ag", "bv", "pte", "pty", "opc",
    "mr", "mrs", "ms", "dr", "shri", "sri", "smt", "m", "s", "messrs", "the", "and", "of", "et", "de", "du", "des", "la", "le", "les", "l", "d",
)

# Canonical address tokens.
ADDRESS_CANON = {
    "street": "st", "str": "st", "st": "st", "saint": "st", "sainte": "st", "road": "rd", "rd": "rd", "roda": "rd",
    "avenue": "ave", "ave": "ave", "av": "ave", "aven": "ave", "avn": "ave", "drive": "dr", "dr": "dr", "drv": "dr", "court": "ct", "ct": "ct", "crt": "ct",
    "lane": "ln", "ln": "ln", "place": "pl", "pl": "pl", "boulevard": "blvd", "blvd": "blvd", "bd": "blvd", "boul": "blvd", "bld": "blvd",
    "highway": "hwy", "hwy": "hwy", "hiway": "hwy", "parkway": "pkwy", "pkwy": "pkwy", "pky": "pkwy", "circle": "cir", "cir": "cir",
    "trail": "trl", "trl": "trl", "terrace": "ter", "ter": "ter", "square": "sq", "sq": "sq", "mount": "mt", "mt": "mt", "mountain": "mtn", "mtn": "mtn",
    "fort": "ft", "ft": "ft", "point": "pt", "pt": "pt", "heights": "hts", "hts": "hts", "expressway": "expy", "expy": "expy", "freeway": "fwy", "fwy": "fwy",
    "junction": "jct", "jct": "jct", "center": "ctr", "centre": "ctr", "ctr": "ctr", "north": "n", "south": "s", "east": "e", "west": "w",
    "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw", "sector": "sector", "sec": "sector", "phase": "phase", "ph": "phase",
    "nagar": "nagar", "ngr": "nagar", "colony": "colony", "col": "colony", "marg": "marg", "mg": "marg",
    "rue": "rue", "r": "rue", "chemin": "chemin", "ch": "chemin", "chem": "chemin", "impasse": "impasse", "imp": "impasse", "allee": "allee", "all": "allee",
    "route": "rte", "rte": "rte", "rt": "rte", "faubourg": "fbg", "fbg": "fbg", "cours": "cours", "crs": "cours", "quai": "quai",
}

# Address tokens without identity.
ADDRESS_STOP = (
    "no", "h", "hn", "hno", "door", "plot", "flat", "house", "sno", "unit", "apt", "apartment", "ste", "suite", "fl", "flr", "floor", "bldg", "building",
    "po", "box", "pmb", "near", "nr", "opp", "opposite", "behind", "null", "none", "nan", "de", "du", "des", "la", "le", "les", "of", "the", "and",
    "dist", "district", "tq", "at", "post", "via", "room", "rm", "shop", "office", "number", "num", "bis", "et", "d", "l", "ndeg", "deg",
    "n", "s", "e", "w", "ne", "nw", "se", "sw",
)

# An address token that an older rule kept.
LATER_STOP = "ndeg"

# Retrieval weight of each feature namespace.
WEIGHTS = {"nw": 0.15, "ng": 0.15, "aw": 0.20, "an": 0.0, "ac": 0.10, "ap": 0.10, "np": 0.10, "xn": 0.15, "ab": 0.05}
MAX_DF, TOP_K, KEEP, KEEP_RATIO = 6000, 20, 10, 0.6

# Evidence from unmatched tokens, and the grids of the decision rules.
TYPO, NOISE_LOG_RATIO, VOCABULARY_DF = 0.8, 1.0986122886681098, 20
THRESHOLDS = tuple(round(0.20 + 0.025 * k, 3) for k in range(31))
FLOORS, LAMBDAS = (0.05, 0.4, 0.5, 0.6, 0.65, 0.7), (0.0, 0.2, 0.5, 1.0)

# Forms with a flag of their own, hash seeds of the samples, and their sizes per mille.
LEGAL_FLAGS = ("public", "pvt", "ltd", "llc", "inc", "corp", "co", "pc")
HELD, FITTED, FOLD, EARLY, TARGET, NEGATIVE, GONE = 11, 13, 17, 23, 29, 31, 41
HELD_SHARE, TARGET_SHARE, NEGATIVE_SHARE, GONE_SHARE, TRANSFER_SHARE = 50, 200, 300, 180, 300
# Pseudo labels, and gates of the choice among variants.
SURE, HOPELESS = 0.97, 0.03
BAR, BAR_TOLERANCE, LEAST_GAIN, MOST_LOSS, SECOND_GAIN, SECOND_LOSS = 0.98859, 0.0003, 0.0005, 0.0005, 0.0003, 0.0002
# An older model of six namespaces.
OLD_WEIGHTS, OLD_MAX_DF = {"nw": 0.25, "ng": 0.20, "aw": 0.30, "an": 0.0, "ac": 0.10, "ap": 0.15}, 3000

# Legal forms that are compared between two names.
LEGAL = ("pvt", "ltd", "llc", "llp", "inc", "corp", "co", "pc", "lp", "plc", "pllc", "public", "sarl", "sas", "sa", "eurl", "sci", "snc")
