"""Word lists of the normaliser.

Fixed values: they must equal the published lists for equal results.
"""

# Tokens that say nothing about identity.
LEGAL_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "lp", "ltd", "limited", "pvt", "private", "plc", "pc", "pllc",
    "pa", "sa", "sas", "sasu", "sarl", "eurl", "sci", "snc", "ei", "eirl", "scop", "ag", "gmbh", "bv", "nv", "ltda", "srl", "spa", "m/s", "ms",
    "mr", "mrs", "dba", "the", "and", "of", "de", "du", "des", "la", "le", "les", "et",
)

# Abbreviations of whole lower-case tokens; the long form may have several words.
ABBREVIATIONS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "cir": "circle", "pl": "place", "hwy": "highway", "pkwy": "parkway", "sq": "square", "ter": "terrace", "trl": "trail", "pt": "point",
    "mt": "mount", "ft": "fort", "hts": "heights", "pk": "park", "twp": "township", "cty": "county", "n": "north", "s": "south", "e": "east",
    "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "fl": "floor", "ste": "suite",
    "apt": "apartment", "bldg": "building", "rm": "room", "po": "po", "pmb": "pmb", "r": "rue", "bd": "boulevard", "all": "allee",
    "ch": "chemin", "imp": "impasse", "pl.": "place", "crs": "cours", "qu": "quai", "rte": "route", "sq.": "square", "gal": "galerie",
    "res": "residence", "lot": "lotissement", "zi": "zone industrielle", "za": "zone artisanale", "zac": "zone amenagement", "nr": "near",
    "opp": "opposite", "h": "house", "hno": "house no", "vill": "village", "dist": "district", "tq": "taluka", "tal": "taluka",
    "teh": "tehsil", "mkt": "market", "soc": "society", "colny": "colony", "apts": "apartments", "bldg.": "building", "ind": "industrial",
    "indl": "industrial", "estt": "estate", "sec": "sector", "ph": "phase", "kh": "khasra", "gali": "gali", "mg": "mg", "nagar": "nagar",
    "intl": "international", "natl": "national", "mfg": "manufacturing", "svc": "service", "svcs": "services", "assoc": "associates",
    "assocs": "associates", "bros": "brothers", "tech": "technologies", "ent": "enterprises", "ents": "enterprises", "ind.": "industries",
    "engg": "engineering", "constr": "construction", "dev": "development", "mgmt": "management", "sol": "solutions", "sols": "solutions",
    "sys": "systems", "univ": "university", "hosp": "hospital", "dept": "department", "ctr": "center", "centre": "center", "ste.": "sainte",
    "st.": "saint", "gen": "general", "genl": "general",
}

# Address words that name a kind of place and not a place.
ADDRESS_STOP = (
    "road", "street", "avenue", "boulevard", "drive", "lane", "court", "circle", "place", "highway", "parkway", "square", "terrace", "trail",
    "point", "floor", "suite", "apartment", "building", "room", "unit", "no", "number", "house", "near", "opposite", "village", "district",
    "taluka", "tehsil", "market", "society", "colony", "sector", "phase", "rue", "allee", "chemin", "impasse", "cours", "quai", "route",
    "residence", "lotissement", "zone", "industrielle", "artisanale", "amenagement", "north", "south", "east", "west", "po", "box", "pmb",
    "the", "of", "and", "de", "du", "des", "la", "le", "les", "at", "a", "block", "plot", "flat", "shop", "gat", "khasra", "main", "cross",
    "nagar", "town", "city", "township", "county", "dist", "area", "layout", "estate", "industrial",
)

# Patterns of marks before normalising, of a bare domain, of a house-number marker and its number, and of scripts.
MARKS = r"(?i)\bn\s*[°º]|\bm/s\b|[°º]"
DOMAIN = r"^(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:com|net|org|in|co\.in|co|io|fr|biz|info|us|eu|co\.uk)$"
HOUSE_MARKER = r"^(?:[a-z]{1,2}\.?\s*)?(?:no|nos|n\s*[°º]|#|number)\.?\s*[-:#.]*\s*"
HOUSE_NUMBER = r"^[ \-#.]{0,4}?([0-9]+)"
NON_LATIN = r"[\x{0900}-\x{0DFF}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}]"
