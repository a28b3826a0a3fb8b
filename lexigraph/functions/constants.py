"""Word lists, patterns, weights and labels the results depend on."""

# ---- fixed values: text ----------------------------------------------------

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

KEYWORD_STOPWORDS = """
a an and are as at be by for from
has he in is it its of on that the
to was will with the this but they have
had what said each which their time if
up out many then them these so some her
would make like into him has two more
very after words long than first been call
who oil sit now find down day did get
come made may part
""".split()

BIGRAM_COMMON_WORDS = "a an the is are was were be been being can should will would".split()

QUESTION_STOPWORDS = """
who what when where why how is was were are
the a an in on at to for of with by
from as be been being have has had do does
did will would should could may might must can
""".split()

FILE_EXTENSIONS = "pdf txt csv xlsx xls ods xlsm".split()

PARSER_BY_EXTENSION = {
    ".pdf": "pdf",
    ".txt": "txt",
    ".text": "txt",
    ".csv": "csv",
    ".xlsx": "spreadsheet",
    ".xls": "spreadsheet",
    ".xlsm": "spreadsheet",
    ".ods": "spreadsheet",
}

# ---- fixed values: entities ------------------------------------------------

NAME_PATTERN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
DATE_PATTERN = (
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},?\s+\d{4}\b"
)
YEAR_PATTERN = r"\b(?:19|20)\d{2}\b"
PROPER_NOUN_PATTERN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"

ENTITY_TYPE_BY_LABEL = {
    "PERSON": "PER",
    "PER": "PER",
    "ORG": "ORG",
    "ORGANIZATION": "ORG",
    "GPE": "LOC",
    "LOC": "LOC",
    "LOCATION": "LOC",
    "DATE": "DATE",
    "TIME": "TIME",
    "MONEY": "MONEY",
    "PERCENT": "PERCENT",
    "FACILITY": "FAC",
    "PRODUCT": "PRODUCT",
    "EVENT": "EVENT",
    "LAW": "LAW",
    "LANGUAGE": "LANGUAGE",
    "NORP": "NORP",
    "WORK_OF_ART": "WORK_OF_ART",
    "ORDINAL": "ORDINAL",
    "CARDINAL": "CARDINAL",
    "QUANTITY": "QUANTITY",
    "OTHER": "OTHER",
}

ENTITY_DESCRIPTIONS = {
    "PER": "Person names indicate human beings being mentioned",
    "ORG": "Organization name indicate companies, agencies, institutions, none-profits, etc.",
    "LOC": "Locations indicate physical places like mountains, lakes, etc.",
    "GPE": "Geopolitical entities indicate countries, cities, states, etc.",
    "PRODUCT": "Products indicate objects, vehicles, foods, etc. (not services)",
    "EVENT": "Events indicate named hurricanes, battles, wars, sports events, etc.",
    "FAC": "Facilities indicate buildings, airports, highways, bridges, etc.",
    "WORK_OF_ART": "Works of art indicate titles of books, songs, etc.",
    "LAW": "Laws indicate named documents made into laws.",
    "NORP": "NORP indicates nationalities or religious or political groups.",
    "DATE": "Dates indicate absolute or relative dates or periods.",
    "TIME": "Times indicate times smaller than a day.",
    "MONEY": "Money indicates monetary values, including unit.",
    "PERCENT": "Percent indicates percentage values.",
    "LANGUAGE": "Language indicates any named language.",
    "ORDINAL": "Ordinal indicates ordinal numbers (first, second, etc.).",
    "CARDINAL": "Cardinal indicates cardinal numbers that do not fall under another type.",
    "QUANTITY": "Quantity indicates measurements, such as weight or distance.",
    "OTHER": "Not a recognized entity type",
}

NODE_LABEL_TYPES = (
    "PER LOC ORG DATE TIME MONEY PERCENT GPE NORP FAC PRODUCT EVENT WORK_OF_ART "
    "LAW LANGUAGE QUANTITY ORDINAL CARDINAL"
).split()

ENTITY_KEYWORD_WEIGHTS = {
    "PER": 1.0, "ORG": 0.9, "LOC": 0.8, "GPE": 0.8,
    "PRODUCT": 0.7, "EVENT": 0.7, "FAC": 0.6, "WORK_OF_ART": 0.6,
    "LAW": 0.5, "LANGUAGE": 0.5, "DATE": 0.4, "TIME": 0.3,
    "MONEY": 0.3, "PERCENT": 0.2, "ORDINAL": 0.2, "CARDINAL": 0.1, "QUANTITY": 0.1,
    "OTHER": 0.1,
}
ENTITY_KEYWORD_DEFAULT_WEIGHT = 0.5

# ---- fixed values: questions (declaration order breaks ties) ---------------

QUESTION_TYPES = {
    "WHO": {
        "description": "Person-focused query",
        "patterns": [
            r"\bwho\b", r"\bwhom\b", r"\bwhose\b",
            r"\bwhich person\b", r"\bwhat person\b", r"\bname the person\b",
        ],
        "weights": {"PER": 2.0, "ORG": 0.5, "LOC": 0.3, "DATE": 0.8},
    },
    "WHERE": {
        "description": "Location-focused query",
        "patterns": [
            r"\bwhere\b", r"\bwhich place\b", r"\bwhich location\b", r"\bwhat location\b",
            r"\bin which (city|state|country|place)\b", r"\bwhat (city|state|country|place)\b",
        ],
        "weights": {"LOC": 2.0, "GPE": 2.0, "FAC": 1.5, "PER": 0.5, "ORG": 0.7, "DATE": 0.5},
    },
    "WHEN": {
        "description": "Time-focused query",
        "patterns": [
            r"\bwhen\b", r"\bwhat time\b", r"\bwhat date\b", r"\bwhat year\b",
            r"\bin which year\b", r"\bhow long\b", r"\bwhat period\b",
        ],
        "weights": {"DATE": 2.0, "TIME": 2.0, "EVENT": 1.5, "PER": 0.8, "ORG": 0.8, "LOC": 0.8},
    },
    "WHAT_ORG": {
        "description": "Organization-focused query",
        "patterns": [
            r"\bwhat (organization|company|agency|institution|department)\b",
            r"\bwhich (organization|company|agency|institution|department)\b",
            r"\bname the (organization|company|agency|institution)\b",
        ],
        "weights": {"ORG": 2.0, "PER": 0.7, "LOC": 0.8, "DATE": 0.8},
    },
    "WHAT_POSITION": {
        "description": "Position/role-focused query",
        "patterns": [
            r"\bwhat (position|role|title|job|office)\b",
            r"\bwhich (position|role|title|job|office)\b",
            r"\bwhat was .* (position|role|title)\b",
            r"\b(attorney general|governor|senator|president|mayor|director)\b",
        ],
        "weights": {"PER": 1.5, "ORG": 1.5, "LOC": 1.2, "DATE": 1.5},
    },
    "HOW_MANY": {
        "description": "Quantity-focused query",
        "patterns": [
            r"\bhow many\b", r"\bhow much\b", r"\bwhat number\b",
            r"\bwhat percentage\b", r"\bwhat amount\b",
        ],
        "weights": {
            "CARDINAL": 2.0, "MONEY": 2.0, "PERCENT": 2.0, "QUANTITY": 2.0,
            "DATE": 1.0, "PER": 0.8, "ORG": 0.8, "LOC": 0.8,
        },
    },
    "WHY": {
        "description": "Reason-focused query",
        "patterns": [r"\bwhy\b", r"\bwhat reason\b", r"\bwhat cause\b", r"\bwhy did\b"],
        "weights": {"EVENT": 1.5, "PER": 1.2, "ORG": 1.2, "DATE": 1.2, "LOC": 1.0},
    },
    "WHAT_EVENT": {
        "description": "Event-focused query",
        "patterns": [
            r"\bwhat (event|incident|occurrence|happening)\b",
            r"\bwhich (event|incident|occurrence)\b",
            r"\bwhat happened\b",
        ],
        "weights": {"EVENT": 2.0, "DATE": 1.5, "LOC": 1.3, "PER": 1.2, "ORG": 1.2},
    },
}
GENERAL_QUESTION = ("GENERAL", "General query")

# ---- fixed values: ranking -------------------------------------------------

TEMPORAL_FIELDS = ["term_start", "term_end", "start_date", "end_date", "year", "date"]

WEIGHT_CONNECTION = 0.15
WEIGHT_TEMPORAL = 0.20
WEIGHT_QUERY_MATCH = 0.20
WEIGHT_ENTITY_TYPE = 0.15
SEARCH_RESULT_LIMIT = 20
SEARCH_TOP_K = 5

MATCH_NAME = 3.0
MATCH_PROPER_NOUN = 2.0
MATCH_SUMMARY = 1.5
MATCH_NEIGHBOURS = 1.0
MATCH_ATTRIBUTES = 1.0
MATCH_LABELS = 0.5

PAGE_SIZE = 5000
TITLE_MAX_CHARS = 100
SNIPPET_CHARS = 100
CONTEXT_WINDOW = 100
TABLE_RULE = "-" * 80
