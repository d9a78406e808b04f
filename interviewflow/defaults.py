"""Fixed values the results depend on, all in one place.

None of these is logic: they are the word lists, patterns and sizes an
existing user's tables were made with. Each is the default of a parameter.
"""

# Cell texts that count as missing when a table is read.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Code points that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\u00a0\u1680"
    r"\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)

# Accepted column names.
ID_NAMES = (
    "Participant_ID",
    "participant_id",
    "PARTICIPANT_ID",
    "ParticipantId",
    "participantId",
    "Pariticipant_ID",
    "ID",
    "id",
)
ID_NAME_PARTS = (("participant", "id"), ("pariticipant", "id"))
TEXT_NAMES = ("Text", "text", "TEXT")

# Patterns for selection columns, tried in this order.
SELECTION_PATTERNS = (
    r".*Selected.*Rational[e]?.*Number.*",
    r".*Selected.*Ration.*",
    r".*Selection.*",
)

# Prefixes of numbered candidate columns, by precedence.
CANDIDATE_PREFIXES = ("Rational_", "Rationale_", "Rationales_", "Rational", "Rationale")

# How many candidates are kept, by how many there are.
PICKS_RULE = {30: 5, 15: 5, 5: 1}
PICKS_DEFAULT = 1

# Label spellings of the three prediction corpora.
LABELS_DEPRESSION = {"non-depressed": 0, "depressed": 1}
LABELS_DEPRESSION_SPOKEN = {
    "Non-depressed.": 0,
    "Non-depressed": 0,
    "non-depressed": 0,
    "depressed": 1,
    "Depressed": 1,
}
LABELS_PTSD = {"non-PTSD": 0, "Non-PTSD": 0, "PTSD": 1}

# Texts put in place of missing prompt fields.
PROMPT_FALLBACKS = {"gender": "patient", "transcript": "", "status": "unknown"}
NO_PROMPT_VALUE = "No specific prompt provided."
NO_PROMPT_COLUMN = "No prompt column found in the data."
USER_TURN = "Medical Rationale: "

# Fixed value: a candidate in a selection request.
BLOCK_MARKS = "\n--- RATIONALE {number} ---\n{text}\n"

# Texts of label 0 and label 1.
STATUS_TEXTS = ("non-depressed", "depressed")

# Sizes and marks of the two preview columns.
CELL_LIMIT = 30000
CELL_SUFFIX = "... (총 {length} 자)"
PREVIEW_SIZES = (1000, 500, 10000)
PREVIEW_MARK = "\n...[중략]...\n"

# Seeds of the two exemplar draws.
SEED_WITH_REUSE = 42
SEED_NO_REUSE = 20250508

# Ids corrected when the caller names none.
CORRECTED_IDS = (325, 335, 352, 356, 380, 386, 409, 413, 418, 422, 459, 483, 633, 682, 691, 696, 709)

# Picks used for these ids when their cells hold none.
DEFAULT_PICKS = {
    302: (5, 10, 14, 21, 26, 1, 4, 7, 11, 17),
    303: (5, 10, 18, 23, 29, 17, 20, 25, 30),
    304: (3, 8, 12, 19, 25, 2, 6, 10, 15, 22),
    305: (7, 11, 16, 22, 28, 4, 9, 13, 18, 24),
    307: (2, 9, 15, 20, 27, 5, 11, 16, 21, 26),
    308: (1, 6, 12, 18, 24, 3, 8, 14, 19, 25),
    309: (4, 10, 16, 23, 29, 2, 7, 13, 18, 24),
    707: (6, 12, 16, 22, 27, 5, 11, 25),
}
