"""The patterns and messages whose text decides the results."""

# Fixed values. Named cleaning patterns (Java regular expressions).
PATTERNS = {
    "punctuation": r"[^a-zA-Z0-9]",
    "digits": r"\b\d+\b",
    "alphanumerics": (
        r"(\b[0-9]+[a-zA-Z]+\b)|(\b+[a-zA-Z]+[0-9]+\b)|(\b[a-zA-Z]+[0-9]+[a-zA-Z]+\b)"
    ),
    "white_space": r"\s+",
    "small_words": r"\b[a-zA-Z0-9]{1,2}\b",
    "urls": r"(https?\://)\S+",
}

# Fixed value. Order in which the named patterns clean a lower-cased text.
CLEANING_ORDER = ("urls", "punctuation", "digits", "small_words", "alphanumerics", "white_space")

# Fixed value. Characters of a text that counts as plain English.
ALLOWED_CHARACTERS = r"^[a-zA-Z0-9$@$!%*?&#^-_. +]+$"

# Fixed value. Answer for a record whose description is not English.
UNSUPPORTED_LANGUAGE = "Not supported language"

# Fixed values. Model settings.
HASH_BUCKETS = 10_000
SMOOTHING = 0.001
DEFAULT_SMOOTHING = 1.0
LINEAR_BUCKETS = 20
LINEAR_ITERATIONS = 100
LINEAR_REGULARIZATION = 0.03
LINEAR_ELASTIC_NET = 0.8

# A word that cleaning keeps, in a lower-cased text without addresses: a whole run of letters
# and digits that the digit, small-word and mixed-word patterns would not blank out. The first
# branch is the usual case. Possessive and free of nested repeats, so a match takes time linear
# in its length and no stack, however long the text is.
KEPT_WORD = (
    r"(?<![a-z0-9])(?:[a-z]{3,}+(?![a-z0-9])"
    r"|(?!(?:[0-9]++[a-z]*+|[a-z]++[0-9]++[a-z]*+|[a-z0-9]{1,2}+)(?![a-z0-9]))[a-z0-9]++)"
)
