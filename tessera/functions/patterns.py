"""Fixed values that must equal the original tool chain's for matching output.

All patterns avoid look-around and back-references, so the same text runs on
Java regex (Spark) and RE2 (DuckDB oracle).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (behavioural constants; do not edit without re-checking parity)
# ---------------------------------------------------------------------------

# Numeric citation marks like "[12]" are removed; any other bracketed run on
# one line is put back unchanged ("$1"), so "[[3]]" and "[]" survive.
NUMERIC_BRACKETS = r"\[\p{Nd}+\]|(\[[^\]\n]*\])"

# Unicode word runs (letters, digits, underscore) = Python's \w+ on text.
WORD_RUN = r"[\p{L}\p{N}_]+"

# Anything outside 7-bit ASCII.
NON_ASCII = r"[^\x00-\x7F]"

# Document id inside a file name "id_<id>.<ext>".
ID_FROM_FILE_NAME = r"^id_([^.]*)"

# A blank line (only white space, Unicode-aware so no-break space counts).
BLANK_LINE = r"(?U)^\s*$"

# The literal prefix removed from category names in text.
CATEGORY_PREFIX = "Category:"

# File name parts of one document per file.
DOC_FILE_PREFIX = "id_"
DOC_FILE_SUFFIX = ".txt"

# English stop list (the classic 179-word list of the NLTK corpus), in its
# natural order.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd "
    "your yours yourself yourselves he him his himself she she's her hers "
    "herself it it's its itself they them their theirs themselves what which "
    "who whom this that that'll these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as "
    "until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t "
    "can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't "
    "shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't"
).split()

# Noun suffix rules (suffix, replacement) in rule order; the word itself is
# also a candidate and comes first.
NOUN_SUFFIX_RULES = (
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
    ("s", ""),
)

# Wiki markup to plain text, applied in this order; each with DOTALL.
WIKI_DROP = (
    r"(?s)<!--.*?-->",
    r"(?s)<ref[^>]*/>",
    r"(?s)<ref[^>]*>.*?</ref>",
)
WIKI_TEMPLATE = r"\{\{[^{}]*\}\}"      # innermost templates; applied as often as they nest
WIKI_TEMPLATE_MARK = r"\{\{|\}\}"
WIKI_TEMPLATE_RUN = r"\{\{+|\}\}+"    # a run counts as many marks of two
WIKI_TABLE_MARK = r"(?m)^[ \t:]*\{\||^[ \t]*\|\}"
WIKI_LINK_MARK = r"\[\[|\]\]"
WIKI_INNER_LINK = r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]"
WIKI_TABLE = r"(?s)\{\|.*?\|\}"
WIKI_PIPED_LINK = r"\[\[[^\]|]*\|([^\]]*)\]\]"
WIKI_LINK = r"\[\[([^\]]*)\]\]"
WIKI_EXTERNAL_LINK = r"\[https?://\S+ ([^\]]*)\]"
WIKI_EMPHASIS = r"'{2,5}"
WIKI_HEADING = r"(?m)^=+\s*(.*?)\s*=+\s*$"
WIKI_TAG = r"<[^>]+>"

# HTML to plain text.
HTML_DROP = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?s)<!--.*?-->",
)
HTML_TAG = r"<[^>]*>"
HTML_ENTITIES = (          # &amp; goes last so "&amp;lt;" is not decoded twice
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "\u00a9"),
    ("&middot;", "\u00b7"),
    ("&amp;", "&"),
)
CHARACTER_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
HTML_SPACE_RUN = r"[ \t\n\r\f]+"

# Training settings of the original scripts (used as defaults).
W2V_VECTOR_SIZE = 200
W2V_WINDOW = 5
W2V_MIN_COUNT = 5
W2V_EPOCHS = 5
W2V_STEP = 0.025
LOGISTIC_BATCH = 6
MLP_BATCH = 20
MLP_HIDDEN = 500
CONV_BATCH = 500
IMPROVEMENT_THRESHOLD = 0.995
PAD_VALUE = -1
