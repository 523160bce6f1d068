"""Fixed values. Results depend on each of them, so they are stated plainly here."""

# How a line of type is classed (sizes are ratios to the body size).
SIZE_RATIO = 1.1
MAX_HEADING_CHARS = 90
BOLD_SATURATION = 0.35
STYLE_SIZE_DIFF = 0.6

# Gaps between lines, in line heights unless named points.
LINE_GAP_RATIO = 1.1
LINE_OVERLAP_RATIO = 0.5
OUTDENT_RATIO = 0.9
COLUMN_GAP_RATIO = 0.6
MIN_COLUMN_GAP = 3.0
BAND_GAP_RATIO = 0.6
DEFAULT_LINE_HEIGHT = 10.0

# Lists and heading levels.
INDENT_TOLERANCE = 3
DETAIL_INDENT = 2.0
DETAIL_REACH = 2.5
LEVEL_RATIO = 0.92
MAX_LEVEL = 4
LIST_ROLES = ("bullet", "numbered", "alpha", "roman")
ROLES = ("heading", "para", "bullet", "numbered", "alpha", "roman", "image")
CHOICES = ("keep", "hide", "delete")

# Joining runs into lines.
BASELINE_OVERLAP = 0.5
BASELINE_SHIFT = 0.8
SAME_SIZE = 1.25
JOIN_GAP_RATIO = 0.6
MARKER_GAP_RATIO = 3.0
WORD_SPACE = 2.5
GUTTER_LOOK = 5
GUTTER_LINES = 3
GUTTER_CLEAR = 3
GUTTER_INSET = 0.15
SPACE_GAP_RATIO = 0.15

# How far a glyph's ink reaches, in font sizes.
CAP_HEIGHT = 0.7
X_HEIGHT = 0.5
DESCENDER = -0.22
DEFAULT_ASCENT = 0.9
DEFAULT_DESCENT = -0.21

# Fixed value: how long one page may take, in seconds.
PAGE_SECONDS = 120.0

# Links and pictures.
LINK_COVER = 0.5
MIN_PICTURE_PT = 4
MIN_PICTURE_PX = 64
BIG_ENOUGH_PT = 24
PICTURE_SLOP = 2.0
PICTURE_TIE = 6.0

# Running headers, footers and page numbers.
MARGIN_FRACTION = 0.12
MIN_PAGES = 2
MARGIN_SHARE = 0.5

# Decisions.
UNDO_DEPTH = 100

# Scoring converters.
TEXT_LAYER_CUTOFF = 0.8
UNQUOTED_MIN = 200
SLACK_EVERY = 10
WORDS_PER_QUOTE = 8
MIN_QUOTE_LETTERS = 24
STRETCH_LETTERS = 30

# Ingest limits, in bytes unless counts.
MAX_FILE = 512 * 1024 * 1024
MAX_INFLATED = 512 * 1024 * 1024
MAX_ENTRIES = 10_000
MAX_DROP = 4 * 1024 * 1024 * 1024
MAX_MANIFEST = 16 * 1024 * 1024
RESERVE = 2
MAX_NAME = 80
MAX_SEGMENT_BYTES = 248

# Versions of the stored shapes.
ANALYSIS_FORMAT = 1
READER_VERSION = 5
EDITS_VERSION = 1
MANIFEST_FORMAT = 1

# The manifest's file name is ours to choose; pass another to the path functions.
MANIFEST_NAME = "manifest.json"
SOURCES_DIR = "sources"
MARKDOWN_DIR = "markdown"

# White space as a regex class: every Unicode space, not only the ASCII ones
# that Java's \s knows.
WS = (
    r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
)
WS_IN_CLASS = WS[1:-1]
