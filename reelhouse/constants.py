"""Fixed values.

These must equal the values the original application uses, or stored links,
lengths, dates and categories would not line up with what it wrote.  They are
stated once, here, in the order the application applies them.
"""

# ---- Fixed values (must match the original application) --------------------

# Video length: one or two digits, colon, two digits, optional colon + two
# digits; anything else that is present becomes "00:00".
LENGTH_PATTERN = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"
LENGTH_FALLBACK = "00:00"
# Badge texts that mean "no length yet" (compared upper-cased).
NO_LENGTH_BADGES = ("UPCOMING", "LIVE")

# Watched-progress bar style, e.g. "width: 61%;".
PROGRESS_PATTERN = r"width:\s*([0-9]+)%"

# A metadata span is a date if it contains one of these words.
DATE_WORDS = ("ago", "hour", "day", "week", "month", "year")

# Links: relative links get the site prefix; the query string is cut at "&".
SITE_BASE = "https://www.youtube.com"
# Thumbnail fallback from the "v=" parameter of the link.
VIDEO_ID_PATTERN = r"[?&]v=([^&]+)"
THUMBNAIL_TEMPLATE = ("https://i.ytimg.com/vi/", "/hqdefault.jpg")

# Model output: a first line "Here is/are/'s ..." followed by a blank line is
# dropped ("." written as [^\n] so Java and RE2 agree with Python).
PREAMBLE_PATTERN = r"^Here( are| is|'s)\s[^\n]*?\n\n"

# Free-form category answers.
CATEGORY_PREFIX = "Category: "
BOLD_PATTERN = r"\*\*([^*]+)\*\*"
UNCATEGORIZED = "Uncategorized"
MAX_CATEGORY_WORDS = 3
CATEGORY_RETRIES = 3

# Caption track used for transcripts (automatic English).
CAPTION_TRACK = "a.en"

# Model sizes: input cap, summary/themes target sizes, passes, chunks.
MODEL_INPUT_CHARS = 4096
SUMMARY_SIZE = 4096
THEMES_SIZE = 1024
SHORTENING_PASSES = 4
MAX_CHUNKS = 5
MAX_TOKENS = 8192          # chunk size is MAX_TOKENS // 2 characters

# Home view and work queues: newest first, page size.
PAGE_SIZE = 50

# Snapshots: one per day, stamp yyyyMMdd, keep the latest five.
SNAPSHOT_KEEP = 5
SNAPSHOT_DATE_FORMAT = "yyyyMMdd"

# Feed markup: card element, skip markers, ordered link selectors, fields.
CARD_TAG = "ytd-rich-item-renderer"
AD_TAG = "ytd-ad-slot-renderer"
SPONSORED_TEXT = "Sponsored"
COLLECTION_CLASS = "ytCollectionsStackCollectionStack2"
# (tag, class, id); None = any
LINK_SELECTORS = (
    ("a", "yt-lockup-metadata-view-model__title", None),
    ("a", "yt-lockup-view-model__content-image", None),
    ("a", None, "thumbnail"),
)
TITLE_SELECTOR = ("h3", "yt-lockup-metadata-view-model__heading-reset")
METADATA_ROW_CLASS = "yt-content-metadata-view-model__metadata-row"
METADATA_TEXT_SELECTOR = ("span", "yt-content-metadata-view-model__metadata-text")
THUMBNAIL_IMAGE_CLASS = "ytThumbnailViewModelImage"
LENGTH_BADGE_TAG = "yt-thumbnail-badge-view-model"
LENGTH_TEXT_CLASS = "yt-badge-shape__text"
PROGRESS_CLASS = "ytThumbnailOverlayProgressBarHostWatchedProgressBarSegment"

# ---- End of fixed values ----------------------------------------------------

# Python's str.strip() whitespace, as one character class that Java regex and
# RE2 read the same way (Spark's trim() only removes spaces).
WHITESPACE_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
