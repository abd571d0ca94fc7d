"""Parameter defaults and literal values."""

# Follower buckets as (order, label, exclusive lower edge, inclusive upper edge).
FOLLOWER_BUCKETS = (
    (1, "<100", 0, 100),
    (2, "100-1K", 100, 1000),
    (3, "1K-10K", 1000, 10000),
    (4, ">10K", 10000, None),
)

# Markers and formats found in the platforms' data.
UNKNOWN = "unknown"
DELETED = "[deleted]"
REMOVED = "[removed]"
ERROR = "[error]"
NOT_AVAILABLE = "N/A"
WATCH_URL_PREFIX = "https://www.youtube.com/watch?v="

# Lines of the summary report, and where blank ones stand (by order number).
REPORT_RULE, REPORT_THIN_RULE = "=" * 70, "-" * 70
REPORT_HEAD, REPORT_BUCKETS = "KEY FINDINGS:", "2. Moderation rates by follower count:"
REPORT_BLANKS = (3, 31, 999)

# Rows kept per author, community and video search, and text cuts.
POSTS_PER_AUTHOR = 50
POSTS_PER_COMMUNITY = 100
VIDEOS_PER_TERM = 10
BODY_CHARS = 500
PREVIEW_CHARS = 100
TITLE_CHARS = 50
TOP_LABELS = 10
SAMPLE_POSTS = 5
VIDEO_REGION = "US"
VIDEO_TYPE = "video"
