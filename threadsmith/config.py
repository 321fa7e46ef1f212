"""Run parameters of a curation job.

Every knob of the original command line becomes a field here; the fixed
thresholds of the original tool are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- fixed values (must equal the original tool for identical results) -----
POSTS_PER_PAGE = 20            # positions 0..19 on a forum page
SHORT_POST_CHARS = 1000        # post text shorter than this is "short"
IMAGE_POST_MIN_IMAGES = 3      # hosted images needed for an image chapter
IMAGE_POST_MAX_CHARS = 300     # text of an image chapter is shorter than this
IDENTIFIER_WINDOW = 200        # identifiers are searched in this many chars
DEDUP_PREFIX_CHARS = 100       # duplicate test compares this prefix
EXCERPT_CHARS = 50             # log excerpt length
BIG_STORY_BYTES = 3670016      # documents of this size or more are split
BLOCKS_PER_PART = 30           # blocks per split part
PAGE_DIGIT_RUN = 4             # the page number is the 4th digit run of a link
DEFAULT_IDENTIFIERS = ("chapitre",)
IMAGE_KEYWORDS = "screen|repost|supprime"
STORY_TAG = "risitas"          # tag word removed from titles in file names
DELETED_AUTHOR = "Pseudo supprimé"
UNKNOWN_AUTHOR = "unknown"
ARCHIVE_HOST = "web.archive.org"
SITE_A = "jeuxvideo.com"
SITE_B = "jvarchive.com"
FULLSIZE_MARKER = "fichiers"
ASSET_FOLDER = "risitas-html/images"   # where rewritten image sources point to
STORY_HEADER = (
    "<!DOCTYPE html>\n<html lang='fr'>\n<head>\n<meta charset='UTF-8'>\n"
    "<meta name='viewport' content='width=device-width, initial-scale=1.0'>\n"
    "<title>Risitas</title>\n</head>\n<body>"
)
STORY_FOOTER = "</body>\n</html>"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CurationConfig:
    """Parameters of one curation run (one field per original option)."""

    extra_authors: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = DEFAULT_IDENTIFIERS
    match_author_root: bool = True          # False = --no-match-author
    all_posts: bool = False                 # --all-posts
    resize_images: bool = True              # False = --no-resize-images
    download_images: bool = False           # asset stage on/off
    use_state: bool = True                  # False = --no-database
    # semantics switches: documented intent (default) vs. behaviour as coded
    dedup_as_coded: bool = False
    dedup_across_runs: bool = False         # posts kept by earlier runs count as earlier posts
    identifier_rescues_short: bool = False
    resume_as_coded: bool = True
    replace_video_frames: bool = False      # dead code in the original tool
    # thresholds
    min_chars: int = SHORT_POST_CHARS
    image_min_images: int = IMAGE_POST_MIN_IMAGES
    image_max_chars: int = IMAGE_POST_MAX_CHARS
    identifier_window: int = IDENTIFIER_WINDOW
    dedup_prefix: int = DEDUP_PREFIX_CHARS
    posts_per_page: int = POSTS_PER_PAGE
    blocks_per_part: int = BLOCKS_PER_PART
    big_story_bytes: int = BIG_STORY_BYTES
    page_digit_run: int = PAGE_DIGIT_RUN
    story_tag: str = STORY_TAG
    asset_folder: str = ASSET_FOLDER

    def with_(self, **kw) -> "CurationConfig":
        return replace(self, **kw)
