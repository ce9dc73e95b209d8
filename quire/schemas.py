"""Schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the triage rules this engine reproduces).
# ---------------------------------------------------------------------------
# Paper ID: four digits, a dot, four or five digits; first match; no version.
ID_PATTERN = r"(\d{4}\.\d{4,5})"
# Code hosts used by enrichment; the paper card also accepts bitbucket.org.
CODE_HOSTS = ("github.com", "gitlab.com", "huggingface.co")
# GitHub pages that are never a repository (matched after "https://").
GITHUB_NOISE = (
    "github.com/features", "github.com/nerfies", "github.com/settings",
    "github.com/login", "github.com/join", "github.com/about",
    "github.com/security", "github.com/pricing", "github.com/enterprise",
)
# Path parts that mark a file inside a repository rather than the repository.
CODE_PATH_SKIP = ("/Assets/", "/blob/", "/raw/", "/tree/")
# Image rules: minimum accepted size, fallback figures tried, skip words.
MIN_IMAGE_BYTES = 500
MAX_FIGURES = 3
FIGURE_SKIP_WORDS = ("icon", "badge", "logo", "favicon", "arxiv-logo")
IMAGE_KEYWORDS = "teaser|banner|pipeline|overview|fig"
IMAGE_EXTENSIONS = "png|jpg|jpeg|webp"
# Result cache is valid above this many bytes; snapshots warn below 1000 bytes
# and expire after more than 30 whole days.
CACHE_MIN_BYTES = 10
SNAPSHOT_MIN_BYTES = 1000
SNAPSHOT_RETENTION_DAYS = 30
# Author caps: five plus a count in the Markdown digest, three on the card.
DIGEST_AUTHOR_CAP = 5
CARD_AUTHOR_CAP = 3
# Criteria document sections and the tier each one maps to.
SECTION_TIERS = {
    "Primary Topics": "high",
    "Secondary Topics": "moderate",
    "Lower Priority": "low",
    "Exclude": "exclude",
}

# ---------------------------------------------------------------------------
# Record schemas. Sources are always read with these; nothing is inferred.
# ---------------------------------------------------------------------------
PAPER = T.StructType([
    T.StructField("paper_id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("abstract", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("abs_url", T.StringType()),
])


# Catalog row: content columns + sticky user state. date_added is the
# partition column of the stored table.
CONTENT_COLUMNS = ("title", "authors", "abstract", "comment", "categories",
                   "published", "pdf_url", "abs_url", "relevance_tier",
                   "relevance_summary")
STATE_COLUMNS = ("date_added", "is_favourite", "favourite_note", "is_dismissed",
                 "thumbnail", "code_url", "project_url")

CATALOG = T.StructType([
    T.StructField("paper_id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("abstract", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("published", T.StringType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("abs_url", T.StringType()),
    T.StructField("relevance_tier", T.StringType()),
    T.StructField("relevance_summary", T.StringType()),
    T.StructField("date_added", T.DateType()),
    T.StructField("is_favourite", T.BooleanType()),
    T.StructField("favourite_note", T.StringType()),
    T.StructField("is_dismissed", T.BooleanType()),
    T.StructField("thumbnail", T.StringType()),
    T.StructField("code_url", T.StringType()),
    T.StructField("project_url", T.StringType()),
])

# Judge envelope (the raw output of one scorer call).
STAGE1_OUTPUT = T.StructType([
    T.StructField("candidate_ids", T.ArrayType(T.StringType())),
])
STAGE2_PAPER = T.StructType([
    T.StructField("arxiv_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("abstract", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("published", T.StringType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("abs_url", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("relevance_tier", T.StringType()),
    T.StructField("relevance_summary", T.StringType()),
])
STAGE2_OUTPUT = T.StructType([
    T.StructField("papers", T.ArrayType(STAGE2_PAPER)),
])
# Fields the stage-2 output must carry for a paper to be accepted.
STAGE2_REQUIRED = ("arxiv_id", "title", "authors", "abstract", "published",
                   "pdf_url", "abs_url", "relevance_tier", "relevance_summary")

