"""Curation of text-to-SQL corpora and query logs as Spark jobs."""

from .config import CLEAN, COMPAT, DIALECTS, CurationConfig
from .functions.labels import label_array, labels_text, semantic_description, short_hash, slug, tool_key, tool_name
from .functions.quality import score_breakdown, total_score
from .functions.templates import extract_templates
from .operators.catalogue import merge_catalogue
from .operators.curate import catalogue_layout, create_tools, curate, curate_viewer, validate, with_status
from .operators.normalize import normalize
from .sources.corpus import corpus_from_lines, read_corpus
from .sources.sinks import write_corpus

__all__ = [
    "CLEAN",
    "COMPAT",
    "DIALECTS",
    "CurationConfig",
    "catalogue_layout",
    "corpus_from_lines",
    "create_tools",
    "curate",
    "curate_viewer",
    "extract_templates",
    "label_array",
    "labels_text",
    "merge_catalogue",
    "normalize",
    "read_corpus",
    "score_breakdown",
    "semantic_description",
    "short_hash",
    "slug",
    "tool_key",
    "tool_name",
    "total_score",
    "validate",
    "with_status",
    "write_corpus",
]
