"""The registered queries of this subpackage."""

from eventloom.llm import (  # noqa: F401
    chat_format,
    decontamination,
    html_extraction,
    importance_resampling,
    jaccard_join,
    license_scan,
    line_dedup,
    packing,
    prefix_trie,
    quality_rules,
    record_files,
    token_counts,
    warc,
)
from eventloom.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
