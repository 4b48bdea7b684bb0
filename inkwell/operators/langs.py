"""Fixed language tables for detection and script checks."""

from __future__ import annotations

# Unicode blocks of the Indic languages served (in check order).
SCRIPT_RANGES = {
    "hi": r"[\x{0900}-\x{097F}]",
    "ta": r"[\x{0B80}-\x{0BFF}]",
    "te": r"[\x{0C00}-\x{0C7F}]",
    "kn": r"[\x{0C80}-\x{0CFF}]",
}

# Stop words of the Latin-script languages (in tie-break order).
STOPWORDS = {
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "was", "for", "with", "as", "this", "by",
           "are", "be", "on"],
    "fr": ["le", "les", "et", "est", "une", "des", "du", "qui", "dans", "pour", "sur", "avec", "pas", "au",
           "aux", "ce", "elle"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "sich", "auf",
           "für", "von", "dem", "auch"],
    "es": ["el", "los", "las", "del", "y", "que", "una", "por", "con", "para", "es", "se", "como", "más",
           "pero", "su"],
}
