"""Driver-side twins of a few text functions, for constants that build expressions."""

from __future__ import annotations

import re
import unicodedata


def strip_marks(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def fold(s: str | None) -> str:
    """Twin of ``norm_alnum``."""
    return re.sub(r"[^a-z0-9]+", " ", strip_marks((s or "").lower())).strip()


def fold_space(s: str | None) -> str:
    """Twin of ``norm_nfd_space``."""
    return re.sub(r"\s+", " ", strip_marks(re.sub(r"[-_']", " ", (s or "").lower()))).strip()


def fold_translate(s: str | None) -> str:
    """Twin of ``norm_translate``."""
    return strip_marks(re.sub(r"\s+", " ", s or "").strip().lower().replace("-", " "))


def slug(s: str | None) -> str:
    """Twin of ``norm_slug``."""
    t = unicodedata.normalize("NFD", s or "").encode("ascii", "ignore").decode().lower().replace("'", " ")
    t = re.sub(r"\bste\b", "sainte", re.sub(r"\bst\b", "saint", t))
    return re.sub(r"[^a-z0-9]+", "-", t).strip("-")
