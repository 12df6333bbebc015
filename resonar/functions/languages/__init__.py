"""Search keys by sound, and query variants, for each language."""

from .backends import BACKENDS, Backend, backend_for, detect_language, detect_language_of

__all__ = ["BACKENDS", "Backend", "backend_for", "detect_language", "detect_language_of"]
