"""Words of a text."""

from __future__ import annotations

#: ASCII other than letters and digits parts words; other characters belong to them.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | str | None) -> list[bytes]:
    """Lower-case words, as UTF-8."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return (raw.lower() if raw.isascii() else raw.decode().lower().encode()).translate(_PARTS).split()
