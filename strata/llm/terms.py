"""Terms of a text: runs of digits, ASCII letters and characters beyond ASCII, with A-Z lower-cased."""

from __future__ import annotations

#: Bytes of UTF-8: digits, a-z and all from 0x80 on stay, A-Z fall, the rest are blanks.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; a null text has none."""
    return text.encode().translate(_TABLE).split() if text else []
