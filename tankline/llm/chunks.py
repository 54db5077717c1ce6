"""Space-led chunks: pieces of a text that byte-level tokenizers encode independently.

The split pattern of these vocabularies starts a new pre-token at every space that
stands before a visible character, so the text may be cut there and each chunk
encoded (and remembered) alone.  Where a space is followed by white space or ends
the text, the white-space run must be seen whole, and :data:`ODD` tells so.
"""

from __future__ import annotations

import re

#: A space whose run of white space goes on (or ends the text): such texts are not cut.
ODD = re.compile(r" (?:\s|\Z)")


def cuttable(text: str, specials: tuple[str, ...] = ()) -> bool:
    return ODD.search(text) is None and not any(s in text for s in specials)
