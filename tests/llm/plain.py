"""Plain versions of operators, for small fixtures."""

import collections


def without_repeats(texts, minimum):
    """Texts without the bytes that strings of ``minimum`` bytes which start more than once cover."""
    raws = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(r[k : k + minimum] for r in raws.values() for k in range(len(r) - minimum + 1))
    out = {}
    for i, r in raws.items():
        gone = bytearray(len(r))
        for k in range(len(r) - minimum + 1):
            if seen[r[k : k + minimum]] > 1:
                gone[k : k + minimum] = b"\1" * minimum
        out[i] = bytes(b for b, g in zip(r, gone, strict=True) if not g).decode("utf-8", "replace")
    return out
