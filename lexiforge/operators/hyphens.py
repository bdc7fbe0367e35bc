"""Joining of hyphenated lines with the words that the text itself knows."""

from __future__ import annotations

import re
from collections import Counter


def join_lines(lines: list[str], known: Counter | None = None) -> str:
    """Lines as one text. "fore-" and "casting" become forecasting; second-order keeps its hyphen.

    The hyphen goes if the joined word occurs elsewhere in the text; it stays if the compound does or
    both halves occur more than once each; otherwise it goes.
    """
    text = " ".join(lines).lower()
    words = known if known is not None else Counter(re.findall("[a-z]+", text))
    compounds = Counter(re.findall("[a-z]+-[a-z]+", text))
    parts: list[str] = []
    for line in filter(None, (x.strip() for x in lines)):
        tail, head = re.search(r"([A-Za-z]+)-$", parts[-1]) if parts else None, re.match(r"[a-z]+", line)
        if tail and head:
            left, right = tail[1].lower(), head[0].lower()
            keep = not words[left + right] and (compounds[f"{left}-{right}"] or (words[left] > 1 and words[right] > 1))
            parts[-1] = (parts[-1] if keep else parts[-1][:-1]) + line
        else:
            parts.append(line)
    return " ".join(parts)
