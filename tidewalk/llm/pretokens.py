"""Pre-tokens of the byte-level vocabularies: the pieces of text that merges don't cross."""

from __future__ import annotations

import re
from collections import Counter

import regex

#: Fixed pattern of the vocabulary, with white space spelled as the Unicode property that its library uses.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


# The same pattern with the letters, numbers and white space below U+0250 spelled out, for the faster standard module.
_LETTERS, _NUMBERS, _SPACE = "A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u024F", "0-9\xB2\xB3\xB9\xBC-\xBE", "\t-\r \x85\xA0"
LATIN = re.compile(r"[\x00-\u024F]*+")
LATIN_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Characters whose Unicode category no version since 13 has changed; a text with others is split by the library itself.
SETTLED = regex.compile(r"[\x00-\u0530\u1E00-\u1EFF\u2000-\u2064\u20A0-\u20BF\u2190-\u21FF\u3000-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\U0001F300-\U0001F5FF]*+")


def pretokens(text: str, tokenizer) -> list[str]:
    if text.isascii() or LATIN.fullmatch(text):
        return LATIN_PATTERN.findall(text)
    if SETTLED.fullmatch(text):
        return PATTERN.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def pretoken_counts(text: str | None, tokenizer, specials: list[str]) -> Counter:
    """How often each pre-token stands in the text; special strings count as one pre-token each."""
    if not text:
        return Counter()
    parts, out = [text], Counter()
    for special in specials:
        if special in text:
            split = [part.split(special) for part in parts]
            out[special] = sum(len(x) - 1 for x in split)
            parts = [x for y in split for x in y]
    if len(parts) == 1:
        return Counter(pretokens(text, tokenizer))
    for part in parts:
        out.update(pretokens(part, tokenizer))
    return out
