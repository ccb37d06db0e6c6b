"""Token counts of a public tokenizer, from its vocabulary file."""

from __future__ import annotations

import base64

import regex
import tiktoken

#: Default place of the vocabulary file; every operator takes another as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the tokenizer divides a text before it looks up byte pairs.
DIVISION = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, tiktoken.Encoding] = {}
_division = regex.compile(DIVISION)


def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, read once per Python worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("corpus", pat_str=DIVISION, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


#: Runs of blanks from this length on overflow the tokenizer's own search for divisions; these are found by another engine.
LONG_BLANKS = 10_000
_blanks = regex.compile(rf"\s{{{LONG_BLANKS}}}")


def count(enc: tiktoken.Encoding, text: str) -> int:
    """Tokens of a text, whatever it holds."""
    if len(text) < LONG_BLANKS or not _blanks.search(text):
        return len(enc.encode_ordinary(text))
    return sum(n for *_, n in _divisions(enc, text))


def _divisions(enc: tiktoken.Encoding, text: str):
    """(start, end, tokens) of the tokenizer's divisions."""
    for m in _division.finditer(text):
        a, b = m.span()
        yield a, b, _size(enc, text[a:b])


def _size(enc: tiktoken.Encoding, division: str) -> int:
    """Tokens of one division or a part of one."""
    return len(enc._encode_single_piece(division)) if len(division) >= LONG_BLANKS and division.isspace() else len(enc.encode_ordinary(division))


def cut(enc: tiktoken.Encoding, text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive stretches of text, each of at most capacity tokens.

    Cuts stand between the tokenizer's own divisions, where both sides keep their tokens; only a
    division that exceeds the capacity by itself is cut inside.
    """
    total = count(enc, text)
    if total <= capacity:
        return [(0, len(text), total)]
    out: list[tuple[int, int, int]] = []
    start = end = held = 0
    for a, b, n in _divisions(enc, text):
        if held + n > capacity and held:
            out.append((start, end, held))
            start, held = end, 0
        if n <= capacity:
            held += n
        else:
            at = a
            while at < b:
                # a character has at most four bytes, so four tokens
                stop = min(b, at + max(1, capacity // 4))
                while stop < b and _size(enc, text[at : stop + max(1, capacity // 8)]) <= capacity:
                    stop = min(b, stop + max(1, capacity // 8))
                out.append((at, stop, _size(enc, text[at:stop])))
                at = stop
            start, held = b, 0
        end = b
    if held:
        out.append((start, end, held))
    return out
