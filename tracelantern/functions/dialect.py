"""Python ``re`` syntax to the syntax of the JVM and of Arrow's linear-time engine.

Rule and token patterns follow Python's Unicode reading of ``\\b \\w \\d \\s`` and
of ``.`` and ``$``.  Java reads the same escapes differently (and not the same way
in every release), so they are spelled out as character classes here.
"""

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc

try:  # the parse tree of the standard library; without it word edges look both ways
    from re import _parser
except ImportError:
    _parser = None

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
_CLASSES = {
    "w": _WORD,
    "d": r"\p{Nd}",
    "s": _SPACE,
}
_RE2_CLASSES = {
    "w": _WORD,
    "d": r"\p{Nd}",
    "s": r"\t-\r\x1c- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}",
}
_EDGE = rf"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_NOT_EDGE = rf"(?:(?<![{_WORD}])(?![{_WORD}])|(?<=[{_WORD}])(?=[{_WORD}]))"
_PIECE = re.compile(r"\\.|\[\^?\]?|\{(\d*)(,?)(\d*)\}|.", re.DOTALL)


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Java pattern that finds what ``re.search(pattern, ...)`` finds.

    UNIX_LINES makes ``.`` stop only at ``\\n`` and ``$`` accept a final ``\\n``,
    as in Python; case is ignored by Unicode rules when asked for.
    """
    before, after = "", ""
    if _one_sided(pattern, 0):
        pattern, before = pattern[2:], f"(?<![{_WORD}])"
    if _one_sided(pattern, -1):
        pattern, after = pattern[:-2], f"(?![{_WORD}])"
    flags = "(?idu)" if ignore_case else "(?d)"
    return flags + before + _translate(pattern, _java_escape) + after


def _one_sided(pattern: str, end: int) -> bool:
    """Whether the pattern has a word edge at this end (0 or -1) and, next to it, always
    a word character, so that only the outer side of the edge needs a look."""
    written = pattern.startswith(r"\b") if end == 0 else pattern.endswith(r"\b")
    if _parser is None or not written:
        return False
    tree = list(_parser.parse(pattern))
    edge = (_parser.AT, _parser.AT_BOUNDARY)
    return len(tree) > 1 and tree[end] == edge and _is_word(tree[1 if end == 0 else -2], end)


def _is_word(node, end: int) -> bool:
    op, arg = node
    if op is _parser.LITERAL:
        return chr(arg).isalnum() or arg == ord("_")
    if op is _parser.RANGE:
        return all(_is_word((_parser.LITERAL, c), end) for c in range(arg[0], arg[1] + 1))
    if op is _parser.CATEGORY:
        return arg in (_parser.CATEGORY_DIGIT, _parser.CATEGORY_WORD)
    if op is _parser.IN:
        return all(_is_word(part, end) for part in arg)
    if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
        return arg[0] > 0 and len(arg[2]) > 0 and _is_word(arg[2][end], end)
    if op is _parser.SUBPATTERN:
        return len(arg[-1]) > 0 and _is_word(arg[-1][end], end)
    if op is _parser.BRANCH:
        return all(len(branch) > 0 and _is_word(branch[end], end) for branch in arg[1])
    return False


def to_re2(pattern: str) -> str | None:
    """Linear-time pattern that is found in just the texts in which Python finds this one
    without regard to case, or None.

    That engine knows word edges for ASCII only, so an edge at an end of a branch is
    spelled out as the character, or the end of the text, beside it.
    """
    if re.search(r"\(\?[^:]", pattern) or not all(map(_folds_alone, pattern)):
        return None  # flags, look-around and letters with odd case are left to the exact search
    try:
        translated = "|".join(map(_edged, _branches(pattern)))
        pc.match_substring_regex(pa.array([""]), translated)
        return translated
    except (_NoEquivalent, pa.ArrowInvalid, re.error):
        return None


def _folds_alone(letter: str) -> bool:
    """Whether a letter equals just its own lower and upper form when case is ignored."""
    if letter.isascii():
        return True
    lower, upper = letter.lower(), letter.upper()
    return len(lower) == len(upper) == 1 and lower.upper() == upper and upper.lower() == lower and not lower.isascii()


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern, outside of all groups and classes."""
    out, depth, in_class = [""], 0, False
    for match in _PIECE.finditer(pattern):
        piece = match.group()
        if piece[0] == "[" and not in_class:
            in_class = True
        elif piece == "]":
            in_class = False
        elif not in_class:
            depth += (piece == "(") - (piece == ")")
            if piece == "|" and depth == 0:
                out.append("")
                continue
        out[-1] += piece
    return out


_OUTSIDE = rf"[^{_WORD}]"
# An edge before a run of any characters, and the other character that follows it.
_EDGE_THEN_ANY = re.compile(r"(?<=\w)\\b\.\*(?=[/ :;,=])")


def _edged(branch: str) -> str:
    before, after = "", ""
    if _one_sided(branch, 0):
        branch, before = branch[2:], rf"(?:\A|{_OUTSIDE})"
    if _one_sided(branch, -1):
        branch, after = branch[:-2], rf"(?:{_OUTSIDE}|\z)"
    # the run starts with the character beside the edge, or is empty
    parts = _EDGE_THEN_ANY.split(branch)
    body = rf"(?:[^{_WORD}\n].*)?".join(_translate(part, _re2_escape, end=r"(?:\n?\z)") for part in parts)
    return before + body + after


def _re2_escape(letter: str, in_class: bool, rest: str) -> str:
    if letter in _RE2_CLASSES:
        return _RE2_CLASSES[letter] if in_class else f"[{_RE2_CLASSES[letter]}]"
    if letter.lower() in _RE2_CLASSES and not in_class:
        return f"[^{_RE2_CLASSES[letter.lower()]}]"
    if letter in "SDWbB" or letter.isdigit():
        raise _NoEquivalent
    return {"Z": r"\z"}.get(letter, "\\" + letter)


class _NoEquivalent(Exception):
    pass


def _translate(pattern: str, escape: Callable[[str, bool, str], str], end: str = "$") -> str:
    out = []
    in_class = False
    for match in _PIECE.finditer(pattern):
        piece = match.group()
        if piece.startswith("\\"):
            out.append(escape(piece[1], in_class, pattern[match.end():]))
        elif piece.startswith("[") and not in_class:
            in_class = True
            out.append(piece.replace("]", "\\]"))
        elif piece == "]" and in_class:
            in_class = False
            out.append(piece)
        elif in_class and piece[0] in "[&":
            # Java would read these as a nested class or an intersection
            out.append("\\" + piece)
            in_class = not piece.endswith("]")
        elif piece[0] == "{" and not in_class:
            low, comma, high = match.groups()
            counted = len(piece) > 2
            out.append(f"{{{low or 0}{comma}{high}}}" if counted else "\\" + piece)
        elif piece == "$" and not in_class:
            out.append(end)
        else:
            out.append(piece)
    return "".join(out)


def _java_escape(letter: str, in_class: bool, rest: str) -> str:
    if letter in _CLASSES:
        return _CLASSES[letter] if in_class else f"[{_CLASSES[letter]}]"
    if letter.lower() in _CLASSES:
        return f"[^{_CLASSES[letter.lower()]}]"
    if letter == "b" and not in_class:
        return _EDGE
    if letter == "b":
        return r"\x08"
    if letter == "B":
        return _NOT_EDGE
    if letter == "Z":
        return r"\z"
    return "\\" + letter
