"""Small text helpers shared by all column builders.

Regular expressions are written for ``java.util.regex`` with the character
classes spelled out, because Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII-only by
default and the Unicode flag draws the classes differently: here a word
character is a letter, a number or ``_``, and the four ASCII separators count as
white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\p{L}\p{N}_"  # inside a class
S = r"[\p{IsWhite_Space}\x1c-\x1f]"
D = r"\p{Nd}"
NOT_AFTER_WORD = rf"(?<![{W}])"
NOT_BEFORE_WORD = rf"(?![{W}])"
IDENT = rf"[a-zA-Z_][{W}]*"
I = "(?iu)"


def starts(letters: str) -> str:
    """Begin a word, in any case, with one of the letters.

    The plain class comes first: it turns down most positions of a text long
    before the dearer look-behind and case folding are tried. The last two are
    the dotted and dotless i and the long s, which fold to ASCII letters.
    """
    odd = {"I": "\u0130\u0131", "S": "\u017f"}
    some = "".join(c + c.lower() + odd.get(c, "") for c in letters)
    return f"(?=[{some}]){NOT_AFTER_WORD}{I}"


# Control characters mark spots inside a text while it is being rewritten. They
# are neither word characters nor white space, and keep the text in one-byte form.
OPEN, CLOSE, SEP, ESC, SPACE = "\x01", "\x02", "\x03", "\x04", "\x05"
_ESCAPED = {OPEN: ESC + "\x06", CLOSE: ESC + "\x07", SEP: ESC + "\x08", SPACE: ESC + "\x0e"}
_ESC_SELF = "\x0f"


def strip(c: Column) -> Column:
    """Remove all white space at both ends (``trim`` removes blanks only).

    A text that starts and ends with a printable ASCII character has none.
    """
    bare = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(bare, c).otherwise(F.regexp_replace(c, rf"\A{S}+|{S}+\z", ""))


def has(c: Column, *words: str) -> Column:
    """True if any of the words occurs as a substring."""
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def mentions(c: Column, *words: str) -> Column:
    """True where one of the upper-case words may occur in any case, as ``(?iu)`` takes it.

    Two characters fold to I and K without being their lower case; a text with one of them counts.
    """
    return has(F.upper(c), *words, "\u0130", "\u212a")


def occurrences(c: Column, word: str) -> Column:
    """Number of non-overlapping occurrences of a fixed word."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word))


def points(test: Column, n: float) -> Column:
    return F.when(test, F.lit(float(n))).otherwise(F.lit(0.0))


def count_of(tests: list[Column]) -> Column:
    """How many of the tests hold."""
    out = F.lit(0)
    for t in tests:
        out = out + t.cast("int")
    return out


def words_if(pairs: list[tuple[Column, str]]) -> Column:
    """Array of the words whose test holds, in the given order."""
    return words_of([F.when(t, F.lit(w)) for t, w in pairs])


def words_of(words: list[Column]) -> Column:
    """Array of those words (not empty, without a comma) that are not null.

    Plain text functions, as ``array_compact`` would have Spark interpret all tests in it.
    """
    return F.array_remove(F.split(F.concat_ws(",", *words), ","), "")


def sql_text(s: str) -> str:
    """A raw SQL string literal; backslashes keep their meaning for the regex engine."""
    quote = "'" if "'" not in s else '"'
    if quote in s:
        raise ValueError(f"no literal can hold both kinds of quotes: {s}")
    return f"r{quote}{s}{quote}"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, {sql_text(rf'\A{S}+|{S}+\z')}, '')"


def shielded_sql(c: str) -> str:
    """Test for marker characters in a text."""
    return f"{c} RLIKE '[{OPEN}{CLOSE}{SEP}{ESC}{SPACE}]'"


def shield_sql(c: str) -> str:
    """Escape marker characters that already occur in a text."""
    out = f"replace({c}, '{ESC}', '{ESC}{_ESC_SELF}')"
    for raw, esc in _ESCAPED.items():
        out = f"replace({out}, '{raw}', '{esc}')"
    return out


def unshield_sql(c: str) -> str:
    out = c
    for raw, esc in _ESCAPED.items():
        out = f"replace({out}, '{esc}', '{raw}')"
    return f"replace({out}, '{ESC}{_ESC_SELF}', '{ESC}')"
