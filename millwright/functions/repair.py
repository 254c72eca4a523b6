"""Repair of texts that a reader of drawings got wrong: symbols, look-alike letters and digits, separators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import First, Stop, Swap, apply, bound

# Which writings are repaired, in this order. \w, \s and \b are written out, for they are those of all scripts.
_W, _S = r"[\p{L}\p{N}_]", r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_B, _E = f"(?<!{_W})", f"(?!{_W})"  # where a word begins, and where it ends
_I = "(?iu)"
_TRIM = (Swap(f"^{_S}+"), Swap(f"{_S}+\\z"))
_SINGLE = (Swap(f"{_S}+", " "), *_TRIM)
_THREAD_COMMA = Swap(r"(MJ?[0-9]+[xX×][0-9]+[.,][0-9]+)" + _S + "*," + _S + "*([0-9]+[hH])", "$1 $2")

#: A character that couldn't be read is a sign between digits, degrees behind one, a diameter before one.
_UNREAD = (Swap("([0-9])\ufffd([0-9])", "$1×$2"), Swap(f"([0-9])\ufffd(?={_S}|$)", "$1°"), Swap("^\ufffd(?=[0-9])", "0"), Swap(f"(?<={_S})\ufffd(?=[0-9])", "0"), Swap("\ufffd"))
_VARIANTS = (Swap("Φ", "Ø"), Swap("º", "°"), Swap("˚", "°"), Swap("^O/(?=[0-9])", "Ø"), Swap(f"(?<={_S})O/(?=[0-9])", "Ø"), Swap(r"[^\x00-\xff]"))
#: Numbers, fractions, tolerances and angles that need nothing.
_CLEAN = (
    Stop((r"^[0-9]+$",)),
    Stop((r"^[0-9]+\.[0-9]+$",), unless=(r"^0[0-9]{2,}",)),
    Stop((r"^\.[0-9]+$",), rules=(Swap("^", "0"),)),
    Stop((r"^[0-9]+/[0-9]+$",)),
    Stop((r"^[0-9]+\.[0-9]+±[0-9]+\.[0-9]+$",)),
    Stop((r"^[0-9]+°$",)),
)
#: Callouts that are known as they are; only separators change.
_KNOWN = Stop(
    (
        f"{_I}{_B}DIA{_E}",
        f"{_I}{_B}MAJOR{_E}",
        r"^[mM][jJ]?[0-9]+[Xx*×][0-9]+(\.[0-9]+)?[^\n]*\z",
        r"^[A-Za-z][0-9]*" + _S + r"+[0-9]+[.,][0-9]+[Xx×][0-9]+\z",
        r"[0-9]+[Hh][0-9]+[Hh]",
    ),
    rules=(*_SINGLE, Swap("(?<=[0-9]),(?=[0-9])", "."), _THREAD_COMMA),
)
_NOT_A_DIAMETER = (Swap("Ø([0-9]+)Ø", "$1"), Swap("^Ø([0-9]{1,2})$", "$1"))
#: Digits, and letters read in their place.
_LOOK_ALIKE = (("0", "OQ"), ("1", "ILT"), ("6", "Gb"), ("8", "B"), ("9", "gq"))
_RESTORED = (
    Swap(f"[·∙•øØ][1I][Aa]{_E}", " DIA"),
    Swap("(?<=[0-9])[·∙•](?=[0-9])", "."),
    Swap("^[·∙•](?=[0-9])", "0."),
    Swap(r"(?<![Øø0-9])ø\.(?=[0-9])", "0."),
    Swap(f"{_B}MJ[Ss]([Xx])", "MJ5x"),
    Swap("([0-9][Hh])[Gg]([Hh])", "$16$2"),
    Swap(r"^[-–—\[\]]+" + _S + "*"),
    Swap(_S + r"*[-–—\[\]]+$"),
    _THREAD_COMMA,
    Swap(r"^L([0-9]+[°(])", "$1"),
    Swap(r"^Q(\.[0-9])", "Ø$1"),
    Swap("([0-9])\ufffd([0-9])", "$1×$2"),
    Swap(f"([0-9])\ufffd(?={_S}|$)", "$1°"),
    Swap(f"^[·∙•]{_S}*"),
    Swap(f"{_S}*[·∙•]$"),
    Swap(f"{_I}[Ø⌀ø]{_S}*([0-9.]+)", "Ø$1"),
    Swap(f"{_I}{_B}O([0-9]+){_E}", "Ø$1"),
    Swap(rf"\+{_S}*[-/]{_S}*", "±"),
    Swap(f"([0-9]){_S}+([0-9]{{2,}})", "$1.$2"),
    Swap(f"([0-9]){_S}*/{_S}*([0-9])", "$1/$2"),
    Swap(f"{_I}R{_S}*([0-9.]+)", "R$1"),
    Swap(rf"{_I}([0-9]+\.?[0-9]*){_S}*F{_E}", "$1R"),
    Swap(f"{_I}M{_S}*([0-9])", "M$1"),
    Swap(f"{_I}([0-9]){_S}*H", "$1h"),
    Swap(rf"{_I}(?<!\(){_B}REF{_E}(?!\))", "(REF)"),
    Swap(f"([0-9]){_S}*[xX×*]{_S}*([0-9])", "$1×$2"),
    Swap(f"([0-9]){_S}*°{_S}*", "$1°"),
    Swap(rf"^0\.([0-9]+){_S}*([hHgGfF][0-9]+)", "Ø$1 $2"),
    Swap(rf"^0([0-9]{{2,}}(?:\.[0-9]+)?){_S}*$", "Ø$1"),
    *_SINGLE,
)


def _numeric(text: Column) -> Column:
    """At least as many digits as letters, and one."""
    digits = F.regexp_count(text, F.lit(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"))
    return (digits > 0) & (digits >= F.regexp_count(text, F.lit(r"\p{L}")))


def _twice_encoded(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; what isn't UTF-8 goes."""
    again = F.replace(F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.when(F.contains(text, F.lit("Ã")) & F.contains(text, F.lit("Â")), again)


_OTHERWISE = First((Swap("ä¸", "+X", when=("ä¸",)), Swap(rf"\+{_S}*-", "±", when=(r"\+", "-"), unless=("±",))))
_DIGITS = tuple(Swap(letter, digit, when=(letter, _numeric), unless=(digit,)) for digit, letters in _LOOK_ALIKE for letter in letters)
#: All rules, before and after the texts that were encoded twice.
BEFORE = (*_UNREAD, *_VARIANTS, *_TRIM)
AFTER = (*_CLEAN, _KNOWN, *_NOT_A_DIAMETER, *_DIGITS, *_RESTORED)


def repair_text(text: Column) -> Column:
    """The text as it was most probably drawn. Clean numbers and known callouts stay as they are but for separators; null stays null."""
    read = lambda t: F.coalesce(_twice_encoded(t), apply((_OTHERWISE,), t))
    return F.when(text == "", text).otherwise(apply(AFTER, bound(apply(BEFORE, text), read)))
