"""English number words: no "and", hyphened tens, no commas; whole numbers to 15 digits."""

from __future__ import annotations

UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", " thousand", " million", " billion", " trillion"]
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def _below_thousand(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    words = [f"{UNITS[hundreds]} hundred"] if hundreds else []
    if rest >= 20:
        words.append(TENS[rest // 10] + (f"-{UNITS[rest % 10]}" if rest % 10 else ""))
    elif rest:
        words.append(UNITS[rest])
    return " ".join(words)


def cardinal(n: int) -> str:
    if n == 0:
        return UNITS[0]
    groups, out = [], []
    while n:
        n, group = divmod(n, 1000)
        groups.append(group)
    for scale in range(len(groups) - 1, -1, -1):
        if groups[scale]:
            out.append(_below_thousand(groups[scale]) + SCALES[scale])
    return " ".join(out)


def ordinal(n: int) -> str:
    words = cardinal(n)
    cut = max(words.rfind(" "), words.rfind("-")) + 1
    last = words[cut:]
    if last in IRREGULAR:
        last = IRREGULAR[last]
    elif last.endswith("y"):
        last = last[:-1] + "ieth"
    else:
        last += "th"
    return words[:cut] + last


def spoken(number: str) -> str:
    """A written number, commas and decimals allowed, as words; decimals digit by digit, whole parts over 15 digits as they are."""
    whole, _, decimals = number.replace(",", "").partition(".")
    said = whole if len(whole) > 15 else cardinal(int(whole))
    return " ".join([said, "point", *(UNITS[int(d)] for d in decimals)]) if decimals else said


def is_one(number: str) -> bool:
    return float(number.replace(",", "")) == 1


_ROMAN = list(zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split(), strict=True))


def to_roman(n: int) -> str:
    out = ""
    for value, letters in _ROMAN:
        while n >= value:
            out, n = out + letters, n - value
    return out


_ROMAN_VALUES = {to_roman(n): n for n in range(1, 4000)}


def from_roman(text: str) -> int:
    """Value of a well-formed Roman numeral up to 3999, else 0."""
    return _ROMAN_VALUES.get(text, 0)
