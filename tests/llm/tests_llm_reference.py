"""Plain versions of what the contracts define."""

import re


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
