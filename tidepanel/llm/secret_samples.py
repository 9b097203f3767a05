"""Made-up training examples for the secret field: secrets and harmless values between given prose.

The fixed patterns mark three kinds of secrets only.  So that the field learns shape and context
instead of these, values of further kinds, letters only among them, stand in prose of the corpus,
with and without a name before them; names are often any word of the prose.  As many harmless values
(dates, paths, addresses, identifiers, compounds, short settings) stand in the same places.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator

NAMES = (
    "password", "pwd", "pass", "passphrase", "secret", "key", "token", "credential", "auth", "login",
    "access_key", "signing_key", "client_secret", "session", "license",
)
JOINS = ("=", " = ", ": ", ":", " := ", " is ", " ")
#: Joins that show an assignment; kinds that prose could hold stand behind these only.
ASSIGNS = JOINS[:5]
_BOTH, _LOW, _UP, _DIGITS = string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.digits


def _of(draw: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(draw.choice(letters) for _ in range(draw.randint(low, high)))


def secret(draw: random.Random) -> tuple[str, bool]:
    """A value, and whether only its context tells that it is secret."""
    kind = draw.randrange(8)
    if kind == 0:
        return _of(draw, _BOTH + _DIGITS, 16, 48), False
    if kind == 1:
        return _of(draw, _LOW + _DIGITS, 16, 40), False
    if kind == 2:
        return _of(draw, _BOTH + _DIGITS + "+/", 18, 64) + "=" * draw.randrange(3), False
    if kind == 3:
        return _of(draw, _UP + "234567", 16, 40), False
    if kind == 4:
        return _of(draw, _LOW, 2, 5) + draw.choice("_-") + _of(draw, _BOTH + _DIGITS, 16, 40), False
    if kind == 5:
        return _of(draw, _LOW, 16, 30), True
    if kind == 6:
        return _of(draw, _BOTH, 14, 30), True
    marks = _of(draw, _BOTH + _DIGITS + "!#$%&@*^?", 8, 14)
    return marks + draw.choice(_DIGITS) + draw.choice("!#$%@") + draw.choice(_BOTH), True


def harmless(draw: random.Random, plain: list[str]) -> tuple[str, bool]:
    """A value that only looks a little like a secret, and whether it stands without a name: compounds do,
    for any number of joined words may be one word of prose but not a setting's value."""
    if draw.random() < 0.3:
        return "".join(draw.choice(plain) for _ in range(draw.randint(2, 6)))[:40], True
    return _setting(draw, draw.choice(plain), draw.choice(plain)), False


def _setting(draw: random.Random, word: str, other: str) -> str:
    digits = lambda n: _of(draw, _DIGITS, n, n)
    kind = draw.randrange(11)
    if kind == 0:
        return f"20{digits(2)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}"
    if kind == 1:
        return f"+{draw.randint(1, 99)} {digits(3)} {digits(4)}"
    if kind == 2:
        return f"v{draw.randint(1, 20)}.{draw.randint(0, 20)}.{draw.randint(0, 9)}"
    if kind == 3:
        return f"/{word}/{other}/{word}-{other}.txt"
    if kind == 4:
        return f"https://www.{word}.org/{other}/{word}-{other}-{draw.randint(1, 99)}"
    if kind == 5:
        return f"{word}_{other}_{draw.choice(('id', 'count', 'name'))}"
    if kind == 6:
        return f"{word.capitalize()}{other.capitalize()}{draw.choice(('', 'List', 'Error'))}"
    if kind == 7:
        return f"{word}-{other}-{word}"
    if kind == 8:
        return f"{word}.{other}@{word}.com"
    if kind == 9:
        return _of(draw, _DIGITS, 1, 16)
    return draw.choice((word, other, word.upper()))


def examples(draw: random.Random, prose: list[list[str]], count: int) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """(text, secret spans, index of the prose) of ``count`` texts, every other one without a secret."""
    for k in range(count):
        at = draw.randrange(len(prose))
        words = prose[at]
        plain = [w for w in words if w.isalpha()] or ["value"]
        name = draw.choice(NAMES) if draw.random() < 0.5 else draw.choice(plain)
        name = draw.choice((name, name, name.upper(), name.capitalize()))
        if k % 2:
            value, bare = harmless(draw, plain)
            told = False
        else:
            value, told = secret(draw)
            bare = not told and draw.random() < 0.35
        quote = draw.choice(('"', "'", "", ""))
        if bare:
            head, quote = "", ""
        else:
            head = name + draw.choice(ASSIGNS if told else JOINS) + quote
        cut = draw.randrange(len(words) + 1)
        before = " ".join(words[:cut])
        start = len(before) + 1 + len(head)
        text = f"{before} {head}{value}{quote}{draw.choice(('', '', '.', ',', ';'))} {' '.join(words[cut:])}"
        yield text, [] if k % 2 else [(start, start + len(value))], at
