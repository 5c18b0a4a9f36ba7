"""A small labelled table for the secret scan: lines with secrets of shapes that no pattern matches,
and lines with what looks like them.

The lines are made from rules with a fixed seed. A value stands behind a word that announces it or
between any words; only passwords need the word, as they look like anything.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
ALNUM = LOWER + UPPER + DIGITS
SIGNS = "!@#$%&*?^~"

#: Words that announce a secret, and words between which anything may stand.
CUES = (
    "password", "pass", "pwd", "passphrase", "secret", "token", "key", "api key", "auth", "bearer",
    "credential", "credentials", "login", "access key", "private key", "client secret", "Authorization",
)
PLAIN = (
    "the", "and", "see", "with", "file", "on", "build", "of", "id", "from", "in", "page", "server", "is",
    "at", "commit", "note", "open", "run", "user", "path", "name", "value", "trace", "request", "order",
)
#: Between the word and the value.
LINKS = (" is ", ": ", " = ", "=", ":", " ", ' "', " -> ")

Draw = random.Random


def _of(draw: Draw, letters: str, least: int, most: int) -> str:
    return "".join(draw.choice(letters) for _ in range(draw.randint(least, most)))


def _mixed(draw: Draw, letters: str, least: int, most: int) -> str:
    """Letters of both kinds and digits, as drawn strings of some length have."""
    while True:
        found = _of(draw, letters, least, most)
        if any(c in DIGITS for c in found) and any(c in LOWER for c in found):
            return found


def _word(draw: Draw) -> str:
    return "".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))


def prefixed(draw: Draw) -> str:
    parts = [_of(draw, LOWER, 2, 5)]
    parts += draw.choice([[], [], ["live"], ["test"], [_of(draw, LOWER, 2, 4)], [_of(draw, DIGITS, 4, 14)]])
    mark = draw.choice("_-")
    return mark.join([*parts, _mixed(draw, ALNUM, 16, 44)])


def bearer(draw: Draw) -> str:
    return _mixed(draw, ALNUM + draw.choice(["", "", "_-"]), 20, 64)


def base64(draw: Draw) -> str:
    return _mixed(draw, ALNUM + "+/", 32, 64) + draw.choice(["", "=", "=="])


def signed_parts(draw: Draw) -> str:
    parts = [_mixed(draw, ALNUM + "_-", 16, 40) for _ in range(2)]
    return ".".join(["eyJ" + _mixed(draw, ALNUM, 12, 30), *parts])


def password(draw: Draw) -> str:
    while True:
        found = _of(draw, ALNUM + SIGNS, 9, 18)
        if sum(any(c in kind for c in found) for kind in (LOWER, UPPER, DIGITS, SIGNS)) >= 3:
            return found


def _date(draw: Draw) -> str:
    return f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}"


def stamp(draw: Draw) -> str:
    return f"{_date(draw)}T{draw.randint(0, 23):02}:{draw.randint(0, 59):02}:{draw.randint(0, 59):02}Z"


def uuid(draw: Draw) -> str:
    digits = draw.choice(["0123456789abcdef", "0123456789ABCDEF"])
    return "-".join(_of(draw, digits, n, n) for n in (8, 4, 4, 4, 12))


def path(draw: Draw) -> str:
    parts = [_word(draw) + draw.choice(["", "", str(draw.randint(1, 99))]) for _ in range(draw.randint(2, 6))]
    return "/" + "/".join(parts) + draw.choice(["", ".txt", ".tar.gz", ".py"])


def address(draw: Draw) -> str:
    return f"https://{_word(draw)}.{draw.choice(['org', 'net', 'com'])}{path(draw)}"


def mail(draw: Draw) -> str:
    return f"{_word(draw)}.{_word(draw)}{draw.randint(1, 99)}@{_word(draw)}.org"


def package(draw: Draw) -> str:
    return f"{_word(draw)}-{_word(draw)}_{draw.randint(0, 9)}.{draw.randint(0, 30)}.{draw.randint(0, 9)}.tar.gz"


def identifier(draw: Draw) -> str:
    words = [_word(draw) for _ in range(draw.randint(2, 5))]
    short = draw.choice(["", "", "Id", "URL", "NS", "HTTP"]) + draw.choice(["", "", "2", "16"])
    camel = words[0] + "".join(w.title() for w in words[1:]) + short
    return draw.choice([camel, camel + "()", "_".join(words), "_".join(words).upper(), "-".join(words)])


def decorated(draw: Draw) -> str:
    """Words that are followed by runs of a sign."""
    return " ".join(
        _word(draw) + draw.choice([",", "."]) * draw.randint(0, 1) + draw.choice(SIGNS + "#") * 3
        for _ in range(draw.randint(1, 5))
    )


def repeated(draw: Draw) -> str:
    return " ".join([draw.choice([_word(draw), _word(draw).title() + "."])] * draw.randint(4, 20))


def number(draw: Draw) -> str:
    groups = [_of(draw, DIGITS, 3, 4) for _ in range(draw.randint(2, 4))]
    account = draw.choice(UPPER) + draw.choice(UPPER) + _of(draw, DIGITS, 14, 22)
    return draw.choice(["-".join(groups), " ".join(groups), "+" + _of(draw, DIGITS, 9, 12), account])


def image(draw: Draw) -> str:
    kind = draw.choice(["png", "jpeg", "gif"])
    return f"data:image/{kind};base64,{_mixed(draw, ALNUM + '+/', 40, 200)}="


def long_word(draw: Draw) -> str:
    return "".join(_word(draw) for _ in range(draw.randint(3, 6)))


def codes(draw: Draw) -> str:
    """Short names with numbers, as items of a list have."""
    return " ".join(
        _of(draw, draw.choice([LOWER, UPPER]), 1, 3) + str(draw.randint(0, 9_999))
        for _ in range(draw.randint(1, 8))
    )


SECRETS: tuple[Callable[[Draw], str], ...] = (prefixed, bearer, base64, signed_parts, password)
LOOK_ALIKES: tuple[Callable[[Draw], str], ...] = (
    stamp, uuid, path, address, mail, package, identifier, number, image, long_word, decorated, repeated,
    codes,
)


def line(draw: Draw, make: Callable[[Draw], str], announced: bool) -> tuple[str, tuple[int, int]]:
    """A line with one value, and where the value is."""

    def words(most: int) -> str:
        count = draw.randint(0, most)
        return " ".join(draw.choice(PLAIN) if draw.random() < 0.6 else _word(draw) for _ in range(count))

    lead = words(6)
    if announced:
        cue = draw.choice(CUES)
        cue = draw.choice([cue, cue.title(), cue.upper(), cue.replace(" ", "_")])
        lead = f"{lead} {cue}".strip() + draw.choice(LINKS)
    elif lead:
        lead += draw.choice([" ", " ", " (", ": ", ' "'])
    value = make(draw)
    tail = words(5)
    closing = '"' if lead.endswith('"') else ")" if lead.endswith("(") else ""
    whole = f"{lead}{value}{closing}" + (f" {tail}" if tail else "")
    return whole, (len(lead), len(lead) + len(value))


def labelled_lines(count: int = 2_400, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the places of their secrets; half hold one, a quarter something that looks like one, and
    the rest passwords in addresses or announced words."""
    draw = Draw(seed)
    found = []
    for i in range(count):
        if i % 2 == 0:
            make = SECRETS[(i // 2) % len(SECRETS)]
            text, span = line(draw, make, make is password or draw.random() < 0.6)
            found.append((text, [span]))
        elif i % 4 == 1:
            text, _ = line(draw, LOOK_ALIKES[(i // 4) % len(LOOK_ALIKES)], draw.random() < 0.3)
            found.append((text, []))
        elif i % 8 == 3:
            user, host = _word(draw), _word(draw)
            lead = f"{draw.choice(['https', 'postgres', 'ftp', 'amqp'])}://{user}:"
            value = password(draw).replace("@", "x") if draw.random() < 0.5 else bearer(draw)
            found.append((f"{lead}{value}@{host}.org/{_word(draw)}", [(len(lead), len(lead) + len(value))]))
        else:
            text, _ = line(draw, long_word, True)
            found.append((text, []))
    return found
