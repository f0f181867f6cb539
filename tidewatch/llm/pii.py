"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) always hold. The model adds spans of these kinds and of secrets. A candidate segment has a digit
or ``@`` in each part between blanks or is assigned to a name like ``password``; it is a run of at most ``LONGEST`` tokens, of ``LONGEST_CHARS``
characters if it has a blank, of ``MOST_DIGITS`` digits if it has a blank or no letter, or else a run without a blank of any length (from
its start, or from behind its last ``=``, ``:`` or quote). It is scored as a whole by its shape, digit groups, checks (Luhn, octets),
classes of characters, neighbours and the word before it; dynamic programming over segments (outside tokens have length one) chooses boundaries and kinds
jointly, with learned scores for the change of kinds. Its spans that overlap no base span are added. Weights are fitted once, on sentences made
from a fixed seed, by gradient ascent on the conditional log-likelihood (forward-backward over segments).

Text without digits, ``@`` and assigned names has no candidates, so only the neighbourhoods of these are read into tokens; between them
every token is outside, which separates the programs exactly. Time is linear in the text, whatever it holds.

Defined results: a null text has no spans; positions are code points, ends exclusive; spans are sorted by kind as listed, then start.
Repeated rows stand for themselves; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LONGEST = 16
LONGEST_CHARS = 96
#: Digits of a segment with a blank or without a letter.
MOST_DIGITS = 19
#: Characters of the gap within which two triggers share one program.
NEAR = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_ASSIGNS = re.compile("[=:]")
_NAME = re.compile(r"""(?i:passphrase|password|passwd|pwd|secret|token|key|credential|bearer)["']?\x20?$""")
_VALUE = re.compile(r"""\x20?["']?[^\W\d_]""")
_ASSIGNED = re.compile(r"""["']?\x20?[=:]\x20?["']?""")
_BLANK = re.compile("[ \n\t]")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, in linear time: from each ``@`` to the left."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def _octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))


def _digits(span: str) -> str:
    return "".join([c for c in span if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _MARK.search(text) is None:
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- segments ---

_WORDS = {
    "secret": ("token", "key", "secret", "password", "passwd", "passphrase", "pwd", "apikey", "bearer", "credential"),
    "phone": ("tel", "phone", "telephone", "call", "fax", "mobile", "cell", "telefon", "handy", "whatsapp"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "ip": ("ip", "host", "server", "address"),
    "email": ("mail", "email", "contact"),
    "id": ("commit", "sha", "sha1", "sha256", "md5", "md5sum", "checksum", "digest", "hash", "isbn", "issn", "uuid", "guid", "order", "invoice", "serial", "build", "revision", "doi", "ticket", "version", "page"),
}
_WORD_CLASS = {w: k for k, ws in _WORDS.items() for w in ws}
#: Tokens between a naming word and what it names.
_BETWEEN = frozenset(["=", ":", '"', "'", "(", ")", "+", ".", "#", "-", ">", "is", "no", "nr", "number", "at", "on"])
#: How public services begin their keys.
_PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_", "pk_", "rk_", "AKIA", "ASIA", "xoxb-", "xoxp-", "AIza", "eyJ", "hf_", "npm_", "SG.", "ya29.")


def tokenize(text: str, at: int, to: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, at, to)]


def _run_starts(text: str, tokens: list[tuple[int, int]]) -> dict[int, int]:
    """Of runs of tokens without a blank: the first token, and the one behind the last ``=``, ``:`` or quote before the run's last letter or
    digit, each with the end of the run's last token of letters or digits."""
    out: dict[int, int] = {}
    i, n = 0, len(tokens)
    while i < n:
        j = i + 1
        while j < n and tokens[j][0] == tokens[j - 1][1]:
            j += 1
        last = j
        while last > i and not text[tokens[last - 1][1] - 1].isalnum():
            last -= 1
        if last > i:
            out[i] = last
            k = last - 1
            while k > i and text[tokens[k - 1][0]] not in "=:\"'":
                k -= 1
            out[k] = last
        i = j
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, tuple]]:
    """(first token, end token, key) of segments that could be an entity; the key holds all that features see."""
    out, word, named, n = [], "", -1, len(tokens)
    digits = [len(_digits(text[a:b])) for a, b in tokens]
    runs = _run_starts(text, tokens)
    for i, (a, b) in enumerate(tokens):
        first = text[a]
        glued = i > 0 and tokens[i - 1][1] == a
        before = text[a - 1] if glued else " "
        after = lambda j: text[tokens[j - 1][1]] if j < n and tokens[j][0] == tokens[j - 1][1] else " "
        assigned = named >= 0 and word == "secret" and _ASSIGNED.fullmatch(text, named, a) is not None
        if (first.isalnum() or first in "+(") and not (glued and before in "._%@"):
            seen, many, blank, letters = False, 0, False, False
            ends = []
            for j in range(i, min(n, i + LONGEST)):
                c, d = tokens[j]
                if j > i and (gap := c - tokens[j - 1][1]):
                    if gap > 1 or text[c - 1] == "\n" or not seen:
                        break
                    blank, seen = True, False
                last = text[c:d]
                many, letters = many + digits[j], letters or (last[0].isalnum() and digits[j] < d - c)
                if j > i and many > MOST_DIGITS and (blank or not letters):
                    break
                if d - a > LONGEST_CHARS and j > i:
                    break
                seen = seen or _MARK.search(last) is not None
                if last[-1].isalnum() and (seen or (assigned and not blank)):
                    ends.append(j + 1)
            if (end := runs.get(i)) is not None and end not in ends and (assigned or _MARK.search(text, a, tokens[end - 1][1])):
                ends.append(end)
            out += [(i, j, _key(text[a : tokens[j - 1][1]], word + "=" * assigned, before, after(j), j - i)) for j in ends]
        token = text[a:b].lower()
        if found := _WORD_CLASS.get(token):
            word, named = found, b
        elif token not in _BETWEEN and not (word == "id" and len(token) <= 2):
            word, named = "", -1
    return out


def _runs_of(span: str) -> int:
    """Changes between lower case, upper case and digits, by length."""
    kinds = re.sub("[0-9]", "0", re.sub("[^\\W\\d_]", lambda m: "A" if m[0].isupper() else "a", span))
    return min(10 * sum(x != y for x, y in zip(kinds, kinds[1:])) // max(len(span), 1), 6)


def _key(span: str, word: str, before: str, after: str, n: int) -> tuple:
    shape = re.sub("[^\\W\\d_]+", "a", span)
    digits = _digits(span)
    check = "luhn" if 13 <= len(digits) <= 19 and luhn(digits) else "octets" if span.count(".") == 3 and re.fullmatch(r"[0-9.]+", span) and _octets(span) else ""
    dense = ""
    if len(span) >= 12 and "@" not in span and re.search("\\s", span) is None and "a" in shape:
        shape = "dense"
        hexed = re.fullmatch("[0-9a-f]+|[0-9A-F]+", span)
        classes = "hex" if hexed else "".join(c for c, p in (("l", "[a-z]"), ("u", "[A-Z]"), ("d", "[0-9]"), ("x", "[^A-Za-z0-9]")) if re.search(p, span))
        dense = (classes, min(len(span) // 8, 8), min(_runs_of(span), 6), any(span.startswith(x) for x in _PREFIXES), "/" in span or "." in span)
    side = lambda c: "a" if c.isalnum() else c if c in " .-@=\"'/:,()+" else "o"
    return (re.sub("[0-9]+", lambda m: str(min(len(m[0]), 20)) + "#", shape), min(len(digits), 20), check, dense, word, side(before), side(after), min(n, 10), span[0] == "0" or span[:2] == "(0")


def key_features(key: tuple) -> list[str]:
    shape, digits, check, dense, word, before, after, n, zero = key
    seps = "".join(sorted({c for c in shape if not c.isalnum() and c != "#"}))
    mail = bool(re.fullmatch(r"[a0-9#._%+-]+@[a0-9#-]+(\.[a0-9#-]+)*\.a", shape))
    out = ["bias", f"d{digits}", f"seps{seps}", f"check{check}", f"word{word}", f"b{before}", f"e{after}", f"n{n}"]
    out += [f"mail{mail}", f"first{shape[:1] if not shape[:1].isdigit() else '0'}", f"letters{'a' in shape}", f"groups{shape.count('#')}"]
    if dense:
        classes, size, changes, prefixed, path = dense
        out += [f"dense{classes}", f"size{size}", f"changes{changes}", f"prefix{prefixed}", f"path{path}", f"classes{classes}{size}", f"word{word}{classes}", f"word{word}prefix{prefixed}", f"changes{changes}{classes}", f"b{before}e{after}dense"]
    else:
        out.append(f"word{word}short")
        if word.endswith("="):
            out.append(f"assigned{before}{after}")
    if len(shape) <= 20 and "a" not in shape:
        out += [f"shape{shape}", f"word{word}d{digits}", f"zero{zero}word{word}"]
    if digits >= 9 and "a" not in shape:
        out.append(f"plus{shape[:1] == '+'}phone{digits <= 15}")
    return out


class Model:
    """Feature and transition weights; label 0 is outside, the others are ``KINDS``."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transition: np.ndarray):
        self.index, self.weights = index, weights
        self.transition = transition.tolist()
        self.cache: dict[tuple, list[float]] = {}

    def scores(self, key: tuple) -> list[float]:
        """Of the kinds, for a segment."""
        found = self.cache.get(key)
        if found is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            rows = [i for f in key_features(key) if (i := self.index.get(f)) is not None]
            found = self.cache[key] = self.weights[rows].sum(axis=0).tolist()
        return found

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The best segmentation's entities."""
        by_end: dict[int, list] = {}
        for i, j, key in candidates(text, tokens):
            by_end.setdefault(j, []).append((i, self.scores(key)))
        labels, move = range(len(KINDS) + 1), self.transition
        best = [[0.0] + [-math.inf] * len(KINDS)]
        back: list[list] = [[None] * (len(KINDS) + 1)]
        entering: list[list[tuple[float, int]]] = []
        for end in range(1, len(tokens) + 1):
            row = best[-1]
            entering.append([max((row[p] + move[p][y], p) for p in labels) for y in labels])
            score, source = [-math.inf] * (len(KINDS) + 1), [None] * (len(KINDS) + 1)
            score[0], source[0] = entering[-1][0][0], (end - 1, entering[-1][0][1])
            for start, of in by_end.get(end, ()):
                for y, s in enumerate(of, 1):
                    total, p = entering[start][y]
                    if total + s > score[y]:
                        score[y], source[y] = total + s, (start, p)
            best.append(score)
            back.append(source)
        out, at = [], len(tokens)
        y = max(labels, key=lambda x: best[at][x])
        while at:
            start, p = back[at][y]
            if y:
                out.append((KINDS[y - 1], tokens[start][0], tokens[at - 1][1]))
            at, y = start, p
        return out[::-1]


def _triggers(text: str):
    """(start, place) of digits, of ``@`` and of values that are assigned to a secret's name, from a place on that is sent in."""
    named = []
    for m in _ASSIGNS.finditer(text):
        p = m.start()
        if (name := _NAME.search(text[max(0, p - 14) : p])) and (value := _VALUE.match(text, p + 1)):
            named.append((p - min(p, 14) + name.start(), value.end() - 1))
    i, at = 0, 0
    while True:
        mark = _MARK.search(text, at)
        while i < len(named) and named[i][0] < at:
            i += 1
        found = named[i] if i < len(named) and (mark is None or named[i][0] < mark.start()) else mark and (mark.start(), mark.start())
        if not found:
            return
        at = yield found


def regions(text: str):
    """Stretches around digits, ``@`` and assigned names: whole blank-parted pieces with the words before; what lies between has no candidate."""
    begin = end = -1
    at = 0  # behind the last piece; all searches stop there or at the next blank, so their work adds up to the text's length
    triggers = _triggers(text)
    found = next(triggers, None)
    while found is not None:
        p, place = found
        start = max(at, *(text.rfind(c, at, p) + 1 for c in " \n\t"))
        blank = _BLANK.search(text, place)
        if end < 0:
            begin = start
        elif start - end > NEAR:
            yield _context(text, begin), end
            begin = start
        end = at = blank.start() if blank else len(text)
        try:
            found = triggers.send(at)
        except StopIteration:
            found = None
    if end >= 0:
        yield _context(text, begin), end


def _context(text: str, begin: int) -> int:
    """Where the first whole word of the ``NEAR`` characters before a place begins."""
    at = max(0, begin - NEAR)
    blank = _BLANK.search(text, at, begin) if at else None
    return at if not at else blank.end() if blank else begin


def added_spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for at, to in regions(text):
        out += model.decode(text, tokenize(text, at, to))
    kept, i = [], 0
    reach = 0  # the furthest end of base spans that start before a span's end
    for kind, a, b in sorted(out, key=lambda s: s[1]):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            kept.append((kind, a, b))
    return kept


# --- training ---


def _sentences(n: int, rng: np.random.Generator) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with marked entities, and with numbers, dates, sums, versions and names that are none."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, size=k))
    word = lambda: "".join(pick("th", "an", "er", "ion", "le", "que", "sch", "os", "ing") for _ in range(int(rng.integers(1, 4))))
    chars = lambda k, of: "".join(of[int(i)] for i in rng.integers(len(of), size=k))

    def card():
        lead = num(int(rng.integers(12, 18)))
        digits = next(lead + str(d) for d in range(10) if luhn(lead + str(d)))
        sep = pick("", "", " ", "-")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def fails():
        """A number as long as a card's whose check fails."""
        lead = num(15)
        return next(lead + str(d) for d in rng.permutation(10).tolist() if not luhn(lead + str(d)))

    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    both = lower + upper + digit
    hexed = lambda k: chars(k, "0123456789abcdef")

    def ensured(value: str) -> str:
        """With a digit in it."""
        at = int(rng.integers(1, len(value) - 1))
        return value if any(c.isdigit() for c in value) else value[:at] + num(1) + value[at + 1 :]

    opaque = (
        lambda: hexed(int(pick(24, 32, 40, 48, 64))), lambda: ensured(chars(int(rng.integers(20, 48)), both)), lambda: ensured(chars(39, both + "/+") + pick(*both)),
        lambda: pick("ghp_", "gho_", "hf_", "npm_") + ensured(chars(36, both)), lambda: pick("sk-", "sk-proj-", "glpat-") + (hexed(32) if rng.random() < 0.3 else ensured(chars(int(rng.integers(20, 60)), both + "-_")) + pick(*both)),
        lambda: pick("sk_live_", "pk_test_", "rk_live_") + ensured(chars(24, both)), lambda: pick("AKIA", "ASIA") + ensured(chars(16, upper + digit)), lambda: f"xoxb-{num(11)}-{num(12)}-{chars(24, both)}", lambda: "AIza" + ensured(chars(35, both)),
        lambda: f"eyJ{ensured(chars(18, both))}.eyJ{chars(int(rng.integers(20, 90)), both)}.{chars(43, both + '-_')}" + pick(*both),
    )
    marked = opaque[3:]

    def assigned():
        """A name, an assignment and what is secret."""
        name = pick("token", "key", "secret", "password", "passwd", "pwd", "api_key", "API-KEY", "apikey", "access_token", "aws_secret_access_key", "client_secret", "SECRET_KEY", "db.password", "passphrase", "auth token", "Password", "credential")
        quote = pick("", "", '"', "'")
        value = pick(*opaque)() if "pass" not in name.lower() and name != "pwd" or rng.random() < 0.2 else ensured(chars(int(rng.integers(8, 15)), both)) if rng.random() < 0.6 else word() + num(int(rng.integers(1, 5))) if rng.random() < 0.6 else chars(int(rng.integers(8, 15)), lower)
        return f'{pick("", "", quote)}{name}{pick(" = ", "=", ": ", ":", " is ") if any(c.isdigit() for c in value) else pick("=", ": ", " = ")}{quote}', value, quote

    national = (lambda: f"0{num(3)} {num(7)}", lambda: f"0{num(2)}/{num(7)}", lambda: f"(0{num(2)}) {num(6)}", lambda: f"0{num(4)}-{num(6)}", lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", lambda: f"0{num(10)}")

    def phone():
        return pick(f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}")

    def entity():
        """(kind, what stands before, value, what stands after)."""
        kind = pick(*KINDS, "secret", "phone")
        if kind == "secret":
            draw = rng.random()
            if draw < 0.7:
                head, value, tail = assigned()
                return kind, head, value, tail
            return (kind, pick("Authorization: Bearer ", "bearer ", "Bearer "), pick(*opaque)(), "") if draw < 0.8 else (kind, pick("", "", "use ", "("), pick(*marked)(), "")
        if kind == "phone":
            return (kind, pick("tel ", "Tel. ", "tel: ", "phone ", "call ", "Telefon ", "fax ", "mobile: ", "phone number "), pick(*national)() if rng.random() < 0.6 else phone(), "") if rng.random() < 0.6 else (kind, "", phone(), "")
        if kind == "email":
            return kind, pick("", "", "mail ", "contact: "), f"{word()}{pick('', '.', '_')}{pick('', num(2))}@{word()}{pick('', num(1))}.{pick('', 'example.')}{pick('com', 'org', 'de')}", ""
        if kind == "ip":
            return kind, pick("", "", "host ", "ip "), ".".join(str(int(x)) for x in rng.integers(1, 256, size=4)), ""
        return kind, pick("", "", "card ", "visa: "), card(), ""

    uuid = lambda: "-".join(hexed(k) for k in (8, 4, 4, 4, 12))
    noise = (
        lambda: num(int(rng.integers(1, 9))), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(3)},{num(3)}.{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}",
        lambda: f"{num(2)}:{num(2)}", lambda: f"{word()}{num(2)}", lambda: f"version {num(1)}.{num(1)}", lambda: f"@{word()}", lambda: num(int(rng.integers(20, 30))), lambda: f"{num(3)} {num(2)}", lambda: f"{num(3)}.{num(3)}.{num(3)}",
        fails, fails, lambda: word() * 6, lambda: f"{num(5)}-{num(4)}", lambda: f"{word()} = {num(3)}", lambda: f"({num(2)})", lambda: f"{int(rng.integers(300, 999))}.{num(2)}.{num(2)}.{num(2)}",
        lambda: f"{pick('commit', 'revision', 'sha', 'commit:')} {hexed(int(pick(7, 12, 40)))}", lambda: f"{pick('md5sum', 'md5:', 'checksum', 'MD5 =')} {hexed(32)}", lambda: f"{pick('sha256', 'digest:', 'hash =', 'checksum:')} {hexed(64)}",
        lambda: f"{pick('ISBN', 'ISBN:', 'isbn', 'ISBN-13:')} {pick('978', '979')}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{pick('isbn', 'ISBN')} {num(13)}", lambda: f"{pick('order', 'invoice', 'ticket', 'order number', 'serial no')} {num(int(rng.integers(5, 13)))}",
        lambda: f"{pick('', '', 'uuid ', 'id ')}{uuid()}", lambda: f"https://{word()}.example.org/{word()}/{num(4)}/{word()}?id={num(6)}", lambda: f"{word()}_{num(4)}_{word()}_v{num(1)}.{pick('pdf', 'csv', 'txt')}", lambda: f"{word()}-{word()}-{num(2)}.{num(1)}",
        lambda: f"{pick('page', 'doi')} 10.{num(4)}/{word()}.{num(4)}.{num(5)}", lambda: f"#{hexed(6)}", lambda: f"{pick('the', 'a')} {pick('key', 'token', 'secret', 'password', 'phone', 'card')} {word()} {pick('', num(2))}", lambda: f"{pick('tokens', 'keys', 'max_tokens', 'key')}{pick(' = ', ': ', '=')}{num(int(rng.integers(1, 5)))}",
        lambda: f"{pick('call', 'tel', 'fax')} {pick('', 'me ')}{num(int(rng.integers(1, 3)))}", lambda: f"{num(4)} {num(4)}", lambda: f"{num(2)} {num(2)} {num(2)}", lambda: f"{word()}{num(1)}{word()}{num(2)}{word()}", lambda: f"{num(4)}/{num(2)}/{num(2)} {num(2)}:{num(2)}:{num(2)}",
        lambda: hexed(int(pick(8, 16))), lambda: f"{pick('Secret', 'Key', 'token')}: {word()} {word()}",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(3, 8))):
            draw = rng.random()
            if draw < 0.35:
                kind, head, value, tail = entity()
                spans.append((kind, len(text) + len(head), len(text) + len(head) + len(value)))
                text += head + value + tail
            elif draw < 0.65:
                text += pick(*noise)()
            else:
                text += word()
            text += pick(" ", " ", " ", ". ", ", ", "\n")
        out.append((text, spans))
    return out


def log_forward(n: int, segments, move: np.ndarray):
    """Forward and backward log-sums over segmentations of ``n`` tokens; ``segments``: (start, end, scores of kinds)."""
    k = len(move)
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for i, j, s in segments:
        by_end.setdefault(j, []).append((i, s))
        by_start.setdefault(i, []).append((j, s))
    a = np.full((n + 1, k), -np.inf)
    a[0, 0] = 0
    into = np.full((n + 1, k), -np.inf)  # before a segment of a label from each place
    for t in range(n):
        into[t] = np.logaddexp.reduce(a[t][:, None] + move, axis=0)
        a[t + 1, 0] = into[t, 0]
        for i, s in by_end.get(t + 1, ()):
            a[t + 1, 1:] = np.logaddexp(a[t + 1, 1:], into[i, 1:] + s)
    b = np.full((n + 1, k), -np.inf)
    b[n] = 0
    ahead = np.full((n + 1, k), -np.inf)  # segments of a label from each place on
    for t in range(n - 1, -1, -1):
        ahead[t, 0] = b[t + 1, 0]
        for j, s in by_start.get(t, ()):
            ahead[t, 1:] = np.logaddexp(ahead[t, 1:], s + b[j, 1:])
        b[t] = np.logaddexp.reduce(move + ahead[t][None, :], axis=1)
    return a, b, into, ahead, np.logaddexp.reduce(a[n])


@lru_cache(maxsize=1)
def trained(n: int = 500, steps: int = 40, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    k = len(KINDS)
    data, index, flat, owner, gold = [], {}, [], [], []
    gold_moves = np.zeros((k + 1, k + 1))
    for text, spans in _sentences(n, rng):
        tokens = tokenize(text, 0, len(text))
        marked = {(a, b): KINDS.index(kind) for kind, a, b in spans}
        found, chosen = [], {}
        for i, j, key in candidates(text, tokens):
            c = len(gold)
            for f in key_features(key):
                flat.append(index.setdefault(f, len(index)))
                owner.append(c)
            label = marked.get((tokens[i][0], tokens[j - 1][1]), -1)
            gold.append(label)
            found.append((i, j, c))
            if label >= 0:
                chosen[i] = (j, label + 1)
        at, before = 0, 0
        while at < len(tokens):
            at, now = chosen.get(at, (at + 1, 0))
            gold_moves[before, now] += 1
            before = now
        data.append((len(tokens), found))
    flat, owner = np.array(flat), np.array(owner)
    hot = np.zeros((len(gold), k))
    for c, label in enumerate(gold):
        if label >= 0:
            hot[c, label] = 1
    weights, move = np.zeros((len(index), k)), np.zeros((k + 1, k + 1))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, move)]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(owner, weights=weights[flat, y], minlength=len(gold)) for y in range(k)], axis=1)
        expected, moves = np.zeros((len(gold), k)), np.zeros_like(move)
        for length, found in data:
            a, b, into, ahead, z = log_forward(length, [(i, j, scores[c]) for i, j, c in found], move)
            for i, j, c in found:
                expected[c] = np.exp(into[i, 1:] + scores[c] + b[j, 1:] - z)
            moves += np.exp(a[:-1, :, None] + move + ahead[:-1, None, :] - z).sum(axis=0)
        gap = hot - expected
        up = np.stack([np.bincount(flat, weights=gap[owner, y], minlength=len(index)) for y in range(k)], axis=1)
        for x, g, m in ((weights, up - 0.02 * weights, moments[0]), (move, gold_moves - moves - 0.02 * move, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += 0.3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Model(index, weights, move)


# --- columns ---

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def spans_of(text: str | None, model: Model) -> list[tuple[str, int, int, bool]]:
    """All spans of a text, by kind as listed, then start. What the model takes for a card has to pass as one, as in the base patterns."""
    if not text:
        return []
    base = base_spans(text)
    added = [s for s in added_spans(text, base, model) if s[0] != "card" or (13 <= len(d := _digits(text[s[1] : s[2]])) <= 19 and luhn(d))]
    found = [(*s, True) for s in base] + [(*s, False) for s in added]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``found``, the spans of each row."""
    model = model or trained()
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, np.array(model.transition)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    held: list[Model] = []

    def run(batch):
        if not held:
            held.append(Model(*shared.value))
        rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans_of(t, held[0])] for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, type=kind)], names=["doc_id", "found"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(chosen, run, chosen.select("doc_id", F.lit(None).cast(SPANS).alias("found")).schema)


def digest(found: DataFrame) -> DataFrame:
    """Numbers of base spans, a digest of these, all spans as text, and the numbers of secrets and of all spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    secrets = F.size(F.filter("found", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), secrets, F.size("found").cast("long").alias("n_spans")
    )


def redact(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with its spans, overlapping ones together, replaced by the first one's kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
