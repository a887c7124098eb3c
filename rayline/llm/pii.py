"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, URL schemes, words that announce an
identifier or a credential, and the prefixes of well-known keys.  Deterministic parsers then expand from an anchor to
the boundaries of an address, account or secret and validate it.  Text without anchors costs the pass alone, and no
parser looks further than its own span.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Batches, tidy

Span = tuple[int, int]

#: Kinds in the order in which spans are listed; the first four are the base, the others what the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "login", "ssn", "secret")

_LETTERS, _DIGITS = string.ascii_letters, frozenset(string.digits)
_LOCAL = frozenset(_LETTERS + string.digits + "._%+-")
_LABEL = frozenset(_LETTERS + string.digits + "-")
_PHONE = frozenset(string.digits + " ().-")
_SCHEME = frozenset(_LETTERS + string.digits + "+.-")
_ACCOUNT = frozenset(string.ascii_uppercase + string.digits)
_NO_LOGIN = frozenset(string.whitespace + "/@<>\"'?#")

_NAME = frozenset(_LETTERS + string.digits + "_-")
_TOKEN = frozenset(_LETTERS + string.digits + "_-")
_VALUE = frozenset(_LETTERS + string.digits + "_-./+=~$!@#%^&*|?")
_QUOTES = "\"'`"

AT, PLUS, DIGIT, SCHEME, IBAN, SSN, CUE, BEARER, PREFIX, BEGIN, END = range(11)

#: Words that announce a credential, alone or at the end of a longer name; of two words also with _, - or nothing between.
CREDENTIALS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "credential", "api key", "access key", "auth key", "private key", "secret key", "encryption key")
#: Prefixes of well-known keys, with the characters that follow and the least number of them.
_ALNUM, _CAPITALS = frozenset(_LETTERS + string.digits), frozenset(string.ascii_uppercase + string.digits)
PREFIXES = {
    "AKIA": (_CAPITALS, 16), "ASIA": (_CAPITALS, 16), "AIza": (_TOKEN, 35), "ghp_": (_ALNUM, 36), "gho_": (_ALNUM, 36), "ghs_": (_ALNUM, 36),
    "ghu_": (_ALNUM, 36), "github_pat_": (_TOKEN, 22), "xoxb-": (_TOKEN, 20), "xoxp-": (_TOKEN, 20), "xoxa-": (_TOKEN, 20), "xoxs-": (_TOKEN, 20),
    "sk-": (_TOKEN, 20), "sk_live_": (_ALNUM, 16), "glpat-": (_TOKEN, 20), "eyJ": (_TOKEN | {"."}, 40),
}
PEM_BEGIN, PEM_END = "-----BEGIN ", "-----END "
#: A credential's value has so many characters at least where it stands in quotes, and where it does not.
QUOTED, BARE = 8, 12
#: Between a credential's word and its value stand at most so many more characters of its name.
NAME_CHARS = 32


def spellings(words: str) -> set[str]:
    """A cue in lower, upper, capital and camel case, with each way to join two words."""
    joined = {j.join(words.split(" ")) for j in (" ", "_", "-", "")}
    camel = words.title().replace(" ", "")
    return {x for w in joined for x in (w, w.upper(), w.capitalize(), w.title())} | {camel, camel[0].lower() + camel[1:]}


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    cues = {"@": (AT,), "+": (PLUS,), "://": (SCHEME,), PEM_BEGIN: (BEGIN,), PEM_END: (END,)} | dict.fromkeys(string.digits, (DIGIT,))
    cues |= {w: (kind,) for kind, words in ((IBAN, ("iban",)), (SSN, ("ssn",)), (CUE, CREDENTIALS), (BEARER, ("bearer ",))) for word in words for w in spellings(word)}
    cues |= {p: (PREFIX, p) for p in PREFIXES}
    for cue, value in cues.items():
        found.add_word(cue, value)
    found.make_automaton()
    return found


def emails(text: str, ats: list[int]) -> list[Span]:
    """From an at-sign left over the local part and right over dotted labels."""
    out: list[Span] = []
    free, n = 0, len(text)
    for at in ats:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        while end < n and text[end] in _LABEL:
            end += 1
        if start == at or end == at + 1:
            continue
        dotted = False
        while end + 1 < n and text[end] == "." and text[end + 1] in _LABEL:
            dotted = True
            end += 2
            while end < n and text[end] in _LABEL:
                end += 1
        if dotted:
            out.append((start, end))
            free = end
    return out


def runs_of(places: list[int]) -> list[Span]:
    """Maximal runs of neighbouring digits."""
    out: list[list[int]] = []
    for p in places:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [(s, e) for s, e in out]


def octet(digits: str) -> bool:
    """At most 255, however many zeros it begins with."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def addresses(text: str, runs: list[Span]) -> list[Span]:
    """Four digit runs joined by dots, each at most 255."""
    out, i = [], 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(octet(text[s:e]) for s, e in four):
                out.append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def cards(text: str, runs: list[Span]) -> list[Span]:
    """Chains of digit runs with one space or hyphen between: 13 to 19 digits that pass Luhn's check."""
    out, i = [], 0
    while i < len(runs):
        j, digits = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            digits += runs[j][1] - runs[j][0]
        if 13 <= digits <= 19 and luhn("".join(text[s:e] for s, e in runs[i : j + 1])):
            out.append((runs[i][0], runs[j][1]))
        i = j + 1
    return out


def phones(text: str, pluses: list[int]) -> list[Span]:
    """From a plus sign over digits and separators to the last digit: 9 to 15 digits."""
    out, n = [], len(text)
    for p in pluses:
        if p + 1 >= n or text[p + 1] not in _DIGITS:
            continue
        end = last = p + 2
        digits = count = 1
        while end < n and text[end] in _PHONE:
            end += 1
            if text[end - 1] in _DIGITS:
                count += 1
                last, digits = end, count
        if last >= p + 4 and 9 <= digits <= 15:
            out.append((p, last))
    return out


def ibans(text: str, cues: list[int]) -> list[Span]:
    """After the word IBAN: country, check digits and up to 30 letters or digits in groups; the remainder by 97 is 1."""
    out = []
    for cue in cues:
        s = cue + 1
        while s < len(text) and s < cue + 4 and text[s] in ": \t.":
            s += 1
        e, kept = s, ""
        while e < len(text) and len(kept) < 34 and (text[e] in _ACCOUNT or text[e] == " " and e + 1 < len(text) and text[e + 1] in _ACCOUNT):
            kept += text[e].strip()
            e += 1
        while len(kept) >= 15:
            code = kept[4:] + kept[:4]
            if kept[:2].isalpha() and kept[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code)) % 97 == 1:
                out.append((s, e))
                break
            e -= 1
            kept = kept[: len(kept) - (text[e] != " ")]
    return out


def logins(text: str, schemes: list[int]) -> list[Span]:
    """scheme://user:password@ in a URL, from the scheme's first letter to the at-sign."""
    out = []
    for colon in schemes:
        s = colon
        while s > 0 and text[s - 1] in _SCHEME:
            s -= 1
        e = colon + 3
        while e < len(text) and text[e] not in _NO_LOGIN:
            e += 1
        if s < colon and e < len(text) and text[e] == "@" and ":" in text[colon + 3 : e]:
            out.append((s, e + 1))
    return out


def social_numbers(text: str, cues: list[int]) -> list[Span]:
    """After the word SSN: 3, 2 and 4 digits with hyphens or spaces."""
    out = []
    for cue in cues:
        s = cue + 1
        while s < len(text) and s < cue + 4 and text[s] in ": #\t.":
            s += 1
        part = text[s : s + 11]
        if len(part) == 11 and all((c in _DIGITS) != (i in (3, 6)) for i, c in enumerate(part)) and part[3] in "- " and part[6] in "- " and text[s + 11 : s + 12] not in _DIGITS:
            out.append((s, s + 11))
    return out


def looks_random(value: str, least: int) -> bool:
    """Long enough, with letters and digits (or signs) mixed, and neither one character over and over nor a place-holder."""
    kinds = sum(any(c in kind for c in value) for kind in (string.ascii_lowercase, string.ascii_uppercase, string.digits, "_-./+=~$!@#%^&*|?"))
    return len(value) >= least and kinds >= 2 and len(set(value)) >= 5 and (least == QUOTED or any(c in _DIGITS for c in value))


def assigned(text: str, cues: list[tuple[int, bool]]) -> list[Span]:
    """Values of credentials: name, separator, value, the value in quotes or bare; or what follows `bearer`.

    `cues` are the last characters of the words, and whether the value follows at once.  The span is the value's.
    """
    out: list[Span] = []
    free, n = 0, len(text)
    for cue, at_once in cues:
        s = cue + 1
        if s < free:
            continue
        if not at_once:
            while s < n and s - cue <= NAME_CHARS and text[s] in _NAME:
                s += 1
            s += s < n and text[s] in _QUOTES  # a quoted name
            while s < n and text[s] in " \t" and s - cue <= 2 * NAME_CHARS:
                s += 1
            sign = s
            while s < n and s - sign < 2 and text[s] in ":=>":
                s += 1
            if s == sign:
                continue
        while s < n and text[s] in " \t" and s - cue <= 3 * NAME_CHARS:
            s += 1
        if text[s : s + 7].lower() == "bearer ":
            s += 7
        quote = text[s : s + 1] if text[s : s + 1] in _QUOTES else ""
        s += len(quote)
        e = s
        while e < n and (text[e] not in _QUOTES and text[e] > " " if quote else text[e] in _VALUE):
            e += 1
        free = max(free, e)
        if quote and text[e : e + 1] != quote:
            continue
        while not quote and e > s and text[e - 1] in ".!?":  # the sentence's
            e -= 1
        if looks_random(text[s:e], QUOTED if quote else BARE):
            out.append((s, e))
    return out


def known_keys(text: str, starts: list[tuple[int, str]]) -> list[Span]:
    """Keys by their prefixes: no letter or digit before, and enough characters of the right kind after."""
    out: list[Span] = []
    free, n = 0, len(text)
    for s, prefix in starts:
        if s < free or s > 0 and text[s - 1] in _ALNUM:
            continue
        kind, least = PREFIXES[prefix]
        e = first = s + len(prefix)
        while e < n and text[e] in kind:
            e += 1
        free = e
        while e > first and text[e - 1] in ".-":
            e -= 1
        body = text[first:e]
        if e - first >= least and (prefix != "eyJ" or body.count(".") == 2) and any(c in _DIGITS for c in body):
            out.append((s, e))
    return out


def private_keys(text: str, begins: list[int], ends: list[int]) -> list[Span]:
    """From a private key's header line to its last line, or the header alone where that line is missing."""
    out: list[Span] = []
    lines = ((s, text.find("-----", s + len(PEM_BEGIN), s + 64)) for s in begins)
    headers = [(s, e + 5) for s, e in lines if e > 0 and text[s + len(PEM_BEGIN) : e].endswith("PRIVATE KEY")]
    at = 0
    for i, (s, e) in enumerate(headers):
        until = headers[i + 1][0] if i + 1 < len(headers) else len(text)
        while at < len(ends) and ends[at] < e:
            at += 1
        close = text.find("-----", ends[at] + len(PEM_END), ends[at] + 64) if at < len(ends) and ends[at] < until else -1
        out.append((s, close + 5 if close > 0 else e))
    return out


def apart(spans: Iterable[Span]) -> list[Span]:
    """Leftmost spans that do not overlap, the longest of those that begin together."""
    out: list[Span] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """Spans by kind, in code points, end exclusive; per kind leftmost and not overlapping."""
    at: list[list[int]] = [[] for _ in range(11)]
    prefixes: list[tuple[int, str]] = []
    for end, found in automaton.iter(text):
        if found[0] == PREFIX:
            prefixes.append((end + 1 - len(found[1]), found[1]))
        else:
            at[found[0]].append(end)
    cues = sorted([(e, False) for e in at[CUE]] + [(e, True) for e in at[BEARER]]) if at[CUE] or at[BEARER] else []
    pem = [[e + 1 - len(x) for e in at[k]] for k, x in ((BEGIN, PEM_BEGIN), (END, PEM_END))]
    secrets = [*assigned(text, cues), *known_keys(text, sorted(prefixes)), *private_keys(text, *pem)]
    runs = runs_of(at[DIGIT])
    return {
        "email": emails(text, at[AT]),
        "ip": addresses(text, runs),
        "card": cards(text, runs),
        "phone": phones(text, at[PLUS]),
        "iban": ibans(text, at[IBAN]),
        "login": logins(text, [e - 2 for e in at[SCHEME]]),
        "ssn": social_numbers(text, at[SSN]),
        "secret": apart(secrets) if secrets else secrets,
    }


def listed(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def _find(batches: Batches) -> Batches:
    automaton = anchors()
    for b in batches:
        rows = [find(x or "", automaton) for x in b.column("text").to_pylist()]
        base = [listed(r, BASE) for r in rows]
        more = [listed(r, ADDED) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                *(pa.array([len(r[k]) for r in rows], pa.int64()) for k in BASE),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                pa.array([f"{x},{y}" if x and y else x or y for x, y in zip(base, more, strict=True)], pa.string()),
                *(pa.array([len(r[k]) for r in rows], pa.int64()) for k in ADDED),
                pa.array([sum(map(len, r.values())) for r in rows], pa.int64()),
            ],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in ADDED), "n_spans"],
        )


FOUND = ", ".join(["doc_id long", *(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string", *(f"n_{k} long" for k in ADDED), "n_spans long"])


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, counts of added kinds, n_spans), one row per row of `df`.

    A null text is the empty text, which has no spans: `spans` is then empty and the digest that of nothing.  Rows
    are read one by one, so null or repeated identifiers and other columns do not matter, and an empty table gives no
    rows.  A text of any length is read whole, in time linear in it.  `spans` lists kind:start:end by kind and start,
    the base kinds first; `n_spans` is their number, so that it is positive where anything was found.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_find), FOUND)
