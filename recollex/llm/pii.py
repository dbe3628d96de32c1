"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, `://`, key prefixes and words that
announce an account, a secret or a street. A deterministic parser for each kind expands an anchor to the left and right
and validates what it finds; each parser reads every character a bounded number of times.

email, ip, card and phone are the base kinds, with the leftmost non-overlapping matches of these patterns:
email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, ip `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)` with parts up to
255, card `[0-9]([\\x20-]?[0-9])+` of 14 to 19 digits that pass Luhn, phone `\\+[0-9][\\x20().0-9-]+[0-9]` of 10 to 15
digits; a match that fails is dropped and not tried again. The further kinds:

* account: an IBAN that passes its checksum, or 8 to 17 digits, within 16 characters after a word that announces it;
* key: AKIA or ASIA and 16 capitals or digits, another service's prefix and 16 or more letters, digits, - or _, or a
  private key from its BEGIN line to its END line (the BEGIN line alone, if that is missing);
* login: user:password before the first at-sign behind `://`, however long;
* secret: the value behind a word such as token or password and = or :, of 8 or more characters (quotes end it, as do
  white space and , ; < >) of which one is no small letter;
* street: a number, up to four capitalised words and Street, Road and the like; a capitalised German word in straße, weg
  and the like and a number; a number, rue and the like and up to four words, the last one capitalised; Calle and the like, up to four
  words and a number.

Defined results: a null or empty text holds nothing. Spans are code points, the end exclusive. Repeated rows give
repeated rows.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "key", "login", "secret", "street")
#: Words that announce an account number, or a secret; prefixes of keys; words of streets by the order of their parts: fixed values.
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
SECRETS = ("token", "secret", "password", "passwd", "passwort", "api_key", "apikey", "api-key", "access_key")
PREFIXES = ("ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_")
STREETS = {
    "after": ("Street", "Road", "Avenue", "Lane", "Boulevard", "Drive"),
    "german": ("straße", "strasse", "weg", "platz", "allee"),
    "french": ("rue", "avenue", "boulevard", "chemin"),
    "spanish": ("Calle", "Avenida", "Plaza", "Paseo"),
}

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DOMAIN = _LETTERS | _DIGITS | {"-"}
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_DIALLED = _DIGITS | frozenset(" ().-")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


@functools.lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in _DIGITS:
        found.add_word(c, "digit")
    words = [("@", "at"), ("+", "plus"), ("://", "scheme"), ("AKIA", "key"), ("ASIA", "key"), ("-----BEGIN ", "private")]
    words += [(x, "prefix") for x in PREFIXES]
    words += [(x, kind) for kind, own in STREETS.items() for x in own]
    words += [(x, kind) for own, kind in ((CUES, "cue"), (SECRETS, "secret")) for cue in own for x in (cue, cue.capitalize(), cue.upper())]
    for word, kind in words:
        found.add_word(word, kind)
    found.make_automaton()
    return found


def emails(text: str, ats: list[int]) -> Iterator[Span]:
    end = 0
    for at in ats:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        to = _domain(text, at + 1)
        if start < at and to:
            yield start, 0, to
            end = to


def _domain(text: str, at: int) -> int:
    """The end of a host name of two labels or more that begins at `at`, or 0."""
    n, to, labels = len(text), at, 0
    while True:
        start = to
        while to < n and text[to] in _DOMAIN:
            to += 1
        if to == start:
            return to - 1 if labels > 1 else 0
        labels += 1
        if to >= n or text[to] != ".":
            return to if labels > 1 else 0
        to += 1


def runs(digits: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of neighbouring places."""
    found: list[tuple[int, int]] = []
    for i in digits:
        if found and found[-1][1] == i:
            found[-1] = (found[-1][0], i + 1)
        else:
            found.append((i, i + 1))
    return found


def ips(text: str, digits: list[tuple[int, int]]) -> Iterator[Span]:
    i = 0
    while i + 3 < len(digits):
        four = digits[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(len(part) <= 3 and int(part or 0) <= 255 for a, b in four for part in [text[a:b].lstrip("0")]):
                yield four[0][0], 1, four[3][1]
            i += 4
        else:
            i += 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def cards(text: str, digits: list[tuple[int, int]]) -> Iterator[Span]:
    i = 0
    while i < len(digits):
        j, n = i, digits[i][1] - digits[i][0]
        while j + 1 < len(digits) and digits[j + 1][0] == digits[j][1] + 1 and text[digits[j][1]] in " -":
            j += 1
            n += digits[j][1] - digits[j][0]
        if 14 <= n <= 19 and luhn("".join(text[a:b] for a, b in digits[i : j + 1])):
            yield digits[i][0], 2, digits[j][1]
        i = j + 1


def phones(text: str, pluses: list[int]) -> Iterator[Span]:
    n = len(text)
    for at in pluses:
        if at + 1 >= n or text[at + 1] not in _DIGITS:
            continue
        to, last, count = at + 2, 0, 1
        while to < n and text[to] in _DIALLED:
            if text[to] in _DIGITS:
                count += 1
                last = to
            to += 1
        if last >= at + 3 and 10 <= count <= 15:
            yield at, 3, last + 1


def _iban(text: str, at: int) -> int:
    """The end of an IBAN that begins at `at`, or 0."""
    code, to, n = "", at, len(text)
    while to < n and len(code) < 34 and (text[to] in _CAPITALS or text[to] == " " and to + 1 < n and text[to + 1] in _CAPITALS):
        if text[to] != " ":
            code += text[to]
        to += 1
        if len(code) >= 15 and (to >= n or text[to] not in _CAPITALS) and code[:2].isalpha() and code[2:4].isdigit():
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return to
    return 0


def accounts(text: str, cues: list[int]) -> Iterator[Span]:
    """After a cue, and at most 16 characters of words and signs that hold no digit, an IBAN or a run of digits."""
    end = 0
    for cue in cues:
        for at in range(max(cue, end), min(cue + 17, len(text))):
            if text[at] in _DIGITS:
                to = at
                while to < len(text) and text[to] in _DIGITS:
                    to += 1
                if 8 <= to - at <= 17:
                    yield at, 4, to
                    end = to
                break
            if text[at] in _CAPITALS and (at == 0 or text[at - 1] not in _LETTERS) and (to := _iban(text, at)):
                yield at, 4, to
                end = to
                break


_PLAIN = _LETTERS | _DIGITS
_KEYED = _PLAIN | {"-", "_"}


def keys(text: str, ends: list[int]) -> Iterator[Span]:
    """A prefix of four capitals, that ends at each of ends, and 16 capitals or digits."""
    for to in ends:
        body = text[to : to + 16]
        if len(body) == 16 and all(c in _CAPITALS for c in body) and text[to + 16 : to + 17] not in _CAPITALS and (to < 5 or text[to - 5] not in _PLAIN):
            yield to - 4, 5, to + 16


def prefixed_keys(text: str, ends: list[int]) -> Iterator[Span]:
    done = 0
    for at in ends:
        start = at - next(len(x) for x in PREFIXES if text.endswith(x, 0, at))
        if start < done or (start and text[start - 1] in _KEYED):
            continue
        to = at
        while to < len(text) and text[to] in _KEYED:
            to += 1
        if to - at >= 16:
            yield start, 5, to
            done = to


def private_keys(text: str, ends: list[int]) -> Iterator[Span]:
    """From -----BEGIN to the END line of the same name, if the name is of a private key."""
    done = 0
    for at in ends:
        to = at
        while to < len(text) and to - at < 40 and (text[to] in _CAPITALS or text[to] == " "):
            to += 1
        name = text[at:to]
        if at - 11 < done or not name.endswith("PRIVATE KEY") or not text.startswith("-----", to):
            continue
        last, stop = f"-----END {name}-----", text.find("-----BEGIN ", to)
        end = text.find(last, to, stop if stop >= 0 else len(text))
        done = end + len(last) if end >= 0 else to + 5
        yield at - 11, 5, done


def logins(text: str, schemes: list[int]) -> Iterator[Span]:
    """user:password between a scheme and an at-sign."""
    for start in schemes:
        to = start
        while to < len(text) and text[to] not in "@/?# \t\r\n":
            to += 1
        if to < len(text) and text[to] == "@" and ":" in text[start + 1 : to - 1]:
            yield start, 6, to


def secrets(text: str, ends: list[int]) -> Iterator[Span]:
    done = 0
    for at in ends:
        if at < done:
            continue
        to = at + (text[at : at + 1] in ("'", '"'))
        to = _blank(text, to)
        if text[to : to + 1] not in ("=", ":") or not text[to : to + 1]:
            continue
        to = _blank(text, to + 1)
        start = to = to + (text[to : to + 1] in ("'", '"'))
        while to < len(text) and text[to] not in "'\",;<> \t\r\n":
            to += 1
        if to - start >= 8 and any(not c.islower() for c in text[start:to]):
            yield start, 7, to
            done = to


def _blank(text: str, at: int) -> int:
    """Behind up to three spaces."""
    to = at
    while to < len(text) and to - at < 3 and text[to] == " ":
        to += 1
    return to


def _word_before(text: str, at: int) -> int:
    """Where the word of letters that ends at `at` begins; words of over 40 letters have no beginning (-1)."""
    start = at
    while start and text[start - 1].isalpha():
        start -= 1
        if at - start > 40:
            return -1
    return start


def _word_after(text: str, at: int) -> int:
    to = at
    while to < len(text) and text[to].isalpha():
        to += 1
        if to - at > 40:
            return at
    return to


def _number_before(text: str, at: int) -> int:
    """Where a number of up to five digits, which ends at `at`, begins, or -1."""
    start = at
    while start and text[start - 1] in _DIGITS and at - start < 6:
        start -= 1
    return start if 0 < at - start < 6 and (not start or not (text[start - 1].isalnum() or text[start - 1] in ".,-")) else -1


def _number_after(text: str, at: int) -> int:
    """The end of a number of up to five digits, with a small letter perhaps, that begins at `at`, or -1."""
    to = at
    while to < len(text) and text[to] in _DIGITS and to - at < 6:
        to += 1
    if not 0 < to - at < 6:
        return -1
    if to < len(text) and "a" <= text[to] <= "z":
        to += 1
    return -1 if to < len(text) and text[to].isalnum() else to


def streets(text: str, places: dict[str, list[int]]) -> Iterator[Span]:
    n = len(text)
    alone = lambda to: to >= n or not text[to].isalpha()
    for to in places["after"]:
        at = _word_before(text, to)
        if not alone(to) or text[at:to] not in STREETS["after"]:
            continue
        for words in range(5):
            if at < 2 or text[at - 1] != " ":
                break
            if words and (start := _number_before(text, at - 1)) >= 0:
                yield start, 8, to
                break
            before = _word_before(text, at - 1)
            if before < 0 or before == at - 1 or not text[before].isupper():
                break
            at = before
    for end in places["german"]:
        start = _word_before(text, end)
        if start >= 0 and alone(end) and text[start].isupper() and text[end : end + 1] == " " and (to := _number_after(text, end + 1)) >= 0:
            yield start, 8, to
    for end in places["french"]:
        at = _word_before(text, end)
        comma = at - 2 if text[at - 2 : at] == ", " else at - 1
        if text[at:end] not in STREETS["french"] or not alone(end) or at < 2 or text[at - 1] != " " or (start := _number_before(text, comma)) < 0:
            continue
        to = end
        for _ in range(4):
            if text[to : to + 1] not in (" ", "'", "’") or (after := _word_after(text, to + 1)) == to + 1:
                break
            if text[to + 1].isupper():
                yield start, 8, after
                break
            to = after
    for end in places["spanish"]:
        start, to = _word_before(text, end), end
        if text[start:end] not in STREETS["spanish"] or not alone(end):
            continue
        for words in range(5):
            gap = 2 if text.startswith(", ", to) else 1
            if words and text[to : to + 1] in (" ", ",") and (after := _number_after(text, to + gap)) >= 0:
                yield start, 8, after
                break
            if text[to : to + 1] != " " or (after := _word_after(text, to + 1)) == to + 1:
                break
            to = after


def spans(text: str) -> list[Span]:
    """All spans of a text by start, then by kind."""
    places: dict[str, list[int]] = defaultdict(list)
    for end, kind in anchors().iter(text):
        places[kind].append(end)
    if not places:
        return []
    digits = runs(places["digit"])
    after = defaultdict(list, {k: [i + 1 for i in own] for k, own in places.items()})
    return sorted([
        *emails(text, places["at"]),
        *ips(text, digits),
        *cards(text, digits),
        *phones(text, places["plus"]),
        *accounts(text, after["cue"]),
        *keys(text, after["key"]),
        *prefixed_keys(text, after["prefix"]),
        *private_keys(text, after["private"]),
        *logins(text, after["scheme"]),
        *secrets(text, after["secret"]),
        *streets(text, after),
    ])


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(x.as_py() or "")] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, _TYPE)], ["doc_id", "found"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and found, the spans (kind, start, end) of each row's text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_found, f"doc_id long, found {_SPANS}")


def redacted(text: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at, to = [], 0, -1
    for start, kind, end in spans(text):
        if start >= to:
            out += [text[at : max(at, start)], f"<{KINDS[kind].upper()}>"]
        at = to = max(to, end)
    return "".join([*out, text[at:]])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = pa.array([x if x is None else redacted(x) for x in batch.column(at).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in `text`, and `n_chars`, if there is one, counted anew."""
    out = docs.mapInArrow(_redacted, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def told(base: bool):
        own = F.filter("found", lambda s: s["kind"].isin(*BASE)) if base else F.col("found")
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(told(True), 256).alias("base_sha256"), told(False).alias("spans"), F.size("found").cast("long").alias("n_spans"))
