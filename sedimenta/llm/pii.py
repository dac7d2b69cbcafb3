"""Personal information inside free text: find it and replace it with typed placeholders.

Anchor expansion. One Aho-Corasick automaton runs over a text and reports anchors: at-signs and their spellings, schemes
(``://``, ``tel:``), known name parts, words that introduce a person, words of streets, cues of identity numbers, and digits
beside separators. Around each anchor a deterministic local parser expands to the boundaries, however far they are, and
validates them. Whole texts are read, and spans are in characters of the text. Parsers stop at what can't belong to their
kind, so that a text costs in proportion to its length.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "idnum", "street", "person")


def _ranges(wanted) -> str:
    """The characters that ``wanted`` holds for, as ranges of a regular expression's class."""
    out, codes = [], [c for c in range(sys.maxunicode + 1) if wanted(chr(c))]
    at = 0
    for k, c in enumerate(codes):
        if k + 1 == len(codes) or codes[k + 1] != c + 1:
            out.append(re.escape(chr(codes[at])) + "-" + re.escape(chr(c)))
            at = k + 1
    return "".join(out)


#: Capital and small letters of every script that has both, and letters of those that haven't.
_U, _L = _ranges(str.isupper), _ranges(str.islower)
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"
_OTHER = _ranges(lambda c: c.isalpha() and not ("A" <= c <= "Z" or "a" <= c <= "z" or "\u00aa" <= c <= "\u024f" or "\u1e00" <= c <= "\u1eff"))

# --- emails -------------------------------------------------------------------------------------------------------
#: Spellings of the at-sign that anchor an email.
AT_SIGNS = ("@", "＠", "&#64;", "&#x40;", "&commat;", "%40", "(at)", "[at]", "{at}", "<at>", "(AT)", "[AT]", " AT ", " at ", "(a)", "[a]", "_at_", " At ")
_WORD_DOT = r"(?:\s?[(\[{<](?:dot|DOT)[)\]}>]\s?|\sDOT\s|\sdot\s|\sDot\s)"
_DOT = rf"(?:\.|{_WORD_DOT})"
#: A label of a domain, and a run of an address's local part, are of Latin letters or of others, never of both: where the
#: script changes, text begins that has no space before it.
_LABEL = rf"(?:[{_LATIN}0-9](?:[{_LATIN}0-9-]*[{_LATIN}0-9])?|[{_OTHER}](?:[{_OTHER}0-9-]*[{_OTHER}0-9])?)"
_DOMAIN = re.compile(rf"(?P<gap>\s?)(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})+)")
_IS_LATIN, _IS_OTHER = re.compile(rf"[{_LATIN}]"), re.compile(rf"[{_OTHER}]")
_DOT_BEFORE = re.compile(rf"{_WORD_DOT}$")
_SPELLED_DOT = re.compile(r"\s[(\[{<]?dot", re.I)
_REMOTE_PATH = re.compile(r":(?:[~\w.-]+/|\d+/|[\w.-]+\.git)")
#: Endings of file names that are no top-level domains.
_FILE = re.compile(r"\.(?:png|jpe?g|gif|svg|ico|webp|js|ts|css|html?|json|ya?ml|xml|txt|rb|go|java|c|h|gz|git)$", re.I)
_VERSION = re.compile(r"\d+x\.|v?\d[\w.-]*$")


def _run(text: str, end: int, dots: bool = True) -> int:
    """Begin of the run of characters of a local part that ends at ``end``; of one script."""
    i, script = end, None
    while i:
        c = text[i - 1]
        if c.isalpha():
            kind = _IS_LATIN if _IS_LATIN.match(c) else _IS_OTHER
            if script is None:
                script = kind
            if kind is not script:
                break
        elif not ("0" <= c <= "9" or c in "_+-" or dots and c == "."):
            break
        i -= 1
    return i


def _local(text: str, at: int, spelled: bool) -> tuple[int, int] | None:
    """(begin, end) of the local part before an at-sign at ``at``, one blank between them at most."""
    end = at
    if end and (text[end - 1] == " " or spelled and text[end - 1].isspace()):
        end -= 1
    b = _run(text, end)
    if b == end or text[end - 1] == ".":
        return None
    while spelled:  # words for dots part it: what stands behind one has no dots of its own
        if "." in text[b:end]:
            break
        m = _DOT_BEFORE.search(text, max(0, b - 8), b)
        if not m:
            break
        before = _run(text, m.start())
        if before == m.start() or text[m.start() - 1] == ".":
            break
        b, inner = before, text[before : m.start()]
        if "." in inner:
            break
    while b < end and text[b] in ".+-":
        b += 1
    return (b, end) if b < end else None


def email_at(text: str, at: int, end: int, scheme_end: int = -1) -> tuple[int, int] | None:
    """The address whose at-sign stands at text[at:end]; before ``scheme_end`` a remote's name goes on."""
    sign = text[at:end].strip()
    spelled = sign not in ("@", "\uff20")
    left = _local(text, at, spelled)
    right = _DOMAIN.match(text, end) if left else None
    if not right or not spelled and (left[1] < at) != bool(right["gap"]):
        return None
    b, e, domain = left[0], right.end(), right["domain"]
    plain = re.sub(_DOT, ".", domain)
    top = plain.rpartition(".")[2]
    if not (top.isalpha() and 2 <= len(top) <= 63):
        return None
    if sign.lower() == "at" and not _SPELLED_DOT.search(domain):
        return None  # "at" in a sentence
    before = text[b - 1] if b else ""
    if before and before in "}$%":
        return None  # a template
    if before and before in "/:" and b < scheme_end:
        return None  # user of a remote
    if e < len(text) and text[e] == ":" and not spelled and _REMOTE_PATH.match(text, e):
        return None  # a repository remote
    if _FILE.search(plain) or _VERSION.match(plain):
        return None
    if e < len(text) and text[e] in "${" and not spelled:
        return None
    return b, e


# --- phones -------------------------------------------------------------------------------------------------------
_PHONE = re.compile(
    r"(?<![\w+.,/-])(?:"
    r"\+\d{1,3}[ .-]?\(0\)[ ]?\d{2,4}(?:[ .-]?\d{2,5}){1,4}"  # +44 (0)161 496 0904
    r"|\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,5}(?:[ .-]?\d{2,5}){1,3}"
    r"|\+\d{1,3}(?:[ .-]\d{1,5}){2,5}|\+\d{9,15}"
    r"|00[1-9]\d{0,2}(?:[ .-]\d{1,5}){2,5}"  # 0044 20 7946 0061
    r"|(?:1[-. ])?\(\d{3}\)[ -]?\d{3}[-. ]\d{4}|(?:1[-.])?\d{3}-\d{3}-\d{4}|(?:1[-.])?\d{3}\.\d{3}\.\d{4}"
    r"|\(0\d{1,4}\)[ /-]?\d{2,5}(?:[ -]\d{2,5}){1,3}"
    r"|0\d{1,4}/\d{3,8}(?:-\d{1,5})?"  # 030/23125-994
    r"|0[1-9]\d{1,3} \d{3,4} \d{3,4}"  # 020 7946 0988
    r")(?![\w]|[.,/-]\d)"
)
_RUN = frozenset("0123456789 +().-/")
#: What stands behind a scheme of calls is a number, with or without country code.
CALLS = ("tel:", "callto:", "sms:")
_CALL = re.compile(r"\+?(?:[0-9]|[().-](?=[0-9(])){7,30}")
#: Words before a number that say what else it is, and the characters that such words and their signs take at most.
_WHAT_ELSE = 40
_NOT_PHONE = re.compile(r"(?:\b(?:part|sku|serial|order|invoice|build|version|bind|isbn|item|model|ticket|lot|batch)\b[ \w]{0,4}[.:#]?\s*(?:no\.?|number|nr\.?)?\s*[:#=]?\s*)$", re.I)
_PAIRS = tuple(f"{a}{s}{b}" for s in ("-", ".", "/", " ") for a in "0123456789" for b in "0123456789") + tuple(f"+{d}" for d in "123456789") + tuple(f"){s}{d}" for s in ("", " ", "-") for d in "0123456789")


def phones_in(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Phone numbers inside a run of digits and separators."""
    for m in _PHONE.finditer(text, lo, hi):
        digits = sum(c.isdigit() for c in m[0])
        if 9 <= digits <= 15 and not _NOT_PHONE.search(text[max(0, m.start() - _WHAT_ELSE) : m.start()]):
            yield m.start(), m.end()


# --- identity numbers ---------------------------------------------------------------------------------------------
#: What makes a number a person's: first words and second words of names of such numbers, and names of one word.
ID_NAMES = (
    (("social", "soc.", "soc"), ("security", "insurance", "sec")),
    (("national",), ("insurance", "id", "identity", "identification", "no", "number")),
    (("ni",), ("number", "no")),
    (("id",), ("card",)),
    (("identity", "identification"), ("card", "document", "no", "number")),
    (("citizen",), ("no", "number", "id")),
    (("pass",), ("nr", "no")),
    (("tax",), ("id", "identification", "number", "no", "payer")),
    (("personal",), ("id", "identity", "identification", "number")),
    (("steuer",), ("id", "nummer", "identifikationsnummer")),
    (("sozialversicherungs",), ("nr", "nummer")),
)
ID_WORDS = ("ssn", "nino", "tin", "passport", "taxpayer")
#: "Ni", "pass" and the like need a sign between their words; others may be written as one.
_APART = ("ni", "pass", "soc.", "soc", "citizen", "personal")
ID_CUES = (*ID_WORDS, *(f"{a}{s}{b}" for first, second in ID_NAMES for a in first for b in second for s in ((" ", "_", "-") if a in _APART else (" ", "_", "-", ""))))
_ID = re.compile(
    r"(?<![\w/.-])(?:\d{3}([- ])\d{2}\1\d{4}|\d{9}|\d{2}-\d{7}|\d{2,3}/\d{3}/\d{4,5}|\d{4} \d{3} \d{4}|\d{10,12}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|ID-\d{6,12}|[A-Z]{1,2}\d{6,9}|[A-Z]\d{3,4}[A-Z]{2}\d{2}|[A-Z]{2,3}-\d{6,9})(?![\w/]|[-.]\d)"
)
#: Between a cue and its number: further words of the name, then signs (as many as a table or markup puts there) and any blanks.
_AFTER = re.compile(r"(?:[._ -]*(?:no|nr|num|number|id|card|code|security|sec|insurance|value|is|was)\b)*+(?:[^\S\n]*+[\n\"'`:=.,#>()\[\]-]){0,12}[^\S\n]*+", re.I)
_BEFORE = re.compile(r"[\"'`)\];,\s]{0,6}(?:(?:#|//|--|/\*|;|%|<!--)\s*)?[\s(\[]{0,3}(?:(?:personal|her|his|their|the|a)\s)?$", re.I)


def id_at(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The number that the cue at text[at:end] names: right behind it, or right before it."""
    if (at and (text[at - 1].isalnum())) or (end < len(text) and text[end].isalpha() and not text[at:end].lower().endswith(("no", "taxpayer", "passport"))):
        return None
    m = _AFTER.match(text, end)
    hit = _ID.match(text, m.end()) if m else None
    if hit and _counts(hit[0]):
        return hit.span()
    lo = max(0, at - _ID_REACH)
    line = text.rfind("\n", lo, at) + 1
    last = None
    for hit in _ID.finditer(text, max(lo, line), at):
        last = hit
    if last and _counts(last[0]) and _BEFORE.match(text[last.end() : at]):
        return last.span()
    return None


#: Longest number in front of a cue plus longest text between them, by the patterns above.
_ID_REACH = 60


def _counts(number: str) -> bool:
    """Nobody's number has only zeros, or a group of them in the form of nine digits in three groups."""
    groups = re.findall(r"\d+", number)
    return any(c in "123456789" for c in number) and not (len(groups) == 3 and [len(g) for g in groups] == [3, 2, 4] and any(not g.strip("0") for g in groups))


# --- streets ------------------------------------------------------------------------------------------------------
_CAP = rf"[{_U}]\w*(?:['’-]\w+)*"
_WAYS = ("Street", "St", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Terrace", "Close", "Court", "Ct", "Drive", "Dr", "Way", "Place", "Square", "Crescent", "Boulevard", "Blvd", "Row", "Walk", "Grove", "Gardens", "Mews", "Parade", "Highway")
_TAILS = ("straße", "strasse", "weg", "gasse", "allee", "platz", "damm", "ufer", "str.", "STRASSE", "WEG")
_HEADS = ("rue", "Rue", "avenue", "Via", "via", "Viale", "Piazza", "Calle", "calle", "Avenida", "Rua", "Plaza", "Straße", "boulevard", "allée", "place")
_NUMBER = r"\d{1,5}(?:\s?[-/]\s?\d{1,4})?\s?[A-Ha-h]?"
_STREET = re.compile(
    rf"(?<![\w.,-])\d{{1,5}}(?:-\d{{1,4}})?[A-Ha-h]?(?: ?1/2)?,? (?:[NSEW]{{1,2}}\.? )?(?:{_CAP} ){{1,3}}(?:{'|'.join(_WAYS)})\b(?!\w)"
    rf"|(?<![\w-]){_CAP}(?<=(?:aße|weg|sse|lee|atz|amm|fer)) \d{{1,5}}(?:-\d{{1,4}})?(?: ?[a-h])?(?!\w)"
    rf"|(?<![\w-])(?:{_CAP} )?(?:[A-Za-zÀ-ÿ]+str\.|Straße|Weg|Allee|Platz) \d{{1,5}}[a-h]?(?!\w)"
    rf"|(?<![\w.,-])\d{{1,5}}(?: ?(?:bis|ter|quater))?,? (?:rue|Rue|avenue|boulevard|allée|place|chemin|quai) (?:(?:de|du|des|la|le|les|de la|d') ?)*{_CAP}(?!\w)"
    rf"|(?<![\w-])(?:Via|Viale|Piazza|Corso|Calle|Avenida|Plaza|Rua) (?:(?:de|del|della|dei|la|da|do) )*{_CAP},? \d{{1,5}}(?:/[A-Za-z])?[a-h]?(?!\w)"
)


# --- persons ------------------------------------------------------------------------------------------------------
_W = rf"(?:[{_U}][{_L}]+|[{_U}]{{2,}})"
_FAM = rf"{_W}(?:-{_W})?"
_I = rf"[{_U}]\."
_PERSON = re.compile(
    rf"(?<![\w@.$-])(?<!\w['’])(?:(?P<f3>{_FAM}), (?P<g3>{_W}(?: {_I})*|{_I}(?: ?{_I})*)"
    rf"|(?P<g1>{_W})(?: {_I}){{0,2}} (?P<f1>{_FAM})"
    rf"|(?P<i2>{_I}(?: ?{_I}){{0,2}}) ?(?P<f2>{_FAM}))(?![\w@(]|-\w)"
)
#: Words that introduce a person.
BEFORE_PERSON = ("uthor: ", "uthors: ", "@author ", "igned-off-by: ", "ritten by ", "aintainer: ", "aintained by ", "eviewed-by: ", "eviewed by ", "cked-by: ", "eported-by: ", "ested-by: ", "o-authored-by: ", "typed by ", "hanks to ", "(c) ", "(C) ", "© ", "opyright ", "<name>", '"name": "', "'name': '", "name = '", 'name = "', "TODO(", "FIXME(", "XXX(", "HACK(", "ontact: ", "wner: ", "reated by ", "pproved by ", "Cc: ", "From: ", "VALUES (")
_GROUP = frozenset("the authors author team group foundation contributors project labs inc ltd gmbh llc corp company copyright all rights reserved licence license developers maintainers signed written todo fixme note this that these table values insert update select from where name street road lane street terrace close court avenue drive way".split())


def _known(word: str, names: frozenset) -> bool:
    return any(w.casefold() in names for w in word.split("-"))


def _case(word: str) -> str:
    return "u" if len(word) > 1 and word.isupper() else "t"


def person_in(m: re.Match, given: frozenset, family: frozenset, sure: bool) -> bool:
    """Whether the shape ``m`` is a person: a part is known as what it stands for, or the place is one for persons."""
    if m["f1"]:
        g, f = m["g1"], m["f1"]
    elif m["f2"]:
        g, f = None, m["f2"]
    else:
        g, f = m["g3"], m["f3"]
    words = [w for w in ([g] if g and "." not in g[:2] else []) + f.split("-")]
    if any(w.split(" ")[0].casefold() in _GROUP for w in words):
        return False
    if g and "." not in g[:2] and _case(g.split(" ")[0]) != _case(f.split("-")[0]):
        return False
    if sure:
        return True
    fk = _known(f, family)
    gk = bool(g) and _known(g.split(" ")[0], given)
    return fk or gk


# --- the operator -------------------------------------------------------------------------------------------------
def build(names: list[tuple[str, str]]):
    """(automaton of anchors, automaton of identity cues in lower case, given names, family names) for known name parts."""
    import ahocorasick

    given = frozenset(n.casefold() for n, k in names if k == "given" and n)
    family = frozenset(n.casefold() for n, k in names if k == "family" and n)
    auto = ahocorasick.Automaton()
    anchors: dict[str, set[str]] = {}

    def add(word: str, kind: str) -> None:
        anchors.setdefault(word, set()).add(kind)

    for w in AT_SIGNS:
        add(w, "at")
    add("://", "scheme")
    for w in CALLS:
        add(w, "call")
    for w in _PAIRS:
        add(w, "digit")
    for w in _WAYS:
        add(f" {w}", "street")
    for w in _TAILS:
        add(w, "street")
    for w in _HEADS:
        add(f"{w} ", "street")
    for n, _ in names:
        if n:
            add(n, "name")
            add(n.upper(), "name")
    for w in BEFORE_PERSON:
        add(w, "before")
    for w, kinds in anchors.items():
        auto.add_word(w, (len(w), tuple(sorted(kinds))))
    auto.make_automaton()
    cues = ahocorasick.Automaton()
    for w in ID_CUES:
        cues.add_word(w, len(w))
    cues.make_automaton()
    return auto, cues, given, family


_DATE = re.compile(r"\b\d{4}-\d\d-\d\d ")
#: Characters that the beginning of such a slot takes at most.
_SLOT_REACH = 24
_SLOT = re.compile(r"(?:^|[|;\n])[ \t]*(?:#|//|--|/\*|\*)?[ \t]*(?:\d{4}-\d\d-\d\d[ ,]+|\d+;|\| ?)$")


def _line(text: str, at: int) -> tuple[int, int]:
    """Begin and end of the line that holds ``at``."""
    hi = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, hi if hi >= 0 else len(text)


def _parts_before(text: str, at: int, parts: int = 8) -> int:
    """Begin of the ``parts``-th word or initial before ``at``, as far as nothing but signs of names stands between."""
    i = at
    while parts and i:
        j = i
        while j and i - j < 3 and text[j - 1] in " .,-'’":
            j -= 1
        k = j
        while k and text[k - 1].isalpha():
            k -= 1
        if k == j:
            return i
        i, parts = k, parts - 1
    return i


def _parts_after(text: str, at: int, parts: int = 8) -> int:
    """End of the ``parts``-th word or initial behind ``at``, with the character behind it."""
    n, i = len(text), at
    while parts and i < n:
        j = i
        while j < n and j - i < 3 and text[j] in " .,-'’":
            j += 1
        k = j
        while k < n and text[k].isalpha():
            k += 1
        if k == j:
            break
        i, parts = k, parts - 1
    return min(n, i + 3)


def find(text: str, auto, cues, given: frozenset, family: frozenset) -> list[tuple[int, int, str]]:
    """Spans (begin, end, kind) of one text, ordered and without overlaps."""
    spans: list[tuple[int, int, str]] = []
    persons: set[tuple[int, int]] = set()
    run_end = line_end = scheme_end = -1
    n = len(text)
    for last, (size, kinds) in auto.iter(text):
        at, end = last + 1 - size, last + 1
        for kind in kinds:
            if kind == "digit":
                if at < run_end:
                    continue
                lo, hi = at, end  # the whole run of digits and separators, looked at once
                while lo > 0 and text[lo - 1] in _RUN:
                    lo -= 1
                while hi < n and text[hi] in _RUN:
                    hi += 1
                run_end = hi
                # the character before the run decides whether a number begins there
                spans += [(b, e, "phone") for b, e in phones_in(text, lo, min(n, hi + 1)) if e <= hi]
                if (d := _DATE.search(text, lo, hi)) and (m := _PERSON.match(text, d.end())) and text.startswith(":", m.end()) and person_in(m, given, family, True):
                    persons.add(m.span())  # an entry of a change log
            elif kind == "at":
                if got := email_at(text, at, end, scheme_end):
                    spans.append((*got, "email"))
            elif kind == "scheme":
                if at >= scheme_end and at and (text[at - 1].isalnum()):
                    space = _SPACE.search(text, at)  # the name of a remote goes on up to a blank
                    scheme_end = space.start() if space else n
            elif kind == "call":
                if (m := _CALL.match(text, end)) and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
            elif kind == "street":
                if at < line_end:
                    continue
                lo, line_end = _line(text, at)  # a line with an anchor, looked at once
                spans += [(m.start(), m.end(), "street") for m in _STREET.finditer(text, lo, line_end)]
            elif kind == "before":
                persons.update(_introduced(text, at, end, given, family))
            elif (not at or not text[at - 1].isalpha()) and (end == n or not text[end].isalpha()):
                persons.update(_named(text, at, end, given, family))
    low = text.lower()
    if len(low) != n:  # a few letters grow in lower case; they stay as they are
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for last, size in cues.iter(low):
        if got := id_at(text, last + 1 - size, last + 1):
            spans.append((*got, "idnum"))
    spans += [(b, e, "person") for b, e in persons]
    return settle(spans, n)


_SPACE = re.compile(r"\s")


def _introduced(text: str, at: int, end: int, given: frozenset, family: frozenset) -> Iterator[tuple[int, int]]:
    """Persons right behind the words at text[at:end]."""
    start, n = end, len(text)
    if text[at:end] in ("(c) ", "(C) ", "© ", "opyright "):
        while start < n and (text[start].isdigit() or text[start] in " ,-"):
            start += 1
    elif text[at:end] == "VALUES (":
        start = text.find("'", end, _line(text, end)[1]) + 1 or end
    while m := _PERSON.match(text, start):
        if not person_in(m, given, family, True):
            return
        yield m.span()
        if not text.startswith(" and ", m.end()):
            return
        start = m.end() + 5


def _named(text: str, at: int, end: int, given: frozenset, family: frozenset) -> Iterator[tuple[int, int]]:
    """Persons that the known name at text[at:end] is a part of."""
    start, hi = _parts_before(text, at), _parts_after(text, end)
    # shapes may begin at any word, so that a word before a name does not hide it
    while m := _PERSON.search(text, start, hi):
        if m.start() > end:
            return
        if m.start() <= at and end <= m.end() and person_in(m, given, family, bool(_SLOT.search(text[max(0, m.start() - _SLOT_REACH) : m.start()]))):
            yield m.span()
            start = m.end()
        else:
            start = m.start() + 1


def settle(spans: list[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """Each place once: emails before streets, numbers and persons; the longer of two of one kind."""
    if not spans:
        return spans
    rank = {"email": 0, "street": 1, "idnum": 2, "phone": 3, "person": 4}
    taken, mask = [], bytearray(n)
    for b, e, k in sorted(set(spans), key=lambda s: (rank[s[2]], s[0] - s[1], s[0])):
        if mask.find(1, b, e) < 0:
            mask[b:e] = b"\1" * (e - b)
            taken.append((b, e, k))
    return sorted(taken)


def _spans(names: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = build(names)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [])
            for k, text in enumerate(batch.column(1)):
                for b, e, kind in find(text.as_py(), *parts):
                    for c, v in zip(out, (ids[k], b, e, kind)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], ["doc_id", "span_beg", "span_end", "pii_kind"])

    return run


#: Known name parts that the automaton takes; a larger table is refused rather than broadcast.
NAMES_MAX = 200_000


def name_parts(known: DataFrame) -> list[tuple[str, str]]:
    """Rows of the (small, size-checked) table of name parts."""
    rows = known.select("name_part", "part_kind").where(F.col("name_part").isNotNull()).distinct().limit(NAMES_MAX + 1).collect()
    if len(rows) > NAMES_MAX:
        raise ValueError(f"more than {NAMES_MAX} known name parts")
    return [(r[0], r[1]) for r in rows]


def personal_spans(documents: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every place of personal information: ``doc_id``, ``span_beg`` (0-based), ``span_end`` (exclusive), ``pii_kind``.

    * null ids and null or empty texts have no place; texts of any length are read whole;
    * places don't overlap: an email holds its parts, the longer of two places of one kind counts;
    * repeated rows come out repeatedly; an empty table gives an empty result; other columns play no part.
    """
    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return narrow.mapInArrow(_spans(name_parts(known)), "doc_id long, span_beg int, span_end int, pii_kind string")


def redact(documents: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``clean_text`` with [EMAIL], [PHONE], [IDNUM], [STREET] and [PERSON] in place of what was found, ``n_places``.

    Null texts stay null and empty ones empty, with 0 places; everything outside the places stays as it is.
    """
    names = name_parts(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = build(names)
        for batch in batches:
            out, places = [], []
            for value in batch.column(1):
                t = value.as_py()
                spans = find(t, *found) if t else []
                parts, at = [], 0
                for b, e, k in spans:
                    parts += [t[at:b], f"[{k.upper()}]"]
                    at = e
                out.append("".join([*parts, t[at:]]) if spans else t)
                places.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(places, pa.int32())], ["doc_id", "clean_text", "n_places"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, clean_text string, n_places int")
