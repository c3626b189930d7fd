"""Personal information in free text (problem 8)."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.text import FUNCTION_WORDS
from dialoom.session import spread

# Forms and words by which personal information is told.
PARTICLES = "de la|de los|del|de|di|da|van der|van den|van|von der|von|ter|le|la|al|el|bin"
TITLES = "Dr|Mr|Mrs|Ms|Miss|Prof|Herrn?|Frau|Sr|Sra|Srta|señor|señora|señorita|Don|Doña|Monsieur|Madame|Mme|Mlle"
FRENCH_VERBS = "veut|voudrait|rappellera|rappelle|préfère|souhaite|demande|arrive|arrivera|passera|est|sera|attend|appelle|a"
NAME_CUES = [
    "my name is", "the name", "this is", "ask for", "spoke with", "held for", "released by", "signed:", "passenger:", "gast:", "pasajero:", "passager ?:",
    "bitte nach", "anrufer heißt", "pregunte por", "me llamo", "a nombre de", "au nom de", "demandez", "guest:", "ich heiße", "mein name ist", "je m'appelle",
]
AFTER_NAMES = set("""speaking rang at on until and y en hat fragen is was has will would called again about the for with from second prefers who i und à a l'accueil
noch ruft möchte rappellera llama llamó ha ist war von zu to in of or but der die das""".split())
NOT_SURNAMES = set("""hello hi hey yes no thanks okay oh well so good dear sorry monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch
donnerstag freitag samstag sonntag hallo gut danke ja nein moment also hola bueno gracias sí bonjour merci oui non""".split())
DIGIT = "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf"
COUNT = r"(?:(?:one|two|three|four|five|six|seven|eight|nine) hundred(?: and)? ?)?(?:(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[ -](?:one|two|three|four|five|six|seven|eight|nine))?|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|one|two|three|four|five|six|seven|eight|nine)|(?:one|two|three|four|five|six|seven|eight|nine) hundred"
STREET_EN = r"street|road|lane|avenue|close|court|terrace|hill|gardens?|parade|way|drive|square|crescent|mews|row|walk|place|grove|st\.|rd\.|ave\.|ln\.|dr\.|st|rd|ave|ln"
STREET_DE = r"straße|strasse|str\.|gasse|weg|allee|platz|ring|ufer|damm"
STREET_ES = r"calle|c/|avda\.|avda|avenida|av\.|plaza|paseo|pza\.|camino|ronda"
STREET_FR = r"rue|avenue|boulevard|bd|place|chemin|impasse|allée|quai|route"
ID_LABEL = r"(?:passport|identity|id card|tax|social security|national insurance|\bid\b|documents? seen|ausweis|reisepass|steuer|sozialvers|pasaporte|\bdni\b|\bnie\b|\bnif\b|passeport|carte d.identité|sécurité sociale|fiscal)"

_I = re.I
_W = r"[^\W\d_]"
_WORD = r"[^\W_](?:[\w+]*[^\W_])?"
_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sAT\s)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sDOT\s)"
EMAIL = [
    re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])"),
    re.compile(r"(?<![\w.+-])\w[\w.+-]*(?:\s?@\s?|\s?[\[(]at[\])]\s?)[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[\w-]+)*(?:\.|\s?[\[(]dot[\])]\s?)[a-z]{2,}(?![\w-])", _I),
    re.compile(rf"(?<!\w)(?:{_WORD} (?:dot|dash|underscore|plus|hyphen|punkt|minus|punto|guion|point|tiret) )*{_WORD} (?:at|arroba|arobase|klammeraffe|ät) (?:{_WORD} (?:dash|hyphen|dot|minus|punkt|punto|guion|point|tiret) )+[a-z]{{2,}}(?!\w)", _I),
]
_SPOKEN = rf"(?:(?:double|triple|doble|triple|doppel|doppelt) )?(?:{DIGIT})"
PHONE = [
    re.compile(r"(?<![\w.])\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?!\w)"),
    re.compile(r"(?<![\w.+])00\d{9,13}(?!\w)"),
    re.compile(r"(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\w)"),
    re.compile(r"(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.])0\d{2,4}[/ ]\d{3,7}(?:-\d{1,4})?(?:(?: \d{3,6}))?(?!\w|-\w)"),
    re.compile(r"(?<![\w.])0\d(?:[ .]\d\d){4}(?!\w)"),
    re.compile(rf"(?<!\w)(?:(?:plus|más) )?{_SPOKEN}(?:[ ,-]{{1,2}}{_SPOKEN}){{6,}}(?!\w)", _I),
]
IDNO = [
    re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    re.compile(r"(?<![\w./-])\d{2}/\d{3}\.\d{3}/\d{2}(?![\w/])"),
    re.compile(r"(?<![\w./-])(?<!\d )\d{4} \d{4} \d{4}(?![\w-])(?! \d)"),
    re.compile(r"(?<![\w-])[A-Z]{2}\d{7}(?![\w-])", _I),
    re.compile(r"(?<![\w-])\d{8}-?[A-Z](?![\w-])", _I),
    re.compile(r"(?<![\w-])[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d(?![\w-])", _I),
    re.compile(rf"(?<!\w)(?:[a-z] ){{1,3}}{_SPOKEN}(?: {_SPOKEN}){{5,}}(?: [a-z](?![\w']))?(?!\w)", _I),
    re.compile(rf"(?<!\w){_SPOKEN}(?: {_SPOKEN}){{5,}} [a-z](?![\w'])", _I),
]
_SUR = rf"(?:O'|Mc|Mac)?{_W}{{3,}}(?:-{_W}{{3,}})?"
_HOUSE = r"\d{1,4}(?: ?[a-z](?!\w)| bis| ter)?"
ADDRESS = [
    re.compile(rf"(?<![\w.,:-])(?:(?:flat|apartment|apt\.?|unit) \d{{1,3}}[a-z]?, ?)?(?:{_HOUSE}|{COUNT}),? (?:[^\W\d_]{{4,}}(?:[ -][^\W\d_]{{4,}})?) (?:{STREET_EN})(?!\w)", _I),
    re.compile(rf"(?<![\w.:-]){_HOUSE},? (?:{STREET_FR}) (?:(?:de la|de l'|des|du|de) ?)?[^\W\d_]{{4,}}(?!\w)", _I),
    re.compile(rf"(?<!\w)[^\W\d_]{{3,}}(?:{STREET_DE}) \d{{1,4}}(?:[a-z]| (?-i:[a-h])(?!['\w]))?(?![\w:])", _I),
    re.compile(r"(?<!\w)(?:Am|An der|Im|Auf der|Zum|Zur) (?!(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag)\b)[A-ZÄÖÜ][a-zäöüß]{3,} \d{1,4}(?: ?[a-h](?!['\w]))?(?![\w:])"),
    re.compile(rf"(?<!\w)(?:{STREET_ES}) ?(?:(?:de la|de los|del|de) )?[^\W\d_]{{4,}},? \d{{1,4}}[a-z]?(?![\w:])", _I),
]
_INITIAL = r"(?: [A-Z]\.)?"
_BEFORE = rf"(?: (?:{PARTICLES}))?"
_SAID = rf"{_W}+(?:-{_W}+)?"
# Patterns that are tried where a word list has a hit; group 1 is the find, or the surname where `sur` says so.
FULL = re.compile(rf"({_SAID}){_INITIAL}{_BEFORE} (?P<sur>{_SUR})(?![\w@])", _I)
TURNED = re.compile(rf"(?<![\w@.-])({_SUR}), ({_W}+)(?:-{_W}+)?(?![\w@])", _I)
INITIALS = re.compile(rf"(?<![\w@.-])(?:[A-Z]\. ?){{1,2}}(?:(?:{PARTICLES}) )?(?:O'|Mc)?[A-ZÄÖÜ]{_W}{{3,}}(?![\w@])")
TITLED = re.compile(rf"(?:{TITLES})\.? (?:(?:Dr|Prof)\. )?((?:[A-Z]\. )?(?:(?:{PARTICLES}) )?(?:O'|Mc)?[^\W\d_]{{4,}}(?:-[^\W\d_]{{3,}})?)(?![\w@])")
TITLED_M = re.compile(rf"(?<![\w])M\. ((?:(?:{PARTICLES}) )?(?:O'|Mc|d')?[A-ZÀ-Þ]{_W}{{3,}})(?= (?:{FRENCH_VERBS})\b)")  # elsewhere M. is an initial
_NAMED = rf"[A-ZÄÖÜ]{_W}+(?:-[A-ZÄÖÜ]{_W}+)?{_INITIAL}{_BEFORE} (?:O'|Mc)?[A-ZÄÖÜ]{_W}{{3,}}"
CUE = re.compile("|".join(NAME_CUES), _I)
CUED = re.compile(rf"\s+({_NAMED})(?![\w@])")
ALONE = re.compile(rf"{_SAID}(?![\w@+]|[.-]\w)")
CUED_ALONE = re.compile(rf"\s+({_SAID})(?![\w@+]|[.-]\w)")
# A name of unknown words is told by what people do, or by what is done to people only.
_ACTS = "phoned|rang|called|telephoned|wrote|replied|asked|said|says|insisted|complained|apologised|thanked|explained|speaking|rief an|fragte|sagte|schrieb|llamó|dijo|preguntó|escribió|a appelé|a dit|demande"
_TO = "write to|speak to|spoke to|speak with|talk to|talked to|reach out to|ask|contact|regards,|sincerely,|dear|schreiben an|sprechen mit|fragen sie|escriba a|hable con|contacte con|écrire à|parler à|contacter"
ACTING = re.compile(rf"(?<![\w@.'-])({_NAMED})(?= (?:{_ACTS})\b)")
ADDRESSED = re.compile(rf"(?<!\w)(?i:{_TO}) ({_NAMED}(?: (?:and|or|und|oder|y|o|et|ou) {_NAMED})?)(?![\w@])")
_FUNCTION = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)
_AND = re.compile(r" (?:and|or|und|oder|y|o|et|ou) ")

_MAY_EMAIL = re.compile(r"@|[\[(]\s?(?i:at)\s?[\])]|\sAT\s")
_MAY_SPOKEN_EMAIL = re.compile(r"\s(?:dot|dash|hyphen|punkt|minus|punto|guion|point|tiret)\s", _I)
_LABELS = ["passport", "identity", "id card", "tax", "social security", "national insurance", "id", "document seen", "documents seen", "ausweis", "reisepass", "steuer", "sozialvers", "pasaporte", "dni", "nie", "nif", "passeport", "carte d", "sécurité sociale", "fiscal"]
_LABEL_START = re.compile(ID_LABEL, _I)
AFTER_LABEL = re.compile(r"[^\n\d:#.!?]{0,20}[:#°.]?\s?(?<![\w-])((?:\d[\d./ -]{5,16}\d|[A-Z]{0,3}\d[\dA-Z./-]{5,16}[\dA-Z]))(?!\w)", _I)
_NUMBER_ONLY = re.compile(r"\d+\.\d+|\d{4}-\d\d.*")
# Words of the address patterns by language, as plain text.
_STREETS = {k: [w.replace("\\.", ".") for w in part.replace("gardens?", "gardens|garden").split("|")] for k, part in {"en": STREET_EN, "fr": STREET_FR, "de": STREET_DE, "es": STREET_ES}.items()}
CARD = re.compile(r"(?<![\w+-])[2-6](?:[ -]?\d){12,18}(?![\w-])(?! \d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
BIRTH = re.compile(r"(?:date of birth|born(?: on)?|d\.?o\.?b\.?|geburtsdatum|geboren(?: am)?|fecha de nacimiento|nacid[oa](?: el)?|date de naissance|née?(?: le)?)\s*:?\s*(\d{4}-\d\d-\d\d|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!\d)", _I)


def luhn(digits: str) -> bool:
    """Whether the last digit of a card number fits the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the two check digits of an account number (without blanks) fit the rest."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


DNI = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: check letters of Spanish identity numbers, by the remainder of 23


def dni_letter(number: int) -> str:
    return DNI[number % 23]


class Words:
    """Finds which words of the lists stand where in a text, all in one pass."""

    def __init__(self, given=()) -> None:
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        kinds: dict[str, set[str]] = {}
        for kind, words in {
            "given": given, "label": _LABELS, "digit": DIGIT.split("|"), **_STREETS,
            "cue": [c.replace(" ?:", "") for c in NAME_CUES], "title": TITLES.replace("Herrn?", "Herrn|Herr").split("|"),
        }.items():
            for w in words:
                kinds.setdefault(w.lower(), set()).add(kind)
        for w, ks in kinds.items():
            self.tree.add_word(w, (len(w), ks))
        self.tree.make_automaton()

    def hits(self, text: str) -> dict[str, list[tuple[int, int]]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in ("given", "label", "digit", "cue", "title", *_STREETS)}
        for end, (n, kinds) in self.tree.iter(low):
            a, b = end + 1 - n, end + 1
            left = a == 0 or not (low[a - 1].isalnum() or low[a - 1] == "_")
            right = b == len(low) or not (low[b].isalnum() or low[b] == "_") or not low[b - 1].isalnum()
            for k in kinds:  # a label may begin a longer word, a German street word may end one
                if (left or k == "de") and (right or k == "label"):
                    out[k].append((a, b))
        return out


_DEFAULT: list[Words] = []


def finds(text: str, words: Words | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in order and without overlaps.

    E-mail addresses first, then addresses, identity numbers, phones and names; what an earlier kind has taken is
    not looked at again. Identity numbers without a label are long numbers whose check digits fit (cards, accounts) and
    the known formats. `words` holds the given names that the corpus uses (given_names); without one, names are told
    by their cues, titles, initials and by what people do.

    Patterns that may begin anywhere run only where a necessary part of them occurs; the others are tried at the hits
    of the word lists.
    """
    if words is None:
        words = _DEFAULT[0] if _DEFAULT else Words()
        _DEFAULT[:] = [words]
    out: list[tuple[int, int, str]] = []
    hits = words.hits(text)
    given = {a for a, _ in hits["given"]}

    def add(a: int, b: int, kind: str) -> None:
        while b > a and text[b - 1] in " ,;-/":
            b -= 1
        if b > a and not any(a < y and x < b for x, y, _ in out):
            out.append((a, b, kind))

    emails = (EMAIL[:2] if _MAY_EMAIL.search(text) else []) + (EMAIL[2:] if _MAY_SPOKEN_EMAIL.search(text) else [])
    said = hits["digit"]
    spoken = any(b[0] - a[1] <= 70 for a, b in zip(said, said[5:]))  # six in a row, 'double' between them
    for p in emails:
        for m in p.finditer(text):
            add(*m.span(), "email")
    on = any(x in text for x in ("Am ", "An der ", "Im ", "Auf der ", "Zum ", "Zur "))
    for p, may in zip(ADDRESS, (hits["en"], hits["fr"], hits["de"], on, hits["es"])):
        for m in p.finditer(text) if may else ():
            add(*m.span(), "address")
    numbers = any(c.isdecimal() for c in text)
    if numbers:
        for m in IBAN.finditer(text):
            if mod97(m[0].replace(" ", "")):
                add(*m.span(), "idno")
        for m in CARD.finditer(text):
            if luhn(re.sub(r"\D", "", m[0])):
                add(*m.span(), "idno")
    for p in (IDNO[:2] + IDNO[3:6] if numbers else []) + (IDNO[6:] if spoken else []):
        for m in p.finditer(text):
            add(*m.span(), "idno")
    if numbers:
        for m in IDNO[2].finditer(text):
            add(*m.span(), "idno")
        for a, _ in hits["label"]:
            label = _LABEL_START.match(text, a)
            m = label and AFTER_LABEL.match(text, label.end())
            if m and sum(c.isdigit() for c in m[1]) >= 5 and not _NUMBER_ONLY.fullmatch(m[1]):
                add(*m.span(1), "idno")
    for p in (PHONE[:-1] if numbers else []) + (PHONE[-1:] if spoken else []):
        for m in p.finditer(text):
            add(*m.span(), "phone")
    if given and ", " in text:
        for m in TURNED.finditer(text):
            if m.start(2) in given and m[1].lower() not in NOT_SURNAMES and (m[1][0].isupper() or m[0].islower()) and whole_given(text, m.start(2), m.end(), hits["given"]):
                add(*m.span(), "name")
    for a, b in hits["given"]:
        if a and text[a - 1] in "@.-":
            continue
        m = FULL.match(text, a)
        if m and whole_given(text, a, m.end(1), hits["given"]) and m["sur"].lower() not in AFTER_NAMES and (m[0][0].islower() or m["sur"][0].isupper()):
            add(*m.span(), "name")
    cues = [b + (text[b : b + 1] == ":") + 2 * (text[b : b + 2] == " :") for _, b in hits["cue"]]
    for b in cues:
        if m := CUED.match(text, b):
            add(*m.span(1), "name")
    if "M." in text:
        for m in TITLED_M.finditer(text):
            add(*m.span(1), "name")
    for a, _ in hits["title"]:
        m = TITLED.match(text, a)
        if m and m[1].split()[-1].lower() not in AFTER_NAMES and (m[1].split()[-1][:1].isupper() or m[0].islower()):
            add(*m.span(1), "name")
    for m in INITIALS.finditer(text):
        add(*m.span(), "name")
    for m in ACTING.finditer(text):
        if m[1].split()[0].lower() not in _FUNCTION:
            add(*m.span(1), "name")
    for m in ADDRESSED.finditer(text):
        if m[1].split()[0].lower() in _FUNCTION:
            continue
        both = _AND.search(m[1])
        if both:
            add(m.start(1) + both.end(), m.end(1), "name")
        add(m.start(1), m.start(1) + both.start() if both else m.end(1), "name")
    for a, b in hits["given"]:
        if (a == 0 or text[a - 1] not in "@.+-") and text[a].isupper() and text[a + 1 : b].islower() and (m := ALONE.match(text, a)) and whole_given(text, a, m.end(), hits["given"]):
            add(*m.span(), "name")
    for b in cues:
        m = CUED_ALONE.match(text, b)
        if m and m.start(1) in given and whole_given(text, m.start(1), m.end(1), hits["given"]):
            add(*m.span(1), "name")
    return sorted(out)


def whole_given(text: str, a: int, b: int, given: list[tuple[int, int]]) -> bool:
    """Whether text[a:b] is a given name of the list, or two joined by a hyphen."""
    parts = text[a:b].split("-")
    spans = set(given)
    at = a
    for part in parts:
        if (at, at + len(part)) not in spans:
            return False
        at += len(part) + 1
    return len(parts) <= 2


def given_names(documents: DataFrame, text: str = "text", least: int = 2, share: float = 0.15, most: int = 100_000) -> list[str]:
    """Given names that a corpus uses, learned from how it uses them: the first words of what follows a cue for names
    ('my name is', 'spoke with', ...) and looks like a name, if at least `least` documents have the word there and these are
    at least `share` of the documents that have it capitalised. All documents are counted; at most the `most` most
    frequent such words, a bound on what is sent with the tasks, are kept.
    """
    cues = "|".join(re.escape(c.replace(" ?:", "")) + (r"\s?:" if c.endswith(" ?:") else "") for c in NAME_CUES).replace("\\ ", " ")
    named = rf"(?<!\p{{L}})(?iu:{cues})\s+(\p{{Lu}}\p{{Ll}}+)(?:-\p{{Lu}}\p{{Ll}}+)?(?: \p{{Lu}}\.)?(?: (?:{PARTICLES}))? (?:O'|Mc)?\p{{Lu}}\p{{L}}{{3,}}"
    docs = documents.select(text).filter(f"{text} is not null")
    once = lambda pattern, group: docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    cued = once(named, 1).filter(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most).collect()
    if not cued:
        return []
    asked = F.broadcast(documents.sparkSession.createDataFrame([(r.w, r.n) for r in cued], "w string, cued long"))  # at most `most` rows
    known = once(r"(?<!\p{L})\p{Lu}\p{Ll}+(?!\p{L})", 0).join(asked, "w").filter(F.col("cued") >= share * F.col("n"))
    return sorted(r.w for r in known.select("w").collect())


def permuted(digits: str, key: bytes, rounds: int = 8) -> str:
    """A keyed permutation of digit strings of one length: a Feistel network over the two halves, so different
    values stay different, equal ones equal, and the same key turns it back (restored)."""
    return _feistel(digits, key, range(rounds), 1)


def restored(digits: str, key: bytes, rounds: int = 8) -> str:
    return _feistel(digits, key, reversed(range(rounds)), -1)


def _feistel(digits: str, key: bytes, order, sign: int) -> str:
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    if not half:
        return digits
    for r in order:
        changes_a = r % 2 == 0
        own, other = (a, b) if changes_a else (b, a)
        mix = int.from_bytes(hmac.new(key, f"{r}|{len(digits)}|{other}".encode(), hashlib.sha256).digest()[:16], "big")
        own = str((int(own) + sign * mix) % 10 ** len(own)).zfill(len(own))
        a, b = (own, b) if changes_a else (a, own)
    return a + b


# The words for the digits 0 to 9.
_DIGIT_WORDS = ["zero|oh|null|cero|zéro", "one|eins|uno|un", "two|zwei|zwo|dos|deux", "three|drei|tres|trois", "four|vier|cuatro|quatre", "five|fünf|cinco|cinq", "six|sechs|seis", "seven|sieben|siete|sept", "eight|acht|ocho|huit", "nine|neun|nueve|neuf"]
_DIGIT_VALUES = {w: str(i) for i, group in enumerate(_DIGIT_WORDS) for w in group.split("|")}
_TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())  # fixed values: two-digit country codes


def written(surface: str) -> str:
    """A number as spoken ('oh double seven ...') in digits; letters stay; other text as it is."""
    out, times = [], 1
    for w in re.findall(r"[^\s,-]+", surface.lower()):
        if w in ("double", "doble", "doppel", "doppelt", "triple"):
            times = 3 if w == "triple" else 2
        elif w in ("plus", "más"):
            out.append("+")
        elif w in _DIGIT_VALUES or len(w) == 1:
            out.append(_DIGIT_VALUES.get(w, w.upper()) * times)
            times = 1
        else:
            return surface
    return "".join(out)


def country_digits(shown: str, digits: str) -> int:
    """How many leading digits of a phone number are its country code, international prefix or trunk 0."""
    if shown.lstrip().startswith("+"):
        n = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3
        return n + (digits[n : n + 1] == "0")  # +44 (0)20 ...
    if digits.startswith("00"):
        return 2 + country_digits("+", digits[2:]) if len(digits) > 4 else 2
    return int(digits.startswith("0"))


def _fill(shape: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdecimal() and c.isascii() else c for c in shape)


def _day_permuted(day: int, key: bytes, days: int) -> int:
    """A keyed permutation of the days: the digits' permutation, repeated until it falls on a day again."""
    while True:
        day = int(permuted(str(day).zfill(6), key))
        if day < days:
            return day


def other_date(surface: str, key: bytes) -> str:
    """A valid date of 1900 to 2099 permuted among these days, in the same format; another text stays as it is."""
    parts = [int(x) for x in re.split(r"[./-]", surface)]
    y, m, d = parts if len(surface.split("-")[0]) == 4 else reversed(parts)
    first = datetime.date(1900, 1, 1)
    try:
        day = (datetime.date(y, m, d) - first).days
    except ValueError:
        return surface
    days = (datetime.date(2100, 1, 1) - first).days
    if not 0 <= day < days:
        return surface
    x = first + datetime.timedelta(_day_permuted(day, key + b"date", days))
    if len(surface.split("-")[0]) == 4:
        return x.isoformat()
    mark = re.search(r"[./-]", surface)[0]
    return f"{x.day:02d}{mark}{x.month:02d}{mark}{x.year}"


def _idno(shown: str, key: bytes) -> str:
    """An identity number permuted within its format; where its check characters fit, the new ones fit too."""
    bare = re.sub(r"[^A-Za-z0-9]", "", shown).upper()
    digits = re.sub(r"\D", "", shown)
    if len(digits) == len(bare) and 13 <= len(digits) <= 19 and luhn(digits):
        body = permuted(digits[:-1], key)
        return _fill(shown, body + next(c for c in "0123456789" if luhn(body + c)))
    if IBAN.fullmatch(shown) and mod97(bare):
        body = "".join(bare[4:])
        own = re.sub(r"\D", "", body)
        new = _fill(body, permuted(own, key))
        check = 98 - int("".join(str(int(c, 36)) for c in new + bare[:2] + "00")) % 97
        return _fill(shown, f"{check:02d}" + re.sub(r"\D", "", new))
    if re.fullmatch(r"\d{8}[A-Z]", bare) and bare[8] == dni_letter(int(bare[:8])):
        body = permuted(digits, key)
        return _fill(shown[:-1], body) + dni_letter(int(body))
    return _fill(shown, permuted(digits, key))


def pseudonym(surface: str, kind: str, key: bytes) -> str:
    """Typed placeholder. Equal values get equal placeholders in every document, however they are written.

    Digits of phones and identity numbers are permuted within their format. Of a phone only the number within its
    country is, so that +44 ..., 0044 ..., 0 ... and spoken forms stay linked; spoken numbers are put in digits first.
    Other finds get a keyed tag of 128 bits.
    """
    if kind in ("phone", "idno"):
        shown = written(surface)
        digits = re.sub(r"[^0-9]", "", shown)
        if len(digits) >= 6:
            n = country_digits(shown, digits) if kind == "phone" else 0
            new = _fill(shown, digits[:n] + permuted(digits[n:], key)) if kind == "phone" else _idno(shown, key)
            return f"<{kind.upper()} {new}>"
    if kind == "date":
        return f"<DATE {other_date(surface, key)}>"
    tag = hmac.new(key, f"{kind}|{' '.join(surface.lower().split())}".encode(), hashlib.sha256).hexdigest()[:32]
    return f"<{kind.upper()} {tag}>"


def to_replace(text: str, words: Words | None = None) -> list[tuple[int, int, str]]:
    """What redaction replaces: the finds, and dates of birth where nothing else was found."""
    out = finds(text, words)
    for m in BIRTH.finditer(text):
        a, b = m.span(1)
        out = [x for x in out if not (a < x[1] and x[0] < b)] + [(a, b, "date")]
    return sorted(out)


def personal_finds(documents: DataFrame, doc: str = "doc_id", text: str = "text", names: list[str] | None = None) -> DataFrame:
    """(doc_id, kind, surface), one row per different find of a document. Null and empty texts have none. Whole texts
    are read; each document is worked on by itself. The given names are learned from the documents unless `names` holds
    them."""
    names = given_names(documents, text) if names is None else names

    def search(batches):
        import pandas as pd

        words = Words(names)
        for pdf in batches:
            rows = {(d, kind, t[a:b]) for d, t in zip(pdf[doc], pdf[text]) if isinstance(t, str) for a, b, kind in finds(t, words)}
            yield pd.DataFrame(sorted(rows, key=str), columns=[doc, "kind", "surface"])

    kind = documents.schema[doc].dataType.simpleString()
    found = spread(documents.select(doc, text).filter(f"{text} is not null and {text} <> ''"), doc).mapInPandas(search, f"{doc} {kind}, kind string, surface string")
    return found.dropDuplicates()


def redacted(documents: DataFrame, key: str | bytes, doc: str = "doc_id", text: str = "text", names: list[str] | None = None) -> DataFrame:
    """(doc_id, text, n_finds) with every find, and every date of birth, replaced by its pseudonym under `key`; the rest
    stays as it is. Texts stay linked with those redacted under the same key only, so the key is the data owner's secret."""
    secret = key.encode() if isinstance(key, str) else key
    names = given_names(documents, text) if names is None else names

    def replace(batches):
        import pandas as pd

        words = Words(names)
        for pdf in batches:
            texts, counts = [], []
            for t in pdf[text]:
                if not isinstance(t, str):
                    texts.append(None)
                    counts.append(0)
                    continue
                parts, at, found = [], 0, to_replace(t, words)
                for a, b, kind in found:
                    parts += [t[at:a], pseudonym(t[a:b], kind, secret)]
                    at = b
                texts.append("".join([*parts, t[at:]]))
                counts.append(len(found))
            yield pd.DataFrame({doc: pdf[doc], text: texts, "n_finds": counts})

    kind = documents.schema[doc].dataType.simpleString()
    return spread(documents.select(doc, text), doc).mapInPandas(replace, f"{doc} {kind}, {text} string, n_finds int")
