"""Problem 9: personal information in free text, and its replacement by typed placeholders.

Method: regular expressions propose spans; validators (Luhn, mod-97, mod-23, mod-11, impossible groups) raise or
lower their score; context words in a window before and after, and neighbouring spans, adjust it. Spans that reach
the threshold are kept; of overlapping ones the better-scored, then the longer. A number with a check digit that
fails it needs a context word. Account and card numbers that pass mod-97 or Luhn are none of the five kinds: they are
blocked, so that no part of them is taken for a phone number. Names are proposed after context words (roles,
introductions, letter heads, addressees, verbs of saying) and read token by token up to a delimiter or function word.

Speed: cheap necessary conditions (an @, a written-out dot, seven digits close together) decide per text which
patterns run; the context words of names are found by one pass of an Aho-Corasick automaton.

Kinds: email, phone, id_number, address, name. The text of a span is exactly as it stands, without titles or the
word before it. Defined cases: null text or id gives nothing; a repeated item of a text gives one row; whole texts
of any length are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 1.0
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# The shapes of the items.
AT = r"\s*[\[({<]\s*(?:at|@|arroba|arobase|ät)\s*[\])}>]\s*"
AT_WORD = r"\s+(?:at|arroba|arobase|ät)\s+"
DOT = r"\s*[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]\s*"
DOT_WORD = r"\s+(?:dot|punkt|punto|point)\s+"
LOCAL = rf"(?<![\w.+@-])[\w+-]+(?:\.[\w+-]+)*(?:(?:{DOT}|{DOT_WORD})[\w+-]+)*"
EMAILS = (
    (re.compile(r"(?<![\w.+-])[\w.+-]*[\w+-]@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w@-])"), 1.2),
    (re.compile(rf"{LOCAL}{AT}[\w-]+(?:(?:{DOT}|{DOT_WORD}|\.)[\w-]+)*(?:{DOT}|{DOT_WORD}|\.)[^\W\d_]{{2,}}(?![\w@-])", re.I), 1.1),
    (re.compile(rf"{LOCAL}{AT_WORD}[\w-]+(?:(?:{DOT}|{DOT_WORD})[\w-]+)*(?:{DOT}|{DOT_WORD})[^\W\d_]{{2,}}(?![\w@-])", re.I), 1.1),
    (re.compile(rf"(?<![\w.+@-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:(?:{DOT}|{DOT_WORD})[\w-]+)+", re.I), 1.1),
)
EXT = r"(?:,?\s*(?:ext\.?|extension|x|Durchwahl|poste|extensión)\s*\.?\s*\d{1,6})?"
PHONES = (
    (re.compile(r"(?<![\w.+/-])(?:\+|00)\d{1,3}(?:[ .\-/]?\(?\d{1,9}\)?){1,7}" + EXT + r"(?![\w])"), 1.0),
    (re.compile(r"(?<![\w.+/-])(?:1[ .-])?\(\d{2,5}\)[ -]?\d{3,}(?:[ .\-/]\d{2,})*" + EXT + r"(?![\w])"), 1.0),
    (re.compile(r"(?<![\w.+/-])(?:1[ .-])?[2-9]\d{2}([ .-])\d{3}\1\d{4}" + EXT + r"(?![\w-])"), 0.8),
    (re.compile(r"(?<![\w.+/-])0\d{1,4}[ /-]\d{3,}(?:[ /-]\d{2,})*" + EXT + r"(?![\w-])"), 0.7),
    (re.compile(r"(?<![\w.+/-])0\d(?:[ .-]\d{2}){4}" + EXT + r"(?![\w-])"), 0.9),
    (re.compile(r"(?<![\w.+/-])[6-9]\d{2}([ .-])\d{3}\1\d{3}" + EXT + r"(?![\w-])"), 0.7),
    (re.compile(r"(?<![\w.+/-])[6-9]\d{2}([ .-])\d{2}\1\d{2,4}(?:\1\d{2})?" + EXT + r"(?![\w-])"), 0.65),
    (re.compile(r"(?<![\w.+/-])1?\d{10}" + EXT + r"(?![\w-])"), 0.65),
)
IDS = (
    ("ssn", re.compile(r"(?<![\w.-])\d{3}([- ]?)\d{2}\1\d{4}(?![\w-])"), 0.7),
    ("nino", re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"), 1.0),
    ("passport", re.compile(r"(?<![\w-])[A-Z]{1,2}\d{7,8}(?![\w-])"), 0.7),
    ("card", re.compile(r"(?<![\w-])(?=[A-Z0-9]{9,10}(?![\w-]))[A-Z](?=(?:[A-Z]*\d){4})[A-Z0-9]{8,9}(?![\w-])"), 0.5),
    ("dni", re.compile(r"(?<![\w.-])(?:\d{8}|\d{1,2}\.\d{3}\.\d{3})[ -]?[A-Z](?![\w-])"), 0.9),
    ("nie", re.compile(r"(?<![\w-])[XYZ]-?\d{7}-?[A-Z](?![\w-])"), 0.9),
    ("insee", re.compile(r"(?<![\w.-])\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w-])"), 0.8),
    ("taxid", re.compile(r"(?<![\w.-])\d{2} ?\d{3} ?\d{3} ?\d{3}(?![\w-])"), 0.2),
    ("sin", re.compile(r"(?<![\w.-])(?<!\d )\d{3}([ -])\d{3}\1\d{3}(?![\w-])"), 0.2),
)
CAP = r"(?:[^\W\d_a-zß-ÿ]|[ÃÂ][\u0080-¿])(?:[^\W\d_]|[ÃÂ][\u0080-¿‐-™]|['’.-](?=\w))*"
TOWN = rf"{CAP}(?:[ -]{CAP})?"
ZIP = r"\d{4,6}(?:-\d{3,4})?"
TAIL = rf"(?:(?:,|\s*\n)?\s*(?:in |à |en |a )?{ZIP}[ ,]+{TOWN}|(?:,\s*|\s*\n\s*){TOWN}(?:,? [A-Z]{{2}})?,? {ZIP})?"
LINK = r"(?:de|del|de la|de las|de los|du|des|d'|la|le|les|von|der|den|dem|am|an|im)"
STREET_END = rf"(?:\.(?=[.,;)]|\s+(?:{TOWN}(?:,? [A-Z]{{2}})?,? {ZIP}|(?:Apt|Suite|Unit|Flat)\b)))?"
EN_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Row|Close|Way|Place|Pl|Square|Terrace|Boulevard|Blvd|Crescent|Hill|Gardens|Mews|Park|Parkway|Circle|Grove|Walk)(?!\w)" + STREET_END
UNIT = r"(?:,?\s+(?:Apt|Apartment|Suite|Unit|Flat|Room|Ste|No)\.?\s*#?\d\w*)?"
ADDRESSES = (
    (re.compile(rf"(?<![\w/=-])\d{{1,5}}[A-Za-z]?,? (?!The )(?:[NSEW]{{1,2}}\.? )?(?:{CAP} ){{1,4}}{EN_STREET}{UNIT}{TAIL}"), 1.1),
    (re.compile(rf"(?<!\w)(?:P\.? ?O\.? ?Box|Postfach|Apartado(?: de Correos)?|Boîte Postale|BP|B\.P\.) ?\d{{1,7}}{TAIL}"), 1.0),
    (re.compile(rf"(?<!\w)(?:{CAP}(?:straße|strasse|str\.|gasse|weg|winkel|platz|allee|ring|ufer|damm|hof|steig|stieg|pfad|chaussee|markt|graben|berg|tal)|(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|Hinter der) (?:{CAP} ?){{1,3}}|{CAP} (?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ring)) ?\d{{1,4}} ?[a-z]?(?![\w]){TAIL}"), 0.8),
    (re.compile(rf"(?<!\w)(?:Calle|C/|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Camino|Paseo|Pº|Ronda|Travesía|Carretera|Glorieta|Callejón)(?: {LINK}(?: |(?<=')))*(?: ?{CAP}| {LINK})+,? ?(?:n\.?º ?|núm\. ?|s/n)?\d{{0,4}}[A-Za-z]?(?:, ?\d{{1,2}}\.?[ºª] ?(?:[A-Z](?!\w)|izq\.?|dcha\.?)?)?{TAIL}"), 1.0),
    (re.compile(rf"(?<![\w/-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|impasse|chemin|place|allée|allÃ©e|quai|route|cours|square|passage|sentier|ruelle)(?: {LINK}(?: |(?<=')))*(?: ?(?:{CAP}|{LINK}(?= |')))+{TAIL}"), 1.1),
)
#: Words that a pattern of ADDRESSES needs, by its place there, and what must follow (None: anything).
ADDRESS_HEADS = (
    (0, r"(?!\w)", (" Street", " St", " Road", " Rd", " Lane", " Ln", " Avenue", " Ave", " Drive", " Dr", " Court", " Ct", " Row", " Close", " Way", " Place", " Pl", " Square",
                    " Terrace", " Boulevard", " Blvd", " Crescent", " Hill", " Gardens", " Mews", " Park", " Parkway", " Circle", " Grove", " Walk")),
    (1, r" ?\d", ("Box", "Postfach", "Apartado", "Apartado de Correos", "Boîte Postale", "BP", "B.P.")),
    (2, r" ?\d", ("straße", "strasse", "str.", "gasse", "weg", "winkel", "platz", "allee", "ring", "ufer", "damm", "hof", "steig", "stieg", "pfad", "chaussee", "markt", "graben",
                  "berg", "tal", "Straße", "Strasse", "Str.", "Gasse", "Weg", "Platz", "Allee", "Ring")),
    (2, None, ("Am ", "An der ", "An den ", "Im ", "In der ", "Auf dem ", "Auf der ", "Zum ", "Zur ", "Unter den ", "Hinter der ")),
    (3, None, ("Calle", "C/", "Avda", "Av.", "Avenida", "Plaza", "Pza", "Camino", "Paseo", "Pº", "Ronda", "Travesía", "Carretera", "Glorieta", "Callejón")),
    (4, r" ", (" rue", " avenue", " av.", " boulevard", " bd", " impasse", " chemin", " place", " allée", " allÃ©e", " quai", " route", " cours", " square", " passage", " sentier", " ruelle")),
)
CUES = {
    "phone": re.compile(r"(?i)call|phone|tel|fax|mobile|cell|number|reach|contact|erreichbar|nummer|ruf|joignable|téléphone|numéro|teléfono|número|móvil|rater"),
    "id_number": re.compile(r"(?i)\bID\b|passport|social|ssn|insurance|identi|ausweis|steuer|tax|numéro|documento|dni|nie\b|nif|payroll|rater|number|nummer|número|sécurité|pasaporte|passeport"),
    "address": re.compile(r"(?i)live|address|send|post|voucher|form to|mail|wohn|habite|vive|paquete|colis|adress|domicili|reside|direcci|in der Nähe|geht an|part pour|deliver"),
}
NUMBER_CUE = re.compile(r"(?i)ausweis|steuer|\btax|\btin\b|social|identi|insurance|\bsin\b|passport")
AGAINST = re.compile(r"(?i)(?:seed|chapter|table|ratio|batch|job|checksum|file|version|step|record|run|ms|exit code|page|line|example)\s*(?:no\.?\s*)?$")

#: Necessary conditions for whole groups of patterns.
SEVEN = re.compile(r"\d(?:[ ().+/-]{0,3}\d){6,}")
AT_MARK = re.compile(AT, re.I)
AT_SPOKEN = re.compile(r"\s(?:at|arroba|arobase|ät)\s")
DOT_WORDS = ("dot", "punkt", "punto", "point")
NINO_END = re.compile(r"\d{2} ?[A-D](?![\w-])")
CARD_SHAPE = re.compile(r"[A-Z][A-Z0-9]{8}")
#: Numbers of accounts and payment cards, if their checksum holds.
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\w-])")
PAY_CARD = re.compile(r"(?<![\w.-])[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])|(?<![\w.-])3[47]\d{2}([ -]?)\d{6}\2\d{5}(?![\w-])")
CHECKED = ("dni", "nie", "insee", "taxid", "sin")

#: What introduces a person.
TITLE = r"(?:(?:dr|prof|mr|mrs|ms|miss|sir|herr|frau|mme|mlle|sr|sra|srta|don|doña|dra|ing|monsieur|madame|señora?)\b\.?\s+)*"
#: What is sent, how it goes, and to whom, in four languages.
SENT = r"(?:forms?|letters?|parcels?|packages?|mail|invoices?|vouchers?|copy|copies|post|paket|brief|rechnung|formular|paquete|carta|factura|correo|colis|lettre|facture|courrier|formulaire)"
GOES = r"(?:\s+(?:geht|gehen|ging|is going|goes|went|was sent|is|est|part|va|fue|est parti|ist))?"
TOWARDS = r"(?:to|for|an|für|pour|à|a|para)"
NAME_CUE = re.compile(
    r"(?:(?<!\w)(?:my name is|name(?:'s)? is|i am called|this is|(?:mein )?name ist|ich (?:heiße|heisse|heiÃŸe)|je m['’]appelle|mon nom est|me llamo|mi nombre es"
    r"|signed(?: off)?(?: by)?|written by|approved by|as far as|you can reach|please (?:contact|ask|call|reach)"
    rf"|{SENT}{GOES}\s+{TOWARDS}|(?:le )?contact est|(?:persona de )?contacto es|ansprechpartner(?:in)? ist|dear|attn\.?|from|to|contact"
    r"|reviewer|rater|annotator|author|assessor|employee|pr(?:ü|Ã¼)fer(?:in)?|annotat(?:rice|eur)|anotadora?|gutachter(?:in)?|revisora?|relect(?:rice|eur)"
    r"|wrote|says|said|met|thanks|regards|sincerely|schrieb|sagte|écrit|escribió|dijo)(?!\w)\s*[:;(,]?\s*)" + TITLE,
    re.I,
)
#: The words that the patterns of NAME_CUE begin with; the automaton looks for them.
CUE_HEADS = (
    "my name", "name", "i am called", "this is", "mein name", "ich hei", "je m", "mon nom", "me llamo", "mi nombre", "signed", "written", "approved", "as far",
    "you can", "please", "form", "letter", "parcel", "package", "mail", "invoice", "voucher", "copy", "copies", "post", "paket", "brief", "rechnung", "paquete",
    "carta", "factura", "correo", "colis", "lettre", "facture", "courrier", "le contact", "contact", "persona de", "ansprechpartner", "dear", "attn", "from", "to",
    "reviewer", "rater", "annotat", "author", "assessor", "employee", "prüfer", "prã¼fer", "anotador", "gutachter", "revisor", "relect",
    "wrote", "says", "said", "met", "thanks", "regards", "sincerely", "schrieb", "sagte", "écrit", "escribió", "dijo",
)
LOOSE = re.compile(r"(?i)^(?:from|to|contact|dear|rater|reviewer|author|annotator|this is|assessor|employee|anotadora?|annotat(?:rice|eur)|pr(?:ü|Ã¼)fer(?:in)?|revisora?|gutachter(?:in)?|relect(?:rice|eur)|signed|wrote|says|said|met|thanks|regards|sincerely|schrieb|sagte|écrit|escribió|dijo)\b")
SPOKEN = re.compile(r"(?i)^(?:wrote|says|said|met|thanks|regards|sincerely|schrieb|sagte|écrit|escribió|dijo)\b")
TITLED = re.compile(r"(?<!\w)(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme|Sr|Sra)\.? +(?=[^\W\d_a-zß-ÿ])")
TOKEN = re.compile(r"(?:[^\W\d_]|[ÃÂ][\u0080-¿‐-™Œ-ƒ])(?:[^\W\d_]|[ÃÂ][\u0080-¿‐-™Œ-ƒ]|['’‐-](?=[^\W\d_]))*")
GAP = re.compile(r"(\.?)(,?)([  ]+)")
VERB = re.compile(r"\s+(?:marked|asked|said|says|wrote|knows|told|wohnt|habite|vive|has|is|was)\b")
PARTICLE = frozenset("de la las los del d' von van zu vom der den le du des di da el y dos ten".split())
STOP = frozenset(
    "and or at marked knows asked who is was were has had if in on for with the a an to of from by id ID said says wrote und oder wohnt meine meiner mit hat ist war erreichbar bei in wenn nummer et ou habite mon ma est joignable à au qui en "
    "vive mi mis es tiene con que teléfono número telefono ext asked about after before as not no nobody someone are can will would should be their they i you we your our my so but".split()
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _mod97(text: str) -> bool:
    """Account numbers: letters as numbers, the first four places moved to the end, remainder 1."""
    code = re.sub(r"\W", "", text)
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _payment_numbers(text: str, at: int, end: int) -> list[tuple[int, int]]:
    """Spans of account numbers that pass mod-97 and of card numbers that pass Luhn, between two places."""
    got = [m.span() for m in IBAN.finditer(text, at, end) if 15 <= len(re.sub(r"\W", "", m.group())) <= 34 and _mod97(m.group())]
    return got + [m.span() for m in PAY_CARD.finditer(text, at, end) if _luhn(re.sub(r"\D", "", m.group()))]


def _automaton(words: dict):
    import ahocorasick

    heads = ahocorasick.Automaton()
    for word, value in words.items():
        heads.add_word(word, value)
    heads.make_automaton()
    return heads


_HEADS = _STREETS = None


def _address_patterns(text: str) -> list[tuple[re.Pattern, float]]:
    """The patterns of ADDRESSES of which the text has a needed word."""
    global _STREETS
    if _STREETS is None:
        words: dict[str, list] = {}
        for place, after, heads in ADDRESS_HEADS:
            for head in heads:
                words.setdefault(head, []).append((place, re.compile(after) if after else None))
        _STREETS = _automaton(words)
    found: set[int] = set()
    for end, needs in _STREETS.iter(text):
        for place, after in needs:
            if place not in found and (after is None or after.match(text, end + 1)):
                found.add(place)
    return [ADDRESSES[i] for i in sorted(found)]


def _number_windows(text: str) -> list[tuple[int, int]]:
    """Where seven digits stand close together, with room for letters before and an extension behind."""
    out: list[tuple[int, int]] = []
    for m in SEVEN.finditer(text):
        a, b = max(0, m.start() - 30), m.end() + 60
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cues(text: str, low: str) -> list[re.Match]:
    """Matches of NAME_CUE from left to right, without overlaps."""
    global _HEADS
    if _HEADS is None:
        _HEADS = _automaton({head: len(head) for head in CUE_HEADS})
    starts = {end - size + 1 for end, size in _HEADS.iter(low)}
    got, free = [], 0
    for at in sorted(starts):
        if at >= free and (at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_")):
            m = NAME_CUE.match(text, at)
            if m:
                got.append(m)
                free = m.end()
    return got


def _valid_id(kind: str, text: str) -> float:
    """Score that a checksum or an impossible part adds; a failed checksum takes some away."""
    if kind in CHECKED:
        return 0.4 if _checked(kind, text) else -0.1
    digits = re.sub(r"\D", "", text)
    if kind == "ssn":
        return -1.0 if digits[3:5] == "00" or digits[5:] == "0000" or digits[:3] == "000" else (0.3 if len(text) > 9 else 0.0)
    return 0.0


def _checked(kind: str, text: str) -> bool:
    """Does the number's own check digit hold?"""
    digits = re.sub(r"\D", "", text)
    if kind in ("dni", "nie"):
        n = int(str("XYZ".index(text[0])) + digits) if kind == "nie" else int(digits)
        return "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23] == text[-1]
    if kind == "insee":
        return 97 - int(digits[:13]) % 97 == int(digits[13:])
    if kind == "taxid":
        p = 10
        for d in digits[:10]:
            s = (int(d) + p) % 10 or 10
            p = s * 2 % 11
        return (11 - p) % 10 == int(digits[10])
    return _luhn(digits)


def _read_name(text: str, at: int, blocked: bytearray) -> tuple[int, int] | None:
    """The name that begins at a position: up to six tokens, at most one comma; None if it has no two parts."""
    pos, end, parts, commas, upper, words = at, at, 0, 0, None, []
    while len(words) < 6:
        m = TOKEN.match(text, pos)
        if not m or blocked[m.start()] or m.end() - m.start() > 40:
            break
        word = m.group()
        low = word.lower()
        particle = low in PARTICLE and not word.isupper() and (words or low in ("von", "van", "de", "du", "le", "zu"))
        capital = word[0].isupper() or word[0] in "ÃÂ" or (word[1:2] in ("'", "’") and word[2:3].isupper())
        initial = len(word) == 1 and text[m.end() : m.end() + 1] == "."
        if low in STOP and not initial and not (capital and low not in ("i", "id") and word.isupper() and upper == "all") and not particle:
            break
        if words and upper is not None and not particle and not initial:
            if (upper in ("cap", "all")) and not capital:
                break
        if upper is None and not particle:
            upper = "all" if word.isupper() and len(word) > 1 else "cap" if capital else "low"
        words.append(word)
        stop = m.end() + (1 if initial else 0)
        if not particle:
            parts += 1
            end = stop
        if not initial and parts >= 3 and upper == "low":
            break
        g = GAP.match(text, stop)
        if not g or (g.group(1) and not initial):
            break
        if g.group(2):
            nxt = TOKEN.match(text, g.end())
            if commas or not nxt or blocked[nxt.start()] or nxt.group().lower() in STOP or (upper != "low" and not nxt.group()[0].isupper()):
                break
            commas += 1
        pos = g.end()
    if parts < 2:
        return None
    if all(len(w) == 1 for w in words) or (len(words[-1]) == 1 and not commas):
        return None
    return at, end


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every personal item, in order, without overlaps."""
    got: list[tuple[float, int, int, str]] = []

    def before(i: int, n: int = 45) -> str:
        return text[max(0, i - n) : i]

    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is two; places must stay the same
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    at_sign, dots = "@" in text, any(w in low for w in DOT_WORDS)
    runs = []
    if at_sign:
        runs.append(EMAILS[0])
        if dots or "[" in text or "(" in text or "{" in text or "<" in text:
            runs.append(EMAILS[3])
    if AT_MARK.search(text):
        runs.append(EMAILS[1])
    if dots and AT_SPOKEN.search(low):
        runs.append(EMAILS[2])
    emails = [(m.start(), m.end(), s) for rx, s in runs for m in rx.finditer(text)]
    got += [(s, a, b, "email") for a, b, s in emails]
    payment: list[tuple[int, int]] = []
    if re.search(r"\d", text):
        windows = _number_windows(text)
        payment = [span for a, b in windows for span in _payment_numbers(text, a, b)]
        for name, rx, score in IDS:
            if name in ("nino", "card"):  # letters among the digits
                hits = rx.finditer(text) if (NINO_END if name == "nino" else CARD_SHAPE).search(text) else ()
            else:
                hits = (m for a, b in windows for m in rx.finditer(text, a, b))
            for m in hits:
                ctx = before(m.start())
                if name in ("taxid", "sin"):  # plain digits: only after words that mean just this
                    if not NUMBER_CUE.search(ctx):
                        continue
                    score_ = score + 0.5
                else:
                    score_ = score
                score_ += _valid_id(name, m.group()) + (0.5 if CUES["id_number"].search(ctx) else 0.0) - (0.8 if AGAINST.search(ctx) else 0.0)
                got.append((score_, m.start(), m.end(), "id_number"))
        for rx, score in PHONES:
            for m in (m for a, b in windows for m in rx.finditer(text, a, b)):
                digits = sum(ch.isdigit() for ch in m.group())
                if not 7 <= digits <= 20:
                    continue
                ctx = before(m.start())
                near = any(abs(a - m.end()) < 40 or abs(m.start() - b) < 20 for a, b, _ in emails)
                score_ = score + (0.4 if CUES["phone"].search(ctx) else 0.0) + (0.3 if near else 0.0) - (0.9 if AGAINST.search(ctx) else 0.0)
                score_ -= 0.7 if re.search(r"(?i)passport|social|\bID |identi|ausweis|documento", ctx) and not m.group().startswith("+") else 0.0
                got.append((score_, m.start(), m.end(), "phone"))
        for rx, score in _address_patterns(text):
            for m in rx.finditer(text):
                ctx = before(m.start(), 60)
                score_ = score + (0.4 if CUES["address"].search(ctx) else 0.0) + (0.4 if re.search(ZIP, m.group()[4:]) else 0.0) - (0.9 if AGAINST.search(ctx) else 0.0)
                if re.search(r"\d", m.group()):
                    got.append((score_, m.start(), m.end(), "address"))
    kept: list[tuple[int, int, str]] = []
    blocked = bytearray(len(text) + 1)
    for a, b in payment:
        if any(g[3] == "id_number" and g[0] >= THRESHOLD and g[1] < b and a < g[2] for g in got):
            continue  # what the context calls an identity number is one
        blocked[a:b] = b"\x01" * (b - a)
    order = {"email": 0, "address": 1, "id_number": 2, "phone": 3}
    for score, a, b, kind in sorted((g for g in got if g[0] >= THRESHOLD), key=lambda g: (order[g[3]] if g[3] in ("email", "address") else 2, -g[0], -(g[2] - g[1]))):
        if any(blocked[a:b]):
            continue
        kept.append((a, b, kind))
        blocked[a:b] = b"\x01" * (b - a)
    for rx in (NAME_CUE, TITLED):
        for m in _cues(text, low) if rx is NAME_CUE else rx.finditer(text):
            at = m.end()
            while at < len(text) and text[at] in "  ":
                at += 1
            span = _read_name(text, at, blocked) if at < len(text) and not blocked[at] else None
            if not span:
                continue
            a, b = span
            first = text[a]
            score = 1.0 + (0.2 if first.isupper() else 0.0)
            if SPOKEN.match(m.group()) and not all(w[0].isupper() for w in TOKEN.findall(text[a:b]) if w.lower() not in PARTICLE):
                continue  # after a verb of saying or thanks, every part has its capital
            rest = text[b : b + 12]
            if LOOSE.match(m.group()) or rx is TITLED:
                # a bare role word needs capitals, or a following delimiter and personal data near by
                near = any(abs(x - b) < 6 or abs(a - y) < 6 for x, y, _ in kept)
                sure = near or VERB.match(rest) or re.search(r"(?i)\b(?:dr|prof|mr|mrs|ms|herr|frau)\b\.?\s*$", m.group())
                score += 0.3 * bool(near) - (0.0 if first.isupper() else (0.1 if sure else 0.6)) + (0.1 if sure else 0.0)
            if re.match(r"\s*(?:Street|Road|Panel|Model|Group|Team|Split)\b", rest):
                score -= 0.6
            if score >= THRESHOLD and not any(blocked[a:b]):
                kept.append((a, b, "name"))
                blocked[a:b] = b"\x01" * (b - a)
    return sorted(kept)


def redact(text: str) -> str:
    out, at = [], 0
    for a, b, kind in find(text):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


def personal_items(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, pii_text), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, texts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, e, kind in find(t):
                    ids.append(i)
                    kinds.append(kind)
                    texts.append(t[a:e])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "kind", "pii_text"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return rows.mapInArrow(run, "doc_id long, kind string, pii_text string").distinct()


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every text with typed placeholders; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([redact(t) if t else t for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"]
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text string")
