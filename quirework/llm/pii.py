"""Personal information in free text: spans and typed placeholders.

Regular expressions propose spans, validators confirm or reject them (Luhn for
card-like digit runs, mod 97 for account and French numbers, the check digit of
German tax numbers, areas of American ones, area and digit counts for
telephones), and words nearby adjust the
score of a span that could also be an order number or an ordinary word.  Spans
scoring ``THRESHOLD`` or more are kept; where two overlap, the type earlier in
``TYPES`` wins.

People are found from a list of given and family names.  The list is incomplete,
so it is also read for its endings: a word is a name if it is made of a stem and
an ending that each occur in at least ``MIN_PARTNERS`` listed names.

Each row is read alone, so the work is one pass over the text without a shuffle.
The name list is small reference data and travels with the function.

Edge cases.  Null and blank texts have no spans and come back unchanged.  Whole
texts are read, however long.  Positions count code points.  Repeated rows give
repeated results.  An empty name list finds no names but all other types.
Columns beyond those named are kept by ``redact`` and not read by ``spans``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "address", "phone", "id_number", "name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}
THRESHOLD = 0.5
MOST_NAMES = 20_000  # of the name list
MIN_PARTNERS = 3
CONTEXT = 42

# Listed names that are ordinary words too and need context when they stand alone.
ORDINARY = set(
    "will mark rose dawn amber grace bell field marsh page price reed stone may june april hope faith bill frank art rich "
    "jack rob drew pat sky summer hunter mason carter baker cook king young long small brown white black green gray wood "
    "woods hill rivers lake brook banks park street hall church bush rice fox wolf day west north winter frost rain snow".split()
)
FILE_ENDINGS = set("png jpg jpeg gif svg webp pdf txt md csv html js py css json xml zip".split())

_US = r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}"
_RUN = r"1[2-9]\d{2}[2-9]\d{6}"
_INTL = r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,5}){1,4}"
_HOME = r"0[1-9]\d{0,3}[ /-]\d{3,5}[ -]\d{2,5}(?:[ -]\d{2,4})?"
_PAIRS = r"0[1-9](?:[ .]\d{2}){4}"
PHONE = re.compile(rf"(?<![\w+./@-])(?:{_US}|{_PAIRS}|{_INTL}|{_HOME}|{_RUN})(?! ?\d)(?![-/]\d)(?!\w)(?: ?(?:ext\.?|x|Durchwahl|poste) ?\d{{1,5}})?")
IDENTITY = re.compile(
    r"(?<![\w+./@-])(?:\d{3}([-. ])\d{2}\1\d{4}|[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}|\d{2} \d{3} \d{3} \d{3}|\d{9}|\d{11}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{8}"
    r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?:\d{4}[ -]?){3}\d{1,7})(?!\w)(?![-/]\w)"
)
_KIND = r"(?:Street|Lane|Drive|Road|Avenue|Boulevard|Court|Way|Place|Square|Terrace|Close|Crescent|Highway|(?:St|Ave|Rd|Blvd|Ln|Dr|Ct|Pl|Sq)\b\.?)"
_CAP = r"[A-ZÄÖÜÉÈÀÂ][\wäöüßéèêàâç'-]+"
_UNIT = r"(?:,? (?:Apt|Suite|Unit|Flat|Floor|No)\.? ?\d+\w?)?"
_TOWN = rf"(?:(?:, ?|\n)(?:\d{{4,5}} )?{_CAP}(?: [A-Z]{{2}}(?= \d{{5}}))?(?: \d{{4,6}})?)?"
ADDRESS = re.compile(
    rf"(?<![\w/.-])\d{{1,5}}[A-Za-z]? (?:(?:North|South|East|West|N|S|E|W)\.? )?(?:{_CAP} ){{1,3}}?{_KIND}(?!\w){_UNIT}{_TOWN}"
    rf"|(?<![\w/.-])\d{{1,4}}(?: ?(?:bis|ter|[A-Za-z]))?,? (?:rue|avenue|boulevard|bd|place|chemin|impasse|all[ée]e|quai|cours)(?: (?:de la|de l'|du|des|de|d'))? ?{_CAP}(?:[ -]{_CAP}){{0,2}}(?:, ?\d{{5}} {_CAP})?"
    rf"|(?<!\w){_CAP}(?:straße|strasse|weg|platz|allee|gasse|ring|damm|ufer|str\.) \d{{1,4}} ?[A-Za-z]?(?!\w){_TOWN}"
    rf"|(?<!\w)(?:P\. ?O\. ?Box|PO Box|P\.O\.B\.|Post Office Box|Postfach|Boîte postale|B\.?P\.?) \d[\d ]*\d{_TOWN}"
)
ADDRESS_HINT = re.compile(r"Box|Postfach|postale|B\.?P|stra|weg|platz|allee|gasse|ring|damm|ufer|str\.|rue|avenue|boulevard|chemin|place|quai|cours|impasse|all[ée]e|" + _KIND)
FOR_ID = re.compile(
    r"(?i)\b(?:ssn|social security|insurance|passe?ports?|reisepass|pass|steuer\w*|tax|tin|ausweis\w*|personalausweis|identit\w+|identity|id|ni|nino|payroll|"
    r"carte|num[ée]ro fiscal|s[ée]curit[ée] sociale|versicherung\w*|licen[cs]e|national)\b"
)
# words for counts, papers, places and digests, of which a number near them is one
AGAINST_ID = re.compile(
    r"(?i)\b(?:rows?|counts?|totals?|sum|amount|invoices?|auftrag|rechnung|commande|facture|orders?|bestellung|receipts?|parts?|items?|hash|checksum|digest|commit|build|port|ticket|issue|isbn|issn|"
    r"shard|partition|node|lat|lon|long|latitude|longitude|coordinates?|version|release|batch|lots?|serial|sku|tracking)\b"
)
BEFORE_NAME = re.compile(
    r"(?:\b(?:Hi|Hello|Dear|Hallo|Liebe|Lieber|Bonjour|Cher|Chère|Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|M|Spoke with|with|by|from|From|candidate|Applicant|owner|backup|ask for|"
    r"for|ship to|contacter|Ansprechpartner ist|Rückfragen|Contact|contact|as|of|cc|regards|Grüße|Cordialement)\b[.:,]?)\s*$"
)
# What people do, in general: verbs of saying, judging, moving and having to; in German and French the
# perfect as well, which takes a determiner or a participle behind the auxiliary.
AFTER_NAME = re.compile(
    r"\s*[<(|;/]|,? (?:thanks|merci|danke)\b|,? (?:tax|tel|phone|telefon|t[ée]l)\b|\s+au \+?\d"
    r"|\s+(?:(?:also|already|always|just|never|often|still|then) )?(?:wrote|writes|said|says|asked|asks|told|tells|replied|answered|agreed|confirmed|promised|suggested|explained|added|noted|mentioned|"
    r"pointed out|reviewed|approved|signed|called|phoned|joined|left|met|saw|read|knew|knows|thinks|thought|wants|wanted|needs to|has to|had to|moved to|lives|lived|works|worked)\b"
    r"|\s+(?:schrieb|sagte|fragte|meinte|antwortete|erkl[äa]rte|wohnt|arbeitet|muss|soll|m[öo]chte)\b|\s+hat (?:den|die|das|dem|der|ein\w*|uns|mir|ihn|sie|es|sich|nicht|schon|gestern|heute)\b"
    r"|\s+(?:habite|travaille|pense|veut|doit)\b|\s+(?:a|est) (?:(?:bien|d[ée]j[àa]|pas) )?\w{2,}(?:[ée]|i|u|it|is)e?\b",
    re.I,
)
AFTER_TITLE = re.compile(r"(?:, [\w-]+(?: [A-Z]\.)?)?\s+(?:a|est|habite|va|doit|peut|veut|n'|ne|devra|viendra)\b")
# nouns that make an ordinary word before them the name of a thing, a group, a place or a way
NOT_A_NAME = re.compile(
    r"\s+(?:teams?|services?|manuals?|buildings?|releases?|projects?|sync|ops|systems?|apps?|tools?|groups?|press|price|prices|curves?|charts?|tables?|lists?|files?|reports?|plans?|models?|"
    r"bays?|islands?|valleys?|bridges?|stations?|rooms?|halls?|street|lane|road|avenue|drive|court|square|place)\b",
    re.I,
)
ARTICLE = re.compile(r"\b(?:the|The|a|A|an|Project|project|der|die|das|le|la)\s+$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def french_number(shown: str) -> bool:
    """Thirteen characters of a French social-security number and the key that completes them to 97."""
    if len(shown) != 15 or not re.fullmatch(r"[12]\d{5}[\dAB]\d{8}", shown):
        return False
    body = shown[:13].replace("2A", "19").replace("2B", "18") if shown[5:7] in ("2A", "2B") else shown[:13]
    return body.isdigit() and 97 - int(body) % 97 == int(shown[13:])


def german_tax(digits: str) -> bool:
    """Eleven digits, the last of which checks the others (mod 11, 10)."""
    if len(digits) != 11 or not digits.isdigit() or digits[0] == "0":
        return False
    product = 10
    for c in digits[:10]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[10])


def us_number(digits: str) -> bool:
    """Nine digits without an area, group or serial of zeros and without area 666."""
    return digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"


def endings(names: Iterable[str]) -> set[tuple[str, str]]:
    """(stem, ending) pairs whose parts each recur in the list, closed under recombination."""
    pairs = {(n[:-k], n[-k:]) for n in names for k in (2, 3, 4) if len(n) - k >= 2 and n.isalpha()}
    while True:
        stems, ends = defaultdict(set), defaultdict(set)
        for s, e in pairs:
            stems[s].add(e)
            ends[e].add(s)
        kept = {(s, e) for s, e in pairs if len(stems[s]) >= MIN_PARTNERS and len(ends[e]) >= MIN_PARTNERS}
        if kept == pairs:
            return {(s, e) for s in stems for e in ends}
        pairs = kept


def _words(names: list[str]) -> str:
    """A pattern for the names, mixed or upper case."""
    pairs = endings(names)
    made = sorted({s for s, _ in pairs}), sorted({e for _, e in pairs}, key=lambda e: (-len(e), e))
    covered = {s + e for s, e in pairs}
    rest = sorted((n for n in names if n not in covered), key=lambda n: (-len(n), n))
    out = []
    if made[0]:
        out.append("(?:" + "|".join(map(re.escape, made[0])) + ")(?:" + "|".join(map(re.escape, made[1])) + ")")
        out.append("(?:" + "|".join(re.escape(s.upper()) for s in made[0]) + ")(?:" + "|".join(re.escape(e.upper()) for e in made[1]) + ")")
    out += [re.escape(n) for n in rest] + [re.escape(n.upper()) for n in rest]
    return "(?:" + "|".join(out) + ")(?![\\w])" if out else r"(?!)"


class Finder:
    """The compiled patterns for one name list: ``(kind, name)`` with kind ``given`` or ``family``."""

    def __init__(self, names: Iterable[tuple[str | None, str | None]]):
        given = sorted({n.strip() for k, n in names if k == "given" and n and n.strip()})
        family = sorted({n.strip() for k, n in names if k == "family" and n and n.strip()})
        g = _words(given)
        f = rf"{_words(family)}(?:-{_words(family)})?"
        self.name = re.compile(
            rf"(?<![\w@.-])(?=[A-ZÄÖÜ])(?:(?P<full>{g}(?: [A-Z]\.)*[  ]{f})|(?P<turned>{f}, {g}(?: [A-Z]\.)?(?!-))"
            rf"|(?P<short>[A-Z]\. ?(?:[A-Z]\. ?)?{f})|(?P<cut>{g} [A-Z]\.)|(?P<one>{g}|{f}))(?![@\w])"
        )

    def emails(self, text: str) -> Iterator[tuple[int, int]]:
        at = text.find("@")
        while at >= 0:
            left = at
            while left and (text[left - 1].isalnum() or text[left - 1] in "._%+*'-•"):
                left -= 1
            while left < at and text[left] in ".'-":
                left += 1
            m = _DOMAIN.match(text, at + 1)
            if m and left < at and any(c.isalnum() for c in text[left:at]) and m.group(1).lower() not in FILE_ENDINGS:
                yield left, m.end()
            at = text.find("@", at + 1)
        if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text or "at}" in text:
            for m in _BRACKETED.finditer(text):
                yield m.span()
        if " dot " in text or " DOT " in text:
            for m in _SPELLED.finditer(text):
                yield m.span()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Kept spans ``(type, start, end)`` in order of their start."""
        if not text or not text.strip():
            return []
        found: list[tuple[str, int, int]] = []

        def free(a: int, b: int) -> bool:
            return all(b <= s or e <= a for _, s, e in found)

        for a, b in self.emails(text):
            if free(a, b):
                found.append(("email", a, b))
        if ADDRESS_HINT.search(text):
            for m in ADDRESS.finditer(text):
                if free(*m.span()):
                    found.append(("address", *m.span()))
        for m in PHONE.finditer(text):
            if self.phone_score(m.group()) >= THRESHOLD and free(*m.span()):
                found.append(("phone", *m.span()))
        for m in IDENTITY.finditer(text):
            if self.identity_score(text, m) >= THRESHOLD and free(*m.span()):
                found.append(("id_number", *m.span()))
        for m in self.name.finditer(text):
            a, b = m.span()
            if m.lastgroup == "short" and text[a] == "M" and AFTER_TITLE.match(text, b):
                a = _TITLE.match(text, a).end()  # "M." is Monsieur here
                b = self.name.match(text, a).end()
            if self.name_score(text, m, a, b) >= THRESHOLD and free(a, b):
                found.append(("name", a, b))
        return sorted(found, key=lambda s: s[1])

    def phone_score(self, shown: str) -> float:
        digits = sum(c.isdigit() for c in re.split(r"ext|x|D|p", shown)[0])
        return 0.8 if 8 <= digits <= 15 else 0.0

    def identity_score(self, text: str, m: re.Match) -> float:
        shown = m.group()
        bare = re.sub(r"[ .-]", "", shown)
        before = text[max(0, m.start() - CONTEXT) : m.start()]
        before = re.split(r"[.!?;]\s|\n", before.replace("no. ", "no "))[-1]
        score = 0.5
        if m.group(1) and not us_number(bare):
            score = 0.0
        elif french_number(bare):
            score = 0.7
        elif german_tax(bare):
            score = 0.5
        elif bare.isdigit() and len(bare) >= 13:
            score = 0.35 if luhn(bare) else 0.0
        elif re.match(r"[A-Z]{2}\d{2}", bare) and len(bare) >= 15:
            score = 0.6 if mod97(bare) else 0.0
        elif bare.isdigit() and bare == shown:
            score = 0.3  # a run of digits may count anything
        if FOR_ID.search(before):
            score += 0.3
        if AGAINST_ID.search(before):
            score -= 0.4
        return score

    def name_score(self, text: str, m: re.Match, a: int, b: int) -> float:
        kind, shown = m.lastgroup, text[a:b]
        if kind != "one":
            return 0.8
        ordinary = shown.lower() in ORDINARY
        score = 0.2 if ordinary else 0.6
        before = text[max(0, a - 24) : a]
        if BEFORE_NAME.search(before):
            score += 0.3
        if AFTER_NAME.match(text, b):
            score += 0.3 if ordinary else 0.1
        if NOT_A_NAME.match(text, b) or ARTICLE.search(before):
            score -= 0.5
        return score

    def redact(self, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, a, b in self.spans(text):
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
        return "".join([*out, text[at:]]) if out else text


_TITLE = re.compile(r"M\. ?")
_DOMAIN = re.compile(r"[A-Za-z0-9*](?:[A-Za-z0-9*-]*[A-Za-z0-9*])?(?:\.[A-Za-z0-9*-]+)*\.([A-Za-z]{2,24})(?![\w-])")
_BRACKETED = re.compile(r"[A-Za-z0-9][\w.+*-]* ?[(\[{] ?(?:at|AT) ?[)\]}] ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?)[A-Za-z0-9-]+)*(?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?)[A-Za-z]{2,24}")
_SPELLED = re.compile(r"[\w+-]+(?: (?:dot|DOT) [\w+-]+)* (?:at|AT) [\w-]+(?: (?:dot|DOT) [\w-]+)+(?![\w-])(?! (?:at|AT|dot|DOT) )")


def listed(names: DataFrame, most: int = MOST_NAMES) -> list[tuple[str, str]]:
    """The name list, reference data of a few hundred rows, without duplicates.

    It becomes one pattern in every task, so a list of more than ``most`` names is refused rather than cut.
    """
    found = [(r["kind"], r["name"]) for r in names.select("kind", "name").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} names")
    return found


def spans(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``(key, pii_type, start_pos, end_pos)``, a row per occurrence."""
    known = listed(names)
    schema = df.select(key).withColumns({"pii_type": F.lit(""), "start_pos": F.lit(0), "end_pos": F.lit(0)}).schema

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder(known)
        for batch in batches:
            rows, kinds, starts, ends = [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                for kind, a, b in finder.spans(body):
                    rows.append(i)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(b)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            arrays = [keys, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "pii_type", "start_pos", "end_pos"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(find, schema)


def redact(df: DataFrame, text: str, names: DataFrame, out: str = "redacted") -> DataFrame:
    """``df`` with ``out``: the text with a placeholder in place of each span."""
    if out == text:
        raise ValueError("the result needs a name of its own")
    known = listed(names)
    df = df.drop(out)
    names_out = [*df.columns, out]

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder(known)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            bodies = pa.array([finder.redact(b) for b in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, bodies], names=names_out)

    return df.mapInArrow(clean, df.withColumn(out, F.lit(None).cast("string")).schema)
