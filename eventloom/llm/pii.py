"""Personal information in free text, found by a semi-Markov conditional random field.

Segments of a text compete: each candidate segment has a type and a score, the sum of
the weights of features of the whole span (shape, numbering plan, membership in the
directory of names) and of what stands around it. Between candidates the text is
outside, at score 0. Dynamic programming over the candidates picks the set of
non-overlapping segments with the greatest score, boundaries and types together; as a
stretch without candidates separates what comes before from what comes after, it runs
over one bounded cluster of candidates at a time. Weights are fitted by maximum
likelihood on sentences of :mod:`eventloom.llm.pii_training`.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = ("email", "phone", "id_number", "address", "name")
#: A directory of name parts is configuration; a larger one is refused rather than sent to every task.
MAX_NAMES = 200_000
#: Characters between two segments that still count as neighbours.
NEAR = 3
# Bounds of an entity, as the decoding wants them: an English street has at most so many words before its kind of road,
# a German one stands within so many characters before its number.
MAX_STREET_WORDS = 6
MAX_GERMAN_ROAD = 120

# Patterns that pass whole texts begin with a class of characters, by which the search skips what can't begin a match, and look
# back from behind the first one; runs of letters that nothing shorter could follow are possessive.
_L = r"[^\W\d_]"
_SEP = r"[   .\-/]"
_AT_WORDS = re.compile(r" ?\[at\] ?| ?\(at\) ?| at (?=[\w-]+ dot )", re.I)
_DOMAIN = {
    "plain": re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    "bracket": re.compile(r"[\w-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[\w-]+)+", re.I),
    "words": re.compile(r"[\w-]+(?: dot [\w-]+)+", re.I),
}
# numbering plans, as whole spans: international, North American, with trunk 0, nine digits in groups
_PLANS = {
    "nanp": rf"(?:(?:\+1|001|1){_SEP}?)?(?:\([2-9]\d\d\)|[2-9]\d\d){_SEP}?[2-9]\d\d{_SEP}?\d{{4}}",
    "intl": rf"(?:\+|00)[1-9]\d{{0,2}}{_SEP}?(?:\(0\){_SEP}?)?\d{{1,5}}(?:{_SEP}?\d{{2,8}}){{1,5}}",
    "trunk": rf"(?:\(0\d{{1,4}}\)|0[1-9]\d{{0,3}}){_SEP}?\d{{2,8}}(?:{_SEP}?\d{{2,6}}){{0,4}}",
    "nine": rf"[5-9]\d\d(?:{_SEP}?\d{{3}}{_SEP}?\d{{3}}|{_SEP}\d\d{_SEP}(?:\d\d{_SEP}\d\d|\d{{4}}))",
}
_PHONE = re.compile(r"(?<![\w.#/+(-])(?<!\d,)(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _PLANS.items()) + r")(?![\w])(?![.,/:-]\d)")
# where nine digits can be: no number reaches beyond such a run
_PHONE_RUN = re.compile(rf"[\d+(][\d+(){_SEP[1:]}{{8,}}")
_IDS = {
    "ssn": r"\d{3}(?P<sep>[-. ]?)\d{2}(?P=sep)\d{4}",
    "nino": r"[A-Za-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Da-d]",
    "dni": r"(?:\d{8}|\d{2}\.\d{3}\.\d{3})[- ]?[A-Za-z]",
    "passport": r"[A-Za-z]{1,2}[ -]?\d{6,8}",
    "tax": r"\d{2} ?\d{3} ?\d{3} ?\d{3}",
}
_ID = re.compile("(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _IDS.items()) + r")(?![\w])(?!-\d)")
# Words that name an identity number, a road, a house number.
ID_WORDS = (
    "ssn", "social security", "social sec", "soc. sec", "nino", "ni number", "ni no", "national insurance", "dni", "nif", "nie", "passport", "pasaporte", "passeport", "reisepass", "travel document", "doc.", "document",
    "ausweis", "tax", "tin", "steuer-id", "steuer-nr", "steuernummer", "utr",
)
_ID_REST = re.compile(r"(?:\.?(?:[ /-](?:no|nr|number|id|n|nº|de|identidad|security|ident|nif|dni|code|card)\b\.?º?)*)\s?[:=#]*\s?", re.I)
_ID_LABEL = re.compile(rf"\b(?:{'|'.join(map(re.escape, ID_WORDS))}){_ID_REST.pattern}$", re.I)
_ROADS = r"street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|way|court|ct|place|pl|terrace|ter|close|crescent|square|sq|row|hill|hollow|bend|parkway|pkwy"
_ROAD = frozenset(_ROADS.split("|"))
_HOUSE = re.compile(rf"\d(?<![\w.:/#-]\d)(?<!\d,\d)\d{{0,4}}[A-Za-z]?(?:-\d{{1,5}}[A-Za-z]?)? (?={_L})(?=(?:[\w'’-]++ ){{1,6}}(?:{_ROADS})\b)", re.I)
_WORDS = re.compile(rf"{_L}[\w'’-]*")
_GERMAN = re.compile(r" (?<=[a-zA-Zß.] )\d{1,4}[a-z]?\b(?:-\d{1,4}[a-z]?\b)?", re.I)
_GERMAN_ROADS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "graben", "werft", "damm", "ring", "steig", "markt", "chaussee", "promenade", "bach", "berg", "brücke", "siedlung", "anger")
_GERMAN_HEAD = re.compile(rf"(?<!\w)(?P<pre>(?:an|am|im|zum|zur|auf|in|unter|hinter|bei)(?: (?:der|dem|den))? (?:{_L}[\w-]* )?)?(?P<road>(?:{_L}[\w-]*\.?)?)$", re.I)
# Kinds of road that stand in front.
FRENCH_ROADS = ("rue", "avenue", "boulevard", "chemin", "impasse", "place", "allée", "quai", "route", "cours", "passage", "square")
SPANISH_ROADS = ("calle", "c/", "avenida", "avda", "plaza", "pza", "paseo", "camino", "ronda", "travesía", "carretera")
_FRENCH_NUMBER = re.compile(r"(?<![\w.,:/#-])\d{1,4}(?: ?(?:bis|ter|quater))?,? $", re.I)
_FRENCH = re.compile(rf"{_L}+ (?:(?:de la|du|des|de) |de l['’]|d['’])?{_L}[\w'’-]*", re.I)
_NEXT_WORD = re.compile(rf" {_L}[\w'’-]*")
_SPANISH = re.compile(rf"{_L}+[./]? ?(?:(?:de los|de las|de la|del|de) )?{_L}[\w'’-]*(?: {_L}[\w'’-]*){{0,2}}?(?:,? n\.?º |,? nº |, | )\d{{1,4}}(?: bis\b)?[A-Za-z]?\b", re.I)
_W_REST = rf"{_L}*+(?:['’-]{_L}++)*+"
_W = _L + _W_REST
_PARTICLE = r"(?:(?:van der|van den|van|von|de la|del|da|di|de) )?"
_PAIR = re.compile(rf"(?P<g>{_W})(?: (?P<m>{_L}\.))? (?P<f>{_PARTICLE}{_W})", re.I)
_REVERSED = re.compile(rf"(?P<f>{_PARTICLE}{_W}), (?P<g>{_W}|{_L}\.)(?: (?P<m>{_L}\.))?", re.I)
_INITIAL = re.compile(rf"(?P<g>{_L}\.)(?: ?(?P<m>{_L}\.))? ?(?P<f>{_PARTICLE}{_W})", re.I)
_INITIAL_ONLY = (("initial", _INITIAL),)
_NAME_FORMS = (("pair", _PAIR), ("reversed", _REVERSED), *_INITIAL_ONLY)
_UP = "A-ZÀ-ÖØ-ÞŁŚŻ"
_TITLED = re.compile(rf"[{_UP}](?<![\w'’-][{_UP}])(?:(?:\. [{_UP}])?[\w'’-]++(?: [{_UP}]\.)?,? {_PARTICLE}[{_UP}][\w'’-]|\. {_PARTICLE}[{_UP}][\w'’-])")
_WORD_BEFORE = re.compile(rf"({_L}(?<![\w'’-]{_L})(?:{_W_REST}|\.))(,?) (?:({_L}\.) )?$")
_FUNCTION = frozenset("of the and in for to a by rows with from on at is was were within".split())

# What commonly stands before a name, by kind, in five languages; single words, in use anywhere.
CUES_BEFORE = {
    "title": "mr mrs ms miss madam sir dr prof doctor professor herr herrn frau doktor sr sra srta señor señora don doña m mme mlle monsieur madame",
    "role": (
        "contact contacto kontakt customer client patient tenant guest member user owner holder applicant sender recipient addressee beneficiary caller colleague nurse driver passenger student witness employee manager buyer payer subscriber visitor neighbour landlord "
        "kunde kundin patientin mieter mieterin gast mitglied nutzer inhaber inhaberin antragsteller absender empfänger empfängerin ansprechpartner ansprechpartnerin kollege kollegin nachbar nachbarin schüler schülerin "
        "cliente clienta paciente inquilino inquilina titular solicitante remitente destinatario destinataria usuario vecino vecina alumno alumna "
        "patiente locataire titulaire demandeur expéditeur destinataire utilisateur voisin voisine élève 担当者 お客様 会員"
    ),
    "label": "name full_name fullname first_name last_name username display label signature signed author reporter assignee nombre nom",
    "greeting": "dear hello hi thanks regards cheers sincerely faithfully wishes greetings hallo grüße gruß grüßen dank danke estimado estimada querido querida saludo saludos atentamente gracias bonjour cher chère cordialement merci salutations",
    "verb": "asked ask tell told met meet meets called call inform informed contact contacted invited paid refund refunded spoke speak written sent forwarded reached rang signed escalated reported confirmed thank is was does did can will has ist war hat bat fragte traf es fue est était",
    "determiner": "the a an this that our my your its their unser mein mi tu su nuestro nuestra mon ma votre notre leur der die das dem den ein eine einen dieser le la les un une ce cette el los las una este esta",
    "preposition": "to from for by with of about via on behalf between and or at cc bcc attn re von an für mit bei durch laut und oder de para por con según y o pour par avec selon à et ou chez",
}
#: What commonly stands after one: verbs of the third person and the like.
CUES_AFTER = {
    "verb": (
        "says said asks asked wants wanted told tells wrote writes called calls gave gives moved moves lives lived has had is was will would can never still bought paid sent signed confirms confirmed reported reports complained replied needs works left joined appears "
        "sagt sagte fragt fragte will wollte schrieb schreibt meldet meldete bestätigt bestätigte bittet bat hat ist war wohnt zieht zog kündigte gab rief fehlt "
        "dice dijo pide pidió quiere escribió llamó confirma confirmó vive es fue ha no compró presentó sigue informa "
        "dit demande demanda veut écrit appelle confirme habite est a signale souhaite fournit reste"
    ),
    "link": "and or on at via under by und oder unter bei y o al en et ou au à 様",
}
_CLASS_BEFORE = {w: kind for kind, words in reversed(CUES_BEFORE.items()) for w in words.split()}
_CLASS_AFTER = {w: kind for kind, words in reversed(CUES_AFTER.items()) for w in words.split()}
_HEAD = re.compile(rf"({_L}(?<![\w'’-]{_L})(?:{_W_REST}|\.)),?(?: {_L}\.)? {_PARTICLE}{_W}[*_\"',;.?)<>/b]*\s?$")
_BEFORE = re.compile(r"([^\W\d](?<!\w[^\W\d])[^\W\d]*+)(\.?+)([\"']?+[ \n]*+[:=>]*+[ \n]*+[*_<>\"'(\[|]*+(?:b>|p>|td>|li>|i>|strong>|span>)?+)$")
_AFTER = re.compile(r"[*_\"')\]<>/]*(?:b>|br/?>|td>|i>|strong>|span>)?[ ,;:.?!(]*([^\W\d]+)(?!\w)")
_ENDING = re.compile(r"(?:ed|ing|ly|ion|ment|able|ous|ers?|s|t|en|te|ck|d|k)$")
_MAIL_AFTER = re.compile(r"[*_\"')]*(?:</b>)?(?:<br/>)?[ ,;:/(<]*[\w.+%-]++ ?(?:@|\[at\]|\(at\)| at [\w-]+ dot )", re.I)
_PHONE_AFTER = re.compile(r"[*_\"')]*(?:</b>)?(?:<br/>)?[ ,;:/(\n]*(?:on |at |unter |al |au |phone=)?(?:\+|\(|00|0|1[ -])?\d[\d (). -]{7,}")
_HOUSE_AFTER = re.compile(r"(?:</b>)?(?:<br/>)?[,;/]? ?\n?\d{1,5}[A-Za-z]? ")
_SPANISH_AFTER = re.compile(rf"(?:</b>)?(?:<br/>)?[,;/]? ?\n?(?:{'|'.join(map(re.escape, SPANISH_ROADS))})(?!\w)", re.I)
_GERMAN_AFTER = re.compile(rf"(?:</b>)?(?:<br/>)?[,;/]? ?\n?(?:(?:am|an|auf|im|zum|zur)(?: (?:der|dem|den))? )?(?:{_L}[\w-]* )?{_L}*(?:{'|'.join(map(re.escape, _GERMAN_ROADS))}) \d", re.I)
_SIGN_OFF = re.compile(r"(?:--|grüßen|regards|saludo|saludos|cordialement|wishes|thanks|dank|sincerely|atentamente|merci|gracias)[,.]?[ \r]*\n+[ >*]*$", re.I)
_NEXT_CHARS = re.compile(r"\W*(\w+)")
# What commonly stands before a phone number, what may stand between, and what stands before numbers of other kinds.
_PHONE_WORDS = "phone telephone fax mobile cell handy hotline ring rang text sms call dial nummer rufnummer teléfono móvil téléphone portable appelez llame 電話 extension under unter reach number".split()
_PHONE_LINKS = "is ist es est at on al au le under unter me".split()
_PHONE_CUE = re.compile(rf"(?:{'|'.join(_PHONE_WORDS)}|tel\w*|número(?: \w+)? es|numéro(?: \w+)? est)(?: (?:{'|'.join(_PHONE_LINKS)}))*[ :=`\"()]*$", re.I)
_NUMBER_WORDS = "offset offsets epoch ts= order invoice # id= seq= id ids record records row rows sku item pallet ticket batch partition version ref no. checksum build page section isbn eur usd gbp $ € £".split()
_NUMBER_CUE = re.compile(rf"(?:{'|'.join(map(re.escape, _NUMBER_WORDS))})[ :=(\"]*$", re.I)
# how text before a number ends if one of them stands there; in texts of other letters upper and lower case are more than two
_PHONE_ENDS, _NUMBER_ENDS = (*_PHONE_WORDS, *_PHONE_LINKS), tuple(w.rstrip("=") for w in _NUMBER_WORDS)


def _phone_cue(before: str) -> bool:
    low = before.lower()
    return not (low.isascii() and "tel" not in low and not low.rstrip(" :=`\"()\n").endswith(_PHONE_ENDS)) and bool(_PHONE_CUE.search(before))


def _number_cue(before: str) -> bool:
    return not (before.isascii() and not before.lower().rstrip(" :=(\"\n").endswith(_NUMBER_ENDS)) and bool(_NUMBER_CUE.search(before))


def lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Candidate:
    __slots__ = ("start", "end", "kind", "features", "score")

    def __init__(self, start: int, end: int, kind: str, features: list[str]):
        self.start, self.end, self.kind, self.features, self.score = start, end, kind, features, 0.0


def _case(word: str) -> str:
    return "U" if word.isupper() and len(word) > 1 else "l" if word.islower() else "T" if word[0].isupper() else "x"


class Proposer:
    """Candidate segments of a text with their features."""

    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.given = {lower(n) for n in given}
        self.family = {lower(n) for n in family}
        anchors: dict[str, list[str]] = defaultdict(list)
        for role, words in (
            ("name", self.given | self.family),
            ("before", {c for c, kind in _CLASS_BEFORE.items() if len(c) > 2 and kind in ("title", "role", "label", "greeting")}),
            ("after", {c for c, kind in _CLASS_AFTER.items() if len(c) > 2 and kind == "verb"}),
            ("id", ID_WORDS),
            ("french", FRENCH_ROADS),
            ("spanish", SPANISH_ROADS),
        ):
            for word in words:
                anchors[word].append(role)
        self.anchors = ahocorasick.Automaton()
        for word, roles in anchors.items():
            self.anchors.add_word(word, (len(word), roles))
        self.anchors.make_automaton()

    # -- single types ---------------------------------------------------------

    def emails(self, text: str, low: str) -> Iterator[Candidate]:
        signs = [m.span() for m in _AT_WORDS.finditer(text)] if "[at]" in low or "(at)" in low or " dot " in low else []
        at = text.find("@")
        while at >= 0:
            signs.append((at, at + 1))
            at = text.find("@", at + 1)
        for first, after in signs:
            sign = text[first:after]
            form = "plain" if sign == "@" else "words" if sign.lower() == " at " else "bracket"
            domain = _DOMAIN[form].match(text, after)
            if not domain:
                continue
            # back over the local part, however long; it holds no at-sign, so all of them together pass a text once
            start = first
            while start and (text[start - 1] in ".+%-_" or text[start - 1].isalnum()):
                start -= 1
            local = text[start:first]
            if not local or not (local[-1] in "+%_" or local[-1].isalnum()):
                continue
            s, e = first - len(local.lstrip(".-%+")), domain.end()
            if s < first:
                yield Candidate(s, e, "email", ["e", f"e:{form}", f"e:dots{min(domain.group().count('.'), 3)}"])

    def phones(self, text: str) -> Iterator[Candidate]:
        # a number and the two characters behind it that decide whether it ends there
        runs = [r.span() for r in _PHONE_RUN.finditer(text) if sum(map(str.isdigit, r.group())) >= 9]
        for m in (m for first, end in runs for m in _PHONE.finditer(text, first, end + 2)):
            span = m.group()
            digits = sum(map(str.isdigit, span))
            if not 9 <= digits <= 14:
                continue
            s, e = m.span()
            before = text[max(0, s - 26) : s]
            f = ["p", f"p:{m.lastgroup}", f"p:n{digits}:{m.lastgroup}"]
            f.append("p:plus" if span[0] == "+" else "p:paren" if "(" in span else "p:bare" if span.isdigit() else "p:groups")
            if span.isdigit():
                f.append(f"p:bare:{m.lastgroup}")
            form = "bare" if span.isdigit() else "sep"
            left, after = before.rstrip(" *_<>\"'([|`"), text[e : e + 3].lstrip(" *_\"')]|`")
            opens = "^" if not left or left[-1] == "\n" else left[-1] if left[-1] in ":=,;./-#" else "b" if before.endswith(">") else "9" if left[-1].isdigit() else "w"
            f += [f"p:{form}:opens:{opens}", f"p:{form}:closes:{'$' if not after else after[0] if not after[0].isalnum() else 'w'}"]
            word = _BEFORE.search(before)
            if word:
                kind = _CLASS_BEFORE.get(lower(word.group(1)))
                f += [f"p:{form}:word:{kind or _case(word.group(1))}"] + ([f"p:{form}:word:{lower(word.group(1))}"] if kind else [])
            if _phone_cue(before):
                f.append("p:cue")
                f.append(f"p:cue:{form}")
            if _number_cue(before):
                f.append("p:counter")
            if _ID_LABEL.search(before):
                f.append("p:id")
            if _MAIL_AFTER.match(text[e : e + 60]) or "@" in before:
                f.append("p:mail")
            yield Candidate(s, e, "phone", f)

    def identity(self, text: str, label_end: int) -> Iterator[Candidate]:
        """A number right behind a label."""
        m = _ID.match(text, _ID_REST.match(text, label_end).end())
        if m:
            shape = next(k for k in _IDS if m.group(k))
            yield Candidate(m.start(), m.end(), "id_number", ["i", f"i:{shape}", f"i:n{sum(map(str.isdigit, m.group()))}"])

    def addresses(self, text: str, low: str) -> Iterator[Candidate]:
        for m in _HOUSE.finditer(text):
            words, at = [], m.end()
            while len(words) <= MAX_STREET_WORDS and (w := _WORDS.match(text, at)):
                words.append(w.group())
                if len(words) > 1 and (road := lower(words[-1])) in _ROAD:
                    f = ["a", "a:en", f"a:en:n{len(words)}", f"a:case{_case(words[0])}", f"a:road:{road}"]
                    after = text[w.end() : w.end() + 24]
                    nxt = _WORDS.match(after, 1)
                    f.append("a:more" if after[:1] == " " and nxt and lower(nxt.group()) in _ROAD and _case(nxt.group()) == _case(words[0]) else "a:last")
                    if any(lower(x) in _FUNCTION for x in words):
                        f.append("a:function")
                    stop = after[:1] == "."
                    if stop:
                        f.append("a:before.")
                        # an abbreviation's stop, unless it ends the sentence
                        rest = "end" if not after[1:2].strip() and not after[1:].strip(" ") else "line" if after[1:2] in "\r\n" else "go" if after[1:2] in ",;<\"" else "next"
                        yield Candidate(m.start(), w.end() + 1, "address", [*f, "a:with.", f"a:with.:{road}", f"a:with.:{'abbr' if len(road) < 5 else 'word'}:{rest}"])
                    yield Candidate(m.start(), w.end(), "address", f)
                at = w.end() + 1
                if text[w.end() : at] != " ":
                    break
        for m in _GERMAN.finditer(text):
            if not low.endswith(_GERMAN_ROADS, 0, m.start()):
                continue
            at = max(0, m.start() - MAX_GERMAN_ROAD)
            head = _GERMAN_HEAD.search(text[at : m.start()])
            if not head or not (m.start() - at - head.start("road") or head.group("pre")):
                continue
            pre = head.group("pre")
            f = ["a", "a:de", "a:de:pre" if pre else "a:de:plain"]
            if not pre:
                yield Candidate(at + head.start("road"), m.end(), "address", f)
                continue
            while head and (p := head.group("pre")):
                yield Candidate(at + head.start(), m.end(), "address", [*f, f"a:pre:{p.strip()}", f"a:pre:{_case(p)}", f"a:pre:{len(p.split())}:{_case(p)}"])
                at, head = at + head.start() + 1, _GERMAN_HEAD.search(text[at + head.start() + 1 : m.start()])
            at = max(0, m.start() - MAX_GERMAN_ROAD)
            head = _GERMAN_HEAD.search(text[at : m.start()])
            yield Candidate(at + head.start("road"), m.end(), "address", ["a", "a:de", "a:de:cut", f"a:cut:{pre.strip()}", f"a:cut:{_case(pre)}", f"a:cut:{len(pre.split())}:{_case(pre)}"])

    def french(self, text: str, road: int) -> Iterator[Candidate]:
        """A house number and the road whose kind begins at ``road``."""
        number = _FRENCH_NUMBER.search(text[max(0, road - 18) : road])
        m = _FRENCH.match(text, road)
        if not number or not m:
            return
        start = road - len(number.group())
        yield Candidate(start, m.end(), "address", ["a", "a:fr", "a:fr:short"])
        w = _NEXT_WORD.match(text, m.end())
        if w:
            yield Candidate(start, w.end(), "address", ["a", "a:fr", "a:fr:long", f"a:fr:{_case(w.group().strip())}", f"a:fr:{lower(w.group().strip())}"])

    def spanish(self, text: str, road: int) -> Iterator[Candidate]:
        m = _SPANISH.match(text, road)
        if m:
            yield Candidate(m.start(), m.end(), "address", ["a", "a:es", f"a:es:{_case(m.group().split()[0])}"])

    # -- names ----------------------------------------------------------------

    def anchored(self, text: str, low: str) -> Iterator[Candidate]:
        """Candidates that need a word: names, labelled numbers, roads named by their kind."""
        starts: set[int] = set()
        for m in _TITLED.finditer(text):
            starts.add(m.start())
            starts.add(m.start() + m.group().index(" ") + 1)  # the first word may be a title
        size = len(low)
        for end, (length, roles) in self.anchors.iter(low):
            s, e = end - length + 1, end + 1
            if (s and low[s - 1].isalnum()) or (e < size and low[end].isalnum() and low[e].isalnum()):
                continue
            for role in roles:
                if role == "name":
                    starts.add(s)
                    at = max(0, s - 40)
                    before = _WORD_BEFORE.search(text[at:s]) if s and text[s - 1] in " \n" else None
                    if before:
                        starts.add(at + before.start())
                        if before.group(3):
                            starts.add(at + before.start(3))
                elif role == "before":
                    at = e
                    while at < size and at < e + 4 and not text[at].isalpha():
                        at += 1
                    starts.add(at)
                elif role == "after":
                    at = max(0, s - 60)
                    head = _HEAD.search(text[at:s])
                    if head:
                        starts.add(at + head.start())
                elif role == "id":
                    yield from self.identity(text, e)
                elif role == "french":
                    yield from self.french(text, s)
                else:
                    yield from self.spanish(text, s)
        seen: set[tuple[int, int]] = set()
        for s in sorted(starts):
            left = text[s - 1] if s else " "
            if left.isalnum():
                continue
            for form, pattern in _INITIAL_ONLY if left in "-_'’@" else _NAME_FORMS:
                m = pattern.match(text, s)
                if not m or m.span() in seen:
                    continue
                seen.add(m.span())
                yield Candidate(m.start(), m.end(), "name", self._name_features(text, m, form))

    def _name_features(self, text: str, m: re.Match, form: str) -> list[str]:
        s, e = m.span()
        given, family = m.group("g"), m.group("f")
        g, fam = lower(given), lower(family)
        pieces = fam.split("-")
        in_g = g in self.given or ("-" in g and all(p in self.given for p in g.split("-")))
        in_f = fam in self.family or (len(pieces) > 1 and any(p in self.family for p in pieces))
        swapped = g in self.family or fam in self.given
        before, after = text[max(0, s - 30) : s], text[e : e + 48]
        cue, tail = _BEFORE.search(before), _AFTER.match(after)
        opened = _CLASS_BEFORE.get(lower(cue.group(1))) if cue else None
        followed = _CLASS_AFTER.get(lower(tail.group(1))) if tail else None
        sign = before.rstrip(" >*").endswith("\n") and bool(_SIGN_OFF.search(before))
        mail = bool(_MAIL_AFTER.match(after))
        if not (in_g or in_f or opened or followed or sign or mail) and before and before[-1] != "\n":
            return self._bare_features(form, m, before, after)
        case = _case(given.strip(".")) + _case(family)
        known = f"{int(in_g)}{int(in_f)}"
        f = ["n", f"n:{form}", f"n:{form}:{known}", f"n:known{known}", f"n:case{case}", f"n:{known}:{case}"]
        role = _CLASS_BEFORE.get(given.strip(".").lower())
        if role:
            f.append(f"n:g:is:{role}")
        if m.group("m"):
            f.append("n:middle")
        if swapped:
            f.append("n:swapped")
        left = before.rstrip(" *_<>\"'([|")
        mark = "^" if not before.strip() or before.endswith("\n") else left[-1:] if left[-1:] in ":=,;.!?>)]-/" else "w"
        f += [f"n:mark:{mark}", f"n:mark:{mark}:{known}", f"n:mark:{mark}:{case}"]
        if left[-1:].isdigit():
            f.append("n:number")
        if opened:
            f += ["n:cue", f"n:cue:{opened}", f"n:cue:{opened}:{known}", f"n:cue:{opened}:{mark}", f"n:cue:{opened}:{case}", f"n:cue:{lower(cue.group(1))}"]
        elif sign:
            f += ["n:sign", f"n:sign:{known}"]
        else:
            f.append(f"n:before:{_case(cue.group(1)) if cue else '^'}:{known}")
        if followed:
            f += ["n:tail", f"n:tail:{followed}", f"n:tail:{followed}:{known}", f"n:tail:{followed}:{case}", f"n:tail:{lower(tail.group(1))}"]
        else:
            f.append(f"n:after:{_case(tail.group(1)) if tail else '$'}:{known}")
        nxt = _NEXT_CHARS.match(after)
        f.append(f"n:next:{'word' + _case(nxt.group(1)) if nxt else '$'}" if after[:1] == " " else f"n:next:{after[:1] or '$'}")
        if mail:
            f.append("n:mail")
        if _PHONE_AFTER.match(after):
            f.append("n:phone")
        if _HOUSE_AFTER.match(after):
            f.append("n:house")
        around = lower(text[max(0, s - 50) : e + 70])
        if len(fam) > 4 and around.count(pieces[0]) > 1:
            f.append("n:echo")
        if not in_g and form != "initial":
            f.append(f"n:g:{g}" if g in _COMMON else "n:g:rare")
        if not in_f:
            f.append(f"n:f:{fam}" if fam in _COMMON else "n:f:rare")
        ordinary = f"{int(g in ORDINARY)}{int(fam in ORDINARY)}"
        if ordinary != "00":
            f += [f"n:ordinary:{ordinary}", f"n:ordinary:{ordinary}:{known}", f"n:ordinary:{ordinary}:{case}"]
        if "l" in case:
            # words in lower case: their endings, and what announces them, tell prose from names
            ends = "".join(e.group() if (e := _ENDING.search(w)) else "-" for w in (g, fam))
            f += [f"n:lower:{ends}", f"n:lower:{known}:{ends}", f"n:lower:{known}:{opened}", f"n:lower:{known}:{followed}", f"n:lower:{opened}:{ordinary}", f"n:lower:{mark}"]
        if fam in _COMMON or g in _COMMON:
            f.append("n:common")
        if form == "initial" and g == "m.":
            f += ["n:m", f"n:m:{followed or ('sign' if sign else '')}"]
        return f

    def _bare_features(self, form: str, m: re.Match, before: str, after: str) -> list[str]:
        """Of a span for which no word speaks: weights of its own, with what opens it and what follows."""
        given, family = m.group("g"), m.group("f")
        left = before.rstrip()
        opens = left[-1:]
        if opens.isalnum():
            opens = f"word{_case(left.rsplit(None, 1)[-1])}"
        elif opens == "." and left[-2:-1].isalpha() and not left[-3:-2].isalnum():
            opens = "initial"
        follows = "road" if _SPANISH_AFTER.match(after) else "none"
        if any(map(str.isdigit, after)):
            follows = "house" if _HOUSE_AFTER.match(after) else "phone" if _PHONE_AFTER.match(after) else "road" if follows == "road" or _GERMAN_AFTER.match(after) else "none"
        case = _case(given.strip(".")) + _case(family)
        f = ["bare", f"bare:{form}", f"bare:case{case}", f"bare:opens:{opens}", f"bare:follows:{follows}", f"bare:{opens}:{follows}", f"bare:{form}:{opens}:{follows}", f"bare:case{case}:{follows}", f"bare:next:{after[:1]}"]
        if left.rstrip(".,:;>")[-1:].isdigit():
            f.append("bare:number")
        g, fam = lower(given), lower(family)
        if g in _COMMON:
            f += ["bare:common", f"bare:g:{g}"]
        if fam in _COMMON:
            f += ["bare:common", f"bare:f:{fam}"]
        ordinary = f"{int(g in ORDINARY)}{int(fam in ORDINARY)}"
        if ordinary != "00":
            f += [f"bare:ordinary:{ordinary}", f"bare:ordinary:{ordinary}:{follows}"]
        if fam in self.given or g in self.family:
            f.append("bare:swapped")
        if m.group("m"):
            f.append("bare:middle")
        return f

    def candidates(self, text: str) -> list[Candidate]:
        low = lower(text)
        out = [*self.emails(text, low), *self.phones(text), *self.addresses(text, low), *self.anchored(text, low)]
        once = {(c.start, c.end, c.kind): c for c in reversed(out)}
        return [once[k] for k in sorted(once)]


# Ordinary words that stand where a name part might: function words of the five languages, and words of offices, shops and computing.
_COMMON = frozenset(
    "the a an and or of to in on at by for with from is was were are be been not no it its this that these those we our they their he she him her his i you your who what when where why how will would can could may might must shall do does did has have had "
    "please still again only also just never nobody everybody all any some more less than then there here up down out over under before after during until since about between into while though although because if so as too very much many few one two both each every other another such own same says said "
    "der die das ein eine einer eines im in am an auf aus bei bis den dem des durch für gegen mit nach ohne um und oder aber ist war sind wird nicht kein keine von vom vor während weil zum zur zu es er sie wir ihr bitte noch auch nur heute gestern weil wenn als wie dass ob so sehr viel mehr seit "
    "le la les un une des du de et ou mais est sont était dans sur pour par avec sans sous entre ne pas plus ce cette ces nous vous ils elle il si comme car puis très aussi depuis tandis que qui "
    "el los las una uno y o pero es son era en por para con sin sobre entre no más este esta estos nosotros ellos ella se su lo al del si como porque muy también desde mientras que quien "
    "address archive article batch book box branch budget build call campaign cancel case change chapter chart check client clock cloud cluster column contact contract copy count court crew customer data database date day delivery department desk document door draft "
    "email error event export factory fax file filter finance floor form gate group guide hall home hour house import index invoice issue item job key lane letter line link list log mail manager manual map market message meeting mobile monday month morning name network news night north note "
    "number office operations order owner page park parcel part partner payment phone place plan platform point pool port press price product project queue rate record refund release report request review ring road room route row sale schedule school section sector series server service "
    "session shard sheet shift shipment shop signature site south spring square staff stage station stock stop store stream street summer support system table task tax team test text ticket time title total track trade training update user value version visit wall warehouse way week west "
    "window winter work world year zone artikel auftrag bestellung büro datei fehler feld kunde kundin lager lieferung rechnung seite straße tag woche zeile archivo artículo calle campo cliente correo error factura fecha pedido tienda adresse article champ client colis commande courrier facture fichier jour magasin rue".split()
) | frozenset(w.lower() for w in ("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday").split())


# Adjectives and nouns of which things are named: products, places, campaigns. In general use, in alphabetical order.
ADJECTIVES = "amber blue bright broad brown clear cold cool copper cotton crystal dark deep early eastern fast fine folded gentle glass golden grand gray green heavy hidden hollow iron late light little long lunar mild misty narrow new noble northern oak old open paper pearl pine plain pocket polar prime quick quiet rapid red round royal rustic salted sandy sharp silent silver slow small smart soft solar solid southern stone summer sunny swift tall tiny true twin velvet warm western white wide wild winter wooden yellow young".split()
NOUNS = "anchor apron archive backpack badge bag basket bell bench blanket board boat book boot bottle bowl box brick bridge broom brush bucket cable campaign candle canvas cap card chair clock coat collection crate cup curtain cushion desk dish door drawer drill engine event fan festival filter flask fork frame gate glove grill guide hammer hammock hook jacket jar kettle key kit knife ladder lamp lantern lens lid line lock magnet map market mat mill mirror mug nail notebook oven pack pan panel pen pencil period pillow pipe plan plate pot project pump queue rack radio release ring rope route rug saw scale scarf set sheet shelf shop shovel sieve sink speaker spoon stand station stool store stove stream strap table tank tape team tent tile tool torch towel tray trolley trowel tube umbrella vase wagon wallet watch wheel window wrench".split()
ORDINARY = frozenset(ADJECTIVES) | frozenset(NOUNS) | _COMMON


class Model:
    """Weights, scores and decoding."""

    def __init__(self, weights: dict[str, float], proposer: Proposer):
        self.weights, self.proposer = weights, proposer

    def clusters(self, text: str) -> Iterator[list[Candidate]]:
        """Runs of candidates that overlap or are neighbours."""
        weight, none = self.weights.get, repeat(0.0)
        run: list[Candidate] = []
        reach = -1
        for c in self.proposer.candidates(text):
            c.score = sum(map(weight, c.features, none))
            if run and c.start - reach > NEAR:
                yield run
                run = []
                reach = -1
            run.append(c)
            reach = max(reach, c.end)
        if run:
            yield run

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """The best set of non-overlapping segments, in order."""
        out: list[tuple[int, int, str]] = []
        for run in self.clusters(text):
            if len(run) == 1:
                if run[0].score > 0:
                    out.append((run[0].start, run[0].end, run[0].kind))
                continue
            best, back = [], []
            # candidates come by start; ended ones leave the heap by end. Of those that ended more than NEAR before,
            # only the best counts; the rest, whose link has a weight, are as many as end within NEAR characters.
            ended: list[tuple[int, int]] = []
            near: deque[int] = deque()
            far, far_at = 0.0, -1
            for j, c in enumerate(run):
                while ended and ended[0][0] <= c.start:
                    near.append(heapq.heappop(ended)[1])
                while near and c.start - run[near[0]].end > NEAR:
                    i = near.popleft()
                    if best[i] > far:
                        far, far_at = best[i], i
                top, at = far, far_at
                for i in near:
                    v = best[i] + self.weights.get(f"t:{run[i].kind}>{c.kind}", 0.0)
                    if v > top:
                        top, at = v, i
                best.append(top + c.score)
                back.append(at)
                heapq.heappush(ended, (c.end, j))
            j = max(range(len(run)), key=best.__getitem__)
            if best[j] <= 0:
                continue
            path = []
            while j >= 0:
                path.append((run[j].start, run[j].end, run[j].kind))
                j = back[j]
            out.extend(reversed(path))
        return out


def _logsumexp(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def fit(sentences: list[tuple[str, list[tuple[int, int, str]]]], proposer: Proposer, rounds: int = 40, rate: float = 0.25, decay: float = 2e-3) -> dict[str, float]:
    """Weights of greatest regularised likelihood (Adagrad over sentences, in a fixed order).

    Gradient of a sentence: features of the true segments minus their expectation,
    from forward and backward sums over all sets of non-overlapping candidates.
    """
    data = []
    for text, true in sentences:
        gold = set(true)
        cands = proposer.candidates(text)
        if cands:
            data.append((cands, [(c.start, c.end, c.kind) in gold for c in cands]))
    w: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(lambda: 1e-3)
    for _ in range(rounds):
        for cands, gold in data:
            n = len(cands)
            score = [sum(w[f] for f in c.features) for c in cands]
            link = {}
            for j, c in enumerate(cands):
                for i in range(j):
                    if cands[i].end <= c.start:
                        link[i, j] = f"t:{cands[i].kind}>{c.kind}" if c.start - cands[i].end <= NEAR else ""
            into, out = defaultdict(list), defaultdict(list)
            for i, j in link:
                into[j].append(i)
                out[i].append(j)
            value = lambda i, j: w[link[i, j]] if link[i, j] else 0.0  # noqa: E731, B023
            alpha = [0.0] * n
            for j in range(n):
                alpha[j] = score[j] + _logsumexp([0.0, *[alpha[i] + value(i, j) for i in into[j]]])
            beta = [0.0] * n
            for i in reversed(range(n)):
                beta[i] = _logsumexp([0.0, *[value(i, j) + score[j] + beta[j] for j in out[i]]])
            z = _logsumexp([0.0, *alpha])
            step: dict[str, float] = defaultdict(float)
            for j, c in enumerate(cands):
                d = gold[j] - math.exp(alpha[j] + beta[j] - z)
                if abs(d) > 1e-4:
                    for f in c.features:
                        step[f] += d
            chosen = [j for j in range(n) if gold[j]]
            follows = set(zip(chosen, chosen[1:]))
            for (i, j), f in link.items():
                if f:
                    step[f] += ((i, j) in follows) - math.exp(alpha[i] + value(i, j) + score[j] + beta[j] - z)
            for f, d in step.items():
                d -= decay * w[f]
                seen[f] += d * d
                w[f] += rate * d / math.sqrt(seen[f])
    return {f: round(v, 4) for f, v in w.items() if abs(v) > 1e-3}


@lru_cache(maxsize=4)
def trained(given: tuple[str, ...], family: tuple[str, ...], seed: int = 7, n: int = 3000) -> str:
    """Weights for a directory, as JSON: fitted once per driver on ``n`` generated texts (the bound of the sample)."""
    from eventloom.llm import pii_training

    return json.dumps(fit(pii_training.sentences(given, family, seed, n), Proposer(given, family)))


@lru_cache(maxsize=4)
def _model(given: tuple[str, ...], family: tuple[str, ...], weights: str) -> Model:
    return Model(json.loads(weights), Proposer(given, family))


def directory(names: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Given and family names of a directory (name_text, name_kind); nulls and blanks are left out."""
    rows = names.select("name_text", "name_kind").filter("trim(name_text) <> '' and name_kind in ('given', 'family')").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"a directory of more than {MAX_NAMES} names")
    of = lambda kind: tuple(sorted(r.name_text.strip() for r in rows if r.name_kind == kind))
    return of("given"), of("family")


def _per_text(docs: DataFrame, names: DataFrame, make, schema: str) -> DataFrame:
    given, family = directory(names)
    weights = trained(given, family)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(given, family, weights)
        for batch in batches:
            yield from make(model, batch)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def find(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, start, end, pii_type, pii_text) of each segment found; offsets in characters.

    Null and empty texts have none. Whole texts, one pass, no shuffle.
    """

    def make(model: Model, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                rows += [(doc, s, e, kind, text[s:e]) for s, e, kind in model.spans(text)]
        cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "end", "pii_type", "pii_text"])

    return _per_text(docs, names, make, "doc_id bigint, start int, end int, pii_type string, pii_text string")


def redact(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, text, n_found): each text with its segments replaced by ``<TYPE>``; null stays null."""

    def make(model: Model, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, counts = [], []
        for text in batch.column(1).to_pylist():
            parts, at, spans = [], 0, model.spans(text) if text else []
            for s, e, kind in spans:
                parts += [text[at:s], f"<{kind.upper()}>"]
                at = e
            texts.append(text if not spans else "".join([*parts, text[at:]]))
            counts.append(len(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_found"])

    return _per_text(docs, names, make, "doc_id bigint, text string, n_found int")


def found(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (doc_id, pii_type, pii_text)."""
    return find(docs, names).select("doc_id", "pii_type", "pii_text").distinct()
