"""Personal information in free text: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "address": "[ADDRESS]", "name": "[NAME]"}

# Given names, street words and the words that announce or rule out a kind.
GIVEN = (
    "Aisha Alice Amina Amir Ana André Andrea Andreas Anna Anne Antonio Aylin Ben Björn Carla Carlos Carmen Chloé Claire Clara Claudia Daniel David Diego Elena Elif Émile Emma Eric Eva Fatima "
    "Felix Fernando Florian François Frank Fritz George Greta Hanna Hanne Hannah Hans Heike Helena Henri Henrik Ines Inès Isabel Ivan Jack Jakob James Jan Javier Jean John Jonas José Juan Julia Jürgen "
    "Karin Karl Katja Klaus Lara Laura Léa Lena Louis Luc Lucas Lucía Luis Lukas Manuel Marek Maria María Marie Mark Marta Martin Mary Mateo Max Mehmet Mia Michael Mila Mireille Mohamed Nadia "
    "Nicolas Nina Noah Noor Nora Nuria Odile Olga Oliver Omar Oskar Pablo Paul Paula Pedro Peter Petra Pierre Pilar Piotr Rafael Robert Rosa Ruben Salma Samir Sarah Sofia Sophie Stefan Susan "
    "Teo Thomas Tim Tomas Tomás Ursula Viktor Walter Wolfgang Yara Yusuf Yves Zoé Zoe"
)
_STREET_EN = "Road|Street|Lane|Way|Court|Close|Row|Avenue|Drive|Place|Square|Terrace|Crescent|Hill|Gardens|Mews|Walk|Boulevard|Rd|St|Ave|Ln"
_STREET_FR = "rue|avenue|bd|boulevard|chemin|impasse|allée|place|quai|route|cours|square|passage|sentier|ruelle|av"
_STREET_ES = "Calle|C/|Avenida|Avda|Av|Plaza|Paseo|Camino|Ronda|Travesía|Carretera|Callejón|Pza|Plza"
_STREET_IT = "Via|Viale|Piazza|Piazzale|Corso|Vicolo|Largo|Rua|Praça"
#: The hundred most usual Chinese family names.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
#: Words that stand before the name of a person who is called, signs or is written to.
ASKED = "ask|ask for|contact|signed|regards|sincerely|attn|written by|author|name|says|demander|cordialement|grüßen|saludo|saludos|preguntar por|kontakt|ansprechpartner|ansprechpartnerin|contacto|contatto|saluti|signé|firmado|firma"
ANNOUNCE_ID = r"SSN|social security(?: number)?|national insurance(?: number)?|NI (?:no|number)|NINO|passport|pass no|tax(?: id| number)|ID card|identity card|Steuer-?I|Steuernummer|Ausweis|Personalausweis|Reisepass|Sozialvers|sécurité sociale|NIR|passeport|carte d.identité|DNI|NIE|NIF|pasaporte|seguridad social|身份证|护照|社保"
RULED_OUT = r"(?:serial|order no\.?|order|invoice|ticket|isbn|batch|rechnung|lot|total|checksum|offset|size|extension|version|memo|code|\bNr\.|pedido|commande|factura|facture)\s*[:#]?\s*$"
CALLING = r"call|ring|phone|tel|tél|fax|mobile|rückruf|rappel|appel|llam|contact|kontakt|keys|clés|llaves|schlüssel|电话|拨打|手机|phone="
LIVING = r"lives|live at|originals|invoice to|address|anschrift|originale|wohnt|wohnung|adresse|habite|originaux|dirección|originales|vive|went to|寄往|地址|住在|regards|cordialement|grüßen|saludo"
_FILES = "png|jpg|jpeg|gif|svg|webp|pdf|txt|csv|log|md|zip|docx|xlsx|js|py|css|html"

_AT = r"(?:@|＠|\s?[(\[{]\s?(?:at|AT|@)\s?[)\]}]\s?|\s(?:at|AT)\s(?=[A-Za-z0-9-]{2,}\s(?:dot|DOT)\s))"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+(?![A-Za-z0-9])")
#: What may stand for a blank within a number: also a no-break space or, where nothing else fits, a line break.
_S, _S_BROKEN = r" \xa0", r" \xa0\n"
_PHONES = [
    r"(?:\+1[ .-]?)?(?:\([2-9]\d\d\)\s?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}",
    r"(?:\+44[ -]?(?:\(0\)[ -]?)?|\(?0)(?:20\)?[ -]?\d{4}[ -]?\d{4}|1\d{2,3}\)?[ -]?\d{3}[ -]?\d{3,4}|[37]\d{2,3}[ -]?\d{3}[ -]?\d{3,4})",
    r"(?:\+33[ .-]?(?:\(0\)[ .-]?)?|0)[1-9](?:[ .-]?\d\d){4}",
    r"(?:(?:\+34|\(\+34\)|0034)[ .-]?)?[6789]\d\d[ .-]?\d{3}[ .-]?\d{3}",
    r"(?:\+34[ .-]?)?[6789]\d\d(?:[ .-]?\d\d){3}",
    r"(?:(?:\+|00)49[ /-]?(?:\(0\)[ -]?)?|\(?0)[1-9]\d{1,3}\)?[ /-]{1,3}\d{3,8}(?:[ -]\d{2,4})?",
    r"(?:\+86[ -]?)?(?:\(0?\d{2,3}\)|0\d{2,3}|(?<=\+86[ ])\d{2,3})[ -]?\d{4}[ -]?\d{4}",
    r"(?:\+86[ -]?)?1[3-9]\d[ -]?\d{4}[ -]?\d{4}",
    r"(?:\(\+\d{1,3}\)|\+\d{1,3}|00[1-9]\d)[ ./-]?(?:\(?\d{1,4}\)?[ .-]){1,4}\d{2,4}",
]
_PHONE, _PHONE_BROKEN = ([re.compile(p.replace("[ ", f"[{s}")) for p in _PHONES] for s in (_S, _S_BROKEN))
_NUMBERISH = re.compile(r"(?<![\w+(])(?:\(\+|\+|\(0?)?\d[\d \xa0\n().\-/]{7,22}\d(?![\w])|(?<=[一-鿿])(?:\(\+|\+|\(0?)?\d[\d \xa0\n().\-/]{7,22}\d")
_IDS = [
    r"\d{3}-\d{2}-\d{4}", r"\d{3} \d{2} \d{4}", r"\d{9}",
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    r"\d{2} \d{3} \d{3} \d{3}", r"\d{11}",
    r"\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}", r"\d{13}",
    r"\d{2}\.?\d{3}\.?\d{3} ?-? ?[A-Z]", r"[XYZ] ?-? ?\d{7} ?-? ?[A-Z]",
    r"[A-Z]\d{7}[A-Z]\d?", r"[A-Z]{1,2}\d{6,9}",
    r"\d{17}[\dXx]",
]
_ID = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p.replace(' ', '[ \\xa0\\n]')})" for p in sorted(_IDS, key=len, reverse=True)) + r")(?![A-Za-z0-9])", re.ASCII)
_TOWN = r"[A-ZÀ-ÞÄÖÜ][^\W\d_]+(?:[-'’ ](?:[a-z]{1,3}[-'’ ])?[A-ZÀ-ÞÄÖÜ][^\W\d_]+)?"
_TOWN1 = r"[A-ZÀ-ÞÄÖÜ][^\W\d_]+(?:-[A-ZÀ-ÞÄÖÜ][^\W\d_]+)*"
_POST_EN = r"(?:[A-Z]{2} ?\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z0-9]? \d[A-Z]{2})"
_ADDRESSES = [
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\w{{1,5}},\s+)?\d{{1,4}}[a-zA-Z]?,?\s(?:[A-Z][^\W\d_]+\s){{1,3}}(?:{_STREET_EN})\b\.?(?:,\s+(?:(?:Flat|Apt\.?|Unit|Suite)\s\w{{1,5}},\s+)?{_TOWN1}(?:,?\s+{_POST_EN}\b)?)?",
    rf"\d{{1,4}}(?:\s?(?:bis|ter|quater|[a-zA-Z])\b)?,?\s+(?:{_STREET_FR})\b\.?\s(?:(?:de|du|des|la|le|les)\s|(?:l|d)[’'])*[A-ZÀ-Þ][\w’'-]+(?:[ -](?:(?:de|du|des|la)\s)?[A-ZÀ-Þ][\w’'-]+)*(?:(?:,\s+|\s)\d{{5}}\s+{_TOWN1})?",
    rf"(?:[A-ZÄÖÜ][^\W\d_]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|graben|steig|markt|hof)|(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|Alte[r]?|Neue[r]?)\s[A-ZÄÖÜ][^\W\d_]+)\s+\d{{1,4}}(?:\s?[a-h]\b)?(?:,\s+(?:\d{{5}}\s+)?{_TOWN1})?",
    rf"(?:{_STREET_ES})\.?(?<!\w)?\s(?:(?:de|del|de la|de los|de las)\s)?[^,;:.\d\n]{{2,30}}?,?\s+(?:n\.?[ºo°]\s?)?\d{{1,4}}(?:,\s+\d{{1,2}}\.?[ºª°]\.?\s?[A-Za-z]{{0,3}}\b)?(?:,\s+\d{{5}}\s+{_TOWN1})?",
    r"(?:[一-鿿]{1,6}?(?:省|市|区|县|镇))*[一-鿿]{1,6}?(?:街|路|巷|大道|弄|胡同)\s?\d{1,5}\s?号(?:\s?\d{1,4}\s?(?:单元|室|楼|栋|号楼|层))*",
    rf"(?:{_STREET_IT})\s(?:(?:di|del|della|dei|da|do|dos|das|de)\s)?[A-ZÀ-Þ][\w’'-]*(?:\s(?:(?:di|del|della|dei|da|do|de)\s)?[A-ZÀ-Þ][\w’'-]+){{0,3}},?\s(?:n\.\s?)?\d{{1,4}}(?:,?\s+\d{{4,5}}(?:-\d{{3}})?\s+{_TOWN1})?",
]
_ADDRESS = [re.compile(rf"(?<!\w){p}" if i != 4 else p) for i, p in enumerate(_ADDRESSES)]
_ADDRESS_MAYBE = (
    rf"\b(?:{_STREET_EN})\b",
    rf"\d\s?(?:bis|ter|quater|[a-zA-Z])?,?\s+(?:{_STREET_FR})\b",
    r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|graben|steig|markt|hof|(?:Am|An de[rn]|Im|In der|Zu[mr]|Auf de[mr]|Unter den|Alter?|Neuer?)\s\p{Lu}\p{L}+)\s+\d",
    rf"(?:{_STREET_ES})\.?\s",
    r"(?:街|路|巷|大道|弄|胡同)\s?\d{1,5}\s?号",
    rf"\b(?:{_STREET_IT})\s",
)
_LETTERS = r"[^\W\d_]"
_G = "|".join(sorted({n for g in GIVEN.split() for n in (g, g.upper())}, key=len, reverse=True))
_FAMILY = rf"(?:(?:van|von|de|del|della|di|der|den|la|le|VAN|VON|DE)\s+){{0,2}}(?=[A-ZÀ-ÞŁŠŽ]){_LETTERS}{{2,}}(?:[-'’](?=[A-ZÀ-ÞŁŠŽ]){_LETTERS}{{2,}})*"
_GIVENS = rf"(?:{_G})(?:-(?:{_G}))*"
_NAME = re.compile(rf"(?<![\w@-])(?:(?P<g>{_GIVENS})(?:\s+[A-ZÀ-Þ]\.)*\s+(?P<f>{_FAMILY})|(?P<f2>{_FAMILY}),\s(?P<g2>{_GIVENS})(?:\s[A-ZÀ-Þ]\.(?=\W|$))*(?! +(?:(?:[A-Z]\. +)+[A-ZÀ-Þ]|(?:van |von |de )?[A-ZÀ-Þ]{_LETTERS}{{2}}|[A-ZÀ-Þ]\. ?[A-ZÀ-Þ])))(?![\w@-])")
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|M|Mme|Mlle|Sr|Sra|señora?|Señora?|Monsieur|Madame)\.?)\s$")
_MEETING = re.compile(r"(?i)(?:ask|with|contact:|to:|to|regards,|by|says|an|bei|sie|à|avec|a|las tiene|demander|cordialement,|grüßen|saludo,|login|from|and|et|und|y|,|;|\"|\t|/|\()\s*$")
NOT_FAMILY = frozenset("the a an and or der die das und le la les et el los las y il in on at for von with date subject release see no both two what please if there nobody contact invoice call send my dr mr ms herr frau street road was is".split())


_CAPITAL = "A-ZÀ-ÞŁŠŽ"
#: Capitalised words in a row, or two of them parted by a comma: what may be a name whatever its words.
_SHAPED = re.compile(rf"[{_CAPITAL}][\w'’-]+,?(?: [{_CAPITAL}]\.)* (?:(?:van|von|de|del|della|di|der|den|la|le|bin|al) ){{0,2}}[{_CAPITAL}][\w'’-]+(?: (?:[{_CAPITAL}]\.|[{_CAPITAL}][\w'’-]+)){{0,3}}")
_HAN = "[^\\W\\d_A-Za-z的了是在和与及或国司部门副总各有个这那]"
_CHINESE = re.compile(rf"(?P<asked>(?:联系人|姓名|作者|签名|经办人|负责人|收件人|寄件人|联系)[:：]?\s?)(?P<a>[{SURNAMES}]{_HAN}{{1,2}})(?![一-鿿])|(?P<b>[{SURNAMES}]{_HAN}{{1,2}})(?=先生|女士|小姐|老师|经理|主任|博士|教授)")
_PROPER = re.compile(rf"(?:[{_CAPITAL}]{_LETTERS}*[a-zß-öø-ÿ]|[{_CAPITAL}]{{2,}})(?:[-'’]{_LETTERS}+)*$")
_ASKED = re.compile(rf"(?:^|[^\w])(?:(?:{ASKED}),?:?|(?:from|to|von|an|de|à|para) ?:)\s$", re.I)
_LEADS = frozenset(ASKED.split("|")) | frozenset("mr mrs ms miss dr prof herr frau mme mlle sr sra señor señora monsieur madame".split()) | NOT_FAMILY


@dataclass
class Span:
    """A candidate of a kind (`shape`: a name by its shape only) with the votes of its labelers, and for names what stands around it."""

    kind: str
    start: int
    end: int
    votes: int
    context: int = 0


def _bits(*votes: bool) -> int:
    return sum(1 << i for i, v in enumerate(votes) if v)


def _context(text: str, start: int, end: int, width: int = 40) -> tuple[str, str]:
    return text[max(0, start - width) : start], text[end : end + width]


def _lone(before: str, after: str) -> bool:
    return bool(re.search(r"(?:^|[\n\t;,|/=\"：:]|\.\s)\s*$", before) and re.match(r"\s*(?:$|[\n\t;,|/\"])", after)) or (not before.strip() or not after.strip())


_CALL, _LIVE, _OUT, _SAYS_ID = re.compile(CALLING, re.I), re.compile(LIVING, re.I), re.compile(RULED_OUT, re.I), re.compile(ANNOUNCE_ID, re.I)
_GIVEN_SET = frozenset(x for g in GIVEN.split() for x in (g.lower(),))


def _first(patterns: list[re.Pattern], text: str, at: int, stop: int) -> tuple[int, int]:
    """The start and negative end of the first, then longest match; -1 if there is none."""
    return min(((m.start(), -m.end()) for p in patterns if (m := p.search(text, at, stop))), default=(-1, 0))


#: What votes on a name by its surroundings: a title, a word that asks for a person, a mail address of the words, borders, numbers or addresses near, words never in small letters, words met again, letters alike.
CONTEXTS = 8
_CONTACT = re.compile(r"@|\d{3}[ .-]\d{2}|\+\d")


def _surroundings(text: str, start: int, end: int, words: list[str]) -> int:
    before, after = _context(text, start, end, 48)
    mail = "@" in before or "@" in after
    near = f"{before}|{after}".lower() if mail else ""
    last = words[-1]
    return _bits(
        bool(_TITLE.search(before)),
        bool(_ASKED.search(before)),
        mail and any(len(w) > 3 and re.search(re.escape(w.lower()[:5]) + r"[\w.+-]*@", near) for w in words),
        _lone(before, after),
        mail or bool(_CONTACT.search(before) or _CONTACT.search(after)),
        not any(f" {w.lower()} " in text for w in words),
        text.count(last) > 1,
        len({w.isupper() for w in words}) == 1 and all(len(w) > 2 for w in words),
    )


def shaped(text: str) -> list[Span]:
    """Spans that look like a name and have no word of the gazetteer: two or three proper words in either order, with initials between, or a Chinese family name in a telling place."""
    out = []
    for m in _SHAPED.finditer(text):
        start, end = m.span()
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@.-") or end < len(text) and (text[end].isalnum() or text[end] in "_@-"):
            continue
        tokens = [(start + x.start(), x[0]) for x in re.finditer(r"\S+", m[0])]
        while tokens and tokens[0][1].lower().rstrip(",") in _LEADS:
            tokens.pop(0)
        while tokens and (tokens[-1][1].lower() in NOT_FAMILY or tokens[-1][1].endswith(".")):
            tokens.pop()
        words = [w.rstrip(",") for _, w in tokens if len(w) > 2 and w[0].isupper()]
        if not 2 <= len(words) <= 3 or any(x.lower() in _GIVEN_SET for w in words for x in w.split("-")) or not all(_PROPER.match(w) for w in words):
            continue
        if tokens[0][1].endswith(",") and len(words) != 2 or any(w.endswith(",") for _, w in tokens[1:]):
            continue
        start, end = tokens[0][0], tokens[-1][0] + len(tokens[-1][1])
        out.append(Span("shape", start, end, 0, _surroundings(text, start, end, words)))
        if len(words) == 3 and len(tokens) == 3:  # the first may only begin the sentence
            start, words = tokens[1][0], words[1:]
            out.append(Span("shape", start, end, 0, _surroundings(text, start, end, words)))
    if "\u4e00" <= max(text, default=""):
        for m in _CHINESE.finditer(text):
            out.append(Span("shape", *m.span("a" if m["a"] else "b"), 0, _bits(not m["a"], bool(m["a"]), False, False, False, True, text.count(m["a"] or m["b"]) > 1, True)))
    return out


def spans(text: str, may: frozenset) -> list[Span]:
    """Candidate spans of the kinds in `may` (address_0 .. for its countries) with the labelers' votes as bits."""
    out: list[Span] = []
    if "email" in may:
        for m in _EMAIL.finditer(text):
            whole = re.sub(_DOT, ".", re.sub(_AT, "@", m[0]))
            local, _, domain = whole.partition("@")
            last = domain.rsplit(".", 1)[-1].lower()
            before, after = _context(text, *m.span())
            out.append(Span("email", *m.span(), _bits(domain.count(".") >= 1, last.isalpha() and len(last) > 1, last not in _FILES.split("|"), len(local) > 1 and any(c.isalpha() for c in local) and not domain[0].isdigit(), len(local) >= 4 and not after.startswith("/"))))
    if "id_number" in may:
        for m in _ID.finditer(text):
            s = m[0]
            before, after = _context(text, *m.span())
            said = [x.end() for x in _SAYS_ID.finditer(before)]
            between = before[said[-1] :] if said else ""
            near = bool(said) and len(between) <= 25 and not re.search(r"[.!?。]\s+[A-Z][a-z]", between)
            shape = bool(re.search(r"[A-Z]", s)) and sum(c.isdigit() for c in s) >= 6 or len(re.sub(r"\D", "", s)) in (15, 17, 18)
            joined = bool(re.search(r"[\d.,/-]\s?\Z", before) and not before.endswith((". ", ", ", ".: "))) or bool(re.match(r"[-/.,]?\d|[-/][A-Za-z]", after))
            out.append(Span("id_number", *m.span(), _bits(near, shape, not joined, not _OUT.search(before), near and len(between) < 14)))
    if "phone" in may:
        for n in _NUMBERISH.finditer(text):
            at = n.start()
            while at < n.end():
                start, end = _first(_PHONE, text, at, n.end())
                broken = _first(_PHONE_BROKEN, text, at, start if start >= 0 else n.end())  # only where no number is whole
                start, end = broken if broken[0] >= 0 else (start, end)
                if start < 0:
                    break
                m, at = text[start:-end], -end
                before, after = _context(text, start, at)
                if re.search(r"(?:[\d+(][ .\-/(]?|[A-Za-z\-.])\Z", before) or re.match(r"[ .\-/]?\d{2}|\d|-[A-Za-z]", after):
                    continue
                digits = len(re.sub(r"\D", "", m))
                full = any(p.fullmatch(m) for p in _PHONE_BROKEN[:8])
                out.append(Span("phone", start, at, _bits(full and 8 <= digits <= 14, m[0] in "+(0" or bool(re.search(r"[ \xa0\n.-]", m)), bool(_CALL.search(before)) or _lone(before, after), not _SAYS_ID.search(before[-24:]), not _OUT.search(before))))
    for i, pattern in enumerate(_ADDRESS):
        if f"address_{i}" not in may:
            continue
        for m in pattern.finditer(text):
            s = m[0].rstrip(" ,")
            cut = max((x.end() for x in re.finditer("寄往|住在|地址(?:是|为)?|位于|送到|送往|寄到|搬到", s)), default=0)
            begin, s = m.start() + cut, s[cut:]
            before, after = _context(text, begin, begin + len(s), 60)
            town = bool(re.search(rf"(?:,|\d{{5}})\s+{_TOWN1}(?:,?\s+{_POST_EN})?$", s)) or i == 4
            post = bool(re.search(rf"\d{{5}}\s+{_TOWN1}$|{_POST_EN}$", s)) or i == 4
            living = bool(_LIVE.search(before)) or _lone(before, after)
            out.append(Span("address", begin, begin + len(s), _bits(True, town, post, living, not re.search(r"\d[.,-]\Z", before))))
    if "name" in may:
        at = 0
        while m := _NAME.search(text, at):
            family = m["f"] or m["f2"]
            first = family.split()[-1].split("-")[0]
            good = first.lower() not in NOT_FAMILY and first.lower() not in _GIVEN_SET
            newline = "\n" in m[0] and bool(re.search(r"\n\s*\n", m[0]))
            before, after = _context(text, *m.span(), 48)
            given = m["g"] or m["g2"]
            cases = given.isupper() == family.split()[-1].isupper()
            meets = bool(_TITLE.search(before) or _MEETING.search(before)) or _lone(before, after) or bool(re.match(r"\s*[(\";,/\t]", after))
            mail = first.lower()[:5] in after.lower() or first.lower()[:5] in before.lower()
            out.append(Span("name", *m.span(), _bits(good, not newline, cases, len(first) >= 4, meets or mail), _surroundings(text, *m.span(), [given.split("-")[0], first])))
            at = m.end() if good else m.start() + max(1, len(given))
    return out + shaped(text) if "shape" in may else out


VOTERS = 5


def expectation(counts: dict[int, int], rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Latent-class EM over vote patterns: the share of true spans and each labeler's rate of votes on true and other spans.

    Priors of ten spans each (right 0.95 on true spans, 0.4 on others) keep rates apart where data are few.
    """
    masks = np.array(sorted(counts), np.int64)
    n = np.array([counts[m] for m in masks], float)
    x = (masks[:, None] >> np.arange(VOTERS)) & 1
    share, yes, no = 0.7, np.full(VOTERS, 0.95), np.full(VOTERS, 0.4)
    for _ in range(rounds):
        p = posterior(x, share, yes, no)
        w, v = n * p, n * (1 - p)
        share = (w.sum() + 7) / (n.sum() + 10)
        yes = (w @ x + 9.5) / (w.sum() + 10)
        no = np.minimum((v @ x + 4) / (v.sum() + 10), yes - 0.05)
        no = np.clip(no, 0.01, 0.9)
    return share, yes, no


#: What is assumed of CONTEXTS beside the data, worth ten spans each: rates at names and at other capitalised words.
_AT_NAMES, _AT_OTHERS = np.array([0.2, 0.3, 0.2, 0.3, 0.3, 0.9, 0.3, 0.9]), np.array([0.01, 0.02, 0.01, 0.4, 0.2, 0.5, 0.4, 0.6])
#: The first of CONTEXTS tell names: they are so many times as frequent there as elsewhere, at least.
TELLING, TIMES = 3, 50


def anchored(known: dict[int, int], counts: dict[int, int], rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """As `expectation` for names that the gazetteer doesn't know: what surrounds names is learned from `known`, those it knows; the rest by EM."""

    def seen(c: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        masks = np.array(sorted(c), np.int64)
        return (masks[:, None] >> np.arange(CONTEXTS)) & 1, np.array([c[m] for m in masks], float)

    kx, kn = seen(known)
    yes = (kn @ kx + 10 * _AT_NAMES) / (kn.sum() + 10) if len(kn) else _AT_NAMES
    yes = np.clip(yes, 0.01, 0.99)
    x, n = seen(counts)
    share, no = 0.1, np.minimum(_AT_OTHERS, yes)
    for _ in range(rounds):
        p = posterior(x, share, yes, no)
        v = n * (1 - p)
        share = ((n * p).sum() + 1) / (n.sum() + 10)
        no = np.clip((v @ x + 10 * _AT_OTHERS) / (v.sum() + 10), 1e-4, 0.99)
        no[:TELLING] = np.minimum(no, yes / TIMES)[:TELLING]
    return share, yes, no


def posterior(x: np.ndarray, share: float, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    a = np.log(share) + (x * np.log(yes) + (1 - x) * np.log(1 - yes)).sum(1)
    b = np.log(1 - share) + (x * np.log(no) + (1 - x) * np.log(1 - no)).sum(1)
    return 1 / (1 + np.exp(np.clip(b - a, -50, 50)))


def classifier(counts: dict[int, int], rounds: int = 400, rates: tuple | None = None) -> dict[int, float]:
    """A logistic span classifier on votes and pairs of votes, trained on the EM's soft labels (or by given `rates`); its probability for every pattern."""
    share, yes, no = rates or expectation(counts)
    voters = len(yes)

    def features(m: np.ndarray) -> np.ndarray:
        x = (m[:, None] >> np.arange(voters)) & 1
        pairs = [x[:, i] * x[:, j] for i in range(voters) for j in range(i)]
        return np.column_stack([np.ones(len(m)), x, *pairs]).astype(float)

    masks = np.array(sorted(counts), np.int64)
    n = np.array([counts[m] for m in masks], float)
    target = posterior((masks[:, None] >> np.arange(voters)) & 1, share, yes, no)
    everything = np.arange(1 << voters)
    prior = posterior((everything[:, None] >> np.arange(voters)) & 1, share, yes, no)
    x, w = np.vstack([features(masks), features(everything)]), np.concatenate([n / n.sum(), np.full(len(everything), 0.2 / len(everything))])
    t = np.concatenate([target, prior])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (w * (t - p)) - 1e-4 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(features(everything) @ beta, -30, 30)))
    return dict(zip(everything.tolist(), p.tolist()))


_GIVEN_MAYBE = r"\b(?:" + "|".join(sorted({n for g in GIVEN.split() for n in (g, g.upper())})) + r")\b"
_MAYBE = {
    "email": r"@|＠|[(\[{]\s?(?:at|AT)\s?[)\]}]|\s(?:dot|DOT)\s",
    "id_number": "|".join(p.replace(" ", r"[ \x{a0}\n]") for p in _IDS),
    "phone": r"\d[\d \x{a0}\n().\-/]{7,22}\d",  # as _NUMBERISH
    **{f"address_{i}": p.replace(r"\s", r"[\s\p{Z}]") for i, p in enumerate(_ADDRESS_MAYBE)},
    "shape": rf"[{_CAPITAL}][\w'’\x{{df}}-\x{{17f}}-]+,?(?: [{_CAPITAL}]\.)* (?:\p{{Ll}}+ ){{0,2}}[{_CAPITAL}]|联系|姓名|作者|签名|经办人|负责人|收件人|寄件人|先生|女士|小姐|老师|经理|主任|博士|教授",
    "name": r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(sorted({n for g in GIVEN.split() for n in (g, g.upper())})) + r")(?:[^\p{L}\p{N}_]|$)",
}


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `kind`, `start`, `stop`, `val`, `votes`, `context` of every candidate span of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            hits = {k: np.asarray(pc.match_substring_regex(texts, pattern=p)) for k, p in _MAYBE.items()}
            some = np.flatnonzero(np.logical_or.reduce(list(hits.values())))
            rows = []
            for i in some:
                t = texts[i].as_py()
                for s in spans(t, frozenset(k for k, h in hits.items() if h[i])):
                    rows.append((i, s.kind, s.start, s.end, re.sub(r"\s+", " ", t[s.start : s.end]), s.votes, s.context))
            if rows:
                at, kind, start, stop, val, votes, context = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(kind), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(val), pa.array(votes, pa.int32()), pa.array(context, pa.int32())], names=["key", "kind", "start", "stop", "val", "votes", "context"])

    schema = f"key {df.schema[key].dataType.simpleString()}, kind string, start int, stop int, val string, votes int, context int"
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


#: Family names with which a given name must be accepted, and the part of its places, to be learned.
FAMILIES, ACCEPTED = 3, 0.5


def _by_shape(rows: DataFrame, known: dict[int, int], counts: dict[int, int], least: float) -> DataFrame:
    """The names among candidates by shape: by their surroundings, or by a given name that others taught."""
    chance = classifier(counts, rates=anchored(known, counts))
    good = [m for m, p in chance.items() if p >= least]
    comma = F.contains("val", F.lit(", "))
    parts = F.split("val", ",? ")
    given = F.when(comma, parts[1]).otherwise(parts[0])
    told = rows.withColumn("given", given).withColumn("family", F.when(comma, parts[0]).otherwise(F.element_at(parts, -1))).withColumn("good", F.col("context").isin(good))
    taught = told.groupBy("given").agg(F.count_distinct(F.when(F.col("good"), F.col("family"))).alias("families"), F.count_if("good").alias("yes"), F.count(F.lit(1)).alias("all"))
    taught = taught.where((F.col("families") >= FAMILIES) & (F.col("yes") >= ACCEPTED * F.col("all"))).select("given", F.lit(True).alias("taught"))
    proper = F.col("context").bitwiseAND(1 << 5 | 1 << 7) == (1 << 5 | 1 << 7)
    both = told.join(taught, "given", "left").where(F.col("good") | (F.col("taught") & proper))
    return both.select("key", F.lit("name").alias("kind"), "start", "stop", "val")


def found(df: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """`key`, `kind`, `start`, `stop`, `val` of the personal information in each text.

    Labelers vote on candidate spans; how often each pattern of votes occurs (at most
    2**VOTERS counts per kind and 2**CONTEXTS for names) goes to the driver, where EM
    estimates the labelers' reliabilities and a classifier is trained on its soft labels.
    Names that the gazetteer doesn't know are candidates by their shape and are judged by
    their surroundings; given names accepted so with three family names or more are
    learned, and then hold in other places, too.  Of overlapping spans the first kind in
    KINDS stays, then the longer one.  Null and empty texts have none, repeated rows give
    repeated spans, an empty table gives none.
    """
    spotted = checkpointed(candidates(df, key, text))
    counts: dict[str, dict[int, int]] = {}
    around: dict[str, dict[int, int]] = {"name": {}, "shape": {}}
    for r in spotted.groupBy("kind", "votes", "context").count().collect():
        if r["kind"] in around and (r["kind"] == "shape" or r["votes"] & 1):
            c = around[r["kind"]]
            c[r["context"]] = c.get(r["context"], 0) + r["count"]
        if r["kind"] != "shape":
            c = counts.setdefault(r["kind"], {})
            c[r["votes"]] = c.get(r["votes"], 0) + r["count"]
    chances = {k: classifier(c) for k, c in counts.items()}
    good = [f"{k}:{m}" for k, c in chances.items() for m, p in c.items() if p >= least]
    order = {k: i for i, k in enumerate(KINDS)}
    kept = spotted.where(F.concat_ws(":", "kind", F.col("votes").cast("string")).isin(good or [""])).select("key", "kind", "start", "stop", "val")
    if around["shape"]:
        kept = kept.unionByName(_by_shape(spotted.where("kind = 'shape'"), around["name"], around["shape"], least))

    @F.pandas_udf("array<boolean>")
    def clear(kinds: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        def one(k, a, b) -> list[bool]:
            out, taken = [False] * len(k), []
            for i in sorted(range(len(k)), key=lambda i: (order[k[i]], a[i] - b[i], a[i])):
                if all(b[i] <= s or e <= a[i] for s, e in taken):
                    out[i] = True
                    taken.append((a[i], b[i]))
            return out

        return pd.Series([one(k, a, b) for k, a, b in zip(kinds, starts, stops)])

    grouped = kept.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "stop", "val")).alias("s"))
    marked = grouped.withColumn("ok", clear(F.col("s.kind"), F.col("s.start"), F.col("s.stop")))
    one = marked.select("key", F.explode(F.arrays_zip("s", "ok")).alias("x")).where("x.ok").select("key", "x.s.*")
    return one.withColumnRenamed("key", key)


def report(df: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """`kind`, `candidates`, `kept`: spans that were proposed, and those left after the classifier and overlaps; names by shape are names."""
    kind = F.when(F.col("kind") == "shape", "name").otherwise(F.col("kind")).alias("kind")
    proposed = candidates(df, key, text).groupBy(kind).agg(F.count(F.lit(1)).alias("candidates"))
    kept = found(df, key, text, least).groupBy("kind").agg(F.count(F.lit(1)).alias("kept"))
    return proposed.join(kept, "kind", "left").select("kind", "candidates", F.coalesce("kept", F.lit(0)).alias("kept"))


def masked(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key` and `masked`: each text (of a unique key) with a typed placeholder in the place of every span."""
    by_doc = found(df, key, text).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias("s"))

    @F.pandas_udf("string")
    def apply(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        def one(t: str, s) -> str:
            if t is None or s is None:
                return t
            out, at = [], 0
            for x in s:
                out += [t[at : x["start"]], PLACEHOLDERS[x["kind"]]]
                at = x["stop"]
            return "".join([*out, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, all_spans)])

    joined = df.select(key, F.col(f"`{text}`").alias("__text")).join(by_doc, key, "left")
    return joined.select(key, F.when(F.col("s").isNull(), F.col("__text")).otherwise(apply("__text", "s")).alias("masked"))
