"""Personal information inside free text (problem 2).

Weak-supervision aggregation. Candidate spans come from loose patterns over the decoded field: any run of capitalised
words may be a name, any group of digits a number. On each span labelers vote for or against or not at all: the shape
of the value, the words before it, the words after it, the markup around it, gazetteers, and signs of something
else. The gazetteer of given names grows from all pages, by how often a word opens a candidate and how often it does so
in a place made for persons. Expectation-maximisation over the counts of all vote patterns estimates per kind how far
each labeler can be trusted; its posteriors train the final span classifier, a logistic regression on votes and
context, which alone decides.
"""

from __future__ import annotations

import re
from base64 import b64decode
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from urllib.parse import unquote_to_bytes
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions.html import entities
from pagelode.session import stored

KINDS = ("email", "phone", "id_number", "address", "name")
LABELERS = ("shape", "before", "after", "markup", "gazetteer", "other")
#: Places made for persons in which a word must open a name to enter the gazetteer of given names, and their least share
#: of all its candidates; candidates from which on a word that none of these places shows is taken for no name.
GAZETTEER_SEEN, GAZETTEER_SHARE, COMMON_SEEN = 3, 0.1, 20
#: Candidates of each kind the span classifier is fitted on, at most.
TRAIN_SPANS = 4_000
#: Features of the classifier: votes per kind and labeler, then hashed context.
HASHED = 1 << 12

# Given names that are common in Europe.
GIVEN = frozenset(
    """adam agnes albert alice amira ana andrea andreas anja anna anouk ansel antonio arthur astrid axel beatriz ben
    bernd bettina birgit bruno carla carlos carmen caroline cecilia charlotte chiara christian claire clara cosmo
    daniel dario david diego dominik edda elena elif elisa emil emma erik eva fatma felix fernando filip francesca
    freya frida george giulia greta gustav hanna hans hedda helena henrik hugo ilka imre ines ingrid irene isabel ivan
    jacob jan jana joao johan johanna john jonas jordi jorge joris jose julia karin karl katarzyna kiran klara klaus
    lars laura lea lena lennart leandro leo lina lotta louis luca lucia luis lukas magnus maja marco maria marie marla
    marta martin mateo matteo max mehmet mia michael milo mira monika nadia nadja natalia nele nicolas nina noor
    odile olga olivia oscar oskar pablo paolo pascale paul pedro peter petra pierre piotr rafael ravi renske robert
    rosa sara saskia selma silvan simon sofia sophie stefan susanne sven tilda tobin theo thomas tomas ulrike ursula
    vera victor wanda werner wiktor ximena yara yusuf zofia""".split()
)

# Labels and cues around values, in the languages of the corpus.
PHONE_CUE = re.compile(r"(?:\btel[ée]?(?:f(?:on[oe]?|oon(?:nummer)?))?\b\.?|\bt[ée]l[ée]phone\b|\btel[eé]fono\b|\bphone\b|\bfax\b|\bmobile?\b|\bcell\b|\bcall\b|\bhandy\b|\bgsm\b|\bwhatsapp\b|\bnumber\b|\bjoignable\b|\bau\b|\bbereikbaar\b|\berreichbar\b|\bunter\b|\btelefonicznie\b|\bkomórk\w+|\btelefonu?\b|\bringen?\b|\bтел\w*|電話)[^\w\d]{0,12}(?:\w{1,9}[\s:]{1,2}){0,2}$", re.I)
PHONE_AFTER = re.compile(r"^\W{0,3}(?:erreichbar|\(?(?:fax|mobile?|home|work|office)\b|ext\.?\s*\d)", re.I)
OTHER_CUE = re.compile(r"(?:\b(?:part|order|item|lot|ean|isbn|invoice|ticket|serial|tracking|sku|ref(?:erence|\.)?|build|version|ratio|size|total|claim|parcel|sendung|colis|paquete|pacco|rating|code|updated|article|artikel|model|gate|route|batch|account|iban|customer|case|docket|receipt|bestell\w*|pedido|commande|ordine|zam[oó]wieni\w*)\b\s*(?:n[or]\.?|n[º°]\.?|number|nr\.?|#|code)?|#|[€$£])[^\w.!?]{0,3}$", re.I)
ID_LABEL = re.compile(
    r"""(?:\bSSN\b|\bsocial[\s-]+security(?:[\s-]+(?:number|no\.?))?|\bnational[\s-]+insurance(?:[\s-]+(?:number|no\.?))?|\bNI[\s-]+(?:number|no\.?)|\bNINO\b
    |\bpassport(?:[\s-]+(?:number|no\.?|n[º°]))?|\bpasseport(?:\s*n[º°]\.?)?|\bpasaporte(?:\s*n[º°.]*)?|\bpassaporto?(?:\s*n[º°.]*)?|\breisepass\w*|\bpass(?:nummer|nr\.?)|\bpaspoort\w*|\bpaszport\w*|\bpasaport\w*|\bпаспорт\w*|パスポート(?:番号)?
    |\bPESEL\b|\bcodice\s+fiscale\b|\bDNI(?:/NIF)?\b|\bNIF\b|\bNIE\b|\bCPF\b|\bBSN\b|\bburgerservicenummer\b|\bpersonnummer\b|\bTC\s+kimlik\b|\bkimlik\b|\bСНИЛС\b|\bИНН\b|マイナンバー|個人番号
    |\bsteuer[\s-]*(?:id(?:entifikationsnummer)?|nummer|nr\.?)|\bIdNr\.?|\bsozialversicherungs\w*|\bausweis(?:nummer|nr\.?|\s+nr\.?)|\bpersonalausweis\w*
    |\bn[º°o]\.?\s*de\s+s[ée]curit[ée]\s+sociale|\bNIR\b|\bn(?:um[ée]ro)?[º°o]?\.?\s*fiscal|\bcarte\s+d['’]identit[ée](?:\s*n[º°.]*)?
    |\bnational\s+id(?:entity)?(?:\s+(?:number|no\.?|card))?|\bidentity\s+card(?:\s+(?:number|no\.?))?|\bID\s+card(?:\s+(?:number|no\.?))?|\btax(?:payer)?[\s-]*(?:id(?:entification)?(?:\s+number)?|number|no\.?|reference)|\bTIN\b|\bITIN\b
    |\bcarta\s+d['’]identit[àa](?:\s*n[º°.]*)?|\bdocumento(?:\s+de\s+identi\w+)?(?:\s*n[º°.]*)?|\bdow[oó]d\s+osobisty\w*|\bid[_-]?(?:number|card)\b)""",
    re.I | re.X,
)
ID_GAP = re.compile(r"(?:[\s:=#.\-–(\"]|</?(?:td|th|dt|dd|b|strong|span)[^>]*>|n[º°o]\.?|number|nr\.?){0,8}", re.I)
ID_CANDIDATE = re.compile(r"\d(?:[ .\-/]?[\dA-Z]){3,22}(?![\w@]|[.\-/]\d)")
ID_PREFIX = re.compile(r"(?<![\w@#+.\-/])(?:(?!(?:ID|NI|NR|NO) )[A-Z]{1,2} ?|[A-Z]{6})$")
ID_KEY = re.compile(r"[?&\"'](?:ssn|nin|pesel|dni|nif|passport|taxid|tax_id|national_id)[\"']?\s*[=:]\s*[\"']?$", re.I)
# How the words of identity labels begin, at most five letters; only such a word makes a label worth reading.
ID_STEMS = frozenset(
    """ssn socia secur insur ni nino passp passe pasap passa reise passn pass paspo paszp паспо pesel codic fisca dni nif nie cpf bsn
    burge perso kimli снилс инн steue idnr sozia auswe sécur nir ident natio card tax taxpa tin itin carta carte docum
    dowód osobi id""".split()
)
ID_SHAPE = re.compile(
    r"(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z]|\d{2}\.?\d{3}\.?\d{3}-?[A-Z]|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{2} \d{3} \d{3} \d{3}|\d{3}-\d{6}-\d{2}|[A-Z]\d{8}|[A-Z]\d{3}[A-Z]\d{4}|\d{11})"
)
ADDRESS_CUE = re.compile(r"(?:\baddress\b|\badress\w*|\bdirecci[oó]n\b|\bindirizzo\b|\bendere[cç]o\b|\bmorada\b|\badres\w*|\bto|\bfrom|\bat|\bin|\blives?\s+(?:at|in)|\ban|\bvers|\bà|\ben|\bem|\bnaar|\bwohnhaft|\bhabite\s+au|住所|адрес\w*|\btill|\bdo|\bvia)\W*$", re.I)
ADDRESS_TAG = re.compile(r"<(?:address|td|dd)[^>]*>\s*$|\"(?:streetAddress|address|street)\"\s*:\s*\"$", re.I)
POSTAL = re.compile(r"^\W{0,4}(?:\d[ºª°]\s?[A-Z]\W{1,4})?(?:[A-Z][\w'\-]+(?:[ \-][A-Z][\w'\-]+)?\W{1,4})?(?:[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}|[A-Z]{2}[ \n]\d{4,5}|\d{4,5}(?: [A-Z]{2})? [A-Z]|[A-Z][\w'\-]+(?:[.<,\n]| [a-z]))")
NAME_CUE = re.compile(
    r"""(?:\bask\s+for|\breach|\bsa(?:ys|id)|\bdear|\bsigned|\bholder|\bname|\bcontact|\bauthor|\bby|\battn\.?|\battention|\bowner|\bcustomer|\bregards|\bsincerely|\bfor|\bfrom|\bwith
    |\btitular|\bnombre|\bnom|\bnome|\bnaam|\breferente|\binterlocut\w+|\bansprech(?:person|partner(?:in)?)|\bcontactpersoon|\bcontacto|\bkontaktperson\w*|\bopiekun\w*|\basesora?
    |\bf[üu]r|\bvon|\bpara|\bpor|\bper|\bpar|\bda|\bde|\bvoor|\bdla|\btill|\bliebe[r]?|\bestimad[oa]|\bcher|\bch[èe]re|\bbeste|\bgentile|\bуважаем\w+|様)(?:\s+(?:is|ist|est|es|è|é|är|jest|to|a))?\W*$""",
    re.I | re.X,
)
NAME_MARKUP = re.compile(r"(?:\"name\"\s*:\s*\"|name=\"author\"\s+content=\"|[?&](?:name|fullname|user_?name|contact)=|/(?:profile|team|author|people|staff|member|user|about)/)$", re.I)
#: Places that are made for persons, from which the gazetteer grows.
PERSON = re.compile(r"(?:\"name\"\s*:\s*\"|name=\"author\"\s+content=\"|[?&](?:fullname|user_?name|contact)=|/(?:profile|team|author|people|staff)/)$", re.I)
NAME_AFTER = re.compile(r"^,?\s+(?:on\s+behalf|was\s+born|at\s+\S+@|\(\d\d\)|and\s+I\b)", re.I)
#: Markup of headings and controls; letters of names.
NAME_FRAME = re.compile(r"<(?:title|h[1-6]|button|option|label|a)\b[^>]*>\s*$", re.I)
NAME_LIKE = re.compile(r"(?:[^\W\d_]|[\s.'’\-,])+")
#: An attribute's value or a path before the place.
IN_LINK = re.compile(r"(?:src|href|id|class|data-\w+)=[\"'][^\"'<>\s]*$", re.I)
# Words of paths that look like two-part names.
NOT_NAMES = frozenset("hair shop store gmbh restaurant sale summer guide user settings profile content wp sign in up order cart help about contact us home page new old my your best top web app team news".split())
NAME_OTHER = re.compile(r"(?:\bstorm|\bmodel|\bhurricane|\bcyclone|\btaif?un|\btempête|\btormenta|\btempesta|\bstreet|\blane|\broute)\W{1,3}$", re.I)
NAME_OTHER_AFTER = re.compile(r"^\s*(?:Ltd|GmbH|Inc|LLC|SA|AG|BV|Collection|Group|Bank|Cloud|Express|Insurance|Wallet|Telecom|Mail|Games|Credit|Stream|Parcel|Market|Post|Pay|Air|Office|Street|Lane|Road|Avenue|Drive|Close|Hill|Court|Row)\b|^\s*(?:day\s+)?\d")
TITLED = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Sr|Sra|Sig|Sig\.ra|Mme|Mlle|Monsieur|Madame|Dhr|Mevr|Pan|Pani)\.?"
UPPER = "A-ZÀ-ÖØ-Þ" + "".join(filter(str.isupper, map(chr, range(0x100, 0x180))))
CAP = rf"[{UPPER}][\w'’]*[^\W\d_]"
SEQUENCE = re.compile(rf"(?<!\w)(?:Sig\.ra\b|[{UPPER}][\w'’\-]*)\.?(?:,?\s+(?:Sig\.ra\b|[{UPPER}][\w'’\-]*)\.?)+")
PIECE = re.compile(rf"(?<!\w)(?:Sig\.ra\b|{CAP}(?:-{CAP})*|[{UPPER}])\.?")
WORDS = re.compile(r"[^\W\d_]+")
#: What context is made of: words and the beginnings of tags.
NEAR = re.compile(r"[^\W\d_]+|</?\w+")
SLUG = re.compile(r"[/?&](?:(?:(?<=/)(?:profile|team|author|people|staff|member|user|contact|in)/|(?<!/)(?:name|fullname|contact|user)=))(?P<n>[A-Za-zÀ-ž]{2,}(?:[\-+ _.][A-Za-zÀ-ž]{1,}\.?){1,3})(?=[/?&#\"'<\s]|$)")
DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}(?![\w\-]|\.[A-Za-z])")
DISGUISES = ("(at)", "[at]", "{at}", "<at>", "_at_", "( at )", "[ at ]", "(@)", "[@]", "(a)", " dot ", "[dot]", "(dot)")
DISGUISED = re.compile(r"(?<![\w.+\-])[A-Za-z0-9](?:[\w.+\-]*\w)?\s?(?:\(\s?(?:at|a|@)\s?\)|\[\s?(?:at|@)\s?\]|\{\s?(?:at|@)\s?\}|<at>|\s(?P<w>at)\s|_at_)\s?[A-Za-z0-9][A-Za-z0-9\-]*(?:\s?(?:\(\s?dot\s?\)|\[\s?dot\s?\]|\{\s?dot\s?\}|<dot>|(?P<d>\sdot\s)|_dot_|\.)\s?[A-Za-z0-9\-]*[A-Za-z])+", re.I)
MAIL_CUE = re.compile(r"(?:mail|correo|write to|reach|contact|\bat|\ban|à|\bto|\band|oder|\bor|:)\W*$", re.I)
PATH_NAME = re.compile(r"/(?P<n>[A-Za-zÀ-ž]{2,}[\-_][A-Za-zÀ-ž]{2,}(?:[\-_][A-Za-zÀ-ž]+)?)(?=[/?#\"'\s]|$)")
# Top-level domains in wide use and the reserved ones; all of two letters are countries.
DOMAINS = frozenset("com org net info biz edu gov mil int eu app dev shop online site store club xyz name mobi test example invalid localhost".split())
FILES = frozenset("png jpg jpeg gif svg webp ico css js json html htm php pdf zip gz mp4 woff woff2 ttf map xml txt".split())
PHONE = re.compile(r"[+(\d][\d  ()./\-]{5,22}\d(?![\w@]|[.\-/]\d|%)")
PHONE_SHAPES = re.compile(
    r"^(?:\+\d{1,3}[ .\-]?(?:\(?\d{1,4}\)?[ .\-/]?){2,6}\d+|00[1-9]\d{0,2}[ .\-/]?(?:\d{1,5}[ .\-/]?){2,5}\d+|\(\d{3}\) ?\d{3}[\-. ]\d{4}|\d{3}([\-.])\d{3}\1\d{4}|0\d(?:([ .\-])\d\d)(?:\2\d\d){3}|\(0\d{1,4}\) ?\d{3,4}[ \-]?\d{3,4}|0\d{1,4} ?/ ?\d{3,6}[ \-]?\d{1,6}|0\d{2,4}[ \-]\d{3,4}[ \-]\d{3,4})$"
)
NOT_PHONE = re.compile(r"^(?:\d{1,2}[./\-]\d{1,2}[./\-](?:19|20)\d\d.*|(?:19|20)\d\d-\d\d-\d\d.*|(?:\d{1,3} )?\d{1,3}(?:\.\d{1,3}){3}(?:[/ ].*)?|\d{3}-\d{2}-\d{4}|\d{4}-\d{3,5}|\d{2} \d{3} \d{3} \d{3}|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{1,4}(?: ?[xX×] ?\d{1,4})+|\d{1,3}(?:[.,]\d{3})+(?:[.,]\d\d)?|\d{2}\.\d{3}\.\d{3}|\d{3}-\d{6}-\d{2})$")
PHONE_LINK = re.compile(r"(?i)(?:tel:|callto:|sms:|[?&\"'](?:tel|phone|mobile|fax|whatsapp|telephone)[\"']?\s*[=:]\s*[\"']?)$")
PLACE_OTHER = re.compile(r"(?i)(?:gate|pool|route|size|model|room|level|platform|version|lot)\s*$")
STYLE = re.compile(r"<style\b[^>]*>.*?(?:</style\s*>|$)", re.I | re.S)
CODED = re.compile("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});|\\\\u[0-9a-fA-F]{4}|%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})*|[\u200b-\u200f\u00ad\u2060\ufeff]|<(?:[bB][rR]\\s*/?|/?(?:[biuBIU]|em|EM|strong|STRONG|span|SPAN|wbr|WBR|mark|small))>")

_STREET_EN = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Crescent|Court|Ct|Row|Hill|Way|Place|Pl|Square|Terrace|Gardens|Grove|Park|Boulevard|Blvd|Highway|Walk|Mews|Parade|Quay|Rise|View|Green|Alley|Circle|Parkway|Trail"
FLAT = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit|Suite|FLAT|APT|UNIT)\s*\d+\s?[A-Za-z]?\s*[,\n]\s*$")
#: Where an address that begins with its house number may go on.
NUMBER_FIRST = re.compile(r"\d\s?[A-Za-z]{0,6},?\s+[A-ZÀ-Žrabcipqs]")
#: Where a house number may end an address that begins with its street.
HOUSE_NUMBER = re.compile(r"\d{1,5}\s?[A-Za-z]?(?![\w.])")
ADDRESS_BY_NUMBER = re.compile(
    rf"""(?:
    \d{{1,5}}\s?[A-Za-z]?,?\s+(?:[NSEW]\.?\s+)?(?:[A-ZÀ-Ž][\w'’.\-]*\s+){{1,4}}?(?:{_STREET_EN}|{_STREET_EN.upper()})\b
    |\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s+(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Bb]d|[Cc]hemin|[Aa]llée|[Pp]lace|[Ii]mpasse|[Qq]uai|[Rr]oute|[Cc]ours|[Pp]assage|[Ss]entier|RUE|AVENUE|CHEMIN|ALLÉE)\s+(?:(?:de\s+la|de\s+l['’]|des|du|de|d['’]|DES|DU|DE(?:\s+LA)?)\s*)?[A-ZÀ-Ž][\w'’\-]*(?:\s+[A-ZÀ-Ž][\w'’\-]*)?
    )""",
    re.X,
)
ADDRESS_BY_STREET = re.compile(
    rf"""(?<![\w.,\-/#])(?:
    (?:(?:Calle|CALLE|Avda\.?|AVDA\.?|Avenida|AVENIDA|Plaza|PLAZA|Paseo|PASEO|Camino|Ronda|Via|VIA|Viale|VIALE|Corso|CORSO|Piazza|PIAZZA|Vicolo|Largo|Rua|RUA|Travessa|Praça|ul\.|UL\.|al\.|ulica|Rue|ул\.|улица|проспект)|C/)\s*(?:[\w'’.\-]+\s+){{0,4}}?[A-ZÀ-ŽА-Я][\w'’.\-]*,?\s*(?:n[º°.]\s*|№\s*|д\.\s*)?\d{{1,5}}\s?[A-Za-z]?(?![\w.])
    |(?:Am|An\s+der|An\s+den|Im|Zum|Zur|Auf\s+dem|Auf\s+der|In\s+der|Unter\s+den|Hinter\s+der|Alte|Alter|Neue|AM|IM|ZUM|ZUR)\s+[A-ZÄÖÜ][\wäöüß\-]+(?:\s+[A-ZÄÖÜ][\wäöüß\-]+)?\s+\d{{1,4}}\s?[a-zA-Z]?(?![\w.])
    |[A-ZÄÖÜÅ][\wäöüßåé\-]*(?:straße|strasse|str\.|STRASSE|STRAßE|gasse|platz|allee|damm|ufer|chaussee|weg|WEG|laan|straat|plein|gracht|kade|gatan|vägen|gränd)\s+\d{{1,4}}\s?[a-zA-Z]?(?![\w.])
    |[A-ZÇĞİÖŞÜ][\wçğıöşü]+\s+(?:Sokak|Sokağı|Sok\.|Caddesi|Cad\.|Bulvarı)\s*(?:No\.?:?\s*)?\d{{1,4}}(?![\w.])
    )""",
    re.X,
)
ADDRESS_TAIL = re.compile(r"(?:\s*[,\n]\s*|\s+)(?:\d{1,2}[ºª°]\s?[A-Z](?:\s*[,\n]\s*))?(?:(?:[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}|\d{4,5} [A-Z][\w'\-]+|[A-Z]{2} \d{4,5}|[A-Z][\w'\-]+(?: [A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2})?)(?:\s*[,\n]\s*|(?=\W|$))){1,3}")


def _words_before(text: str, a: int, n: int) -> int:
    """A place before `a` with at least `n` words in between, or the start of the text."""
    size = 32
    while a > size and len(text[a - size : a].split()) <= n:
        size *= 2
    return max(0, a - size)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of streets with house numbers, whichever comes first, each from its flat on."""
    at = 0
    for begin in NUMBER_FIRST.finditer(text):
        a = begin.start()
        while a and text[a - 1].isdigit():
            a -= 1
        if a < at or a and (text[a - 1].isalnum() or text[a - 1] in "_.,-/#") or not (m := ADDRESS_BY_NUMBER.match(text, a)):
            continue
        at = m.end()
        flat = FLAT.search(text, _words_before(text, a, 4), a)
        yield flat.start() if flat else a, m.end()
    done = 0
    for m in HOUSE_NUMBER.finditer(text):
        stop = m.start()
        if stop < done or not stop or not ((c := text[stop - 1]).isalnum() or c.isspace() or c in "_,:.º°№'’-"):
            continue
        last = text[_words_before(text, stop, 1) : stop].split()
        if last and last[-1].islower() and last[-1][-1] not in ".:º°":
            continue  # only a capitalised word or a sign for numbers stands before the house number of a street
        a, size = max(done, stop - 72), 72
        words = text[a:stop].split()
        while a > done and len(words) < STREET_WORDS and not OUTSIDE_STREET.search(text, a, stop):
            size *= 2
            a = max(done, stop - size)
            words = text[a:stop].split()
        window = " ".join(words)
        if window.endswith(STREET_ENDS) or any(map(f"{window} ".__contains__, STREET_SIGNS)):
            at = a
            while found := ADDRESS_BY_STREET.search(text, at, m.end()):
                found = ADDRESS_BY_STREET.match(text, found.start())  # its number may go on
                at = done = found.end()
                yield found.span()


# What every address that begins with its street contains, white space as one blank, or ends with before its number.
STREET_SIGNS = tuple("Calle|CALLE|C/|Av|AV|Plaza|PLAZA|Paseo|PASEO|Camino|Ronda|Via|VIA|Corso|CORSO|Piazza|PIAZZA|Vicolo|Largo|Rua|RUA|Travessa|Praça|ul.|UL.|al.|ulica|Rue|ул|проспект|Am |An de|Im |Zu|ZU|Auf de|In der |Unter den |Hinter der |Alte|Neue |AM |IM |Sok|Cad|Bulvar".split("|"))
STREET_ENDS = tuple("straße strasse str. STRASSE STRAßE gasse platz allee damm ufer chaussee weg WEG laan straat plein gracht kade gatan vägen gränd".split())
#: Words that stand before the house number of such an address, at most and with a broken one; characters that none has.
STREET_WORDS = 10
OUTSIDE_STREET = re.compile(r"[^\w\s'’.,\-/:º°№]")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


class Decoded:
    """A field with its coded characters decoded and breaks and bare inline tags resolved; knows where each came from."""

    def __init__(self, raw: str, is_html: bool):
        text = STYLE.sub(lambda m: " " * len(m[0]), raw) if is_html else raw
        pieces, self.at, self.shift, self.made, last, n = [], [0], [0], [0], 0, 0
        for m in CODED.finditer(text):
            t, a, b = m[0], m.start(), m.end()
            first = t[0]
            if first == "<":
                new = "\n" if t[2:3] in "rR" else ""
            elif first == "&":
                new = entities.unescape(t)
                if new == t:
                    continue
            elif first == "%":
                new = unquote_to_bytes(t).decode("utf-8", "replace")
            elif first == "\\":
                new = chr(int(t[2:], 16))
            else:
                new = ""
            pieces += (text[last:a], new)
            n += a - last + len(new)
            last = b
            self.at.append(n)
            self.shift.append(b - n)
            self.made.append(len(new))
        pieces.append(text[last:])
        self.text = "".join(pieces)

    def start(self, p: int) -> int:
        """Place in the raw field of the character at `p` of the decoded text."""
        return p + self.shift[bisect_right(self.at, p) - 1]

    def stop(self, p: int) -> int:
        """Place in the raw field right after the character before `p`, without tags that follow it."""
        j = bisect_left(self.at, p, 1)
        if j < len(self.at) and self.at[j] == p and self.made[j]:
            return p + self.shift[j]
        return p + self.shift[bisect_right(self.at, p - 1) - 1]


def _digits(s: str) -> int:
    return sum(map(str.isdigit, s))


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes and not no else -1 if no and not yes else 0


def _sign(other: bool) -> int:
    """Vote of the labeler that looks for signs of something else: it always votes."""
    return -1 if other else 1


Candidate = tuple[int, int, int, list[int], str | None, bool, list[int]]


def _local_start(text: str, at: int) -> int:
    """Where the mailbox before the sign at `at` begins, or `at` if there is none."""
    a = at
    while a and (text[a - 1].isalnum() or text[a - 1] in "_.+-"):
        a -= 1
    while a < at and not (text[a].isascii() and text[a].isalnum()):
        a += 1
    return a if a < at and (text[at - 1].isalnum() or text[at - 1] == "_") else at


def _lead(text: str, a: int) -> tuple[str, str]:
    """What stands before `a`: the words, without the tags and blanks right before it, and those tags."""
    end = a
    while end:
        c = text[end - 1]
        if c.isspace():
            end -= 1
        elif c == ">" and (found := text.rfind("<", 0, end)) >= 0:
            end = found
        else:
            break
    return text[max(0, end - 64) : end], text[end:a]


TOKEN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
MAILBOX = re.compile(r"[\w.+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", re.A)


def coded_mailbox(token: str) -> str | None:
    """The e-mail address that a token spells in base 64, in hexadecimal digits or in those masked by their first byte."""
    plain = token.rstrip("=")
    tries = []
    if len(plain) % 2 == 0 and set(plain) <= set("0123456789abcdefABCDEF"):
        raw = bytes.fromhex(plain)
        tries += [raw, bytes(c ^ raw[0] for c in raw[1:])]
    if len(plain) % 4 != 1:
        try:
            tries.append(b64decode(plain.replace("-", "+").replace("_", "/") + "=" * (-len(plain) % 4), validate=True))
        except ValueError:
            pass
    return next((t.decode() for t in tries if t.isascii() and b"@" in t and MAILBOX.fullmatch(t.decode())), None)


class Places:
    """Spans that do not overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.stops, a)
        return i == len(self.starts) or self.starts[i] >= b

    def take(self, a: int, b: int) -> None:
        if self.free(a, b):
            insort(self.starts, a)
            insort(self.stops, b)


def candidates(raw: str, is_html: bool) -> list[Candidate]:
    """`(kind, start, stop, votes, opening word of a name, in a place for persons, context)` of every possible place.

    Positions are those of the raw field; spans may overlap. Votes are in the order of LABELERS; the gazetteer's vote on
    names that are not among the listed ones is cast later.
    """
    if not raw or raw.isspace():
        return []
    decoded = Decoded(raw, is_html)
    text = decoded.text
    out: list[Candidate] = []
    taken = Places()

    def add(kind: str, a: int, b: int, votes: tuple[int, ...], shape: str, given: str | None = None, person: bool = False) -> None:
        before, after = NEAR.findall(text[max(0, a - 24) : a].lower())[-2:], NEAR.findall(text[b : b + 24].lower())[:1]
        told = [f"{kind}|s|{shape}", *(f"{kind}|b|{w}" for w in before), *(f"{kind}|a|{w}" for w in after)]
        out.append((KINDS.index(kind), decoded.start(a), decoded.stop(b), list(votes), given, person, [crc32(c.encode("utf-8", "surrogatepass")) % HASHED for c in told]))

    at = text.find("@")
    while at >= 0:
        a, host = _local_start(text, at), DOMAIN.match(text, at + 1)
        if a < at and host:
            b = host.end()
            tld = host[0].rpartition(".")[2].lower()
            lead, tags = _lead(text, a)
            linked = "mailto:" in text[max(0, a - 24) : a]
            add("email", a, b, (_vote(tld not in FILES, tld in FILES), _vote(bool(MAIL_CUE.search(lead))), 0, _vote(linked or bool(tags.strip()), not linked and IN_LINK.search(lead) is not None), _vote(tld in DOMAINS or len(tld) == 2 and tld not in FILES, tld in FILES), _sign(tld in FILES)), tld[:6])
            if tld not in FILES:
                taken.take(a, b)
        at = text.find("@", at + 1)
    low = text.lower()
    if any(map(low.__contains__, DISGUISES)):
        at = 0
        while m := DISGUISED.search(text, at):
            at = m.end()
            if m["w"] is not None and m["d"] is None:
                at = m.end("w")  # the word "at"; an address may follow
                continue
            tld = re.split(r"\W+", m[0].lower())[-1]
            add("email", m.start(), m.end(), (_vote(True), _vote(bool(MAIL_CUE.search(_lead(text, m.start())[0]))), 0, 0, _vote(tld in DOMAINS or len(tld) == 2), _sign(False)), "disguised")
            taken.take(m.start(), m.end())

    for m in TOKEN.finditer(text):
        a, b = m.span()
        if a and text[a - 1].isalnum() or m[0].islower() and m[0].isalpha() or not taken.free(a, b):
            continue
        if told := coded_mailbox(m[0]):
            tld = told.rpartition(".")[2].lower()
            add("email", a, b, (_vote(True), _vote("mail" in text[max(0, a - 16) : a].lower()), 0, 0, _vote(tld in DOMAINS or len(tld) == 2), _sign(tld in FILES)), "coded")
            taken.take(a, b)

    for m in ID_CANDIDATE.finditer(text):
        a, b = m.start(), m.end()
        if a and (text[a - 1].isalpha() or text[a - 1] == " "):
            prefix = ID_PREFIX.search(text, max(0, a - 7), a)
            a = prefix.start() if prefix else a
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@#+.-/"):
            continue
        value = text[a:b]
        if _digits(value) < 5 or not taken.free(a, b):
            continue
        end = a
        while end:
            c = text[end - 1]
            if c.isspace() or c in ":=#.-–(\"":
                end -= 1
            elif c == ">" and (found := text.rfind("<", 0, end)) >= 0:
                end = found
            else:
                break
        before = text[max(0, end - 80) : end]
        labelled = False
        if any(w[:5] in ID_STEMS for w in WORDS.findall(before.lower())[-6:]) or not before.isascii():
            for label in ID_LABEL.finditer(before):
                labelled = ID_GAP.fullmatch(before, label.end()) is not None
        shape = ID_SHAPE.match(value)
        if shape and (shape.end() == len(value) or value[shape.end()] == " "):
            b = a + shape.end()  # what follows the number is the next sentence
        else:
            shape = None
            b -= len(value) - len(re.sub(r" [A-Z]$", "", value))
        lead = text[max(0, a - 64) : a]
        key = ID_KEY.search(lead) is not None
        if not (labelled or key or shape):
            continue
        other, phone = OTHER_CUE.search(lead) is not None, lead.endswith("tel:") or PHONE_CUE.search(lead) is not None
        plain = text[a:b].isdigit()
        add("id_number", a, b, (_vote(shape is not None and not plain, shape is None), _vote(labelled, other or phone), 0, _vote(key, IN_LINK.search(lead) is not None), 0, _sign(not labelled and not key and (other or phone))), re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text[a:b]))[:18])

    at = 0
    while m := PHONE.search(text, at):
        a, b = m.span()
        if a and ((c := text[a - 1]).isalnum() or c in "_@#%.-/+$€£,") or text[a] == "(" and not text[a + 1].isdigit():
            at = a + 1
            continue
        at = b
        value = m[0].strip()
        n = _digits(value)
        if not 7 <= n <= 15 or not taken.free(a, b):
            continue
        if value.count("(") != value.count(")"):
            if value.startswith("(") and ")" not in value:
                a, value = a + 1, value[1:]
            else:
                continue
        lead, tags = _lead(text, a)
        shaped, wrong = bool(PHONE_SHAPES.match(value)), bool(NOT_PHONE.match(value))
        link = PHONE_LINK.search(text, max(0, a - 40), a) is not None
        cue = PHONE_CUE.search(lead) is not None
        if value.isdigit() and not (link or cue):
            continue  # bare runs of digits without any sign of a telephone
        other = OTHER_CUE.search(lead) is not None
        add("phone", a, b, (_vote(shaped and not wrong, wrong or not shaped and not link), _vote(cue and not other, other), _vote(bool(PHONE_AFTER.match(text[b : b + 24]))), _vote(link or 'class="tel"' in tags, not link and IN_LINK.search(lead) is not None), _vote(value[0] in "+(0" and not wrong), _sign(other or wrong)), re.sub(r"\d+", "9", value)[:16])

    for a, b in _addresses(text):
        if not taken.free(a, b):
            continue
        lead, tags = _lead(text, a)
        tail = ADDRESS_TAIL.match(text, b)
        stop = b + (len(tail[0].rstrip(" ,\n")) if tail else 0)
        other = PLACE_OTHER.search(lead) is not None
        add("address", a, stop, (_vote(True), _vote(ADDRESS_CUE.search(lead) is not None and not other, other), _vote(POSTAL.match(text[b : b + 40]) is not None), _vote(ADDRESS_TAG.search(text, max(0, a - 24), a) is not None or bool(tags.strip())), 0, _sign(other)), re.sub(r"\d+", "9", text[a:b].split()[-1])[:10].lower())
        taken.take(a, stop)

    for pattern, told in ((SLUG, True), (PATH_NAME, False)):
        for m in pattern.finditer(text):
            a, b = m.span("n")
            if not told and (a < 2 or text[a - 2] in "/<"):
                continue
            parts = re.split(r"[\-+ _.]+", m["n"].lower())
            if not 2 <= len(parts) <= 3 or not NOT_NAMES.isdisjoint(parts) or not taken.free(a, b):
                continue
            person = PERSON.search(text, max(0, a - 24), a) is not None
            add("name", a, b, (0, 0, 0, _vote(told and (person or "=" in m[0]), not told and not person), _vote(parts[0] in GIVEN), _sign(False)), "slug" if told else "path", parts[0], person)
    if is_html:
        _names(text, taken, add)
    return out


# Forms of address, and words that end the names of companies.
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Sr Sra Sig Sig.ra Mme Mlle Monsieur Madame Dhr Mevr Pan Pani".split())
COMPANY = frozenset("ltd gmbh inc group collection bank cloud express insurance wallet telecom games credit stream parcel market post pay air office mail shop store online".split())
# Words of closed classes and of greetings that open sentences, in the languages of the corpus; no name has one.
CLOSED = frozenset(
    """a an the this that these those our your my his her their its we you he she it they i in on at by for from to with of and or but if when as is are was were be please note dear hello hi all every each no not new how what why where who
    der die das den dem des ein eine einen einem einer eines unser unsere ihr ihre mein meine wir sie er es und oder aber wenn als im am an auf aus bei mit nach von vor zu zum zur für in liebe lieber sehr hallo guten gut neu alle jede jeder
    le la les l un une des du de d au aux nos notre votre vos mon ma mes son sa ses nous vous il elle ils elles et ou mais si dans par pour sur avec chez bonjour cher chère tous toutes chaque
    el los las una unos unas del al y o pero si en con por para su sus nuestro nuestra mi tu yo hola estimado estimada cada todo todos
    il lo gli i uno dello della dei degli delle e ma se nel nella con per su suo sua nostro nostra ciao gentile ogni
    os as um uma do da dos das no na e mas se em com por para seu sua nosso nossa olá cada
    het een van voor en maar als met naar bij op onze ons uw wij jullie hallo beste geachte elke
    i w z na do od po przy dla nasz nasza twój pan pani witaj każdy
    och men om i på av för med till vår våra din hej varje
    ve ile bir bu için sayın merhaba her""".split()
)


def _names(text: str, taken: Places, add) -> None:
    """Candidates for names of persons: any two capitalised words that follow each other, or a title with a surname."""
    for run in SEQUENCE.finditer(text):
        pieces = [m for m in PIECE.finditer(text, run.start(), run.end())]
        if len(pieces) < 2:
            continue
        words = [m[0] for m in pieces]
        plain = [w.rstrip(".").lower() for w in words]
        fit = [words[i][-1] == "." if len(w) == 1 else w not in CLOSED for i, w in enumerate(plain)]
        for i in range(len(words) - 1):
            if not fit[i + 1] or not (fit[i] or words[i].rstrip(".") in TITLES):
                continue
            gap = text[pieces[i].end() : pieces[i + 1].start()]
            title = words[i].rstrip(".") in TITLES
            if title:
                j = i + 1
                if j + 1 < len(words) and fit[j + 1] and text[pieces[j].end() : pieces[j + 1].start()].isspace() and (words[j][-1] == "." or plain[j] in GIVEN):
                    j += 1  # a given name or an initial before the surname
                if gap.strip() in ("", ".") and len(plain[j]) > 1:
                    _name(text, pieces[i + 1].start(), pieces[j].end(), "title", None, plain[j], taken, add)
            elif gap.strip() == ",":
                if plain[i + 1] in GIVEN and len(plain[i]) > 1:
                    _name(text, pieces[i].start(), pieces[i + 1].end(), "swapped", plain[i + 1], plain[i], taken, add)
            elif gap.isspace() and words[i][-1] != "." or gap.isspace() and len(plain[i]) == 1:
                j = i + 1
                if len(plain[j]) == 1:
                    j += 1  # an initial in the middle
                    if j == len(words) or not fit[j] or not text[pieces[j - 1].end() : pieces[j].start()].isspace():
                        continue
                if len(plain[j]) > 1 and words[j].rstrip(".") not in TITLES:
                    _name(text, pieces[i].start(), pieces[j].end(), "initial" if len(plain[i]) == 1 else "middle" if j > i + 1 else "full", plain[i] if len(plain[i]) > 1 else None, plain[j], taken, add)


def _name(text: str, a: int, b: int, form: str, given: str | None, last: str, taken: Places, add) -> None:
    if text[b - 1] == ".":
        b -= 1
    if last in COMPANY or not NAME_LIKE.fullmatch(text, a, b) or not taken.free(a, b) or a and text[a - 1] in "@.+-/=%" or b < len(text) and (text[b] in "@+" or text[b] == "-" and text[b + 1 : b + 2].isalnum()):
        return
    lead, tags = _lead(text, a)
    after = text[b : b + 24]
    place = text[max(0, a - 40) : a]
    person = PERSON.search(place) is not None
    company = NAME_OTHER_AFTER.match(after) is not None
    other = NAME_OTHER.search(lead) is not None or given is not None and NAME_OTHER.search(f"{given} ") is not None
    known = given is not None and given in GIVEN
    upper = any(w.isupper() and len(w) > 2 or w == "ID" for w in WORDS.findall(text, a, b))
    cue = form == "title" or NAME_CUE.search(lead) is not None
    odd = upper or form == "full" and last in GIVEN and not known
    add("name", a, b, (_vote(form in ("initial", "middle", "title"), odd), _vote(cue and not other, other), _vote(NAME_AFTER.match(after) is not None, company), _vote(person or NAME_MARKUP.search(place) is not None, NAME_FRAME.search(tags) is not None), _vote(known), _sign(other)), form, given, person or form == "title" or cue and bool(re.search(r"(?i)\b(?:dear|mrs?|ms|dr)\W*$", lead)))


def name_votes(spans: DataFrame, seen: int = GAZETTEER_SEEN, share: float = GAZETTEER_SHARE, common: int = COMMON_SEEN) -> DataFrame:
    """`(given, vote)` of the gazetteer that all pages make: each page counts once for a word and kind of place."""
    names = spans.where("given is not null").groupBy("given", "row").agg(F.max("person").alias("person"))
    counted = names.groupBy("given").agg(F.count(F.lit(1)).alias("n"), F.count_if("person").alias("p"))
    vote = F.when((F.col("p") >= seen) & (F.col("p") >= share * F.col("n")), 1).when((F.col("p") == 0) & (F.col("n") >= common), -1)
    return counted.select("given", vote.alias("vote")).where("vote is not null")


def with_gazetteer(spans: DataFrame) -> DataFrame:
    """The spans with the vote of the grown gazetteer where the listed names cast none."""
    grown = spans.join(name_votes(spans), "given", "left")
    at = LABELERS.index("gazetteer")
    cast = F.transform("votes", lambda v, i: F.when((i == at) & (v == 0) & F.col("vote").isNotNull(), F.col("vote").cast("tinyint")).otherwise(v))
    return grown.select("row", "page_id", "field", "kind", "start", "stop", cast.alias("votes"), "context")


def majority(votes: np.ndarray) -> np.ndarray:
    """Chance of a place by the balance of votes alone, in which no sign of something else counts as no vote."""
    return 1 / (1 + np.exp(-2.0 * (votes[:, :-1].sum(axis=1) + np.minimum(votes[:, -1], 0))))


def reliabilities(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior that a span with these votes is a place of its kind, by expectation-maximisation per kind.

    A labeler that votes is right with chances of its own, given a place and given none; not to vote says nothing. The
    chances start from the majority of votes, and a prior of a few votes says that a labeler is more often right.
    """
    out: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in {k for k, _ in counts}:
        patterns = [(v, n) for (k, v), n in counts.items() if k == kind]
        votes, n = np.array([v for v, _ in patterns]), np.array([c for _, c in patterns], dtype=float)
        post = majority(votes)
        for _ in range(rounds):
            prior = ((post * n).sum() + 1) / (n.sum() + 2)
            ratio = np.full(len(n), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                yes, no = votes[:, j] > 0, votes[:, j] < 0
                good, bad = post * n, (1 - post) * n
                for_good = (good[yes].sum() + 4) / (good[yes | no].sum() + 5)
                for_bad = (bad[yes].sum() + 1) / (bad[yes | no].sum() + 5)
                ratio += np.where(yes, np.log(for_good / for_bad), np.where(no, np.log((1 - for_good) / (1 - for_bad)), 0.0))
            nxt = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
            if np.abs(nxt - post).max() < 1e-6:
                break
            post = nxt
        out |= {(kind, v): float(p) for (v, _), p in zip(patterns, post)}
    return out


#: Features of votes: one for each kind, labeler and vote that was cast, and one for each kind.
VOTES = len(KINDS) * len(LABELERS) * 2 + len(KINDS)


def _index(kind: int, votes, context) -> list[int]:
    base = [kind * len(LABELERS) * 2 + j * 2 + (v > 0) for j, v in enumerate(votes) if v]
    return [*base, VOTES - len(KINDS) + kind, *(VOTES + c for c in context)]


@dataclass
class SpanModel:
    """The final classifier."""

    weights: np.ndarray

    def score(self, kind: int, votes, context) -> float:
        return float(self.weights[_index(kind, votes, context)].sum())

    def keeps(self, found: list[tuple[int, int, int, tuple[int, ...], tuple[int, ...]]]) -> list[tuple[int, int, int]]:
        """`(kind, start, stop)` of the places, by position; of overlapping spans the surer one, then the longer.

        What overlaps a sure e-mail address is part of it.
        """
        scored = []
        for kind, a, b, votes, context in found:
            score = self.score(kind, votes, context)
            if score > 0:
                scored.append((kind == 0, score, b - a, kind, a, b))
        kept, places = [], Places()
        for *_, kind, a, b in sorted(scored, reverse=True):
            if places.free(a, b):
                places.take(a, b)
                kept.append((kind, a, b))
        return sorted(kept, key=lambda k: (k[1], k[2]))


def fit_spans(examples: list[tuple[int, tuple[int, ...], tuple[int, ...], float]], rounds: int = 200, decay: float = 2e-3) -> SpanModel:
    """Logistic regression on the posteriors by whole-batch adaptive steps; all weights are held small."""
    w = np.zeros(VOTES + HASHED)
    if not examples:
        return SpanModel(w)
    rows = [_index(k, v, c) for k, v, c, _ in examples]
    size = np.array([len(r) for r in rows])
    at, of = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), size)
    goal = np.array([p for *_, p in examples])
    total = np.full(len(w), 1e-9)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(rows)), -30, 30))) - goal
        step = np.bincount(at, g[of], len(w)) + decay * len(rows) * 0.01 * w
        total += step * step
        w -= 0.5 * step / np.sqrt(total)
    return SpanModel(w)


def _spans(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """One row per candidate: `(row, page_id, field, kind, start, stop, votes, given, person, context)`; `row` tells rows of the table apart."""
    names = ["row", "page_id", "field", "kind", "start", "stop", "votes", "given", "person", "context"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int8(), pa.int32(), pa.int32(), pa.list_(pa.int8()), pa.string(), pa.bool_(), pa.list_(pa.int32())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 36)
        for batch in batches:
            rows = []
            for page, html, url in zip(*(c.to_pylist() for c in batch.columns)):
                row = next(number)
                for field, value in (("html", html), ("url", url)):
                    rows += [(row, page, field, *found) for found in candidates(value or "", field == "html")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html"), F.col(url_col).alias("url"))
    return rows.mapInArrow(find, "row bigint, page_id bigint, field string, kind tinyint, start int, stop int, votes array<tinyint>, given string, person boolean, context array<int>")


def example_threshold(most: int, total: int) -> int:
    """Greatest 63-bit hash that draws `most` of `total` rows on average."""
    return (1 << 63) - 1 if total <= most else ((1 << 63) * most) // total


def fit(spans: DataFrame, most: int = TRAIN_SPANS) -> SpanModel:
    """Aggregate the votes of all spans and train the classifier on a bounded sample of them, the same number of each kind.

    Spans on which no labeler votes, but for the one that looks for signs of something else and finds none, teach
    nothing: the classifier decides them by what it has learnt of contexts.
    """
    rows = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most kinds x 3^labelers rows
    counts = {(r["kind"], tuple(r["votes"])): r["n"] for r in rows}
    if not counts:
        return SpanModel(np.zeros(VOTES + HASHED))
    posterior = reliabilities(counts)
    draw = F.xxhash64(F.lit("spans"), "row", "field", "kind", "start").bitwiseAND(F.lit((1 << 63) - 1))
    totals = Counter()
    told = {(k, v): n for (k, v), n in counts.items() if v[-1] < 0 or any(v[:-1])}
    for (kind, _), n in told.items():
        totals[kind] += n
    wanted = F.lit(False)
    for kind, n in totals.items():
        wanted = wanted | (F.col("kind") == kind) & (draw <= F.lit(example_threshold(most, n)))
    voted = (F.element_at("votes", -1) < 0) | F.exists(F.slice("votes", 1, len(LABELERS) - 1), lambda v: v != 0)
    sample = spans.where(wanted & voted).select("kind", "votes", "context", draw.alias("draw")).orderBy("draw").limit(2 * most * len(KINDS)).collect()
    examples = [(r["kind"], tuple(r["votes"]), tuple(r["context"]), posterior[r["kind"], tuple(r["votes"])]) for r in sample]
    # Every pattern teaches, without context, in proportion to the root of its count.
    examples += [(k, v, (), posterior[k, v]) for (k, v), n in sorted(told.items()) for _ in range(min(20, int(n**0.5) + 1))]
    return fit_spans(examples)


def _decided(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """`(row, page_id, field, places)` with the places `(kind, start, stop, nth)` of each field that has any."""
    spans = stored(with_gazetteer(stored(_spans(pages, id_col, html_col, url_col), "pii-spans")), "pii-votes")
    shared = pages.sparkSession.sparkContext.broadcast(fit(spans))
    places = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("stop", pa.int64()), ("nth", pa.int64())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            kept = []
            for found in batch.column(3).to_pylist():
                nth: Counter[int] = Counter()
                kept.append([])
                for k, a, b in m.keeps([(x["kind"], x["start"], x["stop"], x["votes"], x["context"]) for x in found]):
                    nth[k] += 1
                    kept[-1].append({"kind": k, "start": a, "stop": b, "nth": nth[k]})
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, places)], names=["row", "page_id", "field", "places"])

    fields = spans.groupBy("row", "page_id", "field").agg(F.collect_list(F.struct("kind", "start", "stop", "votes", "context")).alias("found"))  # of one field of one page
    return fields.mapInArrow(decide, "row bigint, page_id bigint, field string, places array<struct<kind: tinyint, start: bigint, stop: bigint, nth: bigint>>").where(F.size("places") > 0)


def find_places(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """`(page_id, field, kind, nth, start, stop)`: every place of personal information, numbered per field and kind.

    Positions are characters of the raw field. Null, empty and blank fields have no places; rows with null ids are
    left out; a value that occurs twice counts twice, and repeated pages each count.
    """
    found = _decided(pages, id_col, html_col, url_col).select("page_id", "field", F.explode("places").alias("p"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("p.kind") + 1)
    return found.select("page_id", "field", kind.alias("kind"), "p.nth", "p.start", "p.stop")


def redact(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """All columns of the table, with typed placeholders in both fields and the rest of the text unchanged.

    Null fields stay null. Rows with a null id are redacted too, as the fields alone decide. Places are joined to the
    rows by the digest of both fields, so that the text is searched once.
    """
    digest = F.md5(F.to_json(F.struct(F.col(html_col).alias("a"), F.col(url_col).alias("b"))))
    keyed = pages.select(F.xxhash64(digest).alias("k"), digest.alias("d"), F.col(html_col).alias("h"), F.col(url_col).alias("u"))
    shown = _decided(keyed, "k", "h", "u").groupBy(F.col("page_id").alias("pii_key"), "field").agg(F.min_by("places", "row").alias("places"))
    by = shown.groupBy("pii_key").agg(F.max(F.when(F.col("field") == "html", F.col("places"))).alias("in_html"), F.max(F.when(F.col("field") == "url", F.col("places"))).alias("in_url"))
    full = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.xxhash64(digest).alias("pii_key")).join(by, "pii_key", "left")

    def spliced(name: str, places: str):
        text = F.col(f"page.`{name}`")
        piece = lambda i, p: F.concat(F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.get(places, i - 1)["stop"].cast("int") + 1), p["start"].cast("int") - F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1)["stop"].cast("int"))), F.element_at(F.array(*[F.lit(PLACEHOLDER[k]) for k in KINDS]), p["kind"] + 1))
        rest = F.substring(text, F.element_at(places, -1)["stop"].cast("int") + 1, F.length(text))
        return F.when(F.col(places).isNull() | text.isNull(), text).otherwise(F.concat(F.array_join(F.transform(places, lambda p, i: piece(i, p)), ""), rest))

    return full.select(*[(spliced(c, "in_html") if c == html_col else spliced(c, "in_url") if c == url_col else F.col(f"page.`{c}`")).alias(c) for c in pages.columns])
