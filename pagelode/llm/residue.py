"""Template residue and error-page text (problem 3).

Records are aligned word by word: a slot is a place between the same two words before and the same two words after
in which aligned records differ. A variable-shaped token is residue if it stands in such a slot, where other records
have ordinary words; or if the same token is left on pages of several hosts; the notation alone decides only for a
token that has no aligned record, and only if it means nothing else. Default texts are paragraphs that recur in
different surroundings or in the words that such paragraphs teach. Whole-page messages are pages without content of
their own whose lines recur on such bare pages of several hosts; wording gives their kind, and decides alone only for
messages that no other page repeats. Every finding names its evidence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions.html import HIDDEN, INLINE, INVISIBLE, TAG, TITLE, body_of, entities
from pagelode.functions.urls import host_key
from pagelode.session import broadcast_if_small, stored

#: Hosts on which a line must recur on bare pages to be taken for a message without any known wording.
RECURS = 3
#: Short lines a message line may have beside it; more make the page a list with content.
MINOR_LINES = 4
#: Least share of pseudo-Latin in a paragraph of filler; of the words that are learnt from sure paragraphs.
LATIN, LEARNT = 0.2, 0.6
#: Sure paragraphs in which a word must stand to be learnt.
LATIN_SEEN = 5
#: Most words of another record that fill the slot of a variable.
FILLING = 3
#: Different fillings from which on a slot counts as one that ought not to be blank.
FILLED = 3
#: Bits of the filter for contexts of variables, at most (2 ** n); it only spares rows, a full one loses none.
FILTER_BITS = 26

CODE = re.compile(r"<(code|pre|kbd|samp|textarea|xmp)\b[^>]*>.*?(?:</\1\s*>|$)", re.I | re.S)
FRAME = re.compile(r"<(nav|footer|button|select|title)\b[^>]*>.*?(?:</\1\s*>|$)", re.I | re.S)
HEADINGS = re.compile(r"<(h[1-6])\b[^>]*>.*?(?:</\1\s*>|$)", re.I | re.S)
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
NUMBERED = re.compile(r"\b\w*?\d\w*")
SENTENCE = re.compile(r"(?<=[.!?…:])\s+|(?<=[。！？])")

# Notations of template variables. Those in STRONG mean nothing else; those in WEAK can, and need
# the evidence of a slot or of other pages.
STRONG = [
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}",
    r"\{%-?\s*[a-z][^%{}\n]{0,60}%\}",
    r"<%[=\-@]?\s*[^%<>\n]{1,60}%>",
    r"<\?(?:php|=)[^?<>\n]{0,80}\?>",
    r"\$\{[A-Za-z_][^{}\n]{0,50}\}",
    r"#\{[A-Za-z_][^{}\n]{0,50}\}",
    r"\*\|[A-Z_:]{2,40}\|\*",
    r"%%[A-Za-z_]{2,40}%%",
    r"@@[A-Za-z_]{2,40}@@",
    r"\[\[[A-Za-z_ .]{2,40}\]\]",
    r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__",
    r"##[A-Z_]{2,40}##",
    r"\[%[^%\[\]\n]{1,50}%\]",
    r"\{![A-Za-z_][A-Za-z0-9_.]{1,50}\}",
    r"\{\$[A-Za-z_][A-Za-z0-9_.\->]{1,50}\}",
    r"%\([A-Za-z_]{2,40}\)[sdif]",
    r"<<[A-Za-z_][A-Za-z_ ]{1,40}>>",
]
WEAK = [
    r"%[A-Z][A-Z_]{2,40}%",
    r"\$[A-Z][A-Z_]{2,40}\$?",
    r"\{[A-Za-z][A-Za-z]*(?:[_.\- ][A-Za-z]+)*\}|\{\d\}",
    r"(?<![\w:]):[a-z]{2,20}(?:_[a-z]{2,20})*:(?![\w:])",
    r"(?<![\w#&])#[A-Z][A-Z_]{2,30}#(?!\w)",
    r"\bYOUR_[A-Z]{2,20}(?:_[A-Z]{2,20})*\b",
    r"\[(?:[Yy]our|[Ii]nsert|[Ee]nter|[Aa]dd|[Tt]ype|YOUR|INSERT|ENTER|ADD)[ _\-][^\[\]\n]{1,40}\]",
    r"\[[A-Z]{3,}(?:[ _\-][A-Z]{2,})+\]",
    r"\[(?:first|last|full|company|customer|user|client|product|brand|site|city|order|recipient)[ _\-]?[a-z]{0,12}\]",
    r"<(?:your|insert|enter|YOUR|INSERT|ENTER|Your|Insert|Enter)[ _\-][A-Za-z _\-]{2,40}>",
    r"«[A-Z][A-Za-z_]{2,30}»",
    r"(?<![\w~])~[A-Z][A-Z_]{2,30}~(?![\w~])",
    r"\|[A-Z][A-Z_]{3,30}\|",
    r"\[object [A-Z]\w+\]",
]
VARIABLE = re.compile("|".join([f"(?P<s>{'|'.join(STRONG)})", f"(?P<w>{'|'.join(WEAK)})"]))
HINT = re.compile(r"[{\[%$@#«~<]|\*\||\|[A-Z]{3}|__|:[a-z_]+:|YOUR_")

# The customary pseudo-Latin of layouts, by the first five letters of its words.
LOREM = frozenset(
    """lorem ipsum dolor ameti conse adipi eiusm tempo incid labor magna aliqu venia nostr exerc ullam commo irure repre
    volup velit cillu fugia nulla paria excep cupid proid culpa offic deser molli augue justo porta etiam magni ridic
    partu fring preti lacin lacus vesti habit vivam fermo ferme ornar curab tempu massa tellu morbi nisl tinci pulvi
    conva susci phare bland vulpu ultri ultricies sagit accum faucib fauci dapib matti aenea sodal donec maece feugi
    rutru vehic hendr moles placer place luctu posue viver egest sceler scele elemen eleme gravid gravi interd inter
    digni imper solli lobor condi euism facili facil bibend biben cursu turpi liber netus males""".split()
)
# Very common words of the corpus' languages; running text has some of them, pseudo-Latin none.
COMMON_WORDS = frozenset(
    """the of and to is that for with this are der die das und ist nicht mit ein le les des et est une dans pour que el los
    las una del por con il di che gli della un per da os uma do em não para het een van en voor op na się nie przez och
    att det som på är av ve bir bu için ile и в на не что по a в se au te de la""".split()
)
# Default texts of page builders and editors; a sentence is filler if it says such a thing.
FILLER = re.compile(
    r"""\b(?:sample|placeholder|dummy|filler|default|example)\s+(?:text|texts|page|paragraph|heading|subheading|button|copy|content|title|caption|headline|post|description)\b
    |\b(?:text|copy|content|heading|headline|title|subtitle|description|paragraph|name|slogan|tagline|caption)\b[^.]{0,30}\bgo(?:es)?\s+here\b
    |\b(?:heading|headline|title|paragraph|text|column|section|item)\s+(?:one|two|three|four|\d+)\s+goes\s+here\b
    |\b(?:add|insert|enter|type|write|put|place)\b[^.]{0,40}\b(?:text|copy|content|description|title|heading|words|paragraph|bio|story|message)\b[^.]{0,30}\bhere\b
    |\breplace\s+(?:this|me|it)\b[^.]{0,30}\b(?:with|by)\b[^.]{0,30}\b(?:own|text|copy|content|words)\b
    |\b(?:text|copy)\s+(?:block|for\s+layout\s+only)\b
    |\b(?:edit|click)\b[^.]{0,20}\b(?:this\s+text|to\s+edit|to\s+add)\b
    |\blorem\s+ipsum\s+dolor\b
    |\b(?:blindtext|platzhalter\w*|beispieltext|mustertext|fülltext)\b|\bhier\s+(?:steht|kommt|folgt)\b[^.]{0,20}\btext\b|\btext\s+hier\s+(?:eingeben|einfügen)
    |\bersetzen\b[^.]{0,20}\bdurch\b[^.]{0,20}\beigene\b|\bedit\s+(?:it|this|me)\b[^.]{0,40}\b(?:site|page|visitors|own)\b|\b(?:solo|sólo|só|apenas)\s+(?:una\s+muestra|un\s+ejemplo|um\s+exemplo)\b
    |\btexte\s+(?:d['’]exemple|de\s+remplissage|factice|fictif|provisoire|ici)\b|\bvotre\s+texte\s+ici\b|\b(?:saisissez|écrivez|insérez)\b[^.]{0,20}\btexte\b
    |\btexto\s+de\s+(?:ejemplo|prueba|relleno|muestra|exemplo|preenchimento)\b|\b(?:escriba|escribe|escreva|introduzca|inserte|insira|digite)\b[^.]{0,20}\b(?:texto|aqu[íi])\b[^.]{0,20}\b(?:texto|aqu[íi])\b|\b(?:su|tu|seu)\s+texto\s+aqu[íi]\b
    |\btesto\s+(?:di\s+)?(?:esempio|segnaposto|prova|riempimento)\b|\b(?:inserisci|scrivi)\b[^.]{0,20}\btesto\b
    |\b(?:voorbeeldtekst|opvultekst|plaatshouder\w*)\b|\b(?:uw|je)\s+tekst\s+hier\b|\bhier\s+komt\b[^.]{0,20}\btekst\b
    |\bprzykładow\w+\s+(?:tekst|akapit|strona)\b|\b(?:wpisz|wstaw)\b[^.]{0,20}\btekst\b|\btutaj\b[^.]{0,20}\btekst\b
    |\b(?:exempeltext|platshållar\w*|utfyllnadstext)\b|\bskriv\b[^.]{0,20}\btext\b[^.]{0,20}\bhär\b|\bdin\s+text\s+här\b
    |\börnek\s+metin\b|\bmetn\w*\s+buraya\b|\bburaya\b[^.]{0,20}\b(?:metin|yaz)\w*
    |\b(?:пример|образец)\s+текста\b|\b(?:введите|вставьте)\b[^.]{0,20}\bтекст\b|\bваш\s+текст\s+здесь\b|\bтекст[\s-]заполнитель\b
    |(?:サンプル|ダミー)(?:テキスト|文章|ページ)|ここに(?:テキスト|文章|本文)""",
    re.I | re.X,
)
MASH = re.compile(r"^(?:asdf\w*|qwer\w*|qwertz?\w*|zxcv\w*|hjkl\w*|jkl\w*|fdsa|dfgh|sdfg|fghj|foo|bar|baz|bla+h?|test(?:ing|e|o)?|xx+|(\w)\1{2,})$", re.I)

# What messages in place of content say, in the languages of the corpus.
SCRIPTS = re.compile(
    r"""java\s?script|\bscripts?\b|\bscripting\b|\bcookies?\b|skrypt\w*|скрипт\w*|сценари\w*|スクリプト|クッキー
    |\b(?:checking|verifying|validating)\b.{0,40}\b(?:browser|human|visitor|connection|robot)\b|\bjust\s+a\s+(?:moment|second)\b
    |\b(?:vérification|verificación|comprobando|verifica|verificando|überprüf\w*|prüf\w*|controle\w*)\b.{0,40}\b(?:navigateur|navegador|browser\w*|humain|humano)\b
    |\bare\s+(?:you\s+)?(?:a\s+)?(?:human|not\s+a\s+robot)\b|\bhuman\s+visitor\b|ブラウザ.{0,12}確認""",
    re.I | re.X,
)
ERRORS = re.compile(
    r"""\b(?:not|no\s+longer|never)\s+(?:be\s+)?(?:found|exist\w*|available|accessible|valid)\b|\bcan(?:no|['’])?t?\s+(?:not\s+)?(?:find|be\s+(?:found|reached|displayed|loaded))\b|\bno\s+such\b|\bdoes\s+not\s+exist\b
    |\berrors?\b|\bnot_found\b|\b(?:access|permission)\s+denied\b|\bdenied\b|\bforbidden\b|\bunauthori[sz]ed\b|\bpermission\s+to\b|\bmoved\s+or\s+(?:deleted|removed)\b|\b(?:been|was)\s+(?:moved|deleted|removed)\b|\bnot\s+allowed\b
    |\bsuspended\b|\bdeactivated\b|\bparked\b|\bdomain\b.{0,30}\bfor\s+sale\b|\bexpired\b|\bmaintenance\b|\bback\s+(?:soon|shortly|right)\b|\bbe\s+right\s+back\b|\breturn\s+soon\b|\bunder\s+construction\b
    |\b(?:un)available\b|\bunable\s+to\b|\btime(?:d)?[\s-]?out\b|\bbad\s+(?:gateway|request)\b|\bgateway\b|\bdid\s+not\s+(?:answer|respond)\b|\btoo\s+many\s+requests\b|\bslow\s+down\b|\btry\s+again\b
    |\bblocked\b|\bwent\s+wrong\b|\bfatal\b|\btraceback\b|\bexception\b|\bwarning:|\bcould\s+not\s+connect\b|\bnothing\s+here\b|\bno\s+site\s+has\b|\bhttpd\b|\bcertificate\b|\bnot\s+loaded\b|\boops\b|\bincident\b
    |\bintrouvable\b|\bn['’]existe\s+(?:pas|plus)\b|\berreur\b|\baccès\s+(?:refusé|interdit)\b|\bindisponible\b|\bsuspendu\w*\b|\bréessay\w+
    |\bnicht\s+(?:gefunden|mehr|erreichbar|verfügbar|gestattet)\b|\bfehler\b|\bverweigert\b|\bgesperrt\b|\bwartung\w*\b|\banfragen\b|\bexistiert\s+nicht\b|\bspäter\s+erneut\b
    |\bno\s+(?:está\s+disponible|encontrad\w+|existe|se\s+encontró|se\s+pudo)\b|\bencontrad[ao]\b|\bdenegad[oa]\b|\bsuspendid[oa]\b|\bmantenimiento\b|\binténtelo\b
    |\bnon\s+(?:è\s+stat\w+\s+)?(?:trovat\w+|esiste|disponibile)\b|\bnegato\b|\bsospes\w+\b|\bmanutenzione\b|\bnão\s+(?:foi\s+)?(?:encontrad\w+|existe|está\s+disponível)\b|\bnegado\b|\bsuspens\w+\b|\bmanutenção\b|\berro\b|\berrore\b
    |\bniet\s+(?:gevonden|beschikbaar|bestaat)\b|\bbestaat\s+niet\b|\bgeweigerd\b|\bgeblokkeerd\b|\bonderhoud\b|\bopgeschort\b|\bfout\b|\bnie\s+(?:znaleziono|istnieje)\b|\bbłąd\b|\bodmowa\b|\bzawieszon\w+\b|\bprzerwa\s+techniczna\b
    |\b(?:hittades|finns)\s+inte\b|\bnekad\b|\bavstäng\w*\b|\bunderhåll\b|\bfel\b|\bbulunamadı\b|\bengellendi\b|\bhata\b|\bbakım\w*\b|\bне\s+(?:найден\w*|существует|доступ\w*)\b|\bошибк\w+\b|\bзапрещ\w+\b|\bзаблокирован\w*\b|\bприостановлен\w*\b|\bобслуживани\w+\b
    |見つかりません|存在しません|エラー|アクセス(?:拒否|できません)|メンテナンス|停止され|ご利用いただけません""",
    re.I | re.X,
)
#: Kinds of a line: possible content, script notice, error message, something short that says nothing.
CONTENT, SCRIPT, ERROR, MINOR = 0, 1, 2, 3
#: Characters of scripts without blanks between words; a message of that many is a sentence.
DENSE, DENSE_SENTENCE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"), 10
#: Markup of pages that have more to them than a message.
OWN = re.compile(r"<(?:nav|form|input|button)\b", re.I)
#: Words of a line, ends of lines and, in place of a variable, one mark.
PART = re.compile("\\w+|[\n\x01]")
TRACE = re.compile(r"^\s*(?:at\s+[\w$.<>]+\(|File\s+\".*\",\s+line\s+\d+|#\d+\s+\S+\(|[\w.]+(?:Error|Exception)\b)")

# How the words begin of which every default text has one, at most five letters, and its signs in
# Japanese. Every alternative of FILLER has such a word, so that the look at the words spares the search, and no match.
FILLER_STEMS = frozenset(
    """sampl place dummy fille defau examp here text copy repla edit click lorem blind platz beisp muster muste füllt hier ersetz erset
    solo sólo só apena texte texto testo aquí aqui voorb opvul plaat tekst przyk tutaj wpisz wstaw exemp plats utfyl här
    metin metni örnek buray текст приме образ ваш""".split()
)
FILLER_SIGNS = ("サンプル", "ダミー", "ここに")


def _speaks(words: list[str]) -> int:
    return sum(map(COMMON_WORDS.__contains__, words))


@lru_cache(1 << 14)
def is_filler(sentence: str) -> bool:
    """Whether a whole sentence is filler: default text, pseudo-Latin, keyboard mash or one word over and over."""
    words = WORD.findall(sentence.lower())
    if not words:
        return False
    stems = [w[:5] for w in words]
    signs = not FILLER_STEMS.isdisjoint(stems) or not sentence.isascii() and any(s in sentence for s in FILLER_SIGNS)
    if signs and FILLER.search(sentence):
        return True
    if len(words) < 3:
        return False
    latin = [w for w in stems if w in LOREM]
    if len(latin) >= LATIN * len(words) and len(set(latin)) > 1 and len(latin) > 2 * _speaks(words):
        return True
    # Of words that are four fifths mash, one more than a fifth cannot all be others.
    if any(map(MASH.match, words[: len(words) // 5 + 1])) and sum(1 for w in words if MASH.match(w)) >= 0.8 * len(words):
        return True
    return len(words) >= 4 and len(set(words)) == 1


def is_filler_paragraph(block: str, words: list[str] | None = None, latin_known: set[str] | None = None) -> bool:
    """Whether every sentence with words is filler; a paragraph of pseudo-Latin is judged as a whole, too.

    `words` are those of the block in small letters and `latin_known` all pseudo-Latin ones, if they are known already.
    """
    first = SENTENCE.split(block, maxsplit=1)[0]
    if not WORD.search(first) or is_filler(first):
        parts = [s for s in SENTENCE.split(block) if WORD.search(s)]
        if not parts:
            return False
        if all(map(is_filler, parts)):
            return True
    words = WORD.findall(block.lower()) if words is None else words
    if latin_known is not None and latin_known.isdisjoint(words):
        return False
    latin = [w for w in [w[:5] for w in words] if w in LOREM]
    return len(latin) > 3 and len(words) >= 8 and len(latin) >= LATIN * 1.25 * len(words) and len(set(latin)) > 3 and len(latin) > 2 * _speaks(words)


def latin_words(line: str, sure: bool, words: list[str] | None = None) -> list[str]:
    """Words of a paragraph of pseudo-Latin, or of one that may be: in small letters and without any common word."""
    if not line.isascii() or not sure and words is not None and not COMMON_WORDS.isdisjoint(words):
        return []
    words = WORD.findall(line)
    low = [w.lower() for w in words]
    if len(words) < 4 or not sure and not COMMON_WORDS.isdisjoint(low):
        return []
    return low if sum(map(str.islower, words)) >= 0.6 * len(words) else []


@lru_cache(1 << 14)
def _sentence_kind(text: str) -> int:
    if SCRIPTS.search(text):
        return SCRIPT
    if ERRORS.search(text) or TRACE.match(text):
        return ERROR
    long = len(text.split()) > 5 or len(text) > 60 or not text.isascii() and len(DENSE.findall(text)) > DENSE_SENTENCE
    return CONTENT if long else MINOR


def line_kind(line: str) -> int:
    """Kind of a line of a bare page: of its sentences, content outweighs all; a short remark after a message does not."""
    kinds: list[int] = []
    for part in [line] if TRACE.match(line) else SENTENCE.split(line):
        kind = _sentence_kind(part)
        if kind == CONTENT and kinds and kinds[-1] in (SCRIPT, ERROR) and len(part.split()) <= 8:
            kind = MINOR
        if kind == CONTENT:
            return CONTENT
        kinds.append(kind)
    return next((k for k in (ERROR, SCRIPT) if k in kinds), MINOR)


def _mask(line: str) -> int:
    """Key of a line without its digits and words with digits."""
    low = line.lower()
    if DIGIT.search(low):
        low = NUMBERED.sub("0", low)
    return zlib.crc32(low.encode("utf-8", "surrogatepass"))


def page_lines(page: str) -> tuple[str, list[str], list[str], list[str]]:
    """Title, headings, lines of the visible text outside navigation, code and scripts, and texts of navigation."""
    found = TITLE.search(page)
    title = " ".join(entities.unescape(found[1]).split()) if found else ""
    body = CODE.sub(" ", HIDDEN.sub("\n", body_of(page)))
    frame: list[str] = []
    heads: list[str] = []

    def taken(out: list[str]) -> Callable[[re.Match], str]:
        def keep(m: re.Match) -> str:
            out.append(" ".join(entities.unescape(TAG.sub(" ", m[0])).split()))
            return "\n"

        return keep

    body = HEADINGS.sub(taken(heads), FRAME.sub(taken(frame), body))
    text = TAG.sub("\n", INLINE.sub("", body.replace("\r", " ").replace("\n", " ")))
    if "&" in text:
        text = entities.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return title, heads, [s for b in text.split("\n") if (s := " ".join(b.split()))], frame


class WordCodes(dict):
    """A code of 31 bits per word, and 0 for the end of a line, 1 for a variable; remembers what it has seen.

    `latin` has the words with a stem of pseudo-Latin among them.
    """

    def __init__(self) -> None:
        super().__init__({"\n": 0, "\x01": 1})
        self.latin: set[str] = set()

    def __missing__(self, word: str) -> int:
        code = self[word] = max(2, zlib.crc32(word.encode("utf-8", "surrogatepass")) >> 1)
        if word[:5] in LOREM:
            self.latin.add(word)
        return code

    def forget(self, most: int = 1_000_000) -> None:
        """Begin anew if there are too many words."""
        if len(self) > most:
            self.clear()
            self.__init__()


def _contexts(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the two words before and the two after every place that `size` words fill, and whether they suffice.

    Place `i` is before the word `i + 2`; ends of lines come twice. Two words of the four must be words of the line
    and the filling may not reach beyond it.
    """
    n = len(codes) - 3 - size
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    around = [codes[k : k + n] for k in (0, 1, size + 2, size + 3)]
    key = np.zeros(n, np.uint64)
    told = np.zeros(n, np.int8)
    for part in around:
        key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        told += part > 1
    fits = told >= 2
    for k in range(size):
        fits &= codes[k + 2 : k + 2 + n] > 1 if size > 1 else codes[k + 2 : k + 2 + n] > 0
    return key.view(np.int64), fits


def page_facts(pages: DataFrame, id_col: str = "crawl_id", html_col: str = "html_content", url_col: str = "url") -> DataFrame:
    """One row per page with content.

    `vars`: variables with the key of their context (null if too little stands around them); `codes`: a code per word
    of all lines, to align them; `fill`: paragraphs of filler with the keys of their lines and neighbours; `latin`: the
    words of paragraphs of pseudo-Latin, sure or possible; `keys`: the keys of all lines in order; `bare`: keys and
    kinds of the lines of a page that may be a message; `plain`: whether it has nothing but text.
    """
    names = ["crawl_id", "host", "vars", "codes", "fill", "latin", "keys", "bare", "plain"]
    struct = lambda **k: pa.list_(pa.struct(list(k.items())))
    kinds = [pa.int64(), pa.string(), struct(token=pa.string(), strong=pa.bool_(), ctx=pa.int64()), pa.list_(pa.int32()), struct(key=pa.int64(), prev=pa.int64(), next=pa.int64()), struct(sure=pa.bool_(), words=pa.list_(pa.string())), pa.list_(pa.int64()), struct(key=pa.int64(), kind=pa.int32()), pa.bool_()]

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            known.forget()
            rows, words, ends = [], [], []
            for page_id, host, page in zip(*(c.to_pylist() for c in batch.columns)):
                if page.isspace() or not page:
                    continue
                title, heads, lines, frame = page_lines(page)
                every = [title, *heads, *lines]
                keys = [_mask(s) for s in every]
                found = []
                words += (0, 0)
                parts = []
                hinted = HINT.search("\n".join([*every, *frame])) is not None
                for line in [*every, *frame]:
                    if hinted and HINT.search(line):
                        found += [{"token": m[0], "strong": m["s"] is not None} for m in VARIABLE.finditer(line)]
                        line = VARIABLE.sub(" \x01 ", line)
                    parts.append(PART.findall(line.lower()))
                    words += map(known.__getitem__, parts[-1])
                    words += (0, 0)
                ends.append(len(words))
                first = len(keys) - len(lines)
                spoken = parts[first : len(keys)]
                sure = [is_filler_paragraph(s, w, known.latin) for s, w in zip(lines, spoken)]
                fill = [{"key": keys[k], "prev": keys[k - 1] if k else 0, "next": keys[k + 1] if k + 1 < len(keys) else 0} for k, ok in enumerate(sure, first) if ok]
                latin = [{"sure": ok, "words": w} for s, ok, p in zip(lines, sure, spoken) if (w := latin_words(s, ok, p))]
                plain = OWN.search(page) is None
                bare = []
                for s in lines or [s for s in [*heads, title] if s]:
                    bare.append({"key": _mask(s), "kind": line_kind(s)})
                    if bare[-1]["kind"] == CONTENT and not plain:
                        bare = []  # has content of its own
                        break
                rows.append([page_id, host, found, None, fill, latin, keys, bare, plain])
            codes = np.array(words, dtype=np.int32)
            context, fits = _contexts(codes, 1)
            begin = 0
            for row, end in zip(rows, ends):
                at = np.flatnonzero(codes[begin:end] == 1) + begin - 2
                for v, i in zip(row[2], at.tolist()):
                    v["ctx"] = int(context[i]) if fits[i] else None
                row[3] = codes[begin:end]
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    rows = pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("crawl_id"), F.coalesce(host_key(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInArrow(facts, "crawl_id bigint, host string, vars array<struct<token: string, strong: boolean, ctx: bigint>>, codes array<int>, fill array<struct<key: bigint, prev: bigint, next: bigint>>, latin array<struct<sure: boolean, words: array<string>>>, keys array<bigint>, bare array<struct<key: bigint, kind: int>>, plain boolean")


def _filter_of(keys: DataFrame, col: str) -> np.ndarray:
    """A bitmap of the distinct keys; at least 16 bits a key up to the greatest size."""
    n = keys.count()
    power = min(FILTER_BITS, max(10, (16 * n).bit_length()))
    place = F.col(col).bitwiseAND(F.lit((1 << power) - 1))
    words = keys.groupBy(F.shiftright(place, 5).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
    out = np.zeros(1 << (power - 5), np.uint32)
    got = words.toPandas()  # at most 2 ** (FILTER_BITS - 5) rows
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def slot_fillings(facts: DataFrame) -> DataFrame:
    """`(crawl_id, ctx, filling)`: what stands in the contexts of variables on any page; 0 if nothing, 1 a variable."""
    wanted = stored(facts.where(F.size("vars") > 0).select(F.explode("vars.ctx").alias("ctx")).where("ctx is not null").distinct(), "variable-contexts")
    shared = facts.sparkSession.sparkContext.broadcast(_filter_of(wanted, "ctx"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.int64(len(bits) * 32 - 1)
        for batch in batches:
            ends = batch.column(1).value_lengths().to_numpy().cumsum()
            codes = batch.column(1).flatten().to_numpy()
            ids = batch.column(0).to_numpy()
            for size in range(FILLING + 1):
                key, fits = _contexts(codes, size)
                place = key & mask
                at = np.flatnonzero(fits & ((bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1).astype(bool))
                filling = np.zeros(len(at), np.int64)
                for k in range(size):
                    filling = (filling * np.int64(1_000_003) + codes[at + 2 + k]) & np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.searchsorted(ends, at + 2, "right")]), pa.array(key[at]), pa.array(filling)], names=["crawl_id", "ctx", "filling"])

    return facts.select("crawl_id", "codes").mapInArrow(align, "crawl_id bigint, ctx bigint, filling bigint").join(wanted, "ctx", "left_semi")


def _placeholders(facts: DataFrame, fillings: DataFrame) -> DataFrame:
    """`(crawl_id, evidence)` of pages with a variable: slot, recurrence or notation, whichever is the best."""
    left = facts.where(F.size("vars") > 0).select("crawl_id", "host", F.explode("vars").alias("v")).select("crawl_id", "host", "v.*")
    slots = fillings.where("filling > 1").select("ctx").distinct().select("ctx", F.lit(True).alias("slot"))
    spread = left.groupBy("token").agg(F.min("host").alias("a"), F.max("host").alias("b")).where("a <> b").select("token", F.lit(True).alias("spread"))
    judged = left.join(broadcast_if_small(slots), "ctx", "left").join(broadcast_if_small(spread), "token", "left")
    rank = F.when(F.col("slot"), 0).when(F.col("spread"), 1).when(F.col("strong"), 2)
    best = judged.groupBy("crawl_id").agg(F.min(rank).alias("r")).where("r is not null")
    return best.select("crawl_id", F.element_at(F.array(*map(F.lit, ("slot", "recurrence", "notation"))), F.col("r") + 1).alias("evidence"))


def _filler(facts: DataFrame) -> DataFrame:
    """`(crawl_id, evidence)` of pages with filler.

    Slot: the paragraph stands where another record has another one, or recurs between other neighbours; recurrence:
    another host has it too; learnt: its pseudo-Latin is that of five other paragraphs; wording: none of these.
    """
    lines = facts.where(F.size("latin") > 0).select("crawl_id", F.posexplode("latin").alias("line", "x")).select("crawl_id", "line", "x.sure", "x.words")
    learnt = lines.where("sure").select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LATIN_SEEN).select("word", F.lit(1).alias("known"))
    words = lines.select("crawl_id", "line", F.explode("words").alias("word")).join(broadcast_if_small(learnt), "word", "left")
    more = words.groupBy("crawl_id", "line").agg((F.count("known") / F.count(F.lit(1))).alias("share")).where(F.col("share") >= LEARNT)
    fill = facts.where(F.size("fill") > 0).select("crawl_id", "host", F.explode("fill").alias("x")).select("crawl_id", "host", "x.*")
    per = fill.groupBy("key").agg((F.min(F.struct("prev", "next")) != F.max(F.struct("prev", "next"))).alias("moves"), (F.min("host") != F.max("host")).alias("spread"))
    gaps = broadcast_if_small(fill.select("prev", "next").distinct())
    at = facts.select("keys", F.posexplode("keys").alias("i", "key"))
    there = at.select(F.when(F.col("i") > 0, F.get("keys", F.col("i") - 1)).otherwise(F.lit(0)).alias("prev"), "key", F.coalesce(F.get("keys", F.col("i") + 1), F.lit(0)).alias("next"))
    slots = there.join(gaps, ["prev", "next"], "left_semi").groupBy("prev", "next").agg((F.min("key") != F.max("key")).alias("differs"))
    judged = fill.join(broadcast_if_small(per), "key", "left").join(broadcast_if_small(slots), ["prev", "next"], "left")
    sure = judged.select("crawl_id", F.when(F.col("differs") | F.col("moves"), 0).when(F.col("spread"), 1).otherwise(3).alias("r"))
    best = sure.unionByName(more.select("crawl_id", F.lit(2).alias("r"))).groupBy("crawl_id").agg(F.min("r").alias("r"))
    return best.select("crawl_id", F.element_at(F.array(*map(F.lit, ("slot", "recurrence", "learnt", "wording"))), F.col("r") + 1).alias("evidence"))


def _messages(facts: DataFrame, recurs: int) -> DataFrame:
    """`(crawl_id, residue_kind, evidence)` of pages whose every line is that of a message.

    A line is one if it recurs on plain pages of `recurs` hosts and on few pages with content, or by its wording. A page
    all of whose lines recur on such pages is a whole-page template, whatever it says.
    """
    bare = facts.where(F.size("bare") > 0).select("crawl_id", "host", "plain", F.explode("bare").alias("x")).select("crawl_id", "host", "plain", "x.*")
    hosts = bare.where((F.col("kind") != MINOR) & F.col("plain")).select("key", "host", "kind").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("hosts"), F.min("kind").alias("kind")).where(F.col("hosts") >= recurs)
    often = stored(hosts, "message-lines")
    unknown = often.where(F.col("kind") == CONTENT).select("key")
    places = facts.select("crawl_id", (F.size("bare") == 0).alias("full"), F.explode("keys").alias("key")).join(broadcast_if_small(unknown), "key", "left_semi")
    rare = places.groupBy("key").agg(F.count_if("full").alias("m"), F.count_if(~F.col("full")).alias("n")).where(F.col("m") * 10 <= F.col("n"))
    known = rare.select("key").unionByName(often.where(F.col("kind") != CONTENT).select("key")).select("key", F.lit(True).alias("known"))
    judged = bare.join(broadcast_if_small(known), "key", "left").groupBy("crawl_id").agg(
        F.count_if((F.col("kind") == CONTENT) & F.col("known").isNull()).alias("content"),
        F.count_if(F.col("kind") == MINOR).alias("minor"),
        F.count_if(F.col("kind") == SCRIPT).alias("script"),
        F.count_if((F.col("kind") == ERROR) | (F.col("kind") == CONTENT) & F.col("known")).alias("error"),
        F.count_if((F.col("kind") != MINOR) & F.col("known").isNull()).alias("alone"),
    )
    kind = F.when(F.col("error") > 0, "error").when(F.col("script") > 0, "script_notice")
    short = (F.col("content") == 0) & (F.col("minor") <= MINOR_LINES * (F.col("error") + F.col("script")))
    return judged.where(short).select("crawl_id", kind.alias("residue_kind"), F.when(F.col("alone") == 0, "recurrence").otherwise("wording").alias("evidence")).where("residue_kind is not null")


def residue_evidence(pages: DataFrame, id_col: str = "crawl_id", html_col: str = "html_content", url_col: str = "url", recurs: int = RECURS) -> DataFrame:
    """`(crawl_id, residue_kind, evidence)`: placeholder, filler, error or script_notice, each kind once per row of the table.

    Null, empty and blank content is no case; repeated rows each count under their own id, rows with null ids do not.
    """
    facts = stored(page_facts(pages, id_col, html_col, url_col), "page-facts")
    named = lambda df, kind: df.select("crawl_id", F.lit(kind).alias("residue_kind"), "evidence")
    found = named(_placeholders(facts, slot_fillings(facts)), "placeholder").unionByName(named(_filler(facts), "filler")).unionByName(_messages(facts, recurs))
    return found.groupBy("crawl_id", "residue_kind").agg(F.min("evidence").alias("evidence"))


def residue_rows(pages: DataFrame, id_col: str = "crawl_id", html_col: str = "html_content", url_col: str = "url", recurs: int = RECURS) -> DataFrame:
    """`(crawl_id, residue_kind)` of `residue_evidence`."""
    return residue_evidence(pages, id_col, html_col, url_col, recurs).select("crawl_id", "residue_kind")


def blank_slots(pages: DataFrame, id_col: str = "crawl_id", html_col: str = "html_content", url_col: str = "url", filled: int = FILLED) -> DataFrame:
    """`(crawl_id, n_blank)`: pages that leave a slot blank which some record fills with a variable and `filled` others in different ways.

    A blank is not shown as residue, so `residue_rows` does not count it.
    """
    found = stored(slot_fillings(stored(page_facts(pages, id_col, html_col, url_col), "page-facts")), "slot-fillings")
    slots = found.where("filling > 1").select("ctx", "filling").distinct().groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= filled)
    return found.where("filling = 0").join(broadcast_if_small(slots.select("ctx")), "ctx", "left_semi").groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n_blank"))


def without_residue(pages: DataFrame, found: DataFrame, id_col: str = "crawl_id") -> DataFrame:
    """The table without the rows that `found` names; all its columns, also rows with null ids or content."""
    bad = found.select(F.col("crawl_id").alias(id_col)).distinct()
    return pages.join(bad, id_col, "left_anti").select(*pages.columns)
