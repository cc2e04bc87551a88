"""What lines of a web page are furniture, from their own words and marks.

Plain Python over lists of strings, called inside Arrow batches.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

# Words that sentences of en, de, es, fr can hardly do without.
STOPWORDS = frozenset(
    "a an the of to in and for is are was were be been by on at as with from that this it its has had have not or but "
    "may can could will would after before between both each if while so near what who how why nobody few later than yet "
    "der die das ein eine einen einem einer und oder im am an auf aus bei mit nach nicht noch schon seit sich sind von vor "
    "war wurde zu zum zur den dem des für über ohne kaum als ist hat hatte zwischen "
    "el la los las un una unos unas y o en de del al con por para que se no si su sus fue es ha entre tras desde hasta lo "
    "le les des du au aux et ou dans sur sous par pour qui ne pas est sont a été une depuis sans puis ce cette ces son sa ses".split()
)

# Words of site menus in en, de, es, fr.
MENU_WORDS = frozenset(
    "home news sport sports culture science markets market health travel weather opinion opinions video videos podcasts podcast "
    "jobs archive archives contact business technology politics finance about search login menu subscribe world local "
    "start nachrichten wissen wirtschaft kultur meinung wetter reise archiv kontakt politik suche "
    "inicio noticias ciencia mercados cultura deporte deportes opinión tiempo viajes archivo contacto vídeo salud "
    "accueil actualités sciences marchés météo voyages vidéo santé économie".split()
)

# What notices, prompts and credits say in en, de, es, fr.
_NOTICE = (
    "cookie|rights reserved|rechte vorbehalten|derechos reservados|droits réservés|©|(c) 1|(c) 2|copyright|terms of use|privacy|imprint|impressum|datenschutz|aviso legal|privacidad|mentions légales"
    "|written consent|prior consent|may be copied|nachdruck|prohibida la copia|toute copie|views expressed|views given|liability|haftung|no responde de|avis publiés|adverts|advertisement|anzeige|werbung|publicidad|publicité"
    "|partners store"
).split("|")
_SHARE = (
    "share this|share it with|copy link|save for later|artikel teilen|geteilt)|compartir|partager|partages)|recommend|recomendado|empfohlen|recommandé|follow us|turn on alerts|active los avisos|activez les alertes"
    "|sign up|newsletter|in your inbox|subscribe|abonnieren|boletín|la lettre|articles a month"
).split("|")
_NAV = re.compile(r"^(?:skip to|back to top|open menu|menu\b|search\b|log in|nach oben|zum inhalt|volver arriba|ir al contenido|haut de page|aller au contenu)", re.I)
_BYLINE = re.compile(r"^(?:by|von|por|par|words ?:|text ?:|texto ?:|texte ?:|photo ?:|foto ?:|written by|edited by|posted on|published on|last changed|reporting by)\s|\bnewsdesk\b", re.I)
_LABEL = re.compile(
    r"^(?:tags?|topics|etiquetas|temas|schlagwörter|stichworte|themen|schlagworte|mots[- ]clés|étiquettes|sujets|related|see also|read (?:next|more|also)|more (?:on|from) th(?:is|e)|up next|lea también|ver también|más sobre"
    r"|lesen sie auch|siehe auch|mehr (?:zum|dazu)|auch interessant|à lire|lire aussi|voir aussi|sur le même)\b.{0,20}?:",
    re.I,
)
_COMMENT = re.compile(
    r"^[^\s:]+(?: [^\s:]+){0,3} (?:replied|commented|wrote|says?|answered|schrieb|antwortete|kommentierte|meinte|comentó|respondió|escribió|opinó|écrit|répondu|commenté|répond|commente) ?:", re.I
)
_PARTS = re.compile(r"\s{2,}|\s*[|·•>/›»]\s*|\s+[-–—]\s+|,\s+")
_ENDED = re.compile(r"[.!?…:;。！？][\"'”’»)\]*_]*$")
_SENTENCES = re.compile(r"(?<=[.!?:;]) ")
_MARK = re.compile(r"^(?:[-*•–—]|\d{1,3}[.)])\s+")
_NUMBERED = re.compile(r"^\d{1,3}[.)]\s+\S")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

# The styles of blanks that templates leave.
BLANK = re.compile(
    r"\{\{\s*[A-Za-z_][\w. ]*\s*\}\}|\{%\s*[\w. ]+\s*%\}|[$#]\{\s*[\w. ]+\s*\}|<%=?\s*[\w. ]+\s*%>|\[\[\s*[\w. ]+\s*\]\]|@@\w+@@|%%\w+%%|%[A-Z][A-Z_]{2,}%|__[A-Z][A-Z_]+__"
    r"|\[[A-Z][A-Z_]{2,}\]|\[[Ii]nsert [\w ]{2,40}\]|\[[\w ]{2,40} (?:goes )?here\]|\((?:your|insert) [\w ]{2,40} here\)|«[A-Z][A-Z_]{2,}»|\{\d\}",
    re.A,
)


def collapse(line: str) -> str:
    return " ".join(line.split())


def ended(line: str) -> bool:
    """Whether a line ends as sentences do."""
    return _ENDED.search(line[-12:]) is not None


def blanks(text: str) -> list[re.Match]:
    """Unfilled blanks of templates in text."""
    return list(BLANK.finditer(text)) if any(mark in text for mark in "{%<[@_(«$#") else []


def unmarked(line: str) -> str:
    """A line without the mark of a list entry."""
    return _MARK.sub("", line)


def is_numbered(line: str) -> bool:
    return _NUMBERED.match(line) is not None


def is_filler(line: str) -> bool:
    """Five words or more, most in lower case, none of them a function word of a known language; of a long line more than half its sentences."""
    if len(line) > 400:
        parts = [s for s in re.split(r"(?<=[.!?:;]) ", line) if s.count(" ") >= 3] or [line[i : i + 400] for i in range(0, len(line), 400)]
        return 2 * sum(is_filler(s[:400]) for s in parts) > len(parts)
    words = _WORD.findall(line)
    return len(words) >= 5 and sum(w.islower() for w in words) >= 0.8 * len(words) and not any(w.lower() in STOPWORDS for w in words)


def is_list_of_words(raw: str) -> bool:
    """Three parts or more of one or two words each, parted by signs or wide blanks, that don't end as a sentence."""
    parts = [p for p in _PARTS.split(raw.strip()) if p]
    return len(parts) >= 3 and all(len(p.split()) <= 2 for p in parts) and not ended(raw.rstrip())


_CUES = ahocorasick.Automaton()
for _cue in _NOTICE + _SHARE:
    _CUES.add_word(_cue, _cue)
_CUES.make_automaton()


def _told(text: str) -> bool:
    return next(_CUES.iter(text), None) is not None


def _furniture(raw: str) -> bool:
    line = collapse(raw)
    if not _WORD.search(line) or is_list_of_words(raw):
        return True
    if not ended(line):
        words = _WORD.findall(line)
        if sum(w.lower() in MENU_WORDS for w in words) >= 0.6 * len(words) or _NUMBERED.match(line) or (len(words) <= 12 and _BYLINE.search(line)):
            return True
    if _NAV.match(line) and line.count(" ") < 8:
        return True
    if ":" in line and (_LABEL.match(line) or _COMMENT.match(line)):
        return True
    low = line.lower()
    if not _told(low):
        return False
    # a cue counts where it stands in most of the sentences, so that an article may speak of such things
    parts = [s for s in _SENTENCES.split(low) if s.strip()]
    # a sentence about scripts asks for something and may be all a page says
    told = sum(_told(s) and "script" not in s and "skript" not in s for s in parts)
    return 2 * told >= len(parts) > 0 and line.count(" ") < 60 * max(1, told)


_short = lru_cache(maxsize=1 << 16)(_furniture)


def is_furniture(raw: str) -> bool:
    """Whether a line is a menu, notice, prompt, credit, label or comment."""
    # furniture comes back on page after page, so its lines are looked up rather than judged again
    return _short(raw) if len(raw) <= 240 else _furniture(raw)
