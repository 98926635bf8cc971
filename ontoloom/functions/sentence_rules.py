"""Segmentation rules: ordered break and no-break pairs of regular expressions, in cascading tables.

A rule decides a position if ``before`` matches text that ends there and ``after`` matches text that starts there. The rules
of the tables in use are tried in order, the first match decides. ``before`` ends at the last mark with its closing quotes and is matched
backwards, as far as it reaches; ``after`` starts right behind, with the blanks. ``at`` names the signs that may stand just before the position, for
rules that need one of them; an opening rule must match from the unit's first sign on.

Below, lists of abbreviations, months and the like are fixed values of the languages; the rest is logic.
"""

from __future__ import annotations

from typing import NamedTuple

#: Full stops of scripts without blanks, and all marks that can end a unit.
WIDE = "。！？｡।॥"
#: Quotations: pairs of opening and closing signs. Marks inside one don't end a unit, but for the last sign before its end.
QUOTATIONS = (("„", "“”"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ('"', '"'))
#: Signs that close a unit behind its mark.
CLOSERS = ")]）」』”»’›"
_CLOSING = CLOSERS + "\"“"


class Rule(NamedTuple):
    breaks: bool
    before: str
    after: str = ""
    at: str = ""
    opens: bool = False
    words: frozenset[str] = frozenset()


def _no(before: str, after: str = "", at: str = "", opens: bool = False) -> Rule:
    return Rule(False, before, after, at, opens)


def _yes(before: str, after: str = "", at: str = "") -> Rule:
    return Rule(True, before, after, at)


def _abbr(words: str, after: str = "", breaks: bool = False) -> Rule:
    """Whether there is a break after any of these words and their full stop."""
    last = {w.rpartition(".")[2].rpartition("-")[2].removeprefix(r"\s?") for w in words.split("|")}
    last = {x for w in last for x in ((w.replace("?", ""), w[:-2]) if w.endswith("?") else (w.replace("[àa]", "a"),))}
    return Rule(breaks, rf"(?<!\w)(?i:{words})\.", after, ".", False, frozenset(last))


#: Fixed values. Endings of file names.
FILE_ENDINGS = "conf|cfg|ini|log|sh|py|txt|out|err|yaml|yml|json|xml|csv|tar|gz|md|html|pdf"
#: Fixed values. Months of German dates, which follow an ordinal number.
MONTHS_DE = "Januar|Jänner|Februar|März|Maerz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
#: Fixed values. Time zones, which follow a time of day.
ZONES = "Central|Eastern|Pacific|Mountain|Standard|Greenwich|UTC|GMT|CET|CEST|EST|EDT|CST|CDT|PST|PDT|MST|MDT"
#: Fixed values. Words that a sentence goes on with but hardly starts with in small letters.
GOING_ON = "before|after|and|or|are|is|was|were|in|on|for|to|of|that|which|when|until|while|unless|because|und|oder|sind|ist|bis|et|ou|sont|est|y|o|son|es|e|são|é|и|или"
#: Those of them that don't look like articles in capitals.
GOING_ON_CAPITAL = "before|after|and|are|was|were|for|that|which|when|until|while|unless|because|und|oder|sind|sont|est|или"
#: Fixed values. Verbs whose object a quotation can be that ends the sentence.
REPORTING = "says?|said|prints?|printed|shows?|showed|reads?|reports?|reported|answers?|answered|asks?|asked|repl(?:y|ies|ied)|writes?|wrote|displays?|displayed|returns?|returned"
#: Fixed values. General English abbreviations: titles, which a name follows; those before a number; those that a sentence can also end with.
TITLES = "mr|mrs|ms|dr|prof|rev|gen|col|maj|capt|lt|sgt|pvt|st|hon|sen|rep|gov"
BEFORE_NUMBERS = "figs?|eqs?|secs?|sect|chs?|chap|vols?|nos?|pp?|refs?|tab|par|art"
COMPANIES = "inc|ltd|corp|co|bros|llc|jr|sr|etc|dept|univ|assn"
MEASURES = "min|max|avg|std|var|approx|ca|est|incl|ver|rel"


FIRST = [
    # list numbers belong to their unit
    _no(r"(?m:^)[ \t\u00a0]*[(]?\d{1,3}[.)]", r"[ \t\u00a0]", ".)"),
    _no(r"[(]?\d{1,3}[.)]", r"[ \t\u00a0]", ".)", opens=True),
    # numbers, versions, file names: a full stop without a blank behind it
    _no(r"\d\.", r"\d", "."),
    _no(r"\w\.", rf"(?i:(?:{FILE_ENDINGS})(?!\w))", "."),
    # an ellipsis goes on, unless a capital follows small letters
    _yes(r"[a-zß-ÿа-я]\s?(?:\.{2,}|…+)", r"\s+[A-ZÀ-ÞА-Я]", ".…"),
    _no(r"(?:\.{2,}|…+)", r"\s*\w", ".…"),
]

EN = [
    # times of day: those that open the sentence or stand before a zone or a small letter go on
    _no(r"(?:[(]?\d{1,3}[.)]\s+)?(?i:at|by|from|until|around|about|before|after|since|between)\s+\d{1,2}(?::\d\d)?\s+(?i:[ap]\.m)\.", r"\s", ".", opens=True),
    _no(r"\d\s+(?i:[ap]\.m)\.", rf"\s+(?:[a-zß-ÿ]|(?:{ZONES})\b|(?i:{ZONES}) TIME\b)", "."),
    _yes(r"\d\s+(?i:[ap]\.m)\.", r"\s", "."),
    _abbr(rf"e\.g|i\.e|vs|cf|viz|resp|{TITLES}"),
    _abbr(BEFORE_NUMBERS, r"\s+[\dIVX(]"),
    _abbr(r"app|annex|part|no", r"\s+(?:\d|[A-Z]\b)"),
    _abbr(rf"{COMPANIES}|{MEASURES}", r"\s*[a-zß-ÿ0-9,;:)]"),
    _abbr(MEASURES, r"\s"),
]
DE = [
    _no(r"\b\d{1,2}\.", rf"\s+(?:{MONTHS_DE}|(?i:{MONTHS_DE}))\b", "."),
    _abbr(r"bzw|vgl|z\.\s?b|d\.\s?h|u\.\s?a|o\.\s?ä|i\.\s?d\.\s?r|evtl|ggf|inkl|exkl|abb|abschn|kap|nr|bd|vers|str|tel|zzgl|bspw|sog|ca|hr|fr|mind|max"),
    _no(r"(?<!\w)(?i:[zduoi])\.", r"\s*(?i:[bhaäd])\.", "."),
]
FR = [
    _abbr(r"p\.\s?ex|c\.-[àa]-d|env|av|éd|n°|cf|m|mm|mme|mlle|art|chap|tél"),
    _abbr(r"fig|sect|chap|vers?|vol|p|al", r"\s+\d"),
    _no(r"(?<!\w)(?i:p)\.", r"\s*(?i:ex)\.", "."),
]
ES = [
    _abbr(r"p\.\s?ej|aprox|núm|num|apdo|pág|pag|sr|sra|srta|dr|dra|ud|uds|ee\.\s?uu|tel"),
    _abbr(r"fig|vers?|cap|art|n", r"\s+\d"),
    _no(r"(?<!\w)(?i:p)\.", r"\s*(?i:ej)\.", "."),
]
PT = [_abbr(r"secç|secc|núm|págs?|aprox|sr|sra|dr|dra|tel|exmo"), _abbr(r"fig|vers?|cap|art", r"\s+\d")]
RU = [
    _abbr(r"рис|разд|гл|стр|см|верс|вер|ок|т\.\s?е|напр|ср|им|ул|табл|п|тыс|млн|млрд|руб|коп"),
    _no(r"(?<!\w)(?i:т)\.", r"\s*(?i:[едкпч])\.", "."),
    _abbr(r"г|в", r"\s+[а-я]"),
]
HI = [_abbr("क्र|डॉ|श्री|पृ|सं|प्रो|रु")]
_SO_ON = r"etc|usw|т\.\s?д|т\.\s?п|др"
#: Word-like abbreviations that also close sentences: no break only where what follows shows that the sentence goes on.
CLOSING = [
    _abbr(_SO_ON, rf"\s+(?:{GOING_ON})\b"),
    _abbr(r"etc|usw|т\.\s?д", rf"\s+(?:{GOING_ON_CAPITAL.upper()})\b"),
    _abbr(_SO_ON, r"\s*[,;:)]"),
    _abbr(_SO_ON, r"\s", breaks=True),
]
QUOTES = [
    # a quotation that ends with a mark: the sentence goes on with a small letter, a comma, or a letter without case
    _no(r"[.!?…。！？।॥]\s?[\"”“»’」』]", r"\s*[,;:，；、：–—a-zß-ÿа-яё]", _CLOSING),
    _no(r"[.!?…।॥]\s?[\"”“»’]", r"\s*[ऀ-ॿ]", _CLOSING),
    _no(r"[.!?…。！？]\s?[\"”“»’」』]", r"[぀-ヿ㐀-鿿]", _CLOSING),
    # in capitals: the quotation ends the unit if it is the object of a reporting verb and no conjunction follows
    _no(r"[A-ZÀ-ÞА-Я][.!?…]\s?[\"”“»]", rf"\s+(?:{GOING_ON_CAPITAL.upper()})\b", _CLOSING),
    _yes(rf"\b(?:{REPORTING.upper()})\s+(?:\"[^\"]*\"|“[^”]*”|«[^»]*»)", r"\s", _CLOSING),
    _no(r"[A-ZÀ-ÞА-Я][.!?…]\s?[\"”“»]", r"\s+[A-ZÀ-ÞА-Я]{2,}(?![a-zß-ÿа-я])", _CLOSING),
]
LAST = [
    _yes(r"[。！？｡।॥][\"”“»’」』）)\]\s]*", "", WIDE + _CLOSING),
    _yes(r"[!?]+[\"”“»’)\]\s]*", r"\s|\w|[¿¡(\"“„«「『]", "!?" + _CLOSING),
    # initials: at the start of a unit or in a row; letters of an abbreviation before a small letter
    _no(r"[A-ZÀ-ÞА-Я]\.", r"\s+[A-ZÀ-ÞА-Я](?:\.|[a-zß-ÿа-я])", ".", opens=True),
    _no(r"(?<!\w)[A-ZÀ-ÞА-Я]\.", r"\s+[A-ZÀ-ÞА-Я]\.", "."),
    _no(r"(?<!\w)[A-ZÀ-ÞА-Я]\.\s+[A-ZÀ-ÞА-Я]\.", r"\s+[A-ZÀ-ÞА-Я][a-zß-ÿа-я]", "."),
    _no(r"(?:[A-ZÀ-ÞА-Я]\.){2,}", r"\s+[a-zß-ÿа-я]", "."),
    # a unit of measure of one letter ends a sentence like any word
    _yes(r"\d\s?[a-zа-я]\.", r"\s+[A-ZÀ-ÞА-Я]", "."),
    # other single letters with a full stop are parts of abbreviations, unless a version or appendix letter
    _no(r"(?<!\w)[a-zа-я]\.", r"\s*\w", "."),
    _no(r"(?<!\w)[A-ZА-Я]\.", r"[A-ZА-Я]\.", "."),
    _yes(r"\.[\"”“»’)\]]*", r"\s", "." + _CLOSING),
    # the blank is missing
    _yes(r"[^\W\d_]{2}\.[\"”“»’)\]]*", r"[¿¡(\"“„«]*[A-ZÀ-ÞА-Я][a-zß-ÿа-яё\s’']", "." + _CLOSING),
    _yes(r"[\d%)\"”»]\.?[\"”“»’)\]]*", r"[¿¡(\"“„«]*[A-ZÀ-ÞА-Я][a-zß-ÿа-яё]", "." + _CLOSING),
    _yes(r"[A-ZÀ-ÞА-Я]{2}\.[\"”“»’)\]]*", r"[¿¡(\"“„«]*[A-ZÀ-ÞА-Я]{2}", "." + _CLOSING),
    _yes(r"\.[\"”“»’)\]]*", r"[¿¡「『぀-ヿ㐀-鿿ऀ-ॿ]", "." + _CLOSING),
    _yes(r"[^\W\d_]{2}\.[\"”“»’)\]]*", r"[(\"“„«]\w|\d{1,3}\.\s", "." + _CLOSING),
]

#: The cascade: which tables are tried for a language, in order; "*" is the cascade for texts of unknown or mixed languages.
TABLES: dict[str, list[Rule]] = {"first": FIRST, "en": EN, "de": DE, "fr": FR, "es": ES, "pt": PT, "ru": RU, "hi": HI, "closing": CLOSING, "quotes": QUOTES, "last": LAST}
CASCADES: dict[str, tuple[str, ...]] = {
    "*": ("first", "quotes", "closing", "en", "de", "fr", "es", "pt", "ru", "hi", "last"),
    **{k: ("first", "quotes", "closing", k, "last") for k in ("en", "de", "fr", "es", "pt", "ru", "hi")},
    **{k: ("first", "quotes", "closing", "last") for k in ("zh", "ja")},
}
