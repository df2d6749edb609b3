"""Template residue, filler and error pages in a corpus.

Records that came from one template are aligned and its slots induced from
what differs between them, whatever it looks like. A text is cut into units
(sentences, lines, form fields); numbers, dates and tickers are masked, which
gives the unit's form. Two alignments of all forms of the corpus:

- whole units: forms that are equal once placeholders are masked as well are
  records of one template; a slot that others fill, or that holds different
  names in different records, is real;
- by what stands around: a gap of up to three words between equal neighbours
  (up to three words or marks on each side, three at least) holds different
  words in different records; a gap with four or more fillers is a slot. The
  gaps of suspected left-overs are looked up among the forms of all units, so
  words become slots without looking like placeholders.

What a slot retains is residue: a variable name, a default or a blank where
other records have a value.

- a form that no ordinary prose has ({{author}}, <<day>>, ____) is residue in
  any slot, even one that always holds the same words, unless its sentence
  speaks of it (an instruction how to write it, or words such as "the
  placeholder" beside it);
- a word in weak brackets counts in a real slot, or if its name is one that
  real slots carry elsewhere in the corpus;
- a bare variable name (customer_name, FIRST NAME), a bare default (undefined,
  N/A) and a blank (a space too many, or before a comma or full stop) count
  only in a slot induced by what other records hold there.

Placeholders that are quoted or stand in code are spoken of, not left over.
Units that only ever make up whole pages, never part of other texts, are page
templates; a page made of nothing but such units (heading and navigation
apart), however many, with an error, refusal or script notice among them is
excluded too, and so is a text with a unit of filler or a prompt to write some.
A longer text with a notice is judged twice: first by the texts that are plain
(short ones make page units, longer ones without a notice content), then with
its own units counted on the side on which it came out.

One pass over the texts in Python yields small rows and the forms, kept as a
table in the shared folder; the gaps are looked up in one pass over the
distinct forms, behind a bitmap of fixed size; all statistics are Spark
aggregates over the whole corpus (counts, minimum, maximum: nothing is
gathered).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import kept, spread

# Forms of placeholders that no ordinary prose has.
STRONG = [
    r"\$?\$\{[^{}\n]+\}",
    r"#\{[^{}\n]+\}",
    r"\{\{\{?[^{}\n]+\}\}\}?",
    r"\{%[^%\n]+%\}",
    r"\{!?[A-Za-z_][A-Za-z_. ]*\}",
    r"\{\d\}",
    r"<%=?[^%\n]+%>",
    r"<<[^<>\n]+>>",
    r"<[A-Za-z ]+ goes here>",
    r"<[A-Z]+(?:_[A-Z]+)+>",
    r"\[\[[^\[\]\n]+\]\]",
    r"\[(?i:your|insert|enter|add) [^\[\]\n]+\]",
    r"\[[A-Z]+(?:_[A-Z]+)+\]",
    r"%\([A-Za-z_]+\)[sdf]",
    r"%[A-Z][A-Z_]+%",
    r"\*\|[^|\n]+\|\*",
    r"@@[A-Za-z_]+@@",
    r"\$\$[A-Za-z_]+\$\$",
    r"\$[A-Z]+(?:_[A-Z]+)+\b",
    r"\((?i:[a-z ]+ to be (?:inserted|filled in|added|completed|confirmed))\)",
    r"&lt;[A-Za-z_ ]+&gt;",
    r"%\d+\$[sdf]",
    r"(?<![_\w])_{4,}(?![_\w])",
]
# Forms that prose has as well; the name decides.
WEAK = [
    r"\[[A-Za-z][A-Za-z_]*\]",
    r"<[A-Za-z][A-Za-z_]*>",
    r"(?<![\w:]):[a-z][a-z_]+:(?![\w:])",
    r"\$[A-Z]{3,}\b",
    r"(?<!\w)%[A-Za-z_]{2,}%",
    r"(?<!\w)__[A-Za-z][A-Za-z_]+__(?!\w)",
    r"(?<!\w)@[a-z]+_[a-z_]+\b",
    r"\b(?:TBD|TBC|TODO|FIXME)\b",
    *[rf"(?<![\w{m}]){m}{{1,3}}[A-Za-z][A-Za-z_]+{m}{{1,3}}(?![\w{m}])" for m in (r"\?", "~", r"\^", "#", r"\|", "=", "!", "§")],
]
# What stands before or after a placeholder that is spoken of.
SPOKEN_BEFORE = regex.compile(
    r"""(?ix)
      ^\W*(?:please\s+)?(?:mark|tag|label|write|note|enter|type|record|flag|list|name|spell|denote|log)\b[^.;:]*\bas\s*$
    | ^\W*(?:schreiben|markieren|notieren|kennzeichnen|bezeichnen)\s+sie\b[^.;:]*\bals\s*$
    | ^\W*(?:écrivez|notez|marquez|indiquez|saisissez)\b[^.;:]*\bcomme\s*$
    | ^\W*(?:escriba|anote|marque|indique|introduzca)\b[^.;:]*\bcomo\s*$
    | \b(?:placeholders?|variables?|macros?|merge\s+fields?|wildcards?|platzhaltern?|variablen|marcador(?:es)?|espaces?\s+réservés?)\s+(?:(?:called|named|such\s+as|like|namens|wie|llamad[oa]s?|como|nommée?s?|comme)\s+)?$
    """
)
SPOKEN_AFTER = regex.compile(r"(?i)^\s+(?:is|are|ist|sind|est|sont|es|son)\s+(?:an?\s+|the\s+|eine?\s+|une?\s+|una\s+|des\s+)?(?:placeholders?|variables?|macros?|wildcards?|platzhalter|variablen?|marcador(?:es)?|espaces?\s+réservés?)\b|^\s+stands?\s+for\b")
# What joins a placeholder to the one spoken of before it.
SPOKEN_ON = regex.compile(r"(?i)^\W*(?:(?:for\s+(?:instance|example)|e\.\s?g\.|or|and|zum\s+beispiel|z\.\s?b\.|oder|und|par\s+exemple|ou|et|por\s+ejemplo|o|y)\W*)*$")
# Words of the customary dummy text.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "metus nullam libero donec tempus justo massa turpis faucibus eget pretium vitae sapien orci mauris felis augue nibh luctus ligula porta ac vel ante arcu at auctor bibendum blandit condimentum congue convallis cras curabitur cursus dapibus diam dictum dignissim dui egestas eleifend elementum erat eros etiam euismod facilisis fames fermentum feugiat finibus fringilla fusce gravida habitant hendrerit iaculis imperdiet integer interdum lacinia lacus laoreet lectus leo lobortis maecenas magnis malesuada mattis maximus molestie mi morbi nec neque netus nunc odio ornare pellentesque pharetra phasellus placerat porttitor posuere potenti praesent primis proin pulvinar purus quam quisque rhoncus risus rutrum sagittis scelerisque sem semper senectus sodales sollicitudin suscipit suspendisse tellus tincidunt tortor tristique ullamcorper ultrices ultricies urna varius vehicula venenatis vestibulum vivamus viverra volutpat vulputate".split()
)
# Prompts to write something, in the languages of the corpus.
PROMPTS = regex.compile(
    r"""(?ix) \W*(?:
      (?:please\s+)?(?:enter|write|type|add|insert|put|describe|paste|provide)\s+(?:a|an|your|the|some)\b.*\bhere\b.*
    | your\s.+\s(?:goes\s|text\s)?here
    | click\s+(?:here\s+)?to\s+(?:edit|add|change)\b.*
    | placeholder\s+(?:paragraph|text|copy)\b.*
    | (?:this\s+is\s+)?(?:some\s+)?(?:sample|dummy|filler|example)\s+(?:text|copy|content|paragraph)\b.*
    | replace\s+(?:it|this(?:\s+text)?)\s+with\s+your\s+own.*
    | keep\s+it\s+to\s+two\s+or\s+three\s+lines
    | (?:text|content|copy)\s+(?:to\s+(?:come|follow)|coming\s+soon).*
    | (?:beispiel|blind|platzhalter|muster)text\b.*
    | (?:hier|bitte)\s+(?:.*\s)?text\s+(?:eingeben|einfügen|einsetzen|ergänzen).*
    | (?:ihr|dein)\s+text\s+(?:steht\s+)?hier.*
    | hier\s+(?:steht|kommt)\s+(?:ihr|dein)\s+text.*
    | ici\s+(?:vient\s+)?votre\s+texte.*
    | aquí\s+(?:va\s+)?(?:su|tu|el)\s+texto.*
    | (?:geben|fügen|schreiben)\s+sie\s+hier\s.*
    | texte\s+(?:de\s+remplissage|d['’]exemple|provisoire)\b.*
    | votre\s+(?:texte|contenu)\s+ici.*
    | (?:saisissez|entrez|écrivez|insérez|ajoutez)\s.*\bici\b.*
    | texto\s+(?:de\s+(?:ejemplo|relleno)|provisional)\b.*
    | (?:su|tu)\s+texto\s+aquí.*
    | (?:escriba|introduzca|inserte|añada|escribe)\s+aquí\b.*
    )\W*$"""
)
# One of these stands in whatever PROMPTS finds.
PROMPT_WORDS = "here click placeholder sample dummy filler example replace keep text copy content ici aquí hier relleno ejemplo provisional provisoire".split()
# A prompt starts a unit, a capitalised word or what follows a mark of separation.
PROMPT_START = re.compile(r"^\S|(?<=\s)[^\w\s]{0,3}[A-ZÉÁ]\S|(?<=[:–—|>=-])\s*[^\w\s]{0,3}[^\W\d]|(?<=[(\[*])[A-ZÉÁ]\S")
#: A run of so many words of dummy text, so many of them different ones of four letters or more, is no chance.
RUN, RUN_LONG = 4, 3
# What error pages, refusals and script notices say.
NOTICE = regex.compile(
    r"""(?ix)
      \b(?:error|erreur|fehler|http(?:\s+status)?)\s*:?\s*[1-5]\d\d\b
    | (?<![\d.:-])[45]\d\d\b.{0,40}(?:forbidden|not\s+found|bad\s+gateway|gateway|unavailable|time-?out|error|gone|nginx|apache|could\s+not\s+be\s+found)
    | not[_\s-]found | \bcould\s+not\s+be\s+(?:found|established|loaded|reached) | page\s+introuvable | página\s+no\s+encontrada | seite\s+nicht\s+gefunden
    | internal\s+server\s+error | interner\s+serverfehler | error\s+interno | erreur\s+interne
    | bad\s+gateway | gateway\s+time-?out | service\s+unavailable | proxy\s+error | (?:request|connection)\s+timed\s+out | connection\s+(?:refused|reset)
    | did\s+not\s+answer\s+within | certificate\s+expired | too\s+many\s+requests | scheduled\s+maintenance | under\s+maintenance
    | access\s+denied | zugriff\s+verweigert | acceso\s+denegado | accès\s+refusé | (?:do\s+not|don['’]t)\s+have\s+permission | (?:request|access)\s+(?:was|has\s+been)\s+blocked | \bforbidden\b
    | session\s+has\s+expired | sitzung\s+ist\s+abgelaufen | sesión\s+ha\s+caducado | session\s+a\s+expiré | sign\s+in\s+(?:again\s+)?to\s+(?:continue|read) | limit\s+of\s+free
    | (?:enable|activate|switch\s+on|turn\s+on|allow|aktivieren\s+sie|active|activer|activez|requires?|benötigt|requiere|nécessite|need\s+to)\b.{0,30}\b(?:javascript|scripts?|scripting|js)\b
    | \b(?:javascript|scripts?|scripting|js|skripte?)\b.{0,50}\b(?:is\s+required|required|disabled|enabled|turned\s+off|switched\s+off|off|allowed|ausgeschaltet|deaktiviert|desactivados|deshabilitados|désactivés)\b
    | script-capable\s+browser | does\s+not\s+support\s+scripts
    | unable\s+to\s+load | something\s+went\s+wrong | unexpected\s+(?:problem|error) | (?:isn['’]t|is\s+not)\s+available\s+(?:right\s+)?now | does\s+not\s+exist\s+on\s+this\s+server
    | ^traceback\b | stopped,\s+exit\s+code | cannot\s+read\b.{0,60}\bon\s+line\b | checking\s+your\s+(?:browser|connection) | was\s+taken\s+down | ^nothing\s+here\b | link\s+may\s+be\s+broken
    """
)
# What goes along with such notices.
BESIDE = regex.compile(
    r"""(?ix)
      try\s+again | inténtelo | réessayer | erneut | retry | reload | refresh | \b(?:request|reference|trace|ray|incident|event)\s+(?:id\b|[0-9a-f]*\d) | \bkennung\b | \bréférence\b | \breferencia\b
    | ^oops | ^sorry | ^loading | ^back\s+at | ^please\b | team\s+has\s+been | contact\s+(?:support|us) | sign\s+in | log\s+in | melden\s+sie | reconnecter | iniciar\s+sesión | if\s+you\s+think\s+this | removed | allow\s+it | turn\s+them\s+on | will\s+not\s+load | closed\s+the\s+connection | gone | moved
    | check\s+(?:that\s+)?(?:the|your)\s+(?:web\s+)?(?:address|url|spelling|link|connection|network|browser|internet) | (?:go\s+back|return)\s+to\s+the\s+(?:home|start|front|main|previous|last)\b | clear\s+(?:your|the)\s+(?:browser\s+)?(?:cache|cookies) | ^(?:status|status\s+code|error\s+code|cause|host|server|url|path|timestamp|client\s+ip|your\s+ip|what\s+(?:happened|you\s+can\s+do)\??|possible\s+(?:causes?|reasons?)|you\s+(?:can|may|could)\s+(?:also\s+)?try)\s*(?::|$) | ^(?:e-?mail|phone|telephone|help\s?desk|support)\s*:
    | (?:über)?prüfen\s+sie\s+(?:die|ihre)\s+(?:adresse|url|verbindung|schreibweise|internetverbindung) | wenden\s+sie\s+sich\s+an | vérifiez\s+(?:l['’]adresse|l['’]url|votre\s+connexion|l['’]orthographe) | contactez | (?:compruebe|verifique)\s+(?:la\s+dirección|la\s+url|su\s+conexión) | póngase\s+en\s+contacto
    | ^file\b.{0,200},\s+line\s+\d+ | ^at\s+[\w.$<>/]+\s?\( | ^caused\s+by\b | ^(?:[a-z_]\w*\.)*[a-z]\w*(?:error|exception)(?:\s*:|$) | ^\.{3}\s+\d+\s+more$
    """
)
# The line of a trace that is followed by a line of code.
TRACE = regex.compile(r"(?i)^file\b.{0,200},\s+line\s+\d+")
# One of these stands in whatever NOTICE finds (tested against it); saves time.
STEMS = "error erreur fehler http forbidden gateway unavailable timeout time-out gone nginx apache could introuvable encontrada gefunden timed connection answer certificate requests maintenance denied verweigert denegado refusé permission blocked expired abgelaufen caducado expiré limit script js skript unable unexpected available exist traceback stopped cannot checking taken broken".split() + ["not found", "not_found", "not-found", "sign in", "nothing here", "went wrong"]
# Lines that only serve to move about a page.
NAVIGATION = regex.compile(r"(?i)^[\s«»|<>/·•-]*(?:(?:skip to content|back to (?:overview|top|start|list)|home|charts|help|menu|login|log in|contact|previous|next|about|search|imprint|overview)[\s«»|<>/·•-]*)+$")
TAGS = regex.compile(r"</?(?:html|head|body|title|div|p|h[1-6]|hr|br|noscript|span|center|b|i|em|strong|pre|section|article|main|meta|ul|ol|li|a|table|tr|td|th)(?:\s[^<>]*)?/?>", regex.I)
FENCE = re.compile(r"```.*?(?:```|$)", re.S)
# Each pattern begins with the set of its first characters, by which texts are skipped through fast.
QUOTED = re.compile(r"[`“«„‘\"'](?:(?<=`)[^`\n]+`|(?<=“)[^”\n]+”|(?<=«)[^»\n]+»|(?<=„)[^“”\n]+[“”]|(?<=‘)[^’\n]+’|(?<=\")[^\"\n]+\"|(?<=')(?<!\w')[^'\n]+'(?!\w))")
LINES = re.compile(r"[\r\n\v\f\x85  ]+")
SENTENCES = regex.compile(r"(?<=[.?!])[\s﻿]+(?=[\p{Lu}¿¡\"“«'`\[\{<$%#@*:(_-]|[\p{So}])")
CANDIDATE = re.compile("|".join([f"(?P<s{i}>{p})" for i, p in enumerate(STRONG)] + [f"(?P<w{i}>{p})" for i, p in enumerate(WEAK)]))
VALUE = re.compile(
    r"[0-9a-f](?<!\w[0-9a-f])(?=[0-9a-f]{7})(?=[0-9a-f]*\d|(?<=\d))(?=[0-9a-f]*[a-f]|(?<=[a-f]))[0-9a-f]+\b"  # a hexadecimal number of eight digits or more
    r"|[-+−0-9](?:(?<=\d)|(?=\d))\d*(?:[.,:/-]\d+)*"  # a number, date or time
    r"|[A-Z](?<!\w[A-Z])[A-Z]{2}\b"  # a ticker
)
MAY_OPEN = re.compile(r"[\[{<%$@*_&?~^#|=!§]\s?[\w({%$!#@|&]")
MAY_OPEN_COLON = re.compile(r":\w+:")
# Words that stand in the placeholders that have no mark.
OPEN_WORDS = ["to be ", "tbd", "tbc", "todo", "fixme"]
# What a slot may retain that is no placeholder by its form; counts only in an induced slot.
BARE = re.compile(r"(?<![\w.@/\\])[a-z]+(?:_[a-z]+)+(?![\w(@/\\])|\b[A-Z]{2,}(?:[ _][A-Z]{2,})+\b|(?<![\w.])(?:undefined|null|None|NaN|N/A)(?!\w)|(?<=\w)\s(?=[,.](?:\s|$))|\x02")
BARE_SIGNS = ("_", " ,", " .", "\x02", "undefined", "null", "None", "NaN", "N/A")
CAPS = re.compile(r"[A-Z]{2}[ _][A-Z]{2}")
#: A run of blanks between words of a line whose other gaps are single.
WIDE = re.compile(r"(?<=[\w,])  +(?=\w)")
SLOT, OPEN = "\x00", "\x03"
#: Words and marks of a form, as gaps see them.
TOKENS = re.compile(r"[,;:.!?()]|[^\s,;:.!?()]+")
MARKS = frozenset(",;:.!?()")
#: Neighbours of a gap on each side, the fewest of them in all, words in a gap, fillers of a slot.
SIDE, LEAST, WIDTH, VARIES = 3, 3, 3, 4
#: Bits of the bitmap of gaps looked for: 1 MB, whatever the corpus.
BITMAP = 1 << 23
#: A text of up to so many units, heading and navigation apart, shows page units by itself; of longer ones the notice decides.
SHORT = 5
HALF, WRAP = 1 << 63, 1 << 64
#: Odd multipliers of the digests of neighbours.
FOLD, BETWEEN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SAYS_STEM, PROMPT_STEM, LATIN_STEM, OPEN_STEM = 1, 2, 4, 8


def _stems() -> ahocorasick.Automaton:
    """One automaton for all words without which a costlier pattern finds nothing."""
    found: dict[str, int] = {}
    for flag, words in ((SAYS_STEM, STEMS), (PROMPT_STEM, PROMPT_WORDS), (LATIN_STEM, [w for w in LATIN if len(w) >= 4]), (OPEN_STEM, OPEN_WORDS)):
        for w in words:
            found[w] = found.get(w, 0) | flag
    out = ahocorasick.Automaton()
    for w, flag in found.items():
        out.add_word(w, flag)
    out.make_automaton()
    return out


STEM_SEARCH = _stems()


def stems(low: str) -> int:
    flags = 0
    for _, flag in STEM_SEARCH.iter(low):
        flags |= flag
    return flags


def _name(value: str) -> str:
    """The variable name within a placeholder, in one notation."""
    words = re.sub(r"(?i)\b(your|insert|enter|add|goes here|here|to be (inserted|filled in|added|completed|confirmed))\b", " ", value)
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", words)
    return re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9]+", "_", words)).strip("_").lower()


def _skeleton(unit: str) -> str:
    return VALUE.sub(SLOT, unit).lower().strip(" .,:;!?")


def repeated_phrase(words: list[str]) -> bool:
    """Nothing but one or few short phrases over and over."""
    n = len(words)
    if n < 4:
        return False
    for k in (1, 2, 3):
        if n >= max(4, 2 * k) and all(words[i] == words[i % k] for i in range(n)):
            return True
    return n >= 5 and len(set(words)) <= max(2, n // 2) and max(Counter(words).values()) >= 3 and all(len(w) <= 5 for w in words)


def latin_run(words: list[str]) -> bool:
    """A run of dummy Latin that stands by itself: it opens the unit, follows a
    mark of separation, or is capitalised and closes the unit. One within a
    sentence is spoken of.
    """
    bare = [w.strip(".,;:!?()[]*_\"'–—-|").lower() for w in words]
    known = [not w or w in LATIN for w in bare]
    i = 0
    while i < len(words):
        if not known[i]:
            i += 1
            continue
        j = i
        while j < len(words) and known[j]:
            j += 1
        run = [w for w in bare[i:j] if w]
        if len(run) >= RUN and len({w for w in run if len(w) >= 4}) >= RUN_LONG:
            first = next(k for k in range(i, j) if bare[k])
            apart = first == 0 or words[first - 1][-1] in ":–—-|>.)" or (words[first].lstrip("([*_\"'")[:1].isupper() and j == len(words))
            if apart:
                return True
        i = j
    return False


def is_filler(unit: str, low: str | None = None, flags: int | None = None) -> bool:
    """Dummy text or a prompt to write something, in place of content.

    A word three times in a row is dummy text wherever it stands; a prompt, or a
    run of dummy Latin, may follow a lead of any length on its line.
    """
    low = unit.lower() if low is None else low
    flags = stems(low) if flags is None else flags
    raw = low.split()
    if len(raw) >= 3:
        repeats = len(raw) - len(set(raw)) >= 2
        latin = flags & LATIN_STEM and len(raw) >= 4 and sum(w.strip(".,;:!?") in LATIN for w in raw[:4]) >= 3
        if latin or (repeats and (3 * len(set(raw)) <= 2 * len(raw) + 6 or any(a[:3] == b[:3] for a, b in zip(raw, raw[1:])))):
            words = [w for w in (w.strip(".,;:!?") for w in raw) if w]
            if any(a == b == c and len(a) > 2 and a.isalpha() for a, b, c in zip(words, words[1:], words[2:])):
                return True
            if latin and sum(w in LATIN for w in words) >= 0.85 * len(words):
                return True
            if 3 * len(set(words)) <= 2 * len(words) and repeated_phrase(words):
                return True
        if flags & LATIN_STEM and latin_run(unit.split()):
            return True
    return bool(flags & PROMPT_STEM) and any(PROMPTS.match(unit, m.start()) for m in PROMPT_START.finditer(unit))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - HALF


def _left(tokens: list[str], i: int) -> list[str]:
    """The neighbours before position i, nearest last; a mask ends them, the start of the unit is one."""
    out: list[str] = []
    while len(out) < SIDE:
        i -= 1
        if i < 0:
            return ["^", *out]
        if SLOT in tokens[i] or OPEN in tokens[i]:
            break
        out.insert(0, tokens[i])
    return out


def _right(tokens: list[str], j: int) -> list[str]:
    out: list[str] = []
    while len(out) < SIDE:
        if j >= len(tokens):
            return [*out, "$"]
        if SLOT in tokens[j] or OPEN in tokens[j]:
            break
        out.append(tokens[j])
        j += 1
    return out


def _fold(tokens: list[str]) -> int:
    """A digest of a sequence of tokens from their own, in numbers that wrap at 64 bits (as _fillers() has them in arrays)."""
    out = 0
    for t in tokens:
        out = (out * FOLD + xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))) % WRAP
    return out


def _signed(x: int) -> int:
    return x - WRAP if x >= HALF else x


def _gap(left: list[str], right: list[str]) -> int | None:
    """The gap between these neighbours, None if they are too few to tell a template by."""
    if sum(x not in "^$" for x in left) + sum(x not in "^$" for x in right) < LEAST:
        return None
    return _signed((_fold(left) * BETWEEN + _fold(right)) % WRAP)


def _gaps_of(form: str) -> list[tuple[int | None, int]]:
    """(gap, digest of its left side) of each OPEN of a form, in order."""
    tokens = TOKENS.findall(form.replace(OPEN, f" {OPEN} "))
    return [(_gap(left := _left(tokens, i), _right(tokens, i + 1)), _signed(_fold(left))) for i, t in enumerate(tokens) if t == OPEN]


def _masked(unit: str, spans: list[tuple[int, int]], mark: str) -> str:
    pieces, at = [], 0
    for a, b in spans:
        pieces += [unit[at:a], mark]
        at = b
    return _skeleton("".join([*pieces, unit[at:]]))


def _open_slots(unit: str, found: list) -> tuple[str, list[tuple]]:
    """The form of a unit with placeholders; (form, slot, value, strong form, spoken of?, gap, left side) of each."""
    values, at, k, spoken = [], 0, 0, False
    for m in found:
        before = unit[at : m.start()]
        k += len(VALUE.findall(before))
        spoken = (spoken and bool(SPOKEN_ON.match(before))) or bool(SPOKEN_BEFORE.search(unit, 0, m.start()) or SPOKEN_AFTER.match(unit[m.end() :]))
        values.append((k, m.group(), m.lastgroup[0] == "s", spoken))
        k += 1
        at = m.end()
    spans = [m.span() for m in found]
    form, gaps = _masked(unit, spans, SLOT), _gaps_of(_masked(unit, spans, OPEN))
    return form, [(form, *v, *g) for v, g in zip(values, gaps)]


def _bare(unit: str) -> list[tuple]:
    """(form, slot, value, strong form, spoken of?, gap, left side) of bare names, defaults and blanks; slot -1."""
    found = list(BARE.finditer(unit))
    spans = [m.span() for m in found]
    form, gaps = _skeleton(unit.replace("\x02", " ")), _gaps_of(_masked(unit, spans, OPEN))
    spoken = [bool(SPOKEN_BEFORE.search(unit, 0, m.start()) or SPOKEN_AFTER.match(unit[m.end() :])) for m in found]
    return [(form, -1, m.group().strip("\x02"), False, x, *g) for m, x, g in zip(found, spoken, gaps) if g[0] is not None]


def _units(text: str) -> Iterator[tuple[str, bool]]:
    """(unit, heading?) of a text; a mark stands for what is quoted, one for a blank too wide, code is left out."""
    if "```" in text:
        text = FENCE.sub(" ", text)
    # Quoted passages are spoken of.
    text = QUOTED.sub(lambda m: " \x01 " if len(m.group()) > 12 or CANDIDATE.search(m.group()) else m.group(), text)
    if "<" in text:
        text = TAGS.sub("\n", text)
    lines = LINES.split(text)
    if "  " in text:
        lines = [WIDE.sub(" \x02 ", x) if 0 < 4 * len(WIDE.findall(x)) <= len(x.split()) else x for x in lines]
    lines = [x for x in (" ".join(x.split()).strip(" \ufeff\u200b") for x in lines) if x]
    for n, line in enumerate(lines):
        if NAVIGATION.match(line):
            continue
        heading = n == 0 and len(lines) > 1 and line[-1:] not in ".!?…" and len(line.split()) <= 8 and not says_notice(line)
        for sentence in SENTENCES.split(line):
            if ": " in sentence and MAY_OPEN.search(sentence):
                first = CANDIDATE.match(sentence)
                if first and sentence[first.end() : first.end() + 2] == ": ":
                    yield sentence[: first.end() + 1], heading
                    sentence = sentence[first.end() + 2 :]
            sentence = sentence.strip()
            if sentence:
                yield sentence, heading


def says_notice(unit: str, flags: int | None = None) -> bool:
    flags = stems(unit.lower()) if flags is None else flags
    return bool(flags & SAYS_STEM) and bool(NOTICE.search(unit))


def analyse(text: str) -> tuple[list[str], list[tuple], bool, list[tuple[str, bool, bool]], bool]:
    """(forms without placeholders, suspects, filler?, page units, short?) of one text.

    Suspects: as of _open_slots() and _bare(). Page units, all but the heading
    of a text that says a notice: (form, says a notice, goes along), each once.
    """
    filled: list[str] = []
    open_: list[tuple] = []
    content: list[tuple[str, str]] = []
    says: list[bool] = []
    filler = False
    caps = CAPS.search(text) is not None
    may_bare = caps or "  " in text or any(x in text for x in BARE_SIGNS)
    for unit, heading in _units(text):
        bare = may_bare and (any(x in unit for x in BARE_SIGNS) or (caps and CAPS.search(unit) is not None))
        suspects = _bare(unit) if bare else []
        if "\x02" in unit:
            unit = " ".join(unit.replace("\x02", " ").split())
        low = unit.lower()
        flags = stems(low)
        quotes = "\x01" in unit
        filler = filler or (not quotes and is_filler(unit.lstrip("-*• "), low, flags))
        may = flags & OPEN_STEM or MAY_OPEN.search(unit) or (":" in unit and MAY_OPEN_COLON.search(unit))
        found = list(CANDIDATE.finditer(unit)) if may and unit.strip("_ ") else []  # a line of underscores is a rule
        if found:
            skeleton, values = _open_slots(unit, found)
            open_.extend(values)
        else:
            skeleton = _skeleton(unit)
            filled.append(skeleton)
            open_.extend(suspects)
        if not heading:
            content.append((skeleton, unit))
            says.append(not quotes and says_notice(unit, flags))
    page: dict = {}
    if any(says):
        before = ["", *(u for _, u in content)]
        page = dict.fromkeys((k, x, bool(BESIDE.search(u) or TRACE.search(b))) for (k, u), x, b in zip(content, says, before))
    return filled, open_, filler, list(page), 0 < len(content) <= SHORT


ROWS = "kind string, doc_id bigint, skeleton bigint, form string, slot int, value string, name string, strong boolean, spoken boolean, gap bigint, lead bigint, text bigint, short boolean, notice boolean, beside boolean, long_n bigint, short_n bigint, maybe_n bigint"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c, _KINDS[kind]) for c, kind in (x.split() for x in ROWS.split(", "))])


def _storable(form: str) -> str:
    return form.encode("utf-8", "replace").decode()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        counts: dict[str, Counter] = {"long_n": Counter(), "short_n": Counter(), "maybe_n": Counter()}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text or not text.strip():
                continue
            filled, open_, filler, page, short = analyse(text)
            counts["short_n" if short else "maybe_n" if page else "long_n"].update(set(filled))
            for skeleton, slot, value, strong, spoken, gap, lead in open_:
                out.append({"kind": "open", "doc_id": doc, "skeleton": _digest(skeleton), "slot": slot, "value": value, "name": _name(value), "strong": strong, "spoken": spoken, "gap": gap, "lead": lead})
            if filler:
                out.append({"kind": "filler", "doc_id": doc})
            for skeleton, notice, beside in page:
                out.append({"kind": "page", "doc_id": doc, "skeleton": _digest(skeleton), "text": _digest(text), "short": short, "notice": notice, "beside": beside})
        if keys := list(set().union(*counts.values())):
            units = {"kind": ["unit"] * len(keys), "skeleton": [_digest(x) for x in keys], "form": [_storable(x) for x in keys]} | {c: [n[x] for x in keys] for c, n in counts.items()}
            yield pa.RecordBatch.from_arrays([pa.array(units[f.name], f.type) if f.name in units else pa.nulls(len(keys), f.type) for f in _SCHEMA], schema=_SCHEMA)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def _bitmap(wanted: DataFrame) -> bytes | None:
    """The bitmap of the digests in wanted.x, at most BITMAP / 64 words; None if there are none."""
    bit = F.pmod("x", F.lit(BITMAP))
    words = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(x & 63 AS INT))")).alias("bits")).collect()
    if not words:
        return None
    out = np.zeros(BITMAP // 64, np.int64)
    out[[w.word for w in words]] = [w.bits for w in words]
    return out.tobytes()


def _asked(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = (x & np.uint64(BITMAP - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _stands(forms: pa.Array, bits: np.ndarray) -> set[tuple[int, int]]:
    """(gap, digest of what stands in it) of the gaps in the bitmap, for a batch of forms: arrays over all their tokens."""
    split = pa.compute.utf8_split_whitespace(pa.compute.replace_substring_regex(forms, r"([,;:.!?()])", r" \1 "))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    form = np.repeat(np.arange(len(split)), pa.compute.fill_null(pa.compute.list_value_length(split), 0).to_numpy(zero_copy_only=False))
    some = np.array([w != "" for w in words], bool)
    code, form = code[some[code]], form[some[code]]
    n = len(code)
    if not n:
        return set()
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[code]
    mask = np.array([SLOT in w for w in words], bool)[code]
    stop = mask | np.array([w in MARKS for w in words], bool)[code]
    i = np.arange(n)
    new = np.concatenate(([True], form[1:] != form[:-1]))
    start = np.maximum.accumulate(np.where(new, i, 0))
    end = np.concatenate((np.flatnonzero(new)[1:], [n]))[np.cumsum(new) - 1]
    fold, between = np.uint64(FOLD), np.uint64(BETWEEN)
    # Left of each token: neighbours since the last mask or the start of the form.
    last_mask = np.concatenate(([-1], np.maximum.accumulate(np.where(mask, i, -1))[:-1]))
    n_left = np.minimum(i - np.maximum(last_mask + 1, start), SIDE)
    left = np.where((i - start < SIDE) & (last_mask < start), np.uint64(xxhash.xxh64_intdigest("^")), np.uint64(0))
    for d in range(SIDE, 0, -1):
        left = np.where(d <= n_left, left * fold + h[np.maximum(i - d, 0)], left)
    # Right of a gap that ends before each token: neighbours up to the next mask or the end of the form.
    next_mask = np.minimum.accumulate(np.where(mask, i, n)[::-1])[::-1]
    n_right = np.minimum(np.minimum(next_mask, end) - i, SIDE)
    right = np.zeros(n, np.uint64)
    for d in range(SIDE):
        right = np.where(d < n_right, right * fold + h[np.minimum(i + d, n - 1)], right)
    dollar = np.uint64(xxhash.xxh64_intdigest("$"))
    right = np.where((end - i < SIDE) & (next_mask >= end), right * fold + dollar, right)
    found = set()
    i = np.flatnonzero(~stop & _asked(bits, left))
    for width in range(1, WIDTH + 1):
        i = i[(i + width <= end[i]) & ~stop[np.minimum(i + width - 1, n - 1)]]
        closed, j = i + width == end[i], np.minimum(i + width, n - 1)
        gap = left[i] * between + np.where(closed, dollar, right[j])
        ok = (n_left[i] + np.where(closed, 0, n_right[j]) >= LEAST) & _asked(bits, gap)
        found.update((g, _digest(" ".join(words[c] for c in code[k : k + width]))) for g, k in zip(gap[ok].astype(np.int64).tolist(), i[ok].tolist()))
    return found


def _fillers(forms: DataFrame, wanted: bytes) -> DataFrame:
    """(gap, filler): what stands in the gaps of the bitmap, over all forms, each once a batch."""
    shared = forms.sparkSession.sparkContext.broadcast(wanted)  # BITMAP / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            if found := _stands(batch.column(0), bits):
                gap, filler = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(gap, pa.int64()), pa.array(filler, pa.int64())], names=["gap", "filler"])

    return forms.mapInArrow(run, "gap bigint, filler bigint")


def _induced(open_: DataFrame, forms: DataFrame) -> DataFrame:
    """(gap): the gaps of suspects that other units fill in at least VARIES ways."""
    wanted = open_.where("gap IS NOT NULL").select(F.explode(F.array("gap", "lead")).alias("x"))
    bitmap = _bitmap(wanted)
    if bitmap is None:
        return open_.where("FALSE").select("gap")
    fillers = _fillers(forms, bitmap).distinct().groupBy("gap").agg(F.count(F.lit(1)).alias("ways"))
    return kept(fillers.where(F.col("ways") >= VARIES).select("gap"))


def _judged(page: DataFrame) -> DataFrame:
    """doc_id, text: the texts that are pages, of page units with long_n, short_n and texts (in how many different texts).

    A longer one also needs notices, and what goes along with them, in half of its units.
    """
    elsewhere = F.col("long_n") * 5 > F.col("short_n")
    told = F.col("notice") | F.col("beside")
    belongs = ~elsewhere & (told | (F.col("texts") >= 3))
    much = F.col("short") | (F.avg(told.cast("int")).over(Window.partitionBy("doc_id", "text")) >= 0.5)
    p = page.select("doc_id", "text", (belongs & much).alias("belongs"), (F.col("notice") & ~elsewhere).alias("says"))
    return p.groupBy("doc_id", "text").agg(F.min("belongs").alias("all"), F.max("says").alias("says")).where("all AND says").select("doc_id", "text")


def _pages(page: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, text: the texts that are pages, whatever their length."""
    longer = page.where("NOT short")
    seen = longer.groupBy("skeleton").agg(F.count_distinct("text").alias("more"))
    known = page.join(units, "skeleton", "left").join(seen, "skeleton", "left").fillna(0, ["long_n", "short_n", "maybe_n", "more"])
    known = known.withColumn("texts", F.col("short_n") + F.col("more"))
    first = _judged(known.where("NOT short").withColumn("short_n", F.col("short_n") + F.col("maybe_n")))
    sides = longer.join(first.withColumn("page", F.lit(True)), ["doc_id", "text"], "left").groupBy("skeleton")
    sides = sides.agg(F.count_if(F.col("page").isNull()).alias("as_long"), F.count_if("page").alias("as_page"))
    last = known.join(sides, "skeleton", "left").fillna(0, ["as_long", "as_page"])
    return _judged(last.withColumns({"long_n": F.col("long_n") + F.col("as_long"), "short_n": F.col("short_n") + F.col("as_page")}))


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, reason): the documents to leave out; reason is residue, filler or notice.

    Null, empty and blank texts are no case, nor are texts that quote, explain
    or report such things. Documents without an id are left out; repeated rows
    count once per row in the statistics and give one row per reason. An empty
    table gives no rows. How often a placeholder form repeats does not matter:
    only one that is spoken of, and never filled or varied, is fixed text.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = kept(spread(rows).mapInArrow(_rows, ROWS))
    units = rows.where("kind = 'unit'").groupBy("skeleton").agg(*[F.sum(c).alias(c) for c in ("long_n", "short_n", "maybe_n")])
    forms = rows.where("kind = 'unit'").groupBy("skeleton").agg(F.first("form").alias("form")).select("form")
    open_ = rows.where("kind = 'open'").select("doc_id", "skeleton", "slot", "value", "name", "strong", "spoken", "gap", "lead")
    induced = _induced(open_, forms).withColumn("induced", F.lit(True))
    open_ = open_.drop("lead").join(induced, "gap", "left").drop("gap")
    placed = open_.where("slot >= 0")
    slots = placed.groupBy("skeleton", "slot").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    slots = slots.join(units, "skeleton", "left").select(
        "skeleton", "slot", ((F.coalesce(F.col("long_n") + F.col("short_n") + F.col("maybe_n"), F.lit(0)) > 0) | (F.col("lo") != F.col("hi"))).alias("real")
    )
    judged = placed.join(slots, ["skeleton", "slot"])
    names = judged.where("strong AND real AND name <> ''").select("name").distinct().withColumn("known", F.lit(True))
    left_over = judged.join(names, "name", "left").where(
        F.col("real") | ((F.col("strong") | F.col("known") | F.col("induced")) & ~F.col("spoken"))
    )
    bare = open_.where("slot < 0 AND induced AND NOT spoken")
    page = rows.where("kind = 'page'").select("doc_id", "text", "skeleton", "short", "notice", "beside")
    pages = _pages(page, units)
    return (
        left_over.select("doc_id", F.lit("residue").alias("reason"))
        .unionByName(bare.select("doc_id", F.lit("residue").alias("reason")))
        .unionByName(rows.where("kind = 'filler'").select("doc_id", F.lit("filler").alias("reason")))
        .unionByName(pages.select("doc_id", F.lit("notice").alias("reason")))
        .distinct()
        .withColumnRenamed("doc_id", doc_id)
    )
