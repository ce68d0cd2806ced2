"""Fixed values of the term model: words and letters that results depend on."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# English and French question scaffolding, not content.
STOPWORDS = tuple(
    """
    the a an is are was were be been being do does did how what why when where which who whom this that these those
    of in on to for with and or but if then else than as at by from into about it its i you we they he she there here
    can could should would will shall may might must have has had not no yes so such only any some all get set use used
    using work works working handle handled happen happens default value values please explain tell me my our
    le la les de des du un une est sont que qui quoi quel quelle quels quelles pour dans avec entre sur par pas plus et
    ou où ce cette ces se sa son ses leur leurs comment pourquoi quand fait faire peut doit être avoir il elle nous vous
    ils elles au aux si ne
    """.split()
)

# Lower-case letters that count as the same letter, base letter first.
LETTER_CLASSES = (
    "aàáâãäåāăą",
    "cçćĉċč",
    "dďđ",
    "eèéêëēĕėęě",
    "gĝğġģ",
    "iìíîïĩīĭįı",
    "lĺļľŀł",
    "nñńņň",
    "oòóôõöøōŏő",
    "rŕŗř",
    "sśŝşš",
    "tţťŧ",
    "uùúûüũūŭůűų",
    "yýÿŷ",
    "zźżž",
)

# Host sets, parameter names and limits of citation and cache rules.
API_HOSTS = ("eutils.ncbi.nlm.nih.gov", "api.crossref.org", "api.openalex.org", "api.semanticscholar.org", "export.arxiv.org")
ID_PARAMS = ("id", "ids", "uid", "uids", "pmid", "doi", "identifier")
DEAD_LINK_STATUS = (404, 410, 451, 403)


@lru_cache(maxsize=1)
def class_of() -> dict[str, str]:
    """Letter to its class, for pattern building."""
    return {ch: letters for letters in LETTER_CLASSES for ch in letters}


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """``(from, to)`` of a character translation that removes accents, by rule over the BMP.

    A letter of a class maps to its base; any other character maps to what is
    left of its canonical decomposition without marks, if that is one character.
    """
    known = {ch: letters[0] for letters in LETTER_CLASSES for ch in letters}
    source, target = [], []
    for code in range(0x80, 0xFFFE):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        base = known.get(ch)
        if base is None:
            bare = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.category(c).startswith("M"))
            base = bare if len(bare) == 1 else ch
        if base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)
