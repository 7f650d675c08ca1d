"""Quality rules, line first: clean each line, then judge what is left of the document.

Every line is held against rules for punctuation, navigation and boilerplate: by its signs
and their share, by separators between few words, and by phrases of four languages, as a
line's language isn't known. Lines that fail any rule are removed. A document that loses more than ``MAX_LOST`` of the bytes of its
words, or keeps fewer than ``MIN_WORDS`` words, is rejected.

Defined results. Words are runs of characters other than ASCII white space. Null text:
no words, rejected. Lines without a word are neither judged nor counted. Repeated
documents are judged one by one. An empty table gives no rows. Texts are read whole; a
text costs memory in proportion to its length, and batches are bounded in bytes.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_struct

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEATED_PERCENT, SYMBOLS = 50, 50, b"#*$%&|<>"
#: Fixed values of the line rules; texts are UTF-8 bytes throughout.
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
NAVIGATION = tuple(c.encode() for c in "|»›→•·")
#: By language: whole lines that are links, and what only boilerplate says.
LINK_WORDS = {
    "en": "home,login,log in,sign in,sign up,menu,next,previous,share,tweet,search,contact,sitemap,subscribe",
    "de": "startseite,anmelden,abmelden,registrieren,menü,weiter,zurück,teilen,suche,kontakt,impressum,abonnieren",
    "fr": "accueil,connexion,se connecter,s'inscrire,menu,suivant,précédent,partager,rechercher,contact,plan du site,s'abonner",
    "es": "inicio,iniciar sesión,registrarse,menú,siguiente,anterior,compartir,buscar,contacto,mapa del sitio,suscribirse",
}
BOILERPLATE = {
    "en": (
        "all rights reserved", "©", "copyright (c)", "terms of use", "terms of service", "privacy policy", "cookie policy",
        "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled", "javascript is required",
        "lorem ipsum", "read more", "click here", "subscribe to our", "subscribe to the", "licensed under the", "powered by",
        "skip to content", "skip to main content",
    ),
    "de": (
        "alle rechte vorbehalten", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookies akzeptieren",
        "alle cookies akzeptieren", "javascript aktivieren", "weiterlesen", "hier klicken", "newsletter abonnieren", "zum inhalt springen",
    ),
    "fr": (
        "tous droits réservés", "conditions d'utilisation", "conditions générales", "politique de confidentialité", "accepter les cookies",
        "accepter tous les cookies", "activer javascript", "lire la suite", "cliquez ici", "abonnez-vous à", "aller au contenu",
    ),
    "es": (
        "todos los derechos reservados", "condiciones de uso", "términos y condiciones", "política de privacidad", "aceptar cookies",
        "aceptar todas las cookies", "activar javascript", "leer más", "haga clic aquí", "suscríbete a", "saltar al contenido",
    ),
}
_LINKS = frozenset(x.encode() for own in LINK_WORDS.values() for x in own.split(","))
_BOILERPLATE = tuple(x.encode() for own in BOILERPLATE.values() for x in own)
MAX_SYMBOL_SHARE, MAX_LINE_REPEAT, MAX_LOST = 0.10, 0.5, 0.40
PLAIN = re.compile(rb"[0-9A-Za-z]")

VERDICT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("cleaned", T.StringType())]
)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in ``words``."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    v = len(number)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 2_000_000:  # v cubed must stay below 2^63
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * v + ids[2:]
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    found = np.isin(keys, twice)
    hit = np.zeros(n, bool)
    for j in range(3):
        hit[j : j + len(keys)] |= found
    return int(hit.sum())


def line_fails(line: bytes, words: list[bytes], navigation: bool = True, boilerplate: bool = True, repeats: int | None = None) -> str | None:
    """The rule that removes the line, or None.

    ``navigation`` and ``boilerplate`` are false, and ``repeats`` is small, where the
    whole text has shown that these rules can't apply.
    """
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols and symbols > MAX_SYMBOL_SHARE * sum(map(len, words)):
        return "punctuation"
    if not PLAIN.search(line) and not any(map(str.isalnum, line.decode("utf-8"))):
        return "punctuation"
    if navigation and len(words) >= 3 and sum(map(line.count, NAVIGATION)) * 3 >= len(words):
        return "navigation"
    if len(words) <= 3 and b" ".join(words).lower().rstrip(b" >:.!") in _LINKS:
        return "navigation"
    if boilerplate:
        low = line.lower()
        if any(x in low for x in _BOILERPLATE):
            return "boilerplate"
    least = MAX_LINE_REPEAT * len(words)
    if len(words) >= 10 and (repeats is None or repeats > least) and repeated_words(words) > least:
        return "repetition"
    return None


def judge(text: bytes, with_text: bool = True) -> tuple:
    words = text.split()  # at ASCII white space
    n_words = len(words)
    low = text.lower()  # A-Z only
    word_chars = len(text.decode("utf-8")) - sum(map(text.count, SPACES))
    word_bytes = sum(map(len, words))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    n_repeat = repeated_words(words)
    navigation = any(c in text for c in NAVIGATION)
    boilerplate = any(x in low for x in _BOILERPLATE)
    seen: set[bytes] = set()
    n_dup, kept, kept_bytes, kept_words = 0, [], 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            kept.append(line)
            continue
        n_dup += line in seen
        seen.add(line)
        if line_fails(line, own, navigation, boilerplate, n_repeat) is None:
            kept.append(line)
            kept_bytes += sum(map(len, own))
            kept_words += len(own)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEATED_PERCENT * n_words
    good = not base_failed and kept_words >= MIN_WORDS and word_bytes - kept_bytes <= MAX_LOST * word_bytes
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, good, b"\n".join(kept).decode("utf-8") if with_text else None


def apply_rules(docs: DataFrame, text_col: str = "text", out: str = "rules", with_text: bool = True) -> DataFrame:
    """``docs`` with the struct ``out``: the counts, ``base_failed``, ``kept`` and ``cleaned``.

    ``cleaned`` is the text without the removed lines (null if ``with_text`` is off).
    """
    names = VERDICT.names

    def work(texts: list[bytes]) -> dict:
        got = [judge(t, with_text) for t in texts]
        return dict(zip(names, zip(*got, strict=True) if got else [[]] * len(names), strict=True))

    return with_struct(docs, text_col, out, VERDICT, lambda: work)
