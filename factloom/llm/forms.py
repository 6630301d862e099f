"""Visually identical text with different characters (problem 10).

Method: every token that holds letters outside the Latin script is resolved by intersecting the script sets of its
letters, where a look-alike letter also counts for the scripts it can stand for. That tells tokens of mixed scripts and whole-script
look-alikes apart, and selects the spelling: a token of one script stays as it is; one of mixed scripts is spelled in a script that
can write all its letters (Latin first) if there is one; a whole-script look-alike is spelled in Latin letters. The remaining
differences (full width, composition, ligatures, invisible characters, kinds of space) are then normalised. That is
``consistent_spelling``. The form that texts are compared by goes one step further, ``consistent_form``: each letter of the spelling
that is shaped like a Latin one becomes that letter, also within words of another script.

Cases: null -> null; a text that shows nothing keeps its (possibly empty) form but joins no class; any length; line
breaks, tabs, case, accents, digits, raised signs, punctuation and the number of spaces stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import once, settled, tune

# Letters shaped like a Latin letter, by script.
CYRILLIC_SHAPES = dict(zip("АВЕКМНОРСТУХІЈЅԌԚԜҮӀаеорсухіјѕһԁԛԝӏѵү", "ABEKMHOPCTYXIJSGQWYIaeopcyxijshdqwlvy"))
GREEK_SHAPES = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαγικνορυχϲ", "ABEZHIKMNOPTYXCjayikvopuxc"))
ARMENIAN_SHAPES = dict(zip("ՍՕՏԼոսօհցզ", "UOSLnuohgq"))
CHEROKEE_SHAPES = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHGZSVLCPKB"))
# Format characters that can be seen (number and verse signs), which stay.
SEEN_FORMAT = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}

SHAPES = CYRILLIC_SHAPES | GREEK_SHAPES | ARMENIAN_SHAPES | CHEROKEE_SHAPES
SCRIPT_OF_SHAPE = {c: s for s, t in (("Cyrl", CYRILLIC_SHAPES), ("Grek", GREEK_SHAPES), ("Armn", ARMENIAN_SHAPES), ("Cher", CHEROKEE_SHAPES)) for c in t}
#: For each Latin shape, the scripts that own a letter of that shape.
SCRIPTS_OF_LATIN: dict[str, frozenset[str]] = {}
for _c, _l in SHAPES.items():
    SCRIPTS_OF_LATIN[_l] = SCRIPTS_OF_LATIN.get(_l, frozenset({"Latn"})) | {SCRIPT_OF_SHAPE[_c]}
#: For each script, its letter of each Latin shape, the first of several.
LETTER_OF: dict[str, dict[str, str]] = {"Latn": {}}
for _c, _l in SHAPES.items():
    LETTER_OF.setdefault(SCRIPT_OF_SHAPE[_c], {}).setdefault(_l, _c)

_NAMED = [(s, regex.compile(p)) for s, p in (("Latn", r"\p{Script=Latin}"), ("Cyrl", r"\p{Script=Cyrillic}"), ("Grek", r"\p{Script=Greek}"), ("Armn", r"\p{Script=Armenian}"), ("Cher", r"\p{Script=Cherokee}"), ("Jpan", r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}]"))]
_TOKEN = regex.compile(r"[\p{L}\p{M}]*[^\x00-\x7F\W\d_][\p{L}\p{M}]*")
_SHAPED = re.compile("[" + "".join(SHAPES) + "]")


@lru_cache(maxsize=4096)
def script_of(c: str) -> str | None:
    """Script of one letter; None for marks and signs that every script shares."""
    if unicodedata.category(c).startswith("M"):
        return None
    return next((s for s, p in _NAMED if p.match(c)), "Zyyy" if not c.isalpha() else "other")


@lru_cache(maxsize=65536)
def resolve(token: str) -> tuple[str, str]:
    """(spelling, kind) of a token of letters and marks.

    kind: ``single`` (one script and no whole-script look-alike), ``whole`` (all letters of one other script, all shaped
    like Latin ones) or ``mixed`` (no script holds all its letters as written). The spelling is of the one script that the resolved set
    selects; a mixed token that no script can write stays.
    """
    base = unicodedata.normalize("NFD", token)
    written: set[str] = set()
    able: frozenset[str] | None = None
    for c in base:
        s = script_of(c)
        if s is None or s == "Zyyy":
            continue
        written.add(s)
        can = SCRIPTS_OF_LATIN.get(SHAPES.get(c, c), frozenset({s}))
        able = can if able is None else able & can
    if not able or written == {"Latn"} or len(written) == 1 and "Latn" not in able:
        return token, "mixed" if len(written) > 1 else "single"
    script = "Latn" if "Latn" in able else min(able)
    own = LETTER_OF[script]
    spelled = "".join(c if script_of(c) in (script, None, "Zyyy") else own.get(SHAPES.get(c, c), SHAPES.get(c, c)) for c in base)
    return unicodedata.normalize("NFC", spelled), "mixed" if len(written) > 1 else "whole"


@lru_cache(maxsize=65536)
def _shown(token: str) -> str:
    """The spelling of a token, with a Latin letter for each letter shaped like one."""
    spelling = resolve(token)[0]
    base = unicodedata.normalize("NFD", spelling)
    return unicodedata.normalize("NFC", _SHAPED.sub(lambda m: SHAPES[m.group()], base)) if _SHAPED.search(base) else spelling


def _single(c: str) -> str | None:
    """What one character shows, None where it shows itself."""
    o, kind = ord(c), unicodedata.category(c)
    if kind == "Zs":
        return " " if c != " " else None
    if kind == "Cf" and o not in SEEN_FORMAT or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return ""
    if kind == "Cc" and c not in "\t\n\v\f\r\x85":
        return ""
    if 0xFF01 <= o <= 0xFFEE or 0xFB00 <= o <= 0xFB06 or 0xFB13 <= o <= 0xFB17 or unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", c)
    return None


class _Shown(dict):
    """Translation table that learns each character when it is first met."""

    def __missing__(self, o: int) -> int | str:
        shown = _single(chr(o))
        self[o] = out = o if shown is None else shown
        return out


_TABLE = _Shown()


def _normal(text: str) -> str:
    """Each character but the look-alikes replaced by what it shows."""
    out = text.translate(_TABLE)
    return out if out.isascii() else unicodedata.normalize("NFC", out)


def _spelled(normal: str, spell: Callable[[str], str]) -> str:
    return normal if normal.isascii() else unicodedata.normalize("NFC", _TOKEN.sub(lambda m: spell(m.group()), normal))


def consistent_spelling(text: str | None) -> str | None:
    """The text with every token in one script where its letters allow it; words of other alphabets stay in theirs."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    return _spelled(_normal(text), lambda t: resolve(t)[0])


def consistent_form(text: str | None) -> str | None:
    """The text as it looks, each character replaced by what it shows: the consistent spelling, with Latin letters for all that are shaped
    like them."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    return _spelled(_normal(text), _shown)


def _report(text: str | None) -> tuple:
    if text is None:
        return None, None, None, None
    normal = _normal(text)
    kinds = [] if normal.isascii() else [resolve(t)[1] for t in _TOKEN.findall(normal)]
    return _spelled(normal, _shown), _spelled(normal, lambda t: resolve(t)[0]), kinds.count("mixed"), kinds.count("whole")


@F.pandas_udf(T.StringType())
def _form_udf(s: pd.Series) -> pd.Series:
    return s.map(consistent_form)


_REPORT = T.StructType().add("form", "string").add("spelling", "string").add("n_mixed", "integer").add("n_whole", "integer")


@F.pandas_udf(_REPORT)
def _report_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_report(x) for x in s], columns=_REPORT.names).astype({"n_mixed": "Int32", "n_whole": "Int32"})


#: Texts that are their own form: printable ASCII, tabs and line breaks.
_PLAIN = r"[^\t-\r\x20-\x7E]"


def form_of(col: Column) -> Column:
    """Consistent form of a text column; plain ASCII texts stay in the JVM."""
    return F.coalesce(_form_udf(F.when(col.rlike(_PLAIN), col)), col)


def with_forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, spelling, n_mixed, n_whole): each text in its one form and in its consistent spelling, with its tokens of mixed scripts and
    of whole-script look-alikes."""
    tune(docs.sparkSession)
    col = F.col(text)
    rows = once(docs.select(F.col(key), col.alias("_t")), key, "_t", _r=_report_udf(F.when(F.col("_t").rlike(_PLAIN), F.col("_t"))))
    count = lambda c: F.coalesce(F.col(f"_r.{c}"), F.when(F.col("_t").isNotNull(), F.lit(0))).alias(c)
    return rows.select(key, *[F.coalesce(F.col(f"_r.{c}"), "_t").alias(c) for c in ("form", "spelling")], count("n_mixed"), count("n_whole"))


def form_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form_key, text_key): 128-bit digests of form and text. Documents whose text is null or shows nothing are left out."""
    tune(docs.sparkSession)
    rows = once(docs.select(F.col(key), F.col(text).alias("_t")).filter("_t is not null"), key, "_t", _f=form_of(F.col("_t")))
    return rows.filter(F.col("_f").rlike(r"[^\s\x85\u2028\u2029]")).select(key, F.unhex(F.md5("_f")).alias("form_key"), F.unhex(F.md5("_t")).alias("text_key"))


def same_form_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), a < b: documents whose texts differ as stored and have the same form.

    Only digests are written and shuffled. Texts that repeat exactly are one class; classes are paired, never their members among
    themselves, so the work follows the result even if one class holds a third of all rows (AQE splits its partitions).
    """
    rows = settled(form_classes(docs, key, text), "forms")
    kinds = rows.select("form_key", "text_key").distinct()
    many = kinds.groupBy("form_key").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1").select("form_key")
    # the members of forms with more than one text; everything else ends here
    live = settled(rows.join(many, "form_key", "left_semi"), "alike")
    kinds = live.select("form_key", "text_key").distinct()
    pairs = kinds.select("form_key", F.col("text_key").alias("ta")).join(kinds.select("form_key", F.col("text_key").alias("tb")), "form_key").filter("ta < tb")
    a = live.select("form_key", F.col("text_key").alias("ta"), F.col(key).alias("_a"))
    b = live.select("form_key", F.col("text_key").alias("tb"), F.col(key).alias("_b"))
    both = pairs.join(a, ["form_key", "ta"]).join(b, ["form_key", "tb"])
    return both.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"))
